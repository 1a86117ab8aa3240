"""SQL twins of the training-data queries that SQL can express, for an independent engine on the same tables.

They follow the definitions: all pairs, all windows, every document scored.  The other queries are tested against
plain versions, round trips and held-out labels.
"""

from __future__ import annotations

from cotaflow.llm.licenses import COVER, MERGE, NOTICES, PHRASES
from cotaflow.llm.urlrules import LOWER as SMALL
from cotaflow.llm.urlrules import RULES, UPPER

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
LETTER_WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {}

ORACLES["op1_bm25_search"] = f"""
WITH W AS (SELECT doc_id, {LETTER_WORDS} AS words FROM documents),
T AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS word FROM W) GROUP BY ALL),
S AS (SELECT count(*) AS n, avg(len(words)) AS mean FROM W),
F AS (SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM T, S GROUP BY word, n),
R AS (SELECT q.doc_id AS query_id, d.doc_id,
    sum(idf * d.tf * 2.2 / (d.tf + 1.2 * (0.25 + 0.75 * len(words) / mean))) AS score
    FROM T q JOIN F USING (word) JOIN T d USING (word) JOIN W ON W.doc_id = d.doc_id, S
    WHERE q.doc_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM R)
WHERE rank <= 10"""

ORACLES["op5_minhash_near_dedup"] = f"""
WITH RECURSIVE W AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS words FROM documents),
G AS (SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, array_to_string(words[i : i + 4], ' ') AS gram FROM W, range(1, len(words) - 3) AS r(i)
    UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM W WHERE len(words) BETWEEN 1 AND 4)),
N AS (SELECT doc_id, count(*) AS n FROM G GROUP BY doc_id),
B AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM G a JOIN G b USING (gram)
    WHERE a.doc_id <> b.doc_id GROUP BY ALL),
L AS (SELECT a, b FROM B JOIN N x ON x.doc_id = a JOIN N y ON y.doc_id = b
    WHERE 100 * common >= 75 * (x.n + y.n - common)),
C(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b, root FROM C JOIN L ON a = C.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM C LEFT JOIN N USING (doc_id) GROUP BY doc_id, n"""

ORACLES["op7_substring_dedup"] = f"""
WITH W AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS words FROM documents),
V AS (SELECT doc_id, i, array_to_string(words[i : i + 34], ' ') AS part FROM W, range(1, len(words) - 33) AS r(i)),
R AS (SELECT doc_id, i FROM V JOIN (SELECT part FROM V GROUP BY part HAVING count(*) > 1) USING (part)),
G AS (SELECT DISTINCT doc_id, i + j AS i FROM R, range(35) AS s(j)),
K AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM W) ANTI JOIN G USING (doc_id, i)
    GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM W LEFT JOIN K USING (doc_id)"""


def _wordings() -> str:
    rows = []
    for number, wording in enumerate([*PHRASES, *NOTICES]):
        words, k = wording.words(), wording.k
        grams = [" ".join(words[t : t + k]) for t in range(len(words) - k + 1)]
        rows += [f"({number}, '{wording.label}', {wording.phrase}, {len(grams)}, {k}, {t}, '{g}')" for t, g in enumerate(grams)]
    return ", ".join(rows)


ORACLES["op9_license_scan"] = f"""
WITH W AS (SELECT doc_id, {LETTER_WORDS} AS words FROM documents),
G(wording, label, phrase, grams, k, t, gram) AS (VALUES {_wordings()}),
D AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS place, k, array_to_string(words[i : i + k - 1], ' ') AS gram
    FROM W, (VALUES (2), (3)) AS sizes(k), range(1, len(words) - k + 2) AS r(i)),
V AS (SELECT doc_id, wording, label, phrase, grams, place - t AS diagonal, bit_or(1::BIGINT << t) AS bits,
    min(place) AS low, max(place) AS high FROM D JOIN G USING (k, gram) GROUP BY ALL),
M AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER own <= {MERGE} IS NOT TRUE THEN 1 ELSE 0 END AS begins
    FROM V WINDOW own AS (PARTITION BY doc_id, wording ORDER BY diagonal)),
S AS (SELECT doc_id, label, phrase, grams, bit_count(bit_or(bits)) / grams AS cover, min(low) AS low, max(high) AS high
    FROM (SELECT *, sum(begins) OVER (PARTITION BY doc_id, wording ORDER BY diagonal) AS span FROM M)
    GROUP BY doc_id, wording, label, phrase, grams, span),
F AS (SELECT *, CASE WHEN phrase THEN cover = 1 ELSE cover >= {COVER} AND high - low < 2 * grams + {2 * MERGE} END AS found
    FROM S)
SELECT doc_id, len(words) AS n_words, count(*) FILTER (WHERE found AND phrase) AS n_base,
    min(low) FILTER (WHERE found AND phrase) AS first_word, max(low) FILTER (WHERE found AND phrase) AS last_word,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found AND phrase), '') AS base_labels,
    coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE found), '') AS labels,
    coalesce(max(cover), 0.0) AS score
FROM W LEFT JOIN F USING (doc_id) GROUP BY doc_id, words"""

ORACLES["op12_source_divergence"] = f"""
WITH W AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {TERMS} AS terms FROM documents),
T AS (SELECT lang, source, doc, unnest(terms) AS term FROM W),
K AS (SELECT lang, term, count(*) AS uses FROM T GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
C AS (SELECT lang, source, term, count(*) AS uses FROM T SEMI JOIN K USING (lang, term) GROUP BY ALL),
L AS (SELECT lang, count(*) AS v, sum(uses) AS n FROM K GROUP BY lang),
G AS (SELECT lang, source, coalesce(sum(uses), 0) AS n FROM (SELECT DISTINCT lang, source FROM W) LEFT JOIN C USING (lang, source) GROUP BY ALL),
P AS (SELECT lang, source, term, coalesce(c.uses, 0) AS uses,
    1 + (1000000000::HUGEINT * (coalesce(c.uses, 0) + 2)) // (g.n + 2 * v) AS p, 1 + (1000000000::HUGEINT * (k.uses + 2)) // (l.n + 2 * v) AS q
    FROM G g JOIN L l USING (lang) JOIN K k USING (lang) LEFT JOIN C c USING (lang, source, term)),
S AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM P a JOIN P b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
R AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
    FROM G a JOIN G b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN S ON S.lang = a.lang AND S.source = a.source AND S.item = b.source
    UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM P WHERE uses > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM R)
WHERE part = 'pair' OR rank <= 10"""


def _given_rules() -> str:
    return ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in RULES)


ORACLES["op13_url_filter"] = rf"""
WITH U AS (SELECT row_number() OVER () AS row, page_id, coalesce(url, '') AS url,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after FROM pages),
H AS (SELECT row, page_id, url, translate(regexp_extract(after, '^[^/?#]*'), '{UPPER}', '{SMALL}') AS host,
    regexp_extract(after, '^[^/?#]*([^?#]*)', 1) AS path FROM U),
B(verdict, host, path) AS (VALUES {_given_rules()}),
G AS (SELECT row, arg_max(b.host || b.path, length(b.host || b.path)) AS rule, arg_max(b.verdict, length(b.host || b.path)) AS ruled
    FROM H JOIN B b ON (H.host = b.host OR ends_with(H.host, '.' || b.host)) AND starts_with(H.path, b.path) GROUP BY row),
D AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/')[:-2], lambda d: d <> '') AS dirs FROM H),
T AS (SELECT row, unnest(list_filter([
    'scheme:' || nullif(translate(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1), '{UPPER}', '{SMALL}'), ''),
    'tld:' || nullif(labels[-1], ''), 'site:' || CASE WHEN len(labels) > 1 THEN labels[-2] || '.' || labels[-1] END,
    'sub:' || nullif(CASE WHEN len(labels) > 2 THEN labels[1] END, ''), 'dir:' || dirs[1],
    'ext:' || nullif(regexp_extract(path, '\.([A-Za-z0-9]+)\z', 1), ''), 'arg:' || nullif(regexp_extract(url, '^[^?#]*\?([^#&=]+)', 1), '')],
    lambda t: t IS NOT NULL)) AS token FROM D WHERE host <> ''),
M AS (SELECT row, list_sort(list(token)) AS tokens FROM T GROUP BY row),
S AS (SELECT row, list_filter(list_transform(range(len(tokens)), lambda i: CASE WHEN (mask >> i) & 1 = 1 THEN tokens[i + 1] END), lambda t: t IS NOT NULL) AS part
    FROM M, range(1, 128) AS r(mask) WHERE mask < 1 << len(tokens)),
F AS (SELECT part, count(*) AS all_rows, count(*) FILTER (WHERE ruled = 'block') AS block, count(*) FILTER (WHERE ruled = 'allow') AS allow
    FROM S LEFT JOIN G USING (row) GROUP BY part),
N AS (SELECT ceil(0.01::DOUBLE * count(*)) AS least FROM pages),
R AS (SELECT part, verdict, rows, rows / all_rows AS confidence FROM (
    SELECT part, all_rows, 'block' AS verdict, block AS rows FROM F UNION ALL SELECT part, all_rows, 'allow', allow FROM F), N
    WHERE rows >= least AND rows / all_rows >= 0.9),
K AS (SELECT * FROM R a WHERE NOT EXISTS (SELECT 1 FROM R b WHERE b.verdict = a.verdict AND b.confidence >= a.confidence
    AND len(b.part) < len(a.part) AND list_has_all(a.part, b.part))),
X AS (SELECT row, first(array_to_string(part, ' ') ORDER BY confidence DESC, rows DESC, len(part), array_to_string(part, ' '), verdict) AS mined,
    first(verdict ORDER BY confidence DESC, rows DESC, len(part), array_to_string(part, ' '), verdict) AS mined_verdict, max(confidence) AS confidence
    FROM S JOIN K USING (part) GROUP BY row)
SELECT page_id, host, path, rule, coalesce(ruled, mined_verdict, 'allow') AS verdict,
    CASE WHEN rule IS NULL THEN mined END AS mined, CASE WHEN rule IS NULL THEN confidence END AS confidence
FROM H LEFT JOIN G USING (row) LEFT JOIN X USING (row)"""
