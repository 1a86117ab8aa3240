import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cotaflow.llm import crosspolytope, licenses, search

from .corpus import awkward_texts, collected, documents, letter_words


def plain_bm25(rows, queries, k):
    texts = [(i, letter_words(t)) for i, t in rows]
    n, mean = len(texts), sum(len(w) for _, w in texts) / len(texts)
    frequency = Counter(x for _, w in texts for x in set(w))
    out = []
    for name, text in queries:
        scored = []
        for i, w in texts:
            counts, score = Counter(w), 0.0
            for x in sorted(set(letter_words(text)) & set(w)):
                idf = math.log(1 + (n - frequency[x] + 0.5) / (frequency[x] + 0.5))
                score += idf * counts[x] * 2.2 / (counts[x] + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score > 0:
                scored.append((-round(score, 6), i is None, i or 0))
        out += [(name, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard, k", [(16384, 10), (20, 3)])
def test_bm25(spark, monkeypatch, shard, k):
    monkeypatch.setattr(search, "SHARD", shard)
    monkeypatch.setattr(search, "QUERY_BLOCK", 9)
    rng = random.Random(1)
    rows = [*awkward_texts(11), (None, "one without id")] + [(500 + i, " ".join(f"t{int(rng.paretovariate(0.6)) % 90}" for _ in range(40))) for i in range(300)]
    queries = [r for r in rows if r[0] is not None and r[0] % 9 == 0]
    docs = documents(spark, rows)
    asked = documents(spark, queries).withColumnRenamed("doc_id", "query_id")
    found = search.top_k(docs, asked, k).withColumn("score", F.round("score", 6))
    want = plain_bm25(rows, queries, k)
    got = collected(found, "query_id", "rank", "doc_id", "score")
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_bm25_without_texts(spark):
    empty, blank = documents(spark, []), documents(spark, [(1, None), (2, ""), (3, "..!")])
    for docs in (empty, blank):
        assert search.top_k(docs, docs.withColumnRenamed("doc_id", "query_id")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(
        pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "rank": ["x"] * len(rows)})
    )


def plain_nearest(rows, every, k):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in good:
        if q % every == 0:
            other = {i: float(np.dot(np.array(a, np.float64), np.array(v, np.float64))) for i, v in good if i != q and len(v) == len(a)}
            out[q] = sorted(other.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]
    return out


def float32(rows):
    return [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]


def test_nearest_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24))
    x[:1000] *= rng.uniform(0.5, 4, (1000, 1))  # unlike lengths
    x[1500:2500] = x[1500]  # a third of all rows are one vector
    rows = float32([(i, v.tolist()) for i, v in enumerate(x)])
    found = crosspolytope.nearest(vectors(spark, rows), F.col("vec_id") % 100 == 0, 20)
    got = {}
    for q, rank, i, score in sorted(map(tuple, found.collect())):
        got.setdefault(q, []).append((rank, i, score))
    want = plain_nearest(rows, 100, 20)
    assert got.keys() == want.keys() and all([r for r, *_ in g] == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    full = dict(rows)
    for q, g in got.items():
        for _, i, score in g:
            assert score == pytest.approx(float(np.dot(np.array(full[q]), np.array(full[i]))), abs=1e-9)
        assert [i for _, i, _ in g] == [i for _, i, s in sorted(g, key=lambda r: (-r[2], r[1]))]


def test_recall_and_work_on_the_test_table(spark):
    """A quarter of the inner products of brute force finds nine in ten of the nearest, at least."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    x = np.array([v for _, v in rows], float)
    ids = np.array([i for i, _ in rows])
    asks = np.flatnonzero(ids % 20 == 0)
    scores = x[asks] @ x.T
    scores[np.arange(len(asks)), asks] = -np.inf
    want = {int(ids[q]): set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for q, s in zip(asks, scores, strict=True)}
    got = {}
    for r in crosspolytope.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & want[q]) / 20 for q in want]) >= 0.95
    assert crosspolytope.PROBES <= 0.25


def test_vectors_of_extreme_length(spark):
    """Lengths whose squares are beyond doubles, beside common ones."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(600, 8)) * 10.0 ** rng.choice([-200, -3, 0, 120], 600)[:, None]
    table = spark.createDataFrame(pa.table({"vec_id": list(range(600)), "embedding": pa.array(x.tolist(), pa.list_(pa.float64()))}))
    found = crosspolytope.nearest(table, F.col("vec_id") % 100 == 0).collect()
    assert len(found) == 6 * 20
    scores = x[::100] @ x.T
    scores[np.arange(6), np.arange(0, 600, 100)] = -np.inf
    best = {q * 100: set(np.argsort(-s, kind="stable")[:20].tolist()) for q, s in enumerate(scores)}
    assert np.mean([r["vec_id"] in best[r["query_id"]] for r in found]) >= 0.9


def test_nearest_of_few_and_odd_vectors(spark):
    """Fewer candidates than asked for: all of them; those that take no part are nowhere."""
    rows = float32(
        [(0, [1, 0, 0]), (20, [0, 2, 0]), (3, [-1, 0, 0]), (4, [1e-3, 0, 1e-3]), (5, None), (6, [0, 0, 0]), (7, [1, None, 0]), (8, [1, float("nan"), 0])]
        + [(40, [float("inf"), 0, 0]), (9, []), (None, [1, 1, 1]), (10, [1, 1]), (3, [-1, 0, 0]), (11, [0, 50, 0])]
    )
    found = crosspolytope.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20)
    want = plain_nearest(rows, 20, 20)
    assert collected(found, "query_id", "rank", "vec_id") == sorted(((q, r, i) for q, x in want.items() for r, (i, _) in enumerate(x, 1)), key=repr)
    assert crosspolytope.nearest(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def plain_phrases(text):
    found, labels = [], set()
    have = letter_words(text)
    for wording in licenses.PHRASES:
        own = wording.words()
        at = [k for k in range(len(have) - len(own) + 1) if have[k : k + len(own)] == own]
        found += at
        labels |= {wording.label} if at else set()
    return len(have), len(found), min(found, default=None), max(found, default=None), ",".join(sorted(labels))


NOTICE_TEXTS = [
    ("Licensed under the Apache License, Version 2.0 (the thing)", "apache,apache-2.0", 1.0),
    ("Licensed under the APACHE License, in its Version 2.0", "apache,apache-2.0", None),
    ("apache something license", "", None),
    ("mit license mit license MIT-License", "mit", 1.0),
    ("the GNU General Public License license of GNU General Public License", "gpl", 1.0),
    ("the GNU General Private License", "", None),
    ("Permission is hereby granted, free of charge, to any person who is obtaining a copy of that software", "mit-notice", None),
    ("éCC BY", "", None),
    ("", "", 0.0),
    (None, "", 0.0),
]


def test_licences(spark):
    rows = [*enumerate(t for t, *_ in NOTICE_TEXTS)]
    rows += [(i + 100, t) for i, t in awkward_texts(12)] + [(0, rows[0][1]), (0, "released under the mit license"), (None, "cc by cc by")]
    result, spans = licenses.scan(documents(spark, rows))
    got = collected(result, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == sorted(((i, *plain_phrases(t)) for i, t in rows), key=repr)
    by_id = {r["doc_id"]: r for r in result.where("doc_id between 1 and 50").collect()}
    for i, (_, labels, score) in enumerate(NOTICE_TEXTS):
        if i:
            assert by_id[i]["labels"] == labels and 0 <= by_id[i]["score"] <= 1
            assert score is None or by_id[i]["score"] == score
    assert spans.where("doc_id = 3").count() == 3
    assert licenses.scan(documents(spark, []))[0].count() == 0


#: The text of the MIT licence without its title and holders.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_a_whole_licence_as_wording(spark):
    """More places than bits of a long: a whole text, one with words put in and left out, a half and scattered words."""
    whole = licenses.Wording("mit-text", MIT)
    have = MIT.split()
    assert len(whole.words()) > 150
    changed = [w for i, w in enumerate(have) if i % 40 != 7]
    changed[60:60] = ["oh", "my"]
    rows = [(1, "before " + MIT + " after"), (2, " ".join(changed)), (3, " ".join(have[: len(have) // 2])), (4, " ".join(sorted(have))), (5, MIT + " . " + MIT)]
    result, spans = licenses.scan(documents(spark, rows), phrases=(), notices=(whole,))
    found = {r["doc_id"]: r for r in result.collect()}
    assert [found[i]["labels"] for i in range(1, 6)] == ["mit-text", "mit-text", "", "", "mit-text"]
    assert found[1]["score"] == 1 and 0.8 < found[2]["score"] < 1 and 0.4 < found[3]["score"] < 0.6
    words = len(whole.words())
    assert collected(spans.where("doc_id in (1, 5)"), "doc_id", "first_word", "last_word") == [(1, 1, words), (5, 0, words - 1), (5, words, 2 * words - 1)]
