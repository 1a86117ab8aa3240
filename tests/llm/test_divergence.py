import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from checks.compare import connect, differences
from cotaflow.llm import divergence, queries

from .corpus import awkward_texts, collected, documents, lower

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least):
    """(lang, source, text) rows: every kept term of every group against every other group."""
    uses, holding, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = TERM.findall(lower(text))
        uses[lang, source].update(terms)
        holding[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in holding[lang].items() if n >= least]
        total = {s: sum(uses[lang, s][t] for t in kept) for s in sources}
        everywhere = sum(total.values())

        def rate(n, size):
            return 1 + 10**9 * (n + 2) // (size + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pairs = [(o, sum(f(rate(uses[lang, s][t], total[s]), rate(uses[lang, o][t], total[o])) for t in kept)) for o in sources - {s}]
            terms = []
            for t in kept:
                p, q = rate(uses[lang, s][t], total[s]), rate(sum(uses[lang, o][t] for o in sources), everywhere)
                if uses[lang, s][t] and p > q:
                    terms.append((t, f(p, q)))
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1) if part == "pair" or k <= 10]
    return sorted(out, key=repr)


def table(spark, rows):
    frame = documents(spark, [(i, r[2]) for i, r in enumerate(rows)]).drop("lang", "source")
    own = spark.createDataFrame(pa.table({"doc_id": list(range(len(rows))), "lang": pa.array([r[0] for r in rows], pa.string()), "source": pa.array([r[1] for r in rows], pa.string())}))
    return frame.join(own, "doc_id")


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_against_every_pair_and_term(spark):
    rng = random.Random(3)
    texts = [t for _, t in awkward_texts(7)] * 2 + ["Only HERE Ünder", "漢字 words"] * 3
    rows = [(rng.choice(["en", "fr", None, "xx"]), rng.choice([None, "a", "b", "c", "d", "ü", "Z"]), t) for t in texts]
    rows += [("lone", "one", "a b c"), ("none", "p", ""), ("none", "q", None), ("none", None, "12 34")]
    rows += [("en", "hot", texts[0])] * 40
    for least in (1, 10):
        assert collected(divergence.audit(table(spark, rows), least_documents=least), *COLUMNS) == plain(rows, least)


def test_many_sources_and_ties(spark):
    rows = [("en", f"s{i:03d}", "same words in all " + ("odd " * (i % 4))) for i in range(90)]
    assert collected(divergence.audit(table(spark, rows)), *COLUMNS) == plain(rows, 10)


def test_empty_table(spark):
    assert divergence.audit(table(spark, [])).count() == 0
    assert divergence.audit(table(spark, [(None, None, None)])).count() == 0


def test_tree_nodes():
    paths = [[1, 2, 3], [1, 2, 4], [1, 2, 4, 5], [1, 3], [2], [2, 9]]
    rows = np.array([2, 1, 5, 1, 4, 1])
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in paths])))
    flat = np.concatenate(paths)
    starts, items, through = divergence.tree_nodes(flat, bounds, rows)
    got = sorted((tuple(flat[a : b + 1].tolist()), int(n)) for a, b, n in zip(starts, items, through, strict=True))
    want = Counter()
    for path, n in zip(paths, rows, strict=True):
        for k in range(len(path)):
            want[tuple(path[: k + 1])] += int(n)
    assert got == sorted(want.items())


def test_pair_sums_fold_and_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 7)
    rng = np.random.default_rng(1)
    sums, want = divergence.PairSums(), Counter()
    for _ in range(30):
        keys, values = rng.integers(0, 9, 5), rng.integers(-50, 50, 5)
        sums.add(keys, values)
        for k, v in zip(keys.tolist(), values.tolist(), strict=True):
            want[k] += v
    keys, values = sums.fold()
    assert dict(zip(keys.tolist(), values.tolist(), strict=True)) == dict(want)


def test_query_equals_its_twin(spark):
    sf = "/root/testdata/sf0.001"
    name = "op12_source_divergence"
    assert not differences(spark, connect(sf), sf, queries.QUERIES[name], queries.ORACLES[name])
