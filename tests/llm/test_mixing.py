from collections import defaultdict

import pyarrow as pa
import pytest

from cotaflow.llm import mixing
from cotaflow.sources.scratch import Staging

from .corpus import awkward_texts, collected, documents, words


def plain_targets(sizes, cap=3.0):
    """Share by weight, stop what is above, share the excess, again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    most = {s: cap * sizes[s] for s in order}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        target = fixed | {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = [s for s in rest if target[s] > most[s]]
        if not above:
            return target
        fixed |= {s: most[s] for s in above}


@pytest.mark.parametrize(
    "sizes",
    [{"a": 100, "b": 1000, "c": 10, None: 5}, {"z": 10}, {"a": 1, "b": 1, "c": 1, "d": 10000}, {"a": 0, "b": 7}, {"é": 5, "z": 50, "Z": 500, "": 3, None: 400}],
)
def test_targets(spark, sizes):
    table = spark.createDataFrame(pa.table({"source": pa.array(list(sizes), pa.string()), "source_size": list(sizes.values())}))
    found = {r["source"]: r["target"] for r in mixing.capped_targets(table, 3.0).collect()}
    assert found == pytest.approx(plain_targets(sizes))


def test_targets_of_many_sources(spark):
    """More sources than ranges, sizes over many orders of magnitude, so that caps are met round after round."""
    sizes = {f"s{i:04d}": 2 ** (i % 40) + i for i in range(2000)} | {None: 17}
    table = spark.createDataFrame(pa.table({"source": pa.array(list(sizes), pa.string()), "source_size": list(sizes.values())}))
    found = {r["source"]: r["target"] for r in mixing.capped_targets(table.repartition(5), 3.0).collect()}
    assert found == pytest.approx(plain_targets(sizes))


@pytest.mark.parametrize("piece", [mixing.PIECE, 7])
def test_a_third_of_the_rows_repeat(spark, monkeypatch, piece):
    """Repeated rows are handed copies together, alike but for one, also a group of more rows than one task writes."""
    monkeypatch.setattr(mixing, "PIECE", piece)
    rows = [(7, "a b c")] * 500 + [(None, "x y")] * 300 + [(1000 + i, "w " * (5 + i % 9)) for i in range(800)]
    sources = ["hot"] * 500 + [None] * 300 + ["hot" if i % 2 else "other" for i in range(800)]
    docs = spark.createDataFrame(
        pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows], "source": pa.array(sources, pa.string())})
    )
    found = collected(mixing.mix(docs), "doc_id", "source", "size", "target", "copies", "taken")
    assert len(found) == len(rows)
    taken, target = defaultdict(int), {}
    for _, source, _, goal, _, words_taken in found:
        taken[source] += words_taken
        target[source] = goal
    assert all(abs(taken[s] - target[s]) <= 15 for s in target)
    for i, n in ((7, 500), (None, 300)):
        copies = [c for j, _, _, _, c, _ in found if j == i]
        assert len(copies) == n and max(copies) - min(copies) <= 1 and max(copies) <= 3
    assert found == collected(mixing.mix(docs.repartition(3)), "doc_id", "source", "size", "target", "copies", "taken")


def test_mix(spark):
    rows = [*awkward_texts(10), (None, "no id at all"), (None, None)] + [(500 + i, "w " * (20 + i)) for i in range(300)]
    docs = documents(spark, rows)
    found = mixing.mix(docs)
    got = collected(found, "doc_id", "source", "size", "source_size", "target", "taken", "copies")
    sizes, taken = defaultdict(int), defaultdict(int)
    sources = [r["source"] for r in docs.collect()]
    for source, (_, text) in zip(sources, rows, strict=True):
        sizes[source] += len(words(text))
    want = plain_targets(sizes)
    assert collected(found, "doc_id", "size") == sorted(((i, len(words(t))) for i, t in rows), key=repr)
    for _, source, size, source_size, target, words_taken, copies in got:
        assert source_size == sizes[source] and target == pytest.approx(want[source])
        assert words_taken == size * copies and 0 <= copies <= 3
        taken[source] += words_taken
    for source in sizes:
        assert abs(taken[source] - want[source]) <= max(60, 0.02 * want[source]), source
    assert collected(mixing.mix(docs.repartition(7)), "doc_id", "size", "taken") == collected(found, "doc_id", "size", "taken")


def test_empty(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    assert collected(mixing.mix(documents(spark, [(1, None), (2, "")])), "doc_id", "size", "taken") == [(1, 0, 0), (2, 0, 0)]


def test_newton_meets_several_groupings_at_once(spark):
    cells = [("a", "x", 30), ("a", "y", 50), ("b", "x", 40), ("b", "y", 10)]
    table = spark.createDataFrame(pa.table({n: [c[i] for c in cells] for i, n in enumerate(("s", "l", "words"))}))
    wanted = {"s": {"a": 100.0, "b": 40.0}, "l": {"x": 60.0, "y": 80.0}}
    targets = {c: spark.createDataFrame(pa.table({c: list(w), "target": list(w.values())})) for c, w in wanted.items()}
    with Staging(spark) as stage:
        rates = mixing.balance(table, targets, stage).collect()
    for column, want in wanted.items():
        for value, target in want.items():
            assert sum(r["words"] * r["rate"] for r in rates if r[column] == value) == pytest.approx(target, rel=1e-6)
    rate = {(r["s"], r["l"]): r["rate"] for r in rates}  # an exponential tilt: no interaction
    assert rate["a", "x"] * rate["b", "y"] == pytest.approx(rate["a", "y"] * rate["b", "x"], rel=1e-6)


def test_targets_that_can_not_be_met_are_an_error(spark, monkeypatch):
    """The same words can't make one half by source and all of them by language."""
    monkeypatch.setattr(mixing, "MOST_ITERATIONS", 6)
    table = spark.createDataFrame(pa.table({"s": ["a", "b"], "l": ["x", "y"], "words": [10, 10]}))
    wanted = {"s": {"a": 5.0, "b": 15.0}, "l": {"x": 15.0, "y": 5.0}}
    targets = {c: spark.createDataFrame(pa.table({c: list(w), "target": list(w.values())})) for c, w in wanted.items()}
    with Staging(spark) as stage, pytest.raises(RuntimeError, match="can't be met"):
        mixing.balance(table, targets, stage).count()
