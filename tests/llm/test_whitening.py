import numpy as np
import pyarrow as pa
import pytest

from cotaflow.llm import whitening

SCHEMA = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("x", pa.string()), ("key", pa.string()), ("n", pa.int64()), ("copies", pa.string())])


def vectors(spark, rows):
    """A table of (vec_id, vector) with columns of clashing names."""
    n = len(rows)
    columns = [[r[0] for r in rows], [r[1] for r in rows], ["x"] * n, [None] * n, [None] * n, ["c"] * n]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, SCHEMA, strict=True)], schema=SCHEMA))


def plain(matrix, weights):
    """Whole numbers, exact deviations, whitened rows, explained shares: all rows at once, in Python integers and doubles."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in row] for row in matrix]
    n, dims = int(sum(weights)), len(x[0])
    s = [sum(w * row[k] for row, w in zip(x, weights, strict=True)) for k in range(dims)]
    deviations = [sum((n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    centred = np.array([[(n * a - b) / n for a, b in zip(row, s, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ (centred * np.array(weights)[:, None]) / n)
    values, axes = values[::-1], axes[:, ::-1]
    return n, deviations, centred @ axes / np.sqrt(values), values / values.sum()


def compare(rows, want_by_id, components):
    signs = np.sign(sum(np.array(r["whitened"]) * want_by_id[r["vec_id"]][1][:components] for r in rows))
    for r in rows:
        deviation, whitened = want_by_id[r["vec_id"]]
        assert int(r["deviation"]) == deviation
        assert np.allclose(np.array(r["whitened"]) * signs, whitened[:components], atol=1e-9)


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_against_all_rows_at_once(spark, weights):
    rng = np.random.default_rng(4)
    distinct = rng.normal(0, 0.3, (300, 10)).astype(np.float32) * np.linspace(0.3, 2, 10, dtype=np.float32)
    copies = np.concatenate((distinct, np.repeat(distinct[:1], 150, axis=0), distinct[5:9]))
    rows = [(i, v.tolist()) for i, v in enumerate(copies)]
    rows += [(900, None), (901, []), (902, [0.5] * 9 + [None]), (903, [0.5] * 9 + [float("nan")]), (904, [float("inf")] + [0.5] * 9)]
    rows += [(905, [1.0] * 7), (906, [1e30] + [0.0] * 9)]  # another length; beyond whole numbers
    found = whitening.whiten(vectors(spark, rows), components=6, weights=weights).collect()
    assert sorted(r["vec_id"] for r in found) == list(range(len(copies)))
    n, deviations, whitened, explained = plain(copies if weights == "counts" else distinct, [1] * (len(copies) if weights == "counts" else 300))
    if weights == "one":
        again = [*range(300), *[0] * 150, *range(5, 9)]
        deviations, whitened = [deviations[i] for i in again], whitened[again]
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert found[0]["identity_error"] < 1e-9
    assert np.allclose(found[0]["explained"], explained[:6], rtol=1e-9)
    compare(found, {i: (deviations[i], whitened[i]) for i in range(len(copies))}, 6)


def test_repeated_and_null_ids(spark):
    rng = np.random.default_rng(5)
    base = [v.tolist() for v in rng.normal(0, 1, (20, 3))]
    rows = [(i, v) for i, v in enumerate(base)] + [(3, base[3]), (3, base[3]), (None, base[4]), (7, base[8])]
    found = whitening.whiten(vectors(spark, rows), components=32).collect()
    assert sorted(str(r["vec_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    assert {len(r["whitened"]) for r in found} == {3}
    assert len({tuple(r["whitened"]) for r in found if r["vec_id"] == 3}) == 1


def test_axes_without_variance(spark):
    rows = [(i, [float(i % 5), 2.0, 0.0]) for i in range(40)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] for r in found)
    assert found[0]["explained"] == pytest.approx([1, 0, 0]) and found[0]["identity_error"] < 1e-12
    same = whitening.whiten(vectors(spark, [(i, [1.0, 2.0]) for i in range(4)])).collect()
    assert {tuple(r["whitened"]) for r in same} == {(None, None)} and {tuple(r["explained"]) for r in same} == {(None, None)}
    assert {r["identity_error"] for r in same} == {None} and {int(r["deviation"]) for r in same} == {0}


def test_long_vectors_and_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    large = rng.integers(-(2**40), 2**40, (30, 8)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(large)]
    table = spark.createDataFrame(pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    found = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(table).collect()}
    assert found == dict(enumerate(plain(large, [1] * 30)[1]))
    wide = whitening.whiten(vectors(spark, [(i, rng.normal(0, 1, 1500).tolist()) for i in range(12)]), components=4).collect()
    assert len(wide) == 12 and wide[0]["identity_error"] < 1e-8


def test_empty_table(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None)])).columns == ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"]
