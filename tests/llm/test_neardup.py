import numpy as np
import pyarrow as pa

from cotaflow.llm import neardup
from cotaflow.llm.components import components
from cotaflow.sources.scratch import Staging

from .corpus import awkward_texts, collected, documents, lower, words


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain(rows):
    """Every document against every other."""
    sets, root = {}, {}
    for i, text in rows:
        sets.setdefault(i, []).append(shingles(text))
        root[i] = i

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if b < a and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((i, len(shingles(t)), find(i), i == find(i)) for i, t in rows), key=repr)


def test_against_all_pairs(spark):
    rows = awkward_texts()
    found = neardup.near_duplicates(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain(rows)


def test_chains_and_stars_of_near_copies(spark):
    """Members that only meet through others: a chain in which each text drops a few words of the last one, and a star."""
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[k * 12 : k * 12 + 100] + [f"end{k}"])) for k in range(6)]
    rng = np.random.default_rng(1)
    star = [f"s{i}" for i in range(150)]
    for k in range(60):
        near = list(star)
        for at in rng.choice(150, rng.integers(0, 9), replace=False):
            near[at] = f"new{k}-{at}"
        rows.append((100 + k, " ".join(near)))
    rows.append((99, " ".join(star)))
    found = neardup.near_duplicates(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain(rows)


def test_null_ids_and_empty_table(spark):
    same = "a b c d e f g"
    found = neardup.near_duplicates(documents(spark, [(None, same), (4, same), (None, "only one here"), (None, None), (2, "")]))
    assert collected(found, "doc_id", "component_id", "kept") == sorted(
        [(None, 4, False), (4, 4, True), (None, None, True), (None, None, True), (2, 2, True)], key=repr
    )
    assert neardup.near_duplicates(documents(spark, [])).count() == 0


def test_rows_without_id_link_others(spark):
    """The middle of a chain, with an id and without one: its ends are linked either way."""
    base = [f"w{i}" for i in range(200)]
    chain = [" ".join(base[k * 12 : k * 12 + 100]) for k in range(4)]
    for ids, want in (((1, 2, 3), [(1, 1), (2, 1), (3, 1)]), ((1, None, 3), [(1, 1), (3, 1), (None, 1)]), ((None, None, None), [(None, None)] * 3)):
        found = neardup.near_duplicates(documents(spark, list(zip(ids, chain, strict=False))))
        assert collected(found, "doc_id", "component_id") == sorted(want, key=repr)
    found = neardup.near_duplicates(documents(spark, [(None, chain[1]), (5, chain[0]), (None, chain[1]), (4, chain[2])]))
    assert collected(found, "doc_id", "component_id") == sorted([(None, 4), (5, 4), (None, 4), (4, 4)], key=repr)


def test_loose_groups(spark):
    """Members that share keys with many others and are linked with few of them."""
    rng = np.random.default_rng(8)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(120)]
        for k in range(70):
            near = list(base)
            for at in rng.choice(120, rng.integers(0, 9), replace=False):
                near[at] = f"n{rng.integers(0, 40)}"
            rows.append((int(rng.permutation(10_000)[0]) * 1000 + len(rows), " ".join(near)))
    found = neardup.near_duplicates(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain(rows)


def test_signatures_within_the_guaranteed_distance_share_a_key():
    rng = np.random.default_rng(0)
    signs = rng.integers(0, 2**16, (200, neardup.SYMBOLS), dtype=np.uint16)
    indexed = neardup.CHUNKS * neardup.CHUNK_SYMBOLS
    changed = signs.copy()
    for row in changed:
        at = rng.choice(indexed, neardup.GUARANTEED, replace=False)
        row[at] ^= rng.integers(1, 2**16, len(at), dtype=np.uint16)
    assert (neardup.chunk_keys(signs) == neardup.chunk_keys(changed)).any(axis=1).all()


def test_symbols_estimate_similarity():
    words_a = [f"w{i}" for i in range(3000)]
    words_b = words_a[:2400] + [f"v{i}" for i in range(600)]
    hashes, bounds = neardup.shingle_sets(pa.array([" ".join(words_a), " ".join(words_b)]))
    a, b = (set(hashes[bounds[i] : bounds[i + 1]].tolist()) for i in (0, 1))
    signs = neardup.signatures(hashes, bounds)
    assert abs((signs[0] == signs[1]).mean() - len(a & b) / len(a | b)) < 0.15


def test_components(spark, frame):
    edges = frame("a long, b long", *[(i, i + 1) for i in range(40)], (100, 101), (101, 100), (7, 7), (200, 3))
    with Staging(spark) as stage:
        found = dict(collected(components(edges, stage), "node", "component"))
    assert found == {**dict.fromkeys(range(41), 0), 200: 0, 100: 100, 101: 100}


def test_unlike_texts_of_one_id(spark):
    """Each version keeps its own set: partners of either are found, and meet through the id."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(20):
        for version in "ab":
            text = [f"{version}{k}x{i}" for i in range(100)]
            near = [*text[:50], "new", *text[51:]]
            rows += [(500 + k, " ".join(text)), (int(rng.integers(0, 100)) * 10 + 1000 * (k + 1) + ord(version), " ".join(near))]
    rows += [(7, rows[0][1]), (8, rows[6][1]), (9, None)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    found = neardup.near_duplicates(documents(spark, rows))
    assert collected(found, "doc_id", "n_shingles", "component_id", "kept") == plain(rows)
