"""Near-duplicate documents: a multi-index Hamming join of b-bit MinHash signatures.

A text's set holds its distinct shingles of five lower-cased words.  Its signature has 128 symbols of 16 bits,
one from the minimum of each hash function, so two sets of similarity s differ in a share of 1 - s of them.
The first 60 symbols form 12 chunks of 5.  Two signatures that differ in at most 23 of these 60 have a chunk
with at most one error (pigeonhole), so each chunk gives five keys, each with one symbol left out, and every
such pair shares a key: the index finds all pairs within that distance.  At the threshold of 0.75 a pair
beyond it still shares a key but for about 6 in a million, and is held against the distance over all 128
symbols, at which such a pair is lost once in some ten millions.  Each pair left is confirmed on full sets.

Equal sets are one class from the start, named by a hash of the set; unlike versions of one id are linked.
Links are looked for in three rounds: first each class with one hub of its buckets, the class that shares keys
most; then, in buckets whose classes are still in several components, each with the bucket's own hub; then,
where they are still apart, between those of one hub.  What tells a class from the hub is small where the class
is near it, and two classes that are linked must agree in a known part of it, so this last round is a
prefix-filtered join on the rarest such elements.  A group of near copies so costs a link or two a member, not
all its pairs, and no link that could join two components is left out: the last round's bound holds for sure.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.llm.components import components
from cotaflow.session import ship_package
from cotaflow.sources.scratch import Staging, staged

SHINGLE = 5
SYMBOLS = 128
CHUNKS, CHUNK_SYMBOLS = 12, 5
#: Errors allowed in a chunk is one, so all pairs that differ in at most CHUNKS * 2 - 1 indexed symbols meet.
GUARANTEED = CHUNKS * 2 - 1
#: Of all symbols; 5.5 standard deviations above the mean at a similarity of 0.75.
MOST_DIFFERENT = 59
#: Columns that identify a set.
SET = ("n", "print1", "print2")
_MULTIPLIERS = np.random.default_rng(75).integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and where each text's begin (one more marks the end)."""
    words = flat.Words(texts, lower=True)
    grams = flat.rolling(words.hashes, SHINGLE)
    counts = words.counts()
    sets = []
    for i, n in enumerate(counts):
        at = words.first[i]
        if n >= SHINGLE:
            own = np.sort(grams[at : at + n - SHINGLE + 1])
            own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif n:
            own = flat.rolling(words.hashes[at : at + n], int(n))
        else:
            own = grams[:0]
        sets.append(own)
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets], dtype=np.int64))).astype(np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A row of SYMBOLS for each text; texts without shingles have zeros."""
    out = np.zeros((len(bounds) - 1, SYMBOLS), np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    i = 0
    while i < len(full):
        low = bounds[full[i]]
        j = max(i + 1, int(np.searchsorted(bounds[full], low + (1 << 15), "right")) - 1)
        part, cuts = hashes[low : bounds[full[j - 1] + 1]], bounds[full[i:j]] - low
        for k, multiplier in enumerate(_MULTIPLIERS):
            least = np.minimum.reduceat(part * multiplier, cuts)
            out[full[i:j], k] = flat.mix(least) >> np.uint64(48)
        i = j
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    bounds = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rows.ravel(), pa.int64()))


def _prints(hashes: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Size and two sums of hashes of each set; together they identify it."""
    prints = [pa.array(np.diff(bounds), pa.int64())]
    for spread in (hashes, flat.mix(hashes ^ np.uint64(0x5851F42D4C957F2D))):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(spread, dtype=np.uint64)))
        prints.append(flat.signed(total[bounds[1:]] - total[bounds[:-1]]))
    return prints


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"))
        signs = signatures(hashes, bounds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *_prints(hashes, bounds), _lists(signs.view(np.int64))],
            names=["id", *SET, "signature"],
        )


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """Keys of each signature: a chunk's symbols but one, for every chunk and every one left out."""
    keys = []
    for chunk in range(CHUNKS):
        symbols = signs[:, chunk * CHUNK_SYMBOLS : (chunk + 1) * CHUNK_SYMBOLS].astype(np.uint64)
        for error in range(CHUNK_SYMBOLS):
            packed = np.zeros(len(signs), np.uint64)
            for k in range(CHUNK_SYMBOLS):
                if k != error:
                    packed = (packed << np.uint64(16)) | symbols[:, k]
            keys.append(flat.mix(packed + np.uint64((chunk * CHUNK_SYMBOLS + error + 1) * 0x9E3779B97F4A7C15 % 2**64)))
    return np.stack(keys, axis=1)


def _explode_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            lanes = np.ascontiguousarray(batch.column("signature").flatten().to_numpy())
            keys = chunk_keys(lanes.view(np.uint16).reshape(-1, SYMBOLS))
            ids = np.repeat(batch.column("class").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([flat.signed(keys.ravel()), pa.array(ids, pa.int64())], names=["key", "class"])


def _read_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"))
        shingles = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat.signed(hashes))
        yield pa.RecordBatch.from_arrays([*_prints(hashes, bounds), shingles], names=[*SET, "shingles"])


def _distance(a: str, b: str) -> Column:
    """Symbols in which two signatures, each an array of longs, differ."""
    lanes = F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))

    def differing(x: Column) -> Column:
        for shift in (8, 4, 2, 1):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x0001000100010001)))

    return F.aggregate(lanes, F.lit(0), lambda total, x: total + differing(x))


def _similar_size(a: str, b: str) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * 75)


def describe(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, print1, print2, signature) of each row; n and the prints identify its shingle set."""
    ship_package(documents.sparkSession)
    chosen = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(_describe, "id long, n long, print1 long, print2 long, signature array<bigint>")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``documents``.

    Documents are linked when they share at least three quarters of the union of their shingles.
    ``component_id`` is the smallest id reachable, the row's own without shingles or partners; ``kept`` marks
    rows that carry it.  Null and empty texts have no shingles.  Rows with equal texts are linked, repeated
    rows both stay marked; rows that share an id count as linked versions of one document.  Rows without an id
    link others like any row; they take the smallest id of their component, and null where there is none, as
    have rows without an id and without shingles.  No rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    with Staging(spark) as stage:
        described = stage(describe(documents, id_col, text_col), "described")
        named = described.where("n > 0").withColumn("class", F.xxhash64(*SET))
        classes = stage(
            named.groupBy(*SET, "class").agg(F.min("id").alias("least"), F.first("signature").alias("signature")),
            "classes",
        )
        links = _links(documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), classes, stage)
        links = links.union(_versions(named.where("id is not null").select("id", "class")))
        linked = components(links, stage).withColumnRenamed("node", "class")
        linked = stage(linked.join(classes.select("class", "least"), "class"), "linked")
        smallest = stage(linked.groupBy("component").agg(F.min("least").alias("smallest")), "smallest")
        linked = linked.join(smallest, "component").select("class", "smallest")
        merged = classes.join(linked, "class", "left").select(*SET, F.coalesce("smallest", "least").alias("component"))
        rows = described.select("id", *SET).join(merged, list(SET), "left")
        component = F.coalesce("component", "id")
        return staged(
            rows.select(
                F.col("id").alias("doc_id"),
                F.col("n").alias("n_shingles"),
                component.alias("component_id"),
                F.col("id").eqNullSafe(component).alias("kept"),
            ),
            "near-duplicates",
        )


def _versions(named: DataFrame) -> DataFrame:
    """Links (a, b) from the first class of each id to its others."""
    first = named.groupBy("id").agg(F.min("class").alias("a"), F.max("class").alias("last")).where("a <> last")
    return named.join(first.select("id", "a"), "id").where("a <> class").select("a", F.col("class").alias("b")).distinct()


def _links(texts: DataFrame, classes: DataFrame, stage: Staging) -> DataFrame:
    """Confirmed links (a, b) that join all classes which are linked at all."""
    keys = classes.select("class", "signature").mapInArrow(_explode_keys, "key long, class long")
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared-keys")
    members = stage(keys.join(shared, "key"), "members")

    # The hub of a bucket is the class whose keys are shared most; ties go to the smaller class.
    reach = stage(members.groupBy("class").agg(F.sum("size").alias("reach")), "reach")
    ranked = members.join(reach, "class")
    hubs = stage(
        ranked.groupBy("key").agg(F.max(F.struct("reach", (-F.col("class")).alias("minus"))).alias("top")).select(
            "key", (-F.col("top.minus")).alias("hub")
        ),
        "hubs",
    )
    members = stage(members.join(hubs, "key").select("key", "class", "hub"), "placed")
    spokes = members.where("class <> hub").groupBy("class", "hub").agg(F.count("*").alias("common"))
    best = spokes.groupBy("class").agg(F.max(F.struct("common", (-F.col("hub")).alias("minus"))).alias("top"))
    first = best.select(F.col("class").alias("a"), (-F.col("top.minus")).alias("b"))

    sets = stage(
        texts.join(reach.join(classes, "class").where("least is not null").select(F.col("least").alias("id")), "id", "left_semi")
        .union(texts.where("id is null"))
        .mapInArrow(_read_sets, "n long, print1 long, print2 long, shingles array<bigint>")
        .where("n > 0")
        .select(F.xxhash64(*SET).alias("class"), "shingles")
        .join(reach.select("class"), "class", "left_semi")
        .groupBy("class").agg(F.first("shingles").alias("shingles")),
        "sets",
    )
    tried = stage(_compared(_close(first, classes), sets), "tried")
    found = tried.where(_linked("common", "n", "n_hub")).select("a", "b")

    # Where the classes of a bucket are still apart, each is held against the bucket's own hub.
    split = _split_buckets(members, found, stage)
    spokes = split.where("class <> hub").select(F.col("class").alias("a"), F.col("hub").alias("b")).distinct()
    tried = stage(_compared(spokes, sets, unlike=True), "unlike")
    found = stage(found.union(tried.where(_linked("common", "n", "n_hub")).select("a", "b")), "found")

    # Those still apart are held against each other where what tells them from the hub could agree enough.
    split = _split_buckets(members, found, stage)
    apart = split.where("class <> hub").select("class", "hub", "component").distinct()
    known = tried.withColumnsRenamed({"a": "class", "b": "hub"}).join(apart, ["class", "hub"])
    pairs = _may_agree(stage(known, "apart")).select("a", "b").distinct()
    more = _compared(stage(pairs, "pairs"), sets).where(_linked("common", "n", "n_hub"))
    return found.union(stage(more.select("a", "b"), "links"))


def _may_agree(spokes: DataFrame) -> DataFrame:
    """Pairs (a, b) of unlike components that could be linked, among ``spokes`` of one hub: a prefix-filtered join.

    ``spokes`` has each class with its hub, sizes, what is in common, and as ``unlike`` what either has and the
    other lacks.  With l elements of the hub's h lacking and e beyond it, two classes are linked when their
    unlike sets share at least (w_a + w_b) / 14, with w = 8 l + 6 e - h.  Of a class that is not linked to
    the hub w is above h, and below it is at least -h, so that number is positive.  Where two sets share t elements, the first that
    they share, in any one order, is within the first size - t + 1 of both.  The order puts the rarest
    of a hub's group first; w is taken in steps of h, and each class hands in the prefix for each step that
    a partner may be at.
    """
    one = spokes.select(
        "class", "hub", "component", "n", "n_hub", F.size("unlike").alias("size"), F.explode("unlike").alias("element"),
        (8 * (F.col("n_hub") - F.col("common")) + 6 * (F.col("n") - F.col("common")) - F.col("n_hub")).alias("w"),
    )
    frequent = one.groupBy("hub", "element").agg(F.count("*").alias("rows")).where("rows > 1")
    ordered = one.join(frequent, ["hub", "element"], "left").groupBy("class", "hub", "component", "n", "n_hub", "size", "w")
    ordered = ordered.agg(F.array_sort(F.collect_list(F.struct(F.coalesce("rows", F.lit(1)).alias("rows"), "element"))).alias("unlike"))
    steps = F.sequence(F.lit(-1).cast("long"), F.greatest(F.lit(-1), F.expr("(14 * size - w) div n_hub")).cast("long"))
    ordered = ordered.withColumn("step", F.floor(F.col("w") / F.col("n_hub"))).withColumn("other", F.explode(steps))
    shared = F.greatest(F.lit(1).cast("long"), F.ceil((F.col("w") + F.col("other") * F.col("n_hub")) / 14))
    ordered = ordered.withColumn("prefix", (F.col("size") - shared + 1).cast("int")).where("prefix > 0")
    # An element that no other class of the group has can't be what two share.
    prefix = ordered.select("*", F.posexplode(F.slice("unlike", F.lit(1), F.col("prefix"))).alias("at", "item")).where("item.rows > 1")
    prefix = prefix.withColumn("left", F.col("size") - F.col("at"))
    own = ("class", "component", "n", "w", "left")
    a = prefix.select("hub", "item.element", "step", "other", *(F.col(c).alias(f"{c}_a") for c in own))
    b = prefix.select("hub", "item.element", F.col("other").alias("step"), F.col("step").alias("other"), *(F.col(c).alias(f"{c}_b") for c in own))
    near = (F.col("class_a") < F.col("class_b")) & (F.col("component_a") != F.col("component_b")) & _similar_size("n_a", "n_b")
    # At the first element that two share, what is left from there on must be enough.
    near &= F.least("left_a", "left_b") * 14 >= F.col("w_a") + F.col("w_b")
    met = a.join(b, ["hub", "element", "step", "other"]).where(near)
    return met.select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))


def _split_buckets(members: DataFrame, found: DataFrame, stage: Staging) -> DataFrame:
    """(key, class, hub, component) of the buckets whose classes are in several components by the links found."""
    together = components(found, stage).withColumnRenamed("node", "class")
    placed = stage(members.join(together, "class", "left").withColumn("component", F.coalesce("component", "class")), "together")
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return stage(placed.join(apart.where("low <> high").select("key"), "key", "left_semi"), "split")


def _linked(common: str, n_a: str, n_b: str) -> Column:
    return F.col(common) * 100 >= (F.col(n_a) + F.col(n_b) - F.col(common)) * 75


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose signatures and sizes allow a link."""
    signs = classes.select("class", "n", "signature")
    for side in "ab":
        pairs = pairs.join(signs.toDF(side, f"n_{side}", f"signature_{side}"), side)
    near = _similar_size("n_a", "n_b") & (_distance("signature_a", "signature_b") <= MOST_DIFFERENT)
    return pairs.where(near).select("a", "b")


def _compare(unlike: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [(c.flatten().to_numpy().view(np.uint64), c.offsets.to_numpy()) for c in (batch.column("set_a"), batch.column("set_b"))]
            (left, ends), (right, hub_ends) = lists
            ends, hub_ends = ends - ends[0], hub_ends - hub_ends[0]
            common, apart = [], []
            for i in range(batch.num_rows):
                own, hub = left[ends[i] : ends[i + 1]], right[hub_ends[i] : hub_ends[i + 1]]
                inside = hub[np.minimum(np.searchsorted(hub, own), len(hub) - 1)] == own
                common.append(int(inside.sum()))
                if unlike:
                    lacking = own[np.minimum(np.searchsorted(own, hub), len(own) - 1)] != hub
                    apart.append(np.concatenate((own[~inside], ~hub[lacking])))
            columns = [batch.column("a"), batch.column("b"), *(pa.array(x, pa.int64()) for x in (common, np.diff(ends), np.diff(hub_ends)))]
            names = ["a", "b", "common", "n", "n_hub"]
            if unlike:
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in apart]))).astype(np.int32)
                flattened = np.concatenate(apart) if apart else np.zeros(0, np.uint64)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds), flat.signed(flattened)))
                names.append("unlike")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _compared(pairs: DataFrame, sets: DataFrame, unlike: bool = False) -> DataFrame:
    """Pairs with what their full sets have in common, their sizes, and if wanted the elements that only one has.

    Elements that only b has are told from those that only a has by their bits being turned over.
    """
    for side in "ab":
        pairs = pairs.join(sets.toDF(side, f"set_{side}"), side)
    schema = "a long, b long, common long, n long, n_hub long" + (", unlike array<bigint>" if unlike else "")
    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(_compare(unlike), schema)
