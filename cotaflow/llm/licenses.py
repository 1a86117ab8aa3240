"""Licence scan: diagonal voting of rolling word grams against licence wordings.

Every text and every wording is a row of lower-cased words.  The hashes of a text's rolling k-word grams are
joined to the places where wordings hold the same gram; a hit at word p of the text and word t of a wording
votes for the diagonal p - t.  Votes are summed per text, wording and diagonal as bit maps of t, as many as the wording needs.  Diagonals a
few words apart, as words put in or left out make them, are merged, and a span counts when its places cover
enough of the wording.  Short phrases count only whole, on one diagonal: those are their exact occurrences.

Tasks drop grams that no wording has before the join, which is what a semi-join does; the join itself, the
votes and the spans are DataFrame steps.  The wordings are a parameter of fixed size, so they are broadcast.
Votes go to a key of text and wording, so a licence line that all texts share makes no hot key.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.session import ship_package
from cotaflow.sources.scratch import staged

#: Places of a wording are bits of longs, so many to one; a wording has as many longs as it needs.
BITS = 62
#: Diagonals this far apart belong to one span; spans must cover this share of a wording's grams.
MERGE, COVER = 3, 0.6
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Wording:
    """Words that stand for a label; a ``phrase`` must occur whole, others in the share COVER of their grams."""

    label: str
    text: str
    phrase: bool = False

    def words(self) -> list[str]:
        return _WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in self.text))

    @property
    def k(self) -> int:
        return 2 if self.phrase else 3


#: Phrases whose occurrences are counted, and their labels.
PHRASES = (
    Wording("gpl", "gnu general public license", True),
    Wording("apache", "apache license", True),
    Wording("cc-by", "cc by", True),
    Wording("mit", "mit license", True),
)
#: Opening lines and notices of well-known licences.
NOTICES = (
    Wording("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Wording("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    Wording("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Wording("apache-2.0", "you may not use this file except in compliance with the License"),
    Wording("mit-notice", "Released under the MIT License"),
    Wording("mit-notice", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Wording("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Wording("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
)


def wording_grams(wordings) -> list[tuple[int, int, int, int]]:
    """(wording, k, place, gram hash) of all grams of all wordings."""
    out = []
    for i, wording in enumerate(wordings):
        words = flat.Words(pa.array([" ".join(wording.words())]), flat.LETTERS)
        grams = flat.rolling(words.hashes, wording.k)
        if not len(grams):
            raise ValueError(f"a wording must have {wording.k} words or more: {wording.text!r}")
        out += [(i, wording.k, t, int(g)) for t, g in enumerate(grams.view(np.int64))]
    return out


def scan(
    documents: DataFrame, phrases=PHRASES, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """What licences say in each row of ``documents``, and where.

    The first table has a row for each row: (doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score).  ``n_base`` counts all places where a phrase's words stand one after the other, ``first_word``
    and ``last_word`` are the first and last of them (null without any).  Labels are distinct, sorted, joined by
    commas, empty without any; ``labels`` has those of notices too.  ``score`` is the largest share of a
    wording that a span covers, 1 with a phrase.  The second table has the spans: (doc_id, version, label,
    first_word, last_word, cover).  Null and empty texts have no words.  Rows that repeat each other get equal
    results; rows may share an id or have none; no rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    wordings = [*phrases, *notices]
    grams = wording_grams(wordings)
    wanted = {k: np.array(sorted(g for _, kk, _, g in grams if kk == k), np.int64) for k in {k for _, k, _, _ in grams}}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text"):
            words = flat.Words(batch.column("text"), flat.LETTERS, lower=True)
            owner = words.document()
            at, found = [], []
            for k, known in wanted.items():
                rolled = flat.rolling(words.hashes, k).view(np.int64)
                inside = words.grams_of(k)[: len(rolled)]
                near = np.minimum(np.searchsorted(known, rolled), len(known) - 1)
                hit = np.flatnonzero(inside & (known[near] == rolled))
                at.append(hit)
                found.append(rolled[hit])
            at, found = np.concatenate(at), np.concatenate(found)
            order = np.argsort(owner[at], kind="stable")
            at, found = at[order], found[order]
            bounds = np.searchsorted(owner[at], np.arange(batch.num_rows + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(at - words.first[owner[at]]), pa.array(found)], names=["place", "gram"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("version"), pa.array(words.counts().astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pairs)],
                names=["id", "version", "n_words", "hits"],
            )

    texts = documents.select(
        F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("version"), F.col(text_col).alias("text")
    )
    described = texts.mapInArrow(hits, "id long, version long, n_words long, hits array<struct<place:bigint,gram:bigint>>")
    described = staged(described, "gram-hits")

    places = spark.createDataFrame([(g, i, t) for i, _, t, g in grams], "gram long, wording int, t long")
    sizes = [sum(1 for i, *_ in grams if i == n) for n in range(len(wordings))]
    about = spark.createDataFrame(
        [(i, w.label, w.phrase, sizes[i], w.k) for i, w in enumerate(wordings)], "wording int, label string, phrase boolean, grams int, k int"
    )
    votes = described.where(F.size("hits") > 0).select("id", "version", F.inline("hits"))
    votes = votes.join(F.broadcast(places), "gram").withColumn("diagonal", F.col("place") - F.col("t"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("t") % BITS).cast("int"))
    votes = votes.groupBy("id", "version", "wording", "diagonal", F.floor(F.col("t") / BITS).alias("part")).agg(
        F.bit_or(bit).alias("bits"), F.min("place").alias("low"), F.max("place").alias("high")
    )
    votes = votes.join(F.broadcast(about), "wording")

    # Phrases: whole on one diagonal.  Notices: diagonals that lie near each other are one span.
    own = Window.partitionBy("id", "version", "wording").orderBy("diagonal", "part")
    away = F.col("diagonal") - F.lag("diagonal").over(own)
    apart = F.coalesce(away > F.when(F.col("phrase"), 0).otherwise(MERGE), F.lit(True))
    merged = votes.withColumn("begins", apart.cast("int"))
    merged = merged.withColumn("span", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    by = ["id", "version", "wording", "label", "phrase", "grams", "k", "span"]
    parts = merged.groupBy(*by, "part").agg(F.bit_or("bits").alias("bits"), F.min("low").alias("low"), F.max("high").alias("high"))
    spans = parts.groupBy(*by).agg(F.sum(F.bit_count("bits")).alias("places"), F.min("low").alias("low"), F.max("high").alias("high"))
    cover = F.col("places") / F.col("grams")
    long_enough = F.when(F.col("phrase"), F.col("cover") == 1.0).otherwise((F.col("cover") >= COVER) & (F.col("high") - F.col("low") < 2 * F.col("grams") + 2 * MERGE))
    spans = spans.withColumn("cover", cover).withColumn("found", long_enough)

    of_phrase, of_any = F.col("found") & F.col("phrase"), F.col("found")
    per_text = spans.groupBy("id", "version").agg(
        F.count_if(of_phrase).alias("n_base"),
        F.min(F.when(of_phrase, F.col("low"))).alias("first_word"),
        F.max(F.when(of_phrase, F.col("low"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(of_phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(of_any, F.col("label")))), ",").alias("labels"),
        F.max("cover").alias("score"),
    )
    keyed = per_text.withColumnsRenamed({"id": "_id", "version": "_version"})
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("version") == F.col("_version"))
    result = described.select("id", "version", "n_words").join(keyed, same, "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    where = spans.where("found").select(
        F.col("id").alias("doc_id"), "version", "label", F.col("low").alias("first_word"), (F.col("high") + F.col("k") - 1).alias("last_word"), "cover"
    )
    return result, where
