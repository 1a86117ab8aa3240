import random
import re
from collections import Counter

from pyspark.sql import functions as F

from cotaflow.llm import substring

from .corpus import awkward_texts, collected, documents, words


def plain(rows, window=substring.WINDOW):
    """Every window of every text in one table."""
    texts = [(i, words(t)) for i, t in rows]
    seen = Counter(tuple(w[k : k + window]) for _, w in texts for k in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=repr)


COLUMNS = ("doc_id", "n_words", "n_removed", "kept_text")


def test_against_all_windows(spark):
    rows = awkward_texts(1)
    assert collected(substring.remove_repeats(documents(spark, rows)), *COLUMNS) == plain(rows)


def test_passages_that_branch(spark):
    """Passages that share parts, end at text ends, overlap themselves and differ in one word."""
    rng = random.Random(2)
    parts = [[f"p{k}x{i}" for i in range(rng.choice([20, 34, 35, 36, 50]))] for k in range(8)]
    rows = []
    for i in range(60):
        text = []
        for k in rng.choices(range(8), k=rng.randint(1, 6)):
            part = list(parts[k])
            if rng.random() < 0.2:
                part[rng.randrange(len(part))] = f"odd{i}"
            text += part[rng.choice([0, 0, 3]) :] + ([f"own{i}"] if rng.random() < 0.5 else [])
        rows.append((i, " ".join(text)))
    rows += [(90, "z " * 35), (91, "z " * 34), (92, "y " * 36)]
    assert collected(substring.remove_repeats(documents(spark, rows)), *COLUMNS) == plain(rows)


def test_shared_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(50))
    rows = [(1, long), (1, "x " + long), (None, long + " y"), (None, None), (None, "short"), (2, "")]
    assert collected(substring.remove_repeats(documents(spark, rows)), *COLUMNS) == plain(rows)


def test_texts_whose_short_hashes_collide(spark):
    """Texts without id that one 32-bit hash can't tell apart: each is cut by its own windows."""
    passage = " ".join(f"w{i}" for i in range(60))
    texts = spark.range(200_000).select(F.concat(F.lit("t"), F.col("id"), F.lit(" " + passage)).alias("text"), F.hash(F.concat(F.lit("t"), F.col("id"), F.lit(" " + passage))).alias("h"))
    short = spark.range(200_000).select(F.concat(F.lit("own words "), F.col("id")).alias("text"), F.hash(F.concat(F.lit("own words "), F.col("id"))).alias("h"))
    pair = texts.join(short.withColumnsRenamed({"text": "other"}), "h").orderBy("text").first()
    rows = [(None, pair["text"]), (None, pair["other"]), (5, "and " + passage), (None, "x"), (None, "x")]
    assert collected(substring.remove_repeats(documents(spark, rows)), *COLUMNS) == plain(rows)


def test_carries_other_columns_and_takes_no_rows(spark):
    docs = documents(spark, awkward_texts(3)[:5])
    found = substring.remove_repeats(docs, carry=docs.columns).select("row.*")
    assert collected(found, *docs.columns) == collected(docs, *docs.columns)
    assert substring.remove_repeats(documents(spark, [])).count() == 0


def plain_as_written(rows, window=substring.WINDOW):
    """The texts themselves, each run of removed words cut out from its first character to its last."""
    spans = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for _, t in rows]
    split = [words(t) for _, t in rows]
    seen = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, text), span, w in zip(rows, spans, split, strict=True):
        gone = {j for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        cut = {c for j in gone for c in range(span[j][0], span[j + 1][0] if j + 1 in gone else span[j][1])}
        out.append((i, len(gone), text if text is None else "".join(c for at, c in enumerate(text) if at not in cut)))
    return sorted(out, key=repr)


def spaced(rows, seed):
    """``rows`` with line breaks, tabs and runs of blanks in place of single spaces."""
    rng = random.Random(seed)
    return [(i, t and re.sub(" ", lambda m: rng.choice([" ", "\n", "\t", "  ", "\r\n", " \n\n "]), t)) for i, t in rows]


def test_texts_as_written(spark):
    rows = spaced(awkward_texts(4), 4)
    rows += [(900, " \n" + rows[0][1] + "\n\n"), (901, "one\n\ntwo\tthree   four "), (902, None), (None, "é\n漢 ")]
    found = substring.remove_repeats(documents(spark, rows), as_written=True)
    assert collected(found, "doc_id", "n_removed", "kept_text") == plain_as_written(rows)
