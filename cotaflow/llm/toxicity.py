"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguise before anything is matched: compatibility forms, capitals, homoglyphs from other
scripts, digits and signs in place of letters, invisible characters.  What is not a letter becomes a space, so
an entry is a whole word (" word ") or the beginning of one (" beg"); where several match at one word the
longest counts, and an exception phrase hides all entries inside it.  Signs that can be read in several ways are
matched in each: a second automaton holds the entries with all letters of a sign's readings made one, and its
matches count where the text has the letter itself or the sign.  Letters that stand alone, three or more in a row, are
searched for the entries they spell.  The weights of a text's matches, normalised by its length, give its score.

The lexicon is learned from labelled documents: words that stand in more toxic documents than their share, by
the log-likelihood ratio of two binomials, weigh their log odds; word beginnings gather families of forms; words
of clean documents that begin like an entry become exceptions, and so do pairs of words, one of them an entry,
that clean documents have and toxic ones hardly.  A logistic curve, fitted on a third of the
documents that the lexicon has not seen, turns the weights into a probability.

Bound: at most ``SAMPLE`` labelled documents are learned from, a parameter, and all entries that they give evidence for
are kept.  The lexicon goes to the tasks as a broadcast that this sample bounds; scoring reads every whole text once.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cotaflow.llm import flat
from cotaflow.llm.neardup import shingle_sets
from cotaflow.session import ship_package

SAMPLE = 24_000
#: Least log-likelihood ratio and least number of toxic documents of an entry.
EVIDENCE, SUPPORT = 14.0, 4
#: Lengths of word beginnings that can be entries.
BEGINNINGS = range(4, 9)
#: Phrases in which an entry means no harm; always exceptions.
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "oxymoron", "sore loser rule")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t",
    "у": "y", "х": "x", "ѕ": "s", "і": "i", "ї": "i", "ј": "j", "ԁ": "d", "ո": "n", "ս": "u", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
    "ɡ": "g", "ɑ": "a", "ⅼ": "l",
}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
_SIGNS = str.maketrans({"@": "a", "$": "s"})
#: Signs for letters: within words, and dollars at the beginning of one.
_SIGN = re.compile(r"(?<=[^\W_])[@$]+(?=[^\W_])|(?<![\w$])\$+(?=[^\W\d_])")
#: Signs that stand for one of several letters, or for one or none.
READINGS = {"1": "il", "!": "il", "6": "bg", "$": "s"}
#: Such signs in a text: a one; a six, exclamation mark or bar in a word; dollars that end one.
_UNSURE = re.compile(r"[1１]|(?<=[^\W_])[6!|](?=[^\W_])|(?<=[^\W\d_])\$+(?![\w$])")
_MARKS = str.maketrans("１|", "1!")
#: Letters and signs that some reading makes one.
_ONE_OF = str.maketrans({c: letters[0] for sign, letters in READINGS.items() for c in sign + letters})
#: What ``fold`` makes of the signs.
_FOLDED_SIGN = str.maketrans("1!6$", "i   ")
_READ = set("".join(READINGS.values()))
_SPELLED = re.compile(r"(?<= )(?:\S ){2,}\S(?= )")
#: Least length of an entry that spelled-out letters are searched for.
SPELLED = 4


class _Fold(dict):
    """What each character becomes; filled as characters are met."""

    def __missing__(self, code: int):
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn"):
            out = ""
        else:
            plain = unicodedata.normalize("NFKC", char).lower()
            plain = "".join(HOMOGLYPHS.get(c, DIGITS.get(c, c)) for c in plain)
            out = "".join(c if c.isalpha() else " " for c in plain)
        self[code] = out
        return out


_fold = _Fold()


def _letters(text: str) -> str:
    """``text`` with signs for letters undone."""
    return _SIGN.sub(lambda m: m[0].translate(_SIGNS), text) if "@" in text or "$" in text else text


def fold(text: str) -> str:
    """The text in the letters that entries are written in, with a space at both ends."""
    return f" {_letters(text).translate(_fold)} "


def fold_unsure(text: str) -> str:
    """Like ``fold``, with every sign of several readings as a key of ``READINGS``; "" for a text without any."""
    text = _letters(text)
    if not _UNSURE.search(text):
        return ""
    signs = [m.translate(_MARKS) for m in _UNSURE.findall(text)]
    folded = [piece.translate(_fold) for piece in _UNSURE.split(text)]
    return f" {''.join(a + b for a, b in zip(folded, [*signs, ''], strict=True))} "


@dataclass
class Lexicon:
    """Weights of whole words and of beginnings, exception phrases, and the curve from weights to a score."""

    words: dict[str, float]
    beginnings: dict[str, float]
    exceptions: list[str]
    curve: np.ndarray = field(default_factory=lambda: np.array([-4.0, 1.0, 1.0, 0.0]))

    def automaton(self) -> Matcher:
        return Matcher(self)


def _built(entries: dict[str, object]):
    """An Aho-Corasick automaton; None without entries."""
    found = ahocorasick.Automaton()
    for key, value in entries.items():
        found.add_word(key, value)
    if not len(found):
        return None
    found.make_automaton()
    return found


class Matcher:
    """The automata of a lexicon: of its entries as they are, of unsure signs, and of entries spelled out."""

    def __init__(self, lexicon: Lexicon):
        keys: dict[str, tuple[str | None, float]] = {f" {w} ": (w, weight) for w, weight in lexicon.words.items()}
        keys |= {f" {b}": (b + "*", weight) for b, weight in lexicon.beginnings.items()}
        for phrase in lexicon.exceptions:
            if key := " ".join(fold(phrase).split()):
                keys[f" {key} "] = (None, 0.0)
        self.sure = _built({key: (key, *value) for key, value in keys.items()})
        unsure: dict[str, list] = {}
        for key, value in keys.items():
            if set(key) & _READ:
                unsure.setdefault(key.translate(_ONE_OF), []).append((key, *value))
        self.unsure = _built(unsure)
        self.spelled = _built({key.strip(): value for key, value in keys.items() if value[0] and " " not in key.strip() and len(key.strip()) >= SPELLED})

    def found(self, text: str) -> Iterator[tuple[int, str, str | None, float]]:
        """(end, key, entry, weight) of each match in a folded text with one space between words."""
        if self.sure:
            for end, (key, entry, weight) in self.sure.iter(text):
                yield end, key, entry, weight

    def found_unsure(self, text: str) -> Iterator[tuple[int, str, str | None, float]]:
        """The same in a text of ``fold_unsure``, for matches that ``fold`` does not show."""
        if self.unsure:
            for end, entries in self.unsure.iter(text.translate(_ONE_OF)):
                for key, entry, weight in entries:
                    here = text[end - len(key) + 1 : end + 1]
                    fits = all(a == b or b in READINGS.get(a, "") for a, b in zip(here, key, strict=True))
                    if fits and here.translate(_FOLDED_SIGN) != key:
                        yield end, key, entry, weight

    def found_spelled(self, text: str) -> Iterator[tuple[str, float]]:
        """(entry, weight) of entries that letters standing alone spell."""
        if self.spelled:
            for run in _SPELLED.findall(text):
                for _, value in self.spelled.iter(run.replace(" ", "")):
                    yield value


def matches(matcher: Matcher, text: str) -> tuple[list[tuple[str, float]], int]:
    """(entry, weight) of each match in a text, longest at each word and none inside an exception; its words."""
    folded = " ".join(fold(text).split())
    n = folded.count(" ") + 1 if folded else 0
    if not n:
        return [], n
    best: dict[int, tuple[int, str | None, float]] = {}
    hidden = []
    found = list(matcher.found(f" {folded} "))
    if unsure := fold_unsure(text):
        # Places behind those of the other text, in which a sign can be a space.
        found += ((end + len(folded) + 2, *rest) for end, *rest in matcher.found_unsure(f" {' '.join(unsure.split())} "))
    for end, key, entry, weight in found:
        start = end - len(key) + 1
        if entry is None:
            hidden.append((start, end))
        if start not in best or len(key) > best[start][0]:
            best[start] = (len(key), entry, weight)
    for a, b in hidden:
        for start in [s for s in best if a <= s < b and s + best[s][0] - 1 <= b]:
            del best[start]
    whole = [(entry, weight) for _, entry, weight in best.values() if entry is not None]
    return whole + list(matcher.found_spelled(f" {folded} ")), n


def features(found: list[tuple[str, float]], n: int) -> list[float]:
    """What the curve reads: a constant, all weights, distinct weights for the length of the text, the length."""
    total = sum(w for _, w in found)
    distinct = sum(dict(found).values())
    return [1.0, math.log1p(max(total, 0.0)), math.log1p(max(distinct, 0.0) * 1000 / (n + 100)), math.log1p(n) / 10]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches, "text"):
        counts = (Counter(), Counter())
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            counts[label].update(set(fold(text).split()))
        words = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean"])


def _count_pairs(known: frozenset[str]):
    """The task that counts texts with each pair of neighbouring words of which one is ``known``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches, "text"):
            counts = (Counter(), Counter())
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                words = fold(text).split()
                pairs = zip(words, words[1:], strict=False)
                counts[label].update({f"{a} {b}" for a, b in pairs if (a in known) != (b in known)})
            pairs = list(counts[0].keys() | counts[1].keys())
            columns = [pa.array(pairs, pa.string()), *(pa.array([counts[k][w] for w in pairs], pa.int64()) for k in (1, 0))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "clean"])

    return run


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least shingle of each text, which copies and near copies mostly share."""
    for batch in flat.slices(batches, "text"):
        hashes, bounds = shingle_sets(batch.column("text"))
        least = [int(flat.mix(hashes[a:b]).view(np.int64).min()) if b > a else 0 for a, b in zip(bounds, bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=[*batch.schema.names, "least"])


def _ratio(toxic: Column, clean: Column, n_toxic: float, n_clean: float) -> Column:
    """Log-likelihood ratio that a word is commoner in toxic documents than in clean ones; 0 if it is not."""

    def part(k: Column, n: Column, p: Column) -> Column:
        p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    a, b = toxic.cast("double"), clean.cast("double")
    t, c = F.lit(n_toxic), F.lit(n_clean)
    a, b = F.least(a, t), F.least(b, c)
    both = (a + b) / (t + c)
    gain = part(a, t, a / t) + part(b, c, b / c) - part(a, t, both) - part(b, c, both)
    return F.when(a / t > b / c, 2 * gain).otherwise(0.0)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label_col: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    sample: int = SAMPLE,
    exceptions: tuple[str, ...] = EXCEPTIONS,
) -> Lexicon:
    """The lexicon of ``labels`` (``id_col``, ``label_col`` of 0 or 1): from ``sample`` of them, chosen by a hash.

    Null labels, ids and texts are left out.  With labels of one kind only, the lexicon is empty and the curve
    gives the same score to all texts.
    """
    ship_package(documents.sparkSession)
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where("id is not null and label in (0, 1)").distinct()
    chosen = marked.withColumn("order", F.xxhash64(F.lit(4), "id")).orderBy("order", "label").limit(sample)
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # At most ``sample`` rows of two numbers are broadcast; near copies count once.
    known = texts.join(F.broadcast(chosen), "id").select("order", "label", "text")
    schema = "order long, label int, text string, least long"
    known = known.mapInArrow(_sketch, schema).groupBy("label", "least").agg(F.min_by(F.struct("order", "text"), "order").alias("one"))
    known = known.select("label", "one.order", "one.text").persist()
    try:
        learn, tune = known.where("pmod(order, 3) > 0"), known.where("pmod(order, 3) = 0")
        sizes = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
        if not sizes.get(0) or not sizes.get(1):
            return Lexicon({}, {}, list(exceptions))
        lexicon = _learn(learn, sizes[1], sizes[0], exceptions)
        lexicon.curve = _curve(tune, lexicon)
        return lexicon
    finally:
        known.unpersist()


def _learn(learn: DataFrame, n_toxic: int, n_clean: int, exceptions: tuple[str, ...]) -> Lexicon:
    words = learn.select("label", "text").mapInArrow(_count_words, "word string, toxic long, clean long")
    words = words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))

    def best(table: DataFrame, name: str) -> DataFrame:
        gain = _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)
        good = table.withColumn("gain", gain).withColumn("odds", odds).where((F.col("gain") >= EVIDENCE) & (F.col("toxic") >= SUPPORT))
        return good.orderBy(F.desc("gain"), name)

    whole = {r["word"]: float(r["odds"]) for r in best(words.where(F.length("word") > 2), "word").collect()}
    cuts = F.explode(F.filter(F.transform(F.array(*map(F.lit, BEGINNINGS)), lambda k: F.substring("word", F.lit(1), k)), lambda s: F.length(s) < F.length("word")))
    # Forms that clean texts use again and again are exceptions to a family, not part of it.  (Leaving out those
    # that one clean text uses would leave of any beginning what toxic texts happen to have.)
    usual = (F.col("clean") >= 2) & (odds < 1)
    starts = words.where(~usual).select(cuts.alias("start"), "toxic", "clean").groupBy("start")
    starts = starts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count("*").alias("forms"))
    starts = starts.where((F.col("forms") >= 4) & (F.col("clean") * 10 <= F.col("toxic")))
    beginnings: dict[str, float] = {}
    for row in sorted(best(starts, "start").collect(), key=lambda r: (-r["gain"], -len(r["start"]), r["start"])):
        start = row["start"]
        if not any(start.startswith(b) or b.startswith(start) for b in beginnings):
            beginnings[start] = float(row["odds"])
    hidden = []
    if beginnings:
        keys = sorted(beginnings)
        like = F.lit(False)
        for k in BEGINNINGS:
            own = [s for s in keys if len(s) == k]
            if own:
                like = like | F.substring("word", 1, k).isin(own)
        clean = words.where(like & usual)
        hidden = [r["word"] for r in clean.orderBy(F.desc("clean"), "word").collect() if r["word"] not in whole]
    words.unpersist()
    if whole:
        pairs = learn.select("label", "text").mapInArrow(_count_pairs(frozenset(whole)), "word string, toxic long, clean long")
        pairs = pairs.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # Harmless as often as words are taken to be harmful: the same number of texts, and odds ten to one.
        harmless = pairs.where((F.col("clean") >= SUPPORT) & (F.col("toxic") * n_clean * 10 <= F.col("clean") * n_toxic))
        hidden += [r["word"] for r in harmless.orderBy("word").collect()]
    return Lexicon(whole, beginnings, [*exceptions, *hidden])


def _curve(tune: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Logistic coefficients over a third of the sample, with a weak pull to 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = [features(*matches(automaton, t)) for t in batch.column("text").to_pylist()]
            columns = [pa.array([r[k] for r in rows], pa.float64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), *columns], names=["label", "f0", "f1", "f2", "f3"])

    rows = tune.select("label", "text").mapInArrow(run, "label int, f0 double, f1 double, f2 double, f3 double")
    # Equal rows are counted together; there are no more than the sample has.
    rows = rows.groupBy("label", "f0", "f1", "f2", "f3").count().orderBy("label", "f0", "f1", "f2", "f3").collect()
    if not rows:
        return np.zeros(4)
    return logistic(np.array([r[1:5] for r in rows]), np.array([r[0] for r in rows]), np.array([r[5] for r in rows], float))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Coefficients of the weighted logistic curve by Newton steps, each halved until it gains.

    The pull to 0 keeps them finite where the labels can be told apart without error.
    """
    pull = np.array([1e-3, *[0.1] * (x.shape[1] - 1)])

    def gain(c: np.ndarray) -> float:
        z = x @ c
        return float((n * (y * z - np.logaddexp(0, z))).sum() - (pull * c * c).sum() / 2)

    coefficients = np.zeros(x.shape[1])
    best = gain(coefficients)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ coefficients, -500, 500)))
        gradient = x.T @ (n * (y - p)) - pull * coefficients
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull), gradient)
        while (found := gain(coefficients + step)) < best and np.abs(step).max() > 1e-12:
            step /= 2
        if found - best < 1e-10:
            break
        coefficients, best = coefficients + step, found
    return coefficients


def score(documents: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", carry=()) -> DataFrame:
    """(doc_id, score, predicted, n_matches, entries, row) of each row of ``documents``.

    ``row`` holds the columns ``carry``.  ``score`` from 0 to 1 rises with toxicity; ``entries`` are the distinct lexicon entries found, sorted.  Null
    and empty texts match nothing; rows that repeat score alike; no rows give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        automaton = model.automaton()
        for batch in flat.slices(batches, "text"):
            scores, numbers, entries = [], [], []
            for text in batch.column("text").to_pylist():
                found, n = matches(automaton, text or "")
                value = float(np.clip(np.dot(model.curve, features(found, n)), -30, 30))
                scores.append(1 / (1 + math.exp(-value)))
                numbers.append(len(found))
                entries.append(sorted(dict(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= 0.5) for s in scores], pa.int32()),
                    pa.array(numbers, pa.int64()),
                    pa.array(entries, pa.list_(pa.string())),
                    batch.column("row"),
                ],
                names=["doc_id", "score", "predicted", "n_matches", "entries", "row"],
            )

    chosen = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), flat.carried(carry))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"doc_id {kind}, score double, predicted int, n_matches long, entries array<string>"
    return chosen.mapInArrow(run, flat.with_row(chosen, schema))
