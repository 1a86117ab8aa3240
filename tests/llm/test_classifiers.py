import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cotaflow.llm import quality, toxicity

from .corpus import awkward_texts, collected, documents

RUDE = ["fiend", "oaf", "wretch", "dunce"]


def labelled(seed, n=400):
    """(id, text, quality, toxic): junk shouts or repeats, toxic texts hold rude words or forms of one stem."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    rows = []
    for i in range(n):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        good, toxic = int(rng.random() < 0.8), int(rng.random() < 0.3)
        if toxic:
            for _ in range(rng.randint(2, 5)):
                word = rng.choice(RUDE) if rng.random() < 0.6 else "vexol" + rng.choice(vocabulary)
                text.insert(rng.randrange(len(text)), word)
        if not good:
            text = [w.upper() + "!!" for w in text] if rng.random() < 0.5 else text[:6] * 20
        rows.append((i, " ".join(text), good, toxic))
    return rows


def tables(spark, seed):
    rows = labelled(seed)
    labels = spark.createDataFrame(
        pa.table({"doc_id": [r[0] for r in rows], "quality": [r[2] for r in rows], "toxic": [r[3] for r in rows], "text": ["x"] * len(rows)})
    )
    return rows, documents(spark, [r[:2] for r in rows]), labels


def accuracy(scored, truth):
    got = {r["doc_id"]: r["predicted"] for r in scored.collect()}
    return np.mean([got[i] == y for i, y in truth.items()])


def test_quality_on_rows_that_were_held_out(spark):
    rows, docs, labels = tables(spark, 1)
    described = quality.describe(docs)
    model = quality.fit(described, labels.where("doc_id % 3 <> 1"), "quality")
    assert accuracy(quality.score(described, model), {r[0]: r[2] for r in rows if r[0] % 3 == 1}) > 0.95


def test_toxicity_on_rows_that_were_held_out(spark):
    rows, docs, labels = tables(spark, 2)
    lexicon = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"), "toxic")
    assert set(lexicon.words) >= set(RUDE) and {b[:4] for b in lexicon.beginnings} == {"vexo"}
    assert accuracy(toxicity.score(docs, lexicon), {r[0]: r[3] for r in rows if r[0] % 3 == 1}) > 0.95


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_awkward_rows_and_tables(spark, module, label):
    _, docs, labels = tables(spark, 3)
    take = quality.describe if module is quality else lambda table: table
    model = module.fit(take(docs), labels, label)
    rows = [*awkward_texts(8), (None, "no id"), (None, None)]
    found = collected(module.score(take(documents(spark, rows)), model), "doc_id", "score", "predicted")
    assert len(found) == len(rows) and all(0 <= s <= 1 and p == (s >= 0.5) for _, s, p in found)
    scores = {}
    for i, score, _ in found:
        scores.setdefault(i, set()).add(score)
    blank = [scores[i] for i, text in rows if i is not None and not text]
    assert len(set.union(*blank)) == 1  # null and empty texts score alike
    assert all(len(s) == 1 for i, s in scores.items() if i is not None)  # so do repeated rows
    empty = take(documents(spark, []))
    assert module.score(empty, model).count() == 0
    for untrained in (module.fit(empty, labels, label), module.fit(take(docs), labels.where("1 = 0"), label)):
        assert len({s for _, s, _ in collected(module.score(take(docs.where("doc_id < 9")), untrained), "doc_id", "score", "predicted")}) <= 9


def test_labels_may_be_null_or_of_one_kind(spark):
    _, docs, labels = tables(spark, 4)
    described = quality.describe(docs)
    odd = labels.selectExpr("nullif(doc_id, 3) AS doc_id", "CASE WHEN doc_id > 5 THEN 1 END AS quality", "CASE WHEN doc_id > 5 THEN 1 END AS toxic")
    assert {r["score"] for r in quality.score(described, quality.fit(described, odd, "quality")).collect()} == {0.5}
    assert toxicity.fit(docs, odd, "toxic").words == {}


def test_statistics_do_not_depend_on_the_batch():
    texts = pa.array([t for _, t in awkward_texts(9)], pa.string())
    whole = quality.statistics(texts)
    for i in range(0, len(texts), 7):
        assert np.allclose(whole[i : i + 7], quality.statistics(texts.slice(i, 7)), atol=1e-9)


@pytest.mark.parametrize(
    "text, entries",
    [
        ("You IDIOT!", ["idiot"]),
        ("y0u 1d10t", ["idiot"]),
        ("іdіоt with Cyrillic letters", ["idiot"]),  # noqa: RUF001
        ("id​iot", ["idiot"]),
        ("ｉｄｉｏｔ", ["idiot"]),  # noqa: RUF001
        ("tr@sh and tra$h$$$", ["trash"] * 2),
        ("idi\u0301ot", ["idiot"]),
        ("$lime but a $tupid idiot", ["stupid", "idiot"]),
        ("tra$$h", []),  # two s
        ("dumba$$ and a$$", ["dumbass"]),
        ("id!ot, id!ot! id|ot", ["idiot"] * 3),
        ("an idiot!you know", ["idiot"]),
        ("foo1 f001 fool fooi", ["fool"] * 3),
        ("ki1l 1ikel1 b1l1on bi1!on", ["bilion", "likeli", "bilion"]),
        ("6oor and 6og, big6y bi6gy", ["biggy"] * 2),
        ("i d i o t", ["idiot"]),
        ("a i.d.i.o.t here and i-d-i-o-t!", ["idiot"] * 2),
        ("i d i o", []),
        ("idiotic", []),
        ("the trash can", []),
        ("the tra5h c@n", []),
        ("the trash can trash", ["trash"]),
        ("vexolar vexolent", ["vexol*"] * 2),
        ("vexolin is a good word", []),
        ("", []),
    ],
)
def test_matching(text, entries):
    entries_of = dict.fromkeys(("idiot", "trash", "stupid", "dumbass", "fool", "likeli", "bilion", "biggy"), 1.0)
    lexicon = toxicity.Lexicon(entries_of, {"vexol": 1.5}, ["trash can", "vexolin"])
    found, _ = toxicity.matches(lexicon.automaton(), text)
    assert [e for e, _ in found] == entries


def plain_matches(lexicon, text):
    """Entries of plain texts by regular expressions: words as they are, no signs of several readings, no letters alone."""
    folded = f" {' '.join(toxicity.fold(text).split())} "
    keys = {f" {w} ": w for w in lexicon.words} | {f" {b}": b + "*" for b in lexicon.beginnings} | {f" {e} ": None for e in lexicon.exceptions}
    found = [(m.start(), key, entry) for key, entry in keys.items() for m in re.finditer(f"(?={re.escape(key)})", folded)]
    hidden = [(a, a + len(key) - 1) for a, key, entry in found if entry is None]
    best = {}
    for start, key, entry in sorted(found, key=lambda f: (f[0], len(f[1]))):
        best[start] = (len(key), entry)
    inside = lambda a, n: any(x <= a < y and a + n - 1 <= y for x, y in hidden)
    return Counter(entry for a, (n, entry) in best.items() if entry and not inside(a, n))


def test_toxicity_equals_a_plain_matcher(spark):
    """All texts of a corpus, awkward ones too, scored by hand from regular expressions and the curve."""
    rows, docs, labels = tables(spark, 5)
    lexicon = toxicity.fit(docs, labels.where("doc_id % 3 <> 1"), "toxic")
    lexicon.exceptions = [*lexicon.exceptions, f"{RUDE[0]} of {RUDE[1]}"]
    texts = [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in awkward_texts(4) if i is not None]
    texts += [(5000, f"{RUDE[0]} of {RUDE[1]} and {RUDE[1]}"), (5001, f"{RUDE[0].upper()}, {RUDE[0]}! vexolent")]
    weights = lexicon.words | {b + "*": w for b, w in lexicon.beginnings.items()}
    want = set()
    for i, text in texts:
        found = plain_matches(lexicon, text or "")
        n = len(toxicity.fold(text or "").split())
        total, distinct = sum(weights[e] * k for e, k in found.items()), sum(weights[e] for e in found)
        x = [1, math.log1p(max(total, 0)), math.log1p(max(distinct, 0) * 1000 / (n + 100)), math.log1p(n) / 10]
        want.add((i, round(1 / (1 + math.exp(-np.clip(np.dot(lexicon.curve, x), -30, 30))), 9), sum(found.values())))
    got = {(r["doc_id"], round(r["score"], 9), r["n_matches"]) for r in toxicity.score(documents(spark, texts), lexicon).collect()}
    assert got == want


def test_exceptions_are_learned_from_clean_texts(spark):
    """A pair of words that clean texts hold again and again hides the entry in it."""
    rng = random.Random(8)
    filler = lambda: " ".join("".join(rng.choice("bcdfgklmnp") + rng.choice("aeo") for _ in range(3)) for _ in range(30))
    rows = [(i, f"{filler()} {'fiend' if i % 2 else ''} {filler()}" + (" fiend club" if i % 40 == 0 else "")) for i in range(800)]
    labels = spark.createDataFrame(pa.table({"doc_id": [i for i, _ in rows], "toxic": [i % 2 for i, _ in rows]}))
    lexicon = toxicity.fit(documents(spark, rows), labels, "toxic")
    assert "fiend" in lexicon.words and "fiend club" in lexicon.exceptions
    assert toxicity.matches(lexicon.automaton(), "fiend club")[0] == [] and toxicity.matches(lexicon.automaton(), "club fiend")[0]


@pytest.mark.parametrize("noise", [0.0, 0.1])
def test_logistic_curve_finds_the_labels(noise):
    """Also where they can be told apart without error, and where two features say the same."""
    rng = np.random.default_rng(3)
    hits = np.where(rng.random(3000) < 0.1, rng.uniform(3, 9, 3000), 0.0)
    y = ((hits > 0) ^ (rng.random(3000) < noise)).astype(int)
    x = np.column_stack((np.ones(3000), hits, hits * 0.9 + rng.normal(0, 0.01, 3000), rng.uniform(0.3, 0.8, 3000)))
    found = toxicity.logistic(x, y, np.ones(3000))
    assert ((x @ found > 0) == (hits > 0)).all()


def test_quality_equals_a_plain_discriminant(spark):
    """Class means and shrunken covariances of all rows at once, densities by solving, over the same statistics."""
    rows, docs, labels = tables(spark, 6)
    described = quality.describe(docs)
    known = labels.where("doc_id % 3 <> 1")
    scored = quality.score(described, quality.fit(described, known, "quality"))
    x = quality.statistics(pa.array([r[1] for r in rows]))
    learn = np.array([r[0] % 3 != 1 for r in rows])
    label = np.array([r[2] for r in rows])
    covariances, means, shares = [], [], []
    for k in (0, 1):
        own = x[learn & (label == k)]
        means.append(own.mean(axis=0))
        covariances.append((own - means[k]).T @ (own - means[k]) / len(own))
        shares.append(len(own) / learn.sum())
    pooled = sum(c * s for c, s in zip(covariances, shares, strict=True))
    logs = []
    for k in (0, 1):
        c = covariances[k]
        c = (1 - quality.SHRINK_DIAGONAL) * c + quality.SHRINK_DIAGONAL * np.diag(np.diag(c))
        c = (1 - quality.SHRINK_POOLED) * c + quality.SHRINK_POOLED * pooled + quality.RIDGE * np.eye(len(c))
        away = x - means[k]
        logs.append(np.log(shares[k]) - np.linalg.slogdet(c)[1] / 2 - (away * np.linalg.solve(c, away.T).T).sum(axis=1) / 2)
    want = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
    found = {r["doc_id"]: (r["score"], r["predicted"]) for r in scored.collect()}
    assert np.allclose([found[r[0]][0] for r in rows], want, atol=1e-6)
    assert [found[r[0]][1] for r in rows] == [int(w >= 0.5) for w in want]
