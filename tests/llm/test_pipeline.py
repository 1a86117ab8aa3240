import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import connect, differences
from cotaflow.llm import queries
from cotaflow.sources.scratch import staged

from .corpus import awkward_texts, documents, words
from .test_classifiers import labelled
from .test_mixing import plain_targets
from .test_neardup import plain as plain_components
from .test_substring import plain as plain_cut
from .test_substring import plain_as_written, spaced

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Awkward documents beside labelled ones, a third of which are toxic."""
    path = tmp_path_factory.mktemp("corpus")
    known = labelled(5, 300)
    rows = awkward_texts(20) + [(1000 + i, text) for i, text, *_ in known]
    documents(spark, rows).write.parquet(str(path / "documents.parquet"))
    labels = {"doc_id": [1000 + r[0] for r in known], "quality": [r[2] for r in known], "toxic": [r[3] for r in known]}
    pq.write_table(pa.table(labels), path / "labels.parquet")
    return str(path), {1000 + r[0] for r in known if r[3]}


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_every_stage(spark, folder):
    """Each stage against a plain version of it on what the one before has kept."""
    path, toxic = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, steps, frames = docs.columns, [pairs(docs)], [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(staged(stage(spark, frames[-1], path), name))
        if stage is not corpus_pipeline.encode:
            assert frames[-1].columns == columns
            steps.append(pairs(frames[-1]))
    everything, clean, single, cut, mixed = steps

    kept = Counter(everything) - Counter(clean)
    assert not Counter(clean) - Counter(everything)
    wrong = {i for i, _ in kept} ^ toxic
    assert len(wrong) <= 0.05 * len(everything)

    components = {(i, c) for i, _, c, _ in plain_components(clean)}
    assert sorted(i for i, _ in single) == sorted({c for _, c in components}) and set(single) <= set(clean)

    want = {i: (removed, text) for i, _, removed, text in plain_cut(single)}
    for (i, text), row in zip(sorted(cut), sorted(frames[3].collect(), key=lambda r: r["doc_id"]), strict=True):
        removed, left = want[i]
        assert (words(text), removed) == (left.split(" ") if left else [], len(words(dict(single)[i])) - len(words(left)))
        assert not removed or row["n_chars"] == len(text)

    sizes, taken = defaultdict(int), defaultdict(int)
    source = {r["doc_id"]: r["source"] for r in frames[3].collect()}
    for i, text in cut:
        sizes[source[i]] += len(words(text))
    for i, text in mixed:
        taken[source[i]] += len(words(text))
    assert set(mixed) <= set(cut) and max(Counter(mixed).values()) <= 3
    for name, target in plain_targets(sizes).items():
        assert abs(taken[name] - target) <= max(60, 0.03 * target)

    library = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))
    coded = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in frames[-1].collect())
    want = Counter()
    for i, text in mixed:
        ids = library.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        want[i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert coded == want


def test_cutting_leaves_white_space(spark):
    """Whole texts: clean documents stay as they are, null too; the others lose the passages only."""
    rows = spaced(awkward_texts(21), 21) + [(900, "one\n\ntwo\tthree   four "), (901, None), (902, "")]
    docs = documents(spark, rows)
    cut = corpus_pipeline.cut_repeats(spark, docs, "")
    want = plain_as_written(rows)
    assert sorted(pairs(cut), key=repr) == sorted(((i, text) for i, _, text in want), key=repr)
    assert sum(removed > 0 for _, removed, _ in want) > 10
    before = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect())
    after = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in cut.collect())
    clean = Counter((i, text) for i, removed, text in want if not removed)
    assert Counter((i, t) for i, t, _ in (before & after).elements()) >= clean
    assert all(n == len(t) for _, t, n in after - before)


def test_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64())}), tmp_path / "labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_equals_its_twin(spark, duck, name):
    assert not differences(spark, duck, SF, queries.QUERIES[name], queries.ORACLES[name])


CONTRACT = {
    "op2_quality_classifier": {"doc_id", "held_out", "score", "predicted"},
    "op3_token_counts": {"doc_id", "n_words", "n_pieces"},
    "op4_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op6_bpe_encode_decode": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_cross_polytope": {"query_id", "rank", "vec_id", "score"},
    "op10_source_mix": {"doc_id", "size", "source_size", "target", "taken"},
    "op11_whitening": {"vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"},
}


def test_every_query_is_checked():
    assert queries.QUERIES.keys() == queries.ORACLES.keys() | CONTRACT.keys()


@pytest.mark.parametrize("name", CONTRACT)
def test_query_covers_its_table(spark, name):
    found = queries.QUERIES[name](spark, SF)
    assert CONTRACT[name] <= set(found.columns)
    if name == "op11_whitening":
        assert found.count() == 32 * spark.read.parquet(f"{SF}/embeddings.parquet").count()
        assert found.agg({"identity_error": "max"}).first()[0] < 1e-4 and found.where("whitened is null or component not between 1 and 32").isEmpty()
    elif name != "op8_cross_polytope":
        assert found.select("doc_id").distinct().count() == found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    else:
        asked = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()
        assert found.count() == asked * 20
