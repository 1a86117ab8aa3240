import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from cotaflow.llm import bpe, maxmatch
from cotaflow.llm.queries import tokenizer_path

from .corpus import awkward_texts, collected, documents, words

PATH = tokenizer_path("byte_bpe_50k.json")
CONTENT = open(PATH, "rb").read()


def test_ids_and_decoding_are_those_of_the_library():
    rng, letters = random.Random(1), "ab e'stdll  \n\n\t\r\x1c\x85\xa0　 éß漢字🎉12½²!?-_$​́</|>"
    texts = [t or "" for _, t in awkward_texts(4)]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["x<|endoftext|>y <|endoftext|>", "<|endoftext|", "aaaaaaa" * 50, " " * 50, "a" * 30000, "'S 's 'LL don't", "﻿x"]
    table, library = bpe.ByteBPE(CONTENT), Tokenizer.from_file(PATH)
    for at in range(0, len(texts), 100):
        part = texts[at : at + 100]
        for text, ids in zip(part, table.encode(part), strict=True):
            ids = np.frombuffer(ids, "<u4")
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:80]
            assert table.decode(ids).tobytes().decode("utf-8", "replace") == library.decode(ids.tolist(), skip_special_tokens=False)


def test_forgetting_changes_nothing(monkeypatch):
    texts = [t or "" for _, t in awkward_texts(5)]
    table = bpe.ByteBPE(CONTENT)
    want = table.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert [table.encode([t])[0] for t in texts] == want


def test_rows(spark):
    rows = [*awkward_texts(6), (None, "no id"), (None, None)]
    found = bpe.encode_decode(documents(spark, rows), PATH)
    library = Tokenizer.from_file(PATH)
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), bytearray(np.array(ids, "<u4").tobytes()), library.decode(ids, skip_special_tokens=False)))
    assert collected(found, "doc_id", "n_tokens", "ids", "decoded") == sorted(want, key=repr)
    assert bpe.encode_decode(documents(spark, []), PATH).count() == 0


def greedy(pieces, word):
    longest, n, i = max(map(len, pieces)), 0, 0
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                i, n = j, n + 1
                break
        else:
            return maxmatch.UNKNOWN
    return n


@pytest.mark.parametrize("seed", range(8))
def test_automaton_counts_greedy_pieces(seed):
    """Also with vocabularies that can't spell every word."""
    rng = random.Random(seed)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(12)} | {b" ", b" a", b" ab"}
    machine = maxmatch.MaxMatch(sorted(pieces))
    tested = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    sizes = np.array([len(w) for w in tested])
    found = machine.counts(np.frombuffer(b"".join(tested), np.uint8), np.cumsum(sizes) - sizes, sizes)
    assert found.tolist() == [greedy(pieces, b" " + w) for w in tested]


def test_long_words_are_walked_alone(monkeypatch):
    """Words that outlast all others, with bytes that no piece has, give what the steps of all words give."""
    rng = random.Random(9)
    pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(12)} | {b" ", b" a", b" ab"}
    machine = maxmatch.MaxMatch(sorted(pieces))
    tested = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (1, 63, 64, 65, 200, 3000, 3000, 20_000)] + [b"ab" * 100 + b"z" + b"ab" * 400]
    sizes = np.array([len(w) for w in tested])
    data, starts = np.frombuffer(b"".join(tested), np.uint8), np.cumsum(sizes) - sizes
    found = machine.counts(data, starts, sizes).tolist()
    assert found == [greedy(pieces, b" " + w) for w in tested]
    monkeypatch.setattr(maxmatch, "FEW", 0)
    assert machine.counts(data, starts, sizes).tolist() == found


def test_token_counts(spark):
    rows = [*awkward_texts(7), (None, "no id"), (None, None)]
    pieces = set(maxmatch.vocabulary_pieces(CONTENT))
    want = []
    for i, text in rows:
        counts = [greedy(pieces, b" " + w.encode()) for w in words(text)]
        want.append((i, len(counts), sum(counts), max(counts, default=0)))
    found = maxmatch.token_counts(documents(spark, rows), PATH)
    assert collected(found, "doc_id", "n_words", "n_pieces", "longest_word") == sorted(want, key=repr)
    assert maxmatch.token_counts(documents(spark, []), PATH).count() == 0
