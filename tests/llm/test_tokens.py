import random
import zlib
from array import array

import numpy as np
import pytest

from gridledger.llm import packing, token_counts
from gridledger.llm.common import Tokens
from gridledger.llm.queries import tokenizer_file


@pytest.fixture(scope="module")
def tokens():
    return Tokens(tokenizer_file())


def texts():
    rng = random.Random(1)
    letters = "abcxyzÀÉéß'.,!-_1２你好 \t\n\r\x0b\x0c  éª<|>ǅİΣ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 120))) for _ in range(300)]
    return [*out, "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "don't I'LL ''s", "", "thre*** THE!! (a) b]"]


def whole(tokens, text):
    return tokens.library.encode(text, add_special_tokens=False).ids


def test_word_ids_are_the_librarys(tokens):
    for text in texts():
        assert list(array("I", tokens.of([text])[0])) == whole(tokens, text), repr(text)


def test_kept_words_are_bounded():
    few = Tokens(tokenizer_file(), most_words=3)
    text = "one two three four five six, one two"
    assert list(array("I", few.of([text])[0])) == whole(few, text) and len(few.kept) <= 4


def test_splices_equal_whole_texts(tokens):
    rng = random.Random(2)
    for _ in range(25):
        text = " ".join(rng.choice(texts()) for _ in range(12))
        for chunk, overlap in ((80, 10), (200, 40), (400, 64)):
            assert token_counts.count_huge(tokens.library, text, chunk=chunk, overlap=overlap)[0] == len(whole(tokens, text))


def test_overlap_is_widened_without_boundaries(tokens):
    text = "ab" * 900 + " c " + "é" * 700
    n, widened = token_counts.count_huge(tokens.library, text, chunk=200, overlap=40)
    assert n == len(whole(tokens, text)) and widened > 0


def test_counts(docs, tokens):
    rows = [(1, "a b, c"), (2, None), (3, ""), (None, "É"), (1, "a b, c"), (4, "word. " * 9000)]
    got = token_counts.token_counts(docs(rows), tokenizer_file()).collect()
    want = [(i, len((x or "").encode()), len(whole(tokens, x or "")), len(whole(tokens, x or "")) > 2048) for i, x in rows]
    assert sorted([tuple(r)[:4] for r in got], key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs([]), tokenizer_file()).count() == 0


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(docs, tokens):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(int(rng.expovariate(1 / 60))))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "x y"), (5, "repeated"), (1002, "long text, " * 300)]
    got = packing.pack_documents(docs(rows).repartition(11), tokenizer_file(), capacity=128).collect()
    total, want = 0, []
    for i, x in rows:
        ids = [*whole(tokens, x or ""), 1]
        total += len(ids)
        for no, at in enumerate(range(0, len(ids), 128)):
            piece = ids[at : at + 128]
            want.append((i, no, at, len(piece), zlib.crc32(np.asarray(piece, "<u4").tobytes())))
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    assert check_packed(got, 128) <= 1.02 * total / 128 + 1
    assert packing.pack_documents(docs([]), tokenizer_file()).count() == 0


def test_levels_and_bins_that_nothing_fills(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    for lengths in ([60] * 300, [70, 30] * 200, [100] * 5, [1], [33] * 301):
        pieces = spark.createDataFrame(list(enumerate(lengths)), "key long, length long").repartition(20)
        got = packing.pack(pieces, capacity=100).join(pieces, "key").collect()
        assert len(got) == len(lengths)
        n = check_packed(got, 100)
        per = {60: len(lengths), 70: 200, 100: 5, 1: 1, 33: 101}[lengths[0]]
        assert n <= per * 1.1 + 1


def test_packing_does_not_depend_on_the_order_of_its_input(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 200)
    rng = random.Random(6)
    lengths = [rng.randrange(1, 4000) for _ in range(4000)]
    counts = []
    for order in (lengths, sorted(lengths), sorted(lengths, reverse=True)):
        pieces = spark.createDataFrame(list(enumerate(order)), "key long, length long").coalesce(16)
        counts.append(check_packed(packing.pack(pieces).join(pieces, "key").collect(), 4096))
    at_once = len(packing.best_fit(np.asarray(lengths), 4096)[2])
    assert max(counts) <= 1.01 * min(counts) + 1
    assert max(counts) <= 1.05 * at_once  # blocks of 200 pieces see little of the table
