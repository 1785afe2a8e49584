import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tablekeep.llm import packing
from tests.llm.samples import documents, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def check(rows, expected, capacity):
    """Pieces cover every document, sequences are gapless and padded little."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    crcs = sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows if r.doc_id is not None)
    for doc_id, start, length, crc in crcs:
        assert any(
            zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length])) == crc
            for ids in expected[doc_id]
            if len(ids) >= start + length
        )
    total = sum(r.length for r in rows)
    assert total == sum(len(ids) for many in expected.values() for ids in many)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


@pytest.mark.parametrize("capacity", [8, 100, 4096])
def test_against_tokenizer(spark, tokenizer, capacity):
    rows = packing.pack(frame(spark), PATH, capacity=capacity).collect()
    expected = {}
    for doc_id, text, *_ in documents():
        expected.setdefault(doc_id, []).append(ids_of(tokenizer, text))
    check(rows, expected, capacity)


def test_odd_texts(tokenizer):
    pick = random.Random(1)
    pools = ["ab ", "aB'sI'm re ", "é É ß÷×", "<|endoftext|> <", "12 a1.,!?", "日本   \x1c\t", "İÍé "]
    texts = ["".join(pick.choice(pick.choice(pools)) for _ in range(pick.randint(0, 60))) for _ in range(800)]
    texts += [prose(i, 30) for i in range(20)] + ["", "<|startoftext|>a", "x" * 5000]
    own = packing.Tokens(PATH)
    ids, bounds = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() + [2] == ids_of(tokenizer, text), text


def test_other_files_are_asked_for_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words", "", "a\nb"]
    ids, bounds = packing.Tokens(path).encode(pa.array(texts))
    for i, text in enumerate(texts):
        expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert ids[bounds[i] : bounds[i + 1]].tolist() == expected


def test_closest_fill_against_all_multisets():
    pick = random.Random(2)
    for _ in range(300):
        counts = {pick.randint(1, 30): pick.randint(1, 4) for _ in range(pick.randint(0, 5))}
        capacity = pick.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        used = packing.closest_fill(counts, capacity)
        assert all(n <= counts[length] for length, n in used.items())
        assert sum(length * n for length, n in used.items()) == max(s for s in sums if s <= capacity)


def test_whole_documents_stay_whole_where_they_can(spark):
    docs = frame(spark, [(i, prose(i, 20), "en", "s", 0) for i in range(2000)], parts=1)
    rows = packing.pack(docs, PATH).collect()
    assert len(rows) < 2000 * 1.02


def test_empty_ids_and_columns(spark):
    assert packing.pack(frame(spark, []), PATH).collect() == []
    docs = frame(spark, [(1, "a b", "en", "s", 3)]).withColumnRenamed("lang", "sequence_id")
    rows = packing.pack(docs.withColumnRenamed("n_chars", "length"), PATH, with_ids=True).collect()
    assert [(r.doc_tokens, r.length, len(r.ids)) for r in rows] == [(3, 2, 2), (3, 1, 1)]
