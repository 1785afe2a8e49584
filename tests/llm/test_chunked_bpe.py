import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablekeep.llm.chunked_bpe import LONGEST, SHORTEST, Decoder, Slice, Tokens, cuts, encode, encode_slice
from tests.llm.samples import documents, frame, prose

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def tokens():
    return Tokens(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    return len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()


AWKWARD = [
    prose(9, 20000),
    "x" * 20000,  # no word ends, so the join is the whole text
    "日本語テキスト" * 2000,
    ("word " * 3000 + "y" * 9000) * 2,
    "it's" * 3000,
    "é" * 5000 + " " + "Σίσυφος " * 900,
    "<|endoftext|>" * 600,
    " " * 20000 + "a",
    "  　x" * 2000,
    "12345 67.89, " * 800,
]


def test_awkward_texts_give_the_library_ids(tokens):
    part = Slice(pa.array(AWKWARD))
    assert len(part.starts) > 60
    for text, ids in zip(AWKWARD, encode_slice(part, tokens)):
        assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abé' \n3!Σ<|>日", min_size=0, max_size=40), min_size=1, max_size=8), st.integers(1, 60))
def test_any_text(units, times):
    text = "".join(units) * times
    ids = encode_slice(Slice(pa.array([text])), Tokens(PATH))[0]
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_another_kind_of_tokenizer_is_exact_too():
    """Here a word's ids depend on the space before it, so joins only agree as whole texts."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [prose(3, 900), "one two  three " * 300]
    library = Tokenizer.from_file(path)
    for text, ids in zip(texts, encode_slice(Slice(pa.array(texts)), Tokens(path))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert Decoder(library).decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_cuts_follow_the_content():
    passage = prose(5, 3000)
    a, b = Slice(pa.array([prose(6, 500) + passage])), Slice(pa.array([prose(7, 900) + passage]))
    same = {tuple(k) for k in a.keys.tolist()} & {tuple(k) for k in b.keys.tolist()}
    assert len(same) >= 0.8 * len(passage.encode()) / 1500
    sizes = a.ends - a.starts
    assert sizes[:-1].min() >= SHORTEST and sizes.max() <= LONGEST + 3
    assert a.ends[:-1].tolist() == a.starts[1:].tolist()


def test_cuts_keep_characters_whole():
    text = "日" * 30000
    part = Slice(pa.array([text, "", text]))
    assert all(len(c.as_py()) for c in part.chunks(np.arange(len(part.starts))))
    assert len(cuts(np.empty(0, np.uint8), np.zeros(3, np.int64))[0]) == 0


def rows_of(docs):
    return sorted(((r[0], expected(r[1])) for r in docs), key=repr)


def test_rows_with_nulls_copies_and_shared_passages(spark):
    passage = prose(11, 1500)
    docs = documents()
    docs += [(100 + i, prose(20 + i, 200) + passage + prose(50 + i, 300), "en", "s", 1) for i in range(6)]
    docs += [(200 + i, passage, "en", "s", 1) for i in range(40)]  # a hot group of copies
    found = encode(frame(spark, docs, 5), PATH)
    assert sorted(((r[0], tuple(r)[1:]) for r in found.collect()), key=repr) == rows_of(docs)


def test_ids_empty_table_and_clashing_columns(spark):
    docs = [(1, "some words " * 200), (2, None), (3, "some words " * 200)]
    clashing = spark.createDataFrame([(*d, 5, "x") for d in docs], "key long, body string, id int, row string")
    found = {r["key"]: r for r in encode(clashing, PATH, "key", "body", with_ids=True).collect()}
    assert found[1]["ids"] == LIBRARY.encode(docs[0][1], add_special_tokens=False).ids
    assert found[2]["ids"] == [] and found[3]["ids"] == found[1]["ids"]
    assert encode(frame(spark, []), PATH).collect() == []
