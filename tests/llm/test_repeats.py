import hashlib
import random
from collections import Counter

import pytest

from tablekeep.llm import repeats
from tests.llm.samples import documents, frame, prose


def expected(texts, length):
    """Per text: bytes, removed bytes, runs and the digest of the rest, by counting all windows."""
    raw = [(t or "").encode() for t in texts]
    times = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if times[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def check(spark, texts, length, **options):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    result = repeats.remove_repeats(frame(spark, rows), length=length, **options)
    got = sorted(result.collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expected(texts, length)
    assert [r.text for r in got] == texts
    return got


def spliced(seed, texts, passages):
    """Texts made of own prose and pieces of common passages."""
    pick = random.Random(seed)
    common = [prose(1000 + seed * 50 + i, 60) for i in range(passages)]
    out = []
    for i in range(texts):
        parts = []
        for _ in range(pick.randint(1, 4)):
            whole = pick.choice(common)
            a = pick.randint(0, len(whole) // 2)
            parts += [prose(seed * 1000 + i, pick.randint(0, 30)), whole[a : a + pick.randint(10, 400)]]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize("length", [8, 21, 200])
def test_awkward_documents(spark, length):
    check(spark, [t for _, t, *_ in documents()], length)


@pytest.mark.parametrize("group", [2, 6, 256])
def test_common_passages(spark, group):
    got = check(spark, spliced(1, 60, 3), 60, group=group)
    assert any(0 < r.n_removed < r.n_bytes for r in got)


def test_a_passage_in_very_many_texts(spark):
    """More contexts of one anchor than are sorted together, at all offsets."""
    passage = prose(77, 40)
    texts = [prose(i, 12) + passage[i % 5 :] + prose(500 + i, 12) for i in range(80)]
    check(spark, texts, 50, group=8)


def test_near_copies_and_periods(spark):
    base = prose(5, 150)
    texts = [base[: 40 * i] + "#" * i + base[40 * i :] for i in range(12)]
    texts += ["ab" * 300, "abc" * 100 + base[:300], "é" * 150 + "日本" * 90, "é" * 120]
    check(spark, texts, 30)
    check(spark, texts, 200, group=3)


def test_chunks_of_long_texts(monkeypatch):
    finder = repeats.Anchors(20)
    import numpy as np

    raw = np.frombuffer((prose(1, 3000) + "x" * 900).encode(), np.uint8)
    bounds = np.array([0, 0, 15, 15 + 5000, len(raw)])
    whole = finder.find(raw, bounds)
    monkeypatch.setattr(repeats, "CHUNK", 256)
    small = repeats.Anchors(20)
    parts = small.find(raw, bounds)
    # the chunk size enters the order of hashes, so only what anchors guarantee can be compared
    for owner, at, _ in (whole, parts):
        for d in range(4):
            own = at[owner == d]
            for start in range(bounds[d], bounds[d + 1] - 20 + 1):
                assert ((own >= start) & (own + 10 <= start + 20)).any()


def test_kept_text_and_nulls(spark):
    common = "é" * 30
    rows = [(1, "x" + common + "y", "", "", 0), (2, "z" + common, "", "", 0), (3, None, "", "", 0)]
    got = {r.doc_id: r for r in repeats.remove_repeats(frame(spark, rows), length=41).collect()}
    assert (got[1].kept_text, got[2].kept_text, got[3].kept_text) == ("xy", "z", None)
    assert got[3].n_bytes == 0 and got[3].text is None
    assert [tuple(x) for x in got[1].removed] == [(1, 61)]


def test_repeated_rows_and_ids(spark):
    rows = [(None, prose(1, 40), None, None, None)] * 2 + [(1, prose(2, 40), "", "", 0), (1, "a", "", "", 0)]
    got = repeats.remove_repeats(frame(spark, rows), length=200).collect()
    assert sorted((r.n_bytes, r.n_removed) for r in got) == sorted(
        x[:2] for x in expected([r[1] for r in rows], 200)
    )


def test_empty_and_clashing_names(spark):
    assert repeats.remove_repeats(frame(spark, [])).collect() == []
    docs = frame(spark).withColumnRenamed("lang", "spans").withColumnRenamed("n_chars", "n_bytes")
    result = repeats.remove_repeats(docs.withColumnRenamed("source", "key"))
    assert result.columns == ["doc_id", "text", "spans", "key", *repeats.ADDED]
    assert result.count() == len(documents())
