import re
from collections import Counter

import pyarrow as pa
import pytest

from tablekeep.llm import quality_rules as rules
from tests.llm.samples import documents, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    marked = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        again,
        len(marked),
    )


def test_counts_against_plain_python():
    texts = [t or "" for _, t, *_ in documents()] + ["\n\n a \n a\n", "x y z x y z", "a b c a b"]
    found = rules.document_counts(pa.array(texts, pa.string()))
    rows = list(zip(*(found[n].tolist() for n in rules.COUNTS)))
    assert rows == [counts(t) for t in texts]


def line_hash(line):
    """The line's normal form, hashed; lines without a word have none."""
    normal = rules.normal_line(line)
    return rules._hash(normal) if normal else None


def frequent(rows, limit=10):
    """(host, hash of line) of the frequent lines of (host, text) rows, straightforwardly."""
    texts = {(host, text or "") for host, text in rows}
    lines = {t: [(line_hash(x), len(WORD.findall(x))) for x in t[1].split("\n")] for t in texts}
    having = Counter((t[0], x) for t in texts for x in {x for x, _ in lines[t]} - {None})
    votes = {}
    for t in texts:
        shared = sorted({x for x, _ in lines[t] if x is not None and 2 * having[t[0], x] > limit})
        common = sum(words for x, words in lines[t] if x in shared)
        near = common >= 0.8 * len(WORD.findall(t[1]))
        for x in shared:
            others = [y for y in shared if y != x]
            votes.setdefault((t[0], x), set()).add(("near", min(others, default=x)) if near else t)
    return {key for key, own in votes.items() if having[key] > limit and len(own) > limit}


def verdict(text, host, common, min_left=0.5):
    """(clean text, removed words, base failed, kept) of one document."""
    n, *_, repeated = counts(text or "")
    kept_lines, removed = [], 0
    for line in (text or "").split("\n"):
        if (host, line_hash(line)) in common:
            removed += len(WORD.findall(line))
        else:
            kept_lines.append(line)
    failed = n < 50 or 100 * repeated > 50 * n
    clean = text if text is None else "\n".join(kept_lines)
    return clean, removed, failed, not failed and n - removed >= min_left * n


def expected(rows, limit=10, min_left=0.5):
    common = frequent([(host, text) for _, text, _, host, _ in rows], limit)
    return Counter((i, *verdict(text, host, common, min_left)) for i, text, _, host, _ in rows)


def judged(spark, rows, **options):
    result = rules.quality_rules(frame(spark, rows), **options)
    return Counter(
        (r.doc_id, r.clean_text, r.removed_words, r.base_failed, r.kept) for r in result.collect()
    )


@pytest.mark.parametrize("limit,left", [(10, 0.2), (2, 0.9), (1, 0.5)])
def test_verdicts(spark, limit, left):
    rows = documents()
    for i in range(40):
        menu = "Home | News 12\nContact us\n" if i % 2 else "home  NEWS 99!\n"
        rows.append((100 + i, menu + prose(50 + i, 60 if i % 5 else 3), "en", f"src{i % 2}", 0))
    got = judged(spark, rows, limit=limit, min_left=left)
    assert got == expected(rows, limit, left)
    assert any(k[2] for k in got)


def thin_pages(count, thin, host="t"):
    """Pages with the same ten menu lines; the first ``thin`` have few words of their own."""
    menu = "".join(f"entry {chr(97 + i)} of the long menu here\n" for i in range(10))
    return [
        (20000 + i, menu + prose(30000 + i, 30 if i < thin else 300).replace("\n", " "), "en", host, 0)
        for i in range(count)
    ]


@pytest.mark.parametrize("bound", [rules.BROADCAST_BYTES, -1])
def test_three_hosts(spark, monkeypatch, bound):
    """Near copies only; thin pages and some long ones; both at once; and thin pages alone."""
    monkeypatch.setattr(rules, "BROADCAST_BYTES", bound)
    rows = near_copies(60, 0, 0, "near") + thin_pages(300, 250, "thin")
    rows += near_copies(60, 0, 0, "both", 40000) + thin_pages(120, 100, "both")
    rows += thin_pages(40, 40, "all thin")
    result = rules.quality_rules(frame(spark, rows)).collect()
    got = Counter((r.doc_id, r.clean_text, r.removed_words, r.base_failed, r.kept) for r in result)
    assert got == expected(rows)
    for r in result:
        thin = "of the long menu" in r.text
        assert r.removed_words == (70 if thin else 0)
        assert r.kept == (not thin or len(r.text) > 1200)


def test_copies_are_one_document(spark):
    rows = [(i, "A line of it\n" + prose(1, 80), "en", "s", 0) for i in range(60)]
    result = rules.quality_rules(frame(spark, rows)).collect()
    assert all(r.kept and r.removed_words == 0 for r in result)


def large_host():
    """200 documents of a host; a menu line in 15 of them, and every third with a licence."""
    rows = []
    for i in range(200):
        extra = "All rights reserved by us\n" * (i % 3 == 0) + "Home, news and contact\n" * (i < 15)
        rows.append((i, extra + prose(300 + i, 70), "en", "big", 0))
    return [*rows, rows[0], (None, rows[3][1], "en", None, 0), (900, rows[3][1], "en", "small", 0)]


@pytest.mark.parametrize("bound", [rules.BROADCAST_BYTES, -1])
def test_large_hosts_have_the_same_limit(spark, monkeypatch, bound):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", bound)
    rows = large_host()
    for row in rules.quality_rules(frame(spark, rows)).collect():
        words = 0
        if row.source == "big":
            words = 5 * (row.doc_id % 3 == 0) + 4 * (row.doc_id < 15)
        assert (row.removed_words, row.kept) == (words, True)
        assert ("Home" in row.clean_text) == (row.source != "big" and "Home" in row.text)


@pytest.mark.parametrize("bound", [rules.BROADCAST_BYTES, -1])
def test_most_of_a_text_must_stay(spark, monkeypatch, bound):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", bound)
    menu = " ".join(f"entry{i}" for i in range(60)) + "\n"
    rows = [(i, menu + prose(600 + i, 80), "en", "s", 0) for i in range(30)]
    rows += [(100 + i, menu + prose(700 + i, 40), "en", "s", 0) for i in range(5)]
    result = rules.quality_rules(frame(spark, rows)).collect()
    assert {r.doc_id for r in result if r.kept} == set(range(30))


def near_copies(count: int, others: int, far: int, host: str = "s", first: int = 0):
    """A group of near copies of many lines in a host, some of them far ones, and a menu line."""
    base = [prose(800 + i, 12).replace("\n", " ") for i in range(20)]
    menu, rows = ["Home, news and contact"] if others else [], []
    for i in range(count):
        own = list(base)
        own[i % 20] += f" changed{i}"
        own[(7 * i + 3) % 20] = f"other{i} " + own[(7 * i + 3) % 20]
        added = [prose(9000 + i, 400)] if i < far else []
        rows.append((first + i, "\n".join([*menu, *own, *added]), "en", host, 0))
    rows += [
        (first + 10000 + i, "\n".join([*menu, prose(1000 + i, 70)]), "en", host, 0) for i in range(others)
    ]
    return rows


@pytest.mark.parametrize("count,others,far", [(11, 89, 0), (60, 120, 0), (150, 300, 6)])
@pytest.mark.parametrize("bound", [rules.BROADCAST_BYTES, -1])
def test_near_copies_are_no_boilerplate(spark, monkeypatch, bound, count, others, far):
    monkeypatch.setattr(rules, "BROADCAST_BYTES", bound)
    rows = near_copies(count, others, far)
    result = rules.quality_rules(frame(spark, rows)).collect()
    assert len(result) == len(rows)
    assert all(r.kept and r.removed_words == 4 for r in result)  # the menu line only


def test_what_many_texts_quote_is_boilerplate_in_near_copies_too(spark):
    rows = near_copies(60, 30, 25)
    assert judged(spark, rows) == expected(rows)
    kept = {r[0] for r in judged(spark, rows) if r[4]}
    assert kept == {i for i, *_ in rows if i < 25 or i >= 10000}


def test_empty_and_clashing_names(spark):
    assert rules.quality_rules(frame(spark, [])).collect() == []
    docs = frame(spark).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "frequent_lines")
    result = rules.quality_rules(docs)
    assert result.columns == ["doc_id", "text", "source", "frequent_lines", *rules.ADDED]
    assert result.count() == len(documents())
