import random
import re

import numpy as np
import pytest
import xxhash

from tablekeep.llm import simhash
from tablekeep.llm.components import component_labels
from tests.llm.samples import documents, frame, prose


def fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius):
    """Classes by smallest position, over all pairs."""
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    for _, text, *_ in documents():
        assert simhash.fingerprint(text or "") == fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_slices_against_all_pairs(radius):
    random = np.random.default_rng(radius)
    base = random.integers(0, 2**63, size=5, dtype=np.uint64)
    units = []
    for _ in range(20):
        sides = []
        for n in random.integers(1, 150, 2):
            x = base[random.integers(0, 5, n)]
            for _ in range(int(random.integers(0, 8))):
                x = x ^ (np.uint64(1) << random.integers(0, 64, n).astype(np.uint64))
            sides.append(x)
        units.append(tuple(sides))
    got = set(zip(*(x.tolist() for x in simhash.near_pairs(units, radius))))
    assert got == {
        (u, i, j)
        for u, (q, c) in enumerate(units)
        for i, j in zip(*np.nonzero(np.bitwise_count(q[:, None] ^ c[None, :]) <= radius))
    }


@pytest.mark.parametrize("unit", [3, 4096])
def test_links_connect_what_is_near(spark, unit):
    pick = random.Random(7)
    base = [pick.getrandbits(64) for _ in range(4)]
    prints = list({pick.choice(base) ^ sum({1 << pick.randrange(64) for _ in range(pick.randint(0, 4))}) for _ in range(150)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    order = sorted(range(len(prints)), key=lambda i: signed[i])
    prints, signed = [prints[i] for i in order], [signed[i] for i in order]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    labels = {r.node: r.label for r in component_labels(simhash.near_links(df, unit=unit)).collect()}
    classes = components(prints, 4)
    assert [labels.get(p, p) for p in signed] == [signed[c] for c in classes]


def test_documents(spark):
    rows = documents() + [(50 + i, prose(3, 4000 - i), "en", "s", 0) for i in range(6)]
    rows = [r for r in rows if r[0] is not None]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    prints = [fingerprint(r[1]) for r in rows]
    classes = components(prints, 4)
    least = {}
    for row, c in zip(rows, classes):
        least[c] = min(least.get(c, row[0]), row[0])
    expected = sorted((r[0], f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, classes))
    assert sorted(tuple(r) for r in got) == expected


def test_null_ids(spark):
    text = prose(9, 50)
    rows = [(None, text, "", "", 0), (3, text, "", "", 0), (None, prose(10, 50), "", "", 0)]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.component_id or 0) for r in got) == [(False, 3), (True, 0), (True, 3)]


def test_one_of_each_group_stays(spark):
    docs = frame(spark)
    kept = simhash.drop_near_duplicates(docs)
    rows = documents()
    prints = [fingerprint(r[1]) for r in rows]
    groups = {}
    for row, c in zip(rows, components(prints, 4)):
        groups.setdefault(c, []).append(row)
    left = kept.collect()
    assert kept.columns == docs.columns
    assert len(left) == len(groups)
    smallest = [min((r[0] is None, r[0] or 0) for r in g) for g in groups.values()]
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted(smallest)


def test_empty_and_clashing_names(spark):
    assert simhash.near_duplicates(frame(spark, [])).collect() == []
    docs = frame(spark).withColumnRenamed("lang", "k1").withColumnRenamed("source", "fp")
    assert simhash.near_duplicates(docs).count() == len(documents())
    assert simhash.drop_near_duplicates(docs).columns == docs.columns


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    pick = random.Random(seed)
    links = [(pick.randrange(60), pick.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    parent = list(range(200))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {n for link in links if link[0] != link[1] for n in link}
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == {n: root(n) for n in nodes}
