import hashlib
import random
import zlib

import pytest

from tablekeep.llm.prefix_trie import decomposed, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    """The nodes of rebuilt conversations, prefix by prefix."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(own[c])] for c in own}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = (turns.get(c - c % 100, [])[:h]) + turns[c][h:]
    members = {}
    for c, sequence in built.items():
        for d in range(len(sequence) + 1):
            members.setdefault(tuple(sequence[:d]), []).append(c)
    out = set()
    for node, own_members in members.items():
        below = [x for x in members if x[: len(node)] == node]
        inner = {x[:-1] for x in members if x}
        ends = ",".join(str(c) for c in sorted(own_members) if len(built[c]) == len(node))
        out.add(
            (
                min(own_members),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(own_members),
                sum(1 for x in members if x and x[:-1] == node),
                sum(1 for x in below if x not in inner),
                sum((len(members[x]) - 1) * len(x[-1][1]) for x in below if x),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


def conversations(seed, count, words):
    pick = random.Random(seed)
    rows = []
    for _ in range(count):
        c = pick.choice([pick.randrange(300), pick.randrange(10**6)])
        if any(r[0] == c for r in rows):
            continue
        for turn in range(pick.randint(1, 9)):
            rows.append((c, turn, pick.choice(["user", "tool"]), "é" * pick.randrange(words)))
    return rows


def found(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = [tuple(r) for r in prefix_trie(frame, **options).collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.mark.parametrize("component", [2, 5, 8192])
def test_nodes_of_random_conversations(spark, component):
    rows = conversations(component, 60, 3)
    assert found(spark, rows, component=component) == expected(rows)


def test_a_long_chain_is_split_over_tasks(spark):
    """One conversation of most turns, whose nodes are a single path."""
    others = [r for r in conversations(3, 10, 3) if r[0] >= 100]
    got = found(spark, [(7, t, "user", str(t % 5)) for t in range(2500)] + others, component=600)
    length = 2500 - zlib.crc32(b"7") % 6  # conversation 0 is absent
    chain = {r[1]: r for r in got if r[0] == 7 and r[1]}
    assert sorted(chain) == list(range(1, length + 1))
    assert all(r[5] == 1 and r[6] == 0 for r in chain.values())
    assert chain[length][7] == hashlib.sha256(b"7").hexdigest()


def test_copies_end_in_one_node(spark):
    """A third of all conversations are the same: one path, and one long list of ends."""
    rows = [(100 * i, 0, "user", "same") for i in range(9000)]
    got = found(spark, rows)
    ids = ",".join(str(100 * i) for i in range(9000))
    digests = {r[7] for r in got if r[3] == 9000 and r[1] == 1}
    assert digests == {hashlib.sha256(ids.encode()).hexdigest()}
    assert {r[6] for r in got} == {4 * 8999}


def test_nulls_ties_and_repeats(spark):
    rows = [
        (None, 0, "user", "no conversation"),
        (3, None, None, None),
        (3, None, None, None),  # a repeated row is a turn
        (3, 0, "user", None),
        (3, 1, None, "x"),
        (5, 9, "", ""),
        (300, 2, "user", "y" * 100_000),
    ]
    assert found(spark, rows) == expected(rows)


def test_a_conversation_without_turns_is_in_the_root_only(spark):
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 >= 2)
    rows = [(c, 0, "user", "gone")]  # its first turns are those of conversation 0, which is absent
    assert found(spark, rows) == expected(rows)
    assert [r[:6] for r in found(spark, rows)] == [(c, 0, None, 1, 0, 1)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie(empty).collect() == []
    rows = conversations(8, 20, 2)
    frame = spark.createDataFrame(
        [(*r, 1, 2, "z") for r in rows], f"{SCHEMA}, c int, k1 int, `a.b` string"
    )
    assert {tuple(r) for r in prefix_trie(frame).collect()} == expected(rows)


def test_decomposition_of_random_trees():
    for seed in range(30):
        pick = random.Random(seed)
        n = pick.randint(1, 200)
        deep = pick.random()
        parents = [-1] + [i - 1 if pick.random() < deep else pick.randrange(i) for i in range(1, n)]
        values = [(pick.randrange(5), pick.randrange(100)) for _ in range(n)]
        sums = [list(v) for v in values]
        for i in range(n - 1, 0, -1):
            sums[parents[i]][0] += sums[i][0]
            sums[parents[i]][1] += sums[i][1]
        assert decomposed(parents, values) == sums
