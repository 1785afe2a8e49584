"""Suffix sorting by linear grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups start out by first symbol and are
processed in descending order. For each suffix of the processed group its previous smaller suffix
is found over pointers set before; that suffix's Lyndon prefix is extended by the group's, as often
as the group has suffixes that point to it, so it moves to a new group right above its old one.
When all groups are processed they are in order, and one ascending pass over the result puts each
suffix into the next place of its group, from the suffix that follows its Lyndon prefix. Nothing is
renamed and solved again.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter


class _Group:
    """A group of suffixes and its neighbours; ``members`` may hold suffixes that moved on."""

    __slots__ = ("members", "below", "above", "place")

    def __init__(self, members: list[int], below: "_Group | None"):
        """Put a group right above another one."""
        self.members, self.below, self.above, self.place = members, below, None, 0
        if below is not None:
            self.above = below.above
            below.above = self
            if self.above is not None:
                self.above.below = self


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order; an end of the text is below every symbol."""
    n = len(text)
    if not n:
        return []
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    group: list[_Group] = [None] * n
    top = None
    for symbol in sorted(by_symbol):
        top = _Group(by_symbol[symbol], top)
        for i in top.members:
            group[i] = top
    return _ordered(group, _group_suffixes(group, top, n))


def _group_suffixes(group: list[_Group], top: _Group, n: int) -> list[int]:
    """Split the groups until each is of one Lyndon prefix; returns the previous smaller pointers.

    ``place`` of each group becomes the first place of its suffixes in the order.
    """
    before = [-1] * n
    done = bytearray(n)
    place = n
    current = top
    while current is not None:
        members = [i for i in current.members if group[i] is current]
        members.sort()
        for i in members:  # from the left, so that pointers of this group lead on
            j = i - 1
            while j >= 0 and (done[j] or group[j] is current):
                j = before[j]
            before[i] = j
        children: dict[int, int] = {}
        for i in members:
            done[i] = 1
            if (j := before[i]) >= 0:
                children[j] = children.get(j, 0) + 1
        place -= len(members)
        current.place = place
        _split(group, children)
        current = current.below
    return before


def _split(group: list[_Group], children: dict[int, int]) -> None:
    """Move each parent above the rest of its group, those with more children higher."""
    if len(children) == 1:
        (j,) = children
        group[j] = _Group([j], group[j])
        return
    moved: dict[_Group, list[tuple[int, int]]] = {}
    for j, count in children.items():
        moved.setdefault(group[j], []).append((count, j))
    for below, parents in moved.items():
        parents.sort()
        for _, same in groupby(parents, key=itemgetter(0)):
            below = _Group([j for _, j in same], below)
            for j in below.members:
                group[j] = below


def _ordered(group: list[_Group], before: list[int]) -> list[int]:
    n = len(group)
    order = [-1] * n
    placed = bytearray(n)

    def follow(j: int) -> None:
        """Place the suffixes whose Lyndon prefix ends where the one just seen starts."""
        while j >= 0 and not placed[j]:
            placed[j] = 1
            own = group[j]
            order[own.place] = j
            own.place += 1
            j = before[j]

    follow(n - 1)  # the end of the text comes first
    for k in range(n):
        follow(order[k] - 1)
    return order


def common_prefixes(text: list[int], order: list[int]) -> list[int]:
    """For each place of the order the symbols shared with the suffix one place before."""
    n = len(text)
    rank = [0] * n
    for place, i in enumerate(order):
        rank[i] = place
    shared = [0] * n
    size = 0
    for i in range(n):
        if rank[i]:
            j = order[rank[i] - 1]
            while i + size < n and j + size < n and text[i + size] == text[j + size]:
                size += 1
            shared[rank[i]] = size
            size = max(0, size - 1)
        else:
            size = 0
    return shared
