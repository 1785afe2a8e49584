import random

from hypothesis import given, settings, strategies as st

from tablekeep.llm.suffix_sort import common_prefixes, suffix_array


def naive(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_small_alphabets(text):
    assert suffix_array(text) == naive(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 10**6), max_size=40))
def test_any_numbers(text):
    assert suffix_array(text) == naive(text)


def test_repetitive_texts():
    for text in ([0] * 500, [0, 1] * 200, [1, 0] * 200, [2, 1, 0] * 100 + [2, 1], list(range(300))):
        assert suffix_array(text) == naive(text)


def test_common_prefixes():
    pick = random.Random(1)
    for _ in range(100):
        text = [pick.randint(0, 2) for _ in range(pick.randint(0, 50))]
        order = suffix_array(text)
        shared = common_prefixes(text, order)
        for place in range(1, len(order)):
            a, b = text[order[place - 1] :], text[order[place] :]
            same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[place] == same


def test_grows_linearly():
    """Twice the symbols, about twice the groups handled: no work in squares."""
    import time

    def seconds(n):
        pick = random.Random(2)
        text = [pick.randint(0, n) for _ in range(n)]
        start = time.process_time()
        suffix_array(text)
        return time.process_time() - start

    seconds(20_000)
    assert seconds(80_000) < 12 * seconds(20_000)
