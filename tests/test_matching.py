import difflib
import random
import time

import pytest

from lectern.functions import matching


def by_difflib(a, b):
    return [difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize(("letters", "longest"), [("ab", 30), ("abc d", 60), ("aé漢😀x", 40), ("a", 40), ("abcdefghijklmnop", 200)])
def test_ratios_of_many_pairs_are_those_of_difflib(letters, longest, monkeypatch):
    rng = random.Random(5)
    a, b = ([("".join(rng.choices(letters, k=rng.randrange(longest)))) for _ in range(200)] for _ in range(2))
    assert matching.ratios(a, b).tolist() == by_difflib(a, b)
    monkeypatch.setattr(matching, "PLACES", 200)
    assert matching.ratios(a, b).tolist() == by_difflib(a, b)


def test_ratios_are_several_times_faster_than_one_pair_at_a_time():
    rng = random.Random(6)
    a = ["".join(rng.choices(["th", "en", "on ", "er", "a"], k=600)) for _ in range(30)]
    b = [x[::-1] for x in a]
    matching.ratios(a[:2], b[:2])
    began = time.perf_counter()
    got = matching.ratios(a, b).tolist()
    mine = time.perf_counter() - began
    began = time.perf_counter()
    assert got == by_difflib(a, b)
    assert mine * 3 < time.perf_counter() - began


def test_no_pairs_and_empty_texts():
    assert matching.ratios([], []).tolist() == []
    assert matching.ratios(["", "", "a"], ["", "a", ""]).tolist() == [1.0, 0.0, 0.0]
