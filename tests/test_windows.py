import difflib
import random
import time

import numpy as np

from lectern.operators import locate


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_longest_common_subsequences_of_windows_across_words():
    rng = random.Random(1)
    for n in (12, 61, 62, 63, 124, 130):
        needle, hay = "".join(rng.choices("abcde ", k=n)), "".join(rng.choices("abcdefz ", k=n + 60))
        places = np.arange(0, 60, 7)
        assert locate.longest_common(needle, locate._codes(hay), places).tolist() == [longest(needle, hay[p : p + n]) for p in places]


def test_windows_of_a_long_text_are_bounded_before_they_are_compared():
    rng = random.Random(2)
    parts = ["th", "en", "on", "er", "a", "ing", "wh", "st", "of", "ble", "ti", "sh", "re", "ou"]
    hay = "".join(rng.choices(parts, k=4000))
    needle = hay[2400:2500]
    began = time.perf_counter()
    got = locate.window_scores(needle, hay, 0.6, 24)
    mine = time.perf_counter() - began
    match = difflib.SequenceMatcher(None, autojunk=False)
    match.set_seq2(needle)
    began = time.perf_counter()
    want = []
    for p in range(0, len(hay) - 99, 24):
        match.set_seq1(hay[p : p + 100])
        if match.ratio() >= 0.6:
            want.append((p, match.ratio()))
    assert got == want and (2400, 1.0) in got
    assert mine * 3 < time.perf_counter() - began
