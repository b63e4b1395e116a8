"""Corpus-wide location against a scan of every window, chains against every choice, and a paper's repair worked out by hand."""

import itertools
import random

import numpy as np
import pytest

from lectern.operators import align, locate


def scan(needle, hay, least, step=8):
    places = range(0, len(hay) - len(needle) + 1, step)
    score, at = max(((align.ratio(hay[p : p + len(needle)], needle), -p) for p in places), default=(0.0, 0))
    return (-at, round(score, 6)) if len(needle) >= 12 and score >= least else None


def spoilt(rng, text, share):
    out = []
    for c in text:
        out.append(rng.choice(["", "#", c + c]) if rng.random() < share else c)
    return "".join(out)


@pytest.mark.parametrize("least", [0.95, 0.85, 0.7])
def test_every_needle_in_every_text_equals_a_scan(spark, monkeypatch, least):
    monkeypatch.setattr(locate, "CHUNK", 160)
    monkeypatch.setattr(locate, "NEEDLES", 300)
    rng = random.Random(11)
    words = [w * 3 for w in ("alpha", "beta", "gam", "del é", "ep ", "zeta")]
    needles = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 6])))) for k in range(8)] + [(8, "short"), (9, None)]
    texts = []
    for k in range(12):
        filler = " ".join(rng.choice(words) for _ in range(rng.randrange(25)))
        texts.append((k, filler + spoilt(rng, needles[k % 8][1], rng.choice([0, 0.05, 0.2])) + filler[:70]))
    texts += [(12, None), (13, "")]
    got = {(r["needle"], r["doc"]): (r["found_at"], r["score"]) for r in locate.located_everywhere(
        spark.createDataFrame(needles, "key long, needle string"), spark.createDataFrame(texts, "key long, hay string"), least).collect()}
    want = {(k, d): scan(n, t, least) for k, n in needles[:9] for d, t in texts if t}
    assert got == {k: v for k, v in want.items() if v} and len(got) >= 6


def test_seeds_are_shared_by_every_window_as_good():
    rng = random.Random(7)
    for _ in range(400):
        needle = "".join(rng.choice("abcdef") for _ in range(rng.choice([12, 20, 40])))
        window = spoilt(rng, needle, rng.choice([0.02, 0.1]))[: len(needle)].ljust(len(needle), "z")
        score = align.ratio(window, needle)
        q, hits, shift = locate.seeds(len(needle), score)
        met = sum(needle[i : i + q] == window[j : j + q] for i in range(len(needle) - q + 1) for j in range(len(window) - q + 1) if abs(i - j) <= shift)
        assert met >= hits


def test_chains_are_the_heaviest():
    rng = random.Random(1)
    for _ in range(300):
        places = [[(rng.randrange(9), rng.randrange(1, 9) / 8) for _ in range(rng.randrange(4))] for _ in range(5)]
        got = locate.heaviest_chain(places)
        taken = [g for g in got if g]
        assert all(a[0] < b[0] for a, b in itertools.pairwise(taken)) and all(g is None or g in some for g, some in zip(got, places, strict=True))

        def weight(choice):
            some = [c for c in choice if c]
            return sum(c[1] for c in some) if all(a[0] < b[0] for a, b in itertools.pairwise(some)) else -1.0

        assert sum(g[1] for g in taken) == max(map(weight, itertools.product(*[[None, *some] for some in places])))
    assert locate.heaviest_chain([]) == [] and locate.heaviest_chain([[], []]) == [None, None]


def test_a_paper_is_repaired(spark):
    ask = ["Define the momentum of a moving body", "State the law of gravitation for two masses", "Explain why the sky looks blue at noon", "Sketch the field around a long straight wire"]
    answers = ["It is the product of mass and velocity, a vector.", "Force goes with both masses and one over distance squared.", "Short waves are scattered much more than long waves are. Examiners report most did well", "Circles around the wire, closer where the field is stronger."]
    text = "".join(f"{q}\n{a}\n" for q, a in zip(ask, answers, strict=True))
    bad = "x Examiners report y"
    records = [(1, 0, ask[0], bad), (1, 1, ask[1].replace("law", "lew"), "clean"), (1, 2, ask[2], bad), (1, 3, ask[3], bad), (2, 0, "Nothing like it is in the paper", bad)]
    papers = [(1, text), (2, "quite another text " * 3), (3, None)]
    got = {(r["paper"], r["n"]): r for r in locate.repaired_papers(spark.createDataFrame(records, "paper long, n long, question string, current string"), spark.createDataFrame(papers, "paper long, text string"), least=0.6, step=1).collect()}
    assert [got[1, k]["action"] for k in range(4)] == ["replace", "risk", "replace", "replace"] and got[2, 0]["action"] == "keep"
    assert all(got[1, k]["start"] == text.index(ask[k]) for k in range(4)) and got[2, 0]["start"] == 0
    assert got[1, 2]["answer"] == ask[2] + "\n" + answers[2].split(" Examiners")[0] and got[1, 1]["answer"] == "clean" and got[2, 0]["answer"] == bad
    assert np.array_equal(locate.projected("É a-B\n2")[1], [2, 4, 6])


def test_short_texts_are_looked_through_together_and_few_windows_are_compared(monkeypatch):
    rng = random.Random(5)
    words = ["alpha", "beta", "gam", "del é", "ep ", "zeta"]
    needles = [(10 * k, " ".join(rng.choice(words) for _ in range(rng.choice([4, 9, 30])))) for k in range(6)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + spoilt(rng, needles[k % 6][1], rng.choice([0, 0.04])) for k in range(24)] + ["", "é"]
    compared = []
    ratios = locate.matching.ratios
    monkeypatch.setattr(locate.matching, "ratios", lambda a, b: compared.extend(a) or ratios(a, b))
    index = locate.Index(needles, 0.9)
    got = sorted(index.found(texts, 1 << 16, 8))
    want = sorted((k, d, p, r) for k, n in needles for d, t in enumerate(texts) for p in range(0, len(t) - len(n) + 1, 8) if (r := align.ratio(t[p : p + len(n)], n)) >= 0.9)
    assert got == want and len({(k, d) for k, d, _, _ in want}) >= 6
    places = sum(max(0, (len(t) - len(n)) // 8 + 1) for _, n in needles for t in texts)
    assert len(compared) * 5 < places
    # votes and windows taken by small parts, and places of a chunk only
    monkeypatch.setattr(locate, "_VOTES", 50)
    monkeypatch.setattr(locate, "_WINDOWS", 3)
    assert sorted(index.found(texts, 1 << 16, 8)) == want and sorted(index.found(texts, 40, 8)) == [w for w in want if w[2] < 40]
