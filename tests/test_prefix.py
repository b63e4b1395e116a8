import time

from lectern.operators import joins, locate


def test_longest_prefix_of_a_long_stem_is_found_by_halving(spark):
    stem = "abc def " * 15_000
    rows = [(1, stem, "x" + stem[:1500]), (2, stem, "zabz"), (3, stem, "az"), (4, "ab", "xxab"), (5, None, "a"), (6, "ab", None), (7, "", ""), (8, "abab", "abababab")]
    df = spark.createDataFrame(rows, "k int, stem string, hay string")
    began = time.perf_counter()
    got = {r["k"]: r["prefix_length"] for r in joins.longest_prefix(df, "stem", "hay", 2).collect()}
    assert got == {1: 1500, 2: 2, 3: None, 4: 2, 5: None, 6: None, 7: None, 8: 4}
    assert time.perf_counter() - began < 30


def test_letters_beyond_ascii_whose_lower_case_is_in_it():
    told = "".join(map(chr, [*range(0x250), 0x212A, 0x1F600, 0x4E00]))
    kept = [(c, k) for k, c in enumerate(told) for c in c.lower() if c.isascii() and c.isalnum()]
    text, at = locate.projected(told)
    assert (text, at.tolist()) == ("".join(c for c, _ in kept), [k for _, k in kept])
