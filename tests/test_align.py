import random

import numpy as np

from lectern.operators import align


def test_a_long_document_is_compared_in_many_rows(spark, monkeypatch):
    rng = random.Random(3)
    side = lambda n: ["".join(rng.choices("abcd ", k=rng.randrange(30))) for _ in range(n)]
    docs = [(1, side(9), side(7)), (2, side(2), []), (3, None, side(2)), (4, side(1), side(5))]
    monkeypatch.setattr(align, "PAIRS", 14)
    df = spark.createDataFrame(docs, "doc long, left array<string>, right array<string>")
    for method, one in (("global", lambda a, b: align.align(a, b, 0.3)), ("greedy", lambda a, b: align.greedy(a, b, 0.3))):
        want = sorted((d, i, j, round(align.ratio(a[i], b[j]), 6)) for d, a, b in docs if a and b for i, j in one(a, b))
        assert sorted(tuple(r) for r in align.aligned(df, method=method).collect()) == want
    assert align.greedy(["x"], [], 0.3) == [] and align.best_path(np.zeros((0, 3)), 0.3) == []
