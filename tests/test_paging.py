"""Pages of whole collections, against one fold over all pieces, whatever the blocks."""

import random

import pytest

from evispark.operators import paging as P


def fold(sizes, most, budget):
    page, used, count, out = 0, None, 0, []
    for n in sizes:
        if used is None or used + n > budget or count >= most:
            page, used, count = page + 1, 0, 0
        used, count = used + n, count + 1
        out.append(page)
    return out


@pytest.mark.parametrize("block,most,budget", [(4, 4, 20), (5, 3, 9), (64, 64, 100), (4096, 64, 4096)])
def test_pages_equal_one_fold(spark, block, most, budget):
    rng = random.Random(block)
    rows = [(c, i // 3, i % 3, rng.choice([1, 2, 5, 9, 30])) for c, size in (("a", 300), ("b", 1), ("c", 65), (None, 40)) for i in range(size)]
    df = spark.createDataFrame(rows, "c string, line int, piece int, n long").repartition(3)
    got = {}
    paged = P.pages(df, "c", ["line", "piece"], budget, most, block)
    for r in paged.orderBy("c", "i").collect():
        got.setdefault(r["c"], []).append(r["page"])
    want = {}
    for c, *_, n in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        want.setdefault(c, []).append(n)
    assert got == {c: fold(ns, most, budget) for c, ns in want.items()}
    total = {r["c"]: (r["n_bytes"], r["whole"], r["n_spans"]) for r in P.delivered(paged, "c", ["line"]).collect()}
    assert total == {c: (sum(ns), True, -(-len(ns) // 3)) for c, ns in want.items()}
    first = {r["c"]: r["whole"] for r in P.delivered(paged, "c", ["line"], 1).collect()}
    assert first == {c: fold(ns, most, budget)[-1] == 1 for c, ns in want.items()}


def test_no_pieces(spark):
    assert P.pages(spark.createDataFrame([], "c string, line int, n long"), "c", ["line"]).count() == 0
    with pytest.raises(ValueError):
        P.pages(spark.createDataFrame([], "c string, line int, n long"), "c", ["line"], block=3, most=4)
