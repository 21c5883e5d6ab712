"""What SQL can't express of the document operators: the random streams, against known and plainly computed values."""

import re

from quernstone.operators import documents as D


def plain(seed, n):
    mask, state = (1 << 64) - 1, seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & mask
    z = state
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
    return z ^ (z >> 31)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_streams(spark):
    assert D.fnv1a("") == 0xCBF29CE484222325
    assert plain(0, 1) == 0xE220A8397B1DCDAF
    rows = spark.createDataFrame([(0, 1, "a", "x"), (0, 5, "szablony", "REG-03"), (-7, 2, "", "ż")], "s long, n long, p string, i string")
    for r in rows.select("*", D.split_mix("s", "n").alias("out"), D.stream_seed("s", "p", "i").alias("seed")).collect():
        start = r.s & ((1 << 64) - 1)
        assert r.out == signed(plain(start, r.n))
        assert r.seed == signed(plain(start ^ D.fnv1a(f"{r.p}\x1f{r.i}"), 1))


def test_outline_numbers_take_one_sort(spark):
    depths = [2, 1, 3, 2, 3, 3, 1, 2, 2, 3, 1, 3, 1]
    rows = spark.createDataFrame([(d, k, x) for d in (1, 2) for k, x in enumerate(depths)], "doc long, ord long, depth int")
    made = D.outline_numbers(rows, "doc", "ord", "depth")
    want, at = [], [0, 0, 0]
    for x in depths:
        at = [*at[: x - 1], at[x - 1] + 1, *[0] * (3 - x)]
        want.append(".".join(map(str, at[:x])))
    assert [r.number for r in sorted(made.collect(), key=lambda r: (r.doc, r.ord))] == want * 2
    assert made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Sort [") == 1


def test_cells_are_not_sorted(spark, sf):
    import __spark_entry__ as entry

    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["a51_words_in_cells"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    join = plan[plan.index("SortMergeJoin"):]
    assert plan.index("Generate inline") < plan.index("SortMergeJoin") and "Generate" not in join and not re.search(r"Sort \[doc#\d+L ASC NULLS FIRST\]", join)
    words = spark.createDataFrame([(1, 1, 5.0, 5.0), (1, 2, 10.0, 10.0), (1, 3, 0.0, 0.0), (2, 4, 5.0, 5.0), (None, 5, 5.0, 5.0)], "doc long, ord long, centre double, baseline double")
    cells = "array<struct<row_no:long,col_no:long,left:double,right:double,top:double,bottom:double>>"
    pages = spark.createDataFrame([(1, [(0, 0, 0.0, 10.0, 0.0, 10.0), (0, 1, 10.0, 20.0, 0.0, 10.0)]), (2, []), (3, None)], f"doc long, cells {cells}")
    assert sorted((r.ord, r.row_no, r.col_no) for r in D.words_in_cells(words, pages, "doc").collect()) == [(1, 0, 0), (2, 0, 1)]
