"""Cases that a filter or a cut in a query would hide."""

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quernstone import queries_tables
from quernstone.operators import corpus, layout, structure


def test_manifest_order_numbers_every_row(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert sorted(r["at"] for r in entry.queries()["c18_manifest_order"](spark, sf).collect()) == list(range(1, orders + 1))
    rows = [(r, k) for r in (2, 0, 1) for k in (9, -3, 0, 14, 5)]
    got = corpus.numbered(spark.createDataFrame(rows, "rank int, k long"), "rank", "k", "at", 4).collect()
    assert {(r["rank"], r.k): r["at"] for r in got} == {x: i for i, x in enumerate(sorted(rows), 1)}


def test_word_coverage_counts_every_part(spark, tmp_path):
    lines = [f"{w} " * 250 for w in ("one", "two", "three")]
    docs = spark.createDataFrame([(1, "\n".join(lines), "s")], "doc_id long, text string, source string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert entry.queries()["g30_g31_word_coverage"](spark, f"file://{tmp_path}").count() == 0
    parts = spark.createDataFrame([(1, 1, "alpha beta"), (1, 2, "gamma gamma")], "doc_id long, part int, content string")
    whole = spark.createDataFrame([(1, "alpha beta\ngamma delta")], "doc_id long, text string")
    got = queries_tables.word_coverage(whole, parts).collect()
    assert sorted((r.word, r.missing, r.extra) for r in got) == [("delta", 1, 0), ("gamma", 0, 1)]


def test_anchors_of_long_headings_stay_apart(spark, tmp_path):
    pages = spark.createDataFrame([(0, "<h1>Warunki umowy kredytu</h1>"), (5, "<h1>Warunki umowy rachunku</h1>"), (10, "<h1>Warunki umowy kredytu</h1>")], "page_id long, html string")
    pages.write.parquet(f"file://{tmp_path}/pages.parquet")
    got = entry.queries()["a40_d10_unique_identifiers"](spark, f"file://{tmp_path}").collect()
    assert {r.page_id: r.anchor for r in got} == {0: "warunki-umowy-kredytu", 5: "warunki-umowy-rachunku", 10: "warunki-umowy-kredytu-1"}


def test_anchors_of_all_headings_outside_fences(spark, tmp_path):
    text = "# One *two*\r\n```sh\n# no\n~~~\n```\n   ## One two ##\n####### seven\n#none\n~~~~\n~~~\n# no\n~~~~ x\n~~~~~\n### A \\* b_c\n#\n# One two-1\n~~~\n# no"
    spark.createDataFrame([(1, text), (2, "<h1>One two</h1><p>x</p><h2>One two</h2>"), (3, None)], "page_id long, html string").write.parquet(f"file://{tmp_path}/pages.parquet")
    got = entry.queries()["d11_heading_anchors"](spark, f"file://{tmp_path}").orderBy("page_id", "line_no").collect()
    assert [(r.page_id, r.anchor) for r in got] == [(1, "one-two"), (1, "one-two-1"), (1, "a--b_c"), (1, ""), (1, "one-two-1-1"), (2, "one-two"), (2, "one-two-1")]


def test_suffixes_against_plain(spark):
    import random

    r = random.Random(4)
    rows = [(d, o, r.choice(["a", "a", "b", "a-1", "a-1-1", "b-2", "c", "", "-1"])) for d in range(6) for o in range(r.randint(1, 25))]
    rows += [(9, o, "hot") for o in range(3000)]
    want = {}
    for d in range(10):
        taken, following = set(), {}
        for _, o, v in sorted(x for x in rows if x[0] == d):
            name, k = v, following.get(v, 1)
            while name in taken:
                name, k = f"{v}-{k}", k + 1
            following[v] = k
            taken.add(name)
            want[d, o] = name
    got = layout.unique_suffixes(spark.createDataFrame(rows, "d long, o long, v string"), ["d"], "o", "v", "name").collect()
    assert {(x.d, x.o): x.name for x in got} == want


def test_forbidden_phrases_fold_both_sides(spark):
    docs = spark.createDataFrame([(1, "Ma to-do list, là-bas"), (2, "access  TOKEN? tokens"), (3, None), (4, "")], "doc_id long, text string")
    got = corpus.phrases_in(docs, "doc_id", "text", ["To-Do", "LA", "access token", "token", "okens"]).collect()
    assert sorted((x.doc_id, x.word) for x in got) == [(1, "LA"), (1, "To-Do"), (2, "access token"), (2, "token")]


def against_sql(spark, folder, name, tables):
    """Rows of a query and of its SQL on tables of (rows, schema)."""
    con = duckdb.connect()
    for table, (data, schema) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"file://{path}")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    return sorted(map(repr, map(tuple, entry.queries()[name](spark, f"file://{folder}").select(*columns).collect()))), sorted(map(repr, want.fetchall()))


def test_gaps_count_seconds_begun_and_put_nulls_last(spark, tmp_path):
    events = """SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-01-01 00:00:00.9', 1), (2, TIMESTAMP_NTZ'2024-01-01 01:00:01.1', 1), (3, TIMESTAMP_NTZ'2024-01-01 02:00:01.9', 1), (4, NULL, 1), (5, TIMESTAMP_NTZ'2024-01-01 02:00:02', 1),
        (6, TIMESTAMP_NTZ'1969-12-31 22:59:59.9', 2), (7, TIMESTAMP_NTZ'1970-01-01 00:00:00.1', 2), (8, NULL, NULL), (9, NULL, 2) AS t(event_id, ts, user_id)"""
    rows = spark.sql(events)
    got, want = against_sql(spark, tmp_path, "a07_a08_gaps_and_islands", {"events": (rows.collect(), rows.schema)})
    assert got == want and len(got) == 7


def test_word_coverage_sends_texts_and_not_words(spark):
    whole = spark.createDataFrame([(1, "a b a c"), (1, "d"), (2, "x y"), (None, "n n"), (3, None), (4, "only here"), (5, "p\n q  p")], "doc_id long, text string")
    parts = spark.createDataFrame([(1, 1, "c a a"), (1, 2, "b d d"), (2, 1, "y"), (2, 2, "x"), (None, 1, "n n"), (5, 1, "q p"), (5, 2, "p"), (6, 1, "z"), (3, 1, None)], "doc_id long, part int, content string")
    found = queries_tables.word_coverage(whole, parts)
    want = [(1, "d", 0, 1), (4, "here", 1, 0), (4, "only", 1, 0), (6, "z", 0, 1), (None, "n", 0, 2), (None, "n", 2, 0)]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression [doc_id")
    assert len(below) == 3 and not any("regexp_extract_all" in x.split("Join")[0].split("Aggregate")[0] for x in below[1:])


def test_phrases_are_looked_for_without_word_runs(spark):
    docs = spark.createDataFrame([(1, "a b token c"), (2, "!Token"), (3, "tokens"), (4, "ACCESS-token"), (5, "!?"), (6, None)], "doc_id long, text string")
    found = corpus.phrases_in(docs, "doc_id", "text", ["token", "access token", "?!"])
    assert sorted((x.doc_id, x.word) for x in found.collect()) == [(1, "token"), (2, "token"), (4, "access token"), (4, "token")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "Join" not in plan and plan.count("\\p{L}") == 1  # folded once


def test_joined_lines_go_over_the_last_word_alone(spark):
    rows = [["a tele-", "fon b-", "ank x"], ["tele-", "ko-", "mu-", "nikacja"], ["www.a-", "b-", "c"], ["x/-", "y"], ["-", "a"], ["", "a-", "", "b"], ["PKO-", "owski"], ["a-\n", "b"], ["po-", "1"], ["see /x b-", "c"], [" a - ", "b"], []]
    want = ["a telefon b-ank x", "telekomunikacja", "www.a-b-c", "x/-y", "- a", "a-b", "PKO-owski", "a-\n b", "po- 1", "see /x b-c", "a - b", ""]
    made = spark.createDataFrame(list(enumerate(rows)), "i int, ls array<string>").select("i", structure.joined_lines(F.col("ls")).alias("t"))
    assert [r.t for r in sorted(made.collect(), key=lambda r: r.i)] == want


def test_references_are_neither_sorted_nor_sent_one_by_one(spark, tmp_path):
    import random

    r, edges = random.Random(8), [-(1 << 63), -65, -64, -63, -1, 0, 1, 62, 63, 64, 65, 127, 128, (1 << 63) - 1]
    keys = [*edges, None, None, 64, 64, *range(1000, 1300), *(r.getrandbits(64) - (1 << 63) for _ in range(300))]
    items = [(k, r.choice(["R", "N", None])) for k in keys * 2] + [(77, "R"), (None, "R"), (64, "R"), (65, "N")]
    tables = {"orders": ([(k,) for k in keys], "o_orderkey long"), "lineitem": (items, "l_orderkey long, l_returnflag string")}
    got, want = against_sql(spark, tmp_path, "b14_b15_footnote_selection", tables)
    assert got == want and len(got) == len(keys) and repr((None, "unreferenced")) in got
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["b14_b15_footnote_selection"](spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Sort" not in plan and plan.count("FileScan") == 2 and "bit_or" in plan
    near = corpus.among(spark.range(640), "id", spark.range(0, 640, 3).toDF("m"), "third")
    assert {x.id for x in near.where("third").collect()} == set(range(0, 640, 3)) and near.count() == 640


def test_leaves_are_found_without_sorting_what_belongs_to_them(spark, tmp_path):
    keys = [-65, -64, -1, 0, 63, 64, 64, 1 << 40]
    customers = [(k, b) for k in keys for b in (1.0, -1.0, None)] + [(None, -1.0), (None, 1.0)]
    orders = [(k,) for k in (-64, -64, 64, None, 9)]
    got, want = against_sql(spark, tmp_path, "b04_unit_collection", {"customer": (customers, "c_custkey long, c_acctbal double"), "orders": (orders, "o_custkey long")})
    assert got == want and len(got) > len(set(got))  # as many rows as the SQL gives
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = entry.queries()["b04_unit_collection"](spark, f"file://{tmp_path}")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "Sort" not in plan and plan.count("FileScan") == 2
