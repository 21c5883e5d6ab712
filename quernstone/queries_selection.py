"""Queries of the selection, planning and manifest operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import selection as S
from .queries_text import table
from .sources import manifests as M

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def position(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return table(spark, sf, "orders").withColumn("position", F.row_number().over(w))


PROBLEM = "CASE WHEN o_orderkey % 3 = 0 THEN 'unknown unit ' || o_orderkey WHEN o_orderstatus = 'F' THEN 'no support' END"


@query(f"""WITH c AS (SELECT o_custkey, o_orderkey, {PROBLEM} AS p FROM orders), b AS (SELECT o_custkey, string_agg(p, '; ' ORDER BY o_orderkey) AS problems FROM c GROUP BY 1 HAVING count(p) = count(*))
    SELECT o_custkey, o_orderkey, NULL::VARCHAR AS problems FROM c WHERE p IS NULL UNION ALL SELECT o_custkey, NULL, problems FROM b""")
def f08_f09_ground_filter(spark, sf):
    key = F.col("o_orderkey")
    problem = F.when(key % 3 == 0, F.concat(F.lit("unknown unit "), key.cast("string"))).when(F.col("o_orderstatus") == "F", "no support")
    left, lost = S.grounded(table(spark, sf, "orders").select("o_custkey", "o_orderkey", key.alias("ord"), problem.alias("p")), "o_custkey", "p")
    return left.select("o_custkey", "o_orderkey", F.lit(None).cast("string").alias("problems")).unionByName(lost.select("o_custkey", F.lit(None).cast("long").alias("o_orderkey"), "problems"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'unknown field' WHEN 3 THEN 'missing field' END AS problem, CASE WHEN o_orderkey % 5 IN (0, 4) THEN 1 END AS n_items, CASE WHEN o_orderkey % 5 IN (0, 4) THEN o_orderpriority END AS question FROM orders""")
def f10_selection_parse(spark, sf):
    item = F.struct(F.col("o_orderpriority").alias("question"), F.col("o_orderstatus").alias("answer"), F.array(F.col("o_orderkey").cast("string")).alias("basedOn"))
    good, kind = F.to_json(F.struct(F.array(item).alias("items"))), F.col("o_orderkey") % 5
    value = F.when(kind == 1, F.concat(F.lit("x"), good)).when(kind == 2, F.to_json(F.struct(F.array(item).alias("items"), F.lit(1).alias("extra")))).when(kind == 3, F.to_json(F.struct(F.array(item.dropFields("answer")).alias("items")))).otherwise(good)
    rows = S.parsed_selection(table(spark, sf, "orders").select("o_orderkey", value.alias("value")))
    return rows.select("o_orderkey", "problem", F.when(F.col("items").isNotNull(), F.size("items")).alias("n_items"), F.get("items", F.lit(0))["question"].alias("question"))


@query("""WITH i AS (SELECT o_custkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS position, o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN ' ' ELSE o_orderpriority END AS question, CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE 'liczba ' || (o_orderkey % 10) END AS answer FROM orders),
    c AS (SELECT o_custkey AS s, o_orderkey AS id, (o_orderkey % 10) + (o_orderkey % 4 = 0)::INT AS number FROM orders WHERE o_orderkey % 3 <> 0),
    j AS (SELECT i.*, c.number, row_number() OVER (PARTITION BY i.s, question ORDER BY position) AS nth, i.id % 5 = 0 AS empty FROM i LEFT JOIN c ON i.s = c.s AND i.id = c.id AND i.id % 5 <> 0)
    SELECT s AS "set", position, list_filter([CASE WHEN trim(question) = '' THEN 'blank question' END, CASE WHEN trim(question) <> '' AND nth > 1 THEN 'repeated question' END, CASE WHEN answer = '' THEN 'blank answer' END, CASE WHEN empty THEN 'empty basis' END,
        CASE WHEN NOT empty AND (number IS NULL OR id % 11 = 0) THEN 'unknown candidate' END, CASE WHEN number IS NOT NULL AND answer <> '' AND number <> id % 10 THEN 'ungrounded number' END], lambda x: x IS NOT NULL) AS problems FROM j""")
def f11_item_check(spark, sf):
    key = F.col("o_orderkey")
    based = F.when(key % 5 == 0, F.array().cast("array<bigint>")).when(key % 11 == 0, F.array(key, F.lit(-1).cast("long"))).otherwise(F.array(key))
    items = position(spark, sf).select(F.col("o_custkey").alias("set"), "position", F.when(key % 7 == 0, " ").otherwise(F.col("o_orderpriority")).alias("question"), F.when(key % 13 == 0, "").otherwise(F.concat(F.lit("liczba "), (key % 10).cast("string"))).alias("answer"), based.alias("based_on"))
    number = (key % 10) + (key % 4 == 0).cast("int")
    candidates = table(spark, sf, "orders").where("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("set"), key.alias("id"), F.concat(F.lit("kwota "), number.cast("string")).alias("answer"), F.lit(None).cast("string").alias("quote"))
    return S.item_problems(items, candidates)


@query("""WITH i AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderpriority AS d FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, d ORDER BY k) AS nth, min(k) OVER (PARTITION BY o_custkey, d) AS doc_at FROM i),
    one AS (SELECT *, nth <= 1 AND sum((nth <= 1)::INT) OVER (PARTITION BY o_custkey ORDER BY doc_at, k) <= 6 AS must FROM n),
    two AS (SELECT *, CASE WHEN must THEN 0 ELSE sum((NOT must AND nth <= 3)::INT) OVER (PARTITION BY o_custkey ORDER BY k) END AS more, sum(must::INT) OVER (PARTITION BY o_custkey) AS had FROM one)
    SELECT o_custkey::VARCHAR AS "set", k, must OR (nth <= 3 AND more + had <= 6) AS chosen FROM two""")
def f14_c12_quota_choice(spark, sf):
    items = position(spark, sf).select(F.col("o_custkey").alias("set"), F.col("position").alias("k"), F.array("o_orderpriority").alias("documents"))
    return S.quota_choice(items, total=6, least=1, most=3)


@query("""WITH c AS (SELECT o_custkey AS s, o_orderpriority AS doc, o_orderkey AS ord, 'q' || (o_orderkey % 6) AS question FROM orders WHERE o_orderkey % 4 <> 0),
    t AS (SELECT *, row_number() OVER (PARTITION BY s, doc ORDER BY ord) AS turn, min(ord) OVER (PARTITION BY s, doc) AS doc_at FROM c),
    f AS (SELECT * FROM t WHERE true QUALIFY row_number() OVER (PARTITION BY s, question ORDER BY turn, doc_at) = 1)
    SELECT s AS "set", doc, ord, question || '?' AS question, turn, row_number() OVER (PARTITION BY s ORDER BY turn, doc_at) AS place FROM f WHERE question <> 'q5'""")
def f16_pool_fill(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("set"), F.col("o_orderpriority").alias("doc"), F.col("o_orderkey").alias("ord"), F.concat(F.lit("q"), (F.col("o_orderkey") % 6).cast("string"), F.lit("?")).alias("question"))
    return S.unused_candidates(c, c.where("ord % 4 = 0").select("set", "ord"), c.select("set").distinct().withColumn("qnorm", F.lit("q5")))


@query("""WITH s AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, o_orderpriority AS designation, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'h' || (o_orderkey % 5) END AS heading FROM orders),
    e AS (SELECT doc_id, ord * 2 AS ord, designation AS label FROM s UNION ALL SELECT doc_id, ord * 2 + 1, heading FROM s WHERE heading <> '')
    SELECT doc_id, label, min(ord) AS ord FROM e GROUP BY 1, 2""")
def f23_unit_list(spark, sf):
    sections = position(spark, sf).select(F.col("o_custkey").alias("doc_id"), F.col("position").alias("section_ord"), F.col("o_orderpriority").alias("designation"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("h"), (F.col("o_orderkey") % 5).cast("string"))).alias("heading"))
    return S.unit_list(sections)


@query("""SELECT p_partkey, concat_ws(chr(10) || chr(10), '## Task' || chr(10) || p_name, CASE WHEN p_size % 3 <> 0 THEN '## Units' || chr(10) || p_type END, CASE WHEN p_size % 2 = 0 THEN '## Problems' || chr(10) || p_brand END) AS prompt FROM part""")
def f21_prompts(spark, sf):
    units, problems = F.when(F.col("p_size") % 3 != 0, F.col("p_type")).otherwise(" "), F.when(F.col("p_size") % 2 == 0, F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", S.prompt([("Task", F.col("p_name")), ("Units", units), ("Problems", problems)]).alias("prompt"))


@query("""WITH t AS (SELECT DISTINCT c_mktsegment AS kind, c_nationkey::VARCHAR AS template FROM customer), o AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY md5(kind || '/' || template), template) - 1 AS place, count(*) OVER (PARTITION BY kind) AS many FROM t),
    s AS (SELECT DISTINCT c_mktsegment AS kind, unnest(range(40)) AS nth FROM customer)
    SELECT s.kind, (nth + 1)::INT AS nth, substr(s.kind, 1, 3) || '-' || lpad((nth + 1)::VARCHAR, 2, '0') AS id, template FROM s JOIN o ON s.kind = o.kind AND nth % many = place""")
def g10_plan_per_type(spark, sf):
    c = table(spark, sf, "customer")
    counts = c.select(F.col("c_mktsegment").alias("kind"), F.substring("c_mktsegment", 1, 3).alias("prefix"), F.lit(40).alias("n")).distinct()
    return S.plan(c.select(F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("string").alias("template")).distinct(), counts)


@query("""WITH f AS (SELECT o_custkey AS doc, o_orderkey AS fact, o_orderstatus AS value FROM orders), p AS (SELECT o_custkey AS doc, o_orderkey AS fact, 'zero' AS false_value FROM orders WHERE o_orderkey % 9 = 0)
    SELECT f.doc, f.fact, coalesce(false_value, value) AS value, false_value IS NOT NULL AS is_poison FROM f LEFT JOIN p ON f.doc = p.doc AND f.fact = p.fact""")
def g16_g37_overridden_facts(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("fact"), F.col("o_orderstatus").alias("value"))
    bad = o.where("fact % 9 = 0").select("doc", "fact", F.explode(F.array(F.struct(F.lit(2).alias("op"), F.lit("late").alias("false_value")), F.struct(F.lit(1).alias("op"), F.lit("zero").alias("false_value")))).alias("x")).select("doc", "fact", "x.op", "x.false_value")
    return S.overridden(o, bad)


@query("""WITH o AS (SELECT o_custkey AS slot, o_orderkey AS ord, o_orderpriority AS place, o_orderstatus AS goal FROM orders), s AS (SELECT o_orderpriority AS place, o_orderstatus AS goal FROM orders WHERE o_orderkey < 8),
    r AS (SELECT *, CASE WHEN place IN (SELECT place FROM s) THEN 0 ELSE 4 END + CASE WHEN goal IN (SELECT goal FROM s) THEN 0 ELSE 2 END + CASE WHEN (place, goal) IN (SELECT (place, goal) FROM s) THEN 0 ELSE 1 END AS score FROM o)
    SELECT slot, ord, place, goal, score FROM r QUALIFY row_number() OVER (PARTITION BY slot ORDER BY score DESC, ord) = 1""")
def g15_novelty_choice(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("slot"), F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("place"), F.col("o_orderstatus").alias("goal"))
    return S.novelty_choice(o, o.where("ord < 8").select("place", "goal"))


@query("""WITH i AS (SELECT o_custkey AS doc, o_orderkey AS ord, (o_orderkey % 3 <> 0)::INT AS level FROM orders), t AS (SELECT *, sum((level = 0)::INT) OVER (PARTITION BY doc ORDER BY ord) AS top FROM i)
    SELECT doc, ord, top || CASE WHEN level = 1 THEN '.' || sum(level) OVER (PARTITION BY doc, top ORDER BY ord) ELSE '' END AS position FROM t""")
def g34_tariff_positions(spark, sf):
    return S.tariff_positions(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 != 0).cast("int").alias("level")))


@query("SELECT conv_id, coalesce(string_agg(trim(text), ' ' ORDER BY turn, trim(text)) FILTER (trim(text) <> ''), '') AS text FROM conversations GROUP BY 1")
def g38_block_texts(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", F.struct("turn", F.trim("text").alias("t")).alias("ord"), "text")
    return S.block_text(c, ["conv_id"])


@query("""SELECT o_orderkey AS ord, '{"index":' || o_orderkey || ',"status":"' || o_orderstatus || '"' || CASE WHEN o_orderkey % 3 = 0 THEN ',"error":"time-out-reached"' ELSE '' END || '}' AS value FROM orders""")
def h04_h12_manifest_lines(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, "TimeOutReached").alias("error"))
    return M.manifest(rows, "o_orderkey", ["index", "status", "error"], "error")


@query("""SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","items":[' || coalesce((SELECT string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) FROM orders WHERE o_custkey = c_custkey), '') || ']}' AS value FROM customer""")
def h10_nested_manifest(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return M.nested_manifest(table(spark, sf, "customer"), orders, "c_custkey", "o_orderkey", ["c_custkey", "c_mktsegment"], ["o_orderkey", "o_orderstatus"])


@query("SELECT c_custkey, c_mktsegment, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n_items FROM customer")
def h10_manifest_round_trip(spark, sf):
    back = M.read_manifest(h10_nested_manifest(spark, sf), "c_custkey LONG, c_mktsegment STRING, items ARRAY<STRUCT<o_orderkey: LONG, o_orderstatus: STRING>>")
    return back.select("c_custkey", "c_mktsegment", F.size("items").cast("long").alias("n_items"))
