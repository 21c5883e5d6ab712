"""Queries of the document operators on stand-in data, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import documents as D
from .queries_text import _literal, _rows, table

Q: dict = {}
SQL: dict[str, str] = {}
SPLITS = ["Art. 5. 1. Bank otwiera rachunek", "Art. 12a. 1. Opłaty", "Art. 7. Postanowienia", "§ 3. 1. Zasady", "Art. 5.", "zwykły wiersz"]
GROUPS = ["opłata {{fakt:karta}} zł {albo {{fakt:konto}} zł}", "{a {b} c} stała", "bez grup {{fakt:termin}}", "{{fakt:a}}{x {y {z}}}{{fakt:b}}"]
TEMPLATE = "Opłata {{fakt:K1}} dla {{param:nazwa}}, dalej {{ref:brak}}; {{fakt:K1}}."


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT doc_id, nfc_normalize(translate(replace(replace(text || 'ﬁn' || chr(160) || 'e' || chr(769) || chr(8199) || 'x²' || 'ﬄ', 'ﬁ', 'fi'), 'ﬄ', 'ffl'), chr(160) || chr(8199), '  ')) AS text FROM documents""")
def a04_text_normalization(spark, sf):
    raw = F.concat("text", F.lit("\ufb01n\u00a0e\u0301\u2007x\u00b2\ufb04"))
    return table(spark, sf, "documents").select("doc_id", D.normal_text(raw).alias("text"))


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, '') || repeat(chr(1), (page_id % 3)::INT) || repeat(chr(65533), (page_id % 2)::INT), '[\\x00-\\x08\\x0E-\\x1F\\x7F-\\x{84}\\x{86}-\\x{9F}\\x{FFFD}]'))::INT AS unmapped FROM pages")
def a05_unmapped_glyphs(spark, sf):
    text = F.concat(F.coalesce("html", F.lit("")), F.repeat(F.lit("\x01"), (F.col("page_id") % 3).cast("int")), F.repeat(F.lit("\ufffd"), (F.col("page_id") % 2).cast("int")))
    return table(spark, sf, "pages").select("page_id", D.unmapped(text).alias("unmapped"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 16 AS top, CASE WHEN l_quantity * 16 + 10 <= 842 * 0.08::DOUBLE THEN 'header' WHEN l_quantity * 16 >= 842 * (1 - 0.08::DOUBLE) THEN 'footer' ELSE 'body' END AS zone FROM lineitem")
def a10_zones(spark, sf):
    top = F.col("l_quantity") * 16
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", top.alias("top"), D.zone(top, top + 10, F.lit(842.0)).alias("zone"))


@query("""WITH o AS (SELECT o_custkey AS doc, row_number() OVER w AS page, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    m AS (SELECT doc, page, n, page + CASE WHEN doc % 5 = 0 THEN page % 2 ELSE 3 END AS number, n + CASE WHEN doc % 7 = 0 THEN 1 ELSE 0 END AS total FROM o)
    SELECT doc, min(number - page) AS page_offset FROM m GROUP BY doc HAVING count(DISTINCT page) >= 2 AND min(total) = max(total) AND max(total) = max(n) AND min(number - page) = max(number - page)""")
def a14_band_page_marks(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("page"))
    pages = o.groupBy("doc").agg(F.count("*").alias("page_count"))
    marks = o.join(pages, "doc").select("doc", "page", (F.col("page") + F.when(F.col("doc") % 5 == 0, F.col("page") % 2).otherwise(3)).alias("number"), (F.col("page_count") + F.when(F.col("doc") % 7 == 0, 1).otherwise(0)).alias("total"))
    return D.removable_page_marks(marks, "doc", pages)


@query("""WITH l AS (SELECT l_orderkey AS page, l_linenumber, l_partkey, (l_partkey % 500)::DOUBLE AS "left", (l_partkey % 500) + l_quantity AS "right" FROM lineitem),
    g AS (SELECT *, "left" - max("right") OVER (PARTITION BY page ORDER BY "left", "right" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM l),
    x AS (SELECT page, max({'gap': gap, 'at': "left"}) AS w FROM g WHERE gap >= 550 * 0.02::DOUBLE GROUP BY page)
    SELECT l.page, l_linenumber, l_partkey, (CASE WHEN "left" >= w.at THEN 2 ELSE 1 END)::INT AS "column" FROM l LEFT JOIN x ON l.page = x.page""")
def a09_a29_gutter_columns(spark, sf):
    left = (F.col("l_partkey") % 500).cast("double")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", "l_partkey", left.alias("left"), (left + F.col("l_quantity")).alias("right"))
    return D.columns_by_gutter(lines, "page", 550.0).select("page", "l_linenumber", "l_partkey", "column")


@query("""WITH g AS (SELECT l_orderkey, list_sort(list(l_quantity)) AS g FROM lineitem GROUP BY 1), m AS (SELECT *, list_median(g) AS mid FROM g)
    SELECT l_orderkey, g[1] >= 10 AND NOT (len(g) >= 3 AND len(list_filter(g, lambda x: abs(x - mid) <= 0.2::DOUBLE * mid)) = len(g)) AS multi, g[1 + (len(g) - 1) // 4] AS leading FROM m""")
def a47_a48_cells_and_leading(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("g"))
    return g.select("l_orderkey", D.is_multi_cell(F.col("g"), 10.0).alias("multi"), D.lower_quartile(F.col("g")).alias("leading"))


@query(f"SELECT n, CASE WHEN hit THEN regexp_extract(line, p, 1) ELSE line END AS designation, CASE WHEN hit THEN regexp_extract(line, p, 2) END AS item FROM (SELECT n, line, '^(Art\\. ?\\d+[a-z]*\\.)\\s+(1\\.\\s.+)$' AS p, regexp_matches(line, p) AS hit FROM {_literal(SPLITS, ['line'])[1]})".replace("regexp_extract(line, p, ", "regexp_extract(line, '^(Art\\. ?\\d+[a-z]*\\.)\\s+(1\\.\\s.+)$', "))
def a53_article_split(spark, sf):
    unit, item = D.article_split(F.col("line"))
    return _rows(spark, sf, SPLITS, ["line"]).select("n", unit.alias("designation"), item.alias("item"))


@query("""SELECT o_orderkey, list_filter([CASE WHEN NOT regexp_matches(id, '^[A-Za-z0-9._-]{1,100}$') THEN 'id' END, CASE WHEN o_orderkey % 11 <= 0 THEN 'version' END, CASE WHEN o_orderkey % 4 - 1 < 0 THEN 'validity' END], lambda x: x IS NOT NULL) AS problems
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'REG-' || o_orderkey END AS id FROM orders)""")
def b01_metadata_problems(spark, sf):
    key = F.col("o_orderkey")
    name = F.when(key % 5 == 0, F.col("o_orderpriority")).otherwise(F.concat(F.lit("REG-"), key.cast("string")))
    start = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select("o_orderkey", D.metadata_problems(name, key % 11, start, F.date_add(start, (key % 4 - 1).cast("int"))).alias("problems"))


@query("SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS kind FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def c05_left_lookup(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(known, "o_custkey", "left").select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("kind"))


@query("""WITH s AS (SELECT DISTINCT s_nationkey AS n, floor(s_acctbal / 1000)::BIGINT AS fact FROM supplier)
    SELECT a.n AS first_doc, b.n AS second_doc, count(*) AS shared, min(a.fact) AS fact FROM s a JOIN s b ON a.fact = b.fact AND a.n < b.n GROUP BY 1, 2""")
def c07_c08_g09_pairs_sharing_a_fact(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n"), F.floor(F.col("s_acctbal") / 1000).alias("fact")).distinct()
    pairs = s.withColumnRenamed("n", "first_doc").join(s.withColumnRenamed("n", "second_doc"), "fact").where("first_doc < second_doc")
    return pairs.groupBy("first_doc", "second_doc").agg(F.count("*").alias("shared"), F.min("fact").alias("fact"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_min(event_id, (value, event_id)) AS lowest FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def c10_c16_last_wins_and_extremes(spark, sf):
    return table(spark, sf, "events").where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("value"), F.min_by("event_id", F.struct("value", "event_id")).alias("lowest"))


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY seen) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS seen FROM events GROUP BY 1, 2) GROUP BY 1")
def c19_ordered_distinct(spark, sf):
    seen = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("seen"))
    return seen.groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seen", "event_type"))), lambda s: s["event_type"]), ",").alias("kinds"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus AS style, coalesce(lag(o_orderstatus) OVER w <> o_orderstatus, true)::INT AS fresh FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM r),
    t AS (SELECT o_custkey, run, CASE any_value(style) WHEN 'O' THEN '**' WHEN 'F' THEN '*' ELSE '' END AS m, string_agg(o_orderkey::VARCHAR, '' ORDER BY o_orderkey) AS t FROM g GROUP BY 1, 2)
    SELECT o_custkey, string_agg(m || t || m, ' ' ORDER BY run) AS rendered FROM t GROUP BY 1""")
def d03_a44_inline_runs(spark, sf):
    return D.inline_runs(table(spark, sf, "orders").withColumn("t", F.col("o_orderkey").cast("string")), ["o_custkey"], "o_orderkey", "o_orderstatus", "t", {"O": "**", "F": "*"})


@query("""SELECT p_partkey, repeat('  ', p_size % 3) || '- ' || CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '– ' WHEN 2 THEN p_size || '\\) ' ELSE p_size || '\\. ' END || p_name AS line,
    concat_ws(' \\| ', CASE WHEN p_partkey % 3 <> 0 THEN p_brand END, nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE p_type END), ''), p_name) AS "row" FROM part""")
def d06_d08_lists_and_fallback_rows(spark, sf):
    kind, n = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    label = F.when(kind == 0, "•").when(kind == 1, "–").when(kind == 2, F.concat(n, F.lit(")"))).otherwise(F.concat(n, F.lit(".")))
    cells = [F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(F.col("p_type")), F.col("p_name")]
    return table(spark, sf, "part").select("p_partkey", D.list_line(F.col("p_size") % 3, label, F.col("p_name")).alias("line"), D.fallback_row(cells).alias("row"))


@query("""SELECT c_custkey, 'Opłata ' || round(c_acctbal)::BIGINT || ' dla ' || c_name || ', dalej {{ref:brak}}; ' || round(c_acctbal)::BIGINT || '.' AS resolved, ['ref:brak'] AS unresolved FROM customer""")
def e29_g36_template_resolution(spark, sf):
    c = table(spark, sf, "customer")
    key = F.col("c_custkey").cast("string")
    texts = c.select("c_custkey", F.replace(F.replace(F.lit(TEMPLATE), F.lit("K1"), F.concat(F.lit("K"), key)), F.lit("nazwa"), F.concat(F.lit("N"), key)).alias("text"))
    values = c.select(F.concat(F.lit("fakt:K"), key).alias("name"), F.round("c_acctbal").cast("long").cast("string").alias("value")).union(c.select(F.concat(F.lit("param:N"), key), "c_name"))
    return D.resolved(texts, "c_custkey", "text", values)


@query("""WITH l AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, 1 + l_partkey % 3 AS lv, l_returnflag = 'R' AS wanted, l_partkey::VARCHAR AS t FROM lineitem)
    SELECT h.doc, h.ord AS unit, string_agg(x.t, ' ' ORDER BY x.ord) AS unit_text FROM l h JOIN l x ON h.doc = x.doc AND x.ord >= h.ord
        AND NOT EXISTS (SELECT 1 FROM l s WHERE s.doc = h.doc AND s.ord > h.ord AND s.ord <= x.ord AND s.lv <= h.lv) WHERE h.wanted GROUP BY 1, 2""")
def f06_unit_texts(spark, sf):
    ord_ = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), ord_.alias("ord"), (1 + F.col("l_partkey") % 3).alias("lv"), F.col("l_returnflag").alias("flag"), F.col("l_partkey").cast("string").alias("t"))
    return D.unit_texts(s, "doc", "ord", "lv", "t", F.col("flag") == "R")


@query("SELECT l_orderkey, count(DISTINCT l_suppkey % 2) AS documents, count(DISTINCT l_suppkey % 2) = 1 AS kept FROM lineitem WHERE EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) GROUP BY 1")
def f08_f12_known_units_and_merging(spark, sf):
    known = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    items = table(spark, sf, "lineitem").join(known, "l_suppkey", "left_semi").groupBy("l_orderkey").agg(F.countDistinct(F.col("l_suppkey") % 2).alias("documents"))
    return items.withColumn("kept", F.col("documents") == 1)


@query("SELECT event_id, CASE WHEN s IN (401, 403) THEN 'authentication' WHEN s = 404 THEN 'deployment' WHEN s = 429 THEN 'rate' WHEN s >= 500 THEN 'unavailable' WHEN s = 400 THEN 'request' END AS error FROM (SELECT event_id, [200, 400, 401, 403, 404, 429, 500, 503][1 + event_id % 8] AS s FROM events)")
def f19_service_errors(spark, sf):
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 404, 429, 500, 503))), (1 + F.col("event_id") % 8).cast("int"))
    return table(spark, sf, "events").select("event_id", D.service_error(status).alias("error"))


@query("""SELECT conv_id, turn, chr(10) || '## ' || CASE WHEN q LIKE '#%' THEN chr(92) || q ELSE q END || chr(10) || chr(10) || 'A' || chr(10) || chr(10) || text || chr(10) || chr(10)
    || CASE WHEN turn % 2 = 0 THEN 'Źródło: [D](u#page=1)' ELSE 'Źródła: [D](u#page=1); [E](v)' END || chr(10) AS entry
    FROM (SELECT *, CASE WHEN turn % 3 = 0 THEN '# ' ELSE '' END || role || ' ' || role AS q FROM (SELECT conv_id, turn, role, 'x' || turn AS text FROM conversations))""")
def f22_faq_entries(spark, sf):
    q = F.concat(F.when(F.col("turn") % 3 == 0, "# ").otherwise(""), "role", F.lit("\n"), "role", F.lit(" "))
    a = F.concat(F.lit("A  \r\n\r\n\r\n\r\nx"), F.col("turn").cast("string"), F.lit(" "))
    sources = F.when(F.col("turn") % 2 == 0, F.array(F.lit("[D](u#page=1)"))).otherwise(F.array(F.lit("[D](u#page=1)"), F.lit("[E](v)")))
    return table(spark, sf, "conversations").select("conv_id", "turn", D.faq_entry(q, a, sources).alias("entry"))


@query("SELECT o_orderkey, pos % 7 AS document, pos // 7 AS turn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('bloki' || o_orderkey), o_orderkey) - 1 AS pos FROM orders)")
def g12_block_dealing(spark, sf):
    line = Window.partitionBy("o_orderpriority").orderBy(F.md5(F.concat(F.lit("bloki"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey")
    pos = F.row_number().over(line).cast("long") - 1
    return table(spark, sf, "orders").select("o_orderkey", (pos % 7).alias("document"), F.floor(pos / 7).alias("turn"))


@query(f"""SELECT n, list_sort(regexp_extract_all({"regexp_replace(" * 4}replace(replace(line, '{{{{', chr(1)), '}}}}', chr(2)){", '\\{[^{}]*\\}', '', 'g')" * 4}, chr(1) || 'fakt:([^' || chr(2) || ']*)' || chr(2), 1)) AS facts FROM {_literal(GROUPS, ["line"])[1]}""")
def g14_guaranteed_facts(spark, sf):
    facts = F.regexp_extract_all(D.outside_groups(F.col("line")), F.lit(r"\{\{fakt:([^{}]*)\}\}"), F.lit(1))
    return _rows(spark, sf, GROUPS, ["line"]).select("n", F.array_sort(facts).alias("facts"))


@query()
def g29_random_streams(spark, sf):
    seed = D.stream_seed(F.lit(42).cast("long"), F.lit("szablony"), F.col("c_name"))
    return table(spark, sf, "customer").select("c_custkey", seed.alias("seed")).select("c_custkey", "seed", D.split_mix(F.col("seed"), F.lit(1).cast("long")).alias("first"))


@query("""WITH s AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, (1 + l_partkey % 3)::INT AS depth FROM lineitem)
    SELECT doc, ord, depth, CASE depth WHEN 1 THEN a::VARCHAR WHEN 2 THEN a || '.' || b ELSE a || '.' || b || '.' || c END AS number
    FROM (SELECT *, (SELECT count(*) FROM s x WHERE x.doc = s.doc AND x.ord <= s.ord AND x.depth = 1) AS a,
        (SELECT count(*) FROM s x WHERE x.doc = s.doc AND x.ord <= s.ord AND x.depth = 2 AND x.ord > coalesce((SELECT max(ord) FROM s y WHERE y.doc = s.doc AND y.ord <= s.ord AND y.depth < 2), 0)) AS b,
        (SELECT count(*) FROM s x WHERE x.doc = s.doc AND x.ord <= s.ord AND x.depth = 3 AND x.ord > coalesce((SELECT max(ord) FROM s y WHERE y.doc = s.doc AND y.ord <= s.ord AND y.depth < 3), 0)) AS c FROM s)""")
def g33_outline_numbers(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    ord_ = F.row_number().over(Window.partitionBy("doc").orderBy(*order)).cast("long")
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), *order).withColumns({"ord": ord_, "depth": (1 + F.col("l_partkey") % 3).cast("int")})
    return D.outline_numbers(s, "doc", order, "depth").select("doc", "ord", "depth", "number")


LINE_ROWS = "(SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, l_partkey, l_suppkey, l_quantity, l_returnflag FROM lineitem)"


def line_rows(spark, sf):
    ord_ = F.row_number().over(Window.partitionBy("doc").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("long")
    own = ["l_partkey", "l_suppkey", "l_quantity", "l_returnflag"]
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), "l_linenumber", *own).select("doc", ord_.alias("ord"), *own)


@query("SELECT page_id, CASE WHEN h IS NULL THEN 'read-error' WHEN trim(regexp_replace(h, '<[^>]*>|\\s+', ' ', 'g')) = '' THEN 'no-text-layer' END AS reason FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '<p> <b></b>' || chr(10) || '</p>' ELSE html END AS h FROM pages)")
def a02_skipped_pages(spark, sf):
    kind = F.col("page_id") % 5
    html = F.when(kind == 1, F.lit("<p> <b></b>\n</p>")).when(kind > 1, F.col("html"))
    return table(spark, sf, "pages").select("page_id", D.skip_reason(html).alias("reason"))


@query(f"""WITH s AS (SELECT doc, ord, (1 + l_partkey % 4)::INT AS depth, 'p' || l_partkey AS label FROM {LINE_ROWS}),
    a AS (SELECT s.doc, s.ord, list(x.label ORDER BY x.ord) AS ancestors, max(x.ord) AS parent FROM s JOIN s x ON x.doc = s.doc AND x.ord < s.ord AND x.depth < s.depth
        AND NOT EXISTS (SELECT 1 FROM s y WHERE y.doc = s.doc AND y.ord > x.ord AND y.ord < s.ord AND y.depth <= x.depth) GROUP BY 1, 2)
    SELECT s.*, parent, coalesce(ancestors, []) AS ancestors FROM s LEFT JOIN a ON s.doc = a.doc AND s.ord = a.ord""")
def a30_a43_b11_list_tree(spark, sf):
    items = line_rows(spark, sf).select("doc", "ord", (1 + F.col("l_partkey") % 4).cast("int").alias("depth"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("label"))
    return D.list_tree(items, "doc", "ord", "depth", "label")


@query(f"SELECT doc, ord, floor(l_quantity / 10)::BIGINT AS row_no, l_partkey % 100 // 25 AS col_no FROM {LINE_ROWS} WHERE l_quantity > 0 AND l_quantity < 50 AND l_quantity % 10 <> 0 AND l_partkey % 100 < 75")
def a51_words_in_cells(spark, sf):
    rows = line_rows(spark, sf)
    words = rows.where("l_quantity % 10 <> 0").select("doc", "ord", (F.col("l_partkey") % 100).cast("double").alias("centre"), F.col("l_quantity").alias("baseline"))
    names = ["row_no", "col_no", "left", "right", "top", "bottom"]
    grid = F.array(*[F.struct(*[F.lit(v).cast("long" if k.endswith("_no") else "double").alias(k) for k, v in zip(names, (r, c, c * 25, (c + 1) * 25, r * 10, (r + 1) * 10), strict=True)]) for r in range(5) for c in range(3)])
    # a page is the first row of a document: so it comes out in the order that the join needs, and cells are not sorted
    pages = rows.where("ord = 1").select("doc", grid.alias("cells"))
    return D.words_in_cells(words, pages, "doc").select("doc", "ord", "row_no", "col_no")


@query(f"SELECT doc, string_agg(repeat('#', (1 + l_partkey % 3)::INT) || ' H' || ord || CASE WHEN l_returnflag = 'N' THEN '' ELSE chr(10) || chr(10) || 'b' || l_suppkey END, chr(10) || chr(10) ORDER BY ord) || chr(10) AS markdown FROM {LINE_ROWS} GROUP BY doc")
def d01_b16_rendered_sections(spark, sf):
    blocks = line_rows(spark, sf).select("doc", "ord", (1 + F.col("l_partkey") % 3).cast("int").alias("level"), F.concat(F.lit("H"), F.col("ord").cast("string")).alias("heading"), F.when(F.col("l_returnflag") == "N", "").otherwise(F.concat(F.lit("b"), F.col("l_suppkey").cast("string"))).alias("body"))
    return D.rendered_sections(blocks, "doc", "ord", "level", "heading", "body")


@query("SELECT doc_id, list_filter([CASE WHEN trim(coalesce(source, '')) = '' THEN 'name' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'markdown' END, CASE WHEN doc_id % 3 = 0 THEN 'address' END, CASE WHEN ceil(length(text) / 3.0) > 1000 THEN 'size' END], lambda x: x IS NOT NULL) AS problems FROM documents")
def f01_input_problems(spark, sf):
    address = F.when(F.col("doc_id") % 3 == 0, "plik.pdf").otherwise(F.concat(F.lit("https://example.com/"), F.col("doc_id").cast("string")))
    return table(spark, sf, "documents").select("doc_id", D.input_problems(F.col("source"), F.col("text"), address, T.token_estimate(F.col("text")), 1000).alias("problems"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'D' || c_custkey || '-K' || k END AS id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS question, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS answer,
    CASE WHEN c_custkey % 3 <> 0 AND k = 1 THEN '§ 1' END AS unit, CASE WHEN c_custkey % 3 <> 0 THEN 'q' END AS quote, CASE WHEN c_custkey % 3 = 0 THEN 'shape' END AS problem
    FROM customer, (VALUES (1), (2)) AS v(k) WHERE k = 1 OR c_custkey % 3 <> 0""")
def f02_f03_candidate_parse(spark, sf):
    one = lambda unit: F.struct(F.col("c_name").alias("question"), F.col("c_mktsegment").alias("answer"), F.lit(unit).alias("unit"), F.lit("q").alias("quote"))
    good = F.to_json(F.struct(F.array(one("§ 1"), one(" ")).alias("candidates")))
    json = F.when(F.col("c_custkey") % 3 == 0, F.replace(good, F.lit('"quote"'), F.lit('"other"'))).otherwise(good)
    return D.parsed_candidates(table(spark, sf, "customer").select("c_custkey", json.alias("json")), "c_custkey", "json")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN n <= 2 THEN 'formal' WHEN n <= 5 THEN 'compact' ELSE ['formal', 'plain', 'compact'][1 + ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 3] END AS layout FROM (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders)")
def g11_layout_quotas(spark, sf):
    return D.layout_for(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey", [("formal", 2), ("compact", 3)], ["formal", "plain", "compact"])


@query(f"""WITH r AS (SELECT doc, ord, l_returnflag AS sec, row_number() OVER (PARTITION BY doc, l_returnflag ORDER BY ord) AS turn FROM {LINE_ROWS}),
    t AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY turn > 1, turn, sec) AS taken FROM r) SELECT doc, ord, sec FROM t WHERE turn <= 1 OR taken <= 4""")
def g13_optional_blocks(spark, sf):
    return D.optional_blocks(line_rows(spark, sf).select("doc", "ord", F.col("l_returnflag").alias("sec")), "doc", "sec", "ord", 1, 4)
