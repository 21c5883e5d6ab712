"""Queries of the structure operators, with their SQL: sentences of documents stand in for lines, numbers of the key for geometry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import structure as S
from .queries_text import table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


PAGE = 12
LINES = f"""(SELECT *, n // {PAGE} AS page, CASE WHEN n % {PAGE} >= 9 THEN 8.0 WHEN (doc_id + n) % 7 = 0 THEN 13.0 ELSE 10.0 END::DOUBLE AS size, (doc_id + 2 * n) % 5 = 0 AS bold, (doc_id + n) % 11 = 0 AS centered,
    ((n % {PAGE}) * 12 + 8 * ((n % {PAGE}) // 2))::DOUBLE AS baseline FROM (SELECT doc_id, unnest(range(len(ls)))::INT AS n, unnest(ls) AS raw FROM (SELECT doc_id, string_split(coalesce(text, ''), '. ') AS ls FROM documents)),
    LATERAL (SELECT CASE n % 6 WHEN 1 THEN substr(raw, 1, 40) WHEN 2 THEN substr(raw, 1, 30) WHEN 4 THEN substr(raw, 1, 25) || '-' ELSE raw END AS text))"""


def lines(spark, sf):
    """doc_id, n, text, page, size, bold, centered, baseline."""
    raw = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\. ")).alias("n", "raw"))
    n, at = F.col("n"), F.col("n") % PAGE
    head = lambda k: F.substring("raw", 1, k)
    text = F.when(n % 6 == 1, head(40)).when(n % 6 == 2, head(30)).when(n % 6 == 4, F.concat(head(25), F.lit("-"))).otherwise(F.col("raw"))
    size = F.when(at >= 9, 8.0).when((F.col("doc_id") + n) % 7 == 0, 13.0).otherwise(10.0)
    return raw.select(
        "doc_id", "n", text.alias("text"), F.floor(n / PAGE).alias("page"), size.alias("size"), ((F.col("doc_id") + 2 * n) % 5 == 0).alias("bold"), ((F.col("doc_id") + n) % 11 == 0).alias("centered"),
        (at * 12 + 8 * F.floor(at / 2)).cast("double").alias("baseline"),
    )


def _join_sql(a: str, b: str) -> str:
    prefix, word = f"regexp_extract(rtrim({a}), '(\\p{{L}}+)-$', 1)", f"regexp_extract({b}, '^(\\p{{L}}+)', 1)"
    web = f"(regexp_matches(rtrim({a}), '.-$') AND {b} <> '' AND (contains(regexp_extract(rtrim({a}), '([^ ]*)$', 1), '/') OR contains(regexp_extract(rtrim({a}), '([^ ]*)$', 1), 'www.')))"
    keep = f"(regexp_matches({b}, '^\\p{{Lu}}') OR length({prefix}) = 1 OR regexp_matches({prefix}, '^\\p{{Lu}}{{1,4}}$'))"
    return f"CASE WHEN {a} = '' THEN {b} WHEN {b} = '' THEN {a} WHEN {web} THEN {a} || {b} WHEN {prefix} = '' OR {word} = '' THEN {a} || ' ' || {b} WHEN {keep} THEN {a} || {b} ELSE {a}[:-2] || {b} END"


def _joined_sql(items: str) -> str:
    return f"list_reduce(list_prepend('', list_transform({items}, lambda t: trim(t))), lambda a, b: {_join_sql('a', 'b')})"


EXCLUDED = r'''(regexp_matches(text, '\.{4,}|…{2,}') OR regexp_matches(text, '^\s*[„"«]') OR regexp_matches(lower(text), '^\s*(rys|rysunek|tabela|wykres)\b[. ]*[0-9]') OR regexp_matches(trim(text), '[,;]$'))'''
CANDIDATES = f"""(SELECT *, short AND isolated AND (enlarged OR bold OR capitals OR centered) AND NOT {EXCLUDED} AS candidate FROM
    (SELECT *, size >= 1.15::DOUBLE * 10 AS enlarged, upper(text) = text AND lower(text) <> text AS capitals, coalesce(baseline - lag(baseline) OVER w > 1.3::DOUBLE * 12, true) AS isolated, length(text) <= 120 AND regexp_matches(text, '\\p{{L}}') AS short
    FROM {LINES} WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)))"""


@query(f"SELECT doc_id, n, enlarged, isolated, candidate, {EXCLUDED} AS excluded FROM {CANDIDATES}")
def a32_a35_heading_candidates(spark, sf):
    return S.heading_candidates(lines(spark, sf), 10.0, 12.0).select("doc_id", "n", "enlarged", "isolated", "candidate", S.excluded(F.col("text")).alias("excluded"))


@query(f"""WITH c AS (SELECT *, coalesce(NOT candidate AND lag(size) OVER w = size AND lag(bold) OVER w = bold AND (enlarged OR bold) AND baseline - lag(baseline) OVER w <= 1.3::DOUBLE * 12 AND NOT regexp_matches(trim(text), '[,;]$'), false) AS goes_on FROM {CANDIDATES} WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
    r AS (SELECT *, sum((NOT goes_on)::INT) OVER (PARTITION BY doc_id, page ORDER BY n) AS run FROM c),
    k AS (SELECT *, row_number() OVER w AS nth, first(candidate) OVER w AS opens, sum(length(text) + 1) OVER w - 1 AS long FROM r WINDOW w AS (PARTITION BY doc_id, page, run ORDER BY n))
    SELECT doc_id, page, min(n) AS n, string_agg(text, ' ' ORDER BY n) AS text, count(*) AS n_lines FROM k WHERE opens AND nth <= 3 AND (nth = 1 OR long <= 120) GROUP BY doc_id, page, run""")
def a32_headings(spark, sf):
    return S.headings(lines(spark, sf), 10.0, 12.0)


@query(f"""WITH c AS (SELECT * FROM {CANDIDATES} WHERE trim(text) <> ''),
    r AS (SELECT *, min(page) OVER d AS p0, min(n) OVER d AS n0, max(CASE WHEN candidate AND enlarged THEN size END) OVER d AS top FROM c WINDOW d AS (PARTITION BY doc_id)),
    f AS (SELECT doc_id, n, text, CASE WHEN regexp_matches(lower(text), '^\\s*({'|'.join(S.ACT_TYPES)})\\b') AND isolated AND page = p0 THEN 1 WHEN n = n0 AND candidate AND enlarged AND size >= top THEN 2 END AS rank FROM r)
    SELECT doc_id, n, text FROM f WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank, n) = 1""")
def a34_titles(spark, sf):
    return S.titles(lines(spark, sf), 10.0, 12.0)


@query(f"SELECT doc_id, page, {_joined_sql('list(text ORDER BY n)')} AS text FROM {LINES} GROUP BY doc_id, page")
def a37_joined_lines(spark, sf):
    rows = lines(spark, sf).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("ls"))
    return rows.select("doc_id", "page", S.joined_lines(F.transform("ls", lambda r: r["text"])).alias("text"))


NOTE = r"regexp_extract(text, '^\s*(\d{1,3}|\*{1,3})\)?\s', 1)"


@query(f"""WITH l AS (SELECT * REPLACE (CASE WHEN (doc_id + n) % 3 = 0 THEN n || ') ' || text ELSE text END AS text) FROM {LINES}),
    s AS (SELECT *, sum((size > 0.85::DOUBLE * 10)::INT) OVER (PARTITION BY doc_id, page ORDER BY n DESC) AS big FROM l),
    k AS (SELECT *, nullif({NOTE}, '') AS label FROM s WHERE big = 0 AND trim(text) <> ''),
    g AS (SELECT *, sum((label IS NOT NULL)::INT) OVER (PARTITION BY doc_id, page ORDER BY n) AS note FROM k)
    SELECT doc_id, page, max(label) AS label, min(n) AS n, regexp_replace({_joined_sql('list(text ORDER BY n)')}, '^\\s*(\\d{{1,3}}|\\*{{1,3}})\\)?\\s+', '') AS text FROM g GROUP BY doc_id, page, note HAVING max(label) IS NOT NULL""")
def a19_note_definitions(spark, sf):
    marked = F.when((F.col("doc_id") + F.col("n")) % 3 == 0, F.concat(F.col("n").cast("string"), F.lit(") "), "text")).otherwise(F.col("text"))
    return S.note_definitions(lines(spark, sf).withColumn("text", marked), 10.0)


@query(r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, size <= 0.85::DOUBLE * 10 AND l_discount >= 0.15::DOUBLE * 10 / 100 AND regexp_matches(t, '^(\d{1,3}|\*{1,3})\)?$') AS is_marker
    FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey::VARCHAR ELSE '**)' END AS t, l_quantity / 4 AS size FROM lineitem)""")
def a19_note_markers(spark, sf):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey").cast("string")).otherwise("**)")
    marker = S.note_marker(text, F.col("l_quantity") / 4, F.col("l_discount") * 100, F.lit(10.0))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", marker.alias("is_marker"))


@query(f"""WITH g AS (SELECT *, baseline - lag(baseline) OVER w AS gap, lag(size) OVER w AS above FROM {LINES} WHERE n % 3 <> 0 WINDOW w AS (PARTITION BY doc_id, page ORDER BY n)),
    r AS (SELECT *, sum((NOT coalesce(gap > 0 AND gap <= 1.8::DOUBLE * above, false))::INT) OVER (PARTITION BY doc_id, page ORDER BY n) AS note FROM g)
    SELECT doc_id, page, min(n) AS n, string_agg(text, ' ' ORDER BY n) AS text, count(*) AS n_lines FROM r GROUP BY doc_id, page, note""")
def a42_side_notes(spark, sf):
    return S.side_notes(lines(spark, sf).where("n % 3 <> 0"))


SEGMENTS = """(SELECT l_orderkey, l_quantity AS size, CASE l_partkey % 6 WHEN 0 THEN '•' WHEN 1 THEN l_linenumber || ')' WHEN 2 THEN l_linenumber || '.' WHEN 3 THEN 'a/' ELSE 'v' || l_partkey END AS text,
    (l_linenumber * 100 + l_partkey % 50)::DOUBLE AS "left", (l_linenumber * 100 + l_partkey % 50 + 10)::DOUBLE AS "right" FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1)"""


def segments(spark, sf):
    one = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity"))
    kind, no = F.col("l_partkey") % 6, F.col("l_linenumber").cast("string")
    text = F.when(kind == 0, "•").when(kind == 1, F.concat(no, F.lit(")"))).when(kind == 2, F.concat(no, F.lit("."))).when(kind == 3, "a/").otherwise(F.concat(F.lit("v"), F.col("l_partkey").cast("string")))
    left = (F.col("l_linenumber") * 100 + F.col("l_partkey") % 50).cast("double")
    return table(spark, sf, "lineitem").withColumn("one", one).where("one = 1").select("l_orderkey", F.col("l_quantity").alias("size"), text.alias("text"), left.alias("left"), (left + 10).alias("right"))


@query(f"""WITH s AS (SELECT *, coalesce(regexp_matches(text, '^([•◦▪‣]|\\d{{1,3}}\\)|\\p{{Ll}}{{1,2}}\\))$') OR (regexp_matches(text, '^(\\d{{1,3}}[./]|\\p{{Ll}}[./]|[ivx]+\\.)$') AND lead("left") OVER w - "right" <= 2.0::DOUBLE * size), false) AS is_label FROM {SEGMENTS} WINDOW w AS (PARTITION BY l_orderkey ORDER BY "left")),
    k AS (SELECT *, sum((NOT is_label OR NOT coalesce(lag(is_label) OVER w, false))::INT) OVER w2 AS streak FROM (SELECT *, lag(is_label) OVER (PARTITION BY l_orderkey ORDER BY "left") AS before FROM s) WINDOW w AS (PARTITION BY l_orderkey ORDER BY "left"), w2 AS (PARTITION BY l_orderkey ORDER BY "left")),
    o AS (SELECT *, is_label AND row_number() OVER (PARTITION BY l_orderkey, streak ORDER BY "left") % 2 = 1 AS opens FROM k),
    c AS (SELECT *, sum((NOT coalesce(held, false))::INT) OVER (PARTITION BY l_orderkey ORDER BY "left") AS cell FROM (SELECT *, lag(opens) OVER (PARTITION BY l_orderkey ORDER BY "left") AS held FROM o))
    SELECT l_orderkey, cell, string_agg(text, ' ' ORDER BY "left") AS text, min("left") AS "left", max("right") AS "right" FROM c GROUP BY 1, 2""".replace("(NOT is_label OR NOT coalesce(lag(is_label) OVER w, false))::INT) OVER w2 AS streak", "(NOT is_label OR NOT coalesce(before, false))::INT) OVER w2 AS streak").replace(" WINDOW w AS (PARTITION BY l_orderkey ORDER BY \"left\"), w2 AS", " WINDOW w2 AS"))
def a46_line_cells(spark, sf):
    return S.line_cells(segments(spark, sf), ["l_orderkey"])


@query(f"""WITH l AS (SELECT doc_id, page, n // 4 AS "row", n % 2 AS "column", n, text, size >= 13 OR n < 4 AND doc_id % 2 = 0 AS bold FROM {LINES}),
    c AS (SELECT doc_id, page, "row", "column", {_joined_sql('list(text ORDER BY n)')} AS text, min(bold::INT) AS b FROM l GROUP BY ALL)
    SELECT doc_id, page, "row", "column", text, "row" = min("row") OVER t AND min(b) OVER r = 1 AND max("row") OVER t > min("row") OVER t AS is_header FROM c WINDOW t AS (PARTITION BY doc_id, page), r AS (PARTITION BY doc_id, page, "row")""")
def a49_cell_texts(spark, sf):
    n = F.col("n")
    cells = lines(spark, sf).select("doc_id", "page", F.floor(n / 4).alias("row"), (n % 2).alias("column"), "n", "text", ((F.col("size") >= 13) | (n < 4) & (F.col("doc_id") % 2 == 0)).alias("bold"))
    return S.merged_cells(cells, ["doc_id", "page"])


@query("""WITH c AS (SELECT l_orderkey, l_linenumber % 4 AS line, (l_partkey % 500)::DOUBLE AS "left", l_partkey % 500 + l_quantity * 2 AS "right" FROM lineitem),
    l AS (SELECT l_orderkey, line, count(*) FILTER ("left" < 250) AS a, count(*) FILTER ("left" >= 250) AS b, bool_and("right" <= 250 OR "left" >= 250) AS apart, bool_and("right" <= 260 OR "left" >= 240) AS free FROM c GROUP BY 1, 2)
    SELECT l_orderkey, sum(a) > 0 AND sum(b) > 0 AND (bool_and(apart) OR (count(*) FILTER (a <= 1 AND b <= 1) >= 0.75::DOUBLE * count(*) AND bool_and(free))) AS is_text FROM l GROUP BY 1""")
def a52_text_columns(spark, sf):
    left = (F.col("l_partkey") % 500).cast("double")
    cells = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 4).alias("line"), left.alias("left"), (left + F.col("l_quantity") * 2).alias("right"))
    return S.text_columns(cells, ["l_orderkey"], 240.0, 260.0)


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN 'o' ELSE 'x' END = 'o' AND event_type <> CASE WHEN user_id % 2 = 0 THEN 'click' END, false) AS bullet FROM events")
def a54_font_bullets(spark, sf):
    word = F.when(F.col("event_id") % 3 == 0, "o").otherwise("x")
    return table(spark, sf, "events").select("event_id", S.font_bullet(word, F.col("event_type"), F.when(F.col("user_id") % 2 == 0, "click")).alias("bullet"))


POINT, HEADED = r"^\s*(\d{1,3}[)/]|\p{Ll}{1,2}[)/.]|[ivx]+\.|[-–•])\s", r"^\s*(\d{1,3}\.|§ ?\d+|[IVX]+\.)\s"


@query(f"""WITH l AS (SELECT * REPLACE (CASE n % 4 WHEN 0 THEN n || '. ' WHEN 1 THEN n || ') ' WHEN 2 THEN '' ELSE '§ ' || n || ' ' END || CASE WHEN doc_id % 2 = 0 THEN lower(text) ELSE text END AS text) FROM {LINES}),
    m AS (SELECT *, regexp_matches(text, '{POINT}') AS point, regexp_matches(text, '{POINT}') OR regexp_matches(text, '{HEADED}') AS labelled FROM l),
    f AS (SELECT *, coalesce(lead(regexp_matches(text, '^\\p{{Ll}}') AND NOT labelled) OVER w AND lead(baseline) OVER w - baseline <= 1.3::DOUBLE * 12, false) AND size <= 12 AS runs_on FROM m WINDOW w AS (PARTITION BY doc_id, page ORDER BY n))
    SELECT doc_id, n, bold AND labelled AND NOT point AND NOT runs_on AS heading_like FROM f""")
def a55_heading_like_labels(spark, sf):
    n = F.col("n")
    no = n.cast("string")
    label = F.when(n % 4 == 0, F.concat(no, F.lit(". "))).when(n % 4 == 1, F.concat(no, F.lit(") "))).when(n % 4 == 2, "").otherwise(F.concat(F.lit("§ "), no, F.lit(" ")))
    text = F.concat(label, F.when(F.col("doc_id") % 2 == 0, F.lower("text")).otherwise(F.col("text")))
    return S.heading_like(lines(spark, sf).withColumn("text", text), 12.0, 12.0).select("doc_id", "n", "heading_like")


@query("""WITH l AS (SELECT p_partkey AS line_id, p_size % 5 AS s, p_name || ' ' || p_type AS text FROM part),
    m AS (SELECT p_size % 5 AS s, p_type AS member, min(p_partkey) AS ordinal FROM part WHERE p_size % 5 < 2 GROUP BY 1, 2),
    f AS (SELECT line_id, arg_min(member, (ordinal, member)) AS member FROM l JOIN m ON l.s = m.s AND length(member) >= 5 AND contains(' ' || text || ' ', ' ' || member || ' ') AND text <> member GROUP BY 1)
    SELECT l.line_id, CASE WHEN member IS NULL THEN text ELSE trim(replace(' ' || text || ' ', ' ' || member || ' ', '  ')) END AS text FROM l LEFT JOIN f USING (line_id)""")
def a17_embedded_artifacts(spark, sf):
    part = table(spark, sf, "part").withColumn("s", F.col("p_size") % 5)
    rows = part.select(F.col("p_partkey").alias("line_id"), "s", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    members = part.where("s < 2").groupBy("s", F.col("p_type").alias("member")).agg(F.min("p_partkey").alias("ordinal"))
    return S.trimmed_artifacts(rows, members, "s").select("line_id", "text")


@query("SELECT page_id, CASE WHEN reason IS NOT NULL THEN '<!-- page ' || page_id || ': skipped, ' || reason || ' -->' END AS comment FROM (SELECT page_id, CASE WHEN length(coalesce(html, '')) < 200 THEN 'no-text-layer' WHEN page_id % 10 = 0 THEN 'read-error' END AS reason FROM pages)")
def d09_skipped_pages(spark, sf):
    reason = F.when(F.length(F.coalesce("html", F.lit(""))) < 200, "no-text-layer").when(F.col("page_id") % 10 == 0, "read-error")
    return table(spark, sf, "pages").select("page_id", S.skipped_page(F.col("page_id"), reason).alias("comment"))


@query("""WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey // 4 END AS parent FROM orders),
    r AS (SELECT id, 0 AS depth, [id] AS path FROM t WHERE parent IS NULL UNION ALL SELECT t.id, depth + 1, list_append(path, t.id) FROM r JOIN t ON t.parent = r.id WHERE depth < 3)
    SELECT id, depth, array_to_string(path, '.') AS path FROM r""")
def c22_flattened_tree(spark, sf):
    key = F.col("o_orderkey")
    nodes = table(spark, sf, "orders").select(key.alias("id"), F.when(key % 8 != 0, F.floor(key / 4)).alias("parent"), key.alias("ord"))
    return S.flattened(nodes, 3).select("id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ".").alias("path"))


@query("SELECT o.o_orderkey, c.c_name FROM orders o JOIN (SELECT c_nationkey AS k, arg_min(c_name, c_custkey) AS c_name FROM customer GROUP BY 1) c ON o.o_custkey % 25 = c.k")
def c04_first_wins_lookup(spark, sf):
    first = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.min_by("c_name", "c_custkey").alias("c_name"))
    return table(spark, sf, "orders").join(first, F.col("o_custkey") % 25 == F.col("k")).select("o_orderkey", "c_name")


@query("SELECT doc_id, array_to_string(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')[1:3], ' ') AS opening FROM documents")
def c23_first_three_words(spark, sf):
    words = F.filter(F.split(F.coalesce("text", F.lit("")), " "), lambda w: w != "")
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(words, 1, 3), " ").alias("opening"))
