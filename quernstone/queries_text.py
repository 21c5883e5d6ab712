"""Queries of the scalar text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import corpus

ALLOWED = ["example.com", "example.org"]
SECRET = "token"
#: Literal rows: lines of a regulation, labels, page marks and fonts.
LINES = ["Art. 12a. Bank otwiera rachunek", "Art. 5.", "§12", "§ 7. Postanowienia", "[Art. 31. Uchylony]", "Dział IIa", "ROZDZIAŁ 3 Opłaty", "Księga pierwsza", "Księga 3", "§ 5 ust. 2", "Oddział xyz", "<§ 9. Nowe brzmienie", "zwykły wiersz"]
LABELS = ["1) pierwszy", "2a. drugi", "a) litera", "aa) litery", "– myślnik", "• punkt", "1.2. zarys", "II. rzymska", "iv) mała", "i. spór", "xii. dwanaście", "1/ ukośnik", "b/ lit", "2024. rok", "[1) uchylony", "[– nie", "np. skrót", "a)"]
PAGES = ["12", "2024", "- 3 -", "3 / 40", "Strona 7 z 9", "str. 5", "s. 4/10", "iv", "MCMXC", "IIII", "", "x1", "12 / 345"]
HYPHENS = [("opłata 10-", "dniowa"), ("miasto Bielsko-", "Biała"), ("Przedsiębior-", "ca zawarta"), ("www.bank-", "online"), ("PKO-", "owski"), ("e-", "mail"), ("polsko-", "angielski"), ("koniec", "x"), ("słowo-", "1")]
UNITS = [("§ 12 ust. 3", "§ 12."), ("§ 120", "§ 12"), ("6 ust. 2", "6. Opłaty"), ("Art. 5, pkt 1", "art. 5"), ("", "§ 1"), ("§  3", "§ 3"), ("6.1", "6. Opłaty")]
FONTS = ["ABCDEF+Calibri-BoldItalic", "Times,Bold", "Arial", "ArialMT-Oblique", "XYZ+Verdana"]
IDS = ["REG-01-w2", "REG-01", "w3", "a-w", "T-w12"]
LABEL_UNITS = ["5.", "IV.", "§ 3", "Opłaty.", " 12 "]


def _literal(rows: list, names: list[str]) -> tuple:
    """(Spark rows, SQL of them and of all document lines). With two names the second is the line after."""
    rows = [r if isinstance(r, tuple) else (r,) for r in rows]
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    own = "VALUES " + ", ".join("(" + ", ".join([f"{i}::BIGINT", *map(quote, r)]) + ")" for i, r in enumerate(rows))
    columns = ", ".join(["t", "coalesce(lead(t) OVER (PARTITION BY n // 1000000 ORDER BY n), '')"][: len(names)])
    return rows, f"({own} UNION ALL SELECT n, {columns} FROM {DOCUMENT_LINES}) AS v(n, {', '.join(names)})"


DOCUMENT_LINES = "(SELECT (doc_id + 1) * 1000000 + unnest(range(len(ls))) AS n, unnest(ls) AS t FROM (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\n|\\. ') AS ls FROM documents))"


def _rows(spark: SparkSession, sf_dir: str, rows: list, names: list[str]) -> DataFrame:
    """The literal rows and all lines and sentences of the documents."""
    own = spark.createDataFrame([(i, *r) for i, r in enumerate(_literal(rows, names)[0])], "n long, " + ", ".join(f"{x} string" for x in names))
    split = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\n|\. ")).alias("p", "t"))
    following = F.coalesce(F.lead("t").over(Window.partitionBy("doc_id").orderBy("p")), F.lit(""))
    found = [F.col("t"), following][: len(names)]
    return own.unionByName(split.select(((F.col("doc_id") + 1) * 1000000 + F.col("p")).alias("n"), *[c.alias(x) for c, x in zip(found, names, strict=True)]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line)."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


LINES_SQL = "(SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents)"
FP_SQL = "regexp_replace(trim(regexp_replace(regexp_replace(lower({}), '\\p{{Nd}}+', '#', 'g'), '\\s+', ' ', 'g')), '^[^\\p{{L}}#]+|[^\\p{{L}}#]+$', '', 'g')"
SQ = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
ROMAN_SQL = "list_reduce(list_prepend({{'t': 0, 'm': 0}}, list_transform(list_reverse(string_split(lower({}), '')), lambda x: {{'t': CASE x WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 WHEN 'm' THEN 1000 ELSE 0 END, 'm': 0}})), lambda acc, cur: {{'t': acc.t + CASE WHEN cur.t < acc.m THEN -cur.t ELSE cur.t END, 'm': greatest(acc.m, cur.t)}}).t"

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query(f"SELECT doc_id, line_no, {FP_SQL.format('line')} AS fp FROM {LINES_SQL}")
def e01_line_fingerprint(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "line_no", T.fingerprint(F.col("line")).alias("fp"))


@query("WITH p AS (SELECT p_partkey, p_name, lag(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS prev FROM part) SELECT p_partkey, levenshtein(p_name, prev)::INTEGER AS distance, round(1 - levenshtein(p_name, prev) / greatest(length(p_name), length(prev)), 9) AS similarity FROM p WHERE prev IS NOT NULL")
def e02_similarity(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = table(spark, sf, "part").withColumn("prev", F.lag("p_name").over(w)).where("prev IS NOT NULL")
    return p.select("p_partkey", F.levenshtein("p_name", "prev").alias("distance"), F.round(T.similarity(F.col("p_name"), F.col("prev")), 9).alias("similarity"))


_P = "trim(t)"
@query(f"""SELECT n, t, CAST(CASE WHEN regexp_full_match({_P}, '\\d{{1,3}}') THEN {_P} WHEN regexp_full_match({_P}, '[-–—]\\s*\\d{{1,4}}\\s*[-–—]|\\d{{1,4}}\\s*/\\s*\\d{{1,4}}|(?i:strona\\s+\\d{{1,4}}(\\s+z\\s+\\d{{1,4}})?|str\\.\\s*\\d{{1,4}}|s\\.\\s*\\d{{1,4}}(\\s*/\\s*\\d{{1,4}})?)') THEN regexp_extract({_P}, '\\d+')
    WHEN {_P} <> '' AND regexp_full_match({_P}, '(?i)m{{0,3}}(cm|cd|d?c{{0,3}})(xc|xl|l?x{{0,3}})(ix|iv|v?i{{0,3}})') THEN CAST({ROMAN_SQL.format(_P)} AS VARCHAR) END AS INTEGER) AS page,
    CAST(nullif(regexp_extract({_P}, '^(\\d{{1,3}})\\s*/\\s*(\\d{{1,3}})$', 1), '') AS INTEGER) AS of_n, CAST(nullif(regexp_extract({_P}, '^(\\d{{1,3}})\\s*/\\s*(\\d{{1,3}})$', 2), '') AS INTEGER) AS of_m FROM {_literal(PAGES, ["t"])[1]}""")
def e03_e04_e05_page_numbers(spark, sf):
    t = F.col("t")
    n, m = T.page_of_total(t)
    return _rows(spark, sf, PAGES, ["t"]).select("n", "t", T.page_number(t).alias("page"), n.alias("of_n"), m.alias("of_m"))


@query("SELECT DISTINCT p_size, concat(repeat('l', (p_size // 50)::INT), CASE WHEN p_size % 50 >= 40 THEN 'xl' ELSE repeat('x', (p_size % 50 // 10)::INT) END, CASE WHEN p_size % 10 = 9 THEN 'ix' WHEN p_size % 10 = 4 THEN 'iv' ELSE concat(repeat('v', (p_size % 10 // 5)::INT), repeat('i', (p_size % 10 % 5)::INT)) END) AS roman FROM part")
def e06_to_roman(spark, sf):
    return table(spark, sf, "part").select("p_size", T.to_roman(F.col("p_size")).alias("roman")).distinct()


@query(f"""WITH x AS (SELECT n, rtrim(e) AS e, ltrim(f) AS f, regexp_extract(rtrim(e), '(\\p{{L}}+)-$', 1) AS p, regexp_extract(ltrim(f), '^(\\p{{L}}+)', 1) AS w FROM {_literal(HYPHENS, ["e", "f"])[1]})
    SELECT n, CASE WHEN regexp_matches(e, '.-$') AND f <> '' AND regexp_matches(regexp_extract(e, '([^ ]*)$', 1), '/|www\\.') THEN 'KEEP' WHEN p = '' OR w = '' THEN 'NONE'
    WHEN lower(p || '-' || w) = 'polsko-angielski' OR regexp_matches(f, '^\\p{{Lu}}') OR length(p) = 1 OR regexp_full_match(p, '\\p{{Lu}}{{1,4}}') THEN 'KEEP' ELSE 'REMOVE' END AS join_kind FROM x""")
def e07_hyphen_join(spark, sf):
    return _rows(spark, sf, HYPHENS, ["e", "f"]).select("n", T.hyphen_join(F.col("e"), F.col("f"), ["polsko-angielski"]).alias("join_kind"))


_N = "\\d+[a-z]{0,3}[¹²³⁰⁴⁵⁶⁷⁸⁹]*"
@query(f"""WITH x AS (SELECT n, trim(t) AS t, CASE WHEN regexp_matches(trim(t), '^[\\[<].') THEN substr(trim(t), 1, 1) ELSE '' END AS prefix FROM {_literal(LINES, ["t"])[1]}),
    y AS (SELECT *, CASE WHEN prefix <> '' THEN substr(t, 2) ELSE t END AS u, regexp_extract(t, '^(KSIĘGA|Księga|CZĘŚĆ|Część|DZIAŁ|Dział|ROZDZIAŁ|Rozdział|ODDZIAŁ|Oddział)\\s+([\\p{{L}}\\d]+)(\\s|\\.|$)', 1) AS k, regexp_extract(t, '^(KSIĘGA|Księga|CZĘŚĆ|Część|DZIAŁ|Dział|ROZDZIAŁ|Rozdział|ODDZIAŁ|Oddział)\\s+([\\p{{L}}\\d]+)(\\s|\\.|$)', 2) AS num FROM x),
    z AS (SELECT *, CASE WHEN regexp_matches(u, '^Art\\.\\s*{_N}\\.(\\s|$)') THEN 'article' WHEN regexp_matches(u, '^§\\s*{_N}\\.(\\s|$)') OR (prefix = '' AND regexp_matches(u, '^§\\s*{_N}$')) THEN 'paragraph'
        WHEN prefix = '' AND k <> '' AND (regexp_full_match(num, '[IVXLC]{{1,7}}[a-z]?') OR CASE WHEN upper(k) IN ('KSIĘGA', 'CZĘŚĆ') THEN lower(num) IN ('pierwsza', 'druga', 'trzecia') ELSE regexp_full_match(num, '\\d{{1,4}}[a-z]?') END)
        THEN CASE upper(k) WHEN 'KSIĘGA' THEN 'book' WHEN 'CZĘŚĆ' THEN 'part' WHEN 'DZIAŁ' THEN 'division' WHEN 'ROZDZIAŁ' THEN 'chapter' ELSE 'subchapter' END END AS kind FROM y)
    SELECT n, kind, CASE kind WHEN 'article' THEN 'Art. ' || regexp_extract(u, '{_N}') WHEN 'paragraph' THEN '§ ' || regexp_extract(u, '{_N}') ELSE k || ' ' || num END AS designation, CASE WHEN kind IN ('article', 'paragraph') THEN prefix ELSE '' END AS prefix FROM z WHERE kind IS NOT NULL""")
def e08_e09_legal_units(spark, sf):
    u = T.legal_unit(F.col("t"))
    return _rows(spark, sf, LINES, ["t"]).select("n", u.alias("u")).where("u IS NOT NULL").select("n", "u.kind", "u.designation", "u.prefix")


@query()
def e10_e11_list_labels(spark, sf):
    return _rows(spark, sf, LABELS, ["t"]).select("n", T.list_label(F.col("t")).alias("m")).where("m IS NOT NULL").select("n", "m.*")


_NU = "rtrim(regexp_replace(trim(regexp_replace(lower({}), '\\s+', ' ', 'g')), '\\.$', ''))"
@query(f"WITH x AS (SELECT n, {_NU.format('c')} AS c, {_NU.format('u')} AS u FROM {_literal(UNITS, ['c', 'u'])[1]}), y AS (SELECT *, regexp_extract(u, '^(\\d+(\\.\\d+)*)\\. ', 1) AS h FROM x) SELECT n, (u <> '' AND (c = u OR starts_with(c, u || ' ') OR starts_with(c, u || ','))) OR (h <> '' AND (c = h OR starts_with(c, h || ' ') OR starts_with(c, h || ','))) AS matches FROM y")
def e12_unit_match(spark, sf):
    return _rows(spark, sf, UNITS, ["c", "u"]).select("n", T.unit_matches(F.col("c"), F.col("u")).alias("matches"))


@query("SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^\\p{L}\\p{Nd}]+', ' ', 'g'))) AS normal, list_distinct(regexp_extract_all(text, '\\p{Nd}+')).len()::INTEGER AS n_numbers FROM documents")
def e13_e14_grounding_text(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.sha2(T.grounding_normal(t), 256).alias("normal"), F.size(F.array_distinct(T.numbers(t))).alias("n_numbers"))


@query()
def e15_list_label_strip(spark, sf):
    return _rows(spark, sf, [*LABELS, "zob. a) oraz 1/ i lit. b\\) tekst"], ["t"]).select("n", T.without_list_labels(F.col("t")).alias("plain"))


@query("SELECT conv_id, turn, rtrim(regexp_replace(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '[? ]+$', '')) AS question FROM conversations WHERE role = 'user'")
def e16_question_normal(spark, sf):
    return table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_normal(F.col("text")).alias("question"))


@query("SELECT doc_id, ceil(length(text) / 3.0)::INTEGER AS tokens FROM documents")
def e17_token_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, line_no, translate({SQ.format('lower(line)')}, '{T.ACCENTED}', '{T.PLAIN}') AS folded FROM {LINES_SQL}")
def e18_e19_fold(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "line_no", T.fold(F.col("line")).alias("folded"))


FORBIDDEN = ["license", "trash", "the", "token", "access token", "to-do", "Là"]


@query(f"""SELECT doc_id, w AS word FROM documents, (VALUES {', '.join(f"('{w}')" for w in FORBIDDEN)}) AS x(w)
    WHERE contains(' ' || regexp_replace(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ', ' ' || regexp_replace(translate(lower(w), '{T.ACCENTED}', '{T.PLAIN}'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' ')""")
def e20_g18_forbidden_words(spark, sf):
    return corpus.phrases_in(table(spark, sf, "documents"), "doc_id", "text", FORBIDDEN)


@query("SELECT o_orderkey, replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', ' '), '.', ','), ';', '') || ' zł' AS amount, day(o_orderdate) || ' ' || (['stycznia','lutego','marca','kwietnia','maja','czerwca','lipca','sierpnia','września','października','listopada','grudnia'])[month(o_orderdate)] || ' ' || year(o_orderdate) || ' r.' AS printed, CASE WHEN o_orderkey % 200 = 1 THEN 'dzień' WHEN o_orderkey % 200 % 10 BETWEEN 2 AND 4 AND o_orderkey % 200 % 100 NOT BETWEEN 12 AND 14 THEN 'dni' ELSE 'dniach' END AS noun FROM orders")
def e21_e22_polish_format(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", T.polish_amount(F.round("o_totalprice", 2)).alias("amount"), T.polish_date(F.col("o_orderdate")).alias("printed"), T.plural(F.col("o_orderkey") % 200, "dzień", "dni", "dniach").alias("noun"))


@query(f"SELECT n, regexp_extract(regexp_replace(t, '^[A-Z]{{6}}\\+', ''), '^([^-,]*)', 1) AS family, regexp_matches(lower(t), 'bold|black|heavy|semibold|demi') AS bold, regexp_matches(lower(t), 'italic|oblique|slanted|kursiv') AS italic FROM {_literal(FONTS, ['t'])[1]}")
def e23_fonts(spark, sf):
    bold, italic = T.font_style(F.col("t"))
    return _rows(spark, sf, FONTS, ["t"]).select("n", T.font_family(F.col("t")).alias("family"), bold.alias("bold"), italic.alias("italic"))


@query(f"SELECT n, regexp_replace(t, '-w\\d+$', '') AS base FROM {_literal(IDS, ['t'])[1]}")
def e24_version_suffix(spark, sf):
    return _rows(spark, sf, IDS, ["t"]).select("n", T.without_version(F.col("t")).alias("base"))


@query(f"SELECT n, CASE WHEN regexp_full_match(regexp_replace(trim(t), '\\.$', ''), '\\d+|[IVXLC]+') THEN 'sekcja ' ELSE '' END || regexp_replace(trim(t), '\\.$', '') AS label FROM {_literal(LABEL_UNITS, ['t'])[1]}")
def e25_unit_label(spark, sf):
    return _rows(spark, sf, LABEL_UNITS, ["t"]).select("n", T.unit_label(F.col("t")).alias("label"))


@query("""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(?:/.*)?/([^/]*)$', 1), '\\.[A-Za-z0-9]{1,5}$', ''), '^[-. ]+|[-. ]+$', '', 'g') AS s FROM pages),
    n AS (SELECT page_id, left(CASE WHEN s = '' THEN 'document' ELSE s END, 120) AS stem FROM s)
    SELECT page_id, stem || CASE WHEN row_number() OVER (PARTITION BY stem ORDER BY page_id) > 1 THEN '-' || row_number() OVER (PARTITION BY stem ORDER BY page_id) ELSE '' END AS file FROM n""")
def e26_file_names(spark, sf):
    n = F.row_number().over(Window.partitionBy("stem").orderBy("page_id"))
    return table(spark, sf, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem")).select("page_id", F.concat("stem", F.when(n > 1, F.concat(F.lit("-"), n)).otherwise("")).alias("file"))


_H = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1))"
@query(f"SELECT page_id, {_H} AS host, ({_H} IN ('example.com', 'example.org') OR {_H} LIKE '%.example.com' OR {_H} LIKE '%.example.org') AS allowed, CASE WHEN trim(url) = '' THEN 'empty' WHEN NOT regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+') THEN 'not-absolute' WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'scheme' WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]*@') THEN 'user-info' WHEN NOT ({_H} IN ('example.com', 'example.org') OR {_H} LIKE '%.example.com' OR {_H} LIKE '%.example.org') THEN 'host' WHEN row_number() OVER (PARTITION BY url ORDER BY page_id) > 1 THEN 'duplicate' END AS problem FROM pages")
def e27_e28_addresses(spark, sf):
    u = F.col("url")
    again = F.row_number().over(Window.partitionBy("url").orderBy("page_id")) > 1
    return table(spark, sf, "pages").select("page_id", T.host_of(u).alias("host"), T.host_allowed(u, ALLOWED).alias("allowed"), T.address_problem(u, ALLOWED, again).alias("problem"))


@query("SELECT conv_id, turn, '\"' || replace(replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted, replace(text, 'token', '***') AS safe FROM conversations")
def e30_e31_yaml_and_redaction(spark, sf):
    t = F.col("text")
    return table(spark, sf, "conversations").select("conv_id", "turn", T.yaml_quoted(t).alias("quoted"), T.redacted(t, [SECRET]).alias("safe"))


@query(f"SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(line, '([\\\\*_\\[\\]<>`|])', '\\\\\\1', 'g'), '^([#+\\-=])', '\\\\\\1'), '^(\\d+)([.)])', '\\1\\\\\\2') AS escaped FROM {LINES_SQL}")
def d04_escape(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "line_no", T.escape_markdown(F.col("line"), True, True).alias("escaped"))


@query("SELECT l_orderkey, l_linenumber, l_linenumber || '\\)' AS label FROM lineitem")
def d05_escape_label(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.escape_label(F.concat(F.col("l_linenumber").cast("string"), F.lit(")"))).alias("label"))


@query()
def g39_periods(spark, sf):
    return lines(table(spark, sf, "documents")).select("doc_id", "line_no", T.tidy_periods(F.col("line")).alias("tidy"))
