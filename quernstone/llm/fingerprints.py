"""One-permutation MinHash document fingerprints, in DataFrame functions alone.

Words are lower-cased runs of non-space; a shingle is five words (fewer: the whole sequence; none: no shingle). Every
shingle is hashed once. The hash's top bits name one of BINS bins, the rest is its value; sorting the hashes of a text
leaves each bin's minimum first among its own. Empty bins are filled by optimal densification: bin j tries the bins of
its own fixed pseudo-random probe sequence and copies the first that holds a value. After PROBES tries (only texts with
few shingles get so far) the rest of the sequence is settled in one step by the smallest pair hash over the filled bins,
which picks uniformly as the probes do. The low four bits of each bin are packed as one hex digit. Two unrelated bins
agree in one case of sixteen, so likeness = (agreement - 1/16) / (1 - 1/16), not below 0.

Defined results: null text counts as empty; a text without words has the all-zero fingerprint of its own kind (every
digit "0") and equals others of that kind; equal texts have equal fingerprints; repeated rows give repeated results; rows of equal
doc_id are ordered by text, null ids come first; other columns are ignored.

The next document by ascending doc_id is found without a global window: rows are grouped by ranges of ids, of equal width
and of some SPAN rows each (ids may be dense or spread over all longs), and a group gets the first document of the next group as a ghost row. The order of groups is found the
same way over the groups' first ids, so the single-task window at the top sees one row per SPAN squared documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

BINS = 256
WORDS = 5
PROBES = 5
SPAN = 1024
DIGITS = 16
#: Up to so many group heads (two numbers each) are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingle_hashes(words: Column, n: int = WORDS) -> Column:
    """Sorted hashes of the word shingles."""
    many = F.sort_array(F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.xxhash64(F.slice(words, i, n))))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < n, F.array(F.xxhash64(words))).otherwise(many)


def _bin(h: Column) -> Column:
    """0 to BINS - 1, rising with the signed order of hashes."""
    return F.shiftright(h, 56).cast("int") + 128


def _digit(h: Column) -> Column:
    return F.lower(F.hex(h.bitwiseAND(F.lit(DIGITS - 1))))


def with_fingerprint(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Adds the hex fingerprint of a text column."""
    df = df.withColumn("_w", words_of(F.col(text_col))).withColumn("_h", shingle_hashes(F.col("_w"))).drop("_w")
    first = F.filter("_h", lambda h, i: (i == 0) | (_bin(h) != _bin(F.get("_h", i - 1))))
    df = df.withColumn("_m", first).drop("_h")
    before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_bin(F.get("_m", i - 1)))
    placed = F.transform("_m", lambda h, i: F.concat(F.repeat(F.lit("."), _bin(h) - before(i) - 1), _digit(h)))
    df = df.withColumn("_s", F.rpad(F.array_join(placed, ""), BINS, ".")).withColumn("_c", F.split("_s", ""))
    probes = lambda j: [F.nullif(F.get("_c", F.pmod(F.hash(j, F.lit(t)), F.lit(BINS))), F.lit(".")) for t in range(PROBES)]
    rest = lambda j: F.array_min(F.transform("_m", lambda h: F.struct(F.hash(j, _bin(h)).alias("k"), _digit(h).alias("v")))).getField("v")
    dense = F.transform("_c", lambda c, j: F.when(c != ".", c).otherwise(F.coalesce(*probes(j), rest(j))))
    found = F.when(F.size("_m") == 0, F.repeat(F.lit("0"), BINS)).when(F.instr("_s", ".") == 0, F.col("_s")).otherwise(F.array_join(dense, ""))
    return df.withColumn(out_col, found).drop("_m", "_s", "_c")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two fingerprints, corrected for chance agreement."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda hit: hit))
    return F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - 1 / DIGITS) / (1 - 1 / DIGITS))


def span_of(docs: DataFrame, id_col: str = "doc_id") -> int:
    """Width of a group's range of ids: SPAN for dense ids, so much more for sparse ones that a group has some SPAN rows."""
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count(id_col)).first()
    return SPAN if not n else min(1 << 62, max(SPAN, (high - low) // -(-n // SPAN) + 1))


def with_next(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Adds _group and ghost rows (_ghost = 1) so that lead() over a group meets every row's successor."""
    span = span_of(docs, id_col)
    docs = docs.withColumn("_group", F.expr(f"`{id_col}` div {span}"))
    first = docs.groupBy("_group").agg(F.min(id_col).alias("_first")).withColumn("_super", F.expr(f"_group div {SPAN}"))
    first = checkpointed(first)
    whole = Window.orderBy(F.col("_super").asc_nulls_first())
    after = first.groupBy("_super").agg(F.min("_group").alias("_least")).select(
        F.col("_super").alias("_of_super"), F.lead("_least").over(whole).alias("_after"), F.lead(F.lit(1)).over(whole).alias("_has"), F.first("_least").over(whole).alias("_begin")
    )
    inside = Window.partitionBy("_super").orderBy(F.col("_group").asc_nulls_first())
    order = first.select("_group", "_super", F.lead("_group").over(inside).alias("_next"), F.lead(F.lit(1)).over(inside).alias("_more"))
    order = order.join(after, order["_super"].eqNullSafe(after["_of_super"])).select(
        F.col("_group").alias("_prev"), F.when(F.col("_more") == 1, F.col("_next")).when(F.col("_has") == 1, F.col("_after")).otherwise(F.col("_begin")).alias("_of")
    )
    heads = checkpointed(first.join(order, first["_group"].eqNullSafe(order["_of"])).select("_first", "_prev"))
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    ghosts = docs.drop("_group").join(heads, docs[id_col].eqNullSafe(heads["_first"])).drop("_first").withColumnRenamed("_prev", "_group").withColumn("_ghost", F.lit(1))
    return docs.withColumn("_ghost", F.lit(0)).unionByName(ghosts)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text, of its edited form and their likeness, and the likeness to the next document.

    The edited text has its last quarter (rounded down) replaced by as many first characters, or all, of the next document.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(docs).withColumn("_tie", F.xxhash64("text"))
    order = Window.partitionBy("_group").orderBy("_ghost", F.col("doc_id").asc_nulls_first(), "_tie")
    rows = rows.withColumn("_following", F.lead("text").over(order)).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - tail), F.substring(F.col("_following"), F.lit(1), tail))
    rows = rows.withColumn("_edited", F.when(F.col("_ghost") == 0, edited).otherwise("")).drop("_following")
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint").drop("text"), "_edited", "edited_fingerprint")
    rows = rows.withColumn("edited_sha256", F.sha2("_edited", 256)).drop("_edited").withColumn("_next_fp", F.lead("fingerprint").over(order)).where("_ghost = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("_next_fp")).alias("near_next"))
