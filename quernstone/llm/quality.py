"""Quality classifier from weak labels.

Six heuristic labellers vote good, bad or nothing on every document. Expectation-maximisation estimates each labeller's
class-conditional accuracies and the class balance without any true label; no vote counts as missing. Its sufficient statistic is the count
of every vote pattern over all documents, of which there are at most 3^6 whatever the size of the corpus, so the counts
are exact and the fit runs on the driver. The posteriors label a linear scorer over 2^16 hashed features (byte trigrams
and bucketed shape features), fitted on the TRAIN_ROWS documents with the smallest hash of id and text (a documented bound; rows that agree in both are one);
it then scores every document from its whole text.

Defined results: null text counts as empty; a document without words gets no votes and is scored like any other by its
shape features; repeated rows give repeated results; null ids are kept and not used for fitting; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, utf8

TRAIN_ROWS = 3000
BUCKETS = 1 << 16
GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "variety", "word_length", "function_words", "line_repeats", "word_repeats")
#: Frequent function words of the four languages.
FUNCTION_WORDS = frozenset(b"the of and to in is that for it with as was le la les de des et un une du en que der die das und den von zu mit ist el los las y un una por con del".split())
SYMBOLS = b"#$%&*|@^~<>{}[]\\=+_"
TRIGRAM_SCALE = 30.0


def shape(text: bytes) -> tuple[float, ...]:
    """words, symbol share, distinct share, mean word length, function-word share, repeated-line share, repeated-neighbour share."""
    w = text.lower().split()
    n = len(w)
    if not n:
        return 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0
    lines = text.split(b"\n")
    return (
        n, (len(text) - len(text.translate(None, SYMBOLS))) / len(text), len({*w}) / n, sum(map(len, w)) / n, sum(x in FUNCTION_WORDS for x in w) / n,
        1 - len({*lines}) / len(lines), sum(map(bytes.__eq__, w[1:], w)) / n,
    )


def votes(s: tuple[float, ...]) -> int:
    """The labellers' votes as one number in base 3."""
    n, sym, distinct, length, function, lines, again = s
    if not n:
        each = [NONE] * 6
    else:
        each = [
            BAD if sym > 0.02 else GOOD if sym < 0.002 else NONE,
            (BAD if distinct < 0.4 else GOOD if distinct < 0.97 else NONE) if n >= 40 else NONE,
            BAD if length > 7.2 or length < 2.5 else GOOD if 3.5 <= length <= 6.4 else NONE,
            (BAD if function < 0.02 else GOOD if function > 0.06 else NONE) if n >= 15 else NONE,
            (BAD if lines > 0.3 else GOOD if lines < 0.1 else NONE) if n >= 40 else NONE,
            (BAD if again > 0.15 else GOOD if again < 0.05 else NONE) if n >= 10 else NONE,
        ]
    return sum(v * 3**i for i, v in enumerate(each))


def features(text: bytes, s: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, value) of the hashed features."""
    steps = ((1, 5, 15, 40, 150), (0.001, 0.01, 0.03, 0.1), (0.1, 0.2, 0.4, 0.6, 0.95), (2.5, 3.5, 6.4, 7.2), (0.005, 0.02, 0.06, 0.15), (0.01, 0.1, 0.3), (0.01, 0.05, 0.15, 0.5))
    own = np.array([(i * 64 + int(np.searchsorted(t, v, side="right"))) * 2654435761 % BUCKETS for i, (t, v) in enumerate(zip(steps, s, strict=True))])
    b = np.frombuffer(text.lower(), np.uint8).astype(U64)
    if len(b) < 3:
        return own, np.ones(len(own))
    grams = (((b[:-2] << U64(16)) | (b[1:-1] << U64(8)) | b[2:]) * U64(0x9E3779B97F4A7C15)) >> U64(48)
    count = np.bincount(grams.astype(np.int64), minlength=BUCKETS)
    at = np.flatnonzero(count)
    return np.concatenate((own, at)), np.concatenate((np.ones(len(own)), count[at] * (TRIGRAM_SCALE / len(grams))))


def patterns(docs: DataFrame) -> DataFrame:
    """(pattern, n) over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([votes(shape(t)) for t in utf8(b.column(0))], pa.int32())], ["pattern"])

    return docs.select("text").mapInArrow(run, "pattern int").groupBy("pattern").agg(F.count("*").alias("n"))


def expectation_maximisation(counts: dict[int, int], rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, P(vote | class) by labeller, class and vote, posterior of good by pattern)."""
    m = len(LABELLERS)
    codes = np.arange(3**m)
    vote = (codes[:, None] // 3 ** np.arange(m)[None, :]) % 3
    n = np.zeros(3**m)
    for k, c in counts.items():
        n[k] = c
    good, bad = (vote == GOOD).sum(1), (vote == BAD).sum(1)
    posterior = (good + 1.0) / (good + bad + 2.0)  # majority vote to begin with; orients the classes
    prior, table = 0.5, np.full((m, 2, 3), 1 / 3)
    for _ in range(rounds):
        w = np.stack(((1 - posterior) * n, posterior * n))
        prior = (w[1].sum() + 1) / (w.sum() + 2)
        for i in range(m):
            table[i] = np.stack([np.bincount(vote[:, i], w[c], 3) + 0.5 for c in (0, 1)])
            table[i] /= table[i, :, :NONE].sum(axis=1, keepdims=True)
        table[:, :, NONE] = 1  # no vote says nothing of the class: short texts get few votes
        like = np.stack([np.log(table[np.arange(m), c, vote]).sum(axis=1) for c in (0, 1)])
        posterior = 1 / (1 + np.exp(np.clip(like[0] + np.log(1 - prior) - like[1] - np.log(prior), -50, 50)))
    return float(prior), table, posterior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, steps: int = 200, rate: float = 0.6, decay: float = 1e-4) -> np.ndarray:
    """Weights of the buckets and, last, the bias: logistic loss on soft labels, AdaGrad over the whole sample."""
    w, past = np.zeros(BUCKETS + 1), np.full(BUCKETS + 1, 1e-6)
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows])
    value = np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    for _ in range(steps):
        z = np.bincount(row, w[at] * value, len(rows)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        grad = np.append(np.bincount(at, err[row] * value, BUCKETS), err.sum()) + decay * w / len(rows)
        past += grad**2
        w -= rate * grad / np.sqrt(past)
    return w


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, posterior by pattern, vote probabilities) from the documents alone."""
    counts = {r.pattern: r.n for r in patterns(docs).collect()}  # 3^6 rows at most
    _, table, posterior = expectation_maximisation(counts)
    marked = docs.where("doc_id IS NOT NULL").withColumn("_order", F.xxhash64("doc_id", "text"))
    chosen = marked.select("_order").orderBy("_order").limit(train_rows).distinct()  # train_rows numbers at most
    sample = marked.join(F.broadcast(chosen), "_order", "left_semi").dropDuplicates(["_order"]).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(votes(s := shape(t)), *features(t, s)) for t in utf8(b.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in found], pa.int32()), pa.array([x[1].astype(np.int32).tobytes() for x in found], pa.binary()), pa.array([x[2].astype(np.float32).tobytes() for x in found], pa.binary())],
                ["pattern", "at", "value"],
            )

    got = sorted((r.pattern, bytes(r["at"]), bytes(r["value"])) for r in sample.mapInArrow(run, "pattern int, at binary, value binary").collect())
    rows = [(np.frombuffer(a, np.int32).astype(np.int64), np.frombuffer(v, np.float32).astype(np.float64)) for _, a, v in got]
    return fit_scorer(rows, posterior[[p for p, _, _ in got]] if got else np.zeros(0)), posterior, table


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, keep) for every document."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = scorer(docs, train_rows, threshold)
    return docs.mapInArrow(run, "doc_id long, " + schema)


def scorer(docs: DataFrame, train_rows: int, threshold: float):
    weights, posterior, _ = train(docs, train_rows)
    light = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = light.astype(np.float64)
        for b in batches:
            soft, score = [], []
            for t in utf8(b.column(b.num_columns - 1)):
                s = shape(t)
                at, value = features(t, s)
                soft.append(float(posterior[votes(s)]))
                score.append(float(1 / (1 + np.exp(-np.clip(w[at] @ value + w[-1], -50, 50)))))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(soft, pa.float64()), pa.array(score, pa.float64()), pa.array([x >= threshold for x in score], pa.bool_())], [*b.schema.names[:-1], "posterior", "score", "keep"])

    return run, "posterior double, score double, keep boolean"


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, all columns, scored in one pass over their own rows."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    run, schema = scorer(plain, train_rows, threshold)
    fields = docs.schema.fields
    marked = docs.select(*docs.columns, F.col(text_col).alias("_scored")).toDF(*[f"c{i}" for i in range(len(fields))], "_scored")
    head = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    return marked.mapInArrow(run, f"{head}, {schema}").where("keep").select(*[F.col(f"c{i}").alias(f.name) for i, f in enumerate(fields)])
