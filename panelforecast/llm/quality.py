"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.llm.common import fitting_rows, slices
from panelforecast.sources.stages import stage

FIT_ROWS = 20_000
TREES = 60
DEPTH = 5
BINS = 64
RATE = 0.15
L2 = 1.0
LEAST_ROWS = 10
STATISTICS = (
    "log_chars", "log_words", "word_length", "longest_word", "upper", "digits", "bars", "exclaims", "symbols", "other_marks",
    "beyond_ascii", "distinct_words", "top_word", "repeated_neighbours", "distinct_triples", "lines_per_word", "distinct_lines",
    "longest_line", "ended_words", "capital_words", "short_words",
)
_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*+<=>@\\^_{}~"
_OTHER = b"\"'(),-./:;?[]`"


def statistics(text: str | None) -> list[float]:
    """The numbers named in ``STATISTICS``, of the whole text; all zero for a null or empty one."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    raw = text.encode(errors="replace")
    size, n = len(raw), len(words)

    def share(marks: bytes) -> float:
        return (size - len(raw.translate(None, marks))) / size

    lengths = list(map(len, words))
    lines = text.split("\n")
    counts = Counter(words)
    return [
        np.log1p(len(text)), np.log1p(n), sum(lengths) / n, np.log1p(max(lengths)), share(_UPPER), share(_DIGITS), share(b"|"), share(b"!"),
        share(_SYMBOLS), share(_OTHER), (size - len(text)) / size, len(counts) / n, max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:], words[2:]))) / max(1, n - 2), len(lines) / n,
        len(set(lines)) / len(lines), np.log1p(max(map(len, lines))), sum(w[-1] in ".,!?;:" for w in words) / n,
        sum(map(str.isupper, words)) / n, sum(k <= 2 for k in lengths) / n,
    ]


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, statistics)``: one array of numbers for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                values = [statistics(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(values, pa.list_(pa.float64()))], ["id", "statistics"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, statistics array<double>")
    return out.withColumnRenamed("id", id_column)


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Boosted trees for the logistic loss, as flat arrays: of every tree the features and
    cut values of a complete binary tree level by level, and the values of its leaves.

    Every feature is cut into at most ``BINS`` bins of equal rows; a level's sums of
    gradients by node, feature and bin are one count over all rows. Without rows or with
    one class only, the model is that class's share.
    """
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = {"start": float(np.log(share / (1 - share))), "feature": np.zeros((0, inner), np.int64), "cut": np.zeros((0, inner)), "leaf": np.zeros((0, leaves))}
    if not len(y) or y.min() == y.max():
        return model
    rows, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    cell = binned + np.arange(width) * BINS
    allowed = np.zeros((width, BINS), bool)
    for f, c in enumerate(cuts):
        allowed[f, : len(c)] = True
    score = np.full(rows, model["start"])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        gradient, weight = y - p, p * (1 - p)
        node, feature, cut = np.zeros(rows, np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            count = 1 << level
            at = ((node - (count - 1)) * width * BINS)[:, None] + cell
            shape = (count, width, BINS)
            g = np.bincount(at.ravel(), np.repeat(gradient, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            h = np.bincount(at.ravel(), np.repeat(weight, width), count * width * BINS).reshape(shape).cumsum(axis=2)
            k = np.bincount(at.ravel(), minlength=count * width * BINS).reshape(shape).cumsum(axis=2)
            all_g, all_h, all_k = g[:, :1, -1:], h[:, :1, -1:], k[:, :1, -1:]
            gain = g**2 / (h + L2) + (all_g - g) ** 2 / (all_h - h + L2) - all_g**2 / (all_h + L2)
            gain[~((k >= LEAST_ROWS) & (all_k - k >= LEAST_ROWS) & allowed)] = -np.inf
            best = gain.reshape(count, -1).argmax(axis=1)
            good = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            for j in np.flatnonzero(good):
                f, b = divmod(int(best[j]), BINS)
                feature[count - 1 + j], cut[count - 1 + j] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(rows), feature[node]] > cut[node])
        leaf = node - inner
        value = RATE * np.bincount(leaf, gradient, leaves) / (np.bincount(leaf, weight, leaves) + L2)
        score = score + value[leaf]
        model["feature"] = np.vstack((model["feature"], feature))
        model["cut"] = np.vstack((model["cut"], cut))
        model["leaf"] = np.vstack((model["leaf"], value))
    return model


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    """Of label 1, for all rows at once: one array step a level of a tree."""
    score = np.full(len(x), model["start"])
    at = np.arange(len(x))
    inner = model["feature"].shape[1]
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), np.int64)
        while len(x) and node[0] < inner:  # complete trees: all rows are on the same level
            node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
        score += leaf[node - inner]
    return 1 / (1 + np.exp(-score))


def train(stats: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", label_column: str = "quality", fit_rows: int = FIT_ROWS) -> dict:
    """Fit on at most ``fit_rows`` labelled rows, the first by a hash of their id.

    What comes to the driver is that many rows of ``len(STATISTICS)`` numbers. Null labels
    and ids with contradicting labels teach nothing, repeated labels count once.
    """
    known = labels.where(usable & F.col(label_column).isNotNull()).groupBy(id_column).agg(
        F.min(label_column).alias("y"), F.max(label_column).alias("other")
    )
    rows = stats.join(known.where("y = other"), id_column).select(F.xxhash64(F.col(id_column).cast("string")).alias("h"), F.col("y").cast("double").alias("y"), "statistics")
    chosen = fitting_rows(rows, fit_rows)
    x = np.array([r.statistics for r in chosen], dtype=np.float64).reshape(-1, len(STATISTICS))
    return fit(x, np.array([r.y for r in chosen], dtype=np.float64))


def score(stats: DataFrame, model: dict, id_column: str = "doc_id") -> DataFrame:
    """``(id, score)``: the probability of label 1 for every row of statistics."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("statistics").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(probability(shared.value, x))], ["id", "score"])

    rows = stats.select(F.col(id_column).alias("id"), "statistics")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_column)


def classify(docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """``(id, score, predicted)`` for every row of ``docs``, learned from the usable labels.

    Texts are read once; their statistics are a table in the shared folder. Null and
    empty texts are scored as a text of zeros. Repeated rows are scored each. Without
    labels every score is one half.
    """
    stats = stage(document_statistics(docs, id_column, text_column), "document-statistics")
    scored = score(stats, train(stats, labels, usable, id_column, label_column), id_column)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
