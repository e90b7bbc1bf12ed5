"""Word vectors learned from which words stand near each other in a corpus."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from panelforecast.functions.columns import tokens
from panelforecast.operators.joins import lookup_join
from panelforecast.operators.topics import vector_similarity
from panelforecast.sources.stages import lean_shuffles, stage
from panelforecast.sources.tables import fill_cores

# what runs inside tasks travels with them: executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Most frequent words that get a vector: it bounds what the driver and a broadcast hold.
VOCABULARY = 1 << 14
# Pairs that a task holds before they are added up and move, and texts that it pairs up at a time.
PAIRS_HELD, TEXTS_A_STEP = 1 << 23, 256
# Words are dealt to bands by the remainder of their number, so that the frequent ones, which come first, are
# spread. A band's counts are dense where they are added up; a strip of so many of its words is one row of a table.
BANDS, STRIP = 64, 32
WINDOW, DIMENSIONS, OVERSAMPLE, POWER_STEPS = 5, 50, 20, 2
_STRIPS = "band int, first int, lengths binary, b binary, n binary, own binary"


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, n)``: how often each word occurs."""
    return docs.select(F.explode(tokens(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(docs: DataFrame, text: str = "text", size: int = VOCABULARY, counts: DataFrame | None = None) -> DataFrame:
    """``(term, id)``: the ``size`` most frequent words, ties in the order of the alphabet, numbered from 0.

    ``counts`` are the texts' ``term_counts`` where they are known already.
    """
    counts = term_counts(docs, text) if counts is None else counts
    top = counts.orderBy(F.desc("n"), "term").limit(size).select("term").toPandas()["term"].tolist()
    return docs.sparkSession.createDataFrame([(t, i) for i, t in enumerate(top)], "term string, id int")


def word_ids(words: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a column of word lists: every word's place among the terms, -1 for others, and where each list starts and the last one ends."""
    ids = pc.fill_null(pc.index_in(words.flatten(), value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))])


def _narrow(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def _as_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["band", "first", "lengths", "b", "n", "own"])


def _of_rows(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Band, first word of the strip, and its pairs: the words' places in the strip, the other words, the counts."""
    for i in range(batch.num_rows):
        band, first = batch.column("band")[i].as_py(), batch.column("first")[i].as_py()
        lengths, b, n = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("lengths", np.int32), ("b", _narrow(size)), ("n", np.int64)))
        yield band, first, np.repeat(np.arange(len(lengths)), lengths), b, n


def _filed(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int) -> pa.RecordBatch:
    """A row for every band that has some of the pairs, as its words' number of pairs, the other words and the counts."""
    rows = -(-size // BANDS)
    key = (a % BANDS * rows + a // BANDS).astype(_narrow(BANDS * rows))
    order = np.argsort(key, kind="stable")
    lengths = np.bincount(key, minlength=BANDS * rows).astype(np.int32).reshape(BANDS, rows)
    ends, b, n = np.cumsum(lengths.sum(axis=1)), b[order].astype(_narrow(size)), n[order]
    cuts = [(k, slice(ends[k - 1] if k else 0, ends[k])) for k in np.flatnonzero(lengths.any(axis=1)).tolist()]
    return _as_rows([(k, 0, lengths[k].tobytes(), b[c].tobytes(), n[c].tobytes(), None) for k, c in cuts])


def _added_up(filed: DataFrame, size: int) -> DataFrame:
    """The counts of all rows of a band together, in strips with their words' sums; a task holds one band, dense."""
    rows = -(-size // BANDS)

    def strips(band: int, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first in range(0, rows, STRIP):
            some = total[first : first + STRIP]
            a, b = np.nonzero(some)
            lengths = np.bincount(a, minlength=len(some)).astype(np.int32)
            yield _as_rows([(band, first, lengths.tobytes(), b.astype(_narrow(size)).tobytes(), some[a, b].tobytes(), some.sum(axis=1).tobytes())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros((rows, size), np.int64)
        for batch in batches:
            for band, first, a, b, n in _of_rows(batch, size):
                if band != at and at is not None:
                    yield from strips(at, total)
                    total[:] = 0
                at = band
                total[first + a, b] += n  # a row has a pair once
        if at is not None:
            yield from strips(at, total)

    return filed.repartition(BANDS, "band").sortWithinPartitions("band").mapInArrow(add, _STRIPS)


def pair_strips(docs: DataFrame, terms: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """How often two words of the vocabulary stand at most ``window`` words apart, in either order, in strips of the smaller word.

    A word meets the words after it, so pairs grow with the text and not with its square. Tasks add
    up ``PAIRS_HELD`` pairs at a time, and what moves is a row for each band with three bytes or so a pair.
    """
    listed = terms.orderBy("id").toArrow()
    known, size = listed.column("term").combine_chunks(), max(listed.num_rows, 1)
    kind = np.int32 if size * size < 1 << 31 else np.int64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def added() -> pa.RecordBatch:
            codes = np.concatenate(waiting or [np.zeros(0, kind)])
            waiting.clear()
            codes.sort()
            starts = np.flatnonzero(np.diff(codes, prepend=codes.dtype.type(-1)))
            n = np.diff(starts, append=len(codes))
            lo, hi = np.divmod(codes[starts], codes.dtype.type(size))
            return _filed(lo, hi, n, size)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_A_STEP):
                ids, starts = word_ids(batch.column("w").slice(at, TEXTS_A_STEP), known)
                ids, own = ids.astype(kind), np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(starts))
                for apart in range(1, min(window, max(len(ids) - 1, 0)) + 1):
                    a, b = ids[:-apart], ids[apart:]
                    met = (own[:-apart] == own[apart:]) & (a >= 0) & (b >= 0)
                    a, b = a[met], b[met]
                    waiting.append(np.minimum(a, b) * kind(size) + np.maximum(a, b))
                if sum(map(len, waiting)) >= PAIRS_HELD:
                    yield added()
        yield added()

    words = docs.select(tokens(F.col(text)).alias("w")).where(F.size("w") > 1)
    return _added_up(words.mapInArrow(count, _STRIPS), size)


def both_ways(strips: DataFrame, size: int) -> DataFrame:
    """The same counts with every pair under either word; a word beside itself counts for either place.

    No more than the vocabulary's square moves, however long the texts are.
    """

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, first, a, b, n in _of_rows(batch, size):
                a, b = (first + a) * BANDS + band, b.astype(np.int64)
                yield _filed(a, b, n, size)
                yield _filed(b, a, n, size)  # a pair of one word comes twice, as it should

    return _added_up(strips.mapInArrow(turn, _STRIPS), size)


def _listed(strips: DataFrame, size: int, a: str, b: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for band, first, x, y, n in _of_rows(batch, size):
                x = ((first + x) * BANDS + band).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y.astype(np.int32)), pa.array(n)], [a, b, "n"])

    return strips.mapInArrow(rows, f"{a} int, {b} int, n long")


def pair_counts(docs: DataFrame, terms: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(lo, hi, n)``: the counts of ``pair_strips``, a row each."""
    return _listed(pair_strips(docs, terms, text, window), max(terms.count(), 1), "lo", "hi")


def cooccurrences(docs: DataFrame, terms: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``(a, b, n)``: how often two words of the vocabulary stand at most ``window`` words apart, both ways round."""
    size = max(terms.count(), 1)
    return _listed(both_ways(stage(pair_strips(docs, terms, text, window), "pair-counts"), size), size, "a", "b")


def word_totals(counts: DataFrame, size: int) -> np.ndarray:
    """The sum of every word's counts, by its number."""
    rows, out = -(-size // BANDS), np.zeros(-(-size // BANDS) * BANDS)
    for r in counts.select("band", "first", "own").toLocalIterator():
        own = np.frombuffer(r.own, np.int64)
        out[(r.first + np.arange(len(own))) * BANDS + r.band] = own
    return out[:size] if rows else out


def _times(counts: DataFrame, own: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Positive PMI, ln(n N / (n_a n_b)) where it is above zero, times ``x``.

    A strip has its words' whole rows, so that its lines of the product are whole as well and nothing is
    shuffled. It is multiplied as a dense one: a step costs no more than the vocabulary's square, however full it is.
    """
    size, width = x.shape
    total = own.sum()
    # sent once and taken back: a closure of this size would leave a file on every executor for each step
    sent = counts.sparkSession.sparkContext.broadcast((own, x))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, x = sent.value
        dense = np.zeros((STRIP, size))
        for batch in batches:
            for band, first, a, b, n in _of_rows(batch, size):
                ids = np.arange((first * BANDS) + band, size, BANDS)[:STRIP]
                dense[:] = 0
                dense[a, b] = np.maximum(np.log(n * total / (own[ids][a] * own[b])), 0) if len(n) else 0
                product = (dense @ x)[: len(ids)]
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * width), pa.array(product.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), listed], ["a", "line"])

    found = counts.select("band", "first", "lengths", "b", "n").mapInArrow(lines, "a int, line array<double>").toArrow()
    sent.destroy(blocking=True)
    out = np.zeros_like(x)
    if found.num_rows:
        out[found.column("a").to_numpy()] = found.column("line").combine_chunks().flatten().to_numpy().reshape(-1, width)
    return out


def leading_vectors(counts: DataFrame, size: int, dimensions: int = DIMENSIONS, seed: int = 69) -> np.ndarray:
    """Of the positive PMI of counts in strips, both ways round: left singular vectors times the roots of the singular values, by a randomised range finder with power steps.

    ``size`` x (``dimensions`` + 20) numbers are on the driver and in a task at a time; the matrix
    is read once a step. The matrix is symmetric, so singular values are sizes of eigenvalues.
    """
    own = word_totals(counts, size)
    x = np.random.default_rng(seed).standard_normal((size, min(size, dimensions + OVERSAMPLE)))
    for _ in range(1 + POWER_STEPS):
        x = np.linalg.qr(_times(counts, own, x))[0]
    small = x.T @ _times(counts, own, x)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    first = np.argsort(-np.abs(values), kind="stable")[:dimensions]
    return x @ turn[:, first] * np.sqrt(np.abs(values[first]))


def word_vectors(docs: DataFrame, text: str = "text", dimensions: int = DIMENSIONS, window: int = WINDOW, size: int = VOCABULARY, seed: int = 69, counts: DataFrame | None = None) -> DataFrame:
    """``(term, vector)``: words that stand near the same words have vectors that point the same way.

    Null and empty texts have no words; without words the table is empty. ``counts`` are the texts'
    ``term_counts`` where they are known, so that the texts are read once less.
    """
    with lean_shuffles(docs.sparkSession):
        return _word_vectors(docs, text, dimensions, window, size, seed, counts)


def _word_vectors(docs: DataFrame, text: str, dimensions: int, window: int, size: int, seed: int, counts: DataFrame | None) -> DataFrame:
    docs = fill_cores(docs.select(F.col(text).alias("text")))
    terms = stage(vocabulary(docs, "text", size, counts), "vocabulary")
    named = {r.id: r.term for r in terms.collect()}
    schema = "term string, vector array<double>"
    if not named:
        return docs.sparkSession.createDataFrame([], schema)
    pairs = stage(pair_strips(docs, terms, "text", window), "pair-counts")
    vectors = leading_vectors(stage(both_ways(pairs, len(named)), "cooccurrences"), len(named), dimensions, seed)
    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(named) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()))
    return docs.sparkSession.createDataFrame(pa.table({"term": pa.array([named[i] for i in range(len(named))]), "vector": listed}))


def context_similarity(weights: DataFrame, vectors: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``(keyword, topic, similarity)``: cosine of topics with keywords in the space of the word vectors.

    A topic is the weighted mean of its terms' vectors, a keyword the sum of its words'; so a keyword
    finds topics that do not hold it. A keyword without a known word has no row, nor has a topic without a known term.
    """
    vectors = stage(vectors, "word-vectors")
    joined = lookup_join(weights.select("topic", "term", "weight"), vectors, "term", "inner", spread_by="topic")
    rows = joined.select("topic", "weight", array_to_vector("vector").alias("_v"))
    centres = rows.groupBy("topic").agg(vector_to_array(Summarizer.mean(F.col("_v"), F.col("weight"))).alias("centre"))
    words = [(k, w) for k in dict.fromkeys(keywords) for w in sorted(set(re.findall(r"\w{2,}", k.lower())))]
    asked = vectors.sparkSession.createDataFrame(words, "keyword string, term string")
    found = asked.join(vectors, "term").select("keyword", array_to_vector("vector").alias("_v"))
    asked = found.groupBy("keyword").agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("vector"))
    return vector_similarity(asked, centres, "keyword", "vector")
