"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelforecast.llm.common import mix, slices
from panelforecast.sources.stages import stage

SAMPLES = 128
SEED = 9
KNOWN_TERMS = 100_000
AT_ONCE = 512
_LOW_31 = np.uint64(0x7FFFFFFF7FFFFFFF)
_HALF = np.float32(0.5)
_LOG_SCALE = np.float32(62 * np.log(2.0))  # of two draws


def gamma_table(bits: int = 16) -> np.ndarray:
    """The gamma(2, 1) distribution as equally likely values, by halving its distribution function 1 - (1 + x) exp(-x)."""
    wanted = (np.arange(1 << bits) + 0.5) / (1 << bits)
    low, high = np.zeros(1 << bits), np.full(1 << bits, 64.0)
    for _ in range(50):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < wanted
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high.astype(np.float32)


def samples_of(keys: np.ndarray, weights: np.ndarray, samples: int, gamma: np.ndarray) -> np.ndarray:
    """For every term and sample its value ``a``; a document's sample is the term with the smallest.

    r and c are gamma(2, 1), b uniform, all from the term's hash: r one of the equally
    likely values of ``gamma``, c the sum of two exponential draws. With
    t = floor(ln w / r + b) and y = exp(r (t - b)), a = c / (y exp(r)); here is ln a.
    Two documents have the same term and t at the smallest value with a probability of
    exactly their generalised Jaccard similarity, the sum of smaller over the sum of
    larger weights. What is returned holds ln a to a thousandth in its upper 16 bits and
    a mark of the term and t in its lower 16, which also settles ties: the least value
    carries its own mark.
    """
    lane = mix(np.arange(samples, dtype=np.uint64) + np.uint64(1000 * SEED))
    bits = mix(keys[:, None] ^ lane[None, :])
    halves = (bits & _LOW_31).view(np.int32)  # both halves of every word, without their signs
    product = (halves[:, 0::2].astype(np.float32) + _HALF) * (halves[:, 1::2].astype(np.float32) + _HALF)
    a = np.log(_LOG_SCALE - np.log(product))
    bits *= np.uint64(0x9E3779B97F4A7C15)
    bits ^= bits >> np.uint64(29)
    quarters = bits.view(np.uint16)
    r = gamma[quarters[:, 0::4]]
    b = (quarters[:, 1::4].astype(np.float32) + _HALF) * np.float32(2.0**-16)
    mark = quarters[:, 3::4].astype(np.uint32)
    heavy = np.flatnonzero(weights > 1)  # of a weight of 1 t is always 0
    if len(heavy):
        t = np.floor(np.log(weights[heavy].astype(np.float32))[:, None] / r[heavy] + b[heavy])
        a[heavy] -= r[heavy] * t
        turned = (bits[heavy] ^ (t.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0x9E3779B97F4A7C15)
        mark[heavy] = np.where(t > 0, (turned >> np.uint64(48)).astype(np.uint32), mark[heavy])
    a += r * (b - 1)
    steps = np.clip((a + np.float32(48)) * np.float32(1024), 0, 65535).astype(np.uint32)  # of ln a from -48 to 16
    return steps << np.uint32(16) | mark


class Sampler:
    """Fingerprints of texts; the values of terms already met in the task are looked up."""

    def __init__(self, samples: int = SAMPLES):
        self.samples = samples
        self.known: dict[bytes | tuple[bytes, int], int] = {}
        self.values = np.empty((0, samples), np.uint32)
        self.room = np.empty((1024, samples), np.uint32)
        self.gamma = gamma_table()

    def fingerprints(self, texts: list[bytes]) -> list[bytes]:
        """Two bytes a sample. A text without words has the empty fingerprint."""
        if len(self.known) > KNOWN_TERMS:
            self.known, self.values = {}, self.values[:0]
        # a term is a word with its count, a count of 1 left out
        bags = [[word if n == 1 else (word, n) for word, n in Counter(t.split()).items()] for t in texts]
        new = [term for term in dict.fromkeys(term for bag in bags for term in bag) if term not in self.known]
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        if new:
            words = [term if type(term) is bytes else term[0] for term in new]
            keys = np.fromiter((xxhash.xxh64_intdigest(word, SEED) for word in words), np.uint64, len(new))
            weights = np.array([1 if type(term) is bytes else term[1] for term in new], np.float64)
            parts = [samples_of(keys[i : i + AT_ONCE], weights[i : i + AT_ONCE], self.samples, self.gamma) for i in range(0, len(new), AT_ONCE)]
            self.values = np.concatenate((self.values, *parts))
        out = []
        for bag in bags:
            if not bag:
                out.append(b"")
                continue
            codes = np.fromiter(map(self.known.__getitem__, bag), np.int64, len(bag))
            least = None
            for at in range(0, len(codes), len(self.room)):
                some = codes[at : at + len(self.room)]
                part = np.take(self.values, some, axis=0, out=self.room[: len(some)], mode="clip").min(axis=0)
                least = part if least is None else np.minimum(least, part)
            out.append(least.astype("<u2").tobytes())  # the lower 16 bits
        return out


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal samples, which estimates the generalised Jaccard similarity.

    Corrected for two-byte marks that agree by chance. Two texts without words are
    alike, one without and one with words are not.
    """
    if not a or not b:
        return float(a == b)
    same = float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))
    chance = 1.0 / 65536
    return min(1.0, max(0.0, (same - chance) / (1.0 - chance)))


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``(id, fingerprint)``: the samples of the words of every whole text, weighted by their counts, as hex.

    Words are runs without ASCII white space. Equal texts have equal fingerprints; null
    texts count as empty, and texts without words have an empty one. Two fingerprints are
    as alike as ``likeness`` says.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            for part in slices(batch):
                texts = [t or b"" for t in part.column("text").cast(pa.large_binary()).to_pylist()]
                marks = [m.hex() for m in sampler.fingerprints(texts)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(marks, pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")
    return out.withColumnRenamed("id", id_column)


def edited(text: str, following: str) -> str:
    """``text`` whose last half, rounded down, is the beginning of ``following`` of as many code points, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_FIELDS = (("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()))
_RESULT = "id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(sampler: Sampler, ids: list, texts: list[str], marks: list[bytes]) -> list[tuple]:
    """Rows for all texts but the last, each with the one after it."""
    changed = [edited(a, b).encode(errors="replace") for a, b in zip(texts, texts[1:])]
    edits = sampler.fingerprints(changed)
    return [
        (i, len(t), hashlib.sha256(c).hexdigest(), m, e, likeness(m, e), likeness(m, n))
        for i, t, c, m, e, n in zip(ids, texts, changed, marks, edits, marks[1:])
    ]


def edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The next document is the one with the next smaller id, after the last the first; the
    order among repeated ids is that of their texts' hashes, and rows without an id come last.
    Rows are range partitioned by that order, so every task has runs of neighbours and
    works them out in one pass; only the first and last text of each task meet in a
    second, small step. A single row is its own next. Empty input gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))  # a hash, as the borders of the ranges come to the driver
    order = [F.col("id").desc_nulls_last(), F.col("tie")]
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text", F.spark_partition_id().alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        held: tuple | None = None
        first: tuple | None = None
        task = 0
        for batch in batches:
            for part in slices(batch):
                ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
                marks = sampler.fingerprints([t.encode(errors="replace") for t in texts])
                task = part.column("task")[0].as_py()
                if first is None:
                    first = (ids[0], texts[0])
                if held is not None:
                    ids, texts, marks = [held[0], *ids], [held[1], *texts], [held[2], *marks]
                yield _batch(_compared(sampler, ids, texts, marks), [])
                held = (ids[-1], texts[-1], marks[-1])
        if held is not None:
            yield _batch([], [(task, first[0], first[1], held[0], held[1])])

    done = stage(sorted_rows.mapInArrow(run, f"{_RESULT}, task int, first_id long, first_text string, last_id long, last_text string"), "neighbour-fingerprints")
    inner = done.where("task is null").select(*[n for n, _ in _FIELDS])
    borders = done.where("task is not null").select("task", "first_text", "last_id", "last_text")
    tasks = sorted(r.task for r in borders.select("task").collect())  # one row a task
    turn = spark.createDataFrame(list(zip(tasks, [*tasks[1:], *tasks[:1]])), "task int, following int")
    firsts = borders.select(F.col("task").alias("following"), F.col("first_text").alias("next_text"))
    pairs = borders.join(F.broadcast(turn), "task").join(firsts, "following").select("last_id", "last_text", "next_text")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        for batch in batches:
            for i, a, b in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                marks = sampler.fingerprints([a.encode(errors="replace"), b.encode(errors="replace")])
                yield _batch(_compared(sampler, [i, None], [a, b], marks), None)

    result = inner.unionByName(pairs.mapInArrow(meet, _RESULT))
    readable = {c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")}
    return result.withColumns(readable).withColumnRenamed("id", id_column)


def _batch(rows: list[tuple], borders: list[tuple] | None) -> pa.RecordBatch:
    """Result rows, with empty border columns behind them, or one border row with empty result columns."""
    columns = list(zip(*rows)) if rows else [()] * len(_FIELDS)
    arrays = [pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS)]
    names = [n for n, _ in _FIELDS]
    if borders is None:
        return pa.RecordBatch.from_arrays(arrays, names)
    if borders:
        arrays = [pa.nulls(len(borders), t) for _, t in _FIELDS]
    kinds = (("task", pa.int32()), ("first_id", pa.int64()), ("first_text", pa.string()), ("last_id", pa.int64()), ("last_text", pa.string()))
    ends = list(zip(*borders)) if borders else [None] * len(kinds)
    arrays += [pa.array(c, t) if c is not None else pa.nulls(len(rows), t) for c, (_, t) in zip(ends, kinds)]
    return pa.RecordBatch.from_arrays(arrays, [*names, *[n for n, _ in kinds]])
