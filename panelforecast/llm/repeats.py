"""Substring deduplication by suffix trees over prefix partitions of the suffixes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from panelforecast.llm.common import lean_stage, mix, slices

WINDOW = 20
PREFIX = 8
HOT_SHARE = 8
SEED = 7
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every run of ``n`` words, from left to right."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * _FACTOR + hashes[k : k + count]
    return mix(out)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of every window, the leftmost of equal ones."""
    v, p, reach = values, np.arange(len(values)), 1
    while reach < width:
        step = min(reach, width - reach)
        right = v[step:] < v[:-step]
        v, p = np.where(right, v[step:], v[:-step]), np.where(right, p[step:], p[:-step])
        reach += step
    return p


def prefixes(words: list[bytes], window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``prefix`` words, and for every window the place of the one it is filed under.

    That is the run with the smallest hash inside the window: equal windows are filed
    under equal runs at equal offsets, and neighbouring windows mostly share theirs.
    """
    if len(words) < window:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    digest = xxhash.xxh64_intdigest
    grams = _grams(np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words)), prefix)
    return grams, _least(grams, window - prefix + 1)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            grams, keys, places = [], [], []
            for key, text in zip(part.column("key").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()):
                all_grams, filed = prefixes(text.split())
                at = filed[np.flatnonzero(np.diff(filed, prepend=-1))]
                grams.append(all_grams[at].view(np.int64))
                keys.append(np.full(len(at), key))
                places.append(at)
            columns = [pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in (grams, keys, places)]
            yield pa.RecordBatch.from_arrays(columns, ["prefix", "key", "at"])


def _pieces(hot: frozenset):
    """The windows filed under repeated prefixes, as pieces of text that share a prefix.

    A piece holds all neighbouring windows filed under one prefix. Under a prefix with too
    many occurrences every window is a piece of its own, filed under all its words. Of
    equal pieces of a batch only the first carries its words; the others are known to be
    repeats.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[tuple[int, bytes], tuple] = {}
            repeats = []
            for part in slices(batch):
                for key, rank, text, ats in zip(*[part.column(c).to_pylist() for c in ("key", "rank", "text", "ats")]):
                    words = text.encode(errors="surrogatepass").split()
                    grams, filed = prefixes(words)
                    used = np.flatnonzero(np.isin(filed, np.array(ats)))
                    if not len(used):
                        continue
                    cuts = np.flatnonzero((np.diff(used) != 1) | (np.diff(filed[used]) != 0)) + 1
                    for some in np.split(used, cuts):
                        gram = int(grams[filed[some[0]]])
                        lo, n, long = int(some[0]), len(some), gram in hot
                        for start, count in [(lo + k, 1) for k in range(n)] if long else [(lo, n)]:
                            content = b" ".join(words[start : start + count - 1 + WINDOW])
                            dest = (xxhash.xxh64_intdigest(content, SEED) if long else gram) - (1 << 63)
                            row = (dest, content, rank, key, start, count)
                            seen = first.get((dest, content))
                            if seen is None:
                                first[dest, content] = row
                            elif (rank, start) < (seen[2], seen[4]):
                                first[dest, content] = row
                                repeats.append(seen)
                            elif (rank, key, start) != (seen[2], seen[3], seen[4]):
                                repeats.append(row)
            rows = list(first.values()) + [(k ^ s, None, r, k, s, n) for _, _, r, k, s, n in repeats]
            columns = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["dest", "content", "rank", "key", "start", "n"])

    return run


def deep_nodes(pieces: list[tuple[bytes, int]], depth: int = WINDOW) -> Iterator[list[tuple[int, int]]]:
    """Leaves ``(piece, offset)`` below every internal node of at least ``depth`` words of a suffix tree.

    ``pieces`` are distinct contents with the number of their windows; the suffixes that
    begin at those windows are sorted, and a node that deep is a run of neighbours whose
    common prefixes have that many words. A node's words are a maximal repeat's beginning.
    """
    suffixes = []
    for i, (content, n) in enumerate(pieces):
        words = content.split(b" ")
        suffixes += [(words[j:], i, j) for j in range(n)]
    suffixes.sort()
    run = suffixes[:1]
    for before, suffix in zip(suffixes, suffixes[1:]):
        if before[0][:depth] != suffix[0][:depth]:
            if len(run) > 1:
                yield [(i, j) for _, i, j in run]
            run = []
        run.append(suffix)
    if len(run) > 1:
        yield [(i, j) for _, i, j in run]


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows ``(key, start, n)``; rows arrive sorted by prefix, words, document and start."""
    held: list[tuple] = []
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("dest", "content", "rank", "key", "start", "n")]):
            if row[1] is None:
                out.append(row[3:])
                continue
            if held and held[0][0] != row[0]:
                out += _of_prefix(held)
                held = []
            if held and held[-1][1] == row[1]:
                if (row[2], row[4]) != (held[-1][2], held[-1][4]):  # at the same id and place neither is earlier
                    out.append(row[3:])
                continue
            held.append(row)
        yield _ranges(out)
    yield _ranges(_of_prefix(held))


def _of_prefix(held: list[tuple]) -> list[tuple]:
    """One subtree: of the leaves below every deep node all but the earliest are repeats."""
    if len(held) < 2:
        return []
    out = []
    for leaves in deep_nodes([(row[1], row[5]) for row in held]):
        places = [(held[i][2], held[i][4] + j, held[i][3]) for i, j in leaves]
        earliest = min(p[:2] for p in places)
        out += [(key, start, 1) for rank, start, key in places if (rank, start) != earliest]
    return out


def _ranges(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["key", "start", "n"])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            words_in, removed, texts = [], [], []
            for text, spans in zip(part.column("text").cast(pa.large_binary()).to_pylist(), part.column("spans").to_pylist()):
                words = text.split()
                change = np.zeros(len(words) + 1, np.int64)
                for span in spans or ():
                    if span["start"] + span["n"] - 1 + WINDOW <= len(words):
                        change[span["start"]] += 1
                        change[span["start"] + span["n"] - 1 + WINDOW] -= 1
                covered = np.cumsum(change[:-1]) > 0
                words_in.append(len(words))
                removed.append(int(covered.sum()))
                texts.append(b" ".join(w for w, c in zip(words, covered.tolist()) if not c) if removed[-1] else b" ".join(words))
            columns = [part.column("id"), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``(id, n_words, n_removed, kept)``: every text without the words of repeated windows.

    A window is 20 consecutive words (runs without ASCII white space, unchanged) of one
    document; it is a repeat if the same words also start earlier, in a document with a
    smaller id or earlier in the same one. Words covered by a repeat go; the others are
    joined by spaces. Only the first of many copies of a passage stays.

    First every suffix is filed under the prefix of 8 words that is the least of its
    window, and prefixes that occur once are left out: they begin no repeat. Then the
    remaining windows travel, neighbours as one piece, to the task of their prefix. A
    prefix with more than one in ``8 x partitions`` of all occurrences (there are at most
    that many) is made longer, up to the whole window, so that a group of suffixes always
    fits into memory; equal pieces are folded before they travel. Each task builds the
    suffix tree of each prefix; what lies below a node of at least 20 words repeats.

    Null and short texts lose nothing. Rows without an id come after all others; rows of
    equal id are one document each, and of equal starts in them neither is earlier.
    Repeated rows stay as rows; other columns are not carried along.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("id", "text")).withColumn("rank", F.coalesce("id", F.lit((1 << 63) - 1)))
    found = lean_stage(rows.select("key", "text").mapInArrow(_occurrences, "prefix long, key long, at long"), "prefix-occurrences")
    repeated = lean_stage(found.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "prefix-counts")
    parts = HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = repeated.where(F.col("n") > total / parts).select("prefix").limit(parts).collect()
    hot = frozenset(np.array([r.prefix for r in heavy], np.int64).view(np.uint64).tolist())
    lists = lean_stage(
        found.join(repeated.select("prefix"), "prefix").groupBy("key").agg(F.collect_set("at").alias("ats")), "prefix-places"
    )
    pieces = rows.join(lists, "key").select("key", "rank", "text", "ats").mapInArrow(
        _pieces(hot), "dest long, content binary, rank long, key long, start long, n long"
    )
    filed = pieces.repartition("dest").sortWithinPartitions("dest", "content", "rank", "start")
    spans = lean_stage(filed.mapInArrow(_resolved, "key long, start long, n long"), "repeated-windows")
    spans = lean_stage(spans.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans")), "repeated-spans")
    out = rows.select("key", "id", "text").join(spans, "key", "left").select("id", "text", "spans")
    return out.mapInArrow(_kept, "id long, n_words long, n_removed long, kept string").withColumnRenamed("id", id_column)
