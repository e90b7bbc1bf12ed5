"""Near-duplicate vectors by randomly rotated binary codes with correction factors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from panelforecast.llm.graph import components
from panelforecast.sources.stages import stage

COSINE = 0.98
ROTATION_SEED = 20
BANDS = 28
BAND_BITS = 20
BLOCK = 1024
CONFIDENCE = 4.0
PAIRS_AT_ONCE = 256
# Bits a dimension of the asking side of an estimate.
DIGITS = 4
# A block pair: a bucket, the number of its blocks, and two of them.
PAIR = ["label", "band", "key", "dim", "n", "lo", "hi"]


_ROTATIONS: dict = {}


def rotations(dim: int, bands: int = BANDS, bits: int = BAND_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A random rotation for the codes, and the directions whose signs make the bands' keys."""
    if (dim, bands, bits) not in _ROTATIONS:
        rng = np.random.default_rng(ROTATION_SEED)
        turn = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(1 + -(-bands * bits // dim))]
        _ROTATIONS[dim, bands, bits] = turn[0], np.concatenate(turn[1:], axis=0)[: bands * bits]
    return _ROTATIONS[dim, bands, bits]


def _band_keys(units: np.ndarray, bands: int, bits: int) -> np.ndarray:
    signs = (units @ rotations(units.shape[1], bands, bits)[1].T >= 0).reshape(len(units), bands, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def _vectors(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """Rows as double vectors; None for null, zero, empty, and null or non-finite components."""
    out = []
    for value in batch.column("vector"):
        v = value.values if value.is_valid else None
        if v is None or v.null_count or not len(v):
            out.append(None)
            continue
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row with its vector as bytes; null bytes where it links with nothing."""
    for batch in batches:
        raw = [x if x is None else x.tobytes() for x in _vectors(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(raw, pa.binary())], ["id", "label", "raw"])


def _units(rows: list[np.ndarray]) -> np.ndarray:
    units = np.stack(rows)
    units = units / np.abs(units).max(axis=1, keepdims=True)
    return units / np.linalg.norm(units, axis=1, keepdims=True)


def _keyed(bands: int, bits: int):
    """The keys of each vector (a number a band) and its stored code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(r, np.float64) for r in batch.column("raw").to_pylist()]
            keys: list = [None] * len(rows)
            codes: list = [None] * len(rows)
            for dim in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == dim]
                units = _units([rows[i] for i in at])
                for i, k, code in zip(at, _band_keys(units, bands, bits).astype(np.int32), Codes(units).stored()):
                    keys[i], codes[i] = k.tobytes(), code
            dims = pa.array([len(r) for r in rows], pa.int32())
            columns = [batch.column("rep"), batch.column("label"), dims, pa.array(keys, pa.binary()), pa.array(codes, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "dim", "keys", "code"])

    return run


def _filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector and band."""
    for batch in batches:
        keys = np.stack([np.frombuffer(k, np.int32) for k in batch.column("keys").to_pylist()]) if batch.num_rows else np.zeros((0, 1), np.int32)
        at, band = np.divmod(np.arange(keys.size), keys.shape[1])
        taken = batch.select(["rep", "label", "dim"]).take(pa.array(at))
        columns = [*taken.columns, pa.array(band.astype(np.int32)), pa.array(keys.ravel())]
        yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "dim", "band", "key"])


class Codes:
    """Binary codes of unit vectors with what is stored beside them.

    The rotated vector o has one sign bit a dimension: s, of length one. ``own`` = <s, o> is the
    correction: for any unit vector q, <s, q> / own is an unbiased estimate of <o, q> over the
    choice of the rotation, off by about sqrt((1 - own^2) / own^2 / (D - 1)). The asking side q is
    stored in ``DIGITS`` bits a dimension, ``low + step * c``, rounded with a fixed dither so that this
    is unbiased too, off by at most step / 2 / own more. <s, q> then is made of counts of
    common bits, plane by plane; no vector is needed.
    """

    def __init__(self, units: np.ndarray):
        size = units.shape[1]
        turned = units @ rotations(size)[0].T
        self.dim = size
        self.bits = _words(turned >= 0)
        self.own = np.abs(turned).sum(axis=1) / np.sqrt(size)
        self.low = turned.min(axis=1)
        width = turned.max(axis=1) - self.low
        self.step = np.where(width > 0, width, 1.0) / (2**DIGITS - 1)
        dither = np.random.default_rng(ROTATION_SEED + 1).random(size)
        c = np.minimum((turned - self.low[:, None]) / self.step[:, None] + dither, 2**DIGITS - 1).astype(np.int64)
        self.total = c.sum(axis=1).astype(np.float64)
        self.planes = np.stack([_words(c >> b & 1 == 1) for b in range(DIGITS)], axis=1)

    def stored(self) -> list[bytes]:
        factors = np.stack([self.own, self.low, self.step, self.total], axis=1)
        return [f.tobytes() + b.tobytes() + p.tobytes() for f, b, p in zip(factors, self.bits, self.planes)]

    @staticmethod
    def read(stored: list[bytes], dim: int) -> Codes:
        """Codes as ``stored`` wrote them."""
        whole = np.frombuffer(b"".join(stored), np.uint64).reshape(len(stored), -1)
        codes = Codes.__new__(Codes)
        words = -(-dim // 64)
        codes.dim = dim
        codes.own, codes.low, codes.step, codes.total = np.ascontiguousarray(whole[:, :4]).view(np.float64).T
        codes.bits = whole[:, 4 : 4 + words]
        codes.planes = whole[:, 4 + words :].reshape(len(stored), DIGITS, words)
        return codes

    def after(self, start: int) -> Codes:
        """The codes of the rows from ``start`` on."""
        rest = Codes.__new__(Codes)
        rest.dim = self.dim
        for name in ("own", "low", "step", "total", "bits", "planes"):
            setattr(rest, name, getattr(self, name)[start:])
        return rest

    def estimate(self, at: slice, others: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of the rows ``at`` with all of ``others``, and the estimates' error."""
        bits = self.bits[at]
        common = np.zeros((len(bits), len(others.bits)))
        for word in range(bits.shape[1]):
            for b in range(DIGITS):
                common += np.bitwise_count(bits[:, word, None] & others.planes[None, :, b, word]) * float(1 << b)
        ones = np.bitwise_count(bits).sum(axis=1).astype(np.float64)[:, None]
        inner = others.low * (2 * ones - self.dim) + others.step * (2 * common - others.total)
        own = self.own[at, None]
        off = np.sqrt((np.maximum(0.0, 1.0 - own**2) / max(1, self.dim - 1) + others.step**2 / 4) / own**2)
        return inner / np.sqrt(self.dim) / own, off


def _words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as 64-bit words."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _selected(codes: Codes, keys: np.ndarray, band: int, first: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one block pair whose first common band is this one and whose cosine may reach the threshold.

    ``first`` rows form one block and the rest the other; with ``first`` equal to the
    number of rows it is a block against itself.
    """
    shift = 0 if first == len(keys) else first
    others = codes.after(shift)
    for at in range(0, first, PAIRS_AT_ONCE):
        rows = slice(at, min(at + PAIRS_AT_ONCE, first))
        guess, off = codes.estimate(rows, others)
        i, j = np.nonzero(guess + CONFIDENCE * off >= threshold)
        i, j = i + at, j + shift
        keep = i < j
        i, j = i[keep], j[keep]
        if band:
            new = ~(keys[i, :band] == keys[j, :band]).any(axis=1)
            i, j = i[new], j[new]
        yield i, j


def _block_pairs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[list[tuple], int]]:
    """(rows, rows of the first block) of each block pair; rows arrive sorted by their pair."""
    block: list[tuple] = []

    def whole() -> Iterator[tuple[list[tuple], int]]:
        block.sort(key=lambda r: (r[len(PAIR)], r[len(PAIR) + 1]))
        first = sum(r[len(PAIR)] == block[0][len(PAIR)] for r in block) if block else 0
        # of a pair of two blocks both have to have rows
        if len(block) > 1 and (first < len(block) or block[0][5] == block[0][6]):
            yield block, first

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in [*PAIR, *columns]]):
            if block and block[0][: len(PAIR)] != row[: len(PAIR)]:
                yield from whole()
                block = []
            block.append(row)
    yield from whole()


def _read(block: list[tuple], keys: int, code: int) -> tuple[Codes, np.ndarray]:
    return Codes.read([r[code] for r in block], block[0][3]), np.stack([np.frombuffer(r[keys], np.int32) for r in block])


def _chosen(threshold: float, schema: pa.Schema):
    """Blocks of codes in; those of their rows out that are in a pair to recompute."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first in _block_pairs(batches, ["own", "rep", "keys", "code"]):
            codes, keys = _read(block, 9, 10)
            wanted = np.zeros(len(block), bool)
            for i, j in _selected(codes, keys, block[0][1], first, threshold):
                wanted[i] = wanted[j] = True
            rows = [block[k][:9] for k in np.flatnonzero(wanted)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _linked(threshold: float):
    """Blocks of chosen rows with their vectors in, link counts and spanning links out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first in _block_pairs(batches, ["own", "rep", "keys", "code", "copies", "raw"]):
            codes, keys = _read(block, 9, 10)
            ids = np.array([r[8] for r in block], np.int64)
            weight = np.array([r[11] for r in block], np.int64)
            units = _units([np.frombuffer(r[12], np.float64) for r in block])
            left, right = [], []
            for i, j in _selected(codes, keys, block[0][1], first, threshold):
                near = np.einsum("ij,ij->i", units[i], units[j]) >= threshold
                left.append(i[near])
                right.append(j[near])
            yield _spanning(ids, weight, np.concatenate(left), np.concatenate(right))

    return run


def _spanning(ids: np.ndarray, weight: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Number of links of each row, and the smallest row it reaches within the block pair."""
    links = np.bincount(i, weight[j], len(ids)).astype(np.int64) + np.bincount(j, weight[i], len(ids)).astype(np.int64)
    parent = np.arange(len(ids))
    while True:
        root = _find(parent)
        low = np.minimum(root[i], root[j])
        if (root[i] == root[j]).all():
            break
        parent = root.copy()
        np.minimum.at(parent, root[i], low)
        np.minimum.at(parent, root[j], low)
    some = np.flatnonzero(links)
    return _links_batch([(int(ids[k]), int(ids[root[k]]), int(links[k])) for k in some])


def _links_batch(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rep", "root", "links"])


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    threshold: float = COSINE,
    bands: int = BANDS,
    bits: int = BAND_BITS,
    block: int = BLOCK,
) -> DataFrame:
    """``(id, n_links, component_id, kept)``, one row per vector, within equal labels.

    Equal vectors of a label are folded first. The signs of a vector's products with
    random rotations make ``bands`` keys of ``bits`` bits; vectors that share a key are
    candidates, found once, in the first band they share. Only keys, codes and factors go to
    the buckets: there ``Codes`` estimates every candidate's cosine. Vectors are fetched for
    the rows of pairs whose confidence bound reaches the threshold, and these pairs are
    recomputed in double precision; only those at or above it link. A bucket of any size is
    cut into blocks of about ``block`` vectors and every pair of blocks is a piece of work
    of its own; it gives counts and spanning links, never its pairs. No cap on buckets.

    Vectors that are null, zero, or hold null or non-finite components, rows without a
    label or id, and vectors of another length link with nothing; those rows stay, with
    no links and themselves as component. Empty input gives no rows.
    """
    rows = vectors.select(
        F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).cast("array<double>").alias("vector")
    )
    raw = stage(rows.mapInArrow(_prepared, f"id long, label {rows.schema['label'].dataType.simpleString()}, raw binary"), "vectors")
    able = raw.where("id is not null and label is not null and raw is not null")
    reps = stage(able.groupBy("label", "raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vector-classes")
    label_type = rows.schema["label"].dataType.simpleString()
    keyed = stage(reps.mapInArrow(_keyed(bands, bits), f"rep long, label {label_type}, dim int, keys binary, code binary"), "vector-keys")
    members = keyed.select("rep", "label", "dim", "keys").mapInArrow(_filed, f"rep long, label {label_type}, dim int, band int, key int")
    bucket = ["label", "band", "key", "dim"]
    sizes = members.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    crowded = members.join(sizes, bucket)
    crowded = crowded.withColumn("n", F.ceil(F.col("size") / block).cast("int"))
    crowded = crowded.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    crowded = crowded.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    crowded = crowded.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).select(*PAIR, "own", "rep")
    coded = crowded.join(keyed.select("rep", "label", "keys", "code"), ["rep", "label"]).repartition(*PAIR).sortWithinPartitions(*PAIR)
    work = coded.select(*PAIR, "own", "rep", "keys", "code")
    chosen = stage(work.mapInArrow(_chosen(threshold, to_arrow_schema(crowded.schema)), crowded.schema), "vector-pairs")
    held = keyed.select("rep", "label", "keys", "code").join(reps, ["rep", "label"])
    fetched = chosen.join(held, ["rep", "label"]).repartition(*PAIR).sortWithinPartitions(*PAIR)
    exact = fetched.select(*PAIR, "own", "rep", "keys", "code", "copies", "raw").mapInArrow(_linked(threshold), "rep long, root long, links long")
    found = stage(exact, "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("found"))
    roots = components(found, "rep", "root")
    named = (
        reps.select("rep", "label", "copies", "raw")
        .join(counts, "rep", "left")
        .join(roots, F.col("rep") == roots["node"], "left")
        .select("label", "raw", (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    linked = able.join(named, ["label", "raw"]).select("id", "n_links", "component_id")
    alone = raw.where("id is null or label is null or raw is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_column), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )
