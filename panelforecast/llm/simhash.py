"""Near-duplicate documents by SimHash and multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from panelforecast.llm.common import slices
from panelforecast.llm.graph import components
from panelforecast.operators.joins import lookup_join
from panelforecast.sources.stages import stage

BITS = 64
RADIUS = 3
HASH_SEED = 42
SHINGLE = 3
HASHES_AT_ONCE = 1 << 14
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def _fingerprint(text: bytes, shingle: int) -> int:
    words = text.translate(_LOWER).split()  # bytes split at exactly 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(run) for run in zip(*(words[k:] for k in range(shingle)))]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(gram, HASH_SEED) for gram in grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        part = hashes[at : at + HASHES_AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(set_bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE, digest: bool = False) -> DataFrame:
    """``(id, fp)``: the 64-bit SimHash of every row's whole text, as a signed long.

    Words are runs without ASCII white space, A-Z in lower case; shingles are
    space-joined runs of words, repeats counted. Fewer words make one shingle; a
    null text and one without words have fingerprint zero. ``digest`` adds
    ``row_key``, which tells rows of one id and other texts apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column("text").cast(pa.large_binary()).to_pylist()
                marks = pa.array([_fingerprint(t or b"", shingle) for t in texts], pa.int64())
                kept = [c for c in part.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], marks], [*kept, "fp"])

    text = F.col(text_column).cast("string")
    also = [_row_key(F.col(id_column), text).alias("row_key")] if digest else []
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text.alias("text"), *also)
    return rows.mapInArrow(run, "id long, row_key string, fp long" if digest else "id long, fp long")


def _row_key(row_id: Column, text: Column) -> Column:
    """128 bits of an id and a text; a null text is like an empty one, a null id like no other."""
    named = F.coalesce(row_id.cast("long").cast("string"), F.lit("none"))
    return F.md5(F.concat(named, F.lit(" "), F.coalesce(text, F.lit(""))))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, near)``: all pairs of different fingerprints with at most ``radius`` (3) differing bits.

    ``fps`` holds distinct fingerprints. Two that differ in at most 3 bits differ in
    at most one bit of one of their 32-bit halves. Each half's ball of radius one is
    looked up in the table of halves, and the whole distance is verified inside the
    join. Of two halves that differ in one bit only the one with the bit set asks
    for the other, so a fingerprint asks for 16 keys a half on average instead of 33.
    """
    if radius != RADIUS:
        raise ValueError("halves with balls of radius one are complete for a radius of 3 only")
    half = BITS // 2
    segment = [F.shiftrightunsigned("fp", k * half).bitwiseAND((1 << half) - 1) for k in (0, 1)]
    table = fps.select("fp", F.posexplode(F.array(*segment)).alias("half", "key"))
    cleared = F.transform(
        F.sequence(F.lit(0), F.lit(half - 1)),
        lambda i: F.when(F.expr("key").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0,
                         F.expr("key").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))),
    )
    ball = F.filter(F.concat(F.array("key"), cleared), lambda k: k.isNotNull())
    asks = table.select("fp", "half", F.posexplode(ball).alias("step", "key"))
    table = table.withColumnRenamed("fp", "near")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("near")))
    found = asks.join(
        table,
        (asks["half"] == table["half"])
        & (asks["key"] == table["key"])
        & (apart <= radius)
        & ((F.col("step") > 0) | (F.col("fp") < F.col("near"))),
    )
    return found.select(F.least("fp", "near").alias("fp"), F.greatest("fp", "near").alias("near")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row per input row.

    Fingerprints link at 3 or fewer differing bits; ``component_id`` is the smallest
    id reachable by links. Copies share a fingerprint and are folded before anything
    is joined, so a group of copies of any size is one row in the search. Rows
    without an id keep their row; their component is that of their fingerprint, null
    where no member has an id. Other columns are not carried along. Empty input
    gives no rows.
    """
    marked = stage(fingerprints(docs, id_column, text_column, shingle), "simhash")
    placed = _rooted(marked)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = stage(placed.join(named, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(of_fp, "fp").select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def _rooted(marked: DataFrame) -> DataFrame:
    """``(fp, least, root)`` of every fingerprint: its smallest id, and the smallest fingerprint that links reach."""
    classes = stage(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    roots = components(links(classes.select("fp")), "fp", "near")
    return classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of every group of near duplicates, with all its columns.

    Groups are those of ``near_duplicates``. The row with the smallest id stays; a row with an id
    comes before one without, then a hash of id and text decides, then the smaller row in the
    order of its columns. So rows of one id and unlike texts are documents of their own, and
    of equal rows one stays. Empty input gives no rows.

    Only ids, keys and fingerprints are grouped. The rows that are to go are staged and
    measured: within the broadcast limit no text moves, beyond it texts move once to meet
    them, with hot keys spread.
    """
    rows = stage(fingerprints(docs, id_column, text_column, shingle, digest=True), "simhash")
    rooted = stage(_rooted(rows).select("fp", "root"), "simhash-roots")
    each = rows.groupBy("fp", "id", "row_key").agg(F.count(F.lit(1)).alias("copies")).join(rooted, "fp")
    each = stage(each.select("root", "row_key", F.struct(F.col("id").isNull().alias("none"), "id", "row_key").alias("row"), "copies"), "simhash-rows")
    first = each.groupBy("root").agg(F.min("row").alias("first"))
    told = lookup_join(each, first, "root", "inner", spread_by="row_key")
    stays = F.col("row") == F.col("first")
    fate = stage(told.where(~stays | (F.col("copies") > 1)).select("row_key", stays.alias("stays")), "simhash-fates")
    name = [f"c{i}" for i in range(len(docs.columns))]
    named = docs.toDF(*name)
    own_id, text = (F.col(name[docs.columns.index(c)]) for c in (id_column, text_column))
    named = named.withColumn("row_key", _row_key(own_id, text.cast("string"))).withColumn("spread", F.xxhash64(*name))
    if fate.where("stays").isEmpty():
        return lookup_join(named, fate.select("row_key"), "row_key", "left_anti", spread_by="spread").select(*name).toDF(*docs.columns)
    joined = lookup_join(named, fate, "row_key", "left", spread_by="spread")
    alone = joined.where("stays is null").select(*name)
    # equal keys: the smallest of the rows, found on the map side first, however many there are
    several = joined.where("stays").groupBy("row_key").agg(F.min(F.struct(*name)).alias("row")).select("row.*")
    return alone.unionByName(several).toDF(*docs.columns)
