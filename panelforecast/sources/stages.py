"""Stage tables: written once into the shared folder, read back as plain Parquet.

A stage cuts lineage without depending on any executor staying alive, and gives
Catalyst the real size of a table, so that joins with it are planned on facts.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _filesystem(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hadoop_path.getFileSystem(conf), hadoop_path


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    In this order: the setting ``spark.checkpoint.dir``, the context's checkpoint
    folder, a folder under ``spark.sql.warehouse.dir``. The last is refused where it
    is a local path and the master is not local: each machine would see its own.
    """
    folder = spark.conf.get(_SETTING, None)
    if folder:
        return folder.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/panelforecast-stages"
    fs, _ = _filesystem(spark, folder)
    if fs.getUri().getScheme() == "file" and not _is_local(spark.sparkContext.master):
        raise ValueError(f"set {_SETTING} to a folder that all executors share; {folder} is local to each machine")
    return folder


def _is_local(master: str) -> bool:
    """One machine: ``local`` or ``local[n]``, but not ``local-cluster``."""
    return master == "local" or master.startswith("local[")


def prepare_checkpoints(spark: SparkSession) -> None:
    """Let iterative fits write checkpoints into the shared folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def _stage_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stages-{spark.sparkContext.applicationId}"


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` under a fresh name in the shared folder and read it back."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def drop_stage(df: DataFrame) -> None:
    """Remove the table of one stage that nothing reads any more; what is no stage of this application stays."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, path = _filesystem(spark, folder)
        if f"/{_stage_root(spark).rpartition('/')[2]}/" in folder:
            fs.delete(path, True)


@contextmanager
def lean_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind: they go with the action that wrote them."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def clear_stages(spark: SparkSession) -> None:
    """Remove the stages of this application once its results are written."""
    fs, path = _filesystem(spark, _stage_root(spark))
    fs.delete(path, True)


def is_complete(spark: SparkSession, path: str) -> bool:
    fs, marker = _filesystem(spark, f"{path}/_SUCCESS")
    return fs.exists(marker)


def _settings_path(path: str) -> str:
    return f"{path}/_settings.json"


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None where there is none."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        return None
    source = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, at = _filesystem(spark, path)
    target = fs.create(at, True)
    try:
        target.write(bytearray(text, "utf-8"))
    finally:
        target.close()


def read_settings(spark: SparkSession, path: str) -> str | None:
    """The settings that were written beside a table, None where there are none."""
    return read_text(spark, _settings_path(path))


def write_settings(spark: SparkSession, path: str, settings: str) -> None:
    """Write them last: a table without them is not complete for a caller who asks for some."""
    write_text(spark, _settings_path(path), settings)


def file_listing(spark: SparkSession, path: str) -> list[list]:
    """Name, size and time of every file at ``path``, hidden ones aside; empty where there is nothing."""
    fs, at = _filesystem(spark, path)
    if not fs.exists(at):
        return []
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        file = found.next()
        if not file.getPath().getName().startswith(("_", ".")):
            out.append([file.getPath().toString(), file.getLen(), file.getModificationTime()])
    return sorted(out)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order, partitions and files: one aggregate, whose parts merge.

    The count and the sums of two hashes of every row with its nulls; a row more, less, twice
    or with another value changes it, and so does another column name.
    """
    row = [part for c in df.columns for part in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    sums = [F.sum(F.xxhash64(F.lit(salt), *row).cast("decimal(38,0)")) for salt in ("first", "second")]
    found = df.agg(F.count(F.lit(1)), *sums).first()
    return ":".join(str(v) for v in (",".join(df.columns), *found))


def known_digest(spark: SparkSession, source: str, record: str, read: Callable[[], DataFrame]) -> str:
    """The digest of the rows at ``source``, kept in the file ``record`` with the listing it was taken from.

    As long as the files are the same ones the rows are not read again; where the listing
    differs they are, so that files that were merely written anew give the same digest.
    """
    listing = file_listing(spark, source)
    kept = json.loads(read_text(spark, record) or "{}")
    if kept.get("listing") == listing:
        return kept["digest"]
    digest = content_digest(read())
    write_text(spark, record, json.dumps({"listing": listing, "digest": digest}))
    return digest


def materialize(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False, settings: str | None = None
) -> DataFrame:
    """Read the table at ``path``; build and write it first if it is not complete.

    ``force`` rebuilds. A run that died half way left no success marker, so its
    output is overwritten rather than trusted. With ``settings`` a table that was
    built with others is rebuilt as well.
    """
    stale = settings is not None and read_settings(spark, path) != settings
    if force or stale or not is_complete(spark, path):
        build().write.mode("overwrite").parquet(path)
        if settings is not None:
            write_settings(spark, path, settings)
    return spark.read.parquet(path)
