"""Typed reads and plain writes."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, FloatType, StructField, StringType, StructType

from panelforecast.functions.columns import clean_numeric, parse_month_key

# The numeric columns of the monthly district panel.
PANEL_COVARIATES = [
    "count_violence",
    "ndvi_anom",
    "food_price_idx",
    "ruggedness_mean",
    "pop",
    "cropland_pct",
    "sum_fatalities",
    "et_anom",
    "rain_anom",
]

# Words of a delimited file that stand for a missing value.
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

PANEL_SCHEMA = StructType(
    [StructField("year_month", StringType()), StructField("district", StringType()), StructField("ipc", DoubleType())]
    + [StructField(c, DoubleType()) for c in PANEL_COVARIATES]
)

CORPUS_SCHEMA = StructType(
    [
        StructField("summary", StringType()),
        StructField("date", DateType()),
        StructField("location", StringType()),
        StructField("lat", DoubleType()),
        StructField("lng", DoubleType()),
    ]
)


def read_delimited(
    spark: SparkSession, path: str, schema: StructType, multi_line: bool = False
) -> DataFrame:
    """Delimited text with a header row and an explicit schema; dates are ``yyyy-MM-dd``.

    Columns are taken by header name, so files may hold more of them or in another
    order. A field that is empty, quoted or not, or one of ``MISSING_WORDS`` is missing;
    any other that does not fit its type is an error. ``multi_line`` admits line breaks inside quoted text but makes each file
    one task; keep it for article text and convert such files to Parquet once.
    """
    raw = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .csv(path, inferSchema=False)
    )

    def typed(f: StructField) -> Column:
        return F.when(~F.col(f.name).isin(MISSING_WORDS), F.col(f.name)).cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema])


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet with only the named columns; NaN and infinities become NULL."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    floating = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return clean_numeric(df, floating) if floating else df


def in_fixed_order(df: DataFrame, parts: int) -> DataFrame:
    """Deal rows to ``parts`` tasks by a hash of their values, and sort them by it there.

    What is drawn row by row from a seed is then the same for the same rows, whatever
    cluster, cores or files they come from. ``parts`` must not follow any of these.
    """
    key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    keyed = df.withColumn("_order", key).repartition(parts, "_order").sortWithinPartitions("_order")
    return keyed.drop("_order")


def fill_cores(df: DataFrame, bytes_per_core: int = 16 * 1024 * 1024) -> DataFrame:
    """Spread a small input over all cores before costly work on single rows.

    A small table often comes as one file with one row group, hence one task. The size
    is Catalyst's own estimate; an input beyond the bound has enough splits and is
    left where it is. Only for work whose result does not depend on the partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if size >= cores * bytes_per_core:
        return df
    return df.repartition(cores)


def as_panel(df: DataFrame, key: str = "year_month") -> DataFrame:
    """Turn the month key into a DATE and clean every covariate that is present."""
    present = [c for c in [*PANEL_COVARIATES, "ipc"] if c in df.columns]
    return clean_numeric(df.withColumn("date", parse_month_key(F.col(key))).drop(key), present)


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if format == "csv":
        # blanks at the ends of a text are part of it
        writer = writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    writer.format(format).save(path)


def save_model(model, path: str) -> None:
    """Save a Spark ML pipeline, or a fit of this library, which is a small table."""
    if hasattr(model, "to_table"):
        write_table(model.to_table(SparkSession.active()), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: type = PipelineModel):
    if hasattr(kind, "from_table"):
        return kind.from_table(SparkSession.active().read.parquet(path))
    return kind.load(path)
