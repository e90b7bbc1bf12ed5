"""Reading, writing and stages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforecast.plans import datasets as ds
from panelforecast.sources import stages, tables


def test_panel_csv(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text("district,extra,year_month,ipc,pop\nBor,x,2011_03,2.0,NaN\nYei,y,2011_04,,5\n")
    schema = "district string, year_month string, ipc double, pop double"
    raw = tables.read_delimited(spark, str(path), spark.createDataFrame([], schema).schema)
    rows = {r.district: r for r in tables.as_panel(raw).collect()}
    assert rows["Bor"].date == dt.date(2011, 3, 1) and rows["Bor"].pop is None and rows["Bor"].ipc == 2.0
    assert rows["Yei"].ipc is None and rows["Yei"].pop == 5.0


def test_corpus_csv_keeps_quotes_and_line_breaks(spark, tmp_path):
    text = 'He said "no", then\nleft,\n\n"all" of it'
    rows = [(text, dt.date(2011, 3, 9), "Bor", 1.5, None), (" b\t", None, None, None, 2.0), ("", None, "x", None, None)]
    source = spark.createDataFrame(rows, tables.CORPUS_SCHEMA)
    tables.write_table(source, str(tmp_path / "c"), "csv")
    back = tables.read_delimited(spark, str(tmp_path / "c"), tables.CORPUS_SCHEMA, multi_line=True)
    rows[2] = (None, *rows[2][1:])  # an empty field reads as missing
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


def test_infinities_are_missing(spark, tmp_path):
    df = spark.createDataFrame([(1, float("inf")), (2, float("nan")), (3, float("-inf")), (4, 1.0)], "k int, x double")
    tables.write_table(df, str(tmp_path / "t"))
    back = tables.read_table(spark, str(tmp_path / "t"), ["k", "x"])
    assert [(r.k, r.x) for r in back.where("x is not null").collect()] == [(4, 1.0)] and back.count() == 4


def test_materialize_builds_once_and_again_on_demand(spark, tmp_path):
    path, built = str(tmp_path / "s"), []

    def build():
        built.append(1)
        return spark.range(len(built))

    assert stages.materialize(spark, path, build).count() == 1
    assert stages.materialize(spark, path, build).count() == 1 and len(built) == 1
    assert stages.materialize(spark, path, build, force=True).count() == 2


def test_materialize_does_not_trust_a_half_written_table(spark, tmp_path):
    path = str(tmp_path / "h")
    spark.range(7).write.parquet(path)
    (tmp_path / "h" / "_SUCCESS").unlink()
    assert stages.materialize(spark, path, lambda: spark.range(3)).count() == 3


def test_stages_go_to_the_folder_the_session_names(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is not None:
        assert stages.shared_folder(spark) == before.rstrip("/")
    staged = stages.stage(spark.range(5).withColumn("part", F.col("id") % 2), "t", "part")
    assert staged.columns == ["id", "part"] and staged.count() == 5
    assert stages.shared_folder(spark) in staged.inputFiles()[0]


def test_feature_lists_have_the_documented_sizes():
    assert len(ds.feature_names("Standard")) == 10 and len(ds.feature_names("Improved")) == 28
    with pytest.raises(ValueError):
        ds.feature_names("Other")


class _Master:
    """A session whose context claims another master and has no checkpoint folder."""

    def __init__(self, spark, master, settings):
        self._spark, self.sparkContext, self.conf = spark, self, self
        self._jsc, self.master, self._settings = self, master, settings

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False

    def hadoopConfiguration(self):
        return self._spark.sparkContext._jsc.hadoopConfiguration()

    def __getattr__(self, name):
        return getattr(self._spark.sparkContext, name)

    def get(self, key, default=None):
        return self._settings.get(key, default)


def test_local_warehouse_is_refused_on_a_cluster(spark, tmp_path):
    from panelforecast.sources.stages import shared_folder

    settings = {"spark.sql.warehouse.dir": f"file:{tmp_path}"}
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Master(spark, "spark://host:7077", settings))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_Master(spark, "local-cluster[3,2,2048]", settings))
    assert shared_folder(_Master(spark, "local[4]", settings)) == f"file:{tmp_path}/panelforecast-stages"
    settings["spark.checkpoint.dir"] = "s3a://bucket/stages/"
    assert shared_folder(_Master(spark, "yarn", settings)) == "s3a://bucket/stages"


def test_missing_words_and_malformed_numbers(spark, tmp_path):
    path = tmp_path / "panel.csv"
    path.write_text('district,ipc,pop\nBor,NA,1\nYei,null,"n/a"\nNA,,nan\nJuba,2.5,7\n')
    schema = spark.createDataFrame([], "district string, ipc double, pop double").schema
    rows = [tuple(r) for r in tables.read_delimited(spark, str(path), schema).collect()]
    assert rows == [("Bor", None, 1.0), ("Yei", None, None), (None, None, None), ("Juba", 2.5, 7.0)]
    path.write_text("district,ipc,pop\nBor,2..5,1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_delimited(spark, str(path), schema).collect()
