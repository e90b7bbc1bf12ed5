"""The whole analysis over a folder of input files, stage by stage.

    project = Project(spark, "/data/", "/data/stages")
    data = project.dataset("Improved")
    result = model_eval(data, feature_names("Improved"), "Ridge")

Inputs are ``food_crises_cleaned.csv`` and ``articles_summary_cleaned.csv`` (or
folders of that name without ``.csv`` holding Parquet, which is what to use at
scale). Every stage is a Parquet table under the stage folder, built on first use
and then reused as long as the settings and the input rows it depends on stay the same; the
settings and a digest of the rows are written beside it. Input files that were merely written
anew change nothing. A project looks at its inputs once, when it first needs them.
``force=True`` rebuilds.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, DoubleType, StringType, StructField, StructType

from panelforecast.functions.columns import text_key
from panelforecast.operators import topics as tp
from panelforecast.operators.panel import assert_unique_key
from panelforecast.operators.tags import attach_tags, repeat_copies
from panelforecast.plans import datasets as ds, reports
from panelforecast.sources import stages, tables

# Names of the input files.
PANEL_FILE = "food_crises_cleaned"
CORPUS_FILE = "articles_summary_cleaned"


class Project:
    def __init__(
        self,
        spark: SparkSession,
        data_dir: str,
        stage_dir: str | None = None,
        topics: int = 50,
        top_n: int = 10,
        fanout: bool = True,
        force: bool = False,
        tags: Mapping[str, Sequence[str]] = tp.ALL_TAG_KEYWORDS,
    ):
        self.spark = spark
        self.data_dir = data_dir.rstrip("/")
        self.stage_dir = (stage_dir or f"{self.data_dir}/stages").rstrip("/")
        self.topics, self.top_n, self.fanout, self.force = topics, top_n, fanout, force
        self.tags = {tag: list(keywords) for tag, keywords in tags.items()}
        self._built: set[str] = set()
        self._digests: dict[str, str] = {}

    def _settings(self, name: str) -> dict:
        """What a stage and the stages before it depend on, the rows of their inputs included."""
        both = name == "districted" or name.startswith("dataset")
        settings: dict = {"rows": [self._digest(i) for i in (["panel", "corpus"] if both else ["panel"] if name == "panel" else ["corpus"])]}
        if name in ("panel", "corpus"):
            return settings
        settings["topics"] = self.topics
        if name not in ("topic-model", "topics"):
            settings |= {"top_n": self.top_n, "tags": self.tags}
        if name not in ("topic-model", "topics", "tagged"):
            settings["fanout"] = self.fanout
        return settings

    def _digest(self, name: str) -> str:
        """The digest of an input's rows; they are read only if its files are not those of last time."""
        if name not in self._digests:
            file, read = (PANEL_FILE, self._raw_panel) if name == "panel" else (CORPUS_FILE, self._raw_corpus)
            source = f"{self.data_dir}/{file}" + ("" if self._has_parquet(file) else ".csv")
            self._digests[name] = stages.known_digest(self.spark, source, f"{self.stage_dir}/_rows-{name}.json", read)
        return self._digests[name]

    def _stage(self, name: str, build) -> DataFrame:
        force = self.force and name not in self._built
        self._built.add(name)
        settings = json.dumps(self._settings(name), sort_keys=True)
        return stages.materialize(self.spark, f"{self.stage_dir}/{name}", build, force, settings)

    def _has_parquet(self, name: str) -> bool:
        return stages.is_complete(self.spark, f"{self.data_dir}/{name}")

    def panel(self) -> DataFrame:
        """The keyed panel; duplicate (date, district) keys are an error."""

        return self._stage("panel", lambda: assert_unique_key(tables.as_panel(self._raw_panel())))

    def _raw_panel(self) -> DataFrame:
        if self._has_parquet(PANEL_FILE):
            return self.spark.read.parquet(f"{self.data_dir}/{PANEL_FILE}")
        return tables.read_delimited(self.spark, f"{self.data_dir}/{PANEL_FILE}.csv", tables.PANEL_SCHEMA)

    def _raw_corpus(self) -> DataFrame:
        if self._has_parquet(CORPUS_FILE):
            return self.spark.read.parquet(f"{self.data_dir}/{CORPUS_FILE}")
        path = f"{self.data_dir}/{CORPUS_FILE}.csv"
        header = self.spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).columns
        types = {"date": DateType(), "lat": DoubleType(), "lng": DoubleType()}
        schema = StructType([StructField(c, types.get(c, StringType())) for c in header])
        return tables.read_delimited(self.spark, path, schema, multi_line=True)

    def corpus(self) -> DataFrame:
        """Articles with an id. The place is the second column beside summary, lat and lng."""

        def build() -> DataFrame:
            raw = self._raw_corpus()
            place = [c for c in raw.columns if c not in ("summary", "lat", "lng")][1]
            # ids are written with the rows and never computed again
            return raw.select(
                F.monotonically_increasing_id().alias("doc_id"),
                "date",
                F.col(place).alias("location"),
                F.col("summary").alias("text"),
            )

        return self._stage("corpus", build)

    def topic_model(self) -> PipelineModel:
        path, settings = f"{self.stage_dir}/topic-model", json.dumps(self._settings("topic-model"), sort_keys=True)
        forced = self.force and "topic-model" not in self._built
        complete = stages.is_complete(self.spark, f"{path}/metadata")
        if forced or not complete or stages.read_settings(self.spark, path) != settings:
            tables.save_model(tp.fit_topics(self.corpus(), k=self.topics), path)
            stages.write_settings(self.spark, path, settings)
        self._built.add("topic-model")
        return tables.load_model(path)

    def topic_table(self) -> DataFrame:
        """The topic of every article, by id, so that it fits whatever order the files have later."""
        build = lambda: tp.assign_topics(self.topic_model(), self.corpus()).select("doc_id", "topic")
        return self._stage("topics", build)

    def tagged(self) -> DataFrame:
        """The project's tags per article, in one pass for both datasets; a digest stands for the text."""

        def build() -> DataFrame:
            corpus = self.corpus().join(self.topic_table(), "doc_id")
            tagged = ds.tag_corpus(corpus, self.tags, self.top_n)
            return tagged.withColumn("text_key", text_key(F.col("text"))).drop("text", "topic")

        return self._stage("tagged", build)

    def articles(self) -> DataFrame:
        """Tagged articles with ``copies``; without fan-out every article counts once."""

        def build() -> DataFrame:
            if not self.fanout:
                return self.tagged().drop("text_key").withColumn("copies", F.lit(1).cast("long"))
            rows = attach_tags(self.tagged(), self.tagged(), list(self.tags), text_key_column="text_key")
            return rows.drop("text_key")

        return self._stage("articles", build)

    def articles_written_out(self) -> DataFrame:
        """The tagged articles row by row, copies repeated."""
        return repeat_copies(self.articles())

    def districted(self) -> DataFrame:
        """Articles by district, those without a match in every district; ``copies`` counts repeats."""
        return self._stage("districted", lambda: ds.districted_articles(self.articles(), self.panel()))

    def dataset(self, features: str = "Standard") -> DataFrame:
        return self._stage(f"dataset-{features}", lambda: ds.prepare_dataset(self.panel(), self.articles(), features))

    def articles_per_ipc(self, labels: DataFrame | None = None, tags: Sequence[str] = reports.CLASS_REPORT_TAGS) -> DataFrame:
        """Mean topic share per score; labels of the Standard dataset against district-weighted articles."""
        labels = self.dataset("Standard") if labels is None else labels
        weighted = ds.weighted_articles(self.articles(), self.panel(), "Improved")
        return reports.articles_per_ipc(labels, weighted, tags, weight="_weight")

    def articles_per_region(self) -> DataFrame:
        return reports.articles_per_region(self.articles(), self.panel(), weight="copies")
