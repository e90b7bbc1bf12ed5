"""The folder-level analysis against the same steps written out row by row in pandas."""

import csv
import random

import numpy as np
import pandas as pd
import pytest

from panelforecast.operators.topics import ALL_TAG_KEYWORDS
from panelforecast.plans import datasets as ds
from panelforecast.sources import stages
from panelforecast.plans.project import Project
from panelforecast.sources.tables import PANEL_COVARIATES

DISTRICTS = ["Bor South", "Juba", "Yei North"]
CLEAN = ["Bor", "Juba", "Yei"]
WORDS = "hunger food insecurity refugees displaced humanitarian conflict fighting murder rain school media health".split()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(11)
    path = tmp_path_factory.mktemp("data")
    with open(path / "food_crises_cleaned.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["year_month", "district", "country", "ipc", *PANEL_COVARIATES])
        for m in range(30):
            for d in DISTRICTS:
                if (m, d) == (7, "Juba"):
                    continue
                ipc = rng.randint(1, 5) if m % 3 == 1 and m > 3 else ""
                out.writerow([f"{2010 + m // 12}_{m % 12 + 1:02d}", d, "S", ipc, *[round(rng.gauss(0, 1), 3) for _ in PANEL_COVARIATES]])
    with open(path / "articles_summary_cleaned.csv", "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(["summary", "date", "article_location", "lat", "lng"])
        texts = [" ".join(rng.choices(WORDS, k=8)) + '\n"quoted", end' for _ in range(80)]
        for i in range(120):
            m = rng.randint(0, 29)
            place = rng.choice(["Bor town", "yei", "Nowhere", "juba and bor", ""])
            out.writerow([texts[i % 80], f"{2010 + m // 12}-{m % 12 + 1:02d}-{rng.randint(1, 28):02d}", place, 1.5, 2.5])
    return path


@pytest.fixture(scope="module")
def project(spark, folder):
    return Project(spark, str(folder), topics=12, top_n=3)


def monthly_series(frame, tags):
    return pd.DataFrame({t: frame.groupby("month")[t].mean().fillna(0).rolling(3).mean().shift(3) for t in tags})


def expected(project, folder, features):
    panel = pd.read_csv(folder / "food_crises_cleaned.csv")
    panel["date"] = pd.to_datetime(panel["year_month"], format="%Y_%m")
    panel = panel.set_index(["date", "district"])
    lags, tags = (ds.STANDARD_LAGS, ds.STANDARD_TAGS) if features == "Standard" else (ds.IMPROVED_LAGS, ds.IMPROVED_TAGS)
    for spec in lags:
        wide = panel[spec.column].unstack()
        wide = wide.rolling(spec.rolling).mean() if spec.rolling else wide
        wide = wide.diff() if spec.difference else wide
        wide = wide.dropna(how="any") if spec.dropna else wide
        panel[spec.name] = wide.shift(spec.lag).stack()
    panel = panel.sort_index(level=0)
    panel = panel.iloc[panel["ipc"].notnull().argmax():]
    corpus = project.corpus().toPandas()
    tagged = project.tagged().toPandas()[["doc_id", *tags]].merge(corpus[["doc_id", "text"]], on="doc_id")
    news = corpus.merge(tagged.drop(columns="doc_id"), how="left", on="text")
    news["month"] = pd.to_datetime(news["date"]).dt.to_period("M").dt.to_timestamp()
    if features == "Improved":
        rows = []
        for _, r in news.iterrows():
            text = "" if r["location"] is None else r["location"].lower()
            known = r["location"] is not None
            hits = [c for c in CLEAN if known and (c.lower() in text or text in c.lower())] or CLEAN
            rows += [r] * len(hits)
        news = pd.DataFrame(rows)
    news[tags] = news[tags].astype(float)
    series = monthly_series(news, tags)
    out = panel.join(series.rename_axis("date"), how="left")
    out[tags] = out[tags].fillna(0)
    out.insert(0, "const", 1.0)
    if features == "Improved":
        out = out[out["ipc_lag_1"].notnull()]
    return out[["const", *ds.feature_names(features), "ipc"]].sort_index()


@pytest.mark.parametrize("features", ["Standard", "Improved"])
def test_dataset_equals_pandas(project, folder, features):
    data = project.dataset(features)
    assert data.columns == ["date", "district", "const", *ds.feature_names(features), "ipc"]
    got = data.toPandas()
    got["date"] = pd.to_datetime(got["date"])
    got = got.set_index(["date", "district"]).sort_index().astype(float)
    want = expected(project, folder, features).astype(float)
    assert len(got) == len(want) and list(got.index) == list(want.index)
    for c in want.columns:
        np.testing.assert_allclose(got[c], want[c], atol=1e-9, err_msg=c)
    assert got[ds.STANDARD_TAGS].to_numpy().any()


def test_changed_settings_rebuild_what_depends_on_them(spark, folder, tmp_path):
    tags = {"hunger": ["hunger"], "rain": ["rain", "school"]}
    first = Project(spark, str(folder), str(tmp_path), topics=3, top_n=2)
    assert len(first.topic_model().stages[-1].clusterCenters()) == 3 and "Media" in first.tagged().columns

    def stamps():
        return {p.name: (p / "_settings.json").stat().st_mtime_ns for p in tmp_path.iterdir() if (p / "_settings.json").exists()}

    before = stamps()
    same = Project(spark, str(folder), str(tmp_path), topics=3, top_n=2)
    same.tagged()
    assert stamps() == before
    other = Project(spark, str(folder), str(tmp_path), topics=3, top_n=2, tags=tags)
    assert {"hunger", "rain"} <= set(other.tagged().columns) and "Media" not in other.tagged().columns
    after = stamps()
    assert after["tagged"] != before["tagged"] and all(after[n] == before[n] for n in ("corpus", "topic-model", "topics"))
    more = Project(spark, str(folder), str(tmp_path), topics=5, top_n=2, tags=tags)
    assert more.topic_table().agg({"topic": "max"}).first()[0] < 5
    assert len(more.topic_model().stages[-1].clusterCenters()) == 5
    last = stamps()
    assert last["corpus"] == before["corpus"] and last["topics"] != after["topics"]
    copies = [Project(spark, str(folder), str(tmp_path), topics=5, top_n=2, tags=tags, fanout=f).articles().agg({"copies": "max"}).first()[0] for f in (True, False)]
    assert copies[1] == 1


def test_changed_rows_rebuild_what_depends_on_them(spark, folder, tmp_path):
    """A row more rebuilds every stage that it reaches; the same rows in other files rebuild none."""
    import os
    import shutil

    data, out = tmp_path / "data", tmp_path / "stages"
    data.mkdir()
    names = ("food_crises_cleaned.csv", "articles_summary_cleaned.csv")
    for name in names:
        shutil.copy(folder / name, data / name)

    def built():
        project = Project(spark, str(data), str(out), topics=3, top_n=2)
        project.dataset("Standard")
        project.districted()
        return {p.name: (p / "_settings.json").stat().st_mtime_ns for p in out.iterdir() if (p / "_settings.json").exists()}, project

    first, _ = built()
    assert {"panel", "corpus", "topic-model", "topics", "tagged", "articles", "districted", "dataset-Standard"} <= set(first)
    for name in names:  # the same rows, in another order, written later
        lines = (data / name).read_text().splitlines(keepends=True)
        (data / name).write_text("".join([lines[0], *lines[:0:-1]]) if name == names[0] else "".join(lines))
        os.utime(data / name, ns=(first["panel"] + 10**10, first["panel"] + 10**10))
    again, _ = built()
    assert again == first
    panel = (data / names[0]).read_text().splitlines(keepends=True)
    cells = panel[1].rstrip("\n").split(",")
    header = panel[0].rstrip("\n").split(",")
    cells[header.index("district")] = "Another place"
    (data / names[0]).write_text("".join([*panel, ",".join(cells) + "\n"]))
    second, project = built()
    assert {n for n in first if second[n] != first[n]} == {"panel", "districted", "dataset-Standard"}
    assert project.panel().where("district = 'Another place'").count() == 1
    with (data / names[1]).open("a") as corpus:
        corpus.write("hunger and rain,2010-01-05,Bor,1,2\n")
    third, _ = built()
    assert {n for n in first if third[n] != second[n]} == set(first) - {"panel"}


def test_digest_of_rows(spark):
    rows = [(1, "a", 1.5), (2, None, None), (2, None, None), (None, "b", 0.0)]
    schema = "i int, s string, x double"
    whole = stages.content_digest(spark.createDataFrame(rows, schema))
    assert stages.content_digest(spark.createDataFrame(rows[::-1], schema).repartition(3)) == whole
    others = [rows[:3], rows + rows[:1], [*rows[:1], *rows[3:]], [(1, "a", 1.5), (2, None, None), (2, None, None), (None, "b", 0.5)]]
    digests = {stages.content_digest(spark.createDataFrame(r, schema)) for r in others}
    digests.add(stages.content_digest(spark.createDataFrame(rows, "i int, t string, x double")))
    assert len(digests) == 5 and whole not in digests
    swapped = [spark.createDataFrame([(None, "a")], "s string, t string"), spark.createDataFrame([("a", None)], "s string, t string")]
    assert stages.content_digest(swapped[0]) != stages.content_digest(swapped[1])
    assert stages.content_digest(spark.createDataFrame([], schema)) != whole


def test_stages_are_reused_and_rebuilt(spark, project, folder):
    before = project.corpus().count()
    again = Project(spark, str(folder), topics=12, top_n=3)
    assert again.topic_table().count() == before == 120
    (folder / "articles_summary_cleaned.csv").write_text("summary,date,article_location,lat,lng\nhunger,2010-01-05,Bor,1,2\n")
    assert again.corpus().count() == 120
    other = Project(spark, str(folder), stage_dir=str(folder / "other"), topics=12, force=True)
    assert other.corpus().count() == 1


def test_reports(project):
    regions = {r.district: r["count"] for r in project.articles_per_region().collect()}
    written = project.articles_written_out()
    assert regions["Not assigned"] == written.where("location = 'Nowhere' or location is null").count()
    per_class = project.articles_per_ipc()
    assert per_class.columns == ["ipc", "hunger", "refugees", "Diplomacy", "Crisis", "Security", "Education", "International", "Media", "Leadership"]
    assert 0 < per_class.count() <= 5
    assert project.districted().groupBy().sum("copies").first()[0] >= written.count()
    assert set(ALL_TAG_KEYWORDS) <= set(project.articles().columns)
