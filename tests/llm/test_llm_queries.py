"""The registered document queries against SQL, and the pipeline against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, duck
from panelforecast.llm import language, mixing, queries, secrets, simhash
from panelforecast.llm.common import in_written_order, read

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op3_sentencepiece": ["doc_id", "ids", "n_tokens", "n_bytes", "decoded_sha256"],
    "op4_source_mixing": ["doc_id", "source", "source_row", "block", "slot"],
    "op5_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op6_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op7_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_html_extraction": ["page_id", "url", "text", "n_chars"],
    "op9_weighted_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op10_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op12_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op13_importance_resampling": ["doc_id", "n_features", "weight", "score", "rank"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), queries.ORACLES[name], duck(sf_dir)) == ""


def test_mixing_sql_holds_for_unequal_sources(spark, sf_dir, tmp_path):
    sizes = {"a": 900, "b": 250, None: 40, "d": 37, "e": 3}
    rows = [(i, "x", "en", s, 1) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck(sf_dir)
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert compare(queries.op4_source_mixing(spark, str(tmp_path)), queries.ORACLES["op4_source_mixing"], con) == ""


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_has_a_row_for_every_row(spark, sf_dir, name):
    table = {"op8_html_extraction": "pages", "op10_embedding_dedup": "embeddings", "op12_url_filter": "pages"}.get(name, "documents")
    got = entry.queries()[name](spark, sf_dir)
    assert got.columns == COLUMNS[name]
    key = got.columns[0]
    assert sorted(r[0] for r in got.select(key).collect()) == sorted(r[0] for r in read(spark, sf_dir, table).select(key).collect())


def test_secret_query_against_brute_force(spark, sf_dir):
    from test_llm_operators import plain_base

    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    for r in entry.queries()["op5_secret_scan"](spark, sf_dir).collect():
        base = plain_base(texts[r.doc_id] or "")
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)]
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == [x for x in listed.split(",") if x]


def test_simhash_query_against_brute_force(spark, sf_dir):
    from test_llm_operators import plain_simhash, union_find

    rows = read(spark, sf_dir, "documents").collect()
    marks = {r.doc_id: plain_simhash(r.text) for r in rows}
    ids = sorted(marks)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 3])
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in entry.queries()["op1_simhash"](spark, sf_dir).collect()}
    assert got == {i: (marks[i], want[i]) for i in ids}


# ---- the pipeline


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What every stage was given and what it returned."""
    docs, out = read(spark, sf_dir, "documents"), []
    for name, apply in corpus_pipeline.STAGES:
        result = corpus_pipeline.lean_stage(apply(spark, docs, sf_dir), name)
        out.append((name, docs.collect(), result.collect(), result.columns))
        docs = result
    return out


def test_stages_are_those_asked_for(stages):
    assert [n for n, *_ in stages] == ["language_id", "near_duplicates", "secret_scan", "source_mixing", "token_ids"]
    for _, _, _, columns in stages[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_stage_keeps_what_has_a_language(spark, stages):
    _, before, after, _ = stages[0]
    model = language.fit([r.text[:1900] for r in before], [r.lang for r in before])
    _, scores = language.Tagger(model).texts([r.text for r in before])
    clear = {r.doc_id for r, s in zip(before, scores) if s > 0.6}
    assert clear <= {r.doc_id for r in after}
    text = {r.doc_id: r.text for r in before}
    assert all(r.text == text[r.doc_id] for r in after)


def test_near_copy_stage_keeps_the_smallest_of_each_group(stages):
    from test_llm_operators import plain_simhash, union_find

    _, before, after, _ = stages[1]
    marks = {r.doc_id: plain_simhash(r.text) for r in before}
    ids = sorted(marks)
    groups = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 3])
    assert sorted(r.doc_id for r in after) == sorted(set(groups.values()))


def test_near_copy_stage_with_shared_ids_and_equal_rows(spark):
    rng = __import__("random").Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    a, b, c, d = (text(200) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (3, c), (None, d), (None, d), (None, a), (5, ""), (4, None), (None, " "), (6, b + " one"), (7, b)]
    frame = spark.createDataFrame([(i, t, "en", f"s{k % 2}", k // 3, "x", True) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, id string, stays boolean")
    got = corpus_pipeline.near_duplicates(spark, frame, "")
    assert got.columns == frame.columns
    assert sorted(((r.doc_id or 0), r.text or "") for r in got.collect()) == sorted([(1, a), (2, b), (3, c), (0, d), (4, "")])
    assert {(r.source, r.n_chars) for r in got.collect() if r.doc_id == 3} == {("s0", 1)}  # the smallest of the three rows
    distinct = spark.createDataFrame([(1, a), (2, a), (2, b)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.drop_near_duplicates(distinct).collect()) == [(1, a), (2, b)]


def test_rows_of_one_key_may_be_most_of_the_table(spark):
    rows = [(7, "the same words " * 20)] * 3000 + [(i, f"text {i} of its own {i * 37}") for i in range(100)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert sum(r.doc_id == 7 and r.text.startswith("the") for r in kept) == 1


def test_secret_stage_masks_all_and_only_secrets(stages):
    from test_llm_operators import plain_base

    _, before, after, _ = stages[2]
    got = {r.doc_id: r for r in after}
    assert len(got) == len(before)
    for r in before:
        base = plain_base(r.text)
        new = got[r.doc_id]
        if not base:
            assert new.text == r.text or "[SECRET]" in new.text  # a random token
        assert not any(r.text[s:e] in new.text for s, _, e in base)
        assert new.n_chars == len(new.text) or "[SECRET]" not in new.text


def test_mixing_stage_reorders_and_keeps(spark, stages):
    _, before, after, _ = stages[3]
    assert sorted(map(tuple, before)) == sorted(map(tuple, after))
    frame = spark.createDataFrame(before, "doc_id long, text string, lang string, source string, n_chars long")
    order = [r.doc_id for r in mixing.pfair_mix(frame).orderBy("slot", "source_row").collect()]
    assert sorted(order) == sorted(r.doc_id for r in after)


def test_mixing_stage_writes_the_schedule_in_order(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    want = [r.doc_id for r in mixing.pfair_mix(docs).orderBy("slot", "source_row").collect()]
    assert [r.doc_id for r in corpus_pipeline.source_mixing(spark, docs, sf_dir).collect()] == want


def test_token_stage_decodes_to_its_input(stages):
    _, before, after, _ = stages[4]
    want = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in before}
    assert {r.doc_id: r.decoded_sha256 for r in after} == want


def test_final_table_has_the_order_of_the_mixture(spark, stages):
    _, mixed, _, _ = stages[3]
    frame = spark.createDataFrame(mixed, "doc_id long, text string, lang string, source string, n_chars long")
    want = [r.doc_id for r in mixing.pfair_mix(frame).orderBy("slot", "source_row").collect()]
    _, _, after, _ = stages[4]
    assert [r.doc_id for r in sorted(after, key=lambda r: r.place)] == want
    assert sorted(r.place for r in after) == list(range(len(after)))


def test_written_order_of_many_files_and_of_no_file(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("n"), F.xxhash64("id").alias("rows"), F.lit(1).alias("part"))
    rows.repartitionByRange(12, "rows").sortWithinPartitions("rows").write.option("maxRecordsPerFile", 100).parquet(f"{tmp_path}/t")
    placed = in_written_order(spark.read.parquet(f"{tmp_path}/t"), "place")
    assert placed.columns == ["n", "rows", "part", "place"]
    got = placed.orderBy("place").collect()
    assert [r.place for r in got] == list(range(5000)) and [r["rows"] for r in got] == sorted(r["rows"] for r in got)
    made = spark.createDataFrame([(i,) for i in range(50)], "n int")
    assert sorted(r.place for r in in_written_order(made, "place").collect()) == list(range(50))
    assert in_written_order(made.where("n < 0"), "place").collect() == []


def test_pipeline_survives_hostile_tables(spark, tmp_path):
    rows = [(1, "a plain text", "en", "s", 12), (1, "a plain text", "en", "s", 12), (2, None, None, None, None), (None, "no id here", "en", None, 9), (3, "", "de", "t", 0), (4, "token = abcdefghijklmnop", "en", "t", 24)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/some/documents.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/some").collect()
    assert {r.doc_id for r in got} == {1, None, 4}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_entry_registers_all(spark):
    names = list(entry.queries())
    assert [n for n in names if re.match(r"op\d+_", n)] == sorted([*COLUMNS, "op11_embedding_whitening"], key=lambda n: int(re.search(r"\d+", n)[0])) and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()
