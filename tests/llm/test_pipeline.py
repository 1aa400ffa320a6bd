"""The pipeline's stages against brute force, and its queries' contracts on the smallest tables."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from tests.llm.test_llm import brute_join, brute_matches, expected_tokens

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages, rows = [], lambda df: [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        stages.append((rows(docs), docs := spark.read.parquet(str(tmp_path / str(k)))))
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    kept = {i for i, *_ in rows(stages[0][1])}
    judged = [(i in kept) == (q == 1) for i, q in labels.items() if zlib.crc32(str(i).encode()) % 4 == 2]  # rows not learnt from
    assert len(judged) > 20
    assert sum(judged) / len(judged) > 0.9
    assert {i for i, *_ in rows(stages[1][1])} == {c for _, c, _ in brute_join(stages[1][0])}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {i for i, _ in brute_matches(stages[2][0], items)}
    assert {i for i, *_ in rows(stages[2][1])} == {i for i, *_ in stages[2][0]} - bad
    assert sorted(rows(stages[3][1])) == sorted(stages[3][0])
    mixed = [r["doc_id"] for r in stages[3][1].selectExpr("*", "_metadata.file_name as f", "_metadata.row_index as k").orderBy("f", "k").collect()]
    tokens = sorted(map(tuple, stages[4][1].collect()), key=lambda r: r[1])
    assert [t[0] for t in tokens] == mixed
    assert {t[0]: (t[2], t[3]) for t in tokens} == {t[0]: (t[2], t[3]) for t in expected_tokens(stages[4][0])}
    start = 0
    for t in tokens:
        assert t[1] == start
        start += t[2]
    assert corpus_pipeline.run(spark, SF).count() == len(tokens)


def test_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    odd = [(10**6, None, None, None, None), (10**6 + 1, "", "en", "src0", 0), (None, "no id " * 40, "en", "src1", 9), (7, "a b c d e f g " * 2000, "en", "src1", 9)]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = base.limit(60).union(spark.createDataFrame(odd, base.schema))
    docs = docs.selectExpr("*", "1.5 AS score", "'p' AS position", "7 AS block", "'k' AS path", "doc_id AS rid")
    columns = docs.columns
    for start in (docs, docs.limit(0)):
        now = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{start is docs}{k}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            if k < 4:
                assert now.columns == columns
                assert now.where("score <> 1.5 OR position <> 'p' OR block <> 7 OR path <> 'k' OR NOT (rid <=> doc_id)").count() == 0
        assert (now.count() > 0) == (start is docs)


@pytest.mark.parametrize("name,columns", [
    ("op2_token_ids", ["doc_id", "start", "n_tokens", "ids_crc32"]),
    ("op3_warc_archive", ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]),
    ("op5_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op6_nearest", ["query_id", "rank", "vec_id", "score"]),
    ("op8_quality", ["doc_id", "held_out", "score", "predicted"]),
    ("op9_lm_scoring", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
])
def test_contract_columns(spark, name, columns):
    df = __spark_entry__.queries()[name](spark, SF)
    assert df.columns[: len(columns)] == columns
    assert df.count() > 0


def test_token_order_follows_file_numbers(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"word {i}", "en", "s", 1) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars long")
    for i, number in enumerate(("99998", "99999", "100000", "100001", "1000000", "00007")):
        rows.where(f"doc_id = {i}").coalesce(1).write.parquet(str(tmp_path / "one"), mode="overwrite")
        part = next((tmp_path / "one").glob("part-*.parquet"))
        (tmp_path / "docs").mkdir(exist_ok=True)
        part.rename(tmp_path / "docs" / f"part-{number}-x.parquet")
    out = corpus_pipeline.token_ids(spark, spark.read.parquet(str(tmp_path / "docs")), SF)
    assert [r["doc_id"] for r in out.orderBy("start").collect()] == [5, 0, 1, 2, 3, 4]
    clash = spark.read.parquet(str(tmp_path / "docs")).withColumn("file_name", F.lit("z")).withColumn("row_index", -F.col("doc_id"))
    assert corpus_pipeline.token_ids(spark, clash, SF).count() == 6
