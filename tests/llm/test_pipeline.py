"""The pipeline's stages against plain Python versions on a small table."""

import brute
import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodemill.llm import queries

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "dedup_lines", "dedup_documents", "decontaminate", "encode"]
    language, lines, groups, clean, encode = (f for _, f in corpus_pipeline.STAGES)
    odd = docs.unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "1 2 3", None, None, 5)], docs.schema))
    assert {r["doc_id"] for r in odd.select("doc_id").subtract(language(spark, odd, SMALL).select("doc_id")).collect()} == {9001, 9002}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    gone = {r[0]: r[3] for r in brute.dropped_lines(rows)}
    want = {k: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[k]) for k, t in rows}
    got = {r["doc_id"]: r["text"] for r in lines(spark, docs, SMALL).collect()}
    assert got == {k: t for k, t in want.items() if t.strip() or not gone[k]}
    first = {r[0] for r in brute.jaccard_groups(rows) if r[0] == r[2]}
    assert {r["doc_id"] for r in groups(spark, docs, SMALL).collect()} == first
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert {r["doc_id"] for r in clean(spark, docs, SMALL).collect()} == {r[0] for r in brute.hit_words(rows, items) if not r[-1]}
    assert encode(spark, docs, SMALL).where(F.col("decoded") != "").count() == len(rows)
    for stage in (language, lines, groups, clean):
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_stages_on_empty_and_unlabelled_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    # No language was ever learned: every document is rejected.
    none = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.STAGES[0][1](spark, none, SMALL).count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows and ids, a long text, clashing extra columns: no crash, and each row's fate is the defined one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumns({"key": F.lit(1), "label": F.lit("x"), "tokens": F.lit(None).cast("int")})
    long = " ".join(f"the and of {k}" for k in range(60_000))
    odd = [(None, None, None, None, None), (None, "the and of that the in of a", None, None, None), (9001, "", "en", "s", 0), (9002, "of the and in that is", "en", None, None), (9002, "of the and in that is", "en", None, None), (9003, "Of the and in that is", None, "s", 22), (9004, long, "en", "s", len(long)), (9005, "½ 12 !", None, None, None)]
    rows = docs.unionByName(spark.createDataFrame([(*r, 2, "y", 3) for r in odd], docs.schema)).cache()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, rows, SMALL)
        if name != "encode":
            assert got.columns == rows.columns
            kept[name] = [(r["doc_id"], r["text"]) for r in got.where("doc_id is null or doc_id >= 9000").select("doc_id", "text").collect()]
        else:
            assert got.count() == rows.count()
            back = {r["doc_id"]: r["decoded"] for r in got.where("doc_id >= 9000").select("doc_id", "decoded").collect()}
            assert back[9001] == "" and back[9004] == long and back[9003] == "Of the and in that is"
    ids = lambda name: sorted(kept[name], key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None))
    assert [k for k, _ in ids("language")] == [None, 9002, 9002, 9003, 9004]
    # Null and empty texts stay as they are; equal lines stay in the first document alone, which repeated rows are together.
    assert [(k, len(t) if t is not None else None) for k, t in ids("dedup_lines")] == [(None, None), (None, 27), (9001, 0), (9002, 21), (9002, 21), (9004, len(long)), (9005, 6)]
    assert [(k, t is None) for k, t in ids("dedup_documents")] == [(None, True), (None, False), (9001, False), (9002, False), (9004, False), (9005, False)]
    assert len(kept["decontaminate"]) == len(odd)


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert 100 < got.count() < 200


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    got = queries.queries()[name](spark, "/root/testdata/sf0.01").toPandas()
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.01/{table}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert sorted(map(tuple, got[names].values.tolist())) == sorted(map(tuple, want[names].values.tolist()))
