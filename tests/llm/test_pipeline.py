"""The pipeline's stages, each on what the one before it kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from attestra.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, SF)
        assert new.columns == docs.columns, name
        new = new.cache()
        before, after = {r.doc_id for r in kept.select("doc_id").collect()}, {r.doc_id for r in new.select("doc_id").collect()}
        assert after and after <= before, name
        if name in ("pii",):
            assert after == before
        kept = new
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.filter("piece = 0").count() == kept.count()


def test_odd_rows(spark):
    """Null, empty, repeated and very long rows, clashing columns and an empty table go through every stage."""
    from test_operators import ODD

    real = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(*r, "clash", "clash") for r in ODD], "doc_id long, text string, lang string, source string, n_chars long, row string, comp string")
    docs = real.withColumn("row", F.lit("clash")).withColumn("comp", F.lit("clash")).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        some, none = stage(spark, docs, SF), stage(spark, docs.limit(0), SF)
        assert none.count() == 0 and some.count() > 0, name
        if name != "packing":
            assert some.columns == docs.columns, name
        if name == "minhash_near_dedup":
            kept = [(r.doc_id, r.text) for r in some.collect() if r.text and r.text.split()]
            assert len(kept) == len(set(kept))


def test_names():
    names = [int(n[2:].split("_")[0]) for n in queries.queries()]
    assert len(names) == len(set(names)) and set(names) <= set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
