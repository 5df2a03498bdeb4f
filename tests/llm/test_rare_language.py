"""The quality classifier's thresholds for languages with few trusted documents."""

from pyspark.sql import functions as F

from cinderplan.llm import quality_lm
from tests.conftest import DATA


def test_language_with_one_trusted_document(spark):
    labels = spark.read.parquet(f"{DATA}/../sf0.01/labels.parquet")
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    fr = labels.join(docs.where("lang = 'fr' and text <> ''").select("doc_id"), "doc_id")
    one = fr.where("quality = 1 and coalesce(toxic, 0) = 0").agg(F.min("doc_id")).first()[0]
    train = labels.join(fr.select("doc_id"), "doc_id", "left_anti").unionByName(labels.where(F.col("doc_id") == one))
    got = {(r.quality, r.kept): r["count"] for r in quality_lm.judged(docs, train).join(fr.where(F.col("doc_id") != one), "doc_id").groupBy("quality", "kept").count().collect()}
    assert got.get((1, True), 0) > 0.9 * (got.get((1, True), 0) + got.get((1, False), 0)), got
