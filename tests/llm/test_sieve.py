import random

from pyspark.sql import functions as F

from corpus_pipeline import drop_near_copies
from loomspan.llm.sieve import bitmap, sieved


def test_a_bitmap_loses_no_key_and_lets_few_others_through(spark):
    ids = spark.range(0, 90000, 3).withColumnRenamed("id", "doc_id")
    rows = spark.range(0, 90000).withColumnRenamed("id", "doc_id").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    out = sieved(rows, "doc_id", bitmap(ids.union(ids), "doc_id"))
    assert out.columns == ["doc_id", "_met"] and out.count() == 90001
    assert out.where("_met and doc_id % 3 = 0").count() == 30000
    assert out.where("_met").count() < 30000 + 600
    assert sieved(rows, "doc_id", bitmap(ids.limit(0), "doc_id")).where("_met").count() == 0
    names = sieved(rows.select(F.concat(F.lit("k"), "doc_id").alias("k")), "k", bitmap(ids.select(F.concat(F.lit("k"), "doc_id").alias("k")), "k"))
    assert names.where("_met and substr(k, 2) % 3 = 0").count() == 30000


def written(spark):
    return sum(s.shuffleWriteBytes() for s in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)))


def test_texts_that_are_no_copies_are_not_shuffled(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: " ".join(rng.randbytes(6).hex() for _ in range(1500))
    rows = [(i, text()) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [rows[7], (None, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before, was = written(spark), spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = drop_near_copies(spark, spark.read.parquet(str(tmp_path / "docs")), "").select("doc_id").collect()
    finally:
        spark.conf.set(key, was)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == list(range(300)) and len(got) == 301
    assert written(spark) - before < sum(len(t) for _, t in rows) / 3
