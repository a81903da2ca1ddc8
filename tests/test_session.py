import tracemalloc
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomspan.llm import text as T
from loomspan.session import ROW_GROUP, clear, discard, durable, scratch, shared_folder, small_batches, spread


def test_tables_are_kept_until_they_are_deleted(spark):
    one, two = durable(spark.range(5), "one"), durable(spark.range(3), "two")
    discard(one)
    assert two.count() == 3
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        one.count()
    assert durable(spark.range(0), "none").count() == 0
    clear(spark)
    with pytest.raises(Exception, match="does not exist|FAILED_READ_FILE|PATH_NOT_FOUND"):
        two.count()
    assert scratch(spark, "x") != scratch(spark, "x")


def test_the_batch_setting_is_put_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with pytest.raises(ValueError), small_batches(spark, 7):
        assert spark.conf.get(key) == "7"
        raise ValueError
    assert spark.conf.get(key) == before


def test_a_cluster_needs_a_shared_folder():
    cluster = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_folder(cluster(master))


def test_small_inputs_of_few_files_are_spread(spark, tmp_path):
    path = str(tmp_path / "one file")
    spark.range(100).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    assert spread(df).rdd.getNumPartitions() == cores and spread(df).count() == 100
    made = spark.range(100).coalesce(1)
    assert spread(made).rdd.getNumPartitions() == 1
    spark.range(100).repartition(8).write.parquet(path + "s")
    many = spark.read.parquet(path + "s")
    assert spread(many).sameSemantics(many)


def test_row_groups_of_long_texts_are_small(spark):
    rows = spark.range(0, 4000, 1, 1).select("id", F.concat(*(F.sha2(F.concat(F.col("id"), F.lit(f" {i}")), 512) for i in range(60))).alias("text"))
    table = durable(rows, "long")
    sizes = []
    for file in table.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file:").replace("///", "/")).metadata
        sizes += [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert sum(sizes) > 4 * ROW_GROUP and max(sizes) < 2 * ROW_GROUP
    assert table.count() == 4000 and table.exceptAll(rows).isEmpty()
    discard(table)


def test_words_of_a_chunk_need_little_memory():
    column = pa.array(["some words of a text " * 50] * 1000)
    tracemalloc.start()
    hashes, first, end, place = T.words(column)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 250_000 and place[-1] == 250_000 and (end > first).all()
    assert peak < 24 << 20
