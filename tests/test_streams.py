"""Sessions, retention and caches of streams, against the batch operators over all rows."""

import itertools
import random

from pyspark.sql import functions as F

from loomspan.operators import lines as L
from loomspan.operators import ranking as R
from loomspan.operators import spans as S
from loomspan.sources.caches import Cache
from loomspan.streaming.retention import retained
from loomspan.streaming.sessions import merged, sentences

NAMES = itertools.count()


def streamed(spark, folder, batches, schema, make):
    """Rows that a stream gives for batches, one after the other."""
    name, path = f"out{next(NAMES)}", f"{folder}/in{next(NAMES)}"
    spark.createDataFrame(batches[0], schema).coalesce(1).write.parquet(path)
    query = make(spark.readStream.schema(schema).parquet(path)).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{folder}/c{name}").start()
    try:
        query.processAllAvailable()
        for batch in batches[1:]:
            spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(path)
            query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name).collect()


def shuffled(rng, rows, delay, n):
    """Rows dealt to n batches so that none comes later than the delay after a row that was sent before."""
    order = sorted(rows, key=lambda r: r[1] + rng.uniform(0, delay))
    size = -(-len(order) // n)
    return [order[i : i + size] for i in range(0, len(order), size)]


def test_spans_in_any_order_within_the_delay_are_merged_as_in_a_batch(spark, tmp_path):
    rng = random.Random(5)
    schema = "media string, start double, end double"
    rows = [(rng.choice("ab"), s := float(rng.randrange(0, 3000)), s + rng.choice([0.5, 2.0, 8.0])) for _ in range(300)]
    want = sorted((r.media, r.start, r.end, r.n) for r in S.merge_spans(spark.createDataFrame(rows, schema), ["media"], 5.0, aggregates=[F.count(F.lit(1)).alias("n")]).collect())
    batches = [*shuffled(rng, rows, 60, 3), [("z", 90000.0, 90001.0)], [("z", 180000.0, 180001.0)]]
    got = [r for r in streamed(spark, tmp_path, batches, schema, lambda df: merged(df, 5.0, "1 minute")) if r.media != "z"]
    assert sorted((r.media, r.start, r.end, r.n) for r in got) == want


def test_a_late_and_earlier_span_is_one_of_its_own(spark, tmp_path):
    schema = "media string, start double, end double"
    batches = [[("m", 100.0, 105.0)], [("m", 10.0, 12.0)], [("z", 90000.0, 90001.0)], [("z", 180000.0, 180001.0)]]
    got = streamed(spark, tmp_path, batches, schema, lambda df: merged(df, 1.0, "10 minutes"))
    assert sorted((r.start, r.end, r.n) for r in got if r.media == "m") == [(10.0, 12.0, 1), (100.0, 105.0, 1)]


def test_sentences_in_any_order_within_the_delay_are_those_of_a_batch(spark, tmp_path):
    rng = random.Random(6)
    schema = "media string, start double, end double, text string"
    rows, at = [], {"a": 0.0, "b": 3.0}
    for i in range(240):
        m = rng.choice("ab")
        at[m] += rng.choice([0.3, 0.4, 0.5, 4.0])
        rows.append((m, at[m], at[m] + 0.25, f"w{i}" + rng.choice(["", "", "", ".", "?"])))
    want = sorted((r.media, r.start, r.end, r.text, r.n) for r in L.sentences(spark.createDataFrame(rows, schema), ["media"], 2.0, "text").collect())
    batches = [*shuffled(rng, rows, 20, 3), [("z", 90000.0, 90001.0, "x")], [("z", 180000.0, 180001.0, "x")]]
    got = [r for r in streamed(spark, tmp_path, batches, schema, lambda df: sentences(df, 2.0, "20 seconds")) if r.media != "z"]
    assert sorted((r.media, r.start, r.end, r.text, r.n) for r in got) == want


def test_retention_after_each_batch_is_that_of_all_rows_so_far(spark, tmp_path):
    rng = random.Random(7)
    schema = "key string, at double, id string, size long"
    rows = [(rng.choice("ab"), float(rng.randrange(0, 500)), f"e{i}", rng.randint(0, 40)) for i in range(90)]
    batches = [rows[i : i + 30] for i in range(0, 90, 30)]
    for n in (1, 3):
        log = streamed(spark, tmp_path, batches[:n], schema, lambda df: retained(df, "key", 100, 200.0, "1 day"))
        last = {}
        for r in log:  # an entry that has gone never comes back
            assert last.get((r.key, r.id)) is not False or not r.kept
            last[r.key, r.id] = r.kept
        so_far = spark.createDataFrame([r for b in batches[:n] for r in b], schema)
        young = so_far.join(so_far.groupBy("key").agg(F.max("at").alias("newest")), "key").where("at >= newest - 200")
        want = {(r.key, r.id) for r in R.keep_newest(young, ["key"], "size", 100, F.desc("at"), F.desc("id")).collect()}
        assert {k for k, kept in last.items() if kept} == want and len(last) == 30 * n


def test_entries_of_a_silent_key_grow_old(spark, tmp_path):
    schema = "key string, at double, id string, size long"
    batches = [[("a", 10.0, "x", 1)], [("b", 5000.0, "y", 1)], [("b", 9000.0, "y", 1)]]
    log = streamed(spark, tmp_path, batches, schema, lambda df: retained(df, "key", 100, 60.0, "10 seconds"))
    assert [(r.id, r.kept) for r in log if r.key == "a"] == [("x", True), ("x", False)]


ENTRIES = "fingerprint string, stream int, settings string, key string, answer string"


def test_caches_append_once_prune_and_compact(spark, tmp_path):
    cache = Cache(str(tmp_path / "cache"), spark.createDataFrame([], ENTRIES).schema)
    assert cache.read(spark).collect() == [] and cache.compact(spark) is None
    first = [("f1", 0, "s", "a", "1"), ("f1", 0, "s", "b", "1"), ("f2", 1, "s", "a", "1")]
    second = [("f1", 0, "s", "b", "2"), ("f3", 0, "t", "c", "2"), (None, 0, "t", "n", "2")]
    cache.append(spark.createDataFrame(first, ENTRIES), 0)
    for _ in range(2):  # run twice, as after a lost driver
        cache.append(spark.createDataFrame(second, ENTRIES), 1)
    want = sorted([first[0], first[2], *second], key=repr)
    rows = lambda: sorted((tuple(r) for r in cache.read(spark).collect()), key=repr)
    assert rows() == want
    assert spark.read.parquet(f"{cache.path}/batches").count() == 6
    asked = cache.read(spark).where("fingerprint = 'f1' AND stream = 0 AND settings = 's'")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "fingerprint" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert all("fingerprint=f1" in f for f in asked.select(F.input_file_name().alias("f")).distinct().toPandas().f if f)
    assert cache.compact(spark) == 1 and rows() == want
    assert cache.compact(spark) == 1 and rows() == want  # nothing new
    cache.append(spark.createDataFrame([("f1", 0, "s", "a", "3")], ENTRIES), 2)
    assert rows() == sorted([("f1", 0, "s", "a", "3"), first[2], *second], key=repr)
    (tmp_path / "cache" / "whole" / "upto=9").mkdir()  # a compaction that was lost
    assert len(rows()) == 5
    assert cache.compact(spark) == 2 and len(rows()) == 5


def test_a_stream_fills_a_cache(spark, tmp_path):
    cache = Cache(str(tmp_path / "cache"), spark.createDataFrame([], ENTRIES).schema)
    for i in range(2):
        spark.createDataFrame([("f", i, "s", "k", str(i))], ENTRIES).write.mode("append").parquet(str(tmp_path / "in"))
        cache.append_stream(spark.readStream.schema(ENTRIES).parquet(str(tmp_path / "in")), str(tmp_path / "c")).awaitTermination()
    assert sorted(r.stream for r in cache.read(spark).collect()) == [0, 1]
