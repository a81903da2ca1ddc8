"""Registered queries of timelines of any length, sliced sound, models with a memo, streams run to their end, and caches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators import models as P
from loomspan.operators import spans as S
from loomspan.queries import BIN, EV, LAST, ORACLES, SECOND, events, merged_sql, query, table, two_sides
from loomspan.session import scratch
from loomspan.sources import sinks as L
from loomspan.sources import sound as K
from loomspan.sources import subtitles as Q
from loomspan.sources.caches import Cache
from loomspan.streaming.retention import retained
from loomspan.streaming.sessions import merged, sentences

DAY = 86400 * SECOND

# ---- timelines of any length -----------------------------------------------------------------------------------------

LENGTHS = "a + (b - a) * CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 60 WHEN 3 THEN 1000 ELSE 50000 END"


@query(f"WITH {EV}, l AS (SELECT id, media, term, a, {LENGTHS} AS b FROM e), j AS (SELECT x.id, count(*) AS n FROM l x JOIN l y ON x.media = y.media AND x.a < y.b AND y.a < x.b WHERE x.term = 'click' AND y.term = 'purchase' GROUP BY x.id) SELECT * FROM j")
def jn_overlap_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases that they meet, of lengths from minutes to years."""
    times = F.element_at(F.array(*map(F.lit, (1, 1, 60, 1000, 50000))), (F.col("id") % 5 + 1).cast("int"))
    rows = events(spark, sf_dir).select("id", "media", "term", "start", (F.col("start") + (F.col("end") - F.col("start")) * times).alias("end"))
    right = rows.where("term = 'purchase'").select("media", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return S.overlap_join(rows.where("term = 'click'"), right, ["media"], 60 * SECOND).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


@query(merged_sql(f"a - reached >= {3600 * SECOND}", reach=LAST))
def m5_read_groups_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir), ["media"], 3600 * SECOND, reach="last", bucket=DAY)


@query(ORACLES["m9_repeated_lines"])
def m9_repeated_lines_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.repeated(events(spark, sf_dir), ["media"], "term", DAY, tie=["id"], bucket=2 * DAY)


@query(ORACLES["an_running_reach"])
def an_running_reach_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_reach(events(spark, sf_dir), ["media"], ["id"], bucket=DAY).select("id", "reach", F.col("number").cast("int").alias("number"))


@query(ORACLES["jn_snap_speech"])
def jn_snap_speech_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.next_start(flags, found, ["media"], "start", "r_start", "next", bucket=DAY).select("id", "next")


@query(ORACLES["jn_uncovered"])
def set_except_time_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return S.difference(rows.where("term = 'view' and end > start"), rows.where("term <> 'view'"), ["media"], "id", 30 * SECOND, BIN, bucket=DAY).select("id", "start", "end")


# ---- sound and models ------------------------------------------------------------------------------------------------

FRAMES = 64  #: components of a vector, here samples of a slice


@query("""WITH s AS (SELECT label, vec_id, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) * 64 AS o FROM embeddings),
x AS (SELECT label, o + i - 1 AS at, embedding[i]::DOUBLE AS v FROM s, range(1, 65) t(i)),
q AS (SELECT vec_id, label, greatest(o - 10, 0) AS lo, greatest(o - 10, 0) + 150 AS hi FROM s WHERE vec_id % 7 = 0)
SELECT q.vec_id, count(*)::INT AS n, sum(floor(v * 1000))::BIGINT AS total FROM q JOIN x ON x.label = q.label AND x.at >= lo AND x.at < hi GROUP BY q.vec_id""")
def src_sound_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as its sound, a slice each; spans of 150 samples, from ten before every seventh vector."""
    rows = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select(F.col("label").alias("media"), "vec_id", F.col("embedding").alias("samples"))
    slices = S.running_reach(rows.withColumns({"start": F.col("vec_id"), "end": F.col("vec_id")}), ["media"], bucket=1000).select("media", "vec_id", (F.col("number") - 1).alias("slice"), "samples")
    first = F.greatest(F.col("slice") * FRAMES - 10, F.lit(0))
    spans = slices.where("vec_id % 7 = 0").select("media", "vec_id", first.alias("first"), (first + 150).alias("last"))
    heard = K.read(slices.drop("vec_id"), spans, "vec_id", FRAMES)
    total = F.aggregate("samples", F.lit(0).cast("long"), lambda s, x: s + F.floor(x.cast("double") * 1000))
    return heard.select("vec_id", F.size("samples").alias("n"), total.alias("total"))


@query()
def fn_model_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loud parts of every vector, through a memo that half of them have filled before."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    memo = scratch(spark, "memo")
    P.remembered(rows.where("vec_id % 2 = 0"), "vec_id", "embedding", P.LoudParts, "first int, last int", memo)
    return P.remembered(rows, "vec_id", "embedding", P.LoudParts, "first int, last int", memo)


# ---- reports ---------------------------------------------------------------------------------------------------------


def film_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as films; their orders as intervals, and as detections those of high priority."""
    id, none = F.col("c_custkey").alias("media"), F.lit(None).cast("string")
    films = table(spark, sf_dir, "customer").select(id, F.concat(F.lit("/v/"), "c_custkey").alias("path"), (F.col("c_custkey") * 1000).alias("size"), F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).alias("oshash"), (F.col("c_nationkey") * 60 + 0.5).alias("duration"), F.lit(1).alias("index"), F.lit("aac").alias("codec"), F.lit(6).alias("channels"), none.alias("language"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("media"), (F.col("o_orderkey") * 2).cast("double").alias("start"), (F.col("o_orderkey") * 2 + 1.25).alias("end"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("term"), F.lit("listed").alias("category"), F.lit(0.5).alias("confidence"))
    return L.full_reports(films, orders.select("media", "start", "end"), orders.where("text LIKE '1%'"), {"mode": "mute"})


@query("""WITH o AS (SELECT o_custkey AS media, (o_orderkey * 2)::DOUBLE AS start, (o_orderkey * 2 + 1.25)::DOUBLE AS "end", o_orderpriority AS text, o_orderstatus AS term FROM orders),
i AS (SELECT media, string_agg('{"start":' || start || ',"end":' || "end" || '}', ',' ORDER BY start, "end") AS l FROM o GROUP BY media),
d AS (SELECT media, string_agg('{"start":' || start || ',"end":' || "end" || ',"text":"' || text || '","term":"' || term || '","category":"listed","confidence":0.5}', ',' ORDER BY start, "end", text, term) AS l FROM o WHERE text LIKE '1%' GROUP BY media)
SELECT c_custkey AS media, '{"schema_version":1,"input":{"path":"/v/' || c_custkey || '","size":' || c_custkey * 1000 || CASE WHEN c_custkey % 2 = 0 THEN ',"oshash":"' || lower(c_mktsegment) || '"' ELSE '' END || ',"duration":' || (c_nationkey * 60 + 0.5)::DOUBLE
  || '},"audio_stream":{"index":1,"codec":"aac","channels":6},"settings":{"mode":"mute"},"detections":[' || coalesce(d.l, '') || '],"intervals":[' || coalesce(i.l, '') || ']}' AS json
FROM customer LEFT JOIN i ON i.media = c_custkey LEFT JOIN d ON d.media = c_custkey""")
def snk_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return film_reports(spark, sf_dir)


@query("""SELECT c_custkey AS media, CASE WHEN c_custkey % 7 = 0 THEN 'no report' WHEN c_custkey % 5 = 0 THEN 'another version' WHEN c_custkey % 3 = 0 THEN 'incomplete' END AS problem,
CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN '/v/' || c_custkey END AS path, CASE WHEN c_custkey % 7 <> 0 THEN (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) ELSE 0 END::INT AS n_intervals FROM customer""")
def src_full_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports read back, some of them edited: cut short, of another version, or without their input."""
    json, n = F.col("json"), F.col("media")
    lost = F.when(n % 3 == 0, F.regexp_replace(json, r'"path":"[^"]*",', "")).otherwise(json)
    other = F.when(n % 5 == 0, F.regexp_replace(lost, '"schema_version":1', '"schema_version":2')).otherwise(lost)
    edited = F.when(n % 7 == 0, F.substr(other, F.lit(5))).otherwise(other)
    return Q.read_reports(film_reports(spark, sf_dir).select("media", edited.alias("json"))).select("media", "problem", "path", "n_intervals")


# ---- streams and caches ----------------------------------------------------------------------------------------------

FAR = 4102444800.0  #: a time after all rows


STATES = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def to_the_end(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over all that its source has, with a state store that its states need and a partition a core; the session's settings are put back."""
    wanted = STATES | {"spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))}
    before = {key: spark.conf.get(key) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def through_stream(spark: SparkSession, rows: DataFrame, make: Callable[[DataFrame], DataFrame], ends: tuple[float, ...] = (FAR, FAR + 1e8)) -> DataFrame:
    """What a stream gives for rows that it reads from files, and then for rows of media -1 at later times, which let its watermark pass the others."""
    source, out, checkpoint = (scratch(spark, name) for name in ("source", "out", "checkpoint"))
    last = [rows.limit(0).unionByName(spark.createDataFrame([(-1, t, t)], "media long, start double, end double"), allowMissingColumns=True).select(*rows.columns) for t in ends]
    for part in (rows, *last):
        part.write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(rows.schema).parquet(source))
        to_the_end(spark, stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out).where("media >= 0")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in seconds, with the event's name as text; every fifth ends a sentence."""
    text = F.concat("term", F.when(F.col("id") % 5 == 0, ".").otherwise(""))
    return events(spark, sf_dir).select(F.col("media").cast("long").alias("media"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), text.alias("text"))


@query(f"""WITH {EV}, p AS (SELECT *, max(b) OVER (PARTITION BY media ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e),
g AS (SELECT *, sum((reached IS NULL OR a - reached >= {600 * SECOND})::INT) OVER (PARTITION BY media ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT media, min(a) / 1000000.0::DOUBLE AS start, max(b) / 1000000.0::DOUBLE AS "end", count(*) AS n FROM g GROUP BY media, i""")
def st_merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of spans, merged within ten minutes."""
    return through_stream(spark, timed(spark, sf_dir).select("media", "start", "end"), lambda df: merged(df, 600.0))


@query(f"""WITH {EV}, w AS (SELECT media, a, b, term || CASE WHEN id % 5 = 0 THEN '.' ELSE '' END AS t FROM e),
p AS (SELECT *, lag(b) OVER o AS l, lag(t) OVER o AS s FROM w WINDOW o AS (PARTITION BY media ORDER BY a, b, t)),
g AS (SELECT *, sum((l IS NULL OR a - l >= {7200 * SECOND} OR s LIKE '%.')::INT) OVER (PARTITION BY media ORDER BY a, b, t ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT media, min(a) / 1000000.0::DOUBLE AS start, arg_max(b, (a, b, t)) / 1000000.0::DOUBLE AS "end", string_agg(t, ' ' ORDER BY a, b, t) AS text, count(*) AS n FROM g GROUP BY media, i""")
def st_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of words, closed by a full stop or two hours of silence."""
    return through_stream(spark, timed(spark, sf_dir), lambda df: sentences(df, 7200.0))


@query(f"""WITH {EV}, s AS (SELECT media, id::VARCHAR AS id, a, round(conf * 10)::BIGINT AS size FROM e),
k AS (SELECT *, sum(size) OVER (PARTITION BY media ORDER BY a DESC, id DESC ROWS UNBOUNDED PRECEDING) AS total FROM s) SELECT media, id, size FROM k WHERE total <= 5000""")
def st_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events of each user within 5,000 units, kept by state."""
    rows = events(spark, sf_dir).select(F.col("media").cast("long").alias("media"), (F.col("start") / 1e6).alias("at"), F.col("id").cast("string").alias("id"), F.round(F.col("conf") * 10).cast("long").alias("size"))
    source, out, checkpoint = (scratch(spark, name) for name in ("source", "out", "checkpoint"))
    rows.write.parquet(source)
    stream = retained(spark.readStream.schema(rows.schema).parquet(source), "media", 5000, 90 * 86400.0)
    to_the_end(spark, stream, out, checkpoint)
    log = spark.read.schema(stream.schema).parquet(out)
    return log.groupBy("media", "id").agg(F.bool_and("kept").alias("kept"), F.any_value("size").alias("size")).where("kept").select("media", "id", "size")


@query("""SELECT c_mktsegment AS fingerprint, (c_nationkey % 3)::INT AS stream, 's' AS settings, c_custkey AS key,
CASE WHEN c_custkey % 7 = 0 THEN 'third' WHEN c_custkey % 3 = 0 THEN 'second' ELSE 'first' END AS answer FROM customer""")
def snk_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers for customers in three batches, the second written twice, with a compaction before the third."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("fingerprint"), (F.col("c_nationkey") % 3).cast("int").alias("stream"), F.lit("s").alias("settings"), F.col("c_custkey").alias("key"))
    of = lambda answer, every: rows.where(F.col("key") % every == 0).withColumn("answer", F.lit(answer))
    cache = Cache(scratch(spark, "cache"), of("first", 1).schema)
    cache.append(of("first", 1), 0)
    cache.append(of("second", 3), 1)
    cache.append(of("second", 3), 1)
    cache.compact(spark)
    cache.append(of("third", 7), 2)
    return cache.read(spark)
