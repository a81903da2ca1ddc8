"""Registered queries over the driver's tables, each with SQL that DuckDB runs for the same rows.

The tables hold no films: users' events stand for spans (times in microseconds), documents and conversations for lines,
orders and line items for ranked candidates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import masking as W
from loomspan.functions import text as X
from loomspan.operators import context as C
from loomspan.operators import guided as N
from loomspan.operators import lines as L
from loomspan.operators import matching as M
from loomspan.operators import media as D
from loomspan.operators import ranking as R
from loomspan.operators import signals as G
from loomspan.operators import spans as S
from loomspan.operators import sync as A
from loomspan.plans.scan import scan
from loomspan.sources import sinks as K
from loomspan.session import durable, spread
from loomspan.sources import subtitles as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SECOND = 1_000_000


def query(sql: str = "") -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, media, term, start, end, conf): events as spans."""
    start = F.expr("unix_micros(cast(ts as timestamp))")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("media"), F.col("event_type").alias("term"), start.alias("start"), "value")
    return rows.select("id", "media", "term", "start", (F.col("start") + F.round(F.col("value") * 60 * SECOND).cast("long")).alias("end"), F.col("value").alias("conf"))


EV = """e AS (SELECT event_id AS id, user_id AS media, event_type AS term, epoch_us(ts) AS a,
  epoch_us(ts) + round(value * 60000000)::BIGINT AS b, value AS conf FROM events)"""


def merged_sql(new: str, where: str = "", reach: str = "max(b) OVER (PARTITION BY media ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") -> str:
    return f"""WITH {EV}, p AS (SELECT *, {reach} AS reached FROM e {where}),
n AS (SELECT *, (reached IS NULL OR {new})::INT AS k FROM p),
g AS (SELECT *, sum(k) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS i FROM n)
SELECT media, min(a) AS start, max(b) AS "end" FROM g GROUP BY media, i"""


GAP = 600 * SECOND
LAST = "lag(b) OVER (PARTITION BY media ORDER BY a, b, id)"


@query(merged_sql(f"a - reached >= {GAP}"))
def m1_build_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir), ["media"], GAP)


@query(merged_sql(f"a - reached >= {GAP}"))
def m1_build_intervals_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir).select("media", "start", "end"), ["media"], GAP, bucket=86400 * SECOND)


@query(f"""WITH {EV}, w AS (SELECT media, id, term, a - 90000000 AS a, b + 90000000 AS b FROM e),
p AS (SELECT *, max(b) OVER (PARTITION BY media ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM w),
g AS (SELECT *, sum((reached IS NULL OR a - reached >= 1000000)::INT) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT media, min(a) AS start, max(b) AS "end", array_to_string(list_sort(list_distinct(list(term))), ',') AS reasons, count(*) AS n_windows FROM g GROUP BY media, i""")
def m2_plan_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded windows merged, with the sorted set of their reasons."""
    pad = 90 * SECOND
    rows = events(spark, sf_dir).withColumns({"start": F.col("start") - pad, "end": F.col("end") + pad})
    reasons = F.array_join(F.array_sort(F.collect_set("term")), ",").alias("reasons")
    return S.merge_spans(rows, ["media"], SECOND, aggregates=[reasons, F.count(F.lit(1)).alias("n_windows")])


@query(merged_sql("a > reached"))
def m3_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir), ["media"], 0, closed=True)


@query(merged_sql("a >= reached", reach=LAST))
def m4_window_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir), ["media"], 0, reach="last")


@query(merged_sql(f"a - reached >= {3600 * SECOND}", reach=LAST))
def m5_read_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir), ["media"], 3600 * SECOND, reach="last")


@query(merged_sql(f"a > reached + {GAP}", where="WHERE term <> 'view'"))
def m12_cue_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir).where("term <> 'view'"), ["media"], GAP, closed=True)


@query(f"""WITH {EV}, p AS (SELECT *, lag(term) OVER w AS t0, max(b) OVER (PARTITION BY media ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM e WINDOW w AS (PARTITION BY media ORDER BY a, b, id)),
g AS (SELECT *, sum((t0 IS NULL OR t0 <> term OR a > reached + {86400 * SECOND})::INT) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS i FROM p)
SELECT media, term, min(a) AS start, max(b) AS "end", count(*) AS n FROM g GROUP BY media, term, i""")
def m9_repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of equal text within a day are one line."""
    return S.repeated(events(spark, sf_dir), ["media"], "term", 86400 * SECOND, tie=["id"])


@query("""WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[^ \n\r\t]+') AS w FROM documents)),
k AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM t WHERE length(word) >= 5)
SELECT doc_id, min(pos)::INT AS first, (max(pos) + 1)::INT AS last, count(*) AS n FROM k GROUP BY doc_id, run""")
def m14_token_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of neighbouring tokens of five letters or more."""
    long = F.transform(F.regexp_extract_all("text", F.lit(r"[^ \n\r\t]+"), F.lit(0)), lambda w: F.length(w) >= 5)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(S.runs_within(long)).alias("r")).select("doc_id", "r.*")


@query(f"""WITH {EV}, p AS (SELECT id, a - 120000000 AS lo, greatest(b, a) + 200000000 AS hi FROM e),
q AS (SELECT id, lo - greatest(2500000000 - (hi - lo), 0) / 2 AS lo, hi + greatest(2500000000 - (hi - lo), 0) / 2 AS hi FROM p)
SELECT id, lo::DOUBLE AS start, hi::DOUBLE AS "end" FROM q""")
def prj_pad_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    low, high = S.pad_interval(F.col("start"), F.col("end"), 120 * SECOND, 200 * SECOND, 2500 * SECOND)
    return events(spark, sf_dir).select("id", low.cast("double").alias("start"), high.cast("double").alias("end"))


@query(f"""WITH {EV}, l AS (SELECT id, a, b, b - a AS len FROM e WHERE b > a), n AS (SELECT *, CASE WHEN len <= 1200000000 THEN 1 ELSE ceil((len - 120000000) / 1080000000.0)::INT END AS n FROM l),
x AS (SELECT *, unnest(range(n)) AS piece FROM n)
SELECT id, piece::INT AS piece, round(CASE WHEN n = 1 THEN a ELSE a + piece * ((len - 120000000) / n) END)::BIGINT AS start,
  round(CASE WHEN piece = n - 1 THEN b ELSE a + piece * ((len - 120000000) / n) + (len - 120000000) / n + 120000000 END)::BIGINT AS "end" FROM x""")
def an_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.split_spans(events(spark, sf_dir).where("end > start"), 1200 * SECOND, 120 * SECOND)
    return rows.select("id", "piece", F.round("start").cast("long").alias("start"), F.round("end").cast("long").alias("end"))


BIN = 3600 * SECOND
SIDES = f"{EV}, f AS (SELECT * FROM e WHERE term = 'purchase'), d AS (SELECT * FROM e WHERE term = 'click')"


def two_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, sf_dir)
    flags = rows.where("term = 'purchase'").select("id", "media", "start", "end")
    return flags, rows.where("term = 'click'").select("media", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), F.col("conf").alias("r_conf"))


@query(f"WITH {SIDES} SELECT id FROM f WHERE EXISTS (SELECT 1 FROM d WHERE d.media = f.media AND d.a <= f.b AND f.a <= d.b)")
def jn_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.overlap_filter(flags, found, ["media"], BIN, "id", closed=True).select("id")


@query(f"WITH {SIDES} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.media = f.media AND d.a <= f.b AND f.a <= d.b)")
def jn_unconfirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.overlap_filter(flags, found, ["media"], BIN, "id", closed=True, anti=True).select("id")


@query(f"WITH {SIDES} SELECT f.id, count(d.id) AS n, sum(least(f.b, d.b) - greatest(f.a, d.a))::BIGINT AS shared FROM f JOIN d ON d.media = f.media AND d.a < f.b AND f.a < d.b GROUP BY f.id")
def jn_review_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    shared = F.least("end", "r_end") - F.greatest("start", "r_start")
    return S.overlap_join(flags, found, ["media"], BIN).groupBy("id").agg(F.count("r_id").alias("n"), F.sum(shared).alias("shared"))


@query(f"""WITH {SIDES}, j AS (SELECT d.id AS id, f.id AS flag, row_number() OVER (PARTITION BY d.id ORDER BY f.a, f.id) AS k FROM d JOIN f ON d.media = f.media AND d.a <= f.b AND f.a <= d.b)
SELECT d.id, j.flag FROM d LEFT JOIN j ON j.id = d.id AND j.k = 1""")
def jn_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's first overlapping flag."""
    flags, found = two_sides(spark, sf_dir)
    pairs = S.overlap_join(flags, found, ["media"], BIN, closed=True)
    first = pairs.groupBy("r_id").agg(F.min_by("id", F.struct("start", "id")).alias("flag"))
    return found.select(F.col("r_id").alias("id")).join(first.withColumnRenamed("r_id", "id"), "id", "left")


@query(f"""WITH {EV}, r AS (SELECT id, media, a, b FROM e WHERE term = 'view' AND b > a), c0 AS (SELECT media, a, b, max(b) OVER (PARTITION BY media ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM e WHERE term <> 'view'),
c1 AS (SELECT *, sum((reached IS NULL OR a > reached)::INT) OVER (PARTITION BY media ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM c0), c AS (SELECT media, min(a) AS a, max(b) AS b FROM c1 GROUP BY media, i),
p AS (SELECT r.id, greatest(r.a, c.a) AS x, least(r.b, c.b) AS y FROM r JOIN c ON c.media = r.media AND c.a < r.b AND r.a < c.b UNION ALL SELECT id, a, a FROM r UNION ALL SELECT id, b, b FROM r),
g AS (SELECT id, y AS start, lead(x) OVER (PARTITION BY id ORDER BY x, y) AS "end" FROM p) SELECT id, start, "end" FROM g WHERE "end" - start >= 30000000""")
def jn_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of views no other event covers."""
    rows = events(spark, sf_dir)
    return S.difference(rows.where("term = 'view' and end > start"), rows.where("term <> 'view'"), ["media"], "id", 30 * SECOND, BIN).select("id", "start", "end")


@query(f"""WITH {SIDES}, m AS (SELECT id, media, (a + b) // 2 AS mid FROM f),
j AS (SELECT m.id, d.id AS near, row_number() OVER (PARTITION BY m.id ORDER BY abs(d.a - m.mid), d.id) AS k FROM m JOIN d ON d.media = m.media AND abs(d.a - m.mid) <= {BIN})
SELECT f.id, j.near FROM f LEFT JOIN j ON j.id = f.id AND j.k = 1""")
def jn_line_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag's nearest detection, by the flag's middle."""
    flags, found = two_sides(spark, sf_dir)
    flags = flags.withColumn("mid", F.expr("(start + end) div 2"))
    return S.nearest(flags, found.select("media", F.col("r_id").alias("near"), "r_start"), ["media"], "id", "mid", "r_start", BIN, "near").select("id", "near")


@query(f"WITH {SIDES} SELECT f.id, (SELECT min(d.a) FROM d WHERE d.media = f.media AND d.a > f.a) AS next FROM f")
def jn_snap_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.next_start(flags, found, ["media"], "start", "r_start", "next").select("id", "next")


@query(f"""WITH {SIDES}, k AS (SELECT * FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.media = d.media AND f.a < d.b AND d.a < f.b))
SELECT id, media, a AS start, b AS "end" FROM k UNION ALL SELECT id, media, a, b FROM f""")
def jn_merge_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first pass that no row of the second meets, and the second pass."""
    later, first = two_sides(spark, sf_dir)
    kept = S.overlap_filter(first, later, ["media"], BIN, "r_id", anti=True, a=("r_start", "r_end"), b=("start", "end"))
    return kept.select(F.col("r_id").alias("id"), "media", F.col("r_start").alias("start"), F.col("r_end").alias("end")).unionByName(later)


@query(f"""WITH {EV} SELECT x.id FROM e x WHERE EXISTS (SELECT 1 FROM e y WHERE y.media = x.media AND y.id <> x.id AND y.a < x.b AND x.a < y.b)""")
def jn_crowded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that share time with another."""
    rows = events(spark, sf_dir).select("id", "media", "start", "end")
    other = rows.select("media", F.col("id").alias("r_id"), F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return S.overlap_join(rows, other, ["media"], BIN).where("id <> r_id").select("id").distinct()


@query(f"""WITH {EV}, m AS (SELECT id, media, (a + b) // 2 AS mid FROM e WHERE term = 'click') SELECT m.id, min(f.id) AS inside FROM m JOIN e f ON f.term = 'purchase' AND f.media = m.media AND f.a <= m.mid AND m.mid <= f.b GROUP BY m.id""")
def jn_detection_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span that holds a detection's middle."""
    flags, found = two_sides(spark, sf_dir)
    mid = found.select("media", "r_id", F.expr("(r_start + r_end) div 2").alias("mid"))
    return S.overlap_join(flags, mid, ["media"], BIN, closed=True, b=("mid", "mid")).groupBy(F.col("r_id").alias("id")).agg(F.min("id").alias("inside"))


@query()
def an_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.dedupe(events(spark, sf_dir), ["media", "term"], "conf").select("id", "media", "term", "start", "end", "conf")


# ---- text functions and matching -------------------------------------------------------------------------------------

WORDS = r"""t AS (SELECT doc_id, unnest(w) AS raw, unnest(range(len(w))) AS pos FROM (SELECT doc_id, list_filter(regexp_split_to_array(
  regexp_replace(text, '-{2,}|\.{3,}|[–—…]', ' ', 'g'), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents))"""
FOLD = "replace(lower(translate(raw, '‘’‚‛′´`“”„″', '''''''''''''''\"\"\"\"')), 'ß', 'ss')"
EDGES = r"""[\"'.,!?;:()\[\]{}<>«»¿¡…—–\-_/\\|~^♪]""".replace("'", "''")
NORM = rf"trim(regexp_replace(trim({FOLD}), '^{EDGES}+|{EDGES}+$', '', 'g'))"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {WORDS} SELECT doc_id, pos::INT AS pos, raw, {FOLD} AS folded FROM t")
def fn_split_words_and_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lines(spark, sf_dir).select("doc_id", X.split_words(F.col("text")).alias("raw"))
    rows = words.select("doc_id", F.posexplode(F.arrays_zip("raw", X.folded_words(F.col("raw")).alias("folded"))).alias("pos", "w"))
    return rows.select("doc_id", "pos", "w.raw", "w.folded")


COLLAPSED = NORM
for _letter in "abcdefghijklmnopqrstuvwxyzäöüéèêçñáíóúàâîôûëïùìòõãåæøœýÿ":  # SQL lacks back-references
    COLLAPSED = f"regexp_replace({COLLAPSED}, '{_letter}{{{{3,}}}}', '{_letter}', 'g')".replace("{{", "{").replace("}}", "}")


@query(f"WITH {WORDS}, n AS (SELECT DISTINCT raw FROM t) SELECT raw, {COLLAPSED} AS token FROM n")
def fn_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct tokens with their normal form."""
    rows = lines(spark, sf_dir).select(F.explode(X.split_words(F.col("text"))).alias("raw")).distinct()
    return rows.select("raw", X.normalize(F.col("raw"), compose=True).alias("token"))


@query()
def fn_normalize_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, all words of a text at once."""
    words = lines(spark, sf_dir).select(X.split_words(F.col("text")).alias("raw"))
    return words.select(F.explode(F.arrays_zip("raw", X.normalized_words(F.col("raw")).alias("token"))).alias("w")).select("w.*").distinct()


@query(f"WITH {WORDS} SELECT doc_id, count(*) AS n FROM t WHERE length(raw) >= 2 AND regexp_matches(raw, '[*#]') AND (regexp_matches(raw, '\\p{{L}}') OR length(raw) >= 3) GROUP BY doc_id")
def fn_is_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("doc_id", F.explode(X.split_words(F.col("text"))).alias("raw"))
    return rows.where(X.is_masked(F.col("raw"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


TERMS = (M.Term("the", "mild"), M.Term("*tion*", "strong"), M.Term("of the", "phrase"), M.Term("that [is]", "target"), M.Term("thatis", "joined"))


@query(rf"""WITH {WORDS}, k AS (SELECT doc_id, pos, {NORM} AS token FROM t)
SELECT doc_id, pos::INT AS first, (pos + 1)::INT AS last, 'the' AS term FROM k WHERE token = 'the'
UNION ALL SELECT doc_id, pos, pos + 1, '*tion*' FROM k WHERE regexp_matches(token, '^[\p{{L}}\p{{N}}_'']*tion[\p{{L}}\p{{N}}_'']*$') AND token NOT LIKE 'ti%'
UNION ALL SELECT a.doc_id, a.pos, a.pos + 2, 'of the' FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'
UNION ALL SELECT a.doc_id, a.pos, a.pos + 2, 'that [is]' FROM k a JOIN k b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'that' AND b.token = 'is'""")
def jn_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places of terms, without words that the allow list spares."""
    return M.find(lines(spark, sf_dir), "doc_id", M.WordList(TERMS[:4], allow=["ti*"])).select("doc_id", "first", "last", "term")


@query()
def an_greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match(lines(spark, sf_dir), "doc_id", TERMS).select("doc_id", "first", "last", "term", "category", F.array_join("targets", ",").alias("targets"))


@query(f"WITH {WORDS} SELECT {FOLD} AS token, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1")
def ag_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents a token stands: each document's distinct tokens are counted."""
    words = lines(spark, sf_dir).select(X.split_words(F.col("text")).alias("w"))
    return words.select(F.explode(F.array_distinct(X.folded_words(F.col("w")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("docs"))


@query("SELECT conv_id, turn, lpad((ms // 3600000)::VARCHAR, 2, '0') || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((ms % 1000)::VARCHAR, 3, '0') AS at FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT * 67 AS ms FROM conversations)")
def fn_srt_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn")) * 67
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", at.alias("ms")).select("conv_id", "turn", X.srt_time(F.col("ms")).alias("at"))


@query("SELECT conv_id, turn, CASE WHEN length(l) >= 4 AND l = upper(l) THEN 'shouted' END AS delivery, CASE WHEN m >= 2 OR (length(l) >= 4 AND l = upper(l)) THEN 'high' WHEN m = 1 THEN 'medium' ELSE 'low' END AS intensity FROM (SELECT conv_id, turn, regexp_replace(text, '\\P{L}', '', 'g') AS l, length(text) - length(replace(text, '!', '')) AS m FROM conversations)")
def fn_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = X.delivery(F.array().cast("array<string>"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("delivery"), X.intensity(said, F.col("text")).alias("intensity"))


@query("SELECT a.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS similarity, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.1 AS alike FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def fn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", X.cosine(F.col("embedding"), F.col("other")).alias("similarity")).withColumn("alike", F.col("similarity") >= 0.1)


@query("SELECT vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) AS rms, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)) + 1e-12) AS db FROM embeddings")
def ag_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = X.rms(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", level.alias("rms"), X.decibels(level).alias("db"))


@query("SELECT doc_id, substr(sha256(text), 1, 12) AS key FROM documents")
def fn_settings_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", X.short_hash(F.col("text")).alias("key"))


@query("SELECT event_id, CASE WHEN json_extract_string(regexp_extract('said: ' || props || ' {\"x\": 1}', '\\{[^}]*\\}'), '$.page') IN ('/home', '/cart') THEN json_extract_string(props, '$.page') END AS page FROM events")
def fn_parse_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("said: "), F.col("props"), F.lit(' {"x": 1}'))
    return table(spark, sf_dir, "events").select("event_id", X.parse_answer(text, "page", ["/home", "/cart"]).alias("page"))


@query()
def fn_fuzz_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against their neighbours', with words in order."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    pair = rows.join(other, "p_partkey")
    return pair.select("p_partkey", X.fuzz_ratio("p_name", "other").alias("ratio"), X.fuzz_ratio(X.sorted_words(F.col("p_name")), X.sorted_words(F.col("other"))).alias("sorted_ratio"))


# ---- alignment, ranking, decisions, evaluation, sinks ----------------------------------------------------------------

CUES = """c AS (SELECT conv_id AS media, turn::INT AS cue, b - n AS a, b, role = 'system' AS lyrics, w, text FROM (SELECT *, length(text) AS n, len(list_filter(regexp_split_to_array(text, '[ \\n\\r\\t]+'), lambda x: x <> '')) AS w,
  sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS b FROM conversations))"""


def cue_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media, cue, start, end, lyrics, n_words, text): turns on a timeline of their characters."""
    rows = table(spark, sf_dir, "conversations")
    end = F.sum(F.length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    words = F.size(F.filter(F.split("text", "[ \n\r\t]+"), lambda w: w != ""))
    return rows.select(F.col("conv_id").alias("media"), F.col("turn").cast("int").alias("cue"), (end - F.length("text")).alias("start"), end.alias("end"), (F.col("role") == "system").alias("lyrics"), words.alias("n_words"), "text")


@query(f"""WITH {CUES}, r AS (SELECT *, b / 100.0::DOUBLE - a / 100.0::DOUBLE AS len FROM c), f AS (SELECT *, NOT lyrics AND len BETWEEN 1 AND 7 AND w >= 4 AS s, NOT lyrics AND len BETWEEN 0.5 AND 10 AND w >= 2 AS x,
  min(a / 100.0::DOUBLE) OVER (PARTITION BY media) AS lo, max(b / 100.0::DOUBLE) OVER (PARTITION BY media) AS hi FROM r), g AS (SELECT *, bool_or(s) OVER (PARTITION BY media) AS strict FROM f),
k AS (SELECT *, least(2, floor((a / 100.0::DOUBLE - lo) / ((hi - lo) / 3)))::INT AS stretch FROM g WHERE CASE WHEN strict THEN s ELSE x END),
o AS (SELECT *, row_number() OVER (PARTITION BY media, stretch ORDER BY w % 3 DESC, w DESC, cue) AS n FROM k) SELECT media, stretch, cue FROM o WHERE n = 1""")
def an_anchor_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue_rows(spark, sf_dir).withColumns({"start": F.col("start") / 100.0, "end": F.col("end") / 100.0, "n_rare": F.col("n_words") % 3})
    return A.anchors(rows, 3).select("media", "stretch", "cue")


@query(f"""WITH s AS (SELECT unnest([0,1,2,3,4,5,6,7,8]) AS i, unnest([{", ".join(map(repr, A.RATIOS))}]::DOUBLE[]) AS scale),
p AS (SELECT l_suppkey AS k, l_linenumber * 50.0::DOUBLE AS x, l_linenumber * 52.135::DOUBLE + (l_partkey % 7) AS y FROM lineitem),
q AS (SELECT *, count(*) OVER (PARTITION BY k) >= 3 AND max(x) OVER (PARTITION BY k) - min(x) OVER (PARTITION BY k) >= 60 AS free FROM p),
r AS (SELECT k, i, scale, y - scale * x AS res FROM q JOIN s ON i = 0 OR free), o AS (SELECT k, i, scale, median(res) AS o FROM r GROUP BY 1, 2, 3),
e AS (SELECT r.k, r.i, any_value(r.scale) AS scale, any_value(o.o) AS o, median(abs(res - o.o)) AS e FROM r JOIN o ON r.k = o.k AND r.i = o.i GROUP BY r.k, r.i),
t AS (SELECT k, list_reduce(list(struct_pack(i := i, scale := scale, o := o, e := e) ORDER BY i), lambda b, c: CASE WHEN c.e < b.e - 0.05 THEN c ELSE b END) AS b FROM e GROUP BY k)
SELECT k AS l_suppkey, round(b.scale, 6) AS scale, round(b.o, 4) AS "offset", round(b.e, 4) AS error FROM t""")
def an_fit_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two noisy clocks: y runs 1.0427 times x; the nearest standard scale is found."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_linenumber") * 50.0).alias("x"), (F.col("l_linenumber") * 52.135 + F.col("l_partkey") % 7).alias("y"))
    return A.fit(rows, ["l_suppkey"], "x", "y").select("l_suppkey", F.round("scale", 6).alias("scale"), F.round("offset", 4).alias("offset"), F.round("error", 4).alias("error"))


@query("SELECT o_custkey, o_orderkey, k::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def srt_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey"), most=3).select("o_custkey", "o_orderkey", "rank")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1")
def srt_first_usable(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("cost", -F.col("o_totalprice"))
    return R.first_usable(rows, ["o_custkey"], F.col("o_orderstatus") == "F", "o_orderpriority", "cost", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS s FROM orders) WHERE s <= 500000")
def an_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return R.keep_newest(rows, ["o_custkey"], "o_totalprice", 500000, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey")


@query("SELECT p_partkey, (CASE WHEN p_size = 1 THEN 40 ELSE 0 END + p_size / 10.0 + CASE WHEN p_partkey % 100 = 0 THEN 5 ELSE 0 END + least(5.0, log10(1 + p_retailprice)))::DOUBLE AS score FROM part")
def srt_score_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = R.online_score(F.col("p_size") == 1, F.col("p_size") / 10.0, F.col("p_partkey") % 100, F.col("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("double").alias("score"))


@query(f"WITH {CUES}, d AS (SELECT media, cue, CASE WHEN cue % 3 = 0 THEN '' ELSE text END AS t FROM c) SELECT media, cue, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY media ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous, first_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY media ORDER BY cue ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM d")
def an_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue_rows(spark, sf_dir).withColumn("text", F.when(F.col("cue") % 3 == 0, "").otherwise(F.col("text")))
    return C.neighbours(rows, ["media"], "cue", "text").select("media", "cue", "previous", "following")


@query("""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(lower(text), '[ \n\r\t]+'), lambda x: x <> '')) AS w FROM conversations),
a AS (SELECT conv_id, w, count(*) AS n FROM t WHERE turn % 2 = 0 GROUP BY 1, 2), b AS (SELECT conv_id, w, count(*) AS n FROM t WHERE turn % 2 = 1 GROUP BY 1, 2)
SELECT a.conv_id, sum(least(a.n, coalesce(b.n, 0))) / sum(a.n) AS share FROM a LEFT JOIN b ON a.conv_id = b.conv_id AND a.w = b.w GROUP BY a.conv_id""")
def jn_heard_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the even turns' words is in the odd turns."""
    words = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.filter(F.split(F.lower("text"), "[ \n\r\t]+"), lambda w: w != "")).alias("w"))
    return C.share_of(words.where("turn % 2 = 0"), words.where("turn % 2 = 1"), ["conv_id"], "w")


@query("""SELECT p_partkey, CASE WHEN p_size = 50 THEN 'profane' WHEN p_size % 2 = 0 THEN 'profane' WHEN p_size % 7 = 0 THEN 'unsure' WHEN p_size % 11 = 0 THEN 'unsure' WHEN r >= 0.5 THEN 'profane' WHEN p_size % 13 = 0 THEN 'unsure' WHEN p_size % 5 = 0 THEN 'unsure'
 WHEN p_size % 3 = 0 AND r < 0.3 THEN 'harmless' WHEN p_size % 3 = 0 THEN 'unsure' WHEN p_size % 3 = 1 THEN 'profane' ELSE 'unsure' END AS use FROM (SELECT *, (p_partkey % 10) / 10.0 AS r FROM part)""")
def dt_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, rude = F.col("p_size"), (F.col("p_partkey") % 10) / 10.0
    answer = F.when(n % 3 == 0, "harmless").when(n % 3 == 1, "profane").otherwise("unsure")
    out = C.verdict(n == 50, n % 2 != 0, n % 7 != 0, n % 11 != 0, rude, n % 13 != 0, answer, F.lit(True), n % 5 != 0)
    return table(spark, sf_dir, "part").select("p_partkey", out["use"].alias("use"))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 25 THEN 'classifier' END, CASE WHEN p_size % 2 = 0 THEN 'phrase' END, CASE WHEN p_size % 5 = 0 THEN 'sound' END], lambda x: x IS NOT NULL), ',') AS evidence FROM part")
def dt_sexual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    signs = C.evidence(("classifier", n > 25), ("phrase", n % 2 == 0), ("sound", n % 5 == 0))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(signs, ",").alias("evidence"))


@query("SELECT d.lang, count(*) AS n, count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (quality = 1), 0) AS precision, count(*) FILTER (toxic = 1 AND quality = 1) / nullif(count(*) FILTER (toxic = 1), 0) AS recall, count(*) FILTER (quality = 1 AND toxic = 0) AS false_flags FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang")
def ag_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return C.confusion(rows, ["lang"], F.col("toxic") == 1, F.col("quality") == 1)


@query(f"""WITH {SIDES}, c AS (SELECT f.id, f.media, f.b - f.a AS len, sum(CASE WHEN d.id IS NULL THEN 0 ELSE least(f.b, d.b) - greatest(f.a, d.a) END) AS shared FROM f LEFT JOIN d ON d.media = f.media AND d.a < f.b AND f.a < d.b GROUP BY ALL)
SELECT media, count(*) AS n, count(*) FILTER (len > 0 AND shared >= 0.95 * len) AS covered, count(*) FILTER (len > 0 AND shared >= 0.5 * len) AS partly, sum(len)::BIGINT AS seconds FROM c GROUP BY media""")
def ag_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth spans covered by found ones, in full and by half."""
    truth, found = two_sides(spark, sf_dir)
    shared = S.overlap_join(truth, found, ["media"], BIN).groupBy("id").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("shared"))
    rows = truth.join(shared, "id", "left").withColumns({"len": F.col("end") - F.col("start"), "shared": F.coalesce("shared", F.lit(0))})
    by = lambda part: F.count_if((F.col("len") > 0) & (F.col("shared") >= part * F.col("len")))
    return rows.groupBy("media").agg(F.count(F.lit(1)).alias("n"), by(0.95).alias("covered"), by(0.5).alias("partly"), F.sum("len").alias("seconds"))


@query(f"WITH {EV} SELECT term, median(b - a) AS middle, (quantile_disc(b - a, 0.5))::BIGINT AS low_middle, max_by(b - a, abs(conf - 30))::BIGINT AS worst, count(*) FILTER (conf > 50) AS strong FROM e GROUP BY term")
def ag_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("d", F.col("end") - F.col("start"))
    worst = rows.groupBy("term").agg(F.max_by("d", F.abs(F.col("conf") - 30)).alias("worst"), F.count_if(F.col("conf") > 50).alias("strong"))
    return C.median_low(rows, ["term"], "d").withColumn("low_middle", F.col("low_middle").cast("long")).join(worst, "term")


@query(f"WITH {EV} SELECT media, sum(b - a)::BIGINT AS audio, sum(b - a) / 2592000000000.0 AS coverage, count(*) FILTER (term = 'click') AS click, count(*) FILTER (term = 'view') AS viewed, 2 * count(*) FILTER (term = 'purchase') < count(*) AND count(*) >= 3 AS escalate FROM e GROUP BY media")
def ag_audio_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, coverage and counts by reason of each media's spans, and whether too few are confirmed."""
    of = lambda term: F.col("term") == term
    rows = S.lengths(events(spark, sf_dir), ["media"], F.lit(2592000000000.0), ("click", of("click")), ("viewed", of("view")), ("bought", of("purchase")), ("n", F.lit(True)))
    return rows.select("media", F.col("seconds").alias("audio"), "coverage", "click", "viewed", ((2 * F.col("bought") < F.col("n")) & (F.col("n") >= 3)).alias("escalate"))


@query(f"""WITH {EV}, p AS (SELECT *, (a // 1000) / 1000.0 AS s, (b // 1000) / 1000.0 AS t FROM e WHERE b > a) SELECT media, string_agg(printf('%.3f', s::DOUBLE) || chr(9) || printf('%.3f', t::DOUBLE) || chr(9) || '1' || chr(10), '' ORDER BY s, t) AS content FROM p GROUP BY media""")
def snk_edl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).where("end > start").select("media", (F.expr("start div 1000") / 1e3).alias("start"), (F.expr("end div 1000") / 1e3).alias("end"))
    return K.edit_list(rows)


@query()
def snk_edl_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without SQL: the edit list of every media."""
    rows = events(spark, sf_dir).where("end > start").select("media", (F.expr("start div 1000") / 1e3).alias("start"), (F.expr("end div 1000") / 1e3).alias("end"))
    return K.edit_list(rows)


@query(f"""WITH {EV} SELECT id, a / 1000000.0::DOUBLE AS start, coalesce(lag(b) OVER (PARTITION BY media ORDER BY a, b, id), 0) / 1000000.0::DOUBLE AS previous, least(0.01, (b - a) / 3000000.0::DOUBLE) AS fade FROM e""")
def an_command_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("id", "media", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"))
    return K.mute_commands(rows).select("id", "start", "previous", "fade")


# ---- lines, cached spans, media --------------------------------------------------------------------------------------


@query(f"WITH {EV}, p AS (SELECT id, a - (SELECT min(a) FROM e) AS a, b - (SELECT min(a) FROM e) AS b FROM e), g AS (SELECT id, 1.001::DOUBLE * a + 2500000.0::DOUBLE AS x, 1.001::DOUBLE * b + 2500000.0::DOUBLE AS y FROM p) SELECT id, round(x)::BIGINT AS start, round(y)::BIGINT AS \"end\" FROM g")
def prj_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    first = rows.agg(F.min("start").alias("zero"))
    rows = rows.join(F.broadcast(first))  # one row
    at = lambda c: F.round(L.to_media(F.col(c) - F.col("zero"), F.lit(1.001), F.lit(2500000.0))).cast("long")
    return rows.select("id", at("start").alias("start"), at("end").alias("end"))


@query(f"WITH {EV}, m AS (SELECT id, a % 1000 AS lo, a % 1000 + (b - a) % 500 AS hi FROM e), g AS (SELECT *, lo - greatest(300 - (hi - lo), 0) / 2.0::DOUBLE AS l1, greatest(hi - lo, 300) AS n FROM m), h AS (SELECT id, greatest(l1, 0) AS l2, l1 + n + greatest(-l1, 0) AS h2 FROM g) SELECT id, greatest(l2 - greatest(h2 - 1100, 0), 0)::DOUBLE AS start, least(h2, 1100)::DOUBLE AS \"end\" FROM h")
def prj_grow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a least length, shifted at the edges."""
    rows = events(spark, sf_dir).select("id", (F.col("start") % 1000).alias("lo"), ((F.col("end") - F.col("start")) % 500).alias("n"))
    low, high = L.grow(F.col("lo"), F.col("lo") + F.col("n"), 300, F.lit(1100))
    return rows.select("id", low.cast("double").alias("start"), high.cast("double").alias("end"))


@query(f"WITH {EV}, d AS (SELECT * FROM e WHERE term = 'click'), f AS (SELECT media, a - 60000000 AS a, b + 60000000 AS b FROM e WHERE term = 'purchase') SELECT id FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.media = d.media AND f.a <= (d.a + d.b) / 2.0 AND (d.a + d.b) / 2.0 <= f.b)")
def jn_uncovered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return L.uncovered_words(rows.where("term = 'click'"), rows.where("term = 'purchase'"), ["media"], "id", 60 * SECOND, BIN).select("id")


@query(f"WITH {EV}, f AS (SELECT * FROM e WHERE term = 'purchase'), w AS (SELECT media, a, b, (a + b) / 2.0 AS m FROM e WHERE term = 'click'), g AS (SELECT f.id, min(w.a) AS x, max(w.b) AS y FROM f JOIN w ON w.media = f.media AND w.m BETWEEN f.a - 60000000 AND f.b + 60000000 GROUP BY f.id) SELECT f.id, g.x IS NOT NULL AS heard, coalesce(g.x, f.a) AS start, coalesce(g.y, f.b) AS \"end\" FROM f LEFT JOIN g ON g.id = f.id")
def jn_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return L.line_words(rows.where("term = 'purchase'"), rows.where("term = 'click'"), ["media"], "id", 60 * SECOND, BIN).select("id", "heard", "start", "end")


@query(f"WITH {SIDES}, s AS (SELECT f.id, list_distinct(list(d.id::VARCHAR)) AS l FROM f JOIN d ON d.media = f.media AND d.a < f.b AND f.a < d.b GROUP BY f.id) SELECT f.id, coalesce(len(s.l), 0)::INT AS n FROM f LEFT JOIN s ON s.id = f.id UNION ALL SELECT NULL, 1 FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.media = d.media AND d.a < f.b AND f.a < d.b)")
def jn_cue_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cues, found = two_sides(spark, sf_dir)
    cues = cues.withColumns({c: F.col(c).cast("double") for c in ("start", "end")})
    sounds = found.select("media", F.col("r_id").alias("sound_id"), F.col("r_start").cast("double").alias("r_start"), F.col("r_end").cast("double").alias("r_end"), F.col("r_id").cast("string").alias("sound"))
    return L.with_sounds(cues, sounds, ["media"], "id", BIN).select("id", F.size("sounds").alias("n"))


@query(f"WITH {EV}, w AS (SELECT *, lag(b) OVER (PARTITION BY media ORDER BY a, b, id) AS l, lag(term) OVER (PARTITION BY media ORDER BY a, b, id) AS t FROM e), g AS (SELECT *, sum((l IS NULL OR a - l >= {86400 * SECOND} OR t LIKE '%e')::INT) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS s FROM w) SELECT media, min(a) AS start, arg_max(b, (a, b, id)) AS \"end\", string_agg(term, ' ' ORDER BY a, b, id) AS text, count(*) AS n FROM g GROUP BY media, s")
def m11_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences end after words that end in e, or with a day's pause."""
    return L.sentences(events(spark, sf_dir).withColumnRenamed("term", "text"), ["media"], 86400 * SECOND, "id", r"e$")


@query(f"WITH {EV} SELECT id, (lag(b) OVER w + a) / 2.0::DOUBLE AS keep_from, (b + lead(a) OVER w) / 2.0::DOUBLE AS keep_to FROM e WHERE b > a WINDOW w AS (PARTITION BY media ORDER BY a, b)")
def an_overlap_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.middles(events(spark, sf_dir).where("end > start"), ["media"]).select("id", "keep_from", "keep_to")


@query(f"WITH {EV}, w AS (SELECT * FROM e WHERE term = 'view' AND b > a), s AS (SELECT * FROM e WHERE term <> 'view') SELECT w.id, greatest(w.a, s.a) AS start, least(w.b, s.b) AS \"end\" FROM w JOIN s ON s.media = w.media AND w.a < s.b AND s.a < w.b")
def jn_cache_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return L.cached(rows.where("term = 'view' and end > start"), rows.where("term <> 'view'"), ["media"], "id", BIN)[0].select("id", "start", "end")


@query(f"WITH {EV}, w AS (SELECT * FROM e WHERE term = 'view'), s AS (SELECT * FROM e WHERE term <> 'view') SELECT w.id, (SELECT min(s.id) FROM s WHERE s.media = w.media AND s.a <= w.a + 1000 AND s.b >= w.b - 1000 AND s.a <= w.b AND w.a <= s.b) AS source FROM w")
def jn_cache_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return L.containing(rows.where("term = 'view'"), rows.where("term <> 'view'"), ["media"], "id", BIN, 1000, "id").select("id", "source")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM n WHERE n <= 5 OR list_contains(list_transform(range(5), lambda k: round_even(k * (n - 1) / 4.0::DOUBLE, 0)), i::DOUBLE)")
def an_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.evenly(table(spark, sf_dir, "orders"), ["o_custkey"], 5, "o_orderkey").select("o_custkey", "o_orderkey")


@query(merged_sql("a - reached >= 50000").replace(f"WITH {EV}", f"WITH {EV.replace('e AS (', 'e0 AS (')}, e AS (SELECT id, media, a, greatest(b, a + 60000) AS b FROM e0)"))
def m7_normalize_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.normalized(events(spark, sf_dir), ["media"], 50000, 60000)


TAGS = ("eng", "en-GB", "GER", "de-AT", "fre", "pt-BR", "xx")
SCORED = """CASE WHEN c_nationkey % 4 <> 0 THEN CASE c_custkey % 8 WHEN 0 THEN 90 WHEN 1 THEN 90 WHEN 2 THEN 100 WHEN 3 THEN 100 WHEN 5 THEN 80 WHEN 6 THEN 70 WHEN 7 THEN 50 END
  + CASE WHEN c_nationkey % 3 = 0 THEN 20 ELSE 0 END + c_nationkey % 2 END"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as candidates of their nation, in eight languages: German before English, Portuguese and xx, the last of no known language."""
    n = F.col("c_nationkey")
    language = F.get(F.array(*map(F.lit, TAGS)), (F.col("c_custkey") % 8).cast("int"))
    score = D.candidate_score(language, ["de", "en", "pt", "xx"], n % 4 == 0, n % 3 == 0, True, n % 2)
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", score.alias("score"))


@query(f"SELECT c_custkey, {SCORED} AS score FROM customer")
def flt_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("c_custkey", "score")


@query(f"SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, c_custkey)::INT AS rank FROM (SELECT *, {SCORED} AS score FROM customer) WHERE score IS NOT NULL")
def srt_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates that are not left out, best first; ties stay in the order of discovery."""
    scored = candidates(spark, sf_dir).where("score IS NOT NULL")
    return R.ranked(scored, ["c_nationkey"], F.desc("score"), F.col("c_custkey")).select("c_nationkey", "c_custkey", "rank")


@query("SELECT p_partkey, (CASE WHEN lower(p_brand) = lower(b) THEN 10 ELSE 0 END + CASE WHEN lower(p_type) = lower(t) THEN 5 ELSE 0 END)::INT AS score FROM (SELECT *, lead(p_brand) OVER (ORDER BY p_partkey) AS b, lead(p_type) OVER (ORDER BY p_partkey) AS t FROM part)")
def ag_release_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part")
    other = rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"))
    score = D.release_similarity([(F.col("p_brand"), F.col("b"), 10), (F.col("p_type"), F.col("t"), 5)])
    return rows.join(other, "p_partkey", "left").select("p_partkey", score.alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'size' WHEN o_orderstatus <> 'F' THEN 'hash' WHEN o_orderpriority LIKE '1%' THEN 'duration' END AS differs FROM orders")
def flt_report_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = D.mismatch(("size", F.col("o_totalprice") > 200000), ("hash", F.col("o_orderstatus") != "F"), ("duration", F.col("o_orderpriority").startswith("1")))
    return table(spark, sf_dir, "orders").select("o_orderkey", found.alias("differs"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) > 1 AS clash FROM orders")
def jn_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws("/", "o_custkey", "o_orderpriority").alias("output"), F.col("o_orderkey").alias("order"))
    return D.clashes(rows).select("o_orderkey", "clash")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def set_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return R.upsert(rows, rows.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT DISTINCT n_name AS name FROM nation EXCEPT SELECT upper(r_name) FROM region")
def set_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))
    return R.unknown(names, table(spark, sf_dir, "region").select(F.upper("r_name").alias("name")))


@query(f"WITH {EV} SELECT media, array_to_string(list_sort(list_distinct(list(term))), ',') AS reasons, count(*) FILTER (term IN ('click', 'view')) > 0 AS strong FROM e GROUP BY media")
def flt_strong(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct reasons of each media, and whether a strong one is among them."""
    named = F.when(F.col("term") == "click", "lexicon").when(F.col("term") == "view", "masked").otherwise("hint")
    rows = events(spark, sf_dir).groupBy("media").agg(F.array_join(F.array_sort(F.collect_set("term")), ",").alias("reasons"), F.collect_set(named).alias("r"))
    return rows.select("media", "reasons", N.strong(F.col("r")).alias("strong"))


# ---- more of matching, masking, sources and signals ------------------------------------------------------------------


@query(rf"WITH {WORDS}, k AS (SELECT doc_id, pos, {NORM} AS token FROM t) SELECT DISTINCT doc_id, pos::INT AS pos FROM k WHERE regexp_matches(token, '^th[\p{{L}}\p{{N}}_'']*$') OR token = 'of'")
def jn_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.hints(lines(spark, sf_dir), "doc_id", ["th*", "of"]).select("doc_id", "pos")


@query()
def jn_masked_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which listed word a masked token may stand for."""
    return M.masked_categories(M.tokens(lines(spark, sf_dir), "doc_id"), TERMS)


@query()
def dt_flag_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.flag_cues(lines(spark, sf_dir), "doc_id", TERMS[:2], ["whnt*"])
    return rows.select("doc_id", F.array_join("reasons", ",").alias("reasons"), F.size("words").alias("n_words"), F.get("words", F.lit(0)).alias("first"))


@query(r"""WITH a AS (SELECT page_id, string_split_regex(regexp_replace(regexp_replace(regexp_replace(html, '</?[a-zA-Z][^<>]*>|<\d[\d:.]*>', '', 'g'), '\{[^{}]*\}', '', 'g'), '\[[^\[\]]*\]|\([^()]*\)', ' ', 'g'), '\r\n|[\n\r\v\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]') AS l FROM pages),
t AS (SELECT page_id, unnest(l) AS x, unnest(range(len(l))) AS i FROM a),
u AS (SELECT page_id, i, regexp_replace(x, '^\s+|\s+$', '', 'g') AS x FROM t),
v AS (SELECT page_id, i, regexp_replace(CASE WHEN regexp_matches(x, '^#\s.*\s#$|^#$') THEN regexp_replace(x, '^#+|#+$', '', 'g') ELSE x END, '^[-‐‑‒–—]+\s*', '') AS x FROM u),
g AS (SELECT page_id, i, x, regexp_extract(x, '^([^\s:][^:]{0,29}):(?:\s|$)', 1) AS g FROM v),
w AS (SELECT page_id, i, CASE WHEN g <> '' AND g = upper(g) AND g <> lower(g) AND len(string_split_regex(trim(g), '\s+')) <= 4 AND NOT regexp_matches(g, '[?!,"]') THEN substr(x, length(g) + 2) ELSE x END AS x FROM g),
z AS (SELECT page_id, i, trim(regexp_replace(regexp_replace(regexp_replace(x, '^[-‐‑‒–—]+\s*', ''), '[♪♫♬]', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM w)
SELECT page_id, string_agg(x, ' ' ORDER BY i) FILTER (x <> '') AS text FROM z GROUP BY page_id""")
def fn_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of marked-up pages, line by line."""
    return table(spark, sf_dir, "pages").select("page_id", F.nullif(X.clean_text(F.col("html")), F.lit("")).alias("text"))


@query()
def fn_mask_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).select("doc_id", W.mask_words(F.col("text"), ["the", "of the", "and"]).alias("text"))


@query()
def fn_mask_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns whose first visible word is masked."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    first = F.length(F.regexp_extract("text", r"^\S+", 0))
    spans = rows.where(first > 0).select("conv_id", "turn", F.lit(0).alias("first"), first.alias("last"))
    return W.mask_lines(rows, spans, ["conv_id", "turn"], "first_letter")


def cue_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cue_rows(spark, sf_dir).where("text <> ''")
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    return rows.select(F.col("media").cast("string").alias("media"), (F.col("start") / 10).alias("start"), (F.col("end") / 10).alias("end"), flat.alias("text"))


@query(f"WITH {CUES}, k AS (SELECT media, a, b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM c WHERE text <> '') SELECT media::VARCHAR AS media, row_number() OVER (PARTITION BY media ORDER BY a, b)::INT AS cue, a / 10.0::DOUBLE AS start, b / 10.0::DOUBLE AS \"end\" FROM k")
def src_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as subtitles and parsed again."""
    files = K.subtitles(cue_seconds(spark, sf_dir))
    return Q.cues(files).select("media", "cue", "start", "end")


@query(f"WITH {EV} SELECT media::VARCHAR AS media, round(a / 1000000.0::DOUBLE, 3) AS start, round(b / 1000000.0::DOUBLE, 3) AS \"end\" FROM e WHERE round(b / 1000000.0::DOUBLE, 3) > round(a / 1000000.0::DOUBLE, 3)")
def src_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans written as reports and read again."""
    rows = events(spark, sf_dir).select(F.col("media").cast("string").alias("media"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"))
    return Q.report_intervals(K.reports(rows))


@query()
def jn_anchor_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark items as anchors, in the documents that share five words in a row with them, a word each 0.3 s.

    An item is searched around these words, as far as its own length either way. Words are those that are left when
    normalised. Null doc_ids are searched for nothing.
    """
    heard = lambda rows, id: rows.where(F.col(id).isNotNull()).select(id, F.filter(X.normalized_words(X.split_words(F.col("text"))), lambda w: w != "").alias("w"))
    said, items = heard(lines(spark, sf_dir), "doc_id"), heard(table(spark, sf_dir, "benchmark"), "item_id")
    listed = durable(A.word_runs(items, "item_id", "w").select("item_id", "run").distinct(), "listed")  # its size is known, so a small one is broadcast
    shared = A.word_runs(said, "doc_id", "w").join(listed, "run").groupBy("doc_id", "item_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    shared = durable(shared, "shared")  # read for the anchors, their largest and the documents that they are searched in
    asked = shared.join(items.select("item_id", F.array_join("w", " ").alias("text"), F.size("w").alias("n_words")), "item_id")
    asked = asked.select("doc_id", F.col("item_id").alias("cue"), "text", "n_words", ((F.col("a") - F.col("n_words")) * 0.3).alias("low"), ((F.col("b") + F.col("n_words")) * 0.3).alias("high"))
    words = heard(lines(spark, sf_dir).join(shared.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id")
    words = words.select("doc_id", F.posexplode_outer("w").alias("pos", "token")).where("pos IS NOT NULL").withColumn("start", F.col("pos") * 0.3)
    return A.best_window(asked, words, ["doc_id"], "cue").select("doc_id", F.col("cue").alias("item_id"), "score", "fidelity", "heard_at")


@query()
def fn_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of neighbouring vectors as samples, within a lag of 8."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rows.join(other, "vec_id").select("vec_id", G.likeness("embedding", "other", F.lit(8)).alias("l")).select("vec_id", F.col("l.score").alias("likeness"), "l.lag")


QUIET_SQL = "SELECT vec_id, list_transform(range(0, 9), lambda k: sqrt(list_sum(list_transform(embedding[{low}:{high}], lambda v: v::DOUBLE * v::DOUBLE)) / 3)) AS r FROM embeddings"
MOVED_SQL = "coalesce(list_position(list_transform(r, lambda x: x <= greatest(list_min(r) * 1.1220184543019633, 0.001)), true) - 1, 0)"


@query(f"WITH d AS ({QUIET_SQL.format(low='31 - 3 * k', high='33 - 3 * k')}), u AS ({QUIET_SQL.format(low='28 + 3 * k', high='30 + 3 * k')}) SELECT d.vec_id, (-3 * (SELECT {MOVED_SQL} FROM (SELECT d.r)))::INT AS down, (3 * (SELECT {MOVED_SQL} FROM (SELECT u.r)))::INT AS up FROM d JOIN u ON u.vec_id = d.vec_id")
def fn_quietest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far an edge at 30 moves each way, in frames of 3 of a vector's components."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select("vec_id", G.quietest(F.col("embedding"), F.lit(30), -3).alias("down"), G.quietest(F.col("embedding"), F.lit(30), 3).alias("up"))


@query()
def plan_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole scan of documents, a word each 0.3 s."""
    rows = lines(spark, sf_dir).select(F.col("doc_id").cast("string").alias("media"), F.posexplode_outer(X.split_words(F.col("text"))).alias("pos", "text")).where("pos IS NOT NULL")
    words = rows.select("media", "pos", "text", (F.col("pos") * 0.3).alias("start"), (F.col("pos") * 0.3 + 0.25).alias("end"), F.lit(1.0).alias("probability"))
    return scan(words, TERMS[:3])[1]


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def ag_verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.verdict_counts(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"])


@query("SELECT o_custkey, CASE WHEN count(*) FILTER (o_orderstatus = 'F') = count(*) THEN 'all' WHEN count(*) FILTER (o_orderstatus = 'F') = 0 THEN 'none' ELSE 'some' END AS cached FROM orders GROUP BY o_custkey")
def ag_from_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_cache(table(spark, sf_dir, "orders"), ["o_custkey"], F.col("o_orderstatus") == "F")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'no-anchors' WHEN s_suppkey % 10 < 5 THEN 'unmatched' WHEN s_acctbal > 5000 THEN 'error' WHEN s_nationkey < 6 OR s_nationkey % 4 = 3 THEN 'fidelity' END AS problem FROM supplier")
def dt_sync_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as candidates: every seventh has no anchor, and in some nations nothing was heard."""
    none = F.col("s_suppkey") % 7 == 0
    heard = F.when(F.col("s_nationkey") % 4 != 3, F.col("s_nationkey") / 10)
    problem = A.decision(F.when(none, 0).otherwise(F.col("s_suppkey") % 10), F.when(none, 0).otherwise(10), F.col("s_acctbal") / 10000, heard)
    return table(spark, sf_dir, "supplier").select("s_suppkey", problem.alias("problem"))


@query("SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN '/v/' || c_custkey || '.clean.mkv' ELSE '/v/' || c_custkey || '.mkv' END AS output, CASE WHEN c_nationkey % 3 = 1 THEN '/v/' || c_custkey || '.original.mkv' END AS backup FROM customer")
def dt_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_nationkey") % 3
    path = F.concat(F.lit("/v/"), F.col("c_custkey").cast("string"), F.lit(".mkv"))
    out = D.placement(F.when(n == 0, "new").when(n == 1, "backup").otherwise("in_place"), F.lit(None).cast("string"), path)
    return table(spark, sf_dir, "customer").select("c_custkey", out["output"].alias("output"), out["backup"].alias("backup"))


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'pt' WHEN 3 THEN 'fr' WHEN 4 THEN 'zh' END AS language, CASE WHEN p_size > 25 THEN '24000/1001' ELSE '25' END AS rate, round(CASE WHEN p_size > 25 THEN 24000 / 1001.0 ELSE 25 END, 6)::DOUBLE AS fps FROM part")
def fn_lang_and_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.when(F.col("p_size") > 25, "24000/1001").otherwise("25")
    return table(spark, sf_dir, "part").select("p_partkey", D.language_of(F.get(F.array(*map(F.lit, ("eng", "German", "pt", "FRE", "chinese", "xx"))), F.col("p_size") % 6)).alias("language"), shown.alias("rate"), F.round(X.rate(shown), 6).alias("fps"))


# ---- small projections, filters, joins and aggregates ----------------------------------------------------------------

PART = "part"


@query("SELECT p_partkey, p_retailprice + 3 * (p_size / 100.0::DOUBLE) AS padding FROM part")
def prj_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search padding: what is set, and three times the fit's error."""
    return table(spark, sf_dir, PART).select("p_partkey", N.padding(F.col("p_retailprice"), F.col("p_size") / 100).alias("padding"))


@query(f"WITH {EV} SELECT id, least(10000, (b - a) / 3.0::DOUBLE) AS fade FROM e")
def prj_fade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("id", S.fade_of(F.col("start"), F.col("end"), 10000.0).alias("fade"))


@query(f"WITH {EV} SELECT id, a + 35000 AS start, b - 35000 AS \"end\" FROM e WHERE (b - 35000) - (a + 35000) >= 20000")
def prj_verify_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans without their fades and margins, where something is left."""
    return S.core(events(spark, sf_dir), 35000, 20000).select("id", "start", "end")


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_quantity, l_discount * 100), l_quantity - 0.5) AS start, least(greatest(l_quantity + 1, l_tax * 1000), l_quantity + 1.5) AS \"end\" FROM lineitem")
def prj_widen_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned times may only widen a word, by half a second at most."""
    rows, start = table(spark, sf_dir, "lineitem"), F.col("l_quantity")
    low, high = L.widen(start, start + 1, F.col("l_discount") * 100, F.col("l_tax") * 1000)
    return rows.select("l_orderkey", "l_linenumber", low.alias("start"), high.alias("end"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 25 / 23.976::DOUBLE WHEN p_size % 3 = 1 THEN 23.976::DOUBLE / 25 ELSE 1.5 END AS ratio FROM part")
def prj_frame_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratios of frame rates near a standard one."""
    n = F.col("p_size") % 3
    ratio = F.when(n == 0, F.lit(25.0) / 23.9761).when(n == 1, F.lit(23.976) / 25.0001).otherwise(1.5)
    return table(spark, sf_dir, PART).select("p_partkey", A.snap(ratio).alias("ratio"))


@query("WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity AS a, l_quantity + 1 AS b FROM lineitem) SELECT l_orderkey, l_linenumber FROM m WHERE a >= 10.5 AND b <= 40")
def flt_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a window from 10 to 40, clean at its end only."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("start"), (F.col("l_quantity") + 1).alias("end"), F.lit(10.0).alias("ws"), F.lit(40.0).alias("we"))
    return L.inner_words(rows, "ws", "we", 0.5, F.lit(False), F.lit(True)).select("l_orderkey", "l_linenumber")


@query(f"WITH {EV}, m AS (SELECT id, (a % 100) / 10.0::DOUBLE AS g, (a % 100) / 10.0::DOUBLE + (b % 30) / 10.0::DOUBLE AS h FROM e), x AS (SELECT id, greatest(g - 2, 0) AS p, least(h + 2, 20) AS q FROM m), y AS (SELECT id, greatest(p - greatest(4 - (q - p), 0) / 2, 0) AS p, q FROM x), z AS (SELECT id, p, least(greatest(q, p + 4), 20) AS q FROM y) SELECT id, round(greatest(least(p, q - 4), 0), 6) AS start, round(q, 6) AS \"end\" FROM z")
def prj_fill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of a window from 0 to 20 with margins and a least length."""
    rows = events(spark, sf_dir).select("id", ((F.col("start") % 100) / 10).alias("g"), ((F.col("end") % 30) / 10).alias("n"))
    low, high = L.fill_gap(F.col("g"), F.col("g") + F.col("n"), F.lit(0.0), F.lit(20.0), 2, 4)
    return rows.select("id", F.round(low, 6).alias("start"), F.round(high, 6).alias("end"))


@query(f"WITH {CUES}, f AS (SELECT *, length(regexp_extract(text, '^\\S+')) AS n FROM c WHERE text <> '') SELECT media, cue, round(a + (b - a) * 0 / length(text)::DOUBLE - 0.3, 6)::DOUBLE AS start, round(a + (b - a) * n / length(text)::DOUBLE + 0.3, 6)::DOUBLE AS \"end\", 0.2::DOUBLE AS confidence FROM f WHERE n > 0")
def prj_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a line's first word would be said."""
    n = F.length(F.regexp_extract("text", r"^\S+", 0))
    rows = cue_rows(spark, sf_dir).where((F.col("text") != "") & (n > 0)).withColumn("words", F.array(F.struct(F.lit(0).alias("first"), n.alias("last"), F.lit("x").alias("term"))))
    return L.estimates(rows, 0.3).select("media", "cue", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "confidence")


@query(f"WITH {EV} SELECT id, max(b) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS reach, row_number() OVER (PARTITION BY media ORDER BY a, b, id)::INT AS number FROM e")
def an_running_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.running_reach(events(spark, sf_dir), ["media"], ["id"]).select("id", "reach", "number")


@query(f"WITH {WORDS}, f AS (SELECT DISTINCT doc_id, {FOLD} AS token FROM t), n AS (SELECT token, count(*) AS n FROM f GROUP BY token) SELECT doc_id, count(*) FILTER (n <= 2) AS rare FROM f JOIN n USING (token) GROUP BY doc_id")
def ag_rare_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of a document that stand in two documents at most."""
    return R.rare_values(lines(spark, sf_dir), "doc_id", F.array_distinct(X.folded_words(X.split_words(F.col("text")))), X.has_words(F.col("text")))


@query("SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def ag_cache_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.cache_usage(table(spark, sf_dir, "documents"), ["source"], F.octet_length("text"))


@query("SELECT o.o_orderkey, l.n IS NOT NULL AS withdrawn FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def jn_withdraw(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return D.withdrawn(table(spark, sf_dir, "orders").select("o_orderkey"), failed, ["o_orderkey"])


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey FROM orders o WHERE o_orderpriority LIKE '1%' AND NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderstatus = 'F' AND x.o_orderkey = o.o_orderkey)")
def jn_cached_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found online, and cached entries that are not among it."""
    rows = table(spark, sf_dir, "orders")
    return D.cached_and_found(rows.where("o_orderstatus = 'F'").select("o_orderkey"), rows.where("o_orderpriority like '1%'").select("o_orderkey"), ["o_orderkey"])


@query(f"WITH {SIDES} SELECT id FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.media = d.media AND f.a < d.b AND d.a < f.b)")
def jn_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that no interval covers (open)."""
    flags, found = two_sides(spark, sf_dir)
    return S.overlap_filter(found.withColumnRenamed("r_id", "id"), flags.select("media", "start", "end"), ["media"], BIN, "id", anti=True, a=("r_start", "r_end"), b=("start", "end")).select("id")


@query(f"WITH {SIDES} SELECT id FROM d WHERE EXISTS (SELECT 1 FROM f WHERE f.media = d.media AND f.a < d.b AND d.a < f.b)")
def jn_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.overlap_filter(found.withColumnRenamed("r_id", "id"), flags.select("media", "start", "end"), ["media"], BIN, "id", a=("r_start", "r_end"), b=("start", "end")).select("id")


@query(f"WITH {SIDES} SELECT id FROM f WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.media = f.media AND d.a < f.b AND f.a < d.b)")
def jn_not_spliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, found = two_sides(spark, sf_dir)
    return S.overlap_filter(flags, found, ["media"], BIN, "id", anti=True).select("id")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderpriority LIKE '5%' OR o_orderpriority LIKE '4%')")
def flt_machine_translated(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = D.machine_translated(F.col("o_orderpriority").startswith("5"), F.col("o_orderpriority").startswith("4"))
    return table(spark, sf_dir, "orders").where(~made).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice < 200000 - greatest(2, 0.01 * 200000) AS short FROM orders")
def flt_output_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs shorter than they should be by two seconds or a hundredth."""
    return table(spark, sf_dir, "orders").select("o_orderkey", D.too_short(F.col("o_totalprice"), F.lit(200000)).alias("short"))


@query("""WITH s AS (SELECT o_custkey AS media, o_orderkey AS i, o_orderstatus = 'P' AS other, CASE WHEN o_orderpriority LIKE '1%' THEN NULL WHEN o_orderpriority LIKE '2%' THEN 'ger' ELSE 'eng' END AS l, o_orderkey % 4 = 0 AS d, (o_orderkey % 3)::INT AS c FROM orders)
SELECT media, i AS stream FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY other, coalesce(l <> 'eng', true), NOT d, c DESC, i) AS k FROM s) WHERE k = 1""")
def flt_dialogue_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sound streams of their customers."""
    rows, first = table(spark, sf_dir, "orders"), F.substr("o_orderpriority", F.lit(1), F.lit(1))
    flag = lambda c: F.when(c, 1).otherwise(0)
    streams = rows.select(
        F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("index"), F.lit("audio").alias("kind"), F.when(first == "1", None).when(first == "2", "ger").otherwise("eng").alias("language"), F.lit(None).cast("string").alias("title"),
        (F.col("o_orderkey") % 3).cast("int").alias("channels"), F.create_map(F.lit("comment"), flag(F.col("o_orderstatus") == "P"), F.lit("default"), flag(F.col("o_orderkey") % 4 == 0)).alias("disposition"),
    )
    return D.dialogue_stream(streams, "english").select("media", F.col("index").alias("stream"))


@query("SELECT o_custkey, sum(least(a, b))::BIGINT AS both FROM (SELECT o_custkey, o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS a, count(*) FILTER (o_orderstatus = 'O') AS b FROM orders GROUP BY 1, 2) GROUP BY o_custkey HAVING sum(least(a, b)) > 0")
def set_intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of the multiset intersection of priorities of finished and open orders."""
    rows = table(spark, sf_dir, "orders")
    return R.shared_times(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'O'"), ["o_custkey"], "o_orderpriority")


@query("SELECT lang, string_agg(source, ',' ORDER BY f, source) AS found, count(*) AS sources FROM (SELECT lang, source, min(doc_id) AS f FROM documents WHERE source IS NOT NULL GROUP BY lang, source) GROUP BY lang")
def set_distinct_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each language in the order in which they come first."""
    rows = R.distinct_in_order(table(spark, sf_dir, "documents"), ["lang"], "source", "doc_id")
    return rows.select("lang", F.array_join("values", ",").alias("found"), F.size("values").cast("long").alias("sources"))


@query(f"WITH {SIDES}, g AS (SELECT media, a, b, id FROM f WHERE b > a), p AS (SELECT g.id, list_sort(list_distinct(list(d.conf > 30))) AS reasons, count(*) AS n FROM g JOIN d ON d.media = g.media AND d.a < g.b AND g.a < d.b GROUP BY g.id) SELECT id, len(reasons)::INT AS reasons, n FROM p")
def jn_touching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reasons touch each piece."""
    flags, found = two_sides(spark, sf_dir)
    pairs = S.overlap_join(flags.where("end > start"), found, ["media"], BIN)
    return pairs.groupBy("id").agg(F.size(F.collect_set(F.col("r_conf") > 30)).alias("reasons"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {CUES} SELECT media, cue, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY media ORDER BY cue ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heard FROM c WHERE cue % 2 = 1")
def jn_neighbour_heard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spoken line before, among every other one."""
    return C.neighbours(cue_rows(spark, sf_dir).where("cue % 2 = 1"), ["media"], "cue", "text").select("media", "cue", F.col("previous").alias("heard"))


@query(merged_sql("a - reached >= 30000000", where="WHERE term = 'view'"))
def m10_speech_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech joined over short pauses."""
    return S.merge_spans(events(spark, sf_dir).where("term = 'view'"), ["media"], 30 * SECOND)


@query(merged_sql("a > reached", where="WHERE b > a AND b > 0"))
def m8_report_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_spans(events(spark, sf_dir).where("end > start and end > 0"), ["media"], 0, closed=True)


@query(f"WITH {EV}, w AS (SELECT * FROM e WHERE term = 'view' AND b > a), s AS (SELECT media, a, b FROM e WHERE term <> 'view'), q AS (SELECT media, a, b, max(b) OVER (PARTITION BY media ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s), i AS (SELECT *, sum((r IS NULL OR a > r)::INT) OVER (PARTITION BY media ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM q), c AS (SELECT media, min(a) AS a, max(b) AS b FROM i GROUP BY media, k), p AS (SELECT w.id, greatest(w.a, c.a) AS x, least(w.b, c.b) AS y FROM w JOIN c ON c.media = w.media AND c.a < w.b AND w.a < c.b UNION ALL SELECT id, a, a FROM w UNION ALL SELECT id, b, b FROM w), g AS (SELECT id, y AS start, lead(x) OVER (PARTITION BY id ORDER BY x, y) AS \"end\" FROM p) SELECT id, start, \"end\" FROM g WHERE \"end\" - start > 1000")
def m15_cache_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cached spans leave to compute of each window."""
    rows = events(spark, sf_dir)
    gaps = L.cached(rows.where("term = 'view' and end > start"), rows.where("term <> 'view'"), ["media"], "id", BIN, 1001)[1]
    return gaps.select("id", "start", "end")


@query("WITH t AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 're:' ELSE '' END || lower(substr(p_brand, 1, 1 + p_size % 6)) || CASE WHEN p_size % 2 = 0 THEN '*' ELSE '' END || ' ' || lower(p_type) AS term FROM part) SELECT p_partkey, term, term NOT LIKE 're:%' AND len(list_filter(string_split(term, ' '), lambda w: contains(w, '*') AND length(regexp_replace(w, '\\P{L}', '', 'g')) < 3)) > 0 AS broad FROM t")
def fn_warn_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms with a wildcard word of under three letters."""
    term = F.concat(F.when(F.col("p_size") % 3 == 0, "re:").otherwise(""), F.lower(F.substr("p_brand", F.lit(1), 1 + F.col("p_size") % 6)), F.when(F.col("p_size") % 2 == 0, "*").otherwise(""), F.lit(" "), F.lower("p_type"))
    return M.broad_terms(table(spark, sf_dir, "part").select("p_partkey", term.alias("term")))


@query("SELECT doc_id, l, p::INT AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS p FROM documents) WHERE regexp_matches(l, '(?i)licen[cs]e')")
def flt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a pattern of the user's matches."""
    return X.matching_lines(lines(spark, sf_dir), "doc_id", "(?i)licen[cs]e").select("doc_id", "l", "line")


@query()
def fn_fade_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What fades each vector into its reverse."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rows.select("vec_id", F.transform(G.change(F.col("x"), F.reverse("x"), G.fade_mask(64, 8)), lambda v: F.round(v, 6)).alias("change"))


@query()
def snk_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review subtitle for each media: merged spans with the terms that they hold."""
    rows = events(spark, sf_dir)
    spans = S.merge_spans(rows.where("end > start"), ["media"], GAP, aggregates=[F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("start", "term"))), lambda x: x["term"])), " / ").alias("text")])
    low = spans.groupBy("media").agg(F.min("start").alias("zero"))
    seconds = lambda c: (F.col(c) - F.col("zero")) / 1e6
    return K.subtitles(spans.join(low, "media").select(F.col("media").cast("string").alias("media"), seconds("start").alias("start"), seconds("end").alias("end"), "text"))
