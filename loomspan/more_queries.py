"""More registered queries: the guided plan, decisions in context, sources, file masking, sound and small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import masking as W
from loomspan.functions import text as X
from loomspan.functions.charset import decode_text
from loomspan.operators import context as C
from loomspan.operators import guided as N
from loomspan.operators import lines as L
from loomspan.operators import matching as M
from loomspan.operators import media as D
from loomspan.operators import ranking as R
from loomspan.operators import signals as G
from loomspan.operators import spans as S
from loomspan.operators import sync as A
from loomspan.queries import BIN, CUES, EV, NORM, SECOND, SIDES, TERMS, WORDS, cue_rows, cue_seconds, events, lines, merged_sql, query, table
from loomspan.session import scratch
from loomspan.sources import sinks as K
from loomspan.sources import subtitles as Q

# ---- the guided plan -------------------------------------------------------------------------------------------------


def flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media, cue, start, end, reasons): events as flagged lines, in seconds."""
    reason = F.when(F.col("term") == "click", "lexicon").when(F.col("term") == "view", "hint").otherwise("masked")
    return events(spark, sf_dir).select("media", F.col("id").alias("cue"), (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.array(reason).alias("reasons"))


FLAGS = f"{EV}, f AS (SELECT media, id AS cue, a / 1e6 AS a, b / 1e6 AS b, CASE term WHEN 'click' THEN 'lexicon' WHEN 'view' THEN 'hint' ELSE 'masked' END AS reason FROM e)"


@query(f"WITH {FLAGS} SELECT media, 1.001 * a + 2.5 - 2.3 AS start, 1.001 * b + 2.5 + 2.3 AS \"end\", reason AS reasons, cue FROM f")
def prj_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = N.windows(flags(spark, sf_dir), ["media"], F.lit(2.3), F.lit(1.001), F.lit(2.5))
    return rows.select("media", "start", "end", F.array_join("reasons", ",").alias("reasons"), F.get("cues", F.lit(0)).alias("cue"))


@query(f"WITH {EV} SELECT id FROM e WHERE b - a >= {1800 * SECOND}")
def flt_min_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.long_enough(events(spark, sf_dir), 1800 * SECOND).select("id")


@query(f"WITH {FLAGS} SELECT media, count(*) FILTER (reason = 'lexicon') AS lexicon, count(*) FILTER (reason = 'masked') AS masked, count(*) FILTER (reason = 'hint') AS hint FROM f GROUP BY media")
def ag_flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.flag_counts(flags(spark, sf_dir), ["media"])


@query(f"""WITH {FLAGS}, c AS (SELECT media, a, b, reason <> 'hint' AS strong, EXISTS (SELECT 1 FROM f d WHERE d.reason = 'masked' AND d.media = f.media AND d.a <= f.b AND f.a <= d.b) AS ok FROM f),
n AS (SELECT media, count(*) FILTER (strong) AS strong, count(*) FILTER (strong AND ok) AS confirmed FROM c GROUP BY media) SELECT *, strong >= 3 AND 2 * confirmed < strong AS doubtful FROM n""")
def ag_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many strong flags some masked event meets, and whether those are too few."""
    rows = flags(spark, sf_dir)
    heard = rows.where(F.array_contains("reasons", "masked")).select("media", "start", "end")
    return N.confirmation(N.confirmed(rows, heard, ["media"], "cue", 3600), ["media"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'no subtitles' WHEN o_orderkey % 2 = 0 AND o_totalprice / 400000 > 0.6 THEN 'coverage' WHEN o_orderkey % 2 = 0 AND o_orderpriority LIKE '1%' THEN 'not confirmed' END AS fallback FROM orders")
def dt_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    why = N.fallback(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 400000, F.col("o_orderpriority").startswith("1"), F.col("o_orderkey") % 2 == 0, 0.6)
    return table(spark, sf_dir, "orders").select("o_orderkey", why.alias("fallback"))


@query()
def plan_guided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to listen to of each user's month: windows of flagged events and of views that no other event covers."""
    rows = flags(spark, sf_dir)
    zero = rows.groupBy("media").agg(F.min("start").alias("zero"), (F.max("end") - F.min("start")).alias("duration"))
    rows = rows.join(zero, "media").withColumns({c: F.col(c) - F.col("zero") for c in ("start", "end")}).drop("zero", "duration")
    views = F.array_contains("reasons", "hint")
    speech = rows.where(views & (F.col("end") > F.col("start"))).select("media", F.col("cue").alias("id"), "start", "end")
    cues = rows.where(~views)
    o = N.GuidedOptions(padding=90, least=300, most=7200, gap=120, overlap=60, margin=30, uncovered=30, bin=7200)
    films = zero.select("media", "duration", F.lit(3.0).alias("error"))
    return N.guided(cues, speech, cues, films, "media", o)[0].select("media", "piece", "start", "end", F.array_join("reasons", ",").alias("reasons"), F.size("cues").alias("n_cues"))


@query(merged_sql("a - reached >= 100000"))
def m6_refine_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moved edges merged again where less than a tenth of a second parts them."""
    return S.merge_spans(events(spark, sf_dir), ["media"], 100000)


@query(f"WITH {SIDES} SELECT id, media, a AS start, b AS \"end\" FROM d UNION ALL SELECT id, media, a, b FROM f")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("id", "media", "start", "end", "term")
    return rows.where("term = 'click'").unionByName(rows.where("term = 'purchase'")).drop("term")


@query(f"WITH {EV} SELECT media, id, row_number() OVER (PARTITION BY media ORDER BY a, b, id)::INT AS place FROM e")
def srt_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(events(spark, sf_dir), ["media"], F.col("start"), F.col("end"), F.col("id"), rank="place").select("media", "id", "place")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice, p_partkey)::INT AS rank FROM part")
def srt_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.ranked(table(spark, sf_dir, "part"), ["p_brand"], F.desc("p_size"), F.col("p_retailprice"), F.col("p_partkey")).select("p_partkey", "rank")


# ---- decisions in context --------------------------------------------------------------------------------------------


@query("""SELECT o_custkey AS media, o_orderkey AS start, o_orderkey + 1 AS "end", o_orderstatus AS term, 'listed' AS category FROM orders WHERE NOT o_orderpriority LIKE '1%'
UNION ALL SELECT l_suppkey, l_orderkey, l_orderkey + l_linenumber, 'sexual line', 'context' FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> ''""")
def dt_to_mute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as detections, those of first priority harmless; returned items as certain lines."""
    use = F.when(F.col("o_orderpriority").startswith("1"), "harmless").otherwise("profane")
    found = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("media"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 1).alias("end"), F.col("o_orderstatus").alias("term"), F.lit("listed").alias("category"), use.alias("use"))
    said = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("media"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_linenumber")).alias("end"), F.col("l_linestatus").alias("text"), (F.col("l_returnflag") == "R").alias("certain"))
    return C.to_mute(found, said, True, True)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'probably harmless: ' || o_orderpriority WHEN o_orderstatus = 'P' THEN 'unsure: ' || o_orderpriority WHEN o_orderpriority = '5-LOW' THEN 'sexual line' END AS note FROM orders")
def dt_review_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    use = F.when(F.col("o_orderstatus") == "F", "harmless").when(F.col("o_orderstatus") == "P", "unsure").otherwise("profane")
    reason = F.when((use == "profane") & (F.col("o_orderpriority") == "5-LOW"), "sexual line").otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select("o_orderkey", C.review_note(use, reason).alias("note"))


@query(r"""WITH c AS (SELECT *, regexp_extract(text, '^(\w+)', 1) AS w FROM conversations),
h AS (SELECT *, CASE WHEN w IN ('To', 'That', 'La', 'Thatble') THEN (5 - length(w)) * len(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_'']+'), lambda x: lower(x) = lower(w))) ELSE 0 END AS more FROM c)
SELECT conv_id, turn, CASE WHEN text <> '' THEN (length(text) + more) % 100 / 100.0 ELSE 0 END::DOUBLE AS rude FROM h""")
def dt_score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of turns, known by the text in which the ambiguous first word, where there is one, is hidden."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    heard = rows.select("conv_id", "turn", F.regexp_extract("text", r"^(\w+)", 1).alias("word")).where("word in ('To', 'That', 'La', 'Thatble')")
    hidden = C.shown_lines(rows, heard, ["conv_id", "turn"])
    scores = hidden.select(F.col("shown").alias("text"), (F.length("shown") % 100 / 100).alias("rude")).distinct()
    return C.scored_lines(rows, heard, scores, ["conv_id", "turn"], ("rude",)).select("conv_id", "turn", "rude")


@query("SELECT p_partkey, array_to_string(list_concat(CASE WHEN p_size >= 40 THEN ['classifier ' || printf('%.2f', p_size / 100.0::DOUBLE)] ELSE [] END, ['phrase ' || chr(34) || lower(p_brand) || chr(34) || CASE WHEN p_brand = 'Brand#11' THEN ' (ambiguous)' ELSE '' END], CASE WHEN p_size % 2 = 0 THEN ['sound [kiss]'] ELSE [] END, CASE WHEN p_size % 5 = 0 AND p_brand = 'Brand#11' AND p_size < 40 THEN ['judge'] ELSE [] END), '; ') AS evidence, p_size >= 40 OR p_brand <> 'Brand#11' OR p_size % 5 = 0 AS certain FROM part")
def dt_sexual_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size")
    sounds = F.when(n % 2 == 0, F.array(F.lit("kiss"))).otherwise(F.array().cast("array<string>"))
    found = C.sexual_line(n / 100, F.array(F.lower("p_brand")), ["brand#11"], sounds, n % 5 == 0, 0.4)
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", F.array_join("f.evidence", "; ").alias("evidence"), "f.certain")


@query("SELECT p_brand, count(*) FILTER (p_size > 25) AS certain, count(*) FILTER (NOT p_size > 25) AS possible FROM part GROUP BY p_brand")
def ag_sexual_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.sexual_counts(table(spark, sf_dir, "part").withColumn("certain", F.col("p_size") > 25), ["p_brand"])


@query("WITH a AS (SELECT o_orderpriority AS model, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderpriority AS model, count(*) AS n FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority LIKE '3%' GROUP BY 1) SELECT a.model, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b ON a.model = b.model WHERE a.n > coalesce(b.n, 0)")
def ag_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by model since an earlier count."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("model"), "o_orderstatus")
    count = lambda df: df.groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    return C.answered(count(rows.where("o_orderstatus = 'F' or model like '3%'")), count(rows))


@query("SELECT p_brand AS category, count(*) AS n FROM part GROUP BY p_brand")
def ag_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.term_counts(table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("category")))


@query("SELECT l_suppkey, median(l_extendedprice) AS middle, quantile_disc(l_extendedprice, 0.5) AS low_middle FROM lineitem GROUP BY l_suppkey")
def ag_median_low(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.median_low(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("SELECT l_suppkey, median(CASE WHEN l_linenumber > 1 THEN l_discount END) AS fidelity FROM lineitem GROUP BY l_suppkey")
def ag_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians over what was heard; nulls were not."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") > 1, F.col("l_discount")).alias("fidelity"))
    return A.fidelity(rows, ["l_suppkey"])


@query("SELECT l_suppkey, median(l_extendedprice - 2.0 * l_quantity) AS \"offset\" FROM lineitem GROUP BY l_suppkey")
def ag_median_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("r", F.col("l_extendedprice") - 2.0 * F.col("l_quantity"))
    return C.median_low(rows, ["l_suppkey"], "r").select("l_suppkey", F.col("middle").alias("offset"))


@query()
def fn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.phrases(lines(spark, sf_dir), "doc_id", ["of the", "that is", "*tion"]).select("doc_id", F.array_join("found", "|").alias("found"))


@query(f"""WITH s AS (SELECT p_partkey, [split_part(lower(p_type), ' ', 1) || ' is heard', CASE p_size % 4 WHEN 0 THEN 'soft moaning' WHEN 1 THEN 'she pants' WHEN 2 THEN 'breathing heavily' ELSE 'panther growls' END, 'door creaks'] AS l FROM part)
SELECT p_partkey, array_to_string(list_filter(l, lambda x: regexp_matches(x, '{X.SEXUAL_SOUNDS}')), ',') AS sounds FROM s""")
def fn_sexual_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sounds a part, of which the second, named by the part's size, is sexual for three sizes of four."""
    second = F.get(F.array(*map(F.lit, ("soft moaning", "she pants", "breathing heavily", "panther growls"))), (F.col("p_size") % 4).cast("int"))
    sounds = F.array(F.concat(F.split_part(F.lower("p_type"), F.lit(" "), F.lit(1)), F.lit(" is heard")), second, F.lit("door creaks"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.sexual_sounds(sounds), ",").alias("sounds"))


@query()
def fn_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a judge would be asked about every turn's first word, between its neighbours."""
    rows = C.neighbours(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text")
    shown = C.dialogue(F.col("previous"), F.coalesce("text", F.lit("")), F.col("following"))
    return rows.select("conv_id", "turn", C.question("sense", shown, F.regexp_extract("text", r"^\S*", 0)).alias("question"))


@query(f"""WITH {EV}, t AS (SELECT * FROM e WHERE term = 'purchase' AND b > a), d AS (SELECT * FROM e WHERE term = 'click'),
m0 AS (SELECT media, a, b, max(b) OVER (PARTITION BY media ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e WHERE term = 'view'), m1 AS (SELECT *, sum((r IS NULL OR a > r)::INT) OVER (PARTITION BY media ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m0), m AS (SELECT media, min(a) AS a, max(b) AS b FROM m1 GROUP BY media, i),
s AS (SELECT t.id, sum(least(t.b, m.b) - greatest(t.a, m.a)) AS s FROM t JOIN m ON m.media = t.media AND m.a < t.b AND t.a < m.b GROUP BY t.id),
n AS (SELECT t.id, d.a - t.a AS x, d.b - t.b AS y, row_number() OVER (PARTITION BY t.id ORDER BY abs(d.a - t.a), d.a, d.b) AS k FROM t JOIN d ON d.media = t.media AND d.a < t.b AND t.a < d.b)
SELECT t.id, coalesce(s.s, 0) / (t.b - t.a) AS covered, n.x AS start_error, n.y AS end_error FROM t LEFT JOIN s ON s.id = t.id LEFT JOIN n ON n.id = t.id AND n.k = 1""")
def jn_truth_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as truth, merged views as muted spans, clicks as detections."""
    rows = events(spark, sf_dir)
    muted = S.merge_spans(rows.where("term = 'view'").select("media", "start", "end"), ["media"], 0, closed=True)
    return C.truth_overlap(rows.where("term = 'purchase' and end > start"), muted, rows.where("term = 'click'"), ["media"], "id", BIN).select("id", "covered", "start_error", "end_error")


# ---- sources and names -----------------------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' WHEN 2 THEN 'hi' END AS language, p_size % 5 = 0 OR p_size % 4 = 0 AS hearing, p_size % 3 = 0 AS forced FROM part")
def fn_name_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with a language, hi, sdh and forced among their tokens."""
    n = F.col("p_size")
    tokens = F.array_compact(F.array(F.lower("p_type"), F.when(n % 4 == 0, "en").when(n % 4 == 1, "German").when(n % 4 == 2, "hi"), F.when(n % 4 == 0, "hi"), F.when(n % 5 == 0, "SDH"), F.when(n % 3 == 0, "forced")))
    return table(spark, sf_dir, "part").select("p_partkey", D.name_flags(tokens).alias("f")).select("p_partkey", "f.*")


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the streams of orders, as a probe writes them."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    n = F.col("l_linenumber")
    one = F.struct(
        n.alias("index"), F.when(n % 2 == 0, "subtitle").otherwise("audio").alias("codec_type"), F.when(n % 4 == 0, "dvd_subtitle").otherwise("subrip").alias("codec_name"), n.cast("int").alias("channels"), F.lit("0/0").alias("r_frame_rate"), F.format_string("%d.5", n).alias("duration"),
        F.create_map(F.lit("language"), F.when(F.col("l_returnflag") == "R", "ger").otherwise("eng"), F.lit("title"), F.when(F.col("l_partkey") % 5 == 0, "English SDH").when(F.col("l_partkey") % 5 == 1, "Comments").otherwise("Plain")).alias("tags"),
        F.create_map(F.lit("default"), flag(n == 2), F.lit("forced"), flag(F.col("l_linestatus") == "F")).alias("disposition"),
    )
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("media")).agg(F.array_sort(F.collect_list(one), lambda a, b: a["index"] - b["index"]).alias("streams"))
    return rows.select("media", F.to_json(F.struct("streams")).alias("json"))


@query("SELECT l_orderkey::VARCHAR AS media, l_linenumber::INT AS \"index\", (max(l_linenumber) OVER (PARTITION BY l_orderkey) + 0.5)::DOUBLE AS duration, CASE WHEN l_linenumber % 2 = 0 THEN 'subtitle' ELSE 'audio' END AS kind, CASE WHEN l_returnflag = 'R' THEN 'ger' ELSE 'eng' END AS language FROM lineitem")
def src_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.probe(streams(spark, sf_dir)).select("media", "index", "duration", "kind", "language")


@query("SELECT l_orderkey::VARCHAR AS media, l_linenumber::INT AS \"index\", CASE WHEN l_returnflag = 'R' THEN 'de' ELSE 'en' END AS language, l_partkey % 5 = 0 AS hearing, l_linestatus = 'F' AS forced, CASE WHEN l_linenumber = 2 THEN 5 ELSE 0 END::DOUBLE AS bonus FROM lineitem WHERE l_linenumber % 4 = 2 AND l_partkey % 5 <> 1")
def src_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.embedded(D.probe(streams(spark, sf_dir))).select("media", "index", "language", "hearing", "forced", "bonus")


FILES = "v AS (SELECT o_custkey AS c, '/v/' || o_custkey || '/' || o_orderkey || '.mkv' AS media, o_orderkey AS k, o_orderstatus AS s FROM orders)"


@query(f"WITH {FILES} SELECT media, '/v/' || c || CASE WHEN s = 'O' THEN '/Subs/' ELSE '/' END || k || '.de.srt' AS path, 'de' AS language, CASE WHEN s = 'O' THEN 0 ELSE 5 END::DOUBLE AS bonus FROM v WHERE s <> 'P' UNION ALL SELECT media, '/v/' || c || '/subs/' || k || '/2_English.srt', 'en', 0 FROM v WHERE s = 'P'")
def src_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as videos in their customer's folder, with a subtitle beside them, in a folder, or in a folder of their own."""
    o = table(spark, sf_dir, "orders").select(F.concat(F.lit("/v/"), "o_custkey", F.lit("/")).alias("f"), F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"))
    videos = o.select(F.concat("f", "k", F.lit(".mkv")).alias("path"))
    path = F.when(F.col("s") == "O", F.concat("f", F.lit("Subs/"), "k", F.lit(".de.srt"))).when(F.col("s") == "P", F.concat("f", F.lit("subs/"), "k", F.lit("/2_English.srt"))).otherwise(F.concat("f", "k", F.lit(".de.srt")))
    return D.sidecars(o.select(path.alias("path")), videos).select("media", "path", "language", "bonus")


@query("SELECT c_custkey::VARCHAR AS media, '/s/Film ' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '.eng.forced' ELSE '.fr' END || '.srt' AS path, CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'fr' END AS language, false AS hearing, c_nationkey % 2 = 0 AS forced FROM customer")
def src_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("/s/Film "), "c_custkey", F.when(F.col("c_nationkey") % 2 == 0, ".eng.forced").otherwise(".fr"), F.lit(".srt"))
    return D.explicit(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("media"), name.alias("path"))).select("media", "path", "language", "hearing", "forced")


@query("SELECT c_custkey, '/v/' || c_custkey || '.report.json' AS report, '/v/' || c_custkey || '.review.srt' AS review, '/v/' || c_custkey || CASE WHEN c_nationkey % 2 = 0 THEN '.original' ELSE '' END || '.edl' AS edl, '/v/out/' || c_custkey || '.clean.mkv' AS output FROM customer")
def fn_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("/v/"), "c_custkey", F.lit(".mkv"))
    backup = F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("/v/"), "c_custkey", F.lit(".original.mkv")))
    out = D.from_template(path, F.lit("out/{stem}.clean{ext}"))
    return table(spark, sf_dir, "customer").select("c_custkey", *(c.alias(n) for n, c in D.paths(path, backup).items()), out.alias("output"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders x WHERE x.o_orderkey + 32 = o.o_orderkey)")
def jn_outputs_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that are not another input's output: each order's output is named for the order 32 later."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("path"), (F.col("o_orderkey") + 32).cast("string").alias("output"))
    return D.own_outputs(rows).select("o_orderkey")


def subtitle_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(media, content): conversations as files of all formats, by their number."""
    rows = cue_seconds(spark, sf_dir)
    number = F.col("media").cast("long") % 3
    stamp = lambda c: F.format_string("%d:%02d:%02d.%02d", F.floor(F.col(c) / 3600), F.floor(F.col(c) / 60) % 60, F.floor(F.col(c)) % 60, F.round(F.col(c) * 100).cast("long") % 100)
    event = F.concat(F.lit("Dialogue: 0,"), stamp("start"), F.lit(","), stamp("end"), F.lit(",,"), "text", F.lit("\n"))
    frame = F.format_string("{%d}{%d}%s\n", F.round(F.col("start") * 10).cast("long"), F.round(F.col("end") * 10).cast("long"), "text")
    rest = K._joined(rows.where(number > 0).withColumn("_x", F.when(number == 1, event).otherwise(frame)), "_x", "")
    head = F.when(number == 1, "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n").otherwise("")
    return K.subtitles(rows.where(number == 0)).union(rest.withColumn("content", F.concat(head, "content")))


@query(f"WITH {CUES} SELECT DISTINCT media::VARCHAR AS media, CASE media % 3 WHEN 0 THEN 'srt' WHEN 1 THEN 'ass' ELSE 'microdvd' END AS format FROM c WHERE text <> ''")
def fn_subtitle_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtitle_files(spark, sf_dir).select("media", Q.subtitle_format(F.col("content")).alias("format"))


@query(f"WITH {CUES}, k AS (SELECT media, a, b, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM c WHERE text <> '') SELECT media::VARCHAR AS media, row_number() OVER (PARTITION BY media ORDER BY a, b)::INT AS cue, a / 10.0::DOUBLE AS start, b / 10.0::DOUBLE AS \"end\" FROM k")
def src_subs_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as SRT, ASS and MicroDVD files and parsed again."""
    return Q.cues(subtitle_files(spark, sf_dir), fps=10.0).select("media", "cue", "start", "end")


@query("SELECT conv_id::VARCHAR AS media, count(*) AS n FROM conversations WHERE text <> '' AND turn % 2 = 0 GROUP BY 1")
def src_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other turn as a bracketed sound of its file."""
    rows = cue_rows(spark, sf_dir).where("text <> ''")
    flat = F.regexp_replace(F.regexp_replace("text", r"[\[\](){}<>]", ""), r"\s+", " ")
    rows = rows.select(F.col("media").cast("string").alias("media"), (F.col("start") / 10).alias("start"), (F.col("end") / 10).alias("end"), F.when(F.col("cue") % 2 == 0, F.concat(F.lit("["), flat, F.lit(" x]"))).otherwise("words").alias("text"))
    return Q.sounds(K.subtitles(rows)).groupBy("media").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT lower(p_brand) || ' ' || lower(p_type) AS term FROM part WHERE p_size % 3 <> 0")
def src_wordfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and types as a word file, with comments after and instead of terms."""
    term = F.concat(F.lower(F.regexp_replace("p_brand", "#", "~")), F.lit(" "), F.lower("p_type"))
    rows = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("# "), term)).otherwise(F.concat(term, F.lit(" # a comment"))).alias("value"))
    path = scratch(spark, "words")
    rows.write.text(path)
    return Q.word_list(spark, path).select(F.replace("term", F.lit("~"), F.lit("#")).alias("term")).distinct()


@query("SELECT l_orderkey::VARCHAR AS media, l_linenumber::DOUBLE AS start, max(l_partkey) AS written FROM lineitem GROUP BY 1, 2")
def src_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as cached spans, written twice: the last one stays."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("media"), F.col("l_linenumber").cast("double").alias("start"), (F.col("l_linenumber") + 1).cast("double").alias("end"), F.col("l_partkey").alias("written"))
    path = scratch(spark, "transcripts")
    rows.union(rows.withColumn("written", F.col("written") - 1)).write.json(path)
    return Q.transcripts(spark, path).select("media", "start", "written")


@query(f"WITH {EV} SELECT media::VARCHAR AS media, count(*) AS n, sum((b - a) / 1e6)::DOUBLE AS seconds FROM e WHERE b > a AND media % 2 = 0 GROUP BY media")
def src_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as regions of speech; those of odd users are of an older version."""
    rows = events(spark, sf_dir).groupBy("media").agg(F.collect_list(F.array((F.col("start") / 1e6), (F.col("end") / 1e6))).alias("regions"))
    path = scratch(spark, "speech")
    rows.select(F.col("media").cast("string").alias("media"), (1 - F.col("media") % 2).alias("version"), "regions").write.json(path)
    return Q.speech(spark, path).groupBy("media").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).alias("seconds"))


@query(f"WITH {EV} SELECT media::VARCHAR AS media, term AS word, count(*) AS n FROM e WHERE b > a GROUP BY ALL")
def src_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).groupBy(F.col("media").cast("string").alias("media")).agg(F.collect_list(F.struct((F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.col("term").alias("word"))).alias("words"))
    path = scratch(spark, "labelled")
    rows.write.json(path)
    return Q.labelled(spark, path).groupBy("media", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, text FROM documents")
def src_subs_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as UTF-16 with its mark or without, as UTF-8, or in one byte a character where they are long enough and have such
    letters only, decoded again without being told which. Bytes that are UTF-8 too can only be taken for it, and a text that
    begins with a mark of its own has the file's before it: no reader could tell these otherwise."""
    turn, latin = F.col("doc_id") % 4, (F.length("text") >= 200) & ~F.rlike("text", F.lit(r"[^\x00-\x7F\xA0-\xFF]"))
    latin &= ~F.is_valid_utf8(F.encode("text", "ISO-8859-1").cast("string"))
    data = F.when(turn == 0, F.encode("text", "UTF-16")).when((turn == 1) & (F.length("text") >= 20), F.encode("text", "UTF-16LE")).when((turn == 2) & latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    marked = F.regexp_replace("text", r"\A(?=\x{FEFF})", "\ufeff").alias("text")
    rows = lines(spark, sf_dir).select("doc_id", F.when(turn == 0, F.col("text")).otherwise(marked).alias("text"))
    return rows.select("doc_id", decode_text(data, F.lit(None).cast("string")).alias("text"))


# ---- matching and masking --------------------------------------------------------------------------------------------


@query(rf"""WITH {WORDS}, k AS (SELECT doc_id, pos, {NORM} AS token FROM t) SELECT doc_id, pos::INT AS pos FROM k WHERE regexp_matches(token, '^th[\p{{L}}\p{{N}}_'']*$') AND NOT regexp_matches(token, '^the[\p{{L}}\p{{N}}_'']*$')""")
def jn_allow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a wildcard lists, without those that the allow list spares."""
    found = M.find(lines(spark, sf_dir), "doc_id", M.WordList([M.Term("th*", "x")], allow=["the*"]))
    return found.select("doc_id", F.col("first").alias("pos"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'another word in the span' END ELSE 'no substitute' END AS reason, CASE WHEN (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%') AND o_orderkey % 7 <> 0 THEN 'mild ' || substr(o_orderpriority, 1, 1) END AS substitute FROM orders")
def jn_substitute(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.upper("o_orderpriority").alias("term"))
    named = rows.select(F.lower("term").alias("term")).distinct().where("term like '1%' or term like '2%'")
    known = named.select("term", F.concat(F.lit("mild "), F.substr("term", F.lit(1), F.lit(1))).alias("substitute"))
    return M.substitutes(rows, known, F.col("o_orderkey") % 7 == 0).select("o_orderkey", "reason", "substitute")


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '\"DARN!\"' WHEN 1 THEN 'Darn.' ELSE 'darn' END AS said FROM part")
def fn_fit_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = F.when(F.col("p_size") % 4 == 0, F.lit('"HECK!"')).when(F.col("p_size") % 4 == 1, "Heck.").otherwise("heck")
    return table(spark, sf_dir, "part").select("p_partkey", M.fit_case(heard, F.lit("darn")).alias("said"))


@query()
def fn_mask_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations' subtitle files with listed words masked by their first letter."""
    return W.mask_files(subtitle_files(spark, sf_dir), TERMS[:3], "first_letter")


@query()
def fn_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", W.visible(F.col("html")).alias("text"))


@query("SELECT p_partkey, regexp_matches(lower(p_type), '^[a-z0-9_'' ]*ed[a-z0-9_'' ]*$') AS fits FROM (SELECT p_partkey, split_part(p_type, ' ', 2) AS p_type FROM part)")
def fn_wildcard_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.lower(F.get(F.split("p_type", " "), F.lit(1)))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(M.part("*ed*").fits(word), F.lit(False)).alias("fits"))


@query()
def fn_oshash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of long and short contents."""
    content = F.encode(F.repeat("n_name", F.when(F.col("n_nationkey") % 2 == 0, 40000).otherwise(9)), "UTF-8")
    return table(spark, sf_dir, "nation").select("n_nationkey", G.fingerprint(content).alias("key"))


@query(f"WITH {EV}, w AS (SELECT *, lag(b) OVER (PARTITION BY media ORDER BY a, b, id) AS l, lag(term) OVER (PARTITION BY media ORDER BY a, b, id) AS t FROM e), g AS (SELECT *, sum((l IS NULL OR a - l >= {3600 * SECOND} OR t LIKE '%k')::INT) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS s FROM w) SELECT media, min(a) AS start, count(*) AS n FROM g GROUP BY media, s")
def m13_utterance_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences end after words that end in k, or with an hour's pause."""
    return L.sentences(events(spark, sf_dir).withColumnRenamed("term", "text"), ["media"], 3600 * SECOND, "id", r"k$").select("media", "start", "n")


@query()
def fn_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", X.normalize(F.col("o_orderpriority")).alias("token"))
    return rows.select("o_orderkey", F.array_join(X.forms(F.col("token")), "|").alias("forms"))


@query("SELECT p_partkey, substr(sha256(p_name || '|' || p_size), 1, 16) AS key FROM part")
def fn_config_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", X.short_hash(F.concat_ws("|", "p_name", "p_size"), 16).alias("key"))


# ---- sound and times -------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_quantity - 0.1 >= 0.1 THEN l_quantity - 0.1 ELSE 0 END::DOUBLE AS start, CASE WHEN l_linenumber = 1 THEN 60 WHEN 60 - (l_quantity + 5.1) >= 0.1 THEN l_quantity + 5.1 ELSE 60 END::DOUBLE AS \"end\" FROM lineitem")
def fn_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a minute with speech of five seconds, or none."""
    first = F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))
    low, high, _, _ = L.trim(F.lit(0.0), F.lit(60.0), first, first + 5)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", low.cast("double").alias("start"), high.cast("double").alias("end"))


@query("SELECT p_partkey, CASE WHEN p_size % 7 >= 3 AND p_size % 2 = 0 THEN '2' WHEN p_size % 7 >= 2 THEN '0,1' ELSE '0' END AS channels FROM part")
def fn_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    layout = F.when(F.col("p_size") % 2 == 0, "5.1(side)").otherwise("quad")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(G.channels(layout, F.col("p_size") % 7), ",").alias("channels"))


@query("SELECT p_partkey, p_size / 50.0::DOUBLE >= 0.8::DOUBLE - 0.1::DOUBLE AS ok FROM part")
def fn_likeness_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", G.likeness_ok(F.col("p_size") / 50, F.lit(0.8), 0.1).alias("ok"))


@query()
def fn_same_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the vectors of a label are like their neighbours, five vectors a label."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    pairs = L.evenly(rows.join(other, "vec_id"), ["label"], 5, "vec_id").select("label", F.col("embedding").alias("a"), "b")
    return G.same_dialogue(pairs, ["label"], 8, 16000)


@query()
def fn_refine_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of vectors as sound, a component each hundredth of a second, with edges moved to quiet places."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0.24).alias("start"), F.lit(0.4).alias("end"), F.lit(0.0).alias("origin"), F.col("embedding").alias("samples"))
    return G.refine_edges(rows, ["vec_id"], 200, F.lit(0.5), 0.01)


@query()
def fn_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of clicks and views around each purchase: words end a sentence with e, or before a pause of an hour."""
    rows = events(spark, sf_dir)
    words = rows.select("media", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"), F.col("term").alias("text"))
    found = rows.where("term = 'purchase'").select("id", "media", (F.col("start") / 1e6).alias("start"), (F.col("end") / 1e6).alias("end"))
    return L.utterances(found, words, ["media"], "id", 7200.0, 3600.0, 0.05, r"e$")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 25 / 23.976::DOUBLE ELSE 1.2 END AS ratio FROM part")
def fn_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 3
    return table(spark, sf_dir, "part").select("p_partkey", A.snap(F.when(n == 0, 1.0005).when(n == 1, 1.0421).otherwise(1.2)).alias("ratio"))


@query("WITH s AS (SELECT media, id, a, b, conf FROM (SELECT *, row_number() OVER (PARTITION BY media ORDER BY a, b, id) AS k FROM (SELECT event_id AS id, user_id AS media, epoch_us(ts) AS a, epoch_us(ts) + round(value * 60000000)::BIGINT AS b, value AS conf FROM events))) SELECT media, min(conf) AS confidence, count(*) AS n FROM s GROUP BY media")
def ag_run_min_conf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How sure each user's events are, as the least sure of them."""
    return events(spark, sf_dir).groupBy("media").agg(M.run_confidence("conf").alias("confidence"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EV} SELECT media, count(DISTINCT term) AS reasons FROM e GROUP BY media")
def ag_distinct_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.distinct_in_order(events(spark, sf_dir), ["media"], "term", "start", "reasons")
    return rows.select("media", F.size("reasons").cast("long").alias("reasons"))


@query(f"WITH {EV}, p AS (SELECT *, max(b) OVER (PARTITION BY media ORDER BY a, b, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM e), g AS (SELECT *, sum((r IS NULL OR a - r >= {600 * SECOND})::INT) OVER (PARTITION BY media ORDER BY a, b, id ROWS UNBOUNDED PRECEDING) AS i FROM p) SELECT media, min(a) AS start, array_to_string(list_sort(list_distinct(list(term))), ',') AS reasons FROM g GROUP BY media, i")
def set_union_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reasons of merged spans, each once, sorted."""
    reasons = F.array_join(F.array_sort(F.collect_set("term")), ",").alias("reasons")
    return S.merge_spans(events(spark, sf_dir), ["media"], 600 * SECOND, aggregates=[reasons]).select("media", "start", "reasons")


@query(f"""WITH {EV}, k AS (SELECT media, (a // 1000000) % 100000 AS x, (a // 1000000) % 100000 + 1 + (b - a) // 1000000 AS y FROM e) SELECT media::VARCHAR AS media, '{{"schema_version":1,"intervals":[' || string_agg('{{"start":' || x::DOUBLE || ',"end":' || y::DOUBLE || '}}', ',' ORDER BY x, y) || ']}}' AS json FROM k GROUP BY media""")
def snk_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of whole seconds of a day."""
    low = F.expr("start div 1000000") % 100000
    rows = events(spark, sf_dir).select(F.col("media").cast("string").alias("media"), low.cast("double").alias("start"), (low + 1 + F.expr("(end - start) div 1000000")).cast("double").alias("end"))
    return K.reports(rows)


@query()
def snk_subs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as subtitle files."""
    return K.subtitles(cue_seconds(spark, sf_dir))


@query()
def snk_subs_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with listed words taken out."""
    return W.mask_files(K.subtitles(cue_seconds(spark, sf_dir)), TERMS[:3], "remove")


def drifting(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items as anchors of their part, and runs heard for them: the part's clock is off by one of the fixed scales and
    an offset, each run is up to 0.8 s away from it by the item's tax and discount, some are heard badly, some not at all, and
    each has a better run minutes away."""
    scales = F.array(*(F.lit(float(r)) for r in A.RATIOS))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cue"), (F.col("l_orderkey") % 7200).cast("double").alias("start"), "l_tax", "l_discount", "l_quantity")
    clock = F.get(scales, (F.col("part") % len(A.RATIOS)).cast("int")) * F.col("start") + F.col("part") % 20 - 10
    heard = rows.where(F.col("l_quantity") > 4).select("part", "cue", (clock + 10 * (F.col("l_tax") - F.col("l_discount"))).alias("at"), F.lit(5).alias("n_words"), F.when(F.col("l_quantity") < 12, 60.0).otherwise(80 + F.col("l_tax") * 100).alias("score"), (1 - F.col("l_discount")).alias("fidelity"))
    decoys = rows.select("part", "cue", (F.col("start") + 600).alias("at"), F.lit(5).alias("n_words"), F.lit(99.0).alias("score"), F.lit(1.0).alias("fidelity"))
    asked = rows.select("part", "cue", "start", (F.col("start") + 3).alias("end"), F.lit(15.0).alias("radius"), F.lit(7800.0).alias("duration"), F.lit(1.0).alias("scale"))
    return asked, heard.union(decoys)


@query()
def an_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of drifting clocks, followed in order of time."""
    return A.track(*drifting(spark, sf_dir), "part")


@query()
def plan_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a candidate: its anchors followed, fitted and judged. Some clocks are lost, some runs are unlike, and some parts have no anchor."""
    asked, runs = drifting(spark, sf_dir)
    found = A.track(asked, runs, "part")
    return A.check(asked, found, ["part"], "cue", candidates=table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part")))
