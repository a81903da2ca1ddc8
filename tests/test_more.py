import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.functions import masking as W
from loomspan.operators import lines as L
from loomspan.operators import matching as M
from loomspan.operators import media as D
from loomspan.operators import signals as G
from loomspan.plans.scan import scan, scan_reports
from loomspan.streaming.gaps import append_missing, merge_stream


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize("mode, want", [("first_letter", "oh s*** <i>w***</i>t"), ("asterisks", "oh **** <i>****</i>t"), ("remove", "oh <i></i>t")])
def test_mask_text(spark, mode, want):
    text = "oh shit <i>what</i>t"
    spans = F.array(F.struct(F.lit(3).alias("first"), F.lit(7).alias("last")), F.struct(F.lit(8).alias("first"), F.lit(12).alias("last")))
    assert one(spark, W.mask_text(F.lit(text), spans, mode)) == (want,)
    assert one(spark, W.mask_words(F.lit("Hell is hello, HELL no"), ["hell", "hell no"])) == ("[...] is hello, [...]",)


def test_mask_lines(spark):
    lines = spark.createDataFrame([(1, "damn"), (2, "fine"), (3, None)], "id int, text string")
    spans = spark.createDataFrame([(1, 0, 4)], "id int, first int, last int")
    assert [tuple(r) for r in W.mask_lines(lines, spans, ["id"], "remove").collect()] == [(2, "fine")]


def test_signals(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=400)
    a = F.array(*(F.lit(float(v)) for v in x))
    b = F.array(*(F.lit(float(v)) for v in np.roll(x, 5)))
    same, silent = one(spark, G.likeness(a, b, F.lit(10)), G.likeness(a, F.array(F.lit(0.0), F.lit(0.0)), F.lit(10)))
    assert same.score > 0.9 and same.lag == 5 and tuple(silent) == (0.0, 0)
    loud = F.concat(F.array_repeat(F.lit(0.5), 20), F.array_repeat(F.lit(0.0001), 10), F.array_repeat(F.lit(0.5), 10))
    none = F.array().cast("array<double>")
    assert one(spark, G.quietest(loud, F.lit(20), 5), G.quietest(loud, F.lit(30), -5), G.quietest(none, F.lit(3), 5), G.quietest(loud, F.lit(26), 5)) == (5, -5, 0, 0)
    mask = one(spark, G.fade_mask(6, 2))[0]
    assert mask == pytest.approx([0.1464466, 0.8535534, 1, 1, 0.8535534, 0.1464466])
    assert one(spark, G.change(F.array(F.lit(1.0)), F.array(F.lit(3.0)), F.array(F.lit(0.5))))[0] == [1.0]
    data = bytes(range(256)) * 600
    words = np.frombuffer(data[:65536], "<u8").sum(dtype=np.uint64) + np.frombuffer(data[-65536:], "<u8").sum(dtype=np.uint64)
    got = spark.createDataFrame([(data,), (b"x",)], "c binary").select(G.fingerprint("c")).collect()
    assert [r[0] for r in got] == [f"{(len(data) + int(words)) % 2**64:016x}-{len(data)}", None]


def test_media(spark):
    probe = '{"format":{"duration":"N/A"},"streams":[{"index":0,"codec_type":"video","duration":"9.5","r_frame_rate":"24000/1001"},{"index":1,"codec_type":"audio","channels":6,"tags":{"LANGUAGE":"eng","title":"Commentary"},"disposition":{"default":1}},{"index":2,"codec_type":"audio","channels":2,"tags":{"language":"und"}},{"index":3,"codec_type":"audio","channels":2,"tags":{"language":"eng"}}]}'
    rows = D.probe(spark.createDataFrame([("a", probe), ("b", '{"streams":[]}'), ("c", "no json")], "media string, json string"))
    got = sorted(rows.collect(), key=lambda r: r["index"])
    assert len(got) == 4 and got[0].duration == 9.5 and got[0].fps == pytest.approx(23.976, abs=1e-3) and got[2].language is None
    assert [r["index"] for r in D.dialogue_stream(rows, "English").collect()] == [3]
    assert one(spark, D.language_of(F.lit("GER")), D.language_of(F.lit("xx"))) == ("de", None)
    put = lambda mode, path=None: tuple(one(spark, D.placement(F.lit(mode), F.lit(path).cast("string"), F.lit("/a/b.mkv")))[0])
    assert put("new") == ("/a/b.clean.mkv", None, None) and put("backup") == ("/a/b.mkv", "/a/b.original.mkv", None) and put("in_place", "x")[2]
    ins = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d")], "path string, output string")
    assert sorted(r.path for r in D.own_outputs(ins).collect()) == ["a", "d"]


def test_lines(spark):
    cues = spark.createDataFrame([("m", 1, 10.0, 12.0, "x" * 17, [(8, 12, "hell")])], "media string, cue int, start double, end double, text string, words array<struct<first:int,last:int,term:string>>")
    r = L.estimates(cues, 0.3).first()
    assert (r.start, r.end, r.confidence) == (pytest.approx(10 + 16 / 17 - 0.3), pytest.approx(10 + 24 / 17 + 0.3), 0.2)
    gap = lambda *a: tuple(round(x, 4) for x in one(spark, *(c.alias(str(i)) for i, c in enumerate(L.fill_gap(*(F.lit(float(x)) for x in a), 2, 4)))))
    assert gap(13.7, 16.8, 10, 20) == (11.7, 18.8) and gap(19.9, 20, 10, 20) == (16, 20) and gap(10, 10.2, 10, 12) == (10, 12)
    low, high = L.grow(F.lit(-1.0), F.lit(0.5), 4, F.lit(100.0))
    assert one(spark, low, high) == (0, 4)
    words = spark.createDataFrame([("m", i, s, s + 0.2) for i, s in enumerate([10.1, 12.0, 19.8])], "media string, id int, start double, end double").withColumns({"ws": F.lit(10.0), "we": F.lit(20.0)})
    assert [r.id for r in L.inner_words(words, "ws", "we", 0.3, F.lit(False), F.lit(False)).collect()] == [1]
    assert L.inner_words(words, "ws", "we", 0.3, F.lit(True), F.lit(True)).count() == 3
    pieces = spark.createDataFrame([("m", 10.0, 30.0), ("m", 28.0, 50.0)], "media string, start double, end double")
    assert sorted((r.start, r.keep_from, r.keep_to) for r in L.middles(pieces, ["media"]).collect()) == [(10.0, None, 29.0), (28.0, 29.0, None)]


def test_cache(spark):
    spans = spark.createDataFrame([("m", 8.0, 14.0), ("m", 16.5, 21.0)], "media string, start double, end double")
    ask = spark.createDataFrame([("m", 1, 10.0, 20.0)], "media string, id int, start double, end double")
    pieces, gaps = L.cached(ask, spans, ["media"], "id", 5)
    assert sorted((r.start, r.end) for r in pieces.collect()) == [(10, 14), (16.5, 20)]
    assert [(r.start, r.end) for r in gaps.collect()] == [(14, 16.5)]


def test_scan(spark):
    said = [("m", i, w, i * 1.0, i + 0.4, 0.9) for i, w in enumerate("oh Hell no you pack of old liars !".split())]
    words = spark.createDataFrame(said + [("n", 0, "fine", 0.0, 1.0, 1.0)], "media string, pos int, text string, start double, end double, probability double")
    terms = (M.Term("hell", "mild"), M.Term("pack of old liars", "strong"))
    heard, spans = scan(words, terms)
    assert sorted(r.heard for r in heard.collect()) == ["Hell", "pack of old liars"]
    assert sorted((round(r.start, 2), round(r.end, 2)) for r in spans.collect()) == [(0.88, 1.6), (3.88, 7.6)]
    assert [r.media for r in scan_reports(words, terms).collect()] == ["m"]


def test_streams(spark, tmp_path):
    rows = [("m", 100.0, 105.0), ("m", 105.5, 108.0), ("m", 120.0, 121.0), ("m", 4000.0, 4001.0)]
    df = spark.createDataFrame(rows, "media string, start double, end double").withColumn("at", F.timestamp_seconds("start"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = merge_stream(stream, 1.0).writeStream.format("memory").queryName("merged").option("checkpointLocation", f"{tmp_path}/c1").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.start, r.end, r.n) for r in spark.table("merged").collect())
    assert got[:2] == [(100.0, 108.0, 2), (120.0, 121.0, 1)]
    for part in ("x", "y"):
        append_missing(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", "start", f"{tmp_path}/c{part}").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


def test_masked_categories_and_flags(spark):
    terms = (M.Term("damn", "mild"), M.Term("*fuck*", "strong"), M.Term("hell", "mild"))
    words = spark.createDataFrame([("d**n",), ("f***ing",), ("h***",), ("***",), ("hello",), ("z**",)], "token string")
    got = {r.token: r.category for r in M.masked_categories(words, terms).collect()}
    assert got == {"d**n": "mild", "f***ing": "strong", "h***": "mild", "***": "masked", "z**": "masked"}
    lines = spark.createDataFrame([(1, "what the hell"), (2, "oh f***"), (3, "freaking hell"), (4, "fine")], "id int, text string")
    flags = {r.id: r.reasons for r in M.flag_cues(lines, "id", terms, ["freak*"]).collect()}
    assert flags == {1: ["lexicon"], 2: ["masked"], 3: ["hint", "lexicon"]}
    swaps = spark.createDataFrame([("hell", "heck")], "term string, substitute string")
    found = spark.createDataFrame([("Hell", False), ("hell", True), ("damn", False)], "term string, crowded boolean")
    got = sorted((r.term, r.substitute, r.reason) for r in M.substitutes(found, swaps, F.col("crowded")).collect())
    assert got == [("Hell", "heck", None), ("damn", None, "no substitute"), ("hell", None, "another word in the span")]


def test_anchor_search(spark):
    from loomspan.operators import sync as A

    said = "one two three four five six seven".split()
    words = spark.createDataFrame([("m", i, 10.0 + i, w) for i, w in enumerate(said)], "media string, pos int, start double, token string")
    asked = spark.createDataFrame([("m", 1, "three four five", 0.0, 40.0, 3)], "media string, cue int, text string, low double, high double, n_words int")
    best = A.best_window(asked, words, ["media"], "cue").first()
    assert (best.score, best.heard_at) == (100.0, 12.0)
