"""Boundary cases of the operators as small literal tables."""

import pytest
from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import context as C
from loomspan.operators import matching as M
from loomspan.operators import spans as S
from loomspan.operators import sync as A
from loomspan.sources import sinks as K
from loomspan.sources import subtitles as Q


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def spans(spark, *rows):
    return spark.createDataFrame([("m", i, float(a), float(b)) for i, (a, b) in enumerate(rows)], "media string, id long, start double, end double")


def pairs(df):
    return sorted((round(r.start, 6), round(r.end, 6)) for r in df.collect())


@pytest.mark.parametrize(
    "span, before, after, least, limit, want",
    [((10.0, 10.5), 0.1, 0.1, 0.05, 100, (9.9, 10.6)), ((10.0, 10.02), 0, 0, 0.3, 100, (9.86, 10.16)), ((0.0, 0.01), 0, 0, 0.3, 10, (0, 0.3)), ((9.99, 10.0), 0, 0, 0.3, 10, (9.7, 10)), ((2.0, 1.9), 0, 0, 0.3, 10, (1.85, 2.15))],
)
def test_pad_interval(spark, span, before, after, least, limit, want):
    low, high = S.pad_interval(F.lit(span[0]), F.lit(span[1]), before, after, least, F.lit(float(limit)))
    got = one(spark, low.alias("a"), high.alias("b"))
    assert got == pytest.approx(want)


def test_merge_boundaries(spark):
    near = spans(spark, (1.0, 1.5), (1.8, 2.0))
    assert pairs(S.merge_spans(near, ["media"], 0.31)) == [(1.0, 2.0)]
    assert len(pairs(S.merge_spans(near, ["media"], 0.29))) == 2
    windows = spans(spark, (10, 15), (16, 20))
    assert len(pairs(S.merge_spans(windows, ["media"], 1))) == 2
    assert pairs(S.merge_spans(windows, ["media"], 1, closed=True)) == [(10, 20)]
    nested = spans(spark, (0, 10), (1, 2), (5, 6))
    assert len(pairs(S.merge_spans(nested, ["media"], 0, reach="last"))) == 2
    assert pairs(S.merge_spans(nested, ["media"], 0, bucket=1)) == [(0, 10)]
    assert S.merge_spans(nested.limit(0), ["media"], 1).count() == 0


def test_split(spark):
    got = pairs(S.split_spans(spans(spark, (10, 70)), 30, 2))
    assert [round(b - a, 3) for a, b in got] == [21.333] * 3 and got[0][1] - got[1][0] == pytest.approx(2)
    assert got[-1][1] == 70 and pairs(S.split_spans(spans(spark, (0, 30)), 30, 2)) == [(0, 30)]


def test_uncovered(spark):
    cover = spans(spark, (9.5, 12.5), (19.5, 25.5))
    got = S.difference(spans(spark, (5, 11), (12.2, 12.6), (15, 30), (40, 40.3)), cover, ["media"], "id", 0.5, 10)
    assert pairs(got) == [(5, 9.5), (15, 19.5), (25.5, 30)]


def test_nearest_next_and_overlap(spark):
    left = spans(spark, (10, 11), (50, 51))
    right = spark.createDataFrame([("m", 7, 10.4, 10.6), ("m", 8, 11.0, 12.0), ("m", 9, 11.4, 11.5)], "media string, r_id long, r_start double, r_end double")
    assert [r.id for r in S.overlap_filter(left, right, ["media"], 1, "id").collect()] == [0]
    assert {(r.id, r.r_id) for r in S.overlap_join(left, right, ["media"], 1, closed=True).collect()} == {(0, 7), (0, 8)}
    assert {(r.id, r.r_id) for r in S.overlap_join(left, right, ["media"], 1).collect()} == {(0, 7)}
    assert {r.id: r.r_id for r in S.nearest(left, right.select("media", "r_id", "r_start"), ["media"], "id", "end", "r_start", 1, "r_id").collect()} == {0: 8, 1: None}
    assert {r.id: r.next for r in S.next_start(left, right, ["media"], "start", "r_start", "next").collect()} == {0: 10.4, 1: None}


def test_dedupe(spark):
    rows = [("m", "hell", 1, 5.0, 5.3, 0.5), ("m", "hell", 2, 5.1, 5.35, 0.8), ("m", "shit", 3, 5.1, 5.3, 0.9)]
    df = spark.createDataFrame(rows, "media string, term string, id long, start double, end double, conf double")
    assert sorted((r.term, r.conf) for r in S.dedupe(df, ["media", "term"], "conf").collect()) == [("hell", 0.8), ("shit", 0.9)]


@pytest.mark.parametrize("raw, want", [("Rasssscal?!", "rascal"), ("daaamp", "damp"), ("1000", "1000"), ("fuckin'", "fuckin"), ("--", ""), ("straße", "strasse"), ("“Hell,”", "hell"), ("f***", "f***")])
def test_normalize(spark, raw, want):
    assert one(spark, X.normalize(F.lit(raw))) == (want,)


def test_compatibility_characters(spark):
    assert one(spark, X.normalize(F.lit("Ｈｅｌｌ"), compose=True)) == ("hell",)


@pytest.mark.parametrize("raw, want", [("d**n", True), ("***", True), ("#1", False), ("*", False), ("a", False), ("hello", False), ("h*", True)])
def test_masked(spark, raw, want):
    assert one(spark, X.is_masked(F.lit(raw))) == (want,)


TERMS = (M.Term("son of a gun", "strong"), M.Term("gun*", "strong"), M.Term("oh my [hat]", "religious"), M.Term("rascal*", "strong"), M.Term("*dung*", "strong"), M.Term("hell", "mild"), M.Term("hell", "other"), M.Term("[son] of a [gu]", "two"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("you son of a gun!", [(1, 5, "son of a gun", [0, 1, 2, 3])]),
        ("Oh my Hat", [(0, 3, "oh my [hat]", [2])]),
        ("rascalize the rascals", [(2, 3, "rascal*", [0])]),
        ("bulldung duunge", [(0, 1, "*dung*", [0])]),
        ("Hell", [(0, 1, "hell", [0])]),
        ("son of a gu", [(0, 4, "[son] of a [gu]", [0, 3])]),
        ("", []),
    ],
)
def test_match(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    got = M.match(df, "id", TERMS, allow=["rascaliz*"])
    assert sorted((r["first"], r["last"], r.term, r.targets) for r in got.collect()) == want


def test_detections(spark):
    df = spark.createDataFrame([(1, "son of a gu")], "id long, text string")
    words = spark.createDataFrame([(1, i, w, float(i), i + 0.9, p) for i, (w, p) in enumerate([("son", 0.9), ("of", 0.1), ("a", 0.1), ("gu", 0.4)])], "id long, pos int, raw string, start double, end double, probability double")
    got = M.detections(M.match(df, "id", TERMS), words, ["id"])
    assert sorted((r.heard, r.start, r.end, r.confidence) for r in got.collect()) == [("gu", 3.0, 3.9, 0.4), ("son", 0.0, 0.9, 0.9)]


def test_fit(spark):
    points = [(x, 25 / 23.976 * x - 2.5) for x in range(0, 1100, 100)]
    points[3] = (points[3][0], points[3][1] + 30)
    rows = [("a", float(x), float(y)) for x, y in points] + [("b", 0.0, 2.0), ("b", 500.0, 502.0), ("c", 0.0, 1.0), ("c", 10.0, 11.0), ("c", 20.0, 21.0)]
    got = {r.m: r for r in A.fit(spark.createDataFrame(rows, "m string, x double, y double"), ["m"], "x", "y").collect()}
    assert got["a"].scale == 25 / 23.976 and got["a"].offset == pytest.approx(-2.5) and got["a"].error < 0.05
    assert (got["b"].scale, got["b"].offset) == (1, 2) and (got["c"].scale, got["c"].offset) == (1, 1)


def test_verdict_order(spark):
    say = lambda **k: one(spark, C.verdict(*(F.lit(k.get(n, d)) for n, d in (("certain", False), ("ambiguous", True), ("line", True), ("shows", True), ("rude", 0.1), ("judged", True), ("answer", "harmless"), ("ok", True), ("trusted", True)))).alias("v"))[0].use
    assert say() == "harmless" and say(certain=True) == "profane" and say(ambiguous=False) == "profane"
    assert say(rude=0.5) == "profane" and say(rude=0.3) == "unsure" and say(ok=False) == "unsure" and say(trusted=False) == "unsure"
    assert say(judged=False) == "unsure" and say(answer="profane") == "profane" and say(answer="?") == "unsure"


SRT = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i> [door slams]\n- ANN: there\n\n2\n00:00:02,520 --> 00:00:03,000\nHello there\n\n3\n00:00:05,000 --> 00:00:04,000\nnever\n"


def test_subtitles(spark):
    files = spark.createDataFrame([("f", SRT), ("v", "WEBVTT\n\nNOTE x\ny\n\n00:01.000 --> 00:02.000\nHi\n")], "media string, content string")
    got = sorted(tuple(r) for r in Q.cues(files).collect())
    assert got == [("f", 1, 1.0, 3.0, "Hello there", False), ("v", 1, 1.0, 2.0, "Hi", False)]
    assert [(r.media, r.text) for r in Q.sounds(files).collect()] == [("f", "door slams")]
    out = K.subtitles(Q.cues(files).where("media = 'f'")).first().content
    assert out == "1\n00:00:01,000 --> 00:00:03,000\nHello there\n"
    assert K.edit_list(Q.cues(files).where("media = 'v'")).first().content == "1.000\t2.000\t1\n"


def test_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.srt").write_bytes("žluťoučký".encode("cp1250"))
    (tmp_path / "s/b.srt").write_bytes("héllo".encode("utf-16"))
    got = {r.media[-5:]: r.content for r in Q.read_files(spark, str(tmp_path / "s"), "cs").collect()}
    assert got == {"a.srt": "žluťoučký", "b.srt": "héllo"}
    (tmp_path / "w.txt").write_text("hell # mild\n# none\n\nson of a\n")
    assert [r.term for r in Q.word_list(spark, str(tmp_path / "w.txt")).collect()] == ["hell", "son of a"]
    (tmp_path / "t.json").write_text('{"media":"m","start":1.0,"end":2.0,"written":1,"clean_start":true}\nnot json\n{"media":"m","start":1.0001,"end":2.0,"written":2,"clean_start":false}\n')
    assert [(r.written, r.clean_start) for r in Q.transcripts(spark, str(tmp_path / "t.json")).collect()] == [(2, False)]
    reports = K.reports(spans(spark, (1, 2), (3, 4))).union(spark.createDataFrame([("x", "{")], "media string, json string"))
    assert pairs(Q.report_intervals(reports)) == [(1, 2), (3, 4)]


def test_functions(spark):
    got = one(spark, X.srt_time(F.lit(3723004)), X.rate(F.lit("24000/1001")), X.rate(F.lit("25")), X.fuzz_ratio(F.lit("kitten"), F.lit("sitting")), X.sorted_words(F.lit("b a")), X.parse_answer(F.lit('Well: {"use": "harmless"} {"use": "x"}'), "use", ["harmless"]), X.delivery(F.array(F.lit("whispering")), F.lit("x")), X.intensity(F.lit(None).cast("string"), F.lit("Oh!")))
    assert got == ("01:02:03,004", pytest.approx(24000 / 1001), 25.0, pytest.approx(200 * 4 / 13), "a b", "harmless", "whispered", "medium")
