import json

from loomspan.sources import sinks as K
from loomspan.sources import subtitles as Q


def test_times_of_ten_million_seconds_have_no_exponent(spark):
    spans = spark.createDataFrame([("a", 12345678.5, 12345679.0), ("a", 0.25, 1e7)], "media string, start double, end double")
    want = '"intervals":[{"start":0.25,"end":10000000.0},{"start":12345678.5,"end":12345679.0}]'
    assert K.reports(spans).first().json == '{"schema_version":1,' + want + "}"
    files = spark.createDataFrame([("a", '/v/"a"\n', 5, None, 12345678.25, 1, "aac", 2, None)], "media string, path string, size long, oshash string, duration double, index int, codec string, channels int, language string")
    found = spark.createDataFrame([("a", 12345678.5, 12345679.0, 'so "x"', "x", None, 0.0005)], "media string, start double, end double, text string, term string, category string, confidence double")
    full = K.full_reports(files, spans, found)
    text = full.first().json
    assert text.endswith(want + "}") and '"duration":12345678.25}' in text and '"confidence":0.0005}' in text
    assert json.loads(text)["detections"] == [{"start": 12345678.5, "end": 12345679.0, "text": 'so "x"', "term": "x", "confidence": 0.0005}]
    assert json.loads(text)["input"] == {"path": '/v/"a"\n', "size": 5, "duration": 12345678.25} and json.loads(text)["settings"] == {}
    assert Q.read_reports(full).first().n_intervals == 2
    bare = json.loads(K.full_reports(files, spans.limit(0), found.limit(0), {"mode": "mute"}).first().json)
    assert bare["detections"] == bare["intervals"] == [] and bare["settings"] == {"mode": "mute"}
