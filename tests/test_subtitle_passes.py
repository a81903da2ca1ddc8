from loomspan.sources.subtitles import blocks, cues

FILES = [
    ("a", "1\n00:00:01,000 --> 00:00:02,500\none\n\n2\n00:00:03,000 --> 00:00:03,000\nno length\n"),
    ("b", "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.00,two, with\\Ncomma\nDialogue: 0,0:00:01.00,0:00:02.00,{\\p1}m 0 0\nDialogue: 0,0:00\n"),
    ("c", "{10}{25}three|lines\nrest\n{30}{40}{y:i}four\n"),
    ("d", "WEBVTT\n\nNOTE x\n\n00:01.000 --> 00:02.000\nfive\n"),
    ("e", "nothing"),
    ("f", None),
]


def test_files_of_all_formats_are_read_once(spark, tmp_path):
    spark.createDataFrame(FILES, "media string, content string").write.parquet(str(tmp_path / "files"))
    files = spark.read.parquet(str(tmp_path / "files"))
    for fps, media in ((10.0, "abcd"), (None, "abd")):
        made = blocks(files, fps)
        got = sorted((r.media, r.start, r.end, r.text) for r in made.collect())
        want = [("a", 1.0, 2.5, "one"), ("b", 1.0, 2.0, "two, with\ncomma"), ("c", 1.0, 2.5, "three\nlines"), ("c", 3.0, 4.0, "four"), ("d", 1.0, 2.0, "five\n")]
        assert [(m, a, b, t.strip()) for m, a, b, t in got] == [(m, a, b, t.strip()) for m, a, b, t in want if m in media]
        assert made._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert cues(files, 10.0).count() == 5 and blocks(files.limit(0), 10.0).count() == 0
