from loomspan.operators.media import sidecars

VIDEOS = ["/a/Film.mkv", "/b/One.mkv", "/b/Two.mkv", "/c/Film.x.mkv", "/d/İx.mkv"]
FILES = {
    "/a/Film.en.srt": ["/a/Film.mkv"],
    "/a/Subs/Film.en.srt": ["/a/Film.mkv"],  # by its name, and not again as the only video's
    "/a/Subs/FILM_de.srt": ["/a/Film.mkv"],
    "/a/Subs/Filmed.srt": ["/a/Film.mkv"],  # the only video
    "/a/Subs/Film/2_English.srt": ["/a/Film.mkv"],
    "/b/subs/x.srt": [],
    "/b/subs/one.fr.srt": ["/b/One.mkv"],
    "/c/subtitles/film.x-en.ass": ["/c/Film.x.mkv"],
    "/c/subtitles/.srt": [],
    "/d/Subs/İx.en.srt": ["/d/İx.mkv"],
    "/d/Subs/en.srt": ["/d/İx.mkv"],
    "/e/Subs/en.srt": [],
}


def test_files_are_joined_with_videos_once(spark, tmp_path):
    for name, paths in (("files", list(FILES)), ("videos", VIDEOS)):
        spark.createDataFrame([(p,) for p in paths], "path string").write.parquet(str(tmp_path / name))
    out = sidecars(spark.read.parquet(str(tmp_path / "files")), spark.read.parquet(str(tmp_path / "videos")))
    assert sorted((r.path, r.media) for r in out.collect()) == sorted((p, m) for p, media in FILES.items() for m in media)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 2
