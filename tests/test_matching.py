"""The whole matcher, file masking, cleaning, names and the guided plan, against plain Python or literal cases."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions import masking as W
from loomspan.functions import text as X
from loomspan.operators import context as C
from loomspan.operators import guided as N
from loomspan.operators import lines as L
from loomspan.operators import matching as M
from loomspan.operators import media as D
from loomspan.operators import signals as G
from loomspan.sources import subtitles as Q

LIST = [("darn*", "mild"), ("*heck*", "strong"), ("mother-lode", "strong"), ("oh my [hat]", "holy"), ("re:^z+q$", "odd"), ("of a", "phrase"), ("a b c", "phrase"), ("b", "one"), ("off", "gone")]


def token(raw):
    text = unicodedata.normalize("NFKC", raw).translate(str.maketrans(X.QUOTES, X.STRAIGHT)).casefold().strip().strip(X.EDGE).strip()
    return re.sub(r"([^\W\d_])\1{2,}", r"\1", text)


def plain_match(text, terms, allow, disabled):
    words = [token(w) for w in re.split(r"\s+", re.sub(r"-{2,}|\.{3,}|[–—…]", " ", text)) if w]
    forms = [{f for f in (w, w.replace("-", "")) if f} for w in words]

    def rule(word):
        text = token("x" + word.strip("[]") + "x")[1:-1]
        spellings = {text, text.replace("-", "")} if text.replace("-", "").replace("*", "") else {text}
        return re.compile("|".join(r"[\w']*".join(map(re.escape, s.split("*"))) for s in spellings)).fullmatch

    compiled = []
    for t, c in terms:
        if c in disabled:
            continue
        rules = [re.compile(t[3:], re.I).search] if t.startswith("re:") else [rule(w) for w in t.split()]
        marked = [i for i, w in enumerate(t.split()) if w[0] == "["] or list(range(len(rules)))
        compiled.append((t, c, rules, marked))
    spared = [rule(a) for a in allow]
    found = [
        (-len(rules), n, p, t, c, marked)
        for n, (t, c, rules, marked) in enumerate(compiled)
        for p in range(len(words) - len(rules) + 1)
        if all(any(r(f) for f in forms[p + k]) for k, r in enumerate(rules)) and not (len(rules) == 1 and any(s(f) for s in spared for f in forms[p]))
    ]
    taken, out = set(), []
    for size, _, p, t, c, marked in sorted(found):
        if taken.isdisjoint(range(p, p - size)):
            taken |= set(range(p, p - size))
            out.append((p, p - size, t, c, marked))
    endings = ("", "s", "es", "ed", "er", "ers", "ing", "in", "y", "ty", "head", "hole")
    cores = {}
    for t, c in terms:
        parts = [] if t.startswith("re:") else t.split()
        for w in [w for w in parts if w[0] == "["] or parts:
            cores.setdefault(c, []).append(w.strip("[]").replace("*", ""))
    for p, w in enumerate(words):
        if p in taken or len(w) < 2 or not re.search("[*#]", w) or not (any(x.isalpha() for x in w) or len(w) >= 3):
            continue
        category = None
        if any(x.isalpha() for x in w):
            for mask in (lambda m: rf"[\w']{{{len(m[0])}}}", lambda m: r"[\w']+"):
                shape = re.compile(re.sub(r"[^\w']+", mask, w))
                category = category or next((c for c, xs in cores.items() if any(shape.fullmatch(x + e) for x in xs for e in endings)), None)
        if category not in disabled:
            out.append((p, p + 1, w if category is None else f"masked:{w}", category or "masked", [0]))
    return sorted(out)


def test_whole_matcher_against_plain_python(spark):
    rng = random.Random(7)
    pool = "darn darned DARN! daaarn d**n d### heck hecking h**k what-the-heck mother-lode motherlode mother-l*de oh my hat Hat, zzq Zq of a b c off o** *** #1 ‘hat’ ｄａｒｎ the…end x--y darning ok".split()
    lines = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(0, 14)))) for i in range(250)] + [(900, ""), (902, "oh my hat, OH MY Hat!"), (901, "b " * 3000 + "a b c " * 500)]
    terms = [M.Term(t, c) for t, c in LIST]
    got = M.match(spark.createDataFrame(lines, "id int, text string"), "id", terms, allow=["darning", "heck"], disabled=["gone"])
    rows = sorted((r["id"], r["first"], r["last"], r["term"], r["category"], list(r["targets"])) for r in got.collect())
    want = sorted((i, *m) for i, t in lines for m in plain_match(t, LIST, ["darning", "heck"], ["gone"]))
    assert [r for r in rows if r not in want] == [r for r in want if r not in rows] == []
    assert rows == want
    assert {r[4] for r in rows} >= {"mild", "strong", "holy", "odd", "phrase", "one", "masked"}


def test_words_that_are_no_terms():
    for bad in ("", " ", "*", "[*]"):
        with pytest.raises(ValueError):
            M.parts(M.Term(bad, "x"))


@pytest.mark.parametrize(
    "raw, want, sung",
    [
        ("a(b)c [x\ny] d", "a c d", False), ("JOHN: well", "well", False), ("Look: here", "Look: here", False), ("- MAN 2: - yes", "- yes", False), ("♪ la la ♫", "la la", True), ("# la la #", "la la", True), ("#5 is # here", "#5 is # here", False),
        ("<i>Hi</i> {\\an8}there <00:01.000>now", "Hi there now", False), ("ONE TWO THREE FOUR FIVE: no", "ONE TWO THREE FOUR FIVE: no", False), ("WHAT?: no", "WHAT?: no", False), ("12: no", "12: no", False), ("x < y", "x < y", False), ("", "", False),
    ],
)
def test_clean_text(spark, raw, want, sung):
    assert tuple(spark.range(1).select(X.clean_text(F.lit(raw)), X.is_sung(F.lit(raw))).first()) == (want, sung)


def test_delivery_and_sounds(spark):
    rows = [(["he screeches"], "x", "shouted"), (["tearing paper"], "x", None), (["under her breath"], "x", "whispered"), (["sobs"], "x", "tearful"), (["weeps"], "x", "tearful"), ([], "STOP THAT!", "shouted"), ([], "OK", None), (["crystal"], "Oh", None)]
    df = spark.createDataFrame([(i, s, t) for i, (s, t, _) in enumerate(rows)], "i int, s array<string>, t string")
    assert [r.d for r in df.select("i", X.delivery(F.col("s"), F.col("t")).alias("d")).orderBy("i").collect()] == [r[2] for r in rows]
    assert spark.range(1).select(X.sexual_sounds(F.array(*map(F.lit, ("door", "soft moaning", "essex", "having sex"))))).first()[0] == ["soft moaning", "having sex"]


SRT = "1\r\n00:00:01,000 --> 00:00:02,000\r\nWhat the <i>heck</i>?\r\nfine\r\n\r\n2\r\n00:00:03,000 --> 00:00:04,000\r\nheck\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nheck you"
ASS = "[Script Info]\nTitle: heck\n\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.50,{\\i1}oh\\Nheck{\\i0}, no\nComment: 0,0:00:01.00,0:00:02.00,heck\n"


def test_mask_files(spark):
    files = spark.createDataFrame([("s", SRT), ("a", ASS), ("x", "no subtitles, heck")], "media string, content string")
    terms = [M.Term("heck", "x")]
    star = {r.media: (r.content, r.masked) for r in W.mask_files(files, terms, "first_letter").collect()}
    assert star == {"s": (SRT.replace("heck", "h***"), 3), "a": (ASS.replace("Nheck{", "Nh***{"), 1)}
    gone = {r.media: r.content for r in W.mask_files(files, terms, "remove").collect()}
    assert gone["a"] == ASS.replace("Nheck{", "N{")
    assert gone["s"] == "1\r\n00:00:01,000 --> 00:00:02,000\r\nWhat the<i></i>?\r\nfine\r\n\r\n3\r\n00:00:05,000 --> 00:00:06,000\r\nyou"
    got = sorted((r.media, r.start, r.end, r.text) for r in Q.cues(files).collect())
    assert got[0] == ("a", 1.0, 2.5, "oh heck, no") and [g[3] for g in got[1:]] == ["What the heck? fine", "heck", "heck you"]
    frames = spark.createDataFrame([("m", "{10}{20}{y:i}one|two\n{30}{30}never\n")], "media string, content string")
    assert [(r.start, r.end, r.text) for r in Q.cues(frames, fps=10.0).collect()] == [(1.0, 2.0, "one two")]


def test_sidecars_and_names(spark):
    videos = ["/v/a/Film.mkv", "/v/a/Film.2.mkv", "/v/b/Only.mkv"]
    files = ["/v/a/Film.en.srt", "/v/a/Film.2.hi.srt", "/v/a/Filmy.srt", "/v/a/Subs/film/2_French.ass", "/v/a/Subs/English.srt", "/v/b/subs/English.forced.vtt", "/v/b/Only.review.srt", "/v/b/Only.en.hi.srt", "/v/b/note.txt"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "path string")
    got = sorted((r.media, r.path, r.language, r.hearing, r.forced, r.bonus) for r in D.sidecars(frame(files), frame(videos)).collect())
    assert got == sorted([
        ("/v/a/Film.mkv", "/v/a/Film.en.srt", "en", False, False, 5.0), ("/v/a/Film.mkv", "/v/a/Film.2.hi.srt", "hi", False, False, 5.0), ("/v/a/Film.2.mkv", "/v/a/Film.2.hi.srt", "hi", False, False, 5.0),
        ("/v/a/Film.mkv", "/v/a/Subs/film/2_French.ass", "fr", False, False, 0.0), ("/v/b/Only.mkv", "/v/b/subs/English.forced.vtt", "en", False, True, 0.0), ("/v/b/Only.mkv", "/v/b/Only.en.hi.srt", "en", True, False, 5.0),
    ])
    same = spark.range(1).select(D.same_language(F.lit("eng"), F.lit("en-US")), D.same_language(F.lit("ger"), F.lit("deu")), D.same_language(F.lit(None).cast("string"), F.lit("en"))).first()
    assert tuple(same) == (True, True, False)


def test_guided_plan(spark):
    o = N.GuidedOptions()
    flags = spark.createDataFrame([("m", 1, 10.0, 11.0, ["lexicon"]), ("m", 2, 18.0, 19.0, ["hint"]), ("m", 3, 100.0, 170.0, ["masked"]), ("m", 4, 500.0, 501.0, ["lexicon"])], "media string, cue int, start double, end double, reasons array<string>")
    speech = spark.createDataFrame([("m", 1, 60.0, 62.0), ("m", 2, 10.0, 11.5)], "media string, id long, start double, end double")
    media = spark.createDataFrame([("m", 300.0, 0.0), ("n", 100.0, None)], "media string, duration double, error double")
    windows, films = N.guided(flags, speech, flags, media, "media", o)
    got = sorted((r.start, round(r.end, 3), r.reasons, r.cues) for r in windows.collect())
    assert got[0] == (7.5, 21.5, ["hint", "lexicon"], [1, 2]) and got[1] == (58.0, 64.0, ["uncovered"], [])
    assert [g[2:] for g in got[2:]] == [(["masked"], [3])] * 3 and got[2][0] == 98 and got[-1][1] == 172 and len(got) == 5
    state = {r.media: r for r in films.collect()}
    assert state["n"].fallback == "no subtitles" and state["m"].fallback is None and state["m"].windows == 5
    heard = spark.createDataFrame([("m", 10.5, 10.6)], "media string, start double, end double")
    row = N.confirmation(N.confirmed(flags, heard, ["media"], "cue", 60), ["media"]).first()
    assert (row.strong, row.confirmed, row.doubtful) == (3, 1, True)


def test_context_decisions(spark):
    shown = C.hide(F.lit("Heck no, what-the heck, hecks"), F.array(F.lit("heck"), F.lit("heck no")))
    assert spark.range(1).select(shown).first()[0] == "[...], what-the [...], hecks"
    lines = spark.createDataFrame([("m", 1, "heck no"), ("m", 2, "fine"), ("m", 3, "")], "media string, line int, text string")
    heard = spark.createDataFrame([("m", 1, " heck,")], "media string, line int, word string")
    scores = spark.createDataFrame([("[...] no", 0.2), ("heck no", 0.9), ("fine", 0.1), ("", 0.7)], "text string, rude double")
    got = {r.line: r.rude for r in C.scored_lines(lines, heard, scores, ["media", "line"], ("rude",)).collect()}
    assert got == {1: 0.2, 2: 0.1, 3: 0.0}
    asked = spark.range(1).select(C.question("sense", C.dialogue(F.lit(""), F.lit('say "heck"'), F.lit("after")), F.lit("heck")).alias("q"), C.question("sexual", C.dialogue(F.lit(None).cast("string"), F.lit("x"), F.lit("")), F.lit("x")).alias("r")).first()
    assert asked.q.startswith('Dialogue:\n>> "say \\"heck\\""\n   "after"\n\nHow is the word "heck"') and '"harmless"' in asked.q and asked.r.startswith('Dialogue:\n>> "x"\n\nIs the line')


def test_utterances_and_edges(spark):
    words = [("m", t, t + 0.4, w) for t, w in [(0.0, "Well."), (1.0, "what"), (1.5, "the"), (2.0, "heck?"), (2.6, "Go"), (4.5, "on")]]
    found = spark.createDataFrame([("m", 1, 2.0, 2.4), ("m", 2, 9.0, 9.5)], "media string, id long, start double, end double")
    rows = L.utterances(found, spark.createDataFrame(words, "media string, start double, end double, text string"), ["media"], "id").collect()
    assert [(r.id, r.start, r.end, r.original, r.before, r.heard, r.after) for r in rows] == [(1, 1.0, 2.4, "what the heck?", "what the", "heck?", "")]
    loud, quiet = [0.5], [0.0]
    samples = loud * 40 + quiet * 10 + loud * 50 + quiet * 20 + loud * 80
    spans = spark.createDataFrame([("m", 0.6, 0.9, 0.0, samples)], "media string, start double, end double, origin double, samples array<double>")
    row = G.refine_edges(spans, ["media"], 100, F.lit(2.0), 0.25, 0.05).first()
    assert (round(row.start, 3), round(row.end, 3)) == (0.45, 1.05)


def test_masking_is_linear_in_a_line_and_stays_as_defined():
    """Masking the first letters of one long word, by rows: it took a copy of the word's beginning for each letter."""
    from time import perf_counter

    from loomspan.functions.masking import _censored, _masked

    long = "a" * 200_000
    begun = perf_counter()
    assert _masked(f"x {long}", [(2, len(long) + 2)], "first_letter") == "x a" + "*" * (len(long) - 1)
    assert perf_counter() - begun < 5
    assert _censored("<i>Oh, \"darn\"</i>\\Nit  darn", [(1, 1), (3, 3)], "remove") == ("<i>Oh, \"\"</i>\\Nit ", 2)


def test_runs_and_rare_values_without_moving_rows(spark):
    """Runs within a row, and values of two rows at most, need no window and no join; null ids and null lists count as they did."""
    from loomspan.operators import ranking as R
    from loomspan.operators import spans as S

    rows = [(1, [True, True, False, None, True]), (2, None), (None, [False]), (3, []), (4, [True])]
    got = spark.createDataFrame(rows, "id int, h array<boolean>").select("id", S.runs_within(F.col("h")).alias("r"))
    assert {r.id: [tuple(x) for x in r.r or []] for r in got.collect()} == {1: [(0, 2, 2), (4, 5, 1)], 2: [], None: [], 3: [], 4: [(0, 1, 1)]}
    texts = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (None, ["a", "b", "d"]), (3, [])], "id int, v array<string>")
    rare = R.rare_values(texts, "id", F.col("v"), F.size("v") > 0)
    assert {r.id: r.rare for r in rare.collect()} == {1: 1, 2: 1, None: 2}
    assert "Join" not in rare._jdf.queryExecution().executedPlan().toString()


def test_flags_take_one_walk_and_slices_change_nothing(spark, monkeypatch):
    walks, plain = [], M.find
    monkeypatch.setattr(M, "find", lambda *a, **k: walks.append(1) or plain(*a, **k))
    lines = spark.createDataFrame([(1, "Oh--hell, what the h*ll...hell"), (2, "a freaky  day"), (3, None), (4, "nothing")], "id int, text string")
    got = {r.id: (list(r.reasons), [tuple(w) for w in r.words]) for r in M.flag_cues(lines, "id", [M.Term("hell", "mild")], ["freak*"]).collect()}
    assert got == {1: (["lexicon", "masked"], [(4, 9, "hell"), (19, 23, "masked:h*ll"), (26, 30, "hell")]), 2: (["hint"], [])}
    assert len(walks) == 1
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4], "w": [["a"] * 40, None, ["b"] * (2 * M.SLICE), ["c"]]})
    assert [s.column(0).to_pylist() for s in M._slices(batch)] == [[1, 2], [3], [4]]


def test_probe_reads_json_once(spark):
    """Filters on what a probe holds stand behind its parsing, which would be repeated for each of them."""
    good = '{"format": {"duration": "x"}, "streams": [{"index": 0, "duration": "2.5", "tags": {"LANGUAGE": "ger"}}, {"index": 1, "duration": "4"}]}'
    rows = spark.createDataFrame([("a", good), ("b", "no"), ("c", '{"streams": []}'), ("d", None), ("e", '{"streams": [{"index": 3}]}')], "media string, json string")
    got = D.probe(rows)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert sorted((r.media, r["index"], r.duration, r.language) for r in got.collect()) == [("a", 0, 4.0, "ger"), ("a", 1, 4.0, None)]
