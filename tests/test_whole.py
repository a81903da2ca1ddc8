"""Registered queries that take their whole tables, against plain Python."""

import re
from collections import defaultdict

import pytest

from loomspan.functions.text import EDGE, QUOTES, STRAIGHT
from loomspan.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def split(text):
    return [w for w in re.split(r"\s+", re.sub(r"-{2,}|\.{3,}|[–—…]", " ", text or "")) if w]


def normal(raw):
    token = raw.translate(str.maketrans(QUOTES, STRAIGHT)).lower().replace("ß", "ss").strip(" ")
    return re.sub(r"([^\W_])\1{2,}", lambda m: m[0] if m[1] in "0123456789" else m[1], token.strip(EDGE).strip(" "))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def save(spark, tmp_path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_every_media_gets_its_edit_list(spark):
    want = defaultdict(list)
    for r in spark.read.parquet(f"{FOLDER}/events.parquet").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) a", "unix_micros(cast(ts as timestamp)) + cast(round(value * 60000000) as long) b").collect():
        if r.b > r.a:
            want[r.user_id].append((r.a // 1000 / 1e3, r.b // 1000 / 1e3))
    got = {r.media: r.content for r in QUERIES["snk_edl_all"](spark, FOLDER).collect()}
    assert max(want) >= 10 and got == {m: "".join(f"{a:.3f}\t{b:.3f}\t1\n" for a, b in sorted(x)) for m, x in want.items()}


def test_every_media_beyond_the_first_twenty(spark, tmp_path):
    rows = [(i, u, "click", 10.0) for i, u in enumerate([3, 25, 400])]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").selectExpr("*", "timestamp_ntz'2024-01-01 00:00:00' as ts").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(r.media for r in QUERIES["snk_edl_all"](spark, str(tmp_path)).collect()) == [3, 25, 400]


def test_runs_of_letters_are_normalized(spark, tmp_path):
    texts = ["Rasssscal?! soooo no", "daaamp 1000 --so-- Soooo, no", None, "straße ‘ooh’ äää good"]
    folder = save(spark, tmp_path, documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = {w: normal(w) for t in texts for w in split(t)}
    assert {r.raw: r.token for r in QUERIES["fn_normalize_all"](spark, folder).collect()} == want
    assert want["soooo"] == want["Soooo,"] == "so" and want["1000"] == "1000" and want["äää"] == "ä"


def test_whole_items_are_searched_where_documents_share_five_words(spark, tmp_path):
    filler = [f"w{i % 7} x{i % 11}" for i in range(150)]
    items = [(7, "One two, three four five six seven"), (9, "red green blue white black"), (11, "too short"), (12, None)]
    docs = [(i, " ".join([*filler[:i], "one two ' three four five sax seven", "red green blue - white black" if i % 2 else "red green", *filler[:9]])) for i in (0, 39, 40, 77, 130)]
    docs += [(200, None), (None, items[0][1]), (201, "one two three four other five"), (202, "One two, three four five")]
    folder = save(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): (r.score, r.heard_at) for r in QUERIES["jn_anchor_best"](spark, folder).collect()}
    want = {}
    words = lambda t: [w for w in map(normal, split(t or "")) if w]
    for i, t in docs:
        for item, u in items:
            heard, asked, best = words(t), words(u), (-1.0, None)
            runs = {tuple(asked[k : k + 5]) for k in range(len(asked) - 4)}
            hits = [k for k in range(len(heard) - 4) if tuple(heard[k : k + 5]) in runs]
            if i is None or not hits:
                continue
            text = " ".join(asked)
            for n in sorted({max(1, min(len(heard), len(asked) + d)) for d in (-1, 0, 1)}):
                for k in range(max(0, hits[0] - len(asked)), min(len(heard) - n, hits[-1] + len(asked)) + 1):
                    said = " ".join(heard[k : k + n])
                    score = 200 * common_length(text, said) / (len(text) + len(said))
                    best = (score, k * 0.3) if score > best[0] else best
            want[i, item] = pytest.approx(best)
    assert got == want and len(want) == 8
