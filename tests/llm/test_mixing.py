import random
import re

import pytest

from loomspan.llm.mixing import MixOptions, mix, training_rows

SCHEMA = "doc_id long, text string, source string, size int, n_chars long"


def wanted(sizes, o):
    """Targets by source: the excess over caps is shared again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: o.weights[i % len(o.weights)] for i, s in enumerate(names)}
    total, capped = o.total * sum(sizes.values()), {}
    while True:
        left = total - sum(capped.values())
        level = left / (sum(w[s] for s in names if s not in capped) or 1)
        over = [s for s in names if s not in capped and level * w[s] >= o.epochs * sizes[s]]
        if not over:
            return {s: capped.get(s, level * w[s]) for s in names}
        capped |= {s: o.epochs * sizes[s] for s in over}


def moment(schedule, share, steps=20000):
    area = [0.0]
    n = len(schedule) - 1
    f = lambda t: schedule[min(int(t * n), n - 1)] + (schedule[min(int(t * n), n - 1) + 1] - schedule[min(int(t * n), n - 1)]) * (t * n - min(int(t * n), n - 1))
    for i in range(steps):
        area.append(area[-1] + (f(i / steps) + f((i + 1) / steps)) / 2 / steps)
    return next((i / steps for i, a in enumerate(area) if a >= share * area[-1]), 1.0)


def corpus():
    rng = random.Random(1)
    docs = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice(["a", "a", "a", "a", "b", "c", "é", None]), 1, 9) for i in range(500)]
    docs += [(900, "same words here", "a", 1, 9)] * 40 + [(None, None, "a", 1, 9)] * 3 + [(901, "tiny", "zz", 1, 9)]
    return docs


@pytest.mark.parametrize("bucket", [50_000, 10])
def test_against_brute_force(spark, bucket):
    docs, o = corpus(), MixOptions(bucket=bucket)
    out = mix(spark.createDataFrame(docs, SCHEMA).repartition(3), o).collect()
    assert len(out) == len(docs)
    sizes, count = {}, lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for _, t, s, *_ in docs:
        sizes[s] = sizes.get(s, 0) + count(t)
    want, got = wanted(sizes, o), {}
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p.words for p in r.placements)
        got[r.source] = got.get(r.source, 0) + r.taken
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    at = [r.position for r in out if r.position is not None]
    assert at == sorted(at) and all(r.position is None for r in out[len(at) :])
    # positions invert the source's demand at the start of each range
    names = sorted((s for s in sizes if s is not None)) + [None]
    for s in ("a", "b", "c"):
        places = sorted((p.epoch, p.position, p.words) for r in out if r.source == s for p in r.placements)
        done = 0
        for _, x, n in places:
            assert abs(x - moment(o.schedules[names.index(s) % 3], done / want[s])) < 2e-3
            done += n
    again = mix(spark.createDataFrame(docs[::-1], SCHEMA).repartition(7), o).collect()
    assert sorted(map(repr, (tuple(r)[:8] for r in again))) == sorted(map(repr, (tuple(r)[:8] for r in out)))


def test_training_rows(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    out = training_rows(df).collect()
    mixed = mix(df).collect()
    assert len(out) == sum(len(r.placements) for r in mixed)
    assert sum(len((r.text or "").split()) for r in out) == sum(r.taken for r in mixed)
    assert out[0].asDict().keys() == dict.fromkeys(["doc_id", "text", "source", "size", "n_chars"]).keys()
    assert training_rows(df.limit(0)).count() == 0 and mix(df.limit(0)).count() == 0


def test_training_rows_when_files_are_split_anew(spark, tmp_path):
    spark.createDataFrame(corpus(), SCHEMA).repartition(6).write.parquet(f"{tmp_path}/docs")
    docs, key = spark.read.parquet(f"{tmp_path}/docs"), "spark.sql.files.maxPartitionBytes"
    want = sorted((repr(r.doc_id), p.words) for r in mix(docs).collect() for p in r.placements)
    before = spark.conf.get(key)
    try:
        out = training_rows(docs)
        spark.conf.set(key, "2000")
        got = sorted((repr(r.doc_id), len((r.text or "").split())) for r in out.collect())
    finally:
        spark.conf.set(key, before)
    assert got == want


def test_rows_are_right_when_parallelism_changes_between_plan_and_run(spark, tmp_path):
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(i % 17)), "abc"[i % 3], 1, 9) for i in range(900)], SCHEMA)
    docs.repartition(12).write.parquet(str(tmp_path / "docs"))
    key = "spark.sql.leafNodeDefaultParallelism"
    spark.conf.set(key, "2")
    try:
        out = training_rows(spark.read.parquet(str(tmp_path / "docs")))
        spark.conf.set(key, "16")
        got = sorted((r.doc_id, len(r.text.split()), set(w.split("x")[0] for w in r.text.split())) for r in out.collect())
    finally:
        spark.conf.unset(key)
    assert all(len(owners) == 1 and owners == {f"w{i}"} for i, _, owners in got)
    assert [(i, n) for i, n, _ in got] == sorted((r.doc_id, p.words) for r in mix(docs).collect() for p in r.placements)


def test_very_long_text(spark):
    rows = [(1, "word " * 300000, "a", 1, 9), (2, "b c", "b", 1, 9)]
    out = {r.doc_id: r for r in mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[1].size == 300000 and out[2].size == 2 and out[2].taken == 4
