from pyspark.sql import functions as F

from loomspan.functions import text as X
from loomspan.operators import matching as M
from loomspan.operators import sync as A


def test_runs_of_words_are_those_of_plain_python(spark):
    rows = [(1, ["a", "b", "a", "b", "a"]), (2, ["a", "b"]), (3, []), (4, None), (5, ["b", "a", "b", "ä"]), (6, ["ab", "a", "b"])]
    got = A.word_runs(spark.createDataFrame(rows, "id int, w array<string>").coalesce(1), "id", "w", 3).collect()
    want = {(id, i): tuple(w[i : i + 3]) for id, w in rows if w for i in range(len(w) - 2)}
    assert len(got) == len(want) and {(r.id, r.pos) for r in got} == set(want)
    names = {}
    for r in got:
        assert names.setdefault(want[r.id, r.pos], r.run) == r.run
    assert len(set(names.values())) == len(names)


def test_words_are_normalised_once(spark):
    lines = spark.createDataFrame([(1, "One two"), (2, ""), (3, None)], "id int, text string")
    tokens = M.tokens(lines, "id")
    assert [tuple(r) for r in tokens.orderBy("pos").collect()] == [(1, 0, "One", "one"), (1, 1, "two", "two")]
    plan = tokens._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("BatchEvalPython") + plan.count("ArrowEvalPython") == 1, plan


def test_ratio_of_equal_first_texts(spark):
    rows = [("abc", "axbxc"), ("abc", ""), ("", ""), ("abc", "cab"), ("", "x"), ("é😀", "😀"), (None, "x")]
    got = [r.r for r in spark.createDataFrame(rows, "a string, b string").coalesce(1).select(X.fuzz_ratio(F.col("a"), F.col("b")).alias("r")).collect()]
    assert got == [75.0, 0.0, 100.0, 200 * 2 / 6, 0.0, 200 / 3, None]
