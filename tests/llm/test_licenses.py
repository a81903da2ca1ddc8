import math
import random

from loomspan.llm.licenses import TEMPLATES, scan

SCHEMA = "doc_id long, text string, row int, template int"


def cut(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split() if w]
    return [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def brute(docs, templates=TEMPLATES):
    out = []
    for i, text, *_ in docs:
        r = cut(text)
        for name, _, t in templates:
            own = set(cut(t))
            half = 2 ** math.ceil(math.log2(2 * len(cut(t)))) // 2
            best = max(((len(own & set(r[s : s + 2 * half])), -s) for s in range(0, max(1, len(r)), half)), default=(0, 0))
            if best[0] / len(own) >= 0.75:
                out.append((i, name, best[0], -best[1]))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    rng = random.Random(6)
    filler = [f"w{i}" for i in range(50)]
    docs = [(1, None, 1, 1), (2, "", 1, 1), (3, "Under License", 1, 1), (None, TEMPLATES[0][2], 1, 1), (4, TEMPLATES[0][2], 1, 1), (4, TEMPLATES[0][2], 1, 1)]
    for i in range(60):
        _, _, t = rng.choice(TEMPLATES)
        words = t.split()
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "changed"
        around = [rng.choice(filler) for _ in range(rng.randrange(0, 200))]
        at = rng.randrange(len(around) + 1)
        docs.append((10 + i, " ".join([*around[:at], *words, *around[at:]]).upper(), 1, 1))
    docs.append((100, " ".join(filler * 2000 + TEMPLATES[1][2].split() * 3), 1, 1))
    got = sorted(((r.doc_id, r.template, r.found, r.first_run) for r in scan(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)
    assert got == brute(docs) and len(got) > 50
    assert scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_of_two_equal_windows_the_first_is_named(spark):
    text = TEMPLATES[2][2]
    docs = [(1, " ".join([*["x"] * 70, text, *["x"] * 70, text, *["x"] * 9]), 1, 1)]
    got = [(r.doc_id, r.template, r.found, r.first_run) for r in scan(spark.createDataFrame(docs, SCHEMA)).collect()]
    assert got == brute(docs) and got[0][3] < 72


def test_templates_as_a_table(spark):
    rng = random.Random(9)
    own = [(f"t{i}", "Own", " ".join(rng.choices([f"v{k}" for k in range(400)], k=rng.choice([2, 5, 30, 90])))) for i in range(40)]
    table = spark.createDataFrame(own, "template string, license string, text string")
    docs = []
    for i in range(40):
        words = own[i][2].split()
        docs.append((i, " ".join([*rng.choices([f"v{k}" for k in range(400)], k=rng.randrange(300)), *(w if rng.random() < 0.98 else "new" for w in words), "end"]), 1, 1))
    got = sorted(((r.doc_id, r.template, r.found, r.first_run) for r in scan(spark.createDataFrame(docs, SCHEMA), table).collect()), key=repr)
    assert got == brute(docs, own) and len(got) > 20
    assert scan(spark.createDataFrame(docs, SCHEMA), table.limit(0)).count() == 0


def test_many_licenses_in_a_very_long_text(spark):
    docs = [(1, " ".join(f"{TEMPLATES[i % len(TEMPLATES)][2]} and {i}" for i in range(1500)), 1, 1)]
    got = sorted(((r.doc_id, r.template, r.found, r.first_run) for r in scan(spark.createDataFrame(docs, SCHEMA)).collect()), key=repr)
    assert got == brute(docs)
