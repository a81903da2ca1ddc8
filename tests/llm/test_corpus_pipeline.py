import hashlib
import random
import sys
from pathlib import Path

import public_tokenizers
import sentencepiece

import corpus_pipeline as C
from loomspan.llm.mixing import MixOptions, mix
from loomspan.llm.near_duplicates import near_duplicates
from loomspan.llm.queries import op5_toxicity
from loomspan.session import durable

sys.path.insert(0, str(Path(__file__).parent))
from test_mixing import corpus as mix_corpus  # noqa: E402
from test_mixing import wanted  # noqa: E402
from test_near_duplicates import brute  # noqa: E402
from test_toxicity import corpus as toxic_corpus  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_follow_their_operators(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["toxicity", "near_dedup", "mixing", "sentencepiece"]
    assert [n for n, _ in C.STAGES] == names
    clean = C.reject_toxic(spark, docs, FOLDER)
    bad = {r.doc_id for r in op5_toxicity(spark, FOLDER).collect() if r.predicted}
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r.doc_id for r in docs.collect() if r.doc_id not in bad)
    single = C.drop_near_copies(spark, clean, FOLDER)
    kept = sorted(r.doc_id for r in near_duplicates(clean).collect() if r.kept)
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == kept
    mixed = C.mix_sources(spark, docs, FOLDER).collect()
    want = sorted((r.doc_id, p.words) for r in mix(docs).collect() for p in r.placements)
    assert sorted((r.doc_id, len(r.text.split())) for r in mixed) == want
    out = C.run(spark, FOLDER)
    assert out.columns == ["part", "line", "doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_the_order_of_training_reaches_the_end(spark):
    """Files are read in another order than they were written in; part and line tell that of the mix."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    mixed = C.mix_sources(spark, docs, FOLDER)
    want = [(r.doc_id, len(r.text)) for r in mixed.collect()]
    stored = durable(mixed, "mixed")
    texts = {}
    coded = C.encode_pieces(spark, stored, FOLDER).select("part", "line", "doc_id", "decoded_sha256").collect()
    for r in stored.collect():
        texts.setdefault(r.doc_id, set()).add(len(r.text))
    order = [r.doc_id for r in sorted(coded, key=lambda r: (r.part, r.line))]
    assert order == [d for d, _ in want] and len({(r.part, r.line) for r in coded}) == len(want)
    positions = {}
    for r in mix(docs).collect():
        for p in r.placements:
            positions.setdefault(r.doc_id, []).append(p.position)
    seen = {d: iter(sorted(p)) for d, p in positions.items()}
    at = [next(seen[d]) for d in order]
    assert at == sorted(at)


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    """Against the planted words; documents of the held-out part are not learned from."""
    docs = toxic_corpus(800)
    spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in docs], SCHEMA)
    kept = C.reject_toxic(spark, rows, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, _, y in docs if not y]


def test_the_mix_meets_its_targets(spark):
    """Words by source against targets worked out in plain Python."""
    docs = [(i, t, "en", s, n) for i, t, s, _, n in mix_corpus()]
    sizes, taken = {}, {}
    for _, t, _, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for r in C.mix_sources(spark, spark.createDataFrame(docs, SCHEMA), FOLDER).collect():
        taken[r.source] = taken.get(r.source, 0) + len(r.text.split())
        assert r.n_chars == 9 or r.n_chars == len(r.text)
    want = wanted(sizes, MixOptions())
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in want)


def test_nulls_copies_and_empty_tables(spark):
    rows = [(1, None, "en", None, None), (1, None, "en", None, None), (None, "a b c d e f", None, "s", 3), (None, "a b c d e f", None, "s", 3), (2, "", "en", "s", 0), (3, "w " * 3000, "en", "t", 6000), (4, "w " * 3000, "en", "t", 6000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = C.drop_near_copies(spark, docs, FOLDER).collect()
    assert sorted((repr(r.doc_id) for r in out)) == ["1", "2", "3", "None", "None"]
    assert C.reject_toxic(spark, docs, FOLDER).count() == 7
    taken = C.mix_sources(spark, docs, FOLDER).collect()
    assert {r.doc_id for r in taken} == {3, 4, None}
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_near_copies_against_brute_force(spark):
    """One row stays of each group; rows of one doc_id with different texts stay together; the rest is untouched."""
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefgh") * 2 + str(rng.randrange(50)) for _ in range(40)) for _ in range(6)]
    rows = [(i, rng.choice(base) + rng.choice(["", " end", " tail"]), "en", rng.choice("xyz"), i % 7) for i in range(60)]
    rows += [(3, base[0] + " other words here now", "en", "z", 1), (3, base[0] + " other words here now", "de", "a", 1), (None, base[1], "en", "q", 2), (61, None, None, None, None), (61, None, "en", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    kept = {c for i, _, c, k in brute([(r[0], r[1]) for r in rows]) if k}
    want = {}
    for r in rows:
        if r[0] in kept:
            key = (r[0], r[1] or "")
            want[key] = min(want.get(key, r), r, key=lambda x: [(v is not None, v) for v in x])
    got = C.drop_near_copies(spark, docs, FOLDER)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([*want.values(), rows[-3]], key=repr)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(i, f"word{i} and more text of row {i % 3}", "en", "s", 9, 1, 2.0, 3, "p", 5) for i in range(12)], SCHEMA + ", _row int, _score double, _size int, _p string, _key int")
    for name, stage in C.STAGES[:3]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns, name
        assert all(r._row == 1 and r._p == "p" and r._key == 5 for r in out.collect()), name
    assert C.encode_pieces(spark, docs, FOLDER).count() == 12


def test_encoding_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in C.encode_pieces(spark, docs, FOLDER).collect():
        ids = library.encode(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
