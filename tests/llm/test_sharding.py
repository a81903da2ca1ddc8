import math
import struct
import zlib

import xxhash

from loomspan.llm.queries import TREE
from loomspan.llm.sharding import Tree, sharded, write_shards

SCHEMA = "doc_id long, text string, shard string, size int, slot int"


def hashed(key, name):
    seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
    return xxhash.xxh64(name.encode(), seed=seed).intdigest()


def brute(tree, key):
    def win(level, children):
        return min((-math.log(((hashed(key, f"{level} {n}") >> 11) + 1) / 2**53) / w, n) for n, w in children if w)[1]

    racks, shards, r0, s0 = [], [], 0, 0
    for region in tree.regions:
        racks.append([])
        for rack in region:
            racks[-1].append((r0, sum(rack)))
            shards.append([(s0 + i, w) for i, w in enumerate(rack)])
            r0, s0 = r0 + 1, s0 + len(rack)
    region = win("region", [(i, sum(w for _, w in x)) for i, x in enumerate(racks)])
    return win("shard", shards[win("rack", racks[region])])


def test_against_brute_force(spark):
    docs = [(i, f"text {i}" * (i % 7), "x", 1, 2) for i in range(3000)] + [(None, None, "x", 1, 2)] * 3 + [(5, "again é", "x", 1, 2)]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    out = sharded(df, TREE).collect()
    assert len(out) == len(docs)
    by = {}
    for r in out:
        assert r.shard == brute(TREE, r.doc_id) and r.grown_shard == brute(TREE.grown(), r.doc_id)
        assert r.grown_shard in (r.shard, 24)
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and len(by) == 24
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in out}
    assert sizes == {(i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in docs}
    moved = sum(r.grown_shard == 24 for r in out)
    assert 3000 / 25 * 0.6 < moved < 3000 / 25 * 1.4


def test_weights_confine_movement(spark):
    df = spark.range(4000).selectExpr("id doc_id", "'x' text")
    old = Tree((((1, 1), (1,)), ((2, 1),)))
    new = Tree((((1, 1), (1,)), ((2, 3),)))
    a, b = ({r.doc_id: (r.region, r.rack, r.shard) for r in sharded(df, t).collect()} for t in (old, new))
    assert all(a[i] == b[i] or b[i][0] == 1 for i in a)
    share = sum(v[2] == 3 for v in a.values()) / 4000
    assert abs(share - 2 / 6) < 0.04
    assert sharded(df.limit(0), TREE).count() == 0


def test_written_shards(spark, tmp_path):
    df = spark.range(200).selectExpr("id doc_id", "'x' text")
    write_shards(df, TREE, f"{tmp_path}/s")
    back = spark.read.parquet(f"{tmp_path}/s")
    want = {(r.doc_id, r.shard) for r in sharded(df, TREE).collect()}
    assert {(r.doc_id, r.shard) for r in back.collect()} == want
