"""The registered query of each operation, with production parameters over its whole table, and SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import language_model, licenses, pieces, toxicity
from loomspan.llm.main_text import extract
from loomspan.llm.mixing import mix
from loomspan.llm.near_duplicates import near_duplicates
from loomspan.llm.near_vectors import near_vectors
from loomspan.llm.quotations import conversations
from loomspan.llm.repair import damaged, repair, with_faults
from loomspan.llm.sharding import Tree, sharded
from loomspan.llm.spelling import variants
from loomspan.llm.top_products import top_products
from loomspan.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        proto = file.read()
    model, counts = language_model.train(docs, toxicity.crc_part(7) != 2, proto)
    scored = language_model.score(docs, model, counts, proto)
    return scored.select("doc_id", (toxicity.crc_part(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


TREE = Tree.regular(3, 2, 4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded(table(spark, sf_dir, "documents").select("doc_id", "text"), TREE)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "position")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    options = toxicity.ToxicityOptions()
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), toxicity.crc_part(4) != 2, options)
    predicted = F.when(F.col("score") >= options.predicted, 1).otherwise(0)
    return toxicity.score(docs, model, options).select("doc_id", (toxicity.crc_part(4) == 2).alias("held_out"), "score", predicted.alias("predicted"), "offending")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("row")


def piece_model() -> pieces.PieceModel:
    return pieces.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = piece_model()
    coded = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, decoded="decoded")
    return pieces.digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op9_chat_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def chat_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator on conversations whose turns each quote the one before, wrapped anew at 60 characters: whom each answers."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    quote = F.rtrim(F.regexp_replace(F.trim(before), r"(?s)\s*(\S.{0,59})(?=\s|\z)", "> $1\n"))
    made = rows.withColumn("text", F.concat_ws("\n", F.regexp_replace(quote, r"\n(?!> )", "\n> "), "text"))
    return conversations(made).select("conv_id", "turn", "reply_to")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(with_faults(damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP4_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.k + y.k - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.k, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

OP8_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP10_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x,
  embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS able FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.able AND b.able AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS root FROM v UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node WHERE r.root < l.b),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.component_id = v.vec_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""

# CRC-32 of a text whose code points lie below U+0100: its bytes, folded over a table of 256 entries made by rule
CRC_TABLE = "(SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) FROM range(256) t(n))"


def crc_sql(text: str) -> str:
    """SQL for the CRC-32 of an expression; a table crc(t) of CRC_TABLE must be joined."""
    codes = f"list_transform(regexp_extract_all({text}, '(?s).'), lambda c: unicode(c)::BIGINT)"
    data = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(list_reduce({data}, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT), 4294967295)"


OP13_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT d, w, length(w) AS k, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, k, n, {crc_sql("d || ':' || w")} AS h FROM g, crc),
c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % k)::INT) || substr(w, (h % k)::INT + 2) ELSE w END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM c WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.cut = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.cut = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN near_n >= 2 * w.n THEN near END AS form, CASE WHEN near_n >= 2 * w.n THEN near_n END AS form_n FROM w LEFT JOIN b ON b.word = w.word),
o AS (SELECT word, word AS root FROM f WHERE form IS NULL UNION ALL SELECT f.word, o.root FROM o JOIN f ON f.form = o.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN o ON o.word = f.word
"""

def _way(of: str, cost: str, letter: str, line: str = "") -> str:
    """SQL for a way of op12 that goes on from another: its cost, audit and lines."""
    lines = f"list_append({of}.t, {line})" if line else f"{of}.t"
    return f"{{'c': {of}.c + {cost}, 'a': {of}.a || '{letter}', 't': {lines}}}"


def _kept(of: str, initial: str) -> str:
    name = {"u": "user", "a": "assistant"}.get(initial)
    rerole = f", CASE WHEN ok THEN {_way(of, '1 + m', 'R', f"'{name}:' || text")} END" if name else ""
    return f"CASE WHEN ok AND i1 = '{initial}' THEN {_way(of, 'm', 'K', "role || ':' || text")} END{rerole}"


OP12_SQL = rf"""
WITH RECURSIVE crc AS (SELECT {CRC_TABLE} AS t),
b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS n FROM b WHERE k <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, n) AS seen,
  regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS i1, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o),
r AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS e, {{'c': 1000000000::BIGINT, 'a': '', 't': []::VARCHAR[]}} AS s,
    {{'c': 5::BIGINT, 'a': 'I', 't': ['user:']}} AS u, {{'c': 10::BIGINT, 'a': 'II', 't': ['user:', 'assistant:']}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, e1, s1, u2, list_min([a1, {_way('u2', '5', 'I', "'assistant:'")}]) FROM (
    SELECT *, list_min([u1, {', '.join(_way(x, '5', 'I', "'user:'") for x in ('e1', 's1', 'a1'))}]) AS u2 FROM (
      SELECT conv_id, i, {_way('e', '2', 'D')} AS e1, list_min([{_way('s', '2', 'D')}, {_kept('e', 's')}]) AS s1,
        list_min([{_way('u', '2', 'D')}, {', '.join(_kept(x, 'u') for x in 'esa')}]) AS u1, list_min([{_way('a', '2', 'D')}, {_kept('u', 'a')}]) AS a1
      FROM (SELECT r.conv_id, f.i, e, s, u, a, role, text, i1, fault NOT IN ('blank', 'duplicate') AS ok, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS m FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1)))),
g AS (SELECT conv_id, i, fault, turn, lag(i1) OVER (PARTITION BY conv_id ORDER BY i) || i1 AS two FROM f),
c AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
z AS (SELECT r.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, list_min([e, a]) AS best
  FROM r LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM r.conv_id WHERE r.i = coalesce(c.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256 FROM z
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_license_scan": op6_license_scan,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_chat_quotations": op9_chat_quotations,
    "chat_replies": chat_replies,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
    "op11_html_extraction": op11_html_extraction,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "chat_replies": "SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS reply_to FROM conversations",
    "op4_minhash_near_dedup": OP4_SQL,
    "op6_license_scan": licenses.scan_sql(),
    "op8_exact_top_k": OP8_SQL,
    "op10_embedding_near_dedup": OP10_SQL,
    "op12_conversation_repair": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
