"""The stages of a corpus run over documents: reject toxic texts, keep one of each near-duplicate group, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Defined results: an empty table gives an empty one at each stage; null, empty and very long texts, null doc_ids and repeated
rows are handled as the operators' modules say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import pieces, toxicity
from loomspan.llm.mixing import training_rows
from loomspan.llm.near_duplicates import near_duplicates
from loomspan.llm.queries import piece_model, table
from loomspan.llm.sieve import bitmap, sieved
from loomspan.session import durable


def numbered(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[Column]]:
    """docs with columns named by their place but for some, so that none can clash with a new one; and how they are named again."""
    names = [c if c in kept else f"c{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold. Only labels of the training part are learned from.

    Rows go by their own score: equal rows of one doc_id are scored alike.
    """
    options = toxicity.ToxicityOptions()
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), toxicity.crc_part(4) != 2, options)
    rows, columns = numbered(docs, "text")
    return toxicity.with_score(rows, model, options).where(F.col("_score") < options.predicted).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest doc_id.

    Rows of one doc_id are one document. Of its rows with equal texts the first in the order of all columns stays; rows
    with different texts all stay, so no text is lost. A document without words is linked with nothing and stays; rows
    without doc_id stay as they are.
    """
    rows, columns = numbered(docs, "doc_id", "text")
    known = rows.where("doc_id is not null")
    dropped = durable(near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    keyed = known.withColumn("_key", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    twice = durable(keyed.groupBy("doc_id", "_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"), "twice")
    # most rows are neither dropped nor there twice, and are told so by a bitmap: their texts are not shuffled
    bits = bitmap(dropped.union(twice.select("doc_id")), "doc_id")
    clear = sieved(known, "doc_id", bits).where("not _met").select(*rows.columns)
    held = sieved(keyed, "doc_id", bits).where("_met").drop("_met").join(dropped, "doc_id", "left_anti")
    once = held.join(twice, ["doc_id", "_key"], "left_anti").select(*rows.columns)
    again = held.join(twice, ["doc_id", "_key"], "left_semi").groupBy("doc_id", "_key").agg(F.min(F.struct(*rows.columns)).alias("_r"))
    return clear.union(once).union(again.select("_r.*")).select(*columns).union(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time it takes them, in training order, which the next stage reads off the files."""
    return training_rows(docs)


def written_place(docs: DataFrame) -> tuple[Column, Column]:
    """(part, line): where each row of a table stands as it was written, so that its order is not lost when files are read in another.

    Files of a table are numbered by the partitions that wrote them. Of rows that lie in no file, the partition and the
    place in it are taken.
    """
    if docs.inputFiles():
        return F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long"), F.col("_metadata.row_index")
    number = F.monotonically_increasing_id()
    return F.shiftright(number, 33), number.bitwiseAND(F.lit((1 << 33) - 1))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row's ids, and digests of the ids and of the text that they decode to; (part, line) is the order of training.

    docs: a table as mix_sources' rows were written. part and line are null for files that are not named as Spark names them.
    """
    model = piece_model()
    part, line = written_place(docs)
    coded = pieces.encode(docs.select(part.alias("part"), line.alias("line"), "doc_id", "source", "text"), model, decoded="decoded")
    return pieces.digests(coded).select("part", "line", "doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # trained scores and hashes of whole texts: tests compare each stage with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs, name)
    return docs
