"""Corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, and the rest is packed.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; `run` writes
each stage's result as Parquet to the shared folder and reads it again for the next. All but the last
stage return the columns of documents. Rows are judged each by its own text, also where they share a
doc_id; a null doc_id comes after all others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm import packing, simhash, suffix_dedup, toxicity
from heddle.llm.support import LAST_ID, load, scratch, stored, text_tag


def _free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the model learns from the labels of these documents."""
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, F.lit(True))
    pa.default_memory_pool().release_unused()  # the sample's memory on the driver, which later stages don't need
    score = _free(docs, "toxicity")
    return toxicity.scored(docs, model, score).where(F.col(score) < toxicity.THRESHOLD).select(docs.columns)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with two columns that tell a document: its doc_id (null: after all others) and 128 bits of its text."""
    id_, tag = _free(docs, "key_id"), _free(docs, "key_tag")
    return docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))).withColumn(tag, text_tag("text")), id_, tag


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near-duplicates: five-word shingles, likeness 0.8 or more.

    Rows are judged by their texts, whatever ids they share. A null doc_id comes after all others, equal ids go by a hash of the text,
    and of rows that have both alike one stays (that of least hash of all columns).
    """
    first = (F.col("id") == F.col("first_id")) & (F.col("tag") == F.col("first_tag"))
    keyed, id_, tag = _keyed(docs)
    with scratch():  # the search's own tables aren't kept for the stages that follow
        near = simhash.near_duplicates(docs).withColumn("first", first)
        near = stored(near.select(F.col("id").alias(id_), F.col("tag").alias(tag), "copies", "first"), "near", outside=True)
    out = keyed.join(near.where("not first or copies > 1").select(id_, tag), [id_, tag], "left_anti").select(docs.columns)
    repeated = keyed.join(near.where("first and copies > 1").select(id_, tag), [id_, tag], "left_semi")
    whole = F.struct(*docs.columns)
    one = repeated.groupBy(id_, tag).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(id_ + "row"))
    return out.unionByName(one.select(id_ + "row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings of earlier documents; a character that is cut in two goes whole. n_chars follows the text.

    What a row loses follows from its doc_id (null: after all others) and its text, so rows that share an id keep what is their own.
    """
    # all columns travel with the text, so the texts are shuffled for the search alone
    null = _free(docs, "no_text")
    others = [c for c in docs.columns if c != "text"]
    carried = F.struct(*others, F.col("text").isNull().alias(null))
    out = suffix_dedup.deduplicated(docs.select("doc_id", "text", carried.alias("carried")))
    columns = {c: F.col("carried").getField(c) for c in others} | {"text": F.when(~F.col("carried").getField(null), F.col("text"))}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_removed") == 0, columns["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of all that is left: one row for each piece."""
    return packing.packed(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", drop_near_duplicates), ("suffix_dedup", cut_repeats), ("packing", pack)]

#: Learnt scores and byte surgery are not SQL's: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
