"""From raw documents to a mixed, deduplicated and encoded corpus, in five
stages. Each takes (spark, docs, sf_dir), works on all rows its predecessor
kept, and returns a DataFrame; all but the last return the columns of documents.

Every stage numbers its rows (``row_keys``) and decides on each row by its number:
null, repeated and shared doc_ids are rows like all others, and one row of each
group of equal or similar texts stays, whatever its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.llm.common import read, row_keys, save
from precedent.llm.exact_dedup import exact_dedup
from precedent.llm.minhash_dedup import near_dedup
from precedent.llm.pfair_mix import mix_sources, mixed
from precedent.llm.quality_cotraining import score_quality
from precedent.llm.sentencepiece_sampling import encode


def _without(docs: DataFrame, keyed: DataFrame, row: str, gone: DataFrame) -> DataFrame:
    """The rows of ``keyed`` less those that ``gone`` numbers, as columns of ``docs``."""
    return keyed.join(gone, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def _others(keyed: DataFrame, row: str, groups: DataFrame, largest: bool) -> DataFrame:
    """Numbers of all rows but one of each group (row, group): that of the largest or
    smallest doc_id, a null after all others, the first row of several."""
    own = groups.join(keyed.select(row, F.col("doc_id").cast("long").alias("id")), row)
    id_ = F.col("id") if largest else -F.col("id")
    stays = own.groupBy("group").agg(F.max(F.struct(id_.alias("id"), (-F.col(row)).alias("r")))["r"].alias("r"))
    return own.join(stays.select((-F.col("r")).alias(row)), row, "left_anti").select(row)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps (text-less ones go)."""
    keyed, row = row_keys(docs)
    marks = score_quality(keyed, read(spark, sf_dir, "labels"), row_col=row)
    return _without(docs, keyed, row, marks.where("not kept").select(F.col("row").alias(row)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the largest id."""
    keyed, row = row_keys(docs)
    marks = exact_dedup(keyed, id_col=row).where("group_size > 1")
    groups = marks.select(F.col("doc_id").alias(row), F.col("text_sha256").alias("group"))
    return _without(docs, keyed, row, _others(keyed, row, groups, largest=True))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id."""
    keyed, row = row_keys(docs)
    groups = near_dedup(keyed, id_col=row).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    return _without(docs, keyed, row, _others(keyed, row, groups, largest=False))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture of sources."""
    return mixed(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of each document and its place in the mixture: doc_id,
    ids, n_pieces, lossless, source, slot, at, on_target.

    The texts of a source keep the order in which ``docs`` holds them, which is what
    the mixing stage decided: order by (slot, at) for the mixture, that of its files.
    Rows meet their slots by their numbers, so that null and repeated ids each have
    their own."""
    keyed, row = row_keys(docs)
    size = F.octet_length(F.col("text").cast("string"))
    coded = save(encode(keyed, keep={"source": F.col("source"), "size": size, "row": F.col(row)}), "pieces")
    slots = mix_sources(coded, size_col="size", keep=["row"], row_col="row", drawn=False).select("row", "slot", "at", "on_target")
    return coded.join(slots, "row").drop("row", "size")


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("mixing", mixture),
    ("sentencepiece", pieces),
]

#: The first stage is a trained classifier and the last draws at random: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
