"""The registered queries of this subpackage, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precedent.llm.common import read
from precedent.llm.embedding_dedup import near_vectors
from precedent.llm.exact_dedup import exact_dedup
from precedent.llm.hard_negatives import mine_negatives
from precedent.llm.katz_lm import katz_scores
from precedent.llm.language_crf import predict_language
from precedent.llm.license_scan import scan_licenses
from precedent.llm.minhash_dedup import near_dedup
from precedent.llm.oracles import EXACT_SQL, NEAR_SQL, NEGATIVES_SQL, SECRET_SQL, VARIANTS_SQL
from precedent.llm.pfair_mix import mix_sources
from precedent.llm.quality_cotraining import score_quality
from precedent.llm.secret_scan import scan_secrets
from precedent.llm.sentencepiece_sampling import encode
from precedent.llm.span_dedup import span_dedup
from precedent.llm.spelling_variants import group_variants


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text, with the proof that they decode to it."""
    return encode(read(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by co-trained views."""
    return score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learnt from three of four folds."""
    return predict_language(read(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence of every document. Documents have no paths: each is laid in the
    tree source / ten thousands / hundreds of its id, where the first of each
    hundred is its directory's licence file, that of each ten thousand the upper
    directory's, and the first of all the root's."""
    docs = read(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.when(i % 100 == 0, F.lit("LICENSE")).otherwise(F.concat(F.lit("doc"), i.cast("string")))
    upper = F.when(i != 0, F.floor(i / 10000).cast("string"))
    lower = F.when(i % 10000 != 0, F.floor(i / 100).cast("string"))
    path = F.concat_ws("/", "source", upper, lower, name)
    out = scan_licenses(docs.select("doc_id", "text", path.alias("path")), id_col="doc_id")
    return out.withColumnRenamed("file_id", "doc_id")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts; the largest doc_id stays."""
    return exact_dedup(read(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate texts."""
    return near_dedup(read(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors."""
    return near_vectors(read(spark, sf_dir, "embeddings"))


def op8_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without sentences that repeat passages of earlier ones."""
    return span_dedup(read(spark, sf_dir, "documents"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text scored by a Katz model of six of seven folds."""
    return katz_scores(read(spark, sf_dir, "documents"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pfair slots of every document; sources weigh the root of their bytes."""
    return mix_sources(read(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with the form that each is a variant of."""
    return group_variants(read(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has moved on by a label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text, weak parts where they make up a credential."""
    return scan_secrets(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_sentencepiece, op2_quality, op3_language, op4_licenses, op5_exact_dedup, op6_minhash, op7_embeddings, op8_spans,
    op9_katz, op10_mix, op11_variants, op12_hard_negatives, op13_secrets, pipeline)}
ORACLE = {"op5_exact_dedup": EXACT_SQL, "op6_minhash": NEAR_SQL, "op11_variants": VARIANTS_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_secrets": SECRET_SQL}
