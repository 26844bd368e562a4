"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import bpe, chat_format, exact_dedup, knn_quality, license_scan, line_dedup, local_descriptors, near_dedup, periodic_runs, pfair_mix, spelling_groups, substring_dedup, suffix_dedup
from pitchlake.llm.sql import ORACLES  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path() -> str:
    """The public tokenizer file, which is installed with its package on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_knn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn_quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir), tokenizer_path())


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(documents(spark, sf_dir))


#: Target weights of the mixture; sources that it doesn't list get their mean.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 1.0}


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix.mix_plan(documents(spark, sf_dir), MIX_WEIGHTS)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat_format.chat_digest(turns.unionByName(extra))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def op10_local_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_descriptors.edited_copies(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(periodic_runs.with_planted_runs(documents(spark, sf_dir)))


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.spelling_groups(documents(spark, sf_dir))


QUERIES = {
    "op1_knn_quality": op1_knn_quality,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pfair_mix": op4_pfair_mix,
    "op5_license_scan": op5_license_scan,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_near_dedup": op9_near_dedup,
    "op10_local_descriptors": op10_local_descriptors,
    "op11_line_dedup": op11_line_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_groups": op13_spelling_groups,
}
