"""The registered queries of the numbered operators and, where SQL expresses them, their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.batches import bounded_batches
from siltstone.llm.decontaminate import CONTAMINATION_ORACLE, find_contamination
from siltstone.llm.fim import FIM_ORACLE, fill_in_middle, restore
from siltstone.llm.jaccard import jaccard_classes
from siltstone.llm.language import fit_language, identify_language
from siltstone.llm.licenses import license_oracle, scan_licenses
from siltstone.llm.lm import LmParams, score, train
from siltstone.llm.packing import pack
from siltstone.llm.quality import fit_quality, score_quality
from siltstone.llm.runs import digests, find_runs, planted
from siltstone.llm.secrets import scan_secrets
from siltstone.llm.substrings import SUBSTRING_ORACLE, mark_repeats
from siltstone.llm.topk import TOP_K_ORACLE, quantised, top_k
from siltstone.llm.toxicity import fit_toxicity, score_toxicity
from siltstone.session import table


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file is; the package is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), quantised(F.col("embedding")).alias("v"))
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_language(docs, fit_language(docs))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, params = table(spark, sf_dir, "documents"), LmParams()
    fold = F.crc32(F.col("doc_id").cast("string")) % params.fold
    return score(docs, train(docs.filter(fold != params.held), params), F.coalesce(fold == params.held, F.lit(False)))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(find_runs(docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_top_k_search": op1_top_k_search,
        "op2_decontamination": op2_decontamination,
        "op3_license_scan": op3_license_scan,
        "op4_toxicity": op4_toxicity,
        "op5_language_id": op5_language_id,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_secret_scan": op9_secret_scan,
        "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_quality_classifier": op12_quality_classifier,
        "op13_periodic_runs": op13_periodic_runs,
    }
    return {name: _bounded(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_top_k_search": TOP_K_ORACLE,
        "op2_decontamination": CONTAMINATION_ORACLE,
        "op7_substring_dedup": SUBSTRING_ORACLE,
        "op3_license_scan": license_oracle(),
        "op11_fill_in_middle": FIM_ORACLE,
    }
