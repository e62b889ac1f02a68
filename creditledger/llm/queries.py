"""One query per operator over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creditledger.llm import sql, toxicity
from creditledger.llm.common import importable, shared_folder
from creditledger.llm.decontaminate import benchmark_hits, is_contaminated
from creditledger.llm.exact import exact_groups
from creditledger.llm.language import held_out, identify
from creditledger.llm.minhash import near_groups
from creditledger.llm.packing import pack
from creditledger.llm.pii import replace
from creditledger.llm.quality import judge
from creditledger.llm.simhash import simhash_groups
from creditledger.llm.suffix_dedup import cut_repeats
from creditledger.llm.variants import spelling_variants
from creditledger.llm.warc import read_archive, write_archive
from creditledger.llm.whitening import whiten


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: A user sets a secret of their own; with this one results can be repeated.
PII_KEY = b"creditledger public key"


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(_table(spark, sf_dir, "documents"), PII_KEY)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held = held_out(F.col("doc_id"), 3, 1)
    known = labels.select("doc_id", F.col("toxic").alias("label")).filter(~held)
    scored = toxicity.predict(docs, toxicity.train(docs, known))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc"
    manifest = write_archive(_table(spark, sf_dir, "pages"), folder)
    return read_archive(manifest, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").filter("quality = 1")
    return judge(_table(spark, sf_dir, "documents"), trusted)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(_table(spark, sf_dir, "documents"), tokenizer_file())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "n_loss"
    )


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null here; the operator has it as a decimal."""
    rows = whiten(_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": op1_pii_surrogates,
    "op2_language_id": op2_language_id,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_quality": op6_quality,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_near_dedup": op9_near_dedup,
    "op10_packing": op10_packing,
    "op11_simhash": op11_simhash,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op5_warc": sql.WARC,
    "op7_exact_dedup": sql.EXACT_DEDUP,
    "op8_decontamination": sql.DECONTAMINATION,
    "op9_near_dedup": sql.NEAR_DEDUP,
    "op12_spelling_variants": sql.VARIANTS,
}
