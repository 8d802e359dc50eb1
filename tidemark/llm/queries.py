"""One query per operator, over its whole table and with production parameters.

The queries return the digest columns of their contracts; the operators return
more, and write files where that is their purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import licences, link_trust, mixing, near_dedup, sharding
from tidemark.llm.byte_lang import identify_languages
from tidemark.llm.decontaminate import benchmark_matches
from tidemark.llm.line_crf import judge_quality
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.scratch import Scratch
from tidemark.llm.token_store import read_tokens, write_tokens
from tidemark.llm.toxicity import score_severity

#: (verdict, host, path)
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
END_ID = 1


def tokenizer_path() -> str:
    """The vocabulary file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_url_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on every page's URL."""
    judged = link_trust.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def token_digest(docs: DataFrame) -> DataFrame:
    """Writes a token store of ``docs`` to the shared folder and reads its digest back from the files."""
    root = Scratch(docs.sparkSession, "tokens").root
    write_tokens(docs, root, tokenizer=tokenizer_path(), end_id=END_ID)
    return read_tokens(docs.sparkSession, root, with_ids=False)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written and read back."""
    return token_digest(_table(spark, sf_dir, "documents"))


def op4_benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that occur in documents."""
    return benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes from every document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences that documents state."""
    return licences.scan_licences(_table(spark, sf_dir, "documents"))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 and slots of all documents."""
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=16)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    return score_severity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict on every document."""
    return judge_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify_languages(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_url_link_trust,
        op3_token_store,
        op4_benchmark_matches,
        op5_mix_sources,
        op6_licence_rules,
        op7_jump_shards,
        op8_toxicity,
        op9_line_crf,
        op10_byte_cnn,
    )
}

#: The others hang on hashes, models or files that SQL has not; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": near_dedup.oracle(),
    "op2_url_link_trust": link_trust.oracle(URL_RULES),
    "op5_mix_sources": mixing.oracle(),
    "op6_licence_rules": licences.oracle(),
    "op7_jump_shards": sharding.oracle(16),
}
