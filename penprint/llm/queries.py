"""One registered query per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bytecnn import quality_scores
from .decontam import contamination
from .linedup import line_report
from .minhash import near_duplicates
from .packing import byte_pair_encoder, pack_documents
from .perspectives import rotate
from .pii import personal_data_report
from .prefixtrie import prefix_trie
from .quality import quality_report
from .shards import shard_documents
from .urlrules import judge_urls
from .vectordedup import near_duplicate_vectors
from .whitening import whiten

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words_per_shingle=2)


@query
def op2_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


@query
def op3_skip_chain_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_report(_table(spark, sf_dir, "documents"))


@query
def op4_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(_table(spark, sf_dir, "conversations"))


@query
def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_table(spark, sf_dir, "documents"))


def public_encoder():
    """The encoder of the 50k byte-level vocabulary with its one added token; the file is a
    parameter of the query."""
    import public_tokenizers

    return byte_pair_encoder(
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, {"<|endoftext|>": 50256}
    )


@query
def op7_large_item_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_encoder())


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query
def op8_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(_table(spark, sf_dir, "pages"), rules)


@query
def op9_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op10_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(_table(spark, sf_dir, "documents"))


@query
def op11_weighted_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=4)


@query
def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op13_veb_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"), group=100, cuts=6)
