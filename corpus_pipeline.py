"""Training-data pipeline over ``documents``: filter, deduplicate, mix, encode.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns the rows it keeps with the columns of its input, the last one the
encoded documents. Every stage works on all rows its predecessor kept; its
result is written as Parquet in the shared folder and read back.

Rows without ``doc_id`` are treated like others; a near-duplicate group keeps
one of them only where it has no row with an id. A repeated ``doc_id`` is no
reason to drop a row: rows are told apart by a key, and only copies of a text go. An empty table gives an
empty result; further columns of ``documents`` pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rowsift.functions.names import free_name
from rowsift.llm import bpe_tree, gray_index, line_crf, mixing
from rowsift.llm.common import staged
from rowsift.llm.queries import MIX, MIX_SEED, MIX_SWEEPS, bpe_files, table

#: Expected share of the tokens that the mix keeps.
RATE = 0.8
#: Keys of dropped rows are sent to all executors up to this size (measured).
BROADCAST_BYTES = 16 << 20
#: Parts in which a near-duplicate group meets its first row.
SALTS = 32


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the base rules or the line labels reject."""
    weights = line_crf.train_on_labels(docs, table(spark, sf_dir, "labels"))
    return line_crf.judge_lines(docs, weights, keep_columns=True)


def _with_row_key(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a key per row: file and place in it, as Parquet states them; other input is written once."""
    key = free_name("row_key", docs.columns)
    try:
        keyed = docs.withColumn(key, F.concat_ws(":", "_metadata.file_path", "_metadata.row_index"))
        keyed.schema  # noqa: B018 - resolves the hidden columns now
        return keyed, key
    except AnalysisException:  # not read from Parquet files
        return staged(docs.withColumn(key, F.monotonically_increasing_id().cast("string")), "keyed"), key


def simhash_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: smallest id (rows without id last), then first row key."""
    keyed, key = _with_row_key(docs)
    groups = gray_index.near_duplicates(keyed, shingle=3, distance=3, row_key=key)
    rank = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")
    first = (groups.groupBy("component").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("component", F.col("first.row_key").alias("own")))
    # a group of thousands of copies is met in many parts
    salt = F.pmod(F.xxhash64("row_key"), F.lit(SALTS)).cast("int")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dropped = staged(groups.withColumn("salt", salt).join(first, ["component", "salt"]).where(F.col("row_key") != F.col("own"))
                     .select(F.col("row_key").alias(key)), "dropped")
    size = dropped.agg(F.coalesce(F.sum(F.octet_length(key) + 48), F.lit(0))).first()[0]
    return keyed.join(F.broadcast(dropped) if size <= BROADCAST_BYTES else dropped, key, "left_anti").drop(key)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and topics meet their targets in BPE tokens."""
    count, topic = free_name("mix_tokens", docs.columns), free_name("mix_topic", docs.columns)
    # texts are encoded and looked at once; cells are summed from the two new columns alone
    counted = staged(bpe_tree.count_tokens(docs, count, **bpe_files()).withColumn(topic, mixing.form()), "counted")
    return mixing.mix(counted, MIX, rate=RATE, seed=MIX_SEED, sweeps=MIX_SWEEPS, tokens=F.col(count), topic=F.col(topic),
                      keep_columns=True).drop(count, topic)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text; ids, their number and digests, and the digest of the decoded bytes."""
    return bpe_tree.token_digests(docs, with_ids=True, **bpe_files())


STAGES = [
    ("quality rules", quality_rules),
    ("simhash near-duplicates", simhash_groups),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: SQL cannot state line labels, fingerprints or merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
