"""Token counts through a digest cache.

Contents are joined by digest to a table of counts that earlier runs stored;
only contents that the table lacks are encoded, each distinct one once, and
their counts are appended. A count belongs to a tokenizer version: the digest
of the tokenizer file and of the library's version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import discard, join_checked, materialize, null_safe_key, scratch_path, table, text_batches, text_slices

#: Rows with a digest that may be broadcast, once counted: 60 MB or so; more are shuffled.
DIGEST_ROWS = 300_000
CACHE_SCHEMA = "version string, digest binary, n_tokens long"

_processors: dict[str, sentencepiece.SentencePieceProcessor] = {}


def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    """One processor per Python worker and file."""
    if path not in _processors:
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


def tokenizer_version(path: str) -> str:
    """Digest of what decides a count besides the content."""
    digest = hashlib.sha256(f"sentencepiece {sentencepiece.__version__}\0".encode())
    with open(path, "rb") as file:
        digest.update(file.read())
    return digest.hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(path)
        for _, texts in text_slices(batches, 0):
            counts = [len(x) for x in sp.encode(texts, num_threads=1)]
            digests = [hashlib.sha256(x.encode()).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs' ids with n_bytes, n_tokens and over_limit (n_tokens > limit).

    Normalised content is the text in UTF-8, null as empty; nothing else is
    folded, since any other change could change the count. Repeated contents
    share one count; repeated rows each give a row. A null id is kept as an id
    of its own. An empty table gives an empty result. Other columns of docs are
    not read, so their names never clash.

    The cache is a Parquet table that is only appended to; counts appended twice
    by runs that overlap are equal, and are read as one.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(content).cast("long").alias("n_bytes"), F.unhex(F.sha2(content, 256)).alias("digest"))

    def cached() -> DataFrame:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("version") == version)
        return stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    def keys(name: str) -> list:
        """What tells texts apart and spreads the rows of a hot id, of no id, and of a hot content."""
        return [*null_safe_key(name), "digest"]

    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    known = materialize(cached(), "counts-known")
    # One row stands for each distinct content that the cache lacks; a hot content is summed before the shuffle.
    wanted = join_checked(materialize(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "counts-distinct"), known.select("digest"), ["digest"], "left_anti", DIGEST_ROWS)
    wanted = materialize(wanted.select(*keys("doc_id")), "counts-wanted")
    texts = docs.select(content.alias("_text"), F.unhex(F.sha2(content, 256)).alias("digest"), *null_safe_key(id_col))
    texts = join_checked(texts, wanted, ["_key_null", "_key", "digest"], "left_semi", DIGEST_ROWS)
    fresh = text_batches(texts.select("_text")).mapInArrow(_encode(tokenizer_path), "digest binary, n_tokens long")
    # A repeated row may stand for its content twice.
    fresh = materialize(fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts-fresh")
    fresh.select(F.lit(version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    every = materialize(known.unionByName(fresh), "counts-all")
    # A join alone in its stage: a hot content's rows can be split among tasks.
    counted = join_checked(keyed, every, ["digest"], "inner", DIGEST_ROWS)
    discard(known, wanted, fresh)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole documents by piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-counts"))
