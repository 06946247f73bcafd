"""A training corpus from raw documents, in five stages that write tables.

Every stage takes what its predecessor kept. All but the last return the columns
of documents; the last returns token ids and the text decoded from them.

In every stage an empty table gives an empty one, other columns are carried along
whatever their names, and repeated rows are rows of their own: where ids are null or
repeat, rows are numbered, so a decision about one row never takes another with it.
Null texts count as empty: not toxic, rejected by the rules. Null languages and sources
are a language and a source of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import join_checked, materialize, table
from tidewell.llm.mixing import mix_sources
from tidewell.llm.near_dup import near_duplicates
from tidewell.llm.piece_bpe import round_trip_digests
from tidewell.llm.quality_rules import quality_rules
from tidewell.llm.toxicity import ToxicityModel

#: Documents of this toxicity score or more go.
MOST_TOXIC = 0.3


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and a column that tells its rows apart: doc_id, unless ids are missing or repeat; then rows are numbered."""
    counts = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if counts.where((F.col("n") > 1) | F.col("doc_id").isNull()).isEmpty():
        return docs, "doc_id"
    name = "_row"
    while name in docs.columns:
        name += "_"
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "stage-rows"), name


def _without(docs: DataFrame, key: str, rejected: DataFrame) -> DataFrame:
    """The rows of docs whose key isn't among the doc_ids of rejected."""
    gone = materialize(rejected.select(F.col("doc_id").alias(key)), "stage-rejected")
    kept = join_checked(docs, gone, [key], "left_anti")
    return kept if key == "doc_id" else kept.drop(key)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose toxicity score is MOST_TOXIC or more. Weights are learned from the labels of docs."""
    model = ToxicityModel(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    docs, key = _keyed(docs)
    scores = model.score(docs.select(F.col(key).alias("doc_id"), "text"))
    return _without(docs, key, scores.where(F.col("score") >= MOST_TOXIC))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the quality rules or the perplexity bands reject."""
    docs, key = _keyed(docs)
    return _without(docs, key, quality_rules(docs.select(F.col(key).alias("doc_id"), "lang", "text")).where(~F.col("kept")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest id, or where rows are numbered the first."""
    docs, key = _keyed(docs)
    return _without(docs, key, near_duplicates(docs, id_col=key).where(~F.col("kept")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    mixed = mix_sources(docs).where(F.col("copies") > 0)
    again = F.array_repeat(F.struct(*docs.columns), F.col("copies").cast("int"))  # at most three copies
    return mixed.select(F.explode(again).alias("row")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the ids, and digests of the ids and of the text decoded from them."""
    import public_tokenizers

    return round_trip_digests(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("quality rules", apply_rules),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("encoding", encode),
]

#: Perplexity bands and the toxicity grammar can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{i}")
    return docs
