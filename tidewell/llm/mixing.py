"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the
source's target over its size. Those are summed in an order within the source;
one random offset is added; a document is emitted once for each integer that
lies between the sum before it and the sum after it. Only DataFrame functions
are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.llm.common import WORD, materialize, table

#: Weights by the place of a source in code-point order, null last, repeating.
WEIGHTS = (5, 2, 1)
#: A document is taken this many times at most, and so is a source's size.
MOST_COPIES = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources get shares of the total size by weight; a target above most times
    its source's size stops there and the excess is shared again by weight among
    the rest. That ends with min(most * size, level * weight) for one level: with
    sources ordered by most * size / weight, the first k reach their bound, for
    the least k at which the level of the others lies below their bounds. The
    table has one row for each source, so its windows are small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    rows = rows.withColumn("bound", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("bound") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0.0))) / F.sum("weight").over(on))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(everything)["level"], F.lit(0.0))
    target = F.when(F.col("ratio") <= level, F.col("bound")).otherwise(level * F.col("weight"))
    return rows.select("source", "source_size", F.least(target, F.col("bound")).alias("target"))


def _size_class(size: str = "size") -> Column:
    """Eight classes for each power of two, by integer arithmetic."""
    return F.expr(f"cast(8 * length(bin({size})) + shiftright({size} * 8, length(bin({size})) - 1) as int)")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """Rows of docs with size, source_size, target, copies and taken (copies * size).

    docs needs doc_id, text and source; its other columns come back unchanged,
    except that the five named above replace columns of those names. Null text
    has size 0; null is a source of its own, ordered last; a source without
    words has target 0 and none of it is taken. Repeated rows count each on their
    own. An empty table gives an empty result. Reruns agree: the order within a
    source is by size class, a digest of seed, id and text, and id.

    Sums run in three levels (classes of a source, lots of a class, documents of
    a lot), so that no task sorts a source that holds a third of all rows: a class
    of n documents has about sqrt(n) lots of about sqrt(n) documents. Texts are
    shuffled only if the caller uses them.
    """
    own = ("size", "source_size", "target", "copies", "taken")
    base = docs.drop(*own).withColumn("size", n_words(F.col("text"))).withColumn("_class", _size_class())
    base = base.withColumn("_digest", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text"))))
    base = base.withColumn("_draw", F.conv(F.substring("_digest", 1, 8), 16, 10).cast("long"))
    slim = materialize(base.select("source", "size", "_class", "_draw"), "mix-sizes")
    counts = slim.groupBy("source", "_class").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_words"))
    targets = source_targets(counts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most)
    earlier = (Window.unboundedPreceding, -1)
    in_source = Window.partitionBy("source").orderBy("_class").rowsBetween(*earlier)
    in_class = Window.partitionBy("source", "_class").orderBy("_lot").rowsBetween(*earlier)
    in_lot = Window.partitionBy("source", "_class", "_lot").orderBy("_digest", "doc_id")
    classes = counts.select("source", "_class", F.ceil(F.sqrt("_n")).cast("long").alias("_lots"), F.coalesce(F.sum("_n").over(in_source), F.lit(0)).alias("_before_class"))
    classes = classes.withColumnRenamed("source", "_s").withColumnRenamed("_class", "_c")
    targets = targets.withColumnRenamed("source", "_s2")
    plan = classes.join(targets, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2")
    plan = materialize(plan, "mix-classes")  # one row for each source and size class

    def dealt(rows: DataFrame) -> DataFrame:
        met = rows.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")))
        return met.withColumn("_lot", F.col("_draw") % F.col("_lots"))

    lots = dealt(slim).groupBy("source", "_class", "_lot").agg(F.count(F.lit(1)).alias("_n"))
    lots = lots.select(F.col("source").alias("_ls"), F.col("_class").alias("_lc"), F.col("_lot").alias("_ll"), F.coalesce(F.sum("_n").over(in_class), F.lit(0)).alias("_before_lot"))
    rows = dealt(base).withColumn("_place", F.row_number().over(in_lot))
    rows = rows.join(lots, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("_class") == F.col("_lc")) & (F.col("_lot") == F.col("_ll")))
    rank = (F.col("_before_class") + F.col("_before_lot") + F.col("_place")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    named = F.concat_ws(":", F.lit(str(seed)), F.col("source"))
    offset = F.conv(F.substring(F.md5(named), 1, 3), 16, 10).cast("double") / 4096
    crossed = F.floor(offset + rate * rank) - F.floor(offset + rate * (rank - 1))
    rows = rows.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    kept = [c for c in docs.columns if c not in own]
    return rows.select(*kept, *own)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same rows in DuckDB.
OP7_SQL = r"""
WITH base AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(concat_ws(':', '7', doc_id::VARCHAR, text)) AS digest
  FROM documents
), dealt AS (
  SELECT *, (8 * length(bin(size)) + ((size * 8) >> (length(bin(size)) - 1)))::INT AS class, ('0x' || digest[1:8])::BIGINT AS draw FROM base
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM dealt GROUP BY source
), weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS bound FROM sources
), levels AS (
  SELECT *, bound / weight AS ratio,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(bound) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY bound / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), chosen AS (
  SELECT level AS final FROM levels WHERE level <= ratio ORDER BY ratio, source IS NULL, source LIMIT 1
), targets AS (
  SELECT source, source_size, least(bound, CASE WHEN ratio <= final THEN bound ELSE final * weight END) AS target FROM levels, chosen
), lots AS (
  SELECT *, draw % ceil(sqrt(count(*) OVER (PARTITION BY source, class)))::BIGINT AS lot FROM dealt
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY class, lot, digest, doc_id))::DOUBLE AS rank,
         ('0x' || md5(concat_ws(':', '7', source))[1:3])::BIGINT::DOUBLE / 4096 AS start
  FROM lots
)
SELECT doc_id, size, source_size, target,
       (floor(start + (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) * rank)
        - floor(start + (CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END) * (rank - 1)))::BIGINT * size AS taken
FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
"""
