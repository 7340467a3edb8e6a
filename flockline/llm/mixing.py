"""Mixing sources to target weights: capped water-filling over sources, seeded repetitions of documents.

Native: DataFrame and SQL functions only.

Every source asks for weight * level words and is clamped at `max_epochs` times its size; what
clamped sources leave goes to the others in proportion to their weights until none is above its
cap.  With the sources ordered by cap / weight, the clamped ones come first, so one running sum
over the small table of sources finds the level.

Documents of a source are put in a seeded order (md5 of seed and id).  Each is taken whole as many
times as the target holds the source, and what remains of the target is taken once more from the
front of the order; the last document of that front gives the words that are still missing.  The
running sum is taken by buckets of the digest: sums by bucket first, then within a bucket, so a
source with a third of all rows is never in one task.  The buckets follow the number of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._session import cut

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a source in a bucket of the digest, about and at most; 16**3 buckets at least.
BUCKET_ROWS, DIGITS = 100_000, 3


def digits(rows: int) -> int:
    """How many hexadecimal digits of the digest name a bucket."""
    n = DIGITS
    while rows > BUCKET_ROWS * 16**n:
        n += 1
    return n


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with each source's weight and target.

    Sources by code point, null last, take the weights in turn.  The table has a row a source.
    """
    # UTF-8 bytes sort as code points do; the prefix puts null last
    ranked = sizes.withColumn("nth", F.row_number().over(W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    asked = ranked.withColumn("weight", weight.cast("long")).withColumn("cap", max_epochs * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "nth")
    everything = W.partitionBy()
    # were all sources before this one clamped and no other, the level would be this
    before = order.rowsBetween(W.unboundedPreceding, -1)
    tried = asked.withColumn("whole", F.sum("source_size").over(everything)).withColumn(
        "level",
        (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    # the first source that its level does not clamp sets the level of all
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("nth"), F.col("level")))).over(everything)["level"]
    set_ = tried.withColumn("level", level)
    return set_.select("source", "nth", "weight", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of each document.

    Defined cases: null text has size 0; null is a source of its own, last in order; a null doc_id
    orders after all others of its source; rows that share a doc_id share a place in the order and
    follow each other by size; sources without words get target 0; an empty table gives an empty
    result; other columns of docs are ignored, whatever their names.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    slim = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), digest.alias("d")))
    slim = slim.withColumn("bucket", F.substring("d", 1, digits(slim.count())))
    sums = slim.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    goal = goal.withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("words") - F.col("times") * F.col("source_size")).drop("nth", "weight", "words")
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    start = sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))  # noqa: E731  null meets null
    plan = start.join(goal.withColumn("k", key("source")).drop("source"), key("source") == F.col("k")).select("k", "bucket", "start", "source_size", "target", "times", "rest")
    rows = slim.withColumn("k", key("source")).join(plan, ["k", "bucket"])
    inside = W.partitionBy("k", "bucket").orderBy("d", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    ahead = F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - ahead))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("times") * F.col("size") + more).cast("long").alias("taken"))


#: The same in DuckDB, without the buckets, for the seed and weights above.
SQL = r"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix-1' || coalesce(doc_id::VARCHAR, 'null')) AS d FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM t),
w AS (SELECT *, [5, 2, 1][(nth % 3 + 1)::INT] AS weight, 3 * source_size AS cap FROM n),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS lev
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT lev FROM l WHERE lev * weight <= cap ORDER BY cap::DOUBLE / weight, nth LIMIT 1)) AS target FROM l),
h AS (
  SELECT *, floor(target + 0.5)::BIGINT AS words, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END AS times FROM g),
o AS (
  SELECT s.*, h.source_size, h.target, h.times, h.words - h.times * h.source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY d, s.doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM s JOIN h ON s.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, source, size, source_size, target, (times * size + greatest(0, least(size, rest - ahead)))::BIGINT AS taken FROM o
"""
