"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Each document gets a random-looking key from its id. Within a source, documents in key order are what the mix takes until
the source's budget of words is used up; a budget above the source's words starts over from the first document.

The order is a range sort: as keys are uniform, even ranges of the key hold even shares of a source, so a source of any size is dealt
into ranges of about RANGE_ROWS documents without a look at the keys. Sums of the ranges, run up within each source, are the
offsets of running sums inside each range; no task sees a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.frames import stored, table

WEIGHTS = (3, 1, 2)
SHARE_PERCENT = 150
EPOCHS = 2
RANGE_ROWS = 4_000
KEY_BITS = 60


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) to the same with place, target and budget (the target in whole words).

    Sources go by code point, null last, and weigh `weights` in turn. A level is sought at which all targets
    min(epochs * source_size, level * weight) add up to the share: sources by the level where they are full, the first that isn't
    full at its own level tells it. One row per source meets in one task here, and nothing else.
    """
    everyone = Window.partitionBy(F.lit(0))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.partitionBy(F.lit(0)).orderBy("full_at", "place")
    weighed = totals.withColumn("place", F.row_number().over(ordered)) \
        .withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))) \
        .withColumn("cap", epochs * F.col("source_size")) \
        .withColumn("full_at", F.col("cap") / F.col("weight")) \
        .withColumn("wanted", share_percent * F.sum("source_size").over(everyone) / 100) \
        .withColumn("full", F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) \
        .withColumn("open", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))) \
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open")) \
        .withColumn("level", F.coalesce(F.min_by("level", F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place"))).over(everyone), F.max("full_at").over(everyone)))
    return weighed.withColumn("target", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))) \
        .select("source", "source_size", "place", "target", F.floor(F.col("target") + 0.5).cast("long").alias("budget"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per row of docs: doc_id, source, size (words), source_size, target (of its source) and taken (words the mix takes, repeats counted).

    A null text has size 0; a null source is a source. The last document taken may be cut, so that each source gives its budget
    exactly; none gives more than `epochs` times its size. Equal ids have equal keys and go by size, so repeated rows are
    taken one after another; rows without an id share one key. The result depends on the rows only. Other columns are ignored.
    """
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                              F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key")))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    shares = targets(totals.select("source", "source_size"), weights, share_percent, epochs)
    of = stored(shares.join(totals.select(F.col("source").alias("s"), F.ceil(F.col("n") / range_rows).alias("ranges")), F.col("source").eqNullSafe(F.col("s")))
                .select("s", "source_size", "place", "target", "budget", "ranges"))
    dealt = rows.join(of, F.col("source").eqNullSafe(F.col("s"))) \
        .withColumn("range", F.shiftright(F.shiftright("key", KEY_BITS - 30) * F.col("ranges"), 30))
    ends = Window.partitionBy("place").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("place", "range").agg(F.sum("size").alias("sum")) \
        .select(F.col("place").alias("p"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(ends), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("place", "range").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))) \
        .join(offsets, (F.col("place") == F.col("p")) & (F.col("range") == F.col("r"))) \
        .withColumn("ahead", F.col("ahead") + F.col("offset"))
    taken = sum(F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - e * F.col("source_size") - F.col("ahead"))) for e in range(epochs))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
                  CAST('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS BIGINT) AS key FROM documents),
     t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
     w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM t),
     c AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM w),
     l AS (SELECT *, cap / weight AS full_at, 150 * sum(source_size) OVER () / 100 AS wanted FROM c),
     v AS (SELECT *, (wanted - coalesce(sum(cap) OVER (ORDER BY full_at, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY full_at, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l),
     g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM v WHERE level <= full_at ORDER BY full_at, place LIMIT 1), max(full_at) OVER ()) * weight) AS target FROM v),
     o AS (SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS budget,
                  coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS ahead
           FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(greatest(0, least(size, budget - ahead)) + greatest(0, least(size, budget - source_size - ahead)) AS BIGINT) AS taken
FROM o
"""

QUERIES = {"op6_source_mix": op6_source_mix}
ORACLES = {"op6_source_mix": SQL}
