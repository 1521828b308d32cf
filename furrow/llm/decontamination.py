"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Tokens are the runs of letters and digits of the lower-cased text. A stretch is STRETCH (13) consecutive tokens. A document holds
a passage of an item when one of its stretches differs from one of the item's in at most SUBSTITUTIONS (2) tokens, place by place.

Masks: mask r of SUBSTITUTIONS + 1 looks at the places p with p mod 3 = r and ignores the others. Two substitutions spoil
two masks at most, so one of the three seeds of such a pair of stretches is always equal and the join on seeds misses nothing.
Each hit is verified over all places of the stretch, those ignored by its mask too; both stretches are in the joined row, so
no text is fetched again and documents are never shuffled.

Items of SHORTEST to 12 tokens are matched whole, without substitutions; still shorter ones would match ordinary prose and are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.frames import table

STRETCH = 13
SUBSTITUTIONS = 2
SHORTEST = 5
#: Up to so many seeds (24 bytes each, and their stretches) the benchmark side is broadcast; beyond, both sides are shuffled.
BROADCAST_SEEDS = 300_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _stretches(docs: DataFrame, key: str) -> DataFrame:
    """(key, t0..t12): the hash of the token at each place and of the twelve that follow it; null beyond the end."""
    hashed = docs.select(F.col(key).cast("long").alias("key"), F.transform(tokens(F.col("text")), lambda t: F.xxhash64(t)).alias("h"))
    moved = [F.slice("h", k + 1, F.greatest(F.size("h") - k, F.lit(0))) for k in range(STRETCH)]
    return hashed.select("key", F.size("h").alias("length"), F.inline(F.arrays_zip(*moved))).toDF("key", "length", *_places())


def _places() -> list[str]:
    return [f"t{k}" for k in range(STRETCH)]


def _seeds(frame: DataFrame, short: list[int]) -> DataFrame:
    """A row for each seed of each stretch: (…, kind, seed). kind is the mask's number, or minus the length of a short item."""
    kinds = [(r, [k for k in range(STRETCH) if k % (SUBSTITUTIONS + 1) == r], STRETCH) for r in range(SUBSTITUTIONS + 1)] + [(-n, list(range(n)), n) for n in short]
    seeds = F.array(*[F.when(F.col(f"t{n - 1}").isNotNull(), F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), *[f"t{k}" for k in places]).alias("seed"))) for kind, places, n in kinds])
    return frame.select("*", F.explode(seeds).alias("s")).filter("s is not null").select(*frame.columns, "s.kind", "s.seed")


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_stretches, substitutions): for each document that holds a passage of an item, how many pairs of their
    stretches (of whole short items) are alike, and the fewest substituted tokens among these.

    Null or empty texts hold nothing. Rows that repeat a doc_id (or have none) are counted together, as are rows that repeat an
    item_id; tokens are told apart by 64-bit hashes. Other columns are ignored.
    """
    wanted = _stretches(items, "item_id")
    short = sorted(r.n for r in items.select(F.size(tokens(F.col("text"))).alias("n")).filter(F.col("n").between(SHORTEST, STRETCH - 1)).distinct().collect())
    seeds = _seeds(wanted, short).filter(reduce(lambda a, n: a | ((F.col("kind") == -n) & (F.col("length") == n)), short, F.col("kind") >= 0))
    seeds = seeds.select(F.col("key").alias("item_id"), *[F.col(p).alias(f"i{p}") for p in _places()], "kind", "seed")
    bounded = seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS
    hits = _seeds(_stretches(docs, "doc_id"), short).join(F.broadcast(seeds) if bounded else seeds, ["kind", "seed"])
    differ = reduce(lambda a, b: a + b, [F.when(F.col(p) == F.col(f"i{p}"), 0).otherwise(1) for p in _places()])
    exact = reduce(lambda a, b: a & b, [F.col(f"i{p}").isNull() | (F.col(p) == F.col(f"i{p}")) for p in _places()])
    verified = hits.withColumn("differ", F.when(F.col("kind") >= 0, differ).otherwise(F.when(exact, 0))) \
        .filter(F.col("differ") <= SUBSTITUTIONS)
    # A pair of stretches counts once: by the first mask that has no substitution among its places.
    clean = [reduce(lambda a, b: a & b, [F.col(f"t{k}") == F.col(f"it{k}") for k in range(r, STRETCH, SUBSTITUTIONS + 1)]) for r in range(SUBSTITUTIONS + 1)]
    by = reduce(lambda rest, r: F.when(clean[r], r).otherwise(rest), reversed(range(SUBSTITUTIONS)), F.lit(SUBSTITUTIONS))
    counted = verified.filter((F.col("kind") < 0) | (F.col("kind") == by))
    return counted.groupBy(F.col("key").alias("doc_id"), "item_id").agg(F.count("*").alias("n_stretches"), F.min("differ").alias("substitutions"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Pairs of stretches that agree in one third of their places are compared place by place.
SQL = r"""
WITH d AS (SELECT doc_id AS key, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
     i AS (SELECT item_id AS key, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
     dp AS (SELECT key, p, w[p:p + 12] AS s FROM (SELECT key, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
     ip AS (SELECT key, p, w[p:p + 12] AS s FROM (SELECT key, w, unnest(range(1, len(w) - 11)) AS p FROM i)),
     dm AS (SELECT key, p, s, m, list_transform(range(m + 1, 14, 3), lambda k: s[k]) AS seed FROM dp, (VALUES (0), (1), (2)) v(m)),
     im AS (SELECT key, p, s, m, list_transform(range(m + 1, 14, 3), lambda k: s[k]) AS seed FROM ip, (VALUES (0), (1), (2)) v(m)),
     pairs AS (SELECT DISTINCT dm.key AS doc_id, dm.p AS dp, im.key AS item_id, im.p AS ip,
                      len(list_filter(range(1, 14), lambda k: dm.s[k] <> im.s[k])) AS differ
               FROM dm JOIN im ON dm.m = im.m AND dm.seed = im.seed),
     short AS (SELECT key, w FROM i WHERE len(w) BETWEEN 5 AND 12),
     whole AS (SELECT d.key AS doc_id, short.key AS item_id, 0 AS differ
               FROM short, d, unnest(range(1, len(d.w) - len(short.w) + 2)) AS t(p)
               WHERE d.w[t.p:t.p + len(short.w) - 1] = short.w),
     alike AS (SELECT doc_id, item_id, differ FROM pairs WHERE differ <= 2 UNION ALL SELECT doc_id, item_id, differ FROM whole)
SELECT doc_id, item_id, count(*) AS n_stretches, CAST(min(differ) AS INTEGER) AS substitutions FROM alike GROUP BY ALL
"""

QUERIES = {"op4_benchmark_decontamination": op4_benchmark_decontamination}
ORACLES = {"op4_benchmark_decontamination": SQL}
