"""The trie of conversation prefixes by ROLLUP over positional turn-id columns, block after block.

A turn's id is the MD5 of its role and text, beside the text's length, so texts are read once and never shuffled. A conversation is dealt
into blocks of BLOCK positions, one row and BLOCK id columns each. A block's key is the node at which the block before it ends, named by
two 64-bit XORs of hashes of (position, id) over all positions before the block. One statement then groups all blocks of all conversations:

    GROUP BY block, key1, key2, ROLLUP(t1, ..., t8)

grouping_id() tells the depth of each group; a group whose last id isn't null is a node. No step is repeated for deeper blocks, so a
conversation of any length takes the same plan, and hot prefixes are combined before the shuffle.

What a whole subtree adds up to needs no walk over it. Every node is owned by its smallest member, so the nodes that one conversation owns are the
end of its path. With total(c) the code points of c and own(c) those of the nodes it owns, a node v with n members, smallest member o and P code points
above it has the subtree sum of (members - 1) * length = sum(total) - n * P - (sum(own) - own(o) + total(o) - P). Leaves are counted at the conversations
that own them. A second ROLLUP over the same blocks adds these up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.frames import stored, table

BLOCK = 8
#: Positions, and blocks, in one piece of a conversation. Longer ones are ordered and summed piece by piece.
PIECE_BITS = 12
LENT = 6
FAMILY = 100


def turn_id(role: Column, text: Column) -> Column:
    """Role and text as one id that ends in the text's length."""
    return F.concat(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)), F.lit(":"), F.length(text).cast("string"))


def _length(id: Column) -> Column:
    return F.substring(id, 34, 20).cast("long")


def _hashes(position: Column, id: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), position.cast("long"), id) for seed in (1, 2)]


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, position from 1, id), (conv_id, n)) of all turns by turn, null turns first; equal turns go by id.

    The order is found within pieces of a conversation (runs of turn numbers; null turns by the beginning of their id), whose counts are then run up.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), turn_id(role, text).alias("id"))
    first = F.conv(F.substring("id", 1, 3), 16, 10).cast("long") - (1 << 60)
    rows = stored(rows.withColumn("piece", F.when(F.col("turn").isNull(), first).otherwise(F.shiftright("turn", PIECE_BITS))))
    pieces = rows.groupBy("conv_id", "piece").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "id")
    placed = rows.withColumn("at", F.row_number().over(inside)) \
        .join(starts, (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p"))) \
        .select("conv_id", (F.col("start") + F.col("at")).alias("position"), "id")
    return placed, pieces.groupBy("conv_id").agg(F.sum("rows").alias("n"))


def rebuilt(placed: DataFrame, sizes: DataFrame, lent: int = LENT, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """((conv_id, position, id) of the rebuilt conversations, (conv_id) of all of them, also the turnless).

    Each conversation c starts with the first h = crc32(c) % lent turns of conversation c - c % family; after its own first h turns it goes on as it was.
    """
    head = F.crc32(F.col("conv_id").cast("string")) % lent
    convs = sizes.select("conv_id", head.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    # At most `family` conversations share a base, and under `lent` of its turns are wanted.
    firsts = placed.filter((F.col("conv_id") % family == 0) & (F.col("position") < lent)).select(F.col("conv_id").alias("base"), "position", "id")
    given = convs.join(firsts, "base").filter("position <= h").select("conv_id", "position", "id")
    short = convs.filter("h > 0").join(sizes.select(F.col("conv_id").alias("base"), "n"), "base", "left") \
        .select(F.col("conv_id").alias("c"), (F.col("h") - F.coalesce("n", F.lit(0))).alias("missing")).filter("missing > 0")
    own = placed.withColumn("h", head).filter("position > h").join(short, F.col("conv_id") == F.col("c"), "left") \
        .select("conv_id", (F.col("position") - F.coalesce("missing", F.lit(0))).alias("position"), "id")
    return given.union(own), sizes.select("conv_id")


def blocks_of(positions: DataFrame) -> DataFrame:
    """(conv_id, block, t1..t8, x1, x2, size; key1, key2, above): a block's ids, XORs and code points, and those of all positions before it."""
    block, slot = F.floor((F.col("position") - 1) / BLOCK).cast("long"), F.pmod(F.col("position") - 1, F.lit(BLOCK))
    one, two = _hashes(F.col("position"), F.col("id"))
    rows = positions.groupBy("conv_id", block.alias("block")).agg(
        *[F.max(F.when(slot == k, F.col("id"))).alias(f"t{k + 1}") for k in range(BLOCK)],
        F.bit_xor(one).alias("x1"), F.bit_xor(two).alias("x2"), F.sum(_length(F.col("id"))).alias("size"))
    rows = rows.withColumn("piece", F.shiftright("block", PIECE_BITS))
    inside = Window.partitionBy("conv_id", "piece").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"key1": (F.bit_xor, "x1"), "key2": (F.bit_xor, "x2"), "above": (F.sum, "size")}
    rows = rows.select("*", *[F.coalesce(how(of).over(inside), F.lit(0)).alias(name) for name, (how, of) in sums.items()])
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = rows.groupBy("conv_id", "piece").agg(*[how(of).alias(of) for how, of in sums.values()]) \
        .select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), *[how(of).over(earlier).alias(f"_{name}") for name, (how, of) in sums.items()]).filter("p > 0")
    joined = rows.join(pieces, (F.col("conv_id") == F.col("c")) & (F.col("piece") == F.col("p")), "left")
    both = {name: F.col(name) + F.coalesce(f"_{name}", F.lit(0)) if name == "above" else F.col(name).bitwiseXOR(F.coalesce(f"_{name}", F.lit(0))) for name in sums}
    return joined.select("conv_id", "block", *[f"t{k + 1}" for k in range(BLOCK)], "x1", "x2", "size", *[c.alias(name) for name, c in both.items()])


def rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """Per node: depth, key1, key2, up1, up2 (the parent's key), size (code points of its last text), above (those before it) and the measures."""
    names = ", ".join(f"t{k + 1}" for k in range(BLOCK))
    groups = blocks.sparkSession.sql(
        f"SELECT block, key1, key2, {names}, {BLOCK} - bit_count(grouping_id()) AS level, max(above) AS above, {measures} "
        f"FROM {{blocks}} GROUP BY block, key1, key2, ROLLUP({names})", blocks=blocks)
    last = F.get(F.array(*[f"t{k + 1}" for k in range(BLOCK)]), F.col("level") - 1)
    nodes = groups.withColumn("last", last).filter("level > 0 and last is not null").withColumn("depth", F.col("block") * BLOCK + F.col("level"))
    up1, up2, above = F.col("key1"), F.col("key2"), F.col("above")
    for k in range(BLOCK - 1):
        inner = (F.col("level") > k + 1) & F.col(f"t{k + 1}").isNotNull()
        one, two = _hashes(F.col("block") * BLOCK + (k + 1), F.col(f"t{k + 1}"))
        up1, up2 = up1.bitwiseXOR(F.when(inner, one).otherwise(0)), up2.bitwiseXOR(F.when(inner, two).otherwise(0))
        above = above + F.when(inner, _length(F.col(f"t{k + 1}"))).otherwise(0)
    nodes = nodes.withColumns({"up1": up1, "up2": up2, "above": above, "size": _length(F.col("last"))})
    one, two = _hashes(F.col("depth"), F.col("last"))
    return nodes.withColumns({"key1": F.col("up1").bitwiseXOR(one), "key2": F.col("up2").bitwiseXOR(two)}).drop("block", "level", "last", *[f"t{k + 1}" for k in range(BLOCK)])


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, key1, key2, n_ends, ends_sha256): SHA-256 of each node's decimal conv_ids, ascending, comma-joined.

    Sorted rows run through one hash state, so a node at which a third of all conversations end takes no memory.
    """
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, n = None, None, 0

        def done() -> tuple:
            return (*key, n, state.hexdigest())
        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            ids = batch.column(3).to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(ids)] if ids else []
            out = []
            for a, b in zip(cuts, cuts[1:]):
                now = tuple(keys[a].tolist())
                if now != key:
                    if key is not None:
                        out.append(done())
                    key, state, n = now, hashlib.sha256(), 0
                state.update((("," if n else "") + ",".join(map(str, ids[a:b]))).encode())
                n += b - a
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in done()], names=names)
    names = ["depth", "key1", "key2", "n_ends", "ends_sha256"]
    by = ["depth", "key1", "key2"]
    return ends.select(*by, "conv_id").repartition(*by).sortWithinPartitions(*by, "conv_id").mapInArrow(digests, "depth long, key1 long, key2 long, n_ends long, ends_sha256 string")


def trie(positions: DataFrame, convs: DataFrame) -> DataFrame:
    """Per node of the trie over (conv_id, position from 1 without gaps, id): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. convs has every conv_id once, also those without a turn, which are members of the root alone.
    """
    blocks = stored(blocks_of(positions))
    ends = stored(convs.join(blocks.groupBy("conv_id").agg(
        F.max(F.col("block") * BLOCK + sum(F.col(f"t{k + 1}").isNotNull().cast("int") for k in range(BLOCK))).alias("depth"),
        F.bit_xor("x1").alias("key1"), F.bit_xor("x2").alias("key2"), F.sum("size").alias("total")), "conv_id", "left").na.fill(0, ["depth", "key1", "key2", "total"]))
    ended = stored(end_digests(ends))
    by = ["depth", "key1", "key2"]
    nodes = stored(rolled(blocks.drop("x1", "x2", "size"), "min(conv_id) AS conv_id, count(*) AS n_convs"))
    leaves = nodes.join(ended, by).filter("n_ends = n_convs").select("conv_id", F.lit(1).alias("leaf"))
    facts = ends.select("conv_id", "total").join(nodes.groupBy("conv_id").agg(F.sum("size").alias("own")), "conv_id", "left") \
        .join(leaves, "conv_id", "left").na.fill(0, ["own", "leaf"])
    facts = stored(facts.select("conv_id", "total", "own", "leaf"))
    sums = "count(*) AS n_convs, sum(leaf) AS n_leaves, sum(total) AS totals, sum(own) AS owned, min(struct(conv_id, own, total)) AS owner"
    inner = rolled(blocks.drop("x1", "x2", "size").join(facts, "conv_id"), sums) \
        .select(*by, "up1", "up2", "n_convs", "n_leaves", F.col("owner.conv_id").alias("conv_id"),
                (F.col("totals") - F.col("n_convs") * F.col("above") - (F.col("owned") - F.col("owner.own") + F.col("owner.total") - F.col("above"))).alias("saved_tokens"))
    root = facts.agg(F.count("*").alias("n_convs"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.min("conv_id").alias("conv_id"), F.sum(F.col("total") - F.col("own")).alias("saved_tokens")) \
        .filter("n_convs > 0").select(*[F.lit(0).cast("long").alias(c) for c in by], *[F.lit(None).cast("long").alias(c) for c in ("up1", "up2")], "n_convs", "n_leaves", "conv_id", "saved_tokens")
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(*by, F.col("conv_id").alias("parent_conv_id")).union(root.select(*by, "conv_id")) \
        .select(*[F.col(c).alias(f"_{c}") for c in by], "parent_conv_id")
    whole = inner.union(root).join(children, by, "left").join(ended, by, "left")
    up = (F.col("depth") - 1 == F.col("_depth")) & (F.col("up1") == F.col("_key1")) & (F.col("up2") == F.col("_key2"))
    return whole.join(parents, up, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations. Null roles and texts are empty; rows without a conv_id belong to no conversation and are left out; an
    empty table gives no row, not even a root. Turns of one number go by their id; repeated rows are turns of their own. Other columns are ignored.
    """
    placed, sizes = ordered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(*rebuilt(stored(placed), stored(sizes)))


#: CRC-32 as a reduction over single bits: a byte is mixed in, then eight shifts.
CRC32 = """list_reduce(list_concat([4294967295], flatten([[ord(substr(CAST(conv_id AS VARCHAR), i, 1)), 0, 0, 0, 0, 0, 0, 0] for i in range(1, length(CAST(conv_id AS VARCHAR)) + 1)])),
       lambda a, x: xor(xor(CAST(a AS BIGINT), CAST(x AS BIGINT)) >> 1, (xor(CAST(a AS BIGINT), CAST(x AS BIGINT)) & 1) * 3988292384))"""

SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
     i AS (SELECT conv_id, turn, md5(length(role) || ':' || role || text) || ':' || length(text) AS id, length(text) AS size FROM t),
     o AS (SELECT conv_id, id, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM i),
     n AS (SELECT conv_id, n, conv_id - conv_id % {FAMILY} AS base, xor(4294967295, {CRC32}) % {LENT} AS h FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY 1)),
     r AS (SELECT n.conv_id, o.pos AS p, o.id, o.size FROM n JOIN o ON o.conv_id = n.base AND o.pos <= n.h
           UNION ALL SELECT o.conv_id, {LENT} + o.pos, o.id, o.size FROM o JOIN n USING (conv_id) WHERE o.pos > n.h),
     l AS (SELECT n.conv_id, list(r.id ORDER BY p) FILTER (r.id IS NOT NULL) AS ids, list(r.size ORDER BY p) FILTER (r.id IS NOT NULL) AS sizes FROM n LEFT JOIN r USING (conv_id) GROUP BY 1),
     m AS MATERIALIZED (SELECT conv_id, coalesce(len(ids), 0) AS n, unnest(range(0, coalesce(len(ids), 0) + 1)) AS d, ids, sizes FROM l),
     g AS MATERIALIZED (SELECT d, coalesce(array_to_string(ids[:d], ' '), '') AS path, any_value(coalesce(array_to_string(ids[:d - 1], ' '), '')) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
                  coalesce(any_value(CASE WHEN d > 0 THEN sizes[d] END), 0) AS size, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
           FROM m GROUP BY 1, 2),
     k AS MATERIALIZED (SELECT g.*, (SELECT count(*) FROM g x WHERE x.d = g.d + 1 AND x.up = g.path) AS n_children FROM g),
     s AS (SELECT a.conv_id, a.d, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.size) AS saved
           FROM k a JOIN k b ON b.d >= a.d AND (b.path = a.path OR a.d = 0 OR starts_with(b.path, a.path || ' ')) GROUP BY 1, 2)
SELECT k.conv_id, k.d AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, k.ends_sha256
FROM k JOIN s ON s.conv_id = k.conv_id AND s.d = k.d LEFT JOIN k u ON k.d > 0 AND u.d = k.d - 1 AND u.path = k.up
"""

QUERIES = {"op12_prefix_trie": op12_prefix_trie}
ORACLES = {"op12_prefix_trie": SQL}
