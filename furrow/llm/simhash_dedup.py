"""SimHash near-dedup with a byte-position inverted index and count filtering.

A fingerprint is eight bytes. Two that differ in at most DISTANCE (2) bits differ in at most two bytes, so they agree in six byte
positions or more: that is the guaranteed minimum. The index lists fingerprints by the values at four byte positions. Its six
position sets are the unions of two out of the four adjacent position pairs; whichever two positions differ, one set avoids both, so no
pair is missed. Each candidate pair's agreeing positions are tallied, pairs below the minimum fall away, the rest are verified
by their differing bits.

A list longer than LIST_ROWS (near copies of one text with many fingerprints) would give pairs by the square. Its fingerprints are
linked another way, as exact: two fingerprints are within two bits when both are within one bit of a third value, and at most
65 fingerprints are that close to a value. They are grouped by these values and linked to the least of the group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.components import components
from furrow.llm.frames import stored, table, text_batches
from furrow.llm.words import LOWER, slices, spaced, words_of

SHINGLE = 3
DISTANCE = 2
SEED = 42
LIST_ROWS = 64
BYTES = 8
POSITION_SETS = [a + b for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]


def fingerprints_of(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """One fingerprint for each text."""
    words = words_of(LOWER[data], bounds)
    joined, begin, end = spaced(words)
    joined = joined.tobytes()
    count = np.diff(words.first)
    full = np.flatnonzero(words.text[shingle - 1:] == words.text[:len(words.text) - shingle + 1]) if len(words.text) >= shingle else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    a = np.concatenate([begin[full], begin[words.first[short]]])
    b = np.concatenate([end[full + shingle - 1], end[words.first[short + 1] - 1]])
    text = np.concatenate([words.text[full], short])
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(joined[i:j], SEED) for i, j in zip(a.tolist(), b.tolist())), dtype=np.uint64, count=len(a))
    order = np.argsort(text, kind="stable") if len(short) else slice(None)
    values, text = values[order], text[order]
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    n = np.bincount(text, minlength=len(count))
    some = np.flatnonzero(n)
    out = np.zeros((len(count), 64), dtype=np.uint8)
    if len(some):
        set_ = np.add.reduceat(bits, np.searchsorted(text, some), axis=0, dtype=np.int64)
        out[some] = 2 * set_ > n[some][:, None]
    return np.packbits(out, axis=1).view(">u8").ravel().astype(np.uint64)


def _fingerprint_rows(shingle: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, bounds in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints_of(data, bounds, shingle).view(np.int64))], names=["doc_id", "print"])
    return rows


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, print) for each row; a null text or one without words has fingerprint zero."""
    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(_fingerprint_rows(shingle), "doc_id long, print long")


def _mask(positions: tuple[int, ...]) -> Column:
    value = sum(0xFF << 8 * (BYTES - 1 - p) for p in positions)
    return F.lit(value - (1 << 64) if value >> 63 else value).cast("long")


def _agreeing_positions(a: str, b: str) -> Column:
    same = [(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 8 * p).bitwiseAND(F.lit(0xFF)) == 0).cast("int") for p in range(BYTES)]
    return reduce(lambda x, y: x + y, same)


def links(prints: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Edges (u, v) that connect any two different fingerprints of the column `print` that differ in two bits or fewer.

    Pairs out of lists of up to `list_rows` are all there; longer lists give links to the least near member instead of pairs.
    """
    index = prints.select("print", F.explode(F.array(*[F.struct(F.lit(k).alias("set"), F.col("print").bitwiseAND(_mask(p)).alias("key")) for k, p in enumerate(POSITION_SETS)])).alias("at")) \
        .select("print", "at.set", "at.key")
    sizes = index.groupBy("set", "key").agg(F.count("*").alias("rows")).filter("rows > 1")
    lists = index.join(sizes, ["set", "key"])
    short = lists.filter(F.col("rows") <= list_rows)
    least = BYTES - DISTANCE
    pairs = short.select("set", "key", F.col("print").alias("u")).join(short.select("set", "key", F.col("print").alias("v")), ["set", "key"]) \
        .filter("u < v").filter(_agreeing_positions("u", "v") >= least) \
        .filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= DISTANCE).select("u", "v")
    crowded = lists.filter(F.col("rows") > list_rows).select("print").distinct()
    one_bit = F.array(F.col("print"), *[F.col("print").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(64)])
    near = crowded.select("print", F.explode(one_bit).alias("value")).groupBy("value").agg(F.collect_list("print").alias("close")).filter(F.size("close") > 1)
    stars = near.select(F.array_min("close").alias("u"), F.explode("close").alias("v")).filter("u != v")
    return pairs.union(stars)


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Fingerprints at two differing bits or fewer are linked; equal ones are one node, so copies cost nothing. Texts without words
    share fingerprint zero and are linked like others. Rows that repeat a doc_id each give a row; a row without a doc_id gets its
    component's smallest one, null if it has none. Other columns are ignored.
    """
    prints = stored(fingerprints(docs, shingle))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(nodes.select("print"), list_rows))
    rooted = nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "first_id", F.coalesce("root", "print").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(lowest, "root").select("print", "component_id")
    return prints.join(classes, "print").select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_dedup": op2_simhash_dedup}
#: DuckDB has no XXH64; tests hold fingerprints, links and components against brute force.
ORACLES: dict[str, str] = {}
