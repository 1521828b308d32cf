"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of LEAST or more, by SimHash, a byte-position inverted index and count filtering.

A fingerprint has POSITIONS bytes. Each different shingle casts two votes on each bit, so that numbers of votes are even and equal ones go the same way in both texts: at
J = 0.8 a bit then differs with probability 0.1515 or less whatever the number of shingles (one vote: up to 0.19), and a byte agrees with 0.269 or more, that of two unrelated texts with 1/256.
op2's eight bytes and two bits are too few for that. The index lists texts by the bytes at sets of positions. LEVELS has the two indexes: 128 sets of two positions,
which have none in common, and, for lists that are too long, 765 of three. At J = 0.8 linked texts meet in each with 0.9999. A list by one byte would hold 1/256 of all texts.

Pairs that meet are counted over a SKETCH of 16 bytes, which index rows carry: more than SKETCH_BITS differing bits rule them out. Of what is left the agreeing positions of all POSITIONS
are tallied: linked texts have 69 of 256 or more on average, unrelated ones 1; pairs under TALLY fall away. At J = 0.8 the first bound loses 1.3e-6 of the links, the second 1e-8.
Each text has also MARK_WORDS * 64 bits, each the parity of the number of its shingles that fall on it: two texts differ in at least as many shingles as bits, so a pair that differs in more bits than
a link of its sizes may in shingles is ruled out, exactly. The rest is held against the shingles themselves; no link is under LEAST. Equal sets of shingles are one node.

First each text is held against the nearest of the least texts of its lists, and true links give components. Then only what lies in different components is compared: in lists of up to LIST_ROWS
all pairs, in longer ones the least member with the others, and the longer ones' texts go on to the finer index, in whose lists all pairs of different components are compared. So a large group of near
copies costs no pairs by the square; a family of texts that agree in three bytes and still aren't linked costs its square in differing bits. The index is made and read some sets at a time, as it
has hundreds of rows for each text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm.components import components
from furrow.llm.frames import shuffles_removed, stored, text_batches
from furrow.llm.words import LOWER, mix, slices, window_hashes, words_of

SHINGLE = 5
#: The least similarity, as a fraction.
LEAST = (4, 5)
#: Bytes of a fingerprint.
POSITIONS = 256
#: Positions of a set, and sets, of the indexes.
LEVELS = ((2, 128), (3, 765))
#: Linked texts agree in at least so many positions.
TALLY = 32
#: Longs of a fingerprint that index rows carry, and the most bits in which those of linked texts differ.
SKETCH, SKETCH_BITS = 2, 40
#: The index has so many rows for each text at a time, or so many in all if that is more.
PART_SETS, PART_ROWS = 32, 1_500_000
LIST_ROWS = 64
#: Longs of a text's parity bits, a power of two.
MARK_WORDS = 16
#: Beyond so many rows a list of nodes isn't broadcast.
BROADCAST_ROWS = 500_000


#: Votes are added up side by side in fields of two, four and eight bits of a long; so many shingles' two votes fit in four bits, and so many of these sums in eight.
FIELDS = [np.uint64(0x5555555555555555), np.uint64(0x3333333333333333), np.uint64(0x0F0F0F0F0F0F0F0F)]
IN_FOUR, IN_EIGHT = 7, 18


def _runs(first: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of up to `most` begin within texts that begin at `first`, and each text's first run and number of runs."""
    runs = -(-size // most)
    begin = np.cumsum(runs) - runs
    return np.repeat(first, runs) + most * (np.arange(runs.sum()) - np.repeat(begin, runs)), begin, runs


def _vote(values: np.ndarray, k: int) -> np.ndarray:
    """64 bits for each shingle, others for each k."""
    x = values * (mix(np.array([(k + 1) << 20], dtype=np.uint64)) | np.uint64(1))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _position_sets(level: int) -> np.ndarray:
    """A row of positions for each set of a level's index. Each round of sets deals all positions anew, so that a position is in one set of a round at most."""
    size, sets = LEVELS[level]
    deals = []
    for k in range(-(-sets // (POSITIONS // size))):
        order = np.argsort(mix((np.arange(1, POSITIONS + 1, dtype=np.uint64) + np.uint64(level * 100_000 + k * 1_000)) << np.uint64(20)))
        deals.append(order[:POSITIONS // size * size].reshape(-1, size))
    return np.concatenate(deals)[:sets]


def shingles_of(data: np.ndarray, bounds: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, as hashes, and where each text's begin. A text of fewer words is one shingle."""
    words = words_of(LOWER[data], bounds)
    hashes = words.hashes()
    count = np.diff(words.first)
    full = np.flatnonzero(words.text[shingle - 1:] == words.text[:len(words.text) - shingle + 1]) if len(hashes) >= shingle else np.zeros(0, dtype=np.int64)
    short = np.flatnonzero((count > 0) & (count < shingle))
    whole = np.array([window_hashes(hashes[words.first[t]:words.first[t + 1]], count[t])[0] + np.uint64(count[t]) for t in short], dtype=np.uint64)
    values = np.concatenate([window_hashes(hashes, shingle)[full], whole])
    text = np.concatenate([words.text[full], short])
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(len(count) + 1))


def _nodes(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A number for each set of shingles; zero for none."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values), out=total[1:])
    return mix(total[first[1:]] - total[first[:-1]]).view(np.int64)


def prints_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A fingerprint for each text, as longs: a bit is 1 if over half of the votes of the text's shingles set it; zero for a text without shingles."""
    out = np.zeros((len(first) - 1, POSITIONS), dtype=np.uint8)
    size = np.diff(first)
    some = np.flatnonzero(size)
    if not len(some):
        return out.view(np.int64)
    size = size[some]
    fours, begin, runs = _runs(first[some], size, IN_FOUR)
    eights, begin, runs = _runs(begin, runs, IN_EIGHT)
    sums = np.empty((POSITIONS // 8, 8, len(eights)), dtype=np.uint64)
    for k in range(POSITIONS // 8):
        one, two = _vote(values, 2 * k), _vote(values, 2 * k + 1)
        for i in range(2):
            both = (one >> np.uint64(i) & FIELDS[0]) + (two >> np.uint64(i) & FIELDS[0])
            for j in (0, 2):
                four = np.add.reduceat(both >> np.uint64(j) & FIELDS[1], fours)
                for m in (0, 4):
                    sums[k, i + j + m] = np.add.reduceat(four >> np.uint64(m) & FIELDS[2], eights)
    votes = np.add.reduceat(sums.view(np.uint8).reshape(POSITIONS // 8, 8, -1, 8), begin, axis=2, dtype=np.int64)  # by long, bit, text, byte
    bits = (votes > size[:, None]).transpose(2, 0, 3, 1)
    out[some] = np.packbits(bits, axis=3, bitorder="little").reshape(len(some), POSITIONS)
    return out.view(np.int64)


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch, data, bounds in slices(batches):
        values, first = shingles_of(data, bounds)
        prints = prints_of(values, first)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, prints.size + 1, prints.shape[1], dtype=np.int32)), pa.array(prints.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nodes(values, first)), lists], names=["doc_id", "node", "print"])


def _key_rows(level: int, sets: range):
    places = _position_sets(level)[sets.start:sets.stop]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, root = (np.repeat(batch.column(k).to_numpy(), len(sets)) for k in range(2))
                longs = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                at = np.ascontiguousarray(longs).view(np.uint8)
                key = np.tile(np.arange(sets.start, sets.stop, dtype=np.int64), (batch.num_rows, 1))
                for place in places.T:
                    key = key << 8 | at[:, place]
                sketch = [np.repeat(longs[:, k], len(sets)) for k in range(SKETCH)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.ravel(), node, root, *sketch)], names=["key", "node", "root", *[f"s{k}" for k in range(SKETCH)]])
    return rows


def _marks(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MARK_WORDS longs for each text: each bit is the parity of the number of shingles that fall on it."""
    width = MARK_WORDS * 64
    at = np.repeat(np.arange(len(first) - 1), np.diff(first)) * width + (values >> np.uint64(65 - width.bit_length())).astype(np.int64)
    odd = np.bincount(at, minlength=(len(first) - 1) * width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(-1, MARK_WORDS)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    np.seterr(over="ignore")
    for batch, data, bounds in slices(batches):
        values, first = shingles_of(data, bounds)
        sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
        marks = pa.FixedSizeListArray.from_arrays(pa.array(_marks(values, first).ravel()), MARK_WORDS).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(_nodes(values, first)), sets, marks], names=["node", "shingles", "marks"])


def _true(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The different pairs (u, v) whose shingles are similar enough."""
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v") \
        .join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u") \
        .filter(both * LEAST[1] >= (F.size("a") + F.size("b") - both) * LEAST[0]).select("u", "v")


def few(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The frame, to be broadcast if it has few rows."""
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(few(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))


def _index(rooted: DataFrame, level: int, sets: range) -> DataFrame:
    longs = ", ".join(f"s{k} long" for k in range(SKETCH))
    return rooted.select("node", "root", "print").mapInArrow(_key_rows(level, sets), f"key long, node long, root long, {longs}")


def _parts(level: int, rows: int, of: int) -> list[range]:
    """A level's sets, some at a time; the index is of so many texts, out of so many."""
    step = max(PART_SETS * of, PART_ROWS) // max(rows, 1)
    sets = LEVELS[level][1]
    return [range(k, min(k + step, sets)) for k in range(0, sets, step)]


def _differing(a: Callable[[int], Column], b: Callable[[int], Column], longs: int) -> Column:
    """The bits in which longs differ."""
    return reduce(Column.__add__, [F.bit_count(a(k).bitwiseXOR(b(k))) for k in range(longs)])


def _least_of(index: DataFrame) -> DataFrame:
    """Each list's key, number of rows, least member (at) and least and greatest root."""
    return index.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct("node", "root", *[f"s{k}" for k in range(SKETCH)])).alias("at"),
                                    F.min("root").alias("first"), F.max("root").alias("last"))


def _stars(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(u, v, differ): the members v of lists that may be linked to their list's least, u, and have another root."""
    differ = _differing(lambda k: F.col(f"s{k}"), lambda k: F.col(f"at.s{k}"), SKETCH)
    return index.join(lists.withColumnRenamed("key", "of"), (F.col("key") == F.col("of")) & (F.col("root") != F.col("at.root")) & (differ <= SKETCH_BITS)) \
        .select(F.col("at.node").alias("u"), F.col("node").alias("v"), differ.alias("differ"))


def _pairs(index: DataFrame) -> DataFrame:
    """(u, v): all pairs of different roots within lists that may be linked."""
    one, two = (index.select(*[F.col(c).alias(c + side) for c in index.columns]) for side in "uv")
    differ = _differing(lambda k: F.col(f"s{k}u"), lambda k: F.col(f"s{k}v"), SKETCH)
    return one.join(two, F.expr("keyu = keyv and nodeu < nodev and rootu != rootv") & (differ <= SKETCH_BITS)).select(F.col("nodeu").alias("u"), F.col("nodev").alias("v"))


def _tallied(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs that agree in TALLY positions of their fingerprints or more."""
    def differ(a: Column, b: Column) -> Column:
        x = a.bitwiseXOR(b)
        for shift, kept in ((4, 0x0F), (2, 0x03), (1, 0x01)):  # a byte's last bit becomes 1 if it has any
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(int.from_bytes([kept] * 8)).cast("long"))
        return F.bit_count(x)
    one, two = (nodes.select(F.col("node").alias(side), F.col("print").alias("print" + side)) for side in "uv")
    agreeing = F.lit(POSITIONS) - F.aggregate(F.zip_with("printu", "printv", differ), F.lit(0), lambda total, n: total + n)
    return pairs.join(two, "v").join(one, "u").filter(agreeing >= TALLY).select("u", "v")


def _not_ruled_out(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs but for those whose parity bits rule a link out: of n + m shingles linked texts differ in (n + m) * (LEAST[1] - LEAST[0]) / sum(LEAST) at most."""
    one, two = (sets.select(F.col("node").alias(side), F.size("shingles").alias("n" + side), F.col("marks").alias("marks" + side)) for side in "uv")
    differ = _differing(lambda k: F.col("marksu")[k], lambda k: F.col("marksv")[k], MARK_WORDS)
    return pairs.join(two, "v").join(one, "u").filter(differ * sum(LEAST) <= (F.col("nu") + F.col("nv")) * (LEAST[1] - LEAST[0])).select("u", "v")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The links among the pairs (u, v), stored: those that hold by their tally, then their parity bits, then their shingles. Only texts in pairs that pass the tally are read."""
    def some(pairs: DataFrame, of: DataFrame) -> DataFrame:
        return stored(of.join(few(stored(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "node"))), "node", "left_semi"))
    pairs = stored(pairs.select("u", "v").distinct())
    if pairs.isEmpty():
        return pairs
    pairs = stored(_tallied(pairs, some(pairs, nodes)))
    if pairs.isEmpty():
        return pairs
    chosen = some(pairs, nodes.select("node", "doc_id"))
    ids = few(chosen.select("doc_id").distinct())
    sets = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").mapInArrow(_set_rows, "node long, shingles array<long>, marks array<long>")
    sets = stored(sets.join(few(chosen.select("node")), "node", "left_semi").dropDuplicates(["node"]))
    return stored(_true(_not_ruled_out(pairs, sets), sets))


def near_copy_groups(docs: DataFrame, list_rows: int = LIST_ROWS) -> DataFrame:
    """Per row of docs: doc_id and component_id, the smallest doc_id reachable over links. Texts without words are one group.
    A row without a doc_id gets its component's smallest one, null if it has none; rows that repeat a doc_id each give a row. Texts are taken whole at any length. Without rows the
    result is empty. Other columns are ignored."""
    text_batches(docs.sparkSession)
    with shuffles_removed(docs.sparkSession):
        prints, classes = _classes(docs, list_rows)
    return prints.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def _classes(docs: DataFrame, list_rows: int) -> tuple[DataFrame, DataFrame]:
    """Stored tables: doc_id and node of each row, and each node's component_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = stored(docs.mapInArrow(_print_rows, "doc_id long, node long, print array<long>"))
    nodes = stored(prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"), F.first("print").alias("print")))
    of = nodes.count()
    alone = _index(nodes.withColumn("root", F.col("node")), 0, _parts(0, of, of)[0])
    near = _stars(alone, _least_of(alone).filter("rows > 1"))
    best = near.groupBy("v").agg(F.min(F.struct("differ", "u"))["u"].alias("u"))
    links = _verified(best, nodes, docs)
    roots = stored(components(links))
    at, rows = nodes, of
    for level in range(len(LEVELS)):
        rooted = stored(_rooted(at, roots))
        met, crowded = [], []
        for sets in _parts(level, rows, of):
            index = _index(rooted, level, sets)
            if level == len(LEVELS) - 1:
                opened = stored(_least_of(index).filter("first != last").select("key"))
                met.append(stored(_pairs(index.join(few(opened), "key", "left_semi")).distinct()))
                continue
            long = stored(_least_of(index).filter(F.col("rows") > list_rows))
            short = index if long.isEmpty() else index.join(few(long.select("key")), "key", "left_anti")
            met.append(stored(_pairs(short).distinct()))
            long = long.filter("first != last")
            if not long.isEmpty():
                met.append(stored(_stars(index, few(long)).select("u", "v").distinct()))
                crowded.append(stored(index.join(few(long.select("key")), "key", "left_semi").select("node").distinct()))
        found = _verified(reduce(DataFrame.union, met), nodes, docs)
        if not found.isEmpty():
            links = links.union(found)
            roots = stored(components(links))
        if not crowded:
            break
        at = stored(nodes.join(few(stored(reduce(DataFrame.union, crowded).distinct())), "node", "left_semi"))
        rows = at.count()
    rooted = nodes.select("node", F.col("doc_id").alias("first_id")).join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints, stored(rooted.join(lowest, "root").select("node", "component_id"))
