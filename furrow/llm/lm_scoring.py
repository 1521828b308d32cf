"""LM scoring with a log-frequency Bloom filter of bigram counts, broadcast to the workers.

Filter: a bigram of count c is put in with each level 1..q(c), q(c) = 1 + floor(log_LEVEL c). A reader probes levels from 1 until one
is missing; the last one found tells the count up to a factor of LEVEL. Bigrams are counted in a shuffle over ranges of
their hash, as many as the corpus needs; each range becomes a segment of the filter, sized by its own entries, so the filter follows the corpus. The segments are
shared out over as many broadcasts as it takes to keep each under BROADCAST_BYTES; every bigram of a text is looked up in the
one broadcast that has its range, and the texts' sums over the broadcasts are added up.

Model: p(w | v) = (1 - UNIGRAM_SHARE) * count(v w) / count(v) + UNIGRAM_SHARE * p(w), with count(v w) from the filter and at most
count(v), p(w) the smoothed unigram probability. Each text begins and ends with the end token.

Unigram counts are exact. A look-up list would be as large as the vocabulary, so it is not broadcast: documents are dealt out
into chunks, each chunk's different words are joined with the counts once, and a chunk's texts meet its own list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.frames import fold, stored, table, text_batches
from furrow.llm.words import LOWER, mix, slices, sums_by_text, words_of

#: A range of hashes has the bigrams of about so many bytes of text; there are at least 256.
RANGE_BYTES = 4_000_000
LEVEL = 1.5
PROBES = 4
BITS_PER_ENTRY = 8
BROADCAST_BYTES = 128_000_000
UNIGRAM_SHARE = 0.4
ALPHA = 0.1
#: Texts of about so many bytes share a chunk.
CHUNK_BYTES = 16_000_000
#: The hash that stands for the end token; words have other hashes but for one in 2^64.
END = np.uint64(0x5EED)
#: A task counts so many tokens in memory before it hands counts on.
HELD_TOKENS = 4_000_000
#: Bytes that stand for a token or a bigram below the first, which its range tells: all of a token's hash, 56 bits in all of a bigram's.
WIDTHS = {1: 7, 2: 6}


def _tokens(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each text's words and then its end, and where each text's tokens begin (one more at the end)."""
    words = words_of(LOWER[data], bounds)
    first = words.first + np.arange(len(words.first))
    tokens = np.full(first[-1], END, dtype=np.uint64)
    tokens[np.arange(len(words.start)) + words.text] = words.hashes()
    return tokens, first


def _bigrams(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = END
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + tokens)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.diff(np.append(at, len(values)))


def _pack(hashes: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """Hashes of one range, `width` bytes below the range's own, then counts as one byte each or, above 254, five."""
    low = np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 1:1 + width])
    large = counts > 254
    return low.tobytes() + np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u4").tobytes()


def _unpack(blob: bytes, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, 8 - width:] = np.frombuffer(blob, dtype=np.uint8, count=width * n).reshape(-1, width)
    counts = np.frombuffer(blob, dtype=np.uint8, count=n, offset=width * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(blob, dtype="<u4", offset=(width + 1) * n)
    return wide.view(">u8").ravel().astype(np.uint64), counts


def _low(hashes: np.ndarray) -> np.ndarray:
    """What _pack keeps of a bigram's hash."""
    return hashes >> np.uint64(8 * (7 - WIDTHS[2])) & np.uint64((1 << 8 * WIDTHS[2]) - 1)


def _ngram_rows(range_bits: int):
    """Per range and order, the counts of the tokens and bigrams in it, of up to HELD_TOKENS tokens at a time."""
    def handed(held: list[np.ndarray], order: int) -> pa.RecordBatch:
        hashes, counts = _counted(np.concatenate(held))
        cuts = np.searchsorted(hashes >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1).astype(np.uint64))
        some = np.flatnonzero(np.diff(cuts))
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), order, dtype=np.int32)), pa.array(np.diff(cuts)[some]),
                                           pa.array([_pack(hashes[cuts[k]:cuts[k + 1]], counts[cuts[k]:cuts[k + 1]], WIDTHS[order]) for k in some.tolist()], pa.binary())], names=["range", "order", "n", "counts"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: dict[int, list[np.ndarray]] = {1: [], 2: []}
        for _, data, bounds in slices(batches):
            tokens, first = _tokens(data, bounds)
            held[1].append(tokens)
            held[2].append(_bigrams(tokens, first))
            if sum(map(len, held[1])) >= HELD_TOKENS:
                yield from (handed(v, k) for k, v in held.items())
                held = {1: [], 2: []}
        if held[1]:
            yield from (handed(v, k) for k, v in held.items())
    return rows


def levels_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(LEVEL) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of what a level stands for; 0 for none, 1 for the first."""
    return np.where(levels > 1, (LEVEL ** (levels - 1.0) + LEVEL ** levels) / 2, levels.astype(float))


def _place(hashes: np.ndarray, level: int, probe: int, bits: np.ndarray | int) -> np.ndarray:
    """The bit that a bigram's level has to have set for one probe, out of `bits` bits."""
    seeded = mix(hashes * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level * PROBES + probe))
    return (seeded >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32) if np.isscalar(bits) else (seeded >> np.uint64(32)) * bits >> np.uint64(32)


def segment_of(hashes: np.ndarray, counts: np.ndarray) -> tuple[bytes, int]:
    """A segment of the filter and its size in bits, for the bigrams of one range."""
    levels = levels_of(counts)
    size = max(64, int(levels.sum()) * BITS_PER_ENTRY)
    if size > 1 << 32:
        raise ValueError("a segment of over 512 MB: use a smaller RANGE_BYTES")
    bits = np.zeros(size, dtype=bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        some = hashes[levels >= level]
        for probe in range(PROBES):
            bits[_place(some, level, probe, size)] = True
    return np.packbits(bits).tobytes(), size


def _segment_rows(key: tuple, rows: pa.Table) -> pa.Table:
    """Of one range: its segment, and how many different tokens and tokens in all it has."""
    np.seterr(over="ignore")
    joined = {}
    for order, width in WIDTHS.items():
        mine = rows.filter(pc.equal(rows.column("order"), order))
        parts = [_unpack(blob, n, width) for blob, n in zip(mine.column("counts").to_pylist(), mine.column("n").to_pylist())]
        hashes, which = np.unique(np.concatenate([np.zeros(0, dtype=np.uint64), *[h for h, _ in parts]]), return_inverse=True)
        joined[order] = hashes, np.bincount(which, weights=np.concatenate([np.zeros(0), *[c for _, c in parts]]), minlength=len(hashes)).astype(np.int64)
    segment, size = segment_of(*joined[2])
    return pa.table({"range": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([segment], pa.binary()), "n_bits": pa.array([size], pa.int64()),
                     "different": pa.array([len(joined[1][0])], pa.int64()), "tokens": pa.array([int(joined[1][1].sum())], pa.int64())})


class Filter:
    """Some segments of the log-frequency Bloom filter."""

    def __init__(self, sizes: dict[int, int], segments: Iterable[tuple[int, bytes]], range_bits: int):
        """sizes: bits of the segments of each range; one that segments doesn't have is empty."""
        self.shift = np.uint64(64 - range_bits)
        self.start = np.full(1 << range_bits, -1, dtype=np.int64)
        self.size = np.ones(1 << range_bits, dtype=np.uint64)
        at = 0
        for k, n in sizes.items():
            self.start[k], self.size[k] = at, n
            at += -(-n // 8)
        self.bits = np.zeros(at, dtype=np.uint8)
        for k, b in segments:
            self.bits[self.start[k]:self.start[k] + len(b)] = np.frombuffer(b, dtype=np.uint8)

    def counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the hashes fall to this filter, their counts): levels are probed one by one until one is missing."""
        ranges = (hashes >> self.shift).astype(np.int64)
        mine = np.flatnonzero(self.start[ranges] >= 0)
        start, size, low = self.start[ranges[mine]], self.size[ranges[mine]], _low(hashes[mine])
        found = np.zeros(len(mine), dtype=np.int64)
        left, level = np.arange(len(mine)), 1
        while len(left):
            for probe in range(PROBES):
                place = _place(low[left], level, probe, size[left])
                byte = self.bits[start[left] + (place >> np.uint64(3)).astype(np.int64)]
                left = left[(byte >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8))) & np.uint8(1) == 1]
            found[left] = level
            level += 1
        return mine, count_of(found)


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per chunk, its different words and how often they occur in training texts. Chunks come one after another."""
    np.seterr(over="ignore")

    def handed(chunk: int, held: list[np.ndarray], train: list[np.ndarray]) -> pa.RecordBatch:
        words, which = np.unique(np.concatenate(held), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(train)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), chunk, dtype=np.int64)), pa.array(words.view(np.int64)), pa.array(n)], names=["chunk", "word", "n"])
    now, held, train = None, [], []
    for batch, data, bounds in slices(batches):
        tokens, first = _tokens(data, bounds)
        chunks = batch.column(batch.schema.get_field_index("chunk")).to_numpy()
        learns = (~batch.column(batch.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)).astype(np.int64)
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for a, b in zip(edges[:-1], edges[1:]):
            if now is not None and now != chunks[a]:
                yield handed(now, held, train)
                held, train = [], []
            now = int(chunks[a])
            held.append(tokens[first[a]:first[b]])
            train.append(np.repeat(learns[a:b], np.diff(first[a:b + 1])))
    if held:
        yield handed(now, held, train)


def _score_rows(shared, total: int, distinct: int):
    names = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "mark": pa.int64()}

    def rows(texts: pa.Table, known: pa.Table) -> pa.Table:
        np.seterr(over="ignore")
        words = known.column("word").to_numpy().view(np.uint64)
        counts = known.column("n").to_numpy()
        order = np.argsort(words)
        words, counts = words[order], counts[order]
        smooth = np.log10(total + ALPHA * (distinct + 1))
        model: Filter = shared.value
        out: list[list[np.ndarray]] = [[] for _ in names]
        keys: list[pa.RecordBatch] = []
        for batch, data, bounds in slices(iter(texts.to_batches())):
            tokens, first = _tokens(data, bounds)
            at = np.searchsorted(words, tokens)
            count = counts[at]
            base = np.log10(count + ALPHA) - smooth
            before = np.empty_like(count)
            before[1:] = count[:-1]
            before[first[:-1]] = counts[np.searchsorted(words, END)]
            bigrams = _bigrams(tokens, first)
            mine, pairs = model.counts(bigrams)
            seen = np.where(before[mine] > 0, np.minimum(pairs, before[mine]) / np.maximum(before[mine], 1), 0.0)
            value = np.zeros(len(tokens))
            value[mine] = np.log10((1 - UNIGRAM_SHARE) * seen + np.where(before[mine] > 0, UNIGRAM_SHARE, 1.0) * 10 ** base[mine])
            keys.append(batch.select([0, 1]))
            for column, v in zip(out, (np.diff(first), sums_by_text(count > 0, first), np.add.reduceat(base, first[:-1]), np.add.reduceat(value, first[:-1]), np.add.reduceat(bigrams, first[:-1]).view(np.int64))):
                column.append(v)
        found = pa.table({name: pa.array(np.concatenate(v) if v else [], kind) for (name, kind), v in zip(names.items(), out)})
        told = pa.Table.from_batches(keys, texts.schema.empty_table().select([0, 1]).schema)
        return pa.table({name: table.column(name) for table in (told, found) for name in table.column_names})
    return rows


def lm_scores(docs: DataFrame, folds: int = 10, broadcast_bytes: int = BROADCAST_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (log10, smoothed unigrams) and score (log10, the model).

    Texts with crc32(doc_id) mod folds not 0 are learned from, all are scored. A null text is empty: its only token is the end. A row
    without a doc_id counts as an empty id, so it is held out. Each row of docs gives a row. Words are told apart by 64-bit hashes.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    text_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", folds) == 0).alias("held_out"), text.alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    range_bits = max(8, (size // RANGE_BYTES).bit_length())
    segments = stored(rows.filter("not held_out").select("text").mapInArrow(_ngram_rows(range_bits), "range int, order int, n long, counts binary")
                      .groupBy("range").applyInArrow(_segment_rows, "range int, bits binary, n_bits long, different long, tokens long"))
    sizes = segments.select("range", "n_bits", "different", "tokens").orderBy("range").collect()
    total, distinct = sum(r["tokens"] for r in sizes), sum(r["different"] for r in sizes)
    bits = {r["range"]: r["n_bits"] for r in sizes}
    missing = sorted(set(range(1 << range_bits)) - {r["range"] for r in sizes})
    parts, filled = [[]], 0
    for r in sizes:
        if parts[-1] and filled + r["n_bits"] > 8 * broadcast_bytes:
            parts.append([])
            filled = 0
        parts[-1].append(r["range"])
        filled += r["n_bits"]

    chunks = max(1, -(-size // chunk_bytes))
    dealt = rows.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).alias("chunk")).repartition("chunk")
    words = dealt.sortWithinPartitions("chunk").mapInArrow(_word_rows, "chunk long, word long, n long").repartition("word")
    known = words.select("chunk", "word").join(words.groupBy("word").agg(F.sum("n").alias("n")), "word")
    scored = []
    for k, part in enumerate(parts):
        # Fetched some ranges at a time, so the driver holds a part once.
        rows_of = (r for at in range(0, len(part), 32) for r in segments.filter(F.col("range").between(part[at], part[min(at + 31, len(part) - 1)])).select("range", "bits").collect())
        own = {m: bits[m] for m in part} | (dict.fromkeys(missing, 64) if k == 0 else {})
        shared = spark.sparkContext.broadcast(Filter(own, ((r["range"], r["bits"]) for r in rows_of), range_bits))
        scored.append(dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score_rows(shared, total, distinct),
                      "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, mark long"))
    one = scored[0]
    if len(parts) > 1:
        # Each broadcast has scored each row for its own bigrams. `mark` tells texts that share an id apart; equal rows are equal.
        same = ["doc_id", "held_out", "n_tokens", "n_known", "mark"]
        summed = reduce(DataFrame.unionByName, scored).groupBy(*same).agg(F.max("base_score").alias("base_score"), F.sum("score").alias("score"), (F.count("*") / len(parts)).cast("int").alias("rows"))
        one = summed.withColumn("score", F.col("score") / F.col("rows")).withColumn("row", F.explode(F.sequence(F.lit(1), "rows")))
    return one.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
#: Words are hashed and counts are quantised in the filter; tests hold base columns and counts against brute force.
ORACLES: dict[str, str] = {}
