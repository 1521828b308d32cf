"""Product quantisation with integers, over Hilbert-sorted flat blocks.

Vectors become integers floor(SCALE * x) and are gathered into chunks of a bounded size, one row each. For every one of PARTS part positions a
chunk holds its sub-vectors along a Hilbert curve, cut into flat blocks of LEAF neighbours, and for each block the box of its least and largest
components and its sums. Chunks are written once to the checkpoint folder.

In each round a codebook entry stays on a block's shortlist if its least distance to the box isn't over the smallest of all entries' largest
distances. A block with one entry left is added to it by its stored sums; only the others' sub-vectors are compared with their shortlists, in exact
64-bit integers. Ties at the bound stay on the list, so the nearest entry, and the lowest index among equals, are those of a full comparison.

What leaves a task in a round are sums and counts for each entry; the codebooks (ENTRIES x PARTS sub-vectors) are all that is broadcast or
reaches the driver. The last assignment puts codes back into the chunk's own order, so no vector is ever shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import stored, table

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
LEAF = 16
#: Components in a chunk: 16,384 vectors of 64.
CHUNK_VALUES = 1 << 20


def limit_of(width: int) -> int:
    """Integer components are held within +- this, so that a squared distance of `width` components fits 64 bits."""
    return 1 << ((62 - max(1, (width - 1).bit_length())) // 2 - 1)


def integers(values: np.ndarray, width: int, scale: int = SCALE) -> np.ndarray:
    most = limit_of(width)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(values.astype(np.float64) * scale), -most, most).astype(np.int64)


def hilbert(points: np.ndarray) -> np.ndarray:
    """A key for each row along a Hilbert curve through the rows' box (Skilling's transform); up to 63 bits in all, so at most 63 columns."""
    n = min(points.shape[1], 63)
    bits = min(16, 63 // n)
    low = points[:, :n].min(axis=0)
    span = np.maximum(points[:, :n].max(axis=0) - low, 1).astype(np.float64)
    x = ((points[:, :n] - low) / span * ((1 << bits) - 1)).astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:  # undo excess work, from the top bit down
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(on, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


@dataclass
class Blocks:
    """One part position of a chunk: sub-vectors in Hilbert order, where each came from, and the flat blocks' boxes and sums."""

    points: np.ndarray
    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def flat_blocks(points: np.ndarray, leaf: int = LEAF) -> Blocks:
    order = np.argsort(hilbert(points), kind="stable")
    points = points[order]
    starts = np.arange(0, len(points), leaf)
    return Blocks(points, order, np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts), np.add.reduceat(points, starts),
                  np.diff([*starts, len(points)]))


def shortlists(blocks: Blocks, entries: np.ndarray) -> np.ndarray:
    """(block, entry): whether the entry may be nearest to a point of the block's box."""
    least = np.zeros((len(blocks.low), len(entries)), dtype=np.int64)
    most = np.zeros_like(least)
    for j in range(entries.shape[1]):
        below, above = blocks.low[:, j, None] - entries[None, :, j], entries[None, :, j] - blocks.high[:, j, None]
        least += np.maximum(np.maximum(below, above), 0) ** 2
        most += np.maximum(-below, -above) ** 2
    return least <= most.min(axis=1)[:, None]


def nearest(blocks: Blocks, entries: np.ndarray, which: np.ndarray, listed: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, entry, squared distance) of the sub-vectors of the blocks `which`, by their shortlists alone.

    Blocks whose lists are about equally long (up to the next power of two) run as one small array; lists are filled up with their first entry.
    """
    n = len(blocks.points)
    sizes = listed[which].sum(axis=1)
    places, best, distance = [], [], []
    for longest in (1 << k for k in range(int(sizes.max(initial=1) - 1).bit_length() + 1)):
        some = which[(sizes <= longest) & (sizes > longest // 2)]
        for part in np.array_split(some, max(1, len(some) * leaf * longest >> 20)) if len(some) else []:
            # Stable: listed entries first, in rising order.
            lists = np.argsort(~listed[part], axis=1, kind="stable")[:, :longest]
            lists = np.where(np.arange(lists.shape[1]) < listed[part].sum(axis=1)[:, None], lists, lists[:, :1])
            at = part[:, None] * leaf + np.arange(leaf)
            points = blocks.points[np.minimum(at, n - 1)]
            apart = np.zeros((len(part), leaf, lists.shape[1]), dtype=np.int64)
            for j in range(entries.shape[1]):
                apart += (points[:, :, None, j] - entries[lists, j][:, None, :]) ** 2
            first = apart.argmin(axis=2)
            real = at < n
            places.append(at[real])
            best.append(np.take_along_axis(lists, first, axis=1)[real])
            distance.append(np.take_along_axis(apart, first[:, :, None], axis=2)[:, :, 0][real])
    if not places:
        return (np.zeros(0, dtype=np.int64),) * 3
    return np.concatenate(places), np.concatenate(best), np.concatenate(distance)


def entry_sums(blocks: Blocks, entries: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """(entry, count and component sums) of the sub-vectors nearest to each entry; whole blocks where one entry is left."""
    out = np.zeros((len(entries), 1 + entries.shape[1]), dtype=np.int64)
    listed = shortlists(blocks, entries)
    alone = listed.sum(axis=1) == 1
    to = listed[alone].argmax(axis=1)
    np.add.at(out, to, np.concatenate([blocks.counts[alone, None], blocks.sums[alone]], axis=1))
    places, best, _ = nearest(blocks, entries, np.flatnonzero(~alone), listed, leaf)
    np.add.at(out, best, np.concatenate([np.ones((len(places), 1), dtype=np.int64), blocks.points[places]], axis=1))
    return out


def usable(column: str) -> Column:
    """Not null and without a null or non-finite component."""
    x = F.col(column).cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))), F.lit(False))


@dataclass
class Quantised:
    """codes: vec_id, label, code (array of `parts` entry numbers as bytes), error (squared distance to the codebooks' entries); codebooks: (part, entry, component)."""

    codes: DataFrame
    codebooks: np.ndarray


def _chunks(rows: DataFrame, parts: int, width: int, scale: int, leaf: int, values: int) -> DataFrame:
    """One row for each chunk: n, vec_ids, labels and, part after part, the stored arrays of its blocks."""
    label = rows.schema["label"].dataType
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("vec_ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)),
                           *[T.StructField(name, T.BinaryType()) for name in ("points", "places", "low", "high", "sums")]])
    most = max(1, values // (parts * width))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, np.ndarray]]:
        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, size = batch.column("embedding"), np.diff(batch.column("embedding").offsets.to_numpy())
            flat = integers(vectors.flatten().to_numpy(zero_copy_only=False), width, scale)
            whole = np.zeros((batch.num_rows, parts * width), dtype=np.int64)
            whole[np.arange(parts * width) < size[:, None]] = flat
            waiting.append((batch.column("vec_id"), batch.column("label"), whole))
            n += batch.num_rows
            while n >= most:
                ids, labels, vectors = (pa.concat_arrays([w[0] for w in waiting]), pa.concat_arrays([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting]))
                yield ids[:most], labels[:most], vectors[:most]
                waiting, n = ([(ids[most:], labels[most:], vectors[most:])], n - most) if n > most else ([], 0)
        if n:
            yield pa.concat_arrays([w[0] for w in waiting]), pa.concat_arrays([w[1] for w in waiting]), np.concatenate([w[2] for w in waiting])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, vectors in gathered(batches):
            n = len(vectors)
            per = [flat_blocks(vectors[:, p * width:(p + 1) * width], leaf) for p in range(parts)]
            raw = [b"".join(getattr(b, name).astype(kind).tobytes() for b in per) for name, kind in (("points", "<i4"), ("order", "<u4"), ("low", "<i4"), ("high", "<i4"), ("sums", "<i8"))]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.ListArray.from_arrays([0, n], ids), pa.ListArray.from_arrays([0, n], labels), *[pa.array([r], pa.binary()) for r in raw]],
                                             names=["n", "vec_ids", "labels", "points", "places", "low", "high", "sums"])
    return rows.mapInArrow(build, schema)


def _read(batch: pa.RecordBatch, row: int, parts: int, width: int, leaf: int) -> Iterator[Blocks]:
    n = batch.column("n")[row].as_py()
    flats = -(-n // leaf)

    def array(name: str, kind: str, shape: tuple) -> np.ndarray:
        return np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind).reshape(parts, *shape).astype(np.int64)
    points, places = array("points", "<i4", (n, width)), array("places", "<u4", (n,))
    low, high, sums = array("low", "<i4", (flats, width)), array("high", "<i4", (flats, width)), array("sums", "<i8", (flats, width))
    counts = np.full(flats, leaf, dtype=np.int64)
    counts[-1] = n - (flats - 1) * leaf
    for p in range(parts):
        yield Blocks(points[p], places[p], low[p], high[p], sums[p], counts)


def quantise(vectors: DataFrame, entries: int = ENTRIES, parts: int = PARTS, scale: int = SCALE, rounds: int = ROUNDS, leaf: int = LEAF, chunk_values: int = CHUNK_VALUES) -> Quantised:
    """Codes of all rows of vectors (vec_id, embedding, label) whose embedding isn't null and has only finite components; the others are left out.

    Codebooks start from the `entries` smallest vec_ids (all, if there are fewer; null ids last; equal ids by embedding) and take `rounds` rounds of
    integer means. Vectors that are shorter than the longest, or whose length `parts` doesn't divide, count as filled up with zeros. Components
    beyond the range in which distances fit 64 bits (2^21 for parts of 4) are held at its end. Repeated rows are rows of their own. Without a usable row there are no codes and
    no entries. Other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code is one byte a part, so 256 entries at most")
    spark = vectors.sparkSession
    rows = vectors.filter(usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    width = max(1, -(-(longest or 0) // parts))
    books = np.zeros((parts, len(first), width), dtype=np.int64)
    for k, r in enumerate(first):
        whole = np.zeros(parts * width, dtype=np.int64)
        whole[:len(r.embedding)] = integers(np.array(r.embedding, dtype=np.float64), width, scale)
        books[:, k] = whole.reshape(parts, width)
    chunks = stored(_chunks(rows, parts, width, scale, leaf, chunk_values))

    def summed(books: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(books)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((parts, books_shape[1], 1 + width), dtype=np.int64)
            seen = False
            for batch in batches:
                for row in range(batch.num_rows):
                    seen = True
                    for p, blocks in enumerate(_read(batch, row, parts, width, leaf)):
                        total[p] += entry_sums(blocks, shared.value[p], leaf)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.reshape(-1))], names=["at", "n"])
        return chunks.drop("vec_ids", "labels").mapInArrow(sums, "at long, n long").groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"))

    books_shape = books.shape
    for _ in range(rounds if len(first) else 0):
        total = np.zeros(books.shape[0] * books.shape[1] * (1 + width), dtype=object)
        for r in summed(books).collect():  # a row for each number of the codebooks
            total[r["at"]] = int(r["n"])
        total = total.reshape(parts, len(first), 1 + width)
        books = np.where(total[:, :, :1] > 0, total[:, :, 1:] // np.maximum(total[:, :, :1], 1), books).astype(np.int64)
    shared = spark.sparkContext.broadcast(books)

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                n = batch.column("n")[row].as_py()
                codes, error = np.zeros((n, parts), dtype=np.uint8), np.zeros(n, dtype=np.int64)
                for p, blocks in enumerate(_read(batch, row, parts, width, leaf)):
                    listed = shortlists(blocks, shared.value[p])
                    places, best, distance = nearest(blocks, shared.value[p], np.arange(len(listed)), listed, leaf)
                    at = blocks.order[places]
                    codes[at, p] = best
                    error[at] += distance
                whole = codes.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("vec_ids")[row].values, batch.column("labels")[row].values,
                                                  pa.array([whole[k:k + parts] for k in range(0, n * parts, parts)], pa.binary()), pa.array(error)], names=["vec_id", "label", "code", "error"])
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", rows.schema["label"].dataType), T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())])
    return Quantised(chunks.mapInArrow(assigned, schema), books)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = quantise(table(spark, sf_dir, "embeddings"))
    codes = stored(made.codes)
    digest = hashlib.sha256(",".join(map(str, made.codebooks.reshape(-1).tolist())).encode()).hexdigest()
    of_label = codes.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return codes.join(of_label, F.col("label").eqNullSafe(F.col("_label"))) \
        .select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql() -> str:
    """Every part against every entry, round after round."""
    steps = [f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
     FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     p AS MATERIALIZED (SELECT r, p, v[p * len(v) // {PARTS} + 1:(p + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) t(p)),
     b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM p WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, p, s[1] AS distance, s[2] AS e FROM (
         SELECT p.r, p.p, min([list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.e]) AS s FROM p JOIN b{k} b ON b.p = p.p GROUP BY 1, 2))""")
        if k < ROUNDS:
            steps.append(f"""m{k} AS MATERIALIZED (SELECT p, e, list(floored ORDER BY j) AS v FROM (SELECT a.p, a.e, j,
         CAST((sum(p.v[j]) - ((sum(p.v[j]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS floored
         FROM a{k} a JOIN p USING (r, p), range(1, (SELECT max(len(v)) FROM p) + 1) t(j) GROUP BY 1, 2, 3) GROUP BY 1, 2),
     b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e))""")
    steps.append(f"""c AS (SELECT r, string_agg(format('{{:02x}}', CAST(e AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(distance) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY 1),
     h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM k JOIN c USING (r), h""")
    return ",\n     ".join(steps)


QUERIES = {"op13_vector_codes": op13_vector_codes}
ORACLES = {"op13_vector_codes": _sql()}
