"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes: a window of WINDOW words is known by its anchor, the PREFIX-word run with the least hash in it. Equal windows have
equal anchors at equal offsets, so it is enough to place the suffixes that share their anchor's words with another one, one
entry for an anchor with the few words that its windows span, instead of every suffix with its text.

Prefixes: entries are dealt out by the anchor's PREFIX words. Where a prefix holds more than GROUP_ROWS entries it is first
split by document and then, for the windows that are still the earliest of their part, lengthened to WINDOW words.

Subtrees: in each group the windows are ordered as suffixes, the common length of neighbours is taken word by word, and a run
of neighbours that share WINDOW words is the leaves below one deep internal node. All leaves but the earliest repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from furrow.llm.frames import id_of, key_of, one_row_per_document, table, text_batches
from furrow.llm.words import SLICE_BYTES, mix, slices, spaced, text_buffers, window_hashes, words_of

WINDOW = 20
PREFIX = 8
GROUP_ROWS = 4_000
#: A task builds subtrees for so many entries at a time, or for one larger group. Groups are never cut, so results don't depend on it; a worker's memory does, some 10 KB an entry.
BATCH_ENTRIES = 5_000


def anchors_of(hashes: np.ndarray, text: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each anchor: its hash, the first window that it stands for (a word's number) and how many windows follow each other."""
    n, span = len(hashes), window - prefix + 1
    if n < window:
        empty = np.zeros(0, dtype=np.int64)
        return empty.astype(np.uint64), empty, empty
    value = window_hashes(hashes, prefix)
    grams = value
    place = np.arange(len(value))
    width = 1
    while width < span:  # the least of `width` neighbours, leftmost where equal
        step = min(width, span - width)
        later = value[step:] < value[:len(value) - step]
        place = np.where(later, place[step:], place[:len(place) - step])
        value = np.where(later, value[step:], value[:len(value) - step])
        width += step
    whole = np.flatnonzero(text[window - 1:] == text[:n - window + 1])
    owner = place[whole]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (whole[1:] != whole[:-1] + 1)
    at = np.flatnonzero(new)
    return grams[owner[at]], whole[at], np.diff(np.append(at, len(owner)))


def _anchor_rows(window: int, prefix: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, bounds in slices(batches):
            words = words_of(data, bounds)
            gram, first, count = anchors_of(words.hashes(), words.text, window, prefix)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            text = words.text[first]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(ids[text]), pa.array((first - words.first[text]).astype(np.int32)),
                                              pa.array(count.astype(np.int32))], names=["prefix", "id", "start", "n"])
    return rows


def _entry_rows(window: int):
    """The words that an anchor's windows span, for the anchors that occur again."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, bounds in slices(batches):
            words = words_of(data, bounds)
            joined, begin, end = spaced(words)
            joined = joined.tobytes()
            lists = batch.column(batch.schema.get_field_index("found"))
            found = lists.flatten()
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            prefix, start, n, total = (found.field(k).to_numpy(zero_copy_only=False) for k in ("prefix", "start", "n", "total"))
            first = words.first[text] + start
            cut = [joined[a:b] for a, b in zip(begin[first].tolist(), end[first + n + window - 2].tolist())]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(ids[text]), pa.array(start), pa.array(n), pa.array(total),
                                              pa.array(cut, pa.binary()).cast(pa.string())], names=["prefix", "id", "start", "n", "total", "span"])
    return rows


def deep_nodes(group: np.ndarray, hashes: np.ndarray, at: np.ndarray, id_: np.ndarray, start: np.ndarray, window: int) -> np.ndarray:
    """True for each suffix (its first word's number is in `at`) that is not the earliest leaf below its node of depth `window`."""
    label = window_hashes(hashes, window)[at]
    order = np.lexsort((start, id_, label, group))
    same = np.zeros(len(order), dtype=bool)
    close = np.flatnonzero((label[order[1:]] == label[order[:-1]]) & (group[order[1:]] == group[order[:-1]])) + 1
    left, right = at[order[close - 1]], at[order[close]]
    alike = np.ones(len(close), dtype=bool)
    for depth in range(window):  # the common length of two neighbours, as far as it matters
        alike &= hashes[left + depth] == hashes[right + depth]
    same[close] = alike
    later = np.zeros(len(order), dtype=bool)
    later[order] = same
    return later


def _subtree_rows(window: int, group_rows: int):
    """Rows come ordered by prefix and part; a group is never cut. Out: for an entry the windows that occur earlier, as bits, and,
    in a part of a split group, the windows that don't."""
    names = ["id", "start", "repeats", "open"]

    def grown(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if not rows.num_rows:
            return
        prefix, part, id_, start, n, total = (rows.column(k).to_numpy() for k in ("prefix", "part", "id", "start", "n", "total"))
        data, bounds = text_buffers(rows.column("span").chunk(0))
        words = words_of(data, bounds)
        entry = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
        group = mix(prefix.view(np.uint64)) + part.astype(np.uint64)
        later = deep_nodes(group[entry], words.hashes(), words.first[entry] + nth, id_[entry], start[entry] + nth, window)
        repeats = np.zeros(len(n), dtype=np.int64)
        np.add.at(repeats, entry[later], np.int64(1) << nth[later])
        split = total > group_rows
        undecided = np.where(split, ((np.int64(1) << n.astype(np.int64)) - 1) & ~repeats, 0)
        out = np.flatnonzero((repeats != 0) | (undecided != 0))
        span = rows.column("span").chunk(0)
        opened = []
        for i in out.tolist():
            bits = int(undecided[i])
            text = span[i].as_py().split(" ") if bits else []
            opened.append([{"nth": k, "words": " ".join(text[k:k + window])} for k in range(int(n[i])) if bits >> k & 1])
        yield pa.RecordBatch.from_arrays([pa.array(id_[out]), pa.array(start[out]), pa.array(repeats[out]),
                                          pa.array(opened, pa.list_(pa.struct([("nth", pa.int32()), ("words", pa.string())])))], names=names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("prefix", "part")]
            cuts = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])) + 1
            if held and batch.num_rows:
                last = held[-1].slice(held[-1].num_rows - 1)
                if any(last.column(last.schema.get_field_index(k))[0].as_py() != keys[j][0] for j, k in enumerate(("prefix", "part"))):
                    cuts = np.insert(cuts, 0, 0)
            done = 0
            for cut in cuts.tolist():
                if count + cut - done >= BATCH_ENTRIES:
                    if cut > done:
                        held.append(batch.slice(done, cut - done))
                    yield from grown(held)
                    held, count, done = [], 0, cut
            if done < batch.num_rows:
                held.append(batch.slice(done))
                count += batch.num_rows - done
        if held:
            yield from grown(held)
    return rows


def _mark(n: int, found: list | None, copy: bool, window: int) -> np.ndarray:
    gone = np.zeros(n + 1, dtype=np.int32)
    if copy and n >= window:
        gone[0] += 1
    for start, repeats in found or ():
        while repeats:
            k = (repeats & -repeats).bit_length() - 1
            run = 1
            while repeats >> (k + run) & 1:
                run += 1
            gone[start + k] += 1
            gone[start + k + run - 1 + window] -= 1
            repeats &= ~(((1 << run) - 1) << k)
    return np.cumsum(gone[:n]) > 0


def _kept_rows(window: int, with_text: bool, carried: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[], [], [], []]
                repeats = part.column(3)
                starts = part.column(2)
                for i, text in enumerate(part.column(1)):
                    words = text.as_py().encode().split()
                    gone = _mark(len(words), zip(starts[i].as_py() or (), repeats[i].as_py() or ()), part.column(4)[i].as_py(), window)
                    kept = b" ".join(words if not gone.any() else [w for w, g in zip(words, gone.tolist()) if not g])
                    for column, value in zip(out, (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), (kept.decode() if gone.any() else text.as_py()) if with_text else None)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()),
                                                  *([pa.array(out[3], pa.string())] if with_text else []), *([part.column(5)] if carried else [])],
                                                 names=["id", "n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else []), *(["rest"] if carried else [])])
    return rows


def substring_dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group_rows: int = GROUP_ROWS, with_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Mark the words covered by a window of `window` words that also starts earlier (smaller doc_id, or earlier in the document).

    Per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text (the text itself where nothing is removed, else kept words joined by one space). A null or
    empty text has no words; a text of under `window` words keeps all. Rows that repeat a doc_id count as one document with the
    smallest text (and the smallest values of the columns in carry, which are returned as they are); no doc_id sorts first. Other columns are ignored. Words are told apart by 64-bit hashes, window by window.
    """
    if window - prefix + 1 > 62 or not 0 < prefix <= window:
        raise ValueError("prefix must be 1 to window words, and at most 61 shorter")
    text_batches(docs.sparkSession)
    one = one_row_per_document(docs)
    # Whole copies need no tree: all their windows start in the copy with the smallest id.
    digest = one.select("id", F.sha2("text", 256).alias("digest"))
    first = digest.groupBy("digest").agg(F.min("id").alias("first_id"))
    copies = digest.join(first, "digest").filter("id != first_id").select("id", F.lit(True).alias("copy"))
    base = one.join(copies, "id", "left")
    alone = base.filter("copy is null").select("id", "text")
    anchors = alone.mapInArrow(_anchor_rows(window, prefix), "prefix long, id long, start int, n int")
    shared = anchors.groupBy("prefix").agg(F.count("*").alias("total")).filter("total > 1")
    # Joined by another form of the prefix, both sides have an exchange of their own, so a frequent prefix can be split.
    turned = F.bitwise_not("prefix").alias("turned")
    found = anchors.select(turned, "id", "start", "n").join(shared.select(turned, "total"), "turned").withColumn("prefix", F.bitwise_not("turned")).groupBy("id").agg(F.collect_list(F.struct("prefix", "start", "n", "total")).alias("found"))
    entries = alone.join(found, "id").select("id", "text", "found") \
        .mapInArrow(_entry_rows(window), "prefix long, id long, start int, n int, total long, span string") \
        .withColumn("part", F.when(F.col("total") > group_rows, F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / group_rows))).otherwise(0).cast("int"))
    leaves = entries.repartition("prefix", "part").sortWithinPartitions("prefix", "part") \
        .mapInArrow(_subtree_rows(window, group_rows), "id long, start int, repeats long, open array<struct<nth:int,words:string>>")
    # Both branches name the same columns, so that the exchange by id is made once.
    placed = leaves.repartition("id")
    by_words = Window.partitionBy("words").orderBy("id", F.col("start") + F.col("nth"))
    lengthened = placed.filter("repeats is not null").select("id", "start", F.inline("open")) \
        .withColumn("leaf", F.row_number().over(by_words)).filter("leaf > 1").select("id", "start", F.expr("shiftleft(1L, nth)").alias("repeats"))
    repeats = placed.filter("open is not null and repeats != 0").select("id", "start", "repeats").unionByName(lengthened) \
        .groupBy("id").agg(F.collect_list("start").alias("starts"), F.collect_list("repeats").alias("repeats"))
    columns = "id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    marked = base.join(repeats, "id", "left").select("id", "text", "starts", "repeats", F.coalesce("copy", F.lit(False)).alias("copy"))
    names = [c.split()[0] for c in columns.split(", ")[1:]]
    if carry:
        # Joined to the texts where they are; a join with the kept texts would shuffle them once more.
        rest = docs.select(key_of("doc_id").alias("id"), F.struct(*carry).alias("rest")).groupBy("id").agg(F.min("rest").alias("rest"))
        marked = marked.join(rest, "id")
        columns += f", rest {rest.schema['rest'].dataType.simpleString()}"
    return marked.mapInArrow(_kept_rows(window, with_text, bool(carry)), columns).withColumn("doc_id", id_of("id")) \
        .select("doc_id", *names, *[F.col("rest")[c].alias(c) for c in carry])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
#: Windows of words over whole texts, some of 20,000 words, are too slow in SQL; tests hold the operator against brute force.
ORACLES: dict[str, str] = {}
