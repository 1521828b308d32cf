"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A language gives each vocabulary piece a probability. A word's probability is the sum over all its segmentations into pieces,
which the forward algorithm adds up byte by byte; a text's is the product over its words. The vocabulary is a public
SentencePiece file (a parameter, readable on every worker); pieces over LONGEST_PIECE bytes are left out and all single bytes
are put in, so every word has a segmentation. Only piece probabilities are learned, from piece counts of a bounded sample.

Per task, words are told apart by 64-bit hashes and each different one is scored once, all those of one length together in NumPy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import fold, table, text_batches
from furrow.llm.words import LOWER, byte_sums, mix, powers, slices, sums_by_text, text_buffers, words_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: About so many documents of each language are learned from, whole; chosen by a hash of the id.
SAMPLE_PER_LANGUAGE = 500
#: More values of lang than this are refused: the model has a column for each.
MOST_LANGUAGES = 200
LONGEST_PIECE = 16
#: Longer words are scored in parts of so many bytes.
LONGEST_WORD = 31
SMOOTHING = 0.1
UNKNOWN = "und"
SLICE = 1_000_000
LETTER_BYTE = np.zeros(256, dtype=bool)
LETTER_BYTE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def piece_hash(total_difference: np.ndarray, inverse: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    return mix(total_difference * inverse + np.uint64(size))


@dataclass
class Pieces:
    """The vocabulary as bytes: row_of gives each id of the file its row, or -1; a table finds a row by hash."""

    rows: list[bytes]
    row_of: np.ndarray
    slots: np.ndarray
    hashes: np.ndarray

    BITS = 19

    @classmethod
    def read(cls, path: str) -> Pieces:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        known: dict[bytes, int] = {}
        row_of = np.full(model.get_piece_size(), -1, dtype=np.int64)
        for k in range(model.get_piece_size()):
            if model.is_control(k) or model.is_unknown(k):
                continue
            piece = bytes([int(model.id_to_piece(k)[3:5], 16)]) if model.is_byte(k) else model.id_to_piece(k).replace("▁", " ").encode()
            if len(piece) <= LONGEST_PIECE:
                row_of[k] = known.setdefault(piece, len(known))
        for b in range(256):
            known.setdefault(bytes([b]), len(known))
        rows = list(known)
        hashes = np.zeros(len(rows) + 1, dtype=np.uint64)
        slots = np.full(1 << cls.BITS, -1, dtype=np.int32)
        with np.errstate(over="ignore"):
            for k, piece in enumerate(rows):
                hashes[k] = piece_hash(byte_sums(np.frombuffer(piece, dtype=np.uint8))[-1:], np.ones(1, dtype=np.uint64), len(piece))[0]
                at = int(hashes[k]) >> (64 - cls.BITS)
                while slots[at] >= 0:
                    at = (at + 1) % len(slots)
                slots[at] = k
        return cls(rows, row_of, slots, hashes)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash, or len(rows)."""
        at = (hashes >> np.uint64(64 - self.BITS)).astype(np.int64)
        row = self.slots[at]
        wrong = np.flatnonzero((row >= 0) & (self.hashes[row] != hashes))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            row[wrong] = self.slots[at[wrong]]
            wrong = wrong[(row[wrong] >= 0) & (self.hashes[row[wrong]] != hashes[wrong])]
        row[row < 0] = len(self.rows)
        return row


@dataclass
class LanguageModel:
    """log_p: piece rows by languages."""

    languages: list[str]
    pieces: Pieces
    log_p: np.ndarray

    def word_scores(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Log-probabilities of words given as byte ranges, by language. head: the word's first part, with a space before it."""
        out = np.zeros((len(start), len(self.languages)))
        # Kept away from underflow by a factor of 256 for each byte, the same for all segmentations.
        weight = np.vstack([np.exp(self.log_p + np.log(256) * np.array([len(p) for p in self.pieces.rows])[:, None]), np.zeros((1, len(self.languages)))])
        length = size + head
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts):
            n = int(length[group[0]]) if len(group) else 0
            step = max(1, 200_000 // max(n, 1))
            for at in range(0, len(group), step):
                some = group[at:at + step]
                place = (start[some] - head[some])[:, None] + np.arange(n)
                letters = data[np.maximum(place, 0)]
                letters[head[some] == 1, 0] = 0x20
                out[some] = self._forward(letters, weight) - np.log(256) * n
        return out

    def _forward(self, letters: np.ndarray, weight: np.ndarray) -> np.ndarray:
        count, n = letters.shape
        total = np.zeros((count, n + 1), dtype=np.uint64)
        np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * powers(n), axis=1, out=total[:, 1:])
        rows = [self.pieces.find(piece_hash(total[:, k:] - total[:, :-k], powers(n, True)[:n - k + 1], k).ravel()).reshape(count, -1).T for k in range(1, min(n, LONGEST_PIECE) + 1)]
        reached = np.zeros((n + 1, count, weight.shape[1]))
        reached[0] = 1
        for end in range(1, n + 1):
            for k in range(1, min(end, LONGEST_PIECE) + 1):
                reached[end] += reached[end - k] * weight[rows[k - 1][end - k]]
        return np.log(reached[n])

    def scores(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log-probabilities of texts, by language; words without a letter are left out."""
        data = LOWER[data]
        words = words_of(data, bounds)
        size = words.end - words.start
        parts = -(-size // LONGEST_WORD)
        word = np.repeat(np.arange(len(size)), parts)
        offset = (np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)) * LONGEST_WORD
        start = words.start[word] + offset
        end = np.minimum(start + LONGEST_WORD, words.end[word])
        letters = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(LETTER_BYTE[data], out=letters[1:])
        told = np.flatnonzero(letters[end] > letters[start])
        word, start, end, head = word[told], start[told], end[told], (offset[told] == 0).astype(np.int64)
        total = byte_sums(data)
        label = piece_hash(total[end] - total[start], powers(len(data) + 1, True)[start], 0) + ((end - start) * 2 + head).astype(np.uint64)
        _, first, which = np.unique(label, return_index=True, return_inverse=True)
        each = self.word_scores(data, start[first], (end - start)[first], head[first])
        return sums_by_text(each[which], np.searchsorted(words.text[word], np.arange(len(bounds))))


def _count_rows(path: str):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                ids = model.encode(text.as_py().encode().translate(LOWER.tobytes()).decode())
                mine = counts.setdefault(lang.as_py(), np.zeros(model.get_piece_size(), dtype=np.int64))
                np.add.at(mine, np.array(ids, dtype=np.int64), 1)
        for lang, mine in counts.items():
            some = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(mine[some])], names=["lang", "piece", "n"])
    return rows


def learn(labelled: DataFrame, vocabulary: str = VOCABULARY, sample: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """A model of the languages in `labelled` (doc_id, text, lang); rows without a text or lang teach nothing.

    About `sample` documents of each language are used, those with the least hash of doc_id (all where there are fewer). What comes
    back to the driver is one row for each language and piece seen.
    """
    text_batches(labelled.sparkSession)
    rows = labelled.filter("text is not null and lang is not null").select(F.xxhash64("doc_id").alias("h"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    pieces = Pieces.read(vocabulary)
    counts = np.zeros((len(pieces.rows), len(languages)))
    if languages:
        rank = F.shiftrightunsigned("h", 34)  # 30 bits
        share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]) * 2**30)])
        seen = rows.filter(rank < share[F.col("lang")]).select("text", "lang").mapInArrow(_count_rows(vocabulary), "lang string, piece long, n long")
        for r in seen.groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():
            if pieces.row_of[r.piece] >= 0:
                counts[pieces.row_of[r.piece], languages.index(r.lang)] += r.n
    return LanguageModel(languages, pieces, np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * len(counts))))


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of docs with lang_pred and score, from the whole text alone.

    score is the prediction's share of the probability, languages being equally likely at first. A text that is null or has no
    letter, and any text if no language was learned, is "und" with score 0. Columns of docs with these two names are replaced.
    """
    rest = docs.drop("lang_pred", "score").withColumn("text", F.col("text").cast("string"))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        model = shared.value
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        for batch, data, bounds in slices(batches, most=SLICE):
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            seen = sums_by_text(LETTER_BYTE[data], bounds) > 0
            plain = sums_by_text(LETTER_BYTE[data] & (data < 128), bounds) > 0
            for i in np.flatnonzero(seen & ~plain).tolist():
                seen[i] = any(c.isalpha() for c in data[bounds[i]:bounds[i + 1]].tobytes().decode())
            if model.languages and seen.any():
                scores = model.scores(data, bounds)
                share = np.exp(scores - scores.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                best = np.where(seen, share.argmax(axis=1), -1)
                score = np.where(seen, share.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "score"])
    return rest.mapInArrow(rows, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs.filter(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
#: A fitted model; tests hold the forward sums against all segmentations of short words, and the accuracy on held-out rows.
ORACLES: dict[str, str] = {}
