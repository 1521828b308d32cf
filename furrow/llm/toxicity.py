"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in NumPy.

A word's vector is the mean over its character n-grams (as bytes, with < and > around the word) and itself, each hashed into a
table of BUCKETS vectors; a text's is the mean over its words; a softmax of a linear map gives the label. Vectors and map are
fitted together by Adam on a bounded sample. An unseen misspelling shares most n-grams with the word it comes from.

As everything after the look-up is linear, a fitted model scores a text as the mean of one number per n-gram; scoring looks each
different word of a slice up once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import fold, table, text_batches
from furrow.llm.words import LOWER, byte_sums, mix, powers, slices, sums_by_text, words_of

#: About so many labelled documents of each label are learned from, whole; chosen by a hash of the id, never over twice as many.
SAMPLE = {0: 8_000, 1: 2_000}
BUCKET_BITS = 18
SIZES = (3, 4, 5)
DIMENSIONS = 4
STEPS = 150
#: Words in under two sampled texts, or one in so many of them, count in a text's mean but teach nothing: they would only learn
#: their texts by heart.
ONE_TEXT_IN = 2_000
RATE = 0.3
DECAY = 1e-3
#: Texts have few toxic words, so means are scaled up before the map; the map could learn the same, more slowly.
GAIN = 30.0
SLICE = 1_000_000


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of words given as byte ranges, word after word, and where each word's begin (one more at the end)."""
    size = end - start + 2
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(word)) - first[word]
    padded = data[np.clip(start[word] + offset - 1, 0, max(len(data) - 1, 0))] if len(data) else np.zeros(0, dtype=np.uint8)
    padded[first] = 0x3C
    padded[first + size - 1] = 0x3E
    total, inverse = byte_sums(padded), powers(len(padded) + 1, True)
    hashes, owner = [mix((total[first + size] - total[first]) * inverse[first])], [np.arange(len(size))]
    for n in SIZES:
        at = np.flatnonzero(offset + n <= size[word])
        hashes.append(mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n)))
        owner.append(word[at])
    owned = np.concatenate(owner)
    order = np.argsort(owned, kind="stable")
    buckets = (np.concatenate(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)[order]
    return buckets, np.searchsorted(owned[order], np.arange(len(size) + 1))


def _mean(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Means over the rows between entries of first; no stretch is empty."""
    return np.add.reduceat(rows, first[:-1], axis=0) / np.diff(first)[:, None].astype(rows.dtype)


def train(texts: list[str], toxic: np.ndarray, steps: int = STEPS, calm_weight: float = 1.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each bucket and a bias: log-odds of label 1 are the mean over words of the mean over n-grams, plus the bias.

    Every fifth text is kept out of the fit. Of the steps, that which ranks these best (area under the curve) is taken; the bias is then moved to where these are told apart best by F1, a
    text of label 0 standing for calm_weight of them.
    """
    known: dict[bytes, int] = {}
    bags = []
    for text in texts:
        ids = np.array([known.setdefault(w, len(known)) for w in text.encode().translate(LOWER.tobytes()).split()], dtype=np.int64)
        bags.append(np.unique(ids, return_counts=True))
    if not known:
        p = (toxic.sum() + 1) / (len(toxic) + 2)
        return np.zeros(1 << BUCKET_BITS), float(np.log(p / (1 - p)))
    shares = [b[1] / max(b[1].sum(), 1) for b in bags]
    texts_of = np.bincount(np.concatenate([b[0] for b in bags]), minlength=len(known))
    often = np.flatnonzero(texts_of >= min(max(2, len(texts) / ONE_TEXT_IN), texts_of.max()))
    number = np.full(len(known), -1)
    number[often] = np.arange(len(often))
    bags = [(number[b[0]][number[b[0]] >= 0], share[number[b[0]] >= 0]) for b, share in zip(bags, shares)]
    words = list(known)
    known = {words[k]: i for i, k in enumerate(often.tolist())}
    joined = np.frombuffer(b"".join(known), dtype=np.uint8)
    end = np.cumsum([len(w) for w in known])
    start = np.concatenate([[0], end[:-1]])
    bucket, first = subwords(joined, start, end)
    per_word = np.diff(first).astype(np.float32)
    owner = np.repeat(np.arange(len(known)), np.diff(first))
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    word = np.concatenate([b[0] for b in bags])
    share = np.concatenate([b[1] for b in bags]).astype(np.float32) * np.float32(GAIN)
    by_word = np.argsort(word, kind="stable")
    doc_by_word, share_by_word, word_starts = doc[by_word], share[by_word][:, None], np.searchsorted(word[by_word], np.arange(len(known)))
    some = np.unique(doc)
    doc_starts = np.searchsorted(doc, some)
    fits = np.arange(len(texts)) % 5 != 4 if len(texts) >= 50 else np.ones(len(texts), dtype=bool)

    rng = np.random.default_rng(seed)
    vectors = np.zeros((1 << BUCKET_BITS, DIMENSIONS), dtype=np.float32)  # n-grams never seen say nothing
    linear = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    offset = np.zeros(2, dtype=np.float32)
    target = np.eye(2, dtype=np.float32)[toxic]
    # Both labels weigh the same.
    weight = np.where(fits, 1 / np.maximum(1, np.array([(fits & (toxic == c)).sum() for c in (0, 1)]))[toxic], 0).astype(np.float32)
    state = [[p, np.zeros_like(p), np.zeros_like(p)] for p in (vectors, linear, offset)]

    def spread(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=values[:, d], minlength=n) for d in range(values.shape[1])], axis=1).astype(np.float32)

    def means() -> np.ndarray:
        out = np.zeros((len(bags), DIMENSIONS), dtype=np.float32)
        rows = _mean(vectors[bucket], first)[word]
        rows *= share[:, None]
        out[some] = np.add.reduceat(rows, doc_starts, axis=0)
        return out
    judged = ~fits if (~fits & (toxic == 1)).any() and (~fits & (toxic == 0)).any() else fits
    best_area, log_odds, numbers = -1.0, np.zeros(len(texts)), np.zeros(1 << BUCKET_BITS)

    def area(values: np.ndarray) -> float:
        calm, rude = np.sort(values[toxic[judged] == 0]), values[toxic[judged] == 1]
        below = np.searchsorted(calm, rude) + np.searchsorted(calm, rude, side="right")
        return below.sum() / max(1, 2 * len(calm) * len(rude))
    for step in range(1, steps + 1):
        mean = means()
        logits = mean @ linear + offset
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        odds /= odds.sum(axis=1, keepdims=True)
        apart = linear[:, 1] - linear[:, 0]
        reached = area((mean @ apart)[judged])
        if reached >= best_area:
            best_area, log_odds, numbers = reached, mean @ apart, (vectors @ apart).astype(np.float64) * GAIN
        wrong = (odds - target) * weight[:, None]
        rows = (wrong @ linear.T)[doc_by_word]
        rows *= share_by_word
        to_word = np.add.reduceat(rows, word_starts, axis=0) / per_word[:, None]
        grads = (spread(to_word[owner], bucket, len(vectors)) + DECAY * vectors / len(texts), mean.T @ wrong, wrong.sum(axis=0))
        for (p, m, v), g in zip(state, grads):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    cuts = np.sort(np.unique(log_odds[judged]))
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    positives = (toxic[judged] == 1).sum()
    weigh = np.where(toxic[judged] == 1, 1.0, calm_weight)
    f1 = [2 * (toxic[judged][log_odds[judged] >= c] == 1).sum() / max(1, positives + weigh[log_odds[judged] >= c].sum()) for c in cuts]
    best = np.flatnonzero(np.array(f1) == max(f1))
    return numbers, -float(cuts[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, sample: dict[int, int] | None = None, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Learn from documents with a label (doc_id, toxic 0 or 1); rows without text or label teach nothing.

    The sample's ids are broadcast, so documents aren't shuffled; one task fits the model on the sampled texts.
    """
    sample = sample or SAMPLE
    known = labels.filter("toxic in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    kept = {c: min(1.0, most / max(1, sizes.get(c, 0))) for c, most in sample.items()}
    calm_weight = kept[1] / kept[0]
    share = F.create_map(*[F.lit(x) for c in sample for x in (c, kept[c] * 2**30)])
    chosen = known.filter(F.shiftrightunsigned(F.xxhash64("labelled"), 34) < share[F.col("toxic")]).limit(2 * sum(sample.values()))
    texts = docs.filter("text is not null").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("labelled")) \
        .select(F.col("labelled"), F.col("text").cast("string").alias("text"), "toxic")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        rows = sorted((r["labelled"], r["text"], r["toxic"]) for batch in batches for r in batch.to_pylist())
        values, bias = train([r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64), steps, calm_weight) if rows else (np.zeros(1 << BUCKET_BITS), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([bias])], names=["numbers", "bias"])
    r = texts.repartition(1).mapInArrow(fitted, "numbers binary, bias double").collect()
    return (np.frombuffer(r[0]["numbers"]), r[0]["bias"]) if r else (np.zeros(1 << BUCKET_BITS), 0.0)


def score_texts(data: np.ndarray, bounds: np.ndarray, numbers: np.ndarray, bias: float) -> np.ndarray:
    data = LOWER[data]
    words = words_of(data, bounds)
    log_odds = np.full(len(bounds) - 1, bias)
    if len(words.start):
        _, some, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
        bucket, first = subwords(data, words.start[some], words.end[some])
        each = _mean(numbers[bucket][:, None], first)[:, 0]
        log_odds += sums_by_text(each[which], words.first) / np.maximum(1, np.diff(words.first))
    return 1 / (1 + np.exp(-np.clip(log_odds, -700, 700)))


def score(docs: DataFrame, numbers: np.ndarray, bias: float) -> DataFrame:
    """The rows of docs with score (0 to 1) and predicted (1 from 0.5 on), from the whole text alone; a null or empty text gets
    the score of no words. Columns of docs with these two names are replaced."""
    rest = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((numbers, bias))
    schema = T.StructType([*rest.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch, data, bounds in slices(batches, most=SLICE):
            value = score_texts(data, bounds, *shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])
    return rest.mapInArrow(rows, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    numbers, bias = fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0))
    return score(docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text"), numbers, bias).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op9_toxicity": op9_toxicity}
#: A fitted model; tests hold its held-out accuracy and its scoring against a word-by-word sum.
ORACLES: dict[str, str] = {}
