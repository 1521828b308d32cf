import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from furrow.llm.frames import table
from furrow.llm.lm_scoring import Filter, _low, count_of, levels_of, lm_scores, op7_lm_scoring, segment_of

SCHEMA = "doc_id long, text string"


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def fold(doc_id, n=10):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def brute(rows):
    """Base columns, and the model's score with exact but quantised bigram counts."""
    train = [tokens(t) for d, t in rows if fold(d) != 0]
    one = Counter(w for words in train for w in words)
    two = Counter(pair for words in train for pair in zip([None, *words], words))
    n, v = sum(one.values()), len(one)
    out = []
    for d, t in rows:
        words = tokens(t)
        base = [math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words]
        score = 0.0
        for before, w, b in zip([None, *words], words, base):
            c = float(count_of(levels_of(np.array([two[before, w]])))[0]) if two[before, w] else 0.0
            score += math.log10(0.6 * min(c, one[before]) / one[before] + 0.4 * 10 ** b) if one[before] else b
        out.append((d, fold(d) == 0, len(words), sum(one[w] > 0 for w in words), n, sum(base), score))
    return sorted(out, key=repr)


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5])), (a, b)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=repr)


def made():
    rng = random.Random(2)
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choice(["The", "the", "OF", "été", "a", "b", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 120)))) for k in range(150)]
    return rows + [(200, None), (201, ""), (202, " \t"), (None, "the of"), (3, rows[3][1]), (203, "x" * 100_000), (204, "a b " * 30_000)]


@pytest.mark.parametrize("broadcast_bytes", [128_000_000, 700])
def test_against_brute_force(spark, broadcast_bytes):
    rows = made()
    want = brute(rows)
    got = result(lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(3), broadcast_bytes=broadcast_bytes, chunk_bytes=40_000))
    near(got, want)
    # The filter may report a bigram that isn't there, never miss one: scores can only be higher.
    off = [g[6] - w[6] for g, w in zip(got, want)]
    assert all(d > -1e-6 * max(1, abs(w[6])) for d, w in zip(off, want))
    assert sum(d < 0.02 * g[2] + 1e-6 for d, g in zip(off, got)) > 0.9 * len(got)


def test_number_of_broadcasts_changes_nothing(spark):
    docs = spark.createDataFrame(made(), SCHEMA)
    a, b = (result(lm_scores(docs, broadcast_bytes=n)) for n in (128_000_000, 500))
    assert [x[:5] for x in a] == [x[:5] for x in b] and np.allclose([x[5:] for x in a], [x[5:] for x in b])


def test_filter_finds_every_level():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        hashes = rng.integers(0, 1 << 56, 20_000, dtype=np.uint64)  # range 0 of 256
        counts = np.maximum(1, (rng.pareto(1, len(hashes)) * 2).astype(np.int64))
        segment, size = segment_of(_low(hashes), counts)
        f = Filter({0: size}, [(0, segment)], 8)
        mine, got = f.counts(hashes)
        want = count_of(levels_of(counts))
        assert (mine == np.arange(len(hashes))).all() and (got >= want - 1e-9).all()
        assert (got == want).mean() > 0.93
        _, other = f.counts(rng.integers(0, 1 << 56, 20_000, dtype=np.uint64))
        assert (other > 0).mean() < 0.05


def test_clashing_columns_and_no_rows(spark):
    clash = spark.createDataFrame([(1, "a b", 1, 2, 3, 4)], "doc_id int, text string, word int, chunk int, n int, held_out int")
    near(result(lm_scores(clash)), brute([(1, "a b")]))
    assert lm_scores(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    got, want = result(op7_lm_scoring(spark, sf)), brute(rows)
    near(got, want)
    held = [(g[5] / g[2], g[6] / g[2]) for g in got if g[1]]
    assert sum(m for _, m in held) > sum(b for b, _ in held)  # the model does better than unigrams on unseen texts
