import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from furrow.llm import substring_dedup as module
from furrow.llm.frames import table
from furrow.llm.substring_dedup import op1_substring_dedup, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, window=20):
    """Straight from the definition: every window of every document, earliest first."""
    texts = {}
    for key, text in rows:
        if key not in texts or (text is not None and (texts[key] is None or text < texts[key])):
            texts[key] = text
    seen, out = set(), {}
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        words = (texts[key] or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i:i + window])
            if run in seen:
                gone[i:i + window] = [True] * window
            seen.add(run)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out[key] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)


def result(df):
    rows = df.collect()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def made(seed, n=120):
    rng = random.Random(seed)
    word = lambda: rng.choice("a b c d e f g h".split())
    passages = [" ".join(word() for _ in range(rng.randint(15, 70))) for _ in range(6)]
    rows = []
    for k in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else "".join(word() + rng.choice([" ", "  ", "\n", "\t ", "\x0b"]) for _ in range(rng.randint(0, 60))))
        rows.append((k * 3 % 101 + k, " ".join(parts)))
    return rows


@pytest.mark.parametrize("group_rows", [20_000, 3])
def test_against_brute_force(spark, group_rows):
    rows = made(5) + [(1000, "x y " * 200), (1001, "x y " * 150 + "z"), (1002, "été   " * 30), (1003, "été   " * 31)]
    assert result(substring_dedup(frame(spark, rows).repartition(3), group_rows=group_rows)) == brute(rows)


def test_odd_rows(spark):
    run = " ".join(f"w{i}" for i in range(25))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, run), (4, run), (4, "zz " + run), (None, run + " tail"), (5, "w" * 300_000), (6, "q " * 120_000), (7, run.replace(" ", "\n"))]
    assert result(substring_dedup(frame(spark, rows))) == brute(rows)


def test_extra_columns_and_no_rows(spark):
    clash = spark.createDataFrame([(1, "a b", 3, 4, 5, "x")], "doc_id int, text string, id int, prefix int, n long, open string")
    assert result(substring_dedup(clash)) == brute([(1, "a b")])
    assert substring_dedup(frame(spark, [])).count() == 0


def test_query_over_the_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert result(op1_substring_dedup(spark, sf)) == brute(rows)


def test_subtrees_of_many_small_groups_take_little_memory():
    def batches(rows, each=500):
        rng = np.random.default_rng(1)
        for at in range(0, rows, each):
            id_ = np.arange(at, at + each)
            spans = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 32)) for _ in range(each)]
            yield pa.RecordBatch.from_arrays([pa.array(id_ // 2), pa.array(np.zeros(each, np.int32)), pa.array(id_), pa.array(np.zeros(each, np.int32)), pa.array(np.full(each, 13, np.int32)),
                                              pa.array(np.full(each, 2)), pa.array(spans)], names=["prefix", "part", "id", "start", "n", "total", "span"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in module._subtree_rows(module.WINDOW, module.GROUP_ROWS)(batches(25_000))) == 0
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()
