import hashlib
import random
from collections import defaultdict

import pytest

from furrow.llm.source_mix import mix, targets

SCHEMA = "doc_id long, text string, source string"


def filled(sizes, share=1.5, epochs=2, weights=(3, 1, 2)):
    """Targets by the rule itself: share out by weight, stop at the caps, share out the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        each = left / sum(weight[s] for s in open_)
        full = set()
        for s in open_:
            target[s] += each * weight[s]
        left = 0.0
        for s in open_:
            if target[s] >= epochs * sizes[s]:
                left += target[s] - epochs * sizes[s]
                target[s] = epochs * sizes[s]
                full.add(s)
        open_ -= full
    return target


def brute(rows):
    size = lambda text: len((text or "").encode().split())
    key = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    by = defaultdict(list)
    for d, text, s in rows:
        by[s].append((key(d), d is not None, d or 0, size(text), d))
    totals = {s: sum(r[3] for r in v) for s, v in by.items()}
    target, out = filled(totals), []
    for s, v in by.items():
        budget, ahead = int(target[s] + 0.5), 0
        for _, _, _, n, d in sorted(v, key=lambda r: r[:4]):
            out.append((d, s, n, totals[s], sum(max(0, min(n, budget - e * totals[s] - ahead)) for e in (0, 1))))
            ahead += n
    return sorted(out, key=repr), target


@pytest.mark.parametrize("range_rows", [20_000, 3])
def test_against_brute_force(spark, range_rows):
    rng = random.Random(6)
    rows = [(k, rng.choice([None, ""] + ["w " * rng.randint(0, 90)] * 9), rng.choice(["a", "a", "a", "a", "b", "é", "Z", None])) for k in range(300)]
    rows += rows[:5] + [(None, "x y", "a"), (None, "x y z", "a"), (999, "q " * 100_000, "b")]
    got = mix(spark.createDataFrame(rows, SCHEMA), range_rows=range_rows).collect()
    want, target = brute(rows)
    assert sorted(((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got), key=repr) == want
    given = defaultdict(int)
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source]) and 0 <= r.taken <= 2 * r.size
        given[r.source] += r.taken
    assert all(abs(given[s] - target[s]) <= 0.5 for s in given)


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 0, "d": 500, None: 3}, {f"s{k:02}": 100 + 17 * k % 60 for k in range(20)} | {"s00": 1500}, {"a": 5, "b": 5}, {f"{k}": 3 ** k for k in range(12)}])
def test_targets_stop_at_caps(spark, sizes):
    got = {r.source: r.target for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    want = filled(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes)


def test_clashing_columns_and_no_rows(spark):
    clash = spark.createDataFrame([(1, "a b", "s", 7, 8, 9)], "doc_id int, text string, source string, size int, key int, place int")
    r = mix(clash).collect()[0]
    assert (r.size, r.source_size, r.target, r.taken) == (2, 2, 3.0, 3)
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mix(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()[0].taken == 0
