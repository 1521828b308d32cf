import random
import re

import pytest

from furrow.llm.decontamination import contaminated

SCHEMA, ITEMS = "doc_id long, text string", "item_id long, text string"


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = split(text)
        for i, item in items:
            v = split(item)
            n = min(13, len(v))
            if n < 5:
                continue
            for q in range(len(v) - n + 1):
                for p in range(len(w) - n + 1):
                    differ = sum(a != b for a, b in zip(w[p:p + n], v[q:q + n]))
                    if differ <= (2 if n == 13 else 0):
                        count, least = out.get((d, i), (0, 9))
                        out[d, i] = (count + 1, min(least, differ))
    return out


def result(df):
    rows = df.collect()
    got = {(r.doc_id, r.item_id): (r.n_stretches, r.substitutions) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("broadcast", [300_000, 0])
def test_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr("furrow.llm.decontamination.BROADCAST_SEEDS", broadcast)
    rng = random.Random(4)
    word = lambda: rng.choice("the of a Été b3 zu un que".split())
    items = [(k, " ".join(word() + rng.choice(["", ",", ".\n"]) for _ in range(n))) for k, n in enumerate([4, 5, 7, 12, 13, 14, 20, 30, 7])]
    items += [(20, None), (21, ""), (22, items[6][1])]
    docs = []
    for k in range(60):
        parts = [word() for _ in range(rng.randint(0, 30))]
        passage = split(rng.choice(items)[1])
        for _ in range(rng.randint(0, 3)):
            if passage:
                passage[rng.randrange(len(passage))] = "other"
        at = rng.randint(0, len(parts))
        docs.append((k, rng.choice([" ", " - ", "\n"]).join(parts[:at] + [p.upper() for p in passage] + parts[at:])))
    docs += [(90, None), (91, ""), (92, "..."), (93, items[6][1]), (None, items[7][1]), (94, "q " * 40_000)]
    assert result(contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_clashing_columns_and_no_rows(spark):
    text = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, text, 1, 2, 3)], "doc_id int, text string, key int, kind int, t0 int")
    items = spark.createDataFrame([(7, text, 1, 2)], "item_id int, text string, seed int, doc_id int")
    assert result(contaminated(docs, items)) == {(1, 7): (3, 0)}
    assert contaminated(spark.createDataFrame([], SCHEMA), items).count() == 0
    assert contaminated(docs, spark.createDataFrame([], ITEMS)).count() == 0
