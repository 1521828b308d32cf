import random

import numpy as np

from furrow.llm.frames import table
from furrow.llm.toxicity import BUCKET_BITS, fit, op9_toxicity, score, score_texts, subwords, train

CALM = "the of and to in house river mill bread market day town people liked walking there often with friends".split()
RUDE = "idiot moron scum pathetic".split()


def text(rng, rude):
    words = rng.choices(CALM, k=rng.randint(40, 200))
    for _ in range(rng.randint(2, 5) if rude else 0):
        words[rng.randrange(len(words))] = rng.choice(RUDE)
    return " ".join(words)


def test_subwords_of_a_word():
    np.seterr(over="ignore")
    data = np.frombuffer(b"idiot x", dtype=np.uint8)
    both, first = subwords(data, np.array([0, 6]), np.array([5, 7]))
    # <idiot>: the word, five 3-grams, four 4-grams, three 5-grams; <x>: the word and one 3-gram.
    assert first.tolist() == [0, 13, 15]
    alone, _ = subwords(np.frombuffer(b"x", dtype=np.uint8), np.array([0]), np.array([1]))
    assert sorted(both[13:]) == sorted(alone)


def test_scores_are_word_means():
    np.seterr(over="ignore")
    numbers = np.random.default_rng(0).normal(size=1 << BUCKET_BITS)
    texts = ["Idiot people", "", "x", "été idiot idiot"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    got = score_texts(data, np.cumsum([0] + [len(t.encode()) for t in texts]), numbers, 0.25)
    for t, g in zip(texts, got):
        each = []
        for w in t.lower().encode().split():
            bucket, _ = subwords(np.frombuffer(w, dtype=np.uint8), np.array([0]), np.array([len(w)]))
            each.append(numbers[bucket].mean())
        assert abs(g - 1 / (1 + np.exp(-(0.25 + (np.mean(each) if each else 0))))) < 1e-9


def test_training_finds_words_and_misspellings():
    np.seterr(over="ignore")
    rng = random.Random(1)
    toxic = np.array([k % 3 == 0 for k in range(300)]).astype(np.int64)
    numbers, bias = train([text(rng, t) for t in toxic], toxic)

    def said(t):
        data = np.frombuffer(t.encode(), dtype=np.uint8)
        return score_texts(data, np.array([0, len(data)]), numbers, bias)[0]
    new = [(text(rng, t), t) for t in [0, 1] * 50]
    assert sum((said(t) >= 0.5) == want for t, want in new) >= 95
    calm = " ".join(CALM * 4)
    assert said(calm + " idiott pathetik moronn scumm") > said(calm)


def test_odd_rows(spark):
    rng = random.Random(2)
    rows = [(k, text(rng, k % 2)) for k in range(80)]
    docs = spark.createDataFrame([*rows, (80, None), (81, ""), (82, "x" * 100_000), (3, rows[3][1]), (None, "calm")], "doc_id long, text string")
    labels = spark.createDataFrame([*[(k, 1, k % 2) for k in range(80)], (3, 1, 1), (81, None, None), (80, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    numbers, bias = fit(docs, labels, steps=20)
    got = score(docs.selectExpr("*", "1 score", "'x' predicted"), numbers, bias).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    numbers, bias = fit(docs.limit(0), labels, steps=2)
    assert (numbers == 0).all()
    assert score(docs.limit(0), numbers, bias).count() == 0


def test_held_out_labels(spark, sf):
    rows = op9_toxicity(spark, sf.replace("sf0.001", "sf0.1")).join(table(spark, sf.replace("sf0.001", "sf0.1"), "labels"), "doc_id").collect()
    held = [(r.predicted, r.toxic, r.score) for r in rows if r.held_out]
    calm, rude = [s for _, t, s in held if t == 0], [s for _, t, s in held if t == 1]
    assert len(rude) >= 30 and np.mean([[a > b for b in calm] for a in rude]) > 0.8
