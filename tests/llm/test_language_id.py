import numpy as np
import pytest

from furrow.llm.frames import table
from furrow.llm.language_id import VOCABULARY, LanguageModel, Pieces, identify, learn, op8_language_id


@pytest.fixture(scope="module")
def pieces():
    return Pieces.read(VOCABULARY)


def model_of(pieces, seed=0):
    p = np.random.default_rng(seed).dirichlet(np.full(len(pieces.rows), 0.5), size=2).T
    return LanguageModel(["aa", "bb"], pieces, np.log(p + 1e-12))


def all_segmentations(word, log_p, rows):
    """Probability of a word by going through its segmentations one by one."""
    if not word:
        return 1.0
    return sum(np.exp(log_p[rows[word[:k]]]) * all_segmentations(word[k:], log_p, rows) for k in range(1, min(16, len(word)) + 1) if word[:k] in rows)


def test_every_piece_is_found(pieces):
    assert (pieces.find(pieces.hashes[:-1]) == np.arange(len(pieces.rows))).all()
    assert len(set(pieces.hashes[:-1].tolist())) == len(pieces.rows)


def test_forward_sums_all_segmentations(pieces):
    np.seterr(over="ignore")
    model = model_of(pieces)
    rows = {p: k for k, p in enumerate(pieces.rows)}
    for text in ["then", "The cat", "été", "a1 b", "x" * 12, "Größe", " zu\n\tdem "]:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        got = model.scores(data, np.array([0, len(data)]))[0]
        for k in range(2):
            want = sum(np.log(all_segmentations(b" " + w.lower(), model.log_p[:, k], rows)) for w in text.encode().split())
            assert abs(got[k] - want) < 1e-6 * abs(want)


def test_scores_do_not_depend_on_neighbours(pieces):
    np.seterr(over="ignore")
    model = model_of(pieces)
    texts = ["then and there", "", "été " * 50, "w" * 100, "then 12 there"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    bounds = np.cumsum([0] + [len(t.encode()) for t in texts])
    together = model.scores(data, bounds)
    for k, t in enumerate(texts):
        alone = np.frombuffer(t.encode(), dtype=np.uint8)
        assert np.allclose(together[k], model.scores(alone, np.array([0, len(alone)]))[0])


def test_odd_rows(spark, sf):
    model = learn(table(spark, sf, "documents"))
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (3, "12 34 !!", 7, "x"), (4, "— « »", 7, "x"), (5, "the of and to in is that", 7, "x"), (5, "the of and to in is that", 7, "x"), (None, "der und die das ist", 7, "x"), (6, "w" * 200_000, 7, "x"), (7, "日本", 7, "x")]
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify(spark.createDataFrame(rows, "doc_id int, text string, score int, lang_pred string"), model).collect()]
    assert [g[1] for g in got[:7]] == ["und"] * 4 + ["en", "en", "de"]
    assert all(g[2] == 0 for g in got[:4]) and all(0 < g[2] <= 1 for g in got[4:]) and got[8][1] != "und"
    none = learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in identify(spark.createDataFrame(rows, "doc_id int, text string, a int, b string"), none).collect()} == {"und"}
    assert identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_held_out_accuracy(spark, sf):
    got = op8_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 20
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
