"""Personal data by candidate gradient boosting.

Fixed patterns give the base spans. Beside them, generators of high recall propose overlapping spans for the same four kinds in looser spellings: an
address written with (at) and dot, an IP number with [.], a card number with other separators, a phone number without its +. Boosted trees
judge each proposal by its format (digits, groups, checksum, ends) and its context (characters and cue words beside it); a threshold for each
kind, calibrated on documents that the trees haven't seen, selects what is added. Base spans always stay; added ones overlap neither them nor one another.

No table says which spans are personal data, so labels are made from the base spans of a bounded sample of documents: a base span is a
positive example, so are respellings of it put in its place; a proposal beside all base spans is a negative one, so are broken
respellings (wrong checksum, part over 255, too few digits, no domain). Examples are made where the documents lie; one task fits the
trees on at most EXAMPLES of them.

All scanning is linear in the text: a search for an address starts at its @, and runs of digits are taken whole.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.frames import fold, stored, table, text_batches

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: About so many documents give examples, chosen by a hash of id and text; of the examples, at most so many are used.
SAMPLE = 20_000
EXAMPLES = 100_000
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Added spans of a kind must be right in this share of the held-out examples.
PRECISION = 0.99
CONTEXT = 30

# What the base kinds look like.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_NUMBER = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE_NUMBER = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser spellings, and words that stand beside each kind.
AT = re.compile(r"\s?(?:@|\(at\)|\[at\]|\{at\})\s?|\sat\s(?=[A-Za-z0-9-]{1,63}(?:\.|\sdot\s|\s?[(\[{]dot[)\]}])\s?[A-Za-z])", re.I)
LOOSE_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\.|\[\.\]|\sdot\s|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?)[A-Za-z0-9-]{1,63}){0,8}", re.I)
DOT = re.compile(r"\[\.\]|\s?(?:\(dot\)|\[dot\]|\{dot\})\s?|\sdot\s|\.", re.I)
NUMBER = re.compile(r"(?<![0-9])[+(]?[0-9](?:[ ().\-/\[\]]{0,3}[0-9]){3,40}")
GROUP = re.compile(r"[0-9]+")
CUES = (("mail", "contact", "write"), ("ip", "host", "address", "server"), ("card", "visa", "credit", "payment"), ("tel", "phone", "call", "mobile", "fax"))

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if k % 2 == 0 else doubled[int(d)] for k, d in enumerate(reversed(digits))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        # The longest run before the @ is the leftmost start; it can't reach over an earlier @.
        start = free + len(text[free:at].rstrip(LOCAL))
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append((EMAIL, start, host.end()))
        free = host.end() if host else at + 1
        at = text.find("@", free)
    found += [(IP, *m.span()) for m in IP_NUMBER.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((CARD, *m.span()))
    if "+" in text:
        found += [(PHONE, *m.span()) for m in PHONE_NUMBER.finditer(text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def proposals(text: str) -> list[Span]:
    """Overlapping spans that might be personal data in some spelling."""
    found, free = set(), 0
    for mark in AT.finditer(text):
        start = free + len(text[free:mark.start()].rstrip(LOCAL))
        free = mark.end()
        host = LOOSE_HOST.match(text, mark.end())
        if start < mark.start() and host:
            found.add((EMAIL, start, host.end()))
            dots = [m.start() for m in DOT.finditer(text, host.start(), host.end())]
            if len(dots) > 1:
                found.add((EMAIL, start, dots[-1]))
    for region in NUMBER.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, *region.span())]
        spans = {region.span()}
        if len(groups) > 1:  # a neighbouring number may have been taken along
            spans |= {(region.start(), groups[-2][1]), (groups[1][0], region.end())}
        for a in range(len(groups) - 3):
            spans.add((groups[a][0], groups[a + 3][1]))
        for a, b in spans:
            inner = [g for g in groups if a <= g[0] and g[1] <= b]
            n = sum(y - x for x, y in inner)
            if len(inner) == 4 and all(y - x <= 4 for x, y in inner):
                found.add((IP, a, b))
            if 12 <= n <= 20:
                found.add((CARD, a, b))
            if 7 <= n <= 16:
                found.add((PHONE, a, b))
    return sorted(found, key=lambda s: (s[1], s[2], s[0]))


def _edge(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isdigit() else 3 if c.isalpha() else 4 if c in "\"'`" else 5 if c in "=:/#_-+" else 6


def features(text: str, span: Span) -> list[float]:
    """Numbers on a proposal's format and its context of CONTEXT characters on both sides."""
    kind, start, end = span
    said = text[start:end]
    groups = GROUP.findall(said)
    sizes = [len(g) for g in groups]
    digits = "".join(groups)
    marks = [m for m in re.split(r"[0-9A-Za-z]+", said) if m]
    before, after = text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    near = before.lower() + " " + after.lower()
    mark = AT.search(said) if kind == EMAIL else None
    labels = DOT.split(said[mark.end():]) if mark else [""]
    return [
        *(float(kind == k) for k in range(4)), len(said), len(digits), len(groups), max(sizes, default=0), min(sizes, default=0), float(len(set(sizes)) <= 1),
        float(bool(digits) and luhn(digits)), len(set(marks)), max(map(len, marks), default=0), sum(m.count(" ") for m in marks), sum(m.count(".") for m in marks), sum(m.count("-") for m in marks),
        sum(m.count("/") for m in marks), float(said[:1] == "+"), float(digits[:2] == "00"), float("(" in said), float("[" in said), float(all(map(_small, groups))), sum(len(g) > 1 and g[0] == "0" for g in groups),
        float(mark is not None and "@" in mark.group()), float(mark is not None and mark.group() != mark.group().strip()), mark.start() if mark else -1, len(labels), len(labels[-1]), float(labels[-1].isalpha()),
        _edge(before[-1:]), _edge(after[:1]), _edge(after[1:2]), sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), float(any(cue in near for cue in CUES[kind])),
    ]


WIDTH = len(features("x", (0, 0, 1)))


def respelt(said: str, kind: int, rng: random.Random) -> tuple[str, str]:
    """Another spelling of a base span, and a broken one."""
    if kind == EMAIL:
        local, _, host = said.partition("@")
        at, dot = rng.choice([(" @ ", "."), ("(at)", "."), (" (at) ", "(dot)"), ("[at]", "[.]"), (" at ", " dot "), (" [at] ", " [dot] "), (" at ", ".")])
        return local + at + dot.join(host.split(".")), rng.choice([local + at + host.split(".")[0], local + at + "-" + dot + "1"])
    if kind == IP:
        dot, parts = rng.choice(["[.]", " . ", "(.)"]), said.split(".")
        return dot.join(parts), dot.join([*parts[:3], str(rng.randint(256, 9999))])
    digits = re.sub(r"[^0-9]", "", said)
    if kind == CARD:
        cut = [digits[k:k + 4] for k in range(0, len(digits), 4)]
        mark = rng.choice([".", "  ", " - ", "/"])
        place = rng.randrange(len(digits))
        wrong = digits[:place] + str((int(digits[place]) + rng.randint(1, 9)) % 10) + digits[place + 1:]
        return mark.join(cut), rng.choice(["", " ", mark]).join(wrong[k:k + 4] for k in range(0, len(wrong), 4))
    rest = digits[-10:]
    shown = rng.choice([f"00{digits[:-10] or '1'} {rest[:3]} {rest[3:6]} {rest[6:]}", f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{rest[:3]}/{rest[3:6]}-{rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}"])
    return shown, rng.choice([rest[:7], f"{rest[:4]}-{rest[4:6]}-{rest[6:8]}", digits + rest[:2], f"{rest[:3]}.{rest[3:9]}", f"{rest[:4]}-{rest[4:8]}"])


def examples(text: str) -> list[tuple[int, list[float]]]:
    """(label, features) of the text's proposals and of respelt and broken base spans in their places."""
    base, out = base_spans(text), []
    known = set(base)
    for span in proposals(text):
        if span in known:
            out.append((1, features(text, span)))
        elif not any(s[1] < span[2] and span[1] < s[2] for s in base):
            out.append((0, features(text, span)))
    rng = random.Random(zlib.crc32(text.encode()))
    for kind, start, end in base:
        before, after = text[max(0, start - 2 * CONTEXT):start], text[end:end + 2 * CONTEXT]
        for label, said in zip((1, 0), respelt(text[start:end], kind, rng)):
            put = before + said + after
            for span in proposals(put):
                whole = span == (kind, len(before), len(before) + len(said))
                if whole or label == 0 and span[1] < len(before) + len(said) and len(before) < span[2]:
                    out.append((label, features(put, span)))
    return out


@dataclass
class Model:
    """Trees as full binary trees of (feature, cut) and leaf values, their shares summed into log-odds; per kind the calibration (slope, offset) and threshold."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    calibration: np.ndarray
    threshold: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        kind = x[:, :4].argmax(axis=1)
        return 1 / (1 + np.exp(-np.clip(self.calibration[kind, 0] * self.log_odds(x) + self.calibration[kind, 1], -500, 500)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Model:
    """Newton boosting of trees of DEPTH levels on binned features, under logistic loss."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    inner = (1 << DEPTH) - 1
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    odds = np.full(len(y), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-odds))
        grad, bend = y - p, p * (1 - p)
        at = np.zeros(len(y), dtype=np.int64)
        for level in range(DEPTH):
            first = (1 << level) - 1
            nodes = 1 << level
            gains = np.full((nodes, x.shape[1]), -1.0)
            places = np.zeros((nodes, x.shape[1]), dtype=np.int64)
            for j, c in enumerate(cuts):
                if len(c) == 0:
                    continue
                slot = (at - first) * (len(c) + 1) + binned[:, j]
                g, h = (np.bincount(slot, weights=w, minlength=nodes * (len(c) + 1)).reshape(nodes, -1) for w in (grad, bend))
                gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
                gt, ht = g.sum(axis=1, keepdims=True), h.sum(axis=1, keepdims=True)
                gain = gl ** 2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt ** 2 / (ht + 1)
                places[:, j] = gain.argmax(axis=1)
                gains[:, j] = gain.max(axis=1)
            best = gains.argmax(axis=1)
            for k in range(nodes):
                if gains[k, best[k]] > 1e-6:
                    feature[t, first + k], cut[t, first + k] = best[k], cuts[best[k]][places[k, best[k]]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[t, at]] > cut[t, at])
        end = at - inner
        g, h = (np.bincount(end, weights=w, minlength=inner + 1) for w in (grad, bend))
        leaf[t] = RATE * g / (h + 1)
        odds += leaf[t][end]
    return Model(feature, cut, leaf, start, np.tile([1.0, 0.0], (4, 1)), np.full(4, 2.0))


def fit_model(x: np.ndarray, y: np.ndarray, held: np.ndarray, precision: float = PRECISION) -> Model:
    """Trees from the examples that aren't held; calibration and thresholds of each kind from those that are. A kind for which no threshold
    reaches the precision, or without held-out examples of both labels, adds nothing (threshold 2)."""
    if not len(y) or y[~held].min(initial=1) == y[~held].max(initial=0) or held.all():
        return Model(np.zeros((0, 7), dtype=np.int64), np.zeros((0, 7)), np.zeros((0, 8)), 0.0, np.tile([1.0, 0.0], (4, 1)), np.full(4, 2.0))
    model = boost(x[~held], y[~held])
    kind, odds = x[:, :4].argmax(axis=1), model.log_odds(x)
    for k in range(4):
        mine = held & (kind == k)
        if not (y[mine] == 1).any() or not (y[mine] == 0).any():
            continue
        z, label = np.stack([odds[mine], np.ones(mine.sum())], axis=1), y[mine]
        w = np.array([1.0, 0.0])
        for _ in range(25):  # Newton steps of a ridged logistic fit
            p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2), z.T @ (label - p) - 0.1 * (w - [1.0, 0.0]))
            w = w + np.clip(step, -1, 1)
        model.calibration[k] = [max(w[0], 1e-3), w[1]]
        p = model.probability(x[mine])
        order = np.argsort(-p, kind="stable")
        right, n = np.cumsum(label[order]), np.arange(1, len(p) + 1)
        last = np.flatnonzero((right / n >= precision) & (np.diff(p[order], append=-1) < 0))
        if len(last):
            model.threshold[k] = max(0.5, p[order][last[-1]])
    return model


def learn(docs: DataFrame, sample: int = SAMPLE, most: int = EXAMPLES) -> Model:
    """A model from a sample of docs (doc_id, text)."""
    text_batches(docs.sparkSession)
    share = min(1.0, sample / max(1, docs.count()))
    some = docs.filter("text is not null").select("doc_id", F.col("text").cast("string").alias("text")) \
        .filter(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 34) < int(share * 2**30)).select((fold("doc_id", 5) == 0).alias("held"), "text")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = examples(text)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([held] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], names=["held", "label", "x"])
    rows = stored(some.mapInArrow(made, "held boolean, label int, x array<double>"))
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.filter(F.shiftrightunsigned(F.xxhash64("x"), 34) < int(share * 2**30))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((tuple(r["x"]), r["label"], r["held"]) for batch in batches for r in batch.to_pylist())
        m = fit_model(np.array([g[0] for g in got], dtype=np.float64).reshape(-1, WIDTH), np.array([g[1] for g in got], dtype=np.float64), np.array([g[2] for g in got], dtype=bool))
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in (m.feature, m.cut, m.leaf, np.array([m.start]), m.calibration, m.threshold)], names=list("abcdef"))
    r = rows.repartition(1).mapInArrow(fitted, "a binary, b binary, c binary, d binary, e binary, f binary").collect()
    if not r:
        return fit_model(np.zeros((0, WIDTH)), np.zeros(0), np.zeros(0, dtype=bool))
    inner = (1 << DEPTH) - 1
    return Model(np.frombuffer(r[0].a, dtype=np.int64).reshape(-1, inner), np.frombuffer(r[0].b).reshape(-1, inner), np.frombuffer(r[0].c).reshape(-1, inner + 1), float(np.frombuffer(r[0].d)[0]),
                 np.frombuffer(r[0].e).reshape(4, 2), np.frombuffer(r[0].f))


def select(texts: list[str], model: Model) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text. The likeliest proposals are added first; ties go to the earlier, then longer one."""
    base = [base_spans(t) for t in texts]
    offers = []
    for k, t in enumerate(texts):
        taken = np.array([s[1:] for s in base[k]]).reshape(-1, 2)
        taken = taken[np.argsort(taken[:, 0], kind="stable")]
        reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]
        for span in proposals(t):
            before = np.searchsorted(taken[:, 0], span[2]) - 1  # of the base spans that start before its end, the farthest end
            if before < 0 or reach[before] <= span[1]:
                offers.append((k, span, features(t, span)))
    added: list[list[Span]] = [[] for _ in texts]
    if offers:
        x = np.array([o[2] for o in offers], dtype=np.float64)
        p = model.probability(x)
        chosen = np.flatnonzero(p >= model.threshold[x[:, :4].argmax(axis=1)])
        by_text: dict[int, list] = {}
        for i in chosen.tolist():
            by_text.setdefault(offers[i][0], []).append((-p[i], offers[i][1][1], -offers[i][1][2], offers[i][1]))
        for k, mine in by_text.items():
            covered: set[int] = set()  # proposals are short, so their places can be listed
            for *_, span in sorted(mine):
                places = range(span[1], span[2])
                if covered.isdisjoint(places):
                    covered.update(places)
                    added[k].append(span)
    return [(b, sorted(a, key=lambda s: (s[1], s[0]))) for b, a in zip(base, added)]


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], s[0])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Runs of rows of about a million characters, so that proposals don't pile up."""
    texts, first, size = [t or "" for t in batch.column("text").to_pylist()], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= 1_000_000 or k == len(texts) - 1:
            yield batch.slice(first, k + 1 - first), texts[first:k + 1]
            first, size = k + 1, 0


def find(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with base and added (arrays of kind, start, end in code points, the end outside) and redacted (the text without both).

    A null text counts as empty and has none. Repeated rows are judged alike; columns of docs with these names are replaced.
    """
    rest = docs.drop("base", "added", "redacted").withColumn("text", F.col("text").cast("string"))
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rest.schema.fields, T.StructField("base", SPANS), T.StructField("added", SPANS), T.StructField("redacted", T.StringType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                found = select(texts, shared.value)
                spans = [pa.array([[{"kind": KINDS[s[0]], "start": s[1], "end": s[2]} for s in both[side]] for both in found], kind) for side in (0, 1)]
                clean = pa.array([redacted(t, b + a) for t, (b, a) in zip(texts, found)])
                yield pa.RecordBatch.from_arrays([*batch.columns, *spans, clean], names=[*batch.schema.names, "base", "added", "redacted"])
    return rest.mapInArrow(rows, schema)


def digests(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans (base and added, kind:start:end by start, then kind), n_added."""
    text_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def said(spans: list[Span]) -> str:
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], s[0], s[2])))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _texts(whole):
                found = select(texts, shared.value)
                counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found]), pa.array([said(b + a) for b, a in found]),
                                                  pa.array([len(a) for _, a in found], pa.int64())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(rows, schema)


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs, learn(docs))


QUERIES = {"op11_personal_data": op11_personal_data}
#: A fitted model; tests hold the base spans to plain patterns and SQL, and the added ones to held-out respellings.
ORACLES: dict[str, str] = {}
