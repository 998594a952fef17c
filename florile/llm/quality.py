"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of n-grams (n = 1, 2 of its lower-cased words; n = 1, 2, 3 of its word shapes), hashed to 2**BITS.
A word's shape says which kinds of characters it begins and ends with and holds, and whether it repeats the word before it.
Indicators are scaled by the classes' log-count ratios, counted over all labelled training rows, and the scaled vector is brought to
length one. A linear model with hinge loss is fitted to a bounded sample (of each class the rows of the lowest hash, SAMPLE of them, or
as many as have FIT_BYTES of features together) by dual coordinate descent, and a logistic curve turns margins into scores, weighing the classes as
they occur among all labelled rows. Training labels come only from rows whose crc32(doc_id as text) mod 5 is not 0.

Defined results: a null or empty text has no features and gets the score of the bias alone; rows without, or with a null, label don't
train; one label per doc_id (the smallest) counts; with fewer than two classes every score is the share of ones (1 without labels);
null doc_ids are not held out; an empty table gives an empty result; other columns stay.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, lean, mix, scratch, span_hashes, word_spans

BITS = 18
#: Labelled rows of each class that the linear model is fitted to, at most, and bytes of their features (4 each): a bound of the number of
#: rows that come to the driver, whatever their length.
SAMPLE, FIT_BYTES = 3000, 64 << 20
#: Bytes of a text whose features are made at once.
AT_ONCE = 4 << 20
#: Rows of labels up to which they are broadcast (about 16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
THRESHOLD = 0.3
BLOCK = 4096

#: The kind of each byte as a bit: lower case, upper case, digit, letter beyond ASCII, sentence mark, other sign.
KIND = np.full(256, 32, np.uint8)
KIND[ord("a") : ord("z") + 1], KIND[ord("A") : ord("Z") + 1], KIND[ord("0") : ord("9") + 1], KIND[128:] = 1, 2, 4, 8
KIND[[ord(c) for c in ".,;:?'\"()-"]] = 16


SPACE = re.compile(rb"[\x00-\x20]")


def features(text: str | None) -> np.ndarray:
    """The numbers of the text's features, each once. Long texts are taken in parts that overlap by some words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    found, back, at = [], 0, 0
    while at < len(raw):
        m = SPACE.search(raw, at + AT_ONCE)
        at = m.start() if m else len(raw)
        part = raw[back:at]
        own, start = _part(part, back > 0)
        found.append(own)
        back += int(start[-3]) if len(start) > 3 else 0
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.int64)


def _part(raw: bytes, more: bool) -> tuple[np.ndarray, np.ndarray]:
    """Features of a part, and where its words start. more: its first word is there only to tell whether the second repeats it."""
    b = np.frombuffer(raw, np.uint8)
    start, end = word_spans(b)
    if not len(start):
        return np.empty(0, np.int64), start
    w = span_hashes(np.frombuffer(raw.lower(), np.uint8), start, end)
    kind = KIND[b]
    held = np.bitwise_or.reduceat(np.append(kind, 0), np.stack([start, end], 1).ravel())[::2].astype(np.uint64)
    long = np.minimum((end - start) // 4, 7).astype(np.uint64)
    again = np.r_[False, w[1:] == w[:-1]].astype(np.uint64)
    s = mix(held | kind[start].astype(np.uint64) << np.uint64(8) | kind[end - 1].astype(np.uint64) << np.uint64(16) | again << np.uint64(24) | long << np.uint64(28))
    w, s = w[int(more) :], s[int(more) :]
    parts = [w, mix(w[:-1] * BASE + w[1:]), s + np.uint64(1)]
    for n in (2, 3):
        if len(s) >= n:
            total = np.full(len(s) - n + 1, n, np.uint64)
            for i in range(n):
                total = total * BASE + s[i : len(s) - n + 1 + i]
            parts.append(mix(total))
    return np.unique(np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64), start


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counts(labelled: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Of how many texts of either class each feature is part. Summed within tasks, then by block of features; 2**bits numbers come back."""

    def run(batches):
        own = np.zeros((2, 1 << bits), np.int64)
        for b in lean(batches):
            for t, y in zip(b.column(0), b.column(1).to_pylist()):
                own[y, features(t.as_py())] += 1
        blocks = [k for k in range(0, 1 << bits, BLOCK) if own[:, k : k + BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([own[:, k : k + BLOCK].tobytes() for k in blocks], pa.binary())], ["block", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "counts": [total.tobytes()]})

    both = np.zeros((2, 1 << bits))
    for r in labelled.select("text", "label").mapInArrow(run, "block long, counts binary").groupBy("block").applyInPandas(add, "block long, counts binary").collect():
        both[:, r["block"] : r["block"] + BLOCK] = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    return both[0], both[1]


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 0, begin: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model over unit rows (numbers, values); y is -1 or 1, cost bounds each row's dual variable.

    begin: dual variables to start from. It ends when no variable changes by more than a thousandth of its bound.
    """
    w, bias, a = np.zeros(size), 0.0, np.zeros(len(rows)) if begin is None else begin.copy()
    for i in np.flatnonzero(a):
        w[rows[i][0]] += a[i] * y[i] * rows[i][1]
        bias += a[i] * y[i]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            k, x = rows[i]
            g = y[i] * (w[k] @ x + bias) - 1
            new = min(max(a[i] - g / 2, 0.0), cost[i])  # a unit row and the bias make 2 on the diagonal
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[k] += step * x
                bias += step
                most = max(most, abs(new - a[i]) / cost[i])
                a[i] = new
        if most < 1e-3:
            break
    return w, bias, a


class Model:
    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float):
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio.astype(np.float32), weight.astype(np.float32), bias, slope, shift

    def row(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.ratio[k]
        return k, x / max(float(np.sqrt(x @ x)), 1e-9)

    def margin(self, k: np.ndarray) -> float:
        k, x = self.row(k)
        return float(self.weight[k] @ x) + self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.shift, -30, 30))))


def _logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least weighted loss, by Newton's steps with a little shrinkage."""
    x, p = np.stack([m, np.ones_like(m)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        z = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (z - y)) + 1e-3 * p
        h = (x * (weight * z * (1 - z))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        p -= np.clip(step, -2, 2)
    return float(max(p[0], 0.1)), float(p[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """labels: doc_id and quality (0 or 1)."""
    own = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).where(~held_out("doc_id"))
    small = F.broadcast if own.count() <= BROADCAST_ROWS else lambda x: x
    own = scratch(docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(small(own), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.count("*").alias("n")), "labels")  # those of documents that are there
    sizes = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(sizes) < 2:
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0, -30.0 if sizes.get(0) else 30.0)
    plain = docs.select("doc_id", "text")
    labelled = plain.join(small(own), "doc_id")
    pos, neg = _counts(labelled, bits)[::-1]
    ratio = np.log((pos + 1) / (pos.sum() + len(pos))) - np.log((neg + 1) / (neg.sum() + len(neg)))
    first = lambda y: own.where(f"label = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "label", F.xxhash64("doc_id").alias("h"))
    chosen = first(0).unionByName(first(1))

    def pick(batches):
        for b in lean(batches):
            cells = pa.array([features(t.as_py()).astype(np.int32).tobytes() for t in b.column(0)], pa.binary())
            yield pa.RecordBatch.from_arrays([cells, *b.columns[1:]], ["f", "label", "doc_id", "h"])

    picked = scratch(plain.join(F.broadcast(chosen), "doc_id").select("text", "label", "doc_id", "h").mapInArrow(pick, "f binary, label int, doc_id long, h long"), "sample")
    upto, used = {0: None, 1: None}, [0, 0]
    for r in sorted(picked.groupBy("label", "h", "doc_id").agg(F.sum(F.octet_length("f")).alias("n")).collect(), key=lambda r: (r["h"], r["doc_id"])):
        used[r["label"]] += r["n"]
        if used[r["label"]] <= FIT_BYTES or upto[r["label"]] is None:
            upto[r["label"]] = r["h"]
    got = picked.where(" OR ".join(f"label = {y} AND h <= {h}" for y, h in upto.items() if h is not None) or "false").collect()
    got.sort(key=lambda r: (r["doc_id"], r["f"]))
    model = Model(ratio, np.zeros(1 << bits), 0.0, 1.0, 0.0)
    rows = [model.row(np.frombuffer(r["f"], np.int32).astype(np.int64)) for r in got]
    y = np.array([2.0 * r["label"] - 1 for r in got])
    share = np.array([(y < 0).sum(), (y > 0).sum()])
    if not share.all():
        return Model(np.zeros(1 << bits), np.zeros(1 << bits), 0.0, 1.0, -30.0 if share[0] else 30.0)
    cost = np.where(y > 0, len(y) / share[1], len(y) / share[0]) / 2
    test = np.arange(len(y)) % 4 == 0  # margins of rows that a first fit hasn't seen place the curve

    def fit(use: np.ndarray, begin: np.ndarray | None = None) -> tuple[Model, np.ndarray]:
        w, b, a = dual_descent([rows[i] for i in np.flatnonzero(use)], y[use], 1 << bits, cost[use], begin=begin)
        return Model(ratio, w, b, 1.0, 0.0), a

    first, own_a = fit(~test)
    begin = np.zeros(len(y))
    begin[~test] = own_a
    full, _ = fit(np.ones(len(y), bool), begin)
    use = test if len(set(y[test])) == 2 else ~test
    m = np.array([float(first.weight[k] @ x) + first.bias for k, x in (rows[i] for i in np.flatnonzero(use))])
    prior = np.where(y[use] > 0, sizes[1] / max((y[use] > 0).sum(), 1), sizes[0] / max((y[use] < 0).sum(), 1))
    full.slope, full.shift = _logistic(m, (y[use] > 0).astype(float), prior / prior.mean())
    return full


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with columns score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(held.value.score, na_action=None).astype("float64")

    return docs.withColumn("score", F.pandas_udf(run, "double")(F.col("text").cast("string"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
