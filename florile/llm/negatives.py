"""Hard negatives by rotated one-bit codes.

Components become whole numbers, floor(SCALE * x), and the score of two rows is the inner product of those. Whole vectors are rotated by a
fixed random rotation; a row's code is the sign of each rotated component, and with it are stored its alignment (the inner product of
the rotated vector with the unit vector of its signs) and the length of the rest. An anchor is rotated likewise and rounded to LEVELS
steps, whose bits are planes. So popcounts of a code with the planes give the inner product of anchor and signs up to the rounding, of known
length, and Cauchy-Schwarz bounds what the rest of the row can add: an interval that holds the score for certain. Only rows whose
interval reaches what an anchor still needs are scored, in whole numbers, so results are exact.

Anchors and rows are dealt into blocks by hashes of their ids, whatever their labels, and each pair of blocks is a group. A task keeps the
anchors of one group and the best found for them so far, and streams the rows past them, so its memory depends on neither the rows nor
a label's share of them. First come the positives (pairs of one label), then, with their scores known, the negatives.

Defined results: rows without vec_id, label or vector, with a null or non-finite component, or so long that scores wouldn't fit 64 bits (a
squared length over 2**62) take no part; vectors of different length don't meet; rows that repeat wholly are one, and rows that share
a vec_id alone are no partners of each other; other columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, scratch

SCALE, EVERY, LABELS = 256, 50, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 50, 95
#: Anchors and rows of a group; anchors and rows that are held against each other at once.
ANCHORS, ROWS, NEAR, SLICE = 8192, 32768, 64, 2048
LEVELS = 4
EXACT = float(1 << 53)
#: Less than any score; the largest squared length of a row.
NONE, LONGEST = -(1 << 62) - 1, 2.0**62
_turns: dict[int, np.ndarray] = {}


def rotation(dims: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    if dims not in _turns:
        q, r = np.linalg.qr(np.random.default_rng([29, dims]).standard_normal((dims, dims)))
        _turns[dims] = q * np.sign(np.diag(r))
    return _turns[dims]


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit numbers."""
    out = np.zeros((len(bits), -(-bits.shape[1] // 64) * 8), np.uint8)
    own = np.packbits(bits, axis=1)
    out[:, : own.shape[1]] = own
    return out.view(np.uint64)


def encode(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of whole numbers: codes, alignments, and lengths of what the codes leave out."""
    turned = whole.astype(np.float64) @ rotation(whole.shape[1])
    aligned = np.abs(turned).sum(1) / whole.shape[1] ** 0.5
    return packed(turned > 0), aligned, np.sqrt(np.maximum((turned * turned).sum(1) - aligned**2, 0))


class Anchors:
    """Anchors of one group and of one number of dimensions, with what their intervals need."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray):
        self.ids, self.labels, self.whole = ids, labels, whole
        turned = whole.astype(np.float64) @ rotation(whole.shape[1])
        self.norm2 = (turned * turned).sum(1)
        low = turned.min(1, keepdims=True)
        step = (turned.max(1, keepdims=True) - low) / ((1 << LEVELS) - 1)
        level = np.rint((turned - low) / np.where(step > 0, step, 1)).astype(np.int64)
        rounded = low + step * level
        self.planes = np.stack([packed((level >> k) & 1 == 1) for k in range(LEVELS)])
        self.low, self.step, self.sum = low, step, rounded.sum(1, keepdims=True)
        self.off = np.sqrt(((turned - rounded) ** 2).sum(1, keepdims=True))

    def bounds(self, own: np.ndarray, code: np.ndarray, aligned: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Below and above which the scores of the anchors own (positions) with the coded rows can't be."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)[None]
        parts = np.zeros((len(own), len(code)), np.int32)
        for k in range(LEVELS):
            for w in range(code.shape[1]):
                parts += np.bitwise_count(code[None, :, w] & self.planes[k, own, w][:, None]).astype(np.int32) << k
        with_signs = (2 * (self.low[own] * ones + self.step[own] * parts) - self.sum[own]) / self.whole.shape[1] ** 0.5
        near = np.maximum(np.abs(with_signs) - self.off[own], 0)
        norm2 = self.norm2[own][:, None]
        wide = aligned * self.off[own] + rest * np.sqrt(np.maximum(norm2 - near * near, 0))
        wide += 1e-9 * np.sqrt(norm2) * (aligned + rest) + 1e-6  # rounding of the above
        middle = aligned * with_signs
        return middle - wide, middle + wide


def _small(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether no sum of products of rows of a and b leaves what doubles hold exactly."""
    return float(np.abs(a).sum(1, dtype=np.float64).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT


def pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, row by row."""
    return np.einsum("ij,ij->i", *((x.astype(np.float64) for x in (a, b)) if _small(a, b) else (a, b))).astype(np.int64)


def all_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, each row with each."""
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if _small(a, b) else a @ b.T


class Best:
    """For each of so many lists: the most best of (score, id), higher scores and then smaller ids first."""

    def __init__(self, lists: int, most: int):
        self.score, self.id = np.full((lists, most), NONE), np.zeros((lists, most), np.int64)

    @property
    def least(self) -> np.ndarray:
        """What is needed to get into each list."""
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        lists, at = np.unique(of, return_inverse=True)
        most = self.score.shape[1]
        at = np.concatenate([np.repeat(np.arange(len(lists)), most), at])
        score, ids = np.concatenate([self.score[lists].ravel(), score]), np.concatenate([self.id[lists].ravel(), ids])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        stay = rank < most
        self.score[lists[at[stay]], rank[stay]], self.id[lists[at[stay]], rank[stay]] = score[stay], ids[stay]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lists, scores and ids."""
        of, k = np.nonzero(self.score != NONE)
        return of, self.score[of, k], self.id[of, k]


def hundredths(score: np.ndarray, n: int) -> np.ndarray:
    """The largest whole numbers up to n hundredths of the scores."""
    return score // 100 * n + score % 100 * n // 100


class Positives:
    """The best rows of each anchor's label."""

    schema = "anchor long, dims int, key binary, score long, partner long"

    def __init__(self, t: pa.Table, dims: int):
        self.keys = t.column("key")
        self.anchors = Anchors(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _whole(t, dims))
        self.by_label = np.argsort(self.anchors.labels, kind="stable")
        self.best = Best(len(t), POSITIVES)

    def parts(self, labels: np.ndarray):
        """Anchors and rows that may be partners, as positions: those of one label."""
        order = np.argsort(labels, kind="stable")
        for label in np.unique(labels):
            a, b = (np.searchsorted(x[o], [label, label + 1]) for x, o in ((self.anchors.labels, self.by_label), (labels, order)))
            if a[0] < a[1]:
                yield self.by_label[a[0] : a[1]], order[b[0] : b[1]]

    def wanted(self, own: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        return above >= self.best.least[own][:, None]

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        stay = (self.anchors.ids[a] != ids) & (score >= self.best.least[a])
        self.best.add(a[stay], score[stay], ids[stay])

    def result(self, dims: int) -> pa.Table:
        of, score, ids = self.best.found()
        return pa.table({"anchor": self.anchors.ids[of], "dims": np.full(len(of), dims, np.int32), "key": self.keys.take(pa.array(of)), "score": score, "partner": ids})


class Negatives:
    """The best rows of other labels within the band of each of an anchor's positives."""

    schema = "anchor long, dims int, key binary, positive long, positive_score long, score long, partner long"

    def __init__(self, t: pa.Table, dims: int):
        self.keys = t.column("key")
        self.anchors = Anchors(t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _whole(t, dims))
        lists = t.column("positives").to_pylist()
        self.anchor = np.repeat(np.arange(len(t)), [len(x) for x in lists])
        self.score, self.partner = (np.array([p[c] for x in lists for p in x], np.int64) for c in ("score", "partner"))
        self.low, self.high = -hundredths(-self.score, LOW), hundredths(self.score, HIGH)
        self.first = np.searchsorted(self.anchor, np.arange(len(t) + 1))
        self.best = Best(len(self.score), NEGATIVES)
        self._renew()

    def _renew(self) -> None:
        """What each anchor still needs: from the least that would be a list's, up to the highest band."""
        least = np.maximum(self.best.least, self.low)
        least[self.low > self.high] = np.iinfo(np.int64).max
        at = self.first[:-1]
        self.from_, self.to = np.minimum.reduceat(least, at), np.maximum.reduceat(self.high, at)

    def parts(self, labels: np.ndarray):
        every = np.arange(len(labels))
        for k in range(0, len(self.anchors.ids), NEAR):
            yield np.arange(k, min(k + NEAR, len(self.anchors.ids))), every

    def wanted(self, own: np.ndarray, below: np.ndarray, above: np.ndarray) -> np.ndarray:
        return (above >= self.from_[own][:, None]) & (below <= self.to[own][:, None])

    def add(self, a: np.ndarray, score: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        stay = (self.anchors.labels[a] != labels) & (self.anchors.ids[a] != ids) & (score >= self.from_[a]) & (score <= self.to[a])
        a, score, ids = a[stay], score[stay], ids[stay]
        n = self.first[a + 1] - self.first[a]
        of = np.repeat(self.first[a] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        score, ids = np.repeat(score, n), np.repeat(ids, n)
        stay = (self.low[of] <= score) & (score <= self.high[of]) & (score >= self.best.least[of])
        if stay.any():
            self.best.add(of[stay], score[stay], ids[stay])
            self._renew()

    def result(self, dims: int) -> pa.Table:
        of, score, ids = self.best.found()
        a = self.anchor[of]
        return pa.table({"anchor": self.anchors.ids[a], "dims": np.full(len(of), dims, np.int32), "key": self.keys.take(pa.array(a)), "positive": self.partner[of], "positive_score": self.score[of], "score": score, "partner": ids})


def _whole(t: pa.Table | pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("whole").to_pylist()), np.int64).reshape(-1, dims)


def _meet(kind: type):
    """Groups (q, r, dims) whose anchors (side 0) come before their rows (side 1), and rows of kind's result."""

    def run(batches):
        last, held, own = None, [], None
        for batch in lean(batches):
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("q", "r", "dims", "side")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if i == j:
                    continue
                key = tuple(int(c[i]) for c in cols[:3])
                if key != last:
                    if own is not None:
                        yield from own.result(last[2]).to_batches()
                    last, held, own = key, [], None
                part = batch.slice(i, j - i)
                if cols[3][i] == 0:
                    held.append(part)
                    continue
                if own is None and held:
                    own, held = kind(pa.Table.from_batches(held), key[2]), []
                if own is not None:
                    for k in range(0, j - i, SLICE):
                        _pass(own, part.slice(k, SLICE), key[2])
        if own is not None:
            yield from own.result(last[2]).to_batches()

    return run


def _pass(own, part: pa.RecordBatch, dims: int) -> None:
    """Hold some rows against all anchors of a group."""
    ids, labels = (part.column(c).to_numpy() for c in ("vec_id", "label"))
    aligned, rest = (part.column(c).to_numpy()[None] for c in ("aligned", "rest"))
    code, whole = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint64).reshape(len(ids), -1), _whole(part, dims)
    for a, b in own.parts(labels):
        for k in range(0, len(a), NEAR):
            near = a[k : k + NEAR]
            may = own.wanted(near, *own.anchors.bounds(near, code[b], aligned[:, b], rest[:, b]))
            if 8 * np.count_nonzero(may) > may.size:  # many: all scores at once, of which those of the survivors count
                score = all_scores(own.anchors.whole[near], whole[b])
                i, j = np.nonzero(may & own.wanted(near, score, score))
                score = score[i, j]
            else:
                i, j = np.nonzero(may)
                score = pair_scores(own.anchors.whole[near[i]], whole[b[j]])
            if len(i):
                own.add(near[i], score, ids[b[j]], labels[b[j]])


def _prepare(batches):
    """Rows that take part: whole numbers, code, alignment, rest, and a key of what they are."""
    for b in lean(batches):
        ids, labels, wholes = [], [], []
        for i, label, x in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i is None or label is None or not x or None in x:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                v = np.floor(SCALE * np.asarray(x, np.float64))
                fits = np.isfinite(v).all() and float(v @ v) <= LONGEST
            if fits:
                ids.append(i)
                labels.append(label)
                wholes.append(v.astype(np.int64))
        codes: list = [None] * len(ids)
        for d in {len(v) for v in wholes}:
            own = [k for k, v in enumerate(wholes) if len(v) == d]
            for k, *x in zip(own, *encode(np.stack([wholes[k] for k in own]))):
                codes[k] = x
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([len(v) for v in wholes], pa.int32()), pa.array([v.tobytes() for v in wholes], pa.binary()), pa.array([x[0].tobytes() for x in codes], pa.binary()), pa.array([float(x[1]) for x in codes], pa.float64()), pa.array([float(x[2]) for x in codes], pa.float64())],
            ["vec_id", "label", "dims", "whole", "code", "aligned", "rest"],
        )


def _joined(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, kind: type) -> DataFrame:
    """kind's result for each group of a block of anchors and a block of rows."""
    q, r = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // ROWS))
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    more = [c for c in anchors.columns if c not in rows.columns]
    both = anchors.withColumns({"q": block(q, 1), "side": F.lit(0)}).withColumn("r", every(r)).withColumn("code", F.lit(None).cast("binary"))
    both = both.unionByName(rows.withColumns({"r": block(r, 2), "side": F.lit(1)}).withColumn("q", every(q)), allowMissingColumns=True)
    group = ["q", "r", "dims", "side"]
    return both.select(*group, "vec_id", "label", "key", "whole", "code", "aligned", "rest", *more).repartition(*group[:3]).sortWithinPartitions(*group).mapInArrow(_meet(kind), kind.schema)


def rows_of(vectors: DataFrame, label: Column) -> DataFrame:
    """The different rows that take part, as a table: vec_id, label, dims, whole, code, aligned, rest, and a key of label and vector."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), "embedding")
    out = own.mapInArrow(_prepare, "vec_id long, label long, dims int, whole binary, code binary, aligned double, rest double")
    out = out.withColumn("key", F.unhex(F.sha2(F.concat(F.col("label").cast("string").cast("binary"), F.lit(b":"), F.col("whole")), 256)))
    return scratch(out.dropDuplicates(["vec_id", "key"]), "negatives-rows")


def hard_negatives(vectors: DataFrame, label: Column, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score. is_anchor: a condition on vec_id."""
    rows = rows_of(vectors, label)
    anchors = rows.where(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    ranked = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "partner"))
    anchor = ["anchor", "dims", "key"]
    best = _joined(anchors, rows, n_anchors, n_rows, Positives).withColumn("place", ranked(*anchor)).where(F.col("place") <= POSITIVES)
    best = best.groupBy(*anchor).agg(F.collect_list(F.struct("score", "partner")).alias("positives"))  # POSITIVES at most
    anchors = scratch(anchors.join(best.withColumnRenamed("anchor", "vec_id"), ["vec_id", "dims", "key"]), "negatives-anchors")
    found = _joined(anchors, rows, n_anchors, n_rows, Negatives).withColumn("rank", ranked(*anchor, "positive")).where(F.col("rank") <= NEGATIVES)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("partner").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def moved_label(every: int = 7, labels: int = LABELS) -> Column:
    """The label, or the next one where vec_id is divisible by every."""
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % every == 0, (label + 1) % labels).otherwise(label)
