"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are a random product code: a vector is cut in two halves, each half has a codebook of random unit words, and every
pair of words is a direction. A vector is list-decoded to all directions whose inner product with it reaches ALPHA (set so that
LISTED of all directions do on average): the second half's products are sorted, and a binary search for each word of the first half
finds its partners, so the directions, whose number grows with the table, are never tried one by one. Vectors with fewer than LEAST
directions lower their bar until they have them. Vectors that share a label and a direction are compared exactly in double precision.

Equal vectors are collapsed before. Large buckets are dealt into blocks; tasks return counts of links and whom each vector reaches,
never pairs.

Defined results: a vector that is null, empty, zero, holds null or non-finite components, or lacks label or vec_id links with nothing
and is a component of its own; vectors of different length don't link; each row is a vector, also where rows repeat; other columns
are ignored; an empty table gives an empty result.
"""

import hashlib
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINKS, by_group, candidate_groups, components, join_hot, linked, scratch

THRESHOLD, LISTED, LEAST = 0.98, 16, 6
BLOCK = 1024
_books: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def codebooks(dims: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    if (dims, words) not in _books:
        rng = np.random.default_rng([17, dims, words])
        halves = [rng.standard_normal((words, max(1, n))) for n in (dims // 2, dims - dims // 2)]
        _books[dims, words] = tuple(h / np.linalg.norm(h, axis=1, keepdims=True) for h in halves)
    return _books[dims, words]


def decode(v: np.ndarray, words: int, listed: float = LISTED) -> list[np.ndarray]:
    """For each unit row of v: the numbers (first word * words + second word) of its directions, rising."""
    dims = v.shape[1]
    one, two = codebooks(dims, words)
    half = dims // 2
    first = v[:, :half] @ one.T if half else np.zeros((len(v), words))
    second = v[:, half:] @ two.T
    alpha = NormalDist().inv_cdf(1 - min(0.5, listed / words**2)) * (2 / dims) ** 0.5  # a direction has length sqrt(2)
    least, out = min(LEAST, words * words), []
    for a, b in zip(first, second):
        order = np.argsort(b)
        b, bar = b[order], alpha
        while True:
            at = np.searchsorted(b, bar - a)
            n = words - at
            if (total := int(n.sum())) >= least:
                break
            bar -= 0.02
        w = np.repeat(np.arange(words), n)
        inner = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        out.append(np.sort(w * words + order[np.repeat(at, n) + inner]))
    return out


def _prepare(batches):
    """Valid vectors: their unit form in double precision, and a key that equal vectors share."""
    for b in batches:
        ids, labels, vectors = [], [], []
        for i, label, x in zip(*(b.column(k).to_pylist() for k in range(3))):
            if i is None or label is None or not x or None in x:
                continue
            v = np.asarray(x, np.float64)
            top = np.abs(v).max()
            if np.isfinite(top) and top > 0:
                ids.append(i)
                labels.append(label)
                vectors.append(v + 0.0)
        units = [(u := v / np.abs(v).max()) / np.sqrt(u @ u) for v in vectors]
        keys = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in vectors]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([len(v) for v in vectors], pa.int32()), pa.array(keys, pa.binary()), pa.array([u.tobytes() for u in units], pa.binary())], ["vec_id", "label", "dims", "key", "unit"])


def _decode(words: int):
    def run(batches):
        for b in batches:
            units = [np.frombuffer(x, np.float64) for x in b.column(b.schema.get_field_index("unit")).to_pylist()]
            found: list = [None] * len(units)
            for d in {len(u) for u in units}:
                own = [i for i, u in enumerate(units) if len(u) == d]
                for k in range(0, len(own), 1024):
                    for i, f in zip(own[k : k + 1024], decode(np.stack([units[i] for i in own[k : k + 1024]]), words)):
                        found[i] = f
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], [*b.schema.names, "filters"])

    return run


def _compare(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        ids, copies, side = (t.column(c).to_numpy() for c in ("member", "m", "side"))
        v = np.stack([np.frombuffer(x, np.float64) for x in t.column("unit").to_pylist()])
        if t.column("p")[0].as_py() != t.column("q")[0].as_py():
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a, b = np.nonzero(v[one] @ v[two].T >= threshold)
            a, b = one[a], two[b]
        else:
            a, b = np.nonzero(np.triu(v @ v.T >= threshold, 1))
        if len(a):  # pairs that share a lower direction are compared there
            here, lists = t.column("filter")[0].as_py(), t.column("filters").to_pylist()
            lower = [[f for f in x if f < here] for x in lists]
            names, code = np.unique(np.array([f for x in lower for f in x], np.int64), return_inverse=True)
            if len(names):
                has = np.zeros((len(ids), len(names)), np.float32)
                has[np.repeat(np.arange(len(ids)), [len(x) for x in lower]), code] = 1
                first = (has @ has.T)[a, b] == 0
                a, b = a[first], b[first]
        return linked(ids, copies, a, b)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("embedding"))
    valid = scratch(rows.mapInArrow(_prepare, "vec_id long, label long, dims int, key binary, unit binary"), "vectors")
    n_valid = valid.count()
    words = 1 << max(4, min(14, round(np.log2(max(1, n_valid) / 3) / 2)))
    reps = valid.groupBy("label", "dims", "key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.any_value("unit").alias("unit"))
    reps = scratch(reps.mapInArrow(_decode(words), "label long, dims int, key binary, rep long, m long, unit binary, filters array<long>"), "directions")
    entries = reps.select(F.explode("filters").alias("filter"), "label", "dims", F.col("rep").alias("member"), F.lit(1).alias("load"))
    bucket = ["filter", "label", "dims"]
    groups = candidate_groups(entries, bucket, BLOCK, BLOCK, LISTED * n_valid)
    groups = groups.join(reps.select("label", "dims", F.col("rep").alias("member"), "m", "unit", "filters"), ["label", "dims", "member"])
    links = scratch(by_group(groups.select(*bucket, "p", "q", "side", "member", "m", "unit", "filters"), [*bucket, "p", "q"], _compare(threshold), LINKS), "vector-links")
    parts = components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("id").agg(F.sum("n_links").alias("n"))
    known = reps.select("label", "dims", "key", "rep", "m").join(counts, F.col("rep") == F.col("id"), "left").drop("id").join(parts, F.col("rep") == F.col("id"), "left")
    known = scratch(known.select("label", "dims", "key", "m", F.coalesce("component", "rep").alias("c"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "parts")
    found = join_hot(valid.select("vec_id", "label", "dims", "key"), known, ["label", "dims", "key"], "m", n_valid).groupBy("vec_id").agg(F.min("c").alias("c"), F.max("n_links").alias("n_links"))
    out = rows.select("vec_id").join(found, "vec_id", "left").withColumn("component_id", F.coalesce("c", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
