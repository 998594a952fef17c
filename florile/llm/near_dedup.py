"""N-gram Jaccard join with Bayesian pruning of candidates (five words, similarity 0.8 or more).

Each distinct shingle set gets 128 MinHash values of 16 bits. Sets that agree in a band of four values are candidates: 32 bands find
a pair of similarity 0.8 but for one in 10**7. A candidate pair's values are compared 16 at a time; with m of n values equal and a
uniform prior, the posterior of the similarity is a beta distribution, and the pair goes as soon as the chance that it reaches the
threshold falls below TOLERANCE. What remains is verified exactly on the shingle sets.

Texts with equal shingle sets are collapsed into one before, so copies are never paired. Large buckets are dealt into blocks that
are compared block by block within tasks, which return how many links each document has and whom it reaches, never the pairs.

Defined results: words are what stands between ASCII white space and control characters, lower-cased, without the ASCII signs at their ends
(with signs=True they are part of the words); a text of one to four words has one shingle, and one without words (null, empty, signs alone) has
none and links with nothing; links are counted between rows, whatever their doc_ids; a class has the smallest doc_id of its rows, and texts whose
smallest doc_id is the same are in one class; a null doc_id counts as the smallest of all; other columns are ignored; an empty table gives an empty
result.
"""

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LINKS, by_group, candidate_groups, components, join_hot, lean, linked, mix, scratch, shingles, word_hashes

SIZE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, WIDTH, STEP = 32, 4, 16
#: Members of a block, and shingles of all of them together.
BLOCK, LOAD = 1024, 1 << 19
NO_ID = -(1 << 63)
#: Texts that are candidates (16 bytes each) up to which they are broadcast to the texts, so that only candidates' texts are shuffled; beyond, they are joined by a shuffle.
BROADCAST_TEXTS = 500_000

_SEEDS = np.random.default_rng(11).integers(1, 1 << 63, (2, BANDS * WIDTH), dtype=np.uint64)
_MUL, _ADD = _SEEDS[0] | np.uint64(1), _SEEDS[1]


def signature(s: np.ndarray) -> np.ndarray:
    """BANDS numbers of 64 bits, each of WIDTH MinHash values of 16 bits."""
    low = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        np.minimum(low, (s[i : i + 512, None] * _MUL + _ADD).min(0), out=low)
    return (mix(low) >> np.uint64(48)).astype(np.uint16).view(np.int64)


def least_equal(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After STEP, 2 * STEP, ... values: how many must be equal for the posterior to stay at or above the tolerance."""
    out = []
    for n in range(STEP, BANDS * WIDTH + 1, STEP):
        below = 0.0  # the chance of at most m successes in n + 1 trials is the posterior's upper tail
        for m in range(n + 1):
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= tolerance:
                break
        out.append(m)
    return out


def _prepare(size: int, signs: bool):
    def run(batches):
        for b in lean(batches):
            keys, counts, sigs = [], [], []
            for t in b.column(2):
                s = shingles(word_hashes(t.as_py(), signs), size)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(sigs, pa.list_(pa.int64()))], ["doc_id", "digest", "key", "n", "sig"])

    return run


def _intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (a, b)."""
    if len(a) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    code, owner = (x[count[code] > 1] for x in (code, owner))
    code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(code[-1]) + 1 if len(code) else 0, 4096):
        i, j = np.searchsorted(code, [k, k + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[i:j], code[i:j] - k] = 1
        total += m @ m.T
    return total[a, b].astype(np.int64)


def _compare(size: int, threshold: float, tolerance: float, signs: bool):
    need = least_equal(threshold, tolerance)

    def run(t: pa.Table) -> pa.Table:
        ids, copies = t.column("member").to_numpy(), t.column("m").to_numpy()
        band, cross = t.column("band")[0].as_py(), t.column("p")[0].as_py() != t.column("q")[0].as_py()
        side = t.column("side").to_numpy()
        sig = np.stack([np.asarray(x, np.int64) for x in t.column("sig").to_pylist()]).view(np.uint16)
        left, right = [], []
        second = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0) if cross else range(len(ids) - 1):
            j = second if cross else np.arange(i + 1, len(ids))
            equal = np.zeros(len(j), np.int64)
            for k, least in enumerate(need):
                same = sig[j, k * STEP : (k + 1) * STEP] == sig[i, k * STEP : (k + 1) * STEP]
                equal += same.sum(1)
                stay = equal >= least
                earlier = band - k * STEP // WIDTH
                if earlier > 0:  # pairs that agree in an earlier band are compared there
                    stay &= ~same.reshape(len(j), STEP // WIDTH, WIDTH).all(2)[:, :earlier].any(1)
                if not stay.all():
                    j, equal = j[stay], equal[stay]
                if not len(j):
                    break
            left.append(np.full(len(j), i))
            right.append(j)
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (left, right))
        if len(a):
            used = np.unique(np.concatenate([a, b]))
            texts = t.column("text")
            sets = [shingles(word_hashes(texts[int(i)].as_py(), signs), size) for i in used]
            sizes = np.array([len(x) for x in sets])
            x, y = np.searchsorted(used, a), np.searchsorted(used, b)
            both = _intersections(sets, x, y)
            good = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
            a, b = a[good], b[good]
        return linked(ids, copies, a, b, t.column("digest").to_numpy())

    return run


def near_groups(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, signs: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the smallest doc_id reached by links), n_links (other rows linked directly), kept."""
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    all_ = scratch(d.mapInArrow(_prepare(size, signs), "doc_id long, digest long, key binary, n long, sig array<long>"), "signatures")
    reps = all_.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("doc_id", "digest")).alias("r"), F.count("*").alias("m"), F.any_value("n").alias("n"), F.any_value("sig").alias("sig"))
    reps = scratch(reps.select("key", F.col("r.doc_id").alias("member"), F.col("r.digest").alias("digest"), "m", "n", "sig"), "shingle-sets")
    # Different sets may have the same doc_id, or none, so doc_id and digest together say which one is meant.
    member = ("member", "digest")
    entries = reps.select(F.posexplode("sig").alias("band", "h"), *member, F.col("n").alias("load"))
    groups = scratch(candidate_groups(entries, ["band", "h"], BLOCK, LOAD, BANDS * reps.count(), member), "candidates")
    wanted = scratch(groups.select(*member).distinct(), "candidate-texts")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    texts = d.withColumnRenamed("doc_id", "member").join(wanted, [*member], "left_semi").dropDuplicates([*member])
    groups = groups.join(reps.select(*member, "m", "sig"), [*member]).join(texts, [*member])
    run = _compare(size, threshold, tolerance, signs)
    links = scratch(by_group(groups.select("band", "h", "p", "q", "side", *member, "m", "sig", "text"), ["band", "h", "p", "q"], run, f"{LINKS}, digest long"), "links")
    classes = components(links.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "member")
    counts = links.groupBy(F.col("id").alias("member"), "digest").agg(F.sum("n_links").alias("n_links"))
    known = reps.select("key", *member, "m").join(counts, [*member], "left").join(classes, "member", "left")
    known = scratch(known.select("key", "m", F.coalesce("component", "member").alias("class_id"), (F.col("m") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")), "classes")
    alone = all_.where("key IS NULL").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).alias("n_links"))
    out = join_hot(all_.where("key IS NOT NULL").select("doc_id", "key"), known, ["key"], "m", all_.count()).select("doc_id", "class_id", "n_links").unionByName(alone)
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(named("doc_id"), named("class_id"), F.col("n_links").cast("long").alias("n_links"), (F.col("doc_id") == F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class; all columns stay."""
    gone = near_groups(docs, size, threshold).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
