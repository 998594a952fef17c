"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are a polynomial over two primes. A chunk's fingerprint is the polynomial of its bytes; the fingerprint of
two pieces in a row is that of the first, times the base to the length of the second, plus that of the second. So chunks of a huge
document are hashed apart, in different tasks, and combined by a sum. Documents of equal fingerprint and length are then compared
with the group's largest id chunk by chunk; those that differ (a collision) are grouped by their digest instead, so results are exact.

Defined results: a null text is an empty one; a null doc_id sorts below all others; rows that repeat doc_id and text are one
document given twice and get the same values each; other columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_parts, join_hot, scratch

#: Two primes below 2**31 and a base for each.
PRIMES = ((2147483647, 911382323), (2147483629, 972663749))
#: Bytes of a chunk; texts over HUGE bytes have their chunks hashed by many tasks.
CHUNK, HUGE = 1 << 16, 1 << 24

_pow: dict[tuple[int, int], np.ndarray] = {}


def _powers(p: int, base: int, n: int) -> np.ndarray:
    """base**(n-1) ... base**0 modulo p, for n of at most CHUNK."""
    if (p, base) not in _pow:
        x = np.ones(1, np.uint64)
        while len(x) < CHUNK:
            x = np.concatenate([x, x * np.uint64(pow(base, len(x), p)) % np.uint64(p)])
        _pow[p, base] = x[:CHUNK][::-1].copy()
    return _pow[p, base][CHUNK - n :]


def chunk_hash(data: bytes, p: int, base: int) -> int:
    """The polynomial of at most CHUNK bytes: products stay below 2**39, so 2**16 of them sum within 64 bits."""
    x = np.frombuffer(data, np.uint8).astype(np.uint64)
    return int((x * _powers(p, base, len(x))).sum() % np.uint64(p)) if len(x) else 0


def combine(first: int, second: int, length: int, p: int, base: int) -> int:
    """The fingerprint of two pieces in a row, the second of length bytes."""
    return (first * pow(base, length, p) + second) % p


def fingerprint(data: bytes, p: int, base: int) -> int:
    h = 0
    for i in range(0, len(data), CHUNK):
        piece = data[i : i + CHUNK]
        h = combine(h, chunk_hash(piece, p, base), len(piece), p, base)
    return h


def _whole(primes):
    @F.pandas_udf("f1 long, f2 long")
    def prints(texts: pd.Series) -> pd.DataFrame:
        both = [[fingerprint(t.encode("utf-8", "surrogatepass"), p, b) for t in texts] for p, b in primes]
        return pd.DataFrame({"f1": both[0], "f2": both[1]}, dtype="int64")

    return prints


def _shifted(primes):
    """A chunk's fingerprint, shifted by the bytes that follow it in its document."""

    @F.pandas_udf("f1 long, f2 long")
    def prints(chunks: pd.Series, after: pd.Series) -> pd.DataFrame:
        both = [[chunk_hash(c, p, b) * pow(b, int(n), p) % p for c, n in zip(chunks, after)] for p, b in primes]
        return pd.DataFrame({"f1": both[0], "f2": both[1]}, dtype="int64")

    return prints


def _chunks(text: str, chunk: int):
    """An array of (no, chunk) with each byte of the text once. The text is encoded once: it is bound as the one element of an array."""
    last = F.greatest(F.ceil(F.octet_length(text) / chunk) - 1, F.lit(0))
    numbers = F.sequence(F.lit(0).cast("long"), last)
    cut = lambda data: F.transform(numbers, lambda i: F.struct(i.alias("no"), F.substring(data, (i * chunk + 1).cast("int"), F.lit(chunk)).alias("chunk")))
    return F.get(F.transform(F.array(F.encode(text, "UTF-8")), cut), 0)


def fingerprints(docs: DataFrame, huge: int = HUGE, primes=PRIMES) -> DataFrame:
    """doc_id, n_bytes, text_sha256, f1, f2 and text of every row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"n_bytes": F.octet_length("text").cast("long"), "text_sha256": F.sha2("text", 256)})
    usual = d.where(f"n_bytes <= {huge}").withColumn("f", _whole(primes)("text")).select("doc_id", "n_bytes", "text_sha256", "f.f1", "f.f2", "text")
    big = d.where(f"n_bytes > {huge}")
    parts = big.select("doc_id", "n_bytes", "text_sha256", F.explode(_chunks("text", CHUNK)).alias("c")).select("doc_id", "n_bytes", "text_sha256", "c.no", "c.chunk")
    parts = parts.repartition("doc_id", "text_sha256", "no").withColumn("f", _shifted(primes)("chunk", F.greatest(F.col("n_bytes") - (F.col("no") + 1) * CHUNK, F.lit(0))))
    key = ["doc_id", "n_bytes", "text_sha256"]
    # A repeated row doubles the sum; dividing by the count of first chunks undoes that.
    sums = parts.groupBy(*key).agg(F.sum("f.f1").alias("s1"), F.sum("f.f2").alias("s2"), F.count_if(F.col("no") == 0).alias("n"))
    sums = sums.select(*key, F.expr(f"(s1 div n) % {primes[0][0]}").alias("f1"), F.expr(f"(s2 div n) % {primes[1][0]}").alias("f2"))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"s.{k}")) for k in key]
    return usual.unionByName(big.alias("b").join(sums.alias("s"), on).select(*(f"b.{k}" for k in key), "f1", "f2", "text"))


def exact_groups(docs: DataFrame, huge: int = HUGE, primes=PRIMES) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    fp = ["f1", "f2", "n_bytes"]
    full = fingerprints(docs, huge, primes)
    base = scratch(full.drop("text"), "fingerprints")
    total = base.count()
    groups = base.groupBy(*fp).agg(F.count("*").alias("n"), F.max("doc_id").alias("head")).where("n > 1")
    groups = scratch(groups.withColumn("parts", hot_parts("n", total)), "groups")
    # Members meet the head of their group, chunk by chunk. A large group is dealt into parts, and its head is given to each.
    hot = F.broadcast(groups.where("parts > 1").select(*fp, "parts"))
    part = F.pmod(F.xxhash64("doc_id", "text_sha256"), F.coalesce("parts", F.lit(1))).cast("int")
    each = lambda df: df.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = full.join(hot, fp, "left").withColumn("part", part).drop("parts")
    members = own.join(each(groups.drop("n")), [*fp, "part"]).select(*fp, "part", "parts", "doc_id", "head", "text_sha256", F.explode(_chunks("text", CHUNK)).alias("c")).select(*fp, "part", "parts", "doc_id", "head", "text_sha256", "c.no", "c.chunk")
    members = scratch(members, "members")  # what groups hold, so that texts are shuffled once
    heads = each(members.where(F.col("doc_id").eqNullSafe(F.col("head"))).groupBy(*fp, "no").agg(F.min_by("chunk", "text_sha256").alias("head_chunk"), F.max("parts").alias("parts"))).drop("parts")
    checked = members.join(heads, [*fp, "no", "part"], "left").groupBy(*fp, "doc_id", "text_sha256").agg(F.bool_and(F.coalesce(F.col("chunk") == F.col("head_chunk"), F.lit(False))).alias("same"))
    odd = checked.where(~F.col("same")).select(*fp, "doc_id", F.col("text_sha256").alias("class")).distinct()
    odd = scratch(odd, "collisions")
    if not odd.isEmpty():
        on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*fp, "doc_id"]] + [F.col("l.text_sha256") == F.col("r.class")]
        both = scratch(base.alias("l").join(odd.alias("r"), on, "left").select("l.*", F.coalesce("r.class", F.lit("")).alias("class")), "classes")
    else:
        both = base.withColumn("class", F.lit(""))
    sizes = both.groupBy(*fp, "class").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    out = join_hot(both, sizes, [*fp, "class"], "group_size", total)
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but the row of the largest doc_id of each group of equal texts; all columns stay."""
    keep = exact_groups(docs).where("kept").select("doc_id").distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["doc_id"]), "left_semi")
