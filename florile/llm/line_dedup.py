"""Line dedup that can be taken back: sharded cuckoo filters, backed by exact reference counts.

The state is a table of references (key, doc_id, n): how often each document holds each line key. Inserting documents adds rows,
deleting documents takes theirs away, so every decision can be reversed. From it come the exact reference counts of each key and,
sharded by key, cuckoo filters of the keys that two or more documents share. A document's lines are dealt out by shard and looked up
in their shard's filter; only those that may be shared (few) meet the exact table, which has the last word, so false positives of a
filter change nothing. A shard with many references has copies of its filter in several tasks, and the few keys that hold many lines
are told apart before, so no task grows with a common line.

Defined results: a null or empty text is one empty line; a null doc_id counts as the smallest id; rows with the same doc_id are one
document; lines repeated within one document are not shared by that; an empty table gives an empty result; other columns stay.
A key is the line without [\\x20\\x09-\\x0D] at its ends, A-Z lower-cased; keys under MIN_CHARS code points are never shared.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, scratch
from .cuckoo import CuckooFilter, Full

MIN_CHARS = 10
#: Keys of one shard's filter, and references that meet one copy of it. A key with a HOT_SHARE-th of all lines or more is known to be shared
#: without a filter; there are HOT_SHARE of them at most, so they are broadcast.
SHARD_KEYS, PROBE_REFS, HOT_SHARE = 1 << 17, 1 << 18, 10_000
NO_ID = -(1 << 63)


def line_keys(text: str | None) -> list[bytes | None]:
    """A 128-bit key for each line; None for lines that are too short to be shared."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):  # bytes.lower() changes A-Z only
        k = line.strip(b" \t\n\v\f\r")
        long = len(k) >= MIN_CHARS and (len(k) >= 4 * MIN_CHARS or len(k.decode("utf-8", "surrogatepass")) >= MIN_CHARS)
        out.append(xxhash.xxh3_128_digest(k) if long else None)
    return out


def _ids(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")


def line_refs(docs: DataFrame) -> DataFrame:
    """The references of docs: key, doc_id, n."""

    def run(batches):
        for b in lean(batches):
            ids, keys, counts = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own: dict[bytes, int] = {}
                for k in line_keys(t.as_py()):
                    if k is not None:
                        own[k] = own.get(k, 0) + 1
                keys += own
                counts += own.values()
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], ["key", "doc_id", "n"])

    return _ids(docs).mapInArrow(run, "key binary, doc_id long, n long")


def insert(refs: DataFrame, docs: DataFrame) -> DataFrame:
    return refs.unionByName(line_refs(docs)).groupBy("key", "doc_id").agg(F.sum("n").alias("n"))


def delete(refs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """refs without the documents in doc_ids (column doc_id)."""
    gone = doc_ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
    return refs.join(gone, "doc_id", "left_anti")


def reference_counts(refs: DataFrame) -> DataFrame:
    """Exact counts of each key: n_lines, first_doc and last_doc, the smallest and largest id that hold it. Combined before the shuffle."""
    return refs.groupBy("key").agg(F.sum("n").alias("n_lines"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def shared_keys(counts: DataFrame) -> DataFrame:
    return counts.where("first_doc < last_doc")


def _hash(keys) -> np.ndarray:
    """64 bits of each key."""
    return np.frombuffer(b"".join(keys), np.uint64)[::2] if len(keys) else np.empty(0, np.uint64)


def _with_shard(keys: DataFrame, shards: int) -> DataFrame:
    return keys.select("key", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))


FILTERS = "shard int, buckets long, table binary"


def build_filters(keys: DataFrame, shards: int) -> DataFrame:
    """A cuckoo filter for each shard of the (distinct) keys. A shard is a hash range of bounded size, so none is hot."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        h = _hash(pdf["key"].tolist())
        size = len(h)
        while True:
            f = CuckooFilter.sized(size)
            try:
                f.insert(h)
                break
            except Full:
                size *= 2
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "buckets": [f.n], "table": [f.tobytes()]})

    return _with_shard(keys, shards).groupBy("shard").applyInPandas(build, FILTERS)


def remove_keys(filters: DataFrame, keys: DataFrame, shards: int) -> DataFrame:
    """The filters after deleting keys that were in them (their last shared document has gone)."""

    def drop(state: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
        for i, row in state.iterrows():
            f = CuckooFilter(int(row["buckets"]), row["table"])
            f.remove(_hash(gone["key"].tolist()))
            state.at[i, "table"] = f.tobytes()
        return state

    return filters.groupBy("shard").cogroup(_with_shard(keys, shards).groupBy("shard")).applyInPandas(drop, FILTERS)


def add_keys(filters: DataFrame, keys: DataFrame, exact: DataFrame, shards: int) -> DataFrame:
    """The filters after adding (distinct) keys that were not in them. exact: all shared keys by now, from which a shard whose filter is full is built anew."""

    def add(state: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        h = _hash(new["key"].tolist())
        if not len(state):
            return pd.DataFrame({"shard": [int(new["shard"].iloc[0])], "buckets": [0], "table": [b""]})
        shard, f = int(state["shard"].iloc[0]), CuckooFilter(int(state["buckets"].iloc[0]), state["table"].iloc[0])
        try:
            f.insert(h)
        except Full:
            return pd.DataFrame({"shard": [shard], "buckets": [0], "table": [b""]})
        return pd.DataFrame({"shard": [shard], "buckets": [f.n], "table": [f.tobytes()]})

    after = scratch(filters.groupBy("shard").cogroup(_with_shard(keys, shards).groupBy("shard")).applyInPandas(add, FILTERS), "line-filters")
    again = _with_shard(exact, shards).join(F.broadcast(after.where("buckets = 0").select("shard")), "shard").select("key")
    return after.where("buckets > 0").unionByName(build_filters(again, shards))


HITS = "key binary, doc_id long, sure boolean"


def possible_hits(refs: DataFrame, filters: DataFrame, shards: int, hot: DataFrame | None = None, n_refs: int = 0) -> DataFrame:
    """(key, doc_id, sure) of the references that the filters don't rule out; sure where hot (few rows: key, first_doc) says that the line goes.

    n_refs: about how many references there are. References are dealt out by shard and, beyond PROBE_REFS of them a shard, by document.
    """
    copies = max(1, -(-n_refs // (shards * PROBE_REFS)))
    spark = refs.sparkSession
    hot = hot if hot is not None else spark.createDataFrame([], "key binary, first_doc long")
    own = refs.select("key", "doc_id").join(F.broadcast(hot.select("key", "first_doc")), "key", "left").where("first_doc IS NULL OR doc_id > first_doc")
    spread = F.xxhash64("doc_id")
    shard = F.when(F.col("first_doc").isNull(), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")).otherwise(-1 - F.pmod(spread, F.lit(shards * copies)).cast("int"))
    own = own.select(shard.alias("shard"), F.pmod(F.xxhash64(spread), F.lit(copies)).cast("int").alias("copy"), F.lit(1).alias("kind"), "key", "doc_id", F.lit(None).cast("binary").alias("table"))
    held = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("key"), F.col("buckets").alias("doc_id"), "table")
    tasks = max(-(-shards * copies // 4), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def probe(batches):
        at, f = None, None
        for b in batches:
            shard, copy, kind = (b.column(i).to_numpy() for i in range(3))
            hit = np.zeros(b.num_rows, bool)
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0) | (kind[1:] == 0)) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if i == j:
                    continue
                if at != (shard[i], copy[i]):
                    at, f = (shard[i], copy[i]), None
                if kind[i] == 0:  # a shard's filter comes before its references
                    f = CuckooFilter(b.column(4)[i].as_py(), b.column(5)[i].as_py())
                    i += 1
                if i < j:
                    hit[i:j] = at[0] < 0 or (f is not None and f.contains(_hash(b.column(3).slice(i, j - i).to_pylist())))
            keep = pa.array(hit)
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), pa.array(shard < 0)], ["key", "doc_id", "sure"]).filter(keep)

    return own.unionByName(held).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", "kind").mapInArrow(probe, HITS)


def _rewrite(texts: pd.Series, drops: pd.Series) -> pd.DataFrame:
    kept, n, gone = [], [], []
    for t, d in zip(texts, drops):
        t = t or ""
        lines = t.split("\n")
        n.append(len(lines))
        if d is not None and len(d):
            d = set(d)
            stay = [x for x, k in zip(lines, line_keys(t)) if k not in d]
            t = "\n".join(stay)
            gone.append(len(lines) - len(stay))
        else:
            gone.append(0)
        kept.append(t)
    return pd.DataFrame({"text": kept, "n_lines": n, "n_dropped": gone})


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what stays of it, and columns n_lines (before) and n_dropped."""
    n_lines = docs.agg(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    refs = line_refs(docs)
    shared = scratch(shared_keys(reference_counts(refs)), "shared-lines")
    shards = max(1, -(-shared.count() // SHARD_KEYS))
    filters = scratch(build_filters(shared, shards), "line-filters")
    hot = shared.where(F.col("n_lines") * HOT_SHARE >= n_lines)
    hits = scratch(possible_hits(refs, filters, shards, hot, n_lines), "line-hits")
    found = hits.where("NOT sure").join(shared, "key").where("doc_id > first_doc").select("doc_id", "key").unionByName(hits.where("sure").select("doc_id", "key"))
    drops = found.groupBy("doc_id").agg(F.collect_set("key").alias("drops")).withColumnRenamed("doc_id", "drop_id")
    rewrite = F.pandas_udf(_rewrite, "text string, n_lines long, n_dropped long")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("own_id"))
    both = rows.join(drops, F.col("own_id") == F.col("drop_id"), "left").withColumn("new", rewrite("row.text", "drops"))
    keep = [F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return both.select(*keep, F.col("new.n_lines").alias("n_lines"), F.col("new.n_dropped").alias("n_dropped"))
