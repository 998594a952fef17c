"""What several operators of this package share: scratch tables, hashing of words, connected components."""

import string
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Odd multiplier of the rolling hash of a text's bytes, and its inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
#: One random number for each byte value, so that the hash is not linear in the bytes.
BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Bytes that part words: ASCII white space and control characters.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[:33] = True
#: ASCII signs.
IS_SIGN = np.zeros(256, bool)
IS_SIGN[list(string.punctuation.encode())] = True

#: Bytes of a text that are hashed at once. Tables of powers have this length, whatever the length of a text.
PART = 1 << 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


UP, DOWN = _powers(BASE, PART), _powers(BASE_INV, PART)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local one in local mode (tests); a cluster has to name one."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        if not (own := sc._jsc.sc().getCheckpointDir()).isDefined():
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="florile-"))
            own = sc._jsc.sc().getCheckpointDir()
        place = own.get()
    return place.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts lineage and outlives lost executors. Goes when the driver ends."""
    spark = df.sparkSession
    place = f"{shared_dir(spark)}/florile/{name}-{uuid.uuid4().hex}"
    df.write.parquet(place)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return spark.read.schema(df.schema).parquet(place)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in a text's bytes. Words are what stands between white space."""
    edge = np.diff(IS_SPACE[b].astype(np.int8), prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def span_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (in order, apart from each other). Spans within PART bytes are hashed together, longer
    ones in parts, so what is held besides the text and the hashes does not grow with the text."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = int(np.searchsorted(end, low + PART, "right"))
        if j > i:
            own = b[low : int(end[j - 1])]
            total = np.zeros(len(own) + 1, np.uint64)
            np.cumsum(BYTE[own] * UP[: len(own)], out=total[1:])
            out[i:j] = (total[end[i:j] - low] - total[start[i:j] - low]) * DOWN[start[i:j] - low]
            i = j
        else:
            total, shift = np.zeros(1, np.uint64), np.ones(1, np.uint64)
            for k in range(low, int(end[i]), PART):
                own = b[k : min(k + PART, int(end[i]))]
                total += (BYTE[own] * UP[: len(own)]).sum(dtype=np.uint64) * shift
                shift *= UP[PART]
            out[i] = total[0]
            i += 1
    return mix(out + (end - start).astype(np.uint64))


def bare_spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end without the ASCII signs at their ends. Words of signs alone are none."""
    start, end = word_spans(b)
    own = np.flatnonzero(~IS_SIGN[b])
    first = np.searchsorted(own, start)
    some = first < len(own)
    start, end, first = start[some], end[some], first[some]
    last = np.searchsorted(own, end) - 1
    some = first <= last
    return own[first[some]], own[last[some]] + 1


def word_hashes(text: str | None, signs: bool = False) -> np.ndarray:
    """A 64-bit hash for each word of the lower-cased text, in order. signs: signs at the ends of words are part of them."""
    b = np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(b, *(word_spans if signs else bare_spans)(b)) if len(b) else np.empty(0, np.uint64)


def shingles(words: np.ndarray, size: int = 5) -> np.ndarray:
    """The set of hashes of size words in a row, sorted. A text of fewer words has one shingle of all of them; an empty one has none."""
    if not len(words):
        return words
    k = min(size, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = total * BASE + words[i : len(words) - k + 1 + i]
    return np.unique(mix(total))


class Kept(dict):
    """A dictionary of bounded size: when its keys and values take most bytes it starts anew, and takes over from the one before what is
    asked for again, so frequent keys stay."""

    #: Bytes that an entry takes besides its characters, about.
    ENTRY = 200

    def __init__(self, most: int):
        self.most, self.old, self.size = most, {}, 0

    def put(self, keys: list, values: list) -> None:
        self.update(zip(keys, values))
        self.size += sum(map(len, keys)) + sum(map(len, values)) + self.ENTRY * len(keys)

    def turn(self) -> None:
        """Start anew if it is full. What takes more than all the room is not kept at all."""
        if self.size > self.most:
            self.old = dict(self) if self.size <= 2 * self.most else {}
            self.clear()
            self.size = 0

    def unknown(self, keys: Iterable) -> set:
        """The keys that are neither here nor in the one before. Those of the one before are here afterwards."""
        new = {k for k in keys if k not in self}
        again = [k for k in new if k in self.old]
        self.put(again, [self.old[k] for k in again])
        return new.difference(again)


def values(a: pa.Array) -> list[bytes]:
    """The values of a binary array without nulls; to_pylist() takes several times as long."""
    if not len(a):
        return []
    at = np.frombuffer(a.buffers()[1], np.int64 if pa.types.is_large_binary(a.type) else np.int32)[a.offset : a.offset + len(a) + 1].tolist()
    return list(map(a.buffers()[2].to_pybytes().__getitem__, map(slice, at, at[1:])))


#: A key that holds a HOT_SHARE-th of all rows, and HOT_ROWS at least, is hot. There are HOT_SHARE hot keys at most, so a row for each can be broadcast.
HOT_SHARE, HOT_ROWS = 10_000, 1000


def hot_parts(n: Column | str, total: int) -> Column:
    """Into how many parts to deal a key of n rows, so that none is hot; 1 for most keys."""
    return F.greatest(F.ceil(F.col(n) / max(total / HOT_SHARE, HOT_ROWS)), F.lit(1)).cast("int")


def join_hot(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows joined with table, which has one row for each key and says in column n how many of the total rows have it.

    Hot keys are broadcast; the others, of few rows each, are shuffled. rows is read twice, so it should be a table.
    """
    is_hot = hot_parts(n, total) > 1
    few = F.broadcast(table.where(is_hot))
    return rows.join(few, on).unionByName(rows.join(few.select(*on), on, "left_anti").join(table.where(~is_hot), on))


def lean(batches):
    """The batches, one by one; Arrow gives back what it holds of those before. Its pool would else keep it for the life of the worker."""
    for b in batches:
        yield b
        del b
        pa.default_memory_pool().release_unused()


def slices(b: pa.RecordBatch, column: str, most: int):
    """The batch in slices whose texts, or lists, in the column take about most bytes or elements (a longer one stands alone)."""
    c = b.column(b.schema.get_field_index(column))
    sizes = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
    sizes = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
        yield b.slice(i, j - i)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of the edges (a, b): rows (id, component), component being the smallest id in it.

    Alternates "each node's larger neighbours link to its smallest neighbour" with "each node's smaller neighbours do",
    until nothing changes, on edge tables in the shared folder. Nothing but a count and a sum comes to the driver.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = scratch(e, "edges")
    last, total = None, 2 * e.count()
    while total:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
        large = scratch(join_hot(both.where("v > u"), low, ["u"], "n", total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_hot(large, low, ["u"], "n", total).select(F.greatest("v", "m").alias("x"), "m").where("x <> m").select(F.col("x").alias("u"), F.col("m").alias("v"))
        new = scratch(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = new
        if now == last or not now[0]:
            break
        last, total = now, 2 * now[0]
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct())


def candidate_groups(entries: DataFrame, bucket: list[str], block: int, load: int, total: int, member: tuple[str, ...] = ("member",)) -> DataFrame:
    """What to compare with what, from entries (the columns of bucket, of which the first is its rank; member's columns; load), total in number.

    Two members are to be compared in the lowest-ranked bucket that they share. Buckets of one member go; of buckets with the same
    members only the lowest stays. A bucket of over block members, or over load in sum, is dealt into blocks, and each pair of
    blocks (p, q) is a group of its own, so that no group is large. Returns the bucket, p, q, member's columns and side (0 in block p, else 1).
    """
    code = F.xxhash64(*member)
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n"), F.sum("load").alias("all"), F.bit_xor(code).alias("x"), F.bit_xor(F.xxhash64(code, F.lit(1))).alias("y"), F.min(F.struct(*member)).alias("low")).where("n > 1")
    chosen = sizes.groupBy("n", "x", "y", "low").agg(F.min(F.struct(*bucket)).alias("b"), F.max("all").alias("all"))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / load)).cast("int")
    chosen = scratch(chosen.select("b.*", "n", blocks.alias("blocks")), "buckets")
    rows = join_hot(entries, chosen, bucket, "n", total).withColumn("own", F.pmod(F.xxhash64(*member, F.lit(5)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(*bucket, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), *member, (F.col("own") > F.col("other")).cast("int").alias("side"))


def by_group(df: DataFrame, keys: list[str], run, schema: str) -> DataFrame:
    """run(table of one group) for each group of the keys. A task holds one group at a time, and groups are streamed from its sorted rows."""

    def stream(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            new = np.zeros(b.num_rows, bool)
            for c in cols:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if j > i:
                    key = tuple(c[i] for c in cols)
                    if held and key != last:
                        yield from run(pa.Table.from_batches(held)).to_batches()
                        held = []
                    held.append(b.slice(i, j - i))
                    last = key
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


LINKS = "id long, n_links long, root long"


def linked(ids: np.ndarray, copies: np.ndarray, a: np.ndarray, b: np.ndarray, digest: np.ndarray | None = None) -> pa.Table:
    """Rows of LINKS for the pairs (a, b) of positions: how many rows each id links to here, and the smallest id it reaches here. digest: tells apart those with the same id."""
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, a, copies[b])
    np.add.at(n, b, copies[a])
    root = ids.copy()
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == root).all():
            break
        root = new
    on = n > 0
    more = {} if digest is None else {"digest": digest[on]}
    return pa.table({"id": ids[on], "n_links": n[on], "root": root[on]} | more)
