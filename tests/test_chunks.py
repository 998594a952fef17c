"""Walks along lengths in bytes: broken and long inputs."""

import random
import struct
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from florile.functions import arrow
from florile.sources import chunks, files


def of(spark, rows, value):
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(rows)], "i int, content binary")
    return [r["v"] for r in df.select("i", value(F.col("content")).alias("v")).orderBy("i").collect()]


def riff(*parts):
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in parts)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def walked(step, start=0):
    return lambda c: F.transform(chunks.walk(c, start, F.octet_length(c), step), lambda x: F.concat_ws(":", x["id"], x["start"], x["length"]))


def test_broken_bytes(spark):
    """Nulls, empty bytes, lengths that claim too much, that are 0, or that would go back."""
    whole = riff((b"fmt ", b"x" * 16), (b"odd ", b"abc"), (b"data", b""))
    rows = [None, b"", b"RIFF", whole, whole[:-1], whole[:40], whole + b"more\xff\xff\xff\xff", whole + b"m"]
    want = ["fmt :20:16", "odd :44:3", "data:56:0"]
    assert of(spark, rows, walked(chunks.riff, 12)) == [[], [], [], want, want[:2], want[:1], want, want]
    assert of(spark, [b"\0\0\0\x08free\0\0\0\x00mdatxx", b"\0\0\0\x01wide\xff\xff\xff\xff\xff\xff\xff\xff", b"\0\0\0\x04bad "], walked(chunks.box)) == [["free:8:0", "mdat:16:2"], [], []]
    assert of(spark, [b"\x04\0\0\x01a\x81\0\0\x00zzzz", b"\x80\0\0\x09ab"], walked(chunks.flac)) == [["4:4:1", "1:9:0"], []]
    for tags in (chunks.flac_tags, chunks.wav_tags, chunks.mp4_tags, chunks.id3_tags, chunks.ogg_tags):
        assert of(spark, [None, b"", b"other", b"fLaC", b"ID3", b"OggS", b"RIFF\0\0\0\0WAVE", b"\0\0\0\x08ftyp"], lambda c, t=tags: F.coalesce(F.size(t(c)), F.lit(0))) == [0] * 8


def test_comments(spark):
    entry = lambda b: struct.pack("<I", len(b)) + b
    body = lambda n, *e: entry(b"v") + struct.pack("<I", n) + b"".join(map(entry, e))
    block = lambda b: b"fLaC\x84" + len(b).to_bytes(3, "big") + b
    rows = [block(body(3, b"A=1", "a=é=2".encode(), b"B=")), block(body(1, b"A=1", b"B=2")), block(body(9, b"A=1")), block(body(2, b"A=1") + b"\xff\xff\xff\x7f"), block(b"\xff\xff\xff\xff"), block(b"")]
    assert of(spark, rows, chunks.flac_tags) == [{"A": ["1", "é=2"], "B": [""]}, {"A": ["1"]}, {"A": ["1"]}, {"A": ["1"]}, {}, {}]


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_many_chunks(spark, n):
    found = of(spark, [riff(*[(f"{k:04}".encode(), b"z" * (k % 3)) for k in range(n)])], walked(chunks.riff, 12))[0]
    assert [x[:4] for x in found] == [f"{k:04}" for k in range(n)] and [x[-1] for x in found] == [str(k % 3) for k in range(n)]


def test_linear(spark):
    """Time in proportion to the number of chunks, and a frame behind many segments."""

    def took(n):
        rows = [riff(*[(b"abcd", b"zz")] * n)] * 2
        began = time.time()
        assert of(spark, rows, lambda c: F.size(walked(chunks.riff, 12)(c))) == [n, n]
        return time.time() - began

    took(100)
    assert took(40_000) < 3.5 * max(took(20_000), 0.5)
    jpeg = b"\xff\xd8" + b"\xff\xe2\x00\x03x" * 3000 + b"\xff\xc2\x00\x11\x08\x00\x09\x00\x07\x03"
    assert of(spark, [jpeg, jpeg[:-8]], lambda c: files.image_size(c)["width"]) == [7, None]


def test_segments_by_batches(spark):
    """Sizes of JPEG from batches equal those by expressions: broken ones, nulls, frames cut short, few and many rows, also where a batch begins inside a buffer."""
    rng = random.Random(2)
    part = lambda: rng.choice([b"\xff\xe0\x00\x02", b"\xff\xe1\x00\x05abc", b"\xff\xc4\x00\x03x", b"\xff\xff\x00\x04ab", b"\xff\xfe\x01\x00" + b"z" * 254])
    last = lambda: rng.choice([b"", b"\xff\xda\x00\x02", b"\xff\xe0\x00\x01", b"\xfe\xe0\x00\x09", b"\xff\xe0\xff\xff", b"\xff\xd9"]) + b"\xff" + bytes([rng.choice([0xC0, 0xC2, 0xCF, 0xC8])]) + b"\x00\x11\x08\x01\x09\x02\x07\x03"[: rng.choice([1, 2, 4, 6, 8])]
    rows = [None, b"", b"\xff\xd8\xff", b"\xff\xd8", b"GIF89a\x07\x00\x09\x00"] + [b"\xff\xd8\xff\xe0\x00\x02" + b"".join(part() for _ in range(rng.randrange(12))) + last() for _ in range(400)]
    for own in (rows, rows[:30], rows[:1] * 3):
        plain = of(spark, own, lambda c: files.image_size(c, plain=True))
        assert of(spark, own, files.image_size) == plain
    assert {r["width"] for r in of(spark, rows, files.image_size) if r is not None} == {None, 7, 0x207}
    few = pa.array([bytes(b) if b is not None else None for b in rows[4:]])
    kinds = frozenset(k & 0xFF for k in files.FRAMES)
    whole = pa.concat_arrays([pa.array([b"before"]), few])[1:]
    shift = np.where(arrow._frames(few, kinds) < 0, 0, 6)
    assert (arrow._frames(whole, kinds) - shift == arrow._frames(few, kinds)).all()


def test_many_segments(spark):
    """Some ten million segments in a few seconds, in many rows and in one."""
    other = b"\xff\xe2\x00\x03x"
    frame = b"\xff\xc2\x00\x11\x08\x00\x09\x00\x07\x03"
    df = spark.range(8000).select(F.concat(F.lit(bytearray(b"\xff\xd8")), F.unhex(F.repeat(F.lit(other.hex()), F.when(F.col("id") == 0, 2_000_000).otherwise(1000))), F.lit(bytearray(frame))).alias("content"))
    began = time.time()
    assert [tuple(r) for r in df.repartition(4).select(files.image_size(F.col("content")).alias("s")).groupBy("s.mime", "s.width", "s.height").count().collect()] == [("image/jpeg", 7, 9, 8000)]
    assert time.time() - began < 60
