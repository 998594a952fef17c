"""The few text functions that Spark lacks, and a walk along lengths in bytes, as Arrow-batched functions of one column (made when called, as they need a session)."""

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words that stay in lower case inside a title.
SMALL_WORDS = frozenset("a an and as at but by for in nor of on or per the to v via vs".split())
TITLE_WORD = re.compile(r"(?<!\w)[^\W_](?:[^\W_]|['’.\-])*")
LETTER = re.compile(r"[^\W\d_]")


def _per_value(fn, c: Column) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn, na_action="ignore").astype(object)

    return F.pandas_udf(run, "string")(c)


def _title(text: str) -> str:
    def one(m: re.Match) -> str:
        w = m.group()
        if re.search("[A-Z]", w) and re.search("[a-z]", w):
            return w
        low = w.lower()
        if m.start() > 0 and m.end() < len(text) and low.replace(".", "") in SMALL_WORDS:
            return low
        return LETTER.sub(lambda x: x.group().upper(), low, count=1)

    return TITLE_WORD.sub(one, text)


def nfc(c: Column) -> Column:
    """Composed Unicode form. Texts of ASCII alone are in it already and stay in the JVM's hands."""
    odd = c.rlike(r"[^\x00-\x7f]")
    return F.when(odd, _per_value(lambda t: unicodedata.normalize("NFC", t), F.when(odd, c))).otherwise(c)


def unescape(c: Column) -> Column:
    """All HTML character references."""
    return _per_value(html.unescape, c)


def title_case(c: Column) -> Column:
    """Words of mixed case stay; small words are lower case unless the text begins or ends with them; others get a capital as their first letter."""
    return _per_value(_title, c)


#: Rows whose segments are followed all at once; fewer are followed one by one.
TOGETHER = 64


def _frames(content: pa.Array, frames: frozenset[int]) -> np.ndarray:
    """Where the first segment of JPEG with one of these markers begins, in the buffer of a batch; -1 without one. Each round takes one segment of every row that has not ended."""
    at, end = _places(content)
    data = np.frombuffer(content.buffers()[2] or b"", np.uint8)
    kinds, found = np.isin(np.arange(256), list(frames)), np.full(len(at), -1, np.int64)
    live = np.flatnonzero(np.asarray(content.is_valid().to_numpy(zero_copy_only=False)))
    at = at[live] + 2
    while len(live) > TOGETHER:
        there = at + 4 <= end[live]
        live, at = live[there], at[there]
        kind, n = data[at + 1], data[at + 2].astype(np.int64) * 256 + data[at + 3]
        good = (data[at] == 0xFF) & (n >= 2) & (kind != 0xDA)
        own = good & kinds[kind]
        found[live[own]] = at[own]
        good &= ~own
        live, at = live[good], (at + 2 + n)[good]
    whole = memoryview(data)
    for k, p in zip(live.tolist(), at.tolist()):
        last = int(end[k]) - 4
        while p <= last and whole[p] == 0xFF and (kind := whole[p + 1]) != 0xDA and (n := whole[p + 2] << 8 | whole[p + 3]) >= 2:
            if kind in frames:
                found[k] = p
                break
            p += 2 + n
    return found


def _places(content: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each row's bytes begin and end in the buffer of a batch."""
    offsets = np.frombuffer(content.buffers()[1], np.int64 if pa.types.is_large_binary(content.type) else np.int32)[content.offset : content.offset + len(content) + 1]
    return offsets[:-1].astype(np.int64), offsets[1:].astype(np.int64)


def frame_size(content: Column, frames: list[int]) -> Column:
    """(width, height) that the first segment with one of these markers of two bytes says in JPEG; nulls without one, or where the bytes end before."""
    kinds = frozenset(k & 0xFF for k in frames)

    def run(c: pa.Array) -> pa.Array:
        if not len(c):
            return pa.array([], size)
        found, (_, end) = _frames(c, kinds), _places(c)
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)

        def number(skip: int) -> pa.Array:
            there = (found >= 0) & (found + skip + 2 <= end)
            at = found[there] + skip
            out = np.zeros(len(found), np.int64)
            out[there] = data[at].astype(np.int64) * 256 + data[at + 1]
            return pa.array(out, mask=~there)

        return pa.StructArray.from_arrays([number(7), number(5)], fields=list(size))

    size = pa.struct([("width", pa.int64()), ("height", pa.int64())])
    return F.arrow_udf(run, "struct<width:bigint,height:bigint>")(content)
