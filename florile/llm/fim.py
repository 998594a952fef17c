"""Fill-in-the-middle transformation by rotations in place.

A text is cut into units (lines, or whatever UNITS has), two cuts part it into prefix, middle and suffix, and the three are written in
the order that a model learns to fill in: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), each after its sentinel. Cuts and
form follow from a hash of the seed and the doc_id alone, so a document has the same output wherever and however often it is worked on.

The text's bytes stand in one bytearray. Cuts are scanned, sentinels are inserted, and segments change places by rotations of three
reversals each, which need no second copy of the text. Restoring finds the sentinels, turns the rotation back and takes them out.

Defined results: a null text is an empty one; empty texts, texts that hold a sentinel, and those that the rate leaves out stay as they
are (form plain, lengths null); a null doc_id is hashed as an empty string; rows that repeat are transformed each, alike; other
columns are ignored; an empty table gives an empty result.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM_FORM = "plain", "psm", "spm"
#: Bytes that a reversal moves at once, and bytes of texts that a task holds besides its batch.
STEP, HELD = 1 << 16, 8 << 20


def reverse(b: np.ndarray) -> None:
    """Turn the bytes round in place, STEP from both ends at a time."""
    i, j = 0, len(b)
    while j - i > 2 * STEP:
        left = b[i : i + STEP].copy()
        b[i : i + STEP] = b[j - STEP : j][::-1]
        b[j - STEP : j] = left[::-1]
        i, j = i + STEP, j - STEP
    b[i:j] = b[i:j][::-1].copy()


def rotate(b: bytearray, start: int, cut: int, end: int) -> None:
    """Let the segments start:cut and cut:end change places."""
    v = np.frombuffer(b, np.uint8)
    reverse(v[start:cut])
    reverse(v[cut:end])
    reverse(v[start:end])


def line_ends(b: bytes) -> np.ndarray:
    """Where each unit ends: after a line feed, or with the text."""
    ends = np.flatnonzero(np.frombuffer(b, np.uint8) == 10) + 1
    return ends if not len(b) or len(ends) and ends[-1] == len(b) else np.append(ends, len(b))


def char_ends(b: bytes) -> np.ndarray:
    """Where each code point ends."""
    starts = np.flatnonzero(np.frombuffer(b, np.uint8) & 0xC0 != 0x80)
    return np.append(starts[1:], len(b)) if len(b) else starts


UNITS: dict[str, Callable[[bytes], np.ndarray]] = {"line": line_ends, "char": char_ends}


def has_sentinel(b: bytes) -> bool:
    return any(s in b for s in (PREFIX, SUFFIX, MIDDLE))


def length(b: bytes) -> int:
    """Code points of UTF-8."""
    return int(np.count_nonzero(np.frombuffer(b, np.uint8) & 0xC0 != 0x80))


def build(text: bytes, first: int, last: int, form: str) -> bytearray:
    """The text cut at the bytes first <= last, in the order of the form."""
    b = bytearray(text)
    b[last:last] = SUFFIX
    b[first:first] = MIDDLE
    b[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), last + len(PREFIX) + len(MIDDLE)
    rotate(b, middle if form == PSM else 0, suffix, len(b))
    return b


def restore(output: bytes, form: str) -> bytes:
    """The text that was built into output. It holds no sentinel, so the first of each in output is the one that was inserted."""
    if form == PLAIN:
        return output
    b = bytearray(output)
    if form == PSM:
        suffix, middle = b.index(SUFFIX), b.index(MIDDLE)
        rotate(b, suffix, middle, len(b))
        middle, suffix = suffix, suffix + len(b) - middle
    else:
        prefix, middle = b.index(PREFIX), b.index(MIDDLE)
        rotate(b, 0, prefix, len(b))
        middle, suffix = middle - prefix, len(b) - prefix
    del b[suffix : suffix + len(SUFFIX)]
    del b[middle : middle + len(MIDDLE)]
    del b[: len(PREFIX)]
    return bytes(b)


def choices(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits: the first eight hexadecimal digits, and so on, of a hash of the seed and the doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)))


def _transform(unit: str, rate: int, spm: int):
    def run(batches):
        for whole in lean(batches):
            for b in slices(whole, "bytes", HELD):
                counts, forms, before, between, outputs = [], [], [], [], []
                for text, h in zip(b.column(1), b.column(2).to_pylist()):
                    text = text.as_py()
                    ends = UNITS[unit](text)
                    counts.append(len(ends))
                    if not text or h[2] % 100 >= rate or has_sentinel(text):
                        forms.append(PLAIN)
                        before.append(None)
                        between.append(None)
                        outputs.append(text)
                        continue
                    low, high = sorted((h[0] % (len(ends) + 1), h[1] % (len(ends) + 1)))
                    first, last = (int(ends[k - 1]) if k else 0 for k in (low, high))
                    forms.append(SPM_FORM if h[3] % 100 < spm else PSM)
                    before.append(length(text[:first]))
                    between.append(length(text[first:last]))
                    outputs.append(bytes(build(text, first, last, forms[-1])))
                arrays = [b.column(0), pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(outputs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform(docs: DataFrame, seed: int = SEED, unit: str = "line", rate: int = RATE, spm: int = SPM) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of each row of docs. rate: so many of a hundred texts are cut; spm: so many of a hundred of those are spm."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"), choices(F.col("doc_id"), seed).alias("h"))
    out = rows.mapInArrow(_transform(unit, rate, spm), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.decode("output", "UTF-8"))


def _restored(batches: Iterator[pa.RecordBatch]):
    for whole in lean(batches):
        for b in slices(whole, "output", HELD):
            at = b.schema.get_field_index
            texts = [restore(x.as_py(), form) for x, form in zip(b.column(at("output")), b.column(at("form")).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "restored"])


def restored(rows: DataFrame) -> DataFrame:
    """rows (output, form and others) with restored, the texts that they were made of."""
    fields = ", ".join(f"`{f.name}` {'binary' if f.name == 'output' else f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.withColumn("output", F.col("output").cast("binary")).mapInArrow(_restored, f"{fields}, restored binary")
    return out.withColumns({c: F.decode(c, "UTF-8") for c in ("output", "restored")})
