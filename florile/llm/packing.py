"""Packing of documents into token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document is tokenised (then the end id) and cut into full sequences and a rest. The rests are dealt at random into groups of
about GROUP_CHARS characters, so groups grow in number with the input, not in size, and no key is hot: rows that are equal in all, doc_id
included, are told apart by their task and a number there, so they are dealt out like others. Within a group, rests go by
falling length into the first open sequence with room, which a tournament tree over the sequences' room finds in logarithmic time.
Then the emptiest sequences are taken apart to fill the gaps of the fullest, and what remains (under one sequence a group) is
cut at powers of two, whose sequences need no padding.

Defined results: a null text is an empty one, which is one piece of the end id alone; each row is a document of its own, also where
rows repeat or a doc_id is null; other columns are ignored; an empty table gives no pieces.
"""

import json
import os
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, lean, slices, values

SIZE, END = 4096, 2
#: Characters of a group, and groups of a task: tasks grow in number with the input, not in size.
GROUP_CHARS, GROUPS_A_TASK = 4_000_000, 32
#: Bytes of words and ids that a process keeps (twice as many at most); bytes of texts and new words that are taken at once.
KEPT_BYTES, BYTES_AT_ONCE, NEW_AT_ONCE = 48 << 20, 4 << 20, 4096
#: Characters of a long text that are taken at once, or of one that the tokenizer itself reads, which takes some 100 bytes for each.
STRETCH = 1 << 18

#: Fixed value: the split pattern of the public vocabulary file word_bpe_49k.json, for text in lower case.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Where texts may be cut.
GAP = re.compile(r"[ \t\n\r]")
#: Stretches with anything else go through the tokenizer itself: special tokens, control characters, rare white space, other scripts.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-Ɂ‐-‧‰-⁞€]*")
#: What WORD makes of each character that a plain text can have in lower case.
SPACE, LETTER, NUMBER, SIGN = range(4)
KIND = np.array([SPACE if chr(i).isspace() else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(i))[0], SIGN) for i in range(0x3000)], np.uint8)


def split_words(c: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Where the pieces that WORD finds in UTF-16 code units start, and those pieces. The last unit is a space."""
    kind = KIND[c]
    new = kind == NUMBER
    new[0] |= kind[0] != SPACE
    new[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] != SPACE)
    # A lone apostrophe takes the ending after it.
    at = np.flatnonzero(c == ord("'"))
    at = at[new[at] & (kind[at + 1] == LETTER)]
    one, two = c[at + 1], c[np.minimum(at + 2, len(c) - 1)]
    pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    some = pair | np.isin(one, [ord(x) for x in "stmd"])
    new[at[some] + 1] = False
    after = at[some] + np.where(pair[some], 3, 2)
    new[after] |= kind[after] == LETTER
    own = kind != SPACE
    offsets = np.append(np.flatnonzero(new[own]), np.count_nonzero(own)).astype(np.int32) * c.itemsize
    return np.flatnonzero(new), pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(c[own])])


def units(texts: list[str]) -> np.ndarray:
    """The UTF-16 code units of texts in a row, a space after each."""
    return np.frombuffer("".join(x for t in texts for x in (t, " ")).encode("utf-16-le"), "<u2")


def split_word(w: str) -> list[str]:
    """The pieces that WORD cuts a plain text into."""
    return [x.decode("utf-16-le") for x in values(split_words(units([w]))[1])]


def is_plain(t: str) -> bool:
    return "<|" not in t and PLAIN.fullmatch(t) is not None


def lowered(t: str) -> str:
    return (t if unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t)).lower()


def stretches(t: str) -> Iterator[str]:
    """A text in parts of about STRETCH characters, each of which has the ids that it has in the text: no piece or special token holds white space."""
    i = 0
    while i < len(t):
        j = gap.start() if (gap := GAP.search(t, i + STRETCH)) else len(t)
        yield t[i:j]
        i = j


class Words:
    """Ids of texts. Pieces that the vocabulary splits a text into are found and told apart by column, so ids of each different one are looked up or made once."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.t, self.known = Tokenizer.from_file(vocabulary), Kept(KEPT_BYTES)
        # The same merges for words that are normalised and split already; as each comes once, a cache there would only cost.
        m = json.loads(self.t.to_str())["model"]
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.words = Tokenizer(models.BPE(m["vocab"], merges, cache_capacity=0, end_of_word_suffix=m["end_of_word_suffix"]))
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.t.get_vocab()
        self.kind = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # each word has one piece, its last, that says so
        self.ends[[i for p, i in vocab.items() if p.endswith("</w>")]] = True

    def _learn(self, new: list[bytes]) -> None:
        for i in range(0, len(new), NEW_AT_ONCE):
            part = new[i : i + NEW_AT_ONCE]
            ids = np.array(self.words.encode_batch_fast([b" \0".join(part).decode("utf-16-le")], add_special_tokens=False)[0].ids, self.kind)
            at = (ids.itemsize * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            ids = ids.tobytes()
            self.known.put(part, list(map(ids.__getitem__, map(slice, [0, *at], at))))

    def _plain(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts in lower case."""
        starts, pieces = split_words(units(texts))
        coded = pieces.dictionary_encode()
        code, own = coded.indices.to_numpy(), values(coded.dictionary)
        self.known.turn()
        if new := self.known.unknown(own):
            self._learn(list(new))
        own = list(map(self.known.__getitem__, own))
        ids, n = np.frombuffer(b"".join(own), self.kind), np.fromiter(map(len, own), np.int64, len(own)) // np.dtype(self.kind).itemsize
        first, n = (np.cumsum(n) - n)[code], n[code]
        to = np.append(0, np.cumsum(n))
        ids = ids[np.repeat(first - to[:-1], n) + np.arange(to[-1])]
        cuts = to[np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))].tolist()
        return [ids[i:j].tobytes() for i, j in zip([0, *cuts], cuts)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian numbers of self.kind."""
        out: list[bytes | None] = [None] * len(texts)
        short: dict[int, str] = {}
        for i, t in enumerate(texts):
            if len(t) <= BYTES_AT_ONCE and is_plain(t):
                short[i] = lowered(t)
            else:
                out[i] = b"".join(self._plain([lowered(x)])[0] if is_plain(x) else np.array(self.t.encode(x, add_special_tokens=False).ids, self.kind).tobytes() for x in stretches(t))
        if short:
            for i, ids in zip(short, self._plain(list(short.values()))):
                out[i] = ids
        return out


_words: dict[str, Words] = {}


def words_of(vocabulary: str) -> Words:
    """One for each worker process, so that tasks find the words of those before them."""
    if vocabulary not in _words:
        _words[vocabulary] = Words(vocabulary)
    return _words[vocabulary]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Tournament:
    """Room of sequences in a row; each inner node holds the most room below it."""

    def __init__(self, bins: int, room: int):
        self.width = 1 << max(0, (bins - 1).bit_length())
        self.most = [room] * (2 * self.width)

    def first(self, need: int) -> int:
        """The first sequence with so much room."""
        i = 1
        while i < self.width:
            i *= 2
            if self.most[i] < need:
                i += 1
        return i - self.width

    def take(self, bin_: int, need: int) -> None:
        i = bin_ + self.width
        self.most[i] -= need
        while i > 1:
            i //= 2
            self.most[i] = max(self.most[2 * i], self.most[2 * i + 1])


def pack(lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, from, length): each item's tokens once, each sequence full or a power of two."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    tree, bins = Tournament(max(1, len(lengths)), size), []
    for i in order:
        k = tree.first(lengths[i])
        tree.take(k, lengths[i])
        while len(bins) <= k:
            bins.append([])
        bins[k].append((i, 0, lengths[i]))
    used = [sum(x[2] for x in b) for b in bins]
    by = sorted(range(len(bins)), key=lambda k: -used[k])
    lo, hi = 0, len(by) - 1
    while lo < hi:  # fill the gaps of the fullest from the emptiest
        if used[by[lo]] == size:
            lo += 1
            continue
        i, start, n = bins[by[hi]].pop()
        move = min(n, size - used[by[lo]])
        bins[by[lo]].append((i, start, move))
        used[by[lo]] += move
        used[by[hi]] -= move
        if n > move:
            bins[by[hi]].append((i, start + move, n - move))
        if not bins[by[hi]]:
            hi -= 1
    out = [b for b in bins if b]
    if out and (left := used[by[lo]]) < size and left & (left - 1):
        rest = bins[by[lo]]
        out.remove(rest)
        while left:
            room, own = 1 << (left.bit_length() - 1), []
            left -= room
            while room:
                i, start, n = rest.pop()
                move = min(n, room)
                own.append((i, start, move))
                room -= move
                if n > move:
                    rest.append((i, start + move, n - move))
            out.append(own)
    return out


def _cut(vocabulary: str, size: int, end: int):
    """Rows of full sequences (without ids) and of rests (with them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, copies, task = words_of(vocabulary), Counter(), TaskContext.get().partitionId() << 40
        for b in lean(batches):
            for part in slices(b, "text", BYTES_AT_ONCE):
                rows = []
                for doc, raw in zip(part.column(0).to_pylist(), words.encode([t or "" for t in part.column(1).to_pylist()])):
                    own = np.append(np.frombuffer(raw, words.kind), words.kind(end))
                    full = len(own) // size * size
                    # Equal rows of a task are numbered, which is the same whatever order they come in.
                    same = hash((-1 if doc is None else doc, len(own), zlib.crc32(raw)))
                    copy = task + copies[same]
                    copies[same] += 1
                    rows += [(doc, s, size, crc(own[s : s + size]), len(own), None, copy) for s in range(0, full, size)]
                    if full < len(own):
                        rows.append((doc, full, len(own) - full, 0, len(own), own[full:].tobytes(), copy))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "copy"])

    return run


OUT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _group(size: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        doc, start, length, sums, tokens, ids = (table.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"))
        first, rows = table.column("g")[0].as_py() << 32, []
        for k, i in enumerate(i for i, x in enumerate(ids) if x is None):
            rows.append((doc[i], start[i], length[i], sums[i], tokens[i], first + k, 0))
        own = [i for i, x in enumerate(ids) if x is not None]
        seq = first + len(rows)
        for pieces in pack([length[i] for i in own], size):
            at = 0
            for item, s, n in pieces:
                i = own[item]
                rows.append((doc[i], start[i] + s, n, crc(np.frombuffer(ids[i], f"u{len(ids[i]) // length[i]}")[s : s + n]), tokens[i], seq, at))
                at += n
            seq += 1
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=[x.split()[0] for x in OUT.split(", ")])

    return run


def pack_documents(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, group_chars: int = GROUP_CHARS, seed: int = 7) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset there."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, round(chars / group_chars))
    pieces = d.mapInArrow(_cut(vocabulary, size, end), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, copy long")
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "doc_tokens", "ids", "copy"), F.lit(groups))).drop("copy")
    tasks = max(-(-groups // GROUPS_A_TASK), min(groups, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(tasks, "g").groupBy("g").applyInArrow(_group(size), OUT)
