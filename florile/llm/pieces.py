"""SentencePiece encoding and decoding by suffix-array matching, for BPE models with byte fallback.

Texts are cut between any two characters that stand side by side in no piece, as no piece reaches over such a place: what stands
between cuts, a unit, has the same pieces wherever it stands. Units are found and told apart by column, and their pieces kept.

The new units of a batch of texts are joined into one text, whose suffixes are sorted (as deep as the longest piece). A binary
search for every piece of the vocabulary gives the range of suffixes that begin with it: all its occurrences. These are the edges of
a lattice over the text, a table of places and lengths. Relaxing it the BPE way joins, in every unit at once and round by round,
the two neighbouring symbols whose union is the edge of the best score, the leftmost of equals, until no edge joins two symbols.
Characters that end up in no piece become bytes. Units over LONG characters are relaxed with a heap over the same edges instead of in
rounds.

Defined results: null and empty texts have no pieces and decode to an empty text; texts with the space mark U+2581 decode it to a
space, as the format has it; invalid byte sequences decode to U+FFFD; other columns stay; an empty table gives an empty result.
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, lean, slices, values

MARK = "▁"
#: Longest unit that is relaxed in rounds; bytes of units and ids that a process keeps (twice as many at most); bytes of texts that are
#: encoded at once, and cells (characters by lengths of pieces) of the edges of new units.
LONG, KEPT_BYTES, BATCH_BYTES, CELLS = 48, 48 << 20, 2 << 20, 8_000_000
#: Units up to so many characters are relaxed side by side.
WIDTHS = (4, 6, 8, 10, 12, 16, 24, LONG)
#: Letters that are told apart where texts are cut. Those beyond count as one, which makes fewer cuts.
LETTERS = 4096
NONE = np.int32((1 << 31) - 1)


def suffixes(code: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of letters in the order of what follows them (depth symbols; 0, which parts units, is below all, and what follows it
    doesn't count); their first 8 bytes as numbers, and the places of those that go on beyond them."""
    per = 8 // code.dtype.itemsize
    column = np.concatenate([code, np.zeros(depth, code.dtype)]).astype(np.uint64)
    n = 1
    while n < per:
        column[:-n] = column[:-n] << np.uint64(8 * n * code.dtype.itemsize) | column[n:]
        n *= 2
    at = np.flatnonzero(code)
    order = at[np.argsort(column[at])]
    first = column[order]
    on = np.flatnonzero(first & np.uint64(256**code.dtype.itemsize - 1))
    same = first[1:] == first[:-1]
    tied = on[(np.append(same, False) | np.append(False, same))[on]]
    deep = order[tied]
    order[tied] = deep[np.lexsort([column[deep + k] for k in range(depth - per, -1, -per)])]
    return order, first, on


class Pieces:
    def __init__(self, model_file: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        names = [m.id_to_piece(i) for i in range(n)]
        self.kind = np.uint16 if n + 1 < 1 << 16 else np.uint32
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(names) if m.is_byte(i)}
        byte_of = {i: b for b, i in self.byte.items()}
        shown = [bytes([byte_of[i]]) if i in byte_of else b"" if m.is_control(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.size = n
        #: What each id stands for, and what it stands for at the head of a text.
        self.shown = pa.array(shown + [p[1:] if p[:1] == b" " else p for p in shown], pa.binary())
        self.seen = np.array([len(p) > 0 for p in shown])
        self.unknown = m.unk_id()
        usual = [i for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        usual.sort(key=names.__getitem__)  # so that a search finds its neighbours' places warm
        self.ids, self.lens = np.array(usual), np.array([len(names[i]) for i in usual])
        self.starts = np.cumsum(self.lens) - self.lens
        self.points = np.frombuffer("".join(names[i] for i in usual).encode("utf-32-le"), np.uint32)
        self.depth = -(-int(self.lens.max()) // 8) * 8
        self.step = int(self.lens.max()) + 1  # of an edge's cell, between places
        scores = np.array([m.get_score(i) for i in usual])
        #: By id and 1; 0 is no piece.
        self.rank_of = np.full(n + 1, NONE, np.int32)
        self.rank_of[self.ids + 1] = np.unique(-scores, return_inverse=True)[1]
        # Which characters stand side by side in a piece.
        inner = np.ones(len(self.points), bool)
        inner[self.starts] = False
        right = np.flatnonzero(inner)
        letters = np.unique(np.concatenate([self.points[right - 1], self.points[right]]))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[letters] = np.minimum(np.arange(1, len(letters) + 1), LETTERS - 1)
        self.letters = int(self.letter.max()) + 1
        self.joined = np.zeros(self.letters**2, bool)
        self.joined[self.letter[self.points[right - 1]] * self.letters + self.letter[self.points[right]]] = True
        self.known = Kept(KEPT_BYTES)

    def _edges(self, points: np.ndarray) -> np.ndarray:
        """The id, and 1, of the piece at each place of each length (place * step + length); 0 where there is none."""
        cells = np.zeros(len(points) * self.step, self.kind)
        letters = np.unique(points[points != 0])
        wide = 1 if len(letters) < 255 else 2 if len(letters) < 65_535 else 4
        table = np.zeros(int(letters[-1]) + 1 if len(letters) else 1, f"u{wide}")
        table[letters] = np.arange(1, len(letters) + 1)
        own = np.where(self.points < len(table), table[np.minimum(self.points, len(table) - 1)], 0)
        fits = np.minimum.reduceat(own, self.starts) > 0
        if not fits.any():
            return cells
        code = table[points]
        order, first, on = suffixes(code, self.depth)
        lens, ids = self.lens[fits], self.ids[fits]
        low = np.zeros((len(lens), self.depth), f">u{wide}")
        high = np.full((len(lens), self.depth), 256**wide - 1, f">u{wide}")
        r = np.repeat(np.arange(len(lens)), lens)
        c = np.arange(len(r)) - np.repeat(np.cumsum(lens) - lens, lens)
        low[r, c] = high[r, c] = own[np.repeat(fits, self.lens)]
        per = 8 // wide
        begin, end = np.searchsorted(first, low.view(">u8")[:, 0].astype(np.uint64), "left"), np.searchsorted(first, high.view(">u8")[:, 0].astype(np.uint64), "right")
        if len(deep := np.flatnonzero(lens > per)):  # pieces longer than 8 bytes, among the suffixes that are
            kind = f"S{wide * self.depth}"
            padded = np.concatenate([code, np.zeros(self.depth, code.dtype)])
            keys = np.lib.stride_tricks.sliding_window_view(padded, self.depth)[order[on]].astype(f">u{wide}").view(kind).ravel()
            on = np.append(on, len(order))
            begin[deep] = on[np.searchsorted(keys, low[deep].view(kind).ravel(), "left")]
            n = np.searchsorted(keys, high[deep].view(kind).ravel(), "right") - np.searchsorted(keys, low[deep].view(kind).ravel(), "left")
            end[deep] = begin[deep] + n  # those that begin with the same 8 bytes stand side by side
        n = end - begin
        at = order[np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        cells[at * self.step + np.repeat(lens, n)] = np.repeat(ids + 1, n)
        return cells

    def _learn(self, new: list[bytes]) -> None:
        points = np.frombuffer(b"\0\0\0\0".join([*new, b""]), "<u4")
        sizes = np.fromiter(map(len, new), np.int64, len(new)) // 4
        start = np.cumsum(sizes + 1) - sizes - 1
        cells = self._edges(points)
        begins = np.ones(len(points), bool)
        begins[start + sizes] = False
        least = 1
        for most in WIDTHS:
            own = start[(sizes > least) & (sizes <= most)]
            if len(own):
                self._rounds(own, sizes[(sizes > least) & (sizes <= most)], most, begins, cells)
            least = most
        for w in np.flatnonzero(sizes > LONG):
            self._heap(int(start[w]), int(sizes[w]), begins, cells)
        s = np.flatnonzero(begins)
        unit = np.searchsorted(start, s, "right") - 1
        end = np.append(s[1:], 0)
        last = np.append(unit[1:] != unit[:-1], True)
        end[last] = (start + sizes)[unit[last]]
        got = cells[s * self.step + end - s].astype(np.int64) - 1
        size = np.ones(len(got), np.int64)
        odd = np.flatnonzero(got < 0)  # characters of no piece become bytes
        spelt = [[self.byte.get(x, self.unknown) for x in chr(c).encode("utf-8", "surrogatepass")] for c in points[s[odd]].tolist()]
        size[odd] = [len(x) for x in spelt]
        flat = np.repeat(got, size).astype(self.kind)
        for i, x in zip((np.cumsum(size) - size)[odd].tolist(), spelt):
            flat[i : i + len(x)] = x
        cut = (flat.itemsize * np.cumsum(np.bincount(unit, size, len(new)).astype(np.int64))).tolist()
        self.known.put(new, list(map(flat.tobytes().__getitem__, map(slice, [0, *cut], cut))))

    def _rounds(self, start: np.ndarray, sizes: np.ndarray, wide: int, begins: np.ndarray, cells: np.ndarray) -> None:
        """Relax units of wide characters at most. In each, symbol i goes on to after[i], before[i] is the symbol before it (-1: none), and score[i] is of its union with the next.
        As no edge reaches over the 0 that ends a unit, unions that would are of no score."""
        after, before = np.tile(np.arange(1, wide + 2), (len(start), 1)), np.tile(np.arange(-1, wide), (len(start), 1))
        at = start[:, None] + np.arange(wide)
        score = np.where(np.arange(wide) < sizes[:, None] - 1, self.rank_of[cells[np.minimum(at * self.step + 2, len(cells) - 1)]], NONE) if self.step > 2 else np.full(at.shape, NONE)

        def union(place: np.ndarray, length: np.ndarray) -> np.ndarray:
            return self.rank_of[cells[place * self.step + np.where(length < self.step, length, 0)]]

        while len(start):
            i = score.argmin(1)
            r = np.flatnonzero(score[np.arange(len(start)), i] < NONE)
            if len(r) < 0.8 * len(start):
                start, i, score, after, before = start[r], i[r], score[r], after[r], before[r]
                r = np.arange(len(start))
            else:
                i = i[r]
            s, a, b = r * wide, r * (wide + 1), start[r]
            flat_score, flat_after, flat_before = score.reshape(-1), after.reshape(-1), before.reshape(-1)
            j = flat_after[a + i]
            k = flat_after[a + j]
            begins[b + j] = False
            flat_after[a + i] = k
            flat_before[a + k] = i
            flat_score[s + j] = NONE
            flat_score[s + i] = union(b + i, flat_after[a + k] - i)
            h = flat_before[a + i]
            flat_score[s + np.where(h < 0, i, h)] = np.where(h < 0, flat_score[s + i], union(b + h, k - h))

    def _heap(self, start: int, size: int, begins: np.ndarray, cells: np.ndarray) -> None:
        """The same relaxation for one long unit."""
        end = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        alive = [True] * size
        rank, step = self.rank_of, self.step
        found = rank[cells[(start + np.arange(size - 1)) * step + 2]] if step > 2 else np.full(size - 1, NONE)
        some = np.flatnonzero(found < NONE)
        heap = [(f, i, 2) for f, i in zip(found[some].tolist(), some.tolist())]
        heapq.heapify(heap)
        while heap:
            _, i, n = heapq.heappop(heap)
            if not alive[i] or end[i] >= size or end[end[i]] - i != n:
                continue
            j = end[i]
            alive[j] = False
            begins[start + j] = False
            end[i] = end[j]
            if end[i] < size:
                before[end[i]] = i
            for a in (before[i], i):
                if a >= 0 and end[a] < size:
                    m = end[end[a]] - a
                    if m < step and (f := cells.item((start + a) * step + m)):
                        heapq.heappush(heap, (rank.item(f), a, m))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end (0 first)."""
        sizes = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        points = np.frombuffer("".join(x for t in texts if t for x in (MARK, t)).replace(" ", MARK).encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        letter = self.letter[points]
        new = np.ones(len(points), bool)
        np.logical_not(self.joined[letter[:-1] * self.letters + letter[1:]], out=new[1:])
        del letter
        ends = np.cumsum(sizes)
        new[(ends - sizes)[sizes > 0]] = True
        starts = np.flatnonzero(new)
        del new
        offsets = np.append(starts, len(points)) * 4
        kind, offset = (pa.binary(), np.int32) if offsets[-1] < 1 << 31 else (pa.large_binary(), np.int64)
        coded = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(offsets.astype(offset)), pa.py_buffer(points)]).dictionary_encode()
        code, own = coded.indices.to_numpy(), values(coded.dictionary)
        del coded, offsets
        self.known.turn()
        part, size = [], 0
        for w in self.known.unknown(own):
            part.append(w)
            size += len(w) // 4 + 1
            if size * self.step > CELLS:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)
        own = list(map(self.known.__getitem__, own))
        n = np.fromiter(map(len, own), np.int64, len(own)) // np.dtype(self.kind).itemsize
        ids = np.frombuffer(b"".join(own), self.kind)
        first, n = (np.cumsum(n) - n)[code], n[code]
        to = np.append(0, np.cumsum(n))
        ids = ids[np.repeat(first - to[:-1], n) + np.arange(to[-1])].astype(np.int32)
        return ids, to[np.append(0, np.searchsorted(starts, ends))]

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> pa.Array:
        """The texts that the ids between cuts stand for."""
        ids = ids.astype(np.int64)
        if len(ids) and not 0 <= ids.min() <= ids.max() < self.size:
            raise IndexError("no such id")
        seen = np.append(np.flatnonzero(self.seen[ids]), len(ids))
        head = seen[np.searchsorted(seen, cuts[:-1])]
        ids[head[head < cuts[1:]]] += self.size
        shown = self.shown.take(pa.array(ids))
        at = np.frombuffer(shown.buffers()[1], np.int32)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int32)

        def between(cuts: np.ndarray) -> pa.Array:
            return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at[cuts]), shown.buffers()[2] or pa.py_buffer(b"")])

        if len(seen) > len(ids):
            try:
                return between(cuts).cast(pa.string())
            except pa.ArrowInvalid:  # not UTF-8
                pass
        # Bytes are one text where they stand in a row, so what is not shown parts them.
        parts = np.union1d(cuts, np.flatnonzero(~self.seen[ids % self.size]))
        texts, own = [t.decode("utf-8", "replace") for t in values(between(parts))], np.searchsorted(parts, cuts).tolist()
        return pa.array(["".join(texts[i:j]) for i, j in zip(own, own[1:])], pa.string())


_pieces: dict[str, Pieces] = {}


def pieces_of(model_file: str) -> Pieces:
    """One for each worker process, so that tasks find the units of those before them."""
    if model_file not in _pieces:
        _pieces[model_file] = Pieces(model_file)
    return _pieces[model_file]


def _encoded(model_file: str, text: str):
    def run(b: pa.RecordBatch) -> pa.Array:
        ids, cuts = pieces_of(model_file).encode(b.column(b.schema.get_field_index(text)).to_pylist())
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids))

    return run


def _decoded(model_file: str, ids: str):
    def run(b: pa.RecordBatch) -> pa.Array:
        lists = b.column(b.schema.get_field_index(ids))
        cuts = lists.offsets.to_numpy()
        return pieces_of(model_file).decode(lists.values.to_numpy()[cuts[0] : cuts[-1]], cuts - cuts[0])

    return run


def _with_columns(df: DataFrame, by: str, *added) -> DataFrame:
    """df with columns more (name, type, function of a batch), made one after the other within one pass over slices of bounded texts in by."""

    def go(batches):
        for whole in lean(batches):
            for b in slices(whole, by, BATCH_BYTES):
                for name, _, run in added:
                    b = pa.RecordBatch.from_arrays([*b.columns, run(b)], [*b.schema.names, name])
                yield b

    return df.mapInArrow(go, df.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind, _ in added)).schema)


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of piece ids."""
    return _with_columns(docs.drop(ids), text, (ids, "array<int>", _encoded(model_file, text)))


def decode(docs: DataFrame, model_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """docs with a column of the text that the ids stand for."""
    return _with_columns(docs.drop(text), ids, (text, "string", _decoded(model_file, ids)))


def round_trip(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with both columns, from one pass: what is encoded is decoded where it stands."""
    return _with_columns(docs.drop(ids, decoded), text, (ids, "array<int>", _encoded(model_file, text)), (decoded, "string", _decoded(model_file, ids)))
