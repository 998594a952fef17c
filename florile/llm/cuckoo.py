"""A cuckoo filter over 64-bit hashes, in numpy: whole arrays are inserted, looked up and removed at once."""

import numpy as np

SLOTS = 4


class Full(Exception):
    """The keys don't fit; build a larger filter from the exact table."""


class CuckooFilter:
    def __init__(self, buckets: int, table: bytes | None = None):
        """buckets: a power of two."""
        self.n = buckets
        self.t = np.zeros((buckets, SLOTS), np.uint16) if table is None else np.frombuffer(table, np.uint16).reshape(buckets, SLOTS).copy()

    @classmethod
    def sized(cls, keys: int) -> "CuckooFilter":
        """Half full with so many keys, at most."""
        return cls(1 << max(2, int(np.ceil(np.log2(max(1, keys) * 2 / SLOTS)))))

    def _places(self, h: np.ndarray):
        h = h.astype(np.uint64)
        mark = ((h & np.uint64(0xFFFF)) | np.uint64(1)).astype(np.uint16)
        one = ((h >> np.uint64(20)) & np.uint64(self.n - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return place ^ ((mark.astype(np.uint64) * np.uint64(0x5BD1E9955BD1E995) >> np.uint64(24)) & np.uint64(self.n - 1)).astype(np.int64)

    def contains(self, h: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(h)
        return (self.t[one] == mark[:, None]).any(1) | (self.t[two] == mark[:, None]).any(1)

    def insert(self, h: np.ndarray, rounds: int = 500, seed: int = 0) -> None:
        mark, place, _ = self._places(h)
        rng = np.random.default_rng(seed)
        for _ in range(rounds):
            if not len(mark):
                return
            order = np.argsort(place, kind="stable")
            mark, place = mark[order], place[order]
            first = np.r_[True, place[1:] != place[:-1]]
            starts = np.flatnonzero(first)
            rank = np.arange(len(place)) - starts[np.cumsum(first) - 1]
            free = (self.t[place] == 0).sum(1)
            fits = rank < free
            slot = np.argsort(self.t[place] != 0, axis=1, kind="stable")[np.arange(len(place)), np.minimum(rank, SLOTS - 1)]
            self.t[place[fits], slot[fits]] = mark[fits]
            mark, place = mark[~fits], place[~fits]
            # The first of each full bucket takes a random slot; what was there, and the others, try their other bucket.
            lead = np.r_[True, place[1:] != place[:-1]][: len(place)]
            at = rng.integers(0, SLOTS, int(lead.sum()))
            out = self.t[place[lead], at].copy()
            self.t[place[lead], at] = mark[lead]
            mark[lead] = out
            held = mark != 0
            place = self._other(place, mark)[held]
            mark = mark[held]
        if len(mark):
            raise Full

    def remove(self, h: np.ndarray) -> None:
        """One copy of each key; keys must have been inserted."""
        for mark, one, two in zip(*self._places(h)):
            for p in (one, two):
                at = np.flatnonzero(self.t[p] == mark)
                if len(at):
                    self.t[p, at[0]] = 0
                    break

    def tobytes(self) -> bytes:
        return self.t.tobytes()
