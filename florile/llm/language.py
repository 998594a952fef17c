"""Language identification by rank-order profiles.

A text's letter n-grams (one to GRAM letters of its lower-cased words, with a blank before and after each word) are counted, and the TOP
most frequent, ordered by count and then by code points, are its profile. A language's profile is made likewise from the counts of all
its texts. The out-of-place distance of two profiles is the sum, over the text's n-grams, of how many places each one's rank lies from
its rank in the language, or TOP where the language lacks it. The language of the smallest distance is predicted, the first by name
among equals; the score is 1 less the distance's share of the largest one possible.

N-grams are numbers of 63 bits, 21 for each code point, so that they are counted by sorting and their order is that of their letters.
Texts are counted in parts of PART code points, which give the same counts whatever their length. Profiles have TOP rows for each
language, so a few hundred kilobytes reach the driver for a hundred languages.

Defined results: letters are code points of the Unicode categories L*; a text that is null or has no letter is `und` with score 0, and so
is every text if no language was learned; rows that repeat are learned from and scored each; rows of a null language aren't learned
from, and of a null doc_id they are like others where the caller keeps them; other columns are ignored; an empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean

GRAM, TOP = 3, 400
UNKNOWN = "und"
PART = 1 << 18
BITS = np.int64(21)
#: Profiles that reach the driver: languages times TOP rows.
MOST_LANGUAGES = 2000
_letter: list[np.ndarray] = []


def is_letter(codes: np.ndarray) -> np.ndarray:
    if not _letter:
        _letter.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letter[0][codes]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of several counts, rising, and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    total = np.zeros(len(grams), np.int64)
    np.add.at(total, at, np.concatenate([n for _, n in parts]))
    return grams, total


def _counted(codes: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that begin at the first own of the codes, in which 32 stands for all that is no letter, rising, and how often each comes."""
    c = codes.astype(np.int64)
    blank = c == 32
    found = [c[:own][~blank[:own]] << (2 * BITS)]
    n = min(own, len(c) - 1)
    if n > 0:
        found.append(((c[:n] << (2 * BITS)) | (c[1 : n + 1] << BITS))[~(blank[:n] & blank[1 : n + 1])])
    n = min(own, len(c) - 2)
    if n > 0:
        found.append(((c[:n] << (2 * BITS)) | (c[1 : n + 1] << BITS) | c[2 : n + 2])[~blank[1 : n + 1]])
    return np.unique(np.concatenate(found), return_counts=True)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The text's n-grams as numbers, rising, and how often each comes."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    parts = []
    for i in range(0, len(codes), PART):
        part = np.full(min(PART, len(codes) - i) + GRAM, 32, np.uint32)  # one code before, two after
        low, high = max(0, i - 1), min(len(codes), i + PART + GRAM - 1)
        part[low - i + 1 : high - i + 1] = codes[low:high]
        part[~is_letter(part)] = 32
        # Of two parts, the n-grams that begin with the code before the second are counted with the first, but at the start of the text.
        parts.append(_counted(part if i == 0 else part[1:], len(part) - GRAM + (i == 0)))
    return _merged(parts) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def profile(found: np.ndarray, counts: np.ndarray, top: int = TOP) -> np.ndarray:
    """The top most frequent n-grams in the order of their ranks."""
    if len(found) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        over, equal = np.flatnonzero(counts > least), np.flatnonzero(counts == least)
        stay = np.concatenate([over, equal[: top - len(over)]])
        found, counts = found[stay], counts[stay]
    return found[np.lexsort((found, -counts))]


def _count_by_language(batches):
    for b in lean(batches):
        held: dict[str, list] = {}
        for language, t in zip(b.column(0).to_pylist(), b.column(1)):
            own = held.setdefault(language, [])
            if len((got := grams(t.as_py()))[0]):
                own.append(got)
            if len(own) == 64:
                held[language] = [_merged(own)]
        for language, own in held.items():
            if own:
                g, n = _merged(own)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(g)), pa.array(g), pa.array(n)], ["language", "gram", "n"])


def learn(docs: DataFrame, language: str = "lang", top: int = TOP) -> DataFrame:
    """language, gram and rank (from 0): a profile of each language of docs (text and the language's column), from all its texts."""
    rows = docs.select(F.col(language).cast("string").alias("language"), "text").where("language IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count_by_language, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("language").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < top).select("language", "gram", "rank")


def distances(own: np.ndarray, languages: list[tuple[np.ndarray, np.ndarray]], top: int) -> list[int]:
    """The out-of-place distance of a text's profile from each language, given as its n-grams, rising, and their ranks."""
    place, out = np.arange(len(own)), []
    for known, ranks in languages:
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        out.append(int(np.where(known[at] == own, np.abs(ranks[at] - place), top).sum()))
    return out


def _predict(names: list[str], languages: list[tuple[np.ndarray, np.ndarray]], top: int):
    def run(batches):
        for b in lean(batches):
            best, scores = [], []
            for t in b.column(1):
                own = profile(*grams(t.as_py()), top)
                if len(own) and names:
                    far = distances(own, languages, top)
                    k = int(np.argmin(far))
                    best.append(names[k])
                    scores.append(1 - far[k] / (top * len(own)))
                else:
                    best.append(UNKNOWN)
                    scores.append(0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, profiles: DataFrame, top: int = TOP) -> DataFrame:
    """doc_id, lang_pred and score of each row of docs, by the profiles that learn gives."""
    rows = profiles.limit(MOST_LANGUAGES * top + 1).toPandas()
    if len(rows) > MOST_LANGUAGES * top:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    known = sorted((name, own.sort_values("gram")) for name, own in rows.groupby("language"))
    languages = [(own["gram"].to_numpy(np.int64), own["rank"].to_numpy(np.int64)) for _, own in known]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_predict([name for name, _ in known], languages, top), "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column | str) -> Column:
    """Whether a document is not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
