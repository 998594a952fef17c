"""Fill-in-the-middle, hard negatives and language identification against brute force, on the hard cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import documents, prose, texts
from pyspark.sql import functions as F
from test_others import VECTORS

from florile.llm import fim, language, negatives

# Fill in the middle


def fim_model(i, t, units=r"[^\n]*\n|[^\n]+", rate=100):
    t = t or ""
    h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    u = re.findall(units, t, re.S)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 50:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    rows = texts() + [(200 + i, "\n".join(f"line {k} é😀" for k in range(i)) + "\n" * (i % 3)) for i in range(40)]
    rows += [(300, "a <P> b\nc"), (301, "<M>"), (302, "<\n<S\n<P\nP>\n>\n<<"), (303, "<P\n>\n<S"), (304, "x\n" * 30_000), (305, "é" * 200_000 + "\n" + "y" * 100_000)]
    return rows + [(400 + i, "<\nS>\n<M\n><\nP" * (1 + i % 4)) for i in range(30)]


@pytest.mark.parametrize("step, unit, units, rate", [(fim.STEP, "line", r"[^\n]*\n|[^\n]+", 100), (3, "line", r"[^\n]*\n|[^\n]+", 100), (fim.STEP, "char", ".", 40)])
def test_fim(spark, monkeypatch, step, unit, units, rate):
    """Form, lengths and output, and that the text comes back; also with reversals of a few bytes, other units, and some texts left as they are."""
    monkeypatch.setattr(fim, "STEP", step)
    for i, t in fim_rows():
        if step == 3 and len(t or "") < 1000:
            b = (t or "").encode()
            ends = fim.line_ends(b)
            for form in ("psm", "spm"):
                for x in range(0, len(ends) + 1, 3):
                    first, last = (int(ends[k - 1]) if k else 0 for k in (x // 2, x))
                    if not fim.has_sentinel(b):
                        assert fim.restore(bytes(fim.build(b, first, last, form)), form) == b
    rows = fim_rows()
    got = fim.restored(fim.transform(documents(spark, rows), unit=unit, rate=rate)).collect()
    want = Counter((i, *fim_model(i, t, units, rate), t or "") for i, t in rows)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored"]) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_rotate(monkeypatch):
    rng = random.Random(1)
    for step in (1, 3, 1 << 16):
        monkeypatch.setattr(fim, "STEP", step)
        for _ in range(200):
            b = bytearray(rng.randrange(256) for _ in range(rng.randrange(40)))
            i, j, k = sorted(rng.randrange(len(b) + 1) for _ in range(3))
            want = b[:i] + b[j:k] + b[i:j] + b[k:]
            fim.rotate(b, i, j, k)
            assert b == want


def test_fim_long_and_empty(spark):
    """Twice the text takes about twice the time; an empty table gives an empty result."""

    def took(n):
        text = ("word " * 9 + "\n").encode() * n
        began = time.process_time()
        out = fim.build(text, len(text) // 3, len(text) // 2, "spm")
        assert fim.restore(bytes(out), "spm") == text
        return time.process_time() - began

    assert min(took(400_000) for _ in range(3)) < 4 * max(took(200_000), 0.02)
    out = fim.restored(fim.transform(documents(spark, [])))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]


# Hard negatives


def negatives_model(rows, every=5):
    own = {(i, y, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v, y in rows if None not in (i, y) and v and None not in v and all(map(np.isfinite, v))}
    own = {(i, y, v) for i, y, v in own if sum(x * x for x in v) <= 1 << 62}
    out = []
    for i, y, v in own:
        if i % every:
            continue
        met = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for j, z, w in own if i != j and len(v) == len(w))
        for p, j, z in [x for x in met if x[2] == y][: negatives.POSITIVES]:
            found = [(s, k) for s, k, z in met if z != y and 50 * -p <= 100 * -s <= 95 * -p][: negatives.NEGATIVES]
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k) in enumerate(found)]
    return Counter(out)


@pytest.mark.parametrize("sizes", [None, (3, 17, 4, 8)])
def test_negatives(spark, monkeypatch, sizes):
    """Clusters, ties, equal vectors, a label of half the rows, odd and huge vectors, against all pairs; also in small blocks."""
    for name, n in zip(("ANCHORS", "ROWS", "NEAR", "SLICE"), sizes or ()):
        monkeypatch.setattr(negatives, name, n)
    rng = np.random.default_rng(2)
    rows = []
    for c in range(8):
        centre = rng.standard_normal(24)
        for k in range(20):
            v = centre + (0.2 + 0.1 * (k % 7)) * rng.standard_normal(24)
            rows.append((len(rows), [float(x) for x in np.float32(v)], 0 if k % 2 else c % 4))
    n = len(rows)
    rows += [(n + i, rows[40][1], i % 3) for i in range(30)]  # ties
    rows += [(n + 50 + i, [float(x) for x in rng.integers(-1, 2, 24)], i % 2) for i in range(30)]
    rows += [rows[45], rows[45], (45, rows[46][1], 1), (50, rows[40][1], None), (None, rows[40][1], 1)]
    odd = [None, [], [0.0] * 24, [1.0, None] + [0.0] * 22, [float("nan")] * 24, [float("inf")] + [0.0] * 23, rows[40][1][:12], [3e5] * 24, [1e30] * 24, [-2e7] * 24, [3e5] * 23 + [2e5]]
    rows += [(n + 100 + i, v, 1) for i, v in enumerate(odd * 2)] + [(n + 200 + i, [1.0 + i, -2.0], i % 2) for i in range(25)]
    got = negatives.hard_negatives(spark.createDataFrame([(i, v, y, 1, 2, "u", 3, "k") for i, v, y in rows], VECTORS).repartition(3), F.col("label"), F.col("vec_id") % 5 == 0)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = negatives_model([(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows])
    assert Counter(map(tuple, got.collect())) == want and len(want) > 300


@pytest.mark.parametrize("dims", [3, 64, 100])
def test_intervals_hold(dims):
    """Every score lies in its interval, and near pairs' intervals rule out most of what is far."""
    rng = np.random.default_rng(3)
    v = np.floor(256 * np.concatenate([rng.standard_normal((300, dims)), np.repeat(rng.standard_normal((1, dims)), 30, 0) + 0.05 * rng.standard_normal((30, dims)), np.zeros((1, dims))])).astype(np.int64)
    a = negatives.Anchors(np.arange(len(v)), np.zeros(len(v)), v)
    code, aligned, rest = negatives.encode(v)
    low, high = a.bounds(np.arange(len(v)), code, aligned[None], rest[None])
    score = v @ v.T
    assert (low <= score).all() and (score <= high).all()
    if dims > 3:
        bar = score[300:330, 300:330].min()
        assert (high[300:330] >= bar).mean() < 0.3


def test_scores_are_exact():
    v = np.array([[3_000_000_000, 1], [2_999_999_999, -1]], np.int64)
    want = [[sum(int(x) * int(y) for x, y in zip(a, b)) for b in v] for a in v]
    assert negatives.all_scores(v, v).tolist() == want and negatives.pair_scores(v, v).tolist() == [want[0][0], want[1][1]]
    for p in (7, -7, 0, 199, (1 << 62) - 3):
        assert negatives.hundredths(np.array([p]), 95)[0] == p * 95 // 100 and -negatives.hundredths(np.array([-p]), 50)[0] == -(-p * 50 // 100)


def test_negatives_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert negatives.hard_negatives(empty, negatives.moved_label(), F.col("vec_id") % 50 == 0).count() == 0
    moved = spark.createDataFrame([(i, [1.0], y, 1, 2, "u", 3, "k") for i, y in ((7, 9), (8, 9), (14, None), (21, 3))], VECTORS)
    assert [r[0] for r in moved.select(negatives.moved_label()).collect()] == [0, 9, None, 4]


# Languages


def grams_model(t):
    out = Counter()
    for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
        w = f" {w} "
        for k in range(1, 4):
            out.update(w[i : i + k] for i in range(len(w) - k + 1) if w[i : i + k] != " ")
    # A blank that two words share begins or ends an n-gram of each, as each has its own.
    return out


def profile_model(c, top):
    return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:top]]


def named(numbers):
    return ["".join(chr(c) for c in ((g >> 42), (g >> 21) & 0x1FFFFF, g & 0x1FFFFF) if c) for g in numbers.tolist()]


@pytest.mark.parametrize("part", [language.PART, 5])
def test_grams(monkeypatch, part):
    monkeypatch.setattr(language, "PART", part)
    for _, t in [*texts()[:-12], (0, "a"), (0, "A b"), (0, "1 2"), (0, "été, 漢字😀x"), (0, "x" * 23), (0, "ab cde  f, ghij")]:
        if part == 5 and len(t or "") > 2000:
            continue
        grams, counts = language.grams(t)
        assert dict(zip(named(grams), counts.tolist())) == grams_model(t)
        assert named(language.profile(grams, counts, 7)) == profile_model(grams_model(t), 7)


def language_rows():
    rng = random.Random(5)
    words = {"en": "the of and which that with house there think", "de": "der die und nicht schön haus straße über", "fr": "le la les qui été maison où très"}
    rows = [(i, lang, " ".join(rng.choice(own.split()) for _ in range(rng.choice([3, 30, 200])))) for i, (lang, own) in enumerate(sorted(words.items()) * 25)]
    return rows + [(100 + i, None if i % 2 else "xx", t) for i, (_, t) in enumerate(texts())] + [(300, "en", None), (301, "en", "12 !"), (None, "en", "the house"), (302, None, "the house")]


@pytest.mark.parametrize("top", [language.TOP, 12])
def test_languages(spark, top):
    rows = language_rows()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    counts = defaultdict(Counter)
    for i, lang, t in rows:
        if lang is not None and not held(i):
            counts[lang] += grams_model(t)
    known = {lang: {g: k for k, g in enumerate(profile_model(c, top))} for lang, c in counts.items()}
    want = Counter()
    for i, _, t in rows:
        own = profile_model(grams_model(t), top)
        far = min((sum(abs(p[g] - k) if g in p else top for k, g in enumerate(own)), lang) for lang, p in known.items())
        want[(i, far[1], round(1 - far[0] / (top * len(own)), 9)) if own else (i, "und", 0.0)] += 1
    df = spark.createDataFrame([(i, t, lang, 1, "g", 2, "x") for i, lang, t in rows], "doc_id long, text string, lang string, n long, gram string, rank int, language string").repartition(3)
    profiles = language.learn(df.where(~language.held_out("doc_id")), top=top)
    assert sum(p.count() for p in [profiles]) == sum(map(len, known.values()))
    got = language.identify(df, profiles, top)
    assert got.columns == ["doc_id", "lang_pred", "score"]
    assert Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in got.collect()) == want
    nothing = language.identify(df, language.learn(df.limit(0)))
    assert {(r["lang_pred"], r["score"]) for r in nothing.collect()} == {("und", 0.0)}
    assert language.identify(df.limit(0), profiles).count() == 0


def test_languages_of_held_out_rows(spark):
    """Accuracy on the held-out documents of a table."""
    from florile.llm.queries import op13_language_id

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op13_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").selectExpr("avg(int(lang = lang_pred)) AS right", "count(*) AS n").first()
    assert got["right"] >= 0.99 and got["n"] > 200


def test_one_long_word():
    """Time in proportion to the length."""

    def took(n):
        began = time.process_time()
        language.grams("abcdefghij" * n)
        return time.process_time() - began

    took(1000)
    assert took(200_000) < 4 * max(took(100_000), 0.05)
    assert prose(random.Random(1), 3)
