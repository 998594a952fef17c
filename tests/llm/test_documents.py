"""Operators over documents against brute force, on the hard cases."""

import hashlib
import random
import re
import string
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from cases import COLUMNS, components, documents, prose, texts
from pyspark.sql import functions as F

from florile.llm import common, exact_dedup, licenses, line_dedup, near_dedup, packing, pieces, pii, quality
from florile.llm.common import shingles, word_hashes
from florile.llm.cuckoo import CuckooFilter
from florile.llm.queries import vocabulary


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def low(i):
    return -(1 << 63) if i is None else i


# Exact dedup


@pytest.mark.parametrize("huge, primes", [(exact_dedup.HUGE, exact_dedup.PRIMES), (1000, exact_dedup.PRIMES), (1000, ((3, 2), (2, 1)))])
def test_exact(spark, huge, primes):
    """Also with texts hashed in chunks by many tasks, and with primes so small that fingerprints collide."""
    rows = texts() + [(100 + i, "ab"[i % 2] * 4) for i in range(8)]
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    want = sorted((low(i), low(max(by[t or ""], key=low)), len(by[t or ""]), low(i) == max(map(low, by[t or ""])), sha(t or "")) for i, t in rows)
    got = exact_dedup.exact_groups(documents(spark, rows), huge, primes).collect()
    assert sorted((low(r["doc_id"]), low(r["keep_id"]), r["group_size"], r["kept"], r["text_sha256"]) for r in got) == want


def test_exact_hot_groups(spark, monkeypatch):
    """Groups that are dealt into parts, collisions among them."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(common, "HOT_SHARE", 1_000_000)
    for primes in (exact_dedup.PRIMES, ((3, 2), (2, 1))):
        test_exact(spark, 1000, primes)


def took(df):
    """Seconds of a run, once warm."""
    df.write.format("noop").mode("overwrite").save()
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def test_exact_long(spark):
    """Cutting a text into chunks takes time in proportion to it (with the text encoded for each chunk, it is quadratic)."""
    cut = lambda mb: spark.range(1).select(F.repeat(F.lit("abcdefgh"), mb << 17).alias("text")).select(F.size(exact_dedup._chunks("text", 1 << 12)))
    assert took(cut(16)) < 3 * max(took(cut(8)), 0.5)


def test_fingerprints_compose():
    rng = np.random.default_rng(0)
    for p, b in exact_dedup.PRIMES:
        for n in (0, 1, 70_000, 140_001):
            data = rng.integers(0, 256, n, dtype=np.uint8).tobytes()
            k = n // 3
            whole = exact_dedup.fingerprint(data, p, b)
            assert whole == exact_dedup.combine(exact_dedup.fingerprint(data[:k], p, b), exact_dedup.fingerprint(data[k:], p, b), n - k, p, b)


def test_exact_empty(spark):
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0
    assert set(exact_dedup.drop_copies(documents(spark)).columns) == set(COLUMNS)


# Line dedup


def line_model(rows):
    def key(x):
        return x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})

    holds = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holds[key(x)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < 10 or len(holds[key(x)]) < 2 or min(holds[key(x)]) == low(i)]
        out.append((low(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


@pytest.mark.parametrize("keys, refs, hot", [(line_dedup.SHARD_KEYS, line_dedup.PROBE_REFS, line_dedup.HOT_SHARE), (2, 3, 1), (2, 3, 8)])
def test_lines(spark, monkeypatch, keys, refs, hot):
    """With one filter, and with many of few keys and several copies each; with common lines told apart, and without."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", keys)
    monkeypatch.setattr(line_dedup, "PROBE_REFS", refs)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", hot)
    got = line_dedup.line_dedup(documents(spark))
    assert set(got.columns) == set(COLUMNS) | {"n_dropped"}
    assert sorted((low(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == line_model(texts())
    assert line_dedup.line_dedup(documents(spark, [])).count() == 0


def test_lines_are_reversible(spark):
    docs = documents(spark)
    refs = line_dedup.line_refs(docs)
    gone = docs.where("doc_id IN (30, 50)")
    kept = docs.where("doc_id IS NULL OR doc_id NOT IN (30, 50)")
    rows = lambda d: sorted(map(tuple, line_dedup.reference_counts(d).collect()))
    left = line_dedup.delete(refs, gone.select("doc_id"))
    assert rows(left) == rows(line_dedup.line_refs(kept))
    assert rows(line_dedup.insert(left, gone)) == rows(refs)
    shared, still = (line_dedup.shared_keys(line_dedup.reference_counts(x)).select("key") for x in (refs, left))
    filters = line_dedup.build_filters(shared, 2)
    dropped = shared.join(still, "key", "left_anti")
    after = line_dedup.remove_keys(filters, dropped, 2)
    found = lambda f: {bytes(r["key"]) for r in line_dedup.possible_hits(refs, f, 2).collect()}
    keys = lambda d: {bytes(r["key"]) for r in d.collect()}
    assert keys(still) <= found(after) and not keys(dropped) & found(after)
    again = line_dedup.add_keys(after, dropped, shared, 2)
    assert found(again) == found(filters) == keys(shared)


def test_line_filters_follow_single_documents(spark):
    """Insert, delete, insert of one document after the other: the filters hold what the counts say, also when a filter gets full."""
    rng = random.Random(4)
    lines = [f"{prose(rng, 4)} line {i}" for i in range(40)]
    docs = {i: "\n".join(rng.sample(lines, 12)) for i in range(4)}
    refs, filters, before = line_dedup.line_refs(documents(spark, [(0, docs[0])])), line_dedup.build_filters(spark.createDataFrame([], "key binary"), 3), set()
    for what, i in (("insert", 1), ("insert", 2), ("delete", 1), ("insert", 3), ("delete", 0), ("insert", 1)):
        own = documents(spark, [(i, docs[i])])
        refs = line_dedup.scratch(line_dedup.insert(refs, own) if what == "insert" else line_dedup.delete(refs, own.select("doc_id")), "refs")
        shared = line_dedup.shared_keys(line_dedup.reference_counts(refs)).select("key")
        now = {bytes(r["key"]) for r in shared.collect()}
        rows = lambda x: spark.createDataFrame([(bytearray(k),) for k in x], "key binary")
        filters = line_dedup.scratch(line_dedup.remove_keys(line_dedup.add_keys(filters, rows(now - before), shared, 3), rows(before - now), 3), "filters")
        assert {bytes(r["key"]) for r in line_dedup.possible_hits(refs, filters, 3).collect()} == now
        before = now


def test_cuckoo():
    h = np.random.default_rng(1).integers(1, 1 << 63, 20_000, dtype=np.uint64)
    f = CuckooFilter.sized(len(h))
    f.insert(h)
    assert f.contains(h).all()
    other = np.random.default_rng(2).integers(1, 1 << 63, 100_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.001
    f.remove(h[:10_000])
    assert f.contains(h[10_000:]).all() and f.contains(h[:10_000]).mean() < 0.01


# N-gram Jaccard join


def word_set(t, signs):
    """Shingles of a text as tuples of words."""
    words = [w if signs else w.strip(string.punctuation) for w in re.split("[\\x00-\\x20]+", (t or "").lower())]
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_model(rows, signs=False):
    """Of each row: links, and the class of its doc_id."""
    sets = [frozenset(word_set(t, signs)) for _, t in rows]
    links, pairs = Counter(), []
    first = {x: min(low(i) for (i, _), y in zip(rows, sets) if x == y) for x in sets if x}
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                pairs.append((first[sets[i]], first[sets[j]]))
    part = components({low(i) for i, _ in rows}, pairs)
    of = [part[first[x]] if x else low(i) for (i, _), x in zip(rows, sets)]
    return sorted((low(i), of[k], links[k], of[k] == low(i)) for k, (i, _) in enumerate(rows))


def near_rows(got):
    return sorted((low(r["doc_id"]), low(r["class_id"]), r["n_links"], r["kept"]) for r in got.collect())


@pytest.mark.parametrize("block, few, signs", [(near_dedup.BLOCK, near_dedup.BROADCAST_TEXTS, False), (2, 0, False), (near_dedup.BLOCK, 0, True)])
def test_near(spark, monkeypatch, block, few, signs):
    """Also dealt into blocks of two, with candidates shuffled, and with signs as parts of words."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_TEXTS", few)
    rng = random.Random(4)
    own = prose(rng, 100).split()
    rows = texts() + [(80, "(One) two-three, 'four'! -- five; six..."), (81, "one two-three four five six"), (82, "... !?"), (83, " ".join(w.strip(",.") for w in own)), (84, " ".join(own))]
    assert near_rows(near_dedup.near_groups(documents(spark, rows), signs=signs)) == near_model(rows, signs)


@pytest.mark.parametrize("name", [lambda i: None, lambda i: 7, lambda i: i // 2 or None])
def test_near_without_own_ids(spark, name):
    """Near copies, each different, whose doc_ids are null or repeat: links are those of rows with ids, and rows to compare are as many."""
    rng = random.Random(10)
    words = prose(rng, 100).split()
    rows = [(name(i), " ".join(f"w{i}" if k == rng.randrange(100) or k == i else w for k, w in enumerate(words))) for i in range(40)] + [(name(50), prose(rng, 90)), (None, rows_of_one := prose(rng, 60)), (3, rows_of_one)]
    want = near_model(rows)
    assert near_rows(near_dedup.near_groups(documents(spark, rows))) == want and max(r[2] for r in want) > 5


def test_near_stage(spark):
    out = near_dedup.drop_near_copies(documents(spark))
    assert out.columns == COLUMNS
    ids = [r["doc_id"] for r in out.collect()]
    assert {0, 1} <= set(ids) and not {10, 11, 12, 13, 14, 20, 21} & set(ids) and {22, 23, 24, 25} <= set(ids)
    assert near_dedup.near_groups(documents(spark, [])).count() == 0


def test_near_large_group(spark):
    """Many near copies of one text, each different: every link is counted."""
    rng = random.Random(9)
    words = prose(rng, 100).split()
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(100)] = f"w{i}"
        rows.append((i, " ".join(own)))
    sets = [set(shingles(word_hashes(t)).tolist()) for _, t in rows]
    want = [sum(a is not b and len(a & b) >= 0.8 * len(a | b) for b in sets) for a in sets]
    got = {r["doc_id"]: r["n_links"] for r in near_dedup.near_groups(documents(spark, rows)).collect()}
    assert [got[i] for i in range(300)] == want


def test_posterior():
    need = near_dedup.least_equal()
    assert need == sorted(need) and 0 < need[0] < 16 and need[-1] < 0.8 * 128


# PII


def pii_model(t):
    out = []
    t = t or ""
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(out)


ODD = ["a@b.com_x@y.com z", "ab@c@d.org 1.2.3.4.5.6.7.8 1.2.3", "0255.001.2.3 256.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "+1+2 +12345678901234567 +12345678-9 x", "é😀 a@b.c", "@@@ a@.b a@b..c", "x@y.com" * 30, "a.b@c.d@e.f@g.h", "0000 0000 0000"]


def test_pii_base(spark):
    rows = [(i, t) for i, t in texts() if i is not None and i != 52] + [(200 + i, t) for i, t in enumerate(ODD)]
    got = defaultdict(list)
    for r in pii.summary(documents(spark, rows)).collect():
        got[r["doc_id"]].append(r)
    for i, t in rows:
        spans = pii_model(t)
        for r in got[i]:
            assert r["base_sha256"] == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)), t[:50]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == k for x in spans) for k in range(4)]


def test_pii_terms(spark):
    """A rare word that stands near one address in several texts is taken out there, and only there; frequent words stay."""
    rng = random.Random(7)
    rows = [(i, prose(rng, 30)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 12)} the Zanzibar of jo@example.org and {prose(rng, 12)}") for i in range(4)]
    rows += [(2000, f"{prose(rng, 12)} jo@example.org and {prose(rng, 12)}"), (2001, "Zanzibar alone is a fine word")]
    docs = documents(spark, rows)
    spans = {r["doc_id"]: r["spans"] for r in pii.summary(docs).collect()}
    for i in range(4):
        t = dict(rows)[1000 + i]
        terms = [x.split(":")[1:] for x in spans[1000 + i].split(",") if x.startswith("term")]
        assert [t[int(s) : int(e)] for s, e in terms] == ["Zanzibar"]
    assert not any("term" in s for i, s in spans.items() if not 1000 <= i < 1004)
    new = {r["doc_id"]: r for r in pii.sanitise(docs).collect()}
    assert "Zanzibar" not in new[1000]["text"] and "[EMAIL]" in new[1000]["text"] and "Zanzibar" in new[2001]["text"]
    assert all(new[i]["text"] == t for i, t in rows[:300]) and new[1000]["n_chars"] == len(new[1000]["text"])


def test_pii_coarse_and_far(spark):
    """Values that stand in one text each show a term by their domain, and a term counts however far away it stands."""
    rng = random.Random(9)
    rows = [(i, prose(rng, 30)) for i in range(300)]
    rows += [(1000 + i, f"Zanzibar {prose(rng, 40)} p{i}@rare.example {prose(rng, 12)}") for i in range(4)]
    spans = {r["doc_id"]: r["spans"] for r in pii.summary(documents(spark, rows)).collect()}
    assert all("term:0:8" in spans[1000 + i] for i in range(4)) and not any("term" in spans[i] for i in range(300))


def test_pii_counts_copies_once(spark):
    """Copies of a text change nothing: not the count of texts, and not the count of a term."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 30)) for i in range(300)]
    rows += [(1000 + i, f"{prose(rng, 12)} the Zanzibar of jo@example.org and {prose(rng, 12)}") for i in range(3)]
    once = {r["doc_id"]: r["spans"] for r in pii.summary(documents(spark, rows)).collect()}
    copies = pii.summary(documents(spark, rows + [(5000 + i, rows[300][1]) for i in range(200)])).collect()
    assert "term" in once[1000] and {r["doc_id"]: r["spans"] for r in copies if r["doc_id"] < 5000} == once
    assert all(r["spans"] == once[1000] for r in copies if r["doc_id"] >= 5000)


def levels_model(kind, value):
    value = value.lower() if kind == "email" else value if kind == "ip" else re.sub("[^0-9]", "", value)
    own = f"{kind}:{value}"
    if kind == "email":
        return {own, "domain:" + value.rsplit("@", 1)[1], "local:" + value.split("@")[0]}
    if kind == "ip":
        return {own, "net3:" + ".".join(value.split(".")[:3]), "net2:" + ".".join(value.split(".")[:2])}
    return {own, f"{kind}4:{value[:4]}", f"{kind}6:{value[:6]}"}


def disclosing_model(rows):
    """(doc_id, place) of each term that gives a value away, by counts over all different texts and all pairs."""
    texts = sorted({t or "" for _, t in rows})
    n, n_key, n_both, n_term, of = len(texts), Counter(), Counter(), Counter(), {}
    for t in texts:
        spans = pii_model(t)
        keys = set().union(*(levels_model(pii.KINDS[k], t[s:e]) for s, k, e in spans))
        found = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t)]
        own = [x for x in found if not any(x[1] < e and s < x[2] for s, _, e in spans)]
        of[t] = keys, own
        n_term.update({w for w, _, _ in found})
        n_key.update(keys)
        n_both.update((w, k) for w in {w for w, _, _ in own} for k in keys)

    def share(w, k):
        given = (n_both[w, k] + pii.PRIOR * n_key[k] / n) / (n_term[w] + pii.PRIOR)
        return np.log2(given * n / n_key[k]) / np.log2(n / n_key[k]) if n_both[w, k] >= pii.EVIDENCE and n > n_key[k] else 0

    return sorted((i, s, e) for i, t in rows for w, s, e in of[t or ""][1] if any(share(w, k) >= pii.DISCLOSES for k in of[t or ""][0]))


def disclosed(rows, got):
    return sorted((r["doc_id"], *map(int, x.split(":")[1:])) for r in got for x in r["spans"].split(",") if x.startswith("term"))


def test_pii_against_brute_force(spark):
    """Counts, shares and places of terms against all pairs: values that share texts, values of many texts, heavy texts, copies."""
    rng = random.Random(12)
    rows = [(i, prose(rng, 20)) for i in range(400)]
    names = [f"Name{chr(97 + k)}{chr(97 + j)}xyz" for k in range(8) for j in range(6)]
    for i in range(120):
        c = rng.randrange(8)
        values = [rng.choice([f"p{rng.randrange(9)}@host{c}.org", f"10.{c}.{rng.randrange(3)}.{rng.randrange(200)}", f"+49 30 {c}{rng.randrange(10**6, 10**7)}"]) for _ in range(1 + rng.randrange(3))]
        rows.append((1000 + i, f"{prose(rng, 5)} {rng.choice(names[6 * c : 6 * c + 6])} {' and '.join(values)}. {rng.choice(names)} {prose(rng, 5)}".replace("xyz", "")))
    rows += [(2000 + i, " ".join(f"p{k}@host{k % 11}.org {names[k % 40][:-3]}" for k in range(i, 60 + i))) for i in range(3)]
    rows += [(3000, rows[450][1]), (3001, rows[450][1]), (3002, None)]
    want = disclosing_model(rows)
    assert disclosed(rows, pii.summary(documents(spark, rows)).collect()) == want and len(want) > 50


def test_pii_finds_what_is_planted(spark):
    """Of words that stand in texts with one of 20 hosts alone, all are found; of rare words of texts with addresses, and of words met with many hosts, none."""
    rng = random.Random(13)
    rows = [(i, prose(rng, 30)) for i in range(1500)]
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:05}")
    for k in range(100):
        host, telling = f"u{k}@h{k % 20}.example", f"secret{word(k % 20)}"
        rows.append((5000 + k, f"{prose(rng, 10)} {telling} {prose(rng, 10)} {host} once{word(k)} {prose(rng, 5)} often{word(k % 3)}"))
    dt = dict(rows)
    found = Counter(re.match("[a-z]*?(?=[a-j]{5}$)", dt[i][s:e])[0] for i, s, e in disclosed(rows, pii.summary(documents(spark, rows)).collect()))
    assert found == {"secret": 100}


def test_pii_heavy_text(spark, monkeypatch):
    """One text of many addresses and words, which stand in others too, pairs no more than the others do: rows are linear in its length."""
    made = []
    old = pii.scratch
    monkeypatch.setattr(pii, "scratch", lambda df, name: made.append((name, out := old(df, name))) or out)
    rng = random.Random(14)
    word = lambda k: "".join(chr(97 + int(c)) for c in f"{k:06}")

    def pairs(n):
        made.clear()
        rows = [(i, f"{prose(rng, 5)} u{i}@h{i}.example {word(i)} {word(i + 1)}") for i in range(n)]
        rows.append((10**6, " ".join(f"u{i}@h{i}.example {word(i)} {word(i + 7)} {word(i + n)}" for i in range(n))))
        rows += [(10**7 + i, " ".join(f"v{k}@k{k}.example w{word(k)} w{word(k + n)}" for k in range(n)) + f" end{i}") for i in range(2)]
        pii.summary(documents(spark, rows)).write.format("noop").mode("overwrite").save()
        return dict(made)["pii-pairs"].count()

    small, large = pairs(400), pairs(1200)
    assert 400 < small and large < 4 * small


def test_pii_places(spark):
    """Terms and where they stand, outside spans, whether held against each span or met in order."""
    rng = random.Random(3)
    t = "".join(rng.choice(["word ", "été", "a@b.org ", "x", "12.1.1.1", "café@x.de,", " ", "über+49 30 1234567"]) for _ in range(300))
    d = documents(spark, [(1, t)]).select(pii.digest_of("text").alias("digest"), "text", pii.base_spans(F.col("text")).alias("base"))
    spans = [(s, e) for s, _, e in pii_model(t)]
    want = sorted((m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(m.start() < e and s < m.end() for s, e in spans))
    assert len(want) > 20
    for few in (0, 1000):
        assert sorted((r["s"], r["e"]) for r in pii.places(d, few).collect()) == want


def test_pii_many_matches(spark):
    """More matches than are folded together, and texts of many matches in linear time."""
    rng = random.Random(2)
    t = "".join(rng.choice(["a@b.org ", "10.1.2.3, ", "12 34 x ", "é ", "+49 30 1234567; ", "4111 1111 1111 1111 "]) for _ in range(3000))
    (r,) = pii.summary(documents(spark, [(1, t)])).collect()
    spans = pii_model(t)
    assert r["base_sha256"] == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans))
    want, at = "", 0
    marks = [f"[{k.upper()}]" for k in pii.KINDS]
    extra = [(int(s), 9, int(e)) for k, s, e in (x.split(":") for x in r["spans"].split(",")) if k == "term"]
    assert not extra
    for s, k, e in sorted(spans):
        want += t[at : max(at, s)] + marks[k]
        at = max(at, e)
    assert pii.sanitise(documents(spark, [(1, t)])).first()["text"] == want + t[at:]
    text = lambda n: spark.range(1).select(F.repeat(F.lit("12 34 x "), n).alias("text")).select(F.size(pii.base_spans(F.col("text"))), F.size(pii.finds(F.col("text"), pii.CARD)))
    assert took(text(250_000)) < 3 * max(took(text(125_000)), 0.7)


def test_pii_stage(spark):
    out = pii.sanitise(documents(spark))
    assert out.columns == COLUMNS and out.count() == len(texts())
    t = {r["doc_id"]: r["text"] for r in out.collect()}
    assert t[40] == "mail [EMAIL] or [EMAIL][EMAIL] call [PHONE] card [CARD] ip [IP] not 300.1.1.1" and t[22] == ""
    assert pii.summary(documents(spark, [])).count() == 0


def test_pii_is_native(spark):
    plan = pii.summary(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Packing


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, x in texts():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[low(i), np.array(ids, "<u4").tobytes()] += 1
    rows = packing.pack_documents(documents(spark), vocabulary(), group_chars=100_000).collect()
    known = {(i, len(b) // 4): b for i, b in want}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[low(r["doc_id"]), r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
        piece = known[low(r["doc_id"]), r["doc_tokens"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert zlib.crc32(piece) == r["ids_crc32"]
    for (i, n), own in by_doc.items():
        times = want[i, known[i, n]]
        seen = Counter(k for r in own for k in range(r["start"], r["start"] + r["length"]))
        assert set(seen.values()) == {times} and len(seen) == n
    assert sum(want.values()) == sum(want[i, known[i, n]] for i, n in by_doc)
    for own in by_seq.values():
        own.sort(key=lambda r: r["offset"])
        total = 0
        for r in own:
            assert r["offset"] == total
            total += r["length"]
        assert total == 4096 or total & (total - 1) == 0
    assert packing.pack_documents(documents(spark, []), vocabulary()).count() == 0


def test_packing_deals_equal_rows_out(spark):
    """A hundred thousand rows that are equal in all and have no doc_id, beside some of one doc_id: no group gets more than its part."""
    same = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("two words and some more").alias("text"))
    rows = same.unionByName(spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("another text").alias("text")))
    out = packing.pack_documents(rows, vocabulary(), group_chars=50_000)
    own = out.groupBy(F.shiftright("sequence_id", 32).alias("g")).agg(F.count("*").alias("n"), F.sum("length").alias("t")).collect()
    assert len(own) > 40 and max(r["n"] for r in own) < 2 * sum(r["n"] for r in own) / len(own)
    totals = {r["doc_id"]: (r["d"], r["t"]) for r in out.groupBy("doc_id").agg(F.count_if(F.col("start") == 0).alias("d"), F.sum("length").alias("t")).collect()}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in out.select("doc_id", "doc_tokens").distinct().collect()}
    assert totals == {None: (100_000, 100_000 * tokens[None]), 7: (20_000, 20_000 * tokens[7])}


def test_split_word():
    for w in ["(river,", "river", "...", "'song'", "it's", "a-b", "x1.", "“quoted”", "été!!", "--a--b", "$5", "_a_", "o'clock."]:
        assert packing.split_word(w) == packing.WORD.findall(w)


def test_words_of_odd_texts():
    """Apostrophes, digits, signs, letters whose lower case is two characters, combining signs, other scripts, special tokens: ids are those of the tokenizer, also of texts that are cut."""
    rng = random.Random(5)
    plain = ["'", "'", " ", "\n", "\t", *"stredvmlaST12!-.", "'s", "'LL", "word", "\u0130", "\u023a", "\u00df", "\u00b2", "\u00aa", "\u2013", "\u20ac"]
    other = [" ", " ", "\r", "a", "'s", "e\u0301", " \u0301", "\u03a3", "\u4e2d", "\u00a0", "\u0085", "\u2028", "\x00", "\x1f", "\x0b", "\U0001f600", "<|", "|>", "<|endoftext|>", "<|startoftext|>"]
    odd = ["".join(rng.choice(some) for _ in range(n)) for some in (plain, plain + other, other) for n in (0, 1, 2, 5, 20, 300) for _ in range(100)] + ["", " ", "''s", "'s's", "it's 'sam'", "'"]
    words = packing.words_of(vocabulary())
    want = [words.t.encode(t, add_special_tokens=False).ids for t in odd]
    for most, stretch in ((packing.BYTES_AT_ONCE, packing.STRETCH), (packing.BYTES_AT_ONCE, 9), (40, 9), (2, 1)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(packing, "BYTES_AT_ONCE", most)
            m.setattr(packing, "STRETCH", stretch)
            assert [np.frombuffer(x, words.kind).tolist() for x in words.encode(odd)] == want


def test_memory_of_a_long_text():
    """A text takes memory for a few copies of itself, not for an object for each word; where the tokenizer itself reads it, for a stretch at a time."""
    words, text = packing.words_of(vocabulary()), " ".join(["some", "words", "it's", "x1."] * 300_000)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(packing, "BYTES_AT_ONCE", 1 << 17)
        m.setattr(packing, "STRETCH", 1 << 16)
        words.encode([text[:1000]])
        tracemalloc.start()
        try:
            ids = words.encode([text])[0]
            peak = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert peak < 6 * len(text)
        assert len(ids) == 300_000 * len(words.encode(["some words it's x1."])[0])
        asked = []
        m.setattr(words, "t", SimpleNamespace(encode=lambda x, t=words.t, **own: asked.append(len(x)) or t.encode(x, **own)))
        assert words.encode([text + " \u4e2d"])[0][: len(ids)] == ids
        assert asked and max(asked) < 1 << 17


def test_first_fit():
    rng = random.Random(0)
    for n in (1, 2, 7, 500):
        lengths = [rng.randint(1, 4095) for _ in range(n)]
        got = defaultdict(int)
        for b in packing.pack(lengths):
            for i, _, m in b:
                got[i] += m
        assert [got[i] for i in range(n)] == lengths
    tree = packing.Tournament(5, 10)
    assert tree.first(10) == 0
    tree.take(0, 6)
    assert (tree.first(4), tree.first(5)) == (0, 1)


# Quality


def test_quality(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        good = i % 3 > 0
        t = prose(rng, 60) if good else " ".join(w.upper() + "!!" for w in prose(rng, 60).split())
        rows.append((i, t))
        labels.append((i, int(good), 0))
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (10_000, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + [(None if i is None else i + 5000, t) for i, t in texts()])
    model = quality.train(documents(spark, rows), lab.select("doc_id", "quality"))
    out = quality.score(docs, model)
    assert set(out.columns) == set(COLUMNS)
    got = {r["doc_id"]: r for r in out.withColumn("held", quality.held_out("doc_id")).collect()}
    for i, y, _ in labels:
        assert got[i]["held"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        if got[i]["held"] and i < 60:
            assert got[i]["predicted"] == y
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    assert got[5022]["score"] == got[5023]["score"]  # null and empty


def test_quality_against_brute_force(spark, monkeypatch):
    """Ratios and the fitted model against plain counts and another solver; labels without a document and held-out rows count nowhere."""
    rng = random.Random(6)
    rows = [(i, prose(rng, 25) if i % 3 else " ".join(rng.choice(["buy", "now", "cheap", "the", "stone"]) + rng.choice(["!", ""]) for _ in range(25))) for i in range(90)]
    lab = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(5000 + i, 0) for i in range(50)], "doc_id long, quality int")
    seen = {}

    def spy(own, y, size, cost, **more):
        out = solver(own, y, size, cost, **more)
        seen[len(own)] = (own, y, cost, out)
        return out

    solver = quality.dual_descent
    monkeypatch.setattr(quality, "dual_descent", spy)
    model = quality.train(documents(spark, rows), lab)
    train = [(t, int(i % 3 > 0)) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    size = 1 << quality.BITS
    n = np.zeros((2, size))
    for t, y in train:
        for k in set(quality.features(t).tolist()):
            n[y, k] += 1
    want = [np.log((n[y] + 1) / (n[y].sum() + size)) for y in (1, 0)]
    assert np.allclose(model.ratio, want[0] - want[1], atol=1e-5)
    own, y, cost, (w, bias, a) = seen[len(train)]
    x = np.zeros((len(own), size + 1))
    for i, (k, v) in enumerate(own):
        x[i, k], x[i, size] = v, 1
    q = (x @ x.T) * np.outer(y, y)
    b = np.zeros(len(y))  # projected gradient on the dual
    for _ in range(20_000):
        b = np.clip(b - (q @ b - 1) / np.linalg.norm(q, 2), 0, cost)
    loss = lambda z: z @ q @ z / 2 - z.sum()
    assert loss(a) <= loss(b) + 1e-2 * abs(loss(b))
    assert np.allclose(w, (a * y) @ x[:, :size], atol=1e-6) and abs(bias - (a * y).sum()) < 1e-6


def test_quality_long_texts(spark, monkeypatch):
    """Parts of a long text have the features of the whole; the sample is bounded in bytes by its number of rows, not by their length."""
    rng = random.Random(7)
    t = prose(rng, 3000) + " " + "again " * 50 + "x" * 700 + " " + prose(rng, 200)
    whole = quality.features(t)
    for n in (1, 7, 100, 1000):
        monkeypatch.setattr(quality, "AT_ONCE", n)
        assert (quality.features(t) == whole).all()
    monkeypatch.setattr(quality, "AT_ONCE", 4 << 20)
    monkeypatch.setattr(quality, "FIT_BYTES", 20_000)
    rows = [(i, prose(rng, 900 if i % 2 else 30)) for i in range(100)]
    lab = spark.createDataFrame([(i, int(i % 4 < 2)) for i, _ in rows], "doc_id long, quality int")
    taken = []

    def note(own, y, size, cost, **more):
        taken.append([len(x[0]) for x in own])
        return np.zeros(size), 0.0, np.zeros(len(own))

    monkeypatch.setattr(quality, "dual_descent", note)
    quality.train(documents(spark, rows), lab)
    assert 0 < sum(taken[1]) * 4 <= 2 * 20_000 + 8000 and max(taken[1]) > 600 > 100 > min(taken[1])


def test_quality_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = documents(spark)
    assert {r["predicted"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {1}
    assert quality.score(documents(spark, []), quality.train(documents(spark, []), none)).count() == 0


def test_quality_ignores_what_it_must(spark):
    docs = documents(spark)
    lab = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    model = quality.train(docs, lab)
    a = {(r["text"], r["score"]) for r in quality.score(docs, model).select("text", "score").collect()}
    b = {(r["text"], r["score"]) for r in quality.score(docs.withColumns({"doc_id": F.lit(1), "lang": F.lit("x"), "source": F.lit("y")}), model).select("text", "score").collect()}
    assert a == b


# Pieces


def test_pieces(spark):
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(3)
    rows = texts() + [(300 + i, "".join(rng.choice("abctheinre  .,é\n") for _ in range(rng.randint(1, 300)))) for i in range(100)]
    rows += [(500, "  a  b "), (501, "<s> </s> <0x41>"), (502, "hello" * 40), (503, "a\tb\nc")]
    out = pieces.decode(pieces.encode(documents(spark, rows).drop("ids"), file), file)
    for r in out.select("text", "ids", "decoded").collect():
        t = r["text"] or ""
        assert r["ids"] == ref.encode(t) and r["decoded"] == t
    assert pieces.encode(documents(spark, []), file).count() == 0


def test_pieces_learned_once():
    """What no piece reaches over parts words, so a word is learned once, whatever signs and line ends follow it."""
    p, rng = pieces.Pieces(vocabulary("piece_bpe_32k.model")), random.Random(4)
    stems = ["".join(rng.choice("abctheinrso") for _ in range(9)) for _ in range(300)]
    p.encode([" ".join(w + end for w in stems for end in ("", ",", ".", "!", "?\n", ".\n", ";\n", ",\n\n", "\n", "!\n"))])
    assert len(p.known) < 2 * len(stems)


def test_pieces_hard(monkeypatch):
    """Units of each length, of any script, over LONG characters, and parted by U+0000; a few at once, and forgotten again."""
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    ref = sentencepiece.SentencePieceProcessor(model_file=file)
    rng = random.Random(5)
    names = [ref.id_to_piece(i) for i in range(300, ref.get_piece_size())]
    signs = ["thing ation", "(){}[];:'\"+-*/=<>_ \n    return self if", "".join(map(chr, range(0x20, 0x300))), "".join(map(chr, range(0x4E00, 0x5600))), "a😀\U0010ffff \t\r"]
    rows = ["".join(rng.choice(s) for _ in range(rng.randint(1, 200))) for s in signs for _ in range(60)]
    rows += ["".join(rng.choice(names) for _ in range(rng.randint(1, 30))).replace(pieces.MARK, " ") for _ in range(200)] + ["ab" * 3000, "the" * 17 + " " * 50]
    monkeypatch.setattr(pieces, "CELLS", 4000)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    p = pieces.Pieces(file)
    for k in range(0, len(rows), 50):
        own = [None, "", *rows[k : k + 50]]
        ids, cuts = p.encode(own)
        assert [ids[i:j].tolist() for i, j in zip(cuts, cuts[1:])] == [ref.encode(t or "") for t in own]
        assert p.decode(ids, cuts).to_pylist() == [t or "" for t in own]
    ids, cuts = p.encode(["a\0b", "\0\0"])
    assert ids.tolist() == [*ref.encode("a"), p.byte[0], ref.piece_to_id("b"), ref.piece_to_id(pieces.MARK), p.byte[0], p.byte[0]]


def test_pieces_odd_ids():
    """Bytes that are no UTF-8, bytes parted by ids that show nothing, and spaces after such ids."""
    import sentencepiece

    file = vocabulary("piece_bpe_32k.model")
    ref, p = sentencepiece.SentencePieceProcessor(model_file=file), pieces.Pieces(file)
    b, hidden, space = p.byte, next(i for i in range(ref.get_piece_size()) if ref.is_control(i)), ref.piece_to_id(pieces.MARK)
    rows = {(b[0xC3], b[0xA9]): "é", (b[0xC3], hidden, b[0xA9]): "\ufffd\ufffd", (b[0xC3], b[0x41]): "\ufffdA", (b[0xE6], b[0xBC]): "\ufffd", (hidden, space, b[0x41]): "A", (hidden,): "", (): "", (b[0x20], space): " "}
    for some in (list(rows), [(), (b[0xC3], b[0xA9])], [()]):
        ids = np.array([i for r in some for i in r], np.int32)
        assert p.decode(ids, np.cumsum([0, *map(len, some)])).to_pylist() == [rows[r] for r in some]
    with pytest.raises(IndexError):
        p.decode(np.array([-1], np.int32), np.array([0, 1]))


# Licences


def test_licenses(spark):
    rows = texts() + [(400, f"x\n\n{licenses.TEMPLATES[16][1][:400]}\n{licenses.TEMPLATES[16][1][400:]}\n\ny"), (401, "Licensed under CC BY-NC 4.0"), (402, "the Apache License")]
    want = []
    for i, t in rows:
        for line, n, unit in licenses.units(t or ""):
            b = licenses.bigrams(unit)
            best = {}
            for name, template in licenses.TEMPLATES:
                d = licenses.dice(b, licenses.bigrams(template)) if b else 0
                if d >= 0.8:
                    best[name] = max(d, best.get(name, 0))
            want += [(low(i), name, round(d, 9), line, n) for name, d in best.items()]
    got = licenses.scan(documents(spark, rows)).collect()
    assert sorted((low(r[0]), r[1], round(r[2], 9), r[3], r[4]) for r in got) == sorted(want)
    assert {(70, "Apache-2.0"), (71, "MIT"), (400, "MIT"), (401, "CC-BY-NC-4.0")} <= {(r[0], r[1]) for r in got} and 402 not in {r[0] for r in got}
    assert licenses.by_document(documents(spark, [])).count() == 0


def test_licenses_inside(spark):
    """A licence in three paragraphs amid other text, and notices inside a line, are found once each; a matching line counts as before."""
    rng = random.Random(4)
    mit = licenses.TEMPLATES[16][1]
    a, b = mit.index("The above"), mit.index("THE SOFTWARE IS")
    rows = [(1, f"{prose(rng, 150)}\n\n{mit[:a]}\n\n{mit[a:b]}\n\n{mit[b:]}\n\n{prose(rng, 150)}"), (2, "x\nThis text is licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0.")]
    rows += [(4, f"{prose(rng, 30)} Licensed under CC BY 4.0. {prose(rng, 30)} Licensed under CC BY 4.0. {prose(rng, 9)}"), (5, prose(rng, 3000))]
    got = {(r["doc_id"], r["license_id"]): (r["n_units"], r["best_dice"], r["best_line"]) for r in licenses.by_document(documents(spark, rows)).collect()}
    assert got[1, "MIT"] == (1, 1.0, 2) and got[2, "CC-BY-4.0"][1:] == (1.0, 1) and got[3, "CC-BY-4.0"] == (1, 1.0, 0) and got[4, "CC-BY-4.0"] == (2, 1.0, 0)
    assert set(got) == {(1, "MIT"), (2, "CC-BY-4.0"), (3, "CC-BY-4.0"), (4, "CC-BY-4.0")}


def test_licenses_in_long_texts(spark, monkeypatch):
    """Long texts, read word by word, give what short ones do; whole licences inside them are found, and templates can come from files."""
    rng = random.Random(12)
    names = {"BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Zlib", "BSL-1.0", "Apache-2.0", "Unlicense", "0BSD"}
    known = licenses.Templates()
    for name, body in licenses.TEMPLATES:
        if name in names and len(body) > 150:
            t = f"{prose(rng, 400)}\n\nCopyright (c) 2020 Someone\n{body}\n\n{prose(rng, 900)}"
            want = list(licenses.whole_scan(t, known))
            with monkeypatch.context() as m:
                m.setattr(licenses, "AT_ONCE", 50)
                assert list(licenses.whole_scan(t, known)) == want
            assert name in {x[0] for x in want}
    took_ = []
    for n in (40_000, 80_000):
        t, began = prose(rng, n), time.process_time()
        assert not list(licenses.whole_scan(t, known))
        took_.append(time.process_time() - began)
    assert took_[1] < 3 * max(took_[0], 0.2)


def test_licenses_from_files(spark, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("You may do with this as you like, but tell nobody.")
    own = licenses.templates_in(spark, str(tmp_path))
    got = licenses.by_document(documents(spark, [(1, "x y z\nyou may do with this as you like, but tell nobody!")]), own).collect()
    assert [(r["doc_id"], r["license_id"], r["best_line"]) for r in got] == [(1, "Own-1.0", 1)]
