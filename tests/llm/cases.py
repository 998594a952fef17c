"""Small tables with what is hard: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

import random

EXTRA = "n long, key string, row string, score double, digest long, own_id long, text_sha256 string, member long, shard int, base string, spans string, ids string, f1 long, g long, value string, predicted int, n_lines long"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
COLUMNS = [x.split()[0] for x in SCHEMA.split(", ")]


def prose(rng: random.Random, n: int) -> str:
    words = ["the", "of", "and", "stone", "river", "light", "garden", "window", "letter", "morning", "quiet", "paper", "silver", "mountain", "winter", "bridge"]
    return " ".join(rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(n))


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    near = [" ".join("changed" if k == 10 * (i + 1) else w for k, w in enumerate(base[0].split())) for i in range(5)]
    shared = "A line that several documents hold, word by word."
    out: list[tuple[int | None, str | None]] = [(i, t) for i, t in enumerate(base)]
    out += [(10 + i, t) for i, t in enumerate(near)]
    out += [(20, base[1]), (21, base[1]), (22, None), (23, ""), (24, " "), (25, "\n\n"), (26, "one two"), (27, "one two"), (28, "word"), (None, base[2]), (None, "no id here, but a text")]
    out += [(30, f"{base[3]}\n{shared}"), (31, f"  {shared.upper()}\t\nother text of its own"), (32, shared), (33, f"{shared}\n{shared}\nshort\nshort")]
    out += [(40, "mail a.b+c@example.com or x_y@z.org_u@v.net call +49 (0)30 1234-567 card 4111 1111 1111 1111 ip 10.0.0.1 not 300.1.1.1")]
    out += [(50, prose(rng, 40_000)), (51, "x" * 50_000), (52, "1" * 20_000), (53, "\x00 a\x1fb   café 漢字 😀")]
    out += [(60, base[4]), (60, base[4])]  # a repeated row
    out += [(70, "Licensed under the Apache License, Version 2.0.\nother"), (71, "released under the  MIT license")]
    return out


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en" if k % 2 else None, None if k % 3 else "src", None if k % 5 == 0 else len(t or ""), k, "k", None, 0.5, 7, -1, "t", 5, None, "b", "s", "i", None, 3, "v", None, 9) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def components(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
