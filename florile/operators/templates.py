"""Name templates, both ways: %token% patterns compiled into expressions that build names, or take them apart."""

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import MULTI, NUMBER, Catalog
from ..functions.text import stem_of

#: Tokens whose numbers are padded, and how lists are joined.
PADDED, SLASHED = frozenset({"track", "disc"}), frozenset({"genre"})
ILLEGAL = r"""[\x00-\x1f<>:"/\\|?*]"""


#: Ready templates for names, and patterns to take names apart, by label.
RENAME_TEMPLATES = {
    "Artist - Title": "%artist% - %title%", "Track - Title": "%track% - %title%", "Disc-Track - Title": "%disc%-%track% - %title%", "Track. Title": "%track%. %title%", "Album / Track - Title": "%album%/%track% - %title%",
    "Album artist / Year - Album / Track - Title": "%albumartist%/%year% - %album%/%disc%-%track% - %title%",
}
PARSE_PATTERNS = {
    "Track - Artist - Title": "%track% - %artist% - %title%", "Artist - Title": "%artist% - %title%", "Track - Title": "%track% - %title%", "Track. Title": "%track%. %title%",
    "Artist - Album - Track - Title": "%artist% - %album% - %track% - %title%",
}


@dataclass(frozen=True)
class Part:
    text: str
    token: bool


def parts(template: str) -> list[Part]:
    """Literals and tokens; a backslash takes the next character as it is, and a % without partner is one."""
    out: list[Part] = []
    for m in re.finditer(r"\\(.)|%([A-Za-z]+)%|(.)", template, re.S):
        if m[2]:
            out.append(Part(m[2].lower(), True))
        elif out and not out[-1].token:
            out[-1] = Part(out[-1].text + (m[1] or m[3]), False)
        else:
            out.append(Part(m[1] or m[3], False))
    return out


def padded(c: Column, width: int) -> Column:
    """Filled with zeros on the left, never cut."""
    t = c.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def token_value(catalog: Catalog, name: str, width: int = 2) -> Column:
    if name not in catalog:
        return F.lit("")
    f = catalog[name]
    if f.kind == MULTI:
        return F.array_join(f.values(), " / " if name in SLASHED else " & ")
    if f.kind == NUMBER and name in PADDED:
        return F.coalesce(padded(f.column, width), F.lit(""))
    return f.text()


def sanitised(c: Column) -> Column:
    """A name that file systems take: no illegal characters, no doubled spaces, no dots or spaces at the end, never empty."""
    t = F.regexp_replace(F.regexp_replace(c, ILLEGAL, " "), r"\s+", " ")
    t = F.regexp_replace(F.trim(t), r"[. ]+$", "")
    return F.when(t == "", "Unknown").otherwise(t)


def in_case(c: Column, style: str) -> Column:
    if style == "title":  # the first letter of each word; the rest stays
        words = F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30)))
        return F.array_join(words, " ")
    return {"upper": F.upper, "lower": F.lower}.get(style, lambda x: x)(c)


def generate(catalog: Catalog, template: str, sanitise: bool = True, case: str = "keep", width: int = 2) -> tuple[Column, Column]:
    """(path, missing): segments joined by /, and the tokens without a value, once each in order."""
    segments: list[list[Column]] = [[]]
    tokens: list[str] = []
    for p in parts(template):
        if p.token:
            tokens.append(p.text)
            segments[-1].append(in_case(token_value(catalog, p.text, width), case))
        elif p.text == "/":
            segments.append([])
        else:
            segments[-1].append(F.lit(p.text))
    whole = [F.concat(*s) if s else F.lit("") for s in segments]
    missing = F.array_compact(F.array(*[F.when(token_value(catalog, t, width) == "", F.lit(t)) for t in dict.fromkeys(tokens)]))
    return F.concat_ws("/", *(sanitised(s) if sanitise else s for s in whole)), missing


def parse(name: Column, template: str, loose: bool = False) -> dict[str, Column]:
    """The tokens' values (null where empty), matched, and coverage: the share of the stem that they take. Case doesn't matter."""
    stem = F.trim(stem_of(name))
    own = parts(template)
    while loose and own and own[0].token is False:
        own = own[1:]
    body = "".join("(.+?)" if p.token else "".join("\\" + c if c in r"\.[]{}()*+-?^$|/" else c for c in p.text) for p in own)
    regex = f"(?i)^{body}$"
    hit = stem.rlike(regex)
    values: dict[str, Column] = {}
    taken = F.lit(0)
    for i, p in enumerate((p for p in own if p.token), 1):
        v = F.trim(F.regexp_extract(stem, regex, i))
        taken = taken + F.length(v)
        values[p.text] = F.when(hit & (v != ""), v)
    coverage = F.when(hit & (F.length(stem) > 0), taken / F.length(stem)).otherwise(0.0)
    return values | {"matched": hit, "coverage": coverage}


def parse_greedy(name: Column, template: str) -> dict[str, Column]:
    """As parse; where the whole template doesn't fit, the part of it from its first literal to its last may, with a coverage of 1."""
    own = parts(template)
    at = [i for i, p in enumerate(own) if not p.token]
    whole = parse(name, template)
    if not at or (at[0] == 0 and at[-1] == len(own) - 1):
        return whole
    mid = "".join(f"%{p.text}%" if p.token else re.sub(r"([\\%])", r"\\\1", p.text) for p in own[at[0] : at[-1] + 1])
    inner = parse(name, mid)
    fits = ~whole["matched"] & inner["matched"]
    out = {k: F.when(fits, inner[k]).otherwise(v) if k in inner else v for k, v in whole.items()}
    return out | {"matched": whole["matched"] | inner["matched"], "coverage": F.when(fits, 1.0).otherwise(whole["coverage"])}


def parse_first(name: Column, templates: list[str] | None = None) -> Column:
    """The first of the templates (else of the ready patterns) that fits the name; null if none does."""
    out = F.lit(None).cast("string")
    for t in reversed(list(PARSE_PATTERNS.values()) if templates is None else templates):
        out = F.when(parse(name, t)["matched"], F.lit(t)).otherwise(out)
    return out


def guess(name: Column) -> Column:
    """A template that fits: leading digits are a track number, parts between " - " artist and title."""
    stem = stem_of(name)
    return F.when(stem.rlike(r"^\d+ - .+ - .+$"), "%track% - %artist% - %title%").when(stem.rlike(r"^\d+[ .-]+.+$"), "%track% %title%").when(stem.rlike(r"^.+ - .+$"), "%artist% - %title%").otherwise("%title%")


def without_collisions(rows: DataFrame, folder: list[str], target: str, seq: str, mode: str = "rename") -> DataFrame:
    """Names that collide (ignoring case) within a folder: the first keeps its name, later ones get " (2)", " (3)", ..., leaving out numbers that a row's
    own name has already, so made names are unique.

    mode "skip" gives those that collide no name; "cancel" leaves names as they are and marks those that collide, so that the caller can stop.
    """
    w = Window.partitionBy(*folder, F.lower(target)).orderBy(seq)
    out = rows.withColumn("_r", F.row_number().over(w)).withColumn("clash", F.col("_r") > 1)
    if mode == "skip":
        return out.withColumn("new_name", F.when(~F.col("clash"), F.col(target))).drop("_r")
    if mode == "cancel":
        return out.withColumn("new_name", F.col(target)).drop("_r")
    dotted = lambda c: F.regexp_extract(c, r"^.+(\.[^.]*)$", 1)
    form = r"^(.*) \(([0-9]{1,9})\)$"
    low = F.lower(F.col(target))
    own = rows.select(*folder, stem_of(low).alias("_stem"), dotted(low).alias("_dot")).where(F.col("_stem").rlike(form))
    own = own.select(*folder, F.concat(F.regexp_extract("_stem", form, 1), "_dot").alias("_low"), F.regexp_extract("_stem", form, 2).cast("int").alias("_k"))
    used = own.groupBy(*folder, "_low").agg(F.array_sort(F.collect_set("_k")).alias("_used"))
    out = out.withColumn("_low", low).join(used, [*folder, "_low"], "left")
    # The r-th free number: one more for each used number up to it.
    n = F.aggregate(F.coalesce("_used", F.array().cast("array<int>")), F.col("_r"), lambda m, k: F.when((k >= 2) & (k <= m), m + 1).otherwise(m))
    named = F.concat(stem_of(F.col(target)), F.lit(" ("), n.cast("string"), F.lit(")"), dotted(F.col(target)))
    return out.withColumn("new_name", F.when(F.col("clash"), named).otherwise(F.col(target))).select(*rows.columns, "clash", "new_name")
