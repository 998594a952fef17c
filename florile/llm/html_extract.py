"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass decides blocks by where they stand (menus, footers, forms, elements
named like notices, adverts or comments), by link density, and by length together with the density of stop words, where the page's
words show one of the languages whose stop words are known. Short blocks and headings stay undecided. In the second pass they inherit
the label of the nearest decided neighbours in their own part of the page (the article, or the page where it has none): if both sides
agree, that; else the nearer one's, counted in characters. Lists of links give their label to list items alone.

Within the article, only a name that is furniture as a whole ("ad", "comment-list") decides; one that merely holds such a word
("related-work", "side-note"), or has other meanings ("discussion"), counts only for blocks that don't read like text. Names of elements around the article say nothing about
it, unless the page has another article without them.

Defined results: null or empty html gives an empty text and 0; markup that is not closed ends with its page; each row gives a row;
other columns are ignored; an empty table gives an empty result.
"""

import html
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not he his at from are this or an had they which you were "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er hat aus bei nach "
    "de la le et les des en un une du est que qui dans pour pas au sur se ne par ce il sont avec "
    "el y los del las por con no su para al lo como más o pero sus ha me si sin sobre este".split()
)
#: HTML elements by what they do to the text around them.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
UNSEEN = frozenset("head noscript template svg math object canvas audio video select button label input".split())
AROUND = frozenset("nav footer aside form menu dialog search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that close an open one of the first name when they begin.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words in a class, id or role that say an element is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertisements|advertising|adbox|adslot|adsense|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|privacy|disclaimer|announcement|paywall|notice|notices|notification|alert|alerts|popup|modal|overlay|toast|"
    r"comment|comments|commentlist|usercomments|reply|replies|respond|responses|disqus|discussion|sidebar|side|aside|rail|widget|widgets|menu|menus|nav|navbar|navigation|breadcrumb|breadcrumbs|footer|foot|masthead|"
    r"share|sharing|social|related|recommended|recommendations|teaser|newsletter|subscribe|subscription|signup|login|search|pagination|pager|tags|toolbar|hidden|contentinfo|complementary|site-header|page-header|topbar)(?:$|[\s_-])"
)
#: Names of layouts that say what stands beside the article, not what the element is.
LAYOUT = re.compile(r"(?:has|with|no|without)[_-][\w-]+")
#: What begins markup: a tag with its name, a comment, a section or a declaration. The latter three may end with the page, a tag may not.
START = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)|[!?])")
OPEN_END = re.compile("<([!?])()")
#: The end of a tag, or a quote that begins a value.
VALUE = re.compile(r">|=\s*+([\"'])")
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
HIDE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words that make up a name of page furniture together with one that is furniture itself.
NEUTRAL = frozenset("a area bar body block bottom box boxes button buttons card cards container content entry feed form group header inner item items link links list lists main outer panel post posts row section slot story stories text thread title top unit widget wrap wrapper 1 2 3".split())
#: Names of furniture that sections of articles have as well.
DOUBTFUL = frozenset("alert alerts announcement announcements aside discussion disclaimer foot navigation notice notices overlay privacy promotion rail reply responses search side social subscription tags toast".split())
WORD = re.compile(r"[^\W\d_]+")

SHORT, LONG, STOP_LOW, STOP_HIGH, LINKS = 70, 200, 0.08, 0.2, 0.5
GOOD, BAD, OPEN = 1, 0, None


class Block:
    def __init__(self, text: str, linked: int, own: "Element"):
        self.text, self.article, self.heading, self.item = text, own.article, own.heading, own.item
        self.inside, self.outside, self.named, self.doubt = own.inside, own.outside, own.named, own.doubt
        self.links = linked / max(1, len(text))
        self.label = GOOD

    @property
    def around(self) -> bool:
        return self.inside or self.outside or self.named


class Element:
    """An open element, with what it has from those that hold it."""

    __slots__ = ("name", "unseen", "article", "link", "heading", "item", "inside", "outside", "named", "doubt", "block")

    def __init__(self, name: str, up: "Element | None"):
        self.name = name
        for k in self.__slots__[1:]:
            setattr(self, k, getattr(up, k) if up else False)

    #: inside, outside: page furniture within the article, or by an element outside; named: by the name of an element outside.
    #: doubt: by a name within the article that needs to be borne out; block: place of the nearest block-level element, itself included.


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(raw)}


def tag_end(page: str, at: int, known: dict[int, int]) -> int:
    """Where the tag ends whose attributes begin at at: at the first > outside quoted values, or at the first of all if a value isn't closed.

    known has, for each quote that began a value, what was found from there on, so that no part of the page is searched again and again.
    """
    met, i = [], at
    while True:
        m = VALUE.search(page, i)
        if m is None or m[1] is None:
            end = m.start() if m else -1
            break
        quote = m.end() - 1
        if quote in known:
            end = known[quote]
            break
        met.append(quote)
        i = page.find(m[1], quote + 1) + 1
        if not i:
            end = -1
            break
    known.update(dict.fromkeys(met, end))
    return end if end >= 0 else page.find(">", at)


def open_end(page: str, at: int) -> int:
    """Behind the comment, section or declaration that begins at at."""
    what, skip = ("-->", 2) if page.startswith("<!--", at) else ("]]>", 9) if page.startswith("<![CDATA[", at) else (">", 2)
    end = page.find(what, at + skip)
    return end + len(what) if end >= 0 else len(page)


def furniture(names: str) -> bool:
    """Whether one of the names consists of furniture words and neutral ones alone, and not of one that has other meanings."""
    for name in names.split():
        parts = re.split("[_-]+", name)
        own = [x for x in parts if NAMES.fullmatch(x)]
        if own and all(x in own or x in NEUTRAL for x in parts) and not set(own) <= DOUBTFUL:
            return True
    return False


def enter(name: str, raw: str, up: Element | None) -> Element:
    own = Element(name, up)
    a = attributes(raw) if raw.strip() else {}
    named = LAYOUT.sub(" ", " ".join(a[k] for k in ("class", "id", "role") if k in a).lower()) if a else ""
    own.unseen |= name in UNSEEN or ("hidden" in a and a["hidden"].lower() != "until-found") or a.get("aria-hidden", "").strip().lower() == "true" or HIDE.search(a.get("style", "")) is not None
    own.link |= name == "a"
    own.heading |= name in HEADINGS
    own.item = name in ("li", "dt", "dd", "option") or (own.item and name not in BLOCKS)
    begins = name in ("article", "main") or "articlebody" in named
    if own.article or begins:
        own.article = True
        own.inside |= name in AROUND or (bool(named) and not (begins and name == "main") and furniture(named))
        own.doubt |= bool(named) and not begins and NAMES.search(named) is not None
    else:
        own.outside |= name in AROUND or name == "header" or "header" in named.split()
        own.named |= bool(named) and name not in ("html", "body") and NAMES.search(named) is not None
    return own


def blocks(page: str) -> list[Block]:
    """The page's blocks. Each step looks at the top of the stack of open elements, or takes away what it looks at, so the time is linear also in deep markup."""
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    stack: list[Element] = []
    open_: Counter[str] = Counter()
    page_itself = Element("", None)

    def end() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            out.append(Block(text, linked, stack[-1] if stack else page_itself))
        parts, linked = [], 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1].unseen):
            text = html.unescape(raw)
            parts.append(text)
            if stack and stack[-1].link:
                linked += len(" ".join(text.split()))

    def pop(k: int) -> None:
        if any(x.name in BLOCKS for x in stack[k:]):
            end()
        open_.subtract(x.name for x in stack[k:])
        del stack[k:]

    at, lower, last, known = 0, None, page.rfind(">"), {}
    while (m := START.search(page, at)) is not None:
        if m[2] is not None and m.start() > last and (m := OPEN_END.search(page, m.start())) is None:
            break
        say(page[at : m.start()])
        if not m[2]:
            at = open_end(page, m.start())
            continue
        end_ = tag_end(page, m.end(), known)
        raw, at = page[m.end() : end_], end_ + 1
        name = m[2].lower()
        if m[1]:
            if open_[name] > 0:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name))
            elif name in BLOCKS:
                end()
            continue
        if name in RAW:
            lower = lower if lower is not None else page.lower()
            close = lower.find(f"</{name}", at) if len(lower) == len(page) else -1
            if close < 0:
                close = c.start() if (c := re.compile(f"</{name}", re.I).search(page, at)) else len(page)
            at = close
            continue
        if name == "body" and open_["head"] > 0:
            pop(next(k for k in range(len(stack)) if stack[k].name == "head"))
        k = stack[-1].block - 1 if stack else -1
        while k >= 0:  # up to the nearest block-level element that is no paragraph
            if name in CLOSES.get(stack[k].name, ()):
                pop(k)
                break
            if stack[k].name != "p":
                break
            k = stack[k - 1].block - 1 if k else -1
        if name in BLOCKS:
            end()
        elif name == "br":
            parts.append(" ")
        if name in VOID or raw.endswith("/"):
            continue
        own = enter(name, raw, stack[-1] if stack else None)
        stack.append(own)
        open_[name] += 1
        own.block = len(stack) if name in BLOCKS else own.block  # 1 more than its place; 0 is none
    say(page[at:])
    pop(0)
    end()
    return out


def first_pass(own: list[Block]) -> None:
    if not any(b.article and not b.around for b in own):  # all articles are within something named: the name is then one of the page's layout
        for b in own:
            b.named &= not b.article
    whole = any(b.article and not b.around for b in own)
    stops = []
    for b in own:
        words = WORD.findall(b.text.lower())
        stops.append((sum(w in STOP_WORDS for w in words), len(words)))
    prose = [x for b, x in zip(own, stops) if not b.around and b.links <= LINKS and len(b.text) >= SHORT]
    known = sum(x for x, _ in prose) >= STOP_LOW / 2 * sum(n for _, n in prose)
    for b, (x, n) in zip(own, stops):
        stop = x / max(1, n)
        if b.around or (whole and not b.article) or (b.doubt and (b.links > LINKS / 2 or not b.heading and len(b.text) < SHORT and stop < STOP_LOW)):
            b.label = BAD
        elif b.links > LINKS:
            b.label = OPEN if b.heading else BAD
        elif b.heading or len(b.text) < SHORT:
            b.label = OPEN
        elif known and (stop >= STOP_HIGH or b.article and stop >= STOP_LOW):
            b.label = GOOD
        elif len(b.text) >= LONG:
            b.label = GOOD if b.article or not known or stop >= STOP_LOW else BAD
        else:
            b.label = OPEN


def second_pass(own: list[Block]) -> None:
    for article in (True, False):
        part = [b for b in own if b.article == article and not b.around]
        sides = []
        for order in (range(len(part)), range(len(part) - 1, -1, -1)):
            seen: list[tuple[int | None, int]] = [(None, 0)] * len(part)
            near, text = (None, 0), (None, 0)  # the nearest decided block, and the nearest that is no list of links, with how far it is
            for i in order:
                b = part[i]
                seen[i] = near if b.item else text
                far = len(b.text)
                near, text = ((label, d + far) for label, d in (near, text))
                if b.label is not OPEN:
                    near = (b.label, 0)
                    if b.label is GOOD or b.links <= LINKS:
                        text = (b.label, 0)
            sides.append(seen)
        new = []
        for b, (before, far_before), (after, far_after) in zip(part, *sides):
            if b.label is not OPEN:
                new.append(b.label)
            elif before is None and after is None:
                new.append(GOOD)
            elif before is None or after is None or before == after:
                new.append(after if before is None else before)
            else:
                new.append(after if b.heading or far_after <= far_before else before)
        for b, label in zip(part, new):
            b.label = label


def main_text(page: str | None) -> str:
    own = blocks(page or "")
    first_pass(own)
    second_pass(own)
    return "\n".join(b.text for b in own if b.label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row."""
    text = F.pandas_udf(lambda s: s.map(main_text, na_action=None).astype(object), "string")

    return pages.select("page_id", "url", text(F.coalesce("html", F.lit(""))).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
