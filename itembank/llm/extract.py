"""Main text of web pages by template deduction from equivalence classes of tokens.

A page is a sequence of tokens: tags, comments and runs of text. A tag's role is told apart by its path: the tags open
around it. Over the pages of a host, a token's occurrence vector is the number of times it occurs on each page; tokens
with the same vector form an equivalence class (Arasu and Garcia-Molina, 2003). A class is valid if it occurs exactly once on
each of its pages and its tokens keep one order there; the valid classes of a host, nested by place, are its template, and what
stands between two of its tokens is a slot. A class that reaches over several slots of another is one class in each. Tags and names label
slots as articles or as page furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments, code). How much varying text
the slots of an element hold decides between articles, and whether an element is furniture that is only named so. The slots
of furniture are dropped; the others are the extracted text.

Vectors are never gathered: the sum of a digest of (page, count) over the pages is the same for two tokens exactly when
their vectors are, up to collisions of 64 bits, and sums combine before the shuffle, so a host with a third of all pages
is as good as any other. The template of a host is a short list and goes back to the pages by a join that may be split.
"""
from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from itembank.llm.common import query, slices, table

#: A class counts from so many pages, this share of the host's pages, and so many tokens.
LEAST_PAGES, LEAST_SHARE, LEAST_TOKENS = 2, 0.5, 2
#: An element with this share of the content's varying text is no furniture, whatever its names say.
MOST = 0.75
#: The pages of so many largest hosts are dealt over parts of so many pages.
HOT_HOSTS, PART_PAGES = 1000, 256
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup, or is nothing to read.
RAW = frozenset("script style title textarea noscript template iframe svg object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
FURNITURE = frozenset("head nav menu footer aside form button select fieldset dialog header".split()) | RAW
#: Words in class, id or role that name page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies"
    " footer masthead menu modal nav navbar navigation navigationbar newsletter notice notification pagination popup promo related share"
    " sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: A name with one of these words tells a state of the element, not its kind: no-ads, has-sidebar, share-enabled.
STATE_WORDS = frozenset("no has with without is not enabled disabled active".split())
#: "related" names furniture alone or with one of these.
RELATED = frozenset("related article articles content item items link links news page pages post posts reading stories story".split())
#: Furniture that may be long and hold articles of its own.
REPLIES = frozenset("comment comments".split())
CONTENT = frozenset(["article", "main"])
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^\s/>]*(?:\"[^\"]*\"|'[^']*'|[^'\">])*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)


def furniture_words(names: list[str]) -> frozenset[str]:
    """The words among an element's names (class, id, role) that say that it is page furniture."""
    found = set()
    for name in names:
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w]
        if not words or STATE_WORDS & set(words):
            continue
        found |= {w for w in words if w in FURNITURE_WORDS and (w != "related" or set(words) <= RELATED)}
    return frozenset(found)


class Token:
    """kind: open, close or text. path: digest of the tags open around it, its own last."""

    __slots__ = ("kind", "name", "words", "named", "text", "key")

    def __init__(self, kind: str, name: str, words: frozenset[str], named: frozenset[str], path: int, text: str):
        self.kind, self.name, self.words, self.named, self.text = kind, name, words, named, text
        self.key = xxhash.xxh3_64_intdigest(f"{kind} {path} {text}".encode("utf-8", "replace")) - (1 << 63)


class _Open:
    """The open elements: name and path digest of each, and where each name, block and region stands among them, so a
    tag costs the same at any depth."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.paths: list[int] = [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []   # BLOCK elements
        self.regions: list[int] = []  # those but paragraphs

    def path_of(self, label: str) -> int:
        return xxhash.xxh3_64_intdigest(f"{self.paths[-1]}/{label}".encode("utf-8", "replace"))

    def push(self, name: str, path: int) -> None:
        depth = len(self.names)
        self.names.append(name)
        self.paths.append(path)
        self.at.setdefault(name, []).append(depth)
        if name in BLOCK:
            self.blocks.append(depth)
            if name != "p":
                self.regions.append(depth)

    def pop(self) -> Token:
        name, path = self.names.pop(), self.paths.pop()
        self.at[name].pop()
        if name in BLOCK:
            self.blocks.pop()
            if name != "p":
                self.regions.pop()
        return Token("close", name, frozenset(), frozenset(), path, "")

    def last(self, name: str) -> int:
        held = self.at.get(name)
        return held[-1] if held else -1


def tokens_of(page: str) -> list[Token]:
    """Tokens of a page with their paths. An end tag closes what is open inside its element, or nothing; a paragraph
    ends where a block begins; the end of the page closes the rest."""
    out: list[Token] = []
    opened = _Open()
    none: frozenset[str] = frozenset()
    raw_end = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}
    run: list[str] = []  # pieces of the text at hand

    def end_run() -> None:
        if run:
            text = "".join(run)
            out.append(Token("text", "", none, none, opened.paths[-1], text if text.strip() else " "))
            run.clear()

    at = 0
    while at < len(page):
        found = TOKEN.match(page, at)
        raw, at = found[0], found.end()
        if raw[0] != "<" or len(raw) == 1:
            run.append(raw)
            continue
        if raw[1] in "!?":
            end_run()
            continue
        end_run()
        name = NAME.match(raw)[1].lower()
        if raw[1] == "/":
            depth = opened.last(name)
            # The end of an inline or paragraph element does not reach out of the region it stands in.
            if depth >= 0 and (name in BLOCK - {"p"} or not opened.regions or opened.regions[-1] < depth):
                while len(opened.names) > depth:
                    out.append(opened.pop())
            continue
        names = [w for m in NAMED.finditer(raw) for w in (m[2] or m[3] or m[4] or "").lower().split()]
        words = frozenset(w for n in names for w in re.split(r"[^a-z0-9]+", n) if w)
        label = ".".join([name, *sorted(words)])
        if name in BLOCK and opened.blocks and opened.blocks[-1] == opened.last("p"):
            depth = opened.blocks[-1]
            while len(opened.names) > depth:
                out.append(opened.pop())
        path = opened.path_of(label)
        out.append(Token("open", name, words, furniture_words(names), path, ""))
        if name in RAW and not raw.endswith("/>"):
            end = raw_end[name].search(page, at)
            at = end.end() if end else len(page)
        if name in VOID or name in RAW or raw.endswith("/>"):
            out.append(Token("close", name, none, none, path, ""))
        else:
            opened.push(name, path)
    end_run()
    while opened.names:
        out.append(opened.pop())
    return out


def template_on(tokens: list[Token], keys: list[int], classes: list[int]) -> dict[int, int]:
    """Places of the tokens on this page that belong to the host's template, with their nested class (``nested``): of each class, its
    tokens if each occurs once here and in the template's order."""
    counts = Counter(t.key for t in tokens)
    places = {t.key: i for i, t in enumerate(tokens) if counts[t.key] == 1}
    by_class: dict[int, list[int]] = {}
    for key, name in zip(keys, classes):
        by_class.setdefault(name, []).append(places.get(key, -1))
    return nested({name: held for name, held in by_class.items() if min(held) >= 0 and held == sorted(held)})


def nested(by_class: dict[int, list[int]]) -> dict[int, int]:
    """Number of the nested class of each place. Of two classes one lies in one slot of the other, or they lie apart; a class that goes
    on behind a slot where it began is another there."""
    left = {name: len(held) for name, held in by_class.items()}
    out: dict[int, int] = {}
    around: list[int] = []
    number: dict[int, int] = {}
    made = 0
    for place, name in sorted((place, name) for name, held in by_class.items() for place in held):
        if name in number:
            while around[-1] != name:
                del number[around.pop()]
        else:
            around.append(name)
            number[name] = made
            made += 1
        out[place] = number[name]
        left[name] -= 1
        if not left[name]:
            del number[around.pop()]
    return out


def is_hard(t: Token) -> bool:
    """Whether an element is furniture by its tag or as readers' comments, however much text it holds."""
    return t.name in FURNITURE - {"form", "header"} or bool(t.named & REPLIES)


def varying(tokens: list[Token], ends: dict[int, int], fixed: dict[int, int], chars: dict[int, int]) -> dict[int, int]:
    """Characters of text in the slots of each element that starts and ends in one nested class, over the host's pages, by the place of
    its start: what it holds (``chars``, by key) without the template's text, readers' comments and tags of furniture in it."""
    same = [0]
    for i, t in enumerate(tokens):
        same.append(same[-1] + (chars.get(t.key, 0) if t.kind == "text" and i in fixed else 0))
    starts = [i for i in fixed if tokens[i].kind == "open" and fixed.get(ends[i]) == fixed[i]]
    held = {i: chars.get(tokens[i].key, 0) - (same[ends[i]] - same[i]) for i in starts}
    gone, reach = [0], -1
    for i, t in enumerate(tokens):
        hard = i > reach and i in held and is_hard(t)
        reach = ends[i] if hard else reach
        gone.append(gone[-1] + (held[i] if hard else 0))
    return {i: n - (gone[ends[i]] - gone[i + 1]) for i, n in held.items()}


def _spans(tokens: list[Token]) -> tuple[dict[int, int], list[int]]:
    """Place of the end of every element by the place of its start, and characters of text before each place."""
    ends, stack, before = {}, [], [0]
    for i, t in enumerate(tokens):
        if t.kind == "open":
            stack.append(i)
        elif t.kind == "close":
            ends[stack.pop()] = i
        before.append(before[-1] + (len(t.text) - t.text.count(" ") if t.kind == "text" else 0))
    return ends, before


def _roots(tokens: list[Token], ends: dict[int, int], before: list[int], slots: dict[int, int]) -> set[int]:
    """Places where the content elements of the page open: its articles, else its main elements.

    An article in a menu, footer or sidebar, and a reader's comment, are none if another is there, nor is one whose ``slots`` (``varying``)
    hold nothing, for it says the same on all pages. Of several articles, one that alone has
    a first heading and holds most of their text is the content, and the others point to other pages."""
    for kind in ("article", "main"):
        plain, named, hidden, inside, soft = [], [], 0, [], 0
        for i, t in enumerate(tokens):
            if t.kind == "open":
                hard = is_hard(t)
                side = t.name not in ("html", "body") and bool(t.named) and not hard
                if (t.name == kind or kind == "main" and "main" in t.words) and not hidden and not hard:
                    (named if soft or side else plain).append(i)
                inside.append((hard, side))
                hidden, soft = hidden + hard, soft + side
            elif t.kind == "close":
                hard, side = inside.pop()
                hidden, soft = hidden - hard, soft - side
        # What only stands in a wrapper named like furniture counts if it is most of the page.
        found = plain or [i for i in named if 2 * (before[ends[i]] - before[i]) >= before[-1]]
        if not found:
            continue
        found = [i for i in found if slots.get(i, 1) > 0] or found
        outer, reach = [], -1
        for i in found:
            if i > reach:
                outer.append(i)
                reach = ends[i]
        sizes = {i: before[ends[i]] - before[i] for i in outer}
        heads = [i for i in outer if any(t.kind == "open" and t.name == "h1" for t in tokens[i:ends[i]])]
        if len(outer) > 1 and len(heads) == 1 and 2 * sizes[heads[0]] >= sum(sizes.values()):
            outer = heads
        return set(outer)
    return set()


def main_text(page: str | None, keys: list[int], classes: list[int], chars: list[int] = ()) -> str:
    """The slots of the page's template that are neither furniture nor outside the content, as blocks."""
    tokens = tokens_of(page or "")
    fixed = template_on(tokens, keys, classes)
    ends, before = _spans(tokens)
    slots = varying(tokens, ends, fixed, dict(zip(keys, chars)))
    roots = _roots(tokens, ends, before, slots)
    most = MOST * max((slots.get(i, 0) for i in roots or slots), default=0)
    first, last = min(roots, default=len(tokens)), max((ends[i] for i in roots), default=-1)
    opened, content, dropped = [], 0, 0
    blocks, block = [], []

    def furniture(i: int, t: Token) -> bool:
        """Classes of the whole page say what it has, not what it is; nothing around the content is furniture, nor is a form
        around most of a page without an article."""
        if t.name in ("html", "body") or i in roots or (roots and i < first and ends[i] > last):
            return t.name == "head"
        if t.name == "form" and not roots and 2 * (before[ends[i]] - before[i]) >= before[-1]:
            return False
        if t.named and t.name not in FURNITURE and not t.named & REPLIES and slots.get(i, 0) >= most > 0:
            return False
        return (t.name in FURNITURE and not (content and t.name == "header")) or bool(t.named)

    def end_block() -> None:
        text = " ".join(html.unescape("".join(block)).split())
        if text:
            blocks.append(text)
        block.clear()

    for i, t in enumerate(tokens):
        if t.kind == "open":
            if t.name in BLOCK:
                end_block()
            is_root, drop = i in roots, furniture(i, t)
            opened.append((is_root, drop))
            content, dropped = content + is_root, dropped + drop
            if t.name == "br" and not dropped:
                block.append(" ")
        elif t.kind == "close":
            if t.name in BLOCK:
                end_block()
            is_root, drop = opened.pop()
            content, dropped = content - is_root, dropped - drop
        elif not dropped and (content if roots else i not in fixed):
            block.append(t.text)
    end_block()
    return "\n".join(blocks)


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        rows, keys, counts, places, chars = [], [], [], [], []
        for row, page in zip(part.column("row").to_pylist(), part.column("html").to_pylist()):
            tokens = tokens_of(page or "")
            held = Counter(t.key for t in tokens)
            ends, before = _spans(tokens)
            first = {t.key: i for i, t in reversed(list(enumerate(tokens)))}
            rows += [row] * len(held)
            keys += held.keys()
            counts += held.values()
            places += [first[k] / len(tokens) for k in held]
            # An element's text, or the text itself.
            chars += [before[ends.get(first[k], first[k]) + 1] - before[first[k]] for k in held]
        by_row = dict(zip(part.column("row").to_pylist(), part.column("host").to_pylist()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([by_row[r] for r in rows], pa.string()), pa.array(rows, pa.int64()), pa.array(keys, pa.int64()),
             pa.array(counts, pa.int64()), pa.array(places, pa.float64()), pa.array(chars, pa.int64())], ["host", "row", "key", "n", "place", "chars"])


def templates(pages: DataFrame) -> DataFrame:
    """``host``, ``keys``, ``classes``, ``chars`` from ``host``, ``row``, ``html``: the tokens of the host's valid classes in the order of
    their mean place, with the characters of text that each holds on all pages. A list holds at most 1 / LEAST_SHARE times the tokens of a mean page."""
    seen = pages.mapInArrow(_occurrences, "host string, row long, key long, n long, place double, chars long")
    tokens = seen.groupBy("host", "key").agg(
        F.bit_xor(F.xxhash64("row", "n")).alias("vector"), F.count(F.lit(1)).alias("pages"), F.max("n").alias("most"), F.avg("place").alias("place"), F.sum("chars").alias("chars"))
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    once = tokens.where((F.col("most") == 1) & (F.col("pages") >= LEAST_PAGES)).join(sizes, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all"))
    classes = once.groupBy("host", "vector", "pages").agg(F.collect_list(F.struct("place", "key", "chars")).alias("tokens")).where(F.size("tokens") >= LEAST_TOKENS)
    flat = classes.select("host", F.transform("tokens", lambda t: F.struct(t["place"].alias("place"), t["key"].alias("key"), F.col("vector").alias("vector"), t["chars"].alias("chars"))).alias("tokens"))
    ordered = flat.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    return ordered.select("host", F.col("tokens.key").alias("keys"), F.col("tokens.vector").alias("classes"), F.col("tokens.chars").alias("chars"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        columns = [part.column(c).to_pylist() for c in ("html", "keys", "classes", "chars")]
        texts = [main_text(page, keys or [], classes or [], chars or []) for page, keys, classes, chars in zip(*columns)]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` of every row.

    Where a page has an article (or else a main element), that is the content, and all its text outside furniture is
    kept, though it may stand on all pages of the host. Of several, those that say the same on all pages of the host are not the content if
    another varies, and an element in it that holds most of its varying text is no furniture, unless its tag or readers' comments say so; else the content is the body without furniture and without
    text of the template. What stands around the content is no furniture, however it is named, nor is a form around most of a page;
    an article in furniture is the content only if it is most of the page. Elements may be nested to any depth. A null or empty page has the empty text; a page without a host has no template, nor has a
    host with one page; broken markup, repeated rows, null ids and other columns do no harm.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select("page_id", "url", "html", host.alias("host"), F.monotonically_increasing_id().alias("row"))
    known = templates(rows.where(F.coalesce(F.col("host"), F.lit("")) != "").select("host", "row", "html"))
    # The pages of a large host, or of none, are dealt over parts, each with its own copy of the host's template. Of the
    # HOT_HOSTS largest hosts the number of parts goes to every task; any other holds at most 1 / HOT_HOSTS of the pages.
    parts = rows.groupBy(F.coalesce("host", F.lit("")).alias("site")).agg(F.ceil(F.count(F.lit(1)) / PART_PAGES).alias("parts"))
    hot = F.broadcast(parts.where("parts > 1").orderBy(F.col("parts").desc(), "site").limit(HOT_HOSTS))
    one = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = rows.withColumn("site", F.coalesce("host", F.lit(""))).join(hot, "site", "left").withColumn("part", F.pmod(F.xxhash64("row"), one))
    copies = known.withColumnRenamed("host", "site").join(hot, "site", "left").select(
        "site", "keys", "classes", "chars", F.explode(F.sequence(F.lit(0).cast("long"), one - 1)).alias("part"))
    return dealt.join(copies, ["site", "part"], "left").select("page_id", "url", "html", "keys", "classes", "chars").mapInArrow(
        _extract, "page_id long, url string, text string")


@query()
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
