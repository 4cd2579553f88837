"""Main text of web pages by equivalence classes of the tokens that pages of a host share.

A token is the start or the end of an element at its place in the tree (path of tag names and first
class names), or a block of text at its place. Its occurrence vector says how often each page of the host
holds it; the vector is kept as a sum of hashes of (page, times), which tasks combine. Tokens with equal
vectors are one equivalence class. A class is valid when it has at least ``LEAST_TOKENS`` tokens without the ends,
comes on at least ``FREQUENT`` of the pages and in ``LEAST_PAGES`` different bodies (text outside of the
excluded parts, so that copies of one page are no evidence), its tokens come in one order on all pages, again and
again where they repeat, and it is nested: all its instances lie in one gap, between the same two tokens, of the
class around it. The valid classes are the template; text tokens among them are what never changes.

The other blocks fill slots, the gaps of the template. A slot goes that is filled by links over all pages of the
host, and so does one inside a class that repeats (records such as comments) in another gap than the one of the
host that holds the most text. Lists of tags and names judge what is around a block; where text that is left is
inside an article or main element, only that stays, whether it changes or not.

The pages are read twice: once for their tokens, which are written as arrays of hashes that the passes over
order and nesting read, and once for the text. Tasks combine before each shuffle, so a host with a third of all
pages is one row per token of a task. Pages meet the template of their host in joins by host, in which adaptive
execution splits large hosts; a template holds tokens of at least a fifth of the host's pages, which bounds it.

Defined results: null or empty html gives an empty text; a page without a host in its url shares
a template with others of that kind; hosts with fewer than three pages have no template and are
read by names alone; broken markup is closed where HTML closes it; rows that repeat are repeated;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.tables import table, written
from veilscan.session import ship_by_value

ship_by_value(__name__)

LEAST_PAGES = 3
LEAST_TOKENS = 2
FREQUENT = 0.2
#: Templates a task has at hand.
HOSTS = 256
LINKED = 0.6

PIECES = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr br acronym".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first closes an open element of the second.
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
PARAGRAPH_STAYS = INLINE | {"input", "button", "object", "ruby", "video", "audio", "canvas"}
OUTSIDE = frozenset("head title nav footer aside button menu dialog".split())
#: Class names, ids and roles (or their parts between hyphens) of what is not the article.
OUTSIDE_NAMES = re.compile(
    r"^(ad|ads|advert\w*|sponsor\w*|promo\w*|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|comments?|"
    r"commentlist|repl(y|ies)|respond|disqus\w*|discussion|cookies?|consent|gdpr|notices?|alert|banner|popup|modal|"
    r"footer|foot|related|recommend\w*|share|sharing|social\w*|subscribe|newsletter|signup|login|search|widget|"
    r"copyright|legal|pager|pagination|tags|complementary|contentinfo)$", re.I)
#: Of these, what is not the article even where it holds an article element.
NEVER_INSIDE = re.compile(r"^(comments?|commentlist|repl(y|ies)|respond|disqus\w*|discussion|related|recommend\w*|"
                          r"sidebar\w*|ad|ads|advert\w*|sponsor\w*|promo\w*)$", re.I)
PAGE_HEADS = re.compile(r"^(header|site-?header|page-?header|masthead|top-?bar|skip-?link)$", re.I)
#: A name that begins so says what is missing or around.
NEGATED = re.compile(r"^(no|has|with|without|not)[-_]", re.I)
INSIDE = frozenset(("article", "main"))
START, END = -1, -2


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@functools.lru_cache(1 << 14)
def ends_of(path: str) -> tuple[int, int]:
    """Tokens of the start and the end of an element."""
    return hashed(f"<{path}"), hashed(f">{path}")


class Element:
    """``outside``: 0 in the article, 1 in an excluded part that an article element ends, 2 in one that stays."""

    __slots__ = ("tag", "path", "outside", "inside", "opens", "closes")

    def __init__(self, tag: str, names: list[str], parent: Element | None):
        self.tag = tag
        first = names[0] if names else ""
        self.path = f"{parent.path if parent else ''}/{tag}{'.' + first if first else ''}"
        self.inside = bool(parent and parent.inside) or tag in INSIDE
        self.opens, self.closes = ends_of(self.path)
        around = parent.outside if parent else 0
        if tag in INSIDE and around < 2:
            around = 0
        plain = [n for n in names if not NEGATED.match(n)]
        parts = [p for n in plain for p in (n.replace("-", ""), *re.split("[-_]", n))]
        # Inside an article a part of a name says little: social-policy is a subject there.
        judged = plain if self.inside else parts
        if tag in ("html", "body", *INSIDE):
            own = 0
        elif tag in OUTSIDE or any(NEVER_INSIDE.match(p) for p in parts):
            own = 2
        else:
            page_head = not self.inside and (tag == "header" or any(PAGE_HEADS.match(n) for n in names))
            own = int(tag == "form" or page_head or any(OUTSIDE_NAMES.match(p) for p in judged))
        self.outside = max(around, own)


def names_of(tag_text: str) -> list[str]:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag_text)}
    # Numbers in ids often belong to one page.
    ids = [re.sub(r"\d+", "#", n) for n in found.get("id", "").split()]
    return [*found.get("class", "").split(), *ids, *found.get("role", "").split()]


def parsed(page: str) -> tuple[list[tuple[list[Element], str, int]], list[tuple[int, int]]]:
    """(blocks, events) of a page in order. A block is (elements around it, its text, characters in links), an event
    (token, number of the block, or ``START`` or ``END`` of an element)."""
    blocks, events, stack = [], [], []
    text: list[str] = []
    linked, in_link = 0, 0

    def flush():
        nonlocal linked
        # References are decoded over the whole block, then white space becomes single spaces.
        joined = " ".join(entities.unescape("".join(text)).split())
        if joined:
            events.append((hashed(f"={stack[-1].path if stack else ''}\n{joined}"), len(blocks)))
            blocks.append((list(stack), joined, min(linked, len(joined))))
        text.clear()
        linked = 0

    def end(at):
        events.extend((e.closes, END) for e in reversed(stack[at:]))
        del stack[at:]

    for m in PIECES.finditer(page):
        piece = m[0]
        if piece[0] != "<" or piece == "<":
            text.append(piece)
            if in_link:
                linked += len(piece.strip())
            continue
        name = NAME.match(piece)
        if m[1] or not name:
            continue
        tag = name[1].lower()
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                in_link = 0 if piece[1] == "/" else 1
            continue
        flush()
        if piece[1] == "/":
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
            if at is not None:
                end(at)
                in_link = 0
            continue
        closed = CLOSES.get(tag, "").split()
        if closed:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in closed:
                    end(k)
                    break
                if stack[k].tag in ("ul", "ol", "dl", "table", "select"):
                    break
        if tag not in PARAGRAPH_STAYS and stack and stack[-1].tag == "p":
            end(len(stack) - 1)
        element = Element(tag, names_of(piece) if "=" in piece else [], stack[-1] if stack else None)
        events.append((element.opens, START))
        if tag not in VOID and not piece.endswith("/>"):
            stack.append(element)
    flush()
    end(0)
    return blocks, events


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1))
    return F.regexp_replace(host, r"^.*@|:[0-9]*$", "")


def events_of(pages: DataFrame) -> DataFrame:
    """host, page (hash of its html), body (hash of the text outside of excluded parts), tokens array<long>, chars
    array<int> (of a block; ``START`` or ``END`` of an element), links array<int> (characters in links)."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for page in batch.column(1).to_pylist():
                blocks, events = parsed(page or "")
                body = "\n".join(text for around, text, _ in blocks if not any(e.outside for e in around))
                row = (hashed(page or ""), hashed(body), [t for t, _ in events],
                       [k if k < 0 else len(blocks[k][1]) for _, k in events],
                       [0 if k < 0 else blocks[k][2] for _, k in events])
                for column, value in zip(out, row):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)],
                                             ["host", "page", "body", "tokens", "chars", "links"])

    slim = pages.select(host_of(F.col("url")).alias("host"), "html")
    return slim.mapInArrow(run, "host string, page long, body long, tokens array<long>, chars array<int>, links array<int>")


def grouped(batches, columns: int, make, add, limit: int = 200_000, template: int | None = None):
    """Calls ``add(found, *row)`` for every row and yields ``make(found)`` whenever ``found`` is large, and last.
    The column ``template`` is handed over as it is, as few of its values are looked at."""
    found: dict = {}
    for batch in batches:
        for row in zip(*(batch.column(k) if k == template else batch.column(k).to_pylist() for k in range(columns))):
            add(found, *row)
        if len(found) > limit:
            yield make(found)
            found = {}
    yield make(found)


def vectors(events: DataFrame) -> DataFrame:
    """One row per (host, token): its vector (low, high), pages that hold it, times, sum of its first places, whether
    it counts for the size of a class, and number of different bodies (exact up to ``LEAST_PAGES``). Token null: the host."""

    def add(found, host, page, body, tokens, chars):
        times = Counter(tokens)
        first = dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1)))
        ends = {token for token, kind in zip(tokens, chars) if kind == END}
        times[None], first[None] = 1, 0
        halves = {}  # of the hash of (page, times)
        for n in set(times.values()):
            h = hashed(f"{page} {n}") + (1 << 63)
            halves[n] = h & 0xFFFFFFFF, h >> 32
        for token, n in times.items():
            low, high = halves[n]
            old = found.get((host, token))
            if old is None:
                found[host, token] = [low, high, 1, n, first[token], int(token not in ends), {body}]
                continue
            old[0] += low
            old[1] += high
            old[2] += 1
            old[3] += n
            old[4] += first[token]
            if len(old[6]) < LEAST_PAGES:  # different bodies, as many as are asked for
                old[6].add(body)

    names = ["host", "token", "low", "high", "pages", "times", "place", "counts", "bodies"]

    def make(found):
        values = [[k[0] for k in found], [k[1] for k in found], *([v[k] for v in found.values()] for k in range(6)),
                  [list(v[6]) for v in found.values()]]
        kinds = [pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)], names)

    schema = "host string, token long, low long, high long, pages long, times long, place long, counts long, bodies array<long>"
    rows = events.select("host", "page", "body", "tokens", "chars").mapInArrow(lambda b: grouped(b, 5, make, add), schema)
    return rows.groupBy("host", "token").agg(
        *(F.sum(c).alias(c) for c in ("low", "high", "pages", "times", "place")), F.max("counts").alias("counts"),
        F.size(F.array_distinct(F.flatten(F.collect_set("bodies")))).alias("bodies"))


def classes(found: DataFrame) -> DataFrame:
    """host, class, repeats, tokens (in their order): classes of equal vectors that are large and frequent enough."""
    sizes = found.where("token is null").select("host", F.col("pages").alias("of"))
    frequent = found.where("token is not null").join(sizes, "host").where(
        (F.col("of") >= LEAST_PAGES) & (F.col("pages") >= FREQUENT * F.col("of")))
    one = frequent.groupBy("host", "low", "high", "pages", "times").agg(
        F.sort_array(F.collect_list(F.struct("place", "token"))).alias("tokens"),
        F.sum("counts").alias("size"), F.max("bodies").alias("bodies"))
    one = one.where((F.col("size") >= LEAST_TOKENS) & (F.col("bodies") >= LEAST_PAGES))
    return one.select("host", F.xxhash64("low", "high", "pages", "times").alias("class"),
                      (F.col("times") > F.col("pages")).alias("repeats"), F.col("tokens.token").alias("tokens"))


def per_host(found: DataFrame) -> DataFrame:
    """host, template: array of (class, repeats, tokens)."""
    return found.groupBy("host").agg(F.collect_list(F.struct("class", "repeats", "tokens")).alias("template"))


class Template:
    """The classes of a host: places of tokens in them; ``marks``: gap -> (mostly links, the richest of the host)."""

    def __init__(self, found: list[dict] | None):
        self.size = {c["class"]: len(c["tokens"]) for c in found or []}
        self.repeats = {c["class"] for c in found or [] if c["repeats"]}
        self.marks: dict[tuple[int, int], tuple[bool, bool]] | None = None
        self.place = {t: (c["class"], k) for c in found or [] for k, t in enumerate(c["tokens"])}

    def unordered(self, tokens: list[int]) -> set[int]:
        """Classes whose tokens do not come in their order on a page, once or again and again."""
        after, wrong = dict.fromkeys(self.size, 0), set()
        for token in tokens:
            if token in self.place:
                name, k = self.place[token]
                if k != after[name]:
                    wrong.add(name)
                after[name] = (k + 1) % self.size[name]
        return wrong | {name for name, k in after.items() if k}

    def walk(self, tokens: list[int]):
        """(slots, gaps, torn): of each token the gap (class, place) it lies in and the gap of the innermost class that
        does not repeat, or None where the token is of the template; (class, gap around an instance of it); classes
        of instances that are not over when the class around goes on."""
        stack: list[tuple[int, int]] = []
        slots, gaps, torn = [], set(), set()
        outer = (0, 0)
        for token in tokens:
            if token not in self.place:
                once = next((g for g in reversed(stack) if g[0] not in self.repeats), outer)
                slots.append((stack[-1] if stack else outer, once))
                continue
            slots.append(None)
            name, k = self.place[token]
            if k == 0:
                gaps.add((name, stack[-1] if stack else outer))
                stack.append((name, 0))
            else:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if at is None:
                    torn.add(name)
                    continue
                torn.update(g[0] for g in stack[at + 1 :])
                stack[at:] = [(name, k)]
            if k == self.size[name] - 1:
                stack.pop()
        return slots, gaps, torn | {g[0] for g in stack}


def kept_template(kept: dict, host: str | None, found: pa.Scalar) -> Template:
    """The template of a host; those of the last ``HOSTS`` or fewer are at hand."""
    if host not in kept:
        if len(kept) >= HOSTS:
            kept.clear()
        kept[host] = Template(found.as_py())
    return kept[host]


def wrong_classes(events: DataFrame, found: DataFrame, nested: bool) -> DataFrame:
    """(host, class) of the classes that are out of order on some page or, ``nested``, not in one gap of one class."""

    def run(batches):
        kept: dict = {}

        def add(out, host, tokens, template):
            shape = kept_template(kept, host, template)
            if not nested:
                out.update(((host, name), [1, 0, 0]) for name in shape.unordered(tokens))
                return
            _, gaps, torn = shape.walk(tokens)
            for name, gap in gaps:
                h = hashed(repr(gap))
                old = out.setdefault((host, name), [0, h, h])
                old[1:] = min(old[1], h), max(old[2], h)
            for name in torn:
                out.setdefault((host, name), [1, 0, 0])[0] = 1

        def make(out):
            values = [[k[0] for k in out], [k[1] for k in out], *([v[k] for v in out.values()] for k in range(3))]
            kinds = [pa.string(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)],
                                              ["host", "class", "wrong", "low", "high"])

        yield from grouped(batches, 3, make, add, template=2)

    rows = events.join(per_host(found), "host").select("host", "tokens", "template")
    rows = rows.mapInArrow(run, "host string, class long, wrong long, low long, high long").groupBy("host", "class").agg(
        F.max("wrong").alias("wrong"), F.min("low").alias("low"), F.max("high").alias("high"))
    return rows.where("wrong = 1 or low <> high").select("host", "class")


def template_of(events: DataFrame) -> DataFrame:
    """host, class, repeats, tokens: the valid classes."""
    found = written(classes(vectors(events)), "page-classes")
    for nested in (False, True):
        wrong = wrong_classes(events, found, nested)
        found = written(found.join(wrong, ["host", "class"], "left_anti"), "ordered-classes" if not nested else "nested-classes")
    return found


def slot_marks(events: DataFrame, found: DataFrame) -> DataFrame:
    """host, marks: array of (class, place, linked, richest) of the gaps of a host that hold text."""

    def run(batches):
        kept: dict = {}

        def add(out, host, tokens, chars, links, template):
            slots, _, _ = kept_template(kept, host, template).walk(tokens)
            for slot, n, linked in zip(slots, chars, links):
                if slot and n > 0:
                    for at, gap in enumerate(slot):
                        old = out.setdefault((host, *gap), [0, 0, 0])
                        old[2 * at] += n
                        old[1] += 0 if at else linked

        def make(out):
            values = [*([k[i] for k in out] for i in range(3)), *([v[k] for v in out.values()] for k in range(3))]
            kinds = [pa.string(), *[pa.int64()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(values, kinds)],
                                              ["host", "class", "place", "chars", "links", "held"])

        yield from grouped(batches, 5, make, add, template=4)

    rows = events.join(per_host(found), "host").select("host", "tokens", "chars", "links", "template")
    rows = rows.mapInArrow(run, "host string, class long, place long, chars long, links long, held long")
    gaps = rows.groupBy("host", "class", "place").agg(*(F.sum(c).alias(c) for c in ("chars", "links", "held")))
    linked = F.col("links") > LINKED * F.col("chars")
    gaps = written(gaps.withColumn("linked", linked).withColumn("prose", F.when(linked, 0).otherwise(F.col("held"))), "page-gaps")
    most = gaps.groupBy("host").agg(F.max(F.struct("prose", "class", "place")).alias("most"))
    same = (F.col("class") == F.col("most.class")) & (F.col("place") == F.col("most.place"))
    return gaps.join(most, "host").groupBy("host").agg(
        F.collect_list(F.struct("class", "place", "linked", same.alias("richest"))).alias("marks"))


def main_text(page: str, template: Template) -> str:
    """Main text of a page by the template of its host and its marks."""
    blocks, events = parsed(page)
    slots = template.walk([t for t, _ in events])[0] if template.size else None
    left = []
    for at, (_, k) in enumerate(events):
        if k < 0:
            continue
        around, text, linked = blocks[k]
        if around and around[-1].outside:
            continue
        inside = bool(around) and around[-1].inside
        if slots is None:
            if linked > LINKED * len(text) and not inside:
                continue
        elif not inside:
            if slots[at] is None:  # a text of the template
                continue
            gap, once = slots[at]
            marks = template.marks or {}
            if marks.get(gap, (False, False))[0] or gap[0] in template.repeats and not marks.get(once, (False, False))[1]:
                continue
        left.append((inside, text))
    return "\n".join(text for _, text in [x for x in left if x[0]] or left)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row per page."""
    events = written(events_of(pages), "page-events")
    found = template_of(events)
    shapes = per_host(found).join(slot_marks(events, found), "host", "left")
    shapes = written(shapes, "templates")

    def run(batches):
        kept: dict = {}
        for batch in batches:
            texts = []
            for host, page, template, marks in zip(*(batch.column(k).to_pylist() for k in (2, 3)), batch.column(4), batch.column(5)):
                shape = kept_template(kept, host, template)
                if shape.marks is None:
                    shape.marks = {(m["class"], m["place"]): (m["linked"], m["richest"]) for m in marks.as_py() or []}
                texts.append(main_text(page or "", shape))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["page_id", "url", "text"])

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), "html")
    joined = slim.join(shapes, "host", "left").select("page_id", "url", "host", "html", "template", "marks")
    return joined.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
