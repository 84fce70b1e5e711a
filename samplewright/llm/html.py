"""Main text of web pages by wrappers inferred for each host.

A page's token stream (balanced, inline marks left out) is brought to a skeleton: runs of like elements become one repeated
group. Skeletons of one host are aligned one after the other; elements that only some have become optional, elements that
recur become repeated, text becomes a slot. The result is a regular expression without unions, the host's wrapper. Its
region with the article is found from the wrapper and the text in its slots, and each page's slots below it are read out.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samplewright.llm.common import bounded_batches, written

# Skeletons of a host that one task aligns; more of them are aligned in rounds.
GROUP = 256
# Levels of elements that wrappers have; the text of deeper ones belongs to their last level there. Trees have any depth.
LEVELS = 2000
# Items on one level up to which their classes tell them apart. Beyond, a level's elements are told apart by name only, and
# their signatures in wrappers and paths are the name and ``BY_NAME``.
WIDEST = 200
BY_NAME = ".*"
# Bytes of the wrapper table up to which it is sent to all tasks; a larger one is joined.
BROADCAST_BYTES = 8 << 20

# Kinds of elements (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong "
    "sub sup time tt u var wbr".split())
BOILERPLATE = frozenset(
    "nav header footer aside form script style noscript iframe template button select textarea input svg canvas dialog menu object "
    "embed head title audio video map".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent notice notices alert popup modal sidebar "
    "menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus share sharing social "
    "related recommended newsletter subscribe signup login pagination pager widget toolbar".split())
# Words that say where or how an element stands; with them alone beside it, a word above still names the whole element.
PLACE_WORDS = frozenset(
    "site page global main primary secondary top bottom left right upper lower inner outer first last box block area section region zone wrap "
    "wrapper container holder content body group list item items link links bar row col column cell panel unit slot frame post posts article "
    "articles story stories button buttons icon icons text title head heading label form user reader desktop mobile sticky fixed js x".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split())
# An element that begins ends an open one of these kinds within the given scope.
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
            "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead tr td th", "table")}

# A quote opens a value right after the equals sign only; anywhere else it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
NAMED = frozenset(("class", "id", "role", "itemprop", "hidden", "aria-hidden"))
SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1 << 16)
def _names_boilerplate(token: str) -> bool:
    """Whether a class or id names boilerplate as a whole: ``sidebar`` and ``sidebar-left`` do, ``share-price`` does not."""
    words = set(re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())) - {""}
    return bool(words & BOILERPLATE_WORDS) and words <= BOILERPLATE_WORDS | PLACE_WORDS


class Node:
    """An element: its name, its signature (name, class and role), whether it is boilerplate by itself, its children.

    ``word`` says that a word of its class or id names boilerplate, which ``_settle`` weighs against what the element holds.
    """

    __slots__ = ("tag", "sig", "drop", "word", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.sig, self.children = tag, tag, []
        self.drop, self.word = tag in BOILERPLATE, False
        if attributes and ("=" in attributes or "hidden" in attributes):
            named = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMED}
            self.word = any(_names_boilerplate(token) for k in ("class", "id") for token in named.get(k, "").split())
            self.drop |= named.get("role", "").lower() in BOILERPLATE_ROLES or "hidden" in named or named.get("aria-hidden") == "true"
            mark = re.sub(r"\d+", "0", named.get("class") or named.get("id") or "")
            role = named.get("role") or named.get("itemprop") or ""
            # a slash parts the steps of a path
            self.sig = (tag + ("." + ".".join(sorted(mark.split())) if mark.strip() else "") + (f"@{role}" if role else "")).replace("/", "|")


def parse(text: str) -> Node:
    """A tree from any text: unclosed elements end where the next of their kind or their parent does, stray ends are ignored."""
    root = Node("#root")
    stack, at, words = [root], 0, False
    size = len(text)
    opened: dict[str, int] = {}  # open elements by name

    def add(piece: str) -> None:
        if piece:
            stack[-1].children.append(piece)

    def end_from(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < size:
        begin = text.find("<", at)
        if begin < 0:
            add(text[at:])
            break
        m = TOKEN.match(text, begin)
        if m is None:  # a lone bracket is text
            add(text[at:begin + 1])
            at = begin + 1
            continue
        add(text[at:begin])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1 if opened.get(name) else 0, 0, -1):
                if stack[k].tag == name:
                    end_from(k)
                    break
                # an inline end mark does not reach over a block
                if name in INLINE and stack[k].tag not in INLINE:
                    break
            continue
        kinds, scope = (x.split() for x in SIBLINGS.get(name, ("", "")))
        if any(opened.get(kind) for kind in (*kinds, *(("p",) if name in CLOSES_P else ()))):
            for k in range(len(stack) - 1, 0, -1):
                tag = stack[k].tag
                if tag == "p" and name in CLOSES_P or tag in kinds:
                    end_from(k)
                    if tag == "p" or not any(map(opened.get, kinds)):
                        break
                elif tag in scope or tag not in INLINE and name in CLOSES_P:
                    break
        node = Node(name, m[3])
        stack[-1].children.append(node)
        words |= node.word
        if name in RAW:
            end = re.compile(rf"</{name}\s*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else size
        elif name not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    if words:
        _settle(root)
    return root


def _settle(root: Node) -> None:
    """Drop the elements that a word of their class or id names as boilerplate, unless they hold the page's own text.

    Words like ``has-sidebar`` also stand at what is around the article. So these stay: html, body, main and any article outside
    another one; what holds html, body or main; what holds the longest article, as its only one or with most of the page's
    plain text; and, where no other main or article has text, what holds most of the plain text.
    """
    # elements in page order; those inside element i have the numbers from i + 1 to last[i]
    nodes: list[Node] = []
    above: list[int] = []
    plain: list[int] = []
    in_article: list[bool] = []
    stack = [(root, -1, False, False)]
    while stack:
        node, up, link, inside = stack.pop()
        i = len(nodes)
        nodes.append(node)
        above.append(up)
        in_article.append(inside)
        plain.append(0 if link else sum(len(child.strip()) for child in node.children if isinstance(child, str)))
        for child in reversed(node.children):
            if not isinstance(child, str) and not child.drop:
                stack.append((child, i, link or child.tag == "a", inside or node.tag == "article"))
    last = list(range(len(nodes)))
    core = [node.tag in ("html", "body", "main") for node in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        plain[above[i]] += plain[i]
        last[above[i]] = max(last[above[i]], last[i])
        core[above[i]] |= core[i]
    articles = [i for i, node in enumerate(nodes) if node.tag == "article" and not in_article[i]]
    marks = articles + [i for i, node in enumerate(nodes) if node.tag == "main"]
    stay = {i for i, holds in enumerate(core) if holds} | set(articles)
    longest = max(articles, key=plain.__getitem__, default=None)
    total = plain[0]

    def holds(i: int, j: int) -> bool:
        return i < j <= last[i]

    def reaches(i: int, article: int) -> bool:
        """Whether an element holds an article and no other named element in between does."""
        j = above[article] if holds(i, article) else -1
        while j > i and (not nodes[j].word or j in stay):
            j = above[j]
        return j == i

    named = [i for i, node in enumerate(nodes) if node.word]
    for i in reversed(named):
        most = 2 * plain[i] > total
        # articles in a named element further in are its own
        if longest is not None and holds(i, longest) and (most or sum(reaches(i, a) for a in articles) <= 1):
            stay.add(i)
        if most and not any(plain[m] and m != i and not holds(i, m) and not holds(m, i) for m in marks):
            stay.add(i)
    for i in named:
        nodes[i].drop = i not in stay


# ---- skeletons and wrappers: [signature, repeated, optional, items]; the signature "#" is a text slot, "*" a repeated group


def _key(item: list):
    return tuple(_key(i) for i in item[3]) if item[0] == "*" else item[0]


def _merge(a: list, b: list) -> list:
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3])]


def _fold(items: list[list]) -> list[list]:
    """Runs of like items, and of like groups of up to four items, become one repeated item."""
    for width in range(1, 5):
        out, at = [], 0
        while at < len(items):
            block = items[at:at + width]
            keys = [_key(i) for i in block]
            stop = at + width
            while len(block) == width and [_key(i) for i in items[stop:stop + width]] == keys:
                block = [_merge(x, y) for x, y in zip(block, items[stop:stop + width])]
                stop += width
            if stop > at + width:
                out.append([block[0][0], True, block[0][2], block[0][3]] if width == 1 else ["*", True, False, block])
                at = stop
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def align(left: list[list], right: list[list]) -> list[list]:
    """One sequence for both: common items merged in order, others optional."""
    if _is_narrow(left) or _is_narrow(right):
        return _by_name([*left, *right])
    a, b = [_key(i) for i in left], [_key(i) for i in right]
    if a == b:
        return [_merge(x, y) for x, y in zip(left, right)]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(_merge(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([left[i][0], left[i][1], True, left[i][3]])
            i += 1
        else:
            out.append([right[j][0], right[j][1], True, right[j][3]])
            j += 1
    return _narrowed(_fold(out))


def _flat(items: list[list]) -> Iterator[list]:
    """The items with those of repeated groups in place of the groups."""
    for item in items:
        if item[0] == "*":
            yield from _flat(item[3])
        else:
            yield item


def _named(sig: str) -> str:
    return sig if sig == "#" else re.split(r"[.@]", sig, maxsplit=1)[0] + BY_NAME


def _is_narrow(items: list[list]) -> bool:
    return any(item[0].endswith(BY_NAME) for item in items)


def _by_name(items: list[list]) -> list[list]:
    """One repeated item for each name."""
    out: dict[str, list] = {}
    for sig, _, _, inner in _flat(items):
        name = _named(sig)
        out[name] = [name, True, True, align(out[name][3], inner) if name in out else inner]
    return list(out.values())


def _narrowed(items: list[list]) -> list[list]:
    """A level with more than ``WIDEST`` items, as random class names make, is reduced to names; what is aligned with it later, too."""
    return _by_name(items) if len(items) > WIDEST else items


def skeleton(node: Node) -> list[list]:
    """Items of an element: blocks with their items, and one slot for each stretch of text and inline marks."""
    items: list[list] = []
    # open elements: what is left of their children, their items (an inline mark's are those around it) and signature
    stack = [(iter(node.children), items, None)]
    depth = 0
    while True:
        left, inside, sig = stack[-1]
        child = next(left, None)
        if child is None:
            stack.pop()
            if not stack:
                return _fold(items)
            if sig is not None:
                depth -= 1
                stack[-1][1].append([sig, False, False, _fold(inside)])
        elif isinstance(child, str):
            if not child.isspace() and (not inside or inside[-1][0] != "#"):
                inside.append(["#", False, False, []])
        elif child.tag in INLINE:
            stack.append((iter(child.children), inside, None))
        elif child.tag not in RAW and child.tag not in VOID and depth < LEVELS:
            depth += 1
            stack.append((iter(child.children), [], child.sig))


def infer(skeletons: list[str]) -> str:
    """The wrapper that fits all given skeletons or wrappers."""
    # aligning goes down level by level
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10 * LEVELS))
    wrapper = None
    for text in sorted(set(skeletons)):
        wrapper = json.loads(text) if wrapper is None else align(wrapper, json.loads(text))
    return json.dumps(wrapper or [])


def masses(root: Node) -> list[tuple[str, int, int, int]]:
    """For every path of blocks with text outside boilerplate: the path, its characters, those in links, a hash of the text."""
    out: dict[str, list] = {}
    stack = [(iter(root.children), "", False, 0)]
    while stack:
        left, path, link, depth = stack[-1]
        child = next(left, None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            if not child.isspace():
                entry = out.setdefault(path, [0, 0, 0])
                n = len(child.strip())
                entry[0] += n
                entry[1] += n if link else 0
                entry[2] = zlib.crc32(child.encode("utf-8", "replace"), entry[2])
        elif not child.drop:
            deeper = child.tag not in INLINE and depth < LEVELS
            stack.append((iter(child.children), f"{path}/{child.sig}" if deeper else path, link or child.tag == "a", depth + deeper))
    return [(path, *entry) for path, entry in out.items()]


def levels(items: list[list], above: str = "") -> Iterator[tuple[str, bool]]:
    """Paths of a wrapper and of all its elements, and whether the elements one level below each are told apart by name only."""
    stack = [(items, above)]
    while stack:
        items, above = stack.pop()
        flat = list(_flat(items))
        narrow = _is_narrow(flat)
        yield above, narrow
        inner: dict[str, list] = {}
        for sig, _, _, below in flat:
            if sig != "#":
                inner.setdefault(_named(sig) if narrow else sig, []).extend(below)
        stack.extend((below, f"{above}/{sig}") for sig, below in reversed(inner.items()))


def narrow_path(path: str, narrow: set[str]) -> str:
    """The wrapper's path for one of a page; ``narrow`` holds the paths below which elements are told apart by name only."""
    out = ""
    for sig in path.split("/")[1:]:
        out += "/" + (_named(sig) if out in narrow else sig)
    return out


def _name(path: str) -> str:
    return re.split(r"[.@]", path.rsplit("/", 1)[1], maxsplit=1)[0]


def region(wrapper: str, text: list[tuple[str, int, int, bool]]) -> str:
    """Path of the wrapper's element that holds the article.

    ``text`` has, by path, characters, characters in links and whether the text differs between pages. Elements made for
    articles come first if they hold most of what could be one; else it is the innermost element that holds nine tenths of the plain text, where text that never
    differs counts little.
    """
    shape = list(levels(json.loads(wrapper)))
    narrow = {path for path, by_name in shape if by_name}
    sums: dict[str, float] = {}
    for path, chars, links, varies in text:
        mass = max(0, chars - 2 * links) * (1.0 if varies else 0.1)
        at = narrow_path(path, narrow)
        while True:
            sums[at] = sums.get(at, 0.0) + mass
            if not at:
                break
            at = at[:at.rindex("/")]

    def below(path: str) -> float:
        return sums.get(path, 0.0)

    known = [p for p, _ in shape if p and below(p) > 0]
    total = below("")
    mains = [p for p in known if _name(p) == "main" or p.endswith("@main")]
    for test in (lambda p: p.endswith("@articleBody"), lambda p: _name(p) == "article", mains.__contains__):
        fit = [p for p in known if test(p)]
        if fit:
            best = max(fit, key=lambda p: (below(p), -len(p)))
            # cards with other stories' titles are articles too: the article is at least half of any main element around or beside it
            if best in mains or 2 * below(best) >= max((below(m) for m in mains if not m.startswith(best + "/")), default=0.0):
                return best
    rest = [p for p in known if below(p) >= 0.9 * total]
    holders = [p for p in rest if _name(p) not in HEADINGS | {"p", "li", "td", "pre", "blockquote"}]
    return max(holders or [""], key=lambda p: p.count("/"))


def read_out(root: Node, path: str) -> str:
    """Blocks of text in the elements at ``path``, or in the page's own region where it has none there."""
    found: list[Node] = []
    steps = path.split("/")[1:] if path else []
    ways = [(root, 0)]
    while ways:
        node, done = ways.pop()
        if done == len(steps):
            found.append(node)
            continue
        for child in reversed(node.children):
            if not isinstance(child, str):
                if child.tag in INLINE:
                    ways.append((child, done))
                elif steps[done] in (child.sig, child.tag + BY_NAME):
                    ways.append((child, done + 1))
    if not found:
        return read_out(root, region(json.dumps(skeleton(root)), [(p, c, n, True) for p, c, n, _ in masses(root)]))
    blocks: list[str] = []
    current: list[str] = []

    def close() -> None:
        text = SPACE.sub(" ", entities.unescape("".join(current))).strip()
        if text:
            blocks.append(text)
        current.clear()

    for node in found:
        # what is still to be read, the next last: text, elements, and None where a block ends
        ahead = [(child, False) for child in reversed(node.children)]
        while ahead:
            child, only_headings = ahead.pop()
            if child is None:
                close()
            elif isinstance(child, str):
                if not only_headings:
                    current.append(child)
            elif child.tag == "br":
                current.append(" ")
            elif child.drop and child.tag != "header":
                if child.tag not in INLINE:
                    close()
            else:
                if child.tag not in INLINE:
                    close()
                    ahead.append((None, False))
                only_headings = child.tag == "header" or only_headings and child.tag not in HEADINGS
                ahead.extend((inner, only_headings) for inner in reversed(child.children))
        close()
    return "\n".join(blocks)


# ---- on tables


def _host():
    return F.lower(F.coalesce(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), _host().alias("host"))


def path_sums(outlined: DataFrame, merged: DataFrame) -> DataFrame:
    """``host, path, chars, links, varies``: text of all pages summed up by the paths of their host's wrapper.

    Pages' paths are the wrapper's but below narrowed levels, where each page can have paths of its own.
    """
    def summed(rows: DataFrame) -> DataFrame:
        return rows.groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[p for p, by_name in levels(json.loads(w)) if by_name] for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(found, type=pa.list_(pa.string()))], names=["host", "narrow"])

    text = outlined.select("host", F.explode("text").alias("t")).select(
        "host", "t.path", "t.chars", "t.links", F.col("t.hash").alias("lo"), F.col("t.hash").alias("hi"))
    text = summed(text)
    narrow = written(merged.select("host", "wrapper").mapInArrow(find, "host string, narrow array<string>").where(F.size("narrow") > 0), "narrow")
    size = narrow.agg(F.sum(F.octet_length("host") + F.octet_length(F.concat_ws(" ", "narrow")) + 32)).first()[0] or 0
    if size:
        # as in narrow_path
        step = F.aggregate(F.slice(F.split("path", "/"), 2, 1 << 20), F.lit(""), lambda out, sig: F.concat(
            out, F.lit("/"), F.when(F.array_contains("narrow", out), F.concat(F.regexp_extract(sig, "^[^.@]*", 0), F.lit(BY_NAME))).otherwise(sig)))
        text = text.join(F.broadcast(narrow) if size <= BROADCAST_BYTES else narrow, "host", "left")
        text = summed(text.withColumn("path", F.when(F.col("narrow").isNull(), F.col("path")).otherwise(step)))
    return text.select("host", "path", "chars", "links", (F.col("lo") != F.col("hi")).alias("varies"))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper, region`` of every host.

    Only distinct skeletons are gathered, at most about ``GROUP`` in one task: a host with more is aligned in rounds. Text is
    summed up by the wrapper's paths, so what is gathered of a host's text is no longer than its wrapper.
    """
    bounded_batches(pages.sparkSession)

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("html").to_pylist():
                root = parse(text)
                rows.append((json.dumps(skeleton(root)), [{"path": p, "chars": c, "links": n, "hash": h} for p, c, n, h in masses(root)]))
            kind = pa.list_(pa.struct([("path", pa.string()), ("chars", pa.int64()), ("links", pa.int64()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([r[0] for r in rows], type=pa.string()),
                                              pa.array([r[1] for r in rows], type=kind)], names=["host", "wrapper", "text"])

    outlined = written(_pages(pages).select("host", "html").mapInArrow(
        outline, "host string, wrapper string, text array<struct<path: string, chars: bigint, links: bigint, hash: bigint>>"), "outlines")
    now = outlined.select("host", "wrapper").distinct()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [infer(group["wrapper"].to_list())]})

    while True:
        now = written(now, "wrappers")
        most = now.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        salts = -(-most // GROUP)
        now = now.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(max(1, salts)))).groupBy("host", "salt").applyInPandas(
            merge, "host string, wrapper string")
        if salts <= 1:
            break

    now = written(now, "merged")
    by_host = path_sums(outlined, now).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("path", "chars", "links", "varies"))).alias("text"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [region(w, [tuple(t.values()) for t in text or []]) for w, text in zip(
                batch.column("wrapper").to_pylist(), batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("wrapper"), pa.array(found, type=pa.string())],
                                             names=["host", "wrapper", "region"])

    return now.join(by_host, "host", "left").select("host", "wrapper", "text").mapInArrow(place, "host string, wrapper string, region string")


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    The text has the article's blocks in page order, one a line, with character references decoded and white space inside a
    block made one space. A page without an article's text, an empty or null page has an empty text. Pages without a host
    share one wrapper; null and repeated ids and further columns do not matter.
    """
    found = written(wrappers(pages).select("host", "region"), "regions")
    size = found.agg(F.sum(F.octet_length("host") + F.octet_length("region") + 32)).first()[0] or 0
    rows = _pages(pages)
    joined = rows.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_out(parse(h), r or "") if h else "" for h, r in zip(batch.column("html").to_pylist(), batch.column("region").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, type=pa.string()),
                                              pa.array([len(t) for t in texts], type=pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "region").mapInArrow(run, "page_id long, url string, text string, n_chars long")
