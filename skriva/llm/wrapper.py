"""HTML main-text extraction by wrapper induction.

Every page is parsed into blocks of text and a skeleton: the tree of its block elements, keyed by tag and class, with like siblings
folded into one node. Skeletons of one site (a host's pages that begin with the same framing element) are merged by simple tree matching into the site's
wrapper, and every skeleton is aligned with it, so each wrapper node stands for one slot of all the site's pages. Statistics over all
different pages then tell constant nodes (a text that stands in its slot on most pages and in most layouts: template) from varying ones
(content). An article or main element that holds text bounds the content; else all varying slots of the page are content.

Menus, headers, footers, sidebars, adverts, forms, cookie notices and reader comments that their tag, role or a whole class name tells never
count. Class names that may as well name a part of an article (related, social, notice, ...) exclude a zone outside an article only; below one the
wrapper must find the slot constant. Headings in an article are never template.

Only distinct skeletons are aligned, in groups of at most FAN trees per task, level by level, so a host with a third of all
pages costs no more than its distinct layouts, and its frames are separate tasks. Statistics are plain aggregates. The html itself is never
shuffled while the roles of all (site, skeleton) pairs are measured small enough to broadcast.

Edge cases: null or blank html gives an empty text of 0 characters; a url without host puts the page in the host ''; unclosed
elements end with their parent, an unclosed comment, script, style or textarea with the page; an svg, video, title or the like that is never
closed hides nothing; elements nested deeper than DEPTH count to their ancestor there (their text stays); pages whose content slots are
all empty fall back to everything outside the excluded zones, and then to the text of zones known by their class or id only; where
a site's pages are mere copies of one article (less than a tenth of the text varies), constancy marks nothing. Repeated pages are treated row by row.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, measured, table

DEPTH, FAN = 48, 64
TAG = re.compile(
    r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"']*+)|[\"'])*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
#: One attribute after the other, each with its value, so that a name is never looked for inside a value or another name.
ATTRIBUTE = re.compile(r"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
#: What a tag that hides its element holds somewhere.
HIDES = re.compile("hidden|display", re.I)
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea".split())
#: Inline elements without text of the page; what is never closed hides nothing.
UNSEEN = frozenset("title template iframe svg select option optgroup datalist button canvas audio video".split())
NEVER = frozenset("nav footer aside form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup"
    " hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCK - frozenset("html body head td th tr tbody thead tfoot caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that frame a page.
FRAME = frozenset("article center div main section table".split())
#: Opening one of these ends an open one of the second, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
# Words in class or id, and roles, that mark an excluded zone; the second ones may name a part of an article as well.
SURE = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adsbygoogle breadcrumb breadcrumbs comment comments"
    " disqus footer nav navbar navigation pagination sidebar".split())
MAYBE = frozenset(
    "banner consent cookie cookies form gdpr header login masthead menu modal newsletter notice notices notification notifications pager popup promo promoted related respond search"
    " share sharing signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that say nothing of their own beside those.
PLAIN = frozenset(
    "area article articles bar block body bottom box btn button buttons center close col collapse column container desktop fixed full global group icon icons info inner"
    " item items large law left link links list main message mini mobile module outer overlay page panel policy post posts primary reader region right row secondary"
    " section site slot small sticky stories story tablet text thread toggle toggler top trail unit user users width wrap wrapper zone".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = re.compile(r"[a-z]+")
NOT_WORDS = re.compile(r"[^\W\d_a-z]")
CONTENT = frozenset(["article", "main"])
WHOLE = frozenset(["html", "body", *CONTENT])
#: Words that name a part of an article as well as one of the page.
HEADS = frozenset("header masthead banner".split())
#: How an element is excluded: not, perhaps (if its slot is constant), by the words of its class or id (its text stands in if
#: nothing else does), or for good.
IN, PERHAPS, WORDED, OUT = 0, 1, 2, 3


def marks(value: str, article: bool) -> int:
    """What the words of a class or id mark. A name counts as a whole: all of its words must be known."""
    found = IN
    for token in value.split():
        words = frozenset(WORDS.findall(token))
        told = words & (SURE | MAYBE)
        if not told or not words <= SURE | MAYBE | PLAIN or NOT_WORDS.search(token):
            continue
        if article:
            told -= HEADS
        if told & SURE or (told and not article):
            return WORDED
        if told:
            found = PERHAPS
    return found


def attributes(rest: str) -> dict[str, str]:
    """Lower-case names and values of a tag's attributes; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def unseen(found: dict[str, str]) -> bool:
    """Whether the attributes hide their element."""
    return "hidden" in found or "display:none" in found.get("style", "").replace(" ", "")


def read_attributes(rest: str, article: bool = False) -> tuple[str, int]:
    """The class words (for the node's key) and whether the element is an excluded zone; article: whether it is inside one."""
    found = attributes(rest)
    if unseen(found) or found.get("role") in ROLES:
        out = OUT
    else:
        out = max(marks(found.get("class", ""), article), marks(found.get("id", ""), article))
    return ".".join(re.sub(r"\d+", "#", n) for n in sorted(set(found.get("class", "").split()))), out


class Page:
    """The blocks (node, text) outside excluded zones, and the skeleton: parents and keys of its nodes. The key of a node that is
    perhaps excluded ends in "?"."""

    def __init__(self, source: str | None):
        self.parents, self.keys = [-1], ["#"]
        self.children: list[dict[str, int]] = [{}]
        self.blocks: list[tuple[int, str]] = []
        self.text: list[str] = []
        # The text of zones excluded by their words alone.
        self.spare: list[str] = []
        self.content = False
        # Open elements: tag, node, excluded, inside an article; and how many of a tag are open.
        self.stack: list[tuple[str, int, int, bool]] = [("#", 0, IN, False)]
        self.opened: dict[str, int] = {}
        # Where the next end tag of a name stands.
        self.ends: dict[str, int] = {}
        if source:
            self.parse(source)
        self.flush()
        if not self.blocks:
            self.blocks = [(0, t) for t in self.spare]

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words and self.stack[-1][2] == WORDED:
                self.spare.append(words)
            elif words:
                self.blocks.append((self.stack[-1][1], words))
            self.text = []

    def parse(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = TAG.search(source, at)
            if m is None:
                self.say(source[at:])
                return
            if m.start() > at:
                self.say(source[at : m.start()])
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                self.close(name)
            elif name in RAW:
                self.text.append(" ")
                at = self.end_of(source, name, at)[1]
            elif name in VOID or (m[3].endswith("/") and name not in BLOCK):
                if name in BLOCK:
                    self.flush()
                elif name == "br":
                    self.text.append(" ")
            elif name in BLOCK:
                self.open(name, m[3])
            elif name in UNSEEN:
                if self.end_of(source, name, at)[0] < size:  # it ends with its parent at the latest
                    self.text.append(" ")
                    self.push(name, self.stack[-1][1], OUT)
            else:
                self.inline(name, m[3])

    def end_of(self, source: str, name: str, at: int) -> tuple[int, int]:
        """Where the next end tag of this name begins and ends; the end of the page if there is none. Found once for all before it."""
        start, behind = self.ends.get(name, (-1, -1))
        if start < at:
            m = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            start, behind = self.ends[name] = m.span() if m else (len(source), len(source))
        return start, behind

    def say(self, text: str) -> None:
        if self.stack[-1][0] == "head" and text.strip():  # its end tag may be left out
            self.pop_to(len(self.stack) - 1)
        if self.stack[-1][2] != OUT:
            self.text.append(html.unescape(text) if "&" in text else text)

    def push(self, name: str, node: int, out: int) -> None:
        self.stack.append((name, node, out, self.stack[-1][3] or name in CONTENT))
        self.opened[name] = self.opened.get(name, 0) + 1

    def pop_to(self, i: int) -> None:
        for name, *_ in self.stack[i:]:
            self.opened[name] -= 1
        del self.stack[i:]

    def inline(self, name: str, rest: str) -> None:
        """Inline elements make no node, and their names tell nothing; only a hidden one must be followed to its end."""
        if self.stack[-1][0] == "head" and name != "noscript":
            self.pop_to(len(self.stack) - 1)
        if HIDES.search(rest) and self.stack[-1][2] != OUT and unseen(attributes(rest)):
            self.push(name, self.stack[-1][1], OUT)

    def open(self, name: str, rest: str) -> None:
        self.flush()
        if self.stack[-1][0] == "head":
            self.pop_to(len(self.stack) - 1)
        if name in ENDS_P:
            self.end_implied({"p"}, BLOCK - {"p"})
        if name in IMPLIED:
            self.end_implied(*IMPLIED[name])
        _, parent, out, inside = self.stack[-1]
        names, chrome = read_attributes(rest, inside) if rest else ("", IN)
        if name in WHOLE and chrome in (PERHAPS, WORDED) and not set(names.split(".")) & SURE:  # class and id say more of these than what they are
            chrome = IN
        if name in CONTENT and out == WORDED and chrome == IN and (name == "main" or not self.content):
            out = IN  # what holds the page's main or first article is no zone; later articles may be comments
        if name == "header" and not inside:  # a header inside an article may hold its headline
            chrome = OUT
        perhaps, chrome = chrome == PERHAPS, IN if chrome == PERHAPS else chrome
        out = max(out, chrome, OUT if name in NEVER or name == "head" else IN)
        self.content |= name in CONTENT and out == IN
        node = parent
        if not out and len(self.stack) <= DEPTH:
            key = (f"{name}.{names}" if names else name) + "?" * perhaps
            node = self.children[parent].get(key)
            if node is None:
                node = self.children[parent][key] = len(self.keys)
                self.parents.append(parent)
                self.keys.append(key)
                self.children.append({})
        self.push(name, node, out)

    def end_implied(self, names: set[str], stop: set[str] | frozenset[str]) -> None:
        if not any(self.opened.get(n) for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag in names:
                self.pop_to(i)
                return
            if tag in stop:
                return

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        if not self.opened.get(name):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                if name in BLOCK:
                    self.flush()
                else:
                    self.text.append(" ")
                self.pop_to(i)
                return
            if name not in BLOCK and self.stack[i][0] in BLOCK:
                return

    def skeleton(self) -> str:
        return json.dumps([self.parents, self.keys], separators=(",", ":"))

    def frame(self) -> str:
        """The key of the first element that frames the page."""
        return next((k for k in self.keys if re.split(r"[.?]", k)[0] in FRAME), "")


def skeleton_hash(skeleton: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(skeleton.encode()), "big", signed=True)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


# --- Simple tree matching -------------------------------------------------------------------------------------------------


def kids(parents: list[int]) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in parents]
    for i, p in enumerate(parents):
        if p >= 0:
            out[p].append(i)
    return out


def match(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> dict[int, int]:
    """The largest order-preserving top-down match of two trees: node of b -> node of a. Roots always match."""
    (ka, kb), (la, lb) = (kids(a[0]), kids(b[0])), (a[1], b[1])
    memo: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def best(x: int, y: int) -> tuple[int, list[tuple[int, int]]]:
        """Matched nodes below and with x and y, and the chosen pairs of children."""
        found = memo.get((x, y))
        if found is None:
            cx, cy = ka[x], kb[y]
            m = [[0] * (len(cy) + 1) for _ in range(len(cx) + 1)]
            for i, u in enumerate(cx):
                for j, v in enumerate(cy):
                    w = best(u, v)[0] if la[u] == lb[v] else 0
                    m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + w if w else 0)
            i, j, pairs = len(cx), len(cy), []
            while i and j:
                if m[i][j] == m[i - 1][j]:
                    i -= 1
                elif m[i][j] == m[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((cx[i], cy[j]))
            found = memo[x, y] = (1 + m[-1][-1], pairs)
        return found

    out, todo = {0: 0}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        for u, v in best(x, y)[1]:
            out[v] = u
            todo.append((u, v))
    return out


def merge(a: tuple[list[int], list[str]], b: tuple[list[int], list[str]]) -> list[int]:
    """Add to a (in place) the nodes of b that match none of its own; returns the node of a for each node of b."""
    found = match(a, b)
    for v in range(1, len(b[0])):  # parents come before children
        if v not in found:
            found[v] = len(a[0])
            a[0].append(found[b[0][v]])
            a[1].append(b[1][v])
    return [found[v] for v in range(len(b[0]))]


def fold(group: pd.DataFrame) -> pd.DataFrame:
    """Merge the trees of one group (host, frame, part) into one; the most frequent ones come first."""
    group = group.sort_values(["n", "tree_hash"], ascending=[False, True])
    trees = [json.loads(t) for t in group["tree"]]
    whole = (list(trees[0][0]), list(trees[0][1]))
    for t in trees[1:]:
        merge(whole, (t[0], t[1]))
    text = json.dumps([whole[0], whole[1]], separators=(",", ":"))
    return pd.DataFrame({"host": [group["host"].iloc[0]], "frame": [group["frame"].iloc[0]], "tree_hash": [skeleton_hash(text)], "tree": [text], "n": [group["n"].sum()]})


SITE = ["host", "frame"]


def words_of(key: str) -> list[str]:
    """The class words of a node's key."""
    return [w for w in key.rstrip("?").split(".")[1:] if w]


def reduced(tree: tuple[list[int], list[str]], rare: frozenset[str]) -> tuple[list[int], list[str], list[int]]:
    """A tree without the rare class words: its parents and keys, like siblings folded, and the new node of each old one."""
    parents, keys, to, children = [-1], [tree[1][0]], [0], [{}]
    for parent, key in zip(tree[0][1:], tree[1][1:], strict=True):
        kept = ".".join([key.rstrip("?").split(".")[0], *(w for w in words_of(key) if w not in rare)]) + "?" * key.endswith("?")
        above = to[parent]
        node = children[above].get(kept)
        if node is None:
            node = children[above][kept] = len(keys)
            parents.append(above)
            keys.append(kept)
            children.append({})
        to.append(node)
    return parents, keys, to


def framed(skeletons: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, frame, tree_hash, tree, n) of skeletons (host, skeleton, tree, frame, n): those of a host whose framing elements agree in tag and class words are one site.
    Words that fewer than one in FAN of the host's layouts have there, such as generated names, do not count."""
    parts = F.split(F.rtrim(F.col("frame"), F.lit("?")), r"\.")
    words = skeletons.select("host", "skeleton", F.explode(F.array_distinct(F.slice(parts, 2, 1 << 30))).alias("word"))
    layouts = skeletons.groupBy("host").agg(F.count("*").alias("layouts"))
    often = words.groupBy("host", "word").agg(F.count("*").alias("k")).join(layouts, "host").where(FAN * F.col("k") >= F.col("layouts")).select("host", "word")
    kept = words.join(often, ["host", "word"]).groupBy("host", "skeleton").agg(F.array_join(F.sort_array(F.collect_list("word")), ".").alias("names"))
    out = skeletons.join(kept, ["host", "skeleton"], "left")
    frame = F.xxhash64(F.get(parts, F.lit(0)), F.coalesce("names", F.lit("")), F.col("frame").endswith("?"))
    return scratch.keep(out.select("host", frame.alias("frame"), F.col("skeleton").alias("tree_hash"), "tree", "n"), "skeletons")


def plainer(skeletons: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, frame, skeleton, tree_hash, tree, to, n): every skeleton (its hash) less the class words that fewer than one in FAN of its site's
    layouts have, such as generated names. As a constant text stands in most layouts, they tell no template; without them a wrapper does not
    grow with its site's layouts. Sites of up to FAN layouts keep all words."""

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = sorted({w for k in json.loads(batch.column("tree")[i].as_py())[1] for w in words_of(k)})
                same = [pa.array([batch.column(c)[i].as_py()] * len(words), batch.column(c).type) for c in (*SITE, "tree_hash")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(words, pa.string())], names=[*SITE, "tree_hash", "word"])

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [reduced(json.loads(t), frozenset(r or ())) for t, r in zip(batch.column("tree").to_pylist(), batch.column("rare").to_pylist(), strict=True)]
            trees = [json.dumps([p, k], separators=(",", ":")) for p, k, _ in made]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*SITE, "tree_hash")), pa.array([skeleton_hash(t) for t in trees], pa.int64()), pa.array(trees, pa.string()), pa.array([to for *_, to in made], pa.list_(pa.int32())),
                 batch.column("n")], names=[*SITE, "skeleton", "tree_hash", "tree", "to", "n"])

    sizes = skeletons.groupBy(*SITE).agg(F.count("*").alias("layouts")).where(F.col("layouts") > FAN)
    large = skeletons.join(sizes, SITE)
    words = large.select(*SITE, "tree_hash", "tree").mapInArrow(exploded, "host string, frame long, tree_hash long, word string")
    words = scratch.keep(words, "words")
    rare = words.groupBy(*SITE, "word").agg(F.count("*").alias("k")).join(sizes, SITE).where(FAN * F.col("k") < F.col("layouts")).select(*SITE, "word")
    # A tree's own words at most.
    own = words.join(rare, [*SITE, "word"]).groupBy(*SITE, "tree_hash").agg(F.collect_list("word").alias("rare"))
    ready = skeletons.join(own, [*SITE, "tree_hash"], "left").select(*SITE, "tree_hash", "tree", "rare", "n")
    out = ready.mapInArrow(without, "host string, frame long, skeleton long, tree_hash long, tree string, to array<int>, n long")
    return scratch.keep(out, "plainer")


def induce(skeletons: DataFrame, scratch: Scratch) -> DataFrame:
    """skeletons: (host, frame, tree_hash, tree, n), distinct. Returns the wrappers (host, frame, tree), one per site."""
    trees, level = skeletons, 0
    while True:
        sizes = trees.groupBy(*SITE).agg(F.count("*").alias("trees"))
        parted = trees.join(sizes, SITE).withColumn("part", F.pmod(F.xxhash64("tree_hash", F.lit(level)), F.ceil(F.col("trees") / FAN)))
        done = parted.groupBy(*SITE, "part").applyInPandas(lambda g: fold(g), "host string, frame long, tree_hash long, tree string, n long")
        # Parts that came to the same tree are one.
        trees = scratch.keep(done.groupBy(*SITE, "tree_hash").agg(F.first("tree").alias("tree"), F.sum("n").alias("n")), f"fold-{level}")
        level += 1
        if trees.groupBy(*SITE).count().where("count > 1").isEmpty():
            return trees.select(*SITE, F.col("tree").alias("wrapper"))


def aligned(rows: DataFrame) -> DataFrame:
    """(host, frame, skeleton, map): of each skeleton (tree) the node of its site's wrapper for every node, -1 where none matches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, whole = None, None
        for batch in batches:
            maps = []
            for wrapper, tree in zip(batch.column("wrapper").to_pylist(), batch.column("tree").to_pylist(), strict=True):
                if wrapper != text:
                    text, whole = wrapper, json.loads(wrapper)
                own = json.loads(tree)
                found = match(whole, own)
                maps.append([found.get(v, -1) for v in range(len(own[0]))])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*SITE, "tree_hash")), pa.array(maps, pa.list_(pa.int32()))], names=[*SITE, "skeleton", "map"])

    return rows.select(*SITE, "tree_hash", "tree", "wrapper").mapInArrow(run, "host string, frame long, skeleton long, map array<int>")


def parsed(pages: DataFrame, texts: bool) -> DataFrame:
    """Per page: page_id, url, host, skeleton (hash), and per block its node and the hash of its text; with ``texts`` the block texts,
    else the blocks' lengths, the tree, the hash of all text and the frame's key."""
    schema = "page_id long, url string, host string, skeleton long, nodes array<int>, hashes array<long>, "
    schema += "texts array<string>" if texts else "chars array<int>, tree string, page long, frame string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                found = [Page(h) for h in part.column("html").to_pylist()]
                trees = [p.skeleton() for p in found]
                lists = lambda of, kind: pa.array([[of(n, t) for n, t in p.blocks] for p in found], pa.list_(kind))
                columns = [
                    part.column("page_id"), part.column("url"), pa.array([host_of(u) for u in part.column("url").to_pylist()]),
                    pa.array([skeleton_hash(t) for t in trees], pa.int64()), lists(lambda n, _: n, pa.int32()), lists(lambda _, t: skeleton_hash(t), pa.int64())]
                if texts:
                    columns.append(lists(lambda _, t: t, pa.string()))
                else:
                    columns += [lists(lambda _, t: len(t), pa.int32()), pa.array(trees), pa.array([skeleton_hash("\n".join(t for _, t in p.blocks)) for p in found], pa.int64()), pa.array([p.frame() for p in found])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def decide(group: pd.DataFrame) -> pd.DataFrame:
    """For each node of one site's wrapper, whether it is content and whether constant texts are template there. From its tree and one row per node: its
    characters on all different pages, and how many of them stand in constant texts (bounded by the tree)."""
    parents, keys = json.loads(group["wrapper"].iloc[0])
    size = len(parents)
    chars, constant = [0] * size, [0] * size
    for node, c, k in zip(group["node"], group["chars"], group["constant"], strict=True):
        if node >= 0:
            chars[int(node)], constant[int(node)] = int(c), int(k)
    below, same = list(chars), list(constant)
    for i in range(size - 1, 0, -1):
        below[parents[i]] += below[i]
        same[parents[i]] += same[i]
    tag = [re.split(r"[.?]", k)[0] for k in keys]

    def under(tops: set[int]) -> set[int]:
        out: set[int] = set()
        for i in range(size):  # parents come before children
            if i in tops or parents[i] in out:
                out.add(i)
        return out

    articles, mains = ({i for i in range(size) if tag[i] == t and below[i]} for t in ("article", "main"))
    nested = {i for i in articles if parents[i] in under(articles)}
    mass = sum(below[i] for i in articles - nested)
    inside = under(articles if articles and (not mains or 2 * mass >= sum(below[i] for i in mains)) else mains or {0})
    whole, varying = sum(chars[i] for i in inside), sum(chars[i] - constant[i] for i in inside)
    if 10 * varying < whole:  # copies of one page: constancy tells nothing
        return pd.DataFrame({"host": [group["host"].iloc[0]], "frame": [group["frame"].iloc[0]], "content": [[i in inside for i in range(size)]], "template": [[False] * size]})
    # What is perhaps no part of the article goes where all it holds is constant.
    gone = under({i for i in inside if keys[i].endswith("?") and same[i] == below[i]})
    articles_ = under(articles | mains)
    template = [i in inside and constant[i] > 0 and not (tag[i] in HEADINGS and i in articles_) for i in range(size)]
    return pd.DataFrame({"host": [group["host"].iloc[0]], "frame": [group["frame"].iloc[0]], "content": [[i in inside and i not in gone for i in range(size)]], "template": [template]})


def extract(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, text, n_chars per row of pages."""
    seen = scratch.keep(parsed(pages, texts=False), "seen")
    # A skeleton settles its frame and, with the host, its site.
    skeletons = seen.groupBy("host", "skeleton").agg(F.min("tree").alias("tree"), F.min("frame").alias("frame"), F.count("*").alias("n"))
    skeletons = framed(scratch.keep(skeletons, "layouts"), scratch)
    plain = plainer(skeletons, scratch)
    trees = scratch.keep(plain.groupBy(*SITE, "tree_hash").agg(F.first("tree").alias("tree"), F.sum("n").alias("n")), "trees")
    wrappers = induce(trees, scratch)
    maps = aligned(trees.join(wrappers, SITE)).withColumnRenamed("skeleton", "tree_hash")
    maps = plain.join(maps, [*SITE, "tree_hash"]).select(*SITE, "skeleton", F.transform("to", lambda i: F.get("map", i)).alias("map"))
    maps = scratch.keep(maps, "maps")
    # Copies of a page count once; (skeleton, page, nodes) settles the other columns.
    blocks = F.arrays_zip("nodes", "hashes", "chars")
    different = seen.groupBy("host", "skeleton", "page", "nodes").agg(F.first(F.array_distinct(blocks)).alias("blocks"))
    slots = different.select("host", "skeleton", F.explode("blocks").alias("x")).groupBy("host", "skeleton", "x").agg(F.count("*").alias("pages"))
    slots = slots.join(maps, ["host", "skeleton"]).select(*SITE, F.get("map", "x.nodes").alias("node"), F.col("x.hashes").alias("hash"), "x.chars", "pages")
    texts = slots.groupBy(*SITE, "node", "hash").agg(F.sum("pages").alias("pages"), F.count("*").alias("layouts"), F.sum(F.col("pages") * F.col("chars")).alias("chars"))
    sizes = different.groupBy("host", "skeleton").agg(F.count("*").alias("n")).join(maps.select(*SITE, "skeleton"), ["host", "skeleton"]).groupBy(*SITE).agg(F.sum("n").alias("all_pages"), F.count("*").alias("all_layouts"))
    texts = texts.join(sizes, SITE).where("node >= 0")
    # On most of the site's different pages and in most of its layouts.
    texts = texts.withColumn("constant", F.expr("pages >= 3 AND 2 * pages > all_pages AND 2 * layouts > all_layouts"))
    texts = scratch.keep(texts.select(*SITE, "node", "hash", "chars", "constant"), "texts")
    stats = texts.groupBy(*SITE, "node").agg(F.sum("chars").alias("chars"), F.sum(F.when(F.col("constant"), F.col("chars")).otherwise(0)).alias("constant"))
    stats = wrappers.join(stats, SITE, "left").select(*SITE, "wrapper", F.coalesce("node", F.lit(-1)).alias("node"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("chars", "constant")))
    decided = stats.groupBy(*SITE).applyInPandas(lambda g: decide(g), "host string, frame long, content array<boolean>, template array<boolean>")
    # A constant text stands on most pages of its site, so a site has no more of them than two of its pages have blocks.
    fixed = texts.where("constant").groupBy(*SITE).agg(F.collect_list(F.struct("node", "hash")).alias("fixed"))
    roles = maps.join(decided, SITE).join(fixed, SITE, "left")
    # For each node of a page's skeleton: does it belong to the content? And which texts in it are template?
    role = F.transform("map", lambda i: F.when(i < 0, F.lit(True)).otherwise(F.get("content", i)))
    here = F.filter(F.coalesce("fixed", F.array().cast("array<struct<node:int,hash:bigint>>")), lambda x: F.get("template", x["node"]) & F.array_contains("map", x["node"]))
    drop = F.transform(here, lambda x: F.struct((F.array_position("map", x["node"]) - 1).cast("int").alias("nodes"), x["hash"].alias("hashes")))
    roles = scratch.keep(roles.select("host", "skeleton", role.alias("role"), drop.alias("drop")), "roles")
    roles = measured(roles, F.size("role") + 16 * F.size("drop") + F.octet_length("host") + 64)
    out = parsed(pages, texts=True).join(roles, ["host", "skeleton"], "left")
    blocks = F.arrays_zip("nodes", "hashes", "texts")
    constant = lambda x: F.array_contains("drop", F.struct(x["nodes"].alias("nodes"), x["hashes"].alias("hashes")))
    chosen = F.filter(blocks, lambda x: F.coalesce(F.get("role", x["nodes"]), F.lit(True)) & ~F.coalesce(constant(x), F.lit(False)))
    out = out.withColumn("__t", F.transform(chosen, lambda x: x["texts"]))
    out = out.withColumn("text", F.array_join(F.when(F.size("__t") > 0, F.col("__t")).otherwise(F.col("texts")), "\n"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages"), Scratch(spark, "op8"))
