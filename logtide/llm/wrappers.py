"""HTML main text by wrapper inference: union-free expressions learned from the pages of a host.

1. Every page becomes a stream of block tags and text slots; runs of equal siblings are folded into one repeated
   group. Inline tags leave no mark, white space and character references are resolved.
2. All pages of a host take part: equal streams are counted together, then a host's streams are aligned
   in a tree of groupings: first within salted parts, then the parts' wrappers with one another. What only
   one side has becomes optional, what follows itself becomes repeated, and every text becomes a slot.
3. Every page's stream is matched to its host's wrapper, which gives each text its slot: a place in the wrapper, not a
   path. Over all pages of the host every slot is measured: how often it occurs, whether its text ever changes, how
   much of it is link text. Slots inside an article or main element are content; elsewhere a slot is
   content if its text changes and is mostly not links. Menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and comments are never content.
4. The texts of a page that lie in content slots of its host's wrapper are its main text.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.session import materialise

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe)\b[^>]*>.*?(?:</\1\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)", re.S)
NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre section "
    "select summary table tbody td textarea tfoot th thead title tr ul button".split())
VOID = frozenset("br hr".split())
#: Tags whose start ends an open element of the named kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
SKIPPED = frozenset("head title nav aside footer form menu dialog button select option textarea fieldset legend".split())
#: Words in class, id or role that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus "
    "footer gdpr header login menu modal nav navbar navigation newsletter notice notification pagination pager popup "
    "promo related replies reply search share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget complementary contentinfo".split())
CONTENT = re.compile(r"/(?:article|main)(?:[./]|$)")


@dataclass
class Node:
    """Part of a wrapper: a block tag or a text slot (``#``), with its repetition and what it holds."""

    label: str
    optional: bool = False
    repeated: bool = False
    parts: list[Node] = field(default_factory=list)

    def write(self) -> str:
        inner = "".join(p.write() for p in self.parts)
        body = f"{self.label}({inner})" if inner else self.label
        return body + ("*" if self.optional and self.repeated else "?" if self.optional else "+" if self.repeated else "") + " "


def read(source: str) -> Iterator[tuple[str, str, int]]:
    """(path, text, characters inside links) of every text block; (path, "", -1) where a block element opens."""
    stack: list[tuple[str, str]] = []
    buffer: list[str] = []
    linked, in_link, at = 0, False, 0

    def path() -> str:
        return "".join("/" + label for _, label in stack)

    def flush() -> Iterator[tuple[str, str, int]]:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            yield path(), text, linked
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        buffer.append(piece)
        if in_link:
            linked += len(piece)

    for m in TOKEN.finditer(source):
        if m.start() > at:
            take(source[at:m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if tag == "a":
            in_link = not m[2]
        if tag in VOID:
            buffer.append(" ")
        if tag not in BLOCKS:
            continue
        yield from flush()
        if m[2]:
            if any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if stack and stack[-1][0] == "p":
            stack.pop()
        ends = CLOSES.get(tag, ())
        while stack and stack[-1][0] in ends:
            stack.pop()
        stack.append((tag, label_of(tag, m[4] or "")))
        yield path(), "", -1
    rest = source[at:]
    cut = rest.find("<")
    if cut >= 0 and re.match(r"</?[a-zA-Z]", rest[cut:]):
        rest = rest[:cut]
    if rest:
        take(rest)
    yield from flush()


def label_of(tag: str, attributes: str) -> str:
    """Tag with its first class (digits left out); ``!`` marks parts that are never content."""
    names = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in NAME.finditer(attributes)]
    words = {w for _, v in names for w in re.split(r"[^a-z]+", v.lower()) if w}
    kind = next((re.sub(r"[^a-z_-]+", "", v.lower().split()[0]) for k, v in names if k == "class" and v.strip()), "")
    if tag == "div" and any(k == "role" and v.lower() == "main" for k, v in names):
        tag = "main"
    bad = tag in SKIPPED or (words & MARKS and tag not in ("body", "html", "main"))
    return tag + ("." + kind if kind else "") + ("!" if bad else "")


def never_content(path: str) -> bool:
    return "!" in path or "/header" in path and not CONTENT.search(path.partition("/header")[0])


def tree_of(blocks: list[tuple[str, bool]]) -> Node:
    """A page's blocks (path, whether it is a text) as a tree; its slots in depth-first order are the texts in page order."""
    root = Node("")
    open_nodes, open_labels = [root], [""]
    for path, is_text in blocks:
        labels = path.split("/") if path else [""]
        keep = 1
        while keep < min(len(labels), len(open_labels)) and labels[keep] == open_labels[keep]:
            keep += 1
        if not is_text and keep == len(labels):
            keep -= 1
        del open_nodes[keep:], open_labels[keep:]
        for label in labels[keep:]:
            made = Node(label)
            open_nodes[-1].parts.append(made)
            open_nodes.append(made)
            open_labels.append(label)
        if is_text:
            open_nodes[-1].parts.append(Node("#"))
    return root


def shape(blocks: list[tuple[str, str, int]]) -> Node:
    """A page's stream as a tree with runs of equal siblings folded."""
    return folded(tree_of([(path, bool(text)) for path, text, _ in blocks]))


def folded(node: Node) -> Node:
    parts: list[Node] = []
    for part in map(folded, node.parts):
        if parts and parts[-1].label == part.label:
            parts[-1] = merged(parts[-1], part)
            parts[-1].repeated = True
        else:
            parts.append(part)
    node.parts = parts
    return node


def merged(a: Node, b: Node) -> Node:
    """Least expression that holds both; their labels are equal."""
    return Node(a.label, a.optional or b.optional, a.repeated or b.repeated, aligned(a.parts, b.parts))


def aligned(xs: list[Node], ys: list[Node]) -> list[Node]:
    """Longest common subsequence by label; parts of one side only become optional."""
    n, m = len(xs), len(ys)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if xs[i].label == ys[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and xs[i].label == ys[j].label:
            made = merged(xs[i], ys[j])
            i, j = i + 1, j + 1
        else:
            left = j == m or (i < n and best[i + 1][j] >= best[i][j + 1])
            side = xs[i] if left else ys[j]
            made = Node(side.label, True, side.repeated, side.parts)
            i, j = (i + 1, j) if left else (i, j + 1)
        if out and out[-1].label == made.label:
            again = merged(out[-1], made)
            again.repeated, again.optional = True, out[-1].optional and made.optional
            out[-1] = again
        else:
            out.append(made)
    return out


def parsed(expression: str) -> Node:
    """The tree that ``Node.write`` wrote."""
    root = Node("")
    stack = [root]
    for label, mark in re.findall(r"([^()*?+\s]+)?([()*?+]|\s)", expression):
        if label:
            stack[-1].parts.append(Node(label))
        if mark == "(":
            stack.append(stack[-1].parts[-1])
        elif mark == ")":
            stack.pop()
        elif mark in "*?+":
            node = stack[-1].parts[-1]
            node.optional, node.repeated = mark in "*?", mark in "*+"
    return root


class Places:
    """A wrapper that gives the texts of a page their slots: numbers of the wrapper's text slots, depth first."""

    def __init__(self, expression: str):
        self.root = parsed(expression)
        self.numbers: dict[int, str] = {}
        self.known: dict[tuple, list[int | None]] = {}
        todo = [self.root]
        while todo:
            node = todo.pop()
            if node.label == "#":
                self.numbers[id(node)] = str(len(self.numbers))
            todo.extend(reversed(node.parts))

    def of(self, blocks: list[tuple[str, bool]]) -> list[str]:
        """Slot of every text of ``blocks``; a text that the wrapper has no place for is named by its path."""
        found: list[str | None] = []
        todo: list[tuple[Node, Node | None]] = [(tree_of(blocks), self.root)]
        while todo:
            node, place = todo.pop()
            if node.label == "#":
                found.append(self.numbers[id(place)] if place else None)
            elif place is None:
                todo.extend((c, None) for c in reversed(node.parts))
            else:
                chosen = self.assigned(place, tuple(c.label for c in node.parts))
                todo.extend((c, None if j is None else place.parts[j])
                            for c, j in zip(reversed(node.parts), reversed(chosen), strict=True))
        paths = [p for p, is_text in blocks if is_text]
        return [p if f is None else f for f, p in zip(found, paths, strict=True)]

    def assigned(self, place: Node, labels: tuple[str, ...]) -> list[int | None]:
        """Part of ``place`` of each child: in order, as few children without a part and required parts left out as can be."""
        key = (id(place), labels)
        if key not in self.known:
            if len(self.known) > 20000:
                self.known.clear()
            at = {p.label: j for j, p in enumerate(place.parts)}
            if len(at) == len(place.parts) and all(x in at for x in labels):
                self.known[key] = [at[x] for x in labels]
            else:
                self.known[key] = cheapest(place.parts, labels)
        return self.known[key]


def cheapest(parts: list[Node], labels: tuple[str, ...]) -> list[int | None]:
    n, m, lost = len(labels), len(parts), 1 << 20
    # least[i][j]: cost of the children from i on when parts before j are passed; a repeated part may go on in again[i][j]
    least = [[0] * (m + 1) for _ in range(n + 1)]
    again = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for j in range(m, -1, -1):
            if i == n and j == m:
                continue
            ways = []
            if i < n:
                ways.append(least[i + 1][j] + lost)
            if j < m:
                ways.append(least[i][j + 1] + (not parts[j].optional))
                if i < n and labels[i] == parts[j].label:
                    ways.append(again[i + 1][j])
            least[i][j] = min(ways)
        for j in range(m):
            again[i][j] = least[i][j + 1]
            if i < n and parts[j].repeated and labels[i] == parts[j].label:
                again[i][j] = min(again[i][j], again[i + 1][j])
    out: list[int | None] = []
    i = j = 0
    inside = False
    while i < n:
        if inside:
            if parts[j].repeated and labels[i] == parts[j].label and again[i][j] == again[i + 1][j]:
                out.append(j)
                i += 1
            else:
                j, inside = j + 1, False
        elif j < m and labels[i] == parts[j].label and least[i][j] == again[i + 1][j]:
            out.append(j)
            i, inside = i + 1, True
        elif j < m and least[i][j] == least[i][j + 1] + (not parts[j].optional):
            j += 1
        else:
            out.append(None)
            i += 1
    return out


def host_of() -> object:
    found = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return found.alias("host")


READ = ("page_id bigint, url string, host string, stream string, paths array<string>, texts array<string>, "
        "linked array<int>")


def read_pages(pages: DataFrame) -> DataFrame:
    """Every page read once: its stream (its own expression) and blocks as ``paths``, ``texts`` and ``linked``.

    ``linked`` is -1 where an element opens; texts that can never be content are left empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                streams, paths, texts, linked = [], [], [], []
                for source in batch.column(3).to_pylist():
                    blocks = list(read(source))
                    streams.append("".join(p.write() for p in shape(blocks).parts))
                    paths.append([p for p, _, _ in blocks])
                    texts.append(["" if never_content(p) else t.encode("utf-8", "replace").decode() for p, t, _ in blocks])
                    linked.append([k for _, _, k in blocks])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array(streams, pa.string()), pa.array(paths, pa.list_(pa.string())),
                     pa.array(texts, pa.list_(pa.string())), pa.array(linked, pa.list_(pa.int32()))],
                    names=["page_id", "url", "host", "stream", "paths", "texts", "linked"])

    return pages.select("page_id", "url", host_of(), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, READ)


def infer_wrappers(pages_read: DataFrame, fan: int = 64) -> DataFrame:
    """host, wrapper and pages: each host's streams aligned, the commonest first.

    A host's streams are dealt over salted parts of about ``fan`` streams; then ``fan`` parts at a time are merged
    until each host has one wrapper, so that no task aligns more than some ``fan`` expressions of a host.
    """
    counted = materialise(pages_read.groupBy("host", F.col("stream").alias("wrapper")).agg(F.count("*").alias("pages")),
                          "streams")
    most = counted.groupBy("host").count().agg(F.max("count")).collect()[0][0] or 0
    parts = 1
    while parts * fan < most:
        parts *= fan
    level = counted.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(parts)))
    while True:
        level = aligned_parts(level)
        if parts == 1:
            return level.select("host", "wrapper", "pages")
        parts //= fan
        level = level.withColumn("part", F.pmod("part", F.lit(parts)))


def aligned_parts(level: DataFrame) -> DataFrame:
    """One row of (host, wrapper, pages, part) for all rows of a (host, part)."""
    ordered = level.select("host", "wrapper", "pages", "part").repartition("host", "part") \
        .sortWithinPartitions("host", "part", F.desc("pages"), "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, tree, pages = None, Node(""), 0

        def done() -> pa.RecordBatch:
            text = "".join(p.write() for p in tree.parts)
            return pa.RecordBatch.from_pydict({"host": [group[0]], "wrapper": [text], "pages": [pages], "part": [group[1]]})

        for batch in batches:
            for row in batch.to_pylist():
                new, key = parsed(row["wrapper"]), (row["host"], row["part"])
                if key == group:
                    tree = Node("", False, False, aligned(tree.parts, new.parts))
                else:
                    if group is not None:
                        yield done()
                    group, tree, pages = key, new, 0
                pages += row["pages"]
        if group is not None:
            yield done()

    return ordered.mapInArrow(run, "host string, wrapper string, pages bigint, part bigint")


class Wrappers:
    """The wrappers that a task has met last."""

    def __init__(self, room: int = 64):
        self.room, self.held = room, {}

    def places(self, wrapper: str, paths: list[str], linked: list[int]) -> list[str]:
        if wrapper not in self.held:
            if len(self.held) >= self.room:
                self.held.pop(next(iter(self.held)))
            self.held[wrapper] = Places(wrapper)
        return self.held[wrapper].of([(p, k >= 0) for p, k in zip(paths, linked, strict=True)])


def content_slots(pages_read: DataFrame, made: DataFrame, least_pages: int = 3) -> DataFrame:
    """host, ``main`` and ``other``: content slots of the host's wrapper inside an article or main element, and the rest."""
    kinds = pa.schema([("host", pa.string()), ("slot", pa.string()), ("path", pa.string()), ("lo", pa.int64()),
                       ("hi", pa.int64()), ("n", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Wrappers()
        for whole in batches:
            met: dict[tuple[str, str, str], list[int]] = {}
            for start in range(0, whole.num_rows, 256):
                for host, wrapper, paths, texts, linked in zip(
                        *(c.to_pylist() for c in whole.slice(start, 256).columns), strict=True):
                    slots = iter(held.places(wrapper, paths, linked))
                    for path, text, k in zip(paths, texts, linked, strict=True):
                        if k < 0:
                            continue
                        slot = next(slots)
                        if not text:
                            continue
                        h = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                        m = met.setdefault((host, slot, path), [h, h, 0, 0, 0])
                        met[host, slot, path] = [min(m[0], h), max(m[1], h), m[2] + 1, m[3] + len(text), m[4] + k]
            yield pa.RecordBatch.from_pylist([dict(zip(kinds.names, (*key, *m), strict=True)) for key, m in met.items()], kinds)

    slots = pages_read.select("host", "paths", "texts", "linked").join(made.select("host", "wrapper"), "host") \
        .select("host", "wrapper", "paths", "texts", "linked").mapInArrow(
            run, "host string, slot string, path string, lo bigint, hi bigint, n bigint, chars bigint, linked bigint") \
        .groupBy("host", "slot", "path").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"),
                                             F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    inside = F.col("path").rlike(CONTENT.pattern)
    fixed = (F.col("lo") == F.col("hi")) & (F.col("n") >= least_pages)
    fit = inside | (~fixed & (2 * F.col("linked") <= F.col("chars")))
    return slots.where(fit).groupBy("host").agg(F.collect_list(F.when(inside, F.col("slot"))).alias("main"),
                                                F.collect_list(F.when(~inside, F.col("slot"))).alias("other"))


def extract(pages: DataFrame, fan: int = 64) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null, empty or textless page has the empty text. Pages without a readable host form one group.
    Repeated rows are read alike; a page cut off in a tag loses that tag only. Slots of article or main
    elements take precedence on a page that has text in them.
    """
    blocks = materialise(read_pages(pages), "blocks")
    made = materialise(infer_wrappers(blocks, fan), "wrappers")
    known = materialise(made.select("host", "wrapper").join(content_slots(blocks, made), "host", "left"), "known")
    rows = blocks.select("page_id", "url", "host", "paths", "texts", "linked").join(known, "host") \
        .select("page_id", "url", "wrapper", "main", "other", "paths", "texts", "linked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Wrappers()
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch, out = whole.slice(start, 256), []
                for wrapper, main, other, paths, texts, linked in zip(
                        *(c.to_pylist() for c in batch.columns[2:]), strict=True):
                    slots = held.places(wrapper, paths, linked)
                    own = [(s, t) for s, t in zip(slots, (t for t, k in zip(texts, linked, strict=True) if k >= 0),
                                                  strict=True) if t]
                    inner, outer = set(main or ()), set(other or ())
                    out.append(" ".join([t for s, t in own if s in inner] or [t for s, t in own if s in outer]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out, pa.string()),
                     pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper and pages of every host of a page table."""
    return infer_wrappers(materialise(read_pages(pages), "blocks"))
