"""Main text of web pages, by differencing each page with the page of its host whose URL is nearest.

A page is cut into lines (the text of a block element). Pages lie sorted by host and path in evenly filled ranges, pages of equal lines
only once; each meets the nearest one whose article isn't its own (of the two sides, the one that shares the longer part of its path), their
lines are aligned by a longest common subsequence, and shared lines are template: they go. Articles quote each other, so in what a page
marks as its article a shared line goes with the box that it stands in (HOLDERS), if all lines of the box are shared and the box isn't
the article's body; lines of the running text stay. What a page marks as
something else (menus, forms, adverts, comments and so on) goes even where no neighbour has it. A host of any size is spread over
as many tasks as its pages need: a task sees runs of RUN pages, with one more at each end. Pages whose neighbours all carry the same article as far as
that go on to the runs behind.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.alignment import common_places
from cirrus.llm.common import distilled, durable, slices, utf8, with_rid

#: Pages in a run of neighbours, and in a task that sorts.
RUN, PAGES_PER_TASK = 256, 20_000
#: Share of an article's lines from which on two articles are one.
SAME = 0.5

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|iframe|object|textarea|title)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>"
    r"|(?P<text>[^<]+|<)",
    re.I | re.S,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements, and words in class, id or role, that mark what is not the article.
ASIDE = frozenset("aside button dialog footer form head header menu nav select".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted promotion related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ARTICLE, ARTICLE_WORDS = frozenset(("article", "main")), frozenset(("main", "article"))
#: Of ASIDE, what belongs to an article that it stands in; and elements that hold blocks of their own, whose names count inside an article.
OF_ARTICLE, HOLDERS = frozenset(("header",)), frozenset("aside div dl footer form nav ol section table ul".split())
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements that a start tag of the same group ends, if one is open.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}


@dataclass
class Line:
    text: str
    article: bool
    aside: bool
    #: Numbers of the HOLDERS elements inside an article that it stands in.
    boxes: tuple[int, ...] = ()

    def key(self) -> int:
        return xxhash.xxh3_64_intdigest(self.text.encode("utf-8", "surrogatepass")) - (1 << 63)


def lines(page: str) -> list[Line]:
    """The blocks of a page in order, without empty ones: references decoded, white space made single."""
    out: list[Line] = []
    open_: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # tag, inside an article, inside something else, boxes
    n_boxes = 0
    parts: list[str] = []

    def flush() -> None:
        if parts:
            if text := " ".join("".join(parts).split()):
                _, article, aside, boxes = open_[-1] if open_ else ("", False, False, ())
                out.append(Line(text, article, aside, boxes))
            parts.clear()

    for m in TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            parts.append(html.unescape(text) if "&" in text else text)
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            if any(x[0] == tag for x in open_):
                closed = []
                if tag in BLOCK:
                    flush()
                    while open_ and not closed[-1:] == [tag]:
                        closed.append(open_.pop()[0])
                elif open_[-1][0] == tag:
                    open_.pop()
            elif tag == "p":
                flush()
            continue
        if tag in BLOCK:
            flush()
            for t in CLOSES.get(tag, ("p",) if tag in BLOCK else ()):
                while open_ and any(x[0] == t for x in open_[-4:]) and not any(x[0] in ("table", "ul", "ol", "dl") for x in open_[len(open_) - 1 - [x[0] for x in open_[::-1]].index(t) :][1:]):
                    while open_.pop()[0] != t:
                        pass
        elif tag == "br":
            parts.append(" ")
        if tag in VOID:
            continue
        _, article, aside, boxes = open_[-1] if open_ else ("", False, False, ())
        if article and tag in HOLDERS:
            n_boxes += 1
            boxes = (*boxes, n_boxes)
        words = set()
        if m["attrs"] and (not article or tag in HOLDERS):
            for n in NAMED.finditer(m["attrs"]):
                named = (n[2] or n[3] or n[4] or "").lower()
                words.update(named.split() if article else re.split(r"[^a-z0-9]+", named))  # inside an article, only whole names
        if tag in ARTICLE or (tag == "div" and words & ARTICLE_WORDS and "role" in (m["attrs"] or "")):
            article = True
        if (tag in ASIDE and not (article and tag in OF_ARTICLE)) or (tag not in ("html", "body") and words & ASIDE_WORDS):
            aside = True
        if tag in BLOCK or aside != (open_[-1][2] if open_ else False):
            if tag not in BLOCK:
                flush()
            open_.append((tag, article, aside, boxes))
    flush()
    return out


def alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def one_article(keys: list[int], inside: list[bool], other: list[int], other_inside: list[bool]) -> bool:
    """Whether two pages carry the same article: half of the lines (of the longer one) that both mark as theirs are shared."""
    x, y = ({k for k, i in zip(*p) if i} for p in ((keys, inside), (other, other_inside)))
    return bool(x) and len(x & y) >= SAME * max(len(x), len(y))


def other_article(run: list[tuple], k: int, step: int) -> int | None:
    """In a run (class, host, path, line keys, which lines are marked as article; sorted), the nearest page to page k in one direction whose article is another.
    -1 where the host ends before, None where the run does."""
    _, host, _, keys, inside = run[k][:5]
    i = k + step
    while 0 <= i < len(run):
        if run[i][1] != host:
            return -1
        if run[i][3] != keys and not one_article(keys, inside, run[i][3], run[i][4]):
            return i
        i += step
    return None


def shared_with(path: str, keys: list[int], near: list[tuple[str, list[int]]]) -> list[int]:
    """The lines that a page shares with the nearer one of its neighbours (path, line keys)."""
    if not near:
        return []
    other = max(near, key=lambda r: alike(path, r[0]))[1]
    return [i for i, _ in common_places(keys, other)]


def shared_lines(run: list[tuple], k: int) -> list[int]:
    """Of page k of a run, the lines that it shares with the nearer one of the two neighbours whose articles are others."""
    near = [run[i][2:4] for i in (other_article(run, k, step) for step in (-1, 1)) if i is not None and i >= 0]
    return shared_with(*run[k][2:4], near)


def keyed_lines(pages: DataFrame) -> DataFrame:
    """rid, host, path, line keys, which lines are marked as article, and a hash of both, of pages (rid, url, html). A null URL has an empty host and path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            found = [lines(p.decode("utf-8", "replace")) for p in utf8(batch.column("html"))]
            keys = [[x.key() for x in f] for f in found]
            inside = [[x.article and not x.aside for x in f] for f in found]
            kind = [xxhash.xxh3_128_digest(np.array(k, np.int64).tobytes() + bytes(i)) for k, i in zip(keys, inside)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rid", "host", "path")), pa.array(keys, pa.list_(pa.int64())), pa.array(inside, pa.list_(pa.bool_())), pa.array(kind, pa.binary())], names=["rid", "host", "path", "keys", "inside", "kind"])

    url = F.coalesce("url", F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*)?([^?#]*)", 1)
    return pages.select("rid", host.alias("host"), path.alias("path"), "html").mapInArrow(run, "rid long, host string, path string, keys array<long>, inside array<boolean>, kind binary")


def numbered(rows: DataFrame, n_tasks: int) -> DataFrame:
    """rows in order of host, path and rid, with their place in it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            yield batch.append_column("nth", pa.array(np.arange(at, at + batch.num_rows)))
            at += batch.num_rows

    ranged = rows.repartitionByRange(n_tasks, "host", "path", "rid").sortWithinPartitions("host", "path", "rid").withColumn("part", F.spark_partition_id())
    placed = durable(ranged.mapInArrow(count, "rid long, host string, path string, keys array<long>, inside array<boolean>, part int, nth long"), "ordered")
    parts = placed.groupBy("part").count()  # one row for each task of the sort
    before = parts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    return placed.join(before, "part").select("rid", "host", "path", "keys", "inside", (F.col("before") + F.col("nth")).alias("place"))


def template_lines(pages: DataFrame) -> DataFrame:
    """rid and shared: the numbers of the lines that a page (rid, url, html) has in common with its nearest neighbour of another article."""
    keyed = durable(keyed_lines(pages), "lines")
    # Pages of a host with equal lines are one class: its first page is compared, and what it shares holds for all.
    classes = durable(keyed.groupBy("host", "kind").agg(F.min(F.struct("path", "rid")).alias("first")).select("host", "kind", F.col("first.rid").alias("rid")), "classes")
    firsts = keyed.join(classes.select("rid"), "rid", "left_semi").select("rid", "host", "path", "keys", "inside")
    n_pages = classes.count()
    order = numbered(firsts, max(1, -(-n_pages // PAGES_PER_TASK)))
    run = F.floor(F.col("place") / RUN).cast("long")
    ends = F.when(F.col("place") % RUN == 0, F.array(run, run - 1)).when(F.col("place") % RUN == RUN - 1, F.array(run, run + 1)).otherwise(F.array(run))
    dealt = order.withColumn("own", run).withColumn("run", F.explode(ends)).repartition("run").sortWithinPartitions("run", "place").select("run", "own", "rid", "host", "path", "keys", "inside", "place")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def close() -> pa.RecordBatch:
            rows = [h[1:] for h in held]
            whole = held[0][0] == at, held[-1][0] == at  # no run before it, and none behind it
            out = []
            for k in (k for k, h in enumerate(held) if h[0] == at):
                sides = [-1 if i is None and last else i for i, last in zip((other_article(rows, k, step) for step in (-1, 1)), whole)]
                known = None not in sides
                out.append((rows[k][0], shared_lines(rows, k) if known else None, rows[k][5], *(i if i is None or i < 0 else rows[i][5] for i in sides)))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.list_(pa.int32()), *[pa.int64()] * 3))], names=["rid", "shared", "place", "left", "right"])

        for batch in batches:
            for r, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    if any(h[0] == at for h in held):
                        yield close()
                    at, held = r, []
                held.append(row)
        if any(h[0] == at for h in held):
            yield close()

    found = durable(dealt.mapInArrow(align, "rid long, shared array<int>, place long, left long, right long"), "template")
    near, far = found.where(F.col("shared").isNotNull()).select("rid", "shared"), found.where(F.col("shared").isNull())
    if not far.isEmpty():
        near = near.unionByName(durable(far_lines(order, far.select("rid", "place", "left", "right"), -(-n_pages // RUN)), "far-template"))
    return keyed.select("rid", "host", "kind").join(classes.join(near, "rid").drop("rid"), ["host", "kind"]).where(F.size("shared") > 0).select("rid", "shared")


def far_lines(order: DataFrame, asked: DataFrame, n_runs: int) -> DataFrame:
    """rid and shared of pages (rid, place, left, right) whose left or right neighbour (its place, -1: none) lies beyond their own run (null).

    Such pages go to the runs behind, each time to twice as many, until one of another article or of another host is there. A task holds one run.
    """
    run = F.floor(F.col("place") / RUN).cast("long")
    pages = durable(order.withColumn("run", run), "runs")
    sides = [asked.where(F.col(c).isNull()).select("place", F.lit(side).alias("side")) for c, side in (("left", -1), ("right", 1))]
    open_, stops, first, many = durable(sides[0].unionByName(sides[1]), "open-sides"), None, 1, 1

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            out = []
            for r, side, place, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if r != at:
                    at, held = r, []
                if not side:
                    held.append((place, *row))
                    continue
                own = [(place, *row)]
                for page in held[::side]:
                    i = other_article([*own, page], 0, 1)
                    if i is not None:
                        out.append((place, side, page[0], i > 0))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], names=["place", "side", "stop", "other"])

    columns = ["run", "side", "place", "host", "path", "keys", "inside"]
    while not open_.isEmpty():
        ahead = F.sequence(F.col("run") + F.col("side") * first, F.col("run") + F.col("side") * (first + many - 1), F.col("side").cast("long"))
        sent = open_.join(pages, "place").withColumn("run", F.explode(ahead)).where(F.col("run").between(0, n_runs - 1)).select(columns)
        there = pages.join(sent.select("run").distinct(), "run", "left_semi").withColumn("side", F.lit(0)).select(columns)
        dealt = there.unionByName(sent).repartition("run").sortWithinPartitions("run", F.col("side") != 0, "place")
        met = durable(dealt.mapInArrow(meet, "place long, side int, stop long, other boolean"), "stops")
        stops = met if stops is None else stops.unionByName(met)
        first, many = first + many, 2 * many
        left = open_.join(met.select("place", "side").distinct(), ["place", "side"], "left_anti")
        open_ = durable(left.where((run + F.col("side") * first).between(0, n_runs - 1)), "open-sides")
    nearest = stops.groupBy("place", "side").agg(F.min_by(F.struct("stop", "other"), F.col("stop") * F.col("side")).alias("at"))
    out = asked
    for c, side in (("left", -1), ("right", 1)):
        some = nearest.where((F.col("side") == side) & F.col("at.other")).select("place", F.col("at.stop").alias("stop"))
        end = pages.select(F.col("place").alias(c), F.struct("path", "keys").alias(f"{c}_page"))
        out = out.join(some, "place", "left").withColumn(c, F.coalesce(c, "stop")).drop("stop").join(end, c, "left")
    rows = out.join(pages.select("place", "path", "keys"), "place").select("rid", "path", "keys", "left_page", "right_page")

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared_with(path, keys, [tuple(p.values()) for p in near if p]) for _, path, keys, *near in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(got, pa.list_(pa.int32()))], names=["rid", "shared"])

    return rows.mapInArrow(share, "rid long, shared array<int>")


def template_boxes(found: list[Line], gone: set[int]) -> set[int]:
    """Boxes inside an article all of whose lines are gone, but for those that hold half of the article's lines or more: that is its body."""
    inside = [i for i, x in enumerate(found) if x.article and not x.aside]
    size = Counter(b for i in inside for b in found[i].boxes)
    lost = Counter(b for i in inside if i in gone for b in found[i].boxes)
    return {b for b, n in size.items() if lost[b] == n and 2 * n < len(inside)}


def main_text(page: str, shared: list[int]) -> str:
    """The lines that are neither marked as something else nor shared. Of a page that marks an article, those of the article; there a shared
    line goes if the whole box that it stands in is shared, and is a quotation otherwise."""
    found, gone = lines(page), set(shared)
    if any(x.article and not x.aside for x in found):
        boxes = template_boxes(found, gone)
        kept = [x.text for i, x in enumerate(found) if x.article and not x.aside and not (i in gone and boxes.intersection(x.boxes))]
    else:
        kept = [x.text for i, x in enumerate(found) if not x.aside and i not in gone]
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """For each row of pages (page_id, url, html; read from files) page_id, url, text and n_chars.

    A null or empty html has an empty text. A null URL is a page of an unnamed host. Pages that repeat are not compared with their
    copies, and equal pages of a host have equal texts. An empty table gives an empty result.
    """
    shared = distilled(lambda: template_lines(with_rid(pages, "url", "html")), "shared-lines")
    rows = with_rid(pages, "page_id", "url", "html").join(shared, "rid", "left").select(F.struct("page_id", "url").alias("row"), "html", "shared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 4 << 20):
            texts = [main_text(p.decode("utf-8", "replace"), s or []) for p, s in zip(utf8(batch.column("html")), batch.column("shared").to_pylist())]
            texts = [t.encode("utf-8", "replace").decode() for t in texts]  # a reference may name half a surrogate pair
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "text"])

    out = rows.mapInArrow(run, rows.select("row", F.lit("").alias("text")).schema)
    return out.select(F.col("row.page_id").alias("page_id"), F.col("row.url").alias("url"), "text", F.length("text").cast("long").alias("n_chars"))
