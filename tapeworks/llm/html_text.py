"""Main text of web pages from container paths that a host's pages agree on."""

from __future__ import annotations

import html
import re
import zlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeworks.functions.state import checkpoint

# HTML element names by role, and words in class, id or role that mark what is not the article.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "select", "title")
OUT = {"nav", "header", "footer", "aside", "form", "head", "button", "dialog", "menu", "object", "audio", "video", "canvas"}
CONTAINERS = {"body", "main", "article", "section", "div", "td", "center"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
    "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|promo|promotion|sponsor|sponsored|sidebar|side|nav|navbar|"
    r"navigation|menu|breadcrumb|breadcrumbs|footer|header|masthead|comment|comments|respond|reply|replies|disqus|cookie|cookies|"
    r"consent|gdpr|notice|alert|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|popup|modal|overlay|"
    r"toolbar|pagination|pager|widget|skip|search|complementary|contentinfo)(?:$|[\s_-])"
)
P_CLOSERS = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME_CLOSERS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)


class Page:
    """Blocks of text of a page, each with the containers around it; ``paths`` names the containers."""

    def __init__(self, source: str):
        self.paths: list[str] = []
        self.parent: list[int] = []
        self.tags: list[str] = []
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters inside links
        self._text: list[str] = []
        self._linked = 0
        self._stack: list[tuple[str, int, bool, str]] = [("", -1, False, "")]  # tag, container, left out, path
        at = 0
        for m in _PIECE.finditer(source):
            self._add(source[at : m.start()])
            at = m.end()
            if m[3]:
                (self._close if m[2] else self._open)(m[3].lower(), m[4] or "")
        self._add(source[at:])
        self._end_block()

    def _add(self, raw: str) -> None:
        if raw and not self._stack[-1][2]:
            text = html.unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if any(x[0] == "a" for x in self._stack[-4:]):
                self._linked += len(text)

    def _end_block(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1][1], text, min(self._linked, len(text))))
            self._text, self._linked = [], 0

    def _open(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self._add(" ")
            return
        if tag not in INLINE:
            self._end_block()
        if tag in P_CLOSERS:
            self._pop({"p"}, {"table", "td", "th", *CONTAINERS, *OUT})
        elif tag in SAME_CLOSERS:
            self._pop(SAME_CLOSERS[tag], {"table", "ul", "ol", "dl", "select", *OUT})
        if tag in VOID or attrs.endswith("/") and tag not in CONTAINERS:
            return
        _, container, out, path = self._stack[-1]
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)} if attrs else {}
        kind = re.sub(r"\d+", "#", " ".join(named.get("class", "").lower().split()[:2]))
        path = f"{path}/{tag}" + (f".{kind.replace(' ', '.')}" if kind else "")
        if not out:
            marks = " ".join(named.get(k, "") for k in ("class", "id", "role")).lower()
            hidden = "hidden" in named or named.get("aria-hidden", "").lower() == "true" or "display:none" in named.get("style", "").replace(" ", "").lower()
            out = tag in OUT or hidden or (tag not in ("body", "html", "article", "main") and bool(marks.strip()) and bool(NOT_ARTICLE.search(marks)))
        if tag in CONTAINERS and not out:
            self.paths.append(path)
            self.parent.append(container)
            self.tags.append(tag)
            container = len(self.paths) - 1
        self._stack.append((tag, container, out, path))

    def _pop(self, tags: set[str], stop: set[str]) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] in tags:
                del self._stack[k:]
                return
            if self._stack[k][0] in stop:
                return

    def _close(self, tag: str, _: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for k in range(len(self._stack) - 1, 0, -1):
            if self._stack[k][0] == tag:
                del self._stack[k:]
                return
            if tag in INLINE and self._stack[k][0] not in INLINE:
                return

    def scores(self) -> dict[int, float]:
        """Points of each container: the plain text of its blocks, in parts for the containers further out."""
        points: dict[int, float] = {}
        for container, text, linked in self.blocks:
            worth, level = max(len(text) - 2.0 * linked, 0.0), 1
            while container >= 0 and level <= 6:
                points[container] = points.get(container, 0.0) + worth / (1 if level == 1 else 2 * level)
                container, level = self.parent[container], level + 1
        favour = {"article": 2.0, "main": 1.5, "body": 0.6}
        return {c: p * favour.get(self.tags[c], 1.0) for c, p in points.items()}


def _units(page: Page) -> dict[str, list]:
    """By path: plain points, length and text of all its blocks, and whether it lies right under the body.

    The own blocks of the body have a path of their own that ends in a slash.
    """
    inside: dict[str, list] = {}
    top = lambda c: page.tags[c] != "body" and (page.parent[c] < 0 or page.tags[page.parent[c]] == "body")
    for container, text, linked in page.blocks:
        around, c = {}, container
        if c >= 0 and page.tags[c] == "body":
            around[page.paths[c] + "/"] = True
        while c >= 0:
            around[page.paths[c]] = top(c)
            c = page.parent[c]
        for path, is_top in around.items():
            u = inside.setdefault(path, [0.0, 0, [], is_top])
            u[0] += max(len(text) - 2.0 * linked, 0.0)
            u[1] += len(text)
            u[2].append(text)
    return inside


def _last_tag(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(".")[0]


def _outermost(core: str, plain: list[str]) -> str:
    """Of the plain paths around ``core`` the outermost article or main; without one, the outermost below the body."""
    around = sorted((p for p in {core, *plain} if p == core or core.startswith(p + "/")), key=len)
    named = [p for p in around if _last_tag(p) in ("article", "main")]
    return (named or [p for p in around if _last_tag(p) not in ("body", "html", "")] or [core])[0]


def _beside(outer: str, units: list[str]) -> list[str]:
    """The units under the body that go with ``outer``: the body's own blocks, and containers where no article or main is named."""
    named = _last_tag(outer) in ("article", "main")
    return sorted(u for u in units if u != outer and (u[:-1] != outer if u.endswith("/") else not outer.startswith(u + "/")) and (u.endswith("/") or not named))


def votes_of(source: str) -> list[tuple]:
    """Generalised paths of a page's containers with their share of its best points, plain points, length, text hash, place."""
    page = Page(source)
    points = page.scores()
    if not points or max(points.values()) <= 0:
        return []
    top = max(points.values())
    by_path: dict[str, float] = {}
    for c, p in points.items():
        by_path[page.paths[c]] = max(by_path.get(page.paths[c], 0.0), p / top)
    return [(path, by_path.get(path, 0.0), u[0], u[1], zlib.crc32(" ".join(u[2]).encode("utf-8", "replace")), u[3]) for path, u in sorted(_units(page).items())]


def main_text(source: str, paths: list[str] | None) -> str:
    """Text at ``paths``, of which the first is the article's; where the page has not that one, of its own best place."""
    page = Page(source)
    if paths is None or paths[0] not in page.paths or not (text := _text_at(page, paths)):
        points = page.scores()
        if not points:
            return " ".join(text for _, text, _ in page.blocks)
        best = page.paths[max(points, key=lambda c: (points[c], -c))]
        units = _units(page)
        plain = [p for p, u in units.items() if 2 * u[0] >= u[1]]
        outer = _outermost(best, plain)
        text = _text_at(page, [outer, *_beside(outer, [p for p in plain if units[p][3]])])
    return text


def _text_at(page: Page, paths: list[str]) -> str:
    whole, own = set(paths), {p[:-1] for p in paths if p.endswith("/")}
    inside = [False] * len(page.paths)
    for c in range(len(page.paths)):
        inside[c] = page.paths[c] in whole or (page.parent[c] >= 0 and inside[page.parent[c]])
    return " ".join(text for c, text, _ in page.blocks if c >= 0 and (inside[c] or page.paths[c] in own))


def extract_main_text(pages: DataFrame, url: str = "url", source: str = "html", broadcast_rows: int = 100_000) -> DataFrame:
    """All columns of the pages but the source, with ``text`` and ``n_chars``.

    Each page's containers are scored by the plain text in them (menus, headers, footers,
    sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments left
    out). The generalised paths (tags with their classes, digits as #) of all its containers vote,
    by their share of its points, for their host. From each host's winner the text is widened to
    the outermost plain article or main around it, or without one to the outermost plain
    container below the body (plain: half of its characters count after links are taken off).
    Blocks right in the body, and without an article or main also containers right under it, are
    taken too if they are plain, stand on half of the winner's pages and do not say the same on
    all of them. A page without such a place is treated by itself in the same way. Inside,
    character references are decoded, white space in a block becomes one space, and the blocks
    are joined by one space. A null or empty source gives an empty text; a page without a host
    votes with the other such pages; repeated rows are pages like any other. The winners are
    broadcast only if they are counted to be ``broadcast_rows`` at most. New columns replace old
    ones of their names, in whatever case.
    """
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (source.lower(), "text", "n_chars")]
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    # the page's own columns travel as one, so that no name of theirs meets a helper's
    rows = pages.select(F.struct(F.lit(0).alias("__none") if not kept else kept[0], *kept[1:]).alias("__page"), F.col(source).alias("__html"), host.alias("__host"))

    def vote(batches):
        for pdf in batches:
            out = [(h, *v) for h, s in zip(pdf["__host"], pdf["__html"]) if isinstance(s, str) for v in votes_of(s)]
            yield pd.DataFrame(out, columns=["host", "path", "share", "worth", "size", "said", "top"])

    votes = rows.select("__host", "__html").mapInPandas(vote, "host string, path string, share double, worth double, size long, said long, top boolean")
    tally = votes.groupBy("host", "path").agg(
        F.round(F.sum("share"), 6).alias("votes"), (2 * F.round(F.sum("worth")) >= F.sum("size")).alias("plain"),
        ((F.count("*") == 1) | (F.min("said") < F.max("said"))).alias("varied"), F.count("*").alias("n"), F.max("top").alias("top"),
    )
    tally = checkpoint(tally)
    rank = Window.partitionBy("host").orderBy(F.col("votes").desc(), "path")
    core = tally.withColumn("r", F.row_number().over(rank)).where("r = 1").select("host", F.col("path").alias("core"), F.col("n").alias("core_n"))
    near = tally.join(core, "host").where("plain and (startswith(core, concat(path, '/')) or (top and varied and 2 * n >= core_n) or path = core)")
    lists = near.groupBy("host").agg(F.collect_set(F.when(F.expr("startswith(core, concat(path, '/'))"), F.col("path"))).alias("around"), F.collect_set(F.when(F.expr("top and varied and 2 * n >= core_n"), F.col("path"))).alias("tops"))

    @F.pandas_udf("array<string>")
    def places(cores: pd.Series, around: pd.Series, tops: pd.Series) -> pd.Series:
        outer = [_outermost(c, list(a) if a is not None else []) for c, a in zip(cores, around)]
        return pd.Series([[o, *_beside(o, list(t) if t is not None else [])] for o, t in zip(outer, tops)], dtype=object)

    winners = core.join(lists, "host", "left").select(F.col("host").alias("__host"), places("core", "around", "tops").alias("__path"))
    winners = checkpoint(winners)
    near = F.broadcast(winners) if winners.limit(broadcast_rows + 1).count() <= broadcast_rows else winners

    @F.pandas_udf("string")
    def take(sources: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([main_text(s, list(p) if p is not None else None) if isinstance(s, str) else "" for s, p in zip(sources, paths)], dtype=object)

    found = rows.join(near, "__host", "left").select("__page", take("__html", "__path").alias("__text"))
    return found.select(*(["__page.*"] if kept else []), F.col("__text").alias("text"), F.length("__text").cast("long").alias("n_chars"))
