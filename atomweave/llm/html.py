"""Main text of web pages by container paths on which the pages of a host agree.

Every page is read into a light tree.  Its containers are scored by the running text they hold and the links in it,
and the best of them vote, by their path of tags and generalised classes, for the host's main container; Spark adds up
the votes of all pages.  Each page is then read again and the elements at its host's winning path give the text;
a page that lacks that path uses its own best container.  Where the elements are parts of an article, or one with a
headline or lead beside it, the element around them is taken.

Tags that hold no article text (nav, aside, form, ...) are left out, and so are elements whose class, id or role is made
of words for such parts alone, unless they hold the page's article or, where none is marked, most of its text.  A class that has such a word
beside others (``social-history``) decides nothing by itself: the element goes if its text is the same on most of the
host's pages that have it, and stays if not.

Defined results: null or empty html, and pages without running text, give an empty text and n_chars 0.  A null url or
one without ``://`` belongs to the empty host.  Equal votes go to the longer path, then the larger one.  Elements
left open end where HTML ends them, or with the page.  Texts of any length are read whole; repeated rows are answered
each; an empty table gives an empty result.  Input columns named text or n_chars are replaced.  Drawings (svg) are no
text; formulas (math) and the content of objects are.
"""

from __future__ import annotations

import hashlib
import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atomweave.llm.common import BROADCAST_ROWS, slices, staged

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    |<[a-z/!?][^>]*(?:>|\Z)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: HTML's elements that end a line of text, that have no content, and that hold no running text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul head caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div td body blockquote".split())
NO_TEXT = frozenset("nav aside footer form button head menu dialog label fieldset audio video canvas search".split())
#: Words of classes, ids and roles that mark what isn't the article.
NOT_ARTICLE = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login paywall"
    " comment comments commentlist disqus respond reply replies discussion sidebar side rail widget widgets related recommended recommendations more-like share sharing social follow breadcrumb breadcrumbs menu nav navbar navigation pager pagination"
    " footer header masthead topbar toolbar contentinfo complementary search searchbox form hidden skip toc tags".split()
)
#: Words that say where or how an element stands, not what it is.
LAYOUT = frozenset(
    "area bar block body bottom box btn button center close col column container content desktop dark fixed float full global grid group header heading img image inline inner item items large layout left light line link links list"
    " main medium menu mobile module outer page panel placeholder post posts area right row section site slot small sticky story stories article articles text title top unit view wrap wrapper x".split()
)
#: What ends an open p, and which sibling ends an open element of its kind.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SCOPE = frozenset({"article", "section", "main", "div", "td", "th", "table", "aside", "footer", "header", "nav", "blockquote", "body", "html", "button", "object", "form", "figure", "ul", "ol", "li"})


class Page:
    """Elements in page order: parent, path, mark (0 none, 1 doubtful, 2 by class, 3 by tag), whether dropped, and the end
    of their subtree; text blocks with their element.  ``boiler``: paths of doubtful elements that aren't the article."""

    def __init__(self, html: str, boiler: frozenset[str] = frozenset()):
        self.parent, self.tag, self.path, self.mark, self.last = [-1], ["body"], [""], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it in links
        self._read(html)
        self.last = [x or len(self.tag) for x in self.last]
        self.dropped = self._drop(boiler)

    def _drop(self, boiler: frozenset[str]) -> list[bool]:
        by_tag = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            by_tag[n] = by_tag[self.parent[n]] or self.mark[n] == 3
        held = [0] * (len(self.tag) + 1)  # running text before each element
        for node, text, linked in self.blocks:
            held[node + 1] += 0 if by_tag[node] else max(0, len(text) - linked)
        for n in range(len(self.tag)):
            held[n + 1] += held[n]
        heads = [n for n, tag in enumerate(self.tag) if tag in ("article", "main", "h1")]
        out = [False] * len(self.tag)
        for n in range(1, len(self.tag)):
            marked = self.mark[n] == 3 or self.mark[n] == 1 and self.path[n] in boiler
            if self.mark[n] == 2:
                inner = any(n <= k < self.last[n] for k in heads)
                whole = inner or not heads and 2 * (held[self.last[n]] - held[n]) > held[-1]
                marked = not whole or self.mark_inside(n)
            out[n] = out[self.parent[n]] or marked
        return out

    def mark_inside(self, n: int) -> bool:
        """Whether an element stands inside an article, where a class that says otherwise is meant so."""
        while n > 0:
            n = self.parent[n]
            if self.tag[n] in ("article", "main"):
                return True
        return False

    def doubtful(self) -> list[tuple[str, str]]:
        """(path, text) of the doubtful elements that have some."""
        held: dict[int, list[str]] = {}
        for node, text, _ in self.blocks:
            while node > 0 and not self.dropped[node]:
                if self.mark[node] == 1:
                    held.setdefault(node, []).append(text)
                node = self.parent[node]
        return [(self.path[n], "\n\n".join(t)) for n, t in held.items()]

    def _read(self, html: str) -> None:
        stack = [0]
        parts: list[str] = []
        linked, in_link = 0, 0

        def flush(node: int) -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((node, text, min(linked, len(text))))
                parts.clear()
            linked = 0

        def close(depth: int) -> None:
            flush(stack[-1])
            while len(stack) > depth:
                self.last[stack.pop()] = len(self.tag)

        def say(piece: str) -> None:
            nonlocal linked
            if piece:
                piece = unescape(piece) if "&" in piece else piece
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())

        at = 0
        for m in _TOKEN.finditer(html):
            say(html[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                in_link = 0 if m["end"] else 1
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag not in BLOCKS and tag not in NO_TEXT and tag not in ("hr",):
                # of inline elements only those marked as no part of the article count
                if m["end"]:
                    if tag != "span" and tag not in VOID:
                        continue
                    for d in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[d]] == tag:
                            close(d)
                            break
                        if self.tag[stack[d]] in BLOCKS:
                            break
                    continue
                if tag != "span" or not m["attrs"].strip() or _marked(m["attrs"])[1] < 2:
                    continue
            if tag in ("html", "body"):
                flush(stack[-1])
                continue
            if m["end"]:
                for d in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[d]] == tag:
                        close(d)
                        break
                    if tag in ("p", "li", "span") and self.tag[stack[d]] in _SCOPE - {"li"}:
                        break
                else:
                    flush(stack[-1])
                continue
            if tag == "hr":
                flush(stack[-1])
                continue
            if tag in BLOCKS and tag != "span":
                for d in range(len(stack) - 1, 0, -1):
                    open_ = self.tag[stack[d]]
                    if open_ == "p" or open_ in _ENDS.get(tag, ()):
                        close(d)
                        break
                    if open_ in _STOPS.get(tag, _SCOPE) or open_ in _SCOPE and tag not in _ENDS:
                        break
            label, marked = _marked(m["attrs"])
            flush(stack[-1])
            up = stack[-1]
            inside = tag == "header" and any(self.tag[x] in ("article", "main") for x in stack)
            self.parent.append(up)
            self.tag.append(tag)
            self.path.append(f"{self.path[up]}/{tag}{label}")
            self.mark.append(3 if tag in NO_TEXT or tag == "header" and not inside or marked == 3 else marked)
            self.last.append(0)
            if tag not in VOID:
                stack.append(len(self.tag) - 1)
        say(html[at:])
        close(1)
        flush(0)

    def scores(self) -> dict[int, float]:
        """Running text of containers: a block counts for the nearest one whole and for the next one around it by half."""
        out: dict[int, float] = {}
        for node, text, linked in self.blocks:
            if self.dropped[node]:
                continue
            worth = max(0.0, len(text) - 2.0 * linked)
            if self.tag[node] in ("li", "td", "th", "dd", "dt"):
                worth /= 2
            share = 1.0
            while node >= 0 and share > 0.2:
                if self.tag[node] in CONTAINERS and not self.dropped[node]:
                    favoured = 1.3 if self.tag[node] in ("article", "main") else 1.0
                    out[node] = out.get(node, 0.0) + worth * share * favoured
                    share /= 2
                node = self.parent[node]
        return out

    def text_of(self, nodes: list[int]) -> str:
        ranges = [(n, self.last[n]) for n in nodes]
        return "\n\n".join(t for node, t, _ in self.blocks if not self.dropped[node] and any(a <= node < b for a, b in ranges))

    def whole(self, nodes: list[int]) -> list[int]:
        """``nodes``, or the element that they are parts of: the article or main around them, the least one around several,
        or one that adds a headline or running text, less than there is in the nodes."""
        if not nodes:
            return nodes
        up = nodes[0]
        while up > 0 and self.tag[up] not in ("article", "main"):
            up = self.parent[up]
        if up > 0 and all(up <= n < self.last[up] for n in nodes):
            return [up]
        if len(nodes) > 1:
            up = nodes[0]
            while up > 0 and not all(up <= n < self.last[up] for n in nodes):
                up = self.parent[up]
            return [up] if up > 0 else nodes
        node = nodes[0]
        while (up := self.parent[node]) > 0 and self.tag[up] in CONTAINERS:
            own = sum(len(t) for n, t, _ in self.blocks if node <= n < self.last[node] and not self.dropped[n])
            more = [(self.tag[n], len(t), linked) for n, t, linked in self.blocks if up <= n < self.last[up] and not node <= n < self.last[node] and not self.dropped[n]]
            if not more or any(2 * linked > size for _, size, linked in more) or sum(size for _, size, _ in more) > own:
                break
            node = up
        return [node]


def _marked(attrs: str) -> tuple[str, int]:
    """The generalised class of a tag, and its mark: 3 if it's hidden, 2 if a class, id or role is made of words for what
    isn't the article, 1 if it has such a word beside others, else 0."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return "", 0
    label, mark = "", 0
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            mark = 3
        elif name in ("class", "id", "role"):
            tokens = value.split()
            if name == "class":
                label = "".join("." + re.sub(r"\d+", "#", t) for t in sorted(tokens))
            for t in tokens:
                words = set(re.split(r"[^a-z]+", t)) - {""}
                if words & NOT_ARTICLE and not {"article", "header"} <= words:
                    mark = max(mark, 2 if words <= NOT_ARTICLE | LAYOUT else 1)
    return label, mark


def best(page: Page, most: int = 3) -> list[tuple[str, float]]:
    """The page's best containers as (path, share of all its running text)."""
    total = sum(len(t) for n, t, _ in page.blocks if not page.dropped[n]) or 1
    by: dict[str, float] = {}
    for node, s in page.scores().items():
        by[page.path[node]] = by.get(page.path[node], 0.0) + s
    return [(p, s / total) for p, s in sorted(by.items(), key=lambda x: (-x[1], -len(x[0]), x[0]))[:most] if s > 0]


def extract(html: str | None, path: str | None, boiler: frozenset[str] = frozenset()) -> str:
    """The text at ``path``, or of the page's best container if it has no such element."""
    if not html:
        return ""
    page = Page(html, boiler)
    nodes = [] if path is None else [n for n, p in enumerate(page.path) if p == path and not page.dropped[n]]
    if not nodes:
        own = best(page, 1)
        nodes = [n for n, p in enumerate(page.path) if own and p == own[0][0] and not page.dropped[n]]
    return page.text_of(page.whole(nodes))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, path, said, votes): what the pages of each host say together; ``said`` is null for a vote, and else the hash
    of a doubtful element's text, with how often it was seen."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "h", 8 << 20):
                rows: dict[tuple[str, str, int | None], int] = {}
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if not content:
                        continue
                    page = Page(content)
                    seen = [(p, None, int(1e6 * s)) for p, s in best(page)] + [(p, int.from_bytes(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=7).digest()), 1) for p, t in page.doubtful()]
                    for p, said, n in seen:
                        rows[name, p, said] = rows.get((name, p, said), 0) + n
                columns = [*zip(*rows)] or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(rows.values(), pa.int64())], ["host", "path", "said", "votes"])

    return pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("h")).mapInArrow(run, "host string, path string, said long, votes long").groupBy("host", "path", "said").agg(F.sum("votes").alias("votes"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` without html, with text and n_chars."""
    told = staged(votes(pages, url, html))
    best_path = told.where("said IS NULL").groupBy("host").agg(F.max_by("path", F.struct("votes", F.length("path"), F.col("path"))).alias("path"))
    # a doubtful element whose most frequent text is on more than one page, and on most that have it, isn't the article
    same = told.where("said IS NOT NULL").groupBy("host", "path").agg(F.max("votes").alias("most"), F.sum("votes").alias("n")).where("most > 1 AND 2 * most > n")
    winners = staged(best_path.join(same.groupBy("host").agg(F.collect_list("path").alias("boiler")), "host", "left"))
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    few = winners.count() <= BROADCAST_ROWS
    joined = pages.select(*[F.col(f"`{c}`") for c in keep], F.col(html).alias("__html"), host_of(F.col(url)).alias("__host"))
    won = winners.select(F.col("host").alias("__won"), F.col("path").alias("__path"), F.col("boiler").alias("__boiler"))
    joined = joined.join(F.broadcast(won) if few else won, F.col("__host") == F.col("__won"), "left").select(*[f"`{c}`" for c in keep], "__html", "__path", "__boiler")
    schema = T.StructType([*joined.schema.fields[: len(keep)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "__html", 8 << 20):
                n = len(keep)
                text = [extract(h, p, frozenset(b or ())) for h, p, b in zip(*(batch.column(n + i).to_pylist() for i in range(3)))]
                yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], [*keep, "text", "n_chars"])

    return joined.mapInArrow(run, schema)
