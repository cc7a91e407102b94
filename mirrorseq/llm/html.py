"""Main text of web pages by a tree-structured graphical model of the DOM."""

from __future__ import annotations

import collections
import html
import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements by their part in a page, and words that names use.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg iframe object".split())
CONTROLS = frozenset("input button select textarea".split())
#: Elements that may close themselves or hold others of their kind.
FOREIGN = frozenset("svg iframe object".split())
BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select button textarea summary table tbody td tfoot th thead tr ul center".split())
CLOSES_ITSELF = frozenset("li dt dd tr td th option thead tbody tfoot".split())
CHROME = frozenset("header footer nav aside form".split())
_ALIKE = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}
SCOPES = frozenset("ul ol dl table select".split())
BOILERPLATE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs header masthead footer copyright sidebar side aside widget related recommended cookie cookies consent gdpr notice alert popup modal overlay share sharing social newsletter subscribe signup login form search comment comments commentlist reply replies respond discussion disqus pagination pager toolbar skip".split())
CONTENT = frozenset("article content post entry story main body text".split())

#: Features of a node repeat each other in part, so each counts for less.
SHARE = 0.5
#: A tag ends at the next < outside of quotes, if it isn't closed before, and
#: is text then; so no part of a page is read over and over.
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*)((?:"[^"]*"|'[^']*'|[^'"<>])*+|[^<>]*)>|<[!?/][^<>]*>""", re.S)
_ENDS = {name: re.compile(rf"</{name}\b[^<>]*>|\Z", re.I) for name in RAW}
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_MARK = re.compile(r"[.!?…。](?=\s|$)")
_LABEL = re.compile(r"""\sy="([01])\"""")
_SPACE = re.compile(r"\s+")


def _step(value: float, limits: tuple[float, ...]) -> int:
    """How many of the limits the value reaches."""
    return sum(value >= x for x in limits)


class Page:
    """The elements of a page in document order, and its runs of text.

    Only block elements and inline elements with a class, id or role are nodes;
    other inline elements belong to the node around them.
    """

    def __init__(self, source: str) -> None:
        self.tag: list[str] = ["#root"]
        self.attributes: list[str] = [""]
        self.parent: list[int] = [0]
        self.runs: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        self.controls: list[int] = []  # nodes around inline form controls
        self.block = 0
        open_tags: list[tuple[str, int]] = [("#root", 0)]
        count = collections.Counter()  # of the open tags, so that no search is in vain

        def close(i: int) -> None:
            nonlocal links
            for t, _ in open_tags[i:]:
                count[t] -= 1
                links -= t == "a"
            del open_tags[i:]

        at = links = 0
        matches = _TAG.scanner(source)
        while m := matches.search():
            if m.start() > at:
                self._text(source[at : m.start()], open_tags[-1][1], links)
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                if name in BLOCKS or name == "br":
                    self.block += name != "br"
                if count[name]:
                    close(next(i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i][0] == name))
                continue
            if name in BLOCKS:
                self.block += 1
                while count["p"] and open_tags[-1][0] not in BLOCKS and len(open_tags) > 1:
                    close(len(open_tags) - 1)
                if open_tags[-1][0] == "p":
                    close(len(open_tags) - 1)
                if name in CLOSES_ITSELF and any(count[t] for t in _ALIKE.get(name, (name,))):
                    for i in range(len(open_tags) - 1, 0, -1):
                        if open_tags[i][0] in SCOPES:
                            break
                        if open_tags[i][0] in _ALIKE.get(name, (name,)):
                            close(i)
                            break
            if name == "br":
                self._text(" ", open_tags[-1][1], links)
            if name in FOREIGN:
                at = self._past(name, m, source)
                matches = _TAG.scanner(source, at)
                continue
            if name == "textarea":
                self.controls.append(open_tags[-1][1])
            if name in RAW:
                end = _ENDS[name].search(source, at)
                at = end.end()
                matches = _TAG.scanner(source, at)
                continue
            node = open_tags[-1][1]
            if name in CONTROLS and name not in BLOCKS:
                self.controls.append(node)
            if name in BLOCKS or _NAMES.search(m[3]):
                self.tag.append(name)
                self.attributes.append(m[3])
                self.parent.append(node)
                node = len(self.tag) - 1
            if name not in VOID and not m[3].endswith("/"):
                open_tags.append((name, node))
                count[name] += 1
                links += name == "a"
        if at < len(source):
            self._text(source[at:], open_tags[-1][1], links)

    @staticmethod
    def _past(name: str, opened: re.Match, source: str) -> int:
        """Where a foreign element ends; elements of its kind may lie within."""
        if opened[3].endswith("/"):
            return opened.end()
        depth = 1
        for m in _TAG.finditer(source, opened.end()):
            if (m[2] or "").lower() == name:
                depth += -1 if m[1] else not m[3].endswith("/")
                if not depth:
                    return m.end()
        return len(source)

    def _text(self, raw: str, node: int, links: int) -> None:
        if not node and not raw.isspace():
            # text outside of all elements is a node of its own, as far as it goes
            if self.tag[-1] != "#text":
                self.tag.append("#text")
                self.attributes.append("")
                self.parent.append(0)
            node = len(self.tag) - 1
        self.runs.append((node, self.block, html.unescape(raw) if "&" in raw else raw, links > 0))

    def evidence(self) -> list[tuple[str, ...]]:
        """What each node shows: its tag and the kind of its names, and the
        structure of its text: size and share of the page's text, links, marks
        at the end of sentences, length of blocks, paragraphs, controls, depth,
        place on the page, its surroundings, and the text of its siblings."""
        n = len(self.tag)
        chars, linked, marks, paragraphs, controls, depth = ([0] * n for _ in range(6))
        before: list[int | None] = [None] * n  # text of the page before the node's own
        blocks: list[set[int]] = [set() for _ in range(n)]
        whole = 0
        for node, block, text, in_link in self.runs:
            size = len(text.strip())
            if size:
                if before[node] is None:
                    before[node] = whole
                blocks[node].add(block)
                marks[node] += len(_MARK.findall(text))
            whole += size
            chars[node] += size
            linked[node] += size * in_link
        n_blocks, own = [len(b) for b in blocks], list(chars)
        for i in range(1, n):
            depth[i] = depth[self.parent[i]] + (self.tag[i] not in ("html", "body"))
            paragraphs[i] += self.tag[i] == "p"
            controls[i] += self.tag[i] in CONTROLS
        for node in self.controls:
            controls[node] += 1
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            for count in (chars, linked, marks, paragraphs, controls, n_blocks):
                count[p] += count[i]
            if before[i] is not None and (before[p] is None or before[i] < before[p]):
                before[p] = before[i]
        # whether a node opens with a heading that names boilerplate
        told_by = ["none"] * n
        opening: dict[int, str] = {}  # first text below a node, empty if it isn't a heading
        for node, _, text, _ in self.runs:
            if text.strip():
                heading = text if self.tag[node] in ("h1", "h2", "h3", "h4", "h5", "h6") else ""
                while node not in opening:
                    opening[node] = heading
                    node = self.parent[node]
        for i, text in opening.items():
            found = re.findall(r"[a-z]+", text[:200].lower()) if len(text) < 200 else []
            told_by[i] = "boilerplate" if 0 < len(found) <= 5 and not BOILERPLATE.isdisjoint(found) else "none"
        largest = [0] * n  # most text among the children
        for i in range(1, n):
            largest[self.parent[i]] = max(largest[self.parent[i]], chars[i])
        out = []
        context = ["none"] * n  # what the nearest telling element at or above says
        for i in range(n):
            names = {w for m in _NAMES.finditer(self.attributes[i]) for w in re.split(r"[^a-z]+", (m[1] or m[2] or m[3] or "").lower())} - {""} if self.attributes[i] else set()
            told = [k for k, known in (("boilerplate", BOILERPLATE), ("content", CONTENT)) if names & known]
            kind = "both" if len(told) == 2 else told[0] if told else "other" if names else "none"
            size = max(1, chars[i])
            around = self.parent[i]
            bare = self.tag[i] == "body" and 2 * own[i] > size  # counts as text outside of elements
            tag, under = ("#text", "body") if bare else (self.tag[i], self.tag[around] if around else "body")
            out.append((
                f"tag {tag}", f"under {under} {tag}", f"name {kind}", f"size {_step(chars[i], (1, 30, 100, 400))}", f"share {_step(chars[i] / max(1, whole), (0.02, 0.1, 0.4, 0.9))}", f"links {_step(linked[i] / size, (0.1, 0.5))}",
                f"marks {_step(100 * marks[i] / size, (0.2, 0.6, 3))}", f"blocks {_step(chars[i] / max(1, n_blocks[i]), (15, 40, 100))}", f"paragraphs {_step(paragraphs[i], (1, 2, 4))}", f"controls {_step(controls[i], (1, 3))}",
                f"opens {told_by[i]}", f"depth {_step(depth[i], (2, 3, 5))}", f"place {_step((before[i] or 0) / max(1, whole), (0.02, 0.2, 0.8))}", f"within {context[around]}", f"siblings {_step(chars[i] / max(1, largest[around]), (0.1, 0.5, 1))}",
            ))
            own_head = self.tag[i] == "header" and self.tag[around] in ("article", "main")  # an article's heading
            by_tag = "boilerplate" if self.tag[i] in CHROME and not own_head else "content" if self.tag[i] in ("article", "main") else ""
            agrees = kind in ("boilerplate", "content") and by_tag in ("", kind)
            if told_by[i] != "none" and kind != "content" and self.tag[i] not in ("html", "body", "main", "article"):
                by_tag = told_by[i]
            context[i] = kind if agrees else by_tag if by_tag and kind != "boilerplate" else context[around]
        return out

    def labels(self) -> list[int]:
        """Training labels: the nearest ``y`` above or at the node; text outside
        of all elements is main text."""
        out = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            m = _LABEL.search(self.attributes[i])
            implied = self.tag[i] == "#text"
            out[i] = int(m[1]) if m else 1 if implied else out[self.parent[i]]
        return out


Model = dict[str, tuple[float, float]]


def train(labelled: DataFrame, column: str = "html") -> Model:
    """Log potentials from pages with ``y`` attributes: each feature given the
    node's label, and each label given its parent's.

    Pages are counted where they are; the driver gets one row a feature.
    """

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("y", T.IntegerType()), T.StructField("feature", T.StringType())])))
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            rows = []
            for source in pages:
                page = Page(source or "")
                y = page.labels()
                rows.append([{"y": y[i], "feature": f} for i, e in enumerate(page.evidence()) for f in (*e, f"parent {y[page.parent[i]]}") if i])
            yield pd.Series(rows)

    counts = labelled.select(F.explode(counted(F.col(column))).alias("c")).groupBy("c.y", "c.feature").count().collect()
    return model_of({(r["y"], r["feature"]): r["count"] for r in counts})


def model_of(by: Mapping[tuple[int, str], int]) -> Model:
    """Log potentials from the number of nodes by (label, feature)."""
    features = sorted({f for _, f in by})
    group = {f: f.split(" ")[0] for f in features}
    total = {(y, g): sum(n for (z, f), n in by.items() if z == y and group[f] == g) for y in (0, 1) for g in set(group.values())}
    model: Model = {}
    for f in features:
        g = group[f]
        if g == "parent":  # P(label | parent's label)
            whole = by.get((0, f), 0) + by.get((1, f), 0) + 1
            model[f] = tuple(math.log((by.get((y, f), 0) + 0.5) / whole) for y in (0, 1))
        else:
            model[f] = tuple(SHARE * math.log((by.get((y, f), 0) + 0.5) / (total[y, g] + 10)) for y in (0, 1))
    return model


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of each node by sum-product over the tree, exact: messages
    go up from the leaves, then down from the root."""
    n = len(page.tag)
    local = [[0.0, 0.0] for _ in range(n)]
    for i, features in enumerate(page.evidence()):
        for f in features if i else ():
            a, b = model.get(f, (0.0, 0.0))
            local[i][0] += a
            local[i][1] += b
    edge = [model.get(f"parent {p}", (math.log(0.5), math.log(0.5))) for p in (0, 1)]

    def add(a: float, b: float) -> float:
        return max(a, b) + math.log1p(math.exp(-abs(a - b)))

    up = [[0.0, 0.0] for _ in range(n)]
    inside = [list(x) for x in local]
    for i in range(n - 1, 0, -1):
        up[i] = [add(edge[p][0] + inside[i][0], edge[p][1] + inside[i][1]) for p in (0, 1)]
        inside[page.parent[i]][0] += up[i][0]
        inside[page.parent[i]][1] += up[i][1]
    belief = [list(x) for x in inside]
    belief[0] = [inside[0][0], -math.inf]  # the root itself isn't content
    out = [0.0] * n
    for i in range(1, n):
        p = page.parent[i]
        rest = [belief[p][x] - up[i][x] for x in (0, 1)]
        for y in (0, 1):
            from_parent = [rest[x] + edge[x][y] for x in (0, 1)]
            belief[i][y] = inside[i][y] + (add(*from_parent) if from_parent[1] > -math.inf else from_parent[0])
        out[i] = 1 / (1 + math.exp(max(-700.0, min(700.0, belief[i][0] - belief[i][1]))))
    return out


def main_text(source: str | None, model: Model, least: float = 0.5) -> str:
    """The blocks of content nodes, white space folded, joined by newlines."""
    page = Page(source or "")
    keep = marginals(page, model)
    blocks: dict[int, list[str]] = {}
    for node, block, text, _ in page.runs:
        if keep[node] >= least:
            blocks.setdefault(block, []).append(text)
    found = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(b for b in found if b)


def extract(df: DataFrame, model: Model, column: str = "html", out: str = "text") -> DataFrame:
    """``df`` with ``out``, the main text of each whole page.

    Defined results: null and empty pages, and pages without content, give an
    empty text; broken markup is read as far as it goes; repeated rows, ties and
    an empty table stay.  A column named ``out`` is replaced, all others are
    kept.  Pages are handled one by one, without a shuffle.
    """

    @F.pandas_udf(T.StringType())
    def texts(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([main_text(p, model) for p in pages], dtype=object)

    return df.withColumn(out, texts(F.col(column)))
