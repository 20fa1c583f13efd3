"""Main text of web pages by a graphical model on the DOM tree.

Each block element is main text or not. Its potential comes from what it is (tag, names, its own text and links), and
a potential ties it to its parent. Both are estimated from labelled pages. Messages go from the leaves up and from the
root down (sum-product, exact on a tree), which gives each element's marginal given the whole page.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import labelled_pages
from loomwork.llm.common import TEXT_ROWS, stage
from loomwork.llm.dom import Node, parse

#: Labelled pages to train on: a fixed number.
PAGES = 600
SMOOTH = 0.5
#: Elements of one kind say much the same: beyond so many of a tag under one parent, their potentials and those of all below
#: them are scaled down to what so many would say together.
CROWD = 4
#: Words in classes, ids and roles, by what they tell.
HINTS = {
    "ad": "ad ads adv advert advertisement advertising banner sponsor sponsored promo promoted promotion doubleclick",
    "menu": "menu nav navbar navigation topnav breadcrumb breadcrumbs crumbs pagination pager tabs toc",
    "side": "sidebar side widget aside rail complementary",
    "edge": "footer foot header masthead topbar contentinfo copyright colophon",
    "comment": "comment comments reply replies respond disqus discussion reader",
    "notice": "cookie cookies consent notice alert popup modal gdpr overlay banner-notice paywall",
    "share": "share sharing social related recommended recommendations more tags newsletter subscribe subscription",
    "form": "form login signin signup register search searchbox",
    "main": "article content post entry story main body text maincontent",
}
_HINT = {w: k for k, words in HINTS.items() for w in words.split()}
_ENDS = ".!?:;\"'»”…。"
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_GROUP = {t: t for t in "html body article main section div p ul ol li nav aside header footer form table pre blockquote figure".split()}
_GROUP |= {f"h{k}": "h1" if k == 1 else "h" for k in range(1, 7)} | dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot", "caption"), "cell")
_GROUP |= dict.fromkeys(("dl", "dt", "dd"), "dl") | dict.fromkeys(("figcaption",), "figure") | dict.fromkeys(("dialog", "fieldset", "menu", "search"), "widget")


def features(node: Node) -> list[str]:
    hints = {_HINT[w.lower()] for w in _PART.findall(node.names) if w.lower() in _HINT} if node.names else ()
    named = "" if not hints or node.tag not in ("article", "main", "div", "section") else "/" + ("main" if hints == {"main"} else "other")
    out = ["tag:" + _GROUP.get(node.tag, node.tag if node.tag == "#page" else "other") + named]
    out += sorted("hint:" + h for h in hints) or ["hint:none"]
    size = sum(len(t) for _, t, _ in node.texts)
    if size:
        share = sum(n for *_, n in node.texts) / size
        links = "all" if share > 0.8 else "many" if share > 0.4 else "few"
        text = f"{min(4, int(math.log(size + 1, 6)))} {links} {int(node.texts[-1][1][-1:] in _ENDS)}"
    else:
        text = "none"
    return [*out, f"text of {out[0][4:]}:{text}"]  # given the tag and the label


@dataclass
class Model:
    """Log potentials: for a feature [other, main], for a parent's and child's label, and for the page."""

    feature: dict[str, tuple[float, float]]
    tie: tuple[tuple[float, float], tuple[float, float]]
    root: tuple[float, float]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability that each element is main text, by sum-product on the tree."""
        none = (0.0, 0.0)
        own = []
        crowd = Counter((node.parent, node.tag) for node in nodes)
        shares: list[float] = []
        for k, node in enumerate(nodes):
            a = b = 0.0
            for f in features(node):
                x, y = self.feature.get(f, none)
                a += x
                b += y
            share = min(1.0, CROWD / crowd[node.parent, node.tag]) * (shares[node.parent] if k else 1.0)
            shares.append(share)
            own.append([a * share, b * share])
        own[0][0] += self.root[0]
        own[0][1] += self.root[1]
        up = [list(x) for x in own]  # own potential times the messages of the children
        sent = [none] * len(nodes)
        for k in range(len(nodes) - 1, 0, -1):
            a, b = up[k]
            m0, m1 = (_sum(a + self.tie[x][0], b + self.tie[x][1]) for x in (0, 1))
            top = max(m0, m1)
            sent[k] = (m0 - top, m1 - top)
            at = up[nodes[k].parent]
            at[0] += sent[k][0]
            at[1] += sent[k][1]
        down = [none] * len(nodes)
        out = []
        for k, node in enumerate(nodes):
            if k:
                p = node.parent
                a = up[p][0] - sent[k][0] + down[p][0]
                b = up[p][1] - sent[k][1] + down[p][1]
                m0, m1 = (_sum(a + self.tie[0][x], b + self.tie[1][x]) for x in (0, 1))
                top = max(m0, m1)
                down[k] = (m0 - top, m1 - top)
            x, y = up[k][0] + down[k][0], up[k][1] + down[k][1]
            out.append(1.0 / (1.0 + math.exp(min(700.0, max(-700.0, x - y)))))
        return out


def _sum(a: float, b: float) -> float:
    top = max(a, b)
    return top + math.log(math.exp(a - top) + math.exp(b - top))


def train(pages: list[str]) -> Model:
    """Counts of features and of parent-child labels over labelled pages (``data-label`` holds for what is below)."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    totals: list[Counter] = [Counter(), Counter()]
    ties = [[SMOOTH, SMOOTH], [SMOOTH, SMOOTH]]
    roots = [SMOOTH, SMOOTH]
    for page in pages:
        nodes = parse(page)
        labels: list[int] = []
        for k, node in enumerate(nodes):
            above = labels[node.parent] if k else 0
            label = int(node.label) if node.label in ("0", "1") else above
            labels.append(label)
            if k:
                ties[above][label] += 1
            else:
                roots[label] += 1
            for f in features(node):
                seen[label][f] += 1
                totals[label][f.split(":")[0]] += 1
    names = set(seen[0]) | set(seen[1])
    width = Counter(f.split(":")[0] for f in names)
    potential = {}
    for f in names:
        kind = f.split(":")[0]
        potential[f] = tuple(
            math.log((seen[x][f] + SMOOTH) / (totals[x][kind] + SMOOTH * width[kind])) for x in (0, 1)
        )
    tie = tuple(tuple(math.log(n / sum(row)) for n in row) for row in ties)
    return Model(potential, tie, tuple(math.log(n / sum(roots)) for n in roots))


def main_text(page: str | None, model: Model) -> str:
    """Blocks of elements that are main text with a probability over one half, in page order, a line each."""
    if not page:
        return ""
    nodes = parse(page)
    found = model.marginals(nodes)
    blocks = [(at, text) for node, p in zip(nodes, found) if p > 0.5 and not node.hidden for at, text, _ in node.texts]
    return "\n".join(text for _, text in sorted(blocks))


def extract(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text (empty if none), n_chars (its code points).

    Whole pages are read; a null or empty html gives an empty text, as does a page without main text. Broken markup
    gives what can be told of it. Every row, repeated ones too, gives one row.
    """
    model = train(labelled_pages.pages(PAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, model) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
    return stage(out, "articles", TEXT_ROWS)
