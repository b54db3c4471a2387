"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

TEXTS = "page_id long, url string, text string, n_chars long, n_blocks int, n_kept int"

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_MARK = re.compile(r"[>\"']")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "xmp"}
_BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
_NESTED = frozenset("article aside blockquote button details dialog div dl fieldset figure footer form header main menu nav ol section select span svg table ul".split())
_BOILER = frozenset("aside button dialog footer form header menu nav select svg fieldset".split())
_MAIN = frozenset(("article", "main"))
#: Words of class, id and role attributes that mark a container as not being the article.
_HINTS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related remark reply replies respondent share sharing sidebar social sponsor sponsored subscribe subscription tags toolbar widget alert complementary contentinfo search".split()
)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "boiler", "article")
#: Labelled blocks: words and link density in per cent of the block, the one before and the one after; whether a
#: container of it is boilerplate by its tag or names; whether it is inside an article; 1 for main text.
LABELLED = """
6 0 0 0 80 0 0 1 1|80 0 6 0 60 0 0 1 1|1 0 60 0 90 0 0 1 1|3 0 1 0 2 0 0 1 1|2 0 40 0 0 0 0 1 1|12 10 70 0 55 3 0 1 1|9 20 3 0 200 0 0 1 1|150 4 90 1 20 0 0 1 1
1 0 1 0 1 0 0 1 1|7 0 1 100 300 0 0 1 1|30 0 8 0 8 0 0 1 1|4 0 7 0 20 0 0 1 1|500 1 30 0 8 0 0 1 1|5 0 60 0 12 60 0 1 1|22 30 40 0 40 0 0 1 1|2 0 2 0 2 0 0 1 1
1 100 1 100 1 100 0 1 0|3 100 90 0 2 100 0 1 0|4 90 4 100 4 100 0 1 0|2 100 60 0 0 0 0 1 0|8 80 3 100 6 90 0 1 0
1 100 0 0 1 100 1 0 0|1 100 1 100 1 100 1 0 0|1 100 1 100 8 0 1 0 0|8 0 1 100 10 0 1 0 0|6 0 1 100 70 0 1 0 0|12 0 80 0 0 0 1 0 0|40 0 80 0 3 0 1 0 0|120 0 60 0 70 0 1 0 0
9 0 90 0 0 0 1 0 0|15 0 12 0 12 0 1 1 0|30 0 70 0 60 0 1 1 0|60 2 3 100 9 0 1 1 0|5 0 100 0 200 0 1 1 0|4 100 30 0 80 0 1 1 0|200 0 5 0 12 0 1 1 0|1 0 1 0 1 0 1 1 0
90 0 60 0 50 0 0 0 1|45 3 70 0 30 0 0 0 1|25 5 60 0 45 0 0 0 1|200 1 5 0 40 0 0 0 1|60 0 4 0 3 0 0 0 1|18 0 60 0 70 0 0 0 1|20 10 50 5 90 0 0 0 1|35 20 30 0 30 0 0 0 1
1 100 0 0 1 100 0 0 0|2 100 1 100 1 100 0 0 0|3 0 1 100 4 0 0 0 0|5 0 3 0 8 0 0 0 0|8 0 4 0 3 0 0 0 0|12 60 3 100 4 80 0 0 0|20 70 10 60 12 50 0 0 0|6 0 2 100 6 100 0 0 0
30 60 20 50 10 40 0 0 0|4 0 6 0 2 0 0 0 0|7 30 9 40 3 0 0 0 0|10 0 1 100 2 100 0 0 0|60 80 30 70 20 90 0 0 0|2 0 12 0 0 0 0 0 0|9 0 0 0 1 100 0 0 0
"""


class Tree:
    """A binary decision tree grown by the Gini index, as nested tuples (feature, threshold, low, high) or 0/1."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 6):
        self.root = self._grow(rows, labels, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        p, best = y.mean(), None
        if depth and 0 < p < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for t in ((values[:-1] + values[1:]) / 2).tolist():
                    low = x[:, f] <= t
                    a, b = y[low], y[~low]
                    impurity = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, t, low)
        if best is None:
            return int(p >= 0.5)
        _, f, t, low = best
        return f, t, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1)

    def __call__(self, row: tuple) -> int:
        node = self.root
        while not isinstance(node, int):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node


def train() -> Tree:
    rows = np.array([[float(v) for v in row.split()] for row in LABELLED.replace("\n", "|").split("|") if row.strip()])
    rows[:, 1:6:2] /= 100
    return Tree(rows[:, :-1], rows[:, -1])


class _Ends:
    """Where tags end: at the next ``>`` outside quotes, or, where a quote is never closed, at the next ``>`` of all.

    All ends come from one pass over the page's signs from behind, so a tag without an end costs
    what any other costs.
    """

    def __init__(self, html: str):
        self.at = [m.start() for m in _MARK.finditer(html)]
        n = len(self.at)
        self.outside, self.any = [-1] * (n + 1), [-1] * (n + 1)
        quotes = {"\"": -1, "'": -1}
        for i in range(n - 1, -1, -1):
            sign = html[self.at[i]]
            if sign == ">":
                self.outside[i] = self.any[i] = self.at[i]
            else:
                self.any[i] = self.any[i + 1]
                if quotes[sign] >= 0:
                    self.outside[i] = self.outside[quotes[sign] + 1]
                quotes[sign] = i

    def after(self, place: int, quoted: bool = True) -> int:
        """The sign that ends a tag whose attributes begin at ``place``, or -1."""
        i = bisect_left(self.at, place)
        return self.outside[i] if quoted and self.outside[i] >= 0 else self.any[i]


@cache
def _closing(name: str) -> re.Pattern:
    return re.compile(f"</{name}(?![a-z0-9])", re.I)


def blocks(html: str) -> list[tuple[str, int, float, int, int]]:
    """Text blocks in page order: text, words, link density, inside boilerplate, inside an article.

    One pass; the work grows with the length of the page, whatever its markup. A link ends with
    its end tag, with the next link, or with the container in which it began.
    """
    out: list[tuple[str, int, float, int, int]] = []
    parts: list[str] = []
    linked: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    named: Counter = Counter()  # how many of each name are in the stack
    ends = _Ends(html)
    boiler = article = at = 0
    link = -1  # depth of the stack where the open link began
    n = len(html)

    def close() -> None:
        text = " ".join("".join(parts).split()) if parts else ""
        if text:
            words = text.count(" ") + 1
            inside = len(" ".join(linked).split()) if linked else 0
            out.append((text, words, min(1.0, inside / words), int(boiler > 0), int(article > 0)))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        if text:
            text = unescape(text)
            parts.append(text)
            if link >= 0:
                linked.append(text)

    while at < n:
        start = html.find("<", at)
        if start < 0:
            say(html[at:])
            break
        m = _TAG.match(html, start)
        if m is None and html.startswith("<!--", start):
            say(html[at:start])
            at = n if (end := html.find("-->", start + 2)) < 0 else end + 3
            continue
        declaration = m is None and html.startswith(("<!", "<?"), start)
        stop = -1 if m is None and not declaration else ends.after(start + 2 if declaration else m.end(), not declaration)
        if stop < 0:  # a lone sign
            say(html[at : start + 1])
            at = start + 1
            continue
        say(html[at:start])
        at = stop + 1
        if declaration:
            continue
        name, ending, attributes = m[2].lower(), bool(m[1]), html[m.end() : stop]
        if name in _RAW and not ending:
            if not attributes.endswith("/"):
                end = _closing(name).search(html, at)
                at = n if end is None or (stop := html.find(">", end.end())) < 0 else stop + 1
            continue
        if name == "a":
            link = -1 if ending else len(stack)
        elif name == "br":
            parts.append(" ")
        if name in _BLOCKS:
            close()
        if name in _NESTED:
            if not ending:
                inside = article > 0
                bad = name in _BOILER and not (name == "header" and inside)
                if attributes and not bad and name not in _MAIN:
                    said = " ".join("".join(x) for x in _NAMES.findall(attributes)).lower()
                    bad = bool(said) and not _HINTS.isdisjoint(re.split(r"[^a-z]+", said))
                if not attributes.endswith("/"):
                    stack.append((name, bad, name in _MAIN))
                    named[name] += 1
                    boiler += bad
                    article += name in _MAIN
            elif named[name]:
                while True:
                    other, bad, main = stack.pop()
                    named[other] -= 1
                    boiler -= bad
                    article -= main
                    if other == name:
                        break
                if link > len(stack):
                    link = -1
    close()
    return out


def main_text(html: str | None, tree: Tree) -> tuple[str, int, int]:
    """The kept blocks, joined by line ends, the number of blocks and of those kept."""
    found = blocks(html or "")
    edge = ("", 0, 0.0, 0, 0)
    kept = [b[0] for a, b, c in zip([edge, *found], found, [*found[1:], edge], strict=False) if tree((b[1], b[2], a[1], a[2], c[1], c[2], b[3], b[4]))]
    return "\n".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of each page (page_id, url, html), from the whole html, within the task that reads it.

    A page becomes flat blocks between block-level tags. A decision tree, grown on the labelled
    table above when the query is made, keeps or drops a block by its words and link density,
    those of its neighbours, and whether its containers name it boilerplate or an article. A null
    or empty html, or one without text, gives an empty text; repeated rows give repeated results.
    """
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [main_text(h, tree) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], [x.split()[0] for x in TEXTS.split(", ")])

    return pages.select("page_id", "url", "html").mapInArrow(run, TEXTS)
