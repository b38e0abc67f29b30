"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of tags and words. Tags score negative, each name by how much rarer it
is inside main text than outside; words score positive by a logistic model's log-odds for
the block they stand in, or nothing if these are negative. Both are learned from labelled
pages. One linear scan finds the contiguous region of the largest sum, so that short blocks
beyond the tags that end an article stay out, unless what follows outweighs these tags. Of the
region, blocks whose words score nothing (an advert inside the article) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, tune
from .html_pages import PAGES

_TOKEN = re.compile(
    r"""<!--(?P<note>.*?)(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)
    |<(?P<raw>script|style|template|textarea|title|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*(?:>.*?(?:</(?P=raw)\b[^>]*(?:>|\Z)|\Z)|\Z)
    |<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>
    |<[/!?]?[a-z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S | re.I | re.X,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_HINT = re.compile(r"[a-z]+")
#: Elements without content, elements inside a line, and those that close an open paragraph or their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
SAME = frozenset("li dd dt td th tr option p".split())
SCOPE = frozenset("article aside body div footer form header main nav section table ul ol dl menu".split())
#: Elements whose content isn't shown as text; the first two end where a block begins.
UNSEEN = frozenset("svg select object canvas audio video datalist".split())
BROKEN_OFF = frozenset("svg select".split())
#: A word scores CLAMP at most.
CLAMP = 1.0


class Block:
    """A run of text between block boundaries: features, words, tags before it, offsets."""

    __slots__ = ("features", "text", "n_words", "tags", "start", "end", "label")

    def __init__(self, features, text, n_words, tags, start, end, label):
        self.features, self.text, self.n_words, self.tags = features, text, n_words, tags
        self.start, self.end, self.label = start, end, label


def _features(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name = name.lower()
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value.strip("\"'")).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            out.append(".hidden")
        elif name in ("class", "id", "role"):
            out += [f".{x}" for x in _HINT.findall(value)]
    return tuple(out)


class _Open:
    """Open elements, and the features they give; each step takes about the same time, however
    many elements a page leaves open."""

    def __init__(self, known):
        self.known, self.stack, self.places = known, [], {}
        self.scopes, self.active, self.names = [], {}, None

    def push(self, tag: str, features: tuple[str, ...]):
        if tag in ("html", "body"):
            features = ()
        elif self.known is not None:
            features = tuple(f for f in features if f in self.known)
        place = len(self.stack)
        self.stack.append((tag, features))
        self.places.setdefault(tag, []).append(place)
        if tag in SCOPE:
            self.scopes.append(place)
        for f in features:
            n = self.active.get(f, 0)
            self.active[f] = n + 1
            if not n:
                self.names = None

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that name; -1: none."""
        own = self.places.get(tag)
        return own[-1] if own else -1

    def cut(self, place: int):
        """Closes the element at that place and all inside it."""
        while len(self.stack) > place:
            tag, features = self.stack.pop()
            self.places[tag].pop()
            if tag in SCOPE:
                self.scopes.pop()
            for f in features:
                self.active[f] -= 1
                if not self.active[f]:
                    del self.active[f]
                    self.names = None

    def close(self, tag: str):
        if self.has(tag):
            self.cut(self.last(tag))

    def implied(self, tags):
        """Closes the innermost of these elements, if no scope lies in between."""
        place = max(map(self.last, tags))
        if place > (self.scopes[-1] if self.scopes else -1):
            self.cut(place)

    def features(self) -> frozenset:
        if self.names is None:
            self.names = frozenset(self.active)
        return self.names


def blocks(page: str, labels: bool = False, known: frozenset | dict | None = None) -> list[Block]:
    """The page's text blocks in order; references decoded, white space collapsed.

    labels: comments <!--+--> and <!----> begin and end main text (labelled pages only).
    known: features that matter; by default all.
    """
    out: list[Block] = []
    open_, parts, tags = _Open(known), [], []
    start = end = links = 0
    label = False

    def flush():
        nonlocal tags, links
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            n = text.count(" ") + 1
            shape = ("links" if 2 * links > n else "plain", "short" if n < 5 else "long" if n > 15 else "middle")
            out.append(Block(open_.features().union(shape), text, n, tags, start, end, label))
            tags = []
        links = 0

    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            if not parts:
                start = m.start()
            parts.append(text)
            end = m.end()
            if open_.has("a"):
                links += len(text.split())
            continue
        tag = m["tag"]
        if tag is None:
            if labels and m["note"] in ("+", ""):
                flush()
                label = m["note"] == "+"
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        tags.append("/" + tag if m["end"] else tag)
        if m["end"]:
            open_.close(tag)
            continue
        if tag not in INLINE:
            for x in BROKEN_OFF:
                if tag not in ("option", "optgroup") and open_.last(x) > (open_.scopes[-1] if open_.scopes else -1):
                    open_.close(x)
            open_.implied((tag, "p") if tag in SAME else ("p",))  # an open paragraph, or its own like
        elif tag in SAME:
            open_.implied((tag, "p"))
        if tag not in VOID and not m["attrs"].endswith("/"):
            open_.push(tag, (*_features(tag, m["attrs"]), *((".hidden",) if tag in UNSEEN else ())))
    flush()
    return out


class Weights:
    """Log-odds of a block's words by feature, and the scores of tags; from labelled pages."""

    def __init__(self, pages: Sequence[str] = PAGES, l2: float = 0.005, steps: int = 20):
        read = [blocks(p, labels=True) for p in pages]
        seen = [b for own in read for b in own]
        count = Counter(f for b in seen for f in b.features)
        names = sorted(count)
        at = {f: i for i, f in enumerate(names)}
        x = np.zeros((len(seen), len(names) + 1))
        x[:, -1] = 1
        for i, b in enumerate(seen):
            x[i, [at[f] for f in b.features]] = 1
        y = np.array([b.label for b in seen], float)
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
        ridge[-1] = 1e-6
        for _ in range(steps):  # Newton steps of a ridge-penalised logistic regression
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (p - y) + ridge * w)
        self.by = {f: float(w[i]) for f, i in at.items()} | {".hidden": -1e3}
        self.bias = float(w[-1])
        self.cache: dict[frozenset, float] = {}
        # What a tag weighs against a word: where it leads out of an element, or into one that
        # stays open; and as an element that opens and ends in between.
        tags, best = self._tags(read), -1
        for across in (0.1, 0.2, 0.3, 0.45, 0.6, 0.8, 1.0):
            for through in (0.02, 0.05, 0.1, 0.2, 0.4, 0.8):
                self.across, self.through = ({t: scale * x for t, x in tags.items()} for scale in (across, through))
                right = sum(self.region(own)[2] == [i for i, b in enumerate(own) if b.label] for own in read)
                if right > best:
                    best, chosen = right, (self.across, self.through)
        self.across, self.through = chosen

    def region(self, found: Sequence[Block], scan: bool = True) -> tuple[int, int, list[int], float]:
        """The best region [a, b) of a page's blocks, those of it that score, and its score.
        Without the scan: all that score."""
        each = [self.word(b.features) for b in found]
        a, b, top = best_region([(gap, s * x.n_words) for x, s, gap in zip(found, each, self.gaps(found, each), strict=True)]) if scan else (0, len(found), 0.0)
        return a, b, [i for i in range(a, b) if each[i] > 0], top

    @staticmethod
    def _tags(read, least: float = -4.0) -> dict[str, float]:
        """Per tag name the log ratio of its densities (tags a block) inside main text, from
        its first to its last block, and elsewhere; at least `least` and at most 0."""
        inside, outside, n = Counter(), Counter(), [1, 1]
        for own in read:
            main = [i for i, b in enumerate(own) if b.label]
            for i, b in enumerate(own):
                within = bool(main) and main[0] < i <= main[-1] and b.label and own[i - 1].label
                (inside if within else outside).update(t.lstrip("/") for t in b.tags)
                n[not within] += 1
        return {t: min(0.0, max(least, math.log((inside[t] + 0.5) / n[0] / ((outside[t] + 0.5) / n[1])))) for t in inside | outside}

    def word(self, features: frozenset) -> float:
        """Score of each word of a block with these features; 0: not main text."""
        s = self.cache.get(features)
        if s is None:
            s = self.bias + sum(self.by.get(f, 0.0) for f in features)
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[features] = s = max(0.0, min(CLAMP, s))
        return s

    def gaps(self, found: Sequence[Block], words: Sequence[float]) -> list[float]:
        """Of each block the score of the tags since the last block that scores.

        An element that opens and ends in between counts once, whatever is in it: an advert
        doesn't part the article more by being long. Tags that lead out of elements, or into
        those that are still open, count each.
        """
        across, through, out = self.across.get, self.through.get, []
        inner, opened, count = [0.0], [], Counter()  # scores by depth, and the elements open
        for b, s in zip(found, words, strict=True):
            for t in b.tags:
                if t[0] != "/":
                    if t in VOID:
                        inner[-1] += through(t, -0.05)
                    else:
                        opened.append(t)
                        inner.append(0.0)
                        count[t] += 1
                elif count[t[1:]]:
                    while True:
                        last = opened.pop()
                        inner.pop()
                        count[last] -= 1
                        if last == t[1:]:
                            break
                    inner[-1] += through(last, -0.05)
                else:
                    inner[-1] += across(t[1:], -0.1)
            if s > 0:
                out.append(sum(inner) + sum(across(t, -0.1) for t in opened))
                inner, opened, count = [0.0], [], Counter()
            else:
                out.append(0.0)
        return out


def best_region(scores: Sequence[tuple[float, float]]) -> tuple[int, int, float]:
    """First contiguous range [a, b) with the largest sum, for (gap before, value) pairs.

    The gap before the first member doesn't count. No positive value: (0, 0, 0.0).
    """
    best, a, sum_, top = (0, 0), 0, 0.0, 0.0
    for i, (gap, value) in enumerate(scores):
        if sum_ + gap > 0:
            sum_ += gap + value
        else:
            a, sum_ = i, value
        if sum_ > top:
            best, top = (a, i + 1), sum_
    return *best, top


def extract(page: str | None, weights: Weights) -> tuple[str, int, int, float]:
    """Main text, its region's offsets in the page, and the region's score."""
    found = blocks(page or "", known=weights.by)
    a, b, own, top = weights.region(found)
    if a == b:
        return "", 0, 0, 0.0
    return " ".join(found[i].text for i in own), found[a].start, found[b - 1].end, top


def html_extract(pages: DataFrame, html_col: str = "html", labelled: Sequence[str] = PAGES) -> DataFrame:
    """Rows of `pages` with a struct column `main` added (or in place of one so named).

    main: text, n_chars (code points), start and end (the region's offsets in the page),
    score. Null and empty pages, and pages without text that scores positive, give empty
    text. Broken markup is read as browsers do, roughly; whole pages are read whatever
    their length. Repeated rows give repeated results; an empty table gives no rows.
    """
    tune(pages.sparkSession)
    weights = Weights(labelled)
    out = pages.withColumn("main", F.lit(None).cast("struct<text:string,n_chars:long,start:long,end:long,score:double>"))
    at, put = pages.columns.index(html_col), out.columns.index("main")
    kind = pa.struct([("text", pa.string()), ("n_chars", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            rows = []
            for page in batch.column(at):
                text, start, end, score = extract(page.as_py(), weights)
                rows.append({"text": text, "n_chars": len(text), "start": start, "end": end, "score": score})
            columns = list(batch.columns)
            columns[put] = pa.array(rows, kind)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return out.mapInArrow(run, out.schema)


def op8_html_extract(spark, sf_dir):
    """Main text of every page of `pages`; edge cases as html_extract() says."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract(pages).select("page_id", "url", F.col("main.text").alias("text"), F.col("main.n_chars").alias("n_chars"))
