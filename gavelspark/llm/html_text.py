"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words have a score from what they stand in (elements, and words of their class, id and role; of what is around an article, only what sets it apart, as a sidebar or comments do); tags score below zero. Both kinds of weights are learnt from labelled pages. A text whose words score below zero (an advert, a form, comments amid the text) costs NODE at most, so that it does not cut a text in two. One linear scan finds the contiguous region with the greatest sum; in it, words of negative score are left out.

A page is read in one pass whose work grows in proportion to it, however it is nested or cut off: features are kept on the stack of open elements, and an attribute's open quote is looked past once a page.

Defined results: null html is the empty page; a page without a word of positive score has the empty text. The whole html is read. Scripts, styles, noscript and their like are left out up to their end tags, as are elements with `hidden`, or a style that does not show them. Character references are decoded; white space inside a block becomes one space; blocks are joined by one line feed; a line break (br) is white space. Repeated rows are read each. An empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, table
from .labelled_pages import BOILERPLATE, CONTENT, labelled_pages

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STEP = re.compile(r"""[^>=]*(?:(=\s*["'])|(>)|=)""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "math", "object", "noembed", "noframes", "xmp")}
#: Raw elements that a slash at their tag's end closes.
_FOREIGN = ("svg", "math")
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*(?:false|until-found))", re.I)
_UNSHOWN = re.compile(r"""\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)\b(?:display\s*:\s*none|visibility\s*:\s*hidden)\b""", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = set("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that say something about their words by themselves; others count for the words of their class, id and role.
_TELLING = set("a article aside button footer form head header label legend main menu nav select dialog h1 fieldset option".split())
_OFF = {f"hint:{w}" for words in BOILERPLATE.values() for w in words.split()} - {f"hint:{w}" for w in CONTENT}
#: What an article may stand in that makes it a teaser or a comment; other elements around it, a form or a label of the whole page, say nothing.
_APART = {*_OFF, "in:aside", "in:nav", "in:footer", "in:menu", "in:dialog"}
#: A name with one of these words says whether something is there, not what the element is ("post-comments-enabled").
_SWITCHES = set("has no with without enabled disabled allowed count".split())
#: The most that a text of negative words takes from a region.
NODE = 1.0


def _features(tag: str, attributes: str, known: dict | None) -> tuple[str, ...]:
    out = [f"in:{tag}"] * (tag in _TELLING)
    for m in _NAMES.finditer(attributes) if attributes else ():
        for name in (m[1] or m[2] or m[3] or "").split():
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if not _SWITCHES.intersection(words):
                out += [f"hint:{w}" for w in words]
    return tuple(dict.fromkeys(f for f in out if known is None or f in known or f in _APART))


def tokens(html: str, known: dict | None = None) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """("text", decoded text, features of what is around it) and ("tag", name, ()); closing tags have the same name. known: the only features that matter (and what sets an article apart); all if None."""
    read = list(_read(html, known))
    roots = any(kind == "root" for kind, _, _, _ in read)
    for kind, x, features, own in read:
        if kind != "root":
            yield kind, x, (*features, "outside") if kind == "text" and roots and not own else features


def _hidden(attributes: str) -> bool:
    """Whether an element is there but not shown: by the attribute of that name (not by a value that holds the word), or by its style."""
    low = attributes.lower()
    return ("hidden" in low and bool(_HIDDEN.search(_QUOTED.sub('=""', attributes)))) or ("style" in low and bool(_UNSHOWN.search(attributes)))


class _Open:
    """Open elements. Each has the features of all around it from the innermost article on, those that set things apart of what is above that, and whether there is an article."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...], bool]] = []
        self.places: dict[str, list[int]] = {}
        self.hidden: int | None = None  # place of the outermost hidden element

    def around(self) -> tuple[tuple[str, ...], bool]:
        return (self.stack[-1][1], self.stack[-1][3]) if self.stack else ((), False)

    def push(self, tag: str, fs: tuple[str, ...]) -> bool:
        """True if this begins an article that nothing sets apart."""
        _, now, apart, own = self.stack[-1] if self.stack else ("", (), (), False)
        begins = tag in ("article", "main") and not _OFF.intersection(fs)
        now = tuple(dict.fromkeys([*apart, *fs])) if begins else tuple(dict.fromkeys([*now, *fs])) if fs else now
        apart = tuple(dict.fromkeys([*apart, *(f for f in fs if f in _APART)])) if fs else apart
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, now, apart, own or begins))
        return tag in ("article", "main") and not apart

    def pop(self) -> None:
        self.places[self.stack.pop()[0]].pop()
        if self.hidden == len(self.stack):
            self.hidden = None

    def close(self, tag: str) -> None:
        if at := self.places.get(tag):
            for _ in range(len(self.stack) - at[-1]):
                self.pop()


def _tag_end(html: str, at: int, quoted: bool) -> tuple[int, bool]:
    """Where the tag's > is from `at`, -1 if there is none; and whether quoted values are still looked past. A quote that never ends, or has no > behind it, is an ordinary character, here and in the rest of the page."""
    pos = at
    while quoted:
        m = _STEP.match(html, pos)
        if not m:
            break
        if m[2]:
            return m.end() - 1, True
        pos = m.end()
        if m[1]:
            pos = html.find(m[1][-1], pos) + 1
            if not pos:
                break
    return html.find(">", at), False


def _read(html: str, known: dict | None) -> Iterator[tuple[str, str, tuple[str, ...], bool]]:
    """tokens() without what depends on the whole page: each with whether it is in an article or main of its own, and ("root", name, ...) where one opens that does not stand apart."""
    opened, at, start, quoted = _Open(), 0, 0, True
    text = lambda end: [("text", unescape(html[start:end]), *opened.around())] if end > start and opened.hidden is None else []
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at):
            yield from text(at)
            end = html.find("-->", at + 4)
            at = start = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith("<![CDATA[", at):
            yield from text(at)
            end = html.find("]]>", at)
            if opened.hidden is None:
                yield "text", html[at + 9 : end if end >= 0 else len(html)], *opened.around()
            at = start = end + 3 if end >= 0 else len(html)
            continue
        m = _TAG.match(html, at)
        if not m and html[at + 1 : at + 2] not in ("!", "?"):
            at += 1
            continue
        end, quoted = _tag_end(html, m.end(), quoted) if m else (html.find(">", at), quoted)
        if end < 0:  # no tag ends any more
            break
        yield from text(at)
        at = start = end + 1
        if not m:
            continue
        closing, tag, attributes = m[1], m[2].lower(), html[m.end() : end]
        if tag in _RAW and not closing:
            if not (tag in _FOREIGN and attributes.endswith("/")):
                stop = _RAW[tag].search(html, at)
                at = start = stop.end() if stop else len(html)
            continue
        if opened.hidden is None:
            yield "tag", tag, (), False
        if closing:
            opened.close(tag)
        elif tag not in _VOID and tag not in ("html", "body"):
            if tag == "a" or tag in _BLOCK:
                while opened.stack and opened.stack[-1][0] in ("a", "p") and (opened.stack[-1][0] == "p" or tag == "a"):
                    opened.pop()
            fs = _features(tag, attributes, known)
            if attributes and opened.hidden is None and _hidden(attributes):
                opened.push(tag, fs)
                opened.hidden = len(opened.stack) - 1
            elif (fs or tag in _BLOCK - {"p", "li", "tr", "td", "th", "dd", "dt", "option"} or opened.hidden is not None) and opened.push(tag, fs) and opened.hidden is None:
                yield "root", tag, (), True
    yield from text(len(html))


Weights = dict[str, float]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[tuple[str, bool], int] = {}
    for b in batches:
        for html in b.column("html"):
            inside = False
            for kind, x, features in tokens(html.as_py()):
                if kind == "tag" and x == "x-main":
                    inside = not inside
                    continue
                key = ("w " + " ".join(features) if kind == "text" else f"t {x}", inside)
                seen[key] = seen.get(key, 0) + (len(x.split()) if kind == "text" else 1)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.string()), pa.array([i for _, i in seen], pa.bool_()), pa.array(seen.values(), pa.int64())], ["kind", "inside", "n"])


def fit(labelled: DataFrame, rounds: int = 4000, ridge: float = 3e-5) -> Weights:
    """From a column html with <x-main> marks. Words: logistic regression on their features ("" is the constant); tags: log-odds, -0.02 at most."""
    rows = labelled.select("html").mapInArrow(_tally, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).toArrow().to_pylist()
    names = sorted({f for r in rows if r["kind"][0] == "w" for f in r["kind"].split()[1:]})
    at = {f: i + 1 for i, f in enumerate(names)}
    words = [r for r in sorted(rows, key=lambda r: (r["kind"], r["inside"])) if r["kind"][0] == "w" and r["n"]]
    x, y, n = np.zeros((len(words), len(names) + 1)), np.array([r["inside"] for r in words], float), np.array([r["n"] for r in words], float)
    x[:, 0] = 1
    for i, r in enumerate(words):
        x[i, [at[f] for f in r["kind"].split()[1:]]] = 1
    n = np.sqrt(n)  # a long text says less than its words' number
    n /= n.sum()
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, rounds + 1):
        g = x.T @ (n * (1 / (1 + np.exp(-x @ w)) - y)) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.03 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    out = dict(zip(["", *names], w.tolist(), strict=True))
    tags = {r["kind"][2:] for r in rows if r["kind"][0] == "t"}
    count = {(r["kind"][2:], r["inside"]): r["n"] for r in rows if r["kind"][0] == "t"}
    total = [sum(k for (_, i), k in count.items() if i == side) for side in (True, False)]
    for tag in tags:
        odds = np.log((count.get((tag, True), 0) + 1) / (total[0] + 2)) - np.log((count.get((tag, False), 0) + 1) / (total[1] + 2))
        out[f"tag:{tag}"] = float(np.clip(odds, -1, -0.02))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Beginning and end of the contiguous stretch of greatest positive sum, the first of equal ones, in one scan; empty if no score is positive."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        total += score
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def scored(html: str, weights: Weights) -> list[tuple[float, str, bool]]:
    """Score, text or tag, and whether it is a text, of all tokens of a page."""
    known: dict[tuple[str, ...], float] = {}
    items = []
    for kind, x, features in tokens(html, weights):
        if kind == "tag":
            items.append((weights.get(f"tag:{x}", -0.1), x, False))
        else:
            if features not in known:
                known[features] = weights.get("", 0.0) + sum(weights.get(f, 0.0) for f in features)
            items.append((max(known[features] * len(x.split()), -NODE), x, True))
    return items


def main_text(html: str | None, weights: Weights) -> str:
    items = scored(html or "", weights)
    begin, end = best_region([s for s, _, _ in items])
    blocks, now = [], []
    for score, x, text in items[begin:end]:
        if text:
            if score >= 0:
                now.append(x)
        elif x in _BLOCK:
            blocks.append("".join(now))
            now = []
        elif x == "br":
            now.append(" ")
    blocks.append("".join(now))
    return "\n".join(t for b in blocks if (t := " ".join(b.split())))


def extract(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py(), weights) for h in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pick(pages, page_id="bigint", url="string", html="string").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), fit(spark.createDataFrame([(p,) for p in labelled_pages()], "html string")))
