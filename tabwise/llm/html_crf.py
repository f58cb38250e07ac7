"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: runs of text between block-level tags, each
with its open elements.  Ancestor tags, class and id words, and features of the
text give every block a score; neighbouring labels (main text or not) depend on
each other.  Weights are fitted by stochastic gradient ascent on the conditional
likelihood of labelled pages, and the best labelling is found by Viterbi.

Labelled pages are a few annotated layouts (LAYOUTS, in variants that rename
the tags) and a bounded sample of the table whose own mark-up says which part
is the article.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwise.llm.sampling import smallest_hashes

#: Sampled pages at most, and their greatest length in code points.
SAMPLE_PAGES, SAMPLE_LENGTH = 500, 65_536
#: Open elements, summed over its blocks, of a page that the model is fitted on, at most.
SAMPLE_PATHS = 100_000
DIMENSIONS, EPOCHS, RATE, DECAY = 1 << 14, 10, 0.3, 1e-4

# HTML element names by their role in the layout.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s "
             "samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext msup msub msubsup "
             "mfrac msqrt mroot munder mover munderover mstyle mspace annotation svg g text tspan object canvas".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template iframe audio video head title select datalist textarea button".split())
RAW = set("script style textarea title noscript iframe".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
SCOPE = set("ul ol dl table html body div article section main aside nav header footer form blockquote".split())

REGIONS = set("article main section nav aside header footer form".split())

_TAG = re.compile(r"</?([a-zA-Z][-\w:.]*)")
_SPECIAL = re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]+")
_MAIN = re.compile(r"\bdata-main\b")


class Path:
    """The open elements of a block, as a node that shares its ancestors; nodes are kept over pages, with what is known of them."""

    __slots__ = ("parent", "tag", "words", "depth", "new", "region", "bag", "children", "score")

    def __init__(self, parent: Path | None = None, tag: str = "", words: tuple[str, ...] = (), new: tuple[str, ...] = ()):
        self.parent, self.tag, self.words, self.children, self.score = parent, tag, words, {}, None
        self.depth = parent.depth + 1 if parent else 0
        self.new = [_place(n) for n in new]        # features that no ancestor has
        self.region = tag if tag in REGIONS else parent.region if parent else ""       # the innermost landmark decides most
        # The set of class and id words, as a sum that does not depend on their order.
        self.bag = ((parent.bag if parent else 0) + sum(zlib.crc32(n.encode()) for n in new if n.startswith("word="))) & 0xFFFFFFFF

    def elements(self) -> list[tuple[str, tuple[str, ...]]]:
        """(tag, class and id words) from the outermost element to this."""
        out, node = [], self
        while node.parent:
            out.append((node.tag, node.words))
            node = node.parent
        return out[::-1]

    def own_features(self) -> list[int]:
        return [_place(n) for n in ("bias", f"parent={self.tag}", f"region={self.region}", f"region={self.region},parent={self.tag}",
                                    f"region={self.region},words={self.bag}")]

    def features(self) -> list[int]:
        out, node = self.own_features(), self
        while node:
            out += node.new
            node = node.parent
        return out


class Block(NamedTuple):
    text: str
    path: Path
    linked: int      # characters inside links
    main: bool       # inside an element marked data-main (training layouts)


#: Path nodes that are kept over pages.
PATHS = 50_000
_roots: list = [None, 0]


def _root() -> Path:
    if _roots[0] is None or _roots[1] > PATHS:
        _roots[:] = [Path(), 0]
    return _roots[0]


class _Marks:
    """Ends of the tags of a page, each place looked at a bounded number of times, however broken the mark-up is."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.known: dict[int, int] = {}      # opening quote -> end of the tag around it, or -1
        self.clear = (0, -1)                 # a stretch without special characters, and what ends it

    def _next(self, at: int) -> int:
        found = _SPECIAL.search(self.page, at)
        return found.start() if found else len(self.page)

    def tag_end(self, at: int) -> int:
        """Place of the > that ends a tag whose attributes begin at ``at``, quotes respected; -1 if there is none."""
        if at > self.last:
            return -1
        if not self.clear[0] <= at <= self.clear[1]:
            self.clear = (at, self._next(at))
        place, passed = self.clear[1], []
        while True:
            if place >= len(self.page):
                end = -1
            elif self.page[place] == ">":
                end = place
            elif place in self.known:
                end = self.known[place]
            else:
                passed.append(place)
                close = self.page.find(self.page[place], place + 1)
                if close >= 0:
                    place = self._next(close + 1)
                    continue
                end = -1
            self.known.update(dict.fromkeys(passed, end))
            return end


def leaf_blocks(page: str) -> Iterator[Block]:
    """The text blocks of a page in order, references decoded, white space collapsed; unseen elements left out.

    Time and memory grow with the page's length only: open elements are
    counted, not searched, and blocks share their paths.
    """
    root = _root()
    stack: list[tuple[str, Path, Counter, bool]] = [("", root, Counter(), False)]
    places: defaultdict[str, list[int]] = defaultdict(list)      # where in the stack each tag is open
    scopes, held = [0], Counter()                                 # places of scoping elements; features of the path
    unseen = links = mains = linked = at = 0
    parts: list[str] = []
    marks = _Marks(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split()) if parts else ""
        parts.clear()
        n, linked = linked, 0
        return [Block(text, stack[-1][1], min(n, len(text)), mains > 0)] if text else []

    def close(depth: int) -> None:
        """Close all elements from this place of the stack on."""
        nonlocal unseen, links, mains
        while len(stack) > depth:
            tag, node, inline, main = stack.pop()
            places[tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()
            unseen, links, mains = unseen - (tag in UNSEEN), links - inline["a"], mains - main
            held.subtract([f"in={tag}", *(f"word={w}" for w in node.words)])

    while at < len(page):
        text = None
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            text, at = page[at:end], end
        elif page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        elif page.startswith(("<!", "<?"), at) and at < marks.last:
            at = page.find(">", at) + 1
            continue
        else:
            tag = _TAG.match(page, at)
            end = marks.tag_end(tag.end()) if tag else -1
            start, at = at, at + 1 if end < 0 else end + 1
            text = "<" if end < 0 else None
        if text is not None:
            if not unseen:
                text = html.unescape(text)
                parts.append(text)
                if links:
                    linked += len(text.strip())
            continue
        name, closing = tag.group(1).lower(), page[start + 1] == "/"
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            inline, step = stack[-1][2], 1 if not closing else -1 if stack[-1][2][name] else 0
            if name not in VOID:
                inline[name] += step
                links += step * (name == "a")
            continue
        yield from flush()
        if closing:
            if places[name]:
                close(places[name][-1])
            continue
        last = max((places[c][-1] for c in CLOSES.get(name, ("p",)) if places[c]), default=0)
        if last > scopes[-1]:
            close(last)
        if name in VOID:
            continue
        attributes = page[tag.end():end]
        names = tuple(w for g in _NAMES.findall(attributes) for w in _WORD.findall("".join(g).lower())) if "=" in attributes else ()
        above, features = stack[-1][1], [f"in={name}", *(f"word={w}" for w in names)]
        node = above.children.get((name, names))
        if node is None:
            node = above.children[name, names] = Path(above, name, names, tuple(f for f in dict.fromkeys(features) if held[f] <= 0))
            _roots[1] += 1
        held.update(features)
        places[name].append(len(stack))
        if name in SCOPE:
            scopes.append(len(stack))
        main = bool(_MAIN.search(attributes))
        unseen, mains = unseen + (name in UNSEEN), mains + main
        stack.append((name, node, Counter(), main))
        if name in RAW:
            found = re.compile(r"</%s\b" % re.escape(name), re.I).search(page, at)
            at = found.start() if found and found.start() < marks.last else len(page)
    yield from flush()


def _bucket(value: float, edges: tuple) -> int:
    return sum(value >= e for e in edges)


def _place(name: str) -> int:
    return zlib.crc32(name.encode()) % DIMENSIONS


def text_features(block: Block, index: int, count: int) -> list[int]:
    text = block.text
    words, n = text.count(" ") + 1, len(text)
    parent = block.path.tag
    size = _bucket(words, (3, 6, 12, 25, 60))
    stops = text.count(".") + text.count("!") + text.count("?")
    names = (f"words={size}", f"words={size},parent={parent}", f"linked={_bucket(block.linked / n, (0.01, 0.2, 0.5, 0.9))}",
             f"ends={text[-1] if text[-1] in '.!?:;,' else 'w'}", f"stops={_bucket(stops, (1, 2, 4))}", f"commas={_bucket(text.count(','), (1, 3))}",
             f"mark={'©' in text or '|' in text or '·' in text or '»' in text}", f"place={_bucket(index / count, (0.1, 0.3, 0.7, 0.9))}",
             f"digits={_bucket(sum(map(str.isdigit, text)) / n, (0.05, 0.2))}")
    return [_place(x) for x in names]


@dataclass
class BlockTagger:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(DIMENSIONS))     # score of main text minus other
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(2))

    def emissions(self, blocks: list[Block]) -> list[float]:
        w = self.weights
        return [self._path_score(b.path) + sum(w[text_features(b, k, len(blocks))].tolist()) for k, b in enumerate(blocks)]

    def _path_score(self, path: Path) -> float:
        """What a path's features add; kept on its nodes: (model, of the ancestors' features, of all)."""
        todo = []
        while path and (path.score is None or path.score[0] is not self):
            todo.append(path)
            path = path.parent
        above = path.score[1] if path else 0.0
        for node in reversed(todo):
            above += float(self.weights[node.new].sum()) if node.new else 0.0
            node.score = (self, above, above + float(self.weights[node.own_features()].sum()))
            path = node
        return path.score[2]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest labels (Viterbi); on a tie, not main text."""
        if not blocks:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        e = self.emissions(blocks)
        a, b = float(self.starts[0]), float(self.starts[1]) + e[0]
        back = []
        for x in e[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + x
        labels = [b > a]
        for from_other, from_main in reversed(back):
            labels.append(from_main if labels[-1] else from_other)
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        blocks = list(leaf_blocks(page or ""))
        return " ".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


def train_tagger(pages: list[list[tuple[Block, bool]]]) -> BlockTagger:
    """Fit the field on labelled pages (blocks and whether each is main text)."""
    model = BlockTagger()
    data = []
    for page in pages:
        if page:
            blocks = [b for b, _ in page]
            data.append(([np.array(b.path.features() + text_features(b, k, len(blocks))) for k, b in enumerate(blocks)],
                         np.array([int(y) for _, y in page])))
    order = np.random.default_rng(11)
    step = 0
    for _ in range(EPOCHS):
        for k in order.permutation(len(data)):
            at, y = data[k]
            step += 1
            rate = RATE / (1.0 + step / 2000.0)
            n = len(y)
            e = np.zeros((n, 2))
            e[:, 1] = [model.weights[i].sum() for i in at]
            forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
            forward[0] = model.starts + e[0]
            for i in range(1, n):
                forward[i] = np.logaddexp(forward[i - 1, 0] + model.moves[0], forward[i - 1, 1] + model.moves[1]) + e[i]
            for i in range(n - 2, -1, -1):
                ahead = e[i + 1] + backward[i + 1]
                backward[i] = np.logaddexp(model.moves[:, 0] + ahead[0], model.moves[:, 1] + ahead[1])
            total = np.logaddexp(*forward[-1])
            p = np.exp(forward + backward - total)
            expected = np.zeros((2, 2))
            if n > 1:
                pair = forward[:-1, :, None] + model.moves[None] + (e + backward)[1:, None, :] - total
                expected = np.exp(pair).sum(0)
                np.add.at(model.moves, (y[:-1], y[1:]), rate)
                model.moves -= rate * expected
            model.starts -= rate * p[0]
            model.starts[y[0]] += rate
            for i, g in zip(at, y - p[:, 1]):
                model.weights[i] += rate * (g - DECAY * model.weights[i])
    return model


# Annotated layouts; data-main marks main text.  {P} long and {S} short running text, {L} a link, {W} one or two words.
LAYOUTS = [
    "<header class='site-header'><a href=/>{W}</a><p>{S}</p></header><nav class=menu><ul><li>{L}</li><li>{L}</li><li>{L}</li></ul></nav><main><article data-main><h1>{S}</h1><p>{P}</p><p>{P}</p><h2>{W}</h2><p>{P}</p><ul><li>{S}</li><li>{S}</li></ul></article></main><aside class=sidebar><h3>{W}</h3><ul><li>{L}</li><li>{L}</li></ul><p>{S}</p></aside><footer><p>&copy; {W}</p><ul><li>{L}</li></ul></footer>",
    "<div id=top class=nav>{L} | {L} | {L}</div><div class='cookie-notice banner'><p>{S}</p></div><div class=content data-main><h1>{S}</h1><p>{P}</p><blockquote>{S}</blockquote><p>{P}</p><table><tr><td>{W}</td><td>{S}</td></tr></table></div><div class=ad>{S}</div><div class='comments'><h3>{W}</h3><div class=comment><p>{W}</p><p>{S}</p></div><div class=comment><p>{P}</p></div></div><div class=footer>{S} &middot; {L}</div>",
    "<nav><ul><li>{L}</li><li>{L}</li></ul></nav><div class=ad>{S}</div><article data-main><h1>{S}</h1><p>{P}<p>{P}<p>{S}</p></article><section class=comments><h2>{W}</h2><ol><li><p>{S}</p></li><li><p>{P}</p></li></ol><form><p>{S}</p><label>{W}</label></form></section><footer>&copy; {W} {S}</footer>",
    "<div role=banner><p>{W}</p></div><div role=navigation>{L} {L}</div><div role=alert class=notice><p>{S}</p></div><div role=main><div class='post entry' data-main><h1>{S}</h1><p>{P}</p><pre>{S}</pre><p>{P}</p></div><div class='related promo'><h4>{W}</h4><p>{L}</p><p>{L}</p></div></div><div role=complementary><p>{S}</p><p>{L}</p></div><form class=newsletter><p>{S}</p><p>{W}</p></form><div role=contentinfo><p>{S}</p></div>",
    "<header><h1>{W}</h1><nav>{L}{L}</nav></header><aside class='advert sponsored'><p>{P}</p></aside><main data-main><p>{P}</p><h2>{S}</h2><p>{P}</p><p>{P}</p><dl><dt>{W}</dt><dd>{S}</dd></dl></main><aside><p>{S}</p></aside><form action=/s><p>{S}</p></form><footer><p>{S}</p></footer>",
    "<div class=header>{W}</div><ul class=menu><li>{L}</li><li>{L}</li></ul><div id=article data-main><h2>{S}</h2><p>{S}</p><p>{P}</p><p>{P}</p></div><div id=sidebar><p>{P}</p><p>{L}</p></div><div id=disqus class=replies><p>{S}</p><p>{P}</p></div><div id=footer><p>{S}</p></div>",
    "<article><header class=masthead><p>{W}</p><p>{S}</p></header><div data-main><h1>{S}</h1><p>{P}</p><p>{P}</p></div><aside class=related><p>{L}</p></aside><section id=comments><p>{P}</p><p>{S}</p></section><footer><p>{S}</p><p>{L}</p></footer></article>",
]
# Words that layouts may use for one another.
RENAMED = [("article", "section"), ("content", "story"), ("sidebar", "widget"), ("ad>", "advertisement>"), ("comments", "responses"),
           ("notice", "alert"), ("menu", "navbar"), ("main>", "div class=body>")]
_STOCK = ("the house stands near a river and nobody remembers who built it first, although several letters mention the year; "
          "people came there in summer. Later they sold it, moved to town, and opened a small shop that still exists today. "
          "It was never easy work! Would anyone do it again? Most of them say yes, without much thought about the cost").split()


def layout_pages(variants: int = 12) -> list[list[tuple[Block, bool]]]:
    """The annotated layouts filled with running text, in variants."""
    rng = np.random.default_rng(5)

    def fill(m: re.Match) -> str:
        low, high = {"P": (25, 120), "S": (4, 14), "L": (1, 3), "W": (1, 3)}[m.group(1)]
        at = int(rng.integers(0, len(_STOCK)))
        words = [_STOCK[(at + k) % len(_STOCK)] for k in range(int(rng.integers(low, high + 1)))]
        text = " ".join(words).capitalize() + ("." if m.group(1) == "P" or rng.random() < 0.5 and m.group(1) == "S" else "")
        return f"<a href=/x>{text}</a>" if m.group(1) == "L" else text

    pages = []
    for layout in LAYOUTS:
        for _ in range(variants):
            text = layout
            for word, other in RENAMED:
                if rng.random() < 0.3:
                    text = text.replace(word, other)
            pages.append([(b, b.main) for b in leaf_blocks(f"<html><body>{re.sub(r'{([PSLW])}', fill, text)}</body></html>")])
    return pages


# Elements and class words that are no main text even inside an article.
ASIDE_TAGS = {"nav", "aside", "footer", "form", "header", "menu"}
ASIDE_WORDS = set("ad ads advert advertisement banner comment comments cookie disqus footer menu nav navbar navigation newsletter notice "
                  "promo related replies responses share sidebar social sponsored widget".split())


def label_by_markup(page: str | None) -> list[tuple[Block, bool]]:
    """Blocks of a page labelled by its own article or main element; no blocks if it has none."""
    blocks = list(leaf_blocks(page or ""))
    if sum(b.path.depth for b in blocks) > SAMPLE_PATHS:
        return []
    paths = [b.path.elements() for b in blocks]
    if not any(tag in ("article", "main") for path in paths for tag, _ in path):
        return []

    def main(path: list) -> bool:
        inner = [k for k, (t, _) in enumerate(path) if t in ("article", "main")]
        return bool(inner) and not any(t in ASIDE_TAGS or ASIDE_WORDS & set(w) for t, w in path[inner[0]:])

    return [(b, main(path)) for b, path in zip(blocks, paths)]


def fit_tagger(pages: DataFrame) -> BlockTagger:
    """Fit on the annotated layouts and at most SAMPLE_PAGES pages, those of smallest hash."""
    some = pages.where(F.col("html").isNotNull() & (F.char_length("html") <= SAMPLE_LENGTH)).select(F.lit(1).alias("one"), "page_id", "html")
    sample = smallest_hashes(some, "one", SAMPLE_PAGES, F.struct("page_id", "html")).orderBy("_rank").collect()
    return train_tagger(layout_pages() + [label_by_markup(r["html"]) for r in sample])


def extract_main_text(pages: DataFrame, model: BlockTagger | None = None) -> DataFrame:
    """One row per row of ``pages (page_id, url, html)``: page_id, url, text, n_chars.

    ``text``: the blocks labelled as main text, in page order, joined by one
    space; empty if there are none.  Null html counts as empty.  Broken mark-up
    is read as it comes: unclosed elements end with their parent.  Repeated
    rows give equal texts, null ids and urls pass through, an empty table gives
    no rows, other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or fit_tagger(pages))     # DIMENSIONS floats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.extract(p.as_py()) for p in batch.column(2)]
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                                   "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(
        extract, "page_id long, url string, text string, n_chars long")
