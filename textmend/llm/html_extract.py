"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A page is parted into leaf blocks, runs of text that no block element parts. Each block's features are its ancestors'
tags and class words and the shape of its text; no words of the text count. The field's weights are trained by maximum
likelihood on labelled pages, and Viterbi's path labels each block of a page as main text or not.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .arrays import lean

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")
#: Elements that don't part text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr math maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't text of the page.
RAW = frozenset("script style noscript template textarea title select svg annotation annotation-xml iframe object".split())
#: Of these, the ones that hide nothing but their start tag where no end tag follows.
UNCLOSED = frozenset("noscript select svg annotation annotation-xml iframe object".split())
#: An opening tag of the first kind ends an open element of these kinds.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table body html div article section".split())
SLOTS = 1 << 13
SEED, PAGES, EPOCHS = 11, 600, 60


class Node:
    """An open element: its tag, the nearest tag that isn't inline, the names that no element above it has, and its parent."""

    __slots__ = ("tag", "own", "fresh", "above", "score")

    def __init__(self, tag: str, own: str, fresh: list, above: Node | None):
        self.tag, self.own, self.fresh, self.above, self.score = tag, own, fresh, above, None


class Open:
    """The elements that are open, with the places of each tag and of those that part text, so that no step looks through
    all of them however deep a page is."""

    def __init__(self):
        self.nodes: list[Node] = [Node("", "", [], None)]
        self.names: list[list] = [[]]
        self.places: dict[str, list[int]] = {}
        self.parting: list[int] = [0]
        self.seen: dict[str, int] = {}

    def push(self, tag: str, names: list) -> None:
        top, seen = self.nodes[-1], self.seen
        fresh = []
        for n in names:
            if not seen.get(n):
                fresh.append(n)
            seen[n] = seen.get(n, 0) + 1
        if tag not in INLINE:
            self.parting.append(len(self.nodes))
        self.places.setdefault(tag, []).append(len(self.nodes))
        # an element that adds nothing shares its parent's node
        same = not fresh and (tag in INLINE or tag == top.own)
        self.nodes.append(top if same else Node(tag, top.own if tag in INLINE else tag, fresh, top))
        self.names.append([tag, *names])

    def last(self, tags) -> int:
        """The place of the innermost of the tags, 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def pop(self, to: int):
        """Closes all from a place on; the tags, innermost first."""
        while len(self.nodes) > to:
            tag, *names = self.names.pop()
            self.nodes.pop()
            self.places[tag].pop()
            if tag not in INLINE:
                self.parting.pop()
            for n in names:
                self.seen[n] -= 1
            yield tag


class Block:
    __slots__ = ("node", "parts", "linked")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked = node, [], 0


def blocks_of(page: str) -> list[tuple[Node, str, int]]:
    """Leaf blocks in page order: (innermost element, text, characters inside links)."""
    opened = Open()
    out: list[Block] = []
    at, links, fresh = 0, 0, True

    def add(text: str) -> None:
        nonlocal fresh
        if fresh:
            if text.isspace():
                return
            out.append(Block(opened.nodes[-1]))
            fresh = False
        out[-1].parts.append(text)
        if links:
            out[-1].linked += len(text.strip())

    def pop(to: int) -> None:
        nonlocal links, fresh
        for tag in opened.pop(to):
            links -= tag == "a"
            fresh = fresh or tag not in INLINE

    n = len(page)
    missing: set = set()  # raw elements that have no end tag from here on
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            place = opened.last((tag,))
            if place and (tag not in INLINE or place > opened.parting[-1]):
                pop(place)
            fresh = fresh or tag not in INLINE
            continue
        if tag in RAW:
            if tag == "svg" and m[3].endswith("/"):
                continue
            end = None if tag in missing else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if not end:
                missing.add(tag)
            at = end.end() if end else at if tag in UNCLOSED else n
            if tag in ("textarea", "select"):
                fresh = True
            continue
        if tag == "br":
            if not fresh:
                out[-1].parts.append(" ")
            continue
        if tag not in INLINE:
            fresh = True
            near = opened.parting[-1]
            if opened.names[near][:1] == ["p"]:
                pop(near)
            if tag in CLOSES and (place := opened.last(CLOSES[tag])) > opened.last(SCOPE):
                pop(place)
        if tag in VOID or m[3].endswith("/") and tag not in ("p", "div", "a"):
            continue
        names = [tag]
        if m[3] and "=" in m[3]:
            for a in ATTRIBUTE.finditer(m[3]):
                names += ["." + w for w in WORDS.findall((a[2] or a[3] or a[4] or "").lower())]
        opened.push(tag, names)
        if tag == "a":
            links += 1
    done = []
    for b in out:
        text = SPACE.sub(" ", html.unescape("".join(b.parts))).strip()
        if text:
            done.append((b.node, text, b.linked))
    return done


def bucket(x: int) -> int:
    return min(9, int(x).bit_length())


_SLOT: dict = {}


def slot(name: str) -> int:
    found = _SLOT.get(name)
    if found is None:
        if len(_SLOT) > 1 << 16:
            _SLOT.clear()
        found = _SLOT[name] = zlib.crc32(name.encode()) % SLOTS
    return found


def shape(blocks: list) -> list[list[int]]:
    """Slots of the features of each block's text and place."""
    out = []
    n = len(blocks)
    for i, (node, text, linked) in enumerate(blocks):
        size = len(text)
        f = ["bias", "own=" + node.own, f"words={bucket(text.count(' ') + 1)}", f"links={min(4, 4 * linked // max(1, size))}", f"stops={bucket(text.count('.') + text.count(','))}"]
        if text[-1] in ".!?\"”»…":
            f.append("ends")
        if i == n - 1:
            f.append("last")
        if i == 0:
            f.append("first")
        out.append([slot(x) for x in f])
    return out


def inside(node: Node) -> list[int]:
    """Slots of the names of an element and all above it."""
    out = []
    while node is not None:
        out += [slot("in=" + x) for x in node.fresh]
        node = node.above
    return out


def features(blocks: list) -> list[list[int]]:
    """Slots of each block's features."""
    return [f + inside(node) for f, (node, _, _) in zip(shape(blocks), blocks)]


def path_score(node: Node, weights: list) -> tuple[float, float]:
    """Sums of the weights of inside(node); each element is summed up once, however many blocks it holds."""
    todo = []
    while node is not None and node.score is None:
        todo.append(node)
        node = node.above
    x, y = node.score if node is not None else (0.0, 0.0)
    for node in reversed(todo):
        for name in node.fresh:
            p, q = weights[slot("in=" + name)]
            x, y = x + p, y + q
        node.score = x, y
    return x, y


def viterbi(unary, step: np.ndarray) -> list[int]:
    """The best path of labels; unary: a pair for each block, step: (2, 2)."""
    (s00, s01), (s10, s11) = step.tolist()
    rows = unary.tolist() if isinstance(unary, np.ndarray) else unary
    a, b = rows[0]
    back = []
    for x, y in rows[1:]:
        p, q = a + s00, b + s10
        r, t = a + s01, b + s11
        back.append((0 if p >= q else 1, 0 if r >= t else 1))
        a, b = (p if p >= q else q) + x, (r if r >= t else t) + y
    label = 0 if a >= b else 1
    path = [label]
    for pair in reversed(back):
        label = pair[label]
        path.append(label)
    return path[::-1]


def train(pages: list[tuple[str, list[int]]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features (SLOTS, 2) and of steps (2, 2) from labelled pages: (html, label of each leaf block)."""
    seqs = [(features(blocks_of(h)), y) for h, y in pages]
    seqs = [(x, y) for x, y in seqs if x and len(x) == len(y)]
    t = max(len(y) for _, y in seqs)
    n = len(seqs)
    rows = np.array([i * t + j for i, (x, _) in enumerate(seqs) for j, f in enumerate(x) for _ in f])
    cols = np.array([c for x, _ in seqs for f in x for c in f])
    mask = np.zeros((n, t), bool)
    gold = np.zeros((n, t), np.int64)
    for i, (_, y) in enumerate(seqs):
        mask[i, : len(y)] = True
        gold[i, : len(y)] = y
    w, s = np.zeros((SLOTS, 2)), np.zeros((2, 2))
    eye = np.eye(2)
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    for epoch in range(1, epochs + 1):
        u = np.zeros((n * t, 2))
        for k in (0, 1):
            u[:, k] = np.bincount(rows, weights=w[cols, k], minlength=n * t)
        u = u.reshape(n, t, 2)
        forward, back = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        forward[:, 0] = u[:, 0]
        for j in range(1, t):
            forward[:, j] = np.where(mask[:, j, None], u[:, j] + np.logaddexp.reduce(forward[:, j - 1, :, None] + s, axis=1), forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            back[:, j] = np.where(mask[:, j + 1, None], np.logaddexp.reduce(s + (u[:, j + 1] + back[:, j + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(forward[:, -1], axis=1)
        single = np.exp(forward + back - z[:, None, None]) * mask[..., None]
        diff = (single - eye[gold] * mask[..., None]).reshape(n * t, 2)
        gw = np.stack([np.bincount(cols, weights=diff[rows, k], minlength=SLOTS) for k in (0, 1)], axis=1) / n + 1e-4 * w
        gs = np.zeros((2, 2))
        for j in range(1, t):
            on = mask[:, j]
            pair = np.exp(forward[on, j - 1, :, None] + s + (u[on, j] + back[on, j])[:, None, :] - z[on, None, None]).sum(axis=0)
            gs += pair - eye[gold[on, j - 1]].T @ eye[gold[on, j]]
        gs = gs / n + 1e-4 * s
        for v, g, m, q in ((w, gw, moments[0], moments[1]), (s, gs, moments[2], moments[3])):
            m += 0.1 * (g - m)
            q += 0.01 * (g * g - q)
            v -= 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(q / (1 - 0.99**epoch)) + 1e-8)
    return w, s


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[str, list[int]]]:
    """Pages written from varied templates, with the label of each leaf block: 1 for the article's own text."""
    rng = np.random.default_rng(seed)
    syllables = "an be ca de el fo ga he in jo ka la me no or pa que re sa ti un vo wa xi ya zu".split()

    def word() -> str:
        return "".join(rng.choice(syllables, rng.integers(1, 4)))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.integers(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        return words(a, b).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    def prose() -> str:
        x = " ".join(sentence() for _ in range(rng.integers(1, 7)))
        if rng.random() < 0.15:
            x = words(2, 9).capitalize() + ("." if rng.random() < 0.7 else "")
        if rng.random() < 0.2:
            x += f' <a href="/x">{word()}</a> {sentence()}'
        if rng.random() < 0.2:
            x = f"<b>{x}</b>" if rng.random() < 0.6 else f"<em>{word()}</em> {x}"
        return x

    def pick(*x):
        return x[rng.integers(len(x))]

    pages = []
    for _ in range(count):
        out: list[str] = []
        y: list[int] = []

        def put(text: str, label: int, n: int = 1) -> None:
            out.append(text)
            y.extend([label] * n)

        def menu(tag: str, attr: str = "") -> None:
            k = int(rng.integers(2, 9))
            put(f"<{tag}{attr}><ul>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(k)) + f"</ul></{tag}>", 0, k)

        def noise(kinds) -> None:
            kind = pick(*kinds)
            if kind == "ad":
                put(f'<div class="{pick("ad", "ads", "advert", "sponsored", "promo", "banner")}">{sentence(3, 12)}</div>', 0)
            elif kind == "notice":
                put(f'<div {pick("class", "id")}="{pick("cookie-notice", "notice", "cookie-banner", "consent", "newsletter", "popup")}"><p>{sentence()}</p></div>', 0)
            elif kind == "side":
                tag, attr = pick(("aside", ""), ("aside", ' class="sidebar"'), ("div", ' class="sidebar"'), ("div", ' id="side"'))
                if rng.random() < 0.5:
                    menu(tag, attr)
                else:
                    put(f"<{tag}{attr}><h3>{words(1, 4)}</h3><p>{sentence()}</p></{tag}>", 0, 2)
            elif kind == "related":
                menu(pick("section", "div"), f' class="{pick("related", "recommended", "share", "social", "tags", "breadcrumb", "pagination")}"')
            elif kind == "form":
                put(f'<form action="/s"><label>{words(1, 3)}</label><input type="text"><button>{word()}</button></form>', 0, 2)
            elif kind == "comments":
                k = int(rng.integers(1, 4))
                body = "".join(f'<div class="comment"><p>{" ".join(sentence() for _ in range(rng.integers(1, 4)))}</p></div>' for _ in range(k))
                put(f'<{(t := pick("section", "div"))} {pick("class", "id")}="comments">{body}</{t}>', 0, k)

        everywhere = ("ad", "notice", "side", "related", "form")
        put(f'<!DOCTYPE html><html><head><title>{words(2, 6)}</title>{pick("", "<style>body > div:first-child { color: #222 }</style>", "<script>if (1 < 2) { start('<section>'); }</script>")}</head><body{pick("", " class=page")}>', 0, 0)
        if rng.random() < 0.4:
            put(f"<header{pick('', ' class=header')}><h2>{words(1, 4)}</h2></header>" if rng.random() < 0.5 else f'<div class="{pick("header", "masthead", "top")}">{words(1, 5)}</div>', 0)
        if rng.random() < 0.8:
            menu(*pick(("nav", ""), ("nav", ""), ("div", ' class="menu"'), ("div", ' id="nav"'), ("header", "")))
        for _ in range(rng.integers(0, 3)):
            noise(everywhere)
        tag, attr = pick(("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' class="article"'), ("div", ' id="content"'), ("div", ' class="post-body"'), ("section", ' class="story"'))
        put(f"<{tag}{attr}>", 0, 0)
        if rng.random() < 0.85:
            put(f"<h1>{words(2, 8).capitalize()}{pick('', '.')}</h1>", 1)
        for _ in range(rng.integers(1, 12)):
            r = rng.random()
            if r < 0.75:
                put(f"<p>{prose()}" + ("</p>" if rng.random() < 0.85 else "<br>"), 1)
            elif r < 0.8:
                put(f"<h2>{words(1, 6).capitalize()}</h2>", 1)
            elif r < 0.84:
                k = int(rng.integers(2, 5))
                put("<ul>" + "".join(f"<li>{words(2, 10)}</li>" for _ in range(k)) + "</ul>", 1, k)
            elif r < 0.87:
                put(f"<blockquote>{sentence()}</blockquote>", 1)
            elif r < 0.9:
                put(f"<table><tr><td>{word()}</td><td>{word()}</td></tr></table>", 1, 2)
            elif r < 0.92:
                put(f"<pre>{words(2, 9)}</pre>", 1)
            else:
                noise(everywhere)
        if rng.random() < 0.15:
            noise(("comments",))
        put(f"</{tag}>", 0, 0)
        if rng.random() < 0.35:
            noise(("comments",))
        for _ in range(rng.integers(0, 2)):
            noise(everywhere)
        if rng.random() < 0.85:
            line = pick(f"Copyright {rng.integers(1995, 2030)} {words(1, 3)}", f"{words(1, 4)} | {words(1, 3)}", sentence(), f"{words(1, 3)} &mdash; {sentence()}", f"&#169; {words(1, 4)}")
            put(f"<footer>{line}</footer>" if rng.random() < 0.7 else f'<div {pick("class", "id")}="footer">{line}</div>', 0)
        if rng.random() < 0.9:
            put("</body></html>", 0, 0)
        pages.append(("".join(out), y))
    return pages


def extract(page: str | None, weights: list, step: np.ndarray) -> str:
    """The main text of a page, a line for each block; weights as a list of pairs."""
    blocks = blocks_of(page or "")
    if not blocks:
        return ""
    unary = []
    for f, (node, _, _) in zip(shape(blocks), blocks):
        x, y = path_score(node, weights)
        for c in f:
            p, q = weights[c]
            x, y = x + p, y + q
        unary.append((x, y))
    return "\n".join(b[1] for b, label in zip(blocks, viterbi(unary, step)) if label)


def html_extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], html_col: str = "html") -> DataFrame:
    """All columns of pages (but those named text or n_chars), text and n_chars, its code points.

    A null or empty page has an empty text; so has one without main blocks. Broken markup is read as far as it goes: an
    element that isn't closed ends with its parent. Pages of any length and depth are read whole, in time that grows with
    their length. Of equally good labels the first, not main, is taken. Each row is judged alone, so repeated rows get the
    same text."""
    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    at = rest.index(html_col)
    frame = pages.select(*rest).withColumn(html_col, F.col(html_col).cast("string"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        lean()
        weights, step = shared.value[0].tolist(), shared.value[1]
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                text = [extract(x, weights, step) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], names=[*rest, "text", "n_chars"])

    return frame.mapInArrow(each, StructType([*frame.schema, StructField("text", StringType()), StructField("n_chars", LongType())]))
