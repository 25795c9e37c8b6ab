"""Main text of pages: a linear-chain conditional random field over the blocks of the DOM."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dom import Block, blocks

#: Words that mark page furniture when a short block has them.
CUES = frozenset(
    "about accept account ad ads advert advertisement advertising agree all archive author browser by category click close "
    "comment commented comments contact cookie cookies copyright email enable follow home javascript latest leave like login "
    "menu more newsletter next notice partner please policy popular post posted previous privacy promo read related "
    "replied reply reserved rights said says search share sign sponsored submit subscribe tags terms trending use user "
    "visit we welcome".split()
)


def features(page: list[Block]) -> list[list[str]]:
    """Per block: tags and names of what it stands in, and what its text is like."""
    out = []
    n = len(page)
    around: Counter = Counter()
    for b in page:
        if b.node is not None:
            around[id(b.node.parent)] += len(b.text)
    for i, block in enumerate(page):
        text, node = block.text, block.node
        words = text.split()
        size = len(text)
        own = ["bias", f"size:{min(12, size.bit_length())}", f"words:{min(10, len(words).bit_length())}"]
        link = block.linked / size
        own.append("link:" + ("none" if not block.linked else "some" if link < 0.4 else "most" if link < 0.95 else "all"))
        own.append("ends:" + ("stop" if text[-1] in ".!?…:;\"'”»)" else "word"))
        own.append(f"upper:{min(4, int(5 * sum(map(str.isupper, text)) / size))}")
        own.append(f"stops:{min(4, text.count('. ') + text.count(', '))}")
        if any(c in text for c in "©®™"):
            own.append("mark")
        if "|" in text or "»" in text or "·" in text:
            own.append("separator")
        if any(map(str.isdigit, text)):
            own.append("digits")
        if len(words) <= 25:
            own.extend({f"cue:{w}" for w in (x.strip(".,:;!?()[]…").lower() for x in words) if w in CUES})
        own.append("place:" + ("first" if i == 0 else "last" if i == n - 1 else f"{4 * i // n}"))
        if node is not None:
            own.append(f"tag:{node.tag}")
            # how much text its siblings have: a short paragraph of a long article isn't a short box
            own.append(f"siblings:{min(13, around[id(node.parent)].bit_length())}")
            own.append("sibling" if i and page[i - 1].node is not None and page[i - 1].node.parent is node.parent else "no sibling")
            if node.parent is not None:
                own.append(f"parent:{node.parent.tag}")
                own.append(f"path:{node.tag}<{node.parent.tag}" + ("" if any(x.startswith("name:") for x in node.names) else ", unnamed"))
            own.extend(node.names)
        else:
            own.append("tag:")
        out.append(own)
    return out


@dataclass(frozen=True)
class Model:
    """Weight of each feature for `main` over `other`, and of a label after another: [before][after]."""

    weights: dict[str, float]
    steps: tuple[tuple[float, float], tuple[float, float]]

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi: the most likely labels of a page's blocks; ties are not main."""
        if not page:
            return []
        get = self.weights.get
        score = [sum(get(f, 0.0) for f in fs) for fs in features(page)]
        (s00, s01), (s10, s11) = self.steps
        other, main, back = 0.0, score[0], []
        for s in score[1:]:
            back.append((main + s10 > other + s00, main + s11 > other + s01))
            other, main = max(other + s00, main + s10), max(other + s01, main + s11) + s
        label = main > other
        out = [label]
        for from_main in reversed(back):
            label = from_main[label]
            out.append(label)
        return out[::-1]


def train(pages: list[tuple[list[Block], list[bool]]], epochs: int = 40, decay: float = 1e-4, rate: float = 0.05, seed: int = 5) -> Model:
    """Conditional log-likelihood by Adam steps over one page at a time; features seen once teach nothing."""
    rows = [(features(p), labels) for p, labels in pages if p]
    seen = Counter(f for fs, _ in rows for own in fs for f in own)
    names = sorted(f for f, c in seen.items() if c > 1)
    at = {f: i for i, f in enumerate(names)}
    data = []
    for fs, labels in rows:
        index = [[at[f] for f in own if f in at] for own in fs]
        flat = np.array([i for own in index for i in own])
        owner = np.repeat(np.arange(len(index)), [len(own) for own in index])
        data.append((flat, owner, np.array(labels, dtype=float)))
    n = len(names)
    w, m, v = np.zeros(n + 4), np.zeros(n + 4), np.zeros(n + 4)
    shuffle = random.Random(seed)
    order = list(range(len(data)))
    t = 0
    for _ in range(epochs):
        shuffle.shuffle(order)
        for k in order:
            flat, owner, y = data[k]
            size = len(y)
            score = np.bincount(owner, w[flat], minlength=size)
            p, pairs = _marginals(score, w[n:].reshape(2, 2))
            g = np.zeros(n + 4)
            np.add.at(g, flat, (p - y)[owner])
            truth = np.zeros((2, 2))
            labels = y.astype(int)
            np.add.at(truth, (labels[:-1], labels[1:]), 1)
            g[n:] = (pairs - truth).ravel()
            g = g / math.sqrt(size) + decay * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            now = rate * (1 - (t - 1) / (epochs * len(data)))
            w = w - now * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = w[n:].round(6).reshape(2, 2)
    steps = ((float(s[0, 0]), float(s[0, 1])), (float(s[1, 0]), float(s[1, 1])))
    return Model({f: round(float(w[i]), 6) for f, i in at.items()}, steps)


def _marginals(score: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(main) of each block, and expected numbers of each label after each, by forward and backward sums."""
    n = len(score)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = 0.0, score[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp(ahead[i - 1, 0] + steps[0], ahead[i - 1, 1] + steps[1]) + (0.0, score[i])
    for i in range(n - 2, -1, -1):
        after = behind[i + 1] + (0.0, score[i + 1])
        behind[i] = np.logaddexp(steps[:, 0] + after[0], steps[:, 1] + after[1])
    total = np.logaddexp(ahead[-1, 0], ahead[-1, 1])
    p = np.exp(ahead[:, 1] + behind[:, 1] - total)
    after = behind[1:] + np.stack([np.zeros(n - 1), score[1:]], axis=1)
    pairs = np.exp(ahead[:-1, :, None] + steps[None] + after[:, None, :] - total).sum(axis=0) if n > 1 else np.zeros((2, 2))
    return p, pairs


class _Page:
    """A labelled page in the making."""

    def __init__(self) -> None:
        self.parts: list[str] = []

    def raw(self, text: str) -> None:
        self.parts.append(text)

    def text(self, text: str, main: bool) -> str:
        """Text that carries its label through the parser."""
        return ("\ue001" if main else "\ue000") + escape(text, quote=False)


def layout(draw: random.Random, title: str, body: list[str], other: list[str]) -> str:
    """A page about `body` in one of many layouts, its furniture filled with `other`; text is marked with its label."""
    page = _Page()
    main, furniture = (lambda s: page.text(s, True)), (lambda s: page.text(s, False))
    pick = draw.choice
    some = lambda n: " ".join(pick(other).split()[:n]) or "x"
    link = lambda s: f'<a href="/{draw.randrange(999)}">{furniture(s)}</a>'

    def items(n: int, words: int) -> str:
        return "".join(f"<li>{link(some(words))}</li>" for _ in range(n))

    def box(name: str, inner: str, tags: tuple[str, ...] = ("div", "section")) -> str:
        tag = pick(tags)
        return f"<{tag} {pick(('class', 'id'))}=\"{name}\">{inner}</{tag}>"

    def ad() -> str:
        lead = pick(("", "Advertisement", "Sponsored", "Ad"))
        inner = (f"<span>{furniture(lead)}</span> " if lead else "") + furniture(some(draw.randrange(3, 30)))
        return box(pick(("ad", "ads", "advert", "ad-slot", "banner-ad", "sponsored", "promo", "advertisement")), pick((f"<p>{inner}</p>", inner)))

    def notice() -> str:
        lead = pick(("We use cookies.", "This site uses cookies. Accept all", "Please enable JavaScript.", "Notice:", "Subscribe to our newsletter", "Welcome!"))
        inner = f"<p>{furniture(lead + ' ' + some(draw.randrange(0, 25)))}</p>" + pick(("", f"<button>{furniture(pick(('Accept', 'OK', 'Close')))}</button>"))
        return box(pick(("cookie-notice", "notice", "consent", "banner", "alert", "gdpr", "popup", "cookie", "message")), inner, ("div", "section", "aside"))

    def form() -> str:
        label = pick(("Email", "Search", "Name", "Sign up", "Login", "Your comment"))
        return f'<form action="/f"><label>{furniture(label)}</label><input name="q"><p>{furniture(some(draw.randrange(1, 20)))}</p><button>{furniture(pick(("Send", "Submit", "Search", "Subscribe")))}</button></form>'

    def sidebar() -> str:
        inner = f"<h3>{furniture(pick(('Related', 'Popular', 'Latest', 'More', 'About', some(2))))}</h3>"
        inner += pick((f"<ul>{items(draw.randrange(2, 8), 6)}</ul>", f"<p>{furniture(some(30))}</p>", f"<p>{furniture(some(12))}</p><ul>{items(3, 4)}</ul>"))
        if draw.random() < 0.5:
            return f"<aside>{inner}</aside>"
        return box(pick(("sidebar", "side", "related", "widget", "right-column", "rail", "aside", "recommended", "more")), inner)

    def comments() -> str:
        out = [pick((f"<h3>{furniture(pick(('Comments', 'Reader comments', '3 comments', 'Leave a reply')))}</h3>", ""))]
        for _ in range(draw.randrange(1, 6)):
            by = pick((f"<b>{furniture(some(1))}</b> ", f"<span class=\"user\">{furniture(some(2) + ' says:')}</span> ", f"<p>{furniture(some(2))}</p>", ""))
            out.append(pick(("<div class=\"comment\">{}</div>", "<li class=\"comment\">{}</li>", "<div class=\"reply\">{}</div>", "<article class=\"comment\">{}</article>", "<div>{}</div>")).format(by + f"<p>{furniture(some(draw.randrange(4, 60)))}</p>"))
        return box(pick(("comments", "comment-list", "disqus", "responses", "reader-comments", "replies", "discussion")), "".join(out), ("div", "section", "ul", "aside"))

    head = f"<head><meta charset=utf-8><title>{escape(title)}</title><style>p{{margin:0}}</style></head>"
    page.raw(pick(("<!DOCTYPE html>", "")) + "<html>" + pick((head, "")) + "<body>")
    if draw.random() < 0.4:
        page.raw(notice())
    menu = pick((f"<nav><ul>{items(draw.randrange(3, 9), 1)}</ul></nav>", f"<ul class=\"{pick(('menu', 'nav', 'navigation'))}\">{items(5, 1)}</ul>", f"<div class=\"{pick(('menu', 'nav', 'navbar', 'topbar'))}\">{' | '.join(link(some(1)) for _ in range(4))}</div>"))
    top = f"<{pick(('h1', 'h2', 'p', 'div'))}>{furniture(some(3))}</div>" + pick(("", f"<p>{furniture(some(8))}</p>"))
    if draw.random() < 0.6:
        page.raw(pick((f"<header>{top}{menu}</header>", f"<header>{top}</header>{menu}", f'<div class="{pick(("header", "masthead", "top", "site-header"))}">{top}{menu}</div>')))
    else:
        page.raw(menu)
    if draw.random() < 0.2:
        page.raw(f'<div class="{pick(("breadcrumb", "breadcrumbs", "crumbs"))}">{link(some(1))} » {link(some(2))}</div>')
    for extra in draw.sample((ad, form, sidebar, notice), draw.randrange(0, 3)):
        page.raw(extra())
    wrap = pick(("article", "article", "article", "article", "main", 'div class="content"', 'div id="main"', 'div class="post-body"', 'div class="entry-content"', 'section class="story"', 'div class="article-body"', 'div itemprop="articleBody"', 'div class="text"', "div"))
    outer = pick(("", "", "main", 'div id="page"', 'div class="container"', 'div class="wrapper"'))
    page.raw(f"<{outer}>" if outer else "")
    page.raw(f"<{wrap}>")
    if draw.random() < 0.8:
        page.raw(f"<h1>{main(title)}</h1>")
    if draw.random() < 0.2:
        page.raw(f'<p class="{pick(("byline", "meta", "author", "date"))}">{furniture(pick(("By ", "Posted ", "")) + some(3))}</p>')
    middle = draw.randrange(len(body)) if draw.random() < 0.4 and body else -1
    for i, paragraph in enumerate(body):
        tag = pick(("p",) * 14 + ("h2", "blockquote", "li", "div", "pre", "td"))
        text = main(paragraph)
        if draw.random() < 0.15:
            text = pick((f"<b>{text}", f"<em>{text}</em>", f'{text} <a href="/x">{main(some(2))}</a>', f"{text}<br>"))
        page.raw({"li": "<ul><li>{}</li></ul>", "td": "<table><tr><td>{}</td></tr></table>"}.get(tag, f"<{tag}>{{}}" + pick((f"</{tag}>",) * 5 + ("" if tag == "p" else f"</{tag}>",))).format(text))
        if i == middle:
            page.raw(pick((ad, form, sidebar, notice))())
    inside = draw.random() < 0.35
    if inside:
        page.raw(comments() if draw.random() < 0.6 else pick((ad, sidebar, form))())
    page.raw(f"</{wrap.split()[0]}>")
    for extra in draw.sample((ad, form, sidebar, comments, comments), draw.randrange(0, 4)):
        page.raw(extra())
    page.raw(f"</{outer.split()[0]}>" if outer else "")
    bottom = pick(("© 2024 ", "Copyright ", "All rights reserved. ", "", "Contact us: ")) + some(draw.randrange(2, 14))
    page.raw(pick((f"<footer>{furniture(bottom)}</footer>", f"<footer><p>{furniture(bottom)}</p><ul>{items(3, 2)}</ul></footer>", f'<div class="{pick(("footer", "foot", "bottom", "site-footer"))}">{furniture(bottom)}</div>')))
    page.raw(pick(("</body></html>", "")))
    return "".join(page.parts)


def labelled(page: str) -> tuple[list[Block], list[bool]]:
    """Blocks of a marked page, the marks read and taken out."""
    found, labels = [], []
    for block in blocks(page):
        labels.append("\ue001" in block.text)
        text = " ".join(block.text.replace("\ue000", "").replace("\ue001", "").split())
        found.append(Block(text or "x", min(block.linked, len(text)), block.node))
    return found, labels


def _given(page: list[Block]) -> list[bool]:
    """A page that names its article is labelled by that."""
    return [b.node is not None and "in:article" in b.node.names for b in page]


def learn(
    pages: DataFrame, html: str = "html", most: int = 200, layouts: int = 3, seed: int = 17, fill_blocks: int = 40, title_chars: int = 60
) -> Model:
    """Train on a bounded sample of about `most` distinct pages, even by the page's hash.

    A page counts once, however many copies it has; copies fall out on Spark.
    The layouts that a page's text fills take its first `fill_blocks` blocks,
    and as their title the first `title_chars` characters of it; the pages
    themselves are learned from whole.

    Pages with one article element are labelled by it.  Their text also fills
    `layouts` labelled pages each of our own, in many layouts, with menus,
    notices, forms, adverts, sidebars and comments made of other pages' text,
    so that no single tag or name decides.  Without pages the layouts are
    filled with words of a fixed list.
    """
    rows = pages.select(F.col(html).alias("h")).filter(F.length("h") > 0).withColumn("k", F.xxhash64("h", F.lit(23)))
    n = rows.select("k").distinct().count()
    drawn = rows.filter((F.col("k") / F.lit(2.0**64) + F.lit(0.5)) * n < most)
    texts = sorted(r.h for r in drawn.dropDuplicates(["k"]).collect())
    parsed = [p for p in map(blocks, texts) if p]
    given = [(p, _given(p)) for p in parsed]
    given = [(p, labels) for p, labels in given if any(labels)]
    bodies = [[b.text for b, main in zip(p, labels, strict=True) if main][:fill_blocks] for p, labels in given]
    if len(bodies) < 20:
        words = sorted(CUES)
        draw = random.Random(seed)
        bodies += [[" ".join(draw.choices(words, k=draw.randrange(5, 60))).capitalize() + "." for _ in range(draw.randrange(2, 9))] for _ in range(40)]
    draw = random.Random(seed)
    made = []
    for i in range(len(bodies) * layouts):
        body = bodies[i % len(bodies)]
        others = [t for _ in range(4) for t in draw.choice(bodies)]
        made.append(labelled(layout(draw, body[0][:title_chars], body[1:] or body, others)))
    return train(given + made)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """`pages` without the html, with `text`, the main blocks joined by a space, and `n_chars`.

    The whole page is parsed, also where it is malformed; character references
    are decoded and white space in a block becomes one space.  A null, empty or
    text-less page, or one without a main block, has the text ''.  Equal rows
    get equal texts; columns named like the two are replaced.
    """
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(html), F.lit("")).alias("__html"))
    schema = T.StructType([*rows.drop("__html").schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def main_text(page: str) -> str:
        found = blocks(page)
        return " ".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [main_text(h) for h in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*kept, "text", "n_chars"],
                )

    return rows.mapInArrow(run, schema)
