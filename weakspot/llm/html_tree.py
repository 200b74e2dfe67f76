"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Each node is content or not; what a node looks like gives it a potential, and each
parent-child edge has a potential for the pair. Sum-product messages, upward from the leaves and then downward from the root,
give every node's exact marginal; the text of nodes that are content with probability 0.5 or more, in page order, is the main
text. The potentials are trained on labelled pages by maximum likelihood; `sample_pages` makes such pages where none are given.
"""

from __future__ import annotations

import html
import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, small_batches

#: Elements that start a block of their own (fixed values of HTML).
BLOCKS = frozenset(
    "html body main article section header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre figure figcaption form fieldset address details summary hr center dialog menu hgroup search legend".split()
)
#: Elements whose content is read up to their own end tag and is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Elements that hold no text of the page: the head, what isn't shown, and parts of forms.
SKIPPED = frozenset("head template noscript select option button datalist defs desc metadata".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A start tag of the first ends an open one of the second kinds, up to the nearest of the third (fixed values of HTML).
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
}
#: One attribute as HTML reads it: a quote opens a value only right after the equals sign.
ONE = r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]+))?)?"""
ATTRIBUTE = re.compile(ONE)
#: Comments (which "-->", "--!>", or at once ">" and "->" end), other markup, and tags with their attributes.
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</[^a-zA-Z>][^>]*>|</>|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|" + re.sub(r"\((?!\?)", "(?:", ONE) + ")*+)>", re.S)
NAMING = frozenset(["class", "id", "role", "aria-label"])
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")

#: Words of class, id and role names by what they speak of.
HINTS = {
    "nav": "nav navbar menu breadcrumb breadcrumbs pagination pager toc navigation tabs skip",
    "ad": "ad ads advert adverts advertisement banner promo sponsor sponsored promoted adsense doubleclick",
    "comment": "comment comments reply replies disqus respond discussion reviews",
    "foot": "footer copyright colophon bottom legal footnav contentinfo",
    "head": "header masthead topbar logo branding sitehead toolbar",
    "side": "sidebar side aside related recommended widget widgets rail trending popular more complementary",
    "notice": "cookie cookies notice consent gdpr alert popup modal overlay newsletter subscribe signup paywall toast notification",
    "form": "form login search signin register subscribe-form searchbox poll",
    "share": "share social sharing follow tags tag meta byline author date",
    "main": "content article post entry main story body text page articlebody maincontent post-body prose blog",
}
HINT = {word: kind for kind, words in HINTS.items() for word in words.split()}
PARTS = re.compile(r"[a-zA-Z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("tag", "names", "parent", "children", "text", "linked", "skipped", "below", "below_linked", "features", "place", "edge")

    def __init__(self, tag: str, names: tuple, parent, skipped: bool = False):
        self.tag, self.names, self.parent, self.children, self.skipped = tag, names, parent, [], skipped
        self.text, self.linked = [], 0


def is_hidden(attributes: str) -> bool:
    """Whether an element isn't shown, by its own attributes."""
    if "idden" not in attributes and "one" not in attributes and "IDDEN" not in attributes and "ONE" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden" or name == "style" and UNSEEN.search(html.unescape(m[2] or m[3] or m[4] or "")):
            return True
    return False


def parse(page: str) -> list[Node]:
    """Block nodes of a page in page order, the root first; broken nesting is mended as far as blocks need it.

    Elements that hold no text of the page are nodes of the way down only: they end where their end tag or an implied end does,
    as all elements, and nothing under them is kept.
    """
    root = Node("html", (), None)
    nodes, here = [root], root
    at, links = 0, 0
    # text after a child belongs to a block of its own, so that texts come in page order
    while token := TOKEN.search(page, at):
        start, end = token.span()
        if start > at:
            here = _add(here, page[at:start], links, nodes)
        at = end
        tag = token[2]
        if tag is None:
            continue
        tag, closing, attributes = tag.lower(), token[1] == "/", token[3]
        if not closing and tag in RAW:
            close = re.compile(f"</{tag}\\s*>", re.I).search(page, end)
            at = close.end() if close else len(page)
            continue
        block = here if here.tag != "#text" else here.parent
        if closing and (tag in BLOCKS or tag in SKIPPED or block.skipped):
            up = block
            while up is not None and up.tag != tag:
                # an inline end tag ends nothing outside what is skipped
                up = up.parent if tag in BLOCKS or tag in SKIPPED or up.skipped else None
            if up is not None and up.parent is not None and (tag in BLOCKS or up.skipped):
                here, links = up.parent, 0 if tag in BLOCKS else links
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if closing:
            continue
        hidden = block.skipped or tag in SKIPPED or bool(attributes) and is_hidden(attributes)
        if tag in ("html", "body"):
            if tag == "body" and block.tag == "head":
                here = block = root
            if not block.skipped:
                block.names += _hints(attributes)
            continue
        if block.tag == "head" and tag in BLOCKS:
            block, hidden = root, is_hidden(attributes)
        if tag == "br":
            if not block.skipped:
                here = _add(here, " ", links, nodes)
        elif tag in BLOCKS:
            up = _parent_for(tag, block)
            hidden = up.skipped or is_hidden(attributes)
            here = Node(tag, _hints(attributes), up, hidden)
            if not up.skipped:
                up.children.append(here)
                nodes.append(here)
            links = 0
            if tag == "hr":
                here = up
        elif hidden and tag not in VOID and not attributes.endswith("/"):
            here = Node(tag, (), block, True)
    if at < len(page):
        _add(here, page[at:], links, nodes)
    return nodes


def _parent_for(tag: str, block: Node) -> Node:
    """The node under which a new block goes, after the ends that its start tag implies."""
    up = block
    while True:  # a block ends an open paragraph, and what is open in it
        x = up
        while x.tag not in BLOCKS and x.parent is not None:
            x = x.parent
        if x.tag != "p" or x.parent is None:
            break
        up = x.parent
    if tag in CLOSES:
        ended, limit = CLOSES[tag]
        found, x = None, up
        while x is not None and x.tag not in limit:
            if x.tag in ended:
                found = x
            x = x.parent
        return found.parent if found is not None else up
    if tag[0] == "h" and tag[1:].isdigit() and up.tag[0] == "h" and up.tag[1:].isdigit():
        return up.parent
    return up


def _add(here: Node, text: str, links: int, nodes: list[Node]) -> Node:
    if here.skipped:
        if here.tag != "head" or not text.strip():
            return here
        here = here.parent  # text ends the head
    if here.tag == "#text" or not here.children:
        block = here
    else:
        if not text.strip():
            return here
        block = Node("#text", (), here)
        here.children.append(block)
        nodes.append(block)
    block.text.append(text)
    if links:
        block.linked += len(text)
    return block


def _hints(attributes: str) -> tuple:
    if not attributes or "=" not in attributes:
        return ()
    values = [m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes) if m[1].lower() in NAMING]
    return tuple(sorted({HINT[w.lower()] for v in values for w in PARTS.findall(CAMEL.sub(" ", v)) if w.lower() in HINT}))


def block_text(node: Node) -> str:
    return SPACE.sub(" ", html.unescape("".join(node.text))).strip()


def _bin(n: int) -> int:
    return 0 if n == 0 else min(9, int(math.log2(n) / 1.5) + 1)


#: Kinds of tags: nodes of one kind share potentials.
KIND = {t: k for k, ts in {"p": "p blockquote pre", "h": "h1 h2 h3 h4 h5 h6 hgroup", "list": "ul ol dl menu", "item": "li dt dd", "table": "table thead tbody tfoot tr", "cell": "td th caption", "box": "div section center details summary figure figcaption", "#text": "#text"}.items() for t in ts.split()}


def describe(nodes: list[Node]) -> None:
    """Sets each node's features, its edge's kind and its place among its siblings."""
    for i, node in enumerate(nodes):
        node.place = i
    for node in reversed(nodes):
        own = sum(map(len, node.text))
        node.below = own + sum(c.below for c in node.children)
        node.below_linked = node.linked + sum(c.below_linked for c in node.children)
    for node in nodes:
        kind = KIND.get(node.tag, node.tag)
        links = 0 if not node.below else min(4, int(4 * node.below_linked / node.below + 0.5))
        node.features = [f"t:{kind}", f"l:{links}", f"n:{_bin(node.below)}", f"o:{kind}:{_bin(sum(map(len, node.text)))}", *(f"c:{x}" for x in node.names)]
        if node.children:  # how much its own paragraphs say, and how many they are
            said = [sum(map(len, c.text)) for c in node.children if c.tag == "p"]
            node.features += [f"d:{_bin(sum(said))}", f"m:{min(4, len(said))}:{_bin(sum(said) // max(1, len(said)))}"]
        if not node.names:
            node.features.append(f"c-:{kind}")
        above = node.parent
        held = "" if above is None else "main" if above.tag in ("article", "main") or "main" in above.names else "comment" if "comment" in above.names else "other" if above.names else KIND.get(above.tag, above.tag)
        node.edge = f"e:{held}>{kind}"


def marginals(nodes: list[Node], weights: dict) -> tuple[list[float], dict]:
    """P(content) of each node, and each edge kind's expected pairs (parent, child)."""
    n = len(nodes)
    own = [sum(weights.get(f, 0.0) for f in node.features) for node in nodes]
    up: list[tuple[float, float]] = [(0.0, 0.0)] * n
    inside = [[0.0, own[i]] for i in range(n)]
    edges = {}
    for i in range(n - 1, 0, -1):  # upward: children come after their parents
        node = nodes[i]
        e = edges.get(node.edge)
        if e is None:
            e = edges[node.edge] = [[weights.get((node.edge, a, b), 0.0) for b in (0, 1)] for a in (0, 1)]
        message = tuple(_add_logs(inside[i][0] + e[a][0], inside[i][1] + e[a][1]) for a in (0, 1))
        up[i] = message
        above = inside[node.parent.place]
        above[0] += message[0]
        above[1] += message[1]
    outside = [(0.0, 0.0)] * n
    p = [0.0] * n
    pairs: dict = {}
    for i, node in enumerate(nodes):  # downward
        if i:
            j, e = node.parent.place, edges[node.edge]
            rest = [outside[j][a] + inside[j][a] - up[i][a] for a in (0, 1)]
            outside[i] = (_add_logs(rest[0] + e[0][0], rest[1] + e[1][0]), _add_logs(rest[0] + e[0][1], rest[1] + e[1][1]))
            joint = [[rest[a] + e[a][b] + inside[i][b] for b in (0, 1)] for a in (0, 1)]
            top = max(map(max, joint))
            joint = [[math.exp(x - top) for x in r] for r in joint]
            total = sum(map(sum, joint))
            held = pairs.setdefault(node.edge, [[0.0, 0.0], [0.0, 0.0]])
            for a in (0, 1):
                for b in (0, 1):
                    held[a][b] += joint[a][b] / total
        d = outside[i][0] + inside[i][0] - outside[i][1] - inside[i][1]
        p[i] = 1 / (1 + math.exp(min(d, 700.0))) if d > 0 else 1 - 1 / (1 + math.exp(min(-d, 700.0)))
    return p, pairs


def _add_logs(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a >= b else b + math.log1p(math.exp(a - b))


#: First step of the training, which shrinks to nothing over its rounds.
RATE = 0.3


def train(pages: list[tuple[str, list[str]]], rounds: int = 60) -> dict:
    """Potentials from pages and the texts of their content blocks, by gradient ascent on the likelihood of the trees."""
    trees = []
    for page, wanted in pages:
        nodes = parse(page)
        describe(nodes)
        left = list(wanted)
        label = [0] * len(nodes)
        for i, node in enumerate(nodes):
            text = block_text(node)
            if text and text in left:
                left.remove(text)
                label[i] = 1
        # an element without own text is content if most of the text below it is; the page itself never is
        good = [sum(map(len, x.text)) if y else 0 for x, y in zip(nodes, label, strict=True)]
        for i in range(len(nodes) - 1, 0, -1):
            if nodes[i].children and not block_text(nodes[i]) and 2 * good[i] > nodes[i].below:
                label[i] = 1
            good[nodes[i].parent.place] += good[i]
        trees.append((nodes, label))
    weights: dict = {}
    moments: dict = {}
    for t in range(rounds):
        slope: dict = {}
        for nodes, label in trees:
            p, pairs = marginals(nodes, weights)
            for node, q, y in zip(nodes, p, label, strict=True):
                for f in node.features:
                    slope[f] = slope.get(f, 0.0) + y - q
                if node.parent is not None:
                    k = (node.edge, label[node.parent.place], y)
                    slope[k] = slope.get(k, 0.0) + 1
            for edge, table in pairs.items():
                for a in (0, 1):
                    for b in (0, 1):
                        slope[edge, a, b] = slope.get((edge, a, b), 0.0) - table[a][b]
        for k in slope.keys() | weights.keys():
            g = slope.get(k, 0.0) / len(trees) - 0.001 * weights.get(k, 0.0)
            m, v = moments.get(k, (0.0, 0.0))
            m, v = moments[k] = 0.8 * m + 0.2 * g, 0.95 * v + 0.05 * g * g
            weights[k] = weights.get(k, 0.0) + RATE * (1 - t / rounds) * (m / (1 - 0.8 ** (t + 1))) / (math.sqrt(v / (1 - 0.95 ** (t + 1))) + 1e-4)
    return weights


def sample_pages(n: int = 160, seed: int = 1, plain: float = 0.0) -> list[tuple[str, list[str]]]:
    """Labelled pages made for training: page, texts of its content blocks.

    `plain`: share of elements with names that say nothing (or none, or a wrong one) and of articles in plain boxes; such pages
    teach what links, lengths and places tell.
    """
    dice = random.Random(seed)
    words = ["".join(dice.choice("bdfgklmnprstvz") + dice.choice("aeiou") for _ in range(dice.randint(1, 4))) for _ in range(400)]
    say = lambda a, b: " ".join(dice.choice(words) for _ in range(dice.randint(a, b)))

    def links(a, b, item=True):
        one = (lambda x: f"<li>{x}</li>") if item else (lambda x: x)
        body = " ".join(one(f'<a href="/{say(1, 1)}">{say(1, 3)}</a>') for _ in range(dice.randint(a, b)))
        return f"<ul>{body}</ul>" if item else body

    def named(kind, tag="div"):
        if dice.random() < plain:
            name = "".join(dice.choice("bcdfghjkqwxz0123456789_") for _ in range(dice.randint(2, 7)))
            if dice.random() < 0.15:
                name = dice.choice(list(HINT))
            return f'<{tag} class="{name}">' if dice.random() < 0.6 else f"<{tag}>"
        return f'<{tag} {dice.choice(["class", "id"])}="{dice.choice(HINTS[kind].split())}{dice.choice(["", "", "-box", " wide", "_1"])}">'

    def comments():
        """What readers say inside the article, in an element whose name tells it."""
        tag, name = dice.choice(["div", "section", "ul"]), dice.choice(HINTS["comment"].split())
        inner = "".join(dice.choice(["<p>{}</p>", '<div class="comment"><p>{}</p></div>']).format(say(2, 25)) for _ in range(dice.randint(1, 5)))
        return f'<{tag} {dice.choice(["class", "id"])}="{name}">' + (f"<h3>{say(1, 3)}</h3>" if dice.random() < 0.5 else "") + inner + f"</{tag}>"

    def boiler():
        kind = dice.choice(["nav", "nav", "ad", "ad", "side", "notice", "form", "share", "comment", "foot", "head"])
        tag = {"nav": "nav", "side": "aside", "foot": "footer", "head": "header", "form": "form", "comment": "section"}.get(kind, "div")
        if dice.random() < plain:
            tag = "div"
        bare = dice.random() < 0.5 and tag not in ("div", "section")
        opening, closing = (f"<{tag}>", f"</{tag}>") if bare else (named(kind, dice.choice([tag, "div"])), "</div>")
        if not bare:
            closing = f"</{re.match(r'<(\w+)', opening)[1]}>"
        if kind in ("nav", "share"):
            inner = links(2, 9, dice.random() < 0.7)
        elif kind == "comment":
            inner = f"<h3>{say(1, 3)}</h3>" + "".join(f"<div><p>{say(2, 25)}</p></div>" if dice.random() < 0.5 else f"<p>{say(2, 25)}</p>" for _ in range(dice.randint(1, 5)))
        elif kind == "form":
            inner = f"<label>{say(1, 4)}</label><input name=x><p>{say(1, 8)}</p>"
        elif kind == "foot":
            inner = f"&copy; {say(1, 3)} &middot; {say(1, 25)}" if dice.random() < 0.6 else f"<p>&copy; {say(1, 20)}</p>{links(1, 5)}"
        elif kind == "head":
            inner = f"<h1>{say(1, 3)}</h1><p>{say(1, 6)}</p>" if dice.random() < 0.5 else say(1, 6)
        elif kind == "side":
            inner = f"<h3>{say(1, 4)}</h3>{links(2, 8)}" if dice.random() < 0.5 else f"<h3>{say(1, 4)}</h3><p>{say(4, 40)}</p>"
        else:
            inner = say(2, 30) if dice.random() < 0.5 else f"<p>{say(2, 30)}</p>"
        return opening + inner + closing

    def article():
        wanted, out = [], []

        def block(tag, a, b):
            text = say(a, b)
            wanted.append(text)
            shown = text
            if dice.random() < 0.2 and " " in text:
                first, rest = text.split(" ", 1)
                shown = f'<a href="/{first}">{first}</a> {rest}' if dice.random() < 0.5 else f"<b>{first}</b> {rest}"
            out.append(f"<{tag}>{shown}" + ("" if tag in ("p", "li") and dice.random() < 0.15 else f"</{tag}>"))

        if dice.random() < 0.85:
            block("h1", 1, 9)
        for _ in range(dice.choice([1, 2, 3, 5, 8, 13, 21, 40])):
            kind = dice.random()
            if kind < 0.75:
                block("p", 1, dice.choice([3, 15, 60, 150]))
            elif kind < 0.83:
                block(dice.choice(["h2", "h3"]), 1, 6)
            elif kind < 0.9:
                out.append("<ul>")
                for _ in range(dice.randint(2, 5)):
                    block("li", 1, 12)
                out.append("</ul>")
            elif kind < 0.95:
                block("blockquote", 4, 30)
            else:
                out.append("<table><tr>")
                for _ in range(dice.randint(2, 4)):
                    block("td", 1, 4)
                out.append("</tr></table>")
            if dice.random() < 0.2:  # a box inside the article
                out.append(dice.choice(["<figure>", "<section>", "<div>", "<div>", "<details>", named("main")]))
                kind = re.match(r"<(\w+)", out[-1])[1]
                if kind == "details":
                    block("summary", 1, 4)
                for _ in range(dice.randint(1, 3)):
                    block("figcaption" if kind == "figure" else "p", 2, 30)
                out.append(f"</{kind}>")
            if dice.random() < 0.04:
                out.append(boiler())
            if dice.random() < 0.02:
                out.append(comments())
        if dice.random() < 0.15:
            out.append(comments())
        style = dice.random() if dice.random() >= plain else 0.6
        if style < 0.5:
            return "<article>" + "".join(out) + "</article>", wanted
        if style < 0.8:
            tag = dice.choice(["div", "section", "main", "article"])
            return named("main", tag) + "".join(out) + f"</{tag}>", wanted
        return "<main>" + "".join(out) + "</main>", wanted

    pages = []
    for _ in range(n):
        body, wanted = article()
        before, after = [boiler() for _ in range(dice.randint(0, 4))], [boiler() for _ in range(dice.randint(0, 4))]
        while plain and dice.random() < 0.5:
            between = boiler() if dice.random() < 0.5 else ""
            body = f"{named('main')}{between}{body}</div>"
        if dice.random() < 0.3:
            body = f'<div class="{dice.choice(["wrap", "row", "container", "page"])}">{body}{boiler() if dice.random() < 0.5 else ""}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{say(1, 5)}</title></head><body>{''.join(before)}{body}{''.join(after)}</body></html>", wanted))
    return pages


_default: dict = {}


def default_weights() -> dict:
    if not _default:
        _default.update(train(sample_pages() + sample_pages(160, 2, plain=0.8)))
    return _default


def main_text(page: str, weights: dict) -> str:
    nodes = parse(page)
    describe(nodes)
    texts = [block_text(node) if node.text else "" for node in nodes]
    if not any(texts):
        return ""
    p, _ = marginals(nodes, weights)
    return "\n".join(t for t, q in zip(texts, p, strict=True) if t and q >= 0.5)


def extract(pages: DataFrame, labelled: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages, from the whole html (null or empty: empty text).

    Elements that their own attributes hide (hidden, display: none, visibility: hidden) are not part of the text.

    `labelled`: pages and the texts of their content blocks to train on, instead of those of sample_pages(). Repeated rows are
    judged alike; null ids and urls stay; other columns are ignored; an empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    weights = train(labelled) if labelled else default_weights()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            for part, _, _ in chunks(batch, "html", CHUNK_BYTES):
                texts = [main_text(x, weights) if x else "" for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
