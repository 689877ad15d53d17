"""HTML with the standard library's parser: containers, article text, pictures, safe markup."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template head nav svg".split())
BLOCKS = set("p div li h1 h2 h3 h4 h5 h6 blockquote pre td th tr section article ul ol figure figcaption br main header".split())
# Containers that hold no article text.
BOILERPLATE_TAGS = ("aside", "footer")
BOILERPLATE = re.compile(r"(?i)(?:^|[-_\s])(subscribe|newsletter|ad|promo|paywall|signup|join-us|careers)(?:[-_\s]|$)")
SAFE_TAGS = set("p br strong em b i a ul ol li blockquote h2 h3 figure figcaption img".split())
SAFE_ATTRIBUTES = {"a": ("href",), "img": ("src", "alt")}


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self):
        yield self
        for child in self.children:
            if isinstance(child, Node):
                yield from child.walk()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.open[-1].tag == tag:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID and len(self.open) < 500:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                del self.open[at:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(source: str | None) -> Node:
    builder = _Builder()
    builder.feed(source or "")
    builder.close()
    return builder.root


def strip_containers(node: Node) -> Node:
    """The tree without aside, footer and elements whose class or id holds a listed word between its separators."""
    kept = []
    for child in node.children:
        if isinstance(child, Node):
            marks = f"{child.attrs.get('class', '')} {child.attrs.get('id', '')}".strip()
            if child.tag in BOILERPLATE_TAGS or (marks and BOILERPLATE.search(marks)):
                continue
            child = strip_containers(child)
        kept.append(child)
    return Node(node.tag, node.attrs, kept)


def serialise(node: Node | str) -> str:
    if isinstance(node, str):
        return escape(node, quote=False)
    inner = "".join(serialise(c) if node.tag not in ("script", "style") or isinstance(c, Node) else c for c in node.children)
    if not node.tag:
        return inner
    attrs = "".join(f' {k}="{escape(v)}"' for k, v in node.attrs.items())
    return f"<{node.tag}{attrs}>" if node.tag in VOID else f"<{node.tag}{attrs}>{inner}</{node.tag}>"


def text_of(node: Node | str) -> str:
    """Visible text, a line per block."""
    parts: list[str] = []

    def add(n) -> None:
        if isinstance(n, str):
            parts.append(re.sub(r"\s+", " ", n))
        elif n.tag not in HIDDEN:
            parts.append("\n" if n.tag in BLOCKS else "")
            for c in n.children:
                add(c)
            parts.append("\n" if n.tag in BLOCKS else "")

    add(node)
    lines = [line.strip() for line in "".join(parts).split("\n")]
    return "\n".join(line for line in lines if line)


#: Words that a block must have over twice its linked ones to raise the sum of a run of blocks; headings before a run belong to it.
BLOCK_COST = 8
WHOLE_BLOCKS = set("ul ol table figure blockquote pre p h1 h2 h3 h4 h5 h6".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())


def text_blocks(node: Node) -> list[Node]:
    """The page as a row of blocks: whole paragraphs, headings, lists and tables, and what stands between them, as paragraphs."""
    blocks, loose = [], []

    def close() -> None:
        if any(isinstance(c, Node) or c.strip() for c in loose):
            blocks.append(Node("p", {}, list(loose)))
        loose.clear()

    for c in node.children:
        if isinstance(c, str) or c.tag not in BLOCKS | {"html", "body", "form", "dl", "dt", "dd"} or c.tag == "br":
            loose.append(c)
            continue
        close()
        blocks += [c] if c.tag in WHOLE_BLOCKS else text_blocks(c)
    close()
    return blocks


def block_weight(block: Node) -> int:
    """Words less twice the linked ones and the cost of a block, so that menus and short notes weigh less than nothing."""
    linked = sum(len(text_of(n).split()) for n in block.walk() if n.tag == "a")
    return len(text_of(block).split()) - 2 * linked - BLOCK_COST


def main_run(root: Node) -> Node:
    """The run of blocks of greatest summed weight, with the headings just before it; the whole page if no block weighs anything."""
    blocks = text_blocks(root)
    best, run, start = (0, 0, 0), 0, 0
    for at, weight in enumerate(map(block_weight, blocks)):
        if run <= 0:
            run, start = 0, at
        run += weight
        best = max(best, (run, start, at + 1), key=lambda x: x[0])
    _, first, last = best
    while first and last and blocks[first - 1].tag in HEADINGS:
        first -= 1
    return Node("", {}, blocks[first:last]) if last else root


def main_node(root: Node) -> Node:
    """The longest article or main element, else the best run of blocks."""
    for tag in ("article", "main"):
        if found := [n for n in root.walk() if n.tag == tag]:
            return max(found, key=lambda n: len(text_of(n)))
    return main_run(root)


def article_text(source: str | None) -> str:
    return text_of(main_node(strip_containers(parse(source))))


def sanitize(source: str | None) -> str:
    """Only listed tags and attributes; links and pictures only with http, https or mailto; all text stays, scripts go."""

    def render(n) -> str:
        if isinstance(n, str):
            return escape(n, quote=False)
        if n.tag in ("script", "style", "noscript", "template"):
            return ""
        inner = "".join(map(render, n.children))
        if n.tag not in SAFE_TAGS:
            return inner
        attrs = {k: v for k, v in n.attrs.items() if k in SAFE_ATTRIBUTES.get(n.tag, ())}
        attrs = {k: v for k, v in attrs.items() if k == "alt" or re.match(r"(?i)(https?:|mailto:|/|#)", v.strip())}
        shown = "".join(f' {k}="{escape(v)}"' for k, v in attrs.items())
        return f"<{n.tag}{shown}>" if n.tag in VOID else f"<{n.tag}{shown}>{inner}</{n.tag}>"

    return render(parse(source))


def structured(source: str | None) -> str:
    """Headings one level down from h2, paragraphs, quotes, lists and figures with inline emphasis; links become text; calls to action go."""
    from tidemark.functions.text import _PY_CTA, LEAST_KEPT

    out: list[tuple[str, str]] = []

    def inline(n) -> str:
        if isinstance(n, str):
            return escape(re.sub(r"\s+", " ", n), quote=False)
        if n.tag == "br":
            return " "
        inner = "".join(map(inline, n.children)) if n.tag not in HIDDEN else ""
        name = {"b": "strong", "strong": "strong", "i": "em", "em": "em"}.get(n.tag)
        return f"<{name}>{inner}</{name}>" if name and inner.strip() else inner

    def add(n) -> None:
        for c in n.children:
            if not isinstance(c, Node) or c.tag in HIDDEN:
                continue
            body = inline(c).strip()
            if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                out.append((f"h{min(3, int(c.tag[1]) + 1)}", body))
            elif c.tag in ("p", "blockquote", "figcaption") and body:
                out.append((c.tag, body))
            elif c.tag in ("ul", "ol"):
                items = [inline(x).strip() for x in c.children if isinstance(x, Node) and x.tag == "li"]
                out.append((c.tag, "".join(f"<li>{x}</li>" for x in items if x and not _PY_CTA.search(x))))
            else:
                add(c)

    add(main_node(strip_containers(parse(source))))
    whole = [f"<{t}>{b}</{t}>" for t, b in out if b]
    kept = [f"<{t}>{b}</{t}>" for t, b in out if b and not _PY_CTA.search(b)]
    return "\n".join(kept if sum(map(len, kept)) >= LEAST_KEPT * sum(map(len, whole)) else whole)


def images(source: str | None, base: str) -> list[tuple[int, str, str]]:
    """(place, absolute URL, caption) of pictures in order; the page's own preview picture has place -1."""
    root, found = parse(source), []
    for n in root.walk():
        if n.tag == "meta" and n.attrs.get("property") == "og:image" and n.attrs.get("content"):
            found.append((-1, urljoin(base, n.attrs["content"]), ""))
    captions = {id(i): text_of(c) for f in root.walk() if f.tag == "figure" for i in f.walk() if i.tag == "img" for c in f.walk() if c.tag == "figcaption"}
    for at, n in enumerate(n for n in root.walk() if n.tag == "img"):
        if (src := n.attrs.get("src") or n.attrs.get("data-src")) and not src.startswith("data:"):
            found.append((at, urljoin(base, src), captions.get(id(n), n.attrs.get("alt", ""))))
    return found
