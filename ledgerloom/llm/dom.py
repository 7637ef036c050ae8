"""Pages as trees of block elements with their blocks of text: what the extraction of main text reads."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# HTML's elements by their role in a page.
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup "
    "legend li main menu nav ol optgroup option p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes title textarea".split())
SILENT = set("head script style template noscript iframe noembed noframes title textarea select datalist button svg math canvas audio video object map".split())
IN_HEAD = set("base basefont bgsound link meta noframes noscript script style template title".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag ends the nearest open element of these, unless one of the others stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "td", "th"}), "dd": ({"dd", "dt"}, {"dl", "td", "th"}), "dt": ({"dd", "dt"}, {"dl", "td", "th"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)*+)[\s/]*+>""")
ATTRIBUTE = re.compile(r"""([^\s/>=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


@dataclass
class Node:
    """A block element, or, with text, a block of text in one."""

    tag: str
    parent: int
    depth: int
    attributes: dict[str, str] = field(default_factory=dict)
    text: str | None = None
    words: int = 0  # at or below the node
    linked: int = 0  # of these, within links
    leaves: int = 0


def parse(page: str) -> list[Node]:
    """The tree in page order, parents before children; node 0 is the root.

    Ends of elements are implied as HTML implies them. Scripts, styles, comments, the head and form controls hold no
    text. Text between two borders of block elements is one block, its references decoded and its white space single.
    """
    nodes, stack = [Node("#root", -1, 0)], [0]
    pieces: list[tuple[str, bool]] = []
    link_at = silent = 0  # size of the stack where a link was opened; number of open silent elements

    def flush() -> None:
        if silent or not pieces:
            return
        holder = next(i for i in reversed(stack) if nodes[i].tag not in SILENT)
        text = " ".join("".join(t for t, _ in pieces).split())
        if text:
            words = text.count(" ") + 1
            linked = min(words, sum(len(t.split()) for t, inside in pieces if inside))
            nodes.append(Node("#text", holder, nodes[holder].depth + 1, {}, text, words, linked, 1))
        pieces.clear()

    def close(size: int) -> None:
        nonlocal silent, link_at
        while len(stack) > size:
            if nodes[stack[-1]].tag in BLOCK:
                flush()
            silent -= nodes[stack.pop()].tag in SILENT
        if link_at > len(stack):
            link_at = 0

    def nearest(names: set[str], borders: set[str]) -> int:
        """Place in the stack of the nearest open element of these names, 0 if a border comes first."""
        for i in range(len(stack) - 1, 0, -1):
            tag = nodes[stack[i]].tag
            if tag in names:
                return i
            if tag in borders:
                return 0
        return 0

    def say(text: str) -> None:
        if stack[-1] and nodes[stack[-1]].tag == "head" and text.strip():
            close(len(stack) - 1)
        if not silent:
            pieces.append((html.unescape(text) if "&" in text else text, bool(link_at)))

    at, end = 0, len(page)
    while at < end:
        opened = page.find("<", at)
        if opened < 0:
            say(page[at:])
            break
        if opened > at:
            say(page[at:opened])
        follows = page[opened + 1 : opened + 2]
        if follows in ("!", "?") or follows == "/" and not page[opened + 2 : opened + 3].isalpha():
            if page.startswith("<!--", opened):
                ended = [opened + len(x) for x in ("<!-->", "<!--->") if page.startswith(x, opened)] or [i + len(x) for x in ("-->", "--!>") if (i := page.find(x, opened + 4)) >= 0]
            else:
                ended = [i + 1] if (i := page.find(">", opened)) >= 0 else []
            at = min(ended, default=end)
            continue
        if not (follows == "/" or follows.isascii() and follows.isalpha()):
            say("<")
            at = opened + 1
            continue
        found = TAG.match(page, opened)
        if found is None:  # broken attributes: up to the next >, all the rest if there is none
            at = page.find(">", opened) + 1 or end
            name = re.match(r"</?([a-zA-Z][^\s/>]*)", page[opened : opened + 100])
            ends, name, rest = follows == "/", name[1].lower() if name else "", ""
            if at == end and page[-1] != ">":
                break
        else:
            at, ends, name, rest = found.end(), bool(found[1]), found[2].lower(), found[3]
        if name == "br":
            say(" ")
        elif ends:
            if name in BLOCK or name in SILENT:
                borders = {"table", "td", "th"} - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body") else set()
                i = nearest(HEADINGS if name in HEADINGS else {name}, borders)
                if i and name not in ("html", "body"):
                    close(i)
                elif name in BLOCK:
                    flush()
            elif name == "a":
                link_at = 0
        else:
            if nodes[stack[-1]].tag == "head" and name not in IN_HEAD:
                close(len(stack) - 1)
            if name in ENDS_P and (i := nearest({"p"}, {"button", "td", "th", "table", "caption", "object", "template"})):
                close(i)
            if name in ENDS and (i := nearest(*ENDS[name])):
                close(i)
            if name in HEADINGS and nodes[stack[-1]].tag in HEADINGS:
                close(len(stack) - 1)
            if name == "hr":
                flush()
            elif name == "a":
                link_at = len(stack)
            elif name in ("html", "body") and any(nodes[i].tag == name for i in stack):
                pass
            elif (name in BLOCK or name in SILENT) and name not in VOID:
                if name in BLOCK:
                    flush()
                attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(rest)} if "=" in rest else {}
                nodes.append(Node(name, stack[-1], nodes[stack[-1]].depth + 1, attributes))
                stack.append(len(nodes) - 1)
                silent += name in SILENT
            if name in RAW:
                raw = RAW_END[name].search(page, at)
                if name == "xmp":
                    say(page[at : raw.start() if raw else end].replace("&", "&amp;"))
                at = raw.end() if raw else end
                if name in SILENT:
                    close(len(stack) - 1)
    close(1)
    flush()
    for node in reversed(nodes[1:]):
        above = nodes[node.parent]
        above.words, above.linked, above.leaves = above.words + node.words, above.linked + node.linked, above.leaves + node.leaves
    return nodes
