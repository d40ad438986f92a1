"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks: stretches of text that no block-level tag divides. A block's features are its
ancestor tags, the words of their class, id and role, shapes and cue words of its text, and how it stands to the rest
of the page: its neighbours, the share and links of its container, where the container with most prose is, the first
heading. The CRF labels the chain of blocks main or other by Viterbi, and the main blocks are the text. It is trained
on the labelled pages of `training_pages`, which are generated here from a fixed seed in many layouts, more than half
of them with no names or random ones, by gradient ascent on the conditional likelihood (forward-backward).

Character references are decoded; white space in a block becomes one space; blocks are joined by a line feed.
Defined results: a null or empty page, or one without main blocks, gives the empty text; a page that breaks off
keeps what came before; unclosed tags are closed by the blocks that follow; copies of a page, and rows with one id,
give a row each; ties between labels go to other; a long page takes time and memory in proportion to its length,
however it is nested or quoted; an empty table gives an empty result; further columns are ignored, also those named as
the results are.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_text, batched

# Fixed values of HTML: tags that part blocks, tags without an end, tags whose content is plain characters, further
# tags whose content is not text, and the open tags that a new one closes.
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot"
    " th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea iframe title xmp noembed noframes".split())
OPAQUE = RAW | set("template noscript svg".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = set("ul ol dl table article section main div body html aside nav form td th select".split())

_OPEN = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?])")
_PLAIN = re.compile(r"(?:[^=]|=\s*+(?:\"[^\"]*\"|'[^']*'|(?![\"'])))*+")  # attributes whose quotes are all closed
_NEXT = re.compile(r"[^>=]*(?:(>)|=\s*([\"'])?)")
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")


class Node:
    """An open element: tag, words of class, id and role, and the element around it."""

    __slots__ = ("tag", "words", "parent", "hidden")

    def __init__(self, tag: str, words: tuple[str, ...], parent: Node | None, hidden: bool):
        self.tag, self.words, self.parent, self.hidden = tag, words, parent, hidden

    def names(self) -> list[str]:
        return [f"in:{self.tag}", *(f"word:{w}" for w in self.words)]


@dataclass
class Block:
    """text; the element it stands in; characters inside links."""

    text: str
    node: Node
    linked: int


def _attributes(raw: str) -> tuple[tuple[str, ...], bool]:
    """The words of class, id and role, and whether the element is hidden."""
    if not raw.strip(" /\n\t"):
        return (), False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    named = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = tuple(dict.fromkeys(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())))
    gone = "hidden" in found or re.search(r"display\s*:\s*none", found.get("style", ""), re.I) is not None
    return words, gone


class Scanner:
    """Places in a page. What is not found once is not looked for again, so that a page is read in linear time."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        at = self.page.find(what, at)
        if at < 0:
            self.missing.add(what)
        return at

    def tag_end(self, at: int) -> int:
        """Where the `>` of a tag is whose attributes start at `at`; -1 if it never ends."""
        end = self.find(">", at)
        if end < 0 or _PLAIN.fullmatch(self.page, at, end):
            return end
        while m := _NEXT.match(self.page, at):
            if m[1]:
                return m.end() - 1
            at = m.end()
            if m[2] and (close := self.find(m[2], at)) >= 0:
                at = close + 1
        return -1

    def end_tag(self, name: str, at: int) -> tuple[int, int] | None:
        """Where the next end tag of the name starts and ends."""
        pattern = _end_of(name)
        if name in self.missing:
            return None
        m = pattern.search(self.page, at)
        if not m:
            self.missing.add(name)
            return None
        end = self.find(">", m.end())
        return (m.start(), end + 1) if end >= 0 else None


@functools.cache
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I | re.A)


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order. Blocks without a word are left out."""
    out: list[Block] = []
    root = Node("", (), None, False)
    stack, opened, parts = [root], Counter(), []
    linked, in_link, gone, at = 0, False, 0, 0
    scan = Scanner(page)

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append(Block(text, stack[-1], min(linked, len(text))))
        parts.clear()
        linked = 0

    def pop_to(i: int) -> None:
        nonlocal gone
        flush()
        for node in stack[i:]:
            opened[node.tag] -= 1
            gone -= node.hidden
        del stack[i:]

    def text_to(end: int) -> None:
        nonlocal linked
        if not gone and end > at:
            parts.append(page[at:end])
            linked += (end - at) * in_link

    while m := _OPEN.search(page, at):
        text_to(m.start())
        if m[3]:
            end = scan.find("-->", m.end() - 2)
            at = len(page) if end < 0 else end + 3
            continue
        end = scan.tag_end(m.end()) if m[2] else scan.find(">", m.end())
        if end < 0:  # the page breaks off inside a tag
            at = len(page)
            break
        raw, at = page[m.end() : end], end + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "a":
                in_link = False
            elif name in BLOCKS:
                if opened[name] > 0:
                    pop_to(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
                else:
                    flush()
            continue
        closed = raw.endswith("/")
        if name in OPAQUE:
            if not (closed and name == "svg"):
                found = scan.end_tag(name, at)
                at = found[1] if found else len(page) if name in RAW else at
            continue
        if name == "a":
            in_link = True
        if name == "br":
            parts.append(" ")
        if name not in BLOCKS:
            continue
        flush()
        if opened["p"] > 0:
            p = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p" or stack[i].tag in SCOPES)
            if stack[p].tag == "p":
                pop_to(p)
        closes = CLOSES.get(name, ())
        if any(opened[t] > 0 for t in closes):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in closes:
                    pop_to(i)
                    break
                if stack[i].tag in SCOPES and not (name in ("tr", "td", "th") and stack[i].tag in ("td", "th")):
                    break
        if name not in VOID and not closed:
            words, hidden = _attributes(raw)
            node = Node(name, words, stack[-1], hidden)
            stack.append(node)
            opened[name] += 1
            gone += hidden
    text_to(len(page))
    flush()
    return out


# Words that often stand in parts of a page that are not the article, in four languages.
CUES = frozenset(
    "cookie cookies consent privacy subscribe newsletter login sign copyright rights reserved advertisement sponsored related comments comment"
    " reply share follow search menu home contact terms accept impressum datenschutz anmelden kommentare suche werbung accueil rechercher"
    " commentaires connexion publicité inicio buscar comentarios contacto publicidad".split()
)
PROSE = {"p", "td", "pre", "blockquote", "li", "div", "section", "article"}


def _bucket(x: int, most: int) -> int:
    return min(x.bit_length(), most)


def local_features(b: Block) -> list[str]:
    n, words = len(b.text), b.text.split(" ")
    out = ["bias", f"size:{_bucket(n, 11)}", f"words:{_bucket(len(words), 8)}", f"links:{4 * b.linked // max(n, 1)}", f"parent:{b.node.tag}"]
    out += [f"ends:{b.text[-1] in '.!?:;…。'}", f"mark:{any(c in b.text for c in '©|»·')}", f"digits:{sum(map(str.isdigit, b.text)) * 5 > n}", f"comma:{',' in b.text}"]
    if len(words) <= 40:
        cues = CUES.intersection(x.strip(".,:;!?()|»©&") for x in b.text.lower().split(" "))
        out += [f"cue:{w}" for w in cues] + [f"cues:{bool(cues)}"]
    return out


def page_features(chain: list[Block]) -> list[list[str]]:
    """Features of each block that come from the rest of the page."""
    if not chain:
        return []
    size = [len(b.text) for b in chain]
    mass, total, links, count = Counter(), Counter(), Counter(), Counter()
    holder = []  # the element that holds the block's element, or the block's own where it is no leaf
    inner = {b.node.parent for b in chain}
    for b, n in zip(chain, size):
        c = b.node if b.node in inner or b.node.parent is None else b.node.parent
        holder.append(c)
        total[c] += n
        links[c] += b.linked
        count[c] += 1
        if b.node.tag in PROSE and n >= 40:
            mass[c] += n - 2 * b.linked
            if c.parent is not None:
                mass[c.parent] += (n - 2 * b.linked) // 2
    whole = sum(size)
    best = max(mass, key=mass.__getitem__, default=None)
    depth: dict[Node, int] = {}  # how far inside the best container; -1 outside

    def inside(node: Node | None) -> int:
        walk = []
        while node is not None and node not in depth and node is not best:
            walk.append(node)
            node = node.parent
        d = -1 if node is None else 0 if node is best else depth[node]
        for x in reversed(walk):
            d = d + 1 if d >= 0 else -1
            depth[x] = d
        return d

    where = [inside(b.node) for b in chain]
    own = [i for i, d in enumerate(where) if d >= 0]
    first, last = (own[0], own[-1]) if own else (0, 0)
    h1 = next((i for i, b in enumerate(chain) if b.node.tag == "h1"), None)
    shape = [f"{min(_bucket(n, 9), 9) // 2}{2 * b.linked // max(n, 1)}{int(b.node.tag[:1] == 'h')}" for b, n in zip(chain, size)]
    out = []
    for i, (b, c) in enumerate(zip(chain, holder)):
        side = "in" if where[i] >= 0 else "before" if i < first else "after" if i > last else "between"
        f = [
            f"best:{side}:{min(where[i], 3)}",
            f"share:{4 * total[c] // whole}",
            f"held:{_bucket(count[c], 4)}",
            f"dense:{4 * links[c] // max(total[c], 1)}",
            f"mean:{_bucket(total[c] // count[c], 9)}",
            f"head:{'none' if h1 is None else (i > h1) - (i < h1)}",
            f"prev:{shape[i - 1] if i else ''}",
            f"next:{shape[i + 1] if i + 1 < len(chain) else ''}",
            f"from:{min(i, 3)}",
            f"to:{min(len(chain) - 1 - i, 3)}",
            f"flat:{b.node.parent is None or b.node.parent.tag in ('', 'body', 'html')}",
        ]
        f.append(f"{f[0]}:{f[5]}")
        out.append(f)
    return out


def features(chain: list[Block]) -> list[list[str]]:
    """All features of each block of a page, each once."""
    out = []
    for b, far in zip(chain, page_features(chain)):
        names, node = set(), b.node
        while node is not None:
            names.update(node.names())
            node = node.parent
        out.append(local_features(b) + far + sorted(names - {"in:", "in:html", "in:body"}))
    return out


# Fixed words of the layouts that training pages are made from: names of parts that are not the article, names of the
# article itself, and what such parts often say.
OTHER_NAMES = {
    "nav": "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager skip toc",
    "header": "header masthead banner topbar branding logo site",
    "footer": "footer bottom colophon copyright legal",
    "aside": "sidebar aside related widget rail recommended trending popular tags share social",
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion",
    "notice": "cookie cookies consent notice alert modal popup overlay newsletter subscribe paywall gdpr",
    "comments": "comments comment replies reply discussion respond responses thread disqus",
    "form": "form search login signup contact feedback",
}
OTHER_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}
SAYS = {
    "header": "The Daily Example|Example News|My Weblog|Notes and essays|Welcome to our site",
    "footer": "All rights reserved.|Privacy policy and terms|Imprint and contact|Powered by Example|Alle Rechte vorbehalten.|Impressum|Mentions légales|Aviso legal",
    "aside": "Related articles|Most popular|You may also like|Recent posts|Read more|Share this|Tags|Weitere Artikel|Articles liés|Lo más leído",
    "ad": "Advertisement|Sponsored|Anzeige|Publicité|Publicidad|Buy now and save 20% today!|Try it free for 30 days.",
    "notice": "We use cookies to improve your experience.|This site uses cookies.|Subscribe to our newsletter!|Please enable JavaScript.|Wir verwenden Cookies.|Accept|Sign up for free updates.",
    "comments": "Comments|Leave a reply|3 comments|Kommentare|Commentaires|Reply|Join the discussion",
    "form": "Search|Email address|Sign in|Your name|Send|Suche|Rechercher|Buscar",
    "nav": "Home|About|Contact|Menu|News|Login|Blog|Start|Accueil|Inicio",
}
#: Main text of a generated page carries this sign until the blocks are cut.
MARK = "\ue000"
MAIN_NAMES = "content article post entry body story main text page prose markdown single"
_ALPHABET = "etaoinshrdlucmfwypvbgkjqxzéèßöñ"


class Layout:
    """Makes one labelled page. style: semantic, named, random (class names without meaning), bare, flat or table."""

    STYLES = ("semantic", "named", "random", "bare", "flat", "table")

    def __init__(self, rnd: random.Random):
        self.rnd = rnd
        self.style = rnd.choices(self.STYLES, (8, 5, 6, 6, 3, 3))[0]
        self.prose_tag = "p" if rnd.random() < 0.88 else "div"
        self.terse = self.style in ("semantic", "named") and rnd.random() < 0.2  # an article of a few words

    def one_in(self, share: float) -> bool:
        return self.rnd.random() < share

    def word(self) -> str:
        return "".join(self.rnd.choices(_ALPHABET, k=self.rnd.randint(1, 11)))

    def sentence(self, lo: int, hi: int) -> str:
        noisy = self.one_in(0.05)
        ws = [self.word() + self.rnd.choice(["", "", "", "", ",", "###" if noisy else ""]) for _ in range(self.rnd.randint(lo, hi))]
        return " ".join(ws).capitalize() + self.rnd.choice([".", ".", ".", "", "!", "?"])

    def prose(self, lo: int = 1) -> str:
        return " ".join(self.sentence(lo, 14) for _ in range(self.rnd.choice([1, 1, 2, 3, 6, 12])))

    def says(self, kind: str, otherwise: str) -> str:
        return self.rnd.choice(SAYS[kind].split("|")) if self.one_in(0.45) else otherwise

    def random_name(self) -> str:
        return self.rnd.choice(["css-", "sc-", "x", "_", "jsx-"]) + "".join(self.rnd.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=self.rnd.randint(3, 7)))

    def named(self, names: str | None) -> str:
        if self.style == "random" or (self.style == "semantic" and self.one_in(0.1)):
            return f' class="{self.random_name()}"' if self.one_in(0.85) else ""
        if names is None or self.style in ("bare", "flat", "table"):
            return ""
        name = self.rnd.choice(names.split())
        return self.rnd.choice([f' class="{name}"', f' id="{name}"', f' class="{name}-{self.word()} {self.word()}"'])

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}"{self.named(None)}>{text}</a>'

    def wrap(self, body: str, names: str | None = None, tag: str = "div") -> str:
        return f"<{tag}{self.named(names)}>{body}</{tag}>"

    def p(self, text: str) -> str:
        return f"<{self.prose_tag}{self.named(None)}>{text}</{self.prose_tag}>"

    def links(self, kind: str, lo: int, hi: int) -> str:
        some = [self.link(self.says(kind, self.sentence(1, 5 if kind == "aside" else 2))) for _ in range(self.rnd.randint(lo, hi))]
        how = self.rnd.random()
        if how < 0.55:
            end = "</li>" if self.one_in(0.8) else ""
            return f"<ul{self.named(None)}>{''.join(f'<li>{x}{end}' for x in some)}</ul>"
        return " | ".join(some) if how < 0.7 else "".join(some) if how < 0.8 else "".join(self.wrap(x) for x in some)

    def inside(self, kind: str) -> str:
        rnd, says = self.rnd, self.says
        if kind == "nav":
            return self.links("nav", 2, 9)
        if kind == "header":
            return rnd.choice([f"<h1>{says('header', self.sentence(1, 4))}</h1>", self.p(says("header", self.sentence(2, 6))), self.link(says("header", self.word())), self.wrap(says("header", self.word()))])
        if kind == "footer":
            mark = rnd.choice(["&copy; ", "© 2024 ", "Copyright 2023 ", "© "]) if self.one_in(0.8) else ""
            text = mark + says("footer", rnd.choice([f"{self.word()}.example.com &middot; {self.prose()}", self.sentence(1, 9)]))
            return rnd.choice([text, self.p(text), self.p(text) + self.links("footer", 1, 5), self.links("footer", 2, 5) + self.p(text)])
        if kind == "comments":
            each = [rnd.choice(["", self.wrap(self.word(), "comment author"), f"<b>{self.word()}</b> "]) + self.p(self.prose()) + rnd.choice(["", "", self.link("Reply")]) for _ in range(rnd.randint(1, 4))]
            h = rnd.choice(["h2", "h3", "h4"])
            return f"<{h}>{rnd.choice(SAYS['comments'].split('|')) if self.one_in(0.75) else self.sentence(1, 2)}</{h}>" + "".join(self.wrap(x, OTHER_NAMES["comments"]) for x in each)
        if kind == "form":
            return f"<label>{says('form', self.sentence(1, 3))}</label><input name=q><button>{says('form', self.word())}</button>" + rnd.choice(["", self.p(self.sentence(3, 9)), f"<select><option>{self.word()}<option>{self.word()}</select>"])
        if kind == "aside":
            h = f"<h3>{says('aside', self.sentence(1, 3))}</h3>"
            return rnd.choice([h + self.links("aside", 2, 6), h + self.links("aside", 2, 6), h + self.p(self.sentence(3, 12)), self.p(self.prose())])
        text = says(kind, self.prose())
        return rnd.choice([text, self.p(text), self.p(f"{text} {self.link(says(kind, self.word()))}") + f"<button>{says(kind, self.word())}</button>"])

    def other(self, kind: str) -> str:
        own = OTHER_TAGS.get(kind, "div")
        tag = own if self.style == "semantic" and self.one_in(0.75) else "div" if self.style != "named" else self.rnd.choice(["div", "section", own])
        if tag == "form" or kind == "form":
            tag = "form" if self.one_in(0.7) else tag
        body = self.inside(kind)
        if self.style == "flat" and self.one_in(0.7):
            return body if "<" in body[:1] else self.p(body)
        return self.wrap(body, OTHER_NAMES[kind] if tag in ("div", "section") or self.one_in(0.4) else None, tag)

    def main(self, text: str) -> str:
        return MARK + text

    def article(self) -> str:
        rnd, main = self.rnd, self.main
        if self.terse:
            some = [f"<p>{main(self.sentence(1, 4))}</p>" if self.one_in(0.7) else f"<li>{main(self.sentence(1, 3))}</li>" for _ in range(rnd.randint(1, 4))]
            return (f"<h1>{main(self.sentence(1, 3))}</h1>" if self.one_in(0.4) else "") + "".join(some)
        parts = []
        if self.one_in(0.9):
            head = f"<h1{self.named(None)}>{main(self.sentence(2, 9))}</h1>"
            parts.append(self.wrap(head, None, "header") if self.one_in(0.08) else head)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 8, 10, 14])):
            x = rnd.random()
            if x < 0.72:
                inline = rnd.choice(["", "", "", "<b>", "<i>", "<em>"])
                text = self.prose() if self.one_in(0.85) else f"{self.prose()} {self.link(self.sentence(1, 3))} {self.prose()}"
                tag = self.prose_tag
                parts.append(f"<{tag}{self.named(None)}>{inline}{main(text)}" + (rnd.choice(["</p>", "</p>", "</p>", "<br>", ""]) if tag == "p" else "</div>"))
            elif x < 0.79:
                h = rnd.choice(["h2", "h2", "h3"])
                parts.append(f"<{h}>{main(self.sentence(1, 6))}</{h}>")
            elif x < 0.86:
                tag = rnd.choice(["ul", "ol"])
                parts.append(f"<{tag}>" + "".join(f"<li>{main(self.sentence(2, 12))}" + ("</li>" if self.one_in(0.8) else "") for _ in range(rnd.randint(2, 6))) + f"</{tag}>")
            elif x < 0.89:
                parts.append(f"<blockquote><p>{main(self.prose())}</p></blockquote>")
            elif x < 0.92:
                parts.append("<table><tr>" + "".join(f"<td>{main(self.sentence(1, 4))}</td>" for _ in range(rnd.randint(2, 6))) + "</tr></table>")
            elif x < 0.94:
                parts.append(f"<pre>{main(self.prose())}</pre>")
            elif x < 0.96:
                parts.append(f"<figure><img src=x><figcaption>{main(self.sentence(2, 8))}</figcaption></figure>")
            elif x < 0.98 and len(parts) > 1 and self.style != "flat":
                parts.append(self.other(rnd.choice(["ad", "aside", "notice", "form"])))
            else:
                parts.append(f"<svg><path d='M0'/></svg><p>{main(self.prose(3))}</p>")
        return "".join(parts)

    def page(self) -> str:
        rnd = self.rnd
        before = [self.other(k) for k in ("notice", "header", "nav", "ad", "form") if self.one_in(0.75 if k == "nav" else 0.35)]
        after = [self.other(k) for k in ("aside", "comments", "ad", "nav", "form", "footer") if self.one_in(0.75 if k == "footer" else 0.3)]
        rnd.shuffle(before)
        if after and self.style != "flat":
            last = after.pop()
            rnd.shuffle(after)
            after.append(last)
        body = self.article()
        if self.style == "semantic":
            x = rnd.random()
            body = f"<article>{body}{self.other('comments') if self.one_in(0.1) else ''}</article>" if x < 0.75 else f"<main>{body}</main>"
            body = f"<main>{body}</main>" if x < 0.2 else body
        elif self.style == "named":
            body = self.wrap(body, MAIN_NAMES)
        elif self.style in ("random", "bare"):
            body = self.wrap(body)
            while self.one_in(0.3):
                body = self.wrap(body)
        elif self.style == "table":
            cells = [*("<td>" + x + "</td>" for x in before[:1]), "<td>" + body + "</td>", *("<td>" + x + "</td>" for x in after[:1])]
            return "<html><body>" + "".join(before[1:]) + "<table><tr>" + "".join(cells) + "</tr></table>" + "".join(after[1:])
        if self.style != "flat" and self.one_in(0.25):  # a column beside the article
            kinds = [k for k in ("aside", "ad", "nav") if self.one_in(0.5)]
            rail = self.wrap("".join(self.other(k) for k in kinds), OTHER_NAMES["aside"]) if kinds else ""
            body = self.wrap(rail + body if self.one_in(0.4) else body + rail)
        page = "".join(before) + body + "".join(after)
        while self.style != "flat" and self.one_in(0.35):
            page = self.wrap(page, rnd.choice(["wrapper", "container", "root app", "site page"]))
        head = rnd.choice(["<head><title>x</title></head><body>", "<head><title>x</title><body>", "<body>", ""])
        return f"<!DOCTYPE html><html>{head}{page}" + rnd.choice(["</body></html>", ""])


def training_pages(n: int = 1000, seed: int = 7) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: blocks, and for each whether it is main text."""
    rnd, pages = random.Random(seed), []
    for _ in range(n):
        marked = blocks(Layout(rnd).page())
        if marked:
            pages.append(([Block(b.text.replace(MARK, "").strip() or MARK, b.node, b.linked) for b in marked], [int(MARK in b.text) for b in marked]))
    return pages


@dataclass
class Crf:
    """Weights of two labels (0 other, 1 main): of each feature, and of each step from label to label."""

    index: dict[str, int]
    emit: np.ndarray
    step: np.ndarray

    def scores(self, chain: list[Block]) -> list[tuple[float, float]]:
        if not hasattr(self, "rows"):
            self.rows = [tuple(x) for x in self.emit.tolist()]
        index, rows, out = self.index, self.rows, []
        known = {None: (frozenset(), 0.0, 0.0)}  # of each element: features of it and those around it, and their scores

        for b, far in zip(chain, page_features(chain)):
            walk, node = [], b.node
            while node not in known:
                walk.append(node)
                node = node.parent
            for x in reversed(walk):
                seen, o, m = known[x.parent]
                new = {j for f in x.names() if (j := index.get(f)) is not None and j not in seen}
                known[x] = (seen | new, o + sum(rows[j][0] for j in new), m + sum(rows[j][1] for j in new)) if new else known[x.parent]
            _, o, m = known[b.node]
            for f in local_features(b) + far:
                if (j := index.get(f)) is not None:
                    o += rows[j][0]
                    m += rows[j][1]
            out.append((o, m))
        return out

    def decode(self, chain: list[Block]) -> list[int]:
        """Viterbi."""
        if not chain:
            return []
        s = self.scores(chain)
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b = s[0]
        back = []
        for x, y in s[1:]:
            back.append((a + s00 < b + s10, a + s01 <= b + s11))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label, path = int(b > a), []
        for from_other, from_main in reversed(back):
            path.append(label)
            label = int(from_main if label else from_other)
        return [label, *reversed(path)]


#: Features on fewer training pages than this are left out: names without meaning must not be learnt.
LEAST_PAGES = 4


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.3, l2: float = 1e-3) -> Crf:
    """Gradient ascent (Adam) on the conditional likelihood, all pages padded to one length."""
    made = [features(chain) for chain, _ in pages]
    on = Counter(f for page in made for f in {f for row in page for f in row})
    names = sorted(f for f, k in on.items() if k >= LEAST_PAGES)
    index = {f: i for i, f in enumerate(names)}
    n, longest = len(pages), max(len(c) for c, _ in pages)
    own = [(p * longest + t, index[f]) for p, page in enumerate(made) for t, row in enumerate(page) for f in row if f in index]
    who, what = np.array(own).T
    y, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for p, (_, labels) in enumerate(pages):
        y[p, : len(labels)], mask[p, : len(labels)] = labels, True
    gold = np.eye(2)[y] * mask[..., None]
    pairs = mask[:, 1:, None, None] * (np.eye(2)[y][:, :-1, :, None] * np.eye(2)[y][:, 1:, None, :])
    w = [np.zeros((len(names), 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    last = mask.sum(1) - 1
    for k in range(1, rounds + 1):
        s = np.stack([np.bincount(who, w[0][what, c], n * longest) for c in (0, 1)], 1).reshape(n, longest, 2)
        f, b = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        f[:, 0] = s[:, 0]
        for t in range(1, longest):
            f[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(f[:, t - 1, :, None] + w[1], 1) + s[:, t], f[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(w[1] + (s[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = np.logaddexp.reduce(f[np.arange(n), last], 1)[:, None, None]
        node = np.exp(f + b - z) * mask[..., None]
        edge = np.exp(f[:, :-1, :, None] + w[1] + (s + b)[:, 1:, None, :] - z[..., None]) * mask[:, 1:, None, None]
        away = (gold - node).reshape(n * longest, 2)
        g = [np.stack([np.bincount(what, away[who, c], len(names)) for c in (0, 1)], 1) / n - l2 * w[0], (pairs - edge).sum((0, 1)) / n - l2 * w[1]]
        for i in range(2):
            first[i] = 0.9 * first[i] + 0.1 * g[i]
            second[i] = 0.99 * second[i] + 0.01 * g[i] ** 2
            w[i] = w[i] + rate * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Crf(index, w[0], w[1])


@functools.cache
def default_model() -> Crf:
    return train(training_pages())


def main_text(page: str | None, model: Crf) -> str:
    chain = blocks(page or "")
    return "\n".join(b.text for b, label in zip(chain, model.decode(chain)) if label)


def extract(pages: DataFrame, model: Crf | None = None, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of keep, text and n_chars (code points). The model, some 40 KB, is sent to the executors."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    rows = pages.select(*keep, F.col(html_col).cast("string").alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        crf = sent.value
        texts = [main_text(x, crf) for x in as_text(batch.column("__html")).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return batched(rows, run, f"{kinds}, text string, n_chars bigint")
