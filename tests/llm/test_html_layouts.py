"""Pages in layouts that no training page has, against an extraction with the standard library's parser."""

import time
from html.parser import HTMLParser

import pytest

html_crf = pytest.importorskip("rankloom.llm.html_crf")

TEXT = [
    "The river rises in the hills above the town, and for most of the year it is no wider than a street. Every spring it floods the lower meadows.",
    "People who live there have learnt to move their sheep in time; the old mill, built in 1743, stands on the only dry ground for miles.",
    "\u201cWe never had a bridge\u201d, says the miller. \u201cWe had a boat &amp; a rope, and that was enough for my father.\u201d",
    "In den Jahren danach wurde der Fluss begradigt, und die Wiesen fielen trocken. Heute wird er wieder in sein altes Bett gelegt.",
    "Les pêcheurs, eux, n'ont jamais quitté la rive gauche : le poisson y revient chaque automne, en petit nombre.",
    "What the work will cost is not known. A first estimate names four million, a second one nearly twice as much.",
]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
RICH = f"<h1>The river comes back</h1><p>{TEXT[0]}</p><h2>The mill</h2><p>{TEXT[1]}<p>{TEXT[2]}<ul><li>the upper lock, which is closed;<li>the lower lock, which is not.</ul><blockquote><p>{TEXT[3]}</p></blockquote><p>{TEXT[4]}<br>{TEXT[5]}</p>"
PLAIN = "<h1>The river comes back</h1>" + BODY
LINKS = "".join(f'<a href="/{x}">{x.title()}</a> ' for x in ("home", "world", "sport", "weather"))
ITEMS = "".join(f'<li><a href="/{x}">{x.title()} in the valley</a></li>' for x in ("news", "farms", "boats", "walks", "birds"))

#: Family -> (page with one place for the article, the article).
FAMILIES = {
    "hashed names": ('<html><head><title>t</title></head><body><div class="css-9zk"><div class="css-1ab"><div class="css-0">{links}</div></div><div class="css-77"><div class="css-q">{article}</div></div><div class="css-f">© 2024 Valley Times. All rights reserved.</div></div></body></html>', PLAIN),
    "no names": "<html><body><div><div>{links}</div><div>{article}</div><div>© 2024 Valley Times</div></div></body></html>",
    "old table page": '<html><body bgcolor=white><table width=100%><tr><td colspan=2><font size=1>{links}</font></td></tr><tr><td width=150><ul>{items}</ul></td><td valign=top>{article}</td></tr><tr><td colspan=2><center>© 1998 Valley Times | <a href=/m>Mail us</a></center></td></tr></table></body></html>',
    "documentation": '<body><header><a href="/">Valley docs</a></header><div class="layout"><nav aria-label="Pages"><ul>{items}</ul></nav><main>{article}</main></div><footer><p>© Valley docs</p></footer></body>',
    "one page app": '<!doctype html><html><body><div id="root"><div class="x1a x2b"><div class="x9"><a href=/>Valley</a></div><div class="x3c"><div class="x4d">{article}</div><div class="x7"><div class="x8">Advertisement</div></div></div><div class="x5e"><div>Related articles</div><ul>{items}</ul></div></div></div></body></html>',
    "weblog with comments": '<body><div id="masthead"><p>My valley weblog</p></div><div class="hentry">{article}</div><div id="respond-list"><h3>2 comments</h3><div><b>Ann</b><p>Thank you for this, I was there last year.</p><a href=#>Reply</a></div><div><b>Bob</b><p>The bridge was built in 1950, I think.</p><a href=#>Reply</a></div></div><div id="colophon">© Ann Author</div></body>',
    "head left open": '<head><title>x</title><nav>{links}</nav><article>{article}</article><footer>© Valley</footer>',
    "self-closed drawings": '<body><div><svg width=1 /></div><nav>{links}</nav><article>{article}</article><svg><text>drawn</text></svg><footer>© Valley</footer></body>',
    "flat": "<body><p>{links}</p>{article}<hr><p>© 2001 Valley Times. All rights reserved.</p></body>",
}
FAMILIES = {k: v if isinstance(v, tuple) else (v, RICH) for k, v in FAMILIES.items()}


class Reader(HTMLParser):
    """Text of a fragment, a line for each stretch that no block-level tag divides."""

    CUTS = set("p h1 h2 h3 ul ol li blockquote div".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts = [""]

    def handle_starttag(self, tag, attrs):
        self.parts += [""] if tag in self.CUTS else []
        self.parts[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.parts += [""] if tag in self.CUTS else []

    def handle_data(self, data):
        self.parts[-1] += data


def read(fragment):
    r = Reader()
    r.feed(fragment)
    r.close()
    return "\n".join(" ".join(x.split()) for x in r.parts if x.strip())


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_family(family):
    page, article = FAMILIES[family]
    got = html_crf.main_text(page.format(links=LINKS, items=ITEMS, article=article), html_crf.default_model())
    assert got == read(article)


def test_blocks_are_what_the_parser_sees():
    assert [b.text for b in html_crf.blocks("<body>" + RICH)] == read(RICH).split("\n")


@pytest.mark.parametrize("page, text", [
    ("<p>a<svg/>b<p>c", "ab c"), ("<svg>x</svg>a", "a"), ("<svg>a", "a"), ("<head><title>t</title>a", "a"), ("<math><mi>x</mi></math> = 2", "x = 2"),
    ("<object><p>instead</p></object>", "instead"), ("<script>a</script >b<script>c", "b"), ("a<!-- b --> c<!-- d", "a c"), ('<p title="a>b">c', "c"), ("<p don't>c</p> d", "c d"), ('<p a="x>c', "c"), ("a < b &lt; c", "a < b < c"), ("x<p", "x"),
])
def test_markup(page, text):
    assert " ".join(" ".join(b.text for b in html_crf.blocks(page)).split()) == text


@pytest.mark.parametrize("piece", ["<div>x", '<a b="', "<svg>", "<p>a<blockquote>", "</div>", "<li>x", "<table><tr><td>", "<!--", "<a b='\"'", "<script>"])
def test_time_is_linear(piece):
    model = html_crf.default_model()

    def seconds(n):
        at = time.process_time()
        html_crf.main_text(piece * n, model)
        return time.process_time() - at

    seconds(1000)
    assert seconds(16_000) < 12 * seconds(4_000) + 0.3
