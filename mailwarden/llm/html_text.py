"""Main text of web pages by block rules in two passes.

A page is cut into blocks at block-level tags. The first pass decides blocks by the container they stand in, by length,
link density and the share of stop words; short blocks and unclear ones stay open. In the second pass each open block
takes the label of the nearest decided block of its region. Kept blocks are joined in page order, none is cut.

* A container is boilerplate by its tag (nav, aside, footer, form, ...), its role, or a word of its class or id (ad,
  cookie, sidebar, comments, ...), and so is all inside it.
* The outermost ``article`` or ``main`` is a region. Inside it a block is boilerplate only by its container or as an item
  of links; one that the rules cannot decide is open, so short, foreign or odd paragraphs of an article stay.
* If a page has such a region with text, what stands outside is boilerplate; else the densities decide over the page.
* Neighbours are blocks decided by their own text: a boilerplate container says nothing about the block next to it.

One projection, one linear pass over the page, no shuffle. Memory is one page.

Defined cases: a null or empty page, or one without main text, gives ``text`` "" and ``n_chars`` 0; a null page_id or url is
returned as it is; repeated rows each have their row; extra columns are ignored. White space is what Unicode calls so,
the no-break space included. An unfinished tag or comment at the end of a page is dropped, an unknown or unfinished
character reference stays as it is, tags that are never closed end with their container.
"""
from __future__ import annotations

import html
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from mailwarden.llm.common import map_texts

# Tags, roles and words of class names that mark boilerplate.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset(
    "article aside blockquote body button center datalist details dialog div dl fieldset figure footer form head header html li main menu nav object ol p"
    " search section select table ul".split())
BAD_TAGS = frozenset("aside button datalist dialog fieldset footer form head menu nav object search select".split())
#: Elements whose content is no markup, or not shown.
RAW_TAGS = frozenset("iframe math noembed noframes noscript script style svg template textarea title".split())
#: Of these, the ones that swallow the rest of a page when they are not closed.
RAW_TO_END = frozenset("script style textarea title".split())
BAD_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BAD_WORDS = frozenset(
    "ad ads adbox adslot advert affiliate alert archive author-bio banner bio breadcrumb callout consent copyright cta disclaimer discussion disqus donate feedback"
    " foot footnav gdpr header imprint legal login masthead menu modal nav navbar newsletter notice notification outbrain overlay pager pagination paywall"
    " popup privacy rail recommended recommendations register related replies reply respond search share sharing shoutbox sidebar signin signup skip social"
    " subnav subscribe subscription taboola teaser teasers toast toc toolbar topbar trending widget widgets".split())
BAD_STARTS = ("advert", "breadcrumb", "comment", "cookie", "footer", "navig", "promo", "sidebar", "sponsor")
#: A class word that begins so says what the container has around it, not what it is.
NOT_ITSELF = frozenset("has is no not with without".split())
TITLE_WORDS = frozenset("article content entry page post story".split())
STOP_WORDS = frozenset(
    # English
    "a about after all also an and any are as at be because been but by can could do even first for from get give go had has have he her him his how i if in into is"
    " it its just know like make many may me more most my new no not now of on one only or other our out over people say see she should so some such take than that"
    " the their them then there these they this those through time to two up us was way we well were what when where which who will with would you your"
    # French
    " au aux avec ce ces cette comme dans de des deux du elle elles en est et eux il ils je la le les leur leurs lui ma mais mes moi mon ne nos notre nous on ont ou"
    " par pas plus pour qu que qui sa sans ses si son sont sur ta te tes toi ton tous tout très tu un une vos votre vous à été être"
    # German
    " aber alle als am an auch auf aus bei bin bis da damit dann das dass dem den denn der des die dies diese dieser doch dort du durch ein eine einem einen einer eines"
    " er es für gegen hat haben hier ich ihr im ist ja kann kein keine man mehr mein mit nach nicht noch nun nur ob oder ohne sein seine sich sie sind so über um und uns"
    " unter vom von vor war was weil wenn werden wie wir wird zu zum zur zwischen"
    # Spanish
    " al algo ante antes aunque como con contra cual cuando de del desde donde el ella ellas ellos en entre era es esta este esto están fue ha hasta hay la las le les lo"
    " los más me mi muy nada ni no nos nosotros o otro para pero poco por porque que quien se ser si sin sobre son su sus también tan te tiene todo tu un una uno y ya yo".split())

SHORT, LONG = 70, 200                 # characters
LOW, HIGH = 0.20, 0.30                # share of stop words
LINKS = 0.5                           # share of characters inside links

TAG = re.compile(r"<(?:(!--)|([!?]|/(?![a-zA-Z]))|(/?)([a-zA-Z][^\s/>]*+))")
TAG_END = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+)>""")
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
COMMENT_END = re.compile("--!?>")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW_TAGS}
WORD = re.compile(r"[^\W\d_]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Block(NamedTuple):
    text: str
    linked: int          # characters inside links
    heading: bool
    item: bool           # stands in a list item
    bad: bool            # stands in a boilerplate container
    region: int          # outermost article or main, 0 outside


def _names(value: str) -> bool:
    """Whether a class or id names boilerplate."""
    for word in value.lower().replace("_", "-").split():
        parts = [p for p in word.split("-") if p]
        if not parts or parts[0] in NOT_ITSELF or ("header" in parts and TITLE_WORDS & set(parts)):
            continue
        if any(p in BAD_WORDS or p.startswith(BAD_STARTS) for p in parts):
            return True
    return False


def boilerplate(tag: str, attributes: str) -> bool:
    """Whether a container is boilerplate by its own tag and attributes."""
    if tag in BAD_TAGS:
        return True
    if tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and HIDDEN.search(value)):
            return True
        if name == "role" and value.lower() in BAD_ROLES:
            return True
        if name in ("class", "id") and tag != "main" and _names(html.unescape(value)):
            return True
    return False


class _Page:
    """The blocks of one page, collected while its tags are read."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, int]] = []        # open containers: tag, boilerplate, region
        self.counts: dict[str, int] = {}
        self.runs: list[str] = []
        self.linked, self.link, self.heading, self.regions = 0, False, False, 0
        self.bad, self.region = False, 0

    def text(self, run: str) -> None:
        run = html.unescape(run)
        self.runs.append(run)
        if self.link:
            self.linked += len("".join(run.split()))

    def cut(self) -> None:
        """End the block at a block-level tag."""
        text = " ".join("".join(self.runs).split())
        if text:
            self.blocks.append(Block(text, self.linked, self.heading, self.counts.get("li", 0) > 0, self.bad, self.region))
        self.runs, self.linked = [], 0

    def _state(self) -> None:
        _, self.bad, self.region = self.open[-1] if self.open else ("", False, 0)

    def start(self, tag: str, attributes: str) -> None:
        if tag == "a":
            self.link = True
        elif tag in BLOCK_TAGS or tag in CONTAINERS:
            self.cut()
            if self.open and (self.open[-1][0] == "p" or self.open[-1][0] == tag == "li"):
                self.end(self.open[-1][0])                  # a paragraph or list item ends where the next block starts
            self.heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
            if tag not in CONTAINERS:
                self.link = False
                return
            own = boilerplate(tag, attributes)
            region = self.region
            if tag == "header" and not region and not own:
                own = True                                  # of the page; one inside an article holds its title
            if tag in ("article", "main") and not own and (tag == "main" or not self.bad) and not region:
                self.regions += 1
                region = self.regions
            bad = own or (self.bad and tag != "main")
            self.open.append((tag, bad, region))
            self.counts[tag] = self.counts.get(tag, 0) + 1
            self._state()
        elif tag == "br":
            self.runs.append(" ")

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        elif tag in BLOCK_TAGS or tag in CONTAINERS:
            self.cut()
            self.heading = False
            if tag not in CONTAINERS:
                self.link = False
            elif self.counts.get(tag):
                while True:
                    name = self.open.pop()[0]
                    self.counts[name] -= 1
                    if name == tag:
                        break
                self._state()


def page_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; markup, scripts, styles and comments are gone."""
    out, at, unclosed = _Page(), 0, set()
    while m := TAG.search(page, at):
        out.text(page[at:m.start()])
        if m[1]:                                            # <!-- ... -->; <!--> and <!---> are whole
            short = re.compile("-?>").match(page, m.end())
            stop = short or COMMENT_END.search(page, m.end())
            at = stop.end() if stop else len(page)
            continue
        if m[2]:
            at = page.find(">", m.end()) + 1 or len(page)
            continue
        closed = TAG_END.match(page, m.end())
        if not closed:
            at = len(page)
            break
        at, tag = closed.end(), m[4].lower()
        if m[3]:
            out.end(tag)
            continue
        if tag in RAW_TAGS and tag not in unclosed:
            stop = RAW_END[tag].search(page, at)
            if stop:
                at = page.find(">", stop.end()) + 1 or len(page)
                continue
            if tag in RAW_TO_END:
                at = len(page)
                break
            unclosed.add(tag)
        out.start(tag, closed[1])
    out.text(page[at:])
    out.cut()
    return out.blocks


def first_pass(block: Block) -> bool | None:
    """True: main text; False: boilerplate; None: open."""
    if block.bad:
        return False
    size = len(block.text)
    linked = block.linked / size
    words = WORD.findall(block.text.lower())
    stops = sum(map(STOP_WORDS.__contains__, words)) / len(words) if words else 0.0
    if block.region:
        if linked > LINKS:
            return False if block.item else None
        return True if size >= SHORT and stops >= LOW else None
    if linked > LINKS:
        return False
    if size < SHORT:
        return None
    if stops < LOW:
        return False
    return True if size > LONG or stops >= HIGH else None


def second_pass(blocks: list[Block], labels: list[bool | None]) -> list[bool]:
    """Open blocks take the label of the nearest decided block of their region; a heading looks ahead first.

    At equal distance main text wins inside a region and boilerplate outside. Where nothing of the region is decided,
    the blocks of an article are main text, and so are those of a page without any region.
    """
    in_region = any(b.region and label is not False for b, label in zip(blocks, labels))
    labels = [False if in_region and not b.region else label for b, label in zip(blocks, labels)]
    near: dict[int, list[tuple[int, bool] | None]] = {}
    for order, side in ((range(len(blocks)), 0), (reversed(range(len(blocks))), 1)):
        last: dict[int, tuple[int, bool]] = {}
        for i in order:
            region = blocks[i].region
            if labels[i] is None:
                near.setdefault(i, [None, None])[side] = last.get(region)
            elif not blocks[i].bad and (labels[i] or not region):   # a container, or a menu in an article, says nothing about its neighbours
                last[region] = i, labels[i]
    out = []
    for i, (block, label) in enumerate(zip(blocks, labels)):
        if label is None:
            before, after = near[i]
            if block.heading and after:
                label = after[1]
            elif before and after and before[1] != after[1]:
                apart = (i - before[0]) - (after[0] - i)
                label = before[1] if apart < 0 else after[1] if apart > 0 else block.region > 0
            else:
                label = (before or after or (0, True))[1]
        out.append(label)
    return out


def main_text(page: str) -> str:
    """The main text of one page: kept blocks joined by an empty line."""
    blocks = page_blocks(page)
    kept = second_pass(blocks, [first_pass(b) for b in blocks])
    return "\n\n".join(b.text for b, keep in zip(blocks, kept) if keep)


def _rows(rows: list[tuple]) -> list[tuple]:
    out = []
    for page_id, page, url in rows:
        text = main_text(page.decode("utf-8", "replace")) if page else ""
        out.append((page_id, url, text, len(text)))
    return out


def html_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    return map_texts(pages, ["page_id", "html", "url"], "page_id long, url string, text string, n_chars long", _rows)
