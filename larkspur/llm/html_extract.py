"""Main text of web pages by tree scoring.

The page becomes a tree (implied ends of p, li, td and the like included). What can't be article
text is cut: scripts, styles, forms, menus, headers and footers of the page, sidebars, notices,
adverts and reader comments, by element, role or whole names of class and id (article elements never by
name). A form, or an element cut by its name, that holds more than half of the page's text out of links stays, unless an
article or main element stands outside it or it is named for comments, consent or adverts. Every paragraph then
passes points for its length and commas to its parent, half of them to the parent above and fewer
further up; article and main elements get the points of all paragraphs below in full and more for their name, other containers more or less for what class and id say.
All is discounted by the share of the container's text that is in links, and the container with the most points is
the article; no element is taken without being scored. Beside an article or main element siblings are kept too if they score a
fifth of that or are paragraphs of prose; beside others all siblings are, of whatever kind and length, and the loose text between them, if
less than half of their own text is in links.

Inside what is kept nothing is dropped: blocks in page order, character references decoded, white
space (br too) as one space, trimmed, joined by one newline. The time for a page is in proportion to its length, however deep it is.

Defined results: null or empty html, or a page without article text: the empty string with 0 code
points. Broken or cut-off markup is closed at the end of the page. A page without any markup is its
own text. Equal pages give equal texts; ties between containers go to the first. Null url and
repeated rows are kept as they are. Extra columns are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from larkspur.llm.common import table

# Element names of the HTML standard, and words that name what isn't article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend summary tbody td tfoot th thead tr li dd dt".split())
CUT = frozenset("head title script style noscript template iframe object embed svg canvas audio video map form button select option textarea input label fieldset nav footer aside menu dialog search".split())
CUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tr": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
UNLIKELY = re.compile(r"^(ads?|adv|advert.*|adbox|adslot|adsense|sponsor.*|promot?e?d?|promos?|banners?|cookies?.*|consent.*|gdpr|notices?|notification.*|alerts?|popups?|popover|modal.*|overlay.*|paywall|sidebar.*|sidenav|menu.*|nav|nav(bar|igation|menu|list)|topnav|breadcrumbs?|comments?|comment(list|s?area|s?section|form|box).*|disqus.*|repl(y|ies)|respond|share.*|sharing|social.*|related.*|footer.*|masthead|topbar|newsletter.*|subscri.*|signup|login.*|toolbar|pagination|pager|skip|skiplink|skipnav|searchbox|searchform|outbrain|taboola)$")
#: Names that cut whatever the element holds, words that may stand beside a listed one in a name, and words before one that say something else.
SURE = re.compile(r"^(ads?|adv|advert.*|adbox|adslot|adsense|sponsor.*|cookies?.*|consent.*|gdpr|comments?|comment(list|s?area|s?section|form|box).*|disqus.*|repl(y|ies)|respond)$")
BESIDE = frozenset("area bar block blog body bottom box button buttons center column container entry feed fixed float floating form global group header icons inline inner item items left links list main mobile module outer page panel placeholder post posts primary right row secondary section site slot sticky tertiary title top unit widget widgets wrap wrapper zone".split())
QUALIFIES = frozenset("about cat category col columns disable disabled enabled for format full has have hide in is layout no non not off on show single tag term topic type with without".split())
PAGE_HEADER = re.compile(r"^(header|siteheader|pageheader|topheader)$")
#: Names that speak for a container of article text.
LIKELY = re.compile(r"^(articles?|blog|body|content|entry|main|page|posts?|prose|story|text)$")
#: How names weigh in a container's points: article elements and main elements, and class or id for and against.
WEIGHT = {"article": 1.8, "main": 1.3}
FOR, AGAINST = 1.2, 0.8
#: Tables' and lists' cells and the like, which pass their points on at once.
HELD = frozenset("p pre li td th blockquote h1 h2 h3 h4 h5 h6 dd dt".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Node:
    __slots__ = ("name", "up", "kids", "cut", "said", "points", "rising", "total", "at", "chars", "linked")

    def __init__(self, name, up, cut=0, at=0, said=1.0):
        self.name, self.up, self.kids, self.cut, self.at, self.said = name, up, [], cut, at, said
        # of the paragraphs held here, of those further down as they arrive, and of all of them in full
        self.points = self.rising = self.total = 0.0
        self.chars = self.linked = 0


#: Ways to be cut: for certain, or unless most of the page's text is inside.
SURELY, MAYBE = 2, 1


def _named(name: str, inside: bool) -> int:
    """What one name of a class or id says: it cuts if it is a listed word, beside others that don't change its sense."""
    parts = [p for p in (p.lower() for p in _PART.findall(name)) if not p.isdigit()]
    # in an article an alert is a box of its text
    listed = [bool(UNLIKELY.match(p) and not (inside and p in ("alert", "alerts")) or not inside and PAGE_HEADER.match(p)) for p in parts]
    if not any(listed):
        return 0
    known = all(x or p in BESIDE for x, p in zip(listed, parts, strict=True))
    if not known and not (listed[-1] and QUALIFIES.isdisjoint(parts)):
        return 0
    return SURELY if any(SURE.match(p) for p in parts) else MAYBE


def _unwanted(name: str, attrs: str, inside: bool) -> tuple[int, float]:
    """Whether an element can't be article text, and how its names weigh; `inside`: it is in an article element, where headers belong to the text."""
    if name in CUT and name != "form" or name == "header" and not inside:
        return SURELY, 1.0
    least = MAYBE if name == "form" else 0
    if not attrs or name in ("html", "body", "main"):
        return least, 1.0
    got = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)}
    if "hidden" in got or got.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", got.get("style", ""), re.I):
        return SURELY, 1.0
    if got.get("role", "").lower() in CUT_ROLE:
        return SURELY, 1.0
    names = f"{got.get('class', '')} {got.get('id', '')}".split()
    if name == "article" or not names:
        return least, 1.0
    cut = max([least, *(_named(x, inside) for x in names)])
    parts = [p.lower() for x in names for p in _PART.findall(x)]
    return cut, AGAINST if cut else FOR if any(LIKELY.match(p) for p in parts) else 1.0


def spare(root: Node) -> None:
    """Takes back a cut for want of certainty where the element holds more than half of the page's text out of links and all its article and main elements."""
    order, stack, own, marks = [], [(root, False)], {}, {}
    while stack:
        node, in_link = stack.pop()
        order.append(node)
        own[id(node)] = 0 if in_link else sum(len(" ".join(entities.unescape(k).split())) for k in node.kids if isinstance(k, str))
        marks[id(node)] = 0
        stack += [(k, in_link or k.name == "a") for k in reversed(node.kids) if not isinstance(k, str) and k.cut != SURELY]
    for node in reversed(order):
        if own[id(node)] and node.name in ("article", "main"):
            marks[id(node)] += 1
        if node.up is not None:
            own[id(node.up)] += own[id(node)]
            marks[id(node.up)] += marks[id(node)]
    for node in order:
        if node.cut and 2 * own[id(node)] > own[id(root)] and marks[id(node)] == marks[id(root)]:
            node.cut = 0


class Path:
    """The open elements from the root down, and where those of each name stand among them."""

    def __init__(self, root: Node):
        self.nodes, self.of, self.blocks = [root], {}, []

    def open(self, node: Node) -> None:
        self.of.setdefault(node.name, []).append(len(self.nodes))
        if node.name in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)

    def close(self, depth: int) -> None:
        """Ends the element at this depth and all in it."""
        while len(self.nodes) > depth:
            node = self.nodes.pop()
            self.of[node.name].pop()
            if node.name in BLOCK:
                self.blocks.pop()

    def last(self, name: str) -> int:
        return self.of[name][-1] if self.of.get(name) else -1

    def ended_by(self, name: str) -> int | None:
        """The depth of the outermost element that a new `name` ends, not beyond a fence."""
        fence = max(map(self.last, FENCE[name]))
        found = [at[k] for x in ENDS[name] if (at := self.of.get(x)) and (k := bisect_right(at, fence)) < len(at)]
        return min(found, default=None)


def parse(page: str) -> Node:
    root = Node("#root", None)
    path = Path(root)
    at, count, unsure = 0, 0, False
    while at < len(page):
        here = path.nodes[-1]
        m = _TAG.search(page, at)
        if m is None:
            here.kids.append(page[at:])
            break
        if m.start() > at:
            here.kids.append(page[at : m.start()])
        at = m.end()
        if (name := m["name"]) is None:
            if m["cdata"]:
                here.kids.append(entities.escape(m["cdata"]))
            continue
        name, count = name.lower(), count + 1
        if m["end"]:
            depth = path.last(name)
            # the end of an inline element doesn't reach out of its block
            if depth > 0 and (name in BLOCK or not path.blocks or path.blocks[-1] < depth):
                path.close(depth)
            elif name == "p":
                here.kids.append(Node("p", here, at=count))
            elif name == "br":
                here.kids.append(" ")
            continue
        if name in CLOSES_P and path.blocks and path.nodes[path.blocks[-1]].name == "p":
            path.close(path.blocks[-1])
        if name in ENDS and (depth := path.ended_by(name)) is not None:
            path.close(depth)
        here = path.nodes[-1]
        if name == "br" or name == "wbr":
            here.kids.append(" " if name == "br" else "")
            continue
        cut, said = _unwanted(name, m["attrs"], path.last("article") > 0)
        made = Node(name, here, cut, count, said)
        unsure = unsure or made.cut == MAYBE
        here.kids.append(made)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            if end is None and name in ("title", "textarea", "noscript"):
                continue
            stop = len(page) if end is None else end.start()
            if name == "noscript":
                made.cut = SURELY
            made.kids.append(page[at:stop])
            at = len(page) if end is None else (page.find(">", stop) + 1 or len(page))
        elif name not in VOID and not m["attrs"].endswith("/") or name in BLOCK:
            path.open(made)
    if unsure:
        spare(root)
    return root


def score(root: Node) -> list[Node]:
    """Points for every container of a paragraph, a paragraph being a run of inline text in a block. Returns the containers in page order."""
    order: list[Node] = []

    def run(block: Node, texts: list[str], linked: int) -> None:
        text = " ".join("".join(texts).split())
        if not text:
            return
        size = len(text)
        holder = (block.up or block) if block.name in HELD else block
        holder.points += (1 + text.count(",") + text.count("，") + text.count("、") + min(size / 100, 3.0)) * (1 - min(1.0, linked / size))
        holder.chars += size
        holder.linked += min(size, linked)

    texts: list[str] = []
    linked = 0
    # an explicit stack, since pages may nest deeper than Python's calls: what is left of an element, the element, whether in a link, its block
    stack = [(iter(root.kids), root, False, root)]
    order.append(root)
    while stack:
        kids, node, in_link, block = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if node is block:
                run(block, texts, linked)
                texts, linked = [], 0
        elif isinstance(kid, str):
            text = entities.unescape(kid)
            texts.append(text)
            linked += len(" ".join(text.split())) if in_link else 0
        elif not kid.cut:
            if kid.name in BLOCK:
                run(block, texts, linked)
                texts, linked = [], 0
            order.append(kid)
            stack.append((iter(kid.kids), kid, in_link or kid.name == "a", kid if kid.name in BLOCK else block))
    # from the leaves up: what is held here counts half for the parent, what came from below two thirds of what it counts here
    for node in reversed(order):
        node.total += node.points
        if (up := node.up) is not None:
            up.rising += node.points / 2 + node.rising / 1.5
            up.total += node.total
            up.chars += node.chars
            up.linked += node.linked
    for node in order:
        node.points += node.rising
    return [n for n in order if n.chars]


def worth(node: Node) -> float:
    points = node.total * WEIGHT[node.name] if node.name in WEIGHT else node.points * node.said
    return points * (1 - node.linked / max(1, node.chars))


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node, without what is cut."""
    out, texts = [], []

    def flush():
        if text := " ".join("".join(texts).split()):
            out.append(text)
        texts.clear()

    stack = [(iter(node.kids), node)]
    while stack:
        kids, here = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if here.name in BLOCK:
                flush()
        elif isinstance(kid, str):
            texts.append(entities.unescape(kid))
        elif not kid.cut:
            if kid.name in BLOCK:
                flush()
            stack.append((iter(kid.kids), kid))
    flush()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    scored = score(root)
    if not scored:
        return ""
    best = max(scored, key=worth)
    if best.up is None:
        return "\n".join(blocks(best))
    if best.name not in ("article", "main"):
        return "\n".join(_with_siblings(best))
    least, out = 0.2 * best.total, []
    for kid in best.up.kids:
        if kid is best:
            out += blocks(kid)
        elif isinstance(kid, Node) and not kid.cut:
            density = kid.linked / kid.chars if kid.chars else 0.0
            text = blocks(kid)
            prose = kid.name == "p" and density < 0.25 and sum(map(len, text)) > 80
            heading = best.name == "main" and kid.name in ("h1", "h2", "h3", "h4", "h5", "h6") and best.up.name not in ("body", "html", "#root")
            if kid.total >= least and density < 0.5 and best.name != "article" or kid.total >= least and kid.name == best.name == "article" or prose or heading:
                out += text
    return "\n".join(out)


def _with_siblings(best: Node) -> list[str]:
    """Texts of a container and of what stands beside it, loose text too, where less than half is in links."""
    out: list[str] = []
    loose = Node("#loose", None)

    def keep(node: Node) -> None:
        chars, linked = _held(node)
        if 2 * linked < chars:
            out.extend(blocks(node))

    for kid in best.up.kids:
        if not isinstance(kid, Node) or kid.name not in BLOCK and kid is not best:
            loose.kids.append(kid)
            continue
        keep(loose)
        loose.kids = []
        if kid is best:
            out += blocks(kid)
        elif not kid.cut:
            keep(kid)
    keep(loose)
    return out


def _held(node: Node) -> tuple[int, int]:
    """Code points of the text below a node, without what is cut, and those of them in links."""
    chars = linked = 0
    stack = [(node, node.name == "a")]
    while stack:
        here, in_link = stack.pop()
        for kid in here.kids:
            if isinstance(kid, str):
                size = len(" ".join(entities.unescape(kid).split()))
                chars += size
                linked += size if in_link else 0
            elif not kid.cut:
                stack.append((kid, in_link or kid.name == "a"))
    return chars, linked


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of `pages` (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
