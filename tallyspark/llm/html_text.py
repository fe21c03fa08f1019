"""Main text of web pages by two passes of block rules.

The markup is cut into blocks at block-level tags. Blocks in elements that are never text (scripts, styles, forms, menus,
headers, footers, sidebars) or whose class or id is a name of an advert, a notice or reader comments are dropped at once. Names count as wholes: a
name of a part, with words before and after it that only say where it is or that it is a box (site-header, comment-list), so that
share-price, related-work, article-header and with-sidebar are none; an element that is also named for content (content share) stays. Where an element so named would go with main in it, or one
named for a part of the layout with all of the page's articles, or a form with these, the page is read without and with it, and the longer text taken. Where nothing is left
of a page, it is read with its forms, and with the elements of which only some names are such. Pass one
classifies the others by length, stop-word density and link density: bad (mostly links), good (long, with stop words), near good, short.
Pass two gives the undecided ones the label of the nearest decided neighbours in the same region: good if one of the nearest on
either side is, bad if both are. Where a page marks its article (article, main), that is the region to read, unless the marked parts are teasers: one without a
good block beside a text that has them, or several without a second good block each beside one that has two or more. Only a region's blocks count as neighbours. In
an article, blocks that are mostly links (references) are undecided, not bad, and blocks without decided neighbours are good; elsewhere they are bad.
Where no block has stop words of a known language, as far as they are known, and in blocks of Chinese, Japanese or Korean, length
and link density alone decide; a character of these counts as three.

Time is linear in the page's length, whatever its markup. Nulls: a null html is an empty page, with an empty text; null page_id and url are carried. Repeated rows give a row each.
Empty tables give empty results. Broken markup (tags left open, pages cut off) never raises. Other columns are ignored.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame

from .common import small_batches, spelled, tidied

# Names of HTML, and the commonest function words of four languages.
BLOCK_TAGS = set(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li link main menu meta nav ol option p pre section summary table tbody td tfoot th thead"
    " title tr ul br".split()
)
SKIPPED_TAGS = set("script style noscript template head title nav footer aside form menu iframe object svg math canvas select button textarea dialog audio video".split())
RAW_TAGS = "script style noscript template textarea title iframe xmp".split()
VOID_TAGS = set("area base br col embed hr img input link meta param source track wbr".split())
_PLACE = r"(?:site|page|top|bottom|left|right|main|global|primary|secondary|mobile|desktop|sticky|fixed|floating|layout|blog|sub|wp|the|g|l|m|u|c)[_-]"
_BOX = (
    r"(?:[_-](?:box|wrap|wrapper|container|block|area|section|list|bar|slot|unit|links?|items?|posts|articles|stories|content|inner|outer|body|form|group|panel|top|bottom|left|right|main|"
    r"primary|secondary|title|heading|toggle|button|buttons|icons?|text|message|menu|nav|banner|notice|sidebar|widget|popup|overlay|placeholder|[0-9]+))*"
)
_LAYOUT = r"(?:banner|sidebar|side-bar|menu|nav|navbar|navigation|footer|header|masthead|widgets?|toolbar)"
_OTHER = (
    r"(?:ads?|advert\w*|sponsor(?:ed|s|ship)?|promo(?:tion|tions)?|(?:(?:user|reader|readers|visitor|guest|public|customer|facebook|fb|view|all|latest|recent)[_-])?comments?|discussion|disqus|replies|respond|breadcrumbs?|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|subscription|"
    r"signup|login|social|share|sharing|related|recommended|pagination|pager)"
)
_OF_ARTICLE = r"(?:article|post|entry|story)[_-](?=comments?|share|sharing|social|related|recommended|nav|navigation|pagination|footer|sidebar|ads?(?:$|[_-]))"
SKIPPED_NAMES = re.compile(rf"(?:{_PLACE})*(?:{_OF_ARTICLE})?(?:{_LAYOUT}|{_OTHER}){_BOX}", re.I)
LAYOUT_NAMES = re.compile(rf"(?:{_PLACE})*(?:{_OF_ARTICLE})?{_LAYOUT}{_BOX}", re.I)
CONTENT_NAMES = re.compile(rf"(?:{_PLACE})*(?:article|post|entry|story|page|body|main|content|text)(?:[_-](?:article|post|entry|story|body|main|content|text))*", re.I)
HAVING = re.compile(r"(?:^|[_-])(?:with|without|no|has|have)[_-]", re.I)
BUILDER = re.compile(r"^elementor-widget(?:$|[_-])", re.I)  # a page builder's name of any block, text or not
STOP_WORDS_OF = [
    set("the of and to in a is that for it was on with as be by this are from at or an have not but his they which you we".split()),
    set("der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei".split()),
    set("de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec son ou".split()),
    set("el los y del se las por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre".split()),
]
STOP_WORDS = set().union(*STOP_WORDS_OF)
LONG, SHORT, DENSE, SPARSE, LINKED, KNOWN = 200, 70, 0.3, 0.12, 0.35, 4

# a quote opens a value only behind =
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|$))|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<close>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>=]++|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*+)(?:>|$)",
    re.S,
)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WHITE = re.compile(r"\s+")
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af]")


def _names(attrs: str) -> tuple[list[str], list[str]]:
    """Names in class, id and role that stand for what isn't text, and all others."""
    found = [x for m in _NAMED.finditer(attrs) for x in (m[1] or m[2] or m[3] or "").split()]
    bad = [x for x in found if not HAVING.search(x) and SKIPPED_NAMES.fullmatch(BUILDER.sub("", x))]
    return bad, [x for x in found if x not in bad]


def _refused(name: str, attrs: str, in_article: bool) -> str:
    """Why an element is refused: tag, form, name, mixed (some of its names are of other things), layout (its names are only of layout parts); empty if
    it isn't."""
    if name in SKIPPED_TAGS or (name == "header" and not in_article):
        return "form" if name == "form" else "tag"
    if attrs and name not in ("html", "body", "main", "article"):
        if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attrs, re.I):
            return "tag"
        names, others = _names(attrs)
        if names and not any(CONTENT_NAMES.fullmatch(x) for x in others):
            layout = all(LAYOUT_NAMES.fullmatch(BUILDER.sub("", x)) for x in names)
            return "layout" if layout else "mixed" if others else "name"
    return ""


def blocks(page: str, exempt: set[int], wrappers: set[int], doubtful: set[int]) -> list[tuple[str, int, int]]:
    """(text, characters of it in links, the number of the article it is in, from 1, or 0) of each block that isn't in a refused element; elements
    that begin at ``exempt`` places aren't refused. The places of refused ones that seem to hold the article go to ``wrappers``, those of forms and of
    elements of which only some names are refused to ``doubtful``."""
    out, stack, text = [], [], []
    open_named, mains, holding, articles, depth = [], set(), {}, 0, {}
    refused = links = article = ordinal = at = 0
    linked = 0

    def close_block():
        nonlocal linked
        if text:
            joined = _WHITE.sub(" ", "".join(text)).strip()
            if joined:
                out.append((joined, linked, ordinal if article else 0))
            text.clear()
        linked = 0

    def leave():
        nonlocal refused, links, article
        tag, no = stack.pop()
        depth[tag] -= 1
        refused -= no
        if open_named and open_named[-1][0] == len(stack):
            open_named.pop()
        links -= tag == "a"
        article -= tag in ("article", "main")

    def put(raw):
        nonlocal linked
        if raw and not refused:
            chars = html.unescape(raw)
            text.append(chars)
            if links:
                linked += len(_WHITE.sub(" ", chars).strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in BLOCK_TAGS:
            close_block()
        if m["close"]:
            if depth.get(name):
                while stack[-1][0] != name:
                    leave()
                leave()
            continue
        if name in RAW_TAGS:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID_TAGS or _CLOSED.search(m["attrs"] or ""):
            continue
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and depth.get(name):  # these end an open one of their kind
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    while len(stack) > i:
                        leave()
                    break
                if stack[i][0] in ("ul", "ol", "table", "div", "article", "main", "section", "body", "dl", "blockquote"):
                    break
        why = _refused(name, m["attrs"] or "", article > 0) if m.start() not in exempt else ""
        no = why != ""
        if name == "main" or (name == "article" and not _names(m["attrs"] or "")[0]):
            inside = [(place, kind) for _, place, kind in open_named]
            if not any(kind == "tag" for _, kind in inside):
                if name == "main":
                    mains.update(place for place, _ in inside)
                else:
                    articles += 1
                    if all(kind in ("layout", "form", "mixed") for _, kind in inside):
                        for place, _ in inside:
                            holding[place] = holding.get(place, 0) + 1
        if no:
            open_named.append((len(stack), m.start(), why))
            if why in ("form", "mixed"):
                doubtful.add(m.start())
        stack.append((name, no))
        depth[name] = depth.get(name, 0) + 1
        refused += no
        links += name == "a"
        if name in ("article", "main"):
            ordinal += not article
            article += 1
    close_block()
    wrappers.update(mains, (place for place, n in holding.items() if n == articles))
    return out


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?\"'()[]#*$%&|").lower() for w in text.split()]


def in_known_language(found: list[tuple[str, int, int]]) -> bool:
    """Whether a block of some length has KNOWN stop words or more of one language, and is dense with them."""
    for text, linked, _ in found:
        if linked <= LINKED * len(text) and len(text) >= SHORT:
            words = _words(text)
            for stop in STOP_WORDS_OF:
                hits = [w for w in words if w in stop]
                if len(hits) >= SPARSE * len(words) and len(set(hits)) >= KNOWN:
                    return True
    return False


def first_pass(text: str, linked: int, in_article: int, known: bool = True) -> str:
    """bad, good, near or short; by length and links alone if the language isn't ``known``."""
    if linked > LINKED * len(text):
        return "short" if in_article else "bad"
    wide = len(_WIDE.findall(text))
    if not known or 3 * wide > len(text):
        size = len(text) + 2 * wide
        return "short" if size < SHORT else "good" if size > LONG else "near"
    if len(text) < SHORT:
        return "short"
    words = _words(text)
    density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    if density >= DENSE or (len(text) > LONG and density >= SPARSE):
        return "good" if len(text) > LONG or density >= DENSE else "near"
    return "near" if density >= SPARSE or in_article else "bad"


def main_text(page: str) -> str:
    wrappers, doubtful = set(), set()
    text = _chosen(blocks(page, set(), wrappers, doubtful))
    if wrappers:
        text = max(text, _chosen(blocks(page, wrappers, set(), set())), key=len)
    return text or (_chosen(blocks(page, wrappers | doubtful, set(), set())) if doubtful else text)


def _teasers(inside: list[tuple[str, int, int]], outside: list[tuple[str, int, int]], known: bool) -> bool:
    """Whether the marked articles only point to a text beside them: as the number of good blocks says, in each and outside."""
    good = {n: 0 for _, _, n in inside}
    near = False
    for block in inside:
        label = first_pass(*block, known)
        good[block[2]] += label == "good"
        near |= label == "near"
    beside = sum(first_pass(*b, known) == "good" for b in outside)
    if not any(good.values()):
        return beside > near
    return len(good) > 1 and max(good.values()) < 2 <= beside


def _chosen(found: list[tuple[str, int, int]]) -> str:
    """The text of the region to read: what is in articles or, if they are teasers, the rest."""
    known = in_known_language(found)
    inside, outside = ([b for b in found if (b[2] > 0) is side] for side in (True, False))
    return " ".join(_kept(inside if inside and not _teasers(inside, outside, known) else outside, known))


def _kept(region: list[tuple[str, int, int]], known: bool) -> list[str]:
    """The second pass: the good blocks of a region."""
    labels = [first_pass(*b, known) for b in region]
    decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
    keep, at = [], 0
    for i, (text, _, in_article) in enumerate(region):
        while at < len(decided) and decided[at] < i:
            at += 1
        label = labels[i]
        if label in ("short", "near"):
            before = labels[decided[at - 1]] if at else None
            after = labels[decided[at]] if at < len(decided) else None
            sides = {before, after} - {None}
            alone = not sides and (in_article or label == "near")
            label = "good" if "good" in sides or alone else "bad"
        if label == "good":
            keep.append(text)
    return keep


def _extracted(batches):
    import pandas as pd

    from .common import numbers

    for frame in batches:
        texts = [main_text(h or "") for h in frame["html"].tolist()]
        yield pd.DataFrame({"page_id": pd.array(numbers(frame["page_id"]), "Int64"), "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none), n_chars of every page."""
    small_batches(pages.sparkSession)
    given = pages.select(spelled("page_id"), "url", "html")
    return given.mapInPandas(tidied(_extracted), "page_id long, url string, text string, n_chars long")
