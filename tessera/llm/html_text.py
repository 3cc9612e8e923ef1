"""Main text of web pages: blocks classified by stop words, length and links, then by their neighbours."""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no markup; all but a title's and a text area's is no text either, and those aren't article text.
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "math", "canvas", "object", "audio", "video", "select", "button", "head"}
#: Of these, an end tag that is missing swallows the rest of the page; the start tag of another is ignored then.
_SWALLOW = {"script", "style", "textarea", "title", "xmp"}
_OUT = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_BLOCKS = _OUT | _HEADINGS | set("html body header main article section div p ul ol li dl dt dd table thead tbody tfoot tr caption blockquote pre figure figcaption address details summary center hgroup".split())
#: What a start tag closes, if it is open above the nearest container.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, **dict.fromkeys(("thead", "tbody", "tfoot"), {"tr", "thead", "tbody", "tfoot"})}
_LISTS = {"ul", "ol", "dl", "table", "div", "section", "article", "main"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Words of a class or id that mark what never belongs to an article, and what doesn't unless the name also says content.
_NEVER = set("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promoted promotion comment comments disqus reply replies respond cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations breadcrumb breadcrumbs pager pagination copyright paywall".split())
_SELDOM = set("sidebar menu nav navbar navigation header masthead topbar footer notice notices banner widget widgets toolbar skip tags legal disclaimer alert".split())
_CONTENT = set("content article main post entry body story text page wrapper container layout".split())
#: Class names that begin or end like this say what an element has, lacks or is filed under, not what it is.
_ABOUT, _STATE = set("has no with without is js category cat tag type format status template single".split()), set("open closed enabled disabled on off free count".split())
#: Names of what stays out even where no other text is left, and the tags of which the same holds.
_ASIDE = set("comment comments disqus reply replies respond cookie cookies consent gdpr popup modal newsletter subscribe subscription".split())
_FIRM = {"nav", "footer", "aside", "menu", "dialog"}
_STOP = frozenset(
    # Frequent function words of English, German, French and Spanish.
    """the of and to in a is that it for was on are as with his they at be this have from or one had by not but what all were we when your can said there use an each which she do how their if will
    der die das und ist nicht von zu mit den auf für im ein eine einer dem des sich auch es an werden aus er hat dass sie nach wird bei noch wie über war
    le la les de des et est un une du en que qui dans pour pas sur au par plus ne se ce il sont avec ont mais nous vous
    el los las del y que en un una por con no para su al lo como más pero sus este ya o porque entre cuando muy sin sobre también ser""".split()
)
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Stop-word share, and characters, from which a block is surely text; share of linked characters from which it isn't.
DENSE, LONG, LINKED = 0.22, 60, 0.5
#: Share of known stop words in a page's long blocks under which its language is none of those listed.
KNOWN = 0.22
#: Characters of dense text that an element has to hold to be taken for the article in spite of its name, where no other is left.
ENOUGH = 400


def _named(value: str) -> set[str]:
    """Words of class names or an id, but for names that only say what the element has or is filed under."""
    found: set[str] = set()
    for name in value.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if words and not (len(words) > 1 and (words[0] in _ABOUT or words[-1] in _STATE)):
            found.update(words)
    return found


def _excluded(tag: str, attributes: str, inside: bool) -> str:
    """'' if the element may hold article text, 'firm' or 'never' if not, 'seldom' if not unless an article begins within.

    What is 'never' is taken back where it holds all of the page's dense text; what is 'firm' is not.
    """
    if tag in _FIRM:
        return "firm"
    if tag in _OUT or tag == "header" and not inside:
        return "seldom"
    if not attributes.strip() or tag in ("html", "body", "main"):
        return ""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in _ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return "firm"
    names = _named(found.get("class", "")) | _named(found.get("id", ""))
    if names & _ASIDE:
        return "firm"
    if names & _NEVER:
        return "never"
    if names & _SELDOM and not names & _CONTENT and tag != "article":
        return "seldom"
    return ""


def blocks(html: str) -> list[dict]:
    """The page's blocks in order: text, linked characters, whether in an article, and the elements that exclude it.

    `out` has a (number, kind) for each of these elements; without any, the block isn't excluded.
    """
    found: list[dict] = []
    stack: list[tuple[str, str, int, int]] = []  # tag, why excluded, articles open before it, number
    articles, linked, number = 0, False, 0
    parts: list[str] = []
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out = [(x[3], x[1]) for x in stack if x[1]]
                if not out and not any(x[0] in _HEADINGS for x in stack):
                    out = [(x[3], "seldom") for x in stack if x[0] == "header"]
                found.append({"text": text, "linked": link_chars, "article": articles > 0, "out": out})
            parts.clear()
        link_chars = 0

    def text(raw: str) -> None:
        nonlocal link_chars
        raw = unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if linked:
            link_chars += len("".join(raw.split()))

    at, size = 0, len(html)
    while at < size:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                if tag in ("button", "select", "textarea"):
                    parts.append(" ")
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(html, at)
                if end:
                    at = end.end()
                elif tag in _SWALLOW:
                    at = size
        elif tag == "a":
            linked = not closing
        elif tag in ("br", "td", "th", "wbr", "option", "label", "input"):
            parts.append("" if tag == "wbr" else " ")
        elif tag == "hr":
            flush()
        elif tag in _BLOCKS:
            flush()
            linked = False
            if closing:
                k = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if k is not None and not (tag == "p" and any(x[0] != "p" for x in stack[k:])):
                    articles = stack[k][2]
                    del stack[k:]
            else:
                if stack and stack[-1][0] == "p":
                    stack.pop()
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in _CLOSES.get(tag, ()):
                        articles = stack[i][2]
                        del stack[i:]
                        break
                    if stack[i][0] in _LISTS:
                        break
                if attributes.endswith("/") and tag not in ("p", "div"):
                    continue
                why = _excluded(tag, attributes, articles > 0)
                number += 1
                if tag in ("article", "main") and not why:
                    if all(x[1] in ("", "seldom") for x in stack):  # an article within what merely looked like a header, side or form
                        stack[:] = [(t, "", n, k) for t, _, n, k in stack]
                stack.append((tag, why, articles, number))
                articles += tag in ("article", "main") and not any(x[1] for x in stack)
    flush()
    return found


def _stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in _STOP for w in words) / max(1, len(words))


def _classify(page: list[dict]) -> list[bool | None]:
    """The first pass: True for what is text by length, stop words and links, False for what isn't, None where that is open.

    Where the page's long blocks hardly have a known stop word, their language is none of those listed, and length and
    links decide.
    """
    for b in page:
        b["chars"] = len(b["text"].replace(" ", ""))
        b["stop"] = _stop_share(b["text"])
    long = [b for b in page if len(b["text"]) >= LONG and b["linked"] <= LINKED * b["chars"]]
    weight = sum(b["chars"] for b in long)
    known = not long or sum(b["stop"] * b["chars"] for b in long) >= KNOWN * weight
    bounded = any(b["article"] and not b["out"] for b in page)
    labels: list[bool | None] = []
    for b in page:
        inside = b["article"]
        dense = len(b["text"]) >= LONG and (b["stop"] >= (DENSE / 2 if inside else DENSE) if known else b["linked"] <= LINKED / 2 * b["chars"])
        b["dense"] = dense and b["linked"] <= LINKED * b["chars"]
        if b["out"] or bounded and not inside or b["linked"] > LINKED * b["chars"]:
            labels.append(False)
        elif dense:
            labels.append(True)
        elif known and not inside and len(b["text"]) >= 4 * LONG and b["stop"] < DENSE / 4:
            labels.append(False)
        else:
            labels.append(None)
    return labels


def _take_back(page: list[dict]) -> bool:
    """Whether exclusions by name were lifted: those around most of the dense text, if none of it is left elsewhere."""
    held: dict[tuple, int] = {}
    for b in page:
        if b["dense"] and not any(kind == "firm" for _, kind in b["out"]):
            chain = tuple(n for n, _ in b["out"])
            held[chain] = held.get(chain, 0) + len(b["text"])
    if not held or () in held or max(held.values()) < ENOUGH:
        return False
    lifted = set(max(held, key=lambda chain: held[chain]))
    for b in page:
        b["out"] = [x for x in b["out"] if x[0] not in lifted]
    return True


def main_text(html: str | None) -> str:
    """The article's blocks, joined by two line feeds; empty for a null or empty page and for one without article."""
    if not html:
        return ""
    page = blocks(html)
    labels = _classify(page)
    if True not in labels and _take_back(page):
        labels = _classify(page)
    # The second pass: of the decided blocks in the same kind of place, the nearest gives its label.
    decided: dict[bool, list[int]] = {True: [], False: []}
    for i, (b, label) in enumerate(zip(page, labels, strict=True)):
        if label is not None and not (b["article"] and b["out"]):
            decided[b["article"]].append(i)
    kept = []
    for i, (b, label) in enumerate(zip(page, labels, strict=True)):
        if label is None:
            own = decided[b["article"]]
            k = bisect(own, i)
            near = own[max(0, k - 1) : k + 1]
            least = min((abs(x - i) for x in near), default=0)
            votes = [labels[x] for x in near if abs(x - i) == least]
            # Neighbours that are equally near and disagree: within an article it is text, elsewhere not.
            label = (any(votes) or not votes) if b["article"] else bool(votes) and all(votes)
        if label:
            kept.append(b["text"])
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            texts = [main_text(h.as_py()) for h in part["html"]]
            yield pa.RecordBatch.from_arrays([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page (page_id, url, html); other columns are ignored.

    Where a page has an article or main element, only what stands in one counts.  Navigation, headers, footers, asides,
    forms, notices, adverts and reader comments are left out by element, role, class and id; so are scripts and styles.
    A form, header or side around an article is none, and a name that would leave no dense text at all is not believed.
    Of a page in a language without listed stop words, length and links decide.  Whole pages are read, of any length.
    A null or empty page has an empty text; repeated rows give repeated results; no rows, no result rows.
    """
    given = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return given.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
