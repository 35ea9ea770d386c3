"""Text lines of web pages, each with what the page's own markup says of it.

A line is the text of one block, its character references decoded and its white space single. Reading is linear in the
page's length, whatever is left open or misplaced in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

#: What markup says of a line: page furniture, part of an article, part of the main region, or nothing.
DROP, ARTICLE, MAIN, OPEN = "drop", "article", "main", "open"

# Element names of the HTML standard, in its groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav footer aside head title noscript template iframe object svg math select button textarea dialog menu audio video canvas search datalist".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tablist status".split())
#: Words in a class or an id that name furniture; the first kind also where an article lies inside.
ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion comment comments disqus reply replies respond teaser".split())
USUALLY = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead topbar banner cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "pagination pager toolbar copyright disclaimer paywall form skip".split()
)
DENIED = frozenset("has with no without free".split())  # `has-sidebar` says that a sidebar lies beside
BODY = re.compile(r"(?:article|post|entry|story)[-_]?(?:body|content|text)", re.I)

COMMENT_END = re.compile(r"--!?>")
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
ANY_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
TAG_START = re.compile(r"<[/!?]?[a-zA-Z!?]")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
KNOWN = ("class=", "id=", "role=", "style=", "itemprop=", "hidden")


def named(names: str, inside: bool) -> str | None:
    """What the names in a class or an id say: `always` or `usually` furniture, or `body` of an article. A header inside
    an article is the article's own."""
    found = None
    for name in names.split():
        if BODY.fullmatch(name):
            return "body"
        words = {x.lower() for x in WORD.findall(name)}
        if not DENIED.isdisjoint(words):
            continue
        if not ALWAYS.isdisjoint(words):
            return "always"
        if USUALLY & words - ({"header"} if inside else set()):
            found = "usually"
    return found


def said(tag: str, attributes: str, above: str, weak: bool) -> tuple[str, bool]:
    """What a start tag makes of what is inside it, given what holds around it, and whether an article inside may differ."""
    inside = above in (ARTICLE, MAIN)
    named_as, role, body = None, "", False
    if attributes and any(x in attributes.lower() for x in KNOWN):
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id") and tag not in ("html", "body"):
                new = named(value, inside)
                named_as = new if named_as is None or new in ("always", "body") else named_as
            elif key == "role":
                role = value.strip().lower()
            elif key == "itemprop":
                body |= value.strip().lower() == "articlebody"
            elif key == "hidden" or key == "aria-hidden" and value.strip().lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                return DROP, False
    if above == DROP and not weak or tag in FURNITURE or role in ROLES or named_as == "always":
        return DROP, False
    if tag == "form" or tag == "header" and not inside:
        return DROP, True
    if tag == "article" or role == "article":
        return (DROP, False) if above == ARTICLE else (ARTICLE, False)  # an article inside another comments on it
    if tag == "main" or role == "main":
        return MAIN, False
    if body or named_as == "body":
        return ARTICLE, False
    if named_as == "usually":
        return DROP, True
    return above, weak


def lines(page: str) -> list[tuple[str, str]]:
    """(text, what markup says) of each block that has text, in page order; an article where the page has any text in
    one, else its main region, is told apart from all that lies outside, which becomes DROP."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str, bool]] = []
    often: Counter[str] = Counter()
    held: list[str] = []
    state, weak = OPEN, False

    def end_line() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append((text, state))

    def pop() -> None:
        nonlocal state, weak
        tag, state, weak = stack.pop()
        often[tag] -= 1

    def end(tags: set[str], stops: set[str]) -> None:
        if not any(often[x] for x in tags):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in tags:
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] in stops:
                return

    at, last, pattern = 0, page.rfind(">"), TAG
    while True:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            held.append(page[at:])
            if begin >= 0 and TAG_START.match(page, begin):  # a tag that the page's end cuts off
                held[-1] = page[at:begin]
            break
        if begin > at:
            held.append(page[at:begin])
        if page.startswith("<!--", begin):
            closed = COMMENT_END.search(page, begin + 4)
            if page.startswith(">", begin + 4) or page.startswith("->", begin + 4):
                at = page.index(">", begin) + 1
            elif closed is None:
                break
            else:
                at = closed.end()
            continue
        if page.startswith(("<!", "<?"), begin):
            at = page.index(">", begin) + 1
            continue
        found = pattern.match(page, begin)
        if found is None and pattern is TAG and ANY_TAG.match(page, begin):  # a quote that stays open
            pattern = ANY_TAG
            found = pattern.match(page, begin)
        if found is None:
            held.append("<")
            at = begin + 1
            continue
        at, tag = found.end(), found[2].lower()
        if tag == "br" or tag in ("img", "wbr", "input", "hr") and not found[1]:
            if tag == "hr":
                end_line()
            elif tag == "br":
                held.append(" ")
            continue
        if tag in BLOCKS:
            end_line()
        if found[1]:
            if often[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            close = RAW_END[tag].search(page, at)
            if close is None:
                break
            at = close.start()
            continue
        if tag in BLOCKS and tag not in ("html", "body", "option", "optgroup"):
            end({"p"}, {"table", "button", "td", "th", "caption"})
        if tag in ENDS:
            end(*ENDS[tag])
        if tag == "body":
            end({"head"}, set())
        stack.append((tag, state, weak))
        often[tag] += 1
        state, weak = said(tag, found[3], state, weak)
    end_line()
    kinds = {kind for _, kind in out}
    for best in (ARTICLE, MAIN):
        if best in kinds:
            return [(text, kind if kind == best else DROP) for text, kind in out]
    return out
