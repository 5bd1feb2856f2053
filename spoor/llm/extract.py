"""Main text of web pages, by container paths that the pages of a host agree on."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.llm.common import stage

LEVELS = 3          # tag-class steps of a generalised path, counted from the container upwards
MIN_SHARE = 0.1     # of a host's votes that a path needs to win; so at most ten win
GOOD_SHARE = 0.5    # of the text in the page's own container that a winning path has to hold to stand alone

# Elements by their role in a page, and words of class, id and role names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg select option "
                "button canvas audio video annotation annotation-xml".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr object math mfrac mi mn mo mover mpadded mroot "
                   "mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
SKIPPED = frozenset("nav footer aside form dialog menu".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BARRIER = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments "
    "commentlist consent cookie cookies disclaimer disqus donate feedback foot footer gdpr header legal login masthead menu "
    "modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion "
    "recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe "
    "subscription toolbar widget widgets".split())
# Words that go with those in names of parts of a page, and of asides that belong to a text.
PLAIN = frozenset("area articles bar block box buttons container form inner item items link links list news page post posts "
                  "reader section site stories user wrap wrapper".split())
QUOTED = frozenset("callout example pull pullquote quote tip".split())
STATES = frozenset("has hide is js no not show with without".split())   # 'has-sidebar' tells of a sidebar, but is none
GOOD = {"article": 1.5, "main": 1.2}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
                 r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
LEAF = re.compile(r"(p|h[1-6]|li|td|dd|dt|blockquote|pre)\b")


@dataclass
class Page:
    """Elements as (parent, step, skipped, doubted) and text blocks as (element, text, linked characters).

    What is read although its name says that it is noise is doubted."""
    parents: list[int] = field(default_factory=list)
    steps: list[str] = field(default_factory=list)
    skipped: list[bool] = field(default_factory=list)
    doubted: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    def path(self, node: int) -> str:
        steps = []
        while node >= 0 and len(steps) < LEVELS:
            steps.append(self.steps[node])
            node = self.parents[node]
        return ">".join(reversed(steps))


def _noisy(word: str) -> bool:
    """Whether the whole word, its leading or its last part is noise; a header inside the text is none."""
    parts = [x for x in re.split(r"[^a-z]+", word) if x]
    if not parts or not STATES.isdisjoint(parts):
        return False
    return parts[0] in NOISE or (parts[-1] in NOISE and (parts[-1] != "header" or parts[0] in ("global", "site", "top")))


def _all_noise(word: str) -> bool:
    """Whether a name is about noise altogether, as inside an article it has to be: there a section may well be named
    after what it tells of, such as 'comment-on-law'."""
    parts = {x for x in re.split(r"[^a-z]+", word) if x}
    return not parts.isdisjoint(NOISE - {"header"}) and parts <= NOISE | PLAIN


def _step(name: str, attributes: str, inside: bool) -> tuple[str, bool]:
    """Generalised tag-class of an element, without digits, and whether its name says it is noise."""
    classes, noise = [], False
    if attributes:
        for what, *values in NAMES.findall(attributes):
            words = entities.unescape("".join(values)).lower().split()
            noise |= any(map(_all_noise if inside else _noisy, words))
            if what.lower() == "class":
                classes = sorted({re.sub(r"\d+", "", w).strip("-_") for w in words} - {""})
    return ".".join([name, *classes]), noise


def _settle(page: Page, named: list[int], articles: set[int]) -> None:
    """Mark the elements to skip: those named 1 (class noise and forms) or 2 (by their tag), and all inside them.

    An element that holds most of the text in articles, and a quarter of all text, is read all the same. If
    less than a quarter of the text is left, so is one named 1 that holds most of it, and if none is left,
    all that are named 1.
    """
    text, art = [0] * len(named), [0] * len(named)
    for node, block, linked in page.blocks:
        text[node] += max(0, len(block) - linked)
    total = sum(text)
    for n in range(len(named) - 1, -1, -1):
        art[n] = text[n] if n in articles else art[n]
        if page.parents[n] >= 0:
            text[page.parents[n]] += text[n]
            art[page.parents[n]] += art[n]
    whole = sum(a for a, p in zip(art, page.parents) if p < 0)

    def skip(n: int, least: int) -> bool:
        if not named[n] or (named[n] == 1 and least == 2):
            return False
        if 2 * art[n] > whole and 4 * art[n] > total:
            return False
        return not (least == 1 and named[n] == 1 and 2 * text[n] > total and 4 * (whole - art[n]) <= total)

    for least in range(3):
        page.skipped = []
        for n, parent in enumerate(page.parents):
            page.skipped.append((parent >= 0 and page.skipped[parent]) or skip(n, least))
        left = sum(max(0, len(b) - linked) for n, b, linked in page.blocks if not page.skipped[n])
        if (4 * left >= total > 0 and least == 0) or (left and least):
            break
    for n, parent in enumerate(page.parents):
        page.doubted.append((parent >= 0 and page.doubted[parent]) or (named[n] > 0 and 2 * art[n] <= whole))


def parse(html: str | None) -> Page:
    """One pass over the tags. Unclosed, misnested and cut-off markup is tolerated."""
    html, page = html or "", Page()
    named: list[int] = []                  # see _settle
    articles: set[int] = set()
    stack: list[tuple[str, int, bool]] = []      # block elements that are open: name, number, whether in an article
    opened: Counter[str] = Counter()
    anchors, text, linked, at = 0, [], 0, 0

    def close(i: int) -> None:
        """Close the elements from place ``i`` of the stack on."""
        opened.subtract(name for name, _, _ in stack[i:])
        del stack[i:]

    def flush():
        nonlocal text, linked
        if text:
            joined = " ".join(entities.unescape("".join(text)).split())
            if joined and stack:
                page.blocks.append((stack[-1][1], joined, linked))
            elif joined:
                page.parents.append(-1), page.steps.append("html"), named.append(0)
                stack.append(("html", len(page.parents) - 1, False))
                opened["html"] += 1
                page.blocks.append((stack[-1][1], joined, linked))
        text, linked = [], 0

    for tag in TAG.finditer(html):
        if tag.start() < at:
            continue
        if tag.start() > at:
            piece = html[at:tag.start()]
            text.append(piece)
            linked += len(piece) if anchors else 0
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        closing, attributes = (tag[1] or tag[4]) == "/", tag[3] or tag[6] or ""
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            if name in ("button", "select", "textarea", "title"):
                text.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            elif name in ("br", "img", "wbr"):
                text.append(" " if name != "wbr" else "")
            continue
        flush()
        anchors = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in VOID:
            continue
        ends = CLOSES.get(name, ())
        for i in range(len(stack) - 1, -1, -1) if any(opened[e] for e in ends) else ():
            if stack[i][0] in ends:
                close(i)
                break
            if stack[i][0] in BARRIER.get(name, ()):
                break
        if stack and stack[-1][0] == "p" and name != "p":
            close(len(stack) - 1)              # any block ends an open paragraph
        inside = bool(stack) and stack[-1][2]
        step, noise = _step(name, attributes, inside)
        parent = stack[-1][1] if stack else -1
        told = name == "aside" and inside and not noise and not QUOTED.isdisjoint(re.split(r"[^a-z]+", step))
        page.parents.append(parent), page.steps.append(step)
        if name in ("article", "main") and not noise:
            articles.add(len(named))
        hard = (name in SKIPPED and name != "form" and not told) or (name == "header" and not inside)
        soft = name == "form" or (noise and name not in ("html", "body", "article", "main"))
        named.append(2 if hard else 1 if soft else 0)
        stack.append((name, len(page.parents) - 1, inside or name in ("article", "main")))
        opened[name] += 1
    if at < len(html):
        text.append(html[at:])
        linked += len(html) - at if anchors else 0
    flush()
    _settle(page, named, articles)
    return page


def scores(page: Page) -> dict[int, float]:
    """Score of each container: its blocks' unlinked text in full, its inner containers' by half."""
    out: dict[int, float] = {}
    for node, text, linked in page.blocks:
        if page.skipped[node]:
            continue
        worth = max(0.0, len(text) - 2.0 * linked)
        holder = page.parents[node] if LEAF.match(page.steps[node]) and page.parents[node] >= 0 else node
        for share in (1.0, 0.5, 0.25):
            if holder < 0:
                break
            out[holder] = out.get(holder, 0.0) + share * worth
            holder = page.parents[holder]
    return {n: s * GOOD.get(page.steps[n].split(".")[0], 1.0) for n, s in out.items() if s > 0}


def container(page: Page) -> int | None:
    """The best container (of equal ones the first in the page), or its farthest ancestor on the way to
    which each one that adds text to be read adds mostly unlinked text."""
    found = scores(page)
    if not found:
        return None
    plain, linked = [0] * len(page.parents), [0] * len(page.parents)
    for node, text, links in page.blocks:
        if not page.skipped[node]:
            plain[node] += max(0, len(text) - links)
            linked[node] += min(len(text), links)
    for n in range(len(page.parents) - 1, -1, -1):
        if page.parents[n] >= 0:
            plain[page.parents[n]] += plain[n]
            linked[page.parents[n]] += linked[n]
    top = at = max(found, key=lambda n: (found[n], -n))
    while (at := page.parents[at]) >= 0:
        more, links = plain[at] - plain[top], linked[at] - linked[top]
        if more + links and more <= links:
            break
        if more:
            top = at
    return top


def best_path(html: str | None) -> str | None:
    """Generalised path of the page's container."""
    page = parse(html)
    node = container(page)
    return None if node is None else page.path(node)


def main_text(html: str | None, winners: list[str] | None) -> str:
    """Blocks in the first winning path that holds a good share of the text in the page's own container.

    If none does, the blocks of all winning paths and of the container, in page order: a host's usual
    place may hold little of a page whose article lies elsewhere. Against a path that won, doubted text has no weight.
    """
    page = parse(html)
    paths = {}
    for n in range(len(page.parents)):
        if not page.skipped[n]:
            paths.setdefault(page.path(n), set()).add(n)
    choices = [paths[w] for w in (winners if winners is not None else []) if w in paths]
    own = container(page)
    own = set() if own is None else {own}

    def inside(chosen: set[int]) -> list[bool]:
        found: list[bool] = []
        for n, parent in enumerate(page.parents):
            found.append((n in chosen or (parent >= 0 and found[parent])) and not page.skipped[n])
        return found

    def blocks(within: list[bool]) -> list[tuple[str, int]]:
        return [(t, linked) for n, t, linked in page.blocks if within[n]]

    def plain(found: list[tuple[str, int]]) -> int:
        return sum(max(0, len(t) - linked) for t, linked in found)

    sure = [x and not d for x, d in zip(inside(own), page.doubted)]
    for chosen in choices:
        found = blocks(inside(chosen))
        if found and plain(found) >= GOOD_SHARE * plain(blocks(sure)):
            return "\n".join(t for t, _ in found)
    usual = inside(set().union(*choices))
    within = [a or b for a, b in zip(usual, sure)] if blocks(usual) else inside(own)
    return "\n".join(t for t, _ in blocks(within))


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, winners): paths with ``MIN_SHARE`` of the host's votes, most votes first.

    Each page votes for the path of its container. Votes are added up before the shuffle, so
    a host with a third of all pages costs no more than any other.
    """
    def of(htmls: pd.Series) -> pd.Series:
        return pd.Series([best_path(h) for h in htmls], dtype=object)

    votes = (pages.select(host_of(F.col("url")).alias("host"), F.pandas_udf(of, "string")("html").alias("path"))
             .filter("path is not null").groupBy("host", "path").agg(F.count("*").alias("votes")))
    votes = stage(votes, "extract-votes")
    sums = votes.groupBy("host").agg(F.sum("votes").alias("all"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path")))
    return (votes.join(sums, "host").filter(F.col("votes") >= MIN_SHARE * F.col("all")).groupBy("host")
            .agg(F.transform(ranked, lambda x: x["path"]).alias("winners")))


def extract_text(pages: DataFrame) -> DataFrame:
    """All columns of ``pages`` (url, html) and ``main_text``.

    Null and empty pages give the empty text. Pages without a host vote together. A page in which no
    winning path holds half as much text as its own container gets the text of all of them. Of paths with
    equally many votes the one first in text comes first. Repeated rows stay.
    """
    def of(htmls: pd.Series, winners: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, w) for h, w in zip(htmls, winners)], dtype=object)

    # Staged, so that the planner knows the size and broadcasts only a small table.
    paths = stage(host_paths(pages), "extract-paths").withColumnsRenamed({"host": "_host", "winners": "_winners"})
    joined = pages.join(paths, host_of(pages["url"]) == paths["_host"], "left")
    text = F.pandas_udf(of, "string")(pages["html"], paths["_winners"])
    return joined.withColumn("main_text", text).drop(paths["_host"], paths["_winners"])
