"""Main text of web pages: markup proposes, and a host suffix array decides what markup leaves open.

A page is read into blocks of text. Markup marks a block as content (inside an article or main element and under nothing
that is boilerplate) or as boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, comments, by element,
role or whole name). A block under an element of which only a part of a name speaks against it is a suspect, in articles,
too; unmarked blocks of pages without an article or main element are open. For both a suffix array decides: the tokens of all blocks that are not content are concatenated, page by page, over the pages of a host; suffixes
are sorted to a depth of RUN tokens; runs of that length, and whole suspects that are shorter, which stand on two distinct
pages of the host are boilerplate, and so is every token that such a run covers. Open blocks lose their covered tokens and
keep their unique runs.

Other text inside an article is never taken away for being repeated: copies of an article, and passages that several
articles share, are main text of each.

The suffix array is built over blocks of pages of bounded size, in the order in which the pages lie, whatever their host.
It reports each run of RUN tokens once for its block, with the least and the greatest page it is on; an aggregation by host
and run tells which are on distinct pages anywhere. So a host with a third of all pages is never in one task, and a menu
that all its pages share is one row for each block of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import stored

#: Tokens of a run that counts as long.
RUN = 8
#: Tokens of a block of pages.
BLOCK_TOKENS = 400_000

OPEN, CONTENT, BOILERPLATE, SUSPECT = range(4)

# Element names of HTML and usual names of boilerplate.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "canvas", "textarea", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
}
_SPACED = {"br", "td", "th", "img", "option"}
_NEVER = {"head", "title", "nav", "aside", "form", "button", "select", "dialog", "menu", "footer", "label", "fieldset"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "alert"}
_NAMES = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promoted", "nav", "navbar", "navigation", "menu",
    "breadcrumb", "breadcrumbs", "footer", "sidebar", "aside", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login",
    "form", "search", "comment", "comments", "commentlist", "reply", "replies", "respond", "disqus", "related", "recommended", "share", "sharing", "social", "pagination", "pager", "widget",
    "toolbar", "masthead", "skip",
}
_PAGE_NAMES = {"header", "topbar"}
# Of these, names that as a part of a longer name may well mean something else (related-work, ad-hoc, form-factor).
_VAGUE = {"ad", "ads", "aside", "banner", "comment", "form", "header", "login", "menu", "nav", "notice", "overlay", "promo", "related", "reply", "respond", "search", "share", "sharing", "skip", "social", "subscribe"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)(?:>|\Z)|<[!?][^>]*>?|<(?P<end2>/?)(?P<name2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes2>[^>]*)>?",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_HOST = re.compile(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _boilerplate(name: str, attributes: str, inside: bool) -> int:
    """2 for boilerplate, 1 for a suspect, whose repetition decides, 0 for neither. A header inside an article holds the
    article's title. Of class and id, whole names say boilerplate; parts of names do so outside of articles where they are
    not vague, and else make a suspect."""
    if name in _NEVER or (name == "header" and not inside):
        return 2
    if not attributes or not attributes.strip(" /"):
        return 0
    suspect = 0
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value)):
            return 2
        if key == "role" and value.strip() in _ROLES:
            return 2
        if key in ("class", "id"):
            listed = _NAMES if inside else _NAMES | _PAGE_NAMES
            if set(value.split()) & listed:
                return 2
            if parts := set(re.split(r"[^a-z0-9]+", value)) & listed:
                if not inside and parts - _VAGUE:
                    return 2
                suspect = 1
    return suspect


def _is_main(name: str, attributes: str) -> bool:
    return name in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(?:main|article)\b|itemprop\s*=\s*[\"']?articlebody", attributes, re.I))


def blocks(page: str | None) -> list[tuple[str, int]]:
    """(text, label) of each block with text, in page order. If the page has an article, or else a main element, text
    outside of it is boilerplate; if it has neither, unmarked text is open. Where a part of a name
    speaks against a block, it is a suspect."""
    page = page or ""
    found: list[tuple[str, int, bool]] = []
    words: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, boilerplate, level of main element (2 article, 1 main)
    dropped, suspected, levels, best = 0, 0, [], 0
    counts: dict[str, int] = {}

    def flush() -> None:
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                found.append((text, -1 if dropped else max(levels, default=0), suspected > 0))
            words.clear()

    def close(until: int) -> None:
        nonlocal dropped, suspected
        while len(stack) > until:
            name, bad, level = stack.pop()
            counts[name] -= 1
            dropped -= bad == 2
            suspected -= bad == 1
            if level:
                levels.pop()

    at = 0
    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            words.append(page[at:])
            break
        tag = _TAG.match(page, start)
        if tag is None:
            words.append(page[at : start + 1])
            at = start + 1
            continue
        words.append(page[at:start])
        at = tag.end()
        name = (tag["name"] or tag["name2"] or "").lower()
        if not name:
            continue
        ends, attributes = bool(tag["end"] or tag["end2"]), tag["attributes"] or tag["attributes2"] or ""
        if name in _BLOCK:
            flush()
        elif name in _SPACED:
            words.append(" ")
        if ends:
            if counts.get(name):
                to = len(stack) - 1
                while stack[to][0] != name:
                    to -= 1
                if any(bad for _, bad, _ in stack[to:]):
                    flush()
                close(to)
            continue
        if name in _RAW:
            over = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
            at = over.end() if over else len(page)
            continue
        if name in _VOID or attributes.rstrip().endswith("/"):
            continue
        if name in _BLOCK and counts.get("p"):  # a paragraph ends where a block begins, unless it lies further out
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        level = (2 if name == "article" or "articlebody" in attributes.lower() else 1) if _is_main(name, attributes) else 0
        bad = 0 if level else _boilerplate(name, attributes, bool(levels))
        if bad:
            flush()
            dropped += bad == 2
            suspected += bad == 1
        if level:
            flush()
            levels.append(level)
            best = max(best, level if not dropped else 0)
        stack.append((name, bad, level))
        counts[name] = counts.get(name, 0) + 1
    flush()
    return [(text, BOILERPLATE if level < 0 or level < best else SUSPECT if suspect else CONTENT if best else OPEN) for text, level, suspect in found]


def suffix_runs(streams: list[list[str]], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array of concatenated token streams, sorted to a depth of ``run`` tokens (a power of two) by doubling.

    Returns starts of suffixes in that order, the rank of each (equal ranks share their first ``run`` tokens) and the stream
    of each. Every stream ends in separators of its own, and suffixes shorter than a run are left out.
    """
    numbers: dict[str, int] = {}
    flat = [numbers.setdefault(t, len(numbers)) for s in streams for t in s]
    sizes = np.array([len(s) for s in streams], dtype=np.int64)
    stream = np.repeat(np.arange(len(streams)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # tokens to the end of the stream
    rank = np.array(flat, dtype=np.int64)
    reach = 1
    while reach < run:
        later = np.concatenate([rank[reach:], np.full(min(reach, len(rank)), -1)])
        later = np.where(left > reach, later, -1)
        _, rank = np.unique(rank * (len(rank) + 1) + later + 1, return_inverse=True)
        reach *= 2
    whole = np.flatnonzero(left >= run)
    order = whole[np.argsort(rank[whole], kind="stable")]
    return order, rank[order], stream[order]


def _run_key(own_host: str, tokens: list[str]) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest("\0".join([own_host, *tokens]).encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & ((1 << 64) - 1)) - (1 << 63)


def _page_key(own_host: str, page: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{own_host}\0{page}".encode("utf-8", "surrogatepass")) - (1 << 63)


#: Rows of the table that pages are read into: pages (kind 0), runs of blocks of pages (1), places of open pages (2).
_READ = "kind int, page_id string, url string, text string, html string, page long, at long, size long, r1 long, r2 long, least long, most long"


def _frame(kind: int, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names, dtype=object)  # not as floats where some are missing
    out = pd.DataFrame({"kind": np.full(len(rows), kind, dtype=np.int32)})
    for field in _READ.split(", ")[1:]:
        name, of = field.split()
        column = frame[name] if name in names else pd.Series([None] * len(rows), dtype=object)
        out[name] = column.astype("Int64") if of == "long" else column.astype(object)
    return out


def _block_runs(pages: list[tuple[str, int, list[str]]], run: int) -> list[tuple]:
    """Each run of a host in a block of pages (host, page, tokens): its key, and the least and greatest page it stands on."""
    order, rank, stream = suffix_runs([tokens for _, _, tokens in pages], run)
    rows: list[tuple] = []
    if not len(order):
        return rows
    starts = np.concatenate([[0], np.cumsum([len(p[2]) for p in pages])])
    hosts = {h: i for i, h in enumerate(dict.fromkeys(p[0] for p in pages))}
    of = np.array([hosts[p[0]] for p in pages], dtype=np.int64)[stream]
    keys = np.array([p[1] for p in pages], dtype=np.int64)[stream]
    by = np.lexsort((keys, of, rank))
    rank, of, keys, order, stream = rank[by], of[by], keys[by], order[by], stream[by]
    cut = np.flatnonzero(np.concatenate([[True], (rank[1:] != rank[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([cut[1:], [len(rank)]]) - 1
    for a, b in zip(cut.tolist(), last.tolist(), strict=True):
        own, _, tokens = pages[stream[a]]
        at = int(order[a] - starts[stream[a]])
        rows.append((*_run_key(own, tokens[at : at + run]), int(keys[a]), int(keys[b])))
    return rows


def _open_runs(own_host: str, found: list[tuple[str, int]], tokens: list[str], run: int) -> tuple[list[tuple], list[tuple]]:
    """Of a page: (place, size, key) of the runs of ``run`` tokens and of suspects that are shorter; and the latter's keys."""
    if all(label in (CONTENT, BOILERPLATE) for _, label in found):
        return [], []
    runs = [(at, run, *_run_key(own_host, tokens[at : at + run])) for at in range(len(tokens) - run + 1)]
    short, at = [], 0
    for text, label in found:
        size = len(text.split()) if label != CONTENT else 0
        if label == SUSPECT and size < run:
            short.append((at, size, *_run_key(own_host, ["", *tokens[at : at + size]])))
        at += size
    return runs + short, [x[2:] for x in short]


def _read(batches: Iterator[pd.DataFrame], run: int, block_tokens: int) -> Iterator[pd.DataFrame]:
    """Every page is parsed once: its text if markup decides it, or else its html and the runs at each of its places; and
    the runs of each block of pages."""
    pages: list[tuple[str, int, list[str]]] = []
    size = 0
    for batch in batches:
        rows, places, short = [], [], []
        for page_id, url, page in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
            found = blocks(page)
            tokens = [t for text, label in found if label != CONTENT for t in text.split()]
            own, key = host(url), _page_key(host(url), page or "")
            runs, suspects = _open_runs(own, found, tokens, run)
            if any(label in (OPEN, SUSPECT) for _, label in found):
                rows.append((page_id, url, None, page, key))
                places += [(key, *x) for x in runs]
                short += [(*x, key, key) for x in suspects]
            else:
                rows.append((page_id, url, _text(found, None), None, None))
            if len(tokens) >= run:
                pages.append((own, key, tokens))
                size += len(tokens)
            if size >= block_tokens:
                yield _frame(1, _block_runs(pages, run), ["r1", "r2", "least", "most"])
                pages, size = [], 0
        yield _frame(0, rows, ["page_id", "url", "text", "html", "page"])
        if places:
            yield _frame(2, places, ["page", "at", "size", "r1", "r2"])
        if short:
            yield _frame(1, short, ["r1", "r2", "least", "most"])
    if pages:
        yield _frame(1, _block_runs(pages, run), ["r1", "r2", "least", "most"])


def _text(found: list[tuple[str, int]], covered: set[int] | None) -> str:
    kept, at = [], 0
    for text, label in found:
        if label == CONTENT:
            kept.append(text)
            continue
        tokens = text.split()
        if label in (OPEN, SUSPECT):
            left = " ".join(t for i, t in enumerate(tokens, at) if covered is None or i not in covered)
            if left:
                kept.append(left)
        at += len(tokens)
    return "\n".join(kept)


def main_text(pages: DataFrame, run: int = RUN, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages (page_id, url, html).

    Null or empty html has an empty text. Character references are decoded, white space in a block is one space, blocks are
    joined by line feeds. Pages with null urls share the host of no name; rows of one host with the same html are one page
    to the suffix array, and get the same text. Further columns are ignored; an empty table gives an empty result.
    """
    if run & (run - 1):
        raise ValueError("run must be a power of two")
    read = pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(lambda b: _read(b, run, block_tokens), _READ)
    read = stored(read, "pages")
    of = lambda kind: read.where(F.col("kind") == kind)
    shared = of(1).groupBy("r1", "r2").agg(F.min("least").alias("least"), F.max("most").alias("most")).where("least <> most").select("r1", "r2")
    covered = of(2).select("page", "at", "size", "r1", "r2").distinct().join(shared, ["r1", "r2"], "left_semi").groupBy("page").agg(F.collect_set(F.struct("at", "size")).alias("starts"))

    @F.pandas_udf("string")
    def finish(pages: pd.Series, starts: pd.Series) -> pd.Series:
        out = []
        for page, at in zip(pages, starts, strict=True):
            gone = {x["at"] + j for x in (at if at is not None else ()) for j in range(x["size"])}
            out.append(_text(blocks(page), gone))
        return pd.Series(out, dtype=object)

    straight = of(0).where("text is not null").select("page_id", "url", "text")
    judged = of(0).where("text is null").select("page_id", "url", "html", "page").join(covered, "page", "left").select("page_id", "url", finish("html", "starts").alias("text"))
    out = straight.unionByName(judged)
    return out.select(F.col("page_id").cast("long").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
