"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line weighs
the text it holds outside links and outside boilerplate (navigation, headers,
footers, sidebars, notices, adverts, forms, reader comments: by element, role,
or class and id words of an element).  An element that holds the title or most of
the text is no boilerplate, whatever it is; a word that prose uses as well, such
as notice or legal, tells only where a block is short or full of links.  The
weights are summed over a sliding window of ``WINDOW`` lines.  A run starts at a
line with text where that sum surges over a threshold, and ends where it dives to
nothing.  Inside an article or main element every line with text surges, unless an
article without main holds less than half of what the rest of the page has; in the
other reading, the runs that carry a fair share of the heaviest run's text, all
lines of its container, and runs in sections beside it are the main text.  Where
nothing is left, the page is read again without regard to classes and ids.  Kept
lines are whole: nothing is capped.

Defined results: a null, empty or text-less page gives an empty text; unclosed
elements end with their parent, and unclosed boilerplate at the next heading or
section; columns of the input with the names of results are replaced, others
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

WINDOW, SURGE, SHARE = 3, 80, 0.2
SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements whose content is no text (fixed values).
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BOILER = {"nav", "footer", "aside", "form", "head", "menu", "select", "button", "option", "datalist", "dialog", "svg", "math", "object", "audio", "video", "canvas", "map", "fieldset", "label"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
#: Elements that an opening block of the same kind ends.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SECTION = {"article", "main", "section", "header", "footer", "nav", "aside", "h1", "h2", "h3", "body"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "status", "toolbar"}
#: Words of class and id that mark boilerplate.
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising adsense adsbygoogle banner breadcrumb breadcrumbs byline comment comments commentlist commentbox consent cookie cookies copyright"
    " dialog disclaimer discussion disqus footer form gdpr legal login masthead menu menubar modal nav navbar navigation navigator newsletter notice notices notification notifications"
    " overlay pager pagination paywall popover popup privacy promo promos promoted promotion recommend recommendations recommended related replies reply respond responses search"
    " share sharing sidebar sidenav signin signup skip skiplink social sponsor sponsored sponsors subscribe subscription submenu tagcloud teaser toast toolbar topbar topnav tracking widget widgets".split()
)
#: Of these, words that prose uses as well: they tell only with SHORT unlinked text or fewer, or where PARTLY of the text is linked.
PROSE = set("banner copyright dialog disclaimer discussion form legal login notice notices notification notifications privacy recommend respond responses search share sharing social toast tracking".split())
SHORT, PARTLY = 100, 0.3
#: Elements and roles that may wrap a whole page.
WRAPS = {"form", "fieldset", "dialog", "object", "label"}
#: Boilerplate inside a line.
INLINE = {"label", "button"}
#: Marks that an article's own header may carry.
OWN = {"banner"}
#: Words that make a class say what an element has or lacks, or which kind of article it is, rather than what it is.
ABOUT = {"no", "has", "with", "without", "not", "tag", "category", "status", "format", "type", "elementor", "wp", "body", "page", "single"}
#: A quote opens a value after an equals sign alone.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
COMMENTS = re.compile(r"(?:\d+\s+)?(?:reader\s+)?comments?(?:\s*\(?\d+\)?)?|leave a (?:comment|reply)", re.I)


def _marked(raw: str) -> tuple[int, bool, bool, bool]:
    """Whether an element is boilerplate by its class or id (1: by a word of prose, 2: by another), by its role, or as it is hidden; whether it says that it holds the main text."""
    if not raw or ("=" not in raw and "hidden" not in raw.lower()):
        return 0, False, False, False
    named, role, boiler, main = 0, False, False, False
    for m in ATTRIBUTE.finditer(raw):
        name = m[1].lower()
        value = unescape(m[2] or m[3] or m[4] or "")
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in WORD.findall(token)} | {token.lower()}
                if words & MARKS and not words & ABOUT:
                    named = max(named, 2 if words & MARKS - PROSE else 1)
        elif name == "role":
            role |= value.strip().lower() in ROLES
            main |= value.strip().lower() in ("main", "article")
        elif name == "itemprop":
            main |= value.strip().lower() == "articlebody"
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            boiler = True
        elif name == "style":
            boiler |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return named, role, boiler, main


class Line:
    __slots__ = ("text", "weight", "boiler", "inside", "sure", "heading", "parent", "home", "kind")

    def __init__(self, text, weight, boiler, inside, sure, heading, parent, home, kind):
        self.text, self.weight, self.boiler, self.inside, self.sure, self.heading, self.parent, self.home, self.kind = text, weight, boiler, inside, sure, heading, parent, home, kind


def lines_of(html: str, marks: bool = True) -> list[Line]:
    """Blocks of the page in order, with their weights.  marks: whether classes and ids count."""
    tokens = []  # (start, end, closes, tag, attributes)
    at = 0
    while True:
        m = TOKEN.search(html, at)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        tokens.append((m.start(), at, bool(m[1]), tag, m[3] or ""))
        if tag in RAW and not m[1] and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{tag}\s*>?", re.I).search(html, at)
            stop = end.start() if end else len(html)
            tokens.append((at, stop, False, "", ""))
            at = stop
    # which opening tags have an end tag of their own
    closed, open_ = {}, []
    upto, before, last = [], 0, 0  # text of the page before each token
    linked_upto, in_link, in_links = [], 0, False
    for start, end, ends, tag, _ in tokens:
        size = max(0, len(html[last:start].strip()))
        before += size
        in_link += size * in_links
        upto.append(before)
        linked_upto.append(in_link)
        in_links = not ends if tag == "a" else in_links
        last = end
    whole = before + len(html[last:].strip())
    titles = [i for i, (_, _, ends, tag, _) in enumerate(tokens) if tag in ("h1", "main") and not ends]
    for i, (_, _, ends, tag, _) in enumerate(tokens):
        if not tag or tag in VOID:
            continue
        if not ends:
            open_.append((tag, i))
        else:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    closed[open_[k][1]] = i
                    del open_[k:]
                    break
    out: list[Line] = []
    stack: list[tuple[str, int, int, int, bool, int, int]] = []  # tag, boilerplate, inside, links, loose, token, sure
    boiler = inside = links = sure = 0
    parts: list[str] = []
    linked = 0
    heading = False

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                home = stack[-2] if len(stack) > 1 else None
                # sections, and elements of one class, that stand in one parent are of a kind
                kind = (stack[-3][5], home[0], tokens[home[5]][4].strip()) if len(stack) > 2 and (home[0] == "section" or "class" in tokens[home[5]][4]) else None
                out.append(Line(text, 0 if boiler else max(0, len(text) - linked), boiler > 0, inside > 0, sure > 0, heading, len(stack), home[5] if home else -1, kind))
        parts, linked = [], 0

    def pop():
        nonlocal boiler, inside, links, sure
        _, b, n, a, _, _, u = stack.pop()
        boiler -= b
        inside -= n
        links -= a
        sure -= u

    at = 0
    for i, (start, end, ends, tag, raw) in enumerate(tokens):
        if start > at and not (stack and stack[-1][0] in INLINE and stack[-1][1]):
            piece = html[at:start]
            parts.append(piece)
            if links:
                linked += len(piece)
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if not ends:
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        while len(stack) > k:
                            pop()
                    elif stack[k][0] in BLOCK:
                        break
            elif tag in BLOCK:
                while stack and stack[-1][0] == "p":
                    pop()
            if tag in SECTION:
                # boilerplate that is never closed ends here
                for k in range(len(stack)):
                    if stack[k][4] and stack[k][1]:
                        while len(stack) > k:
                            pop()
                        break
            named, role, marked, main = _marked(raw)
            last = closed.get(i, len(tokens))
            held = (upto[last] if last < len(tokens) else whole) - upto[i]
            k = bisect_right(titles, i)
            titled = k < len(titles) and titles[k] < last
            if named and marks and tag not in ("html", "body", "h1", "article", "main") and not main:
                # what holds the page's title or nearly all of its text is no boilerplate, whatever its class says
                if named == 1:
                    own_links = (linked_upto[last] if last < len(tokens) else in_link) - linked_upto[i]
                    named = held - own_links < SHORT or own_links >= PARTLY * held
                marked |= bool(named) and 10 * held <= 9 * whole and not titled
            wraps = titled or 2 * held > whole
            marked |= role and not wraps
            boilerplate = tag in BOILER and not (tag in WRAPS and wraps)
            own = inside and tag == "header"
            b = int(boilerplate or tag in RAW or (tag == "header" and not inside) or (marked and not own and tag not in ("html", "body", "h1")))
            n = int((tag in ("article", "main") or main) and not boiler and not b)
            a = int(tag == "a")
            if raw.rstrip().endswith("/") and tag not in BLOCK:
                continue
            u = int(n and (tag == "main" or main))
            stack.append((tag, b, n, a, i not in closed, i, u))
            sure += u
            boiler += b
            inside += n
            links += a
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") or (heading and tag not in BLOCK)
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        pop()
                    break
            if tag in BLOCK:
                heading = False
    if at < len(html):
        parts.append(html[at:])
    flush()
    # what follows a heading of reader comments, in the same parent, is theirs, if it is not most of the text
    total = sum(len(x.text) for x in out if not x.boiler)
    for k, line in enumerate(out):
        if line.heading and not line.boiler and COMMENTS.fullmatch(line.text):
            end = next((j for j in range(k + 1, len(out)) if out[j].parent < line.parent), len(out))
            if 2 * sum(len(x.text) for x in out[k:end] if not x.boiler) <= total:
                for x in out[k:end]:
                    x.boiler, x.weight = True, 0
    return out


def runs(weights: list[int], surge: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """[from, to) of the lines between surge and dive points of the block distribution."""
    n = len(weights)
    block = [sum(weights[i : i + window]) for i in range(n)]
    out, i = [], 0
    while i < n:
        if block[i] > surge and weights[i]:
            j = i
            while j < n and block[j]:
                j += 1
            out.append((i, j))
            i = j
        else:
            i += 1
    return out


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> str:
    if not html:
        return ""
    return _main(lines_of(html), window, surge, share) or _main(lines_of(html, False), window, surge, share)


def _main(lines: list[Line], window: int, surge: int, share: float) -> str:
    within = [x for x in lines if x.inside]
    own = [len(x.text) if not x.boiler else 0 for x in within]
    kept = _flowing([x for x in lines if not x.inside], window, surge, share)
    sure = any(x.sure and not x.boiler for x in within)
    if sum(own) and (sure or sum(x.weight for x in kept) <= 2 * sum(own)):
        kept = [x for i, j in runs(own, 0, window) for x in within[i:j]]
    return "\n".join(x.text for x in kept if not x.boiler)


def _flowing(lines: list[Line], window: int, surge: int, share: float) -> list[Line]:
    """The lines that the distribution alone shows as main text."""
    weights = [x.weight for x in lines]
    found = runs(weights, surge, window) or runs(weights, 0, window)
    if not found:
        return []
    mass = [sum(weights[i:j]) for i, j in found]
    i, j = found[mass.index(max(mass))]
    homes = {x.home for x in lines[i:j] if x.weight}
    kinds = {x.kind for x in lines[i:j] if x.weight and x.kind}
    keep = [x.weight > 0 and x.home in homes for x in lines]
    for (i, j), m in zip(found, mass):
        if m >= share * max(mass) or any(x.home in homes or x.kind in kinds for x in lines[i:j] if x.weight):
            keep[i:j] = [True] * (j - i)
    return [x for x, k in zip(lines, keep) if k]


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", window: int = WINDOW, surge: int = SURGE, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                rows = b.slice(i, 256)
                text = [main_text(x.as_py(), window, surge, share) for x in rows.column(2)]
                yield batch({"page_id": rows.column(0), "url": rows.column(1), "text": pa.array(text, pa.string()), "n_chars": pa.array([len(x) for x in text], pa.int64())})

    return pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, SCHEMA)
