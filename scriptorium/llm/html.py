"""Main text of web pages by consensus host paths.

Each page's containers are scored by the text in their blocks less what is in links, all of it passed on
to the containers around. From the root down, a wrapper gives way to the container inside it that holds
most of its score, until one is an article or has text of its own: so an article's sections stay
together, and what stands beside it is left. A container's path is its tags and classes from the root
with digits generalised. Each page votes for the path of its best container with the share of its score
that is in it; votes are summed by host with partial aggregation, and a host's path with the most votes
wins. Pages are then read again with the winning path of their host; a page without that path uses its
own best one.

Elements whose tag, role or class tells menus, adverts, comments and the like are dropped. Words that may
as well name a part of an article (related, discussion, notice, search, share) only drop an element that
is short or mostly links; a header inside an article stays, with its headline.

The winners are a written table: Spark broadcasts it if its size is under the session's limit and
joins by host otherwise.

Edge cases: a null or empty html gives an empty text; a null url is the host ``''``; repeated rows
stay; an unclosed element ends with its parent or the page, an embedded one (svg, video) at once; of
paths with equal votes the longer one wins, then the one that sorts last; of containers that hold equal
scores, likewise; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|iframe|textarea|title)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>",
    re.S | re.I,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

#: Elements dropped whole; one without an end is its start tag only.
EMBEDDED = frozenset("template noscript svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption head".split())
CONTAINER = frozenset("article body div main section td center html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A header outside of an article or main goes too.
DROP_TAG = frozenset("nav footer aside form button select option menu dialog head input label datalist fieldset".split())
DROP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
_WORDS = "ads?|advert(?:s|isement|isements|ising)?|adsbygoogle|sponsor(?:ed)?|promo(?:tion|ted)?|banner|sidebars?|side-?bar|menus?|nav(?:bar|igation)?|breadcrumbs?|page-?header|site-?header|masthead|page-?footer|site-?footer|footer|comments?|commentlist|disqus|respond|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|subscription|sign-?up|login|social|widgets?|toolbar|pagination|pager|paywall|copyright|hidden|visually-hidden|sr-only|screen-reader-text"
_MAYBE = "header|discussion|repl(?:y|ies)|notices?|notification|alert|warning-bar|share|sharing|related|recommend(?:ed|ations)?|read-more|search"


def _names(words: str) -> re.Pattern:
    """A class or id tells if it begins with such a word, or ends with one and doesn't say "with" it."""
    return re.compile(rf"(?:{words})(?:[-_].*)?|(?!(?:.*[-_])?(?:has|with|no|without|is|and)[-_]).*[-_](?:{words})", re.I)


_JUNK_HEAD, _JUNK, _WEAK, _INLINE = re.compile(rf"(?:{_WORDS})(?:[-_].*)?", re.I), _names(_WORDS), _names(_MAYBE), _names(f"{_WORDS}|share|sharing|read-more")
#: Text outside links and headings from which an element with such a name counts as part of an article;
#: a section with a heading counts with any.
ENOUGH = 400
#: An opening tag closes these open ones on its way to a limit.
_CLOSES = {"li": ("li", {"ul", "ol", "menu"}), "dd": ("dd dt", {"dl"}), "dt": ("dd dt", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
_CLOSES = {k: (frozenset(a.split()), b) for k, (a, b) in _CLOSES.items()}


class Element:
    __slots__ = ("tag", "path", "drop", "weak", "inside", "no", "text", "links", "heads", "blocks")

    def __init__(self, tag: str, path: str, drop: bool, weak: bool, inside: bool, no: int):
        self.tag, self.path, self.drop, self.weak, self.inside, self.no = tag, path, drop, weak, inside, no
        self.text = self.links = self.heads = self.blocks = 0

    def junk(self) -> bool:
        """Of an element whose name may tell: whether its content does too."""
        plain = self.text - self.links
        if not self.weak or (self.links < 0.4 * self.text and self.heads and plain > 0 and self.tag in ("section", "article")):
            return False
        return self.links >= 0.4 * self.text or plain < ENOUGH or self.blocks < 2


def _open(tag: str, attrs: str, parent: Element | None, no: int, inline: bool = False) -> Element:
    inside = tag in ("article", "main") or bool(parent and parent.inside)
    drop, weak, classes = tag in DROP_TAG or (tag == "header" and not inside), False, ""
    if attrs and not attrs.isspace():
        names = []
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
            if name == "class":
                names += value.split()
                classes = "".join(sorted("." + _DIGITS.sub("#", c) for c in set(value.split())))
            elif name == "id":
                names += value.split()
            elif name == "role":
                drop |= value.strip().lower() in DROP_ROLE
            elif name == "hidden":
                drop = True
            elif name == "aria-hidden":
                drop |= value.strip().lower() == "true"
            elif name == "style":
                drop |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
        if tag not in ("html", "body", "main", "header") and tag not in HEADINGS:
            pattern = _INLINE if inline else _JUNK_HEAD if tag == "article" else _JUNK
            drop |= any(pattern.fullmatch(x) for x in names)
            weak = not inline and tag != "article" and any(_WEAK.fullmatch(x) for x in names)
    path = f"{parent.path}>{tag}{classes}" if parent and parent.path else tag + classes
    return Element(tag, path, drop or bool(parent and parent.drop), weak, inside, no)


def _embedded(page: str) -> dict[int, int]:
    """Where each embedded element that is closed begins and ends."""
    begun: dict[str, list[int]] = {}
    out = {}
    for m in _TOKEN.finditer(page):
        tag = (m["tag"] or "").lower()
        if tag in EMBEDDED:
            if not m["end"]:
                if not m["attrs"].endswith("/"):
                    begun.setdefault(tag, []).append(m.start())
            elif begun.get(tag):
                out[begun[tag].pop()] = m.end()
    return out


def read(page: str) -> list[tuple[str, int, tuple[Element, ...]]]:
    """Blocks of the page in order, without dropped elements: text, characters in links, and the open
    containers from the root."""
    out, stack, text, links, at, n, in_link = [], [], [], 0, 0, 0, 0
    skip, depth = "", 0  # an inline element that is dropped, and how deep in equal ones

    def flush():
        nonlocal links
        if text:
            own = _SPACE.sub(" ", "".join(text)).strip()
            if own and not (stack and stack[-1].drop):
                out.append((own, min(links, len(own)), tuple(stack)))
            text.clear()
            links = 0

    def pop_to(i: int):
        flush()
        del stack[i:]

    def add(raw: str):
        nonlocal links
        if raw and not skip and not (stack and stack[-1].drop):
            own = html.unescape(raw)
            text.append(own)
            if in_link:
                links += len(own)

    ends = None
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if tag in EMBEDDED:
            if not m["end"]:
                ends = _embedded(page) if ends is None else ends
                at = ends.get(m.start(), at)
            continue
        if skip:
            if tag in BLOCK or tag in DROP_TAG:
                skip = ""  # it was never closed
            elif tag == skip:
                depth += -1 if m["end"] else 1
                if not depth:
                    skip = ""
                continue
            else:
                continue
        elif not m["end"] and m["attrs"] and tag not in BLOCK and tag not in VOID and tag not in DROP_TAG and _open(tag, m["attrs"], None, 0, True).drop:
            skip, depth = tag, 1
            continue
        if m["end"]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag in BLOCK or tag in DROP_TAG:
                i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag), None)
                if i is not None:
                    pop_to(i)
            continue
        if tag == "a":
            in_link += not (m["attrs"] or "").endswith("/")
        elif tag == "br":
            add(" ")
        elif tag in BLOCK or tag in DROP_TAG:
            flush()
            if tag in _CLOSES:
                closed, limit = _CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in limit:
                        break
                    if stack[i].tag in closed:
                        pop_to(i)
                        break
            if stack and stack[-1].tag == "p":
                pop_to(len(stack) - 1)
            in_link = 0
            if tag not in VOID:
                n += 1
                stack.append(_open(tag, m["attrs"] or "", stack[-1] if stack else None, n))
    add(page[at:])
    flush()
    for own, in_links, around in out:
        head = any(e.tag in HEADINGS for e in around)
        for e in around:
            if e.weak:
                e.text += 0 if head else len(own)
                e.links += 0 if head else in_links
                e.heads += head
                e.blocks += 1
    return [(own, in_links, tuple(e for e in around if e.tag in CONTAINER)) for own, in_links, around in out if not any(e.weak and e.junk() for e in around)]


def scores(blocks: list) -> dict[str, float]:
    """Score of each container path of a page: the text outside links less that in links of all blocks
    inside."""
    out: dict[str, float] = {}
    for text, links, around in blocks:
        for path in {e.path for e in around}:
            out[path] = out.get(path, 0.0) + len(text) - 2 * links
    return {k: v for k, v in out.items() if v > 0}


#: A container with this share of its score in blocks that are in none of its parts has text of its own.
OWN = 0.1


def best(blocks: list) -> tuple[str | None, float]:
    """Path of the page's best container, and the share of the page's score that it holds."""
    held, own, parts, ends = scores(blocks), {}, {}, {}
    for text, links, around in blocks:
        chain = list(dict.fromkeys(e.path for e in around))
        for e in around:
            ends[e.path] = e.tag
        if chain:
            own[chain[-1]] = own.get(chain[-1], 0.0) + len(text) - 2 * links
        for outer, inner in zip(chain, chain[1:]):
            parts.setdefault(outer, set()).add(inner)
    roots = {e[2][0].path for e in blocks if e[2]}
    total = sum(held.get(r, 0.0) for r in roots)
    choose = lambda paths: max((p for p in paths if p in held), key=lambda p: (held[p], len(p), p), default=None)
    at = choose(roots)
    while at is not None and ends[at] != "article":
        inner = choose(parts.get(at, ()))
        article = choose(p for p in parts.get(at, ()) if ends[p] in ("article", "main"))
        if article is not None and held[article] >= 0.5 * held[at]:
            at = article
        elif inner is not None and held[inner] >= 0.5 * held[at] and (ends[at] in ("html", "body") or own.get(at, 0.0) < OWN * held[at]) and ends[at] != "section":
            at = inner
        else:
            break
    return (at, held[at] / total) if at is not None else (None, 0.0)


def extract(page: str | None, path: str | None) -> str:
    """The text of the containers at the path, or at the page's own best one."""
    found = read(page or "")
    inside = [b for b in found if path is not None and any(e.path == path for e in b[2])]
    if not inside:
        own, _ = best(found)
        inside = [b for b in found if any(e.path == own for e in b[2])] if own is not None else found
    return "\n".join(b[0] for b in inside)


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, path, votes: the winning path of each host; ties go to the longer path, then by name."""
    cols = pages.select(_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            votes: dict[tuple[str, str], float] = {}
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                path, share = best(read(page or ""))
                if path is not None:
                    votes[host, path] = votes.get((host, path), 0.0) + share
            # whole millionths: sums that don't depend on the order of rows
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in votes], pa.string()), pa.array([p for _, p in votes], pa.string()), pa.array([round(v * 1e6) for v in votes.values()], pa.int64())], names=["host", "path", "votes"])

    votes = cols.mapInArrow(run, "host string, path string, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    most = F.struct("votes", F.length("path").alias("length"), "path")
    return votes.groupBy("host").agg(F.max(most).alias("best")).select("host", "best.path", "best.votes")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, path (the host's winning path)."""
    cols = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    winners = written(host_paths(cols)).select(F.col("host").alias("_host"), "path")
    joined = cols.join(winners, _host(cols["url"]) == winners["_host"], "left").select("page_id", "url", "html", "path")

    def run(batches):
        for b in batches:
            text = [extract(page, path) for page, path in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), b.column(3)], names=["page_id", "url", "text", "n_chars", "path"])

    return joined.mapInArrow(run, f"page_id {cols.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint, path string")
