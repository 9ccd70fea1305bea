"""Main text of web pages by consensus of each host's pages.

Every page is read once to score its containers: the deepest element that holds all of the page's
unlinked text outside menus, adverts and the like casts a vote for its generalised tag-class path
(digits in classes become #). Votes are summed per host in Spark, and every page is extracted again
with its host's winning path; a page where that path lacks some of this text uses its own best, and all
its text where no element holds it. The winner so decides about blocks that are mostly links.

Defined results: null html is empty; a page without text gives an empty string; a null url forms a host
of its own; repeated rows are extracted each; extra columns stay out of the result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import slices, written

#: Elements whose content is never text of the article, and names that say the same.
SKIPPED = frozenset("head title nav header footer aside form script style noscript template svg iframe button select textarea object canvas dialog menu audio video map math label fieldset".split())
RAW = frozenset("script style noscript template svg iframe textarea title math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDERS = frozenset("html body div section article main center table tbody thead tfoot tr td th ul ol li dl dd dt blockquote figure details pre".split()) | SKIPPED
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscri\w+|"
    r"nav\w*|menu\w*|breadcrumbs?|sidebar|widgets?|footer|(?:site|page|top)-?header|masthead|toolbar|share|sharing|social|related|recommend\w*|"
    r"comments?|comment-?list|disqus|replies|respond|discussion|login|signup|search|pagination|pager|copyright|skip-?(?:links?|nav\w*|to\w*|content))(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^'">]|"[^"]*"|'[^']*')*|[^>]*)>""", re.S)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Bytes of the winners that are broadcast at most.
SENT = 16 << 20
#: These elements are never dropped for their name (an article within an article is); these roles always are.
KEPT = frozenset("html body article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


def blocks(page: str | None) -> tuple[list[tuple[str, tuple[int, ...], int]], list[str]]:
    """Text blocks as (text, enclosing holders, linked characters), and each holder's path."""
    out: list[tuple[str, tuple[int, ...], int]] = []
    paths: list[str] = []
    stack: list[tuple[str, int, str, bool]] = []  # tag, holder number, path, skipped
    words: list[str] = []
    links = [0]
    in_link = 0
    titled = False  # a title is text though it is a link
    page = page or ""

    def flush() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text and not (stack and stack[-1][3]):
                out.append((text, tuple(s[1] for s in stack), min(links[0], len(text))))
            words.clear()
        links[0] = 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at and not (stack and stack[-1][3]):
            words.append(page[at:start])
            if in_link and not titled:
                links[0] += start - at
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in BLOCKS or tag in SKIPPED:
                flush()
                titled = False
            if tag in HOLDERS and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in BLOCKS or tag in SKIPPED:
            flush()
            in_link = 0
            titled = tag == "h1"
        elif tag == "br":
            words.append(" ")
        elif tag == "a":
            in_link = 1
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag not in HOLDERS:
            continue
        while stack and ((tag == stack[-1][0] and tag in ("li", "td", "th", "tr", "dd", "dt")) or (tag == "tr" and stack[-1][0] in ("td", "th")) or (tag in ("td", "th") and stack[-1][0] in ("td", "th"))):
            stack.pop()
        attrs = {a[1].lower(): next((x for x in a.groups()[1:] if x), "") for a in ATTR.finditer(m[3])} if m[3].strip() else {}
        within = any(s[0] == "article" for s in stack)
        # an article's own header holds its title
        skipped = bool(stack and stack[-1][3]) or (tag in SKIPPED and not (tag == "header" and within))
        if not skipped and (tag not in KEPT or (tag == "article" and within)):
            named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            skipped = bool(named.strip() and NAMES.search(named)) or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()
        cls = ".".join(sorted(re.sub(r"\d+", "#", attrs.get("class", "")).lower().split())[:3])
        step = f"{tag}.{cls}" if cls else tag
        path = f"{stack[-1][2]}>{step}" if stack else step
        paths.append(path)
        stack.append((tag, len(paths) - 1, path, skipped))
    flush()
    return out, paths


def unlinked(found: list[tuple[str, tuple[int, ...], int]]) -> int:
    return sum(max(0, len(text) - 2 * links) for text, _, links in found)


def best(found: list[tuple[str, tuple[int, ...], int]], paths: list[str]) -> tuple[str, int] | None:
    """The deepest holder of all unlinked text: its path and that text's length."""
    held: dict[int, int] = {}
    for text, chain, links in found:
        own = max(0, len(text) - 2 * links)
        for node in chain:
            held[node] = held.get(node, 0) + own
    total = unlinked(found)
    fits = [(len(paths[i].split(">")), -i) for i, v in held.items() if v == total > 0]
    if not fits:
        return None
    i = -max(fits)[1]
    return paths[i], held[i]


def text_of(page: str | None, path: str | None) -> str:
    """The page's blocks under the path if all unlinked text is there, else under its own best container, else all."""
    found, paths = blocks(page)
    if not found:
        return ""
    inside = {i for i, p in enumerate(paths) if p == path}
    taken = [block for block in found if inside.intersection(block[1])] if inside else []
    if not taken or unlinked(taken) < unlinked(found):
        own = best(found, paths)
        inside = {i for i, p in enumerate(paths) if own and p == own[0]}
        taken = [block for block in found if not own or inside.intersection(block[1])]
    return "\n".join(text for text, _, _ in taken)


def host(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def votes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, n, held: the votes of all pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[tuple[str, str], list[int]] = {}
            for h, page in (row for part in slices(batch, 1) for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                if got := best(*blocks(page)):
                    one = tally.setdefault((h, got[0]), [0, 0])
                    one[0] += 1
                    one[1] += got[1]
            rows = [(h, p, n, v) for (h, p), (n, v) in tally.items()]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["host", "path", "n", "held"])

    cast = pages.select(host(url).alias("host"), html).mapInArrow(run, "host string, path string, n bigint, held bigint")
    return cast.groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def winners(cast: DataFrame) -> DataFrame:
    """host, path: most votes, then most text, then the first path."""
    order = F.struct(F.col("n"), F.col("held"), F.col("path"))
    return cast.groupBy("host").agg(F.max(order).alias("w")).select("host", F.col("w.path").alias("path"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, path (the host's winner), text."""
    won = written(winners(votes(pages, url, html)), "winners")
    size = won.agg(F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 32), F.lit(0))).first()[0]
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host(url).alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2)):
            text = [text_of(h, p) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(text, pa.string())], names=["page_id", "url", "path", "text"])

    kind = pages.schema[page_id].dataType.simpleString()
    # winners of measured size are sent to the pages; beyond it pages meet them by a join that splits large hosts
    return rows.join(F.broadcast(won) if size <= SENT else won, "host", "left").select("page_id", "url", "html", "path").mapInArrow(run, f"page_id {kind}, url string, path string, text string")
