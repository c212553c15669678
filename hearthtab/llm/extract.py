"""Main text of web pages by template deduction from equivalence classes.

Tokens are tags, told apart by their first class name and the path of tags they stand in. Over all pages of a host each token has an
occurrence vector: how often it stands on each page. Tokens with equal vectors form an
equivalence class; the vectors are compared by their support and a sum of hashes of page and
count, so that no vector is ever gathered. Classes are valid if they are supported by enough
pages and their tokens nest: each token's path leads through tokens of its own class or of one
with at least the same pages. Valid classes with one occurrence a page are the frame of the
template; the text between their tags are its slots. The slot that holds most text outside
links, counted over all pages of the host, lies in the main slot: the article around it, or the
element that also holds the headings and paragraphs beside it whose text differs between pages.

Blocks of text in the main slot are returned whole; navigation, notices and the like
inside it are left out by their tags and names.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthtab.llm.common import pick, staged

# Least pages and least share of a host's pages for a valid class, least tokens in it.
LEAST_PAGES = 3
LEAST_SHARE = 0.5
LEAST_TOKENS = 2

# Roles of HTML elements.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg annotation object select".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split()
)
_LEFT_OUT = frozenset(
    "aside button dialog fieldset footer form head header input label menu nav option search".split()
)
_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split()
)
# Words in a class or id that mark what is no article text.
_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disqus footer masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
# Parts of names that say where or how an element stands, not what it is.
_LAYOUT_PARTS = frozenset(
    "area article articles author bar block body bottom box button buttons c container content count custom "
    "entry fixed floating form global group heading icon icons inline inner item items js l left link links "
    "list m main media meta module o outer page panel post posts primary reader right row secondary section "
    "site slot sticky text title top u user wrap wrapper x".split()
)
# Parts before "header" that name a page's, not an article's.
_PAGE_PARTS = frozenset("global main site top".split())
# Names of all of a page.
_KEPT_NAMES = frozenset("page site main content post".split())
# Nested elements that paths tell apart.
DEEPEST = 64
# A start tag that ends an open element of the same group.
_ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
# Elements that are text of their own rather than containers of a layout.
_TEXT = _HEADINGS | frozenset(
    "address blockquote dl figure header hgroup li ol p pre section summary td th tr ul".split()
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_CLASS = re.compile(r"""\bclass\s*=\s*["']?\s*([^\s"'/>]+)""", re.I)
_NAME = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int  # characters of it in links
    left_out: bool


def _name_marks(value: str) -> bool:
    """Whether a class or id says that an element is no article text.

    A name counts if all its parts are listed words or plain parts of a layout: ``comment-list`` and
    ``site-footer``, but not ``no-comments``, ``has-sidebar`` or ``share-price``.
    """
    for name in value.split():
        parts = _NAME.findall(name)
        if parts and name not in _KEPT_NAMES:
            if not _NAMES.isdisjoint(parts) and all(p in _NAMES or p in _LAYOUT_PARTS for p in parts):
                return True
            if parts[-1] == "header" and all(p in _PAGE_PARTS for p in parts[:-1]):
                return True
    return False


def _marked(tag: str, attributes: str, in_article: bool) -> str:
    """``sure`` if an element is left out by its tag or role, ``likely`` if by its name or as a form.

    The header of an article holds its title and stays; that of a page goes.
    """
    if tag in _LEFT_OUT and not (tag == "header" and in_article):
        return "likely" if tag == "form" else "sure"
    found = ""
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return "sure"
        if name == "role" and value in _ROLES:
            return "likely" if value == "form" else "sure"
        if name in ("class", "id") and tag not in ("html", "body", "main") and _name_marks(value):
            # The title of an article may stand in an element named as header.
            if not (in_article and "header" in value and _NAMES.isdisjoint(_NAME.findall(value))):
                found = "likely"
    return found


class _Marks:
    """Elements that may be left out, each with the one around it; judged when the page has been read.

    What is only likely to be left out stays if it holds an article or main part, or, where the page has
    neither outside of it, most of the page's text.
    """

    def __init__(self) -> None:
        self._around: list[int] = []
        self._sure: list[bool] = []
        self._holds_article: list[bool] = []
        self._in_article: list[bool] = []
        self._articles_outside = False

    def add(self, around: int, sure: bool, in_article: bool) -> int:
        self._around.append(around)
        self._sure.append(sure)
        self._holds_article.append(False)
        self._in_article.append(in_article)
        return len(self._around) - 1

    def article(self, mark: int) -> None:
        """An article or main part begins inside ``mark`` (-1: outside of all)."""
        if mark < 0:
            self._articles_outside = True
        while mark >= 0 and not self._holds_article[mark]:
            self._holds_article[mark] = True
            mark = self._around[mark]

    def left_out(self, blocks: list[tuple[int, int]]) -> list[bool]:
        """Of each mark whether it is left out, from the (mark, size) of all blocks of text."""
        n = len(self._around)
        inside, total = [0] * n, 0
        for mark, size in blocks:
            total += size
            if mark >= 0:
                inside[mark] += size
        # Marks inside a mark come after it.
        sure = list(self._sure)
        for k in range(n):
            sure[k] = sure[k] or (self._around[k] >= 0 and sure[self._around[k]])
        total -= sum(inside[k] for k in range(n) if sure[k])
        for k in range(n - 1, -1, -1):
            if self._around[k] >= 0 and not sure[k]:
                inside[self._around[k]] += inside[k]
        out = []
        for k in range(n):
            most = 2 * inside[k] > total and not (self._articles_outside or self._in_article[k])
            own = self._sure[k] or not (self._holds_article[k] or most)
            out.append(own or (self._around[k] >= 0 and out[self._around[k]]))
        return out


def parse(page: str) -> tuple[list[Block], Counter]:
    """Blocks of text in page order, and the count of each start tag under its path.

    Unclosed and stray tags are mended as browsers do: a block closes an open paragraph and
    whatever is open in it; an end tag closes up to its element, if that is open. Paths name the outer
    ``DEEPEST`` elements; what lies deeper belongs to the last of them, so that time and memory follow the
    size of the page however deeply it is nested.
    """
    # Tag, mark, and path including the element.
    stack: list[tuple[str, int, tuple[str, ...]]] = []
    # Places in the stack of each open tag, and of all open blocks.
    places: dict[str, list[int]] = defaultdict(list)
    open_blocks: list[int] = []
    found_blocks: list[tuple[tuple[str, ...], str, int, int]] = []
    tags: Counter = Counter()
    marks = _Marks()
    held: list[str] = []
    linked = 0
    path: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            if text:
                found_blocks.append((path, text, linked, stack[-1][1] if stack else -1))
            held.clear()
        linked = 0

    def close(position: int) -> None:
        nonlocal path
        if open_blocks and open_blocks[-1] >= position:
            flush()
        while len(stack) > position:
            tag = stack.pop()[0]
            places[tag].pop()
            if tag in _BLOCK:
                open_blocks.pop()
        path = stack[-1][2] if stack else ()

    def opened(tag: str) -> int:
        return places[tag][-1] if places[tag] else -1

    end = 0
    length = len(page)
    while end < length:
        start = page.find("<", end)
        if start < 0:
            start = length
        if start > end:
            text = page[end:start]
            held.append(text)
            if places["a"]:
                linked += len(text)
        if start >= length:
            break
        found = _TOKEN.match(page, start)
        if not found:
            held.append("<")
            end = start + 1
            continue
        end = found.end()
        tag = found[2] or found[5]
        if not tag:
            continue
        tag = tag.lower()
        attributes = found[3] or found[6] or ""
        if found[1] or found[4]:
            if tag in ("br", "p") and opened(tag) < 0:
                held.append(" ")
                continue
            k = opened(tag)
            if k >= 0:
                # An end tag of an inline element does not reach beyond its block.
                if tag not in _BLOCK and open_blocks and open_blocks[-1] >= k:
                    continue
                close(k)
            continue
        if tag in _RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.I).search(page, end)
            if attributes.rstrip().endswith("/") and tag == "svg":
                continue
            if not stop:
                end = length
            else:
                closing = page.find(">", stop.start())
                end = length if closing < 0 else closing + 1
            if tag in ("textarea", "select", "iframe", "object"):
                held.append(" ")
            continue
        if tag in _BLOCK:
            # A block ends an open paragraph or heading.
            for closer in ("p", *(_HEADINGS if tag in _HEADINGS else ())):
                k = opened(closer)
                if k >= 0:
                    close(k)
            for closer in _ENDED_BY.get(tag, ()):
                k = opened(closer)
                border = max(opened("ul"), opened("ol"), opened("dl"), opened("table"))
                if k > border:
                    close(k)
            flush()
            # Inline elements left open by unclosed blocks do not go on.
            if stack and stack[-1][0] not in _BLOCK:
                close(open_blocks[-1] + 1 if open_blocks else 0)
        elif tag == "br":
            held.append(" ")
        if tag in _VOID:
            continue
        mark = stack[-1][1] if stack else -1
        in_article = bool(places["article"] or places["main"])
        marked = _marked(tag, attributes, in_article)
        if marked:
            if mark < 0:
                flush()
            mark = marks.add(mark, marked == "sure", in_article)
        elif tag in ("article", "main"):
            marks.article(mark)
        if tag in _BLOCK:
            if len(path) < DEEPEST:
                named = _CLASS.search(attributes) if attributes else None
                path = (*path, f"{tag}.{named[1].lower()}" if named else tag)
                tags["/".join(path)] += 1
            open_blocks.append(len(stack))
        places[tag].append(len(stack))
        stack.append((tag, mark, path))
    flush()
    out = marks.left_out([(mark, len(text)) for _, text, _, mark in found_blocks])
    return [Block(p, text, n, mark >= 0 and out[mark]) for p, text, n, mark in found_blocks], tags


def main_text(page: str, *slots: str | None) -> str:
    """Text of the first slot that the page has; without one, of the article, else of the page's body."""
    blocks, tags = parse(page)
    kept = [b for b in blocks if not b.left_out]
    inside: list[Block] = []
    for prefix in (*slots, *_usual_slots(tags)):
        if prefix is not None:
            wanted = tuple(prefix.split("/")) if prefix else ()
            inside = [b for b in kept if b.path[: len(wanted)] == wanted]
            if inside or (prefix in slots and prefix in tags):
                break
    return "\n\n".join(b.text for b in inside)


def _usual_slots(tags: Counter) -> list[str]:
    """Articles or main parts by their tags, the outermost first; then the whole page."""
    paths = sorted(tags, key=lambda p: (p.count("/"), p))
    found = [p for name in ("article", "main") for p in paths if p.rpartition("/")[2].partition(".")[0] == name]
    return [*found, ""]


def layout_of(tags: Counter) -> str:
    """Name of a page's layout: the containers in the upper two levels of its body."""
    upper = set()
    for token in tags:
        labels = token.split("/")
        while labels and labels[0].partition(".")[0] in ("html", "body"):
            del labels[0]
        if 0 < len(labels) <= 2 and not any(label.partition(".")[0] in _TEXT for label in labels):
            upper.add("/".join(labels))
    return f"{xxhash.xxh64_intdigest(' '.join(sorted(upper))):016x}"


def host_of(url: Column) -> Column:
    """Host of an absolute URL, in lower case, without user and white space around; else empty."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[\s\u0085\u00a0]+|[\s\u0085\u00a0]+$", "")
    site = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_extract(site, r"([^@]*)$", 1))


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page and token: its count, the hashed entry of the vector, and size and hash of the text below it."""
    for batch in batches:
        rows = defaultdict(list)
        columns = (batch[c].to_pylist() for c in ("_id", "_url", "_html", "_host"))
        for page_id, url, page, host in zip(*columns, strict=True):
            if not page or not host:
                continue
            blocks, tags = parse(page)
            layout = layout_of(tags)
            mine = xxhash.xxh64_intdigest(f"{page_id}\0{url}")
            text, links, words = Counter(), Counter(), Counter()
            for b in blocks:
                if not b.left_out:
                    own = xxhash.xxh64_intdigest(b.text) >> 24
                    for k in range(1, len(b.path) + 1):
                        place = "/".join(b.path[:k])
                        text[place] += len(b.text)
                        links[place] += b.linked
                        words[place] += own
            for token, count in tags.items():
                rows["host"].append(host)
                rows["layout"].append(layout)
                rows["token"].append(token)
                rows["count"].append(count)
                entry = xxhash.xxh64_intdigest(count.to_bytes(8, "little"), mine) >> 24
                rows["entry"].append(entry)
                rows["plain"].append(text[token] - links[token])
                rows["words"].append(words[token])
        if rows:
            yield pa.RecordBatch.from_pydict(dict(rows))


def main_slot(frame: list[tuple[str, int, bool]]) -> str | None:
    """Main slot among (path, characters outside links, whether its text differs between pages).

    Starts at the innermost slot that holds nearly all text of the fullest one, which may lack a
    title, a lead or a last section beside it, and climbs to the article or main part around it; without
    one, to the outermost element below the body with such text beside the slot.
    """
    top = max((plain for _, plain, _ in frame), default=0)
    if top <= 0:
        return None
    inner = max((t for t, plain, _ in frame if plain >= 0.95 * top), key=lambda t: (t.count("/"), t))
    path = inner.split("/")
    if path[-1].partition(".")[0] in ("html", "body"):
        return None
    tags = [label.partition(".")[0] for label in path]
    for name in ("article", "main"):
        if name in tags:
            return "/".join(path[: tags.index(name) + 1])
    specific = [t.split("/") for t, _, differs in frame if differs]
    size = len(path)
    for n in range(len(path) - 1, 0, -1):
        if tags[n - 1] in ("html", "body"):
            break
        beside = [t[n:] for t in specific if t[:n] == path[:n] and t[: n + 1] != path[: n + 1] and len(t) > n]
        heading = any(t[-1].partition(".")[0] == "h1" for t in beside)
        if heading or tags[n] in _TEXT or any(len(t) == 1 and t[0].partition(".")[0] in _TEXT for t in beside):
            size = n
    return "/".join(path[:size])


def templates(pages: DataFrame, id_column="page_id", url_column="url", html_column="html") -> DataFrame:
    """Main slots: ``host``, ``layout``, ``slot``.

    A row with the empty layout is deduced from all pages of the host, the others from its pages of
    one layout; these are left out where they say the same. Hosts and layouts without a valid
    template have no row, nor have pages of unknown hosts.

    One row per page and token is summed by host and token before anything is shuffled, so the
    size of a host does not matter.
    """
    rows = pick(pages, _id=id_column, _url=url_column, _html=html_column)
    tokens = (
        rows.withColumn("_host", host_of(F.col("_url")))
        .mapInArrow(_token_rows, "host string, layout string, token string, count long, entry long, plain long, words long")
        .withColumn("layout", F.explode(F.array(F.lit(""), "layout")))
        .groupBy("host", "layout", "token")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.max("count").alias("most"),
            F.sum(F.col("entry").cast("decimal(20,0)")).alias("vector"),
            F.sum("plain").alias("plain"),
            (F.min("words") < F.max("words")).alias("differs"),
        )
    )
    tokens = staged(tokens, "tokens")
    size = staged(tokens.groupBy("host", "layout").agg(F.max("pages").alias("all_pages")), "hosts")
    # What stands on a large share of a host's pages is bounded by the tags of a page, whatever the
    # number of pages and of tags that stand on few of them.
    frequent = staged(
        tokens.where(F.col("pages") >= LEAST_PAGES)
        .join(size, ["host", "layout"])
        .where(F.col("pages") >= LEAST_SHARE * F.col("all_pages")),
        "frequent_tokens",
    )
    classes = (
        frequent.groupBy("host", "layout", "pages", "vector")
        .agg(F.count(F.lit(1)).alias("tokens"), F.collect_set("token").alias("members"))
        .where(F.col("tokens") >= LEAST_TOKENS)
    )
    # Nesting: the parent of every member stands in a valid class with as many pages or more.
    members = classes.select("host", "layout", "pages", "vector", F.explode("members").alias("token"))
    valid = members.withColumn("parent", F.regexp_extract("token", r"^(.*)/[^/]*$", 1))
    parents = members.select("host", "layout", F.col("token").alias("parent"), F.col("pages").alias("parent_pages"))
    nested = (
        valid.join(parents, ["host", "layout", "parent"], "left")
        .where((F.col("parent") == "") | (F.col("parent_pages") >= F.col("pages")))
        .select("host", "layout", "token")
    )
    frame = frequent.join(nested, ["host", "layout", "token"]).where("most = 1")
    # The frame of a host is bounded as the tags of a page are.
    listed = frame.groupBy("host", "layout").agg(F.collect_list(F.struct("token", "plain", "differs")).alias("frame"))
    slot = F.udf(lambda frame: main_slot([tuple(x) for x in frame]), "string")
    best = staged(listed.select("host", "layout", slot("frame").alias("slot")).where("slot IS NOT NULL"), "slots")
    whole = best.where("layout = ''")
    same = whole.select("host", "slot")
    return whole.unionByName(best.where("layout <> ''").join(same, ["host", "slot"], "left_anti").select(whole.columns))


def extract_text(
    pages: DataFrame, id_column="page_id", url_column="url", html_column="html"
) -> DataFrame:
    """Main text of every page: the page's identifier and url, ``text``, ``n_chars``.

    Blocks are joined by two line feeds. A null or empty page, or one of markup alone, gives an
    empty text. Pages of unknown or small hosts, and pages without their host's slot, fall back on
    the tags of the page itself. Repeated pages stay rows of their own; extra columns are not read; an
    empty table gives an empty result.
    """
    found = staged(templates(pages, id_column, url_column, html_column), "templates")
    rows = pick(pages, _id=id_column, _url=url_column, _html=html_column)
    page_layout = F.udf(lambda page: layout_of(parse(page)[1]) if page else "", "string")
    by_host = found.where("layout = ''").select(F.col("host").alias("_host"), F.col("slot").alias("_slot"))
    by_layout = found.where("layout <> ''").select(
        F.col("host").alias("_host"), F.col("layout").alias("_layout"), F.col("slot").alias("_layout_slot")
    )
    joined = rows.withColumn("_host", host_of(F.col("_url"))).join(by_host, "_host", "left")
    if by_layout.isEmpty():
        joined = joined.withColumn("_layout_slot", F.lit(None).cast("string"))
    else:
        joined = joined.withColumn("_layout", page_layout("_html")).join(by_layout, ["_host", "_layout"], "left")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                main_text(page.as_py(), slot.as_py(), other.as_py()) if page.as_py() else ""
                for page, slot, other in zip(batch["_html"], batch["_slot"], batch["_layout_slot"], strict=True)
            ]
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch["_id"], batch["_url"], pa.array(texts, pa.string()), pa.array(sizes)],
                names=["_id", "_url", "text", "n_chars"],
            )

    return (
        joined.select("_id", "_url", "_html", "_slot", "_layout_slot")
        .mapInArrow(run, f"_id {kind}, _url string, text string, n_chars long")
        .withColumnsRenamed({"_id": id_column, "_url": url_column})
    )
