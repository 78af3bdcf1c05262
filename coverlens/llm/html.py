"""Main text of web pages: markup tells blocks apart, and comparing a page with its nearest neighbour finds templates.

Pages of a host are sorted by URL path; a page's partner is the neighbour whose path has most of its beginning in
common and whose text is not nearly its own, as that of an alias or a copy is. The two pages' text lines are aligned by
a longest common subsequence, and the lines they share are deleted.
Lines within an ``article`` or ``main`` element are the author's own word for the main text and are not deleted, since
articles do repeat paragraphs of others.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from os.path import commonprefix

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from coverlens.llm.common import fresh, numbered, small_batches, without
from coverlens.llm.urls import host_of, path_of
from coverlens.session import stored

# Elements that begin a line of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
# Elements without main text.
DROPPED = frozenset(
    "aside button dialog fieldset footer form head header iframe input label menu nav noscript object option select svg template textarea title".split()
)
# Elements whose content is not markup.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
# Elements whose end tag may be missing: the next of their kind ends them. Any block ends a paragraph.
REPEATED = frozenset("dd dt li option td th tr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark what surrounds the main text. A page that has, or lacks, a sidebar is none itself.
MARKS = re.compile(
    r"(?:^|\s|(?<!\bhas)(?<!\bwith)(?<!\bno)(?<!\bwithout)[_-])"
    r"(ads?|adsbygoogle|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo|cookies?|consent|gdpr|notices?|menu|nav|navbar|"
    r"navigation|breadcrumbs?|sidebar|side|widget|header|masthead|footer|comments?|commentlist|disqus|replies|respond|share|social|related|"
    r"recommended|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|pagination|contentinfo|complementary|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
# Those that mark an ``article`` element: readers' comments are often articles of their own.
COMMENT = re.compile(r"(?:^|\s)(?:user-|reader-)?comments?(?:$|\s|[_-](?:body|item|wrapper)(?:$|\s))", re.IGNORECASE)
# Two pages are nearly equal if this share of their characters is in lines of both.
ALIKE = 0.9
# So many different pages of a host that are all nearly equal have a long template and little text, and are no copies.
TEMPLATE = 8
_SPACE = re.compile(r"\s+")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
# A quote opens a value only behind an equals sign; elsewhere, and if it is never closed, it is a character like others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<(" + "|".join(RAW) + r")\b[^>]*>.*?(?:</\1\s*>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*')?)*)(?:>|$)|<[!?][^>]*(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)


def _marked(attributes: str, name: str, article: bool) -> bool:
    """Whether class, id or role name surroundings. An article's own header holds its title."""
    values = ["".join(x) for x in _ATTRIBUTE.findall(attributes)]
    if name == "article":
        return any(COMMENT.search(x) for x in values)
    return any(not (article and found.group(1).lower() == "header") for x in values for found in MARKS.finditer(x))


def lines(page: str | None) -> list[tuple[str, bool]]:
    """The page's text lines in order, without what markup names as surroundings, and whether each is in an article."""
    out: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool]] = []  # element, dropped, article
    named: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    dropped = article = 0  # open elements of either kind

    def end_line():
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((text, article > 0))

    def close() -> str:
        nonlocal dropped, article
        element, *kinds = open_.pop()
        named[element] -= 1
        dropped, article = dropped - kinds[0], article - kinds[1]
        return element

    page, at = page or "", 0
    for token in _TOKEN.finditer(page):
        if token.start() > at and not dropped:
            parts.append(page[at : token.start()])
        at = token.end()
        raw, closing, name, attributes = token.groups()
        if raw or not name:
            continue
        name, within = name.lower(), article > 0
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCKS or name in DROPPED:
            end_line()
        if closing:
            while named[name] and close() != name:
                pass
        elif name not in VOID:
            if open_ and (open_[-1][0] == name in REPEATED or (open_[-1][0] == "p" and name in BLOCKS)):
                close()
            marked = name in DROPPED and not (name == "header" and within)
            if attributes and name not in ("html", "body", "main") and not marked:
                marked = _marked(attributes, name, within)
            # Within a marked inline element, others of its name are counted too, so that its own end tag ends it.
            if name in BLOCKS or name in DROPPED or marked or named[name]:
                open_.append((name, marked, name in ("article", "main")))
                named[name] += 1
                dropped, article = dropped + marked, article + open_[-1][2]
    if at < len(page) and not dropped:
        parts.append(page[at:])
    end_line()
    return out


def main_lines(page: str | None) -> list[tuple[str, bool]]:
    """The lines of the articles if the page marks any, else all lines."""
    found = lines(page)
    marked = [x for x in found if x[1]]
    return marked or found


def shared(a: list, b: list) -> list[int]:
    """Places in ``a`` that a longest common subsequence of the two aligns with ``b``.

    Bit-parallel: one integer of len(b) bits per line of ``a``, so long pages cost len(a) * len(b) / 64 steps.
    """
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    state, states = full, [full]
    for x in a:
        u = state & masks.get(x, 0)
        state = ((state + u) | (state - u)) & full
        states.append(state)
    out, j = [], len(b)
    for i in range(len(a), 0, -1):
        # Cleared bits below j count the common lines of a[:i] and b[:j].
        low = (1 << j) - 1
        if j and (~states[i] & low).bit_count() > (~states[i - 1] & low).bit_count():
            while (~states[i] & ((1 << (j - 1)) - 1)).bit_count() == (~states[i] & ((1 << j) - 1)).bit_count():
                j -= 1
            out.append(i - 1)
            j -= 1
    return out[::-1]


def _hashed(batches):
    for batch in batches:
        found = [main_lines(x) for x in batch.column("html").to_pylist()]
        hashes = [[xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _ in x] for x in found]
        lengths = [[len(t) for t, _ in x] for x in found]
        loose = [any(not inside for _, inside in x) for x in found]
        columns = [batch.column(n) for n in ("key", "host", "path")]
        own = [pa.array(hashes, pa.list_(pa.int64())), pa.array(lengths, pa.list_(pa.int32())), pa.array(loose, pa.bool_())]
        yield pa.RecordBatch.from_arrays([*columns, *own], ["key", "host", "path", "lines", "lengths", "loose"])


def _partner(pages: list[dict], i: int) -> list | None:
    """The lines of the nearest page that is not nearly equal; of the least equal one, if many are. Nearly equal pages
    alone do not tell a template from copies of the text: None."""

    def near(j: int) -> int:
        """Characters that two paths begin with in common; -1 if there is no other page."""
        other = 0 <= j < len(pages) and pages[j]["host"] == pages[i]["host"]
        return len(commonprefix([pages[i]["path"], pages[j]["path"]])) if other else -1

    def sums(page: dict) -> tuple[Counter, int]:
        if "counted" not in page:
            page["counted"] = Counter(zip(page["lines"], page["lengths"])), sum(page["lengths"])
        return page["counted"]

    own, size = sums(pages[i])
    low, high, before, after, alike = i - 1, i + 1, near(i - 1), near(i + 1), []
    while max(before, after) >= 0 and len(alike) < TEMPLATE:
        if after > before:
            j, high, after = high, high + 1, near(high + 1)
        else:
            j, low, before = low, low - 1, near(low - 1)
        other, its_size = sums(pages[j])
        common = sum(min(n, other[x]) * x[1] for x, n in own.items() if x in other)
        if 2 * common < ALIKE * (size + its_size):
            return pages[j]["lines"]
        alike.append((common / max(its_size, 1), len(alike), j))
    return pages[min(alike)[2]]["lines"] if len(alike) == TEMPLATE else None


def _compared(table: pa.Table) -> pa.Table:
    pages = table.sort_by("position").to_pylist()
    groups, places = [], []
    for i, page in enumerate(pages):
        if page["home"] == page["block"] and page["loose"]:
            partner = _partner(pages, i)
            groups.append(page["group"])
            places.append(shared(page["lines"], partner) if partner else [])
    return pa.table([pa.array(groups, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["group", "shared"])


def differences(pages: DataFrame, block: int = 4096) -> DataFrame:
    """Per distinct page (key, from url and html) with lines outside articles: the places of lines it shares with its partner.

    Only line hashes are sorted and compared. Pages of a host with equal lines are one page and have one result. Sorted
    pages are cut into blocks of ``block``, each with its neighbours' edges, so a large host is spread over many tasks.
    """
    light = pages.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    light = light.mapInArrow(_hashed, "key long, host string, path string, lines array<long>, lengths array<int>, loose boolean")
    light = stored(light.withColumn("group", F.xxhash64("host", "loose", "lines")), "page-lines")
    first = [F.first(c).alias(c) for c in ("host", "lines", "lengths", "loose")]
    placed = numbered(light.groupBy("group").agg(F.min("path").alias("path"), *first), F.col("host"), F.col("path"), F.col("group"))
    home = F.floor(F.col("position") / block)
    near = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in range(-TEMPLATE, TEMPLATE + 1)]), lambda d: F.floor((F.col("position") + d) / block)))
    spread = placed.withColumns({"home": home, "block": F.explode(near)})
    found = spread.groupBy("block").applyInArrow(_compared, "group long, shared array<int>").where("size(shared) > 0")
    members = light.where("loose").select("key", "group").distinct()
    return members.join(stored(found, "shared-places"), "group").select("key", "shared")


def extracted(pages: DataFrame, out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` (url, html) plus the main text as ``out``: its lines joined by a newline.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments go by element or by
    class, id and role. If a page marks articles, their lines are the text; else the lines that it shares with the
    nearest page of its host are deleted too, aliases and copies of it left aside. White space within a line is one blank, character references are decoded. A null or
    empty html gives an empty text. Equal rows get equal texts. A null url is a host and path of empty name. An input
    column named as ``out`` is replaced.
    """
    pages = without(pages, out) if out.lower() not in ("url", "html") else pages
    pages = small_batches(pages)
    key, gone, found_key = fresh(pages, "key", "gone", "found_key")
    keyed = pages.withColumn(key, F.xxhash64("url", "html"))
    found = differences(keyed.select(F.col(key).alias("key"), "url", "html")).where("size(shared) > 0")
    found = stored(found.select(F.col("key").alias(found_key), F.col("shared").alias(gone)), "shared-lines")
    joined = keyed.join(found, F.col(key) == F.col(found_key), "left").drop(found_key, key)
    schema = StructType([*[f for f in joined.schema.fields if f.name != gone], StructField(out, StringType())])

    def texts(batches):
        for batch in batches:
            places = batch.schema.get_field_index(gone)
            result = []
            for page, drop in zip(batch.column(batch.schema.get_field_index("html")).to_pylist(), batch.column(places).to_pylist()):
                drop = set(drop or ())
                result.append("\n".join(t for i, (t, inside) in enumerate(main_lines(page)) if inside or i not in drop))
            kept = [c for i, c in enumerate(batch.columns) if i != places]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(result, pa.string())], names=schema.names)

    return joined.mapInArrow(texts, schema)
