"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: a node is a path of element names
with their classes, and it carries what the host's distinct pages show there. A
node that looks and reads the same on every page tells nothing, one that differs
does: the importance of a node is the normalised entropy of its presentations
(sequences of children) and of its own texts over those pages, where pages that show
the same main text count once: copies do not look like a template. The importance of
a branch is the largest of any node in it: a branch goes only if all of it is low.
Branches under ``LOW`` are removed from every page. The entropy is relative to that of
as many different pages, so what is asked follows the page count: on up to seven pages
only what is alike on all is low, on more pages some may differ; one page tells nothing.
An element above an ``article`` or ``main`` region on any page of the host never goes.
Elements that say themselves what they are (navigation, footers, forms, hidden parts) go on any host.
Class names and ids are a prior only: a name made of noise words alone (adverts, comments, sharing, ...) takes an element away, but never one
that is or holds a main region. An ``article`` or ``main`` region, where a
page has one, holds the main text: low branches below it go, the region itself stays,
and where nothing would be left of it, it stays whole.

Only aggregated (host, path) rows are shuffled; the few low branches per host come
back to the pages by a join on the host, which Spark broadcasts when their file is
small and otherwise sorts and splits, so a host with a third of all pages is safe.

Rows: null html is empty; a page without text gives "" and 0. A null or malformed
URL has the host "". Repeated rows are extracted once each and counted once in the
tree. Ties cannot arise: a branch is judged by its own figures alone. Unclosed,
cut or badly nested markup is read as browsers do in the common cases. Columns of
the input are kept; ``text``, ``n_chars`` and ``pruned`` replace columns so named.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knownby.llm.catalog import query
from knownby.llm.tables import table, text_column
from knownby.session import materialize

LOW = 0.2

BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NOISE = frozenset("""aside button canvas datalist dialog footer form head iframe label math menu nav noembed noframes noscript object
optgroup option output script select style svg template textarea title""".split())
NOISE_WORDS = frozenset("""ad ads advert adverts advertisement advertising alert alerts banner breadcrumb breadcrumbs byline comment comments
cookie cookies consent disqus footer form header login masthead menu menus meta modal nav navbar navigation newsletter notice notices notification
pager pagination popup promo promotion related replies reply respond search share sharing sidebar sidebars signup social sponsor sponsored
sponsors subscribe subscription tagcloud toolbar widget widgets""".split())
#: Words that say where or what part something is: a class name of noise words and these is noise, one with any other word ("share-price") is not.
PLAIN_WORDS = frozenset("""area bar block bottom box button buttons center col column container content group global holder icon icons inner item items js left
link links list lower main module outer page panel primary region right row secondary section site slot sub top unit upper wrap wrapper""".split())
#: The only words that tell a reader's contribution from the main text of an article element.
READER_WORDS = frozenset("comment comments disqus related replies reply respond".split())
NOISE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Starting one of these ends an open element of the named kinds, up to the nearest container.
ENDS = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
        "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
        "option": (frozenset(["option"]), frozenset(["select"]))}

TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


#: Longer labels and attributes are not kept in caches, which are then bounded in bytes.
CACHED = 160


@functools.lru_cache(maxsize=100_000)
def _child_id(parent: int, label: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{parent}/{label}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def child_id(parent: int, label: str) -> int:
    """A stable 64-bit name of the node ``label`` under a node of the style tree."""
    return _child_id(parent, label) if len(label) <= CACHED else _child_id.__wrapped__(parent, label)


def says(names: str, words: frozenset[str]) -> bool:
    """Is one of the names made of these words, with plain words and numbers beside them at most?"""
    for name in names.split():
        parts = [p for p in re.split(r"[^a-z0-9]+", name) if p and not p.isdigit()]
        if any(p in words for p in parts) and all(p in words or p in NOISE_WORDS or p in PLAIN_WORDS for p in parts):
            return True
    return False


def _traits(name: str, raw: str) -> tuple[str, bool, bool, bool, bool]:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(raw)} if raw.strip(" /\n\t\r") else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".lower()
    role = found.get("role", "").lower()
    noise = (name in NOISE or role in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true"
             or "display:none" in found.get("style", "").replace(" ", "").lower())
    main = (name in ("article", "main") or role in ("main", "article")) and not noise
    named = name not in ("html", "body") and says(names, READER_WORDS if main else NOISE_WORDS)
    classes = " ".join(sorted(found.get("class", "").split()))
    return (f"{name}.{classes}" if classes else name), noise, named, name == "header", main and not named


_cached_traits = functools.lru_cache(maxsize=50_000)(_traits)


def traits(name: str, raw: str) -> tuple[str, bool, bool, bool, bool]:
    """Label in the style tree; is it noise by what it is, by its class or id, noise outside of the main region only, a main region."""
    return _cached_traits(name, raw) if len(raw) <= CACHED else _traits(name, raw)


@functools.cache
def raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>]|$)", re.I)


def walk(html: str, pruned: frozenset[int], nodes: dict[int, list] | None = None) -> list[tuple[str, bool]]:
    """Visible blocks in page order, each with whether it lies in the main region. nodes: gathers each path's children, own texts, whether some of them is kept, and whether it is a main region."""
    spared: set[int] = set()
    blocks = _walk(html, pruned, nodes, spared)
    if spared:  # class names took away what holds a main region: not those
        if nodes is not None:
            nodes.clear()
        blocks = _walk(html, pruned, nodes, spared)
    return blocks


def _walk(html: str, pruned: frozenset[int], nodes: dict[int, list] | None, spared: set[int]) -> list[tuple[str, bool]]:
    """One pass. spared: the places of elements that class names do not remove; places found to hold a main region are added."""
    blocks: list[tuple[str, bool]] = []
    pending: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, path, removed, main
    depths: dict[str, list[int]] = {}  # of the open elements of each name
    taken: list[tuple[int, int]] = []  # depth and place of open elements removed for their class names

    def last(names: Iterable[str]) -> int:
        """Depth of the innermost open element of these names, 0 for none."""
        return max((depths[n][-1] for n in names if depths.get(n)), default=0)

    def flush() -> None:
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            if not stack[-1][2]:
                blocks.append((text, stack[-1][3]))

    def say(text: str) -> None:
        if nodes is not None or not stack[-1][2]:
            text = unescape(text) if "&" in text else text
            pending.append(text)
            if nodes is not None and text and not text.isspace():
                node = nodes.setdefault(stack[-1][1], [[], [], False, False])
                node[1].append(" ".join(text.split()))
                node[2] = node[2] or not stack[-1][2]

    def close(depth: int) -> None:
        while len(stack) > depth:
            name = stack[-1][0]
            if name in BLOCKS or stack[-1][2] != stack[-2][2]:
                flush()
            depths[name].pop()
            stack.pop()
        while taken and taken[-1][0] >= depth:
            taken.pop()

    at, search = 0, TOKEN.search
    while True:
        found = search(html, at)
        if found is None:
            say(html[at:])
            break
        place = found.start()
        if place > at:
            say(html[at:place])
        at = found.end()
        slash, name, raw = found.groups()
        if name is None:
            continue
        name = name.lower()
        if slash:
            if depths.get(name):
                close(depths[name][-1])
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
            if name in ENDS:
                own, limits = ENDS[name]
                limit = last(limits)
                above = [d[bisect.bisect_right(d, limit)] for n in own if (d := depths.get(n)) and d[-1] > limit]
                if above:
                    close(min(above))
            elif depths.get("p") and depths["p"][-1] > last(("td", "th", "button")):
                close(depths["p"][-1])
        elif name == "br":
            say(" ")
        label, noise, named, header, main = traits(name, raw)
        _, parent, removed, inside = stack[-1]
        path = child_id(parent, label)
        if nodes is not None:
            nodes.setdefault(parent, [[], [], False, False])[0].append(label)
        if name in VOID:
            continue
        named = named and place not in spared
        if named:
            taken.append((len(stack), place))
        elif main and not noise and taken:
            spared.update(where for _, where in taken)
        gone = removed or noise or named or (header and not inside) or path in pruned
        if gone and not removed:
            flush()
        if nodes is not None and main and not gone:
            nodes.setdefault(path, [[], [], False, False])[3] = True
        depths.setdefault(name, []).append(len(stack))
        stack.append((name, path, gone, (inside or main) and not gone))
        if name in RAW:
            end = raw_end(name).search(html, at)
            at = end.start() if end else len(html)
    close(1)
    flush()
    return blocks


def main_text(blocks: list[tuple[str, bool]]) -> list[str]:
    """Blocks of the main region if the page has one with text, else all."""
    return [text for text, inside in blocks if inside] or [text for text, _ in blocks]


def extract(html: str, pruned: frozenset[int] = frozenset()) -> str:
    """The main text without the pruned branches; a main region of nothing but such branches stays whole."""
    blocks = walk(html, pruned)
    if pruned and not any(inside for _, inside in blocks):
        whole = walk(html, frozenset())
        if any(inside for _, inside in whole):
            blocks = whole
    return "\n\n".join(main_text(blocks))


def host_of(url: str | Column) -> Column:
    """The host of a URL, the only reading of it here: lower-cased, "" where there is none."""
    address = F.col(url) if isinstance(url, str) else url
    return F.coalesce(F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def digest(parts: Iterable[str]) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def page_nodes(html: str) -> list[tuple[int, int, bool, bool, int, int, int]]:
    """Path, parent, has text to keep, is or holds a main region, presentation and content of each node of one page, and the page's main text."""
    nodes: dict[int, list] = {}
    parents: dict[int, int] = {}
    shown = digest(main_text(walk(html, frozenset(), nodes)))
    for path, (labels, *_) in list(nodes.items()):
        for label in dict.fromkeys(labels):
            below = child_id(path, label)
            parents[below] = path
            nodes.setdefault(below, [[], [], False, False])
    holds: set[int] = set()
    for path, (*_, main) in nodes.items():
        while main and path and path not in holds:
            holds.add(path)
            path = parents.get(path, 0)
    return [(path, parents.get(path, 0), kept, path in holds, digest(labels), digest(texts), shown) for path, (labels, texts, kept, _) in nodes.items() if path]


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path, parent, has_text, holds_main, pages, and the entropies of presentations and contents over the host's distinct main texts."""
    schema = "host string, path long, parent long, has_text boolean, holds_main boolean, style long, content long, page long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for site, source in zip(batch.column(0).to_pylist(), text_column(batch, "html").to_pylist()):
                rows.extend((site, *node) for node in page_nodes(source))
            columns = zip(*rows) if rows else [[]] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["host", "path", "parent", "has_text", "holds_main", "style", "content", "page"])

    seen = pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(run, schema).distinct()

    def entropy(kind: str) -> DataFrame:
        traits_of = [F.first("parent").alias("parent"), F.max("has_text").alias("has_text"), F.max("holds_main").alias("holds_main")]
        counts = seen.groupBy("host", "path", kind).agg(F.count("*").alias("n"), *traits_of)
        total = F.sum("n")
        # -sum(n/m log(n/m)) / log(m) = 1 - sum(n log n) / (m log m)
        importance = F.when(total > 1, 1 - F.try_divide(F.sum(F.col("n") * F.log("n")), total * F.log(total))).otherwise(1.0)
        return counts.groupBy("host", "path").agg(*traits_of, total.alias("pages"), importance.alias(f"{kind}_importance"))

    return entropy("style").join(entropy("content").select("host", "path", "content_importance"), ["host", "path"])


def low_branches(tree: DataFrame, low: float = LOW) -> DataFrame:
    """host and the array of the topmost paths of its low-importance branches with text.

    The largest importance is carried up the tree by doubling: after k rounds a node
    knows all nodes less than 2**k levels below it, so a tree of any depth takes the
    logarithm of its depth in rounds.
    """
    own = F.greatest("style_importance", "content_importance")
    state = materialize(tree.select("host", "path", "parent", "holds_main", F.nullif("parent", F.lit(0)).alias("above"), own.alias("importance"), "has_text"))
    while not (linked := state.where("above is not null")).isEmpty():
        below = linked.groupBy("host", F.col("above").alias("path")).agg(F.max("importance").alias("_importance"), F.max("has_text").alias("_has_text"))
        further = state.select("host", F.col("path").alias("above"), F.col("above").alias("_above"))
        state = materialize(state.join(below, ["host", "path"], "left").join(further, ["host", "above"], "left").select(
            "host", "path", "parent", "holds_main", F.col("_above").alias("above"), F.greatest("importance", "_importance").alias("importance"),
            (F.col("has_text") | F.coalesce("_has_text", F.lit(False))).alias("has_text")))
    judged = state.where((F.col("importance") < low) & ~F.col("holds_main"))
    # What lies below a removed branch goes with it.
    top = judged.join(judged.select("host", F.col("path").alias("parent")), ["host", "parent"], "left_anti")
    return top.where("has_text").groupBy("host").agg(F.collect_set("path").alias("pruned"))


def extract_pages(pages: DataFrame, url: str = "url", html: str = "html", low: float = LOW) -> DataFrame:
    """Add ``text`` and ``n_chars`` to every page."""
    branches = materialize(low_branches(style_tree(pages, url, html), low)).withColumnRenamed("host", "_host")
    given = pages.drop("text", "n_chars", "pruned")
    joined = given.withColumn("_host", host_of(url)).join(branches, "_host", "left").drop("_host")
    schema = T.StructType([f for f in joined.schema.fields if f.name != "pruned"] + [T.StructField("text", T.StringType())])
    keep = schema.names[:-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pruned = batch.column(batch.schema.get_field_index("pruned")).to_pylist()
            texts = [extract(source, frozenset(p or ())) for source, p in zip(text_column(batch, html).to_pylist(), pruned)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op1_site_style_tree")
def op1_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
