"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

1. Each page folds into an expression of its own (``wrappers.fold``).  Pages of one template differ in their texts and in
   how often things repeat, so a host has few *different* expressions however many pages it has; they are counted with
   what their text slots held (characters, characters in links, whether the text was always the same).
2. The expressions of a host are aligned in rounds of about ``FAN`` at a time, until one wrapper is left that covers
   them all.  Only structure moves, no text, and no round holds more than about ``FAN`` expressions of a host in a group.
3. Every expression is aligned with its host's wrapper, which tells the slot of each of its texts; the slots' figures over
   all pages of the host decide which slots are main text.
4. Pages take their blocks of kept slots by (host, expression).  The table of expressions goes to every task only where
   Spark finds it small; else it is joined, and the adaptive skew join splits a host with very many pages.

Which slots are main text: those of ``article`` (else ``main``) outside of boilerplate, where boilerplate is told by
element and by words of class, id, role and item property; without such elements, those of the smallest element that
holds most of the host's text that is neither boilerplate, nor links, nor the same on all pages, and its main heading.

Defined results: null and empty html give an empty text; a page without address belongs to the host ``""``; repeated
rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from acrework.functions.storage import cut_lineage
from acrework.llm.common import documents, text_slices
from acrework.llm.html_tokens import Node, Page
from acrework.llm.wrappers import align, dump, fold, leaves, load

FAN = 16
#: Part of an element's text that a part of it must hold to stand for it.
MOST = 0.7
#: Pages on which a text must be the same, while they differ otherwise, to belong to the template.
SAME_ON = 4
#: Part of a slot's characters in links from which it is a list of links.
LINKS = 0.5
SLICE = 1_000_000
#: Expressions that a task counts at once.
HELD = 5_000

#: Elements that never hold the main text, and such that may, where a whole page is laid out inside of one.
BOILERPLATE_ELEMENTS = frozenset("aside button dialog footer head iframe menu nav object script select style svg template textarea".split())
BOILERPLATE_UNLESS_MOST = frozenset("form header noscript".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu "
    "modal nav navbar navigation newsletter notice notices pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Words that tell boilerplate also as a part of another word (``commentlist``, ``topnav``).
_PARTS = re.compile("comment|sidebar|footer|navbar|breadcrumb|cookie|newsletter|advert|sponsor|disqus|masthead|paginat|subscribe|nav$|menu$|ads$")
_TITLE_WORDS = frozenset(["header", "masthead", "banner"])
_WORDS = re.compile(r"[a-z]+")
_HEADINGS = frozenset(["h1", "h2", "h3"])


def host_of(url: str | None) -> str:
    """The authority of an address, in lower case; empty without one."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", url or "")
    return found[1].rpartition("@")[2].lower() if found else ""


def _folded(html: str | None) -> tuple[Page, list[Node], str, str]:
    page = Page(html or "")
    nodes = fold(page.root.kids)
    text = json.dumps(dump(nodes), separators=(",", ":"), ensure_ascii=False)
    return page, nodes, text, hashlib.md5(text.encode("utf-8", "replace")).hexdigest()


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


_FIGURES = "host string, expression string, nested string, slot int, pages long, chars long, linked long, least long, greatest long, page_least long, page_greatest long"


def _figure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host, expression and slot what its texts hold; slot -1 stands for the expression itself."""
    held: dict[tuple[str, str], tuple[str, list[list[int]]]] = {}

    def rows() -> pa.RecordBatch:
        flat = [(host, key, nested if slot < 0 else None, slot, *figures) for (host, key), (nested, per_slot) in held.items() for slot, figures in enumerate(per_slot, -1)]
        names = [part.split()[0] for part in _FIGURES.split(", ")]
        kinds = [pa.string()] * 3 + [pa.int32()] + [pa.int64()] * 7
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*flat) if flat else [()] * len(names), kinds)], names)

    for batch in text_slices(batches, "html", SLICE):
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page, nodes, nested, key = _folded(html)
            whole = _hash("\n".join(page.blocks))
            figures = [[1, 0, 0, whole, whole, whole, whole]]
            for leaf in leaves(nodes):
                text = _hash("\n".join(page.blocks[k] for k in leaf.blocks))
                figures.append([1, sum(len(page.blocks[k]) for k in leaf.blocks), sum(page.linked[k] for k in leaf.blocks), text, text, whole, whole])
            known = held.setdefault((host_of(url), key), (nested, figures))[1]
            if known is not figures:
                for own, new in zip(known, figures):
                    own[:3] = [x + y for x, y in zip(own[:3], new[:3])]
                    own[3:] = [min(own[3], new[3]), max(own[4], new[4]), min(own[5], new[5]), max(own[6], new[6])]
            if len(held) >= HELD:
                yield rows()
                held.clear()
    yield rows()


def _merged(nested: list[str]) -> str:
    """The wrapper that covers all these expressions."""
    out: list[Node] = []
    for k, text in enumerate(sorted(set(nested))):
        nodes = load(json.loads(text))[0]
        out = align(out, nodes) if k else nodes
    return json.dumps(dump(out), separators=(",", ":"), ensure_ascii=False)


def infer_wrappers(expressions: DataFrame) -> DataFrame:
    """host, wrapper: all expressions of each host (host, expression, nested) aligned, about ``FAN`` at a time."""
    most = expressions.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    rounds = 1
    while FAN**rounds < most:
        rounds += 1
    level = expressions.select("host", F.pmod(F.xxhash64("expression"), F.lit(FAN**rounds)).alias("place"), "nested")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": group["host"][:1], "place": group["place"][:1], "nested": [_merged(group["nested"].tolist())]})

    for k in range(rounds - 1, -1, -1):
        level = level.withColumn("place", F.col("place") % FAN**k).groupBy("host", "place").applyInPandas(merge, level.schema)
        level = cut_lineage(level, "wrappers")
    return level.select("host", F.col("nested").alias("wrapper"))


_SLOTS = StructType([StructField("host", StringType()), StructField("expression", StringType()), StructField("slots", ArrayType(IntegerType()))])


def slots_of(nested: str, wrapper: str) -> list[int]:
    """For each text of an expression its slot in the wrapper, or -1."""
    own, texts = load(json.loads(nested))
    for k, leaf in enumerate(texts):
        leaf.slot, leaf.blocks = None, [k]
    whole, _ = load(json.loads(wrapper))
    out = [-1] * len(texts)
    for leaf in leaves(align(whole, own)):
        for k in leaf.blocks:
            out[k] = -1 if leaf.slot is None else leaf.slot
    return out


def _slot_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"host": f["host"], "expression": f["expression"], "slots": [slots_of(n, w) for n, w in zip(f["nested"], f["wrapper"])]})


def _any(node: Node, test) -> bool:
    return test(node) or any(_any(kid, test) for kid in node.kids)


def _name(node: Node) -> str:
    return node.key.split(".")[0]


def _boilerplate(node: Node, inside: bool, most: frozenset[int]) -> bool:
    """By its element and words.  ``most`` names (by ``id``) the nodes that hold most of the host's text and its heading or
    article: words like ``has-sidebar`` tell nothing there.  A header inside an article that holds a heading is its title.
    """
    name, *words = node.key.split(".")
    said = {w for word in words for w in _WORDS.findall(word) if w in BOILERPLATE_WORDS or _PARTS.search(w)}
    if name in ("html", "body", "article", "main") and not inside:
        return bool({"comment", "comments"} & said)
    if name in BOILERPLATE_ELEMENTS:
        return True
    if name not in BOILERPLATE_UNLESS_MOST and not said:
        return False
    if inside and said <= _TITLE_WORDS and name not in ("form", "noscript") and any(_any(k, lambda n: _name(n) in _HEADINGS) for k in node.kids):
        return False
    return id(node) not in most


def _is(node: Node, name: str, word: str) -> bool:
    own, *words = node.key.split(".")
    return own == name or word in words


def main_slots(wrapper: str, figures: dict[int, tuple]) -> list[int]:
    """The slots of main text; figures: for each slot pages, chars, linked, whether its text never changed though pages did."""
    nodes, _ = load(json.loads(wrapper))
    most_pages = max((f[0] for f in figures.values()), default=0)
    every = sum(f[1] for f in figures.values())
    telling = lambda n: _name(n) == "h1" or _is(n, "article", "articlebody") or _is(n, "main", "main")
    most: set[int] = set()

    def measure(n: Node) -> int:
        size = figures[n.slot][1] if n.key == "#" and n.slot in figures else sum(map(measure, n.kids))
        if 2 * size >= every > 0 and any(_any(kid, telling) for kid in n.kids):
            most.add(id(n))
        return size

    for n in nodes:
        measure(n)
    boilerplate = lambda n, inside: _boilerplate(n, inside, most)

    def texts(among: list[Node], inside: bool) -> list[int]:
        out = []
        for n in among:
            if n.key == "#":
                out.append(n.slot)
            elif not boilerplate(n, inside):
                out += texts(n.kids, inside or _is(n, "article", "articlebody") or _is(n, "main", "main"))
        return out

    def named(among: list[Node], name: str, word: str) -> list[Node]:
        """The outermost such elements that are not in boilerplate."""
        out = []
        for n in among:
            if _is(n, name, word) and not boilerplate(n, False):
                out.append(n)
            elif n.key != "#" and not boilerplate(n, False):
                out += named(n.kids, name, word)
        return out

    for name, word in (("article", "articlebody"), ("main", "main")):
        chosen = [slot for n in named(nodes, name, word) for slot in texts(n.kids, True)]
        if sum(figures[s][1] for s in chosen if s in figures):
            return sorted(chosen)

    def weight(slot: int) -> int:
        if slot not in figures:
            return 0
        pages, chars, linked, same = figures[slot]
        template = same and pages >= SAME_ON and 2 * pages >= most_pages
        return 0 if template or linked >= LINKS * chars else chars - linked

    def titled(among: list[Node]) -> bool:
        """Whether a heading of the first rank with text of its own is among them."""
        return any(n.key != "#" and not boilerplate(n, False) and (sum(map(weight, texts(n.kids, False))) > 0 if _name(n) == "h1" else titled(n.kids)) for n in among)

    while True:
        own = texts(nodes, False)
        total = sum(map(weight, own))
        inner = [n.kids for n in nodes if n.key != "#" and not boilerplate(n, False) and sum(map(weight, texts(n.kids, False))) >= MOST * total > 0]
        if not inner or titled(nodes) and not titled(inner[0]):
            kept = [s for s in own if weight(s)]
            return sorted(kept or own)
        nodes = inner[0]


def _kept_rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        kept = [main_slots(w, {s["slot"]: (s["pages"], s["chars"], s["linked"], s["same"]) for s in (figures if figures is not None else [])}) for w, figures in zip(f["wrapper"], f["figures"])]
        yield pd.DataFrame({"host": f["host"], "kept": kept})


_BLOCKS = "host string, expression string, blocks array<string>, leaf array<int>"


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without html, with their blocks of text and the text of their expression each belongs to."""
    for batch in text_slices(batches, "html", SLICE):
        hosts, keys, blocks, owners = [], [], [], []
        for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page, nodes, _, key = _folded(html)
            owner = [0] * len(page.blocks)
            for k, leaf in enumerate(leaves(nodes)):
                for b in leaf.blocks:
                    owner[b] = k
            hosts.append(host_of(url))
            keys.append(key)
            blocks.append(page.blocks)
            owners.append(owner)
        names = [c for c in batch.schema.names if c != "html"]
        added = [pa.array(hosts, pa.string()), pa.array(keys, pa.string()), pa.array(blocks, pa.list_(pa.string())), pa.array(owners, pa.list_(pa.int32()))]
        yield pa.record_batch([*(batch.column(c) for c in names), *added], [*names, "host", "expression", "blocks", "leaf"])


def kept_texts(pages: DataFrame) -> DataFrame:
    """host, expression, kept: for each text of each different expression whether it is main text.

    Slots that no page's alignment reaches do not occur: every expression went into its host's wrapper.
    """
    source = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = source.mapInArrow(_figure_rows, _FIGURES)
    low, high = [F.min(c).alias(c) for c in ("least", "page_least")], [F.max(c).alias(c) for c in ("greatest", "page_greatest")]
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked")]
    figures = cut_lineage(rows.groupBy("host", "expression", "slot").agg(F.first("nested", ignorenulls=True).alias("nested"), *sums, *low, *high), "page-figures")
    expressions = figures.filter("slot = -1").select("host", "expression", "nested")
    wrappers = cut_lineage(infer_wrappers(expressions), "wrappers")
    slots = cut_lineage(expressions.join(wrappers, "host").mapInPandas(_slot_rows, _SLOTS), "page-slots")
    own = slots.select("host", "expression", F.posexplode("slots").alias("leaf", "place")).filter("place >= 0")
    texts = figures.filter("slot >= 0").withColumnRenamed("slot", "leaf").join(own, ["host", "expression", "leaf"])
    per_slot = texts.groupBy("host", F.col("place").alias("slot")).agg(*sums, *low, *high)
    same = (F.col("least") == F.col("greatest")) & (F.col("page_least") != F.col("page_greatest"))
    listed = per_slot.groupBy("host").agg(F.collect_list(F.struct("slot", "pages", "chars", "linked", same.alias("same"))).alias("figures"))  # as many as the wrapper has slots
    kept = wrappers.join(listed, "host", "left").mapInPandas(_kept_rows, "host string, kept array<int>")
    return slots.join(kept, "host").select("host", "expression", F.transform("slots", lambda s: F.array_contains("kept", s)).alias("kept"))


def extract_main_text(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns, text and n_chars of each page (columns url and html)."""
    kept = cut_lineage(kept_texts(pages), "kept-texts")
    columns = [F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)]
    source = pages.select(*columns, F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = StructType([*(f for f in source.schema.fields if f.name != "html"), *StructType.fromDDL(_BLOCKS).fields])
    parsed = source.mapInArrow(_block_rows, schema).join(kept, ["host", "expression"], "left")
    chosen = F.filter(F.arrays_zip("blocks", "leaf"), lambda b: F.coalesce(F.get("kept", b["leaf"]), F.lit(True)))
    text = parsed.withColumn("text", F.array_join(F.transform(chosen, lambda b: b["blocks"]), " "))
    return text.select(*(F.col(f"_keep{k}").alias(c) for k, c in enumerate(keep)), "text", F.char_length("text").cast("long").alias("n_chars"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of ``pages``."""
    return extract_main_text(documents(spark, sf_dir, "pages"))


#: In the given tables the main text is the one ``article`` of a page, with paragraphs and few character references.
OP13_SQL = r"""
SELECT page_id, url, text, length(text) AS n_chars FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(
    regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's'), '</?b>', '', 'g'), '<[^>]*>', ' ', 'g'),
    '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text
  FROM pages)
"""
