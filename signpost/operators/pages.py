"""Pages to nodes, and page-level lookups over the node array.

``parse_pages`` is the only Python step. It turns each page into one row: the normalised page text
and the array of its elements in document order. An element's text is a range of the page's pieces
of text, so nested elements repeat no text and reading an element costs as much as its text is long. Everything else works on that row inside the JVM without a shuffle,
or explodes it into a node table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from signpost import schemas as S
from signpost.functions.text import clean_text, digest, let, remove_prefix
from signpost.operators.page_reader import batch_reader

def parse_pages(
    pages: DataFrame,
    keep: Sequence[str],
    html: str = "html",
    base: Column | str | None = "url",
    raw_text: bool = False,
) -> DataFrame:
    """One row per page: the ``keep`` columns, ``text``, ``text_pieces``, ``raw_pieces``, ``nodes``,
    ``parse_error``, ``html_bytes``.

    Links are resolved against ``base``. ``raw_text`` fills ``raw_pieces``, the unseparated text, needed only where
    labels are read without a space between nested strings. Filter pages before calling: nothing is
    pushed through the Python step.
    """
    inputs = [F.col(k) for k in keep] + [F.col(html).alias("_html")]
    if base is not None:
        inputs.append((F.col(base) if isinstance(base, str) else base).alias("_base"))
    inputs.append(F.octet_length(F.coalesce(F.col(html), F.lit(""))).alias("_bytes"))
    source = pages.select(*inputs)
    result = StructType(source.schema.fields[: len(keep)] + S.PARSED.fields)
    run = batch_reader(len(keep), base is not None, raw_text, result)
    return source.mapInArrow(run, result)


# -- lookups inside a page row -------------------------------------------------------------

Test = Callable[[Column], Column]


def tagged(*tags: str) -> Test:
    return lambda n: n["tag"].isin(*tags) if len(tags) > 1 else n["tag"] == tags[0]


def with_id(value: str) -> Test:
    return lambda n: n["id"] == value


def with_role(value: str) -> Test:
    return lambda n: n["role"] == value


def with_class(*names: str) -> Test:
    def test(n: Column) -> Column:
        hit = F.lit(False)
        for name in names:
            hit = hit | F.array_contains(n["classes"], name)
        return F.coalesce(hit, F.lit(False))
    return test


def any_of(*tests: Test) -> Test:
    def test(n: Column) -> Column:
        hit = F.lit(False)
        for t in tests:
            hit = hit | F.coalesce(t(n), F.lit(False))
        return hit
    return test


def select(test: Test, inside: Column | None = None) -> Column:
    """Nodes passing the test, in document order; ``inside`` limits to a node's descendants.

    ``inside`` must be a lambda variable (see ``let``), otherwise it is evaluated per node.
    """
    nodes = F.col("nodes")
    if inside is None:
        return F.filter(nodes, lambda n: test(n))
    # Descendants are a slice of the array, so only they are looked at.
    below = F.slice(nodes, inside["seq"] + 2, inside["end_seq"] - inside["seq"])
    return F.filter(below, lambda n: test(n))


def first(test: Test, inside: Column | None = None) -> Column:
    return F.get(select(test, inside), F.lit(0))


def first_root(*priority: Test) -> Column:
    """The first node of the first test that any node passes."""
    return F.coalesce(*[first(t) for t in priority])


def roots(*priority: Test) -> Column:
    """The first node of each test that has one, in priority order."""
    return F.filter(F.array(*[first(t) for t in priority]), lambda n: n.isNotNull())


def text_of(node: Column) -> Column:
    """Normalised text of a node; null for a missing node."""
    return F.array_join(F.slice(F.col("text_pieces"), node["piece_from"] + 1, node["pieces"]), " ")


def raw_text_of(node: Column) -> Column:
    """Text of a node without separators between nested strings, whitespace collapsed."""
    return clean_text(F.array_join(F.slice(F.col("raw_pieces"), node["raw_from"] + 1, node["raw_pieces"]), ""))


def text_or_blank(node: Column) -> Column:
    return let(node, lambda n: F.coalesce(text_of(n), F.lit("")))


# -- fixed values: where pages keep their main content and update date -------------------------
NAVIGATOR_ROOT = (with_id("main"), tagged("main"), with_role("main"), tagged("body"))
GUIDANCE_ROOT = (with_id("main"), tagged("main"))
USEFUL_ROOTS = (with_class("region-content"), with_id("main"), tagged("main"), tagged("body"))
SAMPLE_ROOTS = (
    with_class("region-content"), with_id("main"), tagged("main"), with_role("main"), tagged("body"),
)
NAVIGATOR_UPDATED = any_of(with_class("dateMiseAJour", "field--name-field-date-updated"), tagged("time"))
GUIDANCE_UPDATED = with_class("dateMiseAJour")
UPDATED_PREFIX = "Last update:"


def page_title(root: Column, use_title_tag: bool) -> Column:
    """h1 inside the root, else any h1, else (optionally) the title element, else ``''``."""
    inner = let(root, lambda r: F.when(r.isNotNull(), first(tagged("h1"), r)))
    options = [inner, first(tagged("h1"))]
    if use_title_tag:
        options.append(first(tagged("title")))
    return text_or_blank(F.coalesce(*options))


def last_updated(test: Test, drop_prefix: bool) -> Column:
    found = text_or_blank(first(test))
    return F.trim(remove_prefix(found, UPDATED_PREFIX)) if drop_prefix else found


def content_hash(root: Column) -> Column:
    """Hash of the root's text; a page without a root hashes the empty text."""
    return digest(text_or_blank(root))


def with_page_facts(
    parsed: DataFrame,
    root: Sequence[Test] = NAVIGATOR_ROOT,
    updated: Test = NAVIGATOR_UPDATED,
    drop_prefix: bool = False,
    use_title_tag: bool = True,
) -> DataFrame:
    """Add ``root`` (node), ``page_title``, ``source_last_updated`` and ``content_hash``."""
    chosen = F.col("root")
    return parsed.withColumn("root", first_root(*root)).withColumns({
        "page_title": page_title(chosen, use_title_tag),
        "source_last_updated": last_updated(updated, drop_prefix),
        "content_hash": content_hash(chosen),
    })


def node_table(parsed: DataFrame, keep: Sequence[str], test: Test | None = None) -> DataFrame:
    """One row per element with its text; the test is applied before rows are made."""
    nodes = F.col("nodes") if test is None else select(test)
    told = F.transform(nodes, lambda n: F.struct(n.alias("n"), text_of(n).alias("node_text")))
    return parsed.select(*keep, F.inline(told)).select(*keep, "n.*", "node_text")
