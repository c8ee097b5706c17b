"""The element reader against independent statements of the tree, without Spark."""

import xml.etree.ElementTree as ET

from hypothesis import given, settings
from hypothesis import strategies as st

from signpost.operators.page_reader import VOID_TAGS, _read_page

TAGS = ("div", "p", "b", "li", "a", "h2", "span")
WORDS = st.sampled_from(["alpha", " beta ", "\n", "x &amp; y", "é\u00a0è", "", "  "])


def tree(depth):
    inner = st.lists(tree(depth - 1), max_size=3) if depth else st.just([])
    return st.tuples(st.sampled_from(TAGS), WORDS, inner, WORDS)


def markup(node):
    tag, text, children, tail = node
    return f"<{tag}>{text}{''.join(map(markup, children))}</{tag}>{tail}"


def node_text(reader, node):
    return " ".join(reader.pieces[node[8]:node[9]])


@settings(max_examples=150, deadline=None)
@given(tree(3))
def test_well_formed_markup_equals_an_xml_parser(node):
    html = markup(node)
    root = ET.fromstring(f"<root>{html}</root>")
    reader, error = _read_page(html, None)
    elements = [e for e in root.iter() if e is not root]
    assert error is None and [n[2] for n in reader.nodes] == [e.tag for e in elements]
    for found, element in zip(reader.nodes, elements):
        assert node_text(reader, found) == " ".join(w for s in element.itertext() for w in s.split())
        assert found[0] - reader.nodes.index(found) == sum(1 for _ in element.iter()) - 1
        assert "".join(reader.raw[found[10]:found[11]]) == "".join(element.itertext())


TOKENS = st.sampled_from(
    [f"<{t}>" for t in TAGS] + [f"</{t}>" for t in TAGS]
    + ["<br>", "<br/>", "</br>", "text ", "&copy;", "<!-- c -->", "<script>var a='</p>'</script>", "<style>p</style>", "<", "&", "<a href='/x'>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(TOKENS, max_size=40))
def test_any_markup_gives_a_nested_tree(tokens):
    reader, _ = _read_page("".join(tokens), "https://a.ca/b")
    for seq, node in enumerate(reader.nodes):
        end_seq, parent = node[0], node[1]
        assert seq <= end_seq < len(reader.nodes)
        assert parent < seq and (parent < 0 or end_seq <= reader.nodes[parent][0])
        assert node[8] <= node[9] and node[10] <= node[11]
        if node[2] in VOID_TAGS:
            assert end_seq == seq and node[8] == node[9]
    assert all(p == " ".join(p.split()) and p for p in reader.pieces)
    assert not any("var a" in p for p in reader.pieces)


def test_void_end_tags_and_stray_end_tags_are_ignored():
    reader, _ = _read_page("<p>a<br></br>b</div><hr/>c</p></p>d", None)
    assert [(n[2], node_text(reader, n)) for n in reader.nodes] == [("p", "a b c"), ("br", ""), ("hr", "")]


def test_character_references():
    reader, _ = _read_page("<p>&#x41;&#66;&#150;&#x1F600;&#xD800;&nope;&eacute &lt;b&gt; &#0;x", None)
    assert reader.pieces[0].startswith("AB–😀\ufffd&nopeé <b>")


def test_bad_link_targets_do_not_stop_a_page():
    reader, error = _read_page("<a href='http://[bad'>x</a><a href>y</a><a>z</a>", "https://a.ca/b/")
    assert error is None and [n[7] for n in reader.nodes] == [None, "https://a.ca/b/", None]


def test_rows_are_handed_on_by_the_size_of_their_pages():
    """A batch of very many rows (as the session may ask for) is not held as parsed pages all at once."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    from signpost import schemas as S
    from signpost.operators.page_reader import batch_reader

    pages = [f"<p>{i} " + "word " * 2_000 + "</p>" for i in range(400)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(400), pa.int64()), pa.array(pages), pa.array([len(p) for p in pages], pa.int32())], names=["id", "_html", "_bytes"])
    run = batch_reader(1, False, False, StructType([*StructType().add("id", "long").fields, *S.PARSED.fields]))
    parts = list(run(iter([batch])))
    assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(400))
    assert max(sum(p.column(p.num_columns - 1).to_pylist()) for p in parts) < 1_100_000
