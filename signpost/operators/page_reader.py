"""Per-page element reader that runs inside Spark's Python workers.

The module is pickled by value, so workers need nothing of this package installed.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# -- fixed values: elements without an end tag, and elements whose strings are not page text --
VOID_TAGS = frozenset((
    "area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image",
    "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source",
    "spacer", "track", "wbr",
))
NON_TEXT_TAGS = frozenset(("script", "style", "template", "rt", "rp"))

# Output rows are handed back once this many characters of pages are pending.
FLUSH_CHARS = 1_000_000


class _NodeReader(HTMLParser):
    """Collects one page's elements. Tag rules: void tags close themselves, an end tag closes up to
    the nearest open element of its name, other end tags are ignored, the page end closes the rest."""

    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=False)
        self.base = base
        self.nodes: list[list] = []
        self.open: list[int] = []
        self.open_names: dict[str, int] = {}
        self.hidden = 0
        self.buffer: list[str] = []
        self.pieces: list[str] = []
        self.piece_from: list[int] = []
        self.text_len = 0
        self.raw: list[str] = []

    def end_string(self) -> None:
        if self.buffer:
            string = "".join(self.buffer)
            self.buffer.clear()
            if not self.hidden:
                self.raw.append(string)
                piece = " ".join(string.split())
                if piece:
                    start = self.text_len + 1 if self.pieces else 0
                    self.pieces.append(piece)
                    self.piece_from.append(start)
                    self.text_len = start + len(piece)

    def resolve(self, href: str) -> str | None:
        if not self.base:
            return href
        try:
            return urljoin(self.base, href)
        except ValueError:
            return None

    def push(self, tag: str, attrs) -> None:
        self.end_string()
        ident = classes = role = href = target = None
        for name, value in attrs:
            if name == "href":
                href = value or ""
            elif name == "class":
                classes = (value or "").split()
            elif name == "id":
                ident = value or ""
            elif name == "role":
                role = value or ""
        if tag == "a" and href is not None:
            target = self.resolve(href)
        seq = len(self.nodes)
        parent = self.open[-1] if self.open else -1
        self.nodes.append(
            [seq, parent, tag, ident, classes, role, href, target, len(self.pieces), 0, len(self.raw), 0]
        )
        self.open.append(seq)
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        self.hidden += tag in NON_TEXT_TAGS

    def pop(self) -> str:
        node = self.nodes[self.open.pop()]
        node[0] = len(self.nodes) - 1
        node[9] = len(self.pieces)
        node[11] = len(self.raw)
        tag = node[2]
        self.open_names[tag] -= 1
        self.hidden -= tag in NON_TEXT_TAGS
        return tag

    def handle_starttag(self, tag, attrs):
        self.push(tag, attrs)
        if tag in VOID_TAGS:
            self.pop()

    def handle_startendtag(self, tag, attrs):
        self.push(tag, attrs)
        self.pop()

    def handle_endtag(self, tag):
        self.end_string()
        if self.open_names.get(tag):
            while self.pop() != tag:
                pass

    def handle_data(self, data):
        self.buffer.append(data)

    def handle_entityref(self, name):
        self.buffer.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        digits = (name[1:] if name[:1] in "xX" else name).lstrip("0") or "0"
        # No character has a number of more digits; longer ones would only cost time to read.
        code = int(digits, 16 if name[:1] in "xX" else 10) if len(digits) <= 8 else 1 << 32
        try:
            char = bytes([code]).decode("cp1252") if code < 256 else chr(code)
        except (UnicodeDecodeError, ValueError, OverflowError):
            char = chr(code) if code < 256 else "�"
        self.buffer.append("�" if "\ud800" <= char <= "\udfff" else char)

    def handle_comment(self, data):
        self.end_string()

    handle_decl = handle_pi = handle_comment

    def unknown_decl(self, data):
        self.end_string()
        if data.upper().startswith("CDATA["):
            self.buffer.append(data[6:])
            self.end_string()

    def finish(self) -> None:
        self.end_string()
        while self.open:
            self.pop()


def _read_page(html: str | None, base: str | None):
    reader = _NodeReader(base)
    error = None
    try:
        reader.feed(html or "")
        reader.close()
    except (AssertionError, ValueError) as problem:  # markup the tokenizer refuses: what came before it stays
        error = f"unreadable markup: {problem}"
    reader.finish()
    return reader, error


def batch_reader(carry: int, has_base: bool, keep_raw: bool, result) -> Callable:
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(result)
        node_type = target.field("nodes").type.value_type

        def emit(kept, readers):
            columns: list[list] = [[] for _ in node_type]
            offsets = [0]
            for reader, _ in readers:
                starts = reader.piece_from
                for seq, node in enumerate(reader.nodes):
                    end_seq, parent, tag, ident, classes, role, href, absolute, p0, p1, r0, r1 = node
                    length = starts[p1 - 1] + len(reader.pieces[p1 - 1]) - starts[p0] if p1 > p0 else 0
                    for column, value in zip(columns, (
                        seq, end_seq, parent, tag, ident, classes, role, href, absolute,
                        p0, p1 - p0, length, r0, r1 - r0,
                    )):
                        column.append(value)
                offsets.append(offsets[-1] + len(reader.nodes))
            structs = pa.StructArray.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(columns, node_type)], fields=list(node_type)
            )
            parsed = [
                pa.array([" ".join(r.pieces) for r, _ in readers], pa.string()),
                pa.array([r.pieces for r, _ in readers], target.field("text_pieces").type),
                pa.array([r.raw if keep_raw else None for r, _ in readers], target.field("raw_pieces").type),
                pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()), structs, type=target.field("nodes").type
                ),
                pa.array([e for _, e in readers], pa.string()),
            ]
            arrays = [kept.column(i) for i in range(carry)] + parsed
            sizes = kept.column(kept.num_columns - 1)
            # Carried columns keep the types they came with (time zone, string width).
            schema = pa.schema([*list(kept.schema)[:carry], *list(target)[carry:]])
            return pa.RecordBatch.from_arrays([*arrays, sizes], schema=schema)

        for batch in batches:
            html = batch.column(carry)
            bases = batch.column(carry + 1) if has_base else None
            start, pending, readers = 0, 0, []
            for i in range(batch.num_rows):
                markup = html[i].as_py()
                readers.append(_read_page(markup, bases[i].as_py() if bases is not None else None))
                pending += len(markup or "")
                if pending >= FLUSH_CHARS:
                    yield emit(batch.slice(start, i + 1 - start), readers)
                    start, pending, readers = i + 1, 0, []
            if readers:
                yield emit(batch.slice(start), readers)

    return run
