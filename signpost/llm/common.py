"""What several training-data operators share: shared tables, Arrow tasks, word hashes, components."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signpost.session import discard, written

__all__ = ["discard", "written"]

# Tasks get these functions by value, so workers need nothing of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], schema: str | object) -> DataFrame:
    """Apply a function of one Arrow batch, built once per task, and return its columns.

    The function may return None for a batch without rows to pass on.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            for columns in function(batch):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type)
                     for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels stay unseen: the CRC-32 of its id as text divides by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every linked node: the smallest node its links reach.

    Alternating large and small stars over the two long columns. Both are minima by key (summed
    before the shuffle) and a join of plain tables, whose hot keys the optimizer splits; each
    round is written to the shared folder. Nothing is gathered by component.
    """
    def oriented(df: DataFrame) -> DataFrame:
        return (df.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                .distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    edges = written(oriented(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))), "links")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(oriented(large), "large")
        lesser = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lesser, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        next_edges = written(oriented(small.unionByName(lesser.select("u", F.col("m").alias("v")))), "links")
        discard(edges, least, large, lesser)
        edges, after = next_edges, state(next_edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = after


# --- words and their hashes, over the bytes of a batch of texts ---

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done:done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of a counter-based generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[start:end]`` for every pair, from one running polynomial."""
    up, down = _powers(len(values), _ODD), _powers(len(values) + 1, _INVERSE)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


_SEGMENT = 1 << 18


def words_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, starts, ends, first)`` of the words of several texts laid end to end in ``data``.

    Text i has the bytes from ``bounds[i]`` to ``bounds[i + 1]`` and the words from ``first[i]`` to
    ``first[i + 1]``; starts and ends are places in ``data``. Hashes are made a segment at a time.
    """
    hashes, starts, ends = [], [], []
    low, high = int(bounds[0]), int(bounds[-1])
    cut = np.zeros(high - low + 1, bool)
    cut[bounds - low] = True
    while low < high:
        to = min(high, low + _SEGMENT)
        while to < high and not (_SPACE[data[to]] or cut[to - int(bounds[0])]):
            to += 1
        part = data[low:to]
        inside = ~_SPACE[part]
        new = cut[low - int(bounds[0]):to - int(bounds[0])]
        begins = inside & np.concatenate([[True], ~inside[:-1] | new[1:]])
        stops = inside & np.concatenate([~inside[1:] | new[1:], [True]])
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if len(s):
            hashes.append(block_hashes(_BYTE[part], s, e))
            starts.append(s + low)
            ends.append(e + low)
        low = to
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    starts = np.concatenate(starts)
    return np.concatenate(hashes), starts, np.concatenate(ends), np.searchsorted(starts, bounds)


def texts_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(row, data, bounds)`` of runs of rows of a text column, about a segment of bytes each; null is empty."""
    column = column.cast(pa.large_binary())
    column = column.fill_null(b"") if column.null_count else column
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + _SEGMENT, side="right")) - 1)
        yield row, data, offsets[row:end + 1]
        row = end


def sampled_words(hashes: np.ndarray, first: np.ndarray, gram: int, width: int) -> np.ndarray:
    """Indices of the words that begin a least n-gram of some ``width`` neighbouring n-grams of their text.

    Any ``width + gram - 1`` words that two texts share begin at least one such n-gram in both,
    at the same word.
    """
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    word = np.arange(len(hashes)) + int(first[0])
    own = word + gram <= first[1:][text]
    starts = word[own] - int(first[0])
    if not len(starts):
        return starts
    # A window of greatest values lies before and after each text, so no window sees two of them.
    place = starts + (text[own] + 1) * width
    values = np.full(int(place[-1]) + width + 1, ~np.uint64(0))
    values[place] = block_hashes(hashes, starts, starts + gram)
    return starts[window_minima(values, width)[place]]


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Which values are the least of some window of ``width`` neighbours (all of equal least ones)."""
    n = len(values)
    if n <= width:
        return values == values.min() if n else np.zeros(0, bool)

    def slide(x: np.ndarray, w: int, best) -> np.ndarray:
        done = 1
        while done < w:
            step = min(done, w - done)
            x = best(x[:len(x) - step], x[step:])
            done += step
        return x

    least = slide(values, width, np.minimum)
    pad = np.zeros(width - 1, values.dtype)
    return slide(np.concatenate([pad, least, pad]), width, np.maximum) == values


NO_ID = (1 << 63) - 1
# Rows with arrays of their own that a task holds before it hands them on.
FLUSH_ROWS = 1_000


def text_keys() -> tuple[Column, Column]:
    """A text's identity: its ``doc_id`` (rows without one come last) and a tag of its content.

    The tag is short where an id already tells most texts apart; what is read by it is verified.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    tag = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), tag.alias("tag")


def id_or_null(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def earlier_alike(begins: np.ndarray, of: np.ndarray, place: np.ndarray) -> pa.Array:
    """For each hash at a place of text ``of``: the last place before it in that text of the same hash, null where there is none."""
    order = np.lexsort((place, begins, of))
    again = (np.diff(begins[order]) == 0) & (np.diff(of[order]) == 0)
    earlier = np.full(len(place), -1)
    earlier[order[1:][again]] = place[order[:-1][again]]
    return pa.array(earlier, pa.int64(), mask=earlier < 0)


#: Words after a block, or before it, whose hashes tell how far two texts agree beyond it: as lengths of stretches.
AROUND = (4, 4, 8, 16)


def words_around(hashes: np.ndarray, at: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each block ``at:end`` of a text ``low:high``, 32 bits on the words after it and 32 on those before it.

    Each byte is of one stretch of :data:`AROUND`, the nearest first, so numbers that share leading bytes are of
    places that go on alike that far.
    """
    starts, stops = [], []
    after, before = ends, at
    for n in AROUND:
        starts.append(after)
        after = np.minimum(after + n, high)
        stops.append(after)
    for n in AROUND:
        stops.append(before)
        before = np.maximum(before - n, low)
        starts.append(before)
    parts = block_hashes(hashes, np.concatenate(starts), np.concatenate(stops)).reshape(2 * len(AROUND), len(at)) >> np.uint64(56)
    out = np.zeros(len(at), np.uint64)
    for part in parts:
        out = (out << np.uint64(8)) | part
    return out.view(np.int64)


def sampled_blocks(docs: DataFrame, gram: int, block: int, window: int, around: bool = False) -> DataFrame:
    """``(begins, doc, tag, at, earlier)``: words that :func:`sampled_words` picks, with a hash of the ``block`` words from there.

    ``earlier`` is the last place before ``at`` in the same text that begins alike, null where none does. With
    ``around``, a column of that name tells the words beside the block (:func:`words_around`).
    """
    def make():
        def run(batch: pa.RecordBatch):
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for row, data, bounds in texts_of(batch.column(2)):
                hashes, _, _, first = words_of(data, bounds)
                at = sampled_words(hashes, first, gram, window)
                of = np.searchsorted(first, at, side="right") - 1
                fits = at + block <= first[1:][of]
                at, of = at[fits], of[fits]
                if not len(at):
                    continue
                begins, place = block_hashes(hashes, at, at + block).view(np.int64), at - first[of]
                beside = [words_around(hashes, at, at + block, first[of] - first[0], first[1:][of] - first[0])] if around else []
                yield [begins, doc[row + of], tag[row + of], place, earlier_alike(begins, of, place), *beside]
        return run

    return map_arrow(docs.select(*text_keys(), F.col("text").cast("string").alias("text")), make,
                     "begins long, doc long, tag long, at long, earlier long" + (", around long" if around else ""))


def texts_with_spans(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """``(doc, tag, bytes, low, high)`` of rows ``doc, tag, text, spans``, one text at a time."""
    doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    spans = batch.column(3)
    ends = np.cumsum(spans.value_lengths().to_numpy())
    low, high = (f.to_numpy() for f in spans.flatten().flatten())
    for i, end in enumerate(ends.tolist()):
        begin = end - len(spans[i])
        yield int(doc[i]), int(tag[i]), np.frombuffer(batch.column(2)[i].as_py().encode(), np.uint8), low[begin:end], high[begin:end]


def in_parts(rows: Iterator[tuple]) -> Iterator[list]:
    """Rows as lists of columns, ``FLUSH_ROWS`` at a time."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == FLUSH_ROWS:
            yield list(zip(*held))
            held = []
    if held:
        yield list(zip(*held))
