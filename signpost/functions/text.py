"""Text, hash and formatting expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Python's str.isspace() accepts; Java's \s alone covers only ASCII.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
UNIT_SEPARATOR = "\x1f"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    A lambda variable is the one binding the optimizer never inlines, so an expensive value used
    inside a per-element lambda is not recomputed for each element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def present(value: Column) -> Column:
    """The value as an array, empty when it is null.

    Exploding it keeps rows with a value and evaluates the value once; a filter on a computed column
    would evaluate it a second time below the projection.
    """
    return F.filter(F.array(value), lambda v: v.isNotNull())


def clean_text(value: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(_col(value), SPACE + "+", " "))


def strip(value: Column | str) -> Column:
    """Trim every kind of whitespace, inner runs untouched."""
    return F.regexp_replace(_col(value), rf"^{SPACE}+|{SPACE}+\z", "")


def blank(value: Column | str) -> Column:
    """Null becomes the empty string, the interchange form of a missing value."""
    return F.coalesce(_col(value), F.lit(""))


def is_missing(value: Column | str) -> Column:
    return blank(value) == ""


def or_else(value: Column | str, fallback: Column | str) -> Column:
    """``value`` unless it is empty."""
    return F.coalesce(F.nullif(_col(value), F.lit("")), _col(fallback))


def digest(*values: Column | str) -> Column:
    """SHA-256 hex of the values joined by the unit separator; null counts as empty."""
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *[blank(v) for v in values]), 256)


def short_id(*values: Column | str) -> Column:
    return F.substring(digest(*values), 1, 20)


def payload_hash(content: Column | str) -> Column:
    """Hash of a binary payload through its lower-case hex text."""
    return F.sha2(F.lower(F.hex(_col(content))), 256)


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    single, multi = {}, {}
    for code in range(0x80, 0x11000):
        ch = chr(code)
        if 0xD800 <= code <= 0xDFFF or len(ch.lower()) != 1 or ch.lower() != ch:
            continue
        folded = ch.casefold()
        if folded != ch:
            (single if len(folded) == 1 else multi)[ch] = folded
    return "".join(single), "".join(single.values()), multi


_FOLD_FROM, _FOLD_TO, _FOLD_MULTI = _fold_tables()


def _covering_ranges(letters: str, gap: int = 64) -> str:
    """Character class of a few ranges that cover the letters; long lists match slowly."""
    spans: list[list[int]] = []
    for code in sorted(map(ord, letters)):
        if spans and code - spans[-1][1] <= gap:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


_FOLD_SPECIAL = _covering_ranges(_FOLD_FROM + "".join(_FOLD_MULTI))
_FOLD_RARE = _covering_ranges("".join(ch for ch in _FOLD_MULTI if ch != "ß"))


def casefold(value: Column | str) -> Column:
    """Full case folding: lower case, then the letters whose folding differs from it, if there are any.

    One-to-one letters go through ``translate``, the common ß through ``replace``. Other letters that
    fold to several characters are rare, so they are only looked up in rows that hold one.
    """
    def expand(text: Column) -> Column:
        table = F.create_map(*[F.lit(x) for pair in _FOLD_MULTI.items() for x in pair])
        return F.array_join(
            F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
        )

    lowered = F.lower(_col(value))
    return F.when(
        lowered.rlike(_FOLD_SPECIAL),
        let(
            F.replace(F.translate(lowered, _FOLD_FROM, _FOLD_TO), F.lit("ß"), F.lit("ss")),
            lambda t: F.when(t.rlike(_FOLD_RARE), expand(t)).otherwise(t),
        ),
    ).otherwise(lowered)


def remove_prefix(value: Column | str, prefix: str | Column) -> Column:
    value = _col(value)
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.when(
        F.startswith(value, prefix), F.substr(value, F.length(prefix) + F.lit(1))
    ).otherwise(value)


def strip_trailing(value: Column | str, characters: str) -> Column:
    return F.rtrim(_col(value), F.lit(characters))


def truncate(value: Column | str, n: int) -> Column:
    return F.substring(_col(value), 1, n)


def length_between(value: Column | str, low: int, high: int) -> Column:
    return F.length(_col(value)).between(low, high)


def contains_any(value: Column, fragments: Iterable[str]) -> Column:
    """True when any fragment occurs in the value."""
    return F.exists(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(value, f))


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    result = F.lit(False)
    for prefix in prefixes:
        result = result | F.startswith(value, F.lit(prefix))
    return result


def media_type(content_type: Column | str) -> Column:
    return F.get(F.split(blank(content_type), ";"), F.lit(0))


def looks_like_html(content_type: Column | str, body: Column | str) -> Column:
    return F.contains(blank(content_type), F.lit("html")) | F.startswith(strip(blank(body)), F.lit("<"))


def non_html_summary(content_type: Column | str, n_bytes: Column | str) -> Column:
    return F.concat(
        F.lit("Downloaded non-HTML content with type "),
        or_else(content_type, F.lit("unknown")),
        F.lit(" and "),
        F.format_number(_col(n_bytes), 0),
        F.lit(" bytes."),
    )


def join_or(values: Column, fallback: Column | str) -> Column:
    """Array joined by `` | ``, or the fallback when it is empty or missing."""
    return F.when(
        F.coalesce(F.size(values), F.lit(0)) > 0, F.array_join(values, " | ")
    ).otherwise(_col(fallback))


def natural_key(prefix: str, value: Column | str) -> Column:
    return F.concat(F.lit(prefix), _col(value))


def iso_instant(value: Column | str) -> Column:
    """ISO-8601 UTC text with seconds precision (the session time zone is UTC)."""
    return F.date_format(_col(value), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def iso_date(value: Column | str) -> Column:
    return F.date_format(_col(value), "yyyy-MM-dd")


def fix_windows_1252(value: Column | str) -> Column:
    """Repair cp1252 text that was read as ISO-8859-1 (C1 controls stand for printable characters)."""
    source, target = [], []
    for code in range(0x80, 0xA0):
        try:
            target.append(bytes([code]).decode("cp1252"))
        except UnicodeDecodeError:
            continue
        source.append(chr(code))
    return F.translate(_col(value), "".join(source), "".join(target))
