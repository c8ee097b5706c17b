"""The character set of bytes that name none: UTF-8 by its validity, code pages by what letters stand beside each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signpost.functions.text import let

#: Code pages looked at for bytes that state none, the likeliest first.
CODE_PAGES = ("cp1252", "cp1250", "cp1251", "cp1253")

#: Names that markup states, and the code pages they are read in, as browsers do.
STATED = {
    "cp1252": ("iso-8859-1", "latin1", "latin-1", "windows-1252", "cp1252", "us-ascii", "ascii"),
    "cp1250": ("windows-1250", "cp1250"),
    "iso8859-2": ("iso-8859-2", "latin2"),
    "cp1251": ("windows-1251", "cp1251"),
    "cp1253": ("windows-1253", "cp1253"),
    "cp1254": ("iso-8859-9", "latin5", "windows-1254", "cp1254"),
    "cp1257": ("windows-1257", "cp1257"),
    "iso8859-15": ("iso-8859-15",),
    "koi8-r": ("koi8-r",),
}

# What writing seldom holds: letters of two scripts side by side, a capital after a small letter, a sign beside
# a letter, accented Latin letters in a row, and places that a code page leaves empty.
_UNLIKELY = (
    r"\p{IsLatin}(?=[\p{IsCyrillic}\p{IsGreek}])|[\p{IsCyrillic}\p{IsGreek}](?=\p{IsLatin})|\p{Ll}(?=\p{Lu})"
    r"|\p{L}(?=[\p{S}\p{No}&&[^\x00-\x7F]])|[\p{S}\p{No}&&[^\x00-\x7F]](?=\p{L})|\p{L}(?=[¡¿]\p{L})|[\p{IsLatin}&&[^\x00-\x7F]](?=[\p{IsLatin}&&[^\x00-\x7F]])|[�\x80-\x9F]")

# Letters of other scripts stand in words of their own, of more letters than accented ones have in a row.
_OTHER_SCRIPT = r"[\p{IsCyrillic}\p{IsGreek}]"
_OTHER_PAGES = ("cp1251", "cp1253")
_SHORT_WORD = 3


def unlikely(text: Column, page: str) -> Column:
    """How much of a text read by a code page writing seldom holds; letters of another script in short runs all count."""
    seldom = F.regexp_count(text, F.lit(_UNLIKELY))
    if page not in _OTHER_PAGES:
        return seldom
    runs = F.regexp_count(text, F.lit(_OTHER_SCRIPT + "+"))
    return seldom + let(F.regexp_count(text, F.lit(_OTHER_SCRIPT)), lambda n: F.when(n < _SHORT_WORD * runs, n).otherwise(0))


def in_code_page(latin: Column, name: str) -> Column:
    """Text of a code page whose bytes were read as ISO-8859-1; bytes it does not use become U+FFFD."""
    high = bytes(range(0x80, 0x100))
    # Every byte is decoded by itself, so one character answers to each.
    return F.translate(latin, high.decode("latin-1"), "".join(bytes([b]).decode(name, "replace") for b in high))


def guessed(content: Column, pages: Sequence[str] = CODE_PAGES) -> Column:
    """Text of bytes that state no character set.

    UTF-8 where the well-formed characters beyond ASCII outnumber the malformed bytes, which become U+FFFD
    (so a page cut within a character stays UTF-8), or there are none of these. Else the one of
    ``pages`` whose reading is the least :func:`unlikely` over the whole text, the first of equals. Null stays null.
    """
    def chosen(utf8: Column) -> Column:
        malformed = F.regexp_count(utf8, F.lit("�"))
        beyond = F.regexp_count(utf8, F.lit(r"[^\x00-\x7F�]"))
        return F.when(F.is_valid_utf8(content.cast("string")) | (malformed < beyond), utf8).otherwise(
            let(F.decode(content, "ISO-8859-1"), likeliest))

    def reading(latin: Column, name: str, nth: int) -> Column:
        return let(in_code_page(latin, name), lambda t: F.struct(
            unlikely(t, name).alias("unlikely"), F.lit(nth).alias("nth"), t.alias("text")))

    def likeliest(latin: Column) -> Column:
        return F.array_min(F.array(*[reading(latin, name, i) for i, name in enumerate(pages)]))["text"]

    return let(F.make_valid_utf8(content.cast("string")), chosen)
