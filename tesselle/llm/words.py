"""Words as the contracts define them: maximal runs of bytes other than ASCII white space."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = str.maketrans(_UPPER, _UPPER.lower())
#: ASCII white space other than the blank becomes a blank, so that str.split(" ") finds words.
_BLANKS = str.maketrans({c: " " for c in "\t\n\v\f\r"})


_SPACE = re.compile(r"[\x20\x09-\x0D]")
#: Characters of a text that are handled at once.
PIECE = 1 << 18


def pieces(text: str, most: int = PIECE) -> Iterator[str]:
    """A whole text in runs of about ``most`` characters, cut behind white space only, so that no word is split."""
    at = 0
    while len(text) - at > most:
        m = _SPACE.search(text, at + most)
        if m is None:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:] if at else text


def split_words(text: str | None) -> list[str]:
    """Words of a text; Unicode spaces belong to words, as in WORD."""
    if not text:
        return []
    return [w for w in text.translate(_BLANKS).split(" ") if w] if not text.isascii() else _split_ascii(text)


def _split_ascii(text: str) -> list[str]:
    # str.split() also cuts at the separators 0x1C-0x1F, which WORD counts as parts of words.
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in text.translate(_BLANKS).split(" ") if w]
    return text.split()


def word_count(text: Column) -> Column:
    """Number of words of a text column, null: 0; evaluated in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
