"""Text analysis for lexical search: fold, lower-case, split into word tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.clean import as_column

# Words of letters, marks, digits and '_', kept together across an inner . ' or ’
# (close to Unicode word segmentation: "don't" and "1.5" stay whole).
TOKEN_PATTERN = "[\\p{L}\\p{M}\\p{N}_]+(?:[.'’][\\p{L}\\p{M}\\p{N}_]+)*"

# Letters whose ASCII form has two characters or no decomposition.
LIGATURES = {"ß": "ss", "æ": "ae", "œ": "oe", "þ": "th"}
STROKES = {"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ı": "i", "ħ": "h"}


def fold_table() -> tuple[str, str]:
    """(from, to) strings for ``translate``: accented Latin letters to plain ones.

    Built by rule: the canonical decomposition of every letter in the Latin-1
    and Latin Extended ranges whose base is a single ASCII letter.
    """
    pairs = dict(STROKES)
    for code in range(0x00C0, 0x0250):
        letter = chr(code)
        base = unicodedata.normalize("NFKD", letter)[0]
        if letter.lower() == letter and base != letter and base.isascii() and base.isalpha():
            pairs[letter] = base
    source = "".join(sorted(pairs))
    return source, "".join(pairs[ch] for ch in source)


FOLD_FROM, FOLD_TO = fold_table()


def fold(c: Column | str) -> Column:
    """Lower-case and strip accents."""
    out = F.translate(F.lower(as_column(c)), FOLD_FROM, FOLD_TO)
    for letter, ascii_form in LIGATURES.items():
        out = F.replace(out, F.lit(letter), F.lit(ascii_form))
    return out


def tokens(c: Column | str) -> Column:
    """The analysed tokens of a text, in order; NULL text gives NULL."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN_PATTERN), F.lit(0))


def matches_any(field: Column | str, query: str) -> Column:
    """True where the analysed field holds at least one token of the query text.

    The query side is constant, so it is analysed once at planning time.
    """
    return F.coalesce(F.arrays_overlap(tokens(field), tokens(F.lit(query))), F.lit(False))
