"""Text expressions shared by the rules: trimming, folding, counting, number tokens."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.boxes import let

#: Scripts whose marks count as removable accents: Latin, Greek and Cyrillic.
LAST_FOLDED_BASE = 0x0510


def strip(text: Column) -> Column:
    """Trim every Unicode space and line break, not only blanks."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def none_if_blank(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def compact(text: Column) -> Column:
    """Lower case without any white space."""
    return F.lower(F.regexp_replace(text, r"[\s\p{Z}]+", ""))


def visible_length(text: Column) -> Column:
    return cluster_length(F.regexp_replace(text, r"[\s\p{Z}]+", ""))


def cluster_length(text: Column) -> Column:
    """Number of grapheme clusters, what a reader counts as characters: a letter with its marks, a joined emoji, a line break.

    Printable ASCII, where every code point is a cluster, is measured without the pattern.
    """
    return F.when(text.rlike(r"[^\x20-\x7E]"), F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0)))).otherwise(F.length(text))


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str]:
    """Accented letter -> bare letter, from the Unicode decompositions."""
    marked, bare = [], []
    for code in [*range(0xC0, LAST_FOLDED_BASE), *range(0x1E00, 0x2000)]:
        letter = chr(code)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) > 1 and ord(parts[0]) < LAST_FOLDED_BASE and unicodedata.combining(parts[1]):
            if letter == letter.lower():
                marked.append(letter)
                bare.append(parts[0])
    return "".join(marked), "".join(bare)


def fold(text: Column) -> Column:
    """Key for comparisons that ignore case and accents."""
    marked, bare = _accent_table()
    return F.regexp_replace(F.translate(F.lower(text), marked, bare), r"[̀-ͯ]", "")


def number_tokens(text: Column) -> Column:
    """Numbers in reading order, with inner ``.`` and ``,`` kept."""
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+(?:[.,]\p{Nd}+)*"), F.lit(0))


def characters(text: Column) -> Column:
    """Array of single characters."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def multiset_overlap(left: Column, right: Column) -> Column:
    """Shared characters, counted with repeats, over the shorter length."""

    def share(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]

        def both(letter: Column) -> Column:
            in_a = F.length(a) - F.length(F.replace(a, letter, F.lit("")))
            in_b = F.length(b) - F.length(F.replace(b, letter, F.lit("")))
            return F.least(in_a, in_b)

        counts = F.transform(F.array_intersect(characters(a), characters(b)), both)
        total = F.aggregate(counts, F.lit(0), lambda n, c: n + c)
        return total / F.greatest(F.least(F.length(a), F.length(b)), F.lit(1))

    return let(F.struct(left.alias("a"), right.alias("b")), share)
