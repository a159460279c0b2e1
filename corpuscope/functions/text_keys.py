"""Keys under which variant spellings of a term meet."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation dropped from keys: all of it but the backslash and the hyphen,
#: which becomes a space first.
PUNCTUATION = "!\"#$%&'()*+,./:;<=>?@[]^_`{|}~-"

# Letters without a canonical decomposition, and their base letters.
SPECIAL_LETTERS = {
    "Ð": "D",
    "Đ": "D",
    "đ": "d",
    "ð": "d",
    "Ħ": "H",
    "ħ": "h",
    "ı": "i",
    "ſ": "i",
    "ĸ": "k",
    "Ŀ": "L",
    "Ł": "L",
    "ł": "l",
    "ŀ": "l",
    "Ŋ": "n",
    "ŋ": "n",
    "ŉ": "n",
    "Ø": "O",
    "ø": "o",
    "Ŧ": "T",
    "ŧ": "t",
}


def _accent_table() -> tuple[str, str]:
    """Accented letters of Latin-1 and Latin Extended-A with their base letters."""
    source, target = [], []
    for code in range(0xC0, 0x180):
        letter = chr(code)
        base = SPECIAL_LETTERS.get(letter) or unicodedata.normalize("NFD", letter)[0]
        if base != letter and base.isascii():
            source.append(letter)
            target.append(base)
    return "".join(source), "".join(target)


ACCENTED, PLAIN = _accent_table()


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_accents(c: Column | str) -> Column:
    """Replace accented Latin letters by their base letters."""
    return F.translate(_column(c), ACCENTED, PLAIN)


def _strip(c: Column | str) -> Column:
    return F.regexp_replace(_column(c), r"^\s+|\s+$", "")


def normalised(c: Column | str) -> Column:
    """Trimmed, lower case, hyphens as spaces, no ASCII punctuation, no accents."""
    spaced = F.replace(F.lower(_strip(c)), F.lit("-"), F.lit(" "))
    return remove_accents(F.translate(spaced, PUNCTUATION, ""))


def words(c: Column | str) -> Column:
    """Non-empty whitespace-separated tokens."""
    return F.filter(F.split(_column(c), r"\s+", -1), lambda w: w != "")


def fingerprint(c: Column | str) -> Column:
    """Sorted unique tokens of the normalised text."""
    return F.array_join(F.array_sort(F.array_distinct(words(normalised(c)))), " ")


def _letters(c: Column | str) -> Column:
    return F.regexp_replace(normalised(c), r"\s", "")


def one_gram(c: Column | str) -> Column:
    """Sorted unique characters of the normalised text without spaces."""
    chars = F.filter(F.split(_letters(c), ""), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(chars)), "")


def two_gram(c: Column | str) -> Column:
    """Sorted unique character pairs of the normalised text without spaces."""
    text = _letters(c)
    pairs = F.when(
        F.length(text) >= 2,
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1))),
            lambda i: F.substring(text, i, F.lit(2)),
        ),
    ).otherwise(F.filter(F.array(text), lambda x: F.lit(False)))
    key = F.array_join(F.array_sort(F.array_distinct(pairs)), "")
    return F.when(_column(c).isNotNull(), key)
