"""Text expressions (built-in functions only)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from siteindex.constants import BLANKS, LINE_BREAKS


def _char_class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


_BREAK = _char_class(LINE_BREAKS)
_CASED = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"


def strip(text: Column) -> Column:
    """Remove every kind of Unicode blank at both ends (``trim`` only knows spaces)."""
    return F.trim(text, F.lit(BLANKS))


def squeeze(text: Column) -> Column:
    """One-line form of a text.

    Line breaks and runs with two spaces become one space; a lone tab or space
    inside a line stays as it is.
    """
    parts = F.transform(F.split(text, f"{_BREAK}|  "), strip)
    return F.array_join(F.filter(parts, lambda part: part != ""), " ")


def title_case(text: Column) -> Column:
    """Upper-case the first and lower-case the other letters of every letter run."""
    runs = F.regexp_extract_all(text, F.lit(f"({_CASED}+|(?:(?!{_CASED}).)+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def cut_at(text: Column, separators) -> Column:
    """Keep what stands before each separator, one separator after the other."""
    for separator in separators:
        text = strip(F.substring_index(text, separator, 1))
    return text


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, not at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_where(items: Column, test) -> Column:
    """First array item that passes a test; NULL if none does."""
    return F.get(F.filter(items, test), F.lit(0))


def contains_any(text: Column, words) -> Column:
    """True if a text holds one of a fixed list of words."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


def contains_any_of(text: Column, words: Column) -> Column:
    """The same for an array column of words; false for no words."""
    return F.coalesce(F.exists(words, lambda word: F.contains(text, word)), F.lit(False))
