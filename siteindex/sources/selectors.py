"""Selectors that a caller brings along, compiled to marks for one parser.

A selector is a comma-separated list of compounds (tag, ``*``, ``.class``, ``#id``, ``[attribute]``
with ``=``, ``~=``, ``^=``, ``$=``, ``*=`` or ``|=``) joined by descendant (blank) or child (``>``)
combinators. Every compound of a chain is a mark; one with a combinator also needs the mark of the
chain to its left on an enclosing element, or on the parent. So a selector is decided when an
element opens, from bits that are there already, and no element is compared with another.

Marks fill words of ``WORD`` bits after the word of the standard marks; masks are plain integers
over all words, so any number of selectors can be used.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

WORD = 62
_FULL = (1 << WORD) - 1
_NAME = r"[-\w]+"
_PIECE = re.compile(
    rf"""\s*(?P<comma>,)\s* | \s*(?P<child>>)\s* | (?P<blank>\s+) | (?P<any>\*)
    | \.(?P<of_class>{_NAME}) | \#(?P<of_id>{_NAME}) | (?P<tag>{_NAME})
    | \[\s*(?P<attribute>{_NAME})\s*
      (?:(?P<relation>[~^$*|]?=)\s*(?:"(?P<quoted>[^"]*)"|'(?P<single>[^']*)'|(?P<bare>{_NAME})))?
      \s*\]""",
    re.VERBOSE,
)


class Compound(NamedTuple):
    """What one element has to be; each test is (attribute, relation, value)."""

    tag: str | None
    tests: tuple[tuple[str, str, str], ...]


class Mark(NamedTuple):
    compound: Compound
    combinator: str
    left: int
    value: int


def chains(selector: str) -> list[list[tuple[str, Compound]]]:
    """Compounds of each alternative, from outer to inner, with the combinator before each."""
    found: list[list[tuple[str, Compound]]] = [[]]
    tag, tests, started, combinator = None, [], False, ""
    text = selector.strip()

    def end():
        nonlocal tag, tests, started
        if not started:
            raise ValueError(f"selector not understood: {selector!r}")
        found[-1].append((combinator, Compound(tag, tuple(tests))))
        tag, tests, started = None, [], False

    at = 0
    while at < len(text):
        piece = _PIECE.match(text, at)
        if not piece:
            raise ValueError(f"selector not understood: {selector!r}")
        at, kind = piece.end(), piece.groupdict()
        if kind["comma"]:
            end()
            found.append([])
            combinator = ""
        elif kind["child"] or kind["blank"]:
            end()
            combinator = ">" if kind["child"] else " "
        elif kind["any"] or kind["tag"]:
            if started:
                raise ValueError(f"selector not understood: {selector!r}")
            tag, started = kind["tag"] and kind["tag"].lower(), True
        else:
            started = True
            if kind["of_class"]:
                tests.append(("class", "~=", kind["of_class"]))
            elif kind["of_id"]:
                tests.append(("id", "=", kind["of_id"]))
            else:
                value = kind["quoted"] or kind["single"] or kind["bare"] or ""
                tests.append((kind["attribute"].lower(), kind["relation"] or "", value))
    end()
    return found


def _holds(attrs: dict[str, str], test: tuple[str, str, str]) -> bool:
    name, relation, wanted = test
    value = attrs.get(name)
    if value is None:
        return False
    if relation == "":
        return True
    if relation == "=":
        return value == wanted
    if relation == "~=":
        return wanted in value.split()
    if relation == "|=":
        return value == wanted or value.startswith(wanted + "-")
    if not wanted:
        return False
    if relation == "^=":
        return value.startswith(wanted)
    return value.endswith(wanted) if relation == "$=" else wanted in value


class OwnMarks:
    """Marks of some selectors; equal selectors in equal order have equal marks everywhere."""

    def __init__(self, selectors: Sequence[str]):
        self.masks: dict[str, int] = {}
        self.marks: list[Mark] = []
        known: dict[tuple, int] = {}
        for selector in selectors:
            mask = 0
            for chain in chains(selector):
                key, left = (), 0
                for combinator, compound in chain:
                    key = (*key, combinator, compound)
                    if key not in known:
                        known[key] = 1 << (WORD + len(self.marks))
                        self.marks.append(Mark(compound, combinator, left, known[key]))
                    left = known[key]
                mask |= left
            self.masks[selector] = mask
        self.words = -(-len(self.marks) // WORD)
        self.of_tag: dict[str | None, list[Mark]] = {}
        for mark in self.marks:
            self.of_tag.setdefault(mark.compound.tag, []).append(mark)

    def of(self, tag: str, attrs: dict[str, str], up: int, above: int) -> int:
        """Marks of an element whose parent has ``up`` and all around it ``above``."""
        own = 0
        for key in (tag, None):
            for mark in self.of_tag.get(key, ()):
                around = {"": 1, " ": above & mark.left, ">": up & mark.left}[mark.combinator]
                if around and all(_holds(attrs, test) for test in mark.compound.tests):
                    own |= mark.value
        return own


@lru_cache(maxsize=64)
def own_marks(selectors: tuple[str, ...]) -> OwnMarks:
    return OwnMarks(selectors)


def words(mask: int) -> Iterator[tuple[int, int]]:
    """Number and bits of each word in which a mask has any."""
    number = 0
    while mask:
        if mask & _FULL:
            yield number, mask & _FULL
        mask >>= WORD
        number += 1


def word(mask: int, number: int) -> int:
    return mask >> (WORD * number) & _FULL


def field(name: str, number: int) -> str:
    """Field of a node that holds a word of its marks."""
    return f"{name}{number}" if number else name
