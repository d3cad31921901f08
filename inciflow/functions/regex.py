"""One pattern source for two regular-expression dialects.

Domain patterns follow ECMAScript rules: ``\\b`` is ASCII, ``\\s`` covers the
Unicode spaces and ``$`` is the end of input.  Java and RE2 differ from that
and from each other, so patterns are adapted once, here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

SPACE_SET = (
    r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)
SPACES = f"[{SPACE_SET}]"
#: The characters of SPACES themselves.
SPACE_CHARS = "\t\n\x0b\f\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: A run of white space that is more or other than one plain blank; it starts with one class, so most places fail at once.
UNTIDY_SPACES = f"{SPACES}(?:(?<! )|{SPACES}){SPACES}*+"
_JAVA_EDGE = (
    r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
)


_WORD_AHEAD = re.compile(r"(?:\(\?:)?(?:[A-Za-z0-9]|\\d)", re.ASCII)
_WORD_BEHIND = re.compile(r"(?<!\\)[A-Za-z0-9]\??\Z", re.ASCII)


def _java_edge(pattern: str, i: int) -> str:
    """Cheapest equivalent of an ASCII word edge at offset i of a pattern."""
    before, after = pattern[:i], pattern[i + 2 :]
    if _WORD_AHEAD.match(after) and (not before or before[-1] in "|(:"):
        return r"(?<![A-Za-z0-9_])"
    if _WORD_BEHIND.search(before):
        return r"(?![A-Za-z0-9_])"
    return _JAVA_EDGE


def _adapt(pattern: str, edge: str | None) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\b" and not in_class:
            out.append(_java_edge(pattern, i) if edge is None else edge)
            i += 2
        elif two == r"\s":
            out.append(SPACE_SET if in_class else SPACES)
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            ch = pattern[i]
            if ch == "[" and not in_class:
                in_class = True
            elif ch == "[" and in_class:
                ch = r"\["
            elif ch == "]":
                in_class = False
            elif ch == "$" and not in_class:
                ch = r"\z"
            out.append(ch)
            i += 1
    return "".join(out)


@lru_cache(maxsize=None)
def java(pattern: str, ignore_case: bool = True) -> str:
    return ("(?i)" if ignore_case else "") + _adapt(pattern, None)


@lru_cache(maxsize=None)
def re2(pattern: str) -> str:
    return _adapt(pattern, r"\b")


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """Characters whose compatibility decomposition is one ASCII letter or digit."""
    source, target = [], []
    for point in range(0x80, 0xFFFF):
        ch = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) == 1 and base.isascii() and (base.islower() or base.isdigit()):
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


@lru_cache(maxsize=1)
def ligatures() -> tuple[tuple[str, str], ...]:
    """Characters that decompose to several lower-case ASCII letters."""
    found = []
    for point in range(0x80, 0xFFFF):
        ch = chr(point)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(c) <= 0x36F)
        if len(base) > 1 and base.isascii() and base.isalpha() and base.islower() and unicodedata.name(ch, "").startswith("LATIN"):
            found.append((ch, base))
    return tuple(found)


@lru_cache(maxsize=None)
def literal_guard(pattern: str) -> str:
    """Longest literal run every hit of a pattern must contain, in lower case."""
    runs, run, depth, i = [], "", 0, 0
    while i < len(pattern):
        ch = pattern[i]
        step = 1
        if ch == "\\":
            step = 2
            literal = pattern[i + 1] if pattern[i + 1] in "|().+" else None
        elif ch == "[":
            step = pattern.index("]", i) + 1 - i
            literal = None
        elif ch == "(":
            depth, literal = depth + 1, None
        elif ch == ")":
            depth, literal = depth - 1, None
        elif ch in "?*+{}^$|.":
            literal = None
        else:
            literal = ch
        optional = pattern[i + step : i + step + 1] in ("?", "*", "{")
        if literal is None or depth or optional:
            runs.append(run)
            run = ""
        else:
            run += literal.lower()
        i += step
    return max([*runs, run], key=len)
