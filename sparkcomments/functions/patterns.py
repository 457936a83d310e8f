"""Regular expressions: one spelling for the rule table, one dialect for the JVM."""

from __future__ import annotations

import re

# Fixed value: the characters that count as whitespace, as a character class body.
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = f"[{SPACE_CLASS}]"


def java(pattern: str, ignore_case: bool = False) -> str:
    """``pattern`` for ``java.util.regex`` with Unicode aware ``\\s``, ``\\d`` and ``\\b``.

    ``(?U)`` makes ``\\b`` and ``\\d`` follow Unicode on every JVM version and
    ``(?d)`` makes ``\\n`` the only line end; ``\\s`` is spelled out because the
    JVM's own class leaves out the four ASCII separators.
    """
    flags = "(?iuUd)" if ignore_case else "(?Ud)"
    out, in_class, i = [], False, 0
    while i < len(pattern):
        token = pattern[i:i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        if token == r"\s":
            token = SPACE_CLASS if in_class else SPACE
        elif token == "[":
            in_class = True
        elif token == "]":
            in_class = False
        out.append(token)
    return flags + "".join(out)


def quote(literal: str) -> str:
    """``literal`` as a pattern that matches exactly itself."""
    return "".join("\\" + c if c in r"\.^$|?*+()[]{}-&~#" else c for c in literal)


def sql(value) -> str:
    """``value`` as a Spark SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    escaped = "".join(_ESCAPES.get(c, c) for c in value)
    return f"'{escaped}'"


_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}


def gate_word(start: str) -> str:
    """What is searched for a start: a symbol as it is, of words the part before any inner boundary."""
    return re.match(r"\w+", start)[0] if start[0].isalnum() else start


def any_start(starts) -> str:
    """A pattern for any of ``starts``: words at a word start, symbols anywhere.

    Words are tried by first letter, the longest first: what is found at a place
    has every start that occurs there as a prefix.  ``\b`` without flags never
    sees fewer boundaries than the Unicode one, so nothing is missed.
    """
    symbols = sorted(s for s in starts if not s[0].isalnum())
    words = sorted({gate_word(s) for s in starts if s[0].isalnum()}, key=lambda w: (w[0], -len(w), w))
    by_letter: dict[str, list[str]] = {}
    for word in words:
        by_letter.setdefault(word[0], []).append(quote(word[1:]))
    branches = (f"{letter}(?:{'|'.join(rest)})" for letter, rest in by_letter.items())
    return rf"\b(?:{'|'.join(branches)})|[{''.join(map(quote, symbols))}]"
