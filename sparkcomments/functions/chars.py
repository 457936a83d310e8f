"""Character tables behind text normalisation, in the shape ``translate`` takes."""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import cache

# --------------------------------------------------------------------------
# Character tables that results depend on.
# --------------------------------------------------------------------------

# Look-alike letters and the Latin letters they pass for: Cyrillic lower case,
# Cyrillic upper case, Greek.
LOOKALIKE_FROM = "асеорхуіјѕһԁԛԝᴦ" "АВСЕНКМОРТХУІ" "αορτυνωχ"
LOOKALIKE_TO = "aceopxyijshdqwr" "ABCEHKMOPTXYI" "aoptuvwx"

# Leetspeak: symbols and digits standing in for letters.
LEET_FROM = "@4^8(<{3€69#1!|0ø$57+µ2"
LEET_TO = "aaabccceegghiiioossttuz"

# Zero-width and invisible characters.
ZERO_WIDTH = (
    "\u200b"  # zero width space
    "\u200c"  # zero width non-joiner
    "\u200d"  # zero width joiner
    "\u2060"  # word joiner
    "\ufeff"  # zero width no-break space
    "\u00ad"  # soft hyphen
    "\u034f"  # combining grapheme joiner
    "\u2061"  # function application
    "\u2062"  # invisible times
    "\u2063"  # invisible separator
    "\u2064"  # invisible plus
)

# Marks that split up a word to hide it.
WORD_BREAKERS = ".\"'-_`"

# White space, as text.
WHITESPACE = (
    "\u0009"  # tab
    "\u000a"  # line feed
    "\u000b"  # vertical tab
    "\u000c"  # form feed
    "\u000d"  # carriage return
    "\u001c"  # file separator
    "\u001d"  # group separator
    "\u001e"  # record separator
    "\u001f"  # unit separator
    "\u0020"  # space
    "\u0085"  # next line
    "\u00a0"  # no-break space
    "\u1680"  # ogham space mark
    "\u2000"  # en quad
    "\u2001"  # em quad
    "\u2002"  # en space
    "\u2003"  # em space
    "\u2004"  # three-per-em space
    "\u2005"  # four-per-em space
    "\u2006"  # six-per-em space
    "\u2007"  # figure space
    "\u2008"  # punctuation space
    "\u2009"  # thin space
    "\u200a"  # hair space
    "\u2028"  # line separator
    "\u2029"  # paragraph separator
    "\u202f"  # narrow no-break space
    "\u205f"  # medium mathematical space
    "\u3000"  # ideographic space
)

# Hangul syllables decompose by arithmetic: (first, last) syllable, number of
# vowels times trailing consonants, number of trailing consonants.
HANGUL_FIRST, HANGUL_LAST, HANGUL_VT, HANGUL_T = 0xAC00, 0xD7A3, 588, 28
HANGUL_LEAD = "".join(chr(0x1100 + i) for i in range(19))
HANGUL_VOWEL = "".join(chr(0x1161 + i) for i in range(21))
HANGUL_TAIL = "".join(chr(0x11A7 + i) for i in range(28))  # index 0 means "no tail"


@dataclass(frozen=True)
class FoldTable:
    """Invisible characters dropped, look-alikes mapped, NFKD without marks.

    ``source``/``target`` feed ``translate`` (characters past the end of
    ``target`` are deleted); ``expansions`` holds the characters that become
    several.
    """

    source: str
    target: str
    expansions: dict[str, str]


@cache
def fold_table() -> FoldTable:
    """The table, built from the public Unicode data of the Python runtime.

    Dropping every combining mark makes NFKD a map per code point, so one
    ``translate`` covers all steps.  White space is mapped to the plain blank
    on the way, which leaves ``\\n`` free as a marker.
    """
    lookalike = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO))
    mapped, dropped, expansions = {}, [], {}
    for code in range(1, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF or HANGUL_FIRST <= code <= HANGUL_LAST:
            continue
        char = chr(code)
        if not (
            unicodedata.decomposition(char) or unicodedata.combining(char)
            or char in lookalike or char in ZERO_WIDTH or char in WHITESPACE
        ):
            continue
        if char in ZERO_WIDTH:
            dropped.append(char)
            continue
        decomposed = unicodedata.normalize("NFKD", lookalike.get(char, char))
        folded = "".join(
            " " if c in WHITESPACE else c for c in decomposed if not unicodedata.combining(c)
        )
        if folded == char:
            continue
        if not folded:
            dropped.append(char)
        elif len(folded) == 1:
            mapped[char] = folded
        else:
            expansions[char] = folded
    return FoldTable("".join([*mapped, *dropped]), "".join(mapped.values()), expansions)
