"""Text normalisation as column expressions: no UDF, one pass per step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from . import chars

_MARK = "\n"  # cannot occur once white space is folded to single blanks

_BREAKERS = r"[.\"'\-_`]"
_WORD_WITH_TWO_BREAKERS = rf"(?<![^ ])[^ .\"'\-_`]*+{_BREAKERS}[^ .\"'\-_`]*+{_BREAKERS}[^ ]*+"
_URL = r"https?://[^ ]+|www\.[^ ]+|t\.me/[^ ]+|[^ ]+\.ly/[^ ]+"
_URL_HINTS = ("http", "www.", "t.me/", ".ly/")
_URL_STARTS = ("http", "www", "t.me", "bit.ly")
_HANGUL = "[가-힣]"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _mapped_parts(text: Column, pattern: str, on_match) -> Column:
    """``text`` with ``on_match`` applied to every match of ``pattern``.

    The matches are fenced with a marker, so the elements with an odd index of
    the split are exactly the matches.
    """
    parts = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    return F.array_join(
        F.transform(parts, lambda s, i: F.when(i % 2 == 1, on_match(s)).otherwise(s)), ""
    )


def _char_class(characters) -> str:
    """A class for many characters, as ranges, with a quick way out for ASCII."""
    ranges = []
    for code in sorted(map(ord, characters)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    body = "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)
    return f"(?=[^\\x00-\\x7f])[{body}]"


def _decompose_hangul(char: Column) -> Column:
    index = F.ascii(char) - chars.HANGUL_FIRST
    tail = index % chars.HANGUL_T
    return F.concat(
        F.substring(F.lit(chars.HANGUL_LEAD), F.floor(index / chars.HANGUL_VT).cast("int") + 1, F.lit(1)),
        F.substring(
            F.lit(chars.HANGUL_VOWEL),
            F.floor((index % chars.HANGUL_VT) / chars.HANGUL_T).cast("int") + 1,
            F.lit(1),
        ),
        F.when(tail > 0, F.substring(F.lit(chars.HANGUL_TAIL), tail + 1, F.lit(1))).otherwise(""),
    )


def fold_single(text: Column) -> Column:
    """Drop invisible characters and marks, map look-alikes and NFKD, one to one."""
    table = chars.fold_table()
    return F.when(is_ascii(text), text).otherwise(F.translate(text, table.source, table.target))


def fold_several(single: Column) -> Column:
    """Decompose what :func:`fold_single` left: one character to several (NFKD)."""
    table = chars.fold_table()
    pairs = "\n".join(f"{k}\t{v}" for k, v in table.expansions.items())
    expansions = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))  # folded once, when planned
    several = "".join(table.expansions)
    return F.when(
        ~is_ascii(single)
        & (F.char_length(F.translate(single, several, "")) < F.char_length(single)),
        _mapped_parts(single, _char_class(several), lambda c: F.element_at(expansions, c)),
    ).otherwise(single)


def fold_hangul(text: Column) -> Column:
    """Decompose Hangul syllables into letters (NFKD), by arithmetic."""
    return F.when(
        ~is_ascii(text) & text.rlike(_HANGUL), _mapped_parts(text, _HANGUL, _decompose_hangul)
    ).otherwise(text)


def collapse_spaces(text: Column) -> Column:
    """Runs of white space become one blank; none is left at the ends.

    Expects folded characters, where only ASCII white space is left.  A lone
    blank needs no work, so it is not matched.
    """
    return F.trim(F.regexp_replace(text, r"[\t-\r\x1c-\x20]{2,}|[\t-\r\x1c-\x1f]", " "))


def join_broken_words(text: Column) -> Column:
    """``t.e.l.e.g.r.a.m`` becomes ``telegram``; needs single blanks between words."""

    def joined(word: Column) -> Column:
        bare = F.translate(word, chars.WORD_BREAKERS, "")
        breakers = F.char_length(word) - F.char_length(bare)
        letters = F.char_length(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""))
        return F.when((F.char_length(word) >= 5) & (breakers >= letters * 0.4), bare).otherwise(word)

    return F.when(
        text.rlike(f"{_BREAKERS}[^ ]*{_BREAKERS}"), _mapped_parts(text, _WORD_WITH_TWO_BREAKERS, joined)
    ).otherwise(text)


def _leet_segment(segment: Column) -> Column:
    """Leetspeak to letters, unless the segment reads like an address.

    Leading ``@`` are kept, whatever follows them obeys the same rule.
    """
    rest = F.ltrim(segment, F.lit("@"))
    at_signs = F.substring(segment, F.lit(1), F.char_length(segment) - F.char_length(rest))
    starts_like_url = reduce(Column.__or__, (rest.startswith(start) for start in _URL_STARTS))
    return (
        F.when(segment.contains("/") | starts_like_url, segment)
        .when(segment.startswith("@"), F.concat(at_signs, F.translate(rest, chars.LEET_FROM, chars.LEET_TO)))
        .otherwise(F.translate(segment, chars.LEET_FROM, chars.LEET_TO))
    )


def replace_leetspeak(text: Column) -> Column:
    """Leetspeak to letters between URLs; needs single blanks between words."""
    has_url = reduce(Column.__or__, (text.contains(hint) for hint in _URL_HINTS))
    parts = F.split(F.regexp_replace(text, f"({_URL})", f"{_MARK}$1{_MARK}"), _MARK)
    between_urls = F.array_join(
        F.transform(parts, lambda s, i: F.when(i % 2 == 1, s).otherwise(_leet_segment(s))), ""
    )
    return F.when(has_url, between_urls).otherwise(_leet_segment(text))


def single_blanks(text: Column) -> Column:
    """Blanks left over where a word vanished."""
    return F.trim(F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def strip(text: Column) -> Column:
    """Without white space at the ends, for every kind of white space."""
    return F.trim(text, F.lit(chars.WHITESPACE))


def normalization_steps() -> tuple:
    """The steps in order, each a function from column to column.

    Applied one projection after the other, so that no step is spelled out
    twice in the plan.
    """
    return (fold_single, fold_several, fold_hangul, collapse_spaces, join_broken_words, replace_leetspeak, single_blanks)


def has_lookalikes(text: Column) -> Column:
    return F.when(is_ascii(text), False).otherwise(text.rlike(_char_class(chars.LOOKALIKE_FROM)))


# Characters whose case partners are not found by lower() alone.
_PARTNERS = {0x130: "i", 0x131: "i", 0x17F: "s", 0x212A: "k", 0xB5: "μ"}


def fold_case(text: Column) -> Column:
    """Lower case, one character for one, with the special case partners merged.

    Two texts are equal after folding iff a case-insensitive match would treat
    them as equal; positions in the result are positions in ``text``.
    """
    plain = F.translate(text, "".join(map(chr, _PARTNERS)), "".join(_PARTNERS.values()))
    return F.translate(F.lower(plain), "ς", "σ")


def fold_case_of_texts(text: Column) -> Column:
    """:func:`fold_case` of long texts: gone through by character only where one of the special characters stands."""
    special = "".join(map(chr, _PARTNERS)) + "Σς"
    return F.when(text.rlike(f"[{special}]"), fold_case(text)).otherwise(F.lower(text))


def folded(literal: str) -> str:
    """:func:`fold_case` of a constant."""
    return literal.translate(_PARTNERS).lower().replace("ς", "σ")
