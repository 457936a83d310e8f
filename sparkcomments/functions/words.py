"""Whole-word search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

_WORD_CHAR = r"[\p{L}\p{N}_]"


def words_pattern(words: Column) -> Column:
    """One pattern for any of ``words`` as a whole word, from an array column.

    A word boundary is a change between word and other characters, so a word
    that ends in a symbol needs a word character right after it.
    """

    def bounded(word: Column) -> Column:
        literal = F.regexp_replace(F.lower(word), r"([^\p{L}\p{N}_])", r"\\$1")
        before = F.when(word.rlike(f"^{_WORD_CHAR}"), f"(?<!{_WORD_CHAR})").otherwise(f"(?<={_WORD_CHAR})")
        after = F.when(word.rlike(f"{_WORD_CHAR}$"), f"(?!{_WORD_CHAR})").otherwise(f"(?={_WORD_CHAR})")
        return F.concat(before, literal, after)

    return F.array_join(F.transform(words, bounded), "|")


def contains_word(text: Column, words: Column | Sequence[str]) -> Column:
    """Whether ``text`` holds any of ``words``, in any case; true for no words."""
    return matches_words(text, words_pattern(words) if isinstance(words, Column) else F.lit(constant_pattern(words)))


def constant_pattern(words: Sequence[str]) -> str:
    """:func:`words_pattern` of a constant list."""

    def is_word(char: str) -> bool:
        return char.isalnum() or char == "_"

    def bounded(word: str) -> str:
        before = f"(?<!{_WORD_CHAR})" if is_word(word[:1]) else f"(?<={_WORD_CHAR})"
        after = f"(?!{_WORD_CHAR})" if is_word(word[-1:]) else f"(?={_WORD_CHAR})"
        return before + "".join(c if is_word(c) else "\\" + c for c in word.lower()) + after

    return "|".join(map(bounded, words))


def matches_words(text: Column, pattern: Column) -> Column:
    """:func:`contains_word` with a pattern built beforehand; the empty one is that of no words."""
    # regexp_instr keeps the last compiled pattern, so a constant one is compiled once.
    return (pattern == "") | (F.regexp_instr(F.lower(text), pattern) > 0)
