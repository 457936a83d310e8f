"""Spam scoring as a chain of projections.

Every stage is its own ``select`` over the columns of the stage before, so that
the normalised text, the hits and the sorted weights are each computed once per
row and the generated code stays small.  Nothing here shuffles.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import require_configured
from . import normalize as N
from . import patterns, rules
from .patterns import sql

DEFAULT_THRESHOLD = 0.5

# --------------------------------------------------------------------------
# Presets, texts and limits that results depend on.
# --------------------------------------------------------------------------
PRESETS = {"light": 0.65, "moderate": 0.5, "aggressive": 0.4, "strict": 0.3}
OBFUSCATION = ("obfuscation", "Homoglyph obfuscation detected", 0.30, "[cyrillic/greek characters]")
BLACKLISTED = ("bot_pattern", "Matched blacklist pattern", 1.0)
WHITELISTED = ("Matched whitelist pattern", -1.0, "[whitelisted]")
SHORT = ("Short harmless comment", -0.10)
LONG = ("Long thoughtful comment", -0.15)
SHORT_BELOW, LONG_ABOVE = 30, 200
HIGH_LIKES, SOME_LIKES = 100, 10
HIGH_BONUS, SOME_BONUS = -0.25, -0.10
CAP_FROM_BASE, CAPPED_BONUS = 0.55, -0.10
CAPPED_SUFFIX = " [capped - high spam signals]"
NO_REASON = "No spam signals detected"
DECAY = 0.5
REASONS_SHOWN = 3

RESULT_COLUMNS = (
    "is_spam", "spam_score", "threshold", "signals", "legitimacy_signals", "categories",
    "normalized_text", "had_obfuscation", "reason", "primary_category", "legitimacy_reason",
)

_SIGNAL = "struct<category:string,signal:string,weight:double,matched_text:string>"

# Working columns; dropped at the end.
_P = "_spam_"
_PLACES = 512  # size of the table from starts to rules
_WORD_BITS = 62  # rules to one long
_BLANK, _WHITE, _BLACK, _SCORED = 0, 1, 2, 3
_IS_SCORED = f"{_P}gate = {_SCORED}"

_FIELDS = {  # source -> (text as is, text in lower case)
    rules.NORM: (f"{_P}norm", f"{_P}lower"),
    rules.RAW: (f"{_P}raw", f"{_P}raw"),
    rules.AUTHOR: (f"{_P}author", f"{_P}author_lower"),
}


def preset(name: str) -> float:
    """Threshold of a named strength."""
    return PRESETS[name.lower()]


def strength_label(threshold: Column) -> Column:
    """Name of the strength a threshold falls into."""
    return (
        F.when(threshold >= PRESETS["light"], "Light")
        .when(threshold >= PRESETS["moderate"], "Moderate")
        .when(threshold >= PRESETS["aggressive"], "Aggressive")
        .otherwise("Strict")
    )


def clean_patterns(user_patterns: Sequence[str] | Column | None) -> list[str] | Column:
    """User patterns without surrounding white space and without blank ones; a column stays."""
    if isinstance(user_patterns, Column):
        return user_patterns
    return [p.strip() for p in user_patterns or () if p.strip()]


def first_pattern(folded_text: Column, user_patterns: Sequence[str] | Column) -> Column:
    """The first pattern, in list order, that the text contains; null if none.

    A column holds it already, folded (``operators.listed``).

    The list is folded once, here.  Rows are tested with one alternation; only
    those that hit look for the entry.
    """
    if isinstance(user_patterns, Column):
        return user_patterns
    folded = list(map(N.folded, user_patterns))
    entries = F.expr(f"array({', '.join(map(sql, folded))})")
    first = F.get(F.filter(entries, lambda p: folded_text.contains(p)), F.lit(0))
    return F.when(folded_text.rlike("|".join(map(patterns.quote, folded))), first)


def _add(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    return df.withColumns(
        {_P + name: F.expr(c) if isinstance(c, str) else c for name, c in columns.items()}
    )


def _struct(fields: Sequence[str], *values: str) -> str:
    return f"named_struct({', '.join(f'{sql(f)}, {v}' for f, v in zip(fields, values))})"


_SIGNAL_FIELDS = ("category", "signal", "weight", "matched_text")
_BONUS_FIELDS = ("signal", "bonus", "matched_text")


def _hit(rule, place: int) -> str:
    """Whether the rule matches; cheap necessary conditions go first."""
    text, folded = _FIELDS[rule.source]
    haystack = folded if rule.ignore_case else text
    conditions = []
    if rule.starts:
        conditions.append(f"({_P}tried{place // _WORD_BITS} & {1 << place % _WORD_BITS}L) != 0")
    if rule.hints:
        conditions.append("(" + " OR ".join(f"contains({haystack}, {sql(h)})" for h in rule.hints) + ")")
    for pattern in filter(None, (rule.probe, rule.pattern)):
        conditions.append(f"rlike({haystack}, {sql(patterns.java(pattern))})")
    return " AND ".join(conditions)


def _matched_text(rule) -> str:
    if rule.label is not None:
        return sql(rule.label)
    text, _ = _FIELDS[rule.source]
    return f"regexp_extract({text}, {sql(patterns.java(rule.pattern, rule.ignore_case))}, 0)"


def slots(signals: Sequence[rules.Signal]) -> list[list[rules.Signal]]:
    """The rules grouped by slot, in order."""
    grouped: dict[str, list[rules.Signal]] = {}
    for rule in signals:
        grouped.setdefault(rule.slot, []).append(rule)
    return list(grouped.values())


def _in_slot(slot, value, default: str) -> str:
    """``value`` of the first rule of the slot that hits, else ``default``."""
    cases = " ".join(f"WHEN {_P}{rule.id} THEN {value(rule)}" for rule in slot)
    return f"CASE {cases} ELSE {default} END"


def _weight(rule) -> str:
    if rule.counted:
        base, step, top = rule.counted
        return f"least({_P}{rule.id}_count * {sql(step)} + {sql(base)}, {sql(top)})"
    return sql(float(rule.weight))


def _signal_text(rule) -> str:
    if rule.counted:
        return f"concat({sql(rule.signal + ' (')}, string({_P}{rule.id}_count), 'x)')"
    return sql(rule.signal)


def sealed(df: DataFrame, kept: Sequence[str], computed: dict[str, Column | str]) -> DataFrame:
    """``kept`` columns and the ``computed`` ones, out of reach of filter push-down.

    A filter on a computed column would be pushed below every projection of the
    chain, which spells out all that the column depends on, over and over.
    Filters are not pushed below a generator, so the columns leave the chain
    through one that yields a single row.
    """
    fields = ", ".join(f"`{name}`" for name in computed)
    named = df.select(
        *(F.col(f"`{k}`") for k in kept),
        *((F.expr(x) if isinstance(x, str) else x).alias(name) for name, x in computed.items()),
    )
    one = F.expr(f"inline(array(struct({fields})))")
    return named.select(*(F.col(f"`{k}`") for k in kept if k not in computed), one)


def normalized(df: DataFrame, text: Column, out: str = "normalized_text") -> DataFrame:
    """``df`` with the normalised form of ``text`` as column ``out``."""
    kept = [name for name in df.columns if name != out]
    return sealed(_normalized(df, text, _P + "norm"), kept, {out: F.col(_P + "norm")})


def _normalized(df: DataFrame, text: Column, out: str) -> DataFrame:
    df = df.withColumn(out, F.coalesce(text, F.lit("")))
    for step in N.normalization_steps():
        df = df.withColumn(out, step(F.col(out)))
    return df


def _given(user_patterns) -> bool:
    return isinstance(user_patterns, Column) or bool(user_patterns)


def _gates(df, text, author, likes, threshold, blacklist, whitelist) -> DataFrame:
    """Inputs as non-null columns, the gate every row takes, its normalised text."""
    raw = F.coalesce(text, F.lit(""))
    if not isinstance(threshold, Column):
        threshold = F.lit(float(threshold))
    df = _add(df, {
        "text": raw,
        "author_text": F.coalesce(author, F.lit("")),
        "likes": F.coalesce(likes, F.lit(0)).cast("long"),
        "threshold": F.greatest(F.lit(0.0), F.least(F.lit(1.0), threshold)),
        "length": F.char_length(N.strip(raw)),
    })
    gate = f"WHEN {_P}length = 0 THEN {_BLANK}"
    given = {name: x for name, x in (("white", whitelist), ("black", blacklist)) if _given(x)}
    if given:
        df = _add(df, {"folded": N.fold_case(F.col(f"{_P}text"))})
        df = _add(df, {
            name: first_pattern(F.col(f"{_P}folded"), user_patterns) for name, user_patterns in given.items()
        })
    if "white" in given:
        gate += f" WHEN {_P}white IS NOT NULL THEN {_WHITE}"
    if "black" in given:
        gate += f" WHEN {_P}black IS NOT NULL THEN {_BLACK}"
    df = _add(df, {"gate": f"CASE {gate} ELSE {_SCORED} END"})
    df = _add(df, {
        "raw": f"IF({_IS_SCORED}, {_P}text, '')",
        "author": f"IF({_IS_SCORED}, {_P}author_text, '')",
    })
    df = _normalized(df, F.col(f"{_P}raw"), _P + "norm")
    return _add(df, {
        # The dotless i is the one letter lower() leaves apart from its partner.
        "lower": f"replace(lower({_P}norm), 'ı', 'i')",
        "author_lower": N.fold_case(F.col(f"{_P}author")),
        "lookalike": N.has_lookalikes(F.col(f"{_P}raw")),
    })


def _hits(df, signals, legitimacy) -> DataFrame:
    """One flag per rule.

    A single pass lists the starts that occur in the text; the rules they belong
    to, as a bit set, are the only ones whose patterns are tried.  Bit sets are
    looked up by checksum: two starts sharing a place only add tries.
    """
    all_rules = (*signals, *legitimacy)
    all_starts = sorted({start for rule in all_rules for start in rule.starts})
    tables = [[0] * _PLACES for _ in range(0, len(all_rules), _WORD_BITS)]
    for found in {patterns.gate_word(start) for start in all_starts}:
        place = zlib.crc32(found.encode()) % _PLACES
        for i, rule in enumerate(all_rules):
            if any(found.startswith(patterns.gate_word(start)) for start in rule.starts):
                tables[i // _WORD_BITS][place] |= 1 << i % _WORD_BITS
    if all_starts:
        df = _add(df, {"starts": f"regexp_extract_all({_P}lower, {sql(patterns.any_start(all_starts))}, 0)"})
        tried = {}
        for word, places in enumerate(tables):
            table = f"array({', '.join(f'{bit_set}L' for bit_set in places)})"
            tried[f"tried{word}"] = (
                f"aggregate({_P}starts, 0L, (bits, start) -> bits | {table}[int(crc32(start) % {_PLACES})])")
        df = _add(df, tried)
    df = _add(df, {rule.id: _hit(rule, i) for i, rule in enumerate(all_rules)})
    counts = {}
    for rule in signals:
        if rule.counted:
            text, folded = _FIELDS[rule.source]
            counted = f"regexp_count({folded if rule.ignore_case else text}, {sql(patterns.java(rule.pattern))})"
            counts[f"{rule.id}_count"] = f"IF({_P}{rule.id}, {counted}, 0)"
    return _add(df, counts) if counts else df


def _scores(df, signals, legitimacy) -> DataFrame:
    """Base score, bonuses and verdict, additions in the fixed order."""
    weights = [f"IF({_P}lookalike, {sql(OBFUSCATION[2])}, 0D)"]
    weights += [_in_slot(slot, _weight, "0D") for slot in slots(signals)]
    n = len(weights)
    df = _add(df, {"weights": f"array({', '.join(weights)})"})
    df = _add(df, {
        "ranked": f"sort_array({_P}weights, false)",
        "n_signals": " + ".join(
            # A rule of weight 0 is a signal too: its slot is counted by its hits.
            f"int({_in_slot(slot, lambda r: '1', '0')})" if any(not r.counted and not r.weight for r in slot) else f"int({_P}weights[{i}] > 0D)"
            for i, slot in enumerate([(), *slots(signals)])),
    })
    # Absent signals weigh 0.0, so the sum is the one over present signals.
    base = " + ".join(f"{_P}ranked[{i}] * {sql(DECAY ** i)}" for i in range(n))
    df = _add(df, {"base": f"least({base}, 1D)"})
    bonus = (
        f"CASE WHEN {_P}likes >= {HIGH_LIKES} THEN {sql(HIGH_BONUS)} "
        f"WHEN {_P}likes >= {SOME_LIKES} THEN {sql(SOME_BONUS)} ELSE 0D END"
    )
    df = _add(df, {
        "short": f"{_IS_SCORED} AND {_P}length < {SHORT_BELOW} AND {_P}n_signals = 0",
        "long": f"{_IS_SCORED} AND {_P}length > {LONG_ABOVE} AND {_P}n_signals <= 1",
        "likes_bonus": f"IF({_P}base >= {sql(CAP_FROM_BASE)}, greatest({bonus}, {sql(CAPPED_BONUS)}), {bonus})",
    })
    bonuses = [f"IF({_P}{rule.id}, {sql(float(rule.bonus))}, 0D)" for rule in legitimacy]
    bonuses += [
        f"IF({_P}short, {sql(SHORT[1])}, 0D)", f"IF({_P}long, {sql(LONG[1])}, 0D)", f"{_P}likes_bonus",
    ]
    df = _add(df, {"adjustment": " + ".join(bonuses)})
    final = f"greatest(0D, least(1D, {_P}base + {_P}adjustment))"
    return _add(df, {
        "final": f"CASE WHEN {_IS_SCORED} THEN {final} WHEN {_P}gate = {_BLACK} THEN 1D ELSE 0D END"
    })


def _explanations(signals, legitimacy, blacklist, whitelist) -> dict[str, str]:
    """Everything that tells why, built only where a query asks for it.

    Rows without signals skip the lambdas.
    """

    def per_slot(lookalike: str, value) -> str:
        entries = [f"IF({_P}lookalike, {lookalike}, NULL)"]
        return f"array({', '.join(entries + [_in_slot(s, value, 'NULL') for s in slots(signals)])})"

    signal_array = per_slot(
        _struct(_SIGNAL_FIELDS, *map(sql, OBFUSCATION)),
        lambda r: _struct(_SIGNAL_FIELDS, sql(r.category), _signal_text(r), _weight(r), _matched_text(r)),
    )
    category_array = per_slot(sql(OBFUSCATION[0]), lambda r: sql(r.category))
    text_array = per_slot(sql(OBFUSCATION[1]), _signal_text)
    none = f"{_P}n_signals = 0"
    strongest = f"int(array_position({_P}weights, array_max({_P}weights)))"
    result = {
        "signals": f"IF({none}, cast(array() AS array<{_SIGNAL}>), array_compact({signal_array}))",
        "categories": f"IF({none}, cast(array() AS array<string>), "
                      f"sort_array(array_distinct(array_compact({category_array}))))",
        "reason": f"IF({none}, {sql(NO_REASON)}, "
                  f"array_join(slice(array_compact({text_array}), 1, {REASONS_SHOWN}), '; '))",
        "primary_category": f"IF({none}, NULL, element_at({category_array}, {strongest}))",
        "had_obfuscation": f"{_P}lookalike",
    }

    likes = f"string({_P}likes)"
    likes_text = (
        f"concat(IF({_P}likes >= {HIGH_LIKES}, 'High engagement (', 'Community validated ('), {likes}, ' likes)', "
        f"IF({_P}likes >= {HIGH_LIKES} AND {_P}base >= {sql(CAP_FROM_BASE)}, {sql(CAPPED_SUFFIX)}, ''))"
    )
    entries = [(_P + r.id, sql(r.signal), sql(float(r.bonus)), _matched_text(r)) for r in legitimacy]
    entries += [
        (f"{_P}short", *map(sql, SHORT), "''"),
        (f"{_P}long", *map(sql, LONG), "''"),
        (f"({_IS_SCORED} AND {_P}likes >= {SOME_LIKES})", likes_text, f"{_P}likes_bonus", f"concat({likes}, ' likes')"),
    ]
    structs = ", ".join(f"IF({hit}, {_struct(_BONUS_FIELDS, *e)}, NULL)" for hit, *e in entries)
    names = ", ".join(f"IF({hit}, {e[0]}, NULL)" for hit, *e in entries)
    result["legitimacy_signals"] = f"array_compact(array({structs}))"
    result["legitimacy_reason"] = f"array_join(array({names}), '; ')"

    overrides: dict[str, list[str]] = {}
    if _given(whitelist):
        when = f"WHEN {_P}gate = {_WHITE} THEN "
        overrides.setdefault("legitimacy_signals", []).append(
            when + f"array({_struct(_BONUS_FIELDS, *map(sql, WHITELISTED))})")
        overrides.setdefault("legitimacy_reason", []).append(when + sql(WHITELISTED[0]))
    if _given(blacklist):
        when = f"WHEN {_P}gate = {_BLACK} THEN "
        found = f"substring({_P}text, locate({_P}black, {_P}folded), char_length({_P}black))"
        struct = _struct(_SIGNAL_FIELDS, *map(sql, BLACKLISTED), found)
        for name, value in (
            ("signals", f"array({struct})"), ("categories", f"array({sql(BLACKLISTED[0])})"),
            ("reason", sql(BLACKLISTED[1])), ("primary_category", sql(BLACKLISTED[0])),
        ):
            overrides.setdefault(name, []).append(when + value)
    for name, cases in overrides.items():
        result[name] = f"CASE {' '.join(cases)} ELSE {result[name]} END"
    result["normalized_text"] = (
        f"CASE WHEN {_IS_SCORED} THEN {_P}norm WHEN {_P}gate = {_BLANK} THEN '' ELSE {_P}text END"
    )
    return result


def verdict(threshold: Column, final: str = "final", gate: str = "gate") -> Column:
    """Whether a row scored before is spam at a threshold, from the working columns ``final`` and ``gate``."""
    limit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), threshold))
    return F.col(gate).isin(_BLACK, _SCORED) & (F.col(final) >= limit)


def analyze(
    df: DataFrame,
    text: Column,
    author: Column | None = None,
    likes: Column | None = None,
    threshold: float | Column = DEFAULT_THRESHOLD,
    blacklist: Sequence[str] | Column | None = None,
    whitelist: Sequence[str] | Column | None = None,
    signals: Sequence[rules.Signal] = rules.SIGNALS,
    legitimacy: Sequence[rules.Legitimacy] = rules.LEGITIMACY,
    columns: Sequence[str] = RESULT_COLUMNS,
    working: Sequence[str] = (),
    prefix: str = "",
) -> DataFrame:
    """``df`` with the result columns named in ``columns`` added.

    ``working`` names further columns for queries over single rules: rule ids
    (flags), ``lookalike``, ``S03_count``, ``weights``, ``n_signals``, ``base``,
    ``adjustment``, ``final``, ``gate``.  Only what is named is computed.  Result columns get
    ``prefix`` before their names and replace columns of the same name.
    """
    require_configured(df.sparkSession)
    blacklist, whitelist = clean_patterns(blacklist), clean_patterns(whitelist)
    author = F.lit("") if author is None else author
    likes = F.lit(0) if likes is None else likes
    kept = [name for name in df.columns if name not in {prefix + column for column in columns}]
    df = _gates(df, text, author, likes, threshold, blacklist, whitelist)
    df = _scores(_hits(df, signals, legitimacy), signals, legitimacy)
    results = {
        "is_spam": f"{_P}gate = {_BLACK} OR ({_IS_SCORED} AND {_P}final >= {_P}threshold)",
        "spam_score": f"round({_P}final, 3)",
        "threshold": f"{_P}threshold",
        **_explanations(signals, legitimacy, blacklist, whitelist),
    }
    computed = {prefix + name: results[name] for name in columns} | {name: _P + name for name in working}
    return sealed(df, kept, computed)
