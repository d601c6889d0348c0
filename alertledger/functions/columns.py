"""Column expressions (all built-in, JVM-side; no Python UDFs).

Each helper returns a ``Column`` so callers compose them inside one
``select`` and Catalyst keeps the whole parse inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P
from ..schemas import MONEY


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_text(*parts: str | Column) -> Column:
    """The text columns (default body, snippet, subject), each NULL as '', one space between them."""
    return F.array_join(F.array(*(F.ifnull(col_(c), F.lit("")) for c in parts or P.TEXT_COLUMNS)), " ")


def single_spaces(text: str | Column) -> Column:
    """Every run of white space as one space. A text whose white space is all single spaces is left as it is,
    without replacing each of them by itself. Keep ``text`` a column of an earlier projection: it is used twice."""
    t = col_(text)
    return F.when(t.rlike(P.OTHER_SPACE), F.regexp_replace(t, P.WHITE_SPACE, " ")).otherwise(t)


def normalised_text(*parts: str | Column) -> Column:
    """The joined text columns, every run of white space one space."""
    return F.regexp_replace(joined_text(*parts), P.WHITE_SPACE, " ")


# Literal pre-filters for the *normalised* text. A pattern can only match text
# that contains these literals (case-folded): ``any`` = at least one of them,
# ``all`` = each of them. A plain substring search on the lower-cased text
# skips the regex engine for rows that cannot match; the result is identical
# because the regex still decides every row that passes. Two facts make the
# literals valid: the patterns fold case for ASCII only (lower-casing can add
# candidates, never drop one), and in normalised text every ``\s`` run is
# exactly one space, so ``x\s+y`` needs the literal ``"x y"``.
REQUIRED: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    P.AMOUNT_ANCHORED: (("debited rs", "withdrawal for rs", "spent rs", "purchase of rs"), ()),
    P.AMOUNT_POSTFIX: ((" debited", " credited"), ("rs",)),
    P.AMOUNT_GENERIC: ((), ("rs",)),
    P.REF: ((), ("ref",)),
    P.VPA: ((), ("vpa ",)),
    P.COUNTERPARTY: ((), ("vpa ", " on ")),
    P.CARD_ENDING: ((), ("card ending ",)),
    P.CARD_STARS: ((), ("**",)),
    P.ACCOUNT: ((), ("from account ",)),
    P.CITY: ((), ("in ", " at")),
    P.PLACE: ((), ("at ", " on ")),
    P.BALANCE: ((), ("available balance", "rs")),
    P.LOCAL_DT: ((), ("on ", ":")),
    P.DIRECTION_TESTS[0][0]: (("credited", "refund", "reversal", "received"), ()),
    P.DIRECTION_TESTS[1][0]: (("debited", "withdrawal", "spent", "purchase", "debit card"), ()),
    P.TXN_TYPE_TESTS[0][0]: ((), ("atm withdrawal",)),
    P.TXN_TYPE_TESTS[1][0]: ((), ("upi",)),
    P.TXN_TYPE_TESTS[2][0]: ((), ("credit card",)),
    P.TXN_TYPE_TESTS[3][0]: ((), ("debit card",)),
    P.TXN_TYPE_TESTS[4][0]: ((), ("neft",)),
    P.TXN_TYPE_TESTS[5][0]: ((), ("imps",)),
    P.TXN_TYPE_TESTS[6][0]: ((), ("rtgs",)),
    P.CURRENCY_TESTS[1][0]: (("$", "usd"), ()),
}


def may_match(lowered: Column | None, pattern: str) -> Column | None:
    """Cheap necessary condition for ``pattern`` on the lower-cased text, or None."""
    if lowered is None or pattern not in REQUIRED:
        return None
    any_of, all_of = REQUIRED[pattern]
    cond = None
    if any_of:
        cond = lowered.contains(any_of[0])
        for lit in any_of[1:]:
            cond = cond | lowered.contains(lit)
    for lit in all_of:
        cond = lowered.contains(lit) if cond is None else cond & lowered.contains(lit)
    return cond


def raw_extract(text: str | Column, pattern: str, lowered: Column | None = None) -> Column:
    """Group 1 of the first match; '' or NULL when nothing matched. One regex evaluation."""
    value = F.regexp_extract(col_(text), pattern, 1)
    guard = may_match(lowered, pattern)
    return value if guard is None else F.when(guard, value)


def blank_to_null(raw: str | Column) -> Column:
    """'' → NULL. Keep ``raw`` a column of an earlier projection: the value is used twice."""
    return F.nullif(col_(raw), F.lit(""))


def first_match_label(text: str | Column, tests: Sequence[tuple[str, str]], default: str,
                      lowered: Column | None = None) -> Column:
    """CASE over ``rlike`` tests in order; first hit gives its label."""
    t = col_(text)
    expr = None
    for pattern, label in tests:
        guard = may_match(lowered, pattern)
        hit = t.rlike(pattern) if guard is None else (guard & t.rlike(pattern))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr.otherwise(F.lit(default))


def to_money(raw: str | Column) -> Column:
    """Strip commas, cast to decimal(18,2); '' or overflow → NULL (never raises)."""
    return F.regexp_replace(col_(raw), ",", "").try_cast(MONEY)


def first_found(*raws: str) -> Column:
    """The first raw extract that is not blank."""
    return F.coalesce(*(blank_to_null(r) for r in raws))


def local_datetime(raw: str | Column) -> Column:
    """A raw 'dd-MM-yyyy HH:mm:ss' as a zone-less wall clock; invalid dates → NULL.

    The lenient parse decides validity; the NTZ parse then reads the same text
    without going through the session time zone.
    """
    value, fmt = blank_to_null(raw), F.lit(P.LOCAL_DT_FORMAT)
    return F.when(F.try_to_timestamp(value, fmt).isNotNull(), F.to_timestamp_ntz(value, fmt))


def effective_ts(local="txn_datetime_local", event="event_time") -> Column:
    """bank-local transaction time if parsed, else arrival time."""
    return F.coalesce(col_(local), col_(event))


def reasons_text(reasons: str | Column = "failure_reasons", sep: str = ",") -> Column:
    """reasons array → one display string ('' for an empty array, NULL stays NULL)."""
    return F.array_join(col_(reasons), sep)


EPOCH_NTZ = "1970-01-01 00:00:00"


def timestamp_micros(c: str | Column) -> Column:
    """epoch microseconds (as sent by the mail script) → UTC wall clock (timestamp_ntz).

    Built as epoch + interval so the result never depends on the session zone.
    """
    secs = (col_(c).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.to_timestamp_ntz(F.lit(EPOCH_NTZ)) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs)


def unix_micros_ntz(c: str | Column) -> Column:
    """Inverse of ``timestamp_micros`` for zone-less timestamps."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(EPOCH_NTZ)), col_(c))
