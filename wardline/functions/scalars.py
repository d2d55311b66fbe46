"""Column helpers: text, dates, durations, move text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.scale import epoch


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- parsing -----------------------------------------------------------------

def combine_date_time(date: str | Column, time: str | Column, fmt: str = "dd/MM/yyyy HH:mm") -> Column:
    """Date text and time text as one timestamp; unreadable text gives null."""
    return F.try_to_timestamp(F.concat_ws(" ", _col(date), _col(time)), F.lit(fmt)).cast("timestamp_ntz")


def parse_censored(value: str | Column, text: str | Column, rules: dict[str, float]) -> Column:
    """Number of a reading whose text may be a bound, e.g. ``{">90": 90.1, ">6.0": 6.1}``.

    A bounded text is taken from ``rules``; otherwise the numeric value, else the text read as
    a number, else null.
    """
    shown = F.trim(_col(text))
    out = F.coalesce(_col(value).cast("double"), shown.try_cast("double"))
    for bound, number in rules.items():
        out = F.when(shown == bound, F.lit(float(number))).otherwise(out)
    return out


def parse_range_midpoint(text: str | Column) -> Column:
    """``20-21`` gives 20.5, ``47`` gives 47, anything else null."""
    parts = F.split(F.trim(_col(text)), r"\s*-\s*")
    numbers = F.transform(parts, lambda p: p.try_cast("double"))
    mid = (F.try_element_at(numbers, F.lit(1)) + F.try_element_at(numbers, F.lit(2))) / 2
    return F.when(F.size(parts) == 1, F.try_element_at(numbers, F.lit(1))).when(F.size(parts) == 2, mid)


def blank_to(c: str | Column, label: str) -> Column:
    """Null, empty or all-space text becomes ``label``."""
    col = _col(c)
    return F.when(col.isNull() | col.rlike(r"^\s*$"), F.lit(label)).otherwise(col)


def clean_name(c: str | Column, replacements: dict[str, str]) -> Column:
    """Replace plain substrings, in the given order."""
    col = _col(c)
    for old, new in replacements.items():
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


# --- dates and durations: units are boundaries crossed, as in SQL date-difference functions ---

def years_between(later: str | Column, earlier: str | Column) -> Column:
    return F.year(_col(later)) - F.year(_col(earlier))


def days_between(later: str | Column, earlier: str | Column) -> Column:
    return F.datediff(_col(later).cast("date"), _col(earlier).cast("date"))


def hours_between(later: str | Column, earlier: str | Column) -> Column:
    hour = 3_600_000_000
    return F.floor(epoch(_col(later)) / hour) - F.floor(epoch(_col(earlier)) / hour)


def elapsed_hours(later: str | Column, earlier: str | Column) -> Column:
    """Fractional hours."""
    return (epoch(_col(later)) - epoch(_col(earlier))) / F.lit(3_600_000_000.0)


def elapsed_days(later: str | Column, earlier: str | Column) -> Column:
    return elapsed_hours(later, earlier) / F.lit(24.0)


def start_of_day(ts: str | Column) -> Column:
    return _col(ts).cast("date").cast("timestamp_ntz")


def shifted(ts: str | Column, hours: float = 0, days: int = 0) -> Column:
    """Timestamp moved by a fixed interval (kept without zone)."""
    return _col(ts) + F.expr(f"INTERVAL '{int(round((hours + 24 * days) * 3600))}' SECOND")


def age_at(event: str | Column, anchor_year: str | Column, anchor_age: str | Column) -> Column:
    """Age in years: calendar years since the anchor year plus the age in that year."""
    return F.year(_col(event)) - _col(anchor_year) + _col(anchor_age)


def discharge_from_length(admission: str | Column, days: str | Column) -> Column:
    return F.date_add(_col(admission).cast("date"), _col(days).cast("int"))


# --- sequences ---------------------------------------------------------------

def parent_sequence(play: str | Column) -> Column:
    """All but the last element; the empty sequence has no parent."""
    col = _col(play)
    return F.when(F.size(col) > 0, F.slice(col, F.lit(1), F.size(col) - 1))


def last_move(play: str | Column) -> Column:
    return F.try_element_at(_col(play), F.lit(-1))


def prefixes(play: str | Column, max_depth: int | None = None) -> Column:
    """Every non-empty prefix up to ``max_depth``, shortest first."""
    col = _col(play)
    top = F.least(F.size(col), F.lit(max_depth)) if max_depth else F.size(col)
    return F.when(F.size(col) > 0, F.transform(F.sequence(F.lit(1), top), lambda n: F.slice(col, F.lit(1), n))
                  ).otherwise(F.array().cast("array<array<string>>"))


def move_text(play: str | Column) -> Column:
    """``1. e4 e5 2. Nf3``: the move number stands before each first-side move."""
    col = _col(play)
    numbered = F.transform(col, lambda m, i: F.when(
        i.bitwiseAND(F.lit(1)) == 0,
        F.concat(((i / 2).cast("int") + 1).cast("string"), F.lit(". "), m)).otherwise(m))
    return F.array_join(numbered, " ")


def drop_blanks(items: str | Column) -> Column:
    return F.filter(_col(items), lambda x: x.isNotNull() & (F.trim(x) != ""))
