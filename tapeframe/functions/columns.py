"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import COSTS, LOT_SHARES, Costs

# Offset of the local calendar year, text patterns of landed files.
LOCAL_YEAR_OFFSET = 1911
COMMON_SHARE = r"^[1-9]\d{3}$"
PERIOD_SEPARATOR = "[～~—－-]"
DETAIL_SEPARATOR = "、"
DETAIL_ENTRY = r"^(.+)\+(-?\d+)$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, null when b is zero or either side is null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct(a: str | Column, b: str | Column) -> Column:
    """Signed change of a against b in percent of the size of b."""
    a, b = col(a), col(b)
    return ratio((a - b) * 100, F.abs(b))


def pct_simple(a: str | Column, b: str | Column) -> Column:
    """(a - b) / b * 100, null unless b is positive."""
    a, b = col(a), col(b)
    return F.when(b > 0, ratio(a - b, b) * 100)


def half_up(c: str | Column, digits: int) -> Column:
    """Half-up rounding that ignores noise in the last bits of a computed mean."""
    scale = 10.0**digits
    return F.floor(F.round(col(c) * scale, 4) + 0.5) / scale


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound c from below and above; null stays null."""
    c = out = col(c)
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def vote(c: str | Column, up: float, down: float) -> Column:
    """+1 above ``up``, -1 below ``down``, 0 between or when null."""
    c = col(c)
    return F.when(c > up, 1).when(c < down, -1).otherwise(0)


def round_trip_return(entry: str | Column, exit_: str | Column, costs: Costs = COSTS) -> Column:
    """Return after both fees and the sales tax; 0 when the entry is not valid."""
    entry, exit_ = col(entry), col(exit_)
    gross = ratio(exit_, entry) * F.lit((1 - costs.sell) / (1 + costs.buy)) - 1
    return F.when((entry > 0) & exit_.isNotNull(), gross).otherwise(F.lit(0.0))


def number(c: str | Column) -> Column:
    """Text with thousands separators to double; anything unreadable becomes 0."""
    cleaned = F.regexp_replace(F.trim(col(c)), "[, ]", "")
    return F.coalesce(cleaned.try_cast("double"), F.lit(0.0))


def number_or_null(c: str | Column) -> Column:
    return F.regexp_replace(F.trim(col(c)), "[, ]", "").try_cast("double")


def shares_to_lots(c: str | Column) -> Column:
    """Truncates toward zero."""
    lots = col(c) / LOT_SHARES
    return F.when(lots < 0, F.ceil(lots)).otherwise(F.floor(lots)).cast("long")


def shares_to_lots_rounded(c: str | Column) -> Column:
    """Rounds half to even, as the borrowing balances do."""
    return F.bround(col(c) / LOT_SHARES).cast("long")


def local_date(c: str | Column) -> Column:
    """Local-calendar text (7 digits, any separators) to a date; null if unreadable."""
    digits = F.regexp_replace(col(c), r"\D", "")
    year = F.substring(digits, 1, 3).try_cast("int") + LOCAL_YEAR_OFFSET
    iso = F.concat_ws("-", year.cast("string"), F.substring(digits, 4, 2), F.substring(digits, 6, 2))
    return F.when(F.length(digits) == 7, iso.try_cast("date"))


def local_period(c: str | Column) -> tuple[Column, Column]:
    """First and last date of a period text; a single date is its own end."""
    parts = F.filter(F.split(F.trim(col(c)), PERIOD_SEPARATOR), lambda p: p.rlike(r"\d"))
    return local_date(F.get(parts, F.lit(0))), local_date(F.get(parts, F.size(parts) - 1))


def local_year(c: str | Column) -> Column:
    """Leading digits of a year text; local-calendar years become western years."""
    year = F.regexp_extract(col(c), r"^\s*(\d+)", 1).try_cast("int")
    return F.when(year < LOCAL_YEAR_OFFSET, year + LOCAL_YEAR_OFFSET).otherwise(year)


def detail_map(c: str | Column) -> Column:
    """``name+123、…`` to a map of name to lots; entries of another form are dropped."""
    entries = F.filter(F.split(col(c), DETAIL_SEPARATOR), lambda e: F.trim(e).rlike(DETAIL_ENTRY))
    pairs = F.transform(
        entries,
        lambda e: F.struct(
            F.regexp_extract(F.trim(e), DETAIL_ENTRY, 1).alias("name"),
            F.regexp_extract(F.trim(e), DETAIL_ENTRY, 2).cast("long").alias("lots"),
        ),
    )
    return F.map_from_entries(pairs)


def tags(*flags: tuple[Column, str | Column], limit: int | None = None) -> Column:
    """Array of the texts whose condition holds, in the given order."""
    texts = [F.when(cond, F.lit(t) if isinstance(t, str) else t) for cond, t in flags]
    out = F.array_compact(F.array(*texts))
    return F.slice(out, 1, limit) if limit else out


def tag_text(tags_: Column, sep: str = "|", empty: str = "-") -> Column:
    return F.when(F.size(tags_) > 0, F.array_join(tags_, sep)).otherwise(empty)


def contains_any(c: str | Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.coalesce(col(c), F.lit("")).contains(word)
    return out
