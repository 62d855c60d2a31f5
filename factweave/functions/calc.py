"""Financial arithmetic in decimals. Each calculator returns struct<value, reason>: a value or why there is none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import VALUE


def decimal(text: Column) -> Column:
    return F.trim(text.cast("string")).try_cast(VALUE)


def decimal_string(value: Column, places: int = 4) -> Column:
    """Half-up rounded, without trailing zeros."""
    fixed = F.round(value.cast(VALUE), places).cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def _result(value: Column, places: int, *guards: tuple[Column, str]) -> Column:
    reason = F.lit(None).cast("string")
    for broken, why in reversed(guards):
        reason = F.when(broken, why).otherwise(reason)
    return F.struct(F.when(reason.isNull(), F.round(value, places).cast(VALUE)).alias("value"), reason.alias("reason"))


def _missing(*inputs: Column) -> tuple[Column, str]:
    out = F.lit(False)
    for c in inputs:
        out = out | c.isNull()
    return out, "input missing"


def _part(a: Column, b: Column) -> Column:
    """a / b, null instead of an error for b = 0."""
    return a.cast(VALUE) / F.nullif(b.cast(VALUE), F.lit(0).cast(VALUE))


def upside(target: Column, price: Column) -> Column:
    return _result((_part(target, price) - 1) * 100, 2, _missing(target, price), (price == 0, "price is zero"))


def margin(part: Column, whole: Column) -> Column:
    return _result(_part(part, whole) * 100, 2, _missing(part, whole), (whole == 0, "revenue is zero"))


def ev_from_multiple(metric: Column, multiple: Column) -> Column:
    return _result(metric.cast(VALUE) * multiple.cast(VALUE), 4, _missing(metric, multiple))


def equity_from_ev(ev: Column, net_debt: Column, investments: Column | None = None, minority: Column | None = None, other: Column | None = None) -> Column:
    zero = F.lit(0).cast(VALUE)
    extra = lambda c: zero if c is None else F.coalesce(c.cast(VALUE), zero)
    return _result(ev.cast(VALUE) - net_debt.cast(VALUE) + extra(investments) - extra(minority) + extra(other), 4, _missing(ev, net_debt))


def target_from_equity(equity: Column, shares: Column) -> Column:
    return _result(_part(equity, shares), 2, _missing(equity, shares), (shares == 0, "share count is zero"))


def target_from_eps(eps: Column, pe: Column) -> Column:
    return _result(eps.cast(VALUE) * pe.cast(VALUE), 2, _missing(eps, pe))


def free_cash_flow(ocf: Column, capex: Column) -> Column:
    return _result(ocf.cast(VALUE) - F.abs(capex.cast(VALUE)), 4, _missing(ocf, capex))


def growth(current: Column, prior: Column) -> Column:
    return _result((_part(current, prior) - 1) * 100, 2, _missing(current, prior), (prior == 0, "prior is zero"), (prior < 0, "prior is negative"))


def cagr(start: Column, end: Column, years: Column) -> Column:
    ratio = end.cast("double") / F.nullif(start.cast("double"), F.lit(0.0))
    value = (F.pow(ratio, F.lit(1.0) / F.nullif(years.cast("double"), F.lit(0.0))) - 1) * 100
    safe = F.when((start > 0) & (ratio > 0) & (years > 0), value.cast(VALUE))
    return _result(safe, 2, _missing(start, end, years), (start <= 0, "start is not positive"), (years <= 0, "no years"), (ratio <= 0, "ratio is not positive"))


def agrees(reported: Column, computed: Column, tolerance: float) -> Column:
    """Within a share of the reported value (of the computed one if that is zero); nulls never agree."""
    r, c = reported.cast(VALUE), computed.cast(VALUE)
    base = F.abs(F.when(r == 0, c).otherwise(r))
    return F.coalesce(F.abs(r - c) <= base * F.lit(str(tolerance)).cast("decimal(6,4)"), F.lit(False))


def delta_pct(reported: Column, computed: Column) -> Column:
    r, c = reported.cast(VALUE), computed.cast(VALUE)
    base = F.abs(F.when(r == 0, c).otherwise(r))
    return F.when((r == 0) & (c == 0), F.lit(0).cast(VALUE)).otherwise(F.round(_part(c - r, base) * 100, 4).cast(VALUE))


def same_value(a: Column, b: Column, tolerance: str = "0.005") -> Column:
    """Agreement when facts are merged: null with null only, else within a share of the larger magnitude."""
    x, y = a.cast(VALUE), b.cast(VALUE)
    near = F.abs(x - y) <= F.greatest(F.abs(x), F.abs(y)) * F.lit(tolerance).cast("decimal(6,4)")
    return F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(near)
