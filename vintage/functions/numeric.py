"""Column expressions shared by every operator.

All of them are built-in Spark expressions (no UDF), so they stay inside
whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c, places: int) -> Column:
    """numpy-style rounding: ``rint(x * 10^d) / 10^d`` (half to even on the
    scaled value). Spark's ``round`` is half-up, which differs on ties."""
    scale = float(10 ** places)
    return F.rint(_c(c) * F.lit(scale)) / F.lit(scale)


def month_start(c) -> Column:
    """Truncate a date to the first day of its month (a monthly period)."""
    return F.trunc(_c(c), "MM")


def month_diff(later, earlier) -> Column:
    """Whole months between two monthly periods, as int."""
    a, b = _c(later), _c(earlier)
    return ((F.year(a) - F.year(b)) * 12 + (F.month(a) - F.month(b))).cast("int")


def nan_to_null(c) -> Column:
    c = _c(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def ltv_quotient(r_pc, discount_rate: float) -> Column:
    """``(r/100) / ((1 + d) - r/100)`` with float semantics: x/0 is ±infinity
    and 0/0 is missing (Spark's ANSI division would raise instead)."""
    num = _c(r_pc) / F.lit(100.0)
    den = (F.lit(1.0) + F.lit(float(discount_rate))) - num
    inf = F.lit(float("inf"))
    return (
        F.when(den == 0, F.when(num > 0, inf).when(num < 0, -inf))
        .otherwise(num / F.when(den == 0, F.lit(None)).otherwise(den))
    )


def stable_avg(c, places: int, over=None) -> Column:
    """Mean of values that carry ``places`` decimals, independent of the
    summation order: the scaled values are summed as exact integers.

    Infinite inputs keep float semantics (+inf, -inf, or missing for both).
    Aggregate expression: use inside ``agg``, or pass a window as ``over``.
    """
    c = _c(c)
    scale = float(10 ** places)
    agg = (lambda e: e.over(over)) if over is not None else (lambda e: e)
    finite = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    n_pos = agg(F.sum(F.when(c == F.lit(float("inf")), 1).otherwise(0)))
    n_neg = agg(F.sum(F.when(c == F.lit(float("-inf")), 1).otherwise(0)))
    cnt = agg(F.count(c))
    exact = F.when(cnt > 0, agg(F.sum(F.rint(finite * F.lit(scale)).cast("bigint")))
                   / (cnt * F.lit(scale)))
    return (
        F.when((n_pos > 0) & (n_neg > 0), F.lit(None).cast("double"))
        .when(n_pos > 0, F.lit(float("inf")))
        .when(n_neg > 0, F.lit(float("-inf")))
        .otherwise(exact)
    )


#: Units of the whole numbers that :func:`exact_sum` adds up.
LIMBS = tuple(2.0 ** k for k in (80, 40, 0, -40, -80))
#: From here on values are added as they are.
LIMIT = 2.0 ** 140


def exact_sum(c) -> Column:
    """Sum of doubles that doesn't depend on their order and needs no scale:
    each value is cut, exactly, into whole numbers of five units, which are
    added as whole numbers (partial aggregates of five bigints; nothing is
    collected). What a value has below 2^-80 is left off. Infinite values and
    those from 2^140 on give their own float sum. Aggregate expression."""
    x = _c(c)
    small = F.abs(x) < F.lit(LIMIT)
    rest, parts = F.when(small, x), []
    for unit in LIMBS:
        n = F.when(rest < 0, F.ceil(rest / F.lit(unit))).otherwise(F.floor(rest / F.lit(unit)))
        parts.append(F.sum(n).cast("double") * F.lit(unit))
        rest = F.when(small, x % F.lit(unit))  # exact, as all of this
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.coalesce(F.sum(F.when(~small, x)), total)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def fixed(c, places: int) -> Column:
    """Text of a double with ``places`` decimals as Python's ``f`` format
    prints it: the exact binary value decides, ties go to the even digit.

    The fraction f = x - floor(x) is exact; scaled by 2^62 it is a whole
    number, so the digit and its remainder are whole-number arithmetic. For
    short tables (labels): the steps are bound one by one, not compiled."""
    one, ten = F.lit(2 ** 62).cast("decimal(20,0)"), F.lit(10 ** places).cast("decimal(6,0)")

    def digits(size: Column) -> Column:
        part = ((size - F.floor(size)) * F.lit(float(2 ** 62))).cast("bigint").cast("decimal(20,0)")
        return _let((part * ten).cast("decimal(26,0)"), lambda scaled: _let(
            F.call_function("div", scaled, one), lambda digit: _let(
                ((scaled - digit.cast("decimal(10,0)") * one) * 2).cast("decimal(26,0)"), lambda twice: _let(
                    (F.floor(size).cast("decimal(20,0)") * ten + digit.cast("decimal(10,0)")).cast("decimal(30,0)"), lambda whole:
                    (whole + F.when((twice > one) | ((twice == one) & (whole % 2 == 1)), 1).otherwise(0)).cast("decimal(38,0)")))))

    def dotted(text: Column) -> Column:
        text = F.lpad(text, F.greatest(F.length(text), F.lit(places + 1)), F.lit("0"))
        return F.regexp_replace(text, f"(.{{{places}}})$", ".$1") if places else text

    def shown(x: Column) -> Column:
        size = F.abs(x)
        finite = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), dotted(digits(size).cast("string")))
        return (F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x), F.lit("nan")).when(x == F.lit(float("inf")), F.lit("inf"))
                .when(x == F.lit(float("-inf")), F.lit("-inf")).when(size < F.lit(1e18), finite)
                .otherwise(F.format_string(f"%.{places}f", x)))

    return _let(_c(c).cast("double"), shown)


def general(c) -> Column:
    """Text of a number of at most one decimal in Python's ``g`` format: six
    significant digits, no trailing zeros, an exponent from 10^6 on."""
    def shown(x: Column) -> Column:
        size = F.abs(x)
        short = F.regexp_replace(F.when(size < F.lit(99999.95), fixed(x, 1)).otherwise(fixed(x, 0)), r"\.0$", "")
        out = F.when(x.isNull(), F.lit(None).cast("string")).when(F.isnan(x) | (size == F.lit(float("inf"))), fixed(x, 1)).when(size < F.lit(999999.5), short)
        exact = x.try_cast("decimal(25,1)")
        for e in range(6, 18):
            at = F.bround(exact, 5 - e)
            text = F.regexp_replace((at / F.lit(10 ** e).cast("decimal(18,0)")).cast("decimal(10,5)").cast("string"), r"\.?0+$", "")
            out = out.when(F.abs(at) < F.lit(10 ** (e + 1)).cast("decimal(20,0)"), F.concat(text, F.lit(f"e+{e:02d}")))
        return out.otherwise(F.format_string("%.5e", x))

    return _let(_c(c).cast("double"), shown)
