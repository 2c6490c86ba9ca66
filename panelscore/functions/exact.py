"""Exact sums of doubles and Python's rounding, as Column expressions (AGG-5, MTH-1).

A double is a whole number of a power of two, so a sum can be exact and independent of the order
of its rows. Values below 2**31 whose last bit is 2**-62 or higher (all two-decimal scores, and
nearly all others) are split into three whole numbers of 31 bits, which are summed as longs
with partial aggregation. The few other values of a group are kept as a list and added on the
full range of doubles when the group is complete. The sum is rounded to a double once.

The list is as long as the odd values of a group: judgments of one target, so at most its judges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BITS = 31
_MASK = (1 << _BITS) - 1
_WHOLE = "decimal(38,0)"
#: Places of the full range: 31 bits each, the first at 2**-1085 (below the smallest double), the last at 2**1023.
_FIRST, _PLACES = -1085, 69
#: The place whose unit is 2**-62, the unit of the sums of the common values.
_COMMON = (-62 - _FIRST) // _BITS


def with_parts(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """``df`` with the split columns of each named value (name -> column name), and ``_odd``: the values that need the list.

    ``_n_<name>``: the value in units of 2**-31, cut to a long (null unless it is below 2**31);
    ``_l_<name>``: what is left of it in units of 2**-62, null for a value that needs the list.
    """
    scale = f"{1 << _BITS}D"
    first = [f"cast(if(abs(`{c}`) < {scale}, `{c}` * {scale}, null) as bigint) as _n_{k}" for k, c in values.items()]
    rest = {k: f"((`{c}` * {scale} - _n_{k}) * {scale})" for k, c in values.items()}
    second = [f"if({r} = cast({r} as bigint), cast({r} as bigint), null) as _l_{k}" for k, r in rest.items()]
    odd = [f"if(`{c}` is not null and _l_{k} is null, named_struct('k', {i}, 'x', `{c}`), null)" for i, (k, c) in enumerate(values.items())]
    any_odd = " or ".join(f"(`{c}` is not null and _l_{k} is null)" for k, c in values.items())
    df = df.selectExpr("*", *first).selectExpr("*", *second)
    return df.selectExpr("*", f"if({any_odd}, array_compact(array({', '.join(odd)})), null) as _odd")


def sum_aggregates(values: Sequence[str], over=None) -> list[Column]:
    """Aggregates per value: three partial sums; and one list of odd values for all."""
    make = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    out = []
    for k in values:
        kept = f"if(_l_{k} is null, null, _n_{k})"
        for i, part in ((2, f"shiftright({kept}, {_BITS})"), (1, f"({kept} & {_MASK}L)"), (0, f"_l_{k}")):
            out.append(make(F.expr(f"sum({part})")).alias(f"_s{i}_{k}"))
    return [*out, make(F.collect_list("_odd")).alias("_odds")]


def _lit(n: int) -> Column:
    return F.lit(str(n)).cast(_WHOLE)


def _scaled(x: Column, power: Column) -> Column:
    """x * 2**power in two steps, so that the power itself neither overflows nor vanishes."""
    half = F.floor(power / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), power - half)


def _places(values: Column, common: Column) -> Column:
    """Sums by place of a list of doubles; ``common`` (units of 2**-62) is added at its place."""

    def at(j):
        low = _FIRST + _BITS * j
        unit = F.pow(F.lit(2.0), F.greatest(low, F.lit(-1074)))
        top = F.pow(F.lit(2.0), low + _BITS)  # an infinity from 2**1024 on: the remainder is then the value itself
        times = F.when(low < -1074, 1 << (-1074 - _FIRST)).otherwise(1)
        # the remainder by a power of two and the division by one are exact
        digit = lambda x: (((x % top) / unit).cast("bigint") * times).cast(_WHOLE)
        return F.aggregate(values, F.when(j == _COMMON, common).otherwise(_lit(0)).cast(_WHOLE), lambda acc, x: (acc + digit(x)).cast(_WHOLE))

    return F.transform(F.sequence(F.lit(0), F.lit(_PLACES - 1)), at)


def _carried(places: Column) -> Column:
    """Places with digits from 0 to 2**31 - 1, and the carry out of the last one (negative for a negative sum)."""
    start = F.struct(_lit(0).alias("carry"), F.array().cast("array<bigint>").alias("digits"))

    def step(acc, s):
        t = (s + acc["carry"]).cast(_WHOLE)
        d = F.pmod(t, _lit(1 << _BITS))
        return F.struct(((t - d) / _lit(1 << _BITS)).cast(_WHOLE).alias("carry"), F.concat(acc["digits"], F.array(d.cast("bigint"))).alias("digits"))

    return F.aggregate(places, start, step)


def _rounded(digits: Column) -> Column:
    """The double nearest to a number given by its digits (ties to even)."""
    # three places below the first, so that four can be read from any top place
    padded = F.concat(F.array(*[F.lit(0).cast("bigint")] * 3), digits)
    top = F.array_max(F.transform(padded, lambda d, i: F.when(d > 0, i)))
    at = lambda k: F.get(padded, (top - k).cast("int")).cast(_WHOLE)
    head = at(0)
    for k in (1, 2, 3):
        head = (head * _lit(1 << _BITS) + at(k)).cast(_WHOLE)
    below = F.exists(F.slice(padded, F.lit(1), F.greatest(top - 3, F.lit(0)).cast("int")), lambda d: d > 0)
    # a last bit that only says whether anything follows makes the one rounding of the cast right
    whole = (head * _lit(2) + F.when(below, _lit(1)).otherwise(_lit(0))).cast(_WHOLE)
    return F.when(top.isNull(), F.lit(0.0)).otherwise(_scaled(whole.cast("double"), _BITS * (top - 6) + F.lit(_FIRST - 1)))


def wide_sum(values: Column, common: Column) -> Column:
    """Exact sum of a list of doubles and ``common`` units of 2**-62; with an infinity the plain sum."""
    infinite = F.exists(values, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    plain = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    places = F.transform(F.array(F.lit(0)), lambda _: _places(values, common))
    up = F.transform(places, lambda p: F.struct(_carried(p).alias("c"), p.alias("p")))
    signed = F.transform(up, lambda u: F.when(u["c"]["carry"] < 0, -_rounded(_carried(F.transform(u["p"], lambda s: (-s).cast(_WHOLE)))["digits"])).otherwise(_rounded(u["c"]["digits"])))
    return F.when(infinite, plain).otherwise(signed[0])


def exact_sums(values: Sequence[str]) -> Column:
    """The sums as an array of doubles in the order of the names, from the columns of ``sum_aggregates``."""
    whole = lambda k, i: f"cast(coalesce(_s{i}_{k}, 0) as {_WHOLE})"
    up = lambda x: f"cast({x} * {1 << _BITS} as {_WHOLE})"
    added = lambda x, y: f"cast({x} + {y} as {_WHOLE})"
    commons = [added(up(added(up(whole(k, 2)), whole(k, 1))), whole(k, 0)) for k in values]
    mine = lambda k: F.transform(F.filter(F.flatten("_odds"), lambda o: o["k"] == k), lambda o: o["x"])
    wide = F.transform(F.expr(f"array({', '.join(commons)})"), lambda c, k: wide_sum(mine(k), c))
    plain = ", ".join(f"cast({c} as double) * {2.0**-62!r}D" for c in commons)
    return F.when(F.size("_odds") > 0, wide).otherwise(F.expr(f"array({plain})"))


def py_round(name: str, digits: int = 3) -> Column:
    """``round(x, digits)`` of Python of a column: by the double's exact binary value, ties to even (MTH-1).

    The fraction is compared with the middle between two results. Its nearest double decides
    unless the fraction equals it; then both are compared as whole numbers (units of 2**-62; a
    fraction below 2**-9 has finer bits, there of 2**-70: no middle is as small as 2**-12).
    From 2**43 on three digits change nothing (doubles are further apart), two from 2**46, one from 2**49.
    """
    if not 0 <= digits <= 3:
        raise ValueError("nought to three digits")
    ten = 10**digits
    x = f"abs(`{name}`)"
    whole, part = f"floor({x})", f"({x} - floor({x}))"
    low = f"floor({part} * {ten})"
    odd = f"(2 * {low} + 1)"
    middle = f"({odd} / {2 * ten}D)"
    beyond = " ".join(
        f"when {when} then cast(cast({part} * {float(1 << bits)!r}D as bigint) as decimal(19,0)) * {2 * ten} - cast({odd} as decimal(10,0)) * {1 << bits}"
        for when, bits in ((f"{part} < {2.0**-9!r}D", 70), ("true", 62))
    )
    beyond = f"(case {beyond} end)"
    up = f"if({part} > {middle} or ({part} = {middle} and ({beyond} > 0 or ({beyond} = 0 and {low} % 2 = 1))), 1, 0)"
    return F.expr(f"if({x} < {float(1 << 52 - 3 * digits)!r}D, signum(`{name}`) * ({whole} * {ten} + {low} + {up}) / {ten}D, `{name}`)")
