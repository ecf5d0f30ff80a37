"""Sums of doubles that are exact until they are rounded once, so no order or partitioning of rows changes them.

A double is cut into four digits of BITS bits under a bin, a multiple of BITS in its exponent. Digits of equal bins are summed as whole numbers, which any
partial aggregate can merge; the digits of all bins are then carried and rounded to the nearest double, ties to even. NaN and infinities are flags.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a digit and digits of a double: 60 bits below the bin's lowest hold the 53 of any double. Sums of digits of up to 2 ** 39 rows fit a long.
BITS, DIGITS = 20, 4
#: Bins of the least and the largest double.
LOW, HIGH = -54, 51
POSITIVE, NEGATIVE, NOT_A_NUMBER = 1, 2, 4

#: How a further aggregate is made of rows and then of partial ones.
Also = dict[str, tuple[Column, Callable[[str], Column]]]


def _power(half: Column) -> Column:
    """2.0 ** (BITS / 2 * half): half of a bin's power, as the whole of the least bin's is no double. Powers of two are exact."""
    return F.pow(F.lit(2.0), half * (BITS // 2))


def _bin(value: Column) -> Column:
    size = F.abs(value)
    finite = ~F.isnan(value) & (size < float("inf")) & (size > 0)
    return F.when(finite, F.floor(F.log2(size) / BITS).cast("int"))


def prepared(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """df with the bin and digits of every column named, once a row."""
    rows = df.withColumns({f"_v_{k}": c.cast("double") for k, c in sums.items()})
    rows = rows.withColumns({f"{k}_bin": _bin(F.col(f"_v_{k}")) for k in sums})
    rows = rows.withColumns({f"_r_{k}": F.when(F.col(f"{k}_bin").isNotNull(), F.col(f"_v_{k}") * _power(-F.col(f"{k}_bin")) * _power(-F.col(f"{k}_bin"))).otherwise(0.0) for k in sums})
    # Digit i is what stands before the point after i shifts, less what stood there before; shifts and remainders of doubles are exact.
    digit = lambda k, i: (F.col(f"_r_{k}") if i == 0 else (F.col(f"_r_{k}") * 2.0 ** (BITS * i)) % 2.0**BITS).cast("long")
    return rows.withColumns({f"{k}_{i}": digit(k, i) for k in sums for i in range(DIGITS)})


def digit_sums(sums: dict[str, Column]) -> list[Column]:
    """The aggregates of prepared rows, under <name>_bin as a further group."""
    made = []
    for k in sums:
        v = F.col(f"_v_{k}")
        odd = F.when(F.isnan(v), NOT_A_NUMBER).when(v == float("inf"), POSITIVE).when(v == float("-inf"), NEGATIVE).otherwise(0)
        made += [F.sum(f"{k}_{i}").alias(f"{k}_{i}") for i in range(DIGITS)] + [F.count(v).alias(f"{k}_n"), F.bit_or(odd).alias(f"{k}_odd")]
    return made


def partials(df: DataFrame, groups: list[str], sums: dict[str, Column], also: Also | None = None) -> DataFrame:
    """Partial sums: for each group and bin of the values <name>_bin, <name>_0 and on, <name>_n (values), <name>_odd, and what `also` names.

    Partial rows of parts of a table, or of batches of a stream, are those of the whole when their columns are summed (_odd: or-ed).
    """
    rows = prepared(df, sums)
    return rows.groupBy(*groups, *[f"{k}_bin" for k in sums]).agg(*digit_sums(sums), *[c.alias(n) for n, (c, _) in (also or {}).items()])


def merged(rows: DataFrame, groups: list[str], sums: list[str], also: Also | None = None) -> DataFrame:
    """Sums of partial rows: a group's `name` and <name>_n, and what `also` names. A group has a few rows, one for each bin its values fall in."""
    made = []
    for k in sums:
        made += [F.collect_list(F.struct(F.col(f"{k}_bin").alias("bin"), F.array(*[F.col(f"{k}_{i}") for i in range(DIGITS)]).alias("digits"))).alias(f"_x_{k}"), F.sum(f"{k}_n").alias(f"{k}_n"), F.bit_or(f"{k}_odd").alias(f"_o_{k}")]
    made += [f(n).alias(n) for n, (_, f) in (also or {}).items()]
    return _rounded(rows.groupBy(*groups).agg(*made), sums)


def exact_sums(df: DataFrame, groups: list[str], sums: dict[str, Column], also: Also | None = None) -> DataFrame:
    """Groups with the exact sum of every column named, rounded once, <name>_n, how many values it has, and further aggregates.

    As math.fsum: NaN if a value is, or if infinities of both signs are; an infinity with one sign; NULL values are left out and a group of none is NULL;
    beyond the largest double an infinity.
    """
    return merged(partials(df, groups, sums, also), groups, list(sums), also)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    """Replace each group's bins and flags by the nearest double."""
    shift = lambda way, x, n: F.call_function(way, x, n)
    zero, radix = F.lit(0).cast("long"), 2**BITS
    each = lambda made: {f"{c}_{n}": x for n in names for c, x in made(n).items()}
    col = lambda c, n: F.col(f"{c}_{n}")

    def carried(n: str) -> dict[str, Column]:
        """Sums of digits by place from the lowest, and whether they are below zero."""
        terms = F.filter(f"_x_{n}", lambda t: t["bin"].isNotNull())
        low, high = F.array_min(F.transform(terms, lambda t: t["bin"])) - (DIGITS - 1), F.array_max(F.transform(terms, lambda t: t["bin"]))
        at = lambda p: F.aggregate(terms, zero, lambda a, t: a + F.coalesce(F.get(t["digits"], F.when(t["bin"] >= p, t["bin"] - p)), zero))
        return {"_low": low, "_sums": F.when(F.size(terms) > 0, F.transform(F.sequence(low, high), at))}

    def digits(n: str) -> dict[str, Column]:
        """Digits from the lowest, each below the radix, of the sum without its sign; three more take the last carry."""
        sums = F.transform(f"_sums_{n}", lambda a: F.when(col("_below", n), -a).otherwise(a))
        state = F.struct(F.array().cast("array<bigint>").alias("done"), zero.alias("carry"))
        step = lambda s, a: F.struct(F.array_append(s["done"], (s["carry"] + a) - shift("shiftright", s["carry"] + a, F.lit(BITS)) * radix).alias("done"), shift("shiftright", s["carry"] + a, F.lit(BITS)).alias("carry"))
        return {"_all": F.aggregate(F.concat(sums, F.array(zero, zero, zero)), state, step)["done"]}

    def value(n: str) -> dict[str, Column]:
        top, k = col("_top", n), F.length(F.bin(F.get(f"_all_{n}", col("_top", n))))
        digit = lambda i: F.coalesce(F.get(f"_all_{n}", F.when(top >= i, top - i)), zero)
        # 62 bits from the first that is set; the lowest also stands for any bit below, so that one rounding of a long is that of the sum.
        upper = shift("shiftleft", digit(0), F.lit(62) - k) + shift("shiftleft", digit(1), F.lit(42) - k) + shift("shiftleft", digit(2), F.lit(22) - k)
        third = F.when(k <= 2, shift("shiftleft", digit(3), F.lit(2) - k)).otherwise(shift("shiftright", digit(3), k - 2))
        lost = F.when(k <= 2, zero).otherwise(digit(3) - shift("shiftleft", shift("shiftright", digit(3), k - 2), k - 2))
        sticky = (lost > 0) | F.exists(F.slice(f"_all_{n}", 1, F.greatest(top - 3, F.lit(0))), lambda a: a > 0)
        bits = (upper + third).bitwiseOR(F.when(sticky, 1).otherwise(0).cast("long"))
        # The exponent comes back in two factors, of which only the last can round, and only beyond the largest double.
        whole = bits.cast("double") * shift("shiftleft", F.lit(1).cast("long"), k - 1).cast("double") * 2.0**-61
        place = top + col("_low", n)
        signed = F.coalesce(whole * _power(place) * _power(place) * F.when(col("_below", n), -1).otherwise(1), F.lit(0.0))
        odd, both = col("_o", n), POSITIVE | NEGATIVE
        flagged = F.when((odd.bitwiseAND(NOT_A_NUMBER) > 0) | (odd.bitwiseAND(both) == both), float("nan")).when(odd == POSITIVE, float("inf")).when(odd == NEGATIVE, float("-inf")).otherwise(signed)
        return {"_y": F.when(F.col(f"{n}_n") > 0, flagged)}

    df = df.withColumns(each(carried))
    df = df.withColumns(each(lambda n: {"_below": F.aggregate(f"_sums_{n}", zero, lambda c, a: shift("shiftright", c + a, F.lit(BITS))) < 0}))
    df = df.withColumns(each(digits))
    df = df.withColumns(each(lambda n: {"_top": F.array_max(F.transform(f"_all_{n}", lambda a, i: F.when(a > 0, i)))}))
    kept = [c for c in df.columns if c not in {f"{x}_{n}" for n in names for x in ("_x", "_o", "_low", "_sums", "_below", "_all", "_top")}]
    return df.select(*kept, *[value(n)["_y"].alias(n) for n in names])
