"""Quotients of whole numbers to 34 significant digits, rounded half to even, in columns of whole numbers only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

DIGITS, LIMB, LIMBS = 34, 9, 7


def quotient(num: Column, den: Column) -> Column:
    """num / den (whole numbers under 10^18, den above 0) as `coefficient E exponent`, the coefficient without trailing zeros.

    Long division gives the whole part and LIMBS times LIMB digits behind the point; what then remains only says whether
    the digits dropped are more than they show.  A null operand, or den not above 0, gives null.
    """
    wide = "decimal(38,0)"
    n, d = F.abs(num).cast(wide), den.cast(wide)
    first = F.struct((n % d).cast(wide).alias("r"), F.call_function("div", n, d).cast("string").alias("s"))

    def limb(acc: Column, i: Column) -> Column:
        up = (acc["r"].cast("decimal(19,0)") * F.lit(10**LIMB).cast("decimal(10,0)")).cast(wide)
        return F.struct((up % d).cast(wide).alias("r"), F.concat(acc["s"], F.lpad(F.call_function("div", up, d).cast("string"), LIMB, "0")).alias("s"))

    divided = F.aggregate(F.sequence(F.lit(1), F.lit(LIMBS)), first, limb)
    text = let(divided, lambda x: let(F.ltrim(x["s"], F.lit("0")), lambda s: _rounded(s, x["r"] > 0)))
    sign = F.when(num < 0, "-").otherwise("")
    return F.when(num == 0, "0E0").when(den > 0, F.concat(sign, text))


def _rounded(digits: Column, more: Column) -> Column:
    """The first DIGITS digits after rounding by the others, and by whether more than zeros follow them."""
    rest = F.substring(digits, DIGITS + 1, LIMB * LIMBS + DIGITS)
    dropped = F.length(rest)
    half = F.rpad(F.lit("5"), dropped, "0")
    kept = F.substring(digits, 1, DIGITS)
    odd = F.right(kept, F.lit(1)).cast("int") % 2 == 1
    up = (dropped > 0) & ((rest > half) | ((rest == half) & (more | odd)))
    whole = (kept.cast("decimal(38,0)") + F.when(up, 1).otherwise(0)).cast("string")
    return let(F.rtrim(whole, F.lit("0")), lambda c: F.concat(c, F.lit("E"), (dropped - LIMB * LIMBS + F.length(whole) - F.length(c)).cast("string")))
