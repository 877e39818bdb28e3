"""Reproducible pseudo-random numbers from ids, by 64-bit arithmetic that wraps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW, _TOP = (1 << 22) - 1, (1 << 20) - 1
# Multipliers of the mixing function.
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it; keeps expressions from growing."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def wrapping_multiply(c: Column, factor: int) -> Column:
    """The product modulo 2**64, in limbs of 22, 22 and 20 bits: no product overflows, so ANSI mode allows it."""
    low, k = F.lit(_LOW), (factor & _LOW, factor >> 22 & _LOW, factor >> 44)

    def product(v: Column) -> Column:
        a = [v.bitwiseAND(low), F.shiftrightunsigned(v, 22).bitwiseAND(low), F.shiftrightunsigned(v, 44)]
        p0 = a[0] * k[0]
        p1 = a[0] * k[1] + a[1] * k[0] + F.shiftrightunsigned(p0, 22)

        def rest(m: Column) -> Column:
            p2 = a[0] * k[2] + a[1] * k[1] + a[2] * k[0] + F.shiftrightunsigned(m, 22)
            top = F.shiftleft(p2.bitwiseAND(F.lit(_TOP)), 44)
            return p0.bitwiseAND(low).bitwiseOR(F.shiftleft(m.bitwiseAND(low), 22)).bitwiseOR(top)

        return let(p1, rest)

    return let(c, product)


def wrapping_add(c: Column, term: int) -> Column:
    """The sum modulo 2**64, in halves."""
    mask = (1 << 32) - 1

    def total(v: Column) -> Column:
        low = v.bitwiseAND(F.lit(mask)) + (term & mask)
        high = F.shiftrightunsigned(v, 32) + (term >> 32 & mask) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(mask)))

    return let(c, total)


def mix(value: Column) -> Column:
    """24 well-mixed bits of a 64-bit number, as a number in [0, 1)."""
    shifted = lambda c, n: let(c, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, n)))
    first = wrapping_multiply(shifted(value, 30), MULTIPLIERS[0])
    second = wrapping_multiply(shifted(first, 27), MULTIPLIERS[1])
    return F.shiftrightunsigned(shifted(second, 31), 40).cast("double") / float(1 << 24)


def uniform(source_id: Column, seed: int) -> Column:
    """A number in [0, 1) for each id and seed, the same on every machine and in every order."""
    return mix(source_id.cast("long").bitwiseXOR(F.lit(_signed(seed))))


def with_uniforms(rows: DataFrame, source_id: Column, **seeds: int) -> DataFrame:
    """`rows` with uniform(source_id, seed) under each name.

    Every step of the mixing is a column that the next one reads, which Spark compiles and computes once a row; an
    expression of its own has to bind its values by functions that are interpreted. Of the last product, the bits that
    mix takes stand above all that its last shift changes.
    """
    low, top = F.lit(_LOW), F.lit(_TOP)
    col = lambda what, name: F.col(f"__{what}_{name}")
    step = lambda df, what, value: df.withColumns({f"__{what}_{name}": value(name) for name in seeds})

    def limbs(v: Column) -> list[Column]:
        return [v.bitwiseAND(low), F.shiftrightunsigned(v, 22).bitwiseAND(low), F.shiftrightunsigned(v, 44)]

    def middle(v: Column, k: tuple[int, int, int]) -> Column:
        a = limbs(v)
        return a[0] * k[1] + a[1] * k[0] + F.shiftrightunsigned(a[0] * k[0], 22)

    def upper(v: Column, m: Column, k: tuple[int, int, int]) -> Column:
        a = limbs(v)
        return (a[0] * k[2] + a[1] * k[1] + a[2] * k[0] + F.shiftrightunsigned(m, 22)).bitwiseAND(top)

    def product(v: Column, m: Column, k: tuple[int, int, int]) -> Column:
        return (v.bitwiseAND(low) * k[0]).bitwiseAND(low).bitwiseOR(F.shiftleft(m.bitwiseAND(low), 22)).bitwiseOR(F.shiftleft(upper(v, m, k), 44))

    one, two = ((f & _LOW, f >> 22 & _LOW, f >> 44) for f in MULTIPLIERS)
    out = step(rows, "i", lambda name: source_id.cast("long").bitwiseXOR(F.lit(_signed(seeds[name]))))
    out = step(out, "v", lambda name: col("i", name).bitwiseXOR(F.shiftrightunsigned(col("i", name), 30)))
    out = step(out, "m", lambda name: middle(col("v", name), one))
    out = step(out, "p", lambda name: product(col("v", name), col("m", name), one))
    out = step(out, "w", lambda name: col("p", name).bitwiseXOR(F.shiftrightunsigned(col("p", name), 27)))
    out = step(out, "n", lambda name: middle(col("w", name), two))
    bits = lambda name: F.shiftrightunsigned(col("n", name).bitwiseAND(low), 18).bitwiseOR(F.shiftleft(upper(col("w", name), col("n", name), two), 4))
    return out.select(*(F.col(f"`{c}`") for c in rows.columns if c not in seeds), *((bits(name).cast("double") / float(1 << 24)).alias(name) for name in seeds))
