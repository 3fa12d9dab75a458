"""The scalar math surface: Column in, Column out, all JVM-side.

Comparisons are ordered (a NaN makes every one false, unequal included) and division by zero gives the value the
caller names, since ANSI division raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column, at_zero: float = 0.0) -> Column:
    """a / b, and ``at_zero`` where b is 0."""
    return F.when(b == 0, F.lit(at_zero)).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def fmadd(a: Column, b: Column, c: Column) -> Column:
    return a * b + c


def fnmadd(a: Column, b: Column, c: Column) -> Column:
    return c - a * b


def fmsub(a: Column, b: Column, c: Column) -> Column:
    return a * b - c


def rsqrt(x: Column) -> Column:
    """1 / sqrt(x), and 0 at 0."""
    return safe_div(F.lit(1.0), F.sqrt(x))


def frsqrt(x: Column, prefactor: float = 1.0, steps: int = 1) -> Column:
    """prefactor / sqrt(x), and 0 at 0, by ``steps`` Newton steps y (3 - x y^2) / 2 from the value in single precision."""
    y = rsqrt(x).cast("float").cast("double")
    for _ in range(steps):
        y = y * (3.0 - x * y * y) * 0.5
    return y * prefactor


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def blend(a: Column, b: Column, mask: Column) -> Column:
    """b where the mask holds, a elsewhere."""
    return F.when(mask, b).otherwise(a)


def ordered(op: str, a: Column, b: Column) -> Column:
    """One of eq, ne, lt, le, gt, ge; false if a side is NaN."""
    made = {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[op]
    return ~F.isnan(a) & ~F.isnan(b) & made


def erf(x: Column, terms: int = 160) -> Column:
    """The error function: x e^(-x^2) 2/sqrt(pi) times the sum of (2 x^2)^k / (1 3 5 ... (2k + 1)), all terms of one sign;
    past 6 it is 1 in double precision."""
    a = F.least(F.abs(x), F.lit(6.0))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(acc, k):
        term = acc["term"] * 2.0 * a * a / (2.0 * k + 1.0)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"])
    return F.when(F.isnan(x), x).otherwise(F.signum(x) * F.least(F.lit(1.0), a * F.exp(-a * a) * 1.1283791670955126 * total))


#: every function of the surface by name, with its number of arguments
SURFACE = {
    "add": (2, lambda a, b: a + b), "sub": (2, lambda a, b: a - b), "mul": (2, lambda a, b: a * b), "div": (2, safe_div),
    "abs": (1, F.abs), "sqrt": (1, F.sqrt), "fmadd": (3, fmadd), "fnmadd": (3, fnmadd), "fmsub": (3, fmsub),
    "max": (2, F.greatest), "min": (2, F.least), "rsqrt": (1, rsqrt), "log": (1, F.log), "log2": (1, F.log2), "log10": (1, F.log10),
    "exp": (1, F.exp), "exp2": (1, exp2), "exp10": (1, exp10), "pow": (2, F.pow), "sin": (1, F.sin), "cos": (1, F.cos), "erf": (1, erf),
}
