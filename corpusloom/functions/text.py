"""Column expressions on strings and numbers. Positions are 0-based code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substr0(text: Column, start, length=None) -> Column:
    """``length`` code points from 0-based ``start`` (to the end if None)."""
    at = start if isinstance(start, Column) else F.lit(start)
    size = F.lit(2**31 - 1) if length is None else length if isinstance(length, Column) else F.lit(length)
    return F.substring(text, (at + 1).cast("int"), size.cast("int"))


def floor_log2(v: Column) -> Column:
    """Floor of the binary logarithm from the number of binary digits; 0 for 0."""
    return F.when(v == 0, F.lit(0)).otherwise(F.length(F.bin(v)) - 1).cast("int")


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: binary digits of the answer from the highest down.

    The step count is a logarithm of the shorter length, so there is no cap.
    """
    most = F.least(F.length(a), F.length(b))
    steps = F.reverse(F.sequence(F.lit(0), floor_log2(F.greatest(most, F.lit(1)))))

    def add(done: Column, step: Column) -> Column:
        size = F.pow(F.lit(2), step).cast("int")
        same = (done + size <= most) & (F.substring(a, done + 1, size) == F.substring(b, done + 1, size))
        return F.when(same, done + size).otherwise(done)

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(steps, F.lit(0), add))


def trim_terminators(text: Column) -> Column:
    """Drops one trailing line break, then one trailing ``$``."""
    return F.regexp_replace(F.regexp_replace(text, "[\n\r]\\z", ""), "\\$\\z", "")


def substitute_separators(text: Column) -> Column:
    """``%`` and ``X`` become the terminator ``$``."""
    return F.translate(text, "%X", "$$")


def printable(symbol: Column) -> Column:
    """A two-character picture of a symbol: escapes, ' c', or two hexadecimal digits (more for larger code points)."""
    code = F.ascii(symbol)
    return (
        F.when(symbol == " ", "\\s").when(symbol == "\n", "\\n").when(symbol == "\r", "\\l").when(symbol == "\t", "\\t")
        .when((code > 32) & (code < 127), F.concat(F.lit(" "), symbol))
        .otherwise(F.lower(F.when(code < 16, F.concat(F.lit("0"), F.hex(code))).otherwise(F.hex(code))))
    )


def pictured(name: str, text: Column) -> Column:
    """``name`` and the pictures of all symbols of ``text``."""
    marks = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), printable)
    return F.concat_ws(" ", F.lit(name), F.array_join(marks, ""))


def prefix_less(a: Column, b: Column) -> Column:
    """Whether ``a`` sorts before ``b`` up to the end of the shorter."""
    m = F.least(F.length(a), F.length(b))
    return F.left(a, m) < F.left(b, m)
