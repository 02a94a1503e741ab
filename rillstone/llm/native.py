"""Column helpers for the operators that stay within DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that part words.
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def words(text: Column) -> Column:
    """The runs of characters other than blanks."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def packed(high: Column, low: Column) -> Column:
    """A long with the low 40 bits of ``high`` above 24 bits of ``low``; sorting such longs is sorting primitives."""
    return F.shiftleft(high, 24).bitwiseOR(low.cast("long"))


def unpacked(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFF)).cast("int")


def same_high(x: Column, y: Column) -> Column:
    return F.shiftright(x.bitwiseXOR(y), 24) == 0


#: Texts of fewer words than this have their places packed; longer ones have structs instead, which take longer to sort.
PLACES = 1 << 24


class Packed:
    """Pairs of a hash's low 40 bits and a place below ``PLACES``, as longs."""

    make = staticmethod(packed)
    rank = staticmethod(lambda x: x)
    place = staticmethod(unpacked)
    same = staticmethod(same_high)


class Wide:
    """The same pairs in the same order, for any place."""

    make = staticmethod(lambda high, low: F.struct(F.shiftleft(high, 24).alias("r"), low.cast("int").alias("at")))
    rank = staticmethod(lambda x: x["r"])
    place = staticmethod(lambda x: x["at"])
    same = staticmethod(lambda x, y: x["r"] == y["r"])
