"""Columns from keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(key: Column) -> Column:
    """The 32-bit polynomial hash of a text's characters (base 31), unsigned; 0 for an empty text."""
    codes = F.transform(F.filter(F.split(key, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))


def key_colour(key: Column) -> Column:
    """A fixed colour for a key (24-bit RGB): the hue from the low 16 bits of its hash, saturation 0.55, value 0.85."""
    hue = key_hash(key).bitwiseAND(0xFFFF) / F.lit(65535.0) * 6

    def channel(n: int) -> Column:
        # distance of the hue from the channel's own, folded into [0, 1]
        k = F.pmod(hue + n, F.lit(6.0))
        return F.floor((0.85 - 0.85 * 0.55 * F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0)))) * 255 + 0.5)

    return (channel(5) * 65536 + channel(3) * 256 + channel(1)).cast("int")
