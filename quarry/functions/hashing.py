"""FNV-1a of 64 bits without overflow, on two 32-bit limbs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset basis 0xcbf29ce484222325 as two limbs; prime 0x100000001b3 = 2^40 + 435.
_HIGH, _LOW, _SMALL = 3421674724, 2216829733, 435
_MASK = 0xFFFFFFFF


def fnv1a64(text: Column) -> Column:
    """The hash of a string's UTF-8 bytes as 16 hexadecimal digits; for short strings (one step a byte)."""
    hexes = F.hex(F.encode(text, "UTF-8"))
    steps = F.when(F.length(hexes) > 0, F.sequence(F.lit(1), F.length(hexes) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = F.transform(steps, lambda i: F.conv(hexes.substr(i, F.lit(2)), 16, 10).cast("long"))
    start = F.struct(F.lit(_HIGH).cast("long").alias("h"), F.lit(_LOW).cast("long").alias("l"))

    def step(s: Column, b: Column) -> Column:
        x = s["l"].bitwiseXOR(b)
        low = x * _SMALL
        high = s["h"] * _SMALL + F.shiftright(low, 32) + x.bitwiseAND(F.lit(0xFFFFFF)) * 256
        return F.struct(high.bitwiseAND(F.lit(_MASK)).alias("h"), low.bitwiseAND(F.lit(_MASK)).alias("l"))

    done = F.aggregate(byte, start, step)
    return F.when(text.isNotNull(), F.lower(F.concat(F.lpad(F.hex(done["h"]), 8, "0"), F.lpad(F.hex(done["l"]), 8, "0"))))


def project_key(path: Column) -> Column:
    """A project's directory name: its folder's name and the hash of its whole path."""
    return F.concat_ws("-", F.regexp_extract(path, r"([^/]*)/*$", 1), fnv1a64(path))
