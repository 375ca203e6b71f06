"""Dimensions from a JPEG's headers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])

# Frame headers that carry dimensions, and markers without a length.
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
ALONE = {0x01, *range(0xD0, 0xD9)}


def dimensions(data: bytes | None) -> tuple[int, int] | None:
    """(width, height), or None for anything that is no JPEG with a whole frame header."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while True:
        at = data.find(b"\xff", at)
        while 0 <= at < len(data) and data[at] == 0xFF:
            at += 1
        if at < 1 or at >= len(data):
            return None
        marker, at = data[at], at + 1
        if marker in ALONE or marker == 0:
            continue
        if marker == 0xD9 or at + 2 > len(data):
            return None
        size = int.from_bytes(data[at : at + 2], "big")
        if marker in FRAMES:
            return (int.from_bytes(data[at + 5 : at + 7], "big"), int.from_bytes(data[at + 3 : at + 5], "big")) if at + 7 <= len(data) else None
        at += max(2, size)


@F.pandas_udf(SIZE)
def jpeg_dimensions(content: pd.Series) -> pd.DataFrame:
    found = [dimensions(c) or (None, None) for c in content]
    return pd.DataFrame(found, columns=["width", "height"]).astype("Int32")
