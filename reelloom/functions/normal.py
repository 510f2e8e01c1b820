"""Unicode normal forms, for the rows that need them and no others.

A Python function inside CASE would run for every row, so the rows are parted by a filter: those
that the function cannot change stay in the JVM, the others take one Arrow stage, and both are put together again.
"""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def composed(text: str) -> str:
    """Entities unescaped, canonical composition."""
    return unicodedata.normalize("NFC", html.unescape(text))


def bare(text: str) -> str:
    """Compatibility decomposition without combining marks."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def _column(function):
    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else function(t))

    return apply


def _parted(df: DataFrame, source: Column, out: str, needs: Column, function) -> DataFrame:
    odd = F.coalesce(needs, F.lit(False))
    return df.filter(~odd).withColumn(out, source).unionByName(df.filter(odd).withColumn(out, _column(function)(source)))


#: Odd characters that are as near as this make one range, which is looked at faster than many.
NEAR = 64


@cache
def uncomposed() -> str:
    """A pattern of what composition or unescaping may change: characters that are marks, have another form or join the one before; entities.

    A text of other characters alone is in composed form already, whatever their order. Ranges that lie
    near each other are one, and all lie above U+0300, so that most characters are settled by one look.
    """
    joins = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul
    odd = set()
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        parts = unicodedata.decomposition(c).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            joins.add(int(parts[1], 16))
        if unicodedata.combining(c) or unicodedata.category(c) in ("Cn", "Cs") or unicodedata.normalize("NFC", c) != c:
            odd.add(code)
    ends = []
    for code in sorted(odd | joins):
        if ends and ends[-1][1] >= code - NEAR:
            ends[-1][1] = code
        else:
            ends.append([code, code])
    return f"[\\x{{{ends[0][0]:X}}}-\\x{{10FFFF}}&&[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ends) + "]]|&[#A-Za-z]"


def with_composed(df: DataFrame, source: str, out: str) -> DataFrame:
    c = F.col(source)
    return _parted(df, c, out, c.rlike(r"[^\x00-\x7F]|&") & c.rlike(uncomposed()), composed)


def with_bare(df: DataFrame, source: str, out: str) -> DataFrame:
    c = F.col(source)
    return _parted(df, c, out, c.rlike(r"[^\x00-\x7F]"), bare)
