"""Helpers shared by the operators: words, checkpoints in the shared folder, reading a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir, table

__all__ = ["broadcast_if_small", "count_words", "cut", "join_by_count", "shared_dir", "table", "words"]

#: What separates words in every operator: the space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def count_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


#: A kept table of at most so many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 20_000


def broadcast_if_small(kept: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """kept, a table that cut() returned, marked for broadcast if it has at most so many rows."""
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


#: No more than so many keys hold more than the like part of all rows each.
HOT_KEYS = 10_000


def join_by_count(left: DataFrame, right: DataFrame, on: list[str], n: str, rows: int, hint: str | None = None) -> DataFrame:
    """left (of so many rows, kept) joined to right, which has one row a key and in n its number of rows in left.

    Keys with a HOT_KEYS-th of the rows or more are at most HOT_KEYS: they are broadcast, so no row of theirs
    is shuffled. The others, none of which has more, are joined as Spark or the hint chooses.
    """
    least = max(2, -(-rows // HOT_KEYS))
    hot, rest = right.filter(F.col(n) >= least).drop(n), right.filter(F.col(n) < least).drop(n)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest.hint(hint) if hint else rest, on)
    return left.join(F.broadcast(hot), on).unionByName(cold)

#: DuckDB has no CRC-32: its table by eight steps for each byte, then one step for each byte of a list.
CRC_SQL = """
crc_steps AS (
  SELECT i, 0 AS k, i AS c FROM (SELECT unnest(range(256)) AS i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM crc_steps WHERE k = 8)"""


def crc32_sql(octets: str, tab: str = "tab") -> str:
    """CRC-32 of a list of bytes; tab is crc.tab, and WITH RECURSIVE has CRC_SQL."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c // 256, {tab}[xor(c % 256, b) + 1])), 4294967295)"
