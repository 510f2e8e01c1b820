"""Comparing works attribute by attribute: ordered overlaps, graded status, what may be disclosed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key

ARRAYS = {"genre": "genres", "cast": "actors", "director": "directors", "production_house": "houses", "music_director": "music", "writer": "writers"}
CREW = ["director", "production_house", "music_director", "writer"]
ATTRIBUTES = ["year", *ARRAYS]


def keys_of(values: Column) -> Column:
    return F.transform(values, name_key)


def with_keys(works: DataFrame) -> DataFrame:
    """The comparison keys of each array, once a work: columns k_<array>."""
    return works.withColumns({f"k_{c}": keys_of(F.col(c)) for c in ARRAYS.values()})


def year_status(guess: Column, mystery: Column) -> Column:
    """G1: struct<status, direction, mystery>; the year itself only where both agree."""
    known = guess.isNotNull() & mystery.isNotNull()
    status = F.when(~known, "unknown").when(guess == mystery, "correct").otherwise("absent")
    direction = F.when(~known, "unknown").when(guess == mystery, "same").when(mystery > guess, "later").otherwise("earlier")
    return F.struct(status.alias("status"), direction.alias("direction"), F.when(known & (guess == mystery), mystery).alias("mystery"))


def overlap(guess: Column, guess_keys: Column, mystery_keys: Column) -> Column:
    """What both hold, in the order and spelling of the guess, each key once."""

    def shared(x: Column, i: Column) -> Column:
        k = F.get(guess_keys, i)
        return (k != "") & F.array_contains(mystery_keys, k) & (F.array_position(guess_keys, k) == i + 1)

    return F.filter(guess, shared)


def set_status(guess: Column, mystery: Column, guess_keys: Column, mystery_keys: Column, common: Column) -> Column:
    """Unknown where one side holds nothing at all; correct where the key sets agree."""
    same = (F.size(F.array_except(F.array_remove(guess_keys, ""), mystery_keys)) == 0) & (
        F.size(F.array_except(F.array_remove(mystery_keys, ""), guess_keys)) == 0
    )
    return F.when((F.size(guess) == 0) | (F.size(mystery) == 0), "unknown").when(F.size(common) == 0, "absent").when(same, "correct").otherwise("partial")


def cast_overlap(guess: Column, guess_keys: Column, mystery_keys: Column) -> Column:
    """array<struct<name, guess_position, mystery_position>>, positions from 1 in the raw lists."""
    placed = F.transform(
        guess,
        lambda x, i: F.struct(
            x.alias("name"),
            (i + 1).alias("guess_position"),
            F.array_position(mystery_keys, F.get(guess_keys, i)).cast("int").alias("mystery_position"),
            F.get(guess_keys, i).alias("key"),
        ),
    )
    kept = F.filter(placed, lambda p: (p["key"] != "") & (p["mystery_position"] > 0) & (F.array_position(guess_keys, p["key"]) == p["guess_position"]))
    return F.transform(kept, lambda p: F.struct(p["name"].alias("name"), p["guess_position"].alias("guess_position"), p["mystery_position"].alias("mystery_position")))


def compare(pairs: DataFrame) -> DataFrame:
    """Pairs holds a guess in g_* and a mystery in m_* (columns of with_keys); adds is_correct, year_result,
    common_<attribute>, status_<attribute> and cast_matches."""
    out = pairs.withColumns(
        {"is_correct": F.col("g_movie_id") == F.col("m_movie_id"), "year_result": year_status(F.col("g_year"), F.col("m_year"))}
        | {f"common_{a}": overlap(F.col(f"g_{c}"), F.col(f"g_k_{c}"), F.col(f"m_k_{c}")) for a, c in ARRAYS.items()}
        | {"cast_matches": cast_overlap(F.col("g_actors"), F.col("g_k_actors"), F.col("m_k_actors"))}
    )
    return out.withColumns(
        {
            f"status_{a}": set_status(F.col(f"g_{c}"), F.col(f"m_{c}"), F.col(f"g_k_{c}"), F.col(f"m_k_{c}"), F.col(f"common_{a}"))
            for a, c in ARRAYS.items()
        }
    )


def side(works: DataFrame, prefix: str) -> DataFrame:
    return works.select(*[F.col(c).alias(f"{prefix}_{c}") for c in works.columns])


def disclosed(compared: DataFrame, over: Column) -> DataFrame:
    """What a player may see; the mystery's id, title and positions only once the session is over."""
    shown = F.transform("cast_matches", lambda p: F.struct(p["name"].alias("name"), p["guess_position"].alias("position")))
    return compared.select(
        F.col("g_movie_id").alias("movie_id"),
        F.col("g_title").alias("title"),
        "is_correct",
        F.col("year_result.status").alias("year_status"),
        F.col("year_result.direction").alias("year_direction"),
        F.col("year_result.mystery").alias("year_mystery"),
        shown.alias("cast_common"),
        F.size("cast_matches").alias("cast_count"),
        *[f"status_{a}" for a in ARRAYS],
        *[f"common_{a}" for a in ARRAYS if a != "cast"],
        F.when(over, F.col("m_movie_id")).alias("mystery_id"),
        F.when(over, F.col("m_title")).alias("mystery_title"),
    )


def revealed() -> Column:
    """Attributes that one guess reveals in full; one shared value of the crew is enough."""
    year = F.when(F.col("year_result.status") == "correct", "year")
    return F.array_compact(F.array(year, *[F.when(F.size(f"common_{a}") > 0, a) for a in CREW]))


def shared_values() -> Column:
    """array<struct<attribute, values>> of what a guess put on the board."""
    year = F.when(F.col("year_result.mystery").isNotNull(), F.array(F.col("year_result.mystery").cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = [F.struct(F.lit("year").alias("attribute"), year.alias("values"))]
    rows += [F.struct(F.lit(a).alias("attribute"), F.col(f"common_{a}").alias("values")) for a in ARRAYS]
    return F.array(*rows)


def attribute_values(prefix: str = "") -> Column:
    """array<struct<attribute, values>> of a work's cells, in display order."""
    c = lambda name: F.col(prefix + name)
    year = F.when(F.coalesce(c("year"), F.lit(0)) != 0, F.array(c("year").cast("string"))).otherwise(F.array().cast("array<string>"))
    rows = [F.struct(F.lit("year").alias("attribute"), year.alias("values"))]
    rows += [F.struct(F.lit(a).alias("attribute"), c(col).alias("values")) for a, col in ARRAYS.items()]
    return F.array(*rows)


def n_shared() -> Column:
    return reduce(lambda a, b: a + b, [F.size(f"common_{a}") for a in ARRAYS]) + F.col("year_result.mystery").isNotNull().cast("int")
