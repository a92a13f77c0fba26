"""Documents as one row each, with their lines as an array.

Lines of one document are few, so after one shuffle on the document's key everything that
looks at several of its lines is a function of an array: no further exchange, sort or join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from idweft.functions.columns import blank, let, squeeze

__all__ = ["after", "before", "centre_x", "centre_y", "conf_for", "conf_of", "first", "full_text", "height", "let", "nearest", "pages", "place", "reading_order", "staged", "stages_of", "text_of", "until"]
LINE = ("y1", "x1", "region_idx", "text", "conf", "x2", "y2")


def pages(regions: DataFrame, keys: tuple[str, ...] = ("doc_id",), **more: Column) -> DataFrame:
    """``keys, lines, ordered, full_text``: input order, reading order, upper-cased text.

    ``more`` are further aggregates over a document's lines, by name.

    Reading order is top to bottom, then left to right, ties by input order. A null text or
    confidence counts as '' or 0.
    """
    line = F.struct("y1", "x1", "region_idx", blank(F.col("text")).alias("text"), F.coalesce("conf", F.lit(0.0)).alias("conf"), "x2", "y2")
    got = regions.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("ordered"), *[c.alias(n) for n, c in more.items()])
    by_input = F.transform(F.array_sort(F.transform("ordered", lambda x: F.struct(x["region_idx"].alias("i"), x.alias("line")))), lambda x: x["line"])
    got = got.withColumn("lines", by_input)
    text = F.array_join(F.transform(F.filter("lines", lambda x: x["text"] != ""), lambda x: x["text"]), "\n")
    return got.withColumn("full_text", F.upper(text)).select(*keys, "lines", "ordered", "full_text", *more)


_made: dict[tuple, list[dict[str, Column]]] = {}


def stages_of(df: DataFrame, make: Callable[..., list[dict[str, Column]]], *args) -> list[dict[str, Column]]:
    """What ``make(*args)`` gives: columns by stage, each naming the columns that it reads.

    They fit any table with those columns, so they're made once for an application: a large
    job has thousands of expressions, and to make them takes longer than to plan them.
    """
    key = (df.sparkSession.sparkContext.applicationId, make, *args)
    if key not in _made:
        _made[key] = make(*args)
    return _made[key]


def staged(df: DataFrame, make: Callable[..., list[dict[str, Column]]], *args) -> DataFrame:
    """``df`` with the columns of every stage added or replaced."""
    for stage in stages_of(df, make, *args):
        df = df.withColumns(stage)
    return df


def reading_order(regions: DataFrame, keys: tuple[str, ...] = ("doc_id", "attempt")) -> DataFrame:
    """Every region with its place ``rn`` in reading order, from 1."""
    return regions.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("y1", "x1", "region_idx")))


def full_text(regions: DataFrame, keys: tuple[str, ...] = ("doc_id", "attempt")) -> DataFrame:
    """``keys, full_text``: non-empty texts in input order, joined by line ends, upper-cased."""
    line = F.when(blank(F.col("text")) != "", F.struct("region_idx", "text"))
    rows = F.array_sort(F.collect_list(line))
    return regions.groupBy(*keys).agg(F.upper(F.array_join(F.transform(rows, lambda x: x["text"]), "\n")).alias("full_text"))


# ---- functions of a line array


def first(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The first line that passes; null if none does."""
    return F.get(F.filter(lines, test), 0)


def place(lines: Column, test: Callable[[Column], Column]) -> Column:
    """The index from 0 of the first line that passes; null if none does."""
    return F.array_min(F.filter(F.transform(lines, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()))


def before(lines: Column, at: Column) -> Column:
    """Lines above index ``at``."""
    return F.slice(lines, F.lit(1), F.greatest(F.coalesce(at, F.lit(0)), F.lit(0)))


def after(lines: Column, at: Column) -> Column:
    """Lines below index ``at``; none if it is null."""
    return F.slice(lines, F.coalesce(at, F.lit(1 << 20)) + 2, F.lit(1 << 20))


def until(lines: Column, stop: Callable[[Column], Column], keep_stop: bool = False) -> Column:
    """Lines up to the first that stops the walk, without it or (``keep_stop``) with it."""

    def cut(x: Column) -> Column:
        at = F.coalesce(place(x, stop), F.size(x))
        return F.slice(x, F.lit(1), at + 1 if keep_stop else at)

    return let(lines, cut)


def nearest(lines: Column, test: Callable[[Column], Column], distance: Callable[[Column], Column]) -> Column:
    """The passing line at the least distance, ties by input order; null if none passes."""
    ranked = F.transform(F.filter(lines, test), lambda x: F.struct(distance(x).alias("d"), x["region_idx"].alias("i"), x.alias("line")))
    return F.array_min(ranked)["line"]


def text_of(line: Column) -> Column:
    return blank(line["text"])


def conf_of(line: Column) -> Column:
    return F.coalesce(line["conf"], F.lit(0.0))


def conf_for(lines: Column, needle: Column, default: Column | float = 0.0) -> Column:
    """Confidence of the first line whose text without spaces holds the needle."""
    other = default if isinstance(default, Column) else F.lit(default)
    key = squeeze(blank(needle))
    hit = first(lines, lambda x: F.contains(squeeze(x["text"]), key))
    return F.when(key == "", other).otherwise(F.coalesce(hit["conf"], other))


def height(line: Column) -> Column:
    return F.greatest(line["y2"] - line["y1"], F.lit(1))


def centre_x(line: Column) -> Column:
    return (line["x1"] + line["x2"]) / 2


def centre_y(line: Column) -> Column:
    return (line["y1"] + line["y2"]) / 2
