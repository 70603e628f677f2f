"""Row numbers and pages within groups of any size.

An order is a list of columns, all ascending, nulls first, as Spark compares structs; for the largest
first, negate a number. Large groups are cut into pieces at keys of their own, so no task sorts one whole.
Where pieces begin follows from hashes of the keys: a task that runs again cuts at the same places.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom import fixed
from auditloom.session import cut

#: Rows of a piece, about
PIECE_ROWS = 1 << 20
#: Keys that are looked at for each piece, and pieces whose first keys travel in one row
_SAMPLED, _FAN = 32, 256
#: Steps of a search among sorted keys, the widest first
_STEPS = [1 << bit for bit in range(20, -1, -1)]


def _of_group(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """`df` with its group columns named apart, to be joined with `_same`."""
    return df.withColumnsRenamed({c: f"_g_{c}" for c in group})


def _same(group: Sequence[str], *more: Column) -> Column:
    """Rows of one group, null groups included."""
    same = F.lit(True)
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    for condition in more:
        same &= condition
    return same


def first_keys(df: DataFrame, group: Sequence[str], order: Sequence[Column],
               piece_rows: int = PIECE_ROWS) -> DataFrame:
    """`_number, _key` per group: the keys at which its pieces 1, 2, ... begin; none for a small group.

    One key in `piece_rows / 32` is looked at, chosen by its hash, and every 32nd of those begins a piece.
    What a task sorts here is that share of the largest group.
    """
    every = max(piece_rows // _SAMPLED, 1)
    seen = df.select(*group, F.struct(*order).alias("_key")).filter(
        F.pmod(F.xxhash64(*group, "_key"), F.lit(every)) == 0
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key"))
    return seen.withColumn("_place", place).filter(F.col("_place") % _SAMPLED == 0).select(
        *group, F.expr(f"_place div {_SAMPLED}").cast("int").alias("_number"), "_key"
    )


def _up_to(keys: Column, key: Column) -> Column:
    """How many of the sorted `keys` are not beyond `key`; 0 where there are none."""
    def step(low: Column, width: Column) -> Column:
        fits = (low + width <= F.size(keys)) & (F.get(keys, low + width - 1) <= key)
        return F.when(fits, low + width).otherwise(low)

    return F.aggregate(F.array(*map(F.lit, _STEPS)), F.lit(0), step)


def place_in_pieces(df: DataFrame, group: Sequence[str], order: Sequence[Column],
                    keys: DataFrame) -> DataFrame:
    """Add `_key`, `_piece` and `_split` (whether the group has several pieces).

    Two searches, first among every 256th key of the group, then among those in between, so a row
    meets some hundred keys however many its group has.
    """
    sorted_keys = F.sort_array(F.collect_list(F.when(F.col("_far"), F.col("_key"))))
    own = keys.withColumn("_far", F.col("_number") % _FAN == 0)
    far = _of_group(own.groupBy(*group).agg(sorted_keys.alias("_keys")), group)
    near = _of_group(
        own.filter(~F.col("_far")).withColumn("_from", F.expr(f"_number div {_FAN}").cast("int"))
        .groupBy(*group, "_from").agg(F.sort_array(F.collect_list("_key")).alias("_keys")), group,
    )
    begun = df.withColumn("_key", F.struct(*order)).join(far, _same(group), "left").select(
        *df.columns, "_key", F.col("_keys").isNotNull().alias("_split"),
        _up_to(F.col("_keys"), F.col("_key")).alias("_begun"),
    )
    return begun.join(near, _same(group, F.col("_begun") == F.col("_from")), "left").select(
        *df.columns, "_key", "_split",
        (F.col("_begun") * _FAN + _up_to(F.col("_keys"), F.col("_key"))).alias("_piece"),
    )


def _shifts(placed: DataFrame, group: Sequence[str]) -> DataFrame:
    """`_p, _size, _shift` of each piece of the split groups; the shift is the rows before it."""
    sizes = placed.filter("_split").groupBy(*group, "_piece").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    return _of_group(sizes.withColumn("_shift", shift), group).withColumnRenamed("_piece", "_p")


def _numbered(shifted: DataFrame, group: Sequence[str], columns: Sequence[str], name: str) -> DataFrame:
    within = Window.partitionBy(*group, "_piece").orderBy("_key")
    place = F.row_number().over(within) + F.coalesce(F.col("_shift"), F.lit(0))
    return shifted.select(*columns, place.cast("long").alias(name))


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    name: str = "position",
    sized_by: DataFrame | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add the 1-based place of each row within its group.

    `order` must be total. Rows are shuffled once, by group and piece; each piece is numbered alone and
    shifted by the sizes of the group's earlier ones. Groups of one piece have no shift, so the tables
    that rows are joined with have a row per `piece_rows` rows of large groups. `sized_by` can be any
    cheaper table with the same keys and perhaps more rows; pieces are found there.
    """
    keys = cut(first_keys(df if sized_by is None else sized_by, group, order, piece_rows))
    if keys.isEmpty():  # every group is one piece
        window = Window.partitionBy(*group).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("long"))
    placed = cut(place_in_pieces(df, group, order, keys))  # the sizes and the rows read it
    shifted = placed.join(_shifts(placed, group), _same(group, F.col("_piece") == F.col("_p")), "left")
    return _numbered(shifted, group, df.columns, name)


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """First and last place on a page."""
    if page < 1 or not 1 <= size <= fixed.MAX_PAGE_SIZE:
        raise ValueError(f"page must be at least 1 and size 1 to {fixed.MAX_PAGE_SIZE}")
    return (page - 1) * size + 1, page * size


def page_of_one(df: DataFrame, order: Sequence[Column], page: int = 1,
                size: int = fixed.PAGE_SIZE) -> DataFrame:
    """One page of a table that is already filtered to one owner or repository."""
    first, _ = page_bounds(page, size)
    return df.orderBy(*order).offset(first - 1).limit(size)


def page_of_each(df: DataFrame, group: Sequence[str], order: Sequence[Column], page: int = 1,
                 size: int = fixed.PAGE_SIZE, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """The same page of every group, with `position`.

    Up to the session's `windowGroupLimitThreshold` Spark keeps the leading rows of each group before
    the shuffle. Further on, only the pieces that the page lies in are shuffled and sorted; the others
    are counted. `df` is read up to three times, for keys, sizes and rows. `page_after` costs less.
    """
    first, last = page_bounds(page, size)
    leading = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    keys = None if last <= leading else cut(first_keys(df, group, order, piece_rows))
    if keys is None or keys.isEmpty():
        window = Window.partitionBy(*group).orderBy(*order)
        numbered = df.withColumn("position", F.row_number().over(window).cast("long"))
    else:
        placed = place_in_pieces(df, group, order, keys)
        shifts = cut(_shifts(placed, group))
        met = placed.join(shifts, _same(group, F.col("_piece") == F.col("_p")), "left").filter(
            F.col("_shift").isNull() | ((F.col("_shift") < last) & (F.col("_shift") + F.col("_size") >= first))
        )
        numbered = _numbered(met, group, df.columns, "position")
    return numbered.filter(F.col("position").between(first, last))


def page_after(df: DataFrame, group: Sequence[str], order: Sequence[Column], seen: DataFrame,
               size: int = fixed.PAGE_SIZE) -> DataFrame:
    """The next `size` rows of every group beyond the row that was seen last, with `place` from 1.

    `seen` has at most one row per group, the last of the page before; a group without one begins at its
    first row. However deep the page, Spark keeps `size` rows per group and map task, and
    no earlier row is sorted. Rows that came or went meanwhile neither repeat nor hide others.
    """
    page_bounds(1, size)
    last = _of_group(seen.select(*group, F.struct(*order).alias("_seen")), group)
    ahead = df.withColumn("_key", F.struct(*order)).join(last, _same(group), "left").filter(
        F.col("_seen").isNull() | (F.col("_key") > F.col("_seen"))
    )
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key"))
    return ahead.withColumn("place", place.cast("long")).filter(F.col("place") <= size).select(
        *df.columns, "place"
    )


def page_totals(df: DataFrame, group: Sequence[str], size: int = fixed.PAGE_SIZE) -> DataFrame:
    """Rows and pages per group."""
    return df.groupBy(*group).agg(F.count("*").alias("total")).withColumn(
        "pages", page_count(F.col("total"), size)
    )


def page_count(total: Column, size: int) -> Column:
    return F.greatest(F.ceil(total / F.lit(size)), F.lit(1)).cast("long")
