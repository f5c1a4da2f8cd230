"""Faceted filter and keyword search over points, with caps and a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIGHLIGHT_CAP, CATEGORY_CAP, PAPER_CAP, HISTORY_CAP = 50_000, 5, 10, 20


class TooMany(ValueError):
    """More values than an exploration query takes."""


def capped(values: list[str], cap: int) -> list[str]:
    """Distinct values in order; more than ``cap`` are refused."""
    out = list(dict.fromkeys(values))
    if len(out) > cap:
        raise TooMany(f"{len(out)} values, at most {cap} are allowed")
    return out


def facet_filter(points: DataFrame, categories: list[str], kind: str = "All", category_col: str = "categories", kind_col: str = "type") -> DataFrame:
    out = points.where(F.col(category_col).isin(capped(categories, CATEGORY_CAP)))
    return out if kind == "All" else out.where(F.col(kind_col) == kind)


def keyword_filter(points: DataFrame, keyword: str, text_col: str = "text") -> DataFrame:
    """Rows whose text contains the keyword as it stands, case aside; null contains nothing."""
    return points.where(F.coalesce(F.contains(F.lower(text_col), F.lit(keyword.lower())), F.lit(False)))


def paper_filter(points: DataFrame, papers: list[str], col: str = "paper_id") -> DataFrame:
    return points.where(F.col(col).isin(capped(papers, PAPER_CAP)))


def highlight(points: DataFrame, cap: int = HIGHLIGHT_CAP) -> DataFrame:
    """The rows, or none of them if there are more than ``cap``."""
    n = points.agg(F.count("*").alias("__n"))
    return points.crossJoin(F.broadcast(n)).where(F.col("__n") <= cap).drop("__n")


def facet_counts(points: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of (a, b) and of (a, 'All'); rows with a null in either are left out."""
    rows = points.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = rows.groupingSets([[F.col(a)], [F.col(a), F.col(b)]], F.col(a), F.col(b)).agg(F.count("*").alias("n"), F.grouping(b).alias("g"))
    return g.select(a, F.when(F.col("g") == 1, F.lit("All")).otherwise(F.col(b)).alias(b), "n")


def axis_extent(points: DataFrame, col: str, step: int = 5) -> DataFrame:
    v = F.col(col)
    return points.agg((F.floor(F.min(v) / step) * step).cast("double").alias("low"), ((F.floor(F.max(v) / step) + 1) * step).cast("double").alias("high"))


def number_points(points: DataFrame, order: list[str]) -> DataFrame:
    """point_id by global order, from 0."""
    from lemmaworks.session import running_total

    return running_total(points, order, None, "n", "points").withColumn("point_id", (F.col("n") - 1).cast("int")).drop("n")


def nth_of_facet(points: DataFrame, n: int, facet: str = "categories", order: str = "point_id") -> DataFrame:
    """The n-th point (from 0) of every facet."""
    return points.withColumn("nth", F.row_number().over(W.partitionBy(facet).orderBy(order)) - 1).where(F.col("nth") == n)


def recent_history(events: DataFrame, key: list[str], at: str, cap: int = HISTORY_CAP, who: str | None = None) -> DataFrame:
    """Of equal records the latest, and of these the ``cap`` latest of each user."""
    last = F.row_number().over(W.partitionBy(*([who] if who else []), *key).orderBy(F.desc(at)))
    rows = events.withColumn("k", last).where("k = 1").drop("k")
    if who is None:
        return rows.orderBy(F.desc(at), *key).limit(cap)
    w = W.partitionBy(who).orderBy(F.desc(at), *key)
    return rows.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= cap)


def category_options(points: DataFrame, selected: list[str], col: str = "categories", cap: int = CATEGORY_CAP, order: list[str] | None = None) -> DataFrame:
    """(category, ordinal, disabled): all categories in the global ``order`` (those it lacks behind it, by name); with the cap
    reached, those not selected are disabled."""
    sel = capped(selected, cap)
    c = points.select(F.col(col).alias("category")).where("category is not null").distinct()
    full = F.lit(len(sel) >= cap) & ~F.col("category").isin(sel) if sel else F.lit(False)
    place = global_place(F.col("category"), order or [])
    return c.withColumn("ordinal", F.row_number().over(W.orderBy(place, "category")) - 1).withColumn("disabled", full)


def global_place(c: Column, order: list[str]) -> Column:
    """The place of a category in a global order, whatever order it was chosen in; the order's length for others."""
    at = F.array_position(F.array(*map(F.lit, order)), c) if order else F.lit(0)
    return F.when(at > 0, at - 1).otherwise(F.lit(len(order))).cast("int")


def point_by_id(points: DataFrame, point_id: int, id_col: str = "point_id", text_col: str = "text") -> DataFrame:
    """The point with an id; a null text is shown empty."""
    return points.where(F.col(id_col) == point_id).withColumn(text_col, F.coalesce(text_col, F.lit("")))


def keyword_in_order(points: DataFrame, keyword: str, categories: list[str], order_col: str = "point_id", category_col: str = "categories") -> DataFrame:
    """Points of the facets that contain the keyword, + ``ordinal``: facet by facet in the order given, then by ``order_col``."""
    from lemmaworks.session import running_total

    hit = keyword_filter(facet_filter(points, categories), keyword).withColumn("place", global_place(F.col(category_col), capped(categories, CATEGORY_CAP)))
    return running_total(hit, ["place", order_col], None, "n", "hits").withColumn("ordinal", F.col("n") - 1).drop("n", "place")


def history_key(kind: str, categories: Column, type_: Column, papers: Column, keyword: Column, point: Column) -> Column:
    """What makes two history records one: a filter is known by categories, type, papers and keyword, a point by categories, type and itself."""
    if kind == "point":
        return F.struct(F.lit("point").alias("kind"), F.array_sort(categories).alias("a"), type_.alias("b"), point.cast("string").alias("c"))
    return F.struct(F.lit("filter").alias("kind"), F.array_sort(categories).alias("a"), type_.alias("b"), F.concat_ws("|", F.concat_ws(",", F.array_sort(papers)), F.lower(F.trim(keyword))).alias("c"))


def history_label(categories: Column, type_: Column, keyword: Column, point: Column) -> Column:
    """A record in words; empty parts are left out."""
    some = lambda c: F.when(F.length(c.cast("string")) > 0, c.cast("string"))
    return F.concat_ws(" · ", some(F.concat_ws(", ", categories)), some(F.when(type_ != "All", type_)), some(F.concat(F.lit('"'), keyword, F.lit('"'))), some(F.concat(F.lit("point "), point.cast("string"))))


def replay(history: DataFrame, points: DataFrame, id_col: str = "point_id") -> DataFrame:
    """history (…, point_id) + ``visible``: whether the record's point is still there; records without a point always are."""
    there = points.select(F.col(id_col), F.lit(True).alias("__there")).distinct()
    return history.join(there, id_col, "left").withColumn("visible", F.col(id_col).isNull() | F.coalesce("__there", F.lit(False))).drop("__there")


def figure_groups(points: DataFrame, order: list[str], category_col: str = "categories") -> DataFrame:
    """(category, ordinal, n, low_x, high_x): what one trace of a figure needs, categories in a fixed order."""
    g = points.where(F.col(category_col).isNotNull()).groupBy(F.col(category_col).alias("category")).agg(F.count("*").alias("n"), F.min("x").alias("low_x"), F.max("x").alias("high_x"))
    return g.withColumn("ordinal", global_place(F.col("category"), order))


def distinct_colours(palette: list[str], n: int) -> list[str]:
    """``n`` colours (``#rrggbb``) of a palette, each as far as possible from those before it; the first is the palette's first."""
    rgb = {c: tuple(int(c[i : i + 2], 16) for i in (1, 3, 5)) for c in palette}
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(rgb[a], rgb[b]))
    out = palette[:1]
    while len(out) < min(n, len(rgb)):
        out.append(max((c for c in palette if c not in out), key=lambda c: min(far(c, o) for o in out)))
    return out[:n]


def status_line(shown: int, total: int, cap: int = HIGHLIGHT_CAP) -> str:
    """What a search says of its result."""
    if not total:
        return "No point matches."
    return f"{total:,} points match, more than {cap:,}: none is marked." if total > cap else f"{shown:,} of {total:,} points are marked."
