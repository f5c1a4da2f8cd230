"""Transitive closure of dependencies, breadth first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lemmaworks.session import stage


def closure(edges: DataFrame, src: str = "src", dst: str = "dst", max_depth: int = 100_000) -> DataFrame:
    """(start, node, depth) of everything that a start reaches, itself excluded; cycles end by themselves.

    Each round joins the frontier with the edges and takes off what was seen; rounds are written out, and
    their number is the depth of the graph.  Raises if ``max_depth`` rounds do not suffice.
    """
    e = stage(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).where("node is not null and next is not null").distinct(), "edges")
    seen = front = stage(e.where("node <> next").select(F.col("node").alias("start"), F.col("next").alias("node"), F.lit(1).alias("depth")), "front")
    for depth in range(2, max_depth + 2):
        step = front.select("start", "node").join(e, "node").where("next <> start").select("start", F.col("next").alias("node")).distinct()
        front = stage(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        if not front.limit(1).count():
            return seen
        seen = seen.unionByName(front)
        if depth % 12 == 0:
            seen = stage(seen, "seen")
    raise RuntimeError(f"the closure is deeper than {max_depth}")


def is_statement(stmt_id: Column) -> Column:
    """Whether an id is that of a statement (``::s``), not of an added one (``::a``)."""
    return F.contains(stmt_id, F.lit("::s"))


def dependency_texts(edges: DataFrame, statements: DataFrame) -> DataFrame:
    """(start, stmt_id, depth, ordinal, text): the texts of all that a statement builds on, in the order of discovery (depth,
    then id), numbered from 0.  Starts are statements only; ids without a text are dropped."""
    reach = closure(edges).where(is_statement(F.col("start")))
    texts = statements.where("stmt_id is not null and text is not null").groupBy("stmt_id").agg(F.min("text").alias("text"))
    both = reach.join(texts.select(F.col("stmt_id").alias("node"), "text"), "node")
    order = F.row_number().over(W.partitionBy("start").orderBy("depth", "node")) - 1
    return both.select("start", F.col("node").alias("stmt_id"), "depth", order.alias("ordinal"), "text")
