"""Attaching proofs to statements: nearest before, and by a cited label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmaworks.session import partitions_for, stage

HIGH_GAP = 1500


def last_before(rows: DataFrame, group: str, order: list[str], value: str, into: str) -> DataFrame:
    """rows + ``into``: the last non-null ``value`` at or before each row in the order of its group.

    Rows are range-partitioned by (group, order) and looked at part by part, so a group with a third of all rows is many
    tasks' work; what a part hands on is one value of its last group.  ``order`` must be unique within a group.
    """
    spark = rows.sparkSession
    keys = [group, *order]
    ranged = stage(rows.repartitionByRange(partitions_for(spark), *keys).withColumn("__pid", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("__pid").agg(F.min(group).alias("low"), F.max(group).alias("high"))
    held = ranged.join(F.broadcast(ends.select("__pid", F.col("high").alias("__high"))), "__pid").where(F.col(group) == F.col("__high"))
    tail = held.where(F.col(value).isNotNull()).groupBy("__pid").agg(F.max_by(value, F.struct(*order)).alias("v"))
    carry, now = [], (None, None)
    for r in ends.join(tail, "__pid", "left").orderBy("__pid").collect():  # one row for each part
        carry.append((r["__pid"], now[0], now[1] if now[0] == r["low"] else None))
        now = (r["high"], r["v"] if r["v"] is not None else (now[1] if now[0] == r["low"] == r["high"] else None))
    kind = rows.schema[value].dataType
    schema = T.StructType([T.StructField("__pid", T.IntegerType()), T.StructField("__group", rows.schema[group].dataType), T.StructField("__carry", kind)])
    table = spark.createDataFrame(carry, schema)
    w = W.partitionBy("__pid", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    here = F.last(F.col(value), ignorenulls=True).over(w)
    out = ranged.join(F.broadcast(table), "__pid").withColumn(into, F.coalesce(here, F.when(F.col(group) == F.col("__group"), F.col("__carry"))))
    return out.drop("__pid", "__group", "__carry")


def attach_proofs(proofs: DataFrame, statements: DataFrame, high_gap: int = HIGH_GAP, key: str = "proof_id") -> DataFrame:
    """proofs + (attached_stmt_id, attached_gap, attach_confidence): the statement of the same paper with the greatest
    char_end not after the proof's start.

    Confidence is 'explicit' if the title names references, else 'high' up to ``high_gap`` characters, 'low'
    beyond, 'none' without a statement.  One sort of the positions of both tables replaces a range join; texts do not take
    part in it.  Of statements that end at one place the greatest id wins.  Null papers or places attach nothing.
    ``key`` must be unique.
    """
    keep = [c for c in proofs.columns if c not in ("attached_stmt_id", "attached_gap", "attach_confidence")]
    s = statements.where("paper_id is not null and char_end is not null and stmt_id is not null").select("paper_id", F.col("char_end").alias("at"), F.lit(0).alias("side"), F.col("stmt_id").alias("name"), F.struct("char_end", "stmt_id").alias("st")).distinct()
    p = proofs.where("paper_id is not null and char_start is not null").select("paper_id", F.col("char_start").alias("at"), F.lit(1).alias("side"), F.col(key).alias("name"), F.lit(None).cast(s.schema["st"].dataType).alias("st"))
    found = last_before(s.unionByName(p), "paper_id", ["at", "side", "name"], "st", "last").where("side = 1 and last is not null").select(F.col("name").alias(key), "last")
    hit = proofs.select(*keep).join(found, key, "left")
    gap = F.col("char_start") - F.col("last.char_end")
    named = F.size(F.coalesce("title_refs", F.array().cast("array<string>"))) > 0 if "title_refs" in keep else F.lit(False)
    conf = F.when(named, "explicit").when(gap.isNull(), "none").when(gap <= high_gap, "high").otherwise("low")
    return hit.select(*keep, F.col("last.stmt_id").alias("attached_stmt_id"), gap.alias("attached_gap"), conf.alias("attach_confidence"))


def attach_sections(sections: DataFrame, statements: DataFrame) -> DataFrame:
    """Proof sections attached by the first cited label: the last statement of the paper that carries it."""
    rows = statements.select("paper_id", F.explode("labels").alias("key"), "char_start", "stmt_id")
    index = rows.groupBy("paper_id", "key").agg(F.max_by("stmt_id", F.struct("char_start", "stmt_id")).alias("hit"))
    keep = [c for c in sections.columns if c not in ("attached_stmt_id", "attached_gap", "attach_confidence")]
    s = sections.select(*keep, F.get("title_refs", F.lit(0)).alias("key"))
    out = s.join(index, ["paper_id", "key"], "left")
    return out.select(*keep, F.col("hit").alias("attached_stmt_id"), F.lit(None).cast("int").alias("attached_gap"), F.when(F.col("hit").isNull(), "none").otherwise("explicit").alias("attach_confidence"))


def number_within(df: DataFrame, paper: str, order: list[str], mark: str, into: str) -> DataFrame:
    """Ids ``paper::<mark>NNNN`` by order within the paper, four digits or more."""
    n = F.row_number().over(W.partitionBy(paper).orderBy(*order)) - 1
    return df.withColumn(into, F.format_string(f"%s::{mark}%04d", paper, n))
