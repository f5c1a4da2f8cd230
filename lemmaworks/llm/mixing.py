"""Mixing sources to target shares of tokens by weighted fair queueing.

Each source queues its documents in hash order, whole rounds of repeats one after the other.  A copy's virtual finish
time is the running total of tokens of its source divided by the target share.  All copies are range-sorted by finish
time and the mix is what stands before the total budget in that order, so sources alternate by their shares all along.
A source that is used up falls short; the others go on in proportion until the budget is met.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.llm.tokens import count_tokens
from lemmaworks.session import running_total, stage


def source_name(c: Column) -> Column:
    """A source spelling: case, blanks at the ends and the kind of separator do not matter; null for null or blank."""
    t = F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}_\-.]+", "_")
    return F.when(t == "", F.lit(None)).otherwise(t)


def mix_targets(targets: DataFrame) -> list[dict]:
    rows = targets.where("source is not null").select("source", source_name(F.col("source")).alias("name"), "target_share", "max_repeats", "budget_fraction").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 sources in the targets")
    return sorted((r.asDict() for r in rows), key=lambda r: r["name"])


def mix_plan(by_source: dict[str, tuple[int, int]], total: int, targets: list[dict]) -> list[dict]:
    """Of each target source: its tokens, what it should give, and whether max_repeats copies fall short of it.

    ``by_source``: documents and tokens of each source; ``total``: tokens of all documents.  Decimals keep
    shares exact.
    """
    out = []
    for t in targets:
        docs, tokens = by_source.get(t["name"], (0, 0))
        want = Decimal(str(t["target_share"] or 0)) * Decimal(str(t["budget_fraction"] or 0)) * total
        top = max(0, int(t["max_repeats"] or 0))
        out.append({"source": t["source"], "name": t["name"], "share": float(t["target_share"] or 0), "documents": docs, "tokens": tokens, "wanted": want, "top": top, "cap": top * tokens, "short": top * tokens < want})
    return out


def virtual_end(steps: list[dict], budget: float) -> float:
    """The virtual time at which the sources together have given ``budget`` tokens, none more than its cap; infinite if never."""
    given, rate, now = 0.0, sum(s["share"] for s in steps if s["cap"] > 0), 0.0
    for s in sorted((s for s in steps if s["cap"] > 0 and s["share"] > 0), key=lambda s: s["cap"] / s["share"]):
        stop = s["cap"] / s["share"]
        if given + rate * (stop - now) >= budget:
            return now + (budget - given) / rate
        given, now, rate = given + rate * (stop - now), stop, rate - s["share"]
    return math.inf


def mix(documents: DataFrame, targets: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(uses, report)``.  uses: (id, source, tokens, repeats, first_finish, first_place) of the documents in the mix: how often
    each stands in it, and the virtual finish time and the place (tokens before it) of its first copy.  report: one row of
    each target source: (source, target_share, documents, tokens, wanted_tokens, mixed_tokens, actual_share, short,
    missing_tokens).  ``short``: even its last allowed copy finishes before the budget is met.

    Documents of no target source count for the total but not for the mix; so do documents without
    source.  Texts without tokens are never used.  Empty tables give an empty mix.
    """
    counted = stage(count_tokens(documents, id_col, text_col, source_col, path).withColumn("name", source_name(F.col("carried"))).select("id", "name", "tokens"), "counted")
    t = mix_targets(targets)
    known = [x["name"] for x in t]
    rows = counted.groupBy(F.when(F.col("name").isin(known), F.col("name")).alias("name")).agg(F.count("*").alias("d"), F.sum("tokens").alias("k")).collect()
    total = sum(int(r["k"]) for r in rows)
    steps = mix_plan({r["name"]: (r["d"], int(r["k"])) for r in rows if r["name"]}, total, t)
    budget = int(max([Decimal(str(x["budget_fraction"] or 0)) for x in t], default=Decimal(0)) * total)
    return _uses(counted, steps, budget, seed)


def _uses(counted: DataFrame, steps: list[dict], budget: int, seed: int) -> tuple[DataFrame, DataFrame]:
    spark = counted.sparkSession
    end = virtual_end(steps, budget)
    for s in steps:  # as many rounds as can finish by then
        s["rounds"] = 0 if not s["cap"] or not s["share"] else s["top"] if end == math.inf else min(s["top"], math.ceil(s["share"] * end / s["tokens"] + 1e-9))
    table = spark.createDataFrame([(s["name"], s["rounds"], s["share"]) for s in steps if s["rounds"] > 0], "name string, rounds int, share double")
    copies = (
        counted.where("tokens > 0").join(F.broadcast(table), "name")
        .withColumn("round", F.explode(F.sequence(F.lit(1), F.col("rounds")))).withColumn("h", F.xxhash64("id", "round", F.lit(seed))).drop("rounds")
    )
    queued = running_total(copies, ["name", "round", "h", "id"], "tokens", "upto", "queue")
    begin, at = [], 0
    for s in steps:  # the order by name puts each source's copies after those of the sources before it
        if s["rounds"] > 0:
            begin.append((s["name"], at))
            at += s["rounds"] * s["tokens"]
    starts = spark.createDataFrame(begin, "name string, start long")
    timed = queued.join(F.broadcast(starts), "name").select("id", "name", "tokens", "round", ((F.col("upto") - F.col("start")) / F.col("share")).alias("finish"))
    mixed = running_total(timed, ["finish", "name", "round", "id"], "tokens", "place", "mixed").where(F.col("place") <= budget)
    uses = stage(mixed.groupBy("id", "name", "tokens").agg(F.count("*").alias("repeats"), F.min("finish").alias("first_finish"), F.min(F.col("place") - F.col("tokens")).alias("first_place")), "uses")
    given = {r["name"]: int(r["k"]) for r in uses.groupBy("name").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("k")).collect()}
    whole = sum(given.values())
    report = spark.createDataFrame(
        [(s["source"], s["share"], s["documents"], s["tokens"], float(s["wanted"]), given.get(s["name"], 0), given.get(s["name"], 0) / whole if whole else 0.0, s["short"], max(0.0, float(s["wanted"]) - given.get(s["name"], 0))) for s in steps],
        "source string, target_share double, documents long, tokens long, wanted_tokens double, mixed_tokens long, actual_share double, short boolean, missing_tokens double",
    )
    return uses.select("id", F.col("name").alias("source"), "tokens", "repeats", "first_finish", "first_place"), report
