"""A sample whose categories have target proportions, by raking and weighted exponential keys.

Cell weights are raked to the target margins by iterative proportional fitting; each row then draws the
key -ln(u) / w with u from a hash of its id, and within a category the rows with the smallest keys are
taken.  Minimums are repaired from the same order, so the sample is the same on any partitioning.
"""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.session import running_total, stage

#: Margins are categories, not ids: more cells than this are refused.
MAX_CELLS = 100_000


def rake(cells: dict[tuple, float], margins: list[dict], rounds: int = 200, tol: float = 1e-10) -> dict[tuple, float]:
    """Iterative proportional fitting: weights of the cells so that margin ``i`` has the shares ``margins[i]``.

    A level without target or without rows keeps out of the fit of its margin.  The weights are factors
    on the rows of a cell.
    """
    w = {k: 1.0 for k in cells}
    for _ in range(rounds):
        worst = 0.0
        for i, target in enumerate(margins):
            sums: dict = {}
            for k, n in cells.items():
                if k[i] in target:
                    sums[k[i]] = sums.get(k[i], 0.0) + n * w[k]
            total, want = sum(sums.values()), sum(target[x] for x in sums)
            if not total or not want:
                continue
            for k in cells:
                s = sums.get(k[i], 0.0)
                if s > 0:
                    f = (target[k[i]] / want) / (s / total)
                    worst = max(worst, abs(f - 1.0))
                    w[k] *= f
        if worst < tol:
            break
    return w


def category_name(c: Column) -> Column:
    """A category spelling reduced to its last letters: case, blanks and separators do not matter."""
    t = F.lower(F.regexp_replace(c, r"[\s\p{Z}._\-/:]+", ""))
    return F.when(t == "", F.lit(None)).otherwise(t)


def unify_categories(df: DataFrame, col: str, names: list[str]) -> Column:
    """The target name that a spelling means: the whole name, or only the part after its dot; else the trimmed spelling."""
    k = category_name(F.col(col))
    out = F.trim(F.col(col))
    for n in names:
        whole = "".join(ch for ch in n.lower() if ch.isalnum())
        tail = "".join(ch for ch in n.lower().rsplit(".", 1)[-1] if ch.isalnum())
        keys = [whole] if sum(m.lower().rsplit(".", 1)[-1] == n.lower().rsplit(".", 1)[-1] for m in names) > 1 else [whole, tail]
        out = F.when(k.isin(keys), F.lit(n)).otherwise(out)
    return F.when(k.isNull(), F.lit(None)).otherwise(out)


def pool_of(pairs: DataFrame, routing: DataFrame, names: list[str]) -> DataFrame:
    """(pair_id, category, level): distinct pairs with a category; level is the second margin (positive_type)."""
    r = (
        routing.where("qid is not null").select("qid", unify_categories(routing, "category", names).alias("category")).where("category is not null")
        .groupBy("qid").agg(F.min("category").alias("category"))
    )
    cols = set(pairs.columns)
    level = F.min(F.coalesce(F.col("positive_type"), F.lit("-"))) if "positive_type" in cols else F.min(F.lit("-"))
    p = (
        pairs.where("pair_id is not null and instr(pair_id, 'pair') > 0").groupBy("pair_id").agg(level.alias("level"))
        .withColumn("qid", F.expr("substring(pair_id, instr(pair_id, 'pair') + 4)"))
    )
    return p.join(r, "qid").select("pair_id", "category", "level")


def target_rows(targets: DataFrame) -> list[dict]:
    rows = targets.where("category is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 target categories")
    return sorted((r.asDict() for r in rows), key=lambda r: r["category"])


def plan(counts: dict[str, int], targets: list[dict]) -> tuple[int, list[dict]]:
    """Sample size and, of each target category: quota, rows to take, and whether the target can be met.

    Shares are decimals, so that 0.3 x 10 is 3.  A category falls short if the pool has fewer rows of it
    than share x n, rounded up.  Rows to take: the quota (largest remainders), at least min_rows, at most
    what there is; what a short category lacks is reported, not given to others.
    """
    pool = sum(counts.values())
    frac = Decimal(str(targets[0]["sample_fraction"] or 0)) if targets else Decimal(0)
    n = int(frac * pool)
    share = {t["category"]: Decimal(str(t["target_share"] or 0)) for t in targets}
    base = {c: int(s * n) for c, s in share.items()}
    left = int((sum(share.values()) * n).to_integral_value()) - sum(base.values())
    for c in sorted(share, key=lambda c: (-(share[c] * n - base[c]), c))[: max(0, left)]:
        base[c] += 1
    out = []
    for t in targets:
        c = t["category"]
        have, need = counts.get(c, 0), int((share[c] * n).to_integral_value(ROUND_CEILING))
        take = min(have, max(base[c], int(t["min_rows"] or 0)))
        out.append({"category": c, "target_share": float(share[c]), "pool_rows": have, "needed": need, "quota": base[c], "take": take, "short": have < need})
    return n, out


def cell_takes(cells: dict[tuple, int], w: dict[tuple, float], takes: dict[str, int]) -> dict[tuple, int]:
    """Rows to take of each cell: a category's number in proportion to the raked cells, at most what a cell has (the rest goes to
    the other cells of the category), rounded by largest remainders."""
    out = {}
    for c, take in takes.items():
        free, left = {k: cells[k] * w.get(k, 1.0) for k in cells if k[0] == c}, take
        got: dict[tuple, float] = {}
        while free and left > 0:
            whole = sum(free.values())
            want = {k: left * x / whole if whole > 0 else left / len(free) for k, x in free.items()}
            full = [k for k in free if want[k] >= cells[k]]
            if not full:
                got |= want
                break
            for k in full:
                got[k] = cells[k]
                left -= cells[k]
                del free[k]
        base = {k: int(x + 1e-9) for k, x in got.items()}
        spare = take - sum(base.values())
        for k in sorted(got, key=lambda k: (-(got[k] - base[k]), k)):
            if spare > 0 and base[k] < cells[k]:
                base[k] += 1
                spare -= 1
        out |= base
    return out


def draw(pairs: DataFrame, routing: DataFrame, targets: DataFrame, seed: str = "sample") -> tuple[DataFrame, DataFrame]:
    """``(drawn, report)`` of ``draw_margins`` with the pool's own shares of positive_type as second margin; drawn: (pair_id, category)."""
    drawn, report, _ = draw_margins(pairs, routing, targets, None, seed)
    return drawn.select("pair_id", "category"), report


def draw_margins(pairs: DataFrame, routing: DataFrame, targets: DataFrame, levels_wanted: dict[str, float] | None = None, seed: str = "sample") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(drawn, report, margins)``.  drawn: (pair_id, category, level).  report: one row of each target category.  margins:
    (margin, value, target_share, drawn, actual_share, residual) of every target category and level, and of the size of the
    sample, whose shares are of the size wanted.

    The cells of category and level (positive_type) are raked to the numbers of the categories and the shares of the levels,
    ``levels_wanted`` or the pool's own.  Rows are ordered by weighted exponential keys; the numbers of the cells are then
    repaired to the raked ones, so that categories are exact and levels leave a residual only where the pool lacks rows.

    Pairs without category, unknown categories (no target) and repeated rows are not drawn.  Empty tables
    give an empty sample and a report of zeros.
    """
    spark = pairs.sparkSession
    t = target_rows(targets)
    pool = stage(pool_of(pairs, routing, [x["category"] for x in t]), "pool")
    cells = {(r["category"], r["level"]): r["n"] for r in pool.groupBy("category", "level").agg(F.count("*").alias("n")).limit(MAX_CELLS + 1).collect()}
    if len(cells) > MAX_CELLS:
        raise ValueError("too many cells")
    counts, levels = {}, {}
    for (c, lv), k in cells.items():
        counts[c] = counts.get(c, 0) + k
        levels[lv] = levels.get(lv, 0.0) + k
    n, steps = plan(counts, t)
    whole = sum(levels.values()) or 1.0
    want = {x["category"]: x["target_share"] for x in steps}
    level_share = levels_wanted if levels_wanted is not None else {lv: k / whole for lv, k in levels.items()}
    takes = {x["category"]: x["take"] for x in steps}
    inside = {k: v for k, v in cells.items() if takes.get(k[0])}
    w = rake(inside, [{c: k / max(1, sum(takes.values())) for c, k in takes.items() if k}, level_share])
    quota = cell_takes(inside, w, takes)
    weights = spark.createDataFrame([(c, lv, float(x)) for (c, lv), x in w.items()], "category string, level string, w double")
    u = (F.pmod(F.xxhash64("pair_id", F.lit(seed)), F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = pool.join(F.broadcast(weights), ["category", "level"]).withColumn("key", -F.log(u) / F.greatest("w", F.lit(1e-300))).drop("w")
    ranked = running_total(keyed, ["category", "level", "key", "pair_id"], None, "rank", "ranked")
    begin, at = [], 0
    for c, lv in sorted(inside):
        begin.append((c, lv, at, quota.get((c, lv), 0)))
        at += inside[c, lv]
    cut = spark.createDataFrame(begin, "category string, level string, begin long, take long")
    drawn = ranked.join(F.broadcast(cut), ["category", "level"]).where("rank - begin <= take").select("pair_id", "category", "level")
    drawn = stage(drawn, "drawn")
    taken = sum(x["take"] for x in steps)
    report = spark.createDataFrame(
        [(x["category"], x["target_share"], x["pool_rows"], x["needed"], x["quota"], x["take"], x["take"] / taken if taken else 0.0, x["short"], max(0, x["needed"] - x["pool_rows"])) for x in steps],
        "category string, target_share double, pool_rows long, needed long, quota long, drawn long, actual_share double, short boolean, gap long",
    )
    got = {r["level"]: r["k"] for r in drawn.groupBy("level").agg(F.count("*").alias("k")).collect()}  # at most as many as cells
    rows = [("category", x["category"], x["target_share"], x["take"], taken) for x in steps] + [("level", lv, float(level_share.get(lv, 0.0)), got.get(lv, 0), taken) for lv in sorted({*level_share, *got})] + [("size", "sample", 1.0, taken, n)]
    margins = spark.createDataFrame([(m, v, t_, k, k / o if o else 0.0, (k / o if o else 0.0) - t_) for m, v, t_, k, o in rows], "margin string, value string, target_share double, drawn long, actual_share double, residual double")
    return drawn, report, margins
