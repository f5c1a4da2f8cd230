"""Splits that keep all records of one paper together.

Paper ids come in many spellings.  A spelling is linked to the name it stands for, names that an outside
table calls equal are linked too, and the connected components of these links (minimum labels with
pointer jumping, ``components.py``) are the papers.  The component table is persisted: a later batch is
merged into it, components that already have a split keep it, new components fill the deficits of the
splits, and a merge of components with different splits is quarantined instead of moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.llm.components import connected_components
from lemmaworks.session import running_total, stage

#: Forms of an identifier once white space at the ends is gone and letters are lower case (fixed values).
#: New style: four digits, a separator, four or five digits.  Old style: archive, maybe a subject class, seven digits.
#: Before it may stand folders, a scheme and a host, or a prefix with a colon; after it a version and file endings.
NEW_STYLE = r"^(?:.*[/:\s])?([0-9]{4})[._\-]([0-9]{4,5})(?![0-9])(?:[._\-]?v[0-9]+)?(?:[._\-]\s*[a-z].*|[\s/\[(].*)?$"
OLD_STYLE = r"^(?:.*[/:\s])?([a-z]+(?:-[a-z]+)*)(?:[._]([a-z]{2}))?[/_]([0-9]{7})(?![0-9])(?:[._\-]?v[0-9]+)?(?:[._\-]\s*[a-z].*|[\s/\[(].*)?$"

#: Components of at least this fraction of all records are placed one by one (there are at most 1 / it of them).
LARGE = 0.001


def paper_name(raw: Column) -> Column:
    """The name that a spelling stands for; spellings of no known form stand for themselves; null for null or blank."""
    t = F.lower(F.regexp_replace(raw, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    new1, new2 = F.regexp_extract(t, NEW_STYLE, 1), F.regexp_extract(t, NEW_STYLE, 2)
    arch, cls, num = (F.regexp_extract(t, OLD_STYLE, i) for i in (1, 2, 3))
    old = F.concat(arch, F.when(cls != "", F.concat(F.lit("."), cls)).otherwise(F.lit("")), F.lit("/"), num)
    return F.when(t == "", F.lit(None)).when(num != "", old).when(new2 != "", F.concat(new1, F.lit("."), new2)).otherwise(F.concat(F.lit("as is "), F.trim(raw)))


def name_links(ids: DataFrame, col: str) -> DataFrame:
    """Links (a, b) between each spelling and its name; the two kinds of nodes carry different prefixes."""
    return (
        ids.select(F.col(col).alias("raw")).where("raw is not null").distinct()
        .select(F.concat(F.lit("s:"), "raw").alias("a"), F.concat(F.lit("n:"), paper_name(F.col("raw"))).alias("b"))
        .select("a", F.coalesce("b", "a").alias("b"))
    )


def paper_components(ids: DataFrame, col: str, links: DataFrame | None = None) -> DataFrame:
    """(paper_id, component) for every distinct spelling; ``links`` (a, b) names spellings known to be one paper."""
    edges = name_links(ids, col)
    if links is not None:
        extra = links.select(F.concat(F.lit("s:"), "a").alias("a"), F.concat(F.lit("s:"), "b").alias("b")).where("a is not null and b is not null")
        edges = edges.unionByName(extra).unionByName(name_links(links.select(F.col("a").alias("x")).union(links.select("b")), "x"))
    comp = connected_components(edges)
    return comp.where("node like 's:%'").select(F.expr("substring(node, 3)").alias("paper_id"), "component")


def same_paper_pairs(ids: DataFrame, col: str, links: DataFrame | None = None) -> DataFrame:
    """Pairs (paper_id_a, paper_id_b), a < b by code point, of different spellings of one paper."""
    c = stage(paper_components(ids, col, links), "spellings")
    x, y = c.select("component", F.col("paper_id").alias("paper_id_a")), c.select("component", F.col("paper_id").alias("paper_id_b"))
    return x.join(y, "component").where("paper_id_a < paper_id_b").select("paper_id_a", "paper_id_b")


def assign_splits(new: DataFrame, old: DataFrame | None, targets: list[tuple[str, float]]) -> DataFrame:
    """Give every new component a split such that the shares of all records come near the targets.

    ``new``: (component, weight).  ``old``: (component, split, weight) placed earlier, kept as they are.
    Large components (at least LARGE of all records, so at most 1 / LARGE of them) are placed one by one where the
    deficit is greatest; the many small ones are dealt in hash order, each to the split in whose part of their running
    total its middle lies.
    """
    spark = new.sparkSession
    names = sorted(n for n, _ in targets)
    share = {n: float(s) for n, s in targets}
    have = {n: 0 for n in names}
    if old is not None:
        have |= {r["split"]: int(r["w"]) for r in old.where("split is not null").groupBy("split").agg(F.sum("weight").alias("w")).collect() if r["split"] in have}
    new = stage(new.select("component", F.col("weight").cast("long").alias("weight")), "unplaced")
    total = sum(have.values()) + int(new.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    scale = sum(share.values()) or 1.0
    deficit = {n: share[n] / scale * total - have[n] for n in names}
    floor = max(1.0, LARGE * total)
    placed = []
    for r in sorted(new.where(F.col("weight") >= floor).collect(), key=lambda r: (-r["weight"], r["component"])):
        best = max(names, key=lambda n: deficit[n])
        deficit[best] -= r["weight"]
        placed.append((r["component"], best))
    large = spark.createDataFrame(placed, "component string, split string")
    small = new.where(F.col("weight") < floor)
    # the splits' intervals on the running total of the small components
    room = {n: max(0.0, deficit[n]) for n in names}
    rest = int(small.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0])
    f = rest / sum(room.values()) if sum(room.values()) else 0.0
    ends, at = [], 0.0
    for n in names:
        at += room[n] * f
        ends.append((n, at))
    placed_small = running_total(small.withColumn("h", F.xxhash64("component", F.lit(7))), ["h", "component"], "weight", "upto", "dealt")
    mid = F.col("upto") - F.col("weight") / 2
    split = F.lit(names[-1])
    for n, end in reversed(ends[:-1]):
        split = F.when(mid < F.lit(end), F.lit(n)).otherwise(split)
    dealt = placed_small.withColumn("split", split).select("component", "split")
    return dealt.unionByName(large)


def update_components(existing: DataFrame | None, batch: DataFrame, targets: list[tuple[str, float]], links: DataFrame | None = None) -> DataFrame:
    """Merge a batch of records into the component table and return the new table.

    ``batch``: (paper_id, weight), weight records of each spelling.  ``existing`` and the result:
    (paper_id, component, split, weight, quarantined).  A component that holds spellings of exactly one
    old split keeps that split; one with several is quarantined and its split is null; one with none is
    new.  A component quarantined before stays so.  Null paper ids are ignored.
    """
    fresh = batch.where("paper_id is not null").groupBy("paper_id").agg(F.sum("weight").alias("weight"))
    known = None
    ids, extra = fresh.select("paper_id"), links
    if existing is not None:
        known = stage(existing, "known")
        ids = ids.unionByName(known.select("paper_id"))
        chain = known.groupBy("component").agg(F.min("paper_id").alias("a")).join(known.select("component", F.col("paper_id").alias("b")), "component").select("a", "b")
        extra = chain if links is None else chain.unionByName(links.select("a", "b"))
        fresh = fresh.select("paper_id", "weight").unionByName(known.select("paper_id", "weight")).groupBy("paper_id").agg(F.sum("weight").alias("weight"))
    comp = stage(paper_components(ids, "paper_id", extra).join(fresh, "paper_id", "left").fillna(0, ["weight"]), "components")
    weight = comp.groupBy("component").agg(F.sum("weight").alias("weight"))
    if known is None:
        state = weight.withColumns({"split": F.lit(None).cast("string"), "quarantined": F.lit(False)})
    else:
        was = known.select("paper_id", F.col("split").alias("old"), F.col("quarantined").alias("bad"))
        state = (
            comp.join(was, "paper_id", "left").groupBy("component")
            .agg(F.min("old").alias("lo"), F.max("old").alias("hi"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad"), F.sum("weight").alias("weight"))
            .select("component", "weight", F.when(~F.col("bad") & (F.col("lo") == F.col("hi")), F.col("lo")).alias("split"), (F.col("bad") | F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("quarantined"))
        )
    state = stage(state, "states")
    dealt = assign_splits(state.where("split is null and not quarantined").select("component", "weight"), state.where("split is not null"), targets)
    final = state.join(dealt.withColumnRenamed("split", "dealt"), "component", "left").select("component", F.coalesce("split", "dealt").alias("split"), "quarantined")
    return comp.join(final, "component").select("paper_id", "component", "split", "weight", "quarantined")


def persisted_update(path: str, batch: DataFrame, targets: list[tuple[str, float]], links: DataFrame | None = None) -> DataFrame:
    """Merge a batch into the component table stored at ``path`` and store the result as its next version.

    The table is read from the newest complete version (none: it starts empty) and every update writes a version of its
    own, so a run that is lost in the middle leaves the last one as it was, and is simply run again.
    """
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
    done = sorted(n for n in names if n.startswith("version-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
    known = spark.read.parquet(f"{path}/{done[-1]}") if done else None
    out = f"{path}/version-{len(names):08d}"
    update_components(known, batch, targets, links).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def target_list(targets: DataFrame, name: str = "split", share: str = "target_share") -> list[tuple[str, float]]:
    """Targets as a list (a small table by nature; more than 1,000 rows are refused)."""
    rows = targets.select(name, share).where(f"{name} is not null").distinct().limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 targets")
    return sorted((r[0], float(r[1] or 0)) for r in rows)


def paper_records(statements: DataFrame, pairs: DataFrame) -> DataFrame:
    """(kind, record_id, paper_id, at) of every statement and pair, once: its paper's spelling and when it came.

    A statement without paper_id belongs to the paper in front of ``::`` in its stmt_id, a pair without
    one to the paper of its positive statement's id.  Repeated records count once; records without id and
    without paper are left out.
    """
    head = lambda c: F.regexp_extract(c, r"^(.*?)::", 1)
    some = lambda a, c: F.coalesce(F.col(a), F.when(head(c) != "", head(c)))
    when = lambda t: F.col("ingested_at") if "ingested_at" in t.columns else F.lit(None).cast("timestamp")
    s = statements.select(F.lit("statement").alias("kind"), F.col("stmt_id").alias("record_id"), some("paper_id", "stmt_id").alias("paper_id"), when(statements).alias("at"))
    p = pairs.select(F.lit("pair").alias("kind"), F.col("pair_id").alias("record_id"), some("paper_id", "positive_stmt_id").alias("paper_id"), when(pairs).alias("at"))
    return s.unionByName(p).where("record_id is not null and paper_id is not null").groupBy("kind", "record_id").agg(F.min("paper_id").alias("paper_id"), F.min("at").alias("at"))


def record_splits(statements: DataFrame, pairs: DataFrame, targets: DataFrame, table: str | None = None) -> DataFrame:
    """(kind, record_id, split, quarantined) of every statement and pair (see ``paper_records``).

    With ``table``, a path, the component table stored there is carried on and papers that it knows keep their split.
    """
    rec = stage(paper_records(statements, pairs).drop("at"), "records")
    batch, want = rec.groupBy("paper_id").agg(F.count("*").alias("weight")), target_list(targets)
    comp = update_components(None, batch, want) if table is None else persisted_update(table, batch, want)
    return rec.join(comp.select("paper_id", "split", "quarantined"), "paper_id").select("kind", "record_id", "split", "quarantined")


def splits_in_batches(statements: DataFrame, pairs: DataFrame, targets: DataFrame, table: str, late: float = 0.3) -> DataFrame:
    """(paper_id, component, split, weight, quarantined, before, outcome): the component table after two batches, the last
    ``late`` of the records by time being the second.

    ``before`` is the split after the first batch; ``outcome`` is 'kept', 'new' (filled a deficit), or 'quarantined'.
    Pairs and the statements they point to are one paper, which is given as a link.
    """
    rec = stage(paper_records(statements, pairs), "records")
    cut = rec.agg(F.percentile_approx("at", F.lit(1.0 - late), F.lit(10_000)).alias("t")).first()["t"]
    first = F.coalesce(F.col("at") <= F.lit(cut), F.lit(True))
    weight = lambda r: r.groupBy("paper_id").agg(F.count("*").alias("weight"))
    ids = rec.where("kind = 'statement'").select(F.col("record_id").alias("positive_stmt_id"), F.col("paper_id").alias("b"))
    links = pairs.where("paper_id is not null").select("positive_stmt_id", F.col("paper_id").alias("a")).distinct().join(ids, "positive_stmt_id").select("a", "b").where("a <> b").distinct()
    want = target_list(targets)
    one = persisted_update(table, weight(rec.where(first)), want)
    two = persisted_update(table, weight(rec.where(~first)), want, links)
    was = one.select("paper_id", F.col("split").alias("before"))
    return two.join(was, "paper_id", "left").withColumn("outcome", F.when(F.col("quarantined"), "quarantined").when(F.col("before").isNotNull(), "kept").otherwise("new"))
