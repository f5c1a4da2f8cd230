"""Negatives, category filter, training export, evaluation set, integrity audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lemmaworks.functions import latex as L
from lemmaworks.session import running_total, stage

MAX_NEGATIVES, MIN_NEGATIVE_LENGTH, MIN_NEGATIVES = 32, 25, 4
EVALUATION_QUERIES = 10_000


def statement_rings(statements: DataFrame) -> DataFrame:
    """(paper_id, stmt_id, spot, size): the distinct statements of each paper in a ring, in the order of the md5 of their ids.

    Places come from one range-sorted running count, so the ring of a huge paper is dealt to many tasks.
    """
    s = statements.where("paper_id is not null and stmt_id is not null").select("paper_id", "stmt_id").distinct().withColumn("h", F.md5("stmt_id"))
    n = stage(running_total(s, ["paper_id", "h", "stmt_id"], None, "n", "rings").select("paper_id", "stmt_id", "n"), "ring")
    bounds = n.groupBy("paper_id").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    return n.join(bounds, "paper_id").select("paper_id", "stmt_id", (F.col("n") - F.col("first")).alias("spot"), "size")


def eligible_negatives(pairs: DataFrame, statements: DataFrame, cap: int = MAX_NEGATIVES) -> DataFrame:
    """(pair_id, paper_id, positive_stmt_id, num_eligible, stmt_id, rank): up to ``cap`` statements of the pair's paper that are
    neither the positive nor named beside it, and how many there are in all.

    The statements of a paper stand in a ring of hash order; a pair starts at a place that the md5 of its id gives and takes
    the next ones, so its choice is the same on any cluster and costs ``cap`` rows and the named ones, not the whole paper.
    """
    none = F.array().cast("array<string>")
    named = F.array_union(F.array("positive_stmt_id"), F.coalesce("invoked_stmt_ids", none))
    if "co_positive_ids" in pairs.columns:
        named = F.array_union(named, F.coalesce("co_positive_ids", none))
    p = stage(pairs.where("paper_id is not null").select("pair_id", "paper_id", "positive_stmt_id", F.filter(named, lambda x: x.isNotNull()).alias("named")).dropDuplicates(["pair_id"]), "asked")
    ring = stage(statement_rings(statements), "rings")
    inside = p.select("pair_id", "paper_id", F.explode("named").alias("stmt_id")).join(ring.select("paper_id", "stmt_id"), ["paper_id", "stmt_id"]).groupBy("pair_id").agg(F.count("*").alias("held"))
    sized = p.join(ring.groupBy("paper_id").agg(F.first("size").alias("size")), "paper_id").join(inside, "pair_id", "left")
    start = F.conv(F.substring(F.md5("pair_id"), 1, 8), 16, 10).cast("long") % F.col("size")
    steps = F.least(F.col("size"), F.lit(cap) + F.size("named"))
    asked = sized.select("pair_id", "paper_id", "positive_stmt_id", "named", "size", (F.col("size") - F.coalesce("held", F.lit(0))).alias("num_eligible"), start.alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), steps - 1)).alias("k"))
    met = asked.withColumn("spot", (F.col("start") + F.col("k")) % F.col("size")).join(ring.select("paper_id", "spot", "stmt_id"), ["paper_id", "spot"])
    good = met.where(~F.array_contains("named", F.col("stmt_id"))).withColumn("rank", F.row_number().over(W.partitionBy("pair_id").orderBy("k")))
    return good.where(F.col("rank") <= cap).select("pair_id", "paper_id", "positive_stmt_id", "stmt_id", "rank", "num_eligible")


def negatives(pairs: DataFrame, statements: DataFrame, cap: int = MAX_NEGATIVES, min_length: int = MIN_NEGATIVE_LENGTH, filter_first: bool = False) -> DataFrame:
    """(pair_id, paper_id, positive_stmt_id, num_eligible, negatives): at most ``cap`` chosen, then short and malformed ones
    rejected, so fewer may be left.  With ``filter_first`` they are rejected before the choice, so ``num_eligible`` counts
    the sound ones and the first ``cap`` of them are taken.  A pair without paper has none."""
    texts = statements.select(F.col("stmt_id"), F.col("type"), L.clean_text(F.col("text")).alias("text")).dropDuplicates(["stmt_id"])
    good = stage(texts.where((F.length("text") >= min_length) & L.balanced(F.col("text"))), "sound")
    pool = statements.join(good.select("stmt_id"), "stmt_id", "left_semi") if filter_first else statements
    made = eligible_negatives(pairs, pool, cap).join(good, "stmt_id", "left").groupBy("pair_id").agg(
        F.max("num_eligible").alias("num_eligible"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("rank", "stmt_id", "type", "text")))).alias("n")
    )
    made = made.select("pair_id", "num_eligible", F.transform("n", lambda x: F.struct(x["stmt_id"].alias("stmt_id"), x["type"].alias("type"), x["text"].alias("text"))).alias("negatives"))
    empty = F.array().cast("array<struct<stmt_id:string,type:string,text:string>>")
    base = pairs.select("pair_id", "paper_id", "positive_stmt_id").dropDuplicates(["pair_id"])
    return base.join(made, "pair_id", "left").select("pair_id", "paper_id", "positive_stmt_id", F.coalesce("num_eligible", F.lit(0).cast("bigint")).alias("num_eligible"), F.coalesce("negatives", empty).alias("negatives"))


def negatives_counters(pairs: DataFrame, negs: DataFrame, cap: int = MAX_NEGATIVES) -> DataFrame:
    """(counter, n) of a run: pairs, those without paper or positive, without any negative, capped ones, negatives in all and on
    the average (in thousandths)."""
    size = F.size("negatives")
    a = negs.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("paper_id").isNull()).alias("without_paper"), F.count_if(F.col("positive_stmt_id").isNull()).alias("without_positive"), F.count_if(size == 0).alias("without_negatives"),
        F.count_if(F.col("num_eligible") > cap).alias("capped"), F.sum("num_eligible").alias("eligible"), F.sum(size).alias("negatives"), F.floor(F.coalesce(F.try_divide(1000 * F.sum(size), F.count("*")), F.lit(0))).alias("mean_thousandths"),
    )
    b = pairs.agg(*[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in ("query", "positive_text", "invoked_stmt_ids") if c in pairs.columns])
    return counters(a).unionByName(counters(b))


def counters(one: DataFrame) -> DataFrame:
    """(counter, n) of a row of counts."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("n")) for c in one.columns])).alias("x")).select("x.*")


def in_category(categories: Column, category: str, prefix: bool = False) -> Column:
    t = L.tags(categories)
    return F.coalesce(F.exists(t, lambda x: F.startswith(x, F.lit(category))) if prefix else F.array_contains(t, category), F.lit(False))


def filter_by_category(pairs: DataFrame, metadata: DataFrame, category: str, prefix: bool = False) -> DataFrame:
    """pairs whose paper carries the category; ids are compared as file names."""
    keep = metadata.where(in_category(F.col("categories"), category, prefix)).select(L.file_id(F.col("id")).alias("k")).distinct()
    return pairs.withColumn("k", L.file_id(F.col("paper_id"))).join(keep, "k", "left_semi").drop("k")


def training_records(pairs: DataFrame, negs: DataFrame, min_negatives: int = MIN_NEGATIVES, max_negatives: int | None = None, prompt: str | None = None, order: str | None = None) -> DataFrame:
    """(pair_id, query, pos, neg, drop_reason[, prompt]).  Empty texts, missing negatives, and fewer than ``min_negatives``
    after those equal to the positive are gone, drop a pair; the reason is kept.  Of several rows of negatives of one pair
    the last by ``order`` counts; without ``order`` there must be one."""
    trim = L.collapse_ends
    n = negs.select("pair_id", "negatives") if order is None else negs.groupBy("pair_id").agg(F.max_by("negatives", order).alias("negatives"))
    j = pairs.select("pair_id", trim(F.col("query")).alias("query"), trim(F.col("positive_text")).alias("p")).join(n, "pair_id", "left")
    neg = F.filter(F.transform("negatives", lambda x: trim(x["text"])), lambda t: t.isNotNull() & (t != "") & (t != F.col("p")))
    j = j.withColumn("neg", F.slice(neg, F.lit(1), F.lit(max_negatives)) if max_negatives else neg)
    reason = (
        F.when(F.coalesce(F.length("query"), F.lit(0)) == 0, "empty").when(F.coalesce(F.length("p"), F.lit(0)) == 0, "empty")
        .when(F.col("negatives").isNull(), "no_negatives").when(F.size("neg") < min_negatives, "few_negatives")
    )
    out = j.select("pair_id", "query", F.array("p").alias("pos"), "neg", reason.alias("drop_reason"))
    return out if prompt is None else out.withColumn("prompt", F.lit(prompt))


def sampled_records(records: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` kept records in the order of a seeded hash (the limit counts what is kept)."""
    return records.where("drop_reason is null").withColumn("h", F.md5(F.concat_ws(":", F.lit(str(seed)), "pair_id"))).orderBy("h", "pair_id").limit(n).drop("h")


def query_hash(c: Column) -> Column:
    return F.sha1(L.collapse_ends(c))


def evaluation_queries(pairs: DataFrame, training: DataFrame, limit: int = EVALUATION_QUERIES) -> DataFrame:
    """Pairs whose query stands in no training record, the first ``limit`` in order of pair_id; leaked ones do not count."""
    seen = training.select(query_hash(F.col("query")).alias("h")).where("h is not null").distinct()
    return pairs.where("query is not null").withColumn("h", query_hash(F.col("query"))).join(seen, "h", "left_anti").drop("h").orderBy("pair_id").limit(limit)


def evaluation_set(pairs: DataFrame, negs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(queries, corpus, qrels)`` of evaluation pairs.  Corpus ids number statements by first appearance: positives in
    order of pairs, then negatives."""
    kept = pairs.select("pair_id", "query", "positive_stmt_id", "positive_text", L.query_id(F.col("pair_id")).alias("qid"))
    queries = kept.select(F.col("qid").alias("id"), F.col("query").alias("text"))
    pos = kept.select(F.col("positive_stmt_id").alias("stmt_id"), F.struct(F.lit(0).alias("side"), "pair_id", F.lit(0).alias("at")).alias("o"), F.col("positive_text").alias("text"))
    neg = negs.join(kept.select("pair_id"), "pair_id", "left_semi").select("pair_id", F.posexplode("negatives").alias("at", "n")).select(F.col("n.stmt_id").alias("stmt_id"), F.struct(F.lit(1).alias("side"), "pair_id", "at").alias("o"), F.col("n.text").alias("text"))
    first = pos.unionByName(neg).where("stmt_id is not null").groupBy("stmt_id").agg(F.min("o").alias("o"), F.min_by("text", "o").alias("text"))
    numbered = running_total(first.select("stmt_id", "text", "o.*"), ["side", "pair_id", "at"], None, "n", "corpus").select((F.col("n") - 1).cast("string").alias("id"), "stmt_id", F.lit("").alias("title"), "text")
    numbered = stage(numbered, "numbered")
    qrels = kept.join(numbered.select("stmt_id", F.col("id").alias("docid")), kept["positive_stmt_id"] == F.col("stmt_id")).select("qid", "docid", F.lit(1).alias("relevance"))
    return queries, numbered.drop("stmt_id"), qrels


def first_negatives(pairs: DataFrame, statements: DataFrame, k: int = MAX_NEGATIVES) -> DataFrame:
    """(pair_id, stmt_id, rank): without sampling, the first ``k`` eligible statements of the paper in order of position.

    A pair names few statements, so the first k + |named| of its paper are all that it can need.
    """
    none = F.array().cast("array<string>")
    p = pairs.select("pair_id", "paper_id", F.array_union(F.array("positive_stmt_id"), F.coalesce("invoked_stmt_ids", none)).alias("named")).dropDuplicates(["pair_id"])
    s = statements.where("paper_id is not null and stmt_id is not null").groupBy("paper_id", "stmt_id").agg(F.min("char_start").alias("at"))
    placed = running_total(s.withColumn("at", F.coalesce("at", F.lit(0))), ["paper_id", "at", "stmt_id"], None, "n", "places").select("paper_id", "stmt_id", "n")
    placed = stage(placed, "placed")
    first = placed.groupBy("paper_id").agg(F.min("n").alias("first"), F.count("*").alias("size"))
    spots = placed.join(first, "paper_id").select("paper_id", "stmt_id", (F.col("n") - F.col("first")).alias("spot"))
    asked = p.join(first.select("paper_id", "size"), "paper_id").select("pair_id", "paper_id", "named", F.explode(F.sequence(F.lit(0).cast("long"), F.least("size", F.lit(k) + F.size("named")) - 1)).alias("spot"))
    met = asked.join(spots, ["paper_id", "spot"]).where(~F.coalesce(F.array_contains("named", F.col("stmt_id")), F.lit(False)))
    return met.withColumn("rank", F.row_number().over(W.partitionBy("pair_id").orderBy("spot"))).where(F.col("rank") <= k).select("pair_id", "stmt_id", "rank")


def training_hashes(files: DataFrame, file: str = "file", query: str = "query") -> DataFrame:
    """(file, queries, distinct_hashes, new_hashes): queries of each training file and how many hashes no file before it had.

    Files count in the order of their names; an empty or null query has no hash.
    """
    h = files.select(F.col(file).alias("file"), query_hash(F.col(query)).alias("h"))
    first = h.where("h is not null").groupBy("h").agg(F.min("file").alias("file")).groupBy("file").agg(F.count("*").alias("new_hashes"))
    all_ = h.groupBy("file").agg(F.count("*").alias("queries"), F.count_distinct("h").alias("distinct_hashes"))
    return all_.join(first, "file", "left").select("file", "queries", "distinct_hashes", F.coalesce("new_hashes", F.lit(0).cast("long")).alias("new_hashes"))


def evaluation_counters(pairs: DataFrame, training: DataFrame, limit: int = EVALUATION_QUERIES) -> DataFrame:
    """(counter, n): candidates, those without query, leaked ones, kept and missing to the limit; ``no_overlap`` is 1 if nothing
    leaked at all, which mostly means that the wrong training files were given."""
    seen = training.select(query_hash(F.col("query")).alias("h")).where("h is not null").distinct().withColumn("leaked", F.lit(True))
    h = pairs.withColumn("h", query_hash(F.col("query"))).join(seen, "h", "left")
    leaked = F.count_if("leaked")
    kept = F.least(F.count_if(F.col("query").isNotNull() & F.col("leaked").isNull()), F.lit(limit))
    return counters(h.agg(F.count("*").alias("candidates"), F.count_if(F.col("query").isNull()).alias("without_query"), leaked.alias("leaked"), kept.alias("kept"), (F.lit(limit) - kept).alias("shortfall"), (leaked == 0).cast("int").alias("no_overlap")))


def with_categories(rows: DataFrame, metadata: DataFrame, paper: str = "paper_id") -> DataFrame:
    """rows + (categories, primary): the categories of their paper, ids compared as file names; null where there are none.

    Of several rows of one paper the smallest string counts; only papers that occur are looked up.
    """
    need = rows.select(L.file_id(F.col(paper)).alias("k")).distinct()
    m = metadata.where("categories is not null").select(L.file_id(F.col("id")).alias("k"), L.collapse(F.col("categories")).alias("categories")).join(need, "k", "left_semi").groupBy("k").agg(F.min("categories").alias("categories"))
    return rows.withColumn("k", L.file_id(F.col(paper))).join(m, "k", "left").drop("k").withColumn("primary", F.get(L.tags(F.col("categories")), F.lit(0)))


def whitelisted(categories: Column, allowed: list[str], primary_only: bool = True) -> Column:
    """Whether the primary category, or any, is one of ``allowed``; false for none."""
    t, ok = L.tags(categories), F.array(*map(F.lit, allowed))
    return F.coalesce(F.array_contains(ok, F.get(t, F.lit(0))) if primary_only else F.arrays_overlap(t, ok), F.lit(False))


def shown_points(rows: DataFrame, prefix: str = "math.") -> DataFrame:
    """Points whose categories begin with ``prefix``; a missing category begins with nothing."""
    return rows.where(F.startswith(F.coalesce("categories", F.lit("None")), F.lit(prefix)))


def bucket_overlaps(runs: DataFrame, bucket: str = "bucket", qid: str = "qid") -> DataFrame:
    """(qid, n) of queries that stand in several buckets; empty for a disjoint union."""
    return runs.groupBy(qid).agg(F.count_distinct(bucket).alias("n")).where("n > 1")


def audit(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, expected: int | None = None) -> DataFrame:
    """(check, n) of an evaluation set: sizes, duplicates, orphans, missing documents, the spread of relevances."""
    one = lambda name, df: df.agg(F.lit(name).alias("check"), F.count("*").alias("n"))
    twice = lambda df, *c: df.groupBy(*c).count().where("count > 1")
    q, d, r = queries.select("id"), corpus.select("id"), qrels
    parts = [
        one("queries", q), one("corpus", d), one("qrels", r), one("duplicate_queries", twice(q, "id")), one("duplicate_corpus", twice(d, "id")), one("duplicate_qrels", twice(r, "qid", "docid")),
        one("queries_without_qrel", q.distinct().join(r.select(F.col("qid").alias("id")), "id", "left_anti")), one("orphan_qrels", r.select(F.col("qid").alias("id")).distinct().join(q, "id", "left_anti")),
        one("missing_documents", r.select(F.col("docid").alias("id")).distinct().join(d, "id", "left_anti")), one("judged_queries", q.distinct().join(r.select(F.col("qid").alias("id")), "id", "left_semi")),
        r.groupBy(F.concat(F.lit("relevance_"), F.coalesce(F.col("relevance").cast("string"), F.lit("none"))).alias("check")).agg(F.count("*").alias("n")),
    ]
    if expected is not None:
        parts.append(q.agg(F.lit("expected_gap").alias("check"), (F.lit(expected) - F.count("*")).alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
