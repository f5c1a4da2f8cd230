"""Queries of the training-data operators over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaworks.llm import markup, mixing, mojibake, neardup, overlap, sample, splits, tokens
from lemmaworks.session import shared_dir


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark, d):
    ids = _read(spark, d, "statements").select("paper_id").union(_read(spark, d, "pairs").select("paper_id"))
    return splits.same_paper_pairs(ids, "paper_id")


def p1_splits(spark, d):
    return splits.record_splits(_read(spark, d, "statements"), _read(spark, d, "pairs"), _read(spark, d, "split_targets"))


def p1_whole_papers(spark, d):
    """Records of each kind, and the most splits that the records of one paper are in: 1, as SQL says."""
    st, pr = _read(spark, d, "statements"), _read(spark, d, "pairs")
    rec = splits.paper_records(st, pr).select("kind", "record_id", splits.paper_name(F.col("paper_id")).alias("name"))
    got = rec.join(splits.record_splits(st, pr, _read(spark, d, "split_targets")), ["kind", "record_id"]).where("split is not null")
    most = got.groupBy("name").agg(F.count_distinct("split").alias("k")).agg(F.max("k").alias("splits_of_a_paper"))
    return got.groupBy("kind").agg(F.count("*").alias("n")).crossJoin(most)  # one row on the right


def p1_batches(spark, d):
    table = f"{shared_dir(spark)}/paper-components-{uuid.uuid4().hex}"
    return splits.splits_in_batches(_read(spark, d, "statements"), _read(spark, d, "pairs"), _read(spark, d, "split_targets"), table)


def p2_found(spark, d):
    out = neardup.duplicate_pairs(_read(spark, d, "statements"), "stmt_id", "text")
    return out.select(F.col("id_a").alias("stmt_id_a"), F.col("id_b").alias("stmt_id_b"))


def p2_groups(spark, d):
    return neardup.duplicate_groups(_read(spark, d, "statements"), "stmt_id", "text").withColumnRenamed("id", "stmt_id")


def marked_fields(spark, d) -> DataFrame:
    """(field, record_id, text) of the four texts that may hold markup."""
    s, p, q = (_read(spark, d, t) for t in ("statements", "proofs", "pairs"))
    parts = [(s, "statements.text", "stmt_id", "text"), (p, "proofs.text", "proof_id", "text"), (q, "pairs.query", "pair_id", "query"), (q, "pairs.positive_text", "pair_id", "positive_text")]
    one = [t.select(F.lit(f).alias("field"), F.col(i).alias("record_id"), F.col(c).alias("text")) for t, f, i, c in parts]
    return one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])


def p3_found(spark, d):
    return markup.marked_records(marked_fields(spark, d), ["field", "record_id"])


def p3_clean(spark, d):
    return markup.clean_texts(marked_fields(spark, d), ["field", "record_id"]).distinct()


def p4_found(spark, d):
    _, report = sample.draw(_read(spark, d, "pairs"), _read(spark, d, "routing"), _read(spark, d, "sample_targets"))
    return report.where("short").select("category")


def p4_sample(spark, d):
    return sample.draw(_read(spark, d, "pairs"), _read(spark, d, "routing"), _read(spark, d, "sample_targets"))[0]


def p4_margins(spark, d):
    m = sample.draw_margins(_read(spark, d, "pairs"), _read(spark, d, "routing"), _read(spark, d, "sample_targets"))[2]
    return m.select("margin", "value", *[F.round(c, 6).alias(c) for c in ("target_share", "actual_share", "residual")], "drawn")


def p4_report(spark, d):
    return sample.draw(_read(spark, d, "pairs"), _read(spark, d, "routing"), _read(spark, d, "sample_targets"))[1]


def pair_splits(spark, d) -> DataFrame:
    """(pair_id, split, source), one row for each pair that has a split."""
    return _read(spark, d, "pair_splits").where("pair_id is not null and split is not null").groupBy("pair_id").agg(F.min("split").alias("split"), F.min("source").alias("source"))


def p5_found(spark, d):
    out = overlap.overlap_pairs(_read(spark, d, "pairs"), "pair_id", "split", ["query", "positive_text"], splits=pair_splits(spark, d))
    return out.select(F.col("id_a").alias("pair_id_a"), F.col("id_b").alias("pair_id_b"))


def p5_report(spark, d):
    return overlap.overlap_report(_read(spark, d, "pairs"), "pair_id", "split", "source", ["query", "positive_text"], splits=pair_splits(spark, d))


def p7_ids(spark, d):
    return tokens.encode_corpus(_read(spark, d, "documents"), "doc_id", "text")


def p8_found(spark, d):
    _, report = mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))
    return report.where("short").select("source")


def p8_uses(spark, d):
    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[0]


def p8_report(spark, d):
    return mixing.mix(_read(spark, d, "documents"), _read(spark, d, "mix_targets"))[1]


def p9_found(spark, d):
    return mojibake.affected(_read(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"))


def p9_restored(spark, d):
    return mojibake.affected(_read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found, "p1_splits": p1_splits, "p1_batches": p1_batches, "p1_whole_papers": p1_whole_papers, "p2_found": p2_found, "p2_groups": p2_groups, "p3_found": p3_found, "p3_clean": p3_clean,
        "p4_found": p4_found, "p4_sample": p4_sample, "p4_report": p4_report, "p4_margins": p4_margins, "p5_found": p5_found, "p5_report": p5_report, "p7_ids": p7_ids,
        "p8_found": p8_found, "p8_uses": p8_uses, "p8_report": p8_report, "p9_found": p9_found, "p9_restored": p9_restored,
    }


_CATEGORY = r"""
  names as (select distinct category as name, regexp_replace(lower(category), '[^a-z0-9]', '', 'g') as whole,
                   regexp_replace(lower(split_part(category, '.', -1)), '[^a-z0-9]', '', 'g') as tail from sample_targets where category is not null),
  spelled as (select distinct qid, regexp_replace(lower(category), '[\s._\-/:]+', '', 'g') as k from routing where qid is not null and category is not null),
  routed as (select qid, min(coalesce(name, k)) as category from spelled left join names on k = whole or k = tail where k <> '' group by qid),
  pool as (select p.pair_id, r.category from (select distinct pair_id from pairs where pair_id is not null) p
           join routed r on r.qid = substr(p.pair_id, instr(p.pair_id, 'pair') + 4) where instr(p.pair_id, 'pair') > 0),
  size as (select cast(floor(cast((select max(sample_fraction) from sample_targets) as decimal(9, 6)) * count(*)) as bigint) as n from pool)
"""


def oracle_sql() -> dict[str, str]:
    paper = r"""
      with ids as (select distinct paper_id from (select paper_id from statements union all select paper_id from pairs) where paper_id is not null),
      low as (select paper_id, lower(regexp_replace(paper_id, '^\s+|\s+$', '', 'g')) as t from ids),
      parts as (select paper_id, regexp_extract(t, '([0-9]{4})[._-]([0-9]{4,5})', ['a', 'b']) as n,
                       regexp_extract(t, '([a-z]+(-[a-z]+)*)([._]([a-z]{2}))?[/_]([0-9]{7})', ['arch', 'x', 'y', 'cls', 'num']) as o from low),
      named as (select paper_id, case when o.num <> '' then o.arch || '.' || o.cls || '/' || o.num when n.b <> '' then n.a || '.' || n.b else paper_id end as name from parts)
      select a.paper_id as paper_id_a, b.paper_id as paper_id_b from named a join named b on a.name = b.name and a.paper_id < b.paper_id
    """
    return {
        "p1_found": paper,
        "p1_whole_papers": r"""
          select kind, count(*) as n, 1 as splits_of_a_paper from (
            select distinct 'statement' as kind, stmt_id as id from statements where stmt_id is not null and (paper_id is not null or regexp_matches(stmt_id, '^.+?::'))
            union all select distinct 'pair', pair_id from pairs where pair_id is not null and (paper_id is not null or regexp_matches(positive_stmt_id, '^.+?::'))) group by kind
        """,
        "p4_report": "with" + _CATEGORY + """,
          t as (select distinct category, cast(target_share as decimal(9, 6)) as share, min_rows from sample_targets where category is not null),
          b as (select t.*, size.n, (select count(*) from pool where pool.category = t.category) as have, cast(floor(share * size.n) as bigint) as base, cast(ceil(share * size.n) as bigint) as needed from t, size),
          r as (select *, row_number() over (order by share * n - base desc, category) as k, cast(round(sum(share) over () * n) as bigint) - sum(base) over () as spare from b),
          q as (select *, base + cast(k <= spare as bigint) as quota from r), d as (select *, least(have, greatest(quota, coalesce(min_rows, 0))) as drawn from q)
          select category, cast(share as double) as target_share, have as pool_rows, needed, quota, drawn, drawn / sum(drawn) over () as actual_share, have < needed as short, greatest(0, needed - have) as gap from d
        """,
        "p4_found": "with" + _CATEGORY + """
          select t.category from (select distinct category, cast(target_share as decimal(9, 6)) as share from sample_targets where category is not null) t, size
          where (select count(*) from pool where pool.category = t.category) < ceil(t.share * size.n)
        """,
    }
