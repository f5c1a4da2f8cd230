"""Near-duplicate texts by a parity-sketch join.

A text is the multiset of its words (``words.py``).  Texts with equal multisets form a class, named by a hash;
classes are joined, not texts, so copies cost nothing.  Two classes become candidates if they share one of their
rarest tokens, as any two at the threshold do (``prefixes.py``), and if their parity sketches are close enough:
the Hamming distance of two sketches never exceeds the symmetric difference of the multisets.  Candidates are
verified on the tokens themselves, so that nothing is missed or added at any similarity from the threshold on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaworks.llm.components import connected_components
from lemmaworks.llm.prefixes import close_links, close_pairs
from lemmaworks.llm.words import list_array, mix, occurrences, row_sums, word_hashes
from lemmaworks.session import ship_code, stage


def tokenise(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, n, c, toks)`` for every row with an id and a text: number of words, a commutative 64-bit hash that names
    the class of equal multisets, and the 64-bit occurrence tokens."""
    ship_code(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("id is not null and t is not null")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            words, lens = word_hashes(b.column(1))
            tok, _ = occurrences(words, lens)
            c = row_sums(mix(tok, 1), lens)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int32()), pa.array(c.view("int64")), list_array(tok.view("int64"), lens, pa.int64())], names=["id", "n", "c", "toks"])

    return src.mapInArrow(run, f"id {kind}, n int, c bigint, toks array<bigint>")


def near_duplicates(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and links between classes.

    ``members``: (id, c, n), one row for each distinct id and class; ``c`` names the class.  ``links``: (a, b,
    shared, similarity) with a < b classes whose words have at least ``threshold`` of the longer text in
    common.  Null texts are left out; texts without any word are members without links, and the class of
    each is its own (null).  An id with several texts belongs to several classes.  Repeated rows count once;
    extra columns are ignored.
    """
    toks = stage(tokenise(df.select(id_col, text_col), id_col, text_col), "words")
    members = toks.select("id", F.when(F.col("n") > 0, F.col("c")).alias("c"), "n").distinct()
    cand = stage(close_pairs(toks.select("c", "n", "toks", F.lit(2).cast("tinyint").alias("side")), threshold), "candidates")
    links = close_links(toks, cand, threshold)
    return members, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "shared", (F.col("shared") / F.greatest("n_a", "n_b")).alias("similarity"))


def duplicate_groups(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7) -> DataFrame:
    """One row for each id and class: (id, rep, group_id, n_links): smallest id of the class, smallest id of
    the group of linked classes, links of the class."""
    members, links = near_duplicates(df, id_col, text_col, threshold)
    links = stage(links, "near_links")
    comp = connected_components(links)
    degree = links.select(F.col("a").alias("c")).union(links.select(F.col("b").alias("c"))).groupBy("c").agg(F.count("*").alias("n_links"))
    rep = members.where("c is not null").groupBy("c").agg(F.min("id").alias("rep"))
    known = rep.join(comp.select(F.col("node").alias("c"), "component"), "c", "left").join(degree, "c", "left").withColumn("component", F.coalesce("component", "c"))
    top = known.groupBy("component").agg(F.min("rep").alias("group_id"))
    named = known.join(top, "component").select("c", "rep", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.join(named, "c", "left").select("id", F.coalesce("rep", "id").alias("rep"), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def duplicate_pairs(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.7) -> DataFrame:
    """Every pair (id_a, id_b), id_a < id_b, of ids whose texts are the same or almost the same."""
    members, links = near_duplicates(df, id_col, text_col, threshold)
    m = members.where("c is not null").select("id", "c")
    links = stage(links.select("a", "b"), "near_links")
    same = m.groupBy("c").agg(F.count_distinct("id").alias("k")).where("k > 1").select(F.col("c").alias("a"), F.col("c").alias("b"))
    classes = links.unionByName(same)
    left, right = m.select(F.col("id").alias("x"), F.col("c").alias("a")), m.select(F.col("id").alias("y"), F.col("c").alias("b"))
    return (
        classes.join(left, "a").join(right, "b").where("x <> y")
        .select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
    )
