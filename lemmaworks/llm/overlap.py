"""Records of evaluation splits that stand, exactly or almost, in the training split.

"Almost the same" counts words in any order, so candidates are the pairs that share one of their rarest words
(``prefixes.py``), which loses none at the threshold; their words are compared exactly.  What a pair has in common
in one order is reported by winnowing: each text gives the rolling hashes of its runs of ``K`` words, and in every
window of ``WINDOW`` hashes the smallest is kept, so that any common run of ``K + WINDOW - 1`` words gives a common
fingerprint, a *seed*.  The longest collinear chain of seeds is extended by alignment: word by word from each seed
in both directions, then by the longest rising chain of equal words in the gaps.  Coverage is the share of aligned
words of the evaluation text.

Texts with equal multisets of words are one content, so copies are joined once.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaworks.llm.prefixes import close_links, close_pairs, is_noted, noted
from lemmaworks.llm.words import list_array, mix, occurrences, row_sums, word_hashes
from lemmaworks.session import ship_code, stage

K, WINDOW = 5, 4
#: Pairs of equal words of one gap that are all looked at.
ALL_PAIRS = 100_000


def contents(df: DataFrame, id_col: str, text_cols: list[str], ordered: bool = False) -> DataFrame:
    """(field, id, n, tid, toks[, seq]) of every id and text with a word: number of words, name of the content (the multiset of
    words of the field), 64-bit occurrence tokens, and with ``ordered`` the words as they stand."""
    ship_code(df.sparkSession)
    src = df.select(F.col(id_col).alias("id"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(text_cols)]).where("id is not null")
    names = ["field", "id", "n", "tid", "toks", *(["seq"] if ordered else [])]
    salts = [np.uint64(int.from_bytes(hashlib.blake2b(c.encode(), digest_size=8).digest(), "little")) for c in text_cols]

    def run(batches):
        for b in batches:
            for i, (name, salt) in enumerate(zip(text_cols, salts)):
                words, lens = word_hashes(b.column(i + 1))
                full = np.flatnonzero(lens)
                lens = lens[full]  # rows without words have no place in ``words``
                tok, _ = occurrences(words, lens)
                tok = mix(tok ^ salt, 7)
                tid = mix(row_sums(mix(tok, 1), lens) ^ salt, 8)
                out = [pa.array([name] * len(full), pa.string()), b.column(0).take(pa.array(full)), pa.array(lens, pa.int32()), pa.array(tid.view(np.int64)), list_array(tok.view(np.int64), lens, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + ([list_array(words.view(np.int64), lens, pa.int64())] if ordered else []), names=names)

    return src.mapInArrow(run, f"field string, id {src.schema['id'].dataType.simpleString()}, n int, tid bigint, toks array<bigint>" + (", seq array<bigint>" if ordered else ""))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    m = max(0, len(words) - k + 1)
    h = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k if m else 0):
            h = h * np.uint64(0x100000001B3) + words[j : j + m]
    return mix(h, 20 + k)


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the (rightmost) minima of every window of w consecutive hashes; of fewer hashes, of all."""
    if not len(h):
        return np.zeros(0, np.int64)
    w = min(w, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, w)[:, ::-1]
    return np.unique(np.arange(len(view)) + w - 1 - view.argmin(axis=1))


def rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest chain of pairs that rises in both numbers."""
    tails, ends, back = [], [], {}
    for i, j in sorted(pairs, key=lambda p: (p[0], -p[1])):
        at = bisect_left(tails, j)
        back[i, j] = ends[at - 1] if at else None
        if at == len(tails):
            tails.append(j)
            ends.append((i, j))
        else:
            tails[at], ends[at] = j, (i, j)
    out, p = [], ends[-1] if ends else None
    while p is not None:
        out.append(p)
        p = back[p]
    return out[::-1]


def matched(a: list[int], b: list[int], lo: tuple[int, int], hi: tuple[int, int]) -> list[tuple[int, int]]:
    """A longest rising chain of equal words between two places: equal ends first, then all pairs of equal words; where these
    are more than ALL_PAIRS, only the k-th copy of a word with the k-th."""
    (i, j), (p, q) = lo, hi
    front, tail = [], []
    while i < p and j < q and a[i] == b[j]:
        front.append((i, j))
        i, j = i + 1, j + 1
    while i < p and j < q and a[p - 1] == b[q - 1]:
        p, q = p - 1, q - 1
        tail.append((p, q))
    where: dict[int, list[int]] = {}
    for y in range(q - 1, j - 1, -1):
        where.setdefault(b[y], []).append(y)
    if sum(len(where.get(w, ())) for w in a[i:p]) <= ALL_PAIRS:
        inner = [(x, y) for x in range(i, p) for y in where.get(a[x], ())]
    else:
        inner = [(x, where[a[x]].pop()) for x in range(i, p) if where.get(a[x])]
    return front + rising(inner) + tail[::-1]


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(seeds, aligned words) of two texts: collinear seeds, each extended to words, and what stands equal between them."""
    ha, hb = rolling(a, K), rolling(b, K)
    pa_, pb = winnow(ha, WINDOW), winnow(hb, WINDOW)
    at: dict[int, list[int]] = {}
    for p in pb.tolist():
        at.setdefault(int(hb[p]), []).append(p)
    # a fingerprint that stands often on both sides is met copy by copy, so seeds stay linear in the texts
    seeds = []
    for p in reversed(pa_.tolist()):
        if at.get(int(ha[p])):
            seeds.append((p, at[int(ha[p])].pop()))
    chain = rising(seeds)
    x, y = a.tolist(), b.tolist()
    aligned, lo = 0, (0, 0)
    for i, j in [*chain, (len(x), len(y))]:
        if i >= lo[0] and j >= lo[1]:
            got = matched(x, y, lo, (i, j))
            aligned += len(got)
            lo = (i, j)
    return len(chain), aligned


def chains(links: DataFrame, words: DataFrame) -> DataFrame:
    """links + (seeds, aligned): see ``align``; ``words`` has (tid, seq)."""
    few = words.join(links.select(F.col("tid_eval").alias("tid")).union(links.select("tid_train")).distinct(), "tid", "left_semi").groupBy("tid").agg(F.min("seq").alias("seq"))
    side = lambda s: few.select(F.col("tid").alias(f"tid_{s}"), F.col("seq").alias(f"s_{s}"))
    both = links.join(side("eval"), "tid_eval").join(side("train"), "tid_train")
    cols = links.columns
    heads = ", ".join(f"{c} {links.schema[c].dataType.simpleString()}" for c in cols)

    def run(batches):
        for b in batches:
            seq = [[x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in b.column(f"s_{s}")] for s in ("eval", "train")]
            got = [align(x, y) for x, y in zip(*seq)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in cols], pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=[*cols, "seeds", "aligned"])

    return both.select(*cols, "s_eval", "s_train").mapInArrow(run, heads + ", seeds bigint, aligned bigint")


def on_sides(words: DataFrame, splits: DataFrame, train: str) -> DataFrame:
    """(c, n, toks, side) of contents (field, id, tid, n, toks): side 0 of evaluation ids, 1 of training ids, one row of most copies.

    No text is shuffled to learn its side: bitmaps of the ids of either side, of fixed size, tell it.  A bitmap may put a
    row on a side too many, which makes candidates that the exact ``members`` take out again, and never on one too few.
    """
    ids = splits.select(F.xxhash64("id").alias("h"), (F.col("split") == train).alias("t"))
    n_ids, n_rows = splits.count(), words.count()
    marks = [noted(ids.where(cond).select("h"), n_ids) for cond in ("not t", "t")]  # at most 16 MB each
    rows = words.select("tid", F.xxhash64("id").alias("h"), F.xxhash64("id", "field").alias("row"), "n", "toks")

    def sided(b, k):
        h, row = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        at = np.flatnonzero(is_noted(marks[k].value, h))
        return at, mix(row[at].view(np.uint64), 67 + k).view(np.int64)

    def first(batches):
        for b in batches:
            for k in (0, 1):
                at, row = sided(b, k)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(row), pa.array(np.full(len(at), k, np.int8))], names=["tid", "row", "side"])

    one = rows.select("tid", "h", "row").mapInArrow(first, "tid bigint, row bigint, side tinyint").groupBy("tid", "side").agg(F.min("row").alias("row"))
    chosen = noted(one.select("row"), n_rows)

    def run(batches):
        for b in batches:
            for k in (0, 1):
                at, row = sided(b, k)
                at = at[is_noted(chosen.value, row)]
                yield pa.RecordBatch.from_arrays([*[b.column(i).take(pa.array(at)) for i in (0, 3, 4)], pa.array(np.full(len(at), k, np.int8))], names=["c", "n", "toks", "side"])

    return rows.mapInArrow(run, "c bigint, n int, toks array<bigint>, side tinyint")


def overlaps(df: DataFrame, id_col: str, split_col: str, text_cols: list[str], threshold: float = 0.7, train: str = "train", ordered: bool = False, splits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(members, links)`` of all texts of ``text_cols``.

    members: (field, id, split, tid), repeated where rows of ``df`` or ``splits`` are; ``tid`` names a content of a field.  links: (tid_eval, tid_train, n_eval,
    n_train, shared, similarity): contents of an evaluation and of the training split with at least ``threshold``
    of the longer text's words in common; equal contents link a tid to itself.  With ``ordered`` also ``seeds`` and
    ``aligned`` (words in one order, see ``align``).  The split of an id stands in ``splits`` (id and split column), or
    in ``df`` itself; an id with several splits belongs to each.  Rows without id, split or text, and texts without
    words, are left out; repeated rows count once.
    """
    of = (df if splits is None else splits).select(F.col(id_col).alias("id"), F.col(split_col).alias("split")).where("id is not null and split is not null")
    of = stage(of.distinct() if splits is None else of, "splits")
    words = stage(contents(df, id_col, text_cols, ordered), "contents")
    members = stage(words.select("field", "id", "tid", "n").join(of, "id").select("field", "id", "split", "tid", "n"), "members")
    held = members.groupBy("tid", "n").agg(F.bool_or(F.col("split") != train).alias("x"), F.bool_or(F.col("split") == train).alias("y"))
    held = stage(held, "held")
    texts = on_sides(words, of, train)
    cand = stage(close_pairs(texts, threshold, words.select(F.col("tid").alias("c"), "toks")), "near")
    near = close_links(words.withColumnRenamed("tid", "c"), cand, threshold).select(F.col("a").alias("tid_eval"), F.col("b").alias("tid_train"), F.col("n_a").alias("n_eval"), F.col("n_b").alias("n_train"), F.col("shared").cast("long").alias("shared"))
    near = near.join(held.where("x").select(F.col("tid").alias("tid_eval")), "tid_eval", "left_semi").join(held.where("y").select(F.col("tid").alias("tid_train")), "tid_train", "left_semi").select("tid_eval", "tid_train", "n_eval", "n_train", "shared")
    same = held.where("x and y").select(F.col("tid").alias("tid_eval"), F.col("tid").alias("tid_train"), F.col("n").alias("n_eval"), F.col("n").alias("n_train"), F.col("n").cast("long").alias("shared"))
    links = near.unionByName(same).withColumn("similarity", F.col("shared") / F.greatest("n_eval", "n_train"))
    return members.drop("n"), chains(stage(links, "links"), words) if ordered else links


def overlap_pairs(df: DataFrame, id_col: str, split_col: str, text_cols: list[str], threshold: float = 0.7, train: str = "train", splits: DataFrame | None = None) -> DataFrame:
    """Every pair (id_a, id_b), a < b, of a training id and an evaluation id with the same or almost the same text."""
    members, links = overlaps(df, id_col, split_col, text_cols, threshold, train, splits=splits)
    a = members.where(F.col("split") != train).select(F.col("id").alias("x"), F.col("tid").alias("tid_eval"))
    b = members.where(F.col("split") == train).select(F.col("id").alias("y"), F.col("tid").alias("tid_train"))
    out = links.select("tid_eval", "tid_train").join(a, "tid_eval").join(b, "tid_train").where("x <> y")
    return out.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def overlap_report(df: DataFrame, id_col: str, split_col: str, source_col: str, text_cols: list[str], threshold: float = 0.7, train: str = "train", splits: DataFrame | None = None) -> DataFrame:
    """(split, source, records, overlapping, exact, mean_coverage) of each evaluation split and source.

    ``exact`` counts records with all words of a training text, in any order; coverage is the best share of a record's
    words that stands in one order in a training text, averaged over the overlapping records.  ``splits`` as in
    ``overlaps``, with the source; records are the ids of ``df``.
    """
    members, links = overlaps(df, id_col, split_col, text_cols, threshold, train, ordered=True, splits=splits)
    best = links.groupBy("tid_eval").agg(F.max("similarity").alias("similarity"), F.max(F.col("aligned") / F.col("n_eval")).alias("coverage"))
    hit = members.where(F.col("split") != train).join(best, F.col("tid") == F.col("tid_eval")).groupBy("id").agg(F.max("similarity").alias("similarity"), F.max("coverage").alias("coverage"))
    rec = (df if splits is None else splits).select(F.col(id_col).alias("id"), F.col(split_col).alias("split"), F.col(source_col).alias("source")).where((F.col("split") != train) & F.col("id").isNotNull()).distinct()
    if splits is not None:
        rec = rec.join(df.select(F.col(id_col).alias("id")), "id", "left_semi")
    return rec.join(hit, "id", "left").groupBy("split", "source").agg(
        F.count("*").alias("records"), F.count("similarity").alias("overlapping"), F.count_if(F.col("similarity") >= 1.0).alias("exact"), F.round(F.avg("coverage"), 6).alias("mean_coverage")
    )
