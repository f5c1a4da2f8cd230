"""Token ids of a whole corpus: every distinct word is encoded once.

The tokenizer's own pattern cuts texts into pre-tokens on the JVM.  Blocks of documents replace their
pre-tokens by codes of a block dictionary (the position of a pre-token is its place in the row), so a
frequent word leaves a block once, however often it stands there.  The dictionaries are shuffled by word,
each distinct word is encoded once in the whole job, and the ids go back to the blocks, where the rows
are put together by position.  Decoding joins the table of token bytes.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaworks.llm.words import list_array
from lemmaworks.session import ship_code, stage

#: White space as Unicode defines it; Java's \s is narrower.
SPACE = r"\t-\r \x{85}\p{Z}"
#: The pattern of the byte-level vocabularies, with white space spelled out (fixed value).
PRETOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Code points that the JVM's Unicode tables do not know; texts with one are cut by the ``regex`` module instead.
UNKNOWN = r"\p{Cn}"
BLOCK_TOKENS = 1 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """The vocabulary file; its folder is a parameter, or the variable TOKENIZERS, or the installed package."""
    folder = folder or os.environ.get("TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers

            folder = os.path.dirname(public_tokenizers.__file__)
        except ImportError:
            folder = "/opt/tokenizers"
    return os.path.join(folder, name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The encoder of a rank file, made once in each process; it has no special tokens."""
    if path not in _ENCODERS:
        import tiktoken

        plain = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _ENCODERS[path] = tiktoken.Encoding(os.path.basename(path), pat_str=plain, mergeable_ranks=read_ranks(path), special_tokens={})
    return _ENCODERS[path]


def code_blocks(df: DataFrame, id_col: str, text_col: str, carry: str | None = None) -> DataFrame:
    """Blocks of documents: (block, ids, hashes, lens, carried, codes, words), staged; a hash is that of a row's text.

    ``codes`` is the block's pre-tokens, row after row, as numbers of ``words``.  A null or empty text has
    length 0.  A repeated row (same id and same text) is kept once.
    """
    ship_code(df.sparkSession)
    text = F.col(text_col)
    odd = text.rlike(UNKNOWN)
    cut = F.when(~odd, F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0)))
    src = df.select(F.col(id_col).alias("id"), cut.alias("toks"), F.when(odd, text).alias("raw"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("carried"), F.xxhash64(F.coalesce(text, F.lit("")), F.col(carry) if carry else F.lit(None)).alias("hash"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, number, rx = TaskContext.get().partitionId(), 0, None
        for b in batches:
            toks, raw = b.column(1), b.column(2)
            if raw.null_count < len(raw):
                import regex

                rx = rx or regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
                toks = pa.array([rx.findall(r) if r is not None else t for t, r in zip(toks.to_pylist(), raw.to_pylist())], pa.list_(pa.string()))
            lens = toks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            total, lo = np.cumsum(lens), 0
            while lo < len(lens):
                base = total[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(total, base + BLOCK_TOKENS, side="right")))
                enc = toks.slice(lo, hi - lo).flatten().dictionary_encode()
                codes = enc.indices.to_numpy(zero_copy_only=False)
                small = np.uint16 if len(enc.dictionary) <= 1 << 16 else np.uint32
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(task << 32) + number], pa.int64()), list_array_any(b.column(0).slice(lo, hi - lo)), list_array_any(b.column(4).slice(lo, hi - lo)), list_array(lens[lo:hi], [hi - lo], pa.int32()), list_array_any(b.column(3).slice(lo, hi - lo)),
                     pa.array([codes.astype(small).tobytes()], pa.binary()), pa.array([len(enc.dictionary)], pa.int32()), list_array_any(enc.dictionary.cast(pa.string()))],
                    names=["block", "ids", "hashes", "lens", "carried", "codes", "n_words", "words"],
                )
                number, lo = number + 1, hi

    schema = f"block bigint, ids array<{kind}>, hashes array<bigint>, lens array<int>, carried array<string>, codes binary, n_words int, words array<string>"
    return stage(src.mapInArrow(run, schema), "blocks")


def list_array_any(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids) of distinct words (word)."""

    def run(batches):
        enc = encoder(path)
        for b in batches:
            got = [enc.encode_ordinary(w) for w in b.column(0).to_pylist()]
            lens = np.array([len(g) for g in got], np.int64)
            flat = np.fromiter((x for g in got for x in g), np.int32, int(lens.sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(flat, lens, pa.int32())], names=["word", "ids"])

    return words.mapInArrow(run, "word string, ids array<int>")


def _with_dictionaries(blocks: DataFrame, path: str, lengths_only: bool) -> DataFrame:
    """Blocks joined with what their words became, in code order."""
    entries = blocks.select("block", F.posexplode("words").alias("code", "word"))
    made = encoded_words(entries.select("word").distinct(), path)
    value = F.size("ids").alias("v") if lengths_only else F.col("ids").alias("v")
    back = entries.join(made.select("word", value), "word").groupBy("block").agg(F.collect_list(F.struct("code", "v")).alias("d"))
    back = back.select("block", F.col("d.code").alias("dict_code"), F.col("d.v").alias("dict_value"))
    return blocks.select("block", "ids", "lens", "carried", "codes", "n_words").join(back, "block", "left")


def _seen_before(blocks: DataFrame) -> DataFrame | None:
    """(block, skip): places of rows that repeat an earlier row, its id and its text (by a 64-bit hash); None if no row repeats."""
    rows = blocks.select("block", F.posexplode(F.arrays_zip("ids", "hashes")).alias("at", "r")).select("block", "at", F.col("r.ids").alias("id"), F.col("r.hashes").alias("hash"))
    twice = rows.groupBy("id", "hash").agg(F.count("*").alias("k"), F.min(F.struct("block", "at")).alias("first")).where("k > 1")
    twice = stage(twice, "repeats")
    if not twice.limit(1).count():
        return None
    again = rows.join(twice, (rows["id"].eqNullSafe(twice["id"])) & (rows["hash"] == twice["hash"])).where(F.struct("block", "at") != F.col("first"))
    return again.groupBy("block").agg(F.collect_list("at").alias("skip"))


def encode_corpus(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's text, an empty list for null and empty texts.

    Repeated rows (same id and text; null and empty are one) count once, also those with a null id; an id with several texts
    has a row for each.  No special tokens: their names in a text
    are ordinary text.
    """
    path = path or vocabulary_path()
    blocks = code_blocks(df, id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    full = _with_dictionaries(blocks, path, False)
    skip = _seen_before(blocks)
    full = full.withColumn("skip", F.lit(None).cast("array<int>")) if skip is None else full.join(skip, "block", "left")

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                lens = cols["lens"][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                ids = cols["ids"][i].values
                flat, sizes = _assemble(cols, i)
                out = _per_row(sizes, lens)
                res = pa.RecordBatch.from_arrays([ids, list_array(flat, out, pa.int32())], names=[id_col, "ids"])
                drop = cols["skip"][i].as_py() or []
                if drop:
                    keep = np.ones(len(lens), bool)
                    keep[drop] = False
                    res = res.filter(pa.array(keep))
                yield res

    return full.select("ids", "lens", "codes", "n_words", "dict_code", "dict_value", "skip").mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def _codes(cols, i) -> np.ndarray:
    n = cols["n_words"][i].as_py()
    return np.frombuffer(cols["codes"][i].as_py(), np.uint16 if n <= 1 << 16 else np.uint32).astype(np.int64)


def _assemble(cols, i) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of block ``i`` in order, and the number of ids of each pre-token."""
    codes = _codes(cols, i)
    if not len(codes):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    order = np.argsort(cols["dict_code"][i].values.to_numpy(zero_copy_only=False))
    lists = cols["dict_value"][i].values
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    begin, size = begin[order], size[order]
    sizes = size[codes]
    ends = np.cumsum(sizes)
    at = np.repeat(begin[codes] - (ends - sizes), sizes) + np.arange(ends[-1])
    return values[at], sizes


def _per_row(sizes: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``lens`` elements."""
    total = np.r_[0, np.cumsum(sizes)]
    ends = np.cumsum(lens)
    return total[ends] - total[ends - lens]


def count_tokens(df: DataFrame, id_col: str, text_col: str, carry: str, path: str | None = None) -> DataFrame:
    """(id, carried, tokens) of every distinct row: the number of token ids, 0 for null and empty texts."""
    path = path or vocabulary_path()
    blocks = code_blocks(df, id_col, text_col, carry)
    kind = df.schema[id_col].dataType.simpleString()
    full = _with_dictionaries(blocks, path, True)
    skip = _seen_before(blocks)
    full = full.withColumn("skip", F.lit(None).cast("array<int>")) if skip is None else full.join(skip, "block", "left")

    def run(batches):
        for b in batches:
            cols = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                lens = cols["lens"][i].values.to_numpy(zero_copy_only=False).astype(np.int64)
                codes = _codes(cols, i)
                if len(codes):
                    size = np.zeros(cols["n_words"][i].as_py(), np.int64)
                    size[cols["dict_code"][i].values.to_numpy(zero_copy_only=False)] = cols["dict_value"][i].values.to_numpy(zero_copy_only=False)
                    out = _per_row(size[codes], lens)
                else:
                    out = np.zeros(len(lens), np.int64)
                res = pa.RecordBatch.from_arrays([cols["ids"][i].values, cols["carried"][i].values, pa.array(out, pa.int64())], names=["id", "carried", "tokens"])
                drop = cols["skip"][i].as_py() or []
                if drop:
                    keep = np.ones(len(lens), bool)
                    keep[drop] = False
                    res = res.filter(pa.array(keep))
                yield res

    return full.select("ids", "carried", "lens", "codes", "n_words", "dict_code", "dict_value", "skip").mapInArrow(run, f"id {kind}, carried string, tokens bigint")


def token_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(token, bytes) of the vocabulary; its size is that of the vocabulary file."""
    ranks = read_ranks(path or vocabulary_path())
    return spark.createDataFrame([(v, bytearray(k)) for k, v in ranks.items()], "token int, bytes binary")


def decode_corpus(encoded: DataFrame, id_col: str, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text): the texts of lists of ids, by a join with the table of token bytes; broken UTF-8 is replaced."""
    spark = encoded.sparkSession
    table = F.broadcast(token_table(spark, path))  # at most the vocabulary's 50,256 rows
    rows = encoded.select(F.col(id_col), F.posexplode_outer(ids_col).alias("at", "token")).join(table, "token", "left")
    return rows.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("p")).select(
        id_col, F.make_valid_utf8(F.coalesce(F.concat_ws("", F.transform("p", lambda x: F.hex(x["bytes"]))), F.lit(""))).alias("hex")
    ).select(id_col, F.make_valid_utf8(F.unhex("hex").cast("string")).alias("text"))
