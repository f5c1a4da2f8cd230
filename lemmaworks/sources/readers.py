"""Readers: paper folders, JSON lines in three policies, keyed lines, matrices, CSV, text, search results."""

from __future__ import annotations

import os
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_papers(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".tex", ".ltx")) -> DataFrame:
    """(paper_id, text): every folder with LaTeX files directly in it, files joined in the order of their names.

    The id is the folder's path below ``root`` ('.' for the root).  Bytes that are no UTF-8 become U+FFFD, and all
    line ends become a newline.  One shuffle by folder; a paper must fit in a row.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "content")
    low = F.lower("path")
    keep = files.where(F.greatest(*[F.endswith(low, F.lit(s)) for s in suffixes]))
    folder, name = F.regexp_replace("path", "/[^/]*$", ""), F.substring_index("path", "/", -1)
    base = os.path.abspath(root.removeprefix("file:")) if "://" not in root else root.split("://", 1)[1]
    rel = F.regexp_replace(F.substring_index(folder, base.rstrip("/"), -1), "^/", "")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    rows = keep.select(F.when(rel == "", ".").otherwise(rel).alias("paper_id"), name.alias("name"), text.alias("text"))
    return rows.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "text"))), lambda x: x["text"]), "").alias("text"))


def read_paper(spark: SparkSession, root: str, paper_id: str, comments: bool = False) -> DataFrame:
    """(paper_id, text) of one paper: only its folder is listed.  Comments are taken out unless ``comments`` is set."""
    from lemmaworks.functions.latex import strip_comments

    one = read_papers(spark, f"{root.rstrip('/')}/{paper_id}").where("paper_id = '.'").withColumn("paper_id", F.lit(paper_id))
    return one if comments else one.withColumn("text", strip_comments(F.col("text")))


def read_training_files(spark: SparkSession, paths: list[str], schema: str = "query string") -> tuple[DataFrame, list[str]]:
    """``(rows, missing)``: the union of training files, each row with its ``file``, and the files that are not there."""
    there = [p for p in paths if exists(spark, p)]
    want = T.StructType.fromDDL(schema)
    out = spark.createDataFrame([], T.StructType([*want.fields, T.StructField("file", T.StringType())]))
    for p in there:
        out = out.unionByName(read_json_lines(spark, p, schema).withColumn("file", F.lit(p)))
    return out, [p for p in paths if p not in there]


def read_json_lines(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, policy: str = "skip", keep_raw: bool = False) -> DataFrame:
    """JSON lines with a schema.  ``policy``: 'fail' on a bad line, 'skip' it, or 'mark' it in the column ``_bad``.

    Blank lines never count.  Of several paths, missing ones are left out.  ``keep_raw`` adds the line as it stands.
    """
    paths = [paths] if isinstance(paths, str) else [p for p in paths if exists(spark, p)]
    want = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    if not paths:
        return spark.createDataFrame([], want)
    lines = spark.read.text(paths).where(F.trim("value") != "")
    full = T.StructType([*want.fields, T.StructField("_bad", T.StringType())])
    opts = {"columnNameOfCorruptRecord": "_bad", "mode": "FAILFAST" if policy == "fail" else "PERMISSIVE"}
    got = lines.select("value", F.from_json("value", full if policy != "fail" else want, opts).alias("r"))
    if policy == "skip":
        got = got.where("r._bad is null and r is not null")
    cols = [F.col(f"r.{f.name}") for f in want.fields] + ([F.col("r._bad").alias("_bad")] if policy == "mark" else [])
    return got.select(*cols, *([F.col("value").alias("_raw")] if keep_raw else []))


def read_keyed_lines(spark: SparkSession, path: str, value_schema: str) -> DataFrame:
    """(key, value) of lines that hold one-key objects; of equal keys the last line of the last file wins."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).where(F.trim("value") != "")
    got = lines.select("f", "i", F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias("key", "v"))
    return got.groupBy("key").agg(F.max_by("v", F.struct("f", "i")).alias("value"))


def read_matrix(spark: SparkSession, npy: str, metadata: DataFrame | None = None, id_col: str = "row") -> DataFrame:
    """(row, embedding) of a dense ``.npy`` file, read in slices by the tasks; ``metadata`` is joined by ``id_col``."""
    import numpy as np

    n = int(np.load(npy, mmap_mode="r").shape[0])
    step = max(1, 1 << 14)
    starts = spark.createDataFrame([(i,) for i in range(0, n, step)], "lo bigint").repartition(max(1, -(-n // step)))

    def load(batches):
        m = np.load(npy, mmap_mode="r")
        for pdf in batches:
            for lo in pdf["lo"]:
                part = np.asarray(m[lo : lo + step], np.float32)
                yield pd.DataFrame({id_col: np.arange(lo, lo + len(part)), "embedding": list(part)})

    out = starts.mapInPandas(load, f"{id_col} bigint, embedding array<float>")
    return out if metadata is None else out.join(metadata, id_col)


def read_metadata(spark: SparkSession, path: str, schema: str, id_col: str = "row") -> DataFrame:
    """(row, ...) of a JSON file that holds one array of objects, numbered as they stand; it goes with a matrix of as many rows."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.name + ':' + f.dataType.simpleString() for f in T.StructType.fromDDL(schema).fields)}>>")).alias(id_col, "m"))
    return whole.select(F.col(id_col).cast("long").alias(id_col), "m.*")


def read_points(spark: SparkSession, path: str, schema: str = "x double, y double, text string, paper_id string, type string, categories string") -> DataFrame:
    """CSV with a header and texts over several lines; ids stay strings, so leading zeros survive."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_lines(spark: SparkSession, path: str | None = None, literal: str | None = None, field: str = "text", lines: Iterable[str] | None = None) -> DataFrame:
    """(text) of one literal, of ``lines`` (such as standard input; a driver's own small input), of the field of a file of JSON
    lines (by its ending), or of the lines of a text file; trimmed, empty ones left out."""
    if literal is not None or lines is not None:
        rows = spark.createDataFrame([(x.rstrip("\n"),) for x in ([literal] if literal is not None else lines)], "text string")
    elif path.endswith((".jsonl", ".jsonl.gz")):
        rows = read_json_lines(spark, path, f"{field} string").select(F.col(field).alias("text"))
    else:
        rows = spark.read.text(path).withColumnRenamed("value", "text")
    return rows.select(F.trim("text").alias("text")).where("text <> ''")


def read_runs(spark: SparkSession, root: str, bucket_ids: DataFrame, share: float = 0.9, skip: tuple[str, ...] = ("EVAL", "eval_results.json"), probe: int = 50) -> DataFrame:
    """(path, qid, docid, score) of search results below a folder.

    A JSON object is a ranking if at least ``share`` of its first ``probe`` keys are queries of ``bucket_ids`` (qid[, bucket]);
    else its values are looked at, one level down.  Of several files the one with most queries of a bucket wins it.  Files
    and folders named in ``skip``, and unreadable files, are left out.
    """
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(root).select(F.input_file_name().alias("path"), "value")
    base = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    below = F.split(F.substring_index("path", base, -1), "/")
    named = F.exists(below, lambda x: F.array_contains(F.array(*map(F.lit, skip)), F.regexp_replace(x, r"\.json$", "")) | F.array_contains(F.array(*map(F.lit, skip)), x))
    files = files.where(F.col("path").rlike(r"\.json$") & ~named)
    run = "map<string, map<string, double>>"
    flat = files.select("path", F.posexplode(F.from_json("value", run)).alias("at", "qid", "docs"))
    deep = files.select("path", F.explode(F.from_json("value", f"map<string, {run}>")).alias("k", "m")).select(F.concat_ws("#", "path", "k").alias("path"), F.posexplode("m").alias("at", "qid", "docs"))
    known = bucket_ids.select("qid", (F.col("bucket") if "bucket" in bucket_ids.columns else F.lit("")).alias("bucket")).distinct()
    both = flat.unionByName(deep).where("docs is not null").join(known, "qid", "left")
    good = both.groupBy("path").agg(F.avg(F.when(F.col("at") < probe, F.col("bucket").isNotNull().cast("int"))).alias("s")).where(F.col("s") >= share)
    most = both.join(good.select("path"), "path").where("bucket is not null").groupBy("bucket", "path").agg(F.count("*").alias("n"))
    best = most.groupBy("bucket").agg(F.max_by("path", F.struct("n", "path")).alias("path"))
    return both.join(best, ["bucket", "path"]).select("path", "qid", F.explode("docs").alias("docid", "score"))


def missing_files(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Which of the files that a run needs are not below ``root``; a run starts only if none is."""
    return [n for n in names if not exists(spark, f"{root.rstrip('/')}/{n}")]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
