"""Writers: JSON lines, raw lines, fan-out by category, CSV, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; null fields keep their keys."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_all(parts: dict[str, DataFrame], root: str) -> None:
    """Several outputs of one pass; the frames should read one staged table."""
    for name, df in parts.items():
        write_json_lines(df, f"{root}/{name}")


def write_raw(df: DataFrame, path: str, raw: str = "_raw") -> None:
    """The lines as they were read."""
    df.select(F.col(raw).alias("value")).write.mode("overwrite").text(path)


def write_buckets(df: DataFrame, path: str, category: str = "category") -> None:
    """One folder for each category; what all share is written apart and joined, not copied."""
    df.write.mode("overwrite").partitionBy(category).parquet(path)


def write_bucket_set(queries: DataFrame, corpus: DataFrame, qrels: DataFrame, routes: DataFrame, root: str) -> None:
    """An evaluation set by bucket: ``root/queries`` and ``root/qrels`` as JSON lines with one folder for each category of
    ``routes`` (qid, category), ``root/corpus`` once.  A query without a route is in no bucket."""
    r = routes.select("qid", "category")
    by = lambda df, name: df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("category").json(f"{root}/{name}")
    by(queries.join(r.withColumnRenamed("qid", "id"), "id"), "queries")
    by(qrels.join(r, "qid"), "qrels")
    write_json_lines(corpus, f"{root}/corpus")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_predictions(df: DataFrame, path: str, category, confidence, probs) -> None:
    """Input rows with pred_category, pred_confidence and pred_probs."""
    write_json_lines(df.withColumns({"pred_category": category, "pred_confidence": confidence, "pred_probs": probs}), path)


def markdown_report(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown; more than ``limit`` rows are refused."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has at most {limit} rows")
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"


def metric_report(means: dict[str, float], title: str, judged: int, missing: int = 0) -> str:
    """Means of a run as Markdown, metrics by their report names, in the order given."""
    rows = "\n".join(f"| {metric_name(k)} | {v:.5f} |" for k, v in means.items())
    return f"# {title}\n\n{judged} judged queries, {missing} without a result\n\n| metric | mean |\n|---|---|\n{rows}\n"


def metric_name(name: str) -> str:
    """``ndcg_at_10`` as ``ndcg_cut_10``; other metrics as ``recall_100``."""
    base, _, k = name.rpartition("_at_")
    return f"{base}_cut_{k}" if base == "ndcg" else f"{base}_{k}"
