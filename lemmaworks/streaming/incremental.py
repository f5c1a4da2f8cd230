"""Incremental runs: resume by key, statuses, a streaming variant, and model functions as plug-ins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmaworks.session import ship_code
from lemmaworks.sources.readers import exists

#: Statuses that are not tried again; an empty answer is recorded, an error or a skip is not final.
FINAL = ("ok", "empty")


def pending(tasks: DataFrame, sink: str, key: str) -> DataFrame:
    """Tasks whose key has no final status in the sink (Parquet with ``key`` and ``status``)."""
    spark = tasks.sparkSession
    if not exists(spark, sink):
        return tasks
    done = spark.read.parquet(sink).where(F.col("status").isin(*FINAL)).select(key).distinct()
    return tasks.join(done, key, "left_anti")


def outcome_counters(done: DataFrame, status: str = "status") -> DataFrame:
    """(counter, n): tasks of each status, and all."""
    names = ("ok", "empty", "skip", "error")
    one = done.agg(F.count("*").alias("tasks"), *[F.count_if(F.col(status) == n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("tasks", *names)])).alias("x")).select("x.*")


def check_model(config: dict, classes: list[str], head_norm: float) -> None:
    """What a classifier's checkpoint must promise: left padding, last-token pooling, the classes in their order, a head that is not zero."""
    want = {"padding_side": "left", "pooling": "last_token_index_-1", "classes": list(classes)}
    wrong = [k for k, v in want.items() if config.get(k) != v]
    if wrong or not head_norm > 0:
        raise ValueError(f"checkpoint does not fit: {', '.join(wrong) or 'its head is zero'}")


def limit_thinking(tokens: list[int], begin: int, end: int, cap: int) -> int | None:
    """The token that a decoder must take next: ``end`` once more than ``cap`` tokens were thought since the last ``begin``
    without an end; None if it is free."""
    at = max((i for i, t in enumerate(tokens) if t == begin), default=-1)
    thinking = at >= 0 and end not in tokens[at:]
    return end if thinking and len(tokens) - at - 1 >= cap else None


def token_estimate(c):
    """Tokens of a text without a tokenizer: words, each for every four letters begun, and single signs; null for null."""
    return F.regexp_count(c, F.lit(r"\p{L}{1,4}|\p{N}{1,3}|[^\s\p{L}\p{N}]"))


def run_model(tasks: DataFrame, key: str, text: str, model: Callable[[list[str]], list[str | None]], budget: int = 150_000, size=token_estimate) -> DataFrame:
    """(key, answer, status): ``model`` on batches of texts.  Texts of more tokens than the budget are 'skip', failures 'error',
    empty answers 'empty'; none of them ends the job.  ``size`` counts tokens: an estimate, or a column made by a tokenizer."""
    ship_code(tasks.sparkSession)

    def run(batches):
        for pdf in batches:
            fits = (pdf["n"] <= budget).tolist()
            texts = [t for t, f in zip(pdf["t"], fits) if f and t is not None]
            try:
                got, failed = iter(model(texts)), False
            except Exception:  # noqa: BLE001
                got, failed = iter(()), True
            out = []
            for k, t, f in zip(pdf["k"], pdf["t"], fits):
                if not f or t is None:
                    out.append((k, None, "skip"))
                elif failed:
                    out.append((k, None, "error"))
                else:
                    a = next(got)
                    out.append((k, a, "ok" if a else "empty"))
            yield pd.DataFrame(out, columns=["k", "answer", "status"])

    src = tasks.select(F.col(key).alias("k"), F.col(text).alias("t"), F.coalesce(size(F.col(text)), F.lit(0)).alias("n"))
    return src.mapInPandas(run, f"k {src.schema['k'].dataType.simpleString()}, answer string, status string").withColumnRenamed("k", key)


def resume(tasks: DataFrame, sink: str, key: str, make: Callable[[DataFrame], DataFrame]) -> int:
    """Append what ``make`` gives for the pending tasks; the number of tasks that were pending."""
    todo = pending(tasks, sink, key)
    n = todo.count()
    if n:
        make(todo).write.mode("append").parquet(sink)
    return n


def stream_new_files(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_trigger: int = 16):
    """The same over files as they come: each is read once, a few at a time; runs until no file is left."""
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    q = df.writeStream.foreachBatch(lambda b, _: transform(b).write.mode("append").parquet(sink)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of events in windows (an extension; works on streams and tables)."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """A stored table, made if it is missing or ``force`` is set."""
    if force or not exists(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
