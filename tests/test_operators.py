import random

import pytest
from pyspark.sql import functions as F

from lemmaworks import session
from lemmaworks.operators import attach as A
from lemmaworks.operators import closure as G
from lemmaworks.operators import curate as C
from lemmaworks.operators import explore as X
from lemmaworks.operators import retrieval as R
from lemmaworks.operators import spans as S
from lemmaworks.sources import readers, writers
from lemmaworks.streaming import incremental as I


def test_shared_folder_only_local(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        applicationId, master = "far-away", "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        session.shared_dir(Session())


def test_attach_a_huge_paper(spark):
    rnd = random.Random(4)
    st = [("big", rnd.randrange(100_000), f"s{i}") for i in range(300)] + [("a", 5, "a1"), (None, 5, "n"), ("zero", None, "z")]
    pr = [("big", rnd.randrange(100_000), f"p{i}", "t") for i in range(700)] + [("a", 4, "pa", "t"), ("a", 5, "pb", "t"), (None, 9, "pn", "t"), ("zero", 9, "pz", None), ("b", None, "px", "t"), ("later", 1, "pl", "t")]
    s = spark.createDataFrame(st, "paper_id string, char_end int, stmt_id string")
    p = spark.createDataFrame(pr, "paper_id string, char_start int, proof_id string, text string")
    got = {r["proof_id"]: (r["attached_stmt_id"], r["attach_confidence"]) for r in A.attach_proofs(p, s).collect()}
    assert len(got) == len(pr)
    for paper, at, name, _ in pr:
        may = [(e, i) for q, e, i in st if q is not None and q == paper and e is not None and at is not None and e <= at]
        assert got[name][0] == (max(may)[1] if may else None)
    assert got["pb"] == ("a1", "high") and got["pa"][1] == "none"
    assert A.attach_proofs(p.limit(0), s).collect() == []


def test_negatives_from_a_ring(spark):
    st = spark.createDataFrame([("p", f"s{i}") for i in range(50)] + [("p", "s0"), ("q", "only"), (None, "n")], "paper_id string, stmt_id string")
    pr = spark.createDataFrame([(f"pair{i}", "p", f"s{i}", [f"s{(i + k) % 50}" for k in range(5)] + ["elsewhere"]) for i in range(50)] + [("one", "q", "only", None), ("none", None, "s1", None)], "pair_id string, paper_id string, positive_stmt_id string, invoked_stmt_ids array<string>")
    rows = C.eligible_negatives(pr, st).collect()
    by = {}
    for r in rows:
        by.setdefault(r["pair_id"], []).append(r)
    assert set(by) == {f"pair{i}" for i in range(50)}
    for i in range(50):
        got = by[f"pair{i}"]
        assert sorted(r["rank"] for r in got) == list(range(1, 33)) and {r["num_eligible"] for r in got} == {45}
        assert not {r["stmt_id"] for r in got} & {f"s{(i + k) % 50}" for k in range(5)} and len({r["stmt_id"] for r in got}) == 32
    assert len({r["stmt_id"] for r in rows if r["rank"] == 1}) > 10
    st = st.withColumn("char_start", F.expr("try_cast(substring(stmt_id, 2) as int)"))
    first = {(r["pair_id"], r["rank"]): r["stmt_id"] for r in C.first_negatives(pr, st, 3).collect()}
    assert [first["pair0", k] for k in (1, 2, 3)] == ["s5", "s6", "s7"] and ("one", 1) not in first


def test_caps_refuse(spark):
    df = spark.createDataFrame([(i, "c", "t", f"p{i}", "x") for i in range(20)], "point_id int, categories string, type string, paper_id string, text string")
    with pytest.raises(X.TooMany):
        X.paper_filter(df, [f"p{i}" for i in range(11)])
    with pytest.raises(X.TooMany):
        X.facet_filter(df, list("abcdef"))
    assert X.paper_filter(df, [f"p{i}" for i in range(10)] * 2).count() == 10
    with pytest.raises(ValueError):
        writers.markdown_report(df, "t", 19)


def test_viewer(spark):
    df = spark.createDataFrame([(0, "b", "t", None, 1.0), (1, "a", "t", "Word", 2.0), (2, "b", "t", "word", 3.0)], "point_id int, categories string, type string, text string, x double")
    assert X.point_by_id(df, 0).first()["text"] == "" and X.point_by_id(df, 9).count() == 0
    assert {r["point_id"]: r["ordinal"] for r in X.keyword_in_order(df, "WORD", ["b", "a"]).collect()} == {2: 0, 1: 1}
    assert {r["category"]: (r["ordinal"], r["n"]) for r in X.figure_groups(df, ["b"]).collect()} == {"b": (0, 2), "a": (1, 1)}
    assert {r["category"]: r["ordinal"] for r in X.category_options(df, [], order=["b", "a"]).collect()} == {"b": 0, "a": 1}
    h = spark.createDataFrame([(["b", "a"], "All", [], " Word ", None), (["a", "b"], "All", [], "word", None)], "c array<string>, t string, p array<string>, k string, pt int")
    key = X.history_key("filter", F.col("c"), F.col("t"), F.col("p"), F.col("k"), F.col("pt"))
    assert h.select(key.alias("k")).distinct().count() == 1
    assert h.select(X.history_label(F.col("c"), F.col("t"), F.trim("k"), F.col("pt")).alias("l")).first()["l"] == 'b, a · "Word"'
    seen = X.replay(spark.createDataFrame([(1,), (7,), (None,)], "point_id int"), df)
    assert {r["point_id"]: r["visible"] for r in seen.collect()} == {1: True, 7: False, None: True}
    assert X.distinct_colours(["#000000", "#010101", "#ffffff"], 2) == ["#000000", "#ffffff"] and X.status_line(3, 3) == "3 of 3 points are marked."


def test_retrieval_stages(spark):
    v = [(i, [1.0, float(i % 7), float(i % 3)], "even" if i % 2 == 0 else "odd") for i in range(40)]
    df = spark.createDataFrame(v, "vec_id bigint, embedding array<double>, label string")
    asked = df.where("vec_id < 4").withColumn("category", F.lit("odd"))
    run = R.routed_search(df, asked, 5, "label")
    assert {r["docid"] % 2 for r in run.collect()} == {1} and run.count() == 20
    with pytest.raises(ValueError):
        R.routed_search(df, asked.unionByName(asked.withColumn("category", F.lit("even"))), 5, "label")
    re = R.rerank(run, run.select("qid", "docid", F.col("docid").cast("double").alias("score")), 3).collect()
    assert len(re) == 12 and all(r["rank"] <= 3 for r in re) and max(r["score"] for r in re if r["qid"] == 0) == next(r["score"] for r in re if r["qid"] == 0 and r["rank"] == 1)
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "p string, g string")
    assert R.accuracy(rows, "p", "g").first()["accuracy"] == 0.333333 and R.accuracy(rows.union(spark.createDataFrame([("a", None)], "p string, g string")), "p", "g").first()["accuracy"] is None
    assert spark.range(1).select(R.best_class(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5)), ["b", "a"]).alias("c")).first()["c"] == "b"


def test_runs_by_bucket(spark, tmp_path):
    import json

    (tmp_path / "EVALUATED").mkdir()
    (tmp_path / "EVAL").mkdir()
    (tmp_path / "EVALUATED/one.json").write_text(json.dumps({"a1": {"d": 1.0}, "a2": {"d": 2.0}}))
    (tmp_path / "EVALUATED/less.json").write_text(json.dumps({"a1": {"d": 9.0}}))
    (tmp_path / "two.json").write_text(json.dumps({"deep": {"b1": {"d": 3.0}}}))
    (tmp_path / "EVAL/no.json").write_text(json.dumps({"a1": {"d": 8.0}, "a2": {"d": 8.0}, "a3": {"d": 8.0}}))
    ids = spark.createDataFrame([("a1", "A"), ("a2", "A"), ("a3", "A"), ("b1", "B")], "qid string, bucket string")
    got = sorted((r["qid"], r["score"]) for r in readers.read_runs(spark, str(tmp_path), ids).collect())
    assert got == [("a1", 1.0), ("a2", 2.0), ("b1", 3.0)]
    assert readers.missing_files(spark, str(tmp_path), ["two.json", "three.json"]) == ["three.json"]


def test_small_contracts(spark):
    I.check_model({"padding_side": "left", "pooling": "last_token_index_-1", "classes": ["a"]}, ["a"], 1.0)
    for bad in ({"padding_side": "right", "pooling": "last_token_index_-1", "classes": ["a"]}, {}):
        with pytest.raises(ValueError):
            I.check_model(bad, ["a"], 1.0)
    with pytest.raises(ValueError):
        I.check_model({"padding_side": "left", "pooling": "last_token_index_-1", "classes": ["a"]}, ["a"], 0.0)
    done = spark.createDataFrame([("ok",), ("skip",), ("ok",)], "status string")
    assert {r["counter"]: r["n"] for r in I.outcome_counters(done).collect()} == {"tasks": 3, "ok": 2, "empty": 0, "skip": 1, "error": 0}
    assert C.bucket_overlaps(spark.createDataFrame([("A", "q"), ("B", "q"), ("A", "r")], "bucket string, qid string")).collect()[0]["qid"] == "q"
    part = spark.createDataFrame([("p", "d1", 1, "x")], "paper_id string, id string, at int, text string")
    both = S.with_definitions(part, spark.createDataFrame([("p", "s2", 2, "z"), ("p", "s1", 0, "y")], part.schema)).collect()
    assert [r["id"] for r in sorted(both, key=lambda r: r["ordinal"])] == ["d1", "s1", "s2"]
    assert spark.range(1).select(G.is_statement(F.lit("p::a0001")).alias("x")).first()["x"] is False


def test_more_sources(spark, tmp_path):
    import json

    (tmp_path / "in/a/b").mkdir(parents=True)
    (tmp_path / "in/a/x.tex").write_text("one % no\n")
    (tmp_path / "in/a/b/y.tex").write_text("deep")
    root = str(tmp_path / "in")
    assert [tuple(r) for r in readers.read_paper(spark, root, "a").collect()] == [("a", "one \n")] and readers.read_paper(spark, root, "a", True).first()["text"] == "one % no\n"
    (tmp_path / "t.jsonl").write_text('{"query": "q"}\n{"query": "r"}\n')
    rows, missing = readers.read_training_files(spark, [str(tmp_path / "t.jsonl"), str(tmp_path / "none.jsonl")])
    assert rows.count() == 2 and missing == [str(tmp_path / "none.jsonl")] and rows.first()["file"].endswith("t.jsonl")
    assert [r["text"] for r in readers.read_lines(spark, str(tmp_path / "t.jsonl"), field="query").collect()] == ["q", "r"]
    assert [r["text"] for r in readers.read_lines(spark, lines=["a\n", "\n", " b"]).collect()] == ["a", "b"] and readers.read_lines(spark, literal=" x ").first()["text"] == "x"
    (tmp_path / "m.json").write_text(json.dumps([{"id": "u", "n": 1}, {"id": "v"}]))
    assert [tuple(r) for r in readers.read_metadata(spark, str(tmp_path / "m.json"), "id string, n int").orderBy("row").collect()] == [(0, "u", 1), (1, "v", None)]
    q = spark.createDataFrame([("1", "t"), ("2", "u"), ("3", "no route")], "id string, text string")
    writers.write_bucket_set(q, q, q.select(F.col("id").alias("qid"), F.lit("d").alias("docid"), F.lit(1).alias("relevance")), spark.createDataFrame([("1", "A"), ("2", "B")], "qid string, category string"), str(tmp_path / "set"))
    assert {r["category"]: r["id"] for r in spark.read.json(str(tmp_path / "set/queries")).collect()} == {"A": 1, "B": 2} or spark.read.json(str(tmp_path / "set/queries")).count() == 2
    assert "| ndcg_cut_10 | 0.50000 |" in writers.metric_report({"ndcg_at_10": 0.5}, "t", 3, 1)


def test_thinking_and_last_negatives(spark):
    assert I.limit_thinking([1, 5, 5], 1, 2, 2) == 2 and I.limit_thinking([1, 5], 1, 2, 2) is None and I.limit_thinking([1, 5, 2, 5, 5, 5], 1, 2, 2) is None and I.limit_thinking([], 1, 2, 0) is None
    n = spark.createDataFrame([("p", 1, [("s", "L", "old")] * 5), ("p", 2, [("s", "L", "new")] * 5)], "pair_id string, line int, negatives array<struct<stmt_id:string,type:string,text:string>>")
    pr = spark.createDataFrame([("p", "q", "t")], "pair_id string, query string, positive_text string")
    assert C.training_records(pr, n, order="line").first()["neg"] == ["new"] * 5
