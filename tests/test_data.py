import glob
import json
import math
import os
import re
from decimal import Decimal

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lemmaworks.operators import curate as C
from lemmaworks.operators import explore as X
from lemmaworks.operators import retrieval as R
from lemmaworks.plans import catalog
from lemmaworks.session import running_total
from lemmaworks.sources import readers, writers
from lemmaworks.streaming import incremental as I

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, Decimal)):
        return "%.8g" % float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return None if v is None else str(v)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    r = con.execute(catalog.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    df = catalog.queries()[name](spark, DATA)
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(x[cols.index(c)]) for c in sorted(cols)) for x in r.fetchall()), key=str)
    assert sorted((tuple(plain(x[c]) for c in sorted(cols)) for x in df.collect()), key=str) == want


def test_running_total(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "k int, v long").repartition(7)
    got = {r["k"]: r["t"] for r in running_total(df, ["k"], "v", "t").collect()}
    want, t = {}, 0
    for k, v in sorted((i * 37 % 101, i) for i in range(101)):
        t += v
        want[k] = t
    assert got == want
    assert running_total(df.limit(0), ["k"], "v", "t").collect() == []


def test_negatives_and_training(spark):
    st = spark.createDataFrame([("p", f"p::s{i}", "Lemma", f"statement number {i} is long enough") for i in range(40)] + [("p", "p::x", "Lemma", "short"), ("p", "p::y", "Lemma", "\\begin{a} malformed but long text")], "paper_id string, stmt_id string, type string, text string")
    pr = spark.createDataFrame([("a::pair1", "p", "p::s0", ["p::s1"], "query text", "statement number 0 is long enough"), ("a::pair2", "none", "p::s0", None, "q", "t")], "pair_id string, paper_id string, positive_stmt_id string, invoked_stmt_ids array<string>, query string, positive_text string")
    n = {r["pair_id"]: r for r in C.negatives(pr, st).collect()}
    assert n["a::pair1"]["num_eligible"] == 40 and len(n["a::pair1"]["negatives"]) <= 32 and n["a::pair2"]["negatives"] == []
    assert not {"p::s0", "p::s1"} & {x["stmt_id"] for x in n["a::pair1"]["negatives"]}
    assert len(C.negatives(pr, st, filter_first=True).where("pair_id = 'a::pair1'").first()["negatives"]) == 32
    out = {r["pair_id"]: r["drop_reason"] for r in C.training_records(pr, C.negatives(pr, st)).collect()}
    assert out == {"a::pair1": None, "a::pair2": "few_negatives"}


def test_evaluation(spark):
    pr = spark.createDataFrame([(f"x::pair{i}", f" q{i} ", "s1" if i < 3 else "s2", "t") for i in range(5)], "pair_id string, query string, positive_stmt_id string, positive_text string")
    tr = spark.createDataFrame([("q1",), (None,)], "query string")
    ev = C.evaluation_queries(pr, tr, 3)
    assert [r["pair_id"] for r in ev.collect()] == ["x::pair0", "x::pair2", "x::pair3"]
    ng = spark.createDataFrame([("x::pair0", [("s9", "Lemma", "n"), ("s2", "Lemma", "n")]), ("x::pair1", [("s8", "Lemma", "n")])], "pair_id string, negatives array<struct<stmt_id:string,type:string,text:string>>")
    q, c, r = C.evaluation_set(ev, ng)
    assert sorted(x["id"] for x in c.collect()) == ["0", "1", "2"] and {(x["qid"], x["docid"]) for x in r.collect()} == {("0", "0"), ("2", "0"), ("3", "1")}
    report = {x["check"]: x["n"] for x in C.audit(q, c, r.union(r.limit(1)), 5).collect()}
    assert report["duplicate_qrels"] == 1 and report["expected_gap"] == 2 and report["relevance_1"] == 4


def test_vectors(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 5))
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(m)] + [(60, None, 1), (61, [0.0] * 5, 1)], "vec_id bigint, embedding array<float>, label int")
    got = {(r["qid"], r["docid"]) for r in R.top_k(df, df.where("vec_id < 3"), 7).collect()}
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for q in range(3):
        s = np.round(u @ u[q], 6)
        assert {d for a, d in got if a == q} == {i for i in np.lexsort((np.arange(60), -s)) if i != q and i < 60} & {d for a, d in got if a == q} and len([1 for a, _ in got if a == q]) == 7
    run = spark.createDataFrame([("q", "d1", 2), ("q", "d9", 1)], "qid string, docid string, rank int")
    rel = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 1), ("z", "d3", 1)], "qid string, docid string, relevance int")
    got = {r["qid"]: r for r in R.metrics(run, rel).collect()}
    assert got["z"]["ndcg"] == 0 and got["q"]["recall"] == 0.5 and math.isclose(got["q"]["ndcg"], round((1 / math.log2(3)) / (1 + 1 / math.log2(3)), 6))
    p = spark.range(1).select(R.softmax(F.array(F.lit(1.0), F.lit(1.0))).alias("s"), R.best_class(F.create_map(F.lit("b"), F.lit(0.5), F.lit("a"), F.lit(0.5))).alias("c")).first()
    assert p["s"] == [0.5, 0.5] and p["c"] == "a"


def test_explore(spark):
    df = spark.createDataFrame([(i, "c", "t", None if i == 0 else f"Text {i}") for i in range(6)], "point_id int, categories string, type string, text string")
    assert X.highlight(df, 5).count() == 0 and X.highlight(df, 6).count() == 6
    assert X.keyword_filter(df, "TEXT 1").count() == 1 and X.keyword_filter(df, ".*").count() == 0
    assert [r["disabled"] for r in X.category_options(df, ["a", "b", "d", "e", "f"]).collect()] == [True]
    assert [r["disabled"] for r in X.category_options(df, []).collect()] == [False]


def test_sources(spark, tmp_path):
    (tmp_path / "in/a/b").mkdir(parents=True)
    (tmp_path / "in/a/2.tex").write_bytes(b"two\r\n")
    (tmp_path / "in/a/1.TEX").write_bytes(b"one\xff")
    (tmp_path / "in/a/b/x.ltx").write_text("deep")
    (tmp_path / "in/a/no.txt").write_text("no")
    got = {r["paper_id"]: r["text"] for r in readers.read_papers(spark, str(tmp_path / "in")).collect()}
    assert got == {"a": "one�two\n", "a/b": "deep"}
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\n\nbad\n{"a": 2, "b": "y"}\n')
    rows = readers.read_json_lines(spark, [str(f), str(tmp_path / "missing")], "a int, b string", keep_raw=True)
    assert sorted(r["a"] for r in rows.collect()) == [1, 2]
    assert readers.read_json_lines(spark, str(f), "a int", "mark").where("_bad is not null").count() == 1
    with pytest.raises(Exception):
        readers.read_json_lines(spark, str(f), "a int", "fail").collect()
    writers.write_raw(rows, str(tmp_path / "raw"))
    assert sorted(x["value"] for x in spark.read.text(str(tmp_path / "raw")).collect())[0] == '{"a": 1}'
    writers.write_json_lines(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0]) == {"a": 1, "b": None}
    k = tmp_path / "k.jsonl"
    k.write_text('{"p": "1"}\n{"q": "2"}\n{"p": "3"}\n')
    assert {r["key"]: r["value"] for r in readers.read_keyed_lines(spark, str(k), "string").collect()} == {"p": "3", "q": "2"}
    np.save(tmp_path / "m.npy", np.eye(3, dtype=np.float32))
    assert {r["row"]: list(r["embedding"]) for r in readers.read_matrix(spark, str(tmp_path / "m.npy")).collect()}[1] == [0, 1, 0]
    c = spark.createDataFrame([(0.5, 1.0, 'a "b"\nc', "0704", "t", "math.AG")], "x double, y double, text string, paper_id string, type string, categories string")
    writers.write_csv(c, str(tmp_path / "c"))
    assert readers.read_points(spark, str(tmp_path / "c")).first()["paper_id"] == "0704"
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/r.json").write_text(json.dumps({"q1": {"d": 1.5}, "q2": {"d": 0.5}}))
    (tmp_path / "runs/EVAL.json").write_text(json.dumps({"q1": {"d": 9}}))
    ids = spark.createDataFrame([("q1",), ("q2",)], "qid string")
    assert readers.read_runs(spark, str(tmp_path / "runs"), ids).count() == 2
    assert writers.metric_name("ndcg_at_10") == "ndcg_cut_10" and "| 1 |" in writers.markdown_report(ids.select(F.lit(1)), "t")


def test_incremental(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "x"), ("b", ""), ("c", "y y " * 20)], "k string, t string")
    sink = str(tmp_path / "sink")
    make = lambda df: I.run_model(df, "k", "t", lambda ts: [t.upper() for t in ts], budget=10)
    assert I.resume(tasks, sink, "k", make) == 3
    assert {r["k"]: r["status"] for r in spark.read.parquet(sink).collect()} == {"a": "ok", "b": "empty", "c": "skip"}
    assert [r["k"] for r in I.pending(tasks, sink, "k").collect()] == ["c"]
    src = str(tmp_path / "src")
    tasks.write.parquet(src)
    I.stream_new_files(spark, src, tasks.schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("k"))
    I.stream_new_files(spark, src, tasks.schema, str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: b.select("k"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_records_of_papers(spark):
    paper = "\\newcommand{\\R}{\\mathbb{R}}\n\\newtheorem{satz}{Theorem}\n\\begin{satz}\\label{a} every \\R\\ is fine \\begin{proof} inner \\end{proof}\\end{satz} words % \\begin{lemma} gone gone gone \\end{lemma}\n\\begin{proof}[of \\ref{a}] clear \\R\\end{proof}\n\\section{Proof of Theorem \\ref{a}} body of it \\section{End}"
    got = catalog.records_of(spark.createDataFrame([("x", paper), ("y", None)], "paper_id string, text string")).collect()
    s, p, c = ([r for r in got if r["part"] == k] for k in ("statement", "proof", "section"))
    assert len(s) == 1 and s[0]["env"] == "satz" and s[0]["text"] == "\\label{a} every {\\mathbb{R}}\\ is fine" and s[0]["keys"] == ["a"]
    assert sorted(r["text"] for r in p) == ["clear {\\mathbb{R}}", "inner"] and {r["attach_confidence"] for r in p} == {"none", "explicit"}
    assert len(c) == 1 and c[0]["text"] == "body of it" and c[0]["attached_stmt_id"] == s[0]["id"]


def cut(text, env):
    """Bodies of an environment, by plain search."""
    at, out = 0, []
    while (a := text.find(f"\\begin{{{env}}}", at)) >= 0 and (b := text.find(f"\\end{{{env}}}", a)) >= 0:
        out.append(text[a + len(env) + 8 : b])
        at = b
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_records_of_tables(spark):
    docs = {(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("text is not null").collect()}
    plain = {str(i): re.sub(r"(?<!\\)%.*", "", t) for i, t in docs if "\\newtheorem" not in t}
    names = ("theorem thm mainthm maintheorem lemma lem lemm proposition prop propo corollary cor coro definition defn defi def claim conjecture conj").split()
    want = {}
    for i, t in plain.items():
        n = sum(10 < len(re.sub(r"^\[[^\]]*\]", "", x).strip()) < 3000 for e in names for x in cut(t, e))
        want |= {(i, "statement"): n} if n else {}
        want |= {(i, "proof"): len(cut(t, "proof"))} if cut(t, "proof") else {}
    got = {(r["paper_id"], r["part"]): r["count"] for r in catalog.queries()["document_records"](spark, DATA).groupBy("paper_id", "part").count().collect()}
    assert {k: v for k, v in got.items() if k[0] in plain and k[1] != "section"} == want and want
    # every stored row comes back under its paper, and nothing else
    rows = lambda t, k: {r[k]: r for r in spark.read.parquet(f"{DATA}/{t}.parquet").where("text is not null").collect()}.values()
    stored = [("statement", r["paper_id"]) for r in rows("statements", "stmt_id") if r["paper_id"]] + [("proof", r["paper_id"]) for r in rows("proofs", "proof_id") if r["paper_id"]]
    found = [(r["part"], r["paper_id"]) for r in catalog.queries()["rendered_records"](spark, DATA).collect() if r["part"] != "section"]
    assert sorted(found) == sorted(stored)
