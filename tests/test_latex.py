import pytest
from pyspark.sql import functions as F

from lemmaworks.functions import latex as L
from lemmaworks.operators import attach as A
from lemmaworks.operators import pairs as P
from lemmaworks.operators import spans as S


def one(spark, f, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r["x"] for r in df.select(f(F.col("t")).alias("x")).collect()]


def test_texts(spark):
    assert one(spark, L.clean_text, " a  \n\\label{x} b ", "", None) == ["a b", "", None]
    assert one(spark, L.strip_comments, "a % b\nc \\% d", "x % y") == ["a \nc \\% d", "x "]
    assert one(spark, L.formula_count, "$a$ $$b$$ \\[c\\] \\(d\\) \\begin{align*}e\\end{align*}", "$" + "\\$" * 3000 + "$", "no") == [5, 1, 0]
    assert one(spark, L.content_words, "The quick [REF] fox $jumps$ \\emph{over} it", "") == [3, 0]
    assert one(spark, L.balanced, "\\begin{a}\\begin{b*}\\end{b}\\end{a}", "\\begin{a}\\end{b}", "\\end{a}", "\\begin{a}", "") == [True, False, False, False, True]
    assert one(spark, L.is_glue, " and Lemma~", "", "x" * 41, " implies ", ", (") == [True, True, False, False, True]
    assert one(spark, L.kind_of, "Main Definition-Theorem", "Remark", None) == ["Theorem", None, None]
    assert one(spark, L.target_window, "a" * 200 + "[TARGET]" + "b" * 60, "c" * 100) == ["a" * 80 + "[TARGET]" + "b" * 40, "c" * 80]
    assert one(spark, L.web_id, "1705_10703", "1705.10703v2", "math_0309136", "math_GT_0309136") == ["1705.10703", "1705.10703", "math/0309136", "math.GT/0309136"]
    assert one(spark, L.query_id, "x::pair0000012", "none") == ["0000012", None]
    assert one(spark, L.id_list, "b, a;b  c") == [["b", "a", "c"]]
    assert one(spark, L.definition_blocks, "<think>a</think> x<|sep|> y <|sep|>x<|sep|> <|end|>") == [["x", "y"]]
    assert one(spark, lambda c: F.size(L.json_array(c, "array<struct<a:int>>")), 'z</think> [{"a": 1}] tail', "no") [0] == 1


PAPER = r"""\newtheorem{satz}{Theorem} \newtheorem*{rem}{Remark}
\newcommand{\be}{{\bf E}} \def\two#1{x}
\section{Intro \emph{a {b} c}}
\begin{satz}[Main]\label{t1} We have \be and \beta here, all is well. \begin{proof} no \end{proof}\end{satz}
\begin{rem} Not counted, whatever stands here. \end{rem}
\begin{proof} By \ref{t1} done. \end{proof}
\section{Proof of Theorem~\ref{t0} and \ref{t1}} It follows.
\section{End}
"""


def test_papers(spark):
    df = spark.createDataFrame([("p", PAPER), ("q", None), ("r", "")], "paper_id string, text string")
    s, p, c = S.extract_papers(df)
    s, p, c = s.collect(), p.orderBy("char_start").collect(), c.collect()
    assert [r["stmt_id"] for r in s] == ["p::s0000"] and s[0]["labels"] == ["t1"] and "{{\\bf E}} and \\beta" in s[0]["text"] and "no" not in s[0]["text"].split()
    assert PAPER[s[0]["char_start"] : s[0]["char_end"]].startswith("\\begin{satz}")
    assert [(r["attached_stmt_id"], r["attach_confidence"]) for r in p] == [(None, "none"), ("p::s0000", "high")]
    assert [(r["title_refs"], r["attached_stmt_id"], r["text"]) for r in c] == [(["t1"], "p::s0000", "It follows.")]


@pytest.mark.parametrize("gap,want", [(1500, "high"), (1501, "low")])
def test_attach(spark, gap, want):
    s = spark.createDataFrame([("p", 100, "p::s0")], "paper_id string, char_end int, stmt_id string")
    p = spark.createDataFrame([("p", 100 + gap, "x", ["r"], 1), (None, 5, "y", [], 1), ("p", 50, "z", [], 1)], "paper_id string, char_start int, proof_id string, title_refs array<string>, extra int")
    got = {r["proof_id"]: r for r in A.attach_proofs(p, s).collect()}
    assert got["x"]["attach_confidence"] == "explicit" and got["x"]["attached_gap"] == gap
    assert got["y"]["attach_confidence"] == got["z"]["attach_confidence"] == "none"
    assert A.attach_proofs(p.drop("title_refs"), s).where("proof_id = 'x'").first()["attach_confidence"] == want


def test_pairs(spark):
    body = "Let $a$ be one and $b$ another thing that we want to compare with everything known about sparse operators. "
    text = body + "By Lemma~\\ref{l1} and \\ref{l2} it is so. " + body + "Using \\cref{l1} we win.\n\nNext"
    proofs = spark.createDataFrame([("f::p0", "f", None, text), ("f::p1", "f", "f::s1", text), ("f::p2", "f", None, None)], "proof_id string, paper_id string, attached_stmt_id string, text string")
    long = "Every sparse operator $T$ on this space is bounded below by some constant which depends on $T$ alone and nothing else"
    st = spark.createDataFrame([("f", ["l1"], 1, "f::s1", "Lemma", long), ("f", ["l2"], 2, "f::s2", "Lemma", long)], "paper_id string, labels array<string>, char_start int, stmt_id string, type string, text string")
    got = P.mine_pairs(proofs, st).collect()
    kept = [r for r in got if r["drop_reason"] is None]
    # in f::p1 the neighbour of l2 is the proof's own statement, which ties nothing together
    assert [(r["pair_id"], r["target"]) for r in sorted(kept, key=lambda r: r["pair_id"])] == [("f::pair0000000", "f::s1"), ("f::pair0000001", "f::s2")]
    kept.sort(key=lambda r: r["pair_id"])
    assert kept[0]["query"].endswith("[TARGET]") and "[REF]" in kept[0]["query"] and kept[0]["invoked_stmt_ids"] == ["f::s1", "f::s2"]
    assert sorted(r["drop_reason"] for r in got if r["drop_reason"]) == ["co_cited", "co_cited", "self", "self"]
    n = {r["counter"]: r["n"] for r in P.drop_report(P.mine_pairs(proofs, st), proofs).collect()}
    assert n["references"] == 6 == n["emitted"] + sum(n[r] for r in P.REASONS) and (n["proofs"], n["proofs_with_reference"], n["resolved_percent"], n["distinct_positives"], n["with_after_context"]) == (3, 2, 100, 2, 0)
    after = P.mine_pairs(proofs, st, "thought").where("pair_id = 'f::pair0000000'").first()
    assert after["query"].endswith("[TARGET] we win.")


def test_thought(spark):
    cases = {
        "we win. Next": "we win.", "so\n\nNext": "so", "a \\\\ b": "a ", "\\begin{x} a. B \\\\ c \\end{x} d\\qed e": "\\begin{x} a. B \\\\ c \\end{x} d", "here \\end{y} on": "here ", "no end": "no end", "": "", "e.g. small \\item k": "e.g. small ",
        "\\begin{a}\\begin{b} . X \\end{b}\n\n\\end{a}. $x$": "\\begin{a}\\begin{b} . X \\end{b}\n\n\\end{a}.", "\n\nx": "", "\\parbox stays \\par goes": "\\parbox stays ",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r["t"]: r["u"] for r in df.select("t", P.thought(F.col("t")).alias("u")).collect()}
    assert got == cases | {None: None}


def test_macros_with_brackets():
    from lemmaworks.operators.spans import macros

    text = "\\newcommand{\\R}{\\mathbb{R}} \\def\\x#1{no} \\newcommand{\\y}[2]{no #1} \\renewcommand*{\\z}[some text]{yes}\n\\newcommand{\\w} [a] [b]{last}\n\\def\\q{{a}{b}}"
    assert macros(text) == {"\\R": "{\\mathbb{R}}", "\\z": "{yes}", "\\w": "{last}", "\\q": "{{a}{b}}"}
