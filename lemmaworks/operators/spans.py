r"""Papers in LaTeX to statements, proofs and proof sections.

Balanced braces and replacements that depend on the paper's own definitions are beyond the JVM's regular
expressions, so one Arrow function scans each paper once and returns all three kinds of records; a paper
that fails gives a row with its error and does not end the job.  Attachment is done on the records by
window functions (``attach.py``).
"""

from __future__ import annotations

import re

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lemmaworks.functions.latex import KINDS
from lemmaworks.operators.attach import attach_proofs, attach_sections, number_within
from lemmaworks.session import ship_code, stage

# Fixed values that must be these for the right results -------------------------------------------------
#: Environments that every paper knows, and what they stand for.
KNOWN = {
    "theorem": "Theorem", "thm": "Theorem", "mainthm": "Theorem", "maintheorem": "Theorem",
    "lemma": "Lemma", "lem": "Lemma", "lemm": "Lemma",
    "proposition": "Proposition", "prop": "Proposition", "propo": "Proposition",
    "corollary": "Corollary", "cor": "Corollary", "coro": "Corollary",
    "definition": "Definition", "defn": "Definition", "defi": "Definition", "def": "Definition",
    "claim": "Claim",
    "conjecture": "Conjecture", "conj": "Conjecture",
}
MIN_TEXT, MAX_TEXT, MAX_PROOF, CONTEXT = 10, 3000, 7000, 1000
LEVELS = "section|subsection|subsubsection|paragraph|chapter"

NEW_THEOREM = re.compile(r"(?m)^\s*\\newtheorem\*?\s*\{([^{}]+)\}\s*(?:\[[^\]]+\])?\s*\{([^{}]+)\}")
DEFINE = re.compile(r"\\(?:(?:re)?newcommand|[ex]?def)\*?\s*\{?\s*(\\[A-Za-z@]+|\\[^A-Za-z\s{}\[\]#])\s*\}?\s*")
BRACKETS = re.compile(r"\[(?!\d+\]|#)[^\n]*\]\s*(?=\{)")
HEADING = re.compile(rf"\\(?:{LEVELS})\*?\s*(?:\[[^\]]*\]\s*)?(?=\{{)")
PROOF_OF = re.compile(r"[Pp]roof\s*of.*\\(?:c|C|auto)?ref\*?\{([^{}]+)\}")
TITLE_REF = re.compile(r"\\(?:c|C|auto)?ref\*?\{([^{}]+)\}")
NESTED_PROOF = re.compile(r"(?is)\\begin\{proof\}(?:\[[^\]]*\])?.*?\\end\{proof\}")
LABEL = re.compile(r"\\label\{([^{}]+)\}")
# --------------------------------------------------------------------------------------------------------


def closing_brace(text: str, at: int) -> int:
    """Where the brace that opens at ``at`` ends (exclusive); -1 if it does not."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, at):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return -1


def environments(text: str) -> dict[str, str]:
    """Environment name -> display name: the known ones, overridden by the paper's own."""
    out = dict(KNOWN)
    for name, shown in NEW_THEOREM.findall(text):
        name = name.strip()
        if name and "\\" not in name and "%" not in name:
            out[name] = shown.strip()
    return out


def kind(display: str) -> str | None:
    low = display.lower()
    return next((k.capitalize() for k in KINDS if k in low), None)


def macros(text: str) -> dict[str, str]:
    """Commands without parameters and their bodies, braces kept; the last definition wins.  An optional text in brackets in
    front of the body does not count; a number there, or ``#``, means parameters."""
    out = {}
    for m in DEFINE.finditer(text):
        at = m.end()
        if skip := BRACKETS.match(text, at):
            at = skip.end()
        if text[at : at + 1] in ("[", "#"):
            continue
        if text[at : at + 1] == "{" and (end := closing_brace(text, at)) > 0:
            out[m.group(1)] = text[at:end]
    return out


def replacer(table: dict[str, str]):
    """A function that replaces the commands of ``table`` in one pass and counts; a longer name is no match of a shorter."""
    if not table:
        return lambda t: (t, 0)
    rx = re.compile("(" + "|".join(re.escape(k) for k in sorted(table, key=len, reverse=True)) + r")(?![A-Za-z])")
    return lambda t: rx.subn(lambda m: table[m.group(1)], t)


def spans(text: str, env: str):
    """(start, end, option, body) of an environment; the first end closes, whatever is nested."""
    e = re.escape(env)
    for m in re.compile(rf"\\begin\{{{e}\}}(?:\[([^\]]*)\])?(.*?)\\end\{{{e}\}}", re.S).finditer(text):
        yield m.start(), m.end(), m.group(1), m.group(2)


def headings(text: str):
    """(start, end, title) of section headings, titles with balanced braces."""
    for m in HEADING.finditer(text):
        if (end := closing_brace(text, m.end())) > 0:
            yield m.start(), end, text[m.end() + 1 : end - 1]


def scan_paper(text: str) -> list[tuple]:
    """Rows (part, env, type, display, keys, title, text, start, stop, before, after, truncated, replaced) of one paper."""
    change, rows = replacer(macros(text)), []
    for env, display in environments(text).items():
        k = kind(display)
        if k is None:
            continue
        for a, b, _, body in spans(text, env):
            t, n = change(NESTED_PROOF.sub("", body).strip())
            if MIN_TEXT < len(t) < MAX_TEXT:
                rows.append(("statement", env, k, display, LABEL.findall(t), None, t, a, b, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT], False, n))
    for a, b, option, body in spans(text, "proof"):
        t, n = change(body.strip())
        rows.append(("proof", "proof", None, None, TITLE_REF.findall(option or ""), option, t[:MAX_PROOF], a, b, None, None, len(t) > MAX_PROOF, n))
    heads = list(headings(text))
    for (a, b, title), (nxt, _, _) in zip(heads, heads[1:]):
        if hit := PROOF_OF.search(text[a:b]):
            t, n = change(text[b:nxt].strip())
            rows.append(("section", "section", None, None, [hit.group(1)], None, t[:MAX_PROOF], a, nxt, None, None, len(t) > MAX_PROOF, n))
    return rows


_COLUMNS = "part string, env string, type string, type_display string, keys array<string>, title_arg string, text string, char_start int, char_end int, previous_context string, following_context string, truncated boolean, replaced int"


def scan(papers: DataFrame) -> DataFrame:
    """paper_id + one row for each record found; ``error`` holds why a paper could not be read."""
    ship_code(papers.sparkSession)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    def run(batches):
        for pdf in batches:
            out = []
            for pid, text in zip(pdf["paper_id"], pdf["text"]):
                if text is None:
                    continue
                try:
                    out += [(pid, *r, None) for r in scan_paper(text)]
                except (re.error, regex.error, RecursionError, ValueError) as e:
                    out.append((pid, *[None] * len(names), str(e)))
            yield pd.DataFrame(out, columns=["paper_id", *names, "error"]).astype({"char_start": "Int32", "char_end": "Int32", "replaced": "Int32"})

    return papers.select("paper_id", "text").mapInPandas(run, f"paper_id string, {_COLUMNS}, error string")


def extract_papers(papers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(statements, proofs, sections)`` of papers (paper_id, text), numbered by position and attached.

    Comments are taken out first, so offsets are those of the text without comments.  Null texts give nothing.
    """
    from lemmaworks.functions.latex import strip_comments

    found = stage(scan(papers.withColumn("text", strip_comments(F.col("text")))), "spans")
    s = found.where("part = 'statement'").select("paper_id", "env", "type", "type_display", F.col("keys").alias("labels"), "text", "char_start", "char_end", "previous_context", "following_context")
    s = stage(number_within(s, "paper_id", ["char_start", "env"], "s", "stmt_id"), "statements")
    body = ["paper_id", "title_arg", F.col("keys").alias("title_refs"), "text", "char_start", "char_end", "truncated"]
    p = number_within(found.where("part = 'proof'").select(*body), "paper_id", ["char_start"], "p", "proof_id")
    c = number_within(found.where("part = 'section'").select(*body), "paper_id", ["char_start"], "ps", "proof_id")
    return s, attach_proofs(p, s), attach_sections(c, s)


def run_counters(found: DataFrame) -> DataFrame:
    """Counters of a run: records of each part, texts with a replaced command, replacements, characters, replacements a record."""
    return found.groupBy("part").agg(
        F.count("*").alias("records"), F.count_if(F.col("replaced") > 0).alias("touched"), F.sum("replaced").alias("replacements"), F.sum(F.length("text")).alias("characters"), F.try_divide(F.sum("replaced"), F.count("*")).alias("ratio")
    )


def with_definitions(definitions: DataFrame, statements: DataFrame) -> DataFrame:
    """(paper_id, ordinal, id, text): a paper's definitions in their order, then its statements in theirs; both (paper_id, id, at, text)."""
    both = definitions.select("paper_id", F.lit(0).alias("side"), "id", "at", "text").unionByName(statements.select("paper_id", F.lit(1).alias("side"), "id", "at", "text"))
    return both.withColumn("ordinal", F.row_number().over(W.partitionBy("paper_id").orderBy("side", "at", "id")) - 1).drop("side", "at")
