r"""Markup residue: which parts of a text are markup, and the text without it.

A text is cut into a tree: the document, the elements, environments and groups that nest in it, and
leaves (text, formulas, tags, commands, marks at line starts, emphasis marks, single signs).  Whether a
node is *markup* or *content* is a hidden state of the node.  States of parent and child are tied by a
potential, a state and what the node looks like by another; both are estimated from labelled pages.
Sum-product message passing, upward and then downward, gives each node's marginal, exactly, since the
graph is a tree.  Nodes more likely markup are turned into plain structure (heading lines, list items,
indented code) or dropped; the others stay as they stand, so ``C*-algebras`` and ``n < 4`` survive.

Formulas are what stands between ``$``, ``$$``, ``\(``, ``\[`` and their ends, or in ``equation*``; they are
kept with their delimiters and are no markup, nor are the marks [REF] and [TARGET].
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.session import ship_code

#: Names of HTML and wiki tags (fixed values).
TAGS = frozenset(
    "a abbr b big blockquote body br caption center cite code col dd del details div dl dt em font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html i img input ins kbd li link main math meta nav nowiki ol p pre q references ref s samp script section small span strike strong style sub summary sup table tbody td tfoot th thead title tr tt u ul var".split()
)
CODE_ENVIRONMENTS = "verbatim|verbatim\\*|lstlisting|minted|alltt"
FORMULA = r"\$\$[^$]*(?:\$\$|\Z)|\$[^$]*(?:\$|\Z)|\\\([\s\S]*?(?:\\\)|\Z)|\\\[[\s\S]*?(?:\\\]|\Z)|\\begin\{equation\*\}[\s\S]*?(?:\\end\{equation\*\}|\Z)"
TOKEN = re.compile(
    # ordinary characters fail the first look-ahead at once; marks of line starts come first
    r"(?:(?<=\n)|\A)(?:"
    r"(?P<mdhead>[ \t]*#{1,6}[ \t]+(?=\S))|(?P<wikihead>[ \t]*(?P<eq>={2,6})[^=\n]+(?P=eq)[ \t]*(?=\n|\Z))"
    r"|(?P<rule>[ \t]*(?:-{3,}|\*{3,}|_{3,})[ \t]*(?=\n|\Z))"
    r"|(?P<item>[ \t]*(?:[-+]|[*#:;]+)[ \t]+)|(?P<number>[ \t]*[0-9]{1,3}[.)][ \t]+)"
    r"|(?P<quote>[ \t]*(?:>[ \t]?)+)|(?P<row>[ \t]*\|[^\n]*\|[ \t]*(?=\n|\Z)))"
    r"|(?=[$\\`<&\[{}!~'*_|>^#=\]])(?:"
    r"(?P<formula>" + FORMULA + r")"
    r"|(?P<fence>```[^\n`]*\n[\s\S]*?(?:```|\Z))"
    r"|(?P<verb>\\begin\{(?P<venv>" + CODE_ENVIRONMENTS + r")\}(?:\[[^\]]*\])?[\s\S]*?(?:\\end\{(?P=venv)\}|\Z))"
    r"|(?P<comment><!--[\s\S]*?(?:-->|\Z))"
    r"|(?P<tag></?(?P<name>[A-Za-z][A-Za-z0-9]*)(?P<attrs>(?:\s[^<>]*?)?)\s*/?>|<https?://[^\s<>]+>)"
    r"|(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});)"
    r"|(?P<begin>\\begin\s*\{(?P<benv>[^{}]*)\}(?:\[[^\]]*\])?)|(?P<end>\\end\s*\{[^{}]*\})"
    r"|(?P<command>\\(?P<cname>[A-Za-z@]+\*?)(?:\[[^\]\n]*\])?)|(?P<control>\\[^A-Za-z])"
    r"|(?P<wikilink>\[\[(?:[^\[\]|]*\|)?(?P<shown>[^\[\]]*)\]\])|(?P<template>\{\{[^{}]*\}\})"
    r"|(?P<mdlink>!?\[(?P<label>[^\[\]]*)\]\((?P<url>[^()\s]*)(?:\s\"[^\"]*\")?\))|(?P<mark>\[(?:REF|TARGET)\])"
    r"|(?P<ticks>`+)|(?P<strike>~~)|(?P<primes>''+)|(?P<stars>\*+)|(?P<scores>_+)|(?P<open>\{)|(?P<close>\})"
    r"|(?P<sign>[<>&|^#=~\[\]\\]))"
)
#: A text without any of these outside formulas holds no node but text. Also used on the JVM.
SUSPECT = r"[\\<>&*_`~#{}|=^]|''|\[\[|\]\(|(?:^|\n)[ \t]*(?:(?:[-+:;]|[0-9]{1,3}[.)])[ \t]|-{3,}[ \t]*(?:\n|\r|$))"
JVM_FORMULA = r"\$\$[^$]*\$\$|\$[^$]*\$|\\\([\s\S]*?\\\)|\\\[[\s\S]*?\\\]|\\begin\{equation\*\}[\s\S]*?\\end\{equation\*\}"
#: Commands whose argument is a key and not text, and commands that become a heading (fixed values).
KEY_COMMANDS = frozenset("label ref eqref cref Cref autoref nameref vref pageref cite citep citet hspace vspace hspace* vspace* color input include includegraphics bibliography bibliographystyle usepackage documentclass setcounter".split())
HEADING_COMMANDS = frozenset("part chapter section subsection subsubsection paragraph subparagraph part* chapter* section* subsection* subsubsection* paragraph*".split())
PAIRED = ("ticks", "strike", "primes", "stars", "scores")
CONTENT, MARKUP = 0, 1


class Node:
    __slots__ = ("kind", "text", "look", "kids", "name", "extra", "p", "up", "down", "belief")

    def __init__(self, kind: str, text: str = "", look: str = "", name: str = "", extra: str = ""):
        self.kind, self.text, self.look, self.name, self.extra, self.kids, self.p = kind, text, look, name, extra, [], 0.0


def side(c: str) -> str:
    return "-" if not c else "s" if c.isspace() else "w" if c.isalnum() else "p"


def parse(text: str) -> Node:
    """The tree of a text.  Opening marks without end stay open to the end of the text."""
    root = Node("document")
    stack, at = [root], 0
    waiting: dict[str, Node] = {}

    def put(n: Node) -> Node:
        stack[-1].kids.append(n)
        return n

    for m in TOKEN.finditer(text):
        kind, s = m.lastgroup, m.group()
        kind = next(k for k in _ORDER if m.group(k) is not None) if kind in _INNER else kind
        if kind == "tag" and m.group("name") and m.group("name").lower() not in TAGS and "=" not in (m.group("attrs") or ""):
            kind = "sign"
        if m.start() > at:
            put(Node("text", text[at : m.start()]))
        at = m.end()
        before, after = text[m.start() - 1 : m.start()], text[at : at + 1]
        if kind in PAIRED:
            n = put(Node(kind, s))
            opens, closes = bool(after) and not after.isspace() and side(before) != "w", bool(before) and not before.isspace() and side(after) != "w"
            key = kind + s
            if closes and key in waiting:
                mate = waiting.pop(key)
                mate.look, n.look = "open", "close"
            elif opens:
                n.look = "alone:" + side(before) + side(after)
                waiting[key] = n
            else:
                n.look = "alone:" + side(before) + side(after)
        elif kind == "tag":
            name = (m.group("name") or "url").lower()
            if s.startswith("</"):
                at_open = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind == "element" and stack[i].name == name), None)
                if at_open is not None:
                    del stack[at_open:]
                put(Node("tag", s, "end" if at_open is not None else "stray", name))
            else:
                n = put(Node("element" if name not in ("br", "hr", "img", "input", "meta", "link", "url") and not s.endswith("/>") else "tag", s, "attrs" if m.group("attrs") else "plain", name))
                if n.kind == "element":
                    stack.append(n)
        elif kind == "begin":
            n = put(Node("environment", s, "", m.group("benv").strip()))
            stack.append(n)
        elif kind == "end":
            at_open = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind == "environment"), None)
            if at_open is not None:
                del stack[at_open:]
            put(Node("end", s, "end" if at_open is not None else "stray"))
        elif kind == "open":
            n = put(Node("group", s))
            stack.append(n)
        elif kind == "close":
            at_open = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].kind == "group"), None)
            if at_open is not None:
                del stack[at_open:]
            put(Node("close", s, "end" if at_open is not None else "stray"))
        elif kind == "command":
            put(Node(kind, s, "known" if m.group("cname") in KEY_COMMANDS | HEADING_COMMANDS else "other", m.group("cname")))
        elif kind == "wikilink":
            put(Node(kind, s, "", "", m.group("shown")))
        elif kind == "mdlink":
            put(Node(kind, s, "", "", m.group("label")))
        elif kind in ("sign", "control"):
            put(Node(kind, s, s[:2] + ":" + side(before) + side(after)))
        elif kind == "item":
            put(Node(kind, s, s.strip()[:1] + (":first" if m.start() == 0 else "")))
        elif kind == "number":
            n = int(re.sub(r"\D", "", s))
            run = re.search(rf"(?:\A|\n)[ \t]*(?:{n - 1}|{n + 1})[.)][ \t]", text) is not None
            put(Node(kind, s, "run" if run else "alone"))
        else:
            put(Node(kind, s))
    if at < len(text):
        put(Node("text", text[at:]))
    return root


_GROUPS = sorted(TOKEN.groupindex, key=TOKEN.groupindex.get)
_INNER = {"venv", "name", "attrs", "benv", "cname", "shown", "label", "url", "eq"}
_ORDER = [g for g in _GROUPS if g not in _INNER]
#: Kinds whose state is not in doubt: they carry the text.
PLAIN = ("document", "text", "formula", "mark")


class MarkupModel:
    """Potentials of the tree: prior of the root, child state given parent state, looks given state."""

    def __init__(self, edge: list[list[float]], looks: dict[str, tuple[float, float]], kinds: dict[str, tuple[float, float]]):
        self.edge, self.looks, self.kinds = edge, looks, kinds

    @classmethod
    def train(cls, pages: list[tuple[str, list[tuple[int, int]]]], alpha: float = 0.5) -> MarkupModel:
        """From labelled pages: a text and the spans of it that are markup.  A node is markup if its own
        text overlaps such a span.  Counts are smoothed with ``alpha``; unseen looks fall back on the kind."""
        edge = [[alpha, alpha], [alpha, alpha]]
        looks, kinds, total = defaultdict(lambda: [alpha, alpha]), defaultdict(lambda: [alpha, alpha]), [1.0, 1.0]
        for text, spans in pages:
            place = 0

            def walk(n: Node, state: int) -> None:
                nonlocal place
                for k in n.kids:
                    lo, hi = place, place + len(k.text)
                    place = hi
                    s = int(k.kind not in PLAIN and any(a < hi and lo < b for a, b in spans))
                    if k.kind not in PLAIN:
                        edge[state][s] += 1
                        looks[k.kind + "|" + k.look][s] += 1
                        kinds[k.kind][s] += 1
                        total[s] += 1
                    walk(k, s)

            walk(parse(text), CONTENT)
        edge = [[x / sum(r) for x in r] for r in edge]
        return cls(edge, {k: (v[0] / total[0], v[1] / total[1]) for k, v in looks.items()}, {k: (v[0] / total[0], v[1] / total[1]) for k, v in kinds.items()})

    def look(self, n: Node) -> tuple[float, float]:
        return self.looks.get(n.kind + "|" + n.look) or self.kinds.get(n.kind) or (0.5, 0.5)

    def marginals(self, root: Node) -> Node:
        """Sum-product on the tree; sets ``p``, the probability of markup, of every node."""
        order = [root]
        for n in order:
            order += [k for k in n.kids if k.kind not in PLAIN]
        (e00, e01), (e10, e11) = self.edge
        for n in reversed(order):
            a, b = (1.0, 0.0) if n is root else self.look(n)
            for k in n.kids:
                if k.kind not in PLAIN:
                    ua, ub = k.up
                    a, b = a * ua, b * ub
                    s = a + b
                    a, b = a / s, b / s
            n.belief, n.up = (a, b), (e00 * a + e01 * b, e10 * a + e11 * b)
        root.down = (1.0, 1.0)
        for n in order:
            a, b = n.belief[0] * n.down[0], n.belief[1] * n.down[1]
            n.p = b / (a + b)
            for k in n.kids:
                if k.kind not in PLAIN:
                    ca, cb = a / k.up[0], b / k.up[1]
                    x, y = ca * e00 + cb * e10, ca * e01 + cb * e11
                    k.down = (x / (x + y), y / (x + y))
        return root


def is_markup(n: Node) -> bool:
    return n.p > 0.5 and n.kind not in PLAIN


def has_markup(root: Node) -> bool:
    return any(is_markup(k) or has_markup(k) for k in root.kids)


def render(root: Node) -> str:
    """The clean text: headings as ``## `` lines, items as ``- `` lines, code indented by four blanks, formulas as they stand."""
    out: list[str] = []

    def line() -> None:
        if out and not "".join(out[-2:]).endswith("\n"):
            out.append("\n")

    def code(s: str) -> None:
        line()
        out.append("\n".join("    " + x if x.strip() else "" for x in s.strip("\n").split("\n")) + "\n")

    def kids(n: Node) -> None:
        skip = False
        for i, k in enumerate(n.kids):
            if skip:  # the group that holds a key
                skip = False
                if k.kind == "group":
                    continue
            if not is_markup(k):
                out.append(k.text)
                kids(k)
                continue
            if k.kind == "command":
                if k.name in KEY_COMMANDS or k.name == "textcolor":
                    skip = True
                    if k.name.lower().endswith("ref"):
                        out.append("[REF]")
                elif k.name in HEADING_COMMANDS:
                    line()
                    out.append("## ")
                elif k.name == "item":
                    line()
                    out.append("- ")
                elif k.name == "par":
                    line()
            elif k.kind == "fence":
                body = k.text.split("\n", 1)[1] if "\n" in k.text else ""
                code(body[:-3] if body.endswith("```") else body)
            elif k.kind == "verb":
                code(re.sub(r"\A\\begin\{[^{}]*\}(?:\[[^\]]*\])?|\\end\{[^{}]*\}\Z", "", k.text))
            elif k.kind == "entity":
                out.append(html.unescape(k.text))
            elif k.kind in ("wikilink", "mdlink"):
                out.append(k.extra)
            elif k.kind == "mdhead":
                line()
                out.append("## ")
            elif k.kind == "wikihead":
                line()
                out.append("## " + k.text.strip().strip("=").strip())
            elif k.kind == "item" or k.kind == "number":
                line()
                out.append("- " if k.kind == "item" else k.text.strip() + " ")
            elif k.kind == "row":
                line()
                out.append(" ".join(x.strip() for x in k.text.strip().strip("|").split("|")))
            elif k.kind == "control":
                out.append("\n" if k.text == "\\\\" else k.text[1:] if k.text[1] in "$%&#_{}" else " ")
            elif k.kind == "element":
                if k.name == "pre":
                    inner: list[str] = []
                    _plain(k, inner)
                    code(html.unescape("".join(inner)))
                elif k.name in ("script", "style"):
                    pass
                elif k.name == "math":
                    inner = []
                    _plain(k, inner)
                    out.append("$" + "".join(inner).strip() + "$")
                else:
                    if re.fullmatch(r"h[1-6]", k.name):
                        line()
                        out.append("## ")
                    elif k.name == "li":
                        line()
                        out.append("- ")
                    elif k.name in ("p", "div", "ul", "ol", "table", "tr", "blockquote", "dl", "dt", "dd"):
                        line()
                    kids(k)
                    if k.name in ("p", "div", "table", "tr", "li") or re.fullmatch(r"h[1-6]", k.name):
                        line()
            elif k.kind == "tag":
                if k.name in ("br", "hr"):
                    line()
            elif k.kind == "environment":
                line()
                kids(k)
                line()
            elif k.kind == "group":
                kids(k)

    def _plain(n: Node, into: list[str]) -> None:
        for k in n.kids:
            if k.kind not in ("tag", "element"):
                into.append(k.text)
            _plain(k, into)

    kids(root)
    t = re.sub(r"[ \t]+\n", "\n", "".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<=\S)[ \t]{2,}(?=\S)", " ", t)).strip()


# Labelled pages -------------------------------------------------------------------------------------

_WORDS = "the space of smooth maps carries a natural norm which is bounded on every compact part so that limit exists and we may choose its value after passing to a finite cover where both sides agree".split()
_SIGNS = ["C*-algebras and W*-algebras", "$n$ < 4", "a > b", "3 < 5", "x = 2", "AT&T", "R&D", "case #5", "a ~ b", "p* and q*", "[12]", "[see above]", "5 * 3", "2^n", "x_1 and x_2", "H_*", "f|_U", "|x|", "a < b and c > d", "[REF]", "Lemma~[REF]", "[TARGET]", "G* <", "- and so on", "#S", "2*7", "k*3", "K^*-modules", "7*5*2"]


def labelled_pages(n: int = 600, seed: int = 5) -> list[tuple[str, list[tuple[int, int]]]]:
    """Pages made from a seed: prose, prose signs and formulas as content, constructs of HTML, Markdown, wiki
    and LaTeX as markup, each with the spans that are markup."""
    rnd = random.Random(seed)
    some = lambda a=1, b=5: " ".join(rnd.choice(_WORDS) for _ in range(rnd.randint(a, b)))
    pages = []
    for _ in range(n):
        buf, spans, size = [], [], 0

        def add(s: str, markup: bool = False) -> None:
            nonlocal size
            if markup:
                spans.append((size, size + len(s)))
            buf.append(s)
            size += len(s)

        def wrap(a: str, b: str, inner: str | None = None, depth: int = 0) -> None:
            add(a, True)
            add(some() if inner is None else inner)
            if depth < 3 and rnd.random() < 0.35:
                c, d = rnd.choice([("<b>", "</b>"), ("<pre><code>", "</code></pre>"), ("<li>", "</li>"), ("{\\it ", "}"), ("\\textbf{", "}"), ("\\begin{itemize}", "\\end{itemize}"), ("**", "**"), ("<a href=x>", "</a>")])
                add(" ")
                wrap(c, d, None, depth + 1)
                add(rnd.choice([" ", " " + rnd.choice(_SIGNS) + " "]) + rnd.choice(_WORDS))
            add(b, True)

        for _ in range(rnd.randint(3, 9)):
            add(rnd.choice(["", " ", " "]) + some(4, 12) + " ")
            k = rnd.random()
            if k < 0.22:
                add(rnd.choice(_SIGNS))
            elif k < 0.4:
                add(rnd.choice(["$x_1 < y$", "$$\\sum_{k} a_k$$", "\\(f * g\\)", "\\[ M \\cong N \\]", "\\begin{equation*} a = b \\end{equation*}"]))
            elif k < 0.58:
                t = rnd.choice(["b", "i", "em", "strong", "u", "sup", "span", "p", "li", "h2", "a", "code"])
                wrap(f"<{t}{rnd.choice(['', ' class=x', ' id=\"t1\"'])}>", f"</{t}>")
            elif k < 0.66:
                add(rnd.choice(["<br>", "<br/>", "<hr>", "&nbsp;", "&#160;", "&gt;", "<!-- note -->", "{{citation needed}}", "[[A|b]]", "[[word]]", "[text](#x)", "\\medskip", "\\qed", "\\label{a}", "\\cite{b}", "\\ref{c}", "\\\\", "\\noindent"]), True)
            elif k < 0.8:
                a = rnd.choice(["*", "**", "_", "__", "`", "~~", "''", "'''", "'''''"])
                wrap(a, a)
            elif k < 0.88:
                add("\n\n")
                add(rnd.choice(["# ", "## ", "### ", "- ", "* ", "+ ", "# ", "*# ", "> ", "== Word ==\n", "---\n", "| a | b |\n", "```py\nx = 1\n```\n", "\\begin{verbatim}\nx = 1\n\\end{verbatim}\n"]), True)
            else:
                c = rnd.choice(["\\textbf", "\\emph", "\\text", "\\footnote", "\\section", "\\underline"])
                add(c, True)
                if rnd.random() < 0.9:
                    wrap("{", "}")
                else:
                    wrap("{\\it ", "}")
            if rnd.random() < 0.15:
                add("\n\n")
                e = rnd.choice(["enumerate", "itemize", "center", "quote"])
                wrap(f"\\begin{{{e}}}", f"\\end{{{e}}}", " " + some(2, 6) + " ")
        pages.append(("".join(buf), spans))
    return pages


_MODEL: list[MarkupModel] = []


def default_model() -> MarkupModel:
    """The model of 600 labelled pages, made once in a process."""
    if not _MODEL:
        _MODEL.append(MarkupModel.train(labelled_pages()))
    return _MODEL[0]


def suspect(text: Column) -> Column:
    """Whether a text may hold markup: a sign of it stands outside formulas (JVM side)."""
    return F.regexp_replace(text, JVM_FORMULA, " x ").rlike(SUSPECT)


def clean_texts(df: DataFrame, key_cols: list[str], text_col: str = "text", model: MarkupModel | None = None) -> DataFrame:
    """key columns + (clean, marked): the clean text, and whether it held markup.

    Null stays null and is not marked; an empty text stays empty.  Texts without any suspicious sign do not
    leave the JVM.  Repeated rows are kept as they are.
    """
    ship_code(df.sparkSession)
    model = model or default_model()
    base = df.select(*key_cols, F.col(text_col).alias("text")).withColumn("s", F.coalesce(suspect(F.col("text")), F.lit(False)))
    k = len(key_cols)
    heads = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in key_cols)

    def run(batches):
        for b in batches:
            clean, marked = [], []
            for t, s in zip(b.column(k).to_pylist(), b.column(k + 1).to_pylist()):
                tree = model.marginals(parse(t)) if s else None
                found = tree is not None and has_markup(tree)
                clean.append(render(tree) if found else t)
                marked.append(found)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(k)], pa.array(clean, pa.string()), pa.array(marked)], names=[*key_cols, "clean", "marked"])

    return base.mapInArrow(run, f"{heads}, clean string, marked boolean")


def marked_records(df: DataFrame, key_cols: list[str], text_col: str = "text", model: MarkupModel | None = None) -> DataFrame:
    """The keys of records whose text holds markup, each once."""
    ship_code(df.sparkSession)
    model = model or default_model()
    base = df.select(*key_cols, F.col(text_col).alias("text")).where(suspect(F.col("text")))
    k = len(key_cols)
    heads = ", ".join(f"{c} {base.schema[c].dataType.simpleString()}" for c in key_cols)

    def run(batches):
        for b in batches:
            keep = [i for i, t in enumerate(b.column(k).to_pylist()) if has_markup(model.marginals(parse(t)))]
            yield pa.RecordBatch.from_arrays([b.column(i).take(pa.array(keep, pa.int64())) for i in range(k)], names=key_cols)

    return base.mapInArrow(run, heads).distinct()
