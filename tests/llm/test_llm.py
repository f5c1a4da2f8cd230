import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lemmaworks.llm import components, markup, mixing, mojibake, neardup, overlap, prefixes, sample, splits, tokens, words
from lemmaworks.llm.words import occurrences, word_hashes

VOCAB = [f"w{i}" for i in range(400)]


def text(rnd, n):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def edited(rnd, t, k):
    w = t.split()
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB)
    rnd.shuffle(w)
    return " ".join(w)


def near(a, b, t=0.7):
    x, y = Counter(a.split()), Counter(b.split())
    n = max(sum(x.values()), sum(y.values()))
    return n > 0 and sum((x & y).values()) >= t * n


# Splits ---------------------------------------------------------------------------------------------------


def test_names(spark):
    same = [["7802.10017", "7802_10017", " 7802-10017", "arXiv:7802.10017v2", "batch04/7802_10017", "7802_10017.tar.gz", "7802_10017_src", "./7802_10017", "7802_10017/\t", "https://x.org/abs/7802.10017v1"], ["math.GT/9204384", "math_GT_9204384v2", "ARXIV:MATH.GT/9204384V1", "batch1/math_GT_9204384.tex"], ["math/9204384"], ["math-ph/9204384", "math-ph_9204384"], ["7802.1001", "7802_1001v1"], ["7802.01001"], ["some text"]]
    rows = [(x, i, 1) for i, g in enumerate(same) for x in g] + [(None, 9, 1), ("7802.10017", 9, 1)]
    df = spark.createDataFrame(rows, "paper_id string, id int, component int")
    got = {(r[0], r[1]) for r in splits.same_paper_pairs(df, "paper_id").collect()}
    assert got == {(a, b) for g in same for a in g for b in g if a < b}
    assert splits.same_paper_pairs(df.limit(0), "paper_id").collect() == []


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, None), (900, 900)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    root = {x: x for e in edges for x in e if x is not None and None not in e}
    for _ in range(80):
        for a, b in edges:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_incremental_splits(spark):
    targets = [("train", 0.8), ("validation", 0.1), ("test", 0.1)]
    first = spark.createDataFrame([(f"{1000 + i}.{10000 + i}", 1 + i % 5) for i in range(3000)] + [("9999.11111", 900), (None, 5)], "paper_id string, weight int")
    t1 = splits.update_components(None, first, targets)
    a = {r["paper_id"]: r for r in t1.collect()}
    share = Counter()
    for r in a.values():
        share[r["split"]] += r["weight"]
    whole = sum(share.values())
    assert all(abs(share[n] / whole - s) < 0.01 for n, s in targets)
    two = [next(k for k, r in a.items() if r["split"] == s) for s in ("train", "test")]
    batch = spark.createDataFrame([("arXiv:1000.10000v2", 3), ("8888.22222", 4), (two[0], 1)], "paper_id string, weight int")
    links = spark.createDataFrame([tuple(two)], "a string, b string")
    b = {r["paper_id"]: r for r in splits.update_components(t1, batch, targets, links).collect()}
    assert b["arXiv:1000.10000v2"]["split"] == b["1000.10000"]["split"] or "1000.10000" in two
    assert all(b[k]["quarantined"] and b[k]["split"] is None for k in two) and b["8888.22222"]["split"] in share
    assert all(b[k]["split"] == a[k]["split"] for k in a if k not in two)


def test_persisted_splits(spark, tmp_path):
    targets = [("train", 0.8), ("test", 0.2)]
    path = str(tmp_path / "table")
    rows = lambda lo, hi: spark.createDataFrame([(f"{1000 + i}.{10000 + i}", 2) for i in range(lo, hi)], "paper_id string, weight int")
    a = {r["paper_id"]: r["split"] for r in splits.persisted_update(path, rows(0, 500), targets).collect()}
    (tmp_path / "table/version-00000001").mkdir()  # a version that was not finished
    b = {r["paper_id"]: r for r in splits.persisted_update(path, rows(400, 900), targets).collect()}
    assert len(b) == 900 and all(b[k]["split"] == v for k, v in a.items()) and sum(r["weight"] for r in b.values()) == 2000
    assert abs(sum(r["weight"] for r in b.values() if r["split"] == "test") / 2000 - 0.2) < 0.01
    st = spark.createDataFrame([(f"{1000 + i}.{10000 + i}", f"{1000 + i}.{10000 + i}::s1", i) for i in range(300)] + [(None, "x::s1", 1), (None, None, 1)], "paper_id string, stmt_id string, t int").withColumn("ingested_at", F.timestamp_seconds("t"))
    pr = spark.createDataFrame([(f"odd {i}", f"p{i}", f"{1000 + i}.{10000 + i}::s1", 290) for i in range(50)], "paper_id string, pair_id string, positive_stmt_id string, t int").withColumn("ingested_at", F.timestamp_seconds("t"))
    t = spark.createDataFrame(targets, "split string, target_share double")
    got = {r["paper_id"]: r for r in splits.splits_in_batches(st, pr, t, str(tmp_path / "two")).collect()}
    assert all(got[f"odd {i}"]["component"] == got[f"{1000 + i}.{10000 + i}"]["component"] for i in range(50)) and got["x"]["outcome"] == "kept"
    assert {r["outcome"] for r in got.values()} == {"kept", "new"} and all(r["before"] in (None, r["split"]) for r in got.values())
    again = splits.record_splits(st, pr, t, str(tmp_path / "two"))
    assert {r["record_id"]: r["split"] for r in again.collect()} == {r["record_id"]: got[r["record_id"].split("::")[0] if "::" in r["record_id"] else f"odd {r['record_id'][1:]}"]["split"] for r in again.collect()}


# Near duplicates and overlaps ---------------------------------------------------------------------------------


def corpus(rnd):
    docs, base = [], [text(rnd, rnd.randint(5, 140)) for _ in range(150)]
    for i, t in enumerate(base):
        docs.append((f"a{i}", t))
        if i % 3 == 0:
            docs.append((f"b{i}", edited(rnd, t, len(t.split()) // 25)))
        if i % 10 == 0:
            docs += [(f"c{i}", "<b>" + t.upper() + "</b> \\label{x}"), (f"d{i}", t)]
    return docs + [("e1", ""), ("e2", "  "), ("n", None), (None, base[0]), docs[0], ("long", text(rnd, 60_000))]


def test_near_duplicates(spark):
    docs = corpus(random.Random(5))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "stmt_id string, text string, n int, c string")
    flat = {i: re.sub(r"<[^>]*>|\\label\{x\}", "", t).lower() for i, t in docs if i and t}
    want = {(a, b) for a in flat for b in flat if a < b and near(flat[a], flat[b])}
    got = {(r["id_a"], r["id_b"]) for r in neardup.duplicate_pairs(df, "stmt_id", "text").collect()}
    assert got <= want and len(got) >= 0.98 * len(want)
    groups = {r["id"]: r for r in neardup.duplicate_groups(df, "stmt_id", "text").collect()}
    assert len(groups) == len({i for i, t in docs if i and t is not None}) and groups["a0"]["group_id"] == groups["d0"]["group_id"] and groups["e1"]["n_links"] == 0
    assert neardup.duplicate_pairs(df.limit(0), "stmt_id", "text").collect() == []


def test_overlaps(spark):
    rnd = random.Random(6)
    rows, base = [], [text(rnd, rnd.randint(3, 120)) for _ in range(120)]
    for i, t in enumerate(base):
        w = t.split()
        rows.append((f"p{i}", "train", t, None))
        if i % 3 == 0:
            for _ in range(len(w) // 20):
                w[rnd.randrange(len(w))] = "changed"
            cut = len(w) // 2
            rows.append((f"q{i}", "test" if i % 2 else "validation", " ".join(w[cut:] + w[:cut]), base[i // 2]))
    rows += [("z", None, base[0], base[0]), ("y", "test", None, ""), (None, "test", base[0], None), rows[0]]
    df = spark.createDataFrame([(*r, "s", 7) for r in rows], "pair_id string, split string, query string, positive_text string, source string, n int")
    got = {(r["id_a"], r["id_b"]) for r in overlap.overlap_pairs(df, "pair_id", "split", ["query", "positive_text"]).collect()}
    good = [r for r in rows if r[0] and r[1]]
    want = {(min(a[0], b[0]), max(a[0], b[0])) for a in good for b in good if a[1] == "train" != b[1] and any(a[k] and b[k] and near(a[k], b[k]) for k in (2, 3))}
    assert got == want
    report = {(r["split"], r["source"]): r for r in overlap.overlap_report(df, "pair_id", "split", "source", ["query", "positive_text"]).collect()}
    assert sum(r["overlapping"] for r in report.values()) == len({b for a, b in want})
    assert overlap.overlap_pairs(df.limit(0), "pair_id", "split", ["query"]).collect() == []


def scattered(rnd, count, sizes):
    """Texts and copies with single words replaced all over, from 0.7 to 0.95 alike: {id: text}."""
    out = {}
    for i in range(count):
        w = [rnd.choice(VOCAB) for _ in range(rnd.choice(sizes))]
        out[f"a{i}"] = " ".join(w)
        for at in rnd.sample(range(len(w)), int(len(w) * (0.05 + 0.25 * (i % 6) / 5))):
            w[at] = f"new{rnd.randrange(300)}"
        out[f"b{i}"] = " ".join(w)
    return out


def test_near_duplicates_of_scattered_edits(spark):
    texts = scattered(random.Random(17), 90, [12, 30, 45, 60, 120, 400])
    df = spark.createDataFrame(list(texts.items()), "stmt_id string, text string")
    got = {(r["id_a"], r["id_b"]) for r in neardup.duplicate_pairs(df, "stmt_id", "text").collect()}
    want = {(a, b) for a in texts for b in texts if a < b and near(texts[a], texts[b])}
    assert got == want and len(want) >= 75


def test_overlaps_of_scattered_edits(spark):
    rnd = random.Random(16)
    texts = scattered(rnd, 90, [12, 30, 45, 60, 120, 400])
    every9 = [f"u{i}" for i in range(63)]
    texts |= {"a_ninth": " ".join(every9), "b_ninth": " ".join("x" if i % 9 == 8 else w for i, w in enumerate(every9))}
    df = spark.createDataFrame([(i, "train" if i[0] == "a" else "test", t, None, "s") for i, t in texts.items()], "pair_id string, split string, query string, positive_text string, source string")
    got = {(r["id_a"], r["id_b"]) for r in overlap.overlap_pairs(df, "pair_id", "split", ["query", "positive_text"]).collect()}
    want = {(a, b) for a in texts for b in texts if a[0] == "a" and b[0] == "b" and near(texts[a], texts[b])}
    assert got == want and ("a_ninth", "b_ninth") in want and len(want) >= 75
    members, links = overlap.overlaps(df, "pair_id", "split", ["query"], ordered=True)
    ninth = links.join(members.where("id = 'b_ninth'"), F.col("tid") == F.col("tid_eval")).first()
    assert ninth["seeds"] > 0 and ninth["shared"] == 56 and ninth["aligned"] == 56


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def test_alignment():
    rnd = random.Random(3)
    short = 0
    for _ in range(300):
        a = [rnd.randrange(1, 200) for _ in range(rnd.randint(1, 90))]
        b = list(a)
        for _ in range(rnd.randint(0, len(a) // 5)):
            at, what = rnd.randrange(len(b)), rnd.random()
            b[at : at + (what < 0.7)] = [] if what < 0.3 and len(b) > 1 else [rnd.randrange(200, 300)]
        _, n = overlap.align(np.array(a, np.uint64), np.array(b, np.uint64))
        best = longest_common(a, b)
        assert n <= best
        short += n < best
    assert short <= 3
    cut = overlap.align(np.arange(1, 61, dtype=np.uint64), np.r_[31:61, 1:31].astype(np.uint64))
    assert cut[1] == 30
    assert overlap.align(np.zeros(0, np.uint64), np.arange(5, dtype=np.uint64)) == (0, 0)
    same = np.full(3000, 7, np.uint64)
    assert overlap.align(same, same)[1] == 3000


def test_prefix_cells():
    tok = np.repeat(np.uint64(5), 60)
    counts = np.full(prefixes.BUCKETS, prefixes.CELL * 2 + 1)
    row, key, half = prefixes.cells(np.arange(60), tok, np.arange(60).astype(np.uint64), counts)
    met = Counter()
    for a in range(len(row)):
        for b in range(a):
            if key[a] == key[b] and (half[a] == 2 or half[a] != half[b]):
                met[frozenset((row[a], row[b]))] += 1
    assert len(set(key)) == 6 and len(met) == 60 * 59 // 2 and set(met.values()) == {1}


@pytest.mark.parametrize("cell,small,sides", [(1 << 15, 24, False), (7, 24, False), (40, 3, False), (1 << 15, 3, True), (9, 3, True), (1 << 15, 24, True)])
def test_candidates_lose_nothing(monkeypatch, cell, small, sides):
    """Every pair at the threshold is a candidate, whatever the sizes of cells and tiles; packing changes nothing."""
    monkeypatch.setattr(prefixes, "CELL", cell)
    monkeypatch.setattr(prefixes, "SMALL", small)
    monkeypatch.setattr(prefixes, "ROWS", 5)
    monkeypatch.setattr(prefixes, "COLUMNS", 11)
    rnd = np.random.default_rng(cell + small)
    sets = []
    for _ in range(60):
        base = rnd.choice(120, rnd.integers(1, 60), replace=False)
        sets.append(base)
        for _ in range(2):
            keep = base[rnd.random(len(base)) < 0.85]
            sets.append(np.unique(np.r_[keep, rnd.choice(120, rnd.integers(0, 8), replace=False), base[:1]]))
    sets = [np.unique(x) for x in sets]
    n = np.array([len(x) for x in sets])
    tok = prefixes.mix(np.concatenate(sets).astype(np.uint64), 3)
    c = np.arange(len(sets)) * 7 + 1
    side = rnd.integers(0, 2, len(sets)).astype(np.int8) if sides else np.full(len(sets), 2, np.int8)
    counts = np.bincount(prefixes.bucket(prefixes.short(tok)), minlength=prefixes.BUCKETS)
    place = np.empty(prefixes.BUCKETS, np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(prefixes.BUCKETS)
    row, t, rest, sketch = prefixes.entries(tok, n, counts, place, 0.7)
    at, key, half = prefixes._cells(t, c[row].view(np.uint64), counts)
    r = row[at]
    cols = [key, c[r], n[r], rest[at], (side[r] * 3 + half).astype(np.int8), sketch[at]]
    order = np.argsort(key, kind="stable")
    cols = [x[order] for x in cols]
    back = prefixes.unpack(pa.py_buffer(prefixes.pack(*cols)))
    assert all((np.asarray(x) == np.asarray(y)).all() for x, y in zip(cols, back))
    got = {tuple(x) for x in prefixes.compared(list(back), 0.7).tolist()}
    want = set()
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if len(np.intersect1d(x, y)) >= 0.7 * max(len(x), len(y)) - 1e-9 and (i < j if not sides else (side[i], side[j]) == (0, 1)):
                want.add((int(c[i]), int(c[j])))
    assert want <= got and len(want) > 20


def test_hot_lists():
    """Rows of a token of 400,000 texts travel once, and a long list is compared tile by tile, in little memory and as pair by pair."""
    tok = np.repeat(np.uint64(5), 1000)
    at, _, half = prefixes._cells(tok, np.arange(1000).astype(np.uint64), np.full(prefixes.BUCKETS, 400_000))
    assert len(at) == 1000 and set(half) == {2}
    rnd = np.random.default_rng(3)
    n = rnd.integers(40, 110, 40_000)
    rest = n - (rnd.random(len(n)) * (n - prefixes.needed(n, 0.7) + 1)).astype(int)
    sketch = np.zeros((len(n), prefixes.SKETCH), np.uint64)
    for i in range(400):  # copies, some of them with a few bits changed, and rows that differ in all
        sketch[100 * i : 100 * i + 100] = rnd.integers(0, 1 << 63, prefixes.SKETCH)
    for w in range(prefixes.FIRST):
        sketch[::3, w] ^= np.uint64(1) << rnd.integers(0, 64, len(sketch[::3])).astype(np.uint64)
    full, some = prefixes.wide(n, rest, 0.7), np.arange(1500)
    got = [np.concatenate(k) for k in zip(*prefixes.close(n, rest, sketch, full, some, some[::-1], 0.7))]
    i, j = (k.ravel() for k in np.meshgrid(some, some, indexing="ij"))
    o = prefixes.needed(n[j], 0.7)
    ok = (n[i] <= n[j]) & (o <= rest[i]) & (prefixes.distance(sketch, full, i, j) <= rest[i] + rest[j] - 2 * o)
    assert ok.sum() > 10_000 and sorted(zip(*got)) == list(zip(i[ok], j[ok]))
    tracemalloc.start()
    try:
        for _ in prefixes.close(n, rest, sketch, full, np.arange(500), np.arange(len(n)), 0.7):
            pass
        assert tracemalloc.get_traced_memory()[1] < 300 * len(n)
    finally:
        tracemalloc.stop()


# Markup -------------------------------------------------------------------------------------------------------

MARKED = ["a <b>b</b>", "x &nbsp; y", "<!-- c --> d", "**bold** text", "a _b_ c", "`code` x", "# Title\n\ntext", "- one\n- two", "> said", "~~no~~ yes", "[a](#b) c", "[[a|b]] c", "''it'' x", "== H ==\nx", "{{cite|a}} b", "\\emph{a} b", "{\\it a} b", "\\begin{itemize}\\item a\\end{itemize}", "x \\qed", "a\\label{b}", "see~\\ref{x}", "```\nx\n```", "\\begin{verbatim}\nx\n\\end{verbatim}", "<pre><code>x</code></pre>", "<math>x</math> y", "a<br/>b", "\\begin{equation} x \\end{equation}"]
CLEAN = ["plain words", "", "C*-algebras and W*-algebras", "When $n$ < 4 and m > 2", "By [REF] and [TARGET] we", "$a < b$ and $$\\frac{a}{b}$$", "\\(x_{1}\\) or \\[ \\mathcal{F} \\]", "\\begin{equation*} \\alpha \\end{equation*} holds", "Lemma~[REF] says", "AT&T has 5 * 3", "it's 10-fold"]


def test_markup(spark):
    rows = [("f", str(i), t, i < len(MARKED)) for i, t in enumerate(MARKED + CLEAN)] + [("f", "null", None, False)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "field string, record_id string, text string, want boolean, clean string")
    got = {r["record_id"] for r in markup.marked_records(df, ["field", "record_id"]).collect()}
    assert got == {r[1] for r in rows if r[3]}
    clean = {r["record_id"]: r["clean"] for r in markup.clean_texts(df, ["field", "record_id"]).collect()}
    assert clean["null"] is None and all(clean[r[1]] == r[2] for r in rows if not r[3])


def test_rule_lines(spark):
    rows = [("f", str(i), t) for i, t in enumerate(["one\n\n---\n\ntwo", "one\n----\ntwo", "---\none", "one\n-----"])] + [("f", "dash", "one --- two"), ("f", "word", "one\n---two")]
    got = {r["record_id"] for r in markup.marked_records(spark.createDataFrame(rows, "field string, record_id string, text string"), ["field", "record_id"]).collect()}
    assert got == {"0", "1", "2", "3"}
    seen = [bool(re.search(markup.SUSPECT, re.sub(markup.JVM_FORMULA, " ", t))) for t in MARKED]
    assert all(seen)


def test_prose_signs_not_trained_on():
    m = markup.default_model()
    signs = ["B*-algebras and H*-modules", "e.g. 3*4 = 12", "C^*-dynamical systems", "2 < 3 and 5 > 4", "Smith & Jones", "f: X -> Y", "if a < b then c", "100 < x", "see #7 below", "the 1st - and last - point", "a|b", "[1] Smith", "p-adic * q-adic", "n! > 2n", "http://x.org/a_b"]
    assert not [t for t in signs if markup.has_markup(m.marginals(markup.parse(t)))]
    assert not set(signs) & set(markup._SIGNS)


def test_rendering():
    m = markup.default_model()
    show = lambda t: markup.render(m.marginals(markup.parse(t)))
    assert show("<h2>Title</h2><p>Let $x<1$ be <b>big</b>&gt;</p><ul><li>a</li><li>b</li></ul>") == "## Title\nLet $x<1$ be big>\n- a\n- b"
    assert show("\\section{A}\nWe \\textbf{know}\\label{k} \\ref{z}.\n\\begin{enumerate}\\item one \\item two\\end{enumerate}").startswith("## A\nWe know [REF].\n- one")
    assert "    x = 1" in show("text\n```py\nx = 1\n```\n") and "    y" in show("a <pre><code>y</code></pre>")
    assert show("[word](#x) and [[a|b]] of C*-algebras ''now''") == "word and b of C*-algebras now"
    long = "<p>" * 300 + "x" + "\\begin{a}" * 300
    assert "x" in show(long)


def test_held_out():
    m = markup.MarkupModel.train(markup.labelled_pages(300, 1))
    right = total = 0
    for t, spans in markup.labelled_pages(150, 2):
        tree, at = m.marginals(markup.parse(t)), 0

        def walk(n):
            nonlocal right, total, at
            for k in n.kids:
                lo, at = at, at + len(k.text)
                if k.kind not in markup.PLAIN:
                    total += 1
                    right += markup.is_markup(k) == any(a < at and lo < b for a, b in spans)
                walk(k)

        walk(tree)
    assert right / total > 0.98


# Sample and mix ------------------------------------------------------------------------------------------------------


def test_sample(spark):
    cats = ["math.CO"] * 60 + [" Math-AG "] * 30 + ["GT"] * 8 + [None, "other"]
    pairs = spark.createDataFrame([(f"p::pair{i:03d}", "Lemma" if i % 3 else "Claim", i) for i in range(100)] + [("p::pair000", "Claim", 0), (None, None, 1), ("odd", "x", 1)], "pair_id string, positive_type string, category int")
    routing = spark.createDataFrame([(f"{i:03d}", c, 0.5) for i, c in enumerate(cats)] + [("000", "math.CO", 0.5), ("999", "GT", 0.1), (None, "GT", 0.1)], "qid string, category string, confidence double")
    targets = spark.createDataFrame([("math.CO", 0.5, 5, 0.3), ("math.AG", 0.2, 5, 0.3), ("math.GT", 0.29, 9, 0.3), ("math.LO", 0.01, 2, 0.3)], "category string, target_share double, min_rows bigint, sample_fraction double")
    drawn, report = sample.draw(pairs, routing, targets)
    r = {x["category"]: x for x in report.collect()}
    n = Counter(x["category"] for x in drawn.collect())
    assert {k: v["drawn"] for k, v in r.items()} == {"math.CO": 15, "math.AG": 6, "math.GT": 8, "math.LO": 0} and n == Counter({"math.CO": 15, "math.AG": 6, "math.GT": 8})
    assert {k for k, v in r.items() if v["short"]} == {"math.GT", "math.LO"}
    again = {x["pair_id"] for x in sample.draw(pairs.repartition(5), routing, targets)[0].collect()}
    assert again == {x["pair_id"] for x in drawn.collect()}
    assert sample.draw(pairs.limit(0), routing, targets)[0].collect() == []
    # one category only on one side: the other margin still comes near its target, and what is missing is told
    big = spark.createDataFrame([(f"p::pair{i:05d}", "Lemma" if i % 4 else "Claim", i) for i in range(8000)], "pair_id string, positive_type string, category int")
    both = spark.createDataFrame([(f"{i:05d}", ["math.CO", "math.AG", "math.GT"][i % 3], 0.5) for i in range(8000)], "qid string, category string, confidence double")
    _, _, m = sample.draw_margins(big, both, targets, {"Lemma": 0.5, "Claim": 0.5})
    m = {(r["margin"], r["value"]): r for r in m.collect()}
    assert m["size", "sample"]["drawn"] == 2376 and abs(m["level", "Claim"]["residual"]) < 0.001 and abs(m["category", "math.CO"]["residual"]) < 0.01 and m["category", "math.LO"]["drawn"] == 0
    w = sample.rake({("a", "x"): 10, ("a", "y"): 30, ("b", "x"): 40, ("b", "y"): 20}, [{"a": 0.5, "b": 0.5}, {"x": 0.3, "y": 0.7}])
    share = {k: v * w[k] for k, v in {("a", "x"): 10, ("a", "y"): 30, ("b", "x"): 40, ("b", "y"): 20}.items()}
    whole = sum(share.values())
    assert abs((share["a", "x"] + share["a", "y"]) / whole - 0.5) < 1e-6 and abs((share["a", "x"] + share["b", "x"]) / whole - 0.3) < 1e-6


def test_mix(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, " big " if i % 10 else "Small-one", text(rnd, rnd.randint(5, 60)), i) for i in range(300)] + [(900, None, "x y", 1), (901, "big", None, 1), (902, "else", "z", 1)], "doc_id bigint, source string, text string, tokens int")
    targets = spark.createDataFrame([("big", 0.5, 1, 0.5), ("small_one", 0.3, 2, 0.5), ("none", 0.2, 3, 0.5)], "source string, target_share double, max_repeats bigint, budget_fraction double")
    uses, report = mixing.mix(docs, targets)
    u, r = uses.collect(), {x["source"]: x for x in report.collect()}
    assert r["big"]["short"] is False and r["none"]["short"] and all(x["repeats"] <= (1 if x["source"] == "big" else 2) for x in u)
    assert 0 <= r["big"]["missing_tokens"] < 400 and r["big"]["mixed_tokens"] == sum(x["tokens"] * x["repeats"] for x in u if x["source"] == "big")
    assert mixing.mix(docs.limit(0), targets)[0].collect() == []
    # the queue, copy by copy: shares hold at every place of the mix while no source is used up, and the budget is the end
    whole = sum(x["tokens"] for x in tokens.count_tokens(docs, "doc_id", "text", "source").collect())
    used = sum(x["tokens"] * x["repeats"] for x in u)
    assert used <= whole * 0.5 and used > whole * 0.5 - 130
    assert all(x["first_finish"] > 0 and 0 <= x["first_place"] < whole * 0.5 for x in u)
    early = [x for x in u if x["first_place"] + x["tokens"] <= used // 3]
    part = Counter()
    for x in early:
        part[x["source"]] += x["tokens"]
    assert abs(part["big"] / sum(part.values()) - 0.5 / 0.8) < 0.05
    assert [x["first_place"] for x in sorted(u, key=lambda x: x["first_finish"])] == sorted(x["first_place"] for x in u)


def test_virtual_end():
    steps = [{"share": 0.5, "cap": 100, "tokens": 100}, {"share": 0.3, "cap": 10_000, "tokens": 1000}, {"share": 0.2, "cap": 0, "tokens": 0}]
    v = mixing.virtual_end(steps, 400)
    assert abs(sum(min(s["cap"], s["share"] * v) for s in steps) - 400) < 1e-6
    assert mixing.virtual_end(steps, 10**9) == float("inf") and mixing.virtual_end([], 5) == float("inf")


# Token ids -----------------------------------------------------------------------------------------------------------------


def test_token_ids(spark):
    tk = pytest.importorskip("tokenizers")
    P = pytest.importorskip("public_tokenizers")
    t = tk.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = ["", None, "Hello world's  end\n\n x", "a\u00a0b\u2003\u2028c \x85d", "e\u0301 \U0001d53d\U0001d542 \u4e2d\u6587 123\u0664", "<|endoftext|> isn't", " \t\r\n", "x" * 5000, " " * 3000 + "y", "\U00011f02\U0001e030 new", "it'll we've I'M", "a\x1cb\x1fc"]
    df = spark.createDataFrame([(i, x, "e") for i, x in enumerate(texts)] + [(2, texts[2], "e")], "doc_id bigint, text string, ids string").repartition(3)
    got = {}
    for r in tokens.encode_corpus(df, "doc_id", "text").collect():
        assert r["doc_id"] not in got
        got[r["doc_id"]] = list(r["ids"])
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    enc = spark.createDataFrame(list(got.items()), "doc_id bigint, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in tokens.decode_corpus(enc, "doc_id").collect()} == {i: x or "" for i, x in enumerate(texts)}
    n = {r["id"]: r["tokens"] for r in tokens.count_tokens(df, "doc_id", "text", "ids").collect()}
    assert n == {k: len(v) for k, v in got.items()}
    assert tokens.encode_corpus(df.limit(0), "doc_id", "text").collect() == []
    twice = spark.createDataFrame([(1, "alpha beta gamma", "s"), (1, "delta beta gamma", "s"), (1, "alpha beta gamma", "s"), (None, "x", "s"), (None, "x", "s"), (3, None, "s"), (3, "", "s")], "doc_id bigint, text string, source string").repartition(4)
    assert sorted(r["doc_id"] or 0 for r in tokens.encode_corpus(twice, "doc_id", "text").collect()) == [0, 1, 1, 3]
    assert tokens.count_tokens(twice, "doc_id", "text", "source").count() == 4


# Wrong encodings ----------------------------------------------------------------------------------------------------------------


def test_mojibake(spark):
    words = "réalité élève près déjà fenêtre naïve garçon Größe Übung schön fünf Fläche año niño órbita además acción más".split()
    rnd = random.Random(2)
    clean = [(i, " ".join(rnd.choice(words) for _ in range(25)) + " NÃO É “fine” – x—Ç") for i in range(60)]
    bad, at = [], 100
    for a, b in (("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("utf-8", "cp1251")):
        for _ in range(6):
            t = " ".join(rnd.choice(words) for _ in range(12))
            bad.append((at, t, mojibake.garble(t, ((a, b),))))
            at += 1
    rows = clean + [(i, g) for i, _, g in bad] + [(500, "la r\ufffdalit\ufffd vue"), (501, None), (502, ""), (503, "ascii")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, lost int")
    got = {r["id"]: r for r in mojibake.affected(df, "doc_id", "text").collect()}
    assert set(got) == {i for i, _, _ in bad} | {500}
    # read from one byte to another, a letter is restored only in words with a twin: "año" and "más" have too short a skeleton
    whole = [i for i, t, _ in bad if got[i]["restored"] == t]
    assert all(i in whole for i, _, _ in bad if not 112 <= i < 118) and got[500]["restored"] == "la réalité vue"
    assert mojibake.affected(df.limit(0), "doc_id", "text").collect() == []


def test_words():
    rnd = random.Random(8)
    texts = [
        "Let $x_1$ be \\textbf{Big} <b>one</b> \\label{k}```py\nz\n``` [REF] \\begin{verbatim}q\\end{verbatim}", None, "", " . ", "ÉTÉ été Été 中文 x²", "a<pre>b\nc</pre>d", "```never closed", "&amp;a &#12;b", "{{t|u}}v [[a|b]] [c](#d)",
        "\\begin{verbatim*}x\\end{verbatim*}y\\begin{minted}z", "a<!-- x --> b", "word" * 3000, *[text(rnd, rnd.randint(0, 30)) for _ in range(200)],
    ]
    want = [["let", "x", "1", "be", "big", "one"], [], [], [], ["été", "été", "été", "中文", "x²"], ["a", "d"], [], ["a", "b"], ["v", "b", "c"], ["y", "z"], ["a", "b"], ["word" * 3000], *[t.split() for t in texts[12:]]]
    h, lens = word_hashes(pa.array(texts, pa.string()))
    assert lens.tolist() == [len(w) for w in want]
    name = {}
    assert all(name.setdefault(w, x) == x for w, x in zip((w for t in want for w in t), h.tolist())) and len(set(name.values())) == len(name)
    old, words.CHUNK = words.CHUNK, 64
    try:
        assert (word_hashes(pa.array(texts, pa.string()).slice(0))[0] == h).all()
    finally:
        words.CHUNK = old
    assert len(word_hashes(pa.array([], pa.string()))[0]) == 0
    tok, row = occurrences(h, lens)
    assert len(tok) == len(h) and len(set(tok[row == 4].tolist())) == 5
