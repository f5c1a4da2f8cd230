"""Text garbled by a wrong character decoding: learned from clean near-twins, then repaired.

1. Words with a character outside ASCII are counted over the whole corpus.  A word's *skeleton* is what
   is left without those characters; a garbled word and its clean twin have the same skeleton.
2. Words are joined with the most frequent word of their skeleton and aligned at the skeleton's
   characters.  Each aligned pair of runs that differ is evidence ``(run, twin run, words)``.
3. A *transformation* is a way to write text in one encoding and read it in another, once or twice.  The
   executors find which ones explain each pair; pairs are then counted by the set that explains them, and
   those that explain many different pairs are learned, the best first.
4. A learned transformation tells how every character seen in clean words looks when garbled.  Runs of
   two or more characters are specific and are searched for in every text; single characters, which may
   be rightful letters, count only in words that turn, undone, into a word that is at least as frequent.
   U+FFFD stands for lost bytes; what stood there is restored only in a word with one clean twin.

What reaches the driver are characters (bounded by Unicode) and sets of transformations, never pairs or words.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmaworks.session import ship_code, stage

#: Encodings that a text may be written in or wrongly read in (fixed values).
ENCODINGS = ["latin-1", "cp1252", "mac_roman", "cp437", "cp850", "cp852", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_9", "iso8859_15"]
LOST = "�"
RUN = re.compile(r"[^\x00-\x7f]+")
ENTITY_RUN = re.compile(r"[^\x00-\x7f]*(?:&[A-Za-z]{2,8};[^\x00-\x7f]*)+")
#: What separates words: ASCII white space and punctuation that stands between words.
BETWEEN = r"[\x00-\x20.,;:()\[\]{}]+"
#: Fixes of fewer documents than this are broadcast; more are joined by a shuffle.
SMALL_FIXES = 50_000
#: A transformation is learned if it explains at least so many different pairs of runs not yet explained.
MIN_PAIRS = 3


def _read(raw: bytes, enc: str) -> str:
    """Decode; bytes that the encoding leaves undefined become the control of the same number, as browsers do."""
    try:
        return raw.decode(enc)
    except UnicodeDecodeError:
        out = []
        for b in raw:
            try:
                out.append(bytes([b]).decode(enc))
            except UnicodeDecodeError:
                out.append(chr(b))
        return "".join(out)


def garble(text: str, steps: tuple) -> str | None:
    """The text after each (written, read) step; None if a step cannot be taken."""
    for written, read in steps:
        try:
            raw = text.encode(written)
        except UnicodeEncodeError:
            if written != "cp1252":
                return None
            try:  # controls pass through, see _read
                raw = b"".join(c.encode("latin-1") if 0x80 <= ord(c) < 0xA0 else c.encode(written) for c in text)
            except UnicodeEncodeError:
                return None
        text = raw.decode("utf-8", "replace") if read == "utf-8" else _read(raw, read)
    return text


def candidate_steps() -> list[tuple]:
    """All transformations considered: UTF-8 read as another encoding (once or twice), and one single-byte encoding read as another."""
    once = [(("utf-8", e),) for e in ENCODINGS]
    twice = [(("utf-8", a), ("utf-8", b)) for a in ENCODINGS for b in ENCODINGS]
    single = [((a, b),) for a in ENCODINGS for b in ENCODINGS if a != b]
    return once + twice + single


def explained(bad: str, good: str, steps: list[tuple]) -> list[int]:
    """Numbers of the transformations that make ``bad`` out of ``good``."""
    return [i for i, st in enumerate(steps) if garble(good, st) == bad]


def learn(sets: dict[tuple, tuple[int, int]]) -> list[tuple]:
    """The transformations that explain the evidence, best first (greedy cover).

    ``sets``: numbers of ``candidate_steps`` that explain a pair of runs -> (pairs, words) of all pairs with just this set.
    """
    steps = candidate_steps()
    cost = lambda i: (len(steps[i]), sum(e not in ("utf-8", "latin-1", "cp1252") for st in steps[i] for e in st), str(steps[i]))
    live, learned = dict(sets), []
    while live:
        score: dict[int, list[int]] = {}
        for k, (pairs, words) in live.items():
            for i in k:
                x = score.setdefault(i, [0, 0])
                x[0] += pairs
                x[1] += words
        best = max(score, key=lambda i: (*score[i], *(-x for x in cost(i)[:2]), cost(i)[2]))
        if score[best][0] < MIN_PAIRS:
            break
        learned.append(steps[best])
        live = {k: v for k, v in live.items() if best not in k}
    return learned


def tables(learned: list[tuple], chars: list[str], clean: set[str], seen: dict[tuple[str, str], int]) -> tuple[dict[str, str], dict[str, set[str]]]:
    """``(sequences, singles)``: garbled sequence -> original for sequences of two characters or more, and
    single garbled character -> possible originals, of all ``chars`` that may be originals under all learned transformations.
    ``clean`` are those that rightly stand in texts.

    ``seen``: (garbled, original) -> words, what twins show directly, character by character.
    """
    seq: dict[str, Counter] = defaultdict(Counter)
    one: dict[str, set[str]] = defaultdict(set)
    for rank, steps in enumerate(learned):
        for c in chars:
            bad = garble(c, steps)
            if bad is None or bad == c or LOST in bad or bad.isascii():
                continue
            if len(bad) >= 2:
                seq[bad][c] += 1000 - rank
            elif steps[0][0] != "utf-8":
                one[bad].add(c)
    # a sequence all of whose characters are rightful ones may stand in clean text; it needs such a twin
    rightful = lambda bad: all(c in clean for c in bad)
    best = {}
    for bad, c in seq.items():
        known = [g for g in c if seen.get((bad, g))]
        if known or not rightful(bad):
            best[bad] = max(known or c, key=lambda g: (seen.get((bad, g), 0), c[g], g))
    return best, dict(one)


def undone(text: str, steps: tuple) -> str | None:
    """What the transformation made the text out of; None if it did not."""
    out = text
    for written, read in reversed(steps):
        try:
            out = out.encode(read).decode(written)
        except (UnicodeEncodeError, UnicodeDecodeError):
            try:  # undefined bytes pass as controls, see _read
                out = b"".join(c.encode("latin-1") if 0x80 <= ord(c) < 0xA0 else c.encode(read) for c in out).decode(written)
            except (UnicodeEncodeError, UnicodeDecodeError):
                return None
    return out if out != text and garble(out, steps) == text else None


def word_counts(df: DataFrame, text_col: str) -> DataFrame:
    """(word, n, skeleton): distinct words with a character outside ASCII, and how often they stand."""
    words = df.select(F.explode(F.filter(F.split(F.col(text_col), BETWEEN), lambda w: w.rlike(r"[^\x00-\x7F]"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).withColumn("skeleton", skeleton(F.col("word")))


def skeleton(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x00-\x7F]+", "")


def twins(words: DataFrame) -> DataFrame:
    """(word, n, twin, twin_n): each word with the most frequent other word of its skeleton of three characters or more."""
    w = words.where("length(skeleton) >= 3")
    top = w.where(~F.col("word").contains(LOST)).groupBy("skeleton").agg(F.max_by("word", F.struct("n", "word")).alias("twin"), F.max("n").alias("twin_n"))
    return w.join(top, "skeleton").where("word <> twin").select("word", "n", "twin", "twin_n")


def aligned(word: str, twin: str) -> list[tuple[str, str]] | None:
    """The differing pairs of runs at the same places of the common skeleton; None if the places differ."""

    def runs(x: str) -> dict[int, str]:
        out, before = {}, 0
        for m in RUN.finditer(x):
            out[m.start() - before] = m.group()
            before += m.end() - m.start()
        return out

    a, b = runs(word), runs(twin)
    return [(a[k], b[k]) for k in a if a[k] != b[k]] if a.keys() == b.keys() else None


def evidence(tw: DataFrame) -> DataFrame:
    """(bad, good, n) from aligned twins: the rarer word is the supposedly garbled one; equally rare, either."""
    ship_code(tw.sparkSession)

    def run(batches):
        for b in batches:
            acc = {"bad": [], "good": [], "n": []}
            for w, n, t, m in zip(*[b.column(i).to_pylist() for i in range(4)]):
                for x, y in aligned(w, t) or ():
                    for p, q, k in ((x, y, n), (y, x, m)) if n == m else ((x, y, n),):
                        acc["bad"].append(p)
                        acc["good"].append(q)
                        acc["n"].append(k)
            yield pa.RecordBatch.from_pydict({"bad": pa.array(acc["bad"], pa.string()), "good": pa.array(acc["good"], pa.string()), "n": pa.array(acc["n"], pa.int64())})

    return tw.select("word", "n", "twin", "twin_n").mapInArrow(run, "bad string, good string, n bigint").groupBy("bad", "good").agg(F.sum("n").alias("n"))


class Model:
    """What was learned; small, and the same for every task."""

    def __init__(self, learned: list[tuple], sequences: dict[str, str], singles: dict[str, set[str]]):
        self.learned, self.sequences, self.singles = learned, sequences, singles
        self.lead = "".join(sorted({s[0] for s in sequences}))
        self._rx = None

    def pattern(self):
        """All sequences, the longest first, behind a class of their first characters."""
        if self._rx is None:
            by = defaultdict(list)
            for s in self.sequences:
                by[s[0]].append(s[1:])
            alts = [re.escape(h) + "(?:" + "|".join(re.escape(t) for t in sorted(by[h], key=lambda t: (-len(t), t))) + ")" for h in sorted(by)]
            self._rx = re.compile("|".join(alts)) if alts else re.compile(r"(?!)")
        return self._rx

    def repair(self, text: str) -> tuple[str, int]:
        """The text with all garbled sequences restored, and their number.  Doubly garbled text is undone
        by its own sequences first; what they leave is looked at once more."""
        total = 0
        if "&" in text:  # garbled and then written with entities

            def plain(m):
                nonlocal total
                got, n = self.pattern().subn(lambda x: self.sequences[x.group()], html.unescape(m.group()))
                total += n
                return got if n else m.group()

            text = ENTITY_RUN.sub(plain, text)
        for _ in range(2):
            text, n = self.pattern().subn(lambda m: self.sequences[m.group()], text)
            total += n
            if not n:
                break
        return text, total

    def __getstate__(self):
        return {"learned": self.learned, "sequences": self.sequences, "singles": self.singles, "lead": self.lead, "_rx": None}

    def __setstate__(self, s):
        self.__dict__.update(s)


def fit(words: DataFrame) -> tuple[Model, DataFrame]:
    """``(model, twins)`` from the word counts of the corpus."""
    tw = stage(twins(words), "twins")
    ev = stage(evidence(tw).where(f"bad <> good and not contains(bad, '{LOST}') and not contains(good, '{LOST}')"), "evidence")

    def sets(batches):
        steps = candidate_steps()
        for b in batches:
            got = [",".join(map(str, explained(x, y, steps))) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), b.column(2)], names=["k", "n"])

    by_set = ev.select("bad", "good", "n").mapInArrow(sets, "k string, n bigint").where("k <> ''").groupBy("k").agg(F.count("*").alias("pairs"), F.sum("n").alias("n")).collect()
    learned = learn({tuple(map(int, r["k"].split(","))): (r["pairs"], r["n"]) for r in by_set})

    def parts(batches):
        for b in batches:
            out = {"kind": [], "a": [], "b": [], "n": []}
            for x, y, n in zip(*[b.column(i).to_pylist() for i in range(3)]):
                steps = next((s for s in learned if garble(y, s) == x), None)
                if steps is not None:
                    rows = [("bad", x, None, n), ("good", y, None, n), *[("seen", garble(c, steps), c, n) for c in y]]
                    for k, v in zip(out, zip(*rows)):
                        out[k] += v
            yield pa.RecordBatch.from_pydict({"kind": pa.array(out["kind"], pa.string()), "a": pa.array(out["a"], pa.string()), "b": pa.array(out["b"], pa.string()), "n": pa.array(out["n"], pa.int64())})

    found = stage(ev.select("bad", "good", "n").mapInArrow(parts, "kind string, a string, b string, n bigint").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")), "runs")
    seen = {(r["a"], r["b"]): r["n"] for r in found.where("kind = 'seen'").collect()}
    # a character is clean if no garbled run has it, or if it stands more often on the clean side of the evidence
    per_char = lambda df, c: {r["c"]: r["n"] for r in df.select("n", F.explode(F.array_distinct(F.split(c, ""))).alias("c")).where(F.col("c").rlike(r"[^\x00-\x7F]")).groupBy("c").agg(F.sum("n").alias("n")).collect()}
    bad, good = (per_char(found.where(F.col("kind") == k), "a") for k in ("bad", "good"))
    clean = {c for c in set(per_char(words, "word")) | set(good) if c != LOST and (c not in bad or good.get(c, 0) > bad[c])}
    seq, one = tables(learned, sorted(clean | set(good)), clean, seen)
    return Model(learned, seq, one), tw


def garbled_words(words: DataFrame, tw: DataFrame, model: Model) -> DataFrame:
    """(word, restored) of words that a learned transformation of single bytes made out of a word at least as frequent, or
    the loss of bytes out of their twin.  Whole words are undone, so short ones need no long skeleton."""
    single = [s for s in model.learned if s[0][0] != "utf-8"]

    def undo(batches):
        for b in batches:
            out = {"word": [], "restored": [], "n": []}
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in dict.fromkeys(g for g in (undone(w, s) for s in single) if g is not None and not g.isascii()):
                    out["word"].append(w)
                    out["restored"].append(g)
                    out["n"].append(n)
            yield pa.RecordBatch.from_pydict({"word": pa.array(out["word"], pa.string()), "restored": pa.array(out["restored"], pa.string()), "n": pa.array(out["n"], pa.int64())})

    def lost(batches):
        for b in batches:
            bad, good = [], []
            for w, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                runs = aligned(w, t)
                if runs and all(set(p) == {LOST} and len(p) == len(q) for p, q in runs):
                    bad.append(w)
                    good.append(t)
            yield pa.RecordBatch.from_pydict({"word": pa.array(bad, pa.string()), "restored": pa.array(good, pa.string())})

    known = words.select(F.col("word").alias("restored"), F.col("n").alias("known"))
    made = words.where(~F.col("word").contains(LOST)).select("word", "n").mapInArrow(undo, "word string, restored string, n bigint").join(known, "restored").where("known >= n")
    best = made.groupBy("word").agg(F.max_by("restored", F.struct("known", "restored")).alias("restored"))
    return best.unionByName(tw.where(F.col("word").contains(LOST)).select("word", "twin").mapInArrow(lost, "word string, restored string").groupBy("word").agg(F.min("restored").alias("restored")))


def char_class(chars: str) -> str:
    """A Java class of characters beyond ASCII: ASCII fails at its first part, and neighbours are one range, for the JVM asks
    every member of a class in turn."""
    codes, ranges = sorted(set(map(ord, chars))), []
    for c in codes:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return r"[[^\x00-\x7F]&&[" + "".join(f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for a, b in ranges) + "]]"


def affected(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, passages, lost): records with at least one garbled passage, their text with everything
    restored that can be, the number of restored passages, and of lost characters that remain.

    Null and empty texts are never affected.  Repeated rows count once.  Right letters, accents, capitals
    and symbols of any script are left alone.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]|&[A-Za-z]{2,8};"))
    kind = docs.schema["id"].dataType.simpleString()
    words = stage(word_counts(docs, "text"), "word_counts")
    model, tw = fit(words)
    bad = stage(garbled_words(words, tw, model), "garbled")
    # words of documents that may be garbled in a way that only the twin shows
    marks = "".join(sorted(model.singles)) + LOST
    cls = char_class(marks)
    per_doc = docs.where(F.col("text").rlike(cls)).select("id", F.explode(F.array_distinct(F.filter(F.split("text", BETWEEN), lambda w: w.rlike(cls)))).alias("word"))
    fixes = per_doc.join(bad, "word").groupBy("id").agg(F.map_from_entries(F.collect_set(F.struct("word", "restored"))).alias("fixes"))
    lead = char_class(model.lead + LOST)

    def run(batches):
        rx = re.compile(r"[^\x00-\x20.,;:()\[\]{}]+")
        for b in batches:
            out = {"id": [], "restored": [], "passages": [], "lost": []}
            for i, (text, fix) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                fix = dict(fix) if fix else {}
                n = 0
                if fix:
                    before = text
                    text = rx.sub(lambda m: fix.get(m.group(), m.group()), text)
                    n += sum(m.group() in fix for m in rx.finditer(before))
                text, k = model.repair(text)
                lost = text.count(LOST)
                if n + k + lost:
                    out["id"].append(b.column(0)[i].as_py())
                    out["restored"].append(text)
                    out["passages"].append(n + k)
                    out["lost"].append(lost)
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], b.column(0).type), pa.array(out["restored"], pa.string()), pa.array(out["passages"], pa.int32()), pa.array(out["lost"], pa.int32())], names=list(out))

    fixes = stage(fixes, "fixes")
    some = docs.join(F.broadcast(fixes) if fixes.count() <= SMALL_FIXES else fixes, "id", "left").where(F.col("fixes").isNotNull() | F.col("text").rlike(lead + r"|&[A-Za-z]{2,8};"))
    return some.select("id", "text", "fixes").mapInArrow(run, f"id {kind}, restored string, passages int, lost int").distinct()
