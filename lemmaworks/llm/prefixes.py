"""Candidates of a join on shared words that loses no pair: prefix filter on the rarest tokens, parity sketches behind it.

The occurrence tokens of all texts are put in one order, rarest first.  A text of ``n`` tokens needs at least
``o = ceil(threshold * n)`` of them in a partner, so two partners have a token in common among the first
``n - o + 1`` of each, whatever was changed and wherever.  Rarity is counted by buckets of token hashes, a table
of fixed size; any order keeps the filter complete, the counts only make it narrow.

At the first token that a pair has in common, at places i and j, all that it shares stands at or behind these
places.  So each row of a token carries the parity sketch of its *rest* (each token flips one bit), and the rests
may differ in at most ``(n - i) + (m - j) - 2 o`` tokens, which the Hamming distance of their sketches never exceeds.
Rows of a token are compared in tiles, by the bits of one or two folded words.

Rows travel as packed blocks, one for each bucket of tokens and task.  The rows of a frequent token are dealt to
cells of bounded size, so that no task holds or compares all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmaworks.llm.words import mix
from lemmaworks.session import partitions_for

BUCKETS = 1 << 18
#: 64-bit words of a sketch, and those that are compared first.
SKETCH, FIRST = 4, 3
#: A row whose rest has fewer spare tokens than this can differ from a partner in so few that FIRST words are enough for it.
NARROW = 13
#: Texts of a token that are compared in one cell, about: what a task can hold.  A row travels once for each cell of its token.
CELL = 1 << 19
#: Cells of no more rows than this are compared by shifts, many at a time.
SMALL = 24
#: Tile of rows that are compared at a time.
ROWS, COLUMNS, BAND = 32, 4096, 0.5
#: Pairs that may differ in no more bits than this are told apart by one folded word, others by two.
LOOSE = 18
#: Rows that a task compares at a time, about, and bytes of packed rows that a task keeps before it sends them.
BLOCK_ROWS, KEEP_BYTES = 25_000, 64 << 20
#: Texts sorted at a time; their number takes 14 bits of a sort key.
SLICE = 1 << 14


def flat_tokens(col: pa.Array) -> np.ndarray:
    """The tokens of a column of lists of 64-bit integers."""
    return col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def short(tok: np.ndarray) -> np.ndarray:
    """The 32 bits by which candidates are searched; two tokens that fall together only make more candidates."""
    return tok & np.uint64(0xFFFFFFFF)


def bucket(tok: np.ndarray) -> np.ndarray:
    return (mix(tok, 60) >> np.uint64(46)).astype(np.int64)


def new_rows(seen: set, names: np.ndarray) -> np.ndarray:
    """Places of the names that this task meets for the first time: a class of very many copies leaves a task once."""
    _, at = np.unique(names, return_index=True)
    at = np.sort(at)
    at = at[[k not in seen for k in names[at].tolist()]] if seen else at
    seen.update(names[at].tolist())
    return at


def rarity(texts: DataFrame) -> np.ndarray:
    """How many tokens of ``texts`` (c, toks) fall in each bucket; copies that one task holds count once."""

    def run(batches):
        total, seen = np.zeros(BUCKETS, np.int64), set()
        for b in batches:
            b = b.take(pa.array(new_rows(seen, b.column(0).to_numpy(zero_copy_only=False))))
            total += np.bincount(bucket(short(flat_tokens(b.column(1)))), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["b", "k"])

    out = np.zeros(BUCKETS, np.int64)
    rows = texts.select("c", "toks").mapInArrow(run, "b int, k bigint").groupBy("b").agg(F.sum("k").alias("k")).toArrow()
    out[rows["b"].to_numpy()] = rows["k"].to_numpy()
    return out


def needed(n: np.ndarray, threshold: float) -> np.ndarray:
    """Common tokens that a pair needs whose longer text has n."""
    return np.ceil(n * threshold - 1e-9).astype(np.int64)


def wide(n: np.ndarray, rest: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows carry all words of their sketch; of a pair with another row only the first ones are compared."""
    return rest - needed(n, threshold) >= NARROW


def entries(tok: np.ndarray, n: np.ndarray, counts: np.ndarray, place: np.ndarray, threshold: float):
    """(row, token, rest, sketch) of the rarest tokens of each of up to SLICE rows: ``rest`` tokens stand at or behind the
    token, and ``sketch`` (SKETCH columns) is theirs.  Tokens that no other text has are left out.  ``place`` puts the
    buckets in their order."""
    row = np.repeat(np.arange(len(n)), n)
    tok = short(tok)
    key = np.sort((row.astype(np.uint64) << np.uint64(50)) | (place[bucket(tok)].astype(np.uint64) << np.uint64(32)) | tok)
    tok = short(key)
    ends = np.cumsum(n)
    at = np.arange(len(tok)) - (ends - n)[row]
    keep = np.flatnonzero(at < (n - needed(n, threshold) + 1)[row])
    keep = keep[counts[bucket(tok[keep])] > 1]
    h = mix(tok, 50)
    bit, word = np.uint64(1) << (h & np.uint64(63)), (h >> np.uint64(6)) % np.uint64(SKETCH)
    sketch = np.empty((len(keep), SKETCH), np.uint64)
    for w in range(SKETCH):
        upto = np.r_[np.uint64(0), np.bitwise_xor.accumulate(np.where(word == w, bit, np.uint64(0)))] if len(tok) else np.zeros(1, np.uint64)
        sketch[:, w] = upto[ends[row[keep]]] ^ upto[keep]
    rest = n[row[keep]] - at[keep]
    sketch[~wide(n[row[keep]], rest, threshold), FIRST:] = 0  # never looked at, and packs to nothing
    return row[keep], tok[keep], rest, sketch


def cells(row: np.ndarray, tok: np.ndarray, c: np.ndarray, counts: np.ndarray):
    """(row, key, half) of every cell of every token: part i of a token meets itself (half 2) and, as half 0 or 1, each other part."""
    at, key, half = _cells(tok, c[row], counts)
    return row[at], key, half


def _cells(tok: np.ndarray, c: np.ndarray, counts: np.ndarray):
    parts = -(-counts[bucket(tok)] // CELL)
    own = (mix(c, 61) % parts.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(tok)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    mine = own[at]
    lo, hi = np.minimum(mine, other), np.maximum(mine, other)
    key = mix(mix(tok[at], 62) ^ mix((lo.astype(np.uint64) << np.uint64(32)) | hi.astype(np.uint64), 63), 64)
    return at, key, np.where(lo == hi, 2, (mine == hi).astype(np.int64)).astype(np.int8)


def named(c: np.ndarray) -> np.ndarray:
    """The 48 bits by which a class travels."""
    return (c.view(np.uint64) >> np.uint64(16)).view(np.int64)


def planes(x: np.ndarray, size: int) -> bytes:
    """The ``size`` low bytes of numbers, byte by byte of equal weight, which packs better."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T[:size].tobytes()


def from_planes(raw: np.ndarray, m: int) -> np.ndarray:
    out = np.zeros((m, 8), np.uint8)
    out[:, : len(raw) // m if m else 0] = raw.reshape(-1, m).T
    return out.view(np.int64).ravel()


def pack(key: np.ndarray, c: np.ndarray, n: np.ndarray, rest: np.ndarray, role: np.ndarray, sketch: np.ndarray) -> bytes:
    """Rows, sorted by key, as one block; most bits of a sketch are 0, so entropy coding takes off a quarter."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    head = np.array([len(key), len(first)], np.int64)
    raw = b"".join([head.tobytes(), key[first].tobytes(), np.diff(np.r_[first, len(key)]).astype(np.int64).tobytes(), sketch.tobytes(), planes(c, 6), planes(n, 4), planes(n - rest, 4), role.tobytes()])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(block: pa.Buffer):
    block = pa.decompress(block.slice(8), decompressed_size=int.from_bytes(block.slice(0, 8).to_pybytes(), "little"), codec="zstd")
    m, u = (int(x) for x in np.frombuffer(block, np.int64, 2))
    at, out = 16, []
    for kind, count, size in ((np.uint64, u, 8), (np.int64, u, 8), (np.uint64, m * SKETCH, 8), (np.uint8, m, 6), (np.uint8, m, 4), (np.uint8, m, 4), (np.int8, m, 1)):
        out.append(np.frombuffer(block, kind, count * (size if kind is np.uint8 else 1), at))
        at += count * size
    key, times, sketch, c, n, before, role = out
    c, n, before = (from_planes(x, m) for x in (c, n, before))
    return np.repeat(key, times), c, n, n - before, role, sketch.reshape(-1, SKETCH)


def folds(sketch: np.ndarray) -> np.ndarray:
    """The first FIRST words laid on two and, as a third, on one: every bit falls on one of theirs, which never adds to a distance."""
    low, last = np.uint64(0xFFFFFFFF), sketch[:, FIRST - 1]
    a, b = sketch[:, 0] ^ (last & low), sketch[:, 1] ^ (last & ~low)
    return np.stack([a, b, a ^ b])


def distance(sketch: np.ndarray, full: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bits = np.bitwise_count(sketch[a] ^ sketch[b])
    out = sum(bits[:, w].astype(np.int64) for w in range(FIRST))
    return out + (full[a] & full[b]) * sum(bits[:, w].astype(np.int64) for w in range(FIRST, SKETCH))


def close(n: np.ndarray, rest: np.ndarray, sketch: np.ndarray, full: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i of x, j of y), n[i] <= n[j], of rows of one token whose sizes, places and sketches allow the threshold."""
    before = np.setbufsize(256)  # else numpy copies both sides of a tile of fewer than 3,000 columns, which takes twice the time of comparing
    try:
        return list(_close(n, rest, sketch, full, x, y, threshold))
    finally:
        np.setbufsize(before)


def _close(n: np.ndarray, rest: np.ndarray, sketch: np.ndarray, full: np.ndarray, x: np.ndarray, y: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not len(x) or not len(y):
        return
    y = y[np.argsort(n[y], kind="stable")]
    ny, oy = n[y], needed(n[y], threshold)
    spare = rest[y] - 2 * oy + 1  # a pair may differ in less than rest_x + spare_y
    right = folds(sketch[y])
    # rows of a tile have nearly the same rest, so the same limit, and nearly the same size
    x = x[np.argsort(rest[x], kind="stable")]
    band = np.arange(len(x)) // max(ROWS, int(BAND * (len(x) * ROWS) ** 0.5))
    x = x[np.lexsort((n[x], band))]
    left = folds(sketch[x])[:, :, None]
    limit = np.floor(rest[x] / threshold + 1e-6).astype(np.int64)  # the longest partner
    ends = np.r_[np.flatnonzero(np.diff(band)) + 1, len(x)]
    begins = np.concatenate([np.arange(lo, hi, ROWS) for lo, hi in zip(np.r_[0, ends], ends)])
    firsts, lasts = np.searchsorted(ny, n[x[begins]]), np.searchsorted(ny, np.maximum.reduceat(limit, begins), side="right")
    most = np.maximum.reduceat(rest[x], begins)
    size = min(ROWS, len(x)) * min(COLUMNS, len(y))
    words, bits, more, below = (np.empty(size, k) for k in (np.uint64, np.uint8, np.uint8, bool))
    for lo, hi, first, last, top in zip(begins.tolist(), [*begins[1:].tolist(), len(x)], firsts.tolist(), lasts.tolist(), most.tolist()):
        for j in range(first, last, COLUMNS):
            e = min(j + COLUMNS, last)
            may = np.minimum(np.maximum(spare[j:e] + top, 0), 255).astype(np.uint8)
            shape = hi - lo, e - j
            w, k, m, ok = (v[: shape[0] * shape[1]].reshape(shape) for v in (words, bits, more, below))
            one = np.count_nonzero(may > LOOSE) * 8 <= len(may)
            np.bitwise_count(np.bitwise_xor(left[2 if one else 0, lo:hi], right[2 if one else 0, j:e], out=w), out=k)
            if not one:
                np.bitwise_count(np.bitwise_xor(left[1, lo:hi], right[1, j:e], out=w), out=m)
                np.add(k, m, out=k)
            hit = np.less(k, may, out=ok).ravel().nonzero()[0]
            if len(hit):
                p, q = np.divmod(hit, e - j)
                a, q = x[lo + p], j + q
                b = y[q]
                ok = (n[a] <= n[b]) & (oy[q] <= rest[a])
                a, b, q = a[ok], b[ok], q[ok]
                ok = distance(sketch, full, a, b) < rest[a] + spare[q]
                yield a[ok], b[ok]


def close_small(key: np.ndarray, n: np.ndarray, rest: np.ndarray, side: np.ndarray, half: np.ndarray, sketch: np.ndarray, full: np.ndarray, small: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for all pairs of rows of one key whose cell is small; key is sorted."""
    at = np.flatnonzero(small)
    for d in range(1, SMALL):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            return
        a, b = at, at + d
        may = (side[a] == 2) | (side[a] != side[b])
        may &= (half[a] == 2) | (half[a] != half[b])
        a, b = a[may], b[may]
        ok = distance(sketch, full, a, b) <= rest[a] + rest[b] - 2 * needed(np.maximum(n[a], n[b]), threshold)
        yield a[ok], b[ok]


def compared(cols: list[np.ndarray], threshold: float) -> np.ndarray | None:
    """Unique (a, b) among the rows (key, c, n, rest, role, sketch) of whole cells."""
    order = np.argsort(cols[0], kind="stable")
    key, c, n, rest, role, sketch = (x[order] for x in cols)
    side, half, full = role // 3, role % 3, wide(n, rest, threshold)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[starts, len(key)])
    found = list(close_small(key, n, rest, side, half, sketch, full, np.repeat((size > 1) & (size <= SMALL), size), threshold))
    for lo, k in zip(starts[size > SMALL].tolist(), size[size > SMALL].tolist()):
        g, d, h = np.arange(lo, lo + k), side[lo : lo + k], half[lo : lo + k]
        two, own = d[0] < 2, h[0] == 2
        if two and own:
            tries = [(d == 0, d == 1), (d == 1, d == 0)]
        elif two:
            tries = [((d == s) & (h == v), (d == 1 - s) & (h == 1 - v)) for s in (0, 1) for v in (0, 1)]
        elif own:
            tries = [(h == 2, h == 2)]
        else:
            tries = [(h == 0, h == 1), (h == 1, h == 0)]
        for x, y in tries:
            found += close(n, rest, sketch, full, g[x], g[y], threshold)
    if not found:
        return None
    i, j = (np.concatenate([f[k] for f in found]) for k in (0, 1))
    # of sides 0 and 1 side 0 comes first, else the smaller class
    turn = (side[i] == 1) | ((side[i] == 2) & (c[i] > c[j]))
    a, b = np.where(turn, c[j], c[i]), np.where(turn, c[i], c[j])
    ok = a != b
    return np.unique(np.stack([a[ok], b[ok]], axis=1), axis=0)


def close_pairs(texts: DataFrame, threshold: float, counted: DataFrame | None = None) -> DataFrame:
    """(a, b) of ``texts`` (c bigint, n int, toks array<bigint>, side tinyint): every pair of different c with at least
    ``threshold`` of the longer text's tokens in common, and others that their sketches do not rule out.  Rows may repeat.

    a and b are names of classes (see ``named``) of side 0 and 1; or, of texts of side 2, a < b.  ``counted`` (c, toks) may stand for ``texts`` where tokens
    are counted; it must hold them all.
    """
    spark = texts.sparkSession
    texts = texts.where("n > 0")
    counts = rarity(texts if counted is None else counted)
    place = np.empty(BUCKETS, np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(BUCKETS)
    buckets = max(partitions_for(spark), int(counts.sum() * (1 - threshold)) // BLOCK_ROWS)
    shared = spark.sparkContext.broadcast((counts, place))

    def rows(batches):
        counts, place = shared.value
        kept: dict[int, list] = {}
        size, seen = 0, set()

        def send():
            nonlocal kept, size
            whole = [np.concatenate(x) for x in zip(*kept.pop(0))] if kept else []
            size = 0
            if not whole:
                return
            # by key, and by size within a key, which packs better
            order = np.argsort((whole[0] & np.uint64(0xFFFFFFFFFFFFF000)) | np.minimum(whole[2], 4095).astype(np.uint64))
            whole = [x[order] for x in whole]
            b = ((whole[0] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in the order of the keys
            cut = np.flatnonzero(np.r_[True, np.diff(b) != 0, True])
            names, blocks = b[cut[:-1]], [pack(*(x[lo:hi] for x in whole)) for lo, hi in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

        for batch in batches:
            c, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            batch = batch.take(pa.array(new_rows(seen, mix(c.view(np.uint64), 65) + side.astype(np.uint64))))
            for lo in range(0, batch.num_rows, SLICE):
                b = batch.slice(lo, SLICE)
                c, n, side = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
                c, n = named(c), n.astype(np.int64)
                row, tok, rest, sketch = entries(flat_tokens(b.column(2)), n, counts, place, threshold)
                at, key, half = _cells(tok, c[row].view(np.uint64), counts)
                r = row[at]
                part = (key, c[r], n[r], rest[at], (side[r] * 3 + half).astype(np.int8), sketch[at])
                kept.setdefault(0, []).append(part)
                size += sum(x.nbytes for x in part)
                if size > KEEP_BYTES:
                    yield from send()
        yield from send()

    def compare(batches):
        def done(blocks):
            both = compared([np.concatenate(x) for x in zip(*map(unpack, blocks))], threshold)
            if both is not None and len(both):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])

        last, blocks = None, []
        for b in batches:
            for name, block in zip(b.column(0).to_pylist(), b.column(1)):
                if name != last and blocks:
                    yield from done(blocks)
                    blocks = []
                last = name
                blocks.append(block.as_buffer())
        if blocks:
            yield from done(blocks)

    dealt = texts.select("c", "n", "toks", "side").mapInArrow(rows, "bucket int, block binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "a bigint, b bigint").distinct()


def places(ids: np.ndarray, bits: int) -> np.ndarray:
    return mix(ids.view(np.uint64), 66) >> np.uint64(64 - bits)


def noted(ids: DataFrame, expected: int, most: int = 27):
    """A broadcast bitmap that has the bit of every id of ``ids`` (one bigint column): some 8 bits for each of the ``expected``
    ids, but at most 2 ** ``most``.  With more ids it lets more rows pass, and an exact join behind it decides.
    """
    bits = min(most, max(12, 3 + int(expected).bit_length()))

    def run(batches):
        for b in batches:
            h = places(b.column(0).to_numpy(zero_copy_only=False), bits)
            at, where = np.unique(h >> np.uint64(6), return_inverse=True)
            word = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(word, where, np.uint64(1) << (h & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(word.view(np.int64))], names=["at", "word"])

    rows = ids.mapInArrow(run, "at int, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy()
    return ids.sparkSession.sparkContext.broadcast(out.view(np.uint64))


def is_noted(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the bitmap: all that are, and few others."""
    h = places(ids, int(len(bitmap)).bit_length() + 5)
    return (bitmap[h >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1) == 1


def noted_rows(df: DataFrame, col: str, bitmap) -> DataFrame:
    """The rows whose id (bigint column ``col``) may be in the bitmap."""
    place = df.columns.index(col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(is_noted(bitmap.value, b.column(place).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(run, df.schema)


def close_links(texts: DataFrame, cand: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n_a, n_b, shared) of the candidates (a, b: names) whose tokens in ``texts`` (c, n, toks) reach the threshold,
    counted exactly; a and b are whole classes again."""
    need = cand.select(F.col("a").alias("c")).union(cand.select(F.col("b").alias("c")))
    named_texts = texts.select(F.shiftrightunsigned("c", 16).alias("name"), "c", "n", "toks")
    few = noted_rows(named_texts, "name", noted(need, 2 * cand.count())).dropDuplicates(["c"])
    side = lambda s: few.select(F.col("name").alias(s), F.col("c").alias(f"c_{s}"), F.col("n").alias(f"n_{s}"), F.col("toks").alias(f"t_{s}"))
    both = cand.join(side("a"), "a").join(side("b"), "b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b"), "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("shared"))
    return both.where(F.col("shared") >= F.greatest("n_a", "n_b") * F.lit(threshold) - F.lit(1e-9))
