"""Words of marked-up texts as numbers, column-wise.

Texts come to Python as Arrow columns and stay columns: markup and code blocks are taken out by one linear-time
pattern (RE2), and words are found and hashed on the bytes of the whole column at once, so that no Python object
is made for a text or a word.  (The JVM's backtracking expressions took five times as long for the same words.)
Two texts are compared by their multisets of words: the k-th copy of a word is a token of its own (an
*occurrence token*), which makes the overlap of multisets the intersection of plain sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Environments and elements whose whole body is code.
CODE_ENVIRONMENTS = ("verbatim", "verbatim*", "lstlisting", "minted", "alltt")
CODE_ELEMENTS = ("pre", "script", "style")
#: What is not words: code blocks, tags, comments, entities, templates, commands that carry keys, other
#: command names, link targets, and the reference marks.
NOT_WORDS = (
    r"```(?s:.*?)(?:```|\z)"
    + "".join(rf"|<{e}\b(?s:.*?)</{e}\s*>" for e in CODE_ELEMENTS)
    + "".join(rf"|\\begin\{{{e.replace('*', '[*]')}\}}(?s:.*?)\\end\{{{e.replace('*', '[*]')}\}}" for e in CODE_ENVIRONMENTS)
    + r"|<!--(?s:.*?)-->"
    r"|</?[A-Za-z][^<>]*>"
    r"|&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);"
    r"|\{\{[^{}]*\}\}"
    r"|\\(?:label|ref|eqref|cref|Cref|autoref|nameref|vref|pageref|cite|citep|citet|begin|end|hspace|vspace|textcolor|color|input|includegraphics|url)\*?\s*(?:\[[^\]]*\]\s*)?\{[^{}]*\}"
    r"|\\[A-Za-z]+\*?"
    r"|\]\([^)\s]*\)"
    r"|\[\[[^\]|]*\|"
    r"|\[(?:REF|TARGET)\]"
)
#: Bytes hashed at a time, about; a longer text is taken whole.
CHUNK = 1 << 20
#: Rows sorted at a time; their number takes 14 bits of a sort key.
ROWS = 1 << 14

_BASE = 0x9E3779B97F4A7C15 | 5
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser applied to every element (public-domain splitmix64 constants)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: The number of a byte; an upper-case letter has that of its lower case.
_VALUE = mix(np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], np.uint64), 70)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0, 1, 2 ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < size:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.r_[np.uint64(1), np.full(max(size, CHUNK) - 1, base, np.uint64)])
        if size <= 2 * CHUNK:
            _POWERS[base] = have
    return have[:size]


def plain_words(texts: pa.Array) -> pa.Array:
    """The texts without markup; in texts beyond ASCII, what is no letter or number is a blank and letters are lower case."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    out = pc.replace_substring_regex(texts, NOT_WORDS, " ")
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(out)), False)
    if pc.any(odd).as_py():
        some = pc.replace_substring_regex(pc.utf8_lower(out.filter(odd)), r"[^\p{L}\p{N}]+", " ")
        out = pc.replace_with_mask(out, odd, some)
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-case words of a column of texts, in order, and the number of words of each row (0 for null)."""
    plain = plain_words(texts)
    n = len(plain)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    offs = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + n + 1].astype(np.int64)
    data = plain.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    parts, lens, lo = [], np.zeros(n, np.int64), 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + CHUNK, side="right")) - 1)
        h, k = _hash_chunk(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        parts.append(h)
        lens[lo:hi] = k
        lo = hi
    return np.concatenate(parts), lens


def _hash_chunk(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words are hashed as differences of one running sum over all bytes, shifted back by the inverse power of their place."""
    if not len(b):
        return np.zeros(0, np.uint64), np.zeros(len(offs) - 1, np.int64)
    word = _IS_WORD[b]
    begin, end = word.copy(), word.copy()
    begin[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    edge = offs[(offs > 0) & (offs < len(b))]  # a word ends with its row
    begin[edge] = word[edge]
    end[edge - 1] = word[edge - 1]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    with np.errstate(over="ignore"):
        v = _VALUE[b] * _powers(_BASE, len(b))
        total = np.cumsum(v, dtype=np.uint64)
        h = (total[e] - total[s] + v[s]) * _powers(pow(_BASE, -1, 1 << 64), len(b))[s]
        h = mix(h + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), 71)
    return h, np.diff(np.searchsorted(s, offs))


def occurrences(words: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence tokens (64 bit) grouped by row, and the row of each; words count as equal by 50 bits of their hashes."""
    row = np.repeat(np.arange(len(lens)), lens)
    if not len(words):
        return words, row
    ends = np.cumsum(lens)
    parts = []
    for lo in range(0, len(lens), ROWS):
        a, b = ends[lo] - lens[lo], ends[min(lo + ROWS, len(lens)) - 1]
        # one plain sort by row and word is several times as fast as one by two keys
        k = np.sort(((row[a:b] - lo).astype(np.uint64) << np.uint64(50)) | (words[a:b] >> np.uint64(14)))
        new = np.r_[True, k[1:] != k[:-1]][: len(k)]
        at = np.arange(len(k))
        nth = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
        with np.errstate(over="ignore"):
            parts.append(mix((k & np.uint64((1 << 50) - 1)) + nth * np.uint64(0xD6E8FEB86659FD93)))
    return np.concatenate(parts), row


def row_sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Wrapping sum of the values of each row (rows in order)."""
    out = np.zeros(len(lens), np.uint64)
    full = np.flatnonzero(lens)
    if len(full):
        starts = np.r_[0, np.cumsum(lens)[:-1]][full]
        with np.errstate(over="ignore"):
            out[full] = np.add.reduceat(values, starts)
    return out


def list_array(values: np.ndarray, lens: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(values, kind))
