"""Suffix-array repetition: how much of a text repeats itself, and for how long.

The word suffix arrays of a batch of texts are built together by prefix doubling (numpy sorts;
after a few rounds only suffixes that do repeat are left). Longest-common-prefix values between
neighbouring suffixes give the LCP intervals; each interval whose occurrences have different left
neighbours is a maximal repeated substring. The union of their spans and the longest of them are
held against limits. A text is a unit of its own, so the operator needs no shuffle.

Defined results: null or empty text has no words and fails the base rule (fewer than 10 words);
repeated rows give equal rows; an empty table gives an empty table; columns other than the id and
the text are ignored (``annotate``) or passed through whatever their names (``keep_documents``);
a null id stays null. Memory follows CHUNK_BYTES or the longest single text.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import as_bytes, give_back, id_and_text, importable, in_chunks, SPACES, text_chunks

CHUNK_BYTES = 1_500_000
SYMBOLS = b"#*$%&|<>"
MIN_REPEAT = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_COVERED = 0.20
MAX_LONGEST = 200

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, covered_chars long, longest_repeat long, n_maximal_repeats long"
)


def repeated_suffixes(ids: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix-array order of the suffixes that share a prefix of ``least`` words or more with a neighbour.

    ids: words of all texts, one after another; starts: where each text begins. Returns (sa, lcp):
    positions in suffix order, and the common prefix with the one before (0 where under ``least``).
    Suffixes of different texts never share a prefix.
    """
    n = len(ids)
    none = np.empty(0, np.int64)
    if n < 2:
        return none, none
    doc = np.zeros(n, np.int64)
    doc[starts[(starts > 0) & (starts < n)]] = 1
    ends = np.append(np.flatnonzero(doc), n)
    doc = np.cumsum(doc)
    end = ends[doc]
    key = doc * (int(ids.max()) + 1) + ids
    act = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    new = np.append(True, key[act][1:] != key[act][:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[act] = first
    k, enough = 1, None
    while True:
        # groups of two or more go on; the others are in their final place
        grouped = ~(new & np.append(new[1:], True))
        act = act[grouped]
        if not len(act):
            break
        levels.append((act, rank[act].copy()))
        if 2 * k > least and enough is None:
            enough = len(levels) - 1
        ahead = act + k
        second = np.where(ahead < end[act], rank[np.minimum(ahead, n - 1)] + 1, 0)
        old = rank[act]
        order = np.argsort(old * (n + 1) + second, kind="stable")
        act, old, second = act[order], old[order], second[order]
        place = np.arange(len(act))
        fresh = np.append(True, old[1:] != old[:-1])
        new = fresh | np.append(True, second[1:] != second[:-1])
        rank[act] = old + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(fresh, place, 0))
        k *= 2
    if enough is None:
        return none, none
    sa = levels[enough][0]
    sa = sa[np.argsort(rank[sa], kind="stable")]
    a, b = sa[:-1], sa[1:]
    at = np.zeros(len(a), np.int64)
    same = np.empty(n, np.int64)
    for j in range(len(levels) - 1, -1, -1):
        same[:] = -1 - np.arange(n)
        same[levels[j][0]] = levels[j][1]
        x, y = a + at, b + at
        inside = (x < end[a]) & (y < end[b])
        at += np.where(inside & (same[np.minimum(x, n - 1)] == same[np.minimum(y, n - 1)]), 1 << j, 0)
    lcp = np.append(0, at)
    lcp[lcp < least] = 0
    return sa, lcp


def lcp_intervals(sa: np.ndarray, lcp: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """LCP intervals (length, first, last) in sa whose occurrences have different words before them.

    before: for each position of the text, the word before it; each text's first word has its own.
    """
    values = lcp.tolist()
    left = before[sa].tolist() if len(sa) else []
    stack: list[list] = []  # [length, first, left word or None where several]
    for k in range(len(values) + 1):
        value = values[k] if k < len(values) else 0
        start, word = k - 1, left[k - 1] if k else None
        while stack and stack[-1][0] > value:
            length, start, seen = stack.pop()
            word = seen if seen == word else None
            if word is None:
                yield length, start, k - 1
        if value:
            if stack and stack[-1][0] == value:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == word else None
            else:
                stack.append([value, start, word])


def measure(texts: list[bytes], max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> list[tuple]:
    """A tuple of SCHEMA without doc_id for each text."""
    out: list[tuple] = []
    for lo, hi in in_chunks([len(t) for t in texts], CHUNK_BYTES):
        split = [t.split() for t in texts[lo:hi]]
        sizes = np.array([len(w) for w in split], np.int64)
        starts = np.append(0, np.cumsum(sizes))
        flat = [w for words in split for w in words]
        number: dict[bytes, int] = defaultdict(count(1).__next__)
        ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
        chars_of = np.zeros(len(number) + 1, np.int64)
        chars_of[1:] = [len(w) if w.isascii() else len(w.decode("utf-8", "replace")) for w in number]
        sa, lcp = repeated_suffixes(ids, starts[:-1], MIN_REPEAT)
        reach = np.zeros(len(flat), np.int64)
        if len(sa):
            reach[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
        edge = np.zeros(len(flat) + 1, np.int64)
        at = np.flatnonzero(reach)
        edge[at] += 1
        np.subtract.at(edge, at + reach[at], 1)
        covered = np.cumsum(edge[:-1]) > 0
        before = np.append(0, ids[:-1]) if len(ids) else ids
        inner = starts[:-1][sizes > 0]
        before[inner] = -1 - inner
        owner = np.repeat(np.arange(hi - lo), sizes)
        maximal = np.zeros(hi - lo, np.int64)
        longest = np.zeros(hi - lo, np.int64)
        for length, first, _ in lcp_intervals(sa, lcp, before):
            d = owner[sa[first]]
            maximal[d] += 1
            longest[d] = max(longest[d], length)
        chars = chars_of[ids]
        per = lambda x: np.bincount(owner, x, hi - lo).astype(np.int64)
        repeat_words, covered_chars, word_chars = per(covered), per(chars * covered), per(chars)
        for k, text in enumerate(texts[lo:hi]):
            n = int(sizes[k])
            lines = [x for x in text.split(b"\n") if x.strip(SPACES)] if b"\n" in text else ()
            failed = n < MIN_WORDS or 100 * int(repeat_words[k]) > MAX_REPEAT_PERCENT * n
            kept = not failed and covered_chars[k] <= max_covered * word_chars[k] and longest[k] <= max_longest
            symbols = len(text) - len(text.translate(None, SYMBOLS))
            out.append((n, int(word_chars[k]), symbols, len(lines) - len(set(lines)), int(repeat_words[k]), failed, bool(kept), int(covered_chars[k]), int(longest[k]), int(maximal[k])))
    return out


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row of SCHEMA for each row of df."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.bool_() if x in ("base_failed", "kept") else pa.int64() for x in names[1:]]
        for b in batches:
            for ids, texts in text_chunks(b.column(0), b.column(1), CHUNK_BYTES):
                columns = zip(*measure(texts, max_covered, max_longest), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names)

    return id_and_text(df, id_col, text_col).mapInArrow(rows, SCHEMA)


def keep_documents(df: DataFrame, text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> DataFrame:
    """The rows of df, all columns, that the quality rules keep."""
    importable(df.sparkSession)
    at = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunks = text_chunks(b.column(at), as_bytes(b.column(at)), CHUNK_BYTES)
            yield b.filter(pa.array([x[6] for _, texts in chunks for x in measure(texts, max_covered, max_longest)], pa.bool_()))
        give_back()

    return df.mapInArrow(rows, df.schema)
