"""Token ids in a static range-asymmetric-numeral-system (rANS) file format.

A first pass tokenises all documents, counts every id, deals the documents out by ascending doc id and stages
their ids, deflated. The counts become one frequency table that all blocks share (every id of the
vocabulary gets at least 1 of 2**20, so that any id can be written). A second pass encodes the staged
documents where they lie and writes blocks; the stage is then deleted.

A block holds whole documents, about BLOCK tokens of them, and stands alone: it can be decoded by anyone
who has the table. Its tokens are cut into segments of SEGMENT; a checkpoint for each
segment (its place in the payload and its LANES final states) lets segments be decoded side by side.
A CRC-32 covers checkpoints and payload. Within a segment token t belongs to lane t mod LANES,
and the lanes' words are interleaved in the order in which the decoder asks for them.

Layout below a path: ``table`` (id, freq), ``blocks`` (part: ascending ranges of ids, start: tokens of the part before it, n_docs,
doc_ids, lengths, n_tokens, words: payload words before each segment, states, payload, crc32).
Both are Parquet, so any store that Spark reads and writes serves, and a lost task's output is
rewritten whole by Spark's commit protocol.

Tokenising: white space is dropped by the tokenizer and no token crosses it, so distinct words
are encoded once and those that recur are kept (beyond WORDS_KEPT the others are forgotten). Words of
letters alone skip the normaliser and the splitting pattern, which leave them as they are. ``encode_batch`` on whole texts gives the same ids;
texts with "<|" are encoded whole, as added tokens are matched before the lower-casing used here.

Defined results: null or empty texts have the end id alone; null doc ids come first; repeated rows and
ids are all written, equal ids by their tokens; an empty table gives a table of ones, no blocks, and no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, compress, count, islice
from operator import not_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, give_back, id_and_text, importable, in_chunks, text_chunks, written

SCALE = 20
LOW = 1 << 31
LANES = 32
SEGMENT = 8192
BLOCK = 65536
END_ID = 1
CHUNK_BYTES = 4_000_000
CHUNK_TOKENS = 2_000_000
WORDS_KEPT = 650_000

BLOCKS = "part int, start long, n_docs int, doc_ids binary, lengths binary, n_tokens long, words binary, states binary, payload binary, crc32 long"
DECODED = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"


class Words:
    """Token ids of words, kept in a process from one task to the next."""

    _of: dict[str, Words] = {}

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            told = json.load(f)
        suffix = told["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.size = max(vocab.values()) + 1
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for s, i in vocab.items() if s.endswith(suffix)]] = True
        # a word of letters is one piece and ends with the one token that has the suffix; only where
        # pieces are runs of letters and text is lower-cased can words be shared as below
        self.by_word = bool(suffix) and "Lowercase" in json.dumps(told["normalizer"]) and "[\\p{L}]+" in json.dumps(told["pre_tokenizer"]).replace("\\\\", "\\")
        simple = told | {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
        self.letters = Tokenizer.from_str(json.dumps(simple)) if self.by_word else self.tokenizer
        self.clear()

    @classmethod
    def at(cls, path: str, kept: int = WORDS_KEPT) -> Words:
        if path not in cls._of:
            cls._of[path] = cls(path)
        cls._of[path].kept = kept
        return cls._of[path]

    kept = WORDS_KEPT

    def clear(self) -> None:
        self.index: dict[bytes, int] = defaultdict(count().__next__)
        self.flat, self.start, self.count, self.used = np.empty(1 << 16, np.uint32), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32), 0
        self.seen = np.zeros(1 << 14, np.int64)

    def forget(self) -> None:
        """Keep only words that were asked for again and again."""
        words = list(self.index)
        keep = np.flatnonzero(self.seen[: len(words)] >= 3)
        counts, starts = self.count[keep].astype(np.int64), self.start[keep]
        ids = self.flat[np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        self.clear()
        if len(keep) < self.kept // 2:
            self._put(self._at([words[k] for k in keep]), ids, counts)

    def _put(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Ids of the words of numbers ``at``, counts[k] of them for the k-th."""
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.index) > len(self.start):
            self.start, self.count = np.concatenate([self.start, np.empty_like(self.start)]), np.concatenate([self.count, np.empty_like(self.count)])
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[at] = self.used + np.cumsum(counts) - counts
        self.count[at] = counts
        self.used += len(ids)

    def _at(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes], last: int) -> None:
        """Tokenise new words, the newest first, whose numbers go down from ``last``."""
        letters = list(map(bytes.isalpha, new))
        plain = list(compress(new, letters))
        at = last - np.flatnonzero(letters)
        others = list(compress(new, map(not_, letters)))
        marked, stems, rest, more = [], set(), [], []
        for w in others:
            # lower-case letters below U+0250 are one piece, and what the normaliser makes of them is themselves
            s = w.decode("utf-8", "replace")
            mark = s[-1] in ".,"
            t = s[:-1] if mark else s
            if not (t.isalpha() and t.islower() and max(t) < "ɐ"):
                rest.append(w)
            elif mark:
                marked.append(w)
                stems.add(w[:-1])
            else:
                more.append(w)
        more += [w for w in stems if w not in self.index]
        plain, at = plain + more, np.concatenate([at, self._at(more)])
        late = []
        for k in range(0, len(plain), 1 << 13):
            part, own = plain[k : k + (1 << 13)], at[k : k + (1 << 13)]
            joined = [b" ".join(part[i : i + 128]).decode() for i in range(0, len(part), 128)]
            got = self.letters.encode_batch_fast(joined, add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(e.ids for e in got), np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self._put(own, ids, np.diff(cuts, prepend=0))
            else:  # a word was more than one piece after all
                late += part
        self._put_each(late)
        if marked:
            one = {c: self._direct([chr(c)])[0] for c in b".,"}
            ids, counts = [], []
            for k, w in zip(self._at([w[:-1] for w in marked]).tolist(), marked, strict=True):
                ids += self.flat[self.start[k] : self.start[k] + self.count[k]].tolist() + one[w[-1]]
                counts.append(int(self.count[k]) + len(one[w[-1]]))
            self._put(self._at(marked), np.array(ids, np.uint32), np.array(counts, np.int64))
        self._put_each(rest)

    def _put_each(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 1 << 12):
            part = words[k : k + (1 << 12)]
            got = self._direct([w.decode("utf-8", "replace") for w in part])
            self._put(self._at(part), np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)))

    def _numbers(self, texts: list[bytes]) -> tuple[np.ndarray, list[int], dict[int, list[int]]]:
        """Word numbers of all texts, how many each has, and the ids of those encoded whole."""
        if len(self.index) > self.kept:
            self.forget()
        whole = {k: None for k, t in enumerate(texts) if not self.by_word or b"<|" in t}
        if whole:
            whole = dict(zip(whole, self._direct([texts[k].decode("utf-8", "replace") for k in whole]), strict=True))
        split = [() if k in whole else t.lower().split() for k, t in enumerate(texts)]
        sizes, known = list(map(len, split)), len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sum(sizes))
        if len(self.index) > known:
            self._learn(list(islice(reversed(self.index), len(self.index) - known)), len(self.index) - 1)
        times = np.bincount(numbers)
        self.seen[: len(times)] += times
        return numbers, sizes, whole

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, END_ID after each, and how many each has."""
        numbers, words, whole = self._numbers(texts)
        counts = self.count[numbers].astype(np.int64)
        ids = self.flat[np.repeat(self.start[numbers] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        upto = np.append(0, np.cumsum(counts))
        ends = upto[np.cumsum(words, dtype=np.int64)]
        if whole:
            parts, last = [], 0
            for k, end in enumerate(ends.tolist()):
                parts += [np.array(whole[k], np.uint32) if k in whole else ids[last:end], np.array([END_ID], np.uint32)]
                last = end
            sizes = np.array([len(parts[2 * k]) + 1 for k in range(len(texts))], np.int64)
            return np.concatenate(parts), sizes
        sizes = np.diff(ends, prepend=0) + 1
        return np.insert(ids, ends, np.uint32(END_ID)), sizes


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Frequencies of sum 2**scale, each at least 1, near the counts' shares."""
    total, room = int(counts.sum()), (1 << scale) - len(counts)
    if room < 0:
        raise ValueError("the vocabulary is larger than the frequency table")
    freq = 1 + (counts.astype(object) * room // max(1, total)).astype(np.int64)
    freq[int(counts.argmax())] += (1 << scale) - int(freq.sum())
    return freq


def squeeze(ids: np.ndarray, lengths: np.ndarray, freq: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, list[np.ndarray]]:
    """States [segment, lane] and payload words of each segment. ids: [segment, SEGMENT], padded."""
    s, steps = len(ids), ids.shape[1] // LANES
    f64 = freq.astype(np.uint64)
    cum = (np.cumsum(f64) - f64).astype(np.uint64)
    grid = ids.reshape(s, steps, LANES)
    x = np.full((s, LANES), LOW, np.uint64)
    low, out = np.empty((s, steps, LANES), np.uint32), np.zeros((s, steps, LANES), bool)
    lane, shift, up, word = np.arange(LANES), np.uint64(63 - scale), np.uint64(scale), np.uint64(32)
    shortest = int(lengths.min(initial=ids.shape[1]))
    for t in range(steps - 1, -1, -1):
        sym = grid[:, t]
        f = f64[sym]
        full = x >= f << shift
        if every := (t + 1) * LANES <= shortest:
            valid = None
        else:
            valid = t * LANES + lane < lengths[:, None]
            full &= valid
        low[:, t], out[:, t] = x.astype(np.uint32), full
        y = np.where(full, x >> word, x)
        q = y // f
        y -= q * f
        q <<= up
        q += y
        q += cum[sym]
        x = q if every else np.where(valid, q, x)
    return x, [a[b] for a, b in zip(low, out, strict=True)]


def unsqueeze(states: np.ndarray, payload: np.ndarray, at: np.ndarray, lengths: np.ndarray, freq: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """ids [segment, SEGMENT] of the segments whose words begin at ``at`` in payload."""
    f64 = freq.astype(np.uint64)
    cum = (np.cumsum(f64) - f64).astype(np.uint64)
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
    x, at = states.copy(), at.astype(np.int64).copy()
    payload = np.append(payload, np.uint32(0))
    steps, shortest = -(-int(lengths.max(initial=0)) // LANES), int(lengths.min(initial=SEGMENT))
    ids = np.zeros((len(x), SEGMENT // LANES, LANES), np.uint32)
    lane, mask, up, word, floor = np.arange(LANES), np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32), np.uint64(LOW)
    for t in range(steps):
        slot = x & mask
        sym = symbol[slot]
        y = f64[sym]
        y *= x >> up
        y += slot
        y -= cum[sym]
        need = y < floor
        if (t + 1) * LANES <= shortest:
            ids[:, t], x = sym, y
        else:
            valid = t * LANES + lane < lengths[:, None]
            ids[:, t], x = np.where(valid, sym, 0), np.where(valid, y, x)
            need &= valid
        place = at[:, None] + np.cumsum(need, 1) - 1
        x = np.where(need, (x << word) | payload[np.where(need, place, len(payload) - 1)], x)
        at += need.sum(1)
    return ids.reshape(len(x), SEGMENT)


def by_fullness(ids: np.ndarray, lengths: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``squeeze`` of the whole segments, then of the others, so that the first need no masks."""
    states, words = np.empty((len(ids), LANES), np.uint64), [None] * len(ids)
    for own in (np.flatnonzero(lengths == SEGMENT), np.flatnonzero(lengths < SEGMENT)):
        if len(own):
            found, parts = squeeze(ids[own], lengths[own], freq)
            states[own] = found
            for k, w in zip(own.tolist(), parts, strict=True):
                words[k] = w
    return states, words


def encode_blocks(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray, freq: np.ndarray) -> list[tuple]:
    """Rows of BLOCKS from n_docs on, without start: whole documents, BLOCK tokens or a little more each."""
    ends = np.cumsum(sizes)
    cuts, last = [], 0
    for k, e in enumerate(ends.tolist()):
        if e - last >= BLOCK or k == len(ends) - 1:
            cuts.append((k + 1, last, e))
            last = e
    pads, lengths, spans = [], [], []
    for _, lo, hi in cuts:
        n = -(-(hi - lo) // SEGMENT)
        pad = np.zeros(n * SEGMENT, ids.dtype)
        pad[: hi - lo] = ids[lo:hi]
        pads.append(pad.reshape(n, SEGMENT))
        lengths += [SEGMENT] * (n - 1) + [hi - lo - (n - 1) * SEGMENT]
        spans.append(n)
    if not cuts:
        return []
    states, words = by_fullness(np.concatenate(pads), np.array(lengths), freq)
    rows, first, doc = [], 0, 0
    for (end_doc, lo, hi), n in zip(cuts, spans, strict=True):
        own = words[first : first + n]
        before = np.cumsum([0, *map(len, own)])[:-1].astype("<u4").tobytes()
        payload = np.concatenate(own).astype("<u4").tobytes()
        state = states[first : first + n].astype("<u8").tobytes()
        names = json.dumps(doc_ids[doc:end_doc]).encode()
        rows.append((end_doc - doc, zlib.compress(names), zlib.compress(sizes[doc:end_doc].astype("<u8").tobytes()), hi - lo, before, state, payload, zlib.crc32(payload, zlib.crc32(state, zlib.crc32(before)))))
        first, doc = first + n, end_doc
    return rows


def decode_blocks(rows: list[dict], freq: np.ndarray) -> Iterator[tuple[dict, list[int | None], np.ndarray, np.ndarray]]:
    """(row, doc ids, lengths, token ids) of each block row; ValueError where a checksum fails."""
    states, payload, at, lengths, base, spans = [], [], [], [], 0, []
    for r in rows:
        if zlib.crc32(r["payload"], zlib.crc32(r["states"], zlib.crc32(r["words"]))) != r["crc32"]:
            raise ValueError(f"block {r['part']}/{r['start']}: its checksum doesn't match")
        own = np.frombuffer(r["payload"], "<u4")
        n = -(-r["n_tokens"] // SEGMENT)
        states.append(np.frombuffer(r["states"], "<u8").reshape(n, LANES))
        payload.append(own)
        at.append(base + np.frombuffer(r["words"], "<u4").astype(np.int64))
        lengths += [SEGMENT] * (n - 1) + [r["n_tokens"] - (n - 1) * SEGMENT]
        base += len(own)
        spans.append(n)
    if not rows:
        return
    states, payload, at, lengths = np.concatenate(states), np.concatenate(payload), np.concatenate(at), np.array(lengths)
    ids = np.empty((len(states), SEGMENT), np.uint32)
    for own in (np.flatnonzero(lengths == SEGMENT), np.flatnonzero(lengths < SEGMENT)):
        if len(own):
            ids[own] = unsqueeze(states[own], payload, at[own], lengths[own], freq)
    first = 0
    for r, n in zip(rows, spans, strict=True):
        names = json.loads(zlib.decompress(r["doc_ids"]))
        yield r, names, np.frombuffer(zlib.decompress(r["lengths"]), "<u8").astype(np.int64), ids[first : first + n].reshape(-1)[: r["n_tokens"]]
        first += n


def packed(ids: np.ndarray, width: int) -> bytes:
    """Ids, low bytes before high ones, deflated; width: bytes an id needs."""
    planes = (ids.astype("<u2") if width <= 2 else ids.astype("<u4")).view(np.uint8).reshape(-1, 2 if width <= 2 else 4).T
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes[:width].tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    planes = raw[1:].reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u4")[:, 0]


STAGED = "part int, place long, doc_id long, n long, ids binary, totals binary"
PLACED = STAGED + ", start long"


def arrow_schema(text: str) -> pa.Schema:
    return pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in text.split(", "))])


def stage(df: DataFrame, tokenizer: str, id_col: str, text_col: str, kept: int, chunk: int, place: Column | None) -> DataFrame:
    """A written table of PLACED: each part's documents in order of place (of id, where none is given), with the ids of those before them in the part.

    Parts are ranges of places between quantiles. A task adds a row with how often each id occurs in its texts.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = (F.col(id_col) if place is None else place).cast("long")
    texts = id_and_text(df.withColumn("__place", place).select("__place", F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text", "__place")
    known = df.select(place.cast("double").alias("d")).where("d IS NOT NULL")
    bounds = np.unique(known.approxQuantile("d", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else [])

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = Words.at(tokenizer, kept)
        total, width, schema = np.zeros(words.size, np.int64), max(1, (words.size - 1).bit_length() + 7 >> 3), arrow_schema(STAGED)
        for b in batches:
            at = 0
            for names, texts in text_chunks(b.column(0), b.column(1), chunk):
                places = b.column(2).slice(at, len(names))
                at += len(names)
                where = np.searchsorted(bounds, [-np.inf if x is None else x for x in places.to_pylist()], side="right")
                ids, sizes = words.encode(texts)
                total += np.bincount(ids, minlength=words.size)
                ends = np.cumsum(sizes)
                found = [packed(ids[e - n : e], width) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), places, pa.array(names, pa.int64()), pa.array(sizes), pa.array(found, pa.binary()), pa.nulls(len(names), pa.binary())], schema=schema)
        words.forget()  # between tasks only words that recur stay in memory
        give_back()
        own = TaskContext.get().partitionId() % (len(bounds) + 1)
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([0]), pa.nulls(1, pa.binary()), pa.array([packed(total.view("<u4"), 4)], pa.binary())], schema=schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = -1, 0
        for b in batches:
            starts = []
            for p, n in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if p != part:
                    part, at = p, 0
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts, pa.int64())], schema=arrow_schema(PLACED))

    # rows of one place and id are told apart by their ids, so that reruns agree
    order = F.col("place").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "n", F.xxhash64("ids")
    dealt = texts.mapInArrow(tokenised, STAGED).repartitionById(parts, F.col("part")).sortWithinPartitions("part", *order)
    # the shuffle's files go when the table is written, not when the driver next collects its garbage
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        return written(dealt.mapInArrow(placed, PLACED), "ids")
    finally:
        spark.conf.set(key, before)


def count_ids(staged: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: one number for each id of the vocabulary, summed where the tasks' counts lie."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.ascontiguousarray(unpacked(x)).view(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], ["id", "n"])

    counted = staged.where("totals IS NOT NULL").select("totals").mapInArrow(rows, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for r in counted.toLocalIterator():
        out[r.id] = r.n
    return out


def write(df: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", kept: int = WORDS_KEPT, chunk: int = CHUNK_BYTES, place: Column | None = None) -> None:
    """Encode every text of df and write table and blocks below path, in ascending order of id, or of ``place`` (a long) where one is given.

    kept (words remembered) and chunk (bytes of text at once) trade a worker's memory, about 220 bytes a word
    and 40 bytes a byte, for time; the files are the same.
    """
    spark = df.sparkSession
    staged = stage(df, tokenizer, id_col, text_col, kept, chunk, place)
    freq = frequencies(count_ids(staged, Words.at(tokenizer).size))
    spark.createDataFrame([(k, int(f)) for k, f in enumerate(freq)], "id int, freq int").coalesce(1).write.parquet(f"{path}/table")
    shared = spark.sparkContext.broadcast(freq)
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, ids, sizes, blobs_, starts = (b.column(k).to_pylist() for k in range(5))
            # runs of documents that follow one another in a part
            cuts = [0, *[k for k in range(1, len(ids)) if parts[k] != parts[k - 1] or starts[k] != starts[k - 1] + sizes[k - 1]], len(ids)]
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                for lo, hi in in_chunks(sizes[first:last], CHUNK_TOKENS):
                    lo, hi = first + lo, first + hi
                    tokens, found, start = np.concatenate([unpacked(x) for x in blobs_[lo:hi]]), [], starts[lo]
                    for n_docs, *rest in encode_blocks(ids[lo:hi], tokens, np.array(sizes[lo:hi], np.int64), shared.value):
                        found.append((parts[lo], start, n_docs, *rest))
                        start += rest[2]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in found], arrow_schema(BLOCKS))
        give_back()

    staged.where("ids IS NOT NULL").select("part", "doc_id", "n", "ids", "start").mapInArrow(rows, BLOCKS).write.parquet(f"{path}/blocks")
    drop_written(staged)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks below path: (doc_id, start, n_tokens, ids_crc32) for each document."""
    importable(spark)
    freq = np.array([r.freq for r in spark.read.parquet(f"{path}/table").orderBy("id").toLocalIterator()], np.int64)
    shared = spark.sparkContext.broadcast(freq)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 32):
                ids, starts, counts, sums, parts = [], [], [], [], []
                for r, names, lengths, tokens in decode_blocks(b.slice(k, 32).to_pylist(), shared.value):
                    ends = np.cumsum(lengths)
                    raw = memoryview(tokens.astype("<u4").tobytes())
                    ids += names
                    starts.append(r["start"] + ends - lengths)
                    counts.append(lengths)
                    sums += [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                    parts += [r["part"]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(counts)), pa.array(sums, pa.int64())], [x.split()[0] for x in DECODED.split(", ")])
        give_back()

    # one row a part of the file, so the window and the broadcast are as small as the list of files
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    base = parts.select("part", before.alias("base"))
    return blocks.mapInArrow(rows, DECODED).join(F.broadcast(base), "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
