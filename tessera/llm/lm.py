"""Log-likelihoods of whole documents under a gated recurrent language model.

Tokens are lower-cased words and one end per document. Texts are read twice, to count words and to turn them into entries of the
vocabulary (2 bytes a token); training and scores read those. In steps:

1. Every training document's words are counted. Counts give the base model, a smoothed unigram
   over all word types, and the model's vocabulary: the VOCABULARY most frequent words; the others share one entry.
2. A gated recurrent unit with a class-factored softmax (classes of words near in frequency; p(class) then
   p(word | class)) is trained in numpy by truncated backpropagation through windows of WINDOW
   tokens. Training is spread out: documents are dealt into shards of about SHARD_TOKENS tokens; in each of
   ROUNDS rounds a task trains from the common weights on its share of the shard, and the weights are
   averaged by a grouped sum. One in CHECKED documents only serves to choose how far to go from the
   start to the trained weights (STRENGTHS), so too little data can't make the model worse than the unigram. Output biases
   start at the unigram, so the model starts as the base model and leaves it as it learns. There are MOST_SHARDS shards at
   most; a task streams through its shard in pieces of SHARD_TOKENS tokens, so its memory doesn't grow with the corpus.
3. Every document is scored whole: windows follow one another with the hidden state carried
   across, many documents side by side in lanes, each beginning from a zero state.

A word outside the vocabulary gets p(other | context) times its share among other words under the base model,
so the scores are log-probabilities over the same open vocabulary as the base scores. Counts of the
KNOWN most frequent words travel with the tasks (bounded); the rarer words of a document are joined to the
count table by a shuffle on the word, so no table that grows with the corpus is broadcast.

All training documents train the weights, each once, but for those CHECKED; counts, vocabulary
and base model are over all. See the README for what this costs.

Defined results: null or empty texts have the end token alone; null ids hash as the empty id; repeated rows
have equal results; an empty table gives an empty table; other columns are ignored; words over LONG bytes
are known by their digest. Memory follows CHUNK_BYTES or the longest text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, id_and_text, in_chunks, text_chunks, written

FOLDS, HELD_OUT = 5, 1
VOCABULARY = 1024
CLASSES = 32
KNOWN = 150_000
HIDDEN = 16
WINDOW = 32
LANES = 256
LANE_TOKENS = 6400  # of a lane at least, so that a small corpus gets as many updates as a piece of a large one
SHARD_TOKENS = 1_600_000
MOST_SHARDS = 4096  # beyond, a shard is read in pieces of SHARD_TOKENS
ROUNDS = 2
RATE = 0.02
WARM = 50  # steps over which a round's rate rises
CHECKED = 32  # one in so many of the training documents only checks
STRENGTHS = (0.0, 0.25, 0.5, 0.75, 1.0)
TOP = np.float32(60)  # of a logit, as float32 can hold its exponential
BLOCK = 2048  # tokens of a softmax at once, which a core's cache holds
LONG = 64
CHUNK_BYTES = 8_000_000
COUNTED_BYTES = 1_000_000
KEPT_COUNTS = 200_000
END = b" "  # no word holds a space
GAP = np.isin(np.arange(256), list(SPACES))
CHUNK_ENTRIES = 4_000_000  # scored side by side
READ = "row long, at long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, within double, entries binary, rare array<binary>, times array<int>"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in order, lower-cased, long ones by digest; the number of each text's."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    gap = GAP[data]
    turns = np.flatnonzero(np.diff(gap, prepend=True))  # a word's start and its end in turn, as a gap follows each text
    starts, sizes = turns[::2], turns[1::2] - turns[::2]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap])])
    long = sizes > LONG
    if long.any():
        digests = [b" " + hashlib.md5(w).hexdigest().encode() for w in words.filter(pa.array(long)).to_pylist()]
        words = pc.replace_with_mask(words, pa.array(long), pa.array(digests, pa.binary()))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def count_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) over all training documents, a written table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[pa.Table] = []

        def together() -> list[pa.RecordBatch]:
            t = pa.concat_tables(found).group_by("word", use_threads=False).aggregate([("n", "sum")])
            found[:] = [t.select(["word", "n_sum"]).rename_columns(["word", "n"])]
            return found[0].combine_chunks().to_batches()

        for b in batches:
            for ids, texts in text_chunks(b.column(0), b.column(1), COUNTED_BYTES):
                texts = [text for doc_id, text in zip(ids, texts, strict=True) if fold(doc_id) != HELD_OUT]
                each = split(texts)[0].value_counts()
                found.append(pa.table({"word": each.field(0), "n": each.field(1)}))
                found.append(pa.table({"word": pa.array([END] * bool(texts), pa.binary()), "n": pa.array([len(texts)] * bool(texts), pa.int64())}))
                if sum(map(len, found)) > KEPT_COUNTS:
                    out = together()
                    if len(found[0]) > KEPT_COUNTS // 2:
                        yield from out
                        found.clear()
        if found:
            yield from together()

    return written(id_and_text(df, id_col, text_col).mapInArrow(rows, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


class Table:
    """What of the counts travels with the tasks."""

    def __init__(self, words: list[bytes], counts: list[int], total: int, types: int) -> None:
        self.total, self.types = total, types
        self.words = pa.array(words, pa.binary())
        self.count = np.array(counts, np.float64)
        self.floor = total + 0.5 * (types + 1)
        self.base = np.append(np.log10((self.count + 0.5) / self.floor), 0.0)  # the last is for rare words, which are joined
        # entry 0 of the model's vocabulary is for all other words
        self.end = end = words.index(END) if END in words else None
        chosen = [k for k in range(min(VOCABULARY - 1, len(words)))]
        if end is not None and end not in chosen:
            chosen[-1] = end
        self.entry = np.zeros(len(words) + 1, np.int32)
        self.entry[chosen] = np.arange(1, len(chosen) + 1)
        p = np.zeros(VOCABULARY)
        p[1 : len(chosen) + 1] = (self.count[chosen] + 0.5) / self.floor
        p[0] = max(1e-12, 1.0 - p.sum())
        self.unigram = np.maximum(p, 1e-12)
        # log10 share of a word among the others, 0 for those in the vocabulary
        self.within = np.where(self.entry > 0, 0.0, self.base - np.log10(p[0]))
        self.within[-1] = 0.0
        self.other = float(np.log10(p[0]))

    def numbers(self, words: pa.Array, per: np.ndarray) -> np.ndarray:
        """Numbers of the tokens of all texts, an end after each text's words; rare words have the last."""
        rare = len(self.words)
        own = pc.fill_null(pc.index_in(words, value_set=self.words), rare).to_numpy()
        return np.insert(own, np.cumsum(per), rare if self.end is None else self.end)


def load_table(counts: DataFrame) -> Table:
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # a top-k would have every task send KNOWN rows: find the count from which on at most KNOWN words are left, by a histogram
    # of logarithms (under 4000 buckets), and fetch just those
    bucket = F.floor(F.log2("n") * 64)
    sizes = sorted(((r.b, r.v) for r in counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("v")).collect()), reverse=True)
    room, least = KNOWN, None
    for b, v in sizes:
        if v > room:
            break
        room, least = room - v, b
    top = counts.where(bucket >= (least if least is not None else 1 << 30)).select("word", "n").toArrow()
    words, found = top.column("word").to_pylist(), top.column("n").to_numpy()
    order = sorted(range(len(words)), key=lambda k: (-found[k], words[k]))
    return Table([words[k] for k in order], [int(found[k]) for k in order], whole.n, whole.v)


def by_gate(rows: np.ndarray) -> np.ndarray:
    """Rows for z, g and the candidate side by side as three tables, each without gaps: numpy is several times as fast on those."""
    return np.ascontiguousarray(rows.reshape(-1, 3, HIDDEN).transpose(1, 0, 2))


def unit(x: np.ndarray, h: np.ndarray, rec: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The state after h. x, of three tables, becomes z, g and the candidate; r becomes what the state gives to each."""
    np.matmul(h, rec, out=r)
    gates, c = x[:2], x[2]
    gates += r[:2]
    np.negative(gates, out=gates)
    if gates.max() > TOP:
        np.minimum(gates, TOP, out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    c += x[1] * r[2]
    np.tanh(c, out=c)
    new = c - h
    new *= x[0]
    new += h
    return new


class Model:
    """A GRU with a class-factored output. Arrays are float32."""

    NAMES = ("inp", "rec", "bias", "cls", "cls_b", "out", "out_b")

    def __init__(self, unigram: np.ndarray) -> None:
        rng = np.random.default_rng(11)
        h, v = HIDDEN, len(unigram)
        order = np.argsort(-unigram, kind="stable")
        self.size = -(-v // CLASSES)
        self.class_of, self.place = np.empty(v, np.int16), np.empty(v, np.int32)
        self.class_of[order], self.place[order] = np.arange(v) // self.size, np.arange(v) % self.size
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        self.inp, self.rec, self.bias = small(v + 1, 3 * h), small(h, 3 * h), np.zeros(3 * h, np.float32)
        self.bias[:h] = -1.0  # keep the state at first
        self.cls, self.out = np.zeros((h, CLASSES), np.float32), np.zeros((CLASSES, h, self.size), np.float32)
        mass = np.zeros((CLASSES, self.size))
        mass[self.class_of, self.place] = unigram
        whole = mass.sum(1)
        self.cls_b = np.log(np.maximum(whole, 1e-30)).astype(np.float32)
        self.out_b = np.where(mass > 0, np.log(np.maximum(mass, 1e-30) / np.maximum(whole, 1e-30)[:, None]), -30.0).astype(np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for n in self.NAMES:
            a = getattr(self, n)
            setattr(self, n, flat[at : at + a.size].reshape(a.shape).astype(np.float32))
            at += a.size
        return self

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step: x is rows of ``inp`` plus bias. Returns the new state and what backpropagation needs."""
        x, r = by_gate(x), np.empty((3, *h.shape), np.float32)
        return unit(x, h, by_gate(self.rec), r), *x, r[2]

    def log_probs(self, hs: np.ndarray, words: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of words after states hs; with grads, adds to it and returns d/d hs of their sum."""
        k = self.class_of[words]
        order = np.argsort(k, kind="stable")
        hs, k, place = hs[order], k[order], self.place[words[order]]
        cuts, rows = np.searchsorted(k, np.arange(CLASSES + 1)), np.arange(len(words))
        lp, back = np.zeros(len(words), np.float32), None if grads is None else np.zeros_like(hs)

        def softmax(lo: int, hi: int, weights: np.ndarray, bias: np.ndarray, said: np.ndarray, name: str, part: int | slice) -> None:
            """Adds log-probabilities of the entries said by tokens lo to hi, and d/d hs of their sum. A column for each token, as numpy is faster on long rows."""
            a = weights.T @ hs[lo:hi].T
            a += bias[:, None]
            if a.max() > TOP:
                np.minimum(a, TOP, out=a)
            at = said[lo:hi] * np.intp(hi - lo) + rows[: hi - lo]
            lp[lo:hi] += a.ravel()[at]
            e = np.exp(a, out=a)
            total = e.sum(0)
            lp[lo:hi] -= np.log(total)
            if back is None:
                return
            e *= np.reciprocal(np.negative(total, out=total), out=total)
            e.ravel()[at] += 1
            grads[name][part] += (e @ hs[lo:hi]).T
            grads[name + "_b"][part] += e.sum(1)
            back[lo:hi] += e.T @ weights.T

        for lo in range(0, len(words), BLOCK):
            softmax(lo, min(lo + BLOCK, len(words)), self.cls, self.cls_b, k, "cls", slice(None))
        for c in range(CLASSES):
            for lo in range(cuts[c], cuts[c + 1], BLOCK):
                softmax(lo, min(lo + BLOCK, cuts[c + 1]), self.out[c], self.out_b[c], place, "out", c)
        out, down = np.empty_like(lp), None
        out[order] = lp
        if back is not None:
            down = np.empty_like(back)
            down[order] = back
        return out, down


class Lanes:
    """Documents laid end to end in lanes: fed[t, lane], said[t, lane], and the document of each token."""

    def __init__(self, entries: np.ndarray, sizes: np.ndarray, lanes: int) -> None:
        order = np.argsort(-sizes, kind="stable")
        lanes = max(1, min(lanes, len(sizes)))
        load, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
        for d in order:
            k = int(load.argmin())
            dealt[k].append(d)
            load[k] += sizes[d]
        rank = np.argsort(-load, kind="stable")
        self.load = load[rank]
        steps, starts = int(load.max(initial=0)), np.cumsum(sizes) - sizes
        self.fed, self.said, self.doc = np.zeros((steps, lanes), np.int16), np.zeros((steps, lanes), np.int16), np.zeros((steps, lanes), np.int32)
        self.first = np.zeros((steps, lanes), bool)
        for k, lane in enumerate(rank):
            t = 0
            for d in sorted(dealt[lane]):
                n = int(sizes[d])
                own = entries[starts[d] : starts[d] + n]
                self.said[t : t + n, k], self.doc[t : t + n, k] = own, d
                self.fed[t, k], self.fed[t + 1 : t + n, k] = VOCABULARY, own[:-1]
                self.first[t, k] = True
                t += n

    def windows(self, width: int) -> Iterator[tuple[int, int, int]]:
        """(from, to, lanes in use) of successive windows; a window ends where a lane does."""
        ends = sorted({0, *self.load.tolist()})
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            n = int((self.load > lo).sum())
            for t in range(lo, hi, width):
                yield t, min(hi, t + width), n


class Adam:
    """Ascent with running means of gradients and their squares, both corrected for their start at zero; the rate rises over WARM steps."""

    def __init__(self, rate: float) -> None:
        self.rate, self.count = rate, 0
        self.first: dict[str, np.ndarray] = {}
        self.second: dict[str, np.ndarray] = {}

    def step(self, model: Model, grads: dict[str, np.ndarray], scale: float) -> None:
        self.count += 1
        rate = np.float32(self.rate * min(1.0, self.count / WARM) / (1 - 0.9**self.count))
        root = np.float32((1 - 0.99**self.count) ** -0.5)
        for k, g in grads.items():
            g *= np.float32(scale)
            m, v = self.first.setdefault(k, np.zeros_like(g)), self.second.setdefault(k, np.zeros_like(g))
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.01) * (g - v)
            getattr(model, k)[...] += rate * m / (np.sqrt(v) * root + np.float32(1e-6))


def train_shard(model: Model, entries: np.ndarray, sizes: np.ndarray, adam: Adam) -> Model:
    """One pass of truncated backpropagation over the documents."""
    lanes = Lanes(entries, sizes, min(LANES, max(1, len(entries) // LANE_TOKENS)))
    state = np.zeros((lanes.fed.shape[1], HIDDEN), np.float32)
    n = HIDDEN
    for lo, hi, width in lanes.windows(WINDOW):
        h, steps = state[:width], hi - lo
        ready, rec, down = by_gate(model.inp + model.bias), by_gate(model.rec), np.ascontiguousarray(model.rec.reshape(n, 3, n).transpose(1, 2, 0))
        before, hs, dc = (np.empty((steps, width, n), np.float32) for _ in range(3))
        gates, r, dr = (np.empty((steps, 3, width, n), np.float32) for _ in range(3))
        new = [np.flatnonzero(x) for x in lanes.first[lo:hi, :width]]
        fed = lanes.fed[lo:hi, :width].astype(np.intp)
        for t in range(steps):
            before[t] = h
            before[t, new[t]] = 0
            h = hs[t] = unit(np.take(ready, fed[t], 1, out=gates[t], mode="clip"), before[t], rec, r[t])
        state[:width] = h
        grads = {k: np.zeros_like(getattr(model, k)) for k in Model.NAMES}
        _, back = model.log_probs(hs.reshape(-1, n), lanes.said[lo:hi, :width].ravel(), grads)
        back, carry = back.reshape(steps, width, n), np.zeros((width, n), np.float32)
        for t in range(steps - 1, -1, -1):
            (z, g, c), d, (to_z, to_g, to_r) = gates[t], back[t], dr[t]
            d += carry
            stay = 1 - z
            np.subtract(c, before[t], out=to_z)
            to_z *= z
            to_z *= stay
            to_z *= d
            np.multiply(c, c, out=dc[t])
            np.subtract(1, dc[t], out=dc[t])
            dc[t] *= z
            dc[t] *= d
            np.multiply(dc[t], g, out=to_r)
            np.subtract(1, g, out=to_g)
            to_g *= r[t, 2]
            to_g *= to_r
            stay *= d
            for x in np.matmul(dr[t], down):
                stay += x
            stay[new[t]] = 0
            carry = stay
        by = before.reshape(-1, n).T
        for k in range(3):
            grads["rec"][:, k * n : (k + 1) * n] = by @ dr[:, k].reshape(-1, n)
        # of the input: sums of the tokens of an entry, which are brought side by side
        order = np.argsort(lanes.fed[lo:hi, :width].ravel(), kind="stable")
        some, cut = np.unique(fed.ravel()[order], return_index=True)
        for k, x in enumerate((dr[:, 0], dr[:, 1], dc)):
            part = np.ascontiguousarray(x.reshape(-1, n)[order].T)
            grads["inp"][some, k * n : (k + 1) * n] = np.add.reduceat(part, cut, 1).T
        grads["bias"] += grads["inp"].sum(0)
        adam.step(model, grads, 1.0 / ((hi - lo) * width))
    return model


def pieces(batches: Iterator[pa.RecordBatch], wanted: Callable[[int], bool]) -> Iterator[list[bytes]]:
    """Entries of the wanted rows, in order, SHARD_TOKENS at a time; a longer document stands with what came before it."""
    texts, size = [], 0
    for b in batches:
        for at, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if wanted(at):
                texts.append(x)
                size += len(x) // 2
                if size >= SHARD_TOKENS:
                    yield texts
                    texts, size = [], 0
    if texts:
        yield texts


def train(read: DataFrame, table: Table) -> np.ndarray:
    """Weights after ROUNDS of training on shards and averaging."""
    spark = read.sparkSession
    flat = Model(table.unigram).flat()
    shards = min(MOST_SHARDS, max(1, round(table.total / SHARD_TOKENS)))
    docs = written(read.where("NOT held_out").select("at", "entries").repartition(shards, "at").sortWithinPartitions("at", "entries"), "shards")
    for r in range(ROUNDS):
        weights, rate, unigram = spark.sparkContext.broadcast(flat), RATE / (1 + r), table.unigram

        def trained(batches: Iterator[pa.RecordBatch], weights=weights, rate=rate, unigram=unigram, r=r) -> Iterator[pa.RecordBatch]:
            model, adam, n = Model(unigram).load(weights.value), Adam(rate), 0
            for texts in pieces(batches, lambda at: at % CHECKED and at // CHECKED % ROUNDS == r):
                rng = np.random.default_rng(len(texts))
                texts = [texts[k] for k in rng.permutation(len(texts))]
                entries = np.frombuffer(b"".join(texts), "<u2").astype(np.int32)
                train_shard(model, entries, np.array([len(x) // 2 for x in texts], np.int64), adam)
                n += len(entries)
            if not n:
                return
            new = model.flat()
            # whole numbers, so that the sum doesn't depend on the order of the tasks
            fixed = np.rint(np.clip(new.astype(np.float64), -1e3, 1e3) * (1 << 20)).astype(np.int64)
            for k in range(0, len(fixed), 4096):
                part = fixed[k : k + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part))), pa.array(part * n), pa.array(np.full(len(part), n))], ["at", "v", "n"])

        sums = docs.mapInArrow(trained, "at long, v long, n long").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"), F.sum("n").alias("n"))
        mean = sums.select("at", (F.col("v") / F.col("n")).cast("double").alias("v")).toArrow()
        flat[mean.column("at").to_numpy()] = mean.column("v").to_numpy() / (1 << 20)
    start, weights, unigram = Model(table.unigram).flat(), spark.sparkContext.broadcast(flat), table.unigram

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in pieces(batches, lambda at: True):
            entries, sizes = np.frombuffer(b"".join(texts), "<u2").astype(np.int32), np.array([len(x) // 2 for x in texts], np.int64)
            for s in STRENGTHS:
                model = Model(unigram).load(start + np.float32(s) * (weights.value - start))
                yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([int(model_scores(model, entries, sizes).sum() * 1024)])], ["s", "v"])

    # brought together, as few documents side by side cost as many steps as many
    few = docs.where(F.col("at") % CHECKED == 0).repartition(-(-shards // CHECKED), "at").sortWithinPartitions("at", "entries")
    found = few.mapInArrow(checked, "s double, v long").groupBy("s").agg(F.sum("v").alias("v")).collect()
    best = max(found, key=lambda x: (x.v, -x.s)).s if found else 0.0
    return start + np.float32(best) * (flat - start)


def read_texts(df: DataFrame, table: Table, id_col: str, text_col: str) -> DataFrame:
    """Rows of READ, a written table: entries of all texts, sums without the rare words, and those. Texts are split here once for training and scores."""
    shared = df.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t, row = shared.value, TaskContext.get().partitionId() << 33
        for b in batches:
            for ids, texts in text_chunks(b.column(0), b.column(1), CHUNK_BYTES):
                n, rare = len(ids), len(t.words)
                words, per = split(texts)
                del texts
                numbers, sizes = t.numbers(words, per), per + 1
                ends = np.cumsum(sizes)
                owner, entries = np.repeat(np.arange(n, dtype=np.int32), sizes), t.entry[numbers].astype("<u2").tobytes()
                entries = [entries[2 * (e - k) : 2 * e] for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                at = [zlib.crc32(f, zlib.crc32(str(d).encode())) for d, f in zip(ids, entries, strict=True)]
                # an end is rare where no document trains
                missed = np.flatnonzero(numbers == rare)
                last = missed == ends[owner[missed]] - 1
                few = np.empty(len(missed), object)
                few[last], few[~last] = END, words.take(pa.array((missed - owner[missed])[~last])).to_pylist()
                cuts = np.searchsorted(missed, [0, *ends]).tolist()
                seldom = [Counter(few[lo:hi].tolist()) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
                per = lambda x, owner=owner, n=n: np.bincount(owner, x, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(row, row + n)), pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array([fold(d) == HELD_OUT for d in ids]), pa.array(sizes), pa.array(per(numbers != rare).astype(np.int64)),
                        pa.array(per(t.base[numbers])), pa.array(per(t.within[numbers])), pa.array(entries, pa.binary()), pa.array([list(c) for c in seldom], pa.list_(pa.binary())), pa.array([list(c.values()) for c in seldom], pa.list_(pa.int32())),
                    ],
                    [x.split()[0] for x in READ.split(", ")],
                )
                row += n

    return written(id_and_text(df, id_col, text_col).mapInArrow(rows, READ), "read")


def score(read: DataFrame, table: Table, flat: np.ndarray) -> DataFrame:
    """Rows of SCORED: sums without the rare words."""
    shared, unigram = read.sparkSession.sparkContext.broadcast(flat), table.unigram

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(unigram).load(shared.value)
        for b in batches:
            for lo, hi in in_chunks(b.column("n_tokens").to_pylist(), CHUNK_ENTRIES):
                part = b.slice(lo, hi - lo)
                entries = np.frombuffer(b"".join(part.column("entries").to_pylist()), "<u2").astype(np.int32)
                total = part.column("within").to_numpy() + model_scores(model, entries, part.column("n_tokens").to_numpy()) / np.log(10)
                yield pa.RecordBatch.from_arrays([*(part.column(x.split()[0]) for x in SCORED.split(", ")[:-1]), pa.array(total)], [x.split()[0] for x in SCORED.split(", ")])

    return read.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "within", "entries").mapInArrow(rows, SCORED)


def model_scores(model: Model, entries: np.ndarray, sizes: np.ndarray, lanes: int = 256) -> np.ndarray:
    """Natural log-probability of each document's entries, states carried across windows."""
    laid = Lanes(entries, sizes, min(lanes, max(8, int(sizes.sum()) // max(1, int(sizes.max(initial=1))))))
    state, out = np.zeros((laid.fed.shape[1], HIDDEN), np.float32), np.zeros(len(sizes))
    ready, rec = by_gate(model.inp + model.bias), by_gate(model.rec)
    for lo, hi, width in laid.windows(WINDOW):
        h, hs = state[:width], np.empty((hi - lo, width, HIDDEN), np.float32)
        x, r = np.empty((3, width, HIDDEN), np.float32), np.empty((3, width, HIDDEN), np.float32)
        for t, fed in enumerate(laid.fed[lo:hi, :width].astype(np.intp), lo):
            h[np.flatnonzero(laid.first[t, :width])] = 0
            h = hs[t - lo] = unit(np.take(ready, fed, 1, out=x, mode="clip"), h, rec, r)
        state[:width] = h
        lp, _ = model.log_probs(hs.reshape(-1, HIDDEN), laid.said[lo:hi, :width].ravel())
        out += np.bincount(laid.doc[lo:hi, :width].ravel(), lp.astype(np.float64), len(sizes))
    return out


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of df."""
    counts = count_words(df, id_col, text_col)
    table = load_table(counts)
    read = read_texts(df, table, id_col, text_col)
    scored = score(read, table, train(read, table))
    words = read.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = words.join(counts, "word", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    log = F.log10((F.col("c") + 0.5) / F.lit(table.floor))
    rest = met.groupBy("row").agg(F.sum(F.col("times") * log).alias("more"), F.sum("times").alias("words"), F.sum(F.when(F.col("c") > 0, F.col("times"))).alias("known"))
    out = scored.join(rest, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(table.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + more).alias("base_score"), (F.col("score") + more - F.coalesce("words", F.lit(0)) * table.other).alias("score"),
    )
