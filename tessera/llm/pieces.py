"""SentencePiece BPE: texts to ids and back, by vectorised merge rounds.

A model's pieces become tables: characters to symbols, pairs of symbols to the piece they make, pieces to ranks (equal scores share a rank).
The symbols of many distinct words lie in one flat array. Each round finds the least rank among the pairs of every word (a segmented
minimum), merges the leftmost pair of that rank in all words at once, closes the gaps, looks up only the pairs beside a merge, and
drops the words in which no pair is left. Words end where no piece crosses: before a space sign that follows another character, and
between any two characters that stand side by side in no piece. Merges on both sides of such a place never meet, so the rounds give
what one queue over the whole text gives. A text is a unit of its own and nothing is shuffled; a task encodes each distinct
word once and forgets words beyond WORDS_KEPT.

An unbroken word of over LONGEST symbols would need as many rounds; its merges are taken from a heap, in the same order.

Models: BPE with byte fallback, a leading space sign and an identity normaliser, without pieces that the user defined or left unused (ValueError
otherwise). The driver reads the model's file; tasks get the tables.

Defined results: a null or empty text has no ids and decodes to an empty text; a null array of ids decodes to an empty text, and so does a null id within one; an id out of range is an
error; bytes that aren't UTF-8 count as U+FFFD each; repeated rows have equal results, null ids are kept; an empty table gives an empty table;
columns other than id and text (``encode``) or id and ids (``decode``) are dropped, whatever their names.
"""

from __future__ import annotations

import codecs
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tessera.llm.common import give_back, id_and_text, importable, text_chunks

SPACE = "▁"
CHUNK_BYTES = 2_000_000
CHUNK_IDS = 1_000_000
WORDS_KEPT = 500_000
LONGEST = 4096
NONE = np.iinfo(np.int32).max
APART = -2
POINTS = 0x110000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


@dataclass
class Pieces:
    """The tables of a model. Symbols are ids of pieces, then the characters that occur in pieces but are none; -1 is any other character.

    ``number`` numbers the characters of pieces of two or more (0: any other), ``meet`` has for two such numbers the piece that they make, -1
    where they only stand side by side in longer pieces, APART where they do in none.
    """

    char_symbols: np.ndarray
    number: np.ndarray
    meet: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    ranks: np.ndarray
    byte_ids: np.ndarray
    spelled: list[bytes | None]
    spaced: np.ndarray
    words: re.Pattern
    lines: bool
    kept: dict[str, bytes] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"kept": {}}

    @staticmethod
    def read(path: str) -> Pieces:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, model.SentencePiece
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback and leading space signs are known")
        if norm.precompiled_charsmap or not norm.add_dummy_prefix or norm.remove_extra_whitespaces or model.denormalizer_spec.precompiled_charsmap:
            raise ValueError("only models with an identity normaliser and a leading space sign are known")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("pieces that the user defined or left unused are not known")
        normal = {p.piece: k for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        size = len(model.pieces)
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            symbol.setdefault(c, size + len(symbol) - len(normal))
        # dense ranks: the highest score first
        order = np.unique([-model.pieces[k].score for k in normal.values()])
        splits = sorted((symbol[p[:i]] << 32 | symbol[p[i:]], k) for p, k in normal.items() for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol)
        ranks = np.full(size, NONE, np.int32)
        for k in normal.values():
            ranks[k] = np.searchsorted(order, -model.pieces[k].score)
        char_symbols, number = np.full(POINTS, -1, np.int32), np.zeros(POINTS, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                char_symbols[ord(c)] = k
        joined = sorted({ord(c) for p in normal if len(p) > 1 for c in p})
        number[joined] = np.arange(1, len(joined) + 1)
        meet = np.full((len(joined) + 1, len(joined) + 1), APART, np.int32)
        for p in normal:
            for a, b in zip(p, p[1:], strict=False):
                meet[number[ord(a)], number[ord(b)]] = normal.get(a + b, -1)
        crossed = any(SPACE in p.lstrip(SPACE) for p in normal)
        # no piece holds a line's end in most models; lines are then cut apart before words are looked up
        stop = "" if any("\n" in p for p in normal) else "\n"
        words = re.compile("(?s).+" if crossed else f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|{stop}+" if stop else ""))
        byte_ids = np.zeros(256, np.int32)
        spelled: list[bytes | None] = []
        for k, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                byte_ids[int(p.piece[3:5], 16)] = k
                spelled.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                spelled.append(model.trainer_spec.unk_surface.encode())
            else:
                spelled.append(None if p.type == kinds.CONTROL else p.piece.replace(SPACE, " ").encode())
        return Pieces(
            char_symbols, number, meet, np.array([x for x, _ in splits], np.int64), np.array([k for _, k in splits], np.int64), ranks, byte_ids, spelled,
            np.isin(np.arange(size), [k for p, k in normal.items() if p.startswith(SPACE)]), words, not crossed and bool(stop),
        )

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each two symbols make and its rank; NONE where they make none."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (left >= 0) & (right >= 0) & (self.pairs[at] == key)
        made = np.where(found, self.made[at], -1)
        return made, np.where(found, self.ranks[made], NONE)

    def merge(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left after all merges, and the place of each one's first character. points: characters of all words; starts: where words begin."""
        symbols, number = self.char_symbols[points].astype(np.int64), self.number[points]
        fresh = np.zeros(len(points), bool)
        fresh[starts[starts < len(points)]] = True
        made = np.full(len(points), -1)
        made[:-1] = self.meet[number[:-1], number[1:]]
        fresh[1:] |= made[:-1] == APART
        word, place = np.cumsum(fresh), np.arange(len(points))
        out = []
        sizes = np.diff(np.append(np.flatnonzero(fresh), len(points)))
        if len(sizes) and sizes.max() > LONGEST:
            first = np.flatnonzero(fresh)
            for k in np.flatnonzero(sizes > LONGEST).tolist():
                out.append(self.merge_long(symbols[first[k] : first[k] + sizes[k]], int(first[k])))
            short = np.repeat(sizes <= LONGEST, sizes)
            symbols, word, place, made = symbols[short], word[short], place[short], made[short]
        rank = np.where(made >= 0, self.ranks[made], NONE)
        rank[:-1][word[1:] != word[:-1]] = NONE
        rank[-1:] = NONE
        while len(symbols):
            begins = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(begins, len(word)))
            least = np.minimum.reduceat(rank, begins)
            if (over := least == NONE).any():
                gone = np.repeat(over, sizes)
                out.append((symbols[gone], place[gone]))
                symbols, word, place, made, rank = (x[~gone] for x in (symbols, word, place, made, rank))
                least, sizes = least[~over], sizes[~over]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, sizes))
            hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
            symbols[hit] = made[hit]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            symbols, word, place, made, rank = (x[keep] for x in (symbols, word, place, made, rank))
            hit = hit - np.arange(len(hit))
            beside = np.append(hit, hit[hit > 0] - 1)
            after = np.minimum(beside + 1, len(symbols) - 1)
            made[beside], found = self.pair(symbols[beside], symbols[after])
            rank[beside] = np.where((beside < after) & (word[beside] == word[after]), found, NONE)
        if not out:
            return symbols, place
        symbols, place = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(place)
        return symbols[order], place[order]

    def merge_long(self, symbols: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
        """``merge`` of a single long word, from a heap of (rank, place of the left symbol)."""
        made, rank = self.pair(symbols[:-1], symbols[1:])
        n, own = len(symbols), symbols.tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, own[k], own[k + 1], m) for k, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r != NONE]
        heapq.heapify(heap)
        lookup: dict[tuple[int, int], tuple[int, int]] = {}

        def offer(left: int, right: int) -> None:
            key = (own[left], own[right])
            if key not in lookup:
                m, r = self.pair(np.array(key[:1]), np.array(key[1:]))
                lookup[key] = int(m[0]), int(r[0])
            m, r = lookup[key]
            if r != NONE:
                heapq.heappush(heap, (r, left, *key, m))

        while heap:
            _, k, left, right, m = heapq.heappop(heap)
            nxt = after[k]
            if own[k] != left or nxt == n or own[nxt] != right:
                continue
            own[k], own[nxt], after[k] = m, -2, after[nxt]
            if after[k] < n:
                before[after[k]] = k
                offer(k, after[k])
            if before[k] >= 0:
                offer(before[k], k)
        left = np.array(own)
        place = np.flatnonzero(left != -2)
        return left[place], place + base

    def split(self, text: str) -> list[str]:
        """The words of a text, spaces as space signs; some may be empty."""
        if not text:
            return []
        if self.lines and "  " not in text and SPACE not in text and text[0] != " ":
            return (SPACE + text.replace(" ", " " + SPACE).replace("\n", " \n ")).split(" ")
        return self.words.findall(SPACE + text.replace(" ", SPACE))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        split = [self.split(t) for t in texts]
        new = [w for w in set().union(*split) if w not in self.kept]
        if new:
            points = np.frombuffer("".join(new).encode("utf-32-le"), "<u4").astype(np.int64)
            starts = np.append(0, np.cumsum([len(w) for w in new]))
            symbols, place = self.merge(points, starts[:-1])
            unknown = (symbols < 0) | (symbols >= len(self.ranks))
            ids, first = symbols.astype("<i4"), np.searchsorted(place, starts)
            strange = np.flatnonzero(np.append(0, np.cumsum(unknown))[first[1:]] > np.append(0, np.cumsum(unknown))[first[:-1]])
            raw, bounds = ids.tobytes(), (4 * first).tolist()
            found = [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for k in strange.tolist():
                own = range(first[k], first[k + 1])
                found[k] = b"".join(self.byte_ids[list(chr(points[place[j]]).encode())].tobytes() if unknown[j] else raw[4 * j : 4 * j + 4] for j in own)
            self.kept.update(zip(new, found, strict=True))
        blobs = [b"".join(map(self.kept.__getitem__, words)) for words in split]
        return np.frombuffer(b"".join(blobs), "<i4"), np.array([len(b) // 4 for b in blobs], np.int64)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts, in UTF-8, of ids that lie one after another; control ids have no text, and a text's first piece loses its leading space."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.spelled):
            raise IndexError("an id is out of range")
        ends = np.cumsum(sizes)
        parts = list(map(self.spelled.__getitem__, ids.tolist()))
        control = np.array([x is None for x in self.spelled])[ids]
        strange = np.append(0, np.cumsum(np.isin(ids, self.byte_ids[128:])))
        out = []
        for lo, hi in zip((ends - sizes).tolist(), ends.tolist(), strict=True):
            own = parts[lo:hi]
            if control[lo:hi].any():
                shown = np.flatnonzero(~control[lo:hi])
                own, first = [own[k] for k in shown.tolist()], ids[lo + shown[0]] if len(shown) else None
            else:
                first = ids[lo] if hi > lo else None
            text = b"".join(own)
            if first is not None and self.spaced[first]:
                text = text[1:]
            # only bytes of their own can be no UTF-8
            out.append(text.decode("utf-8", "each_byte").encode() if strange[hi] > strange[lo] else text)
        return out


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for each row of df: what the model's library encodes the text to, without begin and end ids."""
    pieces = df.sparkSession.sparkContext.broadcast(Pieces.read(model))
    source = id_and_text(df, id_col, text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for names, texts in text_chunks(b.column(0), b.column(1), CHUNK_BYTES):
                ids, sizes = pieces.value.encode([t.decode("utf-8", "each_byte") for t in texts])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(names)), lists], ["doc_id", "ids"])
                at += len(names)
        pieces.value.kept.clear()
        give_back()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"doc_id {kind}, ids array<int>")


def decode(df: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, ids, text) for each row of df: the text that the ids spell."""
    importable(df.sparkSession)
    pieces = df.sparkSession.sparkContext.broadcast(Pieces.read(model))
    source = df.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{ids_col}` AS array<int>) AS ids")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            step = max(1, b.num_rows * CHUNK_IDS // max(1, len(b.column(1).values)))
            for k in range(0, b.num_rows, step):
                part = b.slice(k, step)
                ids, owner = part.column(1).flatten(), pc.list_parent_indices(part.column(1))
                here = ids.is_valid().to_numpy(zero_copy_only=False)
                sizes = np.bincount(owner.to_numpy()[here], minlength=part.num_rows)
                texts = pieces.value.decode(ids.drop_null().to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "ids", "text"])
        give_back()

    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(rows, f"doc_id {kind}, ids array<int>, text string")
