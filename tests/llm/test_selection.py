"""Importance resampling, source divergence and the SentencePiece codec against brute force, SQL and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tessera.llm import divergence, pieces, resampling
from tessera.llm.queries import ORACLES, PIECES, QUERIES, tokenizer_path

#: Names that clash with columns of the results.
SCHEMA = "doc_id long, text string, lang string, source string, rank string, weight string, block string, g string, item string, value string, n string, v string, ids string, bucket string"
CLASH = ("r", "w", "b", "g", "i", "v", "n", "v", "x", "k")


def lowered(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["alpha", "Beta", "gamma.", "delta", "épsilon", "zeta,", "eta", "θήτα", "iota2", "kappa", "x|y", "#1", "İ", "don't"]
    texts = [None, "", " \n\t ", "one", "ONE", "a" * 60_000, "a b " * 9_000, "😀 𝒳 é\x0bz \x00"] + [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(70))) for _ in range(400)]
    texts += ["the very same text of a good twenty words that is here again and again so that ties can come up in it too"] * 40
    out = [(k, t, [None, "en", "de", "en"][k % 4], [None, "a", "b", "", "é"][k % 5], *CLASH) for k, t in enumerate(texts)]
    return out + [(None, "no id", "en", "a", *CLASH), (None, texts[20], "xx", "only", *CLASH), out[30], out[30], (900, "one", "fr", "a", *CLASH), (901, "two", "fr", "b", *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def some(rows):
    return sorted((tuple(r) for r in rows), key=str)


# 11. Importance resampling


def runs(text, buckets=10_000, order=3):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, order + 1) for i in range(len(words) - k + 1)]


def resampled(rows, target, percent=5, min_words=20):
    found = [(d, *runs(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in runs(x)[1])
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'null' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gains[b] for b in f)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return some(x[:5] for x in out)


@pytest.mark.parametrize("chunk, blocks", [(4_000_000, 64), (2_000, 64), (2_000, 2)])
def test_resampling(spark, docs, rows, monkeypatch, chunk, blocks):
    monkeypatch.setattr(resampling, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(resampling, "BLOCKS", blocks)
    target = spark.createDataFrame([("alpha beta gamma",), (None,), ("",), ("the very same text",)], "text string")
    found = resampling.resample(docs, target, percent=30)
    wanted = resampled([r[:2] for r in rows], ["alpha beta gamma", None, "", "the very same text"], percent=30)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert some(found.collect()) == wanted
    assert sum(r[4] is not None for r in wanted) > 50


def test_resampling_of_nothing(docs, nothing, rows):
    assert resampling.resample(nothing, docs).collect() == []
    assert some(resampling.resample(docs, nothing).collect()) == resampled([r[:2] for r in rows], [])
    ids = docs.select(F.col("doc_id").cast("string").alias("name"), "text")
    assert {type(r.doc_id) for r in resampling.resample(ids, nothing, id_col="name").collect()} == {str, type(None)}


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for values in ([], [0], [127, 128, 0, 1 << 40, (1 << 62) - 1], (1 << rng.integers(0, 50, 2000)) - 1):
        assert resampling.unpacked(resampling.packed(np.array(values, np.int64))).tolist() == list(values)


def test_resampling_query(spark, data):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{data}/documents.parquet").to_pydict()
    wanted = resampled(list(zip(table["doc_id"], table["text"], strict=True)), pq.read_table(f"{data}/benchmark.parquet")["text"].to_pylist())
    assert some(QUERIES["op11_bucket_resampling"](spark, data).collect()) == wanted


# 12. Source divergence


def audited(rows, least):
    groups, counts, docs = set(), Counter(), Counter()
    for r in rows:
        text, lang, source = (x or "" for x in r[1:4])
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))
        groups.add((lang, source))
        counts.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= least]
        sources = [s for x, s in groups if x == lang]

        def share(of, kept=kept, lang=lang):
            own = {t: sum(counts[lang, s, t] for s in of) for t in kept}
            n = sum(own.values())
            return {t: 1 + 10**9 * (c + 5) // (n + 5 * len(kept)) for t, c in own.items()}

        p, q = share([source]), share(sources)
        pairs = sorted(((-sum(abs(p[t] - x[t]) for t in kept), s.encode(), s) for s in sources if s != source for x in [share([s])]))
        terms = sorted((q[t] - p[t], t.encode(), t) for t in kept if counts[lang, source, t] and p[t] > q[t])[:50]
        out += [(lang, source, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found)]
    return some(out)


@pytest.mark.parametrize("least, shard", [(30, 20_000), (1, 3)])
def test_divergence(docs, rows, monkeypatch, least, shard):
    monkeypatch.setattr(divergence, "SHARD", shard)
    found = divergence.audit(docs, min_docs=least)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    wanted = audited(rows, least)
    assert some(found.collect()) == wanted
    # a language without kept terms still has its pairs
    assert least == 1 or {r[4] for r in wanted if r[0] == "fr"} == {0}


def test_divergence_of_nothing(nothing):
    assert divergence.audit(nothing).collect() == []


def test_shares_are_exact(spark):
    rng = random.Random(8)
    cases = [(c, n) for n in (1, 7, 10**6 + 3, 4 * 10**15 + 1, 9 * 10**15) for c in (0, 1, n // 3, n - 1, n, rng.randrange(n))]
    for c, n in cases:
        assert divergence.share(np.array([c]), np.array([n])).tolist() == [1 + 10**9 * c // n]
    wide = [(c, n - 5 * v, v) for c, n in cases for v in (0, 1) if n > 5 * v]
    df = spark.createDataFrame(wide, "c long, n long, v long").select("c", "n", "v", divergence.share_column(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.c + 5) // (r.n + 5 * r.v)


def test_divergence_query(spark, data):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    query = c.execute(ORACLES["op12_source_divergence"])
    columns = [d[0] for d in query.description]
    assert some(QUERIES["op12_source_divergence"](spark, data).select(columns).collect()) == some(query.fetchall())


# 13. SentencePiece


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces.read(tokenizer_path(PIECES))


def decoded(own, ids):
    return own.decode(np.array(ids, np.int32), np.array([len(ids)]))[0].decode()


def test_pieces_of_odd_texts(own, library):
    rng = random.Random(4)
    letters = "ab e▁\n\t漢字é́😀0x<>st"
    texts = ["", " ", "  a", "a ", " \n ", "<s>", "<0x0A>", "▁a", "▁▁ x", "a\x00b", " " * 5000, "=" * 300, "ab" * 3000, "".join(rng.choice("etaoin ") for _ in range(6000)), "".join(rng.choice("etaoin") for _ in range(5000))]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    ids, sizes = own.encode(texts)
    ends = np.cumsum(sizes)
    for text, n, end in zip(texts, sizes, ends, strict=True):
        found = ids[end - n : end].tolist()
        assert found == library.encode(text)
        assert decoded(own, found) == library.decode(found)


def test_long_words_in_rounds_and_from_the_heap(own, library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(s) for _ in range(n)) for s in ("ab", "etaoinshrdlu", "0123456789abcdef", "=-") for n in (30, 200, 900)]
    for longest in (4096, 8):
        monkeypatch.setattr(pieces, "LONGEST", longest)
        own.kept.clear()
        assert own.encode(texts)[0].tolist() == [x for t in texts for x in library.encode(t)]


def test_any_ids_decode_as_in_the_library(own, library):
    rng = random.Random(2)
    cases = [[rng.choice([rng.randrange(32_000), rng.randrange(300)]) for _ in range(rng.randrange(12))] for _ in range(2000)]
    for ids in cases:
        assert decoded(own, ids) == library.decode(ids)
    with pytest.raises(IndexError):
        decoded(own, [32_000])


def test_codec(spark, docs, rows, library, nothing):
    model = tokenizer_path(PIECES)
    found = pieces.decode(pieces.encode(docs, model), model)
    assert found.columns == ["doc_id", "ids", "text"]
    wanted = [(d, library.encode(t or "")) for d, t, *_ in rows]
    assert some(found.select("doc_id", "ids").collect()) == some(wanted)
    assert all(r.text == library.decode(r.ids) for r in found.collect())
    assert pieces.decode(pieces.encode(nothing, model), model).collect() == []
    bare = spark.createDataFrame([(1, None), (2, [None, 28705, None, 264]), (3, [])], "k long, x array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(bare, model, "k", "x").collect()} == {1: "", 2: " a", 3: ""}
    raw = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF20C3' AS STRING) AS text")
    assert pieces.encode(raw, model).first().ids == library.encode("a� �")


def test_codec_query(spark, data, library):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{data}/documents.parquet").to_pydict()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = [library.encode(t or "") for t in table["text"]]
    wanted = some((d, len(x), sha(",".join(map(str, x))), sha(library.decode(x))) for d, x in zip(table["doc_id"], ids, strict=True))
    assert some(QUERIES["op13_piece_codec"](spark, data).collect()) == wanted
