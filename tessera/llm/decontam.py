"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters and digits. Fixed masks of SPAN tokens ignore some
positions; each mask hashes the others at every place of test items and training texts. Equal
hashes (one mask, one value) put an item against a text at one offset. The overlap there is
verified on the words themselves: within some window of WINDOW tokens (the whole item where it is
shorter) that the text and the item share at that offset, at least SIMILARITY of the
tokens must be equal. Substituted words fall on ignored positions of some mask, so a seed hits
although no run of SPAN tokens is intact. Items of fewer tokens than SPAN have masks of their own
size, each ignoring one position; those of fewer than TOLERANT tokens have one mask that ignores
none, so they are found where a text holds them whole and unchanged. An item of fewer than ANYWHERE tokens ("yes")
stands in texts by chance, so it only counts where it is all of a text.

All of it is DataFrame functions. The seeds of the test items are broadcast while they number at most
BROADCAST_SEEDS (each an 8-byte hash, place, length and item); the words against an item are then cut out where
the seed hits, and no text is shuffled. Beyond that number seeds are joined by a shuffle on the
hash, and the texts that were hit are fetched once. A common passage only gives as many rows as there are places where it lies.

Defined results: null or empty texts and items have no tokens and are clean; repeated rows (same id and
text) have equal results; rows with null ids are kept; an item whose id is null counts and is spelled "null";
items of one text count once for each id; empty tables give no hits; other columns are ignored
(``matches``, ``annotate``) or passed through (``remove``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: Positions that count, of SPAN. In any run of 10 tokens with two substitutions, and of 9 with one, some
#: mask lies on equal tokens only (tests try them all), so no overlap that verifies is lost.
MASKS = ((0, 4, 5, 6, 8), (2, 3, 4, 6, 8), (0, 1, 3, 7, 8), (0, 2, 3, 5, 6))
SPAN = 9
TOLERANT = 6
ANYWHERE = 3
WINDOW = 13
SIMILARITY = 0.8
BROADCAST_SEEDS = 1_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def masks(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks of items of that many tokens: the positions that count."""
    if size >= SPAN:
        return MASKS
    if size < TOLERANT:
        return (tuple(range(size)),)
    return tuple(tuple(p for p in range(size) if p != j) for j in range(size))


def seeds(hashes: Column, pos: Column, size: int) -> list[Column]:
    """The hash of each mask of that size at a place; null where the mask doesn't fit."""
    hashed = lambda k, mask: F.xxhash64(F.lit(100 * size + k), *[F.get(hashes, pos + p) for p in mask])
    return [F.when(pos + size <= F.size(hashes), hashed(k, m)) for k, m in enumerate(masks(size))]


def item_table(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, item_id, item_words, hashes): ``item`` stands for the words, as ids may be null or repeat."""
    words = benchmark.select(F.col(item_col).alias("item_id"), tokens(F.col(text_col)).alias("item_words")).where(F.size("item_words") > 0)
    return words.select(F.xxhash64("item_words").alias("item"), "item_id", "item_words", F.transform("item_words", lambda w: F.xxhash64(w)).alias("hashes"))


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(text_col, F.lit("")))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """(doc_id, text_hash, item_id, equal, window): the best verified overlap of each text and item."""
    items = item_table(benchmark, item_col, item_text_col)
    texts = items.dropDuplicates(["item"]).select("item", "item_words", "hashes")
    sizes = sorted({min(r.n, SPAN) for r in texts.select(F.least(F.size("hashes"), F.lit(SPAN)).alias("n")).distinct().collect()})
    pos, hashes = F.col("pos"), F.col("hashes")
    own = F.array().cast("array<bigint>")
    for n in sizes:
        own = F.when(F.least(F.size(hashes), F.lit(SPAN)) == n, F.array(*seeds(hashes, pos, n))).otherwise(own)
    sown = texts.select("item", "hashes", F.posexplode("hashes").alias("pos", "w")).select("item", F.size("hashes").alias("n"), "pos", F.explode(own).alias("hash"))
    sown = sown.where("hash IS NOT NULL").select("item", "n", F.col("pos").alias("item_pos"), "hash").distinct()
    small = sown.count() <= broadcast_seeds
    sized = lambda df: F.broadcast(df) if small else df

    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    keyed = rows.select("doc_id", "text_hash", tokens(F.col("text")).alias("words"))
    # plain columns after each generator, so that places, hashes and look-ups are one stage of generated code; an outer generator, as for
    # the other kind the optimizer infers a filter that splits and hashes the texts once more
    hashed = keyed.select("doc_id", "text_hash", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    placed = hashed.select("doc_id", "text_hash", "words", "hashes", F.posexplode_outer("hashes").alias("pos", "w"))
    every = F.array(*[x for n in sizes for x in seeds(hashes, pos, n)]) if sizes else F.array().cast("array<bigint>")
    # the words stay at hand where seeds are broadcast; where rows are shuffled by hash, they must not come along
    at_hand = ["words"] if small else []
    met = placed.select("doc_id", "text_hash", *at_hand, F.size("words").alias("n_words"), "pos", F.explode(every).alias("hash")).join(sized(sown), "hash")
    met = met.where((F.col("n") >= ANYWHERE) | (F.col("n_words") == F.col("n"))).withColumn("offset", F.col("pos") - F.col("item_pos"))
    first, last = F.greatest(F.lit(0), -F.col("offset")), F.least(F.col("n"), F.col("n_words") - F.col("offset"))
    window = F.least(F.lit(WINDOW), F.col("n"))

    def cut_out(df: DataFrame) -> DataFrame:
        """The words of the text that lie against the item, where they fill a window."""
        part = F.slice("words", first + F.col("offset") + 1, last - first).alias("part")
        return df.where(last - first >= window).select("doc_id", "text_hash", "item", "offset", first.alias("first"), window.alias("window"), part)

    if small:
        cut = cut_out(met).dropDuplicates(["doc_id", "text_hash", "item", "offset"])
    else:
        hits = met.select("doc_id", "text_hash", "item", "n", "offset").distinct()
        hits = hits.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("item", "n", "offset")).alias("hits"))
        h = hits.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "hits")
        again = rows.join(h, rows.doc_id.eqNullSafe(h.d) & (rows.text_hash == h.t)).dropDuplicates(["doc_id", "text_hash"])
        again = again.select("doc_id", "text_hash", tokens(F.col("text")).alias("words"), "hits")
        cut = cut_out(again.select("doc_id", "text_hash", "words", F.explode("hits").alias("hit")).select("doc_id", "text_hash", "words", F.size("words").alias("n_words"), "hit.*"))
    both = cut.join(sized(texts.select("item", "item_words")), "item")
    same = both.withColumn("same", F.zip_with(F.slice("item_words", F.col("first") + 1, F.size("part")), "part", lambda x, y: (x == y).cast("int")))
    windows = F.transform(F.sequence(F.lit(1), F.size("same") - F.col("window") + 1), lambda i: F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda x, y: x + y))
    best = same.select("doc_id", "text_hash", "item", "window", F.array_max(windows).alias("equal"))
    least = F.when(F.col("window") < TOLERANT, F.col("window")).otherwise(F.col("window") * SIMILARITY)
    best = best.where(F.col("equal") >= least).groupBy("doc_id", "text_hash", "item").agg(F.max("equal").cast("long").alias("equal"), F.max("window").cast("long").alias("window"))
    named = items.select("item", "item_id").distinct()
    return best.join(sized(named), "item").select("doc_id", "text_hash", "item_id", "equal", "window")


def annotate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending, comma-joined) for each row of docs."""
    spelled = F.transform(F.array_sort(F.collect_list(F.struct(F.col("item_id").isNull().alias("none"), "item_id"))), lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null")))
    found = matches(docs, benchmark, id_col, text_col, **more).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n_items"), F.array_join(spelled, ",").alias("item_ids"))
    found = found.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "n_items", "item_ids")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_hash"))
    out = rows.join(found, rows.doc_id.eqNullSafe(found.d) & (rows.text_hash == found.t), "left")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.lit("")).alias("item_ids"))


def remove(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, all columns, that overlap no item.

    The keys of contaminated rows are written and counted: up to BROADCAST_SEEDS they are broadcast and
    no text moves, beyond that rows are shuffled once.
    """
    found = written(matches(docs, benchmark, id_col, text_col, **more).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__t")).distinct(), "contaminated")
    gone = F.broadcast(found) if found.count() <= BROADCAST_SEEDS else found
    return docs.join(gone, docs[id_col].eqNullSafe(gone["__d"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone["__t"]), "left_anti")
