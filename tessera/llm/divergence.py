"""Source divergence audit: how far apart the sources of a language are in their choice of terms.

Count columns are deduplicated: each kept term of a language has a sparse vector, its count in every source that has it. Terms with the same
vector are one row with a multiplicity; every pair of sources is evaluated once on each distinct vector and multiplied by it. Terms are
ranked as themselves.

Tasks count terms in texts and add up over their documents before rows are dealt out by (language, term), once. Distinct vectors are dealt
into shards of about SHARD of them, each co-grouped with its language's sources, so a frequent language is many tasks; pair sums of shards are added. The
first ranks of terms are taken before the shuffle as well as after it. A report on pairs has sources x sources rows by its nature, so a
language's list of sources, and a term's vector, which is no longer, fit a task.

Shares are whole numbers, p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), computed without rounding (exact to 9 * 10**15 words a
language); V is the number of kept terms and N the sum of their counts.

Defined results: null text, language and source are ''; a language without kept terms has pairs of value 0 and no terms; ties go by item in
UTF-8 order; repeated rows are documents of their own; an empty table gives an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import as_bytes, drop_written, give_back, importable, written

MIN_DOCS = 30
TERMS = 50
SCALE = 1_000_000_000
SMOOTH = 5
SHARD = 20_000
TERMS_HELD = 200_000
CELLS = 2_000_000
#: Letters below U+0080, lowered, and every byte of other characters; all else parts terms.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) by long division in base 1000, for 0 <= count <= total; 1 where total is 0."""
    total = np.maximum(total, 1)
    rest, out = count, np.zeros_like(count)
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def share_column(count: Column, n: Column, v: Column) -> Column:
    """The same as an expression."""
    wide = lambda x: x.cast("decimal(19,0)")
    scaled = wide(count + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", scaled, wide(n + SMOOTH * v)).cast("long") + 1


def term_counts(df: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs), summed within tasks only."""
    importable(df.sparkSession)
    rows_in = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))], F.col(text_col).cast("binary").alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: dict[tuple[str, str], Counter] = defaultdict(Counter)
        docs: dict[tuple[str, str], Counter] = defaultdict(Counter)

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), own in times.items():
                terms, n = list(own), len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.binary()), pa.array(own.values(), pa.int64()), pa.array(map(docs[lang, source].__getitem__, terms), pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            times.clear()
            docs.clear()

        for b in batches:
            for key, text in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), as_bytes(b.column(2)), strict=True):
                terms = text.as_py().translate(TERM_BYTES).split()
                times[key].update(terms)
                docs[key].update(set(terms))
            if sum(map(len, times.values())) > TERMS_HELD:
                yield from counted()
        yield from counted()
        give_back()

    return rows_in.mapInArrow(rows, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def kept_terms(df: DataFrame, lang_col: str, source_col: str, text_col: str, min_docs: int) -> DataFrame:
    """A written table (lang, term, total, vec): the terms of enough documents, with their counts by source in order of source."""
    found = term_counts(df, lang_col, source_col, text_col).repartition("lang", "term")
    found = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    found = found.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("vec"))
    return written(found.where(F.col("docs") >= min_docs).drop("docs"), "terms")


def pair_sums(vectors: DataFrame, groups: DataFrame, shards: int) -> DataFrame:
    """(lang, a, b, value) for every two sources a < b of a language: the sum over distinct vectors of multiplicity times distance."""
    left = vectors.select("lang", F.pmod(F.xxhash64("vec"), F.lit(shards)).alias("shard"), "m", "vec")
    right = groups.select("lang", F.explode(F.expr(f"sequence(0L, {shards - 1}L)")).alias("shard"), "source", "n", "v")

    def evaluated(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("source")
        names, totals = right.column("source").to_pylist(), right.column("n").to_numpy() + SMOOTH * right.column("v").to_numpy()
        place, size = {x: k for k, x in enumerate(names)}, len(names)
        sums, step = np.zeros((size, size), np.int64), max(1, CELLS // max(1, size))
        for lo in range(0, left.num_rows, step):
            part = left.slice(lo, step)
            counts = np.zeros((part.num_rows, size), np.int64)
            for k, vec in enumerate(part.column("vec").to_pylist()):
                for x in vec:
                    counts[k, place[x["source"]]] = x["n"]
            p, m = share(counts + SMOOTH, totals[None, :]), part.column("m").to_numpy()
            for k in range(size - 1):
                sums[k, k + 1 :] += m @ np.abs(p[:, k + 1 :] - p[:, k : k + 1])
        a, b = np.triu_indices(size, 1)
        named = pa.array(names, pa.string())
        return pa.table([pa.array([key[0].as_py()] * len(a), pa.string()), named.take(pa.array(a)), named.take(pa.array(b)), pa.array(sums[a, b])], names=["lang", "a", "b", "value"])

    found = left.groupBy("lang", "shard").cogroup(right.groupBy("lang", "shard")).applyInArrow(evaluated, "lang string, a string, b string, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part "pair" has each other source of the language and the distance to it, part "term" the first
    ``terms`` kept terms that the source uses more than its language does."""
    kept = kept_terms(df, lang_col, source_col, text_col, min_docs)
    vectors = written(kept.groupBy("lang", "vec").agg(F.count("*").alias("m")), "vectors")
    by_source = vectors.select("lang", "m", F.inline("vec")).groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("n"))
    by_lang = kept.groupBy("lang").agg(F.sum("total").alias("n_lang"), F.count("*").alias("v"))
    groups = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = written(groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select("lang", "source", zero("n"), zero("n_lang"), zero("v")), "groups")

    sums = pair_sums(vectors, groups, max(1, -(-vectors.count() // SHARD)))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = written(sums.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order)), "pairs")
    drop_written(vectors)

    used = kept.select("lang", F.col("term").alias("item"), "total", F.inline("vec")).withColumnRenamed("n", "count").join(groups, ["lang", "source"])
    p, q = share_column(F.col("count"), F.col("n"), F.col("v")), share_column(F.col("total"), F.col("n_lang"), F.col("v"))
    more = used.select("lang", "source", F.lit("term").alias("part"), "item", (p - q).alias("value")).where("value > 0")
    return pairs.union(more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= terms))


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT doc) AS docs FROM words GROUP BY lang, source, term),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS total FROM counts GROUP BY lang, term HAVING sum(docs) >= 30),
own AS (SELECT c.lang, c.source, c.term, CAST(c.n AS HUGEINT) AS n FROM counts c JOIN kept k ON c.lang = k.lang AND c.term = k.term),
by_lang AS (SELECT lang, sum(total) AS n_lang, count(*) AS v FROM kept GROUP BY lang),
by_source AS (SELECT lang, source, sum(n) AS n FROM own GROUP BY lang, source),
groups AS (SELECT g.lang, g.source, coalesce(s.n, 0) AS n, coalesce(l.n_lang, 0) AS n_lang, coalesce(l.v, 0) AS v
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN by_source s ON g.lang = s.lang AND g.source = s.source LEFT JOIN by_lang l ON g.lang = l.lang),
dense AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(o.n, 0) + 5)) // CAST(g.n + 5 * g.v AS HUGEINT) AS p,
                 1 + (CAST(1000000000 AS HUGEINT) * (k.total + 5)) // CAST(g.n_lang + 5 * g.v AS HUGEINT) AS q
          FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM dense WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT * FROM (SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) AS t WHERE rank <= 50
"""
