"""Explanations by a language model: which cluster gets what, from which texts, and what becomes of the answer.

A model is a function from a column of prompts to a column of answers, so gates, choices and write-backs are one plan
around it: ``batched`` makes one of a function over lists (a service's client, in Arrow batches); ``mock_model`` is an expression.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import answers
from tessera.operators.feeds import newest
from tessera.operators.hydration import PAPERS, blank
from tessera.operators.merge import merge

Model = Callable[[Column], Column]
LONGEST_TAKEAWAY, LEAST_CONTENT, LEAST_NEWS, MOST_NEWS, MOST_WORDS = 280, 80, 300, 6000, 250
MOST_ITEMS = 10
#: Origins of texts by kind. Fixed values.
FULLTEXT_ORIGINS = ("landing_page", "arxiv_pdf", "arxiv_html", "arxiv_eprint", "unpaywall_pdf", "unpaywall_landing", "openalex_pdf", "openalex_landing", "crossref_pdf", "crossref_landing")
ITEM = "array<struct<title:string,snippet:string,full_text:string,kind:string,source_name:string,is_paper:boolean>>"


def batched(answer: Callable[[list[str]], list[str | None]]) -> Model:
    """A model from a function over a list of prompts, called once for each Arrow batch."""

    @F.pandas_udf("string")
    def each(prompts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in prompts:
            yield pd.Series(answer(batch.tolist()))

    return each


def mock_model(prompt: Column) -> Column:
    """The prompt's last line, as an answer in quotes."""
    return F.concat(F.lit('"'), F.element_at(F.split(prompt, "\n"), -1), F.lit('"'))


def mock_embedding(size: int) -> Model:
    """Unit vectors of normal numbers seeded by the text's SHA-256."""

    @F.pandas_udf("array<double>")
    def each(texts: pd.Series) -> pd.Series:
        import hashlib

        import numpy as np

        def one(text: str) -> list[float]:
            v = np.random.default_rng(list(hashlib.sha256((text or "").encode()).digest())).normal(size=size)
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return each


def paper_kind(text: Column, kind: Column, origin: Column) -> Column:
    """missing, fulltext or abstract: as declared, else by origin, else abstract."""
    named, origin = F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lower(F.trim(F.coalesce(origin, F.lit(""))))
    return F.when(blank(text), "missing").when(named.isin("fulltext", "abstract"), named).when(origin.isin(*FULLTEXT_ORIGINS), "fulltext").otherwise("abstract")


def evidence(members: DataFrame, items: DataFrame) -> DataFrame:
    """(cluster_id, items): the first MOST_ITEMS of a cluster by role, then the newest, as an array of ITEM."""
    i = items.select(
        F.col("id").alias("item_id"), "title", "snippet", "full_text", paper_kind(F.col("full_text"), F.col("full_text_kind"), F.col("full_text_source")).alias("kind"), "source_name",
        F.col("content_type").isin(*PAPERS).alias("is_paper"), "published_at",
    )
    met = members.select("cluster_id", "item_id", "role").join(i, "item_id")
    first = met.withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy("role", newest("published_at"), "item_id"))).where(F.col("rn") <= MOST_ITEMS)
    listed = F.array_sort(F.collect_list(F.struct("rn", F.struct("title", "snippet", "full_text", "kind", "source_name", "is_paper").alias("i"))))
    return first.groupBy("cluster_id").agg(F.transform(listed, lambda x: x["i"]).alias("items"))


def takeaway_refusal(title: Column, items: Column) -> Column:
    """Why no takeaway is asked for, null where one is."""
    size = lambda t: F.coalesce(F.char_length(t), F.lit(0))
    total = size(title) + F.aggregate(items, F.lit(0), lambda s, x: s + size(x["title"]) + size(x["snippet"]))
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "no_items").when(F.coalesce(title, F.lit("")) == "", "no_title").when(total < LEAST_CONTENT, "insufficient_content")


def takeaway_prompt(title: Column, items: Column) -> Column:
    """The titles, sources and beginnings of the first five items, under the cluster's title."""
    one = lambda x: F.concat_ws("\n", x["title"], F.concat(F.lit("Source: "), x["source_name"]), F.concat(F.lit("Summary: "), F.when(F.char_length(x["snippet"]) > 300, F.concat(F.left(x["snippet"], F.lit(300)), F.lit("..."))).otherwise(x["snippet"])))
    return F.concat(F.lit("In one or two plain sentences: what happened and why does it matter? Only what the articles say.\n"), F.array_join(F.transform(F.slice(items, 1, 5), one), "\n\n"), F.lit("\n"), title)


def takeaways(clusters: DataFrame, members: DataFrame, items: DataFrame, model: Model) -> DataFrame:
    """(id, takeaway, refusal) for each of the clusters; an answer that tells of too little context is a refusal."""
    met = clusters.select("id", "canonical_title").join(evidence(members, items), F.col("id") == F.col("cluster_id"), "left")
    refusal = takeaway_refusal(F.col("canonical_title"), F.col("items"))
    asked = met.withColumn("refusal", refusal).withColumn("answer", F.when(F.col("refusal").isNull(), model(takeaway_prompt(F.col("canonical_title"), F.col("items")))))
    text = answers.unquoted(F.col("answer"))
    refused = F.coalesce("refusal", F.when(F.col("answer").isNull(), "failed").when(answers.no_context(text), "insufficient_context"))
    return asked.select("id", F.when(refused.isNull(), answers.cut_at_sentence(text, LONGEST_TAKEAWAY)).alias("takeaway"), refused.alias("refusal"))


def fulltext_papers(items: Column) -> Column:
    return F.filter(items, lambda x: x["is_paper"] & (x["kind"] == "fulltext"))


def abstract_papers(items: Column) -> Column:
    return F.filter(items, lambda x: x["is_paper"] & (x["kind"] == "abstract"))


def abstract_context(items: Column, most: int = 5) -> Column:
    """Titles with sources over texts, of the first items that have one; null where none has."""
    given = F.filter(F.slice(items, 1, most), lambda x: ~blank(x["full_text"]))
    head = lambda x: F.concat(F.lit("- "), F.trim(F.coalesce(x["title"], F.lit("Untitled source"))), F.when(~blank(x["source_name"]), F.concat(F.lit(" ["), F.trim(x["source_name"]), F.lit("]"))).otherwise(""))
    return F.when(F.size(given) > 0, F.array_join(F.transform(given, lambda x: F.concat(head(x), F.lit("\n"), x["full_text"])), "\n\n"))


def combined_article(items: Column) -> Column:
    """All texts, each under its title, with rules between; null where there is none."""
    given = F.filter(items, lambda x: ~blank(x["full_text"]))
    part = lambda x: F.concat(F.when(~blank(x["title"]), F.concat(F.lit("## "), F.trim(x["title"]), F.lit("\n\n"))).otherwise(""), answers.stripped(x["full_text"]))
    return F.when(F.size(given) > 0, F.array_join(F.transform(given, part), "\n\n---\n\n"))


def news_content(full_text: Column, snippet: Column) -> Column:
    """What a news summary is made from: the full text if long enough, else the snippet if that is, else null."""
    full, short = answers.stripped(F.coalesce(full_text, F.lit(""))), answers.stripped(F.coalesce(snippet, F.lit("")))
    return F.when(F.char_length(full) >= LEAST_NEWS, F.left(full, F.lit(MOST_NEWS))).when(F.char_length(short) >= LEAST_NEWS, short)


def action(takeaway: Column, deep_dive: Column, items: Column, mode: str = "stage3") -> Column:
    """What a cluster gets next.

    explain: layered explanations of the deep dive there is; deep_dive: one from full texts, then those; abstracts: a short one from
    abstracts; news: a summary; skip_*: nothing, with the reason. The mode "deep_dive" takes papers only.
    """
    paper = F.exists(items, lambda x: x["is_paper"])
    content = news_content(F.coalesce(combined_article(items), F.get(items, 0)["full_text"]), F.get(items, 0)["snippet"])
    out = F.when(F.coalesce(takeaway, F.lit("")) == "", "skip_no_takeaway")
    if mode != "deep_dive":
        out = out.when(~blank(deep_dive), "explain")
    out = out.when(F.coalesce(paper, F.lit(False)) & (F.size(fulltext_papers(items)) > 0), "deep_dive").when(paper & abstract_context(abstract_papers(items)).isNotNull(), "abstracts").when(paper, "skip_no_fulltext")
    if mode == "deep_dive":
        return out.otherwise("skip_no_papers")
    return out.when(F.coalesce(F.size(items), F.lit(0)) == 0, "skip_news_no_items").when(content.isNull(), "skip_news_insufficient_context").otherwise("news")


def skip_reason(action: Column) -> Column:
    """What is noted on the cluster beside the action: null clears the note of a cluster that gets its deep dive."""
    return F.when(action == "abstracts", "abstract_only").when(action == "skip_no_fulltext", "no_fulltext").when(action.like("skip_news%"), F.substring(action, 6, 100))


def shortened(prompt: Column, model: Model) -> Column:
    """The model's clean answer; where it has over MOST_WORDS words, that to the prompt with a demand for brevity, if there is one."""
    first = answers.unquoted(model(prompt))
    again = answers.unquoted(model(F.concat(prompt, F.lit("\n\nRevision instruction: shorten aggressively while preserving meaning."))))
    return F.when(answers.n_words(first) > MOST_WORDS, F.coalesce(again, first)).otherwise(first)


def explained(rows: DataFrame, deep_dive: str, title: str, model: Model) -> DataFrame:
    """rows with long (from the deep dive), short (from long alone), whether either brings new digits, and the confidence."""
    prompt = lambda body: F.concat(F.lit("Explain to a reader, from this text only:\n"), F.col(title), F.lit("\n"), body)
    out = rows.withColumn("long", shortened(prompt(F.col(deep_dive)), model))
    out = out.withColumn("short", F.when(F.coalesce("long", F.lit("")) != "", shortened(prompt(F.col("long")), model)))
    out = out.withColumn("long_new", answers.new_digits(F.col(deep_dive), F.col("long"))).withColumn("short_new", answers.new_digits(F.col("long"), F.coalesce("short", F.lit(""))))
    return out.withColumn("confidence", F.round(answers.intuition_confidence(F.col("long"), F.col("short"), F.col("long_new"), F.col("short_new")), 6))


def rated(answer: Column) -> Column:
    """struct<novelty, translation, evidence, confidence> of a model's impact rating, each from 0 to 1; null where it is no object."""
    names = ("novelty_score", "translation_score", "evidence_score", "confidence")
    o = answers.json_object(answer, ", ".join(f"{n} string" for n in names))
    return F.when(o.isNotNull(), F.struct(*[answers.clamp(answers.number(F.coalesce(o[n], F.lit("")))).alias(n.removesuffix("_score")) for n in names]))


def embeddings_changed(texts: DataFrame, embeddings: DataFrame, embed: Model, force: bool = False) -> DataFrame:
    """(cluster_id, embedding, source_hash): new vectors of texts (cluster_id, text) that have none or whose hash is another."""
    hashed = texts.select("cluster_id", "text", F.sha2("text", 256).alias("source_hash"))
    if not force:
        hashed = hashed.join(embeddings.select("cluster_id", "source_hash"), ["cluster_id", "source_hash"], "left_anti")
    return hashed.select("cluster_id", embed(F.col("text")).alias("embedding"), "source_hash")


def upsert_embeddings(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    return merge(stored, fresh, ["cluster_id"])


def connections(found: DataFrame, most: int = 5) -> DataFrame:
    """Of the analysed predecessors (target, place, connected, confidence) the first ``most`` connected ones of a target, by confidence."""
    w = Window.partitionBy("target")
    first = found.where("connected").withColumn("rn", F.row_number().over(w.orderBy("place"))).where(F.col("rn") <= most)
    return first.withColumn("rank", F.row_number().over(w.orderBy(F.col("confidence").desc(), "place"))).drop("rn")
