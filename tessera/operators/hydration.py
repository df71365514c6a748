"""Getting the text of items: what to fetch, which place to try first, which text to keep, and writing it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.merge import merge

PAPERS = ("preprint", "peer_reviewed")
PAYWALL = (401, 402, 403)
#: Origins of a text in the order of trying: step and kind. Those of one step compete by quality. Fixed values.
CASCADE = {
    "arxiv_html": (1, "fulltext"),
    "arxiv_pdf": (1, "fulltext"),
    "arxiv_eprint": (1, "fulltext"),
    "arxiv_api": (2, "abstract"),
    "unpaywall_pdf": (3, "fulltext"),
    "unpaywall_landing": (4, "fulltext"),
    "openalex_pdf": (5, "fulltext"),
    "openalex_landing": (6, "fulltext"),
    "crossref_pdf": (7, "fulltext"),
    "crossref_landing": (8, "fulltext"),
    "crossref": (9, "abstract"),
    "openalex": (10, "abstract"),
    "landing_page": (11, "fulltext"),
}
#: What an origin of the first step adds to its quality. Fixed values.
BONUS = {"arxiv_eprint": 0.18, "arxiv_html": 0.12, "arxiv_pdf": 0.08}
PLACE = "struct<url:string,source:string,is_pdf:boolean,is_open:boolean,license:string>"


def looked_up(table: dict[str, object], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def papers_due(items: DataFrame, most: int) -> DataFrame:
    """Papers without text, newest first."""
    return items.where(F.col("content_type").isin(*PAPERS) & blank(F.col("full_text"))).orderBy(F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "id").limit(most)


def articles_due(items: DataFrame, most: int) -> DataFrame:
    """Other items whose text is pending and missing, newest first."""
    due = ~F.col("content_type").isin(*PAPERS) & (F.col("full_text_status") == "pending") & blank(F.col("full_text"))
    return items.where(due).orderBy(F.col("published_at").desc_nulls_last(), F.col("fetched_at").desc(), "id").limit(most)


def article_status(code: Column, content_type: Column, good: Column) -> Column:
    """ok, paywalled, error or not_found, from an answer's status code (null: none came), type and whether its text passes the gate."""
    return (
        F.when(code.isin(*PAYWALL), "paywalled").when(code.isNull() | (code != 200), "error").when(~F.coalesce(F.lower(content_type).contains("html"), F.lit(False)), "error")
        .when(F.coalesce(good, F.lit(False)), "ok").otherwise("not_found")
    )


def crossref_places(answer: Column) -> Column:
    """Places in a registry's JSON: PDF links, then the landing page. A license URL makes them open."""
    m = F.from_json(answer, "message struct<license:array<struct<URL:string>>,link:array<struct<URL:string,`content-type`:string>>,URL:string>")["message"]
    license_ = F.nullif(F.trim(F.get(m["license"], 0)["URL"]), F.lit(""))
    place = lambda url, kind: F.struct(F.trim(url).alias("url"), F.lit(f"crossref_{kind}").alias("source"), F.lit(kind == "pdf").alias("is_pdf"), license_.isNotNull().alias("is_open"), license_.alias("license"))
    is_pdf = lambda x: ~blank(x["URL"]) & (F.coalesce(F.lower(x["content-type"]).contains("pdf"), F.lit(False)) | F.lower(x["URL"]).endswith(".pdf"))
    pdfs = F.coalesce(F.transform(F.filter(m["link"], is_pdf), lambda x: place(x["URL"], "pdf")), F.array().cast(f"array<{PLACE}>"))
    return F.concat(pdfs, F.when(~blank(m["URL"]), F.array(place(m["URL"], "landing"))).otherwise(F.array().cast(f"array<{PLACE}>")))


def openalex_places(answer: Column) -> Column:
    """Places in a catalogue's JSON: of the best, the primary and all other locations, PDF and landing page."""
    loc = "struct<pdf_url:string,url_for_pdf:string,landing_page_url:string,url:string,url_for_landing_page:string>"
    m = F.from_json(answer, f"is_oa boolean, open_access struct<license:string>, best_oa_location {loc}, primary_location {loc}, locations array<{loc}>")
    every = F.filter(F.concat(F.array(m["best_oa_location"], m["primary_location"]), F.coalesce(m["locations"], F.array().cast(f"array<{loc}>"))), lambda x: x.isNotNull())
    license_ = F.nullif(m["open_access"]["license"], F.lit(""))
    given = lambda *urls: F.coalesce(*[F.nullif(u, F.lit("")) for u in urls])
    place = lambda url, kind: F.struct(F.trim(url).alias("url"), F.lit(f"openalex_{kind}").alias("source"), F.lit(kind == "pdf").alias("is_pdf"), F.coalesce(m["is_oa"], F.lit(False)).alias("is_open"), license_.alias("license"))
    pairs = F.transform(every, lambda x: F.array(place(given(x["pdf_url"], x["url_for_pdf"]), "pdf"), place(given(x["landing_page_url"], x["url"], x["url_for_landing_page"]), "landing")))
    return F.filter(F.flatten(pairs), lambda p: ~blank(p["url"]))


def in_order(places: Column) -> Column:
    """Open PDFs first, then landing pages; PDFs that aren't open are not tried."""
    return F.concat(F.filter(places, lambda p: p["is_pdf"] & p["is_open"]), F.filter(places, lambda p: ~p["is_pdf"]))


def cascade(items: DataFrame, candidates: DataFrame, quality: Column) -> DataFrame:
    """(item_id, text, status, source, kind, license): of each item's candidate texts the first of the earliest step.

    candidates: item_id, source, place (order within a source), text, license, and status of a landing page without text. Texts of the
    first step compete by quality and bonus, the one listed first wins a tie. An aggregate, so candidates combine before they are shuffled.
    """
    step = looked_up({k: v[0] for k, v in CASCADE.items()}, F.col("source"))
    score = F.when(step == 1, F.round(quality + F.coalesce(looked_up(BONUS, F.col("source")), F.lit(0.0)), 6)).otherwise(0.0)
    found = candidates.withColumn("__order", looked_up({k: n for n, k in enumerate(CASCADE)}, F.col("source"))).withColumn("__step", step).withColumn("__score", score)
    best = F.struct(F.col("text"), F.col("source"), F.when(F.col("__step") <= 2, "arxiv").otherwise(F.col("license")).alias("license"))
    chosen = found.groupBy("item_id").agg(
        F.min_by(F.when(~blank(F.col("text")), best), F.when(~blank(F.col("text")), F.struct("__step", -F.col("__score"), "__order", "place"))).alias("best"),
        F.max(F.when((F.col("source") == "landing_page") & blank(F.col("text")), F.coalesce("status", F.lit("not_found")))).alias("landed"),
    )
    met = items.select("item_id").join(chosen, "item_id", "left")
    status = F.when(F.col("best").isNotNull(), "ok").otherwise(F.coalesce("landed", F.lit("not_found")))
    source = F.coalesce(F.col("best.source"), F.when(F.col("landed").isNotNull(), "landing_page"))
    kind = F.when(F.col("best").isNotNull(), looked_up({k: v[1] for k, v in CASCADE.items()}, F.col("best.source")))
    return met.select("item_id", F.col("best.text").alias("text"), status.alias("status"), source.alias("source"), kind.alias("kind"), F.col("best.license").alias("license"))


def write_back(items: DataFrame, results: DataFrame) -> DataFrame:
    """items with the results (by id) of fetching their texts: text fields are replaced, an image only fills a gap."""
    known = results.join(items.select("id"), "id", "left_semi")
    return merge(items, known, ["id"], {"image_url": "keep_first"})


def images_due(items: DataFrame, most: int) -> DataFrame:
    """(id, pass, url): items without an image, those with an arXiv id first, from whose HTML or landing page one may come."""
    arxiv = ~blank(F.col("arxiv_id"))
    url = F.when(arxiv, F.concat(F.lit("https://arxiv.org/html/"), F.trim("arxiv_id"))).otherwise(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url")))
    due = items.where(F.col("image_url").isNull()).select("id", F.when(arxiv, "arxiv").otherwise("landing").alias("pass"), url.alias("url"), "published_at").where("url IS NOT NULL")
    return due.orderBy("pass", F.col("published_at").desc_nulls_last(), "id").limit(most).select("id", "pass", "url")


def fetch_log(log: DataFrame, runs: DataFrame) -> DataFrame:
    """log with a row for each fetch in runs: times, status, duration in milliseconds, counts."""
    took = ((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1000).cast("long")
    status = F.when(F.col("error_message").isNotNull() | (F.coalesce("http_status", F.lit(0)) >= 400), "error").otherwise("success")
    return log.unionByName(runs.withColumn("duration_ms", took).withColumn("status", status).select(*log.columns))
