"""Small readings of payloads: feed entries' links and images, lists as JSON or array text, explainers, keys."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import squeeze

LINK = "struct<href:string,rel:string,type:string>"
MEDIA = "struct<url:string,medium:string,type:string>"
MOST = 120_000


def given(text: Column) -> Column:
    """Trimmed, null where empty."""
    return F.nullif(F.trim(text), F.lit(""))


def first_of(rows: Column, wanted, value) -> Column:
    """The first given value of the wanted rows."""
    kept = F.filter(F.transform(F.filter(rows, wanted), value), lambda x: F.coalesce(F.trim(x), F.lit("")) != "")
    return F.trim(F.get(kept, 0))


def entry_url(link: Column, links: Column) -> Column:
    """An entry's link, else the first of its links (array of LINK) that is alternate or has no relation."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    return F.coalesce(given(link), first_of(links, lambda x: low(x["rel"]).isin("alternate", ""), lambda x: x["href"]))


def entry_image(media: Column, thumbnails: Column, links: Column, image: Column) -> Column:
    """An entry's image: media content that is one, the first thumbnail, an enclosure of an image type, its image field."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    content = first_of(media, lambda x: low(x["medium"]).isin("image", "") | low(x["type"]).startswith("image/"), lambda x: x["url"])
    enclosed = first_of(links, lambda x: (low(x["rel"]) == "enclosure") & low(x["type"]).startswith("image/"), lambda x: x["href"])
    return F.coalesce(content, given(F.get(thumbnails, 0)["url"]), enclosed, given(image))


def mail_key(address: Column) -> Column:
    return F.lower(F.trim(address))


def cache_key(query: Column, prefix: str = "search") -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.sha2(F.lower(F.trim(query)), 256))


def weak_etag(value: Column) -> Column:
    return F.concat(F.lit('W/"'), value, F.lit('"'))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda s: html.unescape(s) if s and "&" in s else s)


def clean(text: Column, most: int = MOST) -> Column:
    """Entities read, tags and NUL dropped, spaces collapsed; null where nothing is left."""
    return F.nullif(F.left(squeeze(F.regexp_replace(F.regexp_replace(unescaped(text), "\\x00", " "), "<[^>]+>", " ")), F.lit(most)), F.lit(""))


@F.pandas_udf(StringType())
def archived_tex(content: pd.Series) -> pd.Series:
    """The longest TeX file of a source archive (tar, gzipped or not) or a gzipped single file; null where there is none."""
    return content.map(_longest_tex)


def _longest_tex(content: bytes | None) -> str | None:
    import gzip
    import io
    import tarfile

    if not content:
        return None
    try:
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            found = [archive.extractfile(m).read() for m in archive.getmembers() if m.isfile() and m.name.lower().endswith(".tex")]
    except tarfile.TarError:
        try:
            found = [gzip.decompress(content)]
        except OSError:
            found = []
    return max(found, key=len).decode("utf-8", "replace") if found else None


def json_list(value: Column) -> Column:
    """The strings of a JSON array; empty for null, other JSON and what is no JSON."""
    return F.coalesce(F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def array_text(value: Column) -> Column:
    """The members of an array written as {a,"b c"}; empty for null and {}."""
    inside = F.regexp_extract(F.trim(value), r"^\{(.*)\}$", 1)
    parts = F.regexp_extract_all(inside, F.lit(r'("(?:[^"\\]|\\.)*"|[^,]+)'), F.lit(1))
    bare = lambda x: F.when(x.startswith('"'), F.regexp_replace(F.regexp_replace(x, '^"|"$', ""), r"\\(.)", "$1")).otherwise(F.trim(x))
    return F.coalesce(F.filter(F.transform(parts, bare), lambda x: x != "NULL"), F.array().cast("array<string>"))


def merged_explainers(stored: Column, markdown: Column, sources: Column, long: Column, short: Column) -> Column:
    """struct<markdown, generated_at, source_count, eli20, eli5>: what is stored (JSON or text) with a new text, and explanations where given."""
    old = F.when(F.trim(stored).startswith("{"), F.from_json(stored, "generated_at string, source_count int, eli20 string, eli5 string"))
    kept = lambda new, name: F.coalesce(F.nullif(new, F.lit("")), old[name]).alias(name)
    count = F.coalesce(F.nullif(old["source_count"], F.lit(0)), sources)
    return F.struct(markdown.alias("markdown"), F.coalesce(old["generated_at"], F.lit("")).alias("generated_at"), count.alias("source_count"), kept(long, "eli20"), kept(short, "eli5"))
