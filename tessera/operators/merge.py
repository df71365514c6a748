"""Idempotent changes of tables: one merge with a policy for each column, and its special cases.

Plain Parquet has no MERGE INTO, so an operator returns the new version of a table and a writer swaps it in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Policy = str | Callable[[Column, Column], Column]


def last_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an order, as when later duplicates of a batch win."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def merge(target: DataFrame, source: DataFrame, keys: list[str], policy: dict[str, Policy] | None = None) -> DataFrame:
    """target with source upserted on keys.

    Where both have a key, each column follows its policy: "overwrite" (default), "keep_first" (the target's value
    unless it is null), "overwrite_if_given" (the source's value unless it is null), "keep" (the target's), or
    a function of (target, source), which may look at other columns of both as t.x and s.x. Keys of source are unique.
    """
    policy = policy or {}
    names = target.columns
    t = target.select(F.struct(*names).alias("t"), *[F.col(k).alias(f"__{k}") for k in keys])
    s = source.select(F.struct(*[c for c in names if c in source.columns]).alias("s"), *[F.col(k).alias(f"__{k}") for k in keys])
    both = t.join(s, [f"__{k}" for k in keys], "full")
    out = []
    for c in names:
        if c in keys:
            out.append(F.col(f"__{c}").alias(c))
            continue
        if c not in source.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        old, new, how = F.col(f"t.{c}"), F.col(f"s.{c}"), policy.get(c, "overwrite")
        met = {"overwrite": new, "keep": old, "keep_first": F.coalesce(old, new), "overwrite_if_given": F.coalesce(new, old)}[how] if isinstance(how, str) else how(old, new)
        out.append(F.when(F.col("s").isNull(), old).when(F.col("t").isNull(), new).otherwise(met).alias(c))
    return both.select(*out)


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target and those rows of source whose key it lacks, one for each key."""
    fresh = source.dropDuplicates(keys).join(target, keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def delete(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone, keys, "left_anti")


def patch(target: DataFrame, where: Column, values: dict[str, object], clears: dict[str, list[str]] | None = None) -> DataFrame:
    """target with only the given columns changed in rows that match; setting one to None also clears those it names."""
    todo = dict(values)
    for c, more in (clears or {}).items():
        if c in values and values[c] is None:
            todo |= dict.fromkeys(more)
    types = dict(target.dtypes)
    return target.withColumns({c: F.when(where, F.lit(v).cast(types[c])).otherwise(F.col(c)) for c, v in todo.items()})


#: How a feed item that is seen again changes the stored one. An item stays with the source that showed it first; texts are fetched elsewhere.
ITEM_POLICY: dict[str, Policy] = {
    "url": "overwrite", "canonical_url": "overwrite", "title": "overwrite", "title_hash": "overwrite", "content_type": "overwrite", "fetched_at": "overwrite",
    "published_at": "keep_first", "author": "keep_first", "snippet": "keep_first", "arxiv_id": "keep_first", "doi": "keep_first", "image_url": "keep_first", "source_id": "keep", "full_text": "keep",
}
ITEM_ORDER = ("fetched_at", "source_id", "title")


def item_policy(columns: list[str]) -> dict[str, Policy]:
    """ITEM_POLICY, and the status of an item's text: "ok" where one is stored, else what is known of it, else "pending"."""
    has_text = F.trim(F.coalesce("t.full_text", F.lit(""))) != "" if "full_text" in columns else F.lit(False)
    return ITEM_POLICY | {"full_text_status": lambda old, new: F.when(has_text, "ok").otherwise(F.coalesce(old, new, F.lit("pending")))}


def upsert_items(items: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Feed items by key: the batch's last row of a key wins, then columns follow ``item_policy``."""
    return merge(items, last_per_key(batch, [key], [F.col(c).desc() for c in ITEM_ORDER]), [key], item_policy(items.columns))
