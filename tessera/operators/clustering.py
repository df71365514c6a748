"""Greedy clustering of items: in order of time each joins the best cluster so far, or founds one.

Items that could ever meet are those whose titles are linked by containment of tokens or by a shared
identifier; such groups don't affect one another. They are found by joins, and the ordered loop
runs over each group alone. Titles are read whole. An item links only to earlier items of its time window that
hold all its tokens, and, where these are no more than ``candidates``, so that the loop leaves none out, only to
those that can reach ``attach``; the loop's decisions are the same as over all items at once.

Where more clusters hold an item's tokens than ``candidates``, the best ranked are scored: by how near their titles hold the tokens together,
then the newest. Each decision comes with the parts of the best score and the clusters that were scored.
"""

from __future__ import annotations

import heapq
import json
import math
import uuid
from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import english, text
from tessera.session import checkpoint_folder
from tessera.sources import folders



@dataclass(frozen=True)
class Settings:
    """What decides whether an item joins a cluster. The defaults are fixed values."""

    window_days: int = 14
    candidates: int = 200
    attach: float = 0.72
    least_overlap: int = 2
    least_jaccard: float = 0.42
    single_token_guard: bool = True
    by_jaccard: float = 0.65
    by_time: float = 0.25
    by_overlap: float = 0.10
    new_source: float = 0.04
    decay_days: int = 7
    stopwords: tuple[str, ...] = tuple(text.STOPWORDS)
    short_tokens: tuple[str, ...] = tuple(text.SHORT_TOKENS)
    shortest: int = 3

    @property
    def fewest(self) -> int:
        """The least number of tokens that an item shares with a cluster it joins."""
        return max(self.least_overlap, 2 if self.single_token_guard else 1)


#: Settings by their place in a settings file.
PLACES = {
    "window_days": ("timeWindowDays",), "candidates": ("maxCandidates",), "attach": ("thresholds", "attachScore"), "least_overlap": ("thresholds", "minTokenOverlap"), "least_jaccard": ("thresholds", "minTitleJaccard"),
    "single_token_guard": ("thresholds", "singleTokenGuard"), "by_jaccard": ("scoringWeights", "titleJaccard"), "by_time": ("scoringWeights", "timeProximity"), "by_overlap": ("scoringWeights", "tokenOverlap"),
    "new_source": ("bonuses", "newSourceBonus"), "decay_days": ("timeDecayDays",), "stopwords": ("stopwords",), "short_tokens": ("allowShortTokens",), "shortest": ("rareTokenMinLength",),
}


def settings_of(document: str) -> Settings:
    """Settings from a JSON object; what it leaves out keeps its default. A value of another type or a negative weight is an error."""
    raw, given = json.loads(document), {}
    for name, path in PLACES.items():
        value = raw
        for step in path:
            value = value.get(step) if isinstance(value, dict) else None
        if value is None:
            continue
        default = getattr(Settings, name)
        value = tuple(map(str, value)) if isinstance(default, tuple) else float(value) if type(default) is float else value
        if type(value) is not type(default) or (type(value) in (int, float) and value < 0):
            raise ValueError(f"clustering setting {'.'.join(path)} can't be {value!r}")
        given[name] = value
    return Settings(**given)


def read_settings(spark: SparkSession, path: str) -> Settings:
    """Settings from a JSON file in any storage that Spark reads."""
    return settings_of(spark.read.text(path, wholetext=True).first().value)


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the checkpoint folder, read back: plans of many rounds stay small in the driver."""
    spark = df.sparkSession
    checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/groups-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of ``kept`` that nothing reads any more."""
    folders.remove(df.sparkSession, df._kept_at)


def groups(links: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, group): the least node reachable over links (u, v).

    In each round a node, and the node its group is named by, take the least group beyond their links, then the group of that group;
    hooking whole groups onto lower ones keeps the rounds near the logarithm of the longest path.
    """
    both = kept(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = kept(nodes.select("node", F.col("node").alias("group")))
    for _ in range(rounds):
        ends = lambda c: now.select(F.col("node").alias(c), F.col("group").alias(f"group_{c}"))  # noqa: E731, B023
        beyond = both.join(ends("v"), "v").groupBy("u").agg(F.min("group_v").alias("low"))
        hooked = beyond.join(ends("u"), "u").groupBy(F.col("group_u").alias("node")).agg(F.min("low").alias("low"))
        low = beyond.select(F.col("u").alias("node"), "low").union(hooked).groupBy("node").agg(F.min("low").alias("low"))
        lower = kept(now.join(low, "node", "left").select("node", F.least("group", F.coalesce("low", "group")).alias("group")))
        jump = lower.select(F.col("node").alias("group"), F.col("group").alias("up"))
        after = kept(lower.join(jump, "group").select("node", F.col("up").alias("group")))
        settled = now.join(after.withColumnRenamed("group", "g2"), "node").where("group <> g2").isEmpty()
        dropped(lower)
        dropped(now)
        now = after
        if settled:
            dropped(both)
            return now
    raise RuntimeError(f"groups did not settle in {rounds} rounds")


def attachable(rows: DataFrame, how: Settings = Settings(), logged: bool = False) -> DataFrame:
    """(u, v): item u could attach to a cluster that v founds; where logged, also where it would only be scored. rows: item_id, at (seconds), tokens."""
    span, size = how.window_days * 86400, F.size("tokens")
    rows = rows.where(size >= how.fewest).select("item_id", "at", "tokens", size.alias("size"), F.floor(F.col("at") / span).alias("span"))
    spread = rows.select("item_id", "at", "size", "span", F.explode("tokens").alias("token"))
    rarity = spread.groupBy("token").agg(F.count("*").alias("df"))
    # items meet on the rarest token alone, in their own span of time and the one before
    probe = spread.join(rarity, "token").groupBy("item_id", "at", "size", "span").agg(F.min(F.struct("df", "token")).alias("rare"))
    probe = probe.select(F.col("item_id").alias("u"), F.col("at").alias("at_u"), F.col("size").alias("size_u"), F.col("rare.token").alias("token"), F.explode(F.array(F.col("span"), F.col("span") - 1)).alias("span"))
    pairs = probe.join(spread.select(F.col("item_id").alias("v"), F.col("at").alias("at_v"), F.col("size").alias("size_v"), "span", "token"), ["token", "span"])
    pairs = pairs.where("(at_v < at_u OR (at_v = at_u AND v < u)) AND size_v >= size_u").where(F.col("at_u") - F.col("at_v") <= span)
    met = pairs.join(rows.select(F.col("item_id").alias("u"), F.col("tokens").alias("wanted")), "u").join(rows.select(F.col("item_id").alias("v"), "tokens"), "v")
    met = met.where(F.size(F.array_except("wanted", "tokens")) == 0)
    shared = F.col("size_u") / F.col("size_v")
    most = how.by_jaccard * shared + how.by_time * F.exp((F.col("at_v") - F.col("at_u")) / 86400 / how.decay_days) + how.by_overlap * F.least(F.col("size_u") / 6, F.lit(1.0)) + how.new_source
    can = (shared >= how.least_jaccard - 1e-9) & (F.lit(logged) | (most >= how.attach - 1e-9))
    met = met.select("u", "v", can.alias("can"), F.count("*").over(Window.partitionBy("u")).alias("n"))
    return met.where(F.col("can") | (F.col("n") > how.candidates)).select("u", "v").distinct()


def listed(words: str | list[str]) -> list[str]:
    """Words that may come joined by spaces, which takes less room than a list."""
    return words.split() if isinstance(words, str) else words


PARTS = "overlap int, jaccard double, time_prox double, base_score double, new_source_bonus double, total_score double"


def standing(tokens: set[str], cluster: dict) -> tuple:
    """The rank of a cluster among those that hold all tokens: how near together its title's words hold them, then the newest."""
    if "places" not in cluster:
        places: dict[str, list[int]] = {}
        for at, w in enumerate(listed(cluster["words"]), 1):
            if w in cluster["tokens"]:
                places.setdefault(w, []).append(at)
        cluster["places"] = places
    return english.cover_density([cluster["places"][w] for w in tokens]), cluster["at"], cluster["id"]


def score(r, mine: set[str], cluster: dict, how: Settings) -> tuple | None:
    """The parts of an item's score with a cluster that holds all its tokens, total last; null where too little is shared."""
    overlap, union = len(mine), len(cluster["tokens"])
    if overlap < how.fewest or overlap / union < how.least_jaccard:
        return None
    near = math.exp(-abs(r.at - cluster["at"]) / 86400 / how.decay_days)
    base = how.by_jaccard * overlap / union + how.by_time * near + how.by_overlap * min(overlap / 6, 1.0)
    bonus = 0.0 if r.source_id in cluster["sources"] else how.new_source
    return overlap, overlap / union, near, base, bonus, base + bonus


def assign(rows: pd.DataFrame, how: Settings = Settings()) -> pd.DataFrame:
    """The ordered loop over one group. rows: item_id, at (seconds), source_id, ident, tokens, words (lists, or joined by spaces), founder (always founds a cluster).

    Clusters that have left the time window are out of the lists for good, as items come in order of time; so an item meets its window, not all before it.
    """
    rows = rows.sort_values(["at", "item_id"], kind="stable")
    named: dict[str, dict] = {}  # the newest cluster of each identifier
    holding: dict[str, deque[dict]] = {}  # clusters of the window by token, in order of founding
    window: deque[dict] = deque()
    out, founded = [], 0
    for r in rows.itertuples():
        mine, best, parts, scored = set(listed(r.tokens)), None, None, []
        while window and r.at - window[0]["at"] > how.window_days * 86400:
            gone = window.popleft()
            for w in gone["tokens"]:
                holding[w].popleft()
                if not holding[w]:
                    del holding[w]
            for text_of in ("tokens", "words", "places"):
                gone.pop(text_of, None)
        by_identifier = isinstance(r.ident, str) and not r.founder and r.ident in named
        if by_identifier:
            best = named[r.ident]
            scored = [best["id"]]
        elif not r.founder and mine:
            rarest = min((holding.get(w, ()) for w in mine), key=len)
            near = [c for c in rarest if mine <= c["tokens"] and r.at - c["at"] <= how.window_days * 86400]
            if len(near) > how.candidates:
                near = heapq.nlargest(how.candidates, near, key=lambda c: standing(mine, c))
            for c in near:
                found = score(r, mine, c, how)
                if found is None:
                    continue
                scored.append(c["id"])
                if parts is None or found[-1] > parts[-1] or (found[-1] == parts[-1] and standing(mine, c) > standing(mine, best)):
                    best, parts = c, found
            if parts is not None and parts[-1] < how.attach:
                best = None
        decision = "attached" if best else "new"
        if best is None:
            best = {"id": r.item_id, "n": founded, "tokens": mine, "words": r.words, "at": r.at, "sources": set()}
            founded += 1
            for w in mine:
                holding.setdefault(w, deque()).append(best)
            window.append(best)
        best["sources"].add(r.source_id)
        if isinstance(r.ident, str) and (r.ident not in named or named[r.ident]["n"] < best["n"]):
            named[r.ident] = best
        out.append((r.item_id, best["id"], decision, by_identifier, *(parts or (None,) * 6), sorted(scored)))
    names = ["item_id", "cluster_id", "decision", "by_identifier", *[p.split()[0] for p in PARTS.split(", ")], "scored"]
    return pd.DataFrame(out, columns=names).astype({"overlap": "Int32"})


def cluster(items: DataFrame, how: Settings = Settings(), logged: bool = False) -> DataFrame:
    """(item_id, cluster_id, decision): items (item_id, at timestamp, source_id, title, ident) in clusters named by their founder.

    Where logged, also by_identifier, PARTS of the best score, be it too low (null where none was scored), and scored, the clusters that were scored;
    then items that were only scored together share a group, so groups are larger. The decisions are the same.
    Items with a true ``founder``, if there is such a column, stand for clusters that exist and join none.
    """
    founder = F.coalesce("founder", F.lit(False)) if "founder" in items.columns else F.lit(False)
    rows = items.select("item_id", F.unix_timestamp(F.col("at").cast("timestamp")).cast("double").alias("at"), "source_id", "ident", text.title_tokens(F.col("title"), how.stopwords, how.short_tokens, how.shortest).alias("tokens"), text.title_words(F.col("title")).alias("words"), founder.alias("founder"))
    links = attachable(rows, how, logged)
    # a star to the first item of each identifier
    first = rows.where("ident IS NOT NULL").groupBy("ident").agg(F.min("item_id").alias("v"))
    links = links.union(rows.join(first, "ident").where("item_id <> v").select(F.col("item_id").alias("u"), "v"))
    links = kept(links)
    nodes = links.select(F.col("u").alias("node")).union(links.select("v")).distinct()
    of = groups(links, nodes).withColumnRenamed("node", "item_id")
    dropped(links)
    kind = dict(rows.dtypes)["item_id"]
    schema = f"item_id {kind}, cluster_id {kind}, decision string, by_identifier boolean, {PARTS}, scored array<{kind}>"
    joined = {c: F.coalesce(F.array_join(c, " "), F.lit("")) for c in ("tokens", "words")}
    found = rows.join(of, "item_id").withColumns(joined).groupBy("group").applyInPandas(lambda p: assign(p, how), schema)
    # items without links found a cluster each
    blank = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in PARTS.split(", ")}
    alone = rows.where("item_id IS NOT NULL").join(of, "item_id", "left_anti").select("item_id", F.col("item_id").alias("cluster_id"), F.lit("new").alias("decision"), F.lit(False).alias("by_identifier"), *[v.alias(c) for c, v in blank.items()], F.array().cast(f"array<{kind}>").alias("scored"))
    found = found.union(alone)
    return found if logged else found.select("item_id", "cluster_id", "decision")


def assignment_log(found: DataFrame, how: Settings = Settings()) -> DataFrame:
    """A log row for each logged decision of ``cluster`` or ``assign_to_stories``: candidates and the parts of the score as JSON, and the threshold where a score decided."""
    parts = F.to_json(F.struct(*[p.split()[0] for p in PARTS.split(", ")]))
    return found.select(
        "item_id", F.col("cluster_id").alias("decided_cluster_id"), F.when(F.col("decision") == "attached", "attached_existing").otherwise("created_new").alias("decision"), F.to_json("scored").alias("candidate_cluster_ids"),
        F.when(F.col("by_identifier"), F.lit('{"external_id_match":true}')).otherwise(parts).alias("score_breakdown"), F.when(~F.col("by_identifier"), F.lit(how.attach)).alias("threshold_used"),
    )


def candidates_by_identifier(asked: DataFrame, items: DataFrame, members: DataFrame, clusters: DataFrame, most: int = 10) -> DataFrame:
    """(item_id, cluster_id, rn): open clusters with an item of the same arXiv id or DOI as each asked one, newest first.

    Two joins on one identifier each, so neither is a join on "either". An identifier gives an item its newest ``most`` clusters at the most,
    so items meet those alone.
    """
    open_ = clusters.where(F.col("status").isin("active", "pending")).select(F.col("id").alias("cluster_id"), "updated_at")
    held = items.select(F.col("id").alias("m"), "arxiv_id", "doi").join(members.select(F.col("item_id").alias("m"), "cluster_id"), "m").join(open_, "cluster_id")
    newest = [F.col("updated_at").desc(), F.col("cluster_id")]
    pairs = None
    for c in ("arxiv_id", "doi"):
        listed = held.where(F.col(c).isNotNull()).select(c, "cluster_id", "updated_at").distinct()
        first = listed.withColumn("place", F.row_number().over(Window.partitionBy(c).orderBy(*newest))).where(F.col("place") <= most)
        one = asked.where(F.col(c).isNotNull()).select(F.col("id").alias("item_id"), c).join(first, c).select("item_id", "cluster_id", "updated_at")
        pairs = one if pairs is None else pairs.union(one)
    ranked = pairs.distinct().withColumn("rn", F.row_number().over(Window.partitionBy("item_id").orderBy(*newest)))
    return ranked.where(F.col("rn") <= most).select("item_id", "cluster_id", "rn")


def assign_to_stories(clusters: DataFrame, members: DataFrame, items: DataFrame, how: Settings = Settings(), logged: bool = False) -> DataFrame:
    """What ``cluster`` tells of items that no cluster holds: to open clusters (id, canonical_title, updated_at, status), else to new ones.

    A cluster stands by its title, its last update and the newest identifier and source of its items. New clusters are named "n" and their founder's id.
    """
    known = members.select("cluster_id", "item_id").join(items.select(F.col("id").alias("item_id"), "arxiv_id", "source_id"), "item_id").groupBy("cluster_id").agg(F.max("arxiv_id").alias("ident"), F.max("source_id").alias("source_id"))
    open_ = clusters.where(F.col("status").isin("active", "pending")).join(known, clusters.id == known.cluster_id, "left")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    founders = open_.select(name("c", "id").alias("item_id"), F.col("updated_at").cast("timestamp").alias("at"), F.col("source_id").cast("string").alias("source_id"), F.col("canonical_title").alias("title"), "ident", F.lit(True).alias("founder"))
    free = items.join(members.select(F.col("item_id").alias("id")).distinct(), "id", "left_anti")
    fresh = free.select(name("i", "id").alias("item_id"), F.coalesce("published_at", "fetched_at").cast("timestamp").alias("at"), F.col("source_id").cast("string").alias("source_id"), "title", F.col("arxiv_id").alias("ident"), F.lit(False).alias("founder"))
    found = cluster(founders.union(fresh), how, logged).where(F.startswith("item_id", F.lit("i")))
    own = lambda c: F.when(F.startswith(c, F.lit("c")), F.substring(c, 2, 1000)).otherwise(F.concat(F.lit("n"), F.substring(c, 2, 1000)))
    named = {"item_id": F.substring("item_id", 2, 1000), "cluster_id": own(F.col("cluster_id"))}
    return found.withColumns(named | ({"scored": F.transform("scored", own)} if logged else {}))
