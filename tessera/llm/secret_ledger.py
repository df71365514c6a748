"""Secret scans by an incremental blob ledger.

Every version of every text ever held at a path is content-addressed by its SHA-256. The ledger, a
table in the shared folder, has for each blob the rule versions that it was scanned with and what they
found. An update scans only the pairs of blob and rule version that the ledger lacks, each blob
once however many paths and versions hold it, and appends; findings are then joined back to
all paths. Raising a rule's version has that rule alone scanned again.

All of it is DataFrame functions. Where matches lie follows from the pieces between them:
``split`` and ``regexp_extract_all`` of one pattern alternate, and character lengths add up to code
points. What is due is found from digests alone. Where nothing is, no text is read again; up to BROADCAST_DUE blobs are broadcast, so that
texts are scanned where they lie; beyond that a text is fetched by (blob, one path that has it), keys that spread over partitions
although one blob may hold a third of all rows.

Defined results: a null text is the empty blob; repeated rows are each returned; rows with
null ids are returned; an empty table gives an empty table and an empty ledger; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop_written, written

BROADCAST_DUE = 1_000
LEDGER = "blob string, scanned array<string>, found array<struct<kind:string,start:int,end:int>>"


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    needs: str = ""  # a text without it has no match
    group: int = 0  # the group whose length counts
    least: int = 0  # fewer characters: the match is dropped

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    # runs are matched whole or not at all, so a least length in the pattern drops the same ones
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("forge_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", needs="gh"),
    Rule("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", needs="xox"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}", needs="eyJ"),
    Rule("maps_key", 1, r"AIza[0-9A-Za-z_-]{35}", needs="AIza"),
)
RULES = BASE + MORE


def found_by(text: Column, rule: Rule) -> Column:
    """array<struct<kind, start, end>> of a rule's matches, leftmost and non-overlapping, in code points."""
    pattern = F.lit(rule.pattern)
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    pieces = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), counted.alias("part"))
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        lo = acc["at"] + F.char_length(x["0"])
        hi = lo + F.char_length(x["1"])
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), lo.alias("start"), hi.alias("end")))
        return F.struct(hi.alias("at"), F.when(F.char_length(x["2"]) >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    pieces = F.transform(pieces, lambda x: F.struct(x["gap"].alias("0"), x["hit"].alias("1"), x["part"].alias("2")))
    spans = F.aggregate(pieces, start, step, lambda acc: acc["out"])
    there = text.contains(rule.needs) if rule.needs else F.lit(True)
    return F.when(there & text.rlike(rule.pattern), spans).otherwise(nothing)


def ledger_there(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at path; empty where there is none yet."""
    return spark.read.schema(LEDGER).parquet(path) if ledger_there(spark, path) else spark.createDataFrame([], LEDGER)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger at that path lacks of all versions, and append it."""
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = versions.select(F.xxhash64(F.col(path_col)).alias("path"), blob(F.col(text_col)).alias("blob"))
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    first = rows.groupBy("blob").agg(F.min("path").alias("path"))
    due = first.join(seen, "blob", "left").select("blob", "path", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("due")).where(F.size("due") > 0)
    due = written(due.select(F.col("blob").alias("b"), F.col("path").alias("p"), "due"), "due")
    n = due.count()
    if n:
        texts = versions.select(F.xxhash64(F.col(path_col)).alias("path"), blob(F.col(text_col)).alias("blob"), text.alias("text"))
        met = texts.join(F.broadcast(due) if n <= BROADCAST_DUE else due, (texts.path == due.p) & (texts.blob == due.b))
        scan(met, rules).write.mode("append").parquet(ledger)
    elif not ledger_there(spark, ledger):
        spark.createDataFrame([], LEDGER).write.parquet(ledger)
    drop_written(due)


def scan(met: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows of the ledger for texts (blob, text, due)."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    found = F.concat(*[F.when(F.array_contains("due", r.key), found_by(F.col("text"), r)).otherwise(none) for r in rules])
    scanned = met.select("blob", F.col("due").alias("scanned"), found.alias("found"))
    # rows that repeat both path and text met the same pair; the ledger gets one of them
    return scanned.dropDuplicates(["blob"])


def findings(versions: DataFrame, ledger: str, path_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, blob, found) for each row of versions: spans of the given rule versions, by start, then kind as listed."""
    spark = versions.sparkSession
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    keys = F.array(*[F.lit(r.key) for r in rules])
    rows = read_ledger(spark, ledger).where(F.size("found") > 0)
    # of a kind scanned in several versions, the spans of the version asked for count
    rows = rows.select("blob", F.filter("found", lambda x: F.exists("scanned", lambda s: (F.substring_index(s, "@", 1) == x["kind"]) & F.array_contains(keys, s))).alias("found"))
    spans = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    order = F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.array_position(kinds, x["kind"]).alias("n"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = spans.select("blob", F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("found"))
    asked = versions.select(F.col(path_col).alias("doc_id"), blob(F.col(text_col)).alias("blob"))
    nothing = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return asked.join(spans, "blob", "left").select("doc_id", "blob", F.coalesce("found", nothing).alias("found"))


def joined(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
