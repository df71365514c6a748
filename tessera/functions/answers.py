"""What is done with a language model's answers: cleaning, cutting, checking, reading JSON out of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_CONTEXT = "INSUFFICIENT_CONTEXT"
UPDATE_TYPES = ("new_findings", "regulatory", "replication", "application", "controversy", "follow_up", "not_meaningful")
FLAG_TYPES = ("overstatement", "unsupported", "misattribution", "speculation", "hype")
CRITICAL = ("unsupported", "overstatement")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def unquoted(text: Column) -> Column:
    """Stripped, without one pair of double and then one pair of single quotes around it."""
    out = stripped(text)
    for quote in ('"', "'"):
        out = F.when(out.startswith(quote) & out.endswith(quote), stripped(F.substring(out, F.lit(2), F.greatest(F.char_length(out) - 2, F.lit(0))))).otherwise(out)
    return out


def no_context(text: Column) -> Column:
    return F.upper(text).contains(NO_CONTEXT)


def cut_at_sentence(text: Column, longest: int) -> Column:
    """The text, or its first ``longest`` characters up to the last sentence end beyond their middle, or those and three dots."""
    head = F.left(text, F.lit(longest))
    ends = F.regexp_extract(head, r"(?s)^(.*[.?!])", 1)
    return F.when(F.char_length(text) <= longest, text).when(F.char_length(ends) - 1 > longest // 2, ends).otherwise(F.concat(F.regexp_replace(head, r"\s+$", ""), F.lit("...")))


def new_digits(source: Column, derived: Column) -> Column:
    """Whether the derived text has a digit that the source lacks."""
    digits = lambda t: F.array_distinct(F.split(F.regexp_replace(t, "[^0-9]", ""), ""))
    return F.size(F.array_remove(F.array_except(digits(derived), digits(source)), "")) > 0


def json_inside(text: Column) -> Column:
    """The JSON of an answer that may stand in a fenced block."""
    marked, plain = F.regexp_extract(text, r"(?s)```json(.+?)```", 1), F.regexp_extract(text, r"(?s)```(.+?)```", 1)
    return stripped(F.when(text.contains("```json"), F.when(marked != "", marked).otherwise(text)).when(plain != "", plain).otherwise(text))


def json_object(text: Column, schema: str) -> Column:
    """The object in an answer, null where there is none."""
    body = json_inside(text)
    return F.when(body.startswith("{"), F.from_json(body, schema))


def number(text: Column, default: float = 0.0) -> Column:
    """A JSON value (as text) as a number: true is 1, false 0, text that is no number the default."""
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(F.coalesce(text.try_cast("double"), F.lit(default)))


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def intuition_confidence(long: Column, short: Column, long_new: Column, short_new: Column) -> Column:
    """Of the longer (100 to 150 words) and the shorter explanation (60 to 100), each at most 250, and whether they bring new digits."""
    a, b, off = n_words(long), n_words(short), lambda x: F.when(x, 0.1).otherwise(0.0)
    score = 0.75 + F.when(a.between(100, 150), 0.1).when((a > 250) | (a < 50), -0.1).otherwise(0.0) + F.when(b.between(60, 100), 0.1).when((b > 250) | (b < 30), -0.1).otherwise(0.0)
    return clamp(score - off(long_new) - off(short_new))


def deep_dive_confidence(markdown: Column, sources: Column) -> Column:
    """From the length of an analysis, the sections that it shows and its number of sources; 0 for none."""
    low, n = F.lower(markdown), n_words(markdown)
    shown = sum((low.contains(s).cast("int") for s in ("##", "overview", "method", "result", "limitation")), F.lit(0))
    score = 0.7 + F.when(n < 100, -0.1).when(n > 300, 0.1).otherwise(0.0) + 0.05 * F.least(shown, F.lit(4)) + F.when(sources >= 3, 0.1).when(sources == 1, -0.05).otherwise(0.0)
    return F.when(markdown.isNull(), 0.0).otherwise(clamp(score))


def news_confidence(summary: Column, source: Column) -> Column:
    n = n_words(summary)
    return clamp(0.70 + F.when(n.between(30, 60), 0.1).when((n > 100) | (n < 15), -0.15).otherwise(0.0) - F.when(new_digits(source, summary), 0.15).otherwise(0.0))


def update_found(answer: Column) -> Column:
    """struct<meaningful, update_type, summary, changes, confidence> of an answer, null where it holds no object."""
    o = json_object(answer, "meaningful boolean, update_type string, summary string, changes string, confidence double")
    kind = F.when(o["update_type"].isin(*UPDATE_TYPES), o["update_type"]).otherwise("follow_up")
    listed = F.from_json(o["changes"], "array<string>")
    changes = F.when(o["changes"].startswith("["), listed).when(o["changes"].isNull() | o["changes"].startswith("{"), F.array().cast("array<string>")).otherwise(F.array(o["changes"]))
    yes = F.struct(F.lit(True).alias("meaningful"), kind.alias("update_type"), F.coalesce(o["summary"], F.lit("")).alias("summary"), changes.alias("changes"), F.coalesce(o["confidence"], F.lit(0.7)).alias("confidence"))
    no = F.struct(F.lit(False).alias("meaningful"), F.lit("not_meaningful").alias("update_type"), F.lit("").alias("summary"), F.array().cast("array<string>").alias("changes"), F.lit(0.0).alias("confidence"))
    return F.when(o.isNotNull(), F.when(F.coalesce(o["meaningful"], F.lit(False)), yes).otherwise(no))


def citations_checked(answer: Column) -> Column:
    """struct<validated, confidence, flags> of an answer; an unsupported or overstated claim vetoes ``validated``."""
    o = json_object(answer, "validated boolean, overall_confidence double, flags array<struct<type:string,claim:string,issue:string>>")
    whole = F.filter(F.coalesce(o["flags"], F.array().cast("array<struct<type:string,claim:string,issue:string>>")), lambda f: (F.coalesce(f["claim"], F.lit("")) != "") & (F.coalesce(f["issue"], F.lit("")) != ""))
    flags = F.transform(whole, lambda f: F.when(f["type"].isin(*FLAG_TYPES), f["type"]).otherwise("unsupported"))
    validated = F.coalesce(o["validated"], F.lit(False)) & ~F.exists(flags, lambda f: f.isin(*CRITICAL))
    return F.when(o.isNotNull(), F.struct(validated.alias("validated"), F.coalesce(o["overall_confidence"], F.lit(0.5)).alias("confidence"), flags.alias("flags")))
