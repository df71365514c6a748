"""Scores of clusters, items and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cue words and constants of the impact model. Fixed values.
NOVELTY_CUES = ("first", "new", "novel", "sota", "state-of-the-art", "unprecedented")
TRANSLATION_CUES = ("adoption", "clinical", "cost", "deployment", "industry", "outcome", "patient", "policy", "real-world", "scale")
STRONG_CUES = ("approved", "clinical trial", "deployed", "deployed at scale", "fda", "policy change", "production", "real-world")
HEDGE_CUES = ("could", "may", "might", "possibly", "potentially", "preliminary")
RISK_FLAGS = ("preprint_not_peer_reviewed", "press_release_only")
HYPE_WORDS = ("breakthrough", "cure", "game-changing", "miracle", "revolutionary")
CONFIDENCE_MIN, EVIDENCE_MIN = 0.75, 0.35
ABSOLUTE_BAR, ESCAPE_EPSILON, SET_SIZE = 0.97, 0.015, 2


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))).cast("double")


def recency(age_s: Column, scale_s: float = 86400.0) -> Column:
    return F.exp(-age_s / scale_s)


def trending(v6: Column, v24: Column, sources: Column, decay: Column) -> Column:
    return (v6 + 0.5 * v24 + F.least(sources, F.lit(10)) * 0.3) * decay


def impact(base: Column, v6: Column, v24: Column, sources: Column, age_s: Column) -> Column:
    """Model score lifted by velocity and faded over five days."""
    pace = 0.55 * F.log1p(v6) / F.log(F.lit(6.0)) + 0.30 * F.log1p(v24) / F.log(F.lit(12.0)) + 0.15 * (F.least(sources, F.lit(10)) / 10.0)
    return clamp((0.82 * F.coalesce(base, F.lit(0.0)) + 0.18 * F.least(F.lit(1.0), pace)) * (0.90 + 0.10 * recency(age_s, 432000.0)))


def representative(content_type: Column, tier: Column, title: Column) -> Column:
    kinds = F.when(content_type == "peer_reviewed", 2.0).when(content_type == "preprint", 1.5).when(content_type == "report", 1.0).when(content_type == "press_release", 0.5).otherwise(0.0)
    tiers = F.when(tier == "tier1", 1.0).when(tier == "tier2", 0.5).otherwise(0.0)
    shout = (title == F.upper(title)) & (title != F.lower(title))
    return kinds + tiers + F.when(F.length(title).between(30, 160), 1.0).otherwise(0.0) - F.when(shout, 1.0).otherwise(0.0)


def hits(text: Column, cues: tuple[str, ...]) -> Column:
    """How many cues a text contains, as substrings."""
    total = F.lit(0)
    for cue in cues:
        total = total + F.contains(text, F.lit(cue)).cast("int")
    return total


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda x: x != "")


def has(text: Column, *cues: str) -> Column:
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(text, F.lit(cue))
    return found


def novelty(title: Column, takeaway: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, takeaway))
    all_words = words(text)
    ratio = F.when(F.size(all_words) > 0, F.size(F.array_distinct(all_words)) / F.size(all_words)).otherwise(0.0)
    score = 0.44 + F.least(F.lit(0.24), 0.06 * hits(text, NOVELTY_CUES)) + clamp((ratio - 0.52) * 0.25, -0.04, 0.10)
    for bonus, found in ((0.05, has(F.lower(title), "first", "novel")), (-0.12, has(text, "review", "survey")), (-0.08, has(text, "incremental", "extension")), (-0.05, has(text, "replication"))):
        score = score + F.when(found, bonus).otherwise(0.0)
    return clamp(score)


def translation(takeaway: Column) -> Column:
    text = F.lower(takeaway)
    number = F.exists(words(text), lambda w: w.rlike("^[0-9]+$"))
    score = 0.34 + F.least(F.lit(0.24), hits(text, TRANSLATION_CUES) * 0.04) + F.least(F.lit(0.26), hits(text, STRONG_CUES) * 0.10)
    score = score + F.when(number, 0.05).otherwise(0.0) + F.when(has(text, "patient", "clinical", "policy"), 0.06).otherwise(0.0)
    return clamp(score - F.least(F.lit(0.10), hits(text, HEDGE_CUES) * 0.03))


def evidence(types: Column, flags: Column, sources: Column, full_text: Column) -> Column:
    kind = F.when(F.array_contains(types, "peer_reviewed"), 0.30).when(F.array_contains(types, "preprint"), 0.18).when(F.array_contains(types, "report"), 0.12).otherwise(0.0)
    score = 0.30 + kind + F.when(full_text, 0.14).otherwise(0.0) + F.least(F.lit(0.16), F.log1p(F.greatest(sources, F.lit(0))) * 0.08)
    score = score - F.when(F.arrays_overlap(flags, F.array(*map(F.lit, RISK_FLAGS))), 0.05).otherwise(0.0)
    return clamp(score - F.when(F.array_contains(flags, "press_release_only"), 0.22).otherwise(0.0))


def high_impact(nov: Column, tra: Column, evi: Column) -> Column:
    return clamp(0.45 * nov + 0.40 * tra + 0.15 * evi)


def confidence(sources: Column, full_text: Column) -> Column:
    return clamp(0.62 + F.least(F.lit(0.12), sources * 0.03) + F.when(full_text, 0.12).otherwise(0.0))


def reasons(nov: Column, tra: Column, evi: Column, types: Column, sources: Column) -> Column:
    return F.array_compact(
        F.array(
            F.when(nov >= 0.70, "high_novelty_vs_topic"), F.when(tra >= 0.70, "high_translation_scope"), F.when(F.array_contains(types, "peer_reviewed"), "peer_reviewed_support"),
            F.when(sources >= 3, "multi_source_independent_support"), F.when(evi >= EVIDENCE_MIN, "evidence_gate_passed"),
        )
    )


def absolute_high(score: Column, conf: Column, evi: Column) -> Column:
    return F.coalesce((score >= ABSOLUTE_BAR) & (conf >= CONFIDENCE_MIN) & (evi >= EVIDENCE_MIN), F.lit(False))


def passes_gates(score: Column, conf: Column, evi: Column, threshold: Column, qualified: Column) -> Column:
    high = score >= ABSOLUTE_BAR
    wins = (score >= threshold) | (high & (score >= threshold - ESCAPE_EPSILON)) | ((qualified >= SET_SIZE) & high)
    return F.coalesce((conf >= CONFIDENCE_MIN) & (evi >= EVIDENCE_MIN) & wins, F.lit(False))


def anti_hype_flags(types: Column, sources: Column) -> Column:
    """Warnings that follow from the kinds of evidence a cluster has and from how many sources."""
    of = lambda kind: F.array_contains(types, kind)
    no_paper = ~of("peer_reviewed")
    return F.array_compact(
        F.array(F.when(of("preprint") & no_paper, "preprint_not_peer_reviewed"), F.when(of("press_release") & ~of("preprint") & no_paper, "press_release_only"), F.when(sources == 1, "single_source"))
    )


def method_badges(types: Column) -> Column:
    research = F.array_contains(types, "peer_reviewed") | F.array_contains(types, "preprint")
    return F.array_compact(F.array(F.when(research, "observational"), F.when(F.array_contains(types, "report"), "benchmark")))


def takeaway_confidence(takeaway: Column, n_items: Column, longest: int = 280) -> Column:
    size = F.length(takeaway)
    score = 0.8 - F.when(size < 50, 0.15).when(size < 100, 0.05).when(size > longest, 0.1).otherwise(0.0) + F.when(n_items >= 3, 0.1).when(n_items == 1, -0.1).otherwise(0.0)
    return clamp(score - F.when(has(F.lower(takeaway), *HYPE_WORDS), 0.1).otherwise(0.0))


def blend(deterministic: Column, model: Column, own: float = 0.4, other: float = 0.6) -> Column:
    """Weighted mean of two scores; the first alone where the second is null."""
    return clamp(F.when(model.isNull(), deterministic).otherwise((deterministic * own + model * other) / (own + other)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, 0 where a norm is 0; unequal lengths give null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm))


def time_proximity(a: Column, b: Column, decay_days: float = 7.0) -> Column:
    return F.exp(-F.abs(seconds_between(a, b)) / 86400.0 / decay_days)


def candidate(jac: Column, overlap: Column, proximity: Column, has_source: Column) -> Column:
    """Score of a cluster for an item; null where a gate fails."""
    score = 0.65 * jac + 0.25 * proximity + 0.10 * F.least(overlap / 6.0, F.lit(1.0)) + F.when(has_source, 0.0).otherwise(0.04)
    return F.when((overlap >= 2) & (jac >= 0.42), score)
