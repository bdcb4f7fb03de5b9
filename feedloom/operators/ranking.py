"""Scores of feeds and papers. All take ages from an explicit time; missing numbers count as 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_hours(created: Column, as_of: str) -> Column:
    return F.timestamp_diff("SECOND", created, F.lit(as_of).cast("timestamp_ntz")) / 3600.0


def number(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("double")


def flagged(c: str | Column) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("int"), F.lit(0)).cast("double")


def decay(hours: Column, rate: float = 0.05) -> Column:
    return F.exp(-rate * hours)


# The weights of engagement, credibility and score parts.
ENGAGEMENT = {"views": 0.10, "likes": 0.15, "comments": 0.25, "shared": 0.25, "bookmarks": 0.25}
PAPER_ENGAGEMENT = {"views": 0.10, "likes": 0.20, "comments": 0.35, "shared": 0.35}
SCHEDULED_ENGAGEMENT = {"likes": 0.4, "comments": 0.6, "shared": 0.8}


def weighted(weights: dict[str, float]) -> Column:
    return sum((F.lit(w) * number(c) for c, w in weights.items()), F.lit(0.0))


def saturating(c: str, half: float) -> Column:
    return number(c) / (number(c) + half)


def credibility(verified: str = "verified", followers: str = "followers", posts: str = "author_posts") -> Column:
    return 0.5 * flagged(verified) + 0.4 * saturating(followers, 100) + 0.1 * saturating(posts, 50)


def paper_credibility(verified: str = "verified", followers: str = "followers", posts: str = "author_posts") -> Column:
    return 0.5 * flagged(verified) + 0.3 * saturating(followers, 200) + 0.2 * saturating(posts, 100)


def shorts_score(hours: Column, match: Column, boost: Column) -> Column:
    return 0.4 * decay(hours) + 0.4 * F.log(weighted(ENGAGEMENT) + 1) / 10 + 0.1 * credibility() + 0.05 * flagged(match) + boost


def backfill_score(hours: Column, priority: Column) -> Column:
    return 0.3 * decay(hours) + 0.4 * F.log(weighted(ENGAGEMENT) + 1) / 10 + 0.2 * credibility() + 0.1 * flagged(priority)


def hashtag_score(hours: Column) -> Column:
    return 0.4 * decay(hours) + 0.4 * weighted(ENGAGEMENT) / 100 + 0.2 * (0.4 * flagged("verified") + 0.25 * 0.5 + (1 / 11) * 0.1)


def paper_time(hours: Column) -> Column:
    return F.when(hours <= 24, 1.0).otherwise(F.exp(-0.03 * hours))


def scheduled_time(hours: Column) -> Column:
    return F.when(hours <= 24, 1.0).when(hours <= 72, 0.8).otherwise(F.exp(-0.02 * hours))


def paper_score(hours: Column, context: Column, region: Column, meta: Column, followed: Column, allowed: Column) -> Column:
    return 0.25 * paper_time(hours) + 0.30 * context + 0.15 * region + 0.10 * meta + 0.10 * F.log(weighted(PAPER_ENGAGEMENT) + 1) / 15 + 0.05 * paper_credibility() + 0.03 * flagged(followed) + 0.02 * allowed


def scheduled_score(hours: Column, context: Column, region: Column, followed: Column) -> Column:
    return 0.25 * scheduled_time(hours) + 0.30 * context + 0.15 * region + 0.20 * F.least(weighted(SCHEDULED_ENGAGEMENT) / 100, F.lit(1.0)) + 0.10 * flagged(followed)
