"""Text: tags, mentions, keywords, cities, fuzzy match, names, numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks words, and what that scores; words that are no keywords.
MARKED = (("hashtags", "#", 100), ("mentions", "@", 80))
STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")


def tags(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("#([a-zA-Z0-9_]+)"), F.lit(1))


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("@([a-zA-Z0-9_]+)"), F.lit(1))


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-case words of letters and digits, of at least so many characters, without stopwords."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) >= least) & ~w.isin(*STOPWORDS))


def description_keywords(text: Column) -> Column:
    """Words of a description longer than three characters, repeats kept."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\s,]+"), lambda w: F.length(w) > 3)


def keyword_matrix(texts: DataFrame, text_col: str, least: int = 3) -> DataFrame:
    """(bucket, score, word): ten points for every use of a keyword, by which it has its bucket; hashtags and mentions once each, with fixed scores."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    said = lambda words, kind: F.transform(words, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("word")))
    marked = [said(F.array_distinct(F.regexp_extract_all(low, F.lit(f"({mark}[a-z0-9_]+)"), F.lit(1))), bucket) for bucket, mark, _ in MARKED]
    uses = texts.select(F.explode(F.concat(said(tokens(F.col(text_col), least), ""), *marked)).alias("x")).groupBy("x.kind", "x.word").agg(F.count("*").alias("n"))
    fixed = F.coalesce(*[F.when(F.col("kind") == bucket, F.lit(score).cast("long")) for bucket, _, score in MARKED])
    out = uses.select("kind", F.coalesce(fixed, 10 * F.col("n")).alias("score"), "word")
    return out.select(F.when(F.col("kind") == "", F.col("score").cast("string")).otherwise(F.col("kind")).alias("bucket"), "score", "word")


def share_found(text: Column, words: Column) -> Column:
    """Fraction of words that the text contains; 0 for no words."""
    return F.coalesce(F.size(F.filter(words, lambda w: F.contains(text, w))) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def ellipsis(text: Column, n: int = 110) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def compact(n: Column) -> Column:
    return F.when(n > 999, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(n.cast("string"))


def room_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "_")


def seeded_id(key: Column, seed: int, length: int = 16) -> Column:
    """An id that looks random and is the same for a key and seed in every run and on every task."""
    return F.substring(F.md5(F.concat(F.lit(f"id:{seed}:"), key.cast("string")).cast("binary")), 1, length)


def media_url(base: str, name: Column, kind: Column) -> Column:
    folder = F.when(kind == "image", "images").when(kind == "video", "videos").otherwise("files")
    return F.when(name.isNull() | (name == ""), F.lit(None).cast("string")).when(name.startswith("http"), name).otherwise(F.concat_ws("/", F.lit(base), folder, name))


def similar(a: Column, b: Column, threshold: float = 0.3) -> Column:
    """Whether the text a holds something like b: a stretch as long as b (or all of a, if shorter) within that share of b's length by edit distance.

    Near the fuzzy search's threshold, not its scoring.
    """
    a, b = F.lower(a), F.lower(b)
    n, m = F.length(a), F.length(b)
    near = F.exists(F.sequence(F.lit(1), F.greatest(n - m + 1, F.lit(1))), lambda i: F.levenshtein(F.substr(a, i, m), b) <= threshold * m)
    return F.contains(a, b) | near


def can_post(role: Column, is_creator: Column, access: Column) -> Column:
    """By the community's access type: everyone; the creator, admins and moderators; the creator and admins. Unknown roles aren't let in."""
    leads = is_creator | F.coalesce(role == "admin", F.lit(False))
    return F.when(access == "everyone", F.lit(True)).when(access == "moderators", leads | F.coalesce(role == "moderator", F.lit(False))).when(access == "creator", leads).otherwise(F.lit(False))
