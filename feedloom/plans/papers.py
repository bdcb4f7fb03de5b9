"""Papers: recommendations for all papers in one plan, editions, delivery, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import ranking as rk
from ..operators import relational as rel
from ..sources.shared import written
from .feeds import with_author


#: Posts that are taken out and sent to every task; where more could be asked for, papers and posts meet by number in a shuffle.
POSTS_AT_ONCE = 100_000


def _numbered(pool: DataFrame, most: int) -> DataFrame:
    """Posts numbered from 1, newest first: as few rows, written once and sent to every task, where no more than a checked number can be asked for."""
    if most > POSTS_AT_ONCE:
        return rel.numbered_newest(pool, "createdAt", "id", "__number")
    newest = [F.col("createdAt").desc_nulls_last(), F.col("id").desc()]
    return F.broadcast(written(pool.orderBy(*newest).limit(most).withColumn("__number", F.row_number().over(Window.orderBy(*newest)).cast("long"))))


def spread(papers: DataFrame) -> DataFrame:
    """Papers dealt by their id to as many tasks as the session says: few rows, of which each becomes many, so that their size says little about the work."""
    return papers.repartition(int(papers.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")


def candidates(papers: DataFrame, posts: DataFrame, views: DataFrame, as_of: str, per_post: int = 3, days: int | None = None, users: DataFrame | None = None) -> DataFrame:
    """(paper columns, post columns): each paper's newest unviewed posts, per_post times as many as it prints; with their authors' columns where users are given.

    Posts are numbered newest first. A paper that wants k posts takes the first k numbers and one more for each post its author
    has viewed among those; so papers and posts meet by the number. No number is over the largest wish and the most views of
    one author together; up to a checked size these posts are taken once and go to every task, however many posts there are.
    """
    pool = posts.where("not isShort").where(F.col("createdAt") <= F.lit(as_of).cast("timestamp_ntz"))
    if days is not None:
        pool = pool.where(F.col("createdAt") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    p = spread(papers).select(*[F.col(c).alias(f"paper_{c}") for c in papers.columns]).withColumn("__want", per_post * F.coalesce("paper_postCount", F.lit(0)))
    readers = papers.select(F.col("authorId").alias("userId")).distinct()
    read = views.join(readers, "userId", "left_semi").select(F.col("userId").alias("__u"), F.col("postId").alias("__v")).distinct()
    reads = read.groupBy("__u").agg(F.count("*").alias("__n"))
    most = p.join(reads, F.col("paper_authorId") == F.col("__u"), "left").agg(F.max(F.col("__want") + F.coalesce("__n", F.lit(0)))).first()[0] or 0
    pool = _numbered(pool, most)
    seen = read.join(pool.select(F.col("id").alias("__p"), "__number"), F.col("__v") == F.col("__p")).select("__u", F.col("__number").alias("__seen"))
    # unviewed posts before each viewed one
    seen = seen.withColumn("__before", F.col("__seen") - F.row_number().over(Window.partitionBy("__u").orderBy("__seen")))
    skipped = p.join(seen, (F.col("paper_authorId") == F.col("__u")) & (F.col("__before") < F.col("__want"))).groupBy(F.col("paper_id").alias("__i")).agg(F.count("*").alias("__skipped"), F.collect_list("__seen").alias("__gone"))
    last = (F.col("__want") + F.coalesce("__skipped", F.lit(0))).cast("long")
    gone = F.coalesce("__gone", F.array().cast("array<bigint>"))
    shown = pool if users is None else with_author(pool, users)
    slots = p.join(skipped, F.col("paper_id") == F.col("__i"), "left").where("__want > 0").withColumn("__number", F.explode(F.array_except(F.sequence(F.lit(1).cast("long"), last), gone)))
    return slots.drop("__want", "__i", "__skipped", "__gone").join(F.broadcast(shown) if most <= POSTS_AT_ONCE else shown, "__number").drop("__number")


def _scored(papers: DataFrame, posts: DataFrame, users: DataFrame, follows: DataFrame, views: DataFrame, as_of: str, days: int | None = None, readers: DataFrame | None = None) -> DataFrame:
    """Candidates with author, reader, whether the reader follows the author, and the share of the description's words that they hold."""
    reader = (readers if readers is not None else users).select(F.col("id").alias("__r"), F.col("state").alias("reader_state"), F.col("interest").alias("reader_interest"))
    papers = papers.join(reader, F.col("authorId") == F.col("__r"), "left").drop("__r").withColumn("words", text.description_keywords(F.col("description")))
    df = candidates(papers, posts, views, as_of, days=days, users=users).withColumnsRenamed({"paper_reader_state": "reader_state", "paper_reader_interest": "reader_interest"})
    df = rel.flag(df, follows, {"paper_authorId": "followerId", "authorId": "followingId"}, "followed")
    return df.withColumn("keyword_share", F.least(text.share_found(F.col("content"), F.col("paper_words")), F.lit(1.0)))


def _ranked(df: DataFrame) -> DataFrame:
    by = Window.partitionBy("paper_id").orderBy(F.col("score").desc(), F.col("createdAt").desc(), F.col("id"))
    return df.withColumn("place", F.row_number().over(by)).where(F.col("place") <= F.col("paper_postCount")).select("paper_id", "place", "id", "score")


def topic_share(content: Column, topics: Column) -> Column:
    """Share of a list of topics that the text contains; 0 for no list."""
    return F.coalesce(F.size(F.filter(topics, lambda t: F.contains(content, F.lower(t)))) / F.nullif(F.size(topics), F.lit(0)), F.lit(0.0))


def metadata_score(meta: str, interests: Column) -> Column:
    """English 0.3, an interest of the reader within the audience 0.3, news intent 0.2, a focus 0.2."""
    m = F.col(meta)
    part = lambda c, v: F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0)
    meets = F.exists(interests, lambda i: F.contains(F.lower(m["audience"]), F.lower(i)))
    return part(m["language"] == "english", 0.3) + part(meets, 0.3) + part(m["intent_type"].isin("news", "informational"), 0.2) + part(m["focus_level"].isin("high", "medium"), 0.2)


def recommend(papers: DataFrame, posts: DataFrame, users: DataFrame, follows: DataFrame, views: DataFrame, as_of: str, readers: DataFrame | None = None) -> DataFrame:
    """(paper_id, place, id, score): the posts of every paper, best first.

    papers has a struct ``metadata`` as functions.replies.metadata gives it: primary and secondary topics, regions, excluded
    topics, language, audience, intent and focus. Missing parts count as empty. readers (id, state, interest) are the papers' authors, looked
    up among users where it is not given.
    """
    df = _scored(papers, posts, users, follows, views, as_of, readers=readers)
    content, meta = F.lower(F.coalesce("content", F.lit(""))), F.col("paper_metadata")
    context = F.least(F.col("keyword_share") + 0.3 * topic_share(content, meta["primary_topics"]) + 0.1 * topic_share(content, meta["secondary_topics"]), F.lit(1.0))
    named = lambda state: F.coalesce(F.array_contains(meta["regions"]["states"], state.cast("string")), F.lit(False))
    region = F.when(F.col("author_state") == F.col("reader_state"), 1.0).when(F.col("author_state").isNotNull() & F.col("reader_state").isNotNull() & (named(F.col("reader_state")) | named(F.col("author_state"))), 0.7).otherwise(0.0)
    allowed = F.when(F.coalesce(F.exists(meta["excluded_topics"], lambda t: F.contains(content, F.lower(t))), F.lit(False)), 0.1).otherwise(1.0)
    interests = F.filter(F.array("reader_interest"), lambda x: x.isNotNull())
    score = rk.paper_score(rk.age_hours(F.col("createdAt"), as_of), context, region, metadata_score("paper_metadata", interests), F.col("followed"), allowed)
    return _ranked(df.withColumn("score", F.round(score, 6)))


def recommend_scheduled(papers: DataFrame, posts: DataFrame, users: DataFrame, follows: DataFrame, views: DataFrame, as_of: str, readers: DataFrame | None = None) -> DataFrame:
    """As recommend, for posts of the last seven days and the scheduler's weights."""
    df = _scored(papers, posts, users, follows, views, as_of, days=7, readers=readers)
    region = F.when(F.col("author_state").isNull() | F.col("reader_state").isNull(), 0.5).when(F.col("author_state") == F.col("reader_state"), 1.0).otherwise(0.3)
    score = rk.scheduled_score(rk.age_hours(F.col("createdAt"), as_of), F.col("keyword_share"), region, F.col("followed"))
    return _ranked(df.withColumn("score", F.round(score, 6)))


def due(papers: DataFrame, editions: DataFrame, now_utc: str) -> DataFrame:
    """(id, paperDate): editions to make now: today's if it is missing and its hour is next or past, else tomorrow's if today's
    is there, tomorrow's missing and its hour is next. Dates and hours are in the editions' zone."""
    now = dates.local(F.lit(now_utc).cast("timestamp_ntz"))
    today, following = F.to_date(now), F.date_add(F.to_date(now), 1)
    ready = papers.where("status = 'active' and processingStatus = 'completed' and not deleted").select("id", F.floor(dates.delivery_minute(F.col("deliveryTime")) / 60).alias("hour"))
    has = editions.select("paperId", "paperDate").distinct()
    state = has.groupBy("paperId").agg(F.bool_or(F.col("paperDate") == today).alias("t"), F.bool_or(F.col("paperDate") == following).alias("m"))
    ready = ready.join(state, F.col("id") == F.col("paperId"), "left")
    t, m = F.coalesce("t", F.lit(False)), F.coalesce("m", F.lit(False))
    soon = (F.hour(now) + 1) % 24
    day = F.when(~t & ((soon == F.col("hour")) | (F.hour(now) >= F.col("hour"))), today).when(t & ~m & (soon == F.col("hour")), following)
    return ready.select("id", day.alias("paperDate")).where("paperDate is not null")


def deliver(editions: DataFrame, now_utc: str) -> DataFrame:
    """Editions with today's scheduled ones marked delivered once their time has come; nothing in an hour's first minute."""
    now = dates.local(F.lit(now_utc).cast("timestamp_ntz"))
    at = dates.delivery_minute(F.col("deliveryTime"))
    late = (at < 60) & (F.hour(now) > 1)
    comes = (F.col("status") == "scheduled") & (F.col("paperDate") == F.to_date(now)) & (F.hour(now) * 60 + F.minute(now) >= at) & ~late & (F.minute(now) != 0)
    return editions.withColumn("status", F.when(comes, "delivered").otherwise(F.col("status")))


def retained(editions: DataFrame, today: str, days: int = 7) -> DataFrame:
    return editions.where(F.col("paperDate") >= F.date_sub(F.lit(today).cast("date"), days))


def missing(papers: DataFrame, editions: DataFrame, now_utc: str) -> DataFrame:
    """Active papers whose hour has passed without an edition of today."""
    now = dates.local(F.lit(now_utc).cast("timestamp_ntz"))
    late = papers.where("status = 'active' and not deleted").where(F.floor(dates.delivery_minute(F.col("deliveryTime")) / 60) <= F.hour(now))
    have = editions.where(F.col("paperDate") == F.to_date(now)).select("paperId")
    return late.join(have, F.col("id") == F.col("paperId"), "left_anti").select("id", "deliveryTime")


def reading_list(editions: DataFrame, as_of_date: str) -> DataFrame:
    """Unread first, then newest by date and time."""
    at = F.col("paperDate").cast("timestamp_ntz") + F.make_dt_interval(mins=dates.delivery_minute(F.col("deliveryTime")))
    by = Window.partitionBy("paperId").orderBy("isRead", at.desc(), F.col("id"))
    return editions.where(F.col("paperDate") <= F.lit(as_of_date).cast("date")).select("paperId", "id", F.row_number().over(by).alias("place"), "isRead")
