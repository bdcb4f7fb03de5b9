"""Replies of a remote language model, parsed: categories of a post, the metadata of a paper. The model itself is an input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a post is when the model names nothing, and how many categories count.
GENERAL, MOST = "General", 5
METADATA = (
    "struct<summary:string,primary_topics:array<string>,secondary_topics:array<string>,"
    "regions:struct<cities:array<string>,states:array<string>,countries:array<string>,global_scope:boolean>,"
    "excluded_topics:array<string>,tone:string,intent_type:string,focus_level:string,language:string,audience:string,"
    "content_filters:struct<requires_facts:boolean,requires_opinion:boolean,exclude_clickbait:boolean,exclude_ads:boolean>,preferred_sources:array<string>>"
)


def unfenced(reply: Column) -> Column:
    """The reply without white space and the code fence around it."""
    text = F.regexp_replace(reply, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(text, r"^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.regexp_replace(F.when(text.startswith("```"), inner).otherwise(text), r"^\s+|\s+$", "")


def categories(reply: Column) -> Column:
    """The first five categories of a reply; General for a null, broken, empty or other reply than a list."""
    text = unfenced(reply)
    found = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    return F.when(F.size(found) > 0, F.slice(found, 1, MOST)).otherwise(F.array(F.lit(GENERAL)))


def metadata(reply: Column) -> Column:
    """The metadata record of a reply; null where the reply is null or no JSON object, absent fields are null."""
    text = unfenced(reply)
    found = F.from_json(text, METADATA)
    return F.when(text.startswith("{") & F.coalesce(F.size(F.json_object_keys(text)) >= 0, F.lit(False)), found)
