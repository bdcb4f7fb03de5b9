"""URL filters with redirect equivalence, in DataFrame operations only.

Rules name a host and a path prefix; the longest rule that fits a URL decides. Pages also state other names of
themselves: canonical links and refresh redirects, taken relative to the page's base, and a table of
redirects may be given. Connected components over
those edges are sets of aliases. A URL that no rule fits takes its aliases' decision: allowed if a rule allows one of
them, else blocked if a rule blocks one, else ``default``. So blocks spread to aliases, and an explicit allow has
precedence, on the URL itself and among aliases.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

#: A list of rules becomes one expression; more than this many are to be given as a table.
MOST_RULES = 2_000
#: Comments and elements whose text is no markup; tags of interest with their attributes; an attribute, its name and its value.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp|iframe)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\z)"
_VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)"""
_TAG = rf"(?is)<(?:link|meta|base)(?=[\s/>])(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+{_VALUE})?+|=)*+>"
_ATTRIBUTE = rf"(?s)[^\s/>=]++(?:\s*+=\s*+{_VALUE})?+"
_NAME = r"(?s)^([^\s=]++)"
_SET = r"(?s)^[^\s=]++\s*+=\s*+(.*)$"
_QUOTED = r"""(?s)^(["'])(.*)\1$"""
_UP_TO_QUOTE = r"""(?s)^(["'])(.*?)(?:\1.*)?$"""


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def decide(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits; of equally long ones an allow, then the first in order."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: give a table of action, host, path")
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("rule"), none.alias("action"))
    for action, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


#: Named entities of characters that stand in attributes and URLs.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "Tab": "\t", "NewLine": "\n", "excl": "!", "num": "#", "dollar": "$", "percnt": "%", "lpar": "(", "rpar": ")", "ast": "*", "plus": "+", "comma": ",", "period": ".", "sol": "/", "colon": ":", "semi": ";", "equals": "=", "quest": "?", "commat": "@", "lowbar": "_"}


def unescaped(text: Column) -> Column:
    """Text with its numeric entities, decimal and hexadecimal, and the named ones above resolved, each once; numbers that are no character become U+FFFD."""
    names = F.create_map(*[F.lit(x) for n, c in ENTITIES.items() for x in (f"&{n};", c)])

    def part(x: Column) -> Column:
        digits = F.regexp_extract(x, r"^&#[xX]?0*([0-9a-fA-F]{1,7});?$", 1)
        number = F.coalesce(F.when(x.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("long"), F.lit(0))
        code = F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), number).otherwise(F.lit(0xFFFD))
        return F.when(x.startswith("&#"), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.coalesce(F.try_element_at(names, x), x))

    parts = F.regexp_extract_all(text, F.lit(r"(?s)(&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z]+;|&(?!#[0-9xX])|&|[^&]++)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^&#(?:[xX][0-9a-fA-F]|[0-9])") | x.rlike("^&[A-Za-z]"), part(x)).otherwise(x)), "")


def attribute(attributes: Column, name: str) -> Column:
    """The value of the first of a tag's attributes of that name, as it is written; null where there is none."""
    own = F.filter(attributes, lambda x: F.lower(F.regexp_extract(x, _NAME, 1)) == name)
    return F.regexp_replace(F.regexp_extract(F.get(own, 0), _SET, 1), _QUOTED, "$2")


def _plain(target: Column) -> Column:
    """A URL as a browser takes it: without line ends and tabs inside, and without control characters and spaces around."""
    return F.regexp_replace(F.regexp_replace(target, r"[\t\n\r]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def _refresh(content: Column) -> Column:
    """The target that a refresh names after its seconds, in quotes or not."""
    rest = F.regexp_replace(F.regexp_replace(content, r"(?s)^\s*[\d.]*\s*[;,]?\s*", ""), r"(?is)^url\s*=\s*", "")
    return F.regexp_replace(rest, _UP_TO_QUOTE, "$2")


def decided(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (host, path, once each) with struct(rule, action) as decide gives it, for a table of rules (action, host, path).

    A URL meets the rules of its host's suffixes by an equi-join; those whose path it doesn't start with drop out.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    wide = urls.where("host <> ''").select("host", "path", F.explode(suffix).alias("__h"))
    r = rules.select("action", F.col("host").alias("__rule_host"), F.col("path").alias("__rule_path")).distinct()
    met = wide.join(r, F.col("__h") == F.col("__rule_host")).where(F.startswith("path", F.col("__rule_path")))
    rule = F.concat("__rule_host", "__rule_path")
    first = F.struct((-F.length(rule)).alias("n"), (F.col("action") != "allow").alias("a"), rule.alias("r"))
    return met.groupBy("host", "path").agg(F.min_by(F.struct(rule.alias("rule"), "action"), first).alias("__d"))


def _judged(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """df (host, path, ...) with __d, what the rules say of each row."""
    if isinstance(rules, list):
        return df.withColumn("__d", decide(F.col("host"), F.col("path"), rules))
    return df.join(decided(df.select("host", "path").distinct(), rules), ["host", "path"], "left")


def _without_dots(path: Column) -> Column:
    """The path with its segments "." and ".." worked out."""
    parts = F.split(path, "/")
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), lambda held, x: F.when(x == ".", held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x))))
    open_end = path.rlike(r"/\.\.?$") & (F.size(kept) > 0)
    worked = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(open_end, "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), worked).otherwise(path)


def _node(url: Column) -> Column:
    """What two URLs of one page share: host, path without dot segments and query, without the scheme and the fragment."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    path, question = F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*(.*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.when(rest == "", "/").otherwise(F.concat(_without_dots(path), question))))


def _resolved(base: Column, target: Column) -> Column:
    """The URL that a page at ``base`` means by ``target``; null for schemes without "//", as in mailto:."""
    scheme = F.concat(F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.lit(":"))
    site, path = F.concat(scheme, F.lit("//"), host_of(base)), path_of(base)
    folder = F.regexp_replace(F.when(path == "", "/").otherwise(path), r"[^/]*$", "")
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, F.when(path == "", "/").otherwise(path), target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(site, folder, target))
    )


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b): a page's URL and each canonical or refresh target that it states.

    Comments and the text of scripts and the like are cut out; tags are taken apart attribute by attribute, a value ending where its quote does;
    a rel is a list of words. Targets are relative to the first <base href> if there is one, itself relative to the page's URL.
    """
    html = F.col(html_col)
    tags = F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAG), F.lit(0))
    held = pages.where(F.col(url_col).isNotNull() & html.rlike("(?i)<(?:link|meta)")).select(F.col(url_col).alias("u"), tags.alias("tags"))
    # step by step, so that no expression is written out in another several times
    of = lambda tag: F.regexp_extract_all(F.regexp_replace(tag, r"(?is)^<[a-z]+", ""), F.lit(_ATTRIBUTE), F.lit(0))
    bases = F.filter(F.transform(F.filter("tags", lambda x: F.lower(x).startswith("<base")), lambda x: attribute(of(x), "href")), lambda x: x.isNotNull())
    held = held.withColumn("base", _plain(unescaped(F.get(bases, 0)))).withColumn("tag", F.explode(F.array_distinct("tags"))).drop("tags")
    held = held.where(~F.lower("tag").startswith("<base")).withColumn("link", F.lower("tag").startswith("<link")).withColumn("own", of(F.col("tag")))
    held = held.select("u", "base", "link", F.when(F.col("link"), attribute(F.col("own"), "rel")).otherwise(attribute(F.col("own"), "http-equiv")).alias("kind"), F.when(F.col("link"), attribute(F.col("own"), "href")).otherwise(attribute(F.col("own"), "content")).alias("t"))
    held = held.where("t IS NOT NULL AND kind IS NOT NULL").withColumn("words", F.split(F.lower(F.trim(F.regexp_replace(unescaped(F.col("kind")), r"\s+", " "))), " "))
    held = held.where((F.col("link") & F.array_contains("words", "canonical")) | (~F.col("link") & (F.array_join("words", " ") == "refresh")))
    held = held.withColumn("t", unescaped(F.col("t"))).withColumn("t", F.when(F.col("link"), F.col("t")).otherwise(_refresh(F.col("t")))).withColumn("t", _plain(F.col("t"))).where("t <> ''")
    held = held.withColumn("base", F.coalesce(_resolved(F.col("u"), F.col("base")), F.col("u"))).withColumn("t", _resolved(F.col("base"), F.col("t")))
    return held.select(_node(F.col("u")).alias("a"), _node(F.col("t")).alias("b")).where("a is not null and b is not null").distinct()


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """(id_col, host, path, rule, verdict) of every row of pages.

    ``rules`` are (action, host, path prefix), a list or a table of these columns; ``redirects`` has from_url and to_url. Null URL or one without "://":
    host and path are empty, no rule fits, the verdict is ``default``. Null html states nothing. Repeated URLs and
    repeated edges count once; every row of pages is returned, also of repeated or null ids. Empty pages: no rows. Other columns aren't read.
    """
    parsed = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = _judged(parsed, rules)
    edges = []
    if html_col is not None:
        edges.append(alias_edges(pages, url_col, html_col))
    if redirects is not None:
        edges.append(redirects.select(_node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b")))
    verdict = F.col("__d.action")
    if edges:
        parts = connected_components(reduce(DataFrame.unionByName, edges))
        h, p = F.regexp_extract("node", r"(?s)^([^/?#]*)", 1), F.regexp_extract("node", r"(?s)^[^/?#]*([^?#]*)", 1)
        judged = _judged(parts.withColumns({"host": h, "path": p}), rules).withColumn("action", F.col("__d.action"))
        spread = judged.groupBy("component").agg(F.when(F.bool_or(F.col("action") == "allow"), "allow").when(F.bool_or(F.col("action") == "block"), "block").alias("spread")).where("spread is not null")
        found = parts.join(spread, "component").select("node", "spread")
        parsed = parsed.withColumn("__node", _node(F.col("__url")))
        parsed = parsed.join(found, parsed["__node"] == found["node"], "left")
        verdict = F.coalesce(verdict, F.col("spread"))
    return parsed.select(F.col("__id").alias(id_col), "host", "path", F.col("__d.rule").alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
