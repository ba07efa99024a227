"""What an account's texts say: store links, followers, profiles, handles, and the extraction put together from them.

Texts are arrays of strings, in the order in which they count.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as u
from ..functions.coerce import round_half_up
from ..functions.text import let
from ..plans.rules import PROFILE_LINKS, RESERVED_IN_TEXTS, TEXT_HANDLES
from .importer import extraction_confidence

NONE = "array<string>"
MENTION = r"(?i)(?<![A-Za-z0-9_])(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*([kmb])?\+?\s*(followers?|subscribers?|subs?)(?![A-Za-z0-9_])"


def texts_of(*columns: Column, raw: Column | None = None, each: int = 12_000, most: int = 220) -> Column:
    """Trimmed, non-empty texts, each once: the columns', then what strings the raw JSON holds."""
    own = F.array_compact(F.array(*columns)) if columns else F.array().cast(NONE)
    held = own if raw is None else F.concat(own, F.coalesce(json_leaves(raw), F.array().cast(NONE)))
    clean = F.filter(F.transform(held, lambda s: F.substring(F.regexp_replace(s, r"^\s+|\s+$", ""), 1, each)), lambda s: s != "")
    return F.slice(F.array_distinct(clean), 1, most)


def _leaves(value, depth: int, most: int, each: int, out: list[str]) -> None:
    if depth > 4 or len(out) >= most or value is None:
        return
    if isinstance(value, (dict, list)):
        for x in value.values() if isinstance(value, dict) else value:
            _leaves(x, depth + 1, most, each, out)
            if len(out) >= most:
                return
        return
    said = (value if isinstance(value, str) else json.dumps(value)).strip()
    if said:
        out.append(said[:each])


def json_leaves(raw: Column | str, most: int = 180, each: int = 12_000) -> Column:
    """Strings, numbers and truth values of JSON text down to a depth of 4, in order; null if it doesn't parse.

    The walk has no SQL form, as depth and kinds are open; rows go to Python in Arrow batches.
    """

    def walk(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return None
        out: list[str] = []
        _leaves(value, 0, most, each, out)
        return out

    return F.udf(walk, NONE, useArrow=True)(raw)


def all_in(texts: Column, pattern: str, group: int = 1) -> Column:
    """All that a group of the pattern matches, text by text."""
    return F.filter(F.flatten(F.transform(texts, lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(group)))), lambda s: s != "")


def store_slugs(texts: Column, most: int = 40) -> Column:
    """The slugs of store links, each once whatever its case, in order."""
    found = all_in(texts, rf"(?i)(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.)?{u.STORE_HOST.replace('.', '[.]')}/([a-zA-Z0-9._-]+)")
    clean = F.filter(F.transform(found, lambda s: F.regexp_replace(s, "[.]+$", "")), lambda s: s != "")
    lowered = F.transform(clean, F.lower)
    return F.slice(F.filter(clean, lambda s, i: F.array_position(lowered, F.lower(s)) == i + 1), 1, most)


def follower_mentions(texts: Column, most: int = 12) -> Column:
    """Struct of count (the largest of the first `most` mentions) and mentions (up to 8, each once)."""
    whole = F.slice(all_in(texts, MENTION, 0), 1, most)

    def count(m):
        number = F.replace(F.regexp_extract(m, MENTION, 1), F.lit(","), F.lit("")).try_cast("double")
        suffix = F.lower(F.regexp_extract(m, MENTION, 2))
        return round_half_up(number * F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)).cast("long")

    return F.struct(F.array_max(F.transform(whole, count)).alias("count"), F.slice(F.array_distinct(F.transform(whole, F.trim)), 1, 8).alias("mentions"))


def _by_platform(kind: Column, of) -> Column:
    return reduce(lambda out, p: out.when(kind == p, of(p)), list(PROFILE_LINKS)[1:], F.when(kind == list(PROFILE_LINKS)[0], of(list(PROFILE_LINKS)[0])))


def profile_in(texts: Column, kind: Column) -> Column:
    """The first profile of the platform that the texts link to, in normal form."""

    def of(p):
        pattern, form = PROFILE_LINKS[p]
        links = F.slice(F.array_distinct(all_in(texts, pattern, 0)), 1, 20)
        if p in RESERVED_IN_TEXTS:
            links = F.filter(links, lambda x: ~F.lower(F.get(u.path_parts(x), F.lit(0))).isin(*RESERVED_IN_TEXTS[p]))

        def normal(link):
            path = F.array_join(F.slice(u.path_parts(link), 1, 2), "/")
            host = F.when(F.contains(link, F.lit("twitter.com")), "twitter.com").otherwise("x.com") if p == "x" else F.lit(form)
            return F.concat(F.lit("https://"), host, F.lit("/"), F.lower(path) if p in RESERVED_IN_TEXTS else path)

        return let(F.get(links, F.lit(0)), normal)

    return _by_platform(kind, of)


def handle_in(texts: Column, kind: Column) -> Column:
    """The first handle that the texts give in one of the platform's ways; an earlier way goes before a later one in any text."""
    first = lambda p: F.coalesce(*[F.get(all_in(texts, way), F.lit(0)) for way in TEXT_HANDLES[p]])
    return _by_platform(kind, lambda p: let(first(p), lambda raw: u.clean_handle(raw, F.lit(p))))


def profile_of_handle(kind: Column, handle: Column) -> Column:
    """A profile's URL from a handle, if it has the platform's form."""
    ways = {"x": "https://x.com/", "instagram": "https://instagram.com/", "linkedin": "https://linkedin.com/in/", "tiktok": "https://tiktok.com/@", "youtube": "https://youtube.com/@"}
    return let(u.clean_handle(handle, kind), lambda clean: _by_platform(kind, lambda p: F.concat(F.lit(ways[p]), clean)))


def assemble(rows: DataFrame, url: str, platform: str, texts: str) -> DataFrame:
    """rows with kind, store_url, store_slug, store_urls, followers, profile_url, handle, instagram_url, instagram_handle, signals and confidence.

    What the URL itself says goes before what the texts say, and that before what a handle gives. A YouTube channel's URL
    gives way to a handle in the texts.
    """
    c, x = F.col, F.col(texts)
    named = u.platform(u.host(url))
    out = rows.withColumn("kind", F.when(named.isNotNull() & (named != "unknown"), named).otherwise(F.coalesce(c(platform), F.lit("unknown"))))
    out = out.withColumns({"__own": F.when(named == c("kind"), u.profile(url)), "__said": handle_in(x, c("kind")), "__slugs": store_slugs(x), "__m": follower_mentions(x), "__ig": profile_in(x, F.lit("instagram"))})
    out = out.withColumn("__p1", F.coalesce("__own", profile_in(x, c("kind"))))
    out = out.withColumn("__h1", F.coalesce(u.handle("__own"), F.when(u.platform(u.host("__p1")) == c("kind"), let(u.profile("__p1"), u.handle)), "__said"))
    out = out.withColumn("__p2", F.coalesce("__p1", profile_of_handle(c("kind"), c("__h1"))))
    channel = F.coalesce((c("kind") == "youtube") & c("__said").isNotNull() & F.contains(c("__p2"), F.lit("/channel/")), F.lit(False))
    out = out.withColumns({"handle": F.when(channel, c("__said")).otherwise(c("__h1")), "profile_url": F.when(channel, profile_of_handle(F.lit("youtube"), c("__said"))).otherwise(c("__p2"))})
    mentioned = F.get(F.filter(all_in(x, "@([a-zA-Z0-9._]{2,})"), lambda h: ~F.lower(h).isin(*RESERVED_IN_TEXTS["instagram"])), F.lit(0))
    on_ig, ig_handle = c("kind") == "instagram", F.coalesce(u.handle("__ig"), mentioned)
    out = out.withColumns({
        "store_slug": F.lower(F.get("__slugs", F.lit(0))), "store_urls": F.transform(F.slice("__slugs", 1, 10), lambda s: F.concat(F.lit(f"https://{u.STORE_HOST}/"), s)), "followers": c("__m.count"),
        "instagram_url": F.when(on_ig, F.coalesce("profile_url", "__ig")).otherwise(c("__ig")), "instagram_handle": F.when(on_ig, F.coalesce(c("handle"), ig_handle)).otherwise(ig_handle),
    })
    there = lambda n: F.coalesce(c(n) > 0, F.lit(False)) if n == "followers" else c(n).isNotNull()
    names = ("store_slug", "followers", "profile_url", "handle", "instagram_url", "instagram_handle")
    told = (F.lit("store_slug"), F.lit("followers"), F.concat("kind", F.lit("_profile_url")), F.concat("kind", F.lit("_handle")), F.lit("instagram_profile_url"), F.lit("instagram_handle"))
    signals = F.array_compact(F.array(*[F.when(there(n), s) for n, s in zip(names, told, strict=True)]))
    out = out.withColumns({"signals": signals, "confidence": extraction_confidence(*map(there, names)), "store_url": F.get("store_urls", F.lit(0))})
    return out.drop(*[n for n in out.columns if n.startswith("__")])


__all__ = ["assemble", "follower_mentions", "handle_in", "json_leaves", "profile_in", "profile_of_handle", "store_slugs", "texts_of"]
