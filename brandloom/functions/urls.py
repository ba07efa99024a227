"""URL functions, by regular expressions: parts, platforms, profiles, handles, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col

_PARTS = r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?([^?#]*)(\?[^#]*)?(#.*)?$"

# Platforms by host, reserved first path parts, handle forms, tracking parameters.
PLATFORM_HOSTS = {"x": ("x.com", "twitter.com"), "instagram": ("instagram.com",), "linkedin": ("linkedin.com",), "tiktok": ("tiktok.com",), "youtube": ("youtube.com", "youtu.be")}
RESERVED_X = ("home", "search", "explore", "i", "intent")
RESERVED_INSTAGRAM = ("p", "reel", "explore")
HANDLE_FORMS = {"x": "[A-Za-z0-9_]{1,15}", "instagram": "[A-Za-z0-9._]{2,30}", "linkedin": "[A-Za-z0-9_%-]{2,120}", "tiktok": "[A-Za-z0-9._]{2,24}", "youtube": "[A-Za-z0-9._-]{2,60}"}
TRACKING = "utm_|fbclid|gclid|si"
PLATFORM_ALIASES = (("instagram", "insta"), ("tiktok", "tiktok"), ("youtube", "youtu"), ("x", "x.com"), ("x", "twitter"), ("linkedin", "linkedin"))
SHORT_ALIASES = {"ig": "instagram", "tt": "tiktok", "yt": "youtube", "in": "linkedin", "twitter": "x", "x": "x"}
STORE_HOST = "stan.store"


def host(url: Column | str) -> Column:
    """Lower-cased host, null if the URL can't be read."""
    found = F.lower(F.regexp_extract(col(url), _PARTS, 2))
    return F.when(found != "", found)


def path(url: Column | str) -> Column:
    return F.when(host(url).isNotNull(), F.regexp_extract(col(url), _PARTS, 3))


def query(url: Column | str) -> Column:
    return F.when(host(url).isNotNull(), F.regexp_replace(F.regexp_extract(col(url), _PARTS, 4), r"^\?", ""))


def path_parts(url: Column | str) -> Column:
    return F.filter(F.split(path(url), "/"), lambda p: p != "")


def without_www(h: Column | str) -> Column:
    return F.regexp_replace(col(h), r"^www\.", "")


def on_host(h: Column, name: str) -> Column:
    return (h == name) | h.endswith(f".{name}")


def platform(url_host: Column | str) -> Column:
    """Platform of a host, "unknown" if none."""
    h, out = F.lower(col(url_host)), None
    for name, hosts in PLATFORM_HOSTS.items():
        held = F.lit(False)
        for x in hosts:
            held = held | on_host(h, x)
        out = F.when(held, name) if out is None else out.when(held, name)
    return out.otherwise("unknown")


def normal_platform(x: Column | str, other: str = "null") -> Column:
    """A platform's name from its aliases; other: "null", "same" (the input) or "unknown" (keeps unknown, else null)."""
    v = F.lower(F.trim(col(x)))
    out = None
    for name, part in PLATFORM_ALIASES:
        held = F.contains(v, F.lit(part))
        out = F.when(held, name) if out is None else out.when(held, name)
    for short, name in SHORT_ALIASES.items():
        out = out.when(v == short, name)
    if other == "unknown":
        out = out.when(v == "unknown", "unknown")
    return out.otherwise(v if other == "same" else F.lit(None).cast("string"))


def profile(url: Column | str) -> Column:
    """The normal form of a profile's URL, null if it is none."""
    h, parts = without_www(host(url)), path_parts(url)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    kind, low = platform(host(url)), F.lower(F.get(parts, F.lit(0)))
    video = F.regexp_extract(query(url), r"(?:^|&)v=([^&]+)", 1)
    found = (
        F.when((kind == "x") & ~low.isin(*RESERVED_X), first)
        .when((kind == "instagram") & ~first.isin(*RESERVED_INSTAGRAM), first)
        .when((kind == "linkedin") & low.isin("in", "company"), F.concat_ws("/", low, second))
        .when((kind == "tiktok") & first.startswith("@"), first)
        .when((kind == "youtube") & h.endswith("youtu.be"), first)
        .when((kind == "youtube") & first.startswith("@"), first)
        .when((kind == "youtube") & low.isin("channel", "c", "user"), F.concat_ws("/", low, second))
        .when((kind == "youtube") & (low == "watch") & (video != ""), F.concat(F.lit("watch?v="), video))
    )
    pair = (kind.isin("linkedin", "youtube")) & low.isin("in", "company", "channel", "c", "user") & second.isNull()
    return F.when(first.isNotNull() & found.isNotNull() & ~F.coalesce(pair, F.lit(False)), F.concat(F.lit("https://"), h, F.lit("/"), found))


def handle(profile_url: Column | str) -> Column:
    """The handle in a normal profile URL."""
    kind, parts = platform(host(profile_url)), path_parts(profile_url)
    first, second = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return (
        F.when(kind == "unknown", F.lit(None).cast("string")).when(kind == "linkedin", F.when(first.isin("in", "company"), second))
        .when((kind == "youtube") & first.isin("channel", "c", "user"), second).when(kind.isin("youtube", "tiktok"), F.regexp_replace(first, "^@", "")).otherwise(first)
    )


def clean_handle(raw: Column | str, kind: Column | str) -> Column:
    """raw without leading @ signs if it has the platform's form, else null; an unknown platform takes any."""
    trimmed = F.regexp_replace(F.trim(col(raw)), "^@+", "")
    out = F.when(trimmed == "", F.lit(None).cast("string"))
    for name, form in HANDLE_FORMS.items():
        out = out.when(col(kind) == name, F.when(F.regexp_like(trimmed, F.lit(f"^{form}$")), trimmed))
    return out.otherwise(trimmed)


def mentioned_handle(text: Column | str, kind: str) -> Column:
    """The first handle that a text mentions in one of the platform's ways."""
    form = HANDLE_FORMS[kind]
    ways = {
        "x": rf"\(\s*@({form})\s*\)|(?:^|[^A-Za-z0-9_])(?:x|twitter)\s*·\s*({form})(?![A-Za-z0-9_])|@({form})",
        "instagram": rf"\(\s*@({form})\s*\)|(?:^|[^A-Za-z0-9_])instagram\s*·\s*({form})(?![A-Za-z0-9_])|@({form})",
        "linkedin": rf"linkedin\.com/in/({form})|linkedin\.com/company/({form})|(\b\B)",
        "tiktok": rf"tiktok\.com/@({form})|\(\s*@({form})\s*\)|@({form})",
        "youtube": rf"youtube\.com/@({form})|@({form})|(\b\B)",
    }[kind]
    groups = [F.nullif(F.regexp_extract(col(text), f"(?i){ways}", i), F.lit("")) for i in (1, 2, 3)]
    return clean_handle(F.coalesce(*groups), F.lit(kind))


def canonical(url: Column | str, whole_utm: bool = False) -> Column:
    """url without fragment and tracking parameters. Only parameters named exactly as in TRACKING go; whole_utm: all utm_... too."""
    names = f"utm_[^=&]*|{TRACKING}" if whole_utm else TRACKING
    bare = F.regexp_replace(col(url), r"#.*$", "")
    kept = F.regexp_replace(bare, rf"(?i)(?<=[?&])(?:{names})(?:=[^&]*)?(?:&|$)", "")
    return F.when(host(url).isNull(), col(url)).otherwise(F.regexp_replace(kept, r"[?&]$", ""))


def unwrapped(href: Column | str) -> Column:
    """The target of a search engine's redirect link; absolute links as they are."""
    raw = F.trim(col(href))
    target = lambda key: F.try_url_decode(F.regexp_extract(raw, rf"[?&]{key}=([^&]*)", 1))
    return F.when(F.regexp_like(raw, F.lit("(?i)^https?://")), raw).when(raw.startswith("/url?"), F.nullif(target("q"), F.lit(""))).when(raw.startswith("/l/?"), F.nullif(target("uddg"), F.lit("")))


def resolved(href: Column | str, base: Column | str) -> Column:
    """href as a whole URL, read from a page at base."""
    h, b = F.trim(col(href)), col(base)
    site = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    here = F.regexp_extract(b, r"^[^?#]*", 0)
    folder = F.when(here == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_extract(here, r"^(.*/)", 1))
    full = (
        F.when(F.regexp_like(h, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), h).when(h.startswith("//"), F.concat(F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), h))
        .when(h.startswith("/"), F.concat(site, h)).when(h.startswith("?"), F.concat(here, h)).when(h.startswith("#"), F.concat(F.regexp_extract(b, r"^[^#]*", 0), h)).otherwise(F.concat(folder, h))
    )
    full = F.regexp_replace(full, r"/(?:\./)+", "/")
    for _ in range(4):
        full = F.regexp_replace(full, r"(?<=[^/:])/[^/?#]+/\.\./", "/")
    return full


def is_page(url: Column | str) -> Column:
    return F.coalesce(F.regexp_like(F.lower(col(url)), F.lit("^https?://")) & ~F.regexp_like(F.lower(path(url)), F.lit(r"\.(pdf|jpg|jpeg|png|webp|svg|gif|zip|mp4|mov)$")), F.lit(False))


def is_search_host(url: Column | str) -> Column:
    h = host(url)
    return F.coalesce(on_host(h, "google.com") | h.endswith(".googleusercontent.com"), F.lit(False))


def store_slug(text: Column | str, store: str = STORE_HOST) -> Column:
    """Lower-cased slug of the first store link in a text."""
    found = F.regexp_extract(col(text), rf"(?i)(?:https?://)?(?:www\.)?(?:[a-z0-9-]+\.)?{store.replace('.', '[.]')}/([a-zA-Z0-9._-]+)", 1)
    return F.nullif(F.lower(F.regexp_replace(found, "[.]+$", "")), F.lit(""))


def with_scheme(x: Column | str) -> Column:
    """An input as a URL: https is put before a bare host, the fragment goes; null without a dot in the host (localhost may be)."""
    raw = F.trim(col(x))
    full = F.regexp_replace(F.when(F.regexp_like(raw, F.lit("(?i)^https?://")), raw).otherwise(F.concat(F.lit("https://"), raw)), "#.*$", "")
    return F.when(F.contains(host(full), F.lit(".")) | (host(full) == "localhost"), full)


def favicon(x: Column | str) -> Column:
    """Where the icon of an input's site is served."""
    return F.concat(F.lit("https://www.google.com/s2/favicons?domain="), host(with_scheme(x)), F.lit("&sz=128"))


def plain_handle(raw: Column | str) -> Column:
    """Lower-cased, without leading @ signs and what no handle holds."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(col(raw)), "^@+", ""), "[^a-zA-Z0-9._-]", ""))


def link_handle(link: Column | str) -> Column:
    """The handle that a link to a store or a platform shows; null without a path."""
    h, parts = host(link), path_parts(link)
    first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    on = lambda name: F.contains(h, F.lit(name))
    tube = on("youtube.com") | on("youtu.be")
    shown = F.when(on("linkedin.com") & (first == "in"), second).when(tube & first.isin("channel", "c", "user", "@"), second).otherwise(first)
    return F.when(F.size(parts) > 0, plain_handle(shown))


def link_platform(link: Column | str) -> Column:
    """The platform that a link's host names, null if none."""
    h, out = host(link), F.when(F.lit(False), "")
    for name, part in (("instagram", "instagram.com"), ("tiktok", "tiktok.com"), ("youtube", "youtube.com"), ("youtube", "youtu.be"), ("x", "x.com"), ("x", "twitter.com"), ("linkedin", "linkedin.com")):
        out = out.when(F.contains(h, F.lit(part)), name)
    return out


def brand_name(url: Column | str) -> Column:
    """A name from the first label of a host."""
    words = F.filter(F.split(F.get(F.split(without_www(host(url)), r"\."), F.lit(0)), "[-_]"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), w.substr(F.lit(2), F.length(w)))), " ")
