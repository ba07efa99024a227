"""Text functions: phrases, token sets, keyword rules, and what is read out of free text."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import col, round_half_up


def let(x: Column, use) -> Column:
    """use(x), with x worked out once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def phrase(x: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(col(x), r"^[\s ]+|[\s ]+$", "")), r"\s+", " ")


def tokens(x: Column | str) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(col(x)), "[^a-z0-9]+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays (distinct, without nulls); 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.arrays_overlap(a, b), both / (F.size(a) + F.size(b) - both)).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    return F.when(F.arrays_overlap(a, b), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(0.0)


def phrase_similarity(a: Column, b: Column, a_tokens: Column | None = None, b_tokens: Column | None = None) -> Column:
    """1 if equal, 0.84 if one contains the other, else the token overlap; a and b are phrases, whose tokens may be known."""
    ta, tb = tokens(a) if a_tokens is None else a_tokens, tokens(b) if b_tokens is None else b_tokens
    return (
        F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0))
        .when(F.contains(a, b) | F.contains(b, a), F.lit(0.84)).otherwise(overlap(ta, tb))
    )


def keyword_hits(texts: Column, keywords: tuple[str, ...]) -> Column:
    """How many (text, keyword) pairs there are in which the text contains the keyword."""
    per_text = F.transform(texts, lambda t: sum((F.contains(t, F.lit(k)).cast("int") for k in keywords), F.lit(0)))
    return F.aggregate(per_text, F.lit(0), lambda s, n: s + n)


def has_keyword(text: Column, keyword: str) -> Column:
    """text is lower-cased. A keyword with a space may stand anywhere; any other must stand alone (ASCII letters, digits and _ bind)."""
    if " " in keyword:
        return F.contains(text, F.lit(keyword))
    return F.regexp_like(text, F.lit(f"(^|[^A-Za-z0-9_]){re.escape(keyword)}([^A-Za-z0-9_]|$)"))


def keywords_in(text: Column, keywords: list[str]) -> Column:
    """Those of the keywords that has_keyword finds in text (lower-cased): its words are looked up all at once."""
    single = [k for k in keywords if re.fullmatch("[a-z0-9_]+", k)]
    phrases = [k for k in keywords if " " in k]
    others = [k for k in keywords if k not in single and k not in phrases]
    parts = [F.array_intersect(F.split(text, "[^a-z0-9_]+"), strings(*single)), F.filter(strings(*phrases), lambda p: F.contains(text, p))]
    return F.concat(*parts, labels(*[(has_keyword(text, k), k) for k in others]))


def any_word(text: Column, words: str) -> Column:
    """words: alternatives of a regular expression, which must stand alone."""
    return F.regexp_like(text, F.lit(f"(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"))


def contains_any(text: Column, *literals: str) -> Column:
    return functools.reduce(Column.__or__, [F.contains(text, F.lit(x)) for x in literals])


def spaced(text: Column) -> Column:
    """Lower-cased text with a space for what is no word's, and one at either end, for held_word."""
    return F.concat(F.lit(" "), F.regexp_replace(text, "[^a-z0-9_]+", " "), F.lit(" "))


def held_word(text: Column, spaced_text: Column, words: str) -> Column:
    """any_word of a lower-cased text (alternatives without groups), of which spaced is known.

    Plain words are looked up there; the expression of any other alternative is tried only where a word begins as it does.
    """
    plain, others, begun = [], [], []
    for word in words.split("|"):
        start, rest = re.fullmatch(r"([a-z0-9_]*)(.*)", word).groups()
        if rest in ("", "?"):
            plain += [f" {start} "] + ([f" {start[:-1]} "] if rest else [])
        else:
            others.append(word)
            begun.append(" " + (start[:-1] if rest[0] in "?*{" else start))
    found = [contains_any(spaced_text, *plain)] if plain else []
    found += [contains_any(spaced_text, *begun) & any_word(text, "|".join(others))] if others else []
    return functools.reduce(Column.__or__, found)


def labels(*cases: tuple[Column, str]) -> Column:
    """The labels whose conditions hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in cases]))


# Call-to-action and product patterns, by variant.
CTA_RULES = {
    "baseline": (("book|schedule|apply|call", "consultative"), ("buy|checkout|shop|purchase", "transactional"), ("join|subscribe|newsletter", "community"), ("dm|message|contact", "inbound_dm")),
    "page": (("book|schedule|apply|consult|1:1|coaching", "consultative"), ("buy|checkout|shop|purchase|order", "transactional"), ("join|subscribe|newsletter|community", "community"), ("dm|message|contact", "inbound_dm")),
}
PRODUCT_RULES = {
    "baseline": (
        ("course|program", "course"), ("coaching|consulting|mentor", "coaching"), ("template|notion|swipe file", "template"), ("membership|community", "membership"),
        ("newsletter|substack", "newsletter"), ("ebook|guide|pdf", "digital_guide"), ("service|done-for-you|agency", "service"),
    ),
    "page": (
        ("course|program|masterclass|workshop|class", "course"), ("coaching|consulting|mentor|vip|1:1|one-on-one", "coaching"), ("template|notion|swipe file", "template"), ("membership|community", "membership"),
        ("newsletter|substack", "newsletter"), ("ebook|guide|pdf|resource", "digital_guide"), ("service|done-for-you|agency", "service"),
    ),
}
OFFER_WORDS = "course|program|coaching|template|ebook|guide|membership|newsletter|workshop|bundle|service|1:1"
MONEY = r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
LINK = r"(?i)https?://[^\s\"'<>]+"
FOLLOWERS = r"(?:^|[^A-Za-z0-9_])(\d+(?:\.\d+)?)\s*([kmb])?\+?\s*(?:followers?|subscribers?|subs?)(?:[^A-Za-z0-9_]|$)"


def cta_style(text: Column | str, variant: str = "baseline") -> Column:
    lowered, out = F.lower(col(text)), None
    for words, label in CTA_RULES[variant]:
        held = any_word(lowered, words)
        out = F.when(held, F.lit(label)) if out is None else out.when(held, F.lit(label))
    return out.otherwise(F.lit("generic"))


def product_types(text: Column | str, variant: str = "baseline") -> Column:
    lowered = F.lower(col(text))
    return labels(*[(any_word(lowered, words), label) for words, label in PRODUCT_RULES[variant]])


def found(text: Column | str, pattern: str, most: int | None = None) -> Column:
    out = F.array_distinct(F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0)))
    return out if most is None else F.slice(out, 1, most)


def emails(text: Column | str) -> Column:
    return found(text, EMAIL)


def links(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(LINK), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;:!?]+$", "")))


def prices(text: Column | str, most: int = 30) -> Column:
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(col(text), F.lit(MONEY), F.lit(0)), lambda p: F.regexp_replace(p, r"\s+", ""))), 1, most)


def _count(number: Column, suffix: Column) -> Column:
    times = F.when(suffix == "k", 1e3).when(suffix == "m", 1e6).when(suffix == "b", 1e9).otherwise(1.0)
    return round_half_up(number.try_cast("double") * times).cast("long")


def follower_count(text: Column | str) -> Column:
    """The first count of followers or subscribers in a text."""
    compact = F.lower(F.replace(col(text), F.lit(","), F.lit("")))
    number = F.regexp_extract(compact, FOLLOWERS, 1)
    return F.when(number != "", _count(number, F.regexp_extract(compact, FOLLOWERS, 2)))


def most_followers(text: Column | str, mentions: int = 12) -> Column:
    """The largest of the first `mentions` counts in a text."""
    compact = F.lower(F.replace(col(text), F.lit(","), F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(compact, F.lit(FOLLOWERS), F.lit(1)).alias("n"), F.regexp_extract_all(compact, F.lit(FOLLOWERS), F.lit(2)).alias("s"))
    return F.array_max(F.transform(F.slice(pairs, 1, mentions), lambda p: _count(p["n"], p["s"])))


def html_to_text(page: Column | str, most: int = 120_000) -> Column:
    """Tags become line ends or nothing, scripts and styles go, five references are decoded, blank lines collapse."""
    x = F.regexp_replace(col(page), r"(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>", "")
    x = F.regexp_replace(x, r"(?i)<(br|/p|/h[1-6]|/li|/div|/title|/article|/footer|/nav)[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(sign))
    x = F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.substring(F.regexp_replace(x, r"^[ \n]+|[ \n]+$", ""), 1, most)


def html_title(page: Column | str) -> Column:
    return F.regexp_extract(col(page), r"(?is)<title[^>]*>(.*?)</title>", 1)


def clean_text(x: Column | str, most: int = 450) -> Column:
    y = F.replace(F.replace(col(x), F.lit(" "), F.lit(" ")), F.lit("\r"), F.lit(""))
    y = F.regexp_replace(F.regexp_replace(y, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.substring(F.regexp_replace(y, r"^\s+|\s+$", ""), 1, most)


def lines(text: Column | str) -> Column:
    return F.filter(F.transform(F.split(col(text), "\n"), lambda s: F.trim(s)), lambda s: s != "")


def offer_candidates(page: Column | str, text: Column | str, most: int = 25) -> Column:
    anchors = F.transform(F.regexp_extract_all(col(page), F.lit(r"(?is)<a[^>]*>(.*?)</a>"), F.lit(1)), lambda a: F.trim(F.regexp_replace(F.regexp_replace(a, "<[^>]+>", " "), r"\s+", " ")))
    short = F.filter(anchors, lambda a: F.length(a).between(5, 100))
    all_lines = F.filter(lines(text), lambda s: F.length(s).between(5, 90))
    return F.slice(F.array_distinct(F.filter(F.concat(short, all_lines), lambda s: any_word(F.lower(s), OFFER_WORDS))), 1, most)


def bio(text: Column | str) -> Column:
    fit = F.filter(lines(text), lambda s: (F.length(s) > 20) & (F.length(s) < 220))
    return F.when(F.size(fit) > 0, F.array_join(F.slice(fit, 1, 2), " "))


def title_case(handle: Column | str) -> Column:
    """A name from a handle, without leading @ signs."""
    return F.initcap(F.trim(F.regexp_replace(F.regexp_replace(col(handle), "^@+", ""), r"[\s._-]+", " ")))


def bundle(blocks: Column, each: int, count: int, most: int = 13_000) -> Column:
    """Up to count blocks of up to `each` characters, ruled off from each other, up to `most` in all."""
    return F.substring(F.array_join(F.transform(F.slice(blocks, 1, count), lambda b: F.substring(b, 1, each)), "\n\n---\n\n"), 1, most)


def json_strings(json_text: Column | str, most: int = 120, each: int = 1_000) -> Column:
    """String values of JSON text (not its keys), in order."""
    values = F.regexp_extract_all(col(json_text), F.lit(r'[:\[,]\s*"((?:[^"\\]|\\.)*)"(?!\s*:)'), F.lit(1))
    clean = F.filter(F.transform(values, lambda v: F.substring(F.trim(v), 1, each)), lambda v: v != "")
    return F.slice(clean, 1, most)


def first_json_object(x: Column | str) -> Column:
    """From the first { to the last }, if that parses."""
    found_text = F.regexp_extract(col(x), r"(?s)\{.*\}", 0)
    return F.when((found_text != "") & F.try_parse_json(found_text).isNotNull(), found_text)


def compact_count(n: Column | str) -> Column:
    """1.2M, 3.0K, 812."""
    n = col(n).cast("double")
    shown = lambda x, s: F.concat(F.format_string("%.1f", x), F.lit(s))
    return F.when(n >= 1e6, shown(n / 1e6, "M")).when(n >= 1e3, shown(n / 1e3, "K")).otherwise(n.cast("long").cast("string"))


def percent(x: Column | str) -> Column:
    """A share as 3.2%; a dash where there is none."""
    x = col(x).cast("double")
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.concat(F.format_string("%.1f", x * 100), F.lit("%")))


def source_label(x: Column | str) -> Column:
    """Short name of a creator's source."""
    low = F.lower(F.coalesce(col(x), F.lit("")))
    return F.when(low == "", "unknown").when(F.contains(low, F.lit("synthetic")), "synthetic").when(F.contains(low, F.lit("stan_pipeline")), "stan pipeline").otherwise(F.replace(low, F.lit("_"), F.lit(" ")))


def quick_replies(text: Column | str) -> Column:
    """The options A to D that a text lists line by line, up to four; null if there is one at most."""
    options = F.filter(F.transform(lines(text), lambda s: F.trim(F.regexp_extract(s, r"(?i)^[A-D][).:-]\s*(.+)$", 1))), lambda s: s != "")
    return F.when(F.size(options) >= 2, F.slice(options, 1, 4))


def profile_name(title: Column | str) -> Column:
    """The name in a store page's title."""
    clean = F.trim(F.regexp_replace(clean_text(title, 200), r"(?i)\|\s*stan.*$", ""))
    before = F.trim(F.regexp_extract(clean, r"^(.*?)\s*\(@", 1))
    return F.substring(F.nullif(F.coalesce(F.nullif(before, F.lit("")), clean), F.lit("")), 1, 120)


def title_handle(title: Column | str) -> Column:
    """The handle in a page's title: (@handle)."""
    return F.substring(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(col(title), r"\(@([^)]+)\)", 1), "^@+", "")), F.lit("")), 1, 80)


def follower_band(n: Column | str) -> Column:
    n = col(n).cast("double")
    whole = lambda x: F.floor(x).cast("string")
    return (
        F.when(n.isNull() | (n <= 0), "~1k").when(n >= 1e6, F.concat(whole(n / 1e6), F.lit("M+"))).when(n >= 1e4, F.concat(whole(n / 1e3), F.lit("k+")))
        .when(n >= 1e3, F.concat(F.lit("~"), whole(n / 1e3 + 0.5), F.lit("k"))).otherwise("~1k")
    )


