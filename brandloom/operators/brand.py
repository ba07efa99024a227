"""Brands: intake forms, free-text intent, dossiers, page bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import distinct_texts, round_half_up
from ..functions.text import bundle, contains_any, held_word, labels, phrase, spaced
from ..plans import rules


def _first(text: Column, cases) -> Column:
    out = None
    for condition, label in cases:
        out = F.when(condition(text), label) if out is None else out.when(condition(text), label)
    return out


def _like(pattern: str, marks: tuple[str, ...]):
    """Whether a pattern is met, tried only where one of its marks stands."""
    return lambda x: contains_any(x, *marks) & F.regexp_like(x, F.lit(pattern))


def partnership(text: Column, words: Column | None = None) -> Column:
    """words: spaced(text), if it is known."""
    words = spaced(text) if words is None else words
    return _first(text, [((lambda w: lambda x: held_word(x, words, w))(w), label) for w, label in rules.PARTNERSHIP_WORDS])


def compensation(text: Column) -> Column:
    return _first(text, [(_like(pattern, marks), label) for label, pattern, marks in rules.COMPENSATION_WORDS])


def unit(text: Column) -> Column:
    return _first(text, [(_like(pattern, marks), label) for label, pattern, marks in rules.UNIT_WORDS])


def budget(text: Column, strict: bool = False) -> Column:
    """An amount after a dollar sign, else, where money is spoken of, the first number of two to six digits."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    dollars = F.when(F.contains(text, F.lit("$")), F.nullif(F.regexp_extract(bare, r"\$\s*(\d+(?:\.\d+)?)", 1), F.lit("")))
    amount = round_half_up(dollars.try_cast("double")).cast("long")
    if strict:
        return amount
    spoken = contains_any(F.lower(bare), *rules.SPEND_WORDS) | _like(*rules.SPEND_PER)(F.lower(bare))
    number = F.nullif(F.regexp_extract(bare, r"(?:^|[^A-Za-z0-9_])(\d{2,6})(?:\.\d+)?(?:[^A-Za-z0-9_]|$)", 1), F.lit(""))
    return F.coalesce(amount, F.when(spoken, number.try_cast("long")))


def intent(df: DataFrame, text: str) -> DataFrame:
    """df with partnership, compensation, unit, amount, open_budget, goals and platforms, read from free text."""
    low, words = F.col("__low"), F.col("__words")
    staged = df.withColumn("__low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn("__words", spaced(low)).withColumn("compensation", compensation(low))
    is_open = contains_any(low, *rules.NO_BUDGET)
    return staged.withColumns({
        "partnership": partnership(low, words), "compensation": F.col("compensation"), "unit": F.coalesce(unit(low), F.when(F.col("compensation") == "cpm", "per_1k_views")),
        "amount": F.when(~is_open, budget(F.coalesce(F.col(text), F.lit("")))), "open_budget": is_open,
        "goals": labels(*[(held_word(low, words, w), g) for w, g in rules.GOAL_WORDS]), "platforms": labels(*[(held_word(low, words, w), p) for p, w in rules.PLATFORM_WORDS]),
    }).drop("__low", "__words")


def intake_signals(df: DataFrame) -> DataFrame:
    """df (partnership, compensation, amount, unit, goals, platforms of a form) with goal_signals, angle_signals and topic_signals."""
    pick = lambda table, key, k: _first(F.col(key), [((lambda name: lambda x: x == name)(name), v[k]) for name, v in table.items()])
    lists = lambda *xs: distinct_texts(F.array_compact(F.concat(*xs)), fold=False)
    said = lambda prefix, c: F.concat(F.lit(prefix), c)
    per = F.coalesce(F.replace(F.col("unit"), F.lit("_"), F.lit(" ")), F.lit("per video"))
    paid = F.when(F.col("amount") > 0, F.concat(F.lit("$"), round_half_up("amount").cast("long"), F.lit(" "), per))
    p, c = rules.PARTNERSHIPS, rules.COMPENSATIONS
    return df.withColumns({
        "goal_signals": lists(F.array(pick(p, "partnership", 1), pick(c, "compensation", 1)), F.col("goals")),
        "angle_signals": lists(
            F.array(said("preferred collaboration: ", pick(p, "partnership", 0)), said("preferred compensation model: ", pick(c, "compensation", 0))),
            F.transform("goals", lambda g: said("campaign goal priority: ", g)), F.transform("platforms", lambda x: said("preferred platform: ", x)), F.array(said("target payout: ", paid)),
        ),
        "topic_signals": lists(F.array(pick(p, "partnership", 2), pick(c, "compensation", 2), said("creator rate ", paid))),
    })


def merge_dossier(existing: DataFrame, profile: DataFrame, key: str, lists: list[str], summary: str | None = None, suffix: str | None = None) -> DataFrame:
    """existing with the profile's lists added, first casing kept; the suffix is put after a summary that lacks it."""
    new = profile.select(key, *[F.col(c).alias(f"__{c}") for c in lists])
    out = existing.join(new, key, "left").withColumns({c: distinct_texts(F.concat(F.coalesce(c, F.array().cast("array<string>")), F.coalesce(f"__{c}", F.array().cast("array<string>"))), fold=False) for c in lists})
    if summary and suffix:
        out = out.withColumn(summary, F.when(F.contains(F.col(summary), F.lit(suffix)), F.col(summary)).otherwise(F.trim(F.concat_ws(" ", summary, F.lit(suffix)))))
    return out.drop(*[f"__{c}" for c in lists])


def page_bundle(pages: DataFrame, key: str, order: str, text: str, each: int, count: int, most: int = 13_000) -> DataFrame:
    """The first `count` texts of each key as one bundle; rows past them are dropped before anything is gathered."""
    from .ranking import top_k

    first = top_k(pages, [key], [F.col(order)], count, "__rank").withColumn("__cut", F.substring(text, 1, each))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("__rank", "__cut"))), lambda b: b["__cut"])
    return first.groupBy(key).agg(bundle(blocks, each, count, most).alias("bundle"))


def first_source(*sources: Column) -> Column:
    """The first source that has text."""
    return F.coalesce(*[F.nullif(F.trim(s), F.lit("")) for s in sources])


def _chunks(phrases: Column) -> Column:
    """What phrases list, cleaned: no stop words, nothing short, nothing that only asks."""
    parts = F.flatten(F.transform(phrases, lambda p: F.split(p, r"(?i),|/|&|(?<![a-z0-9_])and(?![a-z0-9_])")))
    bare = F.transform(parts, lambda p: F.trim(F.regexp_replace(F.regexp_replace(phrase(p), "^(for|about|around|the|some|more|mostly|with) ", ""), " (for|audiences?|content|profiles?)$", "")))
    noise = F.array(*map(F.lit, rules.PRIORITY_NOISE))
    return F.filter(bare, lambda p: (F.length(p) >= 3) & ~p.isin(*rules.PRIORITY_STOP) & ~F.arrays_overlap(F.split(p, " "), noise))


def priority_niches(text: Column | str, most: int = 6) -> Column:
    """The niches of creators that a text asks for."""
    text = F.col(text) if isinstance(text, str) else text
    asked = r"(?i)(?<![A-Za-z0-9_])(?:looking for|look for|need|want|seeking|searching for|priorit(?:ize|ise)|focus(?:ing)? on|lean(?:ing)? into)\s+([a-z0-9][a-z0-9\s,&/+-]{1,56}?)\s+(?:influencers|creators)(?![A-Za-z0-9_])"
    named = r"(?i)(?<![A-Za-z0-9_])([a-z0-9][a-z0-9\s,&/+-]{1,36}?)\s+(?:influencers|creators)(?![A-Za-z0-9_])"
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (asked, named)])
    return F.slice(F.array_distinct(_chunks(found)), 1, most)


def priority_topics(text: Column | str, niches: Column, most: int = 8) -> Column:
    """The niches, and the topics that a text asks to be covered."""
    text = F.col(text) if isinstance(text, str) else text
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:content about|topics around|focus on topics|covering)\s+([a-z0-9][a-z0-9\s,&/+-]{1,56})(?=$|[.!?,])"
    return F.slice(F.array_distinct(F.concat(niches, _chunks(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))))), 1, most)


def site_searches(df: DataFrame, host: str, name: str) -> DataFrame:
    """df with one row for each search over the brand's own site (label, query, place); the brand's name goes first where it is known."""
    site = F.concat(F.lit("site:"), F.col(host), F.lit(" "))
    one = lambda label, words: F.struct(F.lit(label).alias("label"), F.concat(site, words).alias("query"))
    fixed = F.array(*[one(label, F.lit(words)) for label, words in rules.SITE_SEARCHES])
    named = F.trim(F.coalesce(name, F.lit("")))
    with_name = F.concat(F.array(one("brand-overview", F.concat(F.lit('"'), named, F.lit('"')))), fixed)
    return df.select("*", F.posexplode(F.when(named == "", fixed).otherwise(with_name)).alias("place", "__s")).select("*", "__s.*").drop("__s")


def web_searches(df: DataFrame, host: str, name: str) -> DataFrame:
    """df with one row for each search on the open web (query, place)."""
    named = F.coalesce(F.nullif(F.trim(F.col(name)), F.lit("")), F.col(host))
    return df.select("*", F.posexplode(F.array(*[F.concat(named, F.lit(f" {words}")) for words in rules.WEB_SEARCHES])).alias("place", "query"))


def analysis_source(df: DataFrame, pages: str, fetched: str, searched: str, site: str, web: str, challenged: str) -> DataFrame:
    """df with source and context: the first of its texts that is there. A challenged site is searched for before it is read again."""
    order = lambda names: [F.when(F.trim(F.col(n)) != "", F.struct(F.lit(n).alias("source"), F.col(n).alias("context"))) for n in names]
    plain, shut = F.coalesce(*order([pages, fetched, site, searched, web])), F.coalesce(*order([pages, fetched, searched, site, web]))
    found = F.when(F.coalesce(F.col(challenged), F.lit(False)), shut).otherwise(plain)
    return df.withColumn("source", F.coalesce(found["source"], F.lit("model"))).withColumn("context", found["context"])
