"""Pages as input tables: a brand's pages, and store pages, read into columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import urls as u
from ..plans import rules
from .discovery import hrefs
from .importer import store_confidence
from .ranking import top_k
from .upsert import insert_absent


def brand_pages(saved: DataFrame, fetched: DataFrame, order: str, most: int = 6, clip: int = 35_000, least: int = 400) -> DataFrame:
    """saved (brand_id, url, title, text, n) with the fetched pages put in that aren't there: the first pages of a brand, clipped, without near-empty ones."""
    first = top_k(fetched, ["brand_id"], [F.col(order)], most, "__rank").drop("__rank")
    clipped = first.withColumn("text", F.substring(t.clean_text("text", 1 << 30), 1, clip)).withColumn("n", F.length("text").cast("long")).where(F.col("n") >= least)
    return insert_absent(saved, clipped.withColumn("title", F.nullif("title", F.lit(""))), ["brand_id", "url"], [F.col(order)])


def useful_outbound(links: Column) -> Column:
    """Links to other sites than the store's own, its helpers' and search engines'."""
    own = "|".join(h.replace(".", r"\.") for h in rules.OWN_HOSTS)
    return F.filter(links, lambda x: u.host(x).isNotNull() & ~F.regexp_like(u.host(x), F.lit(own)) & ~u.on_host(u.host(x), u.STORE_HOST))


def social_links(links: Column, most: int = 30) -> Column:
    return F.slice(F.array_distinct(F.filter(links, lambda x: F.regexp_like(x, F.lit(rules.SOCIAL_LINKS)))), 1, most)


def _meta(page: Column, name: str) -> Column:
    tag = F.regexp_extract(page, rf"""(?is)<meta\s[^>]*(?:name|property)\s*=\s*["']{name}["'][^>]*>""", 0)
    return F.nullif(F.trim(F.regexp_extract(tag, r"""(?is)content\s*=\s*["']([^"']*)["']""", 1)), F.lit(""))


def store_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """pages with profile_name, handle, bio, outbound, socials, emails, prices, product_types, cta, image and confidence."""
    page = F.col(html)
    said = t.html_to_text(page)
    links = F.array_distinct(F.filter(F.transform(hrefs(page), lambda h: u.resolved(h, F.col(url))), lambda x: u.host(x).isNotNull()))
    out = pages.withColumns({"__said": said, "__title": F.nullif(F.trim(t.html_title(page)), F.lit("")), "__links": links})
    out = out.withColumns({
        "profile_name": t.profile_name("__title"), "handle": t.title_handle("__title"), "bio": _meta(page, "(?:og:)?description"), "outbound": useful_outbound(F.col("__links")), "emails": t.emails("__said"), "prices": t.prices("__said"),
        "product_types": t.product_types("__said", "page"), "cta": t.cta_style("__said", "page"), "image": _meta(page, "og:image"), "__offers": t.offer_candidates(page, F.col("__said")),
    })
    out = out.withColumn("socials", social_links(F.col("outbound")))
    n = lambda c: F.size(c)
    has = {
        "name": F.col("profile_name").isNotNull(), "bio": F.col("bio").isNotNull(), "offers": n("__offers") > 0, "prices": n("prices") > 0, "types": n("product_types") > 0, "socials": n("socials") > 0, "image": F.col("image").isNotNull(),
        "email": n("emails") > 0, "offers3": n("__offers") >= 3, "prices2": n("prices") >= 2,
    }
    return out.withColumn("offers", F.col("__offers")).withColumn("confidence", store_confidence("page", **has)).drop("__said", "__title", "__links", "__offers")
