"""Organisation cards from crawled listing pages, as a Spark job over a
(page_id, url, html) table.  Every anchor of every page is extracted with
built-in regular expressions; a card is an anchor with a single-segment
``/slug`` href whose text carries a follower count.  The first page (then
the first anchor) wins per slug, chosen with ``min_by`` so a slug linked
from every page is reduced map-side instead of windowed in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import parse_abbrev

# FIXED VALUES: card patterns of the listing page.
ANCHOR_RE = r"(?s)(<a\s[^>]*>.*?</a>)"
HREF_RE = r"""href="([^"]*)\""""
TYPE_SPAN_RE = r"""(?s)<span[^>]*class="[^"]*\bcapitalize\b[^"]*"[^>]*>(.*?)</span>"""
BADGE_SPAN_RE = r"""(?s)<span[^>]*class="[^"]*-skew-x-12[^"]*"[^>]*>(.*?)</span>"""
FOLLOWERS_RE = r"(?i)([\d.,]+\s*[km]?)\s*followers?\b"
MODELS_RE = r"(?i)([\d.,]+\s*[km]?)\s*models?\b"


def _text(html_col):
    """Visible text: tags replaced by spaces, whitespace collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(html_col, r"<[^>]+>", " "), r"\s+", " "))


def extract_org_cards(pages: DataFrame) -> DataFrame:
    a = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR_RE), 1)).alias("pos", "a"))
    href = F.regexp_extract("a", HREF_RE, 1)
    a = a.withColumn("href", href).filter(F.col("href").startswith("/") & ~F.substring("href", 2, 1 << 30).contains("/"))
    text = _text(F.col("a"))
    fol = F.regexp_extract(text, FOLLOWERS_RE, 1)
    mod = F.regexp_extract(text, MODELS_RE, 1)
    ty = F.lower(_text(F.regexp_extract("a", TYPE_SPAN_RE, 1)))
    badge = _text(F.regexp_extract("a", BADGE_SPAN_RE, 1))
    cards = a.select(
        "page_id", "pos", F.substring("href", 2, 1 << 30).alias("slug"),
        F.when(ty != "", ty).alias("org_type"),
        F.when(mod != "", parse_abbrev(mod)).otherwise(F.lit(0).cast("long")).alias("model_count"),
        fol.alias("_fol"), F.when(badge != "", badge).alias("badge"),
    ).filter(F.col("_fol") != "").withColumn("followers", parse_abbrev("_fol")).drop("_fol")
    first = F.min_by(F.struct("org_type", "model_count", "followers", "badge"), F.struct("page_id", "pos"))
    return cards.groupBy("slug").agg(first.alias("c")).select("slug", "c.*")
