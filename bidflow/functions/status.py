"""Statuses as portals print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidflow.functions.text import bound

# Patterns of each status; the first that a text contains decides.
PATTERNS = {
    "OPEN": ["open", "active", "accepting", "in progress", "pending", "current", "live", "ongoing", "available", "accepting bids", "accepting quotes", "accepting proposals", "open for bid", "open for quote", "bidding open"],
    "CLOSED": ["closed", "ended", "expired", "deadline passed", "no longer accepting", "bidding closed", "submission closed", "past deadline", "time expired"],
    "AWARDED": ["awarded", "award", "winner selected", "contract awarded", "vendor selected", "successful bidder", "awardee"],
    "CANCELLED": ["cancelled", "canceled", "withdrawn", "rescinded", "voided", "terminated", "discontinued", "abandoned"],
    "PENDING": ["pending", "under review", "in review", "evaluation", "being evaluated", "under evaluation", "in evaluation"],
}
ORDER = ["OPEN", "CLOSED", "AWARDED", "CANCELLED", "PENDING", "UNKNOWN"]


def parse_status(c: Column, default: str = "UNKNOWN") -> Column:
    """Struct of status and confidence: 0.95 for the pattern itself, 0.85 for a text with it, 0.7 for four fifths of its words."""
    each = [(status, p) for status, patterns in PATTERNS.items() for p in patterns]
    none = lambda sure: F.struct(F.lit(default).alias("status"), F.lit(sure).alias("confidence"))

    def of(text: Column) -> Column:
        held = [F.when(F.contains(text, F.lit(p)), F.struct(F.lit(s).alias("status"), F.when(text == p, 0.95).otherwise(0.85).alias("confidence"))) for s, p in each]

        def near(words: Column) -> Column:
            found = [
                F.when(F.size(F.array_intersect(words, F.array(*(F.lit(w) for w in dict.fromkeys(p.split()))))) >= 0.8 * len(set(p.split())), F.struct(F.lit(s).alias("status"), F.lit(0.7).alias("confidence")))
                for s, p in each
                if len(p.split()) > 1
            ]
            return F.coalesce(*found, none(0.3))

        return F.when(F.coalesce(text, F.lit("")) == "", none(0.0)).otherwise(F.coalesce(*held, bound(F.split(text, r"\s+"), near)))

    return bound(F.lower(F.trim(c)), of)


def inferred(status: Column, closing: Column, awarded: Column, as_of: Column) -> Column:
    """A given status, else what the dates say."""
    return F.coalesce(status, F.when(awarded.isNotNull(), "AWARDED"), F.when(closing > as_of, "OPEN"), F.when(closing.isNotNull(), "CLOSED"), F.lit("UNKNOWN"))


# Exact texts of a status, of a table apart from the patterns above.
EXACT = {
    "OPEN": [
        "open", "active", "accepting bids", "accepting responses", "accepting submissions", "in progress", "current", "live", "available", "published", "posted", "issued", "advertised", "pending",
        "pending award", "under review", "evaluation", "bidding",
    ],
    "CLOSED": ["closed", "bid closed", "submissions closed", "response closed", "ended", "complete", "completed", "finished", "past due", "no longer accepting"],
    "AWARDED": ["awarded", "award made", "contract awarded", "winner selected", "selected", "award complete", "under contract"],
    "EXPIRED": ["expired", "lapsed", "past", "outdated", "stale"],
    "CANCELLED": ["cancelled", "canceled", "withdrawn", "revoked", "terminated", "void", "deleted", "removed"],
}


def exact_status(c: Column) -> Column:
    known = F.create_map(*(F.lit(x) for status, texts in EXACT.items() for text in texts for x in (text, status)))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(c))), F.lit("UNKNOWN"))
