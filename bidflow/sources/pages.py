"""Predicates and projections over fetched pages (url, html, status_code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidflow.scratch import discard, stored

# Signs of a block page, and markers of each kind of pagination.
BLOCK_WORDS = ["captcha", "access denied", "blocked", "unusual traffic", "are you a robot", "verify you are human", "cloudflare"]
BLOCK_STATUS = [403, 406, 418, 451]
BLOCK_LENGTH = 50_000
PAGINATION = [
    ("infinite_scroll", ["infinite-scroll", "infinitescroll", "data-infinite"]),
    ("load_more", ["load more", "load-more", "show more"]),
    ("next_button", ['aria-label="next', 'title="next', 'rel="next"', 'class="next', ">next<", "page-next", 'data-page="next']),
]


def contains_any(c: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(c, F.lit(w))
    return found


def blocked(html: Column, status: Column | None = None) -> Column:
    words = (F.length(html) < BLOCK_LENGTH) & contains_any(F.lower(html), BLOCK_WORDS)
    return words if status is None else status.isin(BLOCK_STATUS) | words


def fetch_result(pages: DataFrame, status: Column) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    return pages.select("page_id", status.between(200, 299).alias("ok"), F.octet_length(html).cast("long").alias("content_length"), blocked(html, status).alias("is_blocked"), (status == 429).alias("rate_limited"))


def pagination_type(html: Column) -> Column:
    low = F.lower(html)
    return F.coalesce(*(F.when(contains_any(low, words), F.lit(kind)) for kind, words in PAGINATION), F.lit("none"))


def external_id_of(url: Column, text: Column) -> Column:
    """Last path segment of four characters or more, else a query key, else a code in the text."""
    path = F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/+$", "")
    last = F.element_at(F.split(path, "/"), -1)
    query = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit("")), r"(?:^|&)(?:id|bid|posting|opportunity)=([^&]+)", 1)
    code = F.regexp_extract(text, r"\b[A-Z]{2,}-\d{2,}[A-Z0-9-]*\b", 0)
    return F.coalesce(F.when(F.length(last) >= 4, last), F.nullif(query, F.lit("")), F.nullif(code, F.lit("")))


def totals(text: Column) -> Column:
    """Struct of first, last and total of a line such as ``1-25 of 1,448``."""
    pattern = r"(\d+)\s*-\s*(\d+) of ([\d,]+)"
    part = lambda i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit("")).try_cast("int")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total"))


# Words of each type of page, tried in this order.
PAGE_TYPES = [
    ("error_page", ["internal server error", "404 not found", "page not found", "service unavailable"]),
    ("empty_results", ["no results", "0 results", "no records found", "nothing found", "no opportunities"]),
]


def page_type(html: Column) -> Column:
    """error_page, empty_results, results_table, results_cards, search_form or unknown, by words and elements of the page."""
    low = F.lower(html)
    rows, cards = F.regexp_count(low, F.lit("<tr[ >]")), F.regexp_count(low, F.lit(r"class=[\"'][^\"']*(card|result-item|listing-item)"))
    told = [F.when(contains_any(low, words), F.lit(kind)) for kind, words in PAGE_TYPES]
    return F.coalesce(*told, F.when(rows >= 3, "results_table"), F.when(cards >= 3, "results_cards"), F.when(F.contains(low, F.lit("<form")) & low.rlike("type=.?(search|text)"), "search_form"), F.lit("unknown"))


def page_chain(links: DataFrame, start: DataFrame, most: int) -> DataFrame:
    """(start_id, page_id, depth): what following next_id from each start page visits, at most ``most`` pages each and none twice.

    Pointers double: a round knows where 2**k steps lead from every page, and takes all pages of a chain
    that far on, so rounds grow with the logarithm of ``most``, and a row is a page of a chain, not a chain. A page that a chain comes to again keeps
    its first place, and the chain ends there. If a page has several next pages the least counts. Rounds are stored, so plans stay short.
    """
    jump = stored(links.where("next_id is not null").groupBy("page_id").agg(F.min("next_id").alias("to")), "page-jumps")
    chains = stored(start.select(F.col("page_id").alias("start_id"), "page_id", F.lit(1).alias("depth")).distinct(), "page-chains")
    step = 1
    while step < most:
        onward = chains.where(F.col("depth") + step <= most).join(jump, "page_id").select("start_id", F.col("to").alias("page_id"), (F.col("depth") + step).alias("depth"))
        longer = stored(chains.unionByName(onward).groupBy("start_id", "page_id").agg(F.min("depth").alias("depth")), "page-chains")
        ended = longer.agg(F.max("depth")).first()[0]
        discard(chains)
        chains, step = longer, 2 * step
        if ended is None or ended < step:  # no chain goes on
            break
        if step < most:
            further = stored(jump.select("page_id", F.col("to").alias("via")).join(jump.withColumnRenamed("page_id", "via"), "via").select("page_id", "to"), "page-jumps")
            discard(jump)
            jump = further
    discard(jump)
    return chains
