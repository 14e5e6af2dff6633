"""Plug-ins of portals: how each type of portal reads its listing and detail pages and finds its way on.

A plug-in is three functions over DataFrames of pages; a portal's configuration names its type. The pages of all
portals go together: one pass a plug-in over the pages of its type, not one a portal.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidflow.sources import html, pages, selectors, variant

Pages = Callable[[DataFrame], DataFrame]


def told_pagination(found: DataFrame) -> DataFrame:
    """(page_id, pagination, strategy, selector, disabled, next_url) of pages (page_id, url, html)."""
    kinds = found.select(F.col("page_id").cast("long").alias("page_id"), pages.pagination_type(F.col("html")).alias("pagination"))
    return kinds.join(selectors.next_selectors(found), "page_id").join(html.next_pages(found), "page_id")


def api_pagination(found: DataFrame) -> DataFrame:
    """The next page that a JSON answer names (next, next_url, links.next, paging.next)."""
    payload = F.try_parse_json("html")
    link = F.coalesce(*(F.try_variant_get(payload, f"$.{p}", "string") for p in ("next", "next_url", "links.next", "paging.next")))
    none = F.lit(None).cast("string")
    told = found.select(F.col("page_id").cast("long").alias("page_id"), "url", link.alias("link"))
    return told.select("page_id", F.when(F.col("link").isNotNull(), "next_link").otherwise("none").alias("pagination"), none.alias("strategy"), none.alias("selector"), none.cast("boolean").alias("disabled"), variant.absolute(F.col("url"), F.col("link")).alias("next_url"))


@dataclass(frozen=True)
class Plugin:
    """listing: pages to records; detail: pages to one record each; pagination: pages to what leads on."""

    listing: Pages = html.extract
    detail: Pages = html.details
    pagination: Pages = told_pagination


#: Portal types, and the plug-in of each; a table of one's own may replace or add some.
PLUGINS: dict[str, Plugin] = {"generic_table": Plugin(), "generic_cards": Plugin(), "search_form": Plugin(), "custom": Plugin(), "api_based": Plugin(listing=variant.json_records, pagination=api_pagination)}


def dispatched(found: DataFrame, portals: DataFrame, what: str, plugins: Mapping[str, Plugin] = PLUGINS) -> DataFrame:
    """What the plug-ins of the portals' types make of their pages (portal_id, page_id, url, html), with portal_id; portals: portal_id, portal_type.

    Pages of unknown portals and of types without a plug-in are left alone. Types that share a function are read in one pass.
    """
    typed = found.join(portals.select("portal_id", "portal_type"), "portal_id")
    by: dict[Pages, list[str]] = {}
    for name, plugin in plugins.items():
        by.setdefault(getattr(plugin, what), []).append(name)
    out = None
    for run, names in by.items():
        own = run(typed.where(F.col("portal_type").isin(names)).select("page_id", "url", "html"))
        out = own if out is None else out.unionByName(own)
    return out.join(found.select(F.col("page_id").cast("long").alias("page_id"), "portal_id"), "page_id")
