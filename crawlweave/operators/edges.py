"""From links to admitted addresses and a deduplicated discovery graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlweave.functions import extract

EDGE_KEY = ("crawl_run_id", "from_url_id", "normalized_discovered_url", "source")


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The other columns of pages and place, source, discovered_url, normalized_discovered_url, anchor of every accepted link; each page is parsed once."""
    own = [c for c in pages.columns if c not in (url, html)]
    kept = pages.select(*own, url, html)
    return kept.mapInArrow(extract.link_rows(len(own)), T.StructType([*kept.schema.fields[: len(own)], *extract.LINK_FIELDS]))


def decided(scope: Column, depth: Column, max_depth: int | None, known: Column, room: Column) -> Column:
    """skip_reason of a candidate: scope, depth, limit or null, in that order. A known address needs no room."""
    deep = F.lit(False) if max_depth is None else depth > max_depth
    return F.when(~scope, "scope").when(deep, "depth").when(~known & ~room, "limit")


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by order; an aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    least = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return least.select(*keys, *[F.col(f"r.{c}").alias(c) for c in (*order, *rest)])


def admitted(new: DataFrame, key: str, order: str, room: int | None) -> DataFrame:
    """The first `room` new addresses by order; a top-k, not a window over all rows."""
    firsts = new.groupBy(key).agg(F.min(order).alias(order))
    return firsts if room is None else firsts.orderBy(order).limit(max(0, room))


def folded(edges: DataFrame, order: str) -> DataFrame:
    """Repeated observations of an edge as one: last known target, last flags, first address and time."""
    return edges.groupBy(*EDGE_KEY).agg(
        F.max_by("to_url_id", F.when(F.col("to_url_id").isNotNull(), F.col(order))).alias("to_url_id"),
        F.max_by("in_scope", order).alias("in_scope"),
        F.max_by("skip_reason", F.struct(order)).alias("skip_reason"),
        F.min_by("discovered_url", order).alias("discovered_url"),
        F.min(order).alias(order),
    )


def upserted(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """old edges with new observations."""
    return merged(old, folded(new, order), order)


def merged(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """old edges with folded new ones: targets are kept unless a new one is known, flags are replaced, first addresses stay."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, list(EDGE_KEY), "full_outer")
    newer = lambda c: F.when(F.col(f"n.{order}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return both.select(*EDGE_KEY, F.coalesce("n.to_url_id", "o.to_url_id").alias("to_url_id"), newer("in_scope"), newer("skip_reason"), F.coalesce("o.discovered_url", "n.discovered_url").alias("discovered_url"), F.coalesce(f"o.{order}", f"n.{order}").alias(order))


def best_of_duplicates(edges: DataFrame, keys: list[str], target: str, created: str) -> DataFrame:
    """The one edge of each key that a clean-up keeps: with a target before without, then the oldest."""
    w = Window.partitionBy(*keys).orderBy(F.col(target).isNotNull().desc(), F.col(created))
    return edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
