"""Pages, arrays of members, pruning, revisions, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list, number: int, size: int) -> tuple[DataFrame, int, int]:
    """A page of rows in a total order, the number of rows, and of pages."""
    if number < 1 or size < 1:
        raise ValueError("pages and their size count from 1")
    total = rows.count()
    return rows.orderBy(*order).offset((number - 1) * size).limit(size), total, -(-total // size)


def with_members(rows: DataFrame, links: DataFrame, key: str, member: str, name: str) -> DataFrame:
    """``name``: the sorted members of each row's key, empty where there are none."""
    lists = links.groupBy(key).agg(F.sort_array(F.collect_set(member)).alias(name))
    none = F.expr(f"cast(array() AS array<{dict(links.dtypes)[member]}>)")
    return rows.join(lists, key, "left").withColumn(name, F.coalesce(name, none))


def prune_lru(entries: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """Keys to delete: the least recently used, until count and bytes both fit.

    Ages fall into days; days that go or stay whole are told by running sums over one row a
    day, and only the days in which a limit is reached are ordered entry by entry.
    """
    age = F.coalesce("last_hit_at", "updated_at", "created_at")
    dated = entries.select("cache_key", "result_size", age.alias("at")).withColumn("day", F.to_date("at"))
    days = dated.groupBy("day").agg(F.count("*").alias("n"), F.sum("result_size").alias("bytes"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row a day
    whole = Window.partitionBy()
    summed = days.select(
        "day",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.greatest(F.sum("n").over(whole) - most, F.lit(0)).alias("n_excess"),
        F.greatest(F.sum("bytes").over(whole) - most_bytes, F.lit(0)).alias("bytes_excess"),
    ).filter("n_before < n_excess OR bytes_before < bytes_excess")
    inside = Window.partitionBy("day").orderBy("at", "cache_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = dated.join(summed, "day").select(
        "cache_key",
        (F.col("n_before") + F.count("*").over(inside)).alias("n"),
        (F.col("bytes_before") + F.coalesce(F.sum("result_size").over(inside), F.lit(0))).alias("bytes"),
        "n_excess",
        "bytes_excess",
    )
    return placed.filter("n < n_excess OR bytes < bytes_excess").select("cache_key")


def keep_newest(jobs: DataFrame, most: int, key: str, at: str) -> DataFrame:
    """Keys of finished jobs beyond the newest ``most``: those not among the top of a total order."""
    finished = jobs.filter(F.col("status").isin("succeeded", "failed", "cancelled"))
    kept = finished.orderBy(F.desc(at), F.desc(key)).limit(most).select(key)
    return finished.join(kept, key, "left_anti").select(key)


def status_counters(sources: DataFrame) -> DataFrame:
    def of(column: str, value: str) -> Column:
        return F.count_if(F.col(column) == value).alias(f"{column.removesuffix('_status')}_{value}")

    states = ("pending", "ready", "failed")
    return sources.agg(F.count("*").alias("sources"), *[of(c, s) for c in ("graph_status", "rag_status") for s in states])


def revision(tables: list[tuple[str, DataFrame]]) -> str:
    """A digest that changes with any row of the tables, whatever their order or partitioning.

    Row digests are summed in four words, so each table needs one aggregate and no sorting.
    """
    out = []
    for name, rows in tables:
        whole = F.sha2(F.to_json(F.struct(*sorted(rows.columns))), 256)
        word = lambda i: F.sum(F.conv(F.substring(whole, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))  # noqa: B023, E731
        out.append((name, *[str(x) for x in rows.agg(F.count("*"), *[word(i) for i in range(4)]).first()]))
    import hashlib

    return hashlib.sha256(repr(out).encode()).hexdigest()


def cache_key(mode: Column, query: Column, state: Column, config: Column, params: Column) -> Column:
    return F.sha2(F.concat_ws("|", mode, query, state, config, params), 256)
