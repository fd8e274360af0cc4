"""Fetch-run bookkeeping: latest runs, freshness, outcomes, source status.

Latest-per-key is an aggregation (``max_by`` over a struct ordering), not a
window: partial aggregation keeps one candidate per key per task, so a
source with a third of all runs costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from grantflow.functions.dates import age_days, display_ts, is_fresh
from grantflow.functions.ids import run_key, run_label

OUTCOMES = ["success", "skipped", "failed"]


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` tuple per ``keys`` (ties broken by
    the following columns, so the result is deterministic)."""
    rest = [c for c in df.columns if c not in keys]
    ordered = list(order) + [c for c in rest if c not in order]
    best = F.max(F.struct(*[F.col(c) for c in ordered])).alias("__best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__best.{c}").alias(c) for c in rest])


def successful(runs: DataFrame, status: str = "status") -> DataFrame:
    """Only a successful run is a download; failed and skipped runs neither
    renew freshness nor move the last-download marker."""
    return runs.filter(F.col(status) == "success")


def with_freshness(df: DataFrame, ts: str, as_of: Column, max_age_days: float = 7,
                   force: bool = False) -> DataFrame:
    """Adds ``age_days`` (rounded to 0.1) and ``fresh`` (unrounded age <= max)."""
    return df.withColumns({
        "age_days": F.round(age_days(ts, as_of), 1),
        "fresh": is_fresh(ts, as_of, max_age_days, force),
    })


def outcome_counts(df: DataFrame, status: str = "status") -> DataFrame:
    """One row: ``n_success, n_skipped, n_failed, n_total``."""
    aggs = [F.count_if(F.col(status) == o).alias(f"n_{o}") for o in OUTCOMES]
    return df.agg(*aggs, F.count(F.lit(1)).alias("n_total"))


def outcome_rows(df: DataFrame, id_col: str, status: str = "status") -> DataFrame:
    """Per-outcome id lists in long form ``(outcome, id)`` — one row per id
    instead of one unbounded array per outcome."""
    return df.select(F.col(status).alias("outcome"), F.col(id_col).alias("id")).distinct()


def select_known(requested: DataFrame, known: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(requested ids that exist, requested ids that do not) — semi / anti join."""
    k = known.select(key).distinct()
    return requested.join(k, key, "left_semi"), requested.join(k, key, "left_anti")


def source_status(catalog: DataFrame, runs: DataFrame, as_of: Column,
                  root: str = "raw") -> DataFrame:
    """Status row per (catalog source, action): catalog ⟕ latest successful
    run of the action.

    ``catalog``: source_id, action, funder, format.  ``runs``: source_name,
    action, run_ts, status, timestamp, file_count, total_bytes.  Actions never
    downloaded keep the defaults (false, null, null, null, 0, 0.0).
    """
    last = latest_per_key(
        successful(runs).select("source_name", "timestamp", "action", "run_ts", "file_count", "total_bytes"),
        ["source_name", "action"], ["timestamp", "run_ts"])
    last = last.select(
        F.col("source_name").alias("source_id"), "action",
        F.lit(True).alias("downloaded"),
        display_ts("timestamp").alias("last_download"),
        F.round(age_days("timestamp", as_of), 1).alias("age_days"),
        F.concat_ws("/", F.lit(root), "source_name", "action", run_label("run_ts")).alias("download_path"),
        F.col("file_count").cast("bigint").alias("file_count"),
        F.round(F.col("total_bytes") / F.lit(1048576.0), 2).alias("size_mb"),
    )
    joined = catalog.select("source_id", "action", "funder", "format") \
        .join(last, ["source_id", "action"], "left")
    return joined.select(
        "source_id", "action", "funder", "format",
        F.coalesce("downloaded", F.lit(False)).alias("downloaded"),
        "last_download", "age_days", "download_path",
        F.coalesce("file_count", F.lit(0).cast("bigint")).alias("file_count"),
        F.coalesce("size_mb", F.lit(0.0)).alias("size_mb"),
    )


def with_landed_sizes(runs: DataFrame, listing: DataFrame) -> DataFrame:
    """``runs`` (source_name, action, run_ts) with ``file_count`` and
    ``total_bytes`` of the files that lie in each run's folder, all kinds and
    sub-folders; 0 where there are none.  ``listing``: the landing listing,
    with the folder's label in ``run_ts``."""
    keys = ["source_name", "action"]
    sizes = listing.where(F.col("run_ts").isNotNull()).groupBy(*keys, F.col("run_ts").alias("__label")).agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("bytes").alias("total_bytes"))
    zero = F.lit(0).cast("bigint")
    return (runs.drop("file_count", "total_bytes").withColumn("__label", run_label("run_ts"))
            .join(sizes, [*keys, "__label"], "left").drop("__label")
            .withColumns({"file_count": F.coalesce("file_count", zero), "total_bytes": F.coalesce("total_bytes", zero)}))


class LoadCounts:
    """Records of several loads and the columns that have a value in them,
    counted while ``rows`` is written.

    ``by`` says which load a row belongs to, one of ``loads``.  Write
    ``self.rows`` instead of ``rows``: the counts come with the write's own
    tasks, nothing is read back.  :meth:`result` waits for that write and has a
    row per load (``load``, ``n_records``, ``n_columns``).
    """

    def __init__(self, rows: DataFrame, by: str, loads: Sequence, columns: Sequence[str]):
        self.loads, self.columns, self.spark = list(loads), list(columns), rows.sparkSession
        self._seen = Observation()
        metrics = []
        for i, load in enumerate(self.loads):
            own = F.col(by) == F.lit(load)
            metrics.append(F.count_if(own).alias(f"n{i}"))
            metrics += [F.max(own & F.col(f"`{c}`").isNotNull()).alias(f"c{i}_{j}") for j, c in enumerate(self.columns)]
        self.rows = rows.observe(self._seen, *metrics)

    def result(self) -> DataFrame:
        seen = self._seen.get
        return self.spark.createDataFrame(
            [(str(load), int(seen[f"n{i}"] or 0), sum(bool(seen[f"c{i}_{j}"]) for j in range(len(self.columns))))
             for i, load in enumerate(self.loads)], "load string, n_records long, n_columns int")


def sort_status(status: DataFrame) -> DataFrame:
    """Not-downloaded first, then oldest first (unknown ages last)."""
    return status.orderBy(F.col("downloaded").asc(), F.col("age_days").desc_nulls_last())


def status_totals(status: DataFrame) -> DataFrame:
    """``downloaded / total`` sources and total size in MB."""
    return status.agg(
        F.count_if("downloaded").alias("n_downloaded"),
        F.count(F.lit(1)).alias("n_sources"),
        F.round(F.sum("size_mb"), 2).alias("total_size_mb"),
    )


DISPLAY_NAMES = [
    ("source_id", "Source ID"), ("action", "Action"), ("funder", "Funder"), ("format", "Format"),
    ("downloaded", "Downloaded"), ("last_download", "Last Download"),
    ("age_days", "Age (days)"), ("file_count", "Files"), ("size_mb", "Size (MB)"),
]


def status_display(status: DataFrame) -> DataFrame:
    """Report projection with display names."""
    return status.select(*[F.col(c).alias(d) for c, d in DISPLAY_NAMES])


def status_json(status: DataFrame) -> DataFrame:
    """One JSON text per status row (nulls kept as ``null``)."""
    return status.select(F.to_json(F.struct(*status.columns),
                                   {"ignoreNullFields": "false"}).alias("json"))


def merge_extras(base: Column, extras: Column) -> Column:
    """``base`` map overridden by ``extras`` (last wins), without relying on
    the session's map-key dedup policy."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(extras), k))
    return F.map_concat(kept, F.coalesce(extras, F.create_map().cast("map<string,string>")))


# The fields every run's metadata has, in their order.
METADATA_FIELDS = ["source_id", "funder", "source_name", "country", "type", "status", "format", "timestamp"]


def run_metadata(files: DataFrame, extras_json: str, keep: Sequence[str] = ()) -> DataFrame:
    """Metadata row per landed load: the base fields (columns of ``files``;
    an absent or null one is ``""``, status defaults to ``Downloaded``) with
    the load's own fields over them, as one map.  ``keep`` passes columns on."""
    def base(name: str) -> Column:
        default = F.lit("Downloaded" if name == "status" else "")
        return F.coalesce(F.col(name).cast("string"), default) if name in files.columns else default

    fields = F.create_map(*[x for n in METADATA_FIELDS for x in (F.lit(n), base(n))])
    extras = F.from_json(F.col(extras_json), "map<string,string>")
    return files.select(*keep, run_key("source_name", "action").alias("run_key"),
                        run_label("run_ts").alias("run_label"),
                        merge_extras(fields, extras).alias("extra"))
