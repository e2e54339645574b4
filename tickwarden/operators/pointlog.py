"""A point table of sorted runs, committed by a manifest.

SNK-3 / AGG-4 with more than appended files: every write is a *run*, a
folder of parquet files partitioned by date whose rows are sorted by
(measurement, ticker, time), each file a narrow range of them.  Beside it
lies the run's file list, with the least and greatest time and ticker and
the number of rows of every file.

A *manifest* names the runs that are the table.  It is a small JSON file
``manifest/<version>.json``; a new version is written under another name
and renamed, which succeeds for one writer only.  A writer that finds its
version taken reads the newer manifest and tries again.  What is not named
in the newest manifest is not part of the table, so a write or a merge
that breaks off between any two steps leaves the table as it was.

Reading a range filters the runs' file lists and opens only the files
whose dates, times and tickers meet the range; the upsert (last write
wins) then sees the points of those files.  ``merge`` replaces runs of
similar size by one (size-tiered: a tier holds runs within a factor of
``TIER`` of each other) in which the upsert is already resolved, keeping
the winning write's order.

Nulls: a point without measurement, ticker or time is in no file list
range and is left out at writing (``points_from_records`` yields none).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwarden.operators.points import range_bounds
from tickwarden.schemas import DEFAULT_MEASUREMENT

FIELDS = "measurement string, ticker string, time timestamp_ntz, price double, version bigint, offset bigint"
FILE_LIST = ("date string, file string, rows bigint, measurements array<string>, first_time timestamp_ntz, "
             "last_time timestamp_ntz, first_ticker string, last_ticker string")
TIER = 4
ATTEMPTS = 20


class PointLog:
    """The point table below ``path`` (any store that renames atomically)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._store = self._hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ manifest

    def _versions(self) -> list[int]:
        folder = self._hadoop.Path(f"{self.path}/manifest")
        if not self._store.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._store.listStatus(folder)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, version: int | None = None) -> dict:
        """``{"version", "runs": [{"run", "rows", "version"}]}``, the newest
        or the one asked for (a snapshot)."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "runs": []}
        name = f"{self.path}/manifest/{version or versions[-1]:012d}.json"
        stream = self._store.open(self._hadoop.Path(name))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, change) -> dict:
        """Apply ``change(manifest)`` to the newest manifest; repeated when
        another writer was first."""
        for _ in range(ATTEMPTS):
            now = self.manifest()
            runs = change(now)
            new = {"version": now["version"] + 1, "runs": runs}
            temp = self._hadoop.Path(f"{self.path}/manifest/_{uuid.uuid4().hex}.json")
            final = self._hadoop.Path(f"{self.path}/manifest/{new['version']:012d}.json")
            stream = self._store.create(temp, False)
            try:
                stream.write(bytearray(json.dumps(new).encode()))
            finally:
                stream.close()
            if self._publish(temp, final):
                return new
            self._store.delete(temp, False)
        raise RuntimeError(f"the manifest of {self.path} kept changing")

    def _publish(self, temp, final) -> bool:
        # a rename onto an existing file fails on HDFS; a local file would be
        # replaced, so look first
        return not self._store.exists(final) and self._store.rename(temp, final)

    # ------------------------------------------------------------- writing

    def _write_run(self, rows: DataFrame) -> tuple[str, int]:
        """Sorted files by date, and their list; returns (run, rows)."""
        run = uuid.uuid4().hex[:16]
        folder = f"{self.path}/runs/{run}"
        key = ["measurement", "date", "ticker", "time"]
        dated = rows.where("measurement is not null and ticker is not null and time is not null").withColumn(
            "date", F.col("time").cast("date").cast("string")
        )
        dated.repartitionByRange(*key).sortWithinPartitions(*key).write.partitionBy("date").parquet(f"{folder}/data")
        written = self.spark.read.schema(f"{FIELDS}, date string").parquet(f"{folder}/data")
        files = written.groupBy("date", F.col("_metadata.file_path").alias("file")).agg(
            F.count("*").alias("rows"), F.collect_set("measurement").alias("measurements"),
            F.min("time").alias("first_time"), F.max("time").alias("last_time"),
            F.min("ticker").alias("first_ticker"), F.max("ticker").alias("last_ticker"),
        )
        files.write.parquet(f"{folder}/files")
        total = self.spark.read.schema(FILE_LIST).parquet(f"{folder}/files").agg(F.sum("rows")).first()[0]
        return run, total or 0

    def append(self, points: DataFrame, order_col: str = "offset") -> dict:
        """Add points as a run; later runs win over earlier ones, within a
        run the greater ``order_col``."""
        order = F.coalesce(F.col(order_col).cast("bigint"), F.lit(-(2**63))) if order_col in points.columns else F.lit(0)
        rows = points.select(
            "measurement", "ticker", "time", "price", F.lit(0).cast("bigint").alias("version"),
            order.cast("bigint").alias("offset"),
        )
        run, total = self._write_run(rows)
        if not total:
            return self.manifest()
        return self._commit(lambda m: [*m["runs"], {"run": run, "rows": total, "version": m["version"] + 1}])

    # ------------------------------------------------------------- reading

    def _rows(self, runs: list[dict], keep: Column | None = None) -> DataFrame | None:
        """The runs' points, each with the version its run was committed as;
        with ``keep`` (on the file lists) of the files it holds for only."""
        out = None
        for entry in runs:
            folder = f"{self.path}/runs/{entry['run']}"
            if keep is None:
                paths = [f"{folder}/data"]
            else:
                listed = self.spark.read.schema(FILE_LIST).parquet(f"{folder}/files").where(keep)
                paths = [r["file"] for r in listed.select("file").collect()]
                if not paths:
                    continue
            rows = self.spark.read.schema(FIELDS).parquet(*paths)
            # points of a merged run keep the version of the run they came in
            own = F.when(F.col("version") > 0, F.col("version")).otherwise(F.lit(entry["version"]))
            rows = rows.withColumn("version", own.cast("bigint"))
            out = rows if out is None else out.unionByName(rows)
        return out

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], FIELDS)

    def read_range(
        self, start: str | None = None, stop: str | None = None, measurement: str = DEFAULT_MEASUREMENT, tickers: tuple[str, str] | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """FLT-6: points with ``start <= time < stop`` of a measurement (and
        of tickers within the two given), upserted."""
        lo, hi = range_bounds(start, stop)
        inside = (F.col("measurement") == measurement) & (F.col("time") >= lo) & (F.col("time") < hi)
        keep = F.array_contains("measurements", measurement) & (F.col("last_time") >= lo) & (F.col("first_time") < hi)
        if tickers:
            inside = inside & F.col("ticker").between(*tickers)
            keep = keep & (F.col("last_ticker") >= tickers[0]) & (F.col("first_ticker") <= tickers[1])
        rows = self._rows(self.manifest(version)["runs"], keep)
        return upserted((self._empty() if rows is None else rows).where(inside)).drop("version", "offset")

    def read(self, version: int | None = None) -> DataFrame:
        """All points, upserted."""
        rows = self._rows(self.manifest(version)["runs"])
        return upserted(self._empty() if rows is None else rows).drop("version", "offset")

    # ------------------------------------------------------------- merging

    def merge(self, tier: int = TIER) -> int:
        """Replace the runs of one size tier by one, if it holds at least
        ``tier``; returns how many were replaced."""
        runs = sorted(self.manifest()["runs"], key=lambda r: r["rows"])
        chosen: list[dict] = []
        for i, first in enumerate(runs):
            chosen = [r for r in runs[i:] if r["rows"] <= tier * first["rows"]]
            if len(chosen) >= tier:
                break
        else:
            return 0
        names = {r["run"] for r in chosen}
        run, total = self._write_run(upserted(self._rows(chosen)))

        def change(m: dict) -> list[dict]:
            if not names <= {r["run"] for r in m["runs"]}:
                raise RuntimeError("another merge replaced a run")
            kept = [r for r in m["runs"] if r["run"] not in names]
            # its points carry their own versions
            return [*kept, {"run": run, "rows": total, "version": max(r["version"] for r in chosen)}]

        self._commit(change)
        return len(names)

    def vacuum(self, keep_versions: int = 1) -> list[str]:
        """Delete runs that none of the newest manifests names (nothing else
        may be writing); returns their names."""
        versions = self._versions()[-max(1, keep_versions):]
        live = {r["run"] for v in versions for r in self.manifest(v)["runs"]}
        root = self._hadoop.Path(f"{self.path}/runs")
        if not self._store.exists(root):
            return []
        dead = sorted(n for n in (f.getPath().getName() for f in self._store.listStatus(root)) if n not in live)
        for name in dead:
            self._store.delete(self._hadoop.Path(root, name), True)
        return dead


def upserted(rows: DataFrame) -> DataFrame:
    """AGG-4: the last write per (measurement, ticker, time): the later run,
    within a run the later record; equal ones by the greater price."""
    last = F.max(F.struct("version", "offset", "price")).alias("w")
    return rows.groupBy("measurement", "ticker", "time").agg(last).select(
        "measurement", "ticker", "time", "w.price", "w.version", "w.offset"
    )
