"""Listings stored in buckets of their id, refreshed bucket by bucket.

The store is one bucketed table over a folder. A row's bucket is the one Spark's bucketing gives
its id, and it is a partition column too, beside the version that wrote it:
``data/version=V/bucket=B``. A manifest names, for each bucket, the version that counts.

A pull touches the buckets of its ids only. These are read from their versions, joined with the
pull where they lie (a bucketed scan needs no exchange; the pull is dealt out to the same
buckets), and written as a new version. The manifest is renamed into place in the end, so a
refresh that breaks off leaves the store as it was, and readers never see half of one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblattice.sources.files import Files
from joblattice.sources.listings import newest_versions

BUCKETS = 64  # of a small store; choose them for about 1 GB each
KEEP = 4  # versions before the newest whose files stay for readers
ID = "id_num"


def bucket_of(buckets: int) -> Column:
    """The bucket Spark's bucketing puts an id in."""
    return F.pmod(F.hash(ID), F.lit(buckets)).cast("int")


def _manifest(files: Files) -> dict | None:
    names = [n for n in files.names("_manifest") if n.endswith(".json")]
    return json.loads(files.read(f"_manifest/{names[-1]}")) if names else None


def _commit(files: Files, state: dict) -> None:
    files.put(f"_manifest/{state['version']:012d}.json", json.dumps(state))


def _next_version(files: Files, last: int = 0) -> int:
    """Above the last version and every one that ever wrote a file, finished or not."""
    return 1 + max([last, *(int(n.split("=")[1]) for n in files.names("data") if n.startswith("version="))])


def _table(spark: SparkSession, path: str, state: dict) -> str:
    """Name of a table over the store's files, known to this session only."""
    name = f"listing_store_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in T.StructType.fromJson(state["schema"]))
    spark.sql(
        f"CREATE TABLE {name} ({columns}, version BIGINT, bucket INT) USING parquet PARTITIONED BY (version, bucket) "
        f"CLUSTERED BY ({ID}) INTO {state['buckets']} BUCKETS LOCATION '{path.rstrip('/')}/data'"
    )
    return name


def _write(rows: DataFrame, path: str, state: dict, version: int) -> None:
    """Add rows as a version, one file a bucket."""
    spark = rows.sparkSession
    name = _table(spark, path, state)
    try:
        names = [f["name"] for f in state["schema"]["fields"]]
        dealt = rows.select(*names).repartition(state["buckets"], ID)
        marked = dealt.select(*names, F.lit(version).cast("bigint").alias("version"), bucket_of(state["buckets"]).alias("bucket"))
        before = spark.conf.get("hive.exec.dynamic.partition.mode", None)
        spark.conf.set("hive.exec.dynamic.partition.mode", "nonstrict")
        try:
            marked.write.insertInto(name)
        finally:
            if before is None:
                spark.conf.unset("hive.exec.dynamic.partition.mode")
            else:
                spark.conf.set("hive.exec.dynamic.partition.mode", before)
    finally:
        spark.sql(f"DROP TABLE {name}")


def create(listings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store listings for the first time; ids are unique."""
    files = Files(listings.sparkSession, path)
    if _manifest(files):
        raise ValueError(f"{path} is a store already")
    state = {"schema": json.loads(listings.schema.json()), "buckets": buckets, "version": _next_version(files), "live": {}}
    _write(listings, path, state, state["version"])
    state["live"] = {str(b): state["version"] for b in range(buckets)}
    _commit(files, state)


def read(spark: SparkSession, path: str, buckets: Sequence[int] | None = None) -> DataFrame:
    """The stored listings, or those of some buckets: other buckets' files are not read."""
    state = _manifest(Files(spark, path))
    if state is None:
        raise ValueError(f"{path} is no store")
    return _read(spark, path, state, buckets).drop("version", "bucket")


def _read(spark: SparkSession, path: str, state: dict, buckets: Sequence[int] | None) -> DataFrame:
    name = _table(spark, path, state)
    spark.catalog.recoverPartitions(name)
    by_version: dict[int, list[int]] = {}
    for b in range(state["buckets"]) if buckets is None else buckets:
        by_version.setdefault(state["live"][str(b)], []).append(b)
    live = [(F.col("version") == v) & F.col("bucket").isin(bs) for v, bs in sorted(by_version.items())]
    return spark.table(name).where(reduce(Column.__or__, live, F.lit(False)))


def merged(old: DataFrame, pull: DataFrame) -> DataFrame:
    """The newest version of every listing of two tables with unique ids.

    On equal dates the pull wins; a stored row that is newer stays. One full join, built
    from the pull, so that stored rows only stream by.
    """
    names = old.columns
    o, p = (frame.select(ID, F.struct(*names).alias(side)) for frame, side in ((old, "o"), (pull.select(*names), "p")))
    stays = F.col("p").isNull() | F.coalesce(F.col("o.posted_on") > F.col("p.posted_on"), F.col("p.posted_on").isNull() & F.col("o.posted_on").isNotNull())
    row = F.when(F.col("o").isNotNull() & stays, F.col("o")).otherwise(F.col("p"))
    return o.join(p.hint("shuffle_hash"), ID, "full_outer").select(row.alias("row")).select("row.*")


def refresh(spark: SparkSession, path: str, pull: DataFrame) -> list[int]:
    """Take a pull into the store; returns the buckets that were written anew."""
    files = Files(spark, path)
    state = _manifest(files)
    if state is None:
        raise ValueError(f"{path} is no store")
    # At most one number per bucket.
    touched = sorted(r.b for r in pull.select(bucket_of(state["buckets"]).alias("b")).distinct().collect())
    if touched:
        version = _next_version(files, state["version"])
        rows = merged(_read(spark, path, state, touched).drop("version", "bucket"), newest_versions(pull))
        _write(rows, path, state, version)
        state = state | {"version": version, "live": state["live"] | {str(b): version for b in touched}}
        _commit(files, state)
        _clean(files, state)
    return touched


def _clean(files: Files, state: dict) -> None:
    """Remove what neither this manifest nor the last ones name."""
    names = [n for n in files.names("_manifest") if n.endswith(".json")]
    kept = [json.loads(files.read(f"_manifest/{n}")) for n in names[-1 - KEEP :]]
    live = {(v, int(b)) for m in kept for b, v in m["live"].items()}
    for n in names[: -1 - KEEP]:
        files.remove(f"_manifest/{n}")
    oldest = min(m["version"] for m in kept)
    for folder in files.names("data"):
        version = int(folder.split("=")[1]) if folder.startswith("version=") else oldest
        if version < oldest:
            for part in files.names(f"data/{folder}"):
                if part.startswith("bucket=") and (version, int(part.split("=")[1])) not in live:
                    files.remove(f"data/{folder}/{part}")
            if not any(v == version for v, _ in live):
                files.remove(f"data/{folder}")
