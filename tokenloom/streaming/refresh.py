"""File-change events to batches of changes: sessions, the newest report of a path, and the state that follows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.plans.tree import FOLDERS, apply_changes, segments, skip_folder, valid_path
from tokenloom.session import ship
from tokenloom.sources.files import FolderSource, count_files, scan

#: A batch closes this long after its last event.
PAUSE = "1 second"


def wanted(events: DataFrame, folders: tuple[str, ...] = FOLDERS) -> DataFrame:
    """Events (ts, seq, kind, rel_path, is_directory, old_path) as changes: ts, seq, rel_path, is_directory, is_removal.

    kind: created, changed, deleted, renamed, or overflow, which says that events were lost and asks for all to be listed
    anew (an empty path). A rename is a change of the new path and a removal of the old one. Changes of folders themselves say nothing. Paths
    below folders that are left out are dropped; of a removal only the parents count, for its own kind is not known.
    """
    new = F.struct(F.col("rel_path").alias("path"), F.col("kind").isin("deleted").alias("removal"))
    old = F.struct(F.col("old_path").alias("path"), F.lit(True).alias("removal"))
    rows = events.where(~((F.col("kind") == "changed") & F.col("is_directory")))
    rows = rows.select("ts", "seq", "kind", "is_directory", F.explode(F.when(F.col("kind") == "renamed", F.array(new, old)).otherwise(F.array(new))).alias("c"))
    path = F.when(F.col("kind") == "overflow", F.lit("")).otherwise(valid_path(F.col("c.path")))
    rows = rows.select("ts", "seq", path.alias("rel_path"), (F.col("is_directory") | (F.col("kind") == "overflow")).alias("is_directory"), F.col("c.removal").alias("is_removal")).where("rel_path is not null")
    s = segments(F.col("rel_path"))
    checked = F.when(F.col("is_removal"), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)
    return rows.where(~skip_folder(checked, folders))


def sessions(changes: DataFrame, keys: tuple[str, ...] = (), pause: str = PAUSE) -> DataFrame:
    """The newest change of each path in each session. Works on streams too, given a watermark on ts."""
    at = F.session_window("ts", pause)
    rows = changes.groupBy(at.alias("session"), *keys, "rel_path").agg(F.max_by(F.struct("is_directory", "is_removal"), "seq").alias("c"), F.max("seq").alias("seq"))
    return rows.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *keys, "rel_path", "c.is_directory", "c.is_removal", "seq")


def session_stream(events: DataFrame, late: str = "10 seconds", folders: tuple[str, ...] = FOLDERS, pause: str = PAUSE) -> DataFrame:
    """A stream of events as closed sessions of changes: what is later than `late` behind the newest event is left out.

    Each session comes once, when the watermark has passed its end; hand the batches to `refreshed` in foreachBatch.
    """
    return sessions(wanted(events.withWatermark("ts", late), folders), pause=pause)


def timestamp(column: str) -> Column:
    """Event times without zone can't carry a watermark; they are read in the session's zone."""
    return F.col(column).cast("timestamp")


def current(generation: int) -> Column:
    """Changes seen for an earlier scan are of no use to this one."""
    return F.col("scan_generation") == generation


def refreshed(files: DataFrame, changes: DataFrame, root: str, config: str, folders: tuple[str, ...] = FOLDERS, **options) -> DataFrame:
    """The files (rel_path, length, token_count) after a batch of changes (rel_path, is_directory, is_removal) below root.

    Changed folders are listed anew, all of them if one is the root itself (events were lost); changed files are counted; a folder that has vanished meanwhile is left as it is known.
    Use it in foreachBatch with the files as a table of versions: read the last, write the next.
    """
    spark = files.sparkSession
    ship(spark)
    spark.dataSource.register(FolderSource)
    removals = changes.where("is_removal").select("rel_path")
    asked = changes.where("not is_removal and is_directory").select("rel_path")
    if not asked.where("rel_path = ''").isEmpty():
        return scan(spark, root, config, folders, **options).where("status = 'Counted'").select("rel_path", "length", "token_count")
    # The changes of one batch are few: their paths are what the listing is told. Only changed folders are listed, none twice.
    paths = sorted(r["rel_path"] for r in asked.distinct().collect())
    tops = [p for k, p in enumerate(paths) if not any(p.lower().startswith(q.lower() + "/") for q in paths if q != p)]
    source = spark.read.format("folder").option("folders", ",".join(folders)).option("below", "\n".join(tops))
    inside = source.load(root)
    key = F.lower("rel_path")
    steps = F.transform(F.sequence(F.lit(1), F.size(segments(F.col("rel_path")))), lambda k: F.lower(F.array_join(F.slice(segments(F.col("rel_path")), 1, k), "/")))
    found = inside.select(F.explode(steps).alias("_r")).join(asked.select(key.alias("_r")).distinct(), "_r", "left_semi").distinct()
    rescans = asked.withColumn("_r", key).join(found, "_r", "left_semi").select("rel_path")
    listed = count_files(inside, config, **options)
    single = changes.where("not is_removal and not is_directory").select("rel_path")
    path = F.concat(F.lit(root.removeprefix("file://").rstrip("/") + "/"), F.col("rel_path"))
    counted = count_files(single.select("rel_path", path.alias("full_path"), F.lit(None).cast("long").alias("length")), config, **options)
    return apply_changes(files, removals, rescans, listed, counted)
