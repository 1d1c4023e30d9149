"""Folder trees as rows: filters by name and size, roll-up to every folder, search, and changes to a known tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Folders left out, and the largest file counted, unless told otherwise.
FOLDERS = ("bin", "obj", "node_modules", ".vs", ".git", "dist", "target")
MAX_BYTES = 10 * 1024 * 1024


def segments(path: Column) -> Column:
    """Path segments; both kinds of slashes part them, empty ones don't count."""
    return F.array_remove(F.split(path, r"[/\\]"), "")


def skip_folder(names: Column, folders: tuple[str, ...] = FOLDERS) -> Column:
    """Whether any of the names is one of the folders, without regard to case."""
    return F.arrays_overlap(F.transform(names, F.lower), F.array(*[F.lit(f.lower()) for f in folders]).cast("array<string>"))


def skip_file(path: Column, length: Column, folders: tuple[str, ...] = FOLDERS, max_bytes: int = MAX_BYTES) -> Column:
    """Too large, or below a folder that is left out; the file's own name doesn't matter."""
    s = segments(path)
    return (length > max_bytes) | skip_folder(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), folders)


def valid_path(path: Column) -> Column:
    """The path with single forward slashes; null if it is empty, rooted, has a drive letter, or steps up."""
    s = segments(path)
    bad = path.isNull() | path.rlike(r"^[/\\]") | path.rlike(r"^[A-Za-z]:") | (F.size(s) == 0) | F.arrays_overlap(s, F.array(F.lit("."), F.lit("..")))
    return F.when(~bad, F.array_join(s, "/"))


def roll_up(files: DataFrame, path: str = "rel_path", tokens: str = "token_count", length: str = "length") -> DataFrame:
    """path, parent_path, name, depth, is_dir and the sums of all files at or below: a row for each file and folder, the root's path empty.

    Each file is one row for each of its ancestors; sums are partial before the shuffle, so that the root is no hot spot.
    """
    s = segments(F.col(path))
    rows = files.select(s.alias("_s"), F.col(tokens).cast("long").alias("_t"), F.col(length).cast("long").alias("_l"))
    at = rows.select(F.explode(F.sequence(F.lit(0), F.size("_s"))).alias("depth"), "_s", "_t", "_l")
    at = at.select(F.array_join(F.slice("_s", 1, F.col("depth")), "/").alias("path"), "depth", (F.col("depth") < F.size("_s")).alias("is_dir"), "_t", "_l")
    out = at.groupBy("path", "depth", "is_dir").agg(F.sum("_t").alias("token_count"), F.count(F.lit(1)).alias("file_count"), F.sum("_l").alias("file_size"))
    parent = F.when(F.col("depth") > 0, F.regexp_replace("path", "/?[^/]*$", ""))
    return out.select("path", parent.alias("parent_path"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), "depth", "is_dir", "token_count", "file_count", "file_size")


def ordinal(name: Column) -> Column:
    """A key that sorts names by their UTF-16 units, in which characters beyond U+FFFF come before U+E000."""
    return F.encode(name, "UTF-16BE")


def with_order(tree: DataFrame) -> DataFrame:
    """tree with child_no: the place of each node among its parent's children, folders and files mixed. New nodes find theirs so, too.

    A folder's children are ranked in one task; there are as many tasks' worth as folders.
    """
    return tree.withColumn("child_no", F.row_number().over(Window.partitionBy("parent_path").orderBy(ordinal(F.col("name")))) - 1)


def search(tree: DataFrame, query: str) -> DataFrame:
    """Nodes whose name holds the query, all below such folders, and the ancestors of both, with their unfiltered sums."""
    hits = tree.where(F.contains(F.lower("name"), F.lit(query.lower())) & (F.col("depth") > 0)).select("path")
    up = hits.select(F.explode(F.transform(F.sequence(F.lit(0), F.size(segments(F.col("path")))), lambda k: F.array_join(F.slice(segments(F.col("path")), 1, k), "/"))).alias("path"))
    nodes = tree.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.col("depth"), F.lit(1))), lambda k: F.array_join(F.slice(segments(F.col("path")), 1, k), "/"))).alias("_above"))
    down = nodes.join(hits.withColumnRenamed("path", "_above"), "_above", "left_semi").select("path")
    return tree.join(up.unionByName(down).distinct(), "path", "left_semi")


def scan_counters(files: DataFrame) -> DataFrame:
    """scanned, skipped, errors and total_tokens of counted files (status, token_count)."""
    s = F.col("status")
    return files.agg(
        F.count_if(s == "Counted").alias("scanned"),
        F.count_if(s.isin("SkippedSize", "SkippedBinary")).alias("skipped"),
        F.count_if(s.isin("Missing", "Error")).alias("errors"),
        F.coalesce(F.sum(F.when(s == "Counted", F.col("token_count").cast("long"))), F.lit(0)).alias("total_tokens"),
    )


def apply_changes(files: DataFrame, removals: DataFrame, rescans: DataFrame, listed: DataFrame, changed: DataFrame) -> DataFrame:
    """The files of a tree after a batch of changes: removals first, then folders listed anew, then single files.

    files: rel_path, length, token_count. removals: rel_path of files or folders. rescans: rel_path of folders whose
    content `listed` (rel_path, status, length, token_count) replaces. changed: single files with their status; a
    counted one is put in, an error keeps what was known, any other status takes the file out. Names are compared
    without regard to case; a file where a folder was replaces it, and the other way round. Single files below a folder
    that is listed anew are ignored, for the listing is newer.
    """
    key = F.lower("rel_path")
    files = files.withColumn("_k", key)

    def below(df: DataFrame, roots: DataFrame) -> DataFrame:
        """Rows of df at or below one of the roots: _k and the root that covers it."""
        steps = F.transform(F.sequence(F.lit(1), F.size(segments(F.col("_k")))), lambda k: F.array_join(F.slice(segments(F.col("_k")), 1, k), "/"))
        return df.select("_k", F.explode(steps).alias("_r")).join(roots, "_r", "left_semi").select("_k").distinct()

    gone = removals.select(key.alias("_r")).unionByName(rescans.select(key.alias("_r"))).distinct()
    left = files.join(below(files, gone), "_k", "left_anti")
    fresh = listed.where("status = 'Counted'").withColumn("_k", key)
    single = changed.withColumn("_k", key)
    single = single.join(below(single, rescans.select(key.alias("_r")).distinct()), "_k", "left_anti").where("status <> 'Error'")
    put = single.where("status = 'Counted'")
    # What a new file displaces: itself, all below its name if that was a folder, and files that are now its folders.
    over = below(left, single.select(F.col("_k").alias("_r")).distinct())
    folders = put.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(segments(F.col("_k")))), lambda k: F.array_join(F.slice(segments(F.col("_k")), 1, k), "/"))).alias("_k")).distinct()
    left = left.join(over, "_k", "left_anti").join(folders, "_k", "left_anti")
    names = ["rel_path", "length", "token_count"]
    return left.select(*names).unionByName(fresh.select(*names)).unionByName(put.select(*names))
