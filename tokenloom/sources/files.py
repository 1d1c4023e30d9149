"""A folder tree as a table: a Python data source that lists files of any name, and the counting of their texts.

The driver opens the topmost folders only, until there are enough of them for all tasks; the tasks list what is below
and read contents. Left-out folders are never entered; of one folder, names come in the order of their UTF-16 units. The folder must be one that all executors see.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tokenloom.functions.tokenizer import compiled
from tokenloom.plans.tree import FOLDERS, MAX_BYTES
from tokenloom.session import ship

HEAD = 4096
SCHEMA = "rel_path string, full_path string, length bigint"


class Folders(InputPartition):
    """Folders (path, path below the root, whether with all that is below) that one task lists."""

    def __init__(self, rows: list[tuple[str, str, bool]]):
        self.rows = rows


class FolderReader(DataSourceReader):
    """The driver opens folders only until there are enough for all tasks; what is below them is listed by the tasks."""

    def __init__(self, options: dict):
        self.root = options["path"].removeprefix("file://")
        names = options.get("folders")
        self.skip = {f.strip().lower() for f in (names.split(",") if names is not None else FOLDERS)} - {""}
        self.tasks = int(options.get("tasks", "64"))
        below = options.get("below")
        self.below = [b for b in below.split("\n") if b] if below is not None else [""]

    def entries(self, folder: str, rel: str) -> tuple[list[tuple[str, str]], list[tuple[str, str, int]]]:
        """Folders and files of one folder; a folder that has vanished meanwhile has none."""
        folders, found = [], []
        try:
            with os.scandir(folder) as entries:
                for e in sorted(entries, key=lambda e: e.name.encode("utf-16-be", "surrogatepass")):
                    path = f"{rel}/{e.name}" if rel else e.name
                    if e.is_dir(follow_symlinks=False):
                        if e.name.lower() not in self.skip:
                            folders.append((e.path, path))
                    elif e.is_file():
                        found.append((path, e.path, e.stat().st_size))
        except (FileNotFoundError, NotADirectoryError):
            if not rel:
                raise
        return folders, found

    def partitions(self) -> list[InputPartition]:
        todo = [(f"{self.root.rstrip('/')}/{b}" if b else self.root, b) for b in self.below]
        shallow = []
        while todo and len(todo) < self.tasks:
            opened = [(f, self.entries(*f)[0]) for f in todo]
            shallow += [(*f, False) for f, _ in opened]
            todo = [inner for _, found in opened for inner in found]
        rows = shallow + [(*f, True) for f in todo]
        return [Folders(rows[k :: self.tasks]) for k in range(min(self.tasks, len(rows)))] or [Folders([])]

    def read(self, partition: Folders):
        for folder, rel, deep in partition.rows:
            todo = [(folder, rel)]
            while todo:
                inner, found = self.entries(*todo.pop())
                if deep:
                    todo += inner[::-1]
                yield from found


class FolderSource(DataSource):
    """spark.read.format('folder').option('folders', 'bin,obj').load(path): rel_path, full_path, length."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options)


def is_text(head: bytes, encoding: str = "utf-8") -> bool:
    """Whether the head of a file is valid in its encoding; a character cut off at the end is no fault."""
    reader = codecs.getincrementaldecoder(encoding)("strict")
    try:
        reader.decode(head, False)
    except UnicodeDecodeError:
        return False
    left = reader.getstate()[0]  # a surrogate's first two bytes aren't the beginning of any character
    return not (codecs.lookup(encoding).name == "utf-8" and left[:1] == b"\xed" and left[1:2] >= b"\xa0")


def decoded(content: bytes, encoding: str = "utf-8") -> str:
    """The text of a file; a UTF-8 mark overrules the encoding and stays, bad bytes become U+FFFD."""
    return content.decode("utf-8" if content[:3] == b"\xef\xbb\xbf" else encoding, "replace")


def text_column(content: Column) -> Column:
    """The same for UTF-8, without Python."""
    return F.make_valid_utf8(content.cast("string"))


def is_text_column(content: Column) -> Column:
    """is_text for UTF-8 without Python: valid once up to three bytes of a cut-off character are dropped."""
    head = F.substring(content, 1, HEAD)
    n = F.octet_length(head)

    def valid(drop: int) -> Column:
        return F.is_valid_utf8(F.substring(head, F.lit(1), n - drop).cast("string"))

    def opens(back: int, needs: str) -> Column:
        """Whether the byte so far from the end begins a longer character, and those behind it continue one."""
        return F.hex(F.substring(head, n - back + 1, F.lit(back))).rlike(needs)

    cut = (
        (n >= 1) & opens(1, "^(C[2-9A-F]|D|E|F[0-4])") & valid(1)
        | (n >= 2) & opens(2, "^(E0[AB]|E[1-9A-CEF][89AB]|ED[89]|F0[9AB]|F[1-3][89AB]|F48)") & valid(2)
        | (n >= 3) & opens(3, "^(F0[9AB].|F[1-3][89AB].|F48.)[89AB]") & valid(3)
    )
    return (n == 0) | valid(0) | cut


def read_file(path: str, length: int | None, max_bytes: int, check: bool, encoding: str) -> tuple[str, int, str | None]:
    """Status, length and text of a file. length: as listed; None: as the file has it now."""
    try:
        if length is None:
            length = os.stat(path).st_size
        if length > max_bytes:
            return "SkippedSize", length, None
        with open(path, "rb") as f:
            head = f.read(min(HEAD, length))
            if check and not is_text(head, encoding):
                return "SkippedBinary", length, None
            parts = [head]
            left = length - len(head)
            while left > 0 and (more := f.read(left)):  # a read may give less than it was asked for
                parts.append(more)
                left -= len(more)
            return "Counted", length, decoded(b"".join(parts), encoding)
    except FileNotFoundError:
        return "Missing", length or 0, None
    except OSError:
        return "Error", length or 0, None


def count_files(files: DataFrame, config: str, max_bytes: int = MAX_BYTES, check_binary: bool = True, encoding: str = "utf-8") -> DataFrame:
    """rel_path, status, length and token_count of listed files; token_count is null unless the status is Counted."""
    ship(files.sparkSession)
    held = files.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = compiled(held.value)
        for batch in batches:
            status, count, lengths = [], [], []
            for path, length in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                s, length, text = read_file(path, length, max_bytes, check_binary, encoding)
                try:
                    n = tokenizer.count(text) if text is not None else None
                except ValueError:
                    s, n = "Error", None
                status.append(s)
                lengths.append(length)
                count.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(status, pa.string()), pa.array(lengths, pa.int64()), pa.array(count, pa.int64())], names=["rel_path", "status", "length", "token_count"])

    return files.select("rel_path", "full_path", "length").mapInArrow(run, "rel_path string, status string, length bigint, token_count bigint")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the one that driver and executors share, as a plain path; only where all is one machine, below the local one."""
    import tempfile
    import uuid

    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.gettempdir()
    path = os.path.join(found.removeprefix("file://"), f"{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def write_files(rows: DataFrame, root: str) -> None:
    """Each row's text (text) as a file below root (rel_path)."""

    def run(some) -> None:
        for r in some:
            path = os.path.join(root, r["rel_path"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "wb") as f:
                f.write(r["text"].encode("utf-8"))

    rows.select("rel_path", "text").foreachPartition(run)


def scan(spark: SparkSession, root: str, config: str, folders: tuple[str, ...] = FOLDERS, **options) -> DataFrame:
    """All files below a folder, listed and counted."""
    ship(spark)
    spark.dataSource.register(FolderSource)
    listed = spark.read.format("folder").option("folders", ",".join(folders)).load(root)
    return count_files(listed, config, **options)
