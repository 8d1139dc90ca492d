"""Compaction of a Parquet folder in place: few files instead of many, and never fewer rows.

Steps, each of which may be the last one that happens:

1. ``begun``: a manifest names the files that are there, the folder aside and the
   rows' number and checksum.
2. ``written``: the rows, in order, in few files aside.  Names with an underscore
   are not data to Spark, so readers see the old files only.
3. ``verified``: what was written is read back; number and checksum must agree.
4. ``published``: a second manifest, put there by one rename, makes the files aside
   the ones that count.
5. ``deleted``: the old files go.
6. ``moved``: the new ones come in their place, and the manifests go.

``recover`` after a failure undoes what was not published and finishes what was.
``live`` reads the rows that count at any moment, between steps too; a plain read
does so before step 4 and after step 6.  Files that arrive meanwhile are left
alone.  One compaction of a folder runs at a time.

Defined results: a folder without files stays as it is; rows that are equal stay
as many as they are; where step 3 finds a difference, nothing has changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BEGUN, _PUBLISHED = "_compaction-begun.json", "_compaction-published.json"


class Folder:
    """A folder in any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, rel: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rel}" if rel else self.path)

    def files(self, below: str = "") -> list[str]:
        """Data files below a folder, as paths from here; names with ``_`` or ``.`` are not data."""
        top = self.at(below)
        if not self.fs.exists(top):
            return []
        out, todo = [], [(top, below)]
        while todo:
            folder, rel = todo.pop()
            for s in self.fs.listStatus(folder):
                name = s.getPath().getName()
                if name[0] not in "_.":
                    own = f"{rel}/{name}" if rel else name
                    todo.append((s.getPath(), own)) if s.isDirectory() else out.append(own)
        return sorted(out)

    def exists(self, rel: str) -> bool:
        return self.fs.exists(self.at(rel))

    def delete(self, rel: str) -> None:
        self.fs.delete(self.at(rel), True)

    def move(self, rel: str, to: str) -> None:
        target = self.at(to)
        self.fs.mkdirs(target.getParent())
        if not self.fs.rename(self.at(rel), target):
            raise OSError(f"{self.path}: {rel} cannot be moved to {to}")

    def write(self, rel: str, value: dict) -> None:
        """The file is there whole or not at all."""
        aside = f"_{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.at(aside), True)
        try:
            out.write(json.dumps(value).encode())
        finally:
            out.close()
        self.move(aside, rel)

    def read(self, rel: str) -> dict:
        stream = self.fs.open(self.at(rel))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def _rows(folder: Folder, files: list[str], base: str = "") -> DataFrame:
    top = folder.at(base).toString()
    return folder.spark.read.option("basePath", top).parquet(*[folder.at(f).toString() for f in files])


def checksum(rows: DataFrame) -> tuple[int, str]:
    """Number of rows, and a sum of their hashes that does not depend on their order or files."""
    own = F.xxhash64(*sorted(rows.columns)), F.xxhash64(F.lit(1), *sorted(rows.columns))
    total: Callable[[Column], Column] = lambda h: F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0).cast("decimal(38,0)"))
    r = rows.agg(F.count(F.lit(1)).alias("n"), total(own[0]).alias("a"), total(own[1]).alias("b")).first()
    return r["n"], f"{r['a']}/{r['b']}"


def compact(spark: SparkSession, path: str, keys: list[str], order: list[str], after: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """Compact a folder that is partitioned by ``keys``; rows of a partition in ``order``.

    ``after`` hears of each step, and of each file that was deleted or moved.
    Returns the numbers of files before and after, and of rows.
    """
    folder = Folder(spark, path)
    recover(spark, path)
    files = folder.files()
    if not files:
        return {"before": 0, "after": 0, "rows": 0}
    rows = _rows(folder, files)
    n, check = checksum(rows)
    aside = f"_compaction-{uuid.uuid4().hex}"
    folder.write(_BEGUN, {"files": files, "aside": aside, "rows": n, "checksum": check})
    after("begun")
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    placed.write.option("compression", "zstd").partitionBy(*keys).parquet(folder.at(aside).toString())
    after("written")
    new = folder.files(aside)
    found = checksum(_rows(folder, new, aside).select(*rows.columns)) if new else (0, check)
    if found != (n, check):
        recover(spark, path)
        raise ValueError(f"{path}: {n} rows with checksum {check} became {found[0]} with {found[1]}; nothing was changed")
    after("verified")
    folder.write(_PUBLISHED, {"files": files, "aside": aside})
    after("published")
    _finish(folder, after)
    return {"before": len(files), "after": len(new), "rows": n}


def _finish(folder: Folder, after: Callable[[str], None]) -> None:
    """From ``published`` on; doing any part of it again changes nothing."""
    told = folder.read(_PUBLISHED)
    for f in told["files"]:
        if folder.exists(f):
            folder.delete(f)
            after("one deleted")
    after("deleted")
    for f in folder.files(told["aside"]):
        folder.move(f, f.removeprefix(f"{told['aside']}/"))
        after("one moved")
    after("moved")
    folder.delete(told["aside"])
    folder.delete(_BEGUN)
    folder.delete(_PUBLISHED)


def recover(spark: SparkSession, path: str) -> str:
    """After a failure: ``finished``, ``undone`` or ``nothing`` to do."""
    folder = Folder(spark, path)
    if folder.exists(_PUBLISHED):
        _finish(folder, lambda step: None)
        return "finished"
    if folder.exists(_BEGUN):
        folder.delete(folder.read(_BEGUN)["aside"])
        folder.delete(_BEGUN)
        return "undone"
    return "nothing"


def live(spark: SparkSession, path: str) -> DataFrame:
    """The rows that count, whatever step a compaction has come to."""
    folder = Folder(spark, path)
    here, told = folder.files(), folder.read(_PUBLISHED) if folder.exists(_PUBLISHED) else None
    if told is None:
        return _rows(folder, here)
    old, aside = {*told["files"]}, folder.files(told["aside"])
    parts = [_rows(folder, own, base) for own, base in (([f for f in here if f not in old], ""), (aside, told["aside"])) if own]
    return reduce(lambda a, b: a.unionByName(b), parts)
