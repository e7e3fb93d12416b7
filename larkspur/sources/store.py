"""The catalog's manifest and the tables' versioned Parquet segments, on any Hadoop file system.

A database is a folder: `manifest-<n>.json` (n grows by one with each commit, created exclusively,
so two writers can't both commit the same n) and `data/<id>` folders of Parquet, never changed once
they are in a manifest. A table is a list of segments; an INSERT adds one, an UPDATE or DELETE
replaces only those that hold changed rows. For each segment the manifest has its number of rows and
the ranges of its primary key's columns, by which checks of keys read only segments that can hold one
of the keys looked for; a segment of which nothing is known is always read. Readers keep the manifest they started with, which makes
every cursor a snapshot.
"""

from __future__ import annotations

import copy
import json
import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.dialect.types import Type
from larkspur.errors import SqlError

KEEP = 5
SEGMENT = "__segment"
#: An INSERT that leaves MANY segments of at most SMALL rows joins them to one, so that single-row INSERTs don't pile up.
SMALL, MANY = 100_000, 32
#: Kinds of columns whose least and greatest value a manifest keeps; texts only up to KEY_LENGTH characters.
KEY_KINDS, KEY_LENGTH = ("SMALLINT", "INTEGER", "BIGINT", "CHAR", "VARCHAR"), 64


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset and all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise SqlError("58030", "spark.checkpoint.dir is not set; on a cluster it must name a folder that driver and executors share")
    return f"{base.rstrip('/') if base else 'file://' + tempfile.mkdtemp(prefix='larkspur-')}/db-{uuid.uuid4().hex}"


def claim_local(draft: str, final: str) -> bool:
    """Gives a file its final name unless there is one of that name: a link is made whole or not at all, whichever process is first."""
    try:
        os.link(draft, final)
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)
    return True


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.root).getFileSystem(conf)
        self.fs.mkdirs(self.path(self.root))
        self.io = jvm.org.apache.commons.io.IOUtils

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(self.root))]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def load(self) -> tuple[int, dict]:
        found = self.versions()
        if not found:
            return 0, new_manifest()
        stream = self.fs.open(self.path(f"{self.root}/manifest-{found[-1]:012d}.json"))
        try:
            return found[-1], json.loads(self.io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def save(self, base: int, manifest: dict) -> int:
        """The next version after `base`; 40001 if another writer has made it. Readers never see half a manifest.

        On a local file system the draft is linked, on HDFS it is renamed (which replaces nothing there), and on other
        stores the file is created under its final name, which appears when it is closed and is refused if it is there."""
        final, scheme = self.path(f"{self.root}/manifest-{base + 1:012d}.json"), self.fs.getUri().getScheme()
        draft = final if scheme not in ("file", "hdfs", "viewfs", "webhdfs") else self.path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        try:
            out = self.fs.create(draft, False)
            out.write(json.dumps(manifest).encode())
            out.close()
            made = draft is final or (claim_local(draft.toUri().getPath(), final.toUri().getPath()) if scheme == "file" else self.fs.rename(draft, final))
        except Py4JJavaError as e:
            if "AlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            made = False
        if draft is not final:
            self.fs.delete(draft, False)
        if not made:
            raise SqlError("40001", "Another session has committed meanwhile; run the transaction again")
        for old in self.versions()[:-KEEP]:
            self.fs.delete(self.path(f"{self.root}/manifest-{old:012d}.json"), False)
        return base + 1

    def write(self, df: DataFrame) -> str:
        segment = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/data/{segment}")
        return segment

    def read(self, table: dict, segments: list[str] | None = None) -> DataFrame:
        """A table's rows under its physical column names; columns that a segment lacks are NULL."""
        schema = ", ".join(f"`{c['id']}` {type_of(c['type']).spark}" for c in table["columns"]) or "`none` int"
        segments = table["segments"] if segments is None else segments
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/data/{s}" for s in segments])

    def measure(self, rows: DataFrame, table: dict, ranged: set[str]) -> dict:
        """In one pass: the number of rows, of NULLs in each NOT NULL column, and [least, greatest] of the columns `ranged` (by id; none if all are NULL)."""
        strict = [c["id"] for c in table["columns"] if c["not_null"]]
        keys = [c["id"] for c in table["columns"] if c["id"] in ranged and type_of(c["type"]).kind in KEY_KINDS]
        ends = [f(c).alias(f"{name}_{c}") for c in keys for name, f in (("lo", F.min), ("hi", F.max))]
        r = rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in strict], *ends).first()
        ranges = {c: [r[f"lo_{c}"], r[f"hi_{c}"]] for c in keys if r[f"lo_{c}"] is not None}
        ranges = {c: v for c, v in ranges.items() if not isinstance(v[0], str) or max(map(len, v)) <= KEY_LENGTH}
        return {"rows": r["rows"], "nulls": {c: r[f"null_{c}"] for c in strict}, "ranges": ranges}

    def compact(self, table: dict) -> None:
        """Joins a table's small segments to one if there are many; nothing else about the table changes."""
        stats = table.get("stats", {})
        small = [s for s in table["segments"] if s in stats and stats[s]["rows"] <= SMALL]
        if len(small) < MANY:
            return
        of = [stats[s] for s in small]
        rows = sum(x["rows"] for x in of)
        segment = self.write(self.read(table, small).coalesce(max(1, rows // 1_000_000)))
        shared = set.intersection(*[set(x["ranges"]) for x in of])
        ranges = {c: [min(x["ranges"][c][0] for x in of), max(x["ranges"][c][1] for x in of)] for c in shared}
        hold(table, [s for s in table["segments"] if s not in small] + [segment], {segment: {"rows": rows, "ranges": ranges}})

    def located(self, table: dict) -> DataFrame:
        """A table's rows with where each stands: __segment, and __file and __row, which no other row shares."""
        if not table["segments"]:
            return self.read(table).withColumns({SEGMENT: F.lit(""), "__file": F.lit(""), "__row": F.lit(0).cast("long")})
        df = self.read(table)
        file = F.col("_metadata.file_path")
        return df.select("*", F.regexp_extract(file, "/data/([0-9a-f]{32})/", 1).alias(SEGMENT), file.alias("__file"), F.col("_metadata.row_index").alias("__row"))

    def stage(self, df: DataFrame) -> DataFrame:
        """Rows written once, outside of any table, and read again; vacuum() takes them away."""
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/data/{self.write(df)}")

    def vacuum(self) -> int:
        """Deletes segments that no kept manifest names: those of rolled-back statements, stages and old versions. Returns how many.

        To be run while no statement is under way."""
        kept = set()
        for v in self.versions():
            stream = self.fs.open(self.path(f"{self.root}/manifest-{v:012d}.json"))
            manifest = json.loads(self.io.toString(stream, "UTF-8"))
            stream.close()
            kept |= {x for s in manifest["spaces"].values() for t in s["tables"].values() for x in t["segments"]}
        data = self.path(f"{self.root}/data")
        found = [s.getPath() for s in self.fs.listStatus(data)] if self.fs.exists(data) else []
        gone = [p for p in found if p.getName() not in kept]
        for p in gone:
            self.fs.delete(p, True)
        return len(gone)


def hold(table: dict, segments: list[str], measured: dict[str, dict]) -> None:
    """Makes `segments` the table's segments; `measured` tells rows and ranges of new ones."""
    ids = {c["id"] for c in table["columns"] if table["pk"] and c["name"] in table["pk"]["columns"]}
    own = {s: {"rows": m["rows"], "ranges": {c: v for c, v in m["ranges"].items() if c in ids}} for s, m in measured.items()}
    table["segments"], table["stats"] = segments, {s: v for s, v in {**table.get("stats", {}), **own}.items() if s in set(segments)}


def overlapping(table: dict, ranges: dict[str, list]) -> list[str]:
    """The table's segments that can hold a row whose columns (by id) all lie in `ranges`."""
    stats = table.get("stats", {})
    apart = lambda a, b: type(a[0]) is type(b[0]) and (a[1] < b[0] or b[1] < a[0])
    return [s for s in table["segments"] if not any(apart(ranges[c], v) for c, v in stats.get(s, {"ranges": {}})["ranges"].items() if c in ranges)]


def new_manifest() -> dict:
    return {"spaces": {"SYSTEM": new_space("SYSTEM")}, "users": {"SYSTEM": {"password": None, "space": None}}, "grants": [], "groups": {"SYSTEM": ["DBA"]}}


def new_space(name: str, file: str | None = None) -> dict:
    return {"file": file or f"{name.lower()}.data", "tables": {}, "views": {}, "indexes": {}}


def fresh(manifest: dict) -> dict:
    return copy.deepcopy(manifest)


def type_of(t: list) -> Type:
    return Type(*t)


def list_of(t: Type) -> list:
    return [t.kind, t.a, t.b, t.start, t.end]
