"""Sessions: statements in, results out. parse, check privileges, bind, run."""

from __future__ import annotations

import contextlib
import datetime as dt
import functools
import itertools
import re
import threading
import uuid
import zoneinfo
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from larkspur.access import Access, verify
from larkspur.dialect.parser import Node, parse
from larkspur.dialect.types import BIGINT, BOOLEAN, DATE, DOUBLE, INTEGER, REAL, SMALLINT, Type, varchar
from larkspur.errors import SqlError, from_spark
from larkspur.functions import rules as R
from larkspur.plans import ddl, dml
from larkspur.plans.binder import Binder, Bound, Relation
from larkspur.sources import dictionary
from larkspur.sources.store import Store, fresh, new_manifest, new_space, scratch_folder, type_of

DATA, DDL = ("Query", "Insert", "Update", "Delete"), ("Create", "Alter", "Drop", "Truncate", "Grant", "Revoke")
MAX_PAGE, PAGE_BYTES = 100_000, 1 << 20
_numbers = itertools.count(1)


@dataclass
class Result:
    """columns [(name, declared type)]; a DataFrame for queries, else a message and the rows changed."""

    columns: list[tuple[str, Type]] = field(default_factory=list)
    frame: DataFrame | None = None
    message: str = ""
    count: int = -1
    tag: str = ""

    def rows(self) -> list[tuple]:
        """All rows, as Python values. For large results use `fetch`."""
        try:
            with tagged(self.frame, self.tag):
                return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []
        except Exception as e:
            raise from_spark(e) from e

    def fetch(self, pages: int = 500):
        """Lists of up to `pages` rows (100,000 at most), or fewer when texts and bytes fill 1 MiB; a partition at a time comes to the driver."""
        pages = min(pages, MAX_PAGE)
        try:
            with tagged(self.frame, self.tag):
                it = self.frame.toLocalIterator()
                page = next_page(it, pages)
            while page:
                yield page
                with tagged(self.frame, self.tag):
                    page = next_page(it, pages)
        except Exception as e:
            raise from_spark(e) from e

    def spool(self) -> Spool:
        """The rows written once, to be read from any position, forwards or backwards."""
        return Spool(self)


def next_page(it, most: int) -> list[tuple]:
    """Up to `most` rows; the row that passes PAGE_BYTES is the page's last, so that a page is never empty for a long row."""
    page, size = [], 0
    for r in itertools.islice(it, most):
        page.append(tuple(r))
        size += sum(len(v) if isinstance(v, (bytes, bytearray)) else len(v.encode()) if isinstance(v, str) else 8 for v in page[-1])
        if size >= PAGE_BYTES:
            break
    return page


class Spool:
    """A result in files of the shared scratch folder. Spark numbers part files in order of the result's partitions, so a row's position is
    its file's offset and its place in the file; the driver keeps one count a file."""

    def __init__(self, result: Result):
        spark = result.frame.sparkSession
        self.columns, self.path = result.columns, scratch_folder(spark)
        plain = result.frame.toDF(*[f"c{i}" for i in range(len(result.columns))])
        plain.write.parquet(self.path)
        self.rows = spark.read.schema(plain.schema).parquet(self.path).select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        counts = sorted((r["__file"], r["count"]) for r in self.rows.groupBy("__file").count().collect())
        self.starts = list(itertools.accumulate([n for _, n in counts], initial=0))
        self.files, self.count = [f for f, _ in counts], self.starts[-1]

    def read(self, start: int, n: int = 500) -> list[tuple]:
        """Rows start to start + n (100,000 at most), from 0; only files that hold them are read."""
        end = min(start + min(n, MAX_PAGE), self.count)
        some = [(f, max(start, a) - a, min(end, b) - a) for f, (a, b) in zip(self.files, itertools.pairwise(self.starts), strict=True) if a < end and b > start]
        if start >= end or not some:
            return []
        parts = [(F.col("__file") == f) & (F.col("__row") >= lo) & (F.col("__row") < hi) for f, lo, hi in some]
        wanted = self.rows.filter(functools.reduce(lambda a, b: a | b, parts)).orderBy("__file", "__row")
        return [tuple(r) for r in wanted.drop("__file", "__row").collect()]

    def close(self) -> None:
        spark = self.rows.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextlib.contextmanager
def tagged(frame: DataFrame | None, tag: str):
    """Spark jobs started inside carry the session's tag, by which cancel() finds them."""
    if frame is None or not tag:
        yield
        return
    context = frame.sparkSession.sparkContext
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


@dataclass
class Transaction:
    base: int
    manifest: dict
    explicit: bool
    start: dict
    savepoints: list[tuple[str, dict]] = field(default_factory=list)
    changed: bool = False
    #: Tables that were read FOR UPDATE.
    claimed: set[tuple[str, str]] = field(default_factory=set)


class Database:
    """A folder of tables, or, without one, tables that other Parquet files back (read only)."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.lock, self.sessions = spark, threading.RLock(), {}
        self.store = Store(spark, root) if root else None
        self.attached: dict[str, dict[str, Relation]] = {}
        self.memory = new_manifest()

    def load(self) -> tuple[int, dict]:
        return self.store.load() if self.store else (0, self.memory)

    def attach(self, space: str, tables: dict[str, DataFrame]) -> None:
        """Names existing DataFrames as tables of a tablespace; column names are upper-cased."""
        own = self.attached.setdefault(space, {})
        self.memory["spaces"].setdefault(space, new_space(space))
        for name, df in tables.items():
            view = f"larkspur_{uuid.uuid4().hex}"
            df.toDF(*[c.upper() for c in df.columns]).createOrReplaceTempView(view)
            own[name.upper()] = Relation([(f.name.upper(), declared(f.dataType)) for f in df.schema.fields if declared(f.dataType)], f"`{view}`", key=(space, name.upper()))

    def detach(self) -> None:
        """Forgets attached tables; DataFrames already made of them keep working."""
        for own in self.attached.values():
            for r in own.values():
                self.spark.catalog.dropTempView(r.sql.strip("`"))
        self.attached.clear()

    def connect(self, user: str = "SYSTEM", password: str = "", space: str | None = None) -> Session:
        _, m = self.load()
        if user not in m["users"] or not verify(password, m["users"][user]["password"]):
            raise SqlError("28000", "User or password is wrong")
        return Session(self, user, space or m["users"][user]["space"])


def declared(t: S.DataType) -> Type | None:
    """The dialect's type of a Spark column; None for what the dialect doesn't have (arrays, maps)."""
    if isinstance(t, S.DecimalType):
        return Type("DECIMAL", t.precision, t.scale)
    return {S.StringType: varchar(65_535), S.ShortType: SMALLINT, S.ByteType: SMALLINT, S.IntegerType: INTEGER, S.LongType: BIGINT, S.FloatType: REAL, S.DoubleType: DOUBLE, S.BooleanType: BOOLEAN, S.DateType: DATE, S.TimestampNTZType: Type("TIMESTAMP", 6), S.BinaryType: Type("VARBINARY", 65_535)}.get(type(t))


def merge(start: dict, mine: dict, latest: dict) -> dict | None:
    """`latest` with the tables that `mine` has changed since `start`; None if they, or tables that keys link them to, have changed in `latest` too, or if `mine` has changed more than rows."""
    bare = lambda m: {**m, "spaces": {s: {**v, "tables": {n: {**t, "segments": None, "stats": None} for n, t in v["tables"].items()}} for s, v in m["spaces"].items()}}
    if bare(start) != bare(mine):
        return None
    out = fresh(latest)
    for space, s in mine["spaces"].items():
        old, now = start["spaces"][space]["tables"], latest["spaces"].get(space, {"tables": {}})["tables"]
        for name, t in s["tables"].items():
            if t == old[name]:
                continue
            linked = {name, *(f["parent"] for f in t["fks"]), *(c for c, x in now.items() if any(f["parent"] == name for f in x["fks"]))}
            if any(now.get(x) != old.get(x) for x in linked):
                return None
            out["spaces"][space]["tables"][name] = t
    return out


class Session:
    def __init__(self, db: Database, user: str, space: str | None):
        self.db, self.spark, self.user, self.space = db, db.spark, user, space
        self.number, self.autocommit, self.zone, self.txn = next(_numbers), True, "UTC", None
        self.clock, self.views, self.unchecked, self.read = self.now(), [], [], set()
        db.sessions[self.number] = self

    def close(self) -> None:
        self.txn = None
        self.db.sessions.pop(self.number, None)

    # state

    @property
    def manifest(self) -> dict:
        return self.txn.manifest if self.txn else self.db.load()[1]

    def now(self) -> dt.datetime:
        return dt.datetime.now(_zone(self.zone)).replace(tzinfo=None)

    def in_transaction(self) -> Transaction:
        if self.txn is None:
            base, m = self.db.load()
            self.txn = Transaction(base, fresh(m), False, start=m)
        return self.txn

    def refresh(self) -> None:
        """READ COMMITTED: before a statement, what others have committed to tables that this transaction hasn't changed comes in."""
        txn = self.txn
        if txn is None or txn.savepoints or self.db.store is None:
            return
        version, latest = self.db.load()
        if self.lost(latest):
            return  # what was read FOR UPDATE has changed: the snapshot stays, and the commit fails
        if version != txn.base and (merged := merge(txn.start, txn.manifest, latest)) is not None:
            txn.base, txn.start, txn.manifest = version, latest, merged

    def lost(self, latest: dict, txn: Transaction | None = None) -> bool:
        """Whether others have changed a table that the transaction has read FOR UPDATE."""
        txn = txn or self.txn
        of = lambda m, key: m["spaces"].get(key[0], {"tables": {}})["tables"].get(key[1])
        return any(of(latest, key) != of(txn.start, key) for key in txn.claimed)

    def commit(self) -> None:
        txn, self.txn = self.txn, None
        if txn is not None and txn.changed:
            if self.db.store is None:
                self.db.memory = txn.manifest
                return
            with self.db.lock:
                for _ in range(10):
                    version, latest = self.db.load()
                    mine = txn.manifest if version == txn.base else None if self.lost(latest, txn) else merge(txn.start, txn.manifest, latest)
                    if mine is None:
                        break
                    with contextlib.suppress(SqlError):  # another process was faster; look again
                        self.db.store.save(version, mine)
                        return
            raise SqlError("40001", "Another session has changed the same tables meanwhile; run the transaction again")

    def rollback(self) -> None:
        self.txn = None

    # names

    def key(self, name: Node, must: bool = True) -> tuple[str, str] | None:
        space = name.space or self.space
        if space is None:
            if must:
                raise SqlError("3F000", f"No tablespace is in use; write TABLESPACE.{name.name}", name.at)
            return None
        return space, name.name

    def relation(self, space: str | None, name: str, at=None) -> Relation:
        own = space or self.space
        m = self.manifest
        if own is not None:
            if r := self.db.attached.get(own, {}).get(name):
                return r
            s = m["spaces"].get(own)
            if s is None:
                raise SqlError("3D000", f"Tablespace {own} does not exist", at)
            if t := s["tables"].get(name):
                return self.table_relation(own, name, t)
            if v := s["views"].get(name):
                return Relation([], view=v["text"], view_columns=v["columns"], key=(own, name))
        if space is None and name == "DUAL":
            return Relation([("DUMMY", varchar(1))], "SELECT 'X' AS DUMMY", view=None, key=("SYSTEM", "DUAL"))
        if space in (None, "SYSTEM") and name in dictionary.COLUMNS:
            return self.dictionary_relation(name)
        if own is None:
            raise SqlError("3F000", f"No tablespace is in use; write TABLESPACE.{name}", at)
        raise SqlError("42P01", f"Table or view {own}.{name} does not exist", at)

    def table_relation(self, space: str, name: str, t: dict) -> Relation:
        self.read.add((space, name))
        df = self.db.store.read(t)
        view = f"larkspur_{uuid.uuid4().hex}"
        df.toDF(*[c["name"] for c in t["columns"]]).createOrReplaceTempView(view)
        self.views.append(view)
        return Relation([(c["name"], type_of(c["type"])) for c in t["columns"]], f"`{view}`", key=(space, name))

    def dictionary_relation(self, name: str) -> Relation:
        access = Access(self.manifest, self.user)
        sessions = [(s.number, s.user, s.space, "ON" if s.autocommit else "OFF", "YES" if s.txn and s.txn.explicit else "NO", "LOCAL", None) for s in self.db.sessions.values()]
        rows = dictionary.rows(name, self.manifest, access.sees, self.user, access.dba, self.view_columns, sessions)
        columns = dictionary.COLUMNS[name]
        view = f"larkspur_{uuid.uuid4().hex}"
        self.spark.createDataFrame(rows, ", ".join(f"{c} {t.spark}" for c, t in columns)).createOrReplaceTempView(view)
        self.views.append(view)
        return Relation(columns, f"`{view}`", key=("SYSTEM", name))

    def view_columns(self, space: str, name: str) -> list[tuple[str, Type]]:
        return self.bind(parse(f'SELECT * FROM "{space}"."{name}"').query).columns

    def binder(self, params=()) -> Binder:
        return Binder(self.relation, self.clock, params, self.zone, self.user, self.space)

    def bind(self, query: Node, params=()) -> Bound:
        return self.binder(params).query(query, None)

    # statements

    def execute(self, sql: str, params=()) -> Result:
        return self.run(parse(sql), list(params))

    def run(self, n: Node, params: list) -> Result:
        if n.params != len(params):
            raise SqlError("07001", f"The statement has {n.params} parameters; {len(params)} were given")
        self.clock, self.views = self.now(), []
        self.refresh()
        Access(self.manifest, self.user).check(n, lambda name: self.access_key(name))
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            if n.kind in DATA:
                return self.data(n, params)
            if n.kind.startswith(DDL):
                return self.definition(n)
            return self.control(n)
        except SqlError:
            raise
        except Exception as e:
            raise from_spark(e) from e
        finally:
            context.removeJobTag(self.tag)
            for v in self.views:
                self.spark.catalog.dropTempView(v)

    def access_key(self, name: Node):
        key = self.key(name, must=False)
        if key is None or key[0] in self.db.attached or name.space is None and (name.name == "DUAL" or name.name in dictionary.COLUMNS):
            return None
        return key

    def frame(self, bound: Bound, texts: bool = True) -> DataFrame:
        """A query's rows; types that Python hasn't (times, intervals, zones) as their text."""
        df = self.spark.sql(bound.sql)
        if texts and any(t.kind in ("TIME", "TIMETZ", "TIMESTAMPTZ", "INTERVAL") for _, t in bound.columns):
            df = df.selectExpr(*[f"{R.text(f'c{i}', t)} AS c{i}" if t.kind in ("TIME", "TIMETZ", "TIMESTAMPTZ", "INTERVAL") else f"c{i}" for i, (_, t) in enumerate(bound.columns)])
        return df.toDF(*[c for c, _ in bound.columns])

    def data(self, n: Node, params: list) -> Result:
        if n.kind == "Query":
            self.read = set()
            bound = self.bind(n.query, params)
            if n.query.for_update and self.db.store is not None and (self.txn is not None or not self.autocommit):
                self.in_transaction().claimed |= self.read
            return Result(bound.columns, self.frame(bound), "SELECT", tag=self.tag)
        if self.db.store is None:
            raise SqlError("25006", "This database is read only")
        txn = self.in_transaction()
        before, dirty = fresh(txn.manifest), txn.changed
        try:
            count = dml.execute(self, n, params)
            txn.changed = True
        except BaseException:
            # a failed statement leaves nothing behind; the transaction goes on
            txn.manifest, txn.changed = before, dirty
            if not txn.explicit and self.autocommit:
                self.rollback()
            raise
        if self.autocommit and not txn.explicit:
            self.commit()
        return Result(message=f"{n.kind.upper()} {count}", count=count)

    def definition(self, n: Node) -> Result:
        if self.db.store is None:
            raise SqlError("25006", "This database is read only")
        self.commit()
        txn = self.in_transaction()
        try:
            message = ddl.execute(self, n)
            txn.changed = True
        except BaseException:
            self.rollback()
            raise
        self.commit()
        return Result(message=message)

    def control(self, n: Node) -> Result:
        k = n.kind
        if k == "Begin":
            if self.txn is not None and (self.txn.explicit or not self.autocommit):
                raise SqlError("25001", "A transaction is already open")
            self.in_transaction().explicit = True
        elif k == "Commit":
            self.commit()
        elif k == "Rollback" and n.savepoint is None:
            self.rollback()
        elif k in ("Savepoint", "Rollback", "Release"):
            if self.txn is None:
                raise SqlError("25P01", "No transaction is open")
            points = self.txn.savepoints
            name = n.savepoint if k == "Rollback" else n.name
            place = next((i for i, (p, _) in enumerate(points) if p == name), None)
            if k == "Savepoint":
                if place is not None:
                    del points[place]
                points.append((name, fresh(self.txn.manifest)))
            elif place is None:
                raise SqlError("3B001", f"Savepoint {name} does not exist")
            elif k == "Rollback":
                self.txn.manifest = fresh(points[place][1])
                del points[place + 1 :]
            else:
                del points[place:]
        elif k == "SetAutocommit":
            if n.value and self.txn is not None:
                self.commit()
            self.autocommit = n.value
        elif k == "Use":
            if n.name not in self.manifest["spaces"]:
                raise SqlError("3D000", f"Tablespace {n.name} does not exist")
            self.space = n.name
        elif k == "SetTimeZone":
            zone = "UTC" if n.zone == "LOCAL" else n.zone
            _zone(zone)
            self.zone = zone
        return Result(message=k)

    # prepared statements and results of other shapes

    def query(self, sql: str, params=()) -> DataFrame:
        """A query's DataFrame, lazy."""
        return self.execute(sql, params).frame

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    @property
    def tag(self) -> str:
        return f"larkspur-session-{self.number}"

    def cancel(self) -> None:
        """Stops this session's running jobs; to be called from another thread."""
        self.spark.sparkContext.cancelJobsWithTag(self.tag)


class Prepared:
    """A parsed statement; its columns are known without running it. Any DDL since makes it invalid."""

    def __init__(self, session: Session, sql: str):
        self.session, self.tree = session, parse(sql)
        self.columns: list[tuple[str, Type]] = []
        self.stamp = self._stamp()
        if self.tree.kind == "Query":
            session.clock, session.views = session.now(), []
            binder = session.binder([None] * self.tree.params)
            binder.describing = True
            self.columns = binder.query(self.tree.query, None).columns

    def _stamp(self):
        spaces = self.session.manifest["spaces"]
        return self.session.space, {s: ({n: t["columns"] for n, t in v["tables"].items()}, v["views"]) for s, v in spaces.items()}

    def execute(self, params=()) -> Result:
        if self._stamp() != self.stamp:
            raise SqlError("0A000", "The prepared statement is no longer valid; prepare it again")
        return self.session.run(self.tree, list(params))


def _zone(name: str):
    if m := re.fullmatch(r"([+-])(\d{1,2}):(\d{2})", name):
        return dt.timezone((1 if m[1] == "+" else -1) * dt.timedelta(hours=int(m[2]), minutes=int(m[3])))
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        raise SqlError("22009", f"Time zone '{name}' is not known") from None
