"""The engine as a PEP 249 module: connect, cursors, `?` parameters, the standard's errors."""

from __future__ import annotations

import datetime as dt
import itertools
import weakref

from pyspark.sql import SparkSession

from larkspur.errors import SqlError, from_spark
from larkspur.session import Database, Session

#: Cursors of one connection that may hold rows not yet read.
MAX_CURSORS = 16

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Date, Time, Timestamp, Binary = dt.date, dt.time, dt.datetime, bytes
DateFromTicks, TimestampFromTicks = dt.date.fromtimestamp, dt.datetime.fromtimestamp


def TimeFromTicks(ticks: float) -> dt.time:  # noqa: N802
    return dt.datetime.fromtimestamp(ticks).time()


class Kind:
    """A type object: equal to the declared types it stands for."""

    def __init__(self, *kinds: str):
        self.kinds = kinds

    def __eq__(self, other):
        return getattr(other, "kind", other) in self.kinds if not isinstance(other, Kind) else self.kinds == other.kinds

    __hash__ = None


STRING, BINARY = Kind("CHAR", "VARCHAR"), Kind("BINARY", "VARBINARY")
NUMBER = Kind("SMALLINT", "INTEGER", "BIGINT", "DECIMAL", "REAL", "DOUBLE")
DATETIME, ROWID = Kind("DATE", "TIME", "TIMETZ", "TIMESTAMP", "TIMESTAMPTZ"), Kind()


class Warning(Exception):  # noqa: A001
    pass


class Error(Exception):
    sqlstate: str | None = None


class InterfaceError(Error):
    pass


class DatabaseError(Error):
    pass


class DataError(DatabaseError):
    pass


class OperationalError(DatabaseError):
    pass


class IntegrityError(DatabaseError):
    pass


class InternalError(DatabaseError):
    pass


class ProgrammingError(DatabaseError):
    pass


class NotSupportedError(DatabaseError):
    pass


def _raised(e: SqlError) -> DatabaseError:
    by_class = {"0A": NotSupportedError, "22": DataError, "23": IntegrityError, "40": OperationalError, "55": OperationalError, "28": OperationalError, "XX": InternalError}
    out = by_class.get(e.sqlstate[:2], ProgrammingError)(str(e))
    out.sqlstate = e.sqlstate
    return out


class Cursor:
    arraysize = 1

    def __init__(self, connection: Connection):
        self.connection, self.rowcount, self.description, self._rows, self._open = connection, -1, None, None, True

    def _check(self) -> None:
        if not self._open or not self.connection._open:
            raise InterfaceError("The cursor is closed")

    def execute(self, operation: str, parameters=()) -> Cursor:
        self._check()
        reading = self.connection.reading
        reading.discard(self)
        try:
            got = self.connection.session.execute(operation, tuple(parameters))
            if got.frame is not None and len(reading) >= MAX_CURSORS:
                raise SqlError("53400", f"A connection reads at most {MAX_CURSORS} results at a time")
        except SqlError as e:
            raise _raised(e) from e
        self.rowcount, self._rows, self.description = got.count, None, None
        if got.frame is not None:
            self.description = [(name, kind, None, None, kind.a or None, kind.b if kind.kind == "DECIMAL" else None, None) for name, kind in got.columns]
            self._rows = itertools.chain.from_iterable(got.fetch())
            reading.add(self)
        return self

    def executemany(self, operation: str, seq_of_parameters) -> Cursor:
        total = 0
        for p in seq_of_parameters:
            self.execute(operation, p)
            total += max(0, self.rowcount)
        self.rowcount = total
        return self

    def callproc(self, *_):
        raise NotSupportedError("Procedures do not exist")

    def fetchmany(self, size: int | None = None) -> list[tuple]:
        self._check()
        if self._rows is None:
            raise ProgrammingError("No query has been executed")
        size = self.arraysize if size is None else size
        try:
            out = list(itertools.islice(self._rows, size))
            if len(out) < size:
                self.connection.reading.discard(self)
            return out
        except SqlError as e:
            raise _raised(e) from e
        except Exception as e:
            raise _raised(from_spark(e)) from e

    def fetchone(self) -> tuple | None:
        return next(iter(self.fetchmany(1)), None)

    def fetchall(self) -> list[tuple]:
        return self.fetchmany(1 << 62)

    def __iter__(self):
        while (row := self.fetchone()) is not None:
            yield row

    def setinputsizes(self, sizes) -> None:
        pass

    def setoutputsize(self, size, column=None) -> None:
        pass

    def close(self) -> None:
        self._open = False
        self.connection.reading.discard(self)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()


class Connection:
    Error, DatabaseError, ProgrammingError = Error, DatabaseError, ProgrammingError

    def __init__(self, session: Session):
        self.session, self._open = session, True
        self.reading: weakref.WeakSet[Cursor] = weakref.WeakSet()
        session.autocommit = False

    def cursor(self) -> Cursor:
        if not self._open:
            raise InterfaceError("The connection is closed")
        return Cursor(self)

    def commit(self) -> None:
        try:
            self.session.commit()
        except SqlError as e:
            raise _raised(e) from e

    def rollback(self) -> None:
        self.session.rollback()

    def set_autocommit(self, value: bool) -> None:
        self.cursor().execute(f"SET AUTOCOMMIT {'ON' if value else 'OFF'}")

    def close(self) -> None:
        self.session.close()
        self._open = False

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self._open:
            self.commit() if kind is None else self.rollback()
            self.close()


def connect(database: str | Database, user: str = "SYSTEM", password: str = "", tablespace: str | None = None, spark: SparkSession | None = None) -> Connection:
    """A connection to the database in a folder (any path that Hadoop's file systems know)."""
    if isinstance(database, str):
        database = Database(spark or SparkSession.builder.getOrCreate(), database)
    try:
        return Connection(database.connect(user, password, tablespace))
    except SqlError as e:
        raise _raised(e) from e
