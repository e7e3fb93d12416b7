"""INSERT, UPDATE and DELETE as new versions of tables, with constraints and referential actions.

Values are computed on the state before the statement. Changed rows are found and written by
DataFrame jobs; only segments that hold changed rows are written anew. Each new segment is measured in
one pass, which answers NOT NULL and tells the ranges of its keys; primary and foreign keys are checked
with aggregates and anti-joins against the segments whose ranges meet them. Removed or moved parent
keys go through a work list until no child changes any more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.dialect.parser import Node, parse
from larkspur.dialect.types import NULL, Type
from larkspur.errors import SqlError
from larkspur.functions import rules as R
from larkspur.plans.binder import AGGREGATES, Binder, Expr, Field, Scope, Source, tick
from larkspur.sources import dictionary
from larkspur.sources.store import SEGMENT, hold, overlapping, type_of

PLACE = ["__file", "__row"]


def execute(session, n: Node, params: list) -> int:
    session.unchecked = []  # foreign keys to look at when all actions have ended
    return {"Insert": insert, "Update": update, "Delete": delete}[n.kind](session, n, params)


# targets: a table, or an updatable view down to its table


class Target:
    """A base table with the names by which a statement may call its columns, and the conditions of the views between."""

    def __init__(self, space: str, name: str, table: dict, columns: dict[str, str | None], conditions: list[tuple[Node, dict[str, str | None], str, list[str]]]):
        self.space, self.name, self.table, self.columns, self.conditions = space, name, table, columns, conditions


def target(session, name: Node, at_space: str | None = None) -> Target:
    space = name.space or at_space or session.space
    if space is None:
        raise SqlError("3F000", f"No tablespace is in use; write TABLESPACE.{name.name}", name.at)
    s = session.manifest["spaces"].get(space)
    if s is None:
        raise SqlError("3D000", f"Tablespace {space} does not exist", name.at)
    if t := s["tables"].get(name.name):
        return Target(space, name.name, t, {c["name"]: c["name"] for c in t["columns"]}, [])
    v = s["views"].get(name.name)
    if v is None:
        if name.name == "DUAL" or name.name in dictionary.COLUMNS:
            raise SqlError("42809", f"{name.name} is read only", name.at)
        raise SqlError("42P01", f"Table or view {space}.{name.name} does not exist", name.at)
    q = parse(v["text"]).query
    b = q.body
    grouped = b.kind != "Select" or b.distinct or b.groups is not None or b.having is not None or len(b.sources) != 1 or b.sources[0].kind != "Table" or q.limit is not None or q.offset is not None
    if grouped or any(i.kind == "Item" and _aggregates(i.expr) for i in b.items):
        raise SqlError("42P17", f"View {name.name} cannot be changed: it is not of one table's rows", name.at)
    below = target(session, b.sources[0].name, space)
    own = b.sources[0].alias or b.sources[0].name.name
    mapping: list[str | None] = []
    for i in b.items:
        if i.kind == "Star":
            mapping += list(below.columns.values())
        elif i.expr.kind == "Column":
            mapping.append(below.columns.get(i.expr.parts[-1]))
        else:
            mapping.append(None)
    conditions = below.conditions + ([(b.where, below.columns, own, [space])] if b.where is not None else [])
    return Target(below.space, below.name, below.table, dict(zip(v["columns"], mapping, strict=True)), conditions)


def _aggregates(n) -> bool:
    if isinstance(n, list):
        return any(map(_aggregates, n))
    if not isinstance(n, Node) or n.kind in ("Scalar", "Exists", "InQuery", "Quantified"):
        return False
    return n.kind == "Call" and n.name in AGGREGATES or any(_aggregates(v) for v in n.__dict__.values())


def base_column(t: Target, name: str) -> dict:
    if name not in t.columns:
        raise SqlError("42703", f"Column {name} does not exist")
    if t.columns[name] is None:
        raise SqlError("42P17", f"Column {name} of the view is not a column of the table")
    return next(c for c in t.table["columns"] if c["name"] == t.columns[name])


# values


def stored(e: Expr, t: Type, b: Binder) -> str:
    """SQL of a value as it is stored in a column of type t."""
    if e.type.kind == "NULL":
        return f"CAST(NULL AS {t.spark})"
    if e.type.kind == "TEXT":
        if t.kind in ("CHAR", "VARCHAR"):
            return R.cast(e.sql, Type("VARCHAR", max(1, len(e.raw))), t)
        value, e = b.literal(e.raw, t), Expr("", NULL)
        return R.fit_bytes(value, t, 1 << 30) if t.kind in ("BINARY", "VARBINARY") else value
    if e.type.family != t.family:
        raise SqlError("42804", f"A value of type {e.type} cannot be stored as {t}")
    return R.cast(e.sql, e.type, t, b.zone, b.today)


def assigned(b: Binder, tree: Node, t: Type, scope: Scope | None = None) -> str:
    return f"CAST({stored(b.expr(tree, scope or Scope([])), t, b)} AS {t.spark})"


def default_of(session, c: dict, b: Binder) -> str:
    t = type_of(c["type"])
    if c["default"] is None:
        return f"CAST(NULL AS {t.spark})"
    return assigned(b, parse(f"SELECT {c['default']}").query.body.items[0].expr, t)


def insert(session, n: Node, params: list) -> int:
    t, b = target(session, n.table), session.binder(params)
    names = n.columns or list(t.columns)
    if len(set(names)) < len(names):
        raise SqlError("42701", "A column is named twice")
    columns = [base_column(t, c) for c in names]
    given = {c["id"] for c in columns}
    rest = [(c, default_of(session, c, b)) for c in t.table["columns"] if c["id"] not in given]
    if n.query is not None:
        bound = b.query(n.query, None)
        if len(bound.columns) != len(columns):
            raise SqlError("42804", f"{len(columns)} columns, but {len(bound.columns)} values")
        values = [f"CAST({stored(Expr(f'q.c{i}', kind), type_of(c['type']), b)} AS {type_of(c['type']).spark}) AS `{c['id']}`" for i, (c, (_, kind)) in enumerate(zip(columns, bound.columns, strict=True))]
        rows = session.spark.sql(f"SELECT {', '.join(values + [f'{v} AS `{c['id']}`' for c, v in rest])} FROM ({bound.sql}) q")
    else:
        selects = []
        for row in n.rows:
            row = [Node("Default", at=None)] * len(columns) if row is None else row
            if len(row) != len(columns):
                raise SqlError("42804", f"{len(columns)} columns, but {len(row)} values")
            own = [default_of(session, c, b) if v.kind == "Default" else assigned(b, v, type_of(c["type"])) for c, v in zip(columns, row, strict=True)]
            selects.append("SELECT " + ", ".join([f"{v} AS `{c['id']}`" for c, v in zip(columns, own, strict=True)] + [f"{v} AS `{c['id']}`" for c, v in rest]))
        rows = session.spark.sql(" UNION ALL ".join(selects)).coalesce(1)
    rows = rows.select(*[c["id"] for c in t.table["columns"]])
    store = session.db.store
    segment = store.write(rows)
    added = store.read(t.table, [segment])
    facts = store.measure(added, t.table, key_columns(t.table))
    if facts["rows"]:
        check_rows(session, t.space, t.name, added, facts, added_only=True)
        hold(t.table, [*t.table["segments"], segment], {segment: facts})
        for fk in t.table["fks"]:
            check_child(session, t.space, t.name, fk, added, facts["ranges"])
        store.compact(t.table)
    return facts["rows"]


# finding and changing rows


def marked(session, t: Target, n: Node, params: list, sets: list[tuple[dict, str]], scope_of) -> DataFrame:
    """The rows that a statement hits, with where they stand and their new values under n_<id>."""
    store, view = session.db.store, f"larkspur_target_{id(n):x}"
    store.located(t.table).createOrReplaceTempView(view)
    session.views.append(view)
    b, scope = scope_of
    conds = []
    for where, columns, alias, spaces in t.conditions:
        saved, b.space = b.space, spaces[0]
        conds.append(b.boolean(b.condition(where, row_scope(t, columns, alias), "WHERE")))
        b.space = saved
    if n.where is not None:
        conds.append(b.boolean(b.condition(n.where, scope, "WHERE")))
    # the hits are found by WHERE, where Spark plans subqueries as joins
    news = "".join(f", {v} AS `n_{c['id']}`" for c, v in sets)
    return session.spark.sql(f"SELECT t.*{news} FROM {view} t" + (f" WHERE {' AND '.join(f'({c})' for c in conds)}" if conds else ""))


def row_scope(t: Target, columns: dict[str, str | None], alias: str) -> Scope:
    by = {c["name"]: c for c in t.table["columns"]}
    fields = [Field(shown, type_of(by[c]["type"]), f"t.{tick(by[c]['id'])}") for shown, c in columns.items() if c is not None]
    return Scope([Source([(alias,)], fields)])


def update(session, n: Node, params: list) -> int:
    t, b = target(session, n.table), session.binder(params)
    names = [c for c, _ in n.sets]
    if len(set(names)) < len(names):
        raise SqlError("42701", "A column is set twice")
    scope = row_scope(t, t.columns, n.alias or n.table.name)
    if not n.alias:
        scope.sources[0].qualifiers.append((t.space, n.table.name))
    sets = []
    for name, value in n.sets:
        c = base_column(t, name)
        sets.append((c, default_of(session, c, b) if value.kind == "Default" else assigned(b, value, type_of(c["type"]), scope)))
    if not t.table["segments"]:
        return 0
    hits = marked(session, t, n, params, sets, (b, scope))
    return change(session, t.space, t.name, hits, {c["id"] for c, _ in sets})


def delete(session, n: Node, params: list) -> int:
    t, b = target(session, n.table), session.binder(params)
    scope = row_scope(t, t.columns, n.alias or n.table.name)
    if not n.alias:
        scope.sources[0].qualifiers.append((t.space, n.table.name))
    if not t.table["segments"]:
        return 0
    return change(session, t.space, t.name, marked(session, t, n, params, [], (b, scope)), None)


def change(session, space: str, name: str, hits: DataFrame, ids: set[str] | None, check: bool = True) -> int:
    """Applies hits (old row, its place, new values n_<id>; ids None: deleted) to a table, then to its children."""
    store, m = session.db.store, session.manifest
    table = m["spaces"][space]["tables"][name]
    columns = [c["id"] for c in table["columns"]]
    hits = store.stage(hits)
    per = {r[SEGMENT]: r["count"] for r in hits.groupBy(SEGMENT).count().collect()}
    if not per:
        return 0
    keep = [s for s in table["segments"] if s not in per]
    old = store.located({**table, "segments": [s for s in table["segments"] if s in per]})
    # only the places of the hits are looked up, so few hits are broadcast and old rows aren't shuffled
    left = old.join(hits.select(*PLACE), PLACE, "left_anti").select(*columns)
    new = None
    if ids is not None:
        new = hits.select(*[F.col(f"n_{c}" if c in ids else c).alias(c) for c in columns])
    measured = {}
    for rows in [left] if new is None else [left, new]:
        segment = store.write(rows)
        measured[segment] = facts = store.measure(store.read(table, [segment]), table, key_columns(table))
    if new is not None:
        new = store.read(table, [segment])
    hold(table, keep + [s for s, m in measured.items() if m["rows"]], {s: m for s, m in measured.items() if m["rows"]})
    pk = [next(c["id"] for c in table["columns"] if c["name"] == x) for x in table["pk"]["columns"]] if table["pk"] else []
    moved = ids is None or any(c in ids for c in pk)
    children = [(c, f) for c, f in _referencing(m, space, name)] if pk and moved else []
    if new is not None and check:
        check_rows(session, space, name, new, facts, pk=any(c in ids for c in pk))
        for fk in table["fks"]:
            if any(_id(table, c) in ids for c in fk["columns"]):
                session.unchecked.append((space, name, fk, new, facts["ranges"]))
    if children:
        keys = hits.select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(pk)], *[(F.col(f"n_{c}") if ids and c in ids else F.col(c) if ids is not None else F.lit(None).cast(hits.schema[c].dataType)).alias(f"n{i}") for i, c in enumerate(pk)], F.lit(ids is None).alias("gone"))
        keys = keys.filter(F.col("gone") | reduce(Column.__or__, [F.col(f"o{i}") != F.col(f"n{i}") for i in range(len(pk))]))
        # a key that another row has taken since is still there
        now = store.read(table).select(*[F.col(c).alias(f"o{i}") for i, c in enumerate(pk)])
        keys = keys.join(now, [f"o{i}" for i in range(len(pk))], "left_anti")
        keys = store.stage(keys)
        if keys.take(1):
            for child, fk in children:
                follow(session, space, child, fk, table, keys)
    while check and session.unchecked:
        check_child(session, *session.unchecked.pop())
    return sum(per.values())


def follow(session, space: str, child: str, fk: dict, parent: dict, keys: DataFrame) -> None:
    """Referential actions of one foreign key for removed or moved parent keys."""
    store = session.db.store
    table = session.manifest["spaces"][space]["tables"][child]
    if not table["segments"]:
        return
    ids = [_id(table, c) for c in fk["columns"]]
    order = [parent["pk"]["columns"].index(p) for p in fk["parent_columns"]]
    match = reduce(Column.__and__, [F.col(i) == F.col(f"o{k}") for i, k in zip(ids, order, strict=True)])
    rows = store.located(table)
    for gone, action in ((True, fk["delete"]), (False, fk["update"])):
        hits = rows.join(keys.filter(F.col("gone") == gone), match)
        plain = [c["id"] for c in table["columns"]] + [SEGMENT, *PLACE]
        if action in ("NO ACTION", "RESTRICT"):
            session.unchecked.append((space, child, fk, None))
        elif action == "CASCADE" and gone:
            change(session, space, child, hits.select(*plain), None, check=False)
        else:
            value = lambda i, k: F.lit(None).cast(rows.schema[i].dataType) if action == "SET NULL" else F.col(f"n{k}").cast(rows.schema[i].dataType)  # noqa: B023, E731
            changed = hits.select(*plain, *[value(i, k).alias(f"n_{i}") for i, k in zip(ids, order, strict=True)])
            change(session, space, child, changed, set(ids), check=False)
            # cascaded rows keep all constraints too
            check_table(session, space, child, not_null=fk["columns"], pk=bool(table["pk"] and set(fk["columns"]) & set(table["pk"]["columns"])))
        table = session.manifest["spaces"][space]["tables"][child]
        if not table["segments"]:
            return
        rows = store.located(table)


def _referencing(m: dict, space: str, name: str):
    return [(t, f) for t, tab in m["spaces"][space]["tables"].items() for f in tab["fks"] if f["parent"] == name]


def _id(table: dict, name: str) -> str:
    return next(c["id"] for c in table["columns"] if c["name"] == name)


# constraints


def key_columns(table: dict) -> set[str]:
    """Ids of the columns of primary and foreign keys."""
    names = set(table["pk"]["columns"] if table["pk"] else ()).union(*[f["columns"] for f in table["fks"]])
    return {c["id"] for c in table["columns"] if c["name"] in names}


def check_rows(session, space: str, name: str, rows: DataFrame, facts: dict, added_only: bool = False, pk: bool = True) -> None:
    """NOT NULL of new rows, and their primary keys: among themselves and against the table without them (added_only), or in the whole table with them."""
    table, store = session.manifest["spaces"][space]["tables"][name], session.db.store
    for c in table["columns"]:
        if facts["nulls"].get(c["id"]):
            raise SqlError("23502", f"Column {c['name']} of {name} cannot be NULL")
    if table["pk"] and pk:
        ids = [_id(table, c) for c in table["pk"]["columns"]]
        # a key that stands twice is one of the new rows', so only segments that can hold one of theirs are read
        near = store.read(table, overlapping(table, facts["ranges"]))
        twice = (rows if added_only else near).groupBy(*ids).count().filter("count > 1").take(1)
        if twice or added_only and rows.join(near.select(*ids), ids, "left_semi").take(1):
            raise SqlError("23505", f"Primary key {table['pk']['name']} of {name} would hold a value twice")


def check_table(session, space: str, name: str, not_null=(), pk: bool = False) -> None:
    table = session.manifest["spaces"][space]["tables"][name]
    if not table["segments"]:
        return
    rows = session.db.store.read(table)
    facts = session.db.store.measure(rows, {**table, "columns": [c for c in table["columns"] if c["name"] in not_null]}, set()) if not_null else {"nulls": {}}
    for c in table["columns"]:
        if facts["nulls"].get(c["id"]):
            raise SqlError("23502", f"Column {c['name']} of {name} cannot be NULL")
    if pk and table["pk"] and rows.groupBy(*[_id(table, c) for c in table["pk"]["columns"]]).count().filter("count > 1").take(1):
        raise SqlError("23505", f"Primary key {table['pk']['name']} of {name} would hold a value twice")


def check_child(session, space: str, name: str, fk: dict, rows: DataFrame | None = None, ranges: dict[str, list] | None = None) -> None:
    """Every foreign key without a NULL has its parent row. `ranges` of the rows' columns spare the parent's segments outside them."""
    s = session.manifest["spaces"][space]["tables"]
    table, parent = s[name], s[fk["parent"]]
    rows = session.db.store.read(table) if rows is None else rows
    ids = [_id(table, c) for c in fk["columns"]]
    own = rows.select(*[F.col(i).alias(f"k{n}") for n, i in enumerate(ids)]).filter(" AND ".join(f"k{n} IS NOT NULL" for n in range(len(ids))))
    to = [_id(parent, c) for c in fk["parent_columns"]]
    near = overlapping(parent, {p: ranges[c] for c, p in zip(ids, to, strict=True) if c in ranges}) if ranges else None
    there = session.db.store.read(parent, near).select(*[F.col(p).cast(own.schema[f"k{n}"].dataType).alias(f"k{n}") for n, p in enumerate(to)])
    if own.join(there, [f"k{n}" for n in range(len(ids))], "left_anti").take(1):
        raise SqlError("23503", f"Foreign key {fk['name']} of {name} has a value without a row in {fk['parent']}")


def has_references(session, space: str, name: str, fk: dict) -> bool:
    table = session.manifest["spaces"][space]["tables"][name]
    ids = [_id(table, c) for c in fk["columns"]]
    return bool(table["segments"] and session.db.store.read(table).filter(" AND ".join(f"`{i}` IS NOT NULL" for i in ids)).take(1))
