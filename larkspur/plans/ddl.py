"""Definition statements: edits of the manifest, and rewrites where rows must change."""

from __future__ import annotations

import itertools
import uuid

from larkspur.access import OBJECT_PRIVILEGES, Access, hashed, reads
from larkspur.dialect.parser import PRIVILEGES, Node
from larkspur.errors import SqlError, unsupported
from larkspur.plans import dml
from larkspur.sources import dictionary
from larkspur.sources.store import list_of, new_space, type_of

MAX_COLUMNS, MAX_INDEX_COLUMNS = 1000, 16


def execute(session, n: Node) -> str:
    return globals()[f"do_{n.kind.lower()}"](session, session.txn.manifest, n)


# lookups


def space_of(m: dict, name: str) -> dict:
    if name not in m["spaces"]:
        raise SqlError("3D000", f"Tablespace {name} does not exist")
    return m["spaces"][name]


def find(session, m, name: Node, kind: str = "tables") -> tuple[str, str, dict]:
    space, obj = session.key(name)
    s = space_of(m, space)
    if obj in s[kind]:
        return space, obj, s[kind][obj]
    other = {"tables": "views", "views": "tables"}.get(kind)
    if other and obj in s[other]:
        raise SqlError("42809", f"{space}.{obj} is not a {kind[:-1]}", name.at)
    if obj == "DUAL" or obj in dictionary.COLUMNS:
        raise SqlError("42809", f"{obj} is read only", name.at)
    raise SqlError("42P01" if kind != "indexes" else "42704", f"{kind[:-1].title()} {space}.{obj} does not exist", name.at)


def column(t: dict, name: str) -> dict:
    for c in t["columns"]:
        if c["name"] == name:
            return c
    raise SqlError("42703", f"Column {name} does not exist")


def dependents(m: dict, space: str, name: str) -> list[tuple[str, str]]:
    """Views that read an object, directly or through others."""
    out, todo = [], [(space, name)]
    while todo:
        key = todo.pop()
        for s, sp in m["spaces"].items():
            for v, view in sp["views"].items():
                if list(key) in view["reads"] and (s, v) not in out:
                    out.append((s, v))
                    todo.append((s, v))
    return out


def referencing(m: dict, space: str, name: str) -> list[tuple[str, dict]]:
    return [(t, f) for t, tab in m["spaces"][space]["tables"].items() for f in tab["fks"] if f["parent"] == name]


def free_name(s: dict, stem: str, numbered: bool) -> str:
    used = set(s["indexes"]) | {t["pk"]["name"] for t in s["tables"].values() if t["pk"]} | {f["name"] for t in s["tables"].values() for f in t["fks"]}
    names = (f"{stem}_{k}" for k in itertools.count(1)) if numbered else itertools.chain([stem], (f"{stem}_{k}" for k in itertools.count(1)))
    return next(x for x in names if x not in used)


def taken(s: dict, name: str) -> None:
    if free_name(s, name, False) != name:
        raise SqlError("42710", f"A constraint or index {name} exists")


# tables


def make_column(session, c: Node, in_pk: bool = False) -> dict:
    default = None
    if c.default is not None:
        constant(session, c.default, c.type)
        default = c.default_text
    return {"id": f"c_{uuid.uuid4().hex[:12]}", "name": c.name, "type": list_of(c.type), "not_null": c.not_null or in_pk, "default": default}


def constant(session, tree: Node, t) -> None:
    """A DEFAULT is a constant that its column's type can take."""
    if any(x.kind in ("Scalar", "Exists", "InQuery", "Quantified", "Param") for x in walk(tree)):
        raise unsupported("A DEFAULT with a subquery or parameter")
    dml.assigned(session.binder(), tree, t)


def walk(n):
    if isinstance(n, list):
        for x in n:
            yield from walk(x)
    elif isinstance(n, Node):
        yield n
        for v in n.__dict__.values():
            yield from walk(v)


def do_createtable(session, m, n) -> str:
    space, name = session.key(n.name)
    s = space_of(m, space)
    if name in s["tables"] or name in s["views"]:
        if n.if_not_exists:
            return f'Table "{name}" exists.'
        raise SqlError("42P07", f"{space}.{name} exists")
    names = [c.name for c in n.columns]
    if len(set(names)) < len(names):
        raise SqlError("42701", "Two columns have the same name")
    if not names or len(names) > MAX_COLUMNS:
        raise SqlError("54011", f"A table has from 1 to {MAX_COLUMNS} columns")
    keys = [c for c in n.constraints if c.kind == "PrimaryKey"]
    if len(keys) > 1:
        raise SqlError("42P16", "A table has one primary key")
    in_pk = set(keys[0].columns) if keys else set()
    t = {"owner": session.user, "columns": [make_column(session, c, c.name in in_pk) for c in n.columns], "pk": None, "fks": [], "segments": []}
    s["tables"][name] = t
    for c in sorted(n.constraints, key=lambda c: c.kind != "PrimaryKey"):
        add_constraint(session, m, space, name, c)
    return f'Table "{name}" created.'


def add_constraint(session, m, space, name, c: Node) -> None:
    s, t = m["spaces"][space], m["spaces"][space]["tables"][name]
    for x in c.columns:
        column(t, x)
    if len(set(c.columns)) < len(c.columns):
        raise SqlError("42701", "A column is named twice in a constraint")
    if c.name:
        taken(s, c.name)
    if c.kind == "PrimaryKey":
        if t["pk"]:
            raise SqlError("42P16", "A table has one primary key")
        if len(c.columns) > MAX_INDEX_COLUMNS:
            raise SqlError("54011", f"A key has at most {MAX_INDEX_COLUMNS} columns")
        t["pk"] = {"name": c.name or free_name(s, f"PK_{name}", False), "columns": list(c.columns)}
        for x in c.columns:
            column(t, x)["not_null"] = True
        dml.check_table(session, space, name, not_null=c.columns, pk=True)
        return
    if c.parent.space not in (None, space):
        raise SqlError("42P16", "A foreign key stays in its tablespace")
    parent = s["tables"].get(c.parent.name)
    if parent is None:
        raise SqlError("42P16" if c.parent.name in s["views"] else "42P01", f"{c.parent.name} is not a table to reference", c.parent.at)
    if parent["pk"] is None:
        raise SqlError("42P16", f"{c.parent.name} has no primary key")
    to = c.parent_columns or parent["pk"]["columns"]
    if sorted(to) != sorted(parent["pk"]["columns"]) or len(to) != len(c.columns):
        raise SqlError("42P16", "A foreign key references the columns of the primary key")
    for x, y in zip(c.columns, to, strict=True):
        if type_of(column(t, x)["type"]).family != type_of(column(parent, y)["type"]).family:
            raise SqlError("42804", f"Column {x} has another type than {y}")
    t["fks"].append({"name": c.name or free_name(s, f"FK_{name}", True), "columns": list(c.columns), "parent": c.parent.name, "parent_columns": list(to), "delete": c.delete, "update": c.update})
    dml.check_child(session, space, name, t["fks"][-1])


def do_altertable(session, m, n) -> str:
    space, name, t = find(session, m, n.name)
    s, a, k = m["spaces"][space], n.action, n.action.kind
    if k == "AddConstraint":
        add_constraint(session, m, space, name, a.constraint)
    elif k == "AddColumn":
        if any(c["name"] == a.column.name for c in t["columns"]):
            raise SqlError("42701", f"Column {a.column.name} exists")
        if len(t["columns"]) >= MAX_COLUMNS:
            raise SqlError("54011", f"A table has at most {MAX_COLUMNS} columns")
        c = make_column(session, a.column)
        old = list(t["columns"])
        t["columns"].append(c)
        if t["segments"]:
            if c["default"] is not None:
                if any(x.kind == "ForeignKey" for x in a.constraints):
                    raise unsupported("A default and a reference of a new column of a table with rows")
                value = dml.assigned(session.binder(), a.column.default, a.column.type)
                rows = session.db.store.read({**t, "columns": old}).selectExpr("*", f"{value} AS `{c['id']}`")
                t["segments"] = [session.db.store.write(rows)]
            if c["not_null"]:
                dml.check_table(session, space, name, not_null=[c["name"]])
        for x in a.constraints:
            add_constraint(session, m, space, name, x)
    elif k == "DropColumn":
        free_column(m, space, name, t, a.column)
        if len(t["columns"]) == 1:
            raise SqlError("42P16", "A table keeps one column at least")
        t["columns"] = [c for c in t["columns"] if c["name"] != a.column]
    elif k == "SetDefault":
        c = column(t, a.column)
        if a.default is not None:
            constant(session, a.default, type_of(c["type"]))
        c["default"] = a.text
    elif k == "SetNotNull":
        c = column(t, a.column)
        if not a.value and t["pk"] and a.column in t["pk"]["columns"]:
            raise SqlError("42P16", "A primary key's column is NOT NULL")
        c["not_null"] = a.value
        if a.value:
            dml.check_table(session, space, name, not_null=[a.column])
    elif k == "RenameColumn":
        c = free_column(m, space, name, t, a.column)
        if any(x["name"] == a.new for x in t["columns"]):
            raise SqlError("42701", f"Column {a.new} exists")
        c["name"] = a.new
    elif k == "RenameTable":
        if dependents(m, space, name):
            raise SqlError("55006", f"A view reads {name}")
        if a.new in s["tables"] or a.new in s["views"]:
            raise SqlError("42P07", f"{space}.{a.new} exists")
        for other in s["tables"].values():
            for f in other["fks"]:
                f["parent"] = a.new if f["parent"] == name else f["parent"]
        for i in s["indexes"].values():
            i["table"] = a.new if i["table"] == name else i["table"]
        for g in m["grants"]:
            if (g["space"], g["object"]) == (space, name):
                g["object"] = a.new
        s["tables"][a.new] = s["tables"].pop(name)
    elif k == "DropConstraint":
        if t["pk"] and t["pk"]["name"] == a.name:
            if referencing(m, space, name):
                raise SqlError("55006", "A foreign key references this primary key")
            t["pk"] = None
        elif any(f["name"] == a.name for f in t["fks"]):
            t["fks"] = [f for f in t["fks"] if f["name"] != a.name]
        else:
            raise SqlError("42704", f"Constraint {a.name} does not exist")
    return f'Table "{name}" altered.'


def free_column(m, space, name, t, c: str) -> dict:
    """A column that no key, index or view uses."""
    found = column(t, c)
    if t["pk"] and c in t["pk"]["columns"] or any(c in f["columns"] for f in t["fks"]) or any(i["table"] == name and c in [x for x, _ in i["columns"]] for i in m["spaces"][space]["indexes"].values()) or dependents(m, space, name):
        raise SqlError("55006", f"Column {c} is in use by a key, an index or a view")
    return found


def drop_table(m, space, name) -> None:
    s = m["spaces"][space]
    for other in s["tables"].values():
        other["fks"] = [f for f in other["fks"] if f["parent"] != name]
    s["indexes"] = {k: i for k, i in s["indexes"].items() if i["table"] != name}
    del s["tables"][name]
    forget(m, space, name)


def forget(m, space, name) -> None:
    m["grants"] = [g for g in m["grants"] if (g["space"], g["object"]) != (space, name)]


def do_droptable(session, m, n, kind="tables") -> str:
    try:
        space, name, _ = find(session, m, n.name, kind)
    except SqlError as e:
        if n.if_exists and e.sqlstate in ("42P01", "3D000"):
            return "Nothing dropped."
        raise
    views = dependents(m, space, name)
    fks = [t for t, _ in referencing(m, space, name) if t != name] if kind == "tables" else []
    if (views or fks) and not n.cascade:
        raise SqlError("55006", f"{name} is in use by a view or a foreign key")
    for s, v in views:
        del m["spaces"][s]["views"][v]
        forget(m, s, v)
    if kind == "tables":
        drop_table(m, space, name)
    else:
        del m["spaces"][space]["views"][name]
        forget(m, space, name)
    return f'{kind[:-1].title()} "{name}" dropped.'


def do_dropview(session, m, n) -> str:
    return do_droptable(session, m, n, "views")


def do_truncate(session, m, n) -> str:
    space, name, t = find(session, m, n.name)
    for child, f in referencing(m, space, name):
        if child != name and dml.has_references(session, space, child, f):
            raise SqlError("23503", f"Rows of {child} reference {name}")
    t["segments"] = []
    return f'Table "{name}" truncated.'


# views and indexes


def do_createview(session, m, n) -> str:
    space, name = session.key(n.name)
    s = space_of(m, space)
    old = s["views"].get(name)
    if name in s["tables"] or old and not n.replace:
        raise SqlError("42P07", f"{space}.{name} exists")
    keys = {session.access_key(x) for x in reads(n.query)} - {None}
    if (space, name) in keys or old and any(k in dependents(m, space, name) for k in keys):
        raise SqlError("42P17", "A view cannot read itself")
    saved, session.space = session.space, space
    try:
        keys = sorted({session.access_key(x) for x in reads(n.query)} - {None})
        columns = session.bind(n.query).columns
    finally:
        session.space = saved
    names = n.columns or [c for c, _ in columns]
    if len(names) != len(columns):
        raise SqlError("42804", "The column list does not have as many names as the query has columns")
    if len(set(names)) < len(names):
        raise SqlError("42701", "Two columns of the view have the same name")
    s["views"][name] = {"owner": old["owner"] if old else session.user, "text": n.text, "columns": names, "reads": [list(k) for k in keys]}
    return f'View "{name}" created.'


def do_createindex(session, m, n) -> str:
    space, name, t = find(session, m, n.table)
    s = m["spaces"][space]
    names = [c for c, _ in n.columns]
    for c in names:
        column(t, c)
    if len(names) > MAX_INDEX_COLUMNS or len(set(names)) < len(names):
        raise SqlError("54011" if len(names) > MAX_INDEX_COLUMNS else "42701", f"An index has up to {MAX_INDEX_COLUMNS} different columns")
    if n.name and n.name.space not in (None, space):
        raise SqlError("42P16", "An index is in its table's tablespace")
    own = n.name.name if n.name else free_name(s, f"IX_{name}", True)
    taken(s, own)
    s["indexes"][own] = {"table": name, "columns": [list(c) for c in n.columns]}
    return f'Index "{own}" created.'


def do_dropindex(session, m, n) -> str:
    space, name, i = find(session, m, n.name, "indexes")
    Access(m, session.user).need(space, i["table"], "ALTER")
    del m["spaces"][space]["indexes"][name]
    return f'Index "{name}" dropped.'


# tablespaces, users, privileges


def do_createtablespace(session, m, n) -> str:
    if n.name in m["spaces"]:
        raise SqlError("42P06", f"Tablespace {n.name} exists")
    m["spaces"][n.name] = new_space(n.name, n.file)
    return f'Tablespace "{n.name}" created.'


def do_droptablespace(session, m, n) -> str:
    s = space_of(m, n.name)
    if n.name == "SYSTEM":
        raise SqlError("42501", "SYSTEM cannot be dropped")
    if (s["tables"] or s["views"]) and not n.contents:
        raise SqlError("55006", f"Tablespace {n.name} is not empty")
    if any(r[0] == n.name for sp, o in m["spaces"].items() if sp != n.name for v in o["views"].values() for r in v["reads"]):
        raise SqlError("55006", "A view of another tablespace reads this one")
    del m["spaces"][n.name]
    m["grants"] = [g for g in m["grants"] if g["space"] != n.name]
    for u in m["users"].values():
        u["space"] = None if u["space"] == n.name else u["space"]
    if session.space == n.name:
        session.space = None
    return f'Tablespace "{n.name}" dropped.'


def do_createuser(session, m, n) -> str:
    if n.name in m["users"]:
        raise SqlError("42710", f"User {n.name} exists")
    if n.space:
        space_of(m, n.space)
    m["users"][n.name] = {"password": hashed(n.password), "space": n.space}
    return f'User "{n.name}" created.'


def user_of(m, name) -> dict:
    if name not in m["users"]:
        raise SqlError("42704", f"User {name} does not exist")
    return m["users"][name]


def do_alteruser(session, m, n) -> str:
    u = user_of(m, n.name)
    if n.password is not None:
        u["password"] = hashed(n.password)
    if n.space:
        space_of(m, n.space)
        u["space"] = n.space
    return f'User "{n.name}" altered.'


def do_dropuser(session, m, n) -> str:
    user_of(m, n.name)
    if n.name in ("SYSTEM", session.user):
        raise SqlError("42501", "This user cannot be dropped")
    owned = [(s, k, o) for s, sp in m["spaces"].items() for k in ("views", "tables") for o, x in sp[k].items() if x["owner"] == n.name]
    if owned and not n.cascade:
        raise SqlError("55006", f"User {n.name} owns objects")
    for s, k, o in owned:
        if o in m["spaces"][s][k]:
            for vs, v in dependents(m, s, o):
                m["spaces"][vs]["views"].pop(v, None)
            if k == "tables":
                drop_table(m, s, o)
            else:
                m["spaces"][s]["views"].pop(o, None)
    del m["users"][n.name]
    m["groups"].pop(n.name, None)
    m["grants"] = [g for g in m["grants"] if g["user"] != n.name]
    return f'User "{n.name}" dropped.'


def do_grant(session, m, n, give: bool = True) -> str:
    for u in n.users:
        user_of(m, u)
    if n.target.kind == "Space":
        space_of(m, n.target.name)
        space, obj, possible = n.target.name, None, PRIVILEGES
    else:
        space, obj = session.key(n.target.name)
        s, possible = space_of(m, space), OBJECT_PRIVILEGES
        if obj in dictionary.COLUMNS and obj not in s["tables"]:
            raise SqlError("42809", f"{obj} is a dictionary view")
        kinds = {"TABLE": ("tables",), "VIEW": ("views",), None: ("tables", "views")}[n.target.object_kind]
        if not any(obj in s[k] for k in kinds):
            raise SqlError("42P01", f"{space}.{obj} does not exist")
    wanted = possible if n.privileges == ["ALL"] else n.privileges
    if any(p not in possible for p in wanted):
        raise SqlError("0LP01", "CREATE is a privilege on tablespaces")
    rows = [{"user": u, "space": space, "object": obj, "privilege": p} for u in n.users for p in wanted]
    m["grants"] = [g for g in m["grants"] if g not in rows] + (rows if give else [])
    return "Granted." if give else "Revoked."


def do_revoke(session, m, n) -> str:
    return do_grant(session, m, n, give=False)


def do_grantgroup(session, m, n, give: bool = True) -> str:
    for u in n.users:
        user_of(m, u)
        got = [g for g in m["groups"].get(u, []) if g not in n.privileges]
        m["groups"][u] = got + (list(dict.fromkeys(n.privileges)) if give else [])
    if not any("DBA" in g for g in m["groups"].values()):
        raise SqlError("42501", "One DBA must remain")
    return "Granted." if give else "Revoked."


def do_revokegroup(session, m, n) -> str:
    return do_grantgroup(session, m, n, give=False)
