"""Dictionary views: what the manifest says, as rows. Who isn't a DBA sees what they hold a privilege on."""

from __future__ import annotations

from larkspur.dialect.types import INTEGER, varchar
from larkspur.sources.store import type_of

V = varchar(4000)
# The views' names and columns.
COLUMNS = {
    "SYS_TABLESPACES": [("TABLESPACE_NAME", V), ("DATAFILE", V), ("FORMAT_VERSION", INTEGER), ("CHARACTER_SET", V), ("STATUS", V)],
    "SYS_USERS": [("USER_NAME", V), ("DEFAULT_TABLESPACE", V)],
    "SYS_TABLES": [("TABLESPACE_NAME", V), ("TABLE_NAME", V), ("OWNER", V), ("COLUMN_COUNT", INTEGER)],
    "SYS_COLUMNS": [("TABLESPACE_NAME", V), ("TABLE_NAME", V), ("COLUMN_NAME", V), ("ORDINAL_POSITION", INTEGER), ("DATA_TYPE", V), ("IS_NULLABLE", V), ("COLUMN_DEFAULT", V)],
    "SYS_VIEWS": [("TABLESPACE_NAME", V), ("VIEW_NAME", V), ("OWNER", V), ("DEFINITION", V)],
    "SYS_INDEXES": [("TABLESPACE_NAME", V), ("INDEX_NAME", V), ("TABLE_NAME", V), ("IS_UNIQUE", V)],
    "SYS_INDEX_COLUMNS": [("TABLESPACE_NAME", V), ("INDEX_NAME", V), ("ORDINAL_POSITION", INTEGER), ("COLUMN_NAME", V), ("IS_DESCENDING", V)],
    "SYS_CONSTRAINTS": [("TABLESPACE_NAME", V), ("CONSTRAINT_NAME", V), ("TABLE_NAME", V), ("CONSTRAINT_TYPE", V), ("REFERENCED_TABLE", V), ("DELETE_RULE", V), ("UPDATE_RULE", V)],
    "SYS_CONSTRAINT_COLUMNS": [("TABLESPACE_NAME", V), ("CONSTRAINT_NAME", V), ("ORDINAL_POSITION", INTEGER), ("COLUMN_NAME", V), ("REFERENCED_COLUMN", V)],
    "SYS_PRIVILEGES": [("GRANTEE", V), ("TABLESPACE_NAME", V), ("OBJECT_NAME", V), ("PRIVILEGE", V)],
    "SYS_GROUP_GRANTS": [("GRANTEE", V), ("GROUP_NAME", V)],
    "SYS_SESSIONS": [("SESSION_ID", INTEGER), ("USER_NAME", V), ("TABLESPACE_NAME", V), ("AUTOCOMMIT", V), ("IN_TRANSACTION", V), ("CHANNEL", V), ("CLIENT_ADDRESS", V)],
}


def rows(view: str, manifest: dict, sees, user: str, dba: bool, view_columns, sessions) -> list[tuple]:
    """sees(space, object or None): whether the user may know of it; view_columns(space, view): [(name, type)]."""
    out: list[tuple] = []
    for space, s in sorted(manifest["spaces"].items()):
        tables = {n: t for n, t in sorted(s["tables"].items()) if sees(space, n)}
        views = {n: v for n, v in sorted(s["views"].items()) if sees(space, n)}
        if view == "SYS_TABLESPACES" and (dba or tables or views or sees(space, None)):
            out.append((space, s["file"], 1, "UTF8", "AVAILABLE"))
        elif view == "SYS_TABLES":
            out += [(space, n, t["owner"], len(t["columns"])) for n, t in tables.items()]
        elif view == "SYS_VIEWS":
            out += [(space, n, v["owner"], v["text"]) for n, v in views.items()]
        elif view == "SYS_COLUMNS":
            for n, t in tables.items():
                out += [(space, n, c["name"], i, str(type_of(c["type"])), "NO" if c["not_null"] else "YES", c["default"]) for i, c in enumerate(t["columns"], 1)]
            for n in views:
                out += [(space, n, c, i, str(kind), "UNKNOWN", None) for i, (c, kind) in enumerate(view_columns(space, n), 1)]
        elif view in ("SYS_INDEXES", "SYS_INDEX_COLUMNS"):
            unique = [(t["pk"]["name"], n, "YES", [(c, False) for c in t["pk"]["columns"]]) for n, t in tables.items() if t["pk"]]
            own = [(n, i["table"], "NO", i["columns"]) for n, i in s["indexes"].items() if i["table"] in tables]
            for name, table, is_unique, columns in sorted(unique + own):
                if view == "SYS_INDEXES":
                    out.append((space, name, table, is_unique))
                else:
                    out += [(space, name, i, c, "YES" if d else "NO") for i, (c, d) in enumerate(columns, 1)]
        elif view in ("SYS_CONSTRAINTS", "SYS_CONSTRAINT_COLUMNS"):
            for n, t in tables.items():
                if t["pk"]:
                    head = (space, t["pk"]["name"])
                    out += [(*head, n, "PRIMARY KEY", None, None, None)] if view == "SYS_CONSTRAINTS" else [(*head, i, c, None) for i, c in enumerate(t["pk"]["columns"], 1)]
                for f in t["fks"]:
                    head = (space, f["name"])
                    out += [(*head, n, "FOREIGN KEY", f["parent"], f["delete"], f["update"])] if view == "SYS_CONSTRAINTS" else [(*head, i, c, p) for i, (c, p) in enumerate(zip(f["columns"], f["parent_columns"], strict=True), 1)]
    if view == "SYS_USERS":
        out = [(n, u["space"]) for n, u in sorted(manifest["users"].items()) if dba or n == user]
    elif view == "SYS_PRIVILEGES":
        out = sorted((g["user"], g["space"], g["object"], g["privilege"]) for g in manifest["grants"] if dba or g["user"] == user)
    elif view == "SYS_GROUP_GRANTS":
        out = sorted((n, g) for n, gs in manifest["groups"].items() for g in gs if dba or n == user)
    elif view == "SYS_SESSIONS":
        out = [r for r in sorted(sessions) if dba or r[1] == user]
    return out
