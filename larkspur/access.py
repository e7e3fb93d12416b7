"""Users, groups and privileges, checked on a statement's tree before it runs."""

from __future__ import annotations

import hashlib
import os

from larkspur.dialect.parser import PRIVILEGES, Node
from larkspur.errors import SqlError

OBJECT_PRIVILEGES = tuple(p for p in PRIVILEGES if p != "CREATE")


def hashed(password: str, salt: str | None = None) -> str:
    salt = salt or os.urandom(16).hex()
    return f"{salt}:{hashlib.pbkdf2_hmac('sha256', password.encode(), bytes.fromhex(salt), 20_000).hex()}"


def verify(password: str, stored: str | None) -> bool:
    return stored is None or hashed(password, stored.split(":")[0]) == stored


class Access:
    def __init__(self, manifest: dict, user: str):
        self.m, self.user = manifest, user

    def in_group(self, group: str, user: str | None = None) -> bool:
        got = self.m["groups"].get(user or self.user, [])
        return group in got or group == "OFFICER" and "DBA" in got

    @property
    def dba(self) -> bool:
        return self.in_group("DBA")

    def granted(self, user: str, space: str, name: str | None, privilege: str) -> bool:
        if self.in_group("DBA", user) or self.in_group("OFFICER", user) and space != "SYSTEM":
            return True
        return any(g["user"] == user and g["space"] == space and g["object"] in (None, name) and g["privilege"] == privilege for g in self.m["grants"])

    def can(self, space: str, name: str | None, privilege: str, user: str | None = None, seen=()) -> bool:
        user = user or self.user
        if self.granted(user, space, name, privilege):
            return True
        s = self.m["spaces"].get(space, {"tables": {}, "views": {}})
        if (t := s["tables"].get(name)) is not None:
            return t["owner"] == user
        v = s["views"].get(name)
        if v is None or v["owner"] != user or (space, name) in seen:
            return False
        if privilege in ("ALTER", "DROP"):
            return True
        # a view's owner without a grant on it is judged by their rights on what it reads
        return all(self.can(a, b, privilege, user, (*seen, (space, name))) for a, b in map(tuple, v["reads"]))

    def sees(self, space: str, name: str | None) -> bool:
        return self.dba or any(self.can(space, name, p) for p in PRIVILEGES)

    def need(self, space: str, name: str | None, privilege: str) -> None:
        known = self.m["spaces"].get(space)
        if known is None or name is not None and privilege != "CREATE" and name not in known["tables"] and name not in known["views"]:
            return  # what does not exist is the next step's error
        if not self.can(space, name, privilege):
            raise SqlError("42501", f"No {privilege} privilege on {space}{'.' + name if name else ''}")

    def need_dba(self) -> None:
        if not self.dba:
            raise SqlError("42501", "Only a DBA may do this")

    def check(self, n: Node, resolve) -> None:
        """resolve(name node) -> (space, name), or None for DUAL, dictionary views and names without a tablespace."""
        k = n.kind
        for name in reads(n):
            if key := resolve(name):
                self.need(*key, "SELECT")
        target = {"Insert": "INSERT", "Update": "UPDATE", "Delete": "DELETE"}.get(k)
        if target and (key := resolve(n.table)):
            self.need(*key, target)
        elif k == "Query" and n.query.for_update:
            for name in reads(n):
                if key := resolve(name):
                    self.need(*key, "UPDATE")
        elif k in ("CreateTable", "CreateView") and (key := resolve(n.name)):
            there = self.m["spaces"].get(key[0], {"views": {}})["views"]
            self.need(key[0], key[1], "ALTER") if k == "CreateView" and n.replace and key[1] in there else self.need(key[0], None, "CREATE")
        elif k in ("AlterTable", "DropTable", "DropView", "Truncate") and (key := resolve(n.name)):
            self.need(*key, "ALTER" if k == "AlterTable" else "DROP")
        elif k == "CreateIndex" and (key := resolve(n.table)):
            self.need(*key, "ALTER")
        elif k in ("CreateTablespace", "DropTablespace", "CreateUser", "DropUser", "GrantGroup", "RevokeGroup"):
            self.need_dba()
        elif k == "AlterUser" and (n.name != self.user or n.space):
            self.need_dba()
        elif k in ("Grant", "Revoke") and not self.dba:
            key = resolve(n.target.name) if n.target.kind == "Object" else None
            s = self.m["spaces"].get(key[0]) if key else None
            if s is None or not self.owns(key, s):
                raise SqlError("42501", "Only a DBA or the owner may grant or revoke")

    def owns(self, key, s, seen=()) -> bool:
        if key[1] in s["tables"]:
            return s["tables"][key[1]]["owner"] == self.user
        v = s["views"].get(key[1])
        return v is not None and v["owner"] == self.user and all(self.owns(tuple(r), self.m["spaces"][r[0]]) for r in v["reads"])


def reads(n) -> list[Node]:
    """Names of all sources a tree reads, subqueries included; the target of DML is not among them."""
    if isinstance(n, (list, tuple)):
        return [x for v in n for x in reads(v)]
    if not isinstance(n, Node):
        return []
    if n.kind == "Table":
        return [n.name]
    skip = ("table", "name", "target")
    out = [x for k, v in n.__dict__.items() if k not in skip for x in reads(v)]
    if n.kind == "CreateTable":
        out += [c.parent for c in n.constraints if c.kind == "ForeignKey" and c.parent.name != n.name.name]
    elif n.kind == "AddConstraint" and n.constraint.kind == "ForeignKey":
        out.append(n.constraint.parent)
    return out
