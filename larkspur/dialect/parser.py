"""Statements to trees. A node is a kind and its attributes; one method reads one construct."""

from __future__ import annotations

import sys

from larkspur.dialect.lexer import RESERVED, Token, position, tokens
from larkspur.dialect.types import DT_FIELDS, YM_FIELDS, Type, resolve
from larkspur.errors import SqlError, unsupported

MAX_NESTING, MAX_DEPTH = 200, 1000
# Statements and objects that are told apart from syntax errors as features not supported.
NO_STATEMENTS = frozenset("WITH MERGE CALL EXECUTE PREPARE DEALLOCATE DECLARE EXPLAIN ANALYZE LOCK COMMENT RENAME BACKUP RESTORE EXPORT IMPORT SHOW DESCRIBE VALUES".split())
NO_OBJECTS = frozenset("SEQUENCE TRIGGER PROCEDURE FUNCTION SYNONYM MATERIALIZED ROLE SCHEMA TEMPORARY GLOBAL LOCAL TYPE PACKAGE DOMAIN UNIQUE DATABASE".split())
PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")
GROUPS = ("CONNECT", "OFFICER", "DBA")
BARE = {"CURRENT_DATE", "CURRENT_TIME", "CURRENT_TIMESTAMP", "LOCALTIME", "LOCALTIMESTAMP", "CURRENT_USER"}
COMPARISONS = ("=", "<>", "<", "<=", ">", ">=")


class Node:
    __slots__ = ("kind", "__dict__")

    def __init__(self, kind: str, **attrs):
        self.kind = kind
        self.__dict__.update(attrs)

    def __eq__(self, other):
        """Same construct, wherever it stands."""
        clean = lambda d: {k: v for k, v in d.items() if k not in ("at", "depth")}
        return isinstance(other, Node) and self.kind == other.kind and clean(self.__dict__) == clean(other.__dict__)

    __hash__ = None

    def __repr__(self):
        return f"{self.kind}({', '.join(f'{k}={v!r}' for k, v in self.__dict__.items() if k not in ('at', 'depth'))})"


class Parser:
    def __init__(self, sql: str):
        self.sql, self.tokens, self.i, self.params, self.nesting = sql, tokens(sql), 0, 0, 0

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def ahead(self, n: int = 1) -> Token:
        return self.tokens[min(self.i + n, len(self.tokens) - 1)]

    def where(self, t: Token | None = None):
        return position(self.sql, (t or self.now).offset)

    def is_(self, *words: str) -> bool:
        return all((t := self.ahead(k)).kind in ("word", "symbol") and t.text == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.is_(*words):
            self.i += len(words)
            return True
        return False

    def any_of(self, *words: str) -> str | None:
        if self.now.kind in ("word", "symbol") and self.now.text in words:
            self.i += 1
            return self.tokens[self.i - 1].text
        return None

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                raise self.unexpected(w)

    def unexpected(self, wanted: str) -> SqlError:
        return SqlError("42601", f'Unexpected "{self.now.text}"; expected {wanted}', self.where())

    def no(self, what: str) -> SqlError:
        return unsupported(what, self.where())

    def named(self, t: Token) -> bool:
        return t.kind == "quoted" or t.kind == "word" and t.text not in RESERVED

    def name(self, what: str = "a name") -> str:
        if not self.named(self.now):
            raise self.unexpected(what)
        self.i += 1
        return self.tokens[self.i - 1].text

    def names(self, what: str = "a column name") -> list[str]:
        self.need("(")
        out = self.listed(lambda: self.name(what))
        self.need(")")
        return out

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    def object_name(self, what: str) -> Node:
        at = self.where()
        first = self.name(what)
        return Node("Name", space=first, name=self.name(what), at=at) if self.take(".") else Node("Name", space=None, name=first, at=at)

    def literal(self, what: str) -> str:
        if self.now.kind != "string":
            raise self.unexpected(what)
        self.i += 1
        return self.tokens[self.i - 1].text

    def integer(self, what: str = "an integer") -> int:
        if self.now.kind != "number" or not self.now.text.isdigit():
            raise self.unexpected(what)
        self.i += 1
        return int(self.tokens[self.i - 1].text)

    def deeper(self, read):
        self.nesting += 1
        if self.nesting > MAX_NESTING:
            raise SqlError("54001", f"Nested more than {MAX_NESTING} levels deep", self.where())
        try:
            return read()
        finally:
            self.nesting -= 1

    def node(self, kind: str, at=None, **attrs) -> Node:
        depth = 1 + max((c.depth for v in attrs.values() for c in (v if isinstance(v, list) else [v]) if isinstance(c, Node) and hasattr(c, "depth")), default=0)
        if depth > MAX_DEPTH:
            raise SqlError("54001", f"Chained more than {MAX_DEPTH} operations deep", self.where())
        return Node(kind, at=at, depth=depth, **attrs)

    # statements

    def statement(self) -> Node:
        out = self.one_statement()
        self.take(";")
        if self.now.kind != "end":
            raise self.unexpected("end of statement")
        out.params = self.params
        return out

    def one_statement(self) -> Node:
        t = self.now
        if t.kind == "word":
            if t.text in NO_STATEMENTS:
                raise self.no(t.text)
            read = getattr(self, f"st_{t.text.lower()}", None)
            if read:
                self.i += 1
                return read()
        if self.is_("SELECT") or self.is_("("):
            return Node("Query", query=self.query(top=True))
        raise self.unexpected("a statement")

    def st_insert(self) -> Node:
        if self.is_("ALL"):
            raise self.no("INSERT ALL")
        self.take("INTO")
        table, columns, rows, query = self.object_name("a table name"), None, None, None
        if self.is_("(") and not (self.is_("(", "SELECT") or self.is_("(", "(")):
            columns = self.names()
        if columns is None and self.take("DEFAULT", "VALUES"):
            rows = [None]
        elif self.take("VALUES"):
            rows = self.listed(lambda: self.row())
        elif self.is_("SELECT") or self.is_("("):
            query = self.query()
        else:
            raise self.unexpected("VALUES or SELECT")
        self.no_tail("RETURNING", "ON")
        return Node("Insert", table=table, columns=columns, rows=rows, query=query)

    def no_tail(self, *words: str) -> None:
        for w in words:
            if self.is_(w):
                raise self.no(f"{w} here")

    def row(self) -> list[Node]:
        self.need("(")
        out = self.listed(self.value)
        self.need(")")
        return out

    def value(self) -> Node:
        if self.is_("DEFAULT"):
            at = self.where()
            self.i += 1
            return Node("Default", at=at)
        return self.expr()

    def st_update(self) -> Node:
        table, alias = self.object_name("a table name"), self.alias()
        self.need("SET")

        def one():
            if self.is_("("):
                raise self.no("Assignment to several columns")
            column = self.name("a column name")
            self.need("=")
            return column, self.value()

        sets = self.listed(one)
        self.no_tail("FROM")
        where = self.expr() if self.take("WHERE") else None
        self.no_tail("RETURNING")
        return Node("Update", table=table, alias=alias, sets=sets, where=where)

    def st_delete(self) -> Node:
        self.take("FROM")
        table, alias = self.object_name("a table name"), self.alias()
        self.no_tail("USING")
        where = self.expr() if self.take("WHERE") else None
        self.no_tail("RETURNING")
        return Node("Delete", table=table, alias=alias, where=where)

    def st_truncate(self) -> Node:
        self.take("TABLE")
        return Node("Truncate", name=self.object_name("a table name"))

    def st_create(self) -> Node:
        replace = self.take("OR", "REPLACE")
        if self.take("VIEW"):
            name = self.object_name("a view name")
            columns = self.names() if self.is_("(") else None
            self.need("AS")
            start, before = self.now.offset, self.params
            query = self.query()
            self.no_tail("WITH")
            if self.params > before:
                raise self.no("Parameters in a view")
            return Node("CreateView", name=name, columns=columns, query=query, text=self.sql[start : self.tokens[self.i - 1].end], replace=replace)
        if replace:
            raise self.unexpected("VIEW")
        if self.take("TABLE"):
            return self.create_table()
        if self.take("INDEX"):
            name = None if self.is_("ON") else self.object_name("an index name")
            self.need("ON")
            table = self.object_name("a table name")
            self.need("(")

            def column():
                c = self.name("a column name")
                if self.is_("("):
                    raise self.no("Function-based index")
                desc = self.any_of("ASC", "DESC") == "DESC"
                if self.is_("NULLS"):
                    raise self.no("NULLS FIRST / LAST in an index")
                return c, desc

            columns = self.listed(column)
            self.need(")")
            self.no_tail("WHERE", "USING")
            return Node("CreateIndex", name=name, table=table, columns=columns)
        if self.take("TABLESPACE"):
            out = Node("CreateTablespace", name=self.name("a tablespace name"), file=None)
            while True:
                if self.take("DATAFILE"):
                    out.file = self.literal("a data file path")
                elif self.take("CHARACTER", "SET"):
                    charset = (self.literal("a character set") if self.now.kind == "string" else self.name("a character set")).upper()
                    if charset not in ("UTF8", "UTF-8"):
                        raise self.no(f"Character set {charset}")
                else:
                    return out
        if self.take("USER"):
            name = self.name("a user name")
            self.need("IDENTIFIED", "BY")
            password = self.literal("a password string")
            return Node("CreateUser", name=name, password=password, space=self.name("a tablespace name") if self.take("DEFAULT", "TABLESPACE") else None)
        if self.now.kind == "word" and self.now.text in NO_OBJECTS:
            raise self.no(f"CREATE {self.now.text}")
        raise self.unexpected("TABLE, VIEW, INDEX, TABLESPACE or USER")

    def create_table(self) -> Node:
        if_not_exists = self.take("IF", "NOT", "EXISTS")
        name = self.object_name("a table name")
        if self.is_("AS"):
            raise self.no("CREATE TABLE AS SELECT")
        self.need("(")
        columns, constraints = [], []

        def element():
            if self.constraint_ahead():
                constraints.append(self.constraint())
            else:
                column, own = self.column_def()
                columns.append(column)
                constraints.extend(own)

        self.listed(element)
        self.need(")")
        self.no_tail("AS", "PARTITION")
        return Node("CreateTable", name=name, columns=columns, constraints=constraints, if_not_exists=if_not_exists)

    def constraint_ahead(self) -> bool:
        return self.is_("CONSTRAINT") or self.is_("PRIMARY", "KEY") or self.is_("FOREIGN", "KEY") or self.is_("UNIQUE") or self.is_("CHECK")

    def constraint(self) -> Node:
        name = self.name("a constraint name") if self.take("CONSTRAINT") else None
        if self.take("PRIMARY", "KEY"):
            return Node("PrimaryKey", name=name, columns=self.names())
        if self.take("FOREIGN", "KEY"):
            columns = self.names()
            return self.references(name, columns)
        if self.is_("UNIQUE") or self.is_("CHECK"):
            raise self.no(f"{self.now.text} constraint")
        raise self.unexpected("PRIMARY KEY or FOREIGN KEY")

    def references(self, name, columns) -> Node:
        self.need("REFERENCES")
        out = Node("ForeignKey", name=name, columns=columns, parent=self.object_name("a table name"), parent_columns=self.names() if self.is_("(") else None, delete="NO ACTION", update="NO ACTION")
        self.no_tail("MATCH")
        while self.take("ON"):
            event = self.any_of("DELETE", "UPDATE")
            if event is None:
                raise self.unexpected("DELETE or UPDATE")
            if self.take("SET", "NULL"):
                action = "SET NULL"
            elif self.is_("SET", "DEFAULT"):
                raise self.no("SET DEFAULT")
            elif self.take("NO", "ACTION"):
                action = "NO ACTION"
            elif (action := self.any_of("CASCADE", "RESTRICT")) is None:
                raise self.unexpected("NO ACTION, RESTRICT, CASCADE or SET NULL")
            setattr(out, event.lower(), action)
        self.no_tail("DEFERRABLE", "INITIALLY")
        return out

    def column_def(self) -> tuple[Node, list[Node]]:
        column = Node("Column", name=self.name("a column name"), type=self.type(), default=None, not_null=False, at=self.where())
        own = []
        while True:
            label = self.name("a constraint name") if self.take("CONSTRAINT") else None
            if self.take("DEFAULT"):
                start = self.now.offset
                column.default = self.additive()
                column.default_text = self.sql[start : self.tokens[self.i - 1].end]
            elif self.take("NOT", "NULL"):
                column.not_null = True
            elif self.take("NULL"):
                pass
            elif self.take("PRIMARY", "KEY"):
                own.append(Node("PrimaryKey", name=label, columns=[column.name]))
            elif self.is_("REFERENCES"):
                own.append(self.references(label, [column.name]))
            elif self.now.kind == "word" and self.now.text in ("UNIQUE", "CHECK", "COLLATE", "GENERATED", "AUTO_INCREMENT", "IDENTITY"):
                raise self.no(f"{self.now.text} of a column")
            elif label is not None:
                raise self.unexpected("a constraint")
            else:
                return column, own

    def st_alter(self) -> Node:
        if self.take("USER"):
            out = Node("AlterUser", name=self.name("a user name"), password=None, space=None)
            while True:
                if self.take("IDENTIFIED", "BY"):
                    out.password = self.literal("a password string")
                elif self.take("DEFAULT", "TABLESPACE"):
                    out.space = self.name("a tablespace name")
                elif out.password is None and out.space is None:
                    raise self.unexpected("IDENTIFIED BY or DEFAULT TABLESPACE")
                else:
                    return out
        if not self.take("TABLE"):
            if self.now.text in NO_OBJECTS or self.now.text in ("TABLESPACE", "INDEX", "VIEW"):
                raise self.no(f"ALTER {self.now.text}")
            raise self.unexpected("TABLE or USER")
        return Node("AlterTable", name=self.object_name("a table name"), action=self.alter_action())

    def column_word(self) -> None:
        if self.is_("COLUMN") and self.named(self.ahead()):
            self.i += 1

    def alter_action(self) -> Node:
        if self.take("ADD"):
            if self.constraint_ahead():
                return Node("AddConstraint", constraint=self.constraint())
            self.column_word()
            column, own = self.column_def()
            return Node("AddColumn", column=column, constraints=own)
        if self.take("DROP"):
            if self.take("CONSTRAINT"):
                return Node("DropConstraint", name=self.name("a constraint name"))
            if self.is_("PRIMARY"):
                raise self.no("DROP PRIMARY KEY")
            self.column_word()
            column = self.name("a column name")
            self.no_tail("CASCADE")
            self.take("RESTRICT")
            return Node("DropColumn", column=column)
        if self.take("ALTER"):
            self.column_word()
            column = self.name("a column name")
            if self.take("SET", "DEFAULT"):
                start = self.now.offset
                return Node("SetDefault", column=column, default=self.additive(), text=self.sql[start : self.tokens[self.i - 1].end])
            if self.take("DROP", "DEFAULT"):
                return Node("SetDefault", column=column, default=None, text=None)
            if self.take("SET", "NOT", "NULL"):
                return Node("SetNotNull", column=column, value=True)
            if self.take("DROP", "NOT", "NULL"):
                return Node("SetNotNull", column=column, value=False)
            if self.is_("TYPE") or self.is_("SET", "DATA"):
                raise self.no("Changing a column's type")
            raise self.unexpected("SET or DROP")
        if self.take("RENAME"):
            if self.take("TO"):
                return Node("RenameTable", new=self.name("a table name"))
            self.column_word()
            column = self.name("a column name")
            self.need("TO")
            return Node("RenameColumn", column=column, new=self.name("a column name"))
        if self.is_("MODIFY"):
            raise self.no("MODIFY")
        raise self.unexpected("ADD, DROP, ALTER or RENAME")

    def st_drop(self) -> Node:
        what = self.any_of("TABLE", "VIEW", "INDEX", "TABLESPACE", "USER")
        if what in ("TABLE", "VIEW"):
            if_exists = self.take("IF", "EXISTS")
            name = self.object_name(f"a {what.lower()} name")
            return Node(f"Drop{what.title()}", name=name, if_exists=if_exists, cascade=self.any_of("RESTRICT", "CASCADE") == "CASCADE")
        if what == "INDEX":
            return Node("DropIndex", name=self.object_name("an index name"))
        if what == "TABLESPACE":
            out = Node("DropTablespace", name=self.name("a tablespace name"), contents=self.take("INCLUDING", "CONTENTS"))
            if out.contents and self.take("AND"):
                self.need("DATAFILES")
            return out
        if what == "USER":
            return Node("DropUser", name=self.name("a user name"), cascade=self.take("CASCADE"))
        if self.now.text in NO_OBJECTS:
            raise self.no(f"DROP {self.now.text}")
        raise self.unexpected("TABLE, VIEW, INDEX, TABLESPACE or USER")

    def st_grant(self) -> Node:
        return self.privilege("Grant", "TO")

    def st_revoke(self) -> Node:
        if self.is_("GRANT", "OPTION"):
            raise self.no("GRANT OPTION FOR")
        return self.privilege("Revoke", "FROM")

    def privilege(self, kind: str, link: str) -> Node:
        if self.take("ALL"):
            self.take("PRIVILEGES")
            wanted = ["ALL"]
        else:
            def one():
                t = self.now
                if t.kind == "word" and (t.text in PRIVILEGES or t.text in GROUPS):
                    self.i += 1
                    if self.is_("("):
                        raise self.no("Column privilege")
                    return t.text
                if t.kind == "word" and (t.text not in RESERVED or t.text == "REFERENCES"):
                    raise self.no(f"Privilege or group {t.text}")
                raise self.unexpected("a privilege or a group")

            wanted = self.listed(one)
        target, groups = None, wanted[0] in GROUPS
        if len({w in GROUPS for w in wanted}) > 1:
            raise SqlError("42601", "Privileges and groups cannot be mixed", self.where())
        if not groups:
            self.need("ON")
            if self.is_("TABLESPACE") and self.named(self.ahead()):
                self.i += 1
                target = Node("Space", name=self.name())
            else:
                object_kind = "TABLE" if self.take("TABLE") else None
                if object_kind is None and self.is_("VIEW") and self.named(self.ahead()):
                    self.i += 1
                    object_kind = "VIEW"
                target = Node("Object", object_kind=object_kind, name=self.object_name("an object name"))
        self.need(link)
        self.no_tail("PUBLIC")
        users = self.listed(lambda: self.name("a user name"))
        self.no_tail("WITH", "CASCADE", "RESTRICT")
        return Node(kind + ("Group" if groups else ""), privileges=wanted, target=target, users=users)

    def modes(self) -> None:
        if self.take("ISOLATION", "LEVEL"):
            if not self.take("READ", "COMMITTED"):
                raise self.no("Isolation level other than READ COMMITTED")
        self.no_tail("READ")

    def st_begin(self) -> Node:
        self.any_of("WORK", "TRANSACTION")
        self.modes()
        return Node("Begin")

    def st_start(self) -> Node:
        self.need("TRANSACTION")
        self.modes()
        return Node("Begin")

    def st_commit(self) -> Node:
        self.take("WORK")
        self.no_tail("AND")
        return Node("Commit")

    def st_rollback(self) -> Node:
        self.take("WORK")
        self.no_tail("AND")
        if not self.take("TO"):
            return Node("Rollback", savepoint=None)
        self.savepoint_word()
        return Node("Rollback", savepoint=self.name("a savepoint name"))

    def savepoint_word(self) -> None:
        if self.is_("SAVEPOINT") and self.named(self.ahead()):
            self.i += 1

    def st_savepoint(self) -> Node:
        return Node("Savepoint", name=self.name("a savepoint name"))

    def st_release(self) -> Node:
        self.savepoint_word()
        return Node("Release", name=self.name("a savepoint name"))

    def st_use(self) -> Node:
        return Node("Use", name=self.name("a tablespace name"))

    def st_set(self) -> Node:
        if self.take("AUTOCOMMIT"):
            self.any_of("=", "TO")
            t = self.now
            if t.text in ("ON", "TRUE", "1", "OFF", "FALSE", "0"):
                self.i += 1
                return Node("SetAutocommit", value=t.text in ("ON", "TRUE", "1"))
            raise self.unexpected("ON or OFF")
        if self.take("TIME", "ZONE"):
            if self.now.kind == "string":
                return Node("SetTimeZone", zone=self.literal("a zone"))
            if self.take("LOCAL"):
                return Node("SetTimeZone", zone="LOCAL")
            if self.is_("INTERVAL"):
                lit = self.primary()
                text = lit.text.strip()
                return Node("SetTimeZone", zone=text if text[:1] in "+-" else f"+{text}")
            raise self.unexpected("a time zone string, LOCAL or INTERVAL")
        if self.take("TRANSACTION"):
            if not self.is_("ISOLATION"):
                raise self.unexpected("ISOLATION LEVEL")
            self.modes()
            return Node("SetTransaction")
        if self.now.kind == "word" and self.now.text in ("SESSION", "ROLE", "SCHEMA", "CONSTRAINTS"):
            raise self.no(f"SET {self.now.text}")
        raise self.unexpected("AUTOCOMMIT, TIME ZONE or TRANSACTION")

    # queries

    def query(self, top: bool = False) -> Node:
        body = self.set_operation(0)
        out = self.node("Select_", body=body, order=[], limit=None, offset=None, for_update=False)
        if self.take("ORDER", "BY"):
            out.order = self.listed(self.order_item)
        while True:
            if out.limit is None and self.take("LIMIT"):
                out.limit = self.additive()
                if self.is_(","):
                    raise self.no("LIMIT a, b")
            elif out.offset is None and self.take("OFFSET"):
                out.offset = self.additive()
                self.any_of("ROW", "ROWS")
            elif out.limit is None and self.take("FETCH"):
                if self.any_of("FIRST", "NEXT") is None:
                    raise self.unexpected("FIRST or NEXT")
                out.limit = self.node("Number", text="1") if self.is_("ROW") or self.is_("ROWS") else self.additive()
                if self.is_("PERCENT"):
                    raise self.no("FETCH PERCENT")
                if self.any_of("ROW", "ROWS") is None:
                    raise self.unexpected("ROW or ROWS")
                if self.is_("WITH", "TIES"):
                    raise self.no("WITH TIES")
                self.need("ONLY")
            else:
                break
        if self.is_("FOR"):
            self.i += 1
            if not self.take("UPDATE"):
                raise self.no("FOR other than FOR UPDATE")
            self.no_tail("OF", "NOWAIT", "SKIP")
            out.for_update = True
        return out

    def set_operation(self, level: int) -> Node:
        """INTERSECT (level 1) binds tighter than UNION and EXCEPT (level 0)."""
        left = self.set_operation(1) if level == 0 else self.query_term()
        while op := self.any_of(*(("INTERSECT",) if level else ("UNION", "EXCEPT"))):
            everything = False
            if self.take("ALL"):
                if op != "UNION":
                    raise self.no(f"{op} ALL")
                everything = True
            else:
                self.take("DISTINCT")
            right = self.set_operation(1) if level == 0 else self.query_term()
            left = self.node("SetOp", op=op, all=everything, left=left, right=right)
        return left

    def query_term(self) -> Node:
        if self.take("("):
            inner = self.deeper(self.query)
            self.need(")")
            return inner if inner.order or inner.limit or inner.offset else inner.body
        if not self.take("SELECT"):
            if self.is_("VALUES"):
                raise self.no("VALUES as a query")
            raise self.unexpected("SELECT")
        distinct = self.any_of("DISTINCT", "ALL") == "DISTINCT"
        items = self.listed(self.select_item)
        if self.is_("INTO"):
            raise self.no("SELECT INTO")
        sources = self.listed(self.join) if self.take("FROM") else []
        where = self.expr() if self.take("WHERE") else None
        groups = None
        if self.take("GROUP", "BY"):
            if self.now.text in ("ROLLUP", "CUBE", "GROUPING") and self.ahead().text in ("(", "SETS"):
                raise self.no(self.now.text)
            groups = self.listed(self.expr)
        having = self.expr() if self.take("HAVING") else None
        self.no_tail("WINDOW", "QUALIFY")
        return self.node("Select", distinct=distinct, items=items, sources=sources, where=where, groups=groups, having=having)

    def select_item(self) -> Node:
        at = self.where()
        if self.take("*"):
            return Node("Star", qualifier=[], at=at)
        for n in (1, 2):
            part = [self.ahead(k) for k in range(2 * n + 1)]
            if all(self.named(part[2 * k]) and part[2 * k + 1].text == "." for k in range(n)) and part[2 * n].kind == "symbol" and part[2 * n].text == "*":
                self.i += 2 * n + 1
                return Node("Star", qualifier=[part[2 * k].text for k in range(n)], at=at)
        expr = self.expr()
        return self.node("Item", expr=expr, alias=self.alias())

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name("an alias")
        return self.name() if self.named(self.now) else None

    def order_item(self) -> Node:
        expr = self.expr()
        desc = self.any_of("ASC", "DESC") == "DESC"
        first = None
        if self.take("NULLS"):
            got = self.any_of("FIRST", "LAST")
            if got is None:
                raise self.unexpected("FIRST or LAST")
            first = got == "FIRST"
        return self.node("Order", expr=expr, desc=desc, nulls_first=first)

    def join(self) -> Node:
        left = self.source()
        while True:
            if self.is_("NATURAL"):
                raise self.no("NATURAL JOIN")
            if self.take("CROSS"):
                self.need("JOIN")
                left = self.node("Join", how="CROSS", left=left, right=self.source(), on=None, using=None)
                if self.is_("ON") or self.is_("USING"):
                    raise self.unexpected("no condition after CROSS JOIN")
                continue
            if self.is_("JOIN") or self.is_("INNER"):
                self.take("INNER")
                how = "INNER"
            elif self.now.kind == "word" and self.now.text in ("LEFT", "RIGHT", "FULL"):
                how = self.any_of("LEFT", "RIGHT", "FULL")
                self.take("OUTER")
            else:
                return left
            self.need("JOIN")
            right = self.source()
            if self.take("ON"):
                left = self.node("Join", how=how, left=left, right=right, on=self.expr(), using=None)
            elif self.take("USING"):
                left = self.node("Join", how=how, left=left, right=right, on=None, using=self.names())
            else:
                raise self.unexpected("ON or USING")

    def source(self) -> Node:
        if self.is_("LATERAL"):
            raise self.no("LATERAL")
        at = self.where()
        if self.take("("):
            if self.is_("SELECT") or self.is_("("):
                mark = self.i, self.params
                try:
                    query = self.deeper(self.query)
                    self.need(")")
                    alias = self.alias()
                    return self.node("Derived", query=query, alias=alias, columns=self.names() if alias and self.is_("(") else None, at=at)
                except SqlError as e:
                    # doubled parentheses may also hold a join of derived tables
                    if e.sqlstate != "42601" or not self.tokens[mark[0]].text == "(":
                        raise
                    self.i, self.params = mark
            inner = self.deeper(self.join)
            self.need(")")
            return inner
        name = self.object_name("a table name")
        alias = self.alias()
        if alias and self.is_("("):
            raise self.unexpected("no column list after a table's alias")
        return self.node("Table", name=name, alias=alias, at=at)

    # expressions, from loose to tight

    def expr(self) -> Node:
        return self.deeper(self.disjunction)

    def disjunction(self) -> Node:
        parts = [self.conjunction()]
        while self.take("OR"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else self.node("Or", parts=parts)

    def conjunction(self) -> Node:
        parts = [self.negation()]
        while self.take("AND"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else self.node("And", parts=parts)

    def negation(self) -> Node:
        if self.take("NOT"):
            return self.node("Not", arg=self.deeper(self.negation))
        return self.predicate()

    def predicate(self) -> Node:
        left = self.additive()
        while True:
            at = self.where()
            if op := self.any_of(*COMPARISONS):
                if many := self.any_of("ANY", "SOME", "ALL"):
                    self.need("(")
                    query = self.deeper(self.query)
                    self.need(")")
                    left = self.node("Quantified", op=op, every=many == "ALL", left=left, query=query, at=at)
                else:
                    left = self.node("Compare", op=op, left=left, right=self.additive(), at=at)
                continue
            if self.take("IS"):
                negated = self.take("NOT")
                if self.is_("DISTINCT"):
                    raise self.no("IS DISTINCT FROM")
                if (what := self.any_of("NULL", "TRUE", "FALSE", "UNKNOWN")) is None:
                    raise self.unexpected("NULL, TRUE, FALSE or UNKNOWN")
                left = self.node("Is", arg=left, what=what, negated=negated, at=at)
                continue
            negated = self.is_("NOT") and self.ahead().text in ("BETWEEN", "IN", "LIKE") and self.take("NOT")
            if self.take("BETWEEN"):
                if self.is_("SYMMETRIC"):
                    raise self.no("BETWEEN SYMMETRIC")
                low = self.additive()
                self.need("AND")
                left = self.node("Between", arg=left, low=low, high=self.additive(), negated=negated, at=at)
            elif self.take("IN"):
                self.need("(")
                if self.is_("SELECT"):
                    query = self.deeper(self.query)
                    left = self.node("InQuery", left=left, query=query, negated=negated, at=at)
                else:
                    left = self.node("In", arg=left, items=self.listed(self.expr), negated=negated, at=at)
                self.need(")")
            elif self.take("LIKE"):
                pattern = self.additive()
                left = self.node("Like", arg=left, pattern=pattern, escape=self.additive() if self.take("ESCAPE") else None, negated=negated, at=at)
            else:
                return left

    def additive(self) -> Node:
        left = self.multiplicative()
        while (at := self.where()) and (op := self.any_of("+", "-", "||")):
            left = self.node("Binary", op=op, left=left, right=self.multiplicative(), at=at)
        return left

    def multiplicative(self) -> Node:
        left = self.unary()
        while (at := self.where()) and (op := self.any_of("*", "/")):
            left = self.node("Binary", op=op, left=left, right=self.unary(), at=at)
        return left

    def unary(self) -> Node:
        at = self.where()
        if op := self.any_of("+", "-"):
            arg = self.deeper(self.unary)
            if arg.kind == "Number":
                return self.node("Number", text=arg.text if op == "+" else arg.text[1:] if arg.text[0] == "-" else f"-{arg.text}", at=at)
            return self.node("Sign", op=op, arg=arg, at=at)
        return self.primary()

    def primary(self) -> Node:
        t, at = self.now, self.where()
        if t.kind == "number":
            self.i += 1
            return self.node("Number", text=t.text, at=at)
        if t.kind in ("string", "hex"):
            self.i += 1
            return self.node("String" if t.kind == "string" else "Hex", text=t.text, at=at)
        if self.take("?"):
            self.params += 1
            return self.node("Param", index=self.params, at=at)
        if self.take("("):
            return self.parenthesised(at)
        if t.kind == "word":
            if t.text in ("NULL", "TRUE", "FALSE"):
                self.i += 1
                return self.node("Constant", value=t.text, at=at)
            read = {"CASE": self.case, "CAST": self.cast, "EXISTS": self.exists}.get(t.text)
            if read and (t.text == "CASE" or self.ahead().text == "("):
                self.i += 1
                return self.deeper(lambda: read(at))
            if lit := self.temporal(at):
                return lit
            if t.text in BARE:
                self.i += 1
                precision = None
                if self.take("("):
                    precision = None if self.is_(")") else self.integer()
                    self.need(")")
                return self.node("Call", name=t.text, args=[], precision=precision, distinct=False, star=False, at=at)
            if self.ahead().kind == "symbol" and self.ahead().text == "(" and (t.text not in RESERVED or t.text in ("LEFT", "RIGHT")):
                return self.deeper(lambda: self.call(at))
        parts = [self.name("an expression")]
        while len(parts) < 3 and self.is_(".") and self.named(self.ahead()):
            self.i += 1
            parts.append(self.name())
        return self.node("Column", parts=parts, at=at)

    def parenthesised(self, at) -> Node:
        if self.is_("SELECT"):
            query = self.deeper(self.query)
            self.need(")")
            return self.node("Scalar", query=query, at=at)
        mark = self.i, self.params
        inner = self.expr()
        if inner.kind == "Scalar" and self.now.text in ("UNION", "EXCEPT", "INTERSECT", "ORDER", "LIMIT", "OFFSET", "FETCH"):
            self.i, self.params = mark
            query = self.deeper(self.query)
            self.need(")")
            return self.node("Scalar", query=query, at=at)
        if self.is_(","):
            raise self.no("Row value")
        self.need(")")
        return inner

    def exists(self, at) -> Node:
        self.need("(")
        query = self.deeper(self.query)
        self.need(")")
        return self.node("Exists", query=query, at=at)

    def case(self, at) -> Node:
        subject = None if self.is_("WHEN") else self.expr()
        whens, values = [], []
        while self.take("WHEN"):
            whens.append(self.expr())
            self.need("THEN")
            values.append(self.expr())
        if not whens:
            raise self.unexpected("WHEN")
        otherwise = self.expr() if self.take("ELSE") else None
        self.need("END")
        return self.node("Case", subject=subject, whens=whens, values=values, otherwise=otherwise, at=at)

    def cast(self, at) -> Node:
        self.need("(")
        arg = self.expr()
        self.need("AS")
        to = self.type()
        self.need(")")
        return self.node("Cast", arg=arg, to=to, at=at)

    def temporal(self, at) -> Node | None:
        """DATE, TIME, TIMESTAMP and INTERVAL are literals only before a string."""
        word = self.now.text
        if word == "INTERVAL":
            sign = self.ahead().text if self.ahead().kind == "symbol" and self.ahead().text in "+-" else ""
            if self.ahead(1 + bool(sign)).kind != "string":
                return None
            self.i += 1 + bool(sign)
            text = self.literal("an interval")
            return self.node("Interval", text=f"-{text}" if sign == "-" and not text.strip().startswith("-") else text.replace("-", "", 1) if sign == "-" else text, qualifier=self.qualifier(), at=at)
        if word not in ("DATE", "TIME", "TIMESTAMP"):
            return None
        n, zone = 1, None
        if word != "DATE" and self.ahead().text in ("WITH", "WITHOUT") and self.ahead(2).text == "TIME" and self.ahead(3).text == "ZONE":
            n, zone = 4, self.ahead().text == "WITH"
        if self.ahead(n).kind != "string":
            return None
        self.i += n
        return self.node("Temporal", what=word, zone=zone, text=self.literal("a literal"), at=at)

    def qualifier(self) -> Type:
        fields = (*YM_FIELDS, *DT_FIELDS)
        start = self.any_of(*fields)
        if start is None:
            raise self.unexpected("an interval field")
        lead = frac = -1
        if self.take("("):
            lead = self.integer()
            if start == "SECOND" and self.take(","):
                frac = self.integer()
            self.need(")")
        end = start
        if self.take("TO"):
            end = self.any_of(*fields)
            group = YM_FIELDS if start in YM_FIELDS else DT_FIELDS
            if end not in group or group.index(end) <= group.index(start):
                raise SqlError("22023", f"Interval cannot go from {start} to {end}", self.where())
            if end == "SECOND" and self.take("("):
                frac = self.integer()
                self.need(")")
        if lead > 9 or lead == 0 or frac > 6:
            raise SqlError("22023", "Interval precision is out of range", self.where())
        return Type("INTERVAL", lead, frac, start, end)

    def type(self) -> Type:
        at = self.where()
        if self.now.kind != "word":
            raise self.unexpected("a data type")
        words = [self.name("a data type")]
        if words[0] == "INTERVAL":
            return resolve("INTERVAL", [], self.qualifier())
        while self.now.kind == "word" and self.now.text in ("PRECISION", "VARYING", "CHAR", "CHARACTER") and words[0] in ("DOUBLE", "NATIONAL", "NCHAR", "CHAR", "CHARACTER", "BINARY"):
            words.append(self.name())
        args = []
        if self.take("("):
            args = self.listed(self.integer)
            self.need(")")
        if self.now.text == "VARYING":
            raise self.unexpected("a length after VARYING")
        zone = False
        if words[0] in ("TIME", "TIMESTAMP"):
            zone = self.take("WITH", "TIME", "ZONE")
            self.take("WITHOUT", "TIME", "ZONE")
        try:
            return resolve(" ".join(words), args, zone=zone)
        except SqlError as e:
            raise SqlError(e.sqlstate, e.message, at) from None

    def call(self, at) -> Node:
        name = self.now.text
        self.i += 2
        if name == "EXTRACT":
            field = self.name("a field")
            self.need("FROM")
            args = [self.expr()]
            self.need(")")
            return self.node("Call", name=name, args=args, field=field, distinct=False, star=False, at=at)
        if name == "TRIM":
            side = self.any_of("LEADING", "TRAILING", "BOTH")
            chars = None
            if side and self.take("FROM"):
                arg = self.expr()
            else:
                arg = self.expr()
                if self.take("FROM"):
                    chars, arg = arg, self.expr()
                elif side:
                    raise self.unexpected("FROM")
            self.need(")")
            return self.node("Call", name=name, args=[arg] + ([chars] if chars else []), side=side or "BOTH", distinct=False, star=False, at=at)
        if name == "POSITION":
            needle = self.additive()
            self.need("IN")
            args = [needle, self.additive()]
            self.need(")")
            return self.node("Call", name=name, args=args, distinct=False, star=False, at=at)
        distinct = star = False
        args = []
        if self.take("*"):
            if name != "COUNT":
                raise self.unexpected("an argument")
            star = True
        elif not self.is_(")"):
            distinct = self.any_of("DISTINCT", "ALL") == "DISTINCT"
            args = [self.expr()]
            if name == "SUBSTRING" and self.take("FROM"):
                args.append(self.expr())
                if self.take("FOR"):
                    args.append(self.expr())
            while self.take(","):
                args.append(self.expr())
        self.need(")")
        if self.now.kind == "word" and self.now.text in ("OVER", "FILTER", "WITHIN") and self.ahead().text in ("(", "GROUP"):
            raise self.no(self.now.text)
        return self.node("Call", name=name, args=args, distinct=distinct, star=star, at=at)


def parse(sql: str) -> Node:
    # the nesting limit is ours to report, not Python's
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 30_000))
    return Parser(sql).statement()
