"""The statement engine: a catalog of immutable DataFrame snapshots, changed by statements and undone by keeping old ones.

A table is a DataFrame with a hidden row identity (``_rid``) beside its declared constraints. DML is a query that makes
the next snapshot, whose lineage is cut by a reliable checkpoint; the new snapshot is validated by jobs before it replaces the old.
A transaction or savepoint is a copy of the catalog's dictionaries.
"""

from __future__ import annotations

import copy
import itertools
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import grid, statements
from .bodies import Body
from .procedures import BodyParser, Procedure, call
from .sql.lexer import SqlError, Token, tokenize
from .sql.translate import Translator, literal, quote, text
from .storage import Store, cut, numbered

_ids = itertools.count()
_LEVELS, LEVELS = "spark.sql.cteRecursionLevelLimit", 1000
RID = "_rid"


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    not_null: bool = False
    auto: bool = False
    default: str | None = None
    length: int | None = None
    declared: str = ""


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]
    on_delete: str = "RESTRICT"
    on_update: str = "RESTRICT"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    df: DataFrame
    key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    checks: tuple[tuple[str, str], ...] = ()
    foreign: tuple[ForeignKey, ...] = ()

    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name.lower() == name.lower():
                return c
        raise SqlError(f"unknown column {name} in {self.name}")


@dataclass(frozen=True)
class View:
    """sql is its query; for columns of one table or view, perhaps filtered: that one, the columns by name, and the test of its rows."""

    sql: str
    base: str | None = None
    columns: tuple[tuple[str, str], ...] = ()
    where: str | None = None
    check: bool = False


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, View] = field(default_factory=dict)
    materialized: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    sequences: dict[str, tuple[int, int]] = field(default_factory=dict)
    indexes: dict[str, tuple[str, tuple[str, ...], bool]] = field(default_factory=dict)
    schemas: set[str] = field(default_factory=set)
    triggers: dict[str, tuple[str, str, str, list[tuple[str, str]]]] = field(default_factory=dict)

    def copy(self) -> State:
        return State(*(copy.copy(getattr(self, f)) for f in self.__dataclass_fields__))


class Engine:
    """``Engine(spark).sql(text)`` runs one statement and returns a DataFrame; ``run_script`` runs several."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.state = spark, State()
        self.variables: dict[str, object] = {}
        self.functions: dict = {}
        self.procedures: dict[str, Procedure] = {}
        self.log: list[str] = []
        self.prefix = f"lm{next(_ids)}_"
        self.numbers: dict[tuple[str, str], int] = {}
        self.drawn: set[str] = set()  # sequences that the statement draws from row by row
        self.known: dict[tuple, str | None] = {}
        self.sources: dict[str, str] = {}  # text of functions and procedures, for save()
        self.stack: list[tuple[str | None, State]] = []

    # -------------------------------------------------------------- names

    def register(self, name: str, df: DataFrame) -> None:
        """A read-only source, such as a Parquet table: no row identity, no copy, full pushdown."""
        df.createOrReplaceTempView(self.view("src", name.lower()))
        self.state.views[name.lower()] = View(f"SELECT * FROM {quote(self.view('src', name.lower()))}")

    def view(self, kind: str, key: str) -> str:
        """The temporary view that stands for a name of any letters."""
        return f"{self.prefix}{kind}{self.numbers.setdefault((kind, key), len(self.numbers))}"

    def relation(self, name: str) -> str:
        key = name.lower()
        if key in self.state.tables:
            table = self.state.tables[key]
            view = self.view("t", key)
            table.df.select(*[quote(c) for c in table.names()]).createOrReplaceTempView(view)
            return quote(view)
        if key in self.state.views:
            return f"({self.state.views[key].sql})"
        if key in self.state.materialized:
            view = self.view("mv", key)
            self.state.materialized[key][1].createOrReplaceTempView(view)
            return quote(view)
        known = [*self.state.tables, *self.state.views, *self.state.materialized]
        near = [k for k in known if _distance(k, key) <= 2]
        raise SqlError(f"unknown table {name}" + (f"; did you mean {near[0]}?" if near else ""), "name")

    def nextval(self, name: str, per_row: bool = False) -> str:
        """The next number as SQL; in a select list, a number for each row, drawn when rows() has counted them."""
        key = name.lower()
        if key not in self.state.sequences:
            raise SqlError(f"unknown sequence {name}", "name")
        value, step = self.state.sequences[key]
        if per_row:
            self.drawn.add(key)
            return f"({value} + {step} * (row_number() OVER (ORDER BY monotonically_increasing_id()) - 1))"
        self.state.sequences[key] = (value + step, step)
        return str(value)

    def rows(self, sql: str) -> DataFrame:
        """A query's rows; sequences that it draws from move on by their number."""
        df = self.spark.sql(sql)
        if self.drawn:
            df = cut(df)
            n = df.count()
            for key in self.drawn:
                value, step = self.state.sequences[key]
                self.state.sequences[key] = (value + step * n, step)
            self.drawn.clear()
        return df

    def kind(self, x: str, sources: list[str], head: str) -> str | None:
        """The Spark type of an expression over the innermost FROM clause, or over it and those around it."""
        key = (x, tuple(sources), head)
        if key not in self.known:
            self.known[key] = None
            for among in ([sources[-1:], sources] if len(sources) > 1 else [sources]):
                try:
                    self.known[key] = self.spark.sql(f"{head}SELECT {x} AS v{' FROM ' + ', '.join(among) if among else ''}").schema[0].dataType.simpleString()
                    break
                except (AnalysisException, ParseException):
                    continue  # it does not stand alone there
        return self.known[key]

    def parser(self, sql) -> Translator:
        return Translator(sql, self.relation, self.variables, self.nextval, self.functions, self.kind)

    def table(self, name: str) -> Table:
        if name.lower() not in self.state.tables:
            self.relation(name)
            raise SqlError(f"{name} is not a table")
        return self.state.tables[name.lower()]

    def note(self, message: str) -> DataFrame:
        return self.spark.createDataFrame([(message,)], "status string")

    # -------------------------------------------------------------- statements

    def run_script(self, script: str | Path) -> Iterator[str]:
        """Text of each statement's result; errors are reported and the script goes on."""
        source = Path(script).read_text() if isinstance(script, Path) else script
        for statement in statements(source):
            try:
                yield grid(self.sql(statement))
            except SqlError as e:
                yield f"ERROR: {e}"

    def sql(self, sql: str) -> DataFrame:
        return self.execute(self.parser(tokenize(sql)), sql)

    def execute(self, p: Translator, sql: str) -> DataFrame:
        before = self.state.copy()
        self.known.clear()
        self.drawn.clear()
        try:
            return self._dispatch(p, sql)
        except SqlError:
            self.state = before
            raise
        except Exception as e:  # Spark's analysis and run-time errors, with its own suggestions of names
            self.state = before
            message = str(e).split("\n\nJVM")[0].split("JVM stacktrace")[0].strip()
            raise SqlError(message, "name" if "UNRESOLVED" in message else "semantic" if isinstance(e, AnalysisException | ParseException) else "runtime") from e

    def _dispatch(self, p: Translator, sql: str) -> DataFrame:
        head = p.peek().upper
        if head in ("SELECT", "WITH", "VALUES") or p.at("("):
            if any(t.upper == "RECURSIVE" for t in p.t) and int(self.spark.conf.get(_LEVELS)) < LEVELS:
                self.spark.conf.set(_LEVELS, str(LEVELS))
            out = p.query()
            self._end(p)
            return self.rows(out)
        method = getattr(self, "_" + head.lower(), None)
        if method is None or head not in ("CREATE", "DROP", "ALTER", "INSERT", "REPLACE", "UPDATE", "DELETE", "MERGE", "TRUNCATE", "SHOW", "DESC", "DESCRIBE", "EXPLAIN", "BEGIN", "START", "COMMIT", "ROLLBACK", "SAVEPOINT", "RELEASE", "SET", "CALL"):
            p.fail("unknown statement")
        p.i += 1
        return method(p, sql)

    def _end(self, p: Translator) -> None:
        p.take(";")
        if p.peek().kind != "end":
            p.fail("unexpected text after the statement")

    # -------------------------------------------------------------- durability

    def save(self, path: str) -> None:
        """Write all tables and what is declared about them into a new folder below path, then make it the current one by one rename."""
        name = f"v-{uuid.uuid4().hex}"
        state, tables = self.state, {}
        for k, (key, t) in enumerate(state.tables.items()):
            t.df.write.parquet(f"{path}/{name}/t{k}")
            tables[key] = {f: [asdict(x) for x in v] if f in ("columns", "foreign") else v for f, v in t.__dict__.items() if f != "df"} | {"at": f"t{k}"}
        for k, (_, df) in enumerate(state.materialized.values()):
            df.write.parquet(f"{path}/{name}/m{k}")
        about = {
            "tables": tables, "views": {k: v.__dict__ for k, v in self._portable().items()}, "materialized": {k: [v[0], f"m{n}"] for n, (k, v) in enumerate(state.materialized.items())},
            "sequences": state.sequences, "indexes": state.indexes, "schemas": sorted(state.schemas), "triggers": state.triggers, "sources": self.sources, "names": {f"{k} {n}": v for (k, n), v in self.numbers.items()}, "prefix": self.prefix,
        }
        store = Store(self.spark, path)
        store.write(f"{name}/about.json", json.dumps(about))
        store.write(f"{name}.current", name)
        store.rename(f"{name}.current", "current")

    def _portable(self) -> dict[str, View]:
        """Views without those over registered sources, which are registered again."""
        return {k: v for k, v in self.state.views.items() if not any(quote(self.view("src", n)) in v.sql for kind, n in list(self.numbers) if kind == "src")}

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Engine:
        """The engine that was saved last below path."""
        store, db = Store(spark, path), cls(spark)
        name = store.read("current")
        about = json.loads(store.read(f"{name}/about.json"))
        renamed = lambda sql: sql.replace(about["prefix"], db.prefix)
        db.numbers = {tuple(k.split(" ", 1)): v for k, v in about["names"].items()}
        for key, t in about["tables"].items():
            columns = tuple(Column(**c) for c in t["columns"])
            foreign = tuple(ForeignKey(tuple(f["columns"]), f["table"], tuple(f["to"]), f["on_delete"], f["on_update"]) for f in t["foreign"])
            df = spark.read.parquet(f"{path}/{name}/{t['at']}")
            db.state.tables[key] = Table(t["name"], columns, df, tuple(t["key"]), tuple(map(tuple, t["unique"])), tuple(map(tuple, t["checks"])), foreign)
            db.relation(key)
        for key, v in about["views"].items():
            db.state.views[key] = View(renamed(v["sql"]), v["base"], tuple(map(tuple, v["columns"])), v["where"], v["check"])
        db.state.materialized = {k: (sql, spark.read.parquet(f"{path}/{name}/{at}")) for k, (sql, at) in about["materialized"].items()}
        db.state.sequences = {k: tuple(v) for k, v in about["sequences"].items()}
        db.state.indexes = {k: (t, tuple(c), u) for k, (t, c, u) in about["indexes"].items()}
        db.state.schemas = set(about["schemas"])
        db.state.triggers = {k: (t, w, e, [tuple(x) for x in sets]) for k, (t, w, e, sets) in about["triggers"].items()}
        for sql in about["sources"].values():
            db.sql(sql)
        return db

    # -------------------------------------------------------------- transactions

    def _begin(self, p, sql):
        self.stack.append((None, self.state.copy()))
        return self.note("BEGIN")

    _start = _begin

    def _commit(self, p, sql):
        self.stack.clear()
        return self.note("COMMIT")

    def _savepoint(self, p, sql):
        self.stack.append((p.name().lower(), self.state.copy()))
        return self.note("SAVEPOINT")

    def _point(self, name: str) -> int:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == name.lower():
                return k
        raise SqlError(f"no savepoint {name}")

    def _release(self, p, sql):
        p.take("SAVEPOINT")
        del self.stack[self._point(p.name())]
        return self.note("RELEASE")

    def _rollback(self, p, sql):
        if p.take("TO"):
            p.take("SAVEPOINT")
            k = self._point(p.name())
            self.state = self.stack[k][1].copy()
            del self.stack[k + 1 :]
        else:
            if not self.stack:
                raise SqlError("no transaction is open")
            self.state = self.stack[0][1]
            self.stack.clear()
        return self.note("ROLLBACK")

    def _set(self, p, sql):
        name = p.name().lower()
        p.need("=")
        value = p.expression()
        self.variables[name] = self.spark.sql(f"SELECT {value} AS v").first()["v"]
        return self.note("SET")

    # -------------------------------------------------------------- DDL

    def _create(self, p, sql):
        replaced = p.take("OR", "REPLACE")
        if p.take("TABLE"):
            return self._create_table(p)
        if p.take("MATERIALIZED", "VIEW"):
            name = p.dotted().lower()
            p.need("AS")
            start = p.peek().at
            self.state.materialized[name] = (sql[start:], cut(self.spark.sql(p.query())))
            return self.note("CREATE MATERIALIZED VIEW")
        if p.take("VIEW"):
            name = p.dotted().lower()
            columns = p.columns() if p.at("(") else None
            if name in self.state.views and not replaced:
                raise SqlError(f"view {name} exists")
            p.need("AS")
            base, pairs, where = self._insertable(p)
            body = p.query()
            check = False
            if p.take("WITH"):
                p.take("CASCADED") or p.take("LOCAL")
                p.need("CHECK", "OPTION")
                check = True
            self.spark.sql(body).schema  # analysed now, planned when used
            if columns:
                pairs = [(c, b) for c, (_, b) in zip(columns, pairs, strict=False)]
                body = f"SELECT * FROM ({body}) AS v({', '.join(map(quote, columns))})"
            self.state.views[name] = View(body, base, tuple(pairs), where, check)
            return self.note("CREATE VIEW")
        unique = p.take("UNIQUE")
        if p.take("INDEX"):
            name = p.name().lower()
            p.need("ON")
            table = self.table(p.dotted())
            columns = tuple(table.column(c).name for c in p.columns())
            if unique:
                self._change(replace(table, unique=(*table.unique, columns)))
            self.state.indexes[name] = (table.name, columns, unique)
            return self.note("CREATE INDEX")
        if p.take("SCHEMA"):
            self.state.schemas.add(p.name().lower())
            return self.note("CREATE SCHEMA")
        if p.take("SEQUENCE"):
            name, start, step = p.dotted().lower(), 1, 1
            while p.peek().kind == "word":
                word = p.name().upper()
                p.take("WITH") or p.take("BY")
                sign = -1 if p.take("-") else 1
                value = sign * int(p.primary())
                start, step = (value, step) if word == "START" else (start, value)
            self.state.sequences[name] = (start, step)
            return self.note("CREATE SEQUENCE")
        if p.at("FUNCTION") or p.at("PROCEDURE"):
            self.sources[" ".join(t.value.lower() for t in p.t[p.i : p.i + 2])] = sql
            return self._create_function(p) if p.take("FUNCTION") else self._create_procedure(p) if p.take("PROCEDURE") else None
        if p.take("TRIGGER"):
            return self._create_trigger(p)
        p.fail("cannot create that")

    def _create_function(self, p):
        """A function becomes an expression where it is called: one RETURN in line, a longer body as steps over a struct."""
        name = p.name().upper()
        p.need("(")
        params: list[tuple[str, str]] = []
        if not p.at(")"):
            p.listed(lambda: params.append((p.name().lower(), p.type_name())))
        p.need(")")
        p.need("RETURNS")
        kind = p.type_name()
        body = BodyParser(p)
        if p.take("BEGIN"):
            nodes = body.block("END")
            p.need("END")
        else:
            nodes = [body.statement()]
        p.take(";")

        def inline(caller: Translator, *args: str) -> str:
            if len(args) != len(params):
                raise SqlError(f"{name} takes {len(params)} arguments")
            q = self.parser(list(nodes[0][1]))
            q.texts = {n: x for (n, _), x in zip(params, args, strict=True)}
            q.sources, q.head = caller.sources, caller.head
            out = q.expression()
            return Translator.cast(out, kind, q.kind(out))

        if len(nodes) == 1 and nodes[0][0] == "return":
            self.functions[name] = inline
        else:
            steps = Body(nodes, params, kind, self.parser)
            steps.call(*["NULL"] * len(params))  # a wrong body is an error now, not when it is called
            self.functions[name] = lambda _, *args: steps.call(*args)
        return self.note("CREATE FUNCTION")

    def _insertable(self, p) -> tuple[str | None, list[tuple[str, str]], str | None]:
        """What a view that begins here takes rows for: a table, (column of the view, its column) pairs, and the rows' test."""
        q = self.parser(p.t[p.i :])
        try:
            q.need("SELECT")
            every, pairs = q.take("*"), []

            def item() -> None:
                column = q.dotted().split(".")[-1]
                named = q.take("AS") or q.peek().kind == "word" and q.peek().upper not in ("FROM", "WHERE")
                pairs.append((q.name() if named and not q.at(",") else column, column))

            if not every:
                q.listed(item)
            q.need("FROM")
            base = q.dotted().lower()
            alias = q.alias().removeprefix(" AS ").strip("`") or base.rsplit(".", 1)[-1]
            own = dict(self.state.views[base].columns) if base in self.state.views else {c: c for c in self.table(base).names()}
            if not own:
                q.fail("no columns")
            pairs = pairs or [(c, c) for c in own]
            where = None
            if q.take("WHERE"):  # over the columns of the table below
                q.sources = [f"{self.relation(base)} AS {quote(alias)}"]
                q.texts = {c.lower(): quote(self._column_below(base, c)) for c in own}
                where = q.expression().replace(quote(alias) + ".", "")
            if not (q.peek().kind == "end" or q.at(";") or q.at("WITH")):
                q.fail("more than columns of one table")
            return base, pairs, where
        except SqlError:
            return None, [], None

    def _column_below(self, name: str, column: str) -> str:
        """The table's column that a column of a view, or of a view of a view, shows."""
        while name in self.state.views:
            view = self.state.views[name]
            column, name = {c.lower(): b for c, b in view.columns}[column.lower()], view.base
        return column

    def _create_procedure(self, p):
        name, params = p.name(), []
        p.need("(")

        def param() -> str:
            mode = p.name().upper() if p.at("IN") or p.at("OUT") or p.at("INOUT") else "IN"
            params.append((mode, p.name().lower(), p.type_name()))
            return ""

        if not p.at(")"):
            p.listed(param)
        p.need(")")
        p.need("BEGIN")
        body = BodyParser(p).block("END")
        p.need("END")
        self.procedures[name.lower()] = Procedure(name, params, body)
        return self.note("CREATE PROCEDURE")

    def _call(self, p, sql):
        name = p.name().lower()
        if name not in self.procedures:
            raise SqlError(f"unknown procedure {name}")
        p.need("(")
        arguments: list[list[Token]] = []

        def argument() -> str:
            start = p.i
            p.expression()
            arguments.append([*p.t[start : p.i], Token("end", "", 0)])
            return ""

        if not p.at(")"):
            p.listed(argument)
        p.need(")")
        values = dict(p.locals)
        for k, tokens in enumerate(arguments):  # a caller's own variables are seen by value
            if len(tokens) == 2 and tokens[0].value.lower() in values:
                arguments[k] = [*tokenize(literal(values[tokens[0].value.lower()]))]
        return call(self, self.procedures[name], arguments)

    def _create_trigger(self, p):
        """BEFORE and AFTER, by row or statement: assignments to NEW, or a note in the session log."""
        name, when, event = p.name(), p.name().upper(), p.name().upper()
        p.need("ON")
        table = self.table(p.dotted())
        if p.take("FOR", "EACH"):
            p.name()
        begun = p.take("BEGIN")
        p.take("SET")

        def assignment() -> tuple[str, str]:
            target = p.dotted()
            p.need("=")
            return target.split(".")[-1], p.expression()

        sets = p.listed(assignment)
        p.take(";")
        if begun:
            p.need("END")
        self.state.triggers[name.lower()] = (table.name.lower(), when, event, sets)
        return self.note("CREATE TRIGGER")

    def _fire(self, table: Table, event: str, rows: DataFrame) -> DataFrame:
        """Rows (NEW, and for updates OLD, as structs) with the assignments of BEFORE triggers."""
        for target, when, what, sets in self.state.triggers.values():
            if (target, when, what) == (table.name.lower(), "BEFORE", event) and event != "DELETE":
                for c, x in sets:
                    column = table.column(c)
                    rows = rows.withColumn("NEW", F.col("NEW").withField(column.name, F.expr(f"CAST({x} AS {column.type})")))
        return rows

    def _fired(self, table: Table, event: str, count: int) -> None:
        for name, (target, when, what, _) in self.state.triggers.items():
            if target == table.name.lower() and what == event and (when == "AFTER" or event == "DELETE"):
                self.log.append(f"{name}: {when} {event} ON {table.name}, {count} rows")

    def _column(self, p) -> tuple[Column, dict]:
        name, at = p.name(), p.i
        serial = p.at("SERIAL")
        kind = p.type_name()
        words = p.t[at : p.i]
        declared = "".join(t.value for t in words)
        length = int(words[2].value) if kind == "STRING" and len(words) > 2 else None
        column, extra = Column(name, kind, auto=serial, length=length, declared=declared.upper()), {}
        while True:
            if p.take("PRIMARY", "KEY"):
                extra["key"] = True
            elif p.take("NOT", "NULL"):
                column = replace(column, not_null=True)
            elif p.take("NULL"):
                pass
            elif p.take("UNIQUE"):
                extra["unique"] = True
            elif p.take("AUTO_INCREMENT") or p.take("IDENTITY"):
                column = replace(column, auto=True)
            elif p.take("DEFAULT"):
                column = replace(column, default=p.sum())
            elif p.take("CHECK"):
                p.need("(")
                extra.setdefault("checks", []).append((f"{name}_check", p.expression()))
                p.need(")")
            elif p.take("REFERENCES"):
                extra["foreign"] = self._references(p, (name,))
            else:
                return column, extra

    def _references(self, p, columns: tuple[str, ...]) -> ForeignKey:
        table = p.dotted()
        to = tuple(p.columns()) if p.at("(") else self.table(table).key
        actions = {"DELETE": "RESTRICT", "UPDATE": "RESTRICT"}
        while p.take("ON"):
            which = p.name().upper()
            action = p.name().upper()
            if action in ("SET", "NO"):
                action += " " + p.name().upper()
            actions[which] = action if action in ("CASCADE", "SET NULL") else "RESTRICT"
        return ForeignKey(columns, table.lower(), to, actions["DELETE"], actions["UPDATE"])

    def _create_table(self, p):
        there = p.take("IF", "NOT", "EXISTS")
        name = p.dotted()
        if "." in name and name.split(".")[0].lower() not in self.state.schemas:
            raise SqlError(f"unknown schema {name.split('.')[0]}")
        if name.lower() in self.state.tables:
            if there:
                return self.note("table exists")
            raise SqlError(f"table {name} exists")
        p.need("(")
        columns, key, unique, checks, foreign = [], (), [], [], []

        def member() -> str:
            nonlocal key
            label = p.name() if p.take("CONSTRAINT") else None
            if p.take("PRIMARY", "KEY"):
                key = tuple(p.columns())
            elif p.take("UNIQUE"):
                unique.append(tuple(p.columns()))
            elif p.take("CHECK"):
                p.need("(")
                checks.append((label or "check", p.expression()))
                p.need(")")
            elif p.take("FOREIGN", "KEY"):
                own = tuple(p.columns())
                p.need("REFERENCES")
                foreign.append(self._references(p, own))
            else:
                c, extra = self._column(p)
                columns.append(c)
                key = (c.name,) if extra.get("key") else key
                unique.extend([(c.name,)] if extra.get("unique") else [])
                checks.extend(extra.get("checks", []))
                foreign.extend([extra["foreign"]] if "foreign" in extra else [])
            return ""

        p.listed(member)
        p.need(")")
        columns = [replace(c, not_null=c.not_null or c.name in key) for c in columns]
        schema = ", ".join([f"{RID} STRING", *(f"{quote(c.name)} {c.type}" for c in columns)])
        self.state.tables[name.lower()] = Table(name, tuple(columns), self.spark.createDataFrame([], schema), key, tuple(unique), tuple(checks), tuple(foreign))
        return self.note("CREATE TABLE")

    def _drop(self, p, sql):
        p.take("MATERIALIZED")
        kind = p.name().upper()
        there = p.take("IF", "EXISTS")
        name = p.dotted().lower()
        where = {"TABLE": self.state.tables, "INDEX": self.state.indexes, "SEQUENCE": self.state.sequences}.get(kind)
        if kind == "VIEW":
            where = self.state.views if name in self.state.views else self.state.materialized
        if kind == "SCHEMA":
            self.state.schemas.discard(name)
        elif kind in ("PROCEDURE", "TRIGGER"):
            (self.procedures if kind == "PROCEDURE" else self.state.triggers).pop(name, None)
        elif kind == "FUNCTION":
            self.functions.pop(name.upper(), None)
        elif name in where:
            del where[name]
        elif not there:
            raise SqlError(f"no {kind.lower()} {name}")
        return self.note(f"DROP {kind}")

    def _alter(self, p, sql):
        if p.take("MATERIALIZED", "VIEW"):
            name = p.dotted().lower()
            p.need("REFRESH")
            source, old = self.state.materialized[name]
            new = self.spark.sql(self.parser(source.rstrip("; \n")).query())
            if new.dtypes != old.dtypes:
                raise SqlError(f"the columns of {name} have changed")
            self.state.materialized[name] = (source, cut(new))
            return self.note("REFRESH")
        p.need("TABLE")
        table = self.table(p.dotted())
        if p.take("ADD"):
            p.take("COLUMN")
            c, _ = self._column(p)
            df = table.df.withColumn(c.name, F.expr(f"CAST({c.default or 'NULL'} AS {c.type})"))
            self._change(replace(table, columns=(*table.columns, c), df=df))
        elif p.take("DROP"):
            p.take("COLUMN")
            c = table.column(p.name())
            self._change(replace(table, columns=tuple(x for x in table.columns if x != c), df=table.df.drop(c.name)))
        elif p.take("MODIFY"):
            p.take("COLUMN")
            c, _ = self._column(p)
            old = table.column(c.name)
            df = table.df.withColumn(old.name, F.expr(Translator.cast(quote(old.name), c.type)))
            self._change(replace(table, columns=tuple(c if x == old else x for x in table.columns), df=df))
        elif p.take("RENAME"):
            if p.take("COLUMN"):
                old = table.column(p.name())
                p.need("TO")
                new = p.name()
                self._change(replace(table, columns=tuple(replace(x, name=new) if x == old else x for x in table.columns), df=table.df.withColumnRenamed(old.name, new)))
            else:
                p.need("TO")
                new = p.dotted()
                del self.state.tables[table.name.lower()]
                self.state.tables[new.lower()] = replace(table, name=new)
        else:
            p.fail("cannot alter that")
        return self.note("ALTER TABLE")

    # -------------------------------------------------------------- constraints

    def _change(self, new: Table, old: Table | None = None) -> None:
        """Validate a snapshot, apply the actions of foreign keys that name it, and make it current."""
        new = replace(new, df=cut(new.df))
        self._validate(new)
        before = self.state.tables.get(new.name.lower())
        self.state.tables[new.name.lower()] = new
        if before is not None:
            for child in list(self.state.tables.values()):
                for fk in child.foreign:
                    if fk.table == new.name.lower():
                        self._follow(child, fk, before, new)

    def _validate(self, table: Table) -> None:
        tests: list[tuple[str, str]] = []
        for c in table.columns:
            if c.not_null:
                tests.append((f"NOT NULL of {c.name}", f"{quote(c.name)} IS NULL"))
            if c.length is not None:
                tests.append((f"length of {c.name}", f"length({quote(c.name)}) > {c.length}"))
        tests += [(f"CHECK {label}", f"NOT ({x})") for label, x in table.checks]
        if tests:  # one job for all row-wise constraints
            row = table.df.agg(*[F.count_if(F.expr(x)).alias(f"t{k}") for k, (_, x) in enumerate(tests)]).first()
            for k, (label, _) in enumerate(tests):
                if row[k]:
                    raise SqlError(f"constraint violated: {label} of {table.name}", "constraint")
        for columns in ([table.key] if table.key else []) + list(table.unique):
            known = table.df.where(" AND ".join(f"{quote(c)} IS NOT NULL" for c in columns))
            if known.groupBy(*[quote(c) for c in columns]).count().where("count > 1").limit(1).count():
                raise SqlError(f"constraint violated: unique {', '.join(columns)} of {table.name}", "constraint")
        for fk in table.foreign:
            parent = self.state.tables.get(fk.table) if fk.table != table.name.lower() else table
            if parent is None:
                raise SqlError(f"unknown table {fk.table}")
            own = table.df.where(" AND ".join(f"{quote(c)} IS NOT NULL" for c in fk.columns)).select(*[F.col(quote(c)).alias(f"k{i}") for i, c in enumerate(fk.columns)])
            keys = parent.df.select(*[F.col(quote(c)).alias(f"k{i}") for i, c in enumerate(fk.to)])
            if own.join(keys, [f"k{i}" for i in range(len(fk.to))], "left_anti").limit(1).count():
                raise SqlError(f"constraint violated: foreign key {', '.join(fk.columns)} of {table.name}", "constraint")

    def _follow(self, child: Table, fk: ForeignKey, before: Table, after: Table) -> None:
        """What a change of a parent does to the rows that point at it."""
        names = [f"k{i}" for i in range(len(fk.to))]
        keys = lambda t: t.df.select(RID, *[F.col(quote(c)).alias(k) for c, k in zip(fk.to, names, strict=True)])
        old, new = keys(before), keys(after)
        moved = old.join(new.withColumnsRenamed({k: "n" + k for k in names}), RID, "left").where(" OR ".join(f"NOT (n{k} <=> {k})" for k in names))
        alive = new.select(RID, F.lit(True).alias("_alive"))
        moved = moved.join(alive, RID, "left").drop(RID)
        hit = child.df.join(moved, [F.col(quote(c)) == F.col(k) for c, k in zip(fk.columns, names, strict=True)], "left")
        hit = hit.withColumn("_hit", F.expr(f"{names[0]} IS NOT NULL"))
        kinds = hit.where("_hit").agg(F.count_if(F.col("_alive").isNull()).alias("gone"), F.count_if(F.col("_alive").isNotNull()).alias("moved")).first()
        if not kinds["gone"] and not kinds["moved"]:
            return
        if kinds["gone"] and fk.on_delete == "RESTRICT" or kinds["moved"] and fk.on_update == "RESTRICT":
            raise SqlError(f"constraint violated: {child.name} refers to {after.name}", "constraint")
        gone = F.col("_hit") & F.col("_alive").isNull()
        if fk.on_delete == "CASCADE":
            hit = hit.where(~gone)
        columns = []
        for c in child.columns:
            x = F.col(quote(c.name))
            if c.name in fk.columns:
                k = names[fk.columns.index(c.name)]
                if fk.on_delete == "SET NULL":
                    x = F.when(gone, None).otherwise(x)
                update = F.col("n" + k) if fk.on_update == "CASCADE" else F.lit(None)
                x = F.when(F.col("_hit") & F.col("_alive").isNotNull(), update).otherwise(x)
            columns.append(x.cast(c.type).alias(c.name))
        self._change(replace(child, df=hit.select(RID, *columns)))

    # -------------------------------------------------------------- DML

    def _returning(self, p, table: Table, rows: DataFrame, count: str) -> DataFrame:
        if not p.take("RETURNING"):
            self._end(p)
            return self.note(count)
        view = self.prefix + "returning"
        rows.select(*[quote(c) for c in table.names()]).createOrReplaceTempView(view)
        p.sources = [f"{quote(view)} AS {quote(table.name.rsplit('.', 1)[-1])}"]
        found: list[tuple[str, str | None]] = []
        p.listed(lambda: found.append(p.item()))
        items = ", ".join(f"{x} AS {quote(n)}" if n else x for x, n in found)
        self._end(p)
        return self.spark.sql(f"SELECT {items} FROM {quote(view)} AS {quote(table.name.rsplit('.', 1)[-1])}")

    def _source(self, p, table: Table, view: dict[str, str] | None = None) -> tuple[list[str], DataFrame]:
        """Columns and rows that an INSERT or REPLACE gives; through a view, by the view's columns."""

        def named(c: str) -> str:
            if view is not None and c.lower() not in view:
                raise SqlError(f"unknown column {c}", "name")
            return table.column(view[c.lower()] if view is not None else c).name

        if p.at("(") and p.peek(1).upper not in ("SELECT", "WITH"):
            columns = [named(c) for c in p.columns()]
        else:
            columns = [named(c) for c in view] if view is not None else table.names()
        if p.take("DEFAULT", "VALUES"):
            return [], self.spark.range(1).select()
        if p.at("VALUES"):
            p.need("VALUES")

            def row() -> str:
                p.need("(")
                k = iter(columns)

                def value() -> str:
                    name = next(k, None)
                    if p.take("DEFAULT"):
                        return f"CAST({(table.column(name).default if name else None) or 'NULL'} AS STRING)"
                    return f"CAST({p.expression()} AS STRING)"

                out = p.listed(value)
                p.need(")")
                if len(out) != len(columns):
                    raise SqlError(f"{len(columns)} values expected, {len(out)} given")
                return f"({', '.join(out)})"

            body = "VALUES " + ", ".join(p.listed(row))
        else:
            body = p.query()
        df = self.rows(body)
        if len(df.columns) != len(columns):
            raise SqlError(f"{len(columns)} columns expected, {len(df.columns)} given")
        return columns, df.toDF(*[f"v{k}" for k in range(len(columns))])

    def _rows(self, table: Table, columns: list[str], df: DataFrame, turns: tuple[str, ...] = ()) -> DataFrame:
        """Given values as full rows: casts, defaults, the next numbers, and new row identities.

        With ``turns``, a column _turn tells how many rows of the same key were given up to this one.
        """
        out = []
        given = {c: f"v{k}" for k, c in enumerate(columns)}
        auto = [c for c in table.columns if c.auto]
        base = table.df.agg(*[F.coalesce(F.max(quote(c.name)), F.lit(0)) for c in auto]).first() if auto else []
        df = numbered(df, "_n") if auto else df.withColumn("_n", F.monotonically_increasing_id())
        for c in table.columns:
            if c.name in given:
                x = F.expr(Translator.cast(given[c.name], c.type) if c.type != "BOOLEAN" else f"coalesce(try_cast({given[c.name]} AS BOOLEAN), try_cast({given[c.name]} AS INT) <> 0)")
            else:
                x = F.expr(c.default or "NULL")
            if c.auto:
                x = F.when(x.isNull() | (x == 0), F.col("_n") + base[auto.index(c)]).otherwise(x)
            out.append(x.cast(c.type).alias(c.name))
        made = df.select(F.expr("uuid()").alias(RID), "_n", F.struct(*out).alias("NEW"))
        rows = self._fire(table, "INSERT", made).select(RID, "_n", "NEW.*")
        if not turns:
            return cut(rows.drop("_n"))
        return cut(rows.withColumn("_turn", F.row_number().over(Window.partitionBy(*[quote(c) for c in turns]).orderBy("_n"))).drop("_n"))

    def _insert(self, p, sql):
        p.need("INTO")
        name, columns, tests, checked = p.dotted().lower(), None, [], False
        while name in self.state.views:  # a view of a view checks, if it does, the tests of those below it too
            view = self.state.views[name]
            if view.base is None:
                raise SqlError(f"{name} takes no rows")
            own = {c.lower(): b for c, b in view.columns}
            columns = own if columns is None else {c: own[b.lower()] for c, b in columns.items()}
            checked |= view.check
            tests += [view.where] if checked and view.where else []
            name = view.base
        table = self.table(name)
        given, df = self._source(p, table, columns)
        upsert = p.take("ON", "DUPLICATE", "KEY", "UPDATE")
        rows = self._rows(table, given, df, table.key if upsert else ())
        for test in tests:
            if rows.where(f"NOT coalesce({test}, false)").limit(1).count():
                raise SqlError("a row does not meet the view's check option", "constraint")
        if upsert:
            return self._upsert(p, table, rows)
        self._change(replace(table, df=table.df.unionByName(rows)))
        count = rows.count()
        self._fired(table, "INSERT", count)
        return self._returning(p, table, rows, f"INSERT {count}")

    def _upsert(self, p, table: Table, rows: DataFrame) -> DataFrame:
        """Rows whose key exists update it; VALUES(c) is the given value. Rows of one key follow each other in turns."""
        self.functions["VALUES"] = lambda _, c: "s." + c.rsplit(".", 1)[-1]
        sets = dict(self._assignments(p, table))
        del self.functions["VALUES"]
        on = [F.col(f"t.{quote(k)}") == F.col(f"s.{quote(k)}") for k in table.key]
        hit = f"t.{RID} IS NOT NULL AND s.{RID} IS NOT NULL"
        out = [F.expr(f"coalesce(t.{RID}, s.{RID})").alias(RID)]
        for c in table.columns:
            q = quote(c.name)
            changed = _qualify(sets[c.name], table, "t") if c.name in sets else f"t.{q}"
            out.append(F.expr(f"CASE WHEN {hit} THEN {changed} WHEN t.{RID} IS NULL THEN s.{q} ELSE t.{q} END").cast(c.type).alias(c.name))
        df = table.df
        for turn in range(1, (rows.agg(F.max("_turn")).first()[0] or 0) + 1):
            both = df.alias("t").join(rows.where(F.col("_turn") == turn).alias("s"), on, "full").select(*out)
            df = both if turn == 1 else cut(both)
        self._change(replace(table, df=df))
        self._end(p)
        return self.note(f"UPSERT {rows.count()}")

    def _replace(self, p, sql):
        p.take("INTO")
        table = self.table(p.dotted())
        given, df = self._source(p, table)
        rows = self._rows(table, given, df, table.key)
        if table.key:  # of several rows of one key the last stays
            last = rows.groupBy(*[quote(c) for c in table.key]).agg(F.max("_turn").alias("_last"))
            rows = rows.join(last, list(table.key)).where("_turn = _last").select(*table.df.columns)
        kept = table.df
        for columns in ([table.key] if table.key else []) + list(table.unique):
            kept = kept.join(rows.select(*[quote(c) for c in columns]), [quote(c).strip("`") for c in columns], "left_anti")
        self._change(replace(table, df=kept.select(*table.df.columns).unionByName(rows)))
        return self._returning(p, table, rows, f"REPLACE {rows.count()}")

    def _assignments(self, p, table: Table) -> list[tuple[str, str]]:
        def one() -> tuple[str, str]:
            name = p.name()
            if p.take("."):
                name = p.name()
            c = table.column(name)
            p.need("=")
            return c.name, (c.default or "NULL") if p.take("DEFAULT") else p.expression()

        return p.listed(one)

    def _scope(self, table: Table, alias: str) -> str:
        """The table with its row identity, as SQL."""
        view = self.view("rid", table.name.lower())
        table.df.createOrReplaceTempView(view)
        return f"{quote(view)} AS {quote(alias)}"

    def _update(self, p, sql):
        table = self.table(p.dotted())
        alias = p.alias().removeprefix(" AS ").strip("`") or table.name.rsplit(".", 1)[-1]
        p.need("SET")
        p.sources = [self._scope(table, alias)]
        sets = self._assignments(p, table)
        sources = ", " + p.tables() if p.take("FROM") else ""
        where = p.expression() if p.take("WHERE") else "true"
        values = ", ".join(f"CAST({x} AS {table.column(n).type}) AS `new_{n}`" for n, x in sets)
        hits = self.spark.sql(f"SELECT {quote(alias)}.{RID} AS `_hit`, {values} FROM {self._scope(table, alias)}{sources} WHERE {where}")
        hits = hits.dropDuplicates(["_hit"]) if sources else hits  # of several matches one counts
        both = table.df.join(hits, F.col(RID) == F.col("_hit"), "left")
        changed = dict(sets)
        out = [F.when(F.col("_hit").isNotNull(), F.col(f"`new_{c.name}`")).otherwise(F.col(quote(c.name))).alias(c.name) if c.name in changed else F.col(quote(c.name)) for c in table.columns]
        old = F.struct(*[F.col(quote(c.name)) for c in table.columns]).alias("OLD")
        made = both.select(RID, old, F.struct(*out).alias("NEW"), F.col("_hit").isNotNull().alias("_hit"))
        fired = self._fire(table, "UPDATE", made.where("_hit")).unionByName(made.where("NOT _hit"))
        new = cut(fired.select(RID, "NEW.*", "_hit"))
        self._change(replace(table, df=new.drop("_hit")))
        rows = new.where("_hit")
        count = rows.count()
        self._fired(table, "UPDATE", count)
        return self._returning(p, table, rows, f"UPDATE {count}")

    def _delete(self, p, sql):
        p.need("FROM")
        table = self.table(p.dotted())
        alias = p.alias().removeprefix(" AS ").strip("`") or table.name.rsplit(".", 1)[-1]
        p.sources = [self._scope(table, alias)]
        where = p.expression() if p.take("WHERE") else "true"
        hits = cut(self.spark.sql(f"SELECT {quote(alias)}.* FROM {self._scope(table, alias)} WHERE {where}"))
        self._change(replace(table, df=table.df.join(hits.select(RID), RID, "left_anti")))
        count = hits.count()
        self._fired(table, "DELETE", count)
        return self._returning(p, table, hits, f"DELETE {count}")

    def _truncate(self, p, sql):
        p.take("TABLE")
        table = self.table(p.dotted())
        self._change(replace(table, df=table.df.limit(0)))
        return self.note("TRUNCATE")

    def _merge(self, p, sql):
        p.need("INTO")
        table = self.table(p.dotted())
        alias = p.alias().removeprefix(" AS ").strip("`") or table.name.rsplit(".", 1)[-1]
        p.need("USING")
        source = p.table()
        p.sources = [f"{self._scope(table, alias)}, {source}"]
        p.need("ON")
        on = p.expression()
        sets: list[tuple[str, str]] = []
        columns: list[str] = []
        given: list[str] = []
        drop = False
        while p.take("WHEN"):
            no = p.take("NOT")
            p.need("MATCHED")
            p.need("THEN")
            if no:
                p.need("INSERT")
                columns = [table.column(c).name for c in p.columns()] if p.at("(") else table.names()
                p.need("VALUES")
                p.need("(")
                given = p.listed(p.expression)
                p.need(")")
            elif p.take("DELETE"):
                drop = True
            else:
                p.need("UPDATE")
                p.need("SET")
                sets = self._assignments(p, table)
        values = "".join(f", CAST({x} AS {table.column(n).type}) AS `new_{n}`" for n, x in sets)
        hits = self.spark.sql(f"SELECT {quote(alias)}.{RID} AS `_hit`{values} FROM {self._scope(table, alias)} JOIN {source} ON {on}").dropDuplicates(["_hit"])
        both = table.df.join(hits, F.col(RID) == F.col("_hit"), "left")
        if drop:
            both = both.where("_hit IS NULL")
        changed = dict(sets)
        new = both.select(RID, *[F.when(F.col("_hit").isNotNull(), F.col(f"`new_{c.name}`")).otherwise(F.col(quote(c.name))).alias(c.name) if c.name in changed else F.col(quote(c.name)) for c in table.columns])
        added = 0
        if given:
            fresh = self.spark.sql(f"SELECT {', '.join(f'{x} AS `v{k}`' for k, x in enumerate(given))} FROM {source} WHERE NOT EXISTS (SELECT 1 FROM {self._scope(table, alias)} WHERE {on})")
            rows = self._rows(table, columns, fresh)
            added = rows.count()
            new = new.unionByName(rows)
        self._end(p)
        self._change(replace(table, df=new))
        return self.note(f"MERGE {hits.count()} matched, {added} added")

    # -------------------------------------------------------------- meta

    def _explain(self, p, sql):
        """The plan as text, JSON or an S-expression; ANALYZE runs the query and gives the rows and times of each node."""
        analyze, form = p.take("ANALYZE"), "TEXT"
        if p.take("FORMAT"):
            p.take("=")
            form = p.name().upper()
        df = self.spark.sql(p.query())
        self._end(p)
        execution = df._jdf.queryExecution()
        if not analyze and form == "TEXT":
            lines = execution.toString().splitlines()
        else:
            if analyze:
                execution.toRdd().count()
            tree = plan_tree(execution.executedPlan(), analyze)
            if form == "JSON":
                lines = json.dumps(tree, indent=2, ensure_ascii=False).splitlines()
            elif form == "SEXPR":
                lines = [sexpr(tree)]
            elif form == "TEXT":
                lines = ["== Physical Plan ==", *outline(tree)]
            else:
                raise SqlError(f"unknown format {form}", "syntax")
        return self.spark.createDataFrame([(line,) for line in lines], "plan string")

    def _show(self, p, sql):
        if p.take("TABLES"):
            return self.spark.createDataFrame([(k,) for k in sorted([*self.state.tables, *self.state.views, *self.state.materialized])], "name string")
        if p.take("CREATE", "TABLE"):
            t = self.table(p.dotted())
            lines = [f"{c.name} {c.declared}{' NOT NULL' * c.not_null}" for c in t.columns] + ([f"PRIMARY KEY ({', '.join(t.key)})"] if t.key else [])
            return self.spark.createDataFrame([(t.name, f"CREATE TABLE {t.name} ({', '.join(lines)})")], "name string, ddl string")
        if p.take("COLUMNS"):
            p.need("FROM")
            return self._desc(p, sql)
        if p.take("INDEX"):
            p.need("FROM")
            name = self.table(p.dotted()).name
            rows = [(k, ", ".join(c), u) for k, (t, c, u) in self.state.indexes.items() if t == name]
            return self.spark.createDataFrame(rows, "name string, columns string, is_unique boolean")
        p.fail("cannot show that")

    def _desc(self, p, sql):
        p.take("TABLE")
        t = self.table(p.dotted())
        return self.spark.createDataFrame([(c.name, c.declared, not c.not_null, c.name in t.key, c.default) for c in t.columns], "name string, type string, nullable boolean, is_key boolean, default_value string")

    _describe = _desc


def plan_tree(node, measured: bool) -> dict:
    """A physical plan as nested dictionaries; stages and adaptive plans are seen through."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return plan_tree(node.executedPlan(), measured)
    if kind.endswith("QueryStageExec"):
        return plan_tree(node.plan(), measured)
    children = node.children()
    below = [plan_tree(children.apply(k), measured) for k in range(children.size())]
    if kind in ("WholeStageCodegenExec", "InputAdapter"):
        return below[0]
    out: dict = {"node": node.nodeName().strip(), "detail": node.simpleString(25)}
    if measured:
        for name, key in (("numOutputRows", "rows"), ("sortTime", "sort ms"), ("aggTime", "aggregate ms"), ("scanTime", "scan ms"), ("buildTime", "build ms"), ("shuffleBytesWritten", "shuffled bytes"), ("spillSize", "spilled bytes")):
            metric = node.metrics().get(name)
            if metric.isDefined():
                out[key] = int(metric.get().value())
    return out | {"children": below}


def _figures(tree: dict) -> dict:
    return {k: v for k, v in tree.items() if k not in ("node", "detail", "children")}


def outline(tree: dict, depth: int = 0) -> list[str]:
    figures = ", ".join(f"{k}: {v}" for k, v in _figures(tree).items())
    return ["  " * depth + tree["detail"] + (f"  ({figures})" if figures else ""), *(line for c in tree["children"] for line in outline(c, depth + 1))]


def sexpr(tree: dict) -> str:
    parts = [tree["node"].replace(" ", "_"), *(f":{k.replace(' ', '-')} {v}" for k, v in _figures(tree).items()), *map(sexpr, tree["children"])]
    return f"({' '.join(parts)})"


def _qualify(expression: str, table: Table, alias: str) -> str:
    """Bare columns of the table as columns of alias."""
    import re

    names = "|".join(re.escape(quote(c)) for c in table.names())
    return re.sub(rf"(?<![.`\w])({names})(?!\.)", lambda m: f"{alias}.{m[1]}", expression)


def _distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


__all__ = ["Engine", "SqlError", "literal", "text"]
