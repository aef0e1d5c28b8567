"""A recursive-descent translator from the dialect's queries and expressions to Spark SQL.

It does only what Spark SQL does not do itself: integer division by operand type, nulls last, ANY and ALL, SIMILAR TO, FETCH and LIMIT
a, b, functions of other names or semantics, simple CASE over null, and lenient casts. All of it becomes standard expressions,
so Catalyst plans and optimises the result like any other query.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable

from .lexer import SqlError, Token, tokenize

_INT = "('tinyint','smallint','int','bigint')"
_INTS = {"tinyint", "smallint", "int", "bigint"}
_LONG = 60  # characters; a longer operand is written once and bound to a name
_STOP = set("FROM WHERE GROUP HAVING ORDER LIMIT OFFSET FETCH UNION INTERSECT EXCEPT ON USING JOIN INNER LEFT RIGHT FULL CROSS NATURAL LATERAL WINDOW AS SET VALUES WHEN THEN ELSE END AND OR NOT IN IS LIKE ILIKE BETWEEN RLIKE REGEXP SIMILAR ESCAPE ASC DESC NULLS FOR RETURNING DO BEGIN QUALIFY WITH SELECT FILTER OVER WITHIN ROWS RANGE PRECEDING FOLLOWING CASE".split())
_TYPES = {"INT": "INT", "INTEGER": "INT", "SMALLINT": "INT", "TINYINT": "INT", "BIGINT": "BIGINT", "SERIAL": "INT", "BOOLEAN": "BOOLEAN", "BOOL": "BOOLEAN", "FLOAT": "DOUBLE", "DOUBLE": "DOUBLE", "REAL": "DOUBLE", "DECIMAL": "DECIMAL", "NUMERIC": "DECIMAL", "VARCHAR": "STRING", "CHAR": "STRING", "TEXT": "STRING", "STRING": "STRING", "DATE": "DATE", "TIMESTAMP": "TIMESTAMP_NTZ", "DATETIME": "TIMESTAMP_NTZ", "TIME": "STRING", "JSON": "STRING", "UUID": "STRING"}


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


_fresh = itertools.count()


def bound(template: str, *operands: str) -> str:
    """The template ({0}, {1}, ...) over operands; if one of them is long, each is evaluated and written once."""
    if all(len(x) <= _LONG for x in operands):
        return template.format(*operands)
    v = f"v{next(_fresh)}"
    fields = ", ".join(f"'a{k}', {x}" for k, x in enumerate(operands))
    return f"transform(array(named_struct({fields})), {v} -> {template.format(*[f'{v}.a{k}' for k in range(len(operands))])})[0]"


def _trunc(x: str, n: str) -> str:
    return bound(f"(CASE WHEN {{0}} < 0 THEN ceil({{0}} * power(10, {n})) ELSE floor({{0}} * power(10, {n})) END / power(10, {n}))", x)


def _strict(f: str) -> Callable[..., str]:
    def call(*a: str) -> str:
        names = [f"{{{k}}}" for k in range(len(a))]
        return bound(f"(CASE WHEN {' OR '.join(f'{x} IS NULL' for x in names)} THEN NULL ELSE {f}({', '.join(names)}) END)", *a)

    return call


def _domain(f: str, test: str) -> Callable[[str], str]:
    return lambda x: bound(f"(CASE WHEN {{0}} {test} THEN {f}({{0}}) END)", x)


# Functions whose name or meaning differs from Spark's.
FUNCTIONS: dict[str, Callable[..., str]] = {
    "IFNULL": lambda *a: f"coalesce({', '.join(a)})",
    "IIF": lambda c, a, b: f"if({c}, {a}, {b})",
    "LEN": lambda s: f"octet_length({s})",
    "LENGTH": lambda s: f"octet_length({s})",
    "CHAR_LENGTH": lambda s: f"octet_length({s})",
    "CONCAT": lambda *a: f"concat_ws('', {', '.join(a)})",
    "SUBSTR": lambda s, b, n=None: f"substring({s}, greatest({b}, 1)" + (f", greatest({n}, 0))" if n else ")"),
    "TRIM": lambda s: f"regexp_replace({s}, '^[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+|[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+$', '')",
    "LTRIM": lambda s: f"regexp_replace({s}, '^[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+', '')",
    "RTRIM": lambda s: f"regexp_replace({s}, '[ \\\\t\\\\n\\\\r\\\\f\\\\x0B]+$', '')",
    "INSTR": lambda h, n: f"instr({h}, {n})",
    "POSITION": lambda h, n: f"instr({h}, {n})",
    "STARTS_WITH": lambda s, p: f"CAST(startswith({s}, {p}) AS INT)",
    "ROUND": lambda x, n=None: f"round({x}, {n})" if n else f"CAST(round({x}) AS BIGINT)",
    "CEIL": lambda x: f"CAST(ceil({x}) AS BIGINT)",
    "FLOOR": lambda x: f"CAST(floor({x}) AS BIGINT)",
    "TRUNC": lambda x, n="0": f"CAST({_trunc(x, n)} AS BIGINT)" if n == "0" else _trunc(x, n),
    "MOD": lambda a, b: bound("CAST({0} - floor({0} / nullif({1}, 0)) * {1} AS BIGINT)", a, b),
    "SQRT": _domain("sqrt", ">= 0"),
    "LN": _domain("ln", "> 0"),
    "LOG": lambda a, b=None: f"log({a}, {b})" if b else _domain("ln", "> 0")(a),
    "LOG10": _domain("log10", "> 0"),
    "SIGN": lambda x: f"CAST(sign({x}) AS INT)",
    "GREATEST": _strict("greatest"),
    "LEAST": _strict("least"),
    "TYPEOF": lambda x: bound("(CASE WHEN {0} IS NULL THEN 'NULL' WHEN typeof({0}) IN ('tinyint','smallint','int','bigint','boolean') THEN 'INTEGER' WHEN typeof({0}) IN ('float','double') THEN 'FLOAT' ELSE 'VARCHAR' END)", x),
    "NOW": lambda: "localtimestamp()",
    "RANDOM": lambda: "rand()",
    "VARIANCE": lambda x: f"var_samp({x})",
    "STDDEV": lambda x: f"stddev_samp({x})",
}
for _a, _b in (("CEILING", "CEIL"), ("SUBSTRING", "SUBSTR"), ("TRUNCATE", "TRUNC")):
    FUNCTIONS[_a] = FUNCTIONS[_b]


class Translator:
    """Translates one statement's queries; ``names`` maps a table name to what Spark knows it by.

    ``kinds(expression, sources, head)`` tells an expression's Spark type among the FROM clauses it stands in, or None.
    """

    def __init__(self, tokens: list[Token] | str, names: Callable[[str], str] = quote, variables: dict | None = None, sequence: Callable[[str, bool], str] | None = None, functions: dict | None = None, kinds: Callable[[str, list[str], str], str | None] | None = None) -> None:
        self.t = tokenize(tokens) if isinstance(tokens, str) else tokens
        self.i, self.names, self.ctes = 0, names, [set()]
        self.locals: dict = {}  # variables of a procedure, by name
        self.texts: dict[str, str] = {}  # parameters of a function, as SQL
        self.kinds, self.sources, self.head = kinds, [], ""
        self.plain = False  # a part of a filter, where null is as good as false
        self.per_row = False  # in the select list of a query with FROM
        self.rows: set[str] = set()  # row values (a, b)
        self.windows: dict[str, str] = {}
        self.parts: list[tuple[str, str | None]] = []  # items of the last select, and their names
        self.single = False  # the last set expression was one select without DISTINCT
        self.variables, self.sequence, self.functions = variables if variables is not None else {}, sequence, functions if functions is not None else {}

    # -------------------------------------------------------------- tokens

    def peek(self, k: int = 0) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def at(self, *words: str) -> bool:
        return all(self.peek(k).upper == w or (self.peek(k).kind == "op" and self.peek(k).value == w) for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            self.fail(f"expected {' '.join(words)}")

    def fail(self, why: str) -> None:
        t = self.peek()
        raise SqlError(f"syntax error at line {t.line}, column {t.column}, near {t.value or 'the end'!r}: {why}", "syntax", t.line, t.column)

    def name(self) -> str:
        t = self.peek()
        if t.kind not in ("word", "name"):
            self.fail("expected a name")
        self.i += 1
        return t.value

    def dotted(self) -> str:
        out = [self.name()]
        while self.take("."):
            out.append(self.name())
        return ".".join(out)

    def listed(self, item: Callable[[], str]) -> list[str]:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    # -------------------------------------------------------------- queries

    def query(self) -> str:
        head, outer = "", self.head
        self.ctes.append(set(self.ctes[-1]))
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            parts = []
            while True:
                cte = self.name()
                columns = f"({', '.join(quote(c) for c in self.columns())})" if self.at("(") else ""
                self.need("AS")
                self.need("(")
                if recursive:
                    self.ctes[-1].add(cte.lower())
                parts.append(f"{quote(cte)}{columns} AS ({self.query()})")
                self.need(")")
                self.ctes[-1].add(cte.lower())
                self.head = (outer.rstrip() + ", " if outer else f"WITH {'RECURSIVE ' * recursive}") + ", ".join(parts) + " "
                if not self.take(","):
                    break
            head = f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} "
        out = head + self.tail(self.set_expression())
        self.ctes.pop()
        self.head = outer
        return out

    def columns(self) -> list[str]:
        self.need("(")
        out = self.listed(self.name)
        self.need(")")
        return out

    def set_expression(self) -> str:
        """UNION and EXCEPT from the left; INTERSECT binds tighter."""
        out = self.set_term()
        while self.at("UNION") or self.at("EXCEPT"):
            self.single = False
            op = self.name().upper()
            every = self.take("ALL")
            self.take("DISTINCT")
            out = f"{out} {op}{' ALL' * every} {self.set_term()}"
            self.single = False
        return out

    def set_term(self) -> str:
        out = self.set_operand()
        while self.take("INTERSECT"):
            every = self.take("ALL")
            out = f"({out} INTERSECT{' ALL' * every} {self.set_operand()})"
            self.single = False
        return out

    def set_operand(self) -> str:
        if self.take("("):
            out = self.query()
            self.need(")")
            self.single = False
            return f"({out})"
        if self.at("VALUES"):
            self.single = False
            return self.values()
        return self.select()

    def values(self) -> str:
        self.need("VALUES")
        self.per_row = False

        def row() -> str:
            self.need("(")
            out = ", ".join(self.listed(self.expression))
            self.need(")")
            return f"({out})"

        return "VALUES " + ", ".join(self.listed(row))

    def keys(self) -> list[tuple[str, str]]:
        """ORDER BY: (expression, direction) of each key."""

        def key() -> tuple[str, str]:
            x = self.expression()
            way = "DESC" if self.take("DESC") else "ASC"
            self.take("ASC")
            nulls = "LAST"
            if self.take("NULLS"):
                nulls = "FIRST" if self.take("FIRST") else (self.need("LAST") or "LAST")
            return x, f"{way} NULLS {nulls}"

        return self.listed(key)

    def order_keys(self) -> str:
        return ", ".join(f"{x} {way}" for x, way in self.keys())

    def tied(self, body: str, keys: list[tuple[str, str]], limit: str, offset: str | None) -> str:
        """FETCH ... WITH TIES: rows by rank. Spark keeps only so many ranks of each partition before it brings them together."""
        if not keys:
            self.fail("WITH TIES needs ORDER BY")
        parts = self.parts if self.single else []
        named = {quote(n): x for x, n in parts if n}

        def key(x: str) -> str:
            if x.isdigit():
                if not 0 < int(x) <= len(parts) or parts[int(x) - 1][0].endswith("*"):
                    self.fail(f"WITH TIES cannot order by position {x} here")
                return parts[int(x) - 1][0]
            return named.get(x, x)

        order = ", ".join(f"{key(x)} {way}" for x, way in keys)
        extra = f"rank() OVER (ORDER BY {order}) AS lm_rank, row_number() OVER (ORDER BY {order}) AS lm_row"
        if self.single:
            items = ", ".join(f"{x} AS {quote(n)}" if n else x for x, n in parts)
            inner = f"SELECT {items}, {extra}{body.removeprefix('SELECT ' + items)}"
        else:
            inner = f"SELECT *, {extra} FROM ({body})"
        last = f"{offset} + {limit}" if offset else limit
        return f"SELECT * EXCEPT (lm_rank, lm_row) FROM ({inner}) WHERE lm_rank <= {last}" + (f" AND lm_row > {offset}" if offset else "") + " ORDER BY lm_row"

    def tail(self, body: str) -> str:
        """ORDER BY, LIMIT, OFFSET, FETCH, and lock hints, which mean nothing here."""
        single, parts = self.single, self.parts
        out, limit, offset, ties, keys = "", None, None, False, []
        if self.take("ORDER", "BY"):
            keys = self.keys()
            out += " ORDER BY " + ", ".join(f"{x} {way}" for x, way in keys)
        while True:
            if self.take("LIMIT"):
                limit = self.expression()
                if self.take(","):
                    offset, limit = limit, self.expression()
            elif self.take("OFFSET"):
                offset = self.expression()
                self.take("ROWS") or self.take("ROW")
            elif self.take("FETCH"):
                self.take("FIRST") or self.take("NEXT")
                limit = "1" if self.at("ROW") or self.at("ROWS") else self.expression()
                self.take("ROWS") or self.take("ROW")
                ties = self.take("WITH", "TIES")
                if not ties:
                    self.need("ONLY")
            elif self.take("FOR"):
                self.name()
                while self.peek().kind == "word" and not self.at(")"):
                    self.i += 1
            else:
                break
        if ties:
            self.single, self.parts = single, parts
            return self.tied(body, keys, limit, offset)
        if limit is not None:
            out += f" LIMIT {limit}"
        if offset is not None:
            out += f" OFFSET {offset}"
        return body + out

    def clause(self, word: str) -> int | None:
        """Where a clause of the select that begins here stands, if it has one."""
        depth, k = 0, self.i
        while (t := self.t[k]).kind != "end":
            if t.kind == "op":
                depth += (t.value == "(") - (t.value == ")")
            if depth < 0 or depth == 0 and (t.upper in ("UNION", "INTERSECT", "EXCEPT", "ORDER", "LIMIT", "FETCH", "RETURNING") or t.kind == "op" and t.value == ";"):
                return None
            if depth == 0 and t.upper == word:
                return k
            k += 1
        return None

    def filter(self) -> str:
        before, self.plain = self.plain, True
        out = self.expression()
        self.plain = before
        return out

    def select(self) -> str:
        """The FROM and WINDOW clauses are read first, as what stands before them depends on them."""
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        before = self.plain, self.per_row, self.windows
        self.plain, self.windows = False, dict(self.windows)
        begin, sources, after, own = self.i, "", None, len(self.sources)
        if (at := self.clause("FROM")) is not None:
            self.i = at + 1
            sources, after = self.tables(), self.i
            self.sources.append(sources)
        self.per_row = after is not None
        if (at := self.clause("WINDOW")) is not None:
            self.i = at + 1

            def window() -> None:
                n = self.name().lower()
                self.need("AS")
                self.windows[n] = self.window_spec()

            self.listed(window)
        window_end, self.i = self.i, begin
        self.parts = []
        found: list[tuple[str, str | None]] = []
        self.listed(lambda: found.append(self.item()))
        items = ", ".join(f"{x} AS {quote(n)}" if n else x for x, n in found)
        out = "SELECT " + "DISTINCT " * distinct + items
        self.per_row = False
        if after is not None:
            self.i = after
            out += " FROM " + sources
        if self.take("WHERE"):
            out += " WHERE " + self.filter()
        if self.take("GROUP", "BY"):
            out += " GROUP BY " + ", ".join(self.listed(self.group))
        if self.take("HAVING"):
            out += " HAVING " + self.filter()
        if self.at("WINDOW"):
            self.i = window_end
        del self.sources[own:]
        self.plain, self.per_row, self.windows = before
        self.parts, self.single = found, not distinct
        return out

    def group(self) -> str:
        for words in (("GROUPING", "SETS"), ("ROLLUP",), ("CUBE",)):
            if self.take(*words):
                self.need("(")

                def member() -> str:
                    if self.take("("):
                        inner = [] if self.at(")") else self.listed(self.expression)
                        self.need(")")
                        return f"({', '.join(inner)})"
                    return self.expression()

                inner = self.listed(member)
                self.need(")")
                return f"{' '.join(words)} ({', '.join(inner)})"
        return self.expression()

    def item(self) -> tuple[str, str | None]:
        """An expression of a select list, and its name if it has one."""
        if self.take("*"):
            return "*", None
        if self.peek().kind in ("word", "name") and self.peek(1).value == "." and self.peek(2).value == "*" and self.peek(2).kind == "op":
            n = self.name()
            self.i += 2
            return f"{quote(n)}.*", None
        x = self.expression()
        if self.take("AS") or self.peek().kind == "name" or self.peek().kind == "word" and self.peek().upper not in _STOP:
            return x, self.name()
        return x, None

    def alias(self) -> str:
        self.take("AS")
        if self.peek().kind == "name" or self.peek().kind == "word" and self.peek().upper not in _STOP:
            out = " AS " + quote(self.name())
            if self.at("("):
                out += f"({', '.join(quote(c) for c in self.columns())})"
            return out
        return ""

    def table(self) -> str:
        lateral = "LATERAL " if self.take("LATERAL") else ""
        if self.take("("):
            if self.at("SELECT") or self.at("WITH") or self.at("VALUES") or self.at("("):
                inner = self.query()
            else:
                inner = "SELECT * FROM " + self.tables()
            self.need(")")
            return f"{lateral}({inner}){self.alias()}"
        n = self.dotted()
        known = quote(n) if n.lower() in self.ctes[-1] else self.names(n)
        alias = self.alias()
        return known + (alias or (f" AS {quote(n.rsplit('.', 1)[-1])}" if known != quote(n) else ""))

    def tables(self) -> str:
        out = self.table()
        while True:
            if self.take(","):
                out += ", " + self.table()
                continue
            words = []
            k = self.i
            for w in ("NATURAL", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER"):
                if self.take(w):
                    words.append(w)
            if not self.take("JOIN"):
                self.i = k
                return out
            out += " " + " ".join([*words, "JOIN"]) + " " + self.table()
            if self.take("ON"):
                self.sources.append(out)
                out += " ON " + self.filter()
                self.sources.pop()
            elif self.take("USING"):
                out += f" USING ({', '.join(quote(c) for c in self.columns())})"

    # -------------------------------------------------------------- expressions

    def expression(self) -> str:
        out = self.conjunction()
        while self.take("OR"):
            out = f"({out} OR {self.conjunction()})"
        return out

    def conjunction(self) -> str:
        out = self.negation()
        while self.take("AND"):
            out = f"({out} AND {self.negation()})"
        return out

    def negation(self) -> str:
        if not self.take("NOT"):
            return self.predicate()
        before, self.plain = self.plain, False
        out = f"(NOT {self.negation()})"
        self.plain = before
        return out

    def subquery(self) -> str:
        self.need("(")
        out = self.query()
        self.need(")")
        return out

    def predicate(self) -> str:
        begin = self.i
        x = self.sum()
        if self.plain and (self.at("IS") or self.peek().kind == "op" and self.peek().value in ("=", "<>", "!=", "<=>")):
            self.plain, self.i = False, begin  # here null and false differ
            x = self.sum()
            self.plain = True
        while True:
            t = self.peek()
            if t.kind == "op" and t.value in ("=", "<>", "!=", "<", "<=", ">", ">=", "<=>"):
                self.i += 1
                op = "<>" if t.value == "!=" else t.value
                if self.at("ANY") or self.at("SOME") or self.at("ALL"):
                    x = self.quantified(x, op, self.name().upper() == "ALL")
                else:
                    x = f"({x} {op} {self.sum()})"
                continue
            if self.take("IS"):
                no = "NOT " if self.take("NOT") else ""
                if self.take("NULL"):
                    x = f"({x} IS {no}NULL)"
                else:
                    x = f"({x} IS {no}{self.name().upper()})"
                continue
            k = self.i
            no = "NOT " if self.take("NOT") else ""
            if self.take("BETWEEN"):
                a = self.sum()
                self.need("AND")
                x = f"({no}({x} BETWEEN {a} AND {self.sum()}))"
            elif self.take("IN"):
                if self.peek(1).upper in ("SELECT", "WITH", "VALUES") and self.at("("):
                    if self.plain or x in self.rows:
                        x = f"({x} {no}IN ({self.subquery()}))"
                    else:
                        x = f"({no}{self.among(x, self.subquery())})"
                else:
                    self.need("(")
                    x = f"({x} {no}IN ({', '.join(self.listed(self.expression))}))"
                    self.need(")")
            elif self.at("LIKE") or self.at("ILIKE"):
                word = self.name().upper()
                p = self.sum()
                e = f" ESCAPE {self.sum()}" if self.take("ESCAPE") else ""
                x = f"({x} {no}{word} {p}{e})"
            elif self.take("REGEXP") or self.take("RLIKE"):
                x = f"({no}({x} RLIKE {self.sum()}))"
            elif self.take("SIMILAR", "TO"):
                from ...functions.dialect import similar_pattern

                if self.peek().kind != "text":
                    self.fail("SIMILAR TO takes a text literal")
                p = self.peek().value
                self.i += 1
                e = "\\"
                if self.take("ESCAPE"):
                    e = self.peek().value
                    self.i += 1
                x = f"({no}({x} RLIKE {text(similar_pattern(p, e))}))"
            else:
                self.i = k
                return x

    def quantified(self, x: str, op: str, every: bool) -> str:
        """ANY and ALL by the extremes, count and nulls of the subquery: uncorrelated parts run once."""
        inner = self.subquery()
        if (op, every) in (("=", False), ("<>", True)):
            return f"(NOT {self.among(x, inner)})" if every else self.among(x, inner)
        q = f"({inner}) AS q(v)"
        one = lambda e: f"(SELECT {e} FROM {q})"
        if op == "=":
            hit = f"({x} = {one('min(v)')} AND {x} = {one('max(v)')})"
        elif op == "<>":
            hit = f"({x} <> {one('min(v)')} OR {x} <> {one('max(v)')})"
        else:
            hit = f"({x} {op} {one('min(v)' if (op[0] == '<') == every else 'max(v)')})"
        # in three-valued logic: a null among the values leaves open what the others do not decide
        if every:
            return f"({one('count(*)')} = 0 OR ({hit} AND ({one('count(*) - count(v)')} = 0 OR NULL)))"
        return f"({one('count(*)')} > 0 AND ({hit} OR ({one('count(*) - count(v)')} > 0 AND NULL)))"

    @staticmethod
    def among(x: str, inner: str) -> str:
        """x IN (subquery) as a three-valued value: null if x or one of the values is and no value is equal; false for no values."""
        q = f"({inner}) AS q(v)"
        hit = f"({x} IN (SELECT v FROM {q} WHERE v IS NOT NULL))"
        return f"((SELECT count(*) FROM {q}) > 0 AND ({hit} OR ({x} IS NULL AND NULL) OR ((SELECT count(*) - count(v) FROM {q}) > 0 AND NULL)))"

    def sum(self) -> str:
        x = self.product()
        while True:
            if self.take("||"):
                x = f"concat(CAST({x} AS STRING), CAST({self.product()} AS STRING))"
            elif self.at("+") or self.at("-"):
                op = self.peek().value
                self.i += 1
                y = self.product()
                x = f"({x} {op} {y})" if not y.startswith("INTERVAL ") else self.shifted(x, op, y)
            else:
                return x

    def kind(self, x: str) -> str | None:
        """The Spark type of an expression where it stands, if it can be told."""
        if x.isdigit():
            return "int"
        return self.kinds(x, self.sources, self.head) if self.kinds else None

    def shifted(self, x: str, op: str, interval: str) -> str:
        """A date stays a date, and text that is a date or a timestamp is read as one and becomes text again."""
        kind = self.kind(x)
        if kind == "date":
            return f"CAST({x} {op} {interval} AS DATE)"
        if kind == "string":
            day = f"CAST(CAST(try_cast({{0}} AS DATE) {op} {interval} AS DATE) AS STRING)"
            return bound(f"(CASE WHEN length(trim({{0}})) <= 10 THEN {day} ELSE date_format(try_cast({{0}} AS TIMESTAMP_NTZ) {op} {interval}, 'yyyy-MM-dd HH:mm:ss') END)", x)
        return f"({x} {op} {interval})"

    def divided(self, x: str, y: str) -> str:
        a, b = self.kind(x), self.kind(y)
        if a in _INTS and b in _INTS:
            return f"({x} DIV nullif({y}, 0))"
        if a and b:
            return f"try_divide({x}, {y})"
        return bound(f"(CASE WHEN typeof({{0}}) IN {_INT} AND typeof({{1}}) IN {_INT} THEN CAST(CAST({{0}} AS DOUBLE) / nullif(CAST({{1}} AS DOUBLE), 0) AS BIGINT) ELSE try_divide({{0}}, {{1}}) END)", x, y)

    def remainder(self, x: str, y: str) -> str:
        """Whole numbers: the dividend's sign; others: floored."""
        a, b = self.kind(x), self.kind(y)
        if a in _INTS and b in _INTS or not (a and b):
            return f"({x} % nullif({y}, 0))"
        return bound("({0} - floor({0} / nullif({1}, 0)) * {1})", x, y)

    def product(self) -> str:
        x = self.unary()
        while self.at("*") or self.at("/") or self.at("%"):
            op = self.peek().value
            self.i += 1
            y = self.unary()
            if op == "*":
                x = f"({x} * {y})"
            else:
                x = self.divided(x, y) if op == "/" else self.remainder(x, y)
        return x

    def unary(self) -> str:
        if self.take("-"):
            return f"(-{self.unary()})"
        self.take("+")
        x = self.primary()
        while self.take("::"):
            x = self.converted(x, self.type_name())
        return x

    def type_name(self) -> str:
        word = self.name().upper()
        kind = _TYPES.get(word)
        if kind is None:
            raise SqlError(f"unknown type {word}")
        self.take("PRECISION")
        if self.take("("):
            args = self.listed(lambda: self.primary())
            self.need(")")
            if kind == "DECIMAL":
                return f"DECIMAL({', '.join(args)})"
        return "DECIMAL(38, 6)" if kind == "DECIMAL" else kind

    def converted(self, x: str, kind: str) -> str:
        return self.cast(x, kind, self.kind(x))

    @staticmethod
    def cast(x: str, kind: str, given: str | None = None) -> str:
        """Lenient: leading digits of text, the nearest number where one is out of range, null where nothing fits. given: x's Spark type."""
        if kind in ("INT", "BIGINT"):
            low, high = ("-2147483648", "2147483647") if kind == "INT" else ("-9223372036854775808L", "9223372036854775807L")
            digits = f"regexp_extract(CAST({{0}} AS STRING), '^\\\\s*([+-]?[0-9]+)', 1)"
            # text of any length: read wide, then cut to the type
            d = f"try_cast({digits} AS DECIMAL(38, 0))"
            number = f"(CASE WHEN {d} >= {high} THEN {high} WHEN {d} <= {low} THEN {low} WHEN {d} IS NOT NULL THEN CAST({d} AS {kind}) WHEN length({digits}) > 38 THEN if(startswith({digits}, '-'), {low}, {high}) ELSE 0 END)"
            wide = f"(CASE WHEN {{0}} >= {high} THEN {high} WHEN {{0}} <= {low} THEN {low} ELSE try_cast({{0}} AS {kind}) END)"
            if given == "string":
                return bound(f"(CASE WHEN {{0}} IS NOT NULL THEN {number} END)", x)
            if given in _INTS or given in ("float", "double") or (given or "").startswith("decimal"):
                return bound(wide, x)
            if given:
                return f"try_cast({x} AS {kind})"
            return bound(f"(CASE WHEN {{0}} IS NULL THEN NULL WHEN typeof({{0}}) = 'string' THEN {number} ELSE try_cast({{0}} AS {kind}) END)", x)
        if kind == "DOUBLE":
            return bound("(CASE WHEN typeof({0}) = 'string' THEN try_cast(regexp_extract(CAST({0} AS STRING), '^\\\\s*([+-]?[0-9]*[.]?[0-9]+)', 1) AS DOUBLE) ELSE try_cast({0} AS DOUBLE) END)", x)
        return f"try_cast({x} AS {kind})"

    def primary(self) -> str:
        t = self.peek()
        if t.kind == "number":
            self.i += 1
            return t.value if not any(c in t.value for c in ".eE") else f"{t.value}D" if "e" not in t.value.lower() else t.value
        if t.kind == "text":
            self.i += 1
            return text(t.value)
        if self.take("("):
            if self.at("SELECT") or self.at("WITH"):
                out = self.query()
                self.need(")")
                return f"({out})"
            listed = self.listed(self.expression)
            self.need(")")
            out = f"({', '.join(listed)})"
            if len(listed) > 1:
                self.rows.add(out)
            return out
        if t.kind == "name":
            return self.reference()
        if t.kind != "word":
            self.fail("expected an expression")
        word = t.upper
        if word.startswith("@"):
            self.i += 1
            return literal(self.variables.get(t.value.lower()))
        if word in ("NULL", "TRUE", "FALSE"):
            self.i += 1
            return word
        if word in ("DATE", "TIMESTAMP", "TIME", "JSON") and self.peek(1).kind == "text":
            self.i += 2
            value = text(self.t[self.i - 1].value)
            return value if word in ("TIME", "JSON") else f"{'TIMESTAMP_NTZ' if word == 'TIMESTAMP' else word} {value}"
        if word == "INTERVAL":
            self.i += 1
            value = self.peek().value
            self.i += 1
            unit = self.name().upper().rstrip("S")
            return f"INTERVAL '{value}' {unit}"
        if word == "CASE":
            before, self.plain = self.plain, False
            out = self.case()
            self.plain = before
            return out
        if word == "CAST":
            self.i += 1
            self.need("(")
            x = self.expression()
            self.need("AS")
            kind = self.type_name()
            self.need(")")
            return self.converted(x, kind)
        if word == "EXISTS" and self.peek(1).value == "(":
            self.i += 1
            return f"EXISTS ({self.subquery()})"
        if word == "EXTRACT":
            self.i += 1
            self.need("(")
            field = self.name()
            self.need("FROM")
            x = self.expression()
            self.need(")")
            return f"CAST(extract({field} FROM {x}) AS INT)"
        if word == "NEXTVAL":
            self.i += 1
            self.need("FOR")
            return self.sequence(self.dotted(), self.per_row)
        if word == "CURRENT_TIMESTAMP":
            self.i += 1
            if self.take("("):
                self.need(")")
            return "localtimestamp()"
        if self.peek(1).kind == "op" and self.peek(1).value == "(":
            before, self.plain = self.plain, False
            out = self.call()
            self.plain = before
            return out
        return self.reference()

    def reference(self) -> str:
        out = [self.name()]
        while self.at(".") and self.peek(1).kind in ("word", "name"):
            self.i += 1
            out.append(self.name())
        if len(out) == 1 and out[0].lower() in self.texts:
            return self.texts[out[0].lower()]
        if len(out) == 1 and out[0].lower() in self.locals:
            return literal(self.locals[out[0].lower()])
        return ".".join(quote(x) for x in out)

    def case(self) -> str:
        self.need("CASE")
        subject = None if self.at("WHEN") else self.expression()
        out = "CASE"
        while self.take("WHEN"):
            test = self.expression()
            self.need("THEN")
            out += f" WHEN {test if subject is None else f'{subject} <=> {test}'} THEN {self.expression()}"
        if self.take("ELSE"):
            out += f" ELSE {self.expression()}"
        self.need("END")
        return f"({out} END)"

    def window_spec(self) -> str:
        self.need("(")
        parts = []
        if self.peek().kind in ("word", "name") and self.peek().upper not in ("PARTITION", "ORDER", "ROWS", "RANGE"):
            parts.append(self.named_window()[1:-1])
        if self.take("PARTITION", "BY"):
            parts.append("PARTITION BY " + ", ".join(self.listed(self.expression)))
        ordered = self.take("ORDER", "BY")
        if ordered:
            def key() -> str:  # in windows null is the greatest value
                x = self.expression()
                if self.take("DESC"):
                    return f"{x} DESC NULLS FIRST"
                self.take("ASC")
                return f"{x} ASC NULLS LAST"

            parts.append("ORDER BY " + ", ".join(self.listed(key)))
        if self.at("ROWS") or self.at("RANGE"):
            kind = self.name().upper()
            if self.take("BETWEEN"):
                a = self.bound()
                self.need("AND")
                parts.append(f"{kind} BETWEEN {a} AND {self.bound()}")
            else:
                parts.append(f"{kind} {self.bound()}")
        self.need(")")
        return f"({' '.join(parts)})"

    def named_window(self) -> str:
        name = self.name()
        if name.lower() not in self.windows:
            self.fail(f"unknown window {name}")
        return self.windows[name.lower()]

    def bound(self) -> str:
        if self.take("UNBOUNDED"):
            return "UNBOUNDED " + self.name().upper()
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW"
        return f"{self.sum()} {self.name().upper()}"

    def call(self) -> str:
        word = self.name()
        name = word.upper()
        self.need("(")
        distinct = self.take("DISTINCT")
        args: list[str] = []
        if self.take("*"):
            args = ["*"]
        elif not self.at(")"):
            args = self.listed(self.expression)
        inner_order = self.order_keys() if self.take("ORDER", "BY") else None
        self.need(")")
        within = inner_order
        if self.take("WITHIN", "GROUP"):
            self.need("(")
            self.need("ORDER", "BY")
            within = self.order_keys()
            self.need(")")
        joined = None  # how values that are gathered and sorted become one text
        if name in ("STRING_AGG", "GROUP_CONCAT", "LISTAGG") and distinct and within and re.fullmatch(r"( ASC| DESC)?( NULLS (FIRST|LAST))?", within.removeprefix(args[0])):
            out, down = f"collect_set({args[0]})", " DESC" in within.removeprefix(args[0])  # in the values' own order, not their texts'
            joined = lambda x: f"CASE WHEN size({x}) > 0 THEN array_join(transform(sort_array({x}, {not down}), v -> CAST(v AS STRING)), {args[1] if len(args) > 1 else text(',')}) END"
        elif name in ("STRING_AGG", "GROUP_CONCAT", "LISTAGG"):
            out = f"listagg({'DISTINCT ' * distinct}CAST({args[0]} AS STRING), {args[1] if len(args) > 1 else text(',')})" + (f" WITHIN GROUP (ORDER BY {within})" if within else "")
        elif name in ("PERCENTILE_CONT", "PERCENTILE_DISC"):
            out = f"{name.lower()}({args[0]}) WITHIN GROUP (ORDER BY {within.replace(' NULLS LAST', '')})"
        elif name in self.functions:
            out = self.functions[name](self, *args)
        elif name in FUNCTIONS and not distinct:
            try:
                out = FUNCTIONS[name](*args)
            except TypeError:
                raise SqlError(f"wrong number of arguments for {name}") from None
        else:
            out = f"{name.lower()}({'DISTINCT ' * distinct}{', '.join(args)})"
        if self.take("FILTER"):
            self.need("(")
            self.need("WHERE")
            out += f" FILTER (WHERE {self.expression()})"
            self.need(")")
        nulls = ""
        if self.at("IGNORE", "NULLS") or self.at("RESPECT", "NULLS"):
            nulls = f" {self.name().upper()} NULLS"
            self.i += 1
        if self.take("OVER"):
            spec = self.window_spec() if self.at("(") else self.named_window()
            if name in ("SUM", "AVG", "MIN", "MAX", "COUNT", "FIRST_VALUE", "LAST_VALUE", "NTH_VALUE") and "ORDER BY" in spec and " ROWS " not in spec and " RANGE " not in spec:
                spec = spec[:-1] + " ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            out += f"{nulls} OVER {spec}"
        return joined(out) if joined else out


def literal(v) -> str:
    """A Python value as a Spark SQL literal."""
    import datetime
    import decimal

    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, int):
        return str(v) if abs(v) < 1 << 31 else f"{v}L"
    if isinstance(v, float):
        return f"CAST('{v!r}' AS DOUBLE)"
    if isinstance(v, decimal.Decimal):
        return f"{v}BD"
    if isinstance(v, datetime.datetime):
        return f"TIMESTAMP_NTZ '{v}'"
    if isinstance(v, datetime.date):
        return f"DATE '{v}'"
    return text(str(v))


def translate(sql: str, **how) -> str:
    """One query of the dialect as Spark SQL."""
    t = Translator(sql, **how)
    out = t.query()
    t.take(";")
    if t.peek().kind != "end":
        t.fail("unexpected text after the query")
    return out
