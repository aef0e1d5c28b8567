"""Stored procedures: a statement tree, interpreted on the driver; its SQL statements are plans like any others."""

from __future__ import annotations

from dataclasses import dataclass, field

from .sql.lexer import SqlError, Token
from .sql.translate import Translator, literal, quote

LIMIT = 1_000_000  # rounds of one loop; more is an error


class Leave(Exception):
    def __init__(self, label: str | None, again: bool = False) -> None:
        self.label, self.again = label, again


class Exit(Exception):
    """Ends the block whose EXIT or UNDO handler ran."""

    def __init__(self, scope: Scope) -> None:
        self.scope = scope


class Return(Exception):
    def __init__(self, value) -> None:
        self.value = value


class Condition(SqlError):
    def __init__(self, state: str, message: str) -> None:
        super().__init__(f"{message} (SQLSTATE {state})")
        self.state = state


@dataclass
class Procedure:
    name: str
    params: list[tuple[str, str, str]]  # mode, name, type
    body: list


@dataclass
class Scope:
    values: dict = field(default_factory=dict)
    types: dict = field(default_factory=dict)
    cursors: dict = field(default_factory=dict)
    handlers: list = field(default_factory=list)


class BodyParser:
    """Statements of a body as tuples; expressions and SQL stay token lists until they run."""

    def __init__(self, p: Translator) -> None:
        self.p = p

    def until(self, *stops: str) -> list[Token]:
        out, depth = [], 0
        while True:
            t = self.p.peek()
            if t.kind == "end" or depth == 0 and (t.upper in stops or t.kind == "op" and t.value == ";"):
                return [*out, Token("end", "", t.at)]
            depth += (t.value == "(" or t.upper == "CASE") - (t.value == ")" or t.upper == "END")
            out.append(t)
            self.p.i += 1

    def block(self, *stops: str) -> list:
        out = []
        while not any(self.p.at(s) for s in stops):
            if self.p.peek().kind == "end":
                self.p.fail("the body is not closed")
            out.append(self.statement())
            self.p.take(";")
        return out

    def labelled(self) -> str | None:
        if self.p.peek().kind == "word" and self.p.peek(1).value == ":":
            label = self.p.name().lower()
            self.p.need(":")
            return label
        return None

    def close(self, *words: str) -> None:
        self.p.need("END", *words)
        if self.p.peek().kind == "word" and self.p.peek(1).value == ";":
            self.p.i += 1  # a closing label

    def statement(self):
        p, label = self.p, self.labelled()
        if p.take("BEGIN"):
            body = self.block("END")
            self.close()
            return ("block", label, body)
        if p.take("IF"):
            arms, other = [], []
            test = self.until("THEN")
            p.need("THEN")
            arms.append((test, self.block("ELSEIF", "ELSE", "END")))
            while p.take("ELSEIF"):
                test = self.until("THEN")
                p.need("THEN")
                arms.append((test, self.block("ELSEIF", "ELSE", "END")))
            if p.take("ELSE"):
                other = self.block("END")
            self.close("IF")
            return ("if", arms, other)
        if p.take("CASE"):
            subject = None if p.at("WHEN") else self.until("WHEN")
            arms, other = [], None
            while p.take("WHEN"):
                test = self.until("THEN")
                p.need("THEN")
                arms.append((test, self.block("WHEN", "ELSE", "END")))
            if p.take("ELSE"):
                other = self.block("END")
            self.close("CASE")
            return ("case", subject, arms, other)
        if p.take("WHILE"):
            test = self.until("DO")
            p.need("DO")
            body = self.block("END")
            self.close("WHILE")
            return ("loop", label, test, body, None)
        if p.take("LOOP"):
            body = self.block("END")
            self.close("LOOP")
            return ("loop", label, None, body, None)
        if p.take("REPEAT"):
            body = self.block("UNTIL")
            p.need("UNTIL")
            test = self.until("END")
            self.close("REPEAT")
            return ("loop", label, None, body, test)
        if p.take("LEAVE"):
            return ("leave", p.name().lower(), False)
        if p.take("ITERATE"):
            return ("leave", p.name().lower(), True)
        if p.take("RETURN"):
            return ("return", self.until())
        if p.take("DECLARE"):
            return self.declare()
        if p.take("SET"):
            name = p.name()
            p.need("=")
            return ("set", name.lower(), self.until())
        if p.take("OPEN"):
            return ("open", p.name().lower())
        if p.take("CLOSE"):
            return ("close", p.name().lower())
        if p.take("FETCH"):
            p.take("FROM")
            name = p.name().lower()
            p.need("INTO")
            return ("fetch", name, [x.lower() for x in p.listed(p.name)])
        if p.take("SIGNAL"):
            p.take("SQLSTATE")
            state, message = p.peek().value, []
            p.i += 1
            if p.take("SET", "MESSAGE_TEXT"):
                p.need("=")
                message = self.until()
            return ("signal", state, message)
        return ("sql", self.until())

    def declare(self):
        p = self.p
        for kind in ("CONTINUE", "EXIT", "UNDO"):
            if p.take(kind):
                p.need("HANDLER")
                p.need("FOR")
                if p.take("NOT", "FOUND"):
                    what = "NOT FOUND"
                elif p.take("SQLSTATE"):
                    what = p.peek().value
                    p.i += 1
                else:
                    what = p.name().upper()
                return ("handler", kind, what, self.statement())
        names = p.listed(p.name)
        if p.take("CURSOR"):
            p.need("FOR")
            return ("cursor", names[0].lower(), self.until())
        kind = p.type_name()
        return ("declare", [x.lower() for x in names], kind, self.until() if p.take("DEFAULT") else None)


class Run:
    """One call. Scopes nest; the innermost name wins."""

    def __init__(self, engine) -> None:
        self.engine, self.scopes = engine, []

    def values(self) -> dict:
        return {k: v for s in self.scopes for k, v in s.values.items()}

    def value(self, tokens: list[Token]):
        p = self.engine.parser(list(tokens))
        p.locals = self.values()
        return self.engine.spark.sql(f"SELECT {p.expression()} AS v").first()["v"]

    def cast(self, kind: str, v):
        return self.engine.spark.sql(f"SELECT {Translator.cast(literal(v), kind)} AS v").first()["v"]

    def assign(self, name: str, v) -> None:
        for s in reversed(self.scopes):
            if name in s.values:
                s.values[name] = self.cast(s.types[name], v)
                return
        if not name.startswith("@"):
            raise SqlError(f"unknown variable {name}")
        self.engine.variables[name] = v

    def block(self, body: list, scope: Scope) -> None:
        before = self.engine.state.copy()
        self.scopes.append(scope)
        depth = len(self.scopes)
        try:
            for node in body:
                try:
                    self.step(node)
                except SqlError as e:
                    self.handle(e, before)
        except Exit as e:
            if e.scope is not scope:
                raise
        finally:
            del self.scopes[depth - 1 :]

    def handle(self, e: SqlError, before) -> None:
        """The most specific handler, the inner block's first: then continue, leave its block, or undo it and leave."""
        state = getattr(e, "state", "45000")
        for scope in reversed(self.scopes):
            for wanted in (state, "NOT FOUND" if state == "02000" else "SQLEXCEPTION"):
                for kind, what, node in reversed(scope.handlers):
                    if what == wanted:
                        if kind == "UNDO":
                            self.engine.state = before.copy()
                        self.step(node)
                        if kind != "CONTINUE":
                            raise Exit(scope)
                        return
        if state != "02000":
            raise e

    def step(self, node) -> None:
        kind, *rest = node
        getattr(self, "do_" + kind)(*rest)

    def run(self, body: list) -> None:
        for node in body:
            try:
                self.step(node)
            except SqlError as e:
                self.handle(e, self.engine.state)

    def do_block(self, label, body):
        try:
            self.block(body, Scope())
        except Leave as e:
            if e.label != label or e.again:
                raise

    def do_if(self, arms, other):
        for test, body in arms:
            if self.value(test):
                return self.run(body)
        self.run(other)

    def do_case(self, subject, arms, other):
        for test, body in arms:
            hit = self.value(test) if subject is None else self.value([Token("op", "(", 0), *subject[:-1], Token("op", ")", 0), Token("op", "<=>", 0), *test])
            if hit:
                return self.run(body)
        if other is None:
            raise Condition("20000", "no CASE arm applies")
        self.run(other)

    def do_loop(self, label, test, body, until):
        for _ in range(LIMIT):
            if test is not None and not self.value(test):
                return
            try:
                self.run(body)
            except Leave as e:
                if e.label != label:
                    raise
                if not e.again:
                    return
            if until is not None and self.value(until):
                return
        raise SqlError(f"a loop did not end within {LIMIT} rounds")

    def do_leave(self, label, again):
        raise Leave(label, again)

    def do_return(self, tokens):
        raise Return(self.value(tokens))

    def do_declare(self, names, kind, default):
        for n in names:
            self.scopes[-1].types[n] = kind
            self.scopes[-1].values[n] = self.cast(kind, self.value(default)) if default else None

    def do_set(self, name, tokens):
        self.assign(name, self.value(tokens))

    def do_handler(self, kind, what, node):
        self.scopes[-1].handlers.append((kind, what, node))

    def do_cursor(self, name, tokens):
        self.scopes[-1].cursors[name] = [tokens, None]

    def cursor(self, name):
        for s in reversed(self.scopes):
            if name in s.cursors:
                return s.cursors[name]
        raise SqlError(f"unknown cursor {name}")

    def do_open(self, name):
        c = self.cursor(name)
        p = self.engine.parser(list(c[0]))
        p.locals = self.values()
        c[1] = self.engine.spark.sql(p.query()).toLocalIterator()

    def do_fetch(self, name, into):
        c = self.cursor(name)
        if c[1] is None:
            raise SqlError(f"cursor {name} is not open")
        row = next(c[1], None)
        for k, n in enumerate(into):
            self.assign(n, None if row is None else row[k])
        if row is None:
            raise Condition("02000", "no more rows")

    def do_close(self, name):
        self.cursor(name)[1] = None

    def do_signal(self, state, message):
        raise Condition(state, str(self.value(message)) if message else "signal")

    def do_sql(self, tokens):
        p = self.engine.parser(list(tokens))
        p.locals = self.values()
        self.engine.execute(p, "")


def call(engine, procedure: Procedure, arguments: list[list[Token]]):
    """Runs a procedure; OUT and INOUT arguments must be session variables. Returns one row of them."""
    if len(arguments) != len(procedure.params):
        raise SqlError(f"{procedure.name} takes {len(procedure.params)} arguments")
    run, scope = Run(engine), Scope()
    for (mode, name, kind), tokens in zip(procedure.params, arguments, strict=True):
        if mode != "IN" and not tokens[0].value.startswith("@"):
            raise SqlError(f"{name} is {mode}: its argument must be a session variable")
        scope.types[name] = kind
        scope.values[name] = None if mode == "OUT" else run.cast(kind, run.value(tokens))
    try:
        run.block(procedure.body, scope)
    except Return:
        pass
    out = {}
    for (mode, name, _), tokens in zip(procedure.params, arguments, strict=True):
        if mode != "IN":
            engine.variables[tokens[0].value.lower()] = out[name] = scope.values[name]
    if not out:
        return engine.note(f"CALL {procedure.name}")
    return engine.spark.sql("SELECT " + ", ".join(f"{literal(v)} AS {quote(k)}" for k, v in out.items()))
