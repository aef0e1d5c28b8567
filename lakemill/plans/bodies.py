"""Function bodies as expressions: DECLARE, SET, IF, CASE, loops and RETURN compiled to Spark SQL, so no row leaves the JVM.

A body's variables are the fields of a struct. A statement turns one struct into the next, bound by ``transform`` over an array of
one, so the text grows with the statements and not with their nesting in each other's operands. A loop is an ``aggregate`` over
LIMIT rounds that stand still once its test fails or it is left; one that has not ended by then is an error.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from .sql.lexer import SqlError, Token
from .sql.translate import Translator, quote, text

LIMIT = 10_000
_SQL_TYPE = {"DECIMAL": "DECIMAL(38, 6)"}


class Body:
    def __init__(self, nodes: list, params: list[tuple[str, str]], kind: str, parser: Callable[[list[Token]], Translator]) -> None:
        self.nodes, self.params, self.kind, self.parser = nodes, params, kind, parser
        self.types = dict(params)
        self.fresh = itertools.count()
        self.declared(nodes)

    def declared(self, nodes: list) -> None:
        for node in nodes:
            if node[0] == "declare":
                self.types |= dict.fromkeys(node[1], node[2])
            elif node[0] == "block":
                self.declared(node[2])
            elif node[0] == "loop":
                self.declared(node[3])
            elif node[0] == "if":
                for _, body in node[1]:
                    self.declared(body)
                self.declared(node[2])
            elif node[0] == "case":
                for _, body in node[2]:
                    self.declared(body)
                self.declared(node[3] or [])

    def name(self) -> str:
        return f"s{next(self.fresh)}"

    def value(self, tokens: list[Token], s: str, kind: str | None = None) -> str:
        """An expression over the variables of struct s."""
        p = self.parser(list(tokens))
        p.texts = {v: f"{s}.{quote(v)}" for v in self.types}
        p.sources = [f"(SELECT {', '.join(f'CAST(NULL AS {k}) AS {quote(v)}' for v, k in self.types.items())}) AS {s}"] if self.types else []
        out = p.expression()
        if p.peek().kind != "end":
            p.fail("unexpected text in an expression")
        return out if kind is None else f"CAST({Translator.cast(out, kind)} AS {kind})"

    def update(self, s: str, changes: dict[str, str]) -> str:
        fields = [*self.types, "ret", "done", "jump"]
        return "named_struct(" + ", ".join(f"{text(f)}, {changes.get(f, f'{s}.{quote(f)}')}" for f in fields) + ")"

    def steps(self, nodes: list, s: str) -> str:
        out = s
        for k, node in enumerate(nodes):
            v = self.name()
            after = self.step(node, v)
            out = f"transform(array({out}), {v} -> {f'CASE WHEN {v}.done OR {v}.jump IS NOT NULL THEN {v} ELSE {after} END' if k else after})[0]"
        return out

    def step(self, node, s: str) -> str:
        kind, *rest = node
        if kind == "declare":
            names, t, default = rest
            return self.update(s, {n: self.value(default, s, t) if default else f"CAST(NULL AS {t})" for n in names})
        if kind == "set":
            name, tokens = rest
            if name not in self.types:
                raise SqlError(f"unknown variable {name}", "name")
            return self.update(s, {name: self.value(tokens, s, self.types[name])})
        if kind == "return":
            return self.update(s, {"ret": self.value(rest[0], s, self.kind), "done": "true"})
        if kind == "block":
            return self.steps(rest[1], s)
        if kind in ("if", "case"):
            subject, arms, other = (None, *rest) if kind == "if" else rest
            left = f"{self.value(subject, s)} <=> " if subject else ""
            tests = " ".join(f"WHEN {left}{self.value(test, s)} THEN {self.steps(body, s)}" for test, body in arms)
            return f"CASE {tests} ELSE {self.steps(other or [], s)} END"
        if kind == "leave":
            label, again = rest
            return self.update(s, {"jump": text(("again " if again else "") + label)})
        if kind == "loop":
            return self.loop(*rest, s)
        raise SqlError(f"{kind} cannot stand in a function")

    def loop(self, label: str | None, test, body, until, s: str) -> str:
        """until ends a loop as a LEAVE of its own does."""
        own, a, b, c, d = label or self.name(), self.name(), self.name(), self.name(), self.name()
        again = f"CASE WHEN {b}.jump = {text('again ' + own)} THEN {self.update(b, {'jump': 'CAST(NULL AS STRING)'})} ELSE {b} END"
        round_ = f"transform(array({self.steps(body, a)}), {b} -> {again})[0]"
        if until:
            stop = f"CASE WHEN {c}.jump IS NULL AND {self.value(until, c)} THEN {self.update(c, {'jump': text(own)})} ELSE {c} END"
            round_ = f"transform(array({round_}), {c} -> {stop})[0]"
        going = f"NOT {a}.done AND {a}.jump IS NULL" + (f" AND coalesce({self.value(test, a)}, false)" if test else "")
        folded = f"aggregate(sequence(1, {LIMIT}), {s}, ({a}, {self.name()}) -> CASE WHEN {going} THEN {round_} ELSE {a} END)"
        still = f"NOT {d}.done AND {d}.jump IS NULL" + (f" AND coalesce({self.value(test, d)}, false)" if test else "")
        ended = self.update(d, {"jump": f"CASE WHEN {still} THEN raise_error('a loop did not end within {LIMIT} rounds') WHEN {d}.jump = {text(own)} THEN NULL ELSE {d}.jump END"})
        return f"transform(array({folded}), {d} -> {ended})[0]"

    def call(self, *args: str) -> str:
        if len(args) != len(self.params):
            raise SqlError(f"{len(self.params)} arguments expected, {len(args)} given")
        given = {n: f"CAST({Translator.cast(x, k)} AS {k})" for (n, k), x in zip(self.params, args, strict=True)}
        begin = {n: given.get(n, f"CAST(NULL AS {k})") for n, k in self.types.items()} | {"ret": f"CAST(NULL AS {self.kind})", "done": "false", "jump": "CAST(NULL AS STRING)"}
        first, last = self.name(), self.name()
        state = "named_struct(" + ", ".join(f"{text(n)}, {x}" for n, x in begin.items()) + ")"
        run = f"transform(array({state}), {first} -> {self.steps(self.nodes, first)})[0]"
        return f"transform(array({run}), {last} -> CASE WHEN {last}.done THEN {last}.ret ELSE raise_error('the function ended without RETURN') END)[0]"
