"""python -m lakemill [FOLDER] [-f SCRIPT | -e SQL] [--load PATH]: runs statements over the Parquet tables of a folder.

Without -f or -e it reads statements from the input. Lines that begin with a backslash ask about a query instead of running it:
\\tokens, \\ast (the query as Spark SQL), \\plan (logical), \\optimized, \\physical; ``.read FILE`` runs a script, ``.save PATH`` and
``.load PATH`` write and read the catalog, ``.quit`` ends.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from .plans.engine import Engine, SqlError
from .plans.sql.lexer import tokenize
from .sources.tables import grid, statements


class Shell:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def meta(self, line: str) -> str:
        word, _, rest = line.partition(" ")
        rest = rest.strip().rstrip(";")
        if word == "\\tokens":
            return "\n".join(f"{t.kind} {t.value}" for t in tokenize(rest)[:-1])
        sql = self.engine.parser(tokenize(rest)).query()
        if word == "\\ast":
            return sql
        execution = self.engine.spark.sql(sql)._jdf.queryExecution()
        plans = {"\\plan": execution.logical, "\\optimized": execution.optimizedPlan, "\\physical": execution.executedPlan}
        if word not in plans:
            raise SqlError(f"unknown command {word}", "syntax")
        return plans[word]().toString().rstrip()

    def run(self, text: str) -> Iterator[str]:
        """Results of a script whose lines may be commands."""
        pending: list[str] = []
        for line in [*text.splitlines(), None]:
            command = line is not None and not "".join(pending).strip() and line.strip().startswith(("\\", "."))
            if line is None or command:
                for statement in statements("\n".join(pending)):
                    yield self.one(lambda s=statement: grid(self.engine.sql(s)))
                pending = []
            if command:
                word, _, rest = line.strip().partition(" ")
                if word == ".quit":
                    return
                if word == ".read":
                    yield from self.run(Path(rest.strip()).read_text())
                elif word in (".save", ".load"):
                    yield self.one(lambda w=word, r=rest.strip(): self.kept(w, r))
                else:
                    yield self.one(lambda x=line.strip(): self.meta(x))
            elif line is not None:
                pending.append(line)
                if line.rstrip().endswith(";") and len(found := list(statements("\n".join(pending)))) and not self.open("\n".join(pending)):
                    for statement in found:
                        yield self.one(lambda s=statement: grid(self.engine.sql(s)))
                    pending = []

    @staticmethod
    def open(text: str) -> bool:
        """Whether a body or a quoted text goes on: then a semicolon more makes no further statement."""
        return len(list(statements(text + "\n;SELECT 1"))) != len(list(statements(text))) + 1

    def kept(self, word: str, path: str) -> str:
        if word == ".save":
            self.engine.save(path)
        else:
            views = {k: v for k, v in self.engine.state.views.items() if v.base is None}
            before, self.engine = self.engine, Engine.load(self.engine.spark, path)
            self.engine.state.views = views | self.engine.state.views
            del before
        return f"{word} {path}"

    @staticmethod
    def one(run) -> str:
        try:
            return run()
        except SqlError as e:
            return f"ERROR [{e.kind}]: {e}"


def main(arguments: list[str] | None = None) -> None:
    options = argparse.ArgumentParser(prog="lakemill")
    options.add_argument("folder", nargs="?")
    options.add_argument("-f", "--file")
    options.add_argument("-e", "--execute")
    options.add_argument("--load")
    given = options.parse_args(arguments)
    spark = SparkSession.builder.appName("lakemill").getOrCreate()
    engine = Engine.load(spark, given.load) if given.load else Engine(spark)
    if given.folder:
        for path in sorted(Path(given.folder).glob("*.parquet")):
            engine.register(path.stem, spark.read.parquet(str(path)))
    text = given.execute or (Path(given.file).read_text() if given.file else sys.stdin.read())
    for out in Shell(engine).run(text):
        print(out, end="\n\n")


if __name__ == "__main__":
    main()
