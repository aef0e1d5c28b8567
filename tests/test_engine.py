"""Statements: DDL, DML, constraints, transactions, views, and the dialect's queries."""

import pytest

from lakemill.plans.engine import Engine, SqlError
from lakemill.plans.sql.translate import translate
from lakemill.sources.tables import grid, statements

from .support import DATA, duck, same

SF = f"{DATA}/sf0.001"


@pytest.fixture
def db(spark):
    engine = Engine(spark)
    engine.sql("CREATE TABLE emp (id INT PRIMARY KEY, name VARCHAR(10) NOT NULL, dept VARCHAR(10) DEFAULT 'ops', pay INT CHECK (pay > 0))")
    engine.sql("INSERT INTO emp VALUES (1, 'ann', 'dev', 10), (2, 'bob', 'dev', 20), (3, 'cid', NULL, 30), (4, 'dee', DEFAULT, NULL)")
    return engine


def rows(engine, sql):
    return sorted((tuple(r) for r in engine.sql(sql).collect()), key=repr)


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 7 / 2, 7 / 0, 7 % 0, -7 / 2", [(3, None, None, -3)]),
        ("SELECT id / 2, pay / 4.0 FROM emp WHERE id = 3", [(1, 7.5)]),
        ("SELECT CONCAT('a', NULL, 'b'), 'a' || NULL, GREATEST(1, NULL), LEAST(3, 2), IIF(NULL, 1, 2)", [("ab", None, None, 2, 2)]),
        ("SELECT CASE dept WHEN NULL THEN 'none' WHEN 'dev' THEN 'd' ELSE 'x' END FROM emp WHERE id IN (1, 3)", [("d",), ("none",)]),
        ("SELECT CAST('12abc' AS INT), CAST('x' AS INT), CAST('1.5z' AS DOUBLE), SQRT(-1), ROUND(2.5), TRUNC(-2.7)", [(12, 0, 1.5, None, 3, -2)]),
        ("SELECT SUBSTR('hello', 0, 2), LENGTH('中文'), INSTR('abc', 'c'), TRIM('  a ')", [("he", 6, 3, "a")]),
        ("SELECT id FROM emp WHERE pay > ANY (SELECT pay FROM emp WHERE dept = 'dev')", [(2,), (3,)]),
        ("SELECT id FROM emp WHERE pay >= ALL (SELECT pay FROM emp WHERE dept = 'dev')", [(2,), (3,)]),
        ("SELECT id FROM emp WHERE id < ALL (SELECT id FROM emp WHERE id > 99)", [(1,), (2,), (3,), (4,)]),
        ("SELECT name FROM emp WHERE name SIMILAR TO '(a|b)%' OR name ILIKE 'D_E'", [("ann",), ("bob",), ("dee",)]),
        ("SELECT id FROM emp ORDER BY pay DESC LIMIT 1, 2", [(1,), (2,)]),
        ("SELECT id FROM emp ORDER BY pay OFFSET 3 ROWS FETCH NEXT 1 ROWS ONLY", [(4,)]),
        ("SELECT dept, SUM(pay) FILTER (WHERE pay > 10) AS s FROM emp GROUP BY dept HAVING COUNT(*) > 1", [("dev", 20)]),
        ("SELECT STRING_AGG(name, '-') WITHIN GROUP (ORDER BY name) FROM emp WHERE dept = 'dev'", [("ann-bob",)]),
        ("SELECT id, SUM(pay) OVER (ORDER BY id) AS s FROM emp WHERE pay IS NOT NULL", [(1, 10), (2, 30), (3, 60)]),
        ("WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 4) SELECT i FROM n", [(1,), (2,), (3,), (4,)]),
        ("SELECT DATE '2024-01-31' + INTERVAL 1 MONTH, EXTRACT(YEAR FROM DATE '2024-05-06')", [(__import__("datetime").date(2024, 2, 29), 2024)]),
        ("SELECT e.id, m FROM emp e, LATERAL (SELECT MAX(pay) AS m FROM emp x WHERE x.id <= e.id) q WHERE e.id < 3", [(1, 10), (2, 20)]),
        ("SELECT id FROM emp WHERE id < 3 INTERSECT SELECT id FROM emp WHERE id > 1 UNION SELECT 9", [(2,), (9,)]),
        ("SELECT TYPEOF(id), TYPEOF(name), TYPEOF(pay) FROM emp WHERE id = 4", [("INTEGER", "VARCHAR", "NULL")]),
        ("SELECT v.a FROM (VALUES (1, 'x'), (2, 'y')) AS v(a, b) WHERE v.b = 'y' FOR UPDATE", [(2,)]),
        ("SELECT dept, COUNT(*) FROM emp GROUP BY ROLLUP (dept) HAVING COUNT(*) >= 2", [("dev", 2), (None, 4)]),
    ],
)
def test_queries(db, sql, want):
    assert rows(db, sql) == sorted(want, key=repr)


def test_dml_and_returning(db):
    assert rows(db, "UPDATE emp SET pay = pay + 1 WHERE dept = 'dev' RETURNING id, pay") == [(1, 11), (2, 21)]
    assert rows(db, "DELETE FROM emp WHERE id = 4 RETURNING name") == [("dee",)]
    assert rows(db, "INSERT INTO emp (id, name) VALUES (5, 'eve') RETURNING id, dept, pay") == [(5, "ops", None)]
    db.sql("UPDATE emp SET pay = s.p FROM (VALUES (1, 99), (7, 1)) AS s(k, p) WHERE emp.id = s.k")
    db.sql("INSERT INTO emp VALUES (2, 'bo', 'x', 5) ON DUPLICATE KEY UPDATE pay = VALUES(pay) + pay")
    db.sql("REPLACE INTO emp VALUES (3, 'new', 'y', 7)")
    db.sql("MERGE INTO emp e USING (VALUES (1, 'm'), (8, 'n')) AS s(k, n) ON e.id = s.k WHEN MATCHED THEN UPDATE SET name = s.n WHEN NOT MATCHED THEN INSERT (id, name, pay) VALUES (s.k, s.n, 3)")
    assert rows(db, "SELECT * FROM emp") == sorted([(1, "m", "dev", 99), (2, "bob", "dev", 26), (3, "new", "y", 7), (5, "eve", "ops", None), (8, "n", "ops", 3)], key=repr)
    db.sql("TRUNCATE TABLE emp")
    assert rows(db, "SELECT COUNT(*) FROM emp") == [(0,)]


@pytest.mark.parametrize("sql", ["INSERT INTO emp VALUES (1, 'dup', 'a', 1)", "INSERT INTO emp VALUES (9, NULL, 'a', 1)", "INSERT INTO emp VALUES (9, 'x', 'a', -1)", "UPDATE emp SET name = 'far too long a name'", "SELECT * FROM empp", "SELECT nope FROM emp", "SELEC 1", "INSERT INTO emp VALUES (1)"])
def test_errors_change_nothing(db, sql):
    before = rows(db, "SELECT * FROM emp")
    with pytest.raises(SqlError):
        db.sql(sql).collect()
    assert rows(db, "SELECT * FROM emp") == before


def test_foreign_keys(db):
    db.sql("CREATE TABLE task (id INT PRIMARY KEY, who INT REFERENCES emp(id) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.sql("CREATE TABLE note (id INT, who INT, FOREIGN KEY (who) REFERENCES emp(id) ON DELETE SET NULL)")
    db.sql("INSERT INTO task VALUES (1, 1), (2, 2)")
    db.sql("INSERT INTO note VALUES (1, 1), (2, NULL)")
    with pytest.raises(SqlError):
        db.sql("INSERT INTO task VALUES (3, 77)")
    db.sql("DELETE FROM emp WHERE id = 1")
    assert rows(db, "SELECT * FROM task") == [(2, 2)] and rows(db, "SELECT * FROM note") == [(1, None), (2, None)]
    db.sql("UPDATE emp SET id = 20 WHERE id = 2")
    assert rows(db, "SELECT * FROM task") == [(2, 20)]


def test_transactions(db):
    db.sql("BEGIN")
    db.sql("UPDATE emp SET pay = 1")
    db.sql("SAVEPOINT a")
    db.sql("DELETE FROM emp")
    db.sql("ROLLBACK TO SAVEPOINT a")
    assert rows(db, "SELECT DISTINCT pay FROM emp") == [(1,)]
    db.sql("ROLLBACK")
    assert rows(db, "SELECT pay FROM emp WHERE id = 2") == [(20,)]


def test_views_sequences_functions_and_meta(db):
    db.sql("CREATE VIEW dev AS SELECT id, name FROM emp WHERE dept = 'dev'")
    db.sql("CREATE MATERIALIZED VIEW tot AS SELECT COUNT(*) AS n FROM emp")
    db.sql("CREATE SEQUENCE s START WITH 5 INCREMENT BY 2")
    db.sql("CREATE FUNCTION twice(x INT) RETURNS INT BEGIN RETURN x * 2; END")
    db.sql("SET @k = 2")
    assert rows(db, "SELECT d.name FROM dev d JOIN emp e ON d.id = e.id WHERE e.id = @k") == [("bob",)]
    assert rows(db, "SELECT NEXTVAL FOR s, TWICE(id) FROM emp WHERE id = 3") == [(5, 6)]
    assert rows(db, "SELECT NEXTVAL FOR s") == [(7,)]
    db.sql("DELETE FROM emp WHERE id = 1")
    assert rows(db, "SELECT n FROM tot") == [(4,)]
    db.sql("ALTER MATERIALIZED VIEW tot REFRESH")
    assert rows(db, "SELECT n FROM tot") == [(3,)]
    db.sql("CREATE UNIQUE INDEX ix ON emp (name)")
    assert rows(db, "SHOW INDEX FROM emp") == [("ix", "name", True)]
    db.sql("ALTER TABLE emp ADD COLUMN age INT DEFAULT 7")
    db.sql("ALTER TABLE emp RENAME TO people")
    assert rows(db, "SELECT age FROM people WHERE id = 2") == [(7,)]
    assert [r[0] for r in db.sql("DESC people").collect()] == ["id", "name", "dept", "pay", "age"]
    assert "Physical Plan" in "\n".join(r[0] for r in db.sql("EXPLAIN ANALYZE SELECT * FROM people").collect())
    db.sql("CREATE TABLE auto (id INT AUTO_INCREMENT PRIMARY KEY, v TEXT)")
    db.sql("INSERT INTO auto (v) VALUES ('a'), ('b')")
    assert rows(db, "SELECT id, v FROM auto") == [(1, "a"), (2, "b")]


def test_procedures(db):
    db.sql("""CREATE PROCEDURE fill(IN n INT, OUT total INT) BEGIN
        DECLARE i INT DEFAULT 0;
        DECLARE done INT DEFAULT 0;
        DECLARE v INT;
        DECLARE c CURSOR FOR SELECT id FROM emp WHERE id > 10 ORDER BY id;
        DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1;
        SET total = 0;
        WHILE i < n DO
            SET i = i + 1;
            IF i = 2 THEN INSERT INTO emp (id, name) VALUES (20, 'two'); ELSE INSERT INTO emp (id, name) VALUES (i + 10, 'x'); END IF;
        END WHILE;
        OPEN c;
        again: LOOP
            FETCH c INTO v;
            IF done = 1 THEN LEAVE again; END IF;
            SET total = total + v;
        END LOOP;
        CLOSE c;
    END""")
    assert rows(db, "CALL fill(3, @t)") == [(11 + 13 + 20,)] and rows(db, "SELECT @t") == [(44,)]
    db.sql("CREATE PROCEDURE safe(OUT s INT) BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET s = -1; SET s = 0; INSERT INTO emp VALUES (1, 'dup', 'a', 1); SET s = 1; END")
    assert rows(db, "CALL safe(@s)") == [(-1,)]
    db.sql("CREATE PROCEDURE undo() BEGIN DECLARE UNDO HANDLER FOR SQLSTATE '45001' SET @u = 1; DELETE FROM emp; SIGNAL SQLSTATE '45001' SET MESSAGE_TEXT = 'no'; END")
    db.sql("CALL undo()")
    assert rows(db, "SELECT @u, COUNT(*) FROM emp") == [(1, 7)]


def test_triggers(db):
    db.sql("CREATE TRIGGER t1 BEFORE INSERT ON emp FOR EACH ROW SET NEW.name = UPPER(NEW.name), NEW.pay = COALESCE(NEW.pay, 1)")
    db.sql("CREATE TRIGGER t2 BEFORE UPDATE ON emp FOR EACH ROW BEGIN SET NEW.pay = GREATEST(NEW.pay, OLD.pay); END")
    db.sql("CREATE TRIGGER t3 AFTER DELETE ON emp FOR EACH STATEMENT SET NEW.pay = 0")
    db.sql("INSERT INTO emp (id, name) VALUES (9, 'zed')")
    db.sql("UPDATE emp SET pay = 15 WHERE id IN (1, 2)")
    assert rows(db, "SELECT id, name, pay FROM emp WHERE id IN (1, 2, 9)") == [(1, "ann", 15), (2, "bob", 20), (9, "ZED", 1)]
    db.sql("DELETE FROM emp WHERE id = 9")
    assert db.log == ["t3: AFTER DELETE ON emp, 1 rows"]


def test_grid_says_that_rows_are_left_out(spark):
    assert grid(spark.range(1001)).splitlines()[-1] == "(first 1000 rows)"
    assert grid(spark.range(1000)).splitlines()[-1] == "(1000 rows)"


def test_scripts_and_grid(spark):
    script = "CREATE TABLE t (a INT); -- c;\nINSERT INTO t VALUES (1);\nSELECT a, ';' AS s FROM t; SELECT oops FROM t"
    assert len(list(statements(script))) == 4
    out = list(Engine(spark).run_script(script))
    assert "1 | ;" in out[2] and out[3].startswith("ERROR") and "(1 row)" in out[2]
    assert grid(spark.range(1).selectExpr("1.50D AS x", "CAST(NULL AS INT) AS y")).splitlines()[2] == "1.5 | NULL"


SQL_BOTH = [
    "SELECT c_mktsegment, COUNT(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice BETWEEN 1000 AND 200000 GROUP BY c_mktsegment",
    "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%'",
    "WITH t AS (SELECT o_custkey AS k, MAX(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT c_custkey, m FROM t JOIN customer ON k = c_custkey WHERE m > (SELECT AVG(m) FROM t)",
    "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders",
    "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS k FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority",
]


@pytest.mark.parametrize("sql", SQL_BOTH)
def test_dialect_against_duckdb(spark, sql):
    engine = Engine(spark)
    for name in ("customer", "orders", "nation", "region", "lineitem"):
        engine.register(name, spark.read.parquet(f"{SF}/{name}.parquet"))
    same(engine.sql(sql), duck(SF), sql)


def test_translation_is_plain_sql():
    assert translate("SELECT a FROM t ORDER BY a DESC LIMIT 2, 3") == "SELECT `a` FROM `t` ORDER BY `a` DESC NULLS LAST LIMIT 3 OFFSET 2"


@pytest.mark.parametrize(
    ("sql", "want"),
    [
        ("SELECT 7 / 2 / 2, TYPEOF(id / 2), 9007199254740993 / 1 FROM emp WHERE id = 1", [(1, "INTEGER", 9007199254740993)]),
        ("SELECT (SELECT MAX(pay) FROM emp) / id / 2, SUM(pay) OVER (ORDER BY id) / 4 FROM emp WHERE id = 2", [(7, 5)]),
        ("SELECT dept, SUM(pay) / COUNT(*) FROM emp WHERE pay > 0 GROUP BY dept", [("dev", 15), (None, 30)]),
        ("WITH t AS (SELECT pay AS p FROM emp) SELECT MAX(p) / 7 FROM t", [(4,)]),
        ("SELECT -7.5 % 2, 7 % -2, -7 % 2, 7.5 % 0", [(0.5, 1, -1, None)]),
        ("SELECT 5 IN (SELECT pay FROM emp), 10 IN (SELECT pay FROM emp), 5 NOT IN (SELECT pay FROM emp), 5 IN (SELECT pay FROM emp WHERE id > 9), pay IN (SELECT 1) FROM emp WHERE id = 4", [(None, True, None, False, None)]),
        ("SELECT id FROM emp WHERE (pay IN (SELECT pay FROM emp WHERE id = 4)) IS NULL", [(1,), (2,), (3,), (4,)]),
        ("SELECT id FROM emp WHERE NOT (pay IN (SELECT pay FROM emp WHERE id < 3))", [(3,)]),
        ("SELECT CAST(99999999999 AS INT), CAST(-1e30 AS BIGINT), CAST('-99999999999' AS INT), CAST('9e' AS INT), CAST(NULL AS INT), CAST(TRUE AS INT)", [(2147483647, -9223372036854775808, -2147483648, 9, None, 1)]),
        ("SELECT '2024-01-31' + INTERVAL 1 MONTH, '2024-01-31 10:00:00' - INTERVAL 1 DAY, DATE '2024-01-31' + INTERVAL 30 HOUR", [("2024-02-29", "2024-01-30 10:00:00", __import__("datetime").date(2024, 2, 1))]),
        ("SELECT SUM(x) OVER w AS s FROM (VALUES (1), (2), (2)) AS v(x) WINDOW w AS (ORDER BY x)", [(1,), (3,), (5,)]),
        ("SELECT dept, id FROM emp ORDER BY dept FETCH FIRST 1 ROW WITH TIES", [("dev", 1), ("dev", 2)]),
        ("SELECT DISTINCT dept AS d FROM emp ORDER BY d DESC FETCH FIRST 1 ROWS WITH TIES", [("ops",)]),
        ("SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept ORDER BY COUNT(*) OFFSET 1 ROW FETCH NEXT 1 ROW WITH TIES", None),
    ],
)
def test_rules_of_the_dialect(db, sql, want):
    got = rows(db, sql)
    assert len(got) == 1 if want is None else got == sorted(want, key=repr)


def test_long_chains_stay_short():
    assert len(translate("SELECT " + "a" + " / 2" * 30 + " FROM t")) < 12_000


BODIES = [
    ("f(n INT) RETURNS BIGINT BEGIN DECLARE i INT DEFAULT 1; DECLARE out BIGINT DEFAULT 1; WHILE i <= n DO SET out = out * i; SET i = i + 1; END WHILE; RETURN out; END", "F(id)", [1, 2, 6, 24]),
    ("f(n INT) RETURNS INT BEGIN IF n = 1 THEN RETURN 10; ELSEIF n = 2 THEN RETURN 20; END IF; RETURN n / 2; END", "F(id)", [10, 20, 1, 2]),
    ("f(n INT) RETURNS TEXT BEGIN CASE n WHEN 1 THEN RETURN 'one'; WHEN 2 THEN RETURN 'two'; ELSE SET n = n * 10; END CASE; RETURN n || '!'; END", "F(id)", ["one", "two", "30!", "40!"]),
    ("f(n INT) RETURNS INT BEGIN DECLARE i INT DEFAULT 0; DECLARE s INT DEFAULT 0; go: LOOP SET i = i + 1; IF i > n THEN LEAVE go; END IF; IF i % 2 = 0 THEN ITERATE go; END IF; SET s = s + i; END LOOP; RETURN s; END", "F(id + 2)", [4, 4, 9, 9]),
    ("f(n INT) RETURNS INT BEGIN DECLARE i INT DEFAULT 0; REPEAT SET i = i + 3; UNTIL i >= n END REPEAT; RETURN i; END", "F(id * 4)", [6, 9, 12, 18]),
    ("f(n INT, m INT) RETURNS INT RETURN COALESCE(n, 0) + m", "F(pay, id)", [11, 22, 33, 4]),
]


@pytest.mark.parametrize(("body", "call", "want"), BODIES)
def test_function_bodies(db, body, call, want):
    db.sql("CREATE FUNCTION " + body)
    assert [r[1] for r in rows(db, f"SELECT id, {call} FROM emp")] == want


def test_wrong_bodies(db):
    db.sql("CREATE FUNCTION g(n INT) RETURNS INT BEGIN IF n = 1 THEN RETURN 1; END IF; END")
    assert rows(db, "SELECT G(id) FROM emp WHERE id = 1") == [(1,)]
    with pytest.raises(Exception, match="without RETURN"):
        db.sql("SELECT G(id) FROM emp").collect()
    with pytest.raises(SqlError):
        db.sql("CREATE FUNCTION h(n INT) RETURNS INT BEGIN SET x = 1; RETURN x; END")


def test_names_beyond_ascii(db):
    db.sql("CREATE TABLE `学生` (`编号` INT PRIMARY KEY, `名字` VARCHAR(50))")
    db.sql("INSERT INTO `学生` VALUES (1, '王')")
    db.sql("UPDATE `学生` SET `名字` = '李' WHERE `编号` = 1")
    assert rows(db, "SELECT s.`名字` FROM `学生` s") == [("李",)]


def test_repeated_keys_in_one_statement(db):
    db.sql("INSERT INTO emp VALUES (9, 'a', 'x', 1), (9, 'b', 'x', 2), (1, 'c', 'x', 5) ON DUPLICATE KEY UPDATE pay = pay + VALUES(pay)")
    assert rows(db, "SELECT id, name, pay FROM emp WHERE id IN (1, 9)") == [(1, "ann", 15), (9, "a", 3)]
    db.sql("REPLACE INTO emp VALUES (9, 'p', 'x', 1), (9, 'q', 'x', 2)")
    assert rows(db, "SELECT name FROM emp WHERE id = 9") == [("q",)]


def test_rows_through_views(db):
    db.sql("CREATE VIEW devs (who, nr) AS SELECT e.name, e.id FROM emp e WHERE e.dept = 'dev' OR e.id > 50")
    db.sql("CREATE VIEW high AS SELECT nr, who AS label FROM devs WHERE nr > 60 WITH CHECK OPTION")
    db.sql("INSERT INTO devs VALUES ('zoe', 51)")
    db.sql("INSERT INTO devs (nr) SELECT 52 WHERE FALSE")
    db.sql("INSERT INTO high (label, nr) VALUES ('top', 61)")
    for sql in ("INSERT INTO high VALUES (55, 'low')", "INSERT INTO devs (id) VALUES (1)"):
        with pytest.raises(SqlError):
            db.sql(sql)
    assert rows(db, "SELECT id, name, dept FROM emp WHERE id > 50") == [(51, "zoe", "ops"), (61, "top", "ops")]


def test_sequences_row_by_row(db):
    db.sql("CREATE SEQUENCE s START WITH 5 INCREMENT BY 5")
    assert sorted(r[0] for r in db.sql("SELECT NEXTVAL FOR s FROM emp").collect()) == [5, 10, 15, 20]
    db.sql("INSERT INTO emp (id, name) VALUES (NEXTVAL FOR s, 'a'), (NEXTVAL FOR s, 'b')")
    assert rows(db, "SELECT id FROM emp WHERE id > 20") == [(25,), (30,)]


def test_explain_formats_and_errors(db):
    text = "\n".join(r[0] for r in db.sql("EXPLAIN ANALYZE SELECT dept, COUNT(*) FROM emp GROUP BY dept").collect())
    assert "rows: 3" in text
    tree = __import__("json").loads("\n".join(r[0] for r in db.sql("EXPLAIN ANALYZE FORMAT JSON SELECT dept, COUNT(*) FROM emp GROUP BY dept").collect()))
    assert tree["rows"] == 3 and tree["children"]
    assert db.sql("EXPLAIN FORMAT SEXPR SELECT 1").first()[0].startswith("(")
    for sql, kind, place in (("SELECT a\nFROM emp WHERE", "syntax", (2, 15)), ("SELECT 1 FROM empp", "name", (None, None)), ("SELECT nam FROM emp", "name", (None, None)), ("INSERT INTO emp VALUES (1, 'x', 'x', 1)", "constraint", (None, None)), ("SELECT 'a\n", "syntax", (1, 8))):
        with pytest.raises(SqlError) as e:
            db.sql(sql).collect()
        assert (e.value.kind, (e.value.line, e.value.column)) == (kind, place)


def test_catalog_survives(db, spark, tmp_path):
    db.sql("CREATE VIEW dev AS SELECT id, name FROM emp WHERE dept = 'dev'")
    db.sql("CREATE FUNCTION twice(x INT) RETURNS INT RETURN x * 2")
    db.sql("CREATE SEQUENCE s START WITH 5")
    db.sql("CREATE MATERIALIZED VIEW m AS SELECT COUNT(*) AS n FROM emp")
    db.save(f"file://{tmp_path}/db")
    db.sql("DELETE FROM emp")
    again = Engine.load(spark, f"file://{tmp_path}/db")
    assert rows(again, "SELECT name, TWICE(id) FROM dev") == [("ann", 2), ("bob", 4)] and rows(again, "SELECT n FROM m") == [(4,)]
    again.sql("INSERT INTO emp (id, name) VALUES (NEXTVAL FOR s, 'eve')")
    with pytest.raises(SqlError):
        again.sql("INSERT INTO emp VALUES (5, 'twin', 'x', 1)")
    again.save(f"file://{tmp_path}/db")
    assert len(rows(Engine.load(spark, f"file://{tmp_path}/db"), "SELECT * FROM emp")) == 5


def test_shell(spark, tmp_path):
    from lakemill.__main__ import Shell

    (tmp_path / "a.sql").write_text("INSERT INTO t VALUES (2);\n")
    script = f"CREATE TABLE t (a INT);\nINSERT INTO t VALUES (1);\n.read {tmp_path}/a.sql\nSELECT SUM(a) AS s\nFROM t;\n\\\\ast SELECT 7 / 2\n\\\\optimized SELECT a FROM t WHERE a > 1\n\\\\nope SELECT 1\nSELECT oops FROM t;\nCREATE PROCEDURE p() BEGIN SET @x = 1; SET @x = 2; END;\nCALL p(); SELECT @x AS x;\n.quit\nSELECT 9;"
    out = list(Shell(Engine(spark)).run(script.replace("\\\\", "\\")))
    assert out[3].splitlines()[2] == "3" and out[4] == "SELECT (7 DIV nullif(2, 0))" and "Filter" in out[5]
    assert out[6].startswith("ERROR [syntax]") and out[7].startswith("ERROR [name]") and out[-1].splitlines()[2] == "2" and len(out) == 11
