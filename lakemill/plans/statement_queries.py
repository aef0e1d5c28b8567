"""Registered queries that run statements through the engine and return what they leave, beside SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import Tables
from .engine import Engine

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TABLE = "CREATE TABLE n (k INT PRIMARY KEY, name VARCHAR(40) NOT NULL, r INT DEFAULT 9, CHECK (k >= 0))"
FILL = "INSERT INTO n SELECT c_custkey, c_name, c_nationkey FROM customer"
REG = "CREATE TABLE reg (id INT PRIMARY KEY)", "INSERT INTO reg SELECT n_nationkey FROM nation"


def engine(spark: SparkSession, path: str, *script: str) -> Engine:
    db, tables = Engine(spark), Tables(spark, path)
    for name in ("nation", "region", "customer", "orders", "supplier", "part"):
        db.register(name, getattr(tables, name))
    for statement in script:
        db.sql(statement)
    return db


def statements(name: str, oracle: str, *script: str) -> None:
    """The last statement's rows are the result."""

    def run(spark: SparkSession, path: str) -> DataFrame:
        return engine(spark, path, *script[:-1]).sql(script[-1])

    QUERIES[name], ORACLES[name] = run, oracle


ALL = "SELECT k, name, r FROM n"
N = "SELECT CAST(c_custkey AS INTEGER) AS k, c_name AS name, c_nationkey AS r FROM customer"
S = "SELECT CAST(s_suppkey * 20 AS INTEGER) AS k, s_name AS name, 5 AS r FROM supplier"

statements("dml_update_from", f"SELECT k, CASE WHEN r_name IS NULL THEN name ELSE r_name || '!' END AS name, r FROM ({N}) LEFT JOIN region ON r = r_regionkey AND r_name LIKE 'A%'", TABLE, FILL, "UPDATE n SET name = r_name || '!' FROM region WHERE r = r_regionkey AND r_name LIKE 'A%'", ALL)
statements("dml_update_returning", f"SELECT k, r + 1 AS r FROM ({N}) WHERE k < 5", TABLE, FILL, "UPDATE n SET r = r + 1 WHERE k < 5 RETURNING k, r")
statements("dml_delete_returning", f"SELECT name FROM ({N}) WHERE r = 2", TABLE, FILL, "DELETE FROM n WHERE r = 2 RETURNING name")
statements("dml_delete_subquery", f"SELECT * FROM ({N}) WHERE k NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)", TABLE, FILL, "DELETE FROM n WHERE k IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 2000)", ALL)
statements("dml_merge", f"SELECT coalesce(n.k, s.k) AS k, CASE WHEN s.k IS NULL THEN n.name ELSE 'm' || s.k END AS name, CASE WHEN n.k IS NULL THEN 9 ELSE n.r END AS r FROM ({N}) n FULL JOIN ({S}) s ON n.k = s.k", TABLE, FILL, "MERGE INTO n USING (SELECT s_suppkey * 20 AS k FROM supplier) AS s ON n.k = s.k WHEN MATCHED THEN UPDATE SET name = 'm' || s.k WHEN NOT MATCHED THEN INSERT (k, name) VALUES (s.k, 'm' || s.k)", ALL)
statements("dml_upsert", f"SELECT coalesce(n.k, s.k) AS k, coalesce(n.name, s.name) AS name, CASE WHEN s.k IS NULL THEN n.r WHEN n.k IS NULL THEN s.r ELSE n.r + s.r END AS r FROM ({N}) n FULL JOIN ({S}) s ON n.k = s.k", TABLE, FILL, "INSERT INTO n SELECT s_suppkey * 20, s_name, 5 FROM supplier ON DUPLICATE KEY UPDATE r = r + VALUES(r)", ALL)
statements("dml_replace", f"SELECT * FROM ({N}) WHERE k NOT IN (3, 90) UNION ALL VALUES (3, 'three', 1), (90, 'ninety', 9)", TABLE, FILL, "REPLACE INTO n VALUES (3, 'three', 1), (90, 'ninety', DEFAULT)", ALL)
statements("dml_insert_select_default", f"SELECT k, name, 9 AS r FROM ({N})", TABLE, "INSERT INTO n (k, name) SELECT c_custkey, c_name FROM customer", ALL)
statements("dml_truncate", "SELECT 0 AS c", TABLE, FILL, "TRUNCATE TABLE n", "SELECT COUNT(*) AS c FROM n")
statements("fk_cascade", f"SELECT * FROM ({N}) WHERE r <> 1", *REG, "CREATE TABLE n (k INT PRIMARY KEY, name TEXT, r INT REFERENCES reg(id) ON DELETE CASCADE)", FILL, "DELETE FROM reg WHERE id = 1", ALL)
statements("fk_set_null", f"SELECT k, name, nullif(r, 1) AS r FROM ({N})", *REG, "CREATE TABLE n (k INT PRIMARY KEY, name TEXT, r INT REFERENCES reg(id) ON DELETE SET NULL)", FILL, "DELETE FROM reg WHERE id = 1", ALL)
statements("alter_table", f"SELECT k, name, 7 AS extra FROM ({N})", TABLE, FILL, "ALTER TABLE n ADD COLUMN extra INT DEFAULT 7", "ALTER TABLE n DROP COLUMN r", "ALTER TABLE n RENAME TO m", "SELECT k, name, extra FROM m")
statements("mv_refresh", "SELECT count(*) AS c FROM customer WHERE c_custkey <> 7", TABLE, FILL, "CREATE MATERIALIZED VIEW v AS SELECT COUNT(*) AS c FROM n", "DELETE FROM n WHERE k = 7", "ALTER MATERIALIZED VIEW v REFRESH", "SELECT c FROM v")
statements("view_join", f"SELECT name, r_name FROM (SELECT * FROM ({N}) WHERE k > 10) JOIN region ON r = r_regionkey", TABLE, FILL, "CREATE VIEW v AS SELECT name, r FROM n WHERE k > 10", "SELECT name, r_name FROM v JOIN region ON r = r_regionkey")
statements("udf_inline", f"SELECT k, r * 2 + 1 AS y FROM ({N})", TABLE, FILL, "CREATE FUNCTION f(x INT) RETURNS INT BEGIN RETURN x * 2 + 1; END", "SELECT k, f(r) AS y FROM n")
statements("txn_savepoint_rollback", f"SELECT k, name, 1 AS r FROM ({N})", TABLE, FILL, "BEGIN", "UPDATE n SET r = 1", "SAVEPOINT a", "DELETE FROM n", "ROLLBACK TO SAVEPOINT a", "COMMIT", ALL)
statements("trigger_before_insert", f"SELECT k, upper(name) || '?' AS name, r FROM ({N})", TABLE, "CREATE TRIGGER t BEFORE INSERT ON n FOR EACH ROW SET NEW.name = UPPER(NEW.name) || '?'", FILL, ALL)
statements("procedure_loop", "SELECT CAST(i AS INTEGER) AS k FROM range(4) t(i)", "CREATE TABLE n (k INT)", "CREATE PROCEDURE p(IN m INT) BEGIN DECLARE i INT DEFAULT 0; WHILE i < m DO INSERT INTO n VALUES (i); SET i = i + 1; END WHILE; END", "CALL p(4)", "SELECT k FROM n")
statements("sequence_nextval", "SELECT 12 AS a", "CREATE SEQUENCE s START WITH 10 INCREMENT BY 2", "SELECT NEXTVAL FOR s AS a", "SELECT NEXTVAL FOR s AS a")
statements("sql_quantified", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)", "SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)")
statements("sql_window_rows_default", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS s FROM orders", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS s FROM orders")
statements("sql_grouping", "SELECT c_mktsegment, n_name, count(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name), ())", "SELECT c_mktsegment, n_name, COUNT(*) AS c FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY GROUPING SETS ((c_mktsegment), (n_name), ())")

# ------------------------------------------------------------------ what the dialect does by its own rules

TIES = "SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS q FROM part) WHERE q <= 7"
LATE = "SELECT p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS q, row_number() OVER (ORDER BY p_size) AS w FROM part) WHERE q <= 8 AND w > 3"
DIGITS = "SELECT p_partkey, CAST(least(p_partkey * 1000000000, 2147483647) AS INTEGER) AS a, 2147483647 AS b, CAST(greatest(-p_retailprice * 1e9, -2147483648) AS INTEGER) AS d, CAST(p_size AS INTEGER) AS e FROM part"
COLLATZ = "WITH RECURSIVE c(k, v, n) AS (SELECT n_nationkey, CAST(n_nationkey + 1 AS BIGINT), 0 FROM nation UNION ALL SELECT k, CASE WHEN v % 2 = 0 THEN v // 2 ELSE 3 * v + 1 END, n + 1 FROM c WHERE v > 1) SELECT k, CAST(max(n) AS INTEGER) AS s FROM c GROUP BY k"
STEPS = "CREATE FUNCTION steps(x INT) RETURNS INT BEGIN DECLARE n INT DEFAULT 0; DECLARE v BIGINT; SET v = x; WHILE v > 1 DO IF v % 2 = 0 THEN SET v = v / 2; ELSE SET v = 3 * v + 1; END IF; SET n = n + 1; END WHILE; RETURN n; END"
TOTAL = "CREATE PROCEDURE total(IN least_ INT, OUT t INT) BEGIN DECLARE done INT DEFAULT 0; DECLARE v INT; DECLARE c CURSOR FOR SELECT r_regionkey FROM region WHERE r_regionkey >= least_ ORDER BY r_regionkey; DECLARE CONTINUE HANDLER FOR NOT FOUND SET done = 1; SET t = 0; OPEN c; go: LOOP FETCH c INTO v; IF done = 1 THEN LEAVE go; END IF; SET t = t + v * v; END LOOP; CLOSE c; END"
SAFE = "CREATE PROCEDURE safe(OUT s INT) BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET s = -1; SET s = 0; INSERT INTO n VALUES (7, 'again', 1); SET s = 1; END"

statements("sql_division", "SELECT o_orderkey, o_custkey // 7 // 3 AS a, 'INTEGER' AS t, o_totalprice / 4 AS b, CAST(9007199254740993 + o_custkey AS BIGINT) AS c FROM orders", "SELECT o_orderkey, o_custkey / 7 / 3 AS a, TYPEOF(o_custkey / 2) AS t, o_totalprice / 4 AS b, (9007199254740993 + o_custkey) / 1 AS c FROM orders")
statements("sql_remainder", "SELECT s_suppkey, (0 - s_suppkey) % 3 AS a, round(-s_acctbal - floor(-s_acctbal / 2) * 2, 6) AS b FROM supplier", "SELECT s_suppkey, (0 - s_suppkey) % 3 AS a, ROUND((0 - s_acctbal) % 2, 6) AS b FROM supplier")
statements("sql_in_projected", "SELECT c_custkey, c_nationkey IN (SELECT nullif(s_nationkey, 3) FROM supplier) AS hit, c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier) AS no FROM customer", "SELECT c_custkey, c_nationkey IN (SELECT NULLIF(s_nationkey, 3) FROM supplier) AS hit, c_nationkey NOT IN (SELECT NULLIF(s_nationkey, 3) FROM supplier) AS no FROM customer")
statements("sql_named_window", "SELECT c_mktsegment, c_nationkey, CAST(sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS r FROM customer", "SELECT c_mktsegment, c_nationkey, SUM(c_nationkey) OVER w AS s, CAST(RANK() OVER w AS BIGINT) AS r FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)")
statements("sql_window_in_expression", "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, 10 * row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders", "SELECT o_orderkey, ROUND(o_totalprice / SUM(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share, CAST(10 * ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS r FROM orders")
statements("sql_window_null_order", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') DESC NULLS FIRST, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'F') NULLS LAST, o_orderkey) AS b FROM orders", "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F') DESC, o_orderkey) AS BIGINT) AS a, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY NULLIF(o_orderstatus, 'F'), o_orderkey) AS BIGINT) AS b FROM orders")
statements("sql_cast_out_of_range", DIGITS, "SELECT p_partkey, CAST(p_partkey * 1000000000 AS INT) AS a, CAST('99999999999x' AS INT) AS b, CAST((0 - p_retailprice) * 1000000000.0 AS INT) AS d, CAST(CAST(p_size AS VARCHAR) || ' mm' AS INT) AS e FROM part")
statements("sql_interval_of_text", "SELECT o_orderkey, CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS VARCHAR) AS a, CAST(o_orderdate AS DATE) AS b FROM orders", "SELECT o_orderkey, SUBSTR(CAST(o_orderdate AS VARCHAR), 1, 10) + INTERVAL 1 MONTH AS a, CAST(o_orderdate AS DATE) + INTERVAL 5 HOUR AS b FROM orders")
statements("sql_unicode_names", N.replace("AS k", 'AS "键"').replace("AS name", 'AS "名"').replace(", c_nationkey AS r", ""), "CREATE TABLE `客户` (`键` INT PRIMARY KEY, `名` TEXT)", "INSERT INTO `客户` SELECT c_custkey, c_name FROM customer", "SELECT `键`, x.`名` FROM `客户` AS x")
statements("sql_recursive_deep", "SELECT CAST(i AS INTEGER) AS i FROM range(1, 501) t(i)", "WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 500) SELECT i FROM s")
statements("sql_fetch_with_ties", TIES, "SELECT p_partkey, p_size FROM part ORDER BY p_size FETCH FIRST 7 ROWS WITH TIES")
statements("sql_fetch_offset_with_ties", LATE, "SELECT p_size FROM part ORDER BY 1 OFFSET 3 ROWS FETCH NEXT 5 ROWS WITH TIES")
statements("dml_upsert_repeated_key", f"SELECT k, name, CASE k WHEN 7 THEN r + 18 ELSE r END AS r FROM ({N})", TABLE, FILL, "INSERT INTO n VALUES (7, 'a', 5), (7, 'b', 6), (7, 'c', 7) ON DUPLICATE KEY UPDATE r = r + VALUES(r)", ALL)
statements("dml_replace_repeated_key", f"SELECT * FROM ({N}) WHERE k <> 7 UNION ALL VALUES (7, 'last', 2)", TABLE, FILL, "REPLACE INTO n VALUES (7, 'first', 1), (7, 'last', 2)", ALL)
statements("view_insert_check", f"SELECT * FROM ({N}) UNION ALL VALUES (100000000, 'new', 9)", TABLE, FILL, "CREATE VIEW v (a, b) AS SELECT name, k FROM n WHERE n.k > 5 WITH CHECK OPTION", "INSERT INTO v VALUES ('new', 100000000)", ALL)
statements("sequence_rows", "SELECT count(*) AS c, 10 AS lo, CAST(8 + 2 * count(*) AS INTEGER) AS hi, count(*) AS d FROM customer", "CREATE SEQUENCE s START WITH 10 INCREMENT BY 2", TABLE, "INSERT INTO n SELECT NEXTVAL FOR s, c_name, c_nationkey FROM customer", "SELECT COUNT(*) AS c, MIN(k) AS lo, MAX(k) AS hi, COUNT(DISTINCT k) AS d FROM n")
statements("auto_increment", "SELECT count(*) AS c, 1 AS lo, CAST(count(*) AS INTEGER) AS hi, count(*) AS d FROM customer", "CREATE TABLE a (id INT AUTO_INCREMENT PRIMARY KEY, v TEXT)", "INSERT INTO a (v) SELECT c_name FROM customer", "SELECT COUNT(*) AS c, MIN(id) AS lo, MAX(id) AS hi, COUNT(DISTINCT id) AS d FROM a")
statements("udf_procedural", COLLATZ, STEPS, "SELECT n_nationkey AS k, STEPS(n_nationkey + 1) AS s FROM nation")
statements("procedure_cursor_out", "SELECT CAST(sum(r_regionkey * r_regionkey) AS INTEGER) AS t FROM region WHERE r_regionkey >= 2", TOTAL, "CALL total(2, @t)", "SELECT @t AS t")
statements("procedure_handler", "SELECT -1 AS s, count(*) AS c FROM customer", TABLE, FILL, SAFE, "CALL safe(@s)", "SELECT @s AS s, COUNT(*) AS c FROM n")

# ------------------------------------------------------------------ the rest of the statements, each through its text

LOOPS = "CREATE PROCEDURE loops(OUT a INT, OUT b INT, OUT c VARCHAR(20)) BEGIN DECLARE i INT DEFAULT 0; SET a = 0; SET b = 0; l: LOOP SET i = i + 1; IF i > 9 THEN LEAVE l; END IF; IF i % 2 = 0 THEN ITERATE l; END IF; SET a = a + i; END LOOP l; REPEAT SET b = b + 2; UNTIL b >= 7 END REPEAT; CASE WHEN a > b THEN SET c = 'more'; ELSE SET c = 'less'; END CASE; END"
SIGNALS = "CREATE PROCEDURE signals(OUT s INT) BEGIN DECLARE CONTINUE HANDLER FOR SQLSTATE '45000' SET s = s + 10; SET s = 1; SIGNAL SQLSTATE '45000'; SET s = s + 100; END"
GUARDED = "CREATE PROCEDURE guarded(OUT s INT) BEGIN DECLARE EXIT HANDLER FOR SQLEXCEPTION SET s = -1; SET s = 0; DELETE FROM reg WHERE id = 1; SET s = 1; END"

statements("sql_unary_minus", "SELECT s_suppkey, -s_acctbal AS a, s_nationkey AS b, 1 - s_suppkey AS c FROM supplier", "SELECT s_suppkey, -s_acctbal AS a, -(-s_nationkey) AS b, -s_suppkey + 1 AS c FROM supplier")
statements("sql_offset_only", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 10", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 10 ROWS")
statements("sql_set_op_trailing", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 20 FROM supplier ORDER BY k DESC LIMIT 9", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey + 20 FROM supplier ORDER BY k DESC LIMIT 9")
statements("sql_set_op_nested", "(SELECT c_nationkey AS k FROM customer) EXCEPT ((SELECT s_nationkey FROM supplier) INTERSECT (SELECT n_nationkey FROM nation WHERE n_regionkey < 3))", "(SELECT c_nationkey AS k FROM customer) EXCEPT ((SELECT s_nationkey FROM supplier) INTERSECT (SELECT n_nationkey FROM nation WHERE n_regionkey < 3))")
statements("sql_variable", "SELECT c_custkey, c_nationkey * 3 AS v FROM customer WHERE c_nationkey > 3", "SET @lo = 3", "SELECT c_custkey, c_nationkey * @lo AS v FROM customer WHERE c_nationkey > @lo")
statements("sql_now_rand", "SELECT count(*) AS c FROM customer", "SELECT COUNT(*) AS c FROM customer WHERE RAND() >= 0 AND RANDOM() < 1 AND NOW() > CAST('2020-01-01' AS DATE) AND CURRENT_TIMESTAMP > CAST('2020-01-01' AS DATE)")
statements("sql_for_update", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 0 FOR UPDATE")
statements("sql_joins", "SELECT r_name, n_name, coalesce(s.c, 0) AS c, t.top FROM nation n JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT s_nationkey, count(*) AS c FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey LEFT JOIN (SELECT c_nationkey, max(c_acctbal) AS top FROM customer GROUP BY 1) t ON c_nationkey = n_nationkey", "SELECT r_name, n_name, COALESCE(s.c, 0) AS c, t.top FROM nation n JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey) LEFT JOIN (SELECT s_nationkey, COUNT(*) AS c FROM supplier GROUP BY s_nationkey) s ON s_nationkey = n_nationkey, LATERAL (SELECT MAX(c_acctbal) AS top FROM customer WHERE c_nationkey = n.n_nationkey) t")
statements("sql_correlated", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 8000)", "SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal) AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 8000)")
statements("sql_aggregates", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS a, sum(c_custkey) FILTER (WHERE c_acctbal > 0) AS b, quantile_cont(c_acctbal, 0.25) AS d, median(c_acctbal) AS e, (SELECT string_agg(CAST(k AS VARCHAR), ',' ORDER BY k DESC) FROM (SELECT DISTINCT c_nationkey AS k FROM customer i WHERE i.c_mktsegment = customer.c_mktsegment AND c_acctbal > 9000)) AS f FROM customer GROUP BY c_mktsegment HAVING count(*) > 1", "SELECT c_mktsegment, COUNT(DISTINCT c_nationkey) AS a, SUM(c_custkey) FILTER (WHERE c_acctbal > 0) AS b, PERCENTILE_CONT(0.25) WITHIN GROUP (ORDER BY c_acctbal) AS d, MEDIAN(c_acctbal) AS e, STRING_AGG(DISTINCT c_nationkey, ',' ORDER BY c_nationkey DESC) FILTER (WHERE c_acctbal > 9000) AS f FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 1")
statements("sql_functions", "SELECT c_custkey, upper(c_name) || '-' || lower(c_mktsegment) AS a, substr(c_name, 3, 4) AS b, strpos(c_name, '#') AS c, replace(c_name, '0', 'o') AS d, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' END AS e, concat_ws('/', c_name, NULL, c_mktsegment) AS f, coalesce(nullif(c_nationkey, 3), -1) AS g FROM customer WHERE c_name LIKE '%1%' AND c_mktsegment ILIKE 'b%' OR c_nationkey BETWEEN 2 AND 4", "SELECT c_custkey, UPPER(c_name) || '-' || LOWER(c_mktsegment) AS a, SUBSTR(c_name, 3, 4) AS b, INSTR(c_name, '#') AS c, REPLACE(c_name, '0', 'o') AS d, CASE WHEN c_acctbal < 0 THEN 'neg' WHEN c_acctbal < 5000 THEN 'mid' END AS e, CONCAT_WS('/', c_name, NULL, c_mktsegment) AS f, IFNULL(NULLIF(c_nationkey, 3), -1) AS g FROM customer WHERE c_name LIKE '%1%' AND c_mktsegment ILIKE 'b%' OR c_nationkey BETWEEN 2 AND 4")
statements("sql_cte_reused", "WITH a AS (SELECT c_nationkey AS k, sum(c_acctbal) AS s FROM customer GROUP BY 1) SELECT x.k, round(x.s - y.m, 2) AS d FROM a x, (SELECT avg(s) AS m FROM a) y", "WITH a (k, s) AS (SELECT c_nationkey, SUM(c_acctbal) FROM customer GROUP BY c_nationkey), y AS (SELECT AVG(s) AS m FROM a) SELECT x.k, ROUND(x.s - y.m, 2) AS d FROM a x CROSS JOIN y")
statements("index_show_drop", "SELECT 'u' AS name, 'k, name' AS \"columns\", true AS is_unique", TABLE, FILL, "CREATE UNIQUE INDEX u ON n (k, name)", "CREATE INDEX i ON n (r)", "DROP INDEX i", "SHOW INDEX FROM n")
statements("schema_qualified", N, "CREATE SCHEMA s", TABLE.replace("TABLE n", "TABLE s.n"), FILL.replace("INTO n", "INTO s.n"), "SELECT k, name, r FROM s.n")
statements("drop_create_again", "SELECT 0 AS c", TABLE, FILL, "DROP TABLE n", "DROP TABLE IF EXISTS n", TABLE, "SELECT COUNT(*) AS c FROM n")
statements("show_tables", "SELECT unnest(['customer', 'n', 'nation', 'orders', 'part', 'region', 'supplier']) AS name", TABLE, "SHOW TABLES")
statements("alter_rename_modify", f"SELECT k, name AS label, CAST(r AS VARCHAR) || '!' AS r FROM ({N})", TABLE, FILL, "ALTER TABLE n RENAME COLUMN name TO label", "ALTER TABLE n MODIFY COLUMN r VARCHAR(9)", "SELECT k, label, r || '!' AS r FROM n")
statements("txn_rollback", f"SELECT * FROM ({N})", TABLE, FILL, "BEGIN", "DELETE FROM n WHERE r > 3", "UPDATE n SET r = 0", "ROLLBACK", ALL)
statements("view_replaced", f"SELECT k, r FROM ({N}) WHERE r > 5", TABLE, FILL, "CREATE VIEW v AS SELECT k FROM n", "CREATE OR REPLACE VIEW v AS SELECT k, r FROM n WHERE r > 5", "SELECT k, r FROM v")
statements("procedure_branches", "SELECT 25 AS a, 8 AS b, 'more' AS c", LOOPS, "CALL loops(@a, @b, @c)", "SELECT @a AS a, @b AS b, @c AS c")
statements("procedure_signal", "SELECT 111 AS s", SIGNALS, "CALL signals(@s)", "SELECT @s AS s")
statements("fk_restrict", "SELECT -1 AS s, (SELECT count(*) FROM nation) AS c", *REG, "CREATE TABLE n (k INT PRIMARY KEY, name TEXT, r INT REFERENCES reg(id) ON DELETE RESTRICT)", FILL, GUARDED, "CALL guarded(@s)", "SELECT @s AS s, COUNT(*) AS c FROM reg")
