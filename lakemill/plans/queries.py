"""Registered queries over the star schema: a DataFrame plan each, beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import dialect as D
from ..operators import constraints as C
from ..operators import relational as R
from ..operators import subquery as S
from ..sources.tables import Tables, range_scan, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, path: f(Tables(spark, path))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r4(x, name):
    return F.round(x, 4).alias(name)


def n(x, name):
    return x.cast("long").alias(name)


# ------------------------------------------------------------------ flagship


@query("""SELECT c_mktsegment, n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 2) AS avg_price
FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P'
GROUP BY c_mktsegment, n_name HAVING count(*) > 5 ORDER BY revenue DESC, c_mktsegment, n_name LIMIT 50""")
def flagship_segment_revenue(t):
    joined = t.customer.join(t.orders.where("o_orderstatus <> 'P'"), c("c_custkey") == c("o_custkey")).join(t.nation, c("c_nationkey") == c("n_nationkey"))
    out = joined.groupBy("c_mktsegment", "n_name").agg(n(F.count("*"), "n_orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"))
    return out.where("n_orders > 5").orderBy(c("revenue").desc(), "c_mktsegment", "n_name").limit(50)


# ------------------------------------------------------------------ scans, filters, projections


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 400 AND o_orderkey <> 200 AND o_orderstatus = 'F'")
def scan_index_range(t):
    return range_scan(t.orders, "o_orderkey", 100, 400, residual=(c("o_orderkey") != 200) & (c("o_orderstatus") == "F")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT s.k AS k, s.p * 2 AS p2 FROM (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderstatus = 'O') AS s WHERE s.p > 300000")
def scan_derived_table(t):
    s = t.orders.where("o_orderstatus = 'O'").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("p")).alias("s")
    return s.where("s.p > 300000").select("s.k", (c("s.p") * 2).alias("p2"))


@query("SELECT v.a AS a, v.b AS b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) AS v(a, b)")
def values_derived(t):
    return values(t.spark, [(1, "x"), (2, None), (3, "z")], "a int, b string")


@query("SELECT CAST(1 + 2 AS INTEGER) AS three, 'a' || 'b' AS ab")
def select_no_from(t):
    return t.spark.range(1).select((lit(1) + lit(2)).alias("three"), D.pipes(lit("a"), lit("b")).alias("ab"))


@query("SELECT o_orderkey, CAST((nullif(o_orderstatus, 'F') = 'O') AS INTEGER) AS eq, CAST((nullif(o_orderstatus, 'F') = 'O' OR o_totalprice > 200000) AS INTEGER) AS o, CAST((nullif(o_orderstatus, 'F') = 'O' AND o_totalprice > 200000) AS INTEGER) AS a, CAST(NOT (nullif(o_orderstatus, 'F') = 'O') AS INTEGER) AS neg FROM orders")
def filter_3vl(t):
    eq, big = F.nullif(c("o_orderstatus"), lit("F")) == "O", c("o_totalprice") > 200000
    return t.orders.select("o_orderkey", D.as_flag(eq).alias("eq"), D.as_flag(eq | big).alias("o"), D.as_flag(eq & big).alias("a"), D.as_flag(~eq).alias("neg"))


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND NOT (nullif(p_size, 12) BETWEEN 15 AND 17)")
def between_not_between(t):
    return t.part.where(c("p_size").between(10, 20) & ~F.nullif(c("p_size"), lit(12)).between(15, 17)).select("p_partkey")


@query("SELECT p_partkey, CAST(p_size IN (1, 5, NULL) AS INTEGER) AS isin, CAST(p_size NOT IN (1, 5, NULL) AS INTEGER) AS notin FROM part")
def in_list_nulls(t):
    isin = c("p_size").isin(1, 5) | F.when(c("p_size").isin(1, 5), True).otherwise(lit(None))
    return t.part.select("p_partkey", D.as_flag(isin).alias("isin"), D.as_flag(~isin).alias("notin"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%1_' AND replace(p_name, '1', '%') LIKE '%!%%' ESCAPE '!'")
def like_escape(t):
    return t.part.where(c("p_name").like("%1_")).where(F.like(F.replace("p_name", lit("1"), lit("%")), lit("%!%%"), lit("!"))).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE 'b%g'")
def ilike(t):
    return t.customer.where(c("c_mktsegment").ilike("b%g")).select("c_custkey")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '[AEIOU]{1}[A-Z]+ [A-Z]+') OR regexp_matches(p_name, '[37]$')")
def regexp_rlike(t):
    return t.part.where(c("p_type").rlike("[AEIOU]{1}[A-Z]+ [A-Z]+") | c("p_name").rlike("[37]$")).select("p_partkey", "p_type")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, '(1|2).*.5')")
def similar_to(t):
    return t.part.where(D.similar_to(c("p_name"), "(1|2)%_5")).select("p_partkey")


@query("SELECT o_orderkey, CAST(coalesce(nullif(o_orderstatus, 'P') = 'F', false) AS INTEGER) AS istrue, CAST(coalesce(nullif(o_orderstatus, 'P') <> 'F', false) AS INTEGER) AS isfalse, CAST(nullif(o_orderstatus, 'P') IS NULL AS INTEGER) AS isnull FROM orders")
def is_true_false(t):
    p = F.nullif(c("o_orderstatus"), lit("P")) == "F"
    return t.orders.select("o_orderkey", D.as_flag(D.is_true(p)).alias("istrue"), D.as_flag(D.is_false(p)).alias("isfalse"), D.as_flag(p.isNull()).alias("isnull"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def case_searched(t):
    p = c("o_totalprice")
    return t.orders.select("o_orderkey", F.when(p > 250000, "high").when(p > 100000, "mid").otherwise("low").alias("band"))


@query("SELECT o_orderkey, CASE WHEN nullif(o_orderstatus, 'P') IS NULL THEN 'none' WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS s FROM orders")
def case_simple_null(t):
    s = F.nullif(c("o_orderstatus"), lit("P"))
    return t.orders.select("o_orderkey", D.case_value(s, [(lit(None), lit("none")), (lit("F"), lit("done"))], lit("open")).alias("s"))


@query("SELECT p_partkey, p_size + 1 AS a, (p_size + 1) * 2 AS b FROM part")
def project_lateral_alias(t):
    t.part.createOrReplaceTempView("_lateral_part")
    return t.spark.sql("SELECT p_partkey, p_size + 1 AS a, a * 2 AS b FROM _lateral_part")


@query("SELECT 'n' AS tag, n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def star_qualified(t):
    return t.nation.alias("n").join(t.region.alias("r"), c("n.n_regionkey") == c("r.r_regionkey")).select(lit("n").alias("tag"), "n.*", "r.r_name")


# ------------------------------------------------------------------ joins


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000")
def join_inner(t):
    return t.orders.join(t.customer.where("c_acctbal > 9000"), c("o_custkey") == c("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_left(t):
    return t.orders.join(t.lineitem, c("o_orderkey") == c("l_orderkey"), "left").groupBy("o_orderkey").agg(n(F.count("l_orderkey"), "n_lines"))


@query("SELECT d.doc_id AS doc_id, l.quality AS quality FROM labels l RIGHT JOIN documents d ON l.doc_id = d.doc_id")
def join_right(t):
    return t.labels.alias("l").join(t.documents.alias("d"), c("l.doc_id") == c("d.doc_id"), "right").select("d.doc_id", "l.quality")


@query("SELECT s.s_suppkey AS s, c.c_custkey AS c FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON s.s_suppkey = c.c_custkey")
def join_full(t):
    return t.supplier.where("s_acctbal > 0").join(t.customer.where("c_acctbal > 0"), c("s_suppkey") == c("c_custkey"), "full").select(c("s_suppkey").alias("s"), c("c_custkey").alias("c"))


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) a JOIN (SELECT r_regionkey AS k, r_name FROM region) b USING (k)")
def join_using(t):
    return t.nation.select(c("n_regionkey").alias("k"), "n_name").join(t.region.select(c("r_regionkey").alias("k"), "r_name"), "k")


@query("SELECT * FROM (SELECT n_regionkey AS k, n_name FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) b")
def join_natural(t):
    return R.natural_join(t.nation.select(c("n_regionkey").alias("k"), "n_name"), t.region.select(c("r_regionkey").alias("k"), "r_name"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    return t.nation.alias("a").join(t.nation.alias("b"), (c("a.n_regionkey") == c("b.n_regionkey")) & (c("a.n_nationkey") < c("b.n_nationkey"))).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"))


@query("SELECT p_partkey, lo FROM part JOIN (VALUES (900, 1000), (1000, 1100), (1500, 1600)) b(lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def join_theta_range(t):
    bands = values(t.spark, [(900, 1000), (1000, 1100), (1500, 1600)], "lo int, hi int")
    return t.part.join(F.broadcast(bands), (c("p_retailprice") >= c("lo")) & (c("p_retailprice") < c("hi"))).select("p_partkey", "lo")


@query("SELECT count(*) AS n, round(sum(a.l_quantity), 2) AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_partkey <> b.l_partkey")
def join_multi_key(t):
    a, b = t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey", "l_quantity").alias("a"), t.lineitem.select("l_orderkey", "l_suppkey", "l_partkey").alias("b")
    on = (c("a.l_orderkey") == c("b.l_orderkey")) & (c("a.l_suppkey") == c("b.l_suppkey")) & (c("a.l_partkey") != c("b.l_partkey"))
    return a.join(b, on).agg(n(F.count("*"), "n"), F.round(F.sum("a.l_quantity"), 2).alias("q"))


@query("SELECT n_name, u.k AS k FROM nation JOIN (SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier) u ON n_nationkey = u.k")
def join_derived_set_op(t):
    u = R.union(t.customer.where("c_acctbal < 0").select(c("c_nationkey").alias("k")), t.supplier.select(c("s_nationkey").alias("k")))
    return t.nation.join(u, c("n_nationkey") == c("k")).select("n_name", "k")


@query("SELECT n_name, x.m AS m FROM nation, LATERAL (SELECT round(max(c_acctbal), 2) AS m FROM customer WHERE c_nationkey = n_nationkey) x")
def join_lateral_corr(t):
    return t.nation.lateralJoin(t.customer.where(c("c_nationkey") == c("n_nationkey").outer()).select(F.round(F.max("c_acctbal"), 2).alias("m"))).select("n_name", "m")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_exists(t):
    return S.exists(t.customer, t.orders.where("o_totalprice > 400000"), c("o_custkey") == c("c_custkey")).select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_not_exists(t):
    return S.not_exists(t.orders, t.lineitem, c("l_orderkey") == c("o_orderkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(s_suppkey, -1) FROM supplier WHERE s_acctbal > 0)")
def anti_not_in(t):
    return S.not_in(t.customer, c("c_custkey"), t.supplier.where("s_acctbal > 0").select(F.nullif(c("s_suppkey"), lit(-1)))).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_acctbal > 0)")
def anti_not_in_null_aware(t):
    return S.not_in(t.customer, c("c_nationkey"), t.supplier.where("s_acctbal > 0").select(F.nullif(c("s_nationkey"), lit(3)))).select("c_custkey")


# ------------------------------------------------------------------ rows that break a constraint


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN l_quantity > 45 THEN 'quantity' END, CASE WHEN l_discount > 0.08 THEN 'discount' END) AS violated FROM lineitem WHERE l_quantity > 45 OR l_discount > 0.08")
def check_violations(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    return C.check_violations(rows, {"quantity": c("l_quantity") <= 45, "discount": c("l_discount") <= 0.08}).drop("l_quantity", "l_discount")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(t):
    return C.unique_violations(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fk_orphans(t):
    return C.fk_orphans(t.documents.select("doc_id", "lang"), ["doc_id"], t.labels, ["doc_id"])


# ------------------------------------------------------------------ subqueries


@query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.8 FROM customer)")
def scalar_subq(t):
    return S.scalar(t.customer, t.customer.agg((F.avg("c_acctbal") * 1.8).alias("v")), "limit_").where("c_acctbal > limit_").select("c_custkey")


@query("SELECT o.o_orderkey AS o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.7 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def scalar_corr(t):
    mean = t.orders.groupBy(c("o_custkey").alias("k")).agg((F.avg("o_totalprice") * 1.7).alias("m"))
    return t.orders.join(mean, c("o_custkey") == c("k")).where("o_totalprice > m").select("o_orderkey")


@query("SELECT c_custkey, CAST(c_nationkey IN (SELECT nullif(s_nationkey, 3) FROM supplier WHERE s_acctbal > 5000) AS INTEGER) AS hit FROM customer")
def in_subq_projected_3vl(t):
    out = S.is_in(t.customer, c("c_nationkey"), t.supplier.where("s_acctbal > 5000").select(F.nullif(c("s_nationkey"), lit(3))), "hit")
    return out.select("c_custkey", D.as_flag(c("hit")).alias("hit"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > ANY (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)")
def any_subq(t):
    return S.quantified(t.customer, c("c_acctbal"), ">", "ANY", t.supplier.where("s_nationkey = 7").select("s_acctbal")).where("result").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_acctbal >= ALL (SELECT s_acctbal FROM supplier WHERE s_nationkey = 7)")
def all_subq(t):
    return S.quantified(t.customer, c("c_acctbal"), ">=", "ALL", t.supplier.where("s_nationkey = 7").select("s_acctbal")).where("result").select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey < ALL (SELECT s_nationkey FROM supplier WHERE s_suppkey < 0)")
def all_empty_true(t):
    return S.quantified(t.nation, c("n_nationkey"), "<", "ALL", t.supplier.where("s_suppkey < 0").select("s_nationkey")).where("result").select("n_nationkey")


# ------------------------------------------------------------------ aggregation


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, round(avg(l_discount), 6) AS d, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def agg_basic(t):
    return t.lineitem.where("l_shipdate <= timestamp_ntz '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        n(F.count("*"), "n"), F.round(F.sum("l_quantity"), 2).alias("q"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("rev"), F.round(F.avg("l_discount"), 6).alias("d"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0")
def agg_empty_input(t):
    return t.orders.where("o_orderkey < 0").agg(n(F.count("*"), "n"), F.sum("o_totalprice").alias("s"), F.avg("o_totalprice").alias("a"), F.min("o_orderkey").alias("lo"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS k FROM orders GROUP BY o_orderpriority")
def agg_count_distinct(t):
    return t.orders.groupBy("o_orderpriority").agg(n(F.count_distinct("o_custkey"), "k"))


@query("SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 4) AS a FROM part GROUP BY p_brand")
def agg_sum_avg_distinct(t):
    t.part.createOrReplaceTempView("_distinct_part")
    return t.spark.sql("SELECT p_brand, CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 4) AS a FROM _distinct_part GROUP BY p_brand")


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_custkey")
def agg_filter(t):
    return t.orders.groupBy("o_custkey").agg(n(F.count_if(c("o_orderstatus") == "F"), "f"), F.round(F.sum(F.when(c("o_totalprice") > 100000, c("o_totalprice"))), 2).alias("big"))


@query("SELECT c_nationkey, round(stddev_samp(c_acctbal), 4) AS sd, round(stddev_pop(c_acctbal), 4) AS sp, round(var_samp(c_acctbal), 2) AS v, round(var_pop(c_acctbal), 2) AS vp FROM customer GROUP BY c_nationkey")
def agg_stats(t):
    return t.customer.groupBy("c_nationkey").agg(r4(F.stddev_samp("c_acctbal"), "sd"), r4(F.stddev_pop("c_acctbal"), "sp"), F.round(F.var_samp("c_acctbal"), 2).alias("v"), F.round(F.var_pop("c_acctbal"), 2).alias("vp"))


@query("SELECT p_brand, round(median(p_retailprice), 4) AS m FROM part GROUP BY p_brand")
def agg_median(t):
    return t.part.groupBy("p_brand").agg(r4(F.median("p_retailprice"), "m"))


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.3), 4) AS a, round(quantile_cont(p_retailprice, 0.7), 4) AS z FROM part GROUP BY p_brand")
def agg_percentile_cont(t):
    return t.part.groupBy("p_brand").agg(r4(F.percentile("p_retailprice", lit(0.3)), "a"), r4(F.percentile("p_retailprice", lit(0.7)), "z"))


@query("SELECT p_brand, quantile_disc(p_retailprice, 0.3) AS a FROM part GROUP BY p_brand")
def agg_percentile_disc(t):
    t.part.createOrReplaceTempView("_disc_part")
    return t.spark.sql("SELECT p_brand, percentile_disc(0.3) WITHIN GROUP (ORDER BY p_retailprice) AS a FROM _disc_part GROUP BY p_brand")


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_string_agg(t):
    t.nation.createOrReplaceTempView("_agg_nation")
    return t.spark.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM _agg_nation GROUP BY n_regionkey")


@query("SELECT CAST(date_part('year', o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")
def group_alias(t):
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(n(F.count("*"), "n"))


@query("SELECT p_size % 5 AS m, p_size > 25 AS big, count(*) AS n FROM part GROUP BY p_size % 5, p_size > 25")
def group_expr(t):
    return t.part.groupBy((c("p_size") % 5).alias("m"), (c("p_size") > 25).alias("big")).agg(n(F.count("*"), "n"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 2000000 AND count(*) > 3")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("x"), F.count("*").alias("k")).where("x > 2000000 and k > 3").select("o_custkey", F.round("x", 2).alias("s"))


@query("SELECT c_mktsegment, coalesce(sum(c_acctbal), 0) > 0 AS pos, round(sum(c_acctbal) / count(*), 4) AS ratio FROM customer GROUP BY c_mktsegment")
def agg_expression(t):
    return t.customer.groupBy("c_mktsegment").agg((F.coalesce(F.sum("c_acctbal"), lit(0)) > 0).alias("pos"), r4(F.sum("c_acctbal") / F.count("*"), "ratio"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(n(F.count("*"), "n"))


@query("SELECT o_orderstatus, o_orderpriority, round(max(o_totalprice), 2) AS m FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.round(F.max("o_totalprice"), 2).alias("m"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    return R.grouping_sets(t.orders, [["o_orderstatus"], ["o_orderpriority"], []], ["o_orderstatus", "o_orderpriority"], [n(F.count("*"), "n")])


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(t):
    return t.orders.select("o_orderstatus", "o_orderpriority").distinct()


# ------------------------------------------------------------------ windows

def _by_cust():
    return Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")


_frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query(f"SELECT o_orderkey, row_number() {_W} AS rn FROM orders")
def win_row_number(t):
    return t.orders.select("o_orderkey", n(F.row_number().over(_by_cust()), "rn"))


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS d FROM part")
def win_rank_dense(t):
    w = Window.partitionBy("p_brand").orderBy(c("p_size").desc())
    return t.part.select("p_partkey", n(F.rank().over(w), "r"), n(F.dense_rank().over(w), "d"))


@query(f"SELECT o_orderkey, ntile(4) {_W} AS q FROM orders")
def win_ntile(t):
    return t.orders.select("o_orderkey", n(F.ntile(4).over(_by_cust()), "q"))


@query("SELECT p_partkey, round(percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6) AS pr, round(cume_dist() OVER (PARTITION BY p_brand ORDER BY p_size DESC), 6) AS cd FROM part")
def win_percent_cume(t):
    w = Window.partitionBy("p_brand").orderBy(c("p_size").desc())
    return t.part.select("p_partkey", F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"))


@query(f"SELECT o_orderkey, lag(o_totalprice, 1, 0) {_W} AS prev, lead(o_totalprice, 2) {_W} AS next2 FROM orders")
def win_lag_lead_default(t):
    return t.orders.select("o_orderkey", F.lag("o_totalprice", 1, 0.0).over(_by_cust()).alias("prev"), F.lead("o_totalprice", 2).over(_by_cust()).alias("next2"))


@query(f"SELECT o_orderkey, last_value(nullif(o_orderstatus, 'P') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s, first_value(nullif(o_orderstatus, 'P') IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {_frame}) AS f FROM orders")
def win_ignore_nulls(t):
    s = F.nullif(c("o_orderstatus"), lit("P"))
    run = _by_cust().rowsBetween(Window.unboundedPreceding, 0)
    every = _by_cust().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.last(s, ignorenulls=True).over(run).alias("s"), F.first(s, ignorenulls=True).over(every).alias("f"))


@query(f"SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey {_frame})")
def win_first_last_nth(t):
    w = _by_cust().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return t.orders.select("o_orderkey", F.first("o_orderkey").over(w).alias("f"), F.last("o_orderkey").over(w).alias("l"), F.nth_value("o_orderkey", 2).over(w).alias("n2"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM orders")
def win_rows_frame(t):
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(_by_cust().rowsBetween(-2, 0)), 2).alias("s3"), n(F.count("*").over(_by_cust().rowsBetween(Window.unboundedPreceding, 0)), "k"))


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS k, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM part")
def win_range_frame(t):
    w = Window.partitionBy("p_brand").orderBy("p_size")
    return t.part.select("p_partkey", n(F.count("*").over(w.rangeBetween(-3, 1)), "k"), n(F.sum("p_size").over(w.rangeBetween(Window.unboundedPreceding, 0)), "s"))


@query("SELECT o_custkey, count(*) AS k, rank() OVER (ORDER BY count(*) DESC) AS r, max(max(o_totalprice)) OVER () AS top FROM orders GROUP BY o_custkey")
def win_over_aggregate(t):
    per = t.orders.groupBy("o_custkey").agg(n(F.count("*"), "k"), F.max("o_totalprice").alias("m"))
    # counts repeat, so the few different ones are ranked, by how many groups stand before each, and joined back
    few = per.groupBy("k").agg(F.count("*").alias("groups"), F.max("m").alias("most"))
    before = Window.orderBy(c("k").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranks = few.select(c("k").alias("j"), n(F.coalesce(F.sum("groups").over(before), lit(0)) + 1, "r"), F.max("most").over(Window.partitionBy()).alias("top"))
    return per.join(ranks, c("k") == c("j")).select("o_custkey", "k", "r", "top")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2")
def win_top_n_per_group(t):
    return R.top_n(t.orders, ["o_custkey"], [c("o_totalprice").desc(), c("o_orderkey")], 2).select("o_custkey", "o_orderkey")


# ------------------------------------------------------------------ sort, limit, set operations


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey")
def sort_nulls_last(t):
    return t.orders.select("o_orderkey", F.nullif(c("o_orderstatus"), lit("F")).alias("s")).orderBy(c("s").desc_nulls_last(), "o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, 1 LIMIT 25")
def sort_ordinal_hidden(t):
    return t.orders.orderBy(c("o_totalprice").desc_nulls_last(), *R.ordinal(t.orders.select("o_orderkey"), [1])).select("o_orderkey").limit(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 15")
def limit_offset(t):
    return R.fetch(t.orders.select("o_orderkey", "o_totalprice"), D.last(c("o_totalprice"), c("o_orderkey")), 10, offset=15)


@query("SELECT p_partkey, p_size FROM (SELECT *, rank() OVER (ORDER BY p_size) AS r FROM part) WHERE r <= (SELECT max(r) FROM (SELECT r, row_number() OVER (ORDER BY p_size) AS k FROM (SELECT p_size, rank() OVER (ORDER BY p_size) AS r FROM part)) WHERE k <= 7)")
def fetch_with_ties(t):
    return R.fetch(t.part.select("p_partkey", "p_size"), D.last(c("p_size")), 7, ties=True)


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(t):
    return R.union(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return R.union(t.customer.select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"), every=True)


@query("SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return R.intersect(t.customer.where("c_acctbal < 0").select(c("c_nationkey").alias("k")), t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def except_(t):
    return R.difference(t.customer.select(c("c_custkey").alias("k")), t.supplier.where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey > 20 INTERSECT SELECT s_nationkey FROM supplier")
def set_op_precedence(t):
    right = R.intersect(t.nation.where("n_nationkey > 20").select("n_nationkey"), t.supplier.select("s_nationkey"))
    return R.union(t.nation.where("n_nationkey < 5").select(c("n_nationkey").alias("k")), right, every=True)


# ------------------------------------------------------------------ scalar functions


@query("SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey // (p_size % 7) END AS q, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_partkey % (p_size % 7) END AS m, round(CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_retailprice / (p_size % 7) END, 4) AS d FROM part")
def fn_arith_dialect(t):
    k = c("p_size") % 7
    return t.part.select("p_partkey", D.idiv(c("p_partkey"), k).alias("q"), D.modulo(c("p_partkey"), k).alias("m"), r4(D.divide(c("p_retailprice"), k), "d"))


@query("SELECT p_partkey, CASE WHEN regexp_matches(p_brand, '^[0-9]') THEN CAST(regexp_extract(p_brand, '^[0-9]+') AS BIGINT) ELSE 0 END AS i, CAST(nullif(regexp_extract(substr(p_name, 6), '^ *([0-9]+)', 1), '') AS DOUBLE) AS d FROM part")
def fn_cast_lenient(t):
    return t.part.select("p_partkey", D.to_int(c("p_brand")).alias("i"), D.to_double(c("p_name").substr(lit(6), F.length("p_name"))).alias("d"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'none') AS a, CASE WHEN nullif(o_orderstatus, 'F') = 'O' THEN 1 ELSE 2 END AS b FROM orders")
def fn_null_funcs(t):
    s = F.nullif(c("o_orderstatus"), lit("F"))
    return t.orders.select("o_orderkey", F.coalesce(s, lit("none")).alias("a"), D.iif(s == "O", lit(1), lit(2)).alias("b"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, CAST(strlen(p_name) AS BIGINT) AS b, substr(p_name, 2, 4) AS s, trim('  ' || p_brand || '  ') AS tr, ltrim('  ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt FROM part")
def fn_string_1(t):
    return t.part.select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_type").alias("l"), n(D.byte_length(c("p_name")), "b"), D.substr(c("p_name"), lit(2), lit(4)).alias("s"), D.trim(D.pipes(lit("  "), c("p_brand"), lit("  "))).alias("tr"), D.ltrim(D.pipes(lit("  "), c("p_brand"))).alias("lt"), D.rtrim(D.pipes(c("p_brand"), lit("  "))).alias("rt"))


@query("SELECT p_partkey, replace(p_name, '1', 'one') AS rp, reverse(p_brand) AS rv, starts_with(p_type, 'S') AS sw, CAST(instr(p_name, '2') AS BIGINT) AS i FROM part")
def fn_string_2(t):
    return t.part.select("p_partkey", D.replace(c("p_name"), "1", "one").alias("rp"), F.reverse("p_brand").alias("rv"), F.startswith(c("p_type"), lit("S")).alias("sw"), n(F.instr(c("p_name"), "2"), "i"))


@query("SELECT o_orderkey, concat(o_orderpriority, nullif(o_orderstatus, 'F')) AS a, o_orderpriority || nullif(o_orderstatus, 'F') AS b, concat_ws('-', o_orderpriority, nullif(o_orderstatus, 'F'), 'z') AS w FROM orders")
def fn_concat_semantics(t):
    s = F.nullif(c("o_orderstatus"), lit("F"))
    return t.orders.select("o_orderkey", D.concat(c("o_orderpriority"), s).alias("a"), D.pipes(c("o_orderpriority"), s).alias("b"), F.concat_ws("-", c("o_orderpriority"), s, lit("z")).alias("w"))


@query("SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN sqrt(c_acctbal) END, 6) AS sq, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 6) AS l, round(CASE WHEN c_acctbal > 0 THEN log10(c_acctbal) END, 6) AS l10, round(abs(c_acctbal), 2) AS ab, round(exp(c_acctbal / 10000), 6) AS e, round(power(c_acctbal, 2), 2) AS p, CAST(sign(c_acctbal) AS INTEGER) AS sg FROM customer")
def fn_math(t):
    x = c("c_acctbal")
    return t.customer.select("c_custkey", F.round(D.sqrt(x), 6).alias("sq"), F.round(D.ln(x), 6).alias("l"), F.round(D.log10(x), 6).alias("l10"), F.round(F.abs(x), 2).alias("ab"), F.round(F.exp(x / 10000), 6).alias("e"), F.round(F.pow(x, lit(2)), 2).alias("p"), F.signum(x).cast("int").alias("sg"))


@query("SELECT c_custkey, CAST(round(c_acctbal) AS BIGINT) AS r, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, CAST(trunc(c_acctbal) AS BIGINT) AS tr, CAST(c_custkey - floor(c_custkey / 7.0) * 7 AS BIGINT) AS m FROM customer")
def fn_round_trunc(t):
    x = c("c_acctbal")
    return t.customer.select("c_custkey", D.round_half_up(x).alias("r"), n(F.ceil(x), "ce"), n(F.floor(x), "fl"), D.truncate(x).alias("tr"), D.mod(c("c_custkey"), lit(7)).alias("m"))


@query("SELECT p_partkey, CASE WHEN nullif(p_size, 10) IS NULL THEN NULL ELSE greatest(p_size, 25) END AS g, CASE WHEN nullif(p_size, 10) IS NULL THEN NULL ELSE least(p_size, 25) END AS l FROM part")
def fn_greatest_least(t):
    s = F.nullif(c("p_size"), lit(10))
    return t.part.select("p_partkey", D.greatest(s, lit(25)).alias("g"), D.least(s, lit(25)).alias("l"))


@query("SELECT p_partkey, 'INTEGER' AS a, 'FLOAT' AS b, CASE WHEN nullif(p_size, 10) IS NULL THEN 'NULL' ELSE 'INTEGER' END AS d, 'VARCHAR' AS e FROM part")
def fn_typeof(t):
    df = t.part
    kind = dict(df.dtypes)
    return df.select("p_partkey", D.type_name(c("p_partkey"), kind["p_partkey"]).alias("a"), D.type_name(c("p_retailprice"), kind["p_retailprice"]).alias("b"), D.type_name(F.nullif(c("p_size"), lit(10)), kind["p_size"]).alias("d"), D.type_name(c("p_name"), kind["p_name"]).alias("e"))


@query("SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(month FROM ts) AS INTEGER) AS mo, CAST(extract(day FROM ts) AS INTEGER) AS d, CAST(extract(hour FROM ts) AS INTEGER) AS h, CAST(extract(minute FROM ts) AS INTEGER) AS mi, CAST(floor(extract(second FROM ts)) AS INTEGER) AS s FROM events")
def date_extract(t):
    return t.events.select("event_id", F.year("ts").alias("y"), F.month("ts").alias("mo"), F.day("ts").alias("d"), F.hour("ts").alias("h"), F.minute("ts").alias("mi"), F.second("ts").alias("s"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 10 DAY AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 YEAR AS DATE) AS b, o_orderdate + INTERVAL 5 HOUR AS h FROM orders")
def date_interval(t):
    d = c("o_orderdate").cast("date")
    return t.orders.select("o_orderkey", F.date_add(d, 10).alias("a"), D.add_months(d, -24).alias("b"), (c("o_orderdate") + F.expr("interval 5 hours")).alias("h"))


@query("SELECT CAST(d + INTERVAL (m) MONTH AS DATE) AS r, m FROM (SELECT DATE '2024-01-31' AS d, unnest([1, 2, 13, -11]) AS m)")
def date_month_clamp(t):
    return values(t.spark, [(1,), (2,), (13,), (-11,)], "m int").select(D.add_months(lit("2024-01-31").cast("date"), c("m")).alias("r"), "m")


# ------------------------------------------------------------------ common table expressions


@query("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT k FROM a WHERE s > (SELECT avg(s) FROM a)) SELECT c_mktsegment, count(*) AS n FROM b JOIN customer ON k = c_custkey GROUP BY c_mktsegment")
def cte_chain(t):
    a = t.orders.groupBy(c("o_custkey").alias("k")).agg(F.sum("o_totalprice").alias("s"))
    b = S.scalar(a, a.agg(F.avg("s").alias("v")), "mean").where("s > mean")
    return b.join(t.customer, c("k") == c("c_custkey")).groupBy("c_mktsegment").agg(n(F.count("*"), "n"))


@query("WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 150) SELECT i, CAST(i * i AS INTEGER) AS sq FROM s")
def cte_recursive_series(t):
    conf = "spark.sql.cteRecursionLevelLimit"
    if int(t.spark.conf.get(conf)) < 1000:
        t.spark.conf.set(conf, "1000")
    return t.spark.sql("WITH RECURSIVE s(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM s WHERE i < 150) SELECT i, i * i AS sq FROM s")


@query("WITH RECURSIVE g(k, d) AS (SELECT CAST(0 AS INTEGER), 0 UNION ALL SELECT n_nationkey, d + 1 FROM g JOIN nation ON n_nationkey = k * 2 + 1 OR n_nationkey = k * 2 + 2 WHERE d < 5) SELECT k, d FROM g")
def cte_recursive_graph(t):
    nodes = t.nation.select("n_nationkey")
    step = lambda d: d.join(nodes, (c("n_nationkey") == c("k") * 2 + 1) | (c("n_nationkey") == c("k") * 2 + 2)).where("d < 5").select(c("n_nationkey").alias("k"), (c("d") + 1).alias("d"))
    return R.recursive(values(t.spark, [(0, 0)], "k int, d int"), step)
