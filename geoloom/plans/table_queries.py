"""Queries over keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tables as tb
from .registry import query, table


@query("""
SELECT CASE WHEN status IS NULL THEN 'missing' ELSE 'present' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM (SELECT nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders) GROUP BY 1
""")
def q_split_na(spark, d):
    orders = table(spark, d, "orders").select(F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice")
    parts = zip(("present", "missing"), tb.split_na(orders, "status"))
    agg = [p.groupBy(F.lit(name).alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")) for name, p in parts]
    return tb.union_many(agg)


@query("""
SELECT l_orderkey AS li_l_orderkey, concat_ws('-', l_orderkey, l_linenumber) AS li_key,
       concat_ws('|', l_returnflag, l_linestatus) AS li_allnames FROM lineitem
""")
def q_prefix_key(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    li = tb.with_names(tb.with_key(li, ["l_orderkey", "l_linenumber"], "key"), ["l_returnflag", "l_linestatus"], "allnames")
    li = tb.with_prefix(li, "li_")
    return li.select("li_l_orderkey", F.concat_ws("-", "li_key.l_orderkey", "li_key.l_linenumber").alias("li_key"), F.array_join("li_allnames", "|").alias("li_allnames"))


_DUPS = "(l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {_DUPS}")
def q_dups_all_copies(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tb.duplicates(li, ["l_orderkey", "l_linenumber"])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE NOT {_DUPS}")
def q_dups_removed(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return tb.check_unique(li, ["l_orderkey", "l_linenumber"], ignore=True)


@query("SELECT o_orderkey AS orderkey, o_orderstatus AS status, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def q_merge_nodups(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linestatus").alias("status"), "l_linenumber", "l_quantity")
    return tb.merge_nodups(orders, li, ["orderkey"])


@query("SELECT c_custkey, c_name, c_nationkey AS nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_merge_addcols(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("nationkey"))
    nation = table(spark, d, "nation").withColumnRenamed("n_nationkey", "nationkey")
    return tb.merge_addcols(customer, nation, ["nationkey"], ["n_name"])


@query("""
WITH o AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_retailprice * 2 END AS price FROM part WHERE p_size < 5)
SELECT p_partkey, p_size, coalesce(o.price, p_retailprice) AS price FROM part LEFT JOIN o ON p_partkey = o.k
""")
def q_override_cols(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    new = F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice") * 2).alias("new_price")
    overrides = part.where("p_size < 5").select("p_partkey", new)
    return tb.override_cols(part, overrides, "p_partkey", [("p_retailprice", "new_price", "price")])


@query("""
WITH o AS (
  SELECT s_suppkey, CAST((s_nationkey + 1) % 25 AS INTEGER) AS n_nationkey FROM supplier WHERE s_acctbal < 1000 AND s_nationkey <> 7
), m AS (
  SELECT s_suppkey, n_nationkey FROM o
  UNION ALL
  SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 2 WHERE s_suppkey NOT IN (SELECT s_suppkey FROM o)
)
SELECT s.s_suppkey, s.s_name, m.n_nationkey, n.n_name FROM supplier s LEFT JOIN m ON s.s_suppkey = m.s_suppkey LEFT JOIN nation n ON m.n_nationkey = n.n_nationkey
""")
def q_match_left_join(spark, d):
    supplier, nation = table(spark, d, "supplier"), table(spark, d, "nation")
    near = nation.where("n_regionkey <> 2")
    links = supplier.join(near, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_nationkey")
    other = F.when(F.col("s_nationkey") != 7, (F.col("s_nationkey") + 1) % 25).cast("int").alias("n_nationkey")
    overrides = supplier.where("s_acctbal < 1000").select("s_suppkey", other)
    match = tb.Match(supplier.select("s_suppkey", "s_name"), nation, "s_suppkey", "n_nationkey", links)
    return match.left_join(overrides, right_cols=["n_name"]).select("s_suppkey", "s_name", "n_nationkey", "n_name")


@query("""
SELECT a.c_custkey, b.n_name FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a
JOIN (SELECT nullif(n_nationkey, 5) AS k, n_name FROM nation) b ON a.k IS NOT DISTINCT FROM b.k
""")
def q_null_safe_merge(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    b = table(spark, d, "nation").select(F.nullif("n_nationkey", F.lit(5)).alias("k"), "n_name")
    return tb.merge_null_safe(a, b, ["k"]).select("c_custkey", "n_name")


@query("""
SELECT cust, string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey) AS orders, string_agg(o_orderpriority, ',' ORDER BY o_orderkey) AS priorities
FROM (SELECT nullif(o_custkey, 7) AS cust, * FROM orders) WHERE cust IS NOT NULL GROUP BY cust
""")
def q_group_tuplelist(spark, d):
    orders = table(spark, d, "orders").withColumn("cust", F.nullif("o_custkey", F.lit(7)))
    lists = tb.group_tuples(orders, "cust", [("orders", ["o_orderkey", "o_orderstatus"]), ("priorities", ["o_orderpriority"])], ["o_orderkey"])
    text = lambda c, f: F.array_join(F.transform(c, f), ",").alias(c)
    return lists.select("cust", text("orders", lambda t: F.concat_ws(":", t["o_orderkey"], t["o_orderstatus"])), text("priorities", lambda t: t["o_orderpriority"]))


@query("SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def q_uniq_ordered(spark, d):
    return tb.first_occurrences(table(spark, d, "part"), "p_name", "p_partkey")


@query("""
WITH a AS (SELECT p_partkey, p_retailprice AS v FROM part WHERE p_size <> 1),
b AS (SELECT p_partkey, CASE WHEN p_size = 10 THEN p_retailprice * 1.001 WHEN p_size = 11 THEN p_retailprice * 1.000001 ELSE p_retailprice END AS v FROM part WHERE p_size <> 2)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey,
  CASE WHEN b.p_partkey IS NULL THEN 'extra0' WHEN a.p_partkey IS NULL THEN 'extra1' ELSE 'diff' END AS status
FROM a FULL JOIN b ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR NOT abs(a.v - b.v) <= 1e-8 + 1e-5 * abs(b.v)
""")
def q_diff_tables(spark, d):
    part = table(spark, d, "part")
    size, price = F.col("p_size"), F.col("p_retailprice")
    a = part.where(size != 1).select("p_partkey", price.alias("v"))
    b = part.where(size != 2).select("p_partkey", F.when(size == 10, price * F.lit(1.001)).when(size == 11, price * F.lit(1.000001)).otherwise(price).alias("v"))
    return tb.diff_tables(a, b, ["p_partkey"], "v")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error' AND user_id = 7")
def q_filter_attrs(spark, d):
    return tb.where_all(table(spark, d, "events"), {"event_type": "error", "user_id": 7}).select("event_id", "event_type")
