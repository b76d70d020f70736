"""P1-P17, W1-W5, U1-U6 on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import bind, table
from cellweave.operators import frames as fr
from cellweave.operators import ordered as od

E6 = 6


@bind("p1_select_listed", "SELECT l_partkey, l_quantity, l_extendedprice FROM lineitem")
def p1(spark, d):
    return fr.select_listed(table(spark, d, "lineitem"), ["l_partkey", "l_quantity", "l_extendedprice"])


@bind("p1_select_span", "SELECT p_brand, p_type, p_size FROM part")
def p1b(spark, d):
    return fr.select_span(table(spark, d, "part"), "p_brand", "p_size")


@bind("p2_select_like", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem")
def p2(spark, d):
    return fr.select_like(table(spark, d, "lineitem"), "key")


@bind("p3_rename_prefix", "SELECT s_suppkey, s_name AS fish_s_name, s_nationkey, s_acctbal AS fish_s_acctbal FROM supplier")
def p3(spark, d):
    return fr.prefix_unless(table(spark, d, "supplier"), "fish_", "key")


@bind("p4_drop_like", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def p4(spark, d):
    return fr.drop_like(fr.drop_like(table(spark, d, "orders"), "status"), "date")


@bind("p5_filter", "SELECT l_partkey, l_extendedprice FROM lineitem WHERE l_partkey > 0 AND l_extendedprice > 50000")
def p5(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", "l_extendedprice")
    return li.where((F.col("l_partkey") > 0) & (F.col("l_extendedprice") > 50000))


@bind("p6_text_predicate", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND value > 20")
def p6(spark, d):
    ev = table(spark, d, "events").select("event_id", "event_type", "value")
    return fr.where_text(ev, "(event_type == 'click') & (value > 20)")


@bind("p8_range_crop", """SELECT l_orderkey, l_quantity, l_discount FROM lineitem
WHERE l_quantity BETWEEN 10 AND 20 AND l_discount BETWEEN CAST(0.02 AS DOUBLE) AND CAST(0.05 AS DOUBLE)""")
def p8(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount")
    return fr.crop(li, "l_quantity", "l_discount", (10, 20), (0.02, 0.05))


@bind("p9_min_above", """SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem
WHERE least(l_quantity, l_extendedprice / 1000) > 20""")
def p9(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice")
    scaled = li.withColumn("scaled", F.col("l_extendedprice") / 1000)
    return fr.min_above(scaled, ["l_quantity", "scaled"], 20).drop("scaled")


@bind("p10_assign_where", """SELECT o_orderkey,
CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE o_orderstatus END AS o_orderstatus,
CASE WHEN o_orderstatus = 'P' THEN '0-NONE' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def p10(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return fr.assign_where(o, F.col("o_orderstatus") == "P", {"o_orderpriority": "0-NONE", "o_orderstatus": "pending"})


@bind("p11_label_from_name", """SELECT page_id,
CASE WHEN contains(lower(url), '.example.com') THEN 'com' ELSE 'other' END AS site FROM pages""")
def p11(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", fr.label_if_contains(F.col("url"), ".Example.com", "com", "other").alias("site"))


@bind("p12_fill_round", """SELECT c_custkey,
round_even(CAST(coalesce(CASE WHEN c_acctbal > 0 THEN c_acctbal / 8 END, 0) AS DOUBLE), 1) AS bal
FROM customer""")
def p12(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") / 8).alias("bal"))
    return fr.fill_and_round(c, ["bal"], 1)


@bind("p13_drop_missing", """SELECT d.doc_id, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id
WHERE l.quality IS NOT NULL AND l.toxic IS NOT NULL""")
def p13(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    joined = docs.join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")
    return fr.drop_missing(joined)


@bind("p14_row_sum", """SELECT l_orderkey, l_linenumber,
round(l_quantity + coalesce(CASE WHEN l_discount > 0 THEN l_discount END, 0) + l_tax, 6) AS total FROM lineitem""")
def p14(spark, d):
    li = table(spark, d, "lineitem").withColumn("disc", F.when(F.col("l_discount") > 0, F.col("l_discount")))
    return li.select("l_orderkey", "l_linenumber", F.round(fr.row_sum(["l_quantity", "disc", "l_tax"]), E6).alias("total"))


@bind("p15_class_indicators", """SELECT o_orderkey,
o_orderpriority <> '3-MEDIUM' AND (o_orderstatus = 'F') AS "F",
o_orderpriority <> '3-MEDIUM' AND (o_orderstatus = 'O') AS "O",
o_orderpriority <> '3-MEDIUM' AND (o_orderpriority = '1-URGENT') AS "1-URGENT"
FROM orders""")
def p15(spark, d):
    cls = F.when(F.col("o_orderpriority") == "3-MEDIUM", "Ignore*").otherwise(
        F.concat_ws(": ", "o_orderstatus", "o_orderpriority"))
    o = table(spark, d, "orders").select("o_orderkey", cls.alias("cls"))
    return fr.class_indicators(o, "cls", ["F", "O", "1-URGENT"]).drop("cls")


@bind("p16_gate", """SELECT l_orderkey, l_linenumber, l_quantity > 25 AS "l_quantity+", l_tax > CAST(0.04 AS DOUBLE) AS "l_tax+" FROM lineitem""")
def p16(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return fr.gate(li, {"l_quantity": 25.0, "l_tax": 0.04}).drop("l_quantity", "l_tax")


@bind("p16_gate_long", """WITH g AS (SELECT event_type, round(avg(value), 2) AS gate FROM events GROUP BY event_type)
SELECT e.event_id, e.event_type, e.value > g.gate AS positive FROM events e JOIN g ON e.event_type = g.event_type""")
def p16b(spark, d):
    ev = table(spark, d, "events")
    gates = ev.groupBy("event_type").agg(F.round(F.avg("value"), 2).alias("gate"))
    return fr.gate_long(ev, gates, "event_type", "value").select("event_id", "event_type", "positive")


@bind("p17_flag_sort", "SELECT p_partkey, p_name, contains(p_name, 'ring') AS has_ring FROM part")
def p17(spark, d):
    return fr.flag_contains(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "ring", "has_ring")


@bind("w1_sort", "SELECT l_suppkey, l_partkey, l_quantity FROM lineitem ORDER BY 1, 2, 3")
def w1(spark, d):
    li = table(spark, d, "lineitem")
    return li.select("l_suppkey", "l_partkey", "l_quantity").orderBy("l_suppkey", "l_partkey", "l_quantity")


@bind("w2_top_n", """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def w2(spark, d):
    return fr.top_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20, ["o_orderkey"])


@bind("w3_arg_max", """SELECT l_suppkey, l_linenumber, s AS score FROM (
SELECT l_suppkey, l_linenumber, sum(l_quantity) AS s,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY sum(l_quantity) DESC, l_linenumber) AS rn
FROM lineitem GROUP BY l_suppkey, l_linenumber) WHERE rn = 1""")
def w3(spark, d):
    planes = table(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.sum("l_quantity").alias("score"))
    return fr.arg_max(planes, ["l_suppkey"], "l_linenumber", "score")


@bind("w4_fill_down", """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN CAST(user_id AS VARCHAR) END IGNORE NULLS)
OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS label FROM events""")
def w4(spark, d):
    ev = table(spark, d, "events").select(
        "event_id", F.when(F.col("event_type") == "purchase", F.col("user_id").cast("string")).alias("label"))
    return fr.fill_down(ev, "event_id", "label")


@bind("w5_cumulative", """SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS running,
round(sum(value) OVER (ORDER BY event_id), 2) AS overall FROM events""")
def w5(spark, d):
    ev = table(spark, d, "events").select("event_id", "user_id", "value")
    one = fr.cumulative(ev, "event_id", "value", ["user_id"], "running")
    two = fr.cumulative(one, "event_id", "value", [], "overall")
    return two.select("event_id", "user_id", F.round("running", 4).alias("running"), F.round("overall", 2).alias("overall"))


@bind("w5_running_product", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS l0, CAST(p_size AS DOUBLE) * 2 AS l1,
CAST(p_size AS DOUBLE) * 8 AS l2 FROM part""")
def w5b(spark, d):
    steps = F.array(F.col("p_size").cast("double"), F.lit(2.0), F.lit(4.0))
    levels = table(spark, d, "part").select("p_partkey", fr.running_product(steps).alias("v"))
    return levels.select("p_partkey", *[F.col("v")[i].alias(f"l{i}") for i in range(3)])


@bind("u1_union", """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, CAST(NULL AS VARCHAR) AS segment FROM supplier
UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""")
def u1(spark, d):
    s = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal bal")
    c = table(spark, d, "customer").selectExpr("c_custkey id", "c_name name", "c_acctbal bal", "c_mktsegment segment")
    return fr.stack([s, c])


@bind("u2_seen_exactly", """SELECT l_orderkey, l_linenumber, min(l_partkey) AS first_pos, count(*) AS n
FROM lineitem GROUP BY 1, 2 HAVING count(*) = 2""")
def u2(spark, d):
    return fr.seen_exactly(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], "l_partkey", 2)


@bind("u3_joined_names", """SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand WHEN p_brand < p_type
THEN p_brand || ', ' || p_type ELSE p_type || ', ' || p_brand END AS names FROM part""")
def u3(spark, d):
    p = table(spark, d, "part").withColumn("none", F.lit(""))
    return p.select("p_partkey", fr.joined_names(["p_type", "p_brand", "none"]).alias("names"))


def hash_sql(seed, *keys):
    text = " || '|' || ".join([f"'{seed}'", *(f"coalesce('v' || CAST({k} AS VARCHAR), 'null')" for k in keys)])
    return f"CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT)"


@bind("u4_sample_fraction", f"SELECT * FROM lineitem WHERE {hash_sql(7, 'l_orderkey', 'l_linenumber')} < {int(0.05 * (1 << 48))}")
def u4(spark, d):
    return fr.sample_fraction(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], 0.05, 7)


@bind("u4_sample_rows", f"SELECT * FROM orders ORDER BY {hash_sql(1001, 'o_orderkey')}, o_orderkey LIMIT 200")
def u4b(spark, d):
    return fr.sample_rows(table(spark, d, "orders"), ["o_orderkey"], 200, 1001)


def stratified_sql(rows, key, value, p0, seed, per):
    """Quarters of the values above a quantile, the first ``per`` keys of each by hash, the last one repeated in short bins."""
    return f"""WITH t AS ({rows}), lim AS (SELECT quantile_cont({value}, CAST({p0} AS DOUBLE)) AS p0 FROM t), v AS (SELECT {key} AS k, {value} AS x FROM t, lim WHERE {value} > p0),
e AS (SELECT quantile_cont(x, 0.25::DOUBLE) AS a, quantile_cont(x, 0.5::DOUBLE) AS b, quantile_cont(x, 0.75::DOUBLE) AS c FROM v),
b AS (SELECT k, x, 1 + (CASE WHEN x >= a THEN 1 ELSE 0 END) + (CASE WHEN x >= b THEN 1 ELSE 0 END) + (CASE WHEN x >= c THEN 1 ELSE 0 END) AS bin FROM v, e),
r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY {hash_sql(seed, 'k')}, k) AS slot, count(*) OVER (PARTITION BY bin) AS n FROM b),
s AS (SELECT k, x, bin, CASE WHEN slot = n AND n < {per} THEN range(slot, {per} + 1) ELSE [slot] END AS slots FROM r WHERE slot <= {per})
SELECT k AS {key}, x AS {value}, CAST(bin AS INTEGER) AS bin, CAST(unnest(slots) AS INTEGER) AS slot FROM s"""


@bind("u5_stratified_counts", stratified_sql("SELECT * FROM orders", "o_orderkey", "o_totalprice", 0.3, 3, 8))
def u5(spark, d):
    picked = fr.stratified_sample(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], 4, 8, p0=0.3, seed=3)
    return picked.select("o_orderkey", "o_totalprice", "bin", "slot")


@bind("u5_short_bins", stratified_sql("SELECT * FROM supplier", "s_suppkey", "s_acctbal", 0.1, 5, 300))
def u5b(spark, d):
    """Bins with fewer items than asked for repeat their last one."""
    picked = fr.stratified_sample(table(spark, d, "supplier"), "s_acctbal", ["s_suppkey"], 4, 300, p0=0.1, seed=5)
    return picked.select("s_suppkey", "s_acctbal", "bin", "slot")


@bind("u5_full_tiles", stratified_sql("""SELECT o_custkey // 8 * 1000 + (o_orderkey % 300) // 7 AS tile, avg(o_totalprice) AS mean FROM orders, (SELECT max(o_custkey) AS high FROM orders)
WHERE o_custkey // 8 * 8 + 8 <= high + 1 AND (o_orderkey % 300) // 7 < 42 GROUP BY 1""", "tile", "mean", 0.2, 9, 5).replace("x AS mean", "round(x, 4) AS mean"))
def u5c(spark, d):
    """Tiles of 8 x 7 pixels of an image that they don't fill; the cut ones at its border are left out."""
    o = table(spark, d, "orders").selectExpr("o_custkey y", "o_orderkey % 300 x", "o_totalprice v")
    ends = o.agg(F.max("y").alias("high"))
    per = o.selectExpr("floor(y / 8) r", "floor(x / 7) c", "v").groupBy("r", "c").agg(F.avg("v").alias("mean"))
    sized = od.attach_one_row(per, ends).selectExpr("r * 1000 + c as tile", "mean", "least(8, high + 1 - r * 8) + 0 as h", "least(7, 300 - c * 7) + 1 as w")
    picked = fr.stratified_sample(fr.full_tiles(sized, 8), "mean", ["tile"], 4, 5, p0=0.2, seed=9)
    return picked.select("tile", F.round("mean", 4).alias("mean"), "bin", "slot")


@bind("u6_combine_cycles", """SELECT l_linestatus AS cycle, l_linenumber AS channel, sum(CAST(l_quantity AS BIGINT))::BIGINT AS px
FROM lineitem WHERE l_linestatus = 'F' OR l_linenumber <> 1 GROUP BY 1, 2""")
def u6(spark, d):
    ch = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("cycle"), F.col("l_linenumber").alias("channel")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("px"))
    sized = ch.withColumns({"h": F.lit(64), "w": F.lit(32)})
    return fr.combine_cycles(sized, "F", 1).select("cycle", "channel", "px")
