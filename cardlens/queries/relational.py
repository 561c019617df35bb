"""Relational queries, one text for Spark SQL and for the oracle.

The TPC-H-like ones follow the benchmark's shapes on tables that lack some of its columns: partsupp is derived from
lineitem, dates of commitment and receipt are replaced by the days between order and shipment, and constants fit the data.
They are not TPC-H results.
"""

from __future__ import annotations

import re

from cardlens.sources.tables import TABLES, register

PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) AS ps_supplycost, sum(l_quantity) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
REVENUE = "l_extendedprice * (1 - l_discount)"

TPCH = {
    "q1": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 1) AS sum_base_price,
        round(sum({REVENUE}), 1) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 1) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty,
        round(avg(l_extendedprice), 3) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= DATE '1998-12-01' - INTERVAL '90' DAY GROUP BY l_returnflag, l_linestatus""",
    "q2": f"""WITH offers AS (SELECT s.s_acctbal, s.s_name, n.n_name, ps.ps_partkey, round(ps.ps_supplycost, 6) AS cost
            FROM {PARTSUPP} ps JOIN supplier s ON s.s_suppkey = ps.ps_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey
            JOIN region r ON r.r_regionkey = n.n_regionkey WHERE r.r_name = 'EUROPE')
        SELECT o.s_acctbal, o.s_name, o.n_name, p.p_partkey FROM part p JOIN offers o ON o.ps_partkey = p.p_partkey
        WHERE p.p_size = 15 AND o.cost = (SELECT min(cost) FROM offers i WHERE i.ps_partkey = p.p_partkey)
        ORDER BY o.s_acctbal DESC, o.n_name, o.s_name, p.p_partkey LIMIT 100""",
    "q3": f"""SELECT l.l_orderkey, round(sum({REVENUE}), 2) AS revenue, o.o_orderdate FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
        JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < DATE '1998-03-15' AND l.l_shipdate > DATE '1998-03-15'
        GROUP BY l.l_orderkey, o.o_orderdate ORDER BY revenue DESC, o.o_orderdate, l.l_orderkey LIMIT 10""",
    "q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '30' DAY) GROUP BY o_orderpriority""",
    "q5": f"""SELECT n.n_name, round(sum({REVENUE}), 2) AS revenue FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
        WHERE r.r_name = 'ASIA' AND o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01' GROUP BY n.n_name""",
    "q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "q7": f"""SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(extract(YEAR FROM l.l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
            FROM supplier s JOIN lineitem l ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
            JOIN nation a ON a.n_nationkey = s.s_nationkey JOIN nation b ON b.n_nationkey = c.c_nationkey
            WHERE ((a.n_name = 'NATION_6' AND b.n_name = 'NATION_7') OR (a.n_name = 'NATION_7' AND b.n_name = 'NATION_6')) AND l.l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31') shipping
        GROUP BY supp_nation, cust_nation, l_year""",
    "q8": f"""SELECT o_year, round(sum(CASE WHEN nation = 'NATION_6' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
            SELECT CAST(extract(YEAR FROM o.o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, b.n_name AS nation FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey
            JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation a ON a.n_nationkey = c.c_nationkey
            JOIN region r ON r.r_regionkey = a.n_regionkey JOIN nation b ON b.n_nationkey = s.s_nationkey
            WHERE r.r_name = 'AMERICA' AND o.o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p.p_type = 'ECONOMY') shares GROUP BY o_year""",
    "q9": f"""SELECT nation, o_year, round(sum(amount), 1) AS sum_profit FROM (SELECT n.n_name AS nation, CAST(extract(YEAR FROM o.o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS amount
            FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN orders o ON o.o_orderkey = l.l_orderkey
            JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE p.p_name LIKE '%blue%') profit GROUP BY nation, o_year""",
    "q10": f"""SELECT c.c_custkey, c.c_name, round(sum({REVENUE}), 2) AS revenue, c.c_acctbal, n.n_name FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderdate >= DATE '1996-10-01' AND o.o_orderdate < DATE '1997-01-01' AND l.l_returnflag = 'R'
        GROUP BY c.c_custkey, c.c_name, c.c_acctbal, n.n_name ORDER BY revenue DESC, c.c_custkey LIMIT 20""",
    "q11": f"""WITH german AS (SELECT ps.ps_partkey, ps.ps_supplycost * ps.ps_availqty AS worth FROM {PARTSUPP} ps JOIN supplier s ON s.s_suppkey = ps.ps_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_name = 'NATION_7')
        SELECT ps_partkey, round(sum(worth), 2) AS total FROM german GROUP BY ps_partkey HAVING sum(worth) > (SELECT sum(worth) * 0.002 FROM german)""",
    "q12": """SELECT l.l_returnflag, CAST(sum(CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END) AS BIGINT) AS low_line_count
        FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag IN ('A', 'R') AND l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1997-01-01' AND l.l_shipdate > o.o_orderdate GROUP BY l.l_returnflag""",
    "q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c.c_custkey, count(o.o_orderkey) AS c_count FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderpriority NOT LIKE '%URGENT%' GROUP BY c.c_custkey) counts GROUP BY c_count""",
    "q14": f"""SELECT round(100.00 * sum(CASE WHEN p.p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
        WHERE l.l_shipdate >= DATE '1996-09-01' AND l.l_shipdate < DATE '1996-10-01'""",
    "q15": f"""WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
        SELECT s.s_suppkey, s.s_name, r.total_revenue FROM supplier s JOIN revenue r ON s.s_suppkey = r.supplier_no WHERE r.total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    "q16": f"""SELECT p.p_brand, p.p_type, p.p_size, count(DISTINCT ps.ps_suppkey) AS supplier_cnt FROM {PARTSUPP} ps JOIN part p ON p.p_partkey = ps.ps_partkey
        WHERE p.p_brand <> 'Brand#5' AND p.p_type NOT LIKE 'MEDIUM%' AND p.p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND ps.ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
        GROUP BY p.p_brand, p.p_type, p.p_size""",
    "q17": """SELECT round(sum(l.l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE p.p_brand = 'Brand#3' AND l.l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p.p_partkey)""",
    "q18": """SELECT c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice, round(sum(l.l_quantity), 2) AS quantity FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
        WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
        GROUP BY c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice ORDER BY o.o_totalprice DESC, o.o_orderdate, o.o_orderkey LIMIT 100""",
    "q19": f"""SELECT round(sum({REVENUE}), 2) AS revenue FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE (p.p_brand = 'Brand#12' AND l.l_quantity BETWEEN 1 AND 11 AND p.p_size BETWEEN 1 AND 15)
        OR (p.p_brand = 'Brand#23' AND l.l_quantity BETWEEN 10 AND 20 AND p.p_size BETWEEN 1 AND 30) OR (p.p_brand = 'Brand#4' AND l.l_quantity BETWEEN 20 AND 30 AND p.p_size BETWEEN 1 AND 45)""",
    "q20": f"""SELECT s.s_name FROM supplier s JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_name = 'NATION_3' AND s.s_suppkey IN (SELECT ps.ps_suppkey FROM {PARTSUPP} ps
            WHERE ps.ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%blue%') AND ps.ps_availqty > (SELECT 0.5 * sum(l.l_quantity) FROM lineitem l
            WHERE l.l_partkey = ps.ps_partkey AND l.l_suppkey = ps.ps_suppkey AND l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1997-01-01'))""",
    "q21": """SELECT s.s_name, count(*) AS numwait FROM supplier s JOIN lineitem a ON s.s_suppkey = a.l_suppkey JOIN orders o ON o.o_orderkey = a.l_orderkey JOIN nation n ON n.n_nationkey = s.s_nationkey
        WHERE o.o_orderstatus = 'F' AND a.l_shipdate > o.o_orderdate + INTERVAL '30' DAY AND n.n_name IN ('NATION_3', 'NATION_4', 'NATION_5') AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem d WHERE d.l_orderkey = a.l_orderkey AND d.l_suppkey <> a.l_suppkey AND d.l_returnflag = 'R') GROUP BY s.s_name ORDER BY numwait DESC, s.s_name LIMIT 100""",
    "q22": """SELECT substring(c_mktsegment FROM 1 FOR 2) AS code, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
        WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1998-01-01' AND o_totalprice > 300000) GROUP BY substring(c_mktsegment FROM 1 FOR 2)""",
}
LOIC = "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey"
SYNTHETIC = {
    "s1": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000",
    "s2": "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'O'",
    "s3": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' AND l.l_quantity > 45",
    "s4": f"SELECT l.l_orderkey, l.l_linenumber FROM {LOIC} JOIN part p ON l.l_partkey = p.p_partkey WHERE c.c_mktsegment = 'BUILDING' AND p.p_type = 'PROMO' AND o.o_totalprice > 200000",
    "s5": f"SELECT l.l_orderkey, l.l_linenumber FROM {LOIC} WHERE c.c_mktsegment = 'MACHINERY' AND o.o_orderstatus = 'P'",
    "s6": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice < 20000",
    "s7": "SELECT l.l_orderkey, l.l_linenumber FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_brand = 'Brand#7'",
    "s8": "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_totalprice < 10000",
    "s9": f"SELECT l.l_orderkey, l.l_linenumber FROM {LOIC} WHERE c.c_nationkey < 5 AND c.c_mktsegment = 'FURNITURE' AND o.o_orderstatus = 'O' AND o.o_totalprice > 100000",
    "s10": f"SELECT l.l_orderkey, l.l_linenumber FROM {LOIC} JOIN part p ON l.l_partkey = p.p_partkey WHERE c.c_mktsegment = 'BUILDING' AND p.p_size BETWEEN 5 AND 20 AND o.o_totalprice BETWEEN 50000 AND 300000 AND l.l_quantity >= 30",
}
E2E = {
    "s1": "SELECT count(*) AS n FROM lineitem WHERE l_discount BETWEEN 0.04 AND 0.06",
    "s2": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 1000",
    "s3": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "s4": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50",
    "s5": "SELECT event_id FROM events WHERE event_id BETWEEN 1000 AND 1500 ORDER BY ts, event_id",
    "s6": "SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l.l_discount > 0.05",
    "s7": "SELECT l.l_orderkey, l.l_linenumber, s.s_name, p.p_brand FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_discount > 0.05",
    "s8": "SELECT count(*) AS n FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE l.l_quantity > 15",
    "s9": "SELECT event_type, round(sum(value), 4) AS total FROM events WHERE event_id > 500 GROUP BY event_type",
    "s10": "SELECT count(*) AS n FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 25)",
}
#: Snowflake joins with minima over many kinds of predicate, and the plan shapes that statistics are tested on.
SHAPES = {
    "snowflake_min": """SELECT min(p.p_name) AS part_name, min(s.s_name) AS supplier_name, min(c.c_name) AS customer_name FROM lineitem l, orders o, customer c, part p, supplier s, nation ns, nation nc, region r
        WHERE l.l_orderkey = o.o_orderkey AND o.o_custkey = c.c_custkey AND l.l_partkey = p.p_partkey AND l.l_suppkey = s.s_suppkey AND s.s_nationkey = ns.n_nationkey AND c.c_nationkey = nc.n_nationkey
        AND nc.n_regionkey = r.r_regionkey AND r.r_name IN ('ASIA', 'EUROPE') AND p.p_name LIKE '%blue%' AND (o.o_orderstatus = 'F' OR o.o_totalprice BETWEEN 1000 AND 50000) AND p.p_size != 7 AND s.s_name IS NOT NULL""",
    "snowflake_notes": """SELECT min(o.o_orderpriority) AS priority, min(p.p_name) AS part_name, min(s.s_name) AS supplier_name FROM part p, lineitem l, orders o, supplier s
        WHERE p.p_type = 'PROMO' AND o.o_orderpriority NOT LIKE '%URGENT%' AND (o.o_orderpriority LIKE '%HIGH%' OR o.o_orderpriority LIKE '%LOW%') AND s.s_acctbal < 2000
        AND p.p_partkey = l.l_partkey AND l.l_orderkey = o.o_orderkey AND s.s_suppkey = l.l_suppkey""",
    "snowflake_keyword": """SELECT min(c.c_name) AS customer_name FROM nation n, part p, lineitem l, orders o, customer c
        WHERE n.n_name = 'NATION_7' AND p.p_name = 'small ring' AND n.n_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_partkey = p.p_partkey""",
    "snowflake_in_list": """SELECT min(p.p_name) AS part_name, max(o.o_totalprice) AS dearest FROM part p, lineitem l, orders o, customer c, nation n
        WHERE p.p_name LIKE '%ring%' AND n.n_name IN ('NATION_1', 'NATION_4', 'NATION_9', 'NATION_16') AND o.o_orderdate > DATE '1997-06-30'
        AND p.p_partkey = l.l_partkey AND o.o_orderkey = l.l_orderkey AND c.c_custkey = o.o_custkey AND n.n_nationkey = c.c_nationkey""",
    "snowflake_rating": """SELECT min(l.l_extendedprice) AS cheapest, min(p.p_name) AS part_name FROM region r, nation n, supplier s, lineitem l, part p
        WHERE r.r_name = 'ASIA' AND p.p_type LIKE '%ECONOMY%' AND l.l_discount > 0.05 AND p.p_size BETWEEN 10 AND 20 AND r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey
        AND s.s_suppkey = l.l_suppkey AND l.l_partkey = p.p_partkey""",
    "snowflake_two_nations": """SELECT min(ns.n_name) AS supplier_nation, min(nc.n_name) AS customer_nation, min(p.p_brand) AS brand FROM nation ns, nation nc, region r, supplier s, customer c, orders o, lineitem l, part p
        WHERE ns.n_name != 'NATION_0' AND (nc.n_name LIKE '%_1%' OR nc.n_name LIKE '%_2%') AND ns.n_regionkey = nc.n_regionkey AND ns.n_regionkey = r.r_regionkey AND nc.n_regionkey = r.r_regionkey AND r.r_name != 'AFRICA'
        AND s.s_nationkey = ns.n_nationkey AND c.c_nationkey = nc.n_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND l.l_partkey = p.p_partkey AND o.o_orderstatus = 'P'""",
    "snowflake_linked": """SELECT min(c.c_name) AS customer_name, min(a.o_orderkey) AS first_order, min(b.o_orderkey) AS linked_order FROM customer c, orders a, orders b, nation n
        WHERE a.o_custkey = c.c_custkey AND b.o_custkey = c.c_custkey AND a.o_custkey = b.o_custkey AND a.o_orderkey != b.o_orderkey AND a.o_orderpriority = '1-URGENT' AND b.o_orderpriority = '5-LOW'
        AND a.o_totalprice > 300000 AND b.o_totalprice < 100000 AND n.n_nationkey = c.c_nationkey AND n.n_name BETWEEN 'NATION_1' AND 'NATION_3'""",
    "snowflake_two_infos": """SELECT min(p.p_name) AS returned_part, min(q.p_name) AS kept_part, count(*) AS pairs FROM lineitem a, lineitem b, orders o, part p, part q
        WHERE a.l_orderkey = o.o_orderkey AND b.l_orderkey = o.o_orderkey AND a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N' AND a.l_partkey = p.p_partkey AND b.l_partkey = q.p_partkey
        AND p.p_type = 'SMALL' AND q.p_type = 'LARGE' AND o.o_orderstatus = 'O'""",
    "snowflake_not_null": """SELECT min(s.s_name) AS supplier_name, min(c.c_mktsegment) AS segment FROM supplier s, nation n, customer c, orders o, lineitem l
        WHERE s.s_name IS NOT NULL AND (s.s_name LIKE '%1%' OR s.s_name LIKE 'S%') AND ((c.c_mktsegment = 'MACHINERY' AND c.c_acctbal > 5000) OR (c.c_mktsegment = 'BUILDING' AND c.c_acctbal < 1000)) AND n.n_nationkey = s.s_nationkey
        AND n.n_nationkey = c.c_nationkey AND s.s_nationkey = c.c_nationkey AND c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey""",
    "snowflake_wide": """SELECT min(p.p_name) AS part_name, min(q.p_name) AS other_part, min(t.s_name) AS other_supplier, min(c.c_name) AS customer_name
        FROM orders o, customer c, nation nc, region rc, lineitem a, part p, supplier s, nation ns, region rs, lineitem b, part q, supplier t, nation nt, region rt
        WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = nc.n_nationkey AND nc.n_regionkey = rc.r_regionkey AND a.l_orderkey = o.o_orderkey AND a.l_partkey = p.p_partkey AND a.l_suppkey = s.s_suppkey
        AND s.s_nationkey = ns.n_nationkey AND ns.n_regionkey = rs.r_regionkey AND b.l_orderkey = o.o_orderkey AND b.l_orderkey = a.l_orderkey AND b.l_partkey = q.p_partkey AND b.l_suppkey = t.s_suppkey
        AND t.s_nationkey = nt.n_nationkey AND nt.n_regionkey = rt.r_regionkey AND rc.r_name = 'EUROPE' AND rs.r_name IN ('ASIA', 'AMERICA') AND rt.r_name != 'EUROPE' AND p.p_size > 40 AND q.p_brand LIKE 'Brand#1%' AND a.l_linenumber != b.l_linenumber""",
    "snowflake_no_match": """SELECT min(p.p_name) AS part_name, min(s.s_name) AS supplier_name FROM part p, lineitem l, supplier s
        WHERE p.p_partkey = l.l_partkey AND l.l_suppkey = s.s_suppkey AND p.p_brand = 'Brand#3' AND s.s_name LIKE '%no such name%'""",
    "cyclic_4way": """SELECT count(*) AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey AND s.s_nationkey = c.c_nationkey""",
    "null_join_keys": """SELECT count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey END AS k FROM orders) a JOIN (SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey END AS k FROM customer) b ON a.k = b.k""",
    "empty_side_join": "SELECT count(*) AS n FROM orders o JOIN (SELECT * FROM customer WHERE c_custkey < 0) c ON o.o_custkey = c.c_custkey",
    "semi_not_equal": "SELECT count(*) AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)",
    "non_equi_nested_loop": "SELECT count(*) AS n FROM nation a JOIN supplier b ON a.n_nationkey < b.s_nationkey",
}
#: FROM lists for Spark, which joins in their order: customers meet suppliers of their nation or region only by way of their own orders.
FROM = {
    "snowflake_two_nations": "customer c, nation nc, region r, orders o, lineitem l, supplier s, nation ns, part p",
    "snowflake_not_null": "customer c, orders o, lineitem l, supplier s, nation n",
}
TEXTS = {f"tpch_{k}": v for k, v in TPCH.items()} | {f"synthetic_{k}": v for k, v in SYNTHETIC.items()} | {f"e2e_{k}": v for k, v in E2E.items()} | SHAPES


def _query(name: str, text: str):
    if name in FROM:
        text = re.sub(r"\bFROM .*?\s+WHERE ", f"FROM {FROM[name]} WHERE ", text, count=1, flags=re.S)
    used = tuple(t for t in TABLES if re.search(rf"\b{t}\b", text))

    def run(spark, sf_dir: str):
        register(spark, sf_dir, used)
        return spark.sql(text)

    return run


QUERIES = {name: _query(name, text) for name, text in TEXTS.items()}
ORACLE_SQL = dict(TEXTS)
