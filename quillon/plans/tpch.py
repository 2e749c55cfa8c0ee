"""The 22 analytic queries, over the columns that the tables here have.

Each text runs on Spark and, by ``for_duckdb``, on DuckDB.  Where a query of the benchmark needs a
column or a literal that these tables lack, the nearest thing stands in; ``STANDS_IN`` says which.
``partsupp`` is made from the line items: the cheapest price of a part at a supplier, and what was
sold of it.  Doubles are rounded, so that the order of summation does not show.
"""

from __future__ import annotations

PARTSUPP = """ps AS (
  SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey,
         MIN(l_extendedprice / l_quantity) AS ps_supplycost, SUM(l_quantity) AS ps_availqty
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""

STANDS_IN = {
    "q2": "p_type instead of a type ending; partsupp from line items",
    "q3": "no order comment or ship priority",
    "q4": "shipped more than 60 days after the order, instead of commit before receipt",
    "q5": "dates in 1996",
    "q6": "dates in 1996",
    "q7": "NATION_1 and NATION_2",
    "q8": "NATION_3 in AMERICA; type ECONOMY",
    "q9": "part names with 'red'; partsupp from line items",
    "q10": "dates in 1996; no address, phone or comment",
    "q11": "partsupp from line items",
    "q12": "return flag instead of ship mode; dates in 1996",
    "q13": "order priority instead of the comment",
    "q16": "suppliers in debt instead of complaints; partsupp from line items",
    "q17": "no container",
    "q18": "quantity above 200",
    "q19": "type instead of container",
    "q20": "part names with 'blue'; partsupp from line items",
    "q21": "shipped more than 60 days after the order, instead of receipt after commit",
    "q22": "last digit of the name instead of the country code of the phone",
}

QUERIES: dict[str, str] = {
    "q1_pricing_summary": """
SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       ROUND(AVG(l_quantity), 4) AS avg_qty, ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 6) AS avg_disc,
       COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "q2_minimum_cost_supplier": f"""
WITH {PARTSUPP},
offers AS (
  SELECT p_partkey, s_suppkey, s_name, s_acctbal, n_name, ps_supplycost
  FROM part JOIN ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE p_size = 15 AND p_type = 'ECONOMY' AND r_name = 'EUROPE'),
cheapest AS (SELECT p_partkey AS c_partkey, MIN(ps_supplycost) AS c_cost FROM offers GROUP BY p_partkey)
SELECT ROUND(s_acctbal, 2) AS s_acctbal, s_name, n_name, p_partkey, ROUND(ps_supplycost, 4) AS ps_supplycost
FROM offers JOIN cheapest ON p_partkey = c_partkey AND ps_supplycost = c_cost
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "q3_shipping_priority": """
SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "q4_order_priority": """
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-10-01 00:00:00'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL 60 DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "q5_local_supplier_volume": """
SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
     JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
     JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'
GROUP BY n_name ORDER BY revenue DESC, n_name""",
    "q6_forecast_revenue": """
SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
  AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24""",
    "q7_volume_shipping": """
SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(YEAR(l_shipdate) AS INT) AS l_year,
       ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
     JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
  AND l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1996-12-31 00:00:00'
GROUP BY n1.n_name, n2.n_name, YEAR(l_shipdate) ORDER BY supp_nation, cust_nation, l_year""",
    "q8_national_market_share": """
SELECT o_year, ROUND(SUM(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0.0E0 END) / SUM(volume), 6) AS mkt_share
FROM (SELECT CAST(YEAR(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation
      FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
           JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
           JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey
           JOIN nation n2 ON s_nationkey = n2.n_nationkey
      WHERE r_name = 'AMERICA' AND p_type = 'ECONOMY'
        AND o_orderdate >= TIMESTAMP '1995-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1996-12-31 00:00:00') all_nations
GROUP BY o_year ORDER BY o_year""",
    "q9_product_type_profit": f"""
WITH {PARTSUPP}
SELECT n_name AS nation, CAST(YEAR(o_orderdate) AS INT) AS o_year,
       ROUND(SUM(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit
FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
     JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey
     JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
WHERE p_name LIKE '%red%' GROUP BY n_name, YEAR(o_orderdate) ORDER BY nation, o_year DESC""",
    "q10_returned_item": """
SELECT c_custkey, c_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(c_acctbal, 2) AS c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "q11_important_stock": f"""
WITH {PARTSUPP},
stock AS (SELECT ps_partkey, SUM(ps_supplycost * ps_availqty) AS part_value
          FROM ps JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
          WHERE n_name = 'NATION_7' GROUP BY ps_partkey),
total AS (SELECT SUM(part_value) AS total_value FROM stock)
SELECT ps_partkey, ROUND(part_value, 2) AS part_value FROM stock CROSS JOIN total
WHERE part_value > total_value * 0.0005E0 ORDER BY part_value DESC, ps_partkey""",
    "q12_shipping": """
SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(SUM(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00'
GROUP BY l_returnflag ORDER BY l_returnflag""",
    "q13_customer_distribution": """
SELECT c_count, COUNT(*) AS custdist
FROM (SELECT c_custkey, COUNT(o_orderkey) AS c_count
      FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND NOT o_orderpriority LIKE '%LOW%'
      GROUP BY c_custkey) c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""",
    "q14_promotion_effect": """
SELECT ROUND(100.0E0 * SUM(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0.0E0 END)
       / SUM(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-10-01 00:00:00'""",
    "q15_top_supplier": """
WITH revenue AS (SELECT l_suppkey AS supplier_no, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS total_revenue
                 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-04-01 00:00:00'
                 GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no
WHERE total_revenue = (SELECT MAX(total_revenue) FROM revenue) ORDER BY s_suppkey""",
    "q16_parts_supplier_relationship": f"""
WITH {PARTSUPP}
SELECT p_brand, p_type, p_size, COUNT(DISTINCT ps_suppkey) AS supplier_cnt
FROM ps JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND NOT p_type LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""",
    "q17_small_quantity_order_revenue": """
SELECT ROUND(SUM(l_extendedprice) / 7.0E0, 4) AS avg_yearly
FROM lineitem JOIN part ON p_partkey = l_partkey
     JOIN (SELECT l_partkey AS t_partkey, 0.2E0 * AVG(l_quantity) AS t_avg FROM lineitem GROUP BY l_partkey) t ON t_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < t_avg""",
    "q18_large_volume_customer": """
SELECT c_name, c_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate, ROUND(o_totalprice, 2) AS o_totalprice,
       ROUND(SUM(l_quantity), 2) AS sum_qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING SUM(l_quantity) > 200)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""",
    "q19_discounted_revenue": """
SELECT ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND REGEXP_LIKE(p_type, 'SMALL|ECONOMY') AND l_quantity >= 1 AND l_quantity <= 11 AND p_size >= 1 AND p_size <= 15)
   OR (p_brand = 'Brand#23' AND REGEXP_LIKE(p_type, 'MEDIUM|PROMO') AND l_quantity >= 10 AND l_quantity <= 20 AND p_size >= 1 AND p_size <= 30)
   OR (p_brand = 'Brand#14' AND REGEXP_LIKE(p_type, 'LARGE|STANDARD') AND l_quantity >= 20 AND l_quantity <= 30 AND p_size >= 1 AND p_size <= 45)""",
    "q20_potential_part_promotion": f"""
WITH {PARTSUPP},
half AS (SELECT l_partkey AS h_partkey, l_suppkey AS h_suppkey, 0.5E0 * SUM(l_quantity) AS h_qty FROM lineitem
         WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY l_partkey, l_suppkey)
SELECT s_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
WHERE n_name = 'NATION_3' AND s_suppkey IN (
  SELECT ps_suppkey FROM ps JOIN half ON ps_partkey = h_partkey AND ps_suppkey = h_suppkey
  WHERE ps_availqty > h_qty AND ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%'))
ORDER BY s_name""",
    "q21_suppliers_who_kept_orders_waiting": """
WITH late AS (SELECT DISTINCT l_orderkey AS t_orderkey, l_suppkey AS t_suppkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
              WHERE l_shipdate > o_orderdate + INTERVAL 60 DAY AND o_orderstatus = 'F'),
late_n AS (SELECT t_orderkey AS k, COUNT(*) AS n_late FROM late GROUP BY t_orderkey),
all_n AS (SELECT l_orderkey AS k, COUNT(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY l_orderkey)
SELECT s_name, COUNT(*) AS numwait FROM supplier JOIN late ON s_suppkey = t_suppkey
     JOIN late_n ON late_n.k = t_orderkey JOIN all_n ON all_n.k = t_orderkey
WHERE n_late = 1 AND n_supp > 1 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22_global_sales_opportunity": """
WITH cust AS (SELECT c_custkey, c_acctbal, SUBSTRING(c_name, LENGTH(c_name), 1) AS cntrycode FROM customer),
rich AS (SELECT AVG(c_acctbal) AS avg_bal FROM cust WHERE c_acctbal > 0 AND cntrycode IN ('1', '3', '5', '7'))
SELECT cntrycode, COUNT(*) AS numcust, ROUND(SUM(c_acctbal), 2) AS totacctbal
FROM cust CROSS JOIN rich LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey
WHERE cntrycode IN ('1', '3', '5', '7') AND c_acctbal > avg_bal AND o_custkey IS NULL
GROUP BY cntrycode ORDER BY cntrycode""",
}


def for_duckdb(text: str) -> str:
    return text.replace("REGEXP_LIKE(", "REGEXP_MATCHES(").replace("VARCHAR(10)", "VARCHAR").strip()


def for_spark(text: str) -> str:
    return text.replace("VARCHAR(10)", "STRING").strip()
