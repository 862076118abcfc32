"""Commerce-model views over the given test tables (FIXTURES.md part 2).

The given parquet tables are TPC-H-like; the operators work on a commerce model
(merchants, products, carts, orders, ...).  Each view below is one SELECT over
the given tables or earlier views.  The DuckDB oracle uses this text as CTEs;
Spark runs the same text (table names bound to DataFrames through
``spark.sql(text, **frames)``) except for the three views in ``SPARK_VIEWS``,
whose non-equi joins are rewritten as generators / an equi join - the oracle
comparison checks that both give the same rows.

Fixed values: the view bodies are the fixture definitions of FIXTURES.md and
must stay as written there for the oracle comparison to hold.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from mercato.session import materialize
from mercato.sources.tables import BASE_TABLES, load

# Fixture view definitions (FIXTURES.md part 2), in creation order.
VIEWS: dict[str, str] = {
    "v_merchants": """
SELECT s_suppkey AS id, s_name AS name,
       CASE s_suppkey % 3 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'pharma' ELSE 'bakery' END AS category
FROM {supplier}""",
    "v_branches": """
SELECT n_nationkey AS id, n_nationkey % 10 AS merchant_id, n_name AS name,
       CASE n_nationkey % 2 WHEN 0 THEN 'Karachi' ELSE 'Lahore' END AS city,
       (n_nationkey * 97) % 1440 AS opening_time_minutes,
       CASE WHEN n_nationkey % 5 = 0 THEN (n_nationkey * 97) % 1440
            ELSE (n_nationkey * 97 + 600) % 1440 END AS closing_time_minutes
FROM {nation}""",
    "v_product_categories": """
SELECT DISTINCT concat(CAST(p_partkey % 10 AS STRING), ':', p_type) AS id,
       p_partkey % 10 AS merchant_id, p_type AS name FROM {part}""",
    "v_products": """
SELECT p_partkey AS id, p_partkey % 10 AS merchant_id,
       CASE WHEN p_partkey % 13 = 0 THEN NULL
            ELSE concat(CAST(p_partkey % 10 AS STRING), ':', p_type) END AS category_id,
       p_name AS name, CAST(round(p_retailprice * 100) / 100 AS DECIMAL(12,2)) AS base_price,
       p_partkey % 3 = 0 AS track_inventory, p_partkey % 11 <> 0 AS is_active
FROM {part}""",
    "v_product_addons": """
SELECT p_partkey * 10 + k AS id, p_partkey AS product_id, concat('addon ', CAST(k AS STRING)) AS name,
       CAST(p_size * k * 0.25 AS DECIMAL(12,2)) AS price
FROM {part} CROSS JOIN (VALUES (1), (2), (3)) AS a(k)""",
    "v_product_inventory": """
SELECT p.id AS product_id, b.id AS branch_id,
       CAST((p.id * 7 + b.id * 13) % 40 AS INT) AS quantity
FROM {v_products} p JOIN {v_branches} b ON p.merchant_id = b.merchant_id
WHERE p.track_inventory AND (p.id + b.id) % 9 <> 0""",
    "v_actors": """
SELECT c_custkey AS id, c_custkey % 10 AS merchant_id,
       concat('user', CAST(c_custkey AS STRING), '@example.com') AS email,
       c_mktsegment AS first_name, c_name AS last_name, c_custkey % 17 <> 0 AS is_active
FROM {customer}""",
    "v_actor_roles": """
SELECT c_custkey % 10 AS merchant_id, c_custkey AS actor_id,
       CASE WHEN floor(c_custkey / 10) % 20 = 0 THEN 'admin' WHEN floor(c_custkey / 10) % 20 < 4 THEN 'merchant'
            WHEN floor(c_custkey / 10) % 20 < 9 THEN 'employee' ELSE 'customer' END AS role_type
FROM {customer}""",
    "v_discounts": """
SELECT p_partkey AS id, p_partkey % 10 AS merchant_id,
       CASE WHEN p_partkey % 3 = 0 THEN p_partkey END AS product_id,
       CASE WHEN p_partkey % 3 = 1 THEN concat(CAST(p_partkey % 10 AS STRING), ':', p_type) END AS category_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'flat' ELSE 'percentage' END AS type,
       CAST(p_size AS DECIMAL(12,2)) AS value,
       CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 4 = 1 THEN TIMESTAMP '2000-06-01 00:00:00'
            ELSE TIMESTAMP '1999-01-01 00:00:00' END AS valid_from,
       CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN TIMESTAMP '1999-12-31 00:00:00'
            ELSE TIMESTAMP '2001-01-01 00:00:00' END AS valid_to,
       CASE WHEN p_partkey % 6 < 3 THEN TIMESTAMP '1998-01-01 00:00:00' ELSE TIMESTAMP '1998-02-01 00:00:00' END AS created_at
FROM {part}""",
    "v_carts": """
SELECT o_orderkey AS id, o_orderkey % 10 AS merchant_id, o_orderkey % 20 AS branch_id,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey - o_custkey % 10 + o_orderkey % 10 END AS actor_id,
       o_orderdate AS created_at
FROM {orders}""",
    "v_cart_items": """
SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS id,
       l_orderkey AS cart_id, l_partkey - l_partkey % 10 + l_orderkey % 10 AS product_id,
       CAST(l_quantity AS INT) AS quantity, l_linenumber AS addon_bits,
       CAST(round(l_discount * l_quantity * 100) / 100 AS DECIMAL(12,2)) AS applied_discount_amount
FROM {lineitem}""",
    "v_cart_item_addons": """
SELECT i.id AS cart_item_id, i.product_id * 10 + k AS addon_id
FROM {v_cart_items} i JOIN (VALUES (1, 1), (2, 2), (3, 4)) AS a(k, bit)
  ON floor(i.addon_bits / bit) % 2 = 1""",
    "v_orders": """
SELECT o_orderkey AS id, o_orderkey AS cart_id, o_orderkey % 10 AS merchant_id, o_orderkey % 20 AS branch_id,
       CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE o_custkey - o_custkey % 10 + o_orderkey % 10 END AS actor_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'card' ELSE 'cash' END AS payment_type,
       CASE o_orderstatus WHEN 'F' THEN 'delivered'
            WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'accepted' ELSE 'out_for_delivery' END
            ELSE CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'cancelled' ELSE 'refunded' END END AS status,
       o_orderdate AS created_at
FROM {orders}""",
    "v_order_items": """
SELECT order_id, product_id, quantity, price, base_amount, addon_amount, discount_amount, tax_amount,
       CAST(base_amount + addon_amount - discount_amount + tax_amount AS DECIMAL(12,2)) AS line_total
FROM (SELECT g.order_id, g.product_id, g.quantity, p.base_price AS price,
             CAST(g.quantity * p.base_price AS DECIMAL(12,2)) AS base_amount, g.addon_amount, g.discount_amount,
             CAST(round(CAST(g.quantity * p.base_price + g.addon_amount - g.discount_amount AS DOUBLE)
                  * CASE WHEN o.payment_type = 'card' THEN 8 ELSE 15 END) / 100 AS DECIMAL(12,2)) AS tax_amount
      FROM (SELECT cart_id AS order_id, product_id, CAST(sum(quantity) AS INT) AS quantity,
                   CAST(sum(quantity * addon_bits) AS DECIMAL(12,2)) AS addon_amount,
                   CAST(sum(applied_discount_amount) AS DECIMAL(12,2)) AS discount_amount
            FROM {v_cart_items} GROUP BY cart_id, product_id) g
      JOIN {v_products} p ON p.id = g.product_id
      JOIN {v_orders} o ON o.id = g.order_id) x""",
    "v_order_item_addons": """
SELECT DISTINCT i.cart_id AS order_id, i.product_id, a.addon_id
FROM {v_cart_items} i JOIN {v_cart_item_addons} a ON a.cart_item_id = i.id""",
    "v_status_requests": """
SELECT event_id, concat(CAST(user_id AS STRING), ':', CAST(CAST(ts AS DATE) AS STRING)) AS order_ref, ts,
       CASE event_type WHEN 'signup' THEN 'accepted' WHEN 'view' THEN 'out_for_delivery' WHEN 'purchase' THEN 'delivered'
            WHEN 'click' THEN 'cancelled' ELSE 'refunded' END AS requested_status
FROM {events}""",
    "v_sessions": """
SELECT event_id AS id, user_id % 10 AS merchant_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id END AS actor_id,
       concat('t', CAST(event_id AS STRING)) AS refresh_token, event_id % 9 = 0 AS is_blocked, ts AS created_at,
       CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-10 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS expires_at
FROM {events}""",
    "v_areas": """
SELECT r_regionkey AS id, r_name AS name, CASE r_regionkey % 2 WHEN 0 THEN 'Karachi' ELSE 'Lahore' END AS city FROM {region}""",
    "v_zones": """
SELECT n_nationkey AS id, n_regionkey AS area_id, n_name AS name,
       CASE WHEN n_nationkey % 3 = 0 THEN concat('POLYGON((', x0, ' ', y0, ',', x2, ' ', y0, ',', x2, ' ', y2, ',', x0, ' ', y2, ',', x0, ' ', y0,
                '),(', xa, ' ', ya, ',', xb, ' ', ya, ',', xb, ' ', yb, ',', xa, ' ', yb, ',', xa, ' ', ya, '))')
            WHEN n_nationkey % 3 = 1 THEN concat('POLYGON((', x0, ' ', y0, ',', x2, ' ', y0, ',', x2, ' ', y2, ',', x1, ' ', y1, ',', x0, ' ', y2, ',', x0, ' ', y0, '))')
            ELSE concat('POLYGON((', x0, ' ', y0, ',', x2, ' ', y0, ',', x1, ' ', y2, ',', x0, ' ', y0, '))') END AS coordinates_wkt
FROM (SELECT n_nationkey, n_regionkey, n_name,
             CAST(60 + n_nationkey % 5 * 4 AS STRING) AS x0, CAST(64 + n_nationkey % 5 * 4 AS STRING) AS x1, CAST(68 + n_nationkey % 5 * 4 AS STRING) AS x2,
             CAST(20 + n_nationkey % 4 * 4 AS STRING) AS y0, CAST(24 + n_nationkey % 4 * 4 AS STRING) AS y1, CAST(28 + n_nationkey % 4 * 4 AS STRING) AS y2,
             CAST(62 + n_nationkey % 5 * 4 AS STRING) AS xa, CAST(66 + n_nationkey % 5 * 4 AS STRING) AS xb,
             CAST(22 + n_nationkey % 4 * 4 AS STRING) AS ya, CAST(26 + n_nationkey % 4 * 4 AS STRING) AS yb
      FROM {nation}) c""",
    "v_service_zones": """
SELECT m.id * 100 + n_nationkey AS id, m.id AS merchant_id, n_nationkey AS zone_id,
       CASE WHEN n_nationkey % 10 = m.id THEN n_nationkey END AS branch_id,
       CASE WHEN (m.id + n_nationkey) % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS created_at
FROM {v_merchants} m JOIN {nation} ON (m.id + n_nationkey) % 4 <> 0""",
    "v_points": """
SELECT c_custkey AS id, c_custkey % 10 AS merchant_id,
       CAST(58 + c_custkey * 7 % 61 * 0.5 AS DOUBLE) AS lon, CAST(18 + c_custkey * 11 % 53 * 0.5 AS DOUBLE) AS lat
FROM {customer}""",
}

VIEW_NAMES = tuple(VIEWS)

# Spark text for three views whose FIXTURES.md form uses a non-equi join (against a 3-row VALUES list, or
# merchants x nations under a modulo condition): generators and an equi join give the same rows without a
# nested-loop join in the plan.  The oracle keeps the original text, so every oracle comparison also checks
# these equivalents.
SPARK_VIEWS: dict[str, str] = {
    "v_product_addons": """
SELECT p_partkey * 10 + k AS id, p_partkey AS product_id, concat('addon ', CAST(k AS STRING)) AS name,
       CAST(p_size * k * 0.25 AS DECIMAL(12,2)) AS price
FROM {part} LATERAL VIEW explode(array(1, 2, 3)) a AS k""",
    "v_cart_item_addons": """
SELECT i.id AS cart_item_id, i.product_id * 10 + a.k AS addon_id
FROM {v_cart_items} i LATERAL VIEW inline(array(struct(1 AS k, 1 AS bit), struct(2 AS k, 2 AS bit),
                                                 struct(3 AS k, 4 AS bit))) a AS k, bit
WHERE floor(i.addon_bits / a.bit) % 2 = 1""",
    # (m + n) % 4 <> 0 depends only on n % 4: each merchant lists its admissible residues, then an equi join
    "v_service_zones": """
SELECT m.id * 100 + n_nationkey AS id, m.id AS merchant_id, n_nationkey AS zone_id,
       CASE WHEN n_nationkey % 10 = m.id THEN n_nationkey END AS branch_id,
       CASE WHEN (m.id + n_nationkey) % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-02 00:00:00' END AS created_at
FROM (SELECT id, r FROM {v_merchants} LATERAL VIEW explode(array(0, 1, 2, 3)) x AS r WHERE (id + r) % 4 <> 0) m
JOIN {nation} ON n_nationkey % 4 = m.r""",
}

# The as-of instants used by the fixture queries (FIXTURES.md part 2).
DISCOUNT_AS_OF = "2000-01-01 00:00:00"
SESSION_AS_OF = "2024-01-20 00:00:00"

_REF = re.compile(r"\{(\w+)\}")


def dependencies(name: str) -> list[str]:
    return _REF.findall(VIEWS[name])


def spark_text(name: str) -> str:
    return SPARK_VIEWS.get(name, VIEWS[name])


def closure(names) -> list[str]:
    """Views needed for ``names`` (including themselves), in creation order."""
    needed: set[str] = set()

    def visit(n: str) -> None:
        if n in needed or n not in VIEWS:
            return
        needed.add(n)
        for dep in dependencies(n):
            visit(dep)

    for n in names:
        visit(n)
    return [n for n in VIEW_NAMES if n in needed]


class Fixtures:
    """Lazily built fixture views of one test directory, bound to one session."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self._stored: set[str] = set()  # frames that are read from written tables

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            if name in BASE_TABLES:
                self._frames[name] = load(self.spark, self.sf_dir, name)
            else:
                deps = {d: self[d] for d in dict.fromkeys(_REF.findall(spark_text(name)))}
                self._frames[name] = self.spark.sql(spark_text(name), **deps)
        return self._frames[name]

    def derived(self, name: str, build) -> DataFrame:
        """A table derived from the views by engine code (e.g. cart items with their addon array), memoised."""
        if name not in self._frames:
            self._frames[name] = build(self)
        return self._frames[name]

    def stored(self, *names: str) -> "Fixtures":
        """The same views, with ``names`` (parents first) written as tables that the views built on them read.

        For a query that reads a costly view more than once.
        """
        out = Fixtures(self.spark, self.sf_dir)
        out._stored = set(self._stored)
        out._frames = {n: self._frames[n] for n in self._stored}
        for name in names:
            if name not in out._stored:
                out._frames[name] = materialize(out[name])
                out._stored.add(name)
        return out

    def is_stored(self, name: str) -> bool:
        return name in self._stored

    def persist_derived(self, directory: str, name: str, build) -> str:
        """Write a derived table once as parquet (like ``persist_views``) and use it from then on."""
        import os

        path = os.path.join(directory, name)
        build(self).write.mode("overwrite").parquet(path)
        self._frames[name] = self.spark.read.parquet(path)
        self._stored.add(name)
        return path

    def persist_views(self, directory: str, names=None) -> dict[str, str]:
        """Write the fixture views as parquet tables under ``directory`` and read them back.

        This is the "load the commerce tables" step: later queries scan real
        parquet tables (with column pruning and filter pushdown) instead of
        re-deriving the views from the TPC-H-like inputs.  Views are written in
        creation order, so each one is built from already written parents.
        """
        import os

        paths = {}
        for name in (names or VIEW_NAMES):
            path = os.path.join(directory, name)
            self[name].write.mode("overwrite").parquet(path)
            self._frames[name] = self.spark.read.parquet(path)
            self._stored.add(name)
            paths[name] = path
        return paths

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("v_") or name in BASE_TABLES:
            return self[name]
        raise AttributeError(name)


_CACHE: dict[tuple[int, str], Fixtures] = {}


def fixtures(spark: SparkSession, sf_dir: str) -> Fixtures:
    key = (id(spark), sf_dir)
    fx = _CACHE.get(key)
    if fx is None or fx.spark is not spark:
        fx = _CACHE[key] = Fixtures(spark, sf_dir)
    return fx


def duckdb_ctes(sql: str) -> str:
    """Prefix ``sql`` with the fixture views it mentions, as DuckDB CTEs.

    The view bodies are the same text Spark runs; table placeholders become the
    plain table names the oracle registers.
    """
    used = [n for n in VIEW_NAMES if re.search(rf"\b{n}\b", sql)]
    order = closure(used)
    if not order:
        return sql
    parts = []
    for n in order:
        body = _REF.sub(lambda m: m.group(1), VIEWS[n]).strip()
        parts.append(f"{n} AS (\n{body}\n)")
    body = sql.strip()
    m = re.match(r"(?i)with\s+recursive\s", body)
    if m:
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[m.end():]
    if re.match(r"(?i)with\s", body):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
