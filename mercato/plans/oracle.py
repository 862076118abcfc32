"""DuckDB oracle SQL for every registered query (same keys as ``mercato.plans.queries``).

Each statement is written against the fixture view names; ``duckdb_ctes``
prefixes the fixture views it mentions (the same view text Spark runs) as CTEs,
so the statement runs on the plain given tables.  Money follows the engine's
rule: ``round(x * 100) / 100`` on doubles, decimal sums reported as doubles.
"""

from __future__ import annotations

import re

from mercato.sources.fixtures import duckdb_ctes

_RAW: dict[str, str] = {}


def sql(name: str, text: str) -> None:
    _RAW[name] = text


def r2(expr: str) -> str:
    """round2 in SQL, on a double."""
    return f"(round(CAST({expr} AS DOUBLE) * 100) / 100)"


COUNTED = "('accepted', 'out_for_delivery', 'delivered')"

# --- reports -----------------------------------------------------------------

_REPORT_SUMS = f"""
       {r2('sum(i.line_total)')} AS total_sales,
       {r2('sum(i.tax_amount)')} AS total_tax,
       {r2('sum(i.discount_amount)')} AS total_discount,
       {r2('sum(i.base_amount + i.addon_amount - i.discount_amount)')} AS profit_estimate"""

sql("monthly_sales_report", f"""
SELECT o.merchant_id, CAST(year(o.created_at) AS INTEGER) AS year, CAST(month(o.created_at) AS INTEGER) AS month,{_REPORT_SUMS}
FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
WHERE o.status IN {COUNTED}
GROUP BY 1, 2, 3
""")

sql("sales_report_zero_spine", f"""
WITH req AS (
  SELECT DISTINCT merchant_id, CAST(year(created_at) AS INTEGER) AS year, CAST(month(created_at) AS INTEGER) AS month
  FROM v_carts),
rep AS (
  SELECT o.merchant_id, CAST(year(o.created_at) AS INTEGER) AS year, CAST(month(o.created_at) AS INTEGER) AS month,{_REPORT_SUMS}
  FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
  WHERE o.status IN {COUNTED}
  GROUP BY 1, 2, 3),
chk AS (
  SELECT *, CASE WHEN month < 1 OR month > 12 THEN 'invalid month'
                 WHEN year < 2000 OR year > 9999 THEN 'invalid year' END AS reason
  FROM req)
SELECT c.merchant_id, c.year, c.month, c.reason,
       CASE WHEN c.reason IS NULL THEN coalesce(r.total_sales, 0.0) END AS total_sales,
       CASE WHEN c.reason IS NULL THEN coalesce(r.total_tax, 0.0) END AS total_tax,
       CASE WHEN c.reason IS NULL THEN coalesce(r.total_discount, 0.0) END AS total_discount,
       CASE WHEN c.reason IS NULL THEN coalesce(r.profit_estimate, 0.0) END AS profit_estimate
FROM chk c LEFT JOIN rep r USING (merchant_id, year, month)
""")

sql("inventory_by_product", """
SELECT p.merchant_id, p.id AS product_id, p.name AS product_name, CAST(coalesce(sum(pi.quantity), 0) AS INTEGER) AS quantity
FROM v_products p LEFT JOIN v_product_inventory pi ON pi.product_id = p.id
GROUP BY p.merchant_id, p.id, p.name
""")

sql("actor_counts", """
SELECT m.id AS merchant_id, CAST(count(a.id) AS BIGINT) AS actor_count
FROM v_merchants m LEFT JOIN v_actors a ON a.merchant_id = m.id
GROUP BY m.id
""")

_PRODUCT_SALES = f"""
SELECT o.merchant_id, i.product_id, CAST(sum(i.quantity) AS BIGINT) AS units_sold, sum(i.line_total) AS revenue
FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
WHERE o.status IN {COUNTED}
GROUP BY 1, 2"""

sql("top_selling_products", f"""
SELECT merchant_id, CAST(rank AS INTEGER) AS rank, product_id, units_sold, {r2('revenue')} AS revenue
FROM (SELECT *, row_number() OVER (PARTITION BY merchant_id ORDER BY units_sold DESC, revenue DESC, product_id) AS rank
      FROM ({_PRODUCT_SALES}) s) t
WHERE rank <= 5
""")

sql("sales_per_merchant", f"""
SELECT o.merchant_id, CAST(count(DISTINCT o.id) AS BIGINT) AS order_count,{_REPORT_SUMS}
FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
WHERE o.status IN {COUNTED}
GROUP BY 1
""")


# --- catalog, listing, lookups -----------------------------------------------

DISCOUNT_AS_OF = "TIMESTAMP '2000-01-01 00:00:00'"
SESSION_AS_OF = "TIMESTAMP '2024-01-20 00:00:00'"
REPRICE_AS_OF = "TIMESTAMP '2001-06-01 00:00:00'"


def ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


sql("list_orders", f"""
SELECT id, merchant_id, branch_id, actor_id, payment_type, status, {ts('created_at')} AS created_at
FROM v_orders
""")

sql("lookup_by_keys", """
WITH k AS (SELECT DISTINCT c.merchant_id, i.product_id FROM v_cart_items i JOIN v_carts c ON c.id = i.cart_id)
SELECT k.merchant_id, k.product_id, p.name, CAST(p.base_price AS DOUBLE) AS base_price, p.id IS NOT NULL AS found
FROM k LEFT JOIN v_products p ON p.merchant_id = k.merchant_id AND p.id = k.product_id
""")

sql("product_detail", """
SELECT p.id, p.merchant_id, p.category_id, p.name, CAST(p.base_price AS DOUBLE) AS base_price, p.track_inventory, p.is_active,
       coalesce(pc.name, '') AS category_name
FROM v_products p LEFT JOIN v_product_categories pc ON pc.merchant_id = p.merchant_id AND pc.id = p.category_id
""")

sql("product_addons", """
SELECT a.id, a.product_id, p.merchant_id, a.name, CAST(a.price AS DOUBLE) AS price
FROM v_product_addons a JOIN v_products p ON p.id = a.product_id
""")

_FULL = "trim(concat(coalesce(a.first_name, ''), ' ', coalesce(a.last_name, '')))"

sql("employees", f"""
SELECT DISTINCT a.merchant_id, a.id AS uid, a.email, {_FULL} AS full_name, a.is_active
FROM v_actors a JOIN v_actor_roles ar ON ar.merchant_id = a.merchant_id AND ar.actor_id = a.id
WHERE ar.role_type = 'employee'
""")

sql("actor_profiles", f"""
SELECT a.merchant_id, a.id AS uid, a.email, {_FULL} AS full_name, a.is_active, ar.role_type
FROM v_actors a LEFT JOIN v_actor_roles ar ON ar.merchant_id = a.merchant_id AND ar.actor_id = a.id
""")

_HAS_ROLE = """EXISTS (SELECT 1 FROM v_actors a JOIN v_actor_roles ar ON ar.actor_id = a.id AND ar.merchant_id = a.merchant_id
                WHERE a.id = {actor} AND ar.role_type = '{role}'{extra})"""


def has_role(actor: str, role: str, merchant: str | None = None) -> str:
    extra = f" AND a.merchant_id = {merchant}" if merchant else ""
    return _HAS_ROLE.format(actor=actor, role=role, extra=extra)


sql("can_view_matrix", f"""
SELECT s.id AS session_id, s.actor_id, s.merchant_id,
       ({has_role('s.actor_id', 'admin')} OR {has_role('s.actor_id', 'merchant', 's.merchant_id')}) AS can_view,
       ({has_role('s.actor_id', 'admin')} OR {has_role('s.actor_id', 'merchant', 's.merchant_id')}) AS can_manage
FROM v_sessions s
""")

sql("default_roles", """
SELECT m.id AS merchant_id, t.role_type, concat(t.role_type, ' role') AS description
FROM v_merchants m, (VALUES ('merchant'), ('employee'), ('customer')) AS t(role_type)
WHERE NOT EXISTS (SELECT 1 FROM v_actor_roles r WHERE r.merchant_id = m.id AND r.role_type = t.role_type)
""")

sql("bootstrap_candidates", """
SELECT m.id, m.name, m.category FROM v_merchants m
WHERE NOT EXISTS (SELECT 1 FROM v_actors a WHERE a.merchant_id = m.id)
""")

sql("split_full_name", """
WITH n AS (SELECT id, concat('  ', first_name, '   ', last_name, ' ') AS full_name FROM v_actors),
w AS (SELECT id, full_name, string_split(trim(regexp_replace(full_name, '\\s+', ' ', 'g')), ' ') AS parts FROM n)
SELECT id, full_name, coalesce(parts[1], '') AS first_name,
       CASE WHEN len(parts) > 1 THEN array_to_string(parts[2:], ' ') ELSE '' END AS last_name
FROM w
""")

sql("session_states", f"""
WITH att AS (
  SELECT event_id AS attempt_id,
         CASE WHEN event_id % 13 = 0 THEN event_id + 1000000000 ELSE event_id END AS session_id,
         concat('user', CAST(CASE WHEN event_id % 11 = 0 THEN user_id + 1 ELSE user_id END AS VARCHAR), '@example.com') AS email,
         concat('t', CAST(CASE WHEN event_id % 7 = 0 THEN event_id + 1 ELSE event_id END AS VARCHAR)) AS refresh_token
  FROM events),
s AS (
  SELECT s.id, s.is_blocked, s.refresh_token AS session_token, s.expires_at, coalesce(a.email, '') AS actor_email
  FROM v_sessions s LEFT JOIN v_actors a ON a.id = s.actor_id AND a.merchant_id = s.merchant_id)
SELECT att.attempt_id, att.session_id,
       CASE WHEN s.id IS NULL THEN 'not_found'
            WHEN s.is_blocked THEN 'blocked'
            WHEN s.actor_email <> att.email THEN 'actor_mismatch'
            WHEN s.session_token <> att.refresh_token THEN 'token_mismatch'
            WHEN {SESSION_AS_OF} > s.expires_at THEN 'expired'
            ELSE 'ok' END AS state
FROM att LEFT JOIN s ON s.id = att.session_id
""")

sql("visible_orders", f"""
WITH req AS (
  SELECT actor_id AS viewer_id, id AS order_id FROM v_orders WHERE actor_id IS NOT NULL
  UNION ALL
  SELECT actor_id + 10 AS viewer_id, id AS order_id FROM v_orders WHERE actor_id IS NOT NULL),
x AS (
  SELECT r.viewer_id, r.order_id, a.merchant_id AS viewer_merchant, o.merchant_id AS order_merchant, o.actor_id AS order_actor,
         {has_role('r.viewer_id', 'admin')} AS is_admin,
         {has_role('r.viewer_id', 'merchant', 'o.merchant_id')} AS is_merchant
  FROM req r LEFT JOIN v_actors a ON a.id = r.viewer_id LEFT JOIN v_orders o ON o.id = r.order_id),
y AS (
  SELECT viewer_id, order_id,
         CASE WHEN viewer_merchant IS NULL THEN 'viewer_not_found'
              WHEN order_merchant IS NULL THEN 'not_found'
              WHEN NOT is_admin AND order_merchant <> viewer_merchant THEN 'not_found'
              WHEN NOT is_admin AND NOT is_merchant AND NOT coalesce(order_actor = viewer_id, false) THEN 'forbidden'
         END AS reason
  FROM x)
SELECT viewer_id, order_id, reason IS NULL AS visible, reason FROM y
""")

# --- discounts and carts -----------------------------------------------------


def active(as_of: str, alias: str = "d") -> str:
    return (f"(({alias}.valid_from IS NULL OR year({alias}.valid_from) <= 1 OR {as_of} >= {alias}.valid_from) AND "
            f"({alias}.valid_to IS NULL OR year({alias}.valid_to) <= 1 OR {as_of} <= {alias}.valid_to))")


def active_cols(as_of: str, vf: str, vt: str) -> str:
    return (f"(({vf} IS NULL OR year({vf}) <= 1 OR {as_of} >= {vf}) AND "
            f"({vt} IS NULL OR year({vt}) <= 1 OR {as_of} <= {vt}))")


def best_cte(as_of: str, targets: str) -> str:
    """Brute force: every matching active discount per target, ranked (priority, newest, id)."""
    return f"""
cands AS (
  SELECT t.tid, d.id AS did, d.type AS dtype, d.value AS dvalue, d.created_at AS dcreated,
         CASE WHEN d.product_id IS NOT NULL THEN 1 WHEN d.category_id IS NOT NULL THEN 2 ELSE 3 END AS pr
  FROM ({targets}) t JOIN v_discounts d ON d.merchant_id = t.merchant_id
  WHERE {active(as_of)}
    AND ((d.product_id IS NOT NULL AND d.product_id = t.product_id)
      OR (d.product_id IS NULL AND d.category_id IS NOT NULL AND d.category_id = t.category_id)
      OR (d.product_id IS NULL AND d.category_id IS NULL))),
best AS (
  SELECT tid, did, dtype, dvalue, pr FROM (
    SELECT *, row_number() OVER (PARTITION BY tid ORDER BY pr, dcreated DESC, did) AS rn FROM cands) WHERE rn = 1)"""


def amount(dtype: str, dvalue: str, sub: str) -> str:
    return (f"CASE WHEN {dtype} = 'percentage' THEN {r2(f'{sub} * CAST({dvalue} AS DOUBLE) / 100')} "
            f"ELSE CASE WHEN CAST({dvalue} AS DOUBLE) > {sub} THEN {r2(sub)} ELSE {r2(dvalue)} END END")


sql("discount_candidates", f"""
WITH pairs AS (
  SELECT p.id AS product_id, p.merchant_id,
         CASE WHEN d.product_id IS NOT NULL THEN 1 WHEN d.category_id IS NOT NULL THEN 2 ELSE 3 END AS priority,
         {active(DISCOUNT_AS_OF)} AS is_act
  FROM v_products p JOIN v_discounts d ON d.merchant_id = p.merchant_id
    AND ((d.product_id IS NOT NULL AND d.product_id = p.id)
      OR (d.product_id IS NULL AND d.category_id IS NOT NULL AND d.category_id = p.category_id)
      OR (d.product_id IS NULL AND d.category_id IS NULL)))
SELECT p.id AS product_id, p.merchant_id,
       CAST(count(*) FILTER (WHERE x.priority = 1) AS BIGINT) AS n_product_scope,
       CAST(count(*) FILTER (WHERE x.priority = 2) AS BIGINT) AS n_category_scope,
       CAST(count(*) FILTER (WHERE x.priority = 3) AS BIGINT) AS n_merchant_scope,
       CAST(count(*) FILTER (WHERE x.is_act) AS BIGINT) AS n_active,
       CAST(min(CASE WHEN x.is_act THEN x.priority END) AS INTEGER) AS best_priority
FROM v_products p LEFT JOIN pairs x ON x.product_id = p.id
GROUP BY 1, 2
""")


_PROD_TARGETS = "SELECT id AS tid, id AS product_id, merchant_id, category_id, CAST(base_price AS DOUBLE) AS subtotal FROM v_products"

sql("best_discount", f"""
WITH {best_cte(DISCOUNT_AS_OF, _PROD_TARGETS).strip()}
SELECT p.id AS product_id, p.merchant_id, b.did AS best_discount_id, b.pr AS best_priority, b.dtype AS best_discount_type,
       CAST(b.dvalue AS DOUBLE) AS best_discount_value
FROM v_products p LEFT JOIN best b ON b.tid = p.id
""")

sql("discount_amounts", f"""
WITH {best_cte(DISCOUNT_AS_OF, _PROD_TARGETS).strip()}
SELECT p.id AS product_id, CAST(p.base_price AS DOUBLE) AS subtotal, b.did AS best_discount_id,
       {amount('b.dtype', 'b.dvalue', 'CAST(p.base_price AS DOUBLE)')} AS discount_amount
FROM v_products p JOIN best b ON b.tid = p.id
""")

sql("no_discount_rows", f"""
SELECT m.id AS merchant_id, -(m.id + 1) AS id, 'flat' AS type, CAST(0 AS DOUBLE) AS value, 'NO_DISCOUNT' AS description,
       {ts(f"{DISCOUNT_AS_OF} - INTERVAL 1 DAY")} AS valid_from, {ts(f"{DISCOUNT_AS_OF} + INTERVAL 100 YEAR")} AS valid_to
FROM v_merchants m
WHERE NOT EXISTS (SELECT 1 FROM v_discounts d WHERE d.merchant_id = m.id AND d.type = 'flat' AND d.product_id IS NULL AND d.category_id IS NULL)
""")

# cart lines: addon key (ids sorted as text) and addon stats per line
_LINES = """
akey AS (
  SELECT cart_item_id AS id, string_agg(CAST(addon_id AS VARCHAR), ',' ORDER BY CAST(addon_id AS VARCHAR)) AS addon_key,
         count(*) AS addon_count
  FROM (SELECT DISTINCT cart_item_id, addon_id FROM v_cart_item_addons WHERE addon_id IS NOT NULL AND addon_id <> 0) GROUP BY 1),
astat AS (
  SELECT x.cart_item_id AS id, sum(CAST(a.price AS DOUBLE)) AS addon_unit_price,
         arg_min(CASE WHEN a.id IS NULL THEN 'addon_not_found' WHEN a.product_id <> i.product_id THEN 'addon_wrong_product' END,
                 CAST(x.addon_id AS VARCHAR))
           FILTER (WHERE a.id IS NULL OR a.product_id <> i.product_id) AS addon_reason,
         sum(CASE WHEN a.id IS NULL THEN 1 ELSE 0 END) AS addon_missing
  FROM (SELECT DISTINCT cart_item_id, addon_id FROM v_cart_item_addons WHERE addon_id IS NOT NULL AND addon_id <> 0) x
  JOIN v_cart_items i ON i.id = x.cart_item_id
  LEFT JOIN v_product_addons a ON a.id = x.addon_id
  GROUP BY 1),
lines AS (
  SELECT i.id, i.cart_id, i.product_id, i.quantity, i.applied_discount_amount, coalesce(k.addon_key, '') AS addon_key,
         coalesce(k.addon_count, 0) AS addon_count, s.addon_unit_price, s.addon_reason,
         coalesce(s.addon_missing, 0) AS addon_missing
  FROM v_cart_items i LEFT JOIN akey k ON k.id = i.id LEFT JOIN astat s ON s.id = i.id)"""

sql("cart_item_signatures", f"""
WITH {_LINES.strip()}
SELECT cart_id, product_id, addon_key, CAST(count(*) AS BIGINT) AS n_items, CAST(sum(quantity) AS BIGINT) AS quantity
FROM lines GROUP BY 1, 2, 3
""")

sql("cart_merge", f"""
WITH {_LINES.strip()}
SELECT cart_id, product_id, addon_key, CAST(sum(quantity) AS BIGINT) AS quantity, CAST(count(*) AS BIGINT) AS n_requests,
       CAST(NULL AS VARCHAR) AS reason
FROM lines WHERE quantity > 0 GROUP BY 1, 2, 3
UNION ALL
SELECT cart_id, product_id, addon_key, CAST(quantity AS BIGINT), CAST(1 AS BIGINT), 'quantity_not_positive'
FROM lines WHERE NOT (quantity > 0)
""")

sql("addon_ownership", f"""
WITH {_LINES.strip()}
SELECT id, cart_id, product_id, addon_key, CAST(addon_count AS BIGINT) AS addon_count, addon_reason FROM lines
""")


def priced_cte(as_of: str, explicit: str | None, lines: str = "lines", sfx: str = "", resolve: bool = True) -> str:
    """Priced cart lines; ``explicit`` is an SQL expression over line columns naming the chosen discount id.

    ``as_of`` is an instant or ``added_at``, a column of ``lines``.
    """
    own = "l.added_at, " if as_of == "added_at" else ""
    targets = (f"SELECT l.id AS tid, {own}l.product_id, c.merchant_id, p.category_id FROM {lines} l "
               "JOIN v_carts c ON c.id = l.cart_id JOIN v_products p ON p.id = l.product_id")
    ex = explicit or "CAST(NULL AS BIGINT)"
    best = best_cte(as_of, targets).strip().replace("cands AS", f"cands{sfx} AS").replace("FROM cands", f"FROM cands{sfx}").replace("best AS", f"best{sfx} AS")
    bsel = "b.did" if resolve else "CAST(NULL AS BIGINT)"
    body = f"""
{best},
pl AS (
  SELECT l.*, c.merchant_id, p.id AS pid, p.merchant_id AS pm, p.category_id,
         {r2('l.quantity * CAST(p.base_price AS DOUBLE) + coalesce(l.addon_unit_price, 0) * l.quantity')} AS subtotal,
         {ex} AS explicit_id,
         {bsel} AS best_id, b.dtype AS best_type, b.dvalue AS best_value
  FROM {lines} l LEFT JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id
  LEFT JOIN best{sfx} b ON b.tid = l.id),
pd AS (
  SELECT pl.*, d.id AS xd_id, d.product_id AS xd_product, d.category_id AS xd_category, d.valid_from AS xd_from, d.valid_to AS xd_to,
         CASE WHEN pl.explicit_id IS NOT NULL THEN pl.explicit_id ELSE pl.best_id END AS did,
         CASE WHEN pl.explicit_id IS NOT NULL THEN d.type ELSE pl.best_type END AS dtype,
         CASE WHEN pl.explicit_id IS NOT NULL THEN d.value ELSE pl.best_value END AS dvalue
  FROM pl LEFT JOIN v_discounts d ON d.id = pl.explicit_id AND d.merchant_id = pl.merchant_id),
pa AS (
  SELECT pd.*, CASE WHEN did IS NULL THEN 0.0 ELSE {amount('dtype', 'dvalue', 'subtotal')} END AS amount FROM pd),
pr AS (
  SELECT pa.*,
    CASE WHEN NOT (quantity > 0) THEN 'quantity_not_positive'
         WHEN merchant_id IS NULL THEN 'cart_not_found'
         WHEN pm IS NULL OR pm <> merchant_id THEN 'product_not_found'
         WHEN addon_reason IS NOT NULL THEN addon_reason
         WHEN explicit_id IS NOT NULL AND xd_id IS NULL THEN 'not_found'
         WHEN explicit_id IS NOT NULL AND NOT {active_cols(as_of, 'xd_from', 'xd_to')} AND xd_to IS NOT NULL AND year(xd_to) > 1
              AND xd_from IS NOT NULL AND year(xd_from) > 1 AND {as_of} < xd_from THEN 'not_active_yet'
         WHEN explicit_id IS NOT NULL AND NOT {active_cols(as_of, 'xd_from', 'xd_to')} AND xd_to IS NOT NULL AND year(xd_to) > 1 THEN 'expired'
         WHEN explicit_id IS NOT NULL AND NOT (CASE WHEN xd_product IS NOT NULL THEN coalesce(xd_product = product_id, false)
                                                    WHEN xd_category IS NOT NULL THEN coalesce(xd_category = category_id, false)
                                                    ELSE true END) THEN 'wrong_scope'
         WHEN amount < 0 OR amount > subtotal THEN 'exceeds_subtotal'
    END AS reason
  FROM pa)"""
    for name in ("pl", "pd", "pa", "pr"):
        body = re.sub(rf"\b{name}\b", name + sfx, body)
    return body


_PRICED_SELECT = """
SELECT cart_id, id AS item_id, product_id, quantity,
       CASE WHEN reason IS NULL THEN subtotal END AS subtotal,
       CASE WHEN reason IS NULL THEN coalesce(did, -(merchant_id + 1)) END AS discount_id,
       CASE WHEN reason IS NULL THEN amount END AS discount_amount,
       reason
FROM pr"""

sql("cart_pricing", f"WITH {_LINES.strip()},\n{priced_cte(DISCOUNT_AS_OF, None).strip()}\n{_PRICED_SELECT}")
_ADDED = """
added AS (
  SELECT l.*, c.created_at + to_seconds(l.id % 600) AS added_at FROM lines l LEFT JOIN v_carts c ON c.id = l.cart_id)"""

sql("cart_pricing_at_add",
    f"WITH {_LINES.strip()},{_ADDED},\n{priced_cte('added_at', None, lines='added').strip()}\n{_PRICED_SELECT}")
sql("explicit_discount_check_at_add",
    f"WITH {_LINES.strip()},{_ADDED},\n"
    f"{priced_cte('added_at', 'CASE WHEN l.id % 3 > 0 THEN l.product_id - l.product_id % 7 END', lines='added').strip()}\n{_PRICED_SELECT}")
# adds in order of arrival, one at a time per signature
_LIVE = f"""
WITH RECURSIVE {_LINES.strip()},{_ADDED},
dearer AS (SELECT * REPLACE (CAST(value * 3 AS DECIMAL(13,2)) AS value) FROM v_discounts),
adds AS (
  SELECT id, cart_id, product_id, quantity, addon_key, addon_unit_price, addon_reason, added_at,
         CASE WHEN id % 3 > 0 THEN product_id - product_id % 7 END AS named FROM added
  UNION ALL
  SELECT -id, cart_id, product_id, 1, addon_key, addon_unit_price, addon_reason, added_at, product_id FROM added),
{priced_cte('added_at', 'l.named', lines='adds').strip().replace('v_discounts', 'dearer')},
st AS (SELECT l.* FROM lines l JOIN v_products p ON p.id = l.product_id WHERE p.track_inventory),
kept AS (SELECT cart_id, product_id, addon_key, min(id) AS item_id, arg_min(quantity, id) AS stored FROM st GROUP BY 1, 2, 3),
seqd AS (
  SELECT pr.id, pr.cart_id, pr.product_id, pr.addon_key, pr.quantity, pr.reason AS own_reason, pr.did, pr.dtype, pr.dvalue, pr.merchant_id,
         CAST(p.base_price AS DOUBLE) AS base, coalesce(pr.addon_unit_price, 0) AS extra, k.item_id, CAST(coalesce(k.stored, 0) AS BIGINT) AS stored,
         row_number() OVER (PARTITION BY pr.cart_id, pr.product_id, pr.addon_key ORDER BY pr.added_at, pr.id) AS rn
  FROM pr LEFT JOIN v_products p ON p.id = pr.product_id
  LEFT JOIN kept k ON k.cart_id = pr.cart_id AND k.product_id = pr.product_id AND k.addon_key = pr.addon_key),
fold AS (
  SELECT CAST(NULL AS BIGINT) AS id, cart_id, product_id, addon_key, CAST(0 AS BIGINT) AS rn, stored AS held, CAST(NULL AS BIGINT) AS merged,
         CAST(NULL AS DOUBLE) AS sub, CAST(NULL AS DOUBLE) AS amt, CAST(NULL AS VARCHAR) AS reason
  FROM seqd WHERE rn = 1
  UNION ALL
  SELECT id, cart_id, product_id, addon_key, rn, CASE WHEN reason IS NULL THEN merged ELSE held END, merged, sub, amt, reason
  FROM (SELECT z.*, coalesce(own_reason, CASE WHEN amt < 0 OR amt > sub THEN 'exceeds_subtotal' END) AS reason
        FROM (SELECT y.*, CASE WHEN did IS NULL THEN 0.0 ELSE {amount('dtype', 'dvalue', 'sub')} END AS amt
              FROM (SELECT x.*, {r2('merged * base + extra * merged')} AS sub
                    FROM (SELECT s.*, f.held, f.held + s.quantity AS merged
                          FROM fold f JOIN seqd s ON s.cart_id = f.cart_id AND s.product_id = f.product_id
                            AND s.addon_key = f.addon_key AND s.rn = f.rn + 1) x) y) z) w),
outcome AS (
  SELECT s.id AS add_id, s.cart_id, s.product_id, s.addon_key, CASE WHEN f.reason IS NULL THEN s.item_id END AS item_id,
         CASE WHEN f.reason IS NULL THEN f.merged END AS merged_quantity, CASE WHEN f.reason IS NULL THEN f.sub END AS subtotal,
         CASE WHEN f.reason IS NULL THEN coalesce(s.did, -(s.merchant_id + 1)) END AS discount_id,
         CASE WHEN f.reason IS NULL THEN f.amt END AS discount_amount, f.reason
  FROM seqd s JOIN fold f ON f.id = s.id AND f.rn > 0)
"""

sql("cart_merge_existing", f"{_LIVE.strip()}\nSELECT * FROM outcome")
sql("cart_items_after_adds", f"""{_LIVE.strip()}
SELECT st.id AS item_id, st.cart_id, st.product_id, st.addon_key, CAST(coalesce(g.q, st.quantity) AS BIGINT) AS quantity
FROM st LEFT JOIN (SELECT item_id, max(merged_quantity) AS q FROM outcome GROUP BY 1) g ON g.item_id = st.id
UNION ALL
SELECT NULL, cart_id, product_id, addon_key, max(merged_quantity) FROM outcome WHERE reason IS NULL AND item_id IS NULL GROUP BY 1, 2, 3, 4
""")

sql("explicit_discount_check",
    f"WITH {_LINES.strip()},\n{priced_cte(DISCOUNT_AS_OF, 'l.product_id - l.product_id % 7').strip()}\n{_PRICED_SELECT}")


sql("cart_reprice", f"""
WITH {_LINES.strip()},
{best_cte(DISCOUNT_AS_OF, "SELECT l.id AS tid, l.product_id, c.merchant_id, p.category_id FROM lines l JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id").strip()},
upd AS (
  SELECT l.id AS item_id, l.quantity - 10 AS new_quantity, b.did AS stored_id
  FROM lines l LEFT JOIN best b ON b.tid = l.id),
lines2 AS (
  SELECT l.id, l.cart_id, l.product_id, u.new_quantity AS quantity, l.addon_unit_price, l.addon_reason, u.stored_id
  FROM lines l JOIN upd u ON u.item_id = l.id),
{priced_cte(REPRICE_AS_OF, 'l.stored_id', lines='lines2', sfx='2', resolve=False).strip()}
SELECT cart_id, id AS item_id, product_id, quantity,
       CASE WHEN reason IS NULL THEN subtotal END AS subtotal,
       CASE WHEN reason IS NULL THEN coalesce(did, -(merchant_id + 1)) END AS discount_id,
       CASE WHEN reason IS NULL THEN amount END AS discount_amount,
       reason
FROM pr2
""")

sql("cart_preview", f"""
WITH {_LINES.strip()},
{best_cte(DISCOUNT_AS_OF, "SELECT l.id AS tid, l.product_id, c.merchant_id, p.category_id FROM lines l JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id").strip()},
pv AS (
  SELECT l.cart_id, l.id AS item_id, l.product_id, l.quantity, CAST(p.base_price AS DOUBLE) AS price, l.addon_unit_price,
         CAST(l.applied_discount_amount AS DOUBLE) AS line_discount,
         coalesce(b.did, -(c.merchant_id + 1)) AS discount_id,
         CASE WHEN b.did IS NOT NULL THEN b.dtype ELSE 'flat' END AS discount_type,
         CASE WHEN b.did IS NOT NULL THEN CAST(b.dvalue AS DOUBLE) ELSE 0.0 END AS discount_value,
         CASE WHEN p.id IS NULL OR p.merchant_id <> c.merchant_id THEN 'product_not_found'
              WHEN l.addon_missing > 0 THEN 'addon_not_found' END AS line_reason
  FROM lines l JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id LEFT JOIN best b ON b.tid = l.id),
m0 AS (
  SELECT cart_id, CASE WHEN id % 11 = 0 THEN NULL WHEN id % 23 = 0 THEN 'bitcoin' ELSE payment_type END AS payment_method
  FROM v_orders),
m AS (
  SELECT cart_id, payment_method, payment_method IS NOT NULL AS preview,
         CASE WHEN payment_method IS NULL THEN 0.0
              ELSE CAST(CASE lower(trim(payment_method)) WHEN 'card' THEN 8.0 WHEN 'cash' THEN 15.0 END AS DOUBLE) END AS vat_rate
  FROM m0),
lv AS (
  SELECT m.cart_id, pv.* EXCLUDE (cart_id), m.payment_method, m.preview, m.vat_rate,
         {r2('price * quantity + coalesce(addon_unit_price, 0) * quantity - line_discount')} AS sub
  FROM m LEFT JOIN pv ON pv.cart_id = m.cart_id),
lv2 AS (SELECT *, {r2('sub * vat_rate / 100')} AS vat,
               row_number() OVER (PARTITION BY cart_id ORDER BY CASE WHEN discount_id IS NULL THEN 1 ELSE 0 END, product_id, item_id) AS disc_rank,
               row_number() OVER (PARTITION BY cart_id ORDER BY CASE WHEN line_reason IS NULL THEN 1 ELSE 0 END, product_id, item_id) AS err_rank
        FROM lv),
g AS (
  SELECT cart_id, payment_method, preview, vat_rate, CAST(count(item_id) AS BIGINT) AS item_count,
         coalesce(sum(CAST(sub AS DECIMAL(14,2))), 0) AS s, coalesce(sum(CAST(vat AS DECIMAL(14,2))), 0) AS v,
         sum(CAST(line_discount AS DECIMAL(14,2))) AS d_all,
         sum(CASE WHEN discount_id IS NOT NULL THEN CAST(line_discount AS DECIMAL(14,2)) END) AS d_sum,
         max(CASE WHEN disc_rank = 1 AND discount_id IS NOT NULL THEN discount_id END) AS f_id,
         max(CASE WHEN disc_rank = 1 AND discount_id IS NOT NULL THEN discount_type END) AS f_type,
         max(CASE WHEN disc_rank = 1 AND discount_id IS NOT NULL THEN discount_value END) AS f_value,
         max(CASE WHEN err_rank = 1 THEN line_reason END) AS line_reason
  FROM lv2 GROUP BY 1, 2, 3, 4),
r AS (
  SELECT g.*, CASE WHEN vat_rate IS NULL THEN 'invalid_payment_method' ELSE line_reason END AS reason,
         f_id IS NOT NULL AND d_all <> 0 AS show_disc
  FROM g)
SELECT cart_id, payment_method, CASE WHEN reason IS NULL AND preview THEN vat_rate END AS vat_rate, item_count,
       CASE WHEN reason IS NULL AND preview THEN {r2('s')} END AS subtotal,
       CASE WHEN reason IS NULL AND preview THEN {r2('v')} END AS total_vat,
       CASE WHEN reason IS NULL THEN {r2('s + v')} END AS total_price,
       CASE WHEN reason IS NULL AND show_disc THEN f_id END AS discount_id,
       CASE WHEN reason IS NULL AND show_disc THEN f_type END AS discount_type,
       CASE WHEN reason IS NULL AND show_disc THEN f_value END AS discount_value,
       CASE WHEN reason IS NULL AND show_disc THEN {r2('d_sum')} END AS discount_amount,
       reason
FROM r
""")


# --- orders ------------------------------------------------------------------

_KARACHI_NOW = "(hour(TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 5 HOUR) * 60 + minute(TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 5 HOUR))"


def is_open_sql(o: str, c: str, now: str = _KARACHI_NOW) -> str:
    return (f"(CASE WHEN {o} = {c} THEN true WHEN {o} < {c} THEN {now} >= {o} AND {now} < {c} "
            f"ELSE {now} >= {o} OR {now} < {c} END)")


# branch minutes at a request's own time
_KARACHI_ASKED = "(hour(rq.asked_at + INTERVAL 5 HOUR) * 60 + minute(rq.asked_at + INTERVAL 5 HOUR))"


_ORDERS = f"""
req AS (
  SELECT cart_id, CASE WHEN id % 97 = 0 THEN 'crypto' WHEN id % 5 = 0 THEN concat(' ', upper(payment_type), ' ')
                       ELSE payment_type END AS payment_type,
         actor_id AS viewer_id, coalesce(created_at, TIMESTAMP '2024-01-20 00:00:00') AS asked_at
  FROM v_orders),
rq AS (SELECT *, CAST(CASE lower(trim(payment_type)) WHEN 'card' THEN 8.0 WHEN 'cash' THEN 15.0 END AS DOUBLE) AS vat_rate FROM req),
flags AS (
  SELECT a.id AS actor_id, max(CASE WHEN ar.role_type = 'merchant' THEN ar.merchant_id END) AS merchant_role_of,
         max(CASE WHEN ar.role_type = 'customer' THEN ar.merchant_id END) AS customer_role_of
  FROM v_actors a JOIN v_actor_roles ar ON ar.actor_id = a.id AND ar.merchant_id = a.merchant_id GROUP BY 1),
xa AS (SELECT DISTINCT cart_item_id, addon_id FROM v_cart_item_addons WHERE addon_id IS NOT NULL AND addon_id <> 0),
merged AS (
  SELECT cart_id, product_id, CAST(sum(quantity) AS INTEGER) AS quantity,
         sum(CAST(round(CAST(coalesce(applied_discount_amount, 0) AS DOUBLE) * 100) / 100 AS DECIMAL(12,2))) AS discount_amount
  FROM v_cart_items GROUP BY 1, 2),
addon_q AS (
  SELECT i.cart_id, i.product_id, x.addon_id, sum(i.quantity) AS addon_quantity
  FROM v_cart_items i JOIN xa x ON x.cart_item_id = i.id GROUP BY 1, 2, 3),
al AS (
  SELECT q.*, a.name AS addon_name, a.price AS addon_price,
         CASE WHEN a.id IS NULL THEN 'addon_not_found' WHEN a.product_id <> q.product_id THEN 'addon_wrong_product' END AS err,
         {r2('CAST(a.price AS DOUBLE) * q.addon_quantity')} AS line_addon_total
  FROM addon_q q LEFT JOIN v_product_addons a ON a.id = q.addon_id),
aagg AS (
  SELECT cart_id, product_id, {r2('sum(line_addon_total)')} AS addon_amount,
         arg_min(err, CAST(addon_id AS VARCHAR)) FILTER (WHERE err IS NOT NULL) AS addon_reason
  FROM al GROUP BY 1, 2),
ml AS (
  SELECT m.*, c.merchant_id, c.branch_id, p.merchant_id AS pm, p.name AS product_name, p.base_price AS price, p.track_inventory,
         inv.quantity AS stock, coalesce(g.addon_amount, 0.0) AS addon_amount, g.addon_reason,
         CASE WHEN p.id IS NULL OR p.merchant_id <> c.merchant_id THEN 'product_not_found'
              WHEN coalesce(p.track_inventory, false) AND c.branch_id IS NOT NULL AND inv.quantity IS NULL THEN 'inventory_not_found'
              WHEN coalesce(p.track_inventory, false) AND c.branch_id IS NOT NULL AND inv.quantity < m.quantity THEN 'insufficient_inventory'
              WHEN g.addon_reason IS NOT NULL THEN g.addon_reason END AS stage1
  FROM merged m JOIN v_carts c ON c.id = m.cart_id
  LEFT JOIN v_products p ON p.id = m.product_id
  LEFT JOIN v_product_inventory inv ON inv.product_id = m.product_id AND inv.branch_id = c.branch_id
  LEFT JOIN aagg g ON g.cart_id = m.cart_id AND g.product_id = m.product_id),
pcl AS (
  SELECT cart_id, arg_min(stage1, product_id) FILTER (WHERE stage1 IS NOT NULL) AS line_err1, count(*) AS n_lines
  FROM ml GROUP BY 1),
rawq AS (SELECT cart_id, min(quantity) AS min_q FROM v_cart_items GROUP BY 1),
r AS (
  SELECT rq.*, c.merchant_id, c.branch_id, c.actor_id AS cart_actor_id,
    CASE WHEN rq.vat_rate IS NULL THEN 'invalid_payment_type'
         WHEN c.id IS NULL THEN 'cart_not_found'
         WHEN c.actor_id IS NOT NULL AND NOT coalesce(f.merchant_role_of = c.merchant_id, false)
              AND NOT coalesce(f.customer_role_of = c.merchant_id AND c.actor_id = rq.viewer_id, false) THEN 'forbidden'
         WHEN b.id IS NULL OR b.merchant_id <> c.merchant_id THEN 'branch_not_found'
         WHEN NOT {is_open_sql('b.opening_time_minutes', 'b.closing_time_minutes', _KARACHI_ASKED)} THEN 'branch_closed'
         WHEN coalesce(q.min_q, 1) <= 0 THEN 'quantity_not_positive'
         WHEN l.line_err1 IS NOT NULL THEN l.line_err1
         WHEN coalesce(l.n_lines, 0) = 0 THEN 'cart_empty' END AS pre_reason
  FROM rq LEFT JOIN v_carts c ON c.id = rq.cart_id
  LEFT JOIN flags f ON f.actor_id = rq.viewer_id
  LEFT JOIN v_branches b ON b.id = c.branch_id
  LEFT JOIN rawq q ON q.cart_id = rq.cart_id
  LEFT JOIN pcl l ON l.cart_id = rq.cart_id),
bl0 AS (
  SELECT ml.*, r.payment_type, r.vat_rate, {r2('ml.quantity * CAST(ml.price AS DOUBLE)')} AS base_amount
  FROM ml JOIN r ON r.cart_id = ml.cart_id AND r.pre_reason IS NULL),
bl1 AS (SELECT *, {r2('base_amount + addon_amount - CAST(discount_amount AS DOUBLE)')} AS line_subtotal FROM bl0),
bl2 AS (SELECT *, {r2('line_subtotal * (vat_rate / 100.0)')} AS tax_amount FROM bl1),
bl AS (SELECT *, {r2('line_subtotal + tax_amount')} AS line_total,
              CASE WHEN discount_amount < 0 THEN 'negative_discount' WHEN line_subtotal < 0 THEN 'discount_exceeds_line' END AS stage2
       FROM bl2),
tot AS (
  SELECT cart_id, arg_min(stage2, product_id) FILTER (WHERE stage2 IS NOT NULL) AS line_err2,
         sum(CAST(line_subtotal AS DECIMAL(14,2))) AS s, sum(CAST(tax_amount AS DECIMAL(14,2))) AS t,
         sum(CAST(line_total AS DECIMAL(14,2))) AS g
  FROM bl GROUP BY 1),
fin AS (SELECT r.*, tot.s, tot.t, tot.g, coalesce(r.pre_reason, tot.line_err2) AS reason FROM r LEFT JOIN tot USING (cart_id))"""

# Serial stock use: orders that pass against the opening stock are replayed one at a time per branch; `fin2` holds every
# request's outcome, its lines checked against the stock left when it came.
_SERIAL = _ORDERS + """,
acc AS (SELECT cart_id AS order_id, branch_id FROM fin WHERE reason IS NULL),
cand AS (
  SELECT bl.cart_id AS order_id, bl.branch_id, bl.product_id, bl.quantity
  FROM bl JOIN acc ON acc.order_id = bl.cart_id WHERE coalesce(bl.track_inventory, false)),
ord AS (
  SELECT c.branch_id, c.order_id,
         row_number() OVER (PARTITION BY c.branch_id ORDER BY o.created_at, c.order_id) AS rn
  FROM (SELECT DISTINCT branch_id, order_id FROM cand) c JOIN v_orders o ON o.id = c.order_id),
fold(branch_id, rn, product_id, remaining, order_id, ok) AS (
  SELECT i.branch_id, CAST(0 AS BIGINT), i.product_id, i.quantity, CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN)
  FROM v_product_inventory i WHERE i.branch_id IN (SELECT branch_id FROM ord)
  UNION ALL
  SELECT branch_id, rn + 1, product_id,
         remaining - CASE WHEN step_ok THEN coalesce(quantity, 0) ELSE 0 END, next_order, step_ok
  FROM (
    SELECT s.branch_id, s.rn, s.product_id, s.remaining, o.order_id AS next_order, l.quantity,
           bool_and(l.quantity IS NULL OR s.remaining >= l.quantity) OVER (PARTITION BY s.branch_id) AS step_ok
    FROM fold s JOIN ord o ON o.branch_id = s.branch_id AND o.rn = s.rn + 1
    LEFT JOIN cand l ON l.order_id = o.order_id AND l.product_id = s.product_id) x),
dec AS (SELECT DISTINCT order_id, ok FROM fold WHERE order_id IS NOT NULL),
alloc AS (SELECT a.order_id, coalesce(d.ok, true) AS ok FROM acc a LEFT JOIN dec d ON d.order_id = a.order_id),
seen AS (
  SELECT ml.cart_id, ml.product_id, ml.quantity, ml.stage1, ml.addon_reason, ml.stock, coalesce(ml.track_inventory, false) AS tracked,
         coalesce(sum(CASE WHEN s.ok AND coalesce(ml.track_inventory, false) THEN ml.quantity ELSE 0 END)
           OVER (PARTITION BY ml.branch_id, ml.product_id ORDER BY o.created_at, ml.cart_id
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken
  FROM ml JOIN v_orders o ON o.id = ml.cart_id LEFT JOIN alloc s ON s.order_id = ml.cart_id),
seen2 AS (
  SELECT cart_id, product_id, CASE WHEN stage1 IN ('product_not_found', 'inventory_not_found') THEN stage1
                                   WHEN tracked AND stock - taken < quantity THEN 'insufficient_inventory'
                                   ELSE addon_reason END AS err
  FROM seen),
serr AS (SELECT cart_id, arg_min(err, product_id) FILTER (WHERE err IS NOT NULL) AS err FROM seen2 GROUP BY 1),
fin2 AS (
  SELECT fin.* EXCLUDE (reason),
         CASE WHEN pre_reason IN ('invalid_payment_type', 'cart_not_found', 'forbidden', 'branch_not_found', 'branch_closed',
                                  'quantity_not_positive') THEN pre_reason
              ELSE coalesce(serr.err, fin.reason) END AS reason
  FROM fin LEFT JOIN serr ON serr.cart_id = fin.cart_id)"""

sql("merged_cart_lines", f"""
WITH {_ORDERS.strip()},
asum AS (SELECT cart_id, product_id, count(*) AS n_addons, sum(addon_quantity) AS addon_units FROM addon_q GROUP BY 1, 2)
SELECT m.cart_id, m.product_id, CAST(m.quantity AS BIGINT) AS quantity, CAST(m.discount_amount AS DOUBLE) AS discount_amount,
       CAST(coalesce(a.n_addons, 0) AS BIGINT) AS n_addons, CAST(coalesce(a.addon_units, 0) AS BIGINT) AS addon_units
FROM merged m LEFT JOIN asum a USING (cart_id, product_id)
""")

sql("order_bills", f"""
WITH RECURSIVE {_SERIAL.strip()}
SELECT cart_id AS order_id, merchant_id, branch_id, cart_actor_id AS actor_id, lower(trim(payment_type)) AS payment_type, vat_rate,
       {r2('s')} AS subtotal, {r2('t')} AS total_tax, {r2('g')} AS total, 'pending' AS status
FROM fin2 WHERE reason IS NULL
""")

sql("order_lines", f"""
WITH RECURSIVE {_SERIAL.strip()}
SELECT bl.cart_id AS order_id, bl.product_id, bl.product_name, bl.quantity, CAST(bl.price AS DOUBLE) AS price, bl.base_amount,
       bl.addon_amount, CAST(bl.discount_amount AS DOUBLE) AS discount_amount, bl.line_subtotal, bl.tax_amount, bl.line_total
FROM bl JOIN fin2 ON fin2.cart_id = bl.cart_id AND fin2.reason IS NULL
""")

sql("order_rejects", f"""
WITH RECURSIVE {_SERIAL.strip()}
SELECT cart_id, payment_type, viewer_id, reason FROM fin2 WHERE reason IS NOT NULL
""")

sql("order_inventory", f"""
WITH RECURSIVE {_SERIAL.strip()},
used AS (
  SELECT ml.product_id, ml.branch_id, sum(ml.quantity) AS used
  FROM ml JOIN fin2 ON fin2.cart_id = ml.cart_id AND fin2.reason IS NULL
  WHERE coalesce(ml.track_inventory, false) GROUP BY 1, 2)
SELECT i.product_id, i.branch_id, CAST(i.quantity - coalesce(u.used, 0) AS INTEGER) AS quantity
FROM v_product_inventory i LEFT JOIN used u ON u.product_id = i.product_id AND u.branch_id = i.branch_id
""")

sql("status_transitions", """
WITH t(to_status) AS (VALUES ('pending'), ('accepted'), ('out_for_delivery'), ('delivered'), ('cancelled'), ('refunded')),
ok(f, t) AS (VALUES ('pending', 'accepted'), ('pending', 'cancelled'), ('accepted', 'out_for_delivery'), ('accepted', 'cancelled'),
                    ('out_for_delivery', 'delivered'), ('out_for_delivery', 'cancelled'), ('delivered', 'refunded'))
SELECT o.id AS order_id, o.status AS from_status, t.to_status,
       EXISTS (SELECT 1 FROM ok WHERE ok.f = o.status AND ok.t = t.to_status) AS allowed
FROM v_orders o, t
""")

sql("status_fold", """
WITH RECURSIVE
ok(f, t) AS (VALUES ('pending', 'accepted'), ('pending', 'cancelled'), ('accepted', 'out_for_delivery'), ('accepted', 'cancelled'),
                    ('out_for_delivery', 'delivered'), ('out_for_delivery', 'cancelled'), ('delivered', 'refunded')),
r AS (SELECT order_ref, requested_status AS t, row_number() OVER (PARTITION BY order_ref ORDER BY ts, event_id) AS rn
      FROM v_status_requests),
fold(order_ref, rn, state, applied) AS (
  SELECT DISTINCT order_ref, CAST(0 AS BIGINT), 'pending', 0 FROM r
  UNION ALL
  SELECT f.order_ref, f.rn + 1,
         CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t) THEN r.t ELSE f.state END,
         f.applied + CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t) THEN 1 ELSE 0 END
  FROM fold f JOIN r ON r.order_ref = f.order_ref AND r.rn = f.rn + 1)
SELECT order_ref, arg_max(state, rn) AS final_status, CAST(max(rn) AS BIGINT) AS n_requests,
       CAST(arg_max(applied, rn) AS BIGINT) AS n_applied, CAST(max(rn) - arg_max(applied, rn) AS BIGINT) AS n_rejected
FROM fold GROUP BY 1
""")


# --- branch hours and coverage -------------------------------------------------

_CLOCK_RE = "'^([0-9]{1,2}):([0-9]{2})$'"

sql("clock_parse", f"""
WITH t AS (
  SELECT event_id,
         CASE WHEN event_id % 7 = 0 THEN 'not-a-time'
              WHEN event_id % 5 = 0 THEN concat(CAST(user_id % 30 AS VARCHAR), ':', lpad(CAST(minute(ts) AS VARCHAR), 2, '0'))
              ELSE concat(lpad(CAST(hour(ts) AS VARCHAR), 2, '0'), ':', lpad(CAST(minute(ts) AS VARCHAR), 2, '0')) END AS text
  FROM events),
p AS (
  SELECT event_id, text,
         CASE WHEN regexp_matches(text, {_CLOCK_RE})
               AND CAST(regexp_extract(text, {_CLOCK_RE}, 1) AS INTEGER) <= 23
               AND CAST(regexp_extract(text, {_CLOCK_RE}, 2) AS INTEGER) <= 59
              THEN CAST(regexp_extract(text, {_CLOCK_RE}, 1) AS INTEGER) * 60 + CAST(regexp_extract(text, {_CLOCK_RE}, 2) AS INTEGER)
         END AS minutes
  FROM t)
SELECT event_id, text, minutes, minutes IS NOT NULL AS valid FROM p
""")


def fmt_clock(m: str) -> str:
    x = f"(greatest({m}, 0) % 1440)"
    return f"concat(lpad(CAST(CAST(floor({x} / 60) AS BIGINT) AS VARCHAR), 2, '0'), ':', lpad(CAST({x} % 60 AS VARCHAR), 2, '0'))"


sql("branch_availability", f"""
SELECT id, merchant_id, name, {is_open_sql('opening_time_minutes', 'closing_time_minutes')} AS is_open,
       {fmt_clock('opening_time_minutes')} AS opening_time, {fmt_clock('closing_time_minutes')} AS closing_time,
       strftime(TIMESTAMP '2024-01-20 00:00:00' + INTERVAL 5 HOUR, '%H:%M') AS current_time, 'Asia/Karachi' AS timezone_name
FROM v_branches
""")

_SZ = """
sz AS (
  SELECT s.id, s.merchant_id, s.zone_id, s.branch_id, z.name AS zone_name, coalesce(b.name, '') AS branch_name,
         a.id AS area_id, a.name AS area_name, a.city AS area_city, s.created_at, z.coordinates_wkt
  FROM v_service_zones s JOIN v_zones z ON z.id = s.zone_id JOIN v_areas a ON a.id = z.area_id
  LEFT JOIN v_branches b ON b.id = s.branch_id)"""

sql("service_zones", f"""
WITH {_SZ.strip()}
SELECT id, merchant_id, zone_id, branch_id, zone_name, branch_name, area_id, area_name, area_city, {ts('created_at')} AS created_at
FROM sz
""")

sql("areas_zones", """
SELECT z.id AS zone_id, z.name AS zone_name, z.area_id, a.name AS area_name, a.city AS area_city, true AS is_valid,
       z.coordinates_wkt
FROM v_zones z JOIN v_areas a ON a.id = z.area_id
""")

sql("zone_coverage", f"""
WITH {_SZ.strip()},
rings AS (
  SELECT id AS sz_id, unnest(regexp_split_to_array(regexp_extract(upper(coordinates_wkt), '^\\s*POLYGON\\s*\\(\\s*\\((.*)\\)\\s*\\)\\s*$', 1),
                                                  '\\)\\s*,\\s*\\(')) AS ring_txt
  FROM sz),
pts AS (SELECT sz_id, regexp_split_to_array(trim(ring_txt), '\\s*,\\s*') AS plist FROM rings),
e0 AS (SELECT sz_id, plist, unnest(range(1, len(plist))) AS i FROM pts),
edges AS (
  SELECT sz_id,
         CAST(string_split(trim(plist[i]), ' ')[1] AS DOUBLE) AS x1, CAST(string_split(trim(plist[i]), ' ')[2] AS DOUBLE) AS y1,
         CAST(string_split(trim(plist[i + 1]), ' ')[1] AS DOUBLE) AS x2, CAST(string_split(trim(plist[i + 1]), ' ')[2] AS DOUBLE) AS y2
  FROM e0),
pair AS (
  SELECT p.id AS pid, s.id AS sz_id,
         bool_or((x2 - x1) * (p.lat - y1) - (y2 - y1) * (p.lon - x1) = 0
                 AND p.lon BETWEEN least(x1, x2) AND greatest(x1, x2) AND p.lat BETWEEN least(y1, y2) AND greatest(y1, y2)) AS on_edge,
         sum(CASE WHEN ((y1 > p.lat) <> (y2 > p.lat)) AND p.lon < (x2 - x1) * (p.lat - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) AS crossings
  FROM v_points p JOIN sz s ON s.merchant_id = p.merchant_id JOIN edges e ON e.sz_id = s.id
  GROUP BY 1, 2),
hit AS (
  SELECT pr.pid, s.*, row_number() OVER (PARTITION BY pr.pid ORDER BY s.created_at DESC, s.id) AS rn
  FROM pair pr JOIN sz s ON s.id = pr.sz_id
  WHERE pr.on_edge OR pr.crossings % 2 = 1)
SELECT p.id, p.merchant_id, p.lon, p.lat, h.pid IS NOT NULL AS covered, h.zone_id, h.branch_id, h.zone_name, h.branch_name,
       h.area_id, h.area_name, h.area_city
FROM v_points p LEFT JOIN hit h ON h.pid = p.id AND h.rn = 1
""")


# --- data quality and batch validation -----------------------------------------


def dup_check(table: str, keys: list[str], name: str, source: str | None = None) -> str:
    src = source or table
    kt = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    nn = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    return (f"SELECT '{name}' AS constraint, {kt} AS key, CAST(count(*) AS BIGINT) AS n_rows FROM {src} "
            f"WHERE {nn} GROUP BY {', '.join(keys)} HAVING count(*) > 1")


sql("unique_violations", f"""
WITH {_LINES.strip()}
{dup_check('lines', ['cart_id', 'product_id', 'addon_key'], 'cart_items_cart_product_addons_key')}
UNION ALL {dup_check('v_order_items', ['order_id', 'product_id'], 'order_items_pkey')}
UNION ALL {dup_check('v_product_inventory', ['product_id', 'branch_id'], 'product_inventory_product_branch_key')}
UNION ALL {dup_check('v_product_categories', ['merchant_id', 'name'], 'product_categories_merchant_name_key')}
UNION ALL {dup_check('v_actors', ['merchant_id', 'email'], 'actors_merchant_email_key')}
UNION ALL {dup_check('v_service_zones', ['merchant_id', 'zone_id', 'branch_id'], 'merchant_service_zones_key')}
UNION ALL {dup_check('v_cart_items', ['id'], 'cart_items_pkey')}
""")


sql("admit_sessions", """
WITH RECURSIVE inc AS (
  SELECT event_id, user_id, concat(user_id, ':', CAST(floor(value) AS BIGINT)) AS id,
         CASE WHEN event_type <> 'error' THEN concat(user_id, ':', strftime(ts, '%Y-%m-%d')) END AS refresh_token,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events),
fold AS (
  SELECT u.user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS id,
         CAST(NULL AS VARCHAR) AS refresh_token, CAST(NULL AS VARCHAR) AS reason,
         CASE WHEN a.id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [concat(a.id, ':1')] END AS ids,
         CASE WHEN a.id IS NULL THEN CAST([] AS VARCHAR[]) ELSE [concat(a.id, ':2024-01-01')] END AS tokens
  FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN v_actors a ON a.id = u.user_id
  UNION ALL
  SELECT user_id, rn, event_id, id, refresh_token, reason,
         CASE WHEN reason IS NULL THEN list_append(ids, id) ELSE ids END,
         CASE WHEN reason IS NULL AND refresh_token IS NOT NULL THEN list_append(tokens, refresh_token) ELSE tokens END
  FROM (SELECT i.user_id, i.rn, i.event_id, i.id, i.refresh_token, f.ids, f.tokens,
               CASE WHEN list_contains(f.ids, i.id) THEN 'sessions_pkey'
                    WHEN i.refresh_token IS NOT NULL AND list_contains(f.tokens, i.refresh_token) THEN 'sessions_refresh_token_key' END AS reason
        FROM fold f JOIN inc i ON i.user_id = f.user_id AND i.rn = f.rn + 1) x)
SELECT event_id, id, refresh_token, reason IS NULL AS accepted, reason FROM fold WHERE rn > 0
""")


def fk_check(child: str, cols: list[str], parent: str, pcols: list[str], name: str) -> str:
    kt = "concat_ws('|', " + ", ".join(f"CAST(c.{k} AS VARCHAR)" for k in cols) + ")"
    nn = " AND ".join(f"c.{k} IS NOT NULL" for k in cols)
    match = " AND ".join(f"p.{pc} = c.{cc}" for cc, pc in zip(cols, pcols))
    return f"SELECT '{name}' AS constraint, {kt} AS key FROM {child} c WHERE {nn} AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE {match})"


sql("fk_orphans", " UNION ALL ".join([
    fk_check("v_cart_items", ["product_id"], "v_products", ["id"], "cart_items_product_id_fkey"),
    fk_check("v_carts", ["branch_id"], "v_branches", ["id"], "carts_branch_id_fkey"),
    fk_check("v_carts", ["merchant_id", "actor_id"], "v_actors", ["merchant_id", "id"], "carts_actor_fkey"),
    fk_check("v_orders", ["merchant_id", "actor_id"], "v_actors", ["merchant_id", "id"], "orders_actor_fkey"),
    fk_check("v_service_zones", ["branch_id"], "v_branches", ["id"], "merchant_service_zones_branch_id_fkey"),
    fk_check("v_products", ["category_id"], "v_product_categories", ["id"], "products_category_id_fkey"),
    fk_check("v_order_items", ["product_id"], "v_products", ["id"], "order_items_product_id_fkey"),
    fk_check("v_branches", ["merchant_id"], "v_merchants", ["id"], "branches_merchant_id_fkey"),
    fk_check("(SELECT CASE WHEN id % 50 = 0 THEN product_id + 1000000000 ELSE product_id END AS product_id FROM v_cart_items)",
             ["product_id"], "v_products", ["id"], "incoming_cart_items_product_id_fkey"),
    fk_check("(SELECT merchant_id, CASE WHEN id % 7 = 0 THEN actor_id + 1 ELSE actor_id END AS actor_id FROM v_carts)",
             ["merchant_id", "actor_id"], "v_actors", ["merchant_id", "id"], "incoming_carts_actor_fkey"),
]))


def rule_check(table: str, name: str, keys: list[str], rules: list[tuple[str, str]]) -> str:
    kt = "concat_ws('|', " + ", ".join(f"CAST({k} AS VARCHAR)" for k in keys) + ")"
    parts = ", ".join(f"CASE WHEN NOT coalesce({cond}, true) THEN '{rn}' END" for rn, cond in rules)
    return (f"SELECT table_name, key, violations FROM (SELECT '{name}' AS table_name, {kt} AS key, "
            f"concat_ws(',', {parts}) AS violations FROM {table}) WHERE violations <> ''")


_EMAIL = r"'^[^@\s]+@[^@\s]+\.[^@\s]+$'"

sql("rule_violations", " UNION ALL ".join([
    rule_check("v_order_items", "order_items", ["order_id", "product_id"], [
        ("price_nonneg", "price >= 0"), ("quantity_positive", "quantity > 0"), ("base_amount_nonneg", "base_amount >= 0"),
        ("addon_amount_nonneg", "addon_amount >= 0"), ("discount_amount_nonneg", "discount_amount >= 0"),
        ("tax_amount_nonneg", "tax_amount >= 0"), ("line_total_nonneg", "line_total >= 0")]),
    rule_check("v_branches", "branches", ["id"], [
        ("opening_time_range", "opening_time_minutes BETWEEN 0 AND 1439"),
        ("closing_time_range", "closing_time_minutes BETWEEN 0 AND 1439"),
        ("city_enum", "city IN ('Karachi', 'Lahore')")]),
    rule_check("v_discounts", "merchant_discounts", ["id"], [
        ("single_scope", "NOT (product_id IS NOT NULL AND category_id IS NOT NULL)"),
        ("type_enum", "type IN ('flat', 'percentage')")]),
    rule_check("v_orders", "orders", ["id"], [
        ("payment_type_enum", "payment_type IN ('card', 'cash')"),
        ("status_enum", "status IN ('pending', 'accepted', 'out_for_delivery', 'delivered', 'refunded', 'cancelled')")]),
    rule_check("v_actors", "actors", ["id"], [
        ("email_format", f"regexp_matches(email, {_EMAIL})"),
        ("first_name_required", "coalesce(trim(CAST(first_name AS VARCHAR)), '') <> ''")]),
    rule_check("v_cart_items", "cart_items", ["id"], [
        ("quantity_positive", "quantity > 0"), ("discount_amount_nonneg", "applied_discount_amount >= 0")]),
    rule_check("(SELECT order_id, product_id, quantity - 10 AS quantity, price - 1000 AS price FROM v_order_items)", "incoming_order_items",
               ["order_id", "product_id"], [("price_nonneg", "price >= 0"), ("quantity_positive", "quantity > 0")]),
    rule_check("(SELECT id, CASE WHEN id % 9 = 0 THEN 'lost' ELSE status END AS status FROM v_orders)", "incoming_orders", ["id"], [
        ("status_enum", "status IN ('pending', 'accepted', 'out_for_delivery', 'delivered', 'cancelled', 'refunded')")]),
]))


def _blank(c: str) -> str:
    return f"coalesce(trim({c}), '') = ''"


def _clock_ok(c: str) -> str:
    return (f"coalesce(regexp_matches({c}, {_CLOCK_RE}) AND TRY_CAST(regexp_extract({c}, {_CLOCK_RE}, 1) AS INTEGER) <= 23 "
            f"AND TRY_CAST(regexp_extract({c}, {_CLOCK_RE}, 2) AS INTEGER) <= 59, false)")


sql("batch_validation", rf"""
WITH
inv AS (
  SELECT c.merchant_id, i.product_id, c.branch_id, i.quantity - 25 AS quantity
  FROM v_cart_items i JOIN v_carts c ON c.id = i.cart_id),
inv_r AS (
  SELECT CASE WHEN p.merchant_id IS NULL OR p.merchant_id <> x.merchant_id THEN 'product_not_found'
              WHEN NOT p.track_inventory THEN 'product_not_tracked'
              WHEN b.id IS NULL OR b.merchant_id <> x.merchant_id THEN 'branch_not_found'
              WHEN x.quantity < 0 THEN 'negative_quantity' END AS reason
  FROM inv x LEFT JOIN v_products p ON p.id = x.product_id LEFT JOIN v_branches b ON b.id = x.branch_id),
prod AS (
  SELECT p_partkey % 10 AS merchant_id,
         CASE WHEN p_partkey % 4 = 0 THEN concat(CAST((p_partkey + 1) % 10 AS VARCHAR), ':', p_type)
              WHEN p_partkey % 4 = 1 THEN NULL ELSE concat(CAST(p_partkey % 10 AS VARCHAR), ':', p_type) END AS category_id,
         CASE WHEN p_partkey % 50 = 0 THEN ' ' ELSE p_name END AS name, p_retailprice - 1000 AS base_price
  FROM part),
prod_r AS (
  SELECT CASE WHEN {_blank('x.name')} THEN 'name_required'
              WHEN x.category_id IS NOT NULL AND (c.id IS NULL OR c.merchant_id <> x.merchant_id) THEN 'category_not_found'
              WHEN NOT (x.base_price > 0) THEN 'price_not_positive' END AS reason
  FROM prod x LEFT JOIN v_product_categories c ON c.id = x.category_id),
addon AS (
  SELECT CASE WHEN id % 7 = 0 THEN (product_id + 1) % 10 ELSE product_id % 10 END AS merchant_id, product_id, name,
         price - 5 AS price
  FROM v_product_addons),
addon_r AS (
  SELECT CASE WHEN {_blank('x.name')} THEN 'name_required'
              WHEN p.merchant_id IS NULL OR p.merchant_id <> x.merchant_id THEN 'product_not_found'
              WHEN NOT (x.price > 0) THEN 'price_not_positive' END AS reason
  FROM addon x LEFT JOIN v_products p ON p.id = x.product_id),
disc AS (
  SELECT merchant_id, CASE WHEN id % 5 = 0 THEN 'bogus' ELSE type END AS type, value - 10 AS value,
         CASE WHEN id % 3 = 0 THEN product_id ELSE product_id + 1 END AS product_id,
         CASE WHEN id % 11 = 0 THEN concat(CAST(merchant_id AS VARCHAR), ':X') ELSE category_id END AS category_id
  FROM v_discounts),
disc_r AS (
  SELECT CASE WHEN NOT coalesce(x.type IN ('percentage', 'flat'), false) THEN 'invalid_type'
              WHEN NOT (x.value > 0) THEN 'value_not_positive'
              WHEN x.product_id IS NOT NULL AND x.category_id IS NOT NULL THEN 'both_scopes'
              WHEN x.product_id IS NOT NULL AND (p.merchant_id IS NULL OR p.merchant_id <> x.merchant_id) THEN 'product_not_found'
              WHEN x.category_id IS NOT NULL AND (c.id IS NULL OR c.merchant_id <> x.merchant_id) THEN 'category_not_found' END AS reason
  FROM disc x LEFT JOIN v_products p ON p.id = x.product_id LEFT JOIN v_product_categories c ON c.id = x.category_id),
br AS (
  SELECT n_name AS name, concat('street ', CAST(n_nationkey AS VARCHAR)) AS address,
         CASE WHEN n_nationkey % 6 = 0 THEN '' ELSE '0300' END AS contact_number,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Karachi' WHEN n_nationkey % 3 = 1 THEN 'Lahore' ELSE 'Quetta' END AS city,
         concat(lpad(CAST((n_nationkey * 7) % 26 AS VARCHAR), 2, '0'), ':00') AS opening_time,
         concat(lpad(CAST((n_nationkey * 7) % 26 AS VARCHAR), 2, '0'), ':3') AS closing_time
  FROM nation),
br_r AS (
  SELECT CASE WHEN {_blank('name')} OR {_blank('address')} OR {_blank('contact_number')} OR {_blank('city')}
                   OR {_blank('opening_time')} OR {_blank('closing_time')} THEN 'required'
              WHEN city NOT IN ('Karachi', 'Lahore') THEN 'invalid_city'
              WHEN NOT {_clock_ok('opening_time')} THEN 'invalid opening time'
              WHEN NOT {_clock_ok('closing_time')} THEN 'invalid closing time' END AS reason
  FROM br),
zn AS (
  SELECT area_id + CASE WHEN id % 8 = 0 THEN 10 ELSE 0 END AS area_id, name,
         CASE WHEN id % 5 = 0 THEN replace(coordinates_wkt, 'POLYGON', 'LINESTRING') ELSE coordinates_wkt END AS coordinates_wkt
  FROM v_zones),
zn_r AS (
  SELECT CASE WHEN {_blank('x.name')} OR {_blank('x.coordinates_wkt')} THEN 'required'
              WHEN a.id IS NULL THEN 'area_not_found'
              WHEN NOT regexp_matches(upper(x.coordinates_wkt), '^\s*POLYGON\s*\(\s*\((.*)\)\s*\)\s*$') THEN 'invalid_polygon' END AS reason
  FROM zn x LEFT JOIN v_areas a ON a.id = x.area_id),
pt_r AS (
  SELECT CASE WHEN NOT (lat * 3 BETWEEN -90 AND 90) THEN 'invalid_latitude'
              WHEN NOT (lon BETWEEN -180 AND 180) THEN 'invalid_longitude' END AS reason
  FROM v_points),
ac AS (
  SELECT c_custkey % 10 AS merchant_id, c_name AS full_name,
         CASE WHEN c_custkey % 9 = 0 THEN 'not-an-email' WHEN c_custkey % 7 = 0 THEN 'dup@example.com'
              ELSE concat('new', CAST(c_custkey AS VARCHAR), '@example.com') END AS email,
         CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'secret' END AS password,
         CASE WHEN c_custkey % 5 = 0 THEN ' Customer ' WHEN c_custkey % 13 = 0 THEN 'admin' ELSE 'employee' END AS role
  FROM customer),
ac_n AS (SELECT merchant_id, email, count(*) AS n FROM ac GROUP BY 1, 2),
ac_r AS (
  SELECT CASE WHEN {_blank('x.full_name')} OR {_blank('x.email')} THEN 'required'
              WHEN NOT regexp_matches(x.email, {_EMAIL}) THEN 'invalid_email'
              WHEN NOT coalesce(lower(trim(x.role)) IN ('merchant', 'employee', 'customer'), false) THEN 'invalid_role'
              WHEN lower(trim(x.role)) <> 'customer' AND {_blank('x.password')} THEN 'password_required'
              WHEN EXISTS (SELECT 1 FROM v_actors a WHERE a.merchant_id = x.merchant_id AND a.email = x.email) OR n.n > 1
                   THEN 'duplicate_email' END AS reason
  FROM ac x JOIN ac_n n ON n.merchant_id = x.merchant_id AND n.email = x.email),
ar_r AS (
  SELECT CASE WHEN coalesce(trim(CASE WHEN r_regionkey % 4 = 0 THEN ' ' ELSE r_name END), '') = '' THEN 'required'
              WHEN (CASE WHEN r_regionkey % 2 = 0 THEN 'Karachi' ELSE 'Multan' END) NOT IN ('Karachi', 'Lahore') THEN 'invalid_city'
         END AS reason
  FROM region),
szb AS (
  SELECT merchant_id, zone_id, CASE WHEN zone_id % 7 = 0 THEN zone_id + 1 ELSE branch_id END AS branch_id FROM v_service_zones),
sz_r AS (
  SELECT CASE WHEN z.id IS NULL THEN 'zone_not_found'
              WHEN x.branch_id IS NOT NULL AND (b.id IS NULL OR b.merchant_id <> x.merchant_id) THEN 'branch_not_found' END AS reason
  FROM szb x LEFT JOIN v_zones z ON z.id = x.zone_id LEFT JOIN v_branches b ON b.id = x.branch_id),
allr AS (
  SELECT 'inventory' AS validator, reason FROM inv_r UNION ALL SELECT 'product', reason FROM prod_r
  UNION ALL SELECT 'addon', reason FROM addon_r UNION ALL SELECT 'discount', reason FROM disc_r
  UNION ALL SELECT 'branch', reason FROM br_r UNION ALL SELECT 'zone', reason FROM zn_r
  UNION ALL SELECT 'point', reason FROM pt_r UNION ALL SELECT 'actor', reason FROM ac_r
  UNION ALL SELECT 'area', reason FROM ar_r UNION ALL SELECT 'service_zone', reason FROM sz_r)
SELECT validator, coalesce(reason, 'ok') AS reason, CAST(count(*) AS BIGINT) AS n_rows FROM allr GROUP BY 1, 2
""")

# --- batch changes ----------------------------------------------------------------

sql("upsert_inventory", """
WITH b AS (
  SELECT i.product_id, c.branch_id, arg_max(i.quantity, i.id) AS quantity
  FROM v_cart_items i JOIN v_carts c ON c.id = i.cart_id GROUP BY 1, 2)
SELECT coalesce(t.product_id, b.product_id) AS product_id, coalesce(t.branch_id, b.branch_id) AS branch_id,
       CAST(CASE WHEN b.product_id IS NOT NULL THEN b.quantity ELSE t.quantity END AS INTEGER) AS quantity,
       CASE WHEN b.product_id IS NOT NULL AND t.product_id IS NULL THEN 'inserted'
            WHEN b.product_id IS NOT NULL THEN 'updated' ELSE 'unchanged' END AS action
FROM v_product_inventory t FULL JOIN b ON t.product_id = b.product_id AND t.branch_id = b.branch_id
""")

sql("update_by_key", """
WITH b AS (
  SELECT id, 'accepted' AS status FROM v_orders WHERE status = 'pending'
  UNION ALL SELECT id + 1000000000, 'accepted' FROM v_orders WHERE status = 'pending')
SELECT o.id, o.merchant_id, CASE WHEN b.id IS NOT NULL THEN b.status ELSE o.status END AS status, o.payment_type,
       b.id IS NOT NULL AS updated
FROM v_orders o LEFT JOIN b ON b.id = o.id
UNION ALL
SELECT b.id, CAST(NULL AS BIGINT), b.status, CAST(NULL AS VARCHAR), false
FROM b WHERE NOT EXISTS (SELECT 1 FROM v_orders o WHERE o.id = b.id)
""")

sql("delete_by_key", """
WITH k AS (
  SELECT DISTINCT cart_id, id FROM (
    SELECT cart_id, id FROM v_cart_items WHERE quantity > 45
    UNION ALL SELECT cart_id, id + 500 FROM v_cart_items WHERE quantity < 3))
SELECT i.cart_id, i.id, CASE WHEN k.id IS NOT NULL THEN 'deleted' ELSE 'kept' END AS outcome
FROM v_cart_items i LEFT JOIN k ON k.cart_id = i.cart_id AND k.id = i.id
UNION ALL
SELECT k.cart_id, k.id, 'not_found' FROM k
WHERE NOT EXISTS (SELECT 1 FROM v_cart_items i WHERE i.cart_id = k.cart_id AND i.id = k.id)
""")

sql("append_rows", f"""
SELECT id, merchant_id, actor_id, refresh_token, is_blocked, {ts('created_at')} AS created_at FROM v_sessions
UNION ALL
SELECT id + 1000000000, merchant_id, actor_id, concat('r', CAST(id AS VARCHAR)), false, '2024-01-20 00:00:00' FROM v_sessions
""")

sql("insert_then_enrich", """
SELECT s.id + 1000000000 AS id, s.merchant_id, s.actor_id, concat('r', CAST(s.id AS VARCHAR)) AS refresh_token,
       '2024-01-20 00:00:00' AS created_at, a.email AS actor_email
FROM v_sessions s JOIN v_actors a ON a.merchant_id = s.merchant_id AND a.id = s.actor_id
""")

def _cascade_sql() -> str:
    """One CTE of reached rows per request kind and table, then vetoes and outcomes."""
    from mercato.plans.queries import DELETE_REQUESTS, DELETE_RULES, DELETE_TABLES

    ctes, outcomes = [], []
    for root, which in DELETE_REQUESTS.items():
        key = {t: "concat_ws(':', " + ", ".join(f"t.{c}" for c in cols) + ")" for t, cols in DELETE_TABLES.items()}
        on = lambda cc, pc: " AND ".join(f"t.{c} = p.{q}" for c, q in zip(cc, pc))
        reached = set()
        for t in DELETE_TABLES:
            ways = [f"SELECT t.*, p.req FROM v_{t} t JOIN {root}_{par} p ON {on(cc, pc)}"
                    for ch, cc, par, pc, rule in DELETE_RULES if ch == t and rule == "cascade" and par in reached]
            if t == root:
                ways.append(f"SELECT t.*, {key[t]} AS req FROM v_{t} t WHERE {which}")
            if ways:
                reached.add(t)
                ctes.append(f"{root}_{t} AS (" + " UNION ".join(ways) + ")")
        vetoes = [f"SELECT p.req, '{ch}' AS child FROM v_{ch} t JOIN {root}_{par} p ON {on(cc, pc)}"
                  for ch, cc, par, pc, rule in DELETE_RULES if rule == "restrict" and par in reached] or ["SELECT '' AS req, '' AS child WHERE false"]
        ctes.append(f"{root}_veto AS (" + " UNION ALL ".join(vetoes) + ")")
        outcomes.append(f"SELECT '{root}' AS request, child AS table_name, 'rejected' AS outcome, req AS key, count(*) AS n_rows FROM {root}_veto GROUP BY ALL")
        free = f"req NOT IN (SELECT req FROM {root}_veto)"
        for t, cols in DELETE_TABLES.items():
            gone = (f"EXISTS (SELECT 1 FROM {root}_{t} g WHERE " + " AND ".join(f"g.{c} = t.{c}" for c in cols) + f" AND g.{free})") if t in reached else "false"
            hits = [f"EXISTS (SELECT 1 FROM {root}_{par} p WHERE {on(cc, pc)} AND p.{free})"
                    for ch, cc, par, pc, rule in DELETE_RULES if ch == t and rule == "set_null" and par in reached] or ["false"]
            outcomes.append(f"SELECT '{root}', '{t}', 'deleted', {key[t]}, 1 FROM v_{t} t WHERE {gone}")
            outcomes.append(f"SELECT '{root}', '{t}', 'cleared', {key[t]}, 1 FROM v_{t} t WHERE NOT {gone} AND ({' OR '.join(hits)})")
            outcomes.append(f"SELECT '{root}', '{t}', 'remaining', '', count(*) FROM v_{t} t WHERE NOT {gone}")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(outcomes)


sql("cascade_delete", _cascade_sql())


# --- JSON commands and streams -------------------------------------------------------

sql("json_commands", """
WITH b AS (
  SELECT id,
         CASE WHEN id % 50 = 0 THEN NULL ELSE CAST(cart_id AS VARCHAR) END AS cart_id,
         CASE WHEN id % 50 = 0 THEN NULL WHEN id % 9 = 0 THEN 'bitcoin' ELSE payment_type END AS payment_type,
         CASE WHEN id % 13 = 0 THEN '' ELSE concat('addr ', CAST(id AS VARCHAR)) END AS delivery_address,
         'name' AS customer_name,
         CASE WHEN id % 17 = 0 THEN NULL ELSE '0300' END AS customer_phone,
         id % 50 = 0 AS bad_json
  FROM v_orders),
e AS (
  SELECT *,
    CASE WHEN coalesce(trim(cart_id), '') = '' THEN 'The field is required'
         WHEN NOT coalesce(regexp_matches(cart_id, '^[0-9]+$'), false) THEN 'The field is invalid' END AS e_cart,
    CASE WHEN coalesce(trim(payment_type), '') = '' THEN 'The field is required'
         WHEN NOT coalesce(payment_type IN ('card', 'cash'), false) THEN 'The field is invalid' END AS e_pay,
    CASE WHEN coalesce(trim(delivery_address), '') = '' THEN 'The field is required' END AS e_addr,
    CASE WHEN coalesce(trim(customer_name), '') = '' THEN 'The field is required' END AS e_name,
    CASE WHEN coalesce(trim(customer_phone), '') = '' THEN 'The field is required' END AS e_phone
  FROM b)
SELECT id, bad_json, payment_type,
       CASE WHEN NOT bad_json THEN concat_ws(',', CASE WHEN e_cart IS NOT NULL THEN 'cart_id' END,
            CASE WHEN e_pay IS NOT NULL THEN 'payment_type' END, CASE WHEN e_addr IS NOT NULL THEN 'delivery_address' END,
            CASE WHEN e_name IS NOT NULL THEN 'customer_name' END, CASE WHEN e_phone IS NOT NULL THEN 'customer_phone' END) END
         AS invalid_fields,
       CASE WHEN NOT bad_json THEN concat('{', concat_ws(',',
            CASE WHEN e_cart IS NOT NULL THEN concat('"cart_id":"', e_cart, '"') END,
            CASE WHEN e_pay IS NOT NULL THEN concat('"payment_type":"', e_pay, '"') END,
            CASE WHEN e_addr IS NOT NULL THEN concat('"delivery_address":"', e_addr, '"') END,
            CASE WHEN e_name IS NOT NULL THEN concat('"customer_name":"', e_name, '"') END,
            CASE WHEN e_phone IS NOT NULL THEN concat('"customer_phone":"', e_phone, '"') END), '}') END AS errors,
       NOT bad_json AND e_cart IS NULL AND e_pay IS NULL AND e_addr IS NULL AND e_name IS NULL AND e_phone IS NULL AS accepted
FROM e
""")

sql("sales_stream", f"""
SELECT o.merchant_id, CAST(CAST(o.created_at AS DATE) AS VARCHAR) AS day,
       {r2('sum(i.line_total)')} AS total_sales, {r2('sum(i.tax_amount)')} AS total_tax,
       {r2('sum(i.discount_amount)')} AS total_discount, CAST(count(*) AS BIGINT) AS n_items
FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
WHERE o.status IN {COUNTED}
GROUP BY 1, 2
""")


sql("status_changes_authorized", """
WITH RECURSIVE
ok(f, t) AS (VALUES ('pending', 'accepted'), ('pending', 'cancelled'), ('accepted', 'out_for_delivery'), ('accepted', 'cancelled'),
                    ('out_for_delivery', 'delivered'), ('out_for_delivery', 'cancelled'), ('delivered', 'refunded')),
auth AS (
  SELECT e.event_id,
         EXISTS (SELECT 1 FROM v_actors a JOIN v_actor_roles ar ON ar.actor_id = a.id AND ar.merchant_id = a.merchant_id
                 WHERE a.id = e.user_id AND ar.role_type = 'merchant' AND a.merchant_id = e.user_id % 10) AS authorized
  FROM events e),
r AS (SELECT s.order_ref, s.requested_status AS t, a.authorized,
             row_number() OVER (PARTITION BY s.order_ref ORDER BY s.ts, s.event_id) AS rn
      FROM v_status_requests s JOIN auth a ON a.event_id = s.event_id),
fold(order_ref, rn, state, applied) AS (
  SELECT DISTINCT order_ref, CAST(0 AS BIGINT), 'pending', 0 FROM r
  UNION ALL
  SELECT f.order_ref, f.rn + 1,
         CASE WHEN r.authorized AND EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t) THEN r.t ELSE f.state END,
         f.applied + CASE WHEN r.authorized AND EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t) THEN 1 ELSE 0 END
  FROM fold f JOIN r ON r.order_ref = f.order_ref AND r.rn = f.rn + 1)
SELECT order_ref, arg_max(state, rn) AS final_status, CAST(max(rn) AS BIGINT) AS n_requests,
       CAST(arg_max(applied, rn) AS BIGINT) AS n_applied, CAST(max(rn) - arg_max(applied, rn) AS BIGINT) AS n_rejected
FROM fold GROUP BY 1
""")


sql("status_stream", """
WITH RECURSIVE
ok(f, t) AS (VALUES ('pending', 'accepted'), ('pending', 'cancelled'), ('accepted', 'out_for_delivery'), ('accepted', 'cancelled'),
                    ('out_for_delivery', 'delivered'), ('out_for_delivery', 'cancelled'), ('delivered', 'refunded')),
r AS (SELECT order_ref, event_id, ts, requested_status AS t,
             row_number() OVER (PARTITION BY order_ref ORDER BY ts, event_id) AS rn
      FROM v_status_requests),
fold(order_ref, rn, event_id, ts, from_status, to_status, applied, state) AS (
  SELECT order_ref, rn, event_id, ts, 'pending', t,
         EXISTS (SELECT 1 FROM ok WHERE ok.f = 'pending' AND ok.t = r.t),
         CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.f = 'pending' AND ok.t = r.t) THEN t ELSE 'pending' END
  FROM r WHERE rn = 1
  UNION ALL
  SELECT f.order_ref, r.rn, r.event_id, r.ts, f.state, r.t,
         EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t),
         CASE WHEN EXISTS (SELECT 1 FROM ok WHERE ok.f = f.state AND ok.t = r.t) THEN r.t ELSE f.state END
  FROM fold f JOIN r ON r.order_ref = f.order_ref AND r.rn = f.rn + 1)
SELECT order_ref, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, from_status, to_status, applied, state AS status_after
FROM fold
""")


sql("stock_allocation", f"""
WITH RECURSIVE {_SERIAL.strip()}
SELECT a.order_id, a.branch_id, coalesce(d.ok, true) AS accepted,
       CASE WHEN d.ok = false THEN 'insufficient_inventory' END AS reason
FROM acc a LEFT JOIN dec d ON d.order_id = a.order_id
""")


sql("order_detail_items", f"""
WITH RECURSIVE {_SERIAL.strip()},
done AS (SELECT cart_id, g FROM fin2 WHERE reason IS NULL),
asum AS (
  SELECT al.cart_id, al.product_id, count(*) AS n, sum(al.addon_quantity) AS u, min(al.addon_id) AS first_id
  FROM al JOIN done ON done.cart_id = al.cart_id GROUP BY 1, 2)
SELECT bl.cart_id AS order_id, {r2('done.g')} AS total, bl.product_id, bl.quantity, bl.line_total,
       CAST(coalesce(a.n, 0) AS BIGINT) AS n_addons, CAST(coalesce(a.u, 0) AS BIGINT) AS addon_units,
       a.first_id AS first_addon_id
FROM bl JOIN done ON done.cart_id = bl.cart_id
LEFT JOIN asum a ON a.cart_id = bl.cart_id AND a.product_id = bl.product_id
""")

sql("cart_detail_items", f"""
WITH {_LINES.strip()},
{best_cte(DISCOUNT_AS_OF, "SELECT l.id AS tid, l.product_id, c.merchant_id, p.category_id FROM lines l JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id").strip()},
li AS (
  SELECT l.cart_id, l.id AS item_id, l.product_id, l.quantity, CAST(p.base_price AS DOUBLE) AS price,
         CAST(l.addon_count AS BIGINT) AS n_addons, coalesce(b.did, -(c.merchant_id + 1)) AS discount_id,
         CASE WHEN p.id IS NULL OR p.merchant_id <> c.merchant_id THEN 'product_not_found'
              WHEN l.addon_missing > 0 THEN 'addon_not_found' END AS line_reason
  FROM lines l JOIN v_carts c ON c.id = l.cart_id LEFT JOIN v_products p ON p.id = l.product_id
  LEFT JOIN best b ON b.tid = l.id),
cr AS (
  SELECT cart_id, arg_min(line_reason, product_id) FILTER (WHERE line_reason IS NOT NULL) AS reason
  FROM li GROUP BY 1)
SELECT c.id AS cart_id, cr.reason, li.product_id, li.item_id, li.quantity, li.price, li.n_addons, li.discount_id
FROM v_carts c LEFT JOIN li ON li.cart_id = c.id LEFT JOIN cr ON cr.cart_id = c.id
""")


sql("json_documents_items", _RAW["order_detail_items"])


_PERIOD = """
SELECT CAST({m} AS BIGINT) AS merchant_id, CAST({y} AS INTEGER) AS year, CAST({mo} AS INTEGER) AS month,
       """ + r2("coalesce(sum(i.line_total), 0)") + """ AS total_sales,
       """ + r2("coalesce(sum(i.tax_amount), 0)") + """ AS total_tax,
       """ + r2("coalesce(sum(i.discount_amount), 0)") + """ AS total_discount,
       """ + r2("coalesce(sum(i.base_amount + i.addon_amount - i.discount_amount), 0)") + """ AS profit_estimate
FROM v_orders o JOIN v_order_items i ON i.order_id = o.id
WHERE o.merchant_id = {m} AND o.status IN """ + COUNTED + """
  AND year(o.created_at) = {y} AND month(o.created_at) = {mo}"""

sql("monthly_sales_report_periods", _PERIOD.format(m=3, y=2000, mo=6) + "\nUNION ALL" + _PERIOD.format(m=3, y=2030, mo=6))

sql("monthly_sales_report_by_month", "\nUNION ALL".join(_PERIOD.format(m=m, y=y, mo=mo) for m, mo, y in ((3, 6, 2000), (7, 1, 1999), (3, 6, 2030))))

sql("status_fold_incremental", _RAW["status_fold"])

sql("upsert_actor_roles", """
WITH b AS (
  SELECT (user_id + CASE event_type WHEN 'signup' THEN 1 ELSE 0 END) % 10 AS merchant_id, user_id AS actor_id,
         arg_max(CASE event_type WHEN 'purchase' THEN 'merchant' WHEN 'signup' THEN 'employee' ELSE 'customer' END, event_id) AS role_type
  FROM events GROUP BY 1, 2)
SELECT coalesce(t.merchant_id, b.merchant_id) AS merchant_id, coalesce(t.actor_id, b.actor_id) AS actor_id,
       coalesce(b.role_type, t.role_type) AS role_type, b.actor_id IS NOT NULL AS changed
FROM v_actor_roles t FULL JOIN b ON t.merchant_id = b.merchant_id AND t.actor_id = b.actor_id
""")

sql("upsert_order_items", """
WITH p AS (SELECT i.* FROM v_order_items i JOIN v_orders o ON o.id = i.order_id WHERE o.status = 'pending')
SELECT i.order_id, i.product_id, CAST(i.quantity + CASE WHEN o.status = 'pending' THEN 1 ELSE 0 END AS BIGINT) AS quantity,
       CAST(i.line_total AS DOUBLE) AS line_total
FROM v_order_items i JOIN v_orders o ON o.id = i.order_id
UNION ALL
SELECT order_id, product_id + 1000000000, CAST(quantity + 1 AS BIGINT), CAST(line_total AS DOUBLE) FROM p
""")


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_ctes(text) for name, text in _RAW.items()}
