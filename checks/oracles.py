"""SQL counterparts of the registered queries, for the same tables."""

from checks.queries import QUESTIONS
from tallyloom import fixed

# The sales rows, as in star.sales.
SALES = """
sales AS (
  SELECT CAST(o_orderdate AS DATE) AS order_date, CAST(l_orderkey AS VARCHAR) AS order_id,
         p_brand AS sku, p_type AS asin, p_name AS product_name, CAST(l_quantity AS INT) AS quantity,
         CAST(CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 1 THEN -1 ELSE 1 END AS DECIMAL(1,0))
           * CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS shipping_amount,
         CASE WHEN l_returnflag = 'N' THEN 'Shipment' WHEN l_returnflag = 'R' THEN 'Refund'
              WHEN l_linestatus = 'F' THEN 'FreeReplacement' ELSE 'Cancel' END AS transaction_type,
         n_name AS region, o_orderstatus AS status, l_linenumber, l_partkey, l_suppkey, l_shipdate
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""

DERIVED = """
         CASE WHEN transaction_type = 'Shipment' AND amount IS NOT NULL THEN abs(amount)
              WHEN transaction_type = 'Refund' AND amount IS NOT NULL THEN -abs(amount) ELSE 0 END AS revenue_calc,
         CASE WHEN transaction_type = 'Refund' AND amount IS NOT NULL THEN abs(shipping_amount) ELSE 0 END
           AS shipping_loss_calc,
         CASE WHEN transaction_type = 'Shipment' AND amount IS NOT NULL THEN quantity ELSE 0 END AS units_sold_calc,
         coalesce(transaction_type = 'FreeReplacement', false) AS needs_estimation"""

FACTS = f"{SALES}, facts AS (SELECT *, amount AS revenue_in_inr, {DERIVED} FROM sales)"

ROW_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, quantity, amount"
ROW_ORDER_DESC = ", ".join(f"{c} DESC" for c in ROW_ORDER.split(", "))

# The rows as an upload spells them, as in star.raw_sales.
RAW = f"""{SALES}, raw AS (
  SELECT CASE WHEN l_linenumber = 6 THEN 'not a date' ELSE CAST(order_date AS VARCHAR) END AS invoice_date,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE concat(' ord-', order_id, ' ') END AS order_id,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE lower(sku) END AS sku, concat(asin, ' ') AS asin,
         product_name AS item_description,
         CASE WHEN l_linenumber = 5 THEN '' ELSE CAST(quantity AS VARCHAR) END AS quantity,
         CASE WHEN l_linenumber = 3 THEN '' WHEN l_linenumber = 4 THEN 'N/A'
              ELSE concat('₹ ', CAST(amount AS VARCHAR)) END AS invoice_amount,
         CAST(shipping_amount AS VARCHAR) AS shipping_amount,
         CASE WHEN transaction_type = 'Shipment' AND l_linenumber = 1 THEN 'SHIP'
              WHEN transaction_type = 'Cancel' AND l_linenumber = 1 THEN 'cancellation'
              WHEN transaction_type = 'FreeReplacement' THEN 'free replacement'
              WHEN transaction_type = 'Refund' AND l_linenumber = 1 THEN 'adjustment fee'
              WHEN transaction_type = 'Refund' AND l_linenumber = 2 THEN 'nan'
              ELSE concat(' ', lower(transaction_type)) END AS transaction_type,
         CASE WHEN l_partkey % 2 = 0 THEN upper(region) ELSE concat(' ', lower(region)) END AS ship_to_city,
         l_linenumber, l_partkey, l_suppkey, l_shipdate, quantity AS seq_quantity, amount AS seq_amount
  FROM sales
), copied AS (SELECT * FROM raw UNION ALL SELECT * FROM raw WHERE l_partkey % 50 = 0)"""

RAW_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, seq_quantity, seq_amount"


def _title(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), '\\p{{L}}+|[^\\p{{L}}]+')"
    return f"array_to_string([upper(run[1]) || run[2:] FOR run IN {runs}], '')"


def _type(text: str) -> str:
    low = f"lower(trim({text}))"
    return f"""CASE WHEN {low} IS NULL OR {low} IN ('', 'nan', 'none') THEN NULL
      WHEN {low} IN ('shipment', 'ship') THEN 'Shipment'
      WHEN {low} IN ('cancel', 'cancelled', 'cancellation') THEN 'Cancel'
      WHEN {low} IN ('refund', 'refunds') THEN 'Refund'
      WHEN {low} IN ('freereplacement', 'free replacement', 'free_replacement') THEN 'FreeReplacement'
      ELSE {_title(low)} END"""


def _date(text: str) -> str:
    return f"CAST(try_strptime(trim({text}), '%Y-%m-%d') AS DATE)"


def _money(text: str) -> str:
    return f"TRY_CAST(regexp_replace({text}, '[₹$,\\s]', '', 'g') AS DECIMAL(24,4))"


def _quantity(text: str) -> str:
    return f"coalesce(CAST(trunc(TRY_CAST(trim({text}) AS DOUBLE)) AS BIGINT), 0)"


def _cells(source: str) -> str:
    """Cleaned cells of raw rows, with the columns that order them."""
    return f"""cells AS (
  SELECT {_date("invoice_date")} AS order_date, upper(trim(order_id)) AS order_id, upper(trim(sku)) AS sku,
         upper(trim(asin)) AS asin, trim(item_description) AS product_name, {_quantity("quantity")} AS quantity,
         TRY_CAST(trim(quantity) AS DOUBLE) IS NULL AS missing_quantity_flag,
         {_money("invoice_amount")} AS amount, coalesce({_money("shipping_amount")}, 0) AS shipping_amount,
         {_type("transaction_type")} AS transaction_type, trim(ship_to_city) AS region, {RAW_ORDER}
  FROM {source})"""


CELL_COLUMNS = (
    "order_date, order_id, sku, asin, product_name, quantity, amount, shipping_amount, transaction_type, region"
)
CLEANED = f"""{RAW}, {_cells("copied")}, kept AS (
  SELECT {CELL_COLUMNS}, count(*) AS copies FROM cells GROUP BY ALL
), cleaned AS (SELECT *, {DERIVED} FROM kept)"""

# Stored rows with their upsert key, and the row chosen per key.
STORED = f"""{FACTS}, stored AS (
  SELECT *, upper(trim(order_id)) AS normalized_order_id, upper(trim(sku)) AS normalized_sku,
         order_date AS normalized_order_date, strftime(order_date, '%Y-%m') AS month_tag FROM facts
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY normalized_order_id, normalized_sku, normalized_order_date
                               ORDER BY {ROW_ORDER_DESC}) AS from_last,
         row_number() OVER (PARTITION BY order_id, sku, order_date ORDER BY {ROW_ORDER}) AS from_first
  FROM stored
)"""

SHOWN = """order_id, CAST(order_date AS VARCHAR) AS order_date, sku, asin, CAST(quantity AS BIGINT) AS quantity,
  CAST(revenue_in_inr AS DOUBLE) AS revenue_in_inr, transaction_type, CAST(revenue_calc AS DOUBLE) AS revenue_calc"""

# What a free replacement costs: mean shipment of its ASIN.
REPLACED = """
per_asin AS (
  SELECT asin, count(*) FILTER (transaction_type = 'FreeReplacement') AS n,
         count(*) FILTER (transaction_type = 'Shipment') AS shipments,
         sum(CASE WHEN transaction_type = 'Shipment' THEN {revenue} END) AS revenue,
         sum(CASE WHEN transaction_type = 'Shipment' THEN shipping_amount END) AS freight,
         sum(CASE WHEN transaction_type = 'FreeReplacement' THEN shipping_amount END) AS own
  FROM {rows} WHERE asin IS NOT NULL AND asin <> '' GROUP BY asin
), replaced AS (
  SELECT coalesce(sum(CAST(n * (CAST(revenue AS DOUBLE) / shipments) AS DECIMAL(38,6)))
                  FILTER (shipments > 0), 0) AS cost,
         coalesce(sum(CAST(n * 2 * (CAST(freight AS DOUBLE) / shipments) AS DECIMAL(38,6)))
                  FILTER (shipments > 0), 0) AS matched_freight,
         coalesce(sum(own * 2) FILTER (shipments = 0), 0) AS own_freight
  FROM per_asin
)"""


def _finish(columns: str, source: str) -> str:
    """Summary columns from gross, refunds, cost, freight, units and orders."""
    return f"""
SELECT round(CAST(gross AS DOUBLE), 2) AS gross_revenue, round(CAST(refunds AS DOUBLE), 2) AS refunds,
       round(CAST(cost AS DOUBLE), 2) AS free_replacement_cost, round(CAST(freight AS DOUBLE), 2) AS shipping_cost_loss,
       round(CAST(gross - refunds - freight - cost AS DOUBLE), 2) AS net_revenue,
       CAST(units AS BIGINT) AS units_sold, CAST(orders AS BIGINT) AS orders,
       CASE WHEN orders > 0 THEN round(CAST(gross - refunds - freight - cost AS DOUBLE) / orders, 2) ELSE 0.0 END AS aov
FROM (SELECT {columns} FROM {source})"""


def _summary(freight: str) -> str:
    return f"WITH {FACTS}, {REPLACED.format(rows='facts', revenue='revenue_calc')}, totals AS (" + f"""
  SELECT coalesce(sum(revenue_calc) FILTER (revenue_calc > 0), 0) AS gross,
         abs(coalesce(sum(revenue_calc) FILTER (revenue_calc < 0), 0)) AS refunds,
         coalesce(sum(shipping_loss_calc), 0) AS loss, coalesce(sum(units_sold_calc), 0) AS units,
         count(DISTINCT order_id) AS orders FROM facts
)""" + _finish(f"*, {freight} AS freight", "totals, replaced")


NONDERIVED = f"WITH {SALES}, {REPLACED.format(rows='sales', revenue='amount')}" + """, totals AS (
  SELECT coalesce(sum(amount) FILTER (transaction_type = 'Shipment'), 0) AS gross,
         abs(coalesce(sum(amount) FILTER (transaction_type = 'Refund'), 0)) AS refunds,
         coalesce(sum(shipping_amount) FILTER (transaction_type = 'Refund'), 0) AS refund_freight,
         coalesce(sum(quantity) FILTER (transaction_type = 'Shipment'), 0) AS units,
         count(DISTINCT order_id) FILTER (transaction_type = 'Shipment') AS orders FROM sales
)"""

PRODUCTS = f"""{FACTS}, products AS (
  SELECT sku, asin, CAST(sum(revenue_calc) AS DOUBLE) AS revenue, CAST(sum(units_sold_calc) AS BIGINT) AS units,
         concat(sku, ' (', asin, ')') AS display_name
  FROM facts WHERE sku IS NOT NULL AND asin IS NOT NULL GROUP BY sku, asin
)"""

MOVERS = f"""{FACTS}, weekly AS (
  SELECT CAST(date_trunc('week', order_date) AS DATE) AS week, sku, asin, sum(revenue_in_inr) AS revenue,
         sum(quantity) AS quantity FROM facts GROUP BY 1, 2, 3
), compared AS (
  SELECT concat(c.sku, ' (', c.asin, ')') AS display_name, CAST(c.revenue AS DOUBLE) AS revenue_current,
         c.quantity AS quantity_current, p.quantity AS quantity_previous,
         CASE WHEN p.revenue <> 0
                THEN (CAST(c.revenue AS DOUBLE) - CAST(p.revenue AS DOUBLE)) / CAST(p.revenue AS DOUBLE) * 100
              WHEN c.revenue > 0 THEN CAST('inf' AS DOUBLE)
              WHEN c.revenue < 0 THEN CAST('-inf' AS DOUBLE) END AS wow_change
  FROM weekly c JOIN weekly p ON c.sku = p.sku
  AND c.asin IS NOT DISTINCT FROM p.asin
  WHERE c.week = (SELECT max(week) FROM weekly) AND p.week = (SELECT max(week) FROM weekly) - INTERVAL 7 DAY
), decliners AS (SELECT * FROM compared WHERE wow_change <= -30 AND quantity_previous >= 10),
fast_movers AS (SELECT * FROM compared WHERE wow_change >= 30 AND quantity_current >= 10)"""

WOW = f"""{FACTS}, windows AS (
  SELECT max(order_date) AS last_day FROM facts
), compared AS (
  SELECT last_day, sum(revenue_in_inr) FILTER (order_date >= last_day - INTERVAL 7 DAY) AS current_revenue,
         sum(revenue_in_inr) FILTER (order_date >= last_day - INTERVAL 14 DAY
                                     AND order_date < last_day - INTERVAL 7 DAY) AS previous_revenue,
         count(*) FILTER (order_date >= last_day - INTERVAL 14 DAY
                          AND order_date < last_day - INTERVAL 7 DAY) AS previous_rows
  FROM facts, windows GROUP BY last_day
), wow AS (
  SELECT *, CASE WHEN previous_rows = 0 THEN NULL WHEN previous_revenue > 0
    THEN (CAST(current_revenue AS DOUBLE) - CAST(previous_revenue AS DOUBLE)) / CAST(previous_revenue AS DOUBLE) * 100
    ELSE 0.0 END AS wow_revenue_change FROM compared
)"""


def _inr(value: str) -> str:
    return f"concat('₹', format('{{:,.2f}}', CAST({value} AS DOUBLE)))"


def _whole(value: str) -> str:
    return f"format('{{:,}}', CAST({value} AS BIGINT))"


def _presets() -> str:
    days = {
        "Last 7 days": ("2001-07-08", "2001-07-15"),
        "Last 30 days": ("2001-06-15", "2001-07-15"),
        "This Month": ("2001-07-01", "2001-07-15"),
        "Last Month": ("2001-06-01", "2001-06-30"),
        "default": ("2001-06-15", "2001-07-15"),
    }
    values = ", ".join(f"('{name}', '{a}', '{b}')" for name, (a, b) in days.items())
    return f"""WITH {FACTS}, presets(preset, first_day, last_day) AS (VALUES {values})
SELECT preset, first_day, last_day, count(order_date) AS rows, CAST(sum(revenue_in_inr) AS DOUBLE) AS revenue
FROM presets LEFT JOIN facts ON order_date BETWEEN CAST(first_day AS DATE) AND CAST(last_day AS DATE)
GROUP BY ALL"""


CANONICAL = f"""{CLEANED}, canonical AS (
  SELECT CAST(order_date AS VARCHAR) AS order_date, order_id,
         CASE WHEN sku IS NULL OR sku IN ('nan', 'NaN', '') THEN 'UNKNOWN_SKU' ELSE sku END AS sku,
         CASE WHEN asin IS NULL OR asin IN ('nan', 'NaN', '') THEN 'UNKNOWN_ASIN' ELSE asin END AS asin,
         CASE WHEN product_name IS NULL OR product_name IN ('nan', 'NaN', '', 'None') THEN 'UNKNOWN_PRODUCT'
              ELSE product_name END AS product_name,
         CAST(quantity AS BIGINT) AS quantity, false AS missing_quantity_flag,
         CAST(coalesce(amount, 0) AS DOUBLE) AS revenue_in_inr, CAST(shipping_amount AS DOUBLE) AS shipping_amount,
         transaction_type, CAST(NULL AS VARCHAR) AS shipment_item_id, {_title("region")} AS region,
         CAST(NULL AS VARCHAR) AS status, 'upload.csv' AS data_source, '2024-01-02 03:04:05' AS upload_date,
         strftime(order_date, '%Y-%m') AS month_tag, order_id AS normalized_order_id,
         upper(CASE WHEN sku IS NULL OR sku IN ('nan', 'NaN', '') THEN 'UNKNOWN_SKU' ELSE sku END) AS normalized_sku,
         CAST(order_date AS VARCHAR) AS normalized_order_date, CAST(revenue_calc AS DOUBLE) AS revenue_calc,
         CAST(shipping_loss_calc AS DOUBLE) AS shipping_loss_calc, CAST(units_sold_calc AS BIGINT) AS units_sold_calc,
         needs_estimation
  FROM cleaned
), valid AS (
  SELECT * FROM canonical WHERE normalized_order_id <> '' AND normalized_sku <> '' AND normalized_order_date <> ''
)"""

STRICT = f"""{RAW}, {_cells("copied")}, complete AS (
  SELECT *, coalesce(amount, 0) AS money, row_number() OVER (
    PARTITION BY order_id, sku, asin, transaction_type, coalesce(amount, 0), order_date ORDER BY {RAW_ORDER}) AS place,
    count(*) OVER (PARTITION BY order_id, sku, asin, transaction_type, coalesce(amount, 0), order_date) AS copies
  FROM cells WHERE order_id IS NOT NULL AND sku IS NOT NULL AND order_date IS NOT NULL
), firsts AS (SELECT * FROM complete WHERE place = 1)"""

TYPES = f"{RAW}, types AS (SELECT {_type('transaction_type')} AS transaction_type FROM raw)"

# Headers of star.wide_upload in order, with the text they hold.
WIDE = [
    ("Order Id", "order_id"),
    ("Shipment Id", "CAST(l_suppkey AS VARCHAR)"),
    ("Shipment Date", "concat('shipped ', strftime(l_shipdate, '%Y-%m-%d'))"),
    ("Order Date", "strftime(l_shipdate, '%Y-%m-%d')"),
    ("Invoice Date", "invoice_date"),
    ("Sku", "sku"),
    ("Asin", "asin"),
    ("Item Description", "item_description"),
    ("Quantity", "quantity"),
    ("Invoice Amount", "invoice_amount"),
    ("Shipping Amount", "shipping_amount"),
    ("Transaction Type", "transaction_type"),
    ("Ship To City", "ship_to_city"),
    ("Shipment Item Id", "CAST(l_partkey AS VARCHAR)"),
    ("Product Tax Code", "CAST(l_partkey AS VARCHAR)"),
    ("Tax Amount", "'12.5'"),
    ("Bill From City", "ship_to_city"),
]
_header_rows = ", ".join(f"({i}, '{h}')" for i, (h, _) in enumerate(WIDE))
_synonym_rows = ", ".join(
    f"({i}, '{field}', '{word}')" for i, (field, words) in enumerate(fixed.SYNONYMS.items()) for word in words
)


def _spelled(name: str, supplier: str) -> str:
    return f"""CASE {supplier} % 3 WHEN 0 THEN upper({name}) WHEN 1 THEN concat('  ', replace({name}, ' ', '   '))
      ELSE {name} END"""


MATCHED = f"""names(pos, name) AS (VALUES {_header_rows}), headers AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS upload, pos, {_spelled("name", "s_suppkey")} AS header,
         lower(name) AS norm FROM supplier, names WHERE pos <> s_suppkey % {len(WIDE)}
), synonyms(field_ord, field, word) AS (VALUES {_synonym_rows}),
matched AS (
  SELECT upload, field_ord, field, pos, header, norm, bool_or(norm = word) AS exact
  FROM headers JOIN synonyms ON contains(norm, word) OR contains(word, norm)
  GROUP BY ALL
)"""
_unpivoted = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{h}' AS name, {e} AS value, order_id, {RAW_ORDER} FROM raw" for i, (h, e) in enumerate(WIDE)
)
# Dates, quantities and amounts are told apart by their values when several headers match.
PROFILE = f"""{RAW}, {MATCHED}, typed AS (
  SELECT DISTINCT name FROM names WHERE pos IN (
    SELECT n.pos FROM names n JOIN synonyms s ON contains(lower(n.name), s.word) OR contains(s.word, lower(n.name))
    WHERE s.field IN ('order_date', 'quantity', 'revenue_amount') AND s.field IN (
      SELECT field FROM names JOIN synonyms ON contains(lower(name), word) OR contains(word, lower(name))
      GROUP BY field HAVING count(DISTINCT pos) > 1))
), cells AS ({_unpivoted}), spelled AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS upload, {_spelled("name", "l_suppkey")} AS header, *
  FROM cells WHERE name IN (SELECT name FROM typed) AND pos <> l_suppkey % {len(WIDE)} AND value IS NOT NULL
), profiled AS (
  SELECT upload, header, count(*) AS sampled, avg(CAST({_date("value")} IS NOT NULL AS INT)) AS date_ratio,
         avg(CAST({_money("value")} IS NOT NULL AS INT)) AS numeric_ratio,
         avg(CAST(TRY_CAST(trim(value) AS DOUBLE) IS NOT NULL AS INT)) AS integer_ratio
  FROM spelled GROUP BY upload, header
)"""


def _mapped() -> str:
    return f"""WITH RECURSIVE {PROFILE}, fields AS (SELECT DISTINCT field_ord, field FROM synonyms),
options AS MATERIALIZED (
  SELECT m.*, coalesce(date_ratio >= 0.7, false) AS is_date, coalesce(numeric_ratio >= 0.7, false) AS is_numeric,
         coalesce(integer_ratio >= 0.7, false) AS is_integer, contains(norm, 'invoice') AS is_invoice
  FROM matched m LEFT JOIN profiled USING (upload, header)
), picks AS (
  SELECT DISTINCT upload, -1 AS field_ord, CAST([] AS VARCHAR[]) AS taken, CAST(NULL AS VARCHAR) AS header FROM headers
  UNION ALL
  SELECT upload, field_ord, list_append(taken, coalesce(header, '')), header FROM (
    SELECT p.upload, p.field_ord + 1 AS field_ord, any_value(p.taken) AS taken,
      CASE WHEN count(o.header) = 1 THEN min(o.header)
           WHEN p.field_ord + 1 = 0 THEN arg_min(o.header, o.pos) FILTER (o.is_date)
           WHEN p.field_ord + 1 = 5 THEN arg_min(o.header, o.pos) FILTER (o.is_integer)
           WHEN p.field_ord + 1 = 6 THEN coalesce(arg_min(o.header, o.pos) FILTER (o.is_invoice AND o.is_numeric),
                                                  arg_min(o.header, o.pos) FILTER (o.is_numeric)) END AS header
    FROM picks p LEFT JOIN options o
      ON o.upload = p.upload AND o.field_ord = p.field_ord + 1 AND NOT list_contains(p.taken, o.header)
    WHERE p.field_ord < 11 GROUP BY p.upload, p.field_ord)
), mapped AS (SELECT upload, field, header FROM picks JOIN fields USING (field_ord))"""


_question_list = "[" + ", ".join("'" + q.replace("'", "''") + "'" for q in QUESTIONS) + "]"
ROUTED = f"""asked AS (
  SELECT concat_ws('-', 'turn', conv_id, turn) AS question_id, text FROM conversations WHERE role = 'user'
  UNION ALL
  SELECT concat_ws('-', 'customer', c_custkey), ({_question_list})[c_custkey % {len(QUESTIONS)} + 1] FROM customer
), lowered AS (SELECT question_id, lower(text) AS t FROM asked), classed AS (
  SELECT *, contains(t, 'total') OR contains(t, 'count') OR contains(t, 'sum') OR contains(t, 'revenue')
    OR contains(t, 'orders') OR contains(t, 'units') OR contains(t, 'top') OR contains(t, 'best') AS numeric
  FROM lowered
), intents AS (
  SELECT question_id, t, CASE WHEN numeric THEN 'numeric' ELSE 'descriptive' END AS class,
    CASE WHEN numeric AND contains(t, 'revenue') THEN 'revenue'
         WHEN numeric AND (contains(t, 'orders') OR contains(t, 'order count')) THEN 'orders'
         WHEN numeric AND (contains(t, 'units') OR contains(t, 'quantity')) THEN 'units'
         WHEN numeric AND contains(t, 'top') AND (contains(t, 'sku') OR contains(t, 'product')
              OR contains(t, 'item') OR contains(t, 'best')) THEN 'top products'
         WHEN numeric THEN 'not understood'
         WHEN contains(t, 'trend') OR contains(t, 'performance') THEN 'totals'
         WHEN contains(t, 'declining') OR contains(t, 'drop') THEN 'declines' ELSE 'summary' END AS intent
  FROM classed
), routed AS (
  SELECT question_id, class, intent, CASE WHEN intent <> 'top products' THEN 0 WHEN contains(t, 'top 3') THEN 3
    WHEN contains(t, 'top 10') THEN 10 ELSE 5 END AS k FROM intents
)"""


def _answers() -> str:
    def line(label: str, value: str) -> str:
        return f"'• **{label}:** ', {_inr(value)}"

    summary = _summary("loss")[len("WITH ") :]
    head, _, select = summary.rpartition("\nSELECT round(CAST(gross")
    money = "SELECT round(CAST(gross" + select
    quoted = {name: text.replace("'", "''") for name, text in (("bad", fixed.NOT_UNDERSTOOD), ("series", fixed.NO_TIME_SERIES))}
    return f"""WITH {head}, money AS ({money}), {ROUTED}, plain AS (
  SELECT sum(revenue_in_inr) AS total, count(DISTINCT order_id) AS orders, sum(quantity) AS units FROM facts
), best AS (
  SELECT row_number() OVER (ORDER BY sum(revenue_calc) DESC, sku, asin) AS place,
         concat(sku, ' (', asin, ')') AS name, sum(revenue_calc) AS revenue FROM facts GROUP BY sku, asin
), answers(intent, k, answer) AS (
  SELECT 'revenue', 0, concat('**Revenue Breakdown:**', chr(10), {line("Net Revenue", "net_revenue")}, chr(10),
         {line("Gross Revenue", "gross_revenue")}, chr(10), {line("Refunds", "refunds")}, chr(10),
         {line("Free Replacements", "free_replacement_cost")}) FROM money
  UNION ALL SELECT 'orders', 0, concat('**Total Orders:** ', {_whole("orders")}) FROM plain
  UNION ALL SELECT 'units', 0, concat('**Total Units Sold:** ', {_whole("units")}) FROM plain
  UNION ALL SELECT 'not understood', 0, '{quoted["bad"]}'
  UNION ALL SELECT 'totals', 0, concat('Based on the data: Total revenue is ', {_inr("total")}, ', with ', orders,
         ' orders and ', units, ' units sold.') FROM plain
  UNION ALL SELECT 'declines', 0, '{quoted["series"]}'
  UNION ALL SELECT 'summary', 0, concat('Here''s a summary: ', orders, ' orders totaling ', {_inr("total")},
         ' in revenue.') FROM plain
  UNION ALL SELECT 'top products', sizes.k, concat('**Top Products by Revenue:**', chr(10),
         string_agg(concat(place, '. ', name, ': ', {_inr("revenue")}, chr(10)), '' ORDER BY place))
    FROM best JOIN (VALUES (3), (5), (10)) sizes(k) ON place <= sizes.k GROUP BY sizes.k
)
SELECT question_id, intent, answer FROM routed LEFT JOIN answers USING (intent, k)"""


def _bundle() -> str:
    names = [
        "gross_revenue",
        "refunds",
        "free_replacement_cost",
        "shipping_cost_loss",
        "net_revenue",
        "units_sold",
        "orders",
        "aov",
    ]
    summary = _summary("loss")[len("WITH ") :]
    head, _, select = summary.rpartition("\nSELECT round(CAST(gross")
    money = "SELECT round(CAST(gross" + select
    wide = " UNION ALL ".join(
        f"SELECT 'summary' AS kpi, '{n}' AS item, CAST({n} AS DOUBLE) AS value FROM money" for n in names
    )
    products, wow = PRODUCTS[len(FACTS) :], WOW[len(FACTS) :]
    return f"""WITH {head}, money AS ({money}){products}{wow}, regions AS (
  SELECT {_title("trim(region)")} AS region, sum(revenue_in_inr) AS revenue FROM facts GROUP BY 1
)
{wide}
UNION ALL SELECT 'breakdown', transaction_type, CAST(sum(revenue_calc) AS DOUBLE) FROM facts GROUP BY 2
UNION ALL SELECT 'wow', 'wow_revenue_change', round(wow_revenue_change, 2) FROM wow
UNION ALL (SELECT 'top_products_revenue', display_name, revenue FROM products ORDER BY revenue DESC, sku, asin LIMIT 10)
UNION ALL (SELECT 'top_products_units', display_name, CAST(units AS DOUBLE) FROM products
           ORDER BY units DESC, sku, asin LIMIT 10)
UNION ALL SELECT 'status_breakdown', status, CAST(count(*) AS DOUBLE) FROM facts GROUP BY 2
UNION ALL (SELECT 'region_revenue', region, CAST(revenue AS DOUBLE) FROM regions ORDER BY revenue DESC, region LIMIT 10)
UNION ALL SELECT 'revenue_trend', CAST(order_date AS VARCHAR), CAST(sum(revenue_in_inr) AS DOUBLE) FROM facts GROUP BY 2"""


def all_oracles() -> dict[str, str]:
    lifecycle = """SELECT count(*) AS rows, count(DISTINCT month_tag) AS months"""
    return {
        "txn_breakdown": f"""WITH {FACTS}
SELECT transaction_type, count(*) AS count, CAST(sum(revenue_calc) AS DOUBLE) AS revenue,
       CAST(sum(units_sold_calc) AS BIGINT) AS units, count(DISTINCT order_id) AS orders,
       concat(transaction_type, ' transactions') AS description
FROM facts WHERE transaction_type IS NOT NULL GROUP BY transaction_type""",
        "revenue_summary": _summary("loss"),
        "revenue_summary_with_ship": _summary("loss + matched_freight"),
        "revenue_nonderived": NONDERIVED
        + _finish("*, refund_freight + matched_freight + own_freight AS freight", "totals, replaced"),
        "breakdown_nonderived": NONDERIVED
        + """, counts AS (SELECT transaction_type, count(*) AS count FROM sales GROUP BY 1)
SELECT transaction_type, count,
  CASE transaction_type WHEN 'Shipment' THEN round(CAST(gross AS DOUBLE), 2)
    WHEN 'Refund' THEN round(-CAST(refunds AS DOUBLE), 2)
    WHEN 'FreeReplacement' THEN round(-CAST(cost AS DOUBLE), 2) ELSE 0.0 END AS revenue,
  CAST(CASE transaction_type WHEN 'Shipment' THEN units ELSE 0 END AS BIGINT) AS units,
  CAST(CASE transaction_type WHEN 'Shipment' THEN orders ELSE 0 END AS BIGINT) AS orders,
  CASE transaction_type WHEN 'Refund' THEN round(CAST(refund_freight AS DOUBLE), 2)
    WHEN 'FreeReplacement' THEN round(CAST(matched_freight + own_freight AS DOUBLE), 2) ELSE 0.0 END AS shipping_loss,
  CASE transaction_type WHEN 'Shipment' THEN 'Successful sales'
    WHEN 'Cancel' THEN 'Cancelled orders (no revenue impact)' WHEN 'Refund' THEN 'Customer returns with shipping loss'
    ELSE 'Free replacements with estimated cost' END AS description
FROM counts, totals, replaced""",
        "revenue_untyped": f"WITH {SALES}"
        + _finish(
            "*",
            """(SELECT coalesce(sum(amount), 0) AS gross, 0 AS refunds, 0 AS cost, 0 AS freight,
  coalesce(sum(quantity), 0) AS units, count(DISTINCT order_id) AS orders FROM sales)""",
        ),
        "breakdown_untyped": f"""WITH {SALES}
SELECT 'Shipment' AS transaction_type, count(*) AS count, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue,
       'Legacy data (all treated as shipments)' AS description FROM sales""",
        "date_type_filter": f"""WITH {FACTS} SELECT {SHOWN} FROM facts
WHERE facts.order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND transaction_type = 'Refund'
ORDER BY facts.order_date, order_id""",
        "preset_last_month": f"""WITH {FACTS} SELECT {SHOWN} FROM facts
WHERE facts.order_date BETWEEN DATE '2001-06-01' AND DATE '2001-06-30'""",
        "preset_counts": _presets(),
        "wow_change": f"""WITH {WOW}
SELECT CAST(last_day AS VARCHAR) AS last_day, CAST(current_revenue AS DOUBLE) AS current_revenue,
       CAST(previous_revenue AS DOUBLE) AS previous_revenue, previous_rows,
       round(wow_revenue_change, 4) AS wow_revenue_change FROM wow""",
        "top_products_revenue": f"""WITH {PRODUCTS}
SELECT display_name, revenue FROM products ORDER BY revenue DESC, sku, asin LIMIT 10""",
        "top_products_units": f"""WITH {PRODUCTS}
SELECT display_name, units FROM products ORDER BY units DESC, sku, asin LIMIT 10""",
        "product_totals": f"WITH {PRODUCTS} SELECT * FROM products",
        "top_sku_only": f"""WITH {FACTS} SELECT sku, CAST(sum(revenue_calc) AS DOUBLE) AS revenue,
       CAST(sum(units_sold_calc) AS BIGINT) AS units,
       CASE WHEN trim(sku) = '' THEN 'Unknown Product' ELSE sku END AS display_name
FROM facts WHERE sku IS NOT NULL GROUP BY sku ORDER BY revenue DESC, sku LIMIT 10""",
        "best_product": f"WITH {PRODUCTS} SELECT * FROM products ORDER BY revenue DESC, sku, asin LIMIT 1",
        "topk_sql": f"WITH {PRODUCTS} SELECT sku, asin, revenue FROM products ORDER BY revenue DESC, sku, asin LIMIT 5",
        "status_counts": f"WITH {FACTS} SELECT status, count(*) AS count FROM facts WHERE status IS NOT NULL GROUP BY 1",
        "region_top10": f"""WITH {FACTS}
SELECT {_title("trim(region)")} AS region, CAST(sum(revenue_in_inr) AS DOUBLE) AS revenue
FROM facts WHERE facts.region IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
        "daily_trend": f"""WITH {FACTS} SELECT CAST(order_date AS VARCHAR) AS order_date,
       CAST(sum(revenue_in_inr) AS DOUBLE) AS revenue, count(*) AS rows FROM facts GROUP BY 1""",
        "weekly_products": f"""WITH {FACTS}
SELECT CAST(CAST(date_trunc('week', order_date) AS DATE) AS VARCHAR) AS week, sku, asin,
       CAST(sum(revenue_in_inr) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity
FROM facts GROUP BY 1, 2, 3""",
        "weekly_skus": f"""WITH {FACTS}
SELECT CAST(CAST(date_trunc('week', order_date) AS DATE) AS VARCHAR) AS week, sku,
       CAST(sum(revenue_in_inr) AS DOUBLE) AS revenue, CAST(sum(quantity) AS BIGINT) AS quantity
FROM facts GROUP BY 1, 2""",
        "fast_movers": f"""WITH {MOVERS}
SELECT display_name, revenue_current, round(wow_change, 4) AS wow_change FROM fast_movers""",
        "decliners": f"""WITH {MOVERS}
SELECT display_name, revenue_current, round(wow_change, 4) AS wow_change FROM decliners""",
        "mover_displays": f"""WITH {MOVERS}
SELECT display_name AS product, {_inr("revenue_current")} AS revenue, format('{{:.1f}}%', wow_change) AS wow_change
FROM decliners
UNION ALL
SELECT display_name, {_inr("revenue_current")}, format('+{{:.1f}}%', wow_change) FROM fast_movers""",
        "overall_totals": f"""WITH {FACTS} SELECT CAST(sum(revenue_in_inr) AS DOUBLE) AS total_revenue,
       count(DISTINCT order_id) AS total_orders, CAST(sum(quantity) AS BIGINT) AS total_units FROM facts""",
        "formatted_kpis": f"""WITH {PRODUCTS}
SELECT display_name AS product, {_inr("revenue")} AS revenue, {_whole("units")} AS units,
       format('{{:+.1f}}%', revenue / nullif(units, 0)) AS signed_percent FROM products""",
        "breakdown_display": f"""WITH {FACTS}
SELECT transaction_type, count(*) AS count, {_inr("sum(revenue_calc)")} AS revenue_impact,
       CAST(sum(units_sold_calc) AS BIGINT) AS units, count(DISTINCT order_id) AS orders,
       concat(transaction_type, ' transactions') AS description FROM facts GROUP BY transaction_type""",
        "kpi_bundle": _bundle(),
        "clean_money": f"""WITH {RAW}
SELECT trim(order_id) AS order_id, invoice_amount AS amount_text, CAST({_money("invoice_amount")} AS DOUBLE) AS amount,
       CAST(coalesce({_money("invoice_amount")}, 0) AS DOUBLE) AS amount_or_zero,
       CAST(coalesce({_money("shipping_amount")}, 0) AS DOUBLE) AS shipping FROM raw""",
        "clean_dates": f"""WITH {RAW}, parsed AS (SELECT invoice_date, {_date("invoice_date")} AS day FROM raw)
SELECT invoice_date AS date_text, CAST(day AS VARCHAR) AS order_date, strftime(day, '%Y-%m') AS month_tag,
       CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS week FROM parsed""",
        "clean_quantity": f"""WITH {RAW}
SELECT quantity AS quantity_text, CAST({_quantity("quantity")} AS BIGINT) AS quantity,
       TRY_CAST(trim(quantity) AS DOUBLE) IS NULL AS missing_quantity FROM raw""",
        "clean_labels": f"""WITH {RAW}
SELECT {_type("transaction_type")} AS transaction_type, {_title("trim(ship_to_city)")} AS region,
       nullif(upper(trim(order_id)), '') AS order_key,
       CASE WHEN nullif(trim(sku), '') IS NOT NULL AND nullif(trim(asin), '') IS NOT NULL
              THEN concat(trim(sku), ' (', trim(asin), ')')
            WHEN nullif(trim(sku), '') IS NOT NULL THEN trim(sku)
            WHEN nullif(trim(asin), '') IS NOT NULL THEN concat('Unknown (', trim(asin), ')')
            ELSE 'Unknown Product' END AS product,
       CASE WHEN nullif(trim(sku), '') IS NULL THEN 'Unknown Product' ELSE sku END AS sku_label FROM raw""",
        "exact_dedup": f"""WITH {CLEANED}
SELECT CAST(order_date AS VARCHAR) AS order_date, order_id, sku, asin, product_name,
       CAST(quantity AS BIGINT) AS quantity, CAST(amount AS DOUBLE) AS revenue_amount,
       CAST(shipping_amount AS DOUBLE) AS shipping_amount, transaction_type, region, copies,
       CAST(revenue_calc AS DOUBLE) AS revenue_calc, CAST(shipping_loss_calc AS DOUBLE) AS shipping_loss_calc,
       CAST(units_sold_calc AS BIGINT) AS units_sold_calc, needs_estimation FROM cleaned""",
        "first_by_key_subset": f"""WITH {STRICT}
SELECT CAST(order_date AS VARCHAR) AS order_date, order_id, sku, trim(asin) AS asin, product_name,
       CAST(quantity AS BIGINT) AS quantity, CAST(money AS DOUBLE) AS revenue_amount,
       CAST(shipping_amount AS DOUBLE) AS shipping_amount, transaction_type, region, missing_quantity_flag
FROM firsts""",
        "cleaning_report": f"""WITH {CLEANED}
SELECT CAST(sum(copies) AS BIGINT) AS total_rows_read, count(*) AS rows_kept,
       CAST(sum(copies - 1) AS BIGINT) AS rows_dropped, CAST(sum(copies - 1) AS BIGINT) AS duplicates_found,
       count(*) FILTER (amount < 0) AS negative_amounts, count(*) FILTER (order_id IS NULL) AS missing_order_id,
       count(*) FILTER (sku IS NULL) AS missing_sku, count(*) FILTER (order_date IS NULL) AS missing_order_date,
       count(*) FILTER (transaction_type IS NULL) AS null_types FROM cleaned""",
        "strict_report": f"""WITH {STRICT}, before AS (
  SELECT count(*) AS total_rows_read,
         count(*) FILTER (order_id IS NULL OR sku IS NULL OR order_date IS NULL) AS rows_without_keys,
         count(*) FILTER (order_id IS NULL) AS missing_order_id, count(*) FILTER (sku IS NULL) AS missing_sku,
         count(*) FILTER (order_date IS NULL) AS missing_order_date,
         count(*) FILTER (missing_quantity_flag) AS missing_quantities FROM cells
), after AS (
  SELECT count(*) AS rows_kept, CAST(sum(copies - 1) AS BIGINT) AS duplicates_found,
         count(*) FILTER (money < 0) AS negative_amounts,
         count(*) FILTER (money < 0 AND transaction_type = 'Refund') AS negative_refunds FROM firsts
) SELECT * FROM before, after""",
        "problem_rows": f"""WITH {STRICT}, first AS (
  SELECT * FROM firsts
  ORDER BY l_partkey, l_suppkey, l_shipdate, l_linenumber, seq_quantity, seq_amount, order_id LIMIT 100
)
SELECT concat_ws(',', CASE WHEN money = 0 THEN 'Zero revenue' END, CASE WHEN quantity = 0 THEN 'Zero quantity' END)
         AS issues, order_id, sku, CAST(money AS DOUBLE) AS revenue_amount
FROM first WHERE money = 0 OR quantity = 0""",
        "canonical_projection": f"WITH {CANONICAL} SELECT * FROM canonical",
        "valid_key_counts": f"""WITH {CANONICAL}
SELECT (SELECT count(*) FROM valid) AS valid_rows,
       (SELECT count(*) FROM canonical) - (SELECT count(*) FROM valid) AS invalid_rows""",
        "upsert_last_wins": f"""WITH {STORED}
SELECT {SHOWN}, month_tag, {_title("region")} AS region, status FROM ranked WHERE from_last = 1""",
        "upsert_into_stored": f"WITH {STORED} SELECT {SHOWN} FROM ranked WHERE from_last = 1",
        "replace_then_append": f"WITH {STORED} SELECT {SHOWN}, month_tag FROM ranked WHERE from_last = 1",
        "append_if_absent": f"WITH {STORED} SELECT {SHOWN} FROM ranked WHERE from_first = 1",
        "append_counts": f"""WITH {SALES}, batch AS (
  SELECT order_id, sku, order_date, count(*) AS n FROM sales WHERE l_linenumber BETWEEN 3 AND 6 GROUP BY ALL
), target AS (SELECT DISTINCT order_id, sku, order_date FROM sales WHERE l_linenumber <= 4), fresh AS (
  SELECT * FROM batch ANTI JOIN target USING (order_id, sku, order_date)
)
SELECT (SELECT count(*) FROM fresh) AS new_rows,
       CAST((SELECT sum(n) FROM batch) AS BIGINT) - (SELECT count(*) FROM fresh) AS duplicate_rows,
       (SELECT count(*) FROM sales WHERE l_linenumber = 7) AS null_key_rows""",
        "duplicate_precheck": f"""WITH {SALES}, held AS MATERIALIZED (
  SELECT DISTINCT order_id, sku, order_date FROM sales WHERE l_linenumber <= 4
), batch AS MATERIALIZED (SELECT order_id, sku, order_date, quantity FROM sales WHERE l_linenumber >= 3)
SELECT upper(trim(order_id)) AS normalized_order_id, upper(trim(sku)) AS normalized_sku,
       CAST(order_date AS VARCHAR) AS normalized_order_date, CAST(quantity AS BIGINT) AS quantity
FROM batch JOIN held USING (order_id, sku, order_date)""",
        "stored_range": f"""WITH {STORED} SELECT {SHOWN} FROM ranked
WHERE from_last = 1 AND ranked.order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'
  AND transaction_type = 'Shipment'""",
        "data_health": f"""WITH {STORED} SELECT count(*) AS total_rows,
       count(DISTINCT (normalized_order_id, normalized_sku, normalized_order_date)) AS unique_keys,
       CAST(min(order_date) AS VARCHAR) AS date_range_start, CAST(max(order_date) AS VARCHAR) AS date_range_end
FROM stored""",
        "table_summary": f"""WITH {STORED} SELECT count(*) AS total_rows,
       CAST(min(order_date) AS VARCHAR) AS date_range_start, CAST(max(order_date) AS VARCHAR) AS date_range_end,
       CAST(1 AS BIGINT) AS data_sources FROM stored""",
        "adhoc_sql": f"""WITH {FACTS} SELECT sku, count(DISTINCT order_id) AS orders, CAST(sum(quantity) AS BIGINT) AS units
FROM facts WHERE sku IS NOT NULL AND order_date IS NOT NULL GROUP BY sku""",
        "csv_roundtrip": f"""WITH {RAW} SELECT count(*) AS rows, count(DISTINCT order_id) AS orders,
       CAST(sum({_money("invoice_amount")}) AS DOUBLE) AS amount,
       count(*) FILTER (invoice_amount IN ('', 'N/A')) AS missing_amounts,
       count(*) FILTER ({_date("invoice_date")} IS NULL) AS undated, count(*) AS positions FROM raw""",
        "snapshots": f"""WITH {CLEANED}
SELECT 'raw' AS snapshot, count(*) AS rows, CAST(sum({_money("invoice_amount")}) AS DOUBLE) AS amount FROM copied
UNION ALL SELECT 'cleaned', count(*), CAST(sum(amount) AS DOUBLE) FROM cleaned""",
        "report_export": f"""WITH {MOVERS}
SELECT display_name AS product, {_inr("revenue_current")} AS revenue, format('+{{:.1f}}%', wow_change) AS wow_change
FROM fast_movers""",
        "full_ingest": f"""WITH {CANONICAL}, keys AS (
  SELECT DISTINCT normalized_order_id, normalized_sku, normalized_order_date FROM valid
)
SELECT count(*) AS rows, count(*) AS keys, count(DISTINCT normalized_order_id) AS orders,
       min(normalized_order_date) AS first_day, max(normalized_order_date) AS last_day FROM keys""",
        "registry_roundtrip": f"""WITH {CANONICAL}, uploads(filename, upload_date) AS (
  VALUES ('second.csv', '2024-01-02 00:00:00'), ('first.csv', '2024-01-01 00:00:00')
)
SELECT filename, uploads.upload_date, count(*) AS row_count, min(order_date) AS date_range_start,
       max(order_date) AS date_range_end, 'Invoice Amount' AS revenue_header, 'active' AS status,
       true AS same_hash
FROM valid, uploads GROUP BY filename, uploads.upload_date""",
        "table_lifecycle": f"""WITH {STORED}, first AS (
  SELECT DISTINCT normalized_order_id, normalized_sku, normalized_order_date, month_tag FROM stored
  WHERE l_linenumber <= 4
), second AS (
  SELECT DISTINCT normalized_order_id, normalized_sku, normalized_order_date, month_tag FROM stored
  WHERE l_linenumber >= 3
), both_ AS (SELECT * FROM first UNION SELECT * FROM second)
SELECT '1 new' AS step, CAST(0 AS BIGINT) AS rows, CAST(0 AS BIGINT) AS months
UNION ALL SELECT '2 replaced', * FROM ({lifecycle} FROM first)
UNION ALL SELECT '3 upserted', * FROM ({lifecycle} FROM both_)
UNION ALL SELECT '4 upserted again', * FROM ({lifecycle} FROM both_)
UNION ALL SELECT '5 cleared', CAST(0 AS BIGINT), CAST(0 AS BIGINT)
UNION ALL SELECT '6 refilled', * FROM ({lifecycle} FROM second)""",
        "type_value_counts": f"WITH {TYPES} SELECT transaction_type, count(*) AS count FROM types GROUP BY 1",
        "type_values": f"WITH {TYPES} SELECT DISTINCT transaction_type FROM types",
        "null_types": f"WITH {TYPES} SELECT count(*) FILTER (transaction_type IS NULL) AS null_types FROM types",
        "amount_reconciliation": f"""WITH {FACTS}
SELECT transaction_type, CAST(sum(revenue_in_inr) AS DOUBLE) AS original_amount,
       CAST(sum(revenue_calc) AS DOUBLE) AS derived_revenue FROM facts GROUP BY 1""",
        "sign_distribution": f"""WITH {FACTS} SELECT count(*) FILTER (revenue_calc > 0) AS positive_rows,
       count(*) FILTER (revenue_calc < 0) AS negative_rows, count(*) FILTER (revenue_calc = 0) AS zero_rows,
       CAST(sum(revenue_calc) AS DOUBLE) AS total_revenue, sum(abs(revenue_calc)) = 0 AS all_zero FROM facts""",
        "column_profile": f"""WITH {FACTS}
SELECT 'revenue_in_inr' AS "column", 'decimal(24,4)' AS type, count(revenue_in_inr) AS non_null,
       CAST(sum(revenue_in_inr) AS DOUBLE) AS total FROM facts
UNION ALL SELECT 'shipping_amount', 'decimal(24,4)', count(shipping_amount), CAST(sum(shipping_amount) AS DOUBLE) FROM facts
UNION ALL SELECT 'quantity', 'int', count(quantity), CAST(sum(quantity) AS DOUBLE) FROM facts
UNION ALL SELECT 'order_id', 'string', count(order_id), NULL FROM facts
UNION ALL SELECT 'revenue_calc', 'decimal(24,4)', count(revenue_calc), CAST(sum(revenue_calc) AS DOUBLE) FROM facts
UNION ALL SELECT 'transaction_type', 'string', count(transaction_type), NULL FROM facts""",
        "totals_by_type": f"""WITH {FACTS}
SELECT transaction_type, count(*) AS rows,
       count(*) FILTER (order_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31') AS rows_in_range,
       CAST(sum(revenue_calc) AS DOUBLE) AS revenue_calc, CAST(sum(shipping_loss_calc) AS DOUBLE) AS shipping_loss_calc,
       CAST(sum(units_sold_calc) AS BIGINT) AS units_sold_calc, CAST(min(order_date) AS VARCHAR) AS min_date,
       CAST(max(order_date) AS VARCHAR) AS max_date FROM facts GROUP BY 1""",
        "derived_totals": f"""WITH {FACTS}
SELECT CAST(sum(revenue_calc) AS DOUBLE) AS revenue_calc, CAST(sum(shipping_loss_calc) AS DOUBLE) AS shipping_loss_calc,
       CAST(sum(units_sold_calc) AS BIGINT) AS units_sold_calc, CAST(min(order_date) AS VARCHAR) AS min_date,
       CAST(max(order_date) AS VARCHAR) AS max_date FROM facts""",
        "sample_per_type": f"""WITH {FACTS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY transaction_type ORDER BY {ROW_ORDER}, order_id) AS place FROM facts
) SELECT {SHOWN} FROM placed WHERE place = 1""",
        "sample_rows": f"""WITH {FACTS} SELECT {SHOWN} FROM (
  SELECT * FROM facts ORDER BY {ROW_ORDER}, order_id LIMIT 5
) facts""",
        "schema_check": f"""WITH {SALES} SELECT store, missing, (SELECT count(*) FROM (
    SELECT DISTINCT order_id, sku, order_date FROM sales)) AS rows
FROM (VALUES ('complete', ''), ('older', 'revenue_calc,needs_estimation')) checks(store, missing)""",
        "date_forms": f"""SELECT form, o_orderkey AS "order", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day
FROM orders, (SELECT concat('form ', i) AS form FROM range({len(fixed.DATE_FORMATS)}) forms(i)) forms""",
        "mixed_headers": f"""WITH {RAW} SELECT coalesce(lower(trim(sku)), 'none') AS sku, count(*) AS rows,
       count(DISTINCT trim(order_id)) AS orders, CAST(sum({_quantity("quantity")}) AS BIGINT) AS units,
       CAST(sum({_money("invoice_amount")}) FILTER (l_linenumber % 2 = 1) AS DOUBLE) AS amount
FROM raw GROUP BY 1""",
        "folder_mapping": f"""WITH {RAW}, filled AS (
  SELECT l_linenumber % 3 AS layout, count(*) AS rows, count(invoice_date) AS days, count(order_id) AS orders, count(sku) AS skus,
         count(nullif(quantity, '')) AS quantities, count(CASE WHEN invoice_amount NOT IN ('', 'N/A') THEN 1 END) AS amounts,
         count(asin) AS asins, count(ship_to_city) AS cities
  FROM raw GROUP BY 1
) SELECT field, header, rows, filled FROM (
  SELECT 'order_date' AS field, 'Invoice Date' AS header, rows, days AS filled FROM filled WHERE layout = 0
  UNION ALL SELECT 'order_id', 'Order Id', rows, orders FROM filled WHERE layout < 2
  UNION ALL SELECT 'sku', 'Sku', rows, skus FROM filled WHERE layout < 2
  UNION ALL SELECT 'quantity', 'Quantity', rows, quantities FROM filled WHERE layout = 1
  UNION ALL SELECT 'revenue_amount', 'Invoice Amount', rows, amounts FROM filled WHERE layout = 1
  UNION ALL SELECT 'asin', 'Asin', rows, asins FROM filled WHERE layout = 2
  UNION ALL SELECT 'region', 'Ship To City', rows, cities FROM filled WHERE layout = 2)""",
        "mixed_ingest": f"""WITH {RAW} SELECT substr(invoice_date, 1, 7) AS month_tag,
       count(DISTINCT concat(order_id, '|', coalesce(sku, 'none'))) AS rows, count(DISTINCT order_id) AS orders
FROM raw WHERE l_linenumber < 6 GROUP BY 1""",
        "quoted_lines": f"""WITH {RAW} SELECT
       CASE WHEN l_partkey % 3 = 0 THEN replace(item_description, ' ', '|') || ', "extra"' ELSE item_description END AS product,
       count(*) AS rows, count(CASE WHEN l_linenumber = 1 THEN 1 END) AS two_lines, count(DISTINCT order_id) AS orders,
       CAST(sum({_quantity("quantity")}) AS BIGINT) AS units
FROM raw GROUP BY 1""",
        "bad_records": f"""WITH {RAW} SELECT CASE l_linenumber WHEN 3 THEN 'long' WHEN 5 THEN 'short' ELSE 'kept' END AS kind,
       count(*) AS rows, count(DISTINCT trim(order_id)) AS orders,
       CAST(coalesce(sum({_quantity("quantity")}) FILTER (l_linenumber NOT IN (3, 5)), 0) AS BIGINT) AS units
FROM raw GROUP BY 1""",
        "drop_empty_rows": f"""WITH {RAW}, kept AS (
  SELECT CASE WHEN l_linenumber <> 7 THEN asin END AS asin_, CASE WHEN l_linenumber < 6 THEN item_description END AS named_
  FROM raw
) SELECT asin_ AS "Asin", count(*) AS rows, count(named_) AS named FROM kept
WHERE asin_ IS NOT NULL OR named_ IS NOT NULL GROUP BY asin_""",
        "replacement_fallback": NONDERIVED.replace("sales AS (", "all_sales AS (", 1).replace(
            "per_asin AS (", """sales AS (SELECT * FROM all_sales WHERE NOT (
  transaction_type = 'Shipment' AND (asin LIKE '%BRASS' OR asin LIKE 'A%' OR asin LIKE 'L%'))), per_asin AS (""", 1
        )
        + _finish("*, refund_freight + matched_freight + own_freight AS freight", "totals, replaced"),
        "profile_sample": f"""WITH {PROFILE}
SELECT upload, header, sampled, round(date_ratio, 4) AS date_ratio,
       CASE WHEN date_ratio > 0 THEN 'yyyy-M-d' END AS date_format, round(numeric_ratio, 4) AS numeric_ratio,
       round(integer_ratio, 4) AS integer_ratio, date_ratio >= 0.7 AS is_date, numeric_ratio >= 0.7 AS is_numeric,
       integer_ratio >= 0.7 AS is_integer FROM profiled""",
        "header_mapping": f"{_mapped()} SELECT * FROM mapped",
        "ambiguous_fields": f"""{_mapped()}
SELECT DISTINCT upload, field FROM mapped JOIN matched USING (upload, field)
WHERE mapped.header IS NULL AND exact""",
        "header_candidates": f"WITH {MATCHED} SELECT upload, field, CAST(pos AS BIGINT) AS pos, header FROM matched",
        "header_signature": f"""WITH {MATCHED}
SELECT upload, sha1(string_agg(header, '|' ORDER BY header)) AS signature, count(*) AS headers
FROM headers GROUP BY upload""",
        "mapping_registry": f"""WITH {MATCHED}, signed AS (
  SELECT upload, sha1(string_agg(header, '|' ORDER BY header)) AS signature FROM headers GROUP BY upload
), chosen(field, header) AS (VALUES ('order_date', 'Invoice Date'), ('order_id', 'Order Id'), ('sku', NULL),
  ('asin', 'Asin'), ('product_name', 'Item Description'), ('quantity', 'Quantity'),
  ('revenue_amount', 'Invoice Amount'), ('shipping_amount', 'Shipping Amount'),
  ('transaction_type', 'Transaction Type'), ('shipment_item_id', NULL), ('region', 'Ship To City'),
  ('status', 'Shipment Id'))
SELECT upload, signature, field, header FROM signed, chosen""",
        "question_intents": f"""WITH {ROUTED} SELECT question_id, class, intent, CAST(k AS BIGINT) AS k FROM routed""",
        "question_answers": _answers(),
    }
