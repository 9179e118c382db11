"""Vocabularies, texts and thresholds the results depend on."""

# --- Fixed values: field synonyms, in mapping order -------------------------
SYNONYMS = {
    "order_date": ["order date", "invoice date", "shipment date", "date"],
    "order_id": ["order id", "order number", "invoice id", "order no"],
    "sku": ["sku", "product id", "item id"],
    "asin": ["asin", "amazon asin"],
    "product_name": ["product name", "item description", "title", "product"],
    "quantity": ["quantity", "qty", "units"],
    "revenue_amount": ["invoice amount", "order amount", "total amount", "amount", "revenue"],
    "shipping_amount": ["shipping amount", "shipping cost", "shipping", "freight"],
    "transaction_type": ["transaction type", "type", "transaction", "order type"],
    "shipment_item_id": ["shipment item id", "shipment id", "item id", "shipment item"],
    "region": ["region", "city", "market"],
    "status": ["status", "order status"],
}

# --- Fixed values: transaction types and their spellings --------------------
SHIPMENT = "Shipment"
CANCEL = "Cancel"
REFUND = "Refund"
FREE_REPLACEMENT = "FreeReplacement"
TYPE_SPELLINGS = {
    SHIPMENT: ["shipment", "ship"],
    CANCEL: ["cancel", "cancelled", "cancellation"],
    REFUND: ["refund", "refunds"],
    FREE_REPLACEMENT: ["freereplacement", "free replacement", "free_replacement"],
}
BLANK_TYPES = ["", "nan", "none"]

# Descriptions of the breakdown rows when no derived columns exist.
TYPE_DESCRIPTIONS = {
    SHIPMENT: "Successful sales",
    CANCEL: "Cancelled orders (no revenue impact)",
    REFUND: "Customer returns with shipping loss",
    FREE_REPLACEMENT: "Free replacements with estimated cost",
}
UNTYPED_DESCRIPTION = "Legacy data (all treated as shipments)"

# --- Fixed values: placeholders ---------------------------------------------
UNKNOWN_SKU = "UNKNOWN_SKU"
UNKNOWN_ASIN = "UNKNOWN_ASIN"
UNKNOWN_PRODUCT = "UNKNOWN_PRODUCT"
MISSING_TEXTS = ["nan", "NaN", ""]
UNKNOWN_LABEL = "Unknown Product"

# --- Fixed values: cell texts a CSV upload uses for "no value" ---------------
NO_VALUE_TEXTS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: profiling and mover thresholds ---------------------------
PROFILE_RATIO = 0.7
MOVER_CHANGE = 30.0
MOVER_UNITS = 10
TOP_PRODUCTS = 10
TOP_REGIONS = 10

# Date formats tried on a column, in order of preference, and the shape of their texts.
DATE_SHAPES = {
    "yyyy-M-d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "M/d/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d/M/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [A-Za-z]{3} \d{4}$",
    "yyyy-M-d H:m:s": r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$",
    "d-M-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$",
    "yyyy/M/d": r"^\d{4}/\d{1,2}/\d{1,2}$",
    "yyyy-M-d'T'H:m:s": r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$",
    "d-MMM-yyyy": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "MMM d, yyyy": r"^[A-Za-z]{3} \d{1,2}, \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [A-Za-z]{3,} \d{4}$",
    "MMMM d, yyyy": r"^[A-Za-z]{3,} \d{1,2}, \d{4}$",
}
DATE_FORMATS = list(DATE_SHAPES)
# Least share of a date column's values that must have the chosen format.
MIN_DATE_SHARE = 0.5

# --- Fixed values: question routing and answers -----------------------------
NUMERIC_WORDS = ["total", "count", "sum", "revenue", "orders", "units", "top", "best"]
PRODUCT_WORDS = ["sku", "product", "item", "best"]
NOT_UNDERSTOOD = "I couldn't understand your question. Try asking about revenue, orders, units, or top products."
NO_TIME_SERIES = "To identify declining trends, I'd need time-series data. Currently showing overall totals."
NO_DATA = "No data available for analysis."
REVENUE_ANSWER = "**Revenue Breakdown:**\n• **Net Revenue:** %s\n• **Gross Revenue:** %s\n• **Refunds:** %s\n• **Free Replacements:** %s"
ORDERS_ANSWER = "**Total Orders:** "
UNITS_ANSWER = "**Total Units Sold:** "
TOTALS_ANSWER = "Based on the data: Total revenue is %s, with %s orders and %s units sold."
SUMMARY_ANSWER = "Here's a summary: %s orders totaling %s in revenue."
PRODUCTS_ANSWER = "**Top Products by Revenue:**\n"
REVENUE_ROUTE = ["revenue"]
ORDERS_ROUTE = ["orders", "order count"]
UNITS_ROUTE = ["units", "quantity"]
TOTALS_ROUTE = ["trend", "performance"]
DECLINES_ROUTE = ["declining", "drop"]
