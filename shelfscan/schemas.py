"""Column layouts of the tables that go in and come out."""

FETCHES = (
    "site STRING, url STRING, attempt INT, fetched_at TIMESTAMP, status INT, "
    "body STRING, error STRING, via STRING"
)

VARIANT_ITEM = (
    "STRUCT<sku: STRING, options: MAP<STRING, STRING>, price: DOUBLE, "
    "listPrice: DOUBLE, availability: STRING>"
)

PRODUCT_FIELDS = [
    ("url", "STRING"),
    ("id", "STRING"),
    ("name", "STRING"),
    ("brand", "STRING"),
    ("sku", "STRING"),
    ("price", "DOUBLE"),
    ("listPrice", "DOUBLE"),
    ("currency", "STRING"),
    ("availability", "STRING"),
    ("image", "STRING"),
    ("description", "STRING"),
    ("specs", "MAP<STRING, STRING>"),
    ("variants", f"ARRAY<{VARIANT_ITEM}>"),
]
PRODUCT_COLUMNS = [name for name, _ in PRODUCT_FIELDS]

PRODUCT_STRUCT = "STRUCT<" + ", ".join(f"{n}: {t}" for n, t in PRODUCT_FIELDS) + ">"

CATALOGUE = (
    f"site STRING, readAt TIMESTAMP, complete BOOLEAN, products ARRAY<{PRODUCT_STRUCT}>, "
    "incompleteReason STRING, discoveryStatus STRING"
)
