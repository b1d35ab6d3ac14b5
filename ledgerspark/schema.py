"""Column names, fixed codes and table schemas of the invoice-line contract."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw header, in the order a source must present it.
RAW_COLUMNS = (
    "Invoice",
    "StockCode",
    "Description",
    "Quantity",
    "InvoiceDate",
    "Price",
    "Customer ID",
    "Country",
)
# Column names ignore case in Spark, so a raw field kept beside its normalised
# namesake is renamed.
RAW_KEPT_AS = {
    "Invoice": "raw_invoice",
    "StockCode": "raw_stock_code",
    "Description": "raw_description",
    "Quantity": "raw_quantity",
    "InvoiceDate": "raw_invoice_date",
    "Price": "raw_price",
    "Customer ID": "raw_customer_id",
    "Country": "raw_country",
}
LINEAGE_COLUMNS = ("source_sheet", "source_row_number", "source_row_id")
FIRST_ROW_NUMBER = 2

# Classifications, quality flags and reject reasons, in encoding order.
ACCEPT = "ACCEPT"
ACCEPT_FLAGGED = "ACCEPT WITH QUALITY FLAG"
REJECT = "REJECT"
ACCEPTED_CLASSES = (ACCEPT, ACCEPT_FLAGGED)
QUALITY_FLAGS = (
    "MISSING_CUSTOMER",
    "INVALID_CUSTOMER_ID",
    "MISSING_DESCRIPTION",
    "ZERO_PRICE",
    "QUANTITY_SIGN_MISMATCH",
    "NONSTANDARD_INVOICE",
    "MISSING_COUNTRY",
)
REJECT_REASONS = (
    "MISSING_INVOICE",
    "MISSING_STOCK_CODE",
    "INVALID_INVOICE_DATE",
    "MISSING_QUANTITY",
    "INVALID_QUANTITY",
    "MISSING_PRICE",
    "INVALID_PRICE",
    "NEGATIVE_PRICE_ADJUSTMENT",
)
UNKNOWN_DESCRIPTION = "UNKNOWN DESCRIPTION"

# Widest text, in UTF-16 units, that each loaded column may hold.
TEXT_LIMITS = {
    "source_sheet": 64,
    "invoice_no": 32,
    "stock_code": 64,
    "description": 512,
    "customer_id": 32,
    "country": 128,
    "classification": 32,
    "quality_flags": 256,
}
NULLABLE_TEXT = ("description", "customer_id", "country")

INT32_MIN = -2147483648
INT32_MAX = 2147483647
PRICE_TYPE = T.DecimalType(19, 4)
AMOUNT_TYPE = T.DecimalType(30, 4)

NORMALIZED_COLUMNS = (
    "invoice_no",
    "stock_code",
    "description",
    "quantity",
    "invoice_datetime",
    "unit_price",
    "customer_id",
    "country",
)
DERIVED_COLUMNS = ("line_amount", "is_cancelled", "batch_month", "loaded_at")

_TYPES = {
    "source_sheet": (T.StringType(), False),
    "source_row_number": (T.LongType(), False),
    "source_row_id": (T.StringType(), False),
    "invoice_no": (T.StringType(), False),
    "stock_code": (T.StringType(), False),
    "description": (T.StringType(), True),
    "quantity": (T.IntegerType(), False),
    "invoice_datetime": (T.TimestampNTZType(), False),
    "unit_price": (PRICE_TYPE, False),
    "customer_id": (T.StringType(), True),
    "country": (T.StringType(), True),
    "line_amount": (AMOUNT_TYPE, False),
    "is_cancelled": (T.BooleanType(), False),
    "batch_month": (T.DateType(), False),
    "loaded_at": (T.TimestampType(), False),
    "classification": (T.StringType(), False),
    "quality_flags": (T.StringType(), False),
    **{flag: (T.BooleanType(), False) for flag in QUALITY_FLAGS},
}

ACCEPTED_COLUMNS = (
    *LINEAGE_COLUMNS,
    *NORMALIZED_COLUMNS,
    *DERIVED_COLUMNS,
    "classification",
    "quality_flags",
    *QUALITY_FLAGS,
)
PARTITION_COLUMNS = ("year", "month")


def _struct(columns) -> T.StructType:
    return T.StructType([T.StructField(c, *_TYPES[c]) for c in columns])


ACCEPTED_SCHEMA = _struct(ACCEPTED_COLUMNS)
_PARTITION_FIELDS = [T.StructField(c, T.StringType(), True) for c in PARTITION_COLUMNS]
ACCEPTED_TABLE_SCHEMA = T.StructType([*ACCEPTED_SCHEMA.fields, *_PARTITION_FIELDS])

# Accepted-line columns a fact row repeats unchanged.
FACT_COPIED_COLUMNS = tuple(
    c
    for c in ACCEPTED_COLUMNS
    if c not in ("stock_code", "description", "customer_id", "country")
)
FACT_KEY_COLUMNS = ("date_key", "customer_key", "product_key", "country_key")
FACT_COLUMNS = ("sales_key", *FACT_KEY_COLUMNS, *FACT_COPIED_COLUMNS)
# Schemas of the warehouse's own small tables, as DDL text, which needs no session.
DESCRIPTION_SCHEMA = (
    "stock_code string, description string, core_count long, core_latest timestamp_ntz, "
    "all_count long, all_latest timestamp_ntz"
)
DIM_SCHEMAS = {
    "dim_date": "date_key int, full_date date, day int, month int, month_name string, quarter int, "
    "year int, weekday_name string, is_weekend boolean",
    "dim_customer": "customer_key int, customer_id string",
    "dim_product": "product_key int, stock_code string, description string",
    "dim_country": "country_key int, country string",
}
FACT_TABLE_SCHEMA = T.StructType(
    [
        T.StructField("sales_key", T.LongType(), False),
        *[T.StructField(c, T.IntegerType(), False) for c in FACT_KEY_COLUMNS],
        *_struct(FACT_COPIED_COLUMNS).fields,
        *_PARTITION_FIELDS,
    ]
)

RAW_TEXT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in RAW_COLUMNS])

RUN_LOG_SCHEMA = T.StructType(
    [
        T.StructField("period", T.DateType(), False),
        T.StructField("input_rows", T.LongType(), False),
        T.StructField("inserted_rows", T.LongType(), False),
        T.StructField("passed", T.BooleanType(), False),
        T.StructField("finished_at", T.TimestampType(), False),
    ]
)


def signature(schema: T.StructType) -> list[tuple[str, str]]:
    """Ordered (name, type) pairs; nullability is a data check, not a file property."""
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def assert_signature(schema: T.StructType, expected: T.StructType, what: str) -> None:
    if signature(schema) != signature(expected):
        raise ValueError(
            f"{what}: expected columns {signature(expected)}, found {signature(schema)}"
        )


def assert_raw_header(columns, what: str = "source") -> None:
    """The raw header must be exactly the eight names, in order, without padding."""
    columns = list(columns)
    if columns == list(RAW_COLUMNS):
        return
    missing = [c for c in RAW_COLUMNS if c not in columns]
    extra = [c for c in columns if c not in RAW_COLUMNS]
    padded = [c for c in columns if c != c.strip()]
    raise ValueError(
        f"{what}: header {columns} is not {list(RAW_COLUMNS)} "
        f"(missing={missing}, extra={extra}, outer whitespace={padded})"
    )
