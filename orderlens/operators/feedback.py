"""Validation of feedback events, row by row, for batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.functions.parsing import clean_id, json_object, lenient_double

# Required fields, accepted types, error codes.
REQUIRED = ["customer_id", "facility_id", "prediction_id", "feedback_type", "rating"]
FEEDBACK_TYPES = ["accuracy", "usefulness", "general", "recommendation"]
INVALID_JSON, MISSING_FIELDS, INVALID_VALUES = "INVALID_JSON", "MISSING_FIELDS", "INVALID_FIELD_VALUES"
QUANTITIES = ["actual_quantity", "predicted_quantity"]

# every field as text: what it must hold is checked, not assumed
FEEDBACK_JSON = ", ".join(
    f"{name} string"
    for name in [*REQUIRED, "comments", "user_id", "product_id", *QUANTITIES]
)


def parse_feedback(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Fields of JSON feedback bodies; an unreadable body leaves them all NULL."""
    parsed = bodies.withColumn("_fields", json_object(F.col(body), FEEDBACK_JSON))
    return parsed.select(*bodies.columns, F.col("_fields").isNotNull().alias("valid_json"), "_fields.*")


def _rating() -> Column:
    """Whole rating; a fraction is cut off."""
    number = lenient_double(F.col("rating").cast("string"))
    return F.when(number.between(-1e9, 1e9), number.cast("int"))


def _blank(name: str) -> Column:
    return clean_id(F.col(name)) == ""


def error_code() -> Column:
    """First failing check of a feedback row, NULL when it is acceptable."""
    missing = F.greatest(*[F.col(name).isNull().cast("int") for name in REQUIRED]) == 1
    rating = _rating()
    in_domain = (
        F.coalesce(rating.between(1, 5), F.lit(False))
        & F.col("feedback_type").isin(FEEDBACK_TYPES)
        & ~_blank("customer_id")
        & ~_blank("facility_id")
    )
    return F.when(missing, MISSING_FIELDS).when(~in_domain, INVALID_VALUES)


def validate_feedback(rows: DataFrame) -> DataFrame:
    """Add the error code and, for the record, cleaned ids, rating and quantities.

    A quantity that is no number is dropped and a negative one flagged; neither
    rejects the row.
    """
    for name in ["comments", "user_id", "product_id", *QUANTITIES]:
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
    code = error_code()
    if "valid_json" in rows.columns:
        code = F.when(~F.col("valid_json"), INVALID_JSON).otherwise(code)
    product = clean_id(F.col("product_id"))
    cleaned = {
        "error_code": code,
        "rating": _rating(),
        **{name: clean_id(F.col(name)) for name in ["customer_id", "facility_id", "prediction_id"]},
        "comments": F.coalesce("comments", F.lit("")),
        "user_id": F.coalesce("user_id", F.lit("anonymous")),
        "product_id": F.when(product != "", product),
    }
    for name in QUANTITIES:
        number = lenient_double(F.col(name).cast("string"))
        cleaned[name] = number
        cleaned[f"negative_{name}"] = F.coalesce(number < 0, F.lit(False))
    return rows.withColumns(cleaned)


def feedback_records(valid: DataFrame, received: Column) -> DataFrame:
    """Accepted rows with a repeatable id and the time they were received."""
    identity = F.sha2(
        F.to_json(F.struct("customer_id", "facility_id", "prediction_id", "feedback_type",
                           "rating", "user_id", "product_id", "comments", *QUANTITIES)), 256)
    kept = valid.where(F.col("error_code").isNull()).drop("error_code")
    return kept.withColumns({"id": identity, "timestamp": received})
