"""Data-quality checks, profiles, business rules and the quality score."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from orderlens.functions.parsing import parse_order_date
from orderlens.functions.stats import (
    clamp,
    count_where,
    iqr_bounds,
    ratio,
    sample_kurtosis,
    sample_skewness,
    total,
)
from orderlens.operators.quantiles import find_quantiles
from orderlens.schema import ORDER_LINE

# Columns whose nulls are checked, and those the score counts.
CRITICAL_COLUMNS = ["CustomerID", "FacilityID", "ProductID", "CreateDate", "OrderUnits"]
SCORED_COLUMNS = CRITICAL_COLUMNS[:4]
# The five columns a minimal raw order file must have.
RAW_REQUIRED_COLUMNS = ["CreateDate", "CustomerID", "FacilityID", "ProductID", "Quantity"]
# Thresholds.
EXCESSIVE_NULL_SHARE = 0.1
PAST_DAYS, FUTURE_DAYS = 365 * 5, 365 * 2
MAX_WARNINGS = 5

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMBERS = (*WHOLE, T.FloatType, T.DoubleType, T.DecimalType)
ID_TYPES = (*WHOLE, T.StringType)

CHECK_ROW = (
    "check string, scope string, value double, threshold double, status string, message string"
)


def _columns_of(df: DataFrame, kinds: tuple) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _columns_of(df, NUMBERS)


def text_columns(df: DataFrame) -> list[str]:
    return _columns_of(df, (T.StringType,))


def column_kinds(df: DataFrame) -> dict[str, int]:
    return {
        "total_columns": len(df.columns),
        "numeric_columns": len(numeric_columns(df)),
        "text_columns": len(text_columns(df)),
        "datetime_columns": len(_columns_of(df, (T.TimestampType, T.TimestampNTZType, T.DateType))),
    }


def _parsed_date(df: DataFrame, column: str = "CreateDate") -> Column:
    if isinstance(df.schema[column].dataType, T.StringType):
        return parse_order_date(F.col(column))
    return F.col(column).cast("timestamp")


# --- checks of the schema -------------------------------------------------------------


def missing_columns(df: DataFrame, required: list[str] | None = None) -> list[str]:
    return [c for c in (required or ORDER_LINE.names) if c not in df.columns]


def unexpected_types(df: DataFrame) -> list[tuple[str, str]]:
    """Columns whose type is not accepted, with that type."""
    accepted = {c: ID_TYPES for c in ["CustomerID", "FacilityID", "OrderID", "ProductID", "VendorID"]}
    accepted |= {c: NUMBERS for c in ["OrderUnits", "Price"]}
    return [
        (f.name, f.dataType.simpleString())
        for f in df.schema
        if f.name in accepted and not isinstance(f.dataType, accepted[f.name])
    ]


# --- checks of the values -------------------------------------------------------------
#
# Each check names the aggregates it needs and how rows are made from them, so that
# several checks of a table share one pass over it.


def _null_facts(df: DataFrame) -> dict[str, Column]:
    present = [c for c in CRITICAL_COLUMNS if c in df.columns]
    return {"total": F.count(F.lit(1))} | {
        f"null_{c}": count_where(F.col(c).isNull()) for c in present
    }


def _null_rows(df: DataFrame) -> list[tuple[str, Column, Column, Column]]:
    """Column name, null count, null percentage and status, given the facts."""
    rows = []
    for c in CRITICAL_COLUMNS:
        if c in df.columns:
            n, records = F.col(f"null_{c}"), F.col("total")
            excessive = n > records * EXCESSIVE_NULL_SHARE
            status = F.when(excessive, "issue").when(n > 0, "warning").otherwise("ok")
            rows.append((c, n, ratio(n * 100.0, records, 0.0), status))
    return rows


def _rows(values: list[tuple], names: list[str]) -> Column:
    """Rows given as tuples of columns or constants, one record each."""
    records = [
        F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(name) for v, name in zip(row, names)])
        for row in values
    ]
    return F.inline(F.array(*records))


def null_checks(df: DataFrame) -> DataFrame:
    """Null count and share of each critical column; any is a warning, over a tenth an issue."""
    facts = df.agg(*[fact.alias(name) for name, fact in _null_facts(df).items()])
    return facts.select(_rows(_null_rows(df), ["column_name", "null_count", "null_pct", "status"]))


def _date_facts(df: DataFrame, column: str) -> dict[str, Column]:
    ts = _parsed_date(df, column)
    return {
        "invalid_dates": count_where(ts.isNull()),
        "min_date": F.to_date(F.min(ts)),
        "max_date": F.to_date(F.max(ts)),
    }


def _date_flags(as_of: dt.date) -> dict[str, Column]:
    now = F.lit(as_of)
    return {
        "too_old": F.coalesce(F.col("min_date") < F.date_sub(now, PAST_DAYS), F.lit(False)),
        "too_new": F.coalesce(F.col("max_date") > F.date_add(now, FUTURE_DAYS), F.lit(False)),
    }


def date_checks(df: DataFrame, as_of: dt.date, column: str = "CreateDate") -> DataFrame:
    """Unreadable dates, and whether the range reaches unusually far back or ahead."""
    facts = df.agg(*[fact.alias(name) for name, fact in _date_facts(df, column).items()])
    return facts.withColumns(_date_flags(as_of))


def _value_kinds(df: DataFrame) -> dict[str, tuple[str, str]]:
    present = [c for c in ["OrderUnits", "Price"] if c in df.columns]
    return {f"{kind}_{c}": (c, kind) for c in present for kind in ["negative", "zero"]}


def _value_facts(df: DataFrame) -> dict[str, Column]:
    return {
        name: count_where(F.col(c) < 0 if kind == "negative" else F.col(c) == 0)
        for name, (c, kind) in _value_kinds(df).items()
    }


def _value_rows(df: DataFrame) -> list[tuple[str, str, Column, Column]]:
    """Column name, problem, row count and status, given the facts."""
    return [
        (c, kind, F.col(name), F.when(F.col(name) > 0, "warning").otherwise("ok"))
        for name, (c, kind) in _value_kinds(df).items()
    ]


def value_checks(df: DataFrame) -> DataFrame:
    """Negative and zero units and prices, one row per kind."""
    facts = df.agg(*[fact.alias(name) for name, fact in _value_facts(df).items()])
    return facts.select(_rows(_value_rows(df), ["column_name", "problem", "row_count", "status"]))


def _plain(field: T.StructField) -> Column:
    """A column as text that equal values share and different ones do not; null stays null."""
    column, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return (column + F.lit(0.0)).cast("string")  # a negative zero equals a zero
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(column)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(column, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return column.cast("string")


def row_digest(df: DataFrame) -> Column:
    """SHA-256 over all columns of a row; each value stands with its length, so rows never run together."""
    parts = []
    for field in df.schema:
        text = _plain(field)
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one, over all columns, with their share.

    Rows are counted by digest, so 32 bytes and a count go through the shuffle whatever a row's width. Copies
    are combined before it; a third of all rows being copies of one another costs a row per task.
    """
    grouped = df.groupBy(row_digest(df).alias("digest")).agg(F.count(F.lit(1)).alias("copies"))
    rows, extra = F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))
    return grouped.agg(
        rows.alias("total_records"),
        extra.alias("duplicate_records"),
        ratio(extra * 100.0, rows, 0.0).alias("duplicate_pct"),
    )


def dependency_violations(df: DataFrame, key: str = "ProductID", dependent: str = "ProductName") -> DataFrame:
    """Keys with more than one value of a column that should follow from them."""
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("key"))
        .agg(F.count_distinct(dependent).alias("n_values"))
        .where(F.col("n_values") > 1)
    )


def _flagged(condition: Column, status: str = "warning") -> Column:
    return F.when(condition, status).otherwise("ok")


def validation_checks(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Every check as one row: check, scope, value, threshold, status, message.

    Schema checks read metadata only. All value checks come out of one aggregate
    that shuffles a row per task; names per product need a second one.
    """
    names = ["check", "scope", "value", "threshold", "status", "message"]
    schema_rows = [
        ("required_columns", c, 1.0, 0.0, "issue", f"Missing required column {c}")
        for c in missing_columns(df)
    ] + [
        ("data_type", c, 1.0, 0.0, "warning", f"Column {c} has unexpected data type {kind}")
        for c, kind in unexpected_types(df)
    ]
    number = lambda c: c.cast("double")
    facts = _null_facts(df) | _value_facts(df)
    rows: list[tuple] = list(schema_rows)
    for c, n, share, status in _null_rows(df):
        text = F.format_string("%d null values (%.2f%%)", n, share)
        rows.append(("nulls", c, number(n), 0.0, _flagged(n > 0), text))
        excessive = F.when(status == "issue", "issue").otherwise("ok")
        rows.append(("excessive_nulls", c, share, EXCESSIVE_NULL_SHARE * 100, excessive, text))
    if "CreateDate" in df.columns:
        facts |= _date_facts(df, "CreateDate")
        bad, flags = F.col("invalid_dates"), _date_flags(as_of)
        text = F.format_string("%d invalid dates", bad)
        rows.append(("invalid_dates", "CreateDate", number(bad), 0.0, _flagged(bad > 0), text))
        for name, edge, label in [("too_old", "min_date", "First date "), ("too_new", "max_date", "Last date ")]:
            text = F.concat(F.lit(label), F.coalesce(F.col(edge).cast("string"), F.lit("unknown")))
            value = flags[name].cast("int").cast("double")
            rows.append((f"dates_{name}", "CreateDate", value, 0.0, _flagged(flags[name]), text))
    for c, kind, n, status in _value_rows(df):
        text = F.format_string(f"%d records with {kind} {c}", n)
        rows.append((f"{kind}_values", c, number(n), 0.0, status, text))
    table = df.agg(*[fact.alias(name) for name, fact in facts.items()])
    result = table.select(_rows(rows, names)) if rows else df.sparkSession.createDataFrame([], CHECK_ROW)
    if {"ProductID", "ProductName"} <= set(df.columns):
        n = F.col("n")
        broken = dependency_violations(df).agg(F.count(F.lit(1)).alias("n"))
        text = F.format_string("%d products with several names", n)
        row = ("one_name_per_product", "ProductID", number(n), 0.0, _flagged(n > 0), text)
        result = result.unionByName(broken.select(_rows([row], names)))
    return result


def verdict(checks: DataFrame) -> DataFrame:
    """Overall result of a check table."""
    issues, warnings = (count_where(F.col("status") == s) for s in ("issue", "warning"))
    return checks.agg(issues.alias("issues_count"), warnings.alias("warnings_count")).withColumn(
        "validation_summary",
        F.when(F.col("issues_count") > 0, "FAILED")
        .when(F.col("warnings_count") <= MAX_WARNINGS, "PASSED")
        .otherwise("PASSED_WITH_WARNINGS"),
    )


# --- profiles -------------------------------------------------------------------------


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Distribution of each numeric column, one row per column.

    Moments of all columns come from a single pass that shuffles one row per task;
    quartiles from :func:`find_quantiles`, which runs when this is called; the
    outliers from one more pass against the two bounds per column.
    """
    names = columns or numeric_columns(df)
    found = find_quantiles(df, names, [0.25, 0.5, 0.75])
    records = []
    for name in names:
        value = F.col(f"`{name}`").cast("double")
        q25, q50, q75 = (F.lit(found[name, p]).cast("double") for p in (0.25, 0.5, 0.75))
        low, high = iqr_bounds(q25, q75)
        records.append(
            F.struct(
                F.lit(name).alias("column_name"),
                F.count(value).alias("n"),
                F.avg(value).alias("mean"),
                F.stddev_samp(value).alias("std"),
                F.min(value).alias("min"),
                F.max(value).alias("max"),
                q50.alias("median"),
                q25.alias("q25"),
                q75.alias("q75"),
                sample_skewness(value).alias("skewness"),
                sample_kurtosis(value).alias("kurtosis"),
                count_where(value == 0).alias("zeros"),
                count_where((value < low) | (value > high)).alias("outliers"),
            )
        )
    wide = df.agg(*[record.alias(name) for name, record in zip(names, records)])
    return wide.select(F.inline(F.array(*[F.col(f"`{name}`") for name in names]))).where("n > 0")


def iqr_outliers(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bounds and number of values outside 1.5 interquartile ranges, per column."""
    profile = numeric_profile(df, columns)
    low, high = iqr_bounds(F.col("q25"), F.col("q75"))
    return profile.select(
        "column_name", low.alias("lower_bound"), high.alias("upper_bound"), "outliers"
    )


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per (column, value), all text columns in one pass; nulls count as a value."""
    names = columns or text_columns(df)
    long = df.select(*names).unpivot([], names, "column_name", "value")
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def categorical_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Cardinality and extreme values of each text column; ties go to the lesser value.

    Extremes are minima over (count, value), so a column of very many values is
    reduced where its value counts lie.
    """
    known = F.col("value").isNotNull()
    place = F.when(known, F.struct((-F.col("n")).alias("rank"), F.col("value")))
    extremes = value_counts(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("rows"),
        count_where(known).alias("unique_values"),
        F.min(place).alias("first"),
        F.max(place).alias("last"),
    )
    return extremes.select(
        "column_name",
        "unique_values",
        F.col("first.value").alias("most_frequent"),
        F.coalesce(-F.col("first.rank"), F.lit(0)).alias("most_frequent_count"),
        F.col("last.value").alias("least_frequent"),
        F.coalesce(-F.col("last.rank"), F.lit(0)).alias("least_frequent_count"),
        ratio(F.col("unique_values"), F.col("rows"), 0.0).alias("cardinality_ratio"),
    )


def categorical_top(df: DataFrame, columns: list[str] | None = None, k: int = 5) -> DataFrame:
    """The k most frequent values of each text column."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    counts = value_counts(df, columns).where("value is not null")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


# --- business rules -------------------------------------------------------------------


def business_rules(df: DataFrame) -> DataFrame:
    """Five rules as rows: rule, metric, whether it passed.

    One scan: a line counts under its customer (with the facility as member), product and vendor
    (with the product as member); (key, member) pairs are combined before they are shuffled, then members are
    counted by key. Units and dates of a line ride along under its customer. A hot key is one row per member.
    """
    has = set(df.columns).issuperset
    none = F.lit(None)
    sound = (F.col("OrderUnits") > 0) & (F.col("Price") > 0) if has({"OrderUnits", "Price"}) else none
    day = F.to_date(_parsed_date(df)) if has({"CreateDate"}) else none
    named = F.col("CategoryName").isNotNull() if has({"ProductID", "CategoryName"}) else none

    def line(kind: str, key: Column, member: Column, along: bool = False, category: Column = none) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            key.cast("string").alias("key"),
            member.cast("string").alias("member"),
            category.cast("boolean").alias("named"),
            F.lit(1 if along else 0).cast("bigint").alias("lines"),
            (sound.cast("bigint") if along else none.cast("bigint")).alias("sound"),
            (day if along else none).cast("date").alias("day"),
        )

    def column(name: str) -> Column:
        return F.col(name) if name in df.columns else none

    lines = [line("customer", column("CustomerID"), column("FacilityID"), along=True)]
    if has({"ProductID", "CategoryName"}):
        lines.append(line("product", F.col("ProductID"), none, category=named))
    if has({"VendorID", "ProductID"}):
        lines.append(line("vendor", F.col("VendorID"), F.col("ProductID")))
    along = [
        F.sum("lines").alias("lines"),
        F.sum("sound").alias("sound"),
        F.max("named").alias("named"),
    ]
    pairs = df.select(F.inline(F.array(*lines))).groupBy("kind", "key", "member").agg(
        *along, F.min("day").alias("first"), F.max("day").alias("last")
    )
    keys = pairs.groupBy("kind", "key").agg(
        F.count("member").alias("members"), *along, F.min("first").alias("first"), F.max("last").alias("last")
    )
    of = lambda kind, value: F.when((F.col("kind") == kind) & F.col("key").isNotNull(), value)
    facts = keys.agg(
        ratio(F.coalesce(F.sum("sound"), F.lit(0)) * 100.0, F.sum("lines"), 0.0).alias("sound"),
        F.datediff(F.max("last"), F.min("first")).alias("span"),
        F.avg(of("customer", F.col("members"))).alias("facilities"),
        F.coalesce(F.avg(of("product", F.col("named").cast("int"))) * 100, F.lit(0.0)).alias("covered"),
        F.avg(of("vendor", F.col("members"))).alias("products"),
    )
    # Names and limits of the rules.
    rules = [
        ({"OrderUnits", "Price"}, "valid_orders", "sound", F.col("sound") >= 95),
        ({"CreateDate"}, "date_span", "span", F.col("span").between(30, 365 * 3)),
        ({"CustomerID", "FacilityID"}, "facilities_per_customer", "facilities", F.col("facilities") > 0),
        ({"ProductID", "CategoryName"}, "category_coverage", "covered", F.col("covered") >= 90),
        ({"VendorID", "ProductID"}, "products_per_vendor", "products", F.col("products") >= 1),
    ]
    rows = [
        (rule, F.col(metric).cast("double"), F.coalesce(passed, F.lit(False)).cast("int"))
        for needed, rule, metric, passed in rules
        if has(needed)
    ]
    return facts.select(_rows(rows, ["rule", "metric", "passed"]))


# --- quality score --------------------------------------------------------------------


def quality_score(df: DataFrame) -> DataFrame:
    """Completeness, validity and consistency on a scale to 100, and their mean.

    One pass and one shuffle: rows are combined by digest, and their gaps and faults are added up on
    the way; the columns themselves are not shuffled.
    """
    counted = lambda condition: F.sum(F.when(condition, 1).otherwise(0))
    gaps = [counted(F.col(c).isNull()) for c in SCORED_COLUMNS if c in df.columns]
    faults = []
    if "OrderUnits" in df.columns:
        faults.append(counted(F.col("OrderUnits") < 0))
    if "CreateDate" in df.columns:
        # one fault for the column, however many of its dates are unreadable
        unreadable = F.col("CreateDate").isNotNull() & _parsed_date(df).isNull()
        unread = F.max(F.coalesce(unreadable, F.lit(False)).cast("long"))
    else:
        unread = F.max(F.lit(0).cast("long"))
    zero = F.lit(0).cast("bigint")
    distinct = df.groupBy(row_digest(df).alias("digest")).agg(
        F.count(F.lit(1)).alias("copies"),
        (total(gaps) if gaps else F.sum(zero)).alias("gaps"),
        (total(faults) if faults else F.sum(zero)).alias("faults"),
        unread.alias("unread"),
    )
    facts = distinct.agg(
        F.coalesce(F.sum("copies"), zero).alias("rows"),
        F.coalesce(F.sum("gaps"), zero).alias("missing_critical"),
        F.coalesce(F.sum("faults") + F.max("unread"), zero).alias("validity_issues"),
        F.coalesce(F.sum(F.col("copies") - 1), zero).alias("duplicate_records"),
    )
    share = lambda name: F.coalesce(F.try_divide(F.col(name) * 100.0, F.col("rows")), F.lit(0.0))
    # an empty table scores nothing for its content, but has no duplicates either
    score = lambda name: F.when(F.col("rows") > 0, clamp(100 - share(name), 0.0, 100.0)).otherwise(0.0)
    scored = facts.withColumns(
        {
            "duplicate_pct": share("duplicate_records"),
            "completeness": score("missing_critical"),
            "validity": score("validity_issues"),
            "consistency": clamp(100 - share("duplicate_records"), 0.0, 100.0),
        }
    )
    mean = (F.col("completeness") + F.col("validity") + F.col("consistency")) / 3
    return scored.withColumn("data_quality_score", mean)


def advice_for_score() -> Column:
    """Advice that follows from the columns of a score row, as an array."""
    # Messages and their thresholds.
    advice = [
        (F.col("data_quality_score") < 70,
         "Data quality is below acceptable threshold (70%). Immediate attention required."),
        (F.col("duplicate_pct") > 5,
         "High duplicate record percentage detected. Consider data deduplication."),
        (F.col("missing_critical") > 0,
         "Missing values found in critical columns. Data cleaning recommended."),
        (F.col("validity_issues") > 0,
         "Data validity issues detected. Review data formats and business rules."),
    ]
    fine = "Data quality is acceptable. Continue with regular monitoring."
    given = F.array_compact(F.array(*[F.when(condition, text) for condition, text in advice]))
    return F.when(F.size(given) > 0, given).otherwise(F.array(F.lit(fine)))


def quality_recommendations(score: DataFrame) -> DataFrame:
    """Advice that follows from a score row, one message per row."""
    return score.select(F.explode(advice_for_score()).alias("recommendation"))


def report_summary(score: DataFrame, checks: DataFrame, rules: DataFrame) -> DataFrame:
    """Summary record, one row, of a score, a check table and a rule table."""
    counts = rules.agg(
        F.struct(
            count_where(F.col("passed") == 1).alias("business_rules_passed"),
            count_where(F.col("passed") == 0).alias("business_rules_failed"),
        )
    )
    # one-row results side by side, each computed once
    return score.select(
        "data_quality_score",
        F.col("rows").alias("total_records"),
        advice_for_score().alias("recommendations"),
        verdict(checks).select(F.struct("*")).scalar().alias("result"),
        counts.scalar().alias("rules"),
    ).select("result.*", "data_quality_score", "total_records", "rules.*", "recommendations")


def validation_report(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Summary record of all of the above, one row; ``df`` is read four times, so store it first."""
    return report_summary(quality_score(df), validation_checks(df, as_of), business_rules(df))
