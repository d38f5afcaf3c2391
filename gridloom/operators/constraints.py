"""Warehouse keys, references and value rules, checked as Spark jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.shared import stored


@dataclass(frozen=True)
class Rules:
    """Constraints of one table: keys, references ``column -> (table, column)``, NOT NULL, checks."""

    keys: tuple[tuple[str, tuple[str, ...]], ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()
    required: tuple[str, ...] = ()
    checks: tuple[tuple[str, str], ...] = ()


_DATE_REF = ("date_key", "dim_date", "date_key")
_METER_REF = ("meter_id", "dim_meter", "meter_id")
_EXTREMES = ("total_consumption", "avg_consumption", "max_consumption", "min_consumption", "reading_count")
_BASIC = ("total_consumption", "avg_consumption", "reading_count")
# The star schema's constraints.
RULES: Mapping[str, Rules] = {
    "dim_meter": Rules(
        keys=(("primary_key", ("meter_id",)),),
        required=("meter_id", "meter_type", "region"),
        checks=(("rated_voltage_positive", "rated_voltage > 0"),),
    ),
    "dim_date": Rules(
        keys=(("primary_key", ("date_key",)),),
        required=("date_key", "year", "quarter", "month", "day", "day_of_week", "weekend_flag", "season"),
        checks=(("month_range", "month BETWEEN 1 AND 12"), ("weekend_flag_domain", "weekend_flag IN (0, 1)")),
    ),
    "fact_hourly_consumption": Rules(
        keys=(("primary_key", ("date_key", "hour", "meter_id")),),
        references=(_DATE_REF, _METER_REF),
        required=("date_key", "hour", "meter_id", *_EXTREMES, "peak_hour_flag"),
        checks=(
            ("hour_range", "hour BETWEEN 0 AND 23"),
            ("total_not_negative", "total_consumption >= 0"),
            ("peak_hour_flag_domain", "peak_hour_flag IN (0, 1)"),
        ),
    ),
    "fact_daily_consumption": Rules(
        keys=(("primary_key", ("date_key", "meter_id")),),
        references=(_DATE_REF, _METER_REF),
        required=("date_key", "meter_id", *_EXTREMES, "weekend_flag", "season"),
        checks=(("total_not_negative", "total_consumption >= 0"),),
    ),
    "fact_monthly_consumption": Rules(
        keys=(("primary_key", ("year", "month", "meter_id")),),
        references=(_METER_REF,),
        required=("year", "month", "meter_id", *_EXTREMES),
        checks=(("month_range", "month BETWEEN 1 AND 12"),),
    ),
    "fact_peak_offpeak": Rules(
        keys=(("primary_key", ("date_key", "tariff_period")),),
        references=(_DATE_REF,),
        required=("date_key", "tariff_period", *_BASIC),
        checks=(("tariff_period_domain", "tariff_period IN ('peak', 'off_peak')"),),
    ),
    "fact_weather_energy": Rules(
        keys=(("primary_key", ("date_key", "weather_condition", "temperature_band")),),
        references=(_DATE_REF,),
        required=("date_key", "weather_condition", "temperature_band", *_BASIC),
    ),
    "fact_meter_consumption": Rules(
        keys=(("primary_key", ("meter_id",)),),
        references=(_METER_REF,),
        required=("meter_id", "meter_type", "region", *_EXTREMES, "consumption_rank"),
    ),
    "fact_predictions": Rules(
        keys=(("unique_reading_model", ("reading_ts", "meter_id", "model_name")),),
        references=(_METER_REF,),
        required=("reading_ts", "meter_id", "predicted_consumption", "model_name", "model_version"),
    ),
    "fact_anomalies": Rules(
        keys=(("unique_reading_method", ("reading_ts", "meter_id", "detection_method")),),
        references=(_METER_REF,),
        required=(
            "reading_ts", "meter_id", "energy_consumption", "anomaly_flag", "anomaly_type",
            "anomaly_severity", "detection_method",
        ),
        checks=(("anomaly_flag_domain", "anomaly_flag IN (0, 1)"),),
    ),
    "energy_summary": Rules(
        required=(
            "total_consumption", "avg_consumption", "peak_consumption", "min_consumption",
            "meter_count", "reading_count", "period_start", "period_end",
        ),
    ),
}


def _result(counted: DataFrame, table: str, names: Sequence[str]) -> DataFrame:
    """Unpivot a one-row frame of counts."""
    pairs = ", ".join(f"'{name}', `{name}`" for name in names)
    return counted.selectExpr(
        f"'{table}' AS table_name", f"stack({len(names)}, {pairs}) AS (constraint_name, violations)"
    )


def _value_rules(df: DataFrame, table: str, rules: Rules) -> DataFrame:
    """All NOT NULL and CHECK rules of a table in one pass; NULL passes a check."""
    counts: dict[str, Column] = {f"not_null_{c}": F.count_if(F.col(c).isNull()) for c in rules.required}
    counts |= {f"check_{name}": F.count_if(~F.expr(test)) for name, test in rules.checks}
    return _result(df.agg(*[count.alias(name) for name, count in counts.items()]), table, list(counts))


def duplicate_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def orphans(fact: DataFrame, column: str, dimension: DataFrame, key: str) -> DataFrame:
    """Referencing values the dimension lacks, with the rows that carry them.

    Rows are counted per value first, so the anti join sees each value once however often it
    occurs. A NULL reference is no orphan.
    """
    used = fact.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return used.join(dimension.select(F.col(key).alias("value")).distinct(), "value", "left_anti")


def check_constraints(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Rules] = RULES
) -> DataFrame:
    """(table_name, constraint_name, violations) for every rule of the tables at hand.

    A key counts surplus groups, a reference counts rows without a partner.
    """
    parts, links, names, labels = [], [], [], []
    for table, df in tables.items():
        known = rules[table]
        if known.required or known.checks:
            parts.append(_value_rules(df, table, known))
        for name, columns in known.keys:
            found = duplicate_keys(df, columns).agg(F.count(F.lit(1)).alias(name))
            parts.append(_result(found, table, [name]))
        for column, target, key in known.references:
            links.append((df, column, tables[target], key))
            names.append((table, target))
            labels.append((table, f"foreign_key_{column}"))
    if links:
        number = F.col("number") + 1
        label = [F.element_at(F.array(*(F.lit(pair[k]) for pair in labels)), number) for k in (0, 1)]
        parts.append(
            _resolved(links, names).select(
                label[0].alias("table_name"), label[1].alias("constraint_name"), F.col("orphans").alias("violations")
            )
        )
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Relationship:
    many: tuple[str, str]
    one: tuple[str, str]
    cardinality: str = "many-to-one"


# Relationships of the semantic model, gold names.
RELATIONSHIPS = (
    Relationship(("wide_fact", "date"), ("dim_date", "date")),
    Relationship(("wide_fact", "meter_id"), ("dim_meter", "meter_id")),
    Relationship(("daily_consumption", "date"), ("dim_date", "date")),
    Relationship(("daily_consumption", "meter_id"), ("dim_meter", "meter_id")),
    Relationship(("meter_consumption", "meter_id"), ("dim_meter", "meter_id"), "one-to-one"),
    Relationship(("predictions", "meter_id"), ("dim_meter", "meter_id")),
    Relationship(("anomalies", "meter_id"), ("dim_meter", "meter_id")),
    Relationship(("peak_offpeak_consumption", "date"), ("dim_date", "date")),
    Relationship(("weather_energy", "date"), ("dim_date", "date")),
    Relationship(("monthly_consumption", "meter_id"), ("dim_meter", "meter_id")),
)


def _used_values(df: DataFrame, columns: Mapping[int, str]) -> DataFrame:
    """(number, value, rows): how often each value occurs in each of the numbered columns, in one pass over the table."""
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("number"), F.col(c).cast("string").alias("value")) for n, c in columns.items())))
    counted = df.select(*set(columns.values())).select(pairs.alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("_p.number", "_p.value", "rows")


def _resolved(
    links: Sequence[tuple[DataFrame, str, DataFrame, str]], names: Sequence[tuple[str, str]]
) -> DataFrame:
    """(number, surplus, unresolved, repeated_one) for references ``(table, column, target, key)``; ``names`` tells tables apart.

    Each table is read once for all its references, and each target once for all that refer to it; values are counted before they
    are joined, so an orphan that a third of the rows carry is one row.
    """
    sources: dict[str, tuple[DataFrame, dict[int, str]]] = {}
    targets: dict[tuple[str, str], tuple[DataFrame, str]] = {}
    where: dict[tuple[str, str], list[int]] = {}
    for number, ((many, column, one, key), (source, target)) in enumerate(zip(links, names, strict=True)):
        sources.setdefault(source, (many, {}))[1][number] = column
        targets[target, key] = (one, key)
        where.setdefault((target, key), []).append(number)
    used = reduce(DataFrame.union, (_used_values(df, columns) for df, columns in sources.values()))
    known = reduce(
        DataFrame.union,
        (
            _used_values(one, {0: key}).select(F.explode(F.array(*map(F.lit, where[at]))).alias("number"), "value", F.col("rows").alias("there"))
            for at, (one, key) in targets.items()
        ),
    )
    known = stored(known, "known-keys")
    joined = used.join(known, ["number", "value"], "left").groupBy("number").agg(
        F.count_if(F.col("rows") > 1).alias("surplus"), F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("rows"))), F.lit(0)).alias("unresolved"),
        F.coalesce(F.sum(F.when(F.col("there").isNull() & F.col("value").isNotNull(), F.col("rows"))), F.lit(0)).alias("orphans"),
    )
    twice = known.where("there > 1").groupBy("number").agg(F.count(F.lit(1)).alias("repeated_one"))
    every = used.sparkSession.range(len(links)).select(F.col("id").cast("int").alias("number"))
    zeros = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("surplus", "unresolved", "orphans", "repeated_one")}
    return every.join(joined, "number", "left").join(twice, "number", "left").withColumns(zeros)


def check_relationships(
    datasets: Mapping[str, DataFrame], relationships: Sequence[Relationship] = RELATIONSHIPS
) -> DataFrame:
    """Per relationship: repeated keys on each side that must be unique, and unresolved rows."""
    dated = {link.many for link in relationships if link.one[1] == "date"}

    def many(name: str) -> DataFrame:
        days = {column: F.to_date(column) for source, column in dated if source == name}
        return datasets[name].withColumns(days) if days else datasets[name]

    links = [(many(link.many[0]), link.many[1], datasets[link.one[0]], link.one[1]) for link in relationships]
    found = _resolved(links, [(link.many[0], link.one[0]) for link in relationships])

    def chosen(values: Sequence[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("number") + 1)

    return found.select(
        chosen([".".join(link.many) for link in relationships]).alias("many_side"),
        chosen([".".join(link.one) for link in relationships]).alias("one_side"),
        chosen([link.cardinality for link in relationships]).alias("cardinality"),
        "repeated_one",
        F.when(chosen([link.cardinality for link in relationships]) == "one-to-one", F.col("surplus"))
        .otherwise(F.lit(0).cast("bigint"))
        .alias("repeated_many"),
        "unresolved",
    )


# What a flat fact, predictions and anomalies must fulfil before they are handed on.
READINESS = {
    "wide_fact": (
        ("total_known", "total_consumption IS NOT NULL"),
        ("anomaly_flag_domain", "anomaly_flag IN (0, 1)"),
        ("severity_domain", "anomaly_severity IN ('none', 'low', 'medium', 'high')"),
    ),
    "predictions": (("prediction_known", "predicted_consumption IS NOT NULL"),),
    "anomalies": (("flagged", "anomaly_flag = 1"),),
}


def check_readiness(datasets: Mapping[str, DataFrame], meters: DataFrame) -> DataFrame:
    """(dataset, rule, violations): row rules, one row per hour and meter, and meters the dimension knows."""
    parts = []
    for name, rules in READINESS.items():
        df = datasets[name]
        counts = [F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(rule) for rule, test in rules]
        parts.append(_result(df.agg(*counts), name, [rule for rule, _ in rules]))
    fact = datasets["wide_fact"]
    repeated = duplicate_keys(fact, ["date", "hour", "meter_id"]).agg(F.count(F.lit(1)).alias("unique_hour"))
    unknown = orphans(fact, "meter_id", meters, "meter_id").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("meter_known"))
    parts += [_result(repeated, "wide_fact", ["unique_hour"]), _result(unknown, "wide_fact", ["meter_known"])]
    return reduce(DataFrame.unionByName, parts).withColumnsRenamed({"table_name": "dataset", "constraint_name": "rule"})
