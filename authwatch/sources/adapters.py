"""Projection of the driver's ``events`` table onto authentication events and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import utc


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    utc(spark)
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click-stream rows read as logins; all derived columns are functions of one row."""
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    text = lambda c: c.cast("string")
    kind = F.col("event_type")
    outcome = (
        F.when(kind.isin("click", "purchase"), "success")
        .when((kind == "signup") & (k % 2 == 0), "challenged")
        .when(kind == "signup", "blocked")
        .otherwise("failure")
    )
    place = k % 4
    stamp = F.col("ts").cast("timestamp")
    rows = raw_events(spark, sf_dir).select("*", k.alias("k"), outcome.alias("outcome"))
    k = F.col("k")
    place = k % 4
    return rows.select(
        F.lit("1.0.0").alias("schema_version"),
        text(F.col("event_id")).alias("event_id"),
        stamp.alias("event_time"),
        F.concat(F.lit("u:"), text(u)).alias("user_id"),
        F.when(k < 70, F.concat(F.lit("s:"), text(u % 25)))
        .otherwise(F.concat(F.lit("s:"), text(F.lit(100) + k % 6))).alias("source_id"),
        F.concat(F.lit("d:"), text((u * 7 + place) % 97)).alias("device_id"),
        F.concat(F.lit("sess:"), text(u), F.lit(":"), F.date_format(stamp, "yyyyMMdd")).alias("session_id"),
        F.concat(F.lit("app-"), text(k % 5)).alias("application_id"),
        F.when(place == 3, "mfa_totp").otherwise("password").alias("authentication_method"),
        F.col("outcome").alias("authentication_outcome"),
        F.when(F.col("outcome") == "failure", "invalid_credentials")
        .when(F.col("outcome") == "blocked", "rate_limited").alias("failure_reason"),
        F.element_at(F.array(F.lit("failed"), F.lit("passed"), F.lit("not_required"), F.lit("bypassed"),
                             F.lit(None).cast("string")), k % 5 + 1).alias("mfa_outcome"),
        F.element_at(F.array(F.lit("US"), F.lit("GB"), F.lit("JP"), F.lit(None).cast("string")),
                     place + 1).alias("country_code"),
        F.lit(None).cast("string").alias("region_code"),
        F.element_at(F.array(F.lit(40.0), F.lit(51.5), F.lit(35.7), F.lit(None).cast("double")),
                     place + 1).alias("coarse_latitude"),
        F.element_at(F.array(F.lit(-74.0), F.lit(-0.1), F.lit(139.7), F.lit(None).cast("double")),
                     place + 1).alias("coarse_longitude"),
        F.when(k % 7 != 0, F.concat(F.lit("ua-"), text(k % 3))).alias("user_agent_family"),
        F.lit(None).cast("string").alias("operating_system_family"),
        F.when(k % 11 == 0, "bot").when(k % 3 == 0, "mobile_app").otherwise("web_browser").alias("client_type"),
        F.when(k % 20 != 0, F.floor(F.col("value") * 10).cast("long")).alias("response_time_ms"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels derived from the user number and the day; one campaign per user group and day."""
    from ..schema import SCENARIOS

    u = F.col("user_id")
    scenario = F.element_at(F.array(*[F.lit(s) for s in SCENARIOS]), (u % 9 + 1).cast("int"))
    day = F.date_format(F.col("ts").cast("timestamp"), "yyyyMMdd")
    # Novel-holdout users are ineligible for supervised training.
    return raw_events(spark, sf_dir).select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("camp-"), (u % 30).cast("string"), F.lit("-"), F.substring(day, 1, 7)).alias("campaign_id"),
        scenario.alias("scenario"),
        (scenario != "normal").alias("malicious"),
        (scenario != "novel_anomaly_holdout").alias("supervised_training_eligible"),
        F.lit("driver").alias("generator_version"),
        F.lit(None).cast("string").alias("scenario_variant"),
        F.lit(None).cast("string").alias("campaign_stage"),
    )
