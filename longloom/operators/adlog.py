"""Metrics per viewer from an ad event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kv import query_param, truthy
from ..functions.numeric import event_indicator, null_skipping_sum, one_minus_ratio, ratio

# Names in the log.
ID_PARAM = "am_crmid"
START_EVENT = "defaultImpression"
END_EVENT = "_q_complete"
SUMMED = ["MaxAds", "AdsSelected", "AdDuration", "MaxDuration", "AdStarted", "AdEnded"]


def request_ids(log: DataFrame) -> DataFrame:
    """Distinct (request, viewer id) pairs of the log rows that carry request parameters; the id may be NULL."""
    return log.filter(truthy(F.col("AllRequestKv"))).select(
        "UniqueIdentifier", query_param(F.col("AllRequestKv"), ID_PARAM).alias("FreewheelId")).distinct()


def first_id(log: DataFrame) -> DataFrame:
    """One viewer id per request: the lowest one it names."""
    viewer = query_param(F.col("AllRequestKv"), ID_PARAM)
    return log.filter(truthy(F.col("AllRequestKv"))).groupBy("UniqueIdentifier").agg(F.min(viewer).alias("FreewheelId"))


def attach_first_id(log: DataFrame) -> DataFrame:
    """Every log row with its request's viewer id, NULL when the request names none; rows without a request number
    are one request.

    The id side has one row per request. A request with very many log rows makes a skewed partition on the log side
    only, which adaptive execution splits.
    """
    ids = first_id(log).withColumnRenamed("UniqueIdentifier", "_request")
    return log.join(ids, F.col("UniqueIdentifier").eqNullSafe(F.col("_request")), "left").drop("_request")


def with_indicators(log: DataFrame) -> DataFrame:
    return log.withColumns({
        "AdStarted": event_indicator(F.col("EventName"), START_EVENT),
        "AdEnded": event_indicator(F.col("EventName"), END_EVENT),
    })


def ad_metrics(log: DataFrame) -> DataFrame:
    """Sums and rates per viewer.

    Attaching a request's id to each of its rows and summing by id is the same as summing the request first and
    attaching the id to the sum. So the log is aggregated by request, id and sums together, then by id: no self-join,
    and both steps combine within tasks first, however many rows one request or viewer has. Requests without an id
    are dropped.
    """
    viewer = F.when(truthy(F.col("AllRequestKv")), query_param(F.col("AllRequestKv"), ID_PARAM))
    requests = with_indicators(log).groupBy("UniqueIdentifier").agg(
        F.min(viewer).alias("FreewheelID"), *[null_skipping_sum(F.col(c)).alias(c) for c in SUMMED])
    totals = requests.filter(truthy(F.col("FreewheelID"))).groupBy("FreewheelID").agg(
        *[F.sum(c).alias(c) for c in SUMMED])
    return totals.select(
        "FreewheelID", *SUMMED,
        one_minus_ratio(F.col("AdEnded"), F.col("AdStarted")).alias("PercentExitAdBreaks"),
        ratio(F.col("AdsSelected"), F.col("MaxAds")).alias("AdServedVSAdRequested"),
    )
