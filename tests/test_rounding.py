"""Rendered numbers round as the SQL does."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import format as fmt
from fleetlens.queries import class_text


@pytest.mark.parametrize(("ns", "text"), [(1_005_000_000, "1.00s"), (1_125_000_000, "1.12s"), (1_375_000_000, "1.38s"), (12_345_678_000_000, "12345.68s"), (999_999_999, "999ms"), (0, "-")])
def test_latency_rounds_the_exact_value(spark, ns, text):
    assert spark.range(1).select(fmt.format_latency(F.lit(ns)).alias("x")).first()["x"] == text


def test_class_text_rounds_halves_up(spark):
    """0.00095 is a little less than its text, and yet 9.5 of 1/10000."""
    report = spark.createDataFrame([(1, {"CPU": 1234.5, "IO": 0.00095, "Lock": 0.00065, "Sync": 0.0, "Network": 0.00014, "Other": 0.25})], "server_id long, classes map<string, double>")
    assert class_text(report).first()["classes"] == "CPU=1234.5000,IO=0.0010,Lock=0.0007,Sync=0.0000,Network=0.0001,Other=0.2500"
