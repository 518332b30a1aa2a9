"""Feature types are checked, never coerced, and the reject policy stops the job."""

import pytest
from pyspark.sql import functions as F

from siftlog.operators import dataset as ds
from siftlog.operators import mapping


def envelopes(spark, event, extensions="{}"):
    return spark.range(1).select(
        F.struct(F.lit("r1").alias("revision_id"), F.lit("PARTIALLY_PARSED").alias("status")).alias("processing"),
        F.struct(F.lit("t1").alias("tenant_id"), F.lit(5).cast("bigint").alias("received_at_ns")).alias("receipt"),
        F.struct(F.expr(event).alias("x"), F.parse_json(F.lit(extensions)).alias("extensions")).alias("event"))


def value(spark, kind, event="1", path="event.x", policy="nullable", extensions="{}"):
    feature = ds.Feature("f", kind, path, policy)
    return envelopes(spark, event, extensions).select(ds.feature_column(feature).alias("v")).first()["v"]


@pytest.mark.parametrize("kind,event,want", [
    ("integer", "7", 7), ("integer", "7.0D", 7), ("integer", "cast(7 as decimal(9,2))", 7), ("number", "1.5D", 1.5), ("number", "3", 3.0), ("boolean", "true", True),
    ("string", "'a'", "a"), ("ip", "'10.0.0.1'", "10.0.0.1"), ("timestamp", "timestamp'2024-01-02 03:04:05.5'", "2024-01-02T03:04:05.5Z"),
    ("timestamp", "'2024-01-02T03:04:05Z'", "2024-01-02T03:04:05Z"), ("integer", "cast(null as bigint)", None),
])
def test_right_types_of_columns(spark, kind, event, want):
    assert value(spark, kind, event) == want


@pytest.mark.parametrize("kind,event", [
    ("integer", "1.5D"), ("integer", "' 5 '"), ("integer", "true"), ("boolean", "1.5D"), ("boolean", "'true'"), ("string", "1.5D"), ("string", "true"),
    ("number", "'1'"), ("number", "double('NaN')"), ("ip", "'10.0.0'"), ("timestamp", "'2024-01-02'"), ("timestamp", "5"),
])
def test_wrong_types_of_columns_fail(spark, kind, event):
    with pytest.raises(Exception, match=f"is not of type {kind}"):
        value(spark, kind, event)


def test_types_inside_extensions(spark):
    def of(kind, body):
        return value(spark, kind, path="event.extensions.k", extensions=body)

    assert [of("integer", '{"k":7}'), of("integer", '{"k":7.0}'), of("number", '{"k":1.5}'), of("boolean", '{"k":true}'), of("string", '{"k":"a"}')] == [7, 7, 1.5, True, "a"]
    assert of("string", '{"k":null}') is None and of("string", "{}") is None
    for kind, body in (("integer", '{"k":1.5}'), ("integer", '{"k":" 5 "}'), ("string", '{"k":1.5}'), ("boolean", '{"k":1}'), ("string", '{"k":{"a":1}}')):
        with pytest.raises(Exception, match="is not of type"):
            of(kind, body)


def test_required_and_reject_policies_stop_the_job(spark):
    with pytest.raises(Exception, match="is missing"):
        value(spark, "integer", "cast(null as bigint)", policy="required")
    rows = envelopes(spark, "1")
    assert ds.select_envelopes(rows, "t1", 0, 10, ["PARTIALLY_PARSED"], "exclude").count() == 0
    with pytest.raises(Exception, match="partial revision rejected"):
        ds.select_envelopes(rows, "t1", 0, 10, ["PARTIALLY_PARSED"], "reject").collect()


def test_time_layouts(spark):
    cases = [
        ("Tue Jan  2 03:04:05 2024", "Mon Jan _2 15:04:05 2006", "2024-01-02 03:04:05"), ("Tue, 02 Jan 2024 03:04:05 GMT", "Mon, 02 Jan 2006 15:04:05 MST", "2024-01-02 03:04:05"),
        ("1/2/2024 03:04:05", "1/2/2006 15:04:05", "2024-01-02 03:04:05"), ("Jan 2 2024 03:04:05.25", "Jan 2 2006 15:04:05", "2024-01-02 03:04:05.25"),
        ("2024-01-02 12:04:05 AM", "2006-01-02 03:04:05 PM", "2024-01-02 00:04:05"), ("2024-01-02 12:04:05 PM", "2006-01-02 03:04:05 PM", "2024-01-02 12:04:05"),
        ("2024-01-02T03:04:05+05:30", "2006-01-02T15:04:05Z07:00", "2024-01-01 21:34:05"), ("2024-02-30 00:00:00", "2006-01-02 15:04:05", None),
        ("2024-01-02 03:04:61", "2006-01-02 15:04:05", None), ("xx", "2006-01-02", None), ("2024-01-02 03:04:05.123456789", "2006-01-02 15:04:05.000000000", "2024-01-02 03:04:05.123456"),
    ]
    for text, layout, want in cases:
        got = spark.range(1).select(mapping.parse_layout(F.lit(text), layout, "").cast("string").alias("v")).first()["v"]
        assert got == want, (text, layout, got)
    for layout in ("15:04", "2006-01-02 2006", ""):
        with pytest.raises(ValueError):
            mapping.compile_layout(layout)
