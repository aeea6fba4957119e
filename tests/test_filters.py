from __future__ import annotations

import datetime as dt

import pytest

from queryset.fixtures import layer
from tilewright.operators.filters import InvalidFilter, audit_filters, filter_layer
from tilewright.sources.layers import as_layer, with_points

ROWS = [
    (1, "01234", "active", 30, 1.5, True, dt.date(2020, 1, 1), 0.0, 0.0),
    (2, "1234", "idle", 40, 2.5, False, dt.date(2021, 1, 1), 1.0, 1.0),
    (3, None, "a_b%c", None, None, None, None, None, None),
    (4, "true", "ACTIVE", -12, -12.5, True, dt.date(2022, 6, 1), 2.0, 2.0),
]
SCHEMA = ("id int, code string, status string, age int, score double, is_active boolean, born date, lon double, lat double")


@pytest.fixture(scope="module")
def people(spark):
    return as_layer(with_points(spark.createDataFrame(ROWS, SCHEMA), "lon", "lat"), "people", drop=("lon", "lat"))


@pytest.mark.parametrize("predicate, ids", [
    (["=", "status", "active"], {1}),
    (["=", "code", 1234], {2}),  # the literal becomes text, '01234' stays different
    (["=", "code", True], {4}),
    (["=", "age", "-12"], {4}),
    ([">", "score", "1.5"], {2}),
    (["=", "age", 30.5], set()),
    (["=", "is_active", "true"], {1, 4}),
    (["=", "is_active", "0"], {2}),
    (["=", "STATUS", "idle"], {2}),
    (["in", "id", [1, "4"]], {1, 4}),
    (["between", "age", 30, 40], {1, 2}),
    (["like", "status", "a%"], {1, 3}),
    (["ilike", "status", "a%"], {1, 3, 4}),
    (["like", "status", "a!_b!%c", "!"], {3}),
    (["is null", "geom"], {3}),
    (["is not null", "age"], {1, 2, 4}),
    (["not", ["=", "age", 30]], {2, 4}),
    (["or", ["and", ["=", "id", 1], ["=", "age", 30]], ["=", "id", 4]], {1, 4}),
    ([">=", "born", "2021-01-01"], {2, 4}),
    (None, {1, 2, 3, 4}),
])
def test_accepted(people, predicate, ids):
    assert {r.id for r in filter_layer(people, predicate).frame.collect()} == ids


@pytest.mark.parametrize("predicate", [
    ["=", "secret", 1], ["=", "age", "old"], ["=", "age", True], ["=", "is_active", "maybe"], ["=", "is_active", 2],
    ["in", "id", []], ["between", "age", 1], ["like", "age", "1%"], ["like", "status", "a!", "!"],
    ["like", "status", "a%", "!!"], ["=", "geom", 1], ["=", "born", "someday"], ["; drop", "id", 1], [], "id = 1",
    ["not", ["=", "id", 1], ["=", "id", 2]], ["=", "id", None], ["=", "score", float("nan")], ["and"],
])
def test_refused(people, predicate):
    with pytest.raises(InvalidFilter):
        filter_layer(people, predicate)


def test_filter_reaches_the_scan(spark, sf):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    made = layer(spark, sf, "order_line")
    kept = filter_layer(made, ["and", ["=", "status", "F"], [">", "price", 1000]]).frame
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    assert "EqualTo(o_orderstatus,F)" in plan and "GreaterThan(o_totalprice,1000.0)" in plan


@pytest.mark.parametrize("text, bad", [
    ("status = 'active'", False), ("a; b", True), ("x -- y", True), ("/* x", True), ("$$", True), ("a::int", True),
    ("select 1", True), ("selected = 1", False), ("DROP", True), ("with_x = 1", False), ("x = 'WITH'", True),
])
def test_audit(spark, text, bad):
    assert audit_filters(spark.createDataFrame([(text,)], "filter string")).first().forbidden is bad
