"""Layers and logs derived from the driver tables by integer arithmetic.

Every text runs unchanged on Spark and DuckDB; ``[table]`` stands for a driver table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

from tilewright.model import Layer
from tilewright.sources.layers import as_layer, with_boxes, with_points, with_segments

TEXTS = {
    "customer_pt": """
select c_custkey as id, c_name as name, nullif(c_mktsegment,'BUILDING') as segment, c_acctbal as balance,
  cast(c_nationkey as string) as code, c_acctbal > 0 as active, 4326 as srid,
  case when c_custkey % 17 = 3 then null else cast(-180 as double) + cast((c_custkey*7919) % 36000 as double)/cast(100 as double) end as lon,
  case when c_custkey % 17 = 3 then null else cast(-80 as double) + cast((c_custkey*104729) % 16000 as double)/cast(100 as double) end as lat
from [customer]""",
    "order_line": """
select id, status, price, placed, lon0, lat0, least(lon0+dlon, cast(180 as double)) as lon1, lat0+dlat as lat1 from (
 select o_orderkey as id, o_orderstatus as status, o_totalprice as price, o_orderdate as placed,
  cast(-180 as double) + cast((o_orderkey*7919) % 36000 as double)/cast(100 as double) as lon0,
  cast(-80 as double) + cast((o_orderkey*104729) % 16000 as double)/cast(100 as double) as lat0,
  cast((o_custkey*31) % 400 as double)/cast(100 as double) as dlon,
  cast((o_custkey*17) % 300 as double)/cast(100 as double) as dlat
 from [orders]) q""",
    "supplier_area": """
select id, name, balance, greatest(clon-half, cast(-180 as double)) as west, clat-half as south,
  least(clon+half, cast(180 as double)) as east, clat+half as north from (
 select s_suppkey as id, s_name as name, s_acctbal as balance, cast(1 + s_suppkey % 5 as double)/cast(2 as double) as half,
  cast(-180 as double) + cast((s_suppkey*7919) % 36000 as double)/cast(100 as double) as clon,
  cast(-80 as double) + cast((s_suppkey*104729) % 16000 as double)/cast(100 as double) as clat
 from [supplier]) q""",
    "lineitem_pt": """
select l_orderkey*10 + l_linenumber as id, l_returnflag as flag, l_quantity as quantity, l_shipdate as shipped,
  cast(-180 as double) + cast((l_orderkey*7919 + l_partkey*13) % 36000 as double)/cast(100 as double) as lon,
  cast(-80 as double) + cast((l_orderkey*104729 + l_suppkey*17) % 16000 as double)/cast(100 as double) as lat
from [lineitem]""",
    "request_log": """
select event_id as req_id, ts, user_id,
 case event_type when 'view' then 'L1' when 'click' then 'L2' when 'purchase' then 'MISS' when 'signup' then 'BYPASS' else 'ERROR' end as source,
 value as latency_ms, case user_id % 3 when 0 then 'customer_pt' when 1 then ' Order_Line ' else 'supplier_area' end as layer,
 cast(event_id % 8 as int) as z, cast((user_id*7) % 150 as int) as x,
 concat(cast((event_id*31) % 150 as string), case event_id % 3 when 0 then '.mvt' when 1 then '.PBF' else '' end) as y_raw
from [events]""",
    "auth_events": """
select event_id as t_sec, user_id % 5 as client, case when event_type = 'signup' then 'ok' else 'fail' end as outcome
from [events] where event_type in ('signup','error','view')""",
    "version_events": """
select event_id as seq, case user_id % 3 when 0 then 'Customer_Pt' when 1 then 'order_line' else 'supplier_area' end as layer,
 case when event_id % 50 = 7 then 'set' else 'bump' end as op,
 case when event_id % 50 = 7 then concat(case when event_id % 100 = 7 then 'v' else '' end, cast(event_id as string)) else null end as v
from [events]""",
    # addresses of the log that lie in the tile grid
    "tile_requests": """
select distinct z, x, y from (
 select cast(event_id % 8 as int) as z, cast((user_id*7) % 150 as int) as x, cast((event_id*31) % 150 as int) as y
 from [events]) q
where x < pow(2, z) and y < pow(2, z)""",
}
TEXTS["customer_multi"] = f"""
select *, greatest(lon-cast(0.5 as double), cast(-180 as double)) as west, lat-cast(0.5 as double) as south,
  least(lon+cast(0.5 as double), cast(180 as double)) as east, lat+cast(0.5 as double) as north
from ({TEXTS['customer_pt']}) c"""


def duck(*names: str) -> str:
    """``with name as (...), ...`` for the SQL side."""
    parts = [f"{n} as ({re.sub(r'\[(\w+)\]', r'\1', TEXTS[n])})" for n in names]
    return "with " + ",\n".join(parts)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    text = TEXTS[name]
    tables = {t: table(spark, sf, t) for t in set(re.findall(r"\[(\w+)\]", text))}
    return spark.sql(re.sub(r"\[(\w+)\]", r"{\1}", text), **tables)


def layer(spark: SparkSession, sf: str, name: str) -> Layer:
    rows = fixture(spark, sf, name)
    if name in ("customer_pt", "lineitem_pt"):
        return as_layer(with_points(rows, "lon", "lat"), name, drop=("lon", "lat"))
    if name == "order_line":
        return as_layer(with_segments(rows, "lon0", "lat0", "lon1", "lat1"), name,
                        drop=("lon0", "lat0", "lon1", "lat1"))
    if name == "supplier_area":
        return as_layer(with_boxes(rows, "west", "south", "east", "north"), name, comment="Areas served",
                        drop=("west", "south", "east", "north"))
    shaped = with_boxes(with_points(rows, "lon", "lat"), "west", "south", "east", "north", "area", present="lon")
    return as_layer(shaped, name, drop=("lon", "lat", "west", "south", "east", "north"))


# ---- SQL fragments -----------------------------------------------------------

PI = repr(math.pi)
WORLD = "cast(20037508.342789244 as double)"


def d(value) -> str:
    return f"cast({value} as double)"


def u(lon: str) -> str:
    return f"(({lon} + {d(180)}) / {d(360)})"


def v(lat: str) -> str:
    return f"(({d(1)} - sign({lat})*ln(tan(radians(abs({lat}))) + {d(1)}/cos(radians(abs({lat}))))/pi()) / {d(2)})"


def lat_of(v_: str) -> str:
    return f"degrees(atan(sinh(pi()*({d(1)} - {d(2)}*{v_}))))"


def boxed(name: str) -> str:
    """Rows of a fixture with their unit box ``u0, v0, u1, v1``."""
    sides = {
        "customer_pt": ("lon", "lat", "lon", "lat"), "lineitem_pt": ("lon", "lat", "lon", "lat"),
        "order_line": ("lon0", "lat0", "lon1", "lat1"), "supplier_area": ("west", "south", "east", "north"),
        "customer_multi": ("west", "south", "east", "north"),
    }[name]
    w, s, e, n = sides
    where = "lon is not null" if name.startswith("customer") else "true"
    return f"select *, {u(w)} as u0, {v(n)} as v0, {u(e)} as u1, {v(s)} as v1 from {name} where {where}"


def covered(name: str, zmin: int, zmax: int, shape: bool = False, extent: int = 4096, source: str | None = None) -> str:
    """Rows of a fixture per tile ``z, x, y``; ``shape`` leaves out lines and areas below half a cell."""
    seen = f"where (u1-u0)*n >= {d(0.5)}/{extent} or (v1-v0)*n >= {d(0.5)}/{extent}" if shape else ""
    return f"""
select *, unnest(generate_series(greatest(cast(ceil(v0*n) as bigint)-1, 0), least(cast(floor(v1*n) as bigint), cast(n as bigint)-1))) as y from (
 select *, unnest(generate_series(greatest(cast(ceil(u0*n) as bigint)-1, 0), least(cast(floor(u1*n) as bigint), cast(n as bigint)-1))) as x from (
  select *, pow({d(2)}, z) as n from (select *, unnest(generate_series({zmin},{zmax})) as z from ({source or boxed(name)}) b) zz) nn
 {seen}) xx"""


def pixel(unit: str, index: str, extent: int = 4096) -> str:
    return f"round_even(({unit}*n - {index})*{d(extent)}, 0)"
