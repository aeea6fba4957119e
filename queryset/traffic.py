from __future__ import annotations

from pyspark.sql import functions as F

from queryset.fixtures import d, duck, fixture, table
from queryset.registry import query
from tilewright.functions.text import tile_row_text
from tilewright.operators import traffic as ops
from tilewright.streaming import lockout
from tilewright.streaming.runs import run_available, run_with_state, work_folder


def metrics_sql(source: str, by: str = "") -> str:
    comma = f"{by}, " if by else ""
    return f"""select {comma}l1_hits, l1_misses, l2_hits, l2_misses, computes, bypassed,
 l1_hits+l2_hits+computes+bypassed as total_requests,
 round(coalesce(cast(l1_hits as double)/nullif(l1_hits+l1_misses, 0), 0), 4) as l1_hit_ratio,
 round(coalesce(cast(l2_hits as double)/nullif(l2_hits+l2_misses, 0), 0), 4) as l2_hit_ratio,
 round(coalesce(cast(l1_hits+l2_hits as double)/nullif(l1_hits+l2_hits+computes+bypassed, 0), 0), 4) as overall_hit_ratio,
 coalesce((2*compute_us + 10*computes) // nullif(20*computes, 0), 0) / {d(100)} as compute_avg_ms,
 (2*coalesce(compute_us, 0) + 100) // 200 / {d(10000)} as compute_total_s,
 coalesce((2*remote_us + 10*l2_hits) // nullif(20*l2_hits, 0), 0) / {d(100)} as remote_avg_ms,
 (2*coalesce(remote_us, 0) + 100) // 200 / {d(10000)} as remote_total_s
from (select {comma}count_if(source='L1') as l1_hits, count_if(source in ('L2','MISS')) as l1_misses,
 count_if(source='L2') as l2_hits, count_if(source='MISS') as l2_misses, count_if(source='MISS') as computes,
 count_if(source='BYPASS') as bypassed, sum(case when source='MISS' then cast(round(latency_ms*1000) as bigint) end) as compute_us,
 sum(case when source='L2' then cast(round(latency_ms*1000) as bigint) end) as remote_us from {source} {f'group by {by}' if by else ''}) m"""


@query("request_metrics", f"{duck('request_log')} {metrics_sql('request_log')}")
def request_metrics(spark, sf):
    return ops.request_metrics(fixture(spark, sf, "request_log"))


@query("request_metrics_by_layer", f"""{duck('request_log')},
l as (select lower(trim(layer)) as layer, case when user_id % 10 = 0 then 'BYPASS' else source end as source, latency_ms from request_log)
{metrics_sql('l', 'layer')}""")
def request_metrics_by_layer(spark, sf):
    log = fixture(spark, sf, "request_log")
    who = F.col("user_id") % 10
    flagged = log.withColumn("bypass", ops.bypass_flag(F.when((who == 0) & (F.col("req_id") % 2 == 0), "false"),
                                                       F.when((who == 0) & (F.col("req_id") % 2 == 1), "no-cache")))
    return ops.request_metrics(flagged.withColumn("layer", F.lower(F.trim("layer"))), ["layer"])


WINDOWED_SQL = f"""{duck('request_log')},
l as (select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as w, source, latency_ms from request_log)
select strftime(w, '%Y-%m-%d %H:%M') as window_start, strftime(w + interval '6 hours', '%Y-%m-%d %H:%M') as window_end, m.* exclude (w)
from ({metrics_sql('l', 'w')}) m"""


def _window_text(frame):
    rest = [c for c in frame.columns if not c.startswith("window_")]
    return frame.select(*[F.date_format(c, "yyyy-MM-dd HH:mm").alias(c) for c in ("window_start", "window_end")], *rest)


@query("request_metrics_windowed", WINDOWED_SQL)
def request_metrics_windowed(spark, sf):
    return _window_text(ops.request_metrics_windowed(fixture(spark, sf, "request_log")))


def _event_stream(spark, sf):
    return spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events*.parquet")


@query("request_metrics_stream", WINDOWED_SQL)
def request_metrics_stream(spark, sf):
    """Windows that a stream of the same log has closed, and those that its state holds open."""
    events = _event_stream(spark, sf)
    source = F.when(F.col("event_type") == "view", "L1").when(F.col("event_type") == "click", "L2").when(
        F.col("event_type") == "purchase", "MISS").when(F.col("event_type") == "signup", "BYPASS").otherwise("ERROR")
    log = events.select("ts", source.alias("source"), F.col("value").alias("latency_ms"))
    closed, state = run_with_state(ops.request_metrics_windowed(log), "request-metrics")
    return _window_text(closed.unionByName(ops.open_windows(state)))



def exposition_sql() -> str:
    values = []
    for i, (name, text, kind, column) in enumerate(ops.EXPOSED[:10]):
        values.append(f"select {3 * i} as line_no, '# HELP {name} {text}' as line")
        values.append(f"select {3 * i + 1}, '# TYPE {name} {kind}'")
        values.append(f"select {3 * i + 2}, concat('{name}{{layer=\"', layer, '\"}} ', cast({column} as varchar)) from m")
    return f"""{duck('request_log')}, l as (select lower(trim(layer)) as layer, source, latency_ms, z, x, y_raw from request_log),
shared as (select layer, count(*) as executions, cast(sum(n) as bigint) - count(*) as waiters from (
 select layer, count(*) as n from l where source = 'MISS' group by layer, z, x, y_raw) k group by layer),
m as (select * from ({metrics_sql('l', 'layer')}) s join shared using (layer)) {' union all '.join(values)}"""


@query("metrics_exposition", exposition_sql())
def metrics_exposition(spark, sf):
    log = fixture(spark, sf, "request_log").withColumn("layer", F.lower(F.trim("layer")))
    shared = ops.coalesce_requests(log.filter("source = 'MISS'"), ["layer", "z", "x", "y_raw"]).groupBy("layer").agg(
        F.sum("executions").alias("executions"), F.sum("waiters").alias("waiters"))
    return ops.exposition(ops.request_metrics(log, ["layer"]).join(shared, "layer"), ["layer"])


@query("latency_percentiles", f"""{duck('request_log')}
select source, percent, latency_ms as value from (
 select source, latency_ms, row_number() over (partition by source order by latency_ms) as rn,
  count(*) over (partition by source) as n from request_log where latency_ms is not null) r
 cross join (select unnest([{d(50)}, {d(95)}, {d(99)}, {d(100)}]) as percent) p
where rn = greatest(1, cast(ceil(percent/100*n) as bigint))""")
def latency_percentiles(spark, sf):
    return ops.latency_percentiles(fixture(spark, sf, "request_log"), ["source"], [50, 95, 99, 100])


@query("request_rate", f"""{duck('request_log')}
select source, count(*) as requests, round(count(*)*{d(1e6)}/(epoch_us(max(ts))-epoch_us(min(ts))), 6) as requests_per_second
from request_log group by source""")
def request_rate(spark, sf):
    return ops.request_rate(fixture(spark, sf, "request_log"), ["source"])


@query("coalesce_requests", rf"""{duck('request_log')}
select lower(trim(layer)) as layer, z, x, regexp_replace(y_raw, '\.(mvt|pbf)$', '', 'i') as y, cast(1 as bigint) as executions,
 count(*) - 1 as waiters from request_log
where source = 'MISS' group by all""")
def coalesce_requests(spark, sf):
    log = fixture(spark, sf, "request_log").filter("source = 'MISS'").withColumn("layer", F.lower(F.trim("layer")))
    return ops.coalesce_requests(log.withColumn("y", tile_row_text(F.col("y_raw"))), ["layer", "z", "x", "y"])


EPOCH = 1_704_067_200  # a stream needs real times: the watermark starts at 1970

# fold of the lockout rules, one row of the recursion per event of a client
LOCKOUT_SQL = f"""{duck('auth_events').replace('with ', 'with recursive ', 1)},
e as (select *, row_number() over (partition by client order by t_sec) as i from auth_events),
f as (
 select client, i, t_sec, outcome, cast(0 as bigint) as n_blocked, false as locked,
  cast(case when outcome = 'fail' then 1 else 0 end as int) as attempts, cast(0 as int) as strikes, cast(0 as bigint) as until,
  case when outcome = 'fail' then t_sec + 3600 else 0 end as expires, cast(0 as bigint) as retry_after from e where i = 1
 union all
 select client, i, t_sec, outcome, case when blocked or locks then 1 else 0 end, locks,
  cast(case when blocked then a when locks then 0 when outcome = 'fail' then a + 1 else 0 end as int),
  cast(case when blocked then s when locks then s + 1 when outcome = 'fail' then s else 0 end as int),
  case when blocked then u when locks then t_sec + len else 0 end,
  case when blocked then x when locks then t_sec + len + 86400 when outcome = 'fail' then t_sec + 3600 else 0 end,
  case when blocked then u - t_sec when locks then len else 0 end
 from (select *, not blocked and outcome = 'fail' and a + 1 >= 5 as locks, cast(60 * pow(2, least(s, 10)) as bigint) as len
  from (select *, t_sec < u as blocked
   from (select e.client, e.i, e.t_sec, e.outcome, case when gone then 0 else attempts end as a,
     case when gone then 0 else strikes end as s, case when gone then 0 else until end as u, case when gone then 0 else expires end as x
    from (select f.*, f.expires > 0 and n.t_sec > f.expires as gone from f join e n on n.client = f.client and n.i = f.i + 1) f
    join e on e.client = f.client and e.i = f.i + 1) p) q) r)
"""
REPORT_SQL = """select client, t_sec, case when outcome = 'ok' then 1 else 0 end as n_ok,
 case when outcome = 'fail' then 1 else 0 end as n_fail, n_blocked, locked, attempts, strikes, retry_after from f"""


@query("lockout", f"{LOCKOUT_SQL} {REPORT_SQL}")
def lockout_query(spark, sf):
    return lockout.detect_lockouts(fixture(spark, sf, "auth_events")).drop("ts")


@query("lockout_summary", f"""{LOCKOUT_SQL} select client, count(*) as events, sum(n_blocked) as blocked, count_if(locked) as lockouts,
 max(strikes) as max_strikes from f group by client""")
def lockout_summary(spark, sf):
    return lockout.lockout_summary(lockout.detect_lockouts(fixture(spark, sf, "auth_events")))


@query("lockout_stream", f"{LOCKOUT_SQL} {REPORT_SQL}")
def lockout_stream(spark, sf):
    events = _event_stream(spark, sf).filter(F.col("event_type").isin("signup", "error", "view")).select(
        (F.col("user_id") % 5).alias("client"), (F.col("event_id") + EPOCH).alias("t_sec"),
        F.when(F.col("event_type") == "signup", "ok").otherwise("fail").alias("outcome"))
    # one event of nobody, a day after all others, moves the watermark past them
    closing = events.sparkSession.createDataFrame([(-1, EPOCH + 10**9, "ok")], "client bigint, t_sec bigint, outcome string")
    folder = work_folder(closing, "closing")
    closing.write.parquet(folder)
    ended = events.unionByName(spark.readStream.schema(closing.schema).parquet(folder))
    report = run_available(lockout.lockout_stream(ended), "lockout")
    return report.withColumn("t_sec", F.col("t_sec") - EPOCH).drop("ts")
