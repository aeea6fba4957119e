"""Metrics of tile-request logs.

A log has ``source`` (L1, L2, MISS, BYPASS; anything else is not counted) and
``latency_ms``; a request with ``bypass`` true counts as BYPASS.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions.text import tile_row_text, truthy
from tilewright.functions.tilemath import address_problem
from tilewright.operators.checkpoints import cut_lineage

DIGIT_BITS = 11  # bits of a fraction that one round of a selection looks at
FRACTION_BITS = 52


def bypass_flag(cache: Column, cache_control: Column) -> Column:
    """``cache=false`` in the query or a ``no-cache`` request header."""
    return F.coalesce((cache == "false") | F.contains(cache_control, F.lit("no-cache")), cache == "false",
                      F.contains(cache_control, F.lit("no-cache")), F.lit(False))


def check_addresses(requests: DataFrame) -> DataFrame:
    """Read tile addresses given as text; adds ``z, x, y`` and ``problem`` (NULL when good)."""
    z, x, y = (F.expr(f"try_cast({c} as int)") for c in ("z_text", "x_text", "y_clean"))
    out = requests.withColumn("y_clean", tile_row_text(F.col("y_text")))
    out = out.withColumn("z", z).withColumn("x", x).withColumn("y", y).drop("y_clean")
    return out.withColumn("problem", address_problem(F.col("z"), F.col("x"), F.col("y")))


def tile_flag(text: Column) -> Column:
    return truthy(text)


def _ratio(part: Column, whole: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(part, whole), F.lit(0.0)), 4)


def _mean_ms(us: str, n: str) -> Column:
    """Mean in milliseconds, rounded half up to 2 decimals."""
    return F.expr(f"if({n} = 0, 0D, (2 * {us} + 10 * {n}) div (20 * {n}) / 100D)")


def _seconds(us: str) -> Column:
    """Total in seconds, rounded half up to 4 decimals."""
    return F.expr(f"(2 * coalesce({us}, 0) + 100) div 200 / 10000D")


def _counters(log: DataFrame) -> tuple[list[Column], list[Column]]:
    source = F.when(F.col("bypass"), "BYPASS").otherwise(F.col("source")) if "bypass" in log.columns else F.col("source")
    us = F.round(F.col("latency_ms") * 1000).cast("decimal(38,0)")  # whole microseconds add up exactly in any order
    computed, remote = source == "MISS", source == "L2"
    counts = [
        F.count_if(source == "L1").alias("l1_hits"), F.count_if(source.isin("L2", "MISS")).alias("l1_misses"),
        F.count_if(remote).alias("l2_hits"), F.count_if(computed).alias("l2_misses"),
        F.count_if(computed).alias("computes"), F.count_if(source == "BYPASS").alias("bypassed"),
        F.sum(F.when(computed, us)).alias("compute_us"), F.sum(F.when(remote, us)).alias("remote_us"),
    ]
    n = {c: F.col(c) for c in ("l1_hits", "l1_misses", "l2_hits", "l2_misses", "computes", "bypassed")}
    total = n["l1_hits"] + n["l2_hits"] + n["computes"] + n["bypassed"]
    report = [
        *n.values(), total.alias("total_requests"),
        _ratio(n["l1_hits"], n["l1_hits"] + n["l1_misses"]).alias("l1_hit_ratio"),
        _ratio(n["l2_hits"], n["l2_hits"] + n["l2_misses"]).alias("l2_hit_ratio"),
        _ratio(n["l1_hits"] + n["l2_hits"], total).alias("overall_hit_ratio"),
        _mean_ms("compute_us", "computes").alias("compute_avg_ms"), _seconds("compute_us").alias("compute_total_s"),
        _mean_ms("remote_us", "l2_hits").alias("remote_avg_ms"), _seconds("remote_us").alias("remote_total_s"),
    ]
    return counts, report


def request_metrics(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hit counts, hit ratios and mean latencies, overall or per group."""
    counts, report = _counters(log)
    by = by or []
    return log.groupBy(*by).agg(*counts).select(*by, *report)


def request_metrics_windowed(log: DataFrame, width: str = "6 hours", lateness: str = "10 minutes") -> DataFrame:
    """The same metrics per tumbling window of ``ts``, for a table or a stream."""
    counts, report = _counters(log)
    timed = log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width).alias("w")).agg(*counts).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *report)


def open_windows(state: DataFrame) -> DataFrame:
    """The windows of ``request_metrics_windowed`` that a stream still keeps open, from its state (``key``, ``value``).

    Together with the windows it has written they are those of a table of the same log, late rows aside.
    """
    names = [f"{c}:bigint" for c in ("l1_hits", "l1_misses", "l2_hits", "computes", "bypassed")]  # equal counters are kept once
    names += [f"{c}:{t}" for us in ("compute_us", "remote_us") for c, t in ((us, "decimal(38,0)"), (f"{us}_empty", "boolean"))]
    _, report = _counters(state)
    held = state.select("key.*", F.col("value").cast(f"struct<{','.join(names)}>").alias("held"))
    window = F.col(held.columns[0])
    return held.select(window["start"].alias("window_start"), window["end"].alias("window_end"), "held.*").withColumn(
        "l2_misses", F.col("computes")).select(
        "window_start", "window_end", *report)


# fixed values: names of the exposed metrics
METRICS = {
    "l1_hits": "mvt_cache_l1_hits_total",
    "l1_misses": "mvt_cache_l1_misses_total",
    "l2_hits": "mvt_cache_l2_hits_total",
    "l2_misses": "mvt_cache_l2_misses_total",
    "bypassed": "mvt_cache_bypass_total",
    "computes": "mvt_cache_compute_total",
    "compute_total_s": "mvt_cache_compute_duration_seconds",
    "remote_total_s": "mvt_cache_remote_latency_seconds",
    "executions": "mvt_cache_singleflight_total",
    "waiters": "mvt_cache_singleflight_waiters_total",
    "store_bytes": "mvt_cache_l1_size_bytes",
    "store_tiles": "mvt_cache_l1_items",
}
MEANING = {
    "l1_hits": "Requests answered from the first level",
    "l1_misses": "Requests that went past the first level",
    "l2_hits": "Requests answered from the second level",
    "l2_misses": "Requests that went past both levels",
    "bypassed": "Requests that asked for a fresh tile",
    "computes": "Tiles made for requests",
    "compute_total_s": "Seconds spent making tiles",
    "remote_total_s": "Seconds spent on answers of the second level",
    "executions": "Distinct tiles among simultaneous requests",
    "waiters": "Requests that shared the tile of another one",
    "store_bytes": "Bytes of the tiles in store",
    "store_tiles": "Tiles in store",
}
GAUGES = ("store_bytes", "store_tiles")
EXPOSED = [(METRICS[c], MEANING[c], "gauge" if c in GAUGES else "counter", c) for c in METRICS]


def exposition(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``line_no, line``: metric rows as exposition text; groups become labels, columns that are not there are left out."""
    by = by or []
    label = F.lit("")
    if by:
        pairs = [F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in by]
        label = F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))
    entries = []
    for i, (name, text, kind, column) in enumerate(EXPOSED):
        if column not in metrics.columns:
            continue
        value = F.format_string(f"{name}%s %s", label, F.col(column).cast("string"))
        for j, line in enumerate((F.lit(f"# HELP {name} {text}"), F.lit(f"# TYPE {name} {kind}"), value)):
            entries.append(F.struct(F.lit(3 * i + j).alias("line_no"), line.alias("line")))
    return metrics.select(F.inline(F.array(*entries))).distinct()


def latency_percentiles(log: DataFrame, by: list[str], percents: list[float], column: str = "latency_ms"
                        ) -> DataFrame:
    """Nearest-rank percentiles, exact, per group: ``by.., percent, value``. Null and NaN are left out.

    Equal values are counted first. Then a radix selection narrows the values down: sign and exponent, then some bits of
    the fraction at a time. Each round counts the values still in question in a histogram of at most
    ``2 ** DIGIT_BITS`` cells and keeps the cell of the wanted rank; after the last one a single value is left.
    No task orders the values of a group, however many there are or however near to each other.
    """
    value = F.col(column).cast("double")
    freq = (log.filter(value.isNotNull() & ~F.isnan(value)).groupBy(*by, F.when(value == 0, 0.0).otherwise(value).alias("value"))
            .agg(F.count(F.lit(1)).alias("n")))
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # null is a group like others
    values = cut_lineage(freq.select(*by, "value", "n", group.alias("_group"), *_digits(F.col("value"))))
    digits = [c for c in values.columns if c.startswith("_digit")]
    asked = F.explode(F.array(*[F.lit(float(p)) for p in percents]))
    rank = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("percent") / 100.0 * F.col("total")))
    target = (values.groupBy("_group").agg(F.sum("n").alias("total")).withColumn("percent", asked)
              .select("_group", "percent", rank.alias("rank")))
    for i, digit in enumerate(digits):
        found = ["_group", *digits[:i]]
        cells = values.join(target, found).groupBy(*found, "percent", "rank", digit).agg(F.sum("n").alias("cell"))
        upto = F.sum("cell").over(Window.partitionBy("_group", "percent").orderBy(digit))
        target = (cells.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("cell") < F.col("rank")))
                  .select(*found, digit, "percent", (F.col("rank") - F.col("upto") + F.col("cell")).alias("rank")))
    return values.join(target, ["_group", *digits]).select(*by, "percent", "value")


def _digits(value: Column) -> list[Column]:
    """Numbers that order values one after the other: sign and exponent first, then parts of the fraction."""
    size = F.abs(value)
    about = F.floor(F.log2(size))  # may round to the next power of two
    power = F.pow(F.lit(2.0), about)
    exponent = F.when(size < power, about - 1).when(size >= 2.0 * power, about + 1).otherwise(about)
    sign = F.signum(value).cast("bigint")
    fraction = ((size / F.pow(F.lit(2.0), exponent) - 1.0) * 2.0**FRACTION_BITS).cast("bigint")  # exact
    steps = range(FRACTION_BITS - DIGIT_BITS, -DIGIT_BITS, -DIGIT_BITS)
    parts = [F.shiftright(fraction, s) if s > 0 else fraction for s in steps]
    low = F.lit((1 << DIGIT_BITS) - 1).cast("bigint")
    parts = [p if i == 0 else p.bitwiseAND(low) for i, p in enumerate(parts)]
    rest = [F.when(value == 0, 0).otherwise(sign * p) for p in parts]
    return [F.when(value == 0, 0).otherwise(sign * (exponent + 4096)).cast("bigint").alias("_digit0"),
            *[r.cast("bigint").alias(f"_digit{i + 1}") for i, r in enumerate(rest)]]


def request_rate(log: DataFrame, by: list[str]) -> DataFrame:
    """Requests per second between the first and the last request of each group."""
    moment = F.col("ts").cast("timestamp")
    span = F.unix_micros(F.max(moment)) - F.unix_micros(F.min(moment))
    counted = log.groupBy(*by).agg(F.count(F.lit(1)).alias("requests"), span.alias("micros"))
    rate = F.coalesce(F.try_divide(F.col("requests") * 1e6, F.col("micros")), F.lit(0.0))
    return counted.select(*by, "requests", F.round(rate, 6).alias("requests_per_second"))


def coalesce_requests(log: DataFrame, keys: list[str]) -> DataFrame:
    """Duplicate requests served by one execution: per key one execution, the others wait."""
    return log.groupBy(*keys).agg(F.lit(1).cast("bigint").alias("executions"),
                                  (F.count(F.lit(1)) - 1).alias("waiters"))
