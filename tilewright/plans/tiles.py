"""Tile jobs: whole pyramids, requested tiles, several layers in one tile, diagnosis.

A tile table has the columns ``layer, z, x, y, part, n_parts, tile, n_features, keys``.
A layer of a tile opens with its name, keys and extent and goes on with blocks of features and their values. What a
block holds depends on the features alone: a tile of up to ``BLOCK_BYTES`` is one block, a larger one is dealt
into blocks by a hash of the features. ``TileOptions.part_bytes`` only says how many blocks share a row, so the bytes
of a tile, the concatenation of its rows in ``part`` order, are the same for any part size, and so is its ETag. No task
ever holds a large tile whole. ``keys`` repeats the attribute names on later parts, so each part can be read alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions import tilemath as tm
from tilewright.model import GeometryColumn, Layer, LayerError, TileOptions
from tilewright.operators import mvt
from tilewright.operators.checkpoints import cut_lineage, drop_stored, stored
from tilewright.operators.cover import WIDE_COVER, cover, in_world, requested, tile_range, visible, widest_cover
from tilewright.operators.descent import tile_shapes
from tilewright.operators.filters import filter_layer, predicate_column
from tilewright.operators.geometry import geometry_code, point_steps, shape_commands
from tilewright.operators.publish import tile_keys
from tilewright.sources.scan import use_all_cores
from tilewright.sources.store import TileStore

TILE = ["z", "x", "y"]
TILE_TABLE = ["layer", *TILE, "part", "n_parts", "tile", "n_features", "keys"]
SEARCH_ZOOMS = 4  # zooms looked at together in the search for large tiles
LARGE_ROWS = 20_000  # large tiles whose addresses may be sent to every executor
SENT_CELLS = 1 << 18  # cells above requested tiles that may be sent to every executor: some 30 MB
SENT_BLOCKS = 1 << 18  # blocks whose numbers may be sent to every executor: some 30 MB
RUN_BLOCKS = 16384  # blocks made together: the shuffle of their features takes some 5 GB
WHOLE = -1  # bucket of a tile that is not large
NUMBER_BLOCK = 4096  # buckets counted together when parts are numbered
FEATURE_COST = 24  # bytes of a feature beside its attributes and vertices
BLOCK_BYTES = 512 << 10  # a tile expected to be larger is written in blocks of about this size


def property_names(layer: Layer, wanted: tuple[str, ...] | None) -> list[str]:
    """Known names out of the wanted ones; all fields when nothing is asked for."""
    fields = layer.fields
    if not wanted:
        return list(fields)
    return [p for p in dict.fromkeys(wanted) if p in fields]


def attribute_names(layer: Layer, options: TileOptions) -> list[str]:
    """Id column first, then the properties, each once."""
    names = property_names(layer, options.properties)
    if options.id_column is None:
        return names
    if options.id_column not in layer.fields:
        raise LayerError(f"{layer.id} has no column {options.id_column!r}")
    return [options.id_column, *[n for n in names if n != options.id_column]]


def layer_names(layer: Layer, options: TileOptions) -> dict[str, str]:
    """Name in the tile of each selected geometry column."""
    chosen = [layer.geometry(options.geometry)] if options.geometry else list(layer.geometries)
    if options.layer_name:
        return {g.name: f"{options.layer_name}_{g.name}" if len(chosen) > 1 else options.layer_name for g in chosen}
    return {g.name: f"{layer.name}_{g.name}" if len(layer.geometries) > 1 else layer.name for g in chosen}


def tile_value(column: Column, dtype: T.DataType) -> Column:
    """Numbers, booleans and text keep their type in a tile, all else becomes text."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return column.cast("bigint")
    if isinstance(dtype, (T.BooleanType, T.FloatType, T.DoubleType, T.StringType)):
        return column
    if isinstance(dtype, T.BinaryType):
        return F.concat(F.lit("\\x"), F.lower(F.hex(column)))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(column)
    return column.cast("string")


@dataclass(frozen=True)
class _Features:
    """Features ready for tiling: attributes ``p0..pn``, geometry and its box."""

    frame: DataFrame
    geometry: GeometryColumn
    names: list[str]
    options: TileOptions

    @property
    def props(self) -> list[str]:
        return [f"p{i}" for i in range(len(self.names))]

    @property
    def shape(self) -> list[str]:
        return [] if self.geometry.is_point else [self.geometry.name]

    def weight(self) -> Column:
        """Bytes this feature may take in a tile."""
        cost = F.lit(FEATURE_COST + 10 * len(self.props)).cast("bigint")
        for p in self.props:
            if isinstance(self.frame.schema[p].dataType, T.StringType):
                cost = cost + F.coalesce(F.octet_length(p), F.lit(0))
        for g in self.shape:
            cost = cost + 4 * F.size(F.flatten(F.flatten(F.col(g)["parts"])))
        return cost


def _features(layer: Layer, options: TileOptions) -> _Features:
    g = layer.geometry(options.geometry)
    layer = filter_layer(layer, options.where)
    names = attribute_names(layer, options)
    fields = layer.fields
    cols = [tile_value(F.col(f"`{n}`"), fields[n]).alias(f"p{i}") for i, n in enumerate(names)]
    shape = [] if g.is_point else [F.col(g.name)]
    frame = layer.frame.filter(in_world(g)).select(*cols, *shape, *g.box_columns)
    return _Features(frame, g, names, options)


@dataclass(frozen=True)
class _Large:
    """Tiles of several blocks: ``z, x, y, buckets``."""

    tiles: DataFrame
    zooms: list[int]
    small: bool  # few enough to broadcast
    blocks: dict[int, int] = field(default_factory=dict)  # of each zoom

    @property
    def few_blocks(self) -> bool:
        """Whether the numbers of all blocks may be broadcast."""
        return sum(self.blocks.values()) <= SENT_BLOCKS

    def runs(self) -> Iterator[tuple[_Large, int]]:
        """Neighbouring zooms whose blocks are made together, and in how many slices."""
        at = 0
        while at < len(self.zooms):
            until, blocks = at + 1, self.blocks[self.zooms[at]]
            while until < len(self.zooms) and blocks + self.blocks[self.zooms[until]] <= RUN_BLOCKS:
                blocks += self.blocks[self.zooms[until]]
                until += 1
            zooms = self.zooms[at:until]
            yield (replace(self, tiles=self.tiles.filter(F.col("z").isin(zooms)), zooms=zooms, blocks={z: self.blocks[z] for z in zooms}),
                   max(1, -(-blocks // RUN_BLOCKS)))
            at = until

    def join(self, rows: DataFrame, how: str) -> DataFrame:
        tiles = self.tiles if how == "inner" else self.tiles.select(TILE)  # semi and anti need no counts
        return rows.join(F.broadcast(tiles) if self.small else tiles, TILE, how)


def _placed(frame: DataFrame, f: _Features, zooms: list[int], wide: bool, requests: DataFrame | None,
            every: bool = False) -> DataFrame:
    """Features per tile: in all tiles they touch, or in the requested ones only."""
    if requests is None:
        return cover(frame, f.geometry, zooms, f.options.extent, wide, every)
    return requested(frame, f.geometry, requests, zooms, f.options.extent, every)


def _large_tiles(f: _Features, zooms: list[int], wide: bool, requests: DataFrame | None = None) -> _Large | None:
    """Find large tiles from boxes and sizes alone, before any geometry is encoded.

    A tile holds no more than the tile above it, so the search stops at the
    first zoom without a large tile; requested tiles are all looked at.
    """
    g, limit = f.geometry, BLOCK_BYTES
    weighed = use_all_cores(f.frame.select(*g.box_columns, f.weight().alias("weight")))

    def over(levels: list[int]) -> DataFrame:
        rows = _placed(weighed, f, levels, wide, requests, every=True)
        seen = F.when(visible(g, F.col("z"), f.options.extent), F.col("weight"))
        total = rows.groupBy(TILE).agg(F.sum("weight").alias("bytes"), F.sum(seen).alias("seen_bytes"))
        return total.filter(F.col("bytes") > limit)

    def buckets(tiles: DataFrame) -> DataFrame:
        return tiles.filter(F.col("seen_bytes") > limit).select(
            *TILE, F.ceil(F.col("seen_bytes") / limit).alias("buckets"))

    found = []
    together = SEARCH_ZOOMS if requests is None else len(zooms)
    for at in range(0, len(zooms), together):
        levels = zooms[at:at + together]
        rows = over(levels).limit(LARGE_ROWS + 1).collect()  # four numbers per large tile
        found += rows
        if len(found) > LARGE_ROWS:
            tiles = cut_lineage(buckets(over(zooms)))
            blocks = {r["z"]: r["blocks"] for r in tiles.groupBy("z").agg(F.sum("buckets").alias("blocks")).collect()}
            return _Large(tiles, sorted(blocks), False, blocks) if blocks else None
        if not any(r["z"] == levels[-1] for r in rows):
            break
    found = [r for r in found if r["seen_bytes"] and r["seen_bytes"] > limit]
    if not found:
        return None
    tiles = f.frame.sparkSession.createDataFrame(found, "z int, x int, y int, bytes bigint, seen_bytes bigint")
    blocks: dict[int, int] = {}
    for r in found:
        blocks[r["z"]] = blocks.get(r["z"], 0) - -r["seen_bytes"] // limit
    return _Large(buckets(tiles), sorted(blocks), True, blocks)


def _drawn(f: _Features) -> tuple[list[Column], Column]:
    """Columns of the tile geometry and whether anything is left of it."""
    g, o = f.geometry, f.options
    margin = o.buffer if o.clip else None
    z, x, y = (F.col(c) for c in TILE)
    if g.is_point:
        step_x, step_y, inside = point_steps(F.col(g.box("u0")), F.col(g.box("v0")), z, x, y, o.extent, margin)
        return [step_x.alias("step_x"), step_y.alias("step_y")], inside
    cmds = shape_commands(F.col(g.name)["parts"], g.srid, geometry_code(g.kind), z, x, y, o.extent, margin)
    return [cmds.alias("cmds")], F.col("cmds").isNotNull()


def _wide(f: _Features, zooms: list[int]) -> bool:
    deepest = max(zooms)
    return 4**deepest > WIDE_COVER and widest_cover(f.frame, f.geometry, deepest) > WIDE_COVER


def _encoded(rows: DataFrame, f: _Features, keep: list[str]) -> DataFrame:
    """Features per tile with their tile geometry, narrowed to what the encoder needs."""
    shape, left = _drawn(f)
    number = _tile_number()
    if f.geometry.is_point:
        return rows.filter(left).select(number, *keep, *f.props, *shape)
    return rows.select(number, *keep, *f.props, *shape).filter(left)


def _small_rows(f: _Features, zooms: list[int], wide: bool, large: _Large | None,
                requests: DataFrame | None = None) -> DataFrame:
    down = _goes_down(f, requests)
    frame = use_all_cores(f.frame)
    if large is not None and f.geometry.is_point and requests is None:
        frame = _seldom_met(frame, f, max(zooms), large)
    rows = _shapes(frame, f, zooms, wide, f.props) if down else _placed(frame, f, zooms, wide, requests)
    if large is not None:  # never where features go down
        rows = large.join(rows, "left_anti")
    return rows.select(_tile_number(), *f.props, "cmds") if down else _encoded(rows, f, [])


def _seldom_met(frame: DataFrame, f: _Features, deepest: int, large: _Large) -> DataFrame:
    """Points without those that only large tiles hold: where the one deepest tile of a point is large, all above it are."""
    if deepest not in large.zooms:
        return frame
    tiles = large.tiles.filter(F.col("z") == deepest).select(F.col("x").alias("_x"), F.col("y").alias("_y"))
    x0, x1, y0, y1 = tile_range(f.geometry, F.lit(deepest))
    met = (x0 == F.col("_x")) & (y0 == F.col("_y")) & (x0 == x1) & (y0 == y1)  # on an edge it has several
    return frame.join(F.broadcast(tiles) if large.small else tiles, met, "left_anti")


def _goes_down(f: _Features, requests: DataFrame | None) -> bool:
    """Whole pyramids of clipped lines and areas are cut zoom by zoom."""
    return requests is None and not f.geometry.is_point and f.options.clip


def _shapes(frame: DataFrame, f: _Features, zooms: list[int], wide: bool, keep: list[str]) -> DataFrame:
    return tile_shapes(frame, f.geometry, zooms, f.options.extent, f.options.buffer, keep, wide)


def _tile_number() -> Column:
    return tm.tile_number(*[F.col(c) for c in TILE]).alias("tile_no")


def _large_rows(f: _Features, spread: DataFrame, wide: bool, large: _Large, requests: DataFrame | None = None, slices: int = 1) -> list[DataFrame]:
    """Features of large tiles, spread over buckets by a hash of their content, in slices of whole rows of the tile table."""
    bucket = F.pmod("spread", "buckets").cast("bigint").alias("bucket")
    rows = large.join(_placed(spread, f, large.zooms, wide, requests), "inner").select("*", bucket)
    if slices == 1:
        return [_encoded(rows, f, ["bucket", "copies"])]
    place = F.pmod(F.xxhash64(*TILE, _together(f)), F.lit(slices))
    return [_encoded(rows.filter(place == i), f, ["bucket", "copies"]) for i in range(slices)]


def _together(f: _Features) -> Column:
    """What the buckets have in common that share a row of the tile table, as long as no bucket is empty."""
    return F.floor(F.col("bucket") / _blocks_of_row(f))


def _blocks_of_row(f: _Features) -> int:
    return max(1, f.options.part_bytes // BLOCK_BYTES)


def _shape_rows(f: _Features, zooms: list[int], wide: bool, large: _Large) -> DataFrame:
    """Features of large and other tiles, going down the zooms once; ``bucket`` is -1 where a tile is not large."""
    rows = _shapes(_spread(f), f, zooms, wide, [*f.props, "copies", "spread"])
    tiles = F.broadcast(large.tiles) if large.small else large.tiles
    bucket = F.coalesce(F.pmod("spread", "buckets").cast("bigint"), F.lit(WHOLE)).alias("bucket")
    return rows.join(tiles, TILE, "left").select(_tile_number(), bucket, "copies", *f.props, "cmds")


def _spread(f: _Features, keep: bool = False) -> DataFrame:
    """Features with ``copies`` and a hash ``spread`` of their content: identical rows would share a bucket, so they are
    counted first and their counts are spread. Counts that are read more than once are kept."""
    counted = use_all_cores(f.frame).groupBy(f.frame.columns).agg(F.count(F.lit(1)).alias("copies"))
    if keep:
        names = counted.columns
        counted = stored(counted.toDF(*[f"c{i}" for i in range(len(names))]), "features").toDF(*names)
    return _split_copies(counted, f).withColumn("spread", F.xxhash64(*f.props, *f.shape, *f.geometry.box_columns, "chunk"))


def _split_copies(frame: DataFrame, f: _Features) -> DataFrame:
    """At most one block's worth of copies per row, so copies spread over buckets too."""
    per_row = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(BLOCK_BYTES) / f.weight()))
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("copies") - 1) / per_row))
    return (frame.withColumn("chunk", F.explode(chunks))
            .withColumn("copies", F.least(per_row, F.col("copies") - F.col("chunk") * per_row)))


def _sorted_by_tile(rows: DataFrame, together: Column | None = None) -> DataFrame:
    """Rows of a tile (or bucket) together, in an order that depends on their content only. Buckets that agree in ``together``
    follow each other in one task."""
    keys = [k for k in mvt.KEYS if k in rows.columns]
    rest = [c for c in rows.columns if c not in keys]
    if "copies" in rest:  # in a tile that is not large copies count as rows, so their number comes last
        rest = [F.when(F.col("bucket") != WHOLE, F.col("copies")), *[c for c in rest if c != "copies"], "copies"]
    dealt = keys if together is None else ["tile_no", together]
    return rows.repartition(*dealt).sortWithinPartitions(*keys, *rest)


def _schema(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{n} {t}" for n, t in fields)


def _encode(rows: DataFrame, f: _Features, name: str) -> DataFrame:
    names, extent, code = f.names, f.options.extent, geometry_code(f.geometry.kind)
    alias = dict(zip(f.props, names))

    def run(batches):
        for table in mvt.whole_groups(batches):
            yield mvt.encode_tiles(table.rename_columns([alias.get(c, c) for c in table.column_names]),
                                   name, names, extent, code)

    tiles = _sorted_by_tile(rows).mapInArrow(run, _schema([*mvt.TILE_FIELDS, ("tile", "binary")]))
    return _whole_tiles(tiles, name)


def _whole_tiles(tiles: DataFrame, name: str) -> DataFrame:
    return tiles.select(F.lit(name).alias("layer"), *TILE, F.lit(0).alias("part"), F.lit(1).alias("n_parts"),
                        "tile", "n_features", _no_keys())


def _no_keys() -> Column:
    return F.lit(None).cast("array<string>").alias("keys")


def _encode_large(slices: list[DataFrame], f: _Features, name: str, few: bool, mixed: bool = False) -> DataFrame:
    """Large tiles as parts: encode buckets as blocks, number their values, join blocks to parts, add the opening part.
    ``mixed`` rows hold other tiles too, each in one bucket.

    Slices are made one after the other, and the shuffle of each is dropped before the next. The numbers of ``few`` blocks are sent
    to the blocks, which then stay where they are and are joined there: those of a part lie side by side, unless a bucket is empty.
    """
    sent = F.broadcast if few else (lambda frame: frame)
    names, extent, code = f.names, f.options.extent, geometry_code(f.geometry.kind)
    alias = dict(zip(f.props, names))

    def run(batches):
        for table in mvt.whole_groups(batches):
            table = table.rename_columns([alias.get(c, c) for c in table.column_names])
            large = pc.not_equal(table.column("bucket"), WHOLE)
            rows = table.filter(large)
            if rows.num_rows:
                batch = mvt.encode_parts(rows, names, code)
                yield batch.append_column("tile", pa.nulls(batch.num_rows, pa.binary())) if mixed else batch
            rows = table.filter(pc.invert(large))
            if rows.num_rows:
                batch = mvt.encode_tiles(rows, name, names, extent, code)
                left = {c: pa.nulls(batch.num_rows, pa.int64() if kind == "bigint" else pa.binary()) for c, kind in mvt.PART_FIELDS
                        if c not in batch.schema.names}
                left["bucket"] = pa.array([WHOLE] * batch.num_rows, pa.int64())
                columns = {**dict(zip(batch.schema.names, batch.columns)), **left}
                yield pa.RecordBatch.from_pydict({c: columns[c] for c, _ in [*mvt.PART_FIELDS, ("tile", "binary")]})

    tile = [("tile", "binary")] if mixed else []
    together = _blocks_of_row(f)
    every = None
    for rows in slices:
        made = cut_lineage(_sorted_by_tile(rows, _together(f)).mapInArrow(run, _schema([*mvt.PART_FIELDS, *tile])))
        every = made if every is None else every.unionByName(made)
    parts = every.filter(F.col("bucket") != WHOLE).drop("tile")
    row = (F.floor((F.col("part") - 1) / together) + 1).cast("int")
    numbers = cut_lineage(_number_parts(parts.select(*TILE, "bucket", "n_values")).withColumn("row", row))

    def finish(batches):
        for batch in batches:
            yield from mvt.finish_parts(batch, [*TILE, "part", "n_features"])

    def join(batches):
        return mvt.join_parts(batches, [*TILE, "row"])

    def finished(numbers, run, place):
        return parts.join(sent(numbers), [*TILE, "bucket"]).mapInArrow(
            run, f"z int, x int, y int, {place} int, n_features bigint, tile binary")

    def gathered(numbers):
        """Blocks of a part that do not lie side by side."""
        joined = finished(numbers, finish, "part").groupBy(*TILE, row.alias("row")).agg(
            F.array_sort(F.collect_list(F.struct("part", "tile"))).alias("blocks"), F.sum("n_features").alias("n_features"))
        return joined.select(*TILE, "row", "n_features", F.aggregate(
            "blocks", F.lit(b""), lambda all_, block: F.concat(all_, block["tile"])).alias("tile"))

    if not few and together > 1:
        body = gathered(numbers)
    else:
        ends = [at(_together(f)).alias(n) for n, at in (("low", F.min), ("high", F.max))]
        apart = numbers.groupBy(*TILE, "row").agg(*ends).filter("low < high").select(*TILE, "row")
        if apart.isEmpty():
            body = finished(numbers, join, "row")
        else:
            body = finished(numbers.join(sent(apart), [*TILE, "row"], "left_anti"), join, "row").unionByName(
                gathered(numbers.join(sent(apart), [*TILE, "row"], "left_semi")))
    body = body.withColumnRenamed("row", "part")

    def measure(batches):
        for batch in batches:
            sizes = [mvt.finished_size(batch.slice(i, 1).to_pylist()[0]) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.select(TILE).columns, pa.array(sizes, pa.int64())], names=[*TILE, "bytes"])

    # Lengths and counts are taken from the parts as they wait, so that each block is finished once.
    sizes = parts.join(sent(numbers), [*TILE, "bucket"]).select(*TILE, *mvt.SIZE_FIELDS).mapInArrow(
        measure, "z int, x int, y int, bytes bigint").groupBy(TILE).agg(F.sum("bytes").alias("bytes"))
    bodies = F.floor((F.max("part") - 1) / together).cast("int") + 1
    counts = numbers.groupBy(TILE).agg((bodies + 1).alias("n_parts"))
    head, keys, tail = mvt.layer_fields(name, names, extent)
    fixed = head + keys + tail

    @F.arrow_udf("binary")
    def opening(size: pa.Array) -> pa.Array:
        return mvt.opening(size, fixed)

    first = sizes.join(sent(counts), TILE).select(
        *TILE, F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("n_features"), opening("bytes").alias("tile"), "n_parts", _no_keys())
    rest = body.join(sent(counts), TILE).withColumn(
        "keys", F.array(*[F.lit(n) for n in names]).cast("array<string>"))
    out = first.unionByName(rest).withColumn("layer", F.lit(name)).select(TILE_TABLE)
    if not mixed:
        return out
    small = every.filter(F.col("bucket") == WHOLE)
    return _whole_tiles(small, name).unionByName(out)


def _number_parts(parts: DataFrame) -> DataFrame:
    """Part number and first value number of each bucket, counted on within its tile.

    The count runs over blocks of buckets first and within blocks after, so that
    no task orders all buckets of one tile.
    """
    block = F.floor(F.col("bucket") / NUMBER_BLOCK)
    parts = parts.withColumn("block", block)
    before = Window.partitionBy(TILE).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("bigint")
    blocks = parts.groupBy(*TILE, "block").agg(F.count(F.lit(1)).alias("n"), F.sum("n_values").alias("v")).select(
        *TILE, "block", F.coalesce(F.sum("n").over(before), none).alias("parts_before"),
        F.coalesce(F.sum("v").over(before), none).alias("values_before"))
    within = Window.partitionBy(*TILE, "block").orderBy("bucket")
    values = F.coalesce(F.sum("n_values").over(within.rowsBetween(Window.unboundedPreceding, -1)), none)
    inside = parts.select(*TILE, "block", "bucket", F.row_number().over(within).alias("nth"), values.alias("values"))
    return inside.join(blocks, [*TILE, "block"]).select(
        *TILE, "bucket", (F.col("parts_before") + F.col("nth")).cast("int").alias("part"),
        (F.col("values_before") + F.col("values")).alias("value_base"))


def _tiles(f: _Features, name: str, zooms: list[int], requests: DataFrame | None = None
           ) -> tuple[DataFrame, _Large | None]:
    wide = requests is None and _wide(f, zooms)
    large = _large_tiles(f, zooms, wide, requests)
    if large is not None and _goes_down(f, requests):
        return _encode_large([_shape_rows(f, zooms, wide, large)], f, name, large.few_blocks, mixed=True), large
    tiles = _encode(_small_rows(f, zooms, wide, large, requests), f, name)
    if large is not None:
        runs = [(large, 1)] if requests is not None else list(large.runs())
        keep = sum(slices for _, slices in runs) > 1
        spread = _spread(f, keep)
        for some, slices in runs:
            rows = _large_rows(f, spread, wide, some, requests, slices)
            tiles = tiles.unionByName(_encode_large(rows, f, name, some.few_blocks))
        if keep:  # all blocks are made
            drop_stored(spread)
    return tiles, large


def _zooms(zmin: int, zmax: int) -> list[int]:
    if not 0 <= zmin <= zmax <= tm.MAX_ZOOM:
        raise LayerError(f"zooms must satisfy 0 <= zmin <= zmax <= {tm.MAX_ZOOM}")
    return list(range(zmin, zmax + 1))


def tile_pyramid(layer: Layer, zmin: int, zmax: int, options: TileOptions = TileOptions()) -> DataFrame:
    """All non-empty tiles of the selected geometry columns, one layer per geometry column."""
    zooms = _zooms(zmin, zmax)
    out = None
    for geometry, name in layer_names(layer, options).items():
        tiles, _ = _tiles(_features(layer, replace(options, geometry=geometry)), name, zooms)
        out = tiles if out is None else out.unionByName(tiles)
    return out


def checked_requests(requests: DataFrame) -> DataFrame:
    """Valid, distinct tile addresses out of a table with ``z, x, y``."""
    z, x, y = (F.col(c) for c in TILE)
    good = requests.filter(tm.address_problem(z, x, y).isNull())
    return good.select(*[F.col(c).cast("int").alias(c) for c in TILE]).distinct()


def _requested_ranges(wanted: DataFrame) -> list:
    """Per requested zoom the range of columns and rows, and the number of tiles: at most 31 rows."""
    bounds = [f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]
    return sorted(wanted.groupBy("z").agg(*bounds, F.count(F.lit(1)).alias("tiles")).collect(), key=lambda r: r["z"])


def _sent(wanted: DataFrame, ranges: list) -> DataFrame:
    """Requests to be met by features; few of them go to the features, so that no feature is shuffled for each zoom."""
    cells = sum((r["z"] + 1) * r["tiles"] for r in ranges)
    return F.broadcast(wanted) if cells <= SENT_CELLS else wanted


def _near(g: GeometryColumn, ranges: list) -> Column:
    """One box around all requested tiles, made of constants so that it reaches the scan."""
    if not ranges:
        return F.lit(False)
    west = min(r["min_x"] / 2.0 ** r["z"] for r in ranges)
    north = min(r["min_y"] / 2.0 ** r["z"] for r in ranges)
    east = max((r["max_x"] + 1) / 2.0 ** r["z"] for r in ranges)
    south = max((r["max_y"] + 1) / 2.0 ** r["z"] for r in ranges)
    if (west, north, east, south) == (0.0, 0.0, 1.0, 1.0):
        return F.lit(True)
    u0, v0, u1, v1 = (F.col(n) for n in g.box_names)
    return (u1 >= west) & (u0 <= east) & (v1 >= north) & (v0 <= south)


def tiles_for(layer: Layer, requests: DataFrame, options: TileOptions = TileOptions()) -> DataFrame:
    """The requested tiles of all selected geometry columns; a tile without features is empty bytes."""
    wanted = cut_lineage(checked_requests(requests))
    ranges = _requested_ranges(wanted)
    zooms = [r["z"] for r in ranges]
    names = layer_names(layer, options)
    whole = layer.name if len(names) > 1 else next(iter(names.values()))
    layers = []
    for geometry, name in names.items():
        if zooms:
            near = layer.with_frame(layer.frame.filter(_near(layer.geometry(geometry), ranges)))
            layers.append(_tiles(_features(near, replace(options, geometry=geometry)), name, zooms, _sent(wanted, ranges)))
    if not layers:
        return wanted.select(F.lit(whole).alias("layer"), *TILE, F.lit(0).alias("part"), F.lit(1).alias("n_parts"),
                             F.lit(b"").alias("tile"), F.lit(0).cast("bigint").alias("n_features"), _no_keys())
    made = layers[0][0] if len(layers) == 1 else _merge(layers, whole)
    return wanted.join(made, TILE, "left").select(
        F.coalesce("layer", F.lit(whole)).alias("layer"), *TILE,
        F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("n_parts", F.lit(1)).alias("n_parts"),
        F.coalesce("tile", F.lit(b"")).alias("tile"),
        F.coalesce("n_features", F.lit(0).cast("bigint")).alias("n_features"), "keys")


def _merge(layers: list[tuple[DataFrame, _Large | None]], name: str) -> DataFrame:
    """Several layers in one tile: their bytes one after the other, in the given order.

    A layer of a tile that is not large is at most one part, so their
    concatenation is bounded. A tile with a large layer keeps its rows, numbered
    through over all layers; ``layer`` then names the layer each row belongs to.
    """
    rows = None
    for i, (tiles, _) in enumerate(layers):
        one = tiles.filter(F.octet_length("tile") > 0).withColumn("ordinal", F.lit(i))
        rows = one if rows is None else rows.unionByName(one)
    found = [large for _, large in layers if large is not None]
    small = rows
    for large in found:
        small = large.join(small, "left_anti")
    entry = F.struct("ordinal", "tile", "n_features")
    merged = small.groupBy(TILE).agg(F.array_sort(F.collect_list(entry)).alias("e")).select(
        F.lit(name).alias("layer"), *TILE, F.lit(0).alias("part"), F.lit(1).alias("n_parts"),
        F.aggregate("e", F.lit(b""), lambda acc, r: F.concat(acc, r["tile"])).alias("tile"),
        F.aggregate("e", F.lit(0).cast("bigint"), lambda acc, r: acc + r["n_features"]).alias("n_features"), _no_keys())
    if not found:
        return merged
    which = found[0].tiles.select(TILE)
    for large in found[1:]:
        which = which.union(large.tiles.select(TILE))
    kept = replace(found[0], tiles=which.distinct(), small=all(large.small for large in found)).join(rows, "left_semi")
    sizes = kept.groupBy(*TILE, "ordinal").agg(F.max("n_parts").alias("own"))  # a row per layer of a tile
    before = Window.partitionBy(TILE).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    places = sizes.select(*TILE, "ordinal", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("before"),
                          F.sum("own").over(Window.partitionBy(TILE)).alias("total"))
    parts = kept.join(places, [*TILE, "ordinal"]).select(
        "layer", *TILE, (F.col("before") + F.col("part")).cast("int").alias("part"),
        F.col("total").cast("int").alias("n_parts"), "tile", "n_features", "keys")
    return merged.unionByName(parts)


def multilayer_pyramid(layer: Layer, zmin: int, zmax: int, options: TileOptions = TileOptions()) -> DataFrame:
    """A pyramid in which every geometry column is a layer of the same tile."""
    zooms = _zooms(zmin, zmax)
    layers = [_tiles(_features(layer, replace(options, geometry=g)), name, zooms)
              for g, name in layer_names(layer, options).items()]
    return _merge(layers, layer.name)


def diagnose_tiles(layer: Layer, requests: DataFrame, options: TileOptions = TileOptions()) -> DataFrame:
    """Per requested tile: rows in the box, after the filter, with tile geometry, and a verdict."""
    wanted = cut_lineage(checked_requests(requests))
    ranges = _requested_ranges(wanted)
    zooms = [r["z"] for r in ranges]
    g = layer.geometry(options.geometry)
    keep = F.lit(True) if options.where is None else F.coalesce(predicate_column(layer, options.where), F.lit(False))
    shape = [] if g.is_point else [F.col(g.name)]
    frame = layer.frame.filter(in_world(g) & _near(g, ranges)).select(keep.alias("kept"), *shape, *g.box_columns)
    f = _Features(frame, g, [], options)
    near = requested(use_all_cores(frame), g, _sent(wanted, ranges), zooms or [0], options.extent, every=True)
    shape, left = _drawn(f)
    drawn = F.col("kept") & visible(g, F.col("z"), options.extent) & left
    counts = near.select("*", *shape).select(*TILE, "kept", drawn.alias("drawn")).groupBy(TILE).agg(
        F.count(F.lit(1)).alias("in_box"), F.count_if("kept").alias("after_filter"),
        F.count_if("drawn").alias("after_clip"))
    n = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("in_box", "after_filter", "after_clip")}
    verdict = (F.when(n["in_box"] == 0, "no features here").when(n["after_filter"] == 0, "all filtered out")
               .when(n["after_clip"] == 0, "all degenerate or clipped away").otherwise("ok"))
    return wanted.join(counts, TILE, "left").select(*TILE, *[c.alias(k) for k, c in n.items()],
                                                    verdict.alias("verdict"))


def get_or_make(layer: Layer, requests: DataFrame, store: DataFrame, version: str | int = 1,
                options: TileOptions = TileOptions()) -> DataFrame:
    """Requested tiles out of a store where it has them, made where it has not.

    ``store`` is a tile table with ``tile_key``. Every distinct address is made
    once, however often it is asked for. ``source`` tells HIT from MISS.
    """
    asked = _keyed(checked_requests(requests), layer, version, options)
    held = store.select("tile_key").distinct()
    hits = store.join(asked.select("tile_key"), "tile_key", "left_semi").withColumn("source", F.lit("HIT"))
    missing = asked.join(held, "tile_key", "left_anti")
    made = _keyed(tiles_for(layer, missing.select(TILE), options), layer, version, options)
    columns = ["tile_key", *TILE_TABLE, "source"]
    return hits.select(columns).unionByName(made.withColumn("source", F.lit("MISS")).select(columns))


def get_or_store(layer: Layer, requests: DataFrame, store: TileStore, version: str | int = 1,
                 options: TileOptions = TileOptions()) -> DataFrame:
    """Requested tiles out of a store that keeps what it has to make.

    Tiles that the store lacks, empty ones included, are made and put into it when this is called; all
    are then read from it. ``source`` is MISS for those made now, HIT for the others.
    """
    asked = cut_lineage(_keyed(checked_requests(requests), layer, version, options))
    held = store.lookup(asked, layer.id, version).where("part = 0").select("tile_key")
    missing = cut_lineage(asked.join(held, "tile_key", "left_anti"))
    batch = None
    if not missing.isEmpty():
        made = _keyed(tiles_for(layer, missing.select(TILE), options), layer, version, options)
        batch = store.put(made.select("tile_key", *TILE_TABLE), layer.id, version)
    source = F.when(F.col("batch") == F.lit(batch), "MISS").otherwise("HIT")
    return store.lookup(asked, layer.id, version).withColumn("source", source).select("tile_key", *TILE_TABLE, "source")


def _keyed(frame: DataFrame, layer: Layer, version: str | int, options: TileOptions) -> DataFrame:
    """Add the tile key of a layer, a dataset version and the options that differ from the defaults."""
    default = TileOptions()
    wanted = {"buffer": options.buffer, "clip": options.clip, "extent": options.extent}
    columns = {k: F.lit(v) for k, v in wanted.items() if v != getattr(default, k)}
    if options.geometry:
        columns["geom"] = F.lit(options.geometry)
    if options.properties:
        columns["properties"] = F.array(*[F.lit(p) for p in options.properties])
    if options.id_column:  # it changes the bytes, so it belongs to the parameters
        ordered = attribute_names(layer, options)
        columns["properties"] = F.lit(",".join(["id=" + ordered[0], *ordered[1:]]))
    if options.layer_name:
        columns["layer_name"] = F.lit(options.layer_name)
    if options.where is not None:
        columns["where"] = F.lit(json.dumps(options.where, default=str))
    named = frame.select("*", F.lit(layer.id).alias("catalog_id"), F.lit(str(version)).alias("version"),
                         *[c.alias(f"{k}") for k, c in columns.items()])
    return tile_keys(named).drop("catalog_id", "version", *columns)
