"""A table of made tiles that requests are answered from and that new tiles are put into."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PLACE = ["store_layer", "store_version", "store_z", "batch"]
TILES = ("tile_key string, layer string, z int, x int, y int, part int, n_parts int, tile binary, n_features bigint, keys array<string>, "
         "store_layer string, store_version string, store_z int, batch string")
COMMITS = "batch string, store_layer string, store_version string"


@dataclass(frozen=True)
class TileStore:
    """Tiles below ``path``, in folders by layer, version, zoom and batch.

    A put writes the folders of its own batch only, replacing what an earlier try of the same batch left, and then marks the batch as
    done. Batches without a mark are not read, so a put that was cut short leaves nothing behind that counts. Where two
    batches hold one key, the smaller batch answers for it.
    """

    path: str

    def put(self, tiles: DataFrame, layer: str, version: str | int, batch: str | None = None) -> str:
        """Store ``tiles`` (a tile table with ``tile_key``) of one dataset version; gives the batch."""
        batch = batch or uuid.uuid4().hex
        placed = tiles.select("*", F.lit(layer).alias("store_layer"), F.lit(str(version)).alias("store_version"),
                              F.col("z").alias("store_z"), F.lit(batch).alias("batch"))
        (placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PLACE)
         .parquet(f"{self.path}/tiles"))
        mark = tiles.sparkSession.createDataFrame([(batch, layer, str(version))], COMMITS)
        mark.coalesce(1).write.mode("append").parquet(f"{self.path}/commits")
        return batch

    def batches(self, spark: SparkSession, layer: str, version: str | int) -> list[str]:
        """Batches of a dataset version that are done, one for each put."""
        if not self._there(spark, "commits"):
            return []
        commits = spark.read.schema(COMMITS).parquet(f"{self.path}/commits")
        rows = commits.where((F.col("store_layer") == layer) & (F.col("store_version") == str(version))).select("batch").distinct()
        return sorted(r.batch for r in rows.collect())

    def lookup(self, asked: DataFrame, layer: str, version: str | int) -> DataFrame:
        """Rows of the tiles that ``asked`` (``tile_key``, ``z``) names and the store has, with their ``batch``.

        Only folders of the version, of the zooms asked for and of batches that are done are read. Keys are matched
        first, without the bytes.
        """
        spark = asked.sparkSession
        done = self.batches(spark, layer, version)
        if not done:
            return spark.createDataFrame([], TILES).drop(*PLACE[:3])
        zooms = [r.z for r in asked.select("z").distinct().collect()]  # no more than there are zooms
        held = (spark.read.schema(TILES).parquet(f"{self.path}/tiles")
                .where((F.col("store_layer") == layer) & (F.col("store_version") == str(version))
                       & F.col("store_z").isin(zooms) & F.col("batch").isin(done)).drop(*PLACE[:2]))
        which = (held.where("part = 0").join(asked.select("tile_key").distinct(), "tile_key", "left_semi")
                 .groupBy("tile_key", "store_z").agg(F.min("batch").alias("batch")))
        return held.join(which, ["tile_key", "store_z", "batch"], "left_semi").drop("store_z")

    def drop_outdated(self, spark: SparkSession, layer: str, version: str | int) -> list[str]:
        """Delete the tiles of all other versions of a layer; gives those versions.

        Marks of deleted batches stay. They name nothing any more, and a version that comes back is made anew.
        """
        if not self._there(spark, "tiles"):
            return []
        files, folder = self._files(spark, f"tiles/store_layer={layer}")
        if not files.exists(folder):
            return []
        names = [status.getPath() for status in files.listStatus(folder)]  # a folder for each version
        old = [path for path in names if path.getName() != f"store_version={version}"]
        for path in old:
            files.delete(path, True)
        return sorted(path.getName().split("=", 1)[1] for path in old)

    def _files(self, spark: SparkSession, name: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def _there(self, spark: SparkSession, name: str) -> bool:
        files, place = self._files(spark, name)
        return files.exists(place)
