"""Map tiles and feature analytics over DataFrames."""

from tilewright.model import GeometryColumn, Layer, LayerError, TileOptions

__all__ = ["GeometryColumn", "Layer", "LayerError", "TileOptions"]
