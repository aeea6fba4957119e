"""A plain, slow reader of vector tiles, to check the encoder and the batch decoder against."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tilewright.operators.ragged import read_varints, unzigzag

def read_fields(data: bytes | memoryview) -> Iterator[tuple[int, int, int | memoryview]]:
    """(field number, wire type, value) of one message."""
    view, at, end = memoryview(data), 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = view[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        tag = varint()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, wire, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield tag >> 3, wire, view[at:at + size]
            at += size


def read_value(message: memoryview):
    """One attribute value; ``None`` for an empty message."""
    out = None
    for number, _, body in read_fields(message):
        if number == 1:
            out = bytes(body).decode()
        elif number in (2, 3):
            out = float(np.frombuffer(body, "<f4" if number == 2 else "<f8")[0])
        elif number == 4:
            out = body - (1 << 64) if body >= 1 << 63 else body
        elif number == 5:
            out = body
        elif number == 6:
            out = (body >> 1) ^ -(body & 1)
        elif number == 7:
            out = bool(body)
    return out


def read_layers(tile: bytes, continues: bool = False) -> Iterator[dict]:
    """Layers of a tile, or the fields of the one layer a later part continues."""
    bodies = [tile] if continues else (body for number, _, body in read_fields(tile) if number == 3)
    for body in bodies:
        layer: dict = {"name": None, "version": 1, "extent": 4096, "features": [], "keys": [], "values": []}
        for number, _, value in read_fields(body):
            if number == 1:
                layer["name"] = bytes(value).decode()
            elif number == 2:
                layer["features"].append(value)
            elif number == 3:
                layer["keys"].append(bytes(value).decode())
            elif number == 4:
                layer["values"].append(value)
            elif number == 5:
                layer["extent"] = value
            elif number == 15:
                layer["version"] = value
        yield layer


def read_feature(message: memoryview) -> dict:
    out: dict = {"id": None, "tags": np.empty(0, np.int64), "type": 0, "geometry": np.empty(0, np.int64)}
    for number, _, value in read_fields(message):
        if number == 1:
            out["id"] = value
        elif number == 3:
            out["type"] = value
        elif number in (2, 4):
            words = read_varints(np.frombuffer(value, np.uint8)).astype(np.int64)
            out["tags" if number == 2 else "geometry"] = words
    return out


def read_paths(words: np.ndarray) -> list[list[tuple[int, int]]]:
    """Vertex lists of a feature; a closed ring repeats its first vertex."""
    paths: list[list[tuple[int, int]]] = []
    at = px = py = 0
    while at < len(words):
        command, count = int(words[at]) & 7, int(words[at]) >> 3
        at += 1
        if command == 7:
            paths[-1].append(paths[-1][0])
            continue
        steps = unzigzag(words[at:at + 2 * count])
        at += 2 * count
        for dx, dy in zip(steps[0::2].tolist(), steps[1::2].tolist()):
            px, py = px + dx, py + dy
            if command == 1:
                paths.append([])
            paths[-1].append((px, py))
    return paths
