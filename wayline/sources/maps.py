"""Road maps of an area: boxes, the query text, and a cache that is fetched once and says where it is from.

Nothing here reaches the network by itself: a fetcher is a function from a
request to bytes, which the caller gives.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]

#: The kinds of ways, and the least and greatest side of a box in degrees.
HIGHWAYS = "motorway trunk primary secondary tertiary unclassified residential service living_street road motorway_link trunk_link primary_link secondary_link tertiary_link"
LEAST_SIDE, MOST_SIDE = 0.005, 0.6


def box_fault(south: Column, west: Column, north: Column, east: Column, large: bool = False) -> Column:
    """What is wrong with a box in degrees; null for a good one."""
    order_lat, order_lon = (south >= -90) & (south < north) & (north <= 90), (west >= -180) & (west < east) & (east <= 180)
    side = F.least(north - south, east - west) < LEAST_SIDE
    fault = F.when(~F.coalesce(order_lat, F.lit(False)), "latitudes").when(~F.coalesce(order_lon, F.lit(False)), "longitudes").when(side, "too small")
    return fault if large else fault.when(F.greatest(north - south, east - west) > MOST_SIDE, "too large")


def checked_box(box: Box, large: bool = False) -> Box:
    """south, west, north, east; a bad box raises."""
    s, w, n, e = map(float, box)
    if not (-90 <= s < n <= 90 and -180 <= w < e <= 180):
        raise ValueError(f"not south, west, north, east in order: {box}")
    if min(n - s, e - w) < LEAST_SIDE or max(n - s, e - w) > MOST_SIDE and not large:
        raise ValueError(f"a side of {box} is under {LEAST_SIDE} or over {MOST_SIDE} degrees")
    return s, w, n, e


def query_text(box: Box) -> str:
    """The text that asks a map server for the drivable ways of a box and their nodes."""
    area = ",".join(f"{x}" for x in box)
    ways = f'way["highway"~"^({HIGHWAYS.replace(" ", "|")})$"]({area});'
    return f"[out:xml][timeout:300];({ways});(._;>;);out body;"


def box_of_match(match: dict) -> Box:
    """The box of a geocoder's match, which writes south, north, west, east as text."""
    s, n, w, e = map(float, match["boundingbox"])
    return s, w, n, e


def fetched(box: Box, path: Path, fetch: Callable[[str], bytes], source: str, now: str, more: dict | None = None) -> dict:
    """The manifest of a map that is fetched once; a file of another box under the same name is refused."""
    manifest = path.with_suffix(".json")
    if path.exists():
        if not manifest.exists():
            raise ValueError(f"{path} has no manifest")
        known = json.loads(manifest.read_text())
        if tuple(known["box"]) != tuple(box):
            raise ValueError(f"{path} holds the box {known['box']}, not {list(box)}")
        return known
    body = fetch(query_text(checked_box(box)))
    if b"<osm" not in body[:500] or b"<way" not in body:
        raise ValueError("the answer is not a map with ways")
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(body)
    record = {"file": path.name, "bytes": len(body), "sha256": hashlib.sha256(body).hexdigest(), "fetched": now, "source": source, "query": query_text(box), "box": list(box)} | (more or {})
    manifest.write_text(json.dumps(record, indent=1) + "\n")
    return record
