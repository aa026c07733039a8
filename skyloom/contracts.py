"""Persisted contracts: schemas, request objects, defaults and the path layout."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import types as T

from .functions import cells

LAYOUT_VERSION = 1

#: The canonical star table. Nothing else is stored for a star; working bands are derived at load time.
STAR_SCHEMA = T.StructType(
    [
        T.StructField("gaia_id", T.LongType(), False),
        T.StructField("gaia_ra", T.DoubleType()),
        T.StructField("gaia_dec", T.DoubleType()),
        T.StructField("gaia_G", T.FloatType()),
        T.StructField("gaia_BP", T.FloatType()),
        T.StructField("gaia_RP", T.FloatType()),
        T.StructField("gaia_ref_epoch", T.DoubleType()),
        T.StructField("gaia_pmra", T.DoubleType()),
        T.StructField("gaia_pmdec", T.DoubleType()),
        T.StructField("gaia_non_single_star", T.ShortType()),
        T.StructField("gaia_ruwe", T.FloatType()),
    ]
)
STAR_COLUMNS = tuple(f.name for f in STAR_SCHEMA)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("pass_id", T.StringType(), False),
        T.StructField("algorithm", T.StringType(), False),
        T.StructField("algorithm_version", T.StringType(), False),
        T.StructField("config", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("release", T.StringType(), False),
        T.StructField("outer_level", T.IntegerType(), False),
        T.StructField("scorer", T.StringType(), False),
        T.StructField("layout_version", T.IntegerType(), False),
        T.StructField("created_at", T.StringType(), False),
        T.StructField("completed_at", T.StringType()),
    ]
)

STATES = ("pending", "running", "done", "excluded", "failed")
STATE_SCHEMA = T.StructType(
    [
        T.StructField("pass_id", T.StringType(), False),
        T.StructField("outer_pix", T.LongType(), False),
        T.StructField("state", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("note", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("lease_until", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class LoadRequest:
    """What a caller wants of the star store: ``pixels`` (all if None), and with ``stitching_level`` also the stars in the ring of
    cells of that level around them."""

    release: str = "dr3"
    outer_level: int = 6
    epoch: float = 2016.0
    band: str = "R"
    stitching_level: int | None = None
    pixels: tuple[int, ...] | None = None


@dataclass(frozen=True)
class SearchConfig:
    """Rules of the guide-star search. A change changes the identity of a pass, not the code."""

    sizes: tuple[int, ...] = (1, 2, 3)
    radius_arcsec: float = 120.0
    min_separation_arcsec: float = 10.0
    mag_min: float = 8.0
    mag_max: float = 18.0
    max_ruwe: float = 1.4
    single_only: bool = True
    outer_level: int = 6
    inner_level: int = 10
    map_levels: tuple[int, ...] = (6, 3)
    top_k: int = 5
    min_area_arcsec2: float = 0.0
    max_side_arcsec: float = 120.0

    def as_map(self) -> dict[str, str]:
        return {k: json.dumps(v, sort_keys=True) for k, v in sorted(asdict(self).items())}


def pass_identity(algorithm: str, version: str, config: SearchConfig, release: str, outer_level: int, scorer: str) -> str:
    """The same inputs give the same id; anything else gives another."""
    record = {"algorithm": algorithm, "version": version, "config": config.as_map(), "release": release, "level": outer_level, "scorer": scorer, "layout": LAYOUT_VERSION}
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def star_root(root: str, release: str, level: int) -> str:
    return f"{root}/stars/release={release}/level={level}"


def star_folder(ra: float, dec: float) -> tuple[int, int]:
    """Hour and declination band (of ten degrees, from the south pole) of a cell's centre. Nine digits are enough to put a
    centre on a border on the same side in every implementation of the sine."""
    return math.floor(round(ra, 9) / 15) % 24, min(17, math.floor((round(dec, 9) + 90) / 10))


def star_path(root: str, release: str, level: int, pix: int) -> str:
    """Folder of a cell in the star store: hour, declination, pixel."""
    hour, dec = star_folder(*cells.centre(pix, level))
    return f"{star_root(root, release, level)}/hour={hour}/dec={dec}/outer_pix={pix}"


def pass_path(root: str, pass_id: str, kind: str) -> str:
    """Folder of a pass artifact: inner, asterisms, map, overlay, manifest or state."""
    if kind not in ("inner", "asterisms", "map", "overlay", "manifest", "state", "bench"):
        raise ValueError(f"no artifact of kind {kind!r}")
    return f"{root}/passes/layout={LAYOUT_VERSION}/{kind}" if kind == "manifest" else f"{root}/passes/layout={LAYOUT_VERSION}/{kind}/pass_id={pass_id}"
