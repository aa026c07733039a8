"""Load-time preparation of stars: projection, proper motion, working bands, quality and magnitude cuts.

Every cut on a stored column stands on that column, so it reaches the Parquet scan; derived columns come after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..contracts import STAR_SCHEMA, LoadRequest, SearchConfig
from ..functions import cells

# G - band as a polynomial in BP - RP (Riello et al. 2021, Johnson-Cousins R and I, V).
BANDS = {
    "R": (-0.02275, 0.3961, -0.1243, -0.01396, 0.003775),
    "I": (0.01753, 0.76, -0.0991),
    "V": (-0.02704, 0.01424, -0.2156, 0.01426),
}
STORED_BANDS = {"G": "gaia_G", "BP": "gaia_BP", "RP": "gaia_RP"}
MAS_PER_DEGREE = 3.6e6


def canonical(df: DataFrame) -> DataFrame:
    """Exactly the stored columns, in their types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in STAR_SCHEMA])


def at_epoch(stars: DataFrame, epoch: float) -> DataFrame:
    """Positions moved to an epoch, to first order; a star without proper motion stays."""
    years = F.lit(float(epoch)) - F.col("gaia_ref_epoch")
    pmra, pmdec = F.coalesce("gaia_pmra", F.lit(0.0)), F.coalesce("gaia_pmdec", F.lit(0.0))
    ra = F.pmod(F.col("gaia_ra") + pmra * years / (MAS_PER_DEGREE * F.cos(F.radians("gaia_dec"))), F.lit(360.0))
    return stars.withColumns({"ra": ra, "dec": F.col("gaia_dec") + pmdec * years / MAS_PER_DEGREE, "epoch": F.lit(float(epoch))})


def band_column(band: str, colour: Column | None = None) -> Column:
    if band in STORED_BANDS:
        return F.col(STORED_BANDS[band]).cast("double")
    colour = _colour() if colour is None else colour
    out = F.lit(0.0)
    for c in reversed(BANDS[band]):
        out = out * colour + c
    return F.col("gaia_G").cast("double") - out


def _colour() -> Column:
    return F.col("gaia_BP").cast("double") - F.col("gaia_RP").cast("double")


def with_band(stars: DataFrame, band: str, name: str = "mag") -> DataFrame:
    """Adds a working band; null without magnitude or colour. The colour is bound, since the polynomial names it for each of its powers, and so is the band, which cuts
    and results name again: copies of the expressions behind them make methods that the JVM does not compile."""
    if band in STORED_BANDS:
        return stars.withColumn(name, band_column(band))
    made = cells.bound(stars, _colour=_colour())
    return cells.bound(made, **{name: band_column(band, F.col("_colour"))}).drop("_colour")


def quality(stars: DataFrame, max_ruwe: float = 1.4, single_only: bool = True) -> DataFrame:
    """Good astrometry (or none stated), and single stars only."""
    stars = stars.where(F.col("gaia_ruwe").isNull() | (F.col("gaia_ruwe") <= F.lit(max_ruwe).cast("float")))
    return stars.where(F.col("gaia_non_single_star") == 0) if single_only else stars


def guide_stars(stars: DataFrame, cfg: SearchConfig = SearchConfig(), band: str = "R", epoch: float = 2016.0) -> DataFrame:
    """Stars for the search: gaia_id, ra, dec, mag, after the cuts. Stars without a magnitude in the band are out."""
    prepared = with_band(at_epoch(quality(stars, cfg.max_ruwe, cfg.single_only), epoch), band)
    return prepared.where(F.col("mag").between(cfg.mag_min, cfg.mag_max)).select("gaia_id", "ra", "dec", "mag")


def prepared(stars: DataFrame, request: LoadRequest) -> DataFrame:
    """Stars at the epoch and in the band of a request, with their cell."""
    out = with_band(at_epoch(stars, request.epoch), request.band)
    return cells.with_cell(out, "gaia_ra", "gaia_dec", request.outer_level, "outer_pix")


def load_stitched(stars: DataFrame, pixels: DataFrame, level: int, request: LoadRequest = LoadRequest()) -> DataFrame:
    """For each wanted cell (``pix``), the prepared stars of the cell and of its neighbours at ``level``.

    The neighbour table has at most nine rows per wanted cell and is made from these cells alone; it is joined by cell, so Spark
    broadcasts it when it is small and shuffles it when it is not.
    """
    wanted = pixels.select("pix").where("pix is not null").distinct()
    around = cells.neighbours_of(wanted, level).unionByName(wanted.withColumn("nbr", F.col("pix")))
    out = cells.with_cell(prepared(stars, request), "gaia_ra", "gaia_dec", level, "nbr")
    return out.join(around, "nbr").withColumn("own", F.col("pix") == F.col("nbr"))
