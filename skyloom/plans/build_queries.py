"""Registered queries over builds: regions of open cells, transitions, changed cells, balance by work, a pass built again in part; with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..contracts import SearchConfig
from ..functions import cells
from ..operators import loader
from ..sources import artifacts, digests, stars
from ..sources.log import LEGAL, StateLog, illegal
from . import build, catalog, oracle, regions

LEVEL = 6
SHARES = 4


def work_regions(spark, sf_dir):
    """Connected regions of the cells that the events leave open, and how many open cells touch each."""
    catalog._root(spark, "regions")  # rounds write to the shared folder
    states = build.latest(catalog.build_events(spark, sf_dir))
    open_ = build.unfinished(states.where("outer_pix is not null").select("outer_pix"), states)
    return regions.regions(open_, LEVEL)


def illegal_transitions(spark, sf_dir):
    """Events whose state may not follow the one before."""
    return illegal(catalog.build_events(spark, sf_dir)).select("outer_pix", "before", "state", "seq")


def clustered(spark, sf_dir):
    """The patch, drawn together at one corner."""
    near = {c: F.lit(low) + F.pow(F.col(c) - low, 2) / 10 for c, low in (("gaia_ra", 150.0), ("gaia_dec", -5.0))}
    return catalog.patch(spark, sf_dir).withColumns(near)


def balance_by_work(spark, sf_dir):
    """Shares of a clustered sky with about equal numbers of stars and predicted pairs."""
    known = digests.cell_digests(clustered(spark, sf_dir), LEVEL)
    return build.balance(digests.predicted_work(known, LEVEL, SearchConfig().radius_arcsec), SHARES)


def _changed_patch(spark, sf_dir):
    """The patch after a change: some stars brighter, some gone."""
    stars_ = catalog.patch(spark, sf_dir)
    return stars_.where("gaia_id % 997 <> 5").withColumn("gaia_G", F.when(F.col("gaia_id") % 499 == 3, F.col("gaia_G") - 1).otherwise(F.col("gaia_G")).cast("float"))


def _changed(spark, sf_dir):
    catalog._root(spark, "changed")  # levels of the trees go to the shared folder
    return digests.changed(*(digests.cell_digests(f(spark, sf_dir), LEVEL) for f in (catalog.patch, _changed_patch)), LEVEL)


def changed_cells(spark, sf_dir):
    """Cells whose stars differ between two stores, found from the top of their digest trees."""
    return _changed(spark, sf_dir)


def cells_to_rebuild(spark, sf_dir):
    """Cells that differ or touch one that does."""
    held = digests.cell_digests(_changed_patch(spark, sf_dir), LEVEL)
    return digests.to_rebuild(_changed(spark, sf_dir), held, LEVEL)


def rebuilt_pass(spark, sf_dir):
    """A pass whose store gets fainter stars in the cells around one star: what it then holds, and how often each cell was built."""
    root, cfg = catalog._root(spark, "rebuilt"), SearchConfig(sizes=(1,), outer_level=LEVEL)
    patch = catalog.patch(spark, sf_dir)
    stars.write_stars(patch, root, "dr3", LEVEL)
    pass_id = build.create_pass(spark, root, cfg)
    build.run(spark, root, pass_id, cfg, batches=1)
    cell = cells.with_cell(patch, "gaia_ra", "gaia_dec", LEVEL, "pix")
    one = cell.where("gaia_id = 77").select("pix")
    fainter = cell.join(one, "pix", "left_semi").withColumn("gaia_G", (F.col("gaia_G") + 0.25).cast("float")).drop("pix")
    stars.write_stars(fainter, root, "dr3", LEVEL)
    build.resume(spark, root, pass_id, cfg, batches=1)
    built = StateLog(spark, root, pass_id).events().where("state = 'done'").groupBy("outer_pix").agg(F.count("*").alias("n_built"))
    return artifacts.read_asterisms(spark, root, pass_id).join(built, "outer_pix").select("outer_pix", "rank", "g1", F.round("score", 6).alias("score"), "n_built")


ALL = (work_regions, illegal_transitions, balance_by_work, changed_cells, cells_to_rebuild, rebuilt_pass)


def queries():
    return {f.__name__: f for f in ALL}


_TOUCH = """touch as (
  select distinct a.pix, b.pix as nbr from own_corners a join corners b on b.dec between a.dec - 1e-7 and a.dec + 1e-7 and (abs(a.ra - b.ra) < 1e-6 or abs(a.ra - b.ra) > 360 - 1e-6 or abs(a.dec) > 90 - 1e-7))"""


def _touching(source: str) -> list[str]:
    """CTEs ending in ``touch``: pix of the source and all cells that share a corner with it, itself too."""
    return [*oracle._corners(LEVEL), f"own_corners as (select corners.* from corners where pix in (select pix from {source}))", _TOUCH]


def oracle_sql() -> dict[str, str]:
    legal = " or ".join(f"(before = '{a}' and state in ({', '.join(repr(b) for b in then)}))" for a, then in LEGAL.items())
    share = math.pi * (SearchConfig().radius_arcsec / 3600) ** 2 / cells.cell_area_deg2(LEVEL + digests.FINER) / 2
    diff = [
        oracle.STARS,
        oracle._pix("loc", "stars", "gaia_ra", "gaia_dec", LEVEL),
        "per_cell as (select pix, count(*) as n, count(*) filter (where gaia_id % 997 = 5) as n_gone, count(*) filter (where gaia_id % 499 = 3) as n_new from loc group by 1)",
        "differs as (select pix, case when n = n_gone then 'gone' else 'changed' end as change from per_cell where n_gone + n_new > 0)",
    ]
    return {
        "work_regions": oracle._with(
            oracle._STATE,
            "open_ as (select outer_pix as pix from last_state where outer_pix is not null and state not in ('done', 'excluded', 'failed'))",
            *_touching("open_"),
            "near as (select pix, nbr from touch where nbr in (select pix from open_) and pix <> nbr)",
            "reach(a, b) as (select pix, pix from open_ union select reach.a, near.nbr from reach join near on near.pix = reach.b)",
        ).replace("with ", "with recursive ", 1)
        + " select a as outer_pix, min(b) as region, (select count(*) from near where near.pix = a) as n_open from reach group by a",
        "illegal_transitions": f"""with ev as ({oracle.EVENTS.format(table="events")}), seen as (select *, coalesce(lag(state) over (partition by outer_pix order by ts, seq), '') as before from ev)
select outer_pix, before, state, seq from seen where not ({legal})""",
        "balance_by_work": oracle._with(
            oracle.STARS,
            "near_ as (select 150.0e0 + pow(gaia_ra - 150.0e0, 2)/10 as ra, -5.0e0 + pow(gaia_dec + 5.0e0, 2)/10 as dec from stars)",
            oracle._pix("loc", "near_", "ra", "dec", LEVEL + digests.FINER),
            "fine as (select pix, count(*) as k from loc group by 1)",
            f"held as (select pix >> {2 * digests.FINER} as outer_pix, cast(sum(k) + floor((sum(k*k) - sum(k)) * {share!r}e0) as bigint) as weight from fine group by 1)",
        )
        + f""", run as (
  select outer_pix, weight, cast(sum(weight) over (order by outer_pix) - weight as bigint) as before, sum(weight) over () as total from held)
select outer_pix, weight, before, cast(least(floor(before*{SHARES}/total), {SHARES - 1}) as integer) as share from run""",
        "changed_cells": oracle._with(*diff) + " select pix as outer_pix, change from differs",
        "cells_to_rebuild": oracle._with(*diff, *_touching("differs")) + " select distinct nbr as outer_pix from touch where nbr in (select pix from per_cell where n > n_gone)",
        "rebuilt_pass": oracle._with(
            oracle.STARS,
            oracle._pix("loc", "stars", "gaia_ra", "gaia_dec", LEVEL),
            "one as (select pix from loc where gaia_id = 77)",
            *_touching("one"),
            'later as (select * replace (case when pix in (select pix from one) then cast("gaia_G" + 0.25 as float) else "gaia_G" end as "gaia_G") from loc)',
            oracle._guides().replace("from stars", "from later"),
            oracle._pairs(),
            oracle.TRIPLES,
            oracle._groups(1),
        )
        + """
select outer_pix, rank, g1, round(score, 6) as score, n_built from (
  select outer_pix, cast(row_number() over (partition by outer_pix order by score desc, g1) as integer) as rank, g1, score,
    case when outer_pix in (select nbr from touch) then 2 else 1 end::bigint as n_built
  from groups where outer_pix in (select pix from loc))
where rank <= 5""",
    }
