"""Registered queries over sources: the archive, the grouped layout, pre-warmed and timed runs, sketches; with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..contracts import SearchConfig
from ..functions import cells
from ..operators import sketches
from ..sources import archive, artifacts, grouped, stars
from . import build, catalog, oracle

LEVEL, PARENTS, ASKED = 6, 4, 3
#: Stars that the archive gives at most for one request.
ROW_LIMIT = 200
#: Stars that a task asks for, about, where cells hold more.
TASK_STARS = 50_000
ERROR = 0.05
SHARES = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def archive_stars(spark, sf_dir):
    """Faint stars north of declination 1 from an archive that gives ``ROW_LIMIT`` stars a request: some columns, by cells that are split where they hold more."""
    root, patch = catalog._root(spark, "archive"), catalog.patch(spark, sf_dir)
    grouped.compact(patch, root, "dr3", ASKED)
    held = grouped.current(spark, root, "dr3", ASKED).where("parent >= 0").select("parent").toArrow().column("parent").to_pylist()
    split = max(0, math.ceil(math.log(max(1, patch.count()) / max(1, len(held)) / TASK_STARS, 4)))
    columns = ["gaia_id", "gaia_ra", "gaia_dec", "gaia_G", "gaia_pmra"]
    found = archive.archive_query(spark, held, "skyloom.sources.grouped:fetch", level=ASKED, columns=columns, row_limit=ROW_LIMIT, service={"root": root, "parent_level": ASKED}, split=split)
    return found.where("gaia_dec > 1 and gaia_G >= 14").select("gaia_id", "gaia_ra", "gaia_dec", "gaia_G", "gaia_pmra")


def grouped_cells(spark, sf_dir):
    """Stars of the cells of every tenth star from the grouped layout, after the parents of one cell have been rewritten without their odd stars."""
    root, patch = catalog._root(spark, "grouped"), catalog.patch(spark, sf_dir)
    grouped.compact(patch, root, "dr3", PARENTS)
    at = cells.with_cell(patch, "gaia_ra", "gaia_dec", LEVEL, "outer_pix")
    parent = at.where("gaia_id = 77").select(cells.parent(F.col("outer_pix"), LEVEL, PARENTS).alias("parent"))
    grouped.compact(patch.where("gaia_id % 2 = 0"), root, "dr3", PARENTS, parent)
    wanted = at.where("gaia_id % 10 = 0").select("outer_pix").distinct().toArrow().column("outer_pix").to_pylist()
    return grouped.read_grouped(spark, root, "dr3", PARENTS, LEVEL, wanted).select("outer_pix", "gaia_id", "gaia_G")


def magnitude_quantiles(spark, sf_dir):
    """Deciles and median of magnitude per cell of two levels, from sketches of the inner cells merged upward."""
    guides = catalog.guides(spark, sf_dir).withColumn("mag", F.round("mag", 9))
    sketch = sketches.magnitude_sketch(guides, 8, ERROR)
    found = sketches.quantiles(sketches.merge_up(sketch, 8, (8, 6, 3)), SHARES, ERROR)
    return found.select("level", "pix", "n_stars", *[F.round(c, 6).alias(c) for c in SHARES])


def _pass(spark, sf_dir, name: str, cfg: SearchConfig, prewarm: tuple[int, ...]):
    root = catalog._root(spark, name)
    stars.write_stars(catalog.patch(spark, sf_dir), root, "dr3", LEVEL)
    ids = []
    for n, limit in enumerate(prewarm):
        made = SearchConfig(sizes=cfg.sizes, outer_level=LEVEL, top_k=cfg.top_k + n)
        ids.append(build.create_pass(spark, root, made))
        build.bench_run(spark, root, ids[-1], made, batches=2, at_once=1, prewarm_bytes=limit)
    return root, ids


def prewarmed_pass(spark, sf_dir):
    """The pairs of a pass whose batches find their stars loaded."""
    root, ids = _pass(spark, sf_dir, "prewarm", SearchConfig(sizes=(2,)), (1 << 28,))
    return artifacts.read_asterisms(spark, root, ids[0]).select("outer_pix", "rank", "g1", "g2")


def bench_records(spark, sf_dir):
    """Records of two timed runs over the given stars, one that reads the store and one that is pre-warmed: what each built."""
    root, ids = _pass(spark, sf_dir, "bench", SearchConfig(sizes=(1,), top_k=1), (0, 1 << 28))
    records = build.read_bench(spark, root, ids[0]).unionByName(build.read_bench(spark, root, ids[1]))
    counts = [F.col(c).cast("long").alias(c) for c in ("n_cells", "n_stars", "n_groups")]
    return records.select("cache_target", "staging", "temperature", "region", *counts, (F.col("seconds").cast("double") > 0).alias("timed"))


ALL = (archive_stars, grouped_cells, magnitude_quantiles, prewarmed_pass, bench_records)


def queries():
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    at = oracle._pix("loc", "stars", "gaia_ra", "gaia_dec", LEVEL)
    order = "order by mag, gaia_id"
    levels = " union all ".join(f"select {k} as level, inner_pix >> {2 * (8 - k)} as pix, gaia_id, round(mag, 9) as mag from fine" for k in (8, 6, 3))
    quantile = ", ".join(f"round((floor(max(mag) filter (where r = greatest(1, ceil(n*{p}e0))) / {2 * ERROR}e0) + 0.5e0) * {2 * ERROR}e0, 6) as {name}" for name, p in SHARES.items())
    best = "row_number() over (partition by outer_pix order by score desc, g1) as place"
    return {
        "archive_stars": oracle._with(oracle.STARS) + ' select gaia_id, gaia_ra, gaia_dec, "gaia_G", gaia_pmra from stars where gaia_dec > 1 and "gaia_G" >= 14',
        "grouped_cells": oracle._with(oracle.STARS, at)
        + f"""
select pix as outer_pix, gaia_id, "gaia_G" from loc
where pix in (select pix from loc where gaia_id % 10 = 0) and (gaia_id % 2 = 0 or pix >> {2 * (LEVEL - PARENTS)} not in (select pix >> {2 * (LEVEL - PARENTS)} from loc where gaia_id = 77))""",
        "magnitude_quantiles": oracle._with(oracle.STARS, oracle._guides(), oracle._pix("fine", "guides", "ra", "dec", 8, "inner_pix"), f"leveled as ({levels})")
        + f"""
select level, pix, count(*) as n_stars, {quantile}
from (select *, row_number() over (partition by level, pix {order}) as r, count(*) over (partition by level, pix) as n from leveled) group by level, pix""",
        "prewarmed_pass": oracle.sql()["resumed_pass"],
        "bench_records": oracle._with(oracle.STARS, oracle._guides(), oracle._pairs(), oracle.TRIPLES, oracle._groups(1), at, f"placed_ as (select *, {best} from groups where outer_pix in (select pix from loc))", "held as (select count(distinct pix) as n_cells, count(*) as n_stars from loc)")
        + f"""
select target as cache_target, staging, temperature, 'dr3/level-{LEVEL}' as region, n_cells, n_stars, (select count(*) from placed_ where place <= k) as n_groups, true as timed
from held, (values ('none', 'none', 'cold', 1), ('executors', 'prewarm', 'warm', 2)) t(target, staging, temperature, k)""",
    }
