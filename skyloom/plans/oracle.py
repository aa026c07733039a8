"""SQL of the registered queries, by other algorithms where there is a choice: brute-force distances, bit loops."""

from __future__ import annotations

import json

from ..contracts import LAYOUT_VERSION, STATES, SearchConfig
from ..functions.cells import cell_area_deg2
from ..operators.loader import BANDS, STORED_BANDS

_RA = "150.0e0 + mod(mod(o_orderkey*o_orderkey,9999991)*7919 + o_orderkey*104729, 10000000)/1000000.0e0"
_DEC = "-5.0e0 + mod(mod(o_orderkey*o_orderkey,9999973)*mod(o_orderkey,99991) + o_orderkey*15485863, 10000000)/1000000.0e0"
_G = "8.0e0 + mod(o_orderkey*7919,12000)/1000.0e0"
_HALF = "(mod(o_orderkey*104729,3500)/1000.0e0 - 0.5e0)/2.0e0"

#: Stars on a patch; {table} is ``orders``. Both engines run this text.
PATCH = f"""
select o_orderkey as gaia_id, {_RA} as gaia_ra, {_DEC} as gaia_dec, cast({_G} as float) as "gaia_G",
  cast(case when mod(o_orderkey,97) = 0 then null else {_G} + {_HALF} end as float) as "gaia_BP",
  cast(case when mod(o_orderkey,97) = 0 then null else {_G} - {_HALF} end as float) as "gaia_RP",
  2016.0e0 as gaia_ref_epoch,
  case when mod(o_orderkey,89) = 0 then null else mod(o_orderkey*31,2001)/10.0e0 - 100.0e0 end as gaia_pmra,
  case when mod(o_orderkey,89) = 0 then null else mod(o_orderkey*37,2001)/10.0e0 - 100.0e0 end as gaia_pmdec,
  cast(case when mod(o_orderkey,23) = 0 then 1 else 0 end as smallint) as gaia_non_single_star,
  cast(case when mod(o_orderkey,101) = 0 then null else 0.8e0 + mod(o_orderkey*17,100)/100.0e0 end as float) as gaia_ruwe
from {{table}}
"""
_DUCK_PATCH = PATCH
PATCH = PATCH.replace('"', "`")

#: Positions all over the sky.
SKY = """
select o_orderkey as gaia_id, mod(o_orderkey*2654435761,360000000)/1000000.0e0 as ra,
  round(degrees(asin(mod(o_orderkey*1597334677,2000001)/1000000.0e0 - 1.0e0)), 9) as dec
from {table}
"""

FOOTPRINTS = """
select r_name as survey, 150.0e0 + mod(n_nationkey*7,10) as ra_min, 150.0e0 + mod(n_nationkey*7,10) + 2.5e0 as ra_max,
  -5.0e0 + mod(n_nationkey*3,10) as dec_min, -5.0e0 + mod(n_nationkey*3,10) + 1.7e0 as dec_max
from {nation} join {region} on n_regionkey = r_regionkey
"""

EVENTS = """
select user_id as outer_pix, ts, event_id as seq,
  case event_type when 'signup' then 'pending' when 'click' then 'running' when 'purchase' then 'done' when 'view' then 'excluded' else 'failed' end as state
from {table}
"""


def _horner(band: str, colour: str) -> str:
    out = ""
    for c in reversed(BANDS[band]):
        out = f"(({out})*{colour} + ({c}e0))" if out else f"({c}e0)"
    return out


def _mag(band: str = "R") -> str:
    colour = '(cast("gaia_BP" as double) - cast("gaia_RP" as double))'
    return f'(cast("gaia_G" as double) - {_horner(band, colour)})'


def _with(*parts: str) -> str:
    return "with " + ",\n".join(p for p in parts if p)


STARS = f"stars as ({_DUCK_PATCH.format(table='orders')})"
SKY_CTE = f"sky as ({SKY.format(table='orders')})"


def _guides(max_ruwe: float = 1.4, name: str = "guides") -> str:
    return f"""{name} as (
  select gaia_id, gaia_ra as ra, gaia_dec as dec, {_mag()} as mag from stars
  where (gaia_ruwe is null or gaia_ruwe <= cast({max_ruwe} as float)) and gaia_non_single_star = 0 and {_mag()} between 8.0 and 18.0)"""


def _pix(name: str, source: str, ra: str, dec: str, k: int, out: str = "pix") -> str:
    """CTEs that add the nested cell of a position, bit by bit."""
    n = 1 << k
    bits = " | ".join(f"(((x_ >> {b}) & 1) << {2 * b}) | (((y_ >> {b}) & 1) << {2 * b + 1})" for b in range(k)) or "0"
    return f"""{name}_1 as (select *, ({ra}) / 90.0e0 as t_, sin(radians({dec})) as z_ from {source}),
{name}_2 as (select *, cast(floor({n}*(0.5e0+t_) - {0.75 * n}e0*z_) as bigint) as jp_, cast(floor({n}*(0.5e0+t_) + {0.75 * n}e0*z_) as bigint) as jm_,
  least(3, cast(floor(t_) as bigint)) as q_, {n}*sqrt(3*(1-abs(z_))) as s_ from {name}_1),
{name}_3 as (select *, least({n - 1}, cast(floor((t_-q_)*s_) as bigint)) as cp_, least({n - 1}, cast(floor((1-(t_-q_))*s_) as bigint)) as cm_ from {name}_2),
{name}_4 as (select *,
  case when abs(z_) <= 2.0e0/3.0e0 then case when (jp_ >> {k}) = (jm_ >> {k}) then (jp_ >> {k}) | 4 when (jp_ >> {k}) < (jm_ >> {k}) then jp_ >> {k} else (jm_ >> {k}) + 8 end
    when z_ > 0 then q_ else q_ + 8 end as f_,
  case when abs(z_) <= 2.0e0/3.0e0 then jm_ & {n - 1} when z_ > 0 then {n - 1} - cm_ else cp_ end as x_,
  case when abs(z_) <= 2.0e0/3.0e0 then {n - 1} - (jp_ & {n - 1}) when z_ > 0 then {n - 1} - cp_ else cm_ end as y_ from {name}_3),
{name} as (select * exclude (t_, z_, jp_, jm_, q_, s_, cp_, cm_, f_, x_, y_), cast((f_ << {2 * k}) | {bits} as bigint) as {out} from {name}_4)"""


def _centre(name: str, source: str, k: int, pix: str = "pix", dx: str = "0.5e0", dy: str = "0.5e0") -> str:
    """CTEs that add the position (ra, dec) of a place in a cell."""
    n = 1 << k
    x = " | ".join(f"((({pix} >> {2 * b}) & 1) << {b})" for b in range(k)) or "0"
    y = " | ".join(f"((({pix} >> {2 * b + 1}) & 1) << {b})" for b in range(k)) or "0"
    return f"""{name}_1 as (select *, ({pix} >> {2 * k}) as f_, ({x}) + {dx} as x_, ({y}) + {dy} as y_ from {source}),
{name}_2 as (select *, (f_ // 4) + 2 - (x_ + y_) / {n}.0e0 as r_ from {name}_1),
{name}_3 as (select *, case when r_ < 1 then r_ when r_ > 3 then 4 - r_ else 1.0e0 end as w_, 2*(f_ % 4) + case when f_ // 4 = 1 then 0 else 1 end as p_ from {name}_2),
{name} as (select * exclude (f_, x_, y_, r_, w_, p_),
  case when w_ <= 0 then 0.0e0 else ((45.0e0*(p_*w_ + (x_ - y_)/{n}.0e0)/w_) + 360.0e0) % 360.0e0 end as ra,
  degrees(asin(case when r_ < 1 then 1 - w_*w_/3 when r_ > 3 then w_*w_/3 - 1 else (2 - r_)*2.0e0/3.0e0 end)) as dec from {name}_3)"""


def _sep(a_ra: str, a_dec: str, b_ra: str, b_dec: str) -> str:
    """Haversine, in arcsec."""
    return f"(2*asin(least(1, sqrt(pow(sin(radians({b_dec} - {a_dec})/2), 2) + cos(radians({a_dec}))*cos(radians({b_dec}))*pow(sin(radians({b_ra} - {a_ra})/2), 2))))*(180*3600/pi()))"


def _pairs(radius: float = 120.0, least: float = 10.0) -> str:
    sep = _sep("a.ra", "a.dec", "b.ra", "b.dec")
    return f"""pairs as (select * from (
  select a.gaia_id as g1, b.gaia_id as g2, a.ra as ra1, a.dec as dec1, b.ra as ra2, b.dec as dec2, a.mag as m1, b.mag as m2, {sep} as sep12
  from guides a join guides b on b.dec between a.dec - {radius / 3600 * 1.001} and a.dec + {radius / 3600 * 1.001} where a.gaia_id < b.gaia_id)
  where sep12 <= {radius} and sep12 >= {least})"""


TRIPLES = """triples as (
  select ij.g1, ij.g2, jk.g2 as g3, ij.ra1, ij.dec1, ij.ra2, ij.dec2, jk.ra2 as ra3, jk.dec2 as dec3, ij.m1, ij.m2, jk.m2 as m3, ij.sep12, ik.sep12 as sep13, jk.sep12 as sep23
  from pairs ij join pairs jk on ij.g2 = jk.g1 join pairs ik on ik.g1 = ij.g1 and ik.g2 = jk.g2)"""


def _vec(i: int) -> str:
    return f"cos(radians(dec{i}))*cos(radians(ra{i})) as x{i}, cos(radians(dec{i}))*sin(radians(ra{i})) as y{i}, sin(radians(dec{i})) as z{i}"


def _groups(*sizes: int) -> str:
    """CTEs ending in ``groups``: size, members, centre, geometry, flux, score, cell."""
    rows = {
        1: "select 1 as size, gaia_id as g1, null::bigint as g2, null::bigint as g3, ra as ra1, dec as dec1, null::double as ra2, null::double as dec2, null::double as ra3, null::double as dec3, mag as m1, null::double as m2, null::double as m3, null::double as a, null::double as b, null::double as c from guides",
        2: "select 2, g1, g2, null, ra1, dec1, ra2, dec2, null, null, m1, m2, null, sep12, null, null from pairs",
        3: "select 3, g1, g2, g3, ra1, dec1, ra2, dec2, ra3, dec3, m1, m2, m3, sep12, sep13, sep23 from triples",
    }
    union = "\n  union all ".join(["select * from (" + rows[1] + ") where false", *[rows[s] for s in sizes]])
    return f"""members as ({union}),
vectors as (select *, {_vec(1)}, {_vec(2)}, {_vec(3)} from members),
sums as (select *, x1 + coalesce(x2,0) + coalesce(x3,0) as sx, y1 + coalesce(y2,0) + coalesce(y3,0) as sy, z1 + coalesce(z2,0) + coalesce(z3,0) as sz,
  coalesce(greatest(a,b,c),0) as max_side, coalesce(sqrt(greatest(0,(a+b+c)*(-a+b+c)*(a-b+c)*(a+b-c)))/4,0) as area,
  pow(10,-0.4*(m1-15)) + coalesce(pow(10,-0.4*(m2-15)),0) + coalesce(pow(10,-0.4*(m3-15)),0) as flux from vectors),
placed as (select size, g1, g2, g3, max_side, area, flux, case when size = 3 and area > 0 then a*b*c/(4*area) else max_side/2 end as circumradius,
  round((degrees(atan2(sy,sx)) + 360) % 360, 9) as ra, round(degrees(atan2(sz,sqrt(sx*sx+sy*sy))), 9) as dec,
  round(flux * case when size = 3 and max_side > 0 then area/(max_side*max_side) else 1 end, 9) as score from sums),
{_pix("groups", "placed", "ra", "dec", 6, "outer_pix")}"""


def _found(*sizes: int, radius: float = 120.0) -> str:
    return _with(STARS, _guides(), _pairs(radius), TRIPLES, _groups(*sizes))


def _overlaps(radius: float) -> str:
    return f"""named as (select *, coalesce(g2,-1) as h2, coalesce(g3,-1) as h3 from groups),
over as (select a.g1 as a1, a.h2 as a2, a.h3 as a3, b.g1 as b1, b.h2 as b2, b.h3 as b3, (a.score > b.score or (a.score = b.score)) as a_better
  from named a join named b on b.dec between a.dec - {radius / 3600 * 1.001} and a.dec + {radius / 3600 * 1.001}
  where (a.g1, a.h2, a.h3) < (b.g1, b.h2, b.h3) and {_sep("a.ra", "a.dec", "b.ra", "b.dec")} <= {radius})"""


def _inner(k: int = 10, source: str = "guides", name: str = "inner_") -> str:
    return f"""{_pix(name + "p", source, "ra", "dec", k, "inner_pix")},
{name} as (select (inner_pix >> {2 * (k - 6)}) as outer_pix, inner_pix, count(*) as n_stars, count(*)/{cell_area_deg2(k)!r} as density, min(mag) as brightest, sum(pow(10,-0.4*(mag-15))) as flux from {name}p group by inner_pix)"""


def _map(level: int, k: int = 10) -> str:
    return f"select {level} as level, (inner_pix >> {2 * (k - level)}) as pix, cast(sum(n_stars) as bigint) as n_stars, count(*) as n_cells, min(brightest) as brightest, sum(flux) as flux from inner_ group by 2"


_BOXES = f"boxes as ({FOOTPRINTS.format(nation='nation', region='region')})"


def _survey_cells(level: int) -> str:
    all_cells = f"all{level} as (select unnest(range(0, {12 * 4**level})) as pix)"
    return f"{all_cells},\n{_centre(f'c{level}', f'all{level}', level)},\nsurvey{level} as (select distinct {level} as level, survey, pix from c{level} join boxes on ra between ra_min and ra_max and dec between dec_min and dec_max)"


def _overlaid() -> str:
    return _with(STARS, _guides(), _inner(), f"map as ({_map(7)} union all {_map(6)})", _BOXES, _survey_cells(7), _survey_cells(6), "survey as (select * from survey7 union all select * from survey6)", "overlaid as (select map.*, survey, survey is not null as inside from map left join survey using (level, pix))")


_STATE = f"ev as ({EVENTS.format(table='events')}), last_state as (select outer_pix, state, n_events from (select *, row_number() over (partition by outer_pix order by ts desc, seq desc) as r, count(*) over (partition by outer_pix) as n_events from ev) where r = 1)"
_UNIVERSE = "universe as (select unnest(range(0, 192)) as outer_pix union select outer_pix from last_state where outer_pix is not null)"


def _corners(level: int) -> list[str]:
    """CTEs ending in ``corners``: pix, ra and dec of the four corners of every cell."""
    places = [(i, j) for i in (0, 1) for j in (0, 1)]
    rows = " union all ".join(f"select pix, ra, dec from v{i}{j}" for i, j in places)
    return [
        f"cells4 as (select unnest(range(0, {12 * 4**level})) as pix)",
        *[_centre(f"v{i}{j}", "cells4", level, dx=f"{i}.0e0", dy=f"{j}.0e0") for i, j in places],
        f"corners as ({rows})",
    ]


#: Best-first removal round by round: the groups that win an open overlap and lose none drop what they overlap.
_GREEDY = """numbered as (select *, row_number() over (order by g1, h2, h3) as id from named),
edges as (
  select case when a_better then x.id else y.id end as win, case when a_better then y.id else x.id end as lose
  from over join numbered x on a1 = x.g1 and a2 = x.h2 and a3 = x.h3 join numbered y on b1 = y.g1 and b2 = y.h2 and b3 = y.h3),
rounds as (
  select 0 as k, []::bigint[] as removed, 1 as grew
  union all
  select k + 1, list_concat(removed, new), len(new) from (
    select k, removed, coalesce((
      with open_ as (select win, lose from edges where not list_contains(removed, win) and not list_contains(removed, lose))
      select list(distinct lose) from open_ where win not in (select lose from open_)), []) as new
    from rounds where grew > 0))"""


def _identity(radius: str = "120.0e0") -> str:
    """SQL of the id of a pass with the default rules and a radius: the digest of its record's text."""
    record = {"algorithm": "guide-star-groups", "version": "1", "config": SearchConfig().as_map() | {"radius_arcsec": "RADIUS"}, "release": "dr3", "level": 6, "scorer": "heuristic-1", "layout": LAYOUT_VERSION}
    before, after = json.dumps(record, sort_keys=True, separators=(",", ":")).split("RADIUS")
    return f"sha256('{before}' || cast(cast({radius} as double) as varchar) || '{after}')"


def sql() -> dict[str, str]:
    guides, pair_ctes = _with(STARS, _guides()), _with(STARS, _guides(), _pairs())
    years = "(2030.5e0 - gaia_ref_epoch)"
    held = _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 5, "outer_pix"), "held as (select outer_pix, count(*) as weight from loc group by 1)")
    compare = _with(STARS, _guides(), _guides(1.2, "guides2"), _inner(8), _inner(8, "guides2", "other_"))
    near = _sep("g.ra", "g.dec", "c.ra", "c.dec")
    members = "g1, coalesce(g2,-1) as g2, coalesce(g3,-1) as g3"
    unit = {c: f"round({v},7) as {c}" for c, v in {"x": "cos(radians(dec))*cos(radians(ra))", "y": "cos(radians(dec))*sin(radians(ra))", "z": "sin(radians(dec))"}.items()}
    bands = ", ".join([f'round(cast("{c}" as double), 6) as "mag_{b}"' for b, c in STORED_BANDS.items()] + [f'round({_mag(b)}, 6) as "mag_{b}"' for b in BANDS])
    inner = """
select outer_pix, inner_pix, n_stars, round(density,6) as density, round(brightest,6) as brightest, round(flux,6) as flux from inner_"""
    density_map = _with(STARS, _guides(), _inner(), f"map as ({_map(6)} union all {_map(3)})") + """
select level, pix, n_stars, n_cells, round(brightest,6) as brightest, round(round(flux,6),3) as flux from map"""
    overlaid = _overlaid() + " select level, pix, survey, inside, n_stars from overlaid"
    return {
        "star_projection": _with(STARS) + " select * from stars",
        "proper_motion": _with(STARS)
        + f"""
select gaia_id, round((gaia_ra + coalesce(gaia_pmra,0)*{years}/(3.6e6*cos(radians(gaia_dec))) + 360.0e0) % 360.0e0, 9) as ra,
  round(gaia_dec + coalesce(gaia_pmdec,0)*{years}/3.6e6, 9) as dec
from stars""",
        "working_band": _with(STARS) + f" select gaia_id, round({_mag()}, 6) as mag from stars",
        "working_bands": _with(STARS) + f" select gaia_id, {bands} from stars",
        "quality_filter": _with(STARS) + " select gaia_id from stars where (gaia_ruwe is null or gaia_ruwe <= cast(1.4 as float)) and gaia_non_single_star = 0",
        "guide_stars": guides + " select gaia_id, ra, dec, round(mag, 6) as mag from guides",
        "stitched_load": _with(
            STARS,
            _pix("loc", "stars", "gaia_ra", "gaia_dec", 6),
            "wanted as (select distinct pix from loc)",
            *_corners(6),
            "own_corners as (select corners.* from corners join wanted using (pix))",
            """around as (
  select distinct a.pix, b.pix as nbr from own_corners a join corners b on b.dec between a.dec - 1e-7 and a.dec + 1e-7 and abs(a.ra - b.ra) < 1e-6)""",
        )
        + " select around.pix, gaia_id, around.pix = nbr as own from around join loc on loc.pix = nbr",
        "ang2pix_l6": _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 6)) + " select gaia_id, pix from loc",
        "ang2pix_l14": _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 14)) + " select gaia_id, pix from loc",
        "parent_pixel": _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 6)) + " select gaia_id, pix from loc",
        "children": _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 3)) + " select pix, unnest(range(pix*16, pix*16+16)) as child from (select distinct pix from loc)",
        "pix2ang": _with(SKY_CTE, _pix("own", "sky", "ra", "dec", 6), "cells6 as (select distinct pix from own)", _centre("loc", "cells6", 6)) + " select pix, round(ra, 9) as ra, round(dec, 9) as dec from loc",
        "cell_helpers": _with(
            SKY_CTE,
            _pix("loc", "sky", "ra", "dec", 12),
            "per_level as (select k, count(distinct pix >> (2*(12-k))) as n_filled, count(*) as n from loc, range(0, 13) t(k) group by k)",
            "sized as (select *, cast(12 * (1 << 2*k) as bigint) as npix, 4*pi()*pow(degrees(1),2)/(12 * (1 << 2*k)) as deg2 from per_level)",
        )
        + """
select cast(k as integer) as level, cast(1 << k as bigint) as nside, npix, round(deg2, 9) as area, round(sqrt(deg2)*3600, 6) as resolution, n_filled, round(n/(n_filled*deg2), 6) as density
from sized""",
        "neighbours": _with(SKY_CTE, _pix("held", "sky", "ra", "dec", 4), *_corners(4), f"spots as (select pix, {', '.join(unit.values())} from corners)")
        + """
select distinct a.pix, b.pix as nbr
from spots a join spots b on abs(a.x-b.x) < 1e-6 and abs(a.y-b.y) < 1e-6 and abs(a.z-b.z) < 1e-6 where a.pix <> b.pix and a.pix in (select pix from held)""",
        "traversal": _with(SKY_CTE, _pix("loc", "sky", "ra", "dec", 5, "outer_pix")) + " select outer_pix, row_number() over (order by outer_pix) - 1 as place from (select distinct outer_pix from loc)",
        "separation": _with(SKY_CTE)
        + f"""
select a.gaia_id, round({_sep("a.ra", "a.dec", "b.ra", "b.dec")}, 4) as sep,
  round((degrees(atan2(sin(radians(b.ra-a.ra))*cos(radians(b.dec)),
    cos(radians(a.dec))*sin(radians(b.dec)) - sin(radians(a.dec))*cos(radians(b.dec))*cos(radians(b.ra-a.ra)))) + 360) % 360, 6) as bearing
from sky a join sky b on b.gaia_id = a.gaia_id + 1""",
        "singles": guides + " select gaia_id as g1, round(mag, 6) as m1 from guides",
        "pairs": pair_ctes + " select g1, g2, round(sep12, 4) as sep12 from pairs",
        "triples": pair_ctes + f", {TRIPLES} select g1, g2, g3, round(sep12, 4) as sep12, round(sep13, 4) as sep13, round(sep23, 4) as sep23 from triples",
        "candidates": _found(1, 2, 3) + f" select size, {members} from groups",
        "star_count": _found(1, 2, 3) + " select outer_pix, count(*) as n_groups from groups group by 1",
        "group_geometry": _found(2, 3)
        + f"""
select {members}, round(ra,7) as ra, round(dec,7) as dec, round(max_side,4) as max_side, round(area,2) as area, round(circumradius,3) as circumradius
from groups""",
        "geom_filter": _found(2, 3) + f" select size, {members} from groups where max_side <= 90 and (size < 3 or area > 500)",
        "heuristic_score": _found(1, 2, 3) + f" select {members}, round(score, 6) as score from groups",
        "scorer_plugin": _found(1, 2, 3) + f" select {members}, round(score, 6) as score from groups",
        "topk_per_pixel": _found(2, 3)
        + f"""
select * from (
  select outer_pix, cast(row_number() over (partition by outer_pix order by score desc, g1, g2 nulls first, g3 nulls first) as integer) as rank, {members}
  from groups)
where rank <= 5""",
        "overlap_pairs": _found(2, 3) + f", {_overlaps(60.0)} select * from over",
        "overlap_suppressed": _found(2, 3)
        + f""", {_overlaps(60.0)}
select g1, h2 as g2, h3 as g3 from named
where not exists (select 1 from over where (a_better and (b1,b2,b3) = (g1,h2,h3)) or (not a_better and (a1,a2,a3) = (g1,h2,h3)))""",
        "overlap_greedy": _found(2, 3).replace("with ", "with recursive ", 1)
        + f""", {_overlaps(60.0)},
{_GREEDY}
select g1, h2 as g2, h3 as g3 from numbered where id not in (select unnest(removed) from (select removed from rounds order by k desc limit 1))""",
        "coverage": _found(3)
        + f""", coarse as (select unnest(range(0, 49152)) as up),
{_centre("cc", "coarse", 6, "up")},
fine as (select unnest(range(up*256, up*256+256)) as pix from cc where ra between 148 and 162 and dec between -7 and 7),
{_centre("c", "fine", 10)}
select pix, count(*) as n_groups, count(distinct g1) as n_first
from groups g join c on c.dec between g.dec - 0.0334 and g.dec + 0.0334 where {near} <= 120 group by pix""",
        "inner_product": _with(STARS, _guides(), _inner()) + inner,
        "stored_inner": _with(STARS, _guides(), _inner()) + inner,
        "density_map": density_map,
        "stored_map": density_map,
        "map_lookup": _with(STARS, _guides(), _inner(), f"map as ({_map(6)})", _pix("loc", "stars", "gaia_ra", "gaia_dec", 6))
        + " select gaia_id, loc.pix, coalesce(n_stars,0) as n_stars, coalesce(n_cells,0) as n_cells from loc left join map on map.pix = loc.pix",
        "survey_overlay": overlaid,
        "stored_overlay": overlaid,
        "survey_summary": _overlaid()
        + """
select survey, coalesce(level,-1) as level, count(*) as n_cells, cast(sum(n_stars) as bigint) as n_stars, grouping_id(survey, level) as grouping
from overlaid group by grouping sets ((survey, level), (level), ())""",
        "state_latest": f"with {_STATE} select outer_pix, state, n_events from last_state",
        "state_summary": f"with {_STATE}, {_UNIVERSE} select coalesce(state, 'pending') as state, count(*) as n_cells from universe left join last_state using (outer_pix) group by 1",
        "unfinished": f"with {_STATE}, {_UNIVERSE} select outer_pix from universe where outer_pix not in (select outer_pix from last_state where state in ('done', 'excluded', 'failed'))",
        "balance": held
        + """, run as (
  select outer_pix, weight, cast(sum(weight) over (order by outer_pix) - weight as bigint) as before, sum(weight) over () as total from held)
select outer_pix, weight, before, cast(least(floor(before*16/total), 15) as integer) as share from run""",
        "pass_compare": compare
        + """
select * from (
  select coalesce(a.outer_pix,b.outer_pix) as outer_pix, coalesce(a.inner_pix,b.inner_pix) as inner_pix,
    case when b.inner_pix is null then 'only_left' when a.inner_pix is null then 'only_right' when a.n_stars <> b.n_stars then 'changed' end as difference
  from inner_ a full outer join other_ b on a.outer_pix = b.outer_pix and a.inner_pix = b.inner_pix)
where difference is not null""",
        "manifest": f"""
select {_identity("60 + 10*r_regionkey")} as pass_id, 'guide-star-groups' as algorithm, '1' as algorithm_version, 'dr3' as release, 6 as outer_level, 'heuristic-1' as scorer, {LAYOUT_VERSION} as layout_version,
  cast(cast(60 + 10*r_regionkey as double) as varchar) as radius, true as open
from region""",
        "resumed_pass": _with(STARS, _guides(), _pairs(), TRIPLES, _groups(2), _pix("owncells", "stars", "gaia_ra", "gaia_dec", 6))
        + """
select outer_pix, rank, g1, g2 from (
  select outer_pix, cast(row_number() over (partition by outer_pix order by score desc, g1, g2) as integer) as rank, g1, g2
  from groups where max_side <= 120 and outer_pix in (select distinct pix from owncells))
where rank <= 5""",
        "inspected_pass": f"with {_STATE} select {_identity()} as pass_id, 'guide-star-groups' as algorithm, "
        + ", ".join(f"count(*) filter (where state = '{state}') as n_{state}" for state in STATES)
        + " from last_state",
    }
