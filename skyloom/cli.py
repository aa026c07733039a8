"""Command line over the Python API: plan, run, resume, bench, compact, inspect, compare. Every path is an argument."""

from __future__ import annotations

import argparse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="skyloom", description=__doc__)
    verbs = top.add_subparsers(dest="verb", required=True)
    for name in ("plan", "run", "resume", "bench", "compact", "inspect", "compare"):
        verb = verbs.add_parser(name)
        verb.add_argument("--root", required=True)
        if name in ("inspect", "compare"):
            verb.add_argument("--pass-id", required=True, nargs=2 if name == "compare" else 1)
        else:
            verb.add_argument("--release", default="dr3")
            verb.add_argument("--level", type=int, default=6)
        if name == "compact":
            verb.add_argument("--parent-level", type=int, default=5)
        elif name not in ("inspect", "compare"):
            verb.add_argument("--band", default="R")
            verb.add_argument("--radius", type=float, default=120.0)
            verb.add_argument("--batches", type=int, default=4)
            verb.add_argument("--retry-failed", action="store_true")
            verb.add_argument("--prewarm-bytes", type=int, default=0)
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    from pyspark.sql import SparkSession

    from .contracts import LoadRequest, SearchConfig
    from .plans import build
    from .sources import artifacts, grouped, stars

    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("skyloom").getOrCreate()
    if args.verb == "inspect":
        build.inspect(spark, args.root, args.pass_id[0]).show(truncate=False, vertical=True)
    elif args.verb == "compare":
        a, b = (artifacts.read_inner(spark, args.root, p) for p in args.pass_id)
        build.compare(a, b, ["outer_pix", "inner_pix"], ["n_stars", "brightest", "flux"]).groupBy("difference").count().show()
    elif args.verb == "compact":
        held = stars.read_stars(spark, args.root, args.release, args.level).drop("outer_pix")
        print("version", grouped.compact(held, args.root, args.release, args.parent_level))
    else:
        request = LoadRequest(release=args.release, outer_level=args.level, band=args.band)
        cfg = SearchConfig(radius_arcsec=args.radius, max_side_arcsec=args.radius, outer_level=args.level)
        pass_id = build.create_pass(spark, args.root, cfg, request)
        print(pass_id)
        if args.verb == "plan":
            universe = stars.read_stars(spark, args.root, args.release, args.level).select("outer_pix").distinct()
            build.unfinished(universe, build.latest(build.read_events(spark, args.root, pass_id)), args.retry_failed).groupBy().count().show()
        else:
            run = build.bench_run if args.verb == "bench" else build.run
            run(spark, args.root, pass_id, cfg, request, batches=args.batches, retry_failed=args.retry_failed, prewarm_bytes=args.prewarm_bytes).show()
            if args.verb == "bench":
                build.bench_summary(build.read_bench(spark, args.root, pass_id)).show()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
