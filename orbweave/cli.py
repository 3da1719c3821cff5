"""Commands: plan, order, mosaic, classify train | predict | smooth, distance."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from .session import local_session

USAGE = "usage: orbweave {plan,order,mosaic,classify,distance} ..."


def _blank(text: str | None) -> str | None:
    return text.strip() or None if text else None


def plan_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("orbweave plan")
    p.add_argument("--catalog", required=True, help="Parquet catalog of scenes")
    p.add_argument("--aoi", required=True)
    p.add_argument("--start", required=True)
    p.add_argument("--end", required=True)
    p.add_argument("--item-type", default="PSScene")
    p.add_argument("--collection")
    p.add_argument("--imagery-type", default="planetscope")
    p.add_argument("--instrument-type", action="append")
    p.add_argument("--cloud-max", type=float, default=0.1)
    p.add_argument("--sun-elev-min", type=float, default=35.0)
    p.add_argument("--coverage-target", type=float, default=0.98)
    p.add_argument("--min-clear-fraction", type=float, default=0.8)
    p.add_argument("--min-clear-obs", type=float, default=3.0)
    p.add_argument("--azimuth-sigma", type=float, default=20.0)
    p.add_argument("--elevation-sigma", type=float, default=10.0)
    p.add_argument("--require-ground-control", action="store_true")
    p.add_argument("--quality-category", default="none")
    p.add_argument("--publishing-stage", default="none")
    p.add_argument("--max-view-angle", type=float)
    p.add_argument("--quality-weight", type=float, default=0.35)
    p.add_argument("--tile-size-m", type=int, default=1000)
    p.add_argument("--limit", type=int)
    p.add_argument("--out")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def parse_plan(argv: Sequence[str]) -> argparse.Namespace:
    parser = plan_parser()
    args = parser.parse_args(argv)
    if args.item_type == "PSScene" and (args.imagery_type or "").lower() in ("planetscope", "") and not args.instrument_type:
        parser.error("--instrument-type is required for PSScene: PS2, PS2.SD, PSB.SD or none")
    return args


def plan(argv: Sequence[str]) -> int:
    from .plans import planner

    a = parse_plan(argv)
    kinds = [k for k in a.instrument_type or [] if k.lower() != "none"] or None
    imagery = None if (a.imagery_type or "none").lower() == "none" else a.imagery_type
    spark = local_session()
    found = planner.plan_monthly_composites(a.aoi, a.start, a.end, a.item_type, a.collection, imagery, kinds, a.cloud_max, a.sun_elev_min, a.coverage_target, a.min_clear_fraction, a.min_clear_obs, a.azimuth_sigma, a.elevation_sigma, a.require_ground_control, a.quality_category, a.publishing_stage, a.max_view_angle, a.quality_weight, "calendar", a.limit, a.tile_size_m, catalog=spark.read.parquet(a.catalog))
    if a.out:
        planner.write_plan(found, a.out)
    print(planner.summary(found))
    return 0


def order_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("orbweave order")
    p.add_argument("--plan", required=True)
    p.add_argument("--aoi", required=True)
    p.add_argument("--catalog", help="Parquet catalog of scenes, for replacements")
    p.add_argument("--outbox", default="orders.jsonl", help="file that requests are written to")
    p.add_argument("--sr-bands", type=int, choices=(4, 8), default=4)
    p.add_argument("--harmonize-to", choices=("sentinel2", "none"), default="none")
    p.add_argument("--order-prefix", default="plan")
    p.add_argument("--archive-type", default="zip")
    p.add_argument("--single-archive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def order(argv: Sequence[str]) -> int:
    from .plans import orders

    a = order_parser().parse_args(argv)
    catalog = local_session().read.parquet(a.catalog) if a.catalog else None
    print(orders.summary(orders.submit_orders_for_plan(a.plan, a.aoi, a.sr_bands, a.harmonize_to, a.order_prefix, _blank(a.archive_type), a.single_archive, client=orders.Outbox(a.outbox), catalog=catalog)))
    return 0


def mosaic_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("orbweave mosaic")
    p.add_argument("--inputs", nargs="+", required=True)
    p.add_argument("--udms", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--workdir")
    p.add_argument("--tmpdir")
    p.add_argument("--ram", type=int, default=131072)
    p.add_argument("--jobs", type=int, default=4)
    p.add_argument("--skip-masking", action="store_true")
    p.add_argument("--sr-bands", type=int, choices=(4, 8), default=4)
    p.add_argument("--ndvi", action="store_true")
    p.add_argument("--target-crs")
    p.add_argument("-v", "--verbose", action="count", default=0)
    return p


def mosaic(argv: Sequence[str]) -> int:
    from .plans import mosaic as M

    a = mosaic_parser().parse_args(argv)
    print(M.run_mosaic(M.MosaicJob(a.inputs, a.output, a.udms, _blank(a.workdir), _blank(a.tmpdir), a.ram, a.jobs, a.skip_masking, a.sr_bands, a.ndvi, _blank(a.target_crs)), local_session()))
    return 0


def _smoothing(p: argparse.ArgumentParser, default: str) -> None:
    p.add_argument("--smooth", choices=("none", "mrf", "bayes"), default=default)
    p.add_argument("--beta", type=float, default=1.0)
    p.add_argument("--neighborhood", type=int, choices=(4, 8), default=4)
    p.add_argument("--icm-iters", type=int, default=3)
    p.add_argument("--bayes-window-size", type=int, default=7)
    p.add_argument("--bayes-neigh-fraction", type=float, default=0.5)
    p.add_argument("--bayes-smoothness", type=float, default=20.0)
    p.add_argument("--block-overlap", type=int)
    p.add_argument("--block-shape", type=int, nargs=2)
    p.add_argument("--jobs", type=int, default=1)


def classify_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("orbweave classify")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("train")
    p.add_argument("--image", nargs="+", action="append", required=True)
    p.add_argument("--band-indices", type=int, nargs="+")
    p.add_argument("--labels", required=True)
    p.add_argument("--label-column", required=True)
    p.add_argument("--model-out", required=True)
    p.add_argument("--n-estimators", type=int, default=500)
    p.add_argument("--max-depth", type=int)
    p.add_argument("--jobs", type=int, default=1)
    p.add_argument("--test-fraction", type=float, default=0.3)
    p.add_argument("--grid-size", type=int)
    p = sub.add_parser("predict")
    p.add_argument("--image", nargs="+", action="append", required=True)
    p.add_argument("--band-indices", type=int, nargs="+")
    p.add_argument("--model", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--probs-out")
    p.add_argument("--binary-out")
    _smoothing(p, "none")
    p = sub.add_parser("smooth")
    p.add_argument("--probs", required=True)
    p.add_argument("--output", required=True)
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--model")
    which.add_argument("--class-values", type=float, nargs="+")
    _smoothing(p, "mrf")
    return top


def classify(argv: Sequence[str]) -> int:
    from .plans import classify as K

    a = classify_parser().parse_args(argv)
    spark = local_session()
    images = [x for run in getattr(a, "image", None) or [] for x in run]
    if a.command == "train":
        K.train_rf(images, a.labels, a.label_column, a.model_out, a.n_estimators, a.max_depth, a.jobs, test_fraction=a.test_fraction, grid_size=a.grid_size, band_indices=a.band_indices, spark=spark)
        return 0
    more = dict(beta=a.beta, neighborhood=a.neighborhood, icm_iters=a.icm_iters, bayes_window_size=a.bayes_window_size, bayes_neigh_fraction=a.bayes_neigh_fraction, bayes_smoothness=a.bayes_smoothness)
    shape = tuple(a.block_shape) if a.block_shape else None
    if a.command == "predict":
        print(K.predict_rf(images, a.model, a.output, a.probs_out, a.binary_out, shape, a.band_indices, a.smooth, a.block_overlap, a.jobs, spark=spark, **more))
    else:
        print(K.smooth_probs(a.probs, a.output, a.model, a.class_values, shape, a.smooth, a.block_overlap, a.jobs, spark=spark, **more))
    return 0


def distance(argv: Sequence[str]) -> int:
    from .plans import classify as K

    p = argparse.ArgumentParser("orbweave distance")
    p.add_argument("--vector", required=True)
    p.add_argument("--template", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--backend", choices=("cpu", "gpu"), default="cpu")
    a = p.parse_args(argv)
    print(K.distance_to_vector(a.vector, a.template, a.output, a.backend, spark=local_session()))
    return 0


COMMANDS = {"plan": plan, "order": order, "mosaic": mosaic, "classify": classify, "distance": distance}


def main(argv: Sequence[str] | None = None) -> int:
    args = list(sys.argv[1:] if argv is None else argv)
    if args and args[0] in ("-h", "--help"):
        print(USAGE)
        return 0
    if not args or args[0] not in COMMANDS:
        print(USAGE, file=sys.stderr)
        return 2
    loud = sum(a == "--verbose" or (a[:1] == "-" and set(a[1:]) == {"v"}) * (len(a) - 1) for a in args)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(loud, 2)])
    return COMMANDS[args[0]](args[1:])


if __name__ == "__main__":
    sys.exit(main())
