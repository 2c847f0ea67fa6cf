"""Run one stage: ``spark-submit --py-files ... -m framelake <stage>`` or ``python -m framelake``."""

from __future__ import annotations

import argparse
import sys

from .operators.heads import list_heads
from .operators.integrity import generate_manifest
from .plans import jobs
from .session import TableError, build_session


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="framelake", description="Stages from raw files to submission")
    stages = top.add_subparsers(dest="stage", required=True)

    stage = stages.add_parser("generate-manifest", help="hash raw files into a manifest")
    stage.add_argument("--root", required=True)
    stage.add_argument("--out", required=True)

    stage = stages.add_parser("verify-data", help="hash the listed files again and compare")
    stage.add_argument("--manifest", required=True)
    stage.add_argument("--root", required=True)

    stage = stages.add_parser("window", help="raw files to normalised frames")
    stage.add_argument("--root", required=True)
    stage.add_argument("--out", required=True)
    stage.add_argument("--scope", choices=("train", "frame"), default="train")

    stage = stages.add_parser("embed", help="frames to cached vectors (built-in statistics)")
    stage.add_argument("--frames", required=True)
    stage.add_argument("--fm", required=True)
    stage.add_argument("--revision", required=True)
    stage.add_argument("--root")

    stage = stages.add_parser("train-head", help="fit a head, score it, log the run")
    stage.add_argument("--fm", required=True)
    stage.add_argument("--head", default="logreg", choices=list_heads())
    stage.add_argument("--revision")
    stage.add_argument("--seed", type=int, default=0)
    stage.add_argument("--experiment", default="cli")
    stage.add_argument("--root")
    stage.add_argument("--store")
    stage.add_argument("--out", default="runs/head")
    stage.add_argument("--tag", action="append", default=[], metavar="NAME=VALUE")

    stage = stages.add_parser("predict", help="apply a saved head to the test split")
    stage.add_argument("--head-path", required=True)
    stage.add_argument("--revision")
    stage.add_argument("--root")
    stage.add_argument("--out", default="runs/test_frame_predictions")

    stage = stages.add_parser("format-submission", help="write and check the matrix")
    stage.add_argument("predictions")
    stage.add_argument("--out", default="teamName_predictions")
    stage.add_argument("--text", action="store_true", help="predictions are text, any number per line")
    stage.add_argument("--store")
    stage.add_argument("--experiment", default="cli")
    stage.add_argument("--tag", action="append", default=[], metavar="NAME=VALUE")
    return top


def main(argv: list[str] | None = None) -> int:
    args = vars(parser().parse_args(argv))
    stage = args.pop("stage")
    if "tag" in args:
        args["tags"] = dict(t.partition("=")[::2] for t in args.pop("tag"))
    spark = build_session(f"framelake {stage}")
    try:
        if stage == "generate-manifest":
            print(f"wrote {args['out']} ({generate_manifest(spark, **args)} files)")
        elif stage == "verify-data":
            print(f"OK: {jobs.verify_raw(spark, **args)} files match")
        elif stage == "window":
            jobs.window_features(spark, args["root"], args["out"], scope=args["scope"])
        elif stage == "embed":
            jobs.frozen_embeddings(spark, args.pop("frames"), **args)
        elif stage == "train-head":
            print(jobs.train_head(spark, args.pop("fm"), args.pop("head"), **args)[1].summary())
        elif stage == "predict":
            print(f"predicted {jobs.predict_test(spark, **args).count()} frames -> {args['out']}")
        else:
            report = jobs.format_submission(spark, args.pop("predictions"), args.pop("out"), **args)
            print(f"wrote {report.path}: {report.n_rows}x{report.n_cols} ok={report.ok}")
    except TableError as exc:
        for row in exc.rows.toLocalIterator():
            print("FAIL:", *[v for v in row if v is not None], file=sys.stderr)
        print(f"FAIL: {exc}", file=sys.stderr)
        return 1
    except (ValueError, FileNotFoundError) as exc:
        print(f"FAIL: {exc}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
