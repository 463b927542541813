"""Command line: plan, run or undo. Exit codes: 0 done, 1 failed or nothing there, 2 refused, 130 interrupted."""

from __future__ import annotations

import argparse
import datetime
import os
import sys

from pyspark.sql import SparkSession

from ..functions import labels, templates
from . import execution, planner
from .options import from_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filmcrate", description="Sorts pictures and videos into dated folders.")
    p.add_argument("folder")
    p.add_argument("--dest", default="")
    p.add_argument("--settings", default="")
    p.add_argument("--pattern", default="")
    p.add_argument("--snapshot", default="", help="folder that remembers what was read, for the next time")
    for flag in ("copy", "dry-run", "undo", "use-mtime", "include-nodate", "convert-heic", "heic-only", "dedupe", "similar", "progress"):
        p.add_argument(f"--{flag}", action="store_true")
    return p


def _told(done: int, total: int) -> None:
    print(f"\r{done}/{total} tasks", end="", file=sys.stderr, flush=True)


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    root = os.path.abspath(args.folder)
    if not os.path.isdir(root):
        print(f"no folder: {root}", file=sys.stderr)
        return 2
    if args.undo:
        dest = os.path.abspath(args.dest) if args.dest else root
        own = execution.find_log(root) or execution.find_log(dest)
        got = execution.undo(own, other_logs=tuple(execution.candidate_logs(root, dest)))
        for path, why in got.skipped:
            print(f"{path}: {why}", file=sys.stderr)
        return 1 if got.nothing or got.blocked_by or got.log_error or got.skipped else 0
    if args.pattern and (wrong := templates.template_problem(args.pattern)):
        print(f"{wrong}: {args.pattern}", file=sys.stderr)
        return 2
    settings = labels.read_settings(args.settings) if args.settings else labels.coerce_settings({})
    settings |= {k: True for k in ("use_mtime", "include_nodate") if getattr(args, k)}
    settings |= {"pattern": args.pattern} if args.pattern else {}
    dest = os.path.abspath(args.dest) if args.dest else root
    if args.copy and dest.lower() == root.lower():
        print("a copy needs another folder", file=sys.stderr)
        return 2
    opts = from_settings(settings | {"dest": ""}, root, dest, "copy" if args.copy else "move", args.heic_only, args.convert_heic or args.heic_only, now=datetime.datetime.now(), time_zone=spark._jvm.java.util.TimeZone.getDefault().getID())
    plan = planner.make_plan(spark, opts, args.dedupe or args.similar, threshold=settings["similar_threshold"] if args.similar else None, snapshot=args.snapshot, progress=_told if args.progress else None)
    for rows, what in ((plan.cloud, "only in the cloud, left out"), (plan.denied, "folder cannot be listed")):
        for row in rows.orderBy("path").toLocalIterator():
            print(f"{row['path']}: {what}", file=sys.stderr)
    if plan.opened is not None:
        print(f"{plan.opened} files read")
    if not plan.items.head(1):
        print("no media files")
        return 1
    for line in planner.printed(plan.items, opts).orderBy("item_idx").toLocalIterator():
        print(line["line"])
    n_folders = plan.empty_dirs.count()
    print(planner.summary(plan.items, n_folders).first().asDict())
    if planner.blocked_groups(plan.items).head(1):
        print("every member of a group would leave", file=sys.stderr)
        return 2
    if args.dry_run:
        return 0
    if (need := planner.space_need(plan.items, opts.mode).first()["need"]) > execution.free_space(plan):
        print(f"{need} bytes needed", file=sys.stderr)
        return 1
    try:
        done = execution.execute(plan, quality=settings["quality"], icc=settings["icc"])
    except OSError as exc:
        print(exc, file=sys.stderr)
        return 1
    for path, why in done.failed:
        print(f"{path}: {why}", file=sys.stderr)
    for path, what in done.notes:
        print(f"{path}: {what}")
    print(f"{done.done} moved, {done.converted} converted, log {done.log_path or '-'}")
    return 1 if done.failed else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("filmcrate").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, args)
    except KeyboardInterrupt:
        return 130


__all__ = ["main", "parser", "run"]
