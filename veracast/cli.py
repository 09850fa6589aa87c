"""Command line: build, rescore, validate, score-single, write-config."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession

from .config import PRESETS, deep_merge, load_config, write_default_config
from .plans.artifacts import Run
from .plans.single import score_against_store
from .sources.messages import single_message

MODES = ("build", "rescore", "validate", "score-single", "write-config")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veracast", description=__doc__)
    p.add_argument("mode", choices=MODES)
    p.add_argument("--config", help="JSON file laid over the defaults; for write-config, where to write them")
    p.add_argument("--preset", choices=sorted(PRESETS))
    for name in ("message", "author", "date", "language", "keywords", "theme", "url"):
        p.add_argument(f"--{name}")
    return p


def session() -> SparkSession:
    return SparkSession.builder.appName("veracast").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="[%(asctime)s] %(message)s", datefmt="%H:%M:%S")
    if args.mode == "write-config":
        print(write_default_config(args.config or "config.json"))
        return 0
    if args.mode == "score-single" and not args.message:
        raise SystemExit("score-single needs --message")
    config = load_config(args.config)
    run = Run(session(), deep_merge(config, PRESETS[args.preset]) if args.preset else config)
    if args.mode == "validate":
        run.validate()
        print("valid")
    elif args.mode in ("build", "rescore"):
        result = run.build() if args.mode == "build" else run.rescore()
        print(json.dumps(result["summary"].first().asDict(), default=str))
    else:
        run.validate()
        from .operators.messages import message_refs

        store, text, windows = (run.read(run.table(t)) for t in ("cleaned_messages", "text_clusters", "text_window_clusters"))
        row = single_message(run.spark, args.message, args.author, args.date, args.language, args.keywords, args.theme, args.url)
        out = score_against_store(row, text, windows, run.read(run.paths["author_scores"]), message_refs(store, text, windows, run.config), run.config)
        print(json.dumps(out.first().asDict(), default=str, indent=1))
    return 0
