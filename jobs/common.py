"""Command line and settings of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
import os
from collections.abc import Callable

from pyspark.sql import SparkSession


def read_config(path: str | None, defaults: dict) -> dict:
    """The settings of a small JSON file over the defaults; unknown names are refused."""
    given = {}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    if unknown := set(given) - set(defaults):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return defaults | given


def main(run: Callable, name: str, paths: dict[str, str], defaults: dict, argv: list[str] | None = None) -> None:
    """Reads the command line, starts a session, calls ``run(spark, config=..., **paths)`` and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    parser.add_argument("--config", default=os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"))
    for path, what in paths.items():
        parser.add_argument(f"--{path}", required=True, help=what)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = read_config(args.pop("config"), defaults)
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        run(spark, config=config, **args)
    finally:
        spark.stop()
