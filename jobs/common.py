"""What the jobs share: their configuration, their logging, and the session of their command lines."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import Observation, SparkSession

log = logging.getLogger("jobs")


def config(path: str | None, defaults: str) -> dict:
    """The defaults beside the job, and over them what the file at ``path`` says; an unknown key is an error."""
    found = json.loads((Path(__file__).parent / defaults).read_text(encoding="utf-8"))
    own = json.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    if unknown := sorted(own.keys() - found.keys()):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return found | own


def observed(rows: Observation) -> int:
    """The number ``n`` of an observation; 0 where Spark left an empty plan out, and the observation with it."""
    try:
        return rows.get["n"]
    except Py4JJavaError:
        return 0


def main(name: str, defaults: str, paths: dict[str, str], run: Callable[..., dict], argv: list[str] | None = None) -> int:
    """Takes a path for each of ``paths`` (name and help), makes a session, runs, logs, and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", help=f"JSON file with other settings than jobs/{defaults}")
    given = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(given.config, defaults)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **{p: getattr(given, p) for p in paths}, settings=settings)
    finally:
        spark.stop()
    return 0
