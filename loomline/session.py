"""Session settings that the engine is meant to run with."""

from __future__ import annotations

import logging
import tempfile
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "128m",
}


def session(name: str = "loomline", **more: str) -> SparkSession:
    """A session with adaptive execution; partition numbers are left to it."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | more).getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; only a session on one machine (tests) may leave it unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/loomline-checkpoints"


@contextmanager
def timed(what: str, log: logging.Logger | None = None) -> Iterator[dict]:
    """Logs how long the block took; the dict gets it as `seconds`."""
    out: dict = {}
    began = time.perf_counter()
    try:
        yield out
    finally:
        out["seconds"] = time.perf_counter() - began
        (log or logging.getLogger("loomline")).info("%s: %.2f s", what, out["seconds"])


def file_logger(path: str) -> logging.Logger:
    """The engine's log, to a file and to the console."""
    log = logging.getLogger("loomline")
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    if not log.handlers:
        for h in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
            h.setFormatter(form)
            log.addHandler(h)
    return log
