"""Start and end of a session, and its settings."""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .errors import FailedPrecondition, InvalidArgument

VERSION = "0.1.0"
LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "fatal": logging.CRITICAL}


@dataclass
class Config:
    app_name: str = "stratavec"
    master: str = ""
    log_level: str = "info"
    log_file: str = ""
    memory_limit_mb: int = 0
    #: Kept; Spark schedules threads and chooses scans itself.
    query_threads: int = 0
    optimize_threads: int = 0
    invert_to_forward_scan_ratio: float = 0.0
    brute_force_by_keys_ratio: float = 0.0
    fts_brute_force_by_keys_ratio: float = 0.0
    jieba_dict_dir: str = ""

    def validate(self) -> None:
        for name in ("invert_to_forward_scan_ratio", "brute_force_by_keys_ratio", "fts_brute_force_by_keys_ratio"):
            if not 0 <= getattr(self, name) <= 1:
                raise InvalidArgument(f"{name} must be in [0, 1]")
        if self.log_level not in LEVELS:
            raise InvalidArgument(f"unknown log level {self.log_level!r}")


_now: Config | None = None


def init(config: Config | None = None) -> SparkSession:
    """The session, with adaptive execution; fails if it is on already."""
    global _now
    if _now is not None:
        raise FailedPrecondition("already initialized")
    config = config or Config()
    config.validate()
    log = logging.getLogger("stratavec")
    log.setLevel(LEVELS[config.log_level])
    log.addHandler(logging.FileHandler(config.log_file) if config.log_file else logging.StreamHandler())
    builder = SparkSession.builder.appName(config.app_name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if config.master:
        builder = builder.master(config.master)
    if config.memory_limit_mb:
        builder = builder.config("spark.driver.memory", f"{config.memory_limit_mb}m")
    _now = config
    return builder.getOrCreate()


def shutdown() -> None:
    global _now
    for h in list(logging.getLogger("stratavec").handlers):
        logging.getLogger("stratavec").removeHandler(h)
        h.close()
    _now = None


def is_initialized() -> bool:
    return _now is not None


def current() -> Config:
    return _now or Config()


def version() -> str:
    return VERSION
