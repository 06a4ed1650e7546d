"""Settings from the environment and an optional .env file; what the shell sets wins."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession

PREFIX = "LOOMGRAPH_"


def load_env(path: str | Path = ".env") -> dict[str, str]:
    """Put the file's KEY=value lines into the environment where a key isn't set; what was put in."""
    put: dict[str, str] = {}
    p = Path(path)
    for line in p.read_text().splitlines() if p.is_file() else ():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        key = key.strip()
        if eq and key and not key.startswith("#") and key not in os.environ:
            os.environ[key] = put[key] = value.strip().strip("'\"")
    return put


@dataclass(frozen=True)
class Config:
    store: str = ""
    shuffle_partitions: int | None = None

    @classmethod
    def from_env(cls) -> Config:
        n = os.environ.get(f"{PREFIX}SHUFFLE_PARTITIONS")
        return cls(os.environ.get(f"{PREFIX}STORE", ""), int(n) if n else None)

    @property
    def configured(self) -> bool:
        return bool(self.store)

    def describe(self) -> str:
        return f"store {self.store or 'not set'}"


def session(config: Config | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; everything else is left to the cluster."""
    config = config or Config.from_env()
    b = SparkSession.builder.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    if config.shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(config.shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
