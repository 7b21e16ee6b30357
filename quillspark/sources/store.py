"""The index as versioned Parquet tables: a new version is written beside the old one, then a pointer file is replaced."""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import time
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..errors import StoreBusyError
from .config import MEMORY

SCHEMA_VERSION = 2
POINTER, LOCK = "_CURRENT", "_LOCK"
TABLES = ("documents", "sections", "tags", "links", "postings", "lengths", "section_postings", "section_lengths")


class Store:
    """Tables by name. In memory they are cached data frames; on disk a version is complete or isn't seen."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.held: dict[str, DataFrame] = {}
        self.meta: dict = {}
        self._load()

    def _load(self) -> None:
        if self.path == MEMORY:
            return
        try:
            meta = json.loads((Path(self.path) / POINTER).read_text())
            if meta.get("schema_version") != SCHEMA_VERSION:
                raise ValueError("another schema")
            held = {t: self.spark.read.parquet(f"{self.path}/{meta['version']}/{t}") for t in TABLES}
        except (FileNotFoundError, NotADirectoryError, ValueError, KeyError, AnalysisException):  # missing, broken or of another schema: it is built anew; other errors are the caller's
            self.held, self.meta = {}, {}
            return
        self.held, self.meta = held, meta

    @contextmanager
    def locked(self, wait: float = 30.0) -> Iterator[None]:
        """One writer at a time; the tables are those of the last writer. Waits for so many seconds."""
        if self.path == MEMORY:
            yield
            return
        Path(self.path).mkdir(parents=True, exist_ok=True)
        with open(Path(self.path) / LOCK, "w") as f:
            until = time.monotonic() + wait
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() > until:
                        raise StoreBusyError(f"another process is writing {self.path}") from None
                    time.sleep(0.05)
            version = self.meta.get("version")
            if self._stored_version() != version:
                self._load()
            yield

    def _stored_version(self) -> str | None:
        try:
            return json.loads((Path(self.path) / POINTER).read_text()).get("version")
        except (OSError, ValueError):
            return None

    def __bool__(self) -> bool:
        return bool(self.held)

    def __getitem__(self, name: str) -> DataFrame:
        return self.held[name]

    def publish(self, tables: dict[str, DataFrame], **meta) -> None:
        old = self.meta.get("version")
        if self.path == MEMORY:
            fresh = {n: df.cache() for n, df in tables.items()}
            for df in fresh.values():
                df.count()
            self.held, self.meta = fresh, {"schema_version": SCHEMA_VERSION, "version": "memory", **meta}
            return
        version = f"v{int(old[1:]) + 1 if old else 1}"
        base = Path(self.path)
        shutil.rmtree(base / version, ignore_errors=True)
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{version}/{name}")
        new = {"schema_version": SCHEMA_VERSION, "version": version, **meta}
        temporary = base / f"{POINTER}.new"
        temporary.write_text(json.dumps(new))
        os.replace(temporary, base / POINTER)
        self._load()
        for stale in base.glob("v*"):
            if stale.name not in (version, old):  # the last version stays for readers that have it open
                shutil.rmtree(stale, ignore_errors=True)

    def note(self, **meta) -> None:
        """New metadata for the same tables."""
        self.meta |= meta
        if self.path != MEMORY and self.held:
            temporary = Path(self.path) / f"{POINTER}.new"
            temporary.write_text(json.dumps(self.meta))
            os.replace(temporary, Path(self.path) / POINTER)
