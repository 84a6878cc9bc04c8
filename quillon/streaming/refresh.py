"""A watched folder of code files and the valid set built from it.

A poll compares the folder's files, by path, size and time, with the poll before.
Two equal polls in a row that differ from what was loaded start a build.  Files
rewritten in place and files removed change the result, which Spark's file stream
source doesn't report, so the folder is listed by the driver.  A failed build keeps
the old codes and isn't tried again until the folder changes.  Readers get the valid
set as a whole: a new table is written, then the view is moved to it.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..operators.threshold import valid_codes
from ..sources.lines import list_files, read_sources
from ..sources.saved import read_saved, write_saved
from ..storage import release, write

#: Codes that are saved beside the files for a restart; the file and a restore go through the driver.
MAX_SAVED = 5_000_000
Snapshot = dict[str, tuple[int, int]]


@dataclass
class Load:
    """What a build or restore did."""

    files: list[str]
    codes: int
    seconds: float
    error: Exception | None = None
    restored: bool = False


@dataclass
class CouponRefresh:
    """Keeps ``view`` at the valid codes of ``folder``."""

    spark: SparkSession
    folder: str
    view: str = "valid_codes"
    min_files: int = 2
    interval: float = 2.0
    on_load: Callable[[Load], None] | None = None
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("quillon.refresh"))

    def __post_init__(self) -> None:
        self._before: Snapshot | None = None
        self._loaded: Snapshot | None = None
        self._valid: DataFrame | None = None
        self._paths: list[str | None] = []
        self.ready = False

    def valid(self) -> DataFrame:
        """The valid set of the last good load; empty before it."""
        return self._valid if self._valid is not None else self.spark.createDataFrame([], "code string")

    def is_valid(self, code: str) -> bool:
        return not self.valid().where(self.valid()["code"] == code).limit(1).isEmpty()

    def _swap(self, valid: DataFrame, path: str | None = None) -> None:
        """Move the view; the table before the last one goes, as a reader may still be at the last."""
        self._valid = valid
        valid.createOrReplaceTempView(self.view)
        self.ready = True
        self._paths.append(path)
        for old in self._paths[:-2]:
            if old:
                release(self.spark, old)
        del self._paths[:-2]

    def restore(self) -> bool:
        """Use the saved result if it was built from the files of now."""
        start = time.monotonic()
        now = list_files(self.folder)
        try:
            saved = read_saved(self.folder)
        except FileNotFoundError:
            return False
        except (ValueError, OSError) as e:
            self.logger.warning("ignore saved codes: %s", e)
            return False
        if not saved.matches(now, self.min_files):
            self.logger.info("saved codes are out of date, rebuilding")
            return False
        self._swap(self.spark.createDataFrame([(c,) for c in saved.codes], "code string"))
        self._before = self._loaded = now
        self._report(Load(sorted(now), len(saved.codes), time.monotonic() - start, restored=True))
        return True

    def poll(self) -> bool:
        """Look at the folder once; build if it has settled. Tells whether it built."""
        try:
            now = list_files(self.folder)
        except OSError as e:
            self.logger.error("scan %s: %s", self.folder, e)
            self._before = None
            return False
        # an empty folder at the start equals no poll before: nothing to wait for
        settled = now == (self._before or {}) if not now else now == self._before
        self._before = now
        if not settled or now == self._loaded:
            return False
        self._build(now)
        self._loaded = now
        return True

    def _build(self, now: Snapshot) -> None:
        start, files = time.monotonic(), sorted(now)
        try:
            path = write(valid_codes(read_sources(self.spark, files), self.min_files, len(files)), "valid-codes")
            valid = self.spark.read.schema("code string").parquet(path).orderBy("code")
            count = valid.count()
        except Exception as e:  # any failure of the job keeps the old set
            self.logger.error("load %s: %s", files, e)
            self._report(Load(files, 0, time.monotonic() - start, error=e))
            return
        self._swap(valid, path)
        try:
            if count <= MAX_SAVED:
                write_saved(self.folder, now, [r["code"] for r in valid.collect()], self.min_files)
            else:
                self.logger.warning("%d codes are too many for the saved file, which is left out", count)
        except OSError as e:
            self.logger.warning("save codes: %s", e)
        self._report(Load(files, count, time.monotonic() - start))

    def _report(self, load: Load) -> None:
        if self.on_load:
            self.on_load(load)

    def run(self, stop: threading.Event) -> None:
        """Restore, then poll until stopped."""
        self.restore()
        while not stop.is_set():
            self.poll()
            stop.wait(self.interval)
