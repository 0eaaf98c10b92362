"""A job's log, a file for each run. Reasons for failed documents are data as well, in the job's table of failures."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

# Fixed value: what ``sources.files.read_log`` reads
FORMAT = "%(asctime)s - %(name)s - %(levelname)s - %(message)s"


@contextmanager
def job_log(job: str, directory: str | None = None) -> Iterator[logging.Logger]:
    """The logger of one run of ``job``; with a ``directory`` on the driver its messages also go to a file there."""
    log = logging.getLogger(f"folioweave.{job}")
    if directory is None:
        yield log
        return
    Path(directory).mkdir(parents=True, exist_ok=True)
    file = logging.FileHandler(Path(directory) / f"{job}-{datetime.now():%Y%m%dT%H%M%S%f}.log", encoding="utf-8")
    file.setFormatter(logging.Formatter(FORMAT))
    before = log.level
    log.setLevel(logging.INFO)
    log.addHandler(file)
    try:
        yield log
    finally:
        log.removeHandler(file)
        log.setLevel(before)
        file.close()
