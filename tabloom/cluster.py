"""Makes the package importable in Python workers that weren't started from its folder."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
_MADE: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Give the package's sources to the session's workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tabloom-src-"), "tabloom_src.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("tabloom", os.path.relpath(full, here)))
    context.addPyFile(path)


def shared_folder(spark: SparkSession, kind: str) -> str:
    """The URI of a fresh place in the folder that the cluster shares (``spark.checkpoint.dir``).

    Only a local session may go without that setting: there driver and executors are one process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tabloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_clean)
    _MADE.append((spark, path))
    return path


def _clean() -> None:
    """What lies in the shared folder goes with the process that put it there."""
    for spark, path in _MADE:
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended: nothing is left to clean with
            return


@contextmanager
def cancellable(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """What runs inside can be stopped from another thread by the function that this gives; tasks are interrupted."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, "cancellable", interruptOnCancel=True)
    try:
        yield lambda: context.cancelJobGroup(group)
    finally:
        context._jsc.clearJobGroup()
