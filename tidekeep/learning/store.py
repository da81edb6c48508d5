"""Saved models: a folder of versions with a pointer that is switched last.

``save`` writes a version under a name of its own and then switches the pointer, so a reader loads
the old model or the new one, whole, and a crash while writing leaves the old one in place. The
version before the current one stays for readers that have just followed the pointer.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

from ..sources import versions

Model = TypeVar("Model")


def save(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new version folder and make it the current one."""
    root, before = root.rstrip("/"), versions.current(spark, root) or {}
    name = f"model-{uuid.uuid4().hex}"
    write(f"{root}/{name}")
    versions.publish(spark, root, {"version": name, "before": before.get("version")})
    if before.get("before"):
        versions.remove(spark, f"{root}/{before['before']}")
    return name


def load(spark: SparkSession, root: str, read: Callable[[str], Model]) -> Model | None:
    """The current version by ``read``, or None where none was saved, so callers fall back."""
    state = versions.current(spark, root)
    return None if state is None else read(f"{root.rstrip('/')}/{state['version']}")
