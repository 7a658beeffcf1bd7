"""Connected components of any graph."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.relationship import connected
from ..sources.shared import kept, shared_path, with_folder

__all__ = ["kept", "labelled", "shared_path"]


def labelled(edges: DataFrame) -> DataFrame:
    return connected(with_folder(edges))
