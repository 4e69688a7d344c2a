"""Event patterns as filters, and message templates as columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_pattern(pattern: Mapping, prefix: str = "") -> Column:
    """A filter that wants every listed field to hold one of its listed values.

    Nested mappings reach into structs. ``-`` in a key is read as ``_``, since column names
    of the state-change feed use it (``detail-type`` -> ``detail_type``). The result is plain
    ``IN`` terms, so it reaches the file scan.
    """
    terms = []
    for key, wanted in pattern.items():
        path = f"{prefix}{key.replace('-', '_')}"
        if isinstance(wanted, Mapping):
            terms.append(event_pattern(wanted, f"{path}."))
        else:
            terms.append(F.col(path).isin(list(wanted)))
    return reduce(and_, terms) if terms else F.lit(True)


def message(template: str, values: Mapping[str, Column]) -> Column:
    """Fill the ``<name>`` slots of ``template``; a missing value leaves its slot empty."""
    pieces = re.split(r"<(\w+)>", template)
    parts = [
        F.coalesce(values[piece].cast("string"), F.lit("")) if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if piece
    ]
    return F.concat(*parts)


def json_paths(event: Column | str, paths: Mapping[str, str]) -> dict[str, Column]:
    """Named values picked from a JSON text column by JSON path."""
    return {name: F.get_json_object(event, path) for name, path in paths.items()}


# The failure notice of a pipeline.
PIPELINE_FAILED = "The Pipeline <pipeline> has failed."
PIPELINE_FAILED_PATHS = {"pipeline": "$.detail.pipeline"}


def failure_notice(event: Column | str) -> Column:
    """The notice text for a state-change event given as JSON text."""
    return message(PIPELINE_FAILED, json_paths(event, PIPELINE_FAILED_PATHS))
