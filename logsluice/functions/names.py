"""Column naming for flattened records."""

from __future__ import annotations

import re

_WORD_STARTS = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def snake_case(path: str) -> str:
    """``a.bCd`` -> ``a_b_cd`` style name: every part split into words, joined by ``_``.

    Runs of capitals stay one word (``sourceIPAddress`` -> ``source_ip_address``).
    """
    return "_".join(_WORD_STARTS.sub("_", part).lower() for part in path.split("."))
