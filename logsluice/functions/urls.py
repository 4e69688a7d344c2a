"""Parts of a URL by delimiter, and the service in front of a dotted name."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(column: Column | str) -> Column:
    """The third ``/``-separated part: ``https://host/path`` -> ``host``."""
    return F.get(F.split(column, "/"), 2)


def url_after(column: Column | str, marker: str) -> Column:
    """The part between the first and second ``marker``, with a leading ``/``."""
    return F.concat(F.lit("/"), F.get(F.split(column, re.escape(marker)), 1))


def before_first_dot(column: Column | str) -> Column:
    """``service.domain`` -> ``service``."""
    return F.substring_index(column, ".", 1)
