"""Log-folder layouts: which globs to list, and which key values a path carries."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsluice.schemas import DELIVERED_KEYS

_TO_THE_END = 2**31 - 1


@dataclass(frozen=True)
class Layout:
    """Where a log tree keeps a delivery day.

    ``folders`` names the folders between the root and the day, with a ``%s`` for the account
    and one for the region. ``day_format`` and ``month_format`` are strftime patterns.
    ``pattern`` is what a folder path must look like for its last folders to be ``keys``, which
    are plain values or ``key=value``.
    """

    folders: str
    day_format: str
    month_format: str
    pattern: str
    named: bool = False
    keys: tuple[str, ...] = DELIVERED_KEYS

    def folder(self, root: str, account: Column, region: Column, day: date) -> Column:
        """One account's and region's folder for ``day``, with a trailing ``/``."""
        below = F.format_string(self.folders, account, region)
        return F.concat(F.lit(f"{root.rstrip('/')}/"), below, F.lit(f"/{day.strftime(self.day_format)}/"))

    def _any_folder(self) -> str:
        return self.folders % ("*", "*")

    def glob(self, root: str) -> str:
        """Every delivery day below ``root``."""
        days = "/".join("*" for _ in self.day_format.split("/"))
        return f"{root.rstrip('/')}/{self._any_folder()}/{days}"

    def days_glob(self, root: str, days: Iterable[date]) -> str:
        """Only the given delivery days; other days are never listed."""
        names = ",".join(sorted({d.strftime(self.day_format) for d in days}))
        return f"{root.rstrip('/')}/{self._any_folder()}/{{{names}}}"

    def months_glob(self, root: str) -> str:
        """The folders of delivery months, for finding out which there are."""
        return f"{root.rstrip('/')}/{self._any_folder()}/*/*"

    def named_month_glob(self, root: str, year: str, month: str) -> str:
        """The delivery days below month folders of these names."""
        return f"{root.rstrip('/')}/{self._any_folder()}/{year}/{month}/*"

    def any_folder(self, root: str) -> str:
        """The region folders of every account."""
        return f"{root.rstrip('/')}/{self._any_folder()}"

    def month_glob(self, root: str, year: int, month: int) -> str:
        """Only the delivery days of one month."""
        return f"{root.rstrip('/')}/{self._any_folder()}/{date(year, month, 1).strftime(self.month_format)}"


# The audit service's own folder names and order.
LOG_FOLDER = "CloudTrail"
DIGEST_FOLDER = "CloudTrail-Digest"
ACCOUNT_LAYOUT = Layout(
    folders=f"%s/{LOG_FOLDER}/%s",
    day_format="%Y/%m/%d",
    month_format="%Y/%m/*",
    pattern=rf"^(?:.*/)?[^/]+/{LOG_FOLDER}[^/]*/[^/]+/\d{{4}}/\d{{2}}/\d{{2}}/?$",
)

# The same keys in ``key=value`` folders, which is how Spark itself lays a tree out.
HIVE_LAYOUT = Layout(
    folders=f"accountid=%s/type={LOG_FOLDER}/region=%s",
    day_format="year=%Y/month=%m/day=%d",
    month_format="year=%Y/month=%m/*",
    pattern=(
        rf"^(?:.*/)?accountid=[^/]+/type={LOG_FOLDER}[^/]*/region=[^/]+"
        r"/year=\d{4}/month=\d{2}/day=\d{2}/?$"
    ),
    named=True,
)


def with_path_values(frame: DataFrame, path: str, layout: Layout = ACCOUNT_LAYOUT) -> DataFrame:
    """Add one column per layout key, counted from the right end of ``path``.

    All are NULL when the path does not fit. A path is matched and split once for all keys.
    """
    folders = F.split(F.rtrim(path, F.lit("/")), "/")
    fitting = frame.withColumn("_folders", F.when(F.col(path).rlike(layout.pattern), folders))

    def value(n: int, key: str) -> Column:
        folder = F.element_at("_folders", n - len(layout.keys))
        return unescaped(F.substring(folder, len(key) + 2, _TO_THE_END)) if layout.named else folder

    return fitting.withColumns({k: value(n, k) for n, k in enumerate(layout.keys)}).drop("_folders")


def unescaped(value: Column) -> Column:
    """A value as ``key=value`` folders and partition lists escape it; unlike in forms, ``+`` is itself there."""
    return F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def scanned_file() -> Column:
    """Path of the file a row was read from, as the store spells it."""
    path = F.col("_metadata.file_path")
    return F.coalesce(unescaped(path), path)


def folder_of(path: Column | str) -> Column:
    """The folder of a file path, with a trailing ``/``."""
    return F.regexp_replace(path, "[^/]*$", "")


def is_digest(path: Column | str) -> Column:
    """True for paths below the digest folder."""
    path = F.col(path) if isinstance(path, str) else path
    return path.contains(DIGEST_FOLDER)


def recent_days(as_of: date, days: int = 1) -> list[date]:
    """``as_of`` and the ``days`` days before it."""
    return [as_of - timedelta(days=n) for n in range(days + 1)]
