"""Path globs, shared by discovery and the embedding rules."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A Java regex for a shell glob; '*' crosses '/', so '*' and '**' agree."""
    regex = fnmatch.translate(pattern)
    return "^" + regex.removesuffix(r"\Z").removesuffix(r"\z") + r"\z"


def any_glob(path: Column, globs: Iterable[str]) -> Column:
    return reduce(or_, [path.rlike(glob_regex(g)) for g in globs], F.lit(False))


def selected(path: Column, include: Iterable[str], exclude: Iterable[str]) -> Column:
    """Within ``include`` (everything when empty) and outside ``exclude``."""
    include = tuple(include)
    return (any_glob(path, include) if include else F.lit(True)) & ~any_glob(path, exclude)
