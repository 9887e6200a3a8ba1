"""Which files of which roots are read, and why others are not."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Directories that are never walked, besides those whose name begins with a dot.
EXCLUDED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", ".eggs", "vendor")
VCS = (".git", ".hg", ".svn")


def glob_regex(pattern: str) -> re.Pattern:
    """'*' and '?' stay within a path part, '**' crosses parts."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i]))
            i += 1
    return re.compile(f"{out}(?:/.*)?")


def matches(path: str, patterns: tuple[str, ...]) -> bool:
    """A pattern matches a path, any of its directories, or (without '/') any part's name."""
    for pattern in patterns:
        if glob_regex(pattern).fullmatch(path) or "/" not in pattern and any(glob_regex(pattern).fullmatch(part) for part in path.split("/")):
            return True
    return False


@dataclass(frozen=True)
class SourcePolicy:
    """Ordered roots with exclude and include globs; an include overrides an exclude."""

    roots: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] = ()

    def discover(self, spark: SparkSession) -> DataFrame:
        """(root, path, status, reason): a row a file or pruned directory; a file reached twice belongs to the first root."""
        rows, seen = [], set()
        for root in self.roots:
            top = os.path.realpath(root)
            for folder, dirs, files in os.walk(top):
                at = lambda name: os.path.relpath(os.path.join(folder, name), top).replace(os.sep, "/")  # noqa: B023, E731
                keep = []
                for d in sorted(dirs):
                    path = at(d)
                    if os.path.islink(os.path.join(folder, d)):
                        rows.append((root, path, "skipped", "symlink_directory"))
                    elif d in VCS:
                        rows.append((root, path, "skipped", "vcs_directory"))
                    elif (d in EXCLUDED or d.startswith(".")) and not matches(path, self.include):
                        rows.append((root, path, "skipped", "default_directory"))
                    elif matches(path, self.exclude) and not self.include:
                        rows.append((root, path, "skipped", "excluded_pattern"))
                    else:
                        keep.append(d)
                dirs[:] = keep
                for f in sorted(files):
                    path, real = at(f), os.path.realpath(os.path.join(folder, f))
                    if not real.startswith(top + os.sep) and real != top:
                        rows.append((root, path, "skipped", "symlink_out_of_root"))
                    elif real in seen:
                        rows.append((root, path, "skipped", "duplicate"))
                    elif matches(path, self.exclude) and not matches(path, self.include):
                        rows.append((root, path, "skipped", "excluded_pattern"))
                    else:
                        seen.add(real)
                        rows.append((root, path, "selected", "selected"))
        return spark.createDataFrame(rows, "root string, path string, status string, reason string")
