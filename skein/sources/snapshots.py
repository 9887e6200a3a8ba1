"""A tree as it was at a git reference."""

from __future__ import annotations

import contextlib
import os
import subprocess
import tempfile
from collections.abc import Iterator

SECONDS = 120


@contextlib.contextmanager
def at_reference(path: str, reference: str) -> Iterator[str]:
    """The folder ``path`` of its repository, checked out at ``reference`` in a worktree that goes afterwards."""
    if reference.startswith("-"):
        raise ValueError(f"not a reference: {reference}")
    git = lambda *a: subprocess.run(["git", "-C", path, *a], capture_output=True, text=True, timeout=SECONDS)
    top = git("rev-parse", "--show-toplevel")
    commit = git("rev-parse", "--verify", f"{reference}^{{commit}}")
    if top.returncode or commit.returncode:
        raise ValueError((commit.stderr or top.stderr).strip())
    inside = os.path.relpath(os.path.realpath(path), os.path.realpath(top.stdout.strip()))
    with tempfile.TemporaryDirectory() as folder:
        tree = os.path.join(folder, "tree")
        made = git("worktree", "add", "--detach", tree, commit.stdout.strip())
        if made.returncode:
            raise ValueError(made.stderr.strip())
        try:
            yield os.path.normpath(os.path.join(tree, inside))
        finally:
            git("worktree", "remove", "--force", tree)
