"""Addresses, clones and heads of repositories. Small driver-side work with files and, where a clone is wanted, git itself."""

from __future__ import annotations

import logging
import os
import re
import shutil
import subprocess
from dataclasses import dataclass

_URL = re.compile(r"^(https?://|git@|ssh://|git://)", re.IGNORECASE)
log = logging.getLogger(__name__)


def is_url(source: str) -> bool:
    return bool(_URL.match(source))


def slug(url: str) -> str:
    """The name of a repository's address; see functions.lexical.url_slug for columns."""
    s = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", "", re.sub(r"^git@([^:]+):", r"\1/", re.sub(r"\.git$", "", url)))
    return re.sub(r"-+", "-", re.sub(r"[/\\:@]+", "-", s)).strip("-")


def sanitise(name: str) -> str:
    return re.sub(r"[^\w\-]", "_", name)[:128]


@dataclass
class RepoInfo:
    repo_id: str
    source: str
    source_type: str
    path: str
    git_branch: str | None
    git_commit: str | None


def _read(path: str) -> str | None:
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            return f.read().strip()
    except OSError:
        return None


def head(path: str) -> tuple[str | None, str | None, str | None]:
    """(branch, commit, address of origin), each None when it can't be read."""
    git = os.path.join(path, ".git")
    if os.path.isfile(git) and (link := _read(git)) and link.startswith("gitdir:"):
        git = os.path.join(path, link[7:].strip())
    ref = _read(os.path.join(git, "HEAD"))
    branch = commit = None
    if ref and ref.startswith("ref:"):
        name = ref[4:].strip()
        branch = name.removeprefix("refs/heads/")
        commit = _read(os.path.join(git, name))
        if commit is None:
            packed = _read(os.path.join(git, "packed-refs")) or ""
            commit = next((x.split()[0] for x in packed.splitlines() if x.endswith(" " + name)), None)
    elif ref:
        commit = ref
    m = re.search(r'\[remote "origin"\][^\[]*?url\s*=\s*(\S+)', _read(os.path.join(git, "config")) or "")
    return branch, commit, m[1] if m else None


def clone_or_update(url: str, target: str, branch: str | None = None, depth: int | None = 1) -> None:
    """Fetch an existing clone (if that fails, it is used as it is) or make a shallow one (if that fails, nothing is left)."""
    run = lambda *a, **k: subprocess.run(["git", *a], check=True, capture_output=True, text=True, **k)
    limit = ["--depth", str(depth)] if depth else []
    if os.path.isdir(os.path.join(target, ".git")):
        try:
            run("fetch", *limit, "origin", *([branch] if branch else []), cwd=target)
            run("reset", "--hard", "FETCH_HEAD", cwd=target)
        except (subprocess.CalledProcessError, OSError) as e:
            log.warning("fetch of %s failed, the cached clone is used: %s", url, e)
        return
    try:
        run("clone", *limit, *(["--branch", branch] if branch else []), url, target)
    except (subprocess.CalledProcessError, OSError) as e:
        shutil.rmtree(target, ignore_errors=True)
        raise RuntimeError(f"could not clone {url}") from e


def resolve(source: str, branch: str | None = None, clones: str | None = None) -> RepoInfo:
    """A local directory or, for an address, its clone."""
    if is_url(source):
        name = sanitise(slug(source))
        path = os.path.join(clones or os.path.join(os.path.expanduser("~"), ".codeweft", "repos"), name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        clone_or_update(source, path, branch)
        b, c, _ = head(path)
        return RepoInfo(name, source, "git_url", path, branch or b, c)
    path = os.path.abspath(os.path.expanduser(source))
    if not os.path.exists(path):
        raise FileNotFoundError(source)
    if not os.path.isdir(path):
        raise NotADirectoryError(source)
    b, c, origin = head(path)
    return RepoInfo(sanitise(slug(origin)) if origin else os.path.basename(path), source, "local_path", path, b, c)
