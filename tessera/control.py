"""Small things of the driver around the data: profiles, workspaces, token maps, steps, progress, files of state.

Nothing here touches rows; all of it is bounded by a configuration or a listing.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


def published(tools: Iterable[str], profile: str = "full", profiles: dict[str, set[str]] | None = None, disabled: Iterable[str] = ()) -> list[str]:
    """The tools of a profile in the order given: ``full`` has all, another what ``profiles`` lists; those that are
    disabled are in none."""
    allowed = None if profile == "full" else (profiles or {})[profile]
    off = set(disabled)
    return [t for t in tools if t not in off and (allowed is None or t in allowed)]


def capabilities(corpora: Iterable[str], queries: Iterable[str], runner=None, enabled: bool = True) -> dict:
    """What can be asked for: corpora, queries and how many jobs are active."""
    active = sum(j.status in ("queued", "running") for j in runner.jobs.values()) if runner else 0
    return {"enabled": enabled, "corpora": sorted(corpora), "queries": sorted(queries), "active_jobs": active}


def dashboard(jobs: Iterable) -> list[dict]:
    """A row per tenant: its last job and how many failed."""
    rows: dict[str, dict] = {}
    for j in jobs:
        r = rows.setdefault(j.tenant, {"tenant": j.tenant, "jobs": 0, "failed": 0, "last": None})
        r["jobs"] += 1
        r["failed"] += j.status == "failed"
        r["last"] = j.status
    return [rows[t] for t in sorted(rows)]


class NotChosen(LookupError):
    """Several workspaces are there and none was named."""


def choose_workspace(known: dict, argument: str = "", headers: dict[str, str] | None = None, default: str = ""):
    """The workspace of a call: the argument's, else the header's, else the default's, else the only one. With several
    and no choice the call is refused, since an answer from another configuration is worse than none."""
    headers = {k.lower(): v for k, v in (headers or {}).items()}
    name = argument.strip() or headers.get("x-workspace", "").strip() or default.strip()
    if name:
        if name not in known:
            raise NotChosen(f"no workspace {name}; there are {', '.join(sorted(known)) or 'none'}")
        return name, known[name]
    if len(known) == 1:
        return next(iter(known.items()))
    raise NotChosen(f"choose one of {', '.join(sorted(known)) or 'none'}")


def token_map(text: str) -> dict[str, tuple[str, str | None]]:
    """``token=tenant`` or ``token=tenant:configuration``, separated by commas; what is incomplete is left out."""
    pairs = (re.fullmatch(r"\s*([^=\s]+)\s*=\s*([^:\s]+)\s*(?::\s*(\S+)\s*)?", part) for part in text.split(","))
    return {m[1]: (m[2], m[3]) for m in pairs if m}


def help_entries(text: str) -> list[tuple[str | None, str]]:
    """(version, path) of lines ``version = path`` or ``path``; a semicolon ends a line too."""
    out = []
    for line in re.split(r"[;\r\n]+", text):
        m = re.fullmatch(r'\s*(?:([^="]+?)\s*=\s*)?"?([^"]+?)"?\s*', line)
        if m:
            out.append((m[1], m[2]))
    return out


STEPS = ("index", "callgraph", "vectorize")


def steps_of(wanted=None, reset: bool = False, confirmed: bool = False, tenant: str = "") -> list[str]:
    """The steps of a job in their order; unknown or no steps are an error, so is a reset that was not confirmed, and a
    job on a task's overlay."""
    if "@task/" in tenant:
        raise ValueError("a task's overlay is not indexed by this job")
    if reset and not confirmed:
        raise ValueError("a reset must be confirmed")
    if wanted is None:
        return list(STEPS)
    unknown = [s for s in wanted if s not in STEPS]
    if unknown or not wanted:
        raise ValueError(f"steps are some of {', '.join(STEPS)}; not {', '.join(map(str, unknown)) or 'none'}")
    return [s for s in STEPS if s in wanted]


@dataclass
class Progress:
    """Lines with rate and remaining time, at most one every ``every`` seconds and one at the end."""

    total: int
    label: str
    say: Callable[[str], None]
    every: float = 2.0
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    began: float = field(init=False)
    said: float = field(init=False)

    def __post_init__(self):
        self.began = self.said = self.clock()

    def advance(self, n: int = 1) -> None:
        self.done += n
        now = self.clock()
        if now - self.said >= self.every or self.done >= self.total:
            self.said, spent = now, now - self.began
            rate = self.done / spent if spent > 0 else 0.0
            left = (self.total - self.done) / rate if rate else None
            self.say(f"{self.label}: {self.done}/{self.total}, {rate:.1f}/s" + (f", {left:.0f} s left" if left else ""))


def safe_path(root: str, path: str) -> str:
    """The real path below ``root``; links and points that lead out are refused."""
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != top and os.path.commonpath([top, full]) != top:
        raise PermissionError(f"{path} leads out of its source")
    return full


def missing_index(error: Exception) -> bool:
    """Does an error say that an index or its table was never made?"""
    return bool(re.search(r"(?i)no such \w*\s*(?:schema )?index|PATH_NOT_FOUND|TABLE_OR_VIEW_NOT_FOUND", str(error)))


class BuildLock:
    """One build at a time: a lock file that its owner touches while it works; one not touched for ``stale`` seconds
    is taken over."""

    def __init__(self, path: str, stale: float = 120.0, clock: Callable[[], float] = time.time):
        self.path, self.stale, self.clock, self.held = path, stale, clock, False

    def acquire(self) -> bool:
        for _ in range(2):
            try:
                os.close(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                self.held = True
                return True
            except FileExistsError:
                try:
                    if self.clock() - os.stat(self.path).st_mtime <= self.stale:
                        return False
                    os.remove(self.path)
                except FileNotFoundError:
                    pass
        return False

    def beat(self) -> None:
        os.utime(self.path)

    def release(self) -> None:
        if self.held:
            self.held = False
            os.remove(self.path)


def save_jobs(path: str, jobs: Iterable) -> None:
    """The jobs as JSON, swapped in whole, so that a reader sees the old or the new file."""
    rows = [{"id": j.id, "tenant": j.tenant, "status": j.status, "error": j.error, "steps": [n for n, _ in j.steps]} for j in jobs]
    handle, at = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(at, path)


def load_jobs(path: str) -> list:
    """The jobs that were saved; what was active has failed, as its process ended. A missing file has none."""
    from tessera.scope import Job

    if not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    ended = ("queued", "running")
    return [Job(r["tenant"], [(n, None) for n in r["steps"]], r["id"], "failed" if r["status"] in ended else r["status"], "the process ended" if r["status"] in ended else r["error"]) for r in rows]


def run_baseline(steps: Iterable[str], work: dict[str, Callable[[], int]]) -> tuple[str, dict[str, int]]:
    """The steps in order and what each counted; a step that gives nothing makes the job end with a warning."""
    counted = {s: work[s]() for s in steps}
    return ("succeeded" if all(counted.values()) else "warning"), counted


# ---- sources ----
def iter_files(root: str, patterns: Iterable[str]) -> list[str]:
    """Files below ``root`` that match any pattern, each once, sorted within a pattern; nothing of ``.git``."""
    import glob

    found = (os.path.join(root, f) for p in patterns for f in sorted(glob.glob(p, root_dir=root, recursive=True, include_hidden=True)))
    return list(dict.fromkeys(f for f in found if os.path.isfile(f) and ".git" not in os.path.relpath(f, root).split(os.sep)))


def git(root: str, *arguments: str) -> str:
    import subprocess

    done = subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(done.stderr.strip() or f"git ended with {done.returncode}")
    return done.stdout.strip()


def materialize(entry: dict, cache: str) -> str:
    """The folder of a source: its ``path``, which must be one, else a shallow clone of ``repo`` and ``branch`` in the
    cache, brought forward if it is there."""
    import hashlib
    import subprocess

    if entry.get("path"):
        if not os.path.isdir(entry["path"]):
            raise NotADirectoryError(entry["path"])
        return entry["path"]
    if not entry.get("repo"):
        raise ValueError("a source needs a path or a repository")
    to = os.path.join(cache, hashlib.sha1(f"{entry['repo']}\0{entry.get('branch') or ''}\0".encode()).hexdigest()[:16])
    if os.path.isdir(os.path.join(to, ".git")):
        git(to, "pull", "--ff-only", "--depth", "1")
    else:
        os.makedirs(cache, exist_ok=True)
        subprocess.run(["git", "clone", "--depth", "1", *(["--branch", entry["branch"]] if entry.get("branch") else []), entry["repo"], to], check=True, capture_output=True)
    return to


def pull(root: str) -> str:
    """Brings a working copy forward, only if its tree is clean, it is on a branch, and history did not fork."""
    if git(root, "status", "--porcelain"):
        raise RuntimeError("the working copy has changes")
    if git(root, "rev-parse", "--abbrev-ref", "HEAD") == "HEAD":
        raise RuntimeError("the working copy is on no branch")
    git(root, "pull", "--ff-only")
    return git(root, "rev-parse", "HEAD")


def repositories(folders: Iterable[str]) -> dict[str, dict]:
    """The folders by the repository that they lie in, with its branch, commits ahead and behind, and changed files;
    folders in none are left out."""
    out: dict[str, dict] = {}
    for folder in folders:
        try:
            top = git(folder, "rev-parse", "--show-toplevel")
        except RuntimeError:
            continue
        if top not in out:
            state = git(top, "status", "--porcelain=v2", "--branch").splitlines()
            heads = dict(x[2:].split(" ", 1) for x in state if x.startswith("# "))
            ahead, behind = (abs(int(n)) for n in heads.get("branch.ab", "+0 -0").split())
            out[top] = {"branch": heads.get("branch.head"), "ahead": ahead, "behind": behind, "changed": sum(not x.startswith("# ") for x in state), "folders": []}
        out[top]["folders"].append(folder)
    return out


def build_source(spark: SparkSession, entry: dict, cache: str = ".cache") -> DataFrame:
    """The units of a manifest's entry by its type: ``its`` (JSON), ``git_artifacts`` (Markdown), ``hbk`` (help books).
    Contents are read by Spark; of a crawl the pages come from ``trees.crawl``."""
    from pyspark.sql import functions as F

    from tessera.sources import help as books
    from tessera.sources import trees

    kind = entry.get("type")
    if kind == "hbk":
        paths = entry.get("files") or iter_files(entry["path"], ["**/*.hbk"])
        return books.pages(spark.read.format("binaryFile").load([p for p, _, _ in books.validate(paths)]).select("path", "content"))
    suffixes = {"its": (".json",), "git_artifacts": (".md", ".adoc")}.get(kind)
    if not suffixes:
        raise ValueError(f"unknown type of source: {kind}")
    files = trees.read_tree(spark, [("base", materialize(entry, cache))], suffixes).select("path", F.col("content"))
    return trees.its_units(files, entry) if kind == "its" else trees.artifact_units(files)


class PageClient:
    """Pages of a section by cursor, with retries. ``send(path, params)`` gives (status, data, seconds to wait or 0);
    408, 425, 429 and 5xx and failures to connect are tried again after growing pauses, 404 is an answer."""

    AGAIN = {408, 425, 429, 500, 502, 503, 504}

    def __init__(self, send: Callable, retries: int = 4, pause: float = 0.5, sleep: Callable[[float], None] = time.sleep):
        self.send, self.retries, self.pause, self.sleep = send, retries, pause, sleep

    def get(self, path: str, params: dict) -> tuple[int, object]:
        for attempt in range(self.retries + 1):
            try:
                status, data, wait = self.send(path, params)
            except OSError as e:
                status, data, wait = 503, str(e), 0
            if status not in self.AGAIN:
                if status >= 400 and status != 404:
                    raise RuntimeError(f"{path}: {status}")
                return status, data
            if attempt < self.retries:
                self.sleep(max(wait, self.pause * 2**attempt))
        raise RuntimeError(f"{path}: {status} after {self.retries + 1} tries")

    def descendants(self, page: str, size: int = 100) -> list[dict]:
        """All pages below one, whatever the number of cursors; a section cut short would count as deleted pages."""
        out, cursor = [], None
        while True:
            _, data = self.get(f"/pages/{page}/descendants", {"page_size": size} | ({"cursor": cursor} if cursor else {}))
            out += data["results"]
            cursor = data.get("next_cursor")
            if not cursor or not data["results"]:
                return out

    def pages(self, ids: Iterable[str], workers: int = 2):
        """(id, status, data) of pages, two at a time; a failure that is no 404 ends the crawl."""
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            yield from pool.map(lambda i: (i, *self.get("/pages", {"id": i})), ids)
