"""Whose rows a query may see, tokens, and jobs."""

from __future__ import annotations

import hashlib
import queue
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARED = "__shared__"


class Refused(PermissionError):
    """No tenant was given, or not one that the caller may use."""


@dataclass(frozen=True)
class TenantScope:
    """The caller's tenant, what all may read, and an overlay of a task on the caller's tenant."""

    tenant: str
    shared: str | None = SHARED
    overlay: str | None = None

    def __post_init__(self):
        if not self.tenant:
            raise Refused("a tenant must be given")
        if self.overlay and not self.overlay.startswith(self.tenant + "@task/"):
            raise Refused("the overlay belongs to another tenant")

    def tenants(self) -> list[str]:
        return [t for t in (self.overlay, self.tenant, self.shared) if t]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("tenant_id").isin(self.tenants()))


def token_hash(token: str) -> str:
    """Only this is stored."""
    return hashlib.sha256(token.encode()).hexdigest()


class TokenStore:
    """Tokens of tenants, of which only hashes are kept; what was done, when and to whom, is kept too. A token that was
    given out cannot be read again, a hash never belongs to two tenants."""

    def __init__(self, clock=time.time):
        self.tenants: dict[str, str] = {}
        self.audit: list[tuple[float, str, str]] = []
        self.clock = clock

    def provision(self, tenant: str) -> str:
        import secrets

        if not tenant:
            raise Refused("a tenant must be given")
        token = secrets.token_urlsafe(32)
        self.tenants[token_hash(token)] = tenant
        self.audit.append((self.clock(), "provision", tenant))
        return token

    def revoke(self, tenant: str) -> int:
        """All tokens of a tenant; how many there were."""
        mine = [h for h, t in self.tenants.items() if t == tenant]
        for h in mine:
            del self.tenants[h]
        self.audit.append((self.clock(), "revoke", tenant))
        return len(mine)


def resolve_tenant(token: str | None, configured: dict[str, str], stored: dict[str, str], headers: dict[str, str] | None = None, http: bool = True) -> str:
    """A configured token goes first, then a stored one, then a header; over HTTP nothing is assumed."""
    if token:
        if token in configured:
            return configured[token]
        if (h := token_hash(token)) in stored:
            return stored[h]
        raise Refused("unknown token")
    tenant = (headers or {}).get("X-Tenant")
    if tenant:
        return tenant
    if http:
        raise Refused("no token and no tenant")
    return "default"


class TtlCache:
    """Answers, found or not, kept for a time."""

    def __init__(self, seconds: float, clock=time.monotonic):
        self.seconds, self.clock, self.kept = seconds, clock, {}

    def get(self, key, load):
        got = self.kept.get(key)
        if got is None or self.clock() - got[1] > self.seconds:
            got = self.kept[key] = (load(key), self.clock())
        return got[0]


@dataclass
class Job:
    tenant: str
    steps: list
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "queued"
    error: str | None = None
    result: dict = field(default_factory=dict)


class JobRunner:
    """One worker, first come first served, one active job a tenant. ``steps`` are (name, function);
    a step that returns an empty result makes the job end with a warning."""

    STATES = ("queued", "running", "succeeded", "warning", "failed")

    def __init__(self):
        self.jobs: dict[str, Job] = {}
        self.todo: queue.Queue = queue.Queue()
        self.lock = threading.Lock()
        threading.Thread(target=self._work, daemon=True).start()

    def submit(self, tenant: str, steps: list) -> Job:
        with self.lock:
            if any(j.tenant == tenant and j.status in ("queued", "running") for j in self.jobs.values()):
                raise ValueError(f"a job of {tenant} is active")
            job = Job(tenant, steps)
            self.jobs[job.id] = job
        self.todo.put(job)
        return job

    def restore(self, saved: list[Job]) -> None:
        """Jobs that were active when the process ended have failed."""
        for j in saved:
            if j.status in ("queued", "running"):
                j.status, j.error = "failed", "the process ended"
            self.jobs[j.id] = j

    def _work(self) -> None:
        while True:
            job = self.todo.get()
            job.status = "running"
            try:
                for name, step in job.steps:
                    job.result[name] = step()
                job.status = "succeeded" if all(job.result.values()) else "warning"
            except Exception as e:  # noqa: BLE001 - a job's failure is its result
                job.status, job.error = "failed", str(e)
            self.todo.task_done()
