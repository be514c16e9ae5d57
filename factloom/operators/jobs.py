"""Jobs on the driver: one at a time, stages with weights, cooperative cancel, restart."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

# Stages in order and their share of the bar.
WEIGHTS = {"parse": 0.2, "extract": 0.6, "link": 0.15, "crops": 0.05}
ACTIVE = ("queued", "running")


def fraction(stage: str, done: int, total: int) -> float:
    """How far the bar is, below 1 until the job is over."""
    if stage not in WEIGHTS or total <= 0:
        return 0.0
    names = list(WEIGHTS)
    passed = sum(WEIGHTS[s] for s in names[: names.index(stage)])
    return min(0.999, passed + WEIGHTS[stage] * min(1.0, done / total))


def seconds_left(elapsed: float, part: float) -> float | None:
    return elapsed / part - elapsed if part > 0.03 else None


class Cancelled(Exception):
    pass


class Jobs:
    """In-memory job table; Spark's own jobs carry the job's id as their group, so cancel reaches them."""

    def __init__(self, spark=None) -> None:
        self.spark, self.rows, self.lock = spark, {}, threading.Lock()
        self.stops: dict[str, threading.Event] = {}

    def recent(self, n: int = 5) -> list[dict]:
        return sorted(self.rows.values(), key=lambda j: -j["started_at"])[:n]

    def active(self) -> dict | None:
        return next((j for j in self.recent(10) if j["status"] in ACTIVE and j["id"] in self.stops), None)

    def start(self, files: list[str], run: Callable, wait: bool = False) -> str | None:
        """Runs run(progress, cancel) in a thread; None if a job is active."""
        with self.lock:
            if self.active():
                return None
            key = uuid.uuid4().hex[:12]
            now = time.time()
            self.rows[key] = {"id": key, "files": files, "status": "queued", "stage": "", "frac": 0.0, "started_at": now, "updated_at": now, "stats": {}, "error": "", "eta_s": None}
            self.stops[key] = threading.Event()
        thread = threading.Thread(target=self._work, args=(key, run), daemon=True)
        thread.start()
        if wait:
            thread.join()
        return key

    def _work(self, key: str, run: Callable) -> None:
        job, stop = self.rows[key], self.stops[key]

        def progress(stage: str, done: int, total: int, detail: str = "") -> None:
            if stop.is_set():
                raise Cancelled
            part, elapsed = fraction(stage, done, total), time.time() - job["started_at"]
            job.update(status="running", stage=stage, stage_done=done, stage_total=total, detail=detail, frac=round(part, 4), elapsed_s=int(elapsed), eta_s=seconds_left(elapsed, part), updated_at=time.time())

        if self.spark is not None:
            self.spark.sparkContext.setJobGroup(key, "ingest", interruptOnCancel=True)
        try:
            stats = run(progress, stop) or {}
            job.update(status="cancelled" if stop.is_set() else "done", stats=stats, frac=1.0)
        except Cancelled:
            job.update(status="cancelled")
        except Exception as e:  # noqa: BLE001 - a failed job is a state, not a crash
            job.update(status="cancelled" if stop.is_set() else "error", error=f"{type(e).__name__}: {e}")
        finally:
            job["updated_at"] = time.time()
            self.stops.pop(key, None)

    def cancel(self, key: str) -> bool:
        stop = self.stops.get(key)
        if stop is None:
            return False
        stop.set()
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(key)
        return True

    def reconcile(self) -> None:
        """After a restart: what was active and has no thread was interrupted."""
        for job in self.rows.values():
            if job["status"] in ACTIVE and job["id"] not in self.stops:
                job.update(status="interrupted", error="the server restarted during the run", updated_at=time.time())
