"""Plans made before a run: memory, disk, workers, capacity, signatures. Plain functions of a few numbers."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

MIB, GIB = 1 << 20, 1 << 30
#: Fixed values of the linear memory model: base, least per worker, and copies of a request that a worker holds.
BASE = 256 * MIB
GRID_LEAST, GRID_COPIES = 32 * MIB, 2.5
POINT_LEAST, POINT_COPIES = 24 * MIB, 4
HIGH, CRITICAL = 0.80, 0.90


@dataclass(frozen=True)
class Plan:
    workers: int
    request_bytes: int
    peak_bytes: int


def grid_peak(block: int, workers: int, in_flight: int) -> int:
    """Peak bytes of block requests of 64 float32 bands."""
    raw = block * block * 256
    return BASE + workers * max(GRID_LEAST, int(GRID_COPIES * raw)) + in_flight * raw


def grid_peaks(block, workers: int, in_flight: int):
    """grid_peak as a column of whole numbers, for tables of plans."""
    from pyspark.sql import functions as F

    raw = block.cast("long") * block.cast("long") * 256
    return F.lit(BASE) + workers * F.greatest(F.lit(GRID_LEAST), F.floor(F.lit(GRID_COPIES) * raw)) + in_flight * raw


def point_peak(chunk: int, years: int, workers: int) -> int:
    """Peak bytes of point chunks, 64 doubles a point and year."""
    return BASE + workers * max(POINT_LEAST, POINT_COPIES * chunk * max(1, years) * 512)


def _fit(peak, usable: int, most: int, workers: int | None) -> int:
    """The asked number of workers, else the most that stay below the high mark; one at least."""
    n = min(workers, most) if workers else max((k for k in range(1, most + 1) if peak(k) <= usable * HIGH), default=1)
    if peak(n) > usable * CRITICAL:
        raise ValueError(f"{n} workers need {peak(n) / GIB:.2f} GiB; {usable * CRITICAL / GIB:.2f} GiB may be used")
    return n


def plan_grid(block: int, usable: int, most: int = 8, workers: int | None = None) -> Plan:
    n = _fit(lambda k: grid_peak(block, k, k), usable, most, workers)
    return Plan(n, block * block * 256, grid_peak(block, n, n))


def plan_points(chunk: int, years: int, usable: int, most: int = 8, workers: int | None = None) -> Plan:
    n = _fit(lambda k: point_peak(chunk, years, k), usable, most, workers)
    return Plan(n, chunk * max(1, years) * 512, point_peak(chunk, years, n))


def capacity(raw: int, free: int, hard: int, warn: int, factor: float, reserve: int) -> dict:
    """Whether a run of `raw` bytes may start, why not, and the phrase that confirms a large one."""
    need = int(raw * factor) + reserve
    blocked = []
    if raw > hard:
        blocked.append(f"raw size {raw / GIB:.2f} GiB is above the limit of {hard / GIB:.2f} GiB")
    if free < need:
        blocked.append(f"free disk {free / GIB:.2f} GiB is below {need / GIB:.2f} GiB")
    return {"required_bytes": need, "can_start": not blocked, "blocked": blocked, "phrase": f"DOWNLOAD {raw / GIB:.2f} GiB" if raw >= warn else ""}


def chunk_slice(n_chunks: int, start: int = 1, most: int | None = None) -> range:
    """Numbers of the chunks a run takes, from 1."""
    if start < 1:
        raise ValueError("chunks count from 1")
    return range(start, 1 + (n_chunks if most is None else min(n_chunks, start + most - 1)))


def signature(**parts) -> str:
    """Digest of a run's parameters, the same for any order of keys; lists of sources sort by id."""
    tidy = {k: sorted(v, key=lambda s: (str(s.get("year")), str(s["id"]))) if k == "sources" else v for k, v in parts.items()}
    return hashlib.sha256(json.dumps(tidy, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def resumable(stored: str | None, current: str) -> bool:
    """True: reuse what is there; False: nothing is there. Another run's rest is an error."""
    if stored is not None and stored != current:
        raise ValueError("the folder holds another run; use a new one")
    return stored is not None
