"""What this machine can take: memory and processors, container limits included."""

from __future__ import annotations

import os
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class Machine:
    memory: int  #: bytes that can be had now
    cores: int


def discover(proc: Path = Path("/proc"), cgroup: Path = Path("/sys/fs/cgroup")) -> Machine:
    """The least of the free memory and what the container may still use (its page cache counts as free)."""
    free = next((int(line.split()[1]) * 1024 for line in (proc / "meminfo").read_text().splitlines() if line.startswith("MemAvailable")), 0)
    try:
        most = (cgroup / "memory.max").read_text().strip()
        if most != "max":
            used = int((cgroup / "memory.current").read_text())
            cached = sum(int(line.split()[1]) for line in (cgroup / "memory.stat").read_text().splitlines() if line.split()[0] in ("inactive_file", "active_file"))
            free = min(free, max(0, int(most) - (used - cached)))
    except OSError:
        pass
    cores = len(os.sched_getaffinity(0))
    try:
        quota, period = (cgroup / "cpu.max").read_text().split()
        if quota != "max":
            cores = max(1, min(cores, int(quota) // int(period)))
    except (OSError, ValueError):
        pass
    return Machine(free, cores)


def admit(machine: Machine, worker_bytes: int, workers: int, headroom: float = 0.8) -> tuple[bool, str]:
    """Whether so many workers may start: several that don't fit are refused, a single one is warned of."""
    fit = int(machine.memory * headroom // worker_bytes)
    if workers <= fit:
        return True, f"{workers} of {fit} workers fit"
    if workers == 1:
        return True, "warning: one worker may not fit"
    return False, f"{workers} workers need {workers * worker_bytes} bytes, {fit} fit"
