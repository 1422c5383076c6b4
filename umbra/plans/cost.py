"""What a city costs before it is built, and whether the machine can take it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Measured rates of the planning model: cells a core and second, loss by sharing, bytes.
RATE, CONTENTION, ARTIFACT_BYTES, SCRATCH_CUBES = 1340.0, 0.114, 155, 3
HEADROOM = 0.8


def sweep_seconds(cells: Column, sectors: Column, reach_cells: Column, workers: Column) -> Column:
    scale = (sectors / 64.0) * (reach_cells / 500.0)
    return cells * scale / (RATE * workers / (1 + CONTENTION * (workers - 1)))


def scratch_bytes(rows: Column, cols: Column, sectors: Column) -> Column:
    return (SCRATCH_CUBES * sectors * rows * cols).cast("long")


def artifact_bytes(covered: Column) -> Column:
    return (covered * ARTIFACT_BYTES).cast("long")


def fitting_workers(memory: Column, worker_bytes: Column, cores: Column) -> Column:
    """Workers that fit the memory and leave a core free; none is a real answer."""
    fit = F.floor(memory * HEADROOM / worker_bytes)
    return F.greatest(F.lit(0), F.least(fit, F.greatest(F.lit(1), cores - 1))).cast("int")
