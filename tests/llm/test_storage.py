from __future__ import annotations

import os

import numpy as np

from agendum.llm.storage import lean


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6


def test_the_memory_of_a_tasks_arrays_goes_back_to_the_system():
    """A few arrays that stay keep the freed ones before them from going by themselves."""
    stay, peak = [], []

    def task():
        arrays = [np.ones(1000) for _ in range(40_000)]
        stay.extend(arrays[::500])
        peak.append(resident_mb())
        yield len(arrays)

    assert list(lean(task())) == [40_000]
    assert len(stay) == 80 and resident_mb() < peak[0] - 200
