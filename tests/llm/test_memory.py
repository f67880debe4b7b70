"""The driver gives back what it has freed, and trains within bounds."""

import ctypes
import gc
import re
import time
import tracemalloc
from pathlib import Path

import numpy as np

from corpusloom.llm import toxicity
from corpusloom.llm.common import release

PIECE, PIECES = 1 << 16, 1600


def resident(pid="self") -> float:
    """MB of a process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_release_gives_back_what_python_freed(spark):
    c = ctypes.CDLL(None)
    c.malloc.restype, c.free.argtypes = ctypes.c_void_p, [ctypes.c_void_p]
    held = [c.malloc(PIECE) for _ in range(PIECES)]
    for p in held:
        ctypes.memset(p, 1, PIECE)
    for k, p in enumerate(held):  # what stays lies between, so that the C library gives nothing back by itself
        if k % 20 != 19:
            c.free(p)
    before = resident()
    release(spark)
    after = resident()
    for p in held[19::20]:
        c.free(p)
    assert before - after > 60


def test_release_gives_back_what_the_jvm_freed(spark):
    jvm = spark._jvm
    pid, stay, go = jvm.ProcessHandle.current().pid(), jvm.java.util.ArrayList(), jvm.java.util.ArrayList()
    for k in range(PIECES):
        (go if k % 20 != 19 else stay).add(jvm.java.nio.ByteBuffer.allocateDirect(PIECE))
    del go
    for _ in range(3):  # buffers are freed some time after they are found to be garbage
        gc.collect()
        jvm.System.gc()
        time.sleep(1)
    before = resident(pid)
    release(spark)
    after = resident(pid)
    assert len(stay) == PIECES // 20 and before - after > 60


def test_long_texts_of_a_sample_are_scored_a_few_at_once():
    rnd = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 400, 6400)) for _ in range(250)]
    tracemalloc.start()
    toxicity.fit(texts, [k % 2 for k in range(250)], epochs=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
