import subprocess
import sys
import time
from pathlib import Path

import pytest

from seqlabel.llm import common, simhash, suffixdedup, toxicity

HOLDS = """
import re, sys
import numpy as np
from seqlabel.llm.common import held, released

def mb():
    return int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

before, pins = mb(), []
def make():
    rows = []
    for _ in range(2000):
        rows.append(np.ones(60_000, np.uint8))
        pins.append(np.ones(2_000, np.uint8))  # what lives on lies between
    return rows
held(("test",), make)
full = mb()
released()
print(full - before, mb() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="needs Linux")
def test_dropped_memory_goes_back_to_the_machine():
    out = subprocess.run([sys.executable, "-c", HOLDS], cwd=Path(__file__).parents[2], capture_output=True, text=True, check=True)
    full, left = map(float, out.stdout.split())
    assert full > 100 and left < 40


@pytest.mark.parametrize("step", [suffixdedup._extract, suffixdedup._pages(4, 4), simhash._search(4, 4), toxicity._count],
                         ids=["extract", "pages", "search", "count"])
def test_steps_drop_what_another_operator_kept(step):
    common.held(("other",), list)
    assert list(step(iter([]))) == []
    assert not common._HELD


def test_swept_shuffles_leave_the_disk(spark):
    """Files of a finished job's shuffle are gone before the next step is done."""
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {x.getName() for x in map(folder.getAllFiles().apply, range(folder.getAllFiles().size())) if x.getName().startswith("shuffle_")}
    common.swept(spark)
    time.sleep(1)
    before = shuffles()
    common.saved(spark.range(1000).repartition(5, "id"), "swept")
    assert shuffles() - before
    common.swept(spark)
    time.sleep(1)
    assert not shuffles() - before
