"""Memory of near-dedup: what earlier operators left in a worker, and lists of one member."""

import subprocess
import sys

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import near

KEPT = """
import os
import numpy as np
from quarry.llm import common, pieces

rss = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20
emptied = []
common.REMEMBERED.append(lambda: emptied.append(1))

def run(batches):
    common.keep_heap()
    held = [np.ones(1 << 17) for _ in range(300)]
    yield rss()
    del held
    yield rss()

full, kept = common.giving_back(run)([])
print(full - rss(), full - kept, len(emptied), len(common.REMEMBERED))
"""


def test_workers_give_back_what_an_operator_kept():
    """A worker that has served the quality classifier took some 275 MB through all of near-dedup."""
    given, at_once, emptied, remembered = map(int, subprocess.run([sys.executable, "-c", KEPT], capture_output=True, text=True, check=True).stdout.split())
    assert at_once < 50 and given > 250  # keep_heap() holds until the task ends
    assert emptied == 2 and remembered >= 2


def test_lists_of_one_member_are_not_made(spark):
    """Every fingerprint stands in 56 lists, most of them its own: no list objects, and pairs of one task's sort only."""
    g = np.random.default_rng(2)
    reps = spark.createDataFrame([(i, 9, int(x)) for i, x in enumerate(g.integers(-(2**63), 2**63 - 1, 50))], "node long, n int, fp long")
    plan = near.fingerprint_pairs(reps)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    assert near.fingerprint_pairs(reps.withColumn("fp", F.lit(5).cast("long"))).count() == 2 * 50 - 3  # with the one before, and with the first


def test_counts_take_one_python_step_a_task(spark):
    """Two in a row took two workers a task, which stay with the executor."""
    steps = []
    numbered = spark.createDataFrame([(i, f"a b c d e {i}") for i in range(40)], "rid long, text string").repartition(3)
    written = near.written
    try:
        near.written = lambda df, name: steps.append((name, df._jdf.queryExecution().executedPlan().toString())) or written(df, name)
        near.counted(numbered)
    finally:
        near.written = written
    assert [name for name, _ in steps] == ["near-counts", "near-counters"]
    assert all(plan.count("MapInArrow") + plan.count("FlatMapGroupsInArrow") == 1 for _, plan in steps), steps
