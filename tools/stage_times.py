"""Stage and job times of one registered query, from Spark's event log.

Writes the event log to a fresh scratch folder (no UI, no server), runs the
query ``runs`` times into the noop sink, and prints the jobs of the last run
with their stages (name, tasks, seconds).

python tools/stage_times.py <query-key> [sf_dir] [runs]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    key = sys.argv[1]
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    runs = int(sys.argv[3]) if len(sys.argv) > 3 else 2
    from shopflow.plans.catalog import QUERIES
    from shopflow.session import build_session

    logdir = tempfile.mkdtemp(prefix="shopflow-events-")
    spark = build_session("local[8]", 16, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": logdir,
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"})
    marks = []
    for _ in range(runs):
        t0 = time.time()
        QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
        marks.append((t0, time.time()))
        print(f"{key}: {marks[-1][1] - marks[-1][0]:.2f} s")
    spark.stop()
    path = glob.glob(os.path.join(logdir, "*"))[0]
    stages, jobs = {}, {}
    for line in open(path):
        e = json.loads(line)
        if e["Event"] == "SparkListenerStageCompleted":
            si = e["Stage Info"]
            stages[si["Stage ID"]] = (si["Stage Name"][:50], si["Number of Tasks"],
                                      (si["Completion Time"] - si["Submission Time"]) / 1000)
        elif e["Event"] == "SparkListenerJobStart":
            jobs[e["Job ID"]] = [e["Submission Time"], e["Stage IDs"], None]
        elif e["Event"] == "SparkListenerJobEnd":
            jobs[e["Job ID"]][2] = e["Completion Time"]
    start = marks[-1][0] * 1000
    for j, (st, ids, end) in sorted(jobs.items()):
        if st >= start and end:
            done = [stages[s] for s in ids if s in stages]
            print(f"job {j}: {(end - st) / 1000:.2f} s", done)


if __name__ == "__main__":
    main()
