"""Per-job and per-stage times from a Spark event log (no UI, no server).

Run a query with the event log written to a scratch folder, e.g.

    BENCH_EVENT_LOG=/tmp/run-x python bench.py

then

    python tools/job_times.py /tmp/run-x [job group]

prints, per job: its group (the query name in bench.py), wall time, the gap
since the previous job (driver time), the number of stages and the call
site; and, per stage, the task count and the slowest task's run and CPU time.
Compressed (zstd) and plain logs, single files and rolling folders are read.
"""

from __future__ import annotations

import glob
import io
import json
import os
import sys


def _lines(path: str):
    files = sorted(glob.glob(os.path.join(path, "**", "*"), recursive=True)) if os.path.isdir(path) else [path]
    for f in files:
        if os.path.isdir(f) or os.path.basename(f).startswith("appstatus"):
            continue
        raw = open(f, "rb").read()
        if f.endswith(".zstd"):
            import zstandard
            raw = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read()
        for line in raw.decode("utf-8", "replace").splitlines():
            if line.strip():
                yield json.loads(line)


def main() -> None:
    path = sys.argv[1]
    group = sys.argv[2] if len(sys.argv) > 2 else None
    jobs: dict[int, dict] = {}
    stage_job: dict[int, int] = {}
    tasks: dict[int, list] = {}
    for e in _lines(path):
        ev = e["Event"]
        if ev == "SparkListenerJobStart":
            props = e.get("Properties", {})
            jobs[e["Job ID"]] = {"group": props.get("spark.jobGroup.id", ""),
                                 "start": e["Submission Time"], "end": None,
                                 "site": props.get("callSite.short", ""),
                                 "stages": {s["Stage ID"]: s["Stage Name"] for s in e["Stage Infos"]}}
            for s in e["Stage IDs"]:
                stage_job[s] = e["Job ID"]
        elif ev == "SparkListenerJobEnd" and e["Job ID"] in jobs:
            jobs[e["Job ID"]]["end"] = e["Completion Time"]
        elif ev == "SparkListenerTaskEnd":
            m = e.get("Task Metrics") or {}
            tasks.setdefault(e["Stage ID"], []).append(
                (m.get("Executor Run Time", 0), m.get("Executor CPU Time", 0) // 1_000_000))
    prev = None
    for jid in sorted(jobs):
        j = jobs[jid]
        if group and j["group"] != group:
            continue
        if j["end"] is None:
            continue
        gap = j["start"] - prev if prev else 0
        prev = j["end"]
        print(f"{j['group'][:28]:28s} job {jid:4d} {j['end'] - j['start']:6d} ms  gap {gap:5d} ms  "
              f"stages {len(j['stages'])}  {j['site']}")
        for sid, name in sorted(j["stages"].items()):
            ts = tasks.get(sid)
            if not ts:
                continue  # skipped (shuffle output reused)
            run, cpu = max(ts)
            print(f"{'':34s} stage {sid:4d} tasks {len(ts):4d}  slowest run {run:6d} ms cpu {cpu:6d} ms  {name[:50]}")


if __name__ == "__main__":
    main()
