"""Per-stage task statistics from a Spark event log (no UI needed).

    python tools/stage_stats.py EVENT_LOG_FILE_OR_DIR

For every stage: task count, the largest and the median task by records
read (input + shuffle), and the longest task run time.  The largest
task's share shows whether one key or partition dominates a stage.
"""

from __future__ import annotations

import io
import json
import os
import statistics
import sys
from collections import defaultdict


def _open(name: str):
    """Event files are plain JSON lines or zstd-compressed (Spark 4 default)."""
    if name.endswith(".zstd") or name.endswith(".zst"):
        import zstandard

        raw = open(name, "rb")
        reader = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True)
        return io.TextIOWrapper(reader, encoding="utf-8")
    return open(name, encoding="utf-8")


def task_records(metrics: dict) -> int:
    inp = metrics.get("Input Metrics", {}).get("Records Read", 0)
    shuffle = metrics.get("Shuffle Read Metrics", {})
    return inp + shuffle.get("Total Records Read", 0)


def stage_stats(path: str) -> list[dict]:
    if os.path.isdir(path):  # Spark 4 writes rolling logs: a folder of event files
        files = sorted(
            os.path.join(root, f)
            for root, _, names in os.walk(path)
            for f in names
            if not f.startswith(("appstatus", "."))
        )
    else:
        files = [path]
    tasks: dict[int, list[tuple[int, int]]] = defaultdict(list)
    names: dict[int, str] = {}
    for name in files:
        with _open(name) as fh:
            for line in fh:
                if not line.startswith("{"):
                    continue
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerTaskEnd" and ev.get("Task Metrics"):
                    m = ev["Task Metrics"]
                    tasks[ev["Stage ID"]].append((task_records(m), m.get("Executor Run Time", 0)))
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    names[info["Stage ID"]] = info.get("Stage Name", "")
    out = []
    for sid in sorted(tasks):
        recs = [r for r, _ in tasks[sid]]
        total = sum(recs) or 1
        out.append({
            "stage": sid,
            "name": names.get(sid, "")[:50],
            "tasks": len(recs),
            "records": sum(recs),
            "max_task_records": max(recs),
            "median_task_records": int(statistics.median(recs)),
            "max_task_share": round(max(recs) / total, 3),
            "max_task_ms": max(t for _, t in tasks[sid]),
        })
    return out


if __name__ == "__main__":
    for row in stage_stats(sys.argv[1]):
        print(json.dumps(row))
