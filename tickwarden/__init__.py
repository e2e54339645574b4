"""tickwarden: market-tick and sensor-snapshot analytics on Spark.

DataFrame / SQL for batch, Structured Streaming for streams.  The
sub-packages are:

* ``sources``   - readers: parquet fixtures, landed JSON text, pages,
                  snapshots, Kafka (behind one function each)
* ``functions`` - column expressions (rounding, ISO text, messages, buckets)
* ``operators`` - batch operators (decode, detectors, bars, points, routing)
* ``streaming`` - the detectors' per-key state logic, stream builders,
                  and the reference's four programs as streaming apps
                  (``python -m tickwarden <alerts|points|messages|route>``)
* ``plans``     - the query catalogue used by ``__spark_entry__`` and bench
"""

from tickwarden.session import build_session, checkpoint_root, scratch_path

__all__ = ["build_session", "checkpoint_root", "scratch_path"]
