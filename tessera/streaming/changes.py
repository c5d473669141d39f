"""Change detection over a stream of file versions.

Versions (path, sha256, scanned_at) arrive in any order.  A stateful operator
per path keeps the latest version and emits a row whenever a later version
differs: what the batch comparison of two snapshots finds, but continuously.
State is one small row a path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.sources.ship import ship

_OUT = "path string, change string, sha256 string, scanned_at timestamp"
_STATE = "sha256 string, scanned_at timestamp"


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["scanned_at", "sha256"], kind="stable", na_position="first")
    sha, at = state.get if state.exists else (None, None)
    out, known = [], state.exists
    for r in rows.itertuples(index=False):
        if r.scanned_at is pd.NaT or (known and at is not None and r.scanned_at < pd.Timestamp(at)):
            continue
        new = r.sha256 if isinstance(r.sha256, str) else None
        change = "new" if not known else "deleted" if new is None and sha is not None else "changed" if new != sha else None
        if change and not (change == "new" and new is None):
            out.append((key[0], change, new, r.scanned_at))
        sha, at, known = new, r.scanned_at, True
    if known:
        state.update((sha, at))
    yield pd.DataFrame(out, columns=["path", "change", "sha256", "scanned_at"])


def watch(versions: DataFrame) -> DataFrame:
    """(path, change, sha256, scanned_at): new, changed or deleted, per later version of a path.

    ``versions`` is a stream with path, sha256 (null: the file is gone) and
    scanned_at (timestamp).  A version older than the latest known one, or
    without a time, changes nothing; equal content changes nothing.
    """
    ship()
    rows = versions.filter("path IS NOT NULL").selectExpr("path", "sha256", "CAST(scanned_at AS timestamp) AS scanned_at")
    return rows.groupBy("path").applyInPandasWithState(_latest, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
