"""The stateful alert processor for Structured Streaming.

Both detectors' state per ticker is one value (the reference runs two
keyed jobs over two scans of the topic):

* ``latched``    BOOLEAN - the target price was reached once (one-shot)
* ``last_close`` DOUBLE  - the previous usable close (null before the
                           first one); a stored 0 is never replaced again
                           (the zero latch)

Two Spark APIs run the same logic (``AlertLogic``):
``applyInPandasWithState`` (default) takes tickers by the *shard*: a call
and a state value per hash of the ticker, since a Python call per ticker
and micro-batch costs far more than its few rows; the state value lists
the shard's tickers as JSON (``jobs.stored_state`` reads it).
``transformWithStateInPandas`` (the newer API) keeps a state value per
ticker, each access a round trip to the state store.

Rows of one ticker in one micro-batch arrive unordered after the
shuffle, so they are sorted by the order columns first.  The detector
logic is vectorised over the batch with numpy (shift, cumulative
flags), not a per-row Python loop.  A micro-batch is bounded by the
source's ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``, which bounds
what one key brings into one call.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickwarden.schemas import ALERT, PERCENTAGE_CHANGE_ALERT, TARGET_PRICE_ALERT

# Spark joins a task's result frames itself, and some have columns of nulls only.
warnings.filterwarnings("ignore", message="The behavior of DataFrame concatenation", category=FutureWarning)

ALERT_COLUMNS = [f.name for f in ALERT.fields]
STATE_SCHEMA = "latched BOOLEAN, last_close DOUBLE"
# a shard's tickers, each with both detectors' state, as JSON
SHARD_STATE_SCHEMA = "held STRING"
HELD_SCHEMA = "tickers ARRAY<STRING>, latched ARRAY<BOOLEAN>, last_close ARRAY<DOUBLE>"
# stands for a null integer on its way to pandas, which knows none
NULL_INT = -(2**63)


def _empty() -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(dtype=_dtype(c)) for c in ALERT_COLUMNS})


def _dtype(col: str) -> str:
    if col == "timestamp":
        return "Int64"
    if col in ("ticker", "datetime", "alert_type"):
        return "object"
    return "float64"


def change_step(
    closes: np.ndarray, prev_state: float | None, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray, float | None]:
    """Previous-value detector over one ordered batch of non-null closes.

    Returns ``(index, previous, pct)`` of the alerting rows and the new
    state.  ``pct`` is ``rint(pct * 100) / 100`` like the batch plan.
    """
    n = len(closes)
    if n == 0:
        return np.array([], dtype=int), np.array([]), np.array([]), prev_state
    prev = np.empty(n)
    prev[0] = np.nan if prev_state is None else prev_state
    prev[1:] = closes[:-1]
    has_prev = np.ones(n, dtype=bool)
    has_prev[0] = prev_state is not None
    # a stored 0 blocks everything after it: the state never moves again
    zero_in_batch = closes == 0
    zero_before = np.zeros(n, dtype=bool)
    zero_before[1:] = np.cumsum(zero_in_batch[:-1]) > 0
    stuck = zero_before | (prev_state is not None and prev_state == 0)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        pct = (closes - prev) / prev * 100.0
        chg = np.rint(pct * 100.0) / 100.0
    ok = has_prev & ~stuck & (prev != 0) & ~np.isnan(chg) & (np.abs(chg) >= threshold)
    if prev_state is not None and prev_state == 0:
        new_state: float | None = 0.0
    elif zero_in_batch.any():
        new_state = 0.0
    else:
        new_state = float(closes[-1])
    idx = np.nonzero(ok)[0]
    return idx, prev[idx], chg[idx], new_state


def target_step(closes: np.ndarray, latched: bool, target: float) -> int | None:
    """Index of the row that fires the one-shot latch, if any."""
    if latched or len(closes) == 0:
        return None
    with np.errstate(invalid="ignore"):
        hit = ~np.isnan(closes) & (closes >= target)
    where = np.nonzero(hit)[0]
    return int(where[0]) if len(where) else None


def _same_value(a: float | None, b: float | None) -> bool:
    if a is None or b is None:
        return a is b
    return a == b or (a != a and b != b)


class AlertLogic:
    """Both detectors for one ticker and one micro-batch (ST-1 + ST-2 = ST-3).

    ``step`` takes the key's rows of the batch and the stored state
    ``(latched, last_close)`` and returns the alert rows (or ``None``)
    and the new state.  Shared by both streaming APIs below.
    """

    def __init__(
        self,
        target: float | None,
        threshold: float | None,
        order_by: Sequence[str] = ("timestamp",),
        target_alert_type: str = TARGET_PRICE_ALERT,
        change_alert_type: str = PERCENTAGE_CHANGE_ALERT,
    ) -> None:
        self.target = target
        self.threshold = threshold
        self.order_by = list(order_by)
        self.target_alert_type = target_alert_type
        self.change_alert_type = change_alert_type

    def step(
        self, frames: list[pd.DataFrame], latched: bool, prev_state: float | None
    ) -> tuple[pd.DataFrame | None, bool, float | None]:
        # Null closes were dropped before the shuffle (they never touch the
        # state), so every NaN here is a real NaN close.
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if batch.empty:
            return None, latched, prev_state
        # nulls first, like the batch window's ascending order
        order = np.lexsort([_sort_key(batch[c]) for c in reversed(self.order_by)])
        closes = batch["close"].to_numpy(dtype="float64")[order]
        ticker = batch["ticker"].to_numpy()[order]
        dt = batch["datetime"].to_numpy()[order]
        ts = batch["timestamp"].to_numpy()[order]
        parts: list[dict] = []
        new_latched, new_close = latched, prev_state

        if self.target is not None:
            i = target_step(closes, latched, self.target)
            if i is not None:
                new_latched = True
                parts.append(
                    {
                        "ticker": ticker[i : i + 1],
                        "datetime": dt[i : i + 1],
                        "timestamp": np.array([None], dtype=object),
                        "target_price": np.array([float(self.target)]),
                        "previous_price": np.array([np.nan]),
                        "current_price": closes[i : i + 1],
                        "price_change_percentage": np.array([np.nan]),
                        "alert_type": np.array([self.target_alert_type], dtype=object),
                    }
                )

        if self.threshold is not None:
            idx, prev, chg, new_state = change_step(closes, prev_state, self.threshold)
            if new_state is not None:
                new_close = float(new_state)
            if len(idx):
                n = len(idx)
                parts.append(
                    {
                        "ticker": ticker[idx],
                        "datetime": dt[idx],
                        "timestamp": ts[idx].astype(object),
                        "target_price": np.full(n, np.nan),
                        "previous_price": prev,
                        "current_price": closes[idx],
                        "price_change_percentage": chg,
                        "alert_type": np.full(n, self.change_alert_type, dtype=object),
                    }
                )
        if not parts:
            return None, new_latched, new_close
        out = pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in ALERT_COLUMNS})
        out["timestamp"] = pd.array(out["timestamp"], dtype="Int64")
        return out, new_latched, new_close


    def steps(
        self, frames: list[pd.DataFrame], held: dict[str | None, tuple[bool, float | None]]
    ) -> tuple[pd.DataFrame | None, dict[str | None, tuple[bool, float | None]]]:
        """``step`` for the rows of many tickers at once.

        ``held`` maps tickers to their state; returns the alert rows (or
        ``None``) and the states that changed.
        """
        batch = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        if batch.empty:
            return None, {}
        code, tickers = pd.factorize(batch["ticker"].to_numpy(dtype=object), use_na_sentinel=False)
        tickers = [None if pd.isna(t) else t for t in tickers]
        # nulls first, like the batch window's ascending order
        order = np.lexsort([*(_sort_key(batch[c]) for c in reversed(self.order_by)), code])
        code = code[order]
        closes = batch["close"].to_numpy(dtype="float64")[order]
        before = [held.get(t, (False, None)) for t in tickers]
        latched = np.array([b[0] for b in before], dtype=bool)
        has_state = np.array([b[1] is not None for b in before], dtype=bool)
        state = np.array([np.nan if b[1] is None else b[1] for b in before], dtype="float64")
        n = len(closes)
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        new_latched, new_state, has_new = latched.copy(), state.copy(), has_state.copy()
        parts: list[tuple[np.ndarray, dict]] = []

        if self.target is not None:
            with np.errstate(invalid="ignore"):
                at = np.flatnonzero(~np.isnan(closes) & (closes >= self.target) & ~latched[code])
            fired, firsts = np.unique(code[at], return_index=True)
            new_latched[fired] = True
            at = at[firsts]
            parts.append((at, {
                "timestamp": np.full(len(at), None, dtype=object),
                "target_price": np.full(len(at), float(self.target)),
                "previous_price": np.full(len(at), np.nan),
                "price_change_percentage": np.full(len(at), np.nan),
                "alert_type": np.full(len(at), self.target_alert_type, dtype=object),
            }))

        if self.threshold is not None:
            prev = np.empty(n)
            prev[1:] = closes[:-1]
            prev[first] = state[code[first]]
            has_prev = np.ones(n, dtype=bool)
            has_prev[first] = has_state[code[first]]
            # a stored 0 blocks everything after it: the state never moves again
            zero = closes == 0
            zeros = np.cumsum(zero)
            own_before = zeros - zero - np.repeat(zeros[first] - zero[first], last - first + 1)
            at_zero = has_state & (state == 0)
            with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                pct = (closes - prev) / prev * 100.0
                chg = np.rint(pct * 100.0) / 100.0
            ok = has_prev & (own_before == 0) & ~at_zero[code] & (prev != 0) & ~np.isnan(chg)
            at = np.flatnonzero(ok & (np.abs(chg) >= self.threshold))
            to_zero = at_zero[code[first]] | (zeros[last] - zeros[first] + zero[first] > 0)
            new_state[code[first]] = np.where(to_zero, 0.0, closes[last])
            has_new[:] = True
            ts = batch["timestamp"].to_numpy()[order[at]].astype(object)
            parts.append((at, {
                "timestamp": np.where(ts == NULL_INT, None, ts),
                "target_price": np.full(len(at), np.nan),
                "previous_price": prev[at],
                "price_change_percentage": chg[at],
                "alert_type": np.full(len(at), self.change_alert_type, dtype=object),
            }))

        same = (new_latched == latched) & (has_new == has_state) & (
            ~has_new | (new_state == state) | (np.isnan(new_state) & np.isnan(state))
        )
        changed = {
            tickers[i]: (bool(new_latched[i]), float(new_state[i]) if has_new[i] else None)
            for i in np.flatnonzero(~same).tolist()
        }
        if not any(len(at) for at, _ in parts):
            return None, changed
        rows = np.concatenate([at for at, _ in parts])
        out = pd.DataFrame({
            "ticker": batch["ticker"].to_numpy(dtype=object)[order[rows]],
            "datetime": batch["datetime"].to_numpy(dtype=object)[order[rows]],
            "current_price": closes[rows],
            **{c: np.concatenate([p[c] for _, p in parts]) for c in parts[0][1]},
        })[ALERT_COLUMNS]
        out["timestamp"] = pd.array(out["timestamp"], dtype="Int64")
        return out, changed


def _sort_key(col: pd.Series) -> np.ndarray:
    """Sortable values, nulls first: integers as int64, other numbers (and
    integers among nulls) as float64, anything else as text."""
    if pd.api.types.is_integer_dtype(col) and not col.isna().any():
        return col.to_numpy(np.int64)
    if pd.api.types.is_numeric_dtype(col):
        return col.astype("float64").fillna(-np.inf).to_numpy()
    text = col.astype(object).where(col.notna(), None)
    # a leading character keeps every null before every value
    return np.array(["" if v is None else "\x01" + str(v) for v in text], dtype=str)


def _unpack(stored) -> tuple[bool, float | None]:
    if stored is None:
        return False, None
    latched = bool(stored[0]) if stored[0] is not None else False
    return latched, stored[1]


def shard_state_function(logic: AlertLogic):
    """The function of a shard of tickers for ``applyInPandasWithState``: the
    state travels with the shard's rows (no state-store round trips)."""

    def detect(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = _held(state.get[0] if state.exists else None)
        out, changed = logic.steps(list(frames), held)
        if changed:
            held.update(changed)
            state.update((_held_text(held),))
        if out is not None:
            yield out

    return detect


def _held(text: str | None) -> dict[str | None, tuple[bool, float | None]]:
    if text is None:
        return {}
    stored = json.loads(text)
    return dict(zip(stored["tickers"], zip(stored["latched"], stored["last_close"])))


def _held_text(held: dict[str | None, tuple[bool, float | None]]) -> str:
    return json.dumps({
        "tickers": list(held), "latched": [v[0] for v in held.values()], "last_close": [v[1] for v in held.values()],
    })


REJECTED_COLUMNS = ["value", "reason", "offset"]


def tagged_state_function(logic: AlertLogic):
    """Both detectors for keys ``(shard, -1)``; records that gave no tick come
    under ``(null, n)`` with n >= 0 and pass through, without state.  A row of
    the output has a ``reason`` if and only if it is such a record."""
    alerts = shard_state_function(logic)

    def detect(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if key[1] >= 0:
            for frame in frames:
                out = frame[REJECTED_COLUMNS].reset_index(drop=True)
                out["offset"] = out["offset"].astype("Int64").mask(out["offset"] == NULL_INT)
                for c in ALERT_COLUMNS:
                    out[c] = pd.Series([None] * len(out), dtype=_dtype(c))
                yield out[ALERT_COLUMNS + REJECTED_COLUMNS]
            return
        for out in alerts(key, frames, state):
            for c in REJECTED_COLUMNS:
                out[c] = pd.Series([None] * len(out), index=out.index, dtype="Int64" if c == "offset" else "object")
            yield out

    return detect


class AlertProcessor(StatefulProcessor):
    """The same logic for ``transformWithStateInPandas`` (RocksDB state;
    one read and at most one write of the state value per key and batch)."""

    def __init__(self, logic: AlertLogic) -> None:
        self.logic = logic

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("detectors", STATE_SCHEMA)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Takes over the state of a history (ST-4)."""
        for latched, last_close in zip(initialState["latched"], initialState["last_close"]):
            self.state.update((bool(latched), float(last_close)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latched, prev_state = _unpack(self.state.get())
        out, new_latched, new_close = self.logic.step(list(rows), latched, prev_state)
        if new_latched != latched or not _same_value(new_close, prev_state):
            self.state.update((new_latched, new_close))
        if out is not None:
            yield out

    def close(self) -> None:
        pass
