"""Counters, gauges and histograms taken while a job runs (`observe`), so that no second pass over the data is needed.

`Meter` collects them: from batches through `Observation`, from streams as a query listener, which also keeps how far each
stream is behind. A trigger that is run again after a failure counts once.
"""

from __future__ import annotations

import threading
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

COUNTER, GAUGE, LEAST = "counter__", "gauge__", "le__"


def measures(counters: dict[str, Column], gauges: dict[str, Column] | None = None, histograms: dict[str, tuple[Column, list[float]]] | None = None) -> list[Column]:
    """Aggregates for observe: rows for which a counter's condition holds, largest values of gauges, cumulative counts of histograms with their sums."""
    out = [F.count_if(c).alias(f"{COUNTER}{k}") for k, c in counters.items()]
    out += [F.max(c.cast("double")).alias(f"{GAUGE}{k}") for k, c in (gauges or {}).items()]
    for k, (value, bounds) in (histograms or {}).items():
        out += [F.count_if(value <= b).alias(f"{COUNTER}{k}_bucket{LEAST}{b}") for b in bounds]
        out += [F.count(value).alias(f"{COUNTER}{k}_bucket{LEAST}+Inf"), F.coalesce(F.sum(value.cast("double")), F.lit(0.0)).alias(f"{COUNTER}{k}_sum")]
    return out


class Meter(StreamingQueryListener):
    """Totals of counters, last values of gauges."""

    def __init__(self) -> None:
        self.lock = threading.Condition()
        self.counters: dict[str, float] = {}
        self.gauges: dict[str, float] = {}
        self.seen: dict[str, int] = {}

    def add(self, found: dict) -> None:
        for k, v in found.items():
            if v is None:
                continue
            if k.startswith(COUNTER):
                name = k.removeprefix(COUNTER)
                self.counters[name] = self.counters.get(name, 0) + v
            elif k.startswith(GAUGE):
                self.gauges[k.removeprefix(GAUGE)] = v

    def observed(self, rows: DataFrame, name: str, exprs: list[Column]) -> tuple[DataFrame, Observation]:
        """rows with measures, for `take` after the one action on them."""
        seen = Observation(name)
        return rows.observe(seen, *exprs), seen

    def take(self, seen: Observation) -> None:
        with self.lock:
            self.add(seen.get)

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.gauges["active_streams"] = self.gauges.get("active_streams", 0) + 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            if p.batchId > self.seen.get(str(p.id), -1):
                self.seen[str(p.id)] = p.batchId
                self.counters["stream_rows"] = self.counters.get("stream_rows", 0) + p.numInputRows
                for row in p.observedMetrics.values():
                    self.add(row.asDict())
                # Of a trigger's rows the newest against the time of the trigger; state rows over all operators.
                if newest := p.eventTime.get("max"):
                    at = lambda t: datetime.fromisoformat(t.replace("Z", "+00:00")).timestamp()
                    self.gauges["stream_lag_seconds"] = at(p.timestamp) - at(newest)
                self.gauges["stream_trigger_seconds"] = p.durationMs.get("triggerExecution", 0) / 1000
                self.gauges["stream_state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
            self.lock.notify_all()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.gauges["active_streams"] = self.gauges.get("active_streams", 1) - 1
            self.lock.notify_all()

    def ended(self, seconds: float = 60) -> bool:
        """Wait until every stream that began has ended, with its events told: they come from another thread."""
        with self.lock:
            return self.lock.wait_for(lambda: self.gauges.get("active_streams") == 0, seconds)

    def rows(self) -> list[tuple[str, str, str | None, float]]:
        """kind, name, le (a histogram's bound) and value of each, in order of name."""
        out = []
        for kind, found in (("counter", self.counters), ("gauge", self.gauges)):
            for k, v in found.items():
                name, _, bound = k.partition(LEAST)
                out.append((kind, name, bound or None, float(v)))
        return sorted(out, key=lambda r: (r[0], r[1], float(r[2] or 0)))

    def exposed(self) -> str:
        """Lines of text: name, bound in braces if any, value."""
        return "".join(f"{n}{{le=\"{b}\"}} {v:g}\n" if b else f"{n} {v:g}\n" for _, n, b, v in self.rows())
