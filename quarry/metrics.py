"""Counters and timings of a workspace in the text format that monitoring systems scrape."""

from __future__ import annotations

from collections import Counter, defaultdict

# Upper bounds of the histograms in seconds.
BOUNDS = {
    "search": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0),
    "index": (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 60.0, 300.0, 600.0),
}


class Metrics:
    def __init__(self, prefix: str = "quarry"):
        self.prefix, self.counts, self.gauges, self.times = prefix, Counter(), {}, defaultdict(list)

    def count(self, name: str, by: int = 1) -> None:
        self.counts[name] += by

    def gauge(self, name: str, value: float) -> None:
        self.gauges[name] = value

    def observe(self, name: str, seconds: float) -> None:
        self.times[name].append(seconds)

    def text(self) -> str:
        out = []
        for name, v in sorted(self.counts.items()):
            out += [f"# TYPE {self.prefix}_{name}_total counter", f"{self.prefix}_{name}_total {v}"]
        for name, v in sorted(self.gauges.items()):
            out += [f"# TYPE {self.prefix}_{name} gauge", f"{self.prefix}_{name} {v:g}"]
        for name, seen in sorted(self.times.items()):
            full = f"{self.prefix}_{name}_seconds"
            out.append(f"# TYPE {full} histogram")
            out += [f'{full}_bucket{{le="{b:g}"}} {sum(s <= b for s in seen)}' for b in BOUNDS.get(name, BOUNDS["search"])]
            out += [f'{full}_bucket{{le="+Inf"}} {len(seen)}', f"{full}_sum {sum(seen):g}", f"{full}_count {len(seen)}"]
        return "\n".join(out) + "\n"
