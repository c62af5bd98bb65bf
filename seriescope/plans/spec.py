"""Stream definitions: what to count, by which labels, over which interval."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def parse_duration(text: str | int | float) -> int:
    """Microseconds of a duration such as ``15m``, ``1h30m`` or a number of seconds."""
    if isinstance(text, (int, float)):
        return round(text * 1_000_000)
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return round(sum(float(a) * UNITS[b] for a, b in parts) * 1_000_000)


def format_duration(us: int) -> str:
    """``15m0s``, ``1h0m0s``, ``1.5s``: the largest unit and all below it."""
    hours, rest = divmod(us, 3_600_000_000)
    minutes, rest = divmod(rest, 60_000_000)
    seconds = f"{rest / 1_000_000:.6f}".rstrip("0").rstrip(".")
    if hours:
        return f"{hours}h{minutes}m{seconds}s"
    return f"{minutes}m{seconds}s" if minutes else f"{seconds}s"


@dataclass(frozen=True)
class StreamSpec:
    """One stream. ``buckets`` and ``hll_sparse`` are accepted as configuration; partitions and sketches see to them here."""

    interval: str | int = "5m"
    group_by: tuple[str, ...] = ()
    group_limit: int = 10_000
    labels: dict[str, str] = field(default_factory=dict)
    buckets: int = 1
    hll_precision: int = 14
    hll_sparse: bool = True

    def __post_init__(self) -> None:
        object.__setattr__(self, "group_by", tuple(sorted(self.group_by or ())))
        if self.interval_us <= 0 or self.interval_us % 2:
            raise ValueError("interval must be positive and even in microseconds")
        if not 4 <= self.hll_precision <= 18:
            raise ValueError("hll_precision must be between 4 and 18")
        if self.group_limit <= 0 or self.buckets <= 0:
            raise ValueError("group_limit and buckets must be positive")
        for name in (*self.group_by, *self.labels):
            if not LABEL.fullmatch(name):
                raise ValueError(f"not a label name: {name!r}")

    @property
    def interval_us(self) -> int:
        return parse_duration(self.interval)

    @property
    def half_us(self) -> int:
        return self.interval_us // 2

    @property
    def interval_text(self) -> str:
        return format_duration(self.interval_us)

    @property
    def keys_text(self) -> str:
        return ",".join(self.group_by) or "__global__"


def load(text: str, storage_nodes: tuple[str, ...] = ()) -> list[StreamSpec]:
    """Stream definitions from YAML text (a mapping with ``streams``); unknown keys are errors. Without any text, nodes to merge must be named."""
    import yaml

    if not text and not storage_nodes:
        raise ValueError("neither streams nor storage nodes are given")
    told = yaml.safe_load(text) if text else {"streams": []}
    if not isinstance(told, dict) or set(told) - {"streams"}:
        raise ValueError("expected a mapping with the key streams")
    names = {f.name for f in fields(StreamSpec)}
    out = []
    for row in told.get("streams") or []:
        if unknown := set(row) - names:
            raise ValueError(f"unknown keys: {sorted(unknown)}")
        # None and zero mean the default.
        out.append(StreamSpec(**{k: v for k, v in row.items() if v or v is False}))
    return out


def projected(specs: list[StreamSpec]) -> list[str]:
    """Labels that any stream groups by; others matter only for the identity of a series."""
    return sorted({k for s in specs for k in s.group_by})
