"""Configuration: what to compute for which periods, sources, and system parameters."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.schemas import FEATURE_COLUMNS


@dataclass(frozen=True)
class Feature:
    """A feature and the periods, in bars, it is computed for."""

    name: str
    periods: tuple[int, ...]
    open: bool = True


@dataclass(frozen=True)
class System:
    """System parameters; times in milliseconds."""

    min_period: int = 60_000
    collect_latency: int = 50
    scale_rate: int = 1
    port_begin: int = 10086
    dump: bool = True
    dump_dir: str = "parquet_result"
    asof_date: str | None = None


@dataclass(frozen=True)
class Endpoint:
    ip: str
    port: int
    channel: str = ""

    @property
    def address(self) -> str:
        return f"tcp://{self.ip}:{self.port}"


@dataclass
class Plan:
    """Features by period, in publish order."""

    by_period: dict[int, list[str]] = field(default_factory=dict)

    @property
    def outputs(self) -> list[tuple[int, str]]:
        return [(p, f) for p, names in self.by_period.items() for f in names]


def merged(lists: list[list[int]]) -> list[int]:
    """Sorted union of sorted lists."""
    return sorted({x for xs in lists for x in xs})


def publish_plan(features: list[Feature], known=FEATURE_COLUMNS) -> Plan:
    """Periods ascending, each with its open features in the order listed; a feature that isn't ``known`` is an error."""
    for f in features:
        if f.name not in known:
            raise ValueError(f"unknown feature {f.name}")
    on = [f for f in features if f.open]
    return Plan({p: [f.name for f in on if p in f.periods] for p in merged([sorted(f.periods) for f in on])})


def load_publish(path: str) -> list[Feature]:
    """The ``trade`` list of a publish file."""
    return [Feature(x["name"], tuple(x["period"]), x.get("open", True)) for x in json.loads(Path(path).read_text())["trade"]]


def load_system(path: str) -> System:
    spec = json.loads(Path(path).read_text())
    s, mode = spec["system"], spec.get("mode", {})
    return System(s["min_period"], s["collect_latency(ms)"], s.get("scale_rate", 1), s["port_begin"], mode.get("dump", False), mode.get("dump_dir", "parquet_result"), s.get("date"))


def load_subscribe(path: str) -> dict[tuple[str, str], Endpoint]:
    """(kind, exchange) to endpoint."""
    spec = json.loads(Path(path).read_text())
    return {(kind, e.upper()): Endpoint(x["ip"], x["port"], x.get("channel", "")) for kind, by in spec.items() for e, x in by.items()}


def load_feature_format(path: str) -> dict[str, list[str]]:
    """Feature to its columns in output order."""
    return {name: list(columns) for name, columns in json.loads(Path(path).read_text()).items()}


def load_period_call(path: str, kind: str = "trade") -> tuple[Plan, dict[tuple[int, str], int]]:
    """The plan of a period_call file (what ``endpoints`` gives), and the port of each (period, feature)."""
    spec = json.loads(Path(path).read_text())
    plan = Plan({x["period"]: list(x["called_func"]) for x in spec[kind]})
    return plan, {(x["period"], f): port for x in spec[kind] for f, port in zip(x["called_func"], x["port"], strict=True)}


def endpoints(plan: Plan, port_begin: int, ip: str = "") -> dict:
    """One port for each output, counted up over periods and features."""
    out, port = [], port_begin
    for period, names in plan.by_period.items():
        out.append({"period": period, "called_func": names, "port": list(range(port, port + len(names)))})
        port += len(names)
    return {"ip": ip, "trade": out, "order": [], "depth": []}


def ports(outputs: DataFrame, port_begin: int) -> DataFrame:
    """(period, feature, port) of a frame of outputs (period, feature, place): ports count up over periods and, within each, places; a table of outputs has some hundreds of rows."""
    place = F.row_number().over(Window.orderBy("period", "place", "feature")) - 1
    return outputs.select("period", "feature", (place + port_begin).cast("int").alias("port"))


#: The shipped publish list.
SHIPPED = [
    Feature("candle_stick", (1, 5, 15, 30)),
    Feature("debug_trade", (1, 3, 10, 15), open=False),
    Feature("trade_amount_dollar", (1, 5, 15, 30)),
    Feature("trade_amount_std", (1, 5, 15, 30)),
    Feature("trade_amount_quantile", (1, 5, 15, 30)),
    Feature("order_flow_min", (1,)),
    Feature("order_flow_min_big", (1, 5, 15)),
    Feature("order_flow_min_small", (1, 5, 15)),
]
