"""The host's own measurements as Python data sources: one nested snapshot, and one row for each process."""

from __future__ import annotations

import os
import time

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Shares are percentages; sizes and rates are bytes.
SNAPSHOT = (
    "timestamp double, cpu struct<usage_percent double, count int, frequency double, load_1min double, load_5min double, load_15min double>, "
    "memory struct<total bigint, available bigint, used bigint, usage_percent double>, disk struct<total bigint, used bigint, free bigint, usage_percent double>, "
    "network struct<bytes_sent bigint, bytes_recv bigint, packets_sent bigint, packets_recv bigint>, system struct<uptime double, boot_time double>, temperatures map<string, double>"
)
PROCESSES = "pid bigint, name string, cpu_percent double, memory_percent double, cpu_seconds double, memory_mb double"
#: Seconds over which shares of the CPU are measured.
SAMPLE_S = 0.1


def _lines(path: str) -> list[str]:
    try:
        with open(path) as f:
            return f.read().splitlines()
    except OSError:
        return []


def _share(used: float, total: float) -> float:
    return round(100 * used / total, 1) if total else 0.0


def _cpu_times() -> tuple[int, int]:
    """(busy, all) ticks of all CPUs since the start."""
    fields = [int(x) for x in _lines("/proc/stat")[0].split()[1:9]]
    return sum(fields) - fields[3] - fields[4], sum(fields)


def _frequency() -> float:
    """MHz, 0 where the host doesn't say."""
    found = [float(x.split(":")[1]) for x in _lines("/proc/cpuinfo") if x.startswith("cpu MHz")]
    return sum(found) / len(found) if found else 0.0


def _network() -> tuple[int, int, int, int]:
    """(bytes sent, bytes received, packets sent, packets received) over all interfaces."""
    rows = [x.split(":")[1].split() for x in _lines("/proc/net/dev")[2:]]
    return tuple(sum(int(r[i]) for r in rows) for i in (8, 0, 9, 1))


def _process_ticks() -> dict[int, tuple[str, int, int]]:
    """pid: (name, ticks, pages)."""
    out = {}
    for pid in filter(str.isdigit, os.listdir("/proc")):
        text = "\n".join(_lines(f"/proc/{pid}/stat"))
        if "(" in text:  # else it has ended meanwhile
            name, rest = text.split("(", 1)[1].rsplit(")", 1)
            fields = rest.split()
            out[int(pid)] = name or "Unknown", int(fields[11]) + int(fields[12]), int(fields[21])
    return out


def _memory() -> tuple[int, int, int, float]:
    kb = {x.split(":")[0]: int(x.split()[1]) for x in _lines("/proc/meminfo") if len(x.split()) > 1}
    total, free = kb["MemTotal"] * 1024, kb.get("MemAvailable", 0) * 1024
    return total, free, total - free, _share(total - free, total)


def _temperatures() -> dict[str, float]:
    """Degrees by sensor: a chip's name, with a number where it has several."""
    by_chip: dict[str, list[float]] = {}
    base = "/sys/class/thermal"
    for zone in sorted(os.listdir(base)) if os.path.isdir(base) else ():
        value = _lines(f"{base}/{zone}/temp")
        if value and value[0].lstrip("-").isdigit():
            by_chip.setdefault((_lines(f"{base}/{zone}/type") or [zone])[0], []).append(int(value[0]) / 1000)
    return {f"{chip}_{i}" if len(v) > 1 else chip: x for chip, v in by_chip.items() for i, x in enumerate(v)}


class _Reader(DataSourceReader):
    def __init__(self, kind: str) -> None:
        self.kind = kind

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition):
        before, processes = _cpu_times(), _process_ticks() if self.kind == "processes" else {}
        time.sleep(SAMPLE_S)
        busy, ticks = (b - a for a, b in zip(before, _cpu_times(), strict=True))
        memory = _memory()
        if self.kind == "snapshot":
            disk, now = os.statvfs("/"), time.time()
            total, used, free = disk.f_blocks * disk.f_frsize, (disk.f_blocks - disk.f_bfree) * disk.f_frsize, disk.f_bavail * disk.f_frsize
            uptime = float(_lines("/proc/uptime")[0].split()[0])
            yield now, (_share(busy, ticks), os.cpu_count(), _frequency(), *os.getloadavg()), memory, (total, used, free, _share(used, total)), _network(), (uptime, now - uptime), _temperatures()
            return
        tick, page = os.sysconf("SC_CLK_TCK"), os.sysconf("SC_PAGE_SIZE")
        for pid, (name, spent, pages) in _process_ticks().items():
            share = 100 * (spent - processes[pid][1]) / tick / SAMPLE_S if pid in processes else 0.0
            yield pid, name, share, 100 * pages * page / memory[0], spent / tick, round(pages * page / 2**20, 1)


class HostSource(DataSource):
    """spark.read.format("host").option("kind", "snapshot" or "processes")."""

    @classmethod
    def name(cls) -> str:
        return "host"

    def schema(self) -> str:
        return SNAPSHOT if self._kind() == "snapshot" else PROCESSES

    def _kind(self) -> str:
        return self.options.get("kind", "snapshot")

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self._kind())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HostSource)
