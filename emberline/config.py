"""Settings of a run and the fixed value tables of the alert model."""

from __future__ import annotations

import ipaddress
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

# They must be these for right results.
SEVERITY_LABELS = {0: "Unknown", 1: "Informational", 2: "Low", 3: "Medium", 4: "High", 5: "Critical", 6: "Fatal"}
SEVERITY_NAMES = {
    "unknown": 0, "informational": 1, "info": 1, "low": 2, "medium": 3, "med": 3,
    "high": 4, "critical": 5, "fatal": 6,
}
SEVERITY_FLOORS = {"none": 0, "low": 2, "medium": 3, "high": 4, "critical": 5}
SEVERITY_WEIGHTS = {0: 0.0, 1: 1.0, 2: 2.0, 3: 4.0, 4: 8.0, 5: 16.0, 6: 32.0}
#: The tactics in the order of an attack: (uid, name). Command and control stands before exfiltration.
TACTICS = (
    ("TA0043", "reconnaissance"), ("TA0042", "resource development"), ("TA0001", "initial access"), ("TA0002", "execution"),
    ("TA0003", "persistence"), ("TA0004", "privilege escalation"), ("TA0005", "defense evasion"), ("TA0006", "credential access"),
    ("TA0007", "discovery"), ("TA0008", "lateral movement"), ("TA0009", "collection"), ("TA0011", "command and control"),
    ("TA0010", "exfiltration"), ("TA0040", "impact"),
)
#: Which identifier names an alert's main entity first.
PRECEDENCE = ("process_guid", "upn", "mac", "ip", "agent_uid", "hostname", "username")
#: Which identifier names an entity.
DISPLAY = ("hostname", "username", "upn", "agent_uid", "mac", "process_guid", "ip")


@dataclass(frozen=True)
class Prefilter:
    severity_floor: str = "medium"
    trusted_networks: tuple[str, ...] = ()
    service_accounts: tuple[str, ...] = ()
    scanner_hosts: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.severity_floor not in SEVERITY_FLOORS:
            raise ValueError(f"severity floor {self.severity_floor!r} is none of {sorted(SEVERITY_FLOORS)}")
        for n in self.trusted_networks:
            ipaddress.ip_network(n, strict=False)


@dataclass(frozen=True)
class Settings:
    window_minutes: int = 60
    evaluate_every_minutes: int = 5
    watermark_seconds: int = 60
    retention_minutes: int = 1440
    surface_threshold: float = 10.0
    reversed_factor: float = 0.5
    weights: dict[int, float] = field(default_factory=lambda: dict(SEVERITY_WEIGHTS))
    precedence: tuple[str, ...] = PRECEDENCE
    prefilter: Prefilter = Prefilter()
    top_k: int = 8
    max_evidence_chars: int = 24_000
    dashboard_url: str = ""

    @property
    def window_ms(self) -> int:
        return self.window_minutes * 60_000


def mapped(key: Column, table: dict, default=None) -> Column:
    """The table's value of a key; a key that isn't in it gives the default."""
    pairs = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))
