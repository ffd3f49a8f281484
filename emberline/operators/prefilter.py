"""Benign alerts are set aside by the first rule that matches: severity, trusted address, service account, scanner."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from emberline.config import SEVERITY_FLOORS, Prefilter
from emberline.functions.values import ipv4_number, ipv6_text, once


def trusted(text: Column, networks: tuple[str, ...]) -> Column:
    """Whether an address lies in one of the networks; what is no address is never trusted."""
    nets = [ipaddress.ip_network(n, strict=False) for n in networks]
    v4 = [(int(n[0]), int(n[-1])) for n in nets if n.version == 4]
    v6 = [(f"{int(n[0]):032x}", f"{int(n[-1]):032x}") for n in nets if n.version == 6]
    hit = F.lit(False)
    for a, b in v4:
        hit = hit | ipv4_number(text).between(a, b)
    for a, b in v6:
        hit = hit | ipv6_text(text).between(a, b)
    return F.coalesce(hit, F.lit(False))


def decide(alerts: DataFrame, rules: Prefilter) -> DataFrame:
    """``alerts`` with ``suppressed``, ``rule`` and ``matched`` (the value as it was written)."""
    floor = SEVERITY_FLOORS[rules.severity_floor]
    level = F.col("severity_id")
    lowered = lambda names: [n.lower() for n in names] or [""]
    low = (level > 0) & (level < floor)
    src, dev = trusted(F.col("src_ip"), rules.trusted_networks), trusted(F.col("device_ip"), rules.trusted_networks)
    account = F.coalesce(F.lower("username").isin(*lowered(rules.service_accounts)) & (F.col("username") != ""), F.lit(False))
    scanner = F.coalesce(F.lower("hostname").isin(*lowered(rules.scanner_hosts)) & (F.col("hostname") != ""), F.lit(False))
    rule = F.when(low, "severity_floor").when(src | dev, "trusted_ip").when(account, "expected_service_account").when(scanner, "approved_scanner_host")
    matched = F.when(low, level.cast("string")).when(src, F.col("src_ip")).when(dev, F.col("device_ip")).when(account, F.col("username")).when(scanner, F.col("hostname"))
    return alerts.withColumn("rule", rule).withColumn("matched", matched).withColumn("suppressed", F.col("rule").isNotNull())


def _bits(address: Column) -> Column:
    """The bits of an address behind its family, as text whose prefixes are its networks (null: no address)."""
    binary = lambda digits, n: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.lpad(F.conv(F.substring(digits, i, F.lit(1)), 16, 2), 4, "0")), "")
    bits = lambda family, digits, n: once(digits, lambda d: F.when(d.isNotNull(), F.concat(F.lit(family), binary(d, n))))
    six = F.when(address.contains(":"), bits("6:", ipv6_text(address), 32))
    return F.coalesce(bits("4:", F.lpad(F.hex(ipv4_number(address)), 8, "0"), 8), six)


def trusted_join(rows: DataFrame, networks: DataFrame, ip_col: str = "ip") -> DataFrame:
    """Longest-prefix match for network lists that are tables: ``rows`` with ``network``, the narrowest of
    ``networks(network string)`` that its address lies in (null: none), of equal ones the first by spelling.

    IPv4 and IPv6, each for itself; a network without a length is one address, bits beyond the length don't count, and what
    is no address or network matches nothing. Each distinct address is looked up once, by one equal key for each length
    that occurs among the networks (at most 163, and only the lengths reach the driver); a wide network with a third of all
    rows is so many addresses and no hot key, and equal addresses are reduced before the shuffle.
    """
    parts = F.split(F.trim("network"), "/")
    bits = _bits(F.get(parts, F.lit(0)))
    length = F.when(F.size(parts) == 1, F.length(bits) - 2).otherwise(F.get(parts, F.lit(1)).try_cast("int"))
    nets = networks.select("network", bits.alias("_bits"), length.alias("_length")).where(F.col("_length").between(0, F.length("_bits") - 2))
    nets = nets.withColumn("_key", F.expr("left(_bits, _length + 2)")).groupBy("_key").agg(F.min("network").alias("network"))
    sizes = [r[0] for r in nets.select(F.length("_key")).distinct().collect()]
    asked = rows.select(F.col(ip_col).alias("_ip")).where(F.col("_ip").isNotNull()).distinct().withColumn("_bits", _bits(F.col("_ip"))).where("_bits is not null")
    keys = F.array_compact(F.array(*(F.when(F.length("_bits") >= n, F.expr(f"left(_bits, {n})")) for n in sizes))) if sizes else F.array().cast("array<string>")
    met = asked.select("_ip", F.explode(keys).alias("_key")).join(nets, "_key")
    best = met.groupBy("_ip").agg(F.max_by("network", F.length("_key")).alias("network"))
    return rows.join(best, rows[ip_col] == best["_ip"], "left").drop("_ip")
