"""Reading values out of JSON records (VARIANT) and casting them with an error text instead of an exception."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime
from itertools import combinations

from pyspark.sql import Column, functions as F

from emberline.config import SEVERITY_NAMES, mapped


def _json_path(keys: tuple[str, ...]) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys)


def _splits(path: str) -> list[tuple[str, ...]]:
    """Ways to read a dotted path: as one flat key, then key by key, then with ever longer flat parts from the left."""
    parts = path.split(".")
    n = len(parts)
    cuts = [c for k in range(n) for c in combinations(range(1, n), k)]
    bounds = lambda c: list(zip((0, *c), (*c, n)))
    order = lambda c: (c != (), [-n - 1 if b - a == 1 else a - b for a, b in bounds(c)])
    return [tuple(".".join(parts[a:b]) for a, b in bounds(c)) for c in sorted(cuts, key=order)]



def kind(v: Column) -> Column:
    """STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, OBJECT, ARRAY or VOID."""
    return F.regexp_extract(F.schema_of_variant(v), r"^[A-Z]+", 0)


def present(v: Column) -> Column:
    """The value, or null for what counts as missing: JSON null and the empty list. An empty string is present."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v) & (F.schema_of_variant(v) != "ARRAY<VOID>"), v)


def lookup_sql(record: str, path: str) -> str:
    """SQL of the value at a dotted path whose keys may be flat, nested or mixed (null: missing)."""
    gets = [f"""try_variant_get({record}, "{_json_path(keys)}", 'variant')""" for keys in _splits(path)]
    return f"coalesce({', '.join(gets)})" if len(gets) > 1 else gets[0]


def each_sql(record: str, path: str) -> tuple[str, str]:
    """As ``lookup_sql``, but through a list on the way: SQL of the present values of its elements (an array of variants,
    null if there are none), and of whether there is a list within the list."""
    parts = path.split(".")
    found, nested = [], []
    for k in range(len(parts) - 1, 0, -1):
        items = f"try_variant_get({lookup_sql(record, '.'.join(parts[:k]))}, '$', 'array<variant>')"
        inner = parts[k:]
        found.append(f"filter(transform({items}, x -> {lookup_sql('x', '.'.join(inner))}), y -> y is not null)")
        nested += [f"coalesce(exists({items}, x -> schema_of_variant({lookup_sql('x', '.'.join(inner[:m]))}) like 'ARRAY%'), false)" for m in range(1, len(inner))]
    # the list is the one at the first prefix that holds one; the others give null or nothing
    values = f"filter(flatten(array_compact(array({', '.join(found)}))), y -> true)" if found else "cast(null as array<variant>)"
    return values, " or ".join(nested) or "false"


def failed(value: Column, target: str) -> Column:
    return F.concat(F.lit(f"{target}: can't use "), F.substring(F.to_json(value), 1, 80))


def first(v: Column) -> Column:
    """Element 0 of a list; anything else unchanged."""
    return F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$[0]", "variant")).otherwise(v)


def to_text(v: Column) -> Column:
    """Strings as they are, numbers in their JSON form; null for the rest."""
    return F.when(kind(v).isin("STRING", "BIGINT", "DECIMAL", "DOUBLE"), F.coalesce(F.try_variant_get(v, "$", "string")))


def to_int(v: Column) -> Column:
    """Integers, whole floats and strings that hold an integer; null for the rest, booleans and 4.5 included."""
    number = F.try_variant_get(v, "$", "double")
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))
        .when(kind(v).isin("DECIMAL", "DOUBLE") & (number == F.floor(number)), number.cast("bigint"))
        .when((kind(v) == "STRING") & text.rlike(r"^[+-]?\d{1,18}$"), text.try_cast("bigint"))
    )


def severity(v: Column) -> Column:
    """0 to 6 from a number, digits or a name (of a list: its first element); null for the rest."""
    v = first(v)
    text = F.lower(F.trim(F.try_variant_get(v, "$", "string")))
    number = F.when(text.rlike(r"^\d$"), text.try_cast("int"))
    whole = F.try_variant_get(v, "$", "double")
    by_number = F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE") & (whole == F.floor(whole)), whole.cast("int"))
    value = F.coalesce(by_number, F.when(kind(v) == "STRING", F.coalesce(number, mapped(text, SEVERITY_NAMES))))
    return F.when(value.between(0, 6), value)


#: Named transforms a mapping may ask for; a caller can add its own before compiling one.
TRANSFORMS = {
    "first": first,
    "int": to_int,
    "str": to_text,
    "lower": lambda v: F.lower(to_text(v)),
}


def _epoch_ms(n: Column) -> Column:
    return F.when(F.abs(n) >= 1e12, n).otherwise(n * 1000)


def text_to_ms(text: Column, offset_minutes: int = 0, assume_year: int | None = None) -> Column:
    """Epoch milliseconds of a string: digits, ISO 8601 (a zone or the offset) or syslog time; null for the rest."""
    t = F.trim(text)
    year = assume_year or datetime.now(UTC).year
    naive = F.lit(offset_minutes * 60_000)
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,9})?)?)?(Z|[+-]\d{2}(:?\d{2})?)?$"
    zoned = t.rlike(r"(Z|[T ].*[+-]\d{2}(:?\d{2})?)$")
    canonical = F.regexp_replace(F.regexp_replace(t, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    canonical = F.when(zoned, canonical).otherwise(t)
    parsed = F.unix_millis(canonical.try_cast("timestamp")) - F.when(zoned, F.lit(0)).otherwise(naive)
    syslog = F.try_to_timestamp(F.concat(F.lit(f"{year} "), F.regexp_replace(t, r"\s+", " ")), F.lit("yyyy MMM d HH:mm:ss"))
    return (
        F.when(t.rlike(r"^-?\d{9,18}$"), _epoch_ms(t.try_cast("bigint")).cast("bigint"))
        .when(t.rlike(r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}$"), F.unix_millis(syslog) - naive)
        .when(t.rlike(iso), parsed)
    )


def to_ms(v: Column, offset_minutes: int = 0, assume_year: int | None = None) -> Column:
    """As ``text_to_ms`` for a JSON value; numbers from 1e12 on are milliseconds, smaller ones seconds."""
    number = _epoch_ms(F.try_variant_get(v, "$", "double")).cast("bigint")
    return F.when(kind(v).isin("BIGINT", "DECIMAL", "DOUBLE"), number).when(kind(v) == "STRING", text_to_ms(F.try_variant_get(v, "$", "string"), offset_minutes, assume_year))


def iso_ms(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def mac(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "-", ":")


IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number (null: not one)."""
    p = F.split(F.trim(text), r"\.")
    part = lambda k: F.get(p, F.lit(k)).try_cast("bigint")
    return F.when(F.trim(text).rlike(IPV4), ((part(0) * 256 + part(1)) * 256 + part(2)) * 256 + part(3))


def ipv6_text(text: Column) -> Column:
    """An IPv6 address as 32 lower-case hex digits, which sort as the addresses do (null: not one)."""
    t = F.lower(F.trim(text))
    halves = F.split(t, "::")
    groups = lambda s: F.filter(F.split(s, ":"), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    full = F.when(F.size(halves) == 2, F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)).otherwise(left)
    valid = t.contains(":") & t.rlike(r"^[0-9a-f:]+$") & (F.size(halves) <= 2) & (F.size(full) == 8) & ~F.exists(full, lambda g: F.length(g) > 4) & ((F.size(halves) == 1) | (missing >= 1))
    return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, with a value that ``f`` uses often made once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def address(text: Column) -> Column:
    """An address as it is compared: without spaces, in lower case, and of IPv6 the short form, the first of the longest rows
    of two or more zero groups as ``::`` (empty: null). What is no address stays as it is."""
    row = lambda n: "(^|:)0" + ":0" * (n - 1) + "(:|$)"
    joined = lambda digits: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.regexp_replace(F.substring(digits, k * 4 + 1, F.lit(4)), "^0{1,3}", "")), ":")
    cut = lambda g: F.coalesce(*(F.when(g.rlike(row(n)), F.regexp_replace(g, "^(.*?)" + row(n), "$1::")) for n in range(8, 1, -1)), g)
    six = lambda t: once(ipv6_text(t), lambda digits: F.when(digits.isNotNull(), once(joined(digits), cut)))
    return once(F.nullif(F.lower(F.trim(text)), F.lit("")), lambda t: F.when(t.contains(":"), F.coalesce(six(t), t)).otherwise(t))
