"""Column expressions that render durations, counts and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("INFO", "WARNING", "CRITICAL")
# Short names of the detectors.
KINDS = {"long_transaction": "long-trx", "lock_chain": "lock-chain", "ddl_conflict": "ddl", "deadlock": "deadlock"}


def div(a: Column, b: int | Column) -> Column:
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a, b)


def _two(big: Column, big_unit: str, small: Column, small_unit: str, gap: str = "", drop_zero: bool = True) -> Column:
    head = F.concat(big.cast("string"), F.lit(big_unit))
    both = F.concat(head, F.lit(gap), small.cast("string"), F.lit(small_unit))
    return F.when(small == 0, head).otherwise(both) if drop_zero else both


def human_duration(ms: Column) -> Column:
    s = div(ms, 1000)
    m = div(s, 60)
    h = div(m, 60)
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, _two(m, "m", s % 60, "s")).otherwise(_two(h, "h", m % 60, "m"))


def format_duration(s: Column) -> Column:
    m = div(s, 60)
    h = div(m, 60)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(m < 60, _two(m, "m", s % 60, "s", drop_zero=False)).otherwise(_two(h, "h", m % 60, "m", drop_zero=False))


def parse_duration(text: Column) -> Column:
    """Seconds of a text like 19h14m; 0 for anything else."""
    total = F.lit(0).cast("long")
    for unit, factor in (("h", 3600), ("m", 60), ("s", 1)):
        parts = F.regexp_extract_all(text, F.lit(rf"(\d+){unit}"), 1)
        total = total + F.aggregate(F.transform(parts, lambda x: x.cast("long")), F.lit(0).cast("long"), lambda a, x: a + x) * factor
    return F.when(text.rlike(r"^(?:\d+[hms])+$"), total).otherwise(0)


def human_uptime(s: Column) -> Column:
    m, h, d = div(s, 60), div(s, 3600), div(s, 86400)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(m.cast("string"), F.lit("m"))).when(s < 86400, _two(h, "h", m % 60, "m", " ")).otherwise(_two(d, "d", h % 24, "h", " "))


def half_up(x: Column, digits: int) -> Column:
    """A double rounded to ``digits`` as SQL engines do: scaled, halves away from zero, scaled back. `round` itself takes
    the double's shortest decimal text, which may be a half where the scaled value is none."""
    return F.round(x * 10.0**digits) / 10.0**digits


def format_latency(ns: Column) -> Column:
    """Seconds have two decimals of the double's exact value, as C's printf has them; `format_string` would round its
    shortest decimal text, `format_number` takes the exact value (and its ties to even). ``ns`` may be a decimal."""
    unit = lambda n, u: F.concat(div(ns, n).cast("string"), F.lit(u))
    return F.when(ns == 0, "-").when(ns >= 10**9, F.concat(F.call_function("format_number", ns / 1e9, F.lit("0.00")), F.lit("s"))).when(ns >= 10**6, unit(10**6, "ms")).when(ns >= 1000, unit(1000, "µs")).otherwise(unit(1, "ns"))


def format_big_count(n: Column) -> Column:
    return F.when(n >= 10**9, F.format_string("%.1fB", n / 1e9)).when(n >= 10**6, F.format_string("%.1fM", n / 1e6)).when(n >= 1000, F.format_string("%.1fk", n / 1e3)).otherwise(n.cast("string"))


def format_rate(r: Column) -> Column:
    return F.when(r >= 1000, F.format_string("%.1fk", r / 1000)).otherwise(F.format_string("%.0f", r))


def format_bytes(n: Column) -> Column:
    return F.when(n >= 2**30, F.format_string("%.1fGB", n / float(2**30))).when(n >= 2**20, F.format_string("%.0fMB", n / float(2**20))).when(n >= 2**10, F.format_string("%.0fKB", n / 1024.0)).otherwise(F.concat(n.cast("string"), F.lit("B")))


def strip_port(host: Column) -> Column:
    return F.regexp_replace(host, r":[^:]*$", "")


def compact_version(version: Column) -> Column:
    return F.substring_index(version, "-", 1)


def truncate_text(text: Column, most: int) -> Column:
    cut = F.left(text, F.lit(most)) if most <= 3 else F.concat(F.left(text, F.lit(most - 3)), F.lit("..."))
    return F.when(F.length(text) <= most, text).otherwise(cut)


def collapse_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def severity_label(severity: Column) -> Column:
    return F.when(severity == 2, "CRITICAL").when(severity == 1, "WARNING").otherwise("INFO")


def issue_kind(detector: Column) -> Column:
    out = F
    for name, kind in KINDS.items():
        out = out.when(detector == name, kind)
    return out.otherwise(detector)


def ps_to_ns(ps: Column) -> Column:
    return div(ps, 1000)


def lock_type_buckets(counts: Column) -> Column:
    """'38×SHARED_READ 6×EXCLUSIVE' of [(lock_type, n)], by count, then name; '—' if empty."""
    order = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["lock_type"] < b["lock_type"], -1).when(a["lock_type"] > b["lock_type"], 1).otherwise(0)
    text = F.array_join(F.transform(F.array_sort(counts, order), lambda x: F.concat(x["n"].cast("string"), F.lit("×"), x["lock_type"])), " ")
    return F.when(F.size(counts) > 0, text).otherwise("—")
