"""Column functions of the query layer. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted spellings of true; the consumers differ in what they accept (fixed values).
TRUE_WORDS = {"report": ("1", "true", "yes", "y"), "benchmark": ("1", "true", "yes"), "worlds": ("1", "true"), "figures": ("1", "true", "yes", "y", "ok")}


def hash_uniform(seed: int, world: Column, u: Column, v: Column | None = None) -> Column:
    """A number in [0, 1) that depends on the arguments only; the same in SQL engines with md5."""
    parts = [F.lit(str(seed)), world.cast("string"), u.cast("string"), *([v.cast("string")] if v is not None else [])]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def budget(n: Column, rate: float | Column) -> Column:
    """Removal steps: rate * n, rounded half to even, from 1 to n."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    return F.greatest(F.lit(1), F.least(n.cast("long"), F.bround(n * rate).cast("long")))


def seed_budget(n: Column) -> Column:
    """Seeds to choose: 5 % of n, rounded half to even, from 3 to 12."""
    return F.greatest(F.lit(3), F.least(F.lit(12), F.bround(F.lit(0.05) * F.greatest(F.lit(1), n)).cast("long")))


def bool_text(c: Column, consumer: str = "report") -> Column:
    """Whether a text says true to the consumer; null is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*TRUE_WORDS[consumer]), F.lit(False))


def number_text(c: Column) -> Column:
    """The number in a table cell without marks (*, %) and units (s, h); null for placeholders and other text."""
    bare = F.regexp_replace(F.trim(F.regexp_replace(c, r"\*", "")), "[%sh]", "")
    return F.when(~F.trim(bare).isin("", "-", "incomplete", "timeout guard"), bare.try_cast("double"))


def finite(c: Column) -> Column:
    """Whether a number is neither null, NaN nor infinite."""
    x = c.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def close(a: Column, b: Column, tolerance: float = 5e-3) -> Column:
    """Equal within the tolerance; null equals null only."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= tolerance)


def short_id(code: Column, n: int = 12) -> Column:
    return F.substring(F.sha1(code), 1, n)


def run_token(c: Column) -> Column:
    """A name for folders: letters, digits, _, - and CJK ideographs; other runs become one _."""
    token = F.regexp_replace(F.regexp_replace(F.trim(c), r"[^0-9A-Za-z_\-\x{4e00}-\x{9fff}]+", "_"), "_+", "_")
    token = F.regexp_replace(token, "^_+|_+$", "")
    return F.when(token == "", F.lit("experiment")).otherwise(token)


def run_timestamp(c: Column) -> Column:
    """YYYYMMDD-HHMMSS from that, from 14 digits or from a date; null for other text."""
    t = F.trim(c)
    return F.when(t.rlike(r"^\d{8}-\d{6}$"), t).when(t.rlike(r"^\d{14}$"), F.concat(F.substring(t, 1, 8), F.lit("-"), F.substring(t, 9, 6))).when(t.rlike(r"^\d{8}$"), F.concat(t, F.lit("-000000")))


def fenced_code(response: Column, function: str) -> Column:
    """The first fenced block that defines the function, else the text from its definition on, else the text."""
    define = rf"def\s+{function}\s*\("
    blocks = F.regexp_extract_all(response, F.lit(r"(?is)```(?:python)?\s*(.*?)```"), F.lit(1))
    block = F.get(F.filter(blocks, lambda b: b.rlike(define)), F.lit(0))
    rest = F.regexp_extract(response, rf"(?s)({define}.*)", 1)
    return F.trim(F.coalesce(block, F.when(rest != "", rest), response), F.lit(" \t\n\r\x0b\x0c"))


def any_of(text: Column, *needles: str) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def code_flags(code: Column) -> dict[str, Column]:
    """What a candidate's code uses, by words in it (fixed values)."""
    low = F.lower(code)
    calls = F.regexp_count(low, F.lit(r"neighbors\("))
    return {
        "degree_backbone": low.contains("degree"),
        "frontier": any_of(low, "frontier", "boundary") | (calls >= 1),
        "weak_tie": any_of(low, "weak", "<= 2", "< 3"),
        "two_hop": any_of(low, "two_hop", "2-hop") | (calls >= 2),
        "boundary": low.contains("boundary") | (calls >= 2),
        "redundancy": any_of(low, "redund", "clustering", "has_edge"),
        "phase": any_of(low, "progress", "phase"),
        "heap_update": any_of(low, "heapq", "heappush"),
        "component_refresh": any_of(low, "connected_components", "number_connected_components"),
        "global_rescan": any_of(low, "betweenness", "pagerank", "all_pairs"),
        "unbounded_two_hop": (calls >= 2) & ~any_of(low, "cap", "limit", "break"),
        "neighbor_calls": calls,
    }


#: The flags that make a candidate's signature, in this order.
SIGNATURE = ("degree_backbone", "frontier", "weak_tie", "two_hop", "boundary", "redundancy", "phase", "heap_update")


def signature(flags: dict[str, Column]) -> Column:
    named = F.concat_ws("|", *[F.when(flags[k], F.lit(k)) for k in SIGNATURE])
    return F.when(named == "", F.lit("plain")).otherwise(named)


def code_family(code: Column, default: Column) -> Column:
    """The first family whose words the code has."""
    low = F.lower(code)
    calls = F.regexp_count(low, F.lit(r"neighbors\("))
    return (
        F.when(any_of(low, "connected_components", "number_connected_components"), "component-refresh")
        .when(low.contains("two") | (calls >= 2), "two-hop-boundary")
        .when(any_of(low, "clustering", "redund"), "redundancy-aware")
        .when(low.contains("heapq"), "heap-local-update")
        .when(low.contains("degree"), "degree-local")
        .otherwise(default)
    )


def contract_violation(code: Column) -> Column:
    """What a bounded candidate must not do and does, or ''."""
    flags = code_flags(code)
    says = "static contract violation: "
    return (
        F.when(flags["global_rescan"], says + "global centrality/rescan token")
        .when(flags["component_refresh"], says + "connected components refresh")
        .when(flags["unbounded_two_hop"], says + "unbounded two-hop scan")
        .when(any_of(F.lower(code), "shortest_path", "all_pairs"), says + "path search")
        .otherwise("")
    )


def json_object(text: Column) -> Column:
    """The text from the first { to the last }, or null."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def in_order(text: Column, left: str, right: str) -> Column:
    """Whether left stands in the text and right somewhere after it."""
    return text.rlike(f"(?s)\\Q{left}\\E.*\\Q{right}\\E")


def compressed_log(seconds: Column, low: float, fast: float) -> Column:
    """log10 of a time; below `low` the axis is compressed by `fast`."""
    x = F.log10(F.greatest(seconds, F.lit(1e-12)))
    return F.when(x < low, F.lit(low) + (x - low) * fast).otherwise(x)


def custom_order(value: Column, names: list[str]) -> Column:
    """A value's place in a list of names, from 1: what sorts by a custom order. Null for what the list doesn't have."""
    return F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), value), F.lit(0).cast("long"))
