"""Lines to entries.

Every line is matched by at most a short cascade of patterns. Whatever pattern matches, its
groups land in one array of fixed slots, so that the columns of an entry are written once
for all formats. The array leaves through a generator (`inline`), which later filters do not
pass: without it, a filter on a parsed column would be pushed down together with a second
copy of the pattern.
"""

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir import patterns as P
from logweir.functions.jsonfields import JsonLine, known_fields, wrapped_json
from logweir.functions.levels import keyword_level, status_level
from logweir.functions.numbers import float_prefix, int_prefix
from logweir.functions.regexes import capture, named_groups, to_java
from logweir.functions.text import compiles, strip
from logweir.functions.times import (
    access_date_text,
    access_offset_text,
    access_time,
    general_time,
    syslog_time,
)
from logweir.schema import ENTRIES, ENTRY_COLUMNS, FORMATS

# Order of the groups behind the kind in a captured array.
SLOTS = [
    "time", "level", "message", "ip", "method", "path", "status", "size", "user_agent",
    "response_time", "process",
]
# kind -> pattern and the number of the group that fills each slot
KINDS = {
    "apache": (P.APACHE_LINE, dict(ip=1, time=4, message=5, status=6, size=7, user_agent=9)),
    "nginx": (
        P.NGINX_ACCESS_LINE,
        dict(ip=1, time=3, message=4, status=5, size=6, user_agent=8, response_time=9),
    ),
    "nginx-error": (P.NGINX_ERROR_LINE, dict(time=1, level=2, message=6)),
    "syslog": (P.SYSLOG_LINE, dict(time=1, process=3, message=5)),
    "timestamped": (P.TIMESTAMPED_LINE, dict(time=1, level=2, message=3)),
    "bracketed": (P.BRACKETED_LINE, dict(time=1, level=2, message=3)),
}
ACCESS = ["apache", "nginx"]
# format -> kinds to try, in order
CASCADES = {
    "apache": ["apache"],
    "nginx": ["nginx", "nginx-error"],
    "json": [],
    "custom": ["syslog", "timestamped", "bracketed"],
}


def _captured(raw: Column, pattern: str, kind: str, groups: dict[str, int]) -> Column:
    return capture(raw, pattern, kind, [groups.get(slot) for slot in SLOTS])


def parse_lines(
    lines: DataFrame,
    format: str = "auto",
    pattern: str | None = None,
    honor_offset: bool = False,
    syslog_year: int | None = None,
) -> DataFrame:
    """All lines with the columns of an entry and ``parsed``, which tells if there is one.

    ``format`` is one of apache, nginx, json, custom, or ``auto`` for lines that carry a
    ``format`` column. ``pattern`` is a user pattern with named groups for the custom format.
    Works on batches and streams alike: no row depends on another.
    """
    if format == "auto" and "format" not in lines.columns:
        raise ValueError("format='auto' needs lines with a format column, see with_format")
    formats = list(FORMATS) if format == "auto" else [format if format in FORMATS else "custom"]
    of_line = F.col("format") if format == "auto" else F.lit(formats[0])
    if pattern:
        groups = named_groups(pattern)
        groups["time"] = groups.pop("timestamp", None)
        if not compiles(lines.sparkSession, to_java(pattern)):
            raise ValueError(f"not a valid pattern: {pattern}")
        kinds = KINDS | {"pattern": (pattern, groups)}
        cascades = CASCADES | {"custom": ["pattern"]}
    else:
        kinds, cascades = KINDS, CASCADES
    raw = F.col("raw")
    staged = lines.select(
        "file", of_line.alias("format"), "line_number", strip(F.col("value")).alias("raw")
    ).where(raw != "")

    def for_format(branches: dict[str, Column], otherwise=None) -> Column:
        """Pick by the format of the line; no test if only one format can occur."""
        if len(formats) == 1:
            return branches.get(formats[0], F.lit(otherwise))
        chain = reduce(lambda c, b: c.when(F.col("format") == b[0], b[1]), branches.items(), F)
        return chain.otherwise(otherwise)

    # Each step tries the next kind on lines no earlier kind has matched.
    depth = max(len(cascades[f]) for f in formats)
    groups_column = F.lit(None).cast("array<string>")
    for step in range(depth):
        tries = {
            f: _captured(raw, kinds[cascades[f][step]][0], cascades[f][step],
                         kinds[cascades[f][step]][1])
            for f in formats
            if len(cascades[f]) > step
        }
        tried = for_format(tries)
        if step:
            earlier = F.col(f"_groups{step - 1}")
            tried = F.when(F.get(earlier, F.lit(1)).isNotNull(), earlier).otherwise(tried)
        staged = staged.withColumn(f"_groups{step}", tried)
        groups_column = F.col(f"_groups{step}")
    json_column = F.lit(None)
    if "json" in formats:
        staged = staged.withColumn("_wrapped", for_format({"json": wrapped_json(raw)}))
        json_column = known_fields(raw, F.col("_wrapped"))
    time_group = F.get(groups_column, F.lit(SLOTS.index("time") + 2))
    has_access = any(kind in ACCESS for f in formats for kind in cascades[f])
    captured = F.struct(
        groups_column.alias("_groups"),
        json_column.alias("_json"),
        (access_date_text(time_group) if has_access else F.lit(None)).alias("_date"),
    )
    staged = staged.select("file", "format", "line_number", "raw", F.inline(F.array(captured)))

    kind, json_texts, columns = _entry_columns(
        lines.sparkSession.sparkContext.applicationId,
        tuple(formats),
        tuple(kind for f in formats for kind in cascades[f]),
        honor_offset,
        syslog_year,
    )
    staged = staged.withColumn("_kind", kind)
    if json_texts:
        staged = staged.select("*", *json_texts)
    return staged.select(
        *[columns[name].alias(name) if name in columns else F.col(name) for name in ENTRY_COLUMNS],
        F.col("_kind").isNotNull().alias("parsed"),
    )


@lru_cache(maxsize=64)
def _entry_columns(
    application: str,
    formats: tuple[str, ...],
    kinds: tuple[str, ...],
    honor_offset: bool,
    syslog_year: int | None,
) -> tuple[Column, list[Column], dict[str, Column]]:
    """Kind of a captured line, texts of its JSON fields, and the columns of its entry.

    They refer to columns by name only, so one application builds them once for all frames:
    building is some thousand calls into the JVM.
    """
    group = F.col("_groups")
    slot = {name: F.get(group, F.lit(i + 2)) for i, name in enumerate(SLOTS)}
    raw, possible = F.col("raw"), list(kinds)
    kind = F.get(group, F.lit(1))
    if "custom" in formats and "pattern" not in kinds:
        possible.append("plain")
        kind = F.when((F.col("format") == "custom") & kind.isNull(), "plain").otherwise(kind)
    if "json" in formats:
        possible.append("json")
        kind = F.when(F.col("_json").isNotNull(), "json").otherwise(kind)
    json = JsonLine(raw, F.col("_json"))
    json_texts = json.text_columns() if "json" in formats else []
    offset = access_offset_text(slot["time"]) if honor_offset else None
    access_at = access_time(F.col("_date"), offset)

    def by_kind(branches: dict) -> Column:
        """Pick by kind; large expressions are functions, built only if their kind can occur."""
        wanted = {k: v() if callable(v) else v for k, v in branches.items() if k in possible}
        chain = reduce(lambda c, b: c.when(F.col("_kind") == b[0], b[1]), wanted.items(), F)
        return chain.otherwise(None) if wanted else F.lit(None)

    def text(name: str) -> Column:
        return F.nullif(slot[name], F.lit(""))

    year = F.lit(str(syslog_year)) if syslog_year else F.year(F.current_date()).cast("string")
    request, message = slot["message"], strip(slot["message"])
    size = F.when(slot["size"] == "-", F.lit(0)).otherwise(int_prefix(slot["size"]))
    status = slot["status"].try_cast("int")

    def access(value: Column) -> dict[str, Column]:
        return dict.fromkeys(ACCESS, value)

    columns = {
        "timestamp": by_kind(
            access(access_at)
            | dict.fromkeys(
                ["nginx-error", "timestamped", "bracketed", "pattern"],
                lambda: general_time(slot["time"]),
            )
            | {"syslog": lambda: syslog_time(slot["time"], year), "json": lambda: json.timestamp}
        ),
        "level": by_kind(
            access(status_level(status))
            | dict.fromkeys(["nginx-error", "timestamped", "bracketed"], F.lower(slot["level"]))
            | {
                "pattern": F.coalesce(F.lower(text("level")), F.lit("info")),
                "syslog": keyword_level(slot["message"]),
                "plain": keyword_level(raw),
                "json": lambda: json.level,
            }
        ),
        "message": by_kind(
            access(F.coalesce(text("message"), raw))
            | dict.fromkeys(["nginx-error", "syslog", "timestamped", "bracketed"], message)
            | {"pattern": F.coalesce(text("message"), raw), "plain": raw, "json": lambda: json.message}
        ),
        "source": by_kind(
            {k: F.lit(k) for k in ["apache", "nginx", "nginx-error", "json", "plain"]}
            | dict.fromkeys(["timestamped", "bracketed", "pattern"], F.lit("custom"))
            | {"syslog": F.concat(F.lit("syslog:"), strip(slot["process"]))}
        ),
        "ip": by_kind(
            access(F.nullif(slot["ip"], F.lit("-"))) | {"pattern": text("ip"), "json": lambda: json.ip}
        ),
        "method": by_kind(
            access(F.nullif(F.split_part(request, F.lit(" "), F.lit(1)), F.lit("")))
            | {"pattern": text("method"), "json": lambda: json.method}
        ),
        "path": by_kind(
            access(F.nullif(F.split_part(request, F.lit(" "), F.lit(2)), F.lit("")))
            | {"pattern": text("path"), "json": lambda: json.path}
        ),
        "status": by_kind(
            access(status) | {"pattern": int_prefix(slot["status"], "int"), "json": lambda: json.status}
        ),
        "size": by_kind(access(size) | {"pattern": int_prefix(slot["size"]), "json": lambda: json.size}),
        "user_agent": by_kind(access(text("user_agent")) | {"json": lambda: json.user_agent}),
        "response_time": by_kind(
            {"nginx": float_prefix(slot["response_time"]), "json": lambda: json.response_time}
        ),
    }
    typed = {name: columns[name].cast(ENTRIES[name].dataType) for name in columns}
    return kind, json_texts, typed


def entries(parsed: DataFrame) -> DataFrame:
    """The entries among parsed lines."""
    return parsed.where("parsed").select(*ENTRY_COLUMNS)


def rejects(parsed: DataFrame) -> DataFrame:
    """The lines that gave no entry."""
    return parsed.where("NOT parsed").select("file", "line_number", "raw", "format")


def parse_logs(lines: DataFrame, format: str = "auto", **options) -> DataFrame:
    """Lines to entries; lines that cannot be parsed are left out."""
    return entries(parse_lines(lines, format, **options))
