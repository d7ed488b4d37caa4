"""Text, clock and identifier functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_seconds(ms: Column) -> Column:
    """Whole seconds in UTC; the part below a second is dropped."""
    return F.date_format(F.timestamp_seconds(F.floor(ms / 1000)), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """Milliseconds of a date or of YYYY-MM-DDTHH:MM:SS[.fraction]Z; null if it is neither."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:\.(\d+))?Z$", 1)
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.(\d+)Z$", 1), 1, 3), 3, "0")
    seconds = F.when(whole != "", F.unix_millis(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss"))) + F.coalesce(fraction.try_cast("long"), F.lit(0)))
    date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))))
    return F.coalesce(seconds, date)


def confidence_units(x: Column) -> Column:
    """0..1 as 0..65,535, ties to even; null if out of range or not a number."""
    return F.when((x >= 0) & (x <= 1) & ~F.isnan(x), F.bround(x * 65_535).cast("long"))


def render_confidence(units: Column) -> Column:
    return F.format_string("%.5f", units / F.lit(65_535.0))


def lisp_string(text: Column) -> Column:
    """A quoted string with its five escapes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


# One pass from left to right: CSI to its final character, OSC to BEL or ESC backslash, ESC with any one character, controls.
_UNSAFE = "(?s)\\x1b\\[[^@-~]*[@-~]?|\\x1b\\].*?(?:\\x07|\\x1b\\\\|\\z)|\\x1b.?|[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x9f]"
_BLANK = "[\\t-\\r\\x85\\p{Z}]+"


def terminal_safe(text: Column) -> Column:
    """Without terminal escapes and control characters but tab and line ends."""
    return F.regexp_replace(text, _UNSAFE, "")


def preview(text: Column, most: int = 80) -> Column:
    """One line: white space collapsed, cut to 77 characters and an ellipsis beyond 80."""
    line = F.trim(F.regexp_replace(terminal_safe(text), _BLANK, " "))
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most - 3), F.lit("..."))).otherwise(line)


def token_estimate(text: Column) -> Column:
    """About four characters a token; 0 for blank text."""
    n = F.length(F.regexp_replace(text, r"^\s+|\s+$", ""))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("long")


def short_id(column: Column) -> Column:
    return F.substring(column, 1, 8)


def like_pattern(term: Column) -> Column:
    """A contains-pattern for LIKE with backslash escapes."""
    out = F.replace(term, F.lit("\\"), F.lit("\\\\"))
    for sign in "%_":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    return F.concat(F.lit("%"), out, F.lit("%"))


def workspace_id(url: Column) -> Column:
    """SHA-256 of the remote's URL, trimmed, with A-Z in lower case, without ``.git`` and a final slash; null for an empty one."""
    plain = F.regexp_replace(url, f"^{_BLANK}|{_BLANK}$", "")
    plain = F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\.git$", ""), "/$", "")
    return F.when(plain != "", F.sha2(plain, 256))


def origin_url(config: Column) -> Column:
    """The URL of the remote ``origin`` in the text of a git configuration; null if it has none.

    Comments and blank lines are skipped; the section's name may be quoted either way or bare.
    """
    lines = F.transform(F.split(config, "\r?\n"), lambda x: F.regexp_replace(x, f"^{_BLANK}|{_BLANK}$", ""))
    lines = F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith(";"))
    head = lambda x: F.regexp_replace(F.regexp_replace(x, r"^[\[\]]+|[\[\]]+$", ""), f"^{_BLANK}|{_BLANK}$", "")
    state = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("url"))

    def step(acc, line):
        value = F.regexp_extract(line, r"^url[\t-\r\p{Z}]*=(.*)$", 1)
        found = acc["inside"] & acc["url"].isNull() & line.rlike(r"^url[\t-\r\p{Z}]*=")
        inside = F.when(line.startswith("["), head(line).isin('remote "origin"', "remote 'origin'", "remote origin")).otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(found, F.regexp_replace(value, f"^{_BLANK}|{_BLANK}$", "")).otherwise(acc["url"]).alias("url"))

    return F.aggregate(lines, state, step, lambda acc: acc["url"])


def repository_slug(url: Column) -> Column:
    """owner/name of a remote URL, in URL or scp form."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(url), "/+$", ""), r"\.git$", "")
    path = F.when(plain.contains("://"), F.regexp_extract(plain, r"^[^:]+://[^/]+/(.+)$", 1)).otherwise(F.regexp_extract(plain, r"^[^:/]+:(.+)$", 1))
    return F.when(path != "", path)


def draft_id(text: Column, surface: Column, agent: Column, project: Column, operator: Column, provenance: Column) -> Column:
    """16 hex digits of SHA-256 over the fields, each ended by a NUL."""
    nul = F.lit("\x00")
    parts = [text, nul, surface, nul]
    for optional in (agent, project, operator, provenance):
        parts += [F.coalesce(optional, F.lit("")), nul]
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def quorum_slug(raw: Column) -> Column:
    """A file-safe name: 48 plain characters, a dash, and 16 hex digits of the hash."""
    suffix = F.substring(F.sha2(raw, 256), 1, 16)
    prefix = F.substring(F.regexp_replace(raw, "[^A-Za-z0-9_-]", "_"), 1, 48)
    return F.when(prefix == "", suffix).otherwise(F.concat(prefix, F.lit("-"), suffix))
