"""Row-wise text expressions: truncation, white space, names, rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All characters that count as white space, beyond what \s covers in Java.
SPACES = r"[\s\x0B\x1C-\x1F\x85\xA0  -     　]+"
MARKER = "\n[Middle of long document omitted]\n"


def normalised(text: Column) -> Column:
    """Every run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def truncated(text: Column, head: int, tail: int, cap: int) -> Column:
    """Texts over cap characters keep their first and last ones around a marker; a cap of 0 keeps all."""
    if not cap:
        return text
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(tail)))).otherwise(text)


def state(text: Column, cap: int) -> Column:
    """Truncation to three quarters of the cap from the start and the rest from the end."""
    head = 3 * cap // 4
    return truncated(text, head, cap - head, cap)


def is_truncated(text: Column, cap: int) -> Column:
    return F.length(text) > cap if cap else F.lit(False)


def slug(name: Column) -> Column:
    """The last part of a path, with everything but letters, digits, dots and hyphens as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(name, "/", -1), r"[^A-Za-z0-9.-]+", "-"), r"^-+|-+$", "")


def path_slug(name: Column, width: int = 80) -> Column:
    return F.substring(F.regexp_replace(name, r"[^a-zA-Z0-9_.-]", "_"), 1, width)


def renamed(name: Column, names: dict[str, str]) -> Column:
    """The name's entry in a table, or the name itself."""
    if not names:
        return name
    return F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[name], name)


def percent(value: Column, missing: str = "n/a") -> Column:
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string("%.2f", value * 100))


def number(cell: Column) -> Column:
    """The first number in a table's cell, emphasis and thousands separators aside."""
    return F.regexp_extract(F.replace(cell, F.lit(","), F.lit("")), r"[-+]?\d*\.?\d+", 0).try_cast("double")


def unmarked(cell: Column) -> Column:
    """A cell without bold and underline marks."""
    return F.regexp_replace(F.regexp_replace(cell, r"\*\*(.*?)\*\*", "$1"), r"<u>(.*?)</u>", "$1")


def pinned(model: Column) -> Column:
    """Whether a model name ends in a dotted version."""
    return model.rlike(r"-\d+(?:\.\d+)+$")


def usable_url(url: Column) -> Column:
    """An http(s) URL with a host and without credentials, query or fragment."""
    part = lambda p: F.parse_url(url, F.lit(p))
    return F.coalesce(part("PROTOCOL").isin("http", "https") & part("HOST").isNotNull() & part("USERINFO").isNull() & part("QUERY").isNull() & part("REF").isNull(), F.lit(False))


def safe_json(value: Column) -> Column:
    """JSON that can stand inside markup."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))


def prompt(template: str, **parts: Column) -> Column:
    """A template with {name} places filled from columns."""
    import re

    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[parts[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces) if i % 2 or p])


def options(criteria: dict[str, str] | None, labels: str = "AB") -> str:
    """The option lines that follow a question: its criteria, or the bare names."""
    return "\n".join(f"{letter}. {text or key}" for letter, (key, text) in zip(labels, (criteria or {"true": "", "false": ""}).items()))


def quotes_folded(text: Column) -> Column:
    """Curly quotes as straight ones, white space normalised, lower case."""
    return F.lower(normalised(F.translate(text, "‘’“”", "''\"\"")))
