"""Digests of canonical JSON and what is dealt out by them."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimworks.functions.text import normalised


def json_string(text: Column) -> Column:
    """A string as JSON with other than ASCII left as it is; escapes in lower-case hexadecimal."""
    whole = F.to_json(F.array(text))
    inner = F.substring(whole, F.lit(2), F.length(whole) - 2)
    # Spark writes control characters as \\u00XX in upper case; only the digits A-F differ, and only in 1A..1F, 0B and so on.
    for c in [x for x in range(32) if any(d.isalpha() for d in f"{x:02x}") and x not in (8, 9, 10, 12, 13)] + [127]:
        inner = F.replace(inner, F.lit(f"\\u{c:04X}"), F.lit(f"\\u{c:04x}" if c < 32 else chr(c)))
    return inner


def digest(*texts: Column) -> Column:
    """sha256 of a JSON list of strings, as Python writes it."""
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *[json_string(t) for t in texts]), F.lit("]")), 256)


def text_group(text: Column) -> Column:
    """sha256 of a text's JSON string with white space normalised: equal for copies that differ in layout."""
    return F.sha2(json_string(normalised(text)), 256)


def input_hash(claim: Column, document: Column) -> Column:
    """sha256 of {claim, document} with sorted keys."""
    return F.sha2(F.concat(F.lit('{"claim": '), json_string(claim), F.lit(', "document": '), json_string(document), F.lit("}")), 256)


def prefix_number(hexadecimal: Column, digits: int = 8) -> Column:
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def pool(group: Column, tune: str = "tune", rest: str = "selection") -> Column:
    """Six in ten groups tune, the others select."""
    return F.when(prefix_number(group) % 10 < 6, tune).otherwise(rest)


def canonical(value) -> str:
    """Canonical JSON of a configuration."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def configuration_digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()
