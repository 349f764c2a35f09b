"""Conversion with few constant pairs as a Spark expression, without Python workers.

The text is cut into tokens, a source (the longest first) or a run of
characters that begin none; each token is looked up in a map.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Looking a token up walks the map, so it is kept small.
MOST_PAIRS = 200


def token_pattern(pairs: Iterable[tuple[str, str]]) -> str:
    """Works in Java's regular expressions and in RE2."""
    sources = sorted({f for f, _ in pairs}, key=lambda f: (-len(f), f))
    first = "".join(sorted({re.escape(f[0]) for f in sources}))
    return f"(?s)(?:[^{first}]+|{'|'.join(re.escape(f) for f in sources)}|.)"


def convert_expression(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Leftmost-longest conversion with at most MOST_PAIRS pairs."""
    table = {f: t for f, t in dict(pairs).items() if f}
    if not table:
        return text
    if len(table) > MOST_PAIRS:
        raise ValueError(f"at most {MOST_PAIRS} pairs; a Converter takes more")
    held = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    tokens = F.regexp_extract_all(text, F.lit(token_pattern(table.items())), F.lit(0))
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(held[t], t)), "")
