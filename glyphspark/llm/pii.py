r"""Personal data: base patterns, and candidates judged by boosted trees (DataFrame operations only).

The base patterns find e-mail addresses, IP addresses, card and phone numbers.
Two generators of high recall propose further spans, secrets and number
groups, which may overlap; boosted trees judge format and context, and a
threshold for each generator, calibrated on held-out rows, selects. The trees
are fitted on the driver from at most ``ROWS`` labelled rows made by a seeded
generator, and evaluated as conditions on columns. All is a projection: no
shuffle, and no row depends on another.

Spans are found with two passes of a pattern: the matches, and the gaps between
them, whose lengths add up to positions in code points. Patterns are written
with possessive quantifiers, which match the same and need neither stack nor
backtracking on long runs.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import as_column, calibrated_threshold, fit, log_odds
from .common import cut, exclusive_scan, exclusive_sums, let, text_blocks

KINDS = ("email", "ip", "card", "phone", "secret", "number")
BASE = KINDS[:4]
#: The character a text must hold for a pattern to match, and the pattern. A match of the first starts where a run of its characters does, or where the match before ended.
PATTERNS = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "secret": ("", r"(?<![A-Za-z0-9+/_=-])(?=AKIA|ASIA|[A-Za-z+/_=-]{0,64}[0-9])[A-Za-z0-9+/_=-]{14,}+"),
    "number": ("", r"(?<![A-Za-z0-9.+-])[(]?[0-9]{2,4}[)]?(?:[\x20./-][(]?[0-9]{2,6}[)]?){1,5}(?![A-Za-z0-9])"),
}
ROWS, SEED, PRECISION = 2400, 7, 0.98
CONTEXT = 24


def matches(text: Column, pattern: str, holds: str = "") -> Column:
    """array<struct<start, end, s>> of a pattern's matches: code points, end exclusive."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,s:string>>")

    def placed(m: Column) -> Column:
        gap = F.transform(F.split(text, pattern, -1), lambda g: F.length(g).cast("long"))
        step = lambda g: F.zip_with(F.slice(g, 1, F.size(m)), m, lambda a, b: a + F.length(b))
        starts = let(gap, lambda g: F.zip_with(exclusive_sums(step(g)), F.slice(g, 1, F.size(m)), lambda a, b: a + b))
        return F.when(F.size(m) == 0, none).otherwise(F.zip_with(starts, m, lambda a, b: F.struct(a.alias("start"), (a + F.length(b)).cast("long").alias("end"), b.alias("s"))))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)
    return F.when(F.contains(text, F.lit(holds)), found).otherwise(none) if holds else found


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.split(F.reverse(digits), "")
    doubled = F.transform(d, lambda c, i: let(c.cast("int") * (i % 2 + 1), lambda v: F.when(v > 9, v - 9).otherwise(v)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "ip":
        return F.forall(F.split(m["s"], r"\."), lambda p: F.regexp_like(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))
    if kind in ("card", "phone"):
        low, high = (12, 19) if kind == "card" else (9, 15)

        def good(d: Column) -> Column:
            return F.length(d).between(low, high) & (luhn(d) if kind == "card" else F.lit(True))

        return let(F.regexp_replace(m["s"], "[^0-9]+", ""), good)
    return F.lit(True)


FEATURES = ("length", "digits", "uppers", "lowers", "others", "distinct", "groups", "first_digits", "changes", "assigned", "secret_word", "phone_word", "prefix", "date", "area")


def candidate_features(s: Column, before: Column) -> list[Column]:
    """Format and context of a candidate, in the order of FEATURES."""
    count = lambda p: F.regexp_count(s, F.lit(p)).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    n = F.length(s).cast("double")
    return [
        n, count("[0-9]") / n, count("[A-Z]") / n, count("[a-z]") / n, count("[^0-9A-Za-z]") / n, F.size(F.array_distinct(F.split(s, ""))) / n, count("[0-9]+"), F.length(F.regexp_extract(s, "[0-9]+", 0)).cast("double"),
        count("[A-Za-z][0-9]|[0-9][A-Za-z]"), flag(F.regexp_like(s, F.lit("^[A-Za-z_-]{2,24}="))), flag(F.regexp_like(F.concat(before, s), F.lit("(?i)(?:passw|pwd|secret|token|api.?key|credential)"))),
        flag(F.regexp_like(before, F.lit(r"(?i)(?:phone|tel\b|call|mobile|fax|ssn|social|account|\biban|passport)"))), flag(F.regexp_like(s, F.lit("^(?:AKIA|ASIA|sk-|ghp_|gho_|xox[bp]-|AIza|eyJ)"))),
        flag(F.regexp_like(s, F.lit(r"^(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}-[0-9]{2,4})$"))), flag(F.regexp_like(s, F.lit(r"^[(]?[0-9]{3}[)]?[\x20./-][0-9]{2,3}[\x20./-][0-9]{4}$"))),
    ]


def labelled_rows(n: int = ROWS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(generator, candidate, text before it, label) rows, half of them personal or secret."""
    r = random.Random(seed)
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    digits, lower, upper = string.digits, string.ascii_lowercase, string.ascii_uppercase
    hexa, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    word = lambda: pick(lower, r.randint(2, 9))
    plain = lambda: " ".join(word() for _ in range(r.randint(0, 4))) + " "

    def secret() -> tuple[str, str]:
        k = r.randrange(6)
        if k == 0:
            return f"{r.choice(['password', 'passwd', 'secret', 'token', 'api_key', 'pwd'])}={pick(hexa, r.randint(10, 32))}", plain()
        if k == 1:
            return f"AKIA{pick(upper + digits, 16)}", plain()
        if k == 2:
            return r.choice(["sk-", "ghp_", "xoxb-"]) + pick(mixed, r.randint(20, 40)), plain()
        if k == 3:
            return pick(mixed, r.randint(24, 44)), plain()
        if k == 4:
            return pick(hexa, r.choice([32, 40, 64])), plain() + r.choice(["secret: ", "token: ", "key ", ""])
        return f"{r.choice(['password', 'token'])}={pick(mixed, r.randint(8, 24))}", plain()

    def no_secret() -> tuple[str, str]:
        k = r.randrange(6)
        if k == 0:
            return f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}", plain()
        if k == 1:
            return "/".join([word(), str(r.randint(1990, 2030)), str(r.randint(1, 12)), word() + "-" + word()]), plain()
        if k == 2:
            return f"{word()}{word()}{word()}{r.randint(1, 99)}", plain()
        if k == 3:
            return f"{r.choice(['page', 'width', 'id', 'section', 'chapter'])}={word()}{r.randint(1, 9999)}", plain()
        if k == 4:
            return pick(digits, r.randint(14, 22)), plain()
        return f"{word()}_{word()}_{r.randint(1, 9999)}_{word()}", plain()

    def number() -> tuple[str, str]:
        a, b, c = pick(digits, 3), pick(digits, 3), pick(digits, 4)
        k = r.randrange(4)
        if k == 0:
            return f"({a}) {b}-{c}", plain()
        if k == 1:
            return r.choice("-. ").join([a, b, c]), plain() + r.choice(["", "phone ", "tel ", "call "])
        if k == 2:
            return f"{a}-{pick(digits, 2)}-{c}", plain() + r.choice(["", "ssn ", "social "])
        return " ".join(pick(digits, 4) for _ in range(r.randint(4, 5))), plain() + r.choice(["account ", "iban "])

    def no_number() -> tuple[str, str]:
        k = r.randrange(6)
        if k == 0:
            return f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", plain()
        if k == 1:
            return f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{r.randint(1900, 2030)}", plain()
        if k == 2:
            return f"{r.randint(1900, 2000)}-{r.randint(2001, 2030)}", plain()
        if k == 3:
            return ".".join(pick(digits, r.randint(2, 3)) for _ in range(r.randint(2, 3))), plain()
        if k == 4:
            return " ".join(pick(digits, r.randint(2, 4)) for _ in range(r.randint(2, 3))), plain()
        return f"{r.randint(10, 999)}/{r.randint(10, 999)}", plain()

    makers = [("secret", secret, 1), ("secret", no_secret, 0), ("number", number, 1), ("number", no_number, 0)]
    return [(kind, *make(), label) for i in range(n) for kind, make, label in [makers[i % 4]]]


def feature_table(spark: SparkSession, rows: list[tuple[str, str, str, int]]) -> np.ndarray:
    """The candidates' features, computed by the columns that judge them later."""
    told = F.from_json(F.lit(json.dumps([{"i": i, "s": s, "b": b[-CONTEXT:]} for i, (_, s, b, _) in enumerate(rows)])), "array<struct<i:int,s:string,b:string>>")
    x = spark.range(1).select(F.explode(told).alias("x")).select("x.*").select("i", *[c.alias(n) for c, n in zip(candidate_features(F.col("s"), F.col("b")), FEATURES, strict=True)])
    return np.array([list(r)[1:] for r in sorted(x.collect(), key=lambda r: r["i"])])


_MODELS: dict = {}


def model(spark: SparkSession, rows: int = ROWS, seed: int = SEED, precision: float = PRECISION) -> dict[str, tuple[list, float]]:
    """For each generator its trees and threshold, at least even odds. Two thirds of the rows fit, one third calibrates."""
    key = (rows, seed, precision)
    if key not in _MODELS:
        labelled = labelled_rows(rows, seed)
        x, y = feature_table(spark, labelled), np.array([r[3] for r in labelled], float)
        fitted = {}
        for kind in ("secret", "number"):
            of = np.array([i for i, r in enumerate(labelled) if r[0] == kind])
            held = np.arange(len(of)) // 2 % 3 == 2
            trees = fit(x[of[~held]], y[of[~held]])
            fitted[kind] = (trees, max(0.0, calibrated_threshold(log_odds(trees, x[of[held]]), y[of[held]], precision)))
        _MODELS[key] = fitted
    return _MODELS[key]


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id, the text, base and more: arrays of struct<start, kind, end>, kind as a place in KINDS.

    base has the patterns' matches that count; more has the judged candidates
    that overlap none of them. A null or empty text has none. Each row gives
    one row; of other columns those named in ``keep`` stay.
    """
    fitted = model(df.sparkSession)
    text = F.col("text")
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep or []])

    def base(kind: str) -> Column:
        holds, pattern = PATTERNS[kind]
        spans = F.filter(matches(text, pattern, holds), lambda m: valid(kind, m))
        return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    def judged(kind: str) -> Column:
        trees, least = fitted[kind]

        def good(m: Column, blocks: Column) -> Column:
            at = F.greatest(m["start"] - CONTEXT, F.lit(0))
            fs = F.struct(*[c.alias(n) for c, n in zip(candidate_features(m["s"], cut(blocks, at, m["start"] - at)), FEATURES, strict=True)])
            return let(fs, lambda f: as_column(trees, [f[n] for n in FEATURES]) >= F.lit(least))

        chosen = let(let(matches(text, PATTERNS[kind][1]), free), lambda ms: F.when(F.size(ms) == 0, ms).otherwise(let(text_blocks(text), lambda blocks: F.filter(ms, lambda m: good(m, blocks)))))
        return F.transform(chosen, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))

    def free(candidates: Column) -> Column:
        """Candidates that overlap no base span: of those base spans that start before a candidate's end, none ends after its start. Both are sorted together, so one pass over them tells."""
        no_match = F.lit(None).cast("struct<start:bigint,end:bigint,s:string>")
        nothing = F.lit(0).cast("long")
        base = F.transform("base", lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("turn"), b["end"].alias("end"), no_match.alias("m")))
        asked = F.transform(candidates, lambda m: F.struct(m["end"].alias("at"), F.lit(0).alias("turn"), nothing.alias("end"), m.alias("m")))

        def told(events: Column) -> Column:
            before = exclusive_scan(F.transform(events, lambda e: e["end"]), nothing, lambda a, b: F.greatest(a, b))
            free_ = F.filter(F.zip_with(events, before, lambda e, b: F.struct(((e["turn"] == 0) & (b <= e["m"]["start"])).alias("free"), e["m"].alias("m"))), lambda x: x["free"])
            return F.transform(free_, lambda x: x["m"])

        return F.when((F.size("base") == 0) | (F.size(candidates) == 0), candidates).otherwise(let(F.array_sort(F.concat(base, asked)), told))

    rows = rows.withColumn("base", F.array_sort(F.concat(*[base(k) for k in BASE])))
    return rows.withColumn("more", F.array_sort(F.concat(judged("secret"), judged("number"))))


def named(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of base spans by kind, base_sha256 and spans of every text."""
    f = find(df, id_col, text_col)

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return f.select(F.col("id").alias(id_col), *counts, F.sha2(named(F.col("base")), 256).alias("base_sha256"), named(F.array_sort(F.concat("base", "more"))).alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The id, the text with each span replaced by its kind in angle brackets, n_spans, and the columns in ``keep``.

    Where spans overlap, the one that starts first names what both cover. A
    null text stays null, an empty one empty. Repeated rows each give a row;
    an empty table gives none; a kept column may have any name but the id's
    and the text's. Time is in proportion to the text and to sorting its spans.
    """
    f = find(df, id_col, text_col, [*(keep or []), text_col])
    kinds = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    text = F.col("text")

    def clean(spans: Column, blocks: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        before = exclusive_scan(ends, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))  # where what earlier spans cover ends
        piece = lambda s, at: F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"] - at), F.element_at(kinds, s["kind"] + 1))).otherwise("")
        rest = let(F.array_max(ends), lambda at: cut(blocks, at, F.length(text) - at))
        return F.concat(F.array_join(F.zip_with(spans, before, piece), ""), rest)

    spans = F.array_sort(F.concat("base", "more"))
    told = let(spans, lambda s: let(text_blocks(text), lambda blocks: clean(s, blocks)))
    shown = F.when(F.col(f"keep_{text_col}").isNull(), F.lit(None).cast("string")).when(F.size("base") + F.size("more") == 0, text).otherwise(told)
    return f.select(F.col("id").alias(id_col), shown.alias(text_col), (F.size("base") + F.size("more")).alias("n_spans"), *[F.col(f"keep_{c}").alias(c) for c in keep or []])
