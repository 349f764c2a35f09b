"""Quality rules with line frequencies over documents (DataFrame operations only).

Base rules look at one text. The cross-document rule hashes normalised lines,
counts the distinct documents of each host that have them, takes lines above
the host's limit for boilerplate, removes them, and rejects documents of which
too little is left. Documents are told apart by their texts: copies of a text
count once, so copying alone makes no line boilerplate. Where near copies are
depleted because they share their lines, and no other document of the host
keeps these, one document stays for each least of such lines, so that no text
goes with all its copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, materialize, words

WINDOW = 8
MIN_WORDS, MOST_REPEATED = 20, 30
#: Documents of a host that a line may be in, at least and as a share; a document is depleted if less than one word in so many is left.
LINE_DOCS, LINE_SHARE, LEFT_PART = 10, 0.01, 3


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words in windows that the array of words has twice or more.

    Most texts have none: their distinct window hashes are as many as the
    windows. For others the starts of repeated windows are found by sorting,
    and each covers the words up to the next start, ``window`` at most.
    """

    def starts(h: Column) -> Column:
        def near(s: Column) -> Column:
            n = F.size(s)
            same = lambda i, j: F.coalesce(F.element_at(s, i)["h"] == F.element_at(s, j)["h"], F.lit(False))
            twice = F.filter(F.sequence(F.lit(1), n), lambda i: ((i > 1) & same(F.greatest(i - 1, F.lit(1)), i)) | ((i < n) & same(F.least(i + 1, n), i)))
            return F.array_sort(F.transform(twice, lambda i: F.element_at(s, i)["i"]))

        return let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), near)

    def covered(p: Column) -> Column:
        n = F.size(p)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(i == n, F.lit(window)).otherwise(F.least(F.element_at(p, F.least(i + 1, n)) - F.element_at(p, i), F.lit(window)))).cast("long")

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(starts(h), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))
    return F.when(F.size(w) <= window, F.lit(0).cast("long")).otherwise(let(hashes, count))


def line_hash(line: Column) -> Column:
    """64 bits of a normalised line's MD5; their order chooses the least line of a document."""
    return F.unhex(F.substring(F.md5(line), 1, 16))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def features(text: Column) -> Column:
    """The base features of a text, and its lines as (hash, words)."""
    t = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        norm = F.transform(lines, normalised)
        held = F.transform(norm, lambda x: F.struct(line_hash(x).alias("h"), F.size(F.split(x, " ")).alias("n")))
        return F.struct((F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"), held.alias("lines"))

    lines = F.filter(F.split(t, "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    symbols = F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long")
    return F.struct(let(words(t), of_words).alias("w"), let(lines, of_lines).alias("l"), symbols.alias("n_symbols"))


KEY = ("__key1", "__key2")


def _keys(id_col: str, text_col: str, host_col: str) -> list[Column]:
    """Two hashes, 128 bits together, of the id, the text and the host. The verdict depends on text and host alone, so rows of equal keys share it."""
    told = [F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.col(host_col).cast("string")]
    marked = [x for c in told for x in (c.isNull(), c)]
    return [F.xxhash64(*marked).alias(KEY[0]), F.xxhash64(F.lit(1), *marked).alias(KEY[1])]


def boilerplate(base: DataFrame) -> DataFrame:
    """(host, h): lines that are in more of a host's documents than the limits allow, of base's rows with host, text and lines."""
    hosts = base.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    held = base.select("host", "text", F.explode(F.array_distinct("lines.h")).alias("h")).distinct()
    often = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs_with")).filter(F.col("docs_with") > LINE_DOCS)
    return often.join(hosts, "host").filter(F.col("docs_with") > F.col("docs") * LINE_SHARE).select("host", "h")


def judge(df: DataFrame, id_col: str, text_col: str, host_col: str, lines: bool = False) -> DataFrame:
    """quality() with the id as ``id``, the keys that name the row, and with lines=True its boilerplate lines' hashes."""
    text = F.col(text_col).cast("string")
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit(""))
    f = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), *_keys(id_col, text_col, host_col), F.xxhash64(text).alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("digest"), host.alias("host"), features(text).alias("f"))
    base = f.select("row", "id", *KEY, "text", "digest", "host", "f.w.*", "f.n_symbols", "f.l.*")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    base = materialize(base, "quality", narrow=True)
    lost = base.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.n").join(boilerplate(base), ["host", "h"])
    lost = materialize(lost, "lines", narrow=True)
    told = [F.sum("n").alias("removed_words")] + [F.collect_set("h").alias("removed_lines")] * lines
    out = base.drop("lines", "text").join(lost.groupBy("row").agg(*told), "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long"))
    depleted = ~F.col("base_failed") & (LEFT_PART * (F.col("n_words") - F.col("removed_words")) < F.col("n_words"))
    out = materialize(out.withColumn("depleted", depleted), "judged", narrow=True)
    safe = lost.join(out.filter("not base_failed and not depleted and removed_words > 0"), "row", "left_semi").select("host", "h").distinct()
    order = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("id"), F.col("digest").alias("digest"))
    risk = lost.join(out.filter("depleted").select("row", order.alias("order")), "row").join(safe, ["host", "h"], "left_anti").groupBy("row", "host", "order").agg(F.min("h").alias("least"))
    first = risk.groupBy("host", "least").agg(F.min("order").alias("order"))
    stays = risk.join(first, ["host", "least", "order"], "left_semi").select("row", F.lit(True).alias("stays"))
    out = out.join(stays, "row", "left")
    kept = ~F.col("base_failed") & (~F.col("depleted") | F.col("stays").isNotNull())
    return out.select("id", *KEY, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", *["removed_lines"] * lines, kept.alias("kept"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Base features, base_failed and the verdict kept for each row.

    Returns the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_words (in boilerplate lines, repeats
    counted) and kept. A null or empty text has no words and fails. Rows of
    equal texts count as one document of their host for line frequencies and
    have verdicts of their own; a null host is a host of its own. A depleted
    document's lines are at risk if no kept document of the host has them; of
    those with the same least line (by hash) at risk the one of least id stays,
    null ids last; equal rows stay or go together. An
    empty table gives no rows. Other columns of df are not read.
    """
    j = judge(df, id_col, text_col, host_col)
    return j.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


def _keyed(df: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return df.select("*", *_keys(id_col, text_col, host_col))


def keep(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of df, with all their columns, that quality() keeps.

    Each row goes by its own verdict: one id may stand with several texts or
    at several hosts. Repeated rows stay or go together; null and empty texts
    go; an empty table stays empty. Columns of any names pass through.
    """
    gone = judge(df, id_col, text_col, host_col).filter("not kept").select(*KEY)
    return _keyed(df, id_col, text_col, host_col).join(gone, list(KEY), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of keep(), their texts without the lines that quality() takes for boilerplate at their host.

    Depleted documents that stay keep their lines. Repeated rows are cleaned alike; null and
    empty texts go with the rows that keep() rejects; an empty table stays
    empty. Columns of any names pass through.
    """
    told = judge(df, id_col, text_col, host_col, lines=True).filter("kept").withColumn("removed_lines", F.when(LEFT_PART * (F.col("n_words") - F.col("removed_words")) >= F.col("n_words"), F.col("removed_lines")))
    told = told.groupBy(*KEY).agg(F.first("removed_lines", ignorenulls=True).alias("__lines"))
    rows = _keyed(df, id_col, text_col, host_col).join(told, list(KEY))
    left = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains("__lines", line_hash(normalised(x))))
    return rows.withColumn(text_col, F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(left, "\n"))).select(*[F.col(f"`{c}`") for c in df.columns])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT r, unnest(list_transform(range(1, len(w) - {WINDOW} + 2), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS g, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM w WHERE len(w) > {WINDOW}),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::BIGINT AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
ln AS (SELECT r, host, unnest(string_split(t, chr(10))) AS x FROM d),
lw AS (SELECT r, host, x, trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, (count(*) - count(DISTINCT x))::BIGINT AS n FROM lw GROUP BY r),
line AS (SELECT r, host, norm, sum(len(string_split(norm, ' '))) AS n FROM lw GROUP BY ALL),
often AS (SELECT l.host, norm FROM line l JOIN d USING (r) GROUP BY l.host, norm HAVING count(DISTINCT md5(t)) > {LINE_DOCS} AND count(DISTINCT md5(t)) > {LINE_SHARE} * (SELECT count(*) FROM d WHERE d.host = l.host)),
lost AS (SELECT r, host, norm, n FROM line JOIN often USING (host, norm)),
rem AS (SELECT r, sum(n)::BIGINT AS n FROM lost GROUP BY r),
f AS (SELECT r, doc_id, host, md5(t) AS m, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
      coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(rem.n, 0) AS removed_words FROM w LEFT JOIN dup USING (r) LEFT JOIN cov USING (r) LEFT JOIN rem USING (r)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f),
c AS (SELECT *, NOT base_failed AND {LEFT_PART} * (n_words - removed_words) < n_words AS depleted FROM b),
safe AS (SELECT DISTINCT l.host, norm FROM lost l JOIN c USING (r) WHERE NOT base_failed AND NOT depleted),
risk AS (SELECT r, l.host, doc_id, m, min(left(md5(norm), 16)) AS least FROM lost l JOIN c USING (r) ANTI JOIN safe s ON s.host = l.host AND s.norm = l.norm WHERE depleted GROUP BY ALL),
stays AS (SELECT r FROM risk QUALIFY rank() OVER (PARTITION BY host, least ORDER BY doc_id NULLS LAST, m) = 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, removed_words, base_failed, NOT base_failed AND (NOT depleted OR r IN (FROM stays)) AS kept FROM c
"""
