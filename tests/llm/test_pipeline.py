"""The pipeline against a brute-force version of its decisions."""

import hashlib
import shutil

from pyspark.sql import functions as F

import corpus_pipeline
from glyphspark.llm import bpe, pii
from glyphspark.llm import queries as llm_queries
from test_operators import slow_components, slow_fingerprint, slow_quality


def test_stages(spark, tmp_path):
    prose = lambda k, n=60: " ".join(f"w{k}x{j * (k + 3) % 97}y" for j in range(n))
    rows = [(k, prose(k) + f" mail u{k}@x.org", "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(100 + k, rows[k][1], "en", "s0", 1) for k in range(5)] + [(200, "too short", "en", "s1", 1), (201, None, None, None, None), (202, "a b c d " * 30, "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    (tmp_path / "sf").mkdir()
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "sf/documents.parquet"))
    kept = [r for r in rows if not slow_quality(r[1])[5]]
    assert len(kept) == 35
    fp = {r[0]: slow_fingerprint(r[1]) for r in kept}
    roots = slow_components(fp, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    docs, stages = spark.read.parquet(str(tmp_path / "sf/documents.parquet")), []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path / "sf"))
        docs.write.parquet(str(tmp_path / f"stage{len(stages)}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{len(stages)}"))
        stages.append(docs.collect())
        if len(stages) < 5:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in stages[0]} == set(fp)
    assert sorted(r.doc_id for r in stages[1]) == sorted(i for i in fp if roots[i] == i)
    assert all("<email>" in r.text and "@" not in r.text and r.n_chars == len(r.text) for r in stages[2])
    assert {r.doc_id for r in stages[3]} <= {r.doc_id for r in stages[2]}
    enc = bpe.encoding(bpe.tokenizer_path(bpe.RANKS))
    text = {r.doc_id: r.text for r in stages[2]}
    for r in stages[4]:
        assert r.tokens == enc.encode_ordinary(text[r.doc_id])
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    run = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in run) == sorted((r.doc_id, r.ids_sha256) for r in stages[4])
    shutil.rmtree(tmp_path)


def test_one_row_of_each_text_stays(spark):
    """Copies of texts of short lines, of long lines and of one line, and near copies: rules and near-dedup leave one row of each."""
    lines = lambda k, words, of: [" ".join(f"t{k}l{j}w{i}" for i in range(words)) for j in range(of)]
    rows = [(k, "\n".join(lines(k, 8, 20)), "en", "h", 1) for k in range(100)]
    texts = [lines("s", 8, 20), lines("g", 30, 6), lines("o", 200, 1), lines("n", 8, 60)]
    rows += [(1000 * (j + 1) + k, "\n".join(x), "en", "h", 1) for j, x in enumerate(texts[:3]) for k in range(12)]
    rows += [(4000 + k, "\n".join([*texts[3][: k % 60], f"{texts[3][k % 60]}x", *texts[3][k % 60 + 1 :]]), "en", "h", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.quality_rules(spark, docs, "")
    left = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, kept, "").collect()]
    assert set(left) >= set(range(100)) and [sum(i // 1000 == k for i in left) for k in (1, 2, 3)] == [1, 1, 1]
    roots = slow_components(fp := {r[0]: slow_fingerprint(r[1]) for r in kept.select("doc_id", "text").collect() if r[0] >= 4000}, [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2])
    assert fp and sorted(i for i in left if i >= 4000) == sorted(set(roots.values()))


def test_every_stage_takes_odd_rows(spark):
    """Null, repeated, very long and clashing rows and an empty table, stage by stage."""
    prose = lambda k, n=60: " ".join(f"w{k}x{j * (k + 3) % 97}y" for j in range(n))
    rows = [(k, prose(k), "en", f"s{k % 3}", 1) for k in range(12)] * 2 + [(None, prose(50), None, None, None), (None, None, None, None, None), (60, "", "en", "s1", 0), (61, None, "en", "s1", None)]
    rows += [(5, prose(70), "en", "s1", 1), (5, prose(5), "en", "other", 1), (80, " ".join(f"v{j}" for j in range(60_000)) + " mail a@b.cd", "en", None, 1)]
    names = ["row", "key", "node", "fp", "base", "copies", "size", "target", "id", "host"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    expected = sorted({r[0] for r in rows if r[0] is not None} - {60, 61})
    full, none = docs, docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        full, none = stage(spark, full, ""), stage(spark, none, "")
        assert none.count() == 0
        if k < 4:
            assert full.columns == docs.columns
            got = full.select("doc_id", "text", *names).collect()
            assert all([r[c] for c in names] == list(range(len(names))) for r in got)
        if k == 0:
            assert len(got) == len(rows) - 3
        if k == 1:
            assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted([*expected, 5]) and sum(r.doc_id is None for r in got) == 1
        if k == 2:
            assert [r.text[-7:] for r in got if r.doc_id == 80] == ["<email>"]
    assert set(full.columns) >= {"doc_id", "n_tokens", "tokens", "ids_sha256", "decoded_sha256"} and full.count() > 0


def test_queries_are_registered():
    assert sorted(llm_queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(llm_queries.QUERIES)
    assert [int(n[2:].split("_")[0]) for n in llm_queries.QUERIES] == list(range(1, 14))
    assert set(llm_queries.ORACLE_SQL) <= set(llm_queries.QUERIES)
    assert pii.KINDS[:4] == pii.BASE
