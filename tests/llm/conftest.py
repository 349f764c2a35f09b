import random

import pytest

#: Columns that clash with names that operators use inside.
CLASHING = ["id", "row", "size", "fp", "node", "key", "n", "found", "base", "tokens", "chunk", "shard", "kept", "class"]


def texts(seed=3, n=120):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(60)]
    out = [None, "", " ", "\n\n", "word", "a" * 5000, "x y " * 3000, "é😀 " * 300, "1" * 3000]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    for k in range(n):
        t = " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 150)))
        if k % 6 == 0:
            t = t + " " + passage + " " + " ".join(r.choice(vocabulary) for _ in range(5))
        if k % 5 == 0:
            t = t.replace(" a", "\n")
        out.append(t)
    return out + out[20:30]


@pytest.fixture(scope="session")
def rows():
    r = random.Random(4)
    out = [(i, t, r.choice(["en", None]), r.choice(["s1", "s1", "s1", "s2", "s3", None])) for i, t in enumerate(texts())]
    out += [out[15], out[15], (None, "null id text of a few words", "en", "s1"), (None, None, None, None)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *[F.lit(None).cast("int").alias(c) for c in CLASHING]).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
