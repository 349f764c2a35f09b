"""SimHash near-duplicates with a bit-sliced comparison of fingerprints.

Fingerprints are made in Arrow batches. Equal ones become one class, by a
grouped minimum of ids, so copies cost nothing later. Two fingerprints that
differ in at most r bits agree in all but r of any bands, so r + 2 bands give
keys of two bands of which at least one is shared: classes meet under equal
keys. The classes of a key with many are told apart by what is left of their
fingerprints, which is cut into bands again, and so on: no key stays large.

Where classes meet, fingerprints are compared bit-sliced: 64 of them stand
vertically as 64 words, one for each bit. A query's bits are XORed into them
plane by plane, two words count the differences of all 64 at once by
carry-save addition, and a block is dropped once all its lanes exceed the
radius. Links of a key are reduced to a forest before they leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import components, local_forest

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Classes under one key that are compared with each other; a key with more is refined.
BLOCK = 4096
#: Pairs of a query and a block of 64 that are compared at once.
JOBS = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's bytes: A-Z lower-cased, words by ASCII white space, XXH64 of each run of words, repeats included."""
    import xxhash

    w = text.lower().split()
    if not w:
        return 0
    h64 = xxhash.xxh64_intdigest
    n = max(1, len(w) - shingle + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        h = np.array([h64(b" ".join(w[i : i + shingle]), seed) for i in range(at, min(n, at + (1 << 16)))], ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: list[Column] = ()) -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a signed long; 0 for a null, empty or blank text. Further columns of longs are passed on."""
    names = df.select(*also).columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t or b"") for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64)), *b.columns[2:]], names=["id", "fp", *names])

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary"), *also).mapInArrow(run, ", ".join(f"{c} long" for c in ["id", "fp", *names]))


def near_lanes(planes: np.ndarray, block: np.ndarray, query: np.ndarray, radius: int) -> np.ndarray:
    """For each job, block and query: a word with a bit for each lane within the radius.

    planes[i, b] has bit i of the 64 fingerprints of block b, one in each lane.
    """
    found = np.zeros(len(block), np.uint64)
    live = np.arange(len(block))
    counts = [np.zeros(len(block), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(block), np.uint64)
    limit = radius + 1
    for i in range(BITS):
        bit = (query >> np.uint64(BITS - 1 - i)) & np.uint64(1)
        carry = planes[i, block] ^ (np.uint64(0) - bit)
        for k, c in enumerate(counts):
            counts[k], carry = c ^ carry, c & carry
        over |= carry
        full = ~np.uint64(0)
        for k, c in enumerate(counts):  # lanes at radius + 1, which stay over
            full = full & (c if limit >> k & 1 else ~c)
        over |= full
        if i % 8 == 7:
            on = over != ~np.uint64(0)
            if not on.all():
                live, block, query, over = live[on], block[on], query[on], over[on]
                counts = [c[on] for c in counts]
                if not len(live):
                    return found
    found[live] = ~over
    return found


def links_of_keys(key: np.ndarray, node: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between nodes of equal key."""
    order = np.lexsort((node, key))
    key, node, fp = key[order], node[order], fp[order].view(np.uint64)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    keep = size > 1
    begin, size = begin[keep], size[keep]
    blocks_of = -(-size // 64)
    first_block = np.concatenate([[0], np.cumsum(blocks_of)])
    planes = np.zeros((BITS, first_block[-1]), np.uint64)
    row_of = np.repeat(np.arange(len(begin)), blocks_of)
    lane0 = begin[row_of] + 64 * (np.arange(first_block[-1]) - first_block[:-1][row_of])
    lanes = np.minimum(size[row_of] - (lane0 - begin[row_of]), 64)
    for j in range(64):
        has = lanes > j
        f = fp[lane0[has] + j]
        for i in range(BITS):
            planes[i, has] |= ((f >> np.uint64(BITS - 1 - i)) & np.uint64(1)) << np.uint64(j)
    valid = np.where(lanes == 64, ~np.uint64(0), (np.uint64(1) << (lanes & 63).astype(np.uint64)) - np.uint64(1))
    out_a, out_b = [], []
    per_block = size[row_of]
    ends = np.concatenate([[0], np.cumsum(per_block)])
    for at in range(0, int(ends[-1]), JOBS):
        job = np.arange(at, min(at + JOBS, int(ends[-1])))
        block = np.searchsorted(ends, job, side="right") - 1
        q = begin[row_of[block]] + job - ends[block]
        use = q < lane0[block] + 63  # each pair once: lanes after the query
        block, q = block[use], q[use]
        hit = near_lanes(planes, block, fp[q], radius) & valid[block]
        some = np.flatnonzero(hit)
        if len(some):
            bits = np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(bits)
            a, b = q[some[r]], lane0[block[some[r]]] + lane
            ok = b > a
            a, b = local_forest(node[a[ok]], node[b[ok]]) if ok.any() else (node[:0], node[:0])
            out_a.append(a)
            out_b.append(b)
    if not out_a:
        return node[:0], node[:0]
    return local_forest(np.concatenate(out_a), np.concatenate(out_b))


def band_keys(rows: DataFrame, width: int, radius: int) -> tuple[DataFrame, int]:
    """Rows (node, fp, key, rest) under each pair of bands of ``rest``, of ``width`` bits: the new key, and the other bands as what is left, with its width."""
    n = radius + 2
    w = -(-width // n)
    shifts = [i * w for i in range(n)]
    bands = [F.shiftrightunsigned("rest", s).bitwiseAND(F.lit((1 << w) - 1)) if s < BITS else F.lit(0).cast("long") for s in shifts]
    parts = []
    for number, (i, j) in enumerate(combinations(range(n), 2)):
        others = [F.shiftleft(band, s) for band, s in zip((b for k, b in enumerate(bands) if k not in (i, j)), shifts) if s < BITS]
        rest = reduce(lambda a, b: a.bitwiseOR(b), others, F.lit(0).cast("long"))
        parts.append(F.struct(F.xxhash64("key", F.lit(number), bands[i], bands[j]).alias("key"), rest.alias("rest")))
    out = rows.select("node", "fp", F.explode(F.array(*parts)).alias("part")).select("node", "fp", "part.key", "part.rest")
    return out, min(width, (n - 2) * w)


def near_links(classes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join all classes (node, fp), of different fingerprints, within the radius into their components.

    A key with more than ``block`` classes is refined by the bits that its two
    bands leave (64, 32, 16, 8 for a radius of 2): near ones among them still
    share a pair of the next bands. It ends where the bits left have no more
    values than a block, so a key's comparisons are bounded however many
    classes are alike, and no link is lost.
    """
    rows, width = classes.select("node", "fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest")), BITS
    jobs = None
    while True:
        before = width
        rows, width = band_keys(rows, width, radius)
        rows = materialize(rows, "keys", narrow=True)
        sizes = materialize(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "keysizes", narrow=True)
        last = 1 << width <= block or width == before or sizes.filter(F.col("n") > block).isEmpty()
        part = rows.join(sizes if last else sizes.filter(F.col("n") <= block), "key").select("key", "node", "fp")
        jobs = part if jobs is None else jobs.unionByName(part)
        if last:
            break
        rows = rows.join(sizes.filter(F.col("n") > block), "key").select("node", "fp", "key", "rest")
    jobs = jobs.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows_held = 0

        def flush(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = links_of_keys(*cols, radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for rb in batches:
            cols = np.stack([rb.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            held.append(cols)
            rows_held += cols.shape[1]
            if rows_held >= 1 << 16:  # a key has all its rows before the next begins
                every = np.concatenate(held, axis=1)
                last = np.searchsorted(every[0], every[0, -1])
                if last:
                    yield flush(list(every[:, :last]))
                held = [every[:, last:]]
                rows_held = every.shape[1] - last
        if held:
            yield flush(list(np.concatenate(held, axis=1)))

    return jobs.mapInArrow(run, "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """fingerprint and component_id of each row.

    component_id is the least id among the rows that fingerprints within the
    radius join, directly or through others. Null, empty and blank texts have
    fingerprint zero and are linked like any other. Rows with a null id take
    part with the others of their fingerprint but are no component's least id;
    a fingerprint that only such rows have gives null. Repeated rows each give
    a row; other columns of df are not read.
    """
    fps = materialize(fingerprints(df, id_col, text_col), "fingerprints", narrow=True)
    classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("node")).filter("node is not null"), "classes", narrow=True)
    roots = components(near_links(classes, radius))
    classes = classes.join(roots, F.col("node") == F.col("id"), "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(classes, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each component of rows that fingerprints within the radius join, with all columns of df.

    It is the row of least id, null ids last. Rows of equal id and text are
    told apart by their other columns, and equal rows are reduced to one; so
    are texts that share an id. Fingerprints are the nodes here, not ids: an
    id that two texts share joins nothing.
    """
    text = F.col(text_col).cast("string")

    def named(i: Column) -> list[Column]:
        return [i.isNull().alias("__null"), F.coalesce(i, F.lit(0)).alias("__id")]

    marks = [F.xxhash64(text).alias("__h1"), F.xxhash64(F.lit(1), text).alias("__h2")]
    names = ["__null", "__id", "__h1", "__h2"]
    fps = fingerprints(df, id_col, text_col, marks).select("fp", F.struct(*named(F.col("id")), "__h1", "__h2").alias("row"))
    classes = materialize(fps.groupBy("fp").agg(F.min("row").alias("row")), "classes", narrow=True)
    roots = components(near_links(classes.select(F.col("fp").alias("node"), "fp"), radius))
    stay = classes.join(roots, F.col("fp") == F.col("id"), "left").groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row")).select("row.*")
    # Each task first reduces its own rows of equal id and text to one, so many of them are no hot group.
    rest = [F.col(f"`{c}`") for c, kind in df.dtypes if c != text_col and "map<" not in kind and kind != "variant"]
    rows = df.select("*", *named(F.col(id_col).cast("long")), *marks)
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*names).orderBy(F.xxhash64(*rest)))).filter("__n = 1")
    return rows.join(stay, names, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
