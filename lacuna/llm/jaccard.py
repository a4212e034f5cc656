"""Near-duplicate documents: n-gram Jaccard join with Bayesian pruning of MinHash comparisons."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.llm.common import components, cut, free_name

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: MinHash values compared before the next look at the posterior.
STEP = 16
#: A tile compares two blocks of about this many classes.
BLOCK = 256
#: Broadcast keys only up to this many (8 to 24 bytes each); beyond it, the join shuffles.
SMALL = 1_000_000
WORD_CACHE = 200_000


class WordHash(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@functools.cache
def constants() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    draw = lambda n: rng.integers(1, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return draw(HASHES), draw(BANDS * ROWS).reshape(BANDS, ROWS)


WORDS = WordHash()


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (multiply and shift, twice)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word runs of the lower-cased text; a text of fewer words is one
    run; one without words has none."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.array([WORDS[w] for w in words], dtype=np.uint64)
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        s = mixed(s * np.uint64(31) + h[k : len(h) - n + 1 + k])
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    a, _ = constants()
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for lo in range(0, len(s), 1024):
        np.minimum(out, np.multiply.outer(a, s[lo : lo + 1024]).min(1), out=out)
    return out >> np.uint64(16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    _, b = constants()
    rows = sig.reshape(BANDS, ROWS)
    return mixed((rows * b).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@functools.cache
def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After STEP, 2 STEP, ... values, the fewest matches with which P(J >= threshold) stays at tolerance or
    above. With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t equals the
    chance of at most m successes in n + 1 trials of chance t."""
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i of a, j of b) that no look at the posterior drops; with `same`, i < j only."""
    need = least_matches(threshold, tolerance)
    match = np.zeros((len(a), len(b)), dtype=np.int16)
    for k in range(STEP):
        match += a[:, k][:, None] == b[:, k][None, :]
    ok = match >= need[0]
    if same:
        ok = np.triu(ok, 1)
    i, j = np.nonzero(ok)
    m = match[i, j].astype(np.int32)
    for step in range(1, len(need)):
        if not len(i):
            break
        part = slice(step * STEP, (step + 1) * STEP)
        for lo in range(0, len(i), 1 << 17):
            own = slice(lo, lo + (1 << 17))
            m[own] += (a[i[own], part] == b[j[own], part]).sum(1)
        keep = m >= need[step]
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def verified(i: np.ndarray, j: np.ndarray, left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have an exact Jaccard similarity of at least the threshold. Many pairs of one tile: one
    product of 0/1 matrices over the tile's shingles; few: sorted intersections."""
    sizes_l, sizes_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    both = np.zeros(len(i), dtype=np.int64)
    rows, cols = np.unique(i), np.unique(j)
    if len(i) > 64 and len(i) > len(rows):
        every, place = np.unique(np.concatenate([*[left[r] for r in rows], *[right[c] for c in cols]]), return_inverse=True)
        n_left = sizes_l[rows].sum()
        rid, cid = np.repeat(np.arange(len(rows)), sizes_l[rows]), np.repeat(np.arange(len(cols)), sizes_r[cols])
        total = np.zeros((len(rows), len(cols)), dtype=np.float32)
        for lo in range(0, len(every), 4096):
            x = np.zeros((len(rows), 4096), dtype=np.float32)
            y = np.zeros((len(cols), 4096), dtype=np.float32)
            pl, pr = place[:n_left], place[n_left:]
            il, ir = (pl >= lo) & (pl < lo + 4096), (pr >= lo) & (pr < lo + 4096)
            x[rid[il], pl[il] - lo] = 1
            y[cid[ir], pr[ir] - lo] = 1
            total += x @ y.T
        both = total[np.searchsorted(rows, i), np.searchsorted(cols, j)].astype(np.int64)
    else:
        for k, (p, q) in enumerate(zip(i, j, strict=True)):
            both[k] = len(np.intersect1d(left[p], right[q], assume_unique=True))
    union = sizes_l[i] + sizes_r[j] - both
    return both >= threshold * union - 1e-9


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable place of each of n places, over links (i, j)."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    return np.array([find(x) for x in range(n)])


def tiles(members: DataFrame, group: str, size: DataFrame) -> DataFrame:
    """(group, fp) -> (group, fp, blk, lo, hi): each group's members dealt into blocks of about BLOCK, each
    member once for every pair of blocks that its own is in."""
    m = members.join(size, group).withColumn("_b", F.ceil(F.col("n") / BLOCK).cast("int"))
    m = m.withColumn("blk", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("_b")).cast("int"))
    m = m.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_b") - 1)))
    return m.select(group, "fp", "blk", F.least("blk", "_o").alias("lo"), F.greatest("blk", "_o").alias("hi"))


def per_tile(rows: DataFrame, keys: list[str], f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """f over each tile's rows, tiles dealt by their keys; a task holds one tile and one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if not len(b):
                continue
            new = (b[keys] != b[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
            for lo, hi in zip(new[:-1], new[1:], strict=True):
                yield f(b.iloc[lo:hi])
            rest = b.iloc[new[-1] :]
        if rest is not None and len(rest):
            yield f(rest)

    return rows.repartition(*keys).sortWithinPartitions(*keys, "fp").mapInPandas(run, schema)


def near_documents(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of near_rows."""
    return near_rows(docs, **settings).select("doc_id", "class_id", "n_links", "kept")


def near_rows(docs: DataFrame, threshold: float = 0.8, n: int = 5, tolerance: float = 1e-6, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, class_id, n_links, kept) of every row: n_links other rows have a Jaccard similarity of at
    least `threshold` on n-word shingles (lower case, split at white space; a shorter text is one shingle);
    class_id is the smallest doc_id reachable by links; kept if it is the row's own.

    1. Rows with equal shingle sets are one class with a count; later steps see classes only.
    2. LSH bands of MinHash values give candidate buckets (a pair at the threshold is missed with chance
       3e-6). Buckets with the same members are one. Within a bucket, tiles of two blocks compare MinHash
       values STEP at a time and drop pairs whose posterior chance of reaching the threshold is below
       `tolerance`; what remains is kept as forests, so families of near copies cost rows in proportion to
       their size.
    3. Families (components of these forests) are tiled again, with the shingles: Bayesian pruning, then
       exact verification of all pairs that remain. Tasks return counts and labels, never pairs.

    Any bucket or family is any number of tiles, so none is collected, and none is capped. Texts without
    words (null, empty, blank) link with nothing. Null ids get a null class_id unless linked, and are never
    kept as such. Repeated rows are copies of each other. An empty table gives no rows.
    Two more columns tell rows and classes apart whatever their ids: `at`, the text's MD5 (null without `digest`),
    and `grp`, the fingerprint that stands for the class (null without words).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), (F.md5(text_col) if digest else F.lit(None).cast("string")).alias("at"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp, bands = [], []
            for t in b["text"]:
                s = shingles(t, n)
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(signature(s)) if len(s) else None)
            yield pd.DataFrame({"doc_id": b["doc_id"], "at": b["at"], "fp": fp, "bands": bands})

    sketched = cut(rows.mapInPandas(sketch, f"doc_id {kind}, at string, fp binary, bands array<long>"))
    classes = sketched.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    classes = cut(classes)

    keyed = classes.select("fp", F.explode("bands").alias("key"))
    sets = keyed.groupBy("key").agg(F.count("*").cast("int").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y")).where("n > 1")
    sets = cut(sets.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"))
    count = sets.count()
    small = F.broadcast if count <= SMALL else (lambda x: x)
    members = cut(keyed.join(small(sets.select("key")), "key"))
    active = cut(members.select("fp").distinct())
    heads = classes.join(active, "fp", "left_semi").select("fp", "first", "copies")

    def full(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets_ = [shingles(t, n) for t in b["text"]]
            yield pd.DataFrame({
                "fp": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets_],
                "shingles": [s.tobytes() for s in sets_],
                "sig": [signature(s).astype(np.uint16).tobytes() for s in sets_],
            })

    ids = cut(heads.select(F.col("first").alias("_id")).distinct())
    small = F.broadcast if ids.count() <= SMALL else (lambda x: x)
    texts = rows.join(small(ids), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").where("text is not null").select("text")
    load = texts.mapInPandas(full, "fp binary, shingles binary, sig binary").dropDuplicates(["fp"])
    load = cut(load.join(heads.select("fp", "copies"), "fp"))

    def sigs(b: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(b["sig"]), dtype=np.uint16).reshape(len(b), HASHES)

    def forest(b: pd.DataFrame) -> pd.DataFrame:
        same = b["lo"].iloc[0] == b["hi"].iloc[0]
        at = np.arange(len(b)) if same else np.flatnonzero(b["blk"] == b["lo"])
        to = at if same else np.flatnonzero(b["blk"] == b["hi"])
        s = sigs(b)
        i, j = survivors(s[at], s[to], threshold, tolerance, same)
        top = roots(len(b), at[i], to[j])
        hit = top != np.arange(len(b))
        fp = b["fp"].to_numpy()
        return pd.DataFrame({"u": fp[hit], "v": fp[top[hit]]})

    work = tiles(members, "key", sets).join(load.select("fp", "sig"), "fp")
    family = components(per_tile(work, ["key", "lo", "hi"], forest, "u binary, v binary"))
    family = cut(family.withColumnRenamed("node", "fp").unionByName(family.select("root").distinct().withColumn("fp", F.col("root"))).distinct())

    def exact(b: pd.DataFrame) -> pd.DataFrame:
        same = b["lo"].iloc[0] == b["hi"].iloc[0]
        at = np.arange(len(b)) if same else np.flatnonzero(b["blk"] == b["lo"])
        to = at if same else np.flatnonzero(b["blk"] == b["hi"])
        s, sets_ = sigs(b), [np.frombuffer(x, dtype=np.uint64) for x in b["shingles"]]
        i, j = survivors(s[at], s[to], threshold, tolerance, same)
        ok = verified(i, j, [sets_[k] for k in at], [sets_[k] for k in to], threshold)
        i, j = at[i[ok]], to[j[ok]]
        copies, links = b["copies"].to_numpy(), np.zeros(len(b), dtype=np.int64)
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        top, fp = roots(len(b), i, j), b["fp"].to_numpy()
        hit = links > 0
        return pd.DataFrame({"fp": fp[hit], "n": links[hit], "root": fp[top[hit]]})

    per_root = family.groupBy("root").agg(F.count("*").cast("int").alias("n"))
    work = tiles(family, "root", per_root).join(load, "fp")
    linked = cut(per_tile(work, ["root", "lo", "hi"], exact, "fp binary, n long, root binary"))
    group = components(linked.select(F.col("fp").alias("u"), F.col("root").alias("v")))
    group = cut(group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).distinct().withColumnRenamed("node", "fp"))
    counts = linked.groupBy("fp").agg(F.sum("n").alias("n"))
    lowest = group.join(classes.select("fp", "first"), "fp").groupBy("root").agg(F.min("first").alias("lowest"))
    info = classes.select("fp", "first", "copies").join(counts, "fp", "left").join(group.join(lowest, "root").select("fp", "root", "lowest"), "fp", "left")
    info = info.select("fp", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("lowest", "first").alias("low"), F.coalesce("root", "fp").alias("grp"))
    out = sketched.select("doc_id", "at", "fp").join(info, "fp", "left")
    class_id = F.coalesce("low", "doc_id")
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(class_id == F.col("doc_id"), F.lit(False)).alias("kept"), "at", "grp")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest id, or if all ids of the
    group are null, the one with the smallest digest of the text. Rows without words stay, those with an id once
    for each id and text. Columns may have any names and come back as they are; an empty table gives no rows."""
    by, at, every, md5 = (free_name(n, docs.columns) for n in ("by", "at", "every", "md5"))
    found = near_rows(docs, id_col=id_col, text_col=text_col, digest=True, **settings)
    first = found.where("grp is not null").groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")).alias("k"))
    stay = first.select(F.col("k.doc_id").alias(by), F.col("k.at").alias(at), F.lit(False).alias(every))
    bare = found.where("grp is null").select(F.col("doc_id").alias(by), F.col("at").alias(at), F.col("doc_id").isNull().alias(every)).distinct()
    stay = cut(stay.unionByName(bare))
    keyed = docs.withColumn(md5, F.md5(text_col))
    out = keyed.join(stay, F.col(id_col).eqNullSafe(F.col(by)) & F.col(md5).eqNullSafe(F.col(at)))
    return out.where(~F.col(every)).dropDuplicates([id_col, md5]).unionByName(out.where(every)).select(*docs.columns)
