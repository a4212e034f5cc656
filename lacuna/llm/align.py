"""Alignment of two tokenizers over the same bytes: groups between common ends, links, and how common each link is."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.bpe import char_bytes
from lacuna.llm.common import cut

#: A text falls into units before each run of spaces between other characters: no token of either kind crosses there.
UNIT = re.compile(r"(?<=\S)(?= +\S)")
#: White space besides the space.
OTHER = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
#: A worker remembers units in two generations of at most so many units and characters; what is met again stays.
UNITS_KEPT, CHARS_KEPT = 200_000, 4_000_000
#: Different links of documents that are numbered together; a chunk's numbers and counts are held in memory.
CHUNK_LINKS = 3_000_000
#: Link numbers in one row.
SLICE = 1 << 15


def units_of(text: str) -> list[str]:
    """The units of space+text, each without the space with which it begins."""
    if text[0] == " " or text[-1] == " " or "  " in text or any(c in text and (" " + c in text or c + " " in text or text[0] == c) for c in OTHER):
        return [u[1:] for u in UNIT.split(" " + text)]
    return text.split(" ")


def expand(ids_a: list[int], ids_b: list[int], ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Links of one group's slices, as numbers: all pairs of occurrences whose byte ranges overlap, in order of place."""
    if len(ids_a) == 1:
        return [ids_a[0] << 32 | b for b in ids_b]
    if len(ids_b) == 1:
        return [a << 32 | ids_b[0] for a in ids_a]
    out, i, j = [], 0, 0
    while True:
        out.append(ids_a[i] << 32 | ids_b[j])
        x, y = ends_a[i], ends_b[j]
        if x == y:
            return out
        i, j = i + (x < y), j + (y < x)


def cuts(ends_a: list[int], ends_b: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The common ends in order, and how many of A's and B's ids end there or before: dictionaries from cumulative ends to places."""
    at_a, at_b = dict(zip(ends_a, count(1))), dict(zip(ends_b, count(1)))  # noqa: B905
    ends = list(filter(at_b.__contains__, at_a))
    return ends, list(map(at_a.__getitem__, ends)), list(map(at_b.__getitem__, ends))


def align(ids_a: list[int], ids_b: list[int], sizes_a: list[int], sizes_b: list[int]) -> Iterator[tuple[int, int, int, list[int]]]:
    """(end in bytes, end in A's ids, end in B's ids, links) of each group of two id lists over the same bytes:
    their common ends cut both lists, and each slice is expanded by itself. Pair.learn does the same for many units at once."""
    ends_a = list(accumulate(map(sizes_a.__getitem__, ids_a)))
    ends_b = list(accumulate(map(sizes_b.__getitem__, ids_b)))
    i = j = 0
    for e, p, q in zip(*cuts(ends_a, ends_b), strict=True):
        if p - i == 1 == q - j:
            yield e, p, q, [ids_a[i] << 32 | ids_b[j]]
        else:
            yield e, p, q, expand(ids_a[i:p], ids_b[j:q], ends_a[i:p], ends_b[j:q])
        i, j = p, q


class Pair:
    """The two tokenizers of a worker, and what is known of units."""

    def __init__(self, path_a: str, path_b: str, kept: int = UNITS_KEPT):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        # strings of special tokens are plain text
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = char_bytes()
        size = max(self.a.get_vocab(True).values()) + 1
        self.bytes_a = [bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in map(self.a.id_to_token, range(size))]
        pieces = list(map(self.b.id_to_piece, range(self.b.get_piece_size())))
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        # units are safe only if no piece joins a space to what stands before it
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)
        self.name = list(map(str, range(max(size, len(pieces)))))
        self.known: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.chars, self.kept = 0, kept

    def learn(self, units: list[str]) -> bool:
        """Remember units that stand one behind the other in a text, as (n_a, n_b, n_groups, groups, links), links
        as the bytes of 64-bit numbers; False if its tokens' bytes aren't the text's."""
        text = " ".join(units)
        a, b = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, self.b.encode(text, num_threads=1)
        raw = (" " + text).encode()
        if b"".join(map(self.bytes_a.__getitem__, a)) != raw or b"".join(map(self.bytes_b.__getitem__, b)) != raw:
            return False
        name, sizes_a, sizes_b = self.name, self.sizes_a, self.sizes_b
        ends_a, ends_b = list(accumulate(map(sizes_a.__getitem__, a))), list(accumulate(map(sizes_b.__getitem__, b)))
        ends, *upto = cuts(ends_a, ends_b)
        p, q = (np.array([0, *x]) for x in upto)
        n_a, n_b = np.diff(p), np.diff(q)
        # groups of one id each, as most are, at once; the others' slices are expanded
        first_a, first_b = np.array(a, np.int64)[p[:-1]], np.array(b, np.int64)[q[:-1]]
        said = [f"{name[x]}|{name[y]}" for x, y in zip(first_a.tolist(), first_b.tolist(), strict=True)]
        more = []
        wide = (n_a > 1) | (n_b > 1)
        at = np.flatnonzero(wide)
        for k, i, i2, j, j2 in zip(*(x.tolist() for x in (at, p[at], p[at + 1], q[at], q[at + 1])), strict=True):
            ids_a, ids_b = a[i:i2], b[j:j2]
            said[k] = f"{','.join([name[x] for x in ids_a])}|{','.join([name[x] for x in ids_b])}"
            more += expand(ids_a, ids_b, ends_a[i:i2], ends_b[j:j2])
        # no token is empty, so a group's ids have one link less than they are
        upto = np.concatenate([[0], np.cumsum(n_a + n_b - 1)])
        links, alone = np.empty(upto[-1], np.int64), np.zeros(upto[-1], bool)
        alone[upto[:-1][~wide]] = True
        links[alone], links[~alone] = (first_a << 32 | first_b)[~wide], more
        links = links.tobytes()
        # each unit's groups
        g = np.concatenate([[0], np.searchsorted(ends, np.cumsum([len(u.encode()) + 1 for u in units]), "right")])
        n_a, n_b, ends = np.diff(p[g]).tolist(), np.diff(q[g]).tolist(), (8 * upto[g]).tolist()
        g = g.tolist()
        for k, u in enumerate(units):
            self.known[u] = (n_a[k], n_b[k], g[k + 1] - g[k], ";".join(said[g[k] : g[k + 1]]), links[ends[k] : ends[k + 1]])
        return True

    def units(self, texts: list[str]) -> list[list[tuple]]:
        """What is known of each text's units, in order; no units for a null or empty text, or one whose bytes differ."""
        if len(self.known) > self.kept or self.chars > CHARS_KEPT:
            self.known, self.before, self.chars = {}, self.known, 0
        parts = [(units_of(t) if self.splits else [t]) if t else [] for t in texts]
        known = self.known
        new = set().union(*parts).difference(known)
        self.chars += sum(map(len, new))
        for u in new & self.before.keys():
            known[u] = self.before[u]
        new.difference_update(known)
        # units that don't end in white space can stand one behind the other
        joint = [u for u in new if self.splits and u and not u[-1].isspace() and not u[0].isspace()]
        for run in [joint, *[[u] for u in new.difference(joint)]]:
            if run and not self.learn(run):
                for u in run:
                    if not self.learn([u]):
                        known[u] = None
        out = []
        for t, p in zip(texts, parts, strict=True):
            rows = [known[u] for u in p]
            if None in rows:
                # some unit's bytes differ: the whole text decides
                rows = [known[t]] if self.learn([t]) else []
            out.append(rows)
        return out


@functools.lru_cache(1)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def batches(texts: list[str | None], size: int = 1 << 20) -> Iterator[list[str | None]]:
    """Texts in runs of about `size` characters."""
    run, n = [], 0
    for t in texts:
        run.append(t)
        n += len(t or "")
        if n >= size:
            yield run
            run, n = [], 0
    if run:
        yield run


def numbered(docs: DataFrame, path_a: str, path_b: str, groups: bool, chunk_links: int) -> DataFrame:
    """One row a document: counts, digest and its different links as numbers within the chunk (`at`, with `times`); and rows that
    say which link has which number in how many of the chunk's documents (`base`, `link`, `docs`)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", groups string" if groups else ""
    schema = f"chunk long, is_doc boolean, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string{more}, at array<int>, times array<int>, base int, link array<long>, docs array<int>"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, part, seq, held, size = pair_of(path_a, path_b), TaskContext.get().partitionId(), 0, [], 0
        types = {}

        def flush() -> Iterator[pa.RecordBatch]:
            chunk = part << 32 | seq
            found = [h[-1][0] for h in held]
            links, at = np.unique(np.concatenate([np.zeros(0, np.int64), *found]), return_inverse=True)
            n = np.bincount(at, minlength=len(links)).astype(np.int32)
            at = at.astype(np.int32)
            offsets = np.cumsum([0, *map(len, found)], dtype=np.int64)

            def batch(cols: dict) -> pa.RecordBatch:
                n = len(next(iter(cols.values())))
                return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in types["out"]], schema=types["out"])

            def lists(flat: np.ndarray, offs: np.ndarray) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(flat))

            step = 2000
            for lo in range(0, len(held), step):
                rows = held[lo : lo + step]
                offs = offsets[lo : lo + len(rows) + 1]
                own = slice(offs[0], offs[-1])
                cols = {"chunk": pa.array(np.full(len(rows), chunk)), "is_doc": pa.array([True] * len(rows)), "doc_id": pa.array([r[0] for r in rows], types["doc_id"])}
                for k, name in enumerate(("n_a", "n_b", "n_groups", "n_links"), 1):
                    cols[name] = pa.array([r[k] for r in rows], pa.int64())
                cols["groups_sha256"] = pa.array([r[5] for r in rows], pa.string())
                if groups:
                    cols["groups"] = pa.array([r[6] for r in rows], pa.string())
                cols["at"] = lists(at[own], offs - offs[0])
                cols["times"] = lists(np.concatenate([r[-1][1] for r in rows]), offs - offs[0])
                yield batch(cols)
            for lo in range(0, len(links), SLICE):
                hi = min(lo + SLICE, len(links))
                ends = np.array([0, hi - lo])
                yield batch({"chunk": pa.array([chunk]), "is_doc": pa.array([False]), "base": pa.array([lo], pa.int32()), "link": lists(links[lo:hi], ends), "docs": lists(n[lo:hi], ends)})

        for frame in frames:
            if not types:
                types["doc_id"] = frame.schema.field("doc_id").type
                fields = {"chunk": pa.int64(), "is_doc": pa.bool_(), "doc_id": types["doc_id"], **dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64()), "groups_sha256": pa.string(), **({"groups": pa.string()} if groups else {}), "at": pa.list_(pa.int32()), "times": pa.list_(pa.int32()), "base": pa.int32(), "link": pa.list_(pa.int64()), "docs": pa.list_(pa.int32())}
                types["out"] = pa.schema(fields)
            ids, at = frame.column("doc_id").to_pylist(), 0
            for texts in batches(frame.column("text").to_pylist()):
                for rows in pair.units(texts):
                    links, times = np.unique(np.frombuffer(b"".join([r[4] for r in rows]), np.int64), return_counts=True)
                    text = ";".join([r[3] for r in rows])
                    digest = hashlib.sha256(text.encode()).hexdigest() if rows else ""
                    held.append((ids[at], *[sum([r[k] for r in rows]) for k in range(3)], int(times.sum()), digest, *([text] if groups else []), (links, times.astype(np.int32))))
                    at += 1
                    size += len(links)
                    if size >= chunk_links:
                        yield from flush()
                        seq, held, size = seq + 1, [], 0
        if held:
            yield from flush()

    return cut(docs.mapInArrow(run, schema))


def link_counts(rows: DataFrame) -> DataFrame:
    """(link, n, is_best): in how many documents each id pair is linked, and whether no pair of its A id is in more."""
    n = rows.where("not is_doc").select(F.explode(F.arrays_zip("link", "docs")).alias("x")).groupBy(F.col("x.link").alias("link")).agg(F.sum("x.docs").alias("n"))
    a = F.shiftright("link", 32)
    top = n.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return n.withColumn("a", a).join(top, "a").select("link", "n", (F.col("n") == F.col("most")).alias("is_best"))


def align_tokens(docs: DataFrame, path_a: str, path_b: str, groups: bool = False, chunk_links: int = CHUNK_LINKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256[, groups]) of every text.

    A reads space+text, B adds that space itself. Ends that both share cut both id lists into groups `a1,a2|b1;...`; links are the
    pairs of occurrences whose bytes overlap. `count_sum` adds up, over a text's links, in how many documents the
    pair is linked; `n_best` counts the links whose pair is in as many documents as any pair of its A id.

    Units between spaces are aligned once and remembered by a worker; a text of a unit whose bytes differ is read as a
    whole. Counting deals no document's links: a chunk of documents numbers its different links, only the numbers'
    table (with documents a link) is summed over the corpus, and the sums come back to the chunk. So a link that
    every document holds is one row a chunk. `chunk_links` bounds what a task holds and changes no result.

    Null and empty texts, and those whose tokens' bytes differ from space+text, have no tokens: zeros and ''. Null
    ids pass through, repeated rows count as documents of their own, other columns are ignored, an empty table
    gives no rows. A text is never cut; the longest has to fit into memory.
    """
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), path_a, path_b, groups, chunk_links)
    table = rows.where("not is_doc").select("chunk", "base", F.posexplode(F.arrays_zip("link", "docs")).alias("i", "x")).select(F.col("chunk").alias("of"), (F.col("base") + F.col("i")).alias("i"), F.col("x.link").alias("link"))
    back = table.join(link_counts(rows), "link").select("of", "i", "n", "is_best")
    own = rows.where("is_doc").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *(["groups"] if groups else []), "at", "times")
    out = T.StructType([own.schema[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())] + [own.schema[c] for c in own.columns if c.startswith("groups")])

    def sums(own: pa.Table, table: pa.Table) -> pa.Table:
        i = table.column("i").to_numpy()
        n, best = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        n[i], best[i] = table.column("n").to_numpy(), table.column("is_best").to_numpy()
        at, times = own.column("at").combine_chunks(), own.column("times").combine_chunks()
        offs, flat = at.offsets.to_numpy() - at.offsets[0].as_py(), at.flatten().to_numpy()
        each = times.flatten().to_numpy().astype(np.int64)
        upto = lambda x: np.concatenate([[0], np.cumsum(x)])[offs]
        own = own.append_column("n_best", pa.array(np.diff(upto(best[flat] * each)))).append_column("count_sum", pa.array(np.diff(upto(n[flat] * each))))
        return own.select(out.names)

    return own.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(sums, out)
