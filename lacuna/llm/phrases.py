"""Phrase collocations from weighted acyclic automata of word n-grams."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import cut

#: Bytes that end a piece become full stops, tabs spaces.
SPLIT = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
#: A text is taken apart in slices of about so many bytes, which end where pieces end.
SLICE = 1 << 22
#: Words of a shard's block; bytes of text for each prefix range.
BLOCK_WORDS, RANGE_BYTES = 1 << 21, 1 << 23
#: Hot prefixes are looked for in about so many bytes of text, are met so often there at least, and are dealt over so many places.
SAMPLE_BYTES, SAMPLE_LEAST, SPREAD = 1 << 25, 50, 64
#: No prefix is hot.
NONE = np.zeros(0, np.uint64)


class Transducer:
    """Counts of word n-grams as an acyclic automaton. The states of depth d stand side by side in the order of their
    paths: `parent[d]` is the place of the state before, `label[d]` the word between (a place in `words`, which are
    sorted), `weight[d]` the count of the path that ends there, 0 where it's only the way to longer ones."""

    def __init__(self, words: list[bytes], parent: list[np.ndarray], label: list[np.ndarray], weight: list[np.ndarray]):
        self.words, self.parent, self.label, self.weight = words, parent, label, weight

    @classmethod
    def from_sorted(cls, paths: Iterable[tuple[bytes, ...]], weights: Iterable[int]) -> Transducer:
        """From paths in order, one by one: what a path shares with the one before is there already, the rest is added."""
        paths = list(paths)
        words = sorted({w for p in paths for w in p})
        place = {w: i for i, w in enumerate(words)}
        depth = max(map(len, paths), default=0)
        parent, label, weight = ([[] for _ in range(depth)] for _ in range(3))
        last: tuple[bytes, ...] = ()
        for path, n in zip(paths, weights, strict=True):
            same = next((i for i, (x, y) in enumerate(zip(path, last)) if x != y), min(len(path), len(last)))  # noqa: B905
            for d in range(same, len(path)):
                parent[d].append(len(parent[d - 1]) - 1 if d else 0)
                label[d].append(place[path[d]])
                weight[d].append(0)
            weight[len(path) - 1][-1] += n
            last = path
        return cls(words, *[[np.array(x, np.int64) for x in xs] for xs in (parent, label, weight)])

    @classmethod
    def from_text(cls, words: list[bytes], ids: np.ndarray, longest: int) -> Transducer:
        """Of a block of text: `ids` are places in `words`, -1 where a piece ends. One depth after the other, each
        position holds the state of the n-gram that begins there."""
        parent, label, weight = [], [], []
        at = np.flatnonzero(ids >= 0)
        state = np.zeros(len(at), np.int64)
        for d in range(longest):
            if d:
                on = at + d < len(ids)
                on[on] = ids[at[on] + d] >= 0
                at, state = at[on], state[on]
            code, state, n = np.unique(state * len(words) + ids[at + d], return_inverse=True, return_counts=True)
            parent.append(code // max(len(words), 1))
            label.append(code % max(len(words), 1))
            weight.append(n.astype(np.int64))
        return cls(words, parent, label, weight)

    @classmethod
    def union(cls, many: list[Transducer]) -> Transducer:
        """All paths of all, their weights added up."""
        words = sorted(set().union(*[t.words for t in many]))
        place = {w: i for i, w in enumerate(words)}
        label_of = [np.array([place[w] for w in t.words], np.int64) for t in many]
        states, parent, label, weight = [np.zeros(1, np.int64) for _ in many], [], [], []
        for d in range(max((len(t.parent) for t in many), default=0)):
            codes = [s[t.parent[d]] * len(words) + of[t.label[d]] for t, s, of in zip(many, states, label_of, strict=True)]
            code, state = np.unique(np.concatenate(codes), return_inverse=True)
            total = np.zeros(len(code), np.int64)
            np.add.at(total, state, np.concatenate([t.weight[d] for t in many]))
            states = np.split(state, np.cumsum([len(c) for c in codes])[:-1])
            parent.append(code // max(len(words), 1))
            label.append(code % max(len(words), 1))
            weight.append(total)
        return cls(words, parent, label, weight)

    def part(self, keep: list[np.ndarray]) -> Transducer:
        """The paths to the states marked in `keep`; states on the way stay with weight 0."""
        need = [k.copy() for k in keep]
        for d in range(len(need) - 1, 0, -1):
            need[d - 1][self.parent[d][need[d]]] = True
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[n] for x, n in zip(self.label, need, strict=True)]]))
        parent, label, weight = [], [], []
        for d, n in enumerate(need):
            place = np.cumsum(need[d - 1]) - 1 if d else np.zeros(1, np.int64)
            parent.append(place[self.parent[d][n]])
            label.append(np.searchsorted(used, self.label[d][n]))
            weight.append(np.where(keep[d][n], self.weight[d][n], 0))
        return Transducer([self.words[i] for i in used], parent, label, weight)

    def compose(self, asked: Transducer) -> list[np.ndarray]:
        """For each state of `asked`, by depth, the weight here of the same path, 0 without one: both are walked together."""
        place = {w: i for i, w in enumerate(self.words)}
        label_of = np.array([place.get(w, -1) for w in asked.words], np.int64)
        state, out = np.zeros(1, np.int64), []
        for d in range(len(asked.parent)):
            came, label = state[asked.parent[d]], label_of[asked.label[d]]
            code = came * len(self.words) + label
            own = self.parent[d] * len(self.words) + self.label[d] if d < len(self.parent) else np.zeros(0, np.int64)
            at = np.minimum(np.searchsorted(own, code), max(len(own) - 1, 0))
            hit = (came >= 0) & (label >= 0) & (own[at] == code if len(own) else False)
            state = np.where(hit, at, -1)
            out.append(np.where(hit, self.weight[d][at], 0) if len(own) else np.zeros(len(code), np.int64))
        return out

    def spread(self, hot: np.ndarray) -> list[np.ndarray]:
        """Where each path lies, from 0 to 2**32: paths are ordered by the mixed hash of their first two words, so what begins alike
        lies together; from the hot ones of these places, longer paths are dealt over SPREAD others by their last word."""
        crc = np.array([zlib.crc32(w) for w in self.words], np.uint64)
        out, mixed = [], np.zeros(1, np.uint64)
        for d, (p, label) in enumerate(zip(self.parent, self.label, strict=True)):
            mixed = mixed[p]
            if d < 2:
                mixed = ((mixed * np.uint64(0x9E3779B1)) ^ crc[label]) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
                mixed ^= mixed >> np.uint64(15)
                out.append(mixed)
            else:
                dealt = (mixed + crc[label] % np.uint64(SPREAD) * np.uint64(2**32 // SPREAD)) & np.uint64(0xFFFFFFFF)
                out.append(np.where(np.isin(mixed, hot), dealt, mixed))
        return out

    def ranges(self, n: int, hot: np.ndarray = NONE) -> list[np.ndarray]:
        """The prefix range, of n, in which each path is counted."""
        return [(at * np.uint64(n) >> np.uint64(32)).astype(np.int64) for at in self.spread(hot)]

    def divided(self, n: int, hot: np.ndarray = NONE) -> Iterator[tuple[int, Transducer]]:
        """The automaton of each range's own paths."""
        ranges = self.ranges(n, hot)
        sorted_ = [np.argsort(r, kind="stable") for r in ranges]
        bounds = [np.searchsorted(r, np.arange(n + 1), sorter=o) for r, o in zip(ranges, sorted_, strict=True)]
        for i in range(n):
            own = [o[b[i] : b[i + 1]] for o, b in zip(sorted_, bounds, strict=True)]
            if any(map(len, own)):
                yield i, self.picked(own)

    def picked(self, own: list[np.ndarray]) -> Transducer:
        """As part(), for few states given by their places, in order."""
        need = list(own)
        for d in range(len(own) - 1, 0, -1):
            need[d - 1] = np.union1d(need[d - 1], self.parent[d][need[d]])
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[x[n] for x, n in zip(self.label, need, strict=True)]]))
        parent, label, weight = [], [], []
        for d, n in enumerate(need):
            parent.append(np.searchsorted(need[d - 1], self.parent[d][n]) if d else np.zeros(len(n), np.int64))
            label.append(np.searchsorted(used, self.label[d][n]))
            w = np.zeros(len(n), np.int64)
            w[np.searchsorted(n, own[d])] = self.weight[d][own[d]]
            weight.append(w)
        return Transducer([self.words[i] for i in used], parent, label, weight)

    def paths(self, depth: int) -> list[tuple[bytes, ...]]:
        """The paths to all states of a depth (from 1), in order."""
        cols, at = [], np.arange(len(self.parent[depth - 1]))
        for d in range(depth - 1, -1, -1):
            cols.append([self.words[i] for i in self.label[d][at]])
            at = self.parent[d][at]
        return list(zip(*cols[::-1], strict=True))

    def to_bytes(self) -> bytes:
        text = b"\n".join(self.words)
        out = [struct.pack("<qqq", len(self.words), len(text), len(self.parent)), text]
        for p, x, w in zip(self.parent, self.label, self.weight, strict=True):
            wide = int(len(w) > 0 and int(w.max()) >= 1 << 32)
            out += [struct.pack("<qq", len(p), wide), np.diff(p, prepend=0).astype("<u4").tobytes(), np.diff(x, prepend=0).astype("<i4").tobytes(), w.astype("<i8" if wide else "<u4").tobytes()]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(out))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Transducer:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, size, depth = struct.unpack_from("<qqq", raw)
        at = 24 + size
        words = raw[24:at].split(b"\n") if n else []
        parent, label, weight = [], [], []
        for _ in range(depth):
            k, wide = struct.unpack_from("<qq", raw, at)
            at += 16
            parent.append(np.cumsum(np.frombuffer(raw, "<u4", k, at).astype(np.int64)))
            label.append(np.cumsum(np.frombuffer(raw, "<i4", k, at + 4 * k).astype(np.int64)))
            weight.append(np.frombuffer(raw, "<i8" if wide else "<u4", k, at + 8 * k).astype(np.int64))
            at += 8 * k + (8 if wide else 4) * k
        return cls(words, parent, label, weight)


class Numbers(dict):
    """Words as numbers, in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, slice by slice, with b"." where a piece ends; A-Z become lower case."""
    flat, at = text.lower().translate(SPLIT), 0
    while at < len(flat):
        end = flat.find(b".", at + SLICE)
        end = len(flat) if end < 0 else end
        yield flat[at:end].replace(b".", b" . ").split()
        at = end


def blocks(frames: Iterator[pa.RecordBatch], longest: int, block_words: int) -> Iterator[tuple[str, Transducer]]:
    """(lang, automaton) of each language's text in each block of words of a task."""
    number, held, size = Numbers({b".": 0}), {}, 0

    def flush() -> Iterator[tuple[str, Transducer]]:
        words = sorted(number.keys() - {b"."})
        place = np.full(len(number), -1, np.int64)
        place[[number[w] for w in words]] = np.arange(len(words))
        for lang, runs in held.items():
            yield lang, Transducer.from_text(words, place[np.concatenate(runs)], longest)

    for frame in frames:
        for lang, text in zip(frame.column("lang").to_pylist(), frame.column("text"), strict=True):
            for some in tokens(text.as_py()):
                ids = np.fromiter(map(number.__getitem__, some), np.int32, len(some))
                held.setdefault(lang, []).append(ids)
                size += len(ids)
            held.setdefault(lang, []).append(np.zeros(1, np.int32))
            if size >= block_words:
                yield from flush()
                number, held, size = Numbers({b".": 0}), {}, 0
    if held:
        yield from flush()


def hot_prefixes(rows: DataFrame, size: int, n_ranges: int) -> np.ndarray:
    """Places of prefixes of two words that are so frequent that what follows them would fill an eighth of a range, as far as a sample of
    bounded size shows them, the most frequent 4,096 at most. They only lay out the work; no count depends on them."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in blocks(frames, 2, BLOCK_WORDS):
            if len(t.words):
                some = t.weight[1] > 1
                yield pa.RecordBatch.from_pydict({"at": t.spread(NONE)[1][some].astype(np.int64), "n": t.weight[1][some]})

    share = min(1.0, SAMPLE_BYTES / max(size, 1))
    # a word takes about six bytes
    least = max(SAMPLE_LEAST, int(size * share / 6 / n_ranges / 8))
    found = rows.sample(share, 1).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([r["at"] for r in found.orderBy(F.desc("n"), "at").limit(4096).collect()], np.uint64)


def shards(rows: DataFrame, longest: int, n_ranges: int, hot: np.ndarray, block_words: int) -> DataFrame:
    """(lang, range, counts): the automaton of each block of words of a task, divided by prefix range."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, counts in blocks(frames, longest, block_words):
            got = [(i, t.to_bytes()) for i, t in counts.divided(n_ranges, hot)]
            if got:
                yield pa.RecordBatch.from_pydict({"lang": [lang] * len(got), "range": pa.array([i for i, _ in got], pa.int32()), "counts": [b for _, b in got]})

    return rows.mapInArrow(run, "lang string, range int, counts binary")


def united(shard_rows: DataFrame, least: int) -> DataFrame:
    """(lang, range, words, counts) by range: the sum of the shards' automata, of it the paths met `least` times or more;
    `words` is how many words all its one-word paths count, rare ones included."""

    def run(table: pa.Table) -> pa.Table:
        total = Transducer.union([Transducer.from_bytes(b) for b in table.column("counts").to_pylist()])
        n = int(total.weight[0].sum()) if total.weight else 0
        left = total.part([w >= least for w in total.weight])
        return pa.table({"lang": table.column("lang")[:1], "range": table.column("range")[:1], "words": pa.array([n], pa.int64()), "counts": pa.array([left.to_bytes()], pa.binary())})

    return cut(shard_rows.groupBy("lang", "range").applyInArrow(run, "lang string, range int, words long, counts binary"))


def candidates(ranges: DataFrame, n_ranges: int, hot: np.ndarray) -> DataFrame:
    """(lang, phrase, size, a, cuts, inner): phrases of 2 words or more, with each cut's parts and their ranges, and the shorter phrases
    of 2 words or more inside."""

    def range_of(parts: list[tuple[bytes, ...]]) -> dict[tuple[bytes, ...], int]:
        parts = sorted(set(parts))
        asked = Transducer.from_sorted(parts, [1] * len(parts))
        where = asked.ranges(n_ranges, hot)
        return {p: int(r) for d in range(len(asked.parent)) for p, r, w in zip(asked.paths(d + 1), where[d], asked.weight[d], strict=True) if w}

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda p: b" ".join(p).decode()
        for frame in frames:
            for lang, blob in zip(frame.column("lang").to_pylist(), frame.column("counts"), strict=True):
                counts = Transducer.from_bytes(blob.as_py())
                for d in range(2, len(counts.parent) + 1):
                    found = [(p, int(w)) for p, w in zip(counts.paths(d), counts.weight[d - 1], strict=True) if w]
                    if not found:
                        continue
                    where = range_of([x for p, _ in found for k in range(1, d) for x in (p[:k], p[k:])])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": [lang] * len(found),
                            "phrase": [text(p) for p, _ in found],
                            "size": pa.array([d] * len(found), pa.int32()),
                            "a": pa.array([w for _, w in found], pa.int64()),
                            "cuts": pa.array([[{"k": k, "first": text(p[:k]), "first_range": where[p[:k]], "rest": text(p[k:]), "rest_range": where[p[k:]]} for k in range(1, d)] for p, _ in found], pa.list_(pa.struct([("k", pa.int32()), ("first", pa.string()), ("first_range", pa.int32()), ("rest", pa.string()), ("rest_range", pa.int32())]))),
                            "inner": pa.array([sorted({text(p[i:j]) for i in range(d) for j in range(i + 2, d + 1) if j - i < d}) for p, _ in found], pa.list_(pa.string())),
                        }
                    )

    return cut(ranges.mapInArrow(run, "lang string, phrase string, size int, a long, cuts array<struct<k:int,first:string,first_range:int,rest:string,rest_range:int>>, inner array<string>"))


def looked_up(asked: DataFrame, ranges: DataFrame) -> DataFrame:
    """(lang, part, f) of asked parts (lang, range, part): the automaton of a range's asked paths composed with its counts."""

    def run(asked: pa.Table, ranges: pa.Table) -> pa.Table:
        parts = sorted(tuple(p.encode().split(b" ")) for p in asked.column("part").to_pylist())
        paths = Transducer.from_sorted(parts, [1] * len(parts))
        none = [np.zeros(len(w), np.int64) for w in paths.weight]
        found = [Transducer.from_bytes(b).compose(paths) for b in ranges.column("counts").to_pylist()]
        got: dict[str, int] = {}
        for d, n in enumerate(found[0] if found else none):
            for p, f, w in zip(paths.paths(d + 1), n, paths.weight[d], strict=True):
                if w:
                    got[b" ".join(p).decode()] = int(f)
        lang = asked.column("lang")[0].as_py() if len(parts) else None
        return pa.table({"lang": pa.array([lang] * len(got), pa.string()), "part": pa.array(list(got), pa.string()), "f": pa.array(list(got.values()), pa.int64())})

    ranges = ranges.select(F.col("lang").alias("l"), F.col("range").alias("r"), "counts")
    return asked.groupBy("lang", "range").cogroup(ranges.groupBy("l", "r")).applyInArrow(run, "lang string, part string, f long")


def cut_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (l r)), exact for counts up to 10 to the 15."""
    wide = lambda c: c.cast("decimal(16,0)")
    return F.call_function("div", wide(a) * wide(a) * F.lit(1_000_000).cast("decimal(7,0)"), wide(left) * wide(right))


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000, block_words: int = BLOCK_WORDS, range_bytes: int = RANGE_BYTES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    A-Z become lower case; pieces end at . , ; : ! ? and U+000A to U+000D, words at spaces and tabs. A phrase is counted
    within pieces, overlaps included, and is a candidate with `least` occurrences or more. A cut after k words scores
    floor(1,000,000 a a / (l r)), l and r the counts of both parts; the lowest-scoring cut counts, the smallest k on
    ties. A candidate goes if one that contains it has at least `share` per cent of its count. Phrases rank by
    score, then a, falling, then by their bytes; n counts all words of the language.

    Each task turns blocks of text into automata of all n-grams, sorted, and divides them by prefix range; a range's
    automata are united and their weights added; parts are looked up by composing a range's asked paths with its counts.
    Parts of a candidate are as frequent as itself, so nothing rarer than `least` is kept behind the union.
    A range holds about `range_bytes` of text; what follows a hot prefix is dealt over several; ranges only lay out the work.

    Null text is empty, a null language `und`. Repeated rows count each. Ids are not read; other columns are
    ignored; an empty table gives no rows. One piece of text has to fit into memory.
    """
    rows = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(1, -(-size // range_bytes))
    hot = hot_prefixes(rows, size, n_ranges)
    ranges = united(shards(rows, longest, n_ranges, hot, block_words), least)
    found = candidates(ranges, n_ranges, hot)

    cuts = found.select("lang", "phrase", "a", F.inline("cuts"))
    asked = cuts.select("lang", F.inline(F.array(*[F.struct(F.col(f"{p}_range").alias("range"), F.col(p).alias("part")) for p in ("first", "rest")]))).distinct()
    counts = cut(looked_up(asked, ranges))
    as_ = lambda part, name: counts.select("lang", F.col("part").alias(part), F.col("f").alias(name))
    scored = cuts.join(as_("first", "l"), ["lang", "first"]).join(as_("rest", "r"), ["lang", "rest"])
    worst = F.min(F.struct(cut_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    scored = scored.groupBy("lang", "phrase", "a").agg(worst).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    longer = found.select("lang", F.explode("inner").alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    left = left.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    n = ranges.groupBy("lang").agg(F.sum("words").alias("n"))
    return left.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
