"""Byte-pair merging: heap-and-linked-list token counts, and a bounded-lookahead streaming transducer.

Vocabulary files are parameters (paths); they are read once per Python worker.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space of the tokenizer files' patterns, spelled out since Python's own \s also holds \x1c-\x1f.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The byte-level pre-tokenizer's pattern (a fixed value of the public format).
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Entries of a worker's word cache; past that it starts anew, so memory is bounded and results never change.
CACHE = 200_000


@functools.cache
def byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@functools.cache
def char_bytes() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_chars())}


class Merges:
    """A merge list: the ids of pieces, and for each adjacent pair its rank and the piece it becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.normalise = spec.get("normalizer") is not None
        self.byte_decoder = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.pieces = {i: p for p, i in self.vocab.items()} | {i: p for p, i in self.special.items()}
        #: For each pair of adjacent ids, as one number, its rank in the list; and what each rank makes.
        self.pairs: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.made.append(self.vocab[a + b])
        self.bytes = [self.vocab.get(c) for c in byte_chars()]
        self.last = [self.vocab.get(c + self.end) for c in byte_chars()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols to the right of a piece's end after which that end can no longer change.

        Whether a merge (a, b) happens can depend on what follows b only through a merge (e, c) of lower rank, where
        e is b or an end part of b (b's right half, that one's right half, ...); whether c comes to be depends
        in the same way on end parts of c, with a rank lower still. So ranks fall along the chain. The longest
        chain, found in one pass over the merges in rank order, times the longest piece bounds how far to the
        right anything can matter.
        """
        longest: dict[int, int] = {}  # of chains that begin with a merge whose left part is this piece
        right: dict[int, int] = {}  # a piece's right half, as the lowest-rank merge makes it
        most = 1
        for rank, pair in enumerate(self.pairs):  # in rank order
            a, b = pair >> 20, pair & 0xFFFFF
            chain, e = 1 + longest.get(b, 0), right.get(b)
            while e is not None:
                chain, e = max(chain, 1 + longest.get(e, 0)), right.get(e)
            longest[a] = max(longest.get(a, 0), chain)
            right.setdefault(self.made[rank], b)
            most = max(most, chain)
        return (most + 1) * max(len(p.removesuffix(self.end) if self.end else p) for p in self.vocab)

    @functools.cached_property
    def inner(self) -> frozenset[int]:
        """Pairs of symbols that stand next to each other inside some piece. Between two symbols that are no such
        pair every piece ends, whatever follows: there the lookahead is 0. An end-of-word symbol pairs with nothing."""
        ends: dict[int, tuple[int, int]] = {}
        pairs = set()
        for rank, pair in enumerate(self.pairs):
            a, b = (ends.get(x, (x, x)) for x in (pair >> 20, pair & 0xFFFFF))
            pairs.add(a[1] << 20 | b[0])
            ends.setdefault(self.made[rank], (a[0], b[1]))
        return frozenset(pairs)

    @functools.cached_property
    def raw(self) -> list[bytes]:
        """The bytes that each id stands for, the end of a word as a space."""
        out = [b""] * (max(self.pieces) + 1)
        for i, p in self.pieces.items():
            if i in self.special.values():
                out[i] = p.encode()
            else:
                ended = bool(self.end) and p.endswith(self.end)
                out[i] = bytes(char_bytes()[c] for c in (p.removesuffix(self.end) if ended else p)) + b" " * ended
        return out

    def symbols(self, word: str) -> list[int]:
        """Ids of a word's bytes; the last one carries the end-of-word mark where the list has one."""
        raw = word.encode("utf-8", "replace")
        ids = [self.bytes[b] for b in raw]
        if ids:
            ids[-1] = self.last[raw[-1]]
        return ids


@functools.cache
def merges_of(path: str) -> Merges:
    return Merges(path)


def merge(sym: list[int], table: Merges) -> tuple[int, list[int]]:
    """Repeatedly merge the lowest-rank adjacent pair, leftmost first: a heap of (rank, place), packed into
    one number each, over a linked list of symbols. Leaves in `sym` the pieces, with -1 where a symbol went
    into the piece before it; returns the number of pieces, and for each symbol its successor."""
    pairs, made, n = table.pairs.get, table.made, len(sym)
    heap = [r * n + i for i in range(n - 1) if (r := pairs(sym[i] << 20 | sym[i + 1])) is not None]
    nxt, prv, left = list(range(1, n + 1)), list(range(-1, n - 1)), n
    heapify(heap)
    while heap:
        rank, i = divmod(heappop(heap), n)
        j = nxt[i]
        if sym[i] < 0 or j >= n or pairs(sym[i] << 20 | sym[j]) != rank:
            continue  # one of the two has gone into another merge
        left -= 1
        sym[i], sym[j] = (new := made[rank]), -1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            if (r := pairs(new << 20 | sym[k])) is not None:
                heappush(heap, r * n + i)
        if (h := prv[i]) >= 0 and (r := pairs(sym[h] << 20 | new)) is not None:
            heappush(heap, r * n + h)
    return left, nxt


def merged_count(ids: list[int], table: Merges) -> int:
    """Pieces left after merging: initial symbols minus merges; no ids are emitted."""
    return merge(ids, table)[0]


class Counter(dict):
    """Tokens of a unit: what stands between white space, with the space before it or without; counted on
    first sight. A word with one mark behind it is the sum of the two, which keeps first sights few."""

    def __init__(self, table: Merges, lead: str, plain: Counter | None = None):
        super().__init__()
        self.table, self.lead, self.pattern, self.plain = table, lead, regex.compile(BYTE_LEVEL), self if plain is None else plain

    def __missing__(self, unit: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        if unit.isalpha():
            n = merged_count(self.table.symbols(self.lead + unit), self.table)
        elif unit[:-1].isalpha() and unit[-1] in ".,;:!?":
            n = self[unit[:-1]] + self.plain.general(unit[-1])
        else:
            n = self.general(unit)
        if len(unit) <= 64:
            self[unit] = n
        return n

    def general(self, unit: str) -> int:
        return sum(merged_count(self.table.symbols(w), self.table) for w in self.pattern.findall(self.lead + unit))


@functools.cache
def counters(path: str) -> tuple[Counter, Counter]:
    table = merges_of(path)
    plain = Counter(table, "")
    return Counter(table, " ", plain), plain


#: White space besides space and line feed, and two of these in a row: texts that have any go the general way.
OTHER = [*"\t\x0b\x0c\r\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)), "  ", "\n\n", " \n", "\n "]
UNITS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def count_tokens(text: str, path: str) -> int:
    """Tokens of a text. No pre-token crosses from other characters into white space, so the text falls into
    units of white space and what follows it, each counted by itself and remembered."""
    table = merges_of(path)
    space, plain = counters(path)
    total = 0
    for part in table.split_special.split(text) if table.split_special else [text]:
        if part in table.special:
            total += 1
        elif not part or part[0] in " \n" or part[-1] in " \n" or any(map(part.__contains__, OTHER)):
            total += sum(map(plain.general, UNITS.findall(part)))
        else:
            rows = part.split("\n")
            total += plain.general("\n") * (len(rows) - 1)
            for row in rows:
                head, *tail = row.split(" ")
                total += plain[head] + sum(map(space.__getitem__, tail))
    return total


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text, by heap-and-linked-list merging.

    Null text counts as empty: 0 bytes, 0 tokens. Special strings inside texts count as their one token, as
    the tokenizers library does by default. Texts are never cut; a very long one is one row of its batch.
    Repeated rows give repeated results; null ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [0 if t is None else count_tokens(t, path) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": pd.Series(n, dtype="int64"), "over_limit": [x > limit for x in n]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


# --- encoding and decoding -------------------------------------------------------------------------------

#: Up to this many symbols a scan over the ranks is quicker than a heap.
FEW = 24
NEVER = 1 << 60


def settle(sym: list[int], table: Merges) -> list[int]:
    """The pieces of a whole run of symbols; lowest rank first, leftmost first."""
    if len(sym) > FEW:
        sym = list(sym)
        merge(sym, table)
        return [x for x in sym if x >= 0]
    rank_of, made, n = table.pairs.get, table.made, len(sym) - 1
    ranks = [rank_of(a << 20 | b, NEVER) for a, b in zip(sym, sym[1:], strict=False)]
    while n > 0 and (best := min(ranks)) != NEVER:
        at = ranks.index(best)
        sym[at] = new = made[best]
        del sym[at + 1], ranks[at]
        n -= 1
        if at:
            ranks[at - 1] = rank_of(sym[at - 1] << 20 | new, NEVER)
        if at < n:
            ranks[at] = rank_of(new << 20 | sym[at + 1], NEVER)
    return sym


def transduce(symbols: Iterable[int], table: Merges) -> Iterator[int]:
    """Pieces of a symbol stream of any length, emitted once stable.

    Two symbols that stand together in no piece (an end of word and what follows, say) end all pieces between
    them, so all before leaves at once. Else the buffer grows up to twice the lookahead; what ends at least a
    lookahead before the buffer's end can't change and leaves. A piece's end stays an end, so the rest of the
    stream can start from there.
    """
    reach, inner = table.lookahead, table.inner
    buffer: list[int] = []
    for s in symbols:
        if buffer and buffer[-1] << 20 | s not in inner:
            yield from settle(buffer, table)
            buffer = []
        buffer.append(s)
        if len(buffer) >= 2 * reach:
            rest = list(buffer)
            _, nxt = merge(buffer, table)
            at = [i for i, x in enumerate(buffer) if x >= 0]
            stable = [i for i in at if nxt[i] <= len(buffer) - reach]
            yield from [buffer[i] for i in stable]
            buffer = rest[nxt[stable[-1]] if stable else 0 :]
    yield from settle(buffer, table)


class TextStream:
    """Decoder state machines: ids in, text out as soon as it is certain.

    `feed` gives what the tokenizer file's library gives. Files with a byte-level decoder: pieces become bytes, and an
    incremental UTF-8 machine holds back at most three bytes of an unfinished character. Files without a
    decoder: pieces come out as written, with a space between. `restore` gives the text that the pieces stand
    for by the byte machine for either kind, ends of words as spaces.
    """

    def __init__(self, table: Merges):
        self.table, self.started = table, False
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def restore(self, ids: Iterable[int]) -> str:
        return self.utf8.decode(b"".join(map(self.table.raw.__getitem__, ids)))

    def feed(self, ids: Iterable[int]) -> str:
        if self.table.byte_decoder:
            return self.restore(ids)
        pieces = list(map(self.table.pieces.__getitem__, ids))
        out = (" " if self.started and pieces else "") + " ".join(pieces)
        self.started |= bool(pieces)
        return out

    def close(self) -> str:
        return self.utf8.decode(b"", True)

    def bytes_text(self, ids: Iterable[int]) -> str:
        """The whole text that the pieces stand for."""
        return self.restore(ids) + self.close()


#: The word pattern of word-end vocabularies (a fixed value of the public format).
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
LETTERS, OTHERS = regex.compile(r"\p{L}+"), regex.compile(rf"[^{SPACE}\p{{L}}\p{{N}}]+")
#: Characters of a text that are normalised and matched at a time.
SLICE = 1 << 14


#: Marks that mostly stand alone; and for Latin-1 text the class of each character: mark, white space, part of a word,
#: other symbol, control character that Python's split takes for white space.
MARKS = ".,;:!?"
CLASSES = bytes(ord("m" if chr(i) in MARKS else "x" if 28 <= i <= 31 else " " if chr(i).isspace() else "a" if chr(i).isalnum() else "o") for i in range(256))


def words_of(low: str) -> list[str]:
    """Units whose own words, one after the other, are the words of a normal form; white space is dropped. Latin-1 text
    whose marks stand alone (mostly so) is split at them and at white space, all else by the pattern."""
    try:
        kinds = low.encode("latin-1").translate(CLASSES)
    except UnicodeEncodeError:
        return WORDS.findall(low)
    if b"mm" in kinds or b"mo" in kinds or b"om" in kinds or b"x" in kinds:
        return WORDS.findall(low)
    for m in MARKS:
        low = low.replace(m, f" {m} ")
    return low.split()


def packed(ids: Iterable[int]) -> bytes:
    """Ids as unsigned 32 bits (array uses the machine's order, little-endian on all that Spark supports)."""
    return array("I", ids).tobytes()


class WordIds(dict):
    """Ids (little-endian, unsigned 32 bits) of words met before. Two generations of REMEMBERED words at most: when the
    younger is full the older is dropped, so memory is bounded and frequent words stay."""

    REMEMBERED = 120_000

    def __init__(self, table: Merges):
        super().__init__()
        self.table, self.older = table, {}

    def __missing__(self, word: str) -> bytes:
        out = self.older.get(word)
        if out is None:
            if word.isalpha() or word in MARKS:
                # a word's end is certain, so a short one is settled at once
                sym = self.table.symbols(word)
                out = packed(settle(sym, self.table) if len(sym) <= FEW else transduce(sym, self.table))
            else:
                out = b"".join([packed(transduce(self.table.symbols(w), self.table)) for w in WORDS.findall(word)])
        if len(word) <= 64:
            if len(self) >= self.REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = out
        return out


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(merges_of(path))


def lower_form(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def clean_cut(text: str, lo: int, hi: int) -> int:
    """The last place in (lo, hi] where normalising both sides apart is normalising the whole, at best before white
    space; beyond hi if there is none up to it."""
    at = max(text.rfind(" ", lo + 1, hi), text.rfind("\n", lo + 1, hi))
    if at > lo:
        return at
    form = unicodedata.normalize
    apart = lambda i: not unicodedata.combining(text[i]) and form("NFC", text[i - 1 : i + 1]) == form("NFC", text[i - 1]) + form("NFC", text[i])
    back = next((i for i in range(hi, lo, -1) if apart(i)), None)
    return back or next((i for i in range(hi + 1, len(text)) if apart(i)), len(text))


def slices(text: str, lo: int, hi: int) -> Iterator[tuple[str, bool]]:
    """(normal form, open) of text[lo:hi] piece by piece; open if the next piece may go on with a run of this one."""
    while lo < hi:
        end = hi if hi - lo <= SLICE else min(hi, clean_cut(text, lo, lo + SLICE))
        yield lower_form(text[lo:end]), end < hi and text[end] not in " \n"
        lo = end


def encode_stream(text: str, path: str) -> Iterator[bytes]:
    """Ids of a whole text (little-endian, unsigned 32 bits), in pieces, as soon as they are certain.

    The text goes through in slices. Words (for which the file's pattern decides) are looked up or go through the
    transducer; a run without an end in the slice is held back, and one longer than a slice is fed to the transducer
    symbol by symbol as the slices come. Nothing grows with the text.
    """
    table, words = merges_of(path), word_ids(path)
    marks = table.split_special.finditer(text) if table.split_special else ()
    lo = 0
    for mark in chain(marks, (None,)):
        yield from encode_plain(text, lo, mark.start() if mark else len(text), table, words)
        if mark:
            yield struct.pack("<I", table.special[mark[0]])
            lo = mark.end()


def encode_plain(text: str, lo: int, hi: int, table: Merges, words: WordIds) -> Iterator[bytes]:
    source = slices(text, lo, hi)
    held, more = "", False

    def run_symbols(kind: regex.Pattern) -> Iterator[int]:
        """Symbols of the run that `held` begins with, drawn from further slices as long as it goes on."""
        nonlocal held, more
        last = None
        while (m := kind.match(held)) is not None:
            for b in m[0].encode("utf-8", "replace"):
                if last is not None:
                    yield table.bytes[last]
                last = b
            held = held[m.end() :]
            if held or not more:
                break
            held, more = next(source, ("", False))
        yield table.last[last]

    for low, more in source:
        held += low
        while more and len(held) > SLICE and (long := LETTERS.match(held) or OTHERS.match(held)) and long.end() >= SLICE:
            run = transduce(run_symbols(LETTERS if LETTERS.match(held) else OTHERS), table)
            while ids := list(islice(run, SLICE)):
                yield packed(ids)
        if not more:
            now, held = held, ""
        else:  # what ends within three characters of the end may be the beginning of something longer
            cut = next((m.start() for m in WORDS.finditer(held, pos=max(0, safe_start(held))) if m.end() > len(held) - 3), len(held))
            now, held = held[:cut], held[cut:]
        if out := b"".join(map(words.__getitem__, words_of(now))):
            yield out
    if held:
        yield b"".join(map(words.__getitem__, words_of(held)))


def safe_start(held: str) -> int:
    """A place from which matching agrees with matching from the beginning: after the last white space."""
    return max(held.rfind(" "), held.rfind("\n")) + 1


def encode_units(text: str, path: str) -> list[tuple[bytes, str]]:
    """The pieces that encode_stream gives, each with what the library decodes from it alone."""
    return [(piece, TextStream(merges_of(path)).feed(array("I", piece))) for piece in encode_stream(text, path)]


#: Bytes of ids and texts that a frame of results holds.
FRAME = 1 << 22


def bpe_stream(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_restored, ids, decoded): every whole text encoded by the
    bounded-lookahead transducer and decoded again; of ids and decoded, those named in `outputs`. n_restored is the
    length of the text that the ids stand for (normal form, a space behind each word), by the byte-to-text machine.

    For vocabularies with word ends (NFC, lower case, white space dropped). Null text counts as empty: no
    ids, the digest of nothing. Ids leave the transducer in pieces, which go into the digests and through the
    decoders at once; besides the row itself and the outputs asked for, nothing grows with a text. Results
    leave in frames of about FRAME bytes. Repeated rows give repeated results; null ids pass through; other
    columns are ignored.
    """

    def one(text: str) -> tuple[int, str, str, int, list[bytes], list[str]]:
        n, restored, ids_sha, text_sha = 0, 0, hashlib.sha256(), hashlib.sha256()
        table, ids_out, text_out = merges_of(path), [], []
        shown, byte_machine = TextStream(table), TextStream(table)

        def give(said: str, back: str) -> None:
            nonlocal restored
            text_sha.update(said.encode("utf-8", "replace"))
            restored += len(back)
            if "decoded" in outputs:
                text_out.append(said)

        for piece in encode_stream(text, path):
            ids_sha.update(piece)
            ids = array("I", piece)
            n += len(ids)
            give(shown.feed(ids), byte_machine.restore(ids))
            if "ids" in outputs:
                ids_out.append(piece)
        give(shown.close(), byte_machine.close())
        return n, ids_sha.hexdigest(), text_sha.hexdigest(), restored, ids_out, text_out

    def frame(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        n, a, b, restored, pieces, said = zip(*rows, strict=True)
        columns = {"doc_id": ids, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b), "n_restored": pa.array(restored, pa.int64())}
        if "ids" in outputs:
            values = np.frombuffer(b"".join([x for p in pieces for x in p]), dtype=np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values, pa.int32()))
        if "decoded" in outputs:
            columns["decoded"] = pa.array(["".join(x) for x in said])
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lo, rows, size = 0, [], 0
            for i in range(b.num_rows):
                rows.append(one(b["text"][i].as_py() or ""))
                size += 200 + 4 * rows[-1][0] * ("ids" in outputs) + 8 * rows[-1][0] * ("decoded" in outputs)
                if size >= FRAME or i + 1 == b.num_rows:
                    yield frame(b["doc_id"].slice(lo, i + 1 - lo), rows)
                    lo, rows, size = i + 1, [], 0

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_restored long" + ", ids array<int>" * ("ids" in outputs) + ", decoded string" * ("decoded" in outputs))
