"""Language identification by hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacuna.llm.common import crc_fold

DIMENSIONS = 512
#: Texts are worked off in groups of about this many characters, so memory doesn't grow with a batch.
CHUNK = 1 << 21


@functools.cache
def letters() -> np.ndarray:
    """For each code point: itself in lower case if a letter (the first code point of it), else 0."""
    low = np.zeros(0x110000, dtype=np.int32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low[i] = ord(c.lower()[0])
    return low


def letter_vector(code: int) -> np.ndarray:
    """A random vector of -1 and 1, the same for a code point wherever it is drawn; 0 is the word edge."""
    return np.random.default_rng([7919, int(code)]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1


class Profiles:
    """Bundles of trigrams. A trigram's vector binds its letters: first twice permuted, second once, third as
    it is, multiplied; a permutation is a rotation. A text's bundle is the sum over its trigrams."""

    def __init__(self):
        self.index = np.full(0x110000, -1, dtype=np.int32)
        self.turned = [np.zeros((0, DIMENSIONS), dtype=np.int8) for _ in range(3)]

    def ids(self, codes: np.ndarray) -> np.ndarray:
        new = np.flatnonzero(np.bincount(codes[self.index[codes] < 0])) if len(codes) else codes
        if len(new):
            base = np.array([letter_vector(c) for c in new])
            self.index[new] = np.arange(len(new)) + len(self.turned[0])
            self.turned = [np.vstack([t, np.roll(base, 2 - k, axis=1)]) for k, t in enumerate(self.turned)]
        return self.index[codes].astype(np.int64)

    def bundle(self, texts: list[str]) -> np.ndarray:
        """A row for each text, scaled to length 1, or all zeros if it has no letter."""
        out = np.zeros((len(texts), DIMENSIONS), dtype=np.float32)
        parts = []
        for t in texts:
            raw = letters()[np.frombuffer(t.encode("utf-32-le", "replace"), dtype=np.uint32)]
            raw = np.concatenate(([0], raw, [0]))
            parts.append(raw[np.concatenate(([True], (raw[1:] > 0) | (raw[:-1] > 0)))])  # one edge between words
        whole = np.concatenate(parts)
        size = np.array([len(p) for p in parts])
        x = self.ids(whole)
        many = len(self.turned[0])
        gram = (x[:-2] * many + x[1:-1]) * many + x[2:]
        inside = np.ones(len(whole), dtype=bool)
        ends = np.cumsum(size)
        inside[ends - 1] = inside[ends - 2] = False  # a trigram stays within its text
        inside &= np.concatenate((whole[1:] > 0, [False])) | (whole > 0)
        row = np.repeat(np.arange(len(texts)), size)[:-2][inside[:-2]]
        gram = gram[inside[:-2]]
        if not len(gram):
            return out
        if many**3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(gram, minlength=1))
            place = np.zeros(many**3, dtype=np.int64)
            place[used] = np.arange(len(used))
            gram = place[gram]
        else:
            used, gram = np.unique(gram, return_inverse=True)
        for lo in range(0, len(used), 8192):  # in slices, so that rare scripts don't make a huge table
            ids = used[lo : lo + 8192]
            vec = self.turned[0][ids // many**2] * self.turned[1][ids // many % many] * self.turned[2][ids % many]
            mine = (gram >= lo) & (gram < lo + 8192) if len(used) > 8192 else slice(None)
            counts = np.bincount(row[mine] * len(ids) + gram[mine] - lo, minlength=len(texts) * len(ids))
            out += counts.reshape(len(texts), len(ids)).astype(np.float32) @ vec.astype(np.float32)
        norm = np.linalg.norm(out.astype(np.float64), axis=1, keepdims=True)
        return (out / np.where(norm > 0, norm, 1)).astype(np.float32)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        out, lo = np.zeros((len(texts), DIMENSIONS), dtype=np.float32), 0
        size = np.cumsum([len(t or "") + 2 for t in texts])
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + CHUNK)))
            hi = min(hi, lo + 256)
            out[lo:hi] = self.bundle([t or "" for t in texts[lo:hi]])
            lo = hi
        return out


@functools.cache
def profiles() -> Profiles:
    return Profiles()


def prototypes(labelled: DataFrame, rows_per_language: int = 4000) -> tuple[list[str], np.ndarray]:
    """Learn one prototype per language from (text, lang, doc_id): the sum of unit bundles, less the mean of
    all languages' unit prototypes. At most about `rows_per_language` rows of each language are read, chosen
    by a hash of the id. Partial sums are made in the tasks; what comes to the driver is one vector per
    language. Languages are ordered by name, so ties go to the first."""
    labelled = labelled.where("lang is not null and text is not null")
    n = labelled.groupBy("lang").agg(F.count("*").alias("_n"))
    share = F.least(F.lit(1.0), F.lit(float(rows_per_language)) / F.col("_n"))
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < share * (1 << 30)
    some = labelled.join(F.broadcast(n), "lang").where(drawn).select("text", "lang")  # one row per language

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            x = profiles().bundles(list(b["text"]))
            for lang in set(b["lang"]):
                total[lang] = total.get(lang, 0) + x[(b["lang"] == lang).to_numpy()].sum(0, dtype=np.float64)
        for lang, v in total.items():
            yield pd.DataFrame({"lang": lang, "dim": np.arange(DIMENSIONS), "v": np.round(v, 4)})

    parts = some.mapInPandas(sums, "lang string, dim int, v double")
    table = parts.groupBy("lang", "dim").agg(F.sum(F.col("v").cast("decimal(30,4)")).cast("double").alias("v")).toPandas()
    langs = sorted(set(table["lang"]))
    p = np.zeros((len(langs), DIMENSIONS))
    for k, lang in enumerate(langs):
        one = table[table["lang"] == lang]
        p[k, one["dim"].to_numpy()] = one["v"].to_numpy()
    unit = lambda a: a / np.maximum(np.linalg.norm(a, axis=-1, keepdims=True), 1e-12)
    return langs, unit(p)


def predict(docs: DataFrame, langs: list[str], p: np.ndarray) -> DataFrame:
    """docs with `text` -> docs with lang_pred and score: the language whose prototype, less what all
    prototypes share, is nearest by cosine; score is the cosine with its whole prototype, at least 0. Other
    columns pass through."""
    common = p.mean(0) if len(p) > 1 else 0 * p.sum(0)
    apart = p - common
    apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = profiles().bundles(list(b["text"])).astype(np.float64)
            seen = np.abs(x).sum(1) > 0
            if len(langs):
                best = ((x - common) @ apart.T).round(9).argmax(1)
                score = np.clip((x * p[best]).sum(1), 0, 1)
            else:
                best, seen, score = np.zeros(len(b), dtype=int), seen & False, np.zeros(len(b))
            name = np.array([*langs, "und"], dtype=object)[np.where(seen, best, len(langs))]
            b = b.assign(lang_pred=name, score=np.where(seen, score, 0.0))
            yield b[names]

    names = [*docs.columns, "lang_pred", "score"]
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInPandas(run, schema)


def keep_known(docs: DataFrame, least: float = 0.1, rows_per_language: int = 4000) -> DataFrame:
    """Rows of docs (doc_id, text, lang, ...) whose text has a language: those that are `und`, or whose score
    is below `least` (no language's profile is near: digits, symbols, noise), go. Columns are those of docs."""
    plain = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"], "text")
    langs, p = prototypes(docs.select("doc_id", "text", "lang").where(crc_fold(F.col("doc_id")) != 2), rows_per_language)
    told = predict(plain, langs, p).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return told.select(*[F.col("text") if c == "text" else F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify(docs: DataFrame, rows_per_language: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs.

    Learns from text and non-null language of documents with crc32(id as text) mod 4 other than 2, predicts
    all of them from whole texts. `und`, score 0: null text, a text without letters, or no labelled
    document to learn from. Equal cosines go to the first language by name. A null id is never held out (its
    crc is null) and never learned from. Repeated rows give repeated results; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    langs, p = prototypes(rows.where(crc_fold(F.col("doc_id")) != 2), rows_per_language)
    out = predict(rows.select("doc_id", "text"), langs, p)
    return out.select("doc_id", F.coalesce(crc_fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
