"""The streaming transducer: bounded memory, early emission, cuts at any place, proven lookahead."""

import random
import resource
from array import array

import pytest

from lacuna.llm import bpe
from lacuna.llm.queries import documents, tokenizer

WORD = tokenizer("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD)


def ids_of(text):
    return list(array("I", b"".join(bpe.encode_stream(text, WORD))))


@pytest.mark.parametrize("size", [7, 16, 33, 1 << 14])
def test_cuts_change_nothing(monkeypatch, size):
    monkeypatch.setattr(bpe, "SLICE", size)
    lib, r = library(), random.Random(size)
    pool = [*"abc thE'sé ñ\n\t  \r\x1c\x85\xa0ΣσςİıḰe̊12９½漢字한국각🙂👩‍👩'll'RE...!!--", "<|endoftext|>", " the", "hello", "straße", "Å"]
    for n in [12] * 300 + [200] * 150:
        text = "".join(r.choice(pool) for _ in range(r.randint(0, n)))
        for t in (text, text.replace(" ", "").replace("\n", "")):
            assert ids_of(t) == lib.encode(t, add_special_tokens=False).ids, t
    for alphabet in ("ab", "etaoin", "a", "é'", "'", "...!"):
        t = "".join(r.choice(alphabet) for _ in range(4000))
        assert ids_of(t) == lib.encode(t, add_special_tokens=False).ids


def peak_mb():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def test_memory_stays_flat():
    text = "words " * 9_000_000  # 54 MB
    sum(map(len, bpe.encode_stream(text[:60_000], WORD)))
    before = peak_mb()
    assert sum(map(len, bpe.encode_stream(text, WORD))) == 4 * 9_000_000
    assert peak_mb() - before < 16
    run = "ab" * 150_000  # one run without an end
    pieces = list(bpe.encode_stream(run, WORD))
    assert len(pieces) > 3
    assert peak_mb() - before < 64


def test_emits_before_the_end(spark, sf_dir):
    """On the given texts: fed symbol by symbol over all words, the transducer gives pieces long before the text ends."""
    table = bpe.merges_of(WORD)
    for row in documents(spark, sf_dir).where("length(text) > 3000").limit(20).collect():
        words = bpe.WORDS.findall(bpe.lower_form(row["text"]))
        drawn = 0

        def symbols():
            nonlocal drawn
            for w in words:
                for s in table.symbols(w):
                    drawn += 1
                    yield s

        lag, ids, total = [], [], sum(len(w.encode()) for w in words)
        for i in bpe.transduce(symbols(), table):
            ids.append(i)
            lag.append(drawn)
        assert ids == ids_of(row["text"])
        assert lag[0] < 100 < total / 4 and lag[len(lag) // 2] < 0.75 * total


def test_lookahead_on_strings_of_pieces(monkeypatch):
    """With early emission at the bound itself, on strings of merge pieces: the same as the whole."""
    table, r = bpe.merges_of(WORD), random.Random(3)
    plain = [p for p in table.vocab if not p.endswith(table.end) and p not in table.special and len(p) > 1]
    for _ in range(3):
        sym = [table.vocab[c] for p in r.choices(plain, k=3 * table.lookahead // 5) for c in p if c in table.vocab]
        assert list(bpe.transduce(sym, table)) == bpe.settle(list(sym), table)


def test_outputs(spark):
    rows = [(1, "Naïve Café, it's 12 o'clock..."), (2, None), (3, ""), (None, "x"), (1, "Naïve Café, it's 12 o'clock...")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lib = library()
    got = bpe.bpe_stream(df, WORD).collect()
    assert len(got) == len(rows)
    for row in got:
        text = next((t or "") for i, t in rows if i == row["doc_id"])
        want = lib.encode(text, add_special_tokens=False).ids
        assert (row["ids"], row["n_tokens"], row["decoded"]) == (want, len(want), lib.decode(want, skip_special_tokens=False))
        assert row["n_restored"] == len(bpe.TextStream(bpe.merges_of(WORD)).bytes_text(want))
