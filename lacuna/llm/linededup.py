"""Fuzzy line dedup with DataFrame functions only: SimHash, pigeonhole blocks, edit similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import components, cut, join_keys

#: Blocks of a line: at most this many, of consecutive features in a fixed order.
BLOCKS = 7
#: Words of more characters than this are features, if there are three of them; else all words are.
SHORT = 3
#: Lines of a bucket that meet at once.
TILE = 512


#: Set in the features of words that aren't longer than SHORT; bits of a feature that tell words apart, below those of its order.
LOW, OWN = 1 << 62, 40


#: What a line must hold to take part.
KEPT = r"[\p{L}\p{M}\p{N}]"


def normal(text: Column) -> Column:
    """Lower case, everything but letters, combining marks, digits and line feeds a space; lines are trimmed after
    the split. Lines that differ in case and symbols only are thus equal."""
    other = r"[^\p{L}\p{M}\p{N}\n]"
    # a single space, as most are, is no match: what replaces it would be the same
    return F.regexp_replace(F.lower(text), rf"{other}(?:(?<! )|(?={other})){other}*", " ")


def simhash(*features: Column) -> Column:
    """The bits that most of two or three equally weighted features have; of two, those that both have."""
    if len(features) == 2:
        return features[0].bitwiseAND(features[1])
    a, b, c = features
    return a.bitwiseAND(b).bitwiseOR(a.bitwiseAND(c)).bitwiseOR(b.bitwiseAND(c))


def block_keys(order: str, wide: int) -> Column:
    """Keys of a line from the column of its features (longs in ascending order): each `wide` consecutive ones of the
    first are a block, and a block's SimHash is a key. A line of fewer features is one block."""
    n, f = F.size(order), F.col(order)
    at = F.sequence(F.lit(0), F.least(n, F.lit(BLOCKS + wide - 1)) - wide)
    blocks = F.transform(at, lambda i: F.xxhash64(F.lit(wide), simhash(*[f[i + j] for j in range(wide)])))
    return F.when(n >= wide, blocks).otherwise(F.array(F.xxhash64(f)))


def word_keys(order: str, wide: int) -> Column:
    """The same for lines of `wide` features at least, as most are: written out, since Spark compiles no lambdas."""
    f = F.col(order)
    blocks = F.array(*[F.xxhash64(F.lit(wide), simhash(*[F.get(f, F.lit(i + j)) for j in range(wide)])) for i in range(BLOCKS)])
    return F.slice(blocks, F.lit(1), F.least(F.size(order) - (wide - 1), F.lit(BLOCKS)))


def keys(lines: DataFrame) -> DataFrame:
    """(h, norm) -> (h, n, key): the block keys of lines in normal form, n the line's length.

    Features are word hashes in an order drawn by the hash, in which longer words come earlier by chance only (a word's place is -ln(u) / the root of its length,
    u its hash as a fraction): so the first ones stand for the whole line, its short own words as well as long words
    that a template repeats, and an edit leaves the order of all others as it is. So one replaced word (or letter) touches at most the 2 * wide - 1
    blocks that one word's removal and another's insertion break; the pigeonholes of the others stay. Lines of few
    words have blocks of two, and of fewer still, of character n-grams; around each change lines have both kinds.
    All this depends on the line alone.
    """
    # step by step, so that nothing is worked out twice; a feature is the word's place in its top bits, its hash below
    def ranked(w: Column, low: int) -> Column:
        h = F.xxhash64(w)
        u = (F.shiftrightunsigned(h, 11) + 1) * (2.0**-53)
        place = F.floor(F.log(u) / F.sqrt(F.length(w)) * -float(1 << 16))  # below 1 << 22, as u is at least 2 ** -53
        rank = F.shiftleft(place, OWN).bitwiseOR(h.bitwiseAND(F.lit((1 << OWN) - 1)))
        return rank.bitwiseOR(F.lit(low)) if low else rank

    def first(words: Column, rank) -> Column:
        return F.slice(F.sort_array(F.array_distinct(F.transform(words, rank))), 1, BLOCKS + 2)

    # short words get their places only in lines of fewer than three longer ones
    words = F.split("norm", " ")
    rows = lines.select("h", "norm", first(F.filter(words, lambda w: F.length(w) > SHORT), lambda w: ranked(w, 0)).alias("long"))
    every = first(words, lambda w: F.when(F.length(w) > SHORT, ranked(w, 0)).otherwise(ranked(w, LOW)))
    rows = rows.select("h", "norm", F.when(F.size("long") >= 3, F.col("long")).otherwise(every).alias("f"))
    rows = rows.select("h", F.length("norm").alias("n"), "f", F.when(F.size("f") < 5, F.split(F.concat(F.lit(" "), "norm", F.lit(" ")), "")).alias("c"))

    def grams(k: int) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size("c") - k, F.lit(0)))
        return F.sort_array(F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[F.coalesce(F.get("c", i + j), F.lit("")) for j in range(k)]))))

    rows = rows.select("h", "n", "f", F.when(F.size("c") < 20, grams(3)).alias("g3"), F.when(F.size("c") >= 16, grams(4)).alias("g4"))
    n, none = F.size("f"), F.expr("cast(array() as array<bigint>)")
    parts = [((n >= 3) & (n < 9), word_keys("f", 2)), (n >= 7, word_keys("f", 3)), (F.col("g3").isNotNull(), block_keys("g3", 2)), (F.col("g4").isNotNull(), block_keys("g4", 3))]
    rows = rows.select("h", "n", F.array_distinct(F.concat(*[F.when(when, x).otherwise(none) for when, x in parts])).alias("keys"))
    return rows.select("h", "n", F.explode_outer("keys").alias("key"))  # none is empty; to explode() Spark adds a filter that works out all of this again


def lines_of(rows: DataFrame) -> DataFrame:
    """(h, o, x, pos, norm): lines whose normal form isn't empty, h its hash; o and x tell rows apart."""
    lines = rows.select("o", "x", F.posexplode(F.split(normal(F.col("text")), "\n", -1)).alias("pos", "line"))
    lines = lines.select("o", "x", "pos", F.trim("line").alias("norm")).where("norm <> ''")
    return lines.select(F.xxhash64("norm", F.length("norm")).alias("h"), "o", "x", "pos", "norm")


#: Lines longer than this are compared word by word, shorter ones character by character.
LONG = 400
#: Long lines whose words have so many characters on average (CJK, base64, minified code) are compared character by character, if both have the
#: first number and one the second.
DENSE, DENSEST = 8, 12
#: Beyond this length dense lines are compared by pieces of some characters, which end at certain characters wherever these stand.
HUGE = 20_000
#: Ends of pieces: about every sixth character of most scripts.
ENDS = r"(?<=[aeo05\u0430\u043e\u0627\u0644\u0915\u0930\u0e01\u0e23\u3042-\u3046\u3099-\u309f\u30a2-\u30a6" + "".join(f"\\u{c:04x}-\\u{c + 20:04x}" for c in range(0x4E00, 0x9F80, 128)) + "".join(f"\\u{c:04x}-\\u{c + 20:04x}" for c in range(0xAC00, 0xD780, 128)) + "])"


#: Characters left out of a line's core, the short form that is compared before the whole line.
COMMON = " aeion"


def words_of(norm: Column) -> Column:
    """How many words a line has, if it is so long that this matters."""
    n = F.length(norm)
    return F.when(n > LONG / 1.25, n - F.length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def forms(norm: Column, words: Column | None = None) -> list[Column]:
    """What the comparison needs of a line: its length, whether it is dense; its characters and its core if they may be compared; its words and,
    of long dense lines, its pieces, one character each, if these may be. A word's character is drawn by its hash
    from 40,000 code points (U+3400 on, none of them a surrogate). words: a column of `words_of`, if there is one."""
    one = lambda w: F.hex(F.lit(0x3400) + F.pmod(F.xxhash64(w), F.lit(40000)))  # noqa: E731  always four digits
    coded = lambda parts: F.decode(F.unhex(F.array_join(F.transform(parts, one), "")), "UTF-16BE")
    n, words = F.length(norm), words_of(norm) if words is None else words
    dense = (n > LONG / 1.25) & (n > DENSE * words)
    chars = (n <= LONG * 1.25) | (dense & (n <= HUGE * 1.25))
    return [
        F.when(chars, F.translate(norm, COMMON, "")).alias("core"), n.alias("n"), dense.alias("dense"), (dense & (n > DENSEST * words)).alias("densest"), F.when(chars, norm).alias("chars"),
        F.when(n > LONG / 1.25, coded(F.split(norm, " "))).alias("words"), F.when(dense & (n > HUGE / 1.25), coded(F.split(norm, ENDS))).alias("pieces"),
    ]


def comparable(a: str, b: str, least: float) -> Column:
    """Lengths with which `similar` can hold."""
    return F.least(a, b) >= least * F.greatest(a, b) - 1e-9


def similar(least: float) -> Column:
    """1 - edit distance / longer length >= least, in characters, but in words if the longer line has more than LONG characters
    and isn't dense, and in pieces if it is dense and has more than HUGE; the distance is followed only as far as that
    allows. Lengths must agree as far."""

    def within(unit: str) -> str:
        most = f"cast(floor(greatest(length(a_{unit}), length(b_{unit})) * {round(1 - least, 6)} + 1e-9) as int)"
        return f"levenshtein(a_{unit}, b_{unit}, {most}) >= 0"

    # each edit of the lines is at most one of their cores, so these, shorter, can't be further apart
    most = f"cast(floor(greatest(a_n, b_n) * {round(1 - least, 6)} + 1e-9) as int)"
    chars = f"(levenshtein(a_core, b_core, {most}) >= 0 and {within('chars')})"
    return F.expr(f"least(a_n, b_n) >= {least} * greatest(a_n, b_n) - 1e-9 and case when greatest(a_n, b_n) > {LONG} and not (a_dense and b_dense and (a_densest or b_densest)) then {within('words')} when greatest(a_n, b_n) > {HUGE} then {within('pieces')} else {chars} end")


def each_once(lines: DataFrame) -> DataFrame:
    """lines_of -> (h, norm, k): each normal form once, k where it occurs first. Repeats meet in their own task before anything
    is dealt, so a line that is in very many documents fills no task."""
    return lines.groupBy("h").agg(F.first("norm").alias("norm"), F.min(F.struct(F.col("o").isNull().alias("none"), "o", "x", "pos")).alias("k"))


def bucketed(keyed: DataFrame) -> DataFrame:
    """(h, n, key), each once -> (key, h, n, head, head_n): the lines of each bucket of two or more but its smallest, the head.
    One shuffle, whatever the size; a bucket is sorted, spilling if it must, never held whole."""
    by = Window.partitionBy("key").orderBy("h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumns({"head": F.first("h").over(by), "head_n": F.first("n").over(by)})
    return out.where("h <> head").select("key", "h", "n", "head", "head_n")


def apart(buckets: DataFrame, root: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b): of each bucket's lines but its head, which has met them all, all pairs that are in different components of root
    (node, root) and similar, each pair once, in the smallest of the buckets that both are in.

    A bucket is dealt by length into tiles of TILE lines, and tiles whose lengths can't agree don't meet. Pairs are compared where
    two tiles meet, with texts (h, forms...), so that only similar ones are rows: no task takes a bucket whole, what is shuffled are lines, and
    lines that are connected already aren't compared."""
    w = Window.partitionBy("key")
    own = buckets.where("h <> head").select("key", "h", "n").join(root, F.col("h") == F.col("node"), "left").select("key", "h", "n", F.coalesce("root", "h").alias("root"))
    own = own.withColumns({"_lo": F.min("root").over(w), "_hi": F.max("root").over(w), "_no": F.row_number().over(w.orderBy("n", "h")) - 1}).where("_lo <> _hi")
    own = cut(own.select("key", F.floor(F.col("_no") / TILE).alias("tile"), "h", "n", "root"))
    tiles = own.groupBy("key", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    side = lambda df, k: df.select("key", *[F.col(c).alias(f"{k}_{c}") for c in df.columns if c != "key"])
    meet = side(tiles, "a").join(side(tiles, "b"), "key").where((F.col("a_tile") == F.col("b_tile")) | (F.col("a_tile") < F.col("b_tile")) & comparable("a_hi", "b_lo", least))
    of = own.groupBy("h").agg(F.collect_list("key").alias("keys"))  # at most as many as a line has blocks
    full = own.drop("n").hint("shuffle_merge").join(texts, "h").hint("shuffle_merge").join(of, "h")
    pairs = meet.select("key", "a_tile", "b_tile").hint("shuffle_merge").join(side(full, "a"), ["key", "a_tile"]).hint("shuffle_merge").join(side(full, "b"), ["key", "b_tile"])
    pairs = pairs.where("a_root <> b_root and (a_tile < b_tile or a_h < b_h)").where(comparable("a_n", "b_n", least))
    pairs = pairs.where("key = array_min(array_intersect(a_keys, b_keys))").where(similar(least))
    return pairs.select(F.col("a_h").alias("a"), F.col("b_h").alias("b"))


def fuzzy_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, stay): rows has (o: the id, x: a digest of the text, text, more: the other columns), stay (o, x, pos): the
    one occurrence of each connected group of lines, the first by id, digest and place. See dedup_lines.
    """
    others = [F.col(c) for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(F.col(id_col).alias("o"), F.xxhash64(text_col).alias("x"), F.col(text_col).alias("text"), F.struct(*others).alias("more") if others else F.lit(None).alias("more"))
    lines = cut(each_once(lines_of(rows.where("text is not null"))).select("h", "norm", "k"))
    buckets = cut(bucketed(keys(lines.select("h", "norm"))))
    # the texts of lines that share a key with another, read once for both rounds
    among = buckets.select("h").unionByName(buckets.select(F.col("head").alias("h"))).distinct()
    texts = lines.select("h", "norm").hint("shuffle_merge").join(among, "h", "left_semi")
    texts = cut(texts.select("h", "norm", words_of(F.col("norm")).alias("words")).select("h", *forms(F.col("norm"), F.col("words"))))

    side = lambda k: texts.select(F.col("h").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in texts.columns if c != "h"])
    # every member against its bucket's smallest
    stars = buckets.where(comparable("head_n", "n", least)).select(F.col("head").alias("a"), F.col("h").alias("b")).distinct()
    like = cut(stars.hint("shuffle_merge").join(side("a"), "a").hint("shuffle_merge").join(side("b"), "b").where(similar(least)).select("a", "b"))
    # where these links, of whatever bucket, leave members of a bucket unconnected, all its pairs that are apart are compared
    root = components(like.select(F.col("a").alias("u"), F.col("b").alias("v")))
    more = cut(apart(buckets, root, texts, least))
    # a line and its root stand for the first links
    group = components(root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    group = cut(group.unionByName(group.select(F.col("root").alias("node"), "root").distinct()).distinct())
    alone = lines.select("h", "k").join(group, F.col("h") == F.col("node"), "left_anti").select("k")
    first = lines.select("h", "k").join(group, F.col("h") == F.col("node")).groupBy("root").agg(F.min("k").alias("k")).select("k")
    return rows, alone.unionByName(first).select("k.o", "k.x", "k.pos")


def dedup_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, more, n_lines, n_kept, text_out) of every row: text_out holds the lines that stay, more
    the other columns of docs as a struct.

    Lines (split at line feeds) are compared in normal form; lines whose normal form is empty (blank,
    punctuation) always stay and count in neither number. Equal forms are one line from the start. Others
    are linked if they share the SimHash of a block (see `keys`) and their edit similarity is at least `least` (in
    words for lines over LONG characters, if they have spaces). Of each connected group the first occurrence stays, by doc_id, then text,
    then place.

    A bucket's lines are each compared with its smallest; where these links leave lines of a bucket unconnected, all pairs of it
    that are apart are compared (`apart`). So no pair that shares a key is left out, and like lines that share one cost rows
    in proportion to their number; of unlike ones the comparisons grow with the square of a bucket, in tiles, the rows don't. A pair
    that shares no key is not found (part of the recall in the README). Lines that
    occur in very many documents are one row with one kept place and are never joined back by their hash.

    Null text stays null with 0 lines. Repeated rows (same id and text) come back alike, with the same kept
    lines. Ids may be of any type that has an order; null ids order last. Texts of any length are worked on whole.
    """
    rows, stay = fuzzy_lines(docs, least, id_col, text_col)
    kept = stay.groupBy("o", "x").agg(F.array_sort(F.collect_list("pos")).alias("kept"))  # lines of one document
    rows = join_keys(rows, cut(kept), ["o", "x"], "left").withColumn("kept", F.coalesce("kept", F.expr("cast(array() as array<int>)")))
    # a flag for each line up to the last that stays, from the gaps between their places
    before = F.concat(F.array(F.lit(-1)), "kept")
    flags = F.flatten(F.zip_with("kept", F.slice(before, F.lit(1), F.size("kept")), lambda k, p: F.concat(F.array_repeat(F.lit(False), k - p - 1), F.array(F.lit(True)))))
    lines = F.zip_with(F.split("text", "\n", -1), flags, lambda x, k: F.struct(x.alias("x"), (~x.rlike(KEPT)).alias("blank"), F.coalesce(k, F.lit(False)).alias("kept")))
    rows = rows.withColumn("_l", lines)
    out = F.array_join(F.transform(F.filter("_l", lambda s: s["blank"] | s["kept"]), lambda s: s["x"]), "\n")
    n = F.coalesce(F.size(F.filter("_l", lambda s: ~s["blank"])), F.lit(0))
    return rows.select(F.col("o").alias("doc_id"), "text", "more", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"), F.size("kept").cast("long").alias("n_kept"), F.when(F.col("text").isNotNull(), out).alias("text_out"))


def keep_first_lines(docs: DataFrame, **settings) -> DataFrame:
    """docs (doc_id, text, n_chars, ...) with only the lines that stay. A document goes only if it has lines and
    none of them stays, so no line goes whose kept occurrence isn't in the output. Columns are those of docs;
    n_chars, where there is one, is the new length."""
    out = dedup_lines(docs, **settings)
    out = out.where(F.col("text").isNull() | (F.col("n_lines") == 0) | (F.col("n_kept") > 0))
    pick = {"doc_id": F.col("doc_id"), "text": F.col("text_out"), "n_chars": F.length("text_out").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[pick.get(c, F.col("more").getField(c) if c not in pick else None).alias(c) for c in docs.columns])
