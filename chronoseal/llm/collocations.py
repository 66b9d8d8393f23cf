"""Phrase collocation mining over a prefix-free parse.

Texts are parsed into overlapping chunks: a chunk ends where the hash of ``OVERLAP`` consecutive words hits a trigger value and
the next chunk starts with those words. The same passage therefore gives the same chunks in every document. The different
chunks of a language with their frequencies form a dictionary, and all n-grams are counted in the dictionary, weighted with the
frequency, instead of in the texts. An n-gram belongs to the chunk in whose own part (without the words that the next
chunk repeats) it starts, so the overlaps count once; the repeated words let it end there.

Counts are exact. All parts of a phrase are at least as frequent as the phrase, so the dictionary is read three times: words;
hashes of pairs of frequent words; phrases of two words or more whose pairs all have frequent hashes. What is frequent reaches
the tasks as a Bloom filter of at most ``2 ** MOST_BITS`` bits: it never misses a frequent phrase, and a false alarm
only adds a row to a count that is then found too low. Counts that go into the result compare words and phrases as text,
never by hash. Rows are combined in the task before each shuffle, so a phrase that makes up a third of a corpus is one
row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import stored

LEAST_COUNT = 100
LONGEST = 5
TOP = 2_000
PARTS = 64
OVERLAP = LONGEST - 1
CHUNK_WORDS = 64
MOST_WORDS = 1 << 10
MOST_BITS = 27
BITMAP = 1 << 15
SLICE = 1 << 20
_U = np.uint64
_BLANK, _BREAK = 0x20, 0x0A
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_IN_WORD = ~_STOP
_IN_WORD[[0x20, 0x09]] = False


def _chunk_starts(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Flags of the words that start a chunk; ``bounds`` are the word ranges of the texts.

    Windows equal to the one before them trigger nothing, so that one word repeated makes long chunks; a chunk's own part
    has at most ``MOST_WORDS`` words.
    """
    n = len(hashes)
    flags = np.zeros(n, bool)
    if n >= OVERLAP:
        table = A.powers(OVERLAP + 1)
        window = np.zeros(n - OVERLAP + 1, _U)
        for k in range(OVERLAP):
            window += hashes[k : n - OVERLAP + 1 + k] * table[k + 1]
        trigger = A.mix(window) % _U(CHUNK_WORDS) == 0
        trigger[1:] &= window[1:] != window[:-1]
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        flags[: len(window)] = trigger & (text[: len(window)] == text[OVERLAP - 1 :])
    flags[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.arange(n)
    return flags | ((at - np.maximum.accumulate(np.where(flags, at, 0))) % MOST_WORDS == 0)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of whole texts: words joined by a space, or a line feed where a piece ends; ``core`` is the chunk's own part."""
    for batch in batches:
        data, offsets = A.utf8(batch.column(1))
        for i, j in A.slices(offsets, SLICE):
            lower, bounds = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
            starts, ends = A.runs(_IN_WORD[lower], bounds)
            if not len(starts):
                continue
            sizes = ends - starts
            text_words = np.searchsorted(starts, bounds)
            stops = np.concatenate(([0], np.cumsum(_STOP[lower])))
            # Words of the slice with one separator after each.
            placed = np.cumsum(sizes + 1) - sizes - 1
            joined = np.full(int(sizes.sum()) + len(sizes), _BLANK, np.uint8)
            joined[A.ragged(placed, sizes)] = lower[A.ragged(starts, sizes)]
            split = np.flatnonzero(stops[starts[1:]] != stops[ends[:-1]])
            joined[placed[split] + sizes[split]] = _BREAK
            first = np.flatnonzero(_chunk_starts(A.span_hashes(lower, starts, sizes), text_words))
            core = np.diff(first, append=len(starts))
            text = np.searchsorted(text_words, first, "right") - 1
            last = np.minimum(first + core + OVERLAP, text_words[text + 1]) - 1
            from_byte, to_byte = placed[first], placed[last] + sizes[last]
            chunk = _strings(joined, from_byte, to_byte - from_byte)
            lang = batch.column(0).slice(i, j - i).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([lang, pa.array(core, pa.int32()), chunk], names=["lang", "core", "chunk"])


def _strings(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[A.ragged(starts, sizes)].tobytes()))


def dictionary(docs: DataFrame) -> DataFrame:
    """The stored dictionary of the parse: ``lang, core, chunk, freq``; a null language is ``und``, a null text has no words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    chunks = rows.mapInArrow(_parse, "lang string, core int, chunk string")
    return stored(chunks.groupBy("lang", "core", "chunk").agg(F.count("*").alias("freq")), "chunks")


class _Chunks:
    """Words of some chunks: exact codes, hashes, and which words start n-grams of their chunk."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.data, offsets = A.utf8(batch.column(2))
        self.starts, self.ends = A.runs((self.data != _BLANK) & (self.data != _BREAK), offsets)
        bounds = np.searchsorted(self.starts, offsets)
        n = np.diff(bounds)
        chunk = np.repeat(np.arange(len(n)), n)
        sizes = self.ends - self.starts
        words = _strings(self.data, self.starts, sizes).dictionary_encode()
        self.code = words.indices.to_numpy().astype(np.int64)
        self.n_codes = len(words.dictionary)
        langs = batch.column(0).dictionary_encode()
        self.lang_names = langs.dictionary
        lang_bytes, lang_offsets = A.utf8(langs.dictionary)
        salt = A.mix(np.array([int(lang_bytes[a:b].astype(np.uint64).dot(A.powers(b - a + 1)[1:])) if b > a else 0 for a, b in zip(lang_offsets, lang_offsets[1:])], _U))
        self.lang = langs.indices.to_numpy()[chunk].astype(np.int64)
        self.salt = salt[self.lang]
        self.hashes = A.span_hashes(self.data, self.starts, sizes)
        self.own = np.arange(len(chunk)) - bounds[:-1][chunk] < batch.column(1).to_numpy()[chunk]
        # Whether a word and the next one stand in one piece of one chunk.
        self.joined = np.zeros(len(chunk), bool)
        self.joined[:-1] = (chunk[1:] == chunk[:-1]) & (self.data[self.ends[:-1]] == _BLANK) if len(chunk) else False
        self.freq = batch.column(3).to_numpy()[chunk]

    def phrase_hashes(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; not meaningful where the phrase leaves its piece."""
        table = A.powers(n + 1)
        padded = np.concatenate((self.hashes, np.zeros(n, _U)))
        return A.mix(sum((padded[k : k + len(self.hashes)] * table[k + 1] for k in range(n)), self.salt + _U(n)))

    def counted(self, at: np.ndarray, ids: np.ndarray, words: int) -> pa.RecordBatch:
        """Weighted counts of the phrases of ``words`` words from the words ``at`` on, which are equal if their ids are."""
        _, first, which = np.unique(ids, return_index=True, return_inverse=True)
        total = np.bincount(which, self.freq[at], minlength=len(first)).astype(np.int64)  # a batch counts far below 2**53
        pick = at[first]
        phrase = _strings(self.data, self.starts[pick], self.ends[pick + words - 1] - self.starts[pick])
        lang = self.lang_names.take(pa.array(self.lang[pick]))
        return pa.RecordBatch.from_arrays([lang, pa.array(np.full(len(pick), words, np.int32)), phrase, pa.array(total)], names=["lang", "words", "phrase", "f"])


COUNTS = "lang string, words int, phrase string, f bigint"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunks]:
    for batch in batches:
        _, offsets = A.utf8(batch.column(2))
        for i, j in A.slices(offsets, SLICE):
            yield _Chunks(batch.slice(i, j - i))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for c in _slices(batches):
        at = np.flatnonzero(c.own)
        if len(at):
            yield c.counted(at, c.lang[at] * c.n_codes + c.code[at], 1)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = _U(len(bits) * 8 - 1)
    first, second = hashes & mask, (hashes >> _U(32)) & mask
    test = lambda at: bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1
    return (test(first) & test(second)).astype(bool)


def _count_pairs(words):
    """Pairs of frequent words by hash: a row takes fewer bytes than the pair as text, and few pairs are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _slices(batches):
            frequent = _passes(words.value, c.phrase_hashes(1))
            at = np.flatnonzero(c.own & c.joined & frequent & np.append(frequent[1:], False))
            pair, which = np.unique(c.phrase_hashes(2)[at], return_inverse=True)
            total = np.bincount(which, c.freq[at], minlength=len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair.view(np.int64)), pa.array(total)], names=["h", "f"])

    return run


def _count_phrases(pairs, longest: int):
    """Phrases of two words or more, as text, whose pairs all pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _slices(batches):
            pair = c.joined & _passes(pairs.value, c.phrase_hashes(2))
            at = np.flatnonzero(c.own & pair)
            ids = c.lang[at] * c.n_codes + c.code[at]
            for n in range(2, longest + 1):
                if n > 2:
                    more = (at + n - 1 < len(c.code)) & pair[np.minimum(at + n - 2, len(pair) - 1)]
                    at, ids = at[more], ids[more]
                if not len(at):
                    break
                _, ids = np.unique(ids * c.n_codes + c.code[at + n - 1], return_inverse=True)
                yield c.counted(at, ids, n)

    return run


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_Chunks(batch).phrase_hashes(1).view(np.int64))], names=["h"])


def hash_filter(hashes: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bloom filter of stored hashes (``h``), two bits a hash, 16 bits of filter a hash if the limit allows.

    What reaches the driver is the filter: at most ``2 ** most_bits`` bits (16 MB)."""
    size = min(1 << most_bits, max(BITMAP, 1 << int(16 * max(1, hashes.count()) - 1).bit_length()))
    mask = F.lit(size - 1).cast("bigint")
    bits = hashes.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("bit"))
    got = bits.groupBy(F.floor(F.col("bit") / BITMAP).cast("int").alias("part")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bitmap")).toArrow()
    out = np.zeros((size // BITMAP, BITMAP // 8), np.uint8)
    for part, bitmap in zip(got.column("part").to_pylist(), got.column("bitmap").to_pylist()):
        out[part] = np.frombuffer(bitmap, np.uint8)
    return out.ravel()


def frequent_phrases(chunks: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST) -> DataFrame:
    """All phrases of 1 to ``longest`` words found at least ``least`` times: ``lang, words, phrase, f``, exact."""
    if longest > OVERLAP + 1:
        raise ValueError(f"phrases of more than {OVERLAP + 1} words need a longer overlap")
    context = chunks.sparkSession.sparkContext
    read = chunks.select("lang", "core", "chunk", "freq")
    enough = F.col("f") >= least
    by_text = lambda count: read.mapInArrow(count, COUNTS).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(enough)
    words = stored(by_text(_count_words), "frequent-words")
    one = words.select("lang", F.lit(1).alias("core"), F.col("phrase").alias("chunk"), F.lit(1).cast("bigint").alias("freq"))
    frequent = context.broadcast(hash_filter(stored(one.mapInArrow(_word_hashes, "h bigint"), "word-hashes")))
    pairs = read.mapInArrow(_count_pairs(frequent), "h bigint, f bigint").groupBy("h").agg(F.sum("f").alias("f")).where(enough)
    chained = context.broadcast(hash_filter(stored(pairs.select("h"), "pair-hashes")))
    return words.unionByName(stored(by_text(_count_phrases(chained, longest)), "frequent-phrases"))


def _part(phrase: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, length), " ")


def _scored(frequent: DataFrame, totals: DataFrame) -> DataFrame:
    """Each phrase of two words or more with its lowest-scoring cut; the numbers stay exact in decimals."""
    longer = frequent.where("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"))
    cut = longer.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cut = cut.withColumn("first", _part(F.col("phrase"), 1, F.col("k"))).withColumn("rest", _part(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")))
    left = frequent.select(F.col("lang"), F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = frequent.select(F.col("lang"), F.col("phrase").alias("rest"), F.col("f").alias("r"))
    # Languages are few: one total each.
    both = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(a as decimal(18,0)) * (cast(n as decimal(18,0)) * 1000BD)) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    lowest = both.withColumn("score", score).groupBy("lang", "words", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return lowest.select("lang", "words", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _contained(frequent: DataFrame) -> DataFrame:
    """Phrases inside a longer one (``lang, phrase``), with the highest count among the longer ones."""
    starts = F.explode(F.sequence(F.lit(1), F.col("words") - F.col("inner") + 1))
    inside = frequent.where("words > 2").withColumn("inner", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("start", starts)
    inside = inside.select("lang", _part(F.col("phrase"), F.col("start"), F.col("inner")).alias("phrase"), F.col("f"))
    return inside.groupBy("lang", "phrase").agg(F.max("f").alias("outer_f"))


def collocations(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` has ``lang`` and ``text``; further columns are not read. A phrase has 2 to ``longest`` words of one piece and
    ``a >= least`` occurrences. A phrase inside a longer one with as many occurrences is dropped. ``l`` and ``r`` count
    the two parts of the cut with the lowest score ``floor(1000 a n / (l r))`` (ties: the first part is shorter); ``n`` counts
    all words of the language.

    A null language is ``und``. Null, empty and wordless texts add nothing. Repeated rows count each time. Ties in the ranking go by count and phrase.
    An empty table gives an empty table.
    """
    chunks = dictionary(docs)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("core") * F.col("freq")).alias("n"))
    frequent = stored(frequent_phrases(chunks, least, longest), "counts")
    scored = _scored(frequent, stored(totals, "totals")).join(_contained(frequent), ["lang", "phrase"], "left")
    open_phrases = scored.where("outer_f IS NULL OR outer_f < a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The last window of a language reads at most PARTS * top rows, whatever the number of tasks.
    parts = open_phrases.withColumn("__part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    best = parts.withColumn("rank", F.row_number().over(W.partitionBy("lang", "__part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: DuckDB SQL of the query over ``documents``.
SQL = """WITH p AS MATERIALIZED (SELECT lang, piece, regexp_extract_all(piece, '[^ \\t]+') AS w FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    g AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM (
      SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest(range(1, 6)) AS m FROM p) WHERE len(w) >= m)),
    t AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY ALL HAVING count(*) >= 100),
    c AS (SELECT lang, m, phrase, f AS a, w, unnest(range(1, m)) AS k FROM f WHERE m > 1),
    s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, k, (1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f) AS score
      FROM c JOIN t USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1:c.m], ' ')),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, array_to_string(w[st:st + q - 1], ' ') AS phrase, max(f) AS outer_f FROM (
      SELECT lang, w, q, f, unnest(range(1, m - q + 2)) AS st FROM (SELECT *, unnest(range(2, m)) AS q FROM f WHERE m > 2)) GROUP BY ALL),
    o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE outer_f IS NULL OR outer_f < a)
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000"""
