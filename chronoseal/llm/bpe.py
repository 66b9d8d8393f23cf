"""Byte-level BPE encoding and decoding with a minimal acyclic transducer over the frequent words.

The words of all texts are counted. The frequent ones, at most ``LEXICON_WORDS``, are merged once and compiled into
a minimal acyclic automaton: words share prefixes and suffixes, and each path adds up to the number of its word, which
points at the ids. The automaton is one file in the shared folder; every executor fetches it once and all its
Python workers map the same pages. Words that the automaton lacks are merged exactly, many at a time.

The lexicon only saves work: any lexicon gives the same ids. The driver holds at most ``LEXICON_WORDS`` words.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import shared_path, stored
from .hashtable import EMPTY, HashMap, find, place
from .pretokens import split

LEXICON_WORDS = 100_000
COUNT_BYTES = 1 << 24
LONG_WORD = 512
_NONE = np.int64(1) << 62


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Merges:
    """Vocabulary and merge ranks of a tokenizer file, with exact merging of many words at once."""

    def __init__(self, config: str) -> None:
        model = json.loads(config)
        vocab = model["model"]["vocab"]
        of_letter = {letter: b for b, letter in enumerate(byte_letters())}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"] if t["special"] or t["content"]}
        self.first = np.array([vocab[letter] for letter in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.pairs: dict[int, int] = {}
        self.ranks = HashMap(17)
        self.ranks.add((left << np.uint64(32)) | right, np.arange(len(pairs)))
        texts = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            texts[i] = bytes(of_letter[c] for c in token)
        for token, i in self.special.items():
            texts[i] = token.encode()
        self.token_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.token_sizes = np.array([len(t) for t in texts], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        got = self.ranks.get((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        return np.where(got >= 0, got, _NONE)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of one long word: neighbours in a linked list, pairs in a heap by rank and position, n log n in its length."""
        if not self.pairs:
            held = self.ranks.keys != EMPTY
            self.pairs.update(zip(self.ranks.keys[held].tolist(), self.ranks.values[held].tolist()))
        n, rank_of, merged = len(symbols), self.pairs.get, self.merged.tolist()
        first = self._rank(symbols[:-1], symbols[1:])
        at = np.flatnonzero(first < _NONE)
        heap = ((first[at] << np.int64(32)) | at).tolist()
        heapq.heapify(heap)
        ids, rank = symbols.tolist(), np.append(np.where(first < _NONE, first, -1), -1).tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            key = heapq.heappop(heap)
            r, i = key >> 32, key & 0xFFFFFFFF
            if rank[i] != r:
                continue  # a neighbour was merged since
            gone = after[i]
            ids[i], ids[gone], rank[gone] = merged[r], -1, -1
            right = after[i] = after[gone]
            rank[i] = -1
            if right < n:
                before[right] = i
                found = rank_of(ids[i] << 32 | ids[right], -1)
                if found >= 0:
                    rank[i] = found
                    heapq.heappush(heap, found << 32 | i)
            left = before[i]
            if left >= 0:
                rank[left] = found = rank_of(ids[left] << 32 | ids[i], -1)
                if found >= 0:
                    heapq.heappush(heap, found << 32 | left)
        out = np.array(ids, np.int64)
        return out[out >= 0]

    def merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and id counts of words: the pair of lowest rank, leftmost, is merged until no pair is left."""
        long = np.flatnonzero(sizes > LONG_WORD)
        if not len(long):
            return self._merge_short(data, starts, sizes)
        short = np.flatnonzero(sizes <= LONG_WORD)
        ids, counts = self._merge_short(data, starts[short], sizes[short])
        alone = [self.merge_long(self.first[data[starts[i] : starts[i] + sizes[i]]]) for i in long]
        every, n = np.concatenate((ids, *alone)), np.concatenate((counts, [len(a) for a in alone])).astype(np.int64)
        order = np.argsort(np.concatenate((short, long)))
        begin = np.cumsum(n) - n
        return every[A.ragged(begin[order], n[order])], n[order]

    def _merge_short(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Many words at once, one merge a word and round."""
        words = len(starts)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        symbols = self.first[data[A.ragged(starts, sizes)]]
        word = np.repeat(np.arange(words), sizes)
        rank = np.full(len(symbols), _NONE)
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = self._rank(symbols[same], symbols[same + 1])
        done_ids, done_words = [], []
        while len(symbols):
            heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            lengths = np.diff(heads, append=len(word))
            # The rank leads, then the position: the minimum is the leftmost pair of the lowest rank.
            key = np.where(rank < _NONE, (rank << np.int64(32)) + np.arange(len(rank)), _NONE)
            best = np.minimum.reduceat(key, heads)
            open_ = best < _NONE
            if not open_.all():
                rest = np.repeat(open_, lengths)
                done_ids.append(symbols[~rest])
                done_words.append(word[~rest])
                shift = np.cumsum(~rest)
                at = (best[open_] & np.int64(0xFFFFFFFF)) - shift[best[open_] & np.int64(0xFFFFFFFF)]
                symbols, word, rank = symbols[rest], word[rest], rank[rest]
            else:
                at = best & np.int64(0xFFFFFFFF)
            if not len(symbols):
                break
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one symbol goes in each earlier word
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            rank[at] = _NONE
            for left in (at[at > 0] - 1, at[at + 1 < len(word)]):
                left = left[word[left] == word[left + 1]]
                rank[left] = self._rank(symbols[left], symbols[left + 1])
        ids, owner = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=words)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of ids, one after the other, and the number of bytes of each id."""
        sizes = self.token_sizes[ids]
        return self.token_bytes[A.ragged(self.token_starts[ids], sizes)], sizes


def compile_lexicon(words: list[bytes], merges: Merges) -> bytes:
    """Minimal acyclic automaton of different words, with their ids, as one mappable block of bytes.

    Words are added in order; the states of a path that can no longer grow are replaced by equal known states.
    """
    words = sorted(words)
    known: dict[tuple, int] = {}
    finals, arcs = [], []  # of finished states

    def finish(final: bool, out: list[tuple[int, int]]) -> int:
        signature = (final, tuple(out))
        if signature not in known:
            known[signature] = len(finals)
            finals.append(final)
            arcs.append(out)
        return known[signature]

    path: list[list] = [[False, [], -1]]  # final, arcs, byte that leads here
    previous = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, out, byte = path.pop()
            path[-1][1].append((byte, finish(final, out)))

    for w in words:
        common = 0
        while common < min(len(w), len(previous)) and w[common] == previous[common]:
            common += 1
        close(common)
        for byte in w[common:]:
            path.append([False, [], byte])
        path[-1][0] = True
        previous = w
    close(0)
    root = finish(path[0][0], path[0][1])
    # Words below each state; targets are finished before the states that point at them.
    below = np.zeros(len(finals), np.int64)
    keys, targets, skips = [], [], []
    for s, out in enumerate(arcs):
        passed = int(finals[s])
        for byte, target in out:
            keys.append(s << 8 | byte)
            targets.append(target)
            skips.append(passed)
            passed += int(below[target])
        below[s] = passed
    bits = max(4, int(3 * len(keys)).bit_length())
    table = np.full(1 << bits, EMPTY)
    slots = place(table, bits, np.array(keys, np.uint64))
    target, skip = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    target[slots], skip[slots] = targets, skips
    sizes = np.array([len(w) for w in words], np.int64)
    ids, counts = merges.merge(np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes) - sizes, sizes)
    parts = {
        "table": table, "target": target, "skip": skip, "final": np.array(finals, np.uint8),
        "ids": ids.astype(np.int32), "counts": counts.astype(np.int32),
    }
    head, blob, at = {"bits": bits, "root": root, "states": len(finals)}, [], 0
    for name, values in parts.items():
        raw = values.tobytes() + b"\0" * (-values.nbytes % 8)
        head[name] = [at, len(values), values.dtype.str]
        blob.append(raw)
        at += len(raw)
    top = json.dumps(head).encode()
    return len(top).to_bytes(8, "little") + top + b" " * (-len(top) % 8) + b"".join(blob)


class Lexicon:
    """Compiled lexicon, mapped from a file or held as bytes."""

    def __init__(self, source: str | bytes) -> None:
        raw = np.memmap(source, np.uint8, "r") if isinstance(source, str) else np.frombuffer(source, np.uint8)
        size = int.from_bytes(raw[:8].tobytes(), "little")
        self.head = head = json.loads(raw[8 : 8 + size].tobytes())
        base = 8 + size + (-size % 8)

        def part(name: str) -> np.ndarray:
            at, n, kind = head[name]
            return raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind)

        self.table, self.target, self.skip, self.final = part("table"), part("target"), part("skip"), part("final")
        self.ids, self.counts = part("ids"), part("counts").astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Number of each word; -1 for words that are not in the lexicon. All words walk one byte at a time."""
        out = np.full(len(starts), -1, np.int64)
        rows = np.arange(len(starts))
        state = np.full(len(starts), self.head["root"], np.int64)
        number = np.zeros(len(starts), np.int64)
        step = 0
        while len(rows):
            ended = sizes[rows] == step
            if ended.any():
                accepted = ended & (self.final[state] == 1)
                out[rows[accepted]] = number[accepted]
                rows, state, number = rows[~ended], state[~ended], number[~ended]
                if not len(rows):
                    break
            key = (state.astype(np.uint64) << np.uint64(8)) | data[starts[rows] + step]
            slots = find(self.table, self.head["bits"], key)
            known = slots >= 0
            slots, rows = slots[known], rows[known]
            state, number = self.target[slots].astype(np.int64), number[known] + self.skip[slots]
            step += 1
        return out


@dataclass(frozen=True)
class Codec:
    """What a task needs: the tokenizer file's text (broadcast) and the name of the lexicon file."""

    config: object
    lexicon: str

    def open(self) -> tuple[Merges, Lexicon]:
        if self.lexicon not in _OPEN:
            _OPEN.clear()
            _OPEN[self.lexicon] = (Merges(self.config.value), Lexicon(SparkFiles.get(self.lexicon)))
        return _OPEN[self.lexicon]


_OPEN: dict[str, tuple[Merges, Lexicon]] = {}


def special_spans(data: np.ndarray, offsets: np.ndarray, specials: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and ids of special tokens that stand inside one text."""
    raw = data.tobytes()
    found = []
    for token, number in specials.items():
        mark, at = token.encode(), raw.find(token.encode())
        while at >= 0:
            inside = np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, at + len(mark), "left")
            if inside:
                found.append((at, at + len(mark), number))
            at = raw.find(mark, at + (len(mark) if inside else 1))
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def cut_words(data: np.ndarray, offsets: np.ndarray, specials: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and sizes of the words of some texts, and the id of those that are special tokens (else -1)."""
    first, last, number = special_spans(data, offsets, specials)
    starts, sizes = split(data, np.concatenate((offsets, first, last)) if len(first) else offsets)
    special = np.full(len(starts), -1, np.int64)
    if len(first):
        span = np.searchsorted(first, starts, "right") - 1
        inside = (span >= 0) & (starts < last[np.maximum(span, 0)])
        lead = inside & (starts == first[np.maximum(span, 0)])
        special[lead] = number[span[lead]]
        sizes = np.where(lead, (last - first)[np.maximum(span, 0)], sizes)
        keep = ~inside | lead
        starts, sizes, special = starts[keep], sizes[keep], special[keep]
    return starts, sizes, special


def encode(data: np.ndarray, offsets: np.ndarray, merges: Merges, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some texts, one after the other, and the number of ids of each text."""
    starts, sizes, special = cut_words(data, offsets, merges.special)
    number = lexicon.numbers(data, starts, sizes)
    counts = np.where(number >= 0, lexicon.counts[number] if len(lexicon.counts) else 0, 0)
    counts[special >= 0] = 1
    unseen = np.flatnonzero((number < 0) & (special < 0))
    merged, merged_counts = merges.merge(data, starts[unseen], sizes[unseen])
    counts[unseen] = merged_counts
    first = np.cumsum(counts) - counts
    ids = np.empty(int(counts.sum()), np.int64)
    seen = np.flatnonzero((number >= 0) & (special < 0))
    ids[A.ragged(first[seen], counts[seen])] = lexicon.ids[A.ragged(lexicon.starts[number[seen]], counts[seen])]
    ids[A.ragged(first[unseen], merged_counts)] = merged
    ids[first[special >= 0]] = special[special >= 0]
    ends = np.concatenate((first, [len(ids)]))[np.searchsorted(starts, offsets)]
    return ids, np.diff(ends)


def _count_words(config):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = Merges(config.value).special
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            words = pa.concat_arrays(held).dictionary_encode()
            n = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            return pa.RecordBatch.from_arrays([words.dictionary.cast(pa.binary()), pa.array(n)], names=["word", "n"])

        for batch in batches:
            data, offsets = A.utf8(batch.column(0))
            for i, j in A.slices(offsets):
                part = data[offsets[i] : offsets[j]]
                starts, sizes, special = cut_words(part, offsets[i : j + 1] - offsets[i], specials)
                if (special >= 0).any():
                    starts, sizes = starts[special < 0], sizes[special < 0]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                flat = part[A.ragged(starts, sizes)]
                held.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat)]))
                size += len(part)
                if size >= COUNT_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return count


def frequent_words(docs: DataFrame, config, most: int = LEXICON_WORDS) -> list[bytes]:
    """The words of all texts whose count is at least the least count that ``most`` words or fewer reach."""
    counted = docs.select("text").mapInArrow(A.released(_count_words(config)), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    # One row for each count below a bound; the few words above it are one class.
    bound = F.least("n", F.lit(100_000))
    sizes = sorted(((r["n"], r["words"]) for r in counted.groupBy(bound.alias("n")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, total = None, 0
    for n, words in sizes:
        if total + words > most:
            break
        least, total = n, total + words
    if least is None:
        return []
    return [r["word"] for r in counted.where(F.col("n") >= least).select("word").collect()]


def build_codec(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS) -> Codec:
    """Count the words of ``docs``, compile the lexicon and hand it to the executors."""
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        text = f.read()
    config = spark.sparkContext.broadcast(text)  # one tokenizer file
    block = compile_lexicon([bytes(w) for w in frequent_words(docs, config, most)], Merges(text))
    name = shared_path(spark, "lexicon")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(name)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(block))
    stream.close()
    spark.sparkContext.addFile(name)
    return Codec(config, name.rsplit("/", 1)[1])


def _encode_texts(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lexicon = codec.open()
        for batch in batches:
            data, offsets = A.utf8(batch.column(batch.schema.get_field_index("text")))
            for i, j in A.slices(offsets):
                ids, counts = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], merges, lexicon)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, A.list_array(pa.array(ids, pa.int32()), counts)], names=[*part.schema.names, "ids"])

    return run


def with_ids(docs: DataFrame, codec: Codec) -> DataFrame:
    """``docs`` with ``ids``, the token ids of ``text`` (null: none); an ``ids`` column is replaced."""
    rest = docs.drop("ids")
    return rest.mapInArrow(A.released(_encode_texts(codec)), A.schema_with(rest, ids=A.IDS))


def _decode_texts(codec: Codec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = codec.open()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("ids"))
            offsets = column.offsets.to_numpy().astype(np.int64)
            data, sizes = merges.decode(column.values.to_numpy())
            ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return run


def with_decoded(encoded: DataFrame, codec: Codec) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its ``ids``; bytes that are no UTF-8 become U+FFFD."""
    rest = encoded.drop("decoded")
    filled = rest.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return filled.mapInArrow(A.released(_decode_texts(codec)), A.schema_with(filled, decoded=A.STRING))


def _digests(codec: Codec):
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, lexicon = codec.open()
        decimal = [b"%d," % i for i in range(len(merges.token_sizes))]
        digits, width = np.frombuffer(b"".join(decimal), np.uint8), np.array([len(d) for d in decimal])
        first = np.cumsum(width) - width

        def sha(values: np.ndarray, sizes: np.ndarray, counts: np.ndarray, less: int) -> list[str]:
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(counts)))]
            view = memoryview(np.ascontiguousarray(values))
            return [hashlib.sha256(view[a : max(a, b - less)]).hexdigest() for a, b in zip(ends[:-1], ends[1:])]

        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets):
                ids, counts = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], merges, lexicon)
                sizes = width[ids]
                joined = sha(digits[A.ragged(first[ids], sizes)], sizes, counts, 1)
                plain, plain_sizes = merges.decode(ids)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts), pa.array(joined), pa.array(sha(plain, plain_sizes, counts, 0))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def round_trip(docs: DataFrame, codec: Codec) -> DataFrame:
    """Per row: ``doc_id, n_tokens, ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256``.

    The ids of a whole text decode to bytes that are the text again, so that the digest of the bytes is that of the
    decoded text. Null is an empty text; repeated rows give repeated rows; an empty table gives none.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return rows.mapInArrow(A.released(_digests(codec)), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
