"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A shingle is five consecutive words. Its weight in a text is its count times an inverse document frequency. Each text
is sampled ``SAMPLES`` times: a sample of two texts is equal with the probability of their weighted Jaccard
similarity. ``BANDS`` subsets of ``ROWS`` samples are bucket keys; they share samples, so the chance that a pair has no
common bucket is measured (``tests/llm``), not that of independent bands. Within a bucket a leader, another for each band, is
verified against all members, which takes as many pairs as members; classes are the components of the verified
pairs. Buckets that then still hold more than one class are compared in full inside tasks, in blocks of members: first by
their samples, then, for members with a partner that agrees often enough, by their texts. Only links that join
classes leave a task. So no pair list grows with the square of a group, and no task holds a whole bucket.

Document frequencies come from a counting sketch over all documents: ``2 ** SKETCH_BITS`` counters, corrected for the
mean of the other shingles that share a counter. Its size is fixed, whatever the corpus. The frequency is damped,
``1 + STRENGTH * log(n / df) / log(n)``: in a class of thousands of copies the shared shingles are frequent and the edits are
rare, and an undamped weight would hide such copies from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from .arrays import stored
from .components import components
from .decontamination import words
from .leavers import row_key, without

SHINGLE = 5
SAMPLES = 96
ROWS = 7
BANDS = 64
SKETCH_BITS = 18
STRENGTH = 0.2
FIRST_BANDS = 8
CHUNK = 64
BLOCK = 1024
SLICE = 1 << 18
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different shingles of some texts in ascending order per text, their counts, shingles per text, text digests.

    A text of fewer than five words, but not none, is one shingle. The digest (two numbers) stands for the sequence
    of words, or for the bytes of a text without words.
    """
    terms, n = words(data, offsets)
    terms = terms.view(_U)
    first = np.cumsum(n) - n
    length = np.minimum(n, SHINGLE)
    per_text = np.where(n > 0, n - length + 1, 0)
    start = A.ragged(first, per_text)
    size = np.repeat(length, per_text)
    mixed = size.astype(_U) * _U(0x9FB21C651E98DF25)
    table = A.powers(SHINGLE + 2)
    padded = np.concatenate((terms, np.zeros(SHINGLE, _U)))
    for k in range(SHINGLE):
        mixed = mixed + np.where(k < size, padded[start + k], _U(0)) * table[k + 1]
    mixed = A.mix(mixed)
    text = np.repeat(np.arange(len(n)), per_text)
    order = np.lexsort((mixed, text))
    mixed, text = mixed[order], text[order]
    new = np.ones(len(mixed), bool)
    new[1:] = (mixed[1:] != mixed[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    digest = np.zeros((len(n), 2), _U)
    full = np.flatnonzero(n > 0)
    digest[full, 0] = A.span_hashes(terms, first[full], n[full])
    digest[full, 1] = A.span_hashes(A.mix(terms), first[full], n[full])
    bare, sizes = np.flatnonzero((n == 0) & (np.diff(offsets) > 0)), np.diff(offsets)
    digest[bare, 0] = A.span_hashes(data, offsets[bare], sizes[bare])
    digest[bare, 1] = A.span_hashes(data ^ np.uint8(0x5A), offsets[bare], sizes[bare])
    return mixed[at], np.diff(at, append=len(mixed)), np.bincount(text[at], minlength=len(n)), digest


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    texts = 0
    for batch in batches:
        data, offsets = A.utf8(batch.column(0))
        texts += len(batch)
        for i, j in A.slices(offsets, SLICE):
            found = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0]
            counts += np.bincount((found >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
    held = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(counts[held], texts))], names=["bucket", "n"])


def idf_table(docs: DataFrame) -> np.ndarray:
    """Weight of each sketch bucket, from all texts; at most ``2 ** SKETCH_BITS + 1`` rows reach the driver."""
    counted = docs.select("text").mapInArrow(A.released(_sketch), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    texts = max(2, int(n[bucket < 0].sum()))
    counts = np.zeros(1 << SKETCH_BITS)
    counts[bucket[bucket >= 0]] = n[bucket >= 0]
    frequency = np.clip(counts - (counts.sum() - counts) / (len(counts) - 1), 1, texts)
    return (1 + STRENGTH * np.log(texts / frequency) / np.log(texts)).astype(np.float32)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return counts.astype(np.float32) * idf[(found >> _U(64 - SKETCH_BITS)).astype(np.int64)]


def _weighted_shingles(column: pa.ChunkedArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of whole texts, their weights, shingles per text, text digests; the wide arrays of a slice only are held at once."""
    data, offsets = A.utf8(column)
    parts = []
    for i, j in A.slices(offsets, SLICE):
        found, counts, per_text, digest = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((found, weights(found, counts, idf).astype(np.float64), per_text, digest))
    return tuple(np.concatenate(of) for of in zip(*parts))


def gamma_quantiles(n: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution of shape 2, by bisection of its distribution function."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def band_rows() -> np.ndarray:
    """Samples of each band. Bands cut from one permutation are disjoint, so a sample that differs spoils few of them."""
    rng = np.random.default_rng(7)
    cuts = SAMPLES // ROWS
    drawn = [rng.permutation(SAMPLES)[: cuts * ROWS].reshape(cuts, ROWS) for _ in range(-(-BANDS // cuts))]
    return np.sort(np.concatenate(drawn)[:BANDS], axis=1)


class Sampler:
    def __init__(self) -> None:
        gamma = gamma_quantiles()
        self.r, self.inverse, self.log_c = gamma.astype(np.float32), (1 / gamma).astype(np.float32), np.log(gamma).astype(np.float32)
        self.odd = A.mix(np.arange(1, SAMPLES + 1, dtype=_U)) | _U(1)
        self.bands = band_rows()
        self.members = np.zeros((SAMPLES, BANDS), np.float32)
        for b, band in enumerate(self.bands):
            self.members[band, b] = 1

    def samples(self, found: np.ndarray, weight: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Samples of each text that has shingles, as bits of the least hash value: one row per text."""
        full = per_text[per_text > 0]
        first = np.cumsum(full) - full
        log_w = np.log(weight)
        out = np.empty((len(full), SAMPLES), np.float32)
        for k in range(SAMPLES):
            h = found * self.odd[k]
            h ^= h >> _U(32)
            h *= _U(0xD6E8FEB86659FD93)
            r_at = (h >> _U(48)).astype(np.int64)
            r = self.r[r_at]
            beta = ((h >> _U(8)) & _U(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            t = np.floor(log_w * self.inverse[r_at] + beta)
            value = self.log_c[((h >> _U(32)) & _U(0xFFFF)).astype(np.int64)] - r * (t - beta + np.float32(1))
            out[:, k] = np.minimum.reduceat(value, first)
        return out.view(np.int32)

    def keys(self, samples: np.ndarray) -> np.ndarray:
        """Bucket keys of each band."""
        table = A.powers(ROWS + 1)[1:]
        wide = samples.view(np.uint32).astype(_U)
        mixed = np.stack([A.mix((wide[:, band] * table).sum(axis=1, dtype=_U) + _U(b + 1)) for b, band in enumerate(self.bands)], axis=1)
        return mixed.view(np.int64)


_SAMPLER: list[Sampler] = []


def _sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def _signatures(idf):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in batches:
            data, offsets = A.utf8(batch.column(1))
            for i, j in A.slices(offsets, SLICE):
                found, counts, per_text, digest = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.where(per_text > 0, SAMPLES, 0)
                taken = sampler.samples(found, weights(found, counts, idf.value), per_text) if len(found) else np.zeros(0, np.int32)
                node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), j - i, [None, pa.py_buffer(digest.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), node, A.list_array(pa.array(taken.ravel()), n)], names=["doc_id", "node", "samples"]
                )

    return run


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sampler = _sampler()
    for batch in batches:
        for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
            column = part.column(1)
            taken = column.flatten().to_numpy().reshape(len(part), SAMPLES)
            rows = np.repeat(np.arange(len(part)), BANDS)
            band = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(part)))
            yield pa.RecordBatch.from_arrays([pa.array(sampler.keys(taken).ravel()), band, part.column(0).take(pa.array(rows))], names=["bucket", "band", "node"])


def _links(idf, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_shingles, hub_weights = None, None, None
        for batch in batches:
            data, offsets = A.utf8(batch.column(2))
            hubs, nodes = batch.column(0), batch.column(1)
            for i, j in A.slices(offsets, SLICE):
                found, counts, per_text, digest = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                weight = weights(found, counts, idf.value).astype(np.float64)
                ends = np.concatenate(([0], np.cumsum(per_text)))
                a, b = [], []
                for k in range(j - i):
                    leader, node = hubs[i + k].as_py(), nodes[i + k].as_py()
                    mine, my_weights = found[ends[k] : ends[k + 1]], weight[ends[k] : ends[k + 1]]
                    stands_for = leader if node is None else node
                    if digest[k].tobytes() != stands_for or not len(mine):
                        continue  # the text of another row with the same id
                    if node is None:
                        hub, hub_shingles, hub_weights = leader, mine, my_weights
                    elif leader == hub:
                        at = np.minimum(np.searchsorted(hub_shingles, mine), len(hub_shingles) - 1)
                        shared = hub_shingles[at] == mine
                        common = np.minimum(hub_weights[at], my_weights)[shared].sum()
                        if common >= threshold * (hub_weights.sum() + my_weights.sum() - common):
                            a.append(leader)
                            b.append(node)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """Pairs (``a``, ``b``) whose weighted Jaccard similarity reaches the threshold.

    ``texts`` has ``node`` and ``text``. The text of a node with many partners is sent once per ``CHUNK`` of them.
    """
    hubs = stored(pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "hubs")
    chunked = stored(pairs.join(hubs, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks").cast("int")).select("a", "b", "chunk"), "pairs")
    partners = chunked.join(texts, chunked["b"] == texts["node"]).select("a", "b", "text", "chunk")
    leaders = hubs.join(texts, hubs["a"] == texts["node"]).select(
        "a", F.lit(None).cast("binary").alias("b"), "text", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    )
    # Leaders come first in their chunk, as nulls sort first.
    rows = leaders.unionByName(partners).repartition("a", "chunk").sortWithinPartitions("a", "chunk", "b").select("a", "b", "text")
    return rows.mapInArrow(A.released(_links(idf, threshold)), "a binary, b binary")


def _sides(block: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the lower block, rows to compare them with, and whether these are the same rows."""
    low, high = int(block.min()), int(block.max())
    every = np.arange(len(block))
    return (every, every, True) if low == high else (np.flatnonzero(block == low), np.flatnonzero(block == high), False)


def _open_nodes(least: int):
    """Nodes of a bucket (or of two blocks of it) that take part in a pair which must still be verified here: different
    classes, samples that agree ``least`` times or more, and no earlier band in which the two meet as well."""

    def run(table: pa.Table) -> pa.Table:
        sampler = _sampler()
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        taken = table.column("samples").combine_chunks().flatten().to_numpy().reshape(len(table), SAMPLES)
        earlier = sampler.members[:, : table.column("band")[0].as_py()]
        mine, other, same = _sides(table.column("block").to_numpy())
        needed = np.zeros(len(table), bool)
        for i in mine:
            partners = other[(label[other] != label[i]) & ((other > i) if same else True)]
            equal = taken[partners] == taken[i]
            close = equal.sum(axis=1) >= least
            partners, equal = partners[close], equal[close]
            if len(partners) and earlier.shape[1]:
                partners = partners[~((equal.astype(np.float32) @ earlier) >= ROWS).any(axis=1)]
            if len(partners):
                needed[i] = True
                needed[partners] = True
        at = pa.array(np.flatnonzero(needed))
        return table.select(["bucket", "i", "j", "node", "label", "block"]).take(at)

    return run


def _block_links(idf, threshold: float):
    """Links that join different classes of a bucket (or of two blocks of it): a spanning forest of all links."""

    def run(table: pa.Table) -> pa.Table:
        found, weight, per_text, digest = _weighted_shingles(table.column("text"), idf.value)
        own_text = np.array([d.tobytes() == n for d, n in zip(digest, table.column("node").to_pylist())], bool)
        if not own_text.all():  # the text of another row with the same id
            held = np.repeat(own_text, per_text)
            table, found, weight, per_text = table.filter(pa.array(own_text)), found[held], weight[held], per_text[own_text]
        if not len(table):
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        ends = np.concatenate(([0], np.cumsum(per_text)))
        _, place = np.unique(found, return_inverse=True)
        del found
        label = table.column("label").combine_chunks().dictionary_encode().indices.to_numpy()
        total = np.add.reduceat(np.append(weight, 0.0), ends[:-1])
        parent = np.arange(int(label.max()) + 1)

        def root(x: int) -> int:
            while parent[x] != x:
                x = parent[x]
            return x

        mine, other, same = _sides(table.column("block").to_numpy())
        dense = np.zeros(int(place.max()) + 1 if len(place) else 1)
        left, right = [], []
        for i in mine:
            roots = np.array([root(x) for x in range(len(parent))])[label]
            partners = other[(roots[other] != roots[i]) & ((other > i) if same else True)]
            if not len(partners):
                continue
            own = slice(ends[i], ends[i + 1])
            dense[place[own]] = weight[own]
            rows = A.ragged(ends[partners], per_text[partners])
            common = np.add.reduceat(np.minimum(dense[place[rows]], weight[rows]), np.cumsum(per_text[partners]) - per_text[partners])
            dense[place[own]] = 0
            for j in partners[common >= threshold * (total[i] + total[partners] - common)]:
                a, b = root(label[i]), root(label[j])
                if a != b:
                    parent[max(a, b)] = min(a, b)
                    left.append(i)
                    right.append(j)
        node = table.column("node").combine_chunks()
        pick = lambda at: node.take(pa.array(at, pa.int64())).cast(pa.binary())
        return pa.table({"a": pick(left), "b": pick(right)})

    return run


def _rest(buckets: DataFrame, nodes: DataFrame, texts: DataFrame, labels: DataFrame, idf, threshold: float) -> DataFrame:
    """Links between different classes that share a bucket. Rows sent: members, not pairs."""
    # Samples agree with the probability of the similarity; five deviations below it nothing is lost.
    least = int(SAMPLES * threshold - 5 * np.sqrt(SAMPLES * threshold * (1 - threshold)))
    labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).where("x <> y")
    mixed = stored(mixed.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "mixed")
    held = stored(labelled.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "held")
    full = held.join(nodes.select("node", "samples"), "node")
    # Blocks meet two by two; a bucket of one block meets itself once.
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    met = full.withColumn("pair", F.explode(others)).select("bucket", "pair.i", "pair.j", "band", "block", "node", "label", "samples")
    kept = "bucket bigint, i int, j int, node binary, label binary, block int"
    needed = stored(met.groupBy("bucket", "i", "j").applyInArrow(_open_nodes(least), kept), "open")
    return needed.join(texts, "node").groupBy("bucket", "i", "j").applyInArrow(_block_links(idf, threshold), "a binary, b binary")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one class yet."""
    left, right = (labels.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label")) for side in "ab")
    known = pairs.join(left, "a", "left").join(right, "b", "left")
    return known.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def _heads(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The known classes as stars around their label, and the edges that join two of them."""
    return labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionByName(_apart(edges, labels))


def classes(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Near-duplicate class of every row: ``doc_id``, ``class_id`` (smallest id of the class), ``class_rows``.

    ``docs`` has ``doc_id`` and ``text``. Rows with the same words in the same order are one text. Texts whose weighted
    Jaccard similarity is at least ``threshold`` are linked; classes are the components of the links.

    A null text is a class of its own. A text without words has exact copies only. Rows with a null id belong to the
    class of their text, but a text that has only such rows is not linked to other texts. Repeated rows share a class.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    present = rows.where(F.col("text").isNotNull())
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(idf_table(present))  # fixed size
    signed = stored(present.mapInArrow(A.released(_signatures(idf)), "doc_id bigint, node binary, samples array<int>"), "signatures")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("samples").alias("samples")), "nodes")
    sampled = nodes.where((F.size("samples") > 0) & F.col("rep").isNotNull())
    keyed = sampled.select("node", "samples").mapInArrow(A.released(_band_rows), "bucket bigint, band int, node binary")
    # Another leader in each bucket of a class: what one leader misses, the next one links.
    ranked = keyed.withColumn("rank", F.struct(F.xxhash64("bucket", "node").alias("h"), "node"))
    leaders = stored(ranked.groupBy("bucket").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("first.node").alias("leader")), "leaders")
    buckets = stored(keyed.join(leaders, "bucket"), "buckets")
    stars = buckets.where("leader <> node").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.min("band").alias("band"))
    stars = stored(stars, "stars")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "rep"), "node")
    texts = stored(wanted.join(rows, wanted["rep"] == rows["doc_id"]).select("node", "text"), "texts")
    # The first bands link most of a class; of the others only the pairs that could still join two classes remain.
    edges = stored(verified(stars.where(F.col("band") < FIRST_BANDS).select("a", "b"), texts, idf, threshold), "links")
    labels = components(edges)
    late = _apart(stars.where(F.col("band") >= FIRST_BANDS).select("a", "b"), labels)
    edges = edges.unionByName(stored(verified(late, texts, idf, threshold), "links"))
    labels = components(_heads(edges, labels))
    more = stored(_rest(buckets.select("bucket", "band", "node"), nodes, texts, labels, idf, threshold), "links")
    labels = components(_heads(edges.unionByName(more), labels))
    named = signed.select("doc_id", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = stored(named.select("doc_id", "label"), "members")
    heads = stored(named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows")), "classes")
    single = rows.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("bigint").alias("class_rows"))
    return named.join(heads, "label").select("doc_id", "class_id", "class_rows").unionByName(single)


def keep_one(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with exactly one row of each class of :func:`classes`: one with the smallest id of the class.

    Rows are told apart by id and text, so rows that share an id but not a text are judged apart. A null id counts as larger than any
    other. Of rows that share id and text one stays, whichever it is. Rows with a null text stay.
    """
    key = row_key(F.col("doc_id"), F.col("text"))
    present = docs.where(F.col("text").isNotNull())
    rows = present.select(F.col("doc_id").cast("bigint").alias("id"), key.alias("doc_id"), "text")
    members = classes(rows.select("doc_id", "text"), threshold).select("doc_id", "class_id").distinct()
    ids = rows.groupBy("doc_id").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    named = stored(members.join(ids, "doc_id"), "near-members")
    # Stored, so that the join has plain exchanges on both sides and adaptive execution can split a hot class.
    first = stored(named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "doc_id")).alias("first")), "near-first")
    losers = stored(named.join(first, "class_id").where("doc_id <> first.doc_id").select("doc_id"), "near-losers")
    repeated = stored(named.where("n > 1").select("doc_id"), "near-repeated")
    left = docs.where(F.col("text").isNull()).unionByName(without(present, key, losers))
    if repeated.isEmpty():
        return left
    again = left.join(repeated.select(F.col("doc_id").alias("__again")), key == F.col("__again"), "left_semi").where(F.col("text").isNotNull())
    return without(left, key, repeated).unionByName(again.withColumn("__key", key).dropDuplicates(["__key"]).select(*docs.columns))
