"""Near-duplicates by SimHash fingerprints.

A text is lower-cased (A-Z only) and split at ASCII white space into words. Its
shingles are runs of ``shingle_words`` words, repeats included; a bit of the
fingerprint is set where more than half of the shingles' XXH64 values have it.
Fewer words than a shingle hash as one sequence; no word gives fingerprint
zero, which links like any other.

Fingerprints link at ``radius`` or fewer differing bits. The 64 bits are cut
into ``blocks`` ranges, and two fingerprints within the radius agree on at
least ``blocks - radius`` of them, so it is enough to compare those with equal
bits in one such choice of ranges (a bucket). Within a bucket the comparison is
bit-sliced: bit planes are stored vertically, many distances grow at once in
carry-save counters, and a block ends as soon as every lane is over the radius.
Large buckets are dealt into chunks, and each pair of chunks is compared by
itself.

Defined cases: a null text is empty; a null id keeps its fingerprint and has a
null component; repeated ids keep one row each; an empty table gives no rows;
columns other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.graph import components
from driftline.llm.shared import materialise, slices, stored, texts_of

SEED = 42
#: Fingerprints of one bucket that are compared in one piece of work.
CHUNK = 1024
#: Up to this many fingerprints a bucket is compared lane by lane with its shifted self.
SMALL = 48


def shingle_hashes(words: list[bytes], shingle_words: int) -> np.ndarray:
    """XXH64 of each shingle of lower-cased words."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle_words))))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)


def hashes_fingerprint(hashes: np.ndarray, bits: int = 64) -> np.ndarray:
    """The fingerprint of shingle hashes, as ``bits / 64`` unsigned integers.

    The first integer has the bits of XXH64 itself, the others those of fixed
    mixes of it. A hash counts as often as it is given.
    """
    n, width = len(hashes), bits // 64
    if not n:
        return np.zeros(width, np.uint64)
    counts = np.zeros(bits // 8 * 256)
    for start in range(0, n, 4096):
        mixed = _mixes(hashes[start : start + 4096], width)
        # Counts of the 256 values of each byte, then of the bits in them.
        octets = mixed.view(np.uint8).reshape(-1, bits // 8) + _OFFSETS[: bits // 8]
        counts += np.bincount(octets.ravel(), minlength=len(counts))
    set_bits = (2 * (counts.reshape(-1, 256) @ _BITS_OF) > n).ravel()
    return np.packbits(set_bits, bitorder="little").view(np.uint64)


def _mixes(hashes: np.ndarray, width: int) -> np.ndarray:
    """(n, width) integers: the hash itself, then width - 1 mixes of it."""
    out = np.repeat(hashes[:, None], width, axis=1)
    if width > 1:
        rest = out[:, 1:]
        rest += np.arange(1, width, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        rest ^= rest >> np.uint64(30)
        rest *= np.uint64(0xBF58476D1CE4E5B9)
        rest ^= rest >> np.uint64(27)
        rest *= np.uint64(0x94D049BB133111EB)
        rest ^= rest >> np.uint64(31)
    return out


_OFFSETS = np.arange(512, dtype=np.int64) * 256
_BITS_OF = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [hashes_fingerprint(shingle_hashes(t.encode().lower().split(), shingle_words))[0] for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- bit-sliced comparison


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(bits, words): plane b holds bit b of every fingerprint, 64 fingerprints to a word.

    ``fps``: (n, width) integers.
    """
    lanes = -(-len(fps) // 64) * 64
    padded = np.zeros((lanes, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def within_radius(differing: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Lanes at most ``radius`` apart, given the planes of differing bits in turn.

    ``counters[i]`` holds bit i of every lane's distance; a carry out of the
    top counter is sticky. The rest is skipped once no lane can be within.
    """
    width = radius.bit_length()
    spare = (1 << width) - 1 - radius  # start there, so that the carry comes at radius + 1
    counters: list[np.ndarray] = []
    over = None
    for k, carry in enumerate(differing):
        if over is None:
            ones = np.full_like(carry, np.uint64(0xFFFFFFFFFFFFFFFF))
            counters = [ones.copy() if spare >> i & 1 else np.zeros_like(carry) for i in range(width)]
            over = np.zeros_like(carry)
        for i in range(width):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        over |= carry
        if k % 8 == 7 and (over == ones).all():
            break
    return ~over


def _unpacked(mask: np.ndarray, lanes: int) -> np.ndarray:
    return np.unpackbits(mask.view(np.uint8), axis=-1, bitorder="little")[..., :lanes].astype(bool)


def block_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i, j) of all left and right fingerprints within the radius."""
    planes, out_i, out_j = bit_planes(right), [], []
    for start in range(0, len(left), 256):
        part = left[start : start + 256]
        # All ones where the query's bit is set, so that the XOR gives differing bits.
        masks = np.uint64(0) - np.unpackbits(np.ascontiguousarray(part).view(np.uint8), axis=1, bitorder="little").T.astype(np.uint64)
        near = _unpacked(within_radius((plane[None, :] ^ mask[:, None] for plane, mask in zip(planes, masks)), radius), len(right))
        i, j = np.nonzero(near)
        out_i.append(i + start)
        out_j.append(j)
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int),) * 2


def small_links(fps: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside many small groups that lie one after another: lane i against lane i + shift."""
    out_i, out_j, at, shift = [], [], np.arange(len(fps)), 1
    while True:
        at = at[at + shift < len(fps)]
        at = at[group[at] == group[at + shift]]
        if not len(at):
            break
        planes = bit_planes(fps[at] ^ fps[at + shift])
        near = at[_unpacked(within_radius(iter(planes), radius), len(at))]
        out_i.append(near)
        out_j.append(near + shift)
        shift += 1
    return (np.concatenate(out_i), np.concatenate(out_j)) if out_i else (np.zeros(0, int),) * 2


def spanning_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (k, root) that connect what the links i-j connect, at most one for each item."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            break
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    k = np.nonzero(root != np.arange(n))[0]
    return k, root[k]


def _compare(radius: int, width: int):
    """Rows of members (rep, side, fp0, fp1, ...) to edges (a, b) of representatives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("members")
            starts = members.offsets.to_numpy()
            lo = starts[0]
            reps, side, *words = (members.values.field(k).to_numpy(zero_copy_only=False)[lo : starts[-1]] for k in range(2 + width))
            fps, starts = np.stack(words, axis=1).view(np.uint64), starts - lo
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)
            at = np.nonzero((sizes <= SMALL)[group])[0]
            i, j = small_links(fps[at], group[at], radius)
            pairs = [(at[i], at[j])]
            for g in np.nonzero(sizes > SMALL)[0]:
                own = np.arange(starts[g], starts[g + 1])
                sides = side[own]
                left, right = own[sides == sides.min()], own[sides == sides.max()]
                i, j = block_links(fps[left], fps[right], radius)
                pairs.append((left[i], right[j]))
            i, j = (np.concatenate(x) for x in zip(*pairs))
            k, root = spanning_links(len(fps), i, j)
            yield pa.RecordBatch.from_arrays([pa.array(reps[k]), pa.array(reps[root])], names=["a", "b"])

    return run


def bucket_work(keyed: DataFrame, words: list[str], more: list[str] = []) -> DataFrame:
    """Pieces of work (choice, key, lo, hi, members) of every bucket with two rows or more."""
    sizes = keyed.groupBy("choice", "key").agg(F.count("*").alias("n"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).filter("n > 1")
    # A chunk meets itself and every other one: one row for each pair that it is in.
    dealt = keyed.join(sizes, ["choice", "key"]).withColumn("side", F.pmod(F.xxhash64(*words), F.col("chunks")).cast("int"))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    work = paired.groupBy("choice", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi")).agg(F.collect_list(F.struct("rep", "side", *words, *more)).alias("members"))
    return work.filter(F.size("members") > 1)


def bucket_edges(keyed: DataFrame, radius: int, words: list[str]) -> DataFrame:
    """Edges that connect what is within the radius in any bucket.

    ``keyed``: (choice, key, rep, and the fingerprint's ``words``), a row for
    each bucket that a fingerprint is in. Edges are between reps.
    """
    return bucket_work(keyed, words).select("members").mapInArrow(_compare(radius, len(words)), "a long, b long")


def fingerprint_edges(distinct: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """Edges that connect exactly the fingerprints linked, directly or by others, within the radius.

    ``distinct``: (fp, rep), each fingerprint once. Edges are between reps.
    """
    cuts = [round(64 * k / blocks) for k in range(blocks + 1)]
    ranges = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [sum(c) for c in combinations(ranges, blocks - radius)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "key"))
    return bucket_edges(keyed, radius, ["fp"])


def near_duplicates(docs: DataFrame, shingle_words: int = 3, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest id reachable by links."""
    if blocks <= radius:
        raise ValueError("blocks must exceed the radius")
    marked = materialise(fingerprints(docs, shingle_words))
    distinct = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    linked = components(fingerprint_edges(distinct, radius, blocks)).withColumnRenamed("id", "rep")
    classes = distinct.join(linked, "rep", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    out = marked.join(classes, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


# --- near copies by similarity: wide fingerprints

#: Bits of a wide fingerprint.
WIDE_BITS = 512
#: Bucket keys of a text, and the smallest hashes that make one key.
TABLES, MIN_HASHES = 14, 3
#: Standard deviations above the mean distance up to which a pair is proposed.
SPREAD = 3.5
#: Nearest others of each text in a piece of work that the rounds propose, before one that compares all the rest.
ROUNDS = (1, 3)
#: Bytes of shingle hashes in a chunk of that last one.
CHUNK_BYTES = 16_000_000
#: Pairs that a task confirms, on average, and those of one text at most in one task.
TILE, OF_ONE = 2048, 1024


def wide_radius(similarity: float, bits: int = WIDE_BITS) -> int:
    """Differing bits up to which texts are proposed as of a shingle (Jaccard) similarity.

    Sets of a size with Jaccard similarity s have the cosine 2 s / (1 + s); a
    bit differs with probability angle / pi, and sets of different sizes with
    that similarity are nearer. ``SPREAD`` standard deviations more keep all
    but about 2 of 10,000 pairs just at the similarity.
    """
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(bits * share + SPREAD * np.sqrt(bits * share * (1 - share)))


def bucket_keys(hashes: np.ndarray) -> np.ndarray:
    """``TABLES`` keys of a set of shingle hashes, each made of ``MIN_HASHES`` smallest values under fixed mixes.

    Two sets agree on one smallest value with probability their Jaccard
    similarity, so a pair at 0.8 shares a key with probability 0.99996, while
    texts that share little meet rarely, however many texts there are.
    """
    least = np.full(TABLES * MIN_HASHES + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(hashes), 4096):
        least = np.minimum(least, _mixes(hashes[start : start + 4096], len(least)).min(axis=0))
    parts = least[1:].reshape(TABLES, MIN_HASHES)
    keys = np.zeros(TABLES, np.uint64)
    for column in parts.T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def _wide(shingle_words: int):
    width = WIDE_BITS // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            words_of = [t.encode().lower().split() for t in texts_of(batch)]
            sets = [np.unique(shingle_hashes(w, shingle_words)) for w in words_of]
            fps = np.stack([hashes_fingerprint(h, WIDE_BITS) for h in sets]) if sets else np.zeros((0, width), np.uint64)
            keys = [bucket_keys(h).view(np.int64) for h in sets]
            same = [xxhash.xxh128_digest(b" ".join(w)) for w in words_of]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.binary()), *(pa.array(fps[:, i].view(np.int64)) for i in range(width)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", *(f"w{i}" for i in range(width)), "keys"])

    return run


def _propose(radius: int, width: int, labelled: bool, limit: int | None):
    """Pieces of work to pairs (a, b), a > b, of representatives with different labels.

    With a limit a text is paired with as many of the others in the piece, by
    distance of fingerprints, and each text of a pair left out is named, as
    ``a``, with its bucket in a row of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, choice, key = batch.column("members"), batch.column("choice").to_numpy(), batch.column("key").to_numpy()
            starts = members.offsets.to_numpy()
            lo = starts[0]
            reps, side, *words = (members.values.field(k).to_numpy(zero_copy_only=False)[lo : starts[-1]] for k in range(2 + width))
            labels = members.values.field(2 + width).to_numpy(zero_copy_only=False)[lo : starts[-1]] if labelled else reps
            fps, starts = np.stack(words, axis=1).view(np.uint64), starts - lo
            sizes = np.diff(starts)
            group = np.repeat(np.arange(len(sizes)), sizes)

            def rows(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
                apart = labels[i] != labels[j]
                i, j = i[apart], j[apart]
                g, a, b = group[i], np.maximum(reps[i], reps[j]), np.minimum(reps[i], reps[j])
                over, left_out = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if limit and len(g):
                    far = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
                    # Every pair from both its ends; a block that meets itself has pairs in both orders.
                    ends = np.unique(np.stack([np.r_[g, g], np.r_[a, b], np.r_[far, far], np.r_[b, a]]), axis=1)
                    first = np.r_[True, (ends[:2, 1:] != ends[:2, :-1]).any(axis=0)]
                    at = np.arange(ends.shape[1])
                    near = at - np.maximum.accumulate(np.where(first, at, 0)) < limit
                    whole = np.stack([ends[0], np.maximum(ends[1], ends[3]), np.minimum(ends[1], ends[3])])
                    chosen, rest = np.unique(whole[:, near], axis=1), whole[:, ~near]
                    over, left_out = np.unique(np.stack([np.r_[rest[0], rest[0]], np.r_[rest[1], rest[2]]]), axis=1)
                    a, b = chosen[1], chosen[2]
                none, no_bucket = [None] * len(over), pa.nulls(len(a), pa.int32())
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[a, left_out], pa.int64()), pa.array([*b.tolist(), *none], pa.int64()), pa.concat_arrays([no_bucket, pa.array(choice[over], pa.int32())]), pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(key[over], pa.int64())])],
                    names=["a", "b", "choice", "key"],
                )

            at = np.nonzero((sizes <= SMALL)[group])[0]
            i, j = small_links(fps[at], group[at], radius)
            yield rows(at[i], at[j])
            for g in np.nonzero(sizes > SMALL)[0]:
                own = np.arange(starts[g], starts[g + 1])
                sides = side[own]
                left, right = own[sides == sides.min()], own[sides == sides.max()]
                i, j = block_links(fps[left], fps[right], radius)
                yield rows(left[i], right[j])

    return run


def proposed(keyed: DataFrame, radius: int, words: list[str], labelled: bool, limit: int | None) -> DataFrame:
    """Distinct pairs (a, b) within the radius in any bucket, and rows (a, choice, key) of texts in pairs left out."""
    work = bucket_work(keyed, words, ["label"] if labelled else []).select("choice", "key", "members")
    return work.mapInArrow(_propose(radius, len(words), labelled, limit), "a long, b long, choice int, key long").distinct()


def jaccard_at_least(left: np.ndarray, right: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of shingle hashes have the similarity."""
    least, most = sorted((len(left), len(right)))
    if least < similarity * most - 1e-9:
        return False
    both = len(np.intersect1d(left, right, assume_unique=True))
    return both >= similarity * (least + most - both) - 1e-9


def _confirm(shingle_words: int, similarity: float):
    """Pairs (a, b) of a tile and their texts (id, text) to edges that connect what the similar pairs connect."""

    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        sets: dict[int, list[np.ndarray]] = {}
        for batch in slices(iter(texts.to_batches())):
            for i, t in zip(batch.column("id").to_pylist(), texts_of(batch)):
                sets.setdefault(i, []).append(np.unique(shingle_hashes(t.encode().lower().split(), shingle_words)))
        a, b = pairs.column("a").to_numpy(), pairs.column("b").to_numpy()
        near = np.fromiter((any(jaccard_at_least(x, y, similarity) for x in sets[i] for y in sets[j]) for i, j in zip(a.tolist(), b.tolist())), bool, len(a))
        ids, at = np.unique(np.concatenate([a[near], b[near]]), return_inverse=True)
        k, root = spanning_links(len(ids), *np.split(at, 2))
        return pa.table({"a": pa.array(ids[k], pa.int64()), "b": pa.array(ids[root], pa.int64())})

    return run


def confirmed(pairs: DataFrame, docs: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Edges that connect what the pairs (a, b) whose texts have the similarity exactly connect.

    Pairs are dealt by ``b``, those of one ``b`` to several tiles where they are
    many, so a text goes once to the tiles of its own pairs as ``b``, and as
    ``a`` to the tile of each partner.
    """
    tiles = max(1, -(-pairs.count() // TILE))
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / OF_ONE).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts"))
    dealt = stored(pairs.join(many, "b").select("a", "b", F.pmod(F.xxhash64("b", part), F.lit(tiles)).alias("tile")))
    ends = F.explode(F.array("a", "b")).alias("id")
    texts = dealt.select("tile", ends).distinct().join(docs.withColumnRenamed("doc_id", "id"), "id").select((F.col("tile") + 0).alias("text_tile"), "id", "text")
    return dealt.groupBy("tile").cogroup(texts.groupBy("text_tile")).applyInArrow(_confirm(shingle_words, similarity), "a long, b long")


def _compare_sets(radius: int, width: int, similarity: float):
    """Pieces of work with labels, keys and shingle hashes to edges that connect what their similar pairs of different labels connect.

    A pair that shares several buckets is compared in the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, choice in enumerate(batch.column("choice").to_pylist()):
                members = batch.column("members")[row].values
                reps, side, *words = (members.field(k).to_numpy(zero_copy_only=False) for k in range(2 + width))
                labels = members.field(2 + width).to_numpy(zero_copy_only=False)
                keys = np.array(members.field(3 + width).to_pylist(), np.int64)
                sets = [np.frombuffer(h, np.uint64) for h in members.field(4 + width).to_pylist()]
                fps = np.stack(words, axis=1).view(np.uint64)
                left, right = np.nonzero(side == side.min())[0], np.nonzero(side == side.max())[0]
                i, j = block_links(fps[left], fps[right], radius)
                i, j = left[i], right[j]
                apart = (labels[i] != labels[j]) & ((i < j) | (side[i] != side[j]))
                i, j = i[apart], j[apart]
                fresh = ~(keys[i, :choice] == keys[j, :choice]).any(axis=1) if len(i) else np.zeros(0, bool)
                i, j = i[fresh], j[fresh]
                near = np.fromiter((jaccard_at_least(sets[x], sets[y], similarity) for x, y in zip(i.tolist(), j.tolist())), bool, len(i))
                k, root = spanning_links(len(reps), i[near], j[near])
                yield pa.RecordBatch.from_arrays([pa.array(reps[k], pa.int64()), pa.array(reps[root], pa.int64())], names=["a", "b"])

    return run


def compared(left_out: DataFrame, classes: DataFrame, docs: DataFrame, words: list[str], radius: int, shingle_words: int, similarity: float) -> DataFrame:
    """Edges of all similar pairs of different labels in the buckets (choice, key, rep, label): sets are compared where the texts meet, and no pair is written."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(t.encode().lower().split(), shingle_words)).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    reps = left_out.select("rep").distinct()
    # A repeated id has several texts, each a member of its own.
    sets = docs.select(F.col("doc_id").alias("rep"), "text").join(reps, "rep").mapInArrow(hashed, "rep long, hashes binary").distinct()
    payload = stored(classes.select("rep", *words, "keys").join(sets, "rep"))
    # Chunks are dealt on ids alone, so that the sets move once, to where they meet.
    light = left_out.join(payload.select("rep", F.octet_length("hashes").alias("size")), "rep")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("size") / CHUNK_BYTES)).cast("int").alias("chunks")
    sizes = light.groupBy("choice", "key").agg(F.count("*").alias("n"), chunks).filter("n > 1")
    dealt = left_out.join(sizes, ["choice", "key"]).withColumn("side", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("choice", "key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "rep", "side", "label").join(payload, "rep")
    work = dealt.groupBy("choice", "key", "lo", "hi").agg(F.collect_list(F.struct("rep", "side", *words, "label", "keys", "hashes")).alias("members")).filter(F.size("members") > 1).select("choice", "members")
    return work.mapInArrow(_compare_sets(radius, len(words), similarity), "a long, b long").filter("a <> b")


def similar_documents(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): groups of texts linked by a shingle similarity of ``similarity`` or more.

    Equal word sequences are one class. Classes with an equal key of
    ``bucket_keys`` are a bucket, whose wide fingerprints are compared by bit
    planes; pairs within ``wide_radius`` are proposed, and every link is
    confirmed by the exact Jaccard similarity of the distinct shingles.
    First rounds propose a text's nearest ones alone; what the links have not
    yet brought together is compared whole, by sets, where the texts meet.
    """
    words = [f"w{i}" for i in range(WIDE_BITS // 64)]
    schema = f"doc_id long, same binary, {', '.join(f'{w} long' for w in words)}, keys array<long>"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marked = stored(docs.mapInArrow(_wide(shingle_words), schema))
    first = ["keys", *words]
    classes = marked.filter("doc_id is not null").groupBy("same").agg(F.min("doc_id").alias("rep"), *[F.any_value(c).alias(c) for c in first])
    keyed, radius = classes.select("rep", *words, F.posexplode("keys").alias("choice", "key")), wide_radius(similarity)
    edges, linked, searched = None, None, keyed
    for at, limit in enumerate(ROUNDS):
        found = stored(proposed(searched, radius, words, linked is not None, limit))
        near = stored(confirmed(found.filter("b is not null").select("a", "b"), docs, shingle_words, similarity))
        edges = near if edges is None else edges.union(near)
        linked = components(edges).withColumnRenamed("id", "rep")
        # Texts of pairs left out meet again where their bucket still has two labels of them.
        left_out = found.filter("b is null").select("choice", "key", F.col("a").alias("rep")).join(linked, "rep", "left").withColumn("label", F.coalesce("component_id", "rep")).drop("component_id")
        apart = left_out.groupBy("choice", "key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("choice", "key")
        left_out = stored(left_out.join(apart, ["choice", "key"], "left_semi"))
        if left_out.isEmpty():
            break
        if at == len(ROUNDS) - 1:
            edges = edges.union(stored(compared(left_out, classes, docs, words, radius, shingle_words, similarity)))
            linked = components(edges).withColumnRenamed("id", "rep")
        searched = left_out.join(classes.select("rep", *words), "rep")
    grouped = classes.select("same", "rep").join(linked, "rep", "left").select("same", F.coalesce("component_id", "rep").alias("component_id"))
    return marked.select("doc_id", "same").join(grouped, "same", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the one with the smallest id stays.

    Rows with a null id stay; of rows with equal ids all stay or none.
    """
    groups = similar_documents(docs, shingle_words, similarity)
    dropped = groups.filter("component_id < doc_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
