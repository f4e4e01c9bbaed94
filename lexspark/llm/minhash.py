"""Near-duplicate groups by one-permutation MinHash with optimal densification.

Text is lower-cased and cut into words: runs of ASCII letters, digits and non-ASCII characters other than white space
and punctuation; each character of a script written without blanks is a word of its own.  Shingles are runs of three
words; a shorter text is one shingle.  One hash of each shingle picks one of 256 bins by its top byte
and leaves its minimum there.  An empty bin copies the first non-empty bin in an order of its own (optimal
densification), so two documents agree in a bin with a probability equal to the Jaccard index of their shingles.
40 bands of 4 bins are hashed into buckets.  Within a bucket each document is compared only with its least id, a
star of ``m - 1`` edges instead of ``m (m - 1) / 2`` pairs; those that turn out unlike it are held against the other
members in blocks (:func:`leftovers`), so no two alike members of a bucket stay apart.  An edge is verified by the
share of equal bins.  Connected edges form groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, small_side

BINS, SHINGLE, BANDS, ROWS = 256, 3, 40, 4
#: Least estimated Jaccard index of a verified edge.
THRESHOLD = 0.5
#: Bytes of text that are hashed at once.
CHUNK = 1 << 18
#: Members of a block of a bucket whose members are unlike its centre.
GRID = 2_048
#: First bytes of characters that are neither punctuation nor white space nor of a script written without blanks:
#: letters of Latin, Greek (without U+0387) and Cyrillic.
PLAIN = (0xC3, 0xC4, 0xC5, 0xCF, 0xD0, 0xD1)
#: RE2: characters that are words of their own, and those between words.
ALONE, BETWEEN = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\x{30FC}\x{FF70}])", r"[\p{Z}\p{P}\x{85}]"


class Hasher:
    """Vectorised signatures of batches of texts.  All arithmetic is modulo 2**64."""

    def __init__(self) -> None:
        rng = np.random.default_rng(20240611)
        self.byte = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 40, 1 << 62)) | 1
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.word = np.zeros(256, bool)
        self.word[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
        self.mult = rng.integers(1, 1 << 63, SHINGLE + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.band = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.order = np.stack([rng.permutation(BINS) for _ in range(BINS)])
        self.powers = self.inverses = np.ones(1, np.uint64)

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            ones = np.ones(n - 1, np.uint64)
            self.powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(ones * self.base)])
            self.inverses = np.concatenate([[np.uint64(1)], np.multiply.accumulate(ones * self.inverse)])

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and how many words each text has.  ``data``: UTF-8 bytes of lower-cased texts."""
        n = len(data)
        is_word = self.word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = is_word[:-1], is_word[1:]
        filled = offsets[:-1] < offsets[1:]
        before[offsets[:-1][filled]] = False
        after[offsets[1:][filled] - 1] = False
        starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
        self._grow(n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(self.byte[data] * self.powers[:n], dtype=np.uint64)])
        hashes = self.mix((sums[ends] - sums[starts]) * self.inverses[starts])
        return hashes, np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])

    def shingles(self, words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each shingle; a text of fewer than SHINGLE words has one."""
        first = np.cumsum(counts) - counts
        padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
        many = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
        owner = np.repeat(np.arange(len(counts)), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + first[owner]
        out = np.zeros(len(at), np.uint64)
        left = counts[owner] - (at - first[owner])
        for k in range(SHINGLE):
            out += np.where(left > k, padded[at + k] + np.uint64(1), np.uint64(0)) * self.mult[k]
        return self.mix(out), owner

    def minima(self, shingles: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Densified minima by text and bin; all ones where a text has no shingle."""
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        out = np.full(n * BINS, none, np.uint64)
        np.minimum.at(out, owner * BINS + (shingles >> np.uint64(56)).astype(np.int64), shingles & np.uint64((1 << 56) - 1))
        out = out.reshape(n, BINS)
        held = out != none
        rows, bins = np.nonzero(~held & held.any(1)[:, None])
        for k in range(BINS):
            if not len(rows):
                break
            source = self.order[bins, k]
            found = held[rows, source]
            out[rows[found], bins[found]] = out[rows[found], source[found]]
            rows, bins = rows[~found], bins[~found]
        return out

    def keys(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Two sums over each text's sequence of words, 128 bits; equal for equal sequences."""
        first = np.cumsum(counts) - counts
        place = (np.arange(len(words)) - np.repeat(first, counts)).astype(np.uint64)
        out = np.zeros((len(counts), 2), np.uint64)
        some = counts > 0
        for k in range(2):
            each = self.mix(words * self.mult[SHINGLE + k] + self.mix(place + self.mult[k]))
            if some.any():
                out[some, k] = np.add.reduceat(each, first[some])
        return out


def spaced(low: pa.Array) -> pa.Array:
    """Texts with a blank for each character between words, and blanks around those that are words of their own."""
    _, offs, data = low.buffers()
    if data is None:
        return low
    offsets = np.frombuffer(offs, np.int64, len(low) + 1, low.offset * 8)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    marked = data >= 0xC0
    for first in PLAIN:
        marked &= data != first
    ends = np.concatenate([[0], np.cumsum(marked)])[offsets - offsets[0]]
    some = pa.array(ends[1:] > ends[:-1])
    if not (ends[-1] > ends[0]):
        return low
    new = pc.replace_substring_regex(pc.replace_substring_regex(low.filter(some), ALONE, r" \1 "), BETWEEN, " ")
    return pc.replace_with_mask(low, some, new)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column(1)))
        sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK, prepend=0)) if len(sizes) else []
        for a, b in zip([0, *cut], [*cut, len(sizes)]):
            if a == b:
                continue
            part = batch.slice(a, b - a)
            raw = part.column(1)
            low = spaced(pa.concat_arrays([pc.utf8_lower(raw).cast(pa.large_string())]))
            _, offs, data = low.buffers()
            offsets = np.frombuffer(offs, np.int64, len(low) + 1, low.offset * 8)
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
            words, counts = hasher.words(data, offsets - offsets[0])
            n = len(low)
            keys = [bytes(k) for k in hasher.keys(words, counts)]
            for i in np.flatnonzero(counts == 0):
                keys[i] = hashlib.blake2b(b"raw" + raw[int(i)].as_py().encode(), digest_size=16).digest()
            minima = hasher.minima(*hasher.shingles(words, counts), n)
            bands = hasher.mix((minima[:, : BANDS * ROWS].reshape(n, BANDS, ROWS) * hasher.band).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(counts > 0, BANDS, 0))]).astype(np.int32)), pa.array(bands[counts > 0].ravel()))
            sig = [row.tobytes() for row in (minima >> np.uint64(32)).astype(np.uint16)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(sig, pa.binary()), bands], names=["id", "key", "sig", "bands"])


def signatures(docs: DataFrame) -> DataFrame:
    """``id, key, sig, bands`` for each row that has an id and a text; ``bands`` is empty for texts without words."""
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL").mapInArrow(_signatures, "id bigint, key binary, sig binary, bands array<bigint>")


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bins of signatures, along the last axis."""
    return (a == b).mean(-1)


def _stack(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint16).reshape(len(sigs), BINS)


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray, n_left: int, threshold: float) -> list[tuple[int, int, float]]:
    """``a, b, jaccard``: links that join whatever is alike between the first ``n_left`` of ``ids`` and the others.

    Each of ``left`` is held against each of ``right``.  Of the alike ones only those links are told that join what
    wasn't joined before, fewer than there are members.
    """
    out, group = [], np.arange(len(ids))
    for i in range(n_left):
        like = similarity(right, left[i])
        near = np.flatnonzero((like >= threshold) & (ids[n_left:] != ids[i])) + n_left
        groups, first = np.unique(group[near], return_index=True)
        new = groups != group[i]
        for j in near[first[new]]:
            a, b = sorted((int(ids[i]), int(ids[j])))
            out.append((a, b, float(like[j - n_left])))
        if new.any():
            group[np.isin(group, groups[new])] = group[i]
    return out


def _compare(threshold: float):
    """Over rows sorted by ``bucket, i, j, whole``: those of ``whole`` 0 against those of 1, within each ``bucket, i, j``."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Each run of rows of equal ``bucket, i, j``, whatever batches it comes in."""
        held: list[pa.Table] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            at = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(at)]
            for a, b in zip(cuts, cuts[1:]):
                if last is not None and (at[a] != last).any():
                    yield pa.concat_tables(held)
                    held = []
                held.append(t.slice(a, b - a))
                last = at[a]
        if held:
            yield pa.concat_tables(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, float]] = []
        for t in groups(batches):
            n = t.column(3).to_pylist().count(0)
            sigs = _stack(t.column(5).to_pylist())
            out += forest(t.column(4).to_numpy(), sigs[:n], sigs[n:], n, threshold)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        yield _links(out)

    return run


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b, jaccard`` of rows ``a, b`` and their signatures."""
    for batch in batches:
        like = similarity(*(_stack(batch.column(k).to_pylist()) for k in (2, 3))) if batch.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like)], names=["a", "b", "jaccard"])


def _links(rows: list[tuple[int, int, float]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "jaccard"])


def leftovers(stars: DataFrame, one: DataFrame, threshold: float) -> DataFrame:
    """Links ``a, b, jaccard`` of members unlike the centre of their bucket, to all other members of that bucket.

    ``stars`` is ``bucket, id, unlike`` without the centres.  What is like the centre is linked through it, so with
    these links no pair of the bucket that is alike stays in two groups.  The members are cut into blocks of about
    GRID rows: each block of unlike ones meets each block of all in a task of bounded memory, which emits fewer links
    than it has rows.  In a bucket of m members, u of them unlike, that are u * m comparisons, vectorised.
    """
    sizes = stars.groupBy("bucket").agg(F.count("*").alias("m"), F.sum(F.col("unlike").cast("bigint")).alias("u")).filter("u > 0 AND m > 1")
    sizes = sizes.select("bucket", F.ceil(F.col("u") / F.lit(GRID)).cast("int").alias("ni"), F.ceil(F.col("m") / F.lit(GRID)).cast("int").alias("nj"))
    members = stars.join(sizes, "bucket").join(one, "id")
    spread = F.xxhash64("id", "bucket")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = members.filter("unlike").select("bucket", F.pmod(spread, F.col("ni")).cast("int").alias("i"), each("nj").alias("j"), F.lit(0).alias("whole"), "id", "sig")
    whole = members.select("bucket", each("ni").alias("i"), F.pmod(spread, F.col("nj")).cast("int").alias("j"), F.lit(1).alias("whole"), "id", "sig")
    placed = rest.unionByName(whole).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "whole")
    return placed.mapInArrow(_compare(threshold), "a bigint, b bigint, jaccard double")


def links(sigs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links ``a < b, jaccard``, each once, of :func:`signatures`; copies of equal words have Jaccard index 1.

    Written to the shared folder; what it was made from is removed.
    """
    sigs = materialize(sigs, "signatures")
    # least ids are combined before they are shuffled, so a text that a third of all rows share is no task's all
    least = sigs.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("key", "a")
    copies = materialize(sigs.select("key", "id").join(least, "key").filter("a < id").select("a", F.col("id").alias("b")).distinct(), "copies")
    # of equal texts only the least id is searched for further
    lone = sigs.select("id", "bands").join(small_side(copies.select(F.col("b").alias("id"))), "id", "left_anti").select("id", F.explode("bands").alias("bucket"))
    # a bucket's hash covers the number of its band
    centres = materialize(lone.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").select("bucket", "a"), "centres")
    stars = materialize(lone.join(centres, "bucket").filter("a < id"), "stars")

    one = sigs.select("id", "sig")
    pairs = stars.select("a", F.col("id").alias("b")).distinct()
    judged = pairs.join(one.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(one.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    # an id of several texts has a row for each
    judged = materialize(judged.select("a", "b", "sa", "sb").mapInArrow(_judge, "a bigint, b bigint, jaccard double").groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")), "judged")
    told = stars.join(judged.select("a", F.col("b").alias("id"), (F.col("jaccard") < threshold).alias("unlike")), ["a", "id"])
    more = leftovers(told.select("bucket", "id", "unlike"), one, threshold)
    found = copies.withColumn("jaccard", F.lit(1.0)).unionByName(judged.filter(F.col("jaccard") >= threshold)).unionByName(more)
    found = materialize(found.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")), "links")
    discard(sigs, copies, centres, stars, judged)
    return found


def components(links: DataFrame) -> DataFrame:
    """``id, group_id`` for all ends of ``links`` (``a, b``); ``group_id`` is the least id of the component.

    Large-star and small-star steps in turn, each a join with the least neighbour, until nothing changes.  Every
    step is written to the shared folder, so lineage stays short.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        if not large:
            both = both.filter("u <= v")
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        out = both.join(least, "v")
        out = out.filter("u > v") if large else out.filter("u <> m").unionByName(least.filter("v <> m").select("v", F.col("v").alias("u"), "m"))
        return out.select(F.col("m").alias("a"), F.col("u").alias("b")).filter("a < b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialize(links.select("a", "b").filter("a < b").distinct(), "edges")
    seen = mark(now)
    while True:
        following = materialize(star(star(now, True), False), "edges")
        discard(now)
        now, last, seen = following, seen, mark(following)
        if last == seen:
            break
    ends = now.select(F.col("b").alias("id"), F.col("a").alias("group_id"))
    return ends.unionByName(ends.select(F.col("group_id").alias("id"), "group_id").distinct())


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, group_id, n_links``: each document of a group of at least two near-duplicates, and how many verified
    links it has (a DOUBLE: the integers of the result are ids); ``group_id`` is the least id.

    Documents without near-duplicates have no row.  Null ids and null texts belong to no group.  Texts without a
    word are near-duplicates only if they are equal, empty ones included.  Rows of the same id are one document;
    where their texts differ, it belongs with the near-duplicates of each.  Texts are taken whole, of any length; ties
    go to the lower id, an empty table gives no rows, extra columns are ignored.
    """
    found = links(signatures(docs), threshold)
    ends = found.select(F.col("a").alias("id")).unionByName(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_links"))
    return components(found).join(ends, "id").select(F.col("id").alias("doc_id"), "group_id", F.col("n_links").cast("double").alias("n_links"))


#: Documents whose id is null, or stands for several rows, are told apart by numbers from this one on.
ODD = 1 << 62


def _gone(sigs: DataFrame, threshold: float) -> DataFrame:
    """``gone``: the ids of all members of groups but the least."""
    found = components(links(sigs, threshold))
    return materialize(found.filter("id <> group_id").select(F.col("id").alias("gone")), "gone")


def drop_near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, that of the least id; all columns stay as they are.

    Here a document is a row's text: of rows that repeat an id and a text one stays, an id of several texts is a
    document for each of them, and rows with a null id take part too; both stand behind rows whose id is their own.
    Rows with a null text are no text's copy and stay; texts without words go only as copies of equal ones.  Very long
    texts are taken whole.  An empty table stays empty, columns may have any names, ids are less than :data:`ODD`.

    Texts aren't shuffled but those of rows with a null or a repeated id.  The ids that go are broadcast if a count
    shows them to be few enough.
    """
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names can't clash
    doc_id, text = (F.col(f"c{docs.columns.index(c)}").cast(kind) for c, kind in (("doc_id", "bigint"), ("text", "string")))
    ids = rows.groupBy(doc_id.alias("id")).agg(F.count("*").alias("n"))
    twice = materialize(ids.filter("id IS NULL OR n > 1").select("id"), "twice")
    plain, odd = rows, None
    if twice.limit(1).count():
        again, same = small_side(twice), text.isNotNull() & doc_id.eqNullSafe(F.col("id"))
        plain = rows.join(again, same, "left_anti")
        # one row of each id and text, combined before the shuffle: a row that is repeated without end is few rows
        once = rows.join(again, same, "left_semi").groupBy(doc_id.alias("id"), text.alias("text")).agg(F.first(F.struct(*rows.columns)).alias("row"))
        odd = materialize(once.select((F.lit(ODD) + F.monotonically_increasing_id()).alias("doc_id"), "text", "row"), "odd")
    told = plain.select(doc_id.alias("doc_id"), text.alias("text"))
    gone = small_side(_gone(signatures(told if odd is None else told.unionByName(odd.select("doc_id", "text"))), threshold))
    out = plain.join(gone, doc_id == F.col("gone"), "left_anti")
    if odd is not None:
        out = out.unionByName(odd.join(gone, F.col("doc_id") == F.col("gone"), "left_anti").select("row.*"))
    return out.toDF(*docs.columns)
