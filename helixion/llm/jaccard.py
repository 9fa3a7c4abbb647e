"""Exact Jaccard self-join over word shingles by universe-partition pigeonhole.

Two sets of sizes n <= l with similarity of at least 3/4 differ in at most
(n + l) / 7 elements. Elements are hashed into segments of a universe that all
sets of a size band share, so at most that many segments differ and the others
hold the same subset in both. Signatures are hashes of (band, segment, subset):

* Bands are powers of two. A set is indexed in its own band and, if a partner
  may lie there, in the next one.
* Large bands: the subsets of the first H + 1 + slack non-empty segments, H
  being the most differences any partner in that band may have. Of two similar
  sets, the one whose prefix ends first shares at least slack + 1 of its
  signatures, since the other's prefix reaches as far.
* Middle bands: all segments, each with its one-deletion neighbourhood, so that
  a segment bears one difference and counts twice.
* Small bands: every element is a segment of its own.
* Allocation by cost: how many sets share a signature is counted over all data.
  A set probes with its cheapest segments and leaves out the dearest ones as
  long as H + 1 units remain; a passage that many documents share is never
  probed by a document with enough of its own.

A set without H + 1 units (possible in principle) makes its band switch to one
element a segment for all sets; so no pair is lost. Groups of a signature are
never expanded into pairs: each is a star around its most central member, the
best pair of each set is verified, and components merge; this is repeated while
it merges more. Then only members outside their group's main component are
compared with members of others. Every link is verified on whole sets.

Element hashes have 64 bits; similarity is exact but for collisions of those
(under 1e-12 a pair of thousand-shingle documents). Bulk data travel as packed
arrays, partitions hold a fixed volume of input each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import narrow, slices
from .common import SHINGLE_WORDS, Scratch, bit_table, in_bits, touched

#: Bytes of text whose signatures are worked on at a time.
BYTES_A_SLICE = 18_000_000
#: The same for the steps on shared signatures, which are fewer; a pair is told once by each slice that sees it.
BYTES_A_PAIR_SLICE, LEAST_PAIR_SLICES = 45_000_000, 8
#: Partitions of a shuffle; a larger table gives each partition more slices.
MOST_PARTITIONS = 20_000
#: Signatures collected before they are dealt out, about 8 bytes each.
FLUSH = 600_000
#: A signature that so many sets of one task bear isn't counted entry by entry, but as a sum of the task.
OFTEN = 16
#: Signatures of a task that are watched for that.
WATCHED = 500_000
#: Sets in one group at a time; of larger groups, each chunk of so many is worked on apart. At least BYTES / HOT_SHARE,
#: so the table of such signatures has 16 bytes for at most half a HOT_SHARE of them.
GROUP, HOT_SHARE = 250_000, 20_000_000
#: Star rounds before the exhaustive one, at most.
ROUNDS = 3
#: Bits of a set's parity map: two to four times its elements, between these.
LEAST_BITS, MOST_BITS = 128, 4096
MIDDLE, LARGE = 4, 6
FINE = -1
NO_ID = -(1 << 63)
U = np.uint64


def shingles(text: str | None) -> tuple[int, int, np.ndarray]:
    """(64-bit name of the word sequence, a second hash of it, sorted distinct shingle hashes) of a whole text."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0, 0, np.empty(0, U)
    joined = b" ".join(words)
    name = xxhash.xxh3_128_intdigest(joined)
    if len(words) <= SHINGLE_WORDS:
        found = np.array([xxhash.xxh3_64_intdigest(joined)], U)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[: -SHINGLE_WORDS].tolist()]
        h = xxhash.xxh3_64_intdigest
        found = np.unique(np.array([h(joined[s:e]) for s, e in zip(starts, (ends[SHINGLE_WORDS - 1 :] - 1).tolist(), strict=True)], U))
    return ((name >> 64) | 1) - (1 << 63), (name & ((1 << 64) - 1)) - (1 << 63), found


def segments_of(band: int, coarse: int = 1) -> int:
    """Segments of a band's universe; FINE: each element is one. coarse: so many times fewer than usual."""
    if band < MIDDLE:
        return FINE
    return int((1 << (band + 1)) / (3 if band < LARGE else 2.4)) // coarse


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(29))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(32))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def instances(n: int) -> list[tuple[int, int, int]]:
    """(0 own band or 1 next, band, H) for a set of n elements."""
    band, most = n.bit_length() - 1, 4 * n // 3
    top = (1 << (band + 1)) - 1
    out = [(0, band, (n + min(most, top)) // 7)]
    return out + [(1, band + 1, (n + most) // 7)] if most > top else out


def signatures(h: np.ndarray, band: int, most: int, fine: bool = False, coarse: int = 1) -> tuple[np.ndarray, np.ndarray, int, int]:
    """(signatures, their segments, units a segment, units to spare) of sorted hashes h; to spare < 0: this partition can't do.

    With one unit a segment, each signature is its own segment.
    """
    m = FINE if fine else segments_of(band, coarse)
    salt = mix(np.array([band * 2 + (m == FINE)], U))[0]
    if m == FINE:
        take = min(len(h), most + 1 + len(h) // 12)
        return mix(h[:take] ^ salt), np.arange(take), 1, take - most - 1
    # h is sorted, so segments (equal slices of the hash space) are runs of it.
    seg = ((h >> U(32)) * U(m)) >> U(32)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(seg)) + 1))
    body = mix(h)
    whole = np.add.reduceat(body, starts)
    ids = seg[starts]
    tag = mix(ids + salt)
    if band >= LARGE:
        take = min(len(starts), most + 1 + len(h) // 12)
        return mix(whole[:take] ^ tag[:take]), ids[:take].astype(np.int64), 1, take - most - 1
    sizes = np.diff(np.append(starts, len(h)))
    each = np.repeat(np.arange(len(starts)), sizes)
    rest = sizes[each] > 1  # an empty rest says nothing
    deleted = mix((whole[each] - body)[rest] ^ tag[each][rest])
    units = int(np.where(sizes > 1, 2, 1).sum())
    return np.concatenate((mix(whole ^ tag), deleted)), np.concatenate((ids, ids[each][rest])).astype(np.int64), 2, units - most - 1


# ------------------------------------------------------- dealing signatures


@dataclass(frozen=True)
class Parts:
    """n partitions by signature, each worked on in ``subs`` slices, one after the other: a slice holds a fixed volume however large the table is."""

    n: int
    subs: int

    @classmethod
    def of(cls, volume: int, each: int, least: int) -> Parts:
        slices = max(least, -(-volume // each))
        n = min(MOST_PARTITIONS, slices)
        return cls(n, -(-slices // n))

    def part(self, keys: np.ndarray) -> np.ndarray:
        return (((keys >> U(32)) * U(self.n)) >> U(32)).astype(np.int64)

    def sub(self, keys: np.ndarray) -> np.ndarray:
        return (((keys & U(0xFFFFFFFF)) * U(self.subs)) >> U(32)).astype(np.int64)


@dataclass
class Pack:
    """Signatures with their owners: heads has a column an owner, whose last number counts its entries; keys and marks have a value an entry."""

    heads: np.ndarray
    keys: np.ndarray
    marks: np.ndarray
    maps: list[bytes]

    def which(self) -> np.ndarray:
        return np.repeat(np.arange(self.heads.shape[1]), self.heads[-1])

    def only(self, entries: np.ndarray) -> Pack:
        heads = self.heads.copy()
        heads[-1] = np.bincount(self.which()[entries], minlength=heads.shape[1])
        return Pack(heads, self.keys[entries], self.marks[entries], self.maps)

    def dealt(self, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row a place, with the owners that have entries there."""
        which = self.which()
        order = np.lexsort((which, place))
        if not len(order):
            return
        which, place, keys, marks = which[order], place[order], self.keys[order], self.marks[order]
        at = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (which[1:] != which[:-1]))))
        heads = self.heads[:, which[at]]
        ends = np.append(at, len(order))
        heads[-1] = np.diff(ends)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(place[at])) + 1, [len(at)]))
        rows = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            i, j = ends[a], ends[b]
            rows.append((int(place[i]), heads[:, a:b].tobytes(), keys[i:j].tobytes(), marks[i:j].tobytes(), [self.maps[x] for x in which[at[a:b]]] if self.maps else None, None, None))
            if len(rows) == 256:
                yield blobs_of(rows)
                rows = []
        if rows:
            yield blobs_of(rows)


BLOBS = "place int, heads binary, keys binary, marks binary, maps array<binary>, facts binary, known binary"
_BLOB_TYPES = (pa.int32(), *[pa.binary()] * 3, pa.list_(pa.binary()), *[pa.binary()] * 2)


def blobs_of(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _BLOB_TYPES, strict=True)], [x.split()[0] for x in BLOBS.split(", ")])


def opened(rows: list[dict], columns: int) -> Pack:
    return Pack(
        np.concatenate([np.frombuffer(r["heads"], np.int64).reshape(columns, -1) for r in rows], axis=1),
        np.concatenate([np.frombuffer(r["keys"], U) for r in rows]), np.concatenate([np.frombuffer(r["marks"], np.int32) for r in rows]),
        [m for r in rows for m in r["maps"] or ()],
    )


def sliced(blobs: DataFrame, parts: Parts, columns: int, work: Callable[[Pack], Iterator[pa.RecordBatch]], schema: str, aside: Callable[[dict], Iterator[pa.RecordBatch]] | None = None) -> DataFrame:
    """work on each slice of each partition. Rows with facts are worked on aside.

    Several slices: a partition deals its blobs again, and Spark sorts them by
    slice, on disk if need be; so Python holds one slice.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in slices(batches, 256):
            yield from batch.to_pylist()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for r in rows(batches):
            if r["facts"] is not None or r["known"] is not None:
                yield blobs_of([tuple(r.values())])
                continue
            held.append(r)
            n += len(r["keys"]) // 8
            if n >= FLUSH:
                pack = opened(held, columns)
                yield from pack.dealt(parts.sub(pack.keys))
                held, n = [], 0
        if held:
            pack = opened(held, columns)
            yield from pack.dealt(parts.sub(pack.keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for r in rows(batches):
            if r["facts"] is not None or r["known"] is not None:
                yield from aside(r)
                continue
            if held and held[-1]["place"] != r["place"]:
                pack = opened(held, columns)
                held = [r]
                yield from work(pack)
            else:
                held.append(r)
        if held:
            pack = opened(held, columns)
            held.clear()
            yield from work(pack)

    dealt = blobs.repartitionById(parts.n, F.col("place"))
    if parts.subs > 1:
        dealt = dealt.mapInArrow(split, BLOBS).sortWithinPartitions("place")
    return dealt.mapInArrow(run, schema)


def firsts(*columns: np.ndarray) -> np.ndarray:
    """Where in sorted columns a new value begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def groups(keys: np.ndarray, *owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of entries without repeats of one owner, start of each signature's group in it), only signatures of two owners or more."""
    order = np.argsort(keys, kind="stable")
    at = firsts(keys[order])
    size = np.diff(np.append(at, len(order)))
    order = order[np.repeat(size > 1, size)]
    order = order[np.lexsort((*(o[order] for o in owner), keys[order]))]
    order = order[firsts(keys[order], *(o[order] for o in owner))]
    at = firsts(keys[order])
    size = np.diff(np.append(at, len(order)))
    order = order[np.repeat(size > 1, size)]
    return order, firsts(keys[order])


# ---------------------------------------------------------------- signatures


class Watch:
    """Counts the signatures that a task meets more than once at a time."""

    def __init__(self):
        self.keys, self.n = np.empty(0, U), np.empty(0, np.int64)

    def sizes(self, keys: np.ndarray) -> np.ndarray:
        """For each entry how often its signature came in this task, as far as watched."""
        k, of, n = np.unique(keys, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.keys, k)
        known = np.zeros(len(k), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == k
        self.n[at[known]] += n[known]
        n[known] = self.n[at[known]]
        new = ~known & (n > 1)
        keys, total = np.concatenate((self.keys, k[new])), np.concatenate((self.n, n[new]))
        if len(keys) > WATCHED:
            most = np.argpartition(-total, WATCHED)[:WATCHED]
            keys, total = keys[most], total[most]
        order = np.argsort(keys)
        self.keys, self.n = keys[order], total[order]
        return n[of]


def index(docs: DataFrame, parts: Parts, fine: frozenset[int] | None = None, coarse: int = 1) -> DataFrame:
    """Blobs of signatures by name of the set, and rows aside with packed facts of the documents. fine: only these bands, one element a segment.

    A signature that a task has met OFTEN goes no further entry by entry: its
    entries are known to be shared and are told aside, and one entry without a
    name stands for their sum.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushes = TaskContext.get().partitionId(), 0
        watch, seen, facts, heads, keys, marks, held = Watch(), set(), [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal flushes, held
            at = xxhash.xxh32_intdigest(f"{part}:{flushes}") % parts.n
            flushes += 1
            told = np.array(facts, np.int64).tobytes() if facts else None
            if heads:
                pack = Pack(np.array(heads, np.int64).T, np.concatenate(keys), np.concatenate(marks).astype(np.int32), [])
                facts.clear(), heads.clear(), keys.clear(), marks.clear()
                held = 0
                size = watch.sizes(pack.keys)
                often = size >= OFTEN
                known = None
                if often.any():
                    which = pack.which()[often]
                    known = np.stack((pack.heads[0][which], pack.heads[1][which], pack.marks[often], pack.keys[often].view(np.int64), size[often])).tobytes()
                    k, n = np.unique(pack.keys[often], return_counts=True)
                    sums = Pack(np.array([[0], [0], [len(k)]]), k, -n.astype(np.int32), [])
                    yield from sums.dealt(parts.part(k))
                    pack = pack.only(~often)
                yield from pack.dealt(parts.part(pack.keys))
                if told or known:
                    yield blobs_of([(at, None, None, None, None, told, known)])
            elif told:
                facts.clear()
                yield blobs_of([(at, None, None, None, None, told, None)])

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sid, second, h = shingles(text)
                spare, n = [0, 0], 0
                if len(h):
                    for which, band, most in instances(len(h)):
                        if fine is not None and band not in fine:
                            continue
                        sigs, seg, unit, spare[which] = signatures(h, band, most, fine is not None, coarse)
                        if (sid, second) not in seen:
                            keys.append(sigs)
                            marks.append(np.full(len(sigs), which) if unit == 1 else which | 2 | seg << 2)
                            n += len(sigs)
                    if n:
                        heads.append((sid, second, n))
                        held += n
                    seen.add((sid, second))
                if fine is None:
                    facts.append((NO_ID if doc_id is None else doc_id, sid, second, len(h), *spare))
                if held >= FLUSH or len(facts) >= 100_000:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BLOBS)


FACTS = "kind int, sid long, second long, doc_id long, n int, spare0 int, spare1 int, marks binary, keys binary, sizes binary"
_FACT_TYPES = (pa.int32(), *[pa.int64()] * 3, *[pa.int32()] * 3, *[pa.binary()] * 3)


def told_of(kind: int, **columns) -> pa.RecordBatch:
    names, rows = [x.split()[0] for x in FACTS.split(", ")], len(columns["sid"])
    columns["kind"] = np.full(rows, kind, np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(rows, t) for c, t in zip(names, _FACT_TYPES, strict=True)], names)


def by_set(sid: np.ndarray, second: np.ndarray, marks: np.ndarray, keys: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 of entries."""
    order = np.lexsort((second, sid))
    sid, second, marks, keys, sizes = (v[order] for v in (sid, second, marks.astype(np.int32), keys, sizes.astype(np.int64)))
    cuts = np.append(firsts(sid, second), len(sid)).tolist()
    for a in range(0, len(cuts) - 1, 4096):
        c = cuts[a : a + 4097]
        cells = {name: [x[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)] for name, x in (("marks", marks), ("keys", keys), ("sizes", sizes))}
        yield told_of(1, sid=sid[c[:-1]], second=second[c[:-1]], **cells)


def count_groups(blobs: DataFrame, parts: Parts, hot: int) -> DataFrame:
    """kind 0: facts of a document. kind 1: of a set, its signatures in a slice that other sets share, and by how many. kind 2: a signature (as sid) of at least ``hot`` sets, and how many (as second)."""

    def work(pack: Pack) -> Iterator[pa.RecordBatch]:
        which = pack.which()
        sid, second = pack.heads[0][which], pack.heads[1][which]
        # Each sum is its own owner: by its place.
        order, starts = groups(pack.keys, np.where(sid == 0, np.arange(len(sid)), second), sid)
        if not len(order):
            return
        weight = np.where(sid[order] == 0, -pack.marks[order].astype(np.int64), 1)
        total = np.add.reduceat(weight, starts)
        big = total >= hot
        if big.any():
            yield told_of(2, sid=pack.keys[order][starts[big]].view(np.int64), second=total[big])
        size = np.repeat(total, np.diff(np.append(starts, len(order))))
        real = sid[order] != 0
        order = order[real]
        yield from by_set(sid[order], second[order], pack.marks[order], pack.keys[order], size[real])

    def aside(row: dict) -> Iterator[pa.RecordBatch]:
        if row["facts"]:
            f = np.frombuffer(row["facts"], np.int64).reshape(-1, 6).T
            yield told_of(0, doc_id=f[0], sid=f[1], second=f[2], n=f[3].astype(np.int32), spare0=f[4].astype(np.int32), spare1=f[5].astype(np.int32))
        if row["known"]:
            k = np.frombuffer(row["known"], np.int64).reshape(5, -1)
            yield from by_set(k[0], k[1], k[2], k[3].view(U), k[4])

    return sliced(blobs, parts, 3, work, FACTS, aside)


def allocate(shared: DataFrame, spared: dict[int, int]) -> DataFrame:
    """id, n, score, keys, probe: per set its shared signatures, which of them it probes, and how many sets meet it there.

    shared: id, spare0, spare1, n, and the packed arrays of all slices.
    spared: the least units to spare of any set in a large band; similar sets
    share more signatures than that, so a set that shares no more has no partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for row in batch.to_pylist():
                marks = np.concatenate([np.frombuffer(x["marks"], np.int32) for x in row["parts"]])
                keys = np.concatenate([np.frombuffer(x["keys"], U) for x in row["parts"]])
                sizes = np.concatenate([np.frombuffer(x["sizes"], np.int64) for x in row["parts"]])
                # Several tasks may have told a signature of one set; the largest sum stands.
                order = np.lexsort((-sizes, marks, keys))
                order = order[firsts(keys[order], marks[order])]
                marks, keys, sizes = marks[order], keys[order], sizes[order]
                probe, keep = np.ones(len(keys), bool), np.ones(len(keys), bool)
                for which in (0, 1):
                    at = (marks & 3) == which
                    if at.sum() <= spared.get(row["n"].bit_length() - 1 + which, -1):
                        keep[at] = False
                    for deletes in (0, 2):
                        at = np.flatnonzero((marks & 3) == which | deletes)
                        spare = row[f"spare{which}"] // (2 if deletes else 1)
                        if not len(at) or spare <= 0:
                            continue
                        seg = np.arange(len(at)) if not deletes else np.unique(marks[at] >> 2, return_inverse=True)[1]
                        cost = np.zeros(seg.max() + 1, np.int64)
                        np.maximum.at(cost, seg, sizes[at])
                        probe[at[np.isin(seg, np.argsort(-cost, kind="stable")[:spare])]] = False
                if keep.any():
                    # Sums of tasks count only as OFTEN, which all of them reach: so scores of sets told by different tasks compare.
                    out.append((row["id"], row["n"], int(np.minimum(sizes - 1, OFTEN - 1)[keep].sum()), keys[keep].tobytes(), probe[keep].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["id", "n", "score", "keys", "probe"])

    return shared.mapInArrow(run, "id long, n int, score long, keys binary, probe binary")


def parities(h: np.ndarray) -> bytes:
    """For each residue whether oddly many of the elements have it; as many residues as a power of two from twice the set's size."""
    b = min(MOST_BITS, max(LEAST_BITS, 2 << max(0, len(h) - 1).bit_length()))
    bits = np.bincount((h % U(b)).astype(np.int64), minlength=b) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, words: int) -> np.ndarray:
    """A parity map for fewer residues: halves laid over each other."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, U).reshape(-1, words), axis=0)


# --------------------------------------------------------------------- pairs


@dataclass(frozen=True)
class Hot:
    """Sorted signatures of very large groups, and into how many chunks each group is cut (0: nobody probes it)."""

    keys: np.ndarray
    chunks: np.ndarray

    def of(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.ones(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.chunks[at], 1)


PROBES, LEFT, RIGHT = 1, 2, 4


def spread(pack: Pack, hot: Hot, turn: int | None) -> Pack:
    """Entries of hot signatures, under keys of their own by chunk; chunks are other ones each turn.

    No turn: a chunk meets each other one, LEFT or RIGHT, and itself.
    """
    c = hot.of(pack.keys)
    if (c == 1).all():
        return pack
    which = pack.which()
    chunk = (mix(pack.heads[0][which].astype(U) ^ mix(pack.keys + U((turn or 0) + 1))) % np.maximum(c, 1).astype(U)).astype(np.int64)
    if turn is not None:
        return Pack(pack.heads, np.where(c > 1, mix(pack.keys ^ mix(chunk.astype(U) + U(1))), pack.keys), pack.marks, pack.maps)
    each = np.repeat(np.arange(len(c)), c)
    other = np.arange(len(each)) - np.repeat(np.cumsum(c) - c, c)
    mine, c = chunk[each], c[each]
    tile = np.minimum(mine, other) * c + np.maximum(mine, other) + 1
    keys = np.where(c > 1, mix(pack.keys[each] ^ mix(tile.astype(U))), pack.keys[each])
    side = np.where(mine == other, 0, np.where(mine < other, LEFT, RIGHT)).astype(np.int32)
    heads = pack.heads.copy()
    heads[-1] = np.bincount(which[each], minlength=heads.shape[1])
    return Pack(heads, keys, pack.marks[each] | side, pack.maps)


@dataclass
class Open:
    """Entries of the groups that somebody probes and that hold several components, in order of group, then size of the set."""

    sid: np.ndarray
    n: np.ndarray
    label: np.ndarray
    score: np.ndarray
    marks: np.ndarray
    group: np.ndarray
    map_at: np.ndarray
    maps: list[bytes]


def open_groups(pack: Pack) -> Open | None:
    """pack's heads: per set its id, size, label, score, and number of entries."""
    map_at = pack.which()
    sid, n, label, score = (pack.heads[i][map_at] for i in range(4))
    order, starts = groups(pack.keys, sid, n)
    if not len(order):
        return None
    sid, n, label, score, marks, map_at = (v[order] for v in (sid, n, label, score, pack.marks, map_at))
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    several = np.maximum.reduceat(label, starts) != np.minimum.reduceat(label, starts)
    keep = (several & (np.bincount(group, marks & PROBES, len(starts)) > 0))[group]
    return Open(*(v[keep] for v in (sid, n, label, score, marks, group, map_at)), pack.maps) if keep.any() else None


def pair_counts(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs, and how often each came."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.empty(0, np.int64)
    return x[at], y[at], np.diff(np.append(at, len(x))).astype(np.int64)


def rays(g: Open) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centre, member, n): of each member its most frequent centre in two stars a group, linear in the group.

    The first star is around the most central member of the group's main
    component, the second around the most central of the others; rays go to
    members of other components that are neither too long nor too short.
    """
    xs, ys = [], []
    at = np.arange(len(g.sid))
    for _ in range(2):
        if not len(at):
            break
        order = np.lexsort((g.label[at], g.group[at]))
        a = at[order]
        new = np.concatenate(([True], (g.group[a[1:]] != g.group[a[:-1]]) | (g.label[a[1:]] != g.label[a[:-1]])))
        count = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
        a = a[np.lexsort((g.sid[a], -g.score[a], -count, g.group[a]))]
        first = np.concatenate(([True], g.group[a[1:]] != g.group[a[:-1]]))
        centre = a[np.flatnonzero(first)[np.cumsum(first) - 1]]
        other = g.label[a] != g.label[centre]
        a, centre = a[other], centre[other]
        near = 4 * np.minimum(g.n[a], g.n[centre]) >= 3 * np.maximum(g.n[a], g.n[centre])
        xs.append(g.sid[centre[near]])
        ys.append(g.sid[a[near]])
        at = a
    x, y, n = pair_counts(np.concatenate(xs), np.concatenate(ys))
    order = np.lexsort((-n, y))
    x, y, n = x[order], y[order], n[order]
    best = np.concatenate(([True], y[1:] != y[:-1])) if len(y) else np.empty(0, bool)
    return x[best], y[best], n[best]


def crossings(g: Open) -> Iterator[pa.RecordBatch]:
    """Members outside their group's main component with those of other components, unless sizes or parity maps rule them out.

    A group is in order of size, so what a set may link with is one run of it.
    """
    xs, ys, held = [], [], 0

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v) for v in pair_counts(np.concatenate(xs), np.concatenate(ys))], ["x", "y", "n"])

    edges = np.append(firsts(g.group), len(g.group))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        sid, n, label, marks, of_map = g.sid[a:b], g.n[a:b], g.label[a:b], g.marks[a:b], g.map_at[a:b]
        probe, side = marks & PROBES, marks & (LEFT | RIGHT)
        _, of, count = np.unique(label, return_inverse=True, return_counts=True)
        width = min(len(g.maps[m]) for m in of_map) // 8
        bits = np.stack([folded(g.maps[m], width) for m in of_map])
        low, high = np.searchsorted(n, (3 * n + 3) // 4), np.searchsorted(n, 4 * n // 3, "right")
        for i in np.flatnonzero(of != np.argmax(count)):
            run = np.s_[low[i] : high[i]]
            j = low[i] + np.flatnonzero((label[run] != label[i]) & (probe[run] | probe[i] > 0) & ((side[run] != side[i]) | (side[i] == 0)))
            j = j[np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64) <= (n[j] + n[i]) // 7]
            xs.append(np.minimum(sid[i], sid[j]))
            ys.append(np.maximum(sid[i], sid[j]))
            held += len(j)
            if held > 1_000_000:
                yield told()
                xs, ys, held = [], [], 0
    if xs:
        yield told()


def pairs_from(entries: DataFrame, parts: Parts, hot: Broadcast, turn: int | None) -> DataFrame:
    """x, y, n: pairs to verify, y being the member. entries: id, n, score, keys, probe, label, bits.

    By turns of ``rays``; without a turn, of ``crossings``. Groups nobody probes give none.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            rows = batch.to_pylist()
            keys = [np.frombuffer(r["keys"], U) for r in rows]
            heads = np.array([[r["id"], r["n"], r["label"], r["score"], len(k)] for r, k in zip(rows, keys, strict=True)], np.int64).T
            probe = np.concatenate([np.frombuffer(r["probe"], bool) for r in rows]).astype(np.int32)
            pack = spread(Pack(heads, np.concatenate(keys), probe, [] if turn is not None else [r["bits"] for r in rows]), hot.value, turn)
            # Any dealing by key keeps a signature's group together.
            yield from pack.dealt(parts.part(mix(pack.keys)))

    def work(pack: Pack) -> Iterator[pa.RecordBatch]:
        if g := open_groups(pack):
            if turn is None:
                yield from crossings(g)
            else:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in rays(g)], ["x", "y", "n"])

    dealt = entries.select("id", "n", "score", "label", "keys", "probe", *(["bits"] if turn is None else [])).mapInArrow(deal, BLOBS)
    return sliced(dealt, parts, 5, work, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))


def hot_groups(told: DataFrame, entries: DataFrame, group: int) -> Hot:
    """The signatures of very large groups; those that no set probes have no chunk. The table is bounded: see HOT_SHARE."""
    rows = told.filter("kind = 2").groupBy("sid").agg(F.max("second").alias("size")).toArrow()
    keys, size = rows["sid"].to_numpy().view(U), rows["size"].to_numpy()
    order = np.argsort(keys)
    keys, size = keys[order], size[order]
    if not len(keys):
        return Hot(keys, size)
    held = entries.sparkSession.sparkContext.broadcast(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            probed = np.concatenate([np.frombuffer(k, U)[np.frombuffer(p, bool)] for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
            probed = np.unique(probed)
            yield pa.RecordBatch.from_arrays([pa.array(probed[np.isin(probed, held.value)].view(np.int64))], ["key"])

    probed = entries.select("keys", "probe").mapInArrow(run, "key long").distinct().toArrow()["key"].to_numpy().view(U)
    return Hot(keys, np.where(np.isin(keys, probed), -(-size // group), 0))


# -------------------------------------------------------------- verification


def token_sets(scratch: Scratch, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, rep, set, bits: sorted shingle hashes of the wanted(id, rep, sid, second, some_id), from their whole texts, and their parity map.

    A bit table of the wanted ids spares most other texts the work; sets are
    joined by name, so ids that repeat or are null make no difference.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in slices(batches):
            got = []
            for text in batch.column(0).to_pylist():
                sid, second, h = shingles(text)
                if len(h) and (sid, second) not in seen:
                    seen.add((sid, second))
                    got.append((sid, second, h.tobytes(), parities(h)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["sid", "second", "set", "bits"])

    bits = scratch.cut(bit_table(wanted, F.xxhash64("some_id")), "bits").scalar()
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text").filter(in_bits(bits, F.xxhash64("doc_id")))
    sets = rows.select("text").mapInArrow(run, "sid long, second long, set binary, bits binary")
    # Tasks that met the same text each brought its set.
    return sets.join(wanted.select("sid", "second", "id", "rep"), ["sid", "second"]).dropDuplicates(["sid", "second"]).select("id", "rep", "set", "bits")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v: the pairs (x, y) that link, 100 * intersection >= 75 * union, as nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                p, q = np.frombuffer(a, U), np.frombuffer(b, U)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                keep.append(4 * both >= 3 * (len(p) + len(q) - both))
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("x"), F.col("rep").alias("xr"), F.col("set").alias("a"))
    two = sets.select(F.col("id").alias("y"), F.col("rep").alias("yr"), F.col("set").alias("b"))
    found = pairs.select("x", "y").join(two, "y").join(one, "x").select("x", "xr", "y", "yr", "a", "b").mapInArrow(run, "x long, xr long, y long, yr long")
    return found.select(node("x", "xr").alias("u"), node("y", "yr").alias("v"))


def node(id_: str, rep: str) -> Column:
    """A set as a node: sets with an id come first, by the least one; so a component's least node bears its least id."""
    return F.struct(F.col(rep).isNull().alias("none"), F.col(rep).alias("rep"), F.col(id_).alias("id"))


#: Nodes whose edges are dealt over SALTS tasks: the HUBS of most edges, of at least HUB each; any other node has less than a 1 / HUBS of all ends.
HUBS, HUB, SALTS = 1000, 100, 64


def _join_nodes(many: DataFrame, one: DataFrame, hubs: list[int]) -> DataFrame:
    """many(u, v) with one(u, m), which has each u once."""
    if not hubs:
        return many.join(one, "u")
    hub = F.col("u.id").isin(hubs)
    many = many.withColumn("salt", F.when(hub, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    one = one.withColumn("salt", F.explode(F.when(hub, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return many.join(one, ["u", "salt"]).drop("salt")


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """id, label, component_id: of all nodes of links(u, v), the least node of the component, its own id and the document's.

    Alternating stars: each node's larger neighbours move to its least one, then
    its smaller ones do. Minima are pre-aggregated, the edges of hubs are salted;
    the number of rounds is logarithmic.
    """
    edges = scratch.cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = [r[0] for r in both.groupBy("u.id").count().filter(F.col("count") >= HUB).orderBy(F.desc("count")).limit(HUBS).collect()]
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _join_nodes(both.filter("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # A node's edges here are at most those to smaller nodes before: the same hubs.
        small = _join_nodes(large, low, hubs).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = scratch.cut(small, "edges")
        scratch.drop(edges)
        edges = new
    out = edges.unionByName(edges.select(F.col("v").alias("u"), "v").distinct())
    out = scratch.cut(out.select(F.col("u.id").alias("id"), F.col("v.id").alias("label"), F.col("v.rep").alias("component_id")), "components")
    scratch.drop(edges)
    return out


def similarity_components(spark: SparkSession, docs: DataFrame, coarse: int = 1, slice_bytes: int = BYTES_A_SLICE, group: int = GROUP) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text).

    coarse: divides the number of segments; the bands where that is too few switch.
    slice_bytes: text whose signatures a task holds at a time. group: sets in one
    group at a time; larger groups are worked on in chunks.

    Null and wordless texts have no shingles and are components of their own.
    Equal word sequences are one set, whatever ids they come under; so repeated
    ids and rows are counted each, and the component of rows that have only null
    ids is null. A very long text is one row of one task. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    with narrow(spark):
        return _components_of(spark, docs, coarse, slice_bytes, group)


def _components_of(spark: SparkSession, docs: DataFrame, coarse: int, slice_bytes: int, group: int) -> DataFrame:
    scratch = Scratch(spark, "jaccard")
    volume = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = Parts.of(volume, slice_bytes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pair_parts = Parts.of(volume, slice_bytes * BYTES_A_PAIR_SLICE // BYTES_A_SLICE, LEAST_PAIR_SLICES)
    group = max(group, volume // HOT_SHARE)
    told = scratch.cut(count_groups(index(docs, parts, None, coarse), parts, group), "counted")
    scratch.release()
    facts = told.filter("kind = 0").select("doc_id", "sid", "second", "n", "spare0", "spare1")
    # Equal sets become one; ids are summed up before the shuffle, so hot copies are no hot keys. A name has 127 bits; a set's short id is its place in this table.
    sets = facts.filter("n > 0").groupBy("sid", "second").agg(
        F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("rep"), F.min("doc_id").alias("some_id"), F.max("n").alias("n"), F.min("spare0").alias("spare0"), F.min("spare1").alias("spare1"),
    )
    sets = scratch.cut(sets.withColumn("id", F.monotonically_increasing_id()), "sets")
    shared = told.filter("kind = 1").select("sid", "second", "marks", "keys", "sizes")
    short = sets.select(F.explode(F.array(F.when(F.col("spare0") < 0, F.length(F.bin("n")) - 1), F.when(F.col("spare1") < 0, F.length(F.bin("n"))))).alias("band")).filter("band IS NOT NULL").distinct()
    bands = frozenset(int(r[0]) for r in short.collect())  # at most 64
    if bands:
        again = scratch.cut(count_groups(index(docs, parts, bands), parts, group), "counted")
        told = told.unionByName(again)
        shared = shared.unionByName(again.filter("kind = 1").select("sid", "second", "marks", "keys", "sizes"))
        # What they can spare differs between the two ways; probe with everything then.
        fine = [F.length(F.bin("n")) + i for i in (-1, 0)]
        numbered = sets.withColumns({f"spare{i}": F.when(fine[i].isin(*bands), F.lit(0)).otherwise(F.col(f"spare{i}")) for i in (0, 1)})
    else:
        numbered = sets
    least = numbered.select(F.explode(F.array(*[F.struct((F.length(F.bin("n")) - 1 + i).alias("band"), F.col(f"spare{i}").alias("spare"), (F.lit(i == 0) | (F.floor(F.col("n") * 4 / 3) >= F.pow(F.lit(2), F.length(F.bin("n"))))).alias("there")) for i in (0, 1)])).alias("x")).select("x.*")
    least = least.filter(f"there AND band >= {LARGE}").groupBy("band").agg(F.min("spare").alias("spare"))
    spared = {r["band"]: max(0, r["spare"]) for r in least.collect() if r["band"] not in bands}  # at most 64 rows
    parted = shared.groupBy("sid", "second").agg(F.collect_list(F.struct("marks", "keys", "sizes")).alias("parts"))  # a set's signatures, bounded by its text
    entries = scratch.cut(allocate(parted.join(numbered.select("sid", "second", "id", "n", "spare0", "spare1"), ["sid", "second"]), spared), "entries")
    scratch.release()
    hot = spark.sparkContext.broadcast(hot_groups(told, entries, group))
    wanted = entries.select("id").join(sets.select("id", "rep", "sid", "second", "some_id"), "id")
    tokens = scratch.cut(token_sets(scratch, docs, wanted), "tokens")
    labels = entries.select("id", F.col("id").alias("label"))
    scratch.release()
    links, tried, before = None, None, 0
    for turn in range(ROUNDS):
        named = entries.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
        found = pairs_from(named, pair_parts, hot, turn)
        best = found.groupBy("y").agg(F.max_by("x", F.struct("n", "x")).alias("x")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        best = scratch.cut(best if tried is None else best.join(tried, ["x", "y"], "left_anti"), "best")
        scratch.release()
        linked = verify(best, tokens)
        links = scratch.cut(linked if links is None else links.unionByName(linked), "links")
        tried = best if tried is None else tried.unionByName(best)
        labels = components(scratch, links)
        now = links.count()
        if now == before:
            break
        before = now
    named = entries.join(labels.select("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    rest = scratch.cut(pairs_from(named.join(tokens.select("id", "bits"), "id"), pair_parts, hot, None).select("x", "y").join(tried, ["x", "y"], "left_anti"), "rest")
    links = scratch.cut(links.unionByName(verify(rest, tokens)), "links")
    scratch.drop(tokens, rest, entries)
    final = components(scratch, links).select("id", "component_id", F.lit(True).alias("linked"))
    scratch.release()
    of_set = sets.join(final, "id", "left").select("sid", "second", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("rep")).alias("component_id"))
    of_set = scratch.cut(of_set, "of_set")
    real = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    # A text in very many rows is a hot key here; Spark splits the rows' side of such a join at run time.
    return facts.join(of_set, ["sid", "second"], "left").select(real.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") == 0, real).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of docs that stand for their component: those with its least id.

    Rows that repeat an id and its text become one row. Rows with a null id stay
    where their whole component has none.
    """
    scratch = Scratch(spark, "kept")
    found = scratch.cut(similarity_components(spark, docs).select(F.col("doc_id").alias("_d"), F.col("component_id").alias("_c")), "found")
    by_id = scratch.cut(found.groupBy("_d").agg(F.count("*").alias("n"), F.bool_or(F.expr("_d <=> _c")).alias("kept")).filter("n > 1 OR NOT kept"), "by_id")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")
    rows = docs.select(row, docs["doc_id"].alias("_id"), F.xxhash64(docs["text"]).alias("_t"))
    # Only rows that an id's mark may concern are shuffled.
    marked, clear = touched(scratch, rows, F.col("_id").cast("long"), by_id.select("_d"))
    marked = marked.join(by_id, F.col("_id").cast("long").eqNullSafe(F.col("_d")), "left").filter("coalesce(kept, true)")
    return clear.select("_row.*").unionByName(marked.dropDuplicates(["_id", "_t"]).select("_row.*"))


#: DuckDB text: all pairs that share a shingle, exact similarity, reachability.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id
)
SELECT documents.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.root) AS component_id
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id JOIN r ON r.doc_id = documents.doc_id GROUP BY documents.doc_id
"""
