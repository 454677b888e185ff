"""Exact join of documents by Jaccard similarity of word shingles: universe partitioning with one-deletion neighbourhoods.

Sets of sizes a and b with similarity of 3/4 or more differ in at most (a + b) / 7 shingles. Sizes are put into bands a
factor 4/3 apart, so that partners lie in the same or in neighbouring bands. A band has a scheme: the universe of shingles
is hashed into m segments, half as many again as pigeonhole needs. A document may give a segment no point, one (its subset
must be a partner's subset) or two (one of both may lack a shingle of the other); as soon as its points exceed the number of
differences, some segment finds the partner. It is enough that the larger of two partners searches.

Each document sends its segment subsets, three bytes per shingle, to the task of scheme and segment; hashes of subsets and of
their one-deletion neighbourhoods are formed and matched only there. Points are first taken where most rare shingles would have
to agree, so that segments or tasks in which a document has next to nothing, or only what many have, get none. Shingles
that come in several sets of a sample count as common, all others as rare; the sample decides only which of the sufficient
points are taken, not what is found. Where a task holds several segments, the points of its segments are then dealt out
anew by cost: partners differ in some task by less than the larger one has points there, and the task knows how many other
documents every subset and every deletion would meet; the document takes the points that meet fewest.

Within a task of several segments, candidates must differ by less than the larger one has points there, by a parity sketch of
the task's shingles, which bounds the difference from below. Candidates that are connected by others already are not looked at, and a
task sends on its documents' components only, never pairs, so what it sends grows with documents and not with the square
of a group. All documents that tasks connect form a family. Families are compared in blocks, each with itself and with
each other: first by whole sketches, which leaves smaller families, then exactly, by whole sets; every meeting of two
blocks again returns the components of its links. Equal sets are one class from the start. Links inside a component are
therefore not all enumerated; components are exact, without false or missing links.

Defined cases: null and empty texts have no shingles and are alone; fewer than five words are one shingle; rows with equal
ids are separate documents, each in the component of its own text; a null id takes part and is nobody's component id
unless all ids of a component are null; an empty table gives no rows. Sets are 64-bit hashes of shingles and of sets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackspark.llm.components import components
from trackspark.llm.tables import id_and_text, release, small
from trackspark.llm.text import SMALL_SLICE, mix, shingles, slices, words
from trackspark.session import settle

#: Shingles that one task matches at a time.
GROUP = 1_500_000
#: Members beyond which a run is first compared with three of its members, and candidates looked at at a time.
LONG, PAIRS = 256, 1_000_000
#: Longs of the smallest parity sketch.
QUICK = 8
#: Documents and shingles of a block of a family, and exact comparisons between looks at what they connect.
BLOCK, BLOCK_SHINGLES, COMPARED = 2000, 2_000_000, 4096
#: Bytes of a shingle's hash in the exact comparison.
MEMBER = 6
#: Documents whose keys are broadcast to find their texts again (under 50 bytes each); more meet the texts in a shuffled join.
BROADCAST_KEYS = 400_000
#: Bytes of text per step of a task; steps are longer, up to so many times, where there are more tasks than these to deal subsets out to.
STEP, LONGER, MANY_TASKS = 4 << 20, 4, 512
#: One set of so many is looked at for common shingles, which come in this many of those sets; and how many, the most frequent, are told apart.
SAMPLED, COMMON_SETS, COMMON = 64, 3, 1 << 18


@dataclass(frozen=True)
class Scheme:
    """How sets whose larger partner has ``low`` to ``high`` shingles are matched."""

    number: int
    low: int
    high: int
    segments: int
    spare: int


def scheme_of(size: np.ndarray) -> np.ndarray:
    """The band of each set size."""
    return np.searchsorted(_HIGH, size)


def _highs(limit: int = 1 << 40) -> list[int]:
    out = [1]
    while out[-1] < limit:
        out.append(out[-1] * 4 // 3 + 1)
    return out


_HIGH = np.array(_highs())


def scheme(number: int) -> Scheme:
    high = int(_HIGH[number])
    low = int(_HIGH[number - 1]) + 1 if number else 1
    differences = 2 * high // 7
    needed = (differences + 2) // 2
    spare = needed // 2 if needed > 2 else 0
    return Scheme(number, low, high, needed + spare, spare)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _narrow(x: np.ndarray, width: int) -> bytes:
    """The low bytes of unsigned integers."""
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widened(raw: bytes | pa.Buffer, width: int) -> np.ndarray:
    packed = np.frombuffer(raw, np.uint8).reshape(-1, width)
    out = np.zeros((len(packed), 8), np.uint8)
    out[:, :width] = packed
    return out.view(np.uint64).ravel()


def _is_in(x: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(x), bool)
    return ascending[np.minimum(np.searchsorted(ascending, x), len(ascending) - 1)] == x


def _lengths(ascending: np.ndarray) -> bytes:
    """Each value of an ascending array, and how often it comes."""
    values, often = np.unique(ascending, return_counts=True)
    return np.stack((values, often)).astype(np.uint32).tobytes()


def _key(sets: list[np.ndarray]) -> np.ndarray:
    """One hash per set: equal for equal sets, 0 for the empty one."""
    at = np.cumsum([0, *map(len, sets)])
    members = np.concatenate([np.zeros(0, np.uint64), *sets])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(members, 3))))
    total = sums[at[1:]] - sums[at[:-1]]
    return np.where(np.diff(at) > 0, mix(total, 4) | np.uint64(1), np.uint64(0))


def _sets(batch: pa.RecordBatch, step: int = STEP) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """Row at which a step begins, the shingle sets of its documents, and their hashes."""
    begin, size, found = 0, 0, []
    for i, j, raw, at in slices(batch.column(1), SMALL_SLICE):
        if found and size + len(raw) > step:
            yield begin, found, _key(found)
            begin, size, found = i, 0, []
        hashes, _, _, counts = words(raw, at)
        size += len(raw)
        found += shingles(hashes, counts)
    if found:
        yield begin, found, _key(found)


def _sketches(sets: list[np.ndarray]) -> pa.Array:
    """Parity of the number of shingles in each bit; between two and four bits per shingle, a power of two, 512 at least.

    The halves of a sketch, combined by exclusive or, are the sketch of half the size.
    """
    out = []
    for members in sets:
        bits = max(64 * QUICK, 1 << (2 * len(members)).bit_length())
        at = (mix(members, 5) & np.uint64(bits - 1)).astype(np.int64)
        odd = np.bincount(at, minlength=bits).astype(np.uint8) & 1
        out.append(np.packbits(odd).view(np.int64))
    return pa.array(out, pa.list_(pa.int64()))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, sets, key in _sets(batch):
            looked_at = mix(key, 12) % np.uint64(SAMPLED) == 0
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).slice(i, len(sets)) for c in (0, 2, 3)), _signed(key), pa.array([len(s) for s in sets], pa.int64()), _sketches(sets),
                    pa.array([s.view(np.int64) if k else None for s, k in zip(sets, looked_at.tolist(), strict=True)], pa.list_(pa.int64())),
                ],
                ["doc_id", "uid", "print", "key", "n", "sketch", "some"],
            )
    release()


def _common(prints: DataFrame) -> np.ndarray:
    """Shingles that come in several of the sampled sets, ascending."""
    sets = prints.where("some is not null").groupBy("key").agg(F.first("some").alias("some"))
    often = sets.select(F.explode("some").alias("x")).groupBy("x").count().where(F.col("count") >= COMMON_SETS)
    found = often.orderBy(F.desc("count"), "x").limit(COMMON).select("x").toArrow()  # at most COMMON numbers
    return np.sort(found["x"].to_numpy().view(np.uint64))


def _points(own: np.ndarray, length: np.ndarray, rare: np.ndarray, plan: Scheme) -> np.ndarray:
    """0, 1 or 2 points for each subset (a row per segment, a column per document), enough to find every partner that isn't larger.

    With one point a partner agrees in all of a subset's shingles, with two in all but one. Taken are the points that
    leave most rare shingles to agree in, then most shingles, and last those that leave none; which depends on nothing but the
    document's own set. Sets below the scheme's band search in that of their own.
    """
    m = plan.segments
    rest = np.concatenate((length, length - 1))
    value = np.where(rest > 0, np.maximum(np.concatenate((rare, rare - 1)), 0) << 20, (rest - 1) << 20) + rest
    value = np.ascontiguousarray((value * (2 * m) - np.arange(2 * m)[:, None]).T)
    needed = np.minimum(np.where(own >= plan.low, 2 * own // 7 + 1, 0), 2 * m)
    least = np.sort(value, axis=1)[np.arange(len(own)), np.minimum(2 * m - needed, 2 * m - 1)]
    taken = (value >= least[:, None]) & (needed > 0)[:, None]
    return (taken[:, :m] + taken[:, m:].astype(np.int64)).T


def _subsets(groups: dict[int, int], common: np.ndarray):
    """Segment subsets of all sets, packed by the task that matches them."""
    step = STEP * min(LONGER, max(1, sum(groups.values()) // MANY_TASKS))
    schema = pa.schema(
        [("task", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("owner", pa.binary()), ("segment", pa.binary()), ("length", pa.binary()), ("shingles", pa.binary())]
    )

    def pack(sets: list[np.ndarray], keys: np.ndarray, plan: Scheme) -> Iterator[tuple]:
        m, docs = plan.segments, len(sets)
        members = np.concatenate(sets)
        owner = np.repeat(np.arange(docs), [len(s) for s in sets])
        hashed = mix(members, 16 + plan.number)
        cell = (hashed >> np.uint64(33)).astype(np.int64) % m * docs + owner
        low = hashed.astype(np.uint32) & np.uint32(0xFFFFFF)
        order = np.lexsort((low, cell))
        low = low[order]
        length = np.bincount(cell, minlength=m * docs)
        tasks, own = groups[plan.number], np.array([len(s) for s in sets], np.int64)
        rare = np.bincount(cell[~_is_in(members, common)], minlength=m * docs) if len(common) else length
        points = _points(own, length.reshape(m, docs), rare.reshape(m, docs), plan).ravel()
        narrow = np.uint8 if not len(length) or length.max() < 64 else np.uint32
        flagged = (4 * length + points).astype(narrow)
        segment, doc = np.divmod(np.arange(m * docs), docs)
        start = np.cumsum(length) - length
        sizes = own.astype(np.uint32)
        entries = np.arange(m * docs)
        if tasks <= m:
            task = segment * tasks // m
        else:  # several tasks for a segment: by smallest and by second smallest shingle, so that neighbours meet
            parts = -(-tasks // m)
            part = [np.where(length > k, low[np.minimum(start + k, len(low) - 1)] % parts, 0) for k in (0, 1)]
            again = np.flatnonzero((part[0] != part[1]) & (length > 0))
            task = np.concatenate((segment * parts + part[0], segment[again] * parts + part[1][again]))
            entries = np.concatenate((entries, again))
        order = np.lexsort((entries, task))  # by task, then segment, then document
        task, entries = task[order], entries[order]
        cuts = np.flatnonzero(np.diff(task, prepend=-1, append=-2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            here = entries[a:b]
            size = length[here]
            take = np.repeat(start[here] - np.cumsum(size) + size, size) + np.arange(size.sum())
            listed, owner = (slice(None), doc[here]) if tasks <= m else np.unique(doc[here], return_inverse=True)
            yield (
                (plan.number << 40) + int(task[a]), keys[listed].tobytes(), sizes[listed].tobytes(), owner.astype(np.uint16).tobytes(),
                _lengths(segment[here]), flagged[here].tobytes(), _narrow(low[take], 3),
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets, keys in _sets(batch, step):
                _, first = np.unique(keys, return_index=True)
                first = first[keys[first] != 0]
                band = scheme_of(np.array([len(sets[i]) for i in first], np.int64))
                rows = []
                for number in np.union1d(band, band + 1).tolist():
                    plan = scheme(number)
                    # sets of the band itself, and those of the band below that are large enough for a partner in it
                    use = [i for i, b in zip(first, band, strict=True) if b == number or b == number - 1 and 4 * len(sets[i]) >= 3 * plan.low]
                    if use and number in groups:
                        for at in range(0, len(use), 1 << 12):
                            some = use[at : at + (1 << 12)]
                            rows += pack([sets[i] for i in some], keys[some], plan)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], schema=schema)
        release()

    return run


def _matching(groups: dict[int, int]):
    """What one task connects through equal hashes of subsets and of their one-deletion neighbourhoods."""
    def run(key: tuple, table: pa.Table) -> pa.Table:
        number, task = divmod(key[0].as_py(), 1 << 40)
        found = _match(scheme(number), task, groups[number], table)
        release()
        return found

    return run


def _match(plan: Scheme, task: int, tasks: int, table: pa.Table) -> pa.Table:
    """Documents that candidates connect: each but the first of a component, with the first one."""
    keys, sizes, segment, length, low, asked = [], [], [], [], [], []
    listed = [np.frombuffer(raw.as_buffer(), np.uint64) for raw in table.column("keys")]
    # copies in other batches bring the same subsets
    fresh, at = np.zeros(sum(map(len, listed)), bool), 0
    fresh[np.unique(np.concatenate(listed), return_index=True)[1]] = True
    for i, own in enumerate(listed):
        new, at = fresh[at : at + len(own)], at + len(own)
        if not new.any():
            continue
        row = {c: table.column(c)[i].as_buffer() for c in ("sizes", "owner", "segment", "length", "shingles")}
        owner = np.frombuffer(row["owner"], np.uint16)
        parts = np.frombuffer(row["segment"], np.uint32).reshape(2, -1)
        wide = row["length"].size // max(1, len(owner))
        flagged = np.frombuffer(row["length"], np.uint8 if wide == 1 else np.uint32).astype(np.int64)
        use = new[owner]
        keys.append(own[owner[use]])
        sizes.append(np.frombuffer(row["sizes"], np.uint32)[owner[use]])
        segment.append(np.repeat(*parts)[use])
        length.append(flagged[use] >> 2)
        asked.append(flagged[use] & 3)
        low.append(_widened(row["shingles"], 3)[np.repeat(use, flagged >> 2)].astype(np.uint32))
    del listed, fresh
    keys, sizes, segment, length, low, asked = map(np.concatenate, (keys, sizes, segment, length, low, asked))
    values = mix(low.astype(np.uint64) | (np.repeat(segment, length).astype(np.uint64) << np.uint64(32)), 6)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    ends = np.cumsum(length)
    whole = mix(segment.astype(np.uint64), 7 + plan.number) + sums[ends] - sums[ends - length]
    owner = np.repeat(np.arange(len(length)), length)
    far = _Differences(keys, sizes, asked, values, owner, plan, task, tasks)
    many = len(far.keys)
    signature = np.concatenate((whole, whole[owner] - values))
    del values, sums, low, keys, sizes
    order = np.argsort(signature)
    signature = signature[order]
    again = signature[1:] == signature[:-1]
    keep = np.append(again, False) | np.append(False, again)
    signature, order = signature[keep], order[keep]
    entry = np.concatenate((np.arange(len(length)), owner))[order]
    del again, keep, owner
    is_whole = order < len(whole)
    run = np.cumsum(np.append(False, signature[1:] != signature[:-1])[: len(signature)])
    points = far.points(asked, entry, is_whole, run)
    # in a run by size, so that a member meets those before it
    by_size = np.lexsort((far.place[entry], run))
    entry, is_whole, run = entry[by_size], is_whole[by_size], run[by_size]
    place, asks = far.place[entry], points[entry]
    first = np.searchsorted(run, run)
    size = np.bincount(run)[run]
    # whom a member meets: those before it in the run
    begin, length = first.copy(), np.where(asks >= np.where(is_whole, 1, 2), np.arange(len(run)) - first, 0)

    def agree(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two members of each run, the larger one first, and whether the points of that one let them meet."""
        x, y = np.where(place[x] > place[y], x, y), np.where(place[x] > place[y], y, x)
        return x, y, (is_whole[x] & is_whole[y] & (asks[x] > 0)) | ((is_whole[x] != is_whole[y]) & (asks[x] == 2))

    label = _samples(far, agree, place, first, size, length, begin, many)
    searching = np.flatnonzero(length)
    cost = np.cumsum(length[searching])
    for part in np.split(searching, np.searchsorted(cost, np.arange(PAIRS, cost[-1] if len(cost) else 0, PAIRS))):
        often = length[part]
        x = np.repeat(part, often)
        y = np.repeat(begin[part] - np.cumsum(often) + often, often) + np.arange(often.sum())
        x, y, found = agree(x, y)
        x, y = place[x[found]], place[y[found]]
        apart = label[x] != label[y]
        x, y = np.divmod(np.unique(x[apart] * many + y[apart]), max(many, 1))
        keep = far.are_possible(x, y)
        label = _connected(label, x[keep], y[keep])
    rest = np.flatnonzero(label != np.arange(many))
    return pa.table({"key": _signed(far.keys[rest]), "other": _signed(far.keys[label[rest]])})


def _connected(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest number of each component, after the links ``x, y`` are added to those that ``label`` stands for."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while len(np.flatnonzero(label != label[label])):
            label = label[label]


def _samples(
    far: _Differences, agree, place: np.ndarray, first: np.ndarray, size: np.ndarray, length: np.ndarray, begin: np.ndarray, many: int
) -> np.ndarray:
    """Components by comparing the members of long runs with three of them, as far as the two ``agree``.

    Where that connects most of a run, ``length`` and ``begin`` are changed: the connected ones need not meet each other any
    more, only the others meet all members.
    """
    label = np.arange(many)
    chosen = np.flatnonzero(size > LONG)
    if not len(chosen):
        return label
    starts = np.flatnonzero(np.append(True, first[chosen][1:] != first[chosen][:-1])[: len(chosen)])
    chosen = chosen[np.repeat(np.add.reduceat(length[chosen], starts) > 0, np.diff(np.append(starts, len(chosen))))]
    for k in (1, 2, 3):
        x, y, found = agree(chosen, first[chosen] + k * size[chosen] // 4)
        x, y = place[x[found]], place[y[found]]
        keep = (x != y) & far.are_possible(x, y)
        label = _connected(label, x[keep], y[keep])
    starts = np.flatnonzero(np.append(True, first[chosen][1:] != first[chosen][:-1])[: len(chosen)])
    for a, b in itertools.pairwise([*starts.tolist(), len(chosen)]):
        members = chosen[a:b]
        values, count = np.unique(label[place[members]], return_counts=True)
        if 2 * count.max() > len(members):
            out = label[place[members]] != values[count.argmax()]
            begin[members] = first[members]
            length[members] = np.where(out, len(members), 0)
    return label


class _Differences:
    """Bounds on how much documents differ within one task's segments.

    All tasks together have more points of a document than it differs from a partner that isn't larger, so in some task the
    two differ by less than its points there. Parity sketches of the task's shingles bound the differences from below.
    """

    def __init__(self, keys: np.ndarray, sizes: np.ndarray, asked: np.ndarray, values: np.ndarray, owner: np.ndarray, plan: Scheme, task: int, tasks: int):
        known, at, place = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((known, sizes[at]))  # documents are numbered by size
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        self.keys, self.place = known[order], number[place]
        self.sizes, self.plan = sizes[at[order]].astype(np.int64), plan
        self.here = int(np.count_nonzero(np.arange(plan.segments) * tasks // plan.segments == task)) if tasks <= plan.segments else 0
        self.asked = np.bincount(self.place, asked, len(self.keys)).astype(np.int64)
        if self.here > 1:
            longs = max(1, -(-2 * plan.high * self.here // (64 * plan.segments)))
            bits = (mix(values, 11) % np.uint64(64 * longs)).astype(np.int64)
            self.sketch = np.zeros((len(self.keys), longs), np.uint64)
            np.bitwise_xor.at(self.sketch, (self.place[owner], bits >> 6), np.uint64(1) << (bits & 63).astype(np.uint64))

    def points(self, asked: np.ndarray, entry: np.ndarray, is_whole: np.ndarray, run: np.ndarray) -> np.ndarray:
        """0, 1 or 2 for each subset: as many as its document needs here, those that meet fewest others; else those ``asked`` for.

        ``entry``, ``is_whole`` and ``run`` tell which subsets, or deletions of them, have equal hashes.
        """
        if self.here < 2:
            return asked
        wholes, n = np.bincount(run, is_whole), len(asked)
        # one point meets equal subsets; two meet what lacks a shingle, too, and by deletions what has one less
        equal = np.zeros(n)
        equal[entry[is_whole]] = wholes[run[is_whole]] - 1
        more = np.bincount(entry, np.where(is_whole, np.bincount(run)[run] - wholes[run], wholes[run]), minlength=n)
        first, second = np.where(equal <= more, equal, (equal + more) / 2), np.where(equal <= more, more, (equal + more) / 2)
        both, doc = np.concatenate((first, second)), np.tile(self.place, 2)
        order = np.lexsort((both, doc))
        doc = doc[order]
        taken = np.arange(len(doc)) - np.searchsorted(doc, doc) < self.asked[doc]
        return np.bincount(order[taken] % n, minlength=n)

    def are_possible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of places, the larger one first, neither sizes nor sketches exclude."""
        a, b = self.sizes[x], self.sizes[y]
        keep = 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)
        if self.here > 1:
            for part in np.array_split(np.flatnonzero(keep), max(1, keep.sum() * self.sketch.shape[1] // PAIRS)):
                differ = np.bitwise_count(self.sketch[x[part]] ^ self.sketch[y[part]]).sum(1, dtype=np.int64)
                keep[part] = differ < self.asked[x[part]]
        return keep


# --- families ----------------------------------------------------------------------


def _in_blocks(members: DataFrame, listed: DataFrame) -> DataFrame:
    """Members of families, each once for every meeting ``root, i, j`` of its block with another or itself.

    ``members`` has ``root, key, n`` and what else is to travel; ``listed`` has ``root`` and ``n`` of the same ones.
    """
    sizes = listed.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias("parts"))
    rows = members.join(sizes, "root").withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return rows.withColumns({"i": F.least("own", "with"), "j": F.greatest("own", "with")}).drop("with", "parts")


def _meetings(meet):
    """Rows come sorted by meeting; ``meet`` gets the rows of each at once and returns pairs of keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            meeting = [] if batch is None else [batch.column(c).to_numpy() for c in ("root", "i", "j")]
            change = np.zeros(0, np.int64)
            if meeting:
                change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in meeting], axis=0)) + 1
            cuts = [0, *change.tolist(), 0 if batch is None else len(batch)]
            same = bool(held) and bool(meeting) and all(held[-1].column(c)[len(held[-1]) - 1].as_py() == m[0] for c, m in zip(("root", "i", "j"), meeting, strict=True))
            if held and not same:
                yield from _links(meet, held)
                held = []
            for at, (a, b) in enumerate(itertools.pairwise(cuts)):
                if b <= a:
                    continue
                held.append(batch.slice(a, b - a))
                if at + 2 < len(cuts):  # another meeting follows in this batch
                    yield from _links(meet, held)
                    held = []
        release()

    return run


def _links(meet, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(held)
    keys = table["key"].to_numpy()
    _, once = np.unique(keys, return_index=True)  # the same text may have been found twice
    if len(once) > 1:
        table = table.take(pa.array(once))
        label = meet(table)
        rest = np.flatnonzero(label != np.arange(len(label)))
        if len(rest):
            yield pa.RecordBatch.from_arrays([pa.array(keys[once][rest]), pa.array(keys[once][label[rest]])], ["a", "b"])


def _sketched(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a meeting that sizes and sketches, folded to the smaller of the two, do not exclude."""
    n, own = table["n"].to_numpy(), table["own"].to_numpy()
    lists = table["sketch"].combine_chunks()
    longs = lists.value_lengths().to_numpy()
    flat, start = lists.flatten().to_numpy().view(np.uint64), np.cumsum(longs) - longs
    by_size = {int(k): np.flatnonzero(longs == k) for k in np.unique(longs)}
    sketch = {k: flat[start[at][:, None] + np.arange(k)] for k, at in by_size.items()}
    across = table["i"][0].as_py() != table["j"][0].as_py()
    xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for small_, wide in itertools.combinations_with_replacement(sorted(by_size), 2):
        if wide > 4 * small_:  # sizes too far apart
            continue
        a, b = by_size[small_], by_size[wide]
        folded = np.bitwise_xor.reduce(sketch[wide].reshape(len(b), -1, small_), axis=1)
        step = max(1, 4 * PAIRS // (small_ * len(b)))
        for at in range(0, len(a), step):
            i = a[at : at + step]
            differ = np.bitwise_count(sketch[small_][at : at + step][:, None] ^ folded[None]).sum(2, dtype=np.int64)
            least, most = np.minimum(n[i][:, None], n[b][None]), np.maximum(n[i][:, None], n[b][None])
            good = (4 * least >= 3 * most) & (7 * differ <= least + most)
            good &= (own[i][:, None] != own[b][None]) if across else True
            if small_ == wide:
                good &= i[:, None] < b[None]
            x, y = np.nonzero(good)
            xs.append(i[x])
            ys.append(b[y])
    return np.concatenate(xs), np.concatenate(ys)


def _by_sketches(table: pa.Table) -> np.ndarray:
    return _connected(np.arange(len(table)), *_sketched(table))


def _exactly(table: pa.Table) -> np.ndarray:
    """Components of the links of a meeting; pairs that are connected already are not compared."""
    x, y = _sketched(table)
    label = np.arange(len(table))
    sets: dict[int, np.ndarray] = {}

    def members(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = _widened(table["members"][i].as_py(), MEMBER)
        return sets[i]

    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    # one partner for each document first, then all others in turn
    turn = np.arange(len(x)) - np.searchsorted(x, x)
    order = np.argsort(turn, kind="stable")
    x, y = x[order], y[order]
    while len(x):
        good = []
        for i, j in zip(x[:COMPARED].tolist(), y[:COMPARED].tolist(), strict=True):
            a, b = members(i), members(j)
            common = len(np.intersect1d(a, b, assume_unique=True))
            good.append(100 * common >= 75 * (len(a) + len(b) - common))
        good = np.array(good)
        label = _connected(label, x[:COMPARED][good], y[:COMPARED][good])
        x, y = x[COMPARED:], y[COMPARED:]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return label


def _met(members: DataFrame, listed: DataFrame, meet) -> DataFrame:
    """``key, root`` of the members that links connect, from all meetings of blocks."""
    rows = _in_blocks(members, listed).repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    return components(rows.mapInArrow(_meetings(meet), "a long, b long")).withColumnRenamed("node", "key")


def _with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed set of each document that still has its class's text."""
    for batch in batches:
        for i, sets, key in _sets(batch):
            step = batch.slice(i, len(sets))
            use = np.flatnonzero(key.view(np.int64) == step.column("key").to_numpy())
            step = step.take(pa.array(use))
            packed = pa.array([_narrow(sets[k], MEMBER) for k in use.tolist()], pa.binary())
            sketches = _sketches([sets[k] for k in use.tolist()])
            yield pa.RecordBatch.from_arrays([*(step.column(c) for c in ("key", "root", "n")), sketches, packed], ["key", "root", "n", "sketch", "members"])
    release()


def _joined(docs: DataFrame, group: int) -> DataFrame:
    """``doc_id, print, n, key, root, component_id`` of every row: hash of its text, class and component of its set."""
    docs = id_and_text(docs)
    # rows without id are found again by their text; such numbers are negative and never shown
    docs = docs.withColumn("uid", F.coalesce("doc_id", -1 - F.abs(F.xxhash64("text") / 2).cast("long"))).withColumn("print", F.xxhash64("text"))
    prints = settle(docs.mapInArrow(_fingerprints, "doc_id long, uid long, print long, key long, n long, sketch array<long>, some array<long>"))
    classes = settle(prints.where("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("first"), F.min("uid").alias("uid"), F.max("n").alias("n"), F.first("sketch").alias("sketch"),
    ))
    bounds = [int(h) for h in _HIGH]
    band = sum((F.col("n") > h).cast("int") for h in bounds[:60])  # the last of these bands is beyond any text
    sizes = dict(classes.groupBy(band.alias("band")).agg(F.sum("n")).collect())  # one row per band of sizes
    groups = {k: max(1, -(-(sizes.get(k, 0) + sizes.get(k - 1, 0)) // group)) for k in sizes}
    split = any(4 * tasks > scheme(k).segments for k, tasks in groups.items())
    common = _common(prints) if split else np.zeros(0, np.uint64)
    packed = docs.mapInArrow(
        _subsets(groups, common), "task long, keys binary, sizes binary, owner binary, segment binary, length binary, shingles binary"
    )
    connected = packed.groupBy("task").applyInArrow(_matching(groups), "key long, other long")
    families = components(connected.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "key")
    families = settle(families.join(classes.select("key", "n", "sketch"), "key"))
    closer = _met(families, families, _by_sketches)
    wanted = settle(closer.join(classes.select("key", "n", "uid"), "key"))
    found = docs.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_KEYS else wanted, "uid")
    sets = found.select("doc_id", "text", "key", "root", "n").mapInArrow(
        _with_sets, "key long, root long, n long, sketch array<long>, members binary"
    )
    roots = _met(sets, wanted, _exactly)
    named = classes.select("key", "first").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(smallest, "root").select("key", "root", "component_id")
    return prints.select("doc_id", "print", "n", "key").join(named, "key", "left")


def join(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, for similarity 3/4 of five-word shingles.

    ``component_id`` is the smallest id among the documents that links lead to, the document's own included.
    """
    return _joined(docs, group).select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """One row of ``docs`` for each component: of the smallest id, null ids last, and of the smallest hash of the text.

    A row stands for itself, whether its id is repeated, reused for other texts or null. Of rows with the same id and text one
    stays. Rows without words are in no component and all stay.
    """
    rows = settle(_joined(docs, group).where("n > 0").groupBy("root", "doc_id", "print").agg(F.count("*").alias("__rows")))
    best = F.struct(F.col("doc_id").isNull(), "doc_id", "print")
    one = F.struct(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), "__rows")
    kept = settle(rows.groupBy("root").agg(F.min_by(one, best).alias("k"), F.count("*").alias("many")).where("many > 1 or k.__rows > 1"))
    others = rows.join(kept.where("many > 1").select("root", "k"), "root")
    others = others.where(~(F.col("doc_id").eqNullSafe(F.col("k.__id")) & (F.col("print") == F.col("k.__print"))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    with_words = F.coalesce(text.rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    # most documents are alone, so only rows that go, as none, and those that come several times are listed
    goes = others.select(F.col("doc_id").alias("__id"), F.col("print").alias("__print"), F.lit(0).cast("long").alias("__rows"))
    listed = small(goes.unionByName(kept.where("k.__rows > 1").select("k.*")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__print"))
    found = docs.where(with_words).join(listed, same, "left")
    once = found.where("__rows > 1").groupBy("__id", "__print").agg(F.first(F.struct(*columns)).alias("r")).select("r.*")
    return found.where("__rows is null").select(*columns).unionByName(once).unionByName(docs.where(~with_words))


def oracle() -> str:
    """DuckDB SQL for :func:`join` over documents, comparing all documents that share a shingle."""
    return """
    WITH RECURSIVE l AS (SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM l),
    n AS (SELECT doc_id, len(g) AS n FROM s),
    e AS (SELECT doc_id, unnest(g) AS x FROM s),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
    p AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
    r AS (SELECT doc_id, doc_id AS t FROM n UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.t)
    SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.t) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""
