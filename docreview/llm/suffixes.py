"""Removal of repeated passages by longest-previous-factor arrays over sampled suffixes.

A byte goes if it is covered by a string of 50 bytes that also starts in an earlier document. A
suffix array of a whole collection would take many times its size, so suffixes are sampled: in
every string of 50 bytes, the 26-byte gram of least hash is an anchor. Equal strings have equal
anchors at equal places, so only suffixes near a common anchor need to be compared:

1. Whole copies of an earlier text are told by their digest and go as a whole.
2. Hashes first: anchors of the other texts go to the bucket of their gram with a hash of the 74
   bytes around them, no bytes. Where these agree all strings around the anchor agree, so whatever
   is in a later document than the first of them is covered. Grams with several surroundings are
   noted in a bit map.
3. Only anchors of those grams send the bytes around them. There the suffixes that start up to 24
   bytes before an anchor are put in suffix order. A suffix has a longest previous factor of 50 or
   more exactly if the previous or the next suffix of a smaller document in that order shares its
   first 50 bytes.
4. The covered intervals meet the texts again by document.

Grams that are frequent in a sample of the texts, those of common lines, are not gathered by gram:
in step 2 they are by surroundings, in step 3 by the 12 bytes before the anchor and again by the 12
behind its gram. A string around an anchor holds one or the other, so equal strings still meet.
The sample decides where anchors go, never what is found."""

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.llm.common import bounded, text_or_empty
from docreview.session import small_batches, stage

LENGTH = 50
GRAM = 26
#: Grams in a string, and the bytes that a string may start before its anchor.
SPAN = LENGTH - GRAM + 1
BEFORE = SPAN - 1
CONTEXT = BEFORE + LENGTH
#: The map of grams with several surroundings: bits for each, up to so many in all (64 MB). Beyond that
#: it lets more anchors send their bytes than need to.
GRAM_BITS = 16
MAP_BITS = 1 << 29
#: Bytes of text that are sampled for frequent grams, in how many of the sampled texts such a gram is
#: (one in so many, and at least), and how many are remembered.
SAMPLE_BYTES, FREQUENT, FREQUENT_TEXTS, MOST_FREQUENT = 32 << 20, 500, 20, 100_000
#: Bytes beside a frequent gram by which its anchors are parted: half of those that a string has there.
SIDE = (LENGTH - GRAM) // 2
#: Bytes of text per bucket, and bytes that are hashed at a time.
BUCKET_BYTES = 4 << 20
BLOCK = 1 << 17
#: Suffixes that are put in order at a time, by whole grams.
SUFFIXES = 1 << 18
#: Anchors whose surroundings are hashed at a time.
ANCHORS = 1 << 16
#: Bytes of text whose anchors a task holds at a time.
PORTION = 8 << 20
LAST = (1 << 63) - 1
_LOW = np.uint64((1 << 48) - 1)
_ODD = 0x9E3779B97F4A7C15


# ---- anchors -------------------------------------------------------------------------------


def _grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every 26-byte gram, by doubling: 26 = 16 + 8 + 2."""
    power = [pow(_ODD, n, 1 << 64) for n in (1, 2, 4, 8)]
    h1 = data.astype(np.uint64)
    h2 = h1[:-1] * np.uint64(power[0]) + h1[1:]
    h4 = h2[:-2] * np.uint64(power[1]) + h2[2:]
    h8 = h4[:-4] * np.uint64(power[2]) + h4[4:]
    h16 = h8[:-8] * np.uint64(power[3]) + h8[8:]
    n = len(data) - GRAM + 1
    h = (h16[:n] * np.uint64(power[3]) + h8[16 : 16 + n]) * np.uint64(power[1]) + h2[24 : 24 + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h | np.uint64(1)


def _sliding(values: np.ndarray, pick) -> np.ndarray:
    """`pick` over every SPAN = 25 = 16 + 9 values in a row."""
    width = 1
    while 2 * width <= SPAN:
        values = pick(values[:-width], values[width:])
        width *= 2
    rest = SPAN - width
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of texts that lie behind one another in `data`.

    `ends` has the start of the first text and the end of each. Strings across two texts have no
    anchor."""
    places, hashes = [], []
    long = np.flatnonzero(np.diff(ends) >= LENGTH)
    starts, stops = ends[long], ends[long + 1] - LENGTH + 1  # where strings may start
    for at in range(int(ends[0]), int(ends[-1]) - LENGTH + 1, BLOCK):
        count = min(BLOCK, int(ends[-1]) - LENGTH + 1 - at)
        first, last = np.searchsorted(stops, at, "right"), np.searchsorted(starts, at + count, "left")
        if first >= last:
            continue
        edges = np.zeros(count + 1, np.int8)
        edges[np.clip(starts[first:last] - at, 0, count)] += 1
        edges[np.clip(stops[first:last] - at, 0, count)] -= 1
        inside = np.cumsum(edges[:-1], dtype=np.int8) > 0
        grams = _grams(data[at : at + count + LENGTH - 1])
        least = np.where(inside, _sliding(grams, np.minimum), np.uint64(0))
        margin = np.zeros(BEFORE, np.uint64)
        chosen = np.flatnonzero(_sliding(np.concatenate([margin, least, margin]), np.maximum) == grams)
        places.append(chosen + at)
        hashes.append(grams[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, which = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[which]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in portions of at most PORTION bytes of text, or one longer text, which bounds
    the arrays that are made of them."""
    for batch in batches:
        ends = _columns(batch)[3]
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + PORTION, "right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order numbers, marks, bytes and ends of the texts of a batch (order, mark, text)."""
    text = batch.column(2)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint32), data, ends


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors have the least hash around them, so most of these are small numbers: they are mixed
    again, or the first buckets would get nearly all."""
    return ((hashes * np.uint64(_ODD) >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


# ---- packing -------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as planes of bytes, small numbers leaving planes of zeros, compressed."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), -1).T if a.size else np.zeros(0, np.uint8)
        parts.append(struct.pack("<qq4s", len(a), a.size // max(1, len(a)), a.dtype.str[1:].encode()) + planes.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(struct.pack("<q", len(p)) + p for p in parts))


def _unpack(blob: bytes) -> list[np.ndarray]:
    data, at, arrays = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(data):
        (size,) = struct.unpack_from("<q", data, at)
        rows, width, kind = struct.unpack_from("<qq4s", data, at + 8)
        kind = np.dtype(kind.rstrip(b"\0").decode())
        planes = np.frombuffer(data, np.uint8, size - 20, at + 28)
        a = planes.reshape(-1, rows).T.copy().view(kind) if rows else np.zeros((0, 1), kind)
        arrays.append(a.reshape(rows, width) if width > 1 else a.reshape(-1))
        at += 8 + size
    return arrays


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    if len(bucket):
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(bucket)], strict=True):
            yield int(bucket[a]), slice(int(a), int(b))


def _rows(packed: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in packed], pa.int64()), pa.array([p for _, p in packed], pa.binary())], ["bucket", "blob"]
    )


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in columns sorted together."""
    n = len(sorted_columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---- hashes: surroundings of anchors --------------------------------------------------------------


def _mix(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    h = np.full(len(rows), np.uint64(len(rows[0]) if len(rows) else 0))
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    for column in padded.view(np.uint64).T:
        h = (h ^ column) * np.uint64(_ODD)
        h ^= h >> np.uint64(32)
    return h


def _surroundings(place: np.ndarray, data: np.ndarray, ends: np.ndarray):
    """For each anchor its text, how many bytes of the text stand before and from it on (BEFORE and
    LENGTH at most), these bytes, and a hash of all that."""
    text = np.searchsorted(ends, place, "right") - 1
    left = np.minimum(place - ends[text], BEFORE)
    right = np.minimum(ends[text + 1] - place, LENGTH)
    columns = np.arange(-BEFORE, LENGTH, dtype=np.int8)
    margin = np.zeros(LENGTH, np.uint8)
    first, last = int(place.min()), int(place.max()) + 1
    # the stretch that the anchors need; beyond the ends of the data there is nothing
    low, high = max(first - BEFORE, int(ends[0])), min(last + LENGTH, int(ends[-1]))
    stretch = np.concatenate([margin[: low - (first - BEFORE)], data[low:high], margin[: last + LENGTH - high]])
    around = np.lib.stride_tricks.sliding_window_view(stretch, CONTEXT)[place - first]
    around[(columns < -left.astype(np.int8)[:, None]) | (columns >= right.astype(np.int8)[:, None])] = 0
    left, right = left.astype(np.uint8), right.astype(np.uint8)
    return text, left, right, around, _mix(np.column_stack([around, left, right]))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the ascending array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _portions(batches):
        _, _, data, ends = _columns(batch)
        place, grams = anchors(data, ends)
        text = np.searchsorted(ends, place, "right") - 1
        by = np.lexsort((text, grams))
        grams = grams[by][_starts(grams[by], text[by])]
        at = _starts(grams)
        yield pa.RecordBatch.from_arrays(
            [pa.array(grams[at].view(np.int64)), pa.array(np.diff(np.append(at, len(grams))))], ["gram", "n"]
        )


def frequent_grams(rows: DataFrame, total: int) -> np.ndarray:
    """Grams of anchors in many texts of a sample, ascending."""
    share = min(1.0, SAMPLE_BYTES / max(1, total))
    spread = F.pmod(F.xxhash64("order", "mark"), F.lit(1 << 20))
    drawn = rows.where(spread < F.lit(int(share * (1 << 20))))
    counts = drawn.mapInArrow(_sampled, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    least = max(FREQUENT_TEXTS, drawn.count() // FREQUENT)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).collect()
    return np.sort(np.array([r["gram"] for r in top], np.int64).view(np.uint64))


def _class_batches(buckets: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            order, mark, data, ends = _columns(batch)
            place, grams = anchors(data, ends)
            if not len(place):
                continue
            hashed = []
            for at in range(0, len(place), ANCHORS):
                text, left, right, _, content = _surroundings(place[at : at + ANCHORS], data, ends)
                hashed.append((text, left, right, content))
            text, left, right, content = (np.concatenate(c) for c in zip(*hashed, strict=True))
            often = _among(grams, frequent.value)
            bucket = _bucket_of(np.where(often, content, grams), buckets)
            by = np.lexsort((content, grams, bucket))
            place, grams, text, left, right, content, bucket = (x[by] for x in (place, grams, text, left, right, content, bucket))
            yield _rows([
                (k, _pack(
                    np.diff(grams[m], prepend=np.uint64(0)), content[m], left[m], right[m],
                    order[text[m]], mark[text[m]], place[m] - ends[text[m]],
                ))
                for k, m in _slices(bucket)
            ])

    return run


def _classes(buckets: int, frequent):
    """The intervals of one bucket's anchors whose surroundings a smaller document has too, and the
    map of its grams with several surroundings."""
    most = MAP_BITS // buckets // 8 * 8

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table.column("blob").to_pylist()]
        parts = [[np.cumsum(p[0], dtype=np.uint64), *p[1:]] for p in parts]
        gram, content, left, right, order, mark, place = (np.concatenate(c) for c in zip(*parts, strict=True))
        del parts
        by = np.lexsort((content, gram))
        gram, content, left, right, order, mark, place = (x[by] for x in (gram, content, left, right, order, mark, place))
        first = _starts(gram, content)
        sizes = np.diff(np.append(first, len(gram)))
        least = np.repeat(np.minimum.reduceat(order, first), sizes)
        early, late = left.astype(np.int64), np.maximum(LENGTH - right.astype(np.int64), 0)
        hit = (order > least) & (early >= late)  # strings start from `early` to `late` before the anchor
        covered = _joined(order[hit], mark[hit], (place - early)[hit], (place - late)[hit] + LENGTH)
        kinds = gram[first]
        at = _starts(kinds)
        several = kinds[at][np.diff(np.append(at, len(kinds))) > 1]
        several = several[~_among(several, frequent.value)]
        bits = int(np.clip(len(several) * GRAM_BITS // 8 * 8, 8, max(8, most)))
        flags = np.zeros(bits, bool)
        flags[(several & _LOW) % np.uint64(bits)] = True
        n = covered.num_rows
        return pa.table({
            "bucket": pa.array([int(table.column("bucket")[0].as_py())] + [None] * n, pa.int64()),
            "bits": pa.array([np.packbits(flags).tobytes()] + [None] * n, pa.binary()),
            **{c: pa.concat_arrays([pa.array([None], pa.int64()), covered.column(c).combine_chunks()]) for c in covered.column_names},
        })

    return run


def _joined(order: np.ndarray, mark: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Table:
    """Intervals (order, mark, start, stop), joined where they follow each other."""
    if len(order):
        by = np.lexsort((stop, start, mark, order))
        order, mark, start, stop = order[by], mark[by], start[by], stop[by]
        own = np.zeros(len(order), bool)
        own[_starts(order, mark)] = True
        # the reach so far inside a document: texts are numbered so that their reaches do not mix
        text = np.cumsum(own) - 1
        width = int(stop.max()) + 1
        reach = np.maximum.accumulate(stop + text * width) - text * width
        new = own.copy()
        new[1:] |= start[1:] > reach[:-1]
        at = np.flatnonzero(new)
        order, mark, start, stop = order[at], mark[at], start[at], np.maximum.reduceat(stop, at)
    return pa.table({"order": order, "mark": mark.astype(np.int64), "start": start, "stop": stop})


# ---- bytes: suffixes around grams with several surroundings ------------------------------------------


def _suffix_batches(buckets: int, maps, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, starts, bits = maps.value
        for batch in _portions(batches):
            order, mark, data, ends = _columns(batch)
            place, grams = anchors(data, ends)
            bucket = _bucket_of(grams, buckets).astype(np.int64)
            bit = (grams & _LOW) % bits[bucket]
            hit = (flags[starts[bucket] + (bit >> np.uint64(3)).astype(np.int64)] >> (7 - (bit & np.uint64(7))).astype(np.uint8)) & 1 > 0
            often = _among(grams, frequent.value)
            place, grams, often = (x[hit | often] for x in (place, grams, often))
            if not len(place):
                continue
            text, left, right, around, content = _surroundings(place, data, ends)
            if often.any():
                # a frequent gram goes by what is before it, and once more by what is behind
                sides = [
                    _mix(np.column_stack([around[often][:, cut], grams[often].view(np.uint8).reshape(-1, 8)])) ^ np.uint64(k)
                    for k, cut in enumerate((slice(BEFORE - SIDE, BEFORE), slice(BEFORE + GRAM, BEFORE + GRAM + SIDE)))
                ]
                grams = np.concatenate([grams[~often], *sides])
                place, text, left, right, around, content = (
                    np.concatenate([x[~often], x[often], x[often]]) for x in (place, text, left, right, around, content)
                )
            by = np.lexsort((content, grams, _bucket_of(grams, buckets)))
            place, grams, text, content = place[by], grams[by], text[by], content[by]
            first = _starts(grams, content)
            counts = np.diff(np.append(first, len(by)))
            chosen = by[first]
            upto = np.append(first, len(by))
            packed = []
            for k, s in _slices(_bucket_of(grams[first], buckets)):
                m = slice(int(upto[s.start]), int(upto[s.stop]))
                packed.append((k, _pack(
                    grams[first[s]], around[chosen[s]], left[chosen[s]], right[chosen[s]],
                    counts[s], order[text[m]], mark[text[m]], (place - ends[text])[m],
                )))
            yield _rows(packed)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The length of the common beginning of each row of `a` and of `b`."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _longest(group: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row, the longest beginning that it shares with another of its group: in sorted
    order that other is next to it."""
    keyed = np.ascontiguousarray(np.column_stack([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows]))
    by = np.argsort(keyed.view(np.dtype((np.void, keyed.shape[1]))).ravel())
    near = _common(keyed[by[:-1]], keyed[by[1:]]) - 4
    best = np.zeros(len(rows), np.int64)
    best[by[:-1]] = near
    best[by[1:]] = np.maximum(best[by[1:]], near)
    return best


def _previous_factors(keyed: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each suffix the smallest document that shares its first bytes, from the order of suffixes.

    In suffix order the suffixes with one beginning are a run; its longest common prefixes within
    reach that far and those at its ends do not. A suffix has a previous factor exactly if a
    smaller document stands before or after it in its run."""
    by = np.argsort(keyed.view(np.dtype((np.void, keyed.shape[1]))).ravel())
    reach = _common(keyed[by[:-1]], keyed[by[1:]]) >= keyed.shape[1]
    at = np.flatnonzero(np.append(True, ~reach))
    least = np.empty(len(doc), np.int64)
    least[by] = np.repeat(np.minimum.reduceat(doc[by], at), np.diff(np.append(at, len(doc))))
    return least


def _covered(table: pa.Table) -> pa.Table:
    """(order, mark, start, stop): the strings around one bucket's anchors that start in a smaller
    document with other surroundings, joined where they follow each other."""
    parts = [_unpack(b) for b in table.column("blob").to_pylist()]
    gram, around, left, right, counts, order, mark, place = (np.concatenate(c) for c in zip(*parts, strict=True))
    left, right = left.astype(np.int64), right.astype(np.int64)
    # Classes: anchors with the same bytes around them.
    content = _mix(np.column_stack([around, left.astype(np.uint8), right.astype(np.uint8)]))
    by = np.lexsort((content, gram))
    first = _starts(gram[by], content[by])
    class_of = np.empty(len(gram), np.int64)
    class_of[by] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(by))))
    member = np.repeat(class_of, counts)
    chosen = by[first]
    gram, around, left, right = gram[chosen], around[chosen], left[chosen], right[chosen]
    least = np.full(len(first), LAST)
    np.minimum.at(least, member, order)
    early, late = left, np.maximum(LENGTH - right, 0)  # strings start from `early` to `late` before the anchor
    nothing = np.zeros(0, np.int64)
    found = [(nothing, nothing, nothing, nothing)]
    # Grams with several classes: strings may be shared by some of the offsets only.
    group_at = _starts(gram)
    sizes = np.diff(np.append(group_at, len(gram)))
    group = np.repeat(np.arange(len(group_at)), sizes)
    several = np.flatnonzero(np.repeat(sizes > 1, sizes))
    if len(several):
        ahead = _longest(group[several], around[several][:, BEFORE:])
        behind = _longest(group[several], around[several][:, :BEFORE][:, ::-1])
        high = np.minimum(early[several], behind)
        low = np.maximum(late[several], LENGTH - ahead)
        several, high, low = (x[high >= low] for x in (several, high, low))
    # Members of a class follow each other here.
    by = np.argsort(member, kind="stable")
    upto = np.searchsorted(member[by], np.arange(len(first) + 1))
    total = np.cumsum(high - low + 1) if len(several) else nothing
    a = 0
    while a < len(several):
        # whole groups, until their suffixes fill a portion
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + SUFFIXES, "right"))
        b = int(np.searchsorted(group[several], group[several[max(b, a + 1) - 1]], "right"))
        spread = high[a:b] - low[a:b] + 1
        who = np.repeat(several[a:b], spread)
        offset = np.repeat(low[a:b], spread) + np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread)
        keyed = np.empty((len(who), 4 + LENGTH), np.uint8)
        keyed[:, :4] = group[who].astype(">u4").view(np.uint8).reshape(-1, 4)
        step = 1 << 16
        for c in range(0, len(who), step):
            w, o = who[c : c + step], offset[c : c + step]
            keyed[c : c + step, 4:] = around[w[:, None], (BEFORE - o)[:, None] + np.arange(LENGTH)]
        factor = _previous_factors(keyed, least[who])
        news = factor < least[who]  # else the hashes have found it
        who, offset = who[news], offset[news]
        # Every member of the class is later than that document.
        times = upto[who + 1] - upto[who]
        row = by[np.repeat(upto[who], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
        start = place[row] - np.repeat(offset, times)
        part = _joined(order[row], mark[row], start, start + LENGTH)
        found.append(tuple(part.column(k).to_numpy() for k in range(4)))
        a = b
    return _joined(*(np.concatenate(c) for c in zip(*found, strict=True)))


# ---- the texts without what is covered -----------------------------------------------------------


def _cut(data: bytes, starts: list[int] | None, stops: list[int] | None) -> tuple[int, int, str]:
    """Bytes removed, maximal runs removed, and the SHA-256 of the rest."""
    digest, removed, spans, done = hashlib.sha256(), 0, 0, 0
    reach = -1
    for start, stop in sorted(zip(starts or (), stops or (), strict=True)):
        if start > reach:
            digest.update(data[done:start])
            spans += 1
            removed += stop - start
            reach = done = stop
        elif stop > reach:
            removed += stop - reach
            reach = done = stop
    digest.update(data[done:])
    return removed, spans, digest.hexdigest()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, starts, stops = (batch.column(i).to_pylist() for i in (1, 2, 3))
        rows = [_cut(t, a, b) for t, a, b in zip(texts, starts, stops, strict=True)]
        removed, spans, digests = zip(*rows) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()),
                pa.array(spans, pa.int64()), pa.array(digests, pa.string()), batch.column(2), batch.column(3),
            ],
            ["_key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "stops"],
        )


INTERVAL = "order long, mark long, start long, stop long"


def covered_intervals(rows: DataFrame) -> DataFrame:
    """(order, mark, text) -> (order, mark, start, stop) of covered bytes; they may overlap."""
    spark = rows.sparkSession
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, -(-total // BUCKET_BYTES))
    frequent = spark.sparkContext.broadcast(frequent_grams(rows, total))
    classes = stage(
        rows.mapInArrow(_class_batches(buckets, frequent), "bucket long, blob binary").groupBy("bucket")
        .applyInArrow(_classes(buckets, frequent), f"bucket long, bits binary, {INTERVAL}")
    )
    # The map: for each bucket where its bytes start and how many bits it has.
    starts, bits, parts, at = np.zeros(buckets, np.int64), np.full(buckets, 8, np.uint64), [b"\0"], 1
    for r in classes.where("bits IS NOT NULL").select("bucket", "bits").toLocalIterator():  # MAP_BITS in all
        starts[r["bucket"]], bits[r["bucket"]] = at, 8 * len(r["bits"])
        parts.append(bytes(r["bits"]))
        at += len(r["bits"])
    maps = spark.sparkContext.broadcast((np.frombuffer(b"".join(parts), np.uint8), starts, bits))
    partly = rows.mapInArrow(_suffix_batches(buckets, maps, frequent), "bucket long, blob binary").groupBy("bucket").applyInArrow(
        _covered, INTERVAL
    )
    return classes.where("bits IS NULL").select("order", "mark", "start", "stop").unionByName(partly)


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every row of `df`: key, n_bytes, n_removed, n_spans, kept_sha256, starts, stops.

    Texts are their UTF-8 bytes. Every byte goes that a string of 50 bytes covers which also starts
    in a text with a smaller key; the first occurrence stays, overlaps count, and strings are
    judged on the input. `n_spans` counts maximal runs of removed bytes; `starts` and `stops` are
    the intervals found, which may overlap (null if none). The key is an integer; a null key comes
    after all others. Texts with the same key do not remove from each other; repeated rows give
    the same row each. A null text is empty. Other columns are not read. An empty table gives no
    rows. A text that is copied as a whole goes as a whole if it has 50 bytes.

    What is shuffled: digests of texts; about 16 bytes per anchor (one in 13 bytes of text) of texts that
    are no whole copies; 74 bytes around anchors whose gram has several surroundings, once per batch and
    surroundings; the intervals; and the texts that are no whole copies once, to meet theirs."""
    small_batches(df.sparkSession)
    order = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    rows = df.select(
        order.alias("order"), F.col(key).alias("_key"), text_or_empty(text).cast("binary").alias("text"),
        F.md5(text_or_empty(text)).alias("_digest"),
    )
    copies = stage(
        rows.groupBy("_digest").agg(F.min("order").alias("_least"), F.max("order").alias("_most")).where("_least < _most").drop("_most")
    )
    # A mark tells texts of one key apart; where no key repeats it is 0, which packs to nothing.
    again = not rows.groupBy("order").count().where("count > 1").isEmpty()
    mark = F.xxhash64("text").bitwiseAND(F.lit((1 << 32) - 1)) if again else F.lit(0).cast("long")
    marked = rows.withColumn("mark", mark).join(bounded(copies), "_digest", "left")
    copied = F.coalesce(F.col("_least") < F.col("order"), F.lit(False))
    first = marked.where(~copied).select("order", "mark", "_key", "text")
    found = stage(covered_intervals(first.select("order", "mark", "text")))
    intervals = found.groupBy("order", "mark").agg(
        F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops")
    )
    size = F.octet_length("text").cast("long")
    whole = lambda c: F.when(size >= LENGTH, F.array(c))
    judged = first.join(intervals, ["order", "mark"], "left").select("_key", "text", "starts", "stops").unionByName(
        marked.where(copied).select("_key", "text", whole(F.lit(0).cast("long")).alias("starts"), whole(size).alias("stops"))
    )
    schema = T.StructType([
        T.StructField("_key", df.schema[key].dataType), T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("stops", T.ArrayType(T.LongType())),
    ])
    return judged.mapInArrow(_finish, schema).withColumnRenamed("_key", key)
