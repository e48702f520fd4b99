"""Exact removal of repeated byte strings: hash-compared suffix sort of the places that can repeat.

Every 200-byte window has an anchor: its 64-byte string of least hash (the leftmost of equals). Equal windows have
equal anchors at equal places, so only windows whose anchor occurs twice can repeat, and anchors, about one for each
70 bytes, are all that is counted over the whole corpus. Windows that start at an anchor or at a text's edge are
compared by two hashes of different kinds (the polynomial of the anchor, XXH3 of the 200 bytes: 128 bits); between two
repeated ones that overlap nothing is left to find. What is left are windows at the borders of repeats: the bytes
around their anchors. Equal surroundings of equal anchors become one variant with a count, whose places are repeats as a
whole; bytes of equal digests are compared. An anchor's variants go to one task, where suffixes of one alignment are
sorted by merging: two suffixes are compared through prefix hashes, binary search finds their common extension, and
the byte after it decides. Suffixes whose hash of 200 bytes no other has are left out before. Neighbours that share
200 bytes are compared byte by byte before they count. What is found of a variant goes back to its places. Anchors
with more than LIMIT variants are not gathered: digests of their windows are counted over the cluster instead.

Defined results: null or empty text has no bytes and nothing removed; texts under 200 bytes keep all; equal rows are
texts of their own, so each loses what the other has; a text's own repeats count, overlapping ones too; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import steps, table, utf8, written
from tidemark.llm.shingles import BASE, INVERSE, mix, powers
from tidemark.llm.spans import pack, remove_spans, text_crc

WINDOW = 200
GRAM = 64
#: Variants of an anchor that one task sorts at most, and places of a variant that one task gives its spans to.
LIMIT = 10_000
SECOND = mix(np.arange(1, 257, dtype=np.uint64))
#: Anchors whose suffixes are sorted at a time.
ROWS_AT_ONCE = 2_000
#: Windows of one or more alignments that are sorted at a time (a single alignment has LIMIT at most).
WINDOWS_AT_ONCE = 500_000
#: Distinct surroundings whose bytes a task has at hand to compare.
VARIANTS_HELD = 50_000
#: Digests of hot windows that are broadcast at most (16 MB).
LOOKED_UP = 1_000_000
#: Windows of hot anchors that are tested together first.
CELL = 8
#: Distinct digests that a task holds before it sends their numbers.
HELD = 500_000


class Prefixes:
    """Prefix polynomial hashes of a byte string, modulo 2 ** 64, over mixed byte values."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SECOND[data] * powers(BASE, len(data)), out=self.sums[1:])
        self.scale = powers(INVERSE, len(data) + 1)

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.scale[start]

    def common(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        """Length of the common extension of the strings at a and b, up to limit, by binary search."""
        low, step = np.zeros(len(a), np.int64), 1 << limit.bit_length() - 1
        while step:
            longer = low + step
            fits = longer <= limit
            longer = np.where(fits, longer, low)
            same = fits & (self.hash(a, longer) == self.hash(b, longer))
            low = np.where(same, longer, low)
            step >>= 1
        return low

    def less(self, a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
        n = self.common(a, b, limit)
        ends = n >= limit
        n = np.where(ends, 0, n)
        return ~ends & (self.data[a + n] < self.data[b + n])


def sort_suffixes(text: Prefixes, starts: np.ndarray, segment: np.ndarray, limit: int = WINDOW) -> np.ndarray:
    """Order of suffixes, cut to `limit` bytes, within segments (numbers that ascend): a stable bottom-up mergesort of all segments at once."""
    n = len(starts)
    order = np.arange(n)
    first = np.searchsorted(segment, segment)  # where each place's segment begins
    last = np.searchsorted(segment, segment, side="right")
    width, largest = 1, int((last - first).max(initial=0))
    place = np.arange(n) - first
    while width < largest:
        right = place // width % 2 == 1
        # The run that each element's run is merged with.
        begin = first + (place // width + np.where(right, -1, 1)) * width
        low = np.minimum(begin, last)
        high = np.minimum(begin + width, last)
        base = low.copy()
        active = np.flatnonzero(low < high)
        while len(active):
            middle = (low[active] + high[active]) >> 1
            mine, other = starts[order[active]], starts[order[middle]]
            # Of equals those of the left run come first.
            r = right[active]
            a, b = np.where(r, mine, other), np.where(r, other, mine)
            less = text.less(a, b, limit)
            before = np.where(r, ~less, less)  # the other element goes before mine
            low[active] = np.where(before, middle + 1, low[active])
            high[active] = np.where(before, high[active], middle)
            active = active[low[active] < high[active]]
        pair = first + place // (2 * width) * 2 * width
        to = pair + place % width + (low - base)
        new = np.empty(n, np.int64)
        new[to] = order
        order = new
        width *= 2
    return order


def repeated_windows(text: Prefixes, starts: np.ndarray, segment: np.ndarray, limit: int = WINDOW) -> np.ndarray:
    """Which of the suffixes share their first `limit` bytes with another of their segment."""
    out = np.zeros(len(starts), bool)
    # A suffix whose hash of `limit` bytes no other of its segment has is none of them.
    hashes = text.hash(starts, limit)
    by = np.lexsort((hashes, segment))
    equal = (segment[by[1:]] == segment[by[:-1]]) & (hashes[by[1:]] == hashes[by[:-1]])
    likely = np.sort(by[np.append(equal, False) | np.append(False, equal)]) if len(by) else by
    starts, segment = starts[likely], segment[likely]
    order = sort_suffixes(text, starts, segment, limit)
    a, b = starts[order[:-1]], starts[order[1:]]
    near = np.flatnonzero((segment[:-1] == segment[1:]) & (text.hash(a, limit) == text.hash(b, limit)))
    for at in range(0, len(near), 20_000):  # equal hashes are checked byte by byte
        some = near[at : at + 20_000]
        place = np.arange(limit)
        same = (text.data[a[some, None] + place] == text.data[b[some, None] + place]).all(1)
        near[at : at + 20_000] = np.where(same, some, -1)
    near = near[near >= 0]
    out[likely[order[near]]] = True
    out[likely[order[near + 1]]] = True
    return out


def anchors(docs: DataFrame) -> DataFrame:
    """The anchors of each text with the first and last window start that has them, and two edge windows (first > last)."""
    names = ["doc_id", "text_crc", "at", "first", "last", "gram", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in steps(batches, limit=1 << 20):
            data, starts = utf8(batch.column(1))
            sizes = np.diff(starts)
            if not (sizes >= WINDOW).any():
                continue
            text = Prefixes(data)
            n = len(data)
            grams = mix(text.hash(np.arange(n - GRAM + 1), GRAM))
            low = grams >> np.uint64(32) << np.uint64(32) | np.arange(len(grams), dtype=np.uint64)
            span, reach = WINDOW - GRAM + 1, 1
            least = low
            while 2 * reach <= span:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            rest = span - reach
            least = np.minimum(least[: len(least) - rest], least[rest:])
            anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the window that starts there
            row = np.repeat(np.arange(len(sizes)), sizes)[: n - WINDOW + 1]
            inside = np.arange(n - WINDOW + 1) + WINDOW <= starts[row + 1]
            windows = np.flatnonzero(inside)
            new = np.ones(len(windows), bool)
            new[1:] = (anchor[windows[1:]] != anchor[windows[:-1]]) | (row[windows[1:]] != row[windows[:-1]])
            first = windows[new]
            last = windows[np.append(np.flatnonzero(new)[1:], len(windows)) - 1]
            at, doc = anchor[first], row[first]
            long = np.flatnonzero(sizes >= WINDOW)
            edges = np.setdiff1d(np.concatenate([starts[long], starts[long + 1] - WINDOW]), at)  # each start once
            edge_doc = row[edges]
            doc = np.concatenate([doc, edge_doc])
            at = np.concatenate([at, edges])
            first, last = (np.concatenate([x, starts[edge_doc] + k]) for x, k in ((first, 0), (last, -1)))
            whole = at + WINDOW <= starts[doc + 1]
            raw = data.tobytes()
            wholes = np.array([digest(raw[a : a + WINDOW]) for a in np.where(whole, at, 0).tolist()], np.uint64)
            base = starts[doc]
            rows = pa.array(doc)
            columns = [batch.column(0).take(rows), batch.column(2).take(rows)]
            columns += [pa.array((x - base).astype(np.int32)) for x in (at, first, last)]
            columns.append(pa.array(grams[at].view(np.int64)))
            columns.append(pa.array(wholes.view(np.int64), mask=~whole))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_crc(F.col("text")).alias("text_crc"))
    return rows.mapInArrow(run, "doc_id long, text_crc long, at int, first int, last int, gram long, whole long")


PLACE = ["doc_id", "text_crc", "at", "first", "last"]


def shared_anchors(docs: DataFrame) -> DataFrame:
    """Anchors that occur at two places or more, with the number of places."""
    found = written(anchors(docs), "suffix-anchors")
    places = found.groupBy("gram").agg(F.count("*").alias("places")).filter("places > 1")
    return found.join(places, "gram").select(*PLACE, "gram", "whole", "places")


def open_grams(flagged: DataFrame) -> DataFrame:
    """Grams of anchors some of whose windows aren't between repeated windows that meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat = lists.flatten()
            at, first, last, gram = (flat.field(k).to_numpy() for k in ("at", "first", "last", "gram"))
            repeated = flat.field("repeated").to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists), dtype=np.int64), np.diff(lists.offsets.to_numpy()))
            known = np.unique((row << 32 | at)[repeated])  # repeated starts of all texts in order
            wide = np.concatenate([[0], np.cumsum(np.diff(known) > WINDOW)])
            # A run of windows is closed if known starts reach from before it to after it without a gap.
            low = np.searchsorted(known, row << 32 | first, side="right") - 1
            high = np.searchsorted(known, row << 32 | last)
            inside = (low >= 0) & (high < len(known))
            closed = np.zeros(len(row), bool)
            i = np.flatnonzero(inside)
            closed[i] = (known[low[i]] >> 32 == row[i]) & (known[high[i]] >> 32 == row[i]) & (wide[high[i]] == wide[low[i]])
            yield pa.RecordBatch.from_arrays([pa.array(gram[~closed & (first <= last)], pa.int64())], names=["gram"])

    place = F.struct("at", "first", "last", "gram", "repeated")
    texts = flagged.groupBy("doc_id", "text_crc", "copy").agg(F.collect_list(place).alias("places"))
    return texts.select("places").mapInArrow(run, "gram long").distinct()


AROUND = "doc_id long, text_crc long, gram long, ahead int, at int, places long, variant binary, bytes binary"
VARIANT = ["gram", "ahead", "variant"]
CARRIED = [*VARIANT, "places"]


def surroundings(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """For each wanted anchor a digest of the bytes of all its windows (variant), and where the first of these is before it (ahead).

    A task sends the bytes themselves once for each of the last VARIANTS_HELD variants it has met; for others they are null.
    """
    lists = wanted.groupBy("doc_id", "text_crc").agg(F.collect_set(F.struct("at", "first", "last", "gram", "places")).alias("wanted"))
    lists = lists.select(F.col("doc_id").alias("want_doc"), F.col("text_crc").alias("want_crc"), "wanted")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_crc(F.col("text")).alias("text_crc"), pack(F.col("text").cast("string")).alias("packed"))
    same = packed["doc_id"].eqNullSafe(lists["want_doc"]) & (packed["text_crc"] == lists["want_crc"])
    names = [x.split()[0] for x in AROUND.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from xxhash import xxh3_128_digest

        unpack = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []
        held: dict[bytes, bytes] = {}

        def batch() -> pa.RecordBatch:
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in batches:
            for doc, crc, blob, places in zip(*(c.to_pylist() for c in part.columns), strict=True):
                text = unpack(blob)
                for p in places:
                    around = text[p["first"] : p["last"] + WINDOW]
                    variant = xxh3_128_digest(around)
                    known = held.get(variant)
                    if known is None:
                        if len(held) >= VARIANTS_HELD:
                            held.clear()
                        held[variant] = around
                    elif known != around:
                        raise ValueError("two strings with one 128-bit digest")
                    rows.append((doc, crc, p["gram"], p["at"] - p["first"], p["at"], p["places"], variant, around if known is None else None))
                    if len(rows) >= 5000:
                        yield batch()
        if rows:
            yield batch()

    joined = packed.join(lists, same).select("doc_id", "text_crc", "packed", "wanted")
    return joined.mapInArrow(run, AROUND)


def variants(around: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each distinct surroundings of an anchor with its number n: those of anchors with up to LIMIT of them, and those of others."""
    found = around.groupBy(*VARIANT).agg(F.count("*").alias("n"), F.max("places").alias("places"), F.min("bytes").alias("bytes"), F.max("bytes").alias("also"))
    # Each task has sent the bytes of a variant at least once: of all that were sent least and greatest are the same.
    same = F.when(F.col("bytes") == F.col("also"), F.col("bytes")).otherwise(F.raise_error(F.lit("two strings with one 128-bit digest")).cast("binary"))
    found = written(found.select(*VARIANT, "n", "places", same.alias("bytes")), "suffix-variants")
    few, many = found.filter(F.col("places") <= LIMIT), found.filter(F.col("places") > LIMIT)
    hot = written(many.groupBy("gram").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > LIMIT).select("gram"), "suffix-hot")
    return few.union(many.join(hot, "gram", "left_anti").select(*few.columns)), many.join(hot, "gram", "left_semi").select(*few.columns)


FOUND = "gram long, ahead int, variant binary, places long, low int, high int"


def sorted_repeats(kinds: DataFrame) -> DataFrame:
    """For each variant the bytes from its first to its last repeated window, from the anchor on, by sorting the suffixes around equal anchors."""
    dealt = kinds.select(*CARRIED, "n", "bytes").repartition("gram").sortWithinPartitions("gram")

    def solved(whole: pa.Table) -> pa.RecordBatch:
        whole = whole.combine_chunks()
        gram, ahead, n = (whole.column(c).to_numpy() for c in ("gram", "ahead", "n"))
        sizes = np.diff(utf8(whole.column("bytes").combine_chunks())[1])
        first = -ahead.astype(np.int64)
        begin, end, found = first.copy(), first + sizes, n > 1
        mates = np.searchsorted(gram, gram, side="right") - np.searchsorted(gram, gram)
        rep = np.flatnonzero(mates > 1)
        if len(rep) and not found.all():
            data, starts = utf8(whole.column("bytes").combine_chunks().take(pa.array(rep)))
            text = Prefixes(data)
            windows = sizes[rep] - WINDOW + 1
            record = np.repeat(np.arange(len(rep), dtype=np.int32), windows)
            step = (np.arange(len(record)) - np.repeat(np.cumsum(windows) - windows, windows)).astype(np.int32)
            # Windows of one alignment can be equal, others can't.
            group = np.cumsum(np.append(True, gram[rep][1:] != gram[rep][:-1])) * (WINDOW + 1)
            key = group[record] + ahead[rep][record] - step
            order = np.argsort(key, kind="stable")
            key = key[order]
            dup = np.zeros(len(record), bool)
            at = 0
            while at < len(order):
                stop = min(at + WINDOWS_AT_ONCE, len(order))
                if stop < len(order):  # an alignment isn't cut
                    cut = int(np.searchsorted(key, key[stop]))
                    stop = cut if cut > at else int(np.searchsorted(key, key[stop], side="right"))
                some = order[at:stop]
                dup[some] = repeated_windows(text, starts[record[some]] + step[some], key[at:stop])
                at = stop
            _widest(np.flatnonzero(dup), record, step, rep, first, begin, end, found)
        row = pa.array(np.flatnonzero(found))
        columns = [whole.column(c).combine_chunks().take(row) for c in CARRIED]
        return pa.RecordBatch.from_arrays([*columns, pa.array(begin[found].astype(np.int32)), pa.array(end[found].astype(np.int32))], names=[*CARRIED, "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = pa.Table.from_batches([batch.slice(at, ROWS_AT_ONCE)])
                held = part if held is None else pa.concat_tables([held, part])
                gram = held.column("gram").to_numpy()
                # An anchor's variants (LIMIT at most) stay together: the last of them may go on in the next rows.
                done = int(np.searchsorted(gram, gram[-1]))
                if done:
                    yield solved(held.slice(0, done))
                    held = held.slice(done)
        if held is not None and held.num_rows:
            yield solved(held)

    return dealt.mapInArrow(run, FOUND)


def _widest(hits: np.ndarray, record: np.ndarray, step: np.ndarray, rows: np.ndarray, first: np.ndarray, begin: np.ndarray, end: np.ndarray, found: np.ndarray) -> None:
    """Set begin, end and found of rows[record] from its first to its last hit, where it isn't found yet: windows of one anchor overlap, so the bytes between are covered."""
    if not len(hits):
        return
    of = record[hits]
    head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    tail = np.append(head[1:], len(hits)) - 1
    new = ~found[rows[of[head]]]
    head, tail = head[new], tail[new]
    row = rows[of[head]]
    begin[row], end[row] = first[row] + step[hits[head]], first[row] + step[hits[tail]] + WINDOW
    found[row] = True


def _windows_of(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, number, place in the joined bytes and offset from the anchor of each window of each row."""
    starts = utf8(part.column("bytes"))[1]
    n = np.diff(starts) - WINDOW + 1
    record = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(record)) - np.repeat(np.cumsum(n) - n, n)
    return record, step, starts[record] + step, part.column("ahead").to_numpy().astype(np.int64)[record] - step


def _digests(text: Prefixes, at: np.ndarray, length: int, salt: np.ndarray) -> np.ndarray:
    """128 bits for each string of `length` bytes, as two columns: the polynomial hash, and XXH3."""
    from xxhash import xxh3_64_intdigest as digest

    raw = text.data.tobytes()
    other = np.array([digest(raw[a : a + length]) for a in at.tolist()], np.uint64)
    return np.column_stack([mix(text.hash(at, length) + salt), other])


def _cells(text: Prefixes, record: np.ndarray, at: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of what the CELL windows of near offsets have in common, one for each cell of a row, and each window's cell."""
    cell = offset // CELL
    new = np.append(True, (record[1:] != record[:-1]) | (cell[1:] != cell[:-1])) if len(record) else np.zeros(0, bool)
    core = (at + offset - cell * CELL)[new]
    return _digests(text, core, WINDOW - CELL + 1, cell[new].astype(np.uint64)), np.cumsum(new) - 1


def _known(two: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which digests are among the known, which are sorted."""
    at = np.searchsorted(known[:, 0], two[:, 0])
    out = np.zeros(len(two), bool)
    for _ in range(np.unique(known[:, 0], return_counts=True)[1].max(initial=0)):  # one step, but for equal first halves
        here = np.minimum(at, len(known) - 1)
        out |= (known[here] == two).all(1)
        at += 1
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, ROWS_AT_ONCE) for batch in batches for at in range(0, batch.num_rows, ROWS_AT_ONCE))


def _summed(two: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct digest once, with the sum of its numbers."""
    if not len(n):
        return two, n
    order = np.lexsort((two[:, 1], two[:, 0]))
    two, n = two[order], n[order]
    new = np.flatnonzero(np.append(True, (two[1:] != two[:-1]).any(1)))
    return two[new], np.add.reduceat(n, new)


def _twice(hot: DataFrame, digests) -> DataFrame:
    """Digests that digests(part) gives twice or more; each task sends equal ones once, with their number, for every HELD of them."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros((0, 2), np.uint64), np.zeros(0, np.int64)
        held = none
        for part in _parts(batches):
            two = digests(part)
            own = _summed(two, np.ones(len(two), np.int64))
            held = _summed(np.concatenate([held[0], own[0]]), np.concatenate([held[1], own[1]]))
            if len(held[1]) >= HELD:
                yield held
                held = none
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for two, n in counts(batches):
            yield pa.RecordBatch.from_arrays([*(pa.array(two[:, k].copy().view(np.int64)) for k in (0, 1)), pa.array(n)], names=["high", "low", "n"])

    found = hot.mapInArrow(run, "high long, low long, n long").groupBy("high", "low").agg(F.sum("n").alias("n"))
    return written(found.filter("n > 1").drop("n"), "suffix-twice")


def _broadcast(twice: DataFrame):
    """The digests for _known, if there are LOOKED_UP at most."""
    if twice.count() > LOOKED_UP:
        return None
    found = twice.toArrow()
    two = np.column_stack([found.column(c).to_numpy() for c in ("high", "low")]).astype(np.int64).view(np.uint64)
    return twice.sparkSession.sparkContext.broadcast(two[np.lexsort((two[:, 1], two[:, 0]))])


def counted_repeats(hot: DataFrame) -> DataFrame:
    """The same for anchors of more than LIMIT variants, which aren't gathered: window digests that occur twice are looked up.

    Windows are first tested by cells: those whose common bytes occur once can't repeat. Up to LOOKED_UP digests (a
    few for each hot anchor) are broadcast; where there are more, cells aren't tested and windows are joined.
    """
    hot = written(hot.select(*CARRIED, "n", "bytes"), "suffix-hot-variants")

    def cores(part: pa.RecordBatch) -> np.ndarray:
        record, _, at, offset = _windows_of(part)
        return _cells(Prefixes(utf8(part.column("bytes"))[0]), record, at, offset)[0]

    cells = _broadcast(_twice(hot, cores))

    def likely(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest, row and number of the windows whose cell occurs twice."""
        record, step, at, offset = _windows_of(part)
        text = Prefixes(utf8(part.column("bytes"))[0])
        if cells is not None:
            two, cell = _cells(text, record, at, offset)
            good = _known(two, cells.value)[cell] if len(cell) else np.zeros(0, bool)
            record, step, at = record[good], step[good], at[good]
        return _digests(text, at, WINDOW, np.zeros(len(at), np.uint64)), record, step

    windows = _twice(hot, lambda part: likely(part)[0])
    known = _broadcast(windows)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            two, record, step = likely(part)
            first = -part.column("ahead").to_numpy().astype(np.int64)
            found = part.column("n").to_numpy() > 1
            begin, end = first.copy(), first + np.diff(utf8(part.column("bytes"))[1])
            _widest(np.flatnonzero(_known(two, known.value)), record, step, np.arange(len(first)), first, begin, end, found)
            rows = pa.array(np.flatnonzero(found))
            columns = [*(part.column(c).take(rows) for c in CARRIED), pa.array(begin[found].astype(np.int32)), pa.array(end[found].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*CARRIED, "low", "high"])

    if known is not None:
        return hot.mapInArrow(look_up, FOUND)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            two, record, step = likely(part)
            rows, low = pa.array(record), step - part.column("ahead").to_numpy()[record]
            columns = [*(part.column(c).take(rows) for c in CARRIED), pa.array(low.astype(np.int32)), *(pa.array(two[:, k].copy().view(np.int64)) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*CARRIED, "low", "one", "two"])

    windows = windows.select(F.col("high").alias("one"), F.col("low").alias("two"))
    found = hot.mapInArrow(each, "gram long, ahead int, variant binary, places long, low int, one long, two long").join(windows, ["one", "two"])
    whole = hot.filter("n > 1").select(*CARRIED, (-F.col("ahead")).alias("low"), (F.octet_length("bytes") - F.col("ahead")).alias("high"))
    return found.select(*CARRIED, "low", (F.col("low") + WINDOW).alias("high")).union(whole)


def spans_of(around: DataFrame, found: DataFrame) -> DataFrame:
    """What was found of a variant at each of its places. The places of common anchors are salted."""
    salts = F.ceil(F.col("places") / LIMIT).cast("int")
    rows = around.select("doc_id", "text_crc", "at", *VARIANT, F.pmod(F.xxhash64("doc_id", "text_crc", "at"), salts).cast("int").alias("salt"))
    found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return rows.join(found, [*VARIANT, "salt"]).select("doc_id", "text_crc", (F.col("at") + F.col("low")).alias("start"), (F.col("at") + F.col("high")).alias("end"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, text_crc, start, end of spans whose union is what repeated windows cover."""
    shared = written(shared_anchors(docs), "suffix-shared")
    twice = shared.filter("whole is not null").groupBy("gram", "whole").agg(F.count("*").alias("n")).filter("n > 1").select("gram", "whole", F.lit(True).alias("repeated"))
    flagged = written(shared.join(twice, ["gram", "whole"], "left").withColumn("repeated", F.coalesce("repeated", F.lit(False))), "suffix-flagged")
    grams = written(open_grams(flagged.withColumn("copy", F.lit(0))), "suffix-open")
    wanted = flagged.filter("first <= last").join(grams, "gram", "left_semi")
    around = written(surroundings(wanted, docs), "suffix-around")
    few, many = variants(around)
    found = sorted_repeats(few).union(counted_repeats(many))
    known = flagged.filter("repeated").select("doc_id", "text_crc", F.col("at").alias("start"), (F.col("at") + WINDOW).alias("end"))
    return written(known.union(spans_of(around, found)), "suffix-spans")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_spans(docs, repeated_spans(docs)).select("doc_id", "cut.*")


ORACLE = r"""
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), windows AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS w
  FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM hexed WHERE len(h) >= 400)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY w) AS times FROM windows) WHERE times > 1
), marked AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM repeated
), numbered AS (
  SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked
), spans AS (
  SELECT doc_id, min(i) AS lo, max(i) + 200 AS hi FROM numbered GROUP BY doc_id, span
), edges AS (
  SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM hexed
), gaps AS (
  SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo, hi), 0) AS before FROM edges
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo, hi) AS rest, sum(hi - lo) AS gone, count(*) FILTER (hi > lo) AS runs
  FROM gaps JOIN hexed USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, gone::BIGINT AS n_removed, runs::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM kept JOIN hexed USING (doc_id)
"""
