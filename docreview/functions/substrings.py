"""Many strings looked up in many texts: by their first bytes, or by an inverted index of character pairs."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docreview.session import stage

#: Strings of so many bytes at most are sent to the texts; more meet them by a shuffle.
BROADCAST_BYTES = 32 << 20
#: First bytes of a string by which it is looked up, and bytes of text that are searched at a time.
HEAD = 4
PORTION = 1 << 20
#: Bytes that are compared at a time to find a string's place among those that begin alike.
WORD = 8
#: Where a string stands in a row: in its title, in its text only, over the seam of both only.
TITLE, BODY, SEAM = range(3)
#: Groups times strings up to which a table tells what a group asks for.
TABLE = 1 << 22
#: Parts into which a shuffle cuts each pair of characters, as a third of all sections may have it.
SALTS = 32
#: Rows of one group that meet the strings in one such part.
SALT_ROWS = 4_096


def character_pairs(value: Column) -> Column:
    """The distinct pairs of neighbouring characters."""
    return F.array_distinct(F.regexp_extract_all(value, F.lit(r"(?s)(?=(..))"), F.lit(1)))


def file_strings(strings: DataFrame, by: list[str]) -> DataFrame:
    """Each distinct (*by, s) with `gram`: the pair of characters in it that the fewest strings
    have. A string of one character or none is filed under itself."""
    short = F.char_length("s") < 2
    grams = F.when(short, F.array("s")).otherwise(character_pairs(F.col("s")))
    spread = strings.select(*by, "s").distinct().withColumn("gram", F.explode(grams))
    common = spread.groupBy("gram").agg(F.count("*").alias("_n"))
    return spread.join(common.hint("merge"), "gram").groupBy(*by, "s").agg(F.min(F.struct("_n", "gram"))["gram"].alias("gram"))


def _tally(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in ascending order, and how often each comes."""
    values = np.sort(values)
    at = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[at], np.diff(np.append(at, len(values)))


def _fold(code: np.ndarray) -> np.ndarray:
    """16 bits of a number of up to 32, well spread: letters alone differ in few bits."""
    return (code * np.uint32(2654435761)) >> np.uint32(16)


class Wanted:
    """Strings and the groups of texts that ask for each, looked up in a batch of texts at once.

    Bytes of UTF-8 are compared: a string is in a text exactly if its bytes are."""

    def __init__(self, strings: list[str], groups: np.ndarray, which: np.ndarray):
        """`groups` and `which` go together: the group (a number) and the place of a string it asks for."""
        self.names = pa.array(strings, pa.string())
        self.groups = np.unique(groups)
        own, size = np.searchsorted(self.groups, groups), (len(self.groups), max(1, len(strings)))
        self.asked, self.table = np.unique(own * size[1] + which), None
        if size[0] * size[1] <= TABLE:
            self.table = np.zeros(size, bool)
            self.table[own, which] = True
        raw = [s.encode("utf-8", "surrogatepass") for s in strings]
        self.sizes = np.array([len(r) for r in raw], np.int64)
        self.empty = np.flatnonzero(self.sizes == 0)
        self.flat = np.frombuffer(b"".join(raw) + bytes(WORD), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.tails = np.zeros(len(raw), np.uint32)
        long = np.flatnonzero(self.sizes >= HEAD)
        self.tails[long] = self._codes(self.flat, self.starts[long] + self.sizes[long] - HEAD, HEAD)
        # For each string the longest other one that it begins with, else -1.
        self.outer = np.full(len(raw), -1, np.int64)
        order = np.array(sorted(long.tolist(), key=raw.__getitem__), np.int64)
        open_ = []
        for k in order.tolist():
            while open_ and not raw[k].startswith(raw[open_[-1]]):
                open_.pop()
            if open_:
                self.outer[k] = open_[-1]
            open_.append(k)
        # Width, distinct first bytes as numbers, one of them for each of 2^16 folds (else -1), which of them share a
        # fold, and the strings of each, in the order of their bytes: `strings` from cuts[c] to cuts[c + 1].
        self.heads = []
        for width in range(1, HEAD + 1):
            strings = order if width == HEAD else np.flatnonzero(self.sizes == width)
            if not len(strings):
                continue
            codes, own, many = np.unique(self._codes(self.flat, self.starts[strings], width), return_inverse=True, return_counts=True)
            folds = _fold(codes)
            slots = np.full(1 << 16, -1, np.int32)
            slots[folds] = np.arange(len(codes))
            shared = np.bincount(folds, minlength=1 << 16)[folds] > 1
            cuts = np.append(0, np.cumsum(many))
            self.heads.append((width, codes, slots, shared, strings[np.argsort(own, kind="stable")], cuts))

    @staticmethod
    def _codes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """The `width` bytes from each of these places on as one number, the first byte lowest."""
        code = data[at].astype(np.uint32)
        for k in range(1, width):
            code |= data[at + k].astype(np.uint32) << np.uint32(8 * k)
        return code

    @staticmethod
    def _words(padded: np.ndarray) -> np.ndarray:
        """The WORD bytes from every place on as numbers in the order of the bytes. The last WORD bytes only fill up."""
        return np.ndarray(len(padded) - WORD + 1, ">u8", padded, strides=(1,))

    def _not_behind(self, words: np.ndarray, place: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether a string, by its bytes, begins what stands at a place or comes before it. Both have the same first bytes."""
        flat, out, left, k = self._words(self.flat), np.ones(len(place), bool), np.arange(len(place)), HEAD
        while len(left := left[self.sizes[which[left]] > k]):
            own = which[left]
            over = (8 * np.maximum(0, WORD - (self.sizes[own] - k))).astype(np.uint64)
            string = flat[self.starts[own] + k].astype(np.uint64) >> over
            there = words[np.minimum(place[left] + k, len(words) - 1)].astype(np.uint64) >> over
            out[left[string > there]] = False
            left, k = left[string == there], k + WORD
        return out

    def _nearest(self, words: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, strings: np.ndarray) -> np.ndarray:
        """Where in `strings`, from `low` up to `high`, the last one stands that is not behind what a place has, `low` - 1 if
        there is none. An only one is not compared. Halving makes no row for each of many strings that begin alike."""
        low = low - (high - low > 1)
        left = np.flatnonzero(high - low > 1)
        while len(left):
            middle = (low[left] + high[left]) // 2
            upto = self._not_behind(words, place[left], strings[middle])
            low[left[upto]], high[left[~upto]] = middle[upto], middle[~upto]
            left = left[high[left] - low[left] > 1]
        return low

    def _search(self, data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, string, place) wherever a string stands; texts lie between `ends` in `data`. In parts of one string a place."""
        text_of = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        # Four bytes from every place on; those behind the end are 0, and no string reaches over it.
        padded = np.append(data, np.zeros(WORD, np.uint8))
        code = np.ndarray(len(data), "<u4", padded, strides=(1,)).astype(np.uint32)
        for width, codes, slots, shared, strings, cuts in self.heads:
            heads = code if width == HEAD else code & np.uint32((1 << 8 * width) - 1)
            slot = slots[_fold(heads)]
            place = np.flatnonzero(slot >= 0)
            at, here = slot[place], heads[place]
            met = codes[at] == here
            again = np.flatnonzero(~met & shared[at])
            if len(again):
                at[again] = np.minimum(np.searchsorted(codes, here[again]), len(codes) - 1)
                met[again] = codes[at[again]] == here[again]
            place, at = place[met], at[met]
            if len(strings) > len(codes):
                nearest = self._nearest(self._words(padded), place, cuts[at], cuts[at + 1], strings)
                known = nearest >= cuts[at]
                place, which = place[known], strings[nearest[known]]
            else:
                which = strings[at]
            while len(place):
                yield self._standing(code, ends, text_of, place, which, width)
                which = self.outer[which]  # shorter ones
                more = np.flatnonzero(which >= 0)
                place, which = place[more], which[more]

    def _standing(
        self, code: np.ndarray, ends: np.ndarray, text_of: np.ndarray, place: np.ndarray, which: np.ndarray, width: int
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, string, place) where the string of a place, whose first bytes are there, stands inside the text."""
        size = self.sizes[which]
        if width == HEAD:  # the last bytes, then those between, HEAD at a time
            last = place + size - HEAD
            same = last < len(code)
            same[same] = code[last[same]] == self.tails[which[same]]
            place, which, size = place[same], which[same], size[same]
        text = text_of[place]
        inside = place + size <= ends[text + 1]
        if width == HEAD:
            left, k = np.flatnonzero(inside & (size > 2 * HEAD)), HEAD
            while len(left):
                met = code[place[left] + k] == self._codes(self.flat, self.starts[which[left]] + k, HEAD)
                inside[left[~met]] = False
                k += HEAD
                left = left[met & (size[left] > k + HEAD)]
        return text[inside].astype(np.int64), which[inside], place[inside]

    def within(self, blobs: pa.Array, group: pa.Array, cut: pa.Array | None = None) -> tuple[np.ndarray, ...]:
        """(row, string), ascending and distinct, for each string that a blob contains and its group asks for.

        With `cut`, each blob is a text of so many bytes, a blank and a title. A third array tells where
        the string stands: TITLE (the text may have it too), BODY (the text only) or SEAM (over the blank only)."""
        n = max(1, len(self.names))
        if not len(blobs):
            return (np.zeros(0, np.int64),) * (2 if cut is None else 3)
        ends = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset : blobs.offset + len(blobs) + 1].astype(np.int64)
        raw = blobs.buffers()[2]
        data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
        given, group = blobs.is_valid().to_numpy(zero_copy_only=False), group.to_numpy(zero_copy_only=False)
        seam = None if cut is None else ends[:-1] + cut.fill_null(0).to_numpy(zero_copy_only=False)
        own = np.minimum(np.searchsorted(self.groups, group), max(0, len(self.groups) - 1))
        pairs, at = [np.zeros(0, np.int64)], 0
        usable = given & (self.groups[own] == group) if len(self.groups) else np.zeros(len(blobs), bool)

        def asked(row: np.ndarray, which: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
            """Each (row, string) that the row's group asks for, with its kind if there is a seam, as one number."""
            if self.table is None:
                wanted = own[row] * n + which
                known = self.asked[np.minimum(np.searchsorted(self.asked, wanted), len(self.asked) - 1)] == wanted
            else:
                known = self.table[own[row], which]
            known &= usable[row]
            code = row * n + which
            return _tally((code if seam is None else code * 3 + kind)[known])[0]

        while at < len(blobs) and usable.any():
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + PORTION, "right")) - 1)
            rows = np.arange(at, upto)
            parts = [asked(rows, np.full(len(rows), e), TITLE) for e in self.empty]
            for row, which, place in self._search(data[ends[at] : ends[upto]], ends[at : upto + 1] - ends[at]):
                row, place, kind = row + at, place + ends[at], TITLE
                if seam is not None:
                    kind = np.where(place > seam[row], TITLE, np.where(place + self.sizes[which] <= seam[row], BODY, SEAM))
                parts.append(asked(row, which, kind))
            if parts:
                pairs.append(_tally(np.concatenate(parts))[0])
            at = upto
        found = np.concatenate(pairs)
        if seam is None:
            return found // n, found % n
        found = found[np.flatnonzero(np.diff(found // 3, prepend=-1))]  # the first of the three
        return found // 3 // n, found // 3 % n, found % 3


def _wanted(index: DataFrame, by: list[str]) -> Wanted:
    """The strings of `index` (*by, s) with the hash of their group; a hash in common is told apart later."""
    table = index.select(F.xxhash64(*by).alias("g"), "s").toArrow()
    coded = table.column("s").combine_chunks().dictionary_encode()
    return Wanted(coded.dictionary.to_pylist(), table.column("g").to_numpy(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64))


def _sent(strings: DataFrame, by: list[str]) -> tuple[DataFrame, bool]:
    """The distinct strings, written, and whether they are few enough to be sent to the texts."""
    index = stage(strings.select(*by, "s").where(F.col("s").isNotNull()).distinct())
    return index, index.agg(F.coalesce(F.sum(F.octet_length("s") + 40), F.lit(0))).first()[0] <= BROADCAST_BYTES


def count_containing(rows: DataFrame, strings: DataFrame, by: list[str], key: list[str], group: list[str]) -> DataFrame:
    """(*group, s, n): how many rows `containing` would give. `group` has the columns of `by`. Strings that
    are sent to the texts are counted where the texts are read, and only these counts are shuffled."""
    index, few = _sent(strings, by)
    if not few:
        return containing(rows, index, by, key).groupBy(*group, "s").agg(F.count("*").alias("n"))
    wanted = _wanted(index, by)
    fields = _count_fields(rows, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _counted(batch, *wanted.within(batch.column(len(group) + 1), batch.column(len(group))), wanted, fields)

    parts = rows.select(*group, F.xxhash64(*by).alias("_by"), F.col("_blob").cast("binary").alias("_blob")).mapInArrow(run, fields)
    return parts.join(F.broadcast(index), [*by, "s"], "left_semi").groupBy(*group, "s").agg(F.sum("n").alias("n"))


def finds(rows: DataFrame, strings: DataFrame, by: list[str]) -> tuple[DataFrame, Wanted] | None:
    """`rows` (with `_body`, `_title` and `_blob`, which go) with `title`, `body` and `seam`: the numbers (`packed`) of the
    strings that the title has, that the text alone has, and that stand over the seam alone; and `Wanted`, which names them.
    Every row is kept. Strings are not empty. None if they are too many to be sent to the texts.

    A hash of `by` in common may give a row strings that it did not ask for: compare `by` as well."""
    index, few = _sent(strings, by)
    if not few:
        return None
    wanted = _wanted(index, by)
    kept = [c for c in rows.columns if c not in ("_blob", "_body", "_title")]
    fields = T.StructType([*(rows.schema[c] for c in kept), *(T.StructField(k, T.BinaryType()) for k in ("title", "body", "seam"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, which, kind = wanted.within(*(batch.column(len(kept) + k) for k in (0, 2, 1)))
            lists = [packed(row[kind == k], which[kind == k], batch.num_rows) for k in (TITLE, BODY, SEAM)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *lists], fields.names)

    texts = rows.select(*kept, F.col("_blob").cast("binary").alias("_blob"), F.octet_length("_body").cast("long").alias("_cut"), F.xxhash64(*by).alias("_by"))
    return texts.mapInArrow(run, fields), wanted


def packed(row: np.ndarray, number: np.ndarray, n: int) -> pa.Array:
    """The numbers of each of `n` rows, rows ascending, as bytes: Spark moves these as one value."""
    ends = np.searchsorted(row, np.arange(n + 1)).astype(np.int32) * np.int32(4)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(number.astype("<i4"))])


def listed(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) for what `packed` made."""
    if not len(lists):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1] // 4
    raw = lists.buffers()[2]
    numbers = np.zeros(0, "<i4") if raw is None else np.frombuffer(raw, "<i4", count=int(ends[-1]))
    return np.repeat(np.arange(len(lists)), np.diff(ends)), numbers[ends[0] :].astype(np.int64)


def count_finds(found: DataFrame, wanted: Wanted, group: list[str]) -> DataFrame:
    """(*group, s, n): how many rows of `found` (of `finds`) have each string. Only counts per batch are shuffled."""
    fields = _count_fields(found, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, which = (np.concatenate(x) for x in zip(*(listed(batch.column(len(group) + k)) for k in range(3))))
            yield _counted(batch, row, which, wanted, fields)

    return found.select(*group, "title", "body", "seam").mapInArrow(run, fields).groupBy(*group, "s").agg(F.sum("n").alias("n"))


def _count_fields(rows: DataFrame, group: list[str]) -> T.StructType:
    return T.StructType([
        *(T.StructField(g, rows.schema[g].dataType) for g in group), T.StructField("s", T.StringType()), T.StructField("n", T.LongType()),
    ])


def _counted(batch: pa.RecordBatch, row: np.ndarray, which: np.ndarray, wanted: Wanted, fields: T.StructType) -> pa.RecordBatch:
    """How often each string comes in the groups of a batch, whose first columns name the group."""
    size, code = len(fields.names) - 2, np.zeros(batch.num_rows, np.int64)
    for k in range(size):
        coded = batch.column(k).dictionary_encode("encode")
        code = np.unique(code * max(1, len(coded.dictionary)) + coded.indices.to_numpy(), return_inverse=True)[1]
    first = np.unique(code, return_index=True)[1]
    n = max(1, len(wanted.names))
    pair, times = _tally(code[row] * n + which)
    one = pa.array(first[pair // n])
    columns = [*(batch.column(k).take(one) for k in range(size)), wanted.names.take(pa.array(pair % n)), pa.array(times)]
    return pa.RecordBatch.from_arrays(columns, fields.names)


def containing(rows: DataFrame, strings: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """Rows of `rows` (with `_blob`) once for each string `s` of `strings` (*by, s) that the blob
    contains. Rows and strings meet on `by`; `key` identifies a row.

    Writes the strings. Within BROADCAST_BYTES they are sent to the texts. Beyond that, distinct pairs of
    characters meet the index of the strings by a shuffle, in SALTS parts each at most (as many as the
    largest group of rows calls for), and the strings found are joined back to their rows. Equal for
    both: the rows.

    Spark takes exploded rows to be as many as the rows they come from, and would broadcast them. The
    hints keep all joins of the larger way shuffles."""
    index, few = _sent(strings, by)
    if few:
        wanted = _wanted(index, by)

        @F.arrow_udf(T.ArrayType(T.StringType()))
        def found_in(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for blobs, group in batches:
                row, which = wanted.within(blobs, group)
                ends = np.searchsorted(row, np.arange(len(blobs) + 1)).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends), wanted.names.take(pa.array(which)))

        # Spark would search again for a filter on what is found, if it knew that both give the same.
        found = found_in.asNondeterministic()(F.col("_blob").cast("binary"), F.xxhash64(*by))
        return rows.withColumn("s", F.explode(found)).join(F.broadcast(index), [*by, "s"])
    index = stage(file_strings(index, by))
    single, empty = index.agg(F.max(F.char_length("s") == 1), F.max(F.col("s") == "")).first()
    grams = character_pairs(F.col("_blob"))
    if single:
        grams = F.concat(grams, F.array_distinct(F.filter(F.split("_blob", ""), lambda c: c != "")))
    if empty:
        grams = F.concat(grams, F.array(F.lit("")))
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    salts = min(SALTS, -(-largest // SALT_ROWS) or 1)
    row = F.struct(*key)
    narrow = rows.select(*by, row.alias("_row"), F.explode(grams).alias("gram")).withColumn(
        "_salt", F.pmod(F.xxhash64("_row"), F.lit(salts))
    )
    parts = index.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = narrow.join(parts.hint("merge"), [*by, "gram", "_salt"]).select("_row", "s").distinct()
    return rows.withColumn("_row", row).join(found.hint("merge"), "_row").where(F.contains("_blob", "s")).drop("_row")
