"""Dimensions met and scored by batches of sections whose strings are known as numbers (`substrings.finds`)."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from docreview.constants import LONG_SECTION_CHARS, TITLE_WEIGHT
from docreview.functions.substrings import TABLE, listed


class Gates:
    """Weighed dimensions. A group is what sections and dimensions meet on, as a number."""

    def __init__(self, dims: pa.Table, names: pa.Array):
        """`dims` has group, item_id, dim_no, anchor and strings (array<struct<kind, s, w>>), one row per
        dimension; `names` has the numbered strings."""
        self.names, self.n = names, max(1, len(names))
        self.item_id, self.dim_no, anchor, lists = (_whole(dims, c) for c in ("item_id", "dim_no", "anchor", "strings"))
        group = _whole(dims, "group").to_numpy()
        own, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        code = _numbers(flat.field("s"), names)
        size = np.bincount(own, minlength=dims.num_rows)
        # The strings of a dimension side by side in their order; a string that is not numbered has the number n.
        shape = (dims.num_rows, int(size.max(initial=0)))
        at = own, np.arange(len(own)) - (np.cumsum(size) - size)[own]
        self.code, self.term, self.weight = np.full(shape, self.n, np.int32), np.zeros(shape, bool), np.zeros(shape)
        self.code[at], self.term[at] = np.where(code < 0, self.n, code), flat.field("kind").to_numpy() == 1
        self.weight[at] = flat.field("w").to_numpy(zero_copy_only=False)
        # A dimension is met through its anchor, one without an anchor through any of its strings.
        bare = anchor.is_null().to_numpy(zero_copy_only=False)
        self.bare = bool(bare.any())
        dim = np.concatenate([np.flatnonzero(~bare), own[bare[own]]])
        gate = np.concatenate([_numbers(anchor, names)[~bare], code[bare[own]]])
        dim, gate = dim[gate >= 0], gate[gate >= 0]
        keys = np.unique(np.stack([group[dim] * self.n + gate, dim]), axis=1)
        self.dims = keys[1]
        self.keys, self.first, self.many = np.unique(keys[0], return_index=True, return_counts=True)

    def meet(self, group: np.ndarray, title: pa.Array, body: pa.Array, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Portions of (row, dimension, score, places): every pair that meets, once. The place of a string
        is 2 in the title, 1 in the text only, else 0."""
        if not len(self.keys):
            return
        (trow, tcode), (brow, bcode) = listed(title), listed(body)
        step = max(1, TABLE // (self.n + 1))
        for start in range(0, len(group), step):
            (a, b), (c, d) = (np.searchsorted(r, [start, start + step]) for r in (trow, brow))
            place = np.zeros((min(step, len(group) - start), self.n + 1), np.int8)  # the last column stays 0
            place[brow[c:d] - start, bcode[c:d]] = 1
            place[trow[a:b] - start, tcode[a:b]] = 2
            row, code = np.concatenate([trow[a:b], brow[c:d]]), np.concatenate([tcode[a:b], bcode[c:d]])
            key = group[row] * self.n + code
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            met = self.keys[at] == key
            row, at = row[met], at[met]
            many = self.many[at]
            nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            row, dim = np.repeat(row, many), self.dims[np.repeat(self.first[at], many) + nth]
            if self.bare:
                pair = np.unique(row * len(self.code) + dim)
                row, dim = pair // len(self.code), pair % len(self.code)
            width = self.code.shape[1]
            for k in range(0, len(row), max(1, TABLE // width)):
                part = slice(k, k + max(1, TABLE // width))
                places = place[(row[part] - start)[:, None], self.code[dim[part]]]
                yield row[part], dim[part], self._score(dim[part], places, lengths[row[part]]), places

    def _score(self, dim: np.ndarray, places: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        total = np.zeros(len(dim))
        for k in range(places.shape[1]):  # added in the order of the strings
            w, p = self.weight[dim, k], places[:, k]
            total += np.where(p == 2, w * TITLE_WEIGHT, np.where(p == 1, w, 0.0))
        return np.where(lengths > LONG_SECTION_CHARS, total * 0.5, total)

    def hits(self, dim: np.ndarray, places: np.ndarray) -> pa.Array:
        """The strings found, in their order, each behind T: or B: (phrases) or t: or b: (terms)."""
        pair, k = np.nonzero(places)
        own = dim[pair]
        tag = pa.array(["T:", "B:", "t:", "b:"]).take(pa.array(2 * self.term[own, k] + (places[pair, k] == 1)))
        found = pc.binary_join_element_wise(tag, self.names.take(pa.array(self.code[own, k])), "")
        ends = np.searchsorted(pair, np.arange(len(dim) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), found)


def _whole(table: pa.Table, column: str) -> pa.Array:
    whole = table.column(column).combine_chunks()
    return whole.combine_chunks() if isinstance(whole, pa.ChunkedArray) else whole


def _numbers(strings: pa.Array, names: pa.Array) -> np.ndarray:
    """The number of each string, -1 for null and what is not numbered."""
    return pc.fill_null(pc.index_in(strings.cast(pa.string()), value_set=names, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
