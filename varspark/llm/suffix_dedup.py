"""Suffix dedup over bytes: a hash-compared sparse suffix sort.

A byte is removed if a string of ``length`` bytes that covers it also starts anywhere else.

1. Every string of ``length`` bytes owns an anchor: its leftmost smallest hashed gram of ``GRAM`` bytes.
   Equal strings own equal anchors at equal offsets, and neighbouring strings mostly share theirs,
   so there are few anchors. Each unit asks shards about its distinct anchors; a shard
   answers the units that hold an anchor found at least twice in all.
2. Of those anchors, units send the bytes of the strings they own. A shard sorts the suffixes at
   the anchors: mergesort, where a comparison finds the common extension by binary search over
   prefix polynomial hashes. Sorted neighbours give each string's longest match; extensions to the left
   are found the same way. Where neighbours don't settle all strings of an anchor, the strings themselves
   are compared by hash. Every match is verified byte by byte, against collisions.
3. Anchors found more than ``HOT`` times (a passage that a third of all documents hold) never meet in one task: their strings are
   counted one by one, combined per unit before the shuffle, by polynomial hash; there, a collision-resistant digest (BLAKE2b, 128 bits)
   of each string stands for the comparison byte by byte, since no task could hold the strings.

Asked for, the bytes that an earlier document (with a smaller doc_id) holds too are counted as well: all holders of a repeated string
meet where its anchor is sorted, so its smallest doc_id is known there.

Texts are never shuffled as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

GRAM = 64
HOT = 1024  # an anchor found more often never has its spans gathered in one task
PIECE = 1 << 19  # bytes of spans that are sorted at once (one anchor may have more)


def _sliding(x: np.ndarray, w: int, op, neutral) -> np.ndarray:
    """op over x[i : i + w] for each i with a full window (van Herk)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    full = np.full(-(-len(x) // w) * w, neutral, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, w)
    ahead = op.accumulate(blocks, axis=1).reshape(-1)
    behind = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(behind[:n], ahead[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, at: np.ndarray, prefix: np.ndarray, length: int, gram: int):
    """For each anchor: its position, its hash, and the first and last start of the strings it is owned by."""
    size = np.diff(at)
    none = np.empty(0, np.int64)
    if not (size >= length).any():
        return none, none.astype(np.uint64), none, none
    grams = np.arange(len(data) - gram + 1)
    g = c.mix(c.range_hash(prefix, grams, grams + gram, 2))
    w = length - gram + 1
    least = _sliding(g, w, np.minimum, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded = np.zeros(len(g) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    some = np.flatnonzero(g == _sliding(padded, w, np.maximum, np.uint64(0)))
    # between these starts, neither the smallest value nor the next candidate changes
    first, last = at[:-1][size >= length], at[1:][size >= length] - length
    cut = np.unique(np.concatenate([first, last + 1, some + 1, np.flatnonzero(least[1:] != least[:-1]) + 1]))
    doc = np.searchsorted(first, cut, "right") - 1
    keep = (doc >= 0) & (cut <= last[np.maximum(doc, 0)])
    end = np.append(cut[1:], len(data))[keep] - 1
    start = cut[keep]
    k = np.searchsorted(some, start)
    open_ = np.arange(len(start))
    while len(open_):
        open_ = open_[g[some[k[open_]]] != least[start[open_]]]
        k[open_] += 1
    p = some[k]
    new = np.flatnonzero(np.diff(p, prepend=-1))
    return p[new], g[p[new]], start[new], np.append(end[new[1:] - 1], end[-1]) if len(new) else none


class _Slice:
    """A run of a unit's rows with its anchors."""

    def __init__(self, data: np.ndarray, at: np.ndarray, length: int, gram: int):
        self.data, self.at = data, at
        self.prefix = c.prefix_hash(c.BYTE[0][data], 2)
        self.p, least, self.lo, self.hi = anchors(data, at, self.prefix, length, gram)
        # minima are small numbers; mixed, they spread over all shards
        self.hash = (c.mix(least ^ c.ODD[5]) >> np.uint64(64 - c.BITS)).astype(np.int64)
        self.doc = np.searchsorted(at, self.p, "right") - 1

    def strings(self, some: np.ndarray, length: int):
        """All starts of the strings that own the anchors some, with two hashes."""
        n = self.hi[some] - self.lo[some] + 1
        start = np.repeat(self.lo[some] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        other = c.prefix_hash(c.BYTE[1][self.data], 3)
        h = c.mix(c.range_hash(self.prefix, start, start + length, 2)) >> np.uint64(64 - c.BITS)
        return start, h.astype(np.int64), c.mix(c.range_hash(other, start, start + length, 3))


# ---------------------------------------------------------------- which anchors are repeated


def _ask_anchors(length: int, gram: int):
    def leaf(unit: c.Unit):
        h, n = np.unique(np.concatenate([_Slice(data, at, length, gram).hash for _, data, at in unit.slices()]), return_counts=True)
        return h, [n.astype(np.uint32)]

    return leaf


def _merge_anchors(hot: int):
    """Answers with the anchors found twice or more, and whether more than ``hot`` times."""

    def merge(shard, keys, values, of):
        order, start = c.groups(keys)
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(values[0][order].astype(np.int64), start), np.diff(np.append(start, len(keys))))
        return total > 1, [total > hot]

    return merge


# ---------------------------------------------------------------- strings of repeated anchors

SPAN = "shard long, h long, unit long, row long, doc long, lo long, p long, hi long, body binary"


def _send_spans(length: int, gram: int, shards: int, path: str):
    """A row for each repeated anchor: the strings that own it start at lo..hi of the unit's row, the anchor at p; body has their bytes."""

    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        known, (hot,) = c.told(path, unit.unit, ["?"])
        known = known[~hot]
        for rows, data, at in unit.slices() if len(known) else ():
            s = _Slice(data, at, length, gram)
            some = np.flatnonzero(c.member(known, s.hash) >= 0)
            if len(some):
                size = s.hi[some] - s.lo[some] + length
                offsets = np.concatenate([[0], np.cumsum(size)])
                taken = data[np.repeat(s.lo[some] - offsets[:-1], size) + np.arange(offsets[-1])]
                body = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken)])
                base = at[s.doc[some]]
                yield c.table(shard=c.shard_of(s.hash[some], shards), h=s.hash[some], unit=np.full(len(some), unit.unit), row=s.doc[some] + rows.start, doc=unit.ids[s.doc[some] + rows.start], lo=s.lo[some] - base, p=s.p[some] - base, hi=s.hi[some] - base, body=body)

    return c.each_unit(work)


def _digests(data: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    raw = data.tobytes()
    both = np.frombuffer(b"".join(hashlib.blake2b(raw[i : i + length], digest_size=16).digest() for i in start.tolist()), "<u8").reshape(-1, 2)
    return [both[:, 0].copy(), both[:, 1].copy()]


def _hot_strings(unit: c.Unit, length: int, gram: int, known: np.ndarray):
    """(starts, document of each, which distinct string it has; hash, digest, count and smallest document of the distinct strings) of the strings of hot anchors, slice by slice."""
    for rows, data, at in unit.slices() if len(known) else ():
        s = _Slice(data, at, length, gram)
        some = np.flatnonzero(c.member(known, s.hash) >= 0)
        if len(some):
            start, h, g = s.strings(some, length)
            order, first = c.groups(g, h)
            which = np.empty(len(h), np.int64)
            which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
            one = order[first]
            doc = unit.ids[rows][np.repeat(s.doc[some], s.hi[some] - s.lo[some] + 1)]
            yield unit.at[rows.start] + start, doc, which, h[one], _digests(data, start[one], length), np.diff(np.append(first, len(h))), np.minimum.reduceat(doc[order], first)


def _ask_strings(length: int, gram: int, path: str):
    """The strings of hot anchors: polynomial hash, BLAKE2b digest, count and smallest document of each."""

    def leaf(unit: c.Unit):
        known, (hot,) = c.told(path, unit.unit, ["?"])
        got = [(h, *d, n, least) for _, _, _, h, d, n, least in _hot_strings(unit, length, gram, known[hot])]
        if not got:
            return np.empty(0, np.int64), []
        h, d, e, n, least = (np.concatenate(x) for x in zip(*got, strict=True))
        order, first = c.groups(e, d, h)
        one = order[first]
        return h[one], [d[one], e[one], np.add.reduceat(n[order], first).astype(np.uint32), np.minimum.reduceat(least[order], first)]

    return leaf


def _merge_strings(shard, keys, values, of):
    d, e, n, least = values
    order, start = c.groups(e, d, keys)
    size = np.diff(np.append(start, len(keys)))
    total, first = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    total[order] = np.repeat(np.add.reduceat(n[order].astype(np.int64), start), size)
    first[order] = np.repeat(np.minimum.reduceat(least[order], start), size)
    return total > 1, [d, e, first]


# ---------------------------------------------------------------- the suffix sort


class Suffixes:
    """Suffixes of spans of one buffer, compared by prefix hashes."""

    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = c.prefix_hash(c.BYTE[0][data], 2)
        self.down = c.powers(2, len(self.prefix))[1]

    def _same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.prefix[a + n] - self.prefix[a]) * self.down[a] == (self.prefix[b + n] - self.prefix[b]) * self.down[b]

    def extend(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, left: bool = False) -> np.ndarray:
        """Common extension of the positions a and b, up to most, by binary search."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        for _ in range(int(most.max(initial=0)).bit_length()):
            mid = (low + high + 1) >> 1
            same = self._same(a - mid, b - mid, mid) if left else self._same(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
        """Whether the suffix at a is smaller than that at b (a prefix is smaller)."""
        most = np.minimum(a_end - a, b_end - b)
        n = self.extend(a, b, most)
        inner = n < most
        x, y = self.data[np.where(inner, a + n, 0)], self.data[np.where(inner, b + n, 0)]
        return np.where(inner, x < y, a_end - a < b_end - b)

    def sort(self, group: np.ndarray, pos: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Order of the suffixes inside groups (which stand together): bottom-up mergesort of all groups at once."""
        n = len(pos)
        order = np.arange(n)
        first = np.searchsorted(group, group)  # of each element's group
        size = np.searchsorted(group, group, "right") - first
        inside = order - first
        run = 1
        while (size > run).any():
            # each element's rank in the sibling run, by binary search
            mine = inside // run
            sib = mine ^ 1
            low = np.minimum(sib * run, size)
            high = np.minimum(low + run, size)
            base = low.copy()
            is_right = mine & 1
            while len(act := np.flatnonzero(low < high)):
                mid = (low[act] + high[act]) >> 1
                other, own = order[first[act] + mid], order[act]
                less = self.before(pos[other], end[other], pos[own], end[own])
                # ties: elements of the left run come first
                tie = ~less & ~self.before(pos[own], end[own], pos[other], end[other])
                less |= tie & (is_right[act] == 1)
                low[act] = np.where(less, mid + 1, low[act])
                high[act] = np.where(less, high[act], mid)
            target = first + (mine & ~1) * run + (inside - mine * run) + (low - base)
            new = np.empty_like(order)
            new[target] = order
            order = new
            run *= 2
        return order


def _matches(s: Suffixes, group, pos, start, last, end, length: int) -> list[tuple[int, int, int]]:
    """(element, first offset, last offset) of strings found again; offsets count from the string's start to the anchor pos.

    Element i owns the strings that start at start[i]..last[i]; its span ends at end[i]; group numbers ascend.
    """
    order = s.sort(group, pos, end)
    raw = s.data.tobytes()
    near, far = (pos - last), (pos - start)  # smallest and largest offset
    found: list[tuple[int, int, int]] = []
    left = np.zeros(len(pos), np.int64)
    i, j = order[:-1], order[1:]
    pair = np.flatnonzero(group[i] == group[j])
    i, j = i[pair], j[pair]
    right = s.extend(pos[i], pos[j], np.minimum(end[i] - pos[i], end[j] - pos[j]))
    back = s.extend(pos[i], pos[j], np.minimum(far[i], far[j]), left=True)
    whole = np.zeros(len(pos), bool)
    broken = set()
    for k in np.flatnonzero(right + back >= length):
        a, b, r, m = int(i[k]), int(j[k]), int(right[k]), int(back[k])
        if raw[pos[a] - m : pos[a] + r] != raw[pos[b] - m : pos[b] + r]:
            broken.add(int(group[a]))  # a collision: left to the comparison of whole strings
            continue
        for x in (a, b):
            lo, hi = max(int(near[x]), length - r), min(int(far[x]), m)
            if lo <= hi:
                found.append((x, lo, hi))
                whole[x] |= lo == near[x] and hi == far[x]
    del left
    size = np.searchsorted(group, group, "right") - np.searchsorted(group, group)
    rest = (size > 2) & ~whole
    again = np.isin(group, group[rest])
    if broken:
        again |= np.isin(group, list(broken))
    own = np.flatnonzero(again)
    if len(own):
        found += _compare_strings(s, raw, group, pos, start, last, own, length)
    return found


def _compare_strings(s: Suffixes, raw: bytes, group, pos, start, last, own, length: int) -> list[tuple[int, int, int]]:
    """Equal strings at equal offsets among the elements own, all of them."""
    n = last[own] - start[own] + 1
    who = np.repeat(own, n)
    at = np.repeat(start[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    offset = pos[who] - at
    h = c.mix(c.mix(c.range_hash(s.prefix, at, at + length, 2) + offset.astype(np.uint64) * c.ODD[4]) + group[who].astype(np.uint64))
    order = np.argsort(h, kind="stable")
    a, b = order[:-1], order[1:]
    same = np.flatnonzero(h[a] == h[b])
    a, b = a[same], b[same]
    if not len(a):
        return []
    # runs of neighbouring offsets with the same pair are verified at once
    run = np.lexsort((offset[a], who[b], who[a]))
    a, b = a[run], b[run]
    x, y, o = who[a], who[b], offset[a]
    cut = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (o[1:] != o[:-1] + 1))))
    found = []
    for k, e in zip(cut, [*cut[1:], len(x)], strict=True):
        i, j, lo, hi = int(x[k]), int(y[k]), int(o[k]), int(o[e - 1])
        p, q = int(pos[i]), int(pos[j])
        if raw[p - hi : p - lo + length] == raw[q - hi : q - lo + length]:
            found += [(i, lo, hi), (j, lo, hi)]
        else:
            for v in range(lo, hi + 1):
                if raw[p - v : p - v + length] == raw[q - v : q - v + length]:
                    found += [(i, v, v), (j, v, v)]
    return found


def _earlier(s: Suffixes, doc, group, pos, found: list[tuple[int, int, int]], length: int) -> list[tuple[int, int, int]]:
    """Those of the strings found that an element of a smaller document has too. found names all holders of each of its strings."""
    if not found:
        return []
    x, lo, hi = np.array(found, np.int64).T
    order = np.lexsort((lo, x))
    x, lo, hi = x[order], lo[order], hi[order]
    wide = int(hi.max()) + 2
    most = np.maximum.accumulate(x * wide + hi)
    new = np.flatnonzero(np.concatenate(([True], x[1:] * wide + lo[1:] > most[:-1] + 1)))  # overlapping intervals of an element as one
    x, lo, hi = x[new], lo[new], most[np.append(new[1:], len(most)) - 1] - x[new] * wide
    n = hi - lo + 1
    who = np.repeat(x, n)
    offset = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    at = pos[who] - offset
    h = c.mix(c.range_hash(s.prefix, at, at + length, 2) + (group.astype(np.uint64) * c.ODD[3])[who] + offset.astype(np.uint64) * c.ODD[4])
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    elements = len(doc)
    rank = np.unique(doc, return_inverse=True)[1] * elements + np.arange(elements)  # elements by document
    own, least = rank[who], np.empty(len(h), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(h))))
    later = np.flatnonzero(own // elements > least // elements)
    i, j, o = who[later], least[later] % elements, offset[later]  # j: the holder with the smallest document; by i and o already
    cut = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (o[1:] != o[:-1] + 1))))[: len(i)]
    raw, out = s.data.tobytes(), []
    for k, e in zip(cut, [*cut[1:], len(i)], strict=False):
        a, b, near, far = int(i[k]), int(j[k]), int(o[k]), int(o[e - 1])
        p, q = int(pos[a]), int(pos[b])
        if raw[p - far : p - near + length] == raw[q - far : q - near + length]:
            out.append((a, near, far))
            continue
        for v in range(near, far + 1):  # a collision: compared with all holders
            own = raw[p - v : p - v + length]
            out += [(a, v, v)] * any(raw[int(pos[y]) - v : int(pos[y]) - v + length] == own for y in who[offset == v] if group[y] == group[a] and doc[y] < doc[a])
    return out


def _merge_spans(length: int, earlier: bool):
    def run(spans: pa.Table) -> pa.Table:
        h, unit, row, doc, lo, p, hi = (spans.column(k).to_numpy() for k in ("h", "unit", "row", "doc", "lo", "p", "hi"))
        data, offsets = c.bytes_of(spans.column("body"))
        order = np.argsort(h, kind="stable")
        span, size = offsets[:-1][order], np.diff(offsets)[order]
        h, unit, row, doc, lo, p, hi = (x[order] for x in (h, unit, row, doc, lo, p, hi))
        group = np.cumsum(np.concatenate(([0], h[1:] != h[:-1])))
        # groups are independent: a few at a time bound the memory of prefix hashes
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        weight = np.cumsum(size)[ends - 1]
        found, a = [], 0
        while a < len(group):
            done = weight[np.searchsorted(ends, a, "right") - 1] if a else 0
            b = int(ends[max(np.searchsorted(weight, done + PIECE, "right") - 1, np.searchsorted(ends, a, "right"))])
            n = size[a:b]
            own = np.cumsum(n) - n
            piece = data[np.repeat(span[a:b] - own, n) + np.arange(int(n.sum()))]
            s, pos = Suffixes(piece), own + p[a:b] - lo[a:b]
            again = _matches(s, group[a:b], pos, own, own + hi[a:b] - lo[a:b], own + n, length)
            found += [(a + x, near, far, 0) for x, near, far in again]
            if earlier:
                found += [(a + x, near, far, 1) for x, near, far in _earlier(s, doc[a:b], group[a:b], pos, again, length)]
            a = b
        x, near, far, kind = (np.array(v, np.int64) for v in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 4
        order, first = c.groups(p[x] - near, p[x] - far, row[x], unit[x], kind)
        one = order[first]
        x, near, far, kind = x[one], near[one], far[one], kind[one]
        return pa.table({"unit": unit[x], "row": row[x], "start": p[x] - far, "stop": p[x] - near + length, "earlier": kind > 0})

    return run


# ---------------------------------------------------------------- removal


def _apply(length: int, gram: int, spans: str, asked: str, hot: str, with_bytes: bool, earlier: bool):
    def work(unit: c.Unit) -> Iterator[pa.RecordBatch]:
        found = c.delivered(spans, unit.unit, ["row", "start", "stop", "earlier"], "unit")
        row, start, stop, before = (np.empty(0, np.int64) if found is None else found.column(k).to_numpy() for k in ("row", "start", "stop", "earlier"))
        before = before.astype(bool)
        edges = np.zeros((1 + earlier, len(unit.data) + 1), np.int32)  # of all strings, and of those that an earlier document has
        for edge, some in zip(edges, (~before, before), strict=False):
            np.add.at(edge, unit.at[row[some]] + start[some], 1)
            np.add.at(edge, unit.at[row[some]] + stop[some], -1)
        known, (flag,) = c.told(asked, unit.unit, ["?"])
        if flag.any():
            *twice, least = (v.tolist() for v in _flat(c.told(hot, unit.unit, ["<u8", "<u8", "<i8"])))
            first = dict(zip(zip(*twice, strict=True), least, strict=True))
            for starts, doc, which, h, (d, e), *_ in _hot_strings(unit, length, gram, known[flag]):
                held = [first.get(x) for x in zip(h.tolist(), d.tolist(), e.tolist(), strict=True)]
                again = np.fromiter((x is not None for x in held), bool, len(h))
                smallest = np.fromiter((c.LAST_ID if x is None else x for x in held), np.int64, len(h))
                for edge, some in zip(edges, (again[which], smallest[which] < doc), strict=False):
                    np.add.at(edge, starts[some], 1)
                    np.add.at(edge, starts[some] + length, -1)
        gone = np.cumsum(edges[0, :-1]) > 0
        out, spans_n, removed = [], [], []
        for i in range(unit.n):
            own = gone[unit.at[i] : unit.at[i + 1]]
            removed.append(int(own.sum()))
            spans_n.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if removed[-1] else 0)
            text = unit.data[unit.at[i] : unit.at[i + 1]]
            text = (text[~own] if removed[-1] else text).tobytes()
            out.append(text if with_bytes else hashlib.sha256(text).hexdigest())
        yield c.table(
            doc_id=unit.doc_id, n_bytes=np.diff(unit.at), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans_n, pa.int64()),
            kept=pa.array(out, pa.binary() if with_bytes else pa.string()),
            **({"n_earlier": np.diff(np.concatenate([[0], np.cumsum(np.cumsum(edges[1, :-1]) > 0)])[unit.at])} if earlier else {}),
        )

    return c.each_unit(work)


def _flat(told) -> list[np.ndarray]:
    keys, values = told
    return [keys, *values]


def suffix_dedup(docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = HOT, with_bytes: bool = True, fan: int | None = None, earlier: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the bytes kept of each document (kept), or only their SHA-256.

    Null and empty texts have no bytes. Strings never cross documents; equal rows are documents each
    and find each other. A null doc_id is a doc_id like others. Only doc_id and text are read. ``hot``: see the
    module; it changes the work, not the result. ``fan``: shards that a unit sends to directly. ``earlier``: n_earlier too, the bytes
    covered by a string that also starts in a document with a smaller doc_id (null is the largest): what goes if first holders keep theirs.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must be from 1 to length")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = c.shard_count(docs)
    packed = c.units(docs, "op8-units")
    asked = c.ask(packed, _ask_anchors(length, gram), ["<u4"], _merge_anchors(hot), shards, "op8-anchors", fan=fan)
    spans = packed.mapInArrow(_send_spans(length, gram, shards, asked), SPAN)
    found = c.deliver(spans.groupBy("shard").applyInArrow(_merge_spans(length, earlier), "unit long, row long, start long, stop long, earlier boolean").select("row", "unit", "start", "stop", "earlier"), "op8-spans", packed, "unit")
    twice = c.ask(packed, _ask_strings(length, gram, asked), ["<u8", "<u8", "<u4", "<i8"], _merge_strings, shards, "op8-hot", fan=fan)
    kept = ("kept binary" if with_bytes else "kept string") + ", n_earlier long" * earlier
    out = packed.mapInArrow(_apply(length, gram, found, asked, twice, with_bytes, earlier), f"doc_id long, n_bytes long, n_removed long, n_spans long, {kept}")
    return out if with_bytes else out.withColumnRenamed("kept", "kept_sha256")


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_bytes=False, earlier=True)
