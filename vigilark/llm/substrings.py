"""Removing byte strings that an earlier document has already: exact-substring deduplication by suffix arrays.

A byte goes if some LENGTH-byte string over it also starts in a document with a smaller doc_id. Matches are judged on
the input, overlap freely and never cross documents.

How the work is dealt out. Each LENGTH-byte window has a key, the least hash of the GRAM-byte strings in it, so equal
windows have equal keys wherever they stand, and neighbouring windows mostly share theirs: a run of windows with one
key is dealt as one piece of text. Documents are packed into chunks once. A chunk tells each range of keys which runs
it holds (key, hash of the text, smallest doc_id), each text once. A range answers: a text that a smaller document
holds whole is covered; a text whose key stands over no other text is settled; only what is left, texts that share a
key but differ, is sent to be compared byte by byte.

There the texts of a range are laid side by side and their suffixes sorted in two stages: only suffixes smaller than
their successors are sorted directly, the others are induced by one scan over the buckets of first symbols; common
prefixes of neighbours of LENGTH or more then join equal windows, whose smallest doc_id decides. Texts of one key
never part, so a batch of suffixes has bounded size; a key over more than HOT different texts is dealt again window
by window, which splits it by content. Chunks get one bit a window back and cut their documents.

Hashes of texts have 64 bits and are compared within one key only. Rows between chunks and ranges are at most one for
each key of a chunk, so they grow with the input.

Defined cases: a null text counts as empty, and is returned with no bytes; text that isn't UTF-8 is read with
replacement characters; a null doc_id counts as the largest; rows that share a doc_id never cover each other; texts
shorter than LENGTH lose nothing; very long texts are taken whole; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ngram import pack, unpack

LENGTH = 50
CHUNK_BYTES = 3_000_000
PIECE = 1 << 18
SLICE_ROWS = 64
KEY_BITS = 48
#: Runs, and later texts, that one range gathers on average.
RANGE_RUNS = 1_000_000
RANGE_TEXTS = 100_000
#: Runs of a range that are compared at once.
SPAN_RUNS = 100_000
#: Windows of one run at most, so that its answer fits one number.
RUN_WINDOWS = 64
#: Bytes whose suffixes are sorted at once, and different texts that one key may have among them.
BATCH_BYTES = 500_000
HOT = 20_000
SETTLED, COVERED, OPEN, SPLIT = 0, 1, 2, 3
_LAST = np.iinfo(np.int64).max


# ---- suffixes ----


def eight(symbols: np.ndarray, depth: int) -> np.ndarray:
    """At each place the next eight symbols as one number that compares as they do; zeros follow the end, and depth more places."""
    n = len(symbols) + depth + 8
    padded = np.zeros(n + 15, np.uint8)
    padded[: len(symbols)] = symbols
    out = np.empty(-(-n // 8) * 8, np.uint64)
    for k in range(8):
        out[k::8] = np.frombuffer(padded, ">u8", len(out) // 8, k)
    return out


def direct(keys: np.ndarray, places: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """places by their first symbols, up to depth or to the next border: eight symbols a round, only ties going on."""
    places = places[np.argsort(keys[places], kind="stable")]
    value = keys[places]
    group = np.cumsum(np.r_[True, value[1:] != value[:-1]][: len(places)])
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        tied = np.zeros(len(places), bool)
        tied[1:] |= same
        tied[:-1] |= same
        tied &= room[places] > at
        where = np.flatnonzero(tied)
        if not len(where):
            break
        value = keys[places[where] + at]
        order = np.lexsort((value, group[where]))
        places[where] = places[where][order]
        ranked, held = value[order], group[where]
        fresh = np.r_[True, (ranked[1:] != ranked[:-1]) | (held[1:] != held[:-1])]
        marks = np.zeros(len(places), np.int64)
        marks[where] = fresh
        marks[~tied] = np.r_[True, ~same][~tied]
        group = np.cumsum(marks)
    return places


def two_stage(symbols: np.ndarray, wanted: np.ndarray, depth: int, keys: np.ndarray | None = None) -> np.ndarray:
    """The wanted places in the order of their suffixes' first `depth` symbols (or up to the next border, a 0).

    symbols ends with a border; borders count as different. A suffix smaller than its successor is sorted directly.
    Any other starts with a symbol c and goes on with a suffix that is smaller than itself, so scanning the sorted
    ones from the smallest on puts it at the next free place of the bucket of c.
    """
    n = len(symbols)
    keys = eight(symbols, depth) if keys is None else keys
    place = np.arange(n)
    differs = np.r_[symbols[:-1] != symbols[1:], True]
    turn = np.minimum.accumulate(np.where(differs, place, n)[::-1])[::-1]  # the end of a run of equal symbols decides for all of it
    small = np.r_[symbols[:-1] < symbols[1:], True][turn]
    # a larger suffix is induced by its successor, which is therefore needed too
    last_small = np.r_[-1, np.maximum.accumulate(np.where(small, place, -1))[:-1]]
    need = np.maximum.accumulate(np.where(wanted, place, -1)) > last_small
    border = np.minimum.accumulate(np.where(symbols == 0, place, n)[::-1])[::-1]
    smalls = direct(keys, np.flatnonzero(need & small), border - place, depth)
    induced = need & ~small
    first = symbols[smalls]
    buckets: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        fresh = np.concatenate(buckets[c]) if buckets[c] else smalls[:0]
        here = [fresh]
        while len(fresh):  # a run of one symbol induces itself
            before = fresh[fresh > 0] - 1
            fresh = before[induced[before] & (symbols[before] == c)]
            here.append(fresh)
        here.append(smalls[np.searchsorted(first, c) : np.searchsorted(first, c, "right")])
        here = np.concatenate(here)
        buckets[c] = []
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0] - 1
        before = before[induced[before] & (symbols[before] > c)]
        if len(before):
            order = np.argsort(symbols[before], kind="stable")
            before = before[order]
            of = symbols[before]
            cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
            for part in np.split(before, cuts):
                buckets[symbols[part[0]]].append(part)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[wanted[found]]


def common_prefixes(order: np.ndarray, keys: np.ndarray, depth: int) -> np.ndarray:
    """How many symbols each place of a sorted order shares with the one before, counted up to depth; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    going = np.arange(1, len(order))
    for at in range(0, depth, 8):
        x = keys[order[going] + at] ^ keys[order[going - 1] + at]
        same = sum((x < (np.uint64(1) << np.uint64(64 - 8 * k))).astype(np.int64) for k in range(1, 8)) + (x == 0)
        out[going] += same
        going = going[x == 0]
    return np.minimum(out, depth)


def earlier(texts: list[bytes], owner: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each text a number whose bit k says that the window at its k-th byte is also in a text of a smaller owner."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    symbols = np.frombuffer(b"\x00".join([x.translate(_SHIFT) for x in texts]) + b"\x00", np.uint8)
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    at = np.arange(len(symbols)) - starts[of]
    wanted = at + length <= sizes[of]
    keys = eight(symbols, length)
    order = two_stage(symbols, wanted, length, keys)
    heads = common_prefixes(order, keys, length) < length
    run = np.cumsum(heads) - 1
    mine = owner[of[order]]
    least = np.minimum.reduceat(mine, np.flatnonzero(heads)) if len(order) else mine
    hit = order[mine > least[run]] if len(order) else order
    out = np.zeros(len(texts), np.uint64)
    np.bitwise_or.at(out, of[hit], np.uint64(1) << at[hit].astype(np.uint64))
    return out


#: UTF-8 has no byte above 0xF4, so symbols are bytes and one, and 0 is the border.
_SHIFT = bytes(min(b + 1, 255) for b in range(256))


# ---- runs of windows ----


def gram_of(length: int) -> int:
    return max(1, 2 * length // 5)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def window_keys(data: np.ndarray, length: int) -> np.ndarray:
    """The key of each window: the least hash of the grams inside."""
    n, gram = len(data), gram_of(length)
    with np.errstate(over="ignore"):
        power, base, size = data.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3), 1
        power ^= power >> np.uint64(32)
        got, have = None, 0
        while True:  # hashes of strings of 1, 2, 4, ... bytes; those that add up to a gram are joined
            if gram & size:
                got = power.copy() if got is None else got[: n - have - size + 1] * base + power[have : have + n - have - size + 1]
                have += size
            if 2 * size > gram:
                break
            power = power[:-size] * base + power[size:]
            base, size = base * base, 2 * size
        least, reach, width = _mixed(got), 1, length - gram + 1
        while 2 * reach <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), 2 * reach
        rest = width - reach
        return np.minimum(least[:-rest], least[rest:]) if rest else least


class _Runs:
    """The runs of a stored chunk, in the order of the text; entry numbers their different texts in the order of keys."""

    def __init__(self, row: dict, length: int):
        self.data = zstandard.ZstdDecompressor().decompress(row["text"])
        self.doc_id, self.size, self.length = row["doc_id"], np.array(row["size"], np.int64), length
        self.ids = np.array([_LAST if x is None else x for x in self.doc_id], np.int64)
        self.ends = np.cumsum(self.size)
        raw = np.frombuffer(self.data, np.uint8)
        parted = [self._piece(raw, at) for at in range(0, max(0, len(raw) - length + 1), PIECE)]
        self.key, self.start, self.stop = (np.concatenate(x) if parted else np.zeros(0, kind) for x, kind in zip(zip(*parted) if parted else [()] * 3, (np.uint64, np.int64, np.int64)))
        self.text = np.array(self.texts(self.start, self.stop, xxhash.xxh3_64_intdigest), np.uint64)
        # runs of one text lie side by side: by key, then by the leading bits of the text's hash; should two texts share
        # these, one may be told of twice, which answers alike
        order = np.argsort(self.key << np.uint64(64 - KEY_BITS) | self.text >> np.uint64(KEY_BITS))
        key, text = self.key[order], self.text[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(order)]
        # documents lie in the order of ids, so the first run of a text has its smallest
        self.first = np.minimum.reduceat(order, np.flatnonzero(fresh)) if len(order) else order
        self.entry = np.empty_like(order)
        self.entry[order] = np.cumsum(fresh) - 1
        self.doc = self.ids[np.searchsorted(self.ends, self.start, "right")]

    def _piece(self, raw: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Key, start and stop of the runs among the windows that start in one piece of the data."""
        key = window_keys(raw[at : at + PIECE + self.length - 1], self.length)
        n = len(key)
        ends = self.ends[np.searchsorted(self.ends, at, "right") : np.searchsorted(self.ends, at + n + self.length, "right")] - at
        fits = np.ones(n, bool)
        cross = (ends[:, None] - np.arange(1, self.length)).ravel()
        fits[cross[(cross >= 0) & (cross < n)]] = False
        head = fits.copy()
        head[1:] &= (key[1:] != key[:-1]) | ~fits[:-1]
        bounds = np.flatnonzero(head | ~fits)
        heads = np.flatnonzero(head[bounds])
        start, stop = bounds[heads], np.r_[bounds, n][heads + 1]
        pieces = -(-(stop - start) // RUN_WINDOWS)
        if len(pieces) and pieces.max() > 1:
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, stop = np.repeat(start, pieces) + nth * RUN_WINDOWS, np.repeat(stop, pieces)
            stop = np.minimum(stop, start + RUN_WINDOWS)
        # least hashes are small ones; mixed again they fall evenly into ranges
        return _mixed(key[start]) >> np.uint64(64 - KEY_BITS), start + at, stop + at

    def texts(self, start: np.ndarray, stop: np.ndarray, fn=bytes) -> list:
        data, more = self.data, self.length - 1
        return [fn(data[a:z]) for a, z in zip(start.tolist(), (stop + more).tolist())]

    def parts(self, codes: np.ndarray):
        """What has to be compared, by key: (key, start, stop), and for each whether it is one window of a split key."""
        open_, split = self.first[codes == OPEN], self.first[codes == SPLIT]
        wide = (self.stop - self.start)[split]
        lone = np.repeat(self.start[split] - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(wide.sum())
        hashes = np.array(self.texts(lone, lone + 1, xxhash.xxh3_64_intdigest), np.uint64) >> np.uint64(64 - KEY_BITS)
        key = np.r_[self.key[open_], hashes]
        start, stop = np.r_[self.start[open_], lone], np.r_[self.stop[open_], lone + 1]
        order = np.argsort(key, kind="stable")
        return key[order], start[order], stop[order]


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)


def _by_range(keys: np.ndarray, ranges: int):
    of = _range(keys, ranges)
    parts = np.unique(of)
    return parts.astype(np.int32), list(zip(np.searchsorted(of, parts), np.searchsorted(of, parts, "right")))


def _rows(batches):
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


# ---- the steps ----

_CHUNK_SCHEMA = "chunk string, doc_id array<long>, size array<long>, text binary"


def _chunks(most: int):
    """Documents in the order of ids, as many as fill a chunk."""

    def batch(docs: list[tuple]) -> pa.RecordBatch:
        docs.sort(key=lambda x: (x[0] is None, x[0] or 0))
        text = zstandard.ZstdCompressor(1).compress(b"".join([x[1] for x in docs]))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([[x[0] for x in docs]], pa.list_(pa.int64())), pa.array([[len(x[1]) for x in docs]], pa.list_(pa.int64())), pa.array([text], pa.binary())], ["chunk", "doc_id", "size", "text"])

    def run(batches):
        docs: list[tuple] = []
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, SLICE_ROWS):
                part = b.slice(at, SLICE_ROWS)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    docs.append((doc_id, text or b""))
                    held += len(docs[-1][1])
                    if held >= most:
                        yield batch(docs)
                        docs, held = [], 0
        if docs:
            yield batch(docs)

    return run


_ASK_SCHEMA = "part int, chunk string, key binary, text binary, doc binary"


def _ask(ranges: int, length: int):
    """A row for each range of keys that a chunk has runs in: their keys, hashes of texts, smallest ids."""

    def run(batches):
        for row in _rows(batches):
            r = _Runs(row, length)
            key, text, doc = r.key[r.first], r.text[r.first], r.doc[r.first]
            parts, spans = _by_range(key, ranges)
            cells = [[pack(np.diff(key[a:z], prepend=np.uint64(0))) for a, z in spans], [pack(text[a:z]) for a, z in spans], [pack(doc[a:z]) for a, z in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([row["chunk"]] * len(parts), pa.string()), *[pa.array(c, pa.binary()) for c in cells]], ["part", "chunk", "key", "text", "doc"])

    return run


_ANSWER_SCHEMA = "part int, chunk string, code binary, open long"


def _answer(hot: int):
    """What a range knows of each run, to each chunk in its own order."""

    def codes(key: np.ndarray, text: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((doc, text, key))
        k, t, d = key[order], text[order], doc[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_text = new_key | np.r_[True, t[1:] != t[:-1]]
        of_key, of_text = np.cumsum(new_key) - 1, np.cumsum(new_text) - 1
        owners = d[new_text]  # the smallest id of each text
        texts = np.bincount(of_key[new_text])
        first_text = np.r_[0, np.cumsum(texts)[:-1]]
        several = (texts > 1) & (np.minimum.reduceat(owners, first_text) < np.maximum.reduceat(owners, first_text))
        left = np.where(several, np.where(texts > hot, SPLIT, OPEN), SETTLED).astype(np.uint8)
        back = np.empty(len(order), np.uint8)
        back[order] = np.where(d > owners[of_text], np.uint8(COVERED), left[of_key])
        return back

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        keys = [np.cumsum(unpack(r["key"], np.uint64), dtype=np.uint64) for r in rows]
        texts, docs = [unpack(r["text"], np.uint64) for r in rows], [unpack(r["doc"], np.int64) for r in rows]
        each = [np.empty(len(k), np.uint8) for k in keys]
        # keys are hashes, so equal spans of them hold about as many runs each
        low, high, n = min(int(k[0]) for k in keys), max(int(k[-1]) for k in keys) + 1, 1 + sum(map(len, keys)) // SPAN_RUNS
        edges = np.array([low + (high - low) * x // n for x in range(n + 1)], np.uint64)
        at = [np.searchsorted(k, edges) for k in keys]
        for x in range(n):
            span = [slice(a[x], a[x + 1]) for a in at]
            if not (size := [s.stop - s.start for s in span]) or not sum(size):
                continue
            found = codes(*(np.concatenate([c[s] for c, s in zip(of, span)]) for of in (keys, texts, docs)))
            for out, s, part in zip(each, span, np.split(found, np.cumsum(size)[:-1])):
                out[s] = part
        return pa.table([pa.array([rows[0]["part"]] * len(rows), pa.int32()), pa.array([r["chunk"] for r in rows]), pa.array([pack(x) for x in each], pa.binary()), pa.array([int((x >= OPEN).sum()) for x in each], pa.int64())], names=["part", "chunk", "code", "open"])

    return run


_SEND_SCHEMA = "part int, chunk string, key binary, doc binary, wide binary, text binary"


def _told(cells: list[dict], name: str, kind) -> np.ndarray:
    """The answers to a chunk, put together in the order of ranges."""
    return np.concatenate([np.zeros(0, kind), *[unpack(x[name], kind) for x in sorted(cells, key=lambda x: x["part"])]])


def _send(ranges: int, length: int):
    """The texts that have to be compared, for each range of their keys."""

    def run(batches):
        for row in _rows(batches):
            r = _Runs(row, length)
            key, start, stop = r.parts(_told(row["answers"], "code", np.uint8))
            if not len(key):
                continue
            doc = r.ids[np.searchsorted(r.ends, start, "right")]
            parts, spans = _by_range(key, ranges)
            zip_ = zstandard.ZstdCompressor(3)
            cells = [
                [pack(np.diff(key[a:z], prepend=np.uint64(0))) for a, z in spans],
                [pack(doc[a:z]) for a, z in spans],
                [pack((stop - start)[a:z].astype(np.uint8)) for a, z in spans],
                [zip_.compress(b"".join(r.texts(start[a:z], stop[a:z]))) for a, z in spans],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array([row["chunk"]] * len(parts), pa.string()), *[pa.array(c, pa.binary()) for c in cells]], ["part", "chunk", "key", "doc", "wide", "text"])

    return run


_MATCH_SCHEMA = "part int, chunk string, mask binary"


def _match(length: int, bulk_bytes: int):
    """Texts of one range compared: equal ones first made one, then suffixes sorted, batch after batch of whole keys."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        size, key, doc, texts = [], [], [], []
        for r in rows:
            key.append(np.cumsum(unpack(r["key"], np.uint64), dtype=np.uint64))
            doc.append(unpack(r["doc"], np.int64))
            ends = np.cumsum(unpack(r["wide"], np.uint8).astype(np.int64) + length - 1).tolist()
            data = zstandard.ZstdDecompressor().decompress(r["text"])
            texts += [data[a:z] for a, z in zip([0, *ends], ends)]
            size.append(len(ends))
        key, doc = np.concatenate(key), np.concatenate(doc)
        seen: dict[tuple, int] = {}
        same = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(key.tolist(), texts)), np.int64, len(texts))
        least = np.full(len(seen), _LAST)
        np.minimum.at(least, same, doc)
        of = np.array([k for k, _ in seen], np.uint64)
        each = [x for _, x in seen]
        order = np.argsort(of, kind="stable")
        masks = np.zeros(len(seen), np.uint64)
        bulk = np.cumsum(np.fromiter((len(each[k]) + 1 for k in order), np.int64, len(order)))
        borders = np.flatnonzero(np.r_[of[order][1:] != of[order][:-1], True]) + 1  # a key's texts stay together
        at = 0
        while at < len(order):
            full = np.searchsorted(bulk, (bulk[at - 1] if at else 0) + bulk_bytes, "right")
            end = max(borders[max(0, np.searchsorted(borders, full, "right") - 1)], borders[np.searchsorted(borders, at, "right")])
            batch = order[at:end]
            masks[batch] = earlier([each[k] for k in batch], least[batch], length)
            at = end
        found = np.where(doc > least[same], ~np.uint64(0), masks[same])
        ends = np.cumsum(size)
        return pa.table([pa.array([rows[0]["part"]] * len(rows), pa.int32()), pa.array([r["chunk"] for r in rows]), pa.array([pack(found[z - n : z]) for n, z in zip(size, ends)], pa.binary())], names=["part", "chunk", "mask"])

    return run


def _spread(start: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """All places of ranges."""
    return np.repeat(start - np.r_[0, np.cumsum(wide)[:-1]], wide) + np.arange(wide.sum())


def _covered(r: _Runs, codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which places of a chunk start a window that an earlier document holds."""
    hit = np.zeros(len(r.data) + 1, bool)
    code, head = codes[r.entry], r.first[r.entry]
    later = r.doc > r.doc[head]
    whole = (code == COVERED) | later
    wide = r.stop - r.start
    hit[_spread(r.start[whole], wide[whole])] = True
    # what was compared: masks stand in the order in which the texts were sent
    _, start, stop = r.parts(codes)
    if len(start):
        sent = _spread(start, stop - start)
        bit = sent - np.repeat(start, stop - start)
        on = np.zeros(len(r.data) + 1, bool)
        on[sent] = np.repeat(masks, stop - start) >> bit.astype(np.uint64) & np.uint64(1)
        rest = (code >= OPEN) & ~later  # also further places of the same text in the same document
        to = _spread(r.start[rest], wide[rest])
        hit[to] |= on[_spread(r.start[head[rest]], wide[rest])]
    return hit


def _cut(length: int):
    def run(batches):
        for row in _rows(batches):
            r = _Runs(row, length)
            hit = _covered(r, _told(row["answers"] or [], "code", np.uint8), _told(row["masks"] or [], "mask", np.uint64))
            edge = np.flatnonzero(np.diff(np.r_[False, hit].view(np.int8)))
            first, last = edge[::2], edge[1::2] + length - 1
            # ranges that touch or overlap in one document are one
            owner = np.searchsorted(r.ends, first, "right")
            new = np.r_[True, (first[1:] > last[:-1]) | (owner[1:] != owner[:-1])][: len(first)]
            first, last, owner = first[new], last[np.r_[new[1:], True][: len(last)]], owner[new]
            bounds = np.searchsorted(owner, np.arange(len(r.size) + 1))
            spans, kept = [], []
            for k, (end, n) in enumerate(zip(r.ends.tolist(), r.size.tolist())):
                a, z = first[bounds[k] : bounds[k + 1]].tolist(), last[bounds[k] : bounds[k + 1]].tolist()
                base = end - n
                spans.append([(x - base, y - base) for x, y in zip(a, z)])
                kept.append(b"".join([r.data[x:y] for x, y in zip([base, *z], [*a, end])]))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays([pa.array(r.doc_id, pa.int64()), pa.array(r.size), pa.array([[{"start": x, "stop": y} for x, y in s] for s in spans], kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, chunk_bytes: int = CHUNK_BYTES, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) for each row of docs (doc_id, text): the removed byte ranges and the bytes that stay."""
    spark = docs.sparkSession
    text = F.make_valid_utf8(F.col("text").cast("string")).cast("binary")
    chunks = stored(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_chunks(chunk_bytes), _CHUNK_SCHEMA), "texts")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    gram = length - gram_of(length) + 2
    n_bytes = chunks.select(F.sum(F.aggregate("size", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = max(least, -(-2 * n_bytes // gram // RANGE_RUNS))
    asked = chunks.mapInArrow(_ask(ranges, length), _ASK_SCHEMA)
    answers = stored(asked.groupBy("part").applyInArrow(_answer(hot), _ANSWER_SCHEMA), "answers")
    told = answers.select("chunk", F.struct("part", "code").alias("a")).groupBy("chunk").agg(F.collect_list("a").alias("answers"))
    ready = chunks.join(told, "chunk", "left")
    n_open = answers.agg(F.sum("open")).first()[0] or 0
    sent = ready.where("answers IS NOT NULL").mapInArrow(_send(max(least, -(-n_open // RANGE_TEXTS)), length), _SEND_SCHEMA)
    masks = stored(sent.groupBy("part").applyInArrow(_match(length, batch_bytes), _MATCH_SCHEMA), "masks")
    got = masks.select("chunk", F.struct("part", "mask").alias("a")).groupBy("chunk").agg(F.collect_list("a").alias("masks"))
    return ready.join(got, "chunk", "left").mapInArrow(_cut(length), "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def op13(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    return without_repeats(docs).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, doc_id, unnest(range(0, greatest(0, length(h) // 2 - 49))) AS p, h FROM d),
w AS (SELECT rid, doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
hit AS (SELECT rid, p FROM w JOIN m USING (s) WHERE doc_id > least),
i AS (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
g AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM i),
s AS (SELECT rid, min(p) AS a, max(p) + 50 AS z FROM g GROUP BY rid, g),
l AS (SELECT rid, list(a ORDER BY a) AS az, list(z ORDER BY a) AS zs, sum(z - a)::BIGINT AS n_removed FROM s GROUP BY 1),
x AS (SELECT d.rid, doc_id, h, length(h) // 2 AS n, coalesce(az, []) AS az, coalesce(zs, []) AS zs, coalesce(n_removed, 0) AS n_removed FROM d LEFT JOIN l USING (rid)),
k AS (SELECT *, coalesce(list_aggregate(list_transform(range(0, len(az) + 1), lambda j: substr(h, 2 * list_extract([0::BIGINT] || zs, j + 1) + 1, 2 * (list_extract(az || [n::BIGINT], j + 1) - list_extract([0::BIGINT] || zs, j + 1)))), 'string_agg', ''), '') AS kept FROM x)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, len(az)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM k
"""
