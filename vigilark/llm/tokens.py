"""Token counts of a byte-level BPE vocabulary by finite-state transducers.

Inside a piece (what the vocabulary's splitting pattern cuts out) the merges are compiled into a deterministic
transducer over bytes. Of each prefix of a piece the last token is unique: it is the vocabulary entry that ends
there and is compatible with the last token of the prefix before it. What later bytes can still change lies within
the longest suffix that begins some entry, so a state is that suffix with the last tokens at its positions, and
finitely many states exist. Each transition is annotated with the tokens that it adds to the count, which is
negative where a byte makes tokens merge. States are made when first met and kept in a bounded table.

Pieces are found for many texts at once from the classes of code points and a window of a few neighbours. Texts
beyond CHUNK code points are cut anywhere, also inside pieces; a chunk becomes a map from each transducer state that it
can be entered in to the state it is left in and the tokens between, and a prefix scan composes the maps of a text by
table look-up, in doubling steps. Which states a chunk can be entered in follows from the chunk before it, and where
that holds the beginning of a piece, from this alone. Every step is exact, and a text needs no more memory than its
chunks. The chunks of one text are read in the task that holds it.

A special token's string counts one and separates what stands around it, as the library does by default.

Defined cases: a null text counts as empty and has no tokens; very long texts are counted whole; repeated rows are
counted each; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 16
#: Code points around a chunk that tell where pieces begin in it.
AROUND = 8
#: The state at the start of a piece.
START = (b"", ((b"", 0),))
MAX_STATES, MAX_PIECES = 200_000, 300_000
LIMIT = 1024
TOKENIZER = "byte_bpe_50k.json"

# classes of code points
END, SPACE, WHITE, LETTER, NUMBER, OTHER = range(6)
# fixed values: white space, and letters and numbers of Unicode 16 that an older unicodedata doesn't know
_WHITE = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LATER = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"), (0x10D40, 0x10D49, "N"), (0x10D4A, 0x10D65, "L"),
    (0x10D6F, 0x10D85, "L"), (0x10EC2, 0x10EC4, "L"), (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"), (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"),
    (0x113B7, 0x113B7, "L"), (0x113D1, 0x113D1, "L"), (0x113D3, 0x113D3, "L"), (0x116D0, 0x116E3, "N"), (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"),
    (0x13460, 0x143FA, "L"), (0x16100, 0x1611D, "L"), (0x16130, 0x16139, "N"), (0x16D40, 0x16D6C, "L"), (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"),
    (0x1CCF0, 0x1CCF9, "N"), (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]


def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for first, last, kind in _LATER:
        seen = out[first : last + 1]
        seen[seen == OTHER] = kinds[kind]
    out[[ord(c) for c in _WHITE]] = WHITE
    out[32] = SPACE
    return out


def byte_names() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """The merges of a vocabulary, compiled state by state."""

    def __init__(self, source: str):
        d = json.loads(source)
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in reversed(list(enumerate(pairs)))}
        self.special = [t["content"] for t in d.get("added_tokens", [])]
        self.entries = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.begins = {t[:k] for t in self.entries for k in range(len(t))}
        self.longest = max(map(len, self.entries))
        self.made = {a + b: (a, b, k) for (a, b), k in self.rank.items()}
        self.edges: tuple[dict, dict] = ({}, {})
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.keys = [START]
        self.ids = {START: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, piece: bytes) -> list[bytes]:
        """The tokens of a short piece by its merges, least rank first."""
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while len(parts) > 1:
            best = min(zip(parts, parts[1:]), key=lambda p: self.rank.get(p, 1 << 60))
            if best not in self.rank:
                break
            out, k = [], 0
            while k < len(parts):
                if k + 1 < len(parts) and (parts[k], parts[k + 1]) == best:
                    out.append(parts[k] + parts[k + 1])
                    k += 2
                else:
                    out.append(parts[k])
                    k += 1
            parts = out
        return parts

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Whether b stays a token after a; a is empty at the start of a piece."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits.clear()
            known = self.fits[a, b] = self._apart(a, b) if a else self.merged(b) == [b]
        return known

    def _edge(self, token: bytes, side: int) -> list[tuple[bytes, float]]:
        """The parts of a token that are its last (side 1) or first (side 0) at some time, each with the rank that ends it."""
        known = self.edges[side].get(token)
        if known is None:
            known, gone = [], float("inf")
            while True:
                known.append((token, gone))
                if token not in self.made:
                    break
                *pair, gone = self.made[token]
                token = pair[side]
            self.edges[side][known[0][0]] = known
        return known

    def _apart(self, a: bytes, b: bytes) -> bool:
        """No merge joins a part of a to a part of b. Merges go by rank, and among equal ones from the left."""
        rank = self.rank
        for x, x_gone in self._edge(a, 1):
            for y, y_gone in self._edge(b, 0):
                r = rank.get((x, y))
                if r is not None and r < x_gone and r <= y_gone:
                    return False
        return True

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        suffix, window = self.keys[state]  # window: last token and count at each position of the suffix, its start included
        grown = suffix + bytes([byte])
        for size in range(len(grown), 0, -1):
            token = grown[-size:]
            if token in self.entries:
                last, count = window[len(window) - size]
                if self._compatible(last, token):
                    count += 1
                    break
        else:
            raise ValueError(f"no token ends {grown!r}")
        window = (*window, (token, count))
        while grown not in self.begins:
            grown = grown[1:]
        window = window[len(window) - len(grown) - 1 :]
        key = (grown, tuple((t, c - count) for t, c in window))
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (found, count)
        return move

    def count(self, piece: bytes) -> int:
        """Tokens of a piece."""
        if len(self.keys) > MAX_STATES:
            self._reset()
        state, total, moves = 0, 0, self.moves
        for byte in piece:
            move = moves[state].get(byte) or self._step(state, byte)
            state = move[0]
            total += move[1]
        return total


    def run(self, key: tuple, data: bytes) -> tuple[tuple, int]:
        """The state after some bytes of a piece, from any state, with the tokens that they add. States are told by what they are, not by number, as numbers end with the table."""
        if len(self.keys) > MAX_STATES:
            self._reset()
        state = self.ids.get(key)
        if state is None:
            state = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.moves.append({})
        total, moves = 0, self.moves
        for byte in data:
            move = moves[state].get(byte) or self._step(state, byte)
            state = move[0]
            total += move[1]
        return self.keys[state], total


class Counter(dict):
    """Tokens by piece, and of whole texts."""

    def __init__(self, source: str):
        super().__init__()
        self.fst = Transducer(source)
        self.table = classes()

    def __missing__(self, piece: str) -> int:
        if len(self) > MAX_PIECES:
            self.clear()
        n = self.fst.count(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def borders(self, joined: str, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin in texts that are joined by one code point each, at the places ends."""
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        kind = np.full(n + 6, END, np.uint8)
        char = np.zeros(n + 6, np.uint32)
        kind[3 : n + 3], char[3 : n + 3] = self.table[code], code
        kind[ends + 3] = END
        char[ends + 3] = 0
        at = lambda k: kind[3 + k : n + 3 + k]
        of = lambda k: char[3 + k : n + 3 + k]
        white = (kind == SPACE) | (kind == WHITE)
        w = lambda k: white[3 + k : n + 3 + k]
        start = at(0) != at(-1)
        # white space: the first of a run begins a piece, and so does the last of two or more before something else
        start = np.where(w(0), ~w(-1) | (~w(1) & (at(1) != END)), start)
        # a single space belongs to what follows it
        start = np.where(~w(0) & w(-1), at(-1) != SPACE, start)
        # 's 't 'm 'd 're 've 'll where the apostrophe begins a piece
        quote = (of(0) == 39) & (at(-1) != OTHER) & (at(-1) != SPACE)
        one = quote & np.isin(of(1), [ord(c) for c in "stmd"])
        two = quote & (((np.isin(of(1), [ord("r"), ord("v")])) & (of(2) == ord("e"))) | ((of(1) == ord("l")) & (of(2) == ord("l"))))
        for mark, size in ((one, 2), (two, 3)):
            p = np.flatnonzero(mark)
            for k in range(1, size):
                start[p + k] = False
            after = p[p + size < n] + size
            start[after[~w(0)[after]]] = True
        start |= (at(-1) == END) | (at(0) == END)
        return start

    def many(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, specials not looked for."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes + 1) - 1
        joined = "\n".join(texts) + "\n"
        begin = np.flatnonzero(self.borders(joined, ends))
        stop = np.r_[begin[1:], len(joined)]
        isend = np.zeros(len(joined), bool)
        isend[ends] = True
        real = ~isend[begin]
        begin, stop = begin[real], stop[real]
        each = np.fromiter(map(self.__getitem__, map(joined.__getitem__, map(slice, begin.tolist(), stop.tolist()))), np.int64, len(begin))
        total = np.r_[0, np.cumsum(each)]  # the prefix scan of counts
        upto = total[np.searchsorted(begin, ends)]
        return np.diff(np.r_[0, upto])

    def chunk_map(self, text: str, first: int, last: int, entries: set[tuple]) -> dict[tuple, tuple[tuple, int]]:
        """Of text[first:last], cut anywhere: from each state that it may be entered in to the state it is left in, with the tokens between.

        Where pieces begin is seen from a few code points around, so it doesn't depend on the state. What precedes the
        first of them goes on from the entry; all that follows is alike for each entry.
        """
        low, high = max(0, first - AROUND), min(len(text), last + AROUND)
        near = text[low:high]
        begin = np.flatnonzero(self.borders(near + "\n", np.array([len(near)]))[first - low : last - low]) + first
        coded = lambda a, z: text[a:z].encode("utf-8", "surrogatepass")
        if first and not len(begin):
            return {s: self.fst.run(s, coded(first, last)) for s in entries}
        begin = begin if len(begin) else np.array([first])
        head = coded(first, int(begin[0]))
        inner = sum(map(self.__getitem__, (text[a:z] for a, z in zip(begin[:-1].tolist(), begin[1:].tolist()))))
        left, tail = self.fst.run(START, coded(int(begin[-1]), last))
        return {s: (left, self.fst.run(s, head)[1] + inner + tail) for s in entries}

    def long(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of one text by the maps of its chunks: a prefix scan composes them by table look-up, in doubling steps."""
        maps, entries = [], {START}
        for a in range(0, len(text), chunk):
            maps.append(self.chunk_map(text, a, min(len(text), a + chunk), entries))
            entries = {left for left, _ in maps[-1].values()}  # what the next chunk may be entered in
        step = 1
        while step < len(maps):
            after = lambda x, y: {s: (y[left][0], n + y[left][1]) for s, (left, n) in x.items()}
            maps = [m if k < step else after(maps[k - step], m) for k, m in enumerate(maps)]
            step *= 2
        return maps[-1][START][1] if maps else 0

    def texts(self, texts: list[str | None]) -> list[int]:
        parts, owner, totals = [], [], [0] * len(texts)
        for k, text in enumerate(texts):
            pieces = [text or ""]
            for s in self.fst.special:
                pieces = [p for x in pieces for p in x.split(s)]
            totals[k] = len(pieces) - 1
            for p in pieces:
                if len(p) > CHUNK:
                    totals[k] += self.long(p)
                elif p:
                    parts.append(p)
                    owner.append(k)
        if parts:
            for k, n in zip(owner, self.many(parts).tolist()):
                totals[k] += n
        return totals


_COUNTERS: dict[int, Counter] = {}


def counter(source: str) -> Counter:
    """The counter of a vocabulary in this process."""
    key = hash(source)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(source)
    return _COUNTERS[key]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; vocabulary: path of a byte-level BPE in JSON."""
    with open(vocabulary, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the input

    def run(batches):
        count = counter(source.value)
        for b in batches:
            size, n = [], []
            for at in range(0, b.num_rows, 128):
                texts = b.column(1).slice(at, 128).to_pylist()
                size += [len((x or "").encode("utf-8", "surrogatepass")) for x in texts]
                n += count.texts(texts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op9(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return count_tokens(docs, public_tokenizers.path(TOKENIZER))
