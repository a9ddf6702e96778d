"""Byte-level BPE encoding and decoding of event texts.

Texts are cut before the merges of a rank file, as its pattern asks, without a regular
expression. Code points become a few classes by table, classes become transition
functions of a small automaton, and functions compose associatively: a batch is cut into
columns, each column's functions are composed, the columns' start states follow by a
scan, and a second pass over all columns at once gives the state, and so a boundary or
none, at every code point. The slices between boundaries feed a cached pair merging.
Byte ends of tokens are kept, so that decoding can be placed in the text.

The pattern is the one shipped beside the rank files: contractions, then runs of
letters, of numbers, or of other signs with one blank before them, and white space whose
last sign is left for what follows.

The project has no tokenised record; the operator is general and runs on the ``event``
text of log records or any other text column.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from .texts import map_texts, remembered

CACHE = 300_000
# bytes up to which a slice is merged without a heap
SHORT = 48
COLUMN = 256

# classes of code points
OTHER, LETTER, NUMBER, SPACE, BLANK, MARK, BREAK = range(7)
# symbols: a class together with what follows
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_INNER, S_LEAD, S_LONE, S_BREAK = range(9)
# states: what the token before the next code point is
END, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, LED, TWO_LEFT, ONE_LEFT = range(8)
# Unicode White_Space, fixed values
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@remembered
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE] = SPACE
    table[0x20] = BLANK
    table[0x27] = MARK
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state and whether a token starts at this symbol."""
    if symbol == S_BREAK:
        return END, True
    if symbol == S_INNER:
        return IN_SPACE, state != IN_SPACE
    if symbol == S_LEAD:
        return LED, True
    if symbol == S_LONE:
        return END, True
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return END, False
        return IN_LETTER, state not in (IN_LETTER, LED)
    if symbol == S_NUMBER:
        return IN_NUMBER, state not in (IN_NUMBER, LED)
    if state in (IN_OTHER, LED):
        return IN_OTHER, False
    return {S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT, S_OTHER: IN_OTHER}[symbol], True


@remembered
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Function of each symbol, composition table, value table, and starts by (state, symbol)."""
    n = 8
    maps = [tuple(range(n))]
    number = {maps[0]: 0}
    first = []
    for symbol in range(9):
        f = tuple(_step(s, symbol)[0] for s in range(n))
        if f not in number:
            number[f] = len(maps)
            maps.append(f)
        first.append(number[f])
    at = 0
    while at < len(maps):  # close under appending one symbol's function
        for k in set(first):
            f = tuple(maps[k][s] for s in maps[at])
            if f not in number:
                number[f] = len(maps)
                maps.append(f)
        at += 1
    compose = np.array([[number[tuple(g[s] for s in f)] for g in maps] for f in maps], np.int16)
    starts = np.array([[_step(s, symbol)[1] for symbol in range(9)] for s in range(n)])
    return np.array(first, np.int16), compose, np.array(maps, np.int8), starts


def _symbols(codes: np.ndarray) -> np.ndarray:
    kind = _classes()[codes]
    kind[codes == 0x10FFFE] = BREAK  # the separator between texts is no character
    after = np.r_[kind[1:], np.uint8(BREAK)]
    out = np.choose(kind, [S_OTHER, S_LETTER, S_NUMBER, S_INNER, S_INNER, S_OTHER, S_BREAK]).astype(np.int8)
    white = (kind == SPACE) | (kind == BLANK)
    last = white & (after != SPACE) & (after != BLANK) & (after != BREAK)
    out[last] = np.where(kind[last] == BLANK, S_LEAD, S_LONE)
    marks = np.flatnonzero(kind == MARK)
    if marks.size:
        padded = np.r_[codes, 0, 0]
        one, two = padded[marks + 1], padded[marks + 2]
        # contraction ends of the pattern, fixed values
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(marks.size, bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        out[marks[short]] = S_SHORT
        out[marks[long]] = S_LONG
    return out


def boundaries(codes: np.ndarray) -> np.ndarray:
    """True where a token, or a separator ``0x10FFFE`` between texts, starts."""
    n = codes.size
    if n == 0:
        return np.zeros(0, bool)
    first, compose, maps, starts = _automaton()
    symbols = _symbols(codes)
    n_cols = -(-n // COLUMN)
    grid = np.full(n_cols * COLUMN, S_BREAK, np.int8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(n_cols, COLUMN).T)
    func = first[grid]
    total = func[0]
    for row in func[1:]:
        total = compose[total, row]
    # start states of the columns: doubling scan over composed functions
    before = np.r_[np.int16(0), total[:-1]]
    step = 1
    while step < n_cols:
        before = np.r_[before[:step], compose[before[:-step], before[step:]]]
        step *= 2
    state = maps[before, END]
    out = np.empty((COLUMN, n_cols), bool)
    for i in range(COLUMN):
        out[i] = starts[state, grid[i]]
        state = maps[func[i], state]
    return out.T.reshape(-1)[:n]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return _merge_short(piece, ranks)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            rank = ranks.get(piece[i : end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n - 1):
        offer(i)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or after[i] >= n or end[after[i]] != stop or end[i] >= stop:
            continue
        j = after[i]
        alive[j] = False
        end[i] = end[j]
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


def _merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for few bytes, where looking through all pairs is cheaper than a heap."""
    none = len(ranks) + (1 << 30)
    ends = list(range(len(piece) + 1))
    pairs = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        del ends[i + 1], pairs[i]
        if i < len(pairs):
            pairs[i] = ranks.get(piece[ends[i] : ends[i + 2]], none)
        if i:
            pairs[i - 1] = ranks.get(piece[ends[i - 1] : ends[i + 1]], none)
    return [ranks[piece[a:b]] for a, b in zip(ends, ends[1:])]


@remembered
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file that every worker has installed."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Merged(dict):
    """Bounded memo of slices as packed ids."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        ids = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


def encode_events(
    events: DataFrame,
    vocabulary: str,
    *,
    id_col: str = "event_id",
    text_col: str = "event",
    offsets: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id_col, *keep, n_tokens long, ids binary)``: ids as little-endian unsigned 32-bit numbers.

    ``vocabulary`` is the path of a rank file at every worker. With ``offsets`` a column
    ``ends`` (same packing) holds the byte in the text at which each token ends. Null
    and empty texts have no token. No special tokens.
    """

    def make():
        encode = _encoder(vocabulary)
        lengths = _token_lengths(vocabulary) if offsets else None

        def work(bodies):
            out = encode(bodies)
            cols = [[len(p) // 4 for p in out], out]
            if offsets:
                cols.append([np.cumsum(lengths[np.frombuffer(p, "<u4")], dtype=np.uint32).astype("<u4").tobytes() for p in out])
            return cols

        return work

    fields = [("n_tokens", "long"), ("ids", "binary")] + [("ends", "binary")] * offsets
    return map_texts(events, [id_col, *keep], text_col, fields, make)


def _encoder(vocabulary: str):
    """A function from UTF-8 texts to their packed ids."""
    merged = _Merged(load_ranks(vocabulary))
    sep = chr(0x10FFFE)

    def encode(bodies: list[bytes]) -> list[bytes]:
        texts = [b.decode("utf-8", "replace") for b in bodies]
        # the separator is a noncharacter; a text that holds it is cut alone, with its own sign kept
        alone = [sep in t for t in texts]
        joined = sep.join("" if a else t for t, a in zip(texts, alone, strict=True)) + sep
        packed = _pack(joined, merged, sep)
        return [_pack_one(t, merged) if a else p for t, a, p in zip(texts, alone, packed, strict=True)]

    return encode


def _decoder(vocabulary: str):
    """A function from packed ids to the bytes they stand for."""
    ranks = load_ranks(vocabulary)
    tokens = [b""] * (max(ranks.values(), default=0) + 1)
    for token, i in ranks.items():
        tokens[i] = token

    def decode(ids: list[bytes]) -> list[bytes]:
        return [b"".join(map(tokens.__getitem__, np.frombuffer(b, "<u4").tolist())) for b in ids]

    return decode


def _token_lengths(vocabulary: str) -> np.ndarray:
    ranks = load_ranks(vocabulary)
    lengths = np.zeros(max(ranks.values(), default=0) + 1, np.uint32)
    for token, i in ranks.items():
        lengths[i] = len(token)
    return lengths


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _pack(joined: str, merged: _Merged, sep: str) -> list[bytes]:
    """Packed ids of each text in ``joined``, every one closed by ``sep``."""
    at = np.flatnonzero(boundaries(_codes(joined))).tolist()
    at.append(len(joined))
    pieces = [joined[a:b] for a, b in zip(at, at[1:])]
    out, start = [], 0
    for i, p in enumerate(pieces):
        if p == sep:
            out.append(b"".join(map(merged.__getitem__, pieces[start:i])))
            start = i + 1
    return out


def _pack_one(text: str, merged: _Merged) -> bytes:
    codes = _codes(text).copy()
    codes[codes == 0x10FFFE] = 0x10FFFF  # also a noncharacter, so of the same class
    at = [*np.flatnonzero(boundaries(codes)).tolist(), len(text)]
    return b"".join(merged[text[a:b]] for a, b in zip(at, at[1:]))


def decode_events(
    encoded: DataFrame, vocabulary: str, *, id_col: str = "event_id", ids_col: str = "ids", out: str = "decoded", keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(id_col, *keep, out binary)``: the bytes that packed ids stand for; null ids are none."""

    def make():
        decode = _decoder(vocabulary)
        return lambda bodies: [decode(bodies)]

    return map_texts(encoded, [id_col, *keep], ids_col, [(out, "binary")], make)


def round_trip_events(
    events: DataFrame, vocabulary: str, *, id_col: str = "event_id", text_col: str = "event", compare: bool = False
) -> DataFrame:
    """Encode and decode in one pass: ``(id_col, n_tokens long, ids binary, decoded binary)``.

    With ``compare`` the last column is ``round_trip boolean`` instead, whether the decoded bytes are the text's.
    One row per input row, repeated ones too; null and empty texts have no tokens and come back empty. An empty
    table has no rows.
    """

    def make():
        encode, decode = _encoder(vocabulary), _decoder(vocabulary)

        def work(bodies):
            ids = encode(bodies)
            back = decode(ids)
            last = [a == b for a, b in zip(bodies, back, strict=True)] if compare else back
            return [len(p) // 4 for p in ids], ids, last

        return work

    last = ("round_trip", "boolean") if compare else ("decoded", "binary")
    return map_texts(events, [id_col], text_col, [("n_tokens", "long"), ("ids", "binary"), last], make)
