"""LM scoring by online logistic context mixing: hashed-context bit predictors, gated weights, adapted while a text is read.

A token is written in bits: words of the broadcast vocabulary, the end and an escape have a prefix code made from their
training counts, other words follow the escape letter by letter, with a prefix code of bytes. For every bit, predictors
look up counts of zeros and ones in hashed tables under contexts of growing order (code node alone, with the word before,
with two words before; inside a spelled word two to four bytes before). Their log-odds are mixed by weights chosen by a
gate, and each text goes on improving its own copy of the weights as it is read. A spelled word that the training texts
have gets, besides its spelling's, the probability of its exact count, mixed by the share of unseen words (Good-Turing).
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftlight.llm.common import HOT_CHARS, HOT_ENTRIES, blocks, columns, crc_fold, frequent, resident, written

#: log2 of the slots of each table: three for words, three for spelled bytes.
TABLE_BITS = (20, 21, 22, 18, 20, 20)
#: Slots that travel together when counts of the tasks are summed.
BLOCK_BITS = 14
#: Bits above a slot of any table, where a code's bit keeps its stage and itself.
MARK = 24
#: What is added to both counts of a slot, and the scale of log-odds stored in 16 bits.
PRIOR, SCALE = 0.3, 2048.0
#: Bits after which a text's weights are adapted, the rate, and a damping number of bits.
STEP, RATE, DAMP = 2048, 0.6, 200.0
#: Gates, and the log-odds above which a context counts as surely seen.
GATES, SURE = 108, 1.6
#: Bytes of text that are read at once, and tokens and spelled words that are expanded to bits at once.
TEXT_BLOCK, BIT_BLOCK, WORD_BLOCK = 4 << 20, 10_000, 1000
#: Log-odds to which the fit of the first weights rounds its inputs: one and two sightings of a slot lie on the grid.
GRID = (0.0, 0.25, 0.6, 1.0, 1.466, 2.037, 2.5, 3.1, 4.0, 5.2, 7.0, 9.5, 13.0)
#: Steps of that fit, its ridge towards the start, and the start: weights of the three orders of words and of spelled bytes.
FIT_STEPS, RIDGE, WORD_START, BYTE_START = 30, 20.0, (0.9, 0.1, 0.1), (0.3, 0.3, 0.4)
_M = np.uint32(2654435761)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of a column of texts laid end to end, A-Z lower-cased, and how many each text has; null counts as empty."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(column.fill_null("")))
    flat, size = lists.flatten().cast(pa.binary()), np.diff(lists.offsets.to_numpy())
    used = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(used, min_count=0).as_py():  # white space at the ends of a text
        before = np.concatenate(([0], np.cumsum(used.to_numpy(zero_copy_only=False))))
        flat, size = flat.filter(used), np.diff(before[np.concatenate(([0], np.cumsum(size)))])
    return flat, size


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Huffman's lengths: the two lightest nodes are merged again and again, from two queues that are both in order."""
    n = len(counts)
    order = np.argsort(counts, kind="stable")
    leaf, made, up = counts[order].tolist(), [], [0] * (2 * n - 1)
    i = j = 0
    for k in range(n, 2 * n - 1):
        weight = 0
        for _ in range(2):
            if j >= len(made) or i < n and leaf[i] <= made[j]:
                weight, up[i], i = weight + leaf[i], k, i + 1
            else:
                weight, up[n + j], j = weight + made[j], k, j + 1
        made.append(weight)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[up[k]] + 1
    if max(depth) > 30:  # codes have 32 bits: the rarest are given a few more sightings
        return code_lengths(np.maximum(counts, counts.sum() / (1 << 19)))
    out = np.empty(n, np.int64)
    out[order] = np.maximum(1, depth[:n])
    return out


def prefix_code(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and length of each symbol: canonical, lengths by Huffman's merges (so no code has fewer bits a token)."""
    length = code_lengths(counts)
    order = np.lexsort((np.arange(len(counts)), length))
    code, at, last = np.zeros(len(counts), np.int64), 0, 0
    sizes, first = np.unique(length[order], return_index=True)
    ends = [*first[1:].tolist(), len(order)]
    for size, a, z in zip(sizes.tolist(), first.tolist(), ends, strict=True):
        at <<= size - last
        code[order[a:z]] = at + np.arange(z - a)
        at, last = at + z - a, size
    return code.astype(np.uint32), length.astype(np.uint8)


def mixed(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    x = (a ^ (np.uint32(b) if np.isscalar(b) else b)) * _M
    return x ^ (x >> np.uint32(15))


@dataclass
class Alphabet:
    """Codes of words and bytes, and for each word symbol the hash under which it is a context."""

    vocab: pa.Array
    counts: np.ndarray  # training counts of the vocabulary
    code: np.ndarray  # vocabulary, end, escape
    length: np.ndarray
    byte_code: np.ndarray
    byte_length: np.ndarray

    @property
    def end(self) -> int:
        return len(self.vocab)

    def symbol_hash(self) -> np.ndarray:
        return mixed(np.arange(1, len(self.code) + 1, dtype=np.uint32), 0x51ED270B)


def expand(code: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each bit of the given codewords: the codeword's place, depth, code node (a leading one and the bits before), bit."""
    size = length.astype(np.int64)
    owner = np.repeat(np.arange(len(size), dtype=np.int32), size)
    depth = np.arange(len(owner), dtype=np.uint32) - np.repeat((np.cumsum(size) - size).astype(np.uint32), size)
    c = np.repeat(code, size)
    left = np.repeat(length.astype(np.uint32), size) - depth
    node = (c >> left) | (np.uint32(1) << depth)
    bit = (c >> (left - np.uint32(1))) & np.uint32(1)
    return owner, depth, node, bit.astype(bool)


def node_hash(node: np.ndarray, depth: np.ndarray, table: int) -> np.ndarray:
    """What a code node adds to its slot of a table; with context_hash() by exclusive or, as tabulation hashing has it.

    The seven nodes of three levels lie in eight slots side by side, so a codeword touches a third as many cache lines.
    """
    low = depth.astype(np.uint32) % np.uint32(3)
    one = np.uint32(1) << low
    h = mixed(mixed(node >> low, 0x9E3779B9 * (table + 1) & 0xFFFFFFFF), 0x7F4A7C15) * _M >> np.uint32(32 - TABLE_BITS[table])
    return (h & np.uint32(0xFFFFFFF8)) | one | (node & (one - np.uint32(1)))


def context_hash(context: np.ndarray, table: int) -> np.ndarray:
    h = mixed(mixed(context, 0x85EBCA6B * (table + 1) & 0xFFFFFFFF), 0x27D4EB2F) * _M >> np.uint32(32 - TABLE_BITS[table])
    return h & np.uint32(0xFFFFFFF8)


class Codes:
    """The bits of all codewords laid end to end, with what a bit brings along whatever its context is: for each table what
    its node adds to the slot, and above it (MARK) its stage and the bit, so that one look fetches all three."""

    def __init__(self, code: np.ndarray, length: np.ndarray, *tables: int):
        self.size = length.astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        _, depth, node, bit = expand(code, length)
        mark = np.minimum(depth >> np.uint32(1), np.uint32(3)) | bit.astype(np.uint32) << np.uint32(2)
        self.part = {t: node_hash(node, depth, t) | mark << np.uint32(MARK) for t in tables}

    def bits(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bits each symbol's codeword has, and for each bit its place among those of all codewords."""
        size = self.size[symbol]
        shift = self.first[symbol] - (np.cumsum(size) - size)
        place = np.repeat(shift, size)
        place += np.arange(len(place))
        return size, place

    def look(self, table: int, place: np.ndarray) -> np.ndarray:
        return np.take(self.part[table], place, mode="clip")


def slot_part(x: np.ndarray, table: int) -> np.ndarray:
    """What looks add to the slots of a table of no more bits than the one looked up."""
    return x & np.uint32((1 << TABLE_BITS[table]) - 1)


def marks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stage (depth in the code by two, three at most) and bit of each look."""
    mark = (x >> np.uint32(MARK)).astype(np.uint8)
    return mark & np.uint8(3), mark > np.uint8(3)


def spread(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slots in the width that gathers like best, one for each bit."""
    return np.repeat(x.astype(np.int64), size)


def signs(bit: np.ndarray) -> np.ndarray:
    return bit.astype(np.float32) * np.float32(2) - np.float32(1)


class Reader:
    """Turns a block of texts into word codes; words that are not in the vocabulary are numbered within the block."""

    def __init__(self, alphabet: Alphabet):
        self.a, self.hash = alphabet, alphabet.symbol_hash()
        self.codes = Codes(alphabet.code, alphabet.length, 2)
        self.spelled: list[bytes] = []

    def read(self, column: pa.Array):
        """Codes of all tokens of the texts laid end to end (an end after each), and where each text ends."""
        flat, size = split_words(column)
        found = pc.index_in(flat, value_set=self.a.vocab)
        code = found.fill_null(-1).to_numpy().astype(np.int64)
        new = flat.filter(found.is_null()).dictionary_encode()
        code[code < 0] = len(self.a.code) + new.indices.to_numpy()
        self.spelled = new.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.tail_hash = np.fromiter(map(zlib.crc32, self.spelled), np.uint32, len(self.spelled))
        ends = np.cumsum(size + 1)
        out = np.full(int(ends[-1]) if len(ends) else 0, self.a.end, np.int64)
        inner = np.ones(len(out), bool)
        inner[ends - 1] = False
        out[inner] = code
        return out, ends

    def parts(self, codes: np.ndarray, ends: np.ndarray):
        """The texts in blocks of about BIT_BLOCK tokens: first text, codes, ends."""
        first = np.flatnonzero(np.diff((ends - 1) // BIT_BLOCK, prepend=-1)).tolist()
        for i, j in zip(first, [*first[1:], len(ends)], strict=True):
            begin = int(ends[i - 1]) if i else 0
            yield i, codes[begin : ends[j - 1]], ends[i:j] - begin

    def expanded(self, codes: np.ndarray, ends: np.ndarray):
        """Bits of each word symbol; per bit stage, bit and its places in the three tables."""
        known = len(self.a.code)
        tail = codes >= known
        symbol = np.where(tail, known - 1, codes)
        h = self.hash[symbol]
        if tail.any():
            h[tail] = self.tail_hash[codes[tail] - known]
        one = np.empty_like(h)
        one[1:] = h[:-1]
        two = np.empty_like(h)
        two[2:] = h[:-2]
        begin = np.concatenate(([0], ends[:-1])).astype(np.int64)
        one[begin] = 1
        two[begin] = 1
        second = begin + 1
        two[second[second < len(two)]] = 1
        two = mixed(one + np.uint32(77), two)
        size, place = self.codes.bits(symbol)
        node = self.codes.look(2, place)
        at = [place, spread(context_hash(one, 1), size), spread(context_hash(two, 2), size)]
        at[1] ^= slot_part(node, 1)
        at[2] ^= slot_part(node, 2)
        return size, *marks(node), at

    def bits(self, codes: np.ndarray, ends: np.ndarray):
        """Per bit of all word symbols: token, stage, bit and its places in the three tables."""
        size, *more = self.expanded(codes, ends)
        return np.repeat(np.arange(len(size)), size), *more


def spelled_bits(ws: list[bytes], codes: Codes):
    """Per bit of the bytes of the words (each closed by a space): word, stage, bit, slots."""
    flat = np.frombuffer(b" ".join(ws) + b" ", np.uint8)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 1
    word = np.repeat(np.arange(len(ws)), size)
    place = np.arange(len(flat)) - (np.cumsum(size) - size)[word]
    bits, at = codes.bits(flat)
    slots, ctx = [], np.zeros(len(flat), np.uint32)
    for k in range(1, 5):
        prev = np.zeros(len(flat), np.uint32)
        prev[k:] = flat[:-k] + np.uint32(1)
        prev[place < k] = 0
        ctx = ctx * np.uint32(257) + prev
        if k > 1:
            slots.append(spread(context_hash(ctx, k + 1), bits))
            node = codes.look(k + 1, at)
            slots[-1] ^= slot_part(node, k + 1)
    return np.repeat(word, bits), *marks(node), slots


def gates(stage: np.ndarray, s: np.ndarray, run: np.ndarray | np.uint8 = np.uint8(0)) -> np.ndarray:
    """Which weights a bit takes: by its stage in the code, by whether the higher orders were never, once or more surely seen,
    and by how many of the two tokens before the highest order had foretold (a text that copies another goes on copying)."""
    size = np.abs(s[1:])
    level = (size > 0).astype(np.uint8) + (size > SURE).astype(np.uint8)
    return ((stage * np.uint8(3) + run) * np.uint8(3) + level[1]) * np.uint8(3) + level[0]


def foretold(owner: np.ndarray, s: np.ndarray, sign: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each bit, of the two tokens before its own in the text how many in a row had every bit foretold by order two."""
    return foretold_by(np.bincount(owner), s, sign, ends)


def foretold_by(size: np.ndarray, s: np.ndarray, sign: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """foretold() by the number of bits of each token."""
    misses = np.cumsum(s[2] * sign <= 0, dtype=np.int32)[np.cumsum(size) - 1]
    hit = np.diff(misses, prepend=0) == 0
    hit[ends - 1] = False  # nothing is carried over from one text to the next
    one = np.concatenate(([False], hit[:-1]))
    two = np.concatenate(([False], one[:-1])) & one
    return np.repeat(one.astype(np.uint8) + two, size)


class Counts:
    """Zeros and ones of every slot, as one task sees them, and how often the mixed inputs came out as they did.

    Before bits are counted they are predicted from what the task has counted so far, as a text is that nobody has seen;
    inputs, gate and outcome go into two more tables (words, spelled bytes) of GATES blocks, from which weights are fitted.
    """

    def __init__(self, first: np.ndarray | None = None):
        self.n = [np.zeros(2 << b if t else 0, np.uint32) for t, b in enumerate(TABLE_BITS)]
        self.n += [np.zeros(GATES << (BLOCK_BITS + 1), np.uint32) for _ in range(2)]
        self.first = first

    def inputs(self, tables: range, at: list[np.ndarray]) -> np.ndarray:
        """16-bit log-odds by the counts so far; those of the lowest order of words are the whole corpus's."""
        out = np.empty((3, len(at[0])), np.int16)
        for row, t, slot in zip(out, tables, at, strict=True):
            if t == 0:
                row[:] = np.take(self.first, slot, mode="clip")
                continue
            both = np.take(self.n[t].view(np.uint64), slot, mode="clip").view(np.int32).astype(np.float32)
            both += np.float32(PRIOR)
            odds = np.log(both[1::2] / both[::2])
            odds *= np.float32(SCALE)
            row[:] = np.clip(np.rint(odds, out=odds), -32767, 32767, out=odds)
        return out

    def add(self, tables: range, at: list[np.ndarray], bit: np.ndarray) -> None:
        for t, slot in zip(tables, at, strict=True):
            np.add.at(self.n[t], (slot << 1) | bit, np.uint32(1))

    def learn(self, words: bool, gate: np.ndarray, odds: np.ndarray, bit: np.ndarray) -> None:
        cell = gate.astype(np.int64)
        cell <<= BLOCK_BITS
        level = np.take(_levels(), odds.view(np.uint16), mode="clip")
        n = np.int32(2 * len(GRID) - 1)
        cell += (level[0] * n + level[1]) * n + level[2]
        np.add.at(self.n[6 if words else 7], (cell << 1) | bit, np.uint32(1))

    def rows(self):
        """(table, block, places, zeros, ones) of the blocks that have any; counts over 16 bits take several rows."""
        for t, n in enumerate(self.n):
            n = n.reshape(-1, 2)
            used = np.flatnonzero(n.view(np.uint64)[:, 0])
            ends = np.searchsorted(used, np.arange((len(n) >> BLOCK_BITS) + 1) << BLOCK_BITS).tolist()
            for b, (lo, hi) in enumerate(zip(ends, ends[1:])):
                own = used[lo:hi]
                zero, one = n[own, 0], n[own, 1]
                while len(own):
                    z, o = np.minimum(zero, 65535), np.minimum(one, 65535)
                    yield t, b, (own & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes(), z.astype("<u2").tobytes(), o.astype("<u2").tobytes()
                    zero, one = zero - z, one - o
                    rest = (zero | one) > 0
                    own, zero, one = own[rest], zero[rest], one[rest]


_COUNT_SCHEMA = "t int, b int, places binary, zeros binary, ones binary"


def _count_batch(rows) -> pa.RecordBatch:
    t, b, p, z, o = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(b, pa.int32()), pa.array(p, pa.binary()), pa.array(z, pa.binary()), pa.array(o, pa.binary())], names=["t", "b", "places", "zeros", "ones"])


def _emit(counts: Counts):
    some = []
    for row in counts.rows():
        some.append(row)
        if len(some) == 64:
            yield _count_batch(some)
            some = []
    if some:
        yield _count_batch(some)


def _summed(batches):
    """Adds up the counts of the blocks of this partition; gives log-odds and saturated totals of each slot."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    for x in batches:
        for t, b, p, z, o in zip(*(c.to_pylist() for c in x.columns), strict=True):
            n = sums.setdefault((t, b), np.zeros((2, 1 << BLOCK_BITS), np.int64))
            at = np.frombuffer(p, "<u2")
            n[0][at] += np.frombuffer(z, "<u2")
            n[1][at] += np.frombuffer(o, "<u2")
    if sums:
        odds, totals = [], []
        for (t, _), n in sums.items():
            if t < len(TABLE_BITS):
                odds.append(_log_odds(*n).tobytes())
                totals.append(b"")
            else:  # outcomes of inputs stay counts
                used = np.flatnonzero(n.any(axis=0))
                odds.append(used.tobytes())
                totals.append(n[:, used].tobytes())
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array(odds, pa.binary()), pa.array(totals, pa.binary())], names=["t", "b", "odds", "totals"])


@cache
def _levels() -> np.ndarray:
    """For each 16-bit log-odds, by its bits as an unsigned number, the nearest point of the grid (mirrored for negatives)."""
    x = np.arange(1 << 16, dtype=np.uint16).view(np.int16) / SCALE
    near = np.searchsorted((np.array(GRID[1:]) + np.array(GRID[:-1])) / 2, np.abs(x))
    return (len(GRID) - 1 + np.where(x < 0, -near, near)).astype(np.uint8)


def fitted(blocks: list[tuple[int, np.ndarray, np.ndarray]], start: tuple[float, float, float]) -> np.ndarray:
    """The weights (3, gates) under which the outcomes of all inputs, (gate, cells, (zeros, ones)), are likeliest, by Newton's
    method; a ridge keeps those that hardly occurred at the start."""
    out = np.tile(np.array(start, float)[:, None], (1, GATES))
    point = np.concatenate([-np.array(GRID[:0:-1]), GRID])
    for gate, cells, n in blocks:
        x = point[np.stack([cells // len(point) ** 2, cells // len(point) % len(point), cells % len(point)])]
        loss = lambda w: (n * np.logaddexp(0, [w @ x, -(w @ x)])).sum() + RIDGE / 2 * ((w - start) ** 2).sum()  # noqa: B023, E731
        w = np.array(start, float)
        for _ in range(FIT_STEPS):
            p = 1 / (1 + np.exp(-(w @ x)))
            slope = x @ (n.sum(axis=0) * p - n[1]) + RIDGE * (w - start)
            step = np.linalg.solve((x * (n.sum(axis=0) * p * (1 - p))) @ x.T + RIDGE * np.eye(3), slope)
            was, size = loss(w), 1.0
            while size > 1e-6 and loss(w - size * step) > was:
                size /= 2
            w = w - size * step
            if np.abs(size * step).max() < 1e-6:
                break
        out[:, gate] = w
    return out.astype(np.float32)


def adapt(weights: np.ndarray, g: np.ndarray, s: np.ndarray, miss: np.ndarray, update: bool = True) -> None:
    """Writes the odds against the outcome of some bits under the weights (3, gates) into miss; then the weights take one step
    down the gradient of the log loss, gate by gate. s is the inputs times the sign of the bit."""
    z = np.take(weights[0], g, mode="clip")
    z *= s[0]
    for k in (1, 2):
        part = np.take(weights[k], g, mode="clip")
        part *= s[k]
        z += part
    np.exp(np.minimum(np.negative(z, out=z), np.float32(30), out=z), out=miss)
    if update:
        e = miss / (miss + np.float32(1))
        n = np.bincount(g, minlength=weights.shape[1]) + DAMP
        for k in range(3):
            weights[k] += (RATE * np.bincount(g, e * s[k], weights.shape[1]) / n).astype(weights.dtype)


def _log_odds(zero: np.ndarray, one: np.ndarray) -> np.ndarray:
    """16-bit log-odds of slots (zero where nothing was counted)."""
    s = np.log((one + PRIOR) / (zero + PRIOR)) * SCALE
    return np.where(zero + one > 0, np.clip(np.rint(s), -32767, 32767), 0).astype("<i2")


def _order_zero(a: Alphabet, counts: np.ndarray) -> np.ndarray:
    """The log-odds of the lowest order at each place of all codewords, from the symbols' counts: the same sums as counting
    the bits of all texts."""
    n = np.zeros(2 << TABLE_BITS[0], np.int64)
    parts = [slice(i, i + 20_000) for i in range(0, len(a.code), 20_000)]
    for part in parts:
        owner, depth, node, bit = expand(a.code[part], a.length[part])
        np.add.at(n, (node_hash(node, depth, 0).astype(np.int64) << 1) | bit, counts[part][owner])
    odds = _log_odds(n[0::2], n[1::2])
    out = []
    for part in parts:
        _, depth, node, _ = expand(a.code[part], a.length[part])
        out.append(odds[node_hash(node, depth, 0)])
    return np.concatenate(out)


@dataclass
class Model:
    alphabet: Alphabet
    odds: list[np.ndarray]  # 16-bit log-odds of each table
    word_weights: np.ndarray
    byte_weights: np.ndarray
    total: int
    distinct: int
    ends: int
    tail_total: int  # training tokens outside the vocabulary
    tail_known: float  # chance that such a token has been seen before
    fitted_bits: tuple[int, int]  # bits of words, and of spelled bytes, to which the first weights were fitted

    def inputs(self, tables: range, at: list[np.ndarray]) -> np.ndarray:
        out = np.empty((3, len(at[0])), np.float32)
        for row, t, slot in zip(out, tables, at, strict=True):
            row[:] = np.take(self.odds[t], slot, mode="clip")
        out *= np.float32(1 / SCALE)
        return out

    def spelling_loss(self, ws: list[bytes], codes: Codes) -> np.ndarray:
        """Natural-log loss of spelling each word; its weights are the fitted ones."""
        out = np.zeros(len(ws))
        for i in range(0, len(ws), WORD_BLOCK):
            part = ws[i : i + WORD_BLOCK]
            owner, stage, bit, at = spelled_bits(part, codes)
            s = self.inputs(range(3, 6), at)
            g = gates(stage, s).astype(np.int64)
            z = self.byte_weights[0][g] * s[0]
            z += self.byte_weights[1][g] * s[1]
            z += self.byte_weights[2][g] * s[2]
            z *= -signs(bit)
            out[i : i + len(part)] = np.bincount(owner, np.log(np.exp(np.minimum(z, np.float32(30))) + np.float32(1)), len(part))
        return out

    def base_log10(self, n) -> np.ndarray:
        return np.log10((np.asarray(n, float) + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def train(docs: DataFrame, text_col: str = "text", hot: int = HOT_ENTRIES) -> tuple[Model, DataFrame]:
    """The model of all texts of docs, and the table (word, n) of all their words.

    Word counts, and the zeros and ones of every slot, are summed over all texts by tasks first and then by slot range;
    the driver receives the tables' log-odds, whose size is fixed by TABLE_BITS, and at most `hot` words. The weights from
    which every text starts are fitted to every bit of every training text and spelled word: a task predicts each block from
    what it counted before it, and how often which inputs (rounded to GRID) had which outcome is summed over all tasks.
    So the weights, unlike the counts, depend a little on how the rows are dealt to tasks.
    """
    spark = docs.sparkSession
    docs = docs.select(docs[text_col].alias("text"))

    def count_words(batches):
        held = []
        for b in blocks(batches, 8 << 20):
            counted = split_words(b.column("text"))[0].value_counts()
            held.append(pa.table({"word": counted.field(0), "n": counted.field(1)}))
            if sum(x.num_rows for x in held) > 1_000_000:
                held = [merged(held)]
                if held[0].num_rows > 500_000:
                    yield from held.pop().to_batches()
        if held:
            yield from merged(held).to_batches()

    def merged(held):
        return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    table = written(docs.mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    ends = docs.count()
    whole = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("n") == 1).alias("once")).collect()[0]
    total, distinct = whole["n"] + ends, whole["v"] + (ends > 0)
    least = frequent(table, "word", most=hot)
    vocabulary = (F.col("n") >= max(2, least)) & (F.length("word") <= HOT_CHARS)
    top = table.filter(vocabulary).toArrow()
    order = np.argsort(-top.column("n").to_numpy(), kind="stable")
    vocab = pa.concat_arrays([x.cast(pa.binary()) for x in top.column("word").chunks] or [pa.array([], pa.binary())]).take(pa.array(order))
    counts = top.column("n").to_numpy()[order]
    del top
    code, length = prefix_code(np.concatenate([counts, [max(1, ends), max(1, whole["n"] - counts.sum())]]).astype(float))
    tail = table.filter(~vocabulary)

    def count_bytes(batches):
        n = np.zeros(256, np.int64)
        for b in batches:
            for w in b.column("word").to_pylist():
                n += np.bincount(np.frombuffer(w, np.uint8), minlength=256)
            n[32] += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(n)], names=["c", "n"])

    per_byte = np.ones(256)
    for r in tail.select("word").mapInArrow(count_bytes, "c int, n long").groupBy("c").agg(F.sum("n").alias("n")).collect():
        per_byte[r["c"]] += r["n"]
    alphabet = Alphabet(vocab, counts, code, length, *prefix_code(per_byte))
    odds = [np.zeros(1 << b, "<i2") for b in TABLE_BITS]
    odds[0] = _order_zero(alphabet, np.concatenate([counts, [ends, whole["n"] - counts.sum()]]))
    shared, resident_key = spark.sparkContext.broadcast((alphabet, odds[0])), f"mixing-{uuid.uuid4().hex}"

    def count_bits(batches):
        a, first = shared.value
        reader, c = resident(resident_key, lambda: Reader(a)), Counts(first)
        for b in blocks(batches, TEXT_BLOCK):
            for _, codes, at_ends in reader.parts(*reader.read(b.column("text"))):
                size, stage, bit, at = reader.expanded(codes, at_ends)
                o = c.inputs(range(3), at)
                s = o * np.float32(1 / SCALE)
                c.learn(True, gates(stage, s, foretold_by(size, s, signs(bit), at_ends)), o, bit)
                c.add(range(1, 3), at[1:], bit)
        yield from _emit(c)

    def count_spelling(batches):
        a, _ = shared.value
        byte_codes, c = Codes(a.byte_code, a.byte_length, 3, 4, 5), Counts()
        for b in batches:
            ws = b.column("word").to_pylist()
            for i in range(0, len(ws), WORD_BLOCK):
                _, stage, bit, at = spelled_bits(ws[i : i + WORD_BLOCK], byte_codes)
                o = c.inputs(range(3, 6), at)
                c.learn(False, gates(stage, o * np.float32(1 / SCALE)), o, bit)
                c.add(range(3, 6), at, bit)
        yield from _emit(c)

    # a spelled word counts once however often it occurs: what is learnt is how new words look
    parts = docs.mapInArrow(count_bits, _COUNT_SCHEMA).unionByName(tail.select("word").mapInArrow(count_spelling, _COUNT_SCHEMA))
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    summed = parts.repartition(n_parts, "t", "b").mapInArrow(_summed, "t int, b int, odds binary, totals binary")
    summed = written(summed, "slots")
    for t in range(1, len(TABLE_BITS)):  # one table at a time, which keeps the driver small
        got = summed.filter(F.col("t") == t).select("b", "odds").toArrow()
        for b, o in zip(got.column(0).to_pylist(), got.column(1), strict=True):
            odds[t][b << BLOCK_BITS : (b + 1) << BLOCK_BITS] = np.frombuffer(o.as_buffer(), "<i2")
        del got
    weights, fitted_bits = [], []
    for t, start in ((6, WORD_START), (7, BYTE_START)):
        got = summed.filter(F.col("t") == t).select("b", "odds", "totals").collect()
        outcomes = [(r["b"], np.frombuffer(r["odds"], np.int64), np.frombuffer(r["totals"], np.int64).reshape(2, -1)) for r in got]
        weights.append(fitted(outcomes, start))
        fitted_bits.append(int(sum(n.sum() for _, _, n in outcomes)))
    tail_total = int(whole["n"] - counts.sum())
    tail_known = min(0.999, 1 - whole["once"] / tail_total) if tail_total else 0.0
    return Model(alphabet, odds, *weights, total, distinct, ends, tail_total, tail_known, tuple(fitted_bits)), table


def score_blocks(model: Model, reader: Reader, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Natural-log loss of each text but for the spelling of escaped words; also its codes and where it ends."""
    codes, ends = reader.read(column)
    loss = np.zeros(len(ends))
    for first, own, own_ends in reader.parts(codes, ends):
        size, stage, bit, at = reader.expanded(own, own_ends)
        s, sign = model.inputs(range(3), at), signs(bit)
        g = gates(stage, s, foretold_by(size, s, sign, own_ends)).astype(np.int64)
        s *= sign
        stop, miss = np.cumsum(size)[own_ends - 1], np.empty(len(g), np.float32)
        a = 0  # bits before it are done; texts that never adapt wait for the next that does
        for begin, z in zip([0, *stop[:-1].tolist()], stop.tolist(), strict=True):
            if z - begin <= STEP:
                continue
            if a < begin:
                adapt(model.word_weights, g[a:begin], s[:, a:begin], miss[a:begin], update=False)
            weights, a = model.word_weights.copy(), begin
            while a < z:
                e = min(a + STEP, z)
                adapt(weights, g[a:e], s[:, a:e], miss[a:e], update=e < z)
                a = e
        if a < len(g):
            adapt(model.word_weights, g[a:], s[:, a:], miss[a:], update=False)
        miss += np.float32(1)
        loss[first : first + len(stop)] = np.add.reduceat(np.log(miss, out=miss), np.concatenate(([0], stop[:-1])), dtype=np.float64)
    return loss, codes, ends


def score(docs: DataFrame, folds: int = 10, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_ENTRIES) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) per row.

    The model learns from rows whose crc32 fold of the id is not 0 (a null id folds as the empty string) and every row is
    scored whole. Null and empty texts are the end alone. score is the model's log10 probability of the text, base_score
    that of the smoothed unigram; counts of words outside the broadcast vocabulary are joined by a shuffle. Without
    training rows the codes fall back to uniform guesses. Repeated rows score alike; further columns are dropped.
    """
    spark = docs.sparkSession
    key = docs.schema[id_col].dataType.simpleString()
    docs = columns(docs, id_col, text_col).toDF("key", "text")
    model, table = train(docs.filter(crc_fold("key", folds) != 0), "text", hot)
    shared, resident_key = spark.sparkContext.broadcast(model), f"mixing-{uuid.uuid4().hex}"

    def run(batches):
        m = shared.value
        a = m.alphabet
        reader, known, byte_codes = resident(resident_key, lambda: Reader(a)), len(a.code), Codes(a.byte_code, a.byte_length, 3, 4, 5)
        base = np.concatenate([m.base_log10(a.counts), m.base_log10([m.ends]), [0.0]])
        for b in blocks(batches, TEXT_BLOCK):
            loss, codes, ends = score_blocks(m, reader, b.column("text"))
            spelling = m.spelling_loss(reader.spelled, byte_codes)
            begin = np.concatenate(([0], ends[:-1]))
            sizes = ends - begin
            hit = codes < known
            first = np.add.reduceat(np.where(hit, base[np.where(hit, codes, known - 1)], 0.0), begin)
            n_known = np.add.reduceat(hit.astype(np.int64), begin) - (m.ends == 0)
            n_bytes = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            tail = np.flatnonzero(~hit)
            of = np.searchsorted(ends, tail, side="right")
            pair, f = np.unique(of * (1 << 32) + (codes[tail] - known), return_counts=True)
            own, which = pair >> 32, pair & 0xFFFFFFFF
            n, none = b.num_rows, len(pair)
            uids = b.column("_uid").to_numpy()
            lead = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(none, kind)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([uids, uids[own]])), pa.concat_arrays([b.column("key"), pa.nulls(none, b.column("key").type)]), lead(sizes, pa.int64()), lead(n_known, pa.int64()), lead(first, pa.float64()),
                    lead(-loss / np.log(10), pa.float64()), pa.concat_arrays([n_bytes, pa.nulls(none, pa.int64())]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array(reader.spelled, pa.binary()).take(pa.array(which))]),
                    pa.array(np.concatenate([np.zeros(n, np.int64), f])), pa.array(np.concatenate([np.zeros(n), -spelling[which] / np.log(10)])),
                ],
                names=["_uid", "key", "n_tokens", "n_known", "base", "score", "n_bytes", "word", "f", "spell"],
            )

    parts = docs.withColumn("_uid", F.monotonically_increasing_id()).mapInArrow(run, f"_uid long, key {key}, n_tokens long, n_known long, base double, score double, n_bytes long, word binary, f long, spell double")
    # rows of documents have no word; a key of their own deals them out evenly
    parts = parts.withColumn("k", F.when(F.col("word").isNull(), F.xxhash64("_uid")).otherwise(F.xxhash64("word")))
    joined = parts.join(table.select(F.xxhash64("word").alias("k"), "word", "n"), ["k", "word"], "left")
    smooth = model.total + 0.1 * (model.distinct + 1)
    more = F.col("f") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(smooth))
    seen, unseen = model.tail_known / max(1, model.tail_total), 1 - model.tail_known
    own = F.when(F.col("n").isNull(), F.col("spell") + float(np.log10(unseen))).otherwise(F.log10(F.col("n") * F.lit(seen) + F.pow(F.lit(10.0), F.col("spell")) * F.lit(unseen)))
    per = joined.groupBy("_uid").agg(
        F.max("key").alias("key"), F.max("n_tokens").alias("n_tokens"), F.sum(F.coalesce("n_known", F.lit(0)) + F.when(F.col("n").isNotNull(), F.col("f")).otherwise(0)).alias("n_known"),
        F.sum(F.coalesce("base", F.lit(0.0)) + more).alias("base_score"), F.sum(F.coalesce("score", F.lit(0.0)) + F.when(F.col("word").isNull(), 0.0).otherwise(F.col("f") * own)).alias("score"), F.max("n_bytes").alias("n_bytes"),
    )
    return per.select(
        F.col("key").alias(id_col), (crc_fold("key", folds) == 0).alias("held_out"), "n_tokens", F.col("n_known").cast("long").alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest(F.lit(1), "n_bytes")).alias("bits_per_byte"),
    )
