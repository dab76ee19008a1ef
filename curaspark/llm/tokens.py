"""Token counts by a compiled finite-state transducer.

The pre-tokenizer of a byte-level BPE is compiled to a deterministic transducer
over character classes: states say what kind of piece is open, transitions are
annotated with the piece starts that they settle (at this character, or one
back).  A text is cut into chunks; each chunk's map from entry state to exit
state is computed for all states at once, the maps compose in a parallel prefix
scan, and a second run from the known entry states emits the piece starts.
Inside a piece an automaton over the vocabulary's trie reads byte by byte; each
transition carries the token that the prefix now ends with and the number of
tokens so far (``Machine``).  All distinct pieces of a slice are read together.

Special strings are found first, as the library does by default, count as one
token and cut the text.  Edge cases: a null text is empty and has 0 tokens; any
length of text is counted whole; an empty table gives an empty result; repeated
rows and extra columns change nothing.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from . import arrays, shared

# character classes; letters that can stand in a contraction are classes of their own
SPACE, WHITE, LETTER, NUMBER, OTHER, QUOTE, ONE, RV, E_, L_ = range(10)
CLASSES = 10
#: states: what the open piece is. A: an apostrophe that opened a piece; AR, AL: the same and r or v, l; DONE: after a contraction;
#: W1S, W1O, W2S, W2O: white space of one or more characters that ends in a space or another one
START, LET, NUM, OTH, A, AR, AL, DONE, W1S, W1O, W2S, W2O = range(12)
STATES = 12
#: white space as the pattern's \s has it: fixed values
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CHUNK = 128


def class_table() -> np.ndarray:
    """Class of each code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[list(WHITE_SPACE)] = WHITE
    for c, k in ((" ", SPACE), ("'", QUOTE), *((x, ONE) for x in "stmd"), *((x, RV) for x in "rv"), ("e", E_), ("l", L_)):
        out[ord(c)] = k
    return out


def compile_transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by class * STATES + state.

    Classes from CLASSES on are the same at the start of a text; class 2 * CLASSES ends the last one.
    Emission: 1 a piece starts at this character, 2 one starts at the character before.
    """
    n = 2 * CLASSES + 1
    to, emit = np.zeros((n, STATES), np.uint8), np.zeros((n, STATES), np.uint8)
    own = {LETTER: LET, ONE: LET, RV: LET, E_: LET, L_: LET, NUMBER: NUM, OTHER: OTH, QUOTE: A}

    def step(c: int, s: int) -> tuple[int, int]:
        if s == AR:
            return (DONE, 0) if c == E_ else _or(step(c, LET), 2)
        if s == AL:
            return (DONE, 0) if c == L_ else _or(step(c, LET), 2)
        if s == A:
            if c == ONE:
                return DONE, 0
            if c in (RV, L_):
                return (AR if c == RV else AL), 0
            return (OTH, 0) if c in (QUOTE, OTHER) else step(c, OTH)
        if c in (SPACE, WHITE):
            if s in (W1S, W1O, W2S, W2O):
                return (W2S if c == SPACE else W2O), 0
            return (W1S if c == SPACE else W1O), 1
        if s == W1S:  # the space belongs to the piece that starts here
            return (OTH if c == QUOTE else own[c]), 0
        if s == W2S:
            return (OTH if c == QUOTE else own[c]), 2
        if s == W2O:
            return own[c], 3
        if own[c] == s or (s == OTH and c == QUOTE):
            return s, 0
        return own[c], 1

    def _or(x, bits):
        return x[0], x[1] | bits

    for c in range(CLASSES):
        for s in range(STATES):
            to[c, s], emit[c, s] = step(c, s)
            first = step(c, START)
            to[CLASSES + c, s], emit[CLASSES + c, s] = first[0], 1 | (2 if s in (AR, AL) else 0)
    emit[2 * CLASSES, [AR, AL]] = 2
    return to.ravel(), emit.ravel()


def piece_starts(classes: np.ndarray, to: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Where pieces start; ``classes`` as of compile_transducer, any number of texts one after the other."""
    n = len(classes)
    if not n:
        return np.zeros(0, np.int64)
    rows = n // CHUNK + 1
    grid = np.full(rows * CHUNK, 2 * CLASSES, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T).astype(np.uint16) * STATES
    # chunk maps: exit state for each entry state; most maps become constant after a few characters
    maps = np.empty((rows, STATES), np.uint8)
    left, m = np.arange(rows), np.broadcast_to(np.arange(STATES, dtype=np.uint8), (rows, STATES))
    single = np.full(rows, 255, np.uint8)
    for t in range(CHUNK):
        m = to[grid[t, left][:, None] + m]
        if t and single.any() and (done := single != 255).any():
            single[done] = to[grid[t, done] + single[done]]
        if t % 8 == 7:
            flat = (m == m[:, :1]).all(axis=1)
            single[left[flat]] = m[flat, 0]
            left, m = left[~flat], m[~flat]
    maps[:] = single[:, None]
    maps[left] = m
    # prefix scan by doubling; it ends early once all maps are constant
    reach = 1
    while reach < rows and not (maps == maps[:, :1]).all():
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
        reach *= 2
    state = np.empty(rows, np.uint8)
    state[0], state[1:] = START, maps[:-1, START]
    bits = np.empty((CHUNK, rows), np.uint8)
    for t in range(CHUNK):
        at = grid[t] + state
        bits[t] = emit[at]
        state = to[at]
    bits = bits.T.ravel()
    start = (bits & 1).astype(bool)
    start[:-1] |= (bits[1:] & 2).astype(bool)
    return np.flatnonzero(start[:n])


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


NONE = 1 << 30


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by number: bytes first, then each merge's token, so that of two merges the one of the lesser number comes first.

    ``parts``: the two tokens that each merged one is made of (a byte of itself), by number.
    """

    parts: np.ndarray
    specials: tuple[bytes, ...]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {v: k for k, v in byte_letters().items()}
        raw = lambda s: bytes(back[c] for c in s)
        number = {bytes([b]): b for b in range(256)}
        parts = [(b, b) for b in range(256)]
        for m in spec["model"]["merges"]:
            x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
            if x + y in number:
                raise ValueError("two merges make one token: their order is not that of the numbers")
            parts.append((number[x], number[y]))
            number[x + y] = len(number)
        return Vocabulary(np.array(parts, np.int64), tuple(x["content"].encode() for x in spec.get("added_tokens", [])))


class Machine:
    """The merges as an automaton that counts while it reads.

    A text's tokens by the merges are the one sequence of tokens in which each, alone, comes out whole and any two
    neighbours stay apart (``apart``).  So the last token of a prefix is the one of its suffixes that is a token and
    stays apart from the last token of the prefix before it; an automaton over the vocabulary's trie (Aho-Corasick)
    gives the suffixes, the longest first.  A transition's count is that of the prefix before the token, and one.
    """

    MEMO = 1 << 20
    WIDE = 64  # bytes up to which pieces are read together

    def __init__(self, vocabulary: Vocabulary):
        self.left, self.right = np.ascontiguousarray(vocabulary.parts.T)
        n = len(self.left)
        keys = (self.left << 20 | self.right)[256:]
        order = np.argsort(keys)
        self.pair_keys, self.pair_made = keys[order], order + 256
        self.memo_key, self.memo_ok = np.full(self.MEMO, -1, np.int64), np.zeros(self.MEMO, bool)
        # a token counts if its own bytes become it
        every = np.arange(n)
        sound = np.ones(n, bool)
        sound[256:] = self._apart(self.left[256:], self.right[256:], every[256:])
        while not (again := sound & sound[self.left] & sound[self.right]).tolist() == sound.tolist():
            sound = again
        self._trie(sound)
        self.scalar: dict[int, bool] = {}

    def _trie(self, sound: np.ndarray) -> None:
        n = len(sound)
        text = [bytes([b]) for b in range(256)]
        for x, y in zip(self.left[256:].tolist(), self.right[256:].tolist(), strict=True):
            text.append(text[x] + text[y])
        self.length = np.array(list(map(len, text)), np.int64)
        child: dict[int, int] = {}
        token, node_of, level = [-1], [0] * n, [[] for _ in range(int(self.length.max()) + 1)]
        for t in np.flatnonzero(sound).tolist():
            node = 0
            for depth, c in enumerate(text[t]):
                key = node << 8 | c
                if (nxt := child.get(key)) is None:
                    nxt = child[key] = len(token)
                    token.append(-1)
                    level[depth].append((key, nxt))
                node = nxt
            token[node], node_of[t] = t, node
        nodes = len(token)
        go, fail = np.zeros((nodes, 256), np.int32), np.zeros(nodes, np.int64)
        longest = np.array(token, np.int64)
        for depth, made in enumerate(level):
            if not made:
                break
            key, node = (np.array(x) for x in zip(*made, strict=True))
            up, c = key >> 8, key & 255
            fail[node] = go[fail[up], c] if depth else 0
            longest[node] = np.where(longest[node] < 0, longest[fail[node]], longest[node])
            go[up, c] = node
            go[node] = go[fail[node]]  # whose children are no deeper than this level; the node's own come with the next
        self.go, self.longest = go.ravel(), longest
        self.shorter = longest[fail[np.array(node_of)]]

    def _pair(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The token that a merge makes of each two, or NONE."""
        key = x << 20 | y
        k = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[k] == key, self.pair_made[k], NONE) if len(self.pair_keys) else np.full(len(x), NONE)

    def _apart(self, x: np.ndarray, y: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Whether no merge under ``before`` joins any of what x ends with and y begins with while both are there.

        The two are taken apart backwards in time.  Of equal merges the left one comes first: so the right one is
        undone first, and a merge across of the same number would have come before it.
        """
        ok, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            met = self._pair(x, y) < before
            ok[live[met]] = False
            go = ~met & ((x > 255) | (y > 255))
            live, x, y = live[go], x[go], y[go]
            first = x > y
            before, x, y = np.where(first, x, y + 1), np.where(first, self.right[x], x), np.where(first, y, self.left[y])
        return ok

    def apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether the tokens x and y stay as they are next to each other; answers are kept in a table of fixed size."""
        key = x << 20 | y
        slot = ((key * 0x9E3779B1) >> 7) & (self.MEMO - 1)
        out = self.memo_ok[slot]
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            got = self._apart(fresh >> 20, fresh & 0xFFFFF, np.full(len(fresh), NONE))
            out[new] = got[back]
            self.memo_key[slot[new]], self.memo_ok[slot[new]] = key[new], got[back]
            # of keys that share a place the last write stays, for the key and for the answer alike
        return out

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each piece."""
        size = ends - starts
        out = np.zeros(len(size), np.int64)
        wide = size <= self.WIDE
        out[wide] = self._together(data, starts[wide], size[wide])
        for k in np.flatnonzero(~wide).tolist():
            out[k] = self._alone(data[starts[k] : ends[k]])
        return out

    def _together(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
        order = np.argsort(-size, kind="stable")
        s, n = starts[order], len(order)
        width = int(size.max(initial=0))
        last, count = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        state = np.zeros(n, np.int64)
        alive = np.searchsorted(-size[order], -np.arange(width), "left")  # pieces of more than t bytes
        for t in range(width):
            m = alive[t]
            state = self.go[(state[:m] << 8) | data[s[:m] + t]].astype(np.int64)
            token, todo = self.longest[state], np.arange(m)
            while len(todo):
                x = token[todo]
                at = t + 1 - self.length[x]
                ok = at == 0
                inner = np.flatnonzero(~ok)
                ok[inner] = self.apart(last[at[inner], todo[inner]].astype(np.int64), x[inner])
                here = todo[ok]
                last[t + 1, here], count[t + 1, here] = x[ok], count[at[ok], here] + 1
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]  # never runs out: one of the suffixes is the prefix's last token
        out = np.empty(n, np.int64)
        out[order] = count[size[order], np.arange(n)]
        return out

    def _alone(self, piece: np.ndarray) -> int:
        """The same for one long piece, step by step: a piece may be a whole text without spaces."""
        last, count, state = [0], [0], 0
        go, longest, shorter, length, known = self.go, self.longest, self.shorter, self.length, self.scalar
        for t, c in enumerate(piece.tolist(), 1):
            state = int(go[state << 8 | c])
            x = int(longest[state])
            while (at := t - int(length[x])) > 0:
                key = last[at] << 20 | x
                if (ok := known.get(key)) is None:
                    if len(known) > self.MEMO:
                        known.clear()
                    ok = known[key] = bool(self._apart(np.array([last[at]]), np.array([x]), np.array([NONE]))[0])
                if ok:
                    break
                x = int(shorter[x])
            last.append(x)
            count.append(count[at] + 1)
        return count[-1]


def cut_specials(data: np.ndarray, off: np.ndarray, specials: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of segments, whether each is a special string, and the text of each."""
    cuts, is_special = [], set()
    raw = data.tobytes() if specials else b""
    taken = 0
    for m in re.finditer(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)), raw) if specials else ():
        k = int(np.searchsorted(off, m.start(), "right"))
        if m.start() >= taken and m.end() <= off[k]:
            cuts += [m.start(), m.end()]
            is_special.add(m.start())
            taken = m.end()
    seg = np.unique(np.concatenate([off, np.array(cuts, np.int64)])) if cuts else np.unique(off)
    special = np.isin(seg[:-1], np.fromiter(is_special, np.int64)) if is_special else np.zeros(max(0, len(seg) - 1), bool)
    return seg, special, np.searchsorted(off, seg[:-1], "right") - 1


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.specials, self.machine = vocabulary.specials, Machine(vocabulary)
        self.classes = class_table()
        self.to, self.emit = compile_transducer()

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(off) - 1, np.int64)
        seg, special, owner = cut_specials(data, off, self.specials)
        if not len(data):
            return out
        at = np.flatnonzero((data & 0xC0) != 0x80)  # first bytes of the characters
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        classes = self.classes[points]
        classes[np.searchsorted(at, seg[:-1])] += CLASSES
        starts = at[piece_starts(classes, self.to, self.emit)]
        ends = np.append(starts[1:], len(data))
        inside = np.searchsorted(seg, starts, "right") - 1
        own = ~special[inside]
        starts, ends, inside = starts[own], ends[own], inside[own]
        h = arrays.range_hashes(data, starts, ends)
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        weights = self.machine.counts(data, starts[first], ends[first])
        np.add.at(out, owner[special], 1)
        return out + np.bincount(owner[inside], weights=weights[which], minlength=len(out)).astype(np.int64)


_COUNTERS: dict[str, Counter] = {}  # of this worker, with what it has learned so far


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. ``path``: a byte-level BPE file, read on the driver; its size is fixed."""
    held = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(path))
    out = StructType([docs.schema["doc_id"], StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches):
        counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, Counter(held.value))
        for rows, data, off in arrays.slices(batches, "text"):
            n = counter.count(data, off)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], out.names)

    return shared.map_arrow(docs.select("doc_id", "text"), run, out)
