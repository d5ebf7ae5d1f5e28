"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is the BPE encoding of its bytes exactly when every token encodes to itself and
every adjacent pair of tokens survives: no merge across their border would ever come first.  That
makes encoding a regular relation.  Its non-deterministic transducer guesses token borders while
reading bytes through the vocabulary trie; ``BpeTransducer`` builds the deterministic one state by
state, as inputs need it.  A state is the set of live guesses, each with the tokens it has not
emitted yet; what all guesses share is emitted at once, so output lags by a bounded lookahead.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from sys import intern

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .batches import mix, ranges
from .common import docs, map_arrow, prepare, resident

NEVER = 1 << 60
#: Longer pre-tokens are encoded one by one.
WIDE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().split(b"\n")))}


class BpeTransducer:
    """Encode byte strings by merge ranks.

    max_states bounds the determinised part that is kept; beyond it the table is emptied, within a
    piece too, and grows anew from the guesses that are live.  max_pairs bounds what is kept of
    pairs of tokens.  So memory is bounded, whatever the texts, and results are the same.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = 200_000, max_pairs: int = 300_000):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.max_states, self.max_pairs = max_states, max_pairs
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self._pair: dict[int, bool] = {}
        self._children: list[dict[int, int]] = [{}]
        self._token: list[int] = [-1]
        for word, rank in ranks.items():
            if len(word) == 1 or self.parts(rank):
                self._insert(word, rank)
        self._reset()

    # -- the vocabulary ----------------------------------------------------------------------
    def _insert(self, word: bytes, rank: int) -> None:
        at = 0
        for b in word:
            to = self._children[at].get(b)
            if to is None:
                to = self._children[at][b] = len(self._token)
                self._children.append({})
                self._token.append(-1)
            at = to
        self._token[at] = rank

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, or None where merges never make it."""
        if token not in self._parts:
            word, found = self.bytes_of[token], None
            if len(word) > 1:
                pieces = [bytes([b]) for b in word]
                while len(pieces) > 2:
                    best = min(range(len(pieces) - 1), key=lambda i: self.ranks.get(pieces[i] + pieces[i + 1], NEVER))
                    if self.ranks.get(pieces[best] + pieces[best + 1], NEVER) >= token:
                        break
                    pieces[best : best + 2] = [pieces[best] + pieces[best + 1]]
                if len(pieces) == 2:
                    found = (self.ranks[pieces[0]], self.ranks[pieces[1]])
            self._parts[token] = found
        return self._parts[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one edge while ``token`` is built, each with the rank that ends it."""
        memo = self._left if side == 0 else self._right
        if token not in memo:
            chain, at, ends = [], token, NEVER
            while True:
                chain.append((at, ends))
                two = self.parts(at)
                if two is None:
                    break
                at, ends = two[side], at
            memo[token] = chain[::-1]
        return memo[token]

    def survives(self, a: int, b: int) -> bool:
        """Whether no merge takes place across the border of a and b, read one after the other."""
        key = a << 32 | b
        known = self._pair.get(key)
        if known is None:
            left, right, i, j = self._edge(a, 1), self._edge(b, 0), 0, 0
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                across = self.ranks.get(self.bytes_of[x] + self.bytes_of[y], NEVER)
                if across < x_ends and across <= y_ends and across < NEVER:
                    known = False
                    break
                if x_ends == NEVER and y_ends == NEVER:
                    known = True
                    break
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            if len(self._pair) > self.max_pairs:
                self._pair.clear()
            self._pair[key] = known
        return known

    # -- the determinised machine -------------------------------------------------------------
    def _reset(self) -> None:
        self._ids: dict[bytes, int] = {}
        self._guesses: list[bytes] = []
        self._outs: list[tuple[int, ...]] = [()]
        self._out_ids: dict[tuple[int, ...], int] = {(): 0}
        self._tail: list[int] = []
        self._edges = Edges()
        self._walk: dict[int, tuple[int, int]] = {}
        self._intern(((0, -1, ()),))

    def _out(self, tokens: tuple[int, ...]) -> int:
        at = self._out_ids.get(tokens)
        if at is None:
            at = self._out_ids[tokens] = len(self._outs)
            self._outs.append(tokens)
        return at

    def _intern(self, guesses: tuple) -> int:
        """The number of a state; it is kept as three numbers a guess."""
        packed = array("i", [x for node, last, owed in guesses for x in (node, last, self._out(owed))]).tobytes()
        at = self._ids.get(packed)
        if at is None:
            at = self._ids[packed] = len(self._guesses)
            self._guesses.append(packed)
            self._tail.append(next((self._out(owed) for node, _, owed in guesses if node == 0), 0))
        return at

    def _live(self, state: int) -> list[tuple[int, int, tuple[int, ...]]]:
        """The guesses of a state: node, last token and tokens owed."""
        x = array("i", self._guesses[state])
        return [(x[k], x[k + 1], self._outs[x[k + 2]]) for k in range(0, len(x), 3)]

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """Subset construction for one state and byte: the next state and what is emitted."""
        whole, out, children, tokens, pair = None, [], self._children, self._token, self._pair
        for node, last, owed in self._live(state):
            to = children[node].get(byte)
            if to is None:
                continue
            token = tokens[to]
            if token >= 0 and whole is None:
                known = last < 0 or pair.get(last << 32 | token)
                if known or known is None and self.survives(last, token):
                    whole = (0, token, (*owed, token))
            if children[to]:
                out.append((to, last, owed))
        if whole:
            out.insert(0, whole)
        k, first = 0, out[0][2]
        for k in range(len(first) + 1):
            if k == len(first) or any(len(owed) <= k or owed[k] != first[k] for _, _, owed in out):
                break
        to = self._intern(tuple([(node, last, owed[k:]) for node, last, owed in out]) if k else tuple(out))
        return to, self._out(first[:k])

    def _restart(self, live: list[int]) -> list[int]:
        """Empty the table and go on from the guesses of some states; their new numbers."""
        guesses = [tuple(self._live(state)) for state in live]
        self._reset()
        return [self._intern(g) for g in guesses]

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, byte after byte."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        state, out = 0, []
        for b in piece:
            step = self._walk.get(state << 8 | b)
            if step is None:
                if len(self._guesses) > self.max_states:
                    state = self._restart([state])[0]
                step = self._walk[state << 8 | b] = self._step(state, b)
            state = step[0]
            if step[1]:
                out += self._outs[step[1]]
        out += self._outs[self._tail[state]]
        return out

    def encode_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each pre-token, and all ids: many are driven through the table side by side."""
        n = np.zeros(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places, found = [np.nonzero(whole >= 0)[0]], [whole[whole >= 0]]
        for k in np.nonzero((whole < 0) & (size > WIDE))[0].tolist():
            ids = self.encode(pieces[k])
            places.append(np.full(len(ids), k))
            found.append(np.array(ids, np.int64))
        rest = np.nonzero((whole < 0) & (size <= WIDE) & (size > 0))[0]
        rest = rest[np.argsort(-size[rest], kind="stable")]
        if len(rest):
            at, ids = self._drive([pieces[k] for k in rest.tolist()])
            places.append(rest[at])
            found.append(ids)
        place, ids = np.concatenate(places), np.concatenate(found)
        order = np.argsort(place, kind="stable")
        np.add.at(n, place, 1)
        return n, ids[order]

    def _drive(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For pieces from the longest to the shortest: the piece of each id, and the ids, of one piece in order."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        text, start = np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size
        state = np.zeros(len(pieces), np.int64)
        emitted: list[tuple[np.ndarray, list[tuple[int, ...]] | np.ndarray]] = []
        where, what = [], []
        for j in range(int(size[0])):
            live = int(np.searchsorted(-size, -j, "left"))
            key = (state[:live] << 8) | text[start[:live] + j]
            row = self._edges.find(key)
            new = np.unique(key[row < 0])
            if len(new):
                if len(self._guesses) + len(new) > self.max_states:
                    # What was emitted so far is told by the old table; the states that are live go on in a new one.
                    emitted.append(self._told(where, what))
                    where, what = [], []
                    old, back = np.unique(state, return_inverse=True)
                    state = np.array(self._restart(old.tolist()), np.int64)[back]
                    key = (state[:live] << 8) | text[start[:live] + j]
                    new = np.unique(key)
                steps = [self._step(k >> 8, k & 255) for k in new.tolist()]
                self._edges.add(new, *(np.array(x, np.int64) for x in zip(*steps)))
                row = self._edges.find(key)
            state[:live] = self._edges.to[row]
            out = self._edges.out[row]
            told = np.nonzero(out)[0]
            where.append(told)
            what.append(out[told])
        tail = np.array(self._tail, np.int64)[state]
        where.append(np.nonzero(tail)[0])
        what.append(tail[tail > 0])
        emitted.append(self._told(where, what))
        place, ids = (np.concatenate(x) for x in zip(*emitted))
        order = np.argsort(place, kind="stable")
        return place[order], ids[order]

    def _told(self, where: list[np.ndarray], what: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of emissions, and the piece of each."""
        if not where:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, what = np.concatenate(where), np.concatenate(what)
        size = np.fromiter(map(len, self._outs), np.int64, len(self._outs))
        flat = np.fromiter((t for out in self._outs for t in out), np.int64, int(size.sum()))
        first = np.cumsum(size) - size
        return np.repeat(where, size[what]), flat[ranges(first[what], size[what])]


class Edges:
    """Transitions by state and byte in open addressing: ``to`` and ``out`` by row."""

    def __init__(self, size: int = 1 << 12):
        self.keys = np.zeros(0, np.int64)
        self.to = self.out = self.keys
        self._used = 0
        self._slots = np.full(4 * size, -1, np.int32)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(len(self._slots) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        out, todo, at = np.full(len(keys), -1, np.int32), None, self._home(keys)
        if not self._used:
            return out
        while True:
            row = self._slots[at]
            own = keys if todo is None else keys[todo]
            hit = (row >= 0) & (self.keys[row] == own)
            if todo is None:
                out[hit] = row[hit]
                todo = np.nonzero((row >= 0) & ~hit)[0]
                at = at[todo]
            else:
                out[todo[hit]] = row[hit]
                more = (row >= 0) & ~hit
                todo, at = todo[more], at[more]
            if not len(todo):
                return out
            at = (at + 1) & (len(self._slots) - 1)

    def add(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        first, self._used = self._used, self._used + len(keys)
        if self._used > len(self.keys):
            room = max(1 << 12, 2 * self._used)
            self.keys, self.to, self.out = (
                np.concatenate([x[:first], np.zeros(room - first, np.int64)]) for x in (self.keys, self.to, self.out)
            )
        for own, new in ((self.keys, keys), (self.to, to), (self.out, out)):
            own[first : self._used] = new
        rows = np.arange(first, self._used, dtype=np.int32)
        if 4 * self._used > len(self._slots):
            self._slots = np.full(1 << (8 * self._used).bit_length(), -1, np.int32)
            rows = np.arange(self._used, dtype=np.int32)
        at = self._home(self.keys[rows])
        while len(rows):
            free = self._slots[at] < 0
            self._slots[at[free]] = rows[free]  # of several for one slot, one stays
            rest = self._slots[at] != rows
            rows, at = rows[rest], (at[rest] + 1) & (len(self._slots) - 1)


def utf8_step(held: bytes, b: int) -> tuple[bytes, str]:
    """The UTF-8 machine: from a state and a byte to the next state and the characters that are now sure.

    A state is the start of an unfinished character (b"" between characters).  Which bytes may
    follow is a range; a byte outside it ends the character as U+FFFD and is read anew, as
    ``bytes.decode(errors="replace")`` does.
    """
    bad = ""
    if held:
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(held[0], 0x80) if len(held) == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(held[0], 0xBF) if len(held) == 1 else 0xBF
        if low <= b <= high:
            held += bytes([b])
            need = 2 if held[0] < 0xE0 else 3 if held[0] < 0xF0 else 4
            return (held, "") if len(held) < need else (b"", held.decode())
        bad = "\ufffd"
    if b < 0x80:
        return b"", bad + chr(b)
    return (bytes([b]), bad) if 0xC2 <= b < 0xF5 else (b"", bad + "\ufffd")


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes in any pieces, whole characters out."""

    def __init__(self) -> None:
        self._held = b""

    def feed(self, data: bytes) -> str:
        out = []
        for b in data:
            self._held, sure = utf8_step(self._held, b)
            out.append(sure)
        return "".join(out)

    def close(self) -> str:
        held, self._held = self._held, b""
        return "\ufffd" if held else ""


class TokenDecoder:
    """The UTF-8 machine with whole tokens as its steps, each worked out when it is first met.

    ``max_steps`` bounds how many are kept.
    """

    def __init__(self, bytes_of: dict, max_steps: int = 200_000):
        self._states: dict[bytes, dict] = {}
        self._kept = 0
        decoder = self

        class State(dict):
            def __init__(self, held: bytes):
                self.held = held

            def __missing__(self, token) -> tuple[str, dict]:
                stream = Utf8Stream()
                stream._held = self.held
                out = stream.feed(bytes_of[token])
                if decoder._kept >= max_steps:
                    decoder._kept = 0
                    for state in decoder._states.values():
                        state.clear()
                decoder._kept += 1
                step = self[token] = out, decoder._state(stream._held)
                return step

        self._new = State
        self.start = self._state(b"")

    def _state(self, held: bytes) -> dict:
        if held not in self._states:
            self._states[held] = self._new(held)
        return self._states[held]

    def feed(self, state: dict, tokens: list) -> tuple[str, dict]:
        """Characters that are sure after some tokens, and the state they lead to."""
        out = []
        for token in tokens:
            sure, state = state[token]
            out.append(sure)
        return "".join(out), state

    def close(self, state: dict) -> str:
        return "\ufffd" if state.held else ""


class TextCodec:
    """Whole texts to ids and back, with the pre-token pattern of the vocabulary.

    Between two non-blank characters a single space always starts a pre-token, so a text is cut
    there first (a text with other white space around its spaces is cut by the pattern alone), and
    each distinct stretch of a batch is encoded and decoded once.
    """

    def __init__(self, path: str, pattern: str):
        self.machine = BpeTransducer(load_ranks(path))
        self._find = regex.compile(pattern).findall
        names = [None] * (max(self.machine.bytes_of) + 1)
        self._names, self._bytes = (
            pa.array([f(i) if i in self.machine.bytes_of else None for i in range(len(names))], t) for f,
            t in ((str, pa.string()), (self.machine.bytes_of.get, pa.binary()))
        )
        self._decoder = TokenDecoder(self.machine.bytes_of)

    def _cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct stretches of some texts, which one stands at each place, and the places of each text."""
        parts = pc.split_pattern(texts, " ")
        flat, bounds = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        coded = flat.dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.zeros(len(codes), bool)
        first[bounds[:-1]] = True
        # A stretch as it stands at the start of a text, and after a space.
        inner = np.array([bool(x) and not (x[0].isspace() or x[-1].isspace()) for x in distinct], bool)
        start = np.array([bool(x) and not x[-1].isspace() for x in distinct], bool)
        good = np.where(first, start[codes], inner[codes])
        fine = np.logical_and.reduceat(good, bounds[:-1]) if len(codes) else np.zeros(0, bool)
        sizes = np.diff(bounds)
        used, codes = np.unique(codes + np.where(first, len(distinct), 0), return_inverse=True)
        units = [" " + distinct[k] if k < len(distinct) else distinct[k - len(distinct)] for k in used.tolist()]
        if fine.all():
            return units, codes, sizes
        index: dict[str, int] = {}
        runs, ends = [], np.cumsum(sizes)
        for k, ok in enumerate(fine.tolist()):
            if ok:
                runs.append(codes[ends[k] - sizes[k] : ends[k]])
            else:
                pieces = self._find(texts[k].as_py())
                runs.append(np.array([index.setdefault(p, len(index)) for p in pieces], np.int64) + len(units))
        return units + list(index), np.concatenate(runs), np.array(list(map(len, runs)), np.int64)

    def _encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each stretch, and all ids."""
        index: dict[str, int] = {}
        pieces, count = [], []
        for u in units:
            if u.isalpha() or u[:1] == " " and u[1:].isalpha():
                pieces.append(index.setdefault(u, len(index)))
                count.append(1)
            else:
                found = self._find(u)
                pieces += [index.setdefault(p, len(index)) for p in found]
                count.append(len(found))
        n, ids = self.machine.encode_many([p.encode() for p in index])
        at, count = np.array(pieces, np.int64), np.array(count, np.int64)
        total = np.append(0, np.cumsum(n[at]))
        return np.diff(total[np.append(0, np.cumsum(count))]), ids[ranges((np.cumsum(n) - n)[at], n[at])]

    def _decode_units(self, n: np.ndarray, ids: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The bytes of the characters that each stretch's ids give from the start, and whether all are whole."""
        raw = pc.binary_join(_lists(n, self._bytes.take(pa.array(ids))), b"")
        used, back = np.unique(ids, return_inverse=True)
        whole = np.array([self._decoder.start[t][1] is self._decoder.start for t in used.tolist()], bool)
        broken = np.unique(np.repeat(np.arange(len(n)), n)[~whole[back]]) if len(ids) else np.zeros(0, np.int64)
        closed = np.ones(len(n), bool)
        if len(broken):
            # Some token ends inside a character: the machine goes through the stretch token by token.
            ends, mended = np.cumsum(n), []
            for k in broken.tolist():
                text, state = self._decoder.feed(self._decoder.start, ids[ends[k] - n[k] : ends[k]].tolist())
                mended.append(text.encode())
                closed[k] = state is self._decoder.start
            mask = np.zeros(len(n), bool)
            mask[broken] = True
            raw = pc.replace_with_mask(raw, pa.array(mask), pa.array(mended, pa.binary()))
        return raw, closed

    def round_trip(self, texts: pa.Array, keep_ids: bool = False) -> dict[str, list | np.ndarray]:
        """``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``round_trip`` and perhaps ``ids`` of a batch of texts."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return {"ids": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "round_trip": []}
        units, codes, sizes = self._cut(texts)
        n, ids = self._encode_units(units)
        named = pc.binary_join(_lists(n, self._names.take(pa.array(ids))), " ").take(pa.array(codes))
        joined = pc.binary_join(_lists(sizes, named), " ")
        raw, closed = self._decode_units(n, ids)
        decoded = pc.binary_join(_lists(sizes, raw.take(pa.array(codes))), b"")
        ends = np.cumsum(sizes)
        if not closed[codes].all():
            first, bad = np.cumsum(n) - n, {}
            for k in np.unique(np.searchsorted(ends, np.nonzero(~closed[codes])[0], "right")).tolist():
                own = codes[ends[k] - sizes[k] : ends[k]]
                text, state = self._decoder.feed(self._decoder.start, ids[ranges(first[own], n[own])].tolist())
                bad[k] = (text + self._decoder.close(state)).encode()
            decoded = pa.array([bad.get(k, x) for k, x in enumerate(decoded.to_pylist())], pa.binary())
        total = np.append(0, np.cumsum(n[codes]))[np.append(0, ends)]
        out = {
            "n_tokens": np.diff(total), "ids_sha256": _digests(joined), "decoded_sha256": _digests(decoded),
            "round_trip": pc.equal(decoded, texts.cast(pa.binary()))
        }
        if keep_ids:
            every = ids[ranges((np.cumsum(n) - n)[codes], n[codes])]
            out["ids"] = pa.ListArray.from_arrays(pa.array(total, pa.int32()), pa.array(every, pa.int32()))
        return out

    def encode(self, text: str) -> list[int]:
        return self.round_trip(pa.array([text]), keep_ids=True)["ids"][0].as_py()

    def decode(self, ids: list[int], chunk: int = 4096) -> str:
        """Decode ids chunk by chunk through the incremental machine."""
        state, out = self._decoder.start, []
        for k in range(0, len(ids), chunk):
            text, state = self._decoder.feed(state, ids[k : k + chunk])
            out.append(text)
        return "".join([*out, self._decoder.close(state)])


def _lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), values)


def _digests(values: pa.Array) -> list[str]:
    """sha256 of each string or binary value."""
    bounds, data = np.frombuffer(values.buffers()[1], np.int32)[
        values.offset : values.offset + len(values) + 1
    ].tolist(), values.buffers()[2]
    view = memoryview(data) if data is not None else memoryview(b"")
    return [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])]


def codec(path: str, pattern: str = public_tokenizers.PATTERN) -> TextCodec:
    """One codec for each worker process."""
    return resident(intern(f"{path}\n{pattern}"), lambda: TextCodec(path, pattern))


def encode_documents(
    df: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text",
    keep_ids: bool = False
) -> DataFrame:
    """Encode and decode every whole text; one row for each row of ``df``, no shuffle.

    Returns id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, ``round_trip`` and, with
    ``keep_ids``, ``ids`` as an array.  A null text counts as empty: 0 tokens and the digests of
    the empty string.  Null and repeated ids pass through; other columns of ``df`` are not read.
    """
    prepare(df.sparkSession)
    kept = "ids array<int>, " if keep_ids else ""

    def run(ids: pa.Array, texts: pa.Array) -> list:
        got = codec(path, pattern).round_trip(texts, keep_ids)
        return [
            ids, *([got["ids"]] if keep_ids else []), got["n_tokens"], got["ids_sha256"], got["decoded_sha256"],
            got["round_trip"]
        ]

    id_type = df.schema[id_col].dataType.simpleString()
    return map_arrow(
        df.select(id_col, text_col), run,
        f"{id_col} {id_type}, {kept}n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean",
        keeps=True
    )


def op1_bpe(spark, sf_dir):
    """Query: the 50k byte-level vocabulary over all documents."""
    return encode_documents(docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))
