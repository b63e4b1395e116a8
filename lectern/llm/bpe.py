"""Byte-level BPE as a finite-state transducer, and a streaming decoder.

Encoding. For every prefix of a piece, the BPE encoding ends in exactly one
token: the longest vocabulary suffix t such that the encoding of what stands
before it ends in a token u and the merges leave the pair (u, t) apart. So a
transducer can read bytes left to right. Its state is the last token emitted and
the bytes read since; it emits as soon as every split that a further byte could
still ask for passes through one point (bounded lookahead: no longer than a
token). States and arcs are made when first met (lazy determinisation) and kept
in a table of bounded size; so are the composed arcs of whole pieces. Of a short
piece only the arcs of its first bytes are kept.

Decoding. Token bytes run through an incremental UTF-8 state machine whose state
is the unfinished sequence; an ill-formed sequence gives U+FFFD. Arcs over whole
tokens are composed lazily as well.

Defined results: null or empty text has no tokens; repeated rows are encoded one
by one; an empty table gives an empty table; bytes that are no UTF-8 are read as
U+FFFD.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import vector

#: Entries that the table of pieces and those of arcs hold before they start anew; they bound memory and never change a result.
TABLE_SIZE, ARCS = 1 << 19, 1 << 18
#: Bytes of a piece whose arcs are kept; later ones are met seldom, and to make them anew takes less time than to look them up in large tables.
HEAD = 4
#: Longer pieces are run through the transducer each time instead of being kept whole.
KEPT_PIECE = 64
_NEVER = 1 << 62
_BYTES = [bytes([k]) for k in range(256)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        self.prefixes = {t[:k] for t in ranks for k in range(1, len(t))}
        self.longest = max(map(len, ranks))  # bounds the lookahead
        self.size = {i: len(t) for t, i in ranks.items()}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.apart: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        #: state -> (last emitted token or None, bytes since, last token at each place since)
        self.states: list[tuple[int | None, bytes, tuple[int, ...]]] = [(None, b"", ())]
        self.known: dict[tuple[int | None, bytes], int] = {(None, b""): 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _edges(self, t: int) -> tuple[list, list] | None:
        """What stands at the right and at the left edge of a token while its merges run.

        Each entry is (bytes, rank that makes it, rank of the merge that consumes it).
        None: the merges of the token's bytes give something else.
        """
        if t not in self.edges:
            token = self.token[t]
            parts = [token[i : i + 1] for i in range(len(token))]
            right, left, made = [(parts[-1], -1)], [(parts[0], -1)], []
            ends: list[list] = [[], []]
            while len(parts) > 1:
                best, at = min((self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if best == _NEVER:
                    break
                last = at == len(parts) - 2
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if last:
                    ends[0].append((*right[-1], best))
                    right.append((parts[-1], best))
                if at == 0:
                    ends[1].append((*left[-1], best))
                    left.append((parts[0], best))
                made.append(best)
            whole = len(parts) == 1 and made == sorted(made)
            self.edges[t] = ([*ends[0], (*right[-1], _NEVER)], [*ends[1], (*left[-1], _NEVER)]) if whole else None
        return self.edges[t]

    def _stay_apart(self, u: int, t: int) -> bool:
        """True unless some merge joins the right edge of u with the left edge of t while both exist.

        Among merges of one rank the leftmost runs first: before one inside t, after one inside u.
        """
        got = self.apart.get(u << 32 | t)
        if got is None:
            if len(self.apart) >= ARCS:
                self.apart.clear()
            got, ranks = bool(self._edges(t)), self.ranks
            for a, made_a, used_a in self._edges(u)[0]:
                for b, made_b, used_b in (self._edges(t) or ((), ()))[1]:
                    r = ranks.get(a + b)
                    if r is not None and made_a < r < used_a and made_b < r <= used_b:
                        got = False
            self.apart[u << 32 | t] = got
        return got

    def _last(self, before: int | None, buffer: bytes, last: tuple[int, ...]) -> int:
        # exactly one start fits, so the order of trial is free: most tokens are short
        token, n, apart = self.ranks.get, len(buffer), self.apart.get
        for start in range(n - 1, max(0, n - self.longest) - 1, -1):
            t = token(buffer[start:])
            if t is not None:
                u = last[start - 1] if start else before
                if u is None:
                    if self._edges(t):
                        return t
                    continue
                fits = apart(u << 32 | t)
                if self._stay_apart(u, t) if fits is None else fits:
                    return t
        raise ValueError("the vocabulary lacks a byte")

    def _commit(self, buffer: bytes, last: tuple[int, ...]) -> int:
        """The last place that every split still open of a buffer that begins no token passes through.

        A later token may start at a place only if what stands from there on begins some token.
        """
        n, size, prefixes = len(buffer), self.size, self.prefixes
        place = n
        for j in range(n - 1, max(1, n - self.longest + 1) - 1, -1):
            if buffer[j:] in prefixes:
                q = j
                while place != q:  # up to where both splits meet
                    if place > q:
                        place -= size[last[place - 1]]
                    else:
                        q -= size[last[q - 1]]
                if not place:
                    return 0
        return place

    def step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        arc = self.arcs.get(state << 8 | byte)
        if arc is None:
            arc = self.arcs[state << 8 | byte] = self._make(state, byte)
        return arc

    def _make(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, buffer, last = self.states[state]
        buffer += _BYTES[byte]
        last = (*last, self._last(before, buffer, last))
        out: tuple[int, ...] = ()
        if buffer not in self.prefixes and (commit := self._commit(buffer, last)):
            out = self._tokens(last, commit)
            before, buffer, last = out[-1], buffer[commit:], last[commit:]
        key = before, buffer
        known = self.known.get(key)
        if known is None:
            known = self.known[key] = len(self.states)
            self.states.append((before, buffer, last))
        return known, out

    def _tokens(self, last: tuple[int, ...], place: int) -> tuple[int, ...]:
        out = []
        while place > 0:
            out.append(last[place - 1])
            place -= self.size[out[-1]]
        return tuple(reversed(out))

    def run(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(self.arcs) >= ARCS:
            self.reset()
        state, out, arcs = 0, [], self.arcs
        for byte in piece if len(piece) > KEPT_PIECE else piece[:HEAD]:
            arc = arcs.get(state << 8 | byte)
            if arc is None:
                if len(arcs) >= 2 * ARCS:  # inside one very long piece: start the tables anew from this state
                    held = self.states[state]
                    self.reset()
                    arcs, state = self.arcs, self.known.setdefault(held[:2], len(self.states))
                    if state == len(self.states):
                        self.states.append(held)
                arc = self.step(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        before, buffer, last = self.states[state]
        if HEAD < len(piece) <= KEPT_PIECE:
            last = self._ahead(before, buffer + piece[HEAD:], last)
        return [*out, *self._tokens(last, len(last))]

    def _ahead(self, before: int | None, buffer: bytes, last: tuple[int, ...]) -> list[int]:
        """The last token at each place of the buffer, of which ``last`` has the first ones: arcs that are not kept, up to a short piece's end."""
        token, apart, longest, last = self.ranks.get, self.apart.get, self.longest, list(last)
        for n in range(len(last) + 1, len(buffer) + 1):
            for start in range(n - 1, max(0, n - longest) - 1, -1):
                t = token(buffer[start:n])
                if t is not None:
                    u = last[start - 1] if start else before
                    fits = bool(self._edges(t)) if u is None else apart(u << 32 | t)
                    if self._stay_apart(u, t) if fits is None else fits:
                        last.append(t)
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last


class Encoder(dict):
    """piece -> its ids as little-endian unsigned 32-bit integers; the composed arcs of the transducer.

    Half the table is set aside when it is full; a piece met again is taken back from there, so frequent ones stay.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.fst, self.pattern = Transducer(ranks), regex.compile(pattern)

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.pop(piece, None)
        if ids is None:
            got = self.fst.run(piece.encode())
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(piece) <= KEPT_PIECE:
            if len(self) >= TABLE_SIZE >> 1:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if len(text) < 1 << 20:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        out = bytearray()  # a very long text: no list of its pieces
        for m in self.pattern.finditer(text):
            out += self[m[0]]
        return bytes(out)


def utf8_step(pending: bytes, byte: int) -> tuple[bytes, str]:
    """One byte of the UTF-8 state machine: the unfinished sequence after it, and what it completes."""
    if not pending:
        if byte < 0x80:
            return b"", chr(byte)
        return (bytes([byte]), "") if 0xC2 <= byte <= 0xF4 else (b"", "�")
    lead = pending[0]
    low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80) if len(pending) == 1 else 0x80
    high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF) if len(pending) == 1 else 0xBF
    if not low <= byte <= high:
        rest, more = utf8_step(b"", byte)
        return rest, "�" + more
    pending += bytes([byte])
    need = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
    return (b"", pending.decode()) if len(pending) == need else (pending, "")


class _State(dict):
    """Arcs over whole tokens from one state of the machine: id -> (next state, text)."""

    def __init__(self, pending: bytes, owner: Decoder):
        super().__init__()
        self.pending, self.owner = pending, owner

    def __missing__(self, token: int):
        pending, out = self.pending, []
        for byte in self.owner.token[token]:
            pending, text = utf8_step(pending, byte)
            out.append(text)
        arc = self[token] = (self.owner.state(pending), "".join(out))
        return arc


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        self.token = {i: t for t, i in ranks.items()}
        self.states: dict[bytes, _State] = {}

    def state(self, pending: bytes) -> _State:
        if pending not in self.states:
            self.states[pending] = _State(pending, self)
        return self.states[pending]

    def decode(self, ids) -> str:
        """Text of a stream of ids; state carries from one id to the next."""
        if len(self.states) >= TABLE_SIZE >> 6:
            self.states.clear()
        state, out = self.state(b""), []
        for i in ids:
            state, text = state[i]
            out.append(text)
        return "".join(out) + "�" * bool(state.pending)


_loaded: dict[tuple, tuple[Encoder, Decoder]] = {}


def coder(path: str, pattern: str) -> tuple[Encoder, Decoder]:
    """Made once a Python worker, which drops it when it turns to another operator."""
    if (path, pattern) not in _loaded:
        if not _loaded:
            vector.kept.append(_loaded.clear)
        with open(path, "rb") as f:
            ranks = read_ranks(f.read())
        _loaded[path, pattern] = Encoder(ranks, pattern), Decoder(ranks)
    return _loaded[path, pattern]


def annotate(df: DataFrame, path: str, pattern: str, text_col: str = "text", with_ids: bool = False, keep_text: bool = True) -> DataFrame:
    """``df`` and, per row, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (binary, little-endian uint32).

    Columns of the input with these names are replaced. Without ``keep_text`` the text is left out and passed to Python once. ``path`` is the vocabulary file, on every machine.
    """
    added = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary"} if with_ids else {})
    keep = [c for c in df.columns if c not in added and (keep_text or c != text_col)]
    src = df.select(*(df[c] for c in keep), F.col(text_col).cast("binary").alias("_bytes"))
    out_schema = df.select(*(df[c] for c in keep), *(F.lit(None).cast(t).alias(n) for n, t in added.items())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, dec = coder(path, pattern)
        # the tables are of tuples without cycles, which the collector would go through again and again
        collects = gc.isenabled()
        gc.disable()
        try:
            for batch in batches:
                n, ids_sha, text_sha, all_ids = [], [], [], []
                for raw in batch.column(batch.num_columns - 1):
                    ids = enc.encode((raw.as_py() or b"").decode("utf-8", "replace"))
                    back = dec.decode(np.frombuffer(ids, "<u4").tolist())
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(back.encode()).hexdigest())
                    all_ids += [ids] if with_ids else []
                new = [pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)] + ([pa.array(all_ids, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *added])
        finally:
            if collects:
                gc.enable()

    return src.mapInArrow(run, out_schema)
