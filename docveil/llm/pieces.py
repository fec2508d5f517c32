"""SentencePiece BPE encoding with seeded merge-dropout, and decoding without loss.

A word's symbols are merged from an agenda: the candidate of the best score first, the leftmost of
equals. A candidate merge, that is the two spans it would join, is skipped when a keyed hash of it
falls under the dropout probability, as though it had never been on the agenda. So a seed gives
the same segmentation anywhere and other seeds others. The hash's key has the seed, the document
and the word's position, so each occurrence of a word has draws of its own.

The segmentation without skips and its merges are kept for words that repeat. Where the hash skips
none of these merges, an occurrence has that segmentation, as a skipped candidate that would not be merged changes nothing;
all other occurrences go through the agenda themselves. Agendas of many short words advance
together, one merge of each in a step. Dropout 0 gives the model's own segmentation.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docveil.llm.common import batches
from docveil.llm.shingles import mix

#: No piece spans a change from other characters to blanks, nor a line end; U+2581 stands for a
#: blank in pieces, so the character itself is spelled in bytes.
UNIT = re.compile(" *[^ \n▁]+| +|\n|▁")
#: Where a very long text may be cut: a line end, or the first of some blanks, starts a unit.
CUT = re.compile("\n|(?<! ) ")
_M = (1 << 64) - 1
_C = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: No candidate, in an agenda's 32-bit order of (rank, place); places have 6 bits.
NONE, PLACE = np.int32(2**31 - 1), 6
#: The symbol of a character that no piece has; no merge has it.
OTHER = 0xFFFF
#: Longer units have an agenda of their own; shorter ones advance together, by length.
LONG = 48
WIDTHS = (2, 4, 6, 8, 10, 12, 16, 24, 32, LONG)
#: Units, and characters of a text, that are worked on at a time.
ROOM, SLICE = 1 << 16, 1 << 20


def _mix(h: int) -> int:
    h = (h ^ (h >> 30)) * 0xBF58476D1CE4E5B9 & _M
    h = (h ^ (h >> 27)) * 0x94D049BB133111EB & _M
    return h ^ (h >> 31)


def _points(units: list[str]) -> np.ndarray:
    """The code points of units, one after another."""
    return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")


def _slices(text: str, size: int) -> Iterator[str]:
    """The text in parts of about ``size`` characters that each start with a unit."""
    at = 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start[0], start[0] + 1, ...`` of ``size[0]`` numbers, then those of the next."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def _room(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` or a longer copy, with room for ``n`` values."""
    return x if n <= len(x) else np.concatenate([x, np.empty(max(n - len(x), len(x)), x.dtype)])


class PairTable:
    """The candidate of each pair of symbols: a table in which a pair has two possible places."""

    def __init__(self, pairs: list[tuple[int, int, int]], rank: np.ndarray):
        key = np.array([(a << 16) | b for a, b, _ in pairs], np.uint32)
        self.shift = np.uint32(32 - max(4, (2 * len(pairs)).bit_length()))
        size = 1 << (32 - int(self.shift))
        rng = np.random.default_rng(7)
        while True:
            self.mul = [np.uint32(int(m) | 1) for m in rng.integers(1, 2**32, 2)]
            held, todo, turn = np.full(2 * size, -1, np.int64), np.arange(len(key)), 0
            while len(todo) and turn < 200:
                at = (key[todo] * self.mul[turn % 2] >> self.shift).astype(np.int64) + size * (turn % 2)
                out = held[np.unique(at)]
                held[at] = todo
                todo = np.concatenate([out[out >= 0], todo[held[at] != todo]])
                turn += 1
            if not len(todo):
                break
        self.size = size
        # An empty place holds a pair that has no order.
        self.key, self.to, self.order = np.full(2 * size, 2**32 - 1, np.uint32), np.zeros(2 * size, np.int32), np.full(2 * size, NONE, np.int32)
        at = np.flatnonzero(held >= 0)
        to = np.array([c for _, _, c in pairs], np.int64)[held[at]]
        self.key[at], self.to[at], self.order[at] = key[held[at]], to, (rank[to] << PLACE).astype(np.int32)

    def places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which pairs have a candidate, its place in the table)."""
        key = (left << np.uint32(16)) | right
        one = (key * self.mul[0] >> self.shift).astype(np.int64)
        two = (key * self.mul[1] >> self.shift).astype(np.int64) + self.size
        at = np.where(self.key[one] == key, one, two)
        hit = np.flatnonzero((self.key[at] == key) & (self.order[at] != NONE))
        return hit, at[hit]


class Pieces:
    """A model's pieces, its merges, and the encoder, which keeps up to ``cache`` units."""

    def __init__(self, path: str, dropout: float, seed: int, cache: int = 150_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(n)]
        byte = {int(t[3:5], 16): i for i, t in enumerate(text) if sp.is_byte(i)}
        if len(byte) != 256:
            raise ValueError(f"{path}: the model has no byte fallback")
        own = {t: i for i, t in enumerate(text) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        if any(re.search("[^▁]▁|\n", t) for t in own):
            raise ValueError(f"{path}: a piece spans white space")
        self.byte, char = byte, {t: i for t, i in own.items() if len(t) == 1}
        # Characters that only longer pieces have get symbols past the ids.
        extra = sorted({c for t in own for c in t} - set(char))
        if n + len(extra) >= OTHER:
            raise ValueError(f"{path}: {n} pieces are too many for ids of 16 bits")
        symbol = char | {c: n + k for k, c in enumerate(extra)}
        of = {**own, **symbol}
        pairs = [(of[t[:k]], of[t[k:]], i) for t, i in own.items() for k in range(1, len(t)) if t[:k] in of and t[k:] in of]
        self.merge = {(a, b): c for a, b, c in pairs}
        _, rank = np.unique(-np.array([sp.get_score(i) for i in range(n)]), return_inverse=True)
        self.rank = rank.astype(np.int64)
        self.pairs = PairTable(pairs, self.rank)
        real = set(own.values())
        self.raw = pa.array([bytes([int(t[3:5], 16)]) if sp.is_byte(i) else t.replace("▁", " ").encode() if i in real else b"" for i, t in enumerate(text)], pa.binary())
        self.seed, self.limit, self.below = seed, cache, min(_M, int(dropout * 2.0**64))
        self.table = np.full(0x110000, OTHER, np.uint32)
        for c, i in symbol.items():
            self.table[ord(c)] = i
        self.table[0x20], self.table[0x2581] = self.table[0x2581], OTHER
        self.forget()

    def forget(self) -> None:
        """Empties the cache.

        Unit r's ids are ``pool[at[r] : at[r] + n_ids[r]]`` and its merges' parts of the skip hash
        ``part[first[r] : first[r] + n_merges[r]]``.
        """
        self.number: dict[str, int] = {}
        self.at, self.n_ids, self.first, self.n_merges = (np.empty(1 << 12, np.int32) for _ in range(4))
        self.pool, self.part = np.empty(1 << 14, np.uint16), np.empty(1 << 14, np.uint64)
        self.used = [0, 0]

    def key(self, doc_key: int, place: int) -> int:
        """The key of the unit at a place of a document."""
        return _mix((place * _C[0] + _mix((doc_key ^ self.seed * _C[1]) & _M)) & _M)

    def skipped(self, key: int, a: int, m: int, b: int) -> bool:
        """Whether the merge of the spans ``a:m`` and ``m:b`` of a unit is skipped."""
        return _mix((key + a * _C[0] + m * _C[1] + b * _C[2]) & _M) < self.below

    def spell(self, unit: str, symbols: list[tuple[int, int]]) -> list[int]:
        """The ids of (place, symbol); characters that are no piece are spelled in bytes."""
        out = []
        for i, s in symbols:
            out += [s] if s < self.n else [self.byte[b] for b in unit[i].encode("utf-8", "surrogatepass")]
        return out

    def one(self, unit: str, key: int) -> list[int]:
        """The ids of a unit, by a heap as agenda."""
        sym = self.table[_points([unit])].tolist()
        n = len(sym)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i] if i >= 0 else n
            if i >= 0 and j < n and (to := self.merge.get((sym[i], sym[j]))) is not None and not self.skipped(key, i, j, end[j]):
                heapq.heappush(agenda, (int(self.rank[to]), i, j, end[j], to))

        for i in range(n):
            offer(i)
        live = [True] * n
        while agenda:
            _, i, j, e, to = heapq.heappop(agenda)
            if not (live[i] and j < n and live[j] and after[i] == j and end[j] == e):
                continue
            sym[i], end[i], after[i], live[j] = to, e, after[j], False
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return self.spell(unit, [(i, s) for i, (s, ok) in enumerate(zip(sym, live, strict=True)) if ok])

    def _advance(self, sym: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
        """Merges units, a column each, in ``sym``; says which symbols stay, and the merges.

        The last row holds ``OTHER``, the symbol behind each unit. ``key`` None skips nothing.
        A step merges the first candidate of every column's agenda ``order``, in which a candidate
        is at its left symbol's place.
        """
        rows, n = sym.shape
        c0, c1, c2 = (np.uint64(x) for x in _C)
        stay = sym != OTHER + 1
        place = np.arange(rows, dtype=np.int32)[:, None]
        after, before = np.repeat(np.minimum(place + 1, rows - 1), n, axis=1).ravel(), np.repeat(np.where(place > 0, place - 1, rows - 1), n, axis=1).ravel()
        flat, kept = sym.ravel(), stay.ravel()
        order, to, columns = np.full((rows, n), NONE, np.int32), np.zeros((rows, n), np.int32), np.arange(n)

        def offer(at: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, a: np.ndarray, m: np.ndarray, b: np.ndarray) -> None:
            """Puts candidates at ``at`` of the agenda, those of columns ``of``."""
            hit, found = self.pairs.places(left, right)
            if key is not None and len(hit):
                h = mix(key[of[hit]] + a[hit].astype(np.uint64) * c0 + m[hit].astype(np.uint64) * c1 + b[hit].astype(np.uint64) * c2)
                ok = h >= np.uint64(self.below)
                hit, found = hit[ok], found[ok]
            agenda, goal = order.ravel(), to.ravel()
            agenda[at] = NONE
            agenda[at[hit]], goal[at[hit]] = self.pairs.order[found] | a[hit], self.pairs.to[found]

        a = np.repeat(place[:-1], n, axis=1).ravel()
        offer(np.arange(len(a)), np.tile(columns, rows - 1), flat[: len(a)], flat[n:], a, a + 1, a + 2)
        merged = []
        while True:
            first = order.min(axis=0)
            live = np.flatnonzero(first != NONE)
            if not len(live):
                return stay, merged
            m = order.shape[1]
            if len(live) < 0.7 * m:
                order, to, columns, first = np.take(order, live, axis=1), np.take(to, live, axis=1), columns[live], first[live]
                m, live = len(live), np.arange(len(live))
            else:
                first = first[live]
            of = columns[live]
            i = first & ((1 << PLACE) - 1)
            x = i * n + of
            new = to.ravel()[i * m + live].astype(np.uint32)
            j = after[x]
            y = j * n + of
            e = after[y]
            z = e * n + of
            if key is None:
                merged.append(np.stack([of, i, j, e]))
            flat[x], after[x], before[z], kept[y] = new, e, i, False
            order.ravel()[j * m + live] = NONE
            p = before[x]
            two = np.concatenate
            offer(two([p * m + live, i * m + live]), two([of, of]), two([flat[p * n + of], new]), two([new, flat[z]]), two([p, i]), two([i, e]), two([e, after[z]]))

    def agendas(self, units: list[str], key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, how many each unit has, parts of the merges' hash, how many) of short units.

        Merges are given for ``key`` None only, which skips none.
        """
        size = np.fromiter(map(len, units), np.int64, len(units))
        start = np.cumsum(size) - size
        symbols = np.append(self.table[_points(units)], np.uint32(OTHER))
        n_ids, n_merges = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        found, parts = [], []
        low = 0
        for width in WIDTHS:
            who = np.flatnonzero((size > low) & (size <= width))
            low = width
            if not len(who):
                continue
            place = np.arange(width + 1)[:, None]
            inside = place < size[who]
            sym = np.where(inside, symbols[np.where(inside, start[who] + place, -1)], np.uint32(OTHER))
            stay, merged = self._advance(sym, None if key is None else key[who])
            stay = (stay & inside).T
            ids, n = sym.T[stay], stay.sum(axis=1)
            odd = np.flatnonzero(((sym.T >= self.n) & stay).any(axis=1))
            if len(odd):
                cut = np.split(ids, np.cumsum(n)[:-1])
                for k in odd.tolist():
                    cut[k] = np.array(self.spell(units[who[k]], list(zip(np.flatnonzero(stay[k]).tolist(), cut[k].tolist(), strict=True))), np.uint32)
                ids, n = np.concatenate(cut), np.array([len(x) for x in cut])
            n_ids[who] = n
            found.append((who, ids.astype(np.uint16), n))
            if merged:
                of, a, m, b = np.concatenate(merged, axis=1)
                part = sum(x.astype(np.uint64) * np.uint64(c) for x, c in zip((a, m, b), _C, strict=True))
                by = np.argsort(of, kind="stable")
                n_merges[who] = k = np.bincount(of, minlength=len(who))
                parts.append((who, part[by], k))

        def placed(pieces: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: np.ndarray, dtype) -> np.ndarray:
            out, start = np.empty(int(n.sum()), dtype), np.cumsum(n) - n
            for who, values, k in pieces:
                out[_spread(start[who], k)] = values
            return out

        return placed(found, n_ids, np.uint16), n_ids, placed(parts, n_merges, np.uint64), n_merges

    def remember(self, units: list[str]) -> None:
        """Adds new units' own segmentations to the cache."""
        ids, n_ids, part, n_merges = self.agendas(units, None)
        n, (a, m) = len(self.number), self.used
        end, (b, k) = n + len(units), (a + len(ids), m + len(part))
        self.at, self.n_ids, self.first, self.n_merges = (_room(x, end) for x in (self.at, self.n_ids, self.first, self.n_merges))
        self.pool, self.part, self.used = _room(self.pool, b), _room(self.part, k), [b, k]
        self.at[n:end], self.n_ids[n:end] = a + np.cumsum(n_ids) - n_ids, n_ids
        self.first[n:end], self.n_merges[n:end] = m + np.cumsum(n_merges) - n_merges, n_merges
        self.pool[a:b], self.part[m:k] = ids, part
        self.number.update(zip(units, range(n, end), strict=True))

    def segment(self, units: list[str], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each unit has) of units of any length."""
        if len(self.number) > self.limit:
            self.forget()
        number = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(number < 0)
        new = [units[i] for i in missing.tolist()]
        # What occurs here once has an agenda of its own and isn't kept.
        fresh = [u for u, n in Counter(new).items() if n > 1 and len(u) <= LONG]
        if fresh:
            self.remember(fresh)
            number[missing] = np.fromiter(map(self.number.get, new, repeat(-1)), np.int64, len(new))
        short = np.flatnonzero(number >= 0)
        r = number[short]
        start, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        start[short], size[short] = self.at[r], self.n_ids[r]
        pools, n = [self.pool[: self.used[0]]], self.used[0]
        length = np.fromiter(map(len, units), np.int64, len(units))
        agenda = (number < 0) & (length <= LONG)
        if self.below:
            k = self.n_merges[r]
            of = np.repeat(short, k)
            agenda[of[mix(key[of] + self.part[_spread(self.first[r], k)]) < np.uint64(self.below)]] = True
        who = np.flatnonzero(agenda)
        if len(who):
            ids, n_ids, _, _ = self.agendas([units[i] for i in who.tolist()], key[who])
            start[who], size[who] = n + np.cumsum(n_ids) - n_ids, n_ids
            pools.append(ids)
            n += len(ids)
        for i in np.flatnonzero(length > LONG).tolist():
            ids = np.array(self.one(units[i], int(key[i])), np.uint16)
            start[i], size[i] = n, len(ids)
            pools.append(ids)
            n += len(ids)
        return np.concatenate(pools)[_spread(start, size)], size

    def encode(self, doc_keys: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each text has): all texts' ids of 16 bits, one text after another."""
        base = np.array([_mix((k ^ self.seed * _C[1]) & _M) for k in doc_keys], np.uint64)
        out, total = [np.empty(0, np.uint16)], np.zeros(len(texts), np.int64)
        held: list[tuple[int, int, list[str]]] = []

        def flush() -> None:
            size = np.array([len(u) for _, _, u in held])
            who = np.repeat(np.array([k for k, _, _ in held]), size)
            place = _spread(np.array([at for _, at, _ in held]), size)
            ids, n = self.segment([u for _, _, units in held for u in units], mix(place.astype(np.uint64) * np.uint64(_C[0]) + base[who]))
            out.append(ids)
            total[:] += np.bincount(who, n, len(texts)).astype(np.int64)
            held.clear()

        room = 0
        for k, text in enumerate(texts):
            at = 0
            for part in _slices(" " + text, SLICE) if text else ():
                units = UNIT.findall(part)
                held.append((k, at, units))
                at, room = at + len(units), room + len(units)
                if room >= ROOM:
                    flush()
                    room = 0
        if held:
            flush()
        return np.concatenate(out), total

    def decode(self, ids: pa.Array, offsets: np.ndarray) -> pa.Array:
        """The text of each run ``offsets[i]:offsets[i + 1]`` of ids, without the blank put before it."""
        if not len(ids):
            return pa.array([""] * (len(offsets) - 1), pa.string())
        spelled = self.raw.take(ids)
        at = np.frombuffer(spelled.buffers()[1], np.int32)[offsets]
        data, some = np.frombuffer(spelled.buffers()[2], np.uint8)[: at[-1]], at[1:] > at[:-1]
        blank = np.zeros(len(data), bool)
        blank[at[:-1][some]] = True
        at = at - np.concatenate(([0], np.cumsum(some))).astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(data[~blank])])
        out.validate(full=True)
        return out


_open: dict[tuple, Pieces] = {}


def pieces(path: str, dropout: float, seed: int) -> Pieces:
    """This process's encoder of a model; the model is read once per worker."""
    key = (path, dropout, seed)
    if key not in _open:
        _open[key] = Pieces(path, dropout, seed)
    return _open[key]


@dataclass(frozen=True)
class Dropout:
    """The model, the chance that a candidate merge is skipped, and the key."""

    path: str
    chance: float = 0.1
    seed: int = 1


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def encode_pieces(docs: DataFrame, p: Dropout) -> DataFrame:
    """All columns of ``docs`` (doc_id, text) and ``ids``, an array of int.

    An empty text has no ids, a null text null ones. The document's key is its doc_id, 0 if null;
    so repeated rows are cut alike. A column named ids is replaced. Texts of any length are worked
    on in parts, which changes nothing. ValueError if the model has no byte fallback, pieces that
    span white space, or more ids than 16 bits hold.
    """
    docs = docs.drop("ids")
    d, x = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(it):
        sp = pieces(p.path, p.chance, p.seed)
        for whole in it:
            for b in batches([whole], 256):
                texts = b.column(x).to_pylist()
                values, n = sp.encode([int(k or 0) for k in b.column(d).to_pylist()], [t or "" for t in texts])
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)), mask=b.column(x).is_null())
                yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, _with(docs, "ids", T.ArrayType(T.IntegerType())))


def decode_pieces(encoded: DataFrame, p: Dropout) -> DataFrame:
    """All columns of ``encoded`` (with ids) and ``decoded``, the text; null ids give null."""
    encoded = encoded.drop("decoded")
    at = encoded.columns.index("ids")

    def run(it):
        sp = pieces(p.path, p.chance, p.seed)
        for whole in it:
            for b in batches([whole], 256):
                column = b.column(at)
                offsets = column.offsets.to_numpy()
                text = sp.decode(column.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0])
                text = pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*b.columns, text], names=[*b.schema.names, "decoded"])

    return encoded.mapInArrow(run, _with(encoded, "decoded", T.StringType()))
