"""Sets of character n-grams inside a task, and an index of a small corpus of them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from math import ceil

import numpy as np

SIZE = 5
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def _mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram at each place but the last ones."""
    n = len(codes) - SIZE + 1
    x = codes[:n] * _ODD[0]
    for i in range(1, SIZE):
        x += codes[i : i + n] * _ODD[i]
        x ^= x >> np.uint64(29)
        x *= _ODD[SIZE - i]
    x ^= x >> np.uint64(32)
    return x


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; a text of ``SIZE`` characters or fewer is its own only one."""
    if not text:
        return np.empty(0, np.uint64)
    codes = _codes(text)
    return np.unique(_mixed(np.pad(codes, (0, max(0, SIZE - len(codes))))))


def hashes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of several texts in order, with repetitions, and the numbers of the texts."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    # A short text is filled up; what stands between texts is left out.
    room = np.where(lengths > 0, np.maximum(lengths, SIZE), 0)
    ends = np.cumsum(room)
    if not len(ends) or not ends[-1]:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    codes = _codes("".join(texts))
    if (room != lengths).any():
        wide = np.zeros(ends[-1], np.uint64)
        wide[np.arange(len(codes)) + np.repeat(ends - room - (np.cumsum(lengths) - lengths), lengths)] = codes
        codes = wide
    of = np.repeat(np.arange(len(texts)), room)[: len(codes) - SIZE + 1]
    inside = np.flatnonzero(np.arange(len(of)) + SIZE <= ends[of])
    return _mixed(codes)[inside], of[inside]


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each is there."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def gram_set(text: str | None) -> frozenset[str]:
    """The n-grams themselves."""
    text = text or ""
    if len(text) <= SIZE:
        return frozenset([text]) if text else frozenset()
    return frozenset(text[i : i + SIZE] for i in range(len(text) - SIZE + 1))


def jaccard_of(a: frozenset, b: frozenset) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common) if a or b else 1.0


def rounded(score: float) -> float:
    """To 6 places, half up in decimals, as Spark's round does."""
    return float(Decimal(repr(score)).quantize(Decimal("1e-6"), ROUND_HALF_UP))


class Rarity:
    """How often a corpus has a gram, in quarters of a power of two, by cells of a table of at most ``MOST`` bytes."""

    LEAST, MOST = 1 << 10, 1 << 22

    @classmethod
    def cells_for(cls, grams: int) -> int:
        return min(max(cls.LEAST, 1 << (4 * grams).bit_length()), cls.MOST)

    def __init__(self, cells: int, at: np.ndarray, counts: np.ndarray) -> None:
        self.mask, self.steps = np.uint64(cells - 1), np.zeros(cells, np.uint8)
        self.steps[at] = 1 + np.floor(4 * np.log2(counts)).astype(np.uint8)

    def in_order(self, found: np.ndarray) -> tuple[int, np.ndarray]:
        """(grams, those that the corpus may have, the rarest first). The order is the same for all that ask."""
        steps = self.steps[(found & self.mask).astype(np.int64)]
        there = found[steps > 0]
        return len(found), there[np.lexsort((there, steps[steps > 0]))]


class GramIndex:
    """A corpus of (id, text): its units by their number of grams, and for each gram the units that have it. Grams are
    numbered by how many units have them, so that the numbers of a text's grams in order begin with the rarest."""

    #: Characters that are gone through at once.
    CHARS = 1 << 18

    def __init__(self, ids: list[int], texts: list[str]) -> None:
        sets = [hashes(t) for t in texts]
        order = sorted((i for i in range(len(ids)) if len(sets[i])), key=lambda i: (len(sets[i]), ids[i]))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        self.sizes = np.array([len(sets[i]) for i in order], np.int64)
        self.ends = np.cumsum(self.sizes)
        grams = np.concatenate([sets[i] for i in order]) if order else np.empty(0, np.uint64)
        self.grams, own, often = np.unique(grams, return_inverse=True, return_counts=True)
        self.numbers = np.empty(len(often), np.int64)
        self.numbers[np.argsort(often, kind="stable")] = np.arange(len(often))
        #: The grams of each unit, one unit after the other.
        self.own = self.numbers[own]
        self.units = np.repeat(np.arange(len(order)), self.sizes)[np.argsort(self.own, kind="stable")]
        self.starts = np.concatenate([[0], np.cumsum(np.sort(often))])
        # A gram is looked for in its cell; where several grams have one, by search.
        self.mask = np.uint64((1 << max(10, (8 * len(self.grams)).bit_length())) - 1)
        cells = (self.grams & self.mask).astype(np.int64)
        self.cells, self.crowded = np.full(int(self.mask) + 1, -1, np.int32), np.bincount(cells, minlength=int(self.mask) + 1) > 1
        self.cells[cells] = np.arange(len(cells))

    def _found(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the hashes that the corpus has, and which of its grams they are."""
        cell = (x & self.mask).astype(np.int64)
        hit = np.flatnonzero(self.cells[cell] >= 0)
        cell, x = cell[hit], x[hit]
        at = self.cells[cell].astype(np.int64)
        more = np.flatnonzero(self.crowded[cell])
        at[more] = np.minimum(np.searchsorted(self.grams, x[more]), len(self.grams) - 1)
        same = self.grams[at] == x
        return hit[same], at[same]

    def candidates(self, text: str, t: float) -> list[tuple[int, float]]:
        return self.candidates_of([text], t)[0]

    def candidates_of(self, texts: list[str], t: float) -> list[list[tuple[int, float]]]:
        """For each text (unit, the most that its similarity can be) of the units that may reach t."""
        out: list[list[tuple[int, float]]] = [[] for _ in texts]
        some, chars = [], 0
        for i, text in enumerate(texts):
            if self.ids and text and not self._too_many(text, t):
                some.append(i)
                chars += len(text)
            if some and (chars >= self.CHARS or i == len(texts) - 1):
                self._find(some, texts, t, out)
                some, chars = [], 0
        if some:
            self._find(some, texts, t, out)
        return out

    def _too_many(self, text: str, t: float) -> bool:
        """Whether the first part of a long text has more grams than a text that is similar to the largest unit can have."""
        most = int(self.sizes[-1] / t) + 1
        return len(text) > 4 * most and len(hashes(text[: 2 * most])) > most

    def _find(self, some: list[int], texts: list[str], t: float, out: list[list[tuple[int, float]]]) -> None:
        """The candidates of some texts at once; texts are numbered by their place among them."""
        x, row = hashes_of([texts[i] for i in some])
        k = len(some)
        # Equal hashes of a text are equal here too, so this counts no gram twice; it may take two grams for one, and
        # then the text seems smaller than it is, which only lets more pairs through.
        bits = np.uint64(k.bit_length())
        distinct, _ = _counted((x >> bits) | (row.astype(np.uint64) << (np.uint64(64) - bits)))
        n = np.bincount((distinct >> (np.uint64(64) - bits)).astype(np.int64), minlength=k)
        hit, at = self._found(x)
        size = len(self.grams)
        both, _ = _counted(row[hit] * size + self.numbers[at])
        rows, grams = both // size, both % size
        bounds = np.searchsorted(rows, np.arange(k + 1))
        common = np.diff(bounds)
        need = np.maximum(1, np.ceil(n * t).astype(np.int64))
        kept = np.maximum(0, common - need + 1)
        cut = np.arange(len(both)) - bounds[rows] < kept[rows]
        often = self.starts[grams[cut] + 1] - self.starts[grams[cut]]
        places = np.arange(often.sum()) - np.repeat(np.cumsum(often) - often, often) + np.repeat(self.starts[grams[cut]], often)
        met, counts = _counted(np.repeat(rows[cut], often) * len(self.ids) + self.units[places])
        rows, units = met // len(self.ids), met % len(self.ids)
        most = np.minimum(counts + need[rows] - 1, np.minimum(self.sizes[units], common[rows]))
        may = most >= t * (n[rows] + self.sizes[units] - most)
        rows, units = rows[may], units[may]
        # Of the few that are left all common grams are counted.
        flags, last = np.zeros(size, bool), -1
        for r, u in zip(rows.tolist(), units.tolist(), strict=True):
            if r != last:
                if last >= 0:
                    flags[grams[bounds[last] : bounds[last + 1]]] = False
                flags[grams[bounds[r] : bounds[r + 1]]] = True
                last = r
            c = int(np.count_nonzero(flags[self.own[self.ends[u] - self.sizes[u] : self.ends[u]]]))
            bound = c / max(1, int(n[r]) + int(self.sizes[u]) - c)
            if bound >= t:
                out[some[r]].append((u, bound))

    def score(self, text: str, unit: int) -> float:
        return jaccard_of(_kept_set(text), _kept_set(self.texts[unit]))

    def matches(self, text: str, t: float) -> list[tuple[int, float, float]]:
        """(id, similarity, its bound) of the units that reach t."""
        return self.matches_of([text], t)[0]

    def matches_of(self, texts: list[str], t: float) -> list[list[tuple[int, float, float]]]:
        """For each text (id, similarity, its bound) of the units that reach t."""
        scored = ([(self.ids[unit], self.score(text, unit), bound) for unit, bound in found] for text, found in zip(texts, self.candidates_of(texts, t), strict=True))
        return [[x for x in found if x[1] >= t] for found in scored]


#: Of texts that are compared several times in a row.
_kept_set = lru_cache(maxsize=512)(gram_set)
