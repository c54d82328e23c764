"""Word shingles as 64-bit hashes and the PartEnum signatures of shingle sets, both vectorised over batches of texts.

A text is lower-cased in A-Z and split into words ``[^\\x20\\x09-\\x0D]+``. Its set holds the hashes of its distinct
runs of ``size`` words; a text with fewer words, but at least one, has its whole word sequence as its only element. Null and
blank texts have the empty set. All hashing works on UTF-8 bytes, so a text of any length costs time in
proportion to its bytes and memory of about 40 bytes a byte of one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U = np.uint64
BATCH_BYTES = 1 << 18
#: Ranges that a signature tells apart, and the bits for them and the parity of a band.
RANGES, PLACE = 1 << 12, 13
#: Ranges that two similar sets agree in among those that they sign, where they have as many.
AGREE = 4
#: Fewest cells of a sketch.
SKETCH_BITS = 512

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return run(_BASE), run(pow(_BASE, -1, 2**64))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch, and where each text's words begin (one more entry than texts)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = _LOWER[np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)]
    blank = _BLANK[raw]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    size = 1 << max(19, int(len(raw)).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + U(1)) * power[: len(raw)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    begins = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
    return words, np.searchsorted(starts, begins)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(texts)
    runs = np.zeros(max(0, len(words) - size + 1), dtype=np.uint64)
    for i in range(size):
        runs += mix(words[i : i + len(runs)] + U(i + 1))
    runs = mix(runs + U(size))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        elif b > a:
            whole = sum(mix(words[a + i : a + i + 1] + U(i + 1)) for i in range(b - a))
            out.append(mix(whole + U(b - a)))
        else:
            out.append(runs[:0])
    return out


def blocks(texts: list[str | None], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of consecutive texts of about ``limit`` characters, or of one longer text."""
    a, n = 0, 0
    for i, t in enumerate(texts):
        if n and n + len(t or "") > limit:
            yield a, i
            a, n = i, 0
        n += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that identify a set."""
    with np.errstate(over="ignore"):
        return tuple(int(x) for x in np.array([mix(s ^ U(0x5851F42D4C957F2D)).sum(), mix(s + U(0x14057B7EF767814F)).sum()], dtype=np.uint64).view(np.int64))


class PartEnum:
    """Signatures such that any two sets with intersection / union >= percent / 100 share one.

    Set sizes fall into bands that grow by ``growth``. Within a band the largest symmetric difference of two similar
    sets is at most ``k``. The 64-bit feature domain is cut into ``n1`` > k equal ranges, and the elements that fall in a
    range are one signature; a difference spoils one range at most, so similar sets agree on at least one signature.
    A set near the next band's lower end signs there as well.

    Mostly more than one signature agrees: a set differs from any similar one of the band by a number d <= k that depends on
    its size, so of its ranges with elements all but d agree. Of these ranges AGREE are enough: a set with more leaves out
    as many of the last ranges as it has more. Of two similar sets the one that leaves out more still has AGREE of its agreeing
    ranges among the rest, which the other signs too, so nothing is lost.

    Ranges without elements would put unrelated sets together. Only sets that may have no agreeing range with elements sign
    them; if both of two similar sets may, both sign all ranges.
    ``needs`` gives the least number of agreeing ranges among those that are signed.
    The lowest PLACE bits of a signature name its band's parity and its range, so that agreeing ranges can be counted.
    """

    def __init__(self, percent: int, growth: float = 1.4, spare: float = 1.15):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be between 50 and 100")
        #: Similar sets lie in one band or in two that follow each other.
        growth = max(growth, 100 / percent + 0.01)
        self.percent, self.growth, self.spare = percent, growth, spare
        self.low: list[int] = [1]
        self.n1: list[int] = []
        self.k: list[int] = []

    def _grow(self, size: int) -> None:
        """Lay out bands until one begins beyond this size and the next."""
        while len(self.low) < 3 or self.low[-2] <= size:
            low = self.low[-1]
            high = max(low, int(low * self.growth))
            total = np.arange(2, 2 * high + 1)
            k = int(most_apart(total, self.percent).max())
            self.k.append(k)
            need = k + 1
            self.n1.append(need if need <= 2 else int(np.ceil(need * self.spare)))
            self.low.append(high + 1)

    def _bands(self, sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(band, indexes of the sets that sign in it, index of each element among all sets' elements, index of its set among the signing ones)."""
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self._grow(int(sizes.max(initial=1)))
        low = np.array(self.low)
        band = np.searchsorted(low, sizes, side="right") - 1
        also = 100 * sizes >= self.percent * low[band + 1]
        begin = np.cumsum(sizes) - sizes
        for b in sorted({*band[sizes > 0].tolist(), *(band[also & (sizes > 0)] + 1).tolist()}):
            own = np.flatnonzero((sizes > 0) & ((band == b) | (also & (band + 1 == b))))
            n = sizes[own]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)
            yield b, own, at, np.repeat(np.arange(len(own)), n)

    def _ranges(self, b: int, features: np.ndarray, local: np.ndarray) -> np.ndarray:
        """The range of each element, numbered through the sets of a band."""
        width = self.n1[b]
        return (((features >> U(32)) * U(width)) >> U(32)).astype(np.int64) + local * width

    def _agreeing(self, b: int, sizes: np.ndarray, full: np.ndarray) -> np.ndarray:
        """How many ranges with elements each set at least shares with any similar set of the band; not above zero where there may be none."""
        total = sizes + np.minimum(self.low[b + 1] - 1, 100 * sizes // self.percent)
        return full.sum(axis=1) - np.minimum(self.k[b], total * (100 - self.percent) // (100 + self.percent))

    def signatures(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All signatures of a batch of sorted sets, and the index of the set that each belongs to."""
        flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        order = mix(flat ^ U(0xD6E8FEB86659FD93))
        sigs, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
        for b, own, at, local in self._bands(sets):
            parity = U((b & 1) << (PLACE - 1))
            if self.k[b] == 0:
                first = np.flatnonzero(np.concatenate([[True], local[1:] != local[:-1]]))
                sigs.append(_placed(mix(np.add.reduceat(order[at], first) + mix(np.array([b + 1], dtype=np.uint64))), parity))
                owners.append(own)
                continue
            n1 = self.n1[b]
            place = self._ranges(b, flat[at], local)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            sums = np.zeros(len(own) * n1, dtype=np.uint64)
            sums[place[first]] = np.add.reduceat(order[at], first)
            full = np.zeros(len(sums), bool)
            full[place[first]] = True
            sums, full = sums.reshape(-1, n1), full.reshape(-1, n1)
            agree = self._agreeing(b, sizes[own], full)
            ranges = np.arange(n1, dtype=np.uint64)
            key = mix(ranges * U(4) + (U(b + 1) << U(32)))
            sign = _placed(mix((sums + U(1)) * U(0xD1342543DE82EF95) + key), parity | (ranges & U(RANGES - 1)))
            live = (full | (agree < 1)[:, None]) & (np.arange(n1) < (n1 - np.maximum(0, agree - AGREE))[:, None])
            sigs.append(sign[live])
            owners.append(own[np.nonzero(live)[0]])
        return np.concatenate(sigs), np.concatenate(owners)

    def needs(self, sets: list[np.ndarray]) -> np.ndarray:
        """For each set the least number of ranges, as signatures name them, in which it agrees with any similar set: in bands of even and of odd number."""
        flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        out = np.ones((len(sets), 2), dtype=np.int64)
        for b, own, at, local in self._bands(sets):
            if self.k[b]:
                n1 = self.n1[b]
                full = np.zeros(len(own) * n1, bool)
                full[self._ranges(b, flat[at], local)] = True
                agree = np.minimum(AGREE, self._agreeing(b, sizes[own], full.reshape(-1, n1)))
                out[own, b & 1] = np.maximum(1, -(-agree // -(-n1 // RANGES)))
        return out


def _placed(sign: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (sign & ~U((1 << PLACE) - 1)) | place


def sketches(sets: list[np.ndarray]) -> list[bytes]:
    """The parity of each set's elements in cells named by their lowest bits: a power of two of cells, at least SKETCH_BITS and twice the set's size.

    Each element in which two sets differ turns one cell, so the number of cells that differ is at most the size of their
    symmetric difference, and close to it. Xor of both halves gives the sketch of half as many cells.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    cells = np.array([max(SKETCH_BITS, 1 << int(2 * n - 1).bit_length()) if n else SKETCH_BITS for n in sizes.tolist()], dtype=np.int64)
    begin = np.cumsum(cells) - cells
    flat = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    cell = (flat & np.repeat(cells - 1, sizes).astype(np.uint64)).astype(np.int64) + np.repeat(begin, sizes)
    bits = np.packbits((np.bincount(cell, minlength=int(cells.sum())) & 1).astype(bool), bitorder="little").tobytes()
    return [bits[a // 8 : (a + c) // 8] for a, c in zip(begin.tolist(), cells.tolist())]


def halved(words: np.ndarray) -> np.ndarray:
    """Sketches, one a row of 64-bit words, of half as many cells."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def most_apart(total: np.ndarray, percent: int) -> np.ndarray:
    """The largest symmetric difference of similar sets whose sizes add up to ``total``."""
    return total - 2 * -(-percent * total // (100 + percent))
