"""Spelling variant grouping by letter-parity bitmasks in three bands.

A word's mask holds, for each letter, whether the word has it an odd number of times. One inserted or deleted letter flips one bit and one
replaced letter at most two, so of three bands of the mask at least one stays. Words meet where a band is equal and their
lengths differ by at most one; a pair is looked at in the first band that it shares, passes if the masks differ in two bits at most, and is
then verified by edit distance. Nothing is lost, whatever letters the bands hold; so that few words share a
band, letters are dealt to bands by turns, those first whose parity is nearest to even odds.

The words of a band's value and length are dealt into blocks of about ``BLOCK``, and each pair of blocks is a join key of
its own, so a value that very many words share spreads over tasks. Of the pairs only each word's count and best partner go on.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, salted, slices, workspace

#: Words of a block, on average, and different words that a counting task holds before it passes their counts on.
BLOCK, HELD = 1 << 15, 400_000
#: Pairs of masks, and letters of pairs, that a task compares at once.
PAIRS = 1 << 20
#: Bands, bits of one, and the bits of the lower of two side by side.
BANDS, WIDTH = 3, 30
LOWER = (1 << WIDTH) - 1
#: What names a pair of blocks, and rows of the bin that a task compares at once, on average.
UNIT, BIN = ("band", "value", "least", "longer", "part", "mate"), 1 << 16
#: A letter of a word.
LETTER = "[A-Za-zÀ-ÿ]"
_LETTERS = [*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100))]


def slip(doc: int, word: str, every: int) -> str:
    """The word, with a letter deleted if ``every`` divides the checksum of document and word."""
    h = zlib.crc32(f"{doc}:{word}".encode())
    at = h % len(word)
    return word if h % every else word[:at] + word[at + 1 :]


def _counted(least_chars: int, every: int):
    find = re.compile(f"{LETTER}{{{max(1, least_chars)},}}").findall  # shorter runs can't give longer words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in slices(batches):
            for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist()):
                # Bytes lower only A-Z.
                found, head = Counter(find(text.lower().decode("utf-8", "replace"))), None
                if every and doc is not None:
                    head = zlib.crc32(f"{doc}:".encode())
                for word, n in found.items():
                    if head is not None and zlib.crc32(word.encode(), head) % every == 0:
                        word = slip(doc, word, every)
                        if len(word) < least_chars:
                            continue
                    held[word] += n
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return run


def words(docs: DataFrame, least_chars: int = 5, least_n: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of least_chars code points that occur least_n times, over whole texts.

    Letters are deleted by ``slip`` (never if ``every`` is 0, nor in rows without an integer id). Null and empty texts have no words.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").cast("binary").alias("text")).where("text is not null")
    return text.mapInArrow(_counted(least_chars, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _parities(words: list[str], tables: list[np.ndarray]) -> list[np.ndarray]:
    """For each table of a bit (or none) for each letter, the parities of each word's letters."""
    raws = [w.encode("latin-1") for w in words]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in raws])[:-1]]).astype(np.int64)
    codes = np.frombuffer(b"".join(raws), np.uint8)
    return [np.bitwise_xor.reduceat(t[codes], starts) if raws else np.zeros(0, np.int64) for t in tables]


def _table(letters: list[str]) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in letters]] = 1 << np.arange(len(letters), dtype=np.int64)
    return out


def _bands(vocabulary: DataFrame) -> list[list[str]]:
    """Letters of each band: the one with the most even parity to the first band, the next to the second, and so on."""

    def odds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, odd, tables = 0, np.zeros(len(_LETTERS), np.int64), [_table([c]) for c in _LETTERS]
        for batch in slices(batches, 4096):
            n += len(batch)
            odd += [int(m.sum()) for m in _parities(batch["word"].to_pylist(), tables)]
        yield pa.RecordBatch.from_arrays([pa.array(_LETTERS), pa.array(odd), pa.array([n] * len(odd), pa.int64())], names=["letter", "odd", "n"])

    rows = vocabulary.select("word").mapInArrow(odds, "letter string, odd long, n long").groupBy("letter").agg(F.sum("odd").alias("odd"), F.sum("n").alias("n")).collect()
    share = {r.letter: r.odd / max(1, r.n) for r in rows}
    order = sorted(_LETTERS, key=lambda c: (abs(0.5 - share.get(c, 0.0)), c))
    return [order[b::BANDS] for b in range(BANDS)]


def _masked(vocabulary: DataFrame, bands: list[list[str]]) -> DataFrame:
    """(word, n, size, b0, b1, b2): the bands of each word's mask."""
    tables = [_table(b) for b in bands]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            words = batch["word"].to_pylist()
            cols = [batch["word"], batch["n"], pa.array([len(w) for w in words], pa.int32()), *map(pa.array, _parities(words, tables))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "n", "size", "b0", "b1", "b2"])

    return vocabulary.mapInArrow(run, "word string, n long, size int, b0 long, b1 long, b2 long")


def _letters_of(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of letters are one edit apart; those of b are as long or longer by one."""
    size = a.shape[1]
    if b.shape[1] == size:
        return (a != b).sum(axis=1) == 1
    alike = lambda eq: np.where(eq.all(axis=1), size, eq.argmin(axis=1))
    return alike(a == b[:, :size]) + alike((a == b[:, 1:])[:, ::-1]) >= size


def _best(word: list[str], i: np.ndarray, other: list[str], n: np.ndarray, j: np.ndarray) -> pa.Table:
    """For each word of the pairs (i, j): the number of its partners, and the best of them."""
    place = np.empty(len(other), np.int64)
    place[sorted(range(len(other)), key=other.__getitem__)] = np.arange(len(other))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, np.int64)
    sums = np.diff(np.append(first, len(i)))
    return pa.table({"word": pa.array([word[x] for x in i[first]], pa.string()), "n_near": pa.array(sums, pa.int64()), "less": pa.array(-n[j[first]], pa.int64()), "other": pa.array([other[x] for x in j[first]], pa.string())})


def _alike(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of equal rows of letters of a and b, at most about PAIRS at a time."""
    a, b = (np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel() for x in (a, b))
    order = np.argsort(b)
    lo, hi = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    total = np.concatenate([[0], np.cumsum(hi - lo)])
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, total[at] + PAIRS, "right")) - 1)
        n = (hi - lo)[at:to]
        i = np.repeat(np.arange(at, to), n)
        yield i, order[np.arange(n.sum()) + np.repeat(lo[at:to] - (total[at:to] - total[at]), n)]
        at = to


def _compare(unit: tuple[int, ...], a: list[str], ni: np.ndarray, x: np.ndarray, b: list[str], nj: np.ndarray, y: np.ndarray) -> Iterator[pa.Table]:
    """Partial results of the words a and b of one pair of blocks, with their n and the two other bands of their masks.

    One edit leaves the first or the second half of a word alone, so only words that agree in a half are looked at.
    """
    band, _, size, longer, part, mate = unit
    s, t, half = _letters_of(a), _letters_of(b), size // 2
    heads = (s[:, :half], t[:, :half]) if half else (np.ones((len(a), 1), np.uint8), np.ones((len(b), 1), np.uint8))
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for second in (False, True):
        for i, j in _alike(s[:, half:], t[:, half + longer :]) if second else _alike(*heads):
            flips = x[i] ^ y[j]
            # Bands come in order, so the first shared band is this one if all before it differ.
            first = True if band == 0 else flips >> WIDTH != 0 if band == 1 else (flips >> WIDTH != 0) & (flips & LOWER != 0)
            near = (np.bitwise_count(flips) <= 2) & first
            i, j = i[near], j[near]
            for c in range(0, len(i), max(1, PAIRS // size)):
                ii, jj = i[c : c + max(1, PAIRS // size)], j[c : c + max(1, PAIRS // size)]
                good = _one_edit(s[ii], t[jj])
                if second:
                    good &= (s[ii, :half] != t[jj, :half]).any(axis=1)
                pairs.append((ii[good], jj[good]))
    i, j = (np.concatenate(p) for p in zip(*pairs))
    yield _best(a, i, b, nj, j)
    if longer or part != mate:  # else both sides hold the same words, and each pair stands twice
        yield _best(b, j, a, ni, i)


def _compared(table: pa.Table) -> pa.Table:
    """Partial results of all pairs of blocks that a bin holds."""
    table = table.sort_by([(c, "ascending") for c in (*UNIT, "side")])
    keys = np.stack([table[c].to_numpy() for c in (*UNIT, "side")])
    starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
    ends = np.append(starts[1:], table.num_rows)
    n, rest, out = table["n"].to_numpy(), table["rest"].to_numpy(), []
    for k in range(len(starts) - 1):
        if (keys[:-1, starts[k]] == keys[:-1, starts[k + 1]]).all():
            l, r = slice(starts[k], ends[k]), slice(starts[k + 1], ends[k + 1])
            a, b = (table["word"].slice(v.start, v.stop - v.start).to_pylist() for v in (l, r))
            out += _compare(tuple(keys[:-1, starts[k]].tolist()), a, n[l], rest[l], b, n[r], rest[r])
    return pa.concat_tables(out) if out else _best([], np.zeros(0, np.int64), [], n[:0], np.zeros(0, np.int64))


def near(vocabulary: DataFrame, folder: str) -> DataFrame:
    """(word, n_near, less, other): partial counts of each word's near words, and the best of them with minus its n."""
    masks = cut(_masked(vocabulary, _bands(vocabulary)), folder)
    others = [[x for x in range(BANDS) if x != i] for i in range(BANDS)]
    sign = lambda size: [F.struct(F.lit(i).alias("band"), F.col(f"b{i}").alias("value"), size.alias("least"), (F.shiftleft(f"b{u}", WIDTH) + F.col(f"b{v}")).alias("rest")) for i, (u, v) in enumerate(others)]
    key = ["band", "value", "least"]
    signed = lambda size: masks.select("word", "n", F.explode(F.array(*sign(size))).alias("k")).select("word", "n", "k.*")
    short, long = signed(F.col("size")), signed(F.col("size") - 1)
    count = short.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    count = cut(count.join(long.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("longs")), key, "left").fillna(0, ["longs"]), folder)
    deal = lambda n: F.pmod(F.xxhash64("word"), F.col(n)).cast("int")
    upto = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)))
    rows = lambda df, side, longer, part, mate: df.select(*key, F.lit(longer).alias("longer"), part.alias("part"), mate.alias("mate"), F.lit(side).alias("side"), "word", "n", "rest")
    own, zero = F.col("own"), F.lit(0)
    short, long = short.join(count, key).withColumn("own", deal("parts")), long.join(count.where("longs > 0"), key).withColumn("own", deal("longs"))
    met = rows(short, 0, 0, own, upto(own, F.col("parts") - 1)).union(rows(short, 1, 0, upto(zero, own), own))
    met = met.union(rows(short, 0, 1, own, upto(zero, F.col("longs") - 1))).union(rows(long, 1, 1, upto(zero, F.col("parts") - 1), own))
    bins = max(1, met.count() // BIN)
    met = met.withColumn("bin", F.pmod(F.xxhash64(*UNIT), F.lit(bins)))
    return met.groupBy("bin").applyInArrow(_compared, "word string, n_near long, less long, other string")


def variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, every: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of ``words``.

    n_near is the number of words that one inserted, deleted or replaced code point parts from it. form is the one of them with the
    largest n (the smallest in code-point order of several), if that is at least twice the word's n; else null. root follows forms to
    the last. Forms at least double n, so they never run in a circle, and root takes few rounds.

    Null, empty and repeated texts count as they stand; no words give no rows; extra columns of docs are ignored. The rows are computed
    at once and stand as a table in the shared folder; the working tables are deleted.
    """
    with workspace(docs.sparkSession) as folder:
        vocabulary = cut(words(docs, least_chars, least_n, every, id_col, text_col), folder)
        best = near(vocabulary, folder).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "other")).alias("best"))
        rows = vocabulary.join(best, "word", "left")
        leads = -F.col("best.less") >= 2 * F.col("n")
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("best.other")).alias("form"), F.when(leads, -F.col("best.less")).alias("form_n"))
        rows = cut(rows, folder)
        tree = rows.select("word", F.coalesce("form", "word").alias("root"))
        while True:
            above = tree.select(F.col("word").alias("root"), F.col("root").alias("top"))
            step = cut(salted(tree, above, "root").select("word", F.col("top").alias("root"), (F.col("top") != F.col("root")).alias("moved")), folder)
            tree = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        return cut(rows.join(tree, "word"))
