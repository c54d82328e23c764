"""N-gram Jaccard join: exact similarity links and groups of word-shingle sets, found by signatures of ranges of their hashes.

1. One pass gives each document's set size, fingerprint, parity sketch and the number of signature ranges in which it must
   agree with any similar set (``shingles``). Equal sets are grouped by fingerprint, with the smallest id as their head.
2. A second pass signs the sets. A task emits a signature once, with its further holders beside it, so a hot signature
   costs the shuffle few rows a task. Holders of a signature are paired with its smallest holder only, never all with all.
3. Sizes and sketches rule most of these pairs out; the heads of the rest are verified on the hashes of all shingles of their whole texts,
   and verified links are closed into groups.
4. A link that is missing joins two groups, so its ends share signatures whose holders are in different groups. Only such
   signatures are looked at further. A holder that has them in fewer ranges than it must agree in with a similar set is
   dropped; that leaves few. The rest are gathered by the smallest holder of their signatures, their lead, and compared
   by sizes and sketches in pairs of blocks of bounded size; neither texts nor signatures go along. What passes is verified as in 3.
   So no link between different groups is lost, and pairs inside a group are never looked at.

Defined results: a null or blank text has size 0 and is its own component; rows with a null id have a null component;
rows that repeat an id are expected to repeat its text and get the same component; extra columns are ignored. Ids are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import components, cut, keep_likely, salted, slices, unused, workspace
from .shingles import PartEnum, blocks, fingerprint, halved, most_apart, shingle_sets, sketches

#: (signature, id) rows that a signing task holds before it emits them.
HELD = 1 << 19
#: Rows of an Arrow batch whose texts stand as Python strings at once.
ROWS = 512
#: Pairs of texts that one task may join.
TEXT_ROWS = 1 << 15
#: Members of a lead that one block aims at.
BLOCK = 2048
#: Bytes of sketches that are compared at once.
COMPARED = 1 << 23
#: The lowest bits of a signature: its range, and the parity of its band.
RANGE, PARITY = "sig & 4095", "cast(shiftright(sig, 12) & 1 as int)"


def _measure(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme = PartEnum(percent)
        for batch in slices(batches, ROWS):
            texts, ids = batch["text"].to_pylist(), batch["id"]
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], size)
                prints, needs = [fingerprint(s) for s in sets], scheme.needs(sets)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([x for x, _ in prints], pa.int64()),
                        pa.array([y for _, y in prints], pa.int64()),
                        pa.array(sketches(sets), pa.binary()),
                        pa.array(needs[:, 0], pa.int32()),
                        pa.array(needs[:, 1], pa.int32()),
                    ],
                    names=["id", "n", "print_a", "print_b", "sketch", "need_even", "need_odd"],
                )

    return run


def _sign(size: int, percent: int):
    def out(sig: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((ids, sig))
        sig, ids = sig[order], ids[order]
        new = np.concatenate([[True], (sig[1:] != sig[:-1]) | (ids[1:] != ids[:-1])])
        sig, ids = sig[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        more = np.diff(np.append(first, len(sig))) - 1
        # Neighbouring rows of one id make the shuffle smaller.
        row = np.argsort(ids[first], kind="stable")
        first, more = first[row], more[row]
        at = np.cumsum(more) - more
        rest = ids[np.arange(more.sum()) - np.repeat(at, more) + np.repeat(first + 1, more)]
        lists = pa.ListArray.from_arrays(pa.array(np.append(at, more.sum()), pa.int32()), pa.array(rest, pa.int64()), mask=pa.array(more == 0))
        return pa.RecordBatch.from_arrays([pa.array(sig[first].view(np.int64)), pa.array(ids[first], pa.int64()), lists], names=["sig", "id", "more"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, seen, sigs, ids, held = PartEnum(percent), set(), [], [], 0
        for batch in slices(batches, ROWS):
            texts, own = batch["text"].to_pylist(), batch["id"].to_numpy(zero_copy_only=False)
            for a, b in blocks(texts):
                sets = shingle_sets(texts[a:b], size)
                prints = [fingerprint(s) for s in sets]
                if len(seen) > HELD // 4:
                    seen.clear()
                fresh = []
                for i, p in enumerate(prints):
                    if len(sets[i]) and p not in seen:
                        seen.add(p)
                        fresh.append(i)
                if fresh:
                    sig, at = scheme.signatures([sets[i] for i in fresh])
                    sigs.append(sig)
                    ids.append(own[a:b][np.array(fresh)[at]])
                    held += len(sig)
                if held > HELD:
                    yield out(np.concatenate(sigs), np.concatenate(ids))
                    sigs, ids, held = [], [], 0
        if held:
            yield out(np.concatenate(sigs), np.concatenate(ids))

    return run


def _verify(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
            ta, tb = batch["text_a"].to_pylist(), batch["text_b"].to_pylist()
            for lo, hi in blocks([(x or "") + (y or "") for x, y in zip(ta, tb)], 1 << 22):
                texts = list({*ta[lo:hi], *tb[lo:hi]})
                sets = {}
                for x, y in blocks(texts):
                    sets.update(zip(texts[x:y], shingle_sets(texts[x:y], size)))
                good = []
                for i in range(lo, hi):
                    s, t = sets[ta[i]], sets[tb[i]]
                    if min(len(s), len(t)) * 100 >= percent * max(len(s), len(t), 1):
                        same = len(np.intersect1d(s, t, assume_unique=True))
                        if 100 * same >= percent * (len(s) + len(t) - same):
                            good.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in good], pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """The pairs (a, b) of ids whose whole texts are similar. ``pairs`` is a table of distinct pairs."""
    texts = keep_likely(docs, "id", pairs.select(F.col("a").alias("x")).union(pairs.select("b"))).dropDuplicates(["id"])
    both = cut(salted(pairs, texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b", task_rows=TEXT_ROWS), folder)
    both = salted(both, texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a", task_rows=TEXT_ROWS)
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verify(size, percent), "a long, b long")


def _words(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(parts), dtype=np.uint64).reshape(len(parts), -1)


def _alike(percent: int):
    """Pairs that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS * 8):
            n, m = (batch[c].to_numpy().astype(np.int64) for c in ("n_a", "n_b"))
            near = np.flatnonzero(100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            one, two = (batch[c].take(pa.array(near)).to_pylist() for c in ("sketch_a", "sketch_b"))
            most, good = most_apart(n + m, percent)[near], np.zeros(len(near), bool)
            widths = np.array([(len(x), len(y)) for x, y in zip(one, two)], dtype=np.int64).reshape(-1, 2)
            for u, v in {tuple(w) for w in widths.tolist()}:
                at = np.flatnonzero((widths == (u, v)).all(axis=1))
                x, y = _words([one[i] for i in at]), _words([two[i] for i in at])
                while x.shape[1] != y.shape[1]:
                    x, y = (halved(x), y) if x.shape[1] > y.shape[1] else (x, halved(y))
                good[at] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most[at]
            yield pa.RecordBatch.from_arrays([batch[c].take(pa.array(near[good])) for c in ("head_a", "head_b")], names=["a", "b"])

    return run


def alike(pairs: DataFrame, nodes: DataFrame, percent: int, folder: str) -> DataFrame:
    """Distinct pairs (a, b), a > b, of heads of the pairs (id, lead) that sizes and sketches do not rule out."""

    def side(key: str, end: str) -> DataFrame:
        return nodes.select(F.col("id").alias(key), *[F.col(c).alias(f"{c}_{end}") for c in ("n", "head", "sketch")])

    both = pairs.join(side("id", "a"), "id")
    both = salted(cut(both, folder), side("lead", "b"), "lead").where("head_a <> head_b")
    found = both.select("n_a", "n_b", "head_a", "head_b", "sketch_a", "sketch_b").mapInArrow(_alike(percent), "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _compare(percent: int, one: tuple[np.ndarray, ...], two: tuple[np.ndarray, ...], apart: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (id, label, n, block, sketch) rows of different labels that sizes and sketches do not rule out."""
    order = np.argsort(two[2], kind="stable")
    ids, label, n, block, cells = (x[order] for x in two)
    step = max(1, COMPARED // max(1, cells.nbytes))
    out = []
    rows = np.argsort(one[2], kind="stable")
    for a in range(0, len(rows), step):
        i, i_label, i_n, i_block, i_cells = (x[rows[a : a + step]] for x in one)
        lo, hi = np.searchsorted(100 * n, percent * i_n[0]), np.searchsorted(percent * n, 100 * i_n[-1], side="right")
        if lo < hi:
            far = np.bitwise_count(i_cells[:, None, :] ^ cells[None, lo:hi]).sum(axis=2, dtype=np.int64)
            total = i_n[:, None] + n[None, lo:hi]
            ok = (far <= most_apart(total, percent)) & (i_label[:, None] != label[None, lo:hi])
            if apart:
                ok &= i_block[:, None] != block[None, lo:hi]
            x, y = np.nonzero(ok)
            out.append((i[x], ids[lo:hi][y]))
    return out


def _within(percent: int):
    """Pairs of members of different groups that may be similar, in units (lead, low, high) that follow each other."""

    def close(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        unit = pa.Table.from_batches(parts)
        cols = [unit[c].to_numpy().astype(np.int64) for c in ("id", "label", "n", "block")]
        apart, sketch = unit["low"][0].as_py() != unit["high"][0].as_py(), unit["sketch"].to_pylist()
        width = np.array([len(s) for s in sketch])
        found = []
        for w in np.unique(width).tolist():
            # Similar sets have sketches of one width or of two that follow each other.
            small, large = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
            mine = (*[c[small] for c in cols], _words([sketch[i] for i in small]))
            found += _compare(percent, mine, mine, apart)
            if len(large):
                found += _compare(percent, mine, (*[c[large] for c in cols], halved(_words([sketch[i] for i in large]))), apart)
        a, b = (np.concatenate([np.zeros(0, dtype=np.int64), *[f[i] for f in found]]) for i in (0, 1))
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pairs], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        unit = None
        for batch in batches:
            if not len(batch):
                continue
            key = np.stack([batch[c].to_numpy() for c in ("lead", "low", "high")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
            for x, y in zip(cuts[:-1], cuts[1:]):
                if kept and unit != tuple(key[:, x].tolist()):
                    yield close(kept)
                    kept = []
                unit = tuple(key[:, x].tolist())
                kept.append(batch.slice(x, y - x))
        if kept:
            yield close(kept)

    return run


def crossing(stars: DataFrame, pairs: DataFrame, signers: DataFrame, folder: str) -> DataFrame:
    """The rows of stars whose signature has holders in different groups, as it has if a row's own ends are.

    pairs: the distinct (id, lead) of stars, signers: (id, label). Only pairs meet labels, and bitmaps drop most other rows before the shuffle.
    """
    labels = signers.select("id", "label")
    ends = cut(pairs.join(labels, "id"), folder)
    ends = salted(ends, labels.select(F.col("id").alias("lead"), F.col("label").alias("lead_label")), "lead").where("label <> lead_label")
    ends = cut(ends.select("id", "lead", F.xxhash64("id", "lead").alias("pair")), folder)
    met = keep_likely(stars.withColumn("pair", F.xxhash64("id", "lead")), "pair", ends.select("pair")).join(ends.select("id", "lead"), ["id", "lead"], "left_semi")
    crossed = cut(met.select("sig").distinct(), folder)
    return salted(cut(keep_likely(stars, "sig", crossed), folder), crossed, "sig").select("sig", "id", "lead")


def across(stars: DataFrame, pairs: DataFrame, nodes: DataFrame, groups: DataFrame, percent: int, folder: str) -> DataFrame:
    """Distinct pairs (a, b), a > b, of heads of different groups that share signatures and may be similar.

    stars: (sig, id, lead), pairs: its distinct (id, lead), nodes: (id, head, n, sketch, need_even, need_odd), groups: (node, label). A member of different
    groups' signatures stays for the bands in which it has them in as many ranges as it must agree in. The m members of a
    lead are dealt into ceil(m / BLOCK) blocks, and every pair of blocks is a unit of about 2 * BLOCK rows at most.
    """
    signers = pairs.select("id").union(pairs.select("lead")).distinct()
    signers = cut(nodes.select("id", "head", "need_even", "need_odd").join(signers, "id", "left_semi"), folder)
    labels = groups.select(F.col("node").alias("head"), "label")
    signers = cut(salted(signers, labels, "head", "left").select("id", "head", F.coalesce("label", "head").alias("label"), "need_even", "need_odd"), folder)
    stars = cut(crossing(stars, pairs, signers, folder), folder)
    members = stars.select("sig", "id").union(stars.select("sig", F.col("lead").alias("id"))).distinct()
    members = members.join(signers, "id").select("sig", "head", "label", "need_even", "need_odd").distinct()
    members = cut(members.withColumn("parity", F.expr(PARITY)), folder)

    agreed = members.select("head", "parity", F.expr(RANGE).alias("range"), "need_even", "need_odd").distinct()
    agreed = agreed.groupBy("head", "parity").agg(F.count("*").alias("ranges"), F.max(F.when(F.col("parity") == 0, F.col("need_even")).otherwise(F.col("need_odd"))).alias("need"))
    members = cut(members.join(agreed.where("ranges >= need").select("head", "parity"), ["head", "parity"], "left_semi").select("sig", "head", "label"), folder)

    leads = members.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("head").alias("lead")).where("low <> high").select("sig", "lead")
    rows = salted(members, leads, "sig").select("lead", "head", "label").distinct()
    rows = cut(rows.join(nodes.select(F.col("id").alias("head"), "n", "sketch"), "head"), folder)
    counts = rows.groupBy("lead").agg(F.count("*").alias("m")).select("lead", F.ceil(F.col("m") / BLOCK).cast("int").alias("parts"))
    rows = salted(rows, counts, "lead").withColumn("block", F.pmod(F.xxhash64("head"), F.col("parts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("lead", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("head").alias("id"), "label", "n", "block", "sketch")
    rows = rows.repartition("lead", "low", "high").sortWithinPartitions("lead", "low", "high")
    return rows.mapInArrow(_within(percent), "a long, b long").distinct()


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_shingles, component_id) for each row of docs: links where 100 * intersection >= percent * union.

    The rows are computed at once and stand as a table in the shared folder; the working tables are deleted.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    with_id = rows.where("id is not null and text is not null")
    with workspace(spark) as folder:
        sized = cut(rows.mapInArrow(_measure(size, percent), "id long, n long, print_a long, print_b long, sketch binary, need_even int, need_odd int"), folder)
        known = sized.where("id is not null and n > 0")
        heads = known.groupBy("print_a", "print_b", "n").agg(F.min("id").alias("head"), F.max("id").alias("last")).where("head <> last").drop("last")
        alone = known.select("id", F.struct("print_a", "print_b", "n").alias("print"))
        copies = salted(alone, heads.select(F.struct("print_a", "print_b", "n").alias("print"), "head"), "print").where("id <> head")
        copies = cut(copies.groupBy("id").agg(F.min("head").alias("head")), folder)
        nodes = known.select("id", "n", "sketch", "need_even", "need_odd").dropDuplicates(["id"]).join(copies, "id", "left").withColumn("head", F.coalesce("head", "id"))
        nodes = cut(nodes, folder)

        signed = with_id.mapInArrow(_sign(size, percent), "sig long, id long, more array<long>")
        signed = signed.withColumn("top", F.min("id").over(W.partitionBy("sig"))).where("id <> top or more is not null")
        own = F.expr("if(id <> top, array(struct(id, top as lead)), array())")
        rest = F.expr("transform(coalesce(more, array()), x -> struct(x as id, id as lead))")
        stars = cut(signed.select("sig", F.explode(F.concat(own, rest)).alias("star")).select("sig", "star.id", "star.lead"), folder)

        leads = cut(stars.select("id", "lead").distinct(), folder)
        pairs = cut(alike(leads, nodes, percent, folder), folder)
        links = cut(verified(pairs, with_id, size, percent, folder), folder)
        groups = components(links, folder)
        pairs = cut(across(stars, leads, nodes, groups, percent, folder).join(pairs, ["a", "b"], "left_anti"), folder)
        more = cut(verified(pairs, with_id, size, percent, folder), folder)
        if not more.isEmpty():
            groups = components(links.union(more), folder)

        named = salted(copies, groups.select(F.col("node").alias("head"), "label"), "head", "left").select("id", F.coalesce("label", "head").alias("label"))
        named = named.union(groups.select("node", "label"))
        out = sized.select("id", "n").join(named, "id", "left")
        return cut(out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id")))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of its group, with all their columns; rows without an id stay."""
    groups = jaccard_groups(docs, size, percent, id_col, text_col)
    name = unused(docs, "gone_id")
    gone = groups.where("component_id <> " + id_col).select(F.col(id_col).cast("long").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")
