"""N-gram Jaccard join: blocked sparse products of a document by n-gram incidence.

Texts with equal shingle sets form one class from the start, so copies are never
paired.  Classes that can reach the similarity are found from hash-sampled shingles:
two linked sets share at least the fraction t of either one, so of any sample that
is drawn by hash alone they share so many that fewer would be seen in one case of
10^12; only the rarest shingles beyond that number need to be compared.  (A set of
at most SAMPLE shingles is not sampled, there the bound is the exact prefix bound.)
Classes that share such a shingle meet in its bucket.  Small groups that meet are one
block; large ones are dealt into blocks by set size, least bucket and salt, and two
blocks are paired only if members of both are in one bucket.  For every pair of blocks
a task accumulates the exact overlap counts of all their pairs as a matrix product
over the shingles that occur twice in it.  Only links that join something are emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_array, cut, group_bounds, partitions, probable_members, text_chunks, whole_groups
from .components import components
from .kernels import set_signatures, shingle_sets

#: Sets of up to so many shingles are compared whole; larger ones by samples of half to all of it.
SAMPLE = 160
#: Chance that a sample hides a linked pair is below exp(-RISK), about 10^-12.
RISK = 27.7
#: Sets in a block of the product, shingles in all its sets, and shingles in a slice of it.
BLOCK, BLOCK_SHINGLES, SLICE = 256, 1 << 22, 4096
#: Set sizes of one class differ by less than this factor, so linked sets are in one class or in neighbouring ones.
RATIO = 1.34
#: Rows of one shingle that are held to count it; longer lists all rank as this long.
LONG_LIST = 1 << 16


def _level(n: int) -> int:
    return max(0, math.ceil(math.log2(n / SAMPLE))) if n > SAMPLE else 0


@lru_cache(maxsize=1 << 16)
def least_shared(size: int, sampled: bool, percent: int) -> int:
    """Shingles of a list of this size that a linked partner has at least."""
    t = percent / 100
    if not sampled:
        return max(1, -(-size * percent // 100))
    for x in range(math.ceil(size * t) - 1, 0, -1):
        q = x / size
        if size * (q * math.log(q / t) + (1 - q) * math.log((1 - q) / (1 - t))) >= RISK:
            return x + 1
    return 1


def _measured(batches: Iterator[pa.RecordBatch], width: int, percent: int, emit: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1)):
            sets = shingle_sets(data, offsets, width)
            signs = set_signatures(sets)
            own = batch.slice(a, b - a)
            if emit == "sets":
                # of rows that repeat an id only those that have the class's set
                keep = np.flatnonzero(column_array(own, "key") == signs[:, 0].view(np.int64))
                yield pa.record_batch({"rep": own.column(0).take(pa.array(keep)), "key": pa.array(signs[keep, 0].view(np.int64)), "shingles": pa.array([sets[k].tobytes() for k in keep], pa.binary())})
                continue
            levels = [_level(len(s)) for s in sets]
            low = [s if not k else s[(s & np.uint64((1 << k) - 1)) == 0] for s, k in zip(sets, levels)]
            if emit == "samples":
                keep = np.repeat(signs[:, 0].view(np.int64), [len(x) for x in low])
                yield pa.record_batch({"h": pa.array(np.concatenate(low).view(np.int64) if low else np.zeros(0, np.int64)), "key": pa.array(keep)})
            else:
                # a set joins the next level too if a linked set can be large enough to be there
                high = [int(((x & np.uint64((2 << k) - 1)) == 0).sum()) if len(s) * 100 > percent * (SAMPLE << k) else -1 for s, x, k in zip(sets, low, levels)]
                yield pa.record_batch(
                    {"doc_id": own.column(0), "sig": pa.array([x.tobytes() for x in signs], pa.binary()), "key": pa.array(signs[:, 0].view(np.int64)), "n": pa.array([len(s) for s in sets], pa.int64()), "p0": pa.array([len(x) for x in low], pa.int32()), "p1": pa.array(high, pa.int32())}
                )


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, key, s) of shingles that two classes have; s: in how many classes, LONG_LIST at most."""
    for cols, continues, unfinished in whole_groups(batches, ["h"], LONG_LIST):
        fresh = np.ones(len(cols["h"]), bool)
        fresh[1:] = (cols["key"][1:] != cols["key"][:-1]) | (cols["h"][1:] != cols["h"][:-1])
        h, key = cols["h"][fresh], cols["key"][fresh]
        if continues or unfinished:
            # one hot shingle: it is long whatever the number of copies behind it
            yield pa.record_batch({"h": pa.array(h), "key": pa.array(key), "s": pa.array(np.full(len(h), LONG_LIST, np.int32))})
            continue
        at = group_bounds({"h": h}, ["h"])
        sizes = np.repeat(np.diff(at), np.diff(at))
        keep = sizes > 1
        if keep.any():
            yield pa.record_batch({"h": pa.array(h[keep]), "key": pa.array(key[keep]), "s": pa.array(sizes[keep].astype(np.int32))})


def _prefixes(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of each class's shared sample, rarest first, what reaches beyond least_shared."""
    for cols, _, _ in whole_groups(batches, ["rep", "key"]):
        h, level_of = cols["h"].view(np.uint64), {}
        out_h, out_row, out_level = [], [], []
        at = group_bounds(cols, ["rep", "key"])
        for a, b in zip(at[:-1], at[1:]):
            n, own = int(cols["n"][a]), h[a:b]
            if n not in level_of:
                level_of[n] = _level(n)
            k = level_of[n]
            for level, p, hs in ((k, int(cols["p0"][a]), own), (k + 1, int(cols["p1"][a]), own[(own & np.uint64((2 << k) - 1)) == 0])):
                if p > 0 and len(hs):
                    reach = p - least_shared(p, level > 0, percent) + 1 - (p - len(hs))
                    if reach > 0:
                        out_h.append(hs[:reach])
                        out_row.append(np.full(min(reach, len(hs)), a))
                        out_level.append(np.full(min(reach, len(hs)), level, np.int32))
        if out_h:
            row = np.concatenate(out_row)
            yield pa.record_batch({"h": pa.array(np.concatenate(out_h).view(np.int64)), "level": pa.array(np.concatenate(out_level)), "rep": pa.array(cols["rep"][row]), "key": pa.array(cols["key"][row])})


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from the first class of each bucket to its others."""
    first, key = None, None
    for batch in batches:
        cols = {n: column_array(batch, n) for n in ("h", "level", "rep")}
        if not len(cols["h"]):
            continue
        at = group_bounds(cols, ["h", "level"])
        heads = cols["rep"][at[:-1]].copy()
        if key == (cols["h"][0], cols["level"][0]):
            heads[0] = first
        key, first = (cols["h"][-1], cols["level"][-1]), heads[-1]
        a = np.repeat(heads, np.diff(at))
        keep = a != cols["rep"]
        if keep.any():
            pairs = np.unique(np.stack([a[keep], cols["rep"][keep]], 1), axis=0)
            yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})


def overlaps(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Exact overlap counts of every set of left with every set of right (or of left)."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets])
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(sets)), sizes)
    live = counts[inverse] > 1
    row, col = row[live], column[inverse[live]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(left), len(right) if right is not None else len(left)))
    width = int(col[-1]) + 1 if len(col) else 0
    for a in range(0, width, SLICE):
        i, j = np.searchsorted(col, [a, a + SLICE])
        dense = np.zeros((len(sets), min(SLICE, width - a)), np.float32)
        dense[row[i:j], col[i:j] - a] = 1
        head = dense[: len(left)]
        out += head @ (dense[len(left) :] if right is not None else head).T
    return out


def _products(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, key, links): how many documents class (a, key) links with in a pair of blocks (b null), and links of classes a and b that join something."""
    keys = ["one", "two"]
    for cols, _, _ in whole_groups(batches, keys):
        at = group_bounds(cols, keys)
        reps, signs, copies = cols["rep"], cols["key"], cols["copies"]
        counted, joined = [], []
        for a, b in zip(at[:-1], at[1:]):
            same = cols["one"][a] == cols["two"][a]
            side = cols["own"][a:b] == cols["one"][a]
            left, right = a + np.flatnonzero(side), a + np.flatnonzero(~side)
            if not len(left) or not (len(right) or same):
                continue
            sets = lambda rows: [np.frombuffer(cols["shingles"][r], np.uint64) for r in rows]
            both = overlaps(sets(left), None if same else sets(right))
            if same:
                right = left
            sums = cols["n"][left][:, None] + cols["n"][right][None, :]
            linked = 100 * both >= percent * (sums - both)
            if same:
                np.fill_diagonal(linked, False)
            if not linked.any():
                continue
            counted += [(r, n) for r, n in zip(left, linked @ copies[right]) if n]
            if not same:
                counted += [(r, n) for r, n in zip(right, copies[left] @ linked) if n]
            joined += [(left[i], right[j]) for i, j in _forest(linked, same)]
        if counted:
            row, n = np.array(counted, np.int64).T
            x, y = np.array(joined, np.int64).T
            none = np.concatenate([np.ones(len(row), bool), np.zeros(len(x), bool)])
            yield pa.record_batch(
                {"a": pa.array(np.concatenate([reps[row], reps[x]])), "b": pa.array(np.concatenate([reps[row], reps[y]]), mask=none), "key": pa.array(np.concatenate([signs[row], signs[x]])), "links": pa.array(np.concatenate([n, np.zeros(len(x), np.int64)]))}
            )


def _forest(linked: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges of linked that keep its components: a spanning forest."""
    rows, cols = linked.shape
    out, open_rows, open_cols = [], np.ones(rows, bool), np.ones(cols, bool)
    for start in range(rows):
        if not open_rows[start]:
            continue
        open_rows[start] = False
        if same:
            open_cols[start] = False
        todo = [(start, True)]
        while todo:
            x, is_row = todo.pop()
            near = np.flatnonzero(linked[x] & open_cols) if is_row else np.flatnonzero(linked[:, x] & open_rows)
            for y in near:
                out.append((x, y) if is_row else (y, x))
                if same:
                    open_rows[y] = open_cols[y] = False
                    todo.append((y, True))
                elif is_row:
                    open_cols[y] = False
                    todo.append((y, False))
                else:
                    open_rows[y] = False
                    todo.append((y, True))
    return out


def _buckets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(own, c, h, level): the buckets of the blocks' members, once for each block and batch."""
    for batch in batches:
        lists = batch.column(2)
        at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        level, h = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        own, c = column_array(batch, "own")[at], column_array(batch, "c")[at]
        by = np.lexsort((level, h, own))
        fresh = np.ones(len(by), bool)
        fresh[1:] = (own[by][1:] != own[by][:-1]) | (h[by][1:] != h[by][:-1]) | (level[by][1:] != level[by][:-1])
        by = by[fresh]
        yield pa.record_batch({"own": pa.array(own[by]), "c": pa.array(c[by], pa.int32()), "h": pa.array(h[by]), "level": pa.array(level[by], pa.int32())})


def _blocks(nodes: DataFrame, n: int) -> DataFrame:
    """Each class once for every pair of blocks that it has to be in: (rep, key, n, copies, own, one, two).

    A group of classes that met is one block if it is small.  A large one is dealt by
    size class, by the least bucket of a class, so that like sets stand together, and
    by a salt; its blocks are paired if they share a bucket and their sizes may match.
    """
    # small tables, fixed before they are joined, so that a hot group's rows can be split
    large = cut(nodes.groupBy("grp").agg(F.count("*").alias("members"), F.sum("n").alias("shingles")).where((F.col("members") > BLOCK) | (F.col("shingles") > BLOCK_SHINGLES)).select("grp"))
    sized = nodes.join(large, "grp").withColumn("c", F.floor(F.log("n") / math.log(RATIO)).cast("int"))
    # sets of a class hold up to RATIO^(c + 1) shingles
    room = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.pow(F.lit(RATIO), F.col("c") + 1)))).cast("int")
    parts = cut(sized.groupBy("grp", "c").agg(F.ceil(F.count("*") / room).cast("long").alias("bins")))
    binned = sized.join(parts, ["grp", "c"]).withColumn("bin", F.pmod(F.xxhash64("home"), F.col("bins")))
    salts = cut(binned.groupBy("grp", "c", "bin").agg(F.ceil(F.count("*") / room).cast("long").alias("salts")))
    columns = ["rep", "key", "n", "copies", "own"]
    dealt = cut(binned.join(salts, ["grp", "c", "bin"]).withColumn("own", F.xxhash64("grp", "c", "bin", F.pmod(F.xxhash64("rep", "key"), F.col("salts")))).select(*columns, "c", "buckets"))
    met = dealt.select("own", "c", "buckets").repartition(n, "own").mapInArrow(_buckets_of, "own long, c int, h long, level int").distinct()
    other = met.select("h", "level", F.col("own").alias("two"), F.col("c").alias("d"))
    near = met.join(other, ["h", "level"]).where((F.col("own") <= F.col("two")) & (F.abs(F.col("c") - F.col("d")) <= 1)).select(F.col("own").alias("one"), "two").distinct()
    pairs = cut(near)
    sides = pairs.select("one", "two", F.col("one").alias("own")).unionByName(pairs.where("one <> two").select("one", "two", F.col("two").alias("own")))
    small = nodes.join(large, "grp", "left_anti").select("rep", "key", "n", "copies", F.col("grp").alias("own"))
    return small.select(*columns, F.col("own").alias("one"), F.col("own").alias("two")).unionByName(dealt.select(*columns).join(sides, "own").select(*columns, "one", "two"))


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """One row per document: id, n_shingles, component_id, n_links.

    Words are runs of other than space and \\t\\n\\v\\f\\r, A-Z folded.  A set holds the
    distinct width-word shingles, the whole sequence if there are fewer words, nothing
    without words or text.  Two documents link when 100 * intersection >= percent *
    union; empty sets link with nothing.  component_id is the smallest id reachable
    by links, the document itself included; n_links counts linked documents, copies
    included.  A row without an id is compared with nothing: its component_id is null
    and it has no links; repeated rows are copies of each other; rows with one id but
    unlike texts are one document as far as reach goes; other columns are ignored.
    Size classes and samples reach as far as 75 percent needs; a lower percent is an error.
    """
    if percent < 75:
        raise ValueError(f"percent {percent} is under 75, for which links of sets of unlike sizes would be lost")
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    n = partitions(docs)

    def measured(emit: str, schema: str, of: DataFrame = source) -> DataFrame:
        return of.mapInArrow(lambda batches: _measured(batches, width, percent, emit), schema)

    sets = cut(measured("sizes", "doc_id long, sig binary, key long, n long, p0 int, p1 int"))
    classes = cut(sets.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("key", "n", "p0", "p1")]))

    samples = measured("samples", "h long, key long").repartition(n, "h").sortWithinPartitions("h", "key")
    shared = samples.mapInArrow(_shared, "h long, key long, s int")
    ranked = shared.join(classes.select("key", "rep", "n", "p0", "p1"), "key").repartition(n, "rep", "key").sortWithinPartitions("rep", "key", "s", "h")
    prefixes = cut(ranked.mapInArrow(lambda b: _prefixes(b, percent), "h long, level int, rep long, key long"))
    stars = prefixes.repartition(n, "h", "level").sortWithinPartitions("h", "level", "rep").mapInArrow(_stars, "a long, b long").distinct()

    groups = components(cut(stars)).select(F.col("node").alias("rep"), F.col("label").alias("grp"))
    homes = prefixes.groupBy("rep", "key").agg(F.collect_list(F.struct("level", "h")).alias("buckets")).withColumn("home", F.array_min("buckets"))
    nodes = cut(groups.join(classes.select("rep", "key", "copies", "n"), "rep").join(homes, ["rep", "key"]))
    reps = nodes.select(F.col("rep").alias("doc_id"), "key")
    # an inner join: a semi join would be moved below the filter
    texts = probable_members(source, reps, "doc_id").join(reps, "doc_id")
    found = measured("sets", "rep long, key long, shingles binary", texts).dropDuplicates(["rep", "key"])
    products = _blocks(nodes, n).join(found, ["rep", "key"])
    links = cut(products.repartition(n, "one", "two").sortWithinPartitions("one", "two").mapInArrow(lambda b: _products(b, percent), "a long, b long, key long, links long"))

    joined = components(links.where("b is not null and a <> b").select("a", "b")).select(F.col("node").alias("rep"), F.col("label").alias("component_id"))
    partners = links.where("b is null").groupBy(F.col("a").alias("rep"), "key").agg(F.sum("links").alias("links"))
    by_class = classes.join(joined, "rep", "left").join(partners, ["rep", "key"], "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return sets.join(by_class, (sets.sig == by_class.sig) & sets.doc_id.isNotNull(), "left").select(
        F.col("doc_id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
