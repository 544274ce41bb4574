"""Vector similarity and average-linkage grouping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions.text import col


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 if a side has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / F.nullif(norm, F.lit(0.0))).otherwise(0.0)


#: Vectors in a tile; a task holds two tiles and the cosines of all their pairs.
TILE = 512


def cosine_pairs(vectors: DataFrame, block: list[str], key: str, vector: str) -> DataFrame:
    """Cosine of all pairs within a block, a the smaller key; rows without a block or a key have none.

    The pairs grow with the square of a block.  Its vectors are dealt into tiles, and
    each two tiles are a group of their own, so that no task has a whole block.
    """
    rows = vectors.select(*block, F.col(key).alias("a"), F.col(vector).cast("array<double>").alias("va")).dropna(subset=[*block, "a"])
    counts = rows.groupBy(*block).agg(F.ceil(F.count("*") / TILE).cast("int").alias("__tiles"))
    dealt = (rows.join(counts, block) if block else rows.crossJoin(counts)).withColumn("__own", F.pmod(F.xxhash64("a", "va"), "__tiles").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__tiles") - 1))
    sides = dealt.withColumn("__other", other).select(*block, "a", "va", "__own", F.least("__own", "__other").alias("__one"), F.greatest("__own", "__other").alias("__two"))

    def group(rows: pa.Table) -> pa.Table:
        return _tile_cosines(rows.combine_chunks(), block)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in block) + ", " * bool(block) + f"a {kinds['a']}, b {kinds['a']}, cosine double"
    # a number of partitions, as tiles that are few MB make many pairs
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sides.repartition(n, *block, "__one", "__two").groupBy(*block, "__one", "__two").applyInArrow(group, schema)


def _tile_cosines(rows: pa.Table, block: list[str]) -> pa.Table:
    """The pairs of two tiles, or of one with itself."""
    code = pc.rank(rows.column("a"), tiebreaker="dense").to_numpy().astype(np.int64)
    own, one, two = (rows.column(c).to_numpy() for c in ("__own", "__one", "__two"))
    lists = rows.column("va").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    left = np.flatnonzero(own == one[0])
    right = left if one[0] == two[0] else np.flatnonzero(own == two[0])
    firsts, seconds, cosines, none = [], [], [], []
    for p in np.unique(sizes[left]):
        for q in np.unique(sizes[right]):
            # vectors of unlike lengths have no cosine, but for those without length
            width = int(min(p, q))
            of = [(k, *_padded(lists, k)) for k in (left[sizes[left] == p], right[sizes[right] == q])]
            (r, x, x2, xn), (s, y, y2, yn) = of
            for at in range(0, len(r), 128):
                i = r[at : at + 128]
                dot = np.zeros((len(i), len(s)))
                part = np.empty_like(dot)
                with np.errstate(all="ignore"):
                    for k in range(width):  # number by number, so that a sum is that of SQL
                        dot += np.multiply(x[at : at + 128, k, None], y[None, :, k], out=part)
                    norm = np.sqrt(x2[at : at + 128, None] * y2[None, :])
                    some = ~((norm <= 0) | xn[at : at + 128, None] | yn[None, :])
                    cosine = np.where(some, dot / np.where(some, norm, 1), 0.0)
                u, v = np.nonzero(code[i][:, None] < code[s][None, :] if right is left else code[i][:, None] != code[s][None, :])
                a, b = i[u], s[v]
                swap = code[a] > code[b]
                firsts.append(np.where(swap, b, a))
                seconds.append(np.where(swap, a, b))
                cosines.append(cosine[u, v])
                none.append(some[u, v] if p != q else np.zeros(len(a), bool))
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
    columns = {c: rows.column(c).take(pa.array(a)) for c in block} | {"a": rows.column("a").take(pa.array(a)), "b": rows.column("a").take(pa.array(b))}
    cosine = pa.array(np.concatenate(cosines), mask=np.concatenate(none)) if cosines else pa.array([], pa.float64())
    return pa.table(columns | {"cosine": cosine})


def _padded(lists: pa.ListArray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of one length, their own dot products, and which have none (null, or with a null in them)."""
    own = lists.take(pa.array(rows))
    flat, n = own.flatten(), len(rows)
    width = len(flat) // n if n else 0
    x = flat.to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
    unknown = own.is_null().to_numpy(zero_copy_only=False) | flat.is_null().to_numpy(zero_copy_only=False).reshape(n, width).any(axis=1)
    square = np.zeros(n)
    with np.errstate(all="ignore"):
        for k in range(width):
            square += x[:, k] * x[:, k]
    return x, square, unknown


def average_linkage(matrix: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of agglomerative clustering by mean distance, merging up to and without the threshold.

    The nearest pair merges first, ties by the smaller index; labels follow first appearance.
    """
    n = len(matrix)
    d = matrix.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    while n > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if not d[i, j] < threshold:
            break
        i, j = min(i, j), max(i, j)
        merged = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        owner[owner == j] = i
    _, first, inverse = np.unique(owner, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def average_linkage_of(x: np.ndarray, threshold: float) -> np.ndarray:
    """average_linkage by cosine distance of rows of length 1 (or 0), with no matrix of distances.

    The mean distance of two clusters is that of their rows' sums, so memory is that of
    the rows.  Each cluster knows its nearest one of those after it; a merger makes no
    cluster come nearer, so what was known stays a lower bound until it is the least.
    Distances count to 12 digits, so that equal ones are ties; unknown ones are infinite.
    """
    n = len(x)
    sums, size, owner = x.astype(float).copy(), np.ones(n), np.arange(n)
    live, stale = np.ones(n, bool), np.zeros(n, bool)
    near, least = np.zeros(n, np.int64), np.full(n, np.inf)

    def rounded(d: np.ndarray) -> np.ndarray:
        return np.nan_to_num(np.round(d, 12), nan=np.inf, posinf=np.inf)

    def look(i: int) -> None:
        stale[i], least[i] = False, np.inf
        if i + 1 < n:
            d = rounded(1 - sums[i + 1 :] @ sums[i] / (size[i + 1 :] * size[i]))
            d[~live[i + 1 :]] = np.inf
            near[i] = i + 1 + int(np.argmin(d))
            least[i] = d[near[i] - i - 1]

    for a in range(0, n, 256):
        d = rounded(1 - sums[a : a + 256] @ sums[a:].T)
        d[np.tril_indices(len(d), 0, d.shape[1])] = np.inf
        near[a : a + 256] = a + np.argmin(d, axis=1)
        least[a : a + 256] = d.min(axis=1)
    while n > 1:
        i = int(np.argmin(least))
        if not least[i] < threshold:
            break
        if stale[i]:
            look(i)
            continue
        j = int(near[i])
        sums[i] += sums[j]
        size[i] += size[j]
        live[j], least[j] = False, np.inf
        owner[owner == j] = i
        stale[:j] |= (near[:j] == i) | (near[:j] == j)
        look(i)
    _, first, inverse = np.unique(owner, return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[inverse]


def linkage_groups(vectors: DataFrame, block: list[str], key: str, vector: str, threshold: float = 0.5) -> DataFrame:
    """block, key, cluster_id: average linkage by cosine distance within each block.

    A block is one task; its memory grows with its rows, its time with their square.
    Null vectors, like those of length 0, are as far from all others as unlike ones.
    """

    def group(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by(key).combine_chunks()
        x = _matrix(rows.column(vector), pc.max(pc.list_value_length(rows.column(vector))).as_py() or 0)
        norm = np.linalg.norm(x, axis=1)
        x = x / np.where(norm > 0, norm, 1)[:, None]
        return rows.select([*block, key]).append_column("cluster_id", pa.array(average_linkage_of(x, threshold), pa.int64()))

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    schema = ", ".join(f"{c} {kinds[c]}" for c in [*block, key]) + ", cluster_id long"
    return vectors.select(*block, key, vector).groupBy(*block).applyInArrow(group, schema)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows; null and empty ones are 0.  Vectors of another width are an error."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    if not np.isin(sizes, (0, width)).all():
        raise ValueError(f"vectors of {sorted(set(sizes.tolist()) - {0})} numbers can't be compared")
    out = np.zeros((len(column), width))
    out[sizes > 0] = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width) if width else 0
    return out
