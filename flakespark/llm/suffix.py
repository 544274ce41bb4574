"""Suffix-array deduplication of repeated byte strings across documents.

A repeated string of `length` bytes has the same smallest k-gram hashes wherever it
stands (winnowing), so every repeat shares an anchor at the same place in the string.
Anchors that two documents have send the bytes around them to a shard of their own.
In a shard a suffix array is refined by Larsson and Sadakane's doubling, Kasai's
predecessors give the common prefixes, and runs of equal strings mark all but those
of the smallest document.  A hot anchor is dealt to many shards, by chunks of
documents and then by pieces; each shard marks what it can, and the strings of its own
smallest documents go on to be merged with those of the other shards, sorted by a
128-bit key, in which every string finds its smallest document by binary search.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column_array, cut, group_bounds, partitions, probable_members, text_pieces, whole_groups
from .kernels import mix, span_hashes, window_hashes

#: Width of the hashed grams of which the smallest in a string is its anchor.
GRAM = 20
#: Segments of one anchor in a piece of its shard.
PIECE = 8192
#: An anchor that so many documents of one chunk of text have is hot: the chunk's go to one of several shards, SHARDS at least.
HOT, SHARDS = 32, 16
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: 48 bits of a gram's hash travel; two grams that share them only cost a comparison.
_SHORT = np.uint64(0xFFFFFFFFFFFF)


def _rolling(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over every width-wide window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that are the smallest of some string of `length` bytes, and every string's smallest."""
    gram = min(GRAM, length)
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    hashes = window_hashes(data, gram) & _SHORT
    # grams across the end of a row count for nothing
    for k in range(1, gram):
        over = offsets[1:-1] - k
        hashes[over[(over >= 0) & (over < len(hashes))]] = _NONE
    width = length - gram + 1
    least = _rolling(hashes, width, np.minimum)
    # a gram is an anchor if it equals the largest of the minima of the windows that hold it
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    chosen = np.flatnonzero((hashes == _rolling(padded, width, np.maximum)) & (hashes != _NONE))
    return chosen, hashes[chosen], least


def spans(pos: np.ndarray, h: np.ndarray, least: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last start of the strings whose smallest gram is at pos."""
    reach = length - min(GRAM, length)
    first, last = pos.copy(), pos - reach
    for back in range(reach, -1, -1):
        start = pos - back
        own = (start >= 0) & (start < len(least))
        own[own] = least[start[own]] == h[own]
        first = np.where(own, np.minimum(first, start), first)
        last = np.where(own, start, last)
    return first, last


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their next `depth` bytes at least (0 stands after the end).

    The first order is by eight bytes; each round then sorts only the groups that are
    still tied, by the ranks of the positions as far ahead as is sorted already.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | padded[k : k + n]
    order = np.argsort(key)
    ranked = key[order]
    head = np.ones(n, bool)
    head[1:] = ranked[1:] != ranked[:-1]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    ahead = 8
    while ahead < depth:
        # members of groups of two and more, in the present order
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        pos = order[at]
        nxt = np.where(pos + ahead < n, rank[np.minimum(pos + ahead, n - 1)] + 1, 0)
        compound = rank[pos] * (n + 1) + nxt
        inner = np.argsort(compound)
        order[at] = pos[inner]
        compound = compound[inner]
        head[at[1:]] = (compound[1:] != compound[:-1]) | head[at[1:]]
        head[0] = True
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[order[at]] = group[at]
        ahead *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For each place in order, the bytes (up to limit) shared with the suffix before it.

    Kasai's predecessor of every position, walked in the order of the text; all
    positions extend at once, and drop out at their first difference.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([data, np.zeros(limit, np.uint8)])
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    for k in range(limit):
        here = live + k
        there = before[live] + k
        live = live[(padded[here] == padded[there]) & (here < n) & (there < n)]
        if not len(live):
            break
        shared[live] += 1
    return shared[order]


def _starts(batches: Iterator[pa.RecordBatch], length: int, hot: int = HOT, shards: int = SHARDS) -> Iterator[pa.RecordBatch]:
    """(h, shard, doc_id, mark) of the anchors of every document, once each.

    Shard 0 is that of all documents.  The documents of a chunk in which the anchor is
    hot go to another one together; one marked row tells shard 0 of them.
    """
    for batch in batches:
        ids = column_array(batch, "doc_id")
        for a, b, _, data, offsets in text_pieces(batch.column(1), length - 1):
            pos, h, _ = anchors(data, offsets, length)
            row = np.searchsorted(offsets, pos, "right") - 1
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            fresh = np.ones(len(h), bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            h, row = h[fresh], row[fresh]
            at = group_bounds({"h": h}, ["h"]) if len(h) else np.zeros(1, np.int64)
            count = np.diff(at)
            many = count >= hot
            shard = 1 + int(mix(ids[a : a + 1].astype(np.int64).view(np.uint64))[0] % np.uint64(shards))
            marked = h[at[:-1][many]]
            none = np.zeros(len(marked), np.int64)
            yield pa.record_batch(
                {
                    "h": pa.array(np.concatenate([h, marked]).view(np.int64)),
                    "shard": pa.array(np.concatenate([np.repeat(many * shard, count), none]).astype(np.int32)),
                    "doc_id": pa.array(np.concatenate([ids[a:b][row], none]), pa.int64()),
                    "mark": pa.array(np.concatenate([np.zeros(len(h), bool), np.ones(len(marked), bool)])),
                }
            )


def _met(batches: Iterator[pa.RecordBatch], piece: int) -> Iterator[pa.RecordBatch]:
    """(h, part, doc_id) of the rows, sorted by (h, shard, doc_id), whose anchor at least two documents have.

    Part 0 holds all of an anchor's documents; other parts, of up to piece rows, do not.
    """
    number = 0
    for cols, continues, unfinished in whole_groups(batches, ["h", "shard"], piece):
        h, ids, part = cols["h"], cols["doc_id"], cols["shard"].astype(np.int64) << 32
        if continues or unfinished:
            number = number + 1 if continues else 1
            keep, part = ~cols["mark"], part + number
        else:
            at = group_bounds(cols, ["h", "shard"])
            sizes = np.diff(at)
            marked = np.repeat(np.maximum.reduceat(cols["mark"], at[:-1]), sizes)
            part = part + marked
            keep = (np.repeat(ids[at[:-1]] != ids[at[1:] - 1], sizes) | marked | (part != 0)) & ~cols["mark"]
        if keep.any():
            yield pa.record_batch({"h": pa.array(h[keep]), "part": pa.array(part[keep]), "doc_id": pa.array(ids[keep], pa.int64())})


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the strings that a shared anchor stands for; what repeats in a document comes once, with its further starts in `more`."""
    for batch in batches:
        ids = column_array(batch, "doc_id")
        names = batch.schema.names
        wanted = batch.column(names.index("wanted"))
        ends = wanted.offsets.to_numpy()
        hashes, parts = (wanted.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for a, b, place, data, offsets in text_pieces(batch.column(names.index("text")), length - 1):
            pos, h, least = anchors(data, offsets, length)
            row = np.searchsorted(offsets, pos, "right") - 1
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            part = np.full(len(pos), -1, np.int64)
            for k in range(b - a):
                i, j = cuts[k], cuts[k + 1]
                if i < j:
                    own = hashes[ends[a + k] : ends[a + k + 1]]
                    by = np.argsort(own, kind="stable")
                    mine = h[i:j].view(np.int64)
                    there = by[np.minimum(np.searchsorted(own[by], mine), len(by) - 1)]
                    part[i:j] = np.where(own[there] == mine, parts[ends[a + k] + there], -1)
            keep = part >= 0
            pos, h, row, part = pos[keep], h[keep], row[keep], part[keep]
            first, last = spans(pos, h, least, length)
            low = np.maximum(first, offsets[row])
            high = np.minimum(last + length, offsets[row + 1])
            fits = high - low >= length
            low, high, row, h, part = low[fits], high[fits], row[fits], h[fits], part[fits]
            raw = data.tobytes()
            texts, start = [raw[i:j] for i, j in zip(low, high)], low - offsets[row] + place
            once, more = _once(row, h, start, texts)
            yield pa.record_batch(
                {"h": pa.array(h[once].view(np.int64)), "part": pa.array(part[once]), "doc_id": pa.array(ids[a:b][row[once]], pa.int64()), "start": pa.array(start[once]), "bytes": pa.array([texts[k] for k in once], pa.binary()), "more": pa.array([more.get(k) for k in once.tolist()], pa.binary())}
            )


def _once(row: np.ndarray, h: np.ndarray, start: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, dict[int, bytes]]:
    """The places of segments that are the first of their kind in a row, and, as bytes, the starts of the later ones."""
    by = np.lexsort((h, row))
    equal = np.zeros(len(by) + 1, bool)
    equal[1:-1] = (row[by][1:] == row[by][:-1]) & (h[by][1:] == h[by][:-1])
    keep, groups = np.ones(len(by), bool), {}
    for k in np.sort(by[equal[:-1] | equal[1:]]).tolist():
        own = groups.setdefault((int(row[k]), texts[k]), [])
        own.append(k)
        keep[k] = len(own) == 1
    return np.flatnonzero(keep), {own[0]: start[own[1:]].astype(np.int64).tobytes() for own in groups.values() if len(own) > 1}


def _equal_strings(data: np.ndarray, begins: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions with `length` bytes left in their segment, in suffix order, and the group of equal strings of each."""
    order = suffix_array(data, length)
    shared = common_prefixes(data, order, length)
    left = np.repeat(begins[1:], np.diff(begins)) - np.arange(len(data))
    group = np.cumsum(shared < length)
    whole = left[order] >= length
    return order[whole], group[whole]


#: Salts of the two halves of a string's key.
_HALVES = (0x3C6EF372FE94F82B, 0x1F83D9ABFB41BD6B)


def _marks(batches: Iterator[pa.RecordBatch], length: int, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, stop) of byte runs that an earlier document has; rows are sorted by (h, part, doc_id).

    Of a hot anchor's piece, the strings of the piece's own smallest documents come
    too, each with its key: whether another piece has a smaller document is left open.
    """
    for cols, continues, unfinished in whole_groups(batches, ["h", "part"], piece):
        ids, start, h = cols["doc_id"], cols["start"], cols["h"]
        # equal segments of an anchor's part stand once in the array, for their smallest document
        number: dict[tuple[int, int, bytes], int] = {}
        kind = np.array([number.setdefault(x, len(number)) for x in zip(h.tolist(), cols["part"].tolist(), cols["bytes"])], np.int64)
        texts = [x for *_, x in number]
        sizes = np.array([len(x) for x in texts], np.int64)
        rep = np.unique(kind, return_index=True)[1]
        open_end = (cols["part"] != 0) | continues | unfinished
        # a part with one segment needs no sorting: its strings are equal throughout
        bounds = group_bounds(cols, ["h", "part"])
        of = np.searchsorted(bounds, rep, "right") - 1
        several = np.bincount(of)[of] > 1
        own_doc = ids[rep]
        strings_of = sizes - length + 1
        at = np.concatenate([[0], np.cumsum(strings_of)])
        least = np.repeat(own_doc, strings_of)
        if several.any():
            chosen = np.flatnonzero(several)
            begins = np.concatenate([[0], np.cumsum(sizes[chosen])])
            data = np.frombuffer(b"".join(texts[k] for k in chosen), np.uint8)
            pos, group = _equal_strings(data, begins, length)
            row = np.searchsorted(begins, pos, "right") - 1
            # strings of unlike anchors are unlike, those of unlike parts of one anchor are kept apart
            by = np.lexsort((of[chosen[row]], group))
            pos, row, group = pos[by], row[by], group[by]
            owner = of[chosen[row]]
            heads = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])]))
            lowest = np.minimum.reduceat(own_doc[chosen[row]], heads)
            least[at[chosen[row]] + pos - begins[row]] = np.repeat(lowest, np.diff(np.append(heads, len(pos))))
        # every row's strings, against the smallest document that has them
        count = strings_of[kind]
        row = np.repeat(np.arange(len(ids)), count)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        smallest = least[at[kind[row]] + inner]
        later = ids[row] > smallest
        further = {k: np.frombuffer(cols["more"][k], np.int64) for k in np.flatnonzero(cols["more"] != None)}  # noqa: E711  in each place
        if later.any():
            # runs of such strings in a row, for each of the row's starts
            edge = np.concatenate([[True], row[1:] != row[:-1]])
            first = np.flatnonzero(later & (edge | ~np.concatenate([[False], later[:-1]])))
            last = np.flatnonzero(later & np.concatenate([edge[1:] | ~later[1:], [True]]))
            at_run, begins = _at_all_starts(row[first], inner[first], start, further)
            doc, stops = ids[row[first]][at_run], begins + (inner[last] - inner[first] + length)[at_run]
            by = np.lexsort((begins, doc))
            doc, begin, stop = _merged(doc[by], begins[by], stops[by])
            none = [pa.nulls(len(doc), pa.int64())] * 2 + [pa.nulls(len(doc), pa.binary())]
            yield pa.record_batch([pa.array(doc), pa.array(begin), pa.array(stop), *none], names=_MARK_NAMES)
        undecided = np.flatnonzero(~later & open_end[row])
        if len(undecided):
            ends = np.concatenate([[0], np.cumsum(sizes)])
            own, shift = row[undecided], inner[undecided]
            data, pos = np.frombuffer(b"".join(texts), np.uint8), ends[kind[own]] + shift
            halves = [span_hashes(data, pos, pos + length, salt).view(np.int64) for salt in _HALVES]
            more = pa.array([(further[r] + k).tobytes() if r in further else None for r, k in zip(own.tolist(), shift.tolist())], pa.binary())
            yield pa.record_batch([*[pa.array(x) for x in (ids[own], start[own] + shift, start[own] + shift + length, *halves)], more], names=_MARK_NAMES)


def _at_all_starts(row: np.ndarray, shift: np.ndarray, start: np.ndarray, further: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each (row, shift) at every start of the row: its number and the place."""
    more = [k for k, r in enumerate(row.tolist()) if r in further] if further else []
    parts = [further[row[k]] + shift[k] for k in more]
    return np.concatenate([np.arange(len(row)), np.repeat(np.array(more, np.int64), [len(x) for x in parts])]), np.concatenate([start[row] + shift, *parts])


_MARK_NAMES = ["doc_id", "start", "stop", "k1", "k2", "more"]


def _across_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of strings sorted by (key, doc_id), those that a smaller document of another shard has."""
    key, smallest = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: column_array(batch, n) for n in _MARK_NAMES}
        at = group_bounds(cols, ["k1", "k2"])
        lowest = cols["doc_id"][at[:-1]].copy()
        if key == (cols["k1"][0], cols["k2"][0]):
            lowest[0] = smallest
        key, smallest = (cols["k1"][-1], cols["k2"][-1]), lowest[-1]
        later = cols["doc_id"] > lowest[np.searchsorted(at, np.arange(batch.num_rows), "right") - 1]
        if later.any():
            width = int(cols["stop"][0] - cols["start"][0])
            starts = [np.concatenate([cols["start"][k : k + 1], np.frombuffer(cols["more"][k] or b"", np.int64)]) for k in np.flatnonzero(later)]
            begin, doc = np.concatenate(starts), np.repeat(cols["doc_id"][later], [len(x) for x in starts])
            by = np.lexsort((begin, doc))
            yield pa.record_batch(dict(zip(_MARK_NAMES, map(pa.array, _merged(doc[by], begin[by], begin[by] + width)))))


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of touching runs, sorted by (doc, start)."""
    fresh = np.ones(len(doc), bool)
    fresh[1:] = doc[1:] != doc[:-1]
    # places of unlike documents are set apart, so that one running maximum serves all
    apart = np.cumsum(fresh) * (int(stop.max()) + 1 if len(stop) else 1)
    reach = np.maximum.accumulate(stop + apart) - apart
    head = fresh.copy()
    head[1:] |= start[1:] > reach[:-1]
    at = np.flatnonzero(head)
    return doc[at], start[at], reach[np.concatenate([at[1:], [len(doc)]]) - 1]


def _kept(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.schema.names
        runs = batch.column(names.index("runs"))
        ends = runs.offsets.to_numpy()
        flat = runs.values
        starts, stops = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        removed, spans, shas, texts = [], [], [], []
        for k, text in enumerate(batch.column(names.index("text")).to_pylist()):
            raw = (text or "").encode()
            a, b = ends[k], ends[k + 1]
            by = np.argsort(starts[a:b], kind="stable")
            gone = np.zeros(len(raw) + 1, np.int64)
            np.add.at(gone, starts[a:b][by], 1)
            np.add.at(gone, stops[a:b][by], -1)
            covered = np.cumsum(gone)[:-1] > 0
            left = np.frombuffer(raw, np.uint8)[~covered].tobytes()
            removed.append(int(covered.sum()))
            spans.append(int((covered & ~np.concatenate([[False], covered[:-1]])).sum()))
            shas.append(hashlib.sha256(left).hexdigest())
            if with_text:
                # a cut through a character leaves bytes that no text can hold
                texts.append(left.decode("utf-8", "ignore"))
        out = {"doc_id": batch.column(names.index("doc_id")), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        if with_text:
            out["kept_text"] = pa.array(texts, pa.string())
        yield pa.record_batch(out)


def suffix_dedup(docs: DataFrame, length: int = 50, with_text: bool = False, id_column: str = "doc_id", text_column: str = "text", piece: int = PIECE, hot: int = HOT) -> DataFrame:
    """Remove every byte covered by a `length`-byte string that starts in a smaller document too.

    Returns id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the
    bytes left, one row for each input row; with_text adds kept_text, the bytes left
    as text (parts of cut characters go).  Null text is empty; strings never cross
    documents and are judged on the input.  Rows that repeat a doc_id are the same
    document (and have its text) and do not clean each other by that; a row without an id is kept whole
    and cleans nothing.  Shorter texts than length stay.  Other columns are ignored.
    Of an anchor's segments no task holds more than piece, and hot (documents of a
    chunk) tells when they are dealt to shards; neither changes the result.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    n = partitions(docs)
    shards = max(SHARDS, n // 4)
    facts = cut(source.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    # copies of a whole text: all but the smallest doc_id lose every byte, and need no search
    # fixed before the join, which can then split the rows of one text
    least = cut(facts.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most"))
    copies = cut(facts.join(least, "sha").where(f"doc_id > least and n_bytes >= {length}").select("doc_id").distinct())

    texts = source.where("doc_id is not null").select("doc_id", "text")
    starts = texts.mapInArrow(lambda b: _starts(b, length, hot, shards), "h long, shard int, doc_id long, mark boolean")
    met = starts.repartition(n, "h", "shard").sortWithinPartitions("h", "shard", "doc_id").mapInArrow(lambda b: _met(b, 8 * piece), "h long, part long, doc_id long")
    wanted = cut(met.join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_list(F.struct("h", "part")).alias("wanted")))

    near = probable_members(texts, wanted, "doc_id").join(wanted, "doc_id")
    segments = near.select("doc_id", "text", "wanted").mapInArrow(lambda b: _segments(b, length), "h long, part long, doc_id long, start long, bytes binary, more binary")
    marks = cut(segments.repartition(n, "h", "part").sortWithinPartitions("h", "part", "doc_id").mapInArrow(lambda b: _marks(b, length, piece), "doc_id long, start long, stop long, k1 long, k2 long, more binary"))
    open_strings = marks.where("k1 is not null").repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "doc_id")
    across = open_strings.mapInArrow(_across_shards, "doc_id long, start long, stop long")
    runs = cut(marks.where("k1 is null").select("doc_id", "start", "stop").unionByName(across).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("runs")))

    more = ", kept_text string" if with_text else ""
    cleaned = probable_members(texts, runs, "doc_id").join(runs, "doc_id").mapInArrow(lambda b: _kept(b, with_text), "doc_id long, n_removed long, n_spans long, kept_sha256 string" + more).dropDuplicates(["doc_id"])
    whole, sha = F.sha2(F.lit(""), 256), F.lower(F.hex("sha"))
    gone = copies.withColumn("gone", F.lit(True))
    out = facts.join(gone, "doc_id", "left").join(cleaned, "doc_id", "left").select(
        F.col("doc_id").alias(id_column),
        "n_bytes",
        F.when(F.col("gone"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("gone"), 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("gone"), whole).otherwise(F.coalesce("kept_sha256", sha)).alias("kept_sha256"),
        *(["kept_text"] if with_text else []),
    )
    return out
