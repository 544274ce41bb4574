"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are words and their first bytes (PREFIXES), as hashes, with weights
(1 + log count) * log(1 + rows / (1 + rows with the term)) * log2(2 + labelled / other
sampled texts with the term): TF-IDF times the relevance frequency, whose factor is 1
at least, so that the label raises terms but leaves none out.  The vocabulary is every
term of at least TERM_ROWS sampled texts, whatever their labels; document frequencies
come from all documents.  The index holds the vectors of all sampled texts, in sections
of like ones; rare terms are summed from postings, a section's common ones by products
with its table, and only if one of its blocks can still beat a query's k-th hit.
"""

from __future__ import annotations

import atexit
import hashlib
import os
import pickle
import re
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column_array, cut, ensure_checkpoint_dir, text_chunks
from .kernels import LOWER, span_hashes, word_spans

#: Bounds of the model: labelled rows that are read, terms that are kept (those of most rows), rows that a term needs.
SAMPLE_ROWS, TERMS, TERM_ROWS = 20000, 1 << 19, 4
PREFIXES = (4, 5, 6, 7)
#: Neighbours that vote, examples in a block, weight of the base rate in a vote.
NEIGHBOURS, BLOCK, PRIOR = 16, 64, 2.0
#: Terms of a section at most whose weights stand in its dense float32 table, the share of its examples that such a term
#: needs, queries that are searched together, and postings that are summed at a time (they fit a core's cache).
COMMON, SHARE, QUERIES, POSTINGS = 4096, 0.12, 384, 1 << 16
#: Sections of the index at most, examples that one has on average at least, and terms by which examples are sorted into them.
SECTIONS, SECTION, SORTING = 8, 1024, 1024
#: What float32 sums of postings may be off by, as a part of themselves: no weight is below 0, so n additions are off by
#: n / 2^24 at most, and postings' weights by 2^-12.
SLACK = 1e-3
#: Bytes of text whose terms are counted at a time.
PIECE = 1 << 17
#: A posting is 32 bits: an example's place above 17 bits of its float32 weight, 5 of the exponent and 12 of the
#: mantissa.  Weights are scaled so that those are the float's bits above SHORT and those above them are 0.
PLACES, SHORT, SCALE = 1 << 15, 11, 2.0**-96


def row_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of every word and prefix."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, terms = [row], [span_hashes(data, starts, ends)]
    for k in PREFIXES:
        longer = ends - starts > k
        rows.append(row[longer])
        terms.append(span_hashes(data, starts[longer], starts[longer] + k) ^ np.uint64(k))
    return np.concatenate(rows), np.concatenate(terms)


def _distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        label = column_array(batch, "label")
        for a, b, data, offsets in text_chunks(batch.column(1)):
            row, term = row_terms(data, offsets)
            by = np.lexsort((row, term))
            row, term = row[by], term[by]
            fresh = np.ones(len(row), bool)
            fresh[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
            row, term = row[fresh], term[fresh]
            head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
            if len(head):
                yield pa.record_batch({"term": pa.array(term[head].view(np.int64)), "n": pa.array(np.diff(np.append(head, len(term)))), "hits": pa.array(np.add.reduceat(label[a:b][row].astype(np.int64), head))})


class Lookup:
    """Numbers of a sorted vocabulary's terms: their leading bits name a bucket of less than one term on average."""

    def __init__(self, vocabulary: np.ndarray):
        self.prefixes: np.ndarray | None = None
        self.vocabulary, bits = vocabulary, max(1, len(vocabulary).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        self.starts = np.append(np.searchsorted(vocabulary, np.arange(1 << bits, dtype=np.uint64) << self.shift), len(vocabulary))

    def words(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A row of the words' numbers, then one for each of PREFIXES; -1 where there is no such term.

        A known word's prefixes are looked up when it is first met.
        """
        if self.prefixes is None:
            self.prefixes = np.full((len(PREFIXES), len(self.vocabulary) + 1), -2, np.int32)  # the last is for unknown words
        word = self.find(span_hashes(text, starts, ends))
        out = np.concatenate([word[None], self.prefixes.take(word, axis=1, mode="wrap")])
        new = np.flatnonzero(out[1] == -2)
        out[1:, new] = -1
        for row, k in zip(out[1:], PREFIXES):
            longer = new[ends[new] - starts[new] > k]
            row[longer] = self.find(span_hashes(text, starts[longer], starts[longer] + k) ^ np.uint64(k))
        met = new[word[new] >= 0]
        self.prefixes[:, word[met]] = out[1:, met]
        return out

    def find(self, term: np.ndarray) -> np.ndarray:
        """-1 where the vocabulary has no such term."""
        out, bucket = np.full(len(term), -1, np.int64), (term >> self.shift).astype(np.int64)
        at, stop = self.starts[bucket], self.starts[bucket + 1]
        live = np.flatnonzero(at < stop)
        while len(live):
            hit = self.vocabulary[at[live]] == term[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
            live = live[at[live] < stop[live]]
        return out


def _counted(data: np.ndarray, offsets: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term number, count) of the vocabulary's terms, sorted; terms are those of row_terms."""
    size, pairs, counts, a = np.int64(len(lookup.vocabulary) or 1), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while a < len(offsets) - 1:  # some rows at a time, as all terms are many times the text
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        text = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = word_spans(text, offsets[a : b + 1] - offsets[a])
        number = lookup.words(text, starts, ends)
        pair = number + np.repeat(np.arange(a, b) * size, np.diff(first))
        pair, count = np.unique(pair[number >= 0], return_counts=True)
        pairs.append(pair)
        counts.append(count)
        a = b
    pair = np.concatenate(pairs)
    row = pair // size
    return row, pair - row * size, np.concatenate(counts)


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, rows, lookup = np.zeros(len(vocabulary), np.int64), 0, Lookup(vocabulary)
    for batch in batches:
        rows += batch.num_rows
        for _, _, data, offsets in text_chunks(batch.column(1)):
            total += np.bincount(_counted(data, offsets, lookup)[1], minlength=len(vocabulary))
    seen = np.flatnonzero(total)
    yield pa.record_batch({"t": pa.array(np.append(seen, -1).astype(np.int32)), "n": pa.array(np.append(total[seen], rows))})


def _packed(x: np.ndarray) -> bytes:
    """The differences of whole numbers, byte by byte of their places, compressed."""
    return zlib.compress(np.diff(x.astype(np.int32), prepend=np.int32(0)).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1).T).view(np.int32).ravel(), dtype=np.int32)


#: What the bytes of a chunk of examples hold.
_PARTS = ("ids", "labels", "sizes", "terms", "counts")


def _vectors(batches: Iterator[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row a chunk of texts, its columns the bytes of arrays."""
    lookup = Lookup(vocabulary)
    for batch in batches:
        ids, label = column_array(batch, "doc_id"), column_array(batch, "label")
        for a, b, data, offsets in text_chunks(batch.column(1)):
            row, term, count = _counted(data, offsets, lookup)
            arrays = [ids[a:b].astype(np.int64).tobytes(), label[a:b].astype(np.int8).tobytes(), *map(_packed, (np.bincount(row, minlength=b - a), term, count))]
            yield pa.record_batch({name: pa.array([x], pa.binary()) for name, x in zip(_PARTS, arrays)})


def _centres(some: np.ndarray, n: int) -> np.ndarray:
    """n unit vectors at most, the centres of a few rounds of spherical k-means on some rows."""
    some = some[some.any(1)]
    if n < 2 or not len(some):
        return np.zeros((1, some.shape[1]), np.float32)
    # each first centre is the row least like those before it
    norm, centre, like = np.linalg.norm(some, axis=1), some.mean(0, keepdims=True), np.full(len(some), -1.0)
    for _ in range(n):
        like = np.maximum(like, some @ centre[-1] / (norm * max(np.linalg.norm(centre[-1]), 1e-9)))
        centre = np.concatenate([centre, some[[like.argmin()]]])
    centre = centre[:n]
    for _ in range(10):
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        own = (some @ centre.T).argmax(1)
        centre = np.stack([some[own == k].sum(0) for k in range(n)])
    return centre / np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)


class Shelf:
    """Large arrays in one file that many processes map, so that a machine holds them once."""

    def __init__(self, path: str):
        self.path, self.own, self.layout, self.size = path, f"{path}.{os.getpid()}.part", {}, 0
        self.file = open(self.own, "w+b")

    def __call__(self, name: str, shape: tuple, kind) -> np.ndarray:
        """An array of zeros in the file; OSError if the disk has no room for it."""
        size = int(np.prod(shape)) * np.dtype(kind).itemsize
        if not size:
            self.layout[name] = (0, shape, kind)
            return np.zeros(shape, kind)
        start = -(-self.size // 4096) * 4096
        os.posix_fallocate(self.file.fileno(), start, size)
        self.layout[name], self.size = (start, shape, kind), start + size
        return np.asarray(np.memmap(self.file, kind, "r+", start, shape))

    def close(self, state: dict) -> None:
        """Adds what is small and gives the file its name."""
        tail = pickle.dumps((self.layout, state))
        self.file.seek(self.size)
        self.file.write(tail + len(tail).to_bytes(8, "little"))
        self.file.close()
        os.replace(self.own, self.path)

    @staticmethod
    def read(path: str) -> dict:
        with open(path, "rb") as file:
            file.seek(-8, os.SEEK_END)
            size = int.from_bytes(file.read(8), "little")
            file.seek(-8 - size, os.SEEK_END)
            layout, state = pickle.loads(file.read(size))
            return state | {name: np.asarray(np.memmap(file, kind, "r", start, shape)) if np.prod(shape) else np.zeros(shape, kind) for name, (start, shape, kind) in layout.items()}


class BlockMaxIndex:
    """Unit vectors of weights over 0 by section and block of examples: a dense table of each section's frequent terms with their largest weight in a block, postings of all other terms.

    Sections hold examples that are alike in their frequent terms, such as those of one
    language, so that a section's table is full and most queries need one of them; a
    section is left out only if none of its blocks can beat a query's k-th hit.  sizes,
    terms and counts are those of the examples one after the other; weigh gives the weight
    of (term, count) before a vector is brought to length 1.  room(name, shape, type) makes
    the large arrays, in memory if it is not given.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, weigh, vocabulary: int, room=None):
        room = room or (lambda name, shape, kind: np.zeros(shape, kind))
        if len(ids) > PLACES:
            raise ValueError(f"{len(ids)} examples are over the {PLACES} that a posting can name")
        start = np.cumsum(sizes) - sizes
        norm, lead = np.empty(len(ids)), np.empty(len(ids), np.int64)
        # a part of the examples at a time, twice, as weights of all in doubles would be the peak of a task's memory
        parts = [slice(k, k + 1024) for k in range(0, len(ids), 1024)]
        widest = np.argsort(-np.bincount(terms, minlength=vocabulary), kind="stable")[:SORTING]
        slot = np.full(vocabulary, -1, np.int32)
        slot[widest] = np.arange(len(widest))

        def wide(row, term, w, n):
            out, at = np.zeros((n, len(widest)), np.float32), slot[term]
            out[row[at >= 0], at[at >= 0]] = w[at >= 0]
            return out

        some = np.unique(np.linspace(0, max(0, len(ids) - 1), 2 * SECTION).astype(int)) if len(ids) else np.zeros(0, int)
        vectors = [slice(a, b) for a, b in zip(start[some].tolist(), (start[some] + sizes[some]).tolist())]
        term, count = (np.concatenate([x[:0], *(x[v] for v in vectors)]) for x in (terms, counts))
        centres = _centres(wide(np.repeat(np.arange(len(some)), sizes[some]), term, weigh(term, count), len(some)), min(SECTIONS, len(ids) // SECTION))
        section = np.zeros(len(ids), np.int64)
        for own in parts:
            i, j, first = start[own][0], start[own][-1] + sizes[own][-1], start[own] - start[own][0]
            w = weigh(terms[i:j], counts[i:j])
            norm[own] = np.sqrt(np.add.reduceat(w * w, first))
            w /= np.repeat(np.where(norm[own] > 0, norm[own], 1), sizes[own])
            # examples of one leading term stand together, so that few blocks can score high
            heavy = np.flatnonzero(w == np.repeat(np.maximum.reduceat(w, first), sizes[own]))
            lead[own] = terms[i:j][heavy[np.searchsorted(heavy, first)]]
            section[own] = (wide(np.repeat(np.arange(len(first)), sizes[own]), terms[i:j], w, len(first)) @ centres.T).argmax(1)
        section = np.unique(section, return_inverse=True)[1]
        by = np.lexsort((ids, lead, section))
        place = np.empty(len(by), np.int32)
        place[by] = np.arange(len(by))
        self.ids, self.labels, self.place = ids[by], labels[by].astype(float), place
        self.start, self.sizes, self.norm, self.terms, self.counts, self.weigh = start[by], sizes[by], norm[by], terms, counts, weigh
        del slot
        members = np.bincount(section)
        held = np.zeros((len(members), vocabulary), np.int32)
        for own in parts:
            i, j = start[own][0], start[own][-1] + sizes[own][-1]
            for s in np.unique(section[own]).tolist():
                held[s] += np.bincount(terms[i:j][np.repeat(section[own] == s, sizes[own])], minlength=vocabulary)
        # terms that are dense in a section: in the first COMMON of the order of their rows, and frequent enough
        self.slot = room("slot", held.shape, np.int16)
        self.slot[:] = -1
        ends, width = np.cumsum(members), []
        for s, n in enumerate(members.tolist()):
            common = np.argsort(-held[s], kind="stable")[:COMMON]
            common = np.sort(common[held[s, common] >= max(1, SHARE * n)])
            self.slot[s, common] = np.arange(len(common))
            held[s, common] = 0
            width.append(len(common))
        self.posted = room("posted", (vocabulary + 1,), np.int64)
        self.posted[1:] = np.cumsum(held.sum(0, dtype=np.int64))
        del held
        self.members, self.width = members, np.array(width)
        # one number with place and weight, so that a list is copied at once
        self.postings, end = room("postings", (int(self.posted[-1]),), np.uint32), self.posted[:-1].copy()
        self.table = room("table", (int((members * self.width).sum()),), np.float32)
        self._divide()
        for own in parts:
            i, j = start[own][0], start[own][-1] + sizes[own][-1]
            term, at, of = terms[i:j], np.repeat(place[own], sizes[own]), np.repeat(section[own], sizes[own])
            w = (weigh(term, counts[i:j]) / np.repeat(np.where(norm[own] > 0, norm[own], 1), sizes[own])).astype(np.float32)
            slot = self.slot[of, term]
            for s in np.unique(section[own]).tolist():
                dense = np.flatnonzero((slot >= 0) & (of == s))
                self.dense[s][slot[dense], at[dense] - (ends[s] - members[s])] = w[dense]
            rare = np.flatnonzero(slot < 0)
            rare = rare[np.argsort(term[rare], kind="stable")]
            term = term[rare]
            new = np.flatnonzero(np.diff(term, prepend=-1))
            size = np.diff(np.append(new, len(term)))
            to = np.arange(len(term)) + np.repeat(end[term[new]] - new, size)
            end[term[new]] += size
            short = (np.maximum(w[rare], np.float32(2.0**-30)) * np.float32(SCALE)).view(np.uint32) >> SHORT
            self.postings[to] = (at[rare].astype(np.uint32) << 17) | short
        self.most = [np.maximum.reduceat(d, np.arange(0, d.shape[1], BLOCK), axis=1) if d.size else np.zeros((len(d), len(range(0, d.shape[1], BLOCK))), np.float32) for d in self.dense]
        self._ready()

    def _divide(self) -> None:
        """The sections' own parts of the table, and where their blocks begin."""
        cut = np.concatenate([[0], np.cumsum(self.members * self.width)])
        self.dense = [self.table[a:b].reshape(k, n) for a, b, k, n in zip(cut, cut[1:], self.width.tolist(), self.members.tolist())]
        self.bounds = np.concatenate([[0], np.cumsum(self.members)]).tolist()
        edges = [np.arange(a, b, BLOCK) for a, b in zip(self.bounds, self.bounds[1:])]
        self.edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        self.firsts = np.cumsum([0, *map(len, edges)])
        self.blocks = len(self.edges)

    def _ready(self) -> None:
        """What each process has of its own."""
        self.query, self.asked = np.zeros(len(self.posted) - 1), np.zeros(len(self.posted) - 1, bool)
        longest = POSTINGS + int(np.diff(self.posted).max(initial=0))
        self.joined, self.places, self.found, self.steps = np.empty(longest, np.uint32), np.empty(longest, np.int64), np.empty(longest), np.arange(longest)

    def state(self) -> dict:
        """What is not on the shelf."""
        return {k: getattr(self, k) for k in ("ids", "labels", "place", "start", "sizes", "norm", "members", "width", "most")}

    @classmethod
    def open(cls, path: str, weigh) -> BlockMaxIndex:
        """The index that was made on a shelf, together with its terms and counts."""
        index = cls.__new__(cls)
        index.__dict__ |= Shelf.read(path)
        index.weigh = weigh
        index._divide()
        index._ready()
        return index

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples that share a term; ties go to the smaller id."""
        return self.search_all([(terms, weights)], k, None if without is None else [without])[0]

    def search_all(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        out, size = [], -(-len(queries) // max(1, -(-len(queries) // QUERIES)))  # even parts, as a table is read for few queries as for many
        for a in range(0, len(queries), max(1, size)):
            out += self._search(queries[a : a + size], k, without and without[a : a + size])
        return out

    def _sum_rare(self, terms: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        """Adds up the postings of terms, some lists at a time."""
        start = self.posted[terms]
        size = self.posted[terms + 1] - start
        ends = np.cumsum(size)
        cuts = [0, *np.searchsorted(ends, np.arange(POSTINGS, int(ends[-1]) if len(ends) else 0, POSTINGS), "left").tolist(), len(ends)]
        total = None
        for a, b in zip(cuts, cuts[1:]):
            first = int(ends[a - 1]) if a else 0
            n = int(ends[b - 1]) - first if b > a else 0
            if not n:
                continue
            # places of all lists' postings, as a copy of each list costs more than its postings
            at = np.repeat(start[a:b] - (ends[a:b] - size[a:b] - first), size[a:b])
            at += self.steps[:n]
            joined = self.postings.take(at, out=self.joined[:n], mode="clip")
            np.right_shift(joined, 17, out=self.places[:n])
            joined <<= 15
            joined >>= 15 - SHORT
            np.multiply(joined.view(np.float32), np.repeat((weights[a:b] / SCALE).astype(np.float32), size[a:b]), out=self.found[:n])
            part = np.bincount(self.places[:n], self.found[:n], len(out))
            total = part if total is None else total + part
        if total is not None:
            out[:] = total

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        m, sections = len(queries), range(len(self.dense))
        score = np.zeros((m, len(self.ids)), np.float32)
        for r, (terms, weights) in enumerate(queries):
            self._sum_rare(terms, weights, score[r])
        row = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        term, weight = (np.concatenate([q[x] for q in queries]) for x in (0, 1))
        common = []
        for s in sections:
            slot = self.slot[s, term]
            dense = np.flatnonzero(slot >= 0)
            common.append(np.zeros((m, len(self.dense[s])), np.float32))
            common[s][row[dense], slot[dense]] = weight[dense]
        # an example that has to be left out may be among the hits that a bound is taken from
        need = k if without is None else k + max(int((self.ids == i).sum()) for i in without)
        top = np.maximum.reduceat(score, self.edges, axis=1)
        bound = np.stack([(top[:, a:b] + common[s] @ self.most[s]).max(1) for s, a, b in zip(sections, self.firsts, self.firsts[1:])], 1) * np.float32(1 + 2 * SLACK)
        # the section that can score highest comes first, then those that can still beat its k-th hit
        wanted = bound == bound.max(1, keepdims=True)
        done, least = np.zeros_like(wanted), np.zeros(m, np.float32)
        for again in (True, False):
            for s, a, b in zip(sections, self.bounds, self.bounds[1:]):
                rows = np.flatnonzero(wanted[:, s])
                if len(rows) and len(self.dense[s]):
                    for r, dots in zip(rows.tolist(), common[s][rows] @ self.dense[s]):
                        score[r, a:b] += dots
            done |= wanted
            if again:
                # the k-th largest of the blocks' best; sums that are not finished are lower bounds too, as no weight is below 0
                top = np.maximum.reduceat(score, self.edges, axis=1) if self.blocks >= need else score
                if top.shape[1] >= need:
                    least = np.partition(top, top.shape[1] - need, axis=1)[:, -need]
                wanted = ~done & (bound >= least[:, None]) & (bound > 0)
        out, query = [], self.query
        for r, (terms, weights) in enumerate(queries):
            found = np.flatnonzero(score[r] >= max(least[r] * (1 - 2 * SLACK), np.finfo(np.float32).tiny))
            if len(found) > need:
                found = found[score[r, found] >= np.partition(score[r, found], len(found) - need)[len(found) - need] * (1 - 2 * SLACK)]
            if without is not None:
                found = found[self.ids[found] != without[r]]
            if not len(found):
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            query[terms], self.asked[terms] = weights, True
            size = self.sizes[found]
            vectors = [slice(a, b) for a, b in zip(self.start[found].tolist(), (self.start[found] + size).tolist())]
            term, count = (np.concatenate([x[v] for v in vectors]) for x in (self.terms, self.counts))
            shared = np.flatnonzero(self.asked.take(term))
            term, count, owner = term.take(shared), count.take(shared), np.repeat(np.arange(len(found)), size).take(shared)
            exact = np.round(np.bincount(owner, query[term] * self.weigh(term, count), len(found)) / self.norm[found], 12)
            query[terms], self.asked[terms] = 0, False
            by = np.lexsort((self.ids[found], -exact))[:k]
            out.append((found[by], exact[by]))
        return out


class Examples:
    """The sampled rows' term counts: as the bytes they came in, or by the path of a file that holds the index over them."""

    def __init__(self, chunks: list[tuple[bytes, ...]], weight: np.ndarray, base: float, path: str | None = None):
        self.chunks, self.weight, self.base, self.path, self._index = chunks, weight, base, path, None
        self._logs = np.ones(1)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_index": None}

    def _joined(self, part: str) -> np.ndarray:
        k = _PARTS.index(part)
        if k < 2:
            return np.frombuffer(b"".join(c[k] for c in self.chunks), (np.int64, np.int8)[k])
        return np.concatenate([_unpacked(c[k]) for c in self.chunks] or [np.zeros(0, np.int32)])

    def labelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and labels of the rows with known terms, and the labels of those without."""
        ids, labels, sizes = (self._joined(k) for k in ("ids", "labels", "sizes"))
        return ids[sizes > 0], labels[sizes > 0], labels[sizes == 0]

    def weigh(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(1 + log count) times the term's weight."""
        if len(counts) and counts.max() > len(self._logs):
            self._logs = 1 + np.log(np.arange(1, int(counts.max()) + 1))
        return self._logs[counts - 1] * self.weight[terms]

    def rows(self, numbers: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Ids and vectors of examples by their numbers."""
        index = self.index()
        places = index.place[numbers]
        starts = index.start[places]
        return index.ids[places], [self.unit(index.terms[a:b], index.counts[a:b]) for a, b in zip(starts.tolist(), (starts + index.sizes[places]).tolist())]

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = self.weigh(terms, counts)
        norm = float(np.sqrt((w * w).sum()))
        return terms, w / norm if norm else w

    def build(self, room=None) -> BlockMaxIndex:
        """The index; its large arrays, terms and counts among them, are made by room, see BlockMaxIndex."""
        room, sizes = room or (lambda name, shape, kind: np.zeros(shape, kind)), self._joined("sizes")
        # in place, as pieces beside the whole would be the peak of a task's memory
        most = max((int(_unpacked(c[4]).max(initial=1)) for c in self.chunks), default=1)
        arrays = [room(name, (int(sizes.sum()),), kind) for name, kind in (("terms", np.int32), ("counts", np.min_scalar_type(most)))]
        for k, out in enumerate(arrays, 3):
            end = 0
            for c in self.chunks:
                piece = _unpacked(c[k])
                out[end : end + len(piece)] = piece
                end += len(piece)
        return BlockMaxIndex(*self.labelled()[:2], sizes[sizes > 0].astype(np.int64), *arrays, self.weigh, len(self.weight), room)

    def shelve(self, path: str) -> None:
        """Makes the index in a file."""
        shelf = Shelf(path)
        try:
            shelf.close(self.build(shelf).state())
        finally:
            shelf.file.close()
            with suppress(FileNotFoundError):
                os.unlink(shelf.own)

    def index(self) -> BlockMaxIndex:
        if self._index is None:
            self._index = BlockMaxIndex.open(self.path, self.weigh) if self.path else self.build()
            self.chunks = []  # the index has it all
        return self._index

    def votes(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float, list[int]]]:
        """Share of the label among the neighbours by squared cosine, drawn towards the base rate."""
        index, out = self.index(), []
        for places, near in index.search_all(vectors, NEIGHBOURS, without):
            near = near * near
            out.append((float(((near * index.labels[places]).sum() + PRIOR * self.base) / (near.sum() + PRIOR)), index.ids[places].tolist()))
        return out


def _shelved(batches: Iterator[pa.RecordBatch], examples: Examples, path: str) -> Iterator[pa.RecordBatch]:
    """Makes the index in a file; -1 if there is no room for it."""
    for batch in batches:
        try:
            examples.shelve(path)
            yield batch
        except OSError:
            yield pa.record_batch({"id": pa.array([-1], pa.int64())})


#: Files of indexes that this driver had made.
_MADE: set[str] = set()


def _drop(paths: set[str]) -> None:
    for path in paths:
        _MADE.discard(path)
        with suppress(OSError):
            os.unlink(path)


atexit.register(lambda: _drop(set(_MADE)))


@contextmanager
def passing():
    """Drops the files of models that are fitted inside; what they score must be written by then."""
    before = set(_MADE)
    try:
        yield
    finally:
        _drop(_MADE - before)


def _spread(spark: SparkSession, examples: Examples):
    """A broadcast of the examples.

    One task makes the index in a file of the checkpoint folder, which driver and
    executors share; every worker maps it, so that a machine holds it once.  If that
    folder is not one of a file system or is full, each worker makes an index of its own.
    """
    sc = spark.sparkContext
    ensure_checkpoint_dir(spark)
    folder = sc._jsc.sc().getCheckpointDir().get()
    if re.match("file:|/", folder):
        path = f"{re.sub('^file:/*', '/', folder)}/nearest-{uuid.uuid4()}.index"
        whole = sc.broadcast(examples)
        _MADE.add(path)
        if spark.range(0, 1, 1, 1).mapInArrow(lambda b: _shelved(b, whole.value, path), "id long").first()["id"] == 0:
            whole.destroy()
            return sc.broadcast(Examples([], examples.weight, examples.base, path))
        _MADE.discard(path)
        return whole
    return sc.broadcast(examples)


def _left_out_votes(batches: Iterator[pa.RecordBatch], examples: Examples) -> Iterator[pa.RecordBatch]:
    """The vote of each numbered example's neighbours, itself not among them."""
    for batch in batches:
        numbers = column_array(batch, "id")
        ids, vectors = examples.rows(numbers)
        votes = examples.votes(vectors, ids.tolist())
        yield pa.record_batch({"id": pa.array(numbers), "vote": pa.array([v for v, _ in votes], pa.float64())})


class Model:
    """A vocabulary with its weights and a calibration; the examples are broadcast on their own (shared).  Bounded whatever the corpus (see SAMPLE_ROWS, TERMS)."""

    def __init__(self, vocabulary: np.ndarray, base: float, empty: float = 0.0, curve: tuple | None = None, shared=None):
        self.vocabulary, self.base, self.empty, self.curve, self.shared = vocabulary, base, empty, curve, shared
        self._lookup: Lookup | None = None
        self.cache: dict[bytes, tuple[float, list[int]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"shared": None, "_lookup": None, "cache": {}}

    def lookup(self) -> Lookup:
        if self._lookup is None:
            self._lookup = Lookup(self.vocabulary)
        return self._lookup

    def scores(self, vectors: list[tuple[np.ndarray, np.ndarray]], examples: Examples | None) -> list[tuple[float, list[int]]]:
        """Score and neighbours of each (terms, counts)."""
        keys = [hashlib.blake2b(t.tobytes() + c.tobytes(), digest_size=16).digest() if len(t) and examples is not None else b"" for t, c in vectors]
        own: dict[bytes, tuple[float, list[int]]] = {b"": (self.empty, [])}
        fresh = {}
        for key, v in zip(keys, vectors):
            if key in self.cache:
                own[key] = self.cache[key]
            elif key:
                fresh[key] = v
        if fresh:
            for key, (raw, ids) in zip(fresh, examples.votes([examples.unit(*v) for v in fresh.values()])):
                own[key] = float(np.interp(raw, *self.curve)), ids
                if len(self.cache) < 1 << 16:
                    self.cache[key] = own[key]
        return [own[key] for key in keys]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit of y on x, as points to interpolate between; ends stay off 0 and 1."""
    by = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[by], y[by]):
        pools.append([a, b, 1.0])
        while len(pools) > 1 and pools[-2][1] >= pools[-1][1]:
            a2, b2, n2 = pools.pop()
            a1, b1, n1 = pools.pop()
            pools.append([(a1 * n1 + a2 * n2) / (n1 + n2), (b1 * n1 + b2 * n2) / (n1 + n2), n1 + n2])
    return np.array([p[0] for p in pools]), np.array([(p[1] * p[2] + 0.5) / (p[2] + 1) for p in pools])


def held_out(id_column: str) -> F.Column:
    """True for rows whose label must not be learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """The model of a 0/1 label, from at most SAMPLE_ROWS labelled rows outside the held-out fold.

    The rows are those with the smallest id hashes.  Null labels and ids are left out; an
    id that is labelled twice takes the larger label.  Without rows to learn from every
    text scores 0.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column)).groupBy(F.col(id_column).cast("long").alias("doc_id")).agg((F.max(label) > 0).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)  # a bounded sample, see SAMPLE_ROWS
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
    # equal texts count once; if their labels differ, with the larger
    distinct = cut(sample.groupBy("text").agg(F.max("label").alias("label")).select(F.lit(0).alias("doc_id"), "text", "label"))
    sums = distinct.agg(F.count("*").alias("n"), F.sum("label").alias("hits")).first()
    if not sums["n"] or not sums["hits"]:
        return Model(np.zeros(0, np.uint64), 0.0)
    base = sums["hits"] / sums["n"]
    counts = cut(distinct.mapInArrow(_distinct_terms, "term long, n long, hits long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(F.col("n") >= TERM_ROWS))
    if counts.count() > TERMS:
        counts = counts.orderBy(F.desc("n"), "term").limit(TERMS)
    got = counts.toArrow()
    vocabulary, n, hits = got.column(0).to_numpy().view(np.uint64), got.column(1).to_numpy(), got.column(2).to_numpy()
    by = np.argsort(vocabulary)
    vocabulary, n, hits = vocabulary[by], n[by], hits[by]
    found = texts.select("doc_id", "text").mapInArrow(lambda b: _frequencies(b, vocabulary), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)  # the last is that of all rows, t = -1
    df[found.column(0).to_numpy()] = found.column(1).to_numpy()
    weight = np.log(1 + df[-1] / (1 + df[:-1])) * np.log2(2 + hits / np.maximum(1, n - hits))
    # in the order of ids, so that every run has the same examples in the same places
    got = sample.orderBy("doc_id", F.xxhash64("text")).mapInArrow(lambda b: _vectors(b, vocabulary), ", ".join(f"{k} binary" for k in _PARTS)).toArrow()
    examples = Examples(list(zip(*(got.column(k).to_pylist() for k in range(len(_PARTS))))), weight, base)
    del got
    ids, marks, bare = examples.labelled()
    empty = (float(bare.sum()) + base) / (len(bare) + 1)
    if not len(ids):
        return Model(vocabulary, base, empty)
    spark = docs.sparkSession
    shared = _spread(spark, examples)
    votes = spark.range(0, len(ids), 1, max(1, min(len(ids) // QUERIES, spark.sparkContext.defaultParallelism))).mapInArrow(lambda b: _left_out_votes(b, shared.value), "id long, vote double").toArrow()
    vote = np.zeros(len(ids))
    vote[votes.column(0).to_numpy()] = votes.column(1).to_numpy()
    return Model(vocabulary, base, empty, isotonic(vote, marks.astype(float)), shared)


def _scored(batches: Iterator[pa.RecordBatch], model: Model, examples: Examples | None, columns: list[str] | None = None, text: int = 1) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for a, b, data, offsets in text_chunks(batch.column(text)):
            row, term, count = _counted(data, offsets, model.lookup())
            cuts = np.searchsorted(row, np.arange(b - a + 1))
            got = model.scores([(term[i:j], count[i:j]) for i, j in zip(cuts, cuts[1:])], examples)
            if columns:
                own = batch.slice(a, b - a)
                yield pa.record_batch([*own.columns[: len(columns)], pa.array([s for s, _ in got], pa.float64())], names=[*columns, "__score"])
                continue
            yield pa.record_batch({"doc_id": ids.slice(a, b - a), "score": pa.array([s for s, _ in got], pa.float64()), "neighbours": pa.array([n for _, n in got], pa.list_(pa.int64()))})


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_column: str = "doc_id", text_column: str = "text", columns: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= threshold), neighbours (ids of the examples that voted).

    columns: instead of doc_id and held_out, these columns of docs, for a filter without a join.

    Null and empty texts, and texts without a known term, get the rate of the label among
    such examples.  The score depends on the text alone; repeated rows score alike, and
    other columns are ignored.  The model is broadcast; its size is bounded.
    """
    shared, examples = docs.sparkSession.sparkContext.broadcast(model), model.shared
    if columns:
        # a text that is among the columns goes to the workers once
        carried = docs.select(*columns)
        if dict(carried.dtypes).get(text_column) == "string":
            at = carried.columns.index(text_column)
        else:
            carried, at = docs.select(*columns, F.col(text_column).cast("string").alias("__text")), len(columns)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[: len(columns)])
        out = carried.mapInArrow(lambda b: _scored(b, shared.value, examples and examples.value, columns, at), f"{schema}, `__score` double")
        return out.withColumn("predicted", (F.col("__score") >= threshold).cast("int"))
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = source.mapInArrow(lambda b: _scored(b, shared.value, examples and examples.value), "doc_id long, score double, neighbours array<long>")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "neighbours")
