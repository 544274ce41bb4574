"""Vector bin packing of examples into training sequences, with free cuts.

Each task packs its own rows: a pool of waiting pieces, and one open sequence that
takes the piece whose demand vector (tokens, one segment, loss-bearing tokens) has
the largest dot product with what is left of the limits.  A piece that no longer
fits is cut.  A sequence that cannot be filled is shortened to a power of two and
the rest goes back to the pool, so no sequence needs padding.  There is no shuffle;
a lost task packs its own rows again and comes to the same sequences.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: how this vocabulary splits a text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that wait in a task's pool before sequences are closed.
POOL = 512
#: The id that ends each document.
END = 1


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the byte-level BPE in a tokenizers JSON file, special strings included.

    tiktoken merges by the same vocabulary four times as fast and gives the same ids.
    The tokenizers library itself encodes texts that hold an added token's string,
    those that tiktoken's pattern gives up on (a million blanks in a row), and all
    texts if the file asks for another way to split them than PATTERN.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    exact = Tokenizer.from_file(path)

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    known = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True) and not spec.get("normalizer")
    if not known or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return slow
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    special = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        try:
            return fast.encode_to_numpy(text)
        except ValueError:  # the pattern's stack is full
            return slow(text)

    return encode


class Packer:
    """Packs pieces (row key, ids, loss mask) under limits on tokens, segments and loss-bearing tokens."""

    def __init__(self, tokens: int, segments: int, loss: int, pool: int = POOL):
        self.limits = np.array([tokens, segments, loss], float)
        self.pool: list[tuple] = []
        self.demand = np.zeros((pool * 2, 3))
        self.keep = pool
        self.sequence = 0
        self.rows: list[tuple] = []

    def add(self, key, ids: np.ndarray, mask: np.ndarray | None = None) -> None:
        """mask: which ids bear loss (None: all)."""
        whole, size = int(min(self.limits[0], self.limits[2] if mask is None else self.limits[0])), len(ids)
        start = 0
        if mask is None and whole == self.limits[0]:
            while size - start >= whole:  # a full sequence of one document
                self.rows.append((key, start, ids[start : start + whole], size, self.sequence, 0))
                self.sequence += 1
                start += whole
        if start < size:
            self._wait((key, start, ids[start:], size, None if mask is None else mask[start:]))
        while len(self.pool) > self.keep:
            self._close()

    def flush(self) -> None:
        while self.pool:
            self._close()

    def _wait(self, piece: tuple) -> None:
        n = len(self.pool)
        if n == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        loss = len(piece[2]) if piece[4] is None else int(piece[4].sum())
        self.demand[n] = np.array([len(piece[2]), 1, loss]) / self.limits
        self.pool.append(piece)

    def _take(self, i: int) -> tuple:
        piece, last = self.pool[i], self.pool.pop()
        if i < len(self.pool):
            self.pool[i] = last
            self.demand[i] = self.demand[len(self.pool)]
        return piece

    def _room(self, piece: tuple, left: np.ndarray) -> int:
        """How many of the piece's first ids still fit."""
        room = int(min(left[0], len(piece[2]) if left[1] >= 1 else 0))
        if piece[4] is None:
            return int(min(room, left[2]))
        over = np.flatnonzero(np.cumsum(piece[4][:room]) > left[2])
        return int(over[0]) if len(over) else room

    def _close(self) -> None:
        left, placed, used = self.limits.copy(), [], 0
        while self.pool and left[0] >= 1 and left[1] >= 1:
            demand = self.demand[: len(self.pool)]
            score = demand @ (left / self.limits)
            fits = (demand * self.limits <= left + 1e-9).all(axis=1)
            i = int(np.argmax(np.where(fits, score, -1))) if fits.any() else int(np.argmax(score))
            room = self._room(self.pool[i], left)
            if not room:
                rooms = [self._room(p, left) for p in self.pool]
                i = int(np.argmax(rooms))
                if not (room := rooms[i]):
                    break
            key, start, ids, size, mask = self._take(i)
            if room < len(ids):
                self._wait((key, start + room, ids[room:], size, None if mask is None else mask[room:]))
            placed.append((key, start, ids[:room], size, None if mask is None else mask[:room]))
            left -= [room, 1, room if mask is None else int(mask[:room].sum())]
            used += room
        if used < self.limits[0]:
            target = 1 << (used.bit_length() - 1)
            while used > target:
                key, start, ids, size, mask = placed.pop()
                keep = max(0, len(ids) - (used - target))
                used -= len(ids) - keep
                if keep:
                    placed.append((key, start, ids[:keep], size, None if mask is None else mask[:keep]))
                self._wait((key, start + keep, ids[keep:], size, None if mask is None else mask[keep:]))
        offset = 0
        for key, start, ids, size, _ in placed:
            self.rows.append((key, start, ids, size, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1


def _mask(bears, size: int) -> np.ndarray | None:
    """Which of size ids bear loss (None: all), from a flag of the whole document or a list of flags; ids past the list's end bear none."""
    if bears is True:
        return None
    mask = np.zeros(size, bool)
    if bears:
        flags = [bool(x) for x in bears[:size]]
        mask[: len(flags)] = flags
    return None if mask.all() else mask


def _packed(batches: Iterator[pa.RecordBatch], path: str, tokens: int, segments: int, loss: int, with_ids: bool, loss_column: bool) -> Iterator[pa.RecordBatch]:
    encode, packer = encoder(path), Packer(tokens, segments, loss)
    base = TaskContext.get().partitionId() << 36

    def out() -> pa.RecordBatch:
        rows, packer.rows = packer.rows, []
        key, start, ids, size, sequence, offset = zip(*rows)
        cols = {
            "doc_id": pa.array(key, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) for x in ids], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids], pa.int64()),
            "doc_tokens": pa.array(size, pa.int64()), "sequence_id": pa.array([base + s for s in sequence], pa.int64()), "offset": pa.array(offset, pa.int64()),
        }
        if with_ids:
            flat = np.concatenate(ids).astype(np.int32)
            cols["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)), pa.array(flat))
        return pa.record_batch(cols)

    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column(1)[row].as_py() or ""
            ids = np.append(encode(text), np.uint32(END))
            packer.add(batch.column(0)[row].as_py(), ids, _mask(batch.column(2)[row].as_py(), len(ids)) if loss_column else None)
            if len(packer.rows) >= 4096:
                yield out()
    packer.flush()
    if packer.rows:
        yield out()


def pack(docs: DataFrame, tokenizer_path: str, tokens: int = 2048, segments: int = 128, loss: int | None = None, with_ids: bool = False, loss_mask: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of all documents, packed into sequences of at most `tokens` ids.

    Returns per piece: doc_id, start (its document's ids before it), length, ids_crc32
    (of the ids as unsigned little-endian 32-bit numbers), doc_tokens, sequence_id,
    offset in the sequence; with_ids adds the ids.  Every document's ids end with id 1
    and lie in exactly one piece each; null text is the end id alone.  A sequence has
    at most `segments` pieces and `loss` loss-bearing ids (default: tokens; all ids
    bear loss unless loss_mask names a column: one boolean for all ids of a document,
    or an array with one for each id; null flags bear none); its length is `tokens` or a
    power of two.  A null id and repeated rows are packed like any others; other
    columns are ignored; an empty table gives an empty table.
    """
    columns = [F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")]
    if loss_mask:
        columns.append(F.col(loss_mask).alias("bears_loss"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    most = loss or tokens
    return docs.select(*columns).mapInArrow(lambda b: _packed(b, tokenizer_path, tokens, segments, most, with_ids, loss_mask is not None), schema)
