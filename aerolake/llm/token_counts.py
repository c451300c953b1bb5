"""Token counts of whole texts with a two-tier lookup on the map side.

A text is cut before every run of spaces that follows something else, and where letters and other
characters meet. No piece of the model spans such a cut (checked when the model is loaded; cuts of the second kind
also ask that texts aren't normalised and no character is unknown), so a text has as many tokens as its pre-tokens
have. A broadcast hash table gives the lengths of frequent pre-tokens under two independent 64-bit
hashes; what it lacks is encoded once and kept in a cache of the Python worker. No pre-token is shuffled.

The table comes from about TABLE_ROWS rows spread over all partitions (twice as many at most), counted on
the driver, and holds TABLE_SIZE entries of 20 bytes at most, so its size has a fixed bound. It decides only
where a length is looked up, never which.

Cases: a null text counts as empty and has no token; texts of blanks, of one endless word, or with
the model's own space mark are counted as the library counts them; very long texts are cut where no
piece can span the cut; of equally frequent pre-tokens the one with the lesser hash enters the table;
repeated rows stay; an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MODEL = "piece_bpe_32k.model"
TABLE_ROWS, TABLE_BYTES = 1000, 20_000
TABLE_SIZE = 50_000
#: Entries of a worker's cache; it starts again from the table when they are reached.
CACHE_SIZE = 500_000
LIMIT = 4096
MARK = "▁"


def model_path(name: str) -> str:
    """Where a public tokenizer lies on this machine; a path stays as it is."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


#: Bytes by kind: 0 spaces, 1 other ASCII characters that aren't letters, 2 letters of ASCII and, by their first
#: bytes, of U+00C0 to U+017F, 3 anything else.
_KINDS = np.repeat(np.array([1, 3], np.uint8), 128)
_KINDS[32] = 0
_KINDS[65:91] = _KINDS[97:123] = _KINDS[0xC3:0xC6] = 2
#: Whether a text may be cut between two kinds (4 x the first + the second): before spaces, or there and between 1 and 2.
_AT_SPACES = np.isin(np.arange(16), (4, 8, 12))
_AT_KINDS = _AT_SPACES | np.isin(np.arange(16), (6, 9))
#: What stands before a pre-token that goes on with a word while it is encoded, by kind.
_BEFORE = ("", "a", ".")


def kinds_of(raw: np.ndarray) -> np.ndarray:
    kinds = _KINDS[raw]
    kinds[np.flatnonzero((kinds == 2) & (raw > 127)) + 1] = 2
    return kinds


def cuts_by_kind(sp) -> bool:  # noqa: ANN001
    """Whether texts can also be cut between letters and other characters: they are encoded as they stand, no character
    is unknown and no piece has both side by side."""
    try:
        from sentencepiece import sentencepiece_model_pb2
    except ImportError:
        return False
    model = sentencepiece_model_pb2.ModelProto.FromString(sp.serialized_model_proto())
    if model.normalizer_spec.precompiled_charsmap or not model.trainer_spec.byte_fallback:
        return False
    own = [p.piece.replace(MARK, " ") for p in model.pieces if p.type in (p.NORMAL, p.USER_DEFINED, p.UNUSED)]
    kinds = kinds_of(np.frombuffer(" ".join(own).encode(), np.uint8))
    return not (_AT_KINDS & ~_AT_SPACES)[4 * kinds[:-1] + kinds[1:]].any()


class Pieces:
    """A sentencepiece model, and the ids of every pre-token met so far."""

    def __init__(self, model: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, keep_ids: bool = False, cache: int = CACHE_SIZE):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_path(model))
        pieces = map(self.sp.id_to_piece, range(self.sp.get_piece_size()))
        self.mark = self.sp.piece_to_id(MARK)
        probe = self.sp.encode("a  b", out_type=str)
        self.cuts = probe[0] == f"{MARK}a" and "".join(probe) == f"{MARK}a{MARK}{MARK}b" and not any(MARK in p.lstrip(MARK) for p in pieces)
        self.may_cut = _AT_KINDS if self.cuts and cuts_by_kind(self.sp) else _AT_SPACES
        self.before = np.array([len(self.sp.encode(x)) for x in _BEFORE])
        self.frequent, self.keep_ids, self.cache = frequent, keep_ids, cache
        self.room = cache + cache // 4
        self.reset()

    def reset(self) -> None:
        self.table = common.HashTable(self.room)
        self.lengths = np.zeros(self.room, np.int32)
        self.ids = common.Ragged("<u2")
        if self.frequent and not self.keep_ids:
            self.table.add(*self.frequent[:2])
            self.lengths[: self.table.used] = self.frequent[2]

    def encode(self, pretokens: list[str]) -> list[list[int]]:
        """The ids of pre-tokens without their first space; an empty one is a space at a text's end."""
        ids = self.sp.encode(pretokens, num_threads=1)
        if "" in pretokens:
            ids = [x if p else [self.mark] for p, x in zip(pretokens, ids, strict=True)]
        return ids

    def numbers(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number, in ``lengths`` and ``ids``, of each pre-token of texts that can be cut, and
        where each text's pre-tokens begin (one more for the end)."""
        raw, at = common.utf8(texts)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        kinds, begins = kinds_of(raw), np.ones(len(raw), bool)
        begins[1:] = self.may_cut[4 * kinds[:-1] + kinds[1:]]
        firsts = at[:-1][np.diff(at) > 0]
        begins[firsts] = True
        starts = np.flatnonzero(begins)
        # A text's first pre-token has no space before it, and its own leading spaces count.
        spaced = raw[starts] == 32
        inner = ~spaced
        opening = np.searchsorted(starts, firsts)
        spaced[opening] = inner[opening] = False
        if self.table.used + len(starts) > self.room or self.table.used > self.cache:
            self.reset()
        found = []
        for lo, hi in common.segments(begins, at):
            i, j = np.searchsorted(starts, [lo, hi])
            found.append(self._numbers(raw[lo:hi], starts[i:j] - lo, spaced[i:j], inner[i:j]))
        return np.concatenate(found), np.searchsorted(starts, at)

    def _numbers(self, raw: np.ndarray, starts: np.ndarray, spaced: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """``spaced``: the first byte is the space that parts words; ``inner``: it goes on with a word."""
        firsts, sizes = starts + spaced, np.diff(starts, append=len(raw)) - spaced
        hashes, checks = common.name_pairs(raw, firsts, sizes, inner)
        found = self.table.find(hashes, checks)
        if len(missing := np.flatnonzero(found < 0)):
            one = missing[common.distinct_pairs(hashes[missing], checks[missing])]
            ids, used = self._encoded(raw, firsts[one], sizes[one], inner[one]), self.table.used
            lengths = ids[1]
            if used + len(one) > len(self.lengths):
                self.lengths = np.concatenate([self.lengths, np.zeros(len(one), np.int32)])
                self.table, old = common.HashTable(2 * (used + len(one))), self.table
                self.table.add(*old.all())
            self.table.add(hashes[one], checks[one])
            self.lengths[used : self.table.used] = lengths
            if self.keep_ids:
                self.ids.append(*ids)
            found[missing] = self.table.find(hashes[missing], checks[missing])
        return found

    def _encoded(self, raw: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these pre-tokens one after the other, and how many each has. One that goes on with a word is
        encoded behind a character of the other kind, whose ids then go."""
        kind = np.where(inner, _KINDS[raw[np.minimum(firsts, len(raw) - 1)]], 0)
        at = np.concatenate([[0], np.cumsum(sizes + inner)])
        data = raw[np.repeat(firsts - inner - at[:-1], sizes + inner) + np.arange(at[-1])]
        for k in (1, 2):
            data[at[:-1][kind == k]] = ord(_BEFORE[k])
        names = pa.LargeStringArray.from_buffers(len(firsts), pa.py_buffer(at), pa.py_buffer(data)).to_numpy(zero_copy_only=False).tolist()
        ids = self.encode(names)
        lengths = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter(chain.from_iterable(ids), np.int64, int(lengths.sum()))
        begin, gone = np.cumsum(lengths) - lengths, self.before[kind]
        keep = np.ones(len(flat), bool)
        for k in range(gone.max()):
            keep[begin[gone > k] + k] = False
        return flat[keep], (lengths - gone).astype(np.int32)

    def whole(self, texts: pa.Array) -> list[int]:
        """Rows whose text can't be cut at spaces."""
        if not self.cuts:
            return list(range(len(texts)))
        if MARK.encode() not in common.utf8(texts)[0].tobytes():
            return []
        return [i for i, t in enumerate(texts.to_pylist()) if MARK in (t or "")]

    def stream(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each text, with ``end`` after each, and where each text's begin."""
        numbers, at = self.numbers(texts)
        ids, lengths = self.ids.gather(numbers)
        first = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[at]
        if odd := {k: np.array(self.sp.encode(texts[k].as_py() or ""), "<u2") for k in self.whole(texts)}:
            own = [odd.get(k, ids[i:j]) for k, (i, j) in enumerate(zip(first, first[1:], strict=False))]
            ids, first = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return np.insert(ids, first[1:], end), first + np.arange(len(first))

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        out = []
        for i, j in common.blocks(texts):
            part = texts.slice(i, j - i)
            numbers, at = self.numbers(part)
            total = np.concatenate([[0], np.cumsum(self.lengths[numbers], dtype=np.int64)])
            n = np.diff(total[at])
            for k in self.whole(part):
                n[k] = len(self.sp.encode(part[k].as_py() or ""))
            out.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_workers: dict[str, Pieces] = {}


def frequent_lengths(docs: DataFrame, model: str = MODEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and lengths of the most frequent pre-tokens of about TABLE_ROWS rows of up to
    TABLE_BYTES, drawn from all partitions; equally frequent ones by their hashes."""
    d = docs.select("text").where(F.octet_length("text") <= TABLE_BYTES)
    part = min(1.0, TABLE_ROWS / max(1, docs.count()))
    rows = d.where(F.rand(1) < part).limit(2 * TABLE_ROWS).collect()
    texts = pa.array([r["text"] for r in rows], pa.large_string())
    pieces, seen = Pieces(model), np.zeros(0, np.int64)
    for i, j in common.blocks(texts):
        numbers, _ = pieces.numbers(texts.slice(i, j - i))
        if pieces.table.used < len(seen):  # the cache was full
            seen = seen[:0]
        seen = np.concatenate([seen, np.zeros(pieces.table.used - len(seen), np.int64)])
        seen += np.bincount(numbers, minlength=len(seen))
    keys, checks = pieces.table.all()
    keys, checks = keys[: len(seen)], checks[: len(seen)]
    top = np.lexsort((keys, -seen))[:TABLE_SIZE]
    return keys[top], checks[top], pieces.lengths[top]


def count_tokens(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs."""
    table = docs.sparkSession.sparkContext.broadcast((model, frequent_lengths(docs, model)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, frequent = table.value
        if (pieces := _workers.get(name)) is None:
            pieces = _workers[name] = Pieces(name, frequent)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pieces.counts(b.column(2)), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return common.map_batches(d, work, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
