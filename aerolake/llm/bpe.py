"""BPE encoding and decoding with an index of pair occurrences.

Texts are cut at white space. The distinct words of a block of texts that are not cached yet are
normalised, cut into pre-tokens and merged together: an index maps each pair with a rank to all its
places in the block, active ranks are applied in ascending order, and every merge updates only the
lists of the pairs next to it. A word's ids and decoded tokens then serve all its occurrences.

Cases: a null text counts as empty; an empty text has no id, and the digests of the empty string;
the strings of special tokens become their ids, as the library does by default; texts with
characters beyond Latin are normalised and cut by the library's own normaliser; a block holds
BLOCK_BYTES bytes or one text and is worked on in segments that end at white space, so very long texts
and partitions stay in memory; repeated rows stay; an empty table gives an empty result; further
columns, whatever their names, are ignored. A cached word is found by two independent 64-bit hashes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .token_counts import model_path

MODEL = "word_bpe_49k.json"
BLOCK_BYTES = 2 << 20
CACHE_SIZE = 200_000
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Up to here Python and the library agree on letters, cases and composition.
_PLAIN = re.compile(r"[^\x00-\x1b\x20-ɏ]")


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBPE:
    """A tokenizer file of the word-end kind: lower case, white space dropped."""

    def __init__(self, model: str):
        import regex

        with open(model_path(model), encoding="utf-8") as f:
            spec = json.load(f)
        # For words beyond Latin the library normalises and cuts; it needs no vocabulary for that.
        small = {"type": "BPE", "vocab": {}, "merges": []}
        self.rules = json.dumps(spec | {"model": small, "added_tokens": [], "post_processor": None, "decoder": None})
        self.library = None
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        named = {i: t for t, i in (vocab | special).items()}
        self.tokens = [named.get(i) for i in range(max(named) + 1)]
        self.special = special
        self.cut_special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.end = spec["model"]["end_of_word_suffix"]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut, self.cut_lines = regex.compile(pattern).findall, regex.compile(pattern + r"|\n").findall
        letters = byte_letters()
        self.first = [vocab[x] for x in letters]
        self.last = [vocab[x + self.end] for x in letters]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]]
        made = {ab: r for r, (_, _, ab) in enumerate(pairs)}
        if len(made) < len(pairs) or any(max(made.get(a, -1), made.get(b, -1)) >= r for r, (a, b, _) in enumerate(pairs)):
            raise ValueError("a merge may only use what earlier merges made, each of them once")
        self.by_rank = np.array(pairs, np.int32).reshape(-1, 3)
        keys = self.by_rank[:, 0].astype(np.int64) << 20 | self.by_rank[:, 1]
        self.ranks = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.ranks]
        self.numerals = list(map(str, range(len(self.tokens))))
        self.reset()

    def reset(self, more: int = 0) -> None:
        """Empty the caches; there is room for CACHE_SIZE words and a block's."""
        self.room = 2 * CACHE_SIZE + more
        self.table = common.HashTable(self.room)
        self.ids = common.Ragged()  # of words
        self.parts = {"\n": 0}  # number of each pre-token in runs
        self.runs = common.Ragged()
        self.runs.append(np.zeros(0), np.zeros(1, np.int64))

    def pretokens(self, word: str) -> list[str]:
        """Pre-tokens of a word that holds no special token."""
        if word.isascii() or not _PLAIN.search(word):
            return self.cut(word.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.rules)
        norm = self.library.normalizer.normalize_str(word)
        byte = {c: b for b, c in enumerate(byte_letters())}
        return [bytes(byte[c] for c in p).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; -1 where there is none."""
        out = np.empty(len(left), np.int32)
        for i in range(0, len(left), 1 << 17):
            a, b = left[i : i + (1 << 17)], right[i : i + (1 << 17)]
            key = a.astype(np.int64) << 20 | b
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[i : i + len(a)] = np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], -1)
        return out

    def merge(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens, all merged together, one after the other, and how many each
        has. Meanwhile a -1 stands between pre-tokens, and -2 where a symbol was merged into the
        one before it."""
        if not names:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        raw = np.frombuffer(("\n" + "\n".join(names) + "\n").encode(), np.uint8)
        symbols = np.array(self.first, np.int32)[raw]
        ends = np.flatnonzero(raw == 10)
        symbols[ends[1:] - 1] = np.array(self.last, np.int32)[raw[ends[1:] - 1]]
        symbols[ends] = -1
        after = np.arange(1, len(symbols) + 1, dtype=np.int32)
        before = np.arange(-1, len(symbols) - 1, dtype=np.int32)
        # The index: for each rank its first places, a slice of one sorted array, and later ones.
        ranks = self.rank_of(symbols[:-1], symbols[1:])
        places = np.flatnonzero(ranks >= 0).astype(np.int32)
        order = np.argsort(ranks[places], kind="stable")
        places, ranks = places[order], ranks[places[order]]
        found, begins = np.unique(ranks, return_index=True)
        initial = dict(zip(found.tolist(), np.split(places, begins[1:]), strict=True)) if len(found) else {}
        later: dict[int, list[int]] = defaultdict(list)
        active = list(initial)
        heapq.heapify(active)
        none = np.zeros(0, np.int32)
        while active:
            rank = heapq.heappop(active)
            a, b, ab = self.by_rank[rank].tolist()
            at = initial.pop(rank, none)
            if rank in later:
                at = np.concatenate([at, np.array(later.pop(rank), np.int32)])
            to = after[at]
            # Places are stale once one of their symbols was merged away.
            there = (symbols[at] == a) & (symbols[to] == b)
            at, to = at[there], to[there]
            if a == b and len(at) > 1:  # of overlapping places the first counts
                taken, free = [], -1
                for i, j in sorted(set(zip(at.tolist(), to.tolist(), strict=True))):
                    if i >= free:
                        taken.append((i, j))
                        free = j + 1
                at, to = np.array(taken, np.int32).T
            if not len(at):
                continue
            right = after[to]
            symbols[at], symbols[to] = ab, -2
            after[at], before[right] = right, at
            left = before[at]
            where = np.concatenate([left, at])
            news = self.rank_of(np.concatenate([symbols[left], symbols[at]]), np.concatenate([symbols[at], symbols[right]]))
            for r, i in zip(news[news >= 0].tolist(), where[news >= 0].tolist(), strict=True):
                if r not in later and r not in initial:
                    heapq.heappush(active, r)
                later[r].append(i)
        symbols = symbols[symbols != -2]
        ends = np.flatnonzero(symbols == -1)
        return symbols[symbols != -1], np.diff(ends) - 1

    def learn(self, words: list[str]) -> None:
        """Append the ids of words (with the blanks after them) to the cache."""
        odd = {}
        for k in [k for k, w in enumerate(words) if _PLAIN.search(w) or self.cut_special and self.cut_special.search(w)]:
            odd[k] = [y for x in self.cut_special.split(words[k]) if x for y in ([x] if x in self.special else self.pretokens(x))] if self.cut_special else self.pretokens(words[k])
            words[k] = "\n"
        flat = self.cut_lines("\n".join([w.rstrip(" \t\n\r\x0b\x0c") for w in words]).lower() + "\n")
        if odd:
            lines = iter(odd.items())
            k, own = next(lines)
            out, line = [], 0
            for p in flat:
                if p == "\n":
                    if line == k:
                        out += own
                        k, own = next(lines, (-1, []))
                    line += 1
                out.append(p)
            flat = out
        new = list(dict.fromkeys([p for p in flat if p not in self.parts and p not in self.special]))
        self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new)), strict=True))
        self.runs.append(*self.merge(new))
        for p in self.special.keys() & set(flat) - self.parts.keys():
            self.parts[p] = len(self.parts)
            self.runs.append(np.array([self.special[p]]), np.array([1]))
        numbers = np.fromiter(map(self.parts.__getitem__, flat), np.int64, len(flat))
        marks = numbers == self.parts["\n"]
        ids, lengths = self.runs.gather(numbers[~marks])
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = total[np.flatnonzero(marks) - np.arange(len(words))]
        self.ids.append(ids, np.diff(ends, prepend=0))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin (one more for the
        end)."""
        raw, at = common.utf8(texts)
        inside = ~_BLANK[raw]
        starts = common.word_starts(inside, at)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        parts = [np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)]
        for lo, hi in common.segments(~inside, at):
            i, j = np.searchsorted(starts, [lo, hi])
            if i < j:
                lo = int(starts[i])
                parts[0][i:j], parts[1][i:j] = common.hash_pairs(raw[lo:hi], starts[i:j] - lo, inside[lo:hi])
        if self.table.used > CACHE_SIZE:
            self.reset()
        found = self.table.find(*parts)
        if len(missing := np.flatnonzero(found < 0)):
            one = missing[common.distinct_pairs(parts[0][missing], parts[1][missing])]
            if self.table.used + len(one) > self.room:
                self.reset(len(one))
                return self.encode_block(texts)
            ends = np.append(starts[1:], len(raw))
            names = [raw[i:j].tobytes().decode() for i, j in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            self.table.add(parts[0][one], parts[1][one])
            self.learn(names)
            found[missing] = self.table.find(parts[0][missing], parts[1][missing])
        ids, lengths = self.ids.gather(found)
        return ids, np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[np.searchsorted(starts, at)]

    def encode(self, text: str) -> list[int]:
        return self.encode_block(pa.array([text]))[0].tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.tokens.__getitem__, ids))


_workers: dict[str, WordBPE] = {}


def encode_decode(docs: DataFrame, model: str = MODEL, outputs: tuple[str, ...] = ("ids_sha256", "decoded_sha256")) -> DataFrame:
    """doc_id and n_tokens of every row, with those of ids (array), decoded (text), ids_sha256 and
    decoded_sha256 that ``outputs`` names, in this order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kinds = {"ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = f"doc_id {kind}, n_tokens bigint, " + ", ".join(f"{c} {kinds[c]}" for c in outputs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (bpe := _workers.get(model)) is None:
            bpe = _workers[model] = WordBPE(model)
        digest = lambda s: sha256(s.encode()).hexdigest()

        def flush(held: list) -> pa.RecordBatch:
            rows = pa.concat_arrays([i for i, _ in held])
            ids, at = bpe.encode_block(pa.concat_arrays([t.cast(pa.large_string()) for _, t in held]))
            made = {c: [] for c in kinds if c in outputs and c != "ids"}
            ends = at.tolist()
            for i, j in zip(ends, ends[1:], strict=False):
                x = ids[i:j].tolist()
                text = bpe.decode(x)
                for c, values in made.items():
                    values.append(text if c == "decoded" else digest(text) if c == "decoded_sha256" else digest(" ".join(map(bpe.numerals.__getitem__, x))))
            own = {c: pa.array(v, pa.string()) for c, v in made.items()}
            own["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            return pa.RecordBatch.from_arrays([rows, pa.array(np.diff(at), pa.int64()), *(own[c] for c in outputs)], ["doc_id", "n_tokens", *outputs])

        # Blocks of texts, over the borders of batches: the index takes in many words at once.
        held, size = [], 0
        for b in batches:
            for i, j in common.blocks(b.column(1), BLOCK_BYTES):
                held.append((b.column(0).slice(i, j - i), b.column(1).slice(i, j - i)))
                size += held[-1][1].nbytes
                if size >= BLOCK_BYTES:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    return common.map_batches(docs.select("doc_id", "text"), work, schema)
