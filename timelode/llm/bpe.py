"""Byte-level BPE by speculation and verification, and its inverse.

A word's tokens are first guessed by greedy longest match. A row of tokens is the BPE encoding of a
word exactly when each token encodes to itself and every adjacent pair is compatible, that is, merging
would not have crossed the border between the two. Both are read off the merge table: the first once per
vocabulary, the second for all adjacent pairs of all new words at once, in numpy. Only words with an
incompatible pair are merged step by step.

Texts are cut before each space that a non-space follows, where the pre-tokenizer always cuts. The
distinct pieces of a slice of texts are encoded once, and kept, within a bound, for later slices; ids of
whole texts are gathered from that store.

Cases: null and empty texts give no ids; the special token's string gives its id, as in the tokenizers
library; texts of any length are encoded whole, and words of any length in segments that are verified and joined; ids that spell no valid UTF-8 decode with U+FFFD.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelode.llm._words import _BYTE, _power
from timelode.llm._common import lean, row_slices, small_batches, table, text_buffers

TOKENIZER = "byte_bpe_50k.json"
#: Distinct pieces kept by a worker; beyond that it starts anew. Bounds memory, not results.
PIECES_KEPT = 60_000
#: Texts are encoded in slices, and long texts in parts, of about so many bytes.
ENCODE_BYTES = 2 << 20
#: Longer words, in bytes, are encoded in segments of so many bytes.
LONG_WORD, SEGMENT = 192, 48
#: Code points below this are classed alike by every Unicode version in use; pieces with others are split by the library itself.
SETTLED = "԰"

#: No such merge or token.
NONE = 1 << 60

#: Bytes that white space can begin with, among ASCII.
ODD = np.zeros(256, bool)
ODD[[*range(9, 14), *range(28, 33)]] = True

#: First bytes of the white space beyond ASCII.
WIDE = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)
#: Bytes that, after a run of letters, are a word of their own at a piece's end.
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?)")] = True
#: UTF-8 of code points below SETTLED has no byte from this one on, but for the last of them.
UNSETTLED = 0xD4

_CUT = re.compile(r" (?=\S)")
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _file(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    out.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


class Index:
    """Distinct uint64 keys to integers, by open addressing, for whole arrays of keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(8, int(len(keys) * 6).bit_length())
        self.key, self.value = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = self.value[slot] == NONE
            take, first = np.unique(np.where(free, slot, -1), return_index=True)
            first = first[take >= 0]
            self.key[slot[first]], self.value[slot[first]] = keys[todo[first]], values[todo[first]]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo, slot = todo[rest], slot[rest]
            slot = np.where(self.value[slot] != NONE, (slot + 1) & ((1 << self.bits) - 1), slot)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or NONE."""
        keys = keys.astype(np.uint64, copy=False)
        slot = self._slot(keys)
        out = self.value[slot]
        wrong = np.flatnonzero((out != NONE) & (self.key[slot] != keys))
        slot = slot[wrong]
        while len(wrong):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            value = self.value[slot]
            settled = (value == NONE) | (self.key[slot] == keys[wrong])
            out[wrong[settled]] = value[settled]
            wrong, slot = wrong[~settled], slot[~settled]
        return out


class Runs:
    """Runs of ids in one growing array."""

    def __init__(self) -> None:
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0
        self.at, self.count, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(counts) > len(self.at):
            self.at, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.count))
        self.ids[self.used : self.used + len(ids)] = ids
        self.at[self.n : self.n + len(counts)] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + len(counts)] = counts
        self.used += len(ids)
        self.n += len(counts)

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the runs in a row, where each run ends)."""
        count = self.count[which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.at[which] - (ends - count), count) + np.arange(total)], ends


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): (sums[j] - sums[i]) * down[i] is a hash of data[i:j], wherever it stands."""
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return sums, down


class Codec:
    """Encoder and decoder of one tokenizers file (byte-level BPE without normaliser)."""

    def __init__(self, name: str = TOKENIZER) -> None:
        from tokenizers.pre_tokenizers import ByteLevel

        with open(_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _alphabet()
        spell = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * self.size
        for t, i in vocab.items():
            spelled[i] = spell(t)
        for t, i in self.special.items():
            spelled[i] = t.encode()
        self.byte_id = [0] * 256
        for t, i in vocab.items():
            if len(spelled[i]) == 1:
                self.byte_id[spelled[i][0]] = i
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        if len(set(made.tolist())) != len(made):
            raise ValueError("two merges make the same token: pairs can't be verified")
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.left[made], self.right[made] = left, right
        self.rank = np.full(self.size, -1)
        self.rank[made] = np.arange(len(made))
        keys = left * self.size + right
        self.pairs, self.made = Index(keys.astype(np.uint64), np.arange(len(made))), made
        self.byte_ids = np.array(self.byte_id)
        self.merge = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made, strict=True))}
        own = self._compatible(left, right, np.arange(len(made)))
        usable = np.ones(self.size, bool)
        for a, b, m, ok in zip(left.tolist(), right.tolist(), made.tolist(), own.tolist(), strict=True):
            usable[m] = ok and usable[a] and usable[b]
        tokens = [i for t, i in vocab.items() if usable[i]]
        size = np.array([len(spelled[i]) for i in tokens])
        data, end = np.frombuffer(b"".join(spelled[i] for i in tokens), np.uint8), np.cumsum(size)
        sums, down = rolling(data)
        at = end - size
        self.spellings = Index(((sums[end] - sums[at]) * down[at]) ^ size.astype(np.uint64), np.array(tokens))
        #: The longest usable token that begins with two given bytes.
        self.longest = np.ones(1 << 16, np.int64)
        long = size > 1
        np.maximum.at(self.longest, data[at[long]].astype(np.int64) << 8 | data[at[long] + 1], size[long])
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_at = np.concatenate([[0], np.cumsum([len(s) for s in spelled])]).astype(np.int64)
        self.words = regex.compile(_WORDS)
        self.library = ByteLevel(add_prefix_space=False, use_regex=True)
        self.special_at = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.failed = self.seen = 0
        self._clear()

    def _clear(self) -> None:
        self.piece, self.word = pa.array([], pa.string()), pa.array(list(self.special), pa.string())
        self.pieces_kept, self.words_kept = Runs(), Runs()
        self.words_kept.add(np.array(list(self.special.values()), np.int64), np.ones(len(self.special), np.int64))

    def _merge_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or NONE."""
        return self.pairs.find(a * self.size + b)

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each pair: whether merging leaves the border between a and b alone, up to the merge of rank limit.

        Backwards through the merges of both: the pieces that meet at the border merge across it if a rule for
        them is due before the merge that takes one of them up. Of equal ranks the left one is due first.
        """
        limit = np.full(len(a), NONE) if limit is None else limit
        ok, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            crossed = self._merge_of(a, b) < limit
            ok[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            undo_left = (ra > rb)[go]
            a, b, ra, rb, live = a[go], b[go], ra[go], rb[go], live[go]
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
        return ok

    def _greedy(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words they are of), by longest match from the left, of the words data[at:end], all words a step at a time."""
        sums, down = rolling(data)
        word, tokens, words = np.arange(len(at)), [], []
        at = at.copy()
        while len(word):
            two = data[at].astype(np.int64) << 8 | np.where(at + 1 < end, data[np.minimum(at + 1, len(data) - 1)], 0)
            size = np.minimum(np.where(at + 1 < end, self.longest[two], 1), end - at)
            token, todo = np.full(len(word), -1), np.arange(len(word))
            while len(todo):
                i, n = at[todo], size[todo]
                found = self.spellings.find(((sums[i + n] - sums[i]) * down[i]) ^ n.astype(np.uint64))
                hit = found != NONE
                token[todo[hit]] = found[hit]
                todo = todo[~hit]
                size[todo] -= 1
            tokens.append(token)
            words.append(word)
            at = at + size
            more = at < end
            word, at, end = word[more], at[more], end[more]
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return np.concatenate(tokens)[order], word[order]

    def _merge_long(self, word: bytes) -> list[int]:
        """The exact encoding of one word, in n log n: lowest rank first, of equal ranks the leftmost."""
        size, merge, n = self.size, self.merge, len(word)
        part, after, before = array("i", [self.byte_id[b] for b in word]), array("i", [*range(1, n), -1]), array("i", [-1, *range(n - 1)])
        # Rank and place as one number; an entry holds if its place still has a pair of that rank.
        heap = [m[0] << 32 | i for i in range(n - 1) if (m := merge.get(part[i] * size + part[i + 1]))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if part[i] < 0 or j < 0 or not (m := merge.get(part[i] * size + part[j])) or m[0] != top >> 32:
                continue
            part[i], part[j] = m[1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (m := merge.get(part[p] * size + part[q])):
                    heapq.heappush(heap, m[0] << 32 | p)
        return [t for t in part if t >= 0]

    def _merge_short(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, words they are of): the exact encodings of many short words, one merge of each at a time."""
        n = end - at
        wide = int(n.max())
        column = np.arange(wide)
        inside = column < n[:, None]
        part = np.where(inside, self.byte_ids[data[np.minimum(at[:, None] + column, len(data) - 1)]], -1)
        rank = np.full(part.shape, NONE)
        both = inside[:, 1:]
        rank[:, :-1][both] = self._merge_of(part[:, :-1][both], part[:, 1:][both])
        row, done, rows = np.arange(len(n)), [], []
        while len(row):
            best = rank.argmin(axis=1)
            each = np.arange(len(row))
            low = rank[each, best]
            end_here = low == NONE
            if end_here.any():
                p = part[end_here]
                full = p >= 0
                done.append(p[full])
                rows.append(np.repeat(row[end_here], full.sum(axis=1)))
                go = ~end_here
                part, rank, row, best, low = part[go], rank[go], row[go], best[go], low[go]
                each = np.arange(len(row))
                if not len(row):
                    break
            source = np.minimum(column + (column > best[:, None]), wide - 1)
            part, rank = np.take_along_axis(part, source, 1), np.take_along_axis(rank, source, 1)
            part[:, -1], rank[:, -1] = -1, NONE
            part[each, best] = self.made[low]
            for side in (best - 1, best):
                a, b = part[each, np.maximum(side, 0)], part[each, np.minimum(side + 1, wide - 1)]
                there = (side >= 0) & (side + 1 < wide) & (b >= 0)
                value = np.full(len(row), NONE)
                value[there] = self._merge_of(a[there], b[there])
                rank[each[side >= 0], side[side >= 0]] = value[side >= 0]
        row = np.concatenate(rows)
        order = np.argsort(row, kind="stable")
        return np.concatenate(done)[order], row[order]

    def _exact(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The exact encoding of each of the parts data[at:end]."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(at)
        n = end - at
        for k in range(0, len(some := np.flatnonzero(n <= 2 * SEGMENT)), 4096):
            own = some[k : k + 4096]
            tokens, owner = self._merge_short(data, at[own], end[own])
            for w, t in zip(own.tolist(), np.split(tokens, np.searchsorted(owner, np.arange(1, len(own)))), strict=True):
                out[w] = t
        for w in np.flatnonzero(n > 2 * SEGMENT).tolist():
            out[w] = np.array(self._merge_long(data[at[w] : end[w]].tobytes()), np.int64)
        return out

    def _encode_run(self, data: np.ndarray) -> np.ndarray:
        """The tokens of one long word: its segments are encoded by themselves, and the pairs at their seams verified; where a pair is incompatible the two segments are encoded as one."""
        at = np.arange(0, len(data), SEGMENT)
        parts = self._exact(data, at, np.append(at[1:], len(data)))
        while len(parts) > 1:
            size = np.diff(np.append(at, len(data)))
            ok = self._compatible(np.array([p[-1] for p in parts[:-1]]), np.array([p[0] for p in parts[1:]]))
            if ok.all():
                break
            # A group of segments that grew before grows by as many again, so that rounds are few.
            for k in np.flatnonzero(~ok).tolist():
                reach = 2 * int(size[k] + size[k + 1]) // SEGMENT if max(size[k], size[k + 1]) > SEGMENT else 0
                ok[k : k + reach] = False
            first = np.flatnonzero(np.append(True, ok))
            begin = at[first]
            again = np.flatnonzero(np.diff(np.append(first, len(parts))) > 1)
            made = self._exact(data, begin[again], np.append(begin[1:], len(data))[again])
            parts = [parts[k] for k in first.tolist()]
            for k, p in zip(again.tolist(), made, strict=True):
                parts[k] = p
            at = begin
        return np.concatenate(parts)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in a row, number of each word's ids) of distinct words."""
        data, end = text_buffers(words)
        at, end = end[:-1], end[1:]
        n = end - at
        usual = np.flatnonzero(n <= LONG_WORD)
        flat, word = self._greedy(data, at[usual], end[usual]) if len(usual) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        word = usual[word]
        same = np.flatnonzero(word[:-1] == word[1:])
        pair, which = np.unique(flat[same] * self.size + flat[same + 1], return_inverse=True)
        ok = self._compatible(pair // self.size, pair % self.size)[which]
        wrong = np.zeros(len(words), bool)
        wrong[word[same[~ok]]] = True
        self.seen += len(words)
        self.failed += int(wrong.sum())
        keep = ~wrong[word]
        tokens, owners = [flat[keep]], [word[keep]]
        for low, high in ((0, 8), (8, 12), (12, 20), (20, 48)):
            if len(some := np.flatnonzero(wrong & (n > low) & (n <= high))):
                t, w = self._merge_short(data, at[some], end[some])
                tokens.append(t)
                owners.append(some[w])
        for w in np.flatnonzero(wrong & (n > 48)).tolist():
            tokens.append(np.array(t := self._merge_long(data[at[w] : end[w]].tobytes()), np.int64))
            owners.append(np.full(len(t), w))
        for w in np.flatnonzero(n > LONG_WORD).tolist():
            tokens.append(t := self._encode_run(data[at[w] : end[w]]))
            owners.append(np.full(len(t), w))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order], np.bincount(owner, minlength=len(words))

    def _split(self, piece: str) -> list[str]:
        if piece.isascii() or max(piece) < SETTLED:
            return self.words.findall(piece)
        return [piece[a:b] for _, (a, b) in self.library.pre_tokenize_str(piece)]

    def _words_of(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the words of all pieces in a row, number of each piece's words). Runs of settled letters, alone or with a mark behind, are told by columns; other pieces are split one by one."""
        bare = pc.if_else(pc.starts_with(pieces, " "), pc.utf8_slice_codeunits(pieces, 1), pieces)
        data, at = text_buffers(bare)
        n = np.diff(at)
        high = np.concatenate([[0], np.cumsum(data >= UNSETTLED)])
        settled = (high[at[1:]] == high[at[:-1]]) & (n > 0)
        letters = settled & np.asarray(pc.utf8_is_alpha(bare))
        marked = settled & ~letters
        marked[marked] = MARK[data[at[1:][marked] - 1]]
        some = np.flatnonzero(marked)
        marked[some] = np.asarray(pc.utf8_is_alpha(pc.utf8_slice_codeunits(bare.take(pa.array(some)), 0, -1)))
        some, other = pieces.take(pa.array(np.flatnonzero(marked))), np.flatnonzero(~letters & ~marked)
        split = [[p] if p in self.special else self._split(p) for p in pieces.take(pa.array(other)).to_pylist()]
        counts = np.where(marked, 2, 1)
        counts[other] = [len(ws) for ws in split]
        # Words by kind of piece, and where each stands in the row.
        kinds = pieces.filter(pa.array(letters)), pc.utf8_slice_codeunits(some, 0, -1), pc.utf8_slice_codeunits(some, -1), pa.array([w for ws in split for w in ws], pa.string())
        first = np.cumsum(counts) - counts
        own = np.repeat(~letters & ~marked, counts)
        stands = np.concatenate([first[letters], first[marked], first[marked] + 1, np.flatnonzero(own)])
        order = np.empty(len(stands), np.int64)
        order[stands] = np.arange(len(stands))
        return pa.concat_arrays(kinds).take(pa.array(order)), counts

    def _pieces(self, pieces: pa.Array) -> np.ndarray:
        """Places in the store of pieces; new ones are encoded together."""
        place = pc.index_in(pieces, self.piece)
        if place.null_count:
            new = pieces.filter(place.is_null()).unique()
            flat, counts = self._words_of(new)
            coded = flat.dictionary_encode()
            index = pc.index_in(coded.dictionary, self.word)
            if index.null_count:
                fresh = coded.dictionary.filter(index.is_null())
                self.words_kept.add(*self._encode_words(fresh))
                self.word = pa.concat_arrays([self.word, fresh])
                index = pc.index_in(coded.dictionary, self.word)
            ids, ends = self.words_kept.gather(np.asarray(index)[np.asarray(coded.indices)].astype(np.int64))
            ends = np.concatenate([[0], ends])
            self.pieces_kept.add(ids, np.diff(ends[np.concatenate([[0], np.cumsum(counts)])]))
            self.piece = pa.concat_arrays([self.piece, new])
            place = pc.index_in(pieces, self.piece)
        return np.asarray(place).astype(np.int64)

    def _gather(self, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat, ends = self.pieces_kept.gather(place)
        return flat, np.concatenate([[0], ends])[first]

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text with special tokens or unusual white space."""
        out = []
        for k, part in enumerate(self.special_at.split(text) if self.special_at else [text]):
            if k % 2:
                out.append(part)
            elif part:
                cut = _CUT.split(part)
                out += [cut[0]] if cut[0] else []
                out += [" " + c for c in cut[1:]]
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, int64 offsets of the texts) of a string column."""
        if len(self.piece) > PIECES_KEPT or len(self.word) > PIECES_KEPT:
            self._clear()
        column = pc.fill_null(column, "") if column.null_count else column
        n = len(column)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        lists = pc.split_pattern(column.cast(pa.string()), " ")
        first = np.asarray(lists.offsets).astype(np.int64)
        first = first - first[0]
        coded = lists.flatten().dictionary_encode()
        code, distinct = np.asarray(coded.indices), coded.dictionary
        data, at = text_buffers(distinct)
        lead = np.where(np.diff(at) > 0, data[np.minimum(at[:-1], max(len(data) - 1, 0))] if len(data) else 32, 32)
        odd = ODD[lead]
        for k in np.flatnonzero(np.isin(lead, WIDE)).tolist():
            odd[k] = distinct[k].as_py()[0].isspace()
        odd_rows = np.logical_or.reduceat(odd[code], first[:-1])
        for s in self.special:
            odd_rows |= np.asarray(pc.match_substring(column, s))
        odd_rows = np.flatnonzero(odd_rows)
        cuts = [self._cut(t) for t in column.take(pa.array(odd_rows)).to_pylist()]
        at_start = distinct.take(pa.array(code[first[:-1]]))
        known = self._pieces(pa.concat_arrays([pc.binary_join_element_wise("", distinct, " "), at_start, pa.array([p for c in cuts for p in c], pa.string())]))
        place = known[: len(distinct)][code]
        place[first[:-1]] = known[len(distinct) :][:n]
        if len(odd_rows):
            own = np.diff(first)
            own[odd_rows] = 0
            keep = np.repeat(own > 0, np.diff(first))
            counts = own.copy()
            counts[odd_rows] = [len(c) for c in cuts]
            start = np.concatenate([[0], np.cumsum(counts)])
            whole = np.zeros(start[-1], np.int64)
            there = np.repeat(own > 0, counts)
            whole[there] = place[keep]
            whole[~there] = known[len(distinct) + n :]
            place, first = whole, start
        return self._gather(place, first)

    def encode_long(self, text: np.ndarray) -> np.ndarray:
        """The ids of one text, given as bytes, encoded in parts of about ENCODE_BYTES: cut where the pre-tokenizer cuts, before a space that a visible ASCII character follows."""
        cut = [0]
        for k in range(ENCODE_BYTES, len(text), ENCODE_BYTES) if not any(" " in s for s in self.special) else ():
            near = text[k : k + ENCODE_BYTES]
            at = np.flatnonzero((near[:-1] == 32) & (near[1:] > 32) & (near[1:] < 127))
            if len(at):
                cut.append(k + int(at[0]))
        parts = (text[a:b].tobytes().decode() for a, b in zip(cut, [*cut[1:], len(text)], strict=True))
        return np.concatenate([self.encode(pa.array([p], pa.string()))[0] for p in parts])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """The texts whose ids are ids[offsets[i]:offsets[i+1]]."""
        length, parts = np.diff(self.spelled_at), []
        for k in range(0, len(ids), ENCODE_BYTES // 4):
            part = ids[k : k + ENCODE_BYTES // 4]
            size = length[part]
            ends = np.cumsum(size)
            parts.append(self.spelled[np.repeat(self.spelled_at[part] - (ends - size), size) + np.arange(int(ends[-1]))].tobytes())
        flat, at = b"".join(parts), np.concatenate([[0], np.cumsum(length[ids])])[offsets].tolist()
        return [flat[i:j].decode("utf-8", "replace") for i, j in zip(at, at[1:], strict=False)]


@lru_cache(maxsize=4)
def codec(name: str = TOKENIZER) -> Codec:
    """One codec per worker process and file."""
    return Codec(name)


def encoded_slices(column: pa.Array, name: str = TOKENIZER) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, ids, offsets) of each slice of a text column."""
    own = codec(name)
    data, offsets = text_buffers(column)
    for i, j in row_slices(offsets, ENCODE_BYTES):
        if j - i == 1 and offsets[j] - offsets[i] > 2 * ENCODE_BYTES:
            ids = own.encode_long(data[offsets[i] : offsets[j]])
            yield i, j, ids, np.array([0, len(ids)])
        else:
            yield i, j, *own.encode(column.slice(i, j - i))


def encode(df: DataFrame, text: str = "text", out: str = "ids", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with its text column replaced by array<int> ids, at the end, as the tokenizers library makes them without added special tokens."""
    kept = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            for i, j, ids, at in encoded_slices(batch.column(batch.num_columns - 1), tokenizer):
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(kept))), values], [*kept, out])

    src = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text}`"))
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    return src.mapInArrow(lean(run), StructType([*src.schema.fields[:-1], StructField(out, ArrayType(IntegerType()))]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", tokenizer: str = TOKENIZER) -> DataFrame:
    """df with the text that its array<int> ids spell, special tokens included, in one more column; null ids give an empty text."""
    kept = [c for c in df.columns if c not in (ids, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer)
        for batch in small_batches(batches, 1024):
            column = batch.column(batch.num_columns - 1)
            count = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
            texts = own.decode(np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(count)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, ids, out])

    src = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{ids}`"))
    from pyspark.sql.types import StringType, StructField, StructType

    return src.mapInArrow(lean(run), StructType([*src.schema.fields, StructField(out, StringType())]))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; the digests are taken from the operator's ids and texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decode(encode(docs))
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
