"""Rank-synchronous pair merging over ragged numpy arrays.

All sequences of a batch lie end to end in one array of symbols. In each round
every sequence finds its lowest-ranked neighbouring pair and merges all its
occurrences at once; sequences without a known pair leave the batch. Only pairs
beside a merge are looked up again. That equals the one-at-a-time,
leftmost-first procedure unless a merge makes a pair whose rank is not above
its own: sequences in which such a symbol was made twice in a round are redone
one merge at a time.

A long sequence would need a round for each of its ranks, so it is merged as
overlapping blocks, which are sequences of the batch like any other. Two
neighbouring blocks are joined after a token that both have at the same place.
What lies between two such places is merged alike alone, in its blocks and in
the whole: the first merge across a place would also be the next one in a block
that goes on beyond it. Where two blocks share no token, longer ones are tried,
and in the end the plain procedure.
"""

from __future__ import annotations

import base64
import heapq

import numpy as np

NONE = np.int32(2**31 - 1)
#: Symbols beyond which a sequence is merged by blocks; symbols of a block, and between the beginnings of two, in turn.
LONG, BLOCKS = 256, ((128, 80), (1024, 512))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


class PairTable:
    """Hash of pairs (left, right) -> (rank, merged symbol), for arrays of pairs."""

    BITS = 19

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        rows = np.arange(len(keys))
        self.levels = []
        for mix in _MIX * 4:
            if not len(rows):
                break
            slot = self._slot(keys[rows], mix)
            table = np.full(1 << self.BITS, -1, np.int32)
            table[slot] = rows
            self.levels.append((mix, table))
            rows = rows[table[slot] != rows]
        assert not len(rows)
        self.keys = np.append(keys, np.uint64(2**64 - 1))
        self.rank = np.append(rank.astype(np.int32), NONE)
        self.merged = np.append(merged.astype(np.int32), np.int32(-1))

    def _slot(self, keys: np.ndarray, mix: int) -> np.ndarray:
        return ((keys * np.uint64(mix)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Row of each pair; the last row stands for none."""
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        found = np.full(len(keys), -1, np.int64)
        for k, (mix, table) in enumerate(self.levels):
            if k == 0:
                at = table[self._slot(keys, mix)]
                found = np.where(self.keys[at] == keys, at, -1).astype(np.int64)
            else:
                rest = np.flatnonzero(found < 0)
                at = table[self._slot(keys[rest], mix)]
                found[rest] = np.where(self.keys[at] == keys[rest], at, -1)
        return np.where(found < 0, len(self.keys) - 1, found)


class Merger:
    """The pairs of a vocabulary. ``rank`` of a symbol is that of the merge which makes it; -1 for first symbols."""

    def __init__(self, left, right, rank, merged, n_symbols: int):
        left, right, rank, merged = (np.asarray(x, np.int64) for x in (left, right, rank, merged))
        self.pairs = PairTable(left, right, rank, merged)
        of = np.full(n_symbols, -1, np.int64)
        of[merged] = rank
        self.unsafe = np.zeros(n_symbols, bool)
        self.unsafe[left[rank <= of[left]]] = True
        self.unsafe[right[rank <= of[right]]] = True

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of each sequence, end to end, and their number."""
        starts = np.cumsum(lengths) - lengths
        long = lengths > LONG
        short, open_ = np.flatnonzero(~long), np.flatnonzero(long)
        seq, sym, _ = self._exact(symbols[np.repeat(~long, lengths)], lengths[short])
        parts = [(short[seq], sym)]
        for block, step in BLOCKS:
            if len(open_):
                seq, sym, open_ = self._blocks(symbols, starts, lengths, open_, block, step)
                parts.append((seq, sym))
        for i in open_.tolist():
            own = self.one_by_one(symbols[starts[i] : starts[i] + lengths[i]])
            parts.append((np.full(len(own), i), own))
        seq, sym = (np.concatenate(x) for x in zip(*parts, strict=True))
        return sym[np.argsort(seq, kind="stable")], np.bincount(seq, minlength=len(lengths))

    def _exact(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, symbol, place of its first) of what is left of all sequences."""
        seq, sym, place, redo = self._rounds(symbols, lengths, False)
        if not len(redo):
            return seq, sym, place
        starts = np.cumsum(lengths) - lengths
        own, size = np.arange(int(lengths[redo].sum())), lengths[redo]
        own += np.repeat(starts[redo] - (np.cumsum(size) - size), size)
        seq2, sym2, place2, _ = self._rounds(symbols[own], size, True)
        keep = np.ones(len(lengths), bool)
        keep[redo] = False
        keep = keep[seq]
        return np.concatenate((seq[keep], redo[seq2])), np.concatenate((sym[keep], sym2)), np.concatenate((place[keep], own[place2]))

    def _blocks(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, long: np.ndarray, most: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, symbol) of the long sequences by joined blocks, and the sequences that cannot be joined."""
        count = np.maximum(1, -(-(lengths[long] - (most - step)) // step))
        owner = np.repeat(long, count)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = starts[owner] + nth * step
        size = np.minimum(most, starts[owner] + lengths[owner] - begin)
        offset = np.cumsum(size) - size
        place = np.repeat(begin - offset, size) + np.arange(int(size.sum()))
        block, sym, start = self._exact(symbols[place], size)
        order = np.lexsort((start, block))
        block, sym, start = block[order], sym[order], place[start[order]]
        end = np.append(start[1:], 0)
        last = np.append(block[1:] != block[:-1], True)
        end[last] = (begin + size)[block[last]]
        # a token that block b and the next one both have: the first such gives the end of b and the beginning of b + 1
        key = start * (most + 1) + (end - start)
        by = np.lexsort((block, key))
        twin = np.flatnonzero((key[by[1:]] == key[by[:-1]]) & (block[by[1:]] == block[by[:-1]] + 1) & (owner[block[by[1:]]] == owner[block[by[:-1]]]))
        left, cut = block[by[twin]], end[by[twin]]
        until = np.full(len(owner), -1, np.int64)
        until[left[::-1]] = cut[::-1]
        final = np.append(owner[1:] != owner[:-1], True)
        until[final] = (begin + size)[final]
        since = np.append(0, until[:-1])
        since[nth == 0] = begin[nth == 0]
        failed = np.unique(owner[(until < 0) | (since >= until)])
        keep = (start >= since[block]) & (end <= until[block])
        keep &= ~np.isin(owner[block], failed)
        return owner[block[keep]], sym[keep], failed

    def _rounds(self, sym: np.ndarray, lengths: np.ndarray, single: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, symbol, place of its first) of what is left, and the sequences to redo with a single merge in each round."""
        seq = np.repeat(np.arange(len(lengths)), lengths)
        n, none = len(sym), len(self.pairs.keys) - 1
        sym, place, done = sym.astype(np.int32), np.arange(n), []
        redo = np.zeros(len(lengths), bool)
        row = np.full(n, none, np.int32)
        if n:
            inner = np.flatnonzero(seq[:-1] == seq[1:])
            row[inner] = self.pairs.find(sym[inner], sym[inner + 1])
        rank = self.pairs.rank[row]
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], seq[1:] != seq[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(sym))))
            over = least == NONE
            if over.any():
                done.append((seq[over], sym[over], place[over]))
                live = ~over
                sym, seq, place, row, rank, least = sym[live], seq[live], place[live], row[live], rank[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            if single:
                at = at[np.concatenate(([True], seq[at[1:]] != seq[at[:-1]]))]
            else:  # of overlapping occurrences every other one, from the left
                run = np.concatenate(([True], np.diff(at) != 1))
                began = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - began) % 2 == 0]
            made = self.pairs.merged[row[at]]
            sym[at] = made
            if not single:
                twice = np.concatenate((seq[at[1:]] == seq[at[:-1]], [False]))
                twice[1:] |= twice[:-1].copy()
                redo[seq[at[twice & self.unsafe[made]]]] = True
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at -= np.arange(len(at))
            sym, seq, place, row, rank = sym[keep], seq[keep], place[keep], row[keep], rank[keep]
            new = np.concatenate((at, at[at > 0] - 1))
            row[new], right = none, np.minimum(new + 1, len(sym) - 1)
            pair = (seq[new] == seq[right]) & (right > new)
            new, right = new[pair], right[pair]
            row[new] = self.pairs.find(sym[new], sym[right])
            for x in (at, np.maximum(at - 1, 0)):
                rank[x] = self.pairs.rank[row[x]]
        blank = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64))]
        return *(np.concatenate(x) for x in zip(*blank, *done, strict=True)), np.flatnonzero(redo)

    def one_by_one(self, symbols: np.ndarray) -> np.ndarray:
        """The plain procedure for one sequence: the lowest rank, of equal ones the leftmost, by a heap of pairs."""
        sym, n = symbols.tolist(), len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        row = self.pairs.find(symbols[:-1], symbols[1:])
        heap = [(int(self.pairs.rank[r]), i, int(r)) for i, r in enumerate(row.tolist()) if self.pairs.rank[r] != NONE]
        of = {i: r for _, i, r in heap}
        heapq.heapify(heap)
        while heap:
            _, i, r = heapq.heappop(heap)
            if of.get(i) != r:
                continue
            j = after[i]
            sym[i], sym[j], after[i] = int(self.pairs.merged[r]), -1, after[j]
            of.pop(i)
            of.pop(j, None)
            if after[j] < n:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n:
                    r = int(self.pairs.find(np.array([sym[a]]), np.array([sym[b]]))[0])
                    of.pop(a, None)
                    if (k := int(self.pairs.rank[r])) != NONE:
                        of[a] = r
                        heapq.heappush(heap, (k, a, r))
        return np.array([x for x in sym if x >= 0], np.int32)


def read_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class ByteMerger:
    """Byte-level vocabulary of a rank file: token ids are the ranks."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        rows = [(ranks[t[:i]], ranks[t[i:]], r, r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.ranks = ranks
        self.merger = Merger(*zip(*rows, strict=True), max(ranks.values()) + 1)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, end to end, and the number for each; a word that is a token is that token."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        rest = np.flatnonzero(whole < 0)
        parts = [words[i] for i in rest]
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        ids, n = self.merger.merge(self.first[np.frombuffer(b"".join(parts), np.uint8)], lengths)
        counts = np.ones(len(words), np.int64)
        counts[rest] = n
        out = np.empty(int(counts.sum()), np.int32)
        merged = np.repeat(whole < 0, counts)
        out[merged] = ids
        out[~merged] = whole[whole >= 0]
        return out, counts


class PieceMerger:
    """Unit counts of a sentencepiece BPE model without normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = {sp.id_to_piece(i): i for i in normal}
        order = {s: k for k, s in enumerate(sorted({-sp.get_score(i) for i in normal}))}
        symbols = dict(pieces)
        for c in sorted({c for p in pieces for c in p}):
            symbols.setdefault(c, n + len(symbols))
        top = max(symbols.values(), default=0) + 1
        rows = [(symbols[p[:i]], symbols[p[i:]], order[-sp.get_score(k)], k) for p, k in pieces.items() for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        self.merger = Merger(*zip(*rows, strict=True), top + 5)
        points = np.arange(0x110000)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
        self.symbol = (top + size).astype(np.int32)
        self.weight = np.ones(top + 5, np.int64)
        self.weight[top + 1 :] = np.arange(1, 5)  # byte fallback
        for c, k in symbols.items():
            if len(c) == 1:
                self.symbol[ord(c)] = k
                if k >= n:
                    self.weight[k] = len(c.encode())
        self.newline_alone = not any("\n" in p for p in pieces)
        self.newline_weight = int(self.weight[self.symbol[10]])
        assert not any(p.lstrip("\u2581").count("\u2581") for p in pieces), "a piece joins words"

    def count(self, words: list[str]) -> np.ndarray:
        """Units of each word, taken as it stands."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids, n = self.merger.merge(self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)], lengths)
        return np.bincount(np.repeat(np.arange(len(words)), n), self.weight[ids], len(words)).astype(np.int64)
