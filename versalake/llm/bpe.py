"""Byte-level BPE by speculation and verification.

A text is cut into pre-tokens, every distinct pre-token is encoded once:

1. *Speculate*: greedy longest match over the vocabulary, for all pre-tokens of a batch at once (prefix hashes and
   a bucketed hash table in numpy).
2. *Verify*: a token sequence is what merging gives if and only if each token is what its own bytes merge to and
   each adjacent pair is what its joint bytes merge to. Pairs are tested for all pre-tokens at once, by undoing
   merges across the seam.
3. Only pre-tokens with a pair that fails are merged exactly, by rank (`merge_all`).

`ByteBPE.encode` takes any list of texts, `ByteBPE.encode_bytes` their UTF-8 as it lies in an Arrow column. Null
counts as the empty text. Special tokens in the text become their id, as in the tokenizers library.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

#: The public pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct chunks that are remembered in a worker (of 16 bytes on average); beyond it the memory starts afresh.
MEMO = 1_000_000
#: Pre-tokens of more bytes than this get their proposals from all places at once, and are merged with a heap if those fail.
LONG = 200

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabulary files."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class Table:
    """A bucketed hash table from 64-bit keys to 32-bit numbers that is probed for whole arrays; -1: not there."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, bits: int = 18):
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        slot, keys, values = slot[order], keys[order], values[order]
        depth = np.arange(len(slot)) - np.searchsorted(slot, slot)
        self.keys = np.zeros((depth.max(initial=0) + 1, 1 << bits), np.uint64)
        self.values = np.full(self.keys.shape, -1, np.int32)
        self.keys[depth, slot], self.values[depth, slot] = keys, values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.values[0][slot]
        miss = np.flatnonzero(self.keys[0][slot] != keys)
        found[miss] = -1
        for k, v in zip(self.keys[1:], self.values[1:]):
            # A slot that is free at one depth is free at all later ones.
            miss = miss[v[slot[miss]] >= 0]
            hit = k[slot[miss]] == keys[miss]
            found[miss[hit]] = v[slot[miss[hit]]]
            miss = miss[~hit]
        return found


class ByteBPE:
    def __init__(self, path: str):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or not plain:
            raise ValueError(f"{path} isn't a plain byte-level BPE")
        letters = _byte_letters()
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = {k: v for k, v in model["vocab"].items() if k not in self.specials}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes = [b""] * self.size
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[c] for c in token)
        for token, i in self.specials.items():
            self.bytes[i] = token.encode()
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.byte_id = [vocab[{b: c for c, b in letters.items()}[i]] for i in range(256)]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        rank = np.full(self.size, -1, np.int64)
        left, right = np.arange(self.size), np.arange(self.size)
        ordered = True
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.ranks.setdefault((i, j), (r, k))
            ordered &= rank[k] < 0 and rank[i] < r and rank[j] < r
            rank[k], left[k], right[k] = r, i, j
        # The pair test compares tokens by the rank of their merge; bytes come before all merges.
        self.speculative = ordered
        self.rank, self.left, self.right = rank, left, right
        self.pair = Table(np.array([i * self.size + j for i, j in self.ranks], np.uint64), np.array([r for r, _ in self.ranks.values()], np.int32))
        self.merged = np.zeros(len(model["merges"]), np.int32)
        for r, k in self.ranks.values():
            self.merged[r] = k
        self.split = regex.compile(PATTERN).findall
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        self._power = np.ones(0, np.uint64)
        self._forget()
        self._table()

    # -- vocabulary table --------------------------------------------------------------------------------

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._power) < n:
            size = max(n, 1 << 19)
            one = np.ones(size, np.uint64)
            one[1:] = _BASE
            self._power = np.cumprod(one, dtype=np.uint64)
            one[1:] = _INVERSE
            self._unpower = np.cumprod(one, dtype=np.uint64)
        return self._power[:n], self._unpower[:n]

    def _table(self) -> None:
        special = set(self.specials.values())
        tokens = [i for i in range(self.size) if (self.rank[i] >= 0 or len(self.bytes[i]) == 1) and i not in special]
        if self.speculative:
            # A token that its own bytes don't merge to is never proposed.
            ids, count = self.merge_all([self.bytes[i] for i in tokens])
            alone = np.array(tokens)[(count == 1) & (ids[np.cumsum(count) - count] == np.array(tokens))]
            tokens = alone.tolist()
        sizes = self.length[tokens]
        self.lengths = np.unique(sizes).tolist()
        data, _ = gather(self.blob, np.append(self.begin, len(self.blob)), np.array(tokens))
        ends = np.cumsum(sizes)
        place = np.arange(len(data)) - np.repeat(ends - sizes, sizes)
        terms = (data.astype(np.uint64) + np.uint64(1)) * self._powers(int(sizes.max()))[0][place]
        hashes = np.add.reduceat(terms, ends - sizes)
        self._lookup = Table(hashes, np.array(tokens, np.int32))

    # -- exact merging -----------------------------------------------------------------------------------

    def merge(self, word: bytes) -> list[int]:
        """The exact encoding of one pre-token: merges by rank, leftmost first."""
        ids = [self.byte_id[b] for b in word]
        if len(ids) > LONG // 4:
            return self._merge_long(ids)
        ranks = self.ranks
        while len(ids) > 1:
            best = min((ranks.get(p, (1 << 60, 0)) for p in zip(ids, ids[1:])))
            if best[0] == 1 << 60:
                break
            out, i, n = [], 0, len(ids)
            while i < n:
                if i + 1 < n and ranks.get((ids[i], ids[i + 1]), (-1,))[0] == best[0]:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*ranks[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in ranks]
        heap = [(r, i, k, a, b) for r, k, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, k, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] is not None else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = k, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (p := (ids[x], ids[y])) in ranks:
                    r, m = ranks[p]
                    heapq.heappush(heap, (r, x, m, *p))
        return [i for i in ids if i is not None]

    # -- speculation and verification --------------------------------------------------------------------

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair: do the joint bytes of tokens a and b merge to exactly [a, b]? Undoes merges across the
        seam, latest first; a merge across it that would have come earlier shows that they don't."""
        ok = np.ones(len(a), bool)
        at, a, b = np.arange(len(a)), a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 60, np.int64)
        while len(at):
            rank = self.pair((a * self.size + b).astype(np.uint64))
            bad = (rank >= 0) & (rank < limit)
            ok[at[bad]] = False
            # The side whose merge came later is undone; an equal token on both sides is undone on the right.
            ra, rb = self.rank[a], self.rank[b]
            undo_left = ra > rb
            live = ~bad & ((ra >= 0) | (rb >= 0))
            limit = np.where(undo_left, ra, rb + 1)
            a, b = np.where(undo_left, self.right[a], a), np.where(undo_left, b, self.left[b])
            at, a, b, limit = at[live], a[live], b[live], limit[live]
        return ok

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """`merge` for many short words at once: each round does every word's merge of lowest rank. Gives the ids
        and how many each word has."""
        size = np.array([len(w) for w in words], np.int64)
        ids = np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), size)
        over: list[tuple[np.ndarray, np.ndarray]] = []
        none = np.int64(1 << 40)
        while len(ids):
            rank = self.pair(ids[:-1].astype(np.uint64) * np.uint64(self.size) + ids[1:].astype(np.uint64)).astype(np.int64)
            rank = np.append(np.where((rank >= 0) & (owner[1:] == owner[:-1]), rank, none), none)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            low = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(ids)))
            live = np.repeat(low < none, count)
            hit = live & (rank == np.repeat(low, count))
            # Of hits that overlap (one token thrice in a row) every other one counts, from the left.
            start = hit & ~np.concatenate([[False], hit[:-1]])
            at = np.arange(len(ids))
            hit &= (at - np.maximum.accumulate(np.where(start, at, 0))) % 2 == 0
            ids[hit] = self.merged[rank[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            done = ~live
            over.append((ids[done], owner[done]))
            keep &= live
            ids, owner = ids[keep], owner[keep]
        ids, owner = (np.concatenate(x) for x in zip(*over)) if over else (ids, owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after another, and where each begins (one entry more than words)."""
        if not self.speculative:
            found = [self.merge(w) for w in words]
            begin = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
            return np.array([i for x in found for i in x], np.int32), begin
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        p = ends - size
        power, unpower = self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=total[1:])
        token = np.full(len(data), -1, np.int32)
        long = np.flatnonzero(size > LONG)
        for i in long.tolist():
            self._propose(total, p[i], ends[i], token)
        live = np.flatnonzero((p < ends) & (size <= LONG))
        while len(live):
            at, rest = p[live], ends[live] - p[live]
            step = np.zeros(len(live), np.int64)
            open_ = np.arange(len(live))
            longest = int(rest.max())
            for n in reversed(self.lengths):
                if n > longest:
                    continue
                mine = open_[rest[open_] >= n]
                if not len(mine):
                    continue
                q = at[mine]
                ids = self._lookup((total[q + n] - total[q]) * unpower[q])
                hit = ids >= 0
                token[q[hit]] = ids[hit]
                step[mine[hit]] = n
                open_ = open_[step[open_] == 0]
                if not len(open_):
                    break
            p[live] = at + step
            live = live[p[live] < ends[live]]
        spots = np.flatnonzero(token >= 0)
        ids = token[spots]
        owner = np.searchsorted(ends, spots, side="right")
        same = np.flatnonzero(owner[1:] == owner[:-1])
        key = ids[same].astype(np.int64) * self.size + ids[same + 1]
        pairs, back = np.unique(key, return_inverse=True)
        ok = self.compatible(pairs // self.size, pairs % self.size)
        # The proposal must also spell the word: a hash that collides is found here.
        spelled = self.decode_bytes(ids) if len(ids) else np.empty(0, np.uint8)
        wrong = np.zeros(len(words), bool)
        wrong[owner[same[~ok[back]]]] = True
        if len(spelled) != len(data):
            wrong[:] = True
        else:
            wrong[np.searchsorted(ends, np.flatnonzero(spelled != data), side="right")] = True
        done = {i: self.merge(words[i]) for i in long[wrong[long]].tolist()}
        failed = np.flatnonzero(wrong & (size <= LONG))
        merged, per = self.merge_all([words[i] for i in failed])
        count = np.bincount(owner, minlength=len(words))
        count[failed] = per
        for i, x in done.items():
            count[i] = len(x)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        right = ~wrong[owner]
        place = np.arange(len(ids)) - np.searchsorted(owner, owner)
        out[begin[owner[right]] + place[right]] = ids[right]
        out[np.repeat(begin[failed] - (np.cumsum(per) - per), per) + np.arange(len(merged))] = merged
        for i, x in done.items():
            out[begin[i] : begin[i + 1]] = x
        return out, begin

    def _propose(self, total: np.ndarray, a: int, b: int, token: np.ndarray) -> None:
        """Greedy longest match of one long word: the longest token at each of its places, then the chain of them."""
        _, unpower = self._powers(len(total))
        longest, ids = np.zeros(b - a, np.int64), np.full(b - a, -1, np.int32)
        for n in self.lengths:
            q = np.arange(a, b - n + 1)
            got = self._lookup((total[q + n] - total[q]) * unpower[q])
            hit = np.flatnonzero(got >= 0)
            longest[hit], ids[hit] = n, got[hit]
        steps, at, spots = longest.tolist(), 0, []
        while at < b - a:
            spots.append(at)
            at += steps[at]
        token[a + np.array(spots)] = ids[spots]

    # -- texts -------------------------------------------------------------------------------------------

    def _forget(self) -> None:
        """Drops what is remembered of chunks: their hashes, sorted, their bytes and their ids."""
        self._main = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self._late = (np.empty(0, np.uint64), np.empty(0, np.int64))
        self._ids: np.ndarray = np.empty(0, np.int32)
        self._at = np.zeros(1, np.int64)
        self._said: np.ndarray = np.empty(0, np.uint8)
        self._said_at = np.zeros(1, np.int64)
        self._twins: dict[bytes, int] = {}
        self._chunk_count = 0

    def _recall(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each chunk, -1 if it isn't known."""
        found = np.full(len(hashes), -1, np.int64)
        for keys, numbers in (self._main, self._late):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                hit = keys[at] == hashes
                found[hit] = numbers[at[hit]]
        return found

    def _cut(self, chunk: str) -> list[str | int]:
        """The pre-tokens of a chunk; special tokens as their ids."""
        if self.special_split and any(s in chunk for s in self.specials):
            parts = [[self.specials[p]] if p in self.specials else self.split(p) for p in self.special_split(chunk)]
            return [x for p in parts for x in p]
        return self.split(chunk)

    def _learn(self, chunks: list[bytes], plain: np.ndarray, special: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks and how many each has. plain: chunks without white space but for a leading space or line
        end; those are cut all at once, kept apart by line ends. special: there may be special tokens."""
        if special:
            plain = plain & ~np.fromiter((b"<" in c for c in chunks), bool, len(chunks))
        simple = np.flatnonzero(plain)
        stream = self.split(b"\n".join([c[1:] if c[0] == 10 else c for c in (chunks[i] for i in simple.tolist())]).decode())
        odd = {i: self._cut(chunks[i].decode()) for i in np.flatnonzero(~plain).tolist()}
        new = {w: i for i, w in enumerate(dict.fromkeys(["\n", *stream]))}
        for x in odd.values():
            for w in x:
                if w.__class__ is str and w not in new:
                    new[w] = len(new)
        ids, begin = self.encode_words([w.encode() for w in new])
        # Special ids stand after the ids of the words.
        specials = list(self.specials.values())
        begin = np.append(begin, begin[-1] + np.arange(1, len(specials) + 1))
        ids = np.append(ids, np.array(specials, np.int32))
        flat = np.fromiter(map(new.__getitem__, stream), np.int64, len(stream))
        apart = flat == new["\n"]
        chunk_of = simple[np.cumsum(apart)[~apart]] if len(simple) else np.empty(0, np.int64)
        led = np.fromiter((chunks[i][0] == 10 for i in simple.tolist()), bool, len(simple))
        led = simple[led]
        rest = np.array([new[w] if w.__class__ is str else len(new) + specials.index(w) for x in odd.values() for w in x], np.int64)
        words = np.concatenate([np.full(len(led), new["\n"]), flat[~apart], rest])
        sizes = np.fromiter(map(len, odd.values()), np.int64, len(odd))
        owner = np.concatenate([led, chunk_of, np.repeat(np.fromiter(odd, np.int64, len(odd)), sizes)]).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        out, counts = gather(ids, begin, words[order])
        return out, np.bincount(owner[order], weights=counts, minlength=len(chunks)).astype(np.int64)

    def _chunks(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk of the texts starts, and its number in the memory. A chunk starts at the text's start and
        at each space or line end after something else than white space, where a pre-token always starts whatever
        else the text holds. Chunks repeat, so each distinct one is encoded once."""
        if self._chunk_count > MEMO or self._said_at[self._chunk_count] > 16 * MEMO:
            self._forget()
        blank = _blank(data)
        start = ((data == 32) | (data == 10)) & ~np.concatenate([[False], blank[:-1]])
        heads = begin[:-1][begin[:-1] < begin[1:]]
        start[heads] = True
        p = np.flatnonzero(start)
        q = np.append(p[1:], len(data))
        distinct, first, back = np.unique(self._hashes(data, p, q), return_index=True, return_inverse=True)
        number = self._recall(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._remember(data, blank, p[first[new]], q[first[new]])
            keys, numbers = (np.append(x, y) for x, y in zip(self._late, (distinct[new], number[new])))
            if len(keys) * 8 > len(self._main[0]):
                keys, numbers = (np.append(x, y) for x, y in zip(self._main, (keys, numbers)))
                order = np.argsort(keys)
                self._main = keys[order], numbers[order]
                self._late = (keys[:0], numbers[:0])
            else:
                order = np.argsort(keys)
                self._late = keys[order], numbers[order]
        chunk = number[back]
        wrong = self._different(data, p, q, chunk)
        if len(wrong):
            # Chunks whose hash is another's: they are known by their bytes.
            raw = data.tobytes()
            twins = [raw[a:b] for a, b in zip(p[wrong].tolist(), q[wrong].tolist())]
            fresh = {t: i for t, i in zip(twins, wrong.tolist()) if t not in self._twins}
            if fresh:
                at = np.array(list(fresh.values()))
                self._twins |= zip(fresh, self._remember(data, blank, p[at], q[at]).tolist())
            chunk[wrong] = [self._twins[t] for t in twins]
        return p, chunk

    def _hashes(self, data: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """A quick hash of each chunk. Different chunks may share one: `_different` compares bytes."""
        power, unpower = self._powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        return (total[q] - total[p]) * unpower[p] ^ (q - p).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)

    def _different(self, data: np.ndarray, p: np.ndarray, q: np.ndarray, chunk: np.ndarray) -> np.ndarray:
        """Which of the chunks, that cover the data, aren't the remembered ones byte by byte."""
        said, size = gather(self._said, self._said_at, chunk)
        odd = size != q - p
        if odd.any():
            fine = np.flatnonzero(~odd)
            said, _ = gather(self._said, self._said_at, chunk[fine])
            data, _ = gather(data, np.append(p, len(data)), fine)
        else:
            fine = np.arange(len(p))
        differ = np.flatnonzero(said != data)
        if len(differ):
            odd[fine[np.searchsorted(np.cumsum((q - p)[fine]), differ, side="right")]] = True
        return np.flatnonzero(odd)

    def _remember(self, data: np.ndarray, blank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Encodes the chunks data[a[i]:b[i]] and gives the numbers under which they are remembered."""
        blanks = np.concatenate([[0], np.cumsum(blank)])
        lead = ((data[a] == 32) | (data[a] == 10)).astype(np.int64)
        plain = (blanks[b] - blanks[np.minimum(a + lead, b)] == 0) & (b - a > lead)
        raw = data.tobytes()
        special = any(s.encode() in raw for s in self.specials)
        chunks = [raw[x:y] for x, y in zip(a.tolist(), b.tolist())]
        ids, count = self._learn(chunks, plain, special)
        base = self._chunk_count
        self._said = _put(self._said, int(self._said_at[base]), np.frombuffer(b"".join(chunks), np.uint8))
        self._said_at = _put(self._said_at, base + 1, self._said_at[base] + np.cumsum(b - a))
        self._ids = _put(self._ids, int(self._at[base]), ids)
        self._at = _put(self._at, base + 1, self._at[base] + np.cumsum(count))
        self._chunk_count += len(a)
        return base + np.arange(len(a))

    def encode_bytes(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts data[begin[i]:begin[i + 1]] (UTF-8), one after another, and where each text begins."""
        if not len(data):
            return np.empty(0, np.int32), np.zeros(len(begin), np.int64)
        p, chunk = self._chunks(data, begin)
        out, sizes = gather(self._ids, self._at, chunk)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return out, ends[np.searchsorted(p, begin)]

    def count_bytes(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each chunk of the texts starts, and how many ids it has."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        p, chunk = self._chunks(data, begin)
        return p, self._at[chunk + 1] - self._at[chunk]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text begins (one entry more than texts)."""
        raw = [(t or "").encode() for t in texts]
        begin = np.concatenate([[0], np.cumsum([len(x) for x in raw], dtype=np.int64)]).astype(np.int64)
        return self.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), begin)

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after another."""
        return gather(self.blob, np.append(self.begin, len(self.blob)), ids)[0]

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[str]:
        """The texts whose ids begin at `begin`; bytes that aren't UTF-8 become the replacement character."""
        data = self.decode_bytes(ids).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.length[ids])])[begin]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]


def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """Writes `new` at position `at` of a buffer, which grows by a half if need be."""
    end = at + len(new)
    if end > len(held):
        wider = np.zeros(max(end, len(held) * 3 // 2), held.dtype)
        wider[:at] = held[:at]
        held = wider
    held[at:end] = new
    return held


def gather(values: np.ndarray, begin: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates values[begin[i]:begin[i + 1]] for i in index; also gives their sizes."""
    index = np.asarray(index)
    start = begin[index]
    size = begin[index + 1] - start
    total = int(size.sum())
    if not total:
        return values[:0], size
    # Within a run positions rise by one; at each run's start the step leads to its first value.
    keep = size > 0
    start, length = start[keep], size[keep]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    step[np.cumsum(length)[:-1]] = start[1:] - (start[:-1] + length[:-1] - 1)
    return values[np.cumsum(step)], size


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The encoder of a file, once in each worker."""
    return ByteBPE(path)


def release() -> None:
    """Drops the encoder at a task's end: idle workers hold memory beside the executor's other stages."""
    from versalake.llm.common import trim

    load.cache_clear()
    trim()


def slices(sizes: np.ndarray, most: int = 1 << 19):
    """Ranges of texts with about `most` bytes together, one text at least."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of an Arrow string column and where each text begins, without a copy; null is the empty text."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    begin = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[begin[0] : begin[-1]] if data is not None and begin[-1] > begin[0] else np.empty(0, np.uint8)
    return raw, begin - begin[0]


def _blank(data: np.ndarray) -> np.ndarray:
    """True at bytes that may belong to white space of any kind; a few other signs beyond ASCII count too."""
    blank = (data == 32) | ((data >= 9) & (data <= 13)) | ((data >= 0x1C) & (data <= 0x1F))
    if len(data) > 2 and (data >= 0x80).any():
        two = (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
        blank[1:] |= two
        lead, next_ = data[:-2], data[1:-1]
        three = ((lead == 0xE2) & ((next_ == 0x80) | (next_ == 0x81))) | ((lead == 0xE1) & (next_ == 0x9A)) | ((lead == 0xE3) & (next_ == 0x80))
        blank[2:] |= three
        blank[1:-1] |= three
    elif (data >= 0x80).any() and len(data) == 2:
        blank[1] |= bool(data[0] == 0xC2)
    return blank
