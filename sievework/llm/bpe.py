"""Byte-level BPE encoding and decoding by speculation and verification.

Unseen words are cut by greedy longest match. A cut is the BPE encoding when every token encodes itself
and no merge crosses any boundary between neighbours, so a vectorised check walks the merge trees of all
adjacent pairs of a batch at once; only words with a failing pair are merged exactly. Chunks between
single spaces are cached, and documents are assembled by gathers over the cache.

Merges of a trained vocabulary rank above those that made their parts; the pair check relies on that.

The tables are built once on the driver, from the vocabulary file, and broadcast as arrays; a worker holds
no more of a vocabulary than them. Words of more than LONG bytes are cut by longest matches found at all
their positions at once, and only the surroundings of failing pairs are merged anew, wider each time, until
every pair of the word passes.

Row rules: null text encodes as the empty text, which has no token. Ids outside the vocabulary decode to
nothing; null ids decode to the empty text. Texts and words may have any length. Pairs of equal rank merge from
the left. Repeated rows are coded one by one; empty tables give empty results. Extra columns pass through; one
that has the name of the output is replaced, as by withColumn.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, small_batches
from .words import slices, tidy

#: Fixed value: how byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space at either end or beside other white space: chunks are then put together before splitting.
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LOOSE_SPACE = re.compile(r" \s|\s |^ | \Z")
#: Cached chunks, and tokens in them, after which those that did not come again go.
CACHED_CHUNKS = 200_000
CACHED_TOKENS = 1_000_000
#: Longer chunks are not kept when the cache is cut down.
CACHED_CHARS = 64
#: Words of more bytes are cut and mended one by one instead of side by side.
LONG = 256
#: Tokens on each side of a failing pair that are merged anew first.
REACH = 16
NEVER = np.iinfo(np.int64).max


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else 256 and up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Lookup:
    """Map from non-negative integers to non-negative integers for arrays of keys; -1 where absent."""

    def __init__(self, keys: list[int], values: list[int]):
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int32 if max(keys, default=0) < 1 << 31 else np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] < 0]
            self.keys[at[free]] = keys[free]  # of several keys for a slot the last one stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        shape = keys.shape
        keys = keys.ravel()
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1).astype(np.int64)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            found = self.keys[at[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out.reshape(shape)


def decoder_tables(spec: str) -> dict:
    """The bytes of each token of a vocabulary file (JSON text with vocab, merges and added tokens)."""
    spec = json.loads(spec)
    names = byte_names()
    found = {i: bytes(names[c] for c in s) for s, i in spec["model"]["vocab"].items()}
    found |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    text = [found.get(i, b"") for i in range(1 + max(found))]
    return {"len": np.array([len(b) for b in text], np.int16), "bytes": b"".join(text)}


class Decoder:
    """Texts of ids of one vocabulary file, or of its decoder_tables; no more than the bytes of each token is held."""

    def __init__(self, spec: str | dict):
        tables = decoder_tables(spec) if isinstance(spec, str) else spec
        self.token_len = tables["len"].astype(np.int64)
        self.size = len(self.token_len)
        self.token_at = np.concatenate(([0], np.cumsum(self.token_len)[:-1]))
        self.token_bytes = np.frombuffer(tables["bytes"], np.uint8)

    def decode_batch(self, ids: list[np.ndarray]) -> list[str]:
        cut = np.cumsum([len(x) for x in ids])
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        known = flat < self.size
        n = np.where(known, self.token_len[np.where(known, flat, 0)], 0)
        at = self.token_at[np.where(known, flat, 0)]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = self.token_bytes[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        stops = ends[cut].tolist()
        return [out[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops[:-1]], stops)]


def pair_rank(by_pair: Lookup, size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank of the merge of each pair, NEVER where there is none."""
    r = by_pair.get(a * size + b)
    return np.where(r < 0, NEVER, r)


def pairs_apart(t: dict, size: int, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
    """True where no merge ranked before ``until`` joins tokens a and b across their boundary; t holds the merges.

    Walks back in time: the piece that was made last, of the one left and the one right of the
    boundary, falls apart into its parts, and each pair of pieces that once met must not merge
    before one of them is taken up by its own side (equal ranks go to the left one).
    """
    a, b = a.astype(np.int64), b.astype(np.int64)
    ok = np.ones(len(a), bool)
    live = np.arange(len(a))
    left_until = np.broadcast_to(np.asarray(until, np.int64), a.shape).copy()
    right_until = np.where(left_until == NEVER, NEVER, left_until - 1)
    while len(live):
        rank = pair_rank(t["by_pair"], size, a, b)
        bad = (rank < left_until) & (rank <= right_until) & (rank != NEVER)
        ok[live[bad]] = False
        born_a, born_b = t["birth"][a], t["birth"][b]
        go = ~bad & ((born_a >= 0) | (born_b >= 0))
        first = born_a > born_b
        left_until = np.where(first, born_a, left_until)[go]
        right_until = np.where(first, right_until, born_b)[go]
        a, b = np.where(first, t["right"][a], a)[go], np.where(first, b, t["left"][b])[go]
        live = live[go]
    return ok


def encoder_tables(spec: str) -> dict:
    """decoder_tables, and the merges and the trie of self-encoding tokens of a vocabulary file, as arrays."""
    out = decoder_tables(spec)
    size = len(out["len"])
    spec = json.loads(spec)
    names = byte_names()
    model = spec["model"]
    as_bytes = lambda s: bytes(names[c] for c in s)
    ids = {as_bytes(s): i for s, i in model["vocab"].items()}
    out["special"] = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
    birth, left_of, right_of = np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    pairs: dict[int, int] = {}
    made = np.zeros(len(model["merges"]), np.int64)
    for rank, pair in enumerate(model["merges"]):
        a, b = (as_bytes(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
        left, right, made[rank] = ids[a], ids[b], ids[a + b]
        pairs.setdefault(left * size + right, rank)
        if birth[made[rank]] < 0:
            birth[made[rank]], left_of[made[rank]], right_of[made[rank]] = rank, left, right
    out |= {"birth": birth, "left": left_of, "right": right_of, "made": made, "by_pair": Lookup(list(pairs), list(pairs.values()))}
    out["byte_id"] = np.array([ids[bytes([b])] for b in range(256)], np.int64)
    formed = np.flatnonzero(birth >= 0)
    apart = pairs_apart(out, size, left_of[formed], right_of[formed], birth[formed])
    whole = np.ones(size, bool)
    for t, ok in sorted(zip(formed.tolist(), apart.tolist()), key=lambda x: birth[x[0]]):
        whole[t] = ok and whole[left_of[t]] and whole[right_of[t]]
    nodes: dict[int, int] = {}
    ends: dict[int, int] = {}
    for word, t in ids.items():
        if whole[t]:
            node = 0
            for b in word:
                node = nodes.setdefault(node << 8 | b, len(nodes) + 1)
            ends[node] = t
    out["trie"] = Lookup(list(nodes), list(nodes.values()))
    out["trie_token"] = np.full(len(nodes) + 1, -1, np.int32)
    out["trie_token"][list(ends)] = list(ends.values())
    return out


class Codec(Decoder):
    """Encoder of one vocabulary file, or of its encoder_tables."""

    def __init__(self, spec: str | dict):
        import regex

        tables = encoder_tables(spec) if isinstance(spec, str) else spec
        super().__init__(tables)
        self.tables, self.special = tables, tables["special"]
        self.split = regex.compile(SPLIT)
        self.special_split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.made, self.byte_id = tables["made"], tables["byte_id"]
        self.trie, self.trie_token = tables["trie"], tables["trie_token"]
        self._pairs: dict[int, int] | None = None
        self.reset()

    def reset(self) -> None:
        self.spaced: dict[str, int] = {}  # chunks that follow a space, without it
        self.initial: dict[str, int] = {}  # chunks that start a text
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at, self.len, self.hits = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.used = self.kept = 0

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pair_rank(self.tables["by_pair"], self.size, a, b)

    @property
    def pairs(self) -> dict[int, int]:
        """Rank of each pair, left * size + right, for merging long words."""
        if self._pairs is None:
            held = self.tables["by_pair"]
            used = held.keys >= 0
            self._pairs = dict(zip(held.keys[used].tolist(), held.values[used].tolist()))
        return self._pairs

    # -- speculation -----------------------------------------------------------------------------

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | int = NEVER) -> np.ndarray:
        return pairs_apart(self.tables, self.size, a, b, until)

    def greedy(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match cuts of all words at once: (word, token) in order. raw holds the words' bytes."""
        words, tokens = [], []
        live, at = np.arange(len(start)), start.copy()
        while len(live):
            node, p, stop = np.zeros(len(live), np.int64), at.copy(), end[live]
            best, upto = np.zeros(len(live), np.int64), at.copy()
            go = np.arange(len(live))
            while len(go):
                node[go] = self.trie.get((node[go] << 8) | raw[p[go]])
                go = go[node[go] >= 0]
                p[go] += 1
                token = self.trie_token[node[go]]
                hit = go[token >= 0]
                best[hit], upto[hit] = token[token >= 0], p[hit]
                go = go[p[go] < stop[go]]
            words.append(live)
            tokens.append(best)
            rest = upto < stop
            live, at = live[rest], upto[rest]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        order = np.argsort(words, kind="stable")
        return words[order], tokens[order]

    def longest_cuts(self, word: bytes) -> np.ndarray:
        """Longest-match cut of one long word: matches at all positions at once, then the way from the first."""
        raw = np.frombuffer(word, np.uint8)
        best, size = self.byte_id[raw], np.ones(len(raw), np.int32)
        go, node, depth = np.arange(len(raw)), np.zeros(len(raw), np.int64), 0
        while len(go):
            node = self.trie.get((node << 8) | raw[go + depth])
            go, node, depth = go[node >= 0], node[node >= 0], depth + 1
            token = self.trie_token[node]
            hit = token >= 0
            best[go[hit]], size[go[hit]] = token[hit], depth
            more = go + depth < len(raw)
            go, node = go[more], node[more]
        at, way, size = 0, [], size.tolist()
        while at < len(size):
            way.append(at)
            at += size[at]
        return best[way]

    def mended(self, word: bytes) -> np.ndarray:
        """Exact encoding of one long word: its cut, with the surroundings of failing pairs merged until all pass."""
        tokens, reach = self.longest_cuts(word), REACH
        while len(bad := np.flatnonzero(~self.apart(tokens[:-1], tokens[1:]))):
            first, last = np.maximum(bad - reach, 0), np.minimum(bad + 2 + reach, len(tokens))
            new = np.concatenate(([True], first[1:] > np.maximum.accumulate(last)[:-1]))
            first, last = first[new], np.maximum.reduceat(last, np.flatnonzero(new))
            if last[0] - first[0] == len(tokens):
                return np.array(self.merged(word), np.int64)
            ends = np.concatenate(([0], np.cumsum(self.token_len[tokens])))
            parts, at = [], 0
            for a, b in zip(first.tolist(), last.tolist()):
                parts += [tokens[at:a], np.array(self.merged(word[ends[a] : ends[b]]), np.int64)]
                at = b
            tokens, reach = np.concatenate([*parts, tokens[at:]]), 4 * reach
        return tokens

    def merged_all(self, raw: list[bytes]) -> list[list[int]]:
        """Exact merging of words side by side: in each, the lowest-ranked pair first, the leftmost of equals."""
        out: list = [None] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            groups.setdefault(max(8, 1 << (len(w) - 1).bit_length()), []).append(i)
        for width, rows in groups.items():
            if width > 64:
                for i in rows:
                    out[i] = self.merged(raw[i])
                continue
            flat = np.frombuffer(b"".join(raw[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            n = np.array([len(raw[i]) for i in rows])
            part = self.byte_id[flat]
            rank = np.where(np.arange(1, width) < n[:, None], self.rank(part[:, :-1], part[:, 1:]), NEVER)
            live = np.arange(len(rows))
            cols, rcols = np.arange(width - 1), np.arange(width - 2)
            while len(live):
                own = rank[live]
                i = own.argmin(1)
                low = own[np.arange(len(live)), i]
                more = low < NEVER
                live, i, low = live[more], i[more], low[more]
                if not len(live):
                    break
                p = part[live]
                p[np.arange(len(live)), i] = self.made[low]
                p[:, :-1] = np.take_along_axis(p, cols + (cols > i[:, None]), 1)
                r = own[more]
                r[:, :-1] = np.take_along_axis(r, rcols + (rcols >= i[:, None]), 1)
                r[:, -1] = NEVER
                n[live] -= 1
                k = np.arange(len(live))
                for j, ok in ((i - 1, i > 0), (i, i < n[live] - 1)):
                    r[k[ok], j[ok]] = self.rank(p[k[ok], j[ok]], p[k[ok], j[ok] + 1])
                part[live], rank[live] = p, r
            for row, i in enumerate(rows):
                out[i] = part[row, : n[row]].tolist()
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging of one long word, by a heap over a linked list."""
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        rank_of, size = self.pairs.get, self.size
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := rank_of(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if part[i] != x or j < 0 or part[j] != y:
                continue
            part[i], part[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and (q := after[p]) >= 0 and (r := rank_of(part[p] * size + part[q])) is not None:
                    heapq.heappush(heap, (r, p, part[p], part[q]))
        return [t for t in part if t >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each word, all tokens in order) of pre-split words."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        if not len(raw):
            return size, size
        end = np.cumsum(size)
        long = size > LONG
        some = np.flatnonzero(~long)
        owner, token = self.greedy(np.frombuffer(b"".join(raw), np.uint8), (end - size)[some], end[some])
        owner = some[owner]
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed = long.copy()
        failed[owner[inner[~self.apart(token[inner], token[inner + 1])]]] = True
        redo = np.flatnonzero(failed)
        short = iter(self.merged_all([raw[i] for i in redo[~long[redo]].tolist()]))
        exact = [self.mended(raw[i]).tolist() if long[i] else next(short) for i in redo.tolist()]
        good = ~failed[owner]
        owner = np.concatenate((owner[good], np.repeat(redo, [len(x) for x in exact]).astype(np.int64)))
        token = np.concatenate((token[good], np.fromiter(itertools.chain.from_iterable(exact), np.int64)))
        order = np.argsort(owner, kind="stable")
        return np.bincount(owner, minlength=len(raw)), token[order]

    # -- texts -----------------------------------------------------------------------------------

    def _learn(self, new: list[tuple[bool, str]]) -> None:
        """Cache unseen chunks (after a space?, chunk). A chunk of one word is that word's entry as well."""
        several: list[tuple[bool, str, list[str]]] = []
        single: dict[str, None] = {}
        for spaced, p in new:
            full = " " + p if spaced else p
            core = p.rstrip(_MARKS)
            # a run of letters, with marks behind it or none, splits there and nowhere else
            words = ([full] if core == p else [full[: len(core) - len(p)], p[len(core) :]]) if core.isalpha() else self.split.findall(full)
            if len(words) == 1 and (spaced or p[0] != " "):
                single[full] = None
            else:
                several.append((spaced, p, words))
                for w in words:
                    if (w[1:] not in self.spaced) if w[0] == " " else (w not in self.initial):
                        single[w] = None
        words = list(single)
        self._store([(w[0] == " ", w[1:] if w[0] == " " else w) for w in words], *self.encode_words(words))
        entry = [[self.spaced[w[1:]] if w[0] == " " else self.initial[w] for w in ws] for _, _, ws in several]
        flat = np.fromiter(itertools.chain.from_iterable(entry), np.int64)
        n, tokens = self._gather(flat)
        owner = np.repeat(np.arange(len(several)), [len(x) for x in entry]).astype(np.int64)
        self._store([(s, p) for s, p, _ in several], np.bincount(owner, n, len(several)).astype(np.int64), tokens)

    def _gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of tokens of each entry, their tokens in order)."""
        n = self.len[entry]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return n, self.flat[np.repeat(self.at[entry] - ends + n, n) + np.arange(total)]

    def _store(self, keys: list[tuple[bool, str]], n: np.ndarray, tokens: np.ndarray) -> None:
        total = len(tokens)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.kept + len(n) > len(self.at):
            self.at, self.len, self.hits = (np.concatenate((x, np.zeros_like(x))) for x in (self.at, self.len, self.hits))
        self.flat[self.used : self.used + total] = tokens
        span = slice(self.kept, self.kept + len(n))
        self.at[span], self.len[span], self.hits[span] = self.used + np.cumsum(n) - n, n, 0
        for k, (spaced, p) in enumerate(keys, self.kept):
            (self.spaced if spaced else self.initial)[p] = k
        self.used += total
        self.kept += len(n)

    def _evict(self) -> None:
        """Keep the chunks that were used again since they came, half of the cache at most, and none that is long."""
        hits = self.hits[: self.kept]
        least = max(2, int(np.median(hits)) + 1)
        old = [(s, p, k) for s, d in ((True, self.spaced), (False, self.initial)) for p, k in d.items() if hits[k] >= least and len(p) <= CACHED_CHARS]
        n, tokens = self._gather(np.array([k for _, _, k in old], np.int64))
        self.reset()
        self._store([(s, p) for s, p, _ in old], n, tokens)

    def chunks(self, text: str) -> list[str]:
        """Pieces that split independently: cut at each space between two characters that are no spaces."""
        parts = text.split(" ")
        if _LOOSE_SPACE.search(text):
            merged = [parts[0]]
            for p in parts[1:]:
                last = merged[-1]
                if not last or last[-1].isspace() or not p or p[0].isspace():
                    merged[-1] = f"{last} {p}"
                else:
                    merged.append(p)
            parts = merged
        return parts

    def encode_batch(self, texts: list[str], special: bool = True) -> list[np.ndarray]:
        """uint32 ids of each text. special: strings of special tokens in a text become those tokens."""
        if self.kept > CACHED_CHUNKS or self.used > CACHED_TOKENS:
            self._evict()
        rows: list[list[tuple[bool, list[str]]]] = []
        want: dict[tuple[bool, str], None] = {}
        for text in texts:
            cut_out = special and self.special_split and any(s in text for s in self.special)
            pieces = self.special_split.split(text) if cut_out else [text]
            segments = [(True, [p]) if cut_out and p in self.special else (False, self.chunks(p)) for p in pieces if p]
            rows.append(segments)
            for alone, parts in segments:
                if not alone:
                    if parts[0] not in self.initial:
                        want[(False, parts[0])] = None
                    for p in set(parts[1:]).difference(self.spaced):
                        want[(True, p)] = None
        self._learn(list(want))
        index: list[int] = []
        cut: list[int] = []
        for segments in rows:
            for alone, parts in segments:
                if alone:
                    index.append(-1 - self.special[parts[0]])
                else:
                    index.append(self.initial[parts[0]])
                    index.extend(map(self.spaced.__getitem__, parts[1:]))
            cut.append(len(index))
        index = np.array(index, np.int64)
        tokens = index < 0
        entry = np.where(tokens, 0, index)
        np.add.at(self.hits, entry[~tokens], 1)
        n = np.where(tokens, 1, self.len[entry])
        ends = np.concatenate(([0], np.cumsum(n)))
        at = np.where(tokens, 0, self.at[entry])
        flat = self.flat[np.repeat(at - ends[:-1], n) + np.arange(ends[-1])]
        flat[ends[:-1][tokens]] = -1 - index[tokens]
        return np.split(flat, ends[cut][:-1]) if cut else []


_CODECS: dict[type, Codec | Decoder] = {}


def forget() -> None:
    _CODECS.clear()


def codec(tables: dict, kind: type[Decoder] | None = None) -> Codec | Decoder:
    """The codec (or decoder) that this Python worker holds while a task runs."""
    kind = kind or Codec
    if kind not in _CODECS:
        _CODECS[kind] = kind(tables)
    return _CODECS[kind]


def read_spec(path: str) -> str:
    """The vocabulary file, read on the driver and broadcast (a vocabulary's size does not follow the data)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(
    docs: DataFrame, path: str | None = None, text: str = "text", out: str = "token_ids", keep: list[str] | None = None
) -> DataFrame:
    """docs (or its columns ``keep``) plus ``out``: ids as little-endian unsigned 32-bit integers, binary."""
    small_batches(docs.sparkSession)
    keep = others(docs.columns if keep is None else keep, out)
    own = free_name(docs, "__sw_text")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text), F.lit("")).alias(own))
    tables = docs.sparkSession.sparkContext.broadcast(encoder_tables(read_spec(path or default_vocabulary())))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tables.value)
        for part in slices(batches, len(keep)):
            ids = [x.astype("<u4").tobytes() for x in c.encode_batch(part.column(len(keep)).to_pylist())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def decode(
    encoded: DataFrame, path: str | None = None, ids: str = "token_ids", out: str = "decoded", keep: list[str] | None = None
) -> DataFrame:
    """encoded (or its columns ``keep``) plus ``out``, the text of the ids."""
    small_batches(encoded.sparkSession)
    keep = others(encoded.columns if keep is None else keep, out)
    own = free_name(encoded, "__sw_ids")
    df = encoded.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(ids), F.lit(b"")).alias(own))
    tables = encoded.sparkSession.sparkContext.broadcast(decoder_tables(read_spec(path or default_vocabulary())))
    schema = T.StructType([*df.schema.fields[:-1], T.StructField(out, T.StringType())])

    @tidy(forget)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tables.value, Decoder)
        for part in slices(batches, len(keep)):
            raw = [np.frombuffer(x, "<u4") for x in part.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(c.decode_batch(raw), pa.string())], names=[*keep, out])

    return df.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    coded = encode(docs.select("doc_id", "text"), path, keep=["doc_id"])
    both = decode(coded, path)
    return both.select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
