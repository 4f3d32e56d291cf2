"""BPE encoding and decoding by speculation and verification, over batches of texts in numpy.

Texts are cut into words by character classes, and only distinct words are encoded. For a word, greedy
longest match proposes tokens. A proposal is the true BPE result exactly if each token is what BPE makes of
its own symbols and each adjacent pair is compatible: undoing the two tokens' merges from the latest to the
earliest, at no moment would a merge across their border have come before the next merge that was done.
Compatibility is tested for all distinct adjacent pairs of a batch at once. Words that fail are merged
exactly, lowest rank and leftmost first, also as arrays.

Defined cases: null text counts as empty and has no tokens; strings of special tokens inside a text become
their single ids; words of more than LONG symbols are merged exactly with a heap, in n log n steps; texts of
more than PIECE code points are cut between words first. Results never depend on batches. Repeated rows are
encoded each; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import tune

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
#: Code points of White_Space (a fixed value of Unicode).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the contractions that are words of their own (a fixed value of the vocabularies).
CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]
END = 256  # added to the last symbol of a word where the vocabulary marks word ends
LONG = 64
PIECE = 1 << 20
NEVER = np.iinfo(np.int32).max
#: Distinct words that a worker keeps between batches.
MEMO_WORDS = 600_000
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
_BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        if kind := kinds.get(unicodedata.category(chr(c))[0]):
            out[c] = kind
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(1)
def byte_chars() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: printable Latin-1 stands for itself, the rest is moved past 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(hidden)}


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse**i modulo 2**64, for i < n."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, inverse))


class Lookup:
    """A map from int64 keys to int32 values for whole arrays: one slot per key in a table of sorted keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        order = np.argsort(keys)
        self.keys, self.values, self.missing = keys[order].astype(np.int64), values[order].astype(np.int32), np.int32(missing)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.values[at], self.missing)


class Bpe:
    """Tables of one vocabulary file of the tokenizers library, and the encoder over them."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, to_byte = spec["model"], byte_chars()
        self.mark = model["end_of_word_suffix"] or ""
        self.folds = spec["normalizer"] is not None  # NFC, white space dropped, lower case
        vocab: dict[str, int] = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, self.specials)))
        n = self.n = max([*vocab.values(), *self.specials.values()]) + 1

        self.rank = np.full(n, -1, np.int32)
        self.left, self.right = np.zeros(n, np.int32), np.zeros(n, np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64)
        self.merged = pairs[:, 2].astype(np.int32)
        self.rank[self.merged] = np.arange(len(pairs))
        self.left[self.merged], self.right[self.merged] = pairs[:, 0], pairs[:, 1]
        self.pair_rank = Lookup(pairs[:, 0] * n + pairs[:, 1], np.arange(len(pairs)), NEVER)

        self.base = np.full(512, -1, np.int32)
        strings: list[bytes] = [b""] * n
        trie: dict[int, int] = {}
        ends = [-1]
        for text, i in vocab.items():
            ended = bool(self.mark) and text.endswith(self.mark)
            raw = bytes(map(to_byte.__getitem__, text.removesuffix(self.mark) if ended else text))
            strings[i] = raw
            symbols = list(raw)
            if ended:
                symbols[-1] += END
            if len(symbols) == 1:
                self.base[symbols[0]] = i
            node = 0
            for s in symbols:
                key = node * 512 + s
                if (after := trie.get(key)) is None:
                    after = trie[key] = len(ends)
                    ends.append(-1)
                node = after
            ends[node] = i
        for text, i in self.specials.items():
            strings[i] = text.encode()
        self.step = Lookup(np.fromiter(trie.keys(), np.int64, len(trie)), np.fromiter(trie.values(), np.int64, len(trie)), -1)
        self.ends = np.array(ends, np.int32)
        self.byte_len = np.array([len(s) for s in strings], np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(self.byte_len)[:-1]])
        self.bytes = np.frombuffer(b"".join(strings), np.uint8)

        # tokens that BPE makes of their own symbols
        ok = np.ones(n, bool)
        limit = np.arange(len(pairs), dtype=np.int32)
        ok[self.merged] = self.compatible(pairs[:, 0], pairs[:, 1], limit)
        for t in self.merged:  # parts come before what is made of them
            ok[t] &= ok[self.left[t]] & ok[self.right[t]]
        self.ok = ok
        self.forget()

    def forget(self) -> None:
        self.memo = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))] * 2
        self.pool, self.pool_n = np.zeros(1 << 16, np.uint32), 0

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE, given the symbols of a and b in a row, would make a and b. limit: rank of what comes after both."""
        a, b = a.astype(np.int32), b.astype(np.int32)
        after_a = np.full(len(a), NEVER, np.int32) if limit is None else limit.copy()
        after_b = after_a.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.pair_rank(x.astype(np.int64) * self.n + y)
            clash = (across < after_a[live]) & (across <= after_b[live]) & (across < NEVER)
            good[live[clash]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~clash & (np.maximum(rx, ry) >= 0)
            live, rx, ry = live[go], rx[go], ry[go]
            undo_a = rx > ry  # of equal merges the left one came first, so the right one is undone first
            i, j = live[undo_a], live[~undo_a]
            after_a[i], a[i] = rx[undo_a], self.right[a[i]]
            after_b[j], b[j] = ry[~undo_a], self.left[b[j]]
        return good

    # ------------------------------------------------------------------ words to tokens

    def encode_words(self, symbols: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words symbols[start:end], one after another, and the number of each word's tokens."""
        n = len(start)
        owner, token = self.propose(symbols, start, end)
        order = np.argsort(owner, kind="stable")
        owner, token = owner[order], token[order]
        bad = np.zeros(n, bool)
        bad[owner[~self.ok[token]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pair, back = np.unique(token[inner].astype(np.int64) * self.n + token[inner + 1], return_inverse=True)
        bad[owner[inner[~self.compatible(pair // self.n, pair % self.n)[back]]]] = True
        if bad.any():
            keep = ~bad[owner]
            redo, again = self.merge_exactly(symbols, start, end, np.flatnonzero(bad))
            owner, token = np.concatenate([owner[keep], redo]), np.concatenate([token[keep], again])
            order = np.argsort(owner, kind="stable")
            owner, token = owner[order], token[order]
        return token.astype(np.uint32), np.bincount(owner, minlength=n)

    def propose(self, symbols, start, end):
        """Greedy longest match: (word, token) arrays, each word's tokens in order."""
        owners, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        words, at = np.arange(len(start)), start.copy()
        while len(words):
            stop = end[words]
            best, best_n = np.full(len(words), -1, np.int32), np.zeros(len(words), np.int64)
            node, live, depth = np.zeros(len(words), np.int64), np.arange(len(words)), 0
            while len(live):
                live = live[at[live] + depth < stop[live]]
                child = self.step(node[live] * 512 + symbols[at[live] + depth])
                found = child >= 0
                live, child = live[found], child[found]
                node[live] = child
                depth += 1
                token = self.ends[child]
                has = token >= 0
                best[live[has]], best_n[live[has]] = token[has], depth
            owners.append(words)
            tokens.append(best)
            at = at + best_n
            more = at < stop
            words, at = words[more], at[more]
        return np.concatenate(owners), np.concatenate(tokens)

    def merge_exactly(self, symbols, start, end, which):
        owners, tokens = [], []
        size = (end - start)[which]
        for low, high in ((0, 8), (8, 16), (16, 32), (32, LONG)):
            some = which[(size > low) & (size <= high)]
            for k in range(0, len(some), 1 << 16):
                owner, token = self.merge_block(symbols, start, end, some[k : k + (1 << 16)])
                owners.append(owner)
                tokens.append(token)
        return np.concatenate(owners), np.concatenate(tokens)

    def merge_block(self, symbols, start, end, which):
        """Exact merging of short words, one merge in every word at a time."""
        size = (end - start)[which]
        width = int(size.max(initial=1))
        cols = np.arange(width)
        inside = cols < size[:, None]
        ids = np.where(inside, self.base[symbols[np.minimum(start[which][:, None] + cols, len(symbols) - 1)]], -1)
        ranks = np.full((len(which), width), NEVER, np.int32)
        ranks[:, :-1] = np.where(inside[:, 1:], self.pair_rank(ids[:, :-1].astype(np.int64) * self.n + ids[:, 1:]), NEVER)
        rows = np.arange(len(which))
        while len(rows):
            sub = ranks[rows]
            at = sub.argmin(1)
            low = sub[np.arange(len(rows)), at]
            go = low < NEVER
            rows, at, low = rows[go], at[go], low[go]
            if not len(rows):
                break
            shift = np.minimum(cols + (cols > at[:, None]), width - 1)
            here = np.arange(len(rows))
            old_ids, old_ranks = ids[rows], ranks[rows]
            new_ids, new_ranks = np.take_along_axis(old_ids, shift, 1), np.take_along_axis(old_ranks, shift, 1)
            new_ids[:, -1], new_ranks[:, -1] = -1, NEVER
            new_ids[here, at] = self.merged[low]
            for side in (-1, 0):  # the pairs on both sides of what was merged
                p = at + side
                fit = (p >= 0) & (p + 1 < width)
                h, p = here[fit], p[fit]
                second = new_ids[h, p + 1]
                new_ranks[h, p] = np.where(second >= 0, self.pair_rank(new_ids[h, p].astype(np.int64) * self.n + second), NEVER)
            new_ranks[here[at == width - 1], width - 1] = NEVER
            ids[rows], ranks[rows] = new_ids, new_ranks
        found = ids >= 0
        return np.repeat(which, found.sum(1)), ids[found]

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Exact merging of one long word with a heap of (rank, place)."""
        ids = self.base[symbols].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        first = self.pair_rank(np.array(ids[:-1], np.int64) * self.n + np.array(ids[1:], np.int64))
        rank_of: dict[int, int] = {}

        def rank(a: int, b: int) -> int:
            key = a * self.n + b
            if (r := rank_of.get(key)) is None:
                r = rank_of[key] = int(self.pair_rank(np.array([key]))[0])
            return r

        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NEVER]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (x := rank(ids[i], ids[k])) < NEVER:
                    heapq.heappush(heap, (x, i, ids[i], ids[k]))
            if (h := before[i]) >= 0 and (x := rank(ids[h], ids[i])) < NEVER:
                heapq.heappush(heap, (x, h, ids[h], ids[i]))
        return np.array([i for i in ids if i >= 0], np.uint32)

    # ------------------------------------------------------------------ texts to words

    def fold(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        # lower case goes by single characters: no rule for a final sigma
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def spans(self, points: np.ndarray, text_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last code point of every word; text_start: where texts begin (their ends are borders)."""
        n = len(points)
        kind = char_classes()[points]
        first = np.zeros(n + 1, bool)
        first[text_start] = True
        first[n] = True
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= first[:n]
        space = kind == SPACE
        starts = change.copy()
        if self.folds:
            starts |= kind == NUMBER
        else:
            # the last white space before a word stands by itself, or with the word if it is a blank
            before_word = np.zeros(n, bool)
            before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
            starts |= before_word
            joined = np.zeros(n, bool)
            joined[1:] = before_word[:-1] & (points[:-1] == 0x20)
            starts &= ~joined
        quote = np.flatnonzero((points == ord("'")) & starts)
        for tail in CONTRACTIONS:
            m = len(tail)
            q = quote[quote + m < n]
            fit = np.ones(len(q), bool)
            for k, c in enumerate(tail, 1):
                fit &= (points[q + k] == ord(c)) & ~first[q + k]
            q = q[fit]
            starts[q + 1] = False
            rest = q + m + 1
            rest = rest[rest < n]
            starts[rest[~space[rest]]] = True
        begin = np.flatnonzero(starts)
        end = np.append(begin[1:], n)
        if self.folds:
            word = kind[begin] != SPACE
            begin, end = begin[word], end[word]
        return begin, end

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin (one more entry for the end)."""
        out: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        batch: list[tuple[int, str]] = []
        held = 0

        def flush():
            nonlocal batch, held
            if batch:
                ids, per = self._encode_pieces([t for _, t in batch])
                np.add.at(counts, [k for k, _ in batch], per)
                out.append(ids)
            batch, held = [], 0

        for k, text in enumerate(texts):
            pieces: list[str | int] = [text]
            if "<|" in text and self.special.search(text):
                pieces, at = [], 0
                for m in self.special.finditer(text):
                    pieces += [text[at : m.start()], self.specials[m[0]]]
                    at = m.end()
                pieces.append(text[at:])
            for piece in pieces:
                if isinstance(piece, int):
                    flush()
                    out.append(np.array([piece], np.uint32))
                    counts[k] += 1
                    continue
                while len(piece) > PIECE and (cut := _SAFE_CUT.search(piece, PIECE)):
                    flush()
                    batch, piece = [(k, piece[: cut.start()])], piece[cut.start() :]
                    flush()
                if piece:
                    batch.append((k, piece))
                    held += len(piece)
                    if held >= PIECE:
                        flush()
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.folds:
            texts = [self.fold(t) for t in texts]
        text_n = np.array([len(t) for t in texts])
        text_at = np.concatenate([[0], np.cumsum(text_n)])
        joined = "".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        raw = np.frombuffer(joined.encode(), np.uint8)
        begin, end = self.spans(points, text_at[:-1][text_n > 0])
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        owner = np.searchsorted(text_at, begin, "right") - 1
        if len(raw) != len(points):
            width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
            byte_at = np.concatenate([[0], np.cumsum(width)])
            begin, end = byte_at[begin], byte_at[end]
        at, n = self._memoised(raw, begin, end)
        ids = self.pool[np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        return ids, np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64)

    def _memoised(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the pool and number of ids of each word raw[begin:end]."""
        if len(self.memo[0][0]) + len(self.memo[1][0]) > MEMO_WORDS:
            self.forget()
        size = end - begin
        up, down = powers(1 << max(16, int(len(raw)).bit_length()))
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
            key = (total[end] - total[begin]) * down[begin]
            key ^= key >> np.uint64(29)
            key = key * np.uint64(0xBF58476D1CE4E5B9) + size.astype(np.uint64)
        at, n = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
        short = size <= LONG
        for i in np.flatnonzero(~short):
            at[i], n[i] = self._keep(self.merge_long(self._symbols(raw, begin[i : i + 1], end[i : i + 1])[0]))
        keys, one, back = np.unique(key[short], return_index=True, return_inverse=True)
        one = np.flatnonzero(short)[one]
        where, count = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known, places, counts in self.memo:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = known[i] == keys
                where[hit], count[hit] = places[i[hit]], counts[i[hit]]
        new = np.flatnonzero(where < 0)
        if len(new):
            symbols, s, e = self._symbols(raw, begin[one[new]], end[one[new]])
            ids, per = self.encode_words(symbols, s, e)
            base, _ = self._keep(ids)
            where[new], count[new] = base + np.concatenate([[0], np.cumsum(per)[:-1]]), per
            self._remember(keys[new], where[new], per)
        at[short], n[short] = where[back], count[back]
        return at, n

    def _symbols(self, raw, begin, end):
        size = end - begin
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        symbols = raw[np.repeat(begin - start, size) + np.arange(size.sum())].astype(np.int64)
        if self.mark:
            symbols[start + size - 1] += END
        return symbols, start, start + size

    def _keep(self, ids: np.ndarray) -> tuple[int, int]:
        while self.pool_n + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        self.pool[self.pool_n : self.pool_n + len(ids)] = ids
        self.pool_n += len(ids)
        return self.pool_n - len(ids), len(ids)

    def _remember(self, keys, places, counts) -> None:
        """Two sorted tables; the small one is merged into the large one when it has grown to a quarter of it."""
        large, small = self.memo
        small = tuple(np.concatenate(x) for x in zip(small, (keys, places, counts.astype(np.int32)), strict=True))
        if len(small[0]) > max(20_000, len(large[0]) // 4):
            large = tuple(np.concatenate(x) for x in zip(large, small, strict=True))
            small = tuple(x[:0] for x in small)
            order = np.argsort(large[0])
            large = tuple(x[order] for x in large)
        order = np.argsort(small[0])
        self.memo = [large, tuple(x[order] for x in small)]

    # ------------------------------------------------------------------ tokens to text

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.byte_len[ids]
        return self.bytes[np.repeat(self.byte_at[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that aren't UTF-8 become replacement characters. Not for vocabularies that mark word ends."""
        return self.decode_bytes(ids).tobytes().decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    """One set of tables for each vocabulary and worker process."""
    return Bpe(path)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encodes every text and decodes its ids; per document the number of tokens and digests of ids and decoded text.

    vocabulary: path of the file, which must exist on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            ids, at = bpe.encode(["" if t is None else t for t in batch["text"].to_pylist()])
            hashes, decoded = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                own = ids[a:b]
                hashes.append(hashlib.sha256(own.astype("<u4", copy=False).tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.diff(at), pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    tune(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
