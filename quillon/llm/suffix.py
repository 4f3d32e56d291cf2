"""Removal of repeated text by bucket-pointer refinement of suffixes, over whole texts as UTF-8 bytes or as words.

A text is a sequence of symbols (`Unit`): its bytes, or its words between white space, A-Z lowered, each as a
64-bit hash. Every window of `length` symbols belongs to one anchor, its q-gram of the smallest hash; consecutive windows of
one anchor make a run. Equal windows lie in runs of one anchor key, so the anchors are the initial q-gram
buckets, dealt over the cluster, and no others need to meet. In a bucket, runs of equal symbols are one content:
contents that occur twice are repeated as a whole. Only contents that stand alone in a bucket with others are
refined: suffixes are first bucketed by eight bytes or one word, and buckets are refined by sorting on the bucket
identifiers of later offsets, which double the depth each time (`repeated_windows`).

A bucket of more than LIMIT contents is refined by the cluster instead: its runs are split into shorter ones,
whose new bucket is the old one with the symbols that all their windows share, again and again down to single
windows. So no bucket has to fit a task, and nothing is left out.

Defined cases: null text counts as empty; texts shorter than `length` lose nothing; repeated rows repeat each
other; rows are known by doc_id and text together, so that ids may be null or repeat; columns beyond these
pass through `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize, partitions, release, squeezed, tune
from quillon.llm.words import mix, powers, word_bounds, word_hashes

LIMIT = 4000
LEVELS = [48, 6, 1]
#: Contents refined together in a task.
GROUP = 1500
CHUNK = 1 << 19
#: Words of a passage whose repetition counts: over 50.
PASSAGE = 51


@dataclass(frozen=True)
class Unit:
    """What texts are sequences of: a symbol's size in bytes, the symbols of an anchor, and those of a first bucket."""

    size: int
    gram: int
    first: int

    def symbols(self, raw: bytes) -> bytes:
        return raw if self.size == 1 else word_hashes([raw])[0].tobytes()

    def array(self, symbols: bytes) -> np.ndarray:
        return np.frombuffer(symbols, np.uint8 if self.size == 1 else np.uint64)

    def spans(self, raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Ranges of symbols as ranges of bytes; blanks around words belong to none."""
        if self.size == 1 or not ranges:
            return ranges
        begin, end = word_bounds(raw)
        return [(int(begin[a]), int(end[b - 1])) for a, b in ranges]


BYTES, WORDS = Unit(1, 32, 8), Unit(8, 5, 1)

ROW = "key long, c1 long, c2 long, n int, doc long, k long, p long, windows int, ahead int"


def anchored_runs(raw: np.ndarray, text_at: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows (start, windows, symbols from the start to the anchor, key of the anchor): all windows of `length` symbols that lie within a text.

    A window's anchor is its q-gram of the smallest hash, the first of these. Consecutive windows with one
    anchor make a run. Equal windows have equal anchors at equal offsets, so they are in runs of one key.
    """
    n, w = len(raw), length - q + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    up, down = powers(1 << int(n).bit_length())
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        gram = mix((total[q:] - total[:-q]) * down[: n - q + 1])
    low = np.uint64((1 << 24) - 1)
    ranked = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    blocks = -(-len(ranked) // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(ranked)] = ranked
    padded = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    count = n - length + 1
    anchor = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
    inside = np.zeros(count + length, np.int32)  # windows that lie within a text
    starts, ends = text_at[:-1], np.maximum(text_at[1:] - length + 1, text_at[:-1])
    np.add.at(inside, starts, 1)
    np.add.at(inside, np.minimum(ends, len(inside) - 1), -1)
    valid = np.cumsum(inside[:count]) > 0
    first = valid.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    text_first = starts[(starts < count)]
    first[text_first] = valid[text_first]
    begin = np.flatnonzero(first)
    stop = np.zeros(count + 1, bool)
    stop[:-1] = first | ~valid
    stop[-1] = True
    stops = np.flatnonzero(stop)
    end = stops[np.searchsorted(stops, begin, "right")]
    return begin, end - begin, anchor[begin] - begin, gram[anchor[begin]].view(np.int64)


def repeated_windows(text: np.ndarray, start: np.ndarray, windows: np.ndarray, length: int, depth: int = 8) -> np.ndarray:
    """Which windows of `length` symbols, beginning at the first `windows` symbols of each slice text[start:], occur twice.

    Bucket-pointer refinement: a position's bucket at depth d and that of the position d further give its
    bucket at depth 2 d; sorting the pairs gives the new pointers. Positions alone in their bucket stay so.
    """
    at = np.repeat(start - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    size = windows + length - 1
    every = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    room = np.repeat(start + size, size) - every  # symbols from a position to its slice's end
    if depth == 1:
        gram = text[every]
    else:  # eight bytes
        padded = np.concatenate([text, np.zeros(depth, np.uint8)])
        gram = np.lib.stride_tricks.sliding_window_view(padded, depth)[every].copy().view(">u8").ravel()
    pointer = np.full(len(text) + 1, -1, np.int64)
    fit = room >= depth
    pointer[every[fit]] = np.unique(gram[fit], return_inverse=True)[1]
    while depth * 2 <= length:
        every, room = every[room >= 2 * depth], room[room >= 2 * depth]
        pair = pointer[every] * len(pointer) + pointer[every + depth]
        fresh = np.unique(pair, return_inverse=True)[1]
        pointer[every] = fresh
        depth *= 2
    pair = pointer[at] * len(pointer) + pointer[at + length - depth]
    _, back, count = np.unique(pair, return_inverse=True, return_counts=True)
    return count[back] > 1


def _keys(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _doc_key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("doc_id", "text").alias("k")


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: v if isinstance(v, pa.Array) else pa.array(v) for n, v in columns.items()})


def _row_batch(key, c1, c2, n, doc, k, p, windows, ahead, **more) -> pa.RecordBatch:
    return _batch(key=key, c1=pa.array(c1, pa.int64()), c2=pa.array(c2, pa.int64()), n=pa.array(n, pa.int32()), doc=pa.array(doc, pa.int64()), k=pa.array(k, pa.int64()), p=pa.array(p, pa.int64()), windows=pa.array(windows, pa.int32()), ahead=pa.array(ahead, pa.int32()), **more)


def runs(docs: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """Rows of ROW: runs with their anchor key and content digest, once per content and batch (n: 1, or 2 for more).

    Runs whose content repeats within the batch are rows without a key too: they are known to be repeated.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            doc, k = batch["doc"].to_numpy(), batch["k"].to_numpy()
            parts: list[tuple[int, int, bytes]] = []
            held = 0
            for i, text in enumerate(batch["text"].to_pylist()):
                if text is None or len(raw := unit.symbols(text.encode())) < length * unit.size:
                    continue
                chunk = CHUNK // unit.size
                for at in range(0, len(raw) // unit.size - length + 1, chunk):
                    parts.append((i, at, raw[at * unit.size : (at + chunk + length - 1) * unit.size]))
                    held += len(parts[-1][2])
                    if held > CHUNK:
                        yield from emit(parts, doc, k)
                        parts, held = [], 0
            if parts:
                yield from emit(parts, doc, k)

    def emit(parts, doc, k):
        joined = b"".join(p for _, _, p in parts)
        text_at = np.concatenate([[0], np.cumsum([len(p) // unit.size for _, _, p in parts])])
        begin, windows, ahead, key = anchored_runs(unit.array(joined), text_at, length, unit.gram)
        if not len(begin):
            return
        view = memoryview(joined)
        digests = [xxhash.xxh3_128_digest(view[a * unit.size : (a + w + length - 1) * unit.size]) for a, w in zip(begin.tolist(), windows.tolist(), strict=True)]
        c1, c2 = _keys(digests)
        owner = np.searchsorted(text_at, begin, "right") - 1
        row = np.array([i for i, _, _ in parts])[owner]
        p = begin - text_at[owner] + np.array([a for _, a, _ in parts])[owner]
        _, one, back, count = np.unique(c1 ^ (c2 << 1), return_index=True, return_inverse=True, return_counts=True)
        again = count[back] > 1
        yield _row_batch(key[one], c1[one], c2[one], np.minimum(count, 2), doc[row[one]], k[row[one]], p[one], windows[one], ahead[one])
        if again.any():
            r, a, w = row[again], p[again], windows[again]
            # runs that follow each other are one range
            joins = np.concatenate([[False], (r[1:] == r[:-1]) & (a[1:] == a[:-1] + w[:-1])])
            head = np.flatnonzero(~joins)
            w = np.add.reduceat(w, head)
            none = pa.nulls(len(head), pa.int64())
            yield _row_batch(none, np.zeros(len(head)), np.zeros(len(head)), np.full(len(head), 2), doc[r[head]], k[r[head]], a[head], w, np.zeros(len(head)))

    rows = docs.select(*_doc_key(), "text")
    return rows.mapInArrow(scan, ROW)


def _resolve(rows: DataFrame, name: str, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ranges known to be repeated, and the single contents (one row each, m in the bucket) of buckets with several.

    What joins by key are written tables on both sides, so that Spark can split the rows of a hot anchor.
    """
    spot = [F.col(c) for c in ("doc", "k", "p", "windows")]
    keyed = rows.where("key is not null")
    shared = keyed.groupBy("key").agg(F.sum("n").alias("total"), F.min("c1").alias("lo1"), F.max("c1").alias("hi1"), F.min("c2").alias("lo2"), F.max("c2").alias("hi2")).where("total > 1")
    shared = materialize(shared.select("key", ((F.col("lo1") != F.col("hi1")) | (F.col("lo2") != F.col("hi2"))).alias("mixed")), f"{name}-shared")
    kept = materialize(keyed.join(shared, "key"), f"{name}-kept")
    whole = kept.where(~F.col("mixed")).select(*spot)
    mixed = kept.where("mixed")
    rep = F.min(F.struct("doc", "k", "p", "windows", "ahead", *carried)).alias("rep")
    contents = materialize(mixed.groupBy("key", "c1", "c2").agg(F.sum("n").alias("n"), rep), f"{name}-contents")
    twice = mixed.join(contents.where("n > 1").select("key", "c1", "c2"), ["key", "c1", "c2"]).select(*spot)
    many = contents.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least")).where("least = 1 and m > 1").select("key", "m")
    many = materialize(many, f"{name}-many")
    alone = contents.join(many, "key").select("key", "m", "n", "rep.*")
    return whole.unionByName(twice), alone


def repeated_ranges(docs: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """(doc, k, p, windows): ranges of window starts that occur elsewhere too; they may touch or repeat."""
    tune(docs.sparkSession)
    rows = materialize(runs(docs, length, unit), "runs")
    local = rows.where("key is null").select("doc", "k", "p", "windows")
    whole, alone = _resolve(rows, "runs", [])
    found = [local, whole]
    slices = materialize(_slices(docs, alone, length, unit), "slices")
    for level in [*LEVELS, 0]:
        total = slices.where(F.col("m") <= LIMIT).count()
        if total:
            found.append(_refine(slices.where(F.col("m") <= LIMIT), max(4 * partitions(docs.sparkSession), -(-total // GROUP)), length, unit))
        hot = slices.where(F.col("m") > LIMIT)
        if not level or hot.isEmpty():
            break
        whole, alone = _resolve(materialize(_split(hot, level, length, unit), f"split-{level}"), f"split-{level}", ["slice"])
        found.append(whole)
        slices = materialize(alone, f"slices-{level}")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _slices(docs: DataFrame, alone: DataFrame, length: int, unit: Unit) -> DataFrame:
    """Adds the symbols of each content, cut from its document."""
    wanted = alone.groupBy("doc", "k").agg(F.collect_list(F.struct("key", "m", "n", "p", "windows", "ahead")).alias("wanted"))
    texts = squeezed(docs.select(*_doc_key(), "text"))
    joined = texts.join(wanted, ["doc", "k"]).dropDuplicates(["doc", "k"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for doc, k, text, wanted in zip(batch["doc"].to_pylist(), batch["k"].to_pylist(), batch["text"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
                raw = unit.symbols(inflate(text))
                for a in range(0, len(wanted), 2000):
                    w = wanted[a : a + 2000]
                    pieces = [raw[x["p"] * unit.size : (x["p"] + x["windows"] + length - 1) * unit.size] for x in w]
                    yield _batch(key=pa.array([x["key"] for x in w], pa.int64()), m=pa.array([x["m"] for x in w], pa.int64()), n=pa.array([x["n"] for x in w], pa.int64()), doc=pa.array([doc] * len(w), pa.int64()), k=pa.array([k] * len(w), pa.int64()), p=pa.array([x["p"] for x in w], pa.int64()), windows=pa.array([x["windows"] for x in w], pa.int32()), ahead=pa.array([x["ahead"] for x in w], pa.int32()), slice=pa.array(pieces, pa.binary()))

    return joined.mapInArrow(cut, "key long, m long, n long, doc long, k long, p long, windows int, ahead int, slice binary")


def _refine(slices: DataFrame, groups: int, length: int, unit: Unit) -> DataFrame:
    """Ranges of repeated windows of contents that occur once, among all contents of their buckets."""

    def refine(table: pa.Table) -> pa.Table:
        pieces = table["slice"].to_pylist()
        windows = table["windows"].to_numpy().astype(np.int64)
        n, p = table["n"].to_numpy(), table["p"].to_numpy()
        start = np.concatenate([[0], np.cumsum([len(x) // unit.size for x in pieces])[:-1]]).astype(np.int64)
        again = repeated_windows(unit.array(b"".join(pieces)), start, windows, length, unit.first)
        owner = np.repeat(np.arange(len(pieces)), windows)
        again &= n[owner] == 1
        at = np.concatenate([[0], np.cumsum(windows)[:-1]])
        within = np.arange(len(owner)) - at[owner]
        before = np.concatenate([[False], again[:-1] & (owner[1:] == owner[:-1])])
        after = np.concatenate([again[1:] & (owner[1:] == owner[:-1]), [False]])
        first, last = np.flatnonzero(again & ~before), np.flatnonzero(again & ~after)
        o = owner[first]
        return pa.table({"doc": table["doc"].to_numpy()[o], "k": table["k"].to_numpy()[o], "p": p[o] + within[first], "windows": pa.array(last - first + 1, pa.int32())})

    dealt = slices.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInArrow(refine, "doc long, k long, p long, windows int")


def _split(hot: DataFrame, level: int, length: int, unit: Unit) -> DataFrame:
    """Splits runs into runs of at most `level` windows; the new key takes in the symbols that all windows there share.

    The cuts lie at fixed distances from the anchor, which are the same in all runs of the bucket.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, spots, pieces = [], [], []
            for key, n, doc, k, p, windows, ahead, piece in zip(*(batch[c].to_pylist() for c in ("key", "n", "doc", "k", "p", "windows", "ahead", "slice")), strict=True):
                at = 0
                while at < windows:  # the window at `at` begins ahead - at symbols before the anchor
                    part = (ahead - at) // level
                    w = min(windows - at, ahead - at - part * level + 1)
                    near = ahead - part * level  # the symbols from here are in all windows of this part
                    core = piece[near * unit.size : max(near, near - level + 1 + length) * unit.size]
                    keys.append(xxhash.xxh3_64_intdigest(core, seed=(key ^ part) & 0xFFFFFFFFFFFFFFFF))
                    spots.append((min(n, 2), doc, k, p + at, w, ahead - at))
                    pieces.append(piece[at * unit.size : (at + w + length - 1) * unit.size])
                    at += w
            if keys:
                c1, c2 = _keys([xxhash.xxh3_128_digest(x) for x in pieces])
                n, doc, k, p, w, ahead = zip(*spots, strict=True)
                yield _row_batch(np.array(keys, np.uint64).view(np.int64), c1, c2, n, doc, k, p, w, ahead, slice=pa.array(pieces, pa.binary()))

    return hot.mapInArrow(split, f"{ROW}, slice binary")


def merged(starts: list[int], windows: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal runs (first symbol, past the last) of the symbols that the windows cover."""
    out: list[list[int]] = []
    for a, w in sorted(zip(starts, windows, strict=True)):
        b = a + w + length - 1
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _with_ranges(docs: DataFrame, searches: dict[str, tuple[int, Unit]]) -> DataFrame:
    """All columns of docs, text compressed; for each search (length, unit) arrays `<name>_starts` and `<name>_counts` of the repeated windows."""
    doc, k = _doc_key()
    out = squeezed(docs.select("*", doc.alias("_doc"), k.alias("_k")))
    for name, (length, unit) in searches.items():
        ranges = repeated_ranges(docs, length, unit).groupBy(F.col("doc").alias("_doc"), F.col("k").alias("_k"))
        out = out.join(ranges.agg(F.collect_list("p").alias(f"{name}_starts"), F.collect_list("windows").alias(f"{name}_counts")), ["_doc", "_k"], "left")
    return out.drop("_doc", "_k")


def removal_report(docs: DataFrame, length: int, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row, without the bytes of repeated windows.

    With `passage`, also n_passages and passage_words: the maximal runs of words that passages of that many
    words cover which occur elsewhere too, and their words. They are found whatever their bytes, and not removed.
    """
    searches = {"_b": (length, BYTES)} | ({"_w": (passage, WORDS)} if passage else {})

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, removed, spans, digests = [], [], [], []
            for text, starts, counts in zip(batch["text"].to_pylist(), batch["_b_starts"].to_pylist(), batch["_b_counts"].to_pylist(), strict=True):
                raw, cut = inflate(text), merged(starts or [], counts or [], length)
                sha, at = hashlib.sha256(), 0
                for a, b in cut:
                    sha.update(raw[at:a])
                    at = b
                sha.update(raw[at:])
                sizes.append(len(raw))
                removed.append(sum(b - a for a, b in cut))
                spans.append(len(cut))
                digests.append(sha.hexdigest())
            more = {}
            if passage:
                runs_of = [merged(a or [], n or [], passage) for a, n in zip(batch["_w_starts"].to_pylist(), batch["_w_counts"].to_pylist(), strict=True)]
                more = {"n_passages": pa.array([len(r) for r in runs_of], pa.int64()), "passage_words": pa.array([sum(b - a for a, b in r) for r in runs_of], pa.int64())}
            yield _batch(doc_id=batch["doc_id"], n_bytes=pa.array(sizes, pa.int64()), n_removed=pa.array(removed, pa.int64()), n_spans=pa.array(spans, pa.int64()), kept_sha256=pa.array(digests, pa.string()), **more)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _with_ranges(docs.select("doc_id", "text"), searches)
    more = ", n_passages long, passage_words long" if passage else ""
    return rows.mapInArrow(report, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def without_repeats(docs: DataFrame, length: int, unit: Unit = BYTES) -> DataFrame:
    """All columns of docs, with the repeated symbols cut out of text; characters that are cut into stay whole. Null texts stay null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for text, starts, counts in zip(batch["text"].to_pylist(), batch["_r_starts"].to_pylist(), batch["_r_counts"].to_pylist(), strict=True):
                raw, at, kept = inflate(text), 0, []
                for a, b in unit.spans(raw, merged(starts or [], counts or [], length)):
                    while a < b and raw[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                        b -= 1
                    kept.append(raw[at:a])
                    at = b
                out.append(b"".join([*kept, raw[at:]]).decode())
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(out, pa.string())], ["row", "text"])

    names = docs.columns
    others = [F.col(f"`{c}`") for c in names if c != "text"]
    inner = docs.select(F.struct(*others, F.col("text").isNull().alias("_null")).alias("row"), "doc_id", "text")
    kept = _with_ranges(inner, {"_r": (length, unit)}).mapInArrow(cut, f"row {inner.schema['row'].dataType.simpleString()}, text string")
    text = F.when(~F.col("row._null"), F.col("text"))
    return kept.select(*[text.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names])
