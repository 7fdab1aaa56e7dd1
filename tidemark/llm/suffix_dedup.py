"""Exact removal of byte strings of `window` bytes that occur again anywhere, by a depth-limited radix sort of suffixes.

Only suffixes' first `window` bytes are ordered, most significant digit first, and a suffix alone in its group leaves at once;
what is left together after the last digit starts a repeated window. The first digit is content-defined: a window is filed
under its least GRAM-byte gram (leftmost of equals), so one record stands for all neighbouring windows with that gram, and
equal windows always meet. Records whose gram occurs once in the corpus drop out; the others bring the bytes their windows
span, and further digits - hashes of the window's thirds - refine the groups within tasks of bounded size; windows that are left
together are compared byte by byte. A gram of more than HOT records is dealt by whole-window digest into several tasks, and each of
these by document into as many again: a window found twice there is decided, the others meet once more, with one of each that was.
So no gram's records, and no window's, are gathered in one task. These windows are told apart by 64-bit digests of digest and place.

Texts that occur more than once are one class, ordered once. Windows that a document itself repeats leave at the first digit,
but for their first place.

Edge cases: null or empty texts have 0 bytes; texts shorter than the window lose nothing; repeated rows count as other
documents, so both lose all from `window` bytes on; null ids stay; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, parts, small_batches, stored, table, text_bytes
from .words import mixed, powers, prefix_sums, span_hashes

WINDOW = 400
GRAM = 64
HOT = 4096
_PLACE = 26


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row."""
    n = len(x)
    blocks = -(-n // w)
    full = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    grid = full.reshape(blocks, w)
    left = np.minimum.accumulate(grid, 1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def _least_places(h: np.ndarray, w: int, bits: int = _PLACE) -> np.ndarray:
    """Where the least of each w values in a row is, by their upper bits, the leftmost of equals; stretch by stretch, so that places
    fit into `bits`."""
    mask, out = np.uint64((1 << bits) - 1), []
    for a in range(0, len(h) - w + 1, (1 << bits) - w):
        part = h[a : a + (1 << bits)]
        least = _sliding_least((part & ~mask) | np.arange(len(part), dtype=np.uint64), w)
        out.append((least & mask).astype(np.int64)[: (1 << bits) - w] + a)
    return np.concatenate(out)


def _bounds_of(flag: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of True in which `same` stay equal."""
    new = flag.copy()
    cut = ~flag[:-1]
    for s in same:
        cut = cut | (s[1:] != s[:-1])
    new[1:] &= cut
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(flag)]]) - 1
    # a run ends where the flag does
    ends = np.flatnonzero(flag & ~np.concatenate([flag[1:], [False]]))
    if len(first):
        last = np.minimum(last, ends[np.searchsorted(ends, first)])
    return first, last


def records(data: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Of texts in a row: (text index, gram hash, gram place, first start, last start) arrays, and (text, first, last) of starts
    of windows that their own text repeats. Places count from the text's begin."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < window:
        return (none, none.astype(np.uint64), none, none, none), (none, none, none)
    sums = prefix_sums(data)
    inverse = powers(np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64)), n + 1)
    h = mixed((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
    p = _least_places(h, window - gram + 1)
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(p)]
    valid = np.arange(len(p)) + window <= bounds[1:][of]
    first, last = _bounds_of(valid, p, of)
    own = np.zeros(len(p), bool)
    if len(first):
        # grams met again in the same text: their windows are compared here
        g = mixed(h[p[first]] + mixed(of[first].astype(np.uint64)))
        order = np.argsort(g, kind="stable")
        twin = np.zeros(len(g), bool)
        eq = g[order][1:] == g[order][:-1]
        twin[order[1:][eq]] = True
        twin[order[:-1][eq]] = True
        if twin.any():
            a, b = first[twin], last[twin]
            s = np.repeat(a - np.concatenate([[0], np.cumsum(b - a + 1)[:-1]]), b - a + 1) + np.arange((b - a + 1).sum())
            key = mixed((sums[s + window] - sums[s]) * inverse[s]) + mixed(of[s].astype(np.uint64))
            _, at, back, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            again = count[back] > 1
            own[s[again]] = True
            later = again.copy()
            later[at] = False
            valid[s[later]] = False
            first, last = _bounds_of(valid, p, of)
    t = of[first]
    base = bounds[:-1][t]
    lo, hi = _bounds_of(own, of)
    return (t, h[p[first]], p[first] - base, first - base, last - base), (of[lo], lo - bounds[:-1][of[lo]], hi - bounds[:-1][of[lo]])


def _lists(of: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.Array]:
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))
    return [pa.ListArray.from_arrays(offsets, pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64))) for c in columns]


def features(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, doc_id, bytes, h, p, a, b, lo, hi): a text's records and own repeats, under the text's digest."""

    def made(batches):
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 18):
                data, bounds = text_bytes(chunk.column("text"))
                rec, own = records(data, bounds, window, gram)
                n = chunk.num_rows
                yield pa.RecordBatch.from_arrays([chunk.column("key"), chunk.column("doc_id"), pa.array(np.diff(bounds)), *_lists(rec[0], n, *rec[1:]), *_lists(own[0], n, *own[1:])], ["key", "doc_id", "bytes", "h", "p", "a", "b", "lo", "hi"])

    return docs.select("key", "doc_id", "text").mapInArrow(made, "key binary, doc_id long, bytes long, h array<long>, p array<long>, a array<long>, b array<long>, lo array<long>, hi array<long>")


def _window_hashes(texts: np.ndarray, bounds: np.ndarray, window: int):
    """Three digits of every window of byte strings in a row, with the string's index and the window's start in it."""
    sums = prefix_sums(texts)
    size = np.diff(bounds) - window + 1
    of = np.repeat(np.arange(len(size)), size)
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    at = bounds[:-1][of] + start
    cuts = [window * k // 3 for k in range(4)]
    return of, start, [span_hashes(sums, at + x, at + y) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


def _dealt(found: DataFrame, window: int) -> DataFrame:
    """Rows (text, key, recs) -> records to sort: h, deal, salt, key, a, rel, payload. deal 0: bytes; else starts and digests."""

    def made(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                data, _ = text_bytes(batch.column("text").slice(row, 1))
                recs = batch.column("recs").slice(row, 1).flatten()
                h, p, a, b, m = (recs.field(k).to_numpy() for k in ("h", "p", "a", "b", "m"))
                key = batch.column("key")[row].as_py()
                out = ([], [], [], [], [], [])
                for k in range(len(h)):
                    piece = data[a[k] : b[k] + window]
                    if m[k] <= HOT:
                        for o, v in zip(out, (h[k], 0, 0, a[k], p[k] - a[k], piece.tobytes()), strict=True):
                            o.append(v)
                    else:
                        _, start, digits = _window_hashes(piece, np.array([0, len(piece)]), window)
                        whole = mixed(mixed(mixed(digits[0]) + digits[1]) + digits[2])
                        deal = (whole % np.uint64(-(-m[k] // HOT) * 4)).astype(np.int64) + 1
                        salt = int.from_bytes(key[:8], "little") % int(-(-m[k] // HOT))
                        for d in np.unique(deal):
                            for o, v in zip(out, (h[k], d, salt, a[k], p[k] - a[k], np.stack([start[deal == d].astype(np.uint64), whole[deal == d]]).tobytes()), strict=True):
                                o.append(v)
                columns = [pa.array(x, pa.int64()) for x in out[:5]]
                yield pa.RecordBatch.from_arrays([*columns[:3], pa.array([key] * len(out[0]), pa.binary()), *columns[3:], pa.array(out[5], pa.binary())], ["h", "deal", "salt", "key", "a", "rel", "payload"])

    return found.select("text", "key", "recs").mapInArrow(made, "h long, deal long, salt long, key binary, a long, rel long, payload binary")


def _same_bytes(data: np.ndarray, at: np.ndarray, group: np.ndarray, window: int) -> np.ndarray:
    """Which windows, beginning at `at`, have the same bytes as another of their group."""
    order = np.lexsort((at, group))
    at, g = at[order], group[order]
    pair = np.flatnonzero(g[1:] == g[:-1])
    words = np.ndarray((len(data) - 7,), np.dtype("<u8"), np.ascontiguousarray(data).data, strides=(1,))
    equal = np.ones(len(pair), bool)
    for a in range(0, len(pair), 1 << 18):
        x, y = at[pair[a : a + (1 << 18)]], at[pair[a : a + (1 << 18)] + 1]
        same = np.ones(len(x), bool)
        for w in [*range(0, window - 7, 8), window - 8]:
            same &= words[x + w] == words[y + w]
        equal[a : a + (1 << 18)] = same
    out = np.zeros(len(at), bool)
    out[pair[equal]] = True
    out[pair[equal] + 1] = True
    # a group whose digests agree though bytes differ is sorted by its bytes
    for bad in np.unique(g[pair[~equal]]):
        lo, hi = np.searchsorted(g, bad), np.searchsorted(g, bad, "right")
        texts = [data[x : x + window].tobytes() for x in at[lo:hi]]
        out[lo:hi] = [texts.count(t) > 1 for t in texts]
    back = np.zeros(len(at), bool)
    back[order] = out
    return back


def _runs_of(rows: pa.Table, row: np.ndarray, start: np.ndarray) -> list[pa.Array]:
    """key, lo, hi of runs of starts, each start of a row of records."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    a = rows.column("a").to_numpy()[row[first]]
    return [rows.column("key").combine_chunks().take(pa.array(row[first])), pa.array(a + start[first]), pa.array(a + start[last])]


_FOUND = "key binary, lo long, hi long, h long, deal long, a long, payload binary"
_NAMES = ["key", "lo", "hi", "h", "deal", "a", "payload"]


def _by_file(rows: DataFrame, keys: tuple[str, ...], passes) -> DataFrame:
    """Deals rows by keys and calls passes(table) with whole files, about 1 MB of payload at a time. Streams."""

    def made(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("payload").nbytes
            if size < 1 << 20:
                continue
            got = pa.Table.from_batches(held)
            other = np.zeros(got.num_rows, bool)
            for k in keys:
                x = got.column(k).to_numpy()
                other |= x != x[-1]
            last = np.flatnonzero(other)
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from passes(got.slice(0, cut))
            held = got.slice(cut).to_batches()
            size = sum(x.column("payload").nbytes for x in held) if cut else size
        if held:
            yield from passes(pa.Table.from_batches(held))

    return rows.repartition(parts(rows.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(made, _FOUND)


def _payloads(payload: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows that hold starts and digests: the row, start and digest of each window."""
    pieces = [np.frombuffer(payload[int(k)].as_buffer(), np.uint64).reshape(2, -1) for k in rows]
    of = np.repeat(rows, [x.shape[1] for x in pieces])
    return of, np.concatenate([x[0] for x in pieces]).astype(np.int64), np.concatenate([x[1] for x in pieces])


def _repeated(dealt: DataFrame, window: int) -> DataFrame:
    """Radix passes over records of one gram -> key, lo, hi: first and last start of runs of repeated windows; and, with payload, the
    windows of hot grams that are still to be decided, under a null key one of each that is."""

    def passes(rows: pa.Table):
        deal, rel = rows.column("deal").to_numpy(), rows.column("rel").to_numpy().astype(np.uint64)
        h = rows.column("h").to_numpy()
        file_ = mixed(mixed(h.view(np.uint64)) + deal.astype(np.uint64))
        payload = rows.column("payload").combine_chunks()
        plain = np.flatnonzero(deal == 0)
        hot = np.flatnonzero(deal != 0)
        got_row, got_start = [], []
        if len(plain):
            raw = payload.take(pa.array(plain)).cast(pa.large_binary())
            bounds = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
            bounds = bounds - bounds[0]
            of, start, digits = _window_hashes(data, bounds, window)
            # filed by gram and by the gram's place in the window
            group = mixed(file_[plain][of] + mixed(rel[plain][of] - start.astype(np.uint64)))
            alive = np.arange(len(of))
            for digit in digits:
                group = mixed(group + mixed(digit[alive]))
                order = np.argsort(group)
                g = group[order]
                same = np.zeros(len(g), bool)
                eq = g[1:] == g[:-1]
                same[1:] |= eq
                same[:-1] |= eq
                keep = np.sort(order[same])
                alive, group = alive[keep], group[keep]
            alive = alive[_same_bytes(data, bounds[of[alive]] + start[alive], group, window)] if len(alive) else alive
            got_row.append(plain[of[alive]])
            got_start.append(start[alive])
        open_ = []
        if len(hot):
            of, start, whole = _payloads(payload, hot)
            group = mixed(mixed(file_[of] + mixed(rel[of] - start.astype(np.uint64))) + whole)
            _, at, back, count = np.unique(group, return_index=True, return_inverse=True, return_counts=True)
            again = count[back] > 1
            got_row.append(of[again])
            got_start.append(start[again])
            cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            for a, b in zip(cut, [*cut[1:], len(of)], strict=True):
                one = ~again[a:b]
                if one.any():
                    open_.append((int(of[a]), False, np.stack([start[a:b][one].astype(np.uint64), group[a:b][one]]).tobytes()))
            for k in np.unique(of[at[count > 1]]):
                own = group[at[count > 1]][of[at[count > 1]] == k]
                open_.append((int(k), True, np.stack([np.zeros(len(own), np.uint64), own]).tobytes()))
        row, start = np.concatenate(got_row), np.concatenate(got_start)
        if len(row):
            marks = _runs_of(rows, row, start)
            yield pa.RecordBatch.from_arrays([*marks, *[pa.nulls(len(marks[0]), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]], _NAMES)
        if open_:
            at = np.array([x[0] for x in open_])
            keys = rows.column("key").combine_chunks().take(pa.array(at, mask=np.array([x[1] for x in open_])))
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([keys, none, none, pa.array(h[at]), pa.array(deal[at]), pa.array(rows.column("a").to_numpy()[at]), pa.array([x[2] for x in open_], pa.binary())], _NAMES)

    return _by_file(dealt, ("h", "deal", "salt"), passes)


def _decided(left: DataFrame) -> DataFrame:
    """What _repeated left open -> key, lo, hi of windows that meet another after all."""

    def passes(rows: pa.Table):
        of, start, group = _payloads(rows.column("payload").combine_chunks(), np.arange(rows.num_rows))
        _, back, count = np.unique(group, return_inverse=True, return_counts=True)
        hit = (count[back] > 1) & rows.column("key").combine_chunks().is_valid().to_numpy(zero_copy_only=False)[of]
        if hit.any():
            marks = _runs_of(rows, of[hit], start[hit])
            yield pa.RecordBatch.from_arrays([*marks, *[pa.nulls(len(marks[0]), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]], _NAMES)

    return _by_file(left.select("key", "h", "deal", "a", "payload"), ("h", "deal"), passes).select("key", "lo", "hi")


def _removed(n: int, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under windows that start in the given runs."""
    order = np.argsort(lo, kind="stable")
    a, b = lo[order], np.maximum.accumulate(hi[order] + window) if len(lo) else hi
    if not len(a):
        return a, b
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > b[:-1]
    first = np.flatnonzero(new)
    return a[first], b[np.concatenate([first[1:], [len(a)]]) - 1]


def deduplicated(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """documents -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end pairs); with_text adds kept (binary)."""
    spark = docs.sparkSession
    small_batches(spark, 200)
    gram = min(GRAM, max(1, window // 4))
    keyed = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    f = features(keyed, window, gram)
    classes = stored(f.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first(F.struct("bytes", "h", "p", "a", "b", "lo", "hi")).alias("x")).select("key", "copies", "rep", "x.*"))
    recs = classes.select("key", F.explode(F.arrays_zip("h", "p", "a", "b")).alias("r")).select("key", "r.*")
    often = recs.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    live = stored(recs.join(often, "h").groupBy("key").agg(F.collect_list(F.struct("h", "p", "a", "b", "m")).alias("recs")))
    live = live.join(classes.select("key", "rep"), "key").select(F.col("key").alias("key_"), "rep", "recs")
    found = keyed.join(live, (F.col("key") == F.col("key_")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    runs = stored(_repeated(_dealt(found, window), window))
    left = runs.where("payload is not null")
    runs = runs.where("payload is null").select("key", "lo", "hi")
    runs = runs if left.isEmpty() else runs.unionByName(_decided(left))
    own = classes.where(F.size("lo") > 0).select("key", F.explode(F.arrays_zip("lo", "hi")).alias("z")).select("key", "z.lo", "z.hi")
    whole = classes.where((F.col("copies") > 1) & (F.col("bytes") >= window)).select("key", F.lit(0).cast("long").alias("lo"), (F.col("bytes") - window).alias("hi"))
    marks = runs.unionByName(own).unionByName(whole).groupBy("key").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")).select(F.col("key").alias("key_"), "lo", "hi")

    def cut(batches):
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data, _ = text_bytes(batch.column("text").slice(k, 1))
                lo, hi = (batch.column(c).slice(k, 1).flatten().to_numpy() for c in ("lo", "hi"))
                a, b = _removed(len(data), lo, hi, window)
                kept = b"".join(data[x:y].tobytes() for x, y in zip(np.concatenate([[0], b]).astype(int), np.concatenate([a, [len(data)]]).astype(int), strict=True))
                rows.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), np.stack([a, b], 1).reshape(-1), kept if with_text else None))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays[: 7 if with_text else 6], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][: 7 if with_text else 6])

    # copies of one text may be many; a join that Spark can split holds them
    out = keyed.join(marks, F.col("key") == F.col("key_"), "left").select("doc_id", "text", "lo", "hi")
    return out.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept binary" * with_text)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(table(spark, sf_dir, "documents")).drop("spans")
