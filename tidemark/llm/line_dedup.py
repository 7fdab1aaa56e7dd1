"""Line dedup by an exact set-similarity join; of similar lines the first stays.

A line's set holds its distinct lower-cased words. A line goes if some line before it, in order of (doc_id, line number), has
Jaccard similarity of `percent` hundredths or more, whether or not that one stays. Tokens are ordered by rarity; a line is
indexed under its prefix; lines that share a prefix token meet if the length and position filters and a parity sketch of a bit
a token or more (whose differing bits never outnumber the differing tokens) allow it; what remains is verified on whole sets.

Entries come packed, many to a row; rows come sorted by label, and all of a token's entries have one label. Equal sets collapse while
a label's rows stream by: their first line alone stays in the token's run, the others are removed at once. The pairs of a run that
length allows are looked at in blocks of at most PAIRS. A run of over RUN lines isn't paired there: its lines go out again, and squares of two blocks of them are dealt to many tasks. Each line takes its BEST
nearest earlier ones; a line that had more and isn't removed by those is compared with all of them in a second pass, so no pair is lost.

Edge cases: lines without words always stay; null and empty texts have no lines; rows with a null doc_id neither lose nor
remove lines; rows that share a doc_id count as one document, lines of one number standing or falling together; a text that
loses all its lines becomes empty; empty tables give empty results; other columns pass by untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, in_chunks, parts, small_batches, stored, table, text_bytes, with_ids
from .words import filter_place, frequency_sketch, id_filter, mixed, word_hashes

PERCENT = 80
#: Candidates that a line sends to verification first, nearest first.
BEST = 4
#: Lines of a run, or of a block of a longer run, that are paired in one task.
RUN = 4096
#: Blocks of a longer run have this many lines for each root of the run's, and half of RUN at least.
SPREAD = 16
#: Pairs looked at, and held, at a time.
PAIRS = 1 << 17
#: Words of the widest sketch, 64 bits each.
WIDEST = 64
#: Labels for each task, and entries that are packed into a row at most.
LABELS = 4
PACK = 8192
#: Bytes of entries that are held before they are packed, and entries that are held before they are paired.
HELD_BYTES = 1 << 24
HELD = 50_000
_LINES = 1 << 16
#: An entry's words: set digest, document, line << 32 | set size, late << 32 | position; the sketch follows.
_HEAD = 4


def line_bounds(data: np.ndarray, bounds: np.ndarray):
    """Begin of every line of texts in a row, and text and number of each."""
    cut = np.flatnonzero(data == 10)
    lines = np.diff(np.searchsorted(cut, bounds)) + 1
    first = np.cumsum(lines) - lines
    start, later = np.empty(int(lines.sum()), np.int64), np.ones(int(lines.sum()), bool)
    later[first] = False
    start[first], start[later] = bounds[:-1], cut + 1
    of = np.repeat(np.arange(len(lines)), lines)
    return start, of, np.arange(len(of)) - first[of]


def needed(n1, n2, percent):
    return -((-percent * (n1 + n2)) // (100 + percent))


def sketch_words(n: np.ndarray) -> np.ndarray:
    """A power of two, a word for each 64 tokens or fewer."""
    return np.minimum(WIDEST, 1 << np.ceil(np.log2(np.maximum(n, 64) / 64)).astype(np.int64))


def _sketches(token: np.ndarray, begin: np.ndarray, n: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Parity sketches of sets in a row, one after the other."""
    bits = 64 * width
    at = np.cumsum(bits) - bits
    cell = np.repeat(at, n) + (token & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(cell, minlength=int(bits.sum())) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def index_entries(data: np.ndarray, bounds: np.ndarray, doc: np.ndarray, level: np.ndarray, percent: int, wanted=None):
    """Prefix entries of all lines, in parts: token, line and position of each entry, words of all lines, and where each line's begin.
    wanted: bitmaps of tokens to make entries of, and of lines to mark as late."""
    start, of, number = line_bounds(data, bounds)
    h, _, line = word_hashes(data, np.append(start, len(data)))
    for l0 in range(0, len(start), _LINES):
        a, b = np.searchsorted(line, (l0, l0 + _LINES))
        if a == b:
            continue
        x = np.sort(((line[a:b] - l0).astype(np.uint64) << np.uint64(48)) | (h[a:b] >> np.uint64(16)))
        x = x[np.concatenate([[True], x[1:] != x[:-1]])]
        token, at = x & np.uint64((1 << 48) - 1), (x >> np.uint64(48)).astype(np.int64)
        begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(begin, len(at)))
        sig = mixed(np.add.reduceat(mixed(token), begin) + n.astype(np.uint64))
        width = sketch_words(n)
        sketch, sketch_at = _sketches(token, begin, n, width), np.cumsum(width) - width
        y = np.sort((at.astype(np.uint64) << np.uint64(48)) | (level[(token >> np.uint64(30)).astype(np.int64)].astype(np.uint64) << np.uint64(40)) | (token >> np.uint64(8)))
        size = n - (-(-percent * n // 100)) + 1
        # sets of fewer than k words, where no other size and no other set is similar enough, are found as equals only
        size = np.where(100 * (n - 1) < percent * n, np.where(100 * n < percent * (n + 1), 1, size), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.repeat(np.arange(len(n)), size)
        key = y[np.repeat(begin, size) + pos].astype(np.uint32).view(np.int32)
        where = at[begin] + l0
        late = np.zeros(len(n), np.uint64)
        if wanted is not None:
            keep = _in(wanted[0], key.astype(np.int64))
            key, pos, own = key[keep], pos[keep], own[keep]
            late = _in(wanted[1], _line_ids(doc[of[where]], number[where])).astype(np.uint64)
        begins = np.append(0, np.cumsum(width + _HEAD))
        out = np.empty(begins[-1], np.uint64)
        head = begins[:-1]
        out[head], out[head + 1] = sig, doc[of[where]].view(np.uint64)
        out[head + 2] = (number[where].astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)
        out[head + 3] = late << np.uint64(32)
        out[np.arange(len(sketch)) + np.repeat(head + _HEAD - sketch_at, width)] = sketch
        yield key, own, pos, out, begins


def _in(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = filter_place(ids)
    return ((bits[at >> 3] >> (7 - (at & 7))) & 1).astype(bool)


def _line_ids(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """What line_id() makes."""
    return doc % (1 << 40) * 1_000_003 + line


def rarity_levels(docs: DataFrame):
    """Broadcast: a step of log count for each bucket of words."""
    counts = frequency_sketch(docs.sparkSession, docs, lambda data, bounds: word_hashes(data, bounds)[0])
    level = np.minimum(255, np.log2(counts + 1.0) * 6).astype(np.uint8)
    return docs.sparkSession.sparkContext.broadcast(level)


def _dealt_to(x: np.ndarray, tasks: int) -> np.ndarray:
    """Where Spark's hash partitioning puts ints: Murmur3, seed 42. Only the evenness of labels rests on it."""
    turned = lambda y, k: (y << np.uint32(k)) | (y >> np.uint32(32 - k))
    y = turned(x.astype(np.int32).view(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    y = (turned(y ^ np.uint32(42), 13) * np.uint32(5) + np.uint32(0xE6546B64)) ^ np.uint32(4)
    y = (y ^ (y >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    y = (y ^ (y >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (y ^ (y >> np.uint32(16))).view(np.int32).astype(np.int64) % tasks


def labels_for(tasks: int, each: int) -> np.ndarray:
    """Ints of which each of so many tasks gets as many."""
    to = _dealt_to(np.arange(tasks * (4 * each + 32)), tasks)
    order = np.argsort(to, kind="stable")
    nth = np.arange(len(to)) - np.searchsorted(to[order], to[order])
    return np.sort(order[nth < each]).astype(np.int32)


def packed(some: list[tuple], labels: np.ndarray):
    """Parts that index_entries made -> batches of (label, data). A row's words: the number of its entries, token << 32 | length of
    each, and the entries' own: those of the line, with the position."""
    key, pos, words = (np.concatenate([x[k] for x in some]) for k in (0, 2, 3))
    lines = np.cumsum([0, *(len(x[4]) - 1 for x in some)])
    own = np.concatenate([x[1] + k for x, k in zip(some, lines, strict=False)])
    long = np.concatenate([np.diff(x[4]) for x in some])
    width, at = long[own], (np.cumsum(long) - long)[own]
    group = (mixed(key.view(np.uint32).astype(np.uint64)) % np.uint64(len(labels))).astype(np.int32)
    order = np.argsort(group, kind="stable")
    for a in range(0, len(order), HELD):
        pick = order[a : a + HELD]
        g, w = group[pick], width[pick]
        new = np.concatenate([[True], g[1:] != g[:-1]])
        new[::PACK] = True
        first = np.flatnonzero(new)
        m = np.diff(np.append(first, len(pick)))
        done = np.cumsum(w) - w
        # a row begins behind the words of the entries before it, two words an entry and one a row
        begin = done[first] + first + np.arange(len(first))
        row = np.repeat(np.arange(len(first)), m)
        out = np.empty(int(w.sum()) + len(pick) + len(first), np.uint64)
        out[begin] = m
        out[np.arange(len(pick)) + done[first][row] + row + 1] = (key[pick].view(np.uint32).astype(np.uint64) << np.uint64(32)) | w.astype(np.uint64)
        step, to = np.arange(w.sum()), (first + m)[row] + row + 1
        out[step + np.repeat(to, w)] = words[step + np.repeat(at[pick] - done, w)]
        out[done + to + 3] |= pos[pick].astype(np.uint64)
        buffers = [None, pa.py_buffer((np.append(begin, len(out)) * 8).astype(np.int32)), pa.py_buffer(out)]
        yield pa.RecordBatch.from_arrays([pa.array(labels[g[first]]), pa.Array.from_buffers(pa.binary(), len(first), buffers)], ["label", "data"])


def entries(docs: DataFrame, percent: int, rarity, labels: np.ndarray, wanted=None) -> DataFrame:
    """(label, data): prefix entries of all lines, packed; wanted as in index_entries, broadcast."""

    def made(batches):
        held, size = [], 0
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 19):
                doc = chunk.column("doc_id").to_numpy()
                for part in index_entries(*text_bytes(chunk.column("text")), doc, rarity.value, percent, wanted and wanted.value):
                    held.append(part)
                    size += 8 * int(np.diff(part[4])[part[1]].sum())
                    if size >= HELD_BYTES:
                        yield from packed(held, labels)
                        held, size = [], 0
        if held:
            yield from packed(held, labels)

    return with_ids(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(made, "label int, data binary")


def _words_of(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of a binary column's values, and where each value begins in them."""
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(bytearray(memoryview(data.buffers()[2])[offsets[0] : offsets[-1]]), np.uint64), (offsets[:-1] - offsets[0]) // 8


class Lines:
    """Entries of some runs as arrays; `words` holds their data, `at` where each entry's begins."""

    FIELDS = ("token", "sig", "doc", "line", "n", "pos", "late", "side", "at")

    def __init__(self, words: np.ndarray, **fields: np.ndarray):
        self.words = words
        self.__dict__ |= fields

    @classmethod
    def of(cls, token: np.ndarray, data: pa.Array, side: np.ndarray | None = None) -> Lines:
        words, at = _words_of(data)
        return cls.at_places(token, words, at, np.zeros(len(at), np.int64) if side is None else side)

    @classmethod
    def unpacked(cls, label: np.ndarray, data: pa.Array) -> Lines:
        """Rows that packed() made; the label is the side."""
        words, begin = _words_of(data)
        m = words[begin].astype(np.int64)
        row = np.repeat(np.arange(len(m)), m)
        first = np.cumsum(m) - m
        index = words[np.arange(len(row)) - first[row] + begin[row] + 1]
        width = (index & np.uint64((1 << 32) - 1)).astype(np.int64)
        done = np.concatenate([[0], np.cumsum(width)])
        at = done[:-1] - done[first][row] + (begin + 1 + m)[row]
        return cls.at_places((index >> np.uint64(32)).astype(np.uint32).view(np.int32), words, at, label.astype(np.int64)[row])

    @classmethod
    def at_places(cls, token: np.ndarray, words: np.ndarray, at: np.ndarray, side: np.ndarray) -> Lines:
        low = np.uint64((1 << 32) - 1)
        third, fourth = words[at + 2], words[at + 3]
        split = lambda x: ((x >> np.uint64(32)).astype(np.int64), (x & low).astype(np.int64))
        (line, n), (late, pos) = split(third), split(fourth)
        return cls(words, token=token.astype(np.int64), sig=words[at], doc=words[at + 1].view(np.int64), line=line, n=n, pos=pos, late=late, side=side, at=at)

    def __len__(self) -> int:
        return len(self.at)

    def take(self, pick) -> Lines:
        return Lines(self.words, **{f: getattr(self, f)[pick] for f in self.FIELDS})

    @classmethod
    def joined(cls, some: list[Lines]) -> Lines:
        """Words that no entry uses any more go."""
        if len(some) == 1:
            return some[0]
        words, at, done = [], [], 0
        for x in some:
            width = sketch_words(x.n) + _HEAD
            step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            words.append(x.words[np.repeat(x.at, width) + step])
            at.append(np.cumsum(width) - width + done)
            done += int(width.sum())
        fields = {f: np.concatenate([getattr(x, f) for x in some]) for f in cls.FIELDS if f != "at"}
        return cls(np.concatenate(words), at=np.concatenate(at), **fields)

    def data(self) -> pa.Array:
        width = (sketch_words(self.n) + _HEAD) if len(self) else np.zeros(0, np.int64)
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        offsets = np.concatenate([[0], np.cumsum(width) * 8]).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.words[np.repeat(self.at, width) + step])])

    def folds(self) -> np.ndarray:
        """All words of a sketch combined: the sketch of 64 bits."""
        width = sketch_words(self.n)
        step = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
        return np.bitwise_xor.reduceat(self.words[np.repeat(self.at + _HEAD, width) + step], np.cumsum(width) - width) if len(self) else np.zeros(0, np.uint64)


def _collapsed(x: Lines) -> tuple[Lines, Lines]:
    """The first line of each set and token, and the others."""
    key = (x.token.astype(np.uint64) << np.uint64(32)) | (x.sig >> np.uint64(32))
    order = np.argsort(key)
    key = key[order]
    same = np.concatenate([key[1:] == key[:-1], [False]])
    several = np.flatnonzero(same | np.concatenate([[False], same[:-1]])) if len(key) else order
    if len(several):
        some = order[several]
        order[several] = some[np.lexsort((x.line[some], x.doc[some], x.sig[some], key[several]))]
    token, sig = x.token[order], x.sig[order]
    new = np.ones(len(order), bool)
    new[1:] = (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])
    return x.take(order[new]), x.take(order[~new])


def _apart(x: Lines, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of whole sketches, the wider one folded; n[i] <= n[j]."""
    w1, w2 = sketch_words(x.n[i]), sketch_words(x.n[j])
    far = np.zeros(len(i), np.int64)
    for a, b in {(int(a), int(b)) for a, b in zip(w1, w2, strict=True)} if len(i) else ():
        k = np.flatnonzero((w1 == a) & (w2 == b))
        one = x.words[(x.at[i[k]] + _HEAD)[:, None] + np.arange(a)]
        two = x.words[(x.at[j[k]] + _HEAD)[:, None] + np.arange(b)].reshape(len(k), b // a, a)
        far[k] = np.bitwise_count(one ^ np.bitwise_xor.reduce(two, 1)).sum(1, dtype=np.int64)
    return far


def _pairs(x: Lines, percent: int, cross: bool):
    """(late, early, differing bits) of entries of one token whose lines are candidates, blocks of at most PAIRS; cross: of different sides."""
    run = np.cumsum(np.concatenate([[0], x.token[1:] != x.token[:-1]])) if len(x) else x.token
    key = (run << 32) | x.n
    order = np.argsort(key, kind="stable")
    x, run, key = x.take(order), run[order], key[order]
    fold = x.folds()
    # partners of a line follow it, up to the largest size allowed
    stop = np.searchsorted(key, (run << 32) | (x.n * 100 // percent), "right")
    count = stop - np.arange(len(x)) - 1
    total = np.concatenate([[0], np.cumsum(count)])
    for p0 in range(0, int(total[-1]), PAIRS):
        p1 = min(p0 + PAIRS, int(total[-1]))
        a, b = np.searchsorted(total, (p0, p1 - 1), "right") - 1
        i = np.repeat(np.arange(a, b + 1), np.minimum(total[a + 1 : b + 2], p1) - np.maximum(total[a : b + 1], p0))
        j = i + 1 + np.arange(p0, p1) - total[i]
        both = x.n[i] + x.n[j]
        need = needed(both, 0, percent)
        ok = np.bitwise_count(fold[i] ^ fold[j]) <= both - 2 * need
        if cross:
            ok &= x.side[i] != x.side[j]
        i, j, both, need = i[ok], j[ok], both[ok], need[ok]
        one, two = x.pos[i], x.pos[j]
        ok = np.minimum(one, two) + np.minimum(x.n[i] - one, x.n[j] - two) >= need
        i, j, both, need = i[ok], j[ok], both[ok], need[ok]
        far = _apart(x, i, j)
        ok = far <= both - 2 * need
        i, j, far = i[ok], j[ok], far[ok]
        same = (x.doc[i] == x.doc[j]) & (x.line[i] == x.line[j])
        before = (x.doc[i] < x.doc[j]) | ((x.doc[i] == x.doc[j]) & (x.line[i] < x.line[j]))
        late, early = np.where(before, j, i)[~same], np.where(before, i, j)[~same]
        if len(late):
            yield order[late], order[early], far[~same]


_FOUND = "kind int, doc long, line int, doc2 long, line2 int, far int, token int, sig long, data binary"


def _rows(kind: int, x: Lines, late: np.ndarray, early: np.ndarray | None = None, far: np.ndarray | None = None, data: bool = False):
    for a in range(0, len(late), 50_000):
        one = x.take(late[a : a + 50_000])
        two = one if early is None else x.take(early[a : a + 50_000])
        z = np.zeros(len(one), np.int32) if far is None else far[a : a + 50_000].astype(np.int32)
        columns = [np.full(len(one), kind, np.int32), one.doc, one.line.astype(np.int32), two.doc, two.line.astype(np.int32), z, one.token.astype(np.int32), one.sig.view(np.int64)]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in columns], one.data() if data else pa.nulls(len(one), pa.binary())], [c.split()[0] for c in _FOUND.split(", ")])


def _sent(x: Lines, percent: int, best: int, cross: bool = False):
    """Rows of kind 1 and 2 for whole runs; best 0: all pairs whose later line is marked late."""
    late, early, far = (np.zeros(0, np.int64) for _ in range(3))
    more = np.zeros(len(x), bool)

    def nearest():
        order = np.lexsort((x.line[early], x.doc[early], far, late))
        at = late[order]
        nth = np.arange(len(at)) - np.searchsorted(at, at)
        more[at[nth >= best]] = True
        return order[nth < best]

    for a, b, d in _pairs(x, percent, cross):
        if not best:
            on = x.late[a] == 1
            yield from _rows(1, x, a[on], b[on], d[on])
            continue
        late, early, far = np.concatenate([late, a]), np.concatenate([early, b]), np.concatenate([far, d])
        if len(late) > PAIRS:
            k = nearest()
            late, early, far = late[k], early[k], far[k]
    if len(late):
        k = nearest()
        yield from _rows(1, x, late[k], early[k], far[k])
        yield from _rows(2, x, np.flatnonzero(more))


def candidates(sorted_entries: DataFrame, percent: int, best: int) -> DataFrame:
    """Packed entries sorted by label -> kind 0: (doc, line) equals an earlier line; 1: compare with (doc2, line2), far bits of their
    sketches differ; 2: more than `best` candidates under token; 3: an entry of a run of over RUN lines, not paired here."""

    def pieces(batches):
        for batch in batches:
            size = np.diff(np.frombuffer(batch.column("data").buffers()[1], np.int32)[batch.column("data").offset :][: batch.num_rows + 1]) if batch.num_rows else []
            part = np.cumsum(size) // (1 << 21)
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a < b:
                    yield Lines.unpacked(batch.column("label").to_numpy()[a:b], batch.column("data").slice(a, b - a))

    def made(batches):
        held, size, most = [], 0, HELD
        over, label = np.zeros(0, np.int64), None  # over: tokens of the label whose runs go out as kind 3
        for x in pieces(batches):
            if len(over):
                on = (x.side == label) & np.isin(x.token, over)
                first, again = _collapsed(x.take(on))
                yield from _rows(0, again, np.flatnonzero(again.pos == 0))
                yield from _rows(3, first, np.arange(len(first)), data=True)
                x = x.take(~on)
            if not len(x):
                continue
            held.append(x)
            size += len(x)
            if size < most:
                continue
            now = int(x.side[-1])
            x, again = _collapsed(Lines.joined(held))
            yield from _rows(0, again, np.flatnonzero(again.pos == 0))
            done = x.side != now
            yield from whole(x.take(done))
            x = x.take(~done)
            if now != label:
                over, label = np.zeros(0, np.int64), now
            long = _long(x)
            if long.any():
                yield from _rows(3, x, np.flatnonzero(long), data=True)
                over = np.concatenate([over, np.unique(x.token[long])])
                x = x.take(~long)
            held, size = [Lines.joined([x, x.take(slice(0, 0))])] if len(x) else [], len(x)
            # a label of many tokens isn't sorted again for each piece
            most = max(HELD, 2 * size)
        if held:
            x, again = _collapsed(Lines.joined(held))
            yield from _rows(0, again, np.flatnonzero(again.pos == 0))
            yield from whole(x)

    def _long(x: Lines) -> np.ndarray:
        """Which entries, in order of token, are of runs of over RUN."""
        cut = np.concatenate([[0], np.flatnonzero(x.token[1:] != x.token[:-1]) + 1, [len(x)]])
        return np.repeat(np.diff(cut) > RUN, np.diff(cut))

    def whole(x: Lines):
        """All of some runs."""
        long = _long(x)
        if long.any():
            yield from _rows(3, x, np.flatnonzero(long), data=True)
            x = x.take(~long)
        yield from _sent(x, percent, best)

    return sorted_entries.mapInArrow(made, _FOUND)


def squares(long: DataFrame, percent: int, best: int) -> DataFrame:
    """Rows of kind 3 -> what candidates() finds, from squares of two blocks of each run, dealt to all tasks."""
    first = F.min(F.struct("doc", "line", "data")).alias("first")
    lines = long.groupBy("token", "sig").agg(first).select("token", "sig", "first.doc", "first.line", "first.data")
    # blocks grow with the root of the run, so that what is sent grows less than its square
    blocks = F.ceil(F.count("*") / F.greatest(F.lit(RUN / 2), SPREAD * F.sqrt(F.count("*")))).cast("int").alias("blocks")
    lines = lines.join(lines.groupBy(F.col("token").alias("token_")).agg(blocks), F.col("token") == F.col("token_"))
    lines = lines.withColumn("own", F.expr("cast(pmod(xxhash64(sig), blocks) as int)"))
    lines = lines.select("token", "data", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    lines = lines.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "data")

    def made(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, x, y, side = (batch.column(c).to_numpy() for c in ("token", "x", "y", "side"))
            new = np.flatnonzero((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (token[a], x[a], y[a])
                if key != last and held:
                    yield from _sent(Lines.joined(held), percent, best, last[1] != last[2])
                    held = []
                last = key
                held.append(Lines.of(token[a:b], batch.column("data").slice(a, b - a), side[a:b].astype(np.int64)))
        if held:
            yield from _sent(Lines.joined(held), percent, best, last[1] != last[2])

    keys = ("token", "x", "y")
    return lines.repartition(parts(long.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(made, _FOUND)


def line_id(doc: str, line: str):
    """A long that stands for a line in a bitmap; unlike lines may share one."""
    return F.expr(f"pmod({doc}, {1 << 40}L) * 1000003L + {line}").alias("id")


def line_sets(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(d, l, set) of the named (doc, line); lines are made into sets where documents are read, those a bitmap rules out aren't."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(lines.select(line_id("doc", "line"))))

    def sets(batches):
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 19):
                data, bounds = text_bytes(chunk.column("text"))
                start, of, number = line_bounds(data, bounds)
                ids = chunk.column("doc_id").take(pa.array(of))
                keep = np.flatnonzero(_in(bits.value, _line_ids(ids.to_numpy(), number)))
                if not len(keep):
                    continue
                # only the lines that are wanted are hashed
                stop = np.append(start[1:], len(data))[keep]
                size = stop - start[keep]
                edges = np.concatenate([[0], np.cumsum(size)])
                own = data[np.repeat(start[keep] - edges[:-1], size) + np.arange(edges[-1])]
                h, _, line = word_hashes(own, edges)
                x = _sorted_sets(line, h)
                cut = np.searchsorted(x[0], np.arange(len(keep) + 1).astype(np.uint64))
                buffers = [None, pa.py_buffer((cut * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x[1]))]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(number[keep].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(keep), buffers)], ["doc", "line", "set"])

    made = with_ids(docs, "doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(sets, "doc long, line int, set binary")
    return made.join(lines, ["doc", "line"], "left_semi").select(F.col("doc").alias("d"), F.col("line").alias("l"), "set")


def _sorted_sets(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Lines and their distinct hashes, in order."""
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return np.stack([line[new].astype(np.uint64), h[new]])


def similar_lines(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (doc, line, doc2, line2) the (doc, line) whose whole sets are similar enough."""

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s1"), batch.column("s2"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                i = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("line")], ["doc", "line"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("d").alias("doc"), F.col("l").alias("line"), F.col("set").alias("s1"))
    two = sets.select(F.col("d").alias("doc2"), F.col("l").alias("line2"), F.col("set").alias("s2"))
    return pairs.join(one, ["doc", "line"]).join(two, ["doc2", "line2"]).select("doc", "line", "s1", "s2").mapInArrow(similar, "doc long, line int").distinct()


def verified(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of stored pairs (doc, line, doc2, line2, far) the (doc, line) whose whole sets are similar enough. Each line's nearest pair is
    tried first, the others only where that one fails."""
    if pairs.isEmpty():
        return pairs.select("doc", "line")
    lines = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("line2").alias("line"))).distinct()
    sets = stored(line_sets(docs, stored(lines)))
    best = pairs.groupBy("doc", "line").agg(F.min(F.struct("far", "doc2", "line2")).alias("b")).select("doc", "line", "b.doc2", "b.line2")
    gone = stored(similar_lines(best, sets, percent))
    rest = stored(pairs.join(gone, ["doc", "line"], "left_anti").select("doc", "line", "doc2", "line2").join(best, ["doc", "line", "doc2", "line2"], "left_anti"))
    return gone if rest.isEmpty() else gone.unionByName(similar_lines(rest, sets, percent))


def _found(docs: DataFrame, percent: int, best: int, rarity, wanted=None) -> DataFrame:
    spark = docs.sparkSession
    # a line has many entries: their tasks are half as large as others
    tasks = 2 * parts(spark)
    dealt = entries(docs, percent, rarity, labels_for(tasks, LABELS), wanted).repartition(tasks, "label").sortWithinPartitions("label")
    found = stored(candidates(dealt, percent, best))
    with batches_of(spark, 20_000):
        long = found.where("kind = 3")
        if long.isEmpty():
            return found
        met = stored(squares(long.select("token", "sig", "doc", "line", "data"), percent, best))
    # of equal sets in a long run all but the first go
    firsts = long.groupBy(F.col("token").alias("t"), F.col("sig").alias("s")).agg(F.min(F.struct("doc", "line")).alias("first"))
    same = long.join(firsts, (F.col("token") == F.col("t")) & (F.col("sig") == F.col("s"))).where(F.struct("doc", "line") != F.col("first"))
    same = same.select(F.lit(0).alias("kind"), *[c for c in found.columns if c != "kind"])
    return found.where("kind < 3").unionByName(met).unionByName(same)


def removed_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, lines): numbers of the lines to remove, from 0, per document that loses any."""
    spark = docs.sparkSession
    small_batches(spark)
    rarity = rarity_levels(docs)
    found = _found(docs, percent, BEST, rarity)

    def pairs(found: DataFrame) -> DataFrame:
        return stored(found.where("kind = 1").groupBy("doc", "line", "doc2", "line2").agg(F.min("far").alias("far")))

    gone = found.where("kind = 0").select("doc", "line").unionByName(verified(docs, pairs(found), percent)).distinct()
    over = found.where("kind = 2").select("doc", "line", "token")
    if not over.isEmpty():
        gone = stored(gone)
        over = stored(over.join(gone, ["doc", "line"], "left_anti"))
        if not over.isEmpty():
            wanted = id_filter(over.select(F.col("token").cast("long").alias("id"))), id_filter(over.select(line_id("doc", "line")))
            wide = _found(docs, percent, 0, rarity, spark.sparkContext.broadcast(wanted))
            gone = gone.unionByName(verified(docs, pairs(wide), percent)).distinct()
    return gone.groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("line")).alias("lines"))


def without(text, lines):
    """Column of a text without the lines of these numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")


def deduplicated(docs: DataFrame, percent: int = PERCENT, keep_empty: bool = True) -> DataFrame:
    """documents with the later of similar lines removed from text; n_chars follows. Texts that lose all lines go unless keep_empty."""
    gone = removed_lines(docs, percent).select(F.col("doc_id").alias("doc_id_"), F.col("lines").alias("lines_"))
    text = F.when(F.col("lines_").isNull(), F.col("text")).otherwise(without(F.col("text"), F.col("lines_")))
    met = docs.join(gone, F.col("doc_id") == F.col("doc_id_"), "left").withColumn("text", text)
    if not keep_empty:
        met = met.where(F.col("lines_").isNull() | F.rlike(F.col("text"), F.lit("[^\\x20\\x09-\\x0D]")))
    if "n_chars" in docs.columns:
        met = met.withColumn("n_chars", F.when(F.col("lines_").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return met.select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers from 0), a row per document."""
    docs = table(spark, sf_dir, "documents")
    gone = removed_lines(docs).select(F.col("doc_id").alias("doc_id_"), "lines")
    n_lines = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) == 0, F.lit(0)).otherwise(F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1)
    counted = docs.select("doc_id", n_lines.cast("long").alias("n_lines"))
    return counted.join(gone, F.col("doc_id") == F.col("doc_id_"), "left").select("doc_id", "n_lines", F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_removed"), F.coalesce("lines", F.array().cast("array<int>")).alias("removed"))
