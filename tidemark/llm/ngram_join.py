"""N-gram Jaccard join of documents by a grouped prefix join, and the components of its links.

A document's set holds its distinct n-word shingles. Equal sets are one class from the start. Classes of equal size and equal
prefix are one group, and only groups meet: by a shared prefix shingle (prefixes under the global rarity order of words.py),
then by length and position filters. Prefixes are longer than one common shingle needs, by a share of the set's size, and a pair
must then share as many shingles more: long texts with one passage in common don't meet, and a group whose prefix shares fewer
shingles with all others together has no link and goes at once. A parity sketch of one to two bits a shingle, whose differing bits
never outnumber the differing shingles, rules most pairs out; whole sets of the others are compared.

What is asked for is each document's component, so links inside a component need not all be found. The first pass tries each
group against one or two hubs of each shingle it shares: linear in the entries. What then is left are pairs of classes in different
components. A shingle of up to SMALL classes pairs them as they are. The classes of all larger ones are gathered by hub, once for
all shingles of that hub, as families; a family is dealt out in squares of at most two blocks, and within a square sketches are
compared by numpy, so a pair that they rule out is no row of any join. The first rounds send, for each class and component, the
nearest pairs only; components merge; the last round sends every pair that still crosses. Only squares that held pairs back go
through another round. After it no link is missing.

Edge cases: null or empty texts, or texts of white space, have size 0 and are linked with nothing; null ids keep a row with a
null component and link nothing; repeated rows are of one class; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, in_chunks, parts, small_batches, stored, table, text_bytes, with_ids
from .components import components
from .words import SKETCH_BITS, bucket, frequency_sketch, id_filter, mixed, passes_filter, shingle_hashes, word_hashes


#: A set of n shingles shares 1 + n // COMMON prefix shingles with any similar set as large or larger.
COMMON = 20
#: A shingle of more classes than this is left to families.
SMALL = 16
#: Classes of a family's block: at least, at most, and for each root of the family's.
BLOCK = (256, 8192, 8)
#: Words of the widest sketch, 64 bits each.
WIDEST = 512
#: Pairs sent for each class and component, round by round; 0: all that are left.
ROUNDS = (2, 16, 0)
#: Sketch words that are compared at a time, and pairs that are held before they go out or are thinned.
CELLS, HELD = 1 << 18, 1 << 17


def _shingles(size: int):
    def hashes(data, bounds):
        h, _, of = word_hashes(data, bounds)
        return shingle_hashes(h, of, len(bounds) - 1, size)

    return hashes


def overlap_needed(n1, n2, percent: int):
    """Least intersection size for 100 * i >= percent * (n1 + n2 - i), in whole numbers."""
    return -((-percent * (n1 + n2)) // (100 + percent))


def common_needed(n):
    """Least number of shared shingles among the prefixes of a similar pair whose smaller set has n."""
    return 1 + n // COMMON


def prefix_length(n, percent: int):
    return min(n, n - (-(-percent * n // 100)) + common_needed(n))


def sketch_bits(n: int) -> int:
    """A power of two, at least n but for very large sets."""
    return min(64 * WIDEST, 1 << max(6, (n - 1).bit_length()))


def features(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n, cls, sketch, prefix): set size, 64-bit digest and parity sketch of the set, prefix shingles (32 bits) in rarity order."""

    def both(data, bounds):
        """Hashes of words, then of shingles: each in its half of the sketch."""
        w, _, of = word_hashes(data, bounds)
        h, _ = shingle_hashes(w, of, len(bounds) - 1, size)
        return np.concatenate([w >> np.uint64(1), (h >> np.uint64(1)) | np.uint64(1 << 63)])

    words, shingles = frequency_sketch(docs.sparkSession, docs, both, SKETCH_BITS + 1).reshape(2, -1)
    # a shingle is hot by the doublings of its bucket's count over the mean; passages that many texts share stand out
    hot = np.log2(np.maximum(1, shingles / max(shingles.mean(), 1))).astype(np.int64)
    rarity = docs.sparkSession.sparkContext.broadcast((np.log2(words + 1.0).astype(np.float32), hot.astype(np.uint8)))

    def made(batches):
        for batch in batches:
            for chunk in in_chunks(batch, "text"):
                data, texts = text_bytes(chunk.column("text"))
                w, _, of = word_hashes(data, texts)
                h, bounds = shingle_hashes(w, of, len(texts) - 1, size)
                level, hot = rarity.value
                common = _commonness(level[bucket(w)], of, len(texts) - 1, size) + (hot[bucket(h)].astype(np.int64) << 32)
                n, cls, prefix, sketch = [], [], [], []
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    s, at = np.unique(h[a:b], return_index=True)
                    n.append(len(s))
                    cls.append(_class_of(s))
                    p = s[np.argsort(common[a:b][at], kind="stable")[: prefix_length(len(s), percent)]] if len(s) else s
                    prefix.append((p >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    bits = sketch_bits(len(s))
                    sketch.append(np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).tobytes())
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(prefix, pa.list_(pa.int32()))], ["doc_id", "n", "cls", "sketch", "prefix"])

    return with_ids(docs, "doc_id", "text").mapInArrow(made, "doc_id long, n long, cls long, sketch binary, prefix array<int>")


def _commonness(level: np.ndarray, of: np.ndarray, n_texts: int, size: int) -> np.ndarray:
    """Of each shingle, in whole steps, the sum of its words' log counts: a function of the shingle alone, and so part of a total
    order; among shingles that aren't hot those of rare words come first, and nearly all of those are rare, however large the corpus."""
    counts = np.bincount(of, minlength=n_texts) if len(of) else np.zeros(n_texts, np.int64)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    begin = np.repeat(np.cumsum(counts) - counts, made) + (np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made))
    steps = np.concatenate([[0], np.cumsum((level * 16).astype(np.int64))])
    return steps[begin + np.repeat(np.minimum(counts, size), made)] - steps[begin]


def _class_of(s: np.ndarray) -> int:
    return int(mixed(np.array([np.add.reduce(mixed(s + np.uint64(1)), dtype=np.uint64) + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _runs(key: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])


def _columns(batch, names):
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def shared_entries(entries: DataFrame) -> DataFrame:
    """Entries (token, gid, n, pos, m), sorted by token within partitions -> those whose token has another entry. Streams."""
    names = ("token", "gid", "n", "pos", "m")

    def made(batches):
        held = None  # the last entry seen, and whether the one before it has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(names)
            token = batch.column("token").to_numpy()
            same = token[1:] == token[:-1]
            before = bool(held is not None and held[0].column("token")[0].as_py() == token[0])
            if held is not None and (held[1] or before):
                yield held[0]
            multi = np.zeros(len(token), bool)
            multi[1:] |= same
            multi[:-1] |= same
            multi[0] |= before
            last = bool(multi[-1])
            multi[-1] = False  # goes out with the next batch, or at the end
            yield batch.filter(pa.array(multi))
            held = (batch.slice(len(token) - 1, 1), last)
        if held is not None and held[1]:
            yield held[0]

    return entries.mapInArrow(made, "token int, gid long, n int, pos int, m int")


def within_reach(shared: DataFrame, percent: int) -> DataFrame:
    """Shared entries of the groups that share as many as a similar pair must, with that number. A group's smallest similar set has
    `percent` of its size, and each shingle that the two share is shared by the group."""
    least = F.expr(f"1 + ((cast(n as bigint) * {percent} + 99) div 100) div {COMMON}")
    return shared.withColumn("shares", F.count("*").over(Window.partitionBy("gid")).cast("int")).where(F.col("shares") >= least)


def with_hubs(shared: DataFrame) -> DataFrame:
    """Each entry with its token's hub, lowest group and number of classes; entries whose token has no other group go. The hub is the
    group that shares the most of its prefix, so that near copies of one text meet in one hub under nearly all their tokens."""
    # the greatest ~gid is the least gid; where one entry is both, its bytes repeat and compress
    one = (F.bitwise_not("gid").alias("inv"), "n", "pos")
    hubs = shared.groupBy(F.col("token").alias("token_")).agg(
        F.max(F.struct((F.col("shares") / F.col("n")).cast("float").alias("central"), *one)).alias("hub"), F.max(F.struct(*one)).alias("low"), F.sum("m").alias("total"), F.count("*").alias("rows")
    )
    named = [F.struct(F.bitwise_not(f"{x}.inv").alias("gid"), f"{x}.n", f"{x}.pos").alias(x) for x in ("hub", "low")]
    return shared.join(hubs.where("rows > 1").select("token_", *named, "total"), F.col("token") == F.col("token_")).drop("token_", "shares")


def hub_pairs(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of groups of which one is the other's hub, or lowest group, under some token, and the filters allow."""

    def fits(x: str):
        n, pos = F.col(f"{x}.n"), F.col(f"{x}.pos")
        need = F.ceil(F.lit(percent) * (F.col("n") + n) / F.lit(100 + percent) - 1e-9)
        size = F.least(F.col("n"), n) * 100 >= percent * F.greatest(F.col("n"), n)
        return (F.col("gid") != F.col(f"{x}.gid")) & size & (F.least(F.col("pos"), pos) + F.least(F.col("n") - F.col("pos"), n - pos) >= need)

    mates = F.array_distinct(F.array_compact(F.array(F.when(fits("hub"), F.col("hub.gid")), F.when(fits("low"), F.col("low.gid")))))
    met = met.select("gid", mates.alias("mates")).distinct().select("gid", F.explode("mates").alias("mate"))
    return met.select(F.least("gid", "mate").alias("a"), F.greatest("gid", "mate").alias("b")).distinct()


def small_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Rows (token, cls, comp, n, pos), a run's at most SMALL rows together -> pairs (a, b) of classes in different components that pass
    the filters under as many tokens as they must share."""
    names = ("token", "cls", "comp", "n", "pos")

    def pairs(x):
        token, cls, comp, n, pos = x
        for k in range(1, SMALL):
            at = np.flatnonzero(token[k:] == token[:-k]) if len(token) > k else np.zeros(0, np.int64)
            if not len(at):
                return
            at = at[comp[at] != comp[at + k]]
            n1, n2, p1, p2 = n[at], n[at + k], pos[at], pos[at + k]
            low = np.minimum(n1, n2)
            keep = (low * 100 >= percent * np.maximum(n1, n2)) & (np.minimum(p1, p2) + np.minimum(n1 - p1, n2 - p2) >= overlap_needed(n1, n2, percent))
            a, b = cls[at[keep]], cls[at[keep] + k]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.minimum(a, b), np.maximum(a, b), common_needed(low[keep]))], ["a", "b", "runs"])

    def made(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _columns(batch, names)
            x = x if held is None else [np.concatenate(p) for p in zip(held, x, strict=True)]
            cut = int(np.searchsorted(x[0], x[0][-1]))
            yield from pairs([c[:cut] for c in x])
            held = [c[cut:] for c in x]
        if held is not None:
            yield from pairs(held)

    found = rows.mapInArrow(made, "a long, b long, runs long").groupBy("a", "b").agg(F.count("*").alias("met"), F.max("runs").alias("runs"))
    return found.where("met >= runs").select("a", "b")


class Side:
    """Classes of a square by size, their sketches in a matrix for each width."""

    def __init__(self, cls, comp, n, sketch):
        order = np.lexsort((cls, n))
        self.cls, self.comp, self.n = cls[order], comp[order], n[order]
        sketch = [sketch[k] for k in order]
        width = np.array([len(x) for x in sketch], np.int64) // 8
        cut = _runs(width) if len(width) else [0]
        self.blocks = [(int(a), np.frombuffer(b"".join(sketch[a:b]), np.uint64).reshape(b - a, -1)) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def near_pairs(left: Side, right: Side, percent: int, same: bool, strict: bool):
    """(i, j, differing bits) of pairs, left one no larger (strict: smaller), in different components that size and sketch allow; same:
    both sides are one, and each pair is met once."""
    for a0, x in left.blocks:
        step = max(1, min(64, CELLS // (16 * x.shape[1])))
        for a in range(0, len(x), step):
            i = np.arange(a0 + a, a0 + min(a + step, len(x)))
            lo = int(np.searchsorted(right.n, left.n[i[0]], "right" if strict else "left"))
            hi = int(np.searchsorted(right.n, left.n[i[-1]] * 100 // percent, "right"))
            lo = max(lo, int(i[0]) + 1) if same else lo
            for b0, y in right.blocks:
                wide = max(1, CELLS // (len(i) * x.shape[1]))
                for b in range(max(lo, b0), min(hi, b0 + len(y)), wide):
                    j = np.arange(b, min(b + wide, hi, b0 + len(y)))
                    n1, n2 = left.n[i][:, None], right.n[j][None, :]
                    ok = (left.comp[i][:, None] != right.comp[j][None, :]) & (n1 * 100 >= percent * n2) & ((i[:, None] < j[None, :]) if same else (n1 < n2) | (not strict and n1 == n2))
                    if not ok.any():
                        continue
                    k1, k2 = _folded(x[i - a0], y.shape[1]), _folded(y[j - b0], x.shape[1])
                    far = np.bitwise_count(k1[:, None, :] ^ k2[None, :, :]).sum(2, dtype=np.int64)
                    p, q = np.nonzero(ok & (far <= n1 + n2 - 2 * overlap_needed(n1, n2, percent)))
                    if len(p):
                        yield i[p], j[q], far[p, q]


def _nearest(a: np.ndarray, b: np.ndarray, far: np.ndarray, best: int) -> np.ndarray:
    """Which pairs are among the `best` nearest of either of their ends."""
    out = np.zeros(len(a), bool)
    for end in (a, b):
        order = np.lexsort((far, end))
        e = end[order]
        out[order] |= np.arange(len(e)) - np.searchsorted(e, e) < best
    return out


def square_pairs(rows: DataFrame, percent: int, best: int) -> DataFrame:
    """Rows (hub, x, y, side, cls, comp, n, sketch), a square's together -> (hub, x, y, a, b, cut): pairs of classes in different components
    that size and sketch allow, of each class the `best` nearest (0: all); cut: the square had more."""

    def square(key, held):
        cls, comp, n, side = (np.concatenate([h[k] for h in held]) for k in range(4))
        sketch = [s for h in held for s in h[4]]
        if (comp == comp[0]).all():
            return
        if held[0][5]:
            one = Side(cls, comp, n, sketch)
            turns = [(one, one, True, False)]
        else:
            first = side == 0
            one, two = (Side(cls[w], comp[w], n[w], [sketch[k] for k in np.flatnonzero(w)]) for w in (first, ~first))
            turns = [(one, two, False, False), (two, one, False, True)]
        a, b, far, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), False

        def out(a, b, cut):
            for k in range(0, len(a), 50_000):
                s = slice(k, k + 50_000)
                place = [pa.array(np.full(len(a[s]), v)) for v in key]
                yield pa.RecordBatch.from_arrays([*place, pa.array(np.minimum(a[s], b[s])), pa.array(np.maximum(a[s], b[s])), pa.array(np.full(len(a[s]), cut))], ["hub", "x", "y", "a", "b", "cut"])

        for left, right, same, strict in turns:
            for i, j, d in near_pairs(left, right, percent, same, strict):
                a, b, far = np.concatenate([a, left.cls[i]]), np.concatenate([b, right.cls[j]]), np.concatenate([far, d])
                if len(a) > HELD:
                    if best:
                        keep = _nearest(a, b, far, best)
                        cut |= not keep.all()
                        a, b, far = a[keep], b[keep], far[keep]
                    if not best or len(a) > HELD // 2:
                        yield from out(a, b, cut)
                        a, b, far = a[:0], b[:0], far[:0]
        if best and len(a):
            keep = _nearest(a, b, far, best)
            cut |= not keep.all()
            a, b = a[keep], b[keep]
        yield from out(a, b, cut)

    def made(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            hub, x, y = (batch.column(c).to_numpy() for c in ("hub", "x", "y"))
            new = np.flatnonzero((hub[1:] != hub[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            edges = [0, *new.tolist(), batch.num_rows]
            cls, comp, n, side = (batch.column(c).to_numpy().astype(np.int64) for c in ("cls", "comp", "n", "side"))
            sketch = batch.column("sketch").to_pylist()
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key = (hub[a], x[a], y[a])
                if key != last and held:
                    yield from square(last, held)
                    held = []
                last = key
                held.append((cls[a:b], comp[a:b], n[a:b], side[a:b], sketch[a:b], x[a] == y[a]))
        if held:
            yield from square(last, held)

    return rows.mapInArrow(made, "hub long, x int, y int, a long, b long, cut boolean")


def crossing(kin: DataFrame, placed: DataFrame, reps: DataFrame, percent: int, best: int, only: DataFrame | None = None) -> DataFrame:
    """Families kin(gid, hub), classes' components placed(cls, gid, n, comp) -> pairs (hub, x, y, a, b, cut) to try, from families of more
    than one component; only: from the squares (hub, x, y) that it names. Blocks grow with the root of the family, so rows that are sent
    grow less than its square. A class's square is a function of the family's size and its own digest, and so the same in all rounds."""
    spark = kin.sparkSession
    family = kin.join(placed.select("gid", "cls", "comp", "n"), "gid").select("hub", "cls", "comp", "n")
    block = F.greatest(F.lit(float(BLOCK[0])), F.least(F.lit(float(BLOCK[1])), BLOCK[2] * F.sqrt("size")))
    large = family.groupBy(F.col("hub").alias("hub_")).agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    large = large.where("lo <> hi").select("hub_", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = family.join(large, F.col("hub") == F.col("hub_")).withColumn("own", F.expr("cast(pmod(xxhash64(cls), blocks) as int)"))
    rows = rows.select("hub", "cls", "comp", "n", "own", F.explode(F.expr("sequence(0, blocks - 1)")).alias("other"))
    rows = rows.select("hub", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side"), "cls", "comp", "n")
    if only is not None:
        rows = rows.join(only, ["hub", "x", "y"], "left_semi")
    rows = rows.join(reps.select(F.col("cls").alias("cls_"), "sketch"), F.col("cls") == F.col("cls_")).drop("cls_")
    rows = rows.repartition(parts(spark), "hub", "x", "y").sortWithinPartitions("hub", "x", "y")
    return square_pairs(rows, percent, best)


def _folded(x: np.ndarray, width: int) -> np.ndarray:
    """Sketches of at most `width` words: a sketch's halves, combined, are the sketch of half as many bits."""
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Of pairs(a, b) of classes those whose sketches don't rule them out."""

    def near(batches):
        for batch in batches:
            n1, n2 = (batch.column(c).to_numpy() for c in ("n1", "n2"))
            k1, k2 = (np.array(batch.column(c).to_pylist(), object) for c in ("k1", "k2"))
            wide = np.array([(len(x), len(y)) for x, y in zip(k1, k2, strict=True)], np.int64).reshape(-1, 2)
            far = np.zeros(len(n1), np.int64)
            for w1, w2 in np.unique(wide, axis=0):
                at = np.flatnonzero((wide == (w1, w2)).all(1))
                x, y = (np.frombuffer(b"".join(k[at]), np.uint64).reshape(len(at), -1) for k in (k1, k2))
                far[at] = np.bitwise_count(_folded(x, y.shape[1]) ^ _folded(y, x.shape[1])).sum(1, dtype=np.int64)
            most = n1 + n2 - 2 * overlap_needed(n1, n2, percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(far <= most))

    one = reps.select(F.col("cls").alias("a"), F.col("n").alias("n1"), F.col("sketch").alias("k1"))
    two = reps.select(F.col("cls").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("k2"))
    return pairs.where("a <> b").join(one, "a").join(two, "b").select("a", "b", "n1", "n2", "k1", "k2").mapInArrow(near, "a long, b long")


def verified(docs: DataFrame, members: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Of stored pairs(a, b) of classes those whose whole sets are similar enough. members(cls, rep) names a document of each class.

    Sets are made where documents are read; a bitmap of the wanted ids keeps most of the others from being made and sent.
    """
    hashes = _shingles(size)
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = members.join(wanted, "cls", "left_semi").select("rep")
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def sets(batches):
        for batch in batches:
            batch = batch.filter(pa.array(passes_filter(bits.value, batch.column("doc_id"))))
            for chunk in in_chunks(batch, "text"):
                h, bounds = hashes(*text_bytes(chunk.column("text")))
                own = [np.unique(h[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in own], pa.int64()), chunk.column("doc_id"), pa.array([s.tobytes() for s in own], pa.binary())], ["cls", "id", "set"])

    made = with_ids(docs, "doc_id", "text").mapInArrow(sets, "cls long, id long, set binary")
    found = stored(made.join(wanted.select(F.col("rep").alias("id")), "id", "left_semi").select("cls", "set"))

    def similar(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s1"), batch.column("s2"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                i = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(found.select(F.col("cls").alias("a"), F.col("set").alias("s1")), "a").join(found.select(F.col("cls").alias("b"), F.col("set").alias("s2")), "b")
    return met.select("a", "b", "s1", "s2").mapInArrow(similar, "a long, b long")


def joined(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents -> (doc_id, n_shingles, component_id), a row each; component_id is the smallest doc_id reachable by links."""
    spark = docs.sparkSession
    small_batches(spark)
    f = stored(features(docs, size, percent))
    live = f.where("n > 0 and doc_id is not null")
    one = F.first(F.struct("n", F.xxhash64("n", "prefix").alias("key"), "sketch", "prefix")).alias("x")
    reps = stored(live.groupBy("cls").agg(F.min("doc_id").alias("rep"), one).select("cls", "rep", "x.*"))
    # groups: equal size, equal prefix; named by their least class, whose prefix is theirs. Those of one class are many and not sent.
    several = stored(reps.groupBy("key").agg(F.min("cls").alias("gid"), F.count("*").cast("int").alias("m")).where("m > 1"))

    def grouped(*columns):
        own = [F.coalesce("gid", "cls").alias("gid"), F.coalesce("m", F.lit(1)).alias("m")]
        return reps.select("key", "cls", *columns).join(several, "key", "left").select("cls", *own, *columns)

    members = stored(grouped("rep", "n"))
    entries = grouped("n", "prefix").where("cls = gid").select("gid", "n", "m", F.posexplode("prefix").alias("pos", "token"))
    entries = entries.select("token", "gid", F.col("n").cast("int").alias("n"), "pos", "m").repartition(parts(spark), "token").sortWithinPartitions("token")
    with batches_of(spark, 20_000):
        shared = stored(within_reach(shared_entries(entries), percent))
    met = stored(with_hubs(shared))
    inside = members.where("cls <> gid").select(F.least("cls", "gid").alias("a"), F.greatest("cls", "gid").alias("b"))
    first = plausible(hub_pairs(met, percent).unionByName(inside), reps, percent)
    links = verified(docs, members, stored(first), size, percent)
    comp = components(links).select(F.col("node").alias("cls_"), "component")
    placed = members.select("cls", "gid", "n").join(comp, F.col("cls") == F.col("cls_"), "left")
    placed = stored(placed.select("cls", "gid", "n", F.coalesce("component", "cls").alias("comp")))
    kin = met.where(F.col("total") > SMALL).select("gid", F.col("hub.gid").alias("hub"))
    kin = stored(kin.unionByName(members.where("m > 1").select("gid", F.col("gid").alias("hub"))).distinct())
    only = None
    for turn, best in enumerate(ROUNDS):
        with batches_of(spark, 2_000):
            sent = stored(crossing(kin, placed, reps, percent, best, only))
        pairs = sent.select("a", "b")
        if not turn:
            small = met.where(F.col("total") <= SMALL).select("token", "gid", "pos").join(placed, "gid").select("token", "cls", "comp", F.col("n").cast("int").alias("n"), "pos")
            with batches_of(spark, 20_000):
                small = stored(small_pairs(small.repartition(parts(spark), "token").sortWithinPartitions("token"), percent))
            pairs = pairs.unionByName(plausible(small, reps, percent))
        pairs = stored(pairs.distinct())
        if not pairs.isEmpty():
            more = verified(docs, members, pairs, size, percent)
            at = placed.select(F.col("cls").alias("cls_"), "comp")
            bridge = more.join(at, F.col("a") == F.col("cls_")).select("b", F.col("comp").alias("ca")).join(at, F.col("b") == F.col("cls_")).select(F.col("ca").alias("a"), F.col("comp").alias("b"))
            over = components(bridge).select(F.col("node").alias("comp_"), F.col("component").alias("top"))
            placed = stored(placed.join(over, F.col("comp") == F.col("comp_"), "left").select("cls", "gid", "n", F.coalesce("top", "comp").alias("comp")))
        only = sent.where("cut").select("hub", "x", "y").distinct()
        if only.isEmpty():
            break
    final = members.select("cls", "rep").join(placed.select(F.col("cls").alias("cls_"), "comp"), F.col("cls") == F.col("cls_")).select("cls", "rep", "comp")
    least = final.groupBy(F.col("comp").alias("comp_")).agg(F.min("rep").alias("component_id"))
    named = final.join(least, F.col("comp") == F.col("comp_")).select(F.col("cls").alias("cls_"), "component_id")
    found = f.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(named, F.when(F.col("n_shingles") > 0, F.col("cls")) == F.col("cls_"), "left")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """documents, of each component only the rows of its smallest doc_id."""
    found = joined(docs, size, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(found, F.col("doc_id") == F.col("gone_"), "left_anti")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"), 4, 85)
