"""Quality rules: fixed document counts, and a linear-chain CRF that labels each line content or boilerplate.

The CRF is trained on labelled_table(), documents of labelled lines made from a fixed seed: running prose against symbol noise,
shouting, cell rows, looped words, menus and licence lines. Features are binned line statistics and those of both neighbours.
Lines are decoded by Viterbi over whole documents; a document is kept if content lines hold at least SHARE of its word characters
and the fixed rules don't reject it.

Edge cases: null and empty texts have no words and fail the fixed rules; texts of one very long line are one step; repeated rows
are judged each; null ids stay; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, small_batches, table, text_bytes, with_ids
from .crf import Crf
from .line_dedup import line_bounds
from .words import _BYTE_LOWER, mixed, prefix_sums, span_hashes, word_spans

SHARE = 0.7
MIN_WORDS = 50
MAX_REPEATED = 50
LABELS = ("content", "boilerplate")
BINS = 12
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _BANG, _PIPE, _STOP = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_BANG[ord("!")] = True
_PIPE[ord("|")] = True
_STOP[list(b".!?:;")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80
#: Words of notices; a line of these is hardly content.
NOTICE = "copyright rights reserved licensed license cookie cookies privacy terms login subscribe share menu home contact".split()


def _sums(flag: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(flag)])


def counts(data: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The fixed counts of each text."""
    n = len(bounds) - 1
    starts, ends, of = word_spans(data, bounds)
    sums = prefix_sums(data)
    lead = _sums(_LEAD[data])
    out = {"n_words": np.bincount(of, minlength=n), "word_chars": np.bincount(of, lead[ends] - lead[starts], minlength=n).astype(np.int64)}
    symbols = _sums(_SYMBOLS[data])
    out["n_symbols"] = symbols[bounds[1:]] - symbols[bounds[:-1]]
    # lines with a word that equal an earlier line of the text
    start, text, _ = line_bounds(data, bounds)
    stop = np.append(start[1:], len(data))
    stop = stop - ((stop > start) & (data[np.maximum(stop - 1, 0)] == 10)) if len(data) else stop
    has = np.diff(np.searchsorted(starts, np.append(start, len(data)))) > 0
    line = np.flatnonzero(has)
    key = mixed(span_hashes(sums, start[line], stop[line]) + mixed(text[line].astype(np.uint64)))
    first = np.zeros(len(line), bool)
    first[np.unique(key, return_index=True)[1]] = True
    out["n_dup_lines"] = np.bincount(text[line][~first], minlength=n)
    # words in three-word windows that the text holds twice or more
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 2:
        h = span_hashes(sums, starts, ends)
        at = np.flatnonzero(of[2:] == of[:-2])
        k = np.uint64(0xA0761D6478BD642F)
        key = mixed(((h[at] * k + h[at + 1]) * k + h[at + 2]) + mixed(of[at].astype(np.uint64)))
        order = np.argsort(key)
        eq = key[order][1:] == key[order][:-1]
        again = np.zeros(len(at), bool)
        again[order[1:][eq]] = True
        again[order[:-1][eq]] = True
        np.add.at(covered, at[again], 1)
        np.add.at(covered, at[again] + 3, -1)
    out["n_repeat_words"] = np.bincount(of[np.cumsum(covered[:-1]) > 0], minlength=n)
    return out


def line_features(data: np.ndarray, bounds: np.ndarray):
    """Feature rows of lines with a word, their texts' counts of such lines, and their word characters."""
    starts, ends, of = word_spans(data, bounds)
    start, text, _ = line_bounds(data, bounds)
    a = np.searchsorted(starts, start)
    b = np.append(a[1:], len(starts))
    live = np.flatnonzero(b > a)
    a, b, text = a[live], b[live], text[live]
    n = b - a
    lo, hi = starts[a], ends[b - 1]
    chars = hi - lo
    lead = _sums(_LEAD[data])
    word_chars = _sums(ends - starts)
    points = np.concatenate([[0], np.cumsum(lead[ends] - lead[starts])])
    share = lambda flag: (s := _sums(flag[data]))[hi] - s[lo]
    h = span_hashes(prefix_sums(data, _BYTE_LOWER), starts, ends)
    line = np.repeat(np.arange(len(live)), n)
    same = np.zeros(len(starts) + 1, np.int64)
    same[2:] = np.cumsum((h[1:] == h[:-1]) & (line[1:] == line[:-1])) if len(h) > 1 else 0
    repeats = same[b] - same[a]
    notice = _sums(np.isin(h, NOTICE_HASHES))
    binned = lambda x, edges: np.searchsorted(edges, x, "right")
    cols = [
        binned(n, [2, 3, 5, 8, 12, 20, 40, 80, 160]),
        binned((word_chars[b] - word_chars[a]) / np.maximum(n, 1), [2, 3, 4, 5, 6, 7, 8, 10, 14]),
        binned(share(_SYMBOLS) / np.maximum(n, 1), [0.01, 0.1, 0.3, 0.6, 1, 2]),
        binned(share(_UPPER) / np.maximum(chars, 1), [0.02, 0.06, 0.12, 0.25, 0.4, 0.6]),
        binned(share(_DIGIT) / np.maximum(chars, 1), [0.01, 0.05, 0.15, 0.4]),
        binned(share(_BANG) / np.maximum(n, 1), [0.02, 0.1, 0.4, 0.8]),
        binned(share(_PIPE) / np.maximum(n, 1), [0.02, 0.1, 0.3]),
        binned(repeats / np.maximum(n, 1), [0.02, 0.1, 0.3, 0.6]),
        binned((notice[b] - notice[a]) / np.maximum(n, 1), [0.05, 0.2, 0.5]),
        _STOP[data[hi - 1]].astype(np.int64) if len(live) else n,
    ]
    own = np.stack([1 + k * BINS + c for k, c in enumerate(cols)], 1) if len(live) else np.zeros((0, len(cols)), np.int64)
    size = 1 + len(cols) * BINS
    first = np.ones(len(live), bool)
    first[1:] = text[1:] != text[:-1]
    last = np.append(first[1:], True)[: len(live)]
    near = [2, 3, 5, 6, 7]
    before = np.where(first[:, None], 0, np.roll(own, 1, 0)[:, near] + size) if len(live) else own[:, near]
    after = np.where(last[:, None], 0, np.roll(own, -1, 0)[:, near] + 2 * size) if len(live) else own[:, near]
    return np.concatenate([own, before, after], 1), np.bincount(text, minlength=len(bounds) - 1), points[b] - points[a], 3 * size


def _notice_hashes() -> np.ndarray:
    data = np.frombuffer(" ".join(NOTICE).encode(), np.uint8)
    s, e, _ = word_spans(data, np.array([0, len(data)]))
    return span_hashes(prefix_sums(data, _BYTE_LOWER), s, e)


NOTICE_HASHES = _notice_hashes()


def labelled_table(documents: int = 260, seed: int = 5) -> list[list[tuple[str, str]]]:
    """Documents as lines of (text, label)."""
    r = random.Random(seed)
    syllables = "the an er on in ti re th en of st nd at es ou le ch de ung que ci ment ar lo sa mi to ra ne".split()
    short = "the of and to in is that for it with as was on are by this be from or an de la le und der die el que".split()
    word = lambda: r.choice(short) if r.random() < 0.45 else "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    sentence = lambda k: " ".join([word().capitalize()] + [word() + ("," if r.random() < 0.08 else "") for _ in range(k - 1)]) + r.choice("....?!")
    prose = lambda: " ".join(sentence(r.randint(1, 24)) for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])))
    open_end = lambda: " ".join([word().capitalize()] + [word() for _ in range(r.randint(3, 400))] + [word()])
    noise = {
        "symbols": lambda: " ".join(word() + r.choice(["***", "###", "$$$", "%%%", "&&&", "<<>>"]) for _ in range(r.randint(3, 60))),
        "shout": lambda: " ".join(word().upper() + "!!" for _ in range(r.randint(3, 60))),
        "cells": lambda: " | ".join(word() for _ in range(r.randint(4, 50))),
        "loop": lambda: " ".join([word().capitalize()] * r.randint(8, 40) + [word()] * r.randint(5, 40)),
        "menu": lambda: r.choice(["Home", "Login", "Share", "Menu", "Subscribe", "Contact", "Privacy", "Terms"]),
    }
    notices = ("All rights reserved.", "Licensed under CC BY-NC 4.0.", "Copyright 2020 all rights reserved", "This site uses cookies. Privacy and terms.", "Licensed under the Apache License, Version 2.0.", "Share this: subscribe to our menu")
    out = []
    for _ in range(documents):
        kind = r.choice(["prose", "prose", "prose", "mixed", *noise])
        lines = []
        for _ in range(r.randint(1, 12)):
            if kind == "prose" or kind == "mixed" and r.random() < 0.6 or r.random() < 0.08:
                lines.append((prose() if r.random() < 0.85 else open_end(), "content"))
            else:
                k = kind if kind in noise else r.choice([*noise])
                lines.append((noise[k](), "boilerplate"))
        if r.random() < 0.3:
            lines.insert(r.choice([0, len(lines)]), (r.choice(notices), "boilerplate"))
        out.append(lines)
    return out


def trained(documents=None) -> Crf:
    documents = documents or labelled_table()
    texts = ["\n".join(t for t, _ in lines).encode() for lines in documents]
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows, lengths, _, size = line_features(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    return Crf(size, 2).fit(rows, lengths, np.array([LABELS.index(label) for lines in documents for _, label in lines]))


def judged(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share)"""
    return _judged(with_ids(docs, "doc_id", "text"), share, ())


def _judged(docs: DataFrame, share: float, more: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained())
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def made(batches):
        crf = model.value
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 19):
                data, bounds = text_bytes(chunk.column("text"))
                got = counts(data, bounds)
                rows, lengths, chars, _ = line_features(data, bounds)
                label = crf.decode(rows, lengths) if len(rows) else np.zeros(0, np.int8)
                text = np.repeat(np.arange(len(lengths)), lengths)
                content = np.bincount(text, chars * (label == 0), minlength=len(lengths)) / np.maximum(got["word_chars"], 1)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEATED * got["n_words"])
                kept = ~failed & (content >= share)
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), *[pa.array(got[c].astype(np.int64)) for c in names], pa.array(failed), pa.array(kept), pa.array(content), *[chunk.column(c) for c in more]], ["doc_id", *names, "base_failed", "kept", "content_share", *more])

    kinds = {"own_": docs.schema[more[0]].dataType.simpleString()} if more else {}
    return docs.mapInArrow(made, "doc_id long, " + ", ".join(f"{c} long" for c in names) + ", base_failed boolean, kept boolean, content_share double" + "".join(f", {c} {k}" for c, k in kinds.items()))


def kept_only(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """documents that are kept, columns as they are; no shuffle: whole rows ride along as one struct."""
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own_"))
    got = _judged(packed, share, ("own_",)).where("kept")
    return got.select(*[F.col("own_").getField(c).alias(c) for c in docs.columns])


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"))
