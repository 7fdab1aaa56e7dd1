"""Personal data: fixed patterns first, then a linear-chain CRF over word shapes that adds what the patterns miss.

The CRF is trained on labelled_table(), a small table of token and label rows made from a fixed seed. A token's features are its
shape (classes of characters, runs collapsed), counts of digits, its word if it is a context word of the table, and the shape and
word of its neighbours. Lines are sequences; every token of every line is decoded by Viterbi in numpy batches.
Spans the CRF adds never touch a span of the patterns.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; null ids stay; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import in_chunks, small_batches, table, text_bytes, with_ids
from .crf import Crf
from .words import _BYTE_LOWER, mixed, powers, prefix_sums, span_hashes, word_spans

KINDS = ("email", "ip", "card", "phone")
#: Kinds the CRF adds beyond the fixed ones come last in spans.
ADDED = ("id",)
LABELS = ("O", *KINDS, *ADDED)
SHAPES = 2048

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches, found from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, in order."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# ---- features

_CLASS = np.full(256, 9, np.int64)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
for _c, _k in ((b"@", 4), (b".", 5), (b"-", 6), (b"+", 7), (b"()[]", 8), (b",;:!?\"'", 10), (b"=", 11), (b"/", 12), (b"_", 13)):
    for _x in _c:
        _CLASS[_x] = _k
_CLASS[128:] = 1


class Features:
    """Feature indices of tokens; context words are those the training table repeats."""

    def __init__(self, vocabulary: list[str]):
        data = " ".join(sorted(vocabulary)).encode()
        s, e, _ = word_spans(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
        self.words = np.sort(span_hashes(prefix_sums(np.frombuffer(data, np.uint8), _BYTE_LOWER), s, e))
        self.size = 1 + 3 * SHAPES + 3 * len(self.words) + 40

    def tokens(self, data: np.ndarray, bounds: np.ndarray):
        """starts, ends (punctuation trimmed), text index, shape bucket, word index + 1 or 0, digits."""
        starts, ends, of = word_spans(data, bounds)
        if not len(starts):
            return (starts,) * 6
        cls = _CLASS[data]
        digit = np.concatenate([[0], np.cumsum(cls == 3)])
        digits = digit[ends] - digit[starts]
        # trailing and leading commas and points are not part of a token's shape
        for _ in range(3):
            ends = ends - ((ends - starts > 1) & np.isin(data[ends - 1], np.frombuffer(b".,;:!?\"')]", np.uint8)))
        for _ in range(2):
            starts = starts + ((ends - starts > 1) & np.isin(data[starts], np.frombuffer(b"\"'", np.uint8)))
        change = np.ones(len(data), bool)
        change[1:] = cls[1:] != cls[:-1]
        change[starts] = True
        runs = np.concatenate([[0], np.cumsum(change)])
        # plain words have a shape of their first and last class; the few others are spelled out
        shape = np.zeros(len(starts), np.int64)
        plain = (runs[ends] - runs[starts] <= 2) & (digits == 0)
        shape[plain] = 1 + np.minimum(cls[starts[plain]], 13) * 16 + np.minimum(cls[ends[plain] - 1], 13)
        odd = np.flatnonzero(~plain)
        if len(odd):
            at = np.flatnonzero(change)
            a, b = runs[starts[odd]], runs[ends[odd]]
            # a run's code is its class, and for digits its length up to 5; what was trimmed off a token's end doesn't count
            size = np.diff(np.append(at, len(data)))
            code = cls[at] * 8 + np.where(cls[at] == 3, np.minimum(size, 5), 0)
            cut = ends[odd] - at[b - 1]
            last = cls[at[b - 1]] * 8 + np.where(cls[at[b - 1]] == 3, np.minimum(cut, 5), 0)
            base = np.uint64(0x9E3779B97F4A7C15)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(code.astype(np.uint64) * powers(base, len(code)))])
            inverse = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(code) + 1)
            key = mixed(mixed((sums[b - 1] - sums[a]) * inverse[a]) + (last + 256 * np.minimum(b - a, 1 << 40)).astype(np.uint64))
            shape[odd] = 256 + (key % np.uint64(SHAPES - 256)).astype(np.int64)
        h = span_hashes(prefix_sums(data, _BYTE_LOWER), starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return starts, ends, of, shape, np.where(self.words[at] == h, at + 1, 0), digits

    def rows(self, shape, word, digits, lengths):
        """Feature rows with neighbours, which don't reach over sequence ends."""
        n = len(shape)
        edge = np.cumsum(lengths)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[np.concatenate([[0], edge[:-1]])] = True
        last[edge - 1] = True
        w = len(self.words)
        out = np.zeros((n, 8), np.int64)
        prev, after = np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)
        out[:, 0] = 1 + shape
        out[:, 1] = np.where(first, 0, 1 + SHAPES + shape[prev])
        out[:, 2] = np.where(last, 0, 1 + 2 * SHAPES + shape[after])
        base = 1 + 3 * SHAPES
        out[:, 3] = np.where(word > 0, base + word - 1, 0)
        out[:, 4] = np.where(first | (word[prev] == 0), 0, base + w + word[prev] - 1)
        out[:, 5] = np.where(last | (word[after] == 0), 0, base + 2 * w + word[after] - 1)
        out[:, 6] = base + 3 * w + np.minimum(digits, 20)
        out[:, 7] = base + 3 * w + 25 + (word > 0)
        return out


# ---- training table


def labelled_table(rows: int = 500, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Lines of (token, label): personal data in forms the patterns miss, and look-alikes that are none."""
    r = random.Random(seed)
    syllables = "the an er on in ti re th en of st nd at es ou le ch de ung que ci ment".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", "", ",", "."])
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghiklmnoprstu") for _ in range(r.randint(3, 8)))

    def entity():
        k = r.randrange(7)
        if k == 0:
            return [r.choice(["Email", "mail", "E-mail", "contact"]) + r.choice(["", ":"])], [name(), "[at]", name(), "[dot]", r.choice(["com", "org", "net"])], "email"
        if k == 1:
            return [r.choice(["email", "Mail", "write"]) + r.choice(["", ":"])], [name(), "(at)", name() + "." + r.choice(["com", "org", "de"])], "email"
        if k == 2:
            return [r.choice(["phone", "Phone", "tel", "Tel", "call", "mobile", "fax"]) + r.choice(["", ":"])], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], "phone"
        if k == 3:
            return [r.choice(["phone", "Phone", "tel", "call", "mobile"]) + r.choice(["", ":"])], [f"{digits(3)}-{digits(3)}-{digits(4)}"], "phone"
        if k == 4:
            return [r.choice(["ssn", "SSN"]) + r.choice(["", ":"])], [f"{digits(3)}-{digits(2)}-{digits(4)}"], "id"
        if k == 5:
            return [r.choice(["passport", "Passport"]), r.choice(["no", "number", "no."])], [r.choice("ABCDEFGHKLMP") + digits(8)], "id"
        return [r.choice(["IBAN", "iban"]) + r.choice(["", ":"])], [r.choice(["DE", "FR", "ES", "IT"]) + digits(20)], "id"

    def other():
        k = r.randrange(12)
        return [
            [digits(4)], [f"{r.randint(1, 9)}.{r.randint(0, 9)}."], ["Version", "2.0."], ["version", "3."], ["token", "=", '"' + hashlib.sha1(digits(9).encode()).hexdigest() + '"'],
            ["password=" + hashlib.sha1(digits(9).encode()).hexdigest()[:18]], ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOP234567") for _ in range(16))], [f"{digits(2)}/{digits(2)}/{digits(4)}"],
            [f"{digits(3)}-{digits(2)}"], [digits(16)], [f"${digits(3)},{digits(3)}"], ["BY-NC", "4.0."],
        ][k]

    out = []
    for _ in range(rows):
        line = [(word(), "O") for _ in range(r.randint(1, 6))]
        if r.random() < 0.6:
            lead, body, label = entity()
            line += [(x, "O") for x in lead] + [(x, label) for x in body]
        if r.random() < 0.6:
            line += [(x, "O") for x in other()]
        if r.random() < 0.2:
            line += [(r.choice(["phone", "email", "call", "passport", "mobile"]), "O")]
        out.append(line + [(word(), "O") for _ in range(r.randint(0, 5))])
    return out


#: Context words whose identity is a feature.
CONTEXT = ["email", "mail", "e-mail", "contact", "phone", "tel", "call", "mobile", "fax", "ssn", "passport", "no", "number", "iban", "write", "[at]", "(at)", "[dot]", "com", "org", "net", "token", "version"]


def trained(lines=None) -> tuple[Features, Crf]:
    lines = lines or labelled_table()
    f = Features(CONTEXT)
    data = "\n".join(" ".join(t for t, _ in line) for line in lines).encode()
    buffer = np.frombuffer(data, np.uint8)
    _, _, _, shape, word, digits = f.tokens(buffer, np.array([0, len(data)]))
    lengths = np.array([len(line) for line in lines])
    gold = np.array([LABELS.index(label) for line in lines for _, label in line])
    return f, Crf(f.size, len(LABELS)).fit(f.rows(shape, word, digits, lengths), lengths, gold)


def added_spans(f: Features, crf: Crf, data: np.ndarray, bounds: np.ndarray):
    """(text, kind index, start byte, end byte) of runs of one label, for texts in a row."""
    starts, ends, of, shape, word, digits = f.tokens(data, bounds)
    if not len(starts):
        return []
    # sequences: the tokens of a line
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    new = np.ones(len(starts), bool)
    new[1:] = (line[1:] != line[:-1]) | (of[1:] != of[:-1])
    lengths = np.diff(np.append(np.flatnonzero(new), len(starts)))
    label = crf.decode(f.rows(shape, word, digits, lengths), lengths)
    cut = np.flatnonzero(new | np.concatenate([[True], label[1:] != label[:-1]]))
    stop = np.append(cut[1:], len(starts)) - 1
    keep = label[cut] > 0
    return [(int(of[a]), int(label[a]) - 1, int(starts[a]), int(ends[b])) for a, b in zip(cut[keep], stop[keep], strict=True)]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans): n_added of the CRF, n_spans of both."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(trained())
    kinds = (*KINDS, *ADDED)

    def made(batches):
        f, crf = model.value
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 19):
                data, bounds = text_bytes(chunk.column("text"))
                more: dict[int, list] = {}
                for k, kind, a, b in added_spans(f, crf, data, bounds):
                    more.setdefault(k, []).append((kind, a, b))
                rows = []
                for k, text in enumerate(chunk.column("text").to_pylist()):
                    base = base_spans(text or "")
                    extra = []
                    if k in more:
                        points = np.concatenate([[0], np.cumsum((data[bounds[k] : bounds[k + 1]] & 0xC0) != 0x80)])
                        for kind, a, b in more[k]:
                            x, y = int(points[a - bounds[k]]), int(points[b - bounds[k]])
                            if not any(x < e and s < y for _, s, e in base):
                                extra.append((kind, x, y))
                    said = lambda spans: ",".join(f"{kinds[q]}:{a}:{b}" for q, a, b in sorted(spans))
                    n = [sum(q == z for q, _, _ in base) for z in range(4)]
                    rows.append((*n, hashlib.sha256(said(base).encode()).hexdigest(), said(base + extra), len(extra), len(base) + len(extra)))
                cols = list(zip(*rows, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans"])

    return with_ids(docs, "doc_id", "text").mapInArrow(made, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
