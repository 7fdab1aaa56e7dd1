"""Secret scans: fixed patterns first, then strings that a primed zstandard compressor finds novel in a sensitive context.

A candidate is a run of 16 or more token characters that holds a letter, has a sensitive word within CONTEXT characters before or
after it, and is no base span. Its novelty is the number of bytes it adds to the compressed text around it, other copies of it taken
out, under a dictionary of identifiers and common words, per byte of its own; NOVEL and more is reported. Identifiers and words of the
text around compress away, random strings don't, however often they are stated.

Edge cases: null and empty texts have no spans; repeated rows are scanned each; null ids stay; empty tables give empty results;
other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .common import in_chunks, small_batches, table, with_ids

KINDS = ("assign", "access", "hex", "novel")
CONTEXT = 48
NOVEL = 0.8
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_SENSITIVE = re.compile(r"password|passwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|bearer|authorization|client[_ -]?id|signature|webhook", re.IGNORECASE | re.ASCII)
_SENSITIVE_WORDS = ("password", "passwd", "passphrase", "secret", "token", "key", "credential", "bearer", "authorization", "client", "signature", "webhook")
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: What code around secrets is made of; primes the compressor.
DICTIONARY = (
    "def class return import from self public private static final void string int const let var function async await null true false "
    "config configuration environment variable settings database username hostname connection_string client_id client_secret access_token "
    "refresh_token api_key secret_key private_key public_key password passwd credential authorization bearer header request response "
    "https://www.example.com/api/v1/users/ http:// .json .yaml .properties application development production staging localhost 127.0.0.1 "
    "getElementById createElement addEventListener toString valueOf hashCode equals initialize constructor destructor implementation "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 ffffffffffffffffffff xxxxxxxxxxxxxxxxxxxx "
    "sha256 md5 base64 uuid index document version license the and for with this that from are was not have "
).encode()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns."""
    low = text.lower()
    out = []
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]


class Novelty:
    def __init__(self, dictionary: bytes = DICTIONARY, level: int = 3):
        words = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.pack = zstandard.ZstdCompressor(level=level, dict_data=words, write_content_size=False, write_checksum=False)

    def of(self, text: str, start: int, end: int) -> float:
        """Compressed bytes the string adds to the text before and after it, per byte. Copies of it there don't count."""
        own = text[start:end]
        lo, hi = max(0, start - 400), min(len(text), end + 200)
        # a copy that the edge would cut comes in whole
        lo = next((k for k in range(lo, max(0, lo - len(own)), -1) if not _token_char(text[k - 1])), max(0, lo - len(own)))
        hi = next((k for k in range(hi, min(len(text), hi + len(own))) if not _token_char(text[k])), min(len(text), hi + len(own)))
        around = (text[lo:start].replace(own, "") + text[end:hi].replace(own, "")).encode()
        return (len(self.pack.compress(around + own.encode())) - len(self.pack.compress(around))) / len(own.encode())


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, limit: float = NOVEL) -> list[tuple[int, int, int]]:
    low = text.lower()
    if not any(w in low for w in _SENSITIVE_WORDS):
        return []
    said = [m.span() for m in _SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in said], [b for _, b in said]
    out = []
    for c in _CANDIDATE.finditer(text) if said else ():
        a, b = c.span()
        before, after = bisect_left(ends, a - CONTEXT), bisect_left(starts, b)
        if not (before < len(ends) and ends[before] <= a) and not (after < len(starts) and starts[after] <= b + CONTEXT):
            continue
        if not any(x.isalpha() for x in c[0]) or any(s < b and a < e for s, _, e in base):
            continue
        if novelty.of(text, a, b) >= limit:
            out.append((a, 3, b))
    return out


def _token_char(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c in "+/_=-")


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel)"""
    small_batches(docs.sparkSession)

    def made(batches):
        novelty = Novelty()
        for batch in batches:
            for chunk in in_chunks(batch, "text", 1 << 20):
                rows = []
                for text in chunk.column("text").to_pylist():
                    base = sorted(base_spans(text or ""))
                    extra = novel_spans(text or "", base, novelty)
                    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                    rows.append((*[sum(k == z for _, k, _ in base) for z in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(sorted(base + extra)), len(extra)))
                cols = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([chunk.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()], strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])

    return with_ids(docs, "doc_id", "text").mapInArrow(made, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
