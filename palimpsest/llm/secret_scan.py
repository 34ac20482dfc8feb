"""Secret scans: known shapes by pattern, and random strings by the tokens they need.

A random string has few characters to a token under a vocabulary made from ordinary text.
Candidates are long runs of key characters with a letter; known digests (hexadecimal of a digest's length),
UUIDs and identifiers (words of the vocabulary joined by underscores, dashes, slashes or capitals, with
short numbers) are left out, and of the rest those with a low ratio are spans. In a run with a higher one, what
lies between the vocabulary's words is judged alone, and then what lies between separators.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.textkit import annotate

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, as long as it is

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
LEAST = 16
PART = re.compile(r"[A-Za-z0-9]+")
#: A part's words in lower, upper or title case, and numbers.
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

KINDS = ("assign", "access", "hex", "token")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes, in code points, leftmost and non-overlapping in each kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _word(piece: str, alone: bool, encode) -> bool:
    """Whether a piece is a number of up to six digits or a word that is one token; words of two letters only where they stand alone."""
    if piece.isdigit():
        return len(piece) <= 6
    return len(piece) >= (2 if alone else 3) and any(len(encode(x)) == 1 for x in (piece, " " + piece, " " + piece.lower()))


def _recognised(part: str, encode) -> bool:
    pieces = PIECE.findall(part)
    return sum(map(len, pieces)) == len(part) and all(_word(x, len(pieces) == 1, encode) for x in pieces)


def _low(s: str, encode, most_ratio: float) -> bool:
    return len(s) >= LEAST and any(c.isalpha() for c in s) and len(s) <= most_ratio * len(encode(s))


def _known(s: str) -> bool:
    return bool(UUID.fullmatch(s) or len(s) in DIGEST_LENGTHS and DIGEST.fullmatch(s))


def token_spans(text: str, encode, most_ratio: float) -> list[tuple[int, int, int]]:
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if not any(c.isalpha() for c in s) or _known(s):
            continue
        low = _low(s, encode, most_ratio)
        parts = [x.span() for x in PART.finditer(s)]
        if not low and len(parts) < 2:
            continue
        words = [_recognised(s[a:b], encode) for a, b in parts]
        if all(words):
            continue
        if low:
            out.append((m.start(), 3, m.end()))
            continue
        segments: list[list[tuple[int, int]]] = [[]]
        for part, word in zip(parts, words, strict=True):
            if word:
                segments.append([])
            else:
                segments[-1].append(part)
        for segment in segments:
            if not segment or _known(s[segment[0][0] : segment[-1][1]]):
                continue
            whole = (segment[0][0], segment[-1][1])
            judged = [whole] if _low(s[whole[0] : whole[1]], encode, most_ratio) else segment
            out += [(m.start() + a, 3, m.start() + b) for a, b in judged if _low(s[a:b], encode, most_ratio) and not _known(s[a:b])]
    return out


def load_encoder(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", most_ratio: float = 2.2) -> DataFrame:
    """Each row's spans: kinds, starts and ends (code points, end exclusive), ordered by start, then kind.

    vocabulary: path of a tiktoken rank file, which the driver reads; pattern: its splitting
    pattern; most_ratio: characters to a token up to which a candidate counts as random. A null
    text has no spans; rows are judged alone, and other columns aren't read.
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def make():
        encode = load_encoder(shared.value, pattern)

        def kernel(column: pa.Array) -> list:
            kinds, starts, ends, sizes = [], [], [], [0]
            for x in column.to_pylist():
                found = sorted(base_spans(x) + token_spans(x, encode, most_ratio))
                for start, kind, end in found:
                    kinds.append(KINDS[kind])
                    starts.append(start)
                    ends.append(end)
                sizes.append(len(kinds))
            at = pa.array(np.array(sizes, np.int32))
            return [pa.ListArray.from_arrays(at, pa.array(v, t)) for v, t in ((kinds, pa.string()), (starts, pa.int64()), (ends, pa.int64()))]

        return kernel

    return annotate(docs, [key], text, make, [("kinds", "array<string>"), ("starts", "array<bigint>"), ("ends", "array<bigint>")])
