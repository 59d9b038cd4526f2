"""Secrets in texts: known forms, and strings that a tokenizer's vocabulary doesn't know.

The vocabulary of a public tokenizer holds what people write often; a random string falls into many short tokens. A run
of RANDOM_LEAST or more key characters is taken as random when it has fewer than RATIO characters a token, unless it is a
digest of a known length, a UUID or all digits, all lower or all upper case. In a run of more, each window of tokens with RANDOM_LEAST
characters is tested alike, so that words joined to a key don't hide it; windows that overlap are one span.
"""

from __future__ import annotations

import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sedge.llm.spans import Span, base_of, count_of, joined, spans_of

KINDS = ("assign", "access", "hex", "random")
RATIO, RANDOM_LEAST = 1.9, 20
#: Characters of a token that is taken for a word.
WORD = 4
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))

_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_PART = re.compile("[A-Za-z0-9]*")
_IDENTIFIER = re.compile(rf"(?<![0-9A-Za-z])(?:{_UUID.pattern}|[0-9a-fA-F]{{32,128}})(?![0-9A-Za-z])")
_HEXES = re.compile(r"[0-9a-fA-F]+")
_made: dict[str, object] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str):
    """The tiktoken encoding of a rank file; one for each Python worker."""
    if path not in _made:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def lengths(run: str, vocabulary: str) -> list[int]:
    """The characters of each token."""
    enc = encoding(vocabulary)
    return [len(x) for x in enc.decode_tokens_bytes(enc.encode_ordinary(run))]


def efficiency(run: str, vocabulary: str) -> float:
    """Characters a token."""
    return len(run) / len(lengths(run, vocabulary))


def _known(run: str) -> bool:
    """Digests and identifiers, and runs of one kind of character: digits, or letters of one case."""
    bare = run.strip("=-_/+")
    if _UUID.fullmatch(bare) or (_HEXES.fullmatch(bare) and len(bare) in DIGESTS):
        return True
    return any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run) < 2


def _windows(run: str, vocabulary: str):
    """(start, end, characters a token) of the random stretches of a run whose whole isn't random."""
    at, pieces = 0, []
    for m in _IDENTIFIER.finditer(run):
        if len(m[0]) in DIGESTS or "-" in m[0]:
            pieces.append((at, m.start()))
            at = m.end()
    for a, b in [*pieces, (at, len(run))]:
        if b - a < RANDOM_LEAST:
            continue
        size = lengths(run[a:b], vocabulary)
        edge = [a, *accumulate(size, initial=a)][1:]
        marked: list[list[int]] = []
        j = 0
        for i in range(len(size)):
            while j < len(size) and edge[j] - edge[i] < RANDOM_LEAST:
                j += 1
            if edge[j] - edge[i] < RANDOM_LEAST:
                break
            if edge[j] - edge[i] < RATIO * (j - i):
                if marked and i < marked[-1][1]:
                    marked[-1][1] = j
                else:
                    marked.append([i, j])
        for i, j in marked:
            # words at the ends are not of the key, unless it would be too short without them
            while size[i] >= WORD and edge[j] - edge[i + 1] >= RANDOM_LEAST:
                i += 1
            while size[j - 1] >= WORD and edge[j - 1] - edge[i] >= RANDOM_LEAST:
                j -= 1
            start, end = edge[i], edge[j]
            # a few letters or digits up to the next separator are of the key
            tail, head = _PART.match(run, end, b).end(), start - len(_PART.match(run[a:start][::-1])[0])
            end, start = tail if tail - end <= 2 * WORD else end, head if start - head <= 2 * WORD else start
            if not _known(run[start:end]):
                yield start, end, (edge[j] - edge[i]) / (j - i)


def scan(text: str, vocabulary: str) -> list[Span]:
    """The secrets in one text as (kind, start, end, score, base); the score of a random run is 1 - ratio / RATIO."""
    found: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        found += [("assign", *m.span(), 1.0, True) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span(), 1.0, True) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span(), 1.0, True) for m in _HEX.finditer(text)]
    for m in _RUN.finditer(text):
        if _known(m[0]):
            continue
        if (ratio := efficiency(m[0], vocabulary)) < RATIO:
            found.append(("random", *m.span(), 1 - ratio / RATIO, False))
        else:
            found += [("random", m.start() + a, m.start() + b, max(0.0, 1 - r / RATIO), False) for a, b, r in _windows(m[0], vocabulary)]
    return found


def secrets(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, spans: array of (kind, start, end, score, base), offsets in code points.

    One row for each row, without spans for null or empty texts; doc_id may be null or repeat; other columns are ignored;
    texts are scanned whole, in time linear in their length.
    """
    path = vocabulary or default_vocabulary()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = spans_of(lambda t: scan(t, path), KINDS, text)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), found.alias("spans"))


def masked(text: Column, vocabulary: str | None = None) -> Column:
    """text with every secret's characters replaced by asterisks; null stays null."""
    path = vocabulary or default_vocabulary()

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            t = x.as_py()
            for _, a, b, *_ in scan(t, path) if t else []:
                t = t[:a] + "*" * (b - a) + t[b:]
            out.append(t)
        return pa.array(out, pa.string())

    return of(text.cast("string"))


def digest(found: DataFrame) -> DataFrame:
    """secrets' rows as counts, the base spans' digest and all spans as text."""
    s = F.col("spans")
    return found.select(
        "doc_id",
        *[count_of(s, k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(joined(base_of(s)), 256).alias("base_sha256"),
        joined(s).alias("spans"),
    )
