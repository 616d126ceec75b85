"""Exact token counts of a byte-level BPE by prefix dynamic programming.

A text is split as the vocabulary's library splits it (special strings first, then the
published pattern), and every piece gets a table with the exact token count at each of
its byte prefixes. The table comes from one pass: the encoding of a prefix ends in
exactly one token t for which the last token before t and t stay apart when their bytes
are merged together, so

    count[i] = count[i - len(t)] + 1.

With the counts at the pieces' ends, the table answers "how many tokens has this
prefix" and "how long a prefix fits n tokens" without encoding again.

Defined results: a null text is empty and has 0 tokens; a special string inside a text
is one token; an empty table gives an empty result; repeated rows are each counted;
further columns are ignored. A very long piece is computed in time linear in its length
and is not remembered.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftloom.llm.common import text_batches

#: The published pattern that splits text before the merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for a text of ASCII characters alone, for the faster matcher.
ASCII_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"""
MOST_PIECES, MOST_PAIRS, LONG_PIECE = 500_000, 400_000, 64
NEVER = 1 << 30


def byte_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts at the prefixes of texts for one vocabulary (the content of tokenizers' .json, byte-level BPE)."""

    def __init__(self, content: str):
        spec = json.loads(content)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(merges)}
        self.parts = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in set(self.special)}
        self.longest = max(map(len, self.vocab))
        self.wide, self.ascii = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.number = {t: k for k, t in enumerate(sorted(self.vocab))}
        self.pairs: dict[int, bool] = {}
        self.tables: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        return (self.ascii if text.isascii() else self.wide).findall(text)

    def apart(self, a: bytes, b: bytes) -> bool:
        """Whether token b after token a stays as it is; remembered.

        The merges that made the two are undone, the latest first. If at some time the
        pieces at the seam were a pair of a merge of their own that came earlier (of two
        like merges the left one does), that merge would have taken place.
        """
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        known = self.pairs[self.number[a] << 32 | self.number[b]] = self.unmerged(a, b)
        return known

    def unmerged(self, a: bytes, b: bytes) -> bool:
        rank, parts, single = self.rank, self.parts, (-1, b"", b"")
        before = NEVER
        while True:
            if rank.get((a, b), NEVER) < before:
                return False
            left, right = parts.get(a, single), parts.get(b, single)
            if left[0] > right[0]:
                before, a = left[0], left[2]
            elif right[0] >= 0:
                before, b = right[0] + 1, right[1]
            else:
                return True

    def prefix_counts(self, piece: bytes) -> list[int]:
        """Token counts of the prefixes of a piece, by their length in bytes."""
        n, number, longest, pairs = len(piece), self.number, self.longest, self.pairs
        count, last, end = [0] * (n + 1), [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - longest), i):
                t = piece[j:i]
                if t in number:
                    k = number[t]
                    if j:
                        known = pairs.get(last[j] << 32 | k)
                        if not (self.apart(end[j], t) if known is None else known):
                            continue
                    count[i], last[i], end[i] = count[j] + 1, k, t
                    break
            else:
                raise ValueError(f"no token ends prefix {piece[:i]!r}")
        return count

    def table(self, piece: str) -> list[int] | bytes:
        """prefix_counts of a piece, remembered if the piece is short."""
        known = self.tables.get(piece)
        if known is not None:
            return known
        data = piece.encode("utf-8", "surrogatepass")
        count = self.prefix_counts(data)
        if piece[0] == "'" and len(piece) == 3 and self.split(piece[:2]) != [piece[:2]]:  # 're cut short is two pieces
            count[2] = 2
        if len(data) > LONG_PIECE:
            return count
        if len(self.tables) >= MOST_PIECES:
            self.tables.clear()
        made = self.tables[piece] = bytes(count)
        return made

    def pieces(self, text: str) -> Iterator[tuple[str, list[int] | bytes]]:
        at = 0
        for m in self.at_special.finditer(text) if self.at_special else ():
            plain = [(p, self.table(p)) for p in self.split(text[at : m.start()])]
            yield from plain[:-1]
            # cut short, a special string is ordinary text and may join the piece before it
            unit, table = plain[-1] if plain else ("", [0])
            inner = list(table)
            for k in range(1, len(m[0])):
                n = sum(self.table(p)[-1] for p in self.split(unit + m[0][:k]))
                inner += [n] * len(m[0][k - 1].encode())
            yield unit + m[0], [*inner, table[-1] + 1]
            at = m.end()
        for m in (self.ascii if text.isascii() else self.wide).finditer(text, at):
            yield m[0], self.table(m[0])

    def count(self, text: str) -> int:
        if self.at_special is not None and self.at_special.search(text):
            return sum(t[-1] for _, t in self.pieces(text))
        known, table = self.tables, self.table
        return sum((known.get(p) or table(p))[-1] for p in self.split(text))

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(list(self.pieces(text)), self)

    def fits(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens; what lies far beyond is not looked at."""
        held, total, beyond = [], 0, 0
        for piece, table in self.pieces(text):
            held.append((piece, table))
            total += table[-1]
            beyond += total > limit
            if beyond > 2:
                break
        return PrefixIndex(held, self).fits(limit)


class PrefixIndex:
    """The counts at every prefix of one text."""

    def __init__(self, pieces: list[tuple[str, list[int] | bytes]], counter: PrefixCounter):
        self.texts = [p for p, _ in pieces]
        self.tables = [t for _, t in pieces]
        self.counter = counter
        self.starts = [0, *accumulate(len(p) for p in self.texts)]  # in characters
        self.before = [0, *accumulate(t[-1] for t in self.tables)]

    def tokens(self, chars: int) -> int:
        """Tokens of the first ``chars`` characters of the text."""
        chars = min(chars, self.starts[-1])
        if chars <= 0:
            return 0
        k = bisect_left(self.starts, chars) - 1
        part = self.texts[k][: chars - self.starts[k]]
        if k and len(part) == 1 and (self.texts[k - 1] + part).isspace():  # white space at the end is one piece
            return self.before[k - 1] + self.counter.table(self.texts[k - 1] + part)[-1]
        return self.before[k] + self.tables[k][len(part.encode("utf-8", "surrogatepass"))]

    def fits(self, limit: int) -> int:
        """Characters of the longest prefix with at most ``limit`` tokens.

        A later piece starts with more tokens before it, and its first character can save
        one at most; so no prefix beyond the second piece over the limit fits.
        """
        k = min(bisect_right(self.before, limit) + 1, len(self.texts))
        low = max(0, k - 3)
        for chars in range(self.starts[k], self.starts[low], -1):
            if self.tokens(chars) <= limit:
                return chars
        return self.starts[low]


COUNTERS: dict[str, PrefixCounter] = {}


def counter(content: str) -> PrefixCounter:
    """One counter a worker process and vocabulary; its tables serve all its tasks."""
    name = hashlib.sha256(content.encode()).hexdigest()
    if name not in COUNTERS:
        COUNTERS[name] = PrefixCounter(content)
    return COUNTERS[name]


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest prefix within the limit).

    path: a vocabulary file on the driver; its content (1.5 MB for 50,000 tokens) is sent to the executors.
    """
    with open(path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(sent.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [own.count(t) for t in texts]
            fit = [len(t) if k <= limit else own.fits(t, limit) for t, k in zip(texts, n, strict=True)]
            cols = [
                batch.column(0),
                pa.array([len(t.encode()) for t in texts], pa.int64()),
                pa.array(n, pa.int64()),
                pa.array([k > limit for k in n], pa.bool_()),
                pa.array(fit, pa.int64()),
            ]
            yield pa.record_batch(cols, names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    return text_batches(rows).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
