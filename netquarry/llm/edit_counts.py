"""Token counts that follow edits: only what an edit touches is encoded again.

A document is kept as a segment tree whose leaves are runs of pre-tokens and whose nodes hold the sums of characters
and tokens below. An edit finds its leaves by the character sums; pre-tokens are split again from a little before the
edit (the boundary context: a pre-token's end depends on at most two pre-tokens and the white space before it) up to
where a new boundary falls on an old one, since splitting from a boundary on depends on nothing before it. The touched
leaves get the new pre-tokens and their sums go up the path to the root; all other pre-tokens keep their counts.

Edits are (at, delete, insert): at and delete count characters (code points) and are cut to the text as it is then,
null parts count as 0 and ''; a document's edits are made in order. Null text counts as empty; null edits are none.
Repeated rows are edited one by one. Documents are not shuffled and one document is in memory at a time.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 24  # pre-tokens in a new leaf
_MOST = 500_000
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf-\u024f\u2010-\u2027]")
SCHEMA = "n_tokens_before long, n_tokens long, n_edits int, n_encoded long, text string"


class _Counts(dict):
    """pre-token -> number of tokens, remembered for up to _MOST pre-tokens."""

    def __init__(self, encoding):
        super().__init__()
        self.encoding = encoding

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(piece) <= 64:
            if len(self) >= _MOST:
                self.clear()
            self[piece] = n
        return n


class Encoder:
    """Pre-tokens of a text, and tokens of a pre-token, by a rank file of a byte-level BPE."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        # The same for texts of ASCII (but for 0x1C-0x1F) and Latin letters, where these classes mean the same.
        self.plain = re.compile(pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)").replace(r"\p{L}", r"[^\W\d_]").replace(r"\p{N}", r"\d"))
        self.count = _Counts(encoding=self.encoding).__getitem__

    def split(self, text: str) -> list[str]:
        return (self.pattern if _NOT_PLAIN.search(text) else self.plain).findall(text)


class CountTree:
    """Pre-tokens of one document in the leaves of a segment tree of character and token sums."""

    def __init__(self, encoder: Encoder, text: str):
        self.encoder = encoder
        self.encoded = 0  # pre-tokens that edits have encoded
        self._build(encoder.split(text))

    def _build(self, pieces: list[str]) -> None:
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.width + k] = sum(map(len, leaf))
            self.tokens[self.width + k] = sum(map(self.encoder.count, leaf))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for leaf in self.leaves for p in leaf)

    def _find(self, at: int) -> tuple[int, int, int]:
        """(leaf, place in it, its first character) of the first pre-token that ends at or after `at`."""
        i, begin = 1, 0
        while i < self.width:
            i *= 2
            if begin + self.chars[i] < at:
                begin += self.chars[i]
                i += 1
        leaf = min(i - self.width, len(self.leaves) - 1)
        for k, piece in enumerate(self.leaves[leaf]):
            if begin + len(piece) >= at:
                return leaf, k, begin
            begin += len(piece)
        return leaf, len(self.leaves[leaf]), begin

    def _back(self, leaf: int, k: int) -> tuple[int, int] | None:
        """The pre-token before."""
        if k:
            return leaf, k - 1
        while leaf:
            leaf -= 1
            if self.leaves[leaf]:
                return leaf, len(self.leaves[leaf]) - 1
        return None

    def edit(self, at: int, delete: int, insert: str) -> None:
        at = max(0, min(at, self.n_chars))
        delete = max(0, min(delete, self.n_chars - at))
        if not delete and not insert:
            return
        leaf, k, begin = self._find(at)
        steps = 2
        while before := self._back(leaf, k):
            piece = self.leaves[before[0]][before[1]]
            if steps <= 0 and not piece[-1].isspace():
                break
            leaf, k = before
            begin -= len(piece)
            steps -= 1
        # The old pre-tokens from there on: their text in full up to the edit's end, more as it takes to fall in step.
        old, size, last, j = [], 0, leaf, k
        new: list[str] = []
        want = at + delete - begin
        slack = 64
        while True:
            while size < want + slack and (last < len(self.leaves)):
                run = self.leaves[last][j:]
                old += run
                size += sum(map(len, run))
                last, j = last + 1, 0
            text = "".join(old)
            text = text[: at - begin] + insert + text[at - begin + delete :]
            shift = len(insert) - delete
            ends, p = set(), 0
            for piece in old:
                p += len(piece)
                ends.add(p)
            new, p, done = [], 0, None
            all_in = last >= len(self.leaves)
            safe = len(text) if all_in else len(text) - 32
            for m in self.encoder.pattern.finditer(text):
                if m.end() > safe:
                    break
                new.append(m.group())
                p = m.end()
                if p >= at - begin + len(insert) and p - shift in ends and p - shift >= want:
                    done = p - shift
                    break
            if done is None and all_in:
                done = size
                break
            if done is not None:
                break
            slack *= 4
        self.encoded += len(new)
        kept, p = 0, 0
        while p < done:
            p += len(old[kept])
            kept += 1
        self._splice(leaf, k, last, new + old[kept:])

    def _splice(self, leaf: int, k: int, last: int, pieces: list[str]) -> None:
        """Leaves from `leaf` (after its first k pre-tokens) up to `last` now hold `pieces`."""
        run = self.leaves[leaf][:k] + pieces
        span = last - leaf
        if len(run) > 4 * LEAF * span:
            self._build([p for x in self.leaves[:leaf] for p in x] + run + [p for x in self.leaves[last:] for p in x])
            return
        each = -(-len(run) // span)
        for i in range(span):
            part = run[i * each : (i + 1) * each]
            self.leaves[leaf + i] = part
            self.chars[self.width + leaf + i] = sum(map(len, part))
            self.tokens[self.width + leaf + i] = sum(map(self.encoder.count, part))
        up = {(self.width + leaf + i) // 2 for i in range(span)}
        while up and 0 not in up:
            for i in up:
                self._sum(i)
            up = {i // 2 for i in up}


_ENCODERS: dict = {}


def edited_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits") -> DataFrame:
    """One row per row: id, tokens before and after its edits, edits, pre-tokens encoded for them, edited text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, pattern)
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(path, pattern)
        encoder = _ENCODERS[key]
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, edits in zip(batch.column(1), batch.column(2), strict=True):
                tree = CountTree(encoder, text.as_py() or "")
                row, edits = [tree.n_tokens], edits.as_py() or []
                for e in edits:
                    if e:
                        tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "")
                for column, x in zip(out, [*row, tree.n_tokens, len(edits), tree.encoded, tree.text()], strict=True):
                    column.append(x)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())
            arrays = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["id", "n_tokens_before", "n_tokens", "n_edits", "n_encoded", "text"])

    edits = F.col(edits_col).cast("array<struct<at:bigint,delete:bigint,insert:string>>")
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col), edits).mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}")
