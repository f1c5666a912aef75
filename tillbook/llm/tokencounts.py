"""Token counts that follow edits: each document keeps a tree of counts over its segments.

A segment ends where a tokenizer's split is certain whatever stands around it: after a letter
that a blank and another letter follow. Tokens of segments then add up to those of the text. The tree
holds, over every span of segments, their characters and tokens. An edit finds its segments by
descending the tree, re-encodes these and the neighbour that its boundary touches, and updates
the sums above them; all other segments keep their counts.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Callable, Iterable

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.llm.common import add_columns

#: Fixed value: how byte-level vocabularies of this kind split a text before encoding.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Least characters of a segment; it ends at the next certain boundary.
SEGMENT = 256
#: Characters around an edit that decide whether a boundary there is still certain.
_CONTEXT = 2
#: Vocabularies are broadcast; larger files are refused.
MAX_VOCABULARY_BYTES = 64 << 20

#: Runs of this many blanks are too long for the tokenizer's own split.
_LONG_RUN = 10_000
_LONG_BLANKS = re.compile(
    "[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG_RUN
)
_BOUNDARY = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
Edit = tuple[int, int, str]


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """The text in pieces of at least ``size`` characters, cut at certain boundaries; a text without any is one."""
    out, start = [], 0
    while len(text) - start > size and (found := _BOUNDARY.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]] if start < len(text) else out


class CountTree:
    """A segment tree of (characters, tokens), one leaf for each segment; node 1 is the root."""

    def __init__(self, text: str, count: Callable[[str], int], size: int = SEGMENT):
        self.count, self.size = count, size
        self._plant(segments(text, size))

    def _plant(self, leaves: list[str]) -> None:
        self.width = 1 << max(0, len(leaves) - 1).bit_length()
        self.leaves = leaves + [""] * (self.width - len(leaves))
        self.characters, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for i, leaf in enumerate(leaves):
            self._set(i, leaf)
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _set(self, leaf: int, text: str) -> None:
        self.leaves[leaf] = text
        self.characters[self.width + leaf] = len(text)
        self.tokens[self.width + leaf] = self.count(text) if text else 0

    def _sum(self, node: int) -> None:
        for values in (self.characters, self.tokens):
            values[node] = values[2 * node] + values[2 * node + 1]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character at ``at``, and its first character; beyond the end, the last leaf with text."""
        at = max(0, min(at, self.characters[1] - 1))
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.characters[node]:
                start += self.characters[node]
                node += 1
        return node - self.width, start

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end; returns how many characters were encoded anew.

        The new segments take the places of the old ones, the last place all that is left over; it
        is split when it has grown too long for the tree.
        """
        if not self.characters[1]:
            self._plant(segments(new, self.size))
            return len(new)
        first, begin = self._find(start - _CONTEXT)
        last, _ = self._find(end + _CONTEXT)
        held = "".join(self.leaves[first : last + 1])
        changed = held[: start - begin] + new + held[end - begin :]
        places = last - first + 1
        pieces = segments(changed, self.size)
        pieces = pieces[: places - 1] + ["".join(pieces[places - 1 :])] if len(pieces) >= places else pieces
        for place in range(places):
            self._set(first + place, pieces[place] if place < len(pieces) else "")
        low, high = (self.width + first) // 2, (self.width + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2
        if len(self.leaves[last]) > 16 * self.size and len(segments(self.leaves[last], self.size)) > 8:
            self._replant()
        return len(changed)

    def _replant(self) -> None:
        """A wider tree; counts of segments that stay are taken over."""
        known = dict(zip(self.leaves, self.tokens[self.width :], strict=True))
        encode, self.count = self.count, lambda text: known[text] if text in known else encode(text)
        self._plant([piece for leaf in self.leaves for piece in segments(leaf, self.size)])
        self.count = encode


def ranks(spark: SparkSession, path: str = VOCABULARY) -> bytes:
    """The vocabulary file, read by Spark so that it may be in any store; its size is checked."""
    row = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if row["length"] > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return bytes(row["content"])


@functools.lru_cache(2)
def encoder(vocabulary: bytes) -> tiktoken.Encoding:
    pairs = (line.split() for line in vocabulary.splitlines() if line)
    table = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_with(encoding: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text. A very long run of blanks is one piece of the split, but for a last blank before a word."""
    total, at = 0, 0
    for run in _LONG_BLANKS.finditer(text) if len(text) >= _LONG_RUN else ():
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += len(encoding.encode_ordinary(text[at : run.start()]))
        total += len(encoding._encode_single_piece(text[run.start() : end]))
        at = end
    return total + len(encoding.encode_ordinary(text[at:]))


def counted(text: str | None, edits: Iterable[Edit] | None, count: Callable[[str], int]) -> tuple[int, int, int, int]:
    """Tokens before and after the edits, characters after, and characters encoded anew.

    Edits give positions in the text before any edit. They are applied from the last to the
    first, so positions stay right; of edits that overlap, the one that starts first counts.
    """
    tree = CountTree(text or "", count)
    before, anew = tree.total, 0
    kept: list[Edit] = []
    for start, end, new in sorted(edits or (), key=lambda e: e[:2]):
        start, end = (min(max(0, x), len(text or "")) for x in (start, end))
        if end >= start and (not kept or start >= kept[-1][1]):
            kept.append((start, end, new or ""))
    for edit in reversed(kept):
        anew += tree.edit(*edit)
    return before, tree.total, tree.characters[1], anew


def count_tokens(documents: DataFrame, vocabulary: bytes, edits: Callable[[str], list[Edit]] | str = "edits") -> DataFrame:
    """The documents with n_tokens, n_tokens_edited, n_chars_edited and n_chars_encoded.

    ``edits`` makes the edits (start, end, replacement) of a text, or names a column that holds an
    array of such structs. n_chars_encoded counts the characters that the edits made it encode
    again. A null text counts as empty, null edits as none; positions beyond the text are moved to its
    end; a null replacement deletes; repeated rows each get their result; columns named as the
    result's are replaced. One pass over whole texts without a shuffle; each document's tree lives while its
    row is handled.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        count = functools.partial(count_with, encoder(sent.value))

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            texts = batch.column("text").to_pylist()
            if callable(edits):
                lists = [edits(text or "") for text in texts]
            else:
                lists = [[tuple(e.values()) for e in row or () if e] for row in batch.column(edits).to_pylist()]
            rows = [counted(text, own, count) for text, own in zip(texts, lists, strict=True)]
            names = ("n_tokens", "n_tokens_edited", "n_chars_edited", "n_chars_encoded")
            return {name: [row[i] for row in rows] for i, name in enumerate(names)}

        return run

    ddl = "n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_encoded long"
    return add_columns(documents, ddl, make)


_NUMBERS = re.compile(r"[0-9][0-9.:-]{6,}")
_ADDRESSES = re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+")


def scrub_edits(text: str) -> list[Edit]:
    """Edits that replace long numbers and mail addresses by a placeholder."""
    edits = [(*m.span(), "[address]") for m in _ADDRESSES.finditer(text)] if "@" in text else []
    return edits + [(*m.span(), "[number]") for m in _NUMBERS.finditer(text)]
