"""Cross-tokenizer alignment: groups of tokens of two vocabularies that cover the same bytes.

A text is tokenised whole by both tokenizers. Where tokens of both end at one byte and the next token of both
begins with a blank stands an anchor; anchors split the document into windows of token ids, mostly words.
The alignment of a window depends on its ids alone, so it is worked out once and kept by its pair of id tuples.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import itertools
import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import map_slices, written
from tillbook.llm.tokencounts import PATTERN, ranks

BYTE_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
PIECE_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Alignments of windows that a task keeps; beyond, it forgets all and starts anew.
KEPT_WINDOWS = 300_000
#: Windows with more tokens than this on one side aren't kept.
KEPT_TOKENS = 64
#: Segments whose ids a tokenizer keeps; beyond, it forgets all and starts anew.
KEPT_SEGMENTS = 300_000
#: Texts are handled together up to this many characters.
CHARACTERS = 1_000_000
#: Fixed value: the mark of a blank in pieces.
MARK = "▁"
#: Fixed value: how a file says that texts are split by PATTERN.
_SPLITTER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
_BLANK_AFTER = regex.compile(f"[^{MARK}]{MARK}")
_SPACE_AFTER_BLANK = regex.compile(r" \s")
_CUT = regex.compile(r"(?<=[^ ])(?= \S)", regex.V1)
#: Characters that a normalising tokenizer would change.
PROBE = "a  b \t\uff21 \ufb01 e\u0301 \u00a0\u2126 "
_LONG_RUN = regex.compile(r"\s{1000}")
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: Characters that all versions of Unicode class alike, so that the pattern splits them as the tokenizer does.
_COMMON = regex.compile("[\\x00-\u052f\u1e00-\u1eff\u2000-\u2064\u20a0-\u20bf\u3000-\u3029\u4e00-\u9fa5\uac00-\ud7a3]*")
#: Of a text without tokens: n_a, n_b, n_groups, groups_sha256, links, times.
NO_TOKENS = (0, 0, 0, "", (), ())


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves, others as symbols from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _by_ranks(file: dict, table: dict[bytes, int]) -> tiktoken.Encoding | None:
    """The encoding by ranks that equals a file's byte-level tokenizer, if there is one."""
    model, symbol = file["model"], _byte_of_symbol()
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [table.get(bytes(map(symbol.__getitem__, "".join(m)))) for m in merges]
    plain = file["normalizer"] is None and file["pre_tokenizer"] == _SPLITTER and not model.get("ignore_merges")
    if not plain or ids != list(range(len(table) - len(merges), len(table))):
        return None
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


class _Segments:
    """Ids that sides give to the segments of texts, each encoded once while it is kept."""

    def __init__(self, *sides: Side):
        self.sides = sides
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = [(array("i"), array("q", [0]), bytearray()) for _ in self.sides]

    def _learn(self, segments: set[str]) -> None:
        if len(self.known) > KEPT_SEGMENTS:
            self.forget()
        missing = list(segments.difference(self.known))
        self.known.update(zip(missing, range(len(self.known), len(self.known) + len(missing)), strict=True))
        for side, (held, ends, spelled) in zip(self.sides, self.held, strict=True):
            found = side.apart(missing)
            held.extend(itertools.chain.from_iterable(found))
            ends.extend([ends[-1] + end for end in itertools.accumulate(map(len, found))])
            spelled.extend(map(side.spells, found, missing))

    def ids(self, segments: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each side the ids of all segments, how many each has, and whether they spell it and the blank before it."""
        self._learn(set(segments))
        numbers = np.fromiter(map(self.known.__getitem__, segments), np.int64, len(segments))
        for held, ends, spelled in self.held:
            ends = np.frombuffer(ends, np.int64)
            size = ends[numbers + 1] - ends[numbers]
            at = np.arange(size.sum()) + np.repeat(ends[numbers] - np.cumsum(size) + size, size)
            yield np.frombuffer(held, np.int32)[at], size, np.frombuffer(spelled, bool)[numbers]

    def encoded(self, texts: list[str], segments: list[list[str]]) -> list[list[tuple[np.ndarray, bool]]]:
        """For each side the ids of each text, whose segments are given, and whether they spell it after a blank.

        Texts that all sides may take apart are encoded by segments, others whole.
        """
        apart = [all(side.apart is not None and side.by_segments(text) for side in self.sides) for text in texts]
        chosen = list(itertools.compress(segments, apart))
        by_parts = [iter(()) for _ in self.sides]
        if chosen:
            stops = np.cumsum(list(map(len, chosen)))
            for k, (ids, size, spelled) in enumerate(self.ids(list(itertools.chain.from_iterable(chosen)))):
                parts = np.split(ids, np.cumsum(size)[stops[:-1] - 1])
                by_parts[k] = zip(parts, np.logical_and.reduceat(spelled, np.append(0, stops[:-1])).tolist(), strict=True)
        return [
            [next(own) if chosen else side.at_once(text) for text, chosen in zip(texts, apart, strict=True)]
            for side, own in zip(self.sides, by_parts, strict=True)
        ]


def segments_of(text: str) -> list[str]:
    """Parts of a text that both tokenizers encode for themselves, without the blank before each.

    They end before a single blank that stands between other characters: no piece of B holds a blank after
    another character, and the split of A ends a piece there whatever stands around.
    """
    parts = text.split(" ")
    return parts if not _SPACE_AFTER_BLANK.search(" " + text + " ") else [part[1:] for part in _CUT.split(" " + text)]


class Side:
    """A tokenizer with the bytes of its tokens, their lengths, and which begin with a blank."""

    def __init__(
        self, bytes_of: list[bytes], apart: Callable[[list[str]], list[list[int]]] | None, by_segments: Callable[[str], bool], whole: Callable[[str], list[int]]
    ):
        self.bytes_of, self.apart, self.by_segments, self.whole = bytes_of, apart, by_segments, whole
        self.length = np.array([len(b) for b in bytes_of], np.int64)
        self.blank = np.array([b.startswith(b" ") for b in bytes_of])

    def spells(self, ids: list[int], text: str) -> bool:
        """Whether the ids are those bytes of a blank and the text."""
        return b"".join(map(self.bytes_of.__getitem__, ids)) == b" " + text.encode("utf-8", "replace")

    def at_once(self, text: str) -> tuple[np.ndarray, bool]:
        ids = self.whole(text)
        return np.array(ids, np.int32), self.spells(ids, text)

    def encode(self, texts: list[str], segments: list[list[str]]) -> list[np.ndarray]:
        """The ids of each text, whose segments are given."""
        return [ids for ids, _ in _Segments(self).encoded(texts, segments)[0]]

    @classmethod
    def byte_level(cls, content: bytes) -> Side:
        """Given a blank before the text.

        Where the file lists its merges in the order of their ids, ids are ranks and a text of common characters is
        encoded by ranks, which gives the same tokens in less time; any other text and file by the file's own library.
        """
        model = tokenizers.Tokenizer.from_str(content.decode())
        model.encode_special_tokens = True
        symbol = _byte_of_symbol()
        special = {token.content for token in model.get_added_tokens_decoder().values()}
        entries = [model.id_to_token(i) for i in range(model.get_vocab_size())]
        decoded = [e.encode() if e in special else bytes(map(symbol.__getitem__, e)) for e in entries]
        fast = _by_ranks(json.loads(content), {b: i for i, b in enumerate(decoded) if entries[i] not in special})
        apart = (lambda segments: [fast.encode_ordinary(" " + s) for s in segments]) if fast else None

        def by_segments(text: str) -> bool:
            return bool(_COMMON.fullmatch(text)) and not _LONG_RUN.search(text)

        return cls(decoded, apart, by_segments, lambda text: model.encode(" " + text, add_special_tokens=False).ids)

    @classmethod
    def pieces(cls, content: bytes) -> Side:
        """Given the text, as the tokenizer adds the blank itself; by segments, if no piece reaches across them."""
        model = sentencepiece.SentencePieceProcessor(model_proto=content)

        def decoded(i: int) -> bytes:
            piece = model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace(MARK, " ").encode()

        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        unchanged = b"".join(map(decoded, model.encode(PROBE))) == b" " + PROBE.encode()
        apart = unchanged and not any(map(_BLANK_AFTER.search, pieces))
        bytes_of = [decoded(i) for i in range(model.get_piece_size())]
        by_parts = (lambda segments: model.encode(segments, num_threads=1)) if apart else None
        return cls(bytes_of, by_parts, lambda text: MARK not in text, model.encode)


class Windows:
    """Alignments of windows by their two id tuples."""

    def __init__(self, a: Side, b: Side):
        self.a, self.b = a, b
        self.segments = _Segments(a, b)
        #: An id as it is written within a group, and as the last of its side.
        self.names = [f"{i}{mark}" for side, last in ((a, "|"), (b, ";")) for i in range(len(side.bytes_of)) for mark in (",", last)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[tuple[bytes, bytes], int] = {}
        self.texts: list[str] = []
        self.groups, self.starts, self.links = array("q"), array("q", [0]), array("q")

    def _learn(self, keys: list[tuple[bytes, bytes]]) -> None:
        """Align windows and number them in this order; their tokens are handled as one stretch of bytes.

        A group ends wherever tokens of both end, so also at the end of each window.
        """
        a, b = (np.frombuffer(b"".join(own), np.int32).astype(np.int64) for own in zip(*keys, strict=True))
        sizes = [np.array(list(map(len, own))) // 4 for own in zip(*keys, strict=True)]
        ends = [np.cumsum(side.length[ids]) for side, ids in ((self.a, a), (self.b, b))]
        marked = np.zeros((2, int(ends[0][-1]) + 1), bool)
        for own, end in zip(marked, ends, strict=True):
            own[end] = True
        shared = marked[0] & marked[1]
        last = [shared[end] for end in ends]
        group = [np.cumsum(own) - own for own in last]
        count = [np.bincount(own) for own in group]
        start = [np.cumsum(own) - own for own in count]
        pairs = count[0] * count[1]
        of = np.repeat(np.arange(len(pairs)), pairs)
        place = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        across = count[1][of]
        left, right = a[start[0][of] + place // across], b[start[1][of] + place % across]
        self.links.frombytes((left * len(self.b.bytes_of) + right).tobytes())
        # the tokens of a group of A, then of B, each as the number of its name
        named = np.empty(len(a) + len(b), np.int64)
        named[np.arange(len(a)) + start[1][group[0]]] = a * 2 + last[0]
        named[np.arange(len(b)) + (start[0] + count[0])[group[1]]] = (b + len(self.a.bytes_of)) * 2 + last[1]
        stops = np.cumsum(sizes[0])
        until = np.cumsum(last[0])[stops - 1]
        self.groups.frombytes(np.diff(until, prepend=0).astype(np.int64).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(pairs)[until - 1]).astype(np.int64).tobytes())
        written_as, begin = list(map(self.names.__getitem__, named.tolist())), 0
        for stop in (stops + np.cumsum(sizes[1])).tolist():
            self.texts.append("".join(written_as[begin:stop]))
            begin = stop

    def _look_up(self, keys: list[tuple[bytes, bytes]]) -> np.ndarray:
        """The numbers of windows; those not known are aligned together."""
        found = list(map(self.known.get, keys))
        missing = dict.fromkeys(key for key, number in zip(keys, found, strict=True) if number is None)
        if not missing:
            return np.array(found)
        new = dict(zip(missing, range(len(self.texts), len(self.texts) + len(missing)), strict=True))
        self._learn(list(new))
        longest = 4 * KEPT_TOKENS
        self.known.update((key, number) for key, number in new.items() if len(key[0]) <= longest and len(key[1]) <= longest)
        return np.array([new[key] if number is None else number for key, number in zip(keys, found, strict=True)])

    def _numbers(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows between anchors of a stretch of bytes, and where they end.

        Each window gets a hash; one of each hash is looked up, and all are compared with it id by id.
        """
        ends = [np.cumsum(side.length[ids]) for side, ids in ((self.a, a), (self.b, b))]
        # the ends before a token that begins with a blank; no token is empty, so ends differ
        before = [end[:-1][side.blank[ids[1:]]] for end, side, ids in zip(ends, (self.a, self.b), (a, b), strict=True)]
        marked = np.zeros(int(ends[0][-1]) + 1, bool)
        marked[before[0]] = True
        anchors = np.append(before[1][marked[before[1]]], ends[0][-1])
        stops = [np.searchsorted(end, anchors, side="right") for end in ends]
        starts = [np.append(0, stop[:-1]) for stop in stops]
        sizes = [stop - start for stop, start in zip(stops, starts, strict=True)]
        hashed = np.zeros(len(anchors), np.uint64)
        places = []
        for k, ids in enumerate((a, b)):
            place = np.arange(len(ids)) - np.repeat(starts[k], sizes[k])
            mixed = (ids.astype(np.uint64) + np.uint64(1)) * _MIX ^ (place * 2 + k + 1).astype(np.uint64) * _TURN
            hashed += np.add.reduceat((mixed ^ (mixed >> np.uint64(31))) * _MIX, starts[k])
            places.append(place)
        _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
        shown = first[which]
        same = all(np.array_equal(size, size[shown]) for size in sizes)
        for start, size, ids, place in zip(starts, sizes, (a, b), places, strict=True):
            same = same and np.array_equal(ids, ids[np.repeat(start[shown], size) + place])
        if not same:  # two windows share a hash
            first = which = np.arange(len(anchors))
        raw_a, raw_b = a.tobytes(), b.tobytes()
        edges = ((4 * x[first]).tolist() for x in (starts[0], stops[0], starts[1], stops[1]))
        keys = [(raw_a[i:j], raw_b[k:m]) for i, j, k, m in zip(*edges, strict=True)]
        return self._look_up(keys)[which], anchors

    def align(self, texts: list[str | None]) -> list[tuple]:
        """``_aligned`` without collections: nothing here refers to itself, and each would walk through all that is kept."""
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._aligned(texts)
        finally:
            if collects:
                gc.enable()

    def _aligned(self, texts: list[str | None]) -> list[tuple]:
        """Tokens of both, groups, their digest, the different links and how often each occurs, of each text.

        Tokens of all texts that both spell again are one stretch of bytes. As each begins with a blank, it begins a window.
        """
        if len(self.texts) > KEPT_WINDOWS:
            self.forget()
        out: list[tuple] = [NO_TOKENS] * len(texts)
        rows = []
        places = [at for at, text in enumerate(texts) if text]
        full = [texts[at] for at in places]
        segments = list(map(segments_of, full))
        for at, (a, spelled_a), (b, spelled_b) in zip(places, *self.segments.encoded(full, segments), strict=True):
            if spelled_a and spelled_b:
                rows.append((at, a, b))
        if not rows:
            return out
        numbers, ends = self._numbers(*(np.concatenate(x) for x in list(zip(*rows, strict=True))[1:]))
        spans = [self.a.length[row[1]].sum() for row in rows]
        stops = np.searchsorted(ends, np.cumsum(spans), side="right")
        owner = np.repeat(np.arange(len(rows)), np.diff(stops, prepend=0))
        starts = np.frombuffer(self.starts, np.int64)
        size = starts[numbers + 1] - starts[numbers]
        at = np.arange(size.sum()) + np.repeat(starts[numbers] - np.cumsum(size) + size, size)
        # a document's link is one integer
        links_of_one = len(self.a.bytes_of) * len(self.b.bytes_of)
        key = np.repeat(owner, size) * links_of_one + np.frombuffer(self.links, np.int64)[at]
        key, times = np.unique(key, return_counts=True)
        edges = np.searchsorted(key, np.arange(len(rows) + 1) * links_of_one)
        left, right = np.divmod(key % links_of_one, len(self.b.bytes_of))
        link = left << 32 | right
        groups = np.bincount(owner, np.frombuffer(self.groups, np.int64)[numbers], len(rows)).astype(np.int64).tolist()
        held, begin = list(map(self.texts.__getitem__, numbers.tolist())), 0
        for k, ((row, a, b), stop) in enumerate(zip(rows, stops.tolist(), strict=True)):
            digest = hashlib.sha256("".join(held[begin:stop])[:-1].encode()).hexdigest()
            part = slice(edges[k], edges[k + 1])
            out[row] = (len(a), len(b), groups[k], digest, link[part], times[part])
            begin = stop
        return out


@functools.lru_cache(2)
def _sides(a: bytes, b: bytes) -> tuple[Side, Side]:
    return Side.byte_level(a), Side.pieces(b)


def _aligned(documents: DataFrame, a: bytes, b: bytes) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, groups_sha256, links, times): links are A id << 32 | B id, each once."""
    sent = documents.sparkSession.sparkContext.broadcast((a, b))

    def make():
        windows = Windows(*_sides(*sent.value))

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            done, texts, held = [], [], 0
            for value in batch.column("text"):
                texts.append(value.as_py())
                held += len(texts[-1] or "")
                if held > CHARACTERS:
                    done += windows.align(texts)
                    texts, held = [], 0
            done += windows.align(texts)
            names = ("n_a", "n_b", "n_groups", "groups_sha256", "links", "times")
            return {c: batch.column(c) for c in ("row", "doc_id")} | {c: [d[i] for d in done] for i, c in enumerate(names)}

        return run

    ddl = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>"
    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return map_slices(rows, ddl, make)


def vocabularies(spark, byte_path: str = BYTE_VOCABULARY, piece_path: str = PIECE_VOCABULARY) -> tuple[bytes, bytes]:
    """The two vocabulary files, read by Spark; their size is checked."""
    return ranks(spark, byte_path), ranks(spark, piece_path)


def align_tokenizers(documents: DataFrame, byte_vocabulary: bytes, piece_vocabulary: bytes) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document.

    A is the byte-level tokenizer, given a blank and the text; B the one of pieces, which adds the blank itself. Names of
    special tokens inside a text are plain text. Groups are cut wherever tokens of both end; each A token of a group is
    linked with each B token of it. The count of a pair of ids is the number of documents that hold it
    linked; n_best counts a document's links whose count is the highest of their A id, ties included, count_sum adds
    the counts of all its links. groups_sha256 is the digest of ``a1,a2|b1;a3|b2,b3``.

    Null and empty texts, and those that the tokens of A or B don't spell again byte by byte, have no tokens:
    zeros and an empty groups_sha256. Repeated rows are documents of their own and each get their row. Other columns are
    not looked at.

    Texts are read once and not shuffled. A document carries its different links with how often each
    occurs; counts are folded before their shuffle and are at most as many as pairs of ids. A link that
    nearly every document holds meets its count by broadcast if the table of counts is small, else by a join of two
    written tables that the adaptive skew join splits.
    """
    aligned = written(_aligned(documents, byte_vocabulary, piece_vocabulary), "aligned")
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    best = counts.groupBy(F.shiftright("link", 32).alias("a")).agg(F.max("n").alias("most"))
    judged = counts.join(best, F.shiftright(counts["link"], 32) == F.col("a")).select("link", "n", (F.col("n") == F.col("most")).alias("best"))
    judged = written(judged, "judged")
    held = aligned.select("row", F.explode(F.arrays_zip("links", "times")).alias("x")).select("row", F.col("x.links").alias("link"), F.col("x.times").alias("times"))
    sums = held.join(judged, "link").groupBy("row").agg(
        F.sum("times").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )
    found = aligned.drop("links", "times").join(written(sums, "sums"), "row", "left")
    zero = F.lit(0).cast("long")
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", *(F.coalesce(c, zero).alias(c) for c in ("n_links", "n_best", "count_sum")), "groups_sha256"
    )
