"""Near duplicates by one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

1. The shingles of a text are hashed once; the hash splits them into bins and the least hash of each bin
   is its value. An empty bin takes the value of the first filled bin in an order of its own.
2. Texts with equal sets are one class. Classes that share a band of bins meet in a bucket, where each is
   paired with the least member only: a star, so a bucket of n members gives n - 1 candidates.
3. Candidates that the sketches don't rule out are confirmed on whole sets; links make components.
4. A star says nothing about two members that both differ from its centre. Buckets whose other members
   are still of several components are compared sketch by sketch inside tasks, which return a spanning
   forest of the pairs that may be links. Forests are confirmed like stars; where a group of
   candidates is still of several components, it is compared on whole sets, block against block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tillbook.llm.common import map_groups, map_slices, written
from tillbook.llm.components import components
from tillbook.operators.reduction import reduced

#: Words of a shingle; a link has at least this many hundredths of the union in common.
WORDS, PERCENT = 4, 80
#: Bands and bins in each: a pair at 0.8 shares no band with probability 5e-9.
BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: Candidates are ruled out this many standard deviations below the agreement that a link expects.
DEVIATIONS = 7
#: Members of a star handled at once; up to so many classes of a bucket or group are one block, compared in one task.
STAR, BLOCK = 256, 256
#: Shingles that the sets of a block hold, about; pairs that a task keeps before it folds them.
HELD, PAIRS = 2**20, 2**18

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGES = np.array([(bin << 64) // BINS for bin in range(BINS)], np.uint64)
#: Column j: the order in which an empty bin j looks at the others.
_PROBES = np.random.default_rng(20240311).permuted(np.tile(np.arange(BINS), (BINS, 1)), axis=1).T


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values in an order that looks random."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_list(text: str | None) -> list[bytes]:
    """What stands between blanks, tabs and line ends, A-Z in lower case; UTF-8."""
    return [] if text is None else text.encode("utf-8", "replace").translate(_LOWER).split()


def shingle_set(text: str | None, size: int = WORDS) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes; one of all words if there are fewer, none without words."""
    found = word_list(text)
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    width = min(size, len(hashed))
    total = np.full(len(hashed) - width + 1, np.uint64(width))
    for i in range(width):
        total = _mixed(total * _MIX + hashed[i : i + len(total)])
    return np.unique(total)


def one_permutation(own: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a set that isn't empty, empty bins densified.

    Bins are equal ranges of hashes, so in a sorted set each bin's least hash is its first one.
    """
    first = np.searchsorted(own, _EDGES)
    filled = np.append(first[1:], len(own)) > first
    source = np.arange(BINS)
    empty = np.flatnonzero(~filled)
    for probes in (_PROBES[:12], _PROBES):
        seen = filled[probes[:, empty]]
        at = seen.argmax(axis=0)
        source[empty] = probes[at, empty]
        empty = empty[~seen[at, np.arange(len(empty))]]
        if not len(empty):
            break
    return own[first[source]]


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's bins."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in range(ROWS):
        keys = _mixed(keys * _MIX + values.reshape(BANDS, ROWS)[:, row])
    return keys.view(np.int64)


def _sketch(values: np.ndarray) -> bytes:
    """8 bits of each bin."""
    return (_mixed(values) & np.uint64(255)).astype(np.uint8).tobytes()


def least_agreement(percent: int) -> int:
    """Bins that must agree for a pair to stay a candidate."""
    p = percent / 100
    return int(BINS * p - DEVIATIONS * (BINS * p * (1 - p)) ** 0.5)


def _are_linked(shared: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * shared >= percent * (left + right - shared)


def _sketched(documents: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, text, n, class, sketch, bands): class is a digest of the set, null without words."""

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {name: [] for name in ("n", "class", "sketch", "bands")}
            for text in batch.column("text").to_pylist():
                own = shingle_set(text, size)
                values = one_permutation(own) if len(own) else None
                out["n"].append(len(own))
                out["class"].append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                out["sketch"].append(_sketch(values) if len(own) else None)
                out["bands"].append(band_keys(values) if len(own) else None)
            return {name: batch.column(name) for name in ("row", "doc_id", "text")} | out

        return run

    rows = documents.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    ddl = "row long, doc_id long, text string, n long, class binary, sketch binary, bands array<long>"
    return map_slices(rows, ddl, make)


def _buckets(classes: DataFrame) -> DataFrame:
    """(bucket, centre, node) of the buckets with several classes; of buckets with equal members, one."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    same = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("node").bitwiseAND(2**40 - 1)).alias("total"))
    groups = banded.groupBy("band").agg(same.alias("same"), F.min("node").alias("centre")).where("same.n > 1")
    chosen = groups.groupBy("same", "centre").agg(F.min("band").alias("band")).select("band", "centre")
    chosen = written(chosen, "buckets")
    members = reduced(banded, chosen, "band").join(chosen, "band")
    return members.select(F.col("band").alias("bucket"), "centre", "node")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that sketches and sizes of the sets don't rule out."""
    sides = [classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")) for c in "ab"]
    met = pairs.join(sides[0], "a").join(sides[1], "b")
    met = met.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    least = least_agreement(percent)

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            a, b = (np.frombuffer(b"".join(batch.column(f"s_{c}").to_pylist()), np.uint8).reshape(-1, BINS) for c in "ab")
            stay = pa.array(np.flatnonzero((a == b).sum(axis=1) >= least))
            return {c: batch.column(c).take(stay) for c in "ab"}

        return run

    return map_slices(met, "a long, b long", make)


class _Texts:
    """The texts of classes, each read from the row that stands for its class."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.held = rows.select("row", "text"), classes.select("node", F.col("holder").alias("row"))

    def beside(self, frame: DataFrame) -> DataFrame:
        """The frame with the text of each node. Only texts asked for leave their tasks: which they are is
        written first, and a filter of their rows is broadcast."""
        wanted = written(frame.select("node").distinct().join(self.held, "node"), "wanted")
        return frame.join(reduced(self.rows, wanted, "row").join(wanted, "row").select("node", "text"), "node")


def _confirmed(pairs: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links. Each ``a`` meets its partners in slices of about STAR; only its own set is held."""
    slices = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("slices"))
    slices = written(slices, "stars")
    outer = pairs.join(slices, "a").select("a", F.pmod(F.xxhash64("b"), "slices").cast("int").alias("slice"), F.col("b").alias("node"))
    inner = slices.select("a", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("a").alias("node"))
    rows = texts.beside(outer.unionAll(inner))
    rows = rows.select("a", "slice", (F.col("node") != F.col("a")).alias("outer"), "node", "text")

    def compare(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        centre = None
        for outer, node, text in rows:
            own = shingle_set(text, size)
            if not outer:
                centre = own
            elif _are_linked(len(np.intersect1d(centre, own, assume_unique=True)), len(centre), len(own), percent):
                yield key[0], node

    return map_groups(rows, ["a", "slice"], ["outer"], ["node", "text"], "a long, b long", compare)


def _labels(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of all classes: the least node that links reach."""
    found = classes.select("node").join(components(links), "node", "left")
    return written(found.select("node", F.coalesce("component", "node").alias("label")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the different labels that pairs of nodes connect."""
    for end in "ab":
        pairs = pairs.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end)
    return pairs.where("label_a <> label_b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after more links: a graph of labels, which is smaller than that of nodes."""
    found = components(_apart(links, labels)).select(F.col("node").alias("label"), "component")
    found = labels.join(found, "label", "left")
    return written(found.select("node", F.coalesce("component", "label").alias("label")), "labels")


def _open(members: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The members, with their labels, of the groups that hold several labels."""
    labelled = written(members.join(labels, "node"), "members")
    several = labelled.groupBy(key).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"))
    several = written(several.where("low < high").select(key, "members"), "several")
    return labelled.join(several, key)


def _in_blocks(members: DataFrame, key: str, classes: DataFrame, shingles: int | None = None) -> DataFrame:
    """Each member once for every block of its group that its own block meets: (key, low, high, side, node, label, n, sketch).

    A group of m members has about sqrt(m / BLOCK) blocks, so copies and what a task holds grow with the root of m
    only. With ``shingles`` it has more, up to m / BLOCK, until a block's sets hold about so many. Members of
    the commonest label have blocks of their own if they fill one; those don't meet each other, as one label has no pairs to find.
    """
    known = members.join(classes.select("node", "n", "sketch"), "node")
    common = known.where(F.col("members") > BLOCK).groupBy(key, "label").agg(F.count("*").alias("k"), F.sum("n").alias("total"))
    common = common.groupBy(key).agg(F.max(F.struct("k", "label")).alias("most"), F.sum("total").alias("total"))
    common = written(common.select(key, "most.*", "total").withColumnRenamed("label", "main"), "common")
    most = F.ceil(F.col("members") / BLOCK)
    blocks = F.ceil(F.sqrt(F.col("members") / BLOCK))
    if shingles:
        blocks = F.least(most, F.greatest(blocks, F.ceil(F.col("total") / shingles)))
    size = F.col("members") / blocks
    whole = F.when(F.col("k") >= size, F.ceil(F.col("k") / size)).otherwise(0).cast("int")
    sizes = common.join(members.select(key, "members").distinct(), key)
    sizes = written(sizes.select(key, "main", "k", whole.alias("whole"), size.alias("size")), "sizes")
    rest = F.ceil((F.col("members") - F.when(F.col("whole") > 0, F.col("k")).otherwise(0)) / F.col("size")).cast("int")
    dealt = known.join(sizes, key, "left").withColumns({"whole": F.coalesce("whole", F.lit(0)), "rest": F.coalesce(rest, F.lit(1))})
    main = (F.col("whole") > 0) & (F.col("label") == F.col("main"))
    place = F.xxhash64("node")
    own = F.when(main, F.pmod(place, F.greatest("whole", F.lit(1)))).otherwise(F.col("whole") + F.pmod(place, "rest")).cast("int")
    others = F.sequence(F.when(main, F.col("whole")).otherwise(0), F.col("whole") + F.col("rest") - 1)
    dealt = dealt.select(key, "node", "label", "n", "sketch", own.alias("block"), others.alias("others"))
    return dealt.select("*", F.explode("others").alias("other")).select(
        key,
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        (F.col("block") > F.col("other")).alias("side"),
        "node",
        "label",
        "n",
        "sketch",
    )


def _unsettled(key: tuple, rows: list[tuple], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(left, right, agreement) of the pairs of a block pair with different labels that may be links, part by part.

    Rows are (side, node, label, n, sketch, ...); rows of one block meet one another.
    """
    least = least_agreement(percent)
    label, n = (np.array([r[i] for r in rows], np.int64) for i in (2, 3))
    sketch = np.frombuffer(b"".join(r[4] for r in rows), np.uint8).reshape(-1, BINS)
    side = np.array([r[0] for r in rows])
    one_block = key[1] == key[2]
    first, second = (np.arange(len(rows)),) * 2 if one_block else (np.flatnonzero(~side), np.flatnonzero(side))
    step = max(1, 16 * BLOCK // max(1, len(second)))
    for start in range(0, len(first), step):
        some = first[start : start + step]
        may = label[some, None] != label[None, second]
        may &= 100 * np.minimum(n[some, None], n[None, second]) >= percent * np.maximum(n[some, None], n[None, second])
        if one_block:
            may &= some[:, None] < second[None, :]
        i, j = np.nonzero(may)
        i, j = some[i], second[j]
        agree = (sketch[i] == sketch[j]).sum(axis=1)
        stay = agree >= least
        yield i[stay], j[stay], agree[stay]


class _Forest:
    """What pairs of positions connect, the labels of rows being connected already."""

    def __init__(self, rows: list[tuple]):
        self.labels = [r[2] for r in rows]
        self.root = {label: label for label in self.labels}
        self.rest = len(self.root) - 1

    def _top(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x

    def add(self, left: np.ndarray, right: np.ndarray) -> list[int]:
        """Which of the pairs, taken in their order, connect anew."""
        out = []
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
            if not self.rest:
                break
            a, b = self._top(self.labels[i]), self._top(self.labels[j])
            if a != b:
                self.root[b] = a
                self.rest -= 1
                out.append(k)
        return out


def _may_be_links(blocks: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, best agreement first, of the possible links of each block pair.

    A task folds the pairs it has met to their forest whenever they are more than PAIRS.
    """

    def compare(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = list(rows)
        pairs, met = np.empty((3, 0), np.int64), []

        def folded() -> np.ndarray:
            every = np.concatenate([pairs, *met], axis=1)
            every = every[:, np.argsort(-every[2], kind="stable")]
            return every[:, _Forest(held).add(every[0], every[1])]

        for part in _unsettled(key, held, percent):
            met.append(np.stack(part))
            if sum(m.shape[1] for m in met) > PAIRS:
                pairs, met = folded(), []
        for i, j in folded()[:2].T.tolist():
            yield held[i][1], held[j][1]

    columns = ["side", "node", "label", "n", "sketch"]
    return map_groups(blocks, ["bucket", "low", "high"], [], columns, "a long, b long", compare)


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets, one left set at a time."""
    out = np.zeros(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    starts = np.flatnonzero(np.diff(left[order], prepend=-1))
    for part in np.split(order, starts[1:]):
        own, others = sets[left[part[0]]], [sets[j] for j in right[part]]
        joined = np.concatenate(others)
        at = np.minimum(np.searchsorted(own, joined), len(own) - 1)
        out[part] = np.add.reduceat((own[at] == joined).astype(np.int64), np.cumsum([0] + [len(s) for s in others[:-1]]))
    return out


def _verified_blocks(blocks: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the links of each block pair, by whole sets."""

    def compare(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        held = list(rows)
        sets, forest = [shingle_set(r[5], size) for r in held], _Forest(held)
        for left, right, _ in _unsettled(key, held, percent):
            if len(left):
                sizes = np.array([len(s) for s in sets], np.int64)
                linked = _are_linked(_shared(sets, left, right), sizes[left], sizes[right], percent)
                left, right = left[linked], right[linked]
                yield from ((held[left[k]][1], held[right[k]][1]) for k in forest.add(left, right))

    columns = ["side", "node", "label", "n", "sketch", "text"]
    return map_groups(texts.beside(blocks), ["component", "low", "high"], [], columns, "a long, b long", compare)


def _class_labels(classes: DataFrame, texts: _Texts, size: int, percent: int) -> DataFrame:
    """(node, label) of all classes; classes with one label are connected by links."""
    buckets = written(_buckets(classes), "members")
    stars = buckets.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(_possible(stars, classes, percent), "pairs")
    links = written(_confirmed(stars, texts, size, percent), "links")
    labels = _labels(classes, links)
    rest = _open(buckets.where("node <> centre").select("bucket", "node"), labels, "bucket")
    pairs = written(_may_be_links(_in_blocks(rest, "bucket", classes), percent).distinct(), "pairs")
    if pairs.isEmpty():
        return labels
    labels = _merged(labels, written(_confirmed(pairs, texts, size, percent), "links"))
    if _apart(pairs, labels).isEmpty():
        return labels
    groups = _open(written(components(pairs), "groups"), labels, "component").where("members > 2")
    late = written(_verified_blocks(_in_blocks(groups, "component", classes, HELD), texts, size, percent), "links")
    return labels if late.isEmpty() else _merged(labels, late)


def deduplicated(documents: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    n_shingles counts the different ``size``-word shingles; a text of fewer words has one of all its words, a null,
    empty or blank one has none and is linked with nothing. Two documents are linked if their sets have
    ``percent`` hundredths of their union in common; component_id is the least doc_id that links reach, kept
    says whether that is the document's own. Repeated rows each get their row and share a component.
    Documents without doc_id take part and connect others; their component_id is null, and
    they are kept, only if no document of the component has an id. Other columns are not looked at.

    Equal sets are folded to one class before anything meets, so a group of copies costs one class. A bucket gives
    no more candidates than members; what a task returns of a block is a forest. Texts are sent
    to the confirmed pairs only, a star's centre once for STAR of its partners.
    """
    rows = written(_sketched(documents, size), "sketched")
    folded = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.min("row").alias("holder"), F.min("doc_id").alias("least_id"), F.first("n").alias("n"),
        F.first("sketch").alias("sketch"), F.first("bands").alias("bands"),
    )
    classes = written(folded.withColumn("node", F.monotonically_increasing_id()), "classes")
    labels = _class_labels(classes, _Texts(rows, classes), size, percent)
    named = written(classes.select("node", "class", "least_id").join(labels, "node"), "named")
    names = written(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "names")
    known = written(named.join(names, "label").select(F.col("class").alias("_class"), "component_id"), "known")
    found = rows.select("doc_id", "n", "class").join(known, F.col("class") == F.col("_class"), "left")
    own = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )
