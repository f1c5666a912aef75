"""N-gram Jaccard join: near duplicates by MinHash, with Bayesian pruning of candidates and exact checks.

1. Every text becomes a set of word n-grams; texts with equal sets are one class.
2. Classes that share a band of MinHash values are candidates. A candidate pair is compared
   value by value in small steps and dropped as soon as the posterior probability that its
   similarity reaches the threshold falls below a tolerance.
3. What is left falls into small clusters. Each cluster is compared as a whole inside tasks,
   large ones block against block: pruned again by Bayes, then verified on the whole sets.
   Tasks return a count of links for each class and the links of a spanning forest, never all pairs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tillbook.llm.common import map_batches, map_slices, words, written
from tillbook.llm.components import components
from tillbook.operators.reduction import reduced

#: Words of an n-gram, and similarity of a link.
WORDS, THRESHOLD = 5, 0.8
#: Bands and MinHash values in each: a pair at 0.8 shares none with probability 5e-8.
BANDS, ROWS = 32, 4
#: A pair is dropped when its chance to reach the threshold is less than this.
TOLERANCE = 1e-6
#: MinHash values compared between two looks at the posterior.
STEP = 16
#: Larger groups of candidates aren't paired but compared as a whole.
CROWD = 16
#: Classes of a cluster compared with one another in one task.
BLOCK = 128

_MULTIPLIERS = np.random.default_rng(20240229).integers(1, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that multiplying and taking the top bits acts as a random order."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The different n-grams of a text as sorted 64-bit hashes; all words if there are fewer, none without words."""
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = max(1, len(hashed) - size + 1)
    total = np.full(n, np.uint64(min(size, len(hashed))))
    for i in range(min(size, len(hashed))):
        total = _mixed(total * _MIX + hashed[i : i + n])
    return np.unique(total)


def min_hashes(own: np.ndarray) -> np.ndarray:
    """Top 32 bits of the least value of each of BANDS * ROWS orders of the set."""
    least = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 512):
        np.minimum(least, (own[start : start + 512, None] * _MULTIPLIERS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; bands never share one but by accident."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX
    for row in range(ROWS):
        keys = _mixed(keys ^ (least.reshape(BANDS, ROWS)[:, row] * _MIX + np.uint64(row)))
    return keys.view(np.int64)


@functools.cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """How many of the first STEP, 2 * STEP, ... values must agree for the pair to stay.

    The similarity has a uniform prior. Values are compared in 8 bits, so unequal ones agree by
    chance once in 256.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    agree = grid + (1 - grid) / 256
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(agree) + (n - m) * np.log1p(-agree)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                break
        out.append(m)
    return tuple(out)


def survivors(left: np.ndarray, right: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Positions of the row pairs of two arrays of 8-bit MinHash values that Bayes doesn't prune."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int64)
    for step, least in enumerate(least_matches(threshold, tolerance)):
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (left[alive, part] == right[alive, part]).sum(axis=1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _signed(documents: DataFrame, size: int, row: str | None = None) -> DataFrame:
    """(doc_id, body, class, sig, bands) of each document: class is a digest of its set, null without words.

    With ``row``, that column as bigint is there too, as row.
    """
    keys = {"doc_id": "doc_id"} | ({"row": row} if row else {})

    def make():
        def run(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {"class": [], "body": [], "sig": [], "bands": []}
            for text in batch.column("text").to_pylist():
                own = shingles(text, size)
                out["body"].append(hashlib.md5((text or "").encode("utf-8", "replace")).digest())
                if len(own):
                    least = min_hashes(own)
                    out["class"].append(hashlib.md5(own.tobytes()).digest())
                    out["sig"].append((least & np.uint64(255)).astype(np.uint8).tobytes())
                    out["bands"].append(band_keys(least))
                else:
                    for name in ("class", "sig", "bands"):
                        out[name].append(None)
            return {key: batch.column(key) for key in keys} | out

        return run

    rows = documents.select(*(F.col(f"`{c}`").cast("long").alias(key) for key, c in keys.items()), "text")
    types = ", ".join(f"{key} long" for key in keys)
    return map_slices(rows, f"{types}, body binary, class binary, sig binary, bands array<long>", make)


def _classes(signed: DataFrame) -> DataFrame:
    """One row for each class, with a number of its own, a document that holds its text, and its copies.

    If rows are numbered, first is the row of the least doc_id (null last), then text hash and number.
    """
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "body", "row") if "row" in signed.columns else None
    return (
        signed.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.min(F.struct("doc_id", "body")).alias("holder"),
            F.min("doc_id").alias("least_id"),
            F.count("*").alias("copies"),
            F.first("sig").alias("sig"),
            F.first("bands").alias("bands"),
            *([F.min(order).alias("first")] if order is not None else []),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )


def _candidate_links(classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """(a, b): links that hold candidates together. Pairs of small groups are pruned, a crowd is linked whole."""
    banded = classes.select("node", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    groups = written(groups, "groups")
    members = written(reduced(banded, groups, "band").join(groups, "band"), "members")
    crowds = members.where((F.col("n") > CROWD) & (F.col("least") < F.col("node")))
    crowds = crowds.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    lists = members.where(F.col("n") <= CROWD).groupBy("band").agg(F.array_sort(F.collect_list("node")).alias("all"))
    firsts = lists.select("all").distinct().select("all", F.posexplode("all").alias("at", "a"))
    pairs = firsts.select("a", F.explode(F.slice("all", F.col("at") + 2, CROWD)).alias("b")).distinct()
    sig = classes.select(F.col("node").alias("a"), F.col("sig").alias("sig_a"))
    pairs = pairs.join(sig, "a").join(sig.select(F.col("a").alias("b"), F.col("sig_a").alias("sig_b")), "b")

    def make():
        def rows(column: pa.Array) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)

        def run(batch: pa.RecordBatch) -> dict[str, list]:
            stay = survivors(rows(batch.column("sig_a")), rows(batch.column("sig_b")), threshold, tolerance)
            return {name: batch.column(name).take(pa.array(stay)) for name in ("a", "b")}

        return run

    return crowds.unionAll(map_slices(pairs, "a long, b long", make))


def _verified_block(
    rows: list[tuple], one_block: bool, size: int, threshold: float, tolerance: float
) -> Iterator[tuple[int, int, int]]:
    """(node, links, root) for the classes of one task: (node, side, copies, sig, text).

    Sides 0 and 1 are compared with each other, or the rows of one block among themselves.
    The root is the least node linked with it here, over any number of steps.
    """
    rows = list({row[0]: row for row in rows}.values())
    if one_block:
        left, right = np.triu_indices(len(rows), 1)
    else:
        sides = (np.array([i for i, r in enumerate(rows) if r[1] == side], np.int64) for side in (0, 1))
        left, right = (x.ravel() for x in np.meshgrid(*sides, indexing="ij"))
    sets = [shingles(r[4], size) for r in rows]
    sizes = np.array([len(s) for s in sets])
    near = np.minimum(sizes[left], sizes[right]) >= threshold * np.maximum(sizes[left], sizes[right]) - 1e-9
    left, right = left[near], right[near]
    sigs = np.frombuffer(b"".join(r[3] for r in rows), np.uint8).reshape(len(rows), -1)
    stay = [
        start + survivors(sigs[left[start : start + 4096]], sigs[right[start : start + 4096]], threshold, tolerance)
        for start in range(0, len(left), 4096)
    ]
    if not stay:
        return
    left, right = left[np.concatenate(stay)], right[np.concatenate(stay)]
    shared = _shared(sets, left, right)
    linked = shared >= threshold * (sizes[left] + sizes[right] - shared) - 1e-9
    root = list(range(len(rows)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, j in zip(left[linked].tolist(), right[linked].tolist(), strict=True):
        links[i] += rows[j][2]
        links[j] += rows[i][2]
        a, b = sorted((top(i), top(j)), key=lambda k: rows[k][0])
        root[b] = a
    for i, row in enumerate(rows):
        if links[i]:
            yield row[0], links[i], rows[top(i)][0]


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections: by a product of incidence matrices where many pairs are asked for, some n-grams at a time."""
    if len(left) < 4 * len(sets):
        return np.array(
            [len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(left, right, strict=True)], np.int64
        )
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    total = np.zeros((len(sets), len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1, 4096):
        part = slice(*np.searchsorted(column, (start, start + 4096)))
        held = np.zeros((len(sets), 4096), np.float32)
        held[row[part], column[part] - start] = 1
        total += held @ held.T
    return total[left, right].round().astype(np.int64)


def _verified(
    documents: DataFrame, classes: DataFrame, clusters: DataFrame, size: int, threshold: float, tolerance: float
) -> DataFrame:
    """(node, links, root, blocks) of the classes that have links; a class of a large cluster has several rows."""
    sizes = clusters.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = clusters.join(sizes, "component").join(classes.select("node", "holder", "copies", "sig"), "node")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the texts of holders only, one of each however often its row is repeated: folded before any shuffle
    wanted = written(dealt.select(F.col("holder.doc_id").alias("_wanted"), F.col("holder.body").alias("_body")).distinct(), "wanted")
    body = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    texts = documents.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), body.alias("_own_body"))
    found = reduced(texts, wanted.withColumnRenamed("_body", "_own_body"), "_own_body")
    # an inner join, as wanted rows are distinct and a semi join would be moved below the filter
    found = found.join(wanted, F.col("_wanted").eqNullSafe(F.col("_id")) & (F.col("_body") == F.col("_own_body")))
    found = written(found.groupBy("_id", "_own_body").agg(F.first("_text").alias("_text")), "texts")
    dealt = dealt.join(found, F.col("holder.doc_id").eqNullSafe(F.col("_id")) & (F.col("holder.body") == F.col("_own_body")))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", partner).select(
        "component",
        F.least("block", "other").alias("low"),
        F.greatest("block", "other").alias("high"),
        "node",
        (F.col("block") > F.col("other")).cast("int").alias("side"),
        "copies",
        "sig",
        F.col("_text").alias("text"),
        "blocks",
    )
    keys = ["component", "low", "high"]
    schema = StructType.fromDDL("node long, links long, root long, blocks int")

    def run(batches):
        arrow = to_arrow_schema(schema)
        key, rows, out = None, [], []

        def close():
            out.extend((*found, key[3]) for found in _verified_block(rows, key[1] == key[2], size, threshold, tolerance))

        def batch_of(found):
            columns = zip(*found, strict=True) if found else ([] for _ in arrow)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*keys, "blocks", "node", "side", "copies", "sig", "text")]
            for row in zip(*columns, strict=True):
                if row[:4] != key:
                    if len(rows) > 1:
                        close()
                    key, rows = row[:4], []
                rows.append(row[4:])
            yield batch_of(out)
            out.clear()
        if len(rows) > 1:
            close()
        yield batch_of(out)

    return map_batches(dealt.repartition(*keys).sortWithinPartitions(*keys), run, schema)


def _linked(
    signed: DataFrame, documents: DataFrame, size: int, threshold: float, tolerance: float
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All classes, (node, component) and (node, links) of those that have links to others."""
    classes = written(_classes(signed), "classes")
    clusters = written(components(_candidate_links(classes, threshold, tolerance)), "clusters")
    linked = written(_verified(documents, classes, clusters, size, threshold, tolerance), "linked")
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    whole = linked.where("blocks = 1").select("node", F.col("root").alias("component"))
    parts = components(linked.where("blocks > 1").select("root", "node"))
    return classes, whole.unionAll(parts), links


def first_of_groups(
    documents: DataFrame, row: str, size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """(row): the number, from the column ``row``, of one row of each group that links connect.

    It is the row of the least doc_id; rows without one come last. Among rows of one doc_id, which may be
    repeated or hold different texts, the text's hash and then the number decide. Copies and
    repeated rows are of one group; a row without words has no links and is a group of its own.
    Classes and groups are folded before their shuffles.
    """
    signed = written(_signed(documents, size, row), "signed")
    classes, component, _ = _linked(signed, documents, size, threshold, tolerance)
    groups = classes.select("node", "first").join(component, "node", "left")
    firsts = groups.groupBy(F.coalesce("component", "node")).agg(F.min("first").alias("first")).select("first.row")
    return firsts.unionAll(signed.where(F.col("class").isNull()).select("row"))


def near_duplicates(
    documents: DataFrame, size: int = WORDS, threshold: float = THRESHOLD, tolerance: float = TOLERANCE
) -> DataFrame:
    """(doc_id, class_id, n_links) of each document.

    n_links counts the other documents whose sets of ``size``-word n-grams have a Jaccard similarity of
    ``threshold`` or more, copies included; class_id is the least doc_id of the documents that
    links connect, directly or over others. A document without words has no links and is its own class.
    A text of fewer words has one n-gram. Repeated rows count as copies and each get their
    row; documents without doc_id take part, their class_id is null if no other of the class has one.
    Other columns are not looked at.

    Copies are one class from the start and folded before the shuffle; a class that holds a
    third of all rows costs as much as any other. Links between different texts are counted
    inside tasks, so a group of n near copies needs n * n / BLOCK**2 block pairs and not n * n rows.
    """
    signed = written(_signed(documents, size), "signed")
    classes, component, links = _linked(signed, documents, size, threshold, tolerance)
    named = component.join(classes.select("node", "least_id"), "node")
    names = named.groupBy("component").agg(F.min("least_id").alias("class_id"))
    of_node = component.join(names, "component").join(links, "node").select("node", "class_id", "links")
    known = classes.join(of_node, "node", "left").where("links IS NOT NULL OR copies > 1").select(
        F.col("class").alias("_class"),
        F.coalesce("class_id", "least_id").alias("_class_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"),
    )
    known = written(known, "known")
    return signed.join(known, F.col("class") == F.col("_class"), "left").select(
        "doc_id",
        F.when(F.col("_class").isNull(), F.col("doc_id")).otherwise(F.col("_class_id")).alias("class_id"),
        F.coalesce("_links", F.lit(0)).alias("n_links"),
    )
