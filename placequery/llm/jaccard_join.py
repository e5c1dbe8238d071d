"""Exact N-gram Jaccard join in metric space.

Jaccard distance is a metric, but unrelated texts all lie at distance near 1 of each other, so
Voronoi regions of whole texts as pivots cannot part them: every window would hold every text.
The first regions therefore have single shingles as pivots. A text lies at 1 - 1/n of each of
its n shingles and at 1 of all others; among its equally near pivots the first in a common order
is its own, and the window of pivots a text within the radius may own instead is its first
n - ceil(t n) + 1 shingles, to which it is replicated. The order is by falling rarity, as far as
counts inside chunks of texts tell, and then by hash. It only decides where texts meet, never
whether they link. Two texts need to meet at the first pivot that both have; what they can share
from there on bounds their similarity, so the places of the pivot settle most pairs.

Inside the regions distances are taken between images of the sets: counts of their shingles in
256 classes. The L1 distance of two images is a metric and never above the symmetric difference
of the sets, which for linked sets of n and m shingles is at most (1 - t) / (1 + t) (n + m).
Pairs within the bound are compared exactly, on the sets. In a small region every pair is
measured. In a crowded one texts become pivots and all others get their distance to them; only
texts of different components meet, inside the triangle window of their two distances to the
pivot, and large regions are first dealt out to the nearest of new pivots, with those within twice
the bound of the border replicated to the others, and so on recursively until a region is small.
Crowds are settled in rounds: in each, what lies within the bound counts as linked for the rest of
the round, so that a crowd hands on about as many pairs as it has texts; those are compared on the
sets, and the next round goes on with the components that this gave.

Nodes are distinct shingle sets, so exact copies cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import Memo, discard, held, stored, whole, with_maybe
from .components import components

# Count in a chunk of texts from which a shingle comes later in the order, and shingles of a chunk.
LEAST_HOT, CHUNK = 2, 1 << 21
# Shingles that can come late: a bound on what is broadcast (9 bytes each). The rest keep their place.
HOT_SHINGLES = 1 << 20
# Texts of a region up to which all its pairs are measured.
CROWD = 16
# Open pairs of a region up to which it is compared outright, pivots of a larger one, levels of regions.
SMALL_REGION, NEW_PIVOTS, LEVELS = 1 << 16, 8, 4
# Rounds over the crowds, the last of which hands on every pair that is left.
ROUNDS = 5
# Pivots are looked up as pieces of 2 ** PIECE_BITS by their first bits; the next 32 bits tell those of a piece apart.
PIECE_BITS = 8
# Characters of text whose words are held at a time.
GROUP_CHARS = 1 << 20
# Classes of an image; counts above 255 are kept as 255, which lets distances only shrink.
CLASSES = 256

_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: Iterable[str | None], width: int, memo: Memo) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of each text.

    A-Z are lower-cased; words are runs without ASCII white space. A text with fewer words is one
    shingle, one without words has none. The words of about ``GROUP_CHARS`` characters are held at a time.
    """
    out, group, chars = [], [], 0
    for t in texts:
        group.append(t)
        chars += len(t) if t else 0
        if chars >= GROUP_CHARS:
            out += _shingles_of(group, width, memo)
            group, chars = [], 0
    return out + _shingles_of(group, width, memo)


def _shingles_of(texts: list[str | None], width: int, memo: Memo) -> list[np.ndarray]:
    coded = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in coded]
    flat = np.fromiter(map(memo.__getitem__, chain.from_iterable(coded)), np.uint64, sum(sizes))
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(flat) - width + 1, 0), np.uint64)
        for k in range(width):
            rolled = _mixed(rolled * _STEP + flat[k : k + len(rolled)] + np.uint64(k))
        out, at = [], 0
        for n in sizes:
            if n >= width:
                out.append(np.unique(rolled[at : at + n - width + 1]))
            elif n:
                one = np.full(1, n, np.uint64)
                for h in flat[at : at + n]:
                    one = _mixed(one * _STEP + h)
                out.append(one)
            else:
                out.append(np.empty(0, np.uint64))
            at += n
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_memo() -> Memo:
    """Hashes of words, kept by the worker."""
    return held("jaccard_join", "words", lambda: Memo(xxhash.xxh3_64_intdigest))


def _texts(column: pa.Array) -> Iterator[str | None]:
    return (t.as_py() for t in column)


def _node_ids(sets: list[np.ndarray]) -> np.ndarray:
    """Hash of each set."""
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)])
    flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def image(found: np.ndarray) -> bytes:
    """Shingles of a set in each class (the first byte of their hash)."""
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.int64), minlength=CLASSES), 255).astype(np.uint8).tobytes()


@F.arrow_udf(LongType())
def _image_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    both = [np.frombuffer(b"".join(v.as_py() for v in x), np.uint8).reshape(-1, CLASSES).astype(np.int16) for x in (a, b)]
    return pa.array(np.abs(both[0] - both[1]).sum(axis=1, dtype=np.int64))


def prefix_size(n: int, percent: int) -> int:
    """Shingles of which two linked sets share at least one, in any common order."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _hot(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that come several times in some chunk of texts, the most frequent HOT_SHINGLES of them, sorted, and how late they come.

    A shingle of D texts among c chunks is counted somewhere once D is about the root of 2 c, however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, chunk, size = word_memo(), [], 0

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(chunk), return_counts=True)
            hot = n >= LEAST_HOT
            return pa.RecordBatch.from_pydict({"h": values[hot].view(np.int64), "n": n[hot].astype(np.int64)})

        for batch in batches:
            for found in shingle_sets(_texts(batch.column(0)), width, memo):
                chunk.append(found)
                size += len(found)
                if size >= CHUNK:
                    yield counted()
                    chunk, size = [], 0
        if chunk:
            yield counted()

    counted = docs.select(whole(text).alias("_text")).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counted = stored(counted)
    hot = counted
    if counted.count() > HOT_SHINGLES:
        hot = counted.orderBy(F.desc("n"), "h").limit(HOT_SHINGLES)
    found = hot.toArrow()
    discard(counted)
    hashes, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], np.log2(n[order]).astype(np.uint8)


def _nodes(docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """doc, n, node (hash of the set), image and the pivots of the window of every document, in the common order."""
    hot = docs.sparkSession.sparkContext.broadcast(_hot(docs, text, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, (late, rank) = word_memo(), hot.value
        for batch in batches:
            sets, windows = shingle_sets(_texts(batch.column(1)), width, memo), []
            for found in sets:
                k = prefix_size(len(found), percent)
                if len(late) and k:
                    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
                    place = np.where(late[at] == found, rank[at], np.uint8(0))
                    if place.any():
                        found = found[np.argsort(place, kind="stable")]
                windows.append(found[:k])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in sets], pa.int64()), pa.array(_node_ids(sets)), pa.array(map(image, sets), pa.binary()), _lists(windows)],
                ["doc", "n", "node", "image", "pivots"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc"), whole(text).alias("_text"))
    return stored(rows.mapInArrow(run, "doc bigint, n bigint, node bigint, image binary, pivots array<bigint>"))


def _again(nodes: DataFrame) -> DataFrame:
    """First bits (key) of the pivots of more than one place, and few others; four bytes of each place are shuffled."""
    low = 32

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.sort(batch.column(0).flatten().to_numpy().view(np.uint64) >> np.uint64(64 - low - PIECE_BITS))
            parts = np.split(found.astype(np.uint32), np.searchsorted(found, np.arange(1, 1 << PIECE_BITS, dtype=np.uint64) << np.uint64(low)))
            some = [k for k, part in enumerate(parts) if len(part)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].tobytes() for k in some], pa.binary())], ["piece", "found"])

    def again(key: tuple, rows: pa.Table) -> pa.Table:
        found = np.sort(np.concatenate([np.frombuffer(v.as_py(), np.uint32) for v in rows.column("found")]))
        twice = np.unique(found[1:][found[1:] == found[:-1]])
        return pa.table({"key": pa.array(twice.astype(np.int64) | key[0].as_py() << low)})

    return nodes.select("pivots").mapInArrow(pieces, "piece int, found binary").groupBy("piece").applyInArrow(again, "key bigint")


def _members(nodes: DataFrame) -> DataFrame:
    """r (pivot), x (node), n, at (place of the pivot in the order of x) and k (texts of the region), of regions of two texts or more."""
    places = nodes.where(F.col("n") > 0).select("node", "n", F.posexplode("pivots").alias("at", "pivot"))
    first = F.shiftrightunsigned("pivot", 64 - 32 - PIECE_BITS)
    likely = with_maybe(places, first, _again(nodes)).where("_maybe")
    rows = likely.select(F.col("pivot").alias("r"), F.col("node").alias("x"), "n", "at").repartition("r").dropDuplicates(["r", "x"])
    return stored(rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("r"))).where(F.col("k") > 1))


def _can_link(a: tuple, b: tuple, percent: int) -> np.ndarray:
    """Whether texts of (n, at) can link if no shingle before their places is common to both; sizes of a ratio below t cannot."""
    return (100 + percent) * np.minimum(a[0] - a[1], b[0] - b[1]) >= percent * (a[0] + b[0])


def _sparse_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (p, x) of small regions that can link by sizes and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches):
            r, x, n, at = (c.to_numpy() for c in columns)
            ends = np.searchsorted(r, r, "right")
            after = ends - np.arange(len(r)) - 1
            one = np.repeat(np.arange(len(r)), after)
            two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(after) - after, after)
            can = _can_link((n[one], at[one]), (n[two], at[two]), percent)
            one, two = x[one[can]], x[two[can]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["p", "x"])

    rows = members.where(F.col("k") <= CROWD).select("r", "x", F.col("n").cast("long"), F.col("at").cast("long"))
    return rows.repartition("r").sortWithinPartitions("r").mapInArrow(run, "p bigint, x bigint").distinct()


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of rows sorted by the first, cut where it changes: no run of equal values is parted."""
    rest = []
    for batch in batches:
        if not batch.num_rows:
            continue
        first = batch.column(0).to_numpy()
        last = int(np.searchsorted(first, first[-1]))
        if rest and first[0] != rest[-1].column(0)[0].as_py():
            yield _joined(rest)
            rest = []
        if last:
            yield _joined([*rest, batch.slice(0, last)])
            rest = []
        rest.append(batch.slice(last))
    if rest:
        yield _joined(rest)


def _joined(batches: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([b.column(j) for b in batches]) for j in range(batches[0].num_columns)]


class _Crowd:
    """One region in memory: which pairs of its texts are to be compared on the sets."""

    # Images that are measured at a time.
    STRIDE = 4096

    def __init__(self, node: np.ndarray, component: np.ndarray, n: np.ndarray, at: np.ndarray, images: np.ndarray, percent: int, step: int, every: bool):
        self.node, self.n, self.at, self.images, self.percent, self.every = node, n, at, images, percent, every
        self.label = np.unique(component, return_inverse=True)[1]
        # Another order of pivots in each round.
        self.turn = np.argsort(_mixed(node.view(np.uint64) + np.uint64(step + 1) * _STEP))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the two texts of every pair."""
        where = self.turn
        if (self.label != self.label[0]).any():
            self._region(where, self.distances(where[0], where), 0)
        one, two = (np.concatenate([f[j] for f in self.found]) if self.found else np.empty(0, np.int64) for j in (0, 1))
        both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1).astype(np.int64), axis=0)
        return both[:, 0], both[:, 1]

    def distances(self, pivot: int, where: np.ndarray) -> np.ndarray:
        out, own = np.empty(len(where), np.int64), self.images[pivot].astype(np.int16)
        for low in range(0, len(where), self.STRIDE):
            out[low : low + self.STRIDE] = np.abs(self.images[where[low : low + self.STRIDE]] - own).sum(axis=1, dtype=np.int64)
        return out

    def _bound(self, d: np.ndarray, y: int, where: np.ndarray) -> np.ndarray:
        return (100 + self.percent) * d <= (100 - self.percent) * (self.n[where] + self.n[y])

    def _meet(self, y: int, where: np.ndarray, d: np.ndarray) -> None:
        """Note the pairs of y with texts at distance ``d`` that are within the bound and of other components."""
        near = where[self._bound(d, y, where) & (self.label[where] != self.label[y])]
        near = near[_can_link((self.n[near], self.at[near]), (self.n[y], self.at[y]), self.percent)]
        if not len(near):
            return
        if not self.every:
            others, at = np.unique(self.label[near], return_index=True)
            near = near[at]
            self.label[np.isin(self.label, others)] = self.label[y]
        self.found.append((np.full(len(near), y), near))

    def _open(self, where: np.ndarray) -> np.ndarray:
        """Texts outside the largest component: of every open pair they hold one at least."""
        own = self.label[where]
        return where[own != np.bincount(own).argmax()]

    def _region(self, where: np.ndarray, d: np.ndarray, level: int) -> None:
        """All open pairs of a region whose texts lie at ``d`` from its pivot."""
        is_open = self._open(where)
        if level < LEVELS - 1 and len(is_open) * len(where) > SMALL_REGION:
            new = is_open[:NEW_PIVOTS]
            far = np.stack([self.distances(q, where) for q in new])
            for q, dq in zip(new, far, strict=True):
                self._meet(q, where, dq)
            # A linked text has at most n / t shingles, so the bound is at most (1 - t) / t n.
            border = self.percent * (far - far.min(axis=0)) <= 2 * (100 - self.percent) * self.n[where]
            if (border.sum(axis=1) ** 2).sum() < len(where) ** 2:
                for dq, inside in zip(far, border, strict=True):
                    self._region(where[inside], dq[inside], level + 1)
                return
            is_open = self._open(where)
        at = dict(zip(where.tolist(), d.tolist(), strict=True))
        for y in is_open.tolist():
            other = np.flatnonzero((self.label[where] != self.label[y]) & self._bound(np.abs(d - at[y]), y, where))
            other = where[other]
            self._meet(y, other, self.distances(y, other))


def _crowded_pairs(crowds: DataFrame, known: DataFrame, labels: DataFrame, percent: int, step: int) -> DataFrame:
    """(r, p, x) within the bound of crowded regions, of texts that ``labels`` does not hold together."""
    every = step == ROUNDS - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_runs(batches):
            r, x, component, n, at = (c.to_numpy() for c in columns[:-1])
            images = np.frombuffer(b"".join(columns[-1].to_pylist()), np.uint8).reshape(-1, CLASSES)
            starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
            for low, high in zip(starts, np.r_[starts[1:], len(r)], strict=True):
                one, two = _Crowd(x[low:high], component[low:high], n[low:high], at[low:high], images[low:high], percent, step, every).pairs()
                one, two = x[low:high][one], x[low:high][two]
                if len(one):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(one), r[low])), pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["r", "p", "x"])

    told = crowds.join(labels.select(F.col("id").alias("x"), "component"), "x", "left")
    told = told.select("r", "x", F.coalesce("component", "x").alias("component"), "at")
    several = told.groupBy("r").agg(F.min("component").alias("_least"), F.max("component").alias("_most")).where(F.col("_least") != F.col("_most"))
    told = told.join(several.select("r"), "r", "left_semi").join(known.select(F.col("node").alias("x"), "n", "image"), "x")
    rows = told.select("r", "x", "component", F.col("n").cast("long"), F.col("at").cast("long"), "image")
    return stored(rows.repartition("r").sortWithinPartitions("r").mapInArrow(run, "r bigint, p bigint, x bigint"))


def _sets(docs: DataFrame, wanted: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """node and its shingles, of the wanted (node, doc) only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_memo()
        for batch in batches:
            found = shingle_sets(_texts(batch.column(0)), width, memo)
            yield pa.RecordBatch.from_arrays([pa.array(_node_ids(found)), _lists(found)], ["node", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), whole(text).alias("_text"))
    likely = with_maybe(rows, F.col("doc"), wanted.select("doc")).where("_maybe")
    ids = wanted.select(F.col("doc").alias("_doc")).distinct()
    texts = likely.join(ids, F.col("doc").eqNullSafe(F.col("_doc")), "left_semi").select("_text")
    # A doc_id can have several texts, and a text several rows.
    found = texts.mapInArrow(run, "node bigint, shingles array<bigint>")
    return stored(found.join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")))


def _measured(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """p, x, the distance of their images, and the sizes of their sets (m, n)."""
    a = known.select(F.col("node").alias("p"), F.col("n").alias("m"), F.col("image").alias("_ip"))
    b = known.select(F.col("node").alias("x"), "n", F.col("image").alias("_ix"))
    joined = pairs.select("p", "x").join(a, "p").join(b, "x")
    return stored(joined.select("p", "x", _image_distance("_ip", "_ix").alias("d"), "m", "n"))


def _within(d: Column, m: Column, n: Column, percent: int) -> Column:
    """The bound of linked sets: d <= (1 - t) / (1 + t) (m + n), and sizes of a ratio of at least t."""
    return ((100 + percent) * d <= (100 - percent) * (m + n)) & (100 * F.least(m, n) >= percent * F.greatest(m, n))


def _exact(docs: DataFrame, near: DataFrame, known: DataFrame, percent: int, text: str, key: str, width: int) -> DataFrame:
    """The pairs (a, b) that link, of (p, x) within the bound."""
    near = stored(near.select("p", "x").distinct())
    if near.isEmpty():
        return near.select(F.col("p").alias("a"), F.col("x").alias("b"))
    met = near.select(F.explode(F.array("p", "x")).alias("node")).distinct()
    sets = _sets(docs, known.select("node", "doc").join(met, "node"), text, key, width)
    joined = near.join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("_sp")), "p")
    joined = joined.join(sets.select(F.col("node").alias("x"), F.col("shingles").alias("_sx")), "x")
    both = F.size(F.array_intersect("_sp", "_sx")).cast("long")
    measured = joined.select("p", "x", both.alias("_both"), (F.size("_sp") + F.size("_sx")).cast("long").alias("_sum"))
    linked = stored(
        measured.where(100 * F.col("_both") >= percent * (F.col("_sum") - F.col("_both"))).select(F.col("p").alias("a"), F.col("x").alias("b"))
    )
    for table in (near, sets):
        discard(table)
    return linked


def links(docs: DataFrame, percent: int, width: int, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(nodes, components): nodes holds doc, n and node of every row, components (id, component) of linked nodes."""
    nodes = _nodes(docs, text, key, width, percent)
    members = _members(nodes)
    sparse = stored(_sparse_pairs(members, percent))
    crowds = members.where(F.col("k") > CROWD).select("r", "x", "at")
    met = sparse.select(F.explode(F.array("p", "x")).alias("node")).union(crowds.select("x")).distinct()
    known = nodes.groupBy("node").agg(F.min("doc").alias("doc"), F.max("n").alias("n"), F.first("image").alias("image"))
    known = stored(known.join(met, "node"))
    measured = _measured(sparse, known)
    found = _exact(docs, measured.where(_within(F.col("d"), F.col("m"), F.col("n"), percent)), known, percent, text, key, width)
    labels = components(found)
    for step in range(ROUNDS):
        near = _crowded_pairs(crowds, known, labels, percent, step)
        if near.isEmpty():
            break
        # A region without pairs has no open ones left.
        crowds = crowds.join(near.select("r").distinct(), "r", "left_semi")
        more = _exact(docs, near, known, percent, text, key, width)
        if not more.isEmpty():
            found = stored(found.unionByName(more))
            labels = components(found)
    for table in (members, sparse, measured, known):
        discard(table)
    return nodes.select("doc", "n", "node"), labels


def _classed(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """node, component (its smallest node) and component_id (its smallest doc_id) of every set with shingles."""
    named = nodes.where(F.col("n") > 0).groupBy("node").agg(F.min("doc").alias("_doc"))
    named = named.join(labels.select(F.col("id").alias("node"), "component"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("_doc").alias("component_id"))
    return named.join(least, "component").select("node", "component", "component_id")


def classes(docs: DataFrame, percent: int = 80, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Two texts link if 100 * intersection >= percent * union of their shingle sets. Null and empty
    texts have no shingles and link with nothing; rows of one doc_id are rows of their own with
    that id; a null id is never the smallest unless alone. Other columns are not read.
    """
    nodes, labels = links(docs, percent, width, text, key)
    classed = _classed(nodes, labels).select("node", "component_id")
    empty = nodes.where(F.col("n") == 0).select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("doc").alias("component_id"))
    full = nodes.where(F.col("n") > 0).join(classed, "node").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(empty)


def one_of_each(docs: DataFrame, percent: int = 80, width: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of every group of linked texts, with all its columns: that of least doc_id, null ids last.

    Each row is judged by its own text: where rows share an id, a text without links stays whatever
    the others do. Of rows equal in id and shingles, the one of least text stays. Rows without
    shingles all stay; an empty table has no row; columns of any name come through.
    """
    nodes, labels = links(docs, percent, width, text, key)
    rows = nodes.where(F.col("n") > 0).groupBy("doc", "node").agg(F.count(F.lit(1)).alias("rows"))
    members = rows.join(stored(_classed(nodes, labels)).select("node", "component"), "node")
    first = F.min(F.struct(F.col("doc").isNull(), "doc", "node")).alias("first")
    groups = members.groupBy("component").agg(F.sum("rows").alias("rows"), first).where(F.col("rows") > 1).select("component", "first")
    stays = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("node") == F.col("first.node"))
    judged = stored(members.join(groups, "component").select(F.col("doc").alias("_doc"), F.col("node").alias("_found"), stays.alias("_stays")))

    @F.arrow_udf(LongType())
    def node_of(texts: pa.Array) -> pa.Array:
        sets = shingle_sets(_texts(texts), width, word_memo())
        return pa.array([node if len(found) else None for node, found in zip(_node_ids(sets).tolist(), sets, strict=True)], pa.int64())

    # The row travels as one value, so that its columns meet none of these names.
    packed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(key).cast("long").alias("_id"), whole(text).alias("_text"))
    marked = with_maybe(packed, F.col("_id"), judged.select("_doc").where(F.col("_doc").isNotNull()).distinct())
    doubtful = F.col("_maybe") | F.col("_id").isNull()
    unjudged = marked.where(~doubtful).select("_row")
    named = marked.where(doubtful).drop("_maybe").withColumn("_node", node_of.asNondeterministic()(F.col("_text")))
    told = named.join(judged, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_node") == F.col("_found")), "left")
    alone = told.where(F.col("_stays").isNull()).select("_row")
    one = told.where("_stays").groupBy("_id", "_node").agg(F.min_by("_row", F.struct("_text")).alias("_row")).select("_row")
    return unjudged.unionByName(alone).unionByName(one).select("_row.*")
