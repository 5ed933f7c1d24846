"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact checks.

1. Each text's distinct word shingles are hashed; one permutation is cut into bins and each bin keeps
   its least value. An empty bin takes the value of the first full bin in its own fixed random order
   (optimal densification). Bins are grouped into bands; the number of bands is derived from the
   threshold so that a linked pair without a common bucket has a chance of about one in a million.
2. Documents with the same set form one class, a node.
3. In each bucket every node is a candidate of the bucket's smallest node only (a star).
4. Candidates of fitting sizes are confirmed on full shingle sets; confirmed links give components by
   min-label propagation with pointer jumping, each round written to the shared folder.
5. Where a bucket still holds several components, members under other labels than the hub's meet all
   members, in blocks bounded by members and bytes. There a pair is a candidate in its first common
   band only, if the sizes allow a link and if the lesser counts of shingles by hash range sum to
   enough; this bound never falls short of the intersection. Only members in a candidate pair bring
   their full sets, once for each pair of blocks, and a block yields the links of a forest, at most
   one less than its members. So the star loses no link, no pair is a row, and nothing grows with
   the square of a group but the bounded work inside blocks.

Hot keys: sums and least values are taken before a shuffle; where a join's key can be hot (a bucket,
a hub, a label, a set, an id), both sides are written tables, so that Spark's skew join splits it.
Intermediate tables are deleted as soon as nothing reads them.

Words are runs of anything but ASCII white space, after lower-casing A-Z. Defined results: a text
without words, or null, has an empty set and its own component; with fewer words than a shingle has,
the whole sequence is the one shingle; rows that repeat an id count as copies of that id's documents
(their sets are linked, and n_shingles is each row's own); a null id keeps its row, links nothing and
has a null component; very long texts are taken alone, in memory of a few times their size; equal
smallest values need no order, as results depend on sets alone; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROWS = 5
#: Members of a block where a bucket's members meet, and bytes of their sets.
BLOCK, BLOCK_BYTES = 1024, 8_000_000
#: Bytes of text whose sets a task holds at a time (a longer text is taken alone); a set takes up to four times its text's bytes.
SETS_BYTES = 4_000_000
MISS = 1e-6
#: Marks word counts below the shingle size, so that "a b" and "a b" as part of a longer text differ.
_SHORT = 0x5851F42D4C957F2D


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_sets(texts: pa.Array, words: int):
    """For each text its sorted distinct shingle hashes (uint64)."""
    texts = pc.fill_null(texts, "")
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = pieces.offsets.to_numpy().astype(np.int64)
    coded = pieces.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    bounds = bounds - bounds[0]
    names = [w for w in coded.dictionary.to_pylist()]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
    empty = np.fromiter((not w for w in names), bool, len(names))
    at = coded.indices.to_numpy()
    every = hashes[at] if len(at) else np.empty(0, np.uint64)
    real = ~empty[at] if len(at) else np.empty(0, bool)
    odd = np.uint64(0x9E3779B97F4A7C15)
    for i in range(len(bounds) - 1):
        h = every[bounds[i] : bounds[i + 1]]
        keep = real[bounds[i] : bounds[i + 1]]
        if not keep.all():
            h = h[keep]
        n = len(h)
        if not n:
            yield h
            continue
        k = min(words, n)
        s = h[: n - k + 1].copy()
        for j in range(1, k):
            s = common.mix64(s) * odd + h[j : n - k + 1 + j]
        if n < words:
            s = s ^ np.uint64(_SHORT * n & 0xFFFFFFFFFFFFFFFF)
        s = common.mix64(s)
        s.sort()
        yield s[np.concatenate([[True], s[1:] != s[:-1]])]


class Signer:
    """Band keys of a sorted shingle set."""

    def __init__(self, bands: int, rows: int = ROWS, seed: int = 7):
        self.bins = bands * rows
        self.shape = (bands, rows)
        rng = np.random.default_rng(seed)
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1)
        self.edges = np.array([(b << 64) // self.bins for b in range(self.bins)], np.uint64)
        self.salt = common.mix64(np.arange(1, self.bins + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))

    def keys(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.empty(0, np.int64)
        first = np.searchsorted(shingles, self.edges)
        own = np.append(first[1:], len(shingles)) > first
        values = shingles[np.minimum(first, len(shingles) - 1)]
        gaps = np.flatnonzero(~own)
        if len(gaps):
            order = self.order[gaps]
            values[gaps] = values[order[np.arange(len(gaps)), own[order].argmax(1)]]
        mixed = common.mix64(values ^ self.salt).reshape(self.shape)
        key = mixed[:, 0]
        for r in range(1, self.shape[1]):
            key = common.mix64(key) + mixed[:, r]
        return common.mix64(key).view(np.int64)


def signatures(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (a 128-bit hash of the set) and the band keys."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            for a, b in common.chunks(batch.column(1), SETS_BYTES):
                counts, marks, keys = [], [], []
                for s in shingle_sets(batch.column(1).slice(a, b - a), words):
                    counts.append(len(s))
                    marks.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(signer.keys(s))
                mark = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                ends = np.cumsum([0, *map(len, keys)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(counts, pa.int64()), pa.array(mark[:, 0].copy()), pa.array(mark[:, 1].copy()), lists], ["doc_id", "n_shingles", "set_a", "set_b", "bands"])

    return common.map_arrow(docs, run, f"doc_id {kind}, n_shingles long, set_a long, set_b long, bands array<long>")


def counts_of(shingles: np.ndarray) -> bytes:
    """How many shingles fall in each of 2**m equal ranges of hashes, m by the set's size.

    The sum of the lesser counts of two sets is never below the size of their intersection. Empty
    (no bound) where a count needs more than 16 bits.
    """
    m = min(9, max(4, len(shingles).bit_length() - 2))
    n = np.bincount((shingles >> np.uint64(64 - m)).astype(np.int64), minlength=1 << m)
    return n.astype("<u2").tobytes() if n.max(initial=0) < 1 << 16 else b""


def sets_of(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """node, n, counts, keys (band keys) and shingles (sorted hashes) of the rows whose set is set_a, set_b."""

    def run(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            for a, b in common.chunks(batch.column(1), SETS_BYTES):
                part = batch.slice(a, b - a)
                own = np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3)], 1)
                sets = list(shingle_sets(part.column(1), words))
                at = [i for i, s in enumerate(sets) if xxhash.xxh3_128_digest(s.tobytes()) == own[i].astype("<i8").tobytes()]
                sets = [sets[i] for i in at]
                blobs = [common.binary_array([f(s) for s in sets]) for f in (counts_of, lambda s: signer.keys(s).tobytes(), lambda s: s.tobytes())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array([len(s) for s in sets], pa.int64()), *blobs], ["node", "n", "counts", "keys", "shingles"])

    return common.map_arrow(docs.select("node", "text", "set_a", "set_b"), run, "node long, n long, counts binary, keys binary, shingles binary")


def confirm(pairs: DataFrame, share: int, parts: int) -> DataFrame:
    """The pairs a, b whose sets set_x and set_y are linked."""

    def run(batches):
        for batch in common.small_batches(batches, 500):
            hit = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                s, t = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                inner = int((s[np.minimum(np.searchsorted(s, t), len(s) - 1)] == t).sum())
                hit.append(inner * parts >= (len(s) + len(t) - inner) * share)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return common.map_arrow(pairs.select("a", "b", "set_x", "set_y"), run, "a long, b long")


_GROUP = ["band", "key", "x", "y"]
_MEMBER = "band int, key long, x int, y int, role int, node long, label long"


class _Members:
    """The members of one group: role bit 1 stands for side x, 2 for side y."""

    def __init__(self, parts: list[pa.RecordBatch]):
        self.table = table = pa.Table.from_batches(parts)
        column = lambda name: table.column(name).combine_chunks()
        self.band = column("band")[0].as_py()
        self.role, self.node, self.label, self.n = (column(c).to_numpy(zero_copy_only=False) for c in ("role", "node", "label", "n"))
        self.keys = np.frombuffer(b"".join(column("keys").to_pylist()), np.int64).reshape(len(self.n), -1)
        self.x, self.y = np.flatnonzero(self.role & 1), np.flatnonzero(self.role & 2)
        counts = [np.frombuffer(c, "<u2") for c in column("counts").to_pylist()]
        self.width = np.array([len(c) for c in counts])
        self.counts = {int(w): np.stack([counts[i] for i in np.flatnonzero(self.width == w)]) for w in np.unique(self.width)}
        self.row = np.zeros(len(self.n), np.int64)
        for w in self.counts:
            own = np.flatnonzero(self.width == w)
            self.row[own] = np.arange(len(own))

    def bound(self, i: int, at: np.ndarray) -> np.ndarray:
        """No intersection of member i with the members at is larger."""
        out = np.minimum(self.n[i], self.n[at])
        mine = self.counts[int(self.width[i])][self.row[i]]
        for w in np.unique(self.width[at]):
            least = min(int(w), len(mine))
            if not least:
                continue
            own = at[self.width[at] == w]
            theirs = self.counts[int(w)][self.row[own]]
            fold = lambda c: c.reshape(*c.shape[:-1], least, -1).sum(-1, dtype=np.int64) if c.shape[-1] > least else c
            out[self.width[at] == w] = np.minimum(fold(mine), fold(theirs)).sum(-1, dtype=np.int64)
        return out

    def used(self, share: int, parts: int) -> np.ndarray:
        """Whether each member is in a pair of x and y under different labels that may be linked and meets in no earlier band."""
        used = np.zeros(len(self.n), bool)
        for i in self.x:
            n, at = self.n[i], self.y[~used[self.y]] if used[i] else self.y
            at = at[(self.label[at] != self.label[i]) & (np.minimum(n, self.n[at]) * parts >= np.maximum(n, self.n[at]) * share)]
            at = at[~(self.keys[at, : self.band] == self.keys[i, : self.band]).any(1)]
            if len(at):
                at = at[self.bound(i, at) * (parts + share) >= (n + self.n[at]) * share]
                used[at] = True
                used[i] |= len(at) > 0
        return used


def _groups(batches):
    """The groups of rows that come sorted by group; a group may span batches."""
    parts: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _GROUP]
        edges = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            own = tuple(c[a] for c in columns)
            if own != mark and parts:
                yield parts
                parts = []
            mark = own
            parts.append(batch.slice(a, b - a))
    if parts:
        yield parts


def _likely(share: int, parts: int):
    """Keeps the members that are in a candidate pair."""

    def run(batches):
        for group in _groups(batches):
            if sum(p.num_rows for p in group) > 1:
                g = _Members(group)
                used = g.used(share, parts)
                if used.any():
                    yield from g.table.select([f.split()[0] for f in _MEMBER.split(", ")]).filter(pa.array(used)).to_batches()

    return run


#: Entries of the matrix that holds which sets have which shingles.
MATRIX = 40_000_000


def _intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray):
    """Runs of x and the sizes of their intersections with all of y."""
    flat = np.concatenate(sets)
    names, at = np.unique(flat, return_inverse=True)
    often = np.bincount(at) > 1
    column = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    use = often[at]
    row, at = row[use], column[at[use]]
    width = int(often.sum())
    # Shingles in slices, so that the matrices stay bounded.
    part = max(1, MATRIX // len(sets))
    for a in range(0, len(x), 256):
        own = x[a : a + 256]
        inner = np.zeros((len(own), len(y)), np.float64)
        for low in range(0, width, part):
            held = np.zeros((len(sets), min(part, width - low)), np.float32)
            here = (at >= low) & (at < low + part) if part < width else slice(None)
            held[row[here], at[here] - low] = 1
            inner += held[own] @ held[y].T
        yield own, np.rint(inner).astype(np.int64)


def _joined(share: int, parts: int):
    """Links between labels that join each group's components: a forest, at most one less than its members."""

    def run(batches):
        for group in _groups(batches):
            g = _Members(group)
            sets = [np.frombuffer(s, np.uint64) for s in g.table.column("shingles").to_pylist()]
            label, a, b = g.label.copy(), [], []
            for own, inner in _intersections(sets, g.x, g.y):
                hit = inner * parts >= (g.n[own][:, None] + g.n[g.y] - inner) * share
                for i in np.flatnonzero(hit.any(1)):
                    mine = label[own[i]]
                    for other in np.unique(label[g.y[hit[i]]]):
                        if other != mine:
                            a.append(mine)
                            b.append(other)
                            label[label == other] = mine
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links_across(rest: DataFrame, prints: DataFrame, share: int, parts: int, space: common.Space) -> DataFrame:
    """Links a, b between labels whose members share a bucket, one of them not under the bucket's main label.

    rest has band, key, node, label, main, n_all, n_other and bytes (of the bucket's members, those not under main, and all sets).
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int")
    rest = rest.withColumns({"nx": blocks("n_all"), "ny": F.least(blocks("n_all"), F.greatest(blocks("n_other"), F.lit(1)))})
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    other = F.col("label") != F.col("main")
    steps = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = F.col("nx") == 1
    pick = lambda c, x, y, role: rest.where(c).select("band", "key", x.alias("x"), y.alias("y"), role.cast("int").alias("role"), "node", "label")
    whole = pick(one, F.lit(0), F.lit(0), F.when(other, 3).otherwise(1))
    xs, ys = pick(~one, place("nx"), F.explode(steps("ny")), F.lit(1)), pick(~one & other, F.explode(steps("nx")), place("ny"), F.lit(2))
    members = whole.unionByName(xs).unionByName(ys)

    def dealt(df, *columns):
        full = df.join(prints.select("node", "n", "counts", "keys", *columns), "node")
        return full.repartition(*_GROUP).sortWithinPartitions(*_GROUP)

    likely = space.keep(common.map_arrow(dealt(members), _likely(share, parts), _MEMBER), "likely")
    return common.map_arrow(dealt(likely, "shingles"), _joined(share, parts), "a long, b long").distinct()


def components(links: DataFrame, space: common.Space) -> DataFrame:
    """node and label, the smallest node that it reaches; links has columns a and b.

    Joins whose key may be hot (a hub, a large component's label) read written tables on both sides,
    so that Spark can split the hot key's rows.
    """
    both = space.keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = space.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        # The least label among the neighbours, then the label of that label.
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = space.keep(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("via")), "step")
        if step.where("old <> via").isEmpty():
            space.drop(both, step)
            return labels
        after = step.join(labels.select(F.col("node").alias("via"), F.col("label").alias("top")), "via").select("node", F.least("via", "top").alias("label"))
        before, labels = labels, space.keep(after, "labels")
        space.drop(before, step)


def near_duplicates(df: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5), rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept; sets are linked if parts * intersection >= share * union, threshold = (share, parts)."""
    return _grouped(df, words, threshold, rows, id_col, text_col)[0]


def _grouped(df: DataFrame, words: int, threshold: tuple[int, int], rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """near_duplicates' rows, and whether an id repeats."""
    share, parts = threshold
    bands = bands_for(share / parts, rows)
    space, sets = common.Space(df.sparkSession), ["set_a", "set_b"]
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = space.keep(signatures(docs, words, bands, rows), "minhash")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets form one class, a node with a number of its own.
    classes = full.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = space.keep(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    member = classes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    hubs = space.keep(member.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size"), "hubs")
    held = space.keep(member.join(hubs, ["band", "key"]), "buckets")
    # An id may repeat: then its rows' classes are linked.
    ids = full.groupBy("doc_id").agg(F.count("*").alias("rows"), *(f(s).alias(f"{k}_{s}") for s in sets for k, f in (("lo", F.min), ("hi", F.max)))).where("rows > 1")
    ids = space.keep(ids, "repeated")
    repeats = not ids.isEmpty()
    needed = held.select("node").distinct().join(classes.select("node", "rep", *sets), "node").withColumnRenamed("rep", "doc_id")
    # Texts are shuffled at any size, so that a small table takes the way of a large one.
    prints = sets_of(docs.where("doc_id IS NOT NULL").join(space.keep(needed, "needed").hint("merge"), "doc_id"), words, bands, rows)
    prints = space.keep(prints.dropDuplicates(["node"]) if repeats else prints, "sets")

    stars = held.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    sizes = prints.select("node", "n")
    near = F.least("n_a", "n_b") * parts >= F.greatest("n_a", "n_b") * share
    stars = space.keep(stars.join(sizes.toDF("b", "n_b"), "b"), "stars")
    stars = space.keep(stars.join(sizes.toDF("a", "n_a"), "a").where(near).select("a", "b"), "stars")
    with_sets = lambda df, at, name: df.join(prints.select(F.col("node").alias(at), F.col("shingles").alias(name)), at)
    links = space.keep(confirm(with_sets(with_sets(stars, "b", "set_y"), "a", "set_x"), share, parts), "links")
    if repeats:
        many = full.join(ids.where("lo_set_a <> hi_set_a OR lo_set_b <> hi_set_b").select("doc_id"), "doc_id").select("doc_id", *sets).distinct()
        many = space.keep(many.join(classes.select("node", *sets), sets).select("doc_id", "node"), "many")
        first = space.keep(many.groupBy("doc_id").agg(F.min("node").alias("a")), "first")
        links = links.union(many.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    labels = components(links, space)

    # What the stars have not joined: members of one bucket under different labels.
    placed = space.keep(held.join(labels, "node", "left").select("band", "key", "node", "n", "hub", F.coalesce("label", "node").alias("label")), "placed")
    own = placed.groupBy("band", "key", "label").agg(F.count("*").alias("c"), F.sum("n").alias("n"), F.max((F.col("node") == F.col("hub")).cast("int")).alias("is_main"))
    mixed = own.groupBy("band", "key").agg(F.count("*").alias("labels"), F.sum("c").alias("n_all"), (F.sum("n") * 8).alias("bytes"), F.max(F.when(F.col("is_main") == 1, F.col("label"))).alias("main"), F.sum(F.when(F.col("is_main") == 0, F.col("c"))).alias("n_other"))
    mixed = space.keep(mixed.where("labels > 1").drop("labels"), "mixed")
    rest = space.keep(placed.drop("n", "hub").join(mixed, ["band", "key"]), "rest")
    more = space.keep(links_across(rest, prints, share, parts, space), "more")
    if not more.isEmpty():
        tops = components(more, space)
        labels = space.keep(labels.unionByName(classes.select("node", F.col("node").alias("label")).join(labels, "node", "left_anti")), "labels")
        labels = space.keep(labels.join(tops.toDF("label", "top"), "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")

    # The smallest id of each component that has a link.
    reps = space.keep(labels.join(classes.select("node", "rep", *sets), "node"), "reps")
    least = space.keep(reps.groupBy("label").agg(F.min("rep").alias("top")), "least")
    linked = space.keep(reps.join(least, "label").select(*sets, "top"), "linked")
    tops = space.keep(classes.select(*sets, "rep").join(linked, sets, "left").select(*sets, F.coalesce("top", "rep").alias("top")), "tops")
    space.drop_all_but(signed, tops)
    found = signed.drop("bands").join(tops, sets, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("top")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept")), repeats


def keep_one(df: DataFrame, words: int = 5, threshold: tuple[int, int] = (4, 5)) -> DataFrame:
    """One row of df for each component, of the document that represents it; rows without an id all stay.

    Of several rows under that id the one with the smallest hash of its columns stays.
    """
    grouped, repeats = _grouped(df, words, threshold)
    kept = grouped.where("kept").select("doc_id")
    one = df.join(kept.distinct() if repeats else kept, "doc_id", "left_semi")
    if repeats:
        row = F.struct(*df.columns)
        one = one.groupBy("doc_id").agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("_row")).select("_row.*")
    return one.select(df.columns).union(df.where("doc_id IS NULL"))


def op2_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.spread(common.table(spark, sf_dir, "documents")), words=3, threshold=(85, 100))


#: The same components by an inverted index over all shingles, for small tables.
OP2_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) END AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(doc_id, top) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT l.b, r.top FROM reach r JOIN links l ON l.a = r.doc_id WHERE r.top < l.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.top) AS component_id, min(r.top) = s.doc_id AS kept
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""
