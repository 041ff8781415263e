"""Near duplicates by MinHash signatures and a multi-index Hamming join.

A document's set is its distinct shingles; equal sets form a class, and only the class's smallest
``doc_id`` goes on. Its signature is a row of 16-bit MinHash components in chunks. Where two signatures
differ in fewer than twice as many components as there are chunks, they differ in at most one component
of some chunk (pigeonhole). So every such pair meets under a key made of a chunk without one of its
components: one key a component, all errors enumerated, no pair under the distance lost. For a
similarity of 0.85 there are 12 chunks of 6: a component differs with probability 0.15, and the distance
23 is 4.2 standard deviations above the mean of 10.8 (about 5 pairs in 100,000 exactly at the threshold
differ in more; less than one in a million at 0.88). For 0.80 there are 15 chunks of 5 and the distance
is 29, again 4.2 deviations above the mean of 15.

Links are wanted up to connectivity. The smallest member under a key is its hub; all members meet their
hubs, the pairs are confirmed on the full shingle sets, and components are formed. Two documents that
share a key share a hub, so what is left are pairs around one hub in different components. Around each
hub, the documents outside its largest component meet all others in blocks of bounded size, set against
set inside a task, and only links leave it; links inside a component add nothing. So a group of copies
costs rows in proportion to its documents.

Words: A-Z lower-cased, runs between white space. A document with fewer words than a shingle is one
shingle; null or empty text has none and is linked with nothing. Rows with one ``doc_id`` are one
document's versions and count as linked, each judged by its own text; rows without ``doc_id`` take no part and are kept. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscan.llm import words
from shelfscan.llm.common import chunks, salted_lookup, ship, staged, text_buffers
from shelfscan.llm.graphs import components

#: Components of the longest signature.
MOST = 80
_A = (words.mix(np.arange(1, MOST + 1, dtype=words.U)) >> words.U(32)).astype(np.uint32) | np.uint32(1)
_B = words.mix(np.arange(1, MOST + 1, dtype=words.U) << words.U(32)).astype(np.uint32)


def layout(percent: int) -> tuple[int, int]:
    """Chunks and components of a chunk for a similarity."""
    return (12, 6) if percent >= 85 else (15, 5) if percent >= 80 else (20, 4)


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, offsets = text_buffers(column)
    for a, b in chunks(offsets):
        part = words.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = words.bounds(part, offsets[a : b + 1] - offsets[a], words.SPACED)
        hashed = words.hashes(part, starts, ends)
        for i in range(b - a):
            own = hashed[first[i] : first[i + 1]]
            if len(own) >= shingle:
                yield np.unique(words.runs(own, shingle))
            elif len(own):
                yield words.runs(own, len(own)) + words.U(len(own))
            else:
                yield own


def signature(shingles: np.ndarray, parts: int) -> np.ndarray:
    """16 bits of the smallest hash under each of the functions."""
    x = (shingles >> words.U(32)).astype(np.uint32)
    a, b = _A[:parts], _B[:parts]
    best = np.full(parts, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        h = x[i : i + 1024, None] * a + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(best, h.min(axis=0), out=best)
    best ^= best >> np.uint32(16)
    best *= np.uint32(0x45D9F3B)
    return (best >> np.uint32(16)).astype(np.uint16)


def _marks(shingles: np.ndarray) -> tuple[int, int]:
    """Two sums of hashes that tell one set from another."""
    if not len(shingles):
        return 0, 0
    one, two = words.mix(shingles), words.mix(shingles ^ words.U(0x5851F42D4C957F2D))
    return tuple(int(x.sum(dtype=words.U).view(np.int64)) for x in (one, two))


def _signed(shingle: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, signs = [], [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n.append(len(s))
                marks = _marks(s)
                one.append(marks[0])
                two.append(marks[1])
                signs.append(signature(s, parts).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "n_shingles", "one", "two", "signature"],
            )

    return run


def _keyed(count: int, width: int):
    """Each class under its keys: the chunk and left-out component, and the chunk's other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = words.mix(np.arange(1, width + 1, dtype=words.U))
        which = words.mix(np.arange(1, count * width + 1, dtype=words.U) << words.U(20)).reshape(1, count, width)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, count, width).astype(words.U)
            terms = words.mix(signs + words.U(1)) * (place | words.U(1))
            keys = words.mix(terms.sum(axis=2, dtype=words.U)[:, :, None] - terms + which)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(ids, count * width))], names=["key", "id"])

    return run


def _close(most: int):
    """Pairs whose signatures differ in at most ``most`` components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            near = pa.array((left != right).sum(axis=1) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(near) for i in (0, 1)], names=["a", "b"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), shingle))
            one, two = ([m[k] for m in map(_marks, sets)] for k in (0, 1))
            columns = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "shingles", "n_shingles", "one", "two"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), words.U), np.frombuffer(y.as_buffer(), words.U)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return run


def _blocks(percent: int):
    """Links between the documents outside (``out``) and all others of a block, in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for members in batch.column(0):
                flat = members.values
                ids, comps = flat.field("id").to_numpy(), flat.field("c").to_numpy()
                out = flat.field("out").to_numpy(zero_copy_only=False)
                sets = [np.frombuffer(x.as_buffer(), words.U) for x in flat.field("shingles")]
                x, y = np.flatnonzero(out), np.flatnonzero(~out)
                both = _common([sets[i] for i in x], [sets[i] for i in y])
                size = np.array([len(s) for s in sets])
                linked = 100 * both >= percent * (size[x][:, None] + size[y][None, :] - both)
                linked &= comps[x][:, None] != comps[y][None, :]
                i, j = np.nonzero(linked)
                left += np.minimum(ids[x[i]], ids[y[j]]).tolist()
                right += np.maximum(ids[x[i]], ids[y[j]]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every set of ``right``."""
    both = np.zeros((len(left), len(right)), np.int64)
    if not len(left) or not len(right):
        return both
    values = [np.concatenate(left), np.concatenate(right)]
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    known = np.intersect1d(np.unique(values[0]), np.unique(values[1]), assume_unique=True)
    place = [np.searchsorted(known, v) for v in values]
    for k in (0, 1):
        good = place[k] < len(known)
        good[good] = known[place[k][good]] == values[k][good]
        place[k], rows[k] = place[k][good], rows[k][good]
    for at in range(0, len(known), 4096):
        parts = []
        for k, n in ((0, len(left)), (1, len(right))):
            m = np.zeros((n, min(4096, len(known) - at)), np.float32)
            inside = (place[k] >= at) & (place[k] < at + m.shape[1])
            m[rows[k][inside], place[k][inside] - at] = 1
            parts.append(m)
        both += (parts[0] @ parts[1].T).astype(np.int64)
    return both


#: Documents of a side of a block.
BLOCK = 256
#: What tells one class from another.
CLASS = ["one", "two", "n_shingles"]


class Search:
    """The stages of one run; each result is a table in the shared folder."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int):
        ship(docs.sparkSession)
        self.docs = docs.selectExpr("CAST(doc_id AS bigint) AS doc_id", "CAST(text AS string) AS text")
        self.shingle, self.percent = shingle, percent
        self.chunks, self.width = layout(percent)
        schema = "doc_id long, n_shingles long, one long, two long, signature binary"
        self.rows = staged(self.docs.mapInArrow(_signed(shingle, self.chunks * self.width), schema), "signatures")
        named = self.rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
        several = named.groupBy("doc_id").agg(F.expr("min(struct(one, two, n_shingles)) < max(struct(one, two, n_shingles)) AS differ"))
        self.versioned = staged(several.filter("differ").select("doc_id"), "versioned")
        self.versions = not self.versioned.isEmpty()
        classes = named.groupBy(*CLASS).agg(F.min("doc_id").alias("first"))
        if self.versions:
            # The first document of a class may be the first of another, too: such classes have an id of their own.
            own = self.versioned.withColumnRenamed("doc_id", "_v")
            classes = classes.join(own, F.col("first") == F.col("_v"), "left")
            classes = classes.selectExpr(*CLASS, "first", "if(_v IS NULL, first, -2 - (xxhash64(one, two, n_shingles) & 9223372036854775807L) DIV 2) AS id")
        else:
            classes = classes.selectExpr(*CLASS, "first", "first AS id")
        self.classes = staged(classes, "classes")
        firsts = self.classes.selectExpr("first AS doc_id", *CLASS, "id")
        signs = named.join(firsts, ["doc_id", *CLASS]).dropDuplicates(["id"])
        self.signs = staged(signs.selectExpr("id", "n_shingles AS n", "signature"), "class-signatures")

    def stars(self) -> DataFrame:
        """``hub`` and ``id`` of every member of a key that is not its hub."""
        keyed = self.signs.select("id", "signature").mapInArrow(_keyed(self.chunks, self.width), "key long, id long")
        hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"))
        hubs = staged(hubs.filter("hub < last").select("key", "hub"), "hubs")
        return staged(keyed.join(hubs, "key").filter("id <> hub").select("hub", "id").distinct(), "stars")

    def sets(self, ids: DataFrame) -> DataFrame:
        """``id`` and ``shingles`` of the classes with the given ``id``."""
        schema = "id long, shingles binary, n_shingles long, one long, two long"
        if not self.versions:
            full = self.docs.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
            return staged(full.mapInArrow(_sets(self.shingle), schema).select("id", "shingles"), "shingle-sets")
        wanted = staged(self.classes.join(ids, "id", "left_semi"), "wanted-classes")
        full = self.docs.join(wanted.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
        found = full.mapInArrow(_sets(self.shingle), schema).withColumnRenamed("id", "first").join(wanted, ["first", *CLASS])
        return staged(found.dropDuplicates(["id"]).select("id", "shingles"), "shingle-sets")

    def between_versions(self) -> DataFrame:
        """Links between the classes that share a document."""
        named = self.rows.filter("n_shingles > 0").join(self.versioned, "doc_id", "left_semi").select("doc_id", *CLASS).distinct()
        met = named.join(self.classes.select(*CLASS, "id"), CLASS).select("doc_id", "id")
        firsts = met.groupBy("doc_id").agg(F.min("id").alias("a"))
        return staged(met.join(firsts, "doc_id").filter("a < id").selectExpr("a", "id AS b").distinct(), "version-links")

    def verify(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Those of the pairs (``a``, ``b``; distinct) that are similar: by size, by signature, then on full sets."""
        sign = self.signs
        sized = pairs.join(sign.selectExpr("id AS a", "n AS na", "signature AS sa"), "a").join(sign.selectExpr("id AS b", "n AS nb", "signature AS sb"), "b")
        sized = sized.filter(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)").select("a", "b", "sa", "sb")
        near = staged(sized.mapInArrow(_close(2 * self.chunks - 1), "a long, b long"), "near-pairs")
        met = near.join(sets.selectExpr("id AS a", "shingles AS xa"), "a").join(sets.selectExpr("id AS b", "shingles AS xb"), "b")
        return staged(met.select("a", "b", "xa", "xb").mapInArrow(_confirmed(self.percent), "a long, b long"), "links")

    def rest(self, stars: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between different components around one hub."""
        around = stars.union(stars.selectExpr("hub", "hub AS id").distinct()).join(found, "id", "left").selectExpr("hub", "id", "coalesce(component, id) AS c")
        around = staged(around, "around-hubs")
        counts = around.groupBy("hub", "c").agg(F.count("*").alias("m"))
        mains = counts.groupBy("hub").agg(F.sum("m").alias("n"), F.expr("min(named_struct('m', -m, 'c', c)) AS main")).filter("-main.m < n")
        mains = staged(mains.selectExpr("hub", "main.c AS main", f"CAST(ceil((n + main.m) / {BLOCK}) AS int) AS outs", f"CAST(ceil(n / {BLOCK}) AS int) AS alls"), "mixed-hubs")
        mixed = around.join(mains, "hub")
        out = mixed.filter("c <> main").selectExpr("hub", "id", "c", "true AS out", "CAST(pmod(xxhash64(id), outs) AS int) AS i", "explode(sequence(0, alls - 1)) AS j")
        others = mixed.selectExpr("hub", "id", "c", "false AS out", "explode(sequence(0, outs - 1)) AS i", "CAST(pmod(xxhash64(id), alls) AS int) AS j")
        blocks = out.union(others).join(sets, "id").groupBy("hub", "i", "j").agg(F.collect_list(F.struct("id", "c", "out", "shingles")).alias("members"))
        return staged(blocks.select("members").mapInArrow(_blocks(self.percent), "a long, b long").distinct(), "links")

    def components(self) -> DataFrame:
        """``id`` (of a class) and ``component``, for classes that are linked."""
        stars = self.stars()
        sets = self.sets(stars.selectExpr("hub AS id").union(stars.select("id")).distinct())
        links = self.verify(stars.selectExpr("hub AS a", "id AS b"), sets)
        if self.versions:
            links = links.union(self.between_versions())
        found = staged(components(links), "components")
        more = self.rest(stars, found, sets)
        return found if more.isEmpty() else staged(components(links.union(more)), "components")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``."""
    s = Search(docs, shingle, percent)
    of_class = s.classes.join(s.components(), "id", "left").selectExpr(*CLASS, "first", "coalesce(component, id) AS class_component")
    if s.versions:
        of_class = staged(of_class, "labelled-classes")
        lowest = of_class.groupBy("class_component").agg(F.min("first").alias("lowest"))
        of_class = salted_lookup(of_class, lowest, ["class_component"]).selectExpr(*CLASS, "lowest AS class_component")
    of_class = staged(of_class.select(*CLASS, "class_component"), "class-components")
    joined = s.rows.select("doc_id", *CLASS).join(of_class, CLASS, "left")
    return joined.selectExpr("doc_id", "n_shingles", "if(doc_id IS NULL, NULL, coalesce(class_component, doc_id)) AS component_id").selectExpr("*", "coalesce(doc_id = component_id, true) AS kept")
