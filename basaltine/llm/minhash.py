"""Near-duplicates by SuperMinHash signatures, banding, verification on full sets and union-find.

A document's set is that of its distinct shingles of SHINGLE words, A-Z lower-cased; the whole sequence if it is
shorter; empty without words. Sets are kept as 64-bit hashes. SuperMinHash gives each element random ranks in its own
random permutation of the SLOTS slots and keeps the least rank per slot; ranks grow by one with each step of the
permutation, so a document stops as soon as no later step can lower a slot, which for sets larger than the signature
is after one or two steps. All elements of a batch take a step together.

Documents with equal sets form a class and are represented once. Classes that agree on one of BANDS bands of ROWS
slots meet in a bucket; at a similarity of 0.75 two sets miss each other with a probability of 6e-6. A bucket never
emits all its pairs. First every member is compared with the bucket's most central one, the one that meets most others
in all buckets, which merges near copies of one text with one comparison each; links found merge components. What is
left are buckets that still hold several components. Their members outside the largest one are compared with all that
they aren't yet connected to: in buckets of SMALL members or fewer pair by pair, in larger ones tile by tile. Large
buckets that share members form a family; a tile holds TILE of a family's outliers and TILE of its members of a size
that allows a link, and counts what their sets share by one matrix product, so only links leave it and a group of any
size is dealt to many tasks. One bound spares most of that and loses nothing: what a set shares with any other
is at most what it shares with all other candidates together, so sets with too many shingles of their own are like no
other. So no link between components is lost. Links are confirmed on the full sets of the texts.

Rows with a null id or repeated ids are documents of their own class like others; a document's component is named by
the smallest id in it, null if there is none. Documents with an empty set have their own id as component. Null texts
are empty. Ties, very long texts and empty tables need no special treatment.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltine.llm.common import broadcast_if_small, checkpointed, without, written
from basaltine.llm.components import UnionFind, components
from basaltine.llm.texthash import mix, shingle_hashes, word_hashes_of

SHINGLE = 5
SLOTS = 128
BANDS, ROWS = 32, 4
#: Members of a bucket that is compared pair by pair, at most.
SMALL = 64
#: Sets on either side of a tile.
TILE = 128
#: Columns of a tile's matrices at once.
WIDE = 8192
#: Parts that the members of one pivot are dealt to.
PARTS = 1024
U = np.uint64


def shingle_sets(texts: list[str | None], n: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words, bounds = word_hashes_of([(t or "").encode().lower() for t in texts])
    return [np.unique(shingle_hashes(words[a:b], n)) for a, b in zip(bounds[:-1], bounds[1:])]


def signatures(sets: list[np.ndarray], slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash: one row of slots for each set; step in the top bits, random rank below. Empty sets: all ones."""
    out = np.full((len(sets), slots), ~U(0), dtype=np.uint64)
    flat = out.reshape(-1)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    x = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    swaps: list[np.ndarray] = []
    for step in range(slots):
        if not len(x):
            break
        r = mix(x + U((step + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        swap = step + ((r >> U(32)) * U(slots - step) >> U(32)).astype(np.int64)
        place = swap
        for t in range(step - 1, -1, -1):  # what the earlier swaps have put there
            place = np.where(place == swaps[t], t, place)
        rank = (U(step) << U(56)) | (mix(r) >> U(8))
        np.minimum.at(flat, doc * slots + place, rank)
        swaps.append(swap)
        open_ = (out.max(axis=1) >> U(56)) > step  # a slot that a later step can lower
        more = open_[doc]
        if not more.all():
            x, doc = x[more], doc[more]
            swaps = [s[more] for s in swaps]
    return out


def bands_of(signs: np.ndarray) -> np.ndarray:
    """One hash for each band, with the band in it."""
    parts = signs[:, : BANDS * ROWS].reshape(len(signs), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signs), BANDS)).copy()
    for k in range(ROWS):
        h = mix(h * U(31) + parts[:, :, k])
    return h.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n, cls, bands) beside the first columns; the text is the last one."""
    for rows in batches:
        for at in range(0, rows.num_rows, 256):
            b = rows.slice(at, 256)
            sets = shingle_sets(b.column(b.num_columns - 1).to_pylist())
            bands = bands_of(signatures(sets))
            cls = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            offsets = pa.array(np.arange(0, BANDS * len(sets) + 1, BANDS, dtype=np.int32))
            made = [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(cls, pa.binary()),
                pa.ListArray.from_arrays(offsets, pa.array(bands.reshape(-1))),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], names=["id", "ta", "tb", "n", "cls", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class's text."""
    for rows in batches:
        for at in range(0, rows.num_rows, 64):
            b = rows.slice(at, 64)
            sets = shingle_sets(b.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            values = np.concatenate(sets).view(np.int64)
            made = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([b.column(0), made], names=["cls", "set"])


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many values each set of a shares with each set of b."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    both = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    for first in range(0, len(both), WIDE):
        some = both[first : first + WIDE]
        sides = []
        for flat, row, n in ((fa, ra, len(a)), (fb, rb, len(b))):
            at = np.searchsorted(some, flat)
            at[at == len(some)] = 0
            hit = some[at] == flat
            m = np.zeros((n, len(some)), np.float32)
            m[row[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def tile_links(percent: int):
    """For applyInArrow: links (u, v) between a tile's outliers and its members, as many as join what is linked."""

    def run(tile: pa.Table) -> pa.Table:
        outlier = tile.column("outlier").to_numpy()
        names = tile.column("cls").to_pylist()
        lists = tile.column("set").combine_chunks()
        edges, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        sets = [flat[x:y] for x, y in zip(edges[:-1], edges[1:])]
        a, b = np.flatnonzero(outlier), np.flatnonzero(~outlier)
        uf, found = UnionFind(), []
        if len(a) and len(b):
            n = np.diff(edges).astype(np.int64)
            common = shared_counts([sets[k] for k in a], [sets[k] for k in b]).astype(np.int64)
            good = (common > 0) & ((100 + percent) * common >= percent * (n[a][:, None] + n[b][None, :]))
            for x, y in zip(*np.nonzero(good)):
                u, v = names[a[x]], names[b[y]]
                if uf.find(u) != uf.find(v):
                    uf.union(u, v)
                    found.append((u, v))
        made = [pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)]
        return pa.Table.from_arrays(made, names=["u", "v"])

    return run


class NearDuplicates:
    """Classes of equal sets, links between them, and components of a table of documents."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75):
        self.percent = percent
        self.docs = docs.select(
            F.col(key).alias("id"),
            F.xxhash64(F.col(text)).alias("ta"),
            F.xxhash64(F.lit(1), text).alias("tb"),
            F.col(text).alias("text"),
        )
        kind = dict(self.docs.dtypes)["id"]
        made = self.docs.mapInArrow(_sketch, f"id {kind}, ta long, tb long, n long, cls binary, bands array<long>")
        self.rows = written(made, "signatures")
        grouped = self.rows.where("cls is not null").groupBy("cls")
        one = grouped.agg(F.min("id").alias("rep"), F.min(F.struct("id", "ta", "tb")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        self.classes = written(one, "classes")
        self.labels = self._labels()

    def _members(self) -> DataFrame:
        """(bucket, cls, size) of the buckets with two members or more."""
        every = self.classes.select("cls", F.explode("bands").alias("bucket"))
        shared = every.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
        return written(every.join(shared, "bucket").select("bucket", "cls", "size"), "buckets")

    def _sets(self, members: DataFrame) -> DataFrame:
        """(cls, set) of the classes in buckets."""
        want = self.classes.join(members.select("cls").distinct(), "cls", "left_semi")
        want = want.select("cls", F.col("one.id").alias("i"), F.col("one.ta").alias("a"), F.col("one.tb").alias("b"))
        same = self.docs.id.eqNullSafe(want.i) & self.docs.ta.eqNullSafe(want.a) & self.docs.tb.eqNullSafe(want.b)
        found = self.docs.join(want, same).select("cls", "text").dropDuplicates(["cls"])  # of repeated rows one is enough
        return written(found.mapInArrow(_sets, "cls binary, set array<long>"), "candidate-sets")

    def _verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (cls, pivot) that are links, as (u, v). A pivot's members are dealt to PARTS parts, each with the pivot's set."""
        part = F.pmod(F.xxhash64("cls"), F.lit(PARTS)).alias("part")
        pairs = pairs.select("cls", "pivot", part)
        pivots = pairs.select("pivot", "part").distinct()
        pivots = pivots.join(sets.select(F.col("cls").alias("pivot"), F.col("set").alias("pivot_set")), "pivot")
        both = pairs.join(sets, "cls").join(pivots, ["pivot", "part"])
        n = F.size("set") + F.size("pivot_set")
        share = F.size(F.array_intersect("set", "pivot_set"))
        alike = both.where(100 * F.least(F.size("set"), F.size("pivot_set")) >= self.percent * F.greatest(F.size("set"), F.size("pivot_set")))
        return checkpointed(alike.where((100 + self.percent) * share >= self.percent * n).select(F.col("cls").alias("u"), F.col("pivot").alias("v")))

    def _shared(self, classes: DataFrame, sets: DataFrame) -> DataFrame:
        """(cls, n, common): how many of a class's n shingles some other of these classes has too; those that can be linked."""
        every = sets.join(classes, "cls", "left_semi").select("cls", F.explode("set").alias("g"))
        own = every.groupBy("g").agg(F.count("*").alias("k"), F.min("cls").alias("cls")).where("k = 1")
        own = own.groupBy("cls").agg(F.count("*").alias("private"))
        out = self.classes.select("cls", "n").join(classes, "cls", "left_semi").join(own, "cls", "left")
        out = out.select("cls", "n", (F.col("n") - F.coalesce("private", F.lit(0))).alias("common"))
        return out.where(100 * F.col("common") >= self.percent * F.col("n"))

    @staticmethod
    def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
        """(bucket, size, cls, comp, most): members of the buckets with several components, with their own and the largest one."""
        state = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        state = state.select("bucket", "size", "cls", F.coalesce("root", "cls").alias("comp"))
        parts = state.groupBy("bucket", "comp").agg(F.count("*").alias("k"))
        spread = parts.groupBy("bucket").agg(F.count("*").alias("comps"), F.max_by("comp", F.struct("k", "comp")).alias("most"))
        return state.join(spread.where("comps > 1").select("bucket", "most"), "bucket")

    def _tiles(self, large: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
        """(cls, family) of the members of large buckets, and the links (u, v) found between a family's components."""
        hub = large.groupBy("bucket").agg(F.min("cls").alias("hub"))
        stars = large.join(hub, "bucket").select(F.col("cls").alias("u"), F.col("hub").alias("v")).distinct()
        family = components(stars).select(F.col("node").alias("cls"), F.col("root").alias("family"))
        known = large.select("cls", "n").distinct().join(family, "cls").join(labels.withColumnRenamed("node", "cls"), "cls", "left")
        known = known.withColumn("comp", F.coalesce("root", "cls")).drop("root")
        step = 1.001 * max(math.log(100 / percent), 0.01)  # the sizes of two linked sets are less than a step apart
        known = checkpointed(known.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")))
        most = known.groupBy("family", "comp").agg(F.count("*").alias("k"))
        most = most.groupBy("family").agg(F.max_by("comp", F.struct("k", "comp")).alias("most"))
        near = F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)
        asked = known.join(broadcast_if_small(most, "family"), "family").where("comp <> most").select("family", "cls", F.explode(near).alias("level"), F.lit(True).alias("outlier"))
        sides = asked.unionByName(known.select("family", "cls", "level", F.lit(False).alias("outlier")))
        sizes = sides.groupBy("family", "level").agg(F.count_if("outlier").alias("a"), F.count_if(~F.col("outlier")).alias("b")).where("a > 0 and b > 0")
        sides = sides.join(broadcast_if_small(sizes, "level"), ["family", "level"])
        rows, columns = F.ceil(F.col("a") / TILE), F.ceil(F.col("b") / TILE)
        place = F.xxhash64("cls")
        mine = F.when(F.col("outlier"), F.pmod(place, rows)).otherwise(F.pmod(place, columns))
        others = F.when(F.col("outlier"), columns).otherwise(rows)
        dealt = sides.select("family", "level", "outlier", "cls", mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), others - 1)).alias("other"))
        row = F.when(F.col("outlier"), F.col("mine")).otherwise(F.col("other"))
        column = F.when(F.col("outlier"), F.col("other")).otherwise(F.col("mine"))
        dealt = dealt.select("family", "level", row.alias("row"), column.alias("column"), "outlier", "cls").join(sets, "cls")
        tiles = dealt.groupBy("family", "level", "row", "column").applyInArrow(tile_links(percent), "u binary, v binary")
        return family, checkpointed(tiles)

    def _labels(self) -> DataFrame:
        """(node, root) of the classes that are linked with others."""
        members = self._members()
        sets = self._sets(members)
        degree = members.groupBy("cls").agg(F.sum("size").alias("degree"))
        central = members.join(degree, "cls").groupBy("bucket").agg(F.max(F.struct("degree", "cls")).alias("c"))
        pairs = members.join(central.select("bucket", F.col("c.cls").alias("pivot")), "bucket").where("cls <> pivot")
        tested = written(pairs.select("cls", "pivot").distinct(), "tested")
        links = self._verified(tested, sets)
        labels = components(links)
        mixed = checkpointed(self._mixed(members.where("size > 2"), labels))
        counts = self._shared(mixed.select("cls").distinct(), sets)
        able = checkpointed(mixed.drop("comp", "most").join(counts, "cls"))
        large = able.where(F.col("size") > SMALL)
        family = None
        if not large.isEmpty():
            family, found = self._tiles(large, labels, sets, self.percent)
            labels = self._merged(labels, found)
        state = self._mixed(able.where(F.col("size") <= SMALL).select("bucket", "size", "cls"), labels)
        state = state.join(able.select("cls", "n", "common").distinct(), "cls")
        if family is None:
            state = state.withColumn("family", F.lit(None).cast("binary"))
        else:
            state = state.join(family, "cls", "left")  # all pairs within a family have been compared
        state = checkpointed(state)
        what = ("cls", "comp", "n", "common", "family")
        x = state.where("comp <> most").select("bucket", *[F.col(c).alias(f"{c}_x") for c in what])
        y = state.select("bucket", *[F.col(c).alias(f"{c}_y") for c in what])
        both = F.least("common_x", "common_y")  # what two classes can share at most
        met = x.join(y, "bucket").where("comp_x <> comp_y and (family_x <> family_y or family_x is null or family_y is null)")
        met = met.where((100 + self.percent) * both >= self.percent * (F.col("n_x") + F.col("n_y")))
        met = met.select(F.least("cls_x", "cls_y").alias("cls"), F.greatest("cls_x", "cls_y").alias("pivot")).distinct()
        done = tested.select(F.least("cls", "pivot").alias("cls"), F.greatest("cls", "pivot").alias("pivot"))
        found = self._verified(checkpointed(met.join(done, ["cls", "pivot"], "left_anti")), sets)
        return self._merged(labels, found)

    @staticmethod
    def _merged(labels: DataFrame, found: DataFrame) -> DataFrame:
        """The components of labels, joined by the links found."""
        if found.isEmpty():
            return labels
        known = labels.select(F.col("node").alias("u"), F.col("root").alias("v"))
        return components(known.unionByName(found))

    def documents(self) -> DataFrame:
        """(id, n, component, kept, ta, tb), one row for each document."""
        named = self.classes.select("cls", "rep").join(self.labels.withColumnRenamed("node", "cls"), "cls", "left")
        named = named.withColumn("root", F.coalesce("root", "cls"))
        least = named.groupBy("root").agg(F.min("rep").alias("component"))
        named = named.join(least, "root").select("cls", "component")
        out = self.rows.drop("bands").join(named, "cls", "left")
        component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component"))
        return out.select("id", "n", component.alias("component"), "ta", "tb").withColumn(
            "kept", F.col("id").eqNullSafe(F.col("component"))
        )


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row for each document."""
    out = NearDuplicates(docs, key, text, percent).documents()
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The documents whose id names their component."""
    gone = NearDuplicates(docs, key, text, percent).documents().where(~F.col("kept"))
    return without(docs, gone.select(F.col("id").alias("k_"), F.col("ta").alias("h_")), key, F.xxhash64(F.col(text)))
