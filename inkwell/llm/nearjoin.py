"""N-gram Jaccard join by parity sketches.

A document's set of word shingles is hashed into p blocks; a block of its sketch is the XOR of the 64-bit hashes of its
shingles, so two sketches differ in at most as many blocks as the sets have elements in one but not the other. Sets
that reach the threshold t differ in at most (1 - t) / (1 + t) of their summed sizes. Sizes are cut into bands whose
ends grow by 1 / t; a set is sketched for its own band and the band below, so every pair of sets that may link meets in
the band of the smaller one, with p above the band's largest difference d. By the pigeonhole principle they agree in at
least p - d blocks. Of those, blocks empty in a set are worthless; the remaining `need` = p - d - empty are not:

1. A block value shared with no other set is dropped; a set left with fewer values than it needs links with nothing.
   Common passages alone don't reach that, so they cost no pairs.
2. Sets meet in star joins: each is verified against one partner of its blocks. Groups of copies collapse into
   components this way without their pairs.
3. Sets of different components that still share blocks are sketched once more, now a block a shingle: each emits only
   its rarest shingles, as many as any partner of a given size must share one of. In near copies with many edits those
   are shingles of their own, which meet nobody. Sets of different components that meet are verified, all pairs of them.

Sets for which `need` isn't positive also emit their empty blocks; two such sets then meet there. Pairs that meet are
first held against the sets' bit sketches: each shingle flips one of `BITS` bits, so the sketches' Hamming distance is at
most the sets' difference, and a pair beyond the bound goes before any set is shipped. Verification is exact on the sets. Equal sets form a class that takes part once. The block values travel packed by ranges of their
hash, so a task sorts arrays instead of Spark moving a row for each; there are as many ranges as bound a range's keys. No caps: no link between different sets is lost.

Nulls and extremes: a text that is null or has no words has no shingles and links with nothing, its component is its
own id. Texts of any length are taken whole. Repeated rows are returned alike; rows that share an id but differ in
text count as one document that has the links of both. Ids are integers. A null id links with nothing and gets as its
component the document of an equal set that has an id, else null. Extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, connected_components
from .shingles import WordHashes, mix, shingle_sets, slices

#: The threshold as a ratio: 100 * intersection >= 80 * union.
NUM, DEN = 4, 5
#: Sketch keys that a task packs together; shingles whose keys a range holds on average, at most.
FLUSH, RANGE = 1_000_000, 4_000_000
BITS = 1024


def bands(top: int = 1 << 40) -> np.ndarray:
    """Largest size of each band. A partner of a set in a band is at most in the next one."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * DEN // NUM))
    return np.array(out)


BANDS = bands()


def differ(size: int) -> int:
    """Largest symmetric difference of linked sets the smaller of which has `size` elements."""
    return (size + size * DEN // NUM) * (DEN - NUM) // (DEN + NUM)


def blocks(band: int) -> int:
    """Blocks of a band's sketches: with few elements so many that they seldom share one."""
    hi = int(BANDS[band])
    d = differ(hi)
    return 16 * hi if hi < 64 else d + 1 + max(8, d // 6)


def sketch(found: np.ndarray, band: int) -> tuple[np.ndarray, int]:
    """Keys of the filled blocks of a set's sketch for a band, and how many of them a partner must share."""
    p = blocks(band)
    part = ((found >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    value = np.bitwise_xor.reduceat(mix(found), first)
    tag = np.uint64(band << 40)
    keys = mix(value ^ mix(part[first] + tag + np.uint64(1)))
    need = len(first) - min(differ(int(BANDS[band])), len(found) // 4)
    if need < 1:
        empty = np.setdiff1d(np.arange(p, dtype=np.uint64), part[first], assume_unique=True)
        keys, need = np.concatenate((keys, mix(mix(empty + tag + np.uint64(1)) + np.uint64(band + 7)))), 1
    return keys, need


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and a 128-bit fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            n, one, two = [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), known):
                n.append(len(s))
                m = mix(s)
                one.append(_signed(int(np.add.reduce(m)) & (2**64 - 1)))
                two.append(_signed(int(np.bitwise_xor.reduce(mix(m + np.uint64(5))))) if len(s) else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64())], names=["doc_id", "n_shingles", "fp", "fp2"])

    return docs.mapInArrow(run, "doc_id bigint, n_shingles bigint, fp bigint, fp2 bigint")


def packed_keys(docs: DataFrame, ranges: int) -> DataFrame:
    """Sketch keys of all documents, packed by range of the key: a row holds, for each slot (a set in a band) that has
    keys there, its fingerprint, band, need and number of keys, and then the keys' lowest 40 bits."""
    schema = "part int, fp binary, band binary, need binary, n binary, low binary, high binary"

    def flush(slots: list, keys: list) -> pa.RecordBatch | None:
        if not keys:
            return None
        every = np.concatenate(keys)
        slot = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        part = ((every >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        every, slot, part = every[order], slot[order], part[order]
        fp, band, need = (np.array([s[i] for s in slots], t) for i, t in enumerate((np.uint64, np.uint8, np.uint32)))
        rows: list[list] = [[] for _ in range(7)]
        cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, count = np.unique(slot[a:b], return_counts=True)
            k = every[a:b]
            for col, x in zip(rows, (int(part[a]), fp[own].tobytes(), band[own].tobytes(), need[own].tobytes(), count.astype(np.uint32).tobytes(), k.astype(np.uint32).tobytes(), (k >> np.uint64(32)).astype(np.uint8).tobytes()), strict=True):
                col.append(x)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=["part", "fp", "band", "need", "n", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        slots: list = []
        keys: list = []
        held = 0
        for batch in slices(batches):
            for s in shingle_sets(batch.column(0).to_pylist(), known):
                if not len(s):
                    continue
                fp = int(np.add.reduce(mix(s))) & (2**64 - 1)
                own = int(np.searchsorted(BANDS, len(s)))
                for band in (own, own - 1):
                    if band >= 0 and differ(int(BANDS[band])) and (band == own or len(s) <= int(BANDS[band]) * DEN // NUM):
                        k, need = sketch(s, band)
                        slots.append((fp, band, need))
                        keys.append(k)
                        held += len(k)
                if held > FLUSH:
                    yield flush(slots, keys)
                    slots, keys, held = [], [], 0
        if held:
            yield flush(slots, keys)

    return docs.select("text").mapInArrow(run, schema)


def shared_keys(packed: DataFrame) -> DataFrame:
    """(fp, band, need, key) for keys that sets with different fingerprints have."""
    schema = "fp bigint, band int, need int, key bigint"

    def run(rows: pa.Table) -> pa.Table:
        part = np.uint64(rows.column("part")[0].as_py())
        get = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        count = get("n", np.uint32)
        key = get("low", np.uint32).astype(np.uint64) | get("high", np.uint8).astype(np.uint64) << np.uint64(32)
        order = np.argsort(key)
        ranked = key[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1], [True]))
        order = order[~(new[:-1] & new[1:])]
        slot = np.searchsorted(np.cumsum(count), order, side="right")
        fp, k = get("fp", np.uint64)[slot], key[order]
        by = np.lexsort((fp, k))
        fp, k, slot = fp[by], k[by], slot[by]
        keep = np.concatenate(([True], (k[1:] != k[:-1]) | (fp[1:] != fp[:-1]))) if len(k) else np.empty(0, bool)
        fp, k, slot = fp[keep], k[keep], slot[keep]
        new = np.concatenate(([True], k[1:] != k[:-1], [True]))
        many = ~(new[:-1] & new[1:]) if len(k) else np.empty(0, bool)
        fp, k, slot = fp[many], k[many], slot[many]
        return pa.table({
            "fp": pa.array(fp.view(np.int64)),
            "band": pa.array(get("band", np.uint8)[slot].astype(np.int32)),
            "need": pa.array(get("need", np.uint32)[slot].astype(np.int32)),
            "key": pa.array((k | part << np.uint64(40)).view(np.int64)),
        })

    return packed.groupBy("part").applyInArrow(run, schema)


def bit_sketch(found: np.ndarray) -> np.ndarray:
    """BITS parities as 64-bit integers."""
    flips = np.bincount((found >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS)
    return np.packbits((flips & 1).astype(np.uint8)).view(np.int64)


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, the set's size, its bit sketch and its items as bytes, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in slices(batches):
            sets = list(shingle_sets(batch.column(1).to_pylist(), known))
            bits = np.concatenate([bit_sketch(s) for s in sets]) if sets else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * (BITS // 64)), pa.array(bits))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, lists, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "bits", "items"])

    return docs.mapInArrow(run, "node bigint, n bigint, bits array<bigint>, items binary")


def shared_tokens(sets: DataFrame, ranges: int) -> DataFrame:
    """(node, token, freq) for the shingles that at least two of the sets have."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            items = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if not items:
                continue
            every, owner = np.concatenate(items), np.repeat(nodes, [len(x) for x in items])
            part = ((every >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            every, owner, part = every[order], owner[order], part[order]
            at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
            cols = [[x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)] for x in (owner, every)]
            yield pa.RecordBatch.from_arrays([pa.array(part[at[:-1]]), *(pa.array(c, pa.binary()) for c in cols)], names=["part", "nodes", "tokens"])

    def count(rows: pa.Table) -> pa.Table:
        node = np.frombuffer(b"".join(rows.column("nodes").to_pylist()), np.int64)
        token = np.frombuffer(b"".join(rows.column("tokens").to_pylist()), np.uint64)
        order = np.argsort(token)
        node, token = node[order], token[order]
        at = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        freq = np.repeat(np.diff(at), np.diff(at))
        many = freq > 1
        return pa.table({"node": node[many], "token": token[many].view(np.int64), "freq": freq[many].astype(np.int64)})

    packed = sets.select("node", "items").mapInArrow(pack, "part int, nodes binary, tokens binary")
    return packed.groupBy("part").applyInArrow(count, "node bigint, token bigint, freq bigint")


def sizes_near(top: int = 1 << 40) -> np.ndarray:
    """Smallest size of each fine class of sizes, growing by a thirtieth."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 31 // 30))
    return np.array(out)


CLASSES = sizes_near()


def prefix_keys(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """(key, node, side): by class of its partner's size, a set's rarest shingles, so many that a partner must share one.

    Sets of sizes a and b that link share at least need = NUM * (a + b) / (NUM + DEN), so in one order of all shingles
    they share one of a's first a - need + 1. In order of frequency, shingles that no other set has come first; they
    meet nobody. A set with more of them than its prefix is long links with nothing and costs nothing here. side is 0
    in keys of one class, else 1 for sets of the smaller class and 2 for those of the larger, which meet only each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys, nodes, sides = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for node, n, ranked in zip(*(batch.column(i).to_pylist() for i in range(2)), batch.column(2), strict=True):
                token = ranked.values.field("token").to_numpy().view(np.uint64)
                own = int(np.searchsorted(CLASSES, n, side="right")) - 1
                last = int(np.searchsorted(CLASSES, n * DEN // NUM, side="right")) - 1
                first = int(np.searchsorted(CLASSES, -(-n * NUM // DEN), side="right")) - 1
                for other in range(first, last + 1):
                    need = -(-NUM * (n + int(CLASSES[other])) // (NUM + DEN))
                    take = n - need + 1 - (n - len(token))
                    if take > 0:
                        tag = np.uint64(min(own, other) << 16 | max(own, other))
                        keys.append(mix(mix(token[:take]) ^ mix(np.array([tag]) + np.uint64(99))))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                        sides.append(np.full(len(keys[-1]), 0 if own == other else 1 if own < other else 2, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sides))], names=["key", "node", "side"])

    ranked = tokens.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("freq", "token"))).alias("ranked"))
    return sets.select("node", "n").join(ranked, "node").select("node", "n", "ranked").mapInArrow(run, "key bigint, node bigint, side int")


def within_bound(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those whose bit sketches differ in no more bits than linked sets of their sizes may differ in items."""
    x, y = (sets.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"bits_{k}")) for k in "ab")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return pairs.join(x, "a").join(y, "b").where((DEN + NUM) * apart <= (DEN - NUM) * (F.col("na") + F.col("nb"))).select("a", "b")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(DEN * common >= NUM * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (sets.select(F.col("node").alias(n), F.col("items").alias(f"{n}_items")) for n in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "a_items", "b_items").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, one row a document."""
    spark = docs.sparkSession
    ws = Workspace(spark, "nearjoin")
    raw = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    prints = ws.cut(fingerprints(raw))
    own = ["fp", "fp2", "n_shingles"]
    classes = ws.cut(prints.where("n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("node")))
    total = prints.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    hits = ws.cut(shared_keys(packed_keys(raw, ranges)))

    # Sets that keep as many block values as any partner must share with them.
    able = hits.groupBy("fp", "band").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("fp", "band")
    kept = hits.join(able, ["fp", "band"]).join(classes.select("fp", "node").where("node IS NOT NULL"), "fp")
    entries = ws.cut(kept.select("key", "band", "need", "node"))
    ws.drop(hits)
    nodes = entries.select("node").distinct()
    sets = ws.cut(set_table(raw.join(nodes, raw.doc_id == nodes.node, "left_semi")))

    labels = entries.select("node").distinct().withColumn("component", F.col("node"))
    tried = ws.cut(entries.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0))
    who = F.struct("component", "node")

    def marked(rows: DataFrame) -> DataFrame:
        """Rows of keys in which components meet, with their own component and the first and last of the key."""
        known = rows.join(labels, "node")
        ends = known.groupBy("key").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo.component <> hi.component")
        return known.join(ends, "key")

    def joined(pairs: DataFrame) -> DataFrame:
        """Labels after the links among new pairs; components, not documents, are merged."""
        nonlocal tried
        pairs = ws.cut(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(pairs)
        good = verify(within_bound(pairs, sets), sets)
        at = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
        edges = ws.cut(good.join(at("a"), "a").join(at("b"), "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
        merged = connected_components(edges, ws).toDF("component", "top")
        return ws.cut(labels.join(merged, "component", "left").select("node", F.coalesce("top", "component").alias("component")))

    def star(rows: DataFrame, by: list[str], enough: str) -> DataFrame:
        """For each set of open keys the partner, of another component, with which it shares most of them."""
        partner = F.when(F.col("component") != F.col("lo.component"), F.col("lo.node")).otherwise(F.col("hi.node"))
        met = marked(rows).select("node", *by, partner.alias("other")).groupBy("node", "other", *by).agg(F.count("*").alias("n")).where(enough)
        best = met.groupBy("node").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
        return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()

    for _ in range(2):
        labels = joined(star(entries, ["band", "need"], "n >= need"))
    left = sets.join(marked(entries).select("node").distinct(), "node", "left_semi")
    met = prefix_keys(left, shared_tokens(left, ranges))
    two = met.groupBy("key").agg(F.min("side").alias("low"), F.max("side").alias("high"), F.count("*").alias("n")).where("n > 1 AND (low = 0 OR low <> high)")
    rare = ws.cut(met.join(two.select("key"), "key", "left_semi"))
    labels = joined(star(rare, [], "n > 0"))
    open_ = ws.cut(marked(rare).select("key", "node", "side", "component"))
    other = open_.select("key", F.col("node").alias("b"), F.col("side").alias("sb"), F.col("component").alias("cb"))
    labels = joined(open_.withColumnRenamed("node", "a").join(other, "key").where("component <> cb AND (side < sb OR (side = 0 AND sb = 0 AND a < b))").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = classes.join(labels, "node", "left").select(*own, F.coalesce("component", "node").alias("component"))
    return prints.join(ends, own, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
