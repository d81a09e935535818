"""N-gram Jaccard join by parity sketches, and the groups of near copies that it links.

A text is its set of five-word shingles. The shingles of a set are dealt by hash into parts and each part is reduced to the XOR of its
hashes: a shingle that only one of two sets holds changes one part, so the number of differing parts never exceeds the symmetric
difference. Sets with a Jaccard similarity of 0.8 differ by a quarter of the smaller one at most; every size band has more parts than that, so
(pigeonhole) such sets agree on a part. Sets that share a part are compared by a bit sketch, whose Hamming distance bounds the
symmetric difference as well, and what remains is verified on the whole sets.

Sets are named by a 64-bit hash of their shingles (a node); equal sets are one node, however many copies there are. Within a part's bucket
all nodes are compared with one leader first. Only where that leaves a bucket in several components, nodes are compared with the nearest node
(by sketch) of each other component, and in the end with all nodes of the components that are still different: no link that could join two
components is lost and no group is expanded into all its pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Words, checked_broadcast, fresh, grams, in_one_text, map_pieces, mix, stored, words_of

WORDS = 5
#: Sets under SMALL are looked up by single shingles. Size bands grow by GROWTH from there.
SMALL, GROWTH, SEEDS = 64, 1.5, 8
#: Ids sent to every executor at most (8 to 16 bytes each); beyond that, joins shuffle.
SENT = 2_000_000
#: Nodes of a bucket compared in one place; larger buckets are cut into blocks and compared block by block.
BLOCK = 4_096
#: Pairs that a task remembers to have handed on.
SEEN = 1_000_000
#: Tasks that the buckets of one leader are dealt out to (per pair of blocks).
DEALT = 8


@lru_cache(1)
def edges() -> np.ndarray:
    out = [0, SMALL]
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * GROWTH))
    return np.array(out, np.int64)


def band(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges(), n, "right") - 1


def n_parts(g: np.ndarray) -> np.ndarray:
    """Parts of a band: over a quarter of its largest set, with room for parts that stay empty."""
    differ = (edges()[g + 1] - 1) // 4
    return differ + differ // 10 + 12


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of each distinct shingle, in order; of fewer than five words the whole run is one."""
    places = np.flatnonzero(in_one_text(words.first, WORDS))
    value, doc = grams(words.hash, WORDS)[places], words.doc[places]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < WORDS))
    if len(short):
        whole = [grams(words.hash[words.first[i] : words.first[i + 1]], int(counts[i]))[0] + np.uint64(counts[i]) for i in short]
        value, doc = np.concatenate([value, mix(np.array(whole, np.uint64))]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], value[new]


def node_of(doc: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
    total = np.zeros(n_docs, np.uint64)
    np.add.at(total, doc, mix(value + np.uint64(0x5851F42D4C957F2D)))
    return mix(total).view(np.int64)


def parts(doc: np.ndarray, value: np.ndarray, group: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, XOR of a part tagged with band and part) of all parts that hold a shingle. ``group``: the band of each text, -1 for none."""
    some = np.flatnonzero(group > 0)
    sizes = np.zeros(len(group), np.int64)
    sizes[some] = n_parts(group[some])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    mine = group[doc] > 0
    d, v = doc[mine], value[mine]
    dealt = (mix(v + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % (1 << 64))) % sizes[d].astype(np.uint64)).astype(np.int64)
    total = np.zeros(begin[-1], np.uint64)
    np.bitwise_xor.at(total, begin[d] + dealt, v)
    full = np.flatnonzero(total)
    owner = np.searchsorted(begin, full, "right") - 1
    tag = (group[owner].astype(np.uint64) << np.uint64(40)) + (full - begin[owner]).astype(np.uint64) + (np.uint64(seed) << np.uint64(56))
    return owner, mix(total[full] ^ mix(tag))


def sketch_bits(n: int) -> int:
    bits = 64
    while bits < 2 * n:
        bits *= 2
    return bits


def sketches(doc: np.ndarray, value: np.ndarray, n_docs: int) -> list[bytes]:
    """Per text the parity of its shingles over two to four times as many bits; a wider sketch folds onto a narrower one."""
    counts = np.bincount(doc, minlength=n_docs)
    bits = np.array([sketch_bits(int(n)) for n in counts], np.int64)
    begin = np.concatenate([[0], np.cumsum(bits)])
    flags = np.zeros(begin[-1], np.uint8)
    at = (mix(value ^ np.uint64(0xD1B54A32D192ED03)) & (bits[doc] - 1).astype(np.uint64)).astype(np.int64)
    np.bitwise_xor.at(flags, begin[doc] + at, np.uint8(1))
    packed = np.packbits(flags, bitorder="little")
    return [packed[a:b].tobytes() if n else b"" for a, b, n in zip((begin[:-1] // 8).tolist(), (begin[1:] // 8).tolist(), counts.tolist())]


def fold(sketch: np.ndarray, words: int) -> np.ndarray:
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = words_of(column)
    doc, value = shingles(words)
    return doc, value, np.bincount(doc, minlength=len(column))


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, n, node, sketch, seed): the size and name of each set, its bit sketch, and the first hash seed that leaves few enough parts empty
    (the pigeonhole needs more parts with a shingle than shingles that may differ)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, value, counts = _lines(batch.column("text"))
        group = np.where(counts > 0, band(counts), -1)
        seed = np.zeros(len(counts), np.int32)
        wanting = group > 0
        for s in range(SEEDS):
            owner, _ = parts(doc, value, np.where(wanting, group, -1), s)
            wanting &= np.bincount(owner, minlength=len(counts)) <= counts // 4
            if not wanting.any():
                break
            seed[wanting] = s + 1
        nodes = pa.array(node_of(doc, value, len(counts)), mask=counts == 0)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(counts.astype(np.int64)), nodes, pa.array(sketches(doc, value, len(counts)), pa.binary()), pa.array(seed)],
            ["id", "n", "node", "sketch", "seed"],
        )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return map_pieces(rows, run, "id long, n long, node long, sketch binary, seed int")


def signatures(docs: DataFrame, text: str, seeds: int) -> DataFrame:
    """(sig, node): one row per part of each set, in its own band and in that of the smallest set it can be similar to."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, value, counts = _lines(batch.column("text"))
        nodes = node_of(doc, value, len(counts))
        own = np.where(counts > 0, band(counts), -1)
        low = np.where(counts > 0, band((4 * counts + 4) // 5), -1)
        single = (own == 0) | (low == 0)
        owners, sigs = [doc[single[doc]]], [mix(value[single[doc]] ^ np.uint64(0xA0761D6478BD642F))]
        for seed in range(seeds):
            for group in (own, np.where(low < own, low, -1)):
                owner, sig = parts(doc, value, group, seed)
                owners.append(owner)
                sigs.append(sig)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(sigs).view(np.int64)), pa.array(nodes[np.concatenate(owners)])], ["sig", "node"]
        )

    return map_pieces(docs.select(F.col(text).alias("text")), run, "sig long, node long")


def led(rows: DataFrame) -> DataFrame:
    """(sig, leader, node) of rows (sig, node): every further node of a bucket with the bucket's first. Buckets are read as sorted runs, none is
    held in memory."""

    def run(batches):
        carry = None  # signature, leader and last node of the run that is still open
        for batch in batches:
            sig, node = (batch.column(c).to_numpy() for c in ("sig", "node"))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            if carry and sig[0] == carry[0] and node[0] == carry[2]:
                new[0] = False
            starts = np.ones(len(sig), bool)
            starts[1:] = sig[1:] != sig[:-1]
            begin = np.flatnonzero(starts)
            leader = np.repeat(node[begin], np.diff(np.append(begin, len(sig))))
            if carry and sig[0] == carry[0]:
                leader[: begin[1] if len(begin) > 1 else len(sig)] = carry[1]
            keep = new & (node != leader)
            carry = (sig[-1], leader[-1], node[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, leader, node)], ["sig", "leader", "node"])

    return rows.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(run, "sig long, leader long, node long")


def _near(a: np.ndarray, b: np.ndarray, n: int, m: int) -> bool:
    """Can sets of sizes n and m with these sketches be similar?"""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    words = min(len(a), len(b))
    return int(np.bitwise_count(fold(a, words) ^ fold(b, words)).sum()) * 9 <= n + m


def sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sizes and sketches allow similarity."""
    left = classes.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    right = classes.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))

    def run(batches):
        for batch in batches:
            a, b = batch.column("su").to_pylist(), batch.column("sv").to_pylist()
            n, m = batch.column("nu").to_pylist(), batch.column("nv").to_pylist()
            keep = [_near(np.frombuffer(w, np.uint64), np.frombuffer(x, np.uint64), y, z) for w, x, y, z in zip(a, b, n, m)]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "u").join(right, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def sets_of(docs: DataFrame, key: str, text: str, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the whole sets of the ``wanted`` nodes, as sorted 64-bit numbers.

    Up to SENT nodes are sent to the executors, so that only their texts' sets are moved; beyond that all sets are and a join picks them.
    """
    names = stored(wanted.join(classes.select("node", "rep"), "node").select("node", "rep"))
    table = None
    if names.limit(SENT + 1).count() <= SENT:
        got = names.toArrow()
        node, rep = got.column("node").to_numpy(), got.column("rep").to_numpy()
        order = np.argsort(node)
        table = docs.sparkSession.sparkContext.broadcast((node[order], rep[order]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc, value, counts = _lines(batch.column("text"))
        nodes = node_of(doc, value, len(counts))
        keep = counts > 0
        if table is not None:
            node, rep = table.value
            if len(node):
                at = np.minimum(np.searchsorted(node, nodes), len(node) - 1)
                ids = batch.column("id").fill_null(-1).to_numpy(zero_copy_only=False)
                keep &= (node[at] == nodes) & (rep[at] == ids)
            else:
                keep[:] = False
        begin = np.searchsorted(doc, np.arange(len(counts) + 1))
        rows = np.flatnonzero(keep).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(nodes[rows]), pa.array([value[begin[i] : begin[i + 1]].tobytes() for i in rows], pa.binary())], ["node", "shingles"]
        )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter(F.col("id").isNotNull())
    found = map_pieces(rows, run, "node long, shingles binary")
    if table is None:
        found = found.join(names.select("node"), "node", "left_semi")
    return found.groupBy("node").agg(F.any_value("shingles").alias("shingles"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (u, v) of sets with 100 x intersection >= 80 x union."""

    def run(batches):
        for batch in batches:
            keep = []
            for a in range(0, batch.num_rows, 128):  # whole sets: few at a time as Python objects
                part = batch.slice(a, 128)
                for x, y in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
                    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    both = int((x[at] == y).sum())
                    keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable by ``links`` (u, v), for every node with a link.

    Alternating large and small stars: every round hangs neighbours on the smallest node of a neighbourhood, until only stars are left. Rounds
    grow with the logarithm of the longest path; edges are stored after each round and minima are summed before they are shuffled.
    """
    pairs = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs = stored(small.select("e.u", "e.v").filter("u <> v").distinct())
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )


def rest(buckets: DataFrame, tried: DataFrame, comps: DataFrame, classes: DataFrame, nearest: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) of one bucket and different components that may be similar and were not compared with a leader; and the buckets
    that were looked at (all others lie in one component).

    ``buckets``: (sig, leader, node). Only buckets where a node is outside its leader's component are looked at; a bucket of over BLOCK nodes is cut
    into blocks and every two blocks are compared in a task of their own. ``nearest``: nodes outside a bucket's largest component with the nearest
    node of every other one only.
    """
    of = comps.select(F.col("node").alias("c"), "comp")
    placed = lambda df, node, out: df.join(of.withColumnRenamed("comp", out), F.col(node) == F.col("c"), "left").withColumn(
        out, F.coalesce(out, node)).drop("c")
    apart = placed(placed(tried, "u", "cu"), "v", "cv").filter("cu <> cv").select(F.col("u").alias("leader"), F.col("v").alias("node"))
    open_ = buckets.join(checked_broadcast(stored(apart), SENT // 2), ["leader", "node"], "left_semi").select("sig").distinct()
    inside = stored(buckets.join(checked_broadcast(stored(open_), SENT), "sig", "left_semi"))
    nodes = inside.unionByName(inside.select("sig", "leader", F.col("leader").alias("node")).distinct())
    sizes = nodes.groupBy("sig").agg(F.count("*").alias("size")).filter("size > 2").select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    cut = nodes.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = placed(cut, "node", "comp").join(classes.select("node", "n", "sketch"), "node")
    # the buckets of one leader meet block by block, dealt out to a few tasks, so that a pair of many common buckets is handed on a few times
    keyed = cut.select("leader", F.pmod("sig", F.lit(DEALT)).alias("deal"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sig", "block", "node", "comp", "n", "sketch")

    def compare(rows: list[tuple]) -> tuple[list[int], list[int]]:
        width = min(len(r[4]) for r in rows)
        block, node, comp, n = (np.array([r[k] for r in rows]) for k in range(4))
        bits = np.stack([fold(np.frombuffer(r[4], np.uint64), width // 8) for r in rows])
        across = block.min() != block.max()
        us, vs = [], []
        if nearest:
            names, inverse, counts = np.unique(comp, return_inverse=True, return_counts=True)
            for i in np.flatnonzero(inverse != counts.argmax()).tolist():
                ok = (comp != comp[i]) & (5 * np.minimum(n[i], n) >= 4 * np.maximum(n[i], n))
                if across:
                    ok &= block != block[i]
                at = np.flatnonzero(ok)
                far = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
                near = 9 * far <= n[i] + n[at]
                at, far = at[near], far[near]
                at = at[np.lexsort((node[at], far))]
                at = at[np.unique(comp[at], return_index=True)[1]]
                us += [int(node[i])] * len(at)
                vs += node[at].tolist()
            return us, vs
        for i in range(len(rows) - 1):
            ok = (comp[i + 1 :] != comp[i]) & (5 * np.minimum(n[i], n[i + 1 :]) >= 4 * np.maximum(n[i], n[i + 1 :]))
            if across:
                ok &= block[i + 1 :] != block[i]
            at = np.flatnonzero(ok) + i + 1
            at = at[9 * np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64) <= n[i] + n[at]]
            us += [int(node[i])] * len(at)
            vs += node[at].tolist()
        return us, vs

    def run(batches):
        key, rows, seen = None, [], set()

        def fresh_pairs():
            if len(seen) > SEEN:
                seen.clear()  # pairs may then be handed on again
            new = {(min(a, b), max(a, b)) for a, b in zip(*compare(rows))} - seen if len(rows) > 1 else set()
            seen.update(new)
            return sorted(new)

        def out(pairs):
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            pairs: list[tuple[int, int]] = []
            columns = [batch.column(c).to_pylist() for c in ("leader", "deal", "i", "j", "sig", "block", "node", "comp", "n", "sketch")]
            for *task, sig, block, node, comp, n, sketch in zip(*columns):
                if key != (task, sig):
                    pairs += fresh_pairs()
                    if key is None or task != key[0]:
                        seen.clear()
                    key, rows = (task, sig), []
                rows.append((block, node, comp, n, sketch))
            yield out(pairs)
        yield out(fresh_pairs())

    dealt = ["leader", "deal", "i", "j"]
    spread = keyed.repartition(*dealt).sortWithinPartitions(*dealt, "sig")
    return spread.mapInArrow(run, "u long, v long").distinct(), inside


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the size of its set and the smallest id reachable by links, its own included.

    Two rows link where 100 x intersection >= 80 x union of their shingles. Rows without words link with nothing. Equal texts are one node, so groups of
    copies are not expanded. Rows with a null id keep a null component and link nothing; rows with one id and different texts are different nodes. Other
    columns are not read, an empty table gives an empty result. Equal 64-bit hashes are taken for equal shingles.
    """
    base = stored(describe(docs, key, text))
    own = base.filter("id IS NOT NULL AND node IS NOT NULL")
    classes = stored(own.groupBy("node").agg(F.min("id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")))
    seeds = own.agg(F.coalesce(F.max("seed"), F.lit(0)).alias("s")).first()["s"] + 1
    if seeds > SEEDS:
        raise ValueError("no hash seed spreads a set over its parts")
    with_id = docs.filter(F.col(key).isNotNull())
    buckets = stored(led(signatures(with_id, text, seeds)))
    tried = stored(buckets.select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = stored(sifted(pairs, classes))
        wanted = pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct()
        return stored(verified(pairs, sets_of(docs, key, text, classes, wanted)))

    links = linked(tried)
    comps = stored(components(links))
    for nearest in (True, False):
        more, buckets = rest(buckets, tried, comps, classes, nearest)
        more = stored(more)
        if more.take(1):
            links = links.unionByName(linked(more))
            comps = stored(components(links))
    of = comps.join(classes.select("node", "rep"), "node")
    least = of.groupBy("comp").agg(F.min("rep").alias("least"))
    group = stored(classes.select("node", "rep").join(comps, "node", "left").join(least, "comp", "left").select(
        F.col("node"), F.coalesce("least", "rep").alias("component")
    ))
    named = own.join(group, "node").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = base.filter("id IS NULL OR node IS NULL").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"))
    return named.unionByName(alone)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies stays, that with the smallest id; columns as they came.

    Rows without words or without an id stay. Of rows repeated under one id one stays for each group it belongs to. Texts are not shuffled where the
    ids to drop are few enough to be sent to the executors.
    """
    groups = stored(near_copies(docs, key, text))
    gone, twice = fresh(docs, "gone", "twice")
    drop = checked_broadcast(stored(groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(gone)).distinct()), SENT)
    left = docs.join(drop, F.col(f"`{key}`").cast("long") == F.col(gone), "left_anti")
    again = stored(groups.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(twice)))
    if not again.take(1):
        return left
    again = checked_broadcast(again, SENT)
    same: Column = F.col(f"`{key}`").cast("long") == F.col(twice)
    return left.join(again, same, "left_anti").unionByName(left.join(again, same, "left_semi").dropDuplicates([key]))
