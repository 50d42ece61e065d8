"""Near-duplicate detection by SuperMinHash, banding, verification on full shingle sets, and union-find grouping.

1. Every text becomes its set of distinct word shingles; equal sets are one node from here on (however many copies there are).
2. SuperMinHash: each shingle draws a random permutation of the slots, rank by rank (Fisher-Yates); its value in the j-th slot it
   reaches is j + a fraction. A slot filled at rank j cannot be improved later, so a text is done at the rank that fills its last slot.
3. Bands of ROWS slots give keys; nodes that share a key are candidates. A bucket is handled in bounded groups: all of it if it has
   at most GROUP nodes, else by the key of the next band as well, and by random groups that each also hold the same few pivots. In a
   group, pairs whose signatures agree in CLOSE of the slots or more (the threshold less about six deviations) are joined. What this
   leaves apart in a large bucket is then compared in full: its nodes outside the bucket's largest component, in blocks of about
   BLOCK, against blocks of all its nodes. So every pair that shares a band is compared or is in one component already; the random
   groups only save work. A bucket of n nodes that stay apart costs n * n comparisons, in tasks of bounded memory.
4. Clusters of candidates are connected components. Each set travels once to its cluster; there pairs are confirmed on the full sets
   and joined by union-find. A cluster with more than CHUNK shingles is split into chunks: inside each, then the nodes with the
   most links against all chunks, then all nodes that are still outside the cluster's largest component, as blocks of probes of
   about CHUNK shingles, each against each chunk. So any link between different components is found, no group of copies is expanded
   into its pairs, and a task holds one chunk and one block of probes (or one longer text), however many are outside.
5. Components of the confirmed links give each text its smallest doc_id.

Defined results: a null or empty text has no shingles, is linked with nothing and is its own component; a null doc_id takes part by
its text, its component is the smallest doc_id that is not null, or null if there is none; repeated rows are copies of each other;
ties cannot occur, as ids are compared. Two texts of similarity 0.8 share no band with probability (1 - 0.8**4)**32 < 1e-7.
Shingles are compared as 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlux.llm import _grams as G
from parlux.llm._durable import connected, durable, renamed, small_or_shuffled, tidied

#: Signature slots, rows of a band, and the least share of equal slots of a candidate pair.
SLOTS, ROWS, CLOSE = 128, 4, 0.6
BANDS = SLOTS // ROWS
#: Nodes in a group of one bucket; expected pivots of a bucket that is split.
GROUP, PIVOTS = 128, 12
#: Nodes on either side of a block comparison that finishes a split bucket.
BLOCK = 1024
#: Shingles in a chunk of a cluster, and how many of its best-linked nodes meet all its chunks first.
CHUNK, HUBS = 400_000, 32

_SIGNED = "doc_id long, text_key long, n_shingles long, node binary, bands array<long>, sig binary"


def shingles(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct n-word shingles of each document, sorted; a shorter text is one shingle of all its words."""
    start, end, doc = G.words(data, offs)
    hashes = G.Spans(data, lower=True).hash(start, end)
    at, keys = G.grams(hashes, doc, n)
    owner = doc[at]
    count = np.bincount(doc, minlength=len(offs) - 1)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(doc, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            short[more] = short[more] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[first[more] + k]
        owner, keys = np.concatenate([owner, few]), np.concatenate([keys, G.mix(short + count[few].astype(np.uint64))])
    order = np.argsort(keys)
    order = order[np.argsort(owner[order], kind="stable")]
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def superminhash(owner: np.ndarray, keys: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """The signatures, n_docs x slots: rank in the upper 32 bits, fraction in the lower."""
    best = np.full(n_docs * slots, np.iinfo(np.uint64).max, np.uint64)
    live, states, perms = owner, keys, None
    for rank in range(slots):
        states = states + np.uint64(0x9E3779B97F4A7C15)
        draw = G.mix(states)
        pick = rank + ((draw >> np.uint64(40)) % np.uint64(slots - rank)).astype(np.int64)
        if rank == 0:
            first = pick
            slot = pick
        else:
            if perms is None:
                perms = np.broadcast_to(np.arange(slots, dtype=np.uint8), (len(live), slots)).copy()
                perms[np.arange(len(live)), 0], perms[np.arange(len(live)), first] = first, 0
            at = np.arange(len(live))
            slot = perms[at, pick].astype(np.int64)
            perms[at, pick] = perms[:, rank]
            perms[:, rank] = slot
        value = np.uint64(rank << 32) | (draw & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, live * slots + slot, value)
        open_docs = (best.reshape(n_docs, slots) == np.iinfo(np.uint64).max).any(1)
        keep = open_docs[live]
        if not keep.any():
            break
        if not keep.all():
            live, states = live[keep], states[keep]
            if rank == 0:
                first = first[keep]
            else:
                perms = perms[keep]
    return best.reshape(n_docs, slots)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def _node(owner: np.ndarray, keys: np.ndarray, n_docs: int) -> np.ndarray:
    """128 bits that stand for each document's whole set, n_docs x 16 bytes."""
    out = np.zeros((n_docs, 2), np.uint64)
    np.add.at(out[:, 0], owner, G.mix(keys ^ np.uint64(0x5851F42D4C957F2D)))
    np.add.at(out[:, 1], owner, G.mix(keys + np.uint64(0x14057B7EF767814F)))
    return out.view(np.uint8).reshape(n_docs, 16)


def _sign(n: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in G.pieces(batch.column(1), 1 << 18):
                size = hi - lo
                owner, keys = shingles(data, offs, n)
                count = np.bincount(owner, minlength=size)
                sig = superminhash(owner, keys, size)
                mixed = np.zeros((size, BANDS), np.uint64)
                for k in range(ROWS):
                    mixed = G.mix(mixed + sig[:, k::ROWS])
                mixed = G.mix(mixed + np.arange(BANDS, dtype=np.uint64))
                has = pa.array(count == 0)
                short = np.ascontiguousarray((G.mix(sig) >> np.uint64(56)).astype(np.uint8))
                null = lambda column: pa.compute.if_else(has, pa.scalar(None, column.type), column)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, size * BANDS + 1, BANDS, dtype=np.int32)), pa.array(mixed.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, size), batch.column(2).slice(lo, size), pa.array(count), null(_binary(_node(owner, keys, size))), bands, _binary(short)], ["doc_id", "text_key", "n_shingles", "node", "bands", "sig"])

    return signed


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union-find over n places: the least place of each one's component."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _whole_groups(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by the key in the given column."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column(key).to_numpy()
        cut = int(np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))[-1])
        if rest and rest[-1].column(key)[-1].as_py() != ids[0]:
            yield pa.Table.from_batches(rest).combine_chunks()
            rest = []
        if cut:
            yield pa.Table.from_batches([*rest, batch.slice(0, cut)]).combine_chunks()
            rest = []
        rest.append(batch.slice(cut))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks()


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _fixed(column, width: int) -> np.ndarray:
    array = _one(column)
    offset = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, 4 * array.offset)
    return np.frombuffer(array.buffers()[2], np.uint8)[offset[0] : offset[-1]].reshape(-1, width)


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, node, sig) sorted by grp -> edges of a spanning forest of the close pairs of each group."""
    least = int(np.ceil(CLOSE * SLOTS))
    for table in _whole_groups(batches, 0):
        ids, sig, nodes = _one(table.column(0)).to_numpy(), _fixed(table.column(2), SLOTS), _one(table.column(1))
        end = np.searchsorted(ids, ids, "right")
        a, b, place = [], [], np.arange(len(ids))
        step = 1
        while len(place := place[place + step < end[place]]):
            for part in np.array_split(place, len(place) // 20_000 + 1):
                near = part[(sig[part] == sig[part + step]).sum(1) >= least]
                a.append(near)
                b.append(near + step)
            step += 1
        root = _labels(len(ids), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(ids))
        at = np.flatnonzero(root != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(root[at])), nodes.take(pa.array(at))], ["a", "b"])


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, probe, node, sig, root) sorted by grp -> edges that join, in each group, whatever close pairs of a probe and another node
    join over the roots."""
    least = int(np.ceil(CLOSE * SLOTS))
    for table in _whole_groups(batches, 0):
        ids, probe, nodes, sig = _one(table.column(0)).to_numpy(), _one(table.column(1)).to_numpy(zero_copy_only=False), _one(table.column(2)), _fixed(table.column(3), SLOTS)
        root = _one(table.column(4)).dictionary_encode().indices.to_numpy().copy()
        cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        a, b = [], []
        for lo, hi in zip(cuts, np.append(cuts[1:], len(ids)), strict=True):
            mine, place = root[lo:hi].copy(), np.flatnonzero(~probe[lo:hi])
            others = np.ascontiguousarray(sig[lo + place])
            for i in np.flatnonzero(probe[lo:hi]):
                # equal slots, eight bytes at a time: no byte's sum passes 16, nor their total 128
                equal = ((others == sig[lo + i]).view(np.uint64).sum(1) * np.uint64(0x0101010101010101)) >> np.uint64(56)
                near = place[(equal >= least) & (mine[place] != mine[i])]
                if len(near):
                    roots, first = np.unique(mine[near], return_index=True)
                    a += [lo + i] * len(first)
                    b += (lo + near[first]).tolist()
                    mine[np.isin(mine, roots)] = mine[i]
        take = lambda at: nodes.take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([take(a), take(b)], ["a", "b"])


def _sets(n: int):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in G.pieces(batch.column(1), 1 << 18):
                owner, keys = shingles(data, offs, n)
                ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=hi - lo))]).astype(np.int32) * 8
                column = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(keys))])
                yield pa.RecordBatch.from_arrays([_binary(_node(owner, keys, hi - lo)), column], ["node", "keys"])

    return made


def _confirm(threshold: float):
    """Rows (grp, probe, node, keys) sorted by grp -> links (a, b, degree of a) confirmed on the full sets.

    A group is a chunk of a cluster. Without probes every pair of it is decided, as far as the two are not joined already; with
    probes (a block of nodes that meets the chunk) only the pairs of a probe and a node of the chunk."""
    percent = round(100 * threshold)

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, 0):
            ids, probe, nodes = _one(table.column(0)).to_numpy(), _one(table.column(1)).to_numpy(zero_copy_only=False), _one(table.column(2))
            column = _one(table.column(3))
            ends = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64) // 8
            flat = np.frombuffer(column.buffers()[2], np.uint64)
            left, right, degree = [], [], []
            for lo, hi in zip(cuts := np.flatnonzero(np.append(True, ids[1:] != ids[:-1])), np.append(cuts[1:], len(ids)), strict=True):
                a, b, d = _links(flat[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo], probe[lo:hi], percent)
                left += [x + lo for x in a]
                right += [x + lo for x in b]
                degree += d
            take = lambda at: nodes.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([take(left), take(right), pa.array(degree, pa.int64())], ["a", "b", "degree"])

    return confirmed


def _links(flat: np.ndarray, ends: np.ndarray, probe: np.ndarray, percent: int) -> tuple[list[int], list[int], list[int]]:
    m, sizes = len(ends) - 1, np.diff(ends)
    if m < 2:
        return [], [], []
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(flat, kind="stable")
    ranked, holder = flat[order], owner[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    posting = np.empty(len(flat), np.int64)
    posting[order] = np.cumsum(new) - 1
    first = np.append(np.flatnonzero(new), len(flat))
    root = np.arange(m)
    a, b, degree = [], [], []
    any_probe = probe.any()
    for i in np.flatnonzero(probe) if any_probe else range(m):
        if not any_probe and (root == root[i]).all():
            continue
        mine = posting[ends[i] : ends[i + 1]]
        start, length = first[mine], first[mine + 1] - first[mine]
        at = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        both = np.bincount(holder[at], minlength=m)
        linked = 100 * both >= percent * (sizes + sizes[i] - both)
        linked &= ~probe  # probes meet each other where the other one is in the chunk
        linked[i] = False
        fresh = np.flatnonzero(linked & (root != root[i]))
        count = int(linked.sum())
        if len(fresh):
            low = min(root[i], root[fresh].min())
            root[np.isin(root, np.append(root[fresh], root[i]))] = low
        # one link to every component that is new to this node, and one at least that tells its degree
        for x in fresh:
            a.append(int(i))
            b.append(int(x))
            degree.append(count)
    return a, b, degree


def _candidates(signed: DataFrame) -> DataFrame:
    """(node, root): components that hold every pair of nodes that may be linked."""
    nodes = signed.where("node is not null").select("node", "bands", "sig").dropDuplicates(["node"])
    keys = nodes.select("node", F.posexplode("bands").alias("band", "key"), "bands").select("node", "key", F.xxhash64("key", F.get("bands", (F.col("band") + 1) % BANDS)).alias("finer"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = durable(keys.join(shared, "key"))  # once, for its uses
    finer = members.where(F.col("n") > GROUP)
    sizes = finer.groupBy("finer").agg(F.count("*").alias("m"))
    token = lambda key: F.xxhash64(F.lit("group"), key, "node")
    dealt = lambda key, n: F.explode(F.when(F.pmod(F.xxhash64(F.lit("pivot"), key, "node"), n) < PIVOTS, F.sequence(F.lit(0), F.ceil(n / GROUP).cast("int") - 1)).otherwise(F.array(F.pmod(token(key), F.ceil(n / GROUP)).cast("int"))))
    small = members.where(F.col("n") <= GROUP).select(F.col("key").alias("grp"), "node")
    wide = finer.select("key", "node", dealt("key", F.col("n")).alias("part")).select(F.xxhash64("key", "part").alias("grp"), "node")
    fine = finer.join(sizes, "finer").where("m > 1").select("finer", "node", F.when(F.col("m") > GROUP, F.pmod(token("finer"), F.ceil(F.col("m") / GROUP))).otherwise(F.lit(0)).alias("part")).select(F.xxhash64("finer", "part").alias("grp"), "node")
    grouped = small.unionByName(wide).unionByName(fine).join(nodes.select("node", "sig"), "node").select("grp", "node", "sig")
    edges = durable(_by_group(grouped, ["grp"]).mapInArrow(tidied(_close_pairs), "a binary, b binary").distinct())
    roots = durable(connected(edges))
    if not finer.take(1):
        return roots
    more = durable(_apart(finer.select("key", "node", "n"), roots, nodes.select("node", "sig")))
    return durable(connected(edges.union(more))) if more.take(1) else roots


def _apart(split: DataFrame, roots: DataFrame, sigs: DataFrame) -> DataFrame:
    """Edges (a, b) that the buckets split (key, node, n) still lack: of close pairs of one bucket whose roots differ."""
    state = durable(split.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    main = state.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("all"), F.max("c").alias("most"))
    open_ = durable(main.where("most < all").select("key", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("sides"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")))
    state = state.join(open_, "key")
    place = lambda name, k: F.pmod(F.xxhash64(F.lit(name), "key", "node"), F.col(k)).cast("int").alias(name)
    every = lambda name, k: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(name)
    probes = state.where("root <> main").select("key", "node", "root", F.lit(True).alias("probe"), place("side", "sides"), every("block", "blocks"))
    rest = state.select("key", "node", "root", F.lit(False).alias("probe"), every("side", "sides"), place("block", "blocks"))
    rows = probes.unionByName(rest).join(sigs, "node").select(F.xxhash64("key", "side", "block").alias("grp"), "probe", "node", "sig", "root")
    return _by_group(rows, ["grp"]).mapInArrow(tidied(_block_pairs), "a binary, b binary").distinct()


def _by_group(df: DataFrame, keys: list[str], more: list[str] | None = None) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys, *(more or []))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id and kept (doc_id is component_id), and further
    text_key (a hash of the text) and root (the component's key; null without shingles).

    n: words in a shingle; threshold: the least Jaccard similarity of linked texts, in hundredths."""
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    signed = durable(source.mapInArrow(tidied(_sign(n)), _SIGNED))
    clusters = _candidates(signed).withColumnRenamed("root", "cluster")
    links = _confirmed_links(source, signed, clusters, n, threshold)
    roots = connected(links)
    named = signed.select("doc_id", "text_key", "n_shingles", "node")
    linked = roots.join(named.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")), "node", "right").select("node", F.coalesce("root", "node").alias("root"), "least")
    linked = durable(linked)
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = linked.join(least, "root").select("node", "root", "component_id")
    out = named.join(by_node, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key", "root")


def _confirmed_links(source: DataFrame, signed: DataFrame, clusters: DataFrame, n: int, threshold: float) -> DataFrame:
    sizes = signed.join(clusters, "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.first("n_shingles").alias("n"), F.first("cluster").alias("cluster"))
    sizes = durable(sizes)
    whole = sizes.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    placed = durable(sizes.join(whole, "cluster").select("node", "row", "n", "cluster", "chunks", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk")))
    wanted = placed.select(F.col("row.doc_id").alias("_id"), F.col("row.text_key").alias("_key"))
    texts = source.join(small_or_shuffled(wanted), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_semi")
    full = texts.mapInArrow(tidied(_sets(n)), "node binary, keys binary")
    sets = full.join(placed.drop("row"), "node").dropDuplicates(["node"])
    schema, group = "a binary, b binary, degree long", F.xxhash64("cluster", "chunk")
    rows = sets.select(group.alias("grp"), F.lit(False).alias("probe"), "node", "keys")
    links = durable(_by_group(rows, ["grp"]).mapInArrow(tidied(_confirm(threshold)), schema))
    large = placed.where("chunks > 1")
    if not large.take(1):
        return links.select("a", "b")
    # several chunks: what is best linked meets every chunk first, then whatever is still outside the largest component
    sets = durable(sets.where("chunks > 1"))

    def probed(chosen: DataFrame) -> DataFrame:
        """Links of the chosen nodes: blocks of them against the chunks of their clusters."""
        probes = sets.join(small_or_shuffled(durable(chosen.select("node"))), "node", "left_semi")
        blocks = probes.groupBy("cluster").agg(F.ceil(F.sum("n") / CHUNK).cast("int").alias("blocks"))
        blocks = small_or_shuffled(durable(blocks))
        every = lambda k, name: F.explode(F.sequence(F.lit(0), F.col(k) - 1)).alias(name)
        asks = probes.join(blocks, "cluster").select("cluster", every("chunks", "chunk"), F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("blocks")).cast("int").alias("block"), F.lit(True).alias("probe"), "node", "keys")
        held = sets.join(blocks, "cluster").select("cluster", "chunk", every("blocks", "block"), F.lit(False).alias("probe"), "node", "keys")
        rows = asks.unionByName(held).select(F.xxhash64("cluster", "chunk", "block").alias("grp"), "probe", "node", "keys")
        return _by_group(rows, ["grp"]).mapInArrow(tidied(_confirm(threshold)), schema).where("a <> b")

    top = links.groupBy(F.col("a").alias("node")).agg(F.max("degree").alias("degree")).join(large, "node")
    best = top.groupBy("cluster", (F.pmod(F.xxhash64(F.lit("hub"), "node"), F.lit(HUBS))).alias("seat")).agg(F.max_by("node", F.struct("degree", "node")).alias("node"))
    links = durable(links.unionByName(probed(best)))
    roots = connected(links)
    state = large.join(roots, "node", "left").select("node", "cluster", F.coalesce("root", "node").alias("root"))
    most = state.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    outside = durable(state.join(most, "cluster").where("root <> main").select("node"))
    if not outside.take(1):
        return links.select("a", "b")
    return links.unionByName(durable(probed(outside))).select("a", "b")


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns as they were, with one document of each component: that of the smallest doc_id (an id that is
    not null goes before null; the smaller hash of the text decides between rows of one id). Rows that repeat both id and text
    collapse into one. Texts without words all stay."""
    found = durable(near_duplicates(docs, n, threshold).select("doc_id", "text_key", "root"))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    first = found.where("root is not null").groupBy("root").agg(F.min(rank).alias("first"))
    lost = found.join(first, "root").where(rank != F.col("first")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    lost = durable(lost)
    rows, at, back = renamed(docs)
    same = F.col(at["doc_id"]).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(at["text"]).cast("string")) == F.col("_key"))
    rest = rows.join(small_or_shuffled(lost), same, "left_anti")
    again = found.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1")
    return back(rest.dropDuplicates([at["doc_id"], at["text"]]) if again.take(1) else rest)


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
