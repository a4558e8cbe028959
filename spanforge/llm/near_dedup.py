"""Near-duplicate documents by MinHash (operator 5).

A document's set holds its distinct shingles of five lower-cased words.  Equal sets become
one node.  128 minima under universal hash functions are cut into 32 bands of four (a pair
at similarity 0.85 shares none with probability 5e-11, at 0.8 with 5e-8).  Nodes that share
a band are held against each other: by signature first, then on full sets; components come from
alternating stars.

No group is expanded into its pairs.  Bands of up to ``SMALL`` nodes give only the pairs
whose signatures agree enough, each at the first band the two share.  Larger bands are cut
into blocks: inside a block all similarities come from one product of incidence matrices,
and only a spanning forest of its links leaves the task.  Members of bands that then still
hold several classes are held against each other by prefixes: shingles of more than ``RARE``
of these members come last in order, and of two sets that reach the limit the smallest common
shingle stands among the first ones of both, so only members that share such a shingle are
verified (few blocks are simply all compared, which costs less).  What very many texts have in common (a template, a passage) thus pairs nobody, and
what is left over are sets made almost only of common shingles; these alone are compared
block by block.  Members that are already connected are not compared again, so a huge group
of copies costs in proportion to its size.

Defined results: a null or blank text has an empty set, is linked with nothing and kept;
repeated rows have equal sets and share a component; rows with the same id are one document,
so all its sets are linked and its rows share a component; a null id is left out of linking
(component null, kept); ties go to the smallest id; columns beside id and text are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanforge.llm.bytetext import Bytes, mix, shingles, slices, tidy
from spanforge.llm.components import connected_components
from spanforge.llm.minhash import bands, minima
from spanforge.llm.storage import dropped, written

HASHES, ROWS = 128, 4
PERCENT = 85
SMALL = 32
BLOCK = 96
FEW_PAIRS = 200_000
RARE = 64
BROADCAST_IDS = 1_000_000


def least_agreeing(percent: int) -> int:
    """Agreeing minima below which a pair is not checked further; one at the limit reaches it but for 1e-12."""
    p, n, below = percent / 100, 0, 0.0
    while n < HASHES and (below := below + comb(HASHES, n) * p**n * (1 - p) ** (HASHES - n)) <= 1e-12:
        n += 1
    return n


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle) sorted by both, shingles per text, and a 64-bit name of each text's set."""
    b = Bytes(texts, lower=True)
    doc, code = shingles(b.words(), b.n)
    count = np.bincount(doc, minlength=b.n)
    begin = np.cumsum(count) - count
    one, two = np.zeros(b.n, np.uint64), np.zeros(b.n, np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        one[full] = np.add.reduceat(code, begin[full])
        two[full] = np.add.reduceat(code * (code | np.uint64(1)), begin[full])
    return doc, code, count, mix(one ^ mix(two ^ mix(count.astype(np.uint64)))).view(np.int64)


def node_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, node (the name of the set) and the signature."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            doc, code, count, node = _features(part.column(1))
            sig = minima(doc, code, len(node), HASHES)
            sig_col = pa.FixedSizeBinaryArray.from_buffers(pa.binary(HASHES * 4), len(node), [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count.astype(np.int64)), pa.array(node), sig_col], names=["doc_id", "n_shingles", "node", "sig"])

    return src.mapInArrow(tidy(run), "doc_id long, n_shingles long, node long, sig binary")


def band_keys(nodes: DataFrame) -> DataFrame:
    """(key, node), one row a band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                keys = bands(_matrix(part.column(1)), ROWS)
                node = np.repeat(part.column(0).to_numpy(zero_copy_only=False), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return nodes.select("node", "sig").mapInArrow(tidy(run), "key long, node long")


def _matrix(sigs: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(len(sigs), HASHES)


def node_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, codes) of all sets of the wanted documents (one column of ids), read from their texts again."""
    src = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    few = ids.count() <= BROADCAST_IDS
    src = src.join(F.broadcast(ids) if few else ids, "rep", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            _, code, count, node = _features(part.column(1))
            at = np.concatenate([[0], np.cumsum(count)])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([code[at[i] : at[i + 1]].tobytes() for i in range(len(node))], pa.binary())], names=["node", "codes"])

    return src.mapInArrow(tidy(run), "node long, codes binary")


def small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of small bands whose signatures agree, each at the lowest key that both share.

    members: (key, node, sig), a few nodes a key.
    """
    least = least_agreeing(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            keys = t.column(0).to_numpy()
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # sorted; the last key may go on
            rest = t.slice(cut)
            if cut:
                yield _pairs(t.slice(0, cut), least)
        if rest is not None and rest.num_rows:
            yield _pairs(rest, least)

    dealt = members.repartition("key").sortWithinPartitions("key").select("key", "node", "sig")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def _pairs(t: pa.Table, least: int) -> pa.RecordBatch:
    key, node = t.column(0).to_numpy(), t.column(1).to_numpy()
    sig = _matrix(t.column(2).combine_chunks())
    found_a, found_b = [], []
    for shift in range(1, SMALL):
        i = np.flatnonzero(key[shift:] == key[:-shift]) if shift < len(key) else []
        if not len(i):
            break
        for at in range(0, len(i), 8192):
            x, y = i[at : at + 8192], i[at : at + 8192] + shift
            same = sig[x] == sig[y]
            agree = same.sum(1) >= least
            x, y, same = x[agree], y[agree], same[agree]
            if not len(x):
                continue
            shared = same.reshape(len(x), -1, ROWS).all(2)
            lowest = np.where(shared, bands(sig[x], ROWS), np.iinfo(np.int64).max).min(1)
            first = (lowest == key[x]) & (node[x] != node[y])
            found_a.append(np.minimum(node[x], node[y])[first])
            found_b.append(np.maximum(node[x], node[y])[first])
    cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
    return pa.RecordBatch.from_arrays([cat(found_a), cat(found_b)], names=["a", "b"])


def exact_links(pairs: DataFrame, sets: DataFrame, percent: int, sets_of: Callable | None = None) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sets_of or stored_sets
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                keep = []
                for p, q in zip(of(pa.chunked_array([part.column(2)])), of(pa.chunked_array([part.column(3)])), strict=True):
                    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        keep.append(False)
                        continue
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    withs = pairs.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("ca")), "a").join(sets.select(F.col("node").alias("b"), F.col("codes").alias("cb")), "b")
    return withs.select("a", "b", "ca", "cb").mapInArrow(tidy(run), "a long, b long")


def forest(node: np.ndarray, group: np.ndarray, codes: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """For the groups that links join, a star from the smallest member to one member of each."""
    m = len(node)
    size = np.array([len(c) for c in codes], np.float32)
    owner = np.repeat(np.arange(m), [len(c) for c in codes])
    _, column, times = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    use = times[column] > 1
    owner, column = owner[use], column[use]
    _, column = np.unique(column, return_inverse=True)
    both = np.zeros((m, m), np.float32)
    for lo in range(0, int(column.max(initial=-1)) + 1, 8192):
        part = (column >= lo) & (column < lo + 8192)
        x = np.zeros((m, 8192), np.float32)
        x[owner[part], column[part] - lo] = 1
        both += x @ x.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    linked &= (size > 0)[:, None] & (group[:, None] != group[None, :])
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    by_group: dict[int, int] = {}
    for i, g in enumerate(group.tolist()):  # a group is connected already
        root[find(i)] = find(by_group.setdefault(g, i))
    before = [find(i) for i in range(m)]
    for i, j in zip(*np.nonzero(np.triu(linked, 1)), strict=True):
        root[find(int(j))] = find(int(i))
    centre: dict[int, int] = {}
    for i in np.argsort(node, kind="stable").tolist():
        centre.setdefault(find(i), i)
    one_of = {before[i]: i for i in range(m)}  # of each group before
    return [(int(node[centre[find(i)]]), int(node[i])) for g, i in one_of.items() if g != before[centre[find(i)]]]


def stored_sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def block_links(blocks: DataFrame, percent: int, sets_of: Callable = stored_sets) -> DataFrame:
    """Links inside blocks of (block columns g1, g2, g3; node, grp, codes)."""

    def run(table: pa.Table) -> pa.Table:
        codes = sets_of(table.column("codes"))
        got = forest(table.column("node").to_numpy(), table.column("grp").to_numpy(), codes, percent)
        return pa.table({"a": pa.array([x for x, _ in got], pa.int64()), "b": pa.array([y for _, y in got], pa.int64())})

    return blocks.groupBy("g1", "g2", "g3").applyInArrow(run, "a long, b long")


def prefixes(nodes: DataFrame, sets: DataFrame, percent: int, sets_of: Callable) -> DataFrame:
    """(node, grp, size, code, place, need): the first shingles of each node's set, those of at most RARE
    nodes, in order of their hash; need of them decide whether it can reach the limit with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                codes = sets_of(pa.chunked_array([part.column(2)]))
                n = np.array([len(c) for c in codes], np.int64)
                node, grp = (np.repeat(part.column(k).to_numpy(zero_copy_only=False), n) for k in (0, 1))
                code = np.concatenate([*codes, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(grp), pa.array(np.repeat(n, n)), pa.array(code)], names=["node", "grp", "size", "code"])

    every = written(nodes.join(sets, "node").select("node", "grp", "codes").mapInArrow(tidy(run), "node long, grp long, size long, code long"), "crowd")
    common = written(every.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > RARE).select("code"), "common")
    rare = every.join(F.broadcast(common) if common.count() <= BROADCAST_IDS else common, "code", "left_anti")
    place = F.row_number().over(W.partitionBy("node").orderBy("code"))
    first = rare.select("*", place.alias("place"), F.expr(f"size * {100 - percent} div 100 + 1").alias("need")).where("place <= need")
    first = written(first, "prefixes")
    dropped(every, common)
    return first


def prefix_pairs(first: DataFrame, percent: int) -> DataFrame:
    """Pairs of different classes that share a shingle of their prefixes and are of fitting sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            codes = t.column(0).to_numpy()
            cut = int(np.searchsorted(codes, codes[-1])) if len(codes) else 0  # sorted; the last code may go on
            rest = t.slice(cut)
            if cut:
                yield found(t.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield found(rest)

    def found(t: pa.Table) -> pa.RecordBatch:
        code, node, grp, size = (t.column(k).to_numpy() for k in range(4))
        out = [np.zeros((2, 0), np.int64)]
        for shift in range(1, RARE):
            i = np.flatnonzero(code[shift:] == code[:-shift]) if shift < len(code) else []
            if not len(i):
                break
            j = i + shift
            fit = (grp[i] != grp[j]) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
            x, y = node[i[fit]], node[j[fit]]
            out.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1))
        pair = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    dealt = first.repartition("code").sortWithinPartitions("code").select("code", "node", "grp", "size")
    return dealt.mapInArrow(tidy(run), "a long, b long").distinct()


def large_links(members: DataFrame, sets: DataFrame, links: DataFrame, percent: int, sets_of: Callable = stored_sets, exact: Callable | None = None) -> DataFrame:
    """Links of large bands, beyond those known.  members: (key, node, n); sets: (node, codes),
    where sets_of makes a list of distinct hashes from a column of codes, and exact(pairs) tells the
    similar ones among pairs of nodes.
    """
    exact = exact or (lambda pairs: exact_links(pairs, sets, percent, sets_of))
    # First inside blocks, each band with a dealing of its own.
    parts = F.ceil(F.col("n") / BLOCK)
    first = members.select("node", F.col("key").alias("g1"), F.pmod(F.xxhash64("key", "node"), parts).alias("g2"), F.lit(0).cast("long").alias("g3"))
    inner = block_links(first.join(sets, "node").withColumn("grp", F.col("node")), percent, sets_of)
    links = written(links.unionByName(inner), "links")
    # Then by prefixes, over all bands that still hold several classes; classes go on as their stars.
    grouped, stars = _by_class(members, links)
    mixed = written(_mixed(grouped), "mixed")
    bands = mixed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    work = bands.agg(F.sum(F.col("blocks") * F.col("blocks"))).first()[0]
    if not work:
        return stars
    if work <= FEW_PAIRS:  # comparing all blocks costs less than prefixes would
        between = between_blocks(mixed, sets, percent, sets_of)
        return stars if between is None else written(stars.unionByName(between), "links")
    crowd = written(mixed.select("node", "grp").distinct(), "crowd")
    prefix = prefixes(crowd, sets, percent, sets_of)
    links = written(stars.unionByName(exact(prefix_pairs(prefix, percent))), "links")
    # Then between blocks of those whose rare shingles are too few to tell.
    left = written(crowd.select("node").join(prefix.where("place = need").select("node"), "node", "left_anti"), "left")
    dropped(grouped, mixed, crowd, prefix)
    if left.isEmpty():
        return links
    rest = members.join(F.broadcast(left) if left.count() <= BROADCAST_IDS else left, "node", "left_semi")
    grouped, stars = _by_class(rest, links)
    between = between_blocks(grouped, sets, percent, sets_of)
    return stars if between is None else written(stars.unionByName(between), "links")


def _by_class(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, grp): members with the class that the links give them; and the classes as links (a, b)."""
    comp = connected_components(links)
    grouped = written(members.join(comp, "node", "left").select("key", "node", F.coalesce("component", "node").alias("grp")), "grouped")
    return grouped, comp.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a <> b")


def _mixed(grouped: DataFrame) -> DataFrame:
    """Members of the bands that hold several classes."""
    mixed = written(grouped.groupBy("key").agg(F.min("grp").alias("a"), F.max("grp").alias("z")).where("a <> z").select("key"), "mixed")
    return grouped.join(F.broadcast(mixed) if mixed.count() <= BROADCAST_IDS else mixed, "key")


def between_blocks(grouped: DataFrame, sets: DataFrame, percent: int, sets_of: Callable) -> DataFrame | None:
    """Links between the classes of each band, block by block; null where no band holds several."""
    sizes = written(grouped.groupBy("key", "grp").agg(F.count("*").alias("m")), "groups")
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.sum(F.when(F.col("m") <= BLOCK, F.col("m"))).alias("rest")).where("classes > 1")
    if mixed.isEmpty():
        return None
    # A large class has blocks of its own, which need no comparison among themselves; small ones share blocks.
    alone = F.col("m") > BLOCK
    own = F.ceil(F.col("m") / BLOCK)
    slots = sizes.join(mixed, "key").select(
        "key", "grp", F.when(alone, F.col("grp")).otherwise(F.lit(None)).alias("class"),
        F.when(alone, own).otherwise(F.greatest(F.lit(1), F.ceil(F.col("rest") / BLOCK))).alias("parts"), alone.alias("alone"),
    )
    slots = written(slots, "slots")
    placed = written(
        grouped.join(F.broadcast(slots) if slots.count() <= BROADCAST_IDS else slots, ["key", "grp"]).select("key", "node", "grp", "class", F.when(F.col("alone"), F.pmod(F.xxhash64("node"), "parts")).otherwise(F.pmod(F.xxhash64("grp"), "parts")).alias("part")),
        "placed",
    )
    blocks = placed.groupBy("key", "class", "part").agg(F.count("*").alias("m"), F.countDistinct("grp").alias("kinds"))
    blocks = written(blocks.withColumn("block", F.xxhash64(F.coalesce("class", F.lit(-1)), F.col("class").isNull(), "part")), "blocks")
    left, right = blocks.alias("l"), blocks.alias("r")
    within = blocks.where("kinds > 1").select("key", F.col("block").alias("b1"), F.col("block").alias("b2"))
    pairs = left.join(right, "key").where("l.block < r.block AND NOT (l.class <=> r.class AND l.class IS NOT NULL)").select("key", F.col("l.block").alias("b1"), F.col("r.block").alias("b2"))
    pairs = within.unionByName(pairs)
    sides = pairs.select("key", "b1", "b2", F.col("b1").alias("block")).unionByName(pairs.where("b1 <> b2").select("key", "b1", "b2", F.col("b2").alias("block")))
    rows = placed.withColumn("block", F.xxhash64(F.coalesce("class", F.lit(-1)), F.col("class").isNull(), "part")).join(sides, ["key", "block"])
    rows = rows.select("node", "grp", F.col("key").alias("g1"), F.col("b1").alias("g2"), F.col("b2").alias("g3")).join(sets, "node")
    found = written(block_links(rows, percent, sets_of), "between")
    dropped(sizes, slots, placed, blocks)
    return found


def same_ids(rows: DataFrame) -> DataFrame | None:
    """Links between the sets of each id with several rows, as stars; null where every id has one.

    rows: (doc_id, node), node null for an empty set.
    """
    several = written(rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z"), F.count("*").alias("n")).where("n > 1"), "repeated")
    if several.isEmpty():
        dropped(several)
        return None
    stars = rows.join(several.where("a <> z").select("doc_id", "a"), "doc_id").where("node <> a")
    return stars.select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    feats = written(node_features(docs, id_col, text_col), "features")
    usable = feats.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # rep: the smallest document with a set stands for it.
    reps = written(usable.groupBy("node").agg(F.min("doc_id").alias("rep")), "sets")
    stars = same_ids(feats.where("doc_id IS NOT NULL").select("doc_id", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")))
    nodes = usable.select(F.col("doc_id").alias("rep"), "node", "sig").join(reps, ["rep", "node"])
    nodes = written((nodes if stars is None else nodes.dropDuplicates(["node"])).select("rep", "node", "sig"), "nodes")
    keys = band_keys(nodes)
    # Written first: small ones are broadcast, and a shuffled join could be split at a crowded key.
    shared = written(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = written(keys.join(F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared, "key"), "members")
    wanted = written(members.select("node").distinct().join(reps, "node").select("rep").distinct(), "wanted")
    sets = node_sets(docs, wanted, id_col, text_col)
    # A repeated id may give a set several times.
    sets = written(sets if stars is None else sets.dropDuplicates(["node"]), "shingles")
    few = members.where(F.col("n") <= SMALL).join(nodes, "node").select("key", "node", "sig")
    pairs = written(small_pairs(few, percent), "pairs")
    links = exact_links(pairs, sets, percent)
    links = links if stars is None else links.unionByName(stars)
    large = members.where(F.col("n") > SMALL)
    links = written(links, "links") if large.isEmpty() else large_links(large, sets, links, percent)
    dropped(nodes, shared, members, wanted, sets, pairs)
    # Components by set, named by their smallest document; sets without a link by their own.
    linked = connected_components(links).join(reps, "node")
    least = written(linked.groupBy("component").agg(F.min("rep").alias("low")), "least")
    named = written(reps.join(linked.join(least, "component").select("node", "low"), "node", "left").select("node", F.coalesce("low", "rep").alias("component_id")), "named")
    light = feats.select("doc_id", "n_shingles", "node")
    alone = "n_shingles = 0 OR doc_id IS NULL"  # an empty set is linked with nothing, nor is a row without id
    out = light.where(f"NOT ({alone})").join(named, "node").select("doc_id", "n_shingles", "component_id")
    out = out.unionByName(light.where(alone).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    if stars is not None:  # an empty row of an id that has texts too
        ids = out.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("own"))
        out = out.join(ids, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("own", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def clean(docs: DataFrame, *, percent: int = PERCENT) -> DataFrame:
    """The kept documents with all their columns."""
    gone = written(near_duplicates(docs, percent=percent).where("NOT kept").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType)).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*docs.columns)
