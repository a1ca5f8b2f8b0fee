"""Operator 6: near-duplicate groups by an LSH forest over MinHash signatures.

1. Every text gives the set of its word shingles and a signature of ``TREES x DEPTH`` minima, one label of ``DEPTH`` minima per tree.
   Documents with equal sets become one node.
2. Every tree is a sorted order of its labels, cut into ranges.  Each label is compared with the one before it, over the ends of ranges, too:
   neighbours whose common prefix is at least ``LEAST`` minima long are candidates of each other, and so is everything between them.
   What candidates reach over all trees is a region.  Only the sets of its nodes are formed again.
3. A region of up to ``REGION`` nodes is solved in one task.  A larger one asks for a prefix longer by one, and falls into smaller regions,
   until these fit or the labels end: each region has a depth of its own.  What is too large at full depth is cut along ``ORDERS`` of
   the trees into blocks of neighbours.
4. In a region or block all pairs whose sizes and signatures allow the similarity are compared on full sets, nearest first, unless links
   found so far connect them already.
5. Pairs of a large region that deeper prefixes and blocks left apart meet by their rare shingles: similar sets share one of their rarest, so each node is
   listed under those, lists within one group are passed over, long lists are split, and the pairs that meet are compared on full sets.
   The links' components are the groups.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabprofile.llm.common import HASH_BLOCK, mix64, pieces, powers, spread
from tabprofile.llm.graphs import components
from tabprofile.session import materialise, shuffle_partitions

TREES, DEPTH, LEAST = 16, 6, 3
#: Nodes of a region or block that are compared with each other.
REGION = 1024
#: Trees whose order cuts a region that is too large at full depth.
ORDERS = 4
#: Slots over which the shingles of large regions are counted to tell rare from common ones.
SLOTS = 1 << 20
#: Standard deviations of the signatures' estimate below the threshold at which a pair is still compared.
SLACK = 6.0
_NO_ID = -(1 << 63)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FACTORS = np.random.default_rng(6).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's different shingles; a shorter text is one shingle as a whole, none without words."""
    data = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    ends = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    up, down, values = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    word = mix64((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    rolled = word.copy()
    for j in range(1, words):
        rolled = rolled[:-1] * _STEP + word[j:] if len(rolled) > 1 else rolled[:0]
    rolled = mix64(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            s = np.sort(rolled[a: b - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            whole = np.full(min(b - a, 1), b - a, np.uint64)
            for w in word[a:b]:
                whole = whole * _STEP + w
            out.append(mix64(whole))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima of every non-empty set under each hash function: one row per set."""
    flat = np.concatenate(sets)
    heads = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.empty((len(sets), len(_FACTORS)), "<u4")
    for k, factor in enumerate(_FACTORS):
        out[:, k] = np.minimum.reduceat((flat * factor >> np.uint64(32)).astype(np.uint32), heads)
    return out


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in pieces(batches, HASH_BLOCK):
        yield batch, batch.column("text").to_pylist()


def _sign(words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _texts(batches):
            sets = shingle_sets(texts, words)
            full = [s for s in sets if len(s)]
            signed = iter(signatures(full)) if full else iter(())
            first, second, minima = [], [], []
            for s in sets:
                if not len(s):
                    first.append(0), second.append(0), minima.append(None)
                    continue
                first.append(int(mix64(s).sum(dtype=np.uint64).view("<i8")))
                second.append(int(mix64(s ^ _STEP).sum(dtype=np.uint64).view("<i8")))
                minima.append(next(signed).tobytes())
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), batch.column("hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array(first, pa.int64()),
                pa.array(second, pa.int64()), pa.array(minima, pa.binary()),
            ], ["id", "hash", "n", "d1", "d2", "minima"])

    return run


#: The column of a run's first node, for each depth.
_HEADS = [f"head{d}" for d in range(LEAST, DEPTH + 1)]


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range of the orders: each with the first node of its run of common prefixes, for every depth; runs of one give none.

    The first and the last row of a range come with their labels and the range's number, so that runs go on from range to range.
    """
    part = TaskContext.get().partitionId()
    last: tuple | None = None  # tree, label, node and heads of the row before
    depths = np.arange(LEAST, DEPTH + 1)

    def rows(node, heads, at=None, tree=None, label=None):
        n = len(node)
        ends = [pa.array([v] * n, t) for v, t in ((at, pa.int32()), (tree, pa.int32()), (label, pa.binary()))]
        return pa.RecordBatch.from_arrays([pa.array(node), *(pa.array(heads[:, k]) for k in range(len(_HEADS))), *ends], ["node", *_HEADS, "at", "tree", "label"])

    for batch in batches:
        if not batch.num_rows:
            continue
        node, tree = (batch.column(c).to_numpy().astype(np.int64) for c in ("node", "tree"))
        raw = batch.column("label").to_pylist()
        label = np.frombuffer(b"".join(raw), "<u4").reshape(-1, DEPTH)
        started = last is not None
        before = np.concatenate([last[1] if started else label[:1], label[:-1]])
        alike = tree == np.concatenate([[last[0] if started else -1], tree[:-1]])
        common = np.logical_and.accumulate((label == before) & alike[:, None], axis=1).sum(axis=1)
        opens = common[:, None] < depths
        at = np.maximum.accumulate(np.where(opens, np.arange(len(node))[:, None], -1), axis=0)
        heads = np.where(at < 0, last[3] if started else 0, node[at])
        if not started:
            yield rows(node[:1], heads[:1], 2 * part, int(tree[0]), raw[0])
        within = common >= LEAST
        yield rows(node[within], heads[within])
        last = int(tree[-1]), label[-1:], raw[-1], heads[-1], node[-1:]
    if last is not None:
        yield rows(last[4], last[3][None], 2 * part + 1, last[0], last[2])


def _forest(nodes: DataFrame) -> DataFrame:
    """``node`` and, per depth, a node in front of it in the order of some tree to which common prefixes of that length lead."""
    spark = nodes.sparkSession
    kinds = ", ".join(["node bigint", *(f"{h} bigint" for h in _HEADS), "at int, tree int, label binary"])
    labels = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "minima").select(
        "tree", F.substring(F.col("minima"), F.col("tree") * (DEPTH * 4) + 1, F.lit(DEPTH * 4)).alias("label"), "node")
    order = ("tree", "label", "node")
    ranges = labels.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    found = materialise(ranges.mapInArrow(_prefixes, kinds))
    # two rows a range: the end of one and the beginning of the next
    ends = sorted(found.where("at is not null").collect(), key=lambda r: r["at"])
    over = []
    for a, b in zip(ends[1::2], ends[2::2]):
        x, y = (np.frombuffer(r["label"], "<u4") for r in (a, b))
        common = int(np.logical_and.accumulate((x == y) & (a["tree"] == b["tree"])).sum())
        if common >= LEAST:
            over.append((b["node"], *(a[h] if common >= d else b["node"] for d, h in zip(range(LEAST, DEPTH + 1), _HEADS))))
    within = found.where("at is null").select("node", *_HEADS)
    return within.unionAll(spark.createDataFrame(over, within.schema)) if over else within


def _sets(words: int):
    """The set of each node, once per task however often its row is repeated."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches, HASH_BLOCK):
            new = []
            for node in batch.column("node").to_pylist():
                new.append(node not in seen)
                seen.add(node)
            batch = batch.filter(pa.array(new, pa.bool_()))
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("region"), batch.column("size"), batch.column("minima"),
                pa.array([s.tobytes() for s in (shingle_sets(texts, words) if texts else ())], pa.binary()),
            ], ["node", "region", "size", "minima", "shingles"])

    return run


def _links_within(nodes: np.ndarray, minima: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect the groups among some nodes: likely pairs are compared on full sets, nearest first."""
    n = len(nodes)
    if n < 2:
        return []
    size = np.array([len(s) for s in sets])
    least = _least_equal(percent, minima.shape[1])
    left, right, score = [], [], []
    for i in range(n - 1):
        fits = np.flatnonzero(100 * np.minimum(size[i], size[i + 1:]) >= percent * np.maximum(size[i], size[i + 1:])) + i + 1
        same = (minima[fits] == minima[i]).sum(axis=1)
        fits, same = fits[same >= least], same[same >= least]
        left.append(np.full(len(fits), i)), right.append(fits), score.append(same)
    left, right, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for k in np.argsort(-score, kind="stable").tolist():
        i, j = int(left[k]), int(right[k])
        a, b = root(i), root(j)
        if a == b:
            continue
        if _similar(sets[i], sets[j], percent):
            parent[a] = b
            out.append((int(nodes[i]), int(nodes[j])))
    return out


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    return (part["node"].to_numpy(), np.stack([np.frombuffer(m, "<u4") for m in part["minima"]]), [np.frombuffer(s, "<u8") for s in part["shingles"]])


_LINKS = "a bigint, b bigint"


def _solve_regions(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [link for _, part in pdf.drop_duplicates("node").groupby("region") for link in _links_within(*_arrays(part), percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _solve_blocks(percent: int, block: int):
    """Rows of a partition are sorted by region and one tree's signature order."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for frame in frames:
            held.append(frame)
            while sum(map(len, held)) >= 2 * block:
                rows = pd.concat(held, ignore_index=True)
                yield solve(rows[:block])
                held = [rows[block // 2:]]  # neighbouring blocks overlap by half
        if held:
            rows = pd.concat(held, ignore_index=True)
            for at in range(0, max(len(rows) - block // 2, 1), block // 2):
                yield solve(rows[at: at + block])

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        found = [link for _, part in rows.groupby("region") for link in _links_within(*_arrays(part), percent)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles fall on each slot, in chunks of slots."""
    found = np.zeros(SLOTS, np.int64)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), "<u8")
        found += np.bincount(_slots(flat), minlength=SLOTS)
    parts = found.reshape(-1, 1 << 14)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[k].astype("<i8").tobytes() for k in some], pa.binary())], ["chunk", "counts"])


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, "<i8") for c in pdf["counts"])
    return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].astype("int32"), "counts": [total.astype("<i8").tobytes()]})


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles * _STEP >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def _rarest(percent: int, counts):
    """A node's shingles in order of slot count and hash, so many that similar sets share one; any order that is one for all nodes is exact."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, HASH_BLOCK, "shingles"):
            tokens, sizes = [], []
            for region, data in zip(batch.column("region").to_pylist(), batch.column("shingles").to_pylist()):
                s = np.frombuffer(data, "<u8")
                order = np.lexsort([s, counts.value[_slots(s)]])[: len(s) + percent * len(s) // -100 + 1]
                tokens.append(mix64(s[order] + mix64(np.array([region], np.int64).view(np.uint64)) * _STEP).view("<i8"))
                sizes.append(len(s))
            many = np.array([len(t) for t in tokens])
            where = pa.array(np.repeat(np.arange(len(many)), many))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(tokens)), batch.column("node").take(where), batch.column("part").take(where),
                pa.array(np.repeat(np.array(sizes, np.int64), many)), pa.array(spread(many))], ["token", "node", "part", "n", "at"])

    return run


def _likely(percent: int):
    """Pairs whose signatures allow the similarity."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("left", "right"))
                fits = pa.array((x == y).sum(axis=1) >= _least_equal(percent, x.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [_similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())]
            fits = pa.array(fits, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(fits) for c in ("a", "b")], ["a", "b"])

    return run


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _least_equal(percent: int, minima: int) -> float:
    share = percent / 100
    return (share - SLACK * (share * (1 - share) / minima) ** 0.5) * minima


def _remaining_links(large: DataFrame, groups: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between nodes of a region that are in different ``groups`` so far, by prefixes of rare shingles."""
    spark = large.sparkSession
    counts = np.zeros((SLOTS >> 14, 1 << 14), np.int64)
    tallied = large.select("shingles").mapInArrow(_tally, "chunk int, counts binary").groupBy("chunk").applyInPandas(_add_up, "chunk int, counts binary")
    for r in tallied.collect():
        counts[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    shared = spark.sparkContext.broadcast(counts.ravel())
    named = large.select("node", "region", "shingles").join(groups, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    listed = materialise(named.mapInArrow(_rarest(percent, shared), "token bigint, node bigint, part bigint, n bigint, at bigint"))
    per_part = listed.groupBy("token", "part").agg(F.count(F.lit(1)).alias("many"))
    lists = per_part.groupBy("token").agg(F.sum("many").alias("all"), F.max(F.struct("many", "part")).alias("top"), F.count(F.lit(1)).alias("parts"))
    # all but the largest group of a list look for partners, in slices of bounded size
    lists = lists.where("parts > 1").select("token", F.col("top.part").alias("home"), F.ceil((F.col("all") - F.col("top.many")) / block).cast("int").alias("slices"))
    listed = materialise(listed.join(lists, "token"))
    a = listed.where("part <> home").withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")).alias("a")
    b = listed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.slice") == F.col("b.slice")) & F.expr(f"""
        a.part <> b.part AND (b.part = b.home OR a.node < b.node) AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
        AND {100 + percent} * least(a.n - a.at, b.n - b.at) >= {percent} * (a.n + b.n)"""))
    pairs = materialise(met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct())

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        left, right = (large.select(F.col("node").alias(n), F.col(column).alias(c)) for n, c in (("a", "left"), ("b", "right")))
        return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right")

    likely = materialise(beside(pairs, "minima").mapInArrow(_likely(percent), _LINKS))
    return beside(likely, "shingles").mapInArrow(_confirm(percent), _LINKS)


def _runs(forest: DataFrame, depth: int) -> DataFrame:
    head = F.col(f"head{depth}")
    return forest.where(head != F.col("node")).select(F.col("node").alias("a"), head.alias("b"))


def _sized(regions: DataFrame) -> DataFrame:
    sizes = regions.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    return regions.join(sizes, "root").select("node", F.col("root").alias("region"), "size")


def _grouped(docs: DataFrame, percent: int, words: int, region: int) -> DataFrame:
    """``id, hash, n, root, component`` of every row: the root is unique to a group, null without words; the component is the group's least id."""
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("hash"),
                        F.coalesce(text.cast("binary"), F.lit(b"")).alias("text"))
    signed = materialise(keyed.mapInArrow(_sign(words), "id bigint, hash bigint, n bigint, d1 bigint, d2 bigint, minima binary"))
    with_words = signed.where("n > 0")
    nodes = materialise(
        with_words.groupBy("d1", "d2", "n").agg(F.min(F.struct("id", "hash", "minima")).alias("r"))
        .select("d1", "d2", "n", F.monotonically_increasing_id().alias("node"), F.col("r.id").alias("id"), F.col("r.hash").alias("hash"),
                F.col("r.minima").alias("minima")))
    forest = _forest(nodes)
    regions = components(_runs(forest, LEAST))
    placed = _sized(regions)
    wanted = nodes.select("node", "id", "hash", "minima").join(placed, "node")
    texts = keyed.join(wanted, ["id", "hash"])
    sets = materialise(texts.select("node", "region", "size", "minima", "text").mapInArrow(
        _sets(words), "node bigint, region bigint, size bigint, minima binary, shingles binary"))
    buckets = max(shuffle_partitions(spark), (sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // (16 << 20))

    def solved(part: DataFrame) -> DataFrame:
        dealt = part.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(buckets))).repartition(buckets, "bucket")
        return dealt.groupBy("bucket").applyInPandas(_solve_regions(percent), _LINKS)

    links = solved(sets.where(F.col("size") <= region))
    large = sets.where(F.col("size") > region)
    if large.limit(1).count():
        large = materialise(large.dropDuplicates(["node"]))
        # what asks for longer prefixes asks for all of them at once: a node at a depth is one key
        steps = DEPTH - LEAST
        keys = [F.struct((F.col("node") * steps + k).alias("a"), (F.col(h) * steps + k).alias("b")) for k, h in enumerate(_HEADS[1:])]
        runs = forest.join(large.select("node"), "node", "left_semi").select(F.explode(F.array(*keys)).alias("r")).select("r.a", "r.b")
        deeper = materialise(_sized(components(runs)).withColumns({"step": F.expr(f"node % {steps}"), "node": F.expr(f"node div {steps}")}))
        # regions of a depth lie within those of the one before, so a node's first region that fits is its place
        fits = deeper.where(F.col("size") <= region).groupBy("node").agg(F.min(F.struct("step", "region", "size")).alias("r"))
        links = links.unionAll(solved(large.drop("region", "size").join(fits.select("node", "r.region", "r.size"), "node")))
        crowded = deeper.where((F.col("size") > region) & (F.col("step") == steps - 1)).drop("step")
        if crowded.limit(1).count():
            ordered = large.drop("region", "size").join(crowded, "node").withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1)))).withColumn(
                "label", F.substring(F.col("minima"), F.col("tree") * (DEPTH * 4) + 1, F.lit(DEPTH * 4)))
            ordered = ordered.repartitionByRange(buckets, "tree", "region", "label", "node").sortWithinPartitions("tree", "region", "label", "node")
            links = links.unionAll(ordered.select("region", "node", "minima", "shingles").mapInPandas(_solve_blocks(percent, region), _LINKS))
        groups = materialise(components(materialise(links)))
        linked = groups.select(F.col("node").alias("a"), F.col("root").alias("b"))
        links = linked.unionAll(_remaining_links(large, groups, percent, region))
    # stored first: else each task holds a worker that solves and one that makes forests, and as many stay with the executor for all later stages
    groups = components(materialise(links))
    # the smallest document of a group speaks for it
    named = nodes.select("node", "d1", "d2", "n", "id").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("id").alias("component"))
    by_set = named.join(least, "root").select("d1", "d2", "n", "root", "component")
    found = signed.select("id", "hash", "n", "d1", "d2").join(by_set, ["d1", "d2", "n"], "left")
    return found.select("id", "hash", "n", "root", F.coalesce("component", "id").alias("component"))


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, region: int = REGION) -> DataFrame:
    """``doc_id, hash, n_shingles, component_id, kept``: documents linked where 100 * |A and B| >= ``percent`` * |A or B|.

    ``component_id`` is the smallest ``doc_id`` of a group, ``kept`` tells whether it is the row's own; ``hash`` (xxhash64 of the text) tells
    rows of one ``doc_id`` apart.  Links are confirmed on full sets.  A pair at the threshold is missed with probability
    (1 - 0.85^3)^16 = 2e-7, in regions of any size; ``region`` says only how many nodes are compared with each other in one task.

    Null and empty texts and texts without words have no shingles, are linked with nothing and kept.  Null ``doc_id`` counts as smallest.
    Rows that repeat a ``doc_id`` are separate documents.  An empty table gives no rows.
    """
    component = F.col("component")
    return _grouped(docs, percent, words, region).select(
        F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "hash", F.col("n").alias("n_shingles"),
        F.nullif(component, F.lit(_NO_ID)).alias("component_id"), (F.col("id") == component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs``, one of each near-duplicate group: that with the smallest ``doc_id``, of its rows that with the smallest hash.

    Groups are told apart by their links, not by ``doc_id``, so unlinked texts with null or repeated ids all stay.  Texts without words are in
    no group and all stay; of rows equal in ``doc_id`` and text, one stays.
    """
    found = _grouped(docs, percent, words, REGION)
    chosen = found.where("n > 0").groupBy("root").agg(F.min(F.struct("id", "hash")).alias("r")).select(
        F.col("r.id").alias("_id"), F.col("r.hash").alias("_hash")).unionAll(
        found.where("n = 0").select(F.col("id").alias("_id"), F.col("hash").alias("_hash")).distinct())
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_ID)), "_hash": F.xxhash64(F.col("text").cast("string"))})
    nth = F.row_number().over(Window.partitionBy("_id", "_hash").orderBy(F.lit(0)))
    return keyed.join(chosen, ["_id", "_hash"]).withColumn("_nth", nth).where("_nth = 1").select(*docs.columns)
