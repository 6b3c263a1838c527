"""SimHash near-duplicates with a Gray-order hierarchical index.

Equal fingerprints collapse first. To find fingerprints within d differing bits, the 64 bits
fall into d + 2 blocks (more for very many fingerprints): two fingerprints that are that close
agree on two whole blocks. For each choice of two blocks, those bits are moved to the front and the permuted fingerprints
sorted by their rank in the reflected Gray code, over the whole cluster by range. Runs that
share the front bits become hierarchical indexes: leaves of Gray neighbours, and upper nodes
that hold the bits all their members share. Pairs of nodes whose shared bits already differ
in more than d places are pruned as a whole. Runs longer than a chunk, or spread over tasks,
meet chunk by chunk, pruned by the chunks' own shared bits first.

Only links that join two classes leave a task, so a dense group gives no more links than it
has members; alternating large and small stars turn the links into components.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, fresh, join_hot, spread, without

SHINGLE, MOST_BITS, SEED = 4, 4, 42
LEAF, FAN = 32, 8
#: Fingerprints of one run that are indexed together.
CHUNK = 16_384
#: Members that a run of random fingerprints may have before pairs must agree in more blocks.
RUN = 32


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles; a text without words gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[i:j], SEED) for i, j in zip(starts, stops)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_key, fp): the fingerprint of each row's whole text as a signed long.

    Null and empty texts, and texts of white space, have fingerprint 0.
    """

    def run(batches):
        for batch in batches:
            found = np.array([fingerprint(x, shingle) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "text_key", "fp"])

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    return spread(read).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, text_key long, fp long")


# -- the index within one task -------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


def blocks_to_agree(n: int, bits: int) -> int:
    """Blocks in which a pair must agree: the least number, two or more, for which n random
    fingerprints make runs of some RUN members or fewer. More blocks mean more layouts."""
    for agree in (2, 3):
        if n >> (64 * agree // (bits + agree)) <= RUN:
            return agree
    return 4


def layouts(bits: int, agree: int = 2) -> list[tuple[list[tuple[int, int]], int]]:
    """For each choice of `agree` blocks of bits + agree: the blocks (shift, width) in their
    new order, from the top, and the width of the chosen together."""
    n = bits + agree
    edges = [64 * k // n for k in range(n + 1)]
    blocks = [(edges[k], edges[k + 1] - edges[k]) for k in range(n)]
    out = []
    for chosen in combinations(range(n), agree):
        order = [blocks[k] for k in chosen] + [b for k, b in enumerate(blocks) if k not in chosen]
        out.append((order, sum(width for _, width in order[:agree])))
    return out


def permuted(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros_like(x)
    for shift, width in order:
        out = (out << np.uint64(width)) | ((x >> np.uint64(shift)) & np.uint64((1 << width) - 1))
    return out


def restored(x: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    out, low = np.zeros_like(x), 0
    for shift, width in reversed(order):
        out |= ((x >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(shift)
        low += width
    return out


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all members share."""

    def __init__(self, codes: np.ndarray, high: np.ndarray | None = None, leaf: int = LEAF):
        """With `high`, each member stands for a group: codes are the bits that all of it has,
        high those that any of it has."""
        self.codes, self.size = codes, leaf
        low, high = codes, codes if high is None else high
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # starts, mask, pattern; leaves first
        starts = np.arange(0, len(codes), leaf)
        while True:
            cut = np.arange(0, len(low), leaf if not self.levels else FAN)
            low, high = np.bitwise_and.reduceat(low, cut), np.bitwise_or.reduceat(high, cut)
            mask = ~(low ^ high)
            self.levels.append((starts, mask, low & mask))
            if len(cut) == 1:
                break
            starts = starts[::FAN]

    def near_leaves(self, other: GrayIndex, bits: int):
        """Batches of pairs of leaves that the shared bits don't rule out; of an index with
        itself, each pair once, a leaf's pair with itself included."""
        same = other is self
        depth = max(len(self.levels), len(other.levels))
        pick = lambda index, level: index.levels[min(level, len(index.levels) - 1)]
        stack = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            _, mask_a, pattern_a = pick(self, level)
            _, mask_b, pattern_b = pick(other, level)
            apart = np.bitwise_count((pattern_a[a] ^ pattern_b[b]) & mask_a[a] & mask_b[b])
            a, b = a[apart <= bits], b[apart <= bits]
            if not len(a):
                continue
            if level == 0:
                for at in range(0, len(a), 512):
                    yield a[at : at + 512], b[at : at + 512]
                continue
            a, b = self._children(a, level), other._children(b, level)
            pairs_a, pairs_b = np.repeat(a, b.shape[1], axis=1).ravel(), np.tile(b, (1, a.shape[1])).ravel()
            ok = (pairs_a >= 0) & (pairs_b >= 0)
            if same:
                ok &= pairs_a <= pairs_b
            pairs_a, pairs_b = pairs_a[ok], pairs_b[ok]
            stack += [(level - 1, pairs_a[at : at + 65_536], pairs_b[at : at + 65_536]) for at in range(0, len(pairs_a), 65_536)]

    def _children(self, nodes: np.ndarray, level: int) -> np.ndarray:
        if level >= len(self.levels):  # the other index is deeper
            return nodes[:, None]
        out = nodes[:, None] * FAN + np.arange(FAN)
        return np.where(out < len(self.levels[level - 1][0]), out, -1)

    def leaf(self, leaves: np.ndarray) -> np.ndarray:
        """Positions of the members of leaves, -1 beyond the end."""
        out = leaves[:, None] * self.size + np.arange(self.size)
        return np.where(out < len(self.codes), out, -1)


class Classes:
    """Classes of positions under links, as the least position of each."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        of = self.of
        while True:
            x, y = of[a], of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = of[of]
                if (up == of).all():
                    break
                of[:] = up


def linked(left: GrayIndex, right: GrayIndex, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the classes of members of two indexes, or of one with itself: pairs
    of (least member, member), positions on the right counted on from the left's."""
    same = right is left
    codes = left.codes if same else np.concatenate([left.codes, right.codes])
    classes = Classes(len(codes))
    shift = 0 if same else len(left.codes)
    for leaves_a, leaves_b in left.near_leaves(right, bits):
        a, b = left.leaf(leaves_a), right.leaf(leaves_b)
        b = np.where(b >= 0, b + shift, -1)
        # leaves that already are of one class, all of them, have nothing to add
        top = lambda x: (np.where(x >= 0, classes.of[x], -1).max(1), np.where(x >= 0, classes.of[x], len(codes)).min(1))
        (most_a, least_a), (most_b, least_b) = top(a), top(b)
        open_ = ~((most_a == least_a) & (most_b == least_b) & (most_a == most_b))
        a, b = a[open_], b[open_]
        if not len(a):
            continue
        near = np.bitwise_count(codes[a][:, :, None] ^ codes[b][:, None, :]) <= bits
        near &= (a >= 0)[:, :, None] & (b >= 0)[:, None, :]
        at, i, j = np.nonzero(near)
        classes.link(a[at, i], b[at, j])
    member = np.flatnonzero(classes.of != np.arange(len(codes)))
    return classes.of[member], member


# -- over the cluster ------------------------------------------------------------------------


def links(fps: DataFrame, bits: int = MOST_BITS, agree: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` within `bits`, enough of them to
    connect all that are connected. The number of blocks to agree in changes the work only."""
    plans = layouts(bits, agree or blocks_to_agree(fps.count(), bits))

    def spread(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, (order, _) in enumerate(plans):
                rank = gray_rank(permuted(codes, order)) ^ np.uint64(1 << 63)  # sorts as signed
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), k, np.int32)), pa.array(rank.view(np.int64))], names=["layout", "rank"])

    def index(batches):
        """Links within chunks; chunks of runs that others may continue."""
        schema = pa.schema([(x, pa.int64()) for x in ("a", "b", "run", "chunk", "low", "high")] + [("codes", pa.binary())])
        from pyspark import TaskContext

        task, state = TaskContext.get().partitionId(), {"chunk": 0}

        def finish(run, codes, more):
            """A chunk's links, and the chunk itself if its run may go on elsewhere."""
            a = b = np.zeros(0, np.int64)
            if len(codes) > 1:
                tree = GrayIndex(codes)
                a, b = linked(tree, tree, bits)
            order = plans[run >> 40][0]
            back = restored(codes, order).view(np.int64)
            out = [pa.RecordBatch.from_arrays([pa.array(back[a]), pa.array(back[b]), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)] if len(a) else []
            if more:
                state["chunk"] += 1
                low, high = (f.reduce(codes).view(np.int64).item() for f in (np.bitwise_and, np.bitwise_or))
                row = (None, None, run, task << 32 | state["chunk"], low, high, codes.tobytes())
                out.append(pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema))
            return out

        def whole(run, codes, more):
            """A run's rows, chunk by chunk; more: others may hold rows of it."""
            more = more or len(codes) > CHUNK
            if more or len(codes) > 1:
                for at in range(0, len(codes), CHUNK):
                    yield from finish(run, codes[at : at + CHUNK], more)

        def worth(run, codes, starts):
            """Which runs need an index: those longer than a leaf, and of the others those with
            members within `bits`, found for all at once."""
            sizes = np.diff(np.append(starts, len(run)))
            out, of = sizes > LEAF, np.repeat(np.arange(len(starts)), sizes)
            for k in range(1, min(LEAF, int(sizes.max()))):
                near = (run[k:] == run[:-k]) & (np.bitwise_count(codes[k:] ^ codes[:-k]) <= bits)
                out[of[k:][near]] = True
            return out

        held_run, held, more = None, [], True  # the run that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            layout = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = gray_code(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(1 << 63))
            front = np.array([64 - w for _, w in plans], np.uint64)[layout]
            run = (layout << 40) | (codes >> front).astype(np.int64)
            starts = np.concatenate(([0], np.flatnonzero(run[1:] != run[:-1]) + 1))
            ends = np.append(starts[1:], len(run))
            if run[0] == held_run:
                held.append(codes[: ends[0]])
                if len(starts) == 1:
                    while sum(map(len, held)) >= CHUNK:
                        all_ = np.concatenate(held)
                        yield from finish(held_run, all_[:CHUNK], True)
                        held, more = [all_[CHUNK:]], True
                    continue
            if held:
                yield from whole(held_run, np.concatenate(held), more)
                more = False
            begin = 1 if run[0] == held_run or held_run is None and len(starts) > 1 else 0
            if held_run is None and len(starts) > 1:  # rows of the first run may lie in the task before
                yield from whole(int(run[0]), codes[: ends[0]], True)
                more = False
            inner = np.arange(begin, len(starts) - 1)
            for k in inner[worth(run, codes, starts)[inner]].tolist():
                yield from whole(int(run[starts[k]]), codes[starts[k] : ends[k]], False)
            held_run, held = int(run[-1]), [codes[starts[-1] :]]
        if held:
            yield from whole(held_run, np.concatenate(held), True)

    def paired(batches):
        """Rows (run, chunk, low, high) in this order as pairs of a run's chunks that the bits
        which each of them shares don't rule out, found by the same tree over the chunks."""
        run, held = None, []

        def pairs():
            chunk, low, high = (np.concatenate(x) for x in zip(*held))
            tree = GrayIndex(low.view(np.uint64), high.view(np.uint64), leaf=1)
            for a, b in tree.near_leaves(tree, bits):
                apart = a != b
                yield pa.RecordBatch.from_arrays([pa.array(np.full(apart.sum(), run)), pa.array(chunk[a[apart]]), pa.array(chunk[b[apart]])], names=["run", "x", "y"])

        for batch in batches:
            runs, *rest = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(runs[1:] != runs[:-1]) + 1).tolist(), len(runs)] if len(runs) else []
            for i, j in zip(cuts, cuts[1:]):
                if run is not None and runs[i] != run:
                    yield from pairs()
                    held = []
                run = int(runs[i])
                held.append([c[i:j] for c in rest])
        if held:
            yield from pairs()

    def meet(batches):
        for batch in batches:
            for run, x, y in zip(*(batch.column(k).to_pylist() for k in range(3))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                a, b = linked(GrayIndex(x), GrayIndex(y), bits)
                if len(a):
                    back = restored(np.concatenate([x, y]), plans[run >> 40][0]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(back[a]), pa.array(back[b])], names=["a", "b"])

    ranked = fps.select("fp").mapInArrow(spread, "layout int, rank long")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = ranked.repartitionByRange(n, "layout", "rank").sortWithinPartitions("layout", "rank")
    found = durable(sorted_.mapInArrow(index, "a long, b long, run long, chunk long, low long, high long, codes binary"))
    near = found.where("run is null").select("a", "b")
    chunks = found.where("run is not null")
    heads = chunks.select("run", "chunk", "low", "high").repartition("run").sortWithinPartitions("run", "chunk")
    pairs = heads.mapInArrow(paired, "run long, x long, y long")
    codes = chunks.select("chunk", "codes")
    across = pairs.join(codes.toDF("x", "codes_x"), "x").join(codes.toDF("y", "codes_y"), "y").select("run", "codes_x", "codes_y").mapInArrow(meet, "a long, b long")
    return near.unionByName(across)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) with the least node of its component.

    Alternates large and small stars until nothing changes; each round is checkpointed, no task
    gets the members of a large star, and only numbers about a round reach the driver.
    """
    stars = durable(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    before = None
    while True:
        # A star's centre m is replaced by the least of its own smaller neighbours; those are
        # what it is linked to as the larger end v of a link.
        least = stars.groupBy("v").agg(F.min("m").alias("low"))
        large = join_hot(stars, least.select(F.col("v").alias("m"), "low"), "m", "left").select("v", F.coalesce("low", "m").alias("m")).distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("low").alias("m")), F.struct("v", F.col("low").alias("m")))).alias("e")).select("e.*").where("v <> m").distinct()
        stars = durable(small)
        now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("v").alias("node"), F.col("m").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MOST_BITS, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of docs: id, text_key, fp, component_id.

    component_id is the least id among rows whose fingerprints are linked, itself included;
    null ids don't count, and a component of null ids only has none. Repeated rows come back
    as often as they came. Empty tables give empty results; other columns are not read.
    """
    rows = durable(fingerprints(docs, id_col, text_col, shingle))
    each = durable(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(each, bits))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    rooted = durable(each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", "root"))
    alone, linked_ = rooted.where("root is null"), rooted.where("root is not null")
    ids = linked_.groupBy("root").agg(F.min("least").alias("component_id"))
    of = join_hot(linked_, ids, "root").select("fp", "component_id").unionByName(alone.select("fp", F.col("least").alias("component_id")))
    found = join_hot(rows, of, "fp", counts=each.select("fp", "n"))
    return found.select(F.col("id").alias(id_col), "text_key", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with the least id of each component only.

    Rows that repeat that id and text count as one, whichever of them. Rows with a null id
    stay: nothing tells them apart. Null and empty texts are one component. Empty tables stay
    empty; columns may have any names. Only ids and hashes of texts move, and the rows that
    repeat an id and text.
    """
    found = durable(near_duplicates(docs, id_col, text_col))
    key = F.xxhash64(docs[text_col])
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id"), "text_key").distinct()
    left = without(docs, gone, [docs[id_col], key], ["id", "text_key"])
    again = found.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("id"), "text_key").count().where("count > 1").select("id", "text_key")
    again = durable(again)
    if again.isEmpty():
        return left
    mark = fresh("text_key", docs)
    once, more = (without(left, again, [left[id_col], F.xxhash64(left[text_col])], ["id", "text_key"], how) for how in ("left_anti", "left_semi"))
    return once.unionByName(more.withColumn(mark, F.xxhash64(F.col(f"`{text_col}`"))).dropDuplicates([id_col, mark]).drop(mark))
