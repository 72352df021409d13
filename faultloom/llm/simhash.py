"""SimHash near-dedup: tiled exact comparison of 64-bit fingerprints.

1. Fingerprints: words are lower-cased (A-Z), shingles of ``SHINGLE`` words are hashed (XXH64, seed
   42), and bit b is 1 if it is set in over half of a text's hashes, repeats included.
2. Equal fingerprints are one class, so copies never meet each other, however many there are.
3. Two fingerprints that differ in at most ``radius`` bits agree on at least one of radius + 1 blocks
   of bits. Each class goes once to each of its blocks' values; within a value, tiles of fingerprints
   ordered by bit count are compared exactly (numpy exclusive-or and bit counts), and tile pairs whose
   bit counts differ by more than the radius are skipped. That loses no link. Each value gives a
   spanning forest of its links (each class with the smallest it reaches there), never all pairs.
   Values that hold very many classes are split: see ``CELL``.
4. Components: rounds of large-star and small-star on the forest, each round a table in the shared
   folder, until nothing changes.

Defined results: a text without words (null and empty too) has fingerprint zero and links like any
other; a null doc_id is a row without influence on others' component (its component is the smallest
id of its class); rows with equal ids keep a row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from faultloom.llm._common import discard, written

SEED = 42
SHINGLE = 3
RADIUS = 3
TILE = 1024
#: Sets of shingles are near-duplicates at a Jaccard similarity of at least NEAR = p / q (see ``keep_first``).
NEAR = (4, 5)
#: Parity bits of a set of shingles: LANES x 64, in the wide form as many more (a power of two) as it has shingles.
LANES = 8
#: The order of shingles is by how often their slot of SLOTS was met in one in SAMPLE documents.
SAMPLE, SLOTS = 64, 1 << 20
MOST_SEEN = 1_000_000
#: Bits of the table that tells which texts have to move: 2 MB, a power of two.
MARKS = 1 << 24
#: Rounds in which groups that meet in a cell are compared by one member each, before all pairs that are left.
ROUNDS = 1
#: Cells of at most FEW nodes are compared pair by pair at once; larger ones go through the rounds first.
FEW = 8
#: So many links (16 MB) are united in one task; more take rounds.
UNITED = 1 << 20
HASHES_AT_ONCE = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a UTF-8 text's words, lower-cased (A-Z); of all words if there are fewer."""
    words = text.translate(_LOWER).split()  # bytes: parts at the six gap bytes and nothing else
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - size + 1)


def majority(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        block = hashes[at : at + HASHES_AT_ONCE].astype("<u8").view(np.uint8)
        ones += np.unpackbits(block.reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.bitwise_or.reduce(np.left_shift((2 * ones > len(hashes)).astype(np.uint64), _BITS)))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of one UTF-8 text."""
    return majority(shingle_hashes(text, shingle))


def parities(hashes: np.ndarray, lanes: int = LANES) -> np.ndarray:
    """lanes x 64 bits, each the parity of the hashes that fall on it: two sets differ in no fewer hashes
    than their parities in bits. The halves of twice as many lanes make these by exclusive-or."""
    ones = np.bincount((hashes % np.uint64(64 * lanes)).astype(np.int64), minlength=64 * lanes) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def wide(hashes: np.ndarray) -> np.ndarray:
    """Parities in a bit a hash or more."""
    lanes = LANES
    while 64 * lanes < len(hashes):
        lanes *= 2
    return parities(hashes, lanes)


def leading(hashes: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first hashes of an ordered set, as many as two sets at a similarity of NEAR can't avoid sharing one of.

    Such sets share at least p / q of the larger, so all but that many and one more suffice, in any order
    that is the same for all sets: here what is met more often comes later, and equal counts by hash.
    """
    if not len(hashes):
        return hashes
    p, q = NEAR
    order = np.argsort(often[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)], kind="stable")
    return hashes[order[: len(hashes) - -(-len(hashes) * p // q) + 1]]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    kind = dict(docs.dtypes)[id_col]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = [fingerprint(t or b"", shingle) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(batches, f"doc_id {kind}, fp long")


def _find(parent: np.ndarray, k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return int(k)


def _join(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = _find(parent, x), _find(parent, y)
        if x != y:
            parent[max(x, y)] = min(x, y)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits between rows of lanes."""
    return sum(np.bitwise_count(x[..., k] ^ y[..., k]).astype(np.uint16) for k in range(x.shape[-1]))


def forest(cell: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest: pairs of positions within equal cells that reach each other over links.

    fps: (rows, lanes). Rows are sorted by cell. Small cells are compared all together, one distance in
    the order at a time; large ones tile by tile, in the order of bit counts. Only pairs with a home row
    count.
    """
    ones = np.bitwise_count(fps).astype(np.int32).sum(axis=1)
    order = np.lexsort((ones, cell))
    cell, fps, ones, home = cell[order], fps[order], ones[order], home[order]
    parent = np.arange(len(fps))
    begins = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.array([], np.int64)
    sizes = np.diff(np.append(begins, len(cell)))
    small = np.repeat(sizes <= 64, sizes)
    left = np.flatnonzero(small)
    far = 1
    while len(left):
        left = left[left + far < len(cell)]
        left = left[cell[left] == cell[left + far]]
        left = left[ones[left + far] - ones[left] <= radius]  # later rows have more bits still
        near = left[_apart(fps[left], fps[left + far]) <= radius]
        near = near[home[near] | home[near + far]]
        _join(parent, near, near + far)
        far += 1
    for begin, size in zip(begins[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        tiles = [(a, min(a + TILE, begin + size)) for a in range(begin, begin + size, TILE)]
        for step in range(len(tiles)):  # near tiles first: what they tie together needs no further comparison
            for (a, b), (c, d) in zip(tiles, tiles[step:], strict=False):
                if ones[c] - ones[b - 1] > radius:
                    continue
                known = _roots(parent, np.concatenate((np.arange(a, b), np.arange(c, d))))
                if known.min() == known.max():
                    continue
                close = (_apart(fps[a:b, None], fps[None, c:d]) <= radius) & (home[a:b, None] | home[None, c:d])
                _join(parent, *_tied(close, np.arange(a, b), np.arange(c, d)))
    root = np.fromiter((_find(parent, k) for k in range(len(parent))), np.int64, len(parent))
    linked = np.flatnonzero(root != np.arange(len(root)))
    return order[linked], order[root[linked]]


def _roots(parent: np.ndarray, rows: np.ndarray) -> np.ndarray:
    found = parent[rows]
    while (up := parent[found]).tolist() != found.tolist():
        found = up
    return found


def _tied(close: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, smallest row it reaches) within one pair of tiles, by passing the smallest along links."""
    none = np.iinfo(np.int64).max
    at_x, at_y = x.copy(), y.copy()
    while True:
        new_y = np.minimum(at_y, np.where(close, at_x[:, None], none).min(axis=0))
        new_x = np.minimum(at_x, np.where(close, new_y[None, :], none).min(axis=1))
        if (new_x == at_x).all() and (new_y == at_y).all():
            break
        at_x, at_y = new_x, new_y
    rows, least = np.concatenate((x, y)), np.concatenate((at_x, at_y))
    moved = rows != least
    return rows[moved], least[moved]


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links of a spanning forest within each block value, between distinct fingerprints ``fp``.

    A cell is a block value and a bit count: a class is at home in its own, and a guest in the cells of
    the next ``radius`` higher counts, where it meets those at home. So even a block value shared by
    very many classes is spread over cells, each of which one task compares.
    """
    width = -(-64 // (radius + 1))
    blocks = [
        F.struct(F.lit(k).alias("k"), F.shiftrightunsigned("fp", k * width).bitwiseAND(F.lit((1 << min(width, 64 - k * width)) - 1)).alias("v"))
        for k in range(radius + 1)
    ]
    steps = F.array(*[F.lit(k) for k in range(radius + 1)])
    cells = (
        classes.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*blocks)).alias("block"))
        .select("fp", "ones", "block", F.explode(steps).alias("up"))
        .select(
            F.xxhash64("block.k", "block.v", F.col("ones") + F.col("up")).alias("cell"), F.col("fp").alias("node"), (F.col("up") == 0).alias("home"), F.array("fp").alias("lanes")
        )
    )
    return cell_links(cells, radius)


def cell_links(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b): a spanning forest of the links within each cell; cells (cell, node, home, lanes)."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted; whole cells are gathered until they are many rows."""
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush(cell: np.ndarray, node: np.ndarray, home: np.ndarray, lanes: np.ndarray) -> pa.RecordBatch:
            a, b = forest(cell, lanes.view(np.uint64), home, radius)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

        for batch in rows:
            if not batch.num_rows:
                continue
            lanes = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, -1)
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False), lanes))
            size += batch.num_rows
            if size < 100_000:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last cell may go on
            if cut:
                yield flush(*[x[:cut] for x in whole])
            held, size = [tuple(x[cut:] for x in whole)], len(whole[0]) - cut
        if held:
            yield flush(*[np.concatenate(x) for x in zip(*held, strict=True)])

    spread = cells.select("cell", "node", "home", "lanes").repartition("cell").sortWithinPartitions("cell")
    return spread.mapInArrow(compare, "a long, b long").filter("a <> b").distinct()


def _written_links(links: DataFrame) -> tuple[DataFrame, tuple]:
    """Distinct links (hi, lo) as a table, and what tells whether two such tables are equal: their number and two sums
    over 64-bit hashes of the rows, taken while they are written."""
    seen = Observation()
    mixed = F.xxhash64("hi", "lo")
    sums = [F.count(F.lit(1)).alias("n"), F.bit_xor(mixed).alias("xor"), F.sum(mixed.cast("decimal(38,0)")).alias("sum")]
    table = written(links.filter("hi <> lo").distinct().observe(seen, *sums), "links")
    return table, tuple(seen.get[k] for k in ("n", "xor", "sum"))


def _united(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of links (hi, lo) that fit in a task: by union and find over the nodes in their order."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in rows if batch.num_rows]
    if held:
        hi, lo = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, at = np.unique(np.concatenate((hi, lo)), return_inverse=True)
        parent = np.arange(len(nodes))
        _join(parent, at[: len(hi)], at[len(hi) :])
        root = np.fromiter((_find(parent, k) for k in range(len(nodes))), np.int64, len(nodes))
        linked = root != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], ["node", "root"])


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) reaches, itself included.

    Large-star joins every node's larger neighbours to its smallest, small-star its smaller ones; both
    are aggregations and joins on nodes. A hub's neighbours are never gathered: only minima are. Links that one
    task can hold, at most ``UNITED``, are united there, to the same roots in one job.
    """
    now, known = _written_links(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")))
    if known[0] <= UNITED:
        return now.coalesce(1).mapInArrow(_united, "node long, root long")
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = least.select("node", F.least("node", "least").alias("least"))
        # Joined by their keys' order: no table of a round passes through the driver.
        large = both.filter("other > node").join(least.hint("merge"), "node").select(F.col("other").alias("hi"), F.col("least").alias("lo"))
        small_least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(small_least.hint("merge"), "hi")
        small = small.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).union(small_least.select("hi", F.col("least").alias("lo")))
        before, was, (now, known) = now, known, _written_links(small)
        discard(edges.sparkSession, before)
        if known == was:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _components_of(made: DataFrame, radius: int) -> DataFrame:
    """made (doc_id, fp, ...) -> (fp, component_id) for every distinct fingerprint."""
    classes = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    tree = components(links(classes.select("fp"), radius))
    named = classes.join(tree.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    # Classes outside the tree are their own roots; both joins are on unique keys of the right side.
    return named.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that a chain of links reaches)."""
    made = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    return made.join(_components_of(made, radius), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32()), pa.array(values.view(np.int64)))


def _often(docs: DataFrame, shingle: int) -> np.ndarray:
    """How often each slot of hashes is met in a sample of the texts; this decides how large cells get, not
    what is found. At most SLOTS rows reach the driver, whatever the input is."""

    def slots(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for t in batch.column(0).cast(pa.binary()):
                found = np.unique(shingle_hashes(t.as_py() or b"", shingle)) & np.uint64(SLOTS - 1)
                slot, n = np.unique(found.astype(np.int32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(slots, "slot int, n long")
    counts = sample.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.uint32)
    often[counts.column("slot").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 2**32 - 1)
    return often


def _seat(i: Column, text: Column) -> Column:
    """128 bits that tell a row from all others, unless id and text are equal."""
    named = F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("-"))
    return F.unhex(F.md5(F.concat_ws("\x1f", F.md5(F.coalesce(text, F.lit(""))), F.when(text.isNull(), "null").otherwise("text"), named)))


def _may_be(rows: DataFrame, seats: DataFrame) -> DataFrame:
    """rows with ``_may_be``: false where a row's seat is surely none of seats. A table of MARKS bits, at most MARKS / 64 rows, goes
    to every task, so that of the texts only those move that a join may keep; the fuller it is, the more do."""
    bit = F.pmod(F.xxhash64("seat"), F.lit(MARKS))
    cells = seats.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("_cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("_bits"))
    joined = rows.withColumn("_cell", F.shiftright(bit, 6)).join(F.broadcast(cells), "_cell", "left")
    marked = F.col("_bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))) != 0
    return joined.withColumn("_may_be", F.coalesce(marked, F.lit(False))).drop("_cell", "_bits")


def _similar(pairs: DataFrame, classes: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have a similarity of NEAR: by size and parities as far as these
    rule it out, then by the sets themselves, which are made again from the texts of one row a node."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch, 0, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(part)), _lists(part)], ["node", "hashes"])

    p, q = NEAR
    for side in "ab":
        pairs = pairs.join(classes.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("wide").alias(f"{side}_wide")), side)
    half = {s: F.when(F.size(f"{s}_wide") > F.size(f"{o}_wide"), _folded(f"{s}_wide")).otherwise(F.col(f"{s}_wide")) for s, o in ("ab", "ba")}
    apart = F.aggregate(F.zip_with(half["a"], half["b"], lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
    pairs = pairs.filter(_sized(F.col("a_size"), F.col("b_size"))).filter(_within(apart, F.col("a_size"), F.col("b_size")))
    close = written(pairs.select("a", "b"), "candidates")
    used = close.select(F.col("a").alias("node")).union(close.select(F.col("b").alias("node"))).distinct()
    used = used.join(classes.select("node", "first"), "node").select("first.seat")
    used = written(used, "used")  # a table's size is known before the texts move
    texts = _may_be(rows, used).filter("_may_be").join(used, "seat", "left_semi").select("text")
    made = written(texts.mapInArrow(sets, "node long, hashes array<long>").dropDuplicates(["node"]), "sets")
    discard(rows.sparkSession, used)
    joined = close
    for side in "ab":
        joined = joined.join(made.select(F.col("node").alias(side), F.col("hashes").alias(f"{side}_set")), side)
    shared = F.size(F.array_intersect("a_set", "b_set"))
    similar = written(joined.filter(shared * (p + q) >= p * (F.size("a_set") + F.size("b_set"))).select("a", "b"), "similar")
    discard(rows.sparkSession, close, made)
    return similar


def _texts(batch: pa.RecordBatch, column: int, shingle: int) -> Iterator[list[np.ndarray]]:
    """The sets of a batch's texts, in lists of bounded size."""
    found: list[np.ndarray] = []
    held = 0
    for t in batch.column(column).cast(pa.binary()):
        found.append(np.unique(shingle_hashes(t.as_py() or b"", shingle)))
        held += len(found[-1])
        if held >= 16 * HASHES_AT_ONCE:
            yield found
            found, held = [], 0
    if found:
        yield found


def _nodes(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)


def _folded(lanes: str) -> Column:
    half = (F.size(lanes) / 2).cast("int")
    return F.zip_with(F.slice(lanes, F.lit(1), half), F.slice(lanes, half + 1, half), lambda u, v: u.bitwiseXOR(v))


def _sized(a: Column, b: Column) -> Column:
    """Sizes that allow a similarity of NEAR; their wide parities are of equal length or one has twice the other's."""
    return NEAR[1] * F.least(a, b) >= NEAR[0] * F.greatest(a, b)


def _within(apart: Column, a: Column, b: Column) -> Column:
    """Sets of a similarity of NEAR differ in so few elements."""
    p, q = NEAR
    return apart * (p + q) <= (q - p) * (a + b)


def _close(cell: np.ndarray, root: np.ndarray, size: np.ndarray, begin: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of unlike groups within equal cells that sizes and parities don't rule out.

    Rows are sorted by cell and size; a row's wide parities are those of ``lanes`` from ``begin`` up to the next row's. Pairs are compared one
    distance in the order at a time, first by LANES lanes each, and are rows only if they stay.
    """
    p, q = NEAR
    width = np.diff(np.append(begin, len(lanes)))
    narrow = np.zeros((len(cell), LANES), np.uint64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        for at in range(0, len(rows), max(1, HASHES_AT_ONCE * LANES // w)):
            part = rows[at : at + max(1, HASHES_AT_ONCE * LANES // w)]
            narrow[part] = np.bitwise_xor.reduce(lanes[begin[part, None] + np.arange(w)].reshape(len(part), w // LANES, LANES), axis=1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    left, far = np.arange(len(cell)), 1
    while len(left):
        left = left[left + far < len(cell)]
        left = left[(cell[left] == cell[left + far]) & (q * size[left] >= p * size[left + far])]  # later rows are larger still
        for at in range(0, len(left), HASHES_AT_ONCE):
            a = left[at : at + HASHES_AT_ONCE]
            a = a[root[a] != root[a + far]]
            most = lambda a: (q - p) * (size[a] + size[a + far])  # noqa: B023, E731
            a = a[_apart(narrow[a], narrow[a + far]).astype(np.int64) * (p + q) <= most(a)]
            found.append((a[width[a + far] == LANES], a[width[a + far] == LANES] + far))
            for w in np.unique(width[a + far]).tolist():
                if w == LANES:
                    continue
                rows = a[width[a + far] == w]
                for k in range(0, len(rows), max(1, HASHES_AT_ONCE * LANES // w)):
                    one = rows[k : k + max(1, HASHES_AT_ONCE * LANES // w)]
                    apart = np.zeros(len(one), np.int64)
                    for of in (w, w // 2):  # sizes are near, so the smaller set has as many lanes or half of them
                        mine = np.flatnonzero(width[one] == of)
                        other = lanes[begin[one[mine] + far, None] + np.arange(w)]
                        other = other if of == w else other[:, :of] ^ other[:, of:]
                        apart[mine] = np.bitwise_count(lanes[begin[one[mine], None] + np.arange(of)] ^ other).sum(axis=1, dtype=np.int64)
                    one = one[apart * (p + q) <= most(one)]
                    found.append((one, one + far))
        far += 1
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def _close_in_cells(cells: DataFrame) -> DataFrame:
    """(a, b): the pairs of unlike groups that meet in a cell and that sizes and parities don't rule out; cells (cell, node, root, size, wide).
    Pairs that are ruled out are never rows."""

    def compare(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cells come sorted; whole cells are gathered until they are many rows."""
        held: list[pa.RecordBatch] = []
        size = 0

        def flush(part: pa.Table) -> pa.RecordBatch:
            cell, node, root, sizes = (part.column(k).to_numpy() for k in range(4))
            wider = part.column(4).combine_chunks()
            lengths = wider.value_lengths().to_numpy()
            a, b = _close(cell, root, sizes, np.cumsum(lengths, dtype=np.int64) - lengths, wider.flatten().to_numpy().view(np.uint64))
            a, b = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            pairs = np.unique(np.stack((a, b), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in rows:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 50_000:
                continue
            whole = pa.Table.from_batches(held)
            cell = whole.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on
            if cut:
                yield flush(whole.slice(0, cut))
            held, size = whole.slice(cut).to_batches(), len(cell) - cut
        if held:
            yield flush(pa.Table.from_batches(held))

    spread = cells.select("cell", "node", "root", "size", "wide").repartition("cell").sortWithinPartitions("cell", "size")
    return spread.mapInArrow(compare, "a long, b long").distinct()


def _tied_by_fingerprint(classes: DataFrame) -> DataFrame:
    """(a, b): the nodes that fingerprints of at most RADIUS differing bits tie together: those of one fingerprint to its smallest
    node, and these along the links of fingerprints."""
    smallest = classes.groupBy("fp").agg(F.min("node").alias("a"))
    equal = classes.join(smallest, "fp").filter("node <> a").select("a", F.col("node").alias("b"))
    named = links(smallest.select("fp")).toDF("fp", "other").join(smallest, "fp").select("other", "a")
    near = named.join(smallest.select(F.col("fp").alias("other"), F.col("a").alias("b")), "other").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return equal.union(near)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, of equal ids by a digest; of equal rows one.

    Texts are near-duplicates at a similarity (Jaccard, sets of shingles) of 0.8 or more; groups are the
    components of those links, each of them decided by the sets. Equal sets are one node. Each set goes to
    the cells of its leading shingles, so similar sets meet in one. Each node is compared first with those that its SimHash
    (of the same shingles, RADIUS bits apart at most; found by ``links``, as in op7) ties it to, and with the
    one that it follows in most cells; what a fingerprint can't tell at this similarity is left to the cells: in ROUNDS rounds, groups that meet
    in a cell of more than FEW nodes are compared by one member each, drawn anew for each cell, each group with the next one: a group of very many
    near copies becomes one without giving its pairs. What is still apart after that is compared pair by pair within each cell, in
    arrays, and only pairs that sizes and parities leave become rows.
    """
    kind = dict(docs.dtypes)[id_col]
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), _seat(F.col(id_col), text).alias("seat"), text.alias("text"))
    often = _often(rows, shingle)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # the leading shingles of copies go out once a task
        for batch in batches:
            begin = 0
            for found in _texts(batch, 2, shingle):
                nodes, first = _nodes(found), []
                for node, x in zip(nodes.tolist(), found, strict=True):
                    first.append(x[:0] if node in seen else leading(x, often))
                    if len(seen) < MOST_SEEN:
                        seen.add(node)
                size, wider = pa.array([len(x) for x in found], pa.int64()), _lists([wide(x) for x in found])
                fps = pa.array(np.array([majority(x) for x in found], np.uint64).view(np.int64))
                part = batch.slice(begin, len(found))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(nodes), size, wider, fps, _lists(first)], ["id", "seat", "node", "size", "wide", "fp", "cells"]
                )
                begin += len(found)

    made = rows.mapInArrow(sketches, f"id {kind}, seat binary, node long, size long, wide array<long>, fp long, cells array<long>")
    made = written(made, "sketches")
    seat, what = F.struct("id", "seat"), F.struct("size", "wide", "fp")
    classes = written(made.groupBy("node").agg(F.min(seat).alias("first"), F.min(what).alias("x")).select("node", "first", "x.*"), "classes")

    along, all_of = Window.partitionBy("cell").orderBy("node"), Window.partitionBy("cell")
    cells = made.select("node", F.explode("cells").alias("cell")).repartition("cell").distinct()
    cells = cells.withColumn("before", F.lag("node").over(along)).withColumn("after", F.lead("node").over(along))
    shared = written(cells.filter("before IS NOT NULL OR after IS NOT NULL").select("cell", "node", "before"), "cells")
    pairs = shared.filter("before IS NOT NULL").groupBy(F.col("node").alias("b"), F.col("before").alias("a")).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select(F.col("x.a").alias("a"), "b")
    spark = docs.sparkSession
    linked = _similar(_tied_by_fingerprint(classes).union(pairs).distinct(), classes, rows, shingle)
    tree = written(components(linked), "tree")
    discard(spark, linked)

    def open_cells(cells: DataFrame) -> DataFrame:
        """Cells whose nodes are not of one group yet, n nodes each."""
        left = cells.select("cell", "node").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
        left = left.withColumn("lo", F.min("root").over(all_of)).withColumn("hi", F.max("root").over(all_of))
        return written(left.withColumn("n", F.count(F.lit(1)).over(all_of)).filter("lo <> hi").select("cell", "node", "root", "n"), "open")

    left = open_cells(shared)
    discard(spark, shared)
    for k in range(ROUNDS + 1):
        if k < ROUNDS:
            member = left.filter(F.col("n") > FEW).groupBy("cell", "root").agg(F.min_by("node", F.xxhash64("node", "cell", F.lit(k))).alias("b"))
            order = Window.partitionBy("cell").orderBy(F.xxhash64("root", "cell", F.lit(k)), "root")
            meet = member.withColumn("a", F.lag("b").over(order)).filter("a is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        else:
            meet = _close_in_cells(left.join(classes.select("node", "size", "wide"), "node"))
        linked = _similar(meet, classes, rows, shingle)
        now = written(components(linked.union(tree.select(F.col("node").alias("a"), F.col("root").alias("b")))), "tree")
        discard(spark, linked, tree)
        tree = now
        if k < ROUNDS:
            left, before = open_cells(left), left
            discard(spark, before)

    best = classes.select("node", "first").join(tree, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    seats = made.groupBy("seat").agg(F.count(F.lit(1)).alias("n"))
    stays = best.select(F.col("first.seat").alias("seat"), F.lit(True).alias("stays"))
    # Rows that go are fewer than those that stay: a table of known size, which Spark broadcasts if it is small.
    odd = seats.join(stays, "seat", "left").filter("stays is null or n > 1").select("seat", "stays")
    odd = written(odd, "odd")
    for t in (made, classes, tree):
        discard(spark, t)
    seated = docs.select(F.struct("*").alias("row"), _seat(F.col(id_col), text).alias("seat"))
    marked = _may_be(seated, odd)
    # Rows that surely stay don't move; the others meet the table of those that go or are repeated.
    doubtful = marked.filter("_may_be").join(odd, "seat", "left_anti").select("row")
    kept = marked.filter("not _may_be").select("row").unionByName(doubtful)
    equal = odd.filter("stays").select("seat")
    if not equal.isEmpty():
        again = _may_be(seated, equal).filter("_may_be").join(equal, "seat", "left_semi")
        kept = kept.unionByName(again.dropDuplicates(["seat"]).select("row"))
    return kept.select("row.*")
