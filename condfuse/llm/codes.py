"""Product codes of vectors by Lloyd rounds over cover trees.

Vectors become integers and are cut into equal parts.  A task puts a block of rows into one cover tree per
part and writes it; the rounds and the last assignment then read the trees.  A node stands for a ball of
points: codebook entries that are farther from its centre than the nearest one by more than twice its
radius are nearest to none of them (triangle inequality).  Where one entry is left the whole subtree is
assigned, its sums taken from running sums over the points in tree order; only ambiguous nodes descend,
and only the points of ambiguous leaves are compared one by one.  All decisions are those of exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from condfuse.llm.common import cut
from condfuse.llm.whitening import matrix, usable

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
BLOCK_VALUES = 1 << 19  # entries of vectors in one block
LEAF = 8  # points of a node that is not split
PAIRS = 1 << 18  # distances computed at once
TOP = 1 << 28  # size of an integer entry; squared distances of a part of up to 32 entries then fit 64 bits
_NODE = ("start", "end", "child", "children")


def quantise(x: np.ndarray) -> np.ndarray:
    q = np.floor(SCALE * x.astype(np.float64))
    if len(q) and np.abs(q).max() >= TOP:
        raise ValueError(f"entries beyond {TOP // SCALE} in size have no exact squared distances here")
    return q.astype(np.int64)


# ---------------------------------------------------------------- the cover trees of a block


@dataclass
class Forest:
    """One cover tree per part over the rows of a block.

    ``points`` holds the parts in tree order, part after part; ``row`` the row of each.  A node is a
    stretch ``start:end`` of points with its centre first; its children are the ``children`` nodes from
    ``child`` on, none for a leaf; ``radius`` is the largest distance of its points from the centre.
    The first nodes are the roots.
    """

    points: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray
    parts: int


def stretches(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``first[0], first[0]+1, ...`` (``count[0]`` of them), then those of ``first[1]`` and so on."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def parted(q: np.ndarray, parts: int) -> np.ndarray:
    """(rows, dims) as (parts * rows, dims / parts), part after part."""
    return np.ascontiguousarray(q.reshape(len(q), parts, -1).swapaxes(0, 1)).reshape(parts * len(q), -1)


def plant(q: np.ndarray, parts: int, leaf: int = LEAF) -> Forest:
    """Cover trees over the rows of ``q``, all parts and all nodes of a level at once.

    A node of radius r gets children of covering radius s, the power of two with s < r <= 2s: its own
    centre first, then in turn the first point that no child covers yet, so centres of siblings are more
    than s apart.  Nodes of at most ``leaf`` points or of equal points stay whole.
    """
    rows, points = len(q), parted(q, parts)
    perm = np.arange(parts * rows)
    squares = lambda a, b: ((points[a] - points[b]) ** 2).sum(axis=1)
    start, end = np.arange(parts) * rows, (np.arange(parts) + 1) * rows
    far = squares(perm, np.repeat(start, rows))
    radius = np.sqrt(np.maximum.reduceat(far, start).astype(float))
    child, children = np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    nodes = [[start, end, child, children, radius]]
    total = parts
    while True:
        start, end, child, children, radius = nodes[-1]
        split = np.flatnonzero((end - start > leaf) & (radius > 0))
        if not len(split):
            break
        size = (end - start)[split]
        place = stretches(start[split], size)  # positions in perm of the points of the nodes to split
        point, node = perm[place], np.repeat(np.arange(len(split)), size)
        reach = 4.0 ** (np.ceil(np.log2(radius[split])) - 1)  # s squared
        turn, away = np.zeros(len(point), np.int64), np.zeros(len(point))
        left, centre, k = np.arange(len(point)), perm[start[split]], 0
        while len(left):
            d = squares(point[left], centre[node[left]])
            inside = d <= reach[node[left]]
            turn[left[inside]], away[left[inside]] = k, d[inside]
            left = left[~inside]
            heads = left[np.r_[True, node[left][1:] != node[left][:-1]]] if len(left) else left
            centre = centre.copy()
            centre[node[heads]] = point[heads]
            k += 1
        order = np.lexsort((turn, node))
        point, node, turn, away = point[order], node[order], turn[order], away[order]
        perm[place] = point
        first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (turn[1:] != turn[:-1])])
        owner = node[first]
        children[split] = np.bincount(owner, minlength=len(split))
        child[split] = total + np.cumsum(children[split]) - children[split]
        count = np.diff(np.r_[first, len(point)])
        nodes.append([place[first], place[first] + count, np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), np.sqrt(np.maximum.reduceat(away, first))])
        total += len(first)
    start, end, child, children, radius = (np.concatenate(c) for c in zip(*nodes, strict=True))
    return Forest(points[perm], perm % max(rows, 1), start, end, child, children, radius, parts)


def _squares(forest: Forest, books: np.ndarray, point: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distances of points to entries of their part's codebook, pair by pair."""
    rows = len(forest.points) // forest.parts
    out = np.empty(len(point), np.int64)
    for a in range(0, len(point), PAIRS):
        p, e = point[a : a + PAIRS], entry[a : a + PAIRS]
        out[a : a + PAIRS] = ((forest.points[p] - books[p // rows, e]) ** 2).sum(axis=1)
    return out


def assign(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry (ties: lower index) of every point, as stretches ``start, end, entry`` that cover the points in no
    order, and how many pairs of points and entries were compared one by one."""
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    entries = books.shape[1]
    node = np.arange(forest.parts)
    owner, entry = np.repeat(np.arange(len(node)), entries), np.tile(np.arange(entries), len(node))
    compared = 0
    while len(node):
        # pairs (node, entry) stand node by node, entries rising
        d = _squares(forest, books, forest.start[node][owner], entry)
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        best, radius = np.minimum.reduceat(d, first), forest.radius[node]
        # the margin covers the rounding of the roots, so that no entry is ruled out wrongly
        bound = np.sqrt(best.astype(float)) + 2 * radius
        keep = np.where(radius[owner] > 0, np.sqrt(d.astype(float)) <= bound[owner] * (1 + 1e-9) + 1e-9, d == best[owner])
        owner, entry = owner[keep], entry[keep]
        count = np.bincount(owner, minlength=len(node))
        first = np.cumsum(count) - count
        sure = (count == 1) | (radius == 0)
        whole.append((forest.start[node[sure]], forest.end[node[sure]], entry[first[sure]]))
        leaf = np.flatnonzero(~sure & (forest.children[node] == 0))
        if len(leaf):
            size = (forest.end - forest.start)[node[leaf]]
            point, held = stretches(forest.start[node[leaf]], size), np.repeat(leaf, size)
            step = max(1, PAIRS // entries)
            for a in range(0, len(point), step):
                p, h = point[a : a + step], held[a : a + step]
                e = entry[stretches(first[h], count[h])]
                d = _squares(forest, books, np.repeat(p, count[h]), e)
                compared += len(d)
                begin = np.cumsum(count[h]) - count[h]
                hit = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, begin), count[h]))
                whole.append((p, p + 1, e[hit[np.searchsorted(hit, begin)]]))
        inner = np.flatnonzero(~sure & (forest.children[node] > 0))
        below = forest.children[node[inner]]
        parent = np.repeat(inner, below)
        node = stretches(forest.child[node[inner]], below)
        entry = entry[stretches(first[parent], count[parent])] if len(parent) else entry[:0]
        owner = np.repeat(np.arange(len(node)), count[parent])
    start, end, entry = (np.concatenate(c) for c in zip(*whole, strict=True))
    return start, end, entry, compared


def sums_of(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sums of the points nearest to each entry: (parts, entries) and (parts, entries, dims of a part)."""
    parts, entries, dims = books.shape
    start, end, entry, _ = assign(forest, books)
    running = np.zeros((len(forest.points) + 1, dims), np.int64)
    np.cumsum(forest.points, axis=0, out=running[1:])
    key = start // (len(forest.points) // parts) * entries + entry
    number, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, dims), np.int64)
    np.add.at(number, key, end - start)
    np.add.at(sums, key, running[end] - running[start])
    return number.reshape(parts, entries), sums.reshape(parts, entries, dims)


def codes_of(forest: Forest, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of every row and part, (rows, parts), and the squared distances of a row added up."""
    start, end, entry, _ = assign(forest, books)
    order = np.argsort(start)
    label = np.repeat(entry[order], (end - start)[order])
    d = _squares(forest, books, np.arange(len(label)), label)
    rows = len(label) // forest.parts
    codes, errors = np.empty((rows, forest.parts), np.uint8), np.empty((rows, forest.parts), np.int64)
    part = np.arange(len(label)) // rows
    codes[forest.row, part], errors[forest.row, part] = label, d
    return codes, errors.sum(axis=1)


# ---------------------------------------------------------------- on Spark


_FOREST = "keys binary, q binary, row binary, start binary, end binary, child binary, children binary, radius binary, n int, dims int"


def forests(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """One row per block of ``vectors(vec_id, label, embedding)``: the ids and labels, the integer rows and the trees."""

    def block(table: pa.Table) -> pa.RecordBatch:
        q = quantise(matrix(table.column("embedding").combine_chunks()))
        if not q.shape[1] or q.shape[1] % parts:
            raise ValueError(f"vectors of {q.shape[1]} entries have no {parts} equal parts")
        forest, sink = plant(q, parts), pa.BufferOutputStream()
        keys = table.select(["vec_id", "label"])
        with pa.ipc.new_stream(sink, keys.schema) as out:
            out.write_table(keys)
        small = np.int16 if np.abs(q).max() < 1 << 15 else np.int32
        rows = [sink.getvalue().to_pybytes(), q.astype(small).tobytes(), forest.row.astype(np.int32).tobytes()]
        rows += [getattr(forest, a).astype(np.int32).tobytes() for a in _NODE] + [forest.radius.tobytes()]
        return pa.RecordBatch.from_arrays([*[pa.array([r], pa.binary()) for r in rows], pa.array([len(q)], pa.int32()), pa.array([q.shape[1]], pa.int32())], names=["keys", "q", "row", *_NODE, "radius", "n", "dims"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = dims = 0
        for batch in batches:
            while batch.num_rows:
                lengths = np.diff(batch.column(2).offsets.to_numpy())
                if (lengths != (dims := dims or int(lengths[0]))).any():
                    raise ValueError("vectors of unequal length")
                size = max(64, BLOCK_VALUES // max(dims, 1))
                held.append(batch.slice(0, size - rows))
                rows += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if rows == size:
                    yield block(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            yield block(pa.Table.from_batches(held))

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, _FOREST)


def _read_forests(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[pa.Table, Forest]]:
    for batch in batches:
        for r in range(batch.num_rows):
            raw = {name: batch.column(name)[r].as_buffer() for name in batch.schema.names if name not in ("n", "dims")}
            n, dims = batch.column("n")[r].as_py(), batch.column("dims")[r].as_py()
            q = np.frombuffer(raw["q"], np.int16 if raw["q"].size == 2 * n * dims else np.int32).astype(np.int64).reshape(n, dims)
            row = np.frombuffer(raw["row"], np.int32)
            points = parted(q, parts)[np.repeat(np.arange(parts) * n, n) + row]
            shape = [np.frombuffer(raw[name], np.int32).astype(np.int64) for name in _NODE]
            yield pa.ipc.open_stream(raw["keys"]).read_all(), Forest(points, row, *shape, np.frombuffer(raw["radius"]), parts)


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry becomes the floored mean of the points nearest to it, unused ones stay.
    Tasks emit sums per entry; those of all tasks, as large as the codebooks, reach the driver."""
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, dims), np.int64)
        for _, forest in _read_forests(batches, parts):
            more = sums_of(forest, books)
            number, sums = number + more[0], sums + more[1]
        part, entry = np.nonzero(number)
        at = np.repeat(np.arange(len(part)), dims)
        columns = [part[at].astype(np.int32), entry[at].astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(part)), number[part, entry][at], sums[part, entry].ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "n", "s"])

    added = trees.mapInArrow(run, "part int, entry int, place int, n long, s long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for r in added.collect():
        out[r.part, r.entry, r.place] = r.s // r.n
    return out


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all integers by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_group_sum(rows: DataFrame, key: str, value: str, name: str, hot: int = 1000) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows of equal ``key``, nulls together.

    Sums are folded per task.  Those of keys with more than one row in ``hot``, fewer than ``hot``
    of them, are broadcast; the other rows, of which no key holds many, are joined by key.  ``rows``
    should be a written table.
    """
    total = rows.count()
    sums = cut(rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("_n")), "group-sums")
    frequent = F.broadcast(sums.where(F.col("_n") * hot > total).withColumn("_hot", F.lit(True)).drop("_n"))
    marked = rows.join(frequent, rows[key].eqNullSafe(frequent["_key"]), "left").drop("_key")
    rare = sums.where(F.col("_n") * hot <= total).drop("_n")
    rest = marked.where("_hot IS NULL").drop("_hot", name)
    rest = rest.join(rare, rest[key].eqNullSafe(rare["_key"])).drop("_key")
    return marked.where("_hot").drop("_hot").unionByName(rest)


def product_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256``: one row per vector with usable entries.

    ``vectors(vec_id, label, embedding)``; rows whose vector is null or holds null or non-finite entries are
    dropped.  The codebook of a part starts as that part of the ``entries`` smallest ids (ties: smaller
    vector; a null id is the largest; fewer rows give fewer entries, equal ones stay apart and the
    lower index wins).  ``code`` has two hex digits per part, ``error`` is the squared distance to the coded
    vector, ``label_error`` its sum over the rows of equal ``label``, nulls together.  Repeated rows and ids stay
    and count each.  An empty table gives no rows; other columns are not read.  Vectors of unequal length, of
    no ``parts`` equal parts, or with entries beyond a million in size are an error.
    """
    if not 0 < entries <= 256:
        raise ValueError("two hex digits name 1 to 256 entries")
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding")))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    id_type, label_type = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label"))
    if not len(first):
        return spark.createDataFrame([], f"vec_id {id_type}, label {label_type}, code string, error long, label_error long, codebooks_sha256 string")
    trees = cut(forests(rows, parts), "cover-trees")
    start = quantise(matrix(first))
    books = parted(start, parts).reshape(parts, len(start), -1)
    for _ in range(rounds):
        books = lloyd_round(trees, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, forest in _read_forests(batches, parts):
            codes, error = codes_of(forest, books)
            text = codes.tobytes().hex()
            code = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            ids = [keys.column(c).combine_chunks() for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*ids, pa.array(code, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = cut(trees.mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long"), "codes")
    return with_group_sum(coded, "label", "error", "label_error").withColumn("codebooks_sha256", F.lit(books_digest(books)))
