"""Jaccard join of word n-gram sets with R-trees over count vectors.

A document's set holds the hashes (64 bit) of its distinct n-grams, or of the whole word sequence if it is shorter. Documents with
one set are one class, named by its smallest key; classes are what is joined.

* **Points.** Tokens of a set are hashed into groups; the counts per group are its point. With a the counts of A and b those of B,
  the overlap of the sets is at most the sum of min(a, b). The number of groups doubles with the size of the set, and counts over half as
  many groups are sums of two, so sets of different sizes compare over the smaller number.
* **Cells.** The same bound over two groups, a set's smallest tokens and the rest, tells that linked sets share one of their smallest
  ``n - ceil(t n) + 1`` tokens. Each such token is a cell; sets meet only in cells.
* **Trees.** The points of a cell are packed into an R-tree (strips by size, then by coordinates). The upper corners of two boxes bound
  the overlap of all pairs below; pairs of points that survive are verified on the sets themselves, made again from the texts.

Groups of copies are not expanded: neighbours within a cell and the cell's first member are verified first and give components; the
trees then look only for pairs that join different components. Members that have such pairs are put into clusters of pairs that may link;
each set goes to its cluster once, and the links that join components come back: a few rows for a member, never all pairs. A cell or
cluster with more than ``CELL`` members is cut into blocks, and every
pair of blocks is a task of its own, so no task grows with a token's frequency. Python gets ``BATCH_ROWS`` rows at a time, and what is made
of them is sent on in pieces of about ``PIECE`` bytes: a row has a point for each of its cells, many times what came in.

Null, empty or blank text: an empty set, linked with nothing. Rows that share a key are one document linked by any of its texts. A
null key: the row comes back without links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basisflow.llm.common import Words, mix, packed_rows, packed_schema, partitions, small_batches, text_blocks, to_partitions, unpack
from basisflow.llm.graph import components, local_components
from basisflow.plans.lineage import written

WORDS, CELL, LEAF, FAN, GROUPS, PER_GROUP = 5, 4096, 32, 8, 32, 4
_odd = np.random.default_rng(77).integers(0, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_BYTES = 4 << 20  # counts compared at a time
BATCH_ROWS, PIECE = 1000, 8 << 20
Share = tuple[int, int]  # threshold as a fraction, numerator and denominator


def ngram_sets(data: np.ndarray, starts: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of each row of a block."""
    w = Words(data, starts, lower=True)
    h, out = w.hash, []
    if len(h) >= words:
        grams = h[:len(h) - words + 1] * _odd[0]
        for k in range(1, words):
            grams = grams + h[k:len(h) - words + 1 + k] * _odd[k]
        grams = mix(grams)
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a:b - words + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _odd[8:8 + b - a]).sum(keepdims=True) + _odd[32 + b - a]))
        else:
            out.append(h[:0])
    return out


def digest(tokens: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    sums = [mix(tokens + _odd[60]).sum(dtype=np.uint64), mix(tokens ^ _odd[61]).sum(dtype=np.uint64)]
    return np.array(sums + [len(tokens)], np.uint64).tobytes()


def groups_for(n: np.ndarray | int) -> np.ndarray | int:
    """Groups of a set of n tokens: ``PER_GROUP`` tokens to a group on average, at most."""
    return GROUPS << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / (PER_GROUP * GROUPS)))).astype(int)


def point(tokens: np.ndarray) -> np.ndarray:
    g = int(groups_for(len(tokens)))
    counts = np.bincount((tokens & np.uint64(g - 1)).astype(np.int64), minlength=g)
    if counts.max(initial=0) > 255:
        raise ValueError("a group of hashed tokens has over 255 where 4 are expected")
    return counts.astype(np.uint8)


def folded(points: np.ndarray, groups: int) -> np.ndarray:
    """Counts over fewer groups."""
    points = points.astype(np.uint16) if points.shape[1] > groups else points
    while points.shape[1] > groups:
        half = points.shape[1] // 2
        points = points[:, :half] + points[:, half:]
    return points


def reachable(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, share: Share) -> np.ndarray:
    """Can sets of these sizes with at most this overlap link?"""
    top, bottom = share
    return (top + bottom) * overlap.astype(np.int64) >= top * (na.astype(np.int64) + nb)


class CountTree:
    """A packed R-tree. ``levels[0]`` are leaves; a level holds upper corners, smallest and largest set sizes and first children."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        strips = max(1, int(np.sqrt(len(sizes) / LEAF)))
        order = np.argsort(sizes, kind="stable")
        widest = int(np.argmax(points.astype(np.float32).var(0)))
        strip = np.arange(len(order)) * strips // max(len(order), 1)
        self.order = order[np.lexsort([points[order, widest], strip])]
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels, upper, low, high, fan = [], self.points, self.sizes, self.sizes, LEAF
        while True:
            first = np.arange(0, len(upper), fan)
            ends = np.append(first[1:], len(upper))
            upper, low, high = np.maximum.reduceat(upper, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)
            self.levels.append((upper, low, high, first, ends))
            if len(upper) == 1:
                break
            fan = FAN


def tree_join(a: CountTree, b: CountTree, share: Share) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (into the points given to a and to b) that the bound leaves; for ``a is b`` each pair once."""
    same = a is b
    u, v = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(max(len(a.levels), len(b.levels)) - 1, -1, -1):
        # a lower tree waits with its root for the other
        (ua, la, ha, fa, ea), (ub, lb, hb, fb, eb) = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        if depth == 0:
            step = max(1, _BYTES // (LEAF * LEAF * ua.shape[1]))
            for lo in range(0, len(u), step):
                yield from _leaf_pairs(a, b, fa, ea, fb, eb, u[lo:lo + step], v[lo:lo + step], same, share)
            return
        next_u, next_v = [], []
        ca = a.levels[min(depth - 1, len(a.levels) - 1)]
        cb = b.levels[min(depth - 1, len(b.levels) - 1)]
        step = max(1, _BYTES // (FAN * FAN * ua.shape[1]))
        for lo in range(0, len(u), step):
            x, y = _crossed(u[lo:lo + step], v[lo:lo + step], (fa, ea) if depth < len(a.levels) else None, (fb, eb) if depth < len(b.levels) else None)
            if same:
                x, y = x[x <= y], y[x <= y]
            fits = (ca[1][x] * share[0] <= cb[2][y] * share[1]) & (cb[1][y] * share[0] <= ca[2][x] * share[1])
            x, y = x[fits], y[fits]
            fits = reachable(np.minimum(ca[0][x], cb[0][y]).sum(1), ca[1][x], cb[1][y], share)
            next_u.append(x[fits])
            next_v.append(y[fits])
        u, v = np.concatenate(next_u), np.concatenate(next_v)
        if not len(u):
            return


def _crossed(u, v, kids_a, kids_b) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs (u, v); None: that node stays."""
    fa, na = (kids_a[0][u], kids_a[1][u] - kids_a[0][u]) if kids_a else (u, np.ones_like(u))
    fb, nb = (kids_b[0][v], kids_b[1][v] - kids_b[0][v]) if kids_b else (v, np.ones_like(v))
    n = na * nb
    pair = np.repeat(np.arange(len(u)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return fa[pair] + k // nb[pair], fb[pair] + k % nb[pair]


def _leaf_pairs(a, b, fa, ea, fb, eb, u, v, same, share):
    x, y = _crossed(u, v, (fa, ea), (fb, eb))
    if same:
        x, y = x[x < y], y[x < y]
    fits = (a.sizes[x] * share[0] <= b.sizes[y] * share[1]) & (b.sizes[y] * share[0] <= a.sizes[x] * share[1])
    x, y = x[fits], y[fits]
    fits = reachable(np.minimum(a.points[x], b.points[y]).sum(1), a.sizes[x], b.sizes[y], share)
    yield a.order[x[fits]], b.order[y[fits]]


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, points = [], [], []
            for _, _, data, starts in text_blocks(batch.column("text")):
                for s in ngram_sets(data, starts, words):
                    n.append(len(s))
                    names.append(digest(s))
                    points.append(point(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(points, pa.binary())],
                                             ["id", "n", "digest", "point"])
    return run


def _postings(words: int, share: Share, n_parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, tokens, owner, size = set(), [], [], 0

        def packed():
            every = np.concatenate(tokens)
            return packed_rows((mix(every) % np.uint64(n_parts)).astype(np.int64), n_parts, every, np.concatenate(owner))

        for batch in batches:
            ids = batch.column("id").to_numpy()
            for lo, _, data, starts in text_blocks(batch.column("text")):
                for r, s in enumerate(ngram_sets(data, starts, words)):
                    name = digest(s)
                    if len(s) and name not in seen:
                        seen.add(name)
                        tokens.append(s[:len(s) - -(-len(s) * share[0] // share[1]) + 1].copy())
                        owner.append(np.full(len(tokens[-1]), ids[lo + r]))
                        size += 2 * tokens[-1].nbytes
                if size >= PIECE:
                    yield packed()
                    seen, tokens, owner, size = set(), [], [], 0
        if tokens:
            yield packed()
    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind 0, id, token, members) of tokens with several members, and (kind 1, id, id, 0) of neighbours and of first members."""
    token, owner = unpack(batches, "<u8", "<i8")
    if not len(token):
        return
    order = np.lexsort([owner, token])
    token, owner = token[order], owner[order]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])])
    token, owner = token[new], owner[new]
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    size = np.diff(np.append(head, len(token)))
    size, first = np.repeat(size, size), np.repeat(head, size)
    linked = np.flatnonzero(np.arange(len(token)) > first)
    pairs = np.unique(np.concatenate([np.stack([owner[linked - 1], owner[linked]], 1), np.stack([owner[first[linked]], owner[linked]], 1)]), axis=0)
    cells = np.flatnonzero(size > 3)  # of three or fewer members, all pairs are among the above
    yield from _rows(0, owner[cells], token[cells].view(np.int64), size[cells])
    yield from _rows(1, pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64))


def _rows(kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(columns[0]), 1 << 18):
        part = [pa.array(c[lo:lo + (1 << 18)]) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], ["kind", "a", "b", "members"])


def _cells(n_parts: int):
    """Points on their way to their cells: token, block pair and side, id, component, size, groups, counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("cells")
            inner, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            owner = np.repeat(np.arange(len(batch)), np.diff(bounds))
            ids, component, n = (batch.column(c).to_numpy() for c in ("id", "component", "n"))
            members, token = inner.field("members").to_numpy(), inner.field("token").to_numpy().view(np.uint64)
            points = np.array(batch.column("point").to_pylist(), object)
            weight = np.cumsum(-(-members // CELL) * np.array([len(p) + 33 for p in points])[owner])
            begin = 0
            while begin < len(owner):
                # one member of a cell at least
                end = max(begin + 1, int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + PIECE, "right")))
                row = owner[begin:end]
                at, cell, side = _block_pairs(ids[row], members[begin:end], token[begin:end])
                row, begin = row[at], end
                part = (cell % np.uint64(n_parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
                lines = []
                for p in np.flatnonzero(np.diff(cuts)):
                    o = order[cuts[p]:cuts[p + 1]]
                    fields = (cell[o], ids[row[o]], component[row[o]], n[row[o]].astype(np.int64), side[o])
                    lines.append((p, *[f.tobytes() for f in fields], b"".join(points[row[o]])))
                yield _packed_fields(lines)
    return run


def _packed_fields(lines: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 0 else pa.binary()) for k, c in enumerate(zip(*lines, strict=True))],
                                      ["part", *[f"c{k}" for k in range(6)]])


def _cells_of(cell: np.ndarray, *then: np.ndarray) -> Iterator[np.ndarray]:
    """Positions of each cell with two members at least."""
    order = np.lexsort([*then, cell])
    head = np.flatnonzero(np.concatenate([[True], cell[order][1:] != cell[order][:-1]]))
    for lo, hi in zip(head, np.append(head[1:], len(order)), strict=True):
        if hi - lo > 1:
            yield order[lo:hi]


def _survivors(share: Share):
    """(a, b): members that some tree pairs with a member of another component, hung on the first of those they hang together with."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, component, n, side, counts = unpack(batches, "<u8", "<i8", "<i8", "<i8", "u1", "u1")
        if not len(cell):
            return
        groups = groups_for(n)
        at, low, found = np.cumsum(groups) - groups, np.zeros(len(cell), np.int64), []
        for o in _cells_of(cell, ids, groups, side):
            if (component[o] != component[o[0]]).any():
                low[o] = np.arange(len(o))
                for a, b in _cell_join(o, side[o], groups, at, n, counts, share):
                    apart = (component[a] != component[b]) & (low[a] != low[b])
                    if apart.any():
                        low[o] = local_components(len(o), low[a[apart]], low[b[apart]])[low[o]]
                hung = low[o] != np.arange(len(o))
                found.append(np.stack([ids[o[hung]], ids[o[low[o[hung]]]]], 1))
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    return run


def _block_pairs(ids: np.ndarray, members: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For members of groups: (position, cell, side) of every pair of blocks that a member belongs to. A group of up to CELL is one block."""
    blocks = -(-members // CELL)
    own = (mix(ids.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
    at = np.repeat(np.arange(len(ids)), blocks)
    j = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    i = own[at]
    low, high = np.minimum(i, j), np.maximum(i, j)
    return at, mix(name[at] + mix((low << 32 | high).view(np.uint64))), np.where(low == high, 0, np.where(i == low, 1, 2)).astype(np.uint8)


def _with_sets(words: int, n_parts: int):
    """Sets on their way to the blocks of their cluster."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, component = batch.column("id").to_numpy(), batch.column("component").to_numpy()
            at, cell, side = _block_pairs(ids, batch.column("members").to_numpy(), batch.column("cluster").to_numpy().view(np.uint64))
            bounds, lines, size = np.searchsorted(at, np.arange(len(ids) + 1)), [], 0
            for lo, _, data, starts in text_blocks(batch.column("text")):
                for r, tokens in enumerate(ngram_sets(data, starts, words), lo):
                    for k in range(bounds[r], bounds[r + 1]):
                        fields = cell[k:k + 1], ids[r:r + 1], component[r:r + 1], np.array([len(tokens)]), side[k:k + 1], tokens
                        lines.append((int(cell[k] % np.uint64(n_parts)), *[f.tobytes() for f in fields]))
                        size += tokens.nbytes
                        if size >= PIECE:
                            yield _packed_fields(lines)
                            lines, size = [], 0
            if lines:
                yield _packed_fields(lines)
    return run


def _linked_in_cells(share: Share):
    """Verified links of each cell, no more than it takes to join its components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, component, n, side, tokens = unpack(batches, "<u8", "<i8", "<i8", "<i8", "u1", "<u8")
        begin, groups, links = np.cumsum(n) - n, groups_for(n), []
        sets = [tokens[b:b + k] for b, k in zip(begin, n, strict=True)]
        place, low = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
        for o in _cells_of(cell, ids, groups, side):
            counts = np.zeros(groups[o].sum(), np.uint8)
            place[o] = np.cumsum(groups[o]) - groups[o]
            for k in o:
                counts[place[k]:place[k] + groups[k]] = point(sets[k])
            low[o] = np.unique(component[o], return_inverse=True)[1]
            for a, b in _cell_join(o, side[o], groups, place, n, counts, share):
                for lo in range(0, len(a), 512):
                    x, y = a[lo:lo + 512], b[lo:lo + 512]
                    apart = low[x] != low[y]
                    found = [(i, j) for i, j in zip(x[apart], y[apart], strict=True) if linked(sets[i], sets[j], share)]
                    if found:
                        i, j = np.array(found).T
                        links.append(np.stack([ids[i], ids[j]], 1))
                        low[o] = local_components(len(o), low[i], low[j])[low[o]]
        if links:
            pairs = np.unique(np.sort(np.concatenate(links), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
    return run


def linked(x: np.ndarray, y: np.ndarray, share: Share) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True)) if len(x) and len(y) else 0
    return both > 0 and share[1] * both >= share[0] * (len(x) + len(y) - both)


def _cell_join(o, side, groups, at, n, counts, share):
    """Index pairs of one cell, by one tree for each side and number of groups."""
    trees = {}
    for s in np.unique(side):
        for g in np.unique(groups[o[side == s]]):
            mine = o[(side == s) & (groups[o] == g)]
            points = counts[at[mine][:, None] + np.arange(g)]
            trees[s, g] = mine, points, CountTree(points, n[mine])
    for (s, g), (mine, points, tree) in trees.items():
        for (s2, g2), (other, points2, tree2) in trees.items():
            # sizes within the threshold differ by less than a factor of two: by one doubling of the groups at most
            if not (s == s2 == 0 and g <= g2 <= 2 * g or s == 1 and s2 == 2 and g2 in (g // 2, g, 2 * g)):
                continue
            small = min(g, g2)
            left = tree if g == small else CountTree(folded(points, small), n[mine])
            right = left if s == s2 and g == g2 else tree2 if g2 == small else CountTree(folded(points2, small), n[other])
            for i, j in tree_join(left, right, share):
                yield mine[i], other[j]


def _bounded(share: Share):
    """Keeps (a, b) of rows with both points whose bound can reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            keep = np.zeros(len(batch), bool)
            fits = (na * share[0] <= nb * share[1]) & (nb * share[0] <= na * share[1])
            pa_, pb_ = batch.column("pa"), batch.column("pb")
            for i in np.flatnonzero(fits):
                x, y = (np.frombuffer(p[i].as_buffer(), "u1")[None, :] for p in (pa_, pb_))
                g = min(x.shape[1], y.shape[1])
                keep[i] = reachable(np.minimum(folded(x, g), folded(y, g)).sum(1), na[i:i + 1], nb[i:i + 1], share)[0]
            yield batch.filter(pa.array(keep)).select(["a", "b"])
    return run


def _verified(words: int, share: Share):
    """Keeps (a, b) of rows with both texts whose sets link."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, 512) for whole in batches for lo in range(0, len(whole), 512)):
            sets = [[s for _, _, data, starts in text_blocks(batch.column(c)) for s in ngram_sets(data, starts, words)] for c in ("ta", "tb")]
            keep = [linked(x, y, share) for x, y in zip(*sets, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])
    return run


def join(docs: DataFrame, words: int = WORDS, share: Share = (80, 100), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_shingles, component_id (the smallest key reachable over links, itself included). Keys are whole numbers."""
    with small_batches(docs.sparkSession, BATCH_ROWS):  # what comes back has no Python stage left to run: it joins written tables
        return _join(docs, words, share, key, text)


def _join(docs: DataFrame, words: int, share: Share, key: str, text: str) -> DataFrame:
    spark, n_parts = docs.sparkSession, partitions(docs.sparkSession)
    every = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = every.where("id is not null")
    signed = written(every.mapInArrow(_signatures(words), "id bigint, n bigint, digest binary, point binary"), "signed")
    named = signed.where("id is not null and n > 0")
    classes = named.groupBy("digest").agg(F.min("id").alias("rep"))
    members = written(named.join(classes, "digest").select("id", "rep", "n", "point"), "members")
    points = members.where("id = rep").select("id", "n", "point").dropDuplicates()
    names = members.select("id", "rep").distinct()

    postings = to_partitions(rows.mapInArrow(_postings(words, share, n_parts), packed_schema(2)), n_parts)
    buckets = written(postings.mapInArrow(_buckets, "kind int, a bigint, b bigint, members bigint"), "buckets")

    def renamed(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(names.withColumnsRenamed({"id": side, "rep": f"r{side}"}), side)
        return pairs.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a < b").distinct()

    def with_points(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(points.withColumnsRenamed({"id": side, "n": f"n{side}", "point": f"p{side}"}), side)
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        # written first: its true size decides how the texts get to it
        pairs = written(pairs, "pairs")
        for side in ("a", "b"):
            pairs = pairs.join(rows.withColumnsRenamed({"id": side, "text": f"t{side}"}), side)
        return written(pairs.mapInArrow(_verified(words, share), "a bigint, b bigint"), "links")

    first = verified(renamed(buckets.where("kind = 1").select("a", "b")).transform(with_points).mapInArrow(_bounded(share), "a bigint, b bigint"))
    groups = written(components(first), "groups")
    cells = (buckets.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("token"), "members").join(names, "id")
             .groupBy("rep", "token").agg(F.max("members").alias("members")).withColumnRenamed("rep", "id")
             .join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    mixed = cells.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    placed = (cells.join(mixed, "token").groupBy("id", "component").agg(F.collect_list(F.struct("token", "members")).alias("cells"))
              .join(points, "id").select("id", "n", "point", "cells", "component"))
    crowded = to_partitions(placed.mapInArrow(_cells(n_parts), packed_schema(6)), n_parts)
    clusters = components(crowded.mapInArrow(_survivors(share), "a bigint, b bigint"))
    alive = (clusters.join(clusters.groupBy("component").agg(F.count("*").alias("members")), "component").withColumnsRenamed({"component": "cluster", "node": "id"})
             .join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    again = to_partitions(rows.join(written(alive, "alive"), "id").mapInArrow(_with_sets(words, n_parts), packed_schema(6)), n_parts)
    second = written(again.mapInArrow(_linked_in_cells(share), "a bigint, b bigint"), "links")
    # a key with several texts ties their classes together
    several = names.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").join(names, "id").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    whole = components(first.unionByName(second).unionByName(several.where("a <> b")))

    out = signed.select("id", "n").join(names.groupBy("id").agg(F.min("rep").alias("rep")), "id", "left")
    out = out.join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "id").alias("component_id"))


def oracle(name: str = "documents") -> str:
    """The join as DuckDB SQL: all pairs that share a shingle, counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {name}),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' '))) END AS s FROM w),
    u AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
    l AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c FROM u x JOIN u y ON x.t = y.t AND x.doc_id <> y.doc_id
          GROUP BY 1, 2) WHERE 100 * c >= 80 * (na + nb - c)),
    r AS (SELECT doc_id AS n, doc_id AS c FROM {name} UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.n)
    SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT n AS doc_id, min(c) AS component_id FROM r GROUP BY 1) USING (doc_id)"""
