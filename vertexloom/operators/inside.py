"""Searches inside components that one task can hold. A block is a bucket of whole components as arrays; all its searches advance together, so a level costs a few array operations
and no superstep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Edges that the searches of one run may look at: what bounds its arrays.
MOST = 2_000_000
#: Above any bound.
OPEN = 1 << 62
#: A row is a vertex (turn is null) or what a turn did.
REFINED = "bucket long, label long, id long, low long, up long, turn long, lower long, upper long, assigned long, pruned long"
#: weight: edges of the component.
LABELLED = "label long, weight long, src long, dst long, ways int"


def _read(batches: Iterator[pa.RecordBatch], **kinds: pa.DataType) -> pa.Table:
    """The columns of all batches, of which there may be none, nullable or not."""
    batches = list(batches)
    return pa.table({name: pa.chunked_array([x.column(name) for x in batches], kind) for name, kind in kinds.items()})


def _least(src, dst):
    """The ends of pairs, the place among them of the least of each one's component, and the place of each src."""
    import numpy as np

    ids, at = np.unique(np.concatenate((src, dst)), return_inverse=True)
    label, (a, b) = np.arange(len(ids)), at.reshape(2, -1)
    first = a
    while len(a):
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))  # a root goes to the least that it meets
        while not np.array_equal(label, further := label[label]):
            label = further
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return ids, label, first


def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id and label, the least of its component, of all ends of pairs (src, dst)."""
    pairs = _read(batches, src=pa.int64(), dst=pa.int64())
    ids, label, _ = _least(*(pairs[c].to_numpy() for c in ("src", "dst")))
    yield from pa.table({"id": ids, "label": ids[label]}).to_batches(max_chunksize=100_000)


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (src, dst, ways) with the label and weight of their components."""
    import numpy as np

    pairs = _read(batches, src=pa.int64(), dst=pa.int64(), ways=pa.int32())
    ids, label, first = _least(*(pairs[c].to_numpy() for c in ("src", "dst")))
    of, weight = label[first], np.zeros(len(ids), np.int64)
    np.add.at(weight, of, np.bitwise_count(pairs["ways"].to_numpy()).astype(np.int64))
    yield from pairs.add_column(0, "label", pa.array(ids[of])).add_column(1, "weight", pa.array(weight[of])).to_batches(max_chunksize=100_000)


class _Block:
    """Vertices by component and id, edges by their source. A row of the table is a pair of id and dst, with edges along its ways, or, where dst is null, a vertex of which more is given;
    the ends of pairs need no row of their own."""

    def __init__(self, table: pa.Table):
        import numpy as np  # only workers need it

        self.np = np
        vertex = table["dst"].is_null()
        v, e = table.filter(vertex), table.filter(table["dst"].is_valid())
        ids, first, at = np.unique(np.concatenate([x.to_numpy() for x in (e["id"], e["dst"], v["id"])]), return_index=True, return_inverse=True)
        label = np.concatenate([x.to_numpy() for x in (e["label"], e["label"], v["label"])])[first]
        order, n = np.lexsort((ids, label)), len(ids)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        a, b, self.given = np.split(place[at], (len(e), 2 * len(e)))
        self.table, self.label, self.ids = v, label[order], ids[order]
        along, back = (e["ways"].to_numpy() & way > 0 for way in (1, 2))
        src, dst = np.concatenate((a[along], b[back])), np.concatenate((b[along], a[back]))
        self.degree = np.bincount(src, minlength=n)
        self.at, self.dst = np.cumsum(self.degree) - self.degree, dst[np.argsort(src, kind="stable")]
        new = np.diff(self.label, prepend=self.label[:1] - 1) != 0
        self.component, self.start = np.cumsum(new) - 1, np.flatnonzero(new)
        self.size = np.diff(self.start, append=n)
        self.weight = self.size + np.bincount(self.component, self.degree, len(self.size)).astype(np.int64)

    def column(self, name: str, null: int):
        """What is given of the vertices, or else null."""
        out = self.np.full(len(self.ids), null)
        if name in self.table.column_names:
            out[self.given] = self.table[name].fill_null(null).to_numpy()
        return out

    def search(self, sources):
        """The distances from each source to all vertices of its component, one source after the other (-1: not reached), and where each source's begin."""
        np = self.np
        of = self.component[sources]
        begin = np.concatenate(([0], np.cumsum(self.size[of])))
        base = begin[:-1] - self.start[of]
        dist, last = np.full(begin[-1], -1, np.int64), np.empty(begin[-1], np.int64)
        who, at, depth = np.arange(len(sources)), sources, 0
        dist[base + at] = 0
        while len(at):
            depth += 1
            degree = self.degree[at]
            ends = np.cumsum(degree)
            edge = np.arange(ends[-1]) + np.repeat(self.at[at] - ends + degree, degree)
            who, at = np.repeat(who, degree), self.dst[edge]
            cell = base[who] + at
            fresh = np.flatnonzero(dist[cell] < 0)
            cell = cell[fresh]
            last[cell] = fresh  # of those that meet in a cell one stays
            one = last[cell] == fresh
            dist[cell] = depth
            who, at = who[fresh[one]], at[fresh[one]]
        return dist, begin

    def runs(self, sources) -> Iterator:
        """The sources in parts of about MOST edges."""
        np = self.np
        cut = np.flatnonzero(np.diff(np.cumsum(self.weight[self.component[sources]]) // MOST)) + 1
        return (part for part in np.split(sources, cut) if len(part))


def farthest(table: pa.Table) -> pa.Table:
    """id and ecc of all vertices, by a search from each."""
    block = _Block(table)
    return _farthest(block, block.np.arange(len(block.ids)))


def farthest_from_given(table: pa.Table) -> pa.Table:
    """The same of those that have a row of their own."""
    block = _Block(table)
    return _farthest(block, block.np.sort(block.given))


def _farthest(block: _Block, sources) -> pa.Table:
    np, ids, ecc = block.np, [], []
    for part in block.runs(sources):
        dist, begin = block.search(part)
        ids.append(block.ids[part])
        ecc.append(np.maximum.reduceat(dist, begin[:-1]))
    both = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (ids, ecc)]
    return pa.table({"id": pa.array(both[0], pa.int64()), "ecc": pa.array(both[1], pa.int64())})


def assigned(table: pa.Table) -> pa.Table:
    """id and ecc of all vertices, by bounds that meet everywhere."""
    rows = refiner(-1, 0)(table)
    return rows.filter(rows["turn"].is_null()).select(["id", "low"]).rename_columns(["id", "ecc"])


def refiner(least: int, greatest: int) -> Callable[[pa.Table], pa.Table]:
    """Bounds of each component refined, one search a turn, until no open vertex of it has a lower bound of `least` or less, or an upper one of `greatest` or more."""

    def refine(table: pa.Table) -> pa.Table:
        block, turns = _Block(table), []
        np = block.np
        low, up, component = block.column("low", 0), block.column("up", OPEN), block.component
        leaf = np.flatnonzero(block.degree == 1)
        hub = block.dst[block.at[leaf]]
        leaf, hub = leaf[block.degree[hub] > 1], hub[block.degree[hub] > 1]
        while True:
            free = low < up
            live = np.zeros(len(block.size), bool)
            live[component[free & ((low <= least) | (up >= greatest))]] = True
            if not live.any():
                break
            some = np.flatnonzero(free & live[component])
            some = some[np.lexsort((-block.degree[some], low[some] if len(turns) % 2 == 0 else -up[some], component[some]))]
            dist, begin = block.search(some[np.diff(component[some], prepend=-1) != 0])
            far = np.repeat(np.maximum.reduceat(dist, begin[:-1]), np.diff(begin))
            at, met = np.flatnonzero(live[component]), dist >= 0
            at, dist, far = at[met], dist[met], far[met]
            low_was, up_was = low.copy(), up.copy()
            low[at], up[at] = np.maximum(low[at], np.maximum(dist, far - dist)), np.minimum(up[at], far + dist)
            sure = (low[hub] == up[hub]) & (low[leaf] < up[leaf])
            own = np.ones(len(low), bool)
            own[leaf[sure]] = False
            turns.append([np.count_nonzero(own & x) for x in (low > low_was, up < up_was, free & (low == up))] + [np.count_nonzero(sure)])
            low[leaf[sure]] = up[leaf[sure]] = low[hub[sure]] + 1
        n, did, bucket = len(low), np.array(turns, np.int64).reshape(-1, 4), table["bucket"][0].as_py()
        bounds = {"bucket": np.full(n, bucket), "label": block.label, "id": block.ids, "low": low, "up": pa.array(up, mask=up == OPEN)}
        counts = {"bucket": np.full(len(did), bucket), "turn": np.arange(1, len(did) + 1)} | dict(zip(("lower", "upper", "assigned", "pruned"), did.T, strict=True))
        names = [x.split()[0] for x in REFINED.split(", ")]
        return pa.concat_tables(pa.table({c: pa.array(part[c], pa.int64()) if c in part else pa.nulls(size, pa.int64()) for c in names}) for part, size in ((bounds, n), (counts, len(did))))

    return refine
