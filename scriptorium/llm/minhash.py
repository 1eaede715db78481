"""MinHash near-dedup with bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch the `k`
smallest of them. Documents with equal sets are one class, of which only the smallest id
goes on. Inverted lists of retained values make candidates: two sets that are similar share
at least `need` values of their sketches, so among its rarest `k - need + 1` values each
must hold one that the other holds among its own; only those are listed, and values that
half of the corpus retains hardly ever are.

Lists are not expanded into pairs of rows. First each document is held against one other,
the smallest id of the list heads that it meets most often; the links found make
components, and a list inside one component needs nothing more. In the lists that are left
open, members outside the largest component are held against the list in cells of bounded
size: a task compares sketches there and yields only the members that the union's sketch
lets pass, each pair in one list alone. Those members' full sets then meet in cells of the
same kind, where exact Jaccard decides and a spanning forest of the links goes on. So rows
never outnumber a list's members by more than its tiles, and no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, few, materialise, spread, text_bytes, without_ids

#: Values in a sketch, and how many of them similar sets share at least: 64 draws at a
#: similarity of 0.8 come below 36 with a probability of 2e-6, at 0.85 of 1e-10.
K, NEED = 64, 36
#: Members of a list that are compared in one cell by their sketches, and shingles of full sets in one cell.
CELL_ROWS, CELL_SHINGLES = 4096, 1 << 20
#: Documents that are sent to the scan by name at most, with their cells; for more, texts are shuffled.
BROADCAST_SETS = 300_000
#: Partners of one document in a cell of the first round.
STAR_ROWS = 4096
#: Leading bits of a sketch's value that its code keeps: equal codes may only let more pairs pass to the exact test.
CODE_BITS = 31
#: Rows of a list from which on sketches are compared by products of matrices, and columns of such a product.
DENSE, COLUMNS = 64, 1024
#: Words whose hash a worker keeps at most.
KEPT_WORDS = 400_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits; 63 bits are kept, so signed and unsigned order agree."""
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(m)
    return (h ^ (h >> np.uint64(33))) >> np.uint64(1)


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


class Shingler:
    """Sets of shingle hashes, sorted; keeps the hashes of words that it has met."""

    def __init__(self, words: int):
        self.words, self.known = words, {}

    def set_of(self, body: bytes | None) -> np.ndarray:
        parts = body.lower().split() if body else []
        if not parts:
            return np.empty(0, np.uint64)
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        h = np.empty(len(parts), np.uint64)
        for i, w in enumerate(parts):
            x = known.get(w)
            if x is None:
                x = known[w] = word_hash(w)
            h[i] = x
        size = min(self.words, len(parts))
        s = np.full(len(parts) - size + 1, size, np.uint64)
        for j in range(size):
            s = _mixed(s * _A + h[j : len(h) - size + 1 + j] * _B)
        return np.unique(s)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(bodies: DataFrame, words: int, k: int) -> DataFrame:
    """(id, n, digest, sketch): size and digest of each document's set, its k smallest values; an empty set has no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.set_of(b) for b in batch.column("body").to_pylist()]
            short = [s[:k].astype(np.int64) for s in sets]
            sketch = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, short)]), pa.int32()), pa.array(np.concatenate([*short, np.empty(0, np.int64)])))
            yield pa.record_batch([batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), sketch], ["id", "n", "digest", "sketch"])

    return bodies.mapInArrow(run, "id bigint, n bigint, digest binary, sketch array<bigint>")


def listed_values(reps: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """(id, n, listed): of each document, its rarest retained values among those that others retain too.

    A set that its sketch holds in full, as do those of all similar sets, needs exactly
    its share of common values; the others need `need`.
    """
    postings = reps.select("id", F.explode("sketch").alias("value"))
    common = postings.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    whole = F.floor(F.lit(k) * percent / 100)
    needed = F.when(F.col("n") <= whole, F.ceil(F.col("n") * percent / 100)).otherwise(F.least(F.lit(need), F.ceil(F.col("n") * percent / 100)))
    shared = postings.join(common, "value").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("values"))
    held = shared.join(reps.select("id", "n", F.least("n", F.lit(k)).alias("kept")), "id")
    # values of this document alone are its rarest and make no list
    length = F.col("kept") - needed + 1 - (F.col("kept") - F.size("values"))
    rarest = F.slice("values", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    return held.select("id", "n", F.transform(rarest, lambda x: x["value"]).alias("listed")).filter("size(listed) > 0")


def _fits(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return (F.least(a, b) * 100) >= F.greatest(a, b) * percent


def _codes(values: str) -> Column:
    """Leading bits of hashes, in their order."""
    return F.transform(values, lambda v: F.shiftright(v, 63 - CODE_BITS).cast("int"))


def star(lists: DataFrame, coded: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """(a, b): each document b with the list head that it meets most often, where the union's sketch lets the pair pass."""
    met = lists.filter("first <> id").filter(_fits("first_n", "n", percent))
    often = met.groupBy("id", "first").agg(F.count("*").alias("c"))
    pairs = often.groupBy(F.col("id").alias("b")).agg(F.max_by("first", F.struct("c", -F.col("first"))).alias("a"))
    side = lambda x: coded.select(F.col("id").alias(x), F.col("codes").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    shared = F.size(F.array_intersect(F.array_intersect(union, F.col("sa")), F.col("sb")))
    return both.filter(shared * k >= F.size(union) * need).select("a", "b")


def star_cells(pairs: DataFrame) -> DataFrame:
    """(id, component, cell, side): b's around their a, those of a document with very many dealt over several cells."""
    load = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_ROWS).cast("int").alias("parts"))
    dealt = pairs.join(load, "a")
    cell = lambda part: F.xxhash64("a", part)
    outer = dealt.select(F.col("b").alias("id"), cell(F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).alias("cell"), F.lit(2).alias("side"))
    centre = load.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(F.col("a").alias("id"), cell(F.col("part")).alias("cell"), F.lit(0).alias("side"))
    return outer.unionByName(centre).select("id", F.col("id").alias("component"), "cell", "side")


def still_open(lists: DataFrame, part: DataFrame) -> DataFrame:
    """(value, id, n, component, largest) of the lists that hold several components."""
    placed = lists.select("value", "id", "n").join(part, "id")
    groups = placed.groupBy("value", "component").agg(F.count("*").alias("c"))
    largest = groups.groupBy("value").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("largest")).filter("parts > 1").select("value", "largest")
    return placed.join(largest, "value").select("value", "id", "n", "component", "largest")


def list_cells(members: DataFrame, weight: Column, room: int) -> DataFrame:
    """members with cell and side: lists cut into tiles by hash; a cell holds what is outside the largest component of one tile against all of another.

    side 0 is held against, 2 is what is held, 1 both. A list of one tile is one cell, and
    each of its rows goes there once.
    """
    tiles = members.groupBy("value").agg(F.ceil(F.sum(weight) / room).cast("int").alias("tiles"))
    own = members.join(tiles, "value").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    other = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda i: i != F.col("tile"))
    outside = F.col("component") != F.col("largest")
    at = lambda i, j, side: F.struct(F.xxhash64("value", i, j).alias("cell"), side.alias("side"))
    here = at(F.col("tile"), F.col("tile"), F.when(outside, 1).otherwise(0))
    cells = F.concat(F.array(here), F.transform(other, lambda i: at(i, F.col("tile"), F.lit(0))), F.when(outside, F.transform(other, lambda j: at(F.col("tile"), j, F.lit(2)))).otherwise(F.array().cast("array<struct<cell:bigint,side:int>>")))
    return own.withColumn("x", F.explode(cells)).select(*members.columns, "x.cell", "x.side")


class Rows:
    """Rows of cells, of any number: columns, and ragged arrays as values with offsets."""

    def __init__(self, columns: dict[str, np.ndarray], ragged: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.columns, self.ragged = columns, ragged

    @classmethod
    def of(cls, batch: pa.RecordBatch, columns: list[str], ragged: list[str]) -> Rows:
        found = {}
        for name in ragged:
            x = batch.column(name)
            at = x.offsets.to_numpy().astype(np.int64)
            found[name] = (x.values.to_numpy()[at[0] : at[-1]], at - at[0])
        return cls({c: batch.column(c).to_numpy() for c in columns}, found)

    def __len__(self) -> int:
        return len(self.columns["cell"])

    def cut(self, a: int, b: int) -> Rows:
        return Rows({c: x[a:b] for c, x in self.columns.items()}, {c: (v[at[a] : at[b]], at[a : b + 1] - at[a]) for c, (v, at) in self.ragged.items()})

    def take(self, which: np.ndarray) -> Rows:
        out = {}
        for c, (v, at) in self.ragged.items():
            size = at[which + 1] - at[which]
            ends = np.cumsum(size)
            out[c] = (v[np.repeat(at[which] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)], np.concatenate([[0], ends]))
        return Rows({c: x[which] for c, x in self.columns.items()}, out)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        if len(parts) == 1:
            return parts[0]
        columns = {c: np.concatenate([p.columns[c] for p in parts]) for c in parts[0].columns}
        ragged = {}
        for c in parts[0].ragged:
            size = np.concatenate([np.diff(p.ragged[c][1]) for p in parts])
            ragged[c] = (np.concatenate([p.ragged[c][0] for p in parts]), np.concatenate([[0], np.cumsum(size)]))
        return Rows(columns, ragged)

    def sizes(self, name: str) -> np.ndarray:
        return np.diff(self.ragged[name][1])

    def matrix(self, name: str, width: int) -> np.ndarray:
        """Rows filled up to a width with what no code is."""
        v, at = self.ragged[name]
        out = np.full((len(at) - 1, width), PAD, np.int64)
        size = np.diff(at)
        out[np.repeat(np.arange(len(size)), size), np.arange(len(v)) - np.repeat(at[:-1], size)] = v
        return out


PAD = np.iinfo(np.int64).max


def shared_counts(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many values each ragged row of x has in common with each of y, whose rows hold distinct values: products of slices of the incidence matrices."""
    (vx, ax), (vy, ay) = x, y
    both = np.intersect1d(vx, vy)
    out = np.zeros((len(ax) - 1, len(ay) - 1), np.float32)
    placed = []
    for v, at in ((vx, ax), (vy, ay)):
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        col = np.searchsorted(both, v)
        hit = col < len(both)
        hit[hit] = both[col[hit]] == v[hit]
        order = np.argsort(col[hit], kind="stable")
        placed.append((row[hit][order], col[hit][order]))
    for c in range(0, len(both), COLUMNS):
        part = []
        for (row, col), n in zip(placed, out.shape, strict=True):
            a, b = np.searchsorted(col, [c, c + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(both) - c)), np.float32)
            m[row[a:b], col[a:b] - c] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def merged_shares(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of sketches (rows of codes, PAD after their end): the union's sketch's size, and how much of it both hold."""
    m = np.concatenate([x, y], 1)
    m.sort(1)
    real = m < PAD
    again = np.zeros(m.shape, bool)
    again[:, 1:] = (m[:, 1:] == m[:, :-1]) & real[:, 1:]
    rank = np.cumsum(real & ~again, 1)
    return np.minimum(rank[:, -1], k), (again & (rank <= k)).sum(1)


def runs(batches: Iterator[pa.RecordBatch], columns: list[str], ragged: list[str], least: int) -> Iterator[Rows]:
    """Whole cells of a sorted partition, as many together as make `least` rows."""
    held: list[Rows] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = Rows.of(batch, columns, ragged)
        cell = rows.columns["cell"]
        last = int(np.flatnonzero(cell != cell[-1])[-1]) + 1 if cell[0] != cell[-1] else 0
        if held and cell[0] != held[-1].columns["cell"][-1] and sum(map(len, held)) >= least:
            yield Rows.joined(held)
            held = []
        if last and sum(map(len, held)) + last >= least:
            yield Rows.joined([*held, rows.cut(0, last)])
            held = []
            rows = rows.cut(last, len(rows))
        held.append(rows)
    if held:
        yield Rows.joined(held)


def passing(rows: Rows, k: int, need: int, percent: int) -> np.ndarray:
    """Which rows of whole cells have a partner across components in their cell whom the union's sketch lets pass, in no list of a smaller value."""
    cell, side, n, comp, value = (rows.columns[c] for c in ("cell", "side", "n", "component", "value"))
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    end = np.append(begin[1:], len(cell))
    hit = np.zeros(len(cell), bool)
    small = end - begin <= DENSE
    # small cells: pairs by index, many cells at a time
    out = np.flatnonzero((side > 0) & np.repeat(small, end - begin))
    first, size = np.repeat(begin, end - begin)[out], np.repeat(end - begin, end - begin)[out]
    codes = listed = None
    step = np.cumsum(size)
    at = 0
    while at < len(out):
        stop = max(at + 1, int(np.searchsorted(step, (step[at - 1] if at else 0) + 65536, "right")))
        o = np.repeat(out[at:stop], size[at:stop])
        i = np.repeat(first[at:stop], size[at:stop]) + np.arange(len(o)) - np.repeat(np.cumsum(size[at:stop]) - size[at:stop], size[at:stop])
        at = stop
        good = (side[i] < 2) & (comp[o] != comp[i]) & ((side[i] == 0) | (side[o] == 2) | (o < i)) & (np.minimum(n[o], n[i]) * 100 >= np.maximum(n[o], n[i]) * percent)
        o, i = o[good], i[good]
        if codes is None:
            codes, listed = rows.matrix("codes", k), rows.matrix("listed", k)
        for s in range(0, len(o), 8192):
            a, b = o[s : s + 8192], i[s : s + 8192]
            total, shared = merged_shares(codes[a], codes[b], k)
            likely = shared * k >= total * need
            a, b = a[likely], b[likely]
            if len(a):
                v = value[a][:, None]
                x, y = (np.where(listed[p] < v, listed[p], PAD) for p in (a, b))
                only = merged_shares(x, y, 2 * k)[1] == 0
                hit[a[only]] = hit[b[only]] = True
    for s, e in zip(begin[~small].tolist(), end[~small].tolist(), strict=True):
        part = rows.cut(s, e)
        inner, outer = np.flatnonzero(side[s:e] < 2), np.flatnonzero(side[s:e] > 0)
        # listed values below this list's own
        v, at = part.ragged["listed"]
        below = v < value[s]
        lower = (v[below], np.concatenate([[0], np.cumsum(below)])[at])
        for j in range(0, len(outer), 512):
            o = outer[j : j + 512]
            mine, all_in = part.take(o), part.take(inner)
            shared = shared_counts(mine.ragged["codes"], all_in.ragged["codes"])
            no, ni = n[s + o][:, None], n[s + inner][None, :]
            least = np.minimum(need, -(-np.maximum(no, ni) * percent // 100))
            ok = (shared >= least) & (comp[s + o][:, None] != comp[s + inner][None, :]) & (np.minimum(no, ni) * 100 >= np.maximum(no, ni) * percent)
            if ok.any():
                low = Rows({"cell": cell[s:e]}, {"x": lower})
                ok &= shared_counts(low.take(o).ragged["x"], low.take(inner).ragged["x"]) == 0
                hit[s + o[ok.any(1)]] = hit[s + inner[ok.any(0)]] = True
    return hit


def likely_members(cells: DataFrame, k: int, need: int, percent: int) -> DataFrame:
    """(value, id) of the rows that pass: what still has to be compared exactly, and in which list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, ["cell", "side", "value", "id", "n", "component"], ["codes", "listed"], 8192):
            hit = passing(rows, k, need, percent)
            if hit.any():
                yield pa.record_batch([pa.array(rows.columns["value"][hit]), pa.array(rows.columns["id"][hit])], ["value", "id"])

    return spread(cells, "cell").sortWithinPartitions("cell", "side").mapInArrow(run, "value bigint, id bigint")


def full_sets(bodies: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(cell, side, id, component, shingles): each wanted document's set, once for each of its cells.

    wanted: (id, digest, component, cells); rows that share an id but not the digest are
    left out. Where they are few, the wanted ids go to the scan and no text is shuffled.
    """
    rows = bodies.join(F.broadcast(wanted) if few(wanted, BROADCAST_SETS) else wanted, "id").select("id", "body", "digest", "component", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64).to_pydict()
                cells, sides, ids, comps, sets = [], [], [], [], []
                for d, body, digest, comp, own in zip(*(part[c] for c in ("id", "body", "digest", "component", "cells")), strict=True):
                    s = shingler.set_of(body)
                    if _digest(s) == digest:
                        for x in own:
                            cells.append(x["cell"])
                            sides.append(x["side"])
                            ids.append(d)
                            comps.append(comp)
                            sets.append(s)
                values = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, sets)]), pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.int64)))
                yield pa.record_batch([pa.array(cells, pa.int64()), pa.array(sides, pa.int32()), pa.array(ids, pa.int64()), pa.array(comps, pa.int64()), values], ["cell", "side", "id", "component", "shingles"])

    return rows.mapInArrow(run, "cell bigint, side int, id bigint, component bigint, shingles array<bigint>")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of links (a, b) as many as connect the same."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(names))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    rest = np.flatnonzero(label != np.arange(len(names)))
    return names[label[rest]], names[rest]


def exact(outer: Rows, inner: Rows, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the similar rows of outer and inner that lie in different components."""
    no, ni = outer.sizes("shingles"), inner.sizes("shingles")
    if len(ni) == 1:  # one document against many
        own, (v, at) = inner.ragged["shingles"][0], outer.ragged["shingles"]
        where = np.minimum(np.searchsorted(own, v), len(own) - 1)
        shared = np.diff(np.concatenate([[0], np.cumsum(own[where] == v)])[at])[:, None]
    else:
        shared = shared_counts(outer.ragged["shingles"], inner.ragged["shingles"]).astype(np.int64)
    union = no[:, None] + ni[None, :] - shared
    hit = (shared * 100 >= union * percent) & (outer.columns["component"][:, None] != inner.columns["component"][None, :])
    a, b = np.nonzero(hit)
    return outer.columns["id"][a], inner.columns["id"][b]


def links(bodies: DataFrame, cells: DataFrame, digests: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): in each cell, a forest of the exact links between rows that are held and those that they are held against.

    cells: (id, component, cell, side). Sets are not stored: one pass over the documents
    sends each to its cells. A task holds one cell's inner sets, and the outer ones go by.
    """
    of = cells.groupBy("id").agg(F.first("component").alias("component"), F.collect_set(F.struct("cell", "side")).alias("cells"))
    wanted = materialise(of.join(digests, "id"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inner, ends = None, [], []

        def found() -> pa.RecordBatch:
            a, b = forest(*(np.concatenate(x) for x in zip(*ends, strict=True)))
            ends.clear()
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        def compared(rows: Rows) -> None:
            if len(rows) and inner:
                held = Rows.joined(inner)
                inner[:] = [held]
                for i in range(0, len(rows), 256):
                    a, b = exact(rows.cut(i, min(i + 256, len(rows))), held, percent)
                    if len(a):
                        ends.append((a, b))

        def closed() -> None:
            """The rows of the inner side that are held themselves meet when it is complete."""
            if inner:
                held = Rows.joined(inner)
                inner[:] = [held]
                compared(held.take(np.flatnonzero(held.columns["side"] == 1)))

        ready = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = Rows.of(batch, ["cell", "side", "id", "component"], ["shingles"])
            cell, side = rows.columns["cell"], rows.columns["side"]
            border = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | ((side[1:] == 2) != (side[:-1] == 2))]))
            for s, e in zip(border.tolist(), [*border[1:].tolist(), len(cell)], strict=True):
                if cell[s] != now:
                    if not ready:
                        closed()
                    now, ready = cell[s], False
                    inner.clear()
                if side[s] == 2:
                    if not ready:
                        closed()
                        ready = True
                    compared(rows.cut(s, e))
                else:
                    inner.append(rows.cut(s, e))
            if sum(len(a) for a, _ in ends) > 100_000:
                yield found()
        if not ready:
            closed()
        if ends:
            yield found()

    sets = spread(full_sets(bodies, wanted, words), "cell").sortWithinPartitions("cell", "side")
    found_links = materialise(sets.mapInArrow(run, "a bigint, b bigint"), "links")
    discard(wanted)
    return found_links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, k: int = K, need: int = NEED) -> DataFrame:
    """(id, n_shingles, component) of each document row.

    Links documents whose sets have 100 * intersection >= percent * union; component is the
    smallest id that links reach. Words are runs of other than ASCII white space, A-Z
    lower-cased; a text of fewer than `words` words is one shingle; null and wordless texts
    have empty sets and link with nothing. Equal sets are linked. Rows that repeat an id
    are documents of their own that share it. Other columns are ignored.
    """
    bodies = text_bytes(docs, id_col, text_col)
    sig = materialise(signatures(bodies, words, k), "signatures")
    sets = sig.filter("digest is not null").select("id", "digest")
    classes = materialise(sets.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    rows = sets.groupBy("id", "digest").agg(F.count("*").alias("c"))
    copies = materialise(rows.join(classes, "digest").filter("id <> rep or c > 1").select("id", "digest", "c", "rep"), "copies")
    gone = copies.filter("id <> rep").select("id", "digest")
    reps = sig.filter("digest is not null").join(F.broadcast(gone) if few(copies) else gone, ["id", "digest"], "left_anti")
    if not copies.filter("c > 1").isEmpty():
        reps = reps.dropDuplicates(["id", "digest"])

    own = materialise(listed_values(reps, k, need, percent), "listed")
    postings = own.select(F.explode("listed").alias("value"), "id", "n")
    heads = postings.groupBy("value").agg(F.count("*").alias("c"), F.min(F.struct("id", "n")).alias("head")).filter("c > 1")
    lists = materialise(postings.join(heads, "value").select("value", "id", "n", F.col("head.id").alias("first"), F.col("head.n").alias("first_n")), "lists")
    members = materialise(lists.select("id").distinct(), "members")
    kept = own.join(F.broadcast(members) if few(members) else members, "id", "left_semi").select("id", "listed")
    coded = materialise(kept.join(reps.select("id", "digest", _codes("sketch").alias("codes")), "id"), "codes")
    digests = coded.select("id", "digest")

    pairs = materialise(star(lists, coded, k, need, percent), "star")
    found = links(bodies, star_cells(pairs), digests, words, percent)
    part = connected_components(members, found)

    members_of = materialise(still_open(lists, part), "open")
    cells = list_cells(members_of, F.lit(1), CELL_ROWS).drop("largest").join(coded.select("id", "codes", "listed"), "id")
    likely = materialise(likely_members(cells, k, need, percent), "likely")
    left = members_of.join(likely.distinct(), ["value", "id"])
    more = links(bodies, list_cells(left, F.col("n"), CELL_SHINGLES).select("id", "component", "cell", "side"), digests, words, percent)
    # a link between two documents joins their components
    final = connected_components(members, found.unionByName(more))
    of_class = classes.select("digest", F.col("rep").alias("id")).join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    out = sig.select("id", "n", "digest").join(of_class, "digest", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))
    discard(own, lists, pairs, members_of, likely, coded, found, more)
    return out


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group of near-duplicates, all columns kept: that of the smallest id.

    Rows that repeat both id and text are one document; rows without an id all stay.
    """
    text_col = options.get("text_col", "text")
    found = materialise(near_duplicates(docs, id_col=id_col, **options), "components")
    left = without_ids(docs, found.filter("component <> id").select("id"), id_col)
    again = materialise(found.filter("id is not null").groupBy("id").agg(F.count("*").alias("c")).filter("c > 1").select("id"), "repeated")
    if again.isEmpty():
        return left
    # only rows whose id is repeated have to meet
    repeated = left.join((F.broadcast(again) if few(again) else again).withColumnRenamed("id", "__again"), F.col(id_col) == F.col("__again"), "left_semi")
    once = repeated.withColumn("__text", F.xxhash64(text_col)).dropDuplicates([id_col, "__text"]).select(*docs.columns)
    return without_ids(left, again, id_col).unionByName(once)
