"""Exact Jaccard self-join of shingle sets by pivots, Voronoi regions and triangle-inequality windows (operator 6).

The Jaccard distance is a metric on sets. Documents with equal sets are one class. The first pivots are one-shingle sets:
the distance of a set to such a pivot is below 1 only if it holds the shingle, so a class lies in the regions of the
shingles it holds, and is replicated into the first few of them, in a fixed order, as many as sets within the threshold
may differ by. (Documents cannot be the first pivots: unrelated documents are all at distance 1 from each other, so every
window would hold everything.) In the order, shingles that many classes have come last.

Regions with many classes hold texts that are alike, where distances tell something, and are divided recursively: some
members become document pivots, the distances of all members to them are measured, and members within the threshold are
linked to their pivot. Members that these links have joined need not meet; members of different pivots still must. Each
belongs to the Voronoi cell of its nearest pivot. Others are replicated into a cell if the triangle inequality lets them
link with one of its members. Cells are divided again until they are small; pivots, which have met all others, leave. Each level takes more pivots than the last one, so the recursion ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_map, freed, ragged, small_batches, scratch, stored, text_slices
from tidemark.llm.components import components
from tidemark.llm.words import WordRows

#: Words of a shingle; sets link if NUM * |union| <= DEN * |intersection|.
WIDTH, NUM, DEN = 4, 85, 100
#: Shingles that more classes have come last in the order, by a table of 2^BITS bits, as large at any size of the input.
OFTEN, BITS = 32, 26
#: A region of more classes is divided.
CROWDED = 160
#: A class keeps so many times the pivots of its window, in case some are moved.
SPARE = 1.6
#: Ids and regions are broadcast up to this number, and joined by a shuffle beyond.
BROADCAST_IDS = 1_000_000
#: Shingles of the members whose distances a task measures together, and columns of an incidence matrix.
BLOCK, COLUMNS = 1 << 19, 2048
#: A region in which so few members have others to meet is settled at once: each of them is a pivot.
ALL = 2048
#: Document pivots of other regions: four times as many at each level, up to the second number.
PIVOTS = (64, 512)
#: Members further than this from all pivots make a cell of their own.
FAR = 0.5
#: A region is left whole if its cells would hold more than so many times its rows.
GROWS = 1.5
#: What distances as 32-bit numbers may be off by.
SLACK = 1e-6


class Rule(NamedTuple):
    """What makes two sets link."""

    width: int = WIDTH
    num: int = NUM
    den: int = DEN

    @property
    def radius(self) -> float:
        return 1 - self.num / self.den


_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread numbers over 64 bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sets of 64-bit hashes of shingles."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.words = WordRows("shingles", lambda ws: (np.fromiter(map(xxhash.xxh64_intdigest, ws), np.uint64, len(ws)),))

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """The sorted distinct shingles of each text."""
        lists = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]  # bytes: A-Z and ASCII spaces only
        rows = self.words.rows([w for ws in lists for w in ws])
        if not len(rows):
            return [np.zeros(0, np.uint64) for _ in texts]
        hashes, n = self.words.column(0)[rows], np.fromiter(map(len, lists), np.int64, len(lists))
        count = np.where(n >= self.width, n - self.width + 1, 0)
        at = ragged(np.cumsum(n) - n, count)
        flat = np.zeros(len(at), np.uint64)
        for k in range(self.width):
            flat = _mix(flat * _MULTIPLY + hashes[at + k])
        out, ends, starts = [], np.cumsum(count), np.cumsum(n) - n
        for k, (end, size) in enumerate(zip(ends.tolist(), count.tolist())):
            if size:
                out.append(np.unique(flat[end - size : end]))
            elif n[k]:  # fewer words: the whole sequence is one shingle
                h = np.uint64(n[k])
                with np.errstate(over="ignore"):
                    for w in hashes[starts[k] : starts[k] + n[k]]:
                        h = _mix(np.array([h * _MULTIPLY + w]))[0]
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


_SHINGLERS: dict[int, Shingler] = {}


def shingler(width: int) -> Shingler:
    return _SHINGLERS.setdefault(width, Shingler(width))


def window(n: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """So many pivots of a set of n must be looked at to find every set within the threshold: n less the least overlap, plus 1."""
    return n - -(-num * n // den) + 1


def window_of_smaller(n: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The same when the other set is at least as large."""
    return n - -(-2 * num * n // (num + den)) + 1


def overlap(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """The least intersection of linked sets of these sizes."""
    return -(-num * (a + b) // (num + den))


def describe(docs: DataFrame, id_col: str, text_col: str, rule: Rule) -> DataFrame:
    """(id, n, digest, first, parity): the size of a document's set, a digest of the set, its first pivots in order of
    hash, as many as its window has and some to spare, and the parities of its shingles by bit (see `parities`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shingler(rule.width)
        for batch, texts in text_slices(batches):
            sets = own.sets(texts)
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            kept = np.minimum(n, np.ceil(SPARE * window(n, rule.num, rule.den)).astype(np.int64) + 8)
            digest, first = [digest_of(x) for x in sets], [x[:k].tobytes() for x, k in zip(sets, kept.tolist())]
            parity = [parities(x).tobytes() for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *(pa.array(x, pa.binary()) for x in (digest, first, parity))], ["id", "n", "digest", "first", "parity"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), text_col), run, f"id {kind}, n long, digest binary, first binary, parity binary")


def parities(shingles: np.ndarray) -> np.ndarray:
    """For each value of the last bits of a hash, whether an odd number of shingles have it: two to four bits a shingle,
    64 at least, as 64-bit words. Parities of two sets differ in no more bits than there are shingles in only one of them."""
    size = max(64, 1 << int(2 * len(shingles) - 1).bit_length()) if len(shingles) else 64
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """A lower bound of the number of shingles that only one of two sets has, from their parities."""
    if len(x) < len(y):
        x, y = y, x
    while len(x) > len(y):  # parities by one bit less
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def digest_of(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _near(df: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """Join with a stored table that is broadcast if it has few rows."""
    return df.join(F.broadcast(small) if small.count() <= BROADCAST_IDS else small, key, how)


class Sets:
    """Where the sets of classes come from: reps has (digest, id, rep), a row for each class; rep is its number."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, rule: Rule, reps: DataFrame):
        self.docs, self.reps, self.rule = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), reps, rule

    def of(self, wanted: DataFrame) -> DataFrame:
        """(rep, set) of the classes with these numbers: their documents are read again."""
        names = stored(_near(self.reps, stored(wanted, "wanted"), "rep", "left_semi"), "names")
        picked = _near(self.docs, names, "id", "inner").select("rep", "digest", "text")
        rule = self.rule

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make = shingler(rule.width)
            for batch, texts in text_slices(batches, 2):
                sets = make.sets(texts)
                # Another row with the same id may have another text.
                same = pa.array([digest_of(x) == d for x, d in zip(sets, batch.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(same), pa.array([x.tobytes() for x in sets], pa.binary()).filter(same)], ["rep", "set"])

        return arrow_map(picked, run, "rep long, set binary")


def _in_bits(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    bit = x & np.uint64((1 << BITS) - 1)
    return (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def pivots(classes: DataFrame, rule: Rule, late: np.ndarray | None = None, shared: np.ndarray | None = None) -> DataFrame:
    """(pivot, rep, n, pos, prev, rare, entered): a row for each region of a class's window. prev is the pivot before,
    rare the number of pivots that aren't late, and entered tells that the pivot is in the window only because others
    were moved.

    late: bits of the shingles that stand at the end of the order. pos -1 marks a class whose kept pivots don't suffice.
    shared: bits of the pivots that more than one class may have; rows of others are left out.
    """
    context = classes.sparkSession.sparkContext
    sent = context.broadcast(late) if late is not None else None
    bits = context.broadcast(shared) if shared is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n = (batch.column(c).to_numpy() for c in (0, 1))
            lists = [np.frombuffer(f, np.uint64) for f in batch.column(2).to_pylist()]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            flat = np.concatenate(lists) if len(lists) else np.zeros(0, np.uint64)
            who, want = np.repeat(np.arange(len(rep)), size), window(n, rule.num, rule.den)
            place, rare = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), size
            if sent is not None and len(flat):
                is_late = _in_bits(sent.value, flat)
                rare = np.bincount(who[~is_late], minlength=len(rep))
                whole = size == n  # the whole set is at hand: pivots moved to the end follow
                keep = ~is_late | whole[who]
                order = np.lexsort((flat, is_late, who))
                order = order[keep[order]]
                flat, who, place = flat[order], who[order], place[order]
                size = np.bincount(who, minlength=len(rep))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            short = np.flatnonzero(size < want)
            prev = np.r_[np.uint64(0), flat[:-1]] if len(flat) else flat
            use = (pos < want[who]) & (size >= want)[who]
            if bits is not None:
                use &= _in_bits(bits.value, flat)
            own, zero = who[use], np.zeros(len(short), np.int64)
            pieces = [
                (flat[use].view(np.int64), rep[own], n[own], pos[use], np.where(pos[use] > 0, prev[use].view(np.int64), 0), rare[own], place[use] >= want[own]),
                (zero, rep[short], n[short], zero - 1, zero, zero, zero),
            ]
            *cols, entered = (np.concatenate(c) for c in zip(*pieces))
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), pa.array(entered.astype(bool))], ["pivot", "rep", "n", "pos", "prev", "rare", "entered"])

    return arrow_map(classes.select("rep", "n", "first"), run, "pivot long, rep long, n long, pos long, prev long, rare long, entered boolean")


def bits_of(rows: DataFrame) -> np.ndarray:
    """One bit for each value of the last BITS bits of the pivots, as 64-bit words: as many at any size of the input."""
    word, bit = F.expr(f"shiftright(pivot & {(1 << BITS) - 1}, 6)"), F.expr("shiftleft(1L, cast(pivot & 63 AS int))")
    words = rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole regions from rows sorted by region: columns as arrays."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        cols = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(cols[0]):
            continue
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last region may go on in the next batch
        if cut or held and held[0][0][0] != cols[0][0]:
            done = [*held, tuple(c[:cut] for c in cols)]
            yield tuple(np.concatenate(c) for c in zip(*done))
            held = []
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _allowed(n, pos, prev, home, dist, a, b, rule: Rule) -> np.ndarray:
    """Whether pairs (a, b) of rows of a region can link, and meet here first."""
    small, large = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
    fits = (rule.num * n[large] <= rule.den * n[small]) & (pos[small] < window_of_smaller(n[small], rule.num, rule.den))
    fits &= np.minimum(n[small] - pos[small], n[large] - pos[large]) >= overlap(n[small], n[large], rule.num, rule.den)
    fits &= (home[a] | home[b]) & (np.abs(dist[a] - dist[b]) <= rule.radius + SLACK)
    # Sets with the same pivot before this one have met in its region.
    return fits & ~((prev[a] == prev[b]) & (pos[a] > 0) & (pos[b] > 0))


def candidates(rows: DataFrame, rule: Rule) -> DataFrame:
    """(a, b) pairs that can link, of regions of at most CROWDED rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for region, rep, n, pos, prev, home, dist in _grouped(batches):
            first = np.flatnonzero(np.r_[True, region[1:] != region[:-1]])
            size = np.diff(np.r_[first, len(region)])
            found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for g in np.unique(size[size > 1]).tolist():
                begin = first[size == g]
                for at in range(0, len(begin), max(1, 200_000 // (g * g))):
                    some = begin[at : at + max(1, 200_000 // (g * g))]
                    a, b = np.triu_indices(g, 1)
                    a, b = (some[:, None] + a).ravel(), (some[:, None] + b).ravel()
                    ok = _allowed(n, pos, prev, home, dist, a, b, rule)
                    found_a.append(rep[a[ok]])
                    found_b.append(rep[b[ok]])
            a, b = np.concatenate(found_a), np.concatenate(found_b)
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    ordered = rows.select("region", "rep", "n", "pos", "prev", "home", "dist").repartition("region").sortWithinPartitions("region")
    return arrow_map(ordered, run, "a long, b long").distinct()


def _common(sets: list[np.ndarray], others: list[np.ndarray], same: np.ndarray) -> np.ndarray:
    """[set, other]: how many shingles they share, by products of incidence matrices. same: the place of each of the
    others among the sets, or -1; shingles that one text alone has need no column then."""
    n, m = (np.fromiter(map(len, z), np.int64, len(z)) for z in (sets, others))
    values, own, times = np.unique(np.concatenate(others), return_inverse=True, return_counts=True)
    of = np.repeat(np.arange(len(others)), m)
    flat, who = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    at = np.minimum(np.searchsorted(values, flat), len(values) - 1)
    known = values[at] == flat
    at, who = at[known], who[known]
    met = np.bincount(at, minlength=len(values))
    holder, pivot = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    holder[at], pivot[own] = who, of  # of the shingles that one member and one pivot have, these are the two
    use = (met > 0) & ~((met == 1) & (times == 1) & (same[pivot] == holder))
    column = np.cumsum(use) - 1
    at, who = column[at[use[at]]], who[use[at]]
    own, of = column[own[use[own]]], of[use[own]]
    by, by_other = np.argsort(at, kind="stable"), np.argsort(own, kind="stable")
    at, who, own, of = at[by], who[by], own[by_other], of[by_other]
    out = np.zeros((len(sets), len(others)), np.float32)
    for low in range(0, int(use.sum()), COLUMNS):
        a, b, c, d = np.searchsorted(at, low), np.searchsorted(at, low + COLUMNS), np.searchsorted(own, low), np.searchsorted(own, low + COLUMNS)
        y = np.zeros((COLUMNS, len(others)), np.float32)
        y[own[c:d] - low, of[c:d]] = 1
        for top in range(0, len(sets), COLUMNS):
            mine = (who[a:b] >= top) & (who[a:b] < top + COLUMNS)
            x = np.zeros((min(COLUMNS, len(sets) - top), COLUMNS), np.float32)
            x[who[a:b][mine] - top, at[a:b][mine] - low] = 1
            out[top : top + COLUMNS] += x @ y
    there = np.flatnonzero(same >= 0)
    out[same[there], there] = m[there]
    return out.astype(np.int32)


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what the links (a, b) join: of each member to the first of its component."""
    root = np.arange(size)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    own = np.flatnonzero(root != np.arange(size))
    return root[own], own


def measure(live: DataFrame, chosen: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """(plan, rep, near, d) and, in rows without a rep, links (a, b).

    live: (plan, rep, n), the members of regions with the same pivots; chosen: (plan, settled, k, rep), the pivots. d has
    the distances to all pivots, near the place of the nearest one; settled plans give links only. What leaves a task of links is a forest. A task measures members of at most about BLOCK
    shingles, so regions may have any size.
    """
    members = stored(live.select("plan", "rep", "n").distinct(), "members")
    salts = members.groupBy("plan").agg(F.ceil(F.sum("n") / BLOCK).alias("salts"))
    left = members.join(salts, "plan").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts")).join(sets, "rep").select("plan", "salt", "rep", "set")
    right = chosen.join(sets, "rep").join(salts, "plan").select("plan", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "settled", "k", F.col("rep").alias("pivot"), F.col("set").alias("shingles"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("plan", pa.int64()), ("rep", pa.int64()), ("near", pa.int32()), ("d", pa.list_(pa.float32())), ("a", pa.int64()), ("b", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        by_place = {k: (r, s) for k, r, s in zip(*(right[c].to_pylist() for c in ("k", "pivot", "shingles")))}
        ordered = [by_place[k] for k in sorted(by_place)]
        pivot, y = np.array([r for r, _ in ordered], np.int64), [np.frombuffer(s, np.uint64) for _, s in ordered]
        by_rep = dict(zip(left["rep"].to_pylist(), left["set"].to_pylist()))
        rep, x = np.fromiter(by_rep, np.int64, len(by_rep)), [np.frombuffer(s, np.uint64) for s in by_rep.values()]
        where = {r: i for i, r in enumerate(by_rep)}
        common = _common(x, y, np.array([where.get(r, -1) for r in pivot.tolist()], np.int64))
        union = np.array([len(s) for s in x], np.int32)[:, None] + np.array([len(s) for s in y], np.int32)[None, :] - common
        link = rule.den * common >= rule.num * union
        who, k = np.nonzero(link & (rep[:, None] != pivot[None, :]))
        both = np.r_[pivot, rep]
        a, b = _forest(k, len(pivot) + who, len(both))
        plan, no = left["plan"][0].as_py(), lambda t, k: pa.nulls(k, t)
        links = pa.Table.from_arrays([pa.array(np.full(len(a), plan)), *(no(f.type, len(a)) for f in list(schema)[1:4]), pa.array(both[a]), pa.array(both[b])], schema=schema)
        freed()
        if right["settled"][0].as_py():
            return links
        d = (1 - common / union).astype(np.float32)
        near = d.argmin(axis=1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rep) + 1) * len(pivot), pa.int32()), pa.array(d.ravel()))
        rows = [*map(pa.array, (np.full(len(rep), plan), rep, near.astype(np.int32))), lists, no(pa.int64(), len(rep)), no(pa.int64(), len(rep))]
        return pa.concat_tables([pa.Table.from_arrays(rows, schema=schema), links])

    out = left.groupBy("plan", "salt").cogroup(right.groupBy("plan", "salt")).applyInArrow(meet, "plan long, rep long, near int, d array<float>, a long, b long")
    return stored(out, "distances")


def plan(live: DataFrame, sizes: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(plan, how, region), each region that is divided once, and (plan, settled, k, rep), the pivots of a plan.

    Regions with the same pivots share their distances. Of those that are settled, regions of the same texts are also put
    together, as long as they have no more than ALL pivots: each member is then sent and measured once, not once a region.
    What more is compared so can only find more links.
    """
    # The members most like what all share: those with the fewest rare shingles. All regions of near copies then have the same.
    order = Window.partitionBy("region").orderBy("rare", "rep")
    homes = _near(live.filter("home"), sizes.filter("how = 2").select("region", "how"), "region", "inner")
    top = homes.select("region", "how", "rep", F.row_number().over(order).alias("k")).filter(F.col("k") <= most)
    lists = top.groupBy("region", "how").agg(F.sort_array(F.collect_list(F.struct("k", "rep")))["rep"].alias("list"))
    plans = stored(lists.groupBy("how", "list").agg(F.min("region").alias("plan"), F.collect_list("region").alias("regions")), "plans")
    named = plans.select("plan", "how", F.explode("regions").alias("region"))
    chosen = plans.select("plan", F.lit(False).alias("settled"), F.posexplode("list").alias("k", "rep"))
    # Settled regions by two least hashes of their members, which regions share the sooner the more members they share, and then by sums of pivots.
    settled = stored(sizes.filter("how = 1").select("region", "how", "homes"), "settled")
    heads = _near(live, settled, "region", "left_semi").groupBy("region").agg(F.min(F.xxhash64("rep")).alias("x"), F.min(F.xxhash64("rep", F.lit(1))).alias("y"))
    before = Window.partitionBy("x", "y", "alone").orderBy("homes", "region").rowsBetween(Window.unboundedPreceding, -1)
    alone = F.when(F.col("homes") > ALL // 2, F.col("region")).alias("alone")
    bins = settled.join(heads, "region").select("*", alone).withColumn("bin", F.floor(F.coalesce(F.sum("homes").over(before), F.lit(0)) / (ALL // 2)))
    by_bin = bins.select("region", "how", F.min("region").over(Window.partitionBy("x", "y", "alone", "bin")).alias("plan"))
    by_bin = stored(by_bin.select("plan", "how", "region"), "plans")
    pivot = _near(live.filter("home"), by_bin.select("region", "plan"), "region", "inner").select("plan", "rep").distinct()
    numbered = pivot.select("plan", F.lit(True).alias("settled"), (F.row_number().over(Window.partitionBy("plan").orderBy("rep")) - 1).alias("k"), "rep")  # at most ALL each
    return named.unionByName(by_bin), stored(chosen.unionByName(numbered), "pivots")


def divide(crowd: DataFrame, sets: DataFrame, rule: Rule) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links (a, b) of members and document pivots, and rows of the small regions that are left.

    crowd: (region, rep, n, pos, prev, rare) of crowded regions. With the links, and the links of pairs that meet in the
    small regions, the components are those of all links. A row is at home in its region if it still has others to meet
    there; the rest are there to be met. Pairs that the links found so far have joined need not meet. So the rows of a
    region's largest joined group may all be away from home if all others, also those that came to be met, then are at
    home: only such a change of places loses no pair.
    """
    # Members with the same pivot before this one have met in its region: the most of those need not meet here.
    before = crowd.filter("pos > 0").groupBy("region", "prev").count().groupBy("region").agg(F.max(F.struct("count", "prev"))["prev"].alias("most"))
    home = F.coalesce((F.col("pos") == 0) | (F.col("prev") != F.col("most")), F.lit(True))
    live = stored(crowd.join(before, "region", "left").select(*crowd.columns, home.alias("home"), F.lit(0.0).cast("float").alias("dist")), "live")
    links, small, level = [], [], 0
    joined = crowd.sparkSession.createDataFrame([], "a long, b long")
    while True:
        sizes = live.groupBy("region").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes")).filter("homes > 0")
        sizes = stored(sizes.select("region", "homes", F.when(F.col("rows") <= CROWDED, 0).when(F.col("homes") <= ALL, 1).otherwise(2).alias("how")), "sizes")
        kinds = {r[0] for r in sizes.select("how").distinct().collect()}
        small.append(_near(live, sizes.filter("how = 0").select("region"), "region", "left_semi"))
        if not kinds & {1, 2}:
            return links, small
        named, chosen = plan(live, sizes, min(PIVOTS[1], PIVOTS[0] * 4**level))
        live = stored(live.join(named, "region"), "live")
        found = measure(live, chosen, sets, rule)
        links.append(found.filter("rep is null").select("a", "b"))
        if 2 not in kinds:
            return links, small
        joined = stored(components(joined.unionByName(links[-1])), "joined")
        at = live.filter("how = 2").join(found.filter("rep is not null").select("plan", "rep", "near", "d"), ["plan", "rep"])
        at = at.withColumn("least", F.element_at("d", F.col("near") + 1)).filter("least > 0")  # pivots have met all
        at = stored(_near(at, joined.select(F.col("node").alias("rep"), F.col("root").alias("group")), "rep", "left"), "measured")
        groups = at.groupBy("region", "group").agg(F.count("*").alias("rows"), F.count_if("home").alias("homes"))
        groups = groups.groupBy("region").agg(F.sum("rows").alias("rows"), F.sum("homes").alias("homes"), F.max(F.when(F.col("group").isNotNull(), F.struct("rows", "group"))).alias("most"))
        groups = groups.filter("most.rows > rows - homes").select("region", F.col("most.group").alias("most"))  # fewer rows are at home then
        at = at.join(groups, "region", "left").withColumn("home", F.when(F.col("most").isNull(), F.col("home")).otherwise(~F.col("group").eqNullSafe(F.col("most"))))
        at = stored(at.drop("group", "most").withColumn("cell", F.when(F.col("least") > FAR, -1).otherwise(F.col("near"))), "measured")
        joined = joined.select(F.col("node").alias("a"), F.col("root").alias("b"))
        cells = at.filter("home").groupBy("region", "cell").agg(F.min("least").alias("low"), F.max("least").alias("high"))
        cells = cells.groupBy("region").agg(F.collect_list(F.struct("cell", "low", "high")).alias("cells"))  # one a pivot at most
        reach, to = rule.radius + SLACK, lambda c: F.element_at("d", c["cell"] + 1)

        def inside(c):
            """Can a member link with one of the cell: its own cell, or by the triangle inequality."""
            ring = (to(c) >= c["low"] - reach) & (to(c) <= c["high"] + reach) & (to(c) <= F.col("least") + 2 * reach)
            return F.when(c["cell"] < 0, F.col("least") >= c["low"] - reach).otherwise(ring) | (F.col("home") & (c["cell"] == F.col("cell")))

        into = stored(at.join(cells, "region").withColumn("into", F.filter("cells", inside)["cell"]).drop("cells"), "into")
        grown = into.groupBy("region").agg((F.sum(F.size("into")) > GROWS * F.count("*")).alias("whole"))
        parts = into.join(grown, "region").select("rep", "n", "pos", "prev", "rare", "region", "home", "cell", "d", F.explode(F.when(F.col("whole"), F.array(F.lit(-2))).otherwise(F.col("into"))).alias("to"))
        own = F.col("home") & ((F.col("to") == -2) | (F.col("to") == F.col("cell")))
        dist = F.element_at("d", F.greatest("to", F.lit(0)) + 1)  # members of one region all have the same pivot here
        live = stored(parts.select(F.xxhash64("region", F.lit(level), "to").alias("region"), "rep", "n", "pos", "prev", "rare", own.alias("home"), dist.alias("dist")), "live")
        level += 1


def near(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that can still link by their parities: linked sets of their sizes have no more shingles apart than so many."""
    pairs = stored(pairs, "candidates")
    ids = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct()
    own = _near(classes.select("rep", "n", "parity"), stored(ids, "ids"), "rep", "left_semi")
    left = pairs.join(own.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("x")), "a")
    both = left.join(own.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in (2, 3))
            most = n_a + n_b - 2 * overlap(n_a, n_b, rule.num, rule.den)
            least = [apart(*(np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))) for x, y in zip(batch.column(4), batch.column(5))]
            keep = pa.array(np.array(least, np.int64) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["a", "b"])

    return stored(arrow_map(both.select("a", "b", "n_a", "n_b", "x", "y"), compare, "a long, b long"), "pairs")


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    joint = np.concatenate([x, y])
    joint.sort(kind="stable")
    return int((joint[1:] == joint[:-1]).sum())


def verify(pairs: DataFrame, sets: Sets) -> DataFrame:
    """The pairs (a, b) whose sets link: the documents are read again, and each pair's sets are compared."""
    rule = sets.rule
    own = sets.of(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct())
    left = pairs.join(own.select(F.col("rep").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(own.select(F.col("rep").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                common = _shared(x, y)
                ok.append(rule.den * common >= rule.num * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return stored(arrow_map(both, compare, "a long, b long"), "links")


def links_of(classes: DataFrame, sets: Sets) -> DataFrame:
    """Links (a, b) between classes, enough of them that the components are those of all links."""
    rule = sets.rule
    counts = stored(pivots(classes, rule).filter("pos >= 0").groupBy("pivot").count().filter("count > 1"), "counts")
    late, shared = bits_of(counts.filter(F.col("count") > OFTEN)), bits_of(counts)
    if late.any():
        shared |= bits_of(pivots(classes, rule, late).filter("entered"))
    rows = stored(pivots(classes, rule, late, shared).drop("entered"), "windows")
    short = rows.filter("pos = -1").select("rep")
    rows = rows.filter("pos >= 0")
    if not short.isEmpty():  # these need their whole sets
        full = stored(sets.of(short).select("rep", (F.length("set") / 8).cast("long").alias("n"), F.col("set").alias("first")).dropDuplicates(["rep"]), "whole")
        more = bits_of(pivots(full, rule, late))
        rows = stored(pivots(classes, rule, late, shared | more).filter("pos >= 0").unionByName(pivots(full, rule, late)).drop("entered"), "windows")
    rows = rows.withColumnRenamed("pivot", "region")
    full = stored(rows.groupBy("region").count().filter(F.col("count") > CROWDED).select("region"), "crowded")
    small = _near(rows, full, "region", "left_anti").select("*", F.lit(True).alias("home"), F.lit(0.0).cast("float").alias("dist"))
    links = []
    if not full.isEmpty():
        crowd = stored(_near(rows, full, "region", "left_semi"), "crowd")
        links, parts = divide(crowd, stored(sets.of(crowd.select("rep").distinct()), "sets"), rule)
        for p in parts:
            small = small.unionByName(p.select(small.columns))
    out = verify(near(candidates(small, rule), classes, rule), sets)
    for more in links:
        out = out.unionByName(more)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id) of every document: documents link if num * |union| <= den * |intersection|.

    Documents without words (null or blank texts) have an empty set and link with none, also not with each other: each
    is its own component. Fewer words than a shingle has make one shingle. Equal sets link, whatever their number. Ids
    may be of any type that can be ordered. Rows with a null id are never the smallest id of a component, but get that of
    the documents that they equal; null if there are none. Rows that share an id are told apart by their texts. Texts are
    read whole, however long; columns besides the two are not read. Shingles are compared as 64-bit hashes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rule = Rule(width, num, den)
    with scratch(spark) as left:
        with scratch(spark) as keep:
            described = stored(describe(docs, id_col, text_col, rule).withColumn("row", F.monotonically_increasing_id()), "described")
            least = described.filter("n > 0 and id is not null").groupBy("digest").agg(F.min(F.struct("id", "row")).alias("m"))
            reps = stored(least.select("digest", "m.id", F.col("m.row").alias("rep")), "classes")
            classes = _near(described.select(F.col("row").alias("rep"), "n", "first", "parity"), stored(reps.select("rep"), "numbers"), "rep", "left_semi")
            classes, plain = stored(classes, "first-pivots"), stored(described.select("id", "n", "digest"), "digests")
            keep += [reps, classes, plain]
        roots = stored(components(links_of(classes, Sets(docs, id_col, text_col, rule, reps))).withColumnRenamed("node", "rep"), "roots")
        named = stored(reps.join(roots, "rep"), "linked")
        first = stored(named.groupBy("root").agg(F.min("id").alias("component")), "components")
        linked = stored(_near(named, first, "root", "inner").select("rep", "component"), "linked")
        left += [reps, plain, linked]
    by_class = reps.join(linked, "rep", "left").select("digest", F.coalesce("component", "id").alias("component"))
    full = plain.filter("n > 0").join(by_class, "digest", "left").select("id", "n", "component")
    none = plain.filter("n = 0").select("id", "n", F.col("id").alias("component"))
    return full.unionByName(none).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """One document of each component, with all its columns: that of the smallest id, null ids last, of equal ids any.

    Each row is judged by its own text: rows may share an id or have none (the documents are then written once more,
    with a number each). Documents without words all stay.
    """
    if docs.filter(F.col(id_col).isNull()).isEmpty() and docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        with scratch(docs.sparkSession) as keep:  # ids name the rows: the documents need not be written with a number each
            others = stored(join(docs, id_col, text_col, width, num, den).filter(F.col(id_col) != F.col("component_id")).select(id_col), "others")
            keep.append(others)
        return _near(docs, others, id_col, "left_anti").select(docs.columns)
    row = "_row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    with scratch(docs.sparkSession) as keep:
        found = join(numbered, row, text_col, width, num, den).select(F.col(row), "component_id")
        # The join has read no id: the least one of each component comes from the rows.
        named = found.join(numbered.select(row, F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(row)).alias("_by")), row)
        first = stored(named.groupBy("component_id").agg(F.min("_by").alias("_by")).select(F.col(f"_by.{row}").alias(row)), "first")
        keep.append(first)
    return _near(numbered, first, row, "left_semi").select(docs.columns)
