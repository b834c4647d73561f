"""SimHash near-deduplication, searched by the generalised pigeonhole principle.

documents -> fingerprint of 64 bits -> equal fingerprints fold into a class ->
bits that go together are grouped into parts -> each class deals its thresholds
over the parts -> probes meet indexed parts -> verification -> components.

Two fingerprints within ``RADIUS`` bits agree, in some part i, within t_i bits,
for any whole t_i >= -1 that sum to RADIUS - parts + 1 (-1: the part is not
looked at). Each class picks its own t_i: a dynamic program over the parts takes
the cheapest sum of the keys to probe and the classes expected there. A value
that very many fingerprints share is thus passed over for others, and a wider
look at a selective part pays for it. Whatever is picked, no link is lost, so
estimates steer cost only. The number of parts (``PARTS``) is the one whose sum
of costs over all classes is the least: few keys on small tables, wider parts
with more probes on large ones.

Classes expected within d bits of a value come from histograms of half parts
over all classes (at most 2**12 counts each), joined as if the halves were
independent. All that the driver and the tasks hold is of fixed size: the 64 x
64 counts of bits set together, and these histograms.

Dense groups: before the search every value of a part that several classes share
names one of them as pivot, and members within RADIUS of it are linked, which is
linear in the bucket. The search then keeps links between different components
only. An indexed value of more than ``HOT`` classes is cut into blocks, each
probe going to every block, so no task holds a whole hot value.

Edge cases: a null, empty or wordless text has fingerprint zero and links like
any other; fewer than three words are one shingle; texts of any length are
hashed whole, some shingles at a time; rows that repeat a doc_id each give a
row; a row without an id never names a component but carries links (component_id
is null if no row of the component has an id); an empty table gives no rows;
further columns of the input are ignored.
"""

from __future__ import annotations

from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .near_dedup import components
from .storage import Scratch, bounded, tidy

BITS, RADIUS, SEED = 64, 3, 42
#: Numbers of parts to choose from.
PARTS = (2, 3, 4)
#: Cost of a key that is probed (written, shuffled, sorted) and of a class met there.
PROBE_COST, MEET_COST = 1.0, 0.1
#: Classes under one indexed value that one block holds.
HOT = 4096
#: Shingles hashed at a time.
CHUNK = 1 << 16
U64 = np.uint64


def fingerprint(text: str | bytes | None, k: int = 3) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 values have it."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # of bytes: A-Z, and ASCII space only
    if not words:
        return 0
    if len(words) < k:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    grams = map(b" ".join, zip(*(islice(words, i, None) for i in range(k)), strict=False))
    hashes = map(xxhash.xxh64_intdigest, grams, repeat(SEED))
    total, ones = len(words) - k + 1, np.zeros(BITS, np.int64)
    for _ in range(0, total, CHUNK):
        some = np.fromiter(islice(hashes, CHUNK), ">u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _signer(k: int):
    def sign(batches):
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            prints = np.array([fingerprint(t.as_py(), k) for t in texts], U64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return sign


def _prints(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("fp").to_numpy(zero_copy_only=False).view(U64)


def _bits(prints: np.ndarray) -> np.ndarray:
    """(rows, 64) zeros and ones; column 0 is the highest bit."""
    return np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits in parts of like size, each bit with those it correlates with most.

    ``together`` counts, for each two bits, the fingerprints with both set."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    bond = np.abs((together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(bond, 0)
    first = [int(bond.sum(1).argmax())]
    while len(first) < parts:  # the others begin with the bits least bound to those before
        rest = bond[:, first].sum(1)
        rest[first] = np.inf
        first.append(int(rest.argmin()))
    groups, free = [[f] for f in first], sorted(set(range(BITS)) - set(first))
    most = [BITS // parts + (i < BITS % parts) for i in range(parts)]
    pull = np.stack([bond[:, f] for f in first])
    while free:
        open_ = [i for i in range(parts) if len(groups[i]) < most[i]]
        mean = np.array([pull[i, free] / len(groups[i]) for i in open_])
        at = np.unravel_index(int(mean.argmax()), mean.shape)
        i, bit = open_[at[0]], free.pop(int(at[1]))
        groups[i].append(bit)
        pull[i] += bond[:, bit]
    return [sorted(g) for g in groups]


def part_values(bits: np.ndarray, group: list[int]) -> np.ndarray:
    """The bits of one part as a number, the first of the group highest."""
    out = np.zeros(len(bits), U64)
    for b in group:
        out = (out << U64(1)) | bits[:, b].astype(U64)
    return out


def halves(group: list[int]) -> list[list[int]]:
    """A part in pieces of at most 12 bits."""
    count = -(-len(group) // 12)
    return [group[i * len(group) // count : (i + 1) * len(group) // count] for i in range(count)]


def near_counts(histogram: np.ndarray) -> np.ndarray:
    """(values, RADIUS + 1): how much of the histogram lies at just d bits of each value."""
    width, values = int(len(histogram)).bit_length() - 1, np.arange(len(histogram))
    out = np.zeros((len(histogram), RADIUS + 1))
    for d in range(min(RADIUS, width) + 1):
        for flip in combinations(range(width), d):
            out[:, d] += histogram[values ^ sum(1 << b for b in flip)]
    return out


class Plan:
    """Parts, and the classes expected near each value of their halves."""

    def __init__(self, groups: list[list[int]], histograms: list[list[np.ndarray]], n: int):
        self.groups, self.n = groups, n
        self.near = [[near_counts(h) / max(n, 1) for h in part] for part in histograms]
        self.keys = [[sum(len(list(combinations(range(len(g)), d))) for d in range(t + 1)) for t in range(RADIUS + 1)] for g in groups]

    def costs(self, bits: np.ndarray) -> list[np.ndarray]:
        """For each part (rows, RADIUS + 2): the cost of a threshold of -1, 0 .. RADIUS."""
        out = []
        for group, near, keys in zip(self.groups, self.near, self.keys, strict=True):
            share = np.zeros((len(bits), RADIUS + 1))
            share[:, 0] = 1
            for piece, table in zip(halves(group), near, strict=True):
                own = table[part_values(bits, piece).astype(np.int64)]
                share = np.stack([sum(share[:, j] * own[:, d - j] for j in range(d + 1)) for d in range(RADIUS + 1)], axis=1)
            meet = np.cumsum(share, axis=1) * self.n
            out.append(np.concatenate([np.zeros((len(bits), 1)), PROBE_COST * np.array(keys) + MEET_COST * meet], axis=1))
        return out

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) thresholds of least cost that sum to RADIUS - parts + 1, and the cost.

        best[s] after i parts: least cost with t_1 + .. + t_i + i = s."""
        whole = RADIUS + 1
        best = np.full((len(bits), whole + 1), np.inf)
        best[:, 0] = 0
        taken = []
        for cost in self.costs(bits):
            options = np.full((len(bits), whole + 1, whole + 1), np.inf)
            for s in range(whole + 1):
                for t in range(s + 1):  # t stands for a threshold of t - 1
                    options[:, s, t] = best[:, s - t] + cost[:, t]
            taken.append(options.argmin(2))
            best = options.min(2)
        rows, at = np.arange(len(bits)), np.full(len(bits), whole)
        out = np.zeros((len(bits), len(taken)), np.int64)
        for i in reversed(range(len(taken))):
            out[:, i] = taken[i][rows, at] - 1
            at = at - taken[i][rows, at]
        return out, best[:, whole]

    def probes(self, prints: np.ndarray):
        """For each part (its number, places in prints, keys): every value within the thresholds."""
        bits = _bits(prints)
        limits, _ = self.thresholds(bits)
        for i, group in enumerate(self.groups):
            values, width = part_values(bits, group), len(group)
            for d in range(RADIUS + 1):
                own = np.flatnonzero(limits[:, i] >= d)
                flips = np.array([sum(1 << b for b in flip) for flip in combinations(range(width), d)], U64)
                step = max(1, (1 << 20) // max(len(flips), 1))
                for lo in range(0, len(own) if len(flips) else 0, step):
                    some = own[lo : lo + step]
                    yield i, np.repeat(some, len(flips)), (values[some][:, None] ^ flips[None]).reshape(-1)


def _together(batches):
    n, counts = 0, np.zeros((BITS, BITS), np.int64)
    for b in batches:
        bits = _bits(_prints(b)).astype(np.float32)
        n += len(bits)
        counts += (bits.T @ bits).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([counts.reshape(-1).tolist()], pa.list_(pa.int64()))], names=["n", "counts"])


def _histogrammer(groups: dict[int, list[list[int]]]):
    """Counts of the values of half parts, added up within the task."""

    def run(batches):
        found = {(m, i, j): np.zeros(1 << len(p), np.int64) for m, parts in groups.items() for i, g in enumerate(parts) for j, p in enumerate(halves(g))}
        for b in batches:
            bits = _bits(_prints(b))
            for m, i, j in found:
                found[m, i, j] += np.bincount(part_values(bits, halves(groups[m][i])[j]).astype(np.int64), minlength=len(found[m, i, j]))
        for (m, i, j), h in found.items():
            at = np.flatnonzero(h)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), x, np.int32)) for x in (m, i, j)] + [pa.array(at), pa.array(h[at])], names=["m", "i", "j", "value", "c"])

    return run


def _coster(plans: dict[int, Plan]):
    def run(batches):
        total = dict.fromkeys(plans, 0.0)
        for b in batches:
            bits = _bits(_prints(b))
            for m, p in plans.items():
                total[m] += float(p.thresholds(bits)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()))], names=["m", "cost"])

    return run


def _keyer(plan: Plan, probe: bool):
    """Rows (part, key, fp): what is probed, or the index."""

    def run(batches):
        for b in batches:
            prints, bits = _prints(b), None
            if probe:
                found = plan.probes(prints)
            else:
                bits = _bits(prints)
                found = ((i, np.arange(len(prints)), part_values(bits, g)) for i, g in enumerate(plan.groups))
            for i, at, keys in found:
                arrays = [pa.array(np.full(len(at), i, np.int32)), pa.array(keys.view(np.int64)), pa.array(prints[at].view(np.int64))]
                yield from pa.Table.from_arrays(arrays, names=["part", "key", "fp"]).to_batches(1 << 16)

    return run


def make_plan(classes: DataFrame, parts: tuple[int, ...] = PARTS) -> Plan:
    """The parts and thresholds' costs for these fingerprints(fp)."""
    rows = classes.select("fp").mapInArrow(tidy(_together), "n long, counts array<long>")
    cells = rows.select("n", F.posexplode("counts").alias("cell", "c")).groupBy("cell").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()  # 4096 numbers
    n, together = 0, np.zeros(BITS * BITS, np.int64)
    for r in cells:
        together[r.cell], n = r.c, r.n
    groups = {m: group_bits(together.reshape(BITS, BITS), n, m) for m in parts}
    counts = classes.select("fp").mapInArrow(tidy(_histogrammer(groups)), "m int, i int, j int, value long, c long").groupBy("m", "i", "j", "value").agg(F.sum("c").alias("c")).collect()  # at most 2**12 for each half part
    histograms = {m: [[np.zeros(1 << len(p), np.int64) for p in halves(g)] for g in parts_] for m, parts_ in groups.items()}
    for r in counts:
        histograms[r.m][r.i][r.j][r.value] = r.c
    plans = {m: Plan(groups[m], histograms[m], n) for m in parts}
    if len(plans) == 1:
        return plans[parts[0]]
    cost = {r.m: r.cost for r in classes.select("fp").mapInArrow(tidy(_coster(plans)), "m int, cost double").groupBy("m").agg(F.sum("cost").alias("cost")).collect()}
    return plans[min(parts, key=lambda m: (cost.get(m, 0), m))]


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 3, parts: tuple[int, ...] = PARTS) -> DataFrame:
    """doc_id, fp, component_id for each row of docs(doc_id, text); fp is the
    fingerprint as a signed long. Fingerprints within RADIUS bits are linked."""
    bounded(spark)
    scratch = Scratch(spark, "simhash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(tidy(_signer(k)), "doc_id long, fp long"), "signed")
    classes = scratch.keep(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    plan = make_plan(classes, parts)
    index = scratch.keep(classes.select("fp").mapInArrow(tidy(_keyer(plan, False)), "part int, key long, fp long"), "index")

    # pivots: linear in the bucket
    pivots = index.groupBy("part", "key").agg(F.min(F.struct(F.xxhash64("fp", "part").alias("o"), F.col("fp").alias("p"))).alias("x"), F.count("*").alias("c")).where("c > 1")
    pivots = scratch.keep(pivots.select("part", "key", "x.p", "c"), "pivots")
    near = f"bit_count(fp ^ p) <= {RADIUS}"
    stars = index.join(pivots, ["part", "key"]).where(f"fp <> p AND {near}")
    first = scratch.keep(stars.select(F.greatest("fp", "p").alias("a"), F.least("fp", "p").alias("b")).distinct(), "stars")
    comps = scratch.keep(components(first, scratch, "comps-first"), "comp-first")
    known = scratch.keep(classes.select("fp").join(comps, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "known")

    # the search: every class probes, within its own thresholds
    probes = known.mapInArrow(tidy(_with_comp(_keyer(plan, True))), "part int, key long, fp long, comp long")
    hot = pivots.where(f"c > {HOT}").select("part", "key", F.ceil(F.col("c") / HOT).cast("int").alias("blocks"))
    entries = index.join(known, "fp").join(hot, ["part", "key"], "left")
    entries = entries.select("part", "key", F.coalesce(F.expr("pmod(xxhash64(fp, 5), blocks)"), F.lit(0)).cast("int").alias("block"), F.col("fp").alias("p"), F.col("comp").alias("pcomp"))
    probes = probes.join(hot, ["part", "key"], "left").select("part", "key", "fp", "comp", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    met = probes.join(entries, (probes.part == entries.part) & (probes.key == entries.key) & (probes.block == entries.block) & (F.col("comp") != F.col("pcomp")) & F.expr(near))
    links = scratch.keep(met.select(F.greatest("fp", "p").alias("a"), F.least("fp", "p").alias("b")).mapInArrow(tidy(_once), "a long, b long"), "links")
    comps = scratch.keep(components(first.union(links), scratch, "comps"), "comp")

    whole = classes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    least = whole.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = scratch.keep(whole.join(least, "comp").select("fp", "component_id"), "named")
    for done in ("classes", "index", "pivots", "stars", "comp-first", "known", "links", "comp"):
        scratch.drop(done)
    return signed.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _with_comp(keys):
    """Rows (fp, comp) -> the rows of ``keys`` with comp."""

    def run(batches):
        for b in batches:
            prints = b.column("fp").to_numpy(zero_copy_only=False)
            order = np.argsort(prints, kind="stable")
            comp = b.column("comp").to_numpy(zero_copy_only=False)
            for out in keys(iter([b])):
                at = order[np.searchsorted(prints, out.column("fp").to_numpy(zero_copy_only=False), sorter=order)]
                yield out.append_column("comp", pa.array(comp[at]))

    return run


def _once(batches):
    """Repeats within a batch go."""
    for b in batches:
        yield from pa.Table.from_batches([b]).group_by(["a", "b"]).aggregate([]).select(["a", "b"]).to_batches()


def hexadecimal(fp):
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
