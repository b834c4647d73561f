"""MinHash near-deduplication with SuperMinHash signatures.

documents -> distinct word shingles -> SuperMinHash signature -> exact copies
fold into one class -> bands -> candidate pairs -> verification on full sets ->
union-find components.

Candidates never form all pairs of a bucket. Each bucket names a pivot, and its
members are held against that pivot only; pivots differ from band to band and
from round to round. What still lies in a bucket with another component after
these rounds is compared in blocks of bounded size, by the ``SKETCH`` smallest
hashes of each set (the whole set, if it has no more), so that no link between
different texts is lost to the pivots and only likely links leave a block.

With ``BANDS`` bands of ``BAND_ROWS`` entries two texts of similarity 0.8 share
no band with probability (1 - 0.8**5)**30 < 1e-5.

Edge cases: a null or wordless text has an empty set, links with nothing and is
its own component; a text of fewer than k words is one shingle; a very long
text has all its shingles in its set and signature and is verified by the whole
set; texts with equal sets are one class, whatever their order or repeats of
words; rows that
repeat a doc_id each give a row; rows without a doc_id never represent a group
and are never kept when a copy has an id; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch, bounded, tidy

BANDS, BAND_ROWS = 30, 5
M = BANDS * BAND_ROWS
#: Smallest hashes of a set that blocks compare.
SKETCH = 256
#: Members of a bucket that one block holds.
BLOCK = 256
PIVOT_ROUNDS = 3

SIGNED = "doc_id long, n_shingles long, h1 long, h2 long, codes binary, least binary"


def _signer(k: int):
    def sign(batches):
        for b in batches:
            buf, at = K.text_buffer(b.column("text"))
            for lo, hi in K.slices(at):
                own = buf[at[lo] : at[hi]]
                sets, begin = K.shingle_sets(own, at[lo : hi + 1] - at[lo], k)
                codes = K.signature_codes(K.superminhash(sets, begin, M))
                h1, h2 = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                for i in range(hi - lo):
                    d = xxhash.xxh3_128_intdigest(sets[begin[i] : begin[i + 1]].tobytes())
                    h1[i], h2[i] = np.array([d >> 64, d & (1 << 64) - 1], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), pa.array(np.diff(begin)), pa.array(h1), pa.array(h2), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array([(sets[begin[i] : min(begin[i + 1], begin[i] + SKETCH)] >> np.uint64(K.HASH_BITS - 32)).astype(np.uint32).tobytes() for i in range(hi - lo)], pa.binary())],
                    names=["doc_id", "n_shingles", "h1", "h2", "codes", "least"],
                )

    return sign


def _band_keys(codes: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of the bands of (rows, M) codes."""
    with np.errstate(over="ignore"):
        x = codes.reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
        h = np.zeros(x.shape[:2], np.uint64)
        for j in range(BAND_ROWS):
            h = K.mix(h * np.uint64(0x9E3779B97F4A7C15) + x[:, :, j] + np.uint64(j + 1))
    return h.view(np.int64)


def _bander(batches):
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint16).reshape(n, M)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(_band_keys(codes).reshape(-1)), pa.array(np.repeat(b.column("rep").to_numpy(zero_copy_only=False), BANDS)), pa.array(np.repeat(b.column("n").to_numpy(zero_copy_only=False), BANDS))],
            names=["band", "key", "rep", "n"],
        )


def _verifier(k: int, threshold: int):
    """Rows (a, b, text_a, text_b), mostly ordered by b -> the pairs that link."""

    def verify(batches):
        for batch in batches:
            a, b = batch.column("a").to_numpy(zero_copy_only=False), batch.column("b").to_numpy(zero_copy_only=False)
            buf_a, at_a = K.text_buffer(batch.column("text_a"))
            buf_b, at_b = K.text_buffer(batch.column("text_b"))
            keep = np.zeros(len(a), bool)
            last, other = None, None
            for lo, hi in K.slices(at_a):
                sets, begin = K.shingle_sets(buf_a[at_a[lo] : at_a[hi]], at_a[lo : hi + 1] - at_a[lo], k)
                for i in range(lo, hi):
                    if last != b[i]:
                        last, other = b[i], K.shingle_sets(buf_b[at_b[i] : at_b[i + 1]], np.array([0, at_b[i + 1] - at_b[i]]), k)[0]
                    mine = sets[begin[i - lo] : begin[i - lo + 1]]
                    if not len(mine) or not len(other):
                        continue
                    spot = np.searchsorted(other, mine)
                    both = int((other[np.minimum(spot, len(other) - 1)] == mine).sum())
                    keep[i] = 100 * both >= threshold * (len(mine) + len(other) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return verify


def similarities(sketches: list[np.ndarray], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated Jaccard similarities of all pairs of a block, and how many
    elements of each union they rest on (0: exact but for 32-bit collisions)."""
    n = len(sketches)
    full = size <= SKETCH
    word, place = np.unique(np.concatenate(sketches), return_inverse=True)
    row = np.repeat(np.arange(n), [len(x) for x in sketches])
    often = np.bincount(place)
    column = np.cumsum(often > 1) - 1
    use = often[place] > 1
    row, place, wide = row[use], column[place[use]], int((often > 1).sum())
    both = np.zeros((n, n), np.float32)
    for at in range(0, wide, 8192):
        own = (place >= at) & (place < at + 8192)
        grid = np.zeros((n, min(8192, wide - at)), np.float32)
        grid[row[own], place[own] - at] = 1
        both += grid @ grid.T
    most = np.array([np.inf if f else float(x[-1]) for x, f in zip(sketches, full, strict=True)])
    # elements of i up to the least of both sketches' ends
    upto = np.stack([np.searchsorted(x, np.minimum(most, 2.0**33), side="right") for x in sketches])
    union = upto + upto.T - both
    return both / np.maximum(union, 1), np.where(full[:, None] & full[None], 0, union)


def _blocks(threshold: int):
    """Rows ordered by (band, key, g, g1, g2) -> likely links within each block:
    pairs of different components and like sizes."""
    t = threshold / 100

    def pairs(rows: dict[str, np.ndarray]):
        size, up, comp, rep = rows["n"], rows["up"], rows["comp"], rows["rep"]
        ok = np.triu(comp[:, None] != comp[None], 1) & ~((up[:, None] == 1) & (up[None] == 1))  # two of the next class meet in its own groups
        if rows["g1"][0] != rows["g2"][0]:  # pairs within one block come in their own group
            ok &= rows["own"][:, None] != rows["own"][None]
        ok &= 100 * np.minimum(size[:, None], size[None]) >= threshold * np.maximum(size[:, None], size[None])
        if not ok.any():
            return
        likely, rest = similarities(rows["least"], size)
        slack = 0.01 + np.where(rest > 0, 5 * np.sqrt(t * (1 - t) / np.maximum(rest, 1)), 0)
        for i, j in zip(*np.nonzero(ok & (likely >= t - slack)), strict=True):
            yield min(int(rep[i]), int(rep[j])), max(int(rep[i]), int(rep[j]))

    names = ("band", "key", "g", "g1", "g2", "own", "up", "rep", "comp", "n")

    def run(batches):
        held, last = [], None

        def flush():
            rows = {c: np.array([r[i] for r in held]) for i, c in enumerate(names)}
            rows["least"] = [np.frombuffer(r[-1], np.uint32) for r in held]
            found = list(pairs(rows)) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in (*names, "least")), strict=True):
                if last is not None and row[:5] != last:
                    yield flush()
                    held = []
                last = row[:5]
                held.append(row)
        if held:
            yield flush()

    return run


def _forest(batches):
    """Union-find over the links of one task: each node with its root."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for b in batches:
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = [x for x in up if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(links: DataFrame, scratch: Scratch, name: str, rounds: int = 60) -> DataFrame:
    """(node, comp) for each node with a link; comp is its component's least node.

    Tasks fold their links by union-find; what is left converges by alternating
    large-star and small-star steps (Kiveris et al., 2014).
    """
    edges = links.mapInArrow(tidy(_forest), "a long, b long").distinct()  # b < a
    edges = scratch.keep(edges, f"{name}-0")
    for i in range(1, rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # a row's own node always has a link to a smaller one here, so b < a holds
        large = scratch.keep(large.where("a > b").distinct(), f"{name}-{i}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("c"))
        small = large.join(low, "a").select(F.explode(F.expr("array(struct(a AS a, m AS b), struct(b AS a, m AS b))")).alias("e")).select("e.a", "e.b").where("a > b").distinct()
        after = scratch.keep(small, f"{name}-{i}")
        stars = after.join(after.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count() == 0
        wide = stars and after.groupBy("a").count().where("count > 1").limit(1).count() == 0
        scratch.drop(f"{name}-{i}-large")
        scratch.drop(f"{name}-{i - 1}")
        edges = after
        if wide:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    Two texts link if 100 * |A ∩ B| >= threshold * |A ∪ B| for their sets of
    distinct k-word shingles; a component is what links connect.
    """
    bounded(spark)
    scratch = Scratch(spark, "near")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = scratch.keep(texts.mapInArrow(tidy(_signer(k)), SIGNED), "signed")
    # one row for each distinct set
    classes = signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("codes").alias("codes")).where("rep IS NOT NULL")
    classes = scratch.keep(classes, "classes")
    bands = classes.select("rep", "n", "codes").mapInArrow(tidy(_bander), "band int, key long, rep long, n long")
    shared = bands.groupBy("band", "key").agg(F.count("*").alias("c")).where("c > 1").select("band", "key")
    bands = scratch.keep(bands.join(shared, ["band", "key"]), "bands")
    body = texts.where("doc_id IS NOT NULL")

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(body.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        both = one.join(body.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        return both.select("a", "b", "text_a", "text_b").mapInArrow(tidy(_verifier(k, threshold)), "a long, b long")

    links, comps, open_ = None, None, bands.withColumn("comp", F.col("rep"))
    for t in range(PIVOT_ROUNDS):
        pivot = open_.groupBy("band", "key").agg(F.min(F.struct(F.xxhash64("rep", "band", F.lit(t)).alias("o"), F.col("rep").alias("p"), F.col("comp").alias("pc"), F.col("n").alias("pn"))).alias("x")).select("band", "key", "x.p", "x.pc", "x.pn")
        pairs = open_.join(pivot, ["band", "key"]).where(f"comp <> pc AND 100 * least(n, pn) >= {threshold} * greatest(n, pn)")
        pairs = scratch.keep(pairs.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct(), f"pairs-{t}")
        found = scratch.keep(verified(pairs), f"links-{t}")
        links = found if links is None else links.union(found)
        comps = scratch.keep(components(links, scratch, f"comps-{t}"), f"comp-{t}")
        now = bands.join(comps, bands.rep == comps.node, "left").select("band", "key", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
        mixed = now.groupBy("band", "key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.count("*").alias("c")).where("c1 <> c2").select("band", "key", "c")
        open_ = scratch.keep(now.join(mixed, ["band", "key"]), f"open-{t}")
        for done in (f"pairs-{t}", f"comp-{t}", *([f"open-{t - 1}"] if t else [])):
            scratch.drop(done)
    # what the pivots left: pairs of different components and like sizes, in blocks, by their least hashes
    step = math.log(100.0 / threshold * 1.0001)  # sizes that may link are of one class or of two next to each other
    spread = open_.withColumn("s", F.floor(F.log("n") / step)).withColumn("g", F.explode(F.expr("array(s, s - 1)"))).withColumn("up", (F.col("g") < F.col("s")).cast("int"))
    sizes = spread.groupBy("band", "key", "g").agg(F.count("*").alias("m"), F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("up").alias("u")).where("c1 <> c2 AND u = 0").select("band", "key", "g", F.ceil(F.col("m") / BLOCK).cast("int").alias("nb"))
    spread = spread.join(sizes, ["band", "key", "g"]).withColumn("own", F.expr("CAST(pmod(xxhash64(rep, 1), nb) AS INT)"))
    order = ["band", "key", "g", "g1", "g2"]
    spread = spread.withColumn("j", F.explode(F.expr("sequence(0, nb - 1)"))).select("band", "key", "g", F.least("own", "j").alias("g1"), F.greatest("own", "j").alias("g2"), "own", "up", "rep", "comp", "n")
    least = signed.where("n_shingles > 0").select(F.col("doc_id").alias("rep"), "h1", "h2", "least").join(classes.select("rep", "h1", "h2"), ["rep", "h1", "h2"], "left_semi").select("rep", "least")
    spread = spread.join(least, "rep")
    rest = spread.repartition(*order).sortWithinPartitions(*order).select(*order, "own", "up", "rep", "comp", "n", "least").mapInArrow(tidy(_blocks(threshold)), "a long, b long").distinct()
    found = scratch.keep(verified(scratch.keep(rest, "pairs-rest")), "links-rest")
    comps = scratch.keep(components(links.union(found), scratch, "comps-rest"), "comp-rest")
    for done in ("bands", f"open-{PIVOT_ROUNDS - 1}", "pairs-rest", "links-rest", *(f"links-{t}" for t in range(PIVOT_ROUNDS))):
        scratch.drop(done)
    whole = classes.join(comps, classes.rep == comps.node, "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "h1", "h2").join(whole, ["h1", "h2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("comp", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


#: The query's result (k = 4, threshold 80) in DuckDB's SQL.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM t),
g AS (SELECT DISTINCT doc_id, g FROM s), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS s, doc_id AS d FROM documents UNION SELECT r.s, e.b FROM r JOIN e ON r.d = e.a),
c AS (SELECT s, min(d) AS component_id FROM r GROUP BY s)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c ON c.s = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
