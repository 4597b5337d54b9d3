"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct five-word shingles. Its sketch has M
registers; each holds, on an exponential scale, the least of the values that
the shingles drew for it, truncated to 16 bits. Sketches of parts merge by the
registers' maximum. The steps:

1. Documents with equal sets form a class, whose smallest id stands for it.
2. Bands of BAND registers are hashed; classes that share a band are candidates.
   At a similarity of 0.75 the chance to share none is about 5e-6 from TINY
   shingles on; the registers of smaller sets are not independent.
3. In a bucket of at most SMALL classes every pair is a candidate. In a larger
   one each class is a candidate with the bucket's centre; then an exact prefix
   filter over the classes of larger buckets, and over all sets so small that
   they may be linked with one below TINY, finds the pairs that were left
   apart, so that no link is lost there and no bucket's pairs are all listed.
   A shingle with many holders is dealt out in blocks.
4. The registers of a pair and the sets' sizes give a joint likelihood of the
   similarity; pairs for which 0.75 is far less likely than the best value go.
5. The rest are confirmed on their full sets, and links make components.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import chunks, materialise
from .components import components
from .shingles import mix, shingle_sets

M = 128
BASE = 1.001
RATE = 20.0
LIMIT = 65534
BAND = 4
SMALL = 24
#: Pairs go if the likelihood at the threshold is so many times e below the best.
LEAST_LOG_RATIO = 16.0
#: Eight MB.
MOST_BITS = 1 << 26
#: Smaller sets, and those that may be linked with one, are compared by the exact prefix filter.
TINY = 12
#: A shingle with more holders is dealt out in blocks of so many; at most MOST_HOT shingles are broadcast as such.
HOT_ROWS = 512
MOST_HOT = 65_536
_U = np.uint64


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers (sets x M, unsigned 16-bit) of sets of 64-bit hashes.

    Every hash draws one value from each of M equally likely parts of the
    exponential distribution, in ascending order, for registers in an order of
    its own; a set is done when no later part can lower a register.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    lowest = np.full(n * M, np.iinfo(np.uint64).max, dtype=_U)
    if sizes.sum():
        hashes = mix(np.concatenate(sets) ^ _U(0x5851F42D4C957F2D))
        owner = np.repeat(np.arange(n), sizes)
        step = (hashes >> _U(40)).astype(np.int64) | 1  # odd, so its multiples visit every register once
        first = (hashes >> _U(20)).astype(np.int64)
        part_bits = 64 - (M - 1).bit_length()
        for j in range(M):
            register = (first + j * step) & (M - 1)
            value = (_U(j) << _U(part_bits)) | (mix(hashes + _U((0x9E3779B97F4A7C15 * (j + 1)) % 2**64)) >> _U(64 - part_bits))
            np.minimum.at(lowest, owner * M + register, value)
            if j < 8 or j % 4 == 3:
                done = (lowest.reshape(n, M).max(1) >> _U(part_bits)) <= _U(j)
                if done.any():
                    keep = ~done[owner]
                    hashes, owner, step, first = hashes[keep], owner[keep], step[keep], first[keep]
                if not len(hashes):
                    break
    uniform = np.minimum(lowest.astype(np.float64) / 2.0**64, 1 - 2.0**-53)
    drawn = -np.log1p(-uniform) / RATE
    scaled = np.floor(1 - np.log(np.maximum(drawn, 1e-300)) / np.log(BASE))
    registers = np.clip(scaled, 0, LIMIT + 1).astype(np.uint16).reshape(n, M)
    registers[sizes == 0] = 0
    return registers


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


@functools.lru_cache(maxsize=1)
def _grid() -> np.ndarray:
    return np.linspace(0.0, 1.0, 201)


def _log_share(x: np.ndarray) -> np.ndarray:
    """How likely one sketch's register exceeds the other's, x being the first's own share of the union."""
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: np.ndarray) -> np.ndarray:
    """Of each pair (rows) at each similarity (columns), given the registers of both and their sets' sizes."""
    above, below = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    total = (n_a + n_b)[:, None].astype(float)
    u, v = n_a[:, None] / total, n_b[:, None] / total
    only_a, only_b = np.maximum(u - v * similarity, 0), np.maximum(v - u * similarity, 0)
    p, q = _log_share(only_a), _log_share(only_b)
    tiny = 1e-12
    return above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + (a.shape[1] - above - below) * np.log(np.maximum(1 - p - q, tiny))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The most likely similarity of each pair."""
    grid = _grid()[None, :]
    possible = grid <= (np.minimum(n_a, n_b) / np.maximum(n_a, n_b))[:, None] + 0.0025
    return _grid()[np.where(possible, log_likelihood(a, b, n_a, n_b, grid), -np.inf).argmax(1)]


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float = 0.75, log_ratio: float = LEAST_LOG_RATIO) -> np.ndarray:
    """Whether each pair may reach the threshold; False only where the registers speak clearly against it."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    best = estimate(a, b, n_a, n_b)
    at = log_likelihood(a, b, n_a, n_b, np.array([[threshold]]))[:, 0]
    top = log_likelihood(a, b, n_a, n_b, best[:, None])[:, 0]
    fits = n_a * 100 >= n_b * int(100 * threshold)
    fits &= n_b * 100 >= n_a * int(100 * threshold)
    return fits & ((best >= threshold) | (top - at <= log_ratio))


def _sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_lo, set_hi (a 128-bit hash of the set) and registers."""
    import xxhash

    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_lo", pa.int64()), ("set_hi", pa.int64()), ("registers", pa.binary())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                sets = shingle_sets([t.encode() for t in part.column(1).to_pylist()])
                digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64) for s in sets])
                registers = sketches(sets)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                ], schema=schema)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_lo long, set_hi long, registers binary")


def _bands(classes: DataFrame) -> DataFrame:
    """(band, id): a hash of each band's place and registers."""
    import xxhash

    n_bands = M // BAND

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint16).reshape(-1, n_bands, BAND)
            # four 16-bit registers are one 64-bit number
            key = mix(np.ascontiguousarray(rows).view(_U).reshape(len(rows), n_bands) ^ mix(np.arange(1, n_bands + 1, dtype=_U))[None, :])
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), n_bands))], ["band", "id"])

    return classes.select("id", "registers").mapInArrow(run, "band long, id long")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the registers don't rule out."""
    side = classes.select("id", "n_shingles", "registers")
    joined = pairs.join(side.toDF("a", "n_a", "r_a"), "a").join(side.toDF("b", "n_b", "r_b"), "b").select("a", "b", "n_a", "n_b", "r_a", "r_b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n = [np.asarray(batch.column(i)) for i in range(4)]
                r = [np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(-1, M) for i in (4, 5)]
                keep = np.concatenate([plausible(r[0][i : i + 500], r[1][i : i + 500], n[2][i : i + 500], n[3][i : i + 500], threshold) for i in range(0, len(n[0]), 500)])
                yield pa.RecordBatch.from_arrays([pa.array(n[0][keep]), pa.array(n[1][keep])], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """One bit for each place that an id's hash falls on, ``bits`` in all, whatever the number of ids."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    rows = ids.select(place.alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("part")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents whose ids are given, and of a few others.

    Texts are not shuffled: each task looks its rows up in a bitmap of at most
    MOST_BITS bits. A bitmap that is too small for the ids lets more of the others
    pass, which costs time and loses nothing.
    """
    bits = min(MOST_BITS, max(1 << 20, 1 << (64 * ids.count()).bit_length()))
    bitmap = _bitmap(ids, bits)
    placed = docs.where("doc_id is not null").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("place"))

    def run(batches):
        for batch in batches:
            place = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1))
            for part in chunks(batch, "text"):
                sets = shingle_sets([t.encode() for t in part.column(1).to_pylist()])
                offsets = np.zeros(len(sets) + 1, dtype=np.int32)
                np.cumsum([len(s) for s in sets], out=offsets[1:])
                flat = pa.array(np.concatenate(sets).view(np.int64)) if sets else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "shingles"])

    return placed.mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold, with the shared number and the union's."""
    joined = pairs.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    counted = joined.select("a", "b", shared.alias("shared"), (F.size("s_a") + F.size("s_b")).cast("long").alias("_sum"))
    counted = counted.select("a", "b", "shared", (F.col("_sum") - F.col("shared")).alias("united"))
    return counted.where(F.col("shared") * 100 >= F.col("united") * int(round(100 * threshold)))


def _left_apart(sets: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different components that may reach the threshold, by an exact prefix filter.

    The sets' shingles are put in one order, rare ones first. Two sets whose
    overlap must be at least o share a shingle among the first n - o + 1 of
    each; o follows from both sizes. So a set's prefix of (1 - threshold) n + 1
    shingles is enough to look at, and a shared one counts only where it stands
    early enough in both for that pair.
    """
    ratio = int(round(100 * threshold))
    items = sets.select("id", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("n_own"), F.explode("shingles").alias("shingle"))
    items = materialise(items, "items")  # read thrice, and listed once
    common = materialise(items.groupBy("shingle").agg(F.count("*").alias("n")), "frequencies")
    hot = _hot(common)
    counted = items.join(hot, "shingle").unionByName(items.join(hot, "shingle", "left_anti").join(common, "shingle"))
    ordered = counted.select("id", "set", "n_own", F.struct("n", "shingle").alias("item"))
    ordered = ordered.groupBy("id", "set", "n_own").agg(F.array_sort(F.collect_set("item")).alias("items"))  # at most a text's shingles
    length = F.col("n_own") - F.ceil(F.col("n_own") * ratio / 100) + 1
    prefix = ordered.select("id", "n_own", F.posexplode(F.slice("items", F.lit(1), length.cast("int"))).alias("at", "item"))
    prefix = prefix.where("item.n > 1").select("id", "n_own", (F.col("at") + 1).alias("at"), F.col("item.shingle").alias("shingle"))
    placed = materialise(prefix.join(roots, "id"), "prefixes")
    # a shingle whose holders are all in one component has nothing to find
    open_ = placed.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("shingle", "n")
    open_ = materialise(open_, "open")
    hot = _hot(open_)
    cold = placed.join(hot, "shingle", "left_anti").join(open_, "shingle").select(placed.columns)
    # the holders of a hot shingle in blocks, every two of which meet in a cell of their own
    n_blocks = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    blocks = placed.join(hot, "shingle").withColumn("block", F.pmod(F.xxhash64("id"), n_blocks).cast("int"))
    first = blocks.select(*placed.columns, F.col("block").alias("low"), F.explode(F.sequence(F.col("block"), n_blocks - 1)).alias("high"))
    second = blocks.select(*placed.columns, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("low"), F.col("block").alias("high"))
    need = F.ceil((F.col("n_a") + F.col("n_b")) * ratio / (100 + ratio))
    early = (F.col("at_a") <= F.col("n_a") - need + 1) & (F.col("at_b") <= F.col("n_b") - need + 1)
    # what can still be shared from here on must do
    rest = 1 + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + F.least(F.col("at_a"), F.col("at_b")) - 1
    possible = (F.col("root_a") != F.col("root_b")) & early & (rest >= need)

    def met(left: DataFrame, right: DataFrame, keys: list[str], once) -> DataFrame:
        def side(frame, name):
            return frame.select(*keys, F.col("id").alias(name), *(F.col(c).alias(f"{new}_{name}") for c, new in (("n_own", "n"), ("at", "at"), ("root", "root"))))

        found = side(left, "a").join(side(right, "b"), keys).where(once & possible)
        return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    ascending = F.col("a") < F.col("b")
    pairs = met(cold, cold, ["shingle"], ascending)
    more = met(first, second, ["shingle", "low", "high"], ascending | (F.col("low") < F.col("high")))
    return pairs.unionByName(more).distinct()


def _hot(counts: DataFrame) -> DataFrame:
    """The rows of counts (key, n) whose n is too large for one task, to be broadcast.

    They are those of more than HOT_ROWS and more than one part in MOST_HOT of
    the whole, so there are fewer than MOST_HOT of them, whatever the input.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    return F.broadcast(counts.where(F.col("n") > max(HOT_ROWS, total // MOST_HOT)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75, small: int = SMALL) -> DataFrame:
    """Each document's component: doc_id, n_shingles, component_id, kept.

    Words are runs without white space, A-Z lower-cased; the set is the
    distinct five-word shingles, or the whole sequence of a shorter text. Two
    documents are linked if 100 times the shared number is at least 100 *
    threshold times the union's. component_id is the smallest id reachable,
    kept is doc_id = component_id. Texts without words, null ones included,
    are linked with nothing. Repeated rows of an id come out once each; an id
    with different texts belongs to all their components, which it joins. Null
    ids stand alone, with a null component, kept. An empty table gives no rows.
    """
    slim = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    table = materialise(_sketch_table(slim), "sketches")
    full = table.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_lo", "set_hi").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers"))
    classes = materialise(classes, "classes")
    bands = materialise(_bands(classes), "bands")
    counts = bands.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("band", "id"), F.col("id"))).alias("_centre")).where("size > 1")
    members = materialise(bands.join(counts.select("band", "size", F.col("_centre.id").alias("centre")), "band"), "members")
    listed = members.where(F.col("size") <= small).groupBy("band").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # at most ``small``
    listed = listed.select(F.posexplode("ids").alias("at", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("at") + 2, F.lit(small))).alias("b"))
    starred = members.where((F.col("size") > small) & (F.col("id") != F.col("centre"))).select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b"))
    candidates = materialise(listed.unionByName(starred).where("a < b").distinct(), "candidates")
    likely = materialise(_likely(candidates, classes, threshold), "likely")
    tiny = classes.where(F.col("n_shingles") < int(TINY / threshold) + 1).select("id")
    crowded = materialise(members.where(F.col("size") > small).select("id").unionByName(tiny).distinct(), "crowded")
    wanted = likely.select(F.col("a").alias("id")).unionByName(likely.select(F.col("b").alias("id"))).unionByName(crowded).distinct()
    # an id with several texts has several sets, any of which may make a link
    sets = materialise(_sets_of(slim, materialise(wanted, "wanted")), "sets")
    links = materialise(_confirmed(likely, sets, threshold).select("a", "b").distinct(), "confirmed")
    if not crowded.isEmpty():
        first = components(links)
        roots = crowded.join(first, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        apart = _left_apart(sets.join(crowded, "id", "left_semi"), materialise(roots, "roots"), threshold)
        more = _confirmed(materialise(_likely(apart, classes, threshold), "late"), sets, threshold)
        links = materialise(links.unionByName(more.select("a", "b")).distinct(), "all_links")
    to_class = full.select("doc_id", "set_lo", "set_hi").join(classes.select("set_lo", "set_hi", "id"), ["set_lo", "set_hi"]).select("doc_id", "id").distinct()
    to_class = materialise(to_class, "to_class")
    # an id with several texts links their classes
    bridges = to_class.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("a", "b")
    roots = components(links.unionByName(bridges))
    rooted = to_class.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = table.select("doc_id", "n_shingles").join(rooted, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
