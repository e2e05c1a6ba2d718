"""MinHash near-duplicates with circulant signatures, banding and exact Jaccard verification.

Signatures: shingle hashes pass a first permutation (a bijective mixer, then its place on a circle of 2^22 points) and
a second permutation of the circle. Coordinate k of a signature is the least value of the second permutation, shifted
by k places, over the shingles: two permutations give all coordinates, and the K shifted values of a shingle lie side
by side, so a signature is the elementwise least of one slice for each shingle.

Links: texts with equal shingle sets are one class. Classes that agree in a band share a bucket. First each bucket's
least class (its hub) is compared with the others, which joins the bulk of large groups without listing their pairs;
then, in buckets that still hold several components, blocks of members are compared with blocks of other components.
All comparisons count whole shingle sets. With 36 bands of 5 rows a pair of similarity 0.8 misses all bands with
probability below 1e-6.

Words are hashed by a polynomial modulo a prime (``kernels.span_hash``) and shingles by mixing their words' hashes, 64 bits
each; that two different shingles of a pair of texts agree has a chance of about 1e-19, so counts are of whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.skew import spread_join
from urbanloom.llm import kernels as K
from urbanloom.llm.graph import components
from urbanloom.llm.storage import stored
from urbanloom.session import ship

BANDS, ROWS = 36, 5
CIRCLE_BITS = 22
#: Fixed by the contract of the query: words of a shingle, and the least similarity as a percentage.
SHINGLE, PERCENT = 4, 80
#: Members of a block when several components of one bucket are compared.
BLOCK = 256
_TABLE: dict[int, np.ndarray] = {}


def shingles(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row; fewer words than k make one shingle, no words make none."""
    low = K.LOWER[data]
    starts, ends, first = K.runs(~K.SPACE[low], offs)
    words = K.span_hash(low, starts, ends)
    grams = K.window_hash(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(K.window_hash(words[a:b], b - a, 77) if b > a else np.zeros(0, np.uint64))
    return out


def _circle(n: int) -> np.ndarray:
    """Row i holds the second permutation's values at places i .. i+n-1 of the circle."""
    if n not in _TABLE:
        around = np.random.Generator(np.random.PCG64(7)).permutation(1 << CIRCLE_BITS).astype(np.uint32)
        _TABLE[n] = np.lib.stride_tricks.sliding_window_view(np.concatenate([around, around[:n]]), n)
    return _TABLE[n]


def signature(hashes: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """n coordinates of one set (not empty)."""
    table = _circle(n)
    at = (K.mix(hashes, 3) >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)
    out = table[at[:1024]].min(axis=0)
    for i in range(1024, len(at), 1024):
        np.minimum(out, table[at[i : i + 1024]].min(axis=0), out=out)
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(ROWS):
        out = K.mix(out + rows[:, j])
    return out


def set_hash(hashes: np.ndarray) -> bytes:
    """128 bits of a set, whatever its order."""
    return b"".join(int(K.mix(hashes, s).sum(dtype=np.uint64)).to_bytes(8, "big") for s in (21, 22))


def _signed(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(id, n, c, bands, s) of each row: size, digest and bands of its set, and the set itself where the id is null."""

    def run(batches):
        for batch in batches:
            missing = batch.column(0).is_null().to_pylist()
            for a, data, offs in K.chunks(batch.column(1)):
                sets = shingles(data, offs, k)
                lists = [bands(signature(s)).view(np.int64) if len(s) else None for s in sets]
                own = [s.tobytes() if len(s) and missing[a + i] else None for i, s in enumerate(sets)]
                yield pa.record_batch([batch.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_hash(s) if len(s) else None for s in sets], pa.binary()), pa.array(lists, pa.list_(pa.int64())), pa.array(own, pa.binary())], names=["id", "n", "c", "bands", "s"])

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {id_type}, n long, c binary, bands array<long>, s binary")


def _sets(df: DataFrame, signed: DataFrame, wanted: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """(c, s) for the classes of ``wanted`` (c, id, digest): their sets, sorted hashes as bytes.

    Sets are made anew from the texts of the classes' ids; classes without an id have them in ``signed``.
    """

    def run(batches):
        for batch in batches:
            numbers, expected = batch.column(0), batch.column(1).to_pylist()
            for a, data, offs in K.chunks(batch.column(2)):
                sets = shingles(data, offs, k)
                at = [i for i, s in enumerate(sets) if len(s) and set_hash(s) == expected[a + i]]
                yield pa.record_batch([numbers.take(pa.array([a + i for i in at], pa.int64())), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["c", "s"])

    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    made = texts.join(wanted, "id").select("c", "digest", "t").mapInArrow(run, "c long, s binary")
    kept = signed.where("id is null and c is not null").select(F.col("c").alias("digest"), "s").join(wanted.where("id is null").select("c", "digest"), "digest").select("c", "s")
    return made.unionByName(kept).groupBy("c").agg(F.first("s").alias("s"))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of ``pairs`` (hub u, member v) whose sets are similar. Hubs with many members are salted."""
    degrees = pairs.groupBy("u").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    salted = pairs.join(degrees, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("salt"))
    hubs = salted.select("u", "salt").distinct().join(sets.withColumnRenamed("c", "u"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "s")
    members = salted.join(sets.withColumnRenamed("c", "v"), "v").select("u", "salt", "v", "s")
    rows = hubs.unionByName(members).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches):
        hub, own = None, None
        for batch in batches:
            found_u, found_v = [], []
            for u, v, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                x = np.frombuffer(s.as_buffer(), np.uint64)
                if v is None:
                    hub, own = u, x.copy()
                elif u == hub and similar(own, x, percent):
                    found_u.append(u)
                    found_v.append(v)
            yield pa.record_batch([pa.array(found_u, pa.int64()), pa.array(found_v, pa.int64())], names=["u", "v"])

    return rows.select("u", "v", "s").mapInArrow(run, "u long, v long")


def block_links(groups: list[tuple[int, int, np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of (node, component, set) members, enough to connect all that are connected."""
    parent = {c: c for _, c, _ in groups}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    every = np.concatenate([s for _, _, s in groups])
    values, inverse = np.unique(every, return_inverse=True)
    sizes = np.array([len(s) for _, _, s in groups])
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for i, (node, comp, _) in enumerate(groups[:-1]):
        roots = np.array([root(c) for _, c, _ in groups[i + 1 :]])
        rest = np.flatnonzero((roots != root(comp)) & (100 * np.minimum(sizes[i + 1 :], sizes[i]) >= percent * np.maximum(sizes[i + 1 :], sizes[i]))) + i + 1
        if not len(rest):
            continue
        mark = np.zeros(len(values) + 1, np.int64)
        mark[inverse[at[i] : at[i + 1]]] = 1
        both = np.add.reduceat(mark[inverse[at[i + 1] :]], at[i + 1 : -1] - at[i + 1])[rest - i - 1]
        for j in rest[100 * both >= percent * (sizes[i] + sizes[rest] - both)]:
            a, b = root(comp), root(groups[j][1])
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((node, groups[j][0]))
    return out


def _across(buckets: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components that share a bucket."""
    members = buckets.join(comp.withColumnRenamed("node", "c"), "c", "left").select("key", "c", F.coalesce("component", "c").alias("comp"))
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("m"), *(F.sum(F.xxhash64("c", F.lit(i)).cast("decimal(38,0)")).alias(f"h{i}") for i in (2, 3)))
    several = counts.groupBy("key").agg(F.sum("m").alias("m"), F.max_by("comp", "m").alias("top"), F.max("m").alias("m_top"), F.sum("h2").alias("h2"), F.sum("h3").alias("h3"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    # buckets of the same members, by their number and two sums of hashes (128 bits), are compared once
    once = several.groupBy("m", "h2", "h3").agg(F.min(F.struct("key", "top", "m_top")).alias("b")).select("b.key", "b.top", F.ceil(F.col("b.m_top") / BLOCK).cast("int").alias("q_top"), F.ceil((F.col("m") - F.col("b.m_top")) / BLOCK).cast("int").alias("q_rest"))
    h = F.xxhash64("c", F.lit(1))
    placed = members.join(once, "key").withColumn("mine", F.when(F.col("comp") == F.col("top"), F.pmod(h, F.col("q_top"))).otherwise(F.col("q_top") + F.pmod(h, F.col("q_rest"))).cast("int"))
    # two blocks meet unless both are of the largest component; equal numbers mean a block by itself
    other = F.when(F.col("mine") < F.col("q_top"), F.sequence(F.col("q_top"), F.col("q_top") + F.col("q_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("q_top") + F.col("q_rest") - 1))
    rows = placed.select("key", "c", "comp", "mine", F.explode(other).alias("other")).select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "c", "comp")
    filled = rows.join(sets, "c").select("key", "i", "j", "c", "comp", "s").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "c")

    def run(batches):
        now, held = None, []
        for batch in batches:
            out = []
            k, i, j, c, comp_ = (batch.column(x).to_pylist() for x in range(5))
            for place, node, own, s in zip(zip(k, i, j), c, comp_, batch.column(5)):
                if place != now:
                    out += block_links(held, percent) if len(held) > 1 else []
                    now, held = place, []
                held.append((node, own, np.frombuffer(s.as_buffer(), np.uint64)))
            yield _pairs(out)
        yield _pairs(block_links(held, percent) if len(held) > 1 else [])

    return filled.mapInArrow(run, "u long, v long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([a for a, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.int64())], names=["u", "v"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = PERCENT) -> DataFrame:
    """``id_col``, ``n_shingles``, ``component_id`` (least id that links reach) and ``kept`` for each row.

    Words are runs without white space, ASCII letters lower-cased; a text's set has its distinct ``shingle``-word
    shingles, the whole sequence if it has fewer words. Null and empty texts have an empty set and are linked with
    nothing: their component is their own id. Rows of a null id are linked like others but never give a component its id;
    where all ids of a component are null, its id is null, and such rows are kept. Repeated rows share a component,
    as equal texts do, and rows that repeat a kept id are kept alike. Extra columns are not read.
    """
    ship(df.sparkSession)
    signed = stored(_signed(df, id_col, text_col, shingle), "signed")
    classes = signed.where("c is not null").groupBy(F.col("c").alias("digest")).agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("copies"))
    # classes are numbered as they are written, so different sets never share a number
    classes = stored(classes.withColumn("c", F.monotonically_increasing_id()), "classes")
    banded = classes.select("c", "n", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("c", "n")).alias("hub")).where("m > 1")
    buckets = stored(banded.join(hubs, "key").select("key", "c", "n", F.col("hub.c").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    wanted = classes.join(buckets.select("c").distinct(), "c").select("c", "id", "digest")
    sets = stored(_sets(df, signed, wanted, id_col, text_col, shingle), "sets")
    near = buckets.where(f"c <> hub and 100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select(F.col("hub").alias("u"), F.col("c").alias("v")).distinct()
    links = stored(_verified(near, sets, percent), "verified")
    comp = components(links)
    more = stored(_across(buckets.select("key", "c"), comp, sets, percent), "across")
    if not more.isEmpty():
        comp = components(links.unionByName(more))
    # the least id of each component, over its classes, then of each class; a component or class may be most of the rows
    linked = stored(comp.withColumnRenamed("node", "c").join(classes.select("c", "id"), "c"), "linked")
    sums = linked.groupBy("component").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    least = spread_join(linked.select("c", "component"), sums.select("component", "least"), "component", sums.select("component", "n"))
    placed = classes.select("c", "id", "digest").join(least.select("c", "least", F.lit(True).alias("linked")), "c", "left")
    placed = placed.select(F.col("digest").alias("c"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("component"))
    rows = spread_join(signed.select("id", "n", "c"), placed, "c", classes.select(F.col("digest").alias("c"), F.col("copies").alias("n")))
    component_id = F.when(F.col("c").isNull(), F.col("id")).otherwise(F.col("component"))
    out = rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component_id.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
