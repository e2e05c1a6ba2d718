"""Exact removal of repeated byte strings by a sparse, hash-compared suffix sort.

Which strings are compared: each stretch of ``WINDOW`` bytes picks the leftmost least of its ``GRAM``-byte grams
(by hash) as anchor, so equal stretches pick equal anchors at equal places. An anchor's context is the bytes of all
stretches that picked it. Equal contexts are counted by digest; different contexts of one anchor are compared.

How they are compared: prefix polynomial hashes of the contexts give, by binary search, the common extension of two
contexts to the right or left of the anchor in logarithmic time. A mergesort with that comparison orders the
contexts by what precedes the anchor and by what follows it. For each left extension that occurs in the order, its
runs are scanned in the order of the right side: neighbours there have the longest common right extension. What is
found is compared byte by byte; if hashes collided, the anchor's contexts are compared without hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.skew import spread_join
from urbanloom.llm import kernels as K
from urbanloom.llm.storage import stored
from urbanloom.session import ship

#: Bytes of a string that counts as repeated, and of a gram.
WINDOW, GRAM = 400, 100
#: Contexts of one anchor that are sorted together; larger groups are split by the bytes about the anchor, in
#: steps of STEP, so that whoever shares a string meets in some part. Parts of more than GROUP contexts are split by
#: single bytes, where all of a part share a whole string and nothing is left to sort.
SPLIT, STEP, GROUP = 256, 100, 20_000
_SMALL = 1 << 18
#: Starts of stretches that are looked at together, however long a text is, and bytes of contexts that are compared at a time.
SLICE, HELD = 1 << 20, 2 << 20


def anchors(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of stretches with one anchor: the anchor's place, the first and the last stretch's start, the gram's hash.

    A stretch's anchor depends on its own bytes alone, so long texts are read slice by slice; a run that a slice's end
    cuts in two is put together again.
    """
    parts = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))]
    for a in range(0, max(len(data) - window + 1, 0), SLICE):
        own = data[a : a + SLICE + window - 1]
        p, lo, hi, h = _anchors(own, np.unique(np.clip(offs - a, 0, len(own))), window, gram)
        parts.append((p + a, lo + a, hi + a, h))
    p, lo, hi, h = (np.concatenate(x) for x in zip(*parts))
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (lo[1:] != hi[:-1] + 1)
    last = np.ones(len(p), bool)
    last[:-1] = new[1:]
    return p[new], lo[new], hi[last], h[new]


def _anchors(data: np.ndarray, offs: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    at = np.arange(n - gram + 1)
    h = K.mix(K.between(K.prefix_hash(data), at, at + gram))
    key = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width, size = window - gram + 1, 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n - window + 1, bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        if b - a >= window:
            valid[a : b - window + 1] = True
    first = valid.copy()
    first[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    starts = offs[:-1][np.diff(offs) >= window]
    first[starts] = True
    lo = np.flatnonzero(first)
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    return place[lo], lo, np.flatnonzero(last), h[place[lo]]


def _prepared(df: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(id, sha, n, grams, twice) of each text: its digest, length, distinct anchors' grams, and those it has twice."""

    def run(batches):
        for batch in batches:
            for a, data, offs in K.chunks(batch.column(1), _SMALL):
                p, _, _, h = anchors(data, offs, window, gram)
                cut = np.searchsorted(p, offs)
                sha, grams, twice = [], [], []
                for i, (x, y) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
                    sha.append(hashlib.sha256(data[x:y]).digest())
                    values, counts = np.unique(h[cut[i] : cut[i + 1]], return_counts=True)
                    grams.append(values.view(np.int64))
                    twice.append(values[counts > 1].view(np.int64))
                yield pa.record_batch([batch.column(0).slice(a, len(sha)), pa.array(sha, pa.binary()), pa.array(np.diff(offs)), pa.array(grams, pa.list_(pa.int64())), pa.array(twice, pa.list_(pa.int64()))], names=["id", "sha", "n", "grams", "twice"])

    id_type = df.schema[id_col].dataType.simpleString()
    return _texts(df, id_col, text_col).mapInArrow(run, f"id {id_type}, sha binary, n long, grams array<long>, twice array<long>")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def _contexts(held: DataFrame, window: int, gram: int) -> DataFrame:
    """(g, ch, sha, p, lo, hi, m) for the anchors of held texts (sha, grams, t) whose gram is among ``grams``; p, lo and
    hi are places in the text, ch is the context's digest. A row stands for m neighbours with equal contexts."""

    def run(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            shas, wanted = batch.column(0), batch.column(1)
            for a, data, offs in K.chunks(batch.column(2), _SMALL):
                p, lo, hi, h = anchors(data, offs, window, gram)
                cut = np.searchsorted(p, offs)
                raw = data.tobytes()
                for i, base in enumerate(offs[:-1].tolist()):
                    own = slice(cut[i], cut[i + 1])
                    keep = np.isin(h[own].view(np.int64), np.array(wanted[a + i].values))
                    last = None
                    for q, x, y, g in zip(p[own][keep].tolist(), lo[own][keep].tolist(), hi[own][keep].tolist(), h[own][keep].view(np.int64).tolist()):
                        y += window
                        ch = hashlib.blake2b(raw[x:y], digest_size=16, salt=(q - x).to_bytes(8, "little")).digest()
                        if last is not None and cols[0][last] == g and cols[1][last] == ch and x - base <= cols[5][last]:
                            cols[5][last] = y - base
                            cols[6][last] += 1
                            continue
                        last = len(cols[0])
                        for c, v in zip(cols, (g, ch, shas[a + i].as_py(), q - base, x - base, y - base, 1)):
                            c.append(v)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["g", "ch", "sha", "p", "lo", "hi", "m"])

    return held.select("sha", "grams", "t").mapInArrow(run, "g long, ch binary, sha binary, p long, lo long, hi long, m long")


class Extensions:
    """Common extensions of contexts about their anchors, by prefix hashes and binary search."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, places: np.ndarray, ends: np.ndarray):
        self.data, self.places, self.starts = data, places, starts
        self.left, self.right = places - starts, ends - places
        # places count from a context's own start, so the powers needed are few
        self.prefix = K.prefix_hash(data, np.arange(len(data)) - np.repeat(starts, ends - starts))

    def common(self, i: np.ndarray, j: np.ndarray, right: bool) -> np.ndarray:
        room = self.right if right else self.left
        lo, hi = np.zeros(len(i), np.int64), np.minimum(room[i], room[j])
        a, b, h, x, y = self.places[i], self.places[j], self.prefix, self.left[i], self.left[j]
        for _ in range(int(hi.max(initial=0)).bit_length()):
            mid = (lo + hi + 1) >> 1
            if right:
                same = K.between(h, a, a + mid, x) == K.between(h, b, b + mid, y)
            else:
                same = K.between(h, a - mid, a, x - mid) == K.between(h, b - mid, b, y - mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def less(self, i: np.ndarray, j: np.ndarray, right: bool, or_equal: bool) -> np.ndarray:
        """Whether context i comes before j; one that is the beginning of the other comes first."""
        room, n = (self.right if right else self.left), self.common(i, j, right)
        done_i, done_j = n == room[i], n == room[j]
        step = n if right else -n - 1
        top = len(self.data) - 1
        x = self.data[np.clip(self.places[i] + step, 0, top)]
        y = self.data[np.clip(self.places[j] + step, 0, top)]
        return np.where(done_i & done_j, or_equal, np.where(done_i, True, np.where(done_j, False, x < y)))

    def sort(self, group: np.ndarray, right: bool) -> np.ndarray:
        """Rows by group, then by context: a bottom-up mergesort of all groups at once. ``group`` must not decrease."""
        n = len(group)
        order = np.arange(n)
        begin = np.searchsorted(group, group)
        end = np.searchsorted(group, group, "right")
        largest, width = int((end - begin).max(initial=0)), 1
        while width < largest:
            slot = np.arange(n) - begin
            run = begin + slot // (2 * width) * (2 * width)
            middle, stop = np.minimum(run + width, end), np.minimum(run + 2 * width, end)
            at = np.flatnonzero(middle < stop)
            first_half = at < middle[at]
            lo = np.where(first_half, middle[at], run[at])
            hi = np.where(first_half, stop[at], middle[at])
            base = lo.copy()
            own = order[at]
            while True:
                live = np.flatnonzero(lo < hi)
                if not len(live):
                    break
                mid = (lo[live] + hi[live]) >> 1
                them, me, first = order[mid], own[live], first_half[live]
                before = np.empty(len(live), bool)
                before[first] = self.less(them[first], me[first], right, False)
                before[~first] = self.less(them[~first], me[~first], right, True)
                lo[live] = np.where(before, mid + 1, lo[live])
                hi[live] = np.where(before, hi[live], mid)
            target = run[at] + (at - np.where(first_half, run[at], middle[at])) + (lo - base)
            moved = order.copy()
            moved[target] = own
            order = moved
            width *= 2
        return order


def repeats(group: np.ndarray, data: np.ndarray, starts: np.ndarray, places: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context the bytes before and after its anchor that repeated strings cover (0, 0 if none)."""
    n = len(group)
    ext = Extensions(data, starts, places, ends)
    by_left = ext.sort(group, False)
    rank = np.empty(n, np.int64)
    rank[ext.sort(group, True)] = np.arange(n)
    g = group[by_left]
    common = np.full(n, -1, np.int64)
    if n > 1:
        common[1:] = np.where(g[1:] == g[:-1], ext.common(by_left[:-1], by_left[1:], False), -1)
    # the different left extensions of each group, one of each group at a time
    pairs = np.unique(np.stack([g[common >= 0], common[common >= 0]], axis=1), axis=0) if n else np.zeros((0, 2), np.int64)
    turn = np.arange(len(pairs)) - np.searchsorted(pairs[:, 0], pairs[:, 0])
    best_l, best_r = np.zeros(n, np.int64), np.zeros(n, np.int64)
    claims: list[tuple] = []
    for t in range(int(turn.max(initial=-1)) + 1):
        now = pairs[turn == t]
        where = np.searchsorted(now[:, 0], g)
        inside = np.flatnonzero((where < len(now)) & (now[np.minimum(where, len(now) - 1), 0] == g))
        level = now[where[inside], 1]
        cluster = np.cumsum(common[inside] < level)
        rows = by_left[inside]
        order = np.lexsort((rank[rows], cluster))
        rows, cluster, level = rows[order], cluster[order], level[order]
        both = np.flatnonzero(cluster[1:] == cluster[:-1])
        reach = np.zeros(len(rows) + 1, np.int64)
        reach[both + 1] = ext.common(rows[both], rows[both + 1], True)
        back = reach[:-1] >= reach[1:]
        most = np.maximum(reach[:-1], reach[1:])
        hit = np.flatnonzero(most + level >= window)
        partner = rows[np.where(back[hit], hit - 1, np.minimum(hit + 1, len(rows) - 1))]
        better = (level[hit] > best_l[rows[hit]]) | (most[hit] > best_r[rows[hit]])
        claims += zip(rows[hit][better].tolist(), partner[better].tolist(), level[hit][better].tolist(), most[hit][better].tolist())
        np.maximum.at(best_l, rows[hit], level[hit])
        np.maximum.at(best_r, rows[hit], most[hit])
    raw = data.tobytes()
    wrong = {int(group[i]) for i, j, l, r in claims if raw[places[i] - l : places[i] + r] != raw[places[j] - l : places[j] + r]}
    for k in wrong:
        _plainly(np.flatnonzero(group == k), raw, starts, places, ends, window, best_l, best_r)
    return best_l, best_r


def _plainly(rows: np.ndarray, raw: bytes, starts, places, ends, window: int, best_l: np.ndarray, best_r: np.ndarray) -> None:
    """The same for one group by comparing bytes, for the case that hashes collided."""
    seen: dict[tuple, list] = {}
    for i in rows.tolist():
        best_l[i] = best_r[i] = 0
        for s in range(int(starts[i]), int(ends[i]) - window + 1):
            seen.setdefault((int(places[i]) - s, raw[s : s + window]), []).append(i)
    for (before, _), who in seen.items():
        for i in who if len(who) > 1 else ():
            best_l[i], best_r[i] = max(best_l[i], before), max(best_r[i], window - before)


def _compared(rows: DataFrame, window: int) -> DataFrame:
    """(g, ch, l, r) from contexts (g, ch, lead, c): what repeats cover, about the anchor. Groups don't leave a task."""

    def flush(held):
        g = np.array([x[0] for x in held], np.int64)
        group = np.concatenate([[0], np.cumsum(g[1:] != g[:-1])])
        sizes = np.array([len(x[3]) for x in held])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        data = np.frombuffer(b"".join(x[3] for x in held), np.uint8)
        l, r = repeats(group, data, starts, starts + np.array([x[2] for x in held]), ends, window)
        at = np.flatnonzero(r)
        return pa.record_batch([pa.array(g[at]), pa.array([held[i][1] for i in at], pa.binary()), pa.array(l[at]), pa.array(r[at])], names=["g", "ch", "l", "r"])

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                for row in zip(*(c.to_pylist() for c in batch.slice(a, 2000).columns)):
                    if size >= HELD and row[0] != held[-1][0]:
                        yield flush(held)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[3])
        if held:
            yield flush(held)

    return rows.select("g", "ch", "lead", "c").repartition("g").sortWithinPartitions("g", "ch").mapInArrow(run, "g long, ch binary, l long, r long")


def _split(rows: DataFrame, window: int, gram: int, step: int) -> DataFrame:
    """(g, ch, lead, c) with each group split into parts, of which a context may be in several.

    Contexts that share a string have l equal bytes before the anchor's gram and window - gram - l after it. With
    k = l // step they have at least k * step before it and more than window - gram - (k + 1) * step after it, so
    these bytes name part k; a context is in all parts that it has the bytes for.
    """
    around = window - gram

    def run(batches):
        for batch in (b.slice(a, 1000) for b in batches for a in range(0, b.num_rows, 1000)):
            out: list[list] = [[], [], [], []]
            for g, ch, lead, c in zip(*(x.to_pylist() for x in batch.columns)):
                for k in range(around // step + 1):
                    left, right = k * step, max(0, around - (k + 1) * step + 1)
                    if left <= lead and lead + gram + right <= len(c):
                        part = hashlib.blake2b(c[lead - left : lead + gram + right], digest_size=8, salt=k.to_bytes(2, "little"), key=g.to_bytes(8, "little", signed=True)).digest()
                        for o, v in zip(out, (int.from_bytes(part, "little", signed=True), ch, lead, c)):
                            o.append(v)
            yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=["g", "ch", "lead", "c"])

    return rows.select("g", "ch", "lead", "c").mapInArrow(run, "g long, ch binary, lead long, c binary")


def _counted(rows: DataFrame, window: int) -> DataFrame:
    """The same for parts split by single bytes: each stretch is a part of its own, named by its digest and place."""

    def run(batches):
        for batch in (b.slice(a, 200) for b in batches for a in range(0, b.num_rows, 200)):
            out: list[list] = [[], [], []]
            for ch, lead, c in zip(*(x.to_pylist() for x in batch.columns)):
                for s in range(len(c) - window + 1):
                    for o, v in zip(out, (ch, lead - s, hashlib.blake2b(c[s : s + window], digest_size=16, salt=(lead - s).to_bytes(8, "little", signed=True)).digest())):
                        o.append(v)
            yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.binary(), pa.int64(), pa.binary()))], names=["ch", "before", "d"])

    each = stored(rows.select("ch", "lead", "c").mapInArrow(run, "ch binary, before long, d binary").distinct(), "stretches")
    counts = each.groupBy("d").agg(F.count("*").alias("n"))
    twice = counts.where("n > 1").select("d")
    return spread_join(each, twice, "d", counts, "inner").groupBy("ch").agg(F.max("before").alias("l"), (F.lit(window) - F.min("before")).alias("r"))


def _cut(held: DataFrame) -> DataFrame:
    """(sha, spans, kept) from texts (sha, t, spans): merged spans, and the bytes that are left."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], []]
            for sha, t, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = t.as_buffer().to_pybytes()
                merged: list[list[int]] = []
                for s in sorted((s["a"], s["b"]) for s in spans):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edge = [0, *(x for s in merged for x in s), len(raw)]
                out[0].append(sha)
                out[1].append([{"a": a, "b": b} for a, b in merged])
                out[2].append(b"".join(raw[a:b] for a, b in zip(edge[::2], edge[1::2])))
            pairs = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
            yield pa.record_batch([pa.array(out[0], pa.binary()), pa.array(out[1], pairs), pa.array(out[2], pa.binary())], names=["sha", "spans", "kept"])

    return held.select("sha", "t", "spans").mapInArrow(run, "sha binary, spans array<struct<a:long,b:long>>, kept binary")


def _slices(held: DataFrame) -> DataFrame:
    """(g, ch, lead, c, size): the bytes of the contexts listed in ``want`` for each text."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for t, want in zip(batch.column(0), batch.column(1).to_pylist()):
                raw = t.as_buffer().to_pybytes()
                for w in want:
                    for o, v in zip(out, (w["g"], w["ch"], w["p"] - w["lo"], raw[w["lo"] : w["hi"]], w["size"])):
                        o.append(v)
            yield pa.record_batch([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64()))], names=["g", "ch", "lead", "c", "size"])

    return held.select("t", "want").mapInArrow(run, "g long, ch binary, lead long, c binary, size long")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, group: int = GROUP) -> DataFrame:
    """``id_col``, ``n_bytes``, ``spans`` (removed runs of bytes), ``kept_sha256`` and ``copies`` for each row.

    A byte goes if a string of ``window`` bytes that covers it also starts anywhere else, in the same text or another.
    Null and empty texts have no bytes; repeated rows and rows with equal texts are copies of each other and lose all
    bytes if they have ``window`` of them. Null ids are kept. ``remaining`` gives the bytes that are left.
    Extra columns are not read. Each row's work depends on distinct texts only, so groups of copies cost nothing more.
    """
    ship(df.sparkSession)
    seen, results = _solve(df, id_col, text_col, window, gram, split, group)
    long, short = seen.where(F.col("n") >= window), seen.where(F.col("n") < window)
    copies = long.groupBy("sha").agg(F.count("*").alias("copies"))
    known = copies.join(results.select("sha", F.col("spans").alias("s"), F.sha2("kept", 256).alias("k")), "sha", "left")
    rows = spread_join(long.select("id", "sha", "n"), known, "sha", copies.withColumnRenamed("copies", "n"))
    whole = F.col("copies") > 1
    none = F.expr("cast(array() as array<struct<a:bigint,b:bigint>>)")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    found = rows.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_bytes"),
        F.when(whole, all_of_it).otherwise(F.coalesce("s", none)).alias("spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("k", F.lower(F.hex("sha")))).alias("kept_sha256"),
        "copies",
    )
    return found.unionByName(short.select(F.col("id").alias(id_col), F.col("n").alias("n_bytes"), none.alias("spans"), F.lower(F.hex("sha")).alias("kept_sha256"), F.lit(1).cast("long").alias("copies")))


def _solve(df: DataFrame, id_col: str, text_col: str, window: int, gram: int, split: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(id, sha, n, ..) of all rows, and (sha, spans, kept) of the texts without copies that lose bytes."""
    seen = stored(_prepared(df, id_col, text_col, window, gram), "seen")
    short = F.xxhash64("sha")
    texts = seen.where(F.col("n") >= window).groupBy("sha").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("grams").alias("grams"), F.first("twice").alias("twice"))
    texts = stored(texts.select("sha", "id", "copies", short.alias("k"), "grams", "twice"), "texts")
    often = texts.select(F.explode(F.concat("grams", "twice")).alias("g")).groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    wanted = texts.select("k", F.explode("grams").alias("g")).join(often, "g").groupBy("k").agg(F.collect_list("g").alias("grams"))
    own = texts.select("sha", "id", "copies", "k").join(wanted, "k").select("sha", "id", "copies", "grams")
    whole = _texts(df, id_col, text_col).withColumn("sha", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    held = stored(whole.join(own.withColumnRenamed("id", "i"), (whole["sha"] == own["sha"]) & whole["id"].eqNullSafe(F.col("i"))).select(own["sha"], "copies", "grams", F.col("t").cast("binary").alias("t")), "held")
    found = stored(_contexts(held, window, gram), "contexts")
    # a context's digest covers its bytes and the anchor's place, hence the gram as well
    kinds = found.groupBy("ch").agg(F.first("g").alias("g"), F.sum("m").alias("m"), F.count("*").alias("n"), F.min(F.struct("sha", "p", "lo", "hi")).alias("one"))
    kinds = stored(kinds.select("g", "ch", "m", "n", "one.*"), "kinds")
    several = kinds.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    chosen = spread_join(kinds.select("g", "ch", "sha", "p", "lo", "hi"), several, "g", several.withColumnRenamed("size", "n"), "inner")
    want = chosen.groupBy("sha").agg(F.collect_list(F.struct("g", "ch", "p", "lo", "hi", "size")).alias("want"))
    slices = stored(_slices(held.join(want, "sha")), "slices")
    parts = stored(_split(slices.where(F.col("size") > split), window, gram, min(STEP, max(1, (window - gram) // 3))), "parts")
    sizes = stored(parts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    parts = spread_join(parts, sizes, "g", sizes, "inner")
    covered = _compared(slices.where(F.col("size") <= split).unionByName(parts.where(F.col("n") <= group).drop("n"), True), window).select("ch", "l", "r")
    if not sizes.where(F.col("n") > group).isEmpty():
        covered = covered.unionByName(_counted(parts.where(F.col("n") > group), window))
    covered = covered.groupBy("ch").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    known = kinds.select("ch", F.when(F.col("m") > 1, True).alias("whole")).join(covered, "ch", "left").where("whole or r is not null")
    hit = spread_join(found.select("ch", "sha", "p", "lo", "hi"), known, "ch", kinds.select("ch", "n"), "inner")
    hit = hit.select("sha", F.when(F.col("whole"), F.col("lo")).otherwise(F.col("p") - F.col("l")).alias("a"), F.when(F.col("whole"), F.col("hi")).otherwise(F.col("p") + F.col("r")).alias("b"))
    spans = hit.groupBy("sha").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    results = stored(_cut(held.where("copies = 1").join(spans, "sha")), "results")
    return seen, results


def remaining(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, split: int = SPLIT, group: int = GROUP) -> DataFrame:
    """``id_col`` and ``kept`` (binary): the bytes that ``remove_repeats`` leaves of each row's text."""
    ship(df.sparkSession)
    seen, results = _solve(df, id_col, text_col, window, gram, split, group)
    copied = seen.where(F.col("n") >= window).groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1")
    rows = _texts(df, id_col, text_col).withColumn("sha", F.unhex(F.sha2(F.col("t").cast("binary"), 256)))
    rows = spread_join(rows, copied, "sha", seen.groupBy("sha").agg(F.count("*").alias("n"))).join(results.select("sha", "kept"), "sha", "left")
    return rows.select(F.col("id").alias(id_col), F.when(F.col("copies") > 1, F.lit("").cast("binary")).otherwise(F.coalesce("kept", F.col("t").cast("binary"))).alias("kept"))


def digests(df: DataFrame) -> DataFrame:
    """What the query returns of ``remove_repeats``."""
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return df.select("doc_id", "n_bytes", n.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
