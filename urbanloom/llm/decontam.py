"""Benchmark decontamination: one Aho-Corasick automaton over all windows of the normalised test items.

Texts are normalised to lower-case ASCII letters and words. The automaton's symbols are words of the test items, each as
a few digits whose ranges differ by place, so that a match begins and ends at words and no state has many ways out; a
word that no item has is a symbol that no window has. A text is scanned once; hits are word ranges, which map back to
code-point spans of the original.
"""

from __future__ import annotations

import re
import uuid
from itertools import chain, repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanloom.core.tables import stored
from urbanloom.llm import kernels as K
from urbanloom.session import ship

#: Fixed by the contract: what separates words, and how many words a window has.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Bytes of test items that one automaton holds (about 150 bytes of memory each); larger sets are scanned part by part.
AUTOMATON_BYTES = 1 << 20
#: Words of an item that are kept together; longer items are cut into slices that overlap by a window less a word.
SLICE = 5000
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else (32 if b in SEPARATORS else b) for b in range(256))
_BUILT: dict[str, object] = {}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


class Windows:
    """The automaton over the windows of (item key, words) pairs, and which items have each window."""

    def __init__(self, items: list[tuple], window: int):
        import ahocorasick

        numbers: dict[bytes, int] = {}
        for _, words in items:
            for w in words:
                numbers.setdefault(w, len(numbers))
        self.digits = 1
        while 256**self.digits < len(numbers):
            self.digits += 1
        self.symbols = {w: tuple(256 * k + (n >> (8 * k) & 255) for k in range(self.digits)) for w, n in numbers.items()}
        self.unknown = (256 * self.digits,) * self.digits
        owners: dict[tuple, dict] = {}
        for key, words in items:
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if words else 0):
                owners.setdefault(tuple(words[i : i + size]), {})[key] = None
        self.built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        # windows of the same items share a number, so a text takes up each set of items once
        groups: dict[tuple, int] = {}
        for words, keys in owners.items():
            group = groups.setdefault(tuple(keys), len(groups))
            self.built.add_word(tuple(chain.from_iterable(map(self.symbols.__getitem__, words))), (len(words), group))
        self.groups = list(groups)
        if owners:
            self.built.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Word ranges hit (merged, end exclusive) and the keys of items of which a window occurs."""
        if not self.groups or not words:
            return [], set()
        text = tuple(chain.from_iterable(map(self.symbols.get, words, repeat(self.unknown))))
        spans, seen = [], set()
        for end, (size, group) in self.built.iter(text):
            last = (end + 1) // self.digits
            spans.append((last - size, last))
            seen.add(group)
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        return merged, {k for g in seen for k in self.groups[g]}


def windows_of(name: str, sent, window: int) -> Windows:
    """The automaton over a broadcast of items; a Python worker builds it once."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows([(k, t.split()) for k, t in sent.value], window)
    return _BUILT[name]


def _slices(rows: DataFrame, window: int) -> DataFrame:
    """(k, t): the items' (k, t) normalised words, at most SLICE windows a row."""

    def run(batches):
        for batch in batches:
            keys, parts = [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(t.as_buffer().to_pybytes())
                for a in range(0, max(len(words) - window + 1, min(len(words), 1)), SLICE):
                    keys.append(k)
                    parts.append(b" ".join(words[a : a + SLICE + window - 1]))
            yield pa.record_batch([pa.array(keys, pa.string()), pa.array(parts, pa.binary())], names=["k", "t"])

    return rows.mapInArrow(run, "k string, t binary")


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, ``n_words``, ``hits`` (word ranges), ``spans`` (code points of the original) and ``items`` for each row.

    Null and empty texts have no words. Items without words have no windows; equal items each count, and rows that
    repeat an item id count as one item; null item ids are left out. Items are read in parts of about half of
    ``AUTOMATON_BYTES`` of text, the bound of what is broadcast at a time (items are cut into slices first, so none is
    larger); each part scans all texts, which are written with a row key by which the parts' hits are merged, so that no
    item or row is left out however many there are, and rows that repeat or lack an id stay apart.
    Extra columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    rows = benchmark.select(F.col(item_col).cast("string").alias("k"), F.col(item_text_col).cast("string").cast("binary").alias("t")).where("k is not null and t is not null")
    rows = stored(_slices(rows, window).distinct(), "items")
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    n_parts = int(2 * total // AUTOMATON_BYTES) + 1
    names = [id_col, *(c for c in carry if c != id_col)]
    passed = names
    if n_parts > 1:
        df = stored(df.select(*dict.fromkeys([*names, text_col])).withColumn(_ROW, F.monotonically_increasing_id()), "texts")
        passed = [_ROW]
    kept = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in passed)
    schema = f"{kept}, n_words long, hits array<struct<a:int,b:int>>, spans array<struct<a:int,b:int>>, items array<string>"
    texts = df.select(*passed, F.col(text_col).cast("string").alias("_text_"))

    def part(k: int) -> DataFrame:
        own = rows if n_parts == 1 else rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n_parts)) == k)
        sent = spark.sparkContext.broadcast([(r["k"], bytes(r["t"])) for r in own.collect()])
        name = uuid.uuid4().hex

        def run(batches):
            windows = windows_of(name, sent, window)
            for batch in batches:
                for a, data, offs in K.chunks(batch.column(len(passed))):
                    counts, hits, spans, items = [], [], [], []
                    for i in range(len(offs) - 1):
                        text = data[offs[i] : offs[i + 1]].tobytes()
                        words = words_of(text)
                        found, keys = windows.scan(words)
                        counts.append(len(words))
                        hits.append([{"a": x, "b": y} for x, y in found])
                        where = [m.span() for m in WORD.finditer(text.decode("utf-8").translate(_LOWER))] if found else []
                        spans.append([{"a": where[x][0], "b": where[y - 1][1]} for x, y in found])
                        items.append(sorted(keys))
                    pairs = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
                    yield pa.record_batch([*(c.slice(a, len(offs) - 1) for c in batch.columns[: len(passed)]), pa.array(counts, pa.int64()), pa.array(hits, pairs), pa.array(spans, pairs), pa.array(items, pa.list_(pa.string()))], names=[*passed, "n_words", "hits", "spans", "items"])

        return texts.mapInArrow(run, schema)

    if n_parts == 1:
        return part(0)
    return df.join(_merge([part(k) for k in range(n_parts)]), _ROW).select(*names, "n_words", "hits", "spans", "items")


_LOWER = {i: i + 32 for i in range(65, 91)}
#: The row key that texts are written with when a benchmark has several parts.
_ROW = "_row_"


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Joins what the parts of a large benchmark give for each row key; ranges that touch become one, and so do their spans."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p.where("size(hits) > 0"))
    zipped = F.arrays_zip("hits", "spans")
    out = both.groupBy(_ROW).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list(zipped))).alias("m"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        wider = [F.struct(last[c]["a"].alias("a"), F.greatest(last[c]["b"], x[c]["b"]).alias("b")).alias(c) for c in ("hits", "spans")]
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(*wider)))
        return F.when((F.size(acc) > 0) & (x["hits"]["a"] <= last["hits"]["b"]), joined).otherwise(F.concat(acc, F.array(x)))

    none = F.expr("cast(array() as array<struct<hits:struct<a:int,b:int>,spans:struct<a:int,b:int>>>)")
    out = out.withColumn("m", F.aggregate("m", none, step))
    return out.select(_ROW, "n_words", F.col("m.hits").alias("hits"), F.col("m.spans").alias("spans"), "items")


def verdicts(df: DataFrame) -> DataFrame:
    """What the query returns of ``contamination``."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + (x["b"] - x["a"]).cast("long"))
    return df.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
