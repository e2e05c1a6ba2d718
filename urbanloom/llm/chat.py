"""Chat formatting: heterogeneous layouts become canonical turns, turns become marked text with a loss mask.

A layout is the tree of a record's field names; its fingerprint is the hash of that tree. The fingerprint selects a
declarative mapping from fields to turns: for typed tables when the plan is made, for JSON rows by row. All of it is
DataFrame expressions.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
#: Layouts (field names sorted, [] for lists) and how their fields become turns. "rows": one turn a row. "list": the
#: turns are a list. "fields": (role, field) in order; an empty optional field gives no turn.
MAPPINGS = (
    {"layout": "{conv_id,role,text,turn}", "kind": "rows", "key": "conv_id", "order": "turn", "role": "role", "text": "text"},
    {"layout": "{messages:[{content,role}]}", "kind": "list", "list": "messages", "role": "role", "text": "content"},
    {"layout": "{conversations:[{from,value}]}", "kind": "list", "list": "conversations", "role": "from", "text": "value"},
    {"layout": "{turns:[{role,text}]}", "kind": "list", "list": "turns", "role": "role", "text": "text"},
    {"layout": "{completion,prompt}", "kind": "fields", "turns": (("user", "prompt"), ("assistant", "completion"))},
    {"layout": "{prompt,response}", "kind": "fields", "turns": (("user", "prompt"), ("assistant", "response"))},
    {"layout": "{answer,question}", "kind": "fields", "turns": (("user", "question"), ("assistant", "answer"))},
    {"layout": "{instruction,output}", "kind": "fields", "turns": (("user", "instruction"), ("assistant", "output"))},
    {"layout": "{input,instruction,output}", "kind": "fields", "turns": (("system", "instruction"), ("user", "input"), ("assistant", "output")), "optional": ("input",)},
    {"layout": "{prompt,response,system}", "kind": "fields", "turns": (("system", "system"), ("user", "prompt"), ("assistant", "response")), "optional": ("system",)},
)
#: Other names of the roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def fingerprint(layout: str) -> str:
    return hashlib.sha256(layout.encode()).hexdigest()[:16]


_BY_PRINT = {fingerprint(m["layout"]): m for m in MAPPINGS}


def layout_of(kind: T.DataType) -> str:
    """The layout of a typed record."""
    if isinstance(kind, T.StructType):
        return "{" + ",".join(f.name + (f":{x}" if (x := layout_of(f.dataType)) else "") for f in sorted(kind, key=lambda f: f.name)) + "}"
    return f"[{layout_of(kind.elementType)}]" if isinstance(kind, T.ArrayType) else ""


def _layout_of_variant(v: Column) -> Column:
    """The layout of a JSON value, from its schema string."""
    s = F.regexp_replace(F.schema_of_variant(v), r"DECIMAL\(\d+,\d+\)|[A-Z_]+(?=[,>]|$)", "")
    for a, b in ((r"OBJECT<", "{"), (r"ARRAY<", "["), (r"\s", "")):
        s = F.regexp_replace(s, a, b)
    # closing marks: objects and lists close in reverse order, so the innermost are rewritten first
    for _ in range(8):
        s = F.regexp_replace(s, r"\{([^<>{}\[\]]*(?:\[[^<>]*\]|\{[^<>]*\}|[^<>{}\[\]])*)>", "{$1}")
        s = F.regexp_replace(s, r"\[([^<>{}\[\]]*(?:\{[^<>]*\}|\[[^<>]*\]|[^<>{}\[\]])*)>", "[$1]")
    return F.regexp_replace(s, r":(?=[,}\]]|$)", "")


def _role(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for name, role in ROLES.items():
        out = F.when(F.lower(c) == name, role).otherwise(out)
    return out


def turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``id_col``, ``fingerprint`` and ``turns`` of rows whose records are JSON texts of any layout.

    Rows that are null, no JSON or of an unknown layout have null turns and keep their fingerprint (null without
    JSON), so nothing is dropped. A record of a known layout with a null list has no turns.
    """
    v = F.try_parse_json(F.col(json_col))
    rows = df.select(id_col, v.alias("_v")).withColumn("fingerprint", F.substring(F.sha2(_layout_of_variant(F.col("_v")), 256), 1, 16))
    out = F.lit(None).cast(TURNS)
    for key, m in _BY_PRINT.items():
        if m["kind"] == "list":
            kind = f"array<struct<`{m['role']}`:string,`{m['text']}`:string>>"
            found = _listed(F.coalesce(F.try_variant_get("_v", f"$.{m['list']}", kind), F.expr(f"cast(array() as {kind})")), m)
        elif m["kind"] == "fields":
            found = _fields(m, lambda f: F.try_variant_get("_v", f"$.{f}", "string"))
        else:
            continue
        out = F.when(F.col("fingerprint") == key, found).otherwise(out)
    return rows.select(id_col, "fingerprint", out.alias("turns"))


def _listed(items: Column, m: dict) -> Column:
    return F.transform(items, lambda x: F.struct(_role(x[m["role"]]).alias("role"), F.coalesce(x[m["text"]], F.lit("")).alias("text")))


def _fields(m: dict, get) -> Column:
    turns = [F.struct(F.lit(role).alias("role"), F.coalesce(get(f), F.lit("")).alias("text")) for role, f in m["turns"]]
    kept = [F.when(t["text"] != "", t) if f in m.get("optional", ()) else t for t, (_, f) in zip(turns, m["turns"])]
    return F.array_compact(F.array(*kept))


def canonical_turns(df: DataFrame, id_col: str | None = None) -> DataFrame:
    """(conv_id, pos, role, text): canonical turns of a typed table, by the fingerprint of its columns but ``id_col``.

    An unknown layout is an error when the plan is made. Null roles and texts are empty. Turns of a rows layout are
    numbered by the order column (nulls first), ties by role and text, and keep their roles' names; rows with a null
    key are one conversation.
    """
    schema = T.StructType([f for f in df.schema if f.name != id_col])
    m = _BY_PRINT.get(fingerprint(layout_of(schema)))
    if m is None:
        raise ValueError(f"no mapping for the layout {layout_of(schema)}")
    if m["kind"] == "rows":
        rows = df.select(F.col(m["key"]).alias("conv_id"), F.col(m["order"]).alias("_o"), F.coalesce(F.col(m["role"]), F.lit("")).alias("role"), F.coalesce(F.col(m["text"]), F.lit("")).alias("text"))
        return rows.select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("_o", "role", "text")).alias("pos"), "role", "text")
    if m["kind"] == "list":
        turns = _listed(F.col(m["list"]), m)
    else:
        turns = _fields(m, F.col)
    key = F.col(id_col) if id_col else F.monotonically_increasing_id()
    return df.select(key.alias("conv_id"), F.posexplode(turns).alias("_p", "_t")).select("conv_id", (F.col("_p") + 1).alias("pos"), "_t.role", "_t.text")


def escape(c: Column) -> Column:
    """No control string and no line end of a role survives in an escaped text; ``unescape`` gives it back."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&#10;"), F.lit("\n")), F.lit("&amp;"), F.lit("&"))


def format_chat(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) from canonical turns: one text for each conversation, and the code-point spans
    (start, end exclusive) of the texts that are trained on, in order."""
    rows = turns.select("conv_id", "pos", F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")).alias("r"), escape(F.col("text")).alias("t"), F.col("role").isin(*trained).alias("loss"))
    rows = rows.withColumn("seg", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END + "\n")))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.char_length("seg").cast("long")).over(before), F.lit(0)) + len(START) + 1 + F.char_length("r")
    rows = rows.withColumn("start", at).withColumn("end", F.col("start") + F.char_length("t"))
    all_of_it = F.array_sort(F.collect_list(F.struct("pos", "seg", "start", "end", "loss"))).alias("x")
    return rows.groupBy("conv_id").agg(all_of_it).select(
        "conv_id",
        F.array_join(F.transform("x", lambda x: x["seg"]), "").alias("formatted"),
        F.transform(F.filter("x", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, in_loss) from (conv_id, formatted, loss_spans), in time linear in the text."""
    segs = formatted.select("conv_id", F.posexplode(F.split("formatted", r"<\|im_start\|>")).alias("pos", "seg")).where("pos > 0")
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    size = F.char_length("seg").cast("long") + len(START)
    segs = segs.withColumn("r", F.substring_index("seg", "\n", 1)).withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + len(START) + 1 + F.char_length("r"))
    body = F.substr(F.col("seg"), F.char_length("r") + 2, F.char_length("seg") - F.char_length("r") - 1 - len(END + "\n"))
    segs = segs.withColumn("t", body).withColumn("to", F.col("at") + F.char_length("t"))
    spans = formatted.select(F.col("conv_id").alias("c"), F.explode("loss_spans").alias("s")).select("c", F.col("s.start").alias("a"), F.col("s.end").alias("b"))
    joined = segs.join(spans, segs["conv_id"].eqNullSafe(spans["c"]) & (F.col("at") == F.col("a")) & (F.col("to") == F.col("b")), "left")
    return joined.select("conv_id", "pos", unescape(F.col("r")).alias("role"), unescape(F.col("t")).alias("text"), F.col("a").isNotNull().alias("in_loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the query returns, from what is read back."""
    turns = read_back(formatted).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "role", "text", "in_loss"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("x", lambda x: x["in_loss"]), lambda x: x["text"]), "")
    sizes = formatted.select(F.col("conv_id").alias("c"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    rows = turns.join(sizes, turns["conv_id"].eqNullSafe(sizes["c"]))
    return rows.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
