"""Chat formatting: records of different layouts become canonical turns, and turns one marked text with a loss mask.

A record's nested field paths (its parsed schema without scalar types) are hashed to a fingerprint; a table of declarative
mappings, keyed by the fingerprints of the layouts they are for, says where roles and texts are. Records with an unknown
fingerprint keep a null layout and give no turns.

The template writes a turn as ``<s>``, the role's mark, the text and ``</s>``. Inside texts and role names a backslash is
doubled and a control string gets one after its first character, so no control string is left and reading back is exact.
The loss mask lists the code point ranges of assistant texts.

Defined results: null texts and roles are empty; turns with equal numbers are ordered by role and text, null turns first; rows
without conversation id form one conversation. A conversation is one row of output, so its turns meet in one group. Extra
columns are not read.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Layouts. A list layout names the array and the fields of its elements; a flat one lists role and field in order.
# Fields after "?" may be missing.
LIST_LAYOUTS = {
    "messages": ("messages", "role", "content"),
    "shared": ("conversations", "from", "value"),
    "dialog": ("dialog", "speaker", "text"),
}
FLAT_LAYOUTS = {
    "instruction": (("system", "?system"), ("user", "instruction"), ("user", "?input"), ("assistant", "output")),
    "prompt": (("system", "?system"), ("user", "prompt"), ("assistant", "completion")),
    "response": (("system", "?system"), ("user", "prompt"), ("assistant", "response")),
    "question": (("system", "?system"), ("user", "question"), ("assistant", "answer")),
}
#: One message: the fields of its role and its text.
MESSAGE_LAYOUTS = {"message": ("role", "text"), "content": ("role", "content")}
# Other names of roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

CONTROL = r"([<\[])(/?(?:s>|INST\]|SYS\]|ROLE\]))"
SCALAR = r"(?<=[:<] ?)(?:DECIMAL\([^)]*\)|[A-Z_]+)(?=[,>]|$)"


# ---- layouts ---------------------------------------------------------------------------------------------


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths of a variant."""
    return F.xxhash64(F.regexp_replace(F.schema_of_variant(record), SCALAR, "_"))


def _skeletons() -> list[tuple[str, str]]:
    """Layouts with an example of each set of fields that they may have."""
    out = [(name, f'{{"{array}":[{{"{role}":"","{text}":""}}]}}') for name, (array, role, text) in LIST_LAYOUTS.items()]
    out += [(name, f'{{"{role}":"","{text}":""}}') for name, (role, text) in MESSAGE_LAYOUTS.items()]
    for name, fields in FLAT_LAYOUTS.items():
        loose = [f[1:] for _, f in fields if f[0] == "?"]
        firm = [f for _, f in fields if f[0] != "?"]
        for k in range(len(loose) + 1):
            for some in combinations(loose, k):
                out.append((name, "{" + ",".join(f'"{f}":""' for f in [*firm, *some]) + "}"))
    return out


def mappings(spark: SparkSession) -> DataFrame:
    """The registered layouts by fingerprint: a fixed number of rows."""
    rows = spark.createDataFrame(_skeletons(), "layout STRING, skeleton STRING")
    return rows.select("layout", fingerprint(F.parse_json("skeleton")).alias("fingerprint"))


def _text(value: Column, path: str) -> Column:
    return F.coalesce(F.variant_get(value, path, "string"), F.lit(""))


def _turn(role: Column, text: Column) -> Column:
    plain = role
    for other, name in ROLES.items():
        plain = F.when(role == other, F.lit(name)).otherwise(plain)
    return F.struct(plain.alias("role"), text.alias("text"))


def turns_of(record: Column, layout: Column) -> Column:
    """Canonical turns of a record, by its layout."""
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, (array, role, text) in LIST_LAYOUTS.items():
        each = F.variant_get(record, f"$.{array}", "array<variant>")
        out = F.when(layout == name, _listed(each, role, text)).otherwise(out)
    for name, (role, text) in MESSAGE_LAYOUTS.items():
        out = F.when(layout == name, F.array(_turn(_text(record, f"$.{role}"), _text(record, f"$.{text}")))).otherwise(out)
    for name, fields in FLAT_LAYOUTS.items():
        parts = [(_turn(F.lit(role), _text(record, f"$.{f.strip('?')}")), f) for role, f in fields]
        listed = F.array(*[F.when(F.variant_get(record, f"$.{f[1:]}", "string") != "", t) if f[0] == "?" else t for t, f in parts])
        out = F.when(layout == name, F.filter(listed, lambda t: t.isNotNull())).otherwise(out)
    return out


def _listed(each: Column, role: str, text: str) -> Column:
    return F.transform(each, lambda m: _turn(_text(m, f"$.{role}"), _text(m, f"$.{text}")))


def canonical(records: DataFrame, keys: list[str], record: str = "record") -> DataFrame:
    """``keys, layout, part, role, text``: one row per turn; a record of unknown layout is one row with nulls."""
    parsed = records.select(*keys, F.parse_json(record).alias("_record"))
    parsed = parsed.withColumn("fingerprint", fingerprint(F.col("_record")))
    known = parsed.join(F.broadcast(mappings(records.sparkSession)), "fingerprint", "left")  # a fixed table, a row a layout
    turns = known.select(*keys, "layout", F.posexplode_outer(turns_of(F.col("_record"), F.col("layout"))).alias("part", "_turn"))
    return turns.select(*keys, "layout", "part", "_turn.role", "_turn.text")


# ---- template --------------------------------------------------------------------------------------------


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _mark(role: Column) -> tuple[Column, Column]:
    """What stands before and after a role's text."""
    before = F.when(role == "system", "<s>[SYS]").when(role == "user", "<s>[INST]").when(role == "assistant", "<s>")
    after = F.when(role == "system", "[/SYS]</s>").when(role == "user", "[/INST]</s>").when(role == "assistant", "</s>")
    return before.otherwise(F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"))), after.otherwise("</s>")


def formatted(turns: DataFrame, conv: str = "conv_id", order: tuple[str, ...] = ("turn", "part", "role", "text")) -> DataFrame:
    """``conv, formatted, mask``: one text per conversation; the mask holds start and length of assistant texts."""
    before, after = _mark(F.col("role"))
    text = escape(F.col("text"))
    pieces = turns.withColumns({"_before": before, "_text": text, "_after": after})
    pieces = pieces.withColumn("_piece", F.concat("_before", "_text", "_after"))
    so_far = Window.partitionBy(conv).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumns({"_end": F.sum(F.length("_piece").cast("bigint")).over(so_far), "_at": F.row_number().over(so_far)})
    start = F.col("_end") - F.length("_after") - F.length("_text")
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.length("_text").cast("bigint").alias("length")))
    rows = pieces.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("_at", "_piece", span.alias("span")))).alias("rows"))
    return rows.select(
        conv,
        F.array_join(F.transform("rows", lambda r: r["_piece"]), "").alias("formatted"),
        F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("mask"),
    )


def read_back(text: Column) -> Column:
    """Turns (role, text) of a formatted text."""
    role = lambda p: (
        F.when(p.startswith("[SYS]"), "system").when(p.startswith("[INST]"), "user")
        .when(p.startswith("[ROLE]"), unescape(F.regexp_extract(p, r"(?s)^\[ROLE\](.*?)\[/ROLE\]", 1))).otherwise("assistant")
    )
    body = lambda p: (
        F.regexp_replace(F.regexp_replace(p, r"(?s)^(?:\[SYS\]|\[INST\]|\[ROLE\].*?\[/ROLE\])", ""), r"\[/(?:SYS|INST)\]\z", "")
    )
    parts = F.filter(F.split(text, "</s>"), lambda p: p != "")
    parts = F.transform(parts, lambda p: F.substr(p, F.lit(4)))
    return F.transform(parts, lambda p: F.struct(role(p).alias("role"), unescape(body(p)).alias("text")))


PROBE = "</s>[INST] ok [/INST]"


def op5_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text"
    )
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    both = rows.unionByName(probe)
    records = both.select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    out = formatted(canonical(records, ["conv_id", "turn"])).withColumn("turns", read_back(F.col("formatted")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform("mask", lambda m: unescape(F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


_ESCAPED = r"regexp_replace(replace({0}, '\', '\\'), '([<\[])(/?(?:s>|INST\]|SYS\]|ROLE\]))', '\1\\\2', 'g')"
ORACLE_OP5 = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS raw, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
t AS (SELECT conv_id, turn, CASE raw {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ROLES.items())} ELSE raw END AS role, text FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_ESCAPED.format("text")}) + 7 + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 0
      ELSE 13 + length({_ESCAPED.format("role")}) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
