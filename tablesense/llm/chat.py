"""Chat formatting with typed content parts (operator 8), DataFrames only.

A message row has a conversation, a turn, a role and an array of parts
``struct<kind, text, ref, units>``. A visitor turns each part into its place
in the output: text parts are escaped text, image, audio, document and other
parts are numbered placeholders; each attachment's reference and expanded
token count are recorded. The template of a turn is

    ### <role>: <part><|+|><part>...</turn>\\n

Inside texts and roles a backslash is doubled and every control string is
broken by a backslash after its first character, so no control string stands
in an escaped text, and ``unescape`` restores it exactly.

The rows of one conversation meet in one task, as its text is one value; both
the window and the grouping use that one shuffle.

Defined results: a null text is empty, a null role the empty role; rows are
ordered by turn (null first), rows of equal turn by role and content; repeated
rows are turns of their own; rows with a null conversation form one
conversation; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, MARK, JOIN = "### ", "</turn>\n", "<|", "<|+|>"
CONTROL = (OPEN, "</turn>", MARK)
PART = "struct<kind:string,text:string,ref:string,units:bigint>"

# Expanded tokens of one unit: an image tile, a second of audio, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 700}
OTHER_TOKENS = 100


def escape(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\", r"\\\\")
    for c in CONTROL:
        rest = "".join("\\" + x if x in "|+\\" else x for x in c[1:])
        out = F.regexp_replace(out, f"{c[0]}(?={rest})", c[0] + r"\\")
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(F.coalesce(role, F.lit(""))), ":", r"\\:")


class PartVisitor:
    """What becomes of a part; ``n`` is its number among the conversation's
    attachments. One method per kind, each an expression of the part."""

    def text(self, part: Column) -> Column:
        return escape(F.coalesce(part["text"], F.lit("")))

    def attachment(self, kind: Column, n: Column) -> Column:
        return F.concat(F.lit(MARK), kind, F.lit(" "), n.cast("string"), F.lit("|>"))

    def is_text(self, part: Column) -> Column:
        return F.coalesce(part["kind"] == "text", part["ref"].isNull() & part["text"].isNotNull(), F.lit(False))

    def kind(self, part: Column) -> Column:
        return F.when(part["kind"].isin(*UNIT_TOKENS), part["kind"]).otherwise(F.lit("file"))

    def tokens(self, part: Column) -> Column:
        units = F.greatest(F.coalesce(part["units"], F.lit(1)), F.lit(0))
        out = F.when(self.is_text(part), F.coalesce(F.regexp_count(part["text"], F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)))
        for k, n in UNIT_TOKENS.items():
            out = out.when(part["kind"] == k, units * n)
        return out.otherwise(units * OTHER_TOKENS).cast("long")

    def visit(self, part: Column, n: Column) -> Column:
        return F.when(self.is_text(part), self.text(part)).otherwise(self.attachment(self.kind(part), n))


def text_part(text: Column) -> Column:
    """A one-part content array."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def chat_format(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                parts: str = "parts", loss_role: str = "assistant", visitor: PartVisitor | None = None) -> DataFrame:
    """One row per conversation: ``conv``, formatted, n_turns, loss_spans
    array<struct<start,length>> (code points, from 1; text parts of
    ``loss_role``), attachments array<struct<n,kind,ref,turn_no,tokens>>,
    n_tokens (expanded)."""
    v = visitor or PartVisitor()
    rows = messages.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.filter(F.coalesce(F.col(parts).cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>")),
                 lambda p: p.isNotNull()).alias("parts"))
    rows = rows.withColumn("attached", F.filter("parts", lambda p: ~v.is_text(p)))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", F.to_json("parts"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("turn_no", F.row_number().over(order))
            .withColumn("base", F.coalesce(F.sum(F.size("attached")).over(before), F.lit(0))))
    nth = lambda i: F.col("base") + F.size(F.filter(F.slice("parts", F.lit(1), i), lambda p: ~v.is_text(p))) + 1
    rows = (rows.withColumn("pieces", F.transform("parts", lambda p, i: v.visit(p, nth(i))))
            .withColumn("head", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(": ")))
            .withColumn("line", F.concat("head", F.array_join("pieces", JOIN), F.lit(CLOSE))))
    rows = rows.withColumn("start", F.coalesce(F.sum(F.char_length("line")).over(before), F.lit(0))
                           + F.char_length("head") + 1)
    lens = F.transform("pieces", lambda p: F.char_length(p).cast("long"))
    skip = lambda i: F.aggregate(F.slice(lens, F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x)
    span = F.transform("parts", lambda p, i: F.struct(
        (v.is_text(p) & (F.col("role") == loss_role)).alias("loss"),
        (F.col("start") + skip(i) + i * len(JOIN)).cast("long").alias("start"),
        F.char_length(F.col("pieces")[i]).cast("long").alias("length")))
    attach = F.transform("attached", lambda p, i: F.struct(
        (F.col("base") + i + 1).cast("long").alias("n"), v.kind(p).alias("kind"), p["ref"].alias("ref"),
        F.col("turn_no").alias("turn_no"), v.tokens(p).alias("tokens")))
    one = rows.select("conv", F.struct(
        "turn_no", "line",
        F.transform(F.filter(span, lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("spans"),
        attach.alias("attach"),
        F.aggregate(F.transform("parts", v.tokens), F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens")).alias("r"))
    got = one.groupBy("conv").agg(F.array_sort(F.collect_list("r")).alias("r"))
    return got.select(
        F.col("conv").alias(conv), F.array_join(F.col("r.line"), "").alias("formatted"),
        F.size("r").cast("long").alias("n_turns"), F.flatten("r.spans").alias("loss_spans"),
        F.flatten("r.attach").alias("attachments"),
        F.aggregate("r.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation of
    text parts."""
    lines = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    head = r"(?s)\A### ((?:[^:\\]|\\.)*+): (.*)\z"
    return F.transform(lines, lambda x: F.struct(
        unescape(F.regexp_extract(x, head, 1)).alias("role"),
        unescape(F.regexp_extract(x, head, 2)).alias("text")))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss spans, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(
        F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), "")
