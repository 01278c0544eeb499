"""Chat formatting, in DataFrame operations only.

Records come in many layouts. The hash of a record's nested field paths (its fingerprint) selects a
declarative mapping that turns it into canonical turns of role and text. A template then writes
turns as one string, with control strings inside texts escaped reversibly, and marks which turns count
for the loss.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns: `paths` are the fields it has, `turns` a SQL expression over them.

    per_row: the layout has one row per turn; `turns` then gives (conversation, order, role, text).
    """

    name: str
    paths: tuple[str, ...]
    turns: str
    per_row: bool = False


#: Layouts of records; a record with the fields of several takes the first.
MAPPINGS = (
    Mapping("turn rows", ("conv_id", "role", "text", "turn"), "struct(conv_id as conv, turn as at, role, text)", True),
    Mapping("messages", ("messages[].content", "messages[].role"), "transform({messages}, m -> struct(m.role as role, m.content as text))"),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), "transform({conversations}, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"),
    Mapping("instruction with input", ("input", "instruction", "output"), "array(struct('user' as role, concat_ws('\\n\\n', nullif({instruction}, ''), nullif({input}, '')) as text), struct('assistant' as role, {output} as text))"),
    Mapping("instruction", ("instruction", "output"), "array(struct('user' as role, {instruction} as text), struct('assistant' as role, {output} as text))"),
    Mapping("prompt and response", ("prompt", "response"), "array(struct('user' as role, {prompt} as text), struct('assistant' as role, {response} as text))"),
    Mapping("prompt and completion", ("completion", "prompt"), "array(struct('user' as role, {prompt} as text), struct('assistant' as role, {completion} as text))"),
    Mapping("question and answer", ("answer", "question"), "array(struct('user' as role, {question} as text), struct('assistant' as role, {answer} as text))"),
)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of a schema's leaves: a.b for structs, a[].b for arrays."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def select_mapping(paths: Iterable[str], mappings: Sequence[Mapping] = MAPPINGS) -> Mapping | None:
    """By fingerprint; records with more fields than a layout names are matched by the fields it needs."""
    paths = set(paths)
    by_print = {fingerprint(m.paths): m for m in mappings}
    return by_print.get(fingerprint(paths)) or next((m for m in mappings if paths.issuperset(m.paths)), None)


#: What a JSON record may have, of all mappings that have a record per conversation.
_JSON = "struct<messages:array<struct<role:string,content:string>>,conversations:array<struct<`from`:string,value:string>>,instruction:string,input:string,output:string,prompt:string,response:string,completion:string,question:string,answer:string>"


def json_fingerprint(record: Column, mappings: Sequence[Mapping] = MAPPINGS) -> Column:
    """Each JSON record's fingerprint: the hash of the paths it has, of those that mappings know.

    A path is there if its top field is, and for a[].b if some element has b.
    """
    known = sorted({p for m in mappings if not m.per_row for p in m.paths})
    # one wildcard query per path of an array; null if there is none
    has = lambda p: F.get_json_object(record, "$." + p.replace("[]", "[*]")).isNotNull()
    there = F.filter(F.array(*[F.when(has(p), F.lit(p)) for p in known]), lambda x: x.isNotNull())
    return F.substring(F.sha2(F.concat_ws("\n", there), 256), 1, 16)


def json_turns(records: DataFrame, id_col: str = "conv_id", record_col: str = "record", mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """JSON records of any known layouts to (conv, layout, turns).

    The fingerprint selects the mapping; a fingerprint of no single layout (a record with the fields of
    several, or with nulls) is resolved by the first layout whose fields are all there. Records of no
    known layout, and those that are no JSON, get layout null and no turns. Null texts are empty.
    """
    usable = [m for m in mappings if not m.per_row]
    df = records.select(F.col(id_col).alias("conv"), json_fingerprint(F.col(record_col), mappings).alias("_fp"), F.from_json(F.col(record_col), _JSON).alias("_r"), F.col(record_col).alias("_j"))
    known = sorted({p for m in usable for p in m.paths})
    prints = {fingerprint(m.paths): m for m in usable}
    expr = lambda m: F.expr(m.turns.format(**{p.split("[")[0].split(".")[0]: f"_r.{p.split('[')[0].split('.')[0]}" for p in known}))
    needs = lambda m: [F.get_json_object("_j", "$." + p.replace("[]", "[*]")).isNotNull() for p in m.paths]
    layout = turns = None
    for m, test in [(m, F.col("_fp") == fp) for fp, m in prints.items()] + [(m, _all(needs(m))) for m in usable]:
        layout = F.when(test, m.name) if layout is None else layout.when(test, m.name)
    for m in usable:
        turns = F.when(F.col("layout") == m.name, expr(m)) if turns is None else turns.when(F.col("layout") == m.name, expr(m))
    return df.withColumn("layout", layout).select("conv", "layout", F.coalesce(turns, F.array()).cast(TURNS).alias("turns"))


def _all(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def turns_of(df: DataFrame, mappings: Sequence[Mapping] = MAPPINGS, fields: Sequence[str] | None = None) -> DataFrame:
    """A table of any known layout to rows (conv, at, role, text), one per turn.

    The mapping is selected by the fingerprint of the table's field paths (or of `fields` alone, where a
    table has more). For layouts with a record per row, conv is the column conv_id, or null.
    """
    m = select_mapping(fields or field_paths(df.schema), mappings)
    if m is None:
        raise ValueError(f"no mapping for the fields {field_paths(df.schema)}")
    if m.per_row:
        return df.select(F.expr(m.turns).alias("t")).select("t.*")
    tops = {p.split("[")[0].split(".")[0] for p in m.paths}
    conv = F.col("conv_id") if "conv_id" in df.columns else F.lit(None).cast("long")
    return df.select(conv.alias("conv"), F.posexplode(F.expr(m.turns.format(**{t: t for t in tops}))).alias("at", "t")).select("conv", F.col("at").cast("long").alias("at"), "t.role", "t.text")


def escape(text: Column) -> Column:
    """Puts a backslash between < and | (and after any backslashes there): no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role is one line: its line ends, and the percent signs that mark them, are escaped too."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chat(turns: DataFrame, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """Rows (conv, at, role, text) to one row per conversation: conv, formatted, n_turns, loss_mask, loss_spans.

    Turns are in order of at (null first), then role, then text; null roles and texts are empty; repeated
    rows are turns of their own. loss_mask tells for each turn whether it counts for the loss;
    loss_spans are those texts' places in formatted (start from 0, and end, in code points). A conversation
    is one record of the output, and so is put together in one task; a null conv is one conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv", "at", role.alias("role"), text.alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("head", head).withColumn("body", escape(F.col("text"))).withColumn("loss", F.col("role").isin(*loss_roles))
    size = F.length("head") + F.length("body") + F.lit(len(END) + 1)
    order = Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("i", F.row_number().over(order)).withColumn("begin", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size + F.length("head"))
    span = F.when(F.col("loss"), F.struct(F.col("begin").alias("start"), (F.col("begin") + F.length("body")).alias("end")))
    part = F.struct("i", F.concat("head", "body", F.lit(f"{END}\n")).alias("s"), "loss", span.alias("span"))
    return (
        rows.groupBy("conv")
        .agg(F.array_sort(F.collect_list(part)).alias("p"))
        .select(
            "conv", F.concat_ws("", F.col("p.s")).alias("formatted"), F.size("p").cast("long").alias("n_turns"), F.col("p.loss").alias("loss_mask"),
            F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: the template and its escapes undone."""
    parts = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda s: s != "")
    head = lambda s: F.substring_index(s, "\n", 1)
    return F.transform(
        parts,
        lambda s: F.struct(
            unescape_role(F.substr(head(s), F.lit(len(START) + 1))).alias("role"),
            unescape(F.substr(s, F.length(head(s)) + 2)).alias("text"),
        ),
    )
