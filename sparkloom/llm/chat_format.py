"""Chat formatting: layouts are told by a hash of their nested field paths, and mapped to turns by declaration.

A record's signature is its tree of field names, without the types of what they hold;
its fingerprint is the hash of that. Layouts declare where roles and texts lie, and which
fields may be missing, so the fingerprints that a layout has are known beforehand: a map
from fingerprint to layout picks the mapping of each record. JSON records show their tree
as a variant, typed records by which of their fields are not null.

The template marks each turn as `<|start|>role<|text|>words<|end|>`. Inside roles and
texts every control string gets a backslash after its first sign, and one that already
has backslashes there gets one more; taking one away again restores the text.

Everything is column expressions; no step's time grows faster than a conversation.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
#: Control strings of this template and of other common ones: <|word|>, <s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>.
_CONTROL = r"(\|\w+\|>|/?s>|/?INST\]|</?SYS>>)"
PLAIN, ESCAPED = rf"([<\[])(\\*){_CONTROL}", rf"([<\[])\\(\\*){_CONTROL}"
TURNS = "array<struct<role:string,text:string>>"
#: Roles by the names that layouts use.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where the turns of one kind of record lie.

    turns: path of a list of objects with a role and a text. Otherwise fields: pairs (path,
    role) in order, whose texts are one turn each; fields of the same role that follow each
    other are one turn, joined by an empty line. optional: further paths that may be there,
    and of the others those that may be missing.
    """

    name: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fields: tuple[tuple[str, str], ...] = ()
    optional: tuple[str, ...] = ()

    def paths(self) -> list[str]:
        return [f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"] if self.turns else [p for p, _ in self.fields]

    def signatures(self) -> list[str]:
        """Of all sets of paths that the layout may have."""
        fixed = [p for p in self.paths() if p not in self.optional]
        return [signature([*fixed, *some]) for n in range(len(self.optional) + 1) for some in itertools.combinations(self.optional, n) if fixed or some]


LAYOUTS = (
    Layout("turn rows", "turns", "role", "text", optional=("turns[].turn", "conv_id")),
    Layout("messages", "messages", "role", "content", optional=("messages[].content", "messages[].name", "id", "source", "messages[].weight")),
    Layout("from and value", "conversations", "from", "value", optional=("conversations[].value", "id", "source", "conversations[].weight")),
    Layout("instruction", fields=(("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant")), optional=("system", "input", "id", "source")),
    Layout("prompt and response", fields=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system", "id", "source")),
    Layout("prompt and completion", fields=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system", "id", "source")),
    Layout("question and answer", fields=(("system_prompt", "system"), ("context", "user"), ("question", "user"), ("answer", "assistant")), optional=("system_prompt", "context", "id", "source")),
)


def signature(paths: list[str]) -> str:
    """The tree of paths such as `messages[].role`, names in order: `{messages[{content,role>>>`."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
    return _tree(tree)


def _tree(tree: dict) -> str:
    def shown(part: str, below: dict) -> str:
        name, many = part.removesuffix("[]"), part.endswith("[]")
        return name + ("[" if many else "") + (_tree(below) if below else "") + (">" if many else "")

    return "{" + ",".join(shown(p, b) for p, b in sorted(tree.items())) + ">"


def json_signature(value: Column) -> Column:
    """Of a variant: its schema without types. Fields that hold null are not there."""
    shape = F.schema_of_variant(value)
    for old, new in ((r"(?<=[<,] ?)(`[^`]*`|\w+): VOID(, |(?=>))", ""), (r": (OBJECT<|ARRAY<)", "$1"), (r": [A-Z]+(\([0-9,]+\))?", ""), ("OBJECT<", "{"), ("ARRAY<", "["), (r", ", ","), (r",>", ">"), (r"\[[A-Z]+(\([0-9,]+\))?>", "[>")):
        shape = F.regexp_replace(shape, old, new)
    return shape


def typed_signature(fields: T.StructType, at) -> Column:
    """Of a typed record: its fields that are not null; those of a list's objects that some object has."""

    def shown(field: T.StructField) -> Column:
        value, kind = at(field.name), field.dataType
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.concat(F.lit(field.name), typed_signature(kind, value.getField)))
        if not isinstance(kind, T.ArrayType):
            return F.when(value.isNotNull(), F.lit(field.name))
        if not isinstance(kind.elementType, T.StructType):
            return F.when(value.isNotNull(), F.lit(f"{field.name}[>"))
        own = sorted(kind.elementType.fields, key=lambda f: f.name)
        some = lambda name: F.exists(value, lambda x: x[name].isNotNull())
        names = [F.when(some(f.name), F.lit(f.name)) for f in own]
        return F.when(value.isNotNull(), F.concat(F.lit(f"{field.name}[{{"), F.concat_ws(",", *names), F.lit(">>")))

    return F.concat(F.lit("{"), F.concat_ws(",", *[shown(f) for f in sorted(fields.fields, key=lambda f: f.name)]), F.lit(">"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


class ChatFormat:
    """Records of many layouts as turns, and turns as one text with a loss mask.

    Null texts and roles are empty. Records whose fingerprint no layout has keep null turns
    and a null layout, so that `fingerprints` can show what is missing; malformed JSON has
    neither, and an empty list of turns shows no fields, so it has no layout. A record without turns gives an empty text. Fields of an instruction layout
    that are null or empty give no turn. Repeated records are formatted each.
    """

    def __init__(self, layouts: tuple[Layout, ...] = LAYOUTS, learned: tuple[str, ...] = ("assistant",)):
        """learned: roles whose texts are under the loss mask."""
        self.layouts, self.learned = layouts, learned

    def _choice(self, shape: Column) -> Column:
        """The layout's place by its fingerprint; the first one that has it."""
        known: dict[str, int] = {}
        for k, layout in enumerate(self.layouts):
            for s in layout.signatures():
                known.setdefault(hashlib.md5(s.encode()).hexdigest(), k)
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.md5(shape))

    def _turns(self, layout: Layout, read) -> Column:
        clean = lambda x: F.coalesce(x, F.lit(""))
        named = lambda x: F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for pair in ROLES.items() for y in pair]), x), x)
        if layout.turns:
            return F.transform(read(layout.turns, f"array<struct<{layout.role}:string,{layout.text}:string>>"), lambda t: F.struct(named(clean(t[layout.role])).alias("role"), clean(t[layout.text]).alias("text")))
        out = []
        for role, own in itertools.groupby(layout.fields, key=lambda f: f[1]):
            text = F.concat_ws("\n\n", *[F.nullif(read(path, "string"), F.lit("")) for path, _ in own])
            out.append(F.when(text != "", F.struct(F.lit(role).alias("role"), text.alias("text"))))
        return F.array_compact(F.array(*out))

    def _canonical(self, df: DataFrame, shape: Column, read) -> DataFrame:
        choice = F.col("_layout")
        turns, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
        for k, layout in enumerate(self.layouts):
            turns, name = F.when(choice == k, self._turns(layout, read).cast(TURNS)).otherwise(turns), F.when(choice == k, F.lit(layout.name)).otherwise(name)
        df = df.withColumn("_shape", shape).withColumn("_layout", self._choice(F.col("_shape")))
        return df.select("*", F.md5("_shape").alias("fingerprint"), F.col("_shape").alias("signature"), name.alias("layout"), turns.alias("turns"))

    def from_json(self, df: DataFrame, record: str = "record", keys: tuple[str, ...] = ()) -> DataFrame:
        """keys, fingerprint, signature, layout and turns of JSON records."""
        own = df.select(*[F.col(k) for k in keys], F.try_parse_json(F.col(record).cast("string")).alias("_value"))
        read = lambda path, kind: F.try_variant_get("_value", f"$.{path}", kind)
        return self._canonical(own, json_signature(F.col("_value")), read).select(*keys, "fingerprint", "signature", "layout", "turns")

    def from_struct(self, df: DataFrame, record: str = "record", keys: tuple[str, ...] = ()) -> DataFrame:
        """The same of typed records."""
        kind = df.schema[record].dataType
        own = df.select(*[F.col(k) for k in keys], F.col(record).alias("_value"))

        def read(path: str, wanted: str) -> Column:
            if path not in kind.names:  # this layout's fingerprint cannot occur
                return F.lit(None).cast(wanted)
            at = F.col("_value")[path]
            if not wanted.startswith("array"):
                return at.cast("string")
            element, names = getattr(kind[path].dataType, "elementType", None), re.findall(r"(\w+):string", wanted)
            if not isinstance(element, T.StructType):
                return F.lit(None).cast(wanted)
            return F.transform(at, lambda t: F.struct(*[(t[n].cast("string") if n in element.names else F.lit(None).cast("string")).alias(n) for n in names]))

        return self._canonical(own, typed_signature(kind, F.col("_value").getField), read).select(*keys, "fingerprint", "signature", "layout", "turns")

    def from_rows(self, df: DataFrame) -> DataFrame:
        """The same of rows (conv_id, turn, role, text), a record for each conv_id. Rows of equal turn are in order of role and text, those of a null turn last; a row without a conv_id is a conversation of its own."""
        row = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
        apart = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
        grouped = df.select("conv_id", row.alias("row"), apart.alias("apart")).groupBy("conv_id", "apart").agg(F.array_sort(F.collect_list("row")).alias("turns"))
        record = F.struct("conv_id", F.transform("turns", lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
        return self.from_struct(grouped.select("conv_id", record.alias("record")), keys=("conv_id",))

    def fingerprints(self, canonical: DataFrame) -> DataFrame:
        """Records of each fingerprint, with its signature and layout: those without a layout want a mapping."""
        return canonical.groupBy("fingerprint", "signature", "layout").agg(F.count("*").alias("records"))

    def format(self, canonical: DataFrame) -> DataFrame:
        """Adds formatted, and loss: for each turn how many characters of its part of the text come before those under the mask, and how many are under it."""
        text = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END))
        before = lambda t: F.length(escape(t["role"])) + len(START) + len(TEXT)
        under = lambda t: F.when(t["role"].isin(*self.learned), F.length(escape(t["text"]))).otherwise(0)
        turns = F.coalesce("turns", F.array().cast(TURNS))
        mask = F.transform(turns, lambda t: F.struct(before(t).cast("long").alias("skip"), under(t).cast("long").alias("take")))
        return canonical.select("*", F.array_join(F.transform(turns, text), "").alias("formatted"), mask.alias("loss"))

    def read_back(self, formatted: DataFrame) -> DataFrame:
        """From formatted and loss alone: adds read_turns, and read_loss, the texts under the mask."""
        parts = F.slice(F.split("formatted", re.escape(END)), 1, F.size("loss"))
        cut = lambda p: F.split(p, re.escape(TEXT), 2)
        turn = lambda p: F.struct(unescape(F.substring(cut(p)[0], len(START) + 1, 1 << 30)).alias("role"), unescape(cut(p)[1]).alias("text"))
        out = formatted.select("*", parts.alias("_parts"))
        masked = F.zip_with("_parts", "loss", lambda p, m: F.when(m["take"] > 0, unescape(F.substring(p, m["skip"].cast("int") + 1, m["take"].cast("int")))))
        return out.select("*", F.transform("_parts", turn).alias("read_turns"), F.array_compact(masked).alias("read_loss")).drop("_parts")
