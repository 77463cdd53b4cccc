"""Chat formatting, in DataFrame operations only.

Conversations come in many layouts: prompt and completion, instruction with input and output,
lists of messages under various names.  The layout of a record is recognised by its schema
fingerprint, a hash of its sorted nested field paths, which selects a declarative mapping to turns
of role and text.  The turns are written with a template whose marks cannot occur inside a text:
control strings in texts are escaped, and reading back restores them.
"""

from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

START, END = "<|im_start|>", "<|im_end|>"
ESCAPE = "\\"
#: Control strings of common templates: their second character is escaped.
CONTROL = r"(<(?=\||s>|/s>)|\[(?=INST\]|/INST\]))"
LOSS_ROLE = "assistant"

#: Layouts: the field paths that make the fingerprint, and either single fields with their roles
#: in order, or a list of messages with the fields for role and text.  ``named`` layouts use names of
#: their own for the roles; the roles of the others are taken as they are.
LAYOUTS = [
    {"paths": ["messages[].content", "messages[].role"], "list": ("messages", "role", "content")},
    {"paths": ["turns[].role", "turns[].text"], "list": ("turns", "role", "text")},
    {"paths": ["dialog[].speaker", "dialog[].text"], "list": ("dialog", "speaker", "text")},
    {"paths": ["conversations[].from", "conversations[].value"],
     "list": ("conversations", "from", "value"), "named": True},
    {"paths": ["completion", "prompt"], "fields": [("prompt", "user"), ("completion", "assistant")]},
    {"paths": ["prompt", "response"], "fields": [("prompt", "user"), ("response", "assistant")]},
    {"paths": ["prompt", "response", "system"],
     "fields": [("system", "system"), ("prompt", "user"), ("response", "assistant")]},
    {"paths": ["instruction", "output"],
     "fields": [("instruction", "user"), ("output", "assistant")]},
    {"paths": ["input", "instruction", "output"],
     "fields": [(("instruction", "input"), "user"), ("output", "assistant")]},
]
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind, at=""):
    """The paths of all leaves of a type, lists as ``[]``."""
    if isinstance(kind, StructType):
        return [p for f in kind for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, MapType):
        return field_paths(kind.valueType, f"{at}{{}}")
    return [at]


def path_hash(paths):
    """Fingerprint of an array column of field paths; the order does not count."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def schema_fingerprint(kind):
    """Fingerprint of a struct type, as a column."""
    return path_hash(F.array(*[F.lit(p) for p in field_paths(kind)]))


def record_paths(record, layouts=LAYOUTS):
    """Field paths of a JSON record with fields that hold values or lists of messages, as far as any
    layout knows them.

    The paths of a list are those of all its messages together; an empty list has all that are known
    of it.
    """
    known = F.array(*[F.lit(p) for p in sorted({p for spec in layouts for p in spec["paths"]})])

    def below(field):
        name = F.concat(field["key"], F.lit("[]."))
        messages = F.from_json(field["value"], "array<map<string,string>>")
        inner = F.array_distinct(F.flatten(F.transform(messages, lambda m: F.map_keys(m))))
        return (
            F.when(F.size(messages) == 0, F.filter(known, lambda p: F.startswith(p, name)))
            .when(inner.isNotNull(), F.transform(inner, lambda key: F.concat(name, key)))
            .otherwise(F.array(field["key"])))

    fields = F.map_entries(F.from_json(record, "map<string,string>"))
    found = F.flatten(F.transform(fields, below))
    return F.filter(found, lambda p: F.array_contains(known, p))


def layout_table(spark, layouts=LAYOUTS):
    """``fingerprint, layout`` of the declared layouts, a fixed small table."""
    rows = [(at, spec["paths"]) for at, spec in enumerate(layouts)]
    table = spark.createDataFrame(rows, "layout int, paths array<string>")
    return table.select(path_hash(F.col("paths")).alias("fingerprint"), "layout")


def role_name(role):
    """The canonical name of a role; null is empty."""
    role = F.coalesce(role, F.lit(""))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, F.lower(role)), role)


def list_turns(messages, role, text, named=False):
    """Turns of a list of messages; roles are translated only where a layout has names of its own."""
    def known(m):
        return role_name(m[role]) if named else F.coalesce(m[role], F.lit(""))

    return F.transform(messages, lambda m: F.struct(
        known(m).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def field_turns(fields):
    """Turns from single fields, given as ``(text column, role)``; a missing system text is none."""
    turns = F.array(*[
        F.struct(F.lit(role).alias("role"), text.alias("text")) for text, role in fields])
    turns = F.filter(turns, lambda t: (t["role"] != "system") | t["text"].isNotNull())
    return F.transform(turns, lambda t: F.struct(
        t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))


def _joined(texts):
    """A text or several, joined by a blank line, empty ones left out."""
    whole = F.array_join(F.filter(F.array(*texts), lambda t: F.coalesce(t, F.lit("")) != ""), "\n\n")
    return texts[0] if len(texts) == 1 else whole


def mapped(spec, field):
    """Turns of one layout; ``field(name)`` gives a column, ``field(name, type)`` a list."""
    if "list" in spec:
        name, role, text = spec["list"]
        messages = field(name, f"array<struct<`{role}`:string,`{text}`:string>>")
        return list_turns(messages, role, text, spec.get("named", False))
    fields = []
    for names, role in spec["fields"]:
        names = (names,) if isinstance(names, str) else names
        fields.append((_joined([field(name) for name in names]), role))
    return field_turns(fields)


def canonical_turns(records, record="record", layouts=LAYOUTS):
    """Add ``layout`` and ``turns`` to rows with JSON records of any declared layout.

    Records of an unknown layout, broken and null ones get a null layout and null turns.
    """
    known = layout_table(records.sparkSession, layouts)
    marked = records.withColumn("fingerprint", path_hash(record_paths(F.col(record), layouts)))
    found = marked.join(F.broadcast(known), "fingerprint", "left")
    turns = F.lit(None).cast(TURNS)
    for at, spec in enumerate(layouts):
        def field(name, kind=None):
            value = F.get_json_object(record, f"$.{name}")
            return F.from_json(value, kind) if kind else value

        turns = F.when(F.col("layout") == at, mapped(spec, field)).otherwise(turns)
    return found.withColumn("turns", turns).drop("fingerprint")


def typed_turns(frame, layouts=LAYOUTS, keep=()):
    """Turns of a frame whose columns besides ``keep`` are one record each.

    The frame's own schema is fingerprinted, so a layout costs nothing per row.  An unknown layout
    is an error.
    """
    kept = {k.lower() for k in keep}
    kind = StructType([f for f in frame.schema if f.name.lower() not in kept])
    spark = frame.sparkSession
    marks = spark.range(1).select(schema_fingerprint(kind).alias("fingerprint"))
    found = marks.join(layout_table(spark, layouts), "fingerprint").first()
    if found is None:
        raise ValueError(f"no layout has the paths {sorted(field_paths(kind))}")
    spec = layouts[found["layout"]]
    return frame.select(*keep, mapped(spec, lambda name, kind=None: F.col(name)).alias("turns"))


def escaped(text):
    """Control strings made harmless, so that no mark of the template occurs."""
    doubled = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    return F.regexp_replace(doubled, CONTROL, "$1\\\\")


def unescaped(text):
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def formatted(turns):
    """The whole conversation in the template: mark, role, line end, text, mark, for each turn.

    A line end inside a role is escaped too.
    """
    parts = F.transform(turns, lambda t: F.concat(
        F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(ESCAPE + "\n")), F.lit("\n"),
        escaped(t["text"]), F.lit(END + "\n")))
    return F.array_join(parts, "")


def read_back(text):
    """The turns of a formatted conversation."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    role = r"^<\|im_start\|>([^\\\n]*+(?:\\[\s\S][^\\\n]*+)*+)\n"
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.regexp_extract(p, role, 1)).alias("role"),
        unescaped(F.regexp_replace(p, role, "")).alias("text")))


def loss_spans(turns):
    """The loss mask: where the assistant's texts stand in the formatted conversation.

    ``start`` counts code points from 0.  Spans cover the texts as written, escapes included, and
    neither marks nor roles.
    """
    def written(t):
        role = F.replace(escaped(t["role"]), F.lit("\n"), F.lit(ESCAPE + "\n"))
        head = F.length(role) + len(START) + 1
        return F.struct(
            head.alias("head"), F.length(escaped(t["text"])).alias("size"),
            (t["role"] == LOSS_ROLE).alias("learned"))

    none = F.array().cast("array<struct<start:int,size:int>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc, t):
        start = acc["at"] + t["head"]
        span = F.array(F.struct(start.alias("start"), t["size"].alias("size")))
        return F.struct(
            (start + t["size"] + len(END) + 1).alias("at"),
            F.when(t["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.transform(turns, written), begin, step, lambda acc: acc["spans"])


def under_mask(text, spans):
    """The text of a formatted conversation under its loss mask, unescaped, spans in order."""
    return F.array_join(F.transform(spans, lambda s: unescaped(
        F.substring(text, s["start"] + 1, s["size"]))), "")


def gather(rows):
    """Rows ``conv_id, turn, role, text`` as one JSON record per conversation.

    Rows are ordered by turn, null first; equal turns by role and text.  A null text or role is
    empty.  A null conv_id is a conversation of its own.  The records take the layouts that keep
    roles as they are, in turn by conv_id, as a corpus of several origins would.
    """
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("turns"))
    kept = [spec["list"] for spec in LAYOUTS if "list" in spec and not spec.get("named")]

    def record(name, role, text):
        messages = F.transform("turns", lambda m: F.struct(
            m["role"].alias(role), m["text"].alias(text)))
        return F.to_json(F.struct(F.col("conv_id").alias("id"), messages.alias(name)))

    which = F.pmod(F.coalesce(F.col("conv_id"), F.lit(0)), F.lit(len(kept)))
    found = record(*kept[0])
    for at, spec in enumerate(kept[1:], 1):
        found = F.when(which == at, record(*spec)).otherwise(found)
    return grouped.select("conv_id", found.alias("record"))


def digests(rows):
    """Format all conversations of ``rows (conv_id, turn, role, text)`` and read them back.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.  Roles stay as they
    are; nulls and order as in ``gather``; repeated rows are turns of their own; other columns are not
    read.
    """
    turns = canonical_turns(gather(rows)).select("conv_id", "turns")
    written = turns.select("conv_id", formatted(F.col("turns")).alias("formatted"),
                           loss_spans(F.col("turns")).alias("loss"))
    read = written.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                          under_mask(F.col("formatted"), F.col("loss")).alias("learned"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
