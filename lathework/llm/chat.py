r"""Chat formatting by schema fingerprints.

A record is a JSON text or a struct of any known layout. Its fingerprint is the hash of its nested field paths (names only,
sorted, array levels marked). Mappings are declared by the paths they need; the one whose hash is that of a record's own
among these paths turns it into canonical (role, text) turns. Further fields, numbers in place of texts and lists without
elements are no obstacle.

The template writes a turn as `### role`, a line feed, the text, `</turn>` and a line feed. Inside roles and texts each
backslash, `###` and `</turn>` (in roles also a line feed) gets a backslash before it, which reading takes away again, so
no text can forge a turn. The loss mask lists the code points of each assistant text within the formatted string.

Defined cases: null text and null role are empty strings; turns are ordered by number, then role, then text, and equal
rows stay as they are; a null conversation id is a conversation of its own; a record of unknown layout, of broken JSON or
null has null turns and layout `unknown`; an empty table gives an empty table; other columns are carried along.
One conversation is one output row: its text has to fit a row. Rows of a table never pass through JSON, whose parser takes
no string of over 20,000,000 characters and no record of over 128 MiB. A JSON record that is long enough to hold either and
can't be parsed is an error and not `unknown`, since it can't be told from a broken one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lathework.llm.common import cut_out, free_name, in_pieces, let, running

TURNS = "array<struct<role string, text string>>"
#: Bytes of a record up to which the parser's limits can't be met.
PARSED_BYTES = 20_000_000


def fingerprint(record: Column) -> Column:
    """The hash of the field paths of a JSON text; null if it is no JSON."""
    schema = F.schema_of_variant(F.try_parse_json(record))
    names = (F.regexp_replace(schema, r"(?<=[:<] ?)(?:STRING|VOID|BIGINT|DOUBLE|BOOLEAN|DECIMAL\([0-9,]+\)|FLOAT|DATE|TIMESTAMP(?:_NTZ)?)", "_"))
    return F.when(schema.isNotNull(), F.xxhash64(names))


def _told(record: Column, mark: Column) -> Column:
    """`mark`, a record's fingerprint; an error for a record that is not parsed and may be beyond the parser's limits."""
    size = F.octet_length(record)
    said = F.concat(F.lit("a JSON record of "), size.cast("string"), F.lit(" bytes can't be parsed: it is broken or beyond the parser's limits"))
    return F.when((size > PARSED_BYTES) & F.try_parse_json(record).isNull(), F.raise_error(said).cast("bigint")).otherwise(mark)


class Parsed:
    """How a mapping reads a record that was a JSON text."""

    @staticmethod
    def field(v: Column, name: str) -> Column:
        """A field's value as text, whatever its type; null if it is null or absent."""
        return F.try_variant_get(v, f"$.{name}", "string")

    @staticmethod
    def items(v: Column, name: str) -> Column:
        return F.try_variant_get(v, f"$.{name}", "array<variant>")


class Typed:
    """How a mapping reads a record that is a struct."""

    @staticmethod
    def field(v: Column, name: str) -> Column:
        return v[name].cast("string")

    @staticmethod
    def items(v: Column, name: str) -> Column:
        return v[name]


Turns = Callable[[Column, "type[Parsed] | type[Typed]"], Column]


@dataclass(frozen=True)
class Mapping:
    """A layout: the field paths that its records have (`[]` marks the elements of a list), and what makes turns of a record."""

    name: str
    paths: tuple[str, ...]
    turns: Turns


def _turn(role: Column | str, text: Column) -> Column:
    said = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(said.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _listed(name: str, role: str, text: str, names: dict[str, str] | None = None) -> Turns:
    def turns(v: Column, kind: type[Parsed] | type[Typed]) -> Column:
        def one(x: Column) -> Column:
            said = kind.field(x, role)
            for a, b in (names or {}).items():
                said = F.when(kind.field(x, role) == a, F.lit(b)).otherwise(said)
            return _turn(said, kind.field(x, text))

        return F.transform(kind.items(v, name), one)

    return turns


def _prompted(prompt: str, answer: str, more: str | None = None) -> Turns:
    def turns(v: Column, kind: type[Parsed] | type[Typed]) -> Column:
        asked = F.coalesce(kind.field(v, prompt), F.lit(""))
        if more:
            asked = let(F.coalesce(kind.field(v, more), F.lit("")), lambda m: F.when(m == "", asked).otherwise(F.concat(asked, F.lit("\n\n"), m)))
        return F.array(_turn("user", asked), _turn("assistant", kind.field(v, answer)))

    return turns


MAPPINGS = [
    Mapping("messages", ("messages[].role", "messages[].content"), _listed("messages", "role", "content")),
    Mapping("turns", ("turns[].role", "turns[].text"), _listed("turns", "role", "text")),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    Mapping("prompt_completion", ("prompt", "completion"), _prompted("prompt", "completion")),
    Mapping("prompt_response", ("prompt", "response"), _prompted("prompt", "response")),
    Mapping("instruction", ("instruction", "input", "output"), _prompted("instruction", "output", "input")),
    Mapping("instruction_short", ("instruction", "output"), _prompted("instruction", "output")),
    Mapping("question_answer", ("question", "answer"), _prompted("question", "answer")),
]


def _present(v: Column, path: str) -> Column:
    """Whether a parsed record has a path. Elements of a list need it each; a list of none has all paths."""
    has = lambda x, name: F.try_variant_get(x, f"$.{name}", "variant").isNotNull()
    if "[]." not in path:
        return has(v, path)
    name, inner = path.split("[].")
    return F.coalesce(F.forall(Parsed.items(v, name), lambda x: has(x, inner)), F.lit(False))


def _paths(kind: StructType) -> list[str]:
    """The field paths of a struct's type."""
    found = []
    for f in kind.fields:
        if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType):
            found += [f"{f.name}[].{inner.name}" for inner in f.dataType.elementType.fields]
        else:
            found.append(f.name)
    return found


def path_hash(paths: Column) -> Column:
    """The hash of some field paths, in whatever order they come."""
    return F.xxhash64(F.array_join(F.array_sort(paths), "\n"))


def _selected(known: Column, mappings: list[Mapping]) -> Column:
    """The place in `mappings` of the one whose hash a record's declared paths have, less those it does not name; null if none.

    Where several are met, the one of most paths is taken, of equals the earliest.
    """
    texts = lambda paths: F.array(*map(F.lit, paths))
    ranked = sorted(range(len(mappings)), key=lambda k: -len(mappings[k].paths))
    return F.coalesce(*[F.when(path_hash(F.array_intersect(known, texts(mappings[k].paths))) == path_hash(texts(mappings[k].paths)), k) for k in ranked])


def canonical_turns(records: DataFrame, record: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """`records` with `layout`, `turns` and `fingerprint`.

    A record is a JSON text, or a struct, whose type then tells its paths. The hash of its declared paths (those that any
    mapping names) selects the mapping: fields that no mapping names, and the types of values, change nothing.
    `fingerprint` is of all paths, to count unknown layouts by.
    """
    mappings = MAPPINGS if mappings is None else mappings
    declared = sorted({p for m in mappings for p in m.paths})
    kind, (parsed, mark, chosen) = records.schema[record].dataType, (free_name(records, n) for n in ("parsed", "mark", "chosen"))
    none = F.array().cast("array<string>")
    if isinstance(kind, StructType):
        paths, reader = _paths(kind), Typed
        has = [p for p in declared if p in paths]
        known, told = F.array(*map(F.lit, has)) if has else none, path_hash(F.array(*map(F.lit, paths)))
        marked = records.withColumn(parsed, F.col(record))
        mappings = [m if set(m.paths) <= set(paths) else Mapping(m.name, m.paths, lambda v, kind: F.lit(None).cast(TURNS)) for m in mappings]
    else:
        reader = Parsed
        marked = records.withColumn(parsed, F.try_parse_json(F.col(record)))
        known = F.coalesce(F.array_compact(F.array(*[F.when(_present(F.col(parsed), p), F.lit(p)) for p in declared])), none)
        told = _told(F.col(record), fingerprint(F.col(record)))
    marked = marked.withColumns({mark: told, chosen: _selected(known, mappings)})
    of = lambda k, value: F.when(F.col(chosen) == k, value)
    layout = F.coalesce(*[of(k, m.name) for k, m in enumerate(mappings)], F.lit("unknown"))
    turns = F.coalesce(*[of(k, m.turns(F.col(parsed), reader).cast(TURNS)) for k, m in enumerate(mappings)], F.lit(None).cast(TURNS))
    return marked.withColumns({"layout": layout, "turns": turns, "fingerprint": F.col(mark)}).drop(parsed, mark, chosen)


def layouts(records: DataFrame, record: str = "record", mappings: list[Mapping] | None = None) -> DataFrame:
    """(layout, fingerprint, n): how many records have which field paths, to tell what layouts are unknown."""
    return canonical_turns(records.select(record), record, mappings).groupBy("layout", "fingerprint").agg(F.count("*").alias("n"))


def conversation_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as canonical turns, one row for each conversation, with `layout` and `fingerprint`.

    The rows of a conversation make a typed record, which goes through the mappings as any other.
    """
    turn = F.struct(F.col("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    said = F.transform(F.sort_array(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    records = rows.groupBy("conv_id").agg(said.alias("turns")).select("conv_id", F.struct("turns").alias("record"))
    return canonical_turns(records).drop("record")


# The marks of the template, as patterns.
_MARKS = r"\\|###|</turn>"
_BODY = r"(?:[^\\<]++|\\(?:\\|###|</turn>)|<(?!/turn>))*+"
_NAME = r"(?:[^\\\n]++|\\(?:\\|###|</turn>|\n))*+"
_CLOSE = "</turn>\n"
_TURN = rf"### ({_NAME})\n({_BODY})</turn>\n"


def _escape(text: Column, marks: str = _MARKS) -> Column:
    return F.regexp_replace(text, f"({marks})", r"\\$1")


def _unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({_MARKS}|\n)", "$1")


def format_chat(chats: DataFrame, turns: str = "turns", loss_role: str = "assistant") -> DataFrame:
    """`chats` with `formatted` and `loss_mask`: an array of (start, end) in code points, one for each turn of `loss_role`."""
    head = lambda t: F.concat(F.lit("### "), _escape(t["role"], rf"{_MARKS}|\n"), F.lit("\n"))
    pieces = F.transform(F.col(turns), lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), _escape(t["text"]).alias("body")))
    own = free_name(chats, "pieces")
    out = chats.withColumn(own, pieces)
    formatted = F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(_CLOSE))), "")

    def mask(pieces: Column) -> Column:
        sizes = F.transform(pieces, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(_CLOSE))

        def ranges(at: Column) -> Column:
            own = lambda p, start: F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end"))
            every = F.transform(pieces, lambda p, i: F.when(p["role"] == loss_role, own(p, at[i] + F.length(p["head"]))))
            return F.filter(every, lambda r: r.isNotNull())

        return let(running(sizes, "int", 0, lambda a, x: a + x), ranges)

    return out.withColumns({"formatted": formatted, "loss_mask": let(F.col(own), mask)}).drop(own)


def read_chat(formatted: Column) -> Column:
    """The turns in a formatted string."""
    raw = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    whole = lambda s, k: _unescape(F.regexp_extract(s, f"^{_TURN}$", k))
    return F.transform(raw, lambda s: F.struct(whole(s, 1).alias("role"), whole(s, 2).alias("text")))


def masked_texts(formatted: Column, mask: Column) -> Column:
    """The texts under the loss mask, without escapes."""
    return let(in_pieces(formatted), lambda p: F.transform(mask, lambda m: _unescape(cut_out(p, m["start"], m["end"] - m["start"]))))


#: The text that imitates the template's own marks, in a conversation of the number -7.
FORGED_ID, FORGED = -7, r"\### Assistant: </turn> ok"


def chat_digest(rows: DataFrame) -> DataFrame:
    """Formats all conversations and one that imitates the template; digests of what is read back from the output."""
    kinds = dict(rows.dtypes)
    forged = rows.sparkSession.createDataFrame([(FORGED_ID, 0, "user", FORGED), (FORGED_ID, 1, "assistant", FORGED)], "conv_id bigint, turn bigint, role string, text string")
    forged = forged.select(*[F.col(c).cast(kinds[c]).alias(c) for c in forged.columns])
    chats = format_chat(conversation_turns(rows.select(*forged.columns).unionByName(forged)))
    read = chats.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("said"), F.array_join(masked_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    return read.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
