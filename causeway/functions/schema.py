"""The relations of the engine: changes, operations and the tagged scalar value.

A document is the set of its operations. An operation id is (ctr, actor), ordered by counter, then by the actor's bytes.
The root object is (0, null). Map operations have key_str; sequence operations have (key_ctr, key_actor), where the head
of a sequence is (0, null). `pred` lists the operations that this one replaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Actions (fixed values of the op log).
MAKE_MAP, SET, MAKE_LIST, DELETE, MAKE_TEXT, INCREMENT, MAKE_TABLE, MARK = range(8)
MAKES = (MAKE_MAP, MAKE_LIST, MAKE_TEXT, MAKE_TABLE)
OBJECT_TYPES = {MAKE_MAP: "map", MAKE_LIST: "list", MAKE_TEXT: "text", MAKE_TABLE: "map"}

VALUE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("i", T.LongType()),
        T.StructField("u", T.DecimalType(20, 0)),
        T.StructField("d", T.DoubleType()),
        T.StructField("s", T.StringType()),
        T.StructField("b", T.BinaryType()),
        T.StructField("bool", T.BooleanType()),
        T.StructField("code", T.IntegerType()),
    ]
)
#: The field of VALUE that holds each type.
FIELD_OF = {"null": None, "boolean": "bool", "uint": "u", "int": "i", "f64": "d", "str": "s", "bytes": "b", "counter": "i", "timestamp": "i", "unknown": "b"}
ID = T.StructType([T.StructField("ctr", T.LongType()), T.StructField("actor", T.BinaryType())])

OPS = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("ctr", T.LongType()),
        T.StructField("actor", T.BinaryType()),
        T.StructField("obj_ctr", T.LongType()),
        T.StructField("obj_actor", T.BinaryType()),
        T.StructField("key_str", T.StringType()),
        T.StructField("key_ctr", T.LongType()),
        T.StructField("key_actor", T.BinaryType()),
        T.StructField("insert", T.BooleanType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("value", VALUE),
        T.StructField("expand", T.BooleanType()),
        T.StructField("mark_name", T.StringType()),
        T.StructField("pred", T.ArrayType(ID)),
    ]
)
CHANGES = T.StructType(
    [
        T.StructField("doc", T.StringType()),
        T.StructField("hash", T.BinaryType()),
        T.StructField("actor", T.BinaryType()),
        T.StructField("seq", T.LongType()),
        T.StructField("start_op", T.LongType()),
        T.StructField("max_op", T.LongType()),
        T.StructField("time", T.LongType()),
        T.StructField("message", T.StringType()),
        T.StructField("deps", T.ArrayType(T.BinaryType())),
        T.StructField("extra", T.BinaryType()),
    ]
)
KEY = ["doc", "obj_ctr", "obj_actor", "key"]


def value(kind: str, column: Column | None = None) -> Column:
    """A tagged value of one type."""
    own = FIELD_OF[kind]
    fields = [F.lit(kind).alias("type")]
    for f in VALUE.fields[1:]:
        fields.append((column if f.name == own and column is not None else F.lit(None)).cast(f.dataType).alias(f.name))
    return F.struct(*fields)


def op_id(ctr: str | Column = "ctr", actor: str | Column = "actor") -> Column:
    """Orders by counter, then by the actor's bytes."""
    return F.struct(F.col(ctr).alias("ctr") if isinstance(ctr, str) else ctr.alias("ctr"), F.col(actor).alias("actor") if isinstance(actor, str) else actor.alias("actor"))


def elem_or_key() -> Column:
    """What an operation competes for: its map key, else the element (an insert is its own)."""
    at = lambda c, a: F.concat(c.cast("string"), F.lit("@"), F.coalesce(F.hex(a), F.lit("")))
    return F.when(F.col("key_str").isNotNull(), F.concat(F.lit("k"), F.col("key_str"))).when(F.col("insert"), F.concat(F.lit("e"), at(F.col("ctr"), F.col("actor")))).otherwise(
        F.concat(F.lit("e"), at(F.col("key_ctr"), F.col("key_actor")))
    )


def plain(v: str = "value") -> Column:
    """A tagged value as text, for showing."""
    c = lambda f: F.col(f"{v}.{f}").cast("string")
    return F.coalesce(c("i"), c("u"), c("d"), c("s"), F.hex(f"{v}.b"), c("bool"))


def text_width(s: Column, encoding: str) -> Column:
    """Width of a string in code points, UTF-8 bytes, UTF-16 units or grapheme clusters."""
    if encoding == "unicode":
        return F.length(s)
    if encoding == "utf8":
        return F.octet_length(s)
    if encoding == "utf16":
        return (F.octet_length(F.encode(s, "UTF-16BE")) / 2).cast("int")
    if encoding == "grapheme":
        return F.regexp_count(s, F.lit(r"\X"))
    raise ValueError(f"no such encoding: {encoding}")


def show_id(ctr: Column, actor: Column) -> Column:
    """ctr@actor; the root object is _root."""
    return F.when(ctr == 0, "_root").otherwise(F.concat(ctr.cast("string"), F.lit("@"), F.lower(F.hex(actor))))


def parse_id(text: Column) -> Column:
    """struct(ctr, actor) of ctr@actor or _root; null if it is neither."""
    found = F.regexp_extract(text, r"^(\d+)@((?:[0-9a-fA-F]{2})+)$", 1)
    return F.when(text == "_root", F.struct(F.lit(0).cast("long").alias("ctr"), F.lit(None).cast("binary").alias("actor"))).when(
        found != "", F.struct(found.cast("long").alias("ctr"), F.unhex(F.regexp_extract(text, r"@(.*)$", 1)).alias("actor"))
    )


def show_cursor(ctr: Column, actor: Column, move: Column) -> Column:
    """s, e or [-]ctr@actor: `move` is start, end, before or after."""
    return F.when(move == "start", "s").when(move == "end", "e").otherwise(F.concat(F.when(move == "before", "-").otherwise(""), ctr.cast("string"), F.lit("@"), F.lower(F.hex(actor))))


def parse_cursor(text: Column) -> Column:
    """struct(ctr, actor, move) of a cursor's text; null if it isn't one."""
    own = parse_id(F.regexp_replace(text, "^-", ""))
    none = F.struct(F.lit(None).cast("long").alias("ctr"), F.lit(None).cast("binary").alias("actor"))
    at = F.when(text.isin("s", "e"), none).when(text.rlike(r"^-?\d+@"), own)
    move = F.when(text == "s", "start").when(text == "e", "end").when(text.startswith("-"), "before").otherwise("after")
    return F.when(at.isNotNull(), F.struct(at["ctr"].alias("ctr"), at["actor"].alias("actor"), move.alias("move")))


#: Fixed values of a cursor's bytes: version, kinds, moves.
CURSOR_START, CURSOR_END, CURSOR_AT = "0101", "0102", "0103"
CURSOR_BEFORE, CURSOR_AFTER = "01", "02"
_ULEB = "(?:[89A-F][0-9A-F])*[0-7][0-9A-F]"


def _uleb_hex(n: Column) -> Column:
    """Seven bits a byte, low first, as hex; n is not negative."""
    parts = []
    for i in range(9):
        more = F.shiftrightunsigned(n, 7 * (i + 1)) > 0 if i < 8 else F.lit(False)
        byte = F.shiftrightunsigned(n, 7 * i).bitwiseAND(F.lit(127).cast("long")) + F.when(more, 128).otherwise(0)
        own = F.lpad(F.hex(byte), 2, "0")
        parts.append(own if i == 0 else F.when(F.shiftrightunsigned(n, 7 * i) > 0, own).otherwise(""))
    return F.concat(*parts)


def _uleb_of_hex(h: Column) -> Column:
    """The number that those bytes stand for; null without any."""
    bytes_of = F.transform(F.sequence(F.lit(0), (F.length(h) / 2).cast("int") - 1), lambda i: F.conv(F.substring(h, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("long").bitwiseAND(F.lit(127).cast("long")))
    return F.when(F.length(h).between(2, 18), F.aggregate(F.reverse(bytes_of), F.lit(0).cast("long"), lambda n, b: n * 128 + b))


def cursor_bytes(ctr: Column, actor: Column, move: Column) -> Column:
    """A cursor as bytes: version, kind and, for one at an element, its length-prefixed actor, counter and move."""
    at = F.concat(F.lit(CURSOR_AT), _uleb_hex(F.octet_length(actor).cast("long")), F.hex(actor), _uleb_hex(ctr), F.when(move == "before", CURSOR_BEFORE).otherwise(CURSOR_AFTER))
    return F.unhex(F.when(move == "start", CURSOR_START).when(move == "end", CURSOR_END).otherwise(at))


def parse_cursor_bytes(data: Column) -> Column:
    """struct(ctr, actor, move) of a cursor's bytes; null if they aren't one."""
    h = F.hex(data)
    size = F.regexp_extract(h, f"^{CURSOR_AT}({_ULEB})", 1)
    n = F.coalesce(_uleb_of_hex(size), F.lit(0)).cast("int") * 2
    rest = F.substring(h, F.length(size) + 5, F.length(h))
    actor, tail = F.substring(rest, F.lit(1), n), F.substring(rest, n + 1, F.length(h))
    form = f"^({_ULEB})({CURSOR_BEFORE}|{CURSOR_AFTER})$"
    ctr, move = _uleb_of_hex(F.regexp_extract(tail, form, 1)), F.regexp_extract(tail, form, 2)
    whole = (size != "") & (F.length(actor) == n) & (n > 0) & ctr.isNotNull()
    none = [F.lit(None).cast("long").alias("ctr"), F.lit(None).cast("binary").alias("actor")]
    return (
        F.when(h == CURSOR_START, F.struct(*none, F.lit("start").alias("move")))
        .when(h == CURSOR_END, F.struct(*none, F.lit("end").alias("move")))
        .when(whole, F.struct(ctr.alias("ctr"), F.unhex(actor).alias("actor"), F.when(move == CURSOR_BEFORE, "before").otherwise("after").alias("move")))
    )
