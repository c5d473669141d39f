"""Facts about Dart source as column expressions: no Python worker is involved.

All patterns see the whole text of a file and all classes of a file share the
results.  Arrays keep the order of first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A letter, digit or underscore of any script, in Java's and RE2's syntax.
W = r"[\p{L}\p{N}_]"

# What is looked for, with the group that is kept.
METHOD = rf"(?:Future|Stream|void|bool|String|int|double|List|Map)\s+({W}+)\s*\("
EVENT = rf"on<({W}+)>\s*\("
API_PATH = r"['\"](/[a-zA-Z0-9/_\-{}]+)['\"]"
ROUTE_PATH = rf"static\s+(?:const\s+)?String\s+{W}+\s*=\s*['\"](/[a-z0-9/_\-]+)['\"]"
ERROR = rf"(?:throw\s+({W}+)|catch\s*\({W}+\s+({W}+)\)|on\s+({W}+Exception|{W}+Error)\s*\{{)"
LOOKUP = rf"(?:i|Modular)\.get<({W}+)>"
BINDING = rf"Bind\.(?:{W}+)\(\(i\)\s*=>\s*({W}+)\("
ROUTED = rf"r\.module\(['\"](.+?)['\"],\s*module:\s*({W}+)\(\)"
EVENT_CLASS = rf"class\s+({W}+Event)\b"
STATE_CLASS = rf"class\s+({W}+State)\b"
INHERITING = rf"class\s+({W}+)\s+(?:extends|with|implements)\s+({W}+)"
STANDALONE = rf"class\s+({W}+)\s*[{{<]"

# Node types by what a name holds; the first rule that holds counts.
# (type, parts of the name, whether the name must end with one of them)
NODE_RULES = (
    ("Controller", ("Bloc", "Cubit", "Controller", "Store"), False),
    ("Service", ("Service",), False),
    ("Repository", ("Repository", "Gateway", "Api", "Datasource", "DataSource"), False),
    ("UI", ("Page", "Screen", "View"), False),
    ("UseCase", ("UseCase",), False),
    ("Event", ("Event",), True),
    ("State", ("State",), True),
    ("Model", ("Model", "Entity", "Dto", "Response", "VO"), False),
    ("Resource", ("Resource", "Mapper", "Converter", "Transformer"), False),
    ("Param", ("Param", "Request", "Body", "Input"), False),
    ("Route", ("Route",), False),
    ("Widget", ("Widget", "Button", "Card", "Dialog", "Sheet", "Item", "Tile", "Cell", "Badge", "Chip", "Tag"), False),
)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def _all(content: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(content, F.lit(pattern), F.lit(group))


def methods(content: Column) -> Column:
    """Names of methods after one of nine return types; distinct, at most 10."""
    return F.slice(F.array_distinct(_all(content, METHOD)), 1, 10)


def events(content: Column) -> Column:
    """Types of handled events; distinct, at most 10."""
    return F.slice(F.array_distinct(_all(content, EVENT)), 1, 10)


def api_paths(content: Column) -> Column:
    """Quoted paths of more than three characters; distinct, at most 5."""
    return F.slice(F.filter(F.array_distinct(_all(content, API_PATH)), lambda p: F.length(p) > 3), 1, 5)


def route_paths(content: Column) -> Column:
    """The first three route constants, repeated ones included."""
    return F.slice(_all(content, ROUTE_PATH), 1, 3)


def error_types(content: Column) -> Column:
    """Thrown types, caught names and handled error types in order; distinct, at most 5."""
    both = lambda a, b: F.concat(a, b)
    each = F.zip_with(F.zip_with(_all(content, ERROR, 1), _all(content, ERROR, 2), both), _all(content, ERROR, 3), both)
    return F.slice(F.array_distinct(F.filter(each, lambda e: e != "")), 1, 5)


def looked_up(content: Column) -> Column:
    return F.array_distinct(_all(content, LOOKUP))


def bound(content: Column) -> Column:
    return F.array_distinct(_all(content, BINDING))


def routed(content: Column) -> Column:
    """Modules routed to, repeated ones included."""
    return _all(content, ROUTED, 2)


def inheriting(content: Column) -> Column:
    """Structs (name, base) of classes that extend, mix in or implement something."""
    return F.arrays_zip(_all(content, INHERITING, 1).alias("name"), _all(content, INHERITING, 2).alias("base"))


def declared(content: Column) -> Column:
    """Structs (name, base): inheriting classes first, then standalone ones not among them."""
    names = _all(content, INHERITING, 1)
    alone = F.array_except(F.array_distinct(_all(content, STANDALONE)), names)
    return F.concat(inheriting(content), F.transform(alone, lambda n: F.struct(n.alias("name"), F.lit("").alias("base"))))


def class_line(content: Column, name: Column) -> Column:
    """The last line that holds ``class`` and the name; 1 where none does or the last line has no end.

    The name must be followed by something that isn't part of a name.
    """
    lines = F.split(content, "\n", -1)
    word = F.concat(F.lit(r"\bclass\s+"), name, F.lit(rf"(?!{W})"))
    last = F.array_max(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, word), i + 1)))
    return F.when(last.isNull() | (last >= F.size(lines)), F.lit(1)).otherwise(last)


def part_file(path: Column) -> Column:
    """Whether a file holds the events or states of a bloc, by its name."""
    return path.endswith("_event.dart") | path.endswith("_state.dart")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def titled(text: Column) -> Column:
    """Each letter after a non-letter in upper case, all others in lower case."""
    letters = F.split(F.lower(text), "")
    word = lambda c: c.rlike(r"\p{L}")
    step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(acc["inside"], c).otherwise(F.upper(c))).alias("out"), word(c).alias("inside"))
    return F.aggregate(letters, F.struct(F.lit("").alias("out"), F.lit(False).alias("inside")), step, lambda acc: acc["out"])


def part_id(path: Column) -> Column:
    """Name of a part-file node: the file's name in title case without underscores."""
    return F.replace(titled(F.replace(F.replace(file_name(path), F.lit(".dart"), F.lit("")), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def part_classes(content: Column) -> Column:
    """Event classes, then state classes, at most 20."""
    return F.slice(F.concat(_all(content, EVENT_CLASS), _all(content, STATE_CLASS)), 1, 20)


def bloc_of(part: Column) -> Column:
    return F.replace(F.replace(part, F.lit("Event"), F.lit("Bloc")), F.lit("State"), F.lit("Bloc"))


def node_type(name: Column, base: Column) -> Column:
    """The type of a class by its name and base; the first rule that holds, else Unknown."""
    base = F.coalesce(base, F.lit(""))
    out = F.when(base.contains("Module") | name.contains("Module"), "Module")
    for kind, parts, at_end in NODE_RULES:
        out = out.when(_any([name.endswith(p) if at_end else name.contains(p) for p in parts]), kind)
    return out.otherwise("Unknown")


def summary(kind: Column, base: Column, methods_: Column, events_: Column, paths: Column) -> Column:
    """Type, base, up to three events or else four methods, and the first path, joined by `` | ``.

    Null arrays count as empty and null items are left out.
    """
    some = lambda a: F.array_compact(F.coalesce(a, F.array().cast("array<string>")))
    e, m, p = some(events_), some(methods_), some(paths)
    return F.concat_ws(
        " | ",
        kind,
        F.when(F.coalesce(base, F.lit("")).isin("", "Mixin"), None).otherwise(F.concat(F.lit("extends "), base)),
        F.when(F.size(e) > 0, F.concat(F.lit("on<"), F.array_join(F.slice(e, 1, 3), ","), F.lit(">"))).when(F.size(m) > 0, F.concat(F.lit("fn:"), F.array_join(F.slice(m, 1, 4), ","))),
        F.concat(F.lit("api:"), F.get(p, F.lit(0))),
    )


def script_type(name: Column, base: Column) -> Column:
    """The smaller classification of the script extractor; null is no node."""
    out = None
    for kind in ("Module", "Controller", "Service", "Repository"):
        out = F.when(name.endswith(kind), kind) if out is None else out.when(name.endswith(kind), kind)
    return out.when(F.coalesce(base, F.lit("")).contains("Module"), "Module")
