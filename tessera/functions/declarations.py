"""Top-level declarations of Dart text by a small brace-aware scanner.

Expressions can't count braces, so this is the one step of extraction that
runs in Python: an Arrow function over whole batches of texts.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.ship import ship

_SKIP = re.compile(
    r"//[^\n]*|/\*.*?(?:\*/|\Z)"
    r"|r?'''.*?(?:'''|\Z)|r?\"\"\".*?(?:\"\"\"|\Z)"
    r"|'(?:[^'\\\n]|\\.)*'?|\"(?:[^\"\\\n]|\\.)*\"?"
    r"|[{}()\[\];]|[\w$]+|<|>|\n|\S",
    re.S,
)
_PART = re.compile(r"[\w$]+\Z")
_OPEN, _CLOSE = set("{(["), set("})]")


def _words(text: str):
    """(token, line): words and punctuation outside strings and comments."""
    line = 1
    for m in _SKIP.finditer(text):
        t = m[0]
        if t == "\n":
            line += 1
            continue
        if t[0] in "'\"" or t[:2] in ("//", "/*", "r'", 'r"'):
            line += t.count("\n")
            continue
        yield t, line


def declarations(text: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, base, line) of each class, mixin and extension at the top level.

    The base of a class is its superclass without type arguments, of an
    extension the extended type, of a mixin the word Mixin.  A text that ends
    in the middle of a declaration gives what was seen of it.
    """
    out, depth, tokens = [], 0, list(_words(text))
    i, n = 0, len(tokens)
    while i < n:
        t, line = tokens[i]
        if t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth = max(0, depth - 1)
        elif depth == 0 and t in ("class", "mixin", "extension") and i + 1 < n and _PART.match(tokens[i + 1][0]):
            if t == "mixin" and tokens[i + 1][0] == "class":
                i += 1
                continue
            start = line
            j = i - 1
            while j >= 0 and tokens[j][0] in ("abstract", "base", "final", "sealed", "interface", "mixin"):
                start = tokens[j][1]
                j -= 1
            name = tokens[i + 1][0]
            base, k, angle = ("Mixin" if t == "mixin" else ""), i + 2, 0
            want = {"class": "extends", "extension": "on"}.get(t)
            if t == "extension" and name == "on" and k < n and _PART.match(tokens[k][0]):
                name, k = "", i + 1
            while k < n and tokens[k][0] not in ("{", ";"):
                w = tokens[k][0]
                angle += (w == "<") - (w == ">")
                if w == want and angle == 0 and not base and k + 1 < n:
                    base = tokens[k + 1][0]
                k += 1
            if name:
                out.append((t, name, base, start))
            i = k
            continue
        i += 1
    return out


def constructor_types(text: str) -> list[tuple[str, str]]:
    """(class, type) of each typed parameter of a class's own constructors, in order, repeats kept.

    The first question mark of a type is removed.
    """
    out, depth, tokens = [], 0, list(_words(text))
    owner, at = None, 0
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i][0]
        if depth == 0 and t == "class" and i + 1 < n:
            owner, at = tokens[i + 1][0], None
        if t == "{":
            depth += 1
            if owner and at is None:
                at = depth
        elif t == "}":
            depth = max(0, depth - 1)
            if owner and at is not None and depth < at:
                owner = None
        elif owner and at == depth and t == owner and i + 1 < n and tokens[i + 1][0] == "(":
            level, k, part = 1, i + 2, []
            while k < n and level:
                w = tokens[k][0]
                level += (w in _OPEN) - (w in _CLOSE)
                whole = part.count("<") == part.count(">")
                if not level or (whole and w in (",", "{", "[", "}", "]") and level <= 2):
                    out.extend(_parameter(owner, part))
                    part = []
                else:
                    part.append(w)
                k += 1
            i = k
            continue
        i += 1
    return out


def _parameter(owner: str, part: list[str]) -> list[tuple[str, str]]:
    if "=" in part:
        part = part[: part.index("=")]
    words = [w for w in part if w not in ("final", "required", "covariant", "const")]
    if len(words) < 2 or "." in words:
        return []
    return [(owner, "".join(words[:-1]).replace("?", "", 1))]


_DECLARED = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()), T.StructField("base", T.StringType()), T.StructField("line", T.IntegerType())]))
_TYPED = T.ArrayType(T.StructType([T.StructField("owner", T.StringType()), T.StructField("type", T.StringType())]))


def _declared(texts: pa.Array) -> pa.Array:
    names = ("kind", "name", "base", "line")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("base", pa.string()), ("line", pa.int32())]))
    return pa.array([[dict(zip(names, d, strict=True)) for d in declarations(t or "")] for t in texts.to_pylist()], kind)


def _typed(texts: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("owner", pa.string()), ("type", pa.string())]))
    return pa.array([[{"owner": o, "type": x} for o, x in constructor_types(t or "")] for t in texts.to_pylist()], kind)


def top_level(content: Column) -> Column:
    """Array of structs (kind, name, base, line); empty for a null text."""
    ship()
    return F.arrow_udf(_declared, _DECLARED)(content)


def injected(content: Column) -> Column:
    """Array of structs (owner, type): constructor dependencies; empty for a null text."""
    ship()
    return F.arrow_udf(_typed, _TYPED)(content)
