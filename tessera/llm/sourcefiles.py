"""Generated, minified, third-party and data files among scanned sources.

A random forest decides.  Its features are shape only: how well the code
compresses, the entropy of its tokens, lengths and make-up of identifiers,
comment density, lines, literals and repetition.  Its labels come from header
notices, which the features never see: comments are cut out of the code
before anything is measured, and the header doesn't count in the density.

* positive: a notice of a generator, of a third party's licence or of a
  bundler;
* negative: a team's own copyright line;
* positive too, where the header says nothing: a body that is one long literal
  given to a name.  Files of mere data carry no notices, so a forest of notices
  alone has never seen one and finds none of them; this label stands in.

The forest is fitted on at most ``LABELLED`` rows of each class, drawn by a
hash; every file is scored.  Afterwards an exact check adds files whose hash
is in the third-party index, should the forest have missed one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.ship import ship
from tessera.sources.tables import stage

#: Most labelled rows of one class that the forest is fitted on.
LABELLED = 4000
TREES, DEPTH, SEED, CUT = 24, 8, 5, 0.7

#: Notices of generators, bundlers and third parties, in the words that such headers use.
FOREIGN = (
    r"(?i)generated code|code generated|auto-?generated|@generated|automatically (created|generated) (from|by)|"
    r"(produced|created|written) by (a builder|\w+ [0-9.]+)|do not edit: |machine output|"
    r"tự động từ|maschinell erzeugt|automatisch (erzeugt|generiert)|generado (automáticamente|por)|archivo generado|"
    r"spdx-license-identifier|upstream: |permission to (copy|use)|use of this source|all rights reserved|^\s*/\*!"
)
#: A team's own copyright line.
OWN = r"(?i)copyright \d+ the [\w-]+ team"

FEATURES = (
    "compression", "entropy", "distinct_tokens", "ident_length", "ident_short", "ident_words", "ident_numbered", "comments",
    "line_mean", "line_max", "number_tokens", "digit_chars", "string_chars", "symbol_tokens", "common_line", "distinct_lines",
    "returns", "arrows", "foreign_imports", "capital_names", "log_length", "bare_calls",
)

#: A header: comments, blank lines and imports before anything else.
HEAD = r"(?:\s*(?://[^\n]*(?:\n|\Z)|/\*(?s:.*?)\*/|(?:import|export|part|library)\b[^\n;]*;))*"
#: A file of data has at most so many names, and at least so many characters.
DATA_NAMES, DATA_LENGTH = 5, 200

_HEADER, _FOREIGN, _OWN = re.compile(HEAD), re.compile(FOREIGN), re.compile(OWN)
_COMMENT = re.compile(r"('(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\")|//[^\n]*|/\*(?:.*?\*/|.*)", re.S)  # an open comment goes to the end
_TOKEN = re.compile(r"'''.*?'''|[A-Za-z_$][\w$]*|\d[\w.]*|'[^'\n]*'|\"[^\"\n]*\"|[^\s\w]", re.S)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_PACKAGE = re.compile(r"import '([\w:./-]*)'|from '([\w./-]*)'")
_DROP_NAMES = {c: None for c in range(128) if chr(c).isalnum() or chr(c) in "_$ \t\r"}


def _code(text: str) -> str:
    return _COMMENT.sub(lambda m: m[1] or "", text) if "//" in text or "/*" in text else text


def notice(header: str) -> float | None:
    """1 for a foreign notice in the header, 0 for a team's own, none for neither or both."""
    foreign, own = _FOREIGN.search(header) is not None, _OWN.search(header) is not None
    return None if foreign == own else float(foreign)


def measure(content: str, repo: str | None = None) -> tuple[list[float], float | None]:
    """The features of one file, in the order of ``FEATURES``, and the label that its header gives.

    The header is read in Python: its pattern, unlike Java's, takes no stack
    for repetitions, so a header may have any number of lines.
    """
    head = _HEADER.match(content)[0]
    body = content[len(head) :].lstrip()
    code, said = _code(body), notice(head)
    tokens = _TOKEN.findall(code) or ["."]
    n = len(tokens)
    counts = Counter(tokens)
    entropy = -sum(c * math.log(c / n) for c in counts.values()) / n / math.log(max(n, 2))
    names = {t: c for t, c in counts.items() if t[0].isalpha() or t[0] in "_$"}
    uses = sum(names.values()) or 1
    unlike = len(names) or 1
    numbers = sum(c for t, c in counts.items() if t[0].isdigit())
    strings = sum((len(t) - 2) * c for t, c in counts.items() if t[0] in "'\"")
    lines = [x for x in code.split("\n") if x and not x.isspace()] or ["."]
    shapes = Counter([x.translate(_DROP_NAMES) for x in lines])
    raw = code.encode("utf-8", "replace")
    size = max(len(code), 1)
    own = (repo or "").split("-", 1)[-1].replace("-", "_")
    imports = [a or b for a, b in _PACKAGE.findall(_code(head))]
    foreign = sum(1 for x in imports if x.startswith("package:") and own and not x[8:].startswith(own))
    return [
        len(zlib.compress(raw, 1)) / max(len(raw), 1),
        entropy,
        len(counts) / n,
        sum(map(len, names)) / unlike,
        sum(c for t, c in names.items() if len(t) <= 2) / uses,
        sum(len(_WORDS.findall(t)) for t in names) / unlike,
        sum(1 for t in names if t[-1].isdigit()) / unlike,
        (len(body) - len(code)) / max(len(body), 1),
        size / len(lines),
        max(map(len, lines)),
        numbers / n,
        sum(map(code.count, "0123456789")) / size,
        strings / size,
        (n - uses - numbers) / n,
        max(shapes.values()) / len(lines),
        len(shapes) / len(lines),
        (counts.get("return", 0) + counts.get("this", 0)) / len(lines),
        code.count("=>") / len(lines),
        foreign,
        sum(1 for t in names if t[0].isupper()) / unlike,
        math.log(size),
        code.count("();") / len(lines),
    ], 1.0 if said is None and sum(names.values()) <= DATA_NAMES and len(code) >= DATA_LENGTH else said


def _measured(content: pa.Array, repo: pa.Array) -> pa.Array:
    rows = [(None, None) if text is None else measure(text, name) for text, name in zip(content.to_pylist(), repo.to_pylist(), strict=True)]
    x, label = pa.array([r[0] for r in rows], pa.list_(pa.float32())), pa.array([r[1] for r in rows], pa.float64())
    return pa.StructArray.from_arrays([x, label], names=["x", "label"])


def features(content: str, repo: str) -> Column:
    """``measure`` of each file as (x, label); null values for a null content."""
    ship()
    return F.arrow_udf(_measured, "struct<x: array<float>, label: double>")(content, repo)


def fit(labelled: DataFrame, bound: int = LABELLED) -> RandomForestClassificationModel | None:
    """A forest over (features array, label); None where a class is absent.

    At most about ``bound`` rows of each class are used, by a hash of the
    features; classes weigh the same.
    """
    n = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(0.0) or not n.get(1.0):
        return None
    rate = F.when(F.col("label") == 1, min(1.0, bound / n[1.0])).otherwise(min(1.0, bound / n[0.0]))
    kept = {k: min(v, bound) for k, v in n.items()}
    rows = labelled.filter(F.pmod(F.xxhash64("x"), F.lit(1 << 20)) < rate * (1 << 20)).select(
        array_to_vector(F.col("x").cast("array<double>")).alias("features"),
        "label",
        F.when(F.col("label") == 1, 1.0 / kept[1.0]).otherwise(1.0 / kept[0.0]).alias("weight"),
    )
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", minInstancesPerNode=3, featureSubsetStrategy="onethird")
    return forest.fit(rows.coalesce(2))


def foreign_files(files: DataFrame, index: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(file_id, score, known): every file with content; known marks exact copies of the index.

    ``files`` has file_id, repo, content, sha256; ``index`` content, sha256.

    * A null content has no row; an empty one has the features of no code.
    * Rows of a file scanned twice each get a row, with equal scores for equal
      content and repo.
    * A null repo makes no import foreign.
    * Without labels of both classes there is no forest: scores are null and
      only the exact check remains.
    """
    measured = files.filter("content IS NOT NULL").select("file_id", "sha256", features("content", "repo").alias("m"))
    x = stage(measured.select("file_id", "sha256", "m.label", "m.x"), "features")
    model = fit(x.filter("label IS NOT NULL").select("x", "label"), bound)
    if model is None:
        scored = x.withColumn("score", F.lit(None).cast("double"))
    else:
        v = model.setFeaturesCol("v").transform(x.withColumn("v", array_to_vector(F.col("x").cast("array<double>"))))
        scored = v.withColumn("score", vector_to_array("probability")[1])
    copies = index.filter("content IS NOT NULL").select("sha256").filter("sha256 IS NOT NULL").distinct().withColumn("known", F.lit(True))
    return scored.join(copies, "sha256", "left").select("file_id", "score", F.coalesce("known", F.lit(False)).alias("known"), "label", "x")
