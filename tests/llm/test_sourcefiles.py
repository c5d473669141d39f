import hashlib
import random

import numpy as np

from tessera.llm.sourcefiles import CUT, FEATURES, foreign_files, measure

FILE = "file_id bigint, repo string, content string, sha256 string, label string, x int"
INDEX = "content string, sha256 string, pkg string"
WORDS = "river stone amber cloud window garden paper lantern copper island".split()


def sha(t):
    return None if t is None else hashlib.sha256(t.encode()).hexdigest()


def own(rng, header):
    body = "".join(f"  void load{rng.choice(WORDS).title()}{rng.choice(WORDS).title()}(String text) {{\n    if (busy) return;\n    notifyListeners();\n  }}\n" for _ in range(rng.randint(3, 9)))
    name = "".join(w.title() for w in rng.sample(WORDS, 3))
    return f"{header}import 'package:shop_app/core/x.dart';\n\nclass {name}Page extends Widget {{\n{body}}}\n"


def made(rng, header):
    n = rng.randint(8, 20)
    return header + "class RiverDto {\n" + "".join(f"  final int? field_{i:03d};\n" for i in range(n)) + "  int get hashCode => " + " ^ ".join(f"field_{i:03d}.hashCode" for i in range(n)) + ";\n}\n"


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows, truth = [], {}
    for i in range(240):
        bad, named = i % 3 == 0, i % 2 == 0
        text = made(rng, "// GENERATED CODE - hands off\n" * named) if bad else own(rng, "// Copyright 2024 the shop team.\n" * named)
        rows.append((i, None if i % 11 == 0 else "x-shop-app", text, sha(text), "clash", 1))
        truth[i] = bad
    rows += [(900, "r", None, None, None, None), (901, "r", "", sha(""), None, None), rows[3], (902, "x-shop-app", own(rng, "") * 200, "big", "", 0)]
    third = own(rng, "// known\n")
    rows.append((903, "x-shop-app", third, sha(third), None, None))
    index = [(third, sha(third), "p"), (None, None, None)]
    got = foreign_files(spark.createDataFrame(rows, FILE), spark.createDataFrame(index, INDEX)).collect()
    by = {r.file_id: r for r in got}
    assert len(got) == len(rows) - 1 and 900 not in by and by[903].known
    hidden = [i for i in truth if i % 2]
    assert sum((by[i].score >= CUT) == truth[i] for i in hidden) >= 0.97 * len(hidden)


def test_no_labels_and_empty(spark):
    index = spark.createDataFrame([], INDEX)
    rows = [(1, "r", "class A {}\n", "s", None, None)]
    assert [(r.file_id, r.score, r.known) for r in foreign_files(spark.createDataFrame(rows, FILE), index).collect()] == [(1, None, False)]
    assert foreign_files(spark.createDataFrame([], FILE), index).count() == 0


def test_notices_are_hidden():
    body = "class A {\n  int x = 3;\n}\n"
    plain, label = measure(body, "r")
    assert label is None and len(plain) == len(FEATURES)
    assert measure("// Copyright 2021 the x team.\n" + body, "r") == (plain, 0.0)
    assert measure("/* SPDX-License-Identifier: q */\n\n" + body, "r") == (plain, 1.0)
    assert measure("// import 'package:other/y.dart';\n/* import 'package:z/y.dart'; */\n" + body, "r") == (plain, None)
    assert measure("import 'package:other/y.dart';\n" + body, "r")[0][FEATURES.index("foreign_imports")] == 1
    assert len(measure("", None)[0]) == len(FEATURES) == len(measure("'" * 100_000 + "é", "r")[0])


def test_headers_and_comments_of_any_length(spark):
    body = "class A {\n  int x = 3;\n}\n"
    texts = ["// line of a long licence\n" * 100_000 + body, "/* " + "words " * 1_700_000 + "*/\n" + body, "/* open " + "/* " * 200_000, "// only comments\n" * 50_000]
    rows = [(i, "r", t, sha(t), None, None) for i, t in enumerate(texts)]
    got = foreign_files(spark.createDataFrame(rows, FILE), spark.createDataFrame([], INDEX)).collect()
    by = {r.file_id: list(r.x) for r in got}
    assert len(by) == 4 and by[0] == by[1] == [float(np.float32(v)) for v in measure(body, "r")[0]]


def test_mere_data_is_a_label():
    assert measure("const a = <int>[\n" + "  0x01, 0x02,\n" * 40 + "];\n", "r")[1] == 1.0
    assert measure("// Copyright 2021 the x team.\nconst a = <int>[\n" + "  0x01, 0x02,\n" * 40 + "];\n", "r")[1] == 0.0
