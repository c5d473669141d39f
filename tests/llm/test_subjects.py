import random

from tessera.llm import subjects
from tessera.llm.setjoin import similar_classes
from tessera.llm.subjects import SIMILAR, composition, plain, sentences_of, subject_areas

DOC = "doc_id bigint, text string, word string, sid string, score double"
LABEL = "doc_id bigint, subject string, reader string, labels string"
SUBJECTS = {
    "law": ("judge court verdict clause appeal".split(), "rules sues amends".split()),
    "sport": ("coach league medal match keeper".split(), "wins trains tackles".split()),
    "cooking": ("oven soup garlic dough pan".split(), "fries boils bakes".split()),
}
EVERYDAY = "cat door garden letter clock song umbrella child".split()
VERBS = "likes follows needs checks waits".split()


def sentence(rng, subject):
    if subject:
        nouns, verbs = SUBJECTS[subject]
        a, b = rng.sample(nouns, 2)
        verb = rng.choice(verbs + VERBS[:2])
    else:
        a, verb, b = rng.choice(EVERYDAY), rng.choice(VERBS), rng.choice(EVERYDAY + [w for n, _ in SUBJECTS.values() for w in n[:2]])
    text = f"the {a} {verb} the {b}"
    return rng.choice([f"People say that {text}.", f"{text} in spring.", f"Is it true that {text}?"])


def corpus(n, seed=1):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        chosen = [rng.choice([None, None, *SUBJECTS]) for _ in range(rng.randint(1, 3))]
        truth[i] = {c for c in chosen if c}
        docs.append((i, " ".join(sentence(rng, c) for c in chosen), "w", "s", 0.0))
        if i % 5 == 0:
            labels += [(i, s, "r", "x") for s in truth[i]] or [(i, None, "r", "x")]
    return docs, truth, labels


def areas(spark, names=tuple(SUBJECTS)):
    return spark.createDataFrame([(n, "d", 1.0) for n in names], "subject string, description string, score double")


def test_held_out_documents(spark):
    docs, truth, labels = corpus(1800)
    extra = [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "...", None, None, None), (5003, "word " * 30_000, None, None, None), docs[1]]
    df = spark.createDataFrame(docs + extra, DOC)
    got = {}
    rows = subject_areas(df, spark.createDataFrame(labels + labels[:9] + [(99_999, "law", "r", "x"), (5, "astrology", "r", "x")], LABEL), areas(spark)).collect()
    assert len(rows) == len({(r.doc_id, r.subject) for r in rows})
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert not {5000, 5001, 5002} & set(got)
    held = [i for i in truth if i % 5]
    hit = sum(len(truth[i] & got.get(i, set())) for i in held)
    f1 = 2 * hit / (sum(len(truth[i]) for i in held) + sum(len(got.get(i, ())) for i in held))
    assert f1 > 0.9
    assert any(len(v) > 1 for v in got.values())
    found = spark.createDataFrame([(i, s) for i, v in got.items() for s in v], "doc_id bigint, subject string")
    counts = {r.subject: r.n_documents for r in composition(found, areas(spark, (*SUBJECTS, "travel"))).collect()}
    assert counts["travel"] == 0 and counts["law"] == sum("law" in v for v in got.values())


def test_stretch_without_sentence_ends_keeps_its_subjects(spark):
    docs, _, labels = corpus(1800)
    rng, want = random.Random(2), {}
    for i in range(30):
        want[7000 + i] = set(rng.sample(list(SUBJECTS), 2))
        docs.append((7000 + i, "\n".join(" ".join(rng.sample(SUBJECTS[s][0], 3)) for s in sorted(want[7000 + i])), "w", "s", 0.0))
    got = {}
    for r in subject_areas(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), areas(spark)).filter("doc_id >= 7000").collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i) == w for i, w in want.items()) >= 27


def test_edges_are_verified_and_labels_cross_nothing_else(spark, monkeypatch):
    kept = {}
    real = subjects.propagated
    monkeypatch.setattr(subjects, "propagated", lambda nodes, edges, given, k, rounds: kept.update(nodes=nodes.collect(), edges=edges.collect()) or real(nodes, edges, given, k, rounds))
    made = []
    monkeypatch.setattr(subjects, "similar_classes", lambda sets, t, n: made.append(sets.collect()) or similar_classes(sets, t, n))
    docs, _, labels = corpus(300)
    subject_areas(spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL), areas(spark), passes=1).count()
    items = {frozenset(r["items"]) for r in made[0]}
    want = sum(len(a & b) >= SIMILAR * len(a | b) - 1e-12 for a in items for b in items if a != b)
    assert len(kept["nodes"]) == len(items) and len(kept["edges"]) == want > 0
    assert all(e.similarity >= SIMILAR for e in kept["edges"])


def test_no_labels_no_areas_no_documents(spark):
    docs, _, labels = corpus(20)
    df, given = spark.createDataFrame(docs, DOC), spark.createDataFrame(labels, LABEL)
    assert subject_areas(df, given.limit(0), areas(spark)).count() == 0
    assert subject_areas(df, given, areas(spark).limit(0)).count() == 0
    assert subject_areas(df.limit(0), given, areas(spark)).count() == 0


def test_sentences():
    assert plain("Nu\u0301mero E\u0301TE\u0301") == "n\u00famero \u00e9t\u00e9"
    assert sentences_of("The cat sat. The cat sat! Hm. ¿Es verdad?") == ["the cat sat", "es verdad"]
