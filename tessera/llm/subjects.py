"""Subject areas of documents by label propagation over a verified similarity graph.

A document is about a subject where one of its sentences is, so the graph's
nodes are sentences, and a document has the subjects of all its sentences.

1. *Content.*  A word belongs to a sentence's content when the readers' labels
   of the documents that hold it lean towards a subject (``LEAN``).  Content
   words that nearly always come together (names, compounds) are one term.  A
   sentence with fewer than two terms proves nothing, since a subject's word
   may be merely mentioned; it is no node.  A set phrase of ``PHRASE`` words or
   more that always come together counts word by word.  Sentences with the same
   content are one node.
2. *Edges.*  Two nodes are linked when the Jaccard similarity of their content
   is at least ``SIMILAR``.  Candidates come from banded minwise hashing, every
   edge is verified exactly (``setjoin``), no partner is dropped.
3. *Propagation.*  Each round joins the edges with the subjects of their
   sources and averages them, by similarity, at their targets.  Readers' labels
   stay clamped: a labelled node keeps a share of its votes that grows with
   their number.  A reader labels a document, not a sentence, so each subject of
   a labelled document goes to the sentence that the graph supports best; the
   others may take only subjects that the reader gave.  This is judged anew in
   the first ``JUDGED`` rounds.  Rounds end when the accepted subjects of at most
   ``SETTLED`` of the nodes change (``rounds`` bounds them).
4. *Result.*  A node has every subject with at least ``ACCEPT`` of its score; one
   that joins several subjects, with two terms of its own for each, has those
   with half of that.

The words that lean are learned from the labels first.  Where labels are few
they miss much, so the accepted sentences are taken as weak labels and the
steps are repeated until the words stay nearly the same (``SAME``), at most
``PASSES`` times.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.setjoin import similar_classes
from tessera.operators.skew import SHARE, hot_keys, salt_of, salts_of, spread_join
from tessera.sources.ship import ship
from tessera.sources.tables import drop, stage

#: Smoothed share of a word's labels that leans towards a subject, and the weight of what is expected of any word.
LEAN, PRIOR = 0.3, 2.0
#: Content words at most so far apart that come together in more than this share of the rarer one's sentences are one term; words of a set phrase.
NEAR, TOGETHER, PHRASE = 2, 0.6, 5
#: Similarity of linked nodes.
SIMILAR = 1 / 3
#: Share of its votes that a labelled node keeps at most, votes at which it keeps half of that.
CLAMP, HALF = 0.8, 1.5
#: Rounds that judge anew which sentence a label belongs to; score from which a sentence takes a label beside the best one.
JUDGED, TAKES = 2, 0.3
#: Score from which a subject belongs to the result.
ACCEPT = 0.4
#: Share of nodes whose accepted subjects may still change at the end; rounds at most.
SETTLED, ROUNDS = 0.005, 40
#: Passes at most, likeness of the words of two passes that ends them, weight of an accepted sentence as a label, prior of a subject then.
PASSES, SAME, GUESS, RARE = 3, 0.9, 0.15, 0.05

_SENTENCE = regex.compile(r"[^.!?…。！？]+")
_WORD = regex.compile(r"\p{L}+")


def plain(text: str) -> str:
    """Lower case with composed accents, however they are encoded."""
    return unicodedata.normalize("NFC", text.lower())


def sentences_of(text: str) -> list[str]:
    """The sentences of a text as words, each word once; of at least two words."""
    out = []
    for part in _SENTENCE.findall(plain(text)):
        words = list(dict.fromkeys(_WORD.findall(part)))
        if len(words) > 1:
            out.append(" ".join(words))
    return list(dict.fromkeys(out))


def _split(texts: pa.Array) -> pa.Array:
    return pa.array([sentences_of(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))


def said_by(documents: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, words) and (sid, words), both staged: who says which sentence, and each sentence once.

    Sentences are known by 128-bit hashes, words by 64-bit ones.
    """
    ship()
    split = F.arrow_udf(_split, T.ArrayType(T.StringType()))
    rows = documents.select(F.col(key).alias("doc_id"), F.explode(split(F.col(text))).alias("sentence"))
    said = stage(rows.select("doc_id", F.unhex(F.md5("sentence")).alias("sid"), F.transform(F.split("sentence", " "), lambda w: F.xxhash64(w)).alias("words")), "said")
    return said, stage(said.select("sid", "words").dropDuplicates(["sid"]), "sentences")


def leaning(labels: DataFrame, k: int) -> DataFrame:
    """(word, n, best): the words that lean towards a subject, staged.

    ``labels`` has words, weight, y (array<double>: how much of the weight each
    of the ``k`` subjects has) and prior (array<double>, the same in all rows).
    """
    sums = [F.sum(F.col("y")[i]).alias(f"y{i}") for i in range(k)]
    priors = [F.max(F.col("prior")[i]).alias(f"p{i}") for i in range(k)]
    heard = labels.select(F.explode("words").alias("word"), "weight", "y", "prior").groupBy("word").agg(F.sum("weight").alias("n"), *sums, *priors)
    shares = F.array(*[F.struct(((F.col(f"y{i}") + PRIOR * F.col(f"p{i}")) / (F.col("n") + PRIOR)).alias("share"), F.lit(-i).alias("i")) for i in range(k)])
    top = heard.select("word", "n", F.array_max(shares).alias("top")).filter(F.col("top.share") >= LEAN)
    return stage(top.select("word", "n", (-F.col("top.i")).alias("best")), "leaning")


def _terms(words: list[int], bests: list[int], glued: list[bool]) -> tuple[list[str], list[int]] | None:
    """(items, own) of the content words of a sentence, each with its subject and whether it is one term with the word before; None where they prove nothing."""
    runs: list[list[int]] = []
    subjects = []
    for word, best, more in zip(words, bests, glued, strict=True):
        if more and runs:
            runs[-1].append(word)
        else:
            runs.append([word])
            subjects.append(best)
    if len(runs) < 2 and len(runs[0]) < PHRASE:
        return None
    items = [str(w) for run in runs for w in (run if len(run) >= PHRASE else ["_".join(map(str, run))])]
    own = sorted(b for b, n in Counter(subjects).items() if n > 1)
    return items, own if len(own) > 1 else []


def _composed(contents: pa.Array) -> pa.Array:
    if isinstance(contents, pa.ChunkedArray):
        contents = contents.combine_chunks()
    lengths = contents.value_lengths().to_numpy(zero_copy_only=False)
    pos, word, best, glued = (x.to_numpy(zero_copy_only=False) for x in contents.flatten().flatten())
    order = np.lexsort((pos, np.repeat(np.arange(len(lengths)), lengths)))
    word, best, glued = word[order].tolist(), best[order].tolist(), glued[order].tolist()
    rows, a = [], 0
    for n in lengths:
        found = _terms(word[a : a + n], best[a : a + n], glued[a : a + n])
        rows.append({"items": found[0] if found else None, "own": found[1] if found else None})
        a += n
    return pa.array(rows, pa.struct([("items", pa.list_(pa.string())), ("own", pa.list_(pa.int32()))]))


def contents(sentences: DataFrame, words: DataFrame) -> DataFrame:
    """(sid, items, own): the content of the sentences that have two terms or a set phrase.

    ``own`` lists the subjects that two terms or more lean to, where there are
    several.  A word may be in a third of all sentences: its rows are spread.
    """
    each = sentences.select("sid", F.posexplode("words").alias("pos", "word"))
    n = words.agg(F.sum("n")).first()[0] or 0
    hot = [r.word for r in words.filter(F.col("n") * SHARE > n).select("word").collect()]  # fewer than SHARE
    order = Window.partitionBy("sid").orderBy("pos")
    kept = spread_join(each, words.select("word", "best"), "word", hot, "sid")
    before = F.lag(F.struct("word", "pos")).over(order)
    kept = stage(kept.withColumn("last", before).select("sid", "pos", "word", "best", F.when(F.col("pos") - F.col("last.pos") <= NEAR, F.col("last.word")).alias("left")), "kept")
    often = kept.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    pairs = kept.filter("left IS NOT NULL").groupBy("left", "word").agg(F.count(F.lit(1)).alias("both")).filter("both > 1")
    pairs = pairs.join(often, "word").join(often.select(F.col("word").alias("left"), F.col("n").alias("n_left")), "left")
    glued = stage(pairs.filter(F.col("both") > TOGETHER * F.least("n", "n_left")).select("left", "word", F.lit(True).alias("glued"), "both"), "glued")
    hot = [r.word for r in glued.filter(F.col("both") * SHARE > n).select("word").distinct().collect()]  # fewer than SHARE
    runs = kept.withColumn("_salt", salt_of(F.col("word"), hot, F.col("sid"))).join(glued.drop("both").withColumn("_salt", salts_of(F.col("word"), hot)), ["left", "word", "_salt"], "left")
    whole = runs.groupBy("sid").agg(F.collect_list(F.struct("pos", "word", "best", F.coalesce("glued", F.lit(False)).alias("glued"))).alias("ws"))
    ship()
    composed = F.arrow_udf(_composed, "struct<items: array<string>, own: array<int>>")
    return stage(whole.select("sid", composed("ws").alias("c")).select("sid", "c.items", "c.own").filter("items IS NOT NULL"), "contents")


def _votes(given: DataFrame, scores: DataFrame | None, k: int, hot: list) -> DataFrame:
    """(cls, votes, v0...): for each node of labelled documents its votes for each subject.

    ``given`` has doc_id, cls and labels, one row for each node that a labelled
    document holds; ``scores`` has cls and f (array of scores); ``hot`` are the
    hot nodes of ``given``.
    """
    each = given.withColumn("label", F.explode_outer("labels")).withColumn("part", 1 / F.greatest(F.size("labels"), F.lit(1)))
    if scores is None:
        of = Window.partitionBy("doc_id", "label")
        alone = (F.count(F.lit(1)).over(of) == 1) & (F.size("labels") == 1)
        each = each.withColumn("mass", F.when(F.col("label").isNull(), 0.0).when(alone, 1.0).otherwise(0.6 * F.col("part")))
    else:
        each = spread_join(each, scores.select("cls", "f"), "cls", hot, "doc_id", "left").withColumn("score", F.coalesce(F.get("f", F.col("label")), F.lit(0.0)))
        best = F.row_number().over(Window.partitionBy("doc_id", "label").orderBy(F.col("score").desc(), "cls")) == 1
        strong = (F.col("score") > TAKES) & (F.col("score") == F.array_max("f"))
        each = each.withColumn("mass", F.when(F.col("label").isNotNull() & (best | strong), 1.0).otherwise(0.0))
    return each.groupBy("cls").agg(F.sum("part").alias("votes"), *[F.sum(F.when(F.col("label") == i, F.col("mass")).otherwise(0.0)).alias(f"v{i}") for i in range(k)])


def _accepted(own: Column, f: Column) -> Column:
    """array<int>: the subjects of a node."""
    with_i = F.transform(f, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    return F.transform(F.filter(with_i, lambda s: (s["x"] >= ACCEPT) | (F.array_contains(own, s["i"]) & (s["x"] >= ACCEPT / 2))), lambda s: s["i"])


def propagated(nodes: DataFrame, edges: DataFrame, given: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """(cls, f, accepted): scores of the k subjects and the accepted ones, of each node that labels reach; staged.

    ``nodes`` has cls and own, ``edges`` cls (target), from (source) and similarity in both directions.
    """
    state, clamps, hot = None, None, hot_keys(given, "cls", given.count())
    none = F.array().cast("array<int>")

    def step(now: DataFrame) -> DataFrame:
        told = edges.join(now.select(F.col("cls").alias("from"), "f"), "from")
        heard = told.groupBy("cls").agg(F.sum("similarity").alias("s"), *[F.sum(F.col("similarity") * F.col("f")[i]).alias(f"h{i}") for i in range(k)])
        keeps = F.when(F.col("s").isNull(), 1.0).otherwise(CLAMP * F.col("votes") / (F.col("votes") + HALF))
        mean, voted = [F.col(f"h{i}") / F.col("s") for i in range(k)], [F.col(f"v{i}") / F.col("votes") for i in range(k)]
        f = [F.when(F.col("votes").isNull(), m).otherwise(keeps * v + (1 - keeps) * F.coalesce(m, F.lit(0.0))) for m, v in zip(mean, voted, strict=True)]
        return nodes.join(heard, "cls", "left").join(clamps, "cls", "left").filter("s IS NOT NULL OR votes IS NOT NULL").select("cls", "own", F.array(*f).alias("f"))

    for r in range(rounds):
        judges = r <= JUDGED
        if judges:
            before, clamps = clamps, stage(_votes(given, state, k, hot), "clamps")
            drop(before)
        if state is None:
            state = clamps.select("cls", F.array(*[F.col(f"v{i}") / F.col("votes") for i in range(k)]).alias("f"), none.alias("accepted"))
        after = step(state)
        after = after.join(state.select("cls", F.col("accepted").alias("was")), "cls", "left").withColumn("accepted", _accepted(F.col("own"), F.col("f")))
        after = after.select("cls", "f", "accepted", (~F.col("accepted").eqNullSafe(F.coalesce("was", none))).alias("changed"))
        new = stage(after, "state")
        drop(state)
        state = new
        if not judges:
            n, changed = state.agg(F.count(F.lit(1)), F.count_if("changed")).first()
            if changed <= SETTLED * n:
                break
    drop(clamps)
    return state


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS, passes: int = PASSES) -> DataFrame:
    """(doc_id, subject, score): the subjects of each document.

    ``labels`` has ``key`` and subject (null: the reader found none); subjects
    outside ``areas`` count as none.  ``areas`` is a fixed list and has subject.

    * A null or empty text, or one without a sentence of two words, has no
      subjects; nor has any document where no label gives a subject.
    * Several readers' subjects of one document are all kept; repeated labels
      count once.  Labels of unknown documents are ignored.
    * Rows with the same key are one document.  Other columns are ignored.
    * A sentence may have several subjects; equally supported ones are all kept
      or all left out.
    """
    subjects = sorted(r.subject for r in areas.filter("subject IS NOT NULL").select("subject").distinct().collect())  # the fixed list of areas
    spark, k = documents.sparkSession, len(subjects)
    nothing = T.StructType([T.StructField("doc_id", documents.schema[key].dataType), T.StructField("subject", T.StringType()), T.StructField("score", T.DoubleType())])
    if not subjects:
        return spark.createDataFrame([], nothing)
    said, sentences = said_by(documents, key, text)
    index = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(i))])
    read = labels.select(F.col(key).alias("doc_id"), F.when(F.col("subject").isin(subjects), index[F.col("subject")]).alias("i"))
    read = stage(read.groupBy("doc_id").agg(F.sort_array(F.collect_set("i")).alias("labels")), "read")
    marked = stage(said.join(read, "doc_id").dropDuplicates(["doc_id", "sid"]), "marked")
    counts = read.join(marked.select("doc_id").distinct(), "doc_id", "left_semi").select(*[F.avg(F.array_contains("labels", i).cast("double")) for i in range(k)]).first()
    if not any(counts):
        return spark.createDataFrame([], nothing)
    hot = hot_keys(marked, "sid")
    none = F.array().cast("array<int>")
    shares = lambda of: F.array(*[F.array_contains(of, i).cast("double") for i in range(k)])
    fixed = lambda values: F.array(*[F.lit(float(x)) for x in values])
    words = leaning(marked.select("words", F.lit(1.0).alias("weight"), shares(F.col("labels")).alias("y"), fixed(counts).alias("prior")), k)

    for done in range(1, passes + 1):
        found = contents(sentences, words)
        graph = similar_classes(found.select(F.lit("s").alias("set_name"), F.col("sid").alias("id"), "items"), SIMILAR, 2)
        of = stage(graph.members.select(F.col("id").alias("sid"), "cls").join(found.select("sid", "own"), "sid"), "of")
        nodes = stage(of.groupBy("cls").agg(F.first("own").alias("own")), "nodes")
        pairs = stage(graph.pairs, "pairs")
        edges = stage(pairs.select(F.col("cls_a").alias("cls"), F.col("cls_b").alias("from"), "similarity").unionAll(pairs.select(F.col("cls_b").alias("cls"), F.col("cls_a").alias("from"), "similarity")), "edges")
        given = stage(spread_join(marked.select("doc_id", "sid", "labels"), of.select("sid", "cls"), "sid", hot, "doc_id").select("doc_id", "cls", "labels"), "given")
        state = propagated(nodes, edges, given, k, rounds)
        drop(found, nodes, pairs, edges, given)
        judged = stage(of.join(state.select("cls", "f", "accepted"), "cls").filter(F.size("accepted") > 0).select("sid", "f", "accepted"), "judged")
        drop(of, state)
        if done == passes:
            break
        # sentences of labelled documents take only the reader's subjects, and those of which no sentence was accepted
        mine = spread_join(marked, judged.select("sid", "accepted"), "sid", hot, "doc_id", "left").withColumn("accepted", F.coalesce("accepted", none))
        met = F.array_distinct(F.flatten(F.collect_list("accepted").over(Window.partitionBy("doc_id"))))  # as long as the document
        takes = F.when(F.size("accepted") > 0, F.array_intersect("accepted", "labels")).otherwise(F.array_except("labels", "met"))
        firm = mine.withColumn("met", met).select("words", F.lit(1.0).alias("weight"), shares(takes).alias("y"))
        told = judged.select("sid", "accepted", F.lit(False).alias("marked")).unionByName(marked.select("sid", none.alias("accepted"), F.lit(True).alias("marked")))
        told = told.groupBy("sid").agg(F.max("marked").alias("marked"), F.flatten(F.collect_set("accepted")).alias("accepted"))
        weak = sentences.join(told, "sid", "left").filter("marked IS NULL OR NOT marked")
        weak = weak.select("words", F.lit(GUESS).alias("weight"), F.transform(shares(F.coalesce("accepted", none)), lambda x: x * GUESS).alias("y"))
        more = leaning(firm.unionByName(weak).withColumn("prior", fixed([RARE] * k)), k)
        same, size, size_now = more.join(words.select("word"), "word").count(), words.count(), more.count()
        if same >= SAME * (size + size_now - same):
            drop(more)
            break
        drop(words, judged)
        words = more
    drop(words, marked, read, sentences)
    name = F.create_map(*[x for i, s in enumerate(subjects) for x in (F.lit(i), F.lit(s))])
    taken = judged.select("sid", F.explode("accepted").alias("i"), "f").select("sid", name[F.col("i")].alias("subject"), F.get("f", F.col("i")).alias("score"))
    # a third of the documents may hold one sentence
    pairs = said.select("doc_id", "sid")
    return spread_join(pairs, taken, "sid", hot_keys(pairs, "sid"), "doc_id").groupBy("doc_id", "subject").agg(F.max("score").alias("score"))


def composition(found: DataFrame, areas: DataFrame) -> DataFrame:
    """(subject, n_documents): how many documents each area has; zero for areas without any."""
    counts = found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n"))
    return areas.select("subject").join(counts, "subject", "left").select("subject", F.coalesce("n", F.lit(0)).alias("n_documents"))
