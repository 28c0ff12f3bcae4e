"""Steps whose time or disk grew faster than their input."""

import glob
import os
import re

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from penprint.catalog import standins as si
from penprint.functions import trees as fn
from penprint.operators import features as ft, models as md, stylometry as st, trees as tr, vocabulary as vc
from penprint.operators.motifs import expand_motifs, head_bags, merge_motifs, motif_counts
from penprint.operators.parses import cache_rows, sentence_rows
from penprint.schemas import PARSES
from penprint.sinks import tables as sk
from penprint.sources import tables as stb


def _sentence(n: int, number: int = 1) -> dict:
    """A sentence of ``n`` words below the first."""
    words = [f"w{i}" for i in range(n)]
    ends = [len(" ".join(words[: i + 1])) for i in range(n)]
    return {
        "sent_id": number, "text": " ".join(words), "head": [0] * n,
        "pos": ["NOUN", "VERB"] * (n // 2) + ["ADJ"] * (n % 2), "dep": ["ROOT"] + ["obj"] * (n - 1),
        "lower": words, "start": [e - len(w) for e, w in zip(ends, words)], "end": ends,
    }


def _parses(spark, *sents):
    return spark.createDataFrame([(i, 0, "t", s) for i, s in enumerate(sents)], PARSES)


def test_json_cache_is_packed_and_reads_back(spark, tmp_path):
    parses = _parses(spark, [_sentence(40, k + 1) for k in range(50)])
    named = parses.select("*", *[F.lit(c).alias(c) for c in ("title", "author", "source_path")])
    cache = cache_rows(sentence_rows(named, ["title", "author", "source_path"]))
    packed, plain = str(tmp_path / "packed"), str(tmp_path / "plain")
    sk.write_parse_cache(cache, packed)
    sk.write_parse_cache(cache, plain, compression="none")
    size = lambda p: sum(map(os.path.getsize, glob.glob(f"{p}/part-*")))
    assert size(packed) * 8 < size(plain)
    key = lambda r: r.sentence_id
    back = [sorted(stb.read_parse_cache(spark, p).collect(), key=key) for p in (packed, plain)]
    assert back[0] == back[1] == sorted(cache.collect(), key=key)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _texts(spark):
    rows = [(i, f"some {i % 3} words are here and there, {i} of them") for i in range(40)]
    return spark.createDataFrame([*rows, (None, "some words"), (7, "words are"), (8, None)], "k bigint, text string")


def test_block_weights_take_the_norm_once(spark):
    texts = _texts(spark)
    fitted = st.fit_char_ngrams(texts)
    blocks = fitted.blocks(texts.where("k > 8"), "k")
    # The norm, a sum over the row, must not stand inside the function of each entry.
    plan = blocks._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sqrt(" in plan and not re.search(r"\.x / sqrt\(", plan)
    weights = {r.k: sorted(r.w) for r in fitted.transform(texts.where("k > 8"), "k").groupBy("k").agg(F.collect_list("weight").alias("w")).collect()}
    for row in blocks.collect():
        assert sorted(row.tfidf["values"]) == weights[row.k]
        assert abs(sum(v * v for v in weights[row.k]) - 1) < 1e-9


def test_grams_are_not_shuffled(spark):
    texts = _texts(spark)
    plan = _plan(st.fit_char_ngrams(texts).transform(texts, "k").groupBy("k").count())
    # The one exchange by key stands below the explode: it deals texts, not their grams.
    assert len(re.findall(r"Exchange hashpartitioning\(k#", plan)) == 1, plan
    assert plan.index("Exchange hashpartitioning(k#") > plan.rindex("Generate explode"), plan


def test_block_value_finds_and_misses(spark):
    block = F.struct(
        F.lit(9).alias("size"), F.array(F.lit(1), F.lit(4)).alias("indices"), F.array(F.lit(0.5), F.lit(2.0)).alias("values")
    )
    row = spark.range(1).select(*[vc.block_value(block, i).alias(f"v{i}") for i in (0, 1, 4, 8)]).first()
    assert tuple(row) == (0.0, 0.5, 2.0, 0.0)


def test_motifs_are_summed_without_a_shuffle(spark):
    parses = _parses(spark, [_sentence(5, 1), _sentence(7, 2)], [_sentence(6, 1)], [])
    counted = motif_counts(parses)
    # The bags are dealt once; their expansion, which is far larger, stays in place.
    assert len(re.findall(r"Exchange ", _plan(counted))) == 1
    assert "chunk_id" in re.search(r"Exchange hashpartitioning\(([^)]*)", _plan(counted)).group(1)
    per_text = merge_motifs(motif_counts(sentence_rows(parses), by=("text_id",)).withColumn("chunk_id", F.lit(0)))
    assert len(re.findall(r"Exchange ", _plan(per_text))) == 1
    plain = merge_motifs(expand_motifs(head_bags(parses)))
    assert sorted(counted.collect()) == sorted(per_text.collect()) == sorted(plain.collect())


def _stand_in(text):
    """The stand-in sentences of a text, word by word."""
    if text is None:
        return None
    found = []
    for number, piece in enumerate(re.split("\u0001", re.sub(r"([.!?]+)[ \t\n\x0b\f\r]+", "\\1\u0001", text)), 1):
        w = re.findall(r"\w+", piece)
        n = len(w)
        up = lambda i: max(i - 1, 0) // 4
        head = [n - 1 - up(n - 1 - i) if n % 2 else up(i) for i in range(n)]
        ends = [len(" ".join(w[: i + 1])) for i in range(n)]
        if w:
            found.append((
                number, " ".join(w), head, [si.POS[len(x) % 7] for x in w],
                ["ROOT" if h == i else si.DEP[i % 8] for i, h in enumerate(head)],
                [x.lower() for x in w], [e - len(x) for e, x in zip(ends, w)], ends,
            ))
    return found


ODD_TEXTS = [
    None, "", "...", " \n", "One. Two! three?", "a.\u0001b", ". . a", "end.\n\n\nNext? ! ok", "no end", "x.y z",
    "\u0391\u03a3 \u0391\u03a3. \u03a3 \u0391\u03a3.\u0392", "\u0130x Stra\u00dfe \u4e2d \uff11\uff12 _a", "\U0001d49cB \U0001f600 c.\u00a0d", "\x00a?\x85b",
    " ".join(f"w{i}" for i in range(501)), None, "last",
]


def test_stand_in_parse_is_made_in_batches(spark, tmp_path, monkeypatch):
    rows = [(None if i == 4 else i // 2, t, "s") for i, t in enumerate(ODD_TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for size in (1 << 20, 8):
        monkeypatch.setattr(si, "SLICE_BYTES", size)
        parses = si.parses(spark, str(tmp_path), "source")
        # No function per word in the plan; the words of a sentence are counted once.
        assert "MapInArrow" in _plan(parses) and "lambda" not in _plan(parses)
        got = [(r.text_id, r.text, r.sents and [tuple(s) for s in r.sents]) for r in parses.collect()]
        want = [(k, t, _stand_in(t)) for k, t, _ in rows]
        assert sorted(map(repr, got)) == sorted(repr((k, t, s and s)) for k, t, s in want)


def test_labels_are_made_outside_of_array_functions(spark):
    parses = _parses(spark, [_sentence(5, 1), _sentence(4, 2)], [], None)
    labelled = tr.labelled_tokens(parses, "mixed", ["w1"])
    assert not re.search(r"lambdafunction\([^\n]*pos:", _plan(labelled))
    assert labelled.columns == ["text_id", "chunk_id", "sent_id", "token_i", "lower", "label"]
    found = [(r.sent_id, r.token_i, r.label) for r in labelled.collect()]
    assert sorted(found)[:3] == [(1, 0, "pos:NOUN|dep:ROOT"), (1, 1, "tok:w1"), (1, 2, "pos:NOUN|dep:obj")]
    assert len(found) == 9


def test_clauses_are_counted_over_the_whole_chunk(spark):
    def sentence(*deps):
        return {**_sentence(len(deps)), "dep": list(deps)}

    parses = _parses(
        spark, [sentence("acl", "acl", "ccomp"), sentence("x", "acl")], [], None, [sentence("acl", None)]
    )
    counts, features = ft.clause_counts(parses), ft.chunk_features(parses)
    assert "lambda" not in _plan(counts) and "= acl" not in _plan(features)
    names = ("clause_acl_count", "clause_ccomp_count", "clause_relcl_count")
    of = lambda df: [tuple(r[n] for n in names) for r in df.orderBy("text_id").collect()]
    assert of(counts) == [(3, 1, 0), (0, 0, 0), (None,) * 3, (1, 0, 0)]
    assert of(features) == [(3, 1, 0), (0, 0, 0), (None,) * 3, (None,) * 3]


def test_climbing_ends_when_all_have_arrived(spark):
    def doubled(head):
        root, depth = head, [int(h != i) for i, h in enumerate(head)]
        at = lambda v, i: None if i is None or not 0 <= i < len(v) else v[i]
        for _ in range(max(len(head) - 2, 0).bit_length()):
            depth = [None if None in (d, at(depth, r)) else d + at(depth, r) for d, r in zip(depth, root)]
            root = [at(root, r) for r in root]
        return root, [d or 0 for d in depth]  # an unknown depth reads as 0

    # A chain, a star, two roots, circles, a head outside, all roots.
    heads = [[0, 0, 1, 2, 3, 4, 5, 6, 7], [3] * 7, [0, 0, 2, 2, 3], [1, 0, 0, 2, 3], [1, 2, 0, 3, 3, 4], [0, 9, 1, 2, 0], [0, 1, 2], [0], []]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, head array<int>")
    made = df.select("i", fn.climb(F.col("head")).alias("c"))
    assert "done" in made._jdf.queryExecution().analyzed().toString()
    for r in made.collect():
        assert (r.c.root, r.c.depth) == doubled(heads[r.i]), heads[r.i]


def _points(spark, n):
    rows = [(i, float(i * 7 % 5 > 2), float(i % 13), float(i * i % 17)) for i in range(n)]
    df = spark.createDataFrame(rows, "row_id int, label double, a double, b double").coalesce(1)
    return VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)


def test_forest_rows_use_the_cores(spark):
    many, few = _points(spark, 2000), _points(spark, 300)
    dealt = md.forest_rows(many, 2000)
    assert dealt.rdd.getNumPartitions() == min(spark.sparkContext.defaultParallelism, 4)
    assert sorted(dealt.collect()) == sorted(many.collect())
    assert md.forest_rows(few, 300).rdd.getNumPartitions() == 1


def test_forest_keeps_each_rows_place(spark):
    points = _points(spark, 300)
    forest = md.classifier("random_forest", 300, 2, numTrees=5)
    assert forest.getCacheNodeIds()
    plain = md.classifier("random_forest", 300, 2, numTrees=5, cacheNodeIds=False)
    assert forest.fit(points).toDebugString.split("\n")[1:] == plain.fit(points).toDebugString.split("\n")[1:]
