"""Tree measures and motifs against brute force on random and extreme trees."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from penprint.functions import trees
from penprint.operators import features as ft, motifs as mo, parses as pa, trees as tr
from penprint.schemas import PARSES

DEPS = ["ccomp", "advcl", "det", "obj"]


def sentence(head, number=1, pos=None, dep=None, lower=None):
    n = len(head)
    return {
        "sent_id": number,
        "text": " ".join(lower or ["w"] * n),
        "head": head,
        "pos": pos or ["NOUN"] * n,
        "dep": dep or ["obj"] * n,
        "lower": lower or ["w"] * n,
        "start": None,
        "end": None,
    }


def random_tree(rng, n):
    order = list(range(n))
    rng.shuffle(order)
    head = list(range(n))
    for at in range(1, n):
        head[order[at]] = order[rng.randrange(at)]
    return head


def path(head, i):
    steps = [i]
    while head[i] != i:
        i = head[i]
        steps.append(i)
    return steps


@pytest.fixture(scope="module")
def heads():
    rng = random.Random(7)
    return [
        [1, 4, 1, 2, 4, 4],
        [0],
        list(range(5)),
        [0] + list(range(300)),
        [0] * 200,
        [0, 0, 2, 2, 3],
        *[random_tree(rng, n) for n in (2, 3, 17, 90)],
    ]


def test_measures_match_walking(spark, heads):
    df = spark.createDataFrame([(h,) for h in heads], "head array<int>")
    rows = df.select(
        "head",
        trees.depths(F.col("head")).alias("depth"),
        trees.subtree_sizes(F.col("head")).alias("size"),
        trees.branching_factors(F.col("head")).alias("kids"),
    ).collect()
    for r in rows:
        n = len(r.head)
        above = Counter(a for i in range(n) for a in path(r.head, i))
        assert r.depth == [len(path(r.head, i)) - 1 for i in range(n)]
        assert r.size == [above[i] for i in range(n)]
        assert r.kids == [sum(h == i for j, h in enumerate(r.head) if j != i) for i in range(n)]
    assert rows[0].depth == [2, 1, 2, 3, 0, 1]
    assert rows[0].size == [1, 4, 2, 1, 6, 1]
    assert rows[0].kids == [0, 2, 1, 0, 2, 0]


def parses(spark, chunks):
    return spark.createDataFrame([(1, i, "t", c) for i, c in enumerate(chunks)], PARSES)


def test_chunk_features_match_token_aggregates(spark, heads):
    chunks = [[], [sentence(h, i) for i, h in enumerate(heads, 1)], [sentence(heads[0])]]
    rows = ft.chunk_features(parses(spark, chunks)).orderBy("chunk_id").collect()
    for chunk, row in zip(chunks, rows):
        every = [(s["head"], i) for s in chunk for i in range(len(s["head"]))]
        depth = [len(path(h, i)) - 1 for h, i in every]
        kids = [sum(x == i for j, x in enumerate(h) if j != i) for h, i in every]
        size = [sum(i in path(h, j) for j in range(len(h))) for h, i in every]
        assert (row.token_count, row.sentence_count) == (len(every), len(chunk))
        for name, values in (("dependency_depth", depth), ("branching_factor", kids), ("subtree_size", size)):
            values = values or [0]
            assert row[f"{name}_mean"] == pytest.approx(sum(values) / len(values))
            assert (row[f"{name}_max"], row[f"{name}_min"]) == (max(values), min(values))


def brute_motifs(sentences, label, least=3):
    counts = Counter()
    for s in sentences:
        for h in range(len(s["head"])):
            kids = [label(s, j) for j, x in enumerate(s["head"]) if x == h and j != h]
            for size in range(least, len(kids) + 1):
                for combo in combinations(kids, size):
                    counts[f"{s['pos'][h]}:{'+'.join(sorted(combo))}"] += 1
    return counts


@pytest.mark.parametrize("mode", ["category", "mixed"])
@pytest.mark.parametrize("least", [3, 4])
def test_motifs_match_enumeration(spark, mode, least):
    rng = random.Random(3)
    chunk = []
    for number in range(1, 15):
        n = rng.randrange(1, 16)
        head = [0] + [rng.randrange(0, max(1, min(i, 3))) for i in range(1, n)]
        chunk.append(
            sentence(
                head,
                number,
                [rng.choice(["NOUN", "VERB"]) for _ in range(n)],
                [rng.choice(DEPS) for _ in range(n)],
                [rng.choice(["the", "sea", "of"]) for _ in range(n)],
            )
        )
    words = ["the", "of"]

    def label(s, j):
        if mode == "mixed" and s["lower"][j] in words:
            return f"tok:{s['lower'][j]}"
        return f"pos:{s['pos'][j]}|dep:{s['dep'][j]}"

    rows = mo.motif_counts(parses(spark, [chunk]), mode, words, least).collect()
    assert {r.motif: r.cnt for r in rows} == dict(brute_motifs(chunk, label, least))


def test_motif_repeats_and_a_head_with_many_children(spark):
    bag = sentence([0, 0, 0, 0, 0], pos=["VERB"] * 5, dep=["ROOT", "a", "a", "a", "b"])
    wide = sentence([0] * 61)
    rows = mo.motif_counts(parses(spark, [[bag], [wide]])).collect()
    first = {r.motif: r.cnt for r in rows if r.chunk_id == 0}
    a, b = "pos:VERB|dep:a", "pos:VERB|dep:b"
    assert first == {
        f"VERB:{a}+{a}+{a}": 1,
        f"VERB:{a}+{a}+{b}": 3,
        f"VERB:{a}+{a}+{a}+{b}": 1,
    }
    second = [r.cnt for r in rows if r.chunk_id == 1]
    assert len(second) == 58
    assert sum(second) == 2**60 - 1 - 60 - 60 * 59 // 2
    with pytest.raises(ValueError):
        mo.motif_counts(parses(spark, [[bag]]), min_leaves=2)


def test_many_distinct_children_cross_block_borders(spark):
    s = sentence([0] * 15, dep=["ROOT"] + [f"d{i:02d}" for i in range(14)])
    rows = mo.motif_counts(parses(spark, [[s]])).agg(F.count("*"), F.sum("cnt")).first()
    assert tuple(rows) == (2**14 - 1 - 14 - 91,) * 2


def test_decimal_counts_go_beyond_bigint(spark):
    rows = mo.motif_counts(parses(spark, [[sentence([0] * 101)]]), count_type="decimal(38,0)")
    assert int(rows.agg(F.sum("cnt")).first()[0]) == 2**100 - 1 - 100 - 50 * 99


def test_pivot_fills_zero(spark):
    bag = sentence([0, 0, 0, 0])
    df = parses(spark, [[bag], []])
    wide = mo.motif_pivot(ft.chunk_features(df), mo.motif_counts(df)).orderBy("chunk_id").collect()
    name = "motif_NOUN:pos:NOUN|dep:obj+pos:NOUN|dep:obj+pos:NOUN|dep:obj_count"
    assert [r[name] for r in wide] == [1, 0]
    counts = mo.motif_counts(df)
    assert mo.top_motifs(counts, 1) == [name[6:-6]]
    assert mo.motif_map(counts).first().motif_counts == {name[6:-6]: 1}


def test_flat_tokens_nest_again(spark, heads):
    df = parses(spark, [[sentence(h, i) for i, h in enumerate(heads, 1)], []])
    again = pa.nest_tokens(df.select("text_id", "chunk_id", "text"), pa.tokens(df))
    same = ["head", "pos", "dep", "lower", "sent_id"]
    left, right = (
        x.orderBy("chunk_id").select(*[f"sents.{c}" for c in same]).collect() for x in (df, again)
    )
    assert left == right


def test_no_python_and_no_cross_join_in_tree_plans(spark, sf_dir):
    import __spark_entry__ as contract

    for name in ("chunk_features", "motif_counts", "subtree_size", "char_ngram_vocab", "function_word_freq"):
        plan = contract.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan, name
    plan = ft.chunk_features(
        spark.createDataFrame([], PARSES)
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_head_lookup(spark):
    rows = tr.tokens_with_head(parses(spark, [[sentence([1, 1, 1], pos=["A", "B", "C"])]])).collect()
    assert [(r.pos, r.head_pos, r.head_depth) for r in rows] == [("A", "B", 0), ("B", "B", 0), ("C", "B", 0)]
