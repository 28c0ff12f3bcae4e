"""Motifs of small bags, whose choices are spelled out, against all others."""

from collections import Counter
from itertools import combinations

import pytest

from penprint.operators import motifs as mo

SCHEMA = "text_id bigint, chunk_id int, pos string, bag array<struct<value:string,n:int>>, heads bigint"


def _bags():
    names = ["a", "b", "c", None, "d|e", "f", "g", "h"]
    bags = [[(x, 1) for x in names[:k]] for k in range(3, 9)]
    bags += [[("a", 2), ("b", 1)], [("a", 7)], [("a", 1), ("b", 3), ("c", 1)]]
    rows = [(i, 0, "VERB", bag, 1 + i % 3) for i, bag in enumerate(bags)]
    return [*rows, (99, 1, None, bags[1], 1), (None, 0, "X", bags[0], 2)]


def _brute(rows, least):
    found = Counter()
    for text, chunk, pos, bag, heads in rows:
        leaves = [x for x, n in bag for _ in range(n)]
        for k in range(least, len(leaves) + 1):
            for c in combinations(leaves, k):
                motif = None if pos is None else f"{pos}:" + "+".join(x for x in c if x is not None)
                found[text, chunk, motif] += heads
    return found


@pytest.mark.parametrize("least", [3, 4, 7])
def test_spelled_motifs_equal_brute_force(spark, least, monkeypatch):
    rows = _bags()
    bags = spark.createDataFrame(rows, SCHEMA)

    def counted():
        made = mo.merge_motifs(mo.expand_motifs(bags, least)).collect()
        return {(r.text_id, r.chunk_id, r.motif): r.cnt for r in made}

    want = dict(_brute(rows, least))
    assert counted() == want
    monkeypatch.setattr(mo, "_SPELLED", 2)
    assert counted() == want


def test_small_bags_have_no_number_per_choice(spark):
    bags = spark.createDataFrame([(1, 0, "VERB", [(x, 1) for x in "abcd"], 1)], SCHEMA)
    made = mo.expand_motifs(bags)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws(+" in plan
    assert sorted(r.motif for r in made.collect()) == ["VERB:a+b+c", "VERB:a+b+c+d", "VERB:a+b+d", "VERB:a+c+d", "VERB:b+c+d"]
