"""Subtree motifs: a head with any three or more of its children.

A head with child labels ``a, a, b`` has as many motifs as there are ways to take
labels from that bag. Labels that repeat are handled by their multiplicity: taking ``c``
of ``n`` equal labels gives one motif, counted ``n choose c`` times. Every motif is
produced, without a cap, yet a head with a hundred equal children costs a hundred rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import bind, positions, run_lengths
from ..functions.trees import head_groups

MIN_LEAVES = 3
# Choices enumerated per inner explode; bounds the array a single row can hold.
_STEP = 4096
# Bags of so many different labels have their choices spelled out: 42 of them for six.
_SPELLED = 6


def _check(min_leaves: int) -> None:
    if min_leaves < MIN_LEAVES:
        raise ValueError("min_leaves must be at least 3, so that a motif has four nodes")


def head_bags(
    parses: DataFrame, mode: str = "category", words: list[str] = (), min_leaves: int = MIN_LEAVES
) -> DataFrame:
    """``(text_id, chunk_id, pos, bag, heads)``: distinct child-label bags of a chunk.

    Equal heads of a chunk are counted inside its row, before anything is exploded.
    """
    _check(min_leaves)
    every = F.flatten(
        F.transform("sents", lambda s: head_groups(s, mode, list(words), min_leaves))
    )
    return parses.select(
        "text_id", "chunk_id", F.explode(run_lengths(F.sort_array(every))).alias("r")
    ).select(
        "text_id",
        "chunk_id",
        F.col("r.value.pos").alias("pos"),
        run_lengths(F.col("r.value.labels")).alias("bag"),
        F.col("r.n").cast("bigint").alias("heads"),
    )


def _choose(n: Column, c: Column, kind: str) -> Column:
    """``n choose c``, exact: each step's product is divisible by its index."""
    one = F.lit(1).cast(kind)
    return F.aggregate(
        positions(F.least(c, n - c)),
        one,
        lambda acc, i: F.try_divide(acc * (n - i).cast(kind), (i + 1).cast(kind)).cast(kind)
        if kind != "bigint"
        else F.call_function("div", acc * (n - i), (i + 1).cast("bigint")),
    )


def _spelled(min_leaves: int) -> tuple[Column, Column]:
    """Whether a bag is small and without repeats, and then all its motifs.

    Such bags are most of a parse; their motifs are plain concatenations, without a
    number and a function for each choice.
    """
    size = F.size("bag")
    known = range(min_leaves, _SPELLED + 1)
    label = [F.get("bag", F.lit(i))["value"] for i in range(_SPELLED)]
    motifs = F.lit(None).cast("array<string>")
    for n in reversed(known):
        chosen = [c for m in range(min_leaves, n + 1) for c in combinations(range(n), m)]
        named = [F.concat("pos", F.lit(":"), F.concat_ws("+", *[label[i] for i in c])) for c in chosen]
        motifs = F.when(size == n, F.array(*named)).otherwise(motifs)
    return size.isin(list(known)) & F.forall("bag", lambda b: b["n"] == 1), motifs


def expand_motifs(
    bags: DataFrame, min_leaves: int = MIN_LEAVES, count_type: str = "bigint"
) -> DataFrame:
    """``(text_id, chunk_id, motif, cnt)``, not yet summed over bags.

    Small bags without repeats have their choices spelled out. In others a choice is a
    number in mixed radix: digit ``l`` says how many of label ``l`` are taken. Numbers are
    exploded in two steps, so no row holds more than 4096 of them per step. Counts beyond
    BIGINT raise; ask for ``decimal(38,0)`` to go further.
    """
    _check(min_leaves)
    zero = F.lit(0).cast("bigint")
    one = F.lit(1).cast("bigint")
    # Whatever the session says of overflow: a count of choices beyond BIGINT raises.
    size = F.aggregate("bag", F.lit(1.0), lambda acc, b: acc * (b["n"] + 1))
    choices = F.when(
        size < float(1 << 62), F.aggregate("bag", one, lambda acc, b: acc * (b["n"] + 1))
    ).otherwise(F.raise_error(F.lit("a head has more motifs than BIGINT counts")).cast("bigint"))
    radix = F.transform(
        "bag",
        lambda b, i: F.aggregate(
            F.slice("bag", F.lit(1), i), one, lambda acc, x: acc * (x["n"] + 1)
        ),
    )
    small, motifs = _spelled(min_leaves)
    staged = bags.withColumn("_small", small)
    staged = staged.withColumn("_choices", F.when(F.col("_small"), one).otherwise(choices))
    staged = staged.withColumn("_radix", F.when(~F.col("_small"), radix))
    # Without repeated labels every choice is one way, and nothing needs to be counted.
    staged = staged.withColumn("_plain", F.col("_small") | F.forall("bag", lambda b: b["n"] == 1))
    blocks = staged.withColumn(
        "_block",
        F.explode(F.sequence(zero, F.shiftright(F.col("_choices") - 1, 12))),
    )
    low = F.col("_block") * _STEP
    numbers = F.sequence(low, F.least(low + _STEP, F.col("_choices")) - 1)
    nothing = F.lit(None)
    numbered = blocks.withColumn(
        "_e",
        F.explode(
            F.when(F.col("_small"), F.transform(motifs, lambda m: F.struct(nothing.cast("bigint").alias("k"), m.alias("motif"))))
            .otherwise(F.transform(numbers, lambda k: F.struct(k.alias("k"), nothing.cast("string").alias("motif"))))
        ),
    ).withColumn("_k", F.col("_e.k"))
    taken = numbered.withColumn(
        "_taken",
        F.when(
            ~F.col("_small"),
            F.transform(
                "_radix",
                lambda r, i: F.call_function(
                    "div", F.col("_k"), r
                )
                % (F.get("bag", i)["n"] + 1),
            ),
        ),
    )
    wanted = taken.where(
        F.col("_small") | (F.aggregate("_taken", zero, lambda acc, c: acc + c) >= min_leaves)
    )
    leaves = F.flatten(
        F.transform(
            "_taken", lambda c, i: F.array_repeat(F.get("bag", i)["value"], c.cast("int"))
        )
    )
    single = F.lit(1).cast(count_type)
    ways = F.when(F.col("_plain"), single).otherwise(
        F.aggregate(
            F.transform(
                "_taken", lambda c, i: _choose(F.get("bag", i)["n"], c.cast("int"), count_type)
            ),
            single,
            lambda acc, w: (acc * w).cast(count_type),
        )
    )
    numbered_motif = F.concat("pos", F.lit(":"), F.array_join(leaves, "+"))
    return wanted.select(
        "text_id",
        "chunk_id",
        F.when(F.col("_small"), F.col("_e.motif")).otherwise(numbered_motif).alias("motif"),
        (F.col("heads") * ways).cast(count_type).alias("cnt"),
    )


def merge_motifs(counts: DataFrame) -> DataFrame:
    """Sum motif counts per chunk; nothing is shuffled when rows are dealt by id already."""
    return counts.groupBy("text_id", "chunk_id", "motif").agg(
        F.sum("cnt").alias("cnt")
    )


def motif_counts(
    parses: DataFrame,
    mode: str = "category",
    words: list[str] = (),
    min_leaves: int = MIN_LEAVES,
    count_type: str = "bigint",
    by: tuple[str, ...] = ("text_id", "chunk_id"),
) -> DataFrame:
    """Long motif table ``(text_id, chunk_id, motif, cnt)``.

    Bags are dealt by the columns ``by`` before they are expanded, so the sums find their
    rows in place and the motifs themselves are never shuffled. ``("text_id",)`` keeps the
    chunks of a text together for a later sum per text; it asks for ids of single texts.
    """
    bags = head_bags(parses, mode, words, min_leaves).repartition(*by)
    return merge_motifs(expand_motifs(bags, min_leaves, count_type))


def top_motifs(counts: DataFrame, n: int) -> list[str]:
    """The ``n`` most frequent motifs, ties by name: the columns of a wide table."""
    ranked = counts.groupBy("motif").agg(F.sum("cnt").alias("cnt"))
    return [r.motif for r in ranked.orderBy(F.desc("cnt"), "motif").limit(n).collect()]


def motif_pivot(
    features: DataFrame, counts: DataFrame, motifs: list[str] | None = None
) -> DataFrame:
    """Feature rows with one ``motif_<key>_count`` column per listed motif, 0 if absent.

    Without a list every motif becomes a column, up to ``spark.sql.pivotMaxValues``;
    beyond that Spark refuses, and the long table is the form to use.
    """
    keys = ["text_id", "chunk_id"]
    grouped = counts.groupBy(*keys)
    if motifs is None:
        wide = grouped.pivot("motif").sum("cnt")
    else:
        wide = counts.where(F.col("motif").isin(motifs)).groupBy(*keys).pivot("motif", motifs).sum("cnt")
    names = [c for c in wide.columns if c not in keys]
    renamed = wide.select(*keys, *[F.col(f"`{c}`").alias(f"motif_{c}_count") for c in names])
    joined = features.join(renamed, keys, "left")
    return joined.select(
        *features.columns,
        *[
            F.coalesce(F.col(f"`motif_{c}_count`"), F.lit(0).cast("bigint")).alias(f"motif_{c}_count")
            for c in names
        ],
    )


def motif_map(counts: DataFrame) -> DataFrame:
    """``(text_id, chunk_id, motif_counts MAP)``; a group is one chunk's own motifs."""
    return counts.groupBy("text_id", "chunk_id").agg(
        F.map_from_entries(F.collect_list(F.struct("motif", "cnt"))).alias("motif_counts")
    )
