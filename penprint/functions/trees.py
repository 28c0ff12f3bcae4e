"""Dependency-tree measures of one sentence, computed on its packed arrays.

``head[i]`` is the position of token ``i``'s head and equals ``i`` at a root. Paths to
the root are shortened by pointer doubling: after ``r`` rounds every token knows its
ancestor ``2**r`` steps up, so a sentence of ``n`` tokens takes ``log2(n)`` rounds
instead of a walk per token.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import bind, positions, run_lengths, run_starts, total


def _rounds(longest: Column) -> Column:
    """``[0, .., r-1]`` with the least ``r`` for which ``2**r >= longest``."""
    safe = F.greatest(longest, F.lit(1))
    return positions(F.ceil(F.log2(safe.cast("double"))).cast("int"))


def climb(head: Column) -> Column:
    """``struct<root, depth>``: each token's root and its distance from it.

    The rounds are enough for a chain; a round that moves no token ends the work, and the
    rest of them only hand their state on.
    """
    start = F.struct(
        head.alias("root"),
        F.transform(head, lambda h, i: F.when(h == i, 0).otherwise(1)).alias("depth"),
        F.lit(False).alias("done"),
    )

    def climbed(acc: Column, up: Column) -> Column:
        return F.struct(
            up.alias("root"),
            F.transform(
                acc["depth"], lambda d, i: d + F.get(acc["depth"], F.get(acc["root"], i))
            ).alias("depth"),
            F.lit(False).alias("done"),
        )

    def arrived(acc: Column) -> Column:
        return F.struct(
            acc["root"].alias("root"), acc["depth"].alias("depth"), F.lit(True).alias("done")
        )

    return F.aggregate(
        _rounds(F.size(head) - 1),
        start,
        lambda acc, _: F.when(acc["done"], acc).otherwise(
            bind(
                F.transform(acc["root"], lambda h: F.get(acc["root"], h)),
                lambda up: F.when(
                    # Not so in a circle, or with heads outside the sentence (null here).
                    (up == acc["root"])
                    & ~F.exists(up, lambda h: F.coalesce(F.get(acc["depth"], h) != 0, F.lit(True))),
                    arrived(acc),
                ).otherwise(climbed(acc, up)),
            )
        ),
    )


def depths(head: Column) -> Column:
    return climb(head)["depth"]


def _sum_by_target(n: Column, own: Column, target: Column) -> Column:
    """For each position ``v``: ``own[v]`` plus ``own[u]`` over all ``u`` with ``target[u] = v``.

    Pairs are packed into one BIGINT each, sorted, and added up run by run. Every
    position contributes its own pair, so run ``v`` belongs to position ``v``.
    """
    scale = F.lit(1 << 31)
    mine = F.transform(own, lambda s, i: i.cast("bigint") * scale + s)
    given = F.filter(
        F.transform(
            own,
            lambda s, i: F.when(
                F.get(target, i) >= 0, F.get(target, i).cast("bigint") * scale + s
            ),
        ),
        lambda x: x.isNotNull(),
    )

    def add_runs(pairs: Column) -> Column:
        keys = F.transform(pairs, lambda p: F.shiftright(p, 31))
        return bind(
            run_starts(keys),
            lambda starts: F.transform(
                starts,
                lambda st, k: total(
                    F.slice(
                        pairs, st + 1, F.coalesce(F.get(starts, k + 1), F.size(pairs)) - st
                    ),
                    lambda p: p % scale,
                ).cast("int"),
            ),
        )

    return bind(F.sort_array(F.concat(mine, given)), add_runs)


def subtree_sizes(head: Column) -> Column:
    """Tokens at or below each token.

    ``size`` counts descendants fewer than ``2**r`` steps down; adding the sizes found
    at the tokens exactly ``2**r`` steps down doubles the reach.
    """

    def sizes(deepest: Column) -> Column:
        start = F.struct(
            F.transform(head, lambda h, i: F.when(h == i, -1).otherwise(h)).alias("up"),
            F.transform(head, lambda _: F.lit(1)).alias("size"),
        )
        return F.aggregate(
            _rounds(deepest + 1),
            start,
            lambda acc, _: F.struct(
                F.transform(
                    acc["up"],
                    lambda u: F.when(u < 0, -1).otherwise(F.get(acc["up"], F.greatest(u, F.lit(0)))),
                ).alias("up"),
                _sum_by_target(F.size(head), acc["size"], acc["up"]).alias("size"),
            ),
        )["size"]

    return F.when(F.size(head) == 0, F.array().cast("array<int>")).otherwise(
        bind(F.array_max(depths(head)), sizes)
    )


def child_heads(head: Column) -> Column:
    """Heads of all non-root tokens, sorted."""
    return F.sort_array(F.filter(head, lambda h, i: h != i))


def branching_factors(head: Column) -> Column:
    """Children per token: how often each position occurs as a head."""
    n = F.size(head)
    # Every position is added once, so run v is position v and the extra one is taken off.
    return F.transform(
        run_lengths(F.sort_array(F.concat(positions(n), F.filter(head, lambda h, i: h != i)))),
        lambda r: r["n"] - 1,
    )


def _longest_run(ordered: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(run_lengths(ordered), lambda r: r["n"])), F.lit(0))


def _most_frequent(values: Column) -> Column:
    """How often the most frequent value occurs; mostly all are one value."""
    return F.when(F.size(F.array_distinct(values)) == 1, F.size(values)).otherwise(
        _longest_run(F.sort_array(values))
    )


def sentence_summary(sentence: Column) -> Column:
    """The few numbers of a sentence from which all chunk features but clause counts follow.

    The sum of subtree sizes is the sum of ``depth + 1``, every forest has a leaf, and
    the largest subtree hangs below a root, so no ancestor closure is needed.
    """
    head = sentence["head"]
    return bind(
        climb(head),
        lambda c: F.struct(
            F.size(head).cast("bigint").alias("tokens"),
            total(F.transform(head, lambda h, i: (h != i).cast("int"))).alias("arcs"),
            total(c["depth"]).alias("depth_sum"),
            F.coalesce(F.array_max(c["depth"]), F.lit(0)).alias("depth_max"),
            _longest_run(child_heads(head)).alias("branching_max"),
            _most_frequent(c["root"]).alias("subtree_max"),
        ),
    )


def count_of(values: Column, value: str) -> Column:
    """How often ``value`` stands in an array of strings, without a function per element."""
    return (F.size(values) - F.size(F.array_remove(values, value))).cast("bigint")


def child_label(
    lower: Column, pos: Column, dep: Column, mode: str = "category", words: list[str] = ()
) -> Column:
    """Leaf label of a token: its word when listed (mixed mode), else its categories."""
    if mode not in ("category", "mixed"):
        raise ValueError(f"unknown motif mode: {mode}")
    category = F.concat(F.lit("pos:"), pos, F.lit("|dep:"), dep)
    if mode == "category" or not words:
        return category
    return F.when(lower.isin(list(words)), F.concat(F.lit("tok:"), lower)).otherwise(category)


def head_groups(
    sentence: Column, mode: str, words: list[str], min_leaves: int
) -> Column:
    """``array<struct<pos, labels>>``: each head with enough children, labels sorted."""
    pairs = F.filter(
        F.transform(
            sentence["head"],
            lambda h, i: F.when(
                h != i,
                F.struct(
                    h.alias("head"),
                    child_label(
                        F.get(sentence["lower"], i),
                        F.get(sentence["pos"], i),
                        F.get(sentence["dep"], i),
                        mode,
                        words,
                    ).alias("label"),
                ),
            ),
        ),
        lambda p: p.isNotNull(),
    )

    def groups(kids: Column) -> Column:
        heads = F.transform(kids, lambda k: k["head"])
        return bind(
            run_starts(heads),
            lambda starts: F.transform(
                starts,
                lambda st, k: F.struct(
                    F.get(sentence["pos"], F.get(kids, st)["head"]).alias("pos"),
                    F.transform(
                        F.slice(kids, st + 1, F.coalesce(F.get(starts, k + 1), F.size(kids)) - st),
                        lambda kid: kid["label"],
                    ).alias("labels"),
                ),
            ),
        )

    return F.filter(
        bind(F.sort_array(pairs), groups), lambda g: F.size(g["labels"]) >= min_leaves
    )
