"""The conversation prefix trie against a brute-force trie built in Python."""

import hashlib
import zlib

import pytest

from penprint.llm.prefixtrie import prefix_trie
from penprint.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, key string"


def brute_trie(rows, group=100, cuts=6):
    convs = {}
    for c, turn, role, text in rows:
        if c is None:
            continue
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    ordered = {
        c: [(r, t) for _, r, t in sorted(ts, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))]
        for c, ts in convs.items()
    }
    rebuilt = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % cuts
        base = ordered.get(c - c % group, [])
        rebuilt[c] = base[:h] + own[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for key in nodes:
        if key:
            children.setdefault(key[:-1], []).append(key)
    out = []
    for key, members in nodes.items():
        sub = [k for k in nodes if k[: len(key)] == key]
        leaves = sum(1 for k in sub if k not in children)
        saved = sum((len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) for k in sub)
        ends = sorted(c for c in members if len(rebuilt[c]) == len(key))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            len(children.get(key, [])), leaves, saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=lambda r: (r[1], r[0], r[3], r[7]))


def _spark_rows(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted(rows, key=lambda r: (r[1], r[0], r[3], r[7]))


def test_trie_on_the_table(spark, sf_dir):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf_dir}/conversations.parquet").to_pylist()
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table]
    got = _spark_rows(QUERIES["op13_veb_trie"](spark, sf_dir))
    assert got == brute_trie(rows)


def test_trie_edges(spark):
    rows = [
        (0, 0, "user", "hello"), (0, 1, "assistant", "hi"), (0, 2, "user", "bye"), (0, None, "system", "first"),
        (1, 0, "user", "hello"), (1, 1, None, None), (1, 1, None, None),  # repeated turn, nulls
        (2, 5, "user", "x" * 50_000),  # a very long text
        (3, None, None, None),
        (7, 0, "user", "ünïcode ✓"), (7, 1, "user", ""),
        (100, 0, "user", "hello"), (100, 1, "assistant", "hi"),
        (105, 3, "user", "own"), (250, 0, "user", "no base here"),
        (None, 0, "user", "dropped"),
    ]
    rows += [(300 + i, 0, "user", "copy") for i in range(40)]  # many equal conversations
    frame = spark.createDataFrame([r + (1, "k") for r in rows], SCHEMA)
    assert _spark_rows(prefix_trie(frame)) == brute_trie(rows)


def test_trie_empty(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
