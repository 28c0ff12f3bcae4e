"""Operators that SQL cannot state, against brute force, bounds and held-out labels."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

import corpus_pipeline
from penprint.llm import linedup, minhash
from penprint.llm.bytecnn import Network, blocks, probabilities, WIDTH
from penprint.llm.packing import pack_lengths, place_table
from penprint.llm.queries import QUERIES
from penprint.llm.shards import deal_slots, load_map, rebalance, save_map


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(0, 40), max_size=30))
def test_histogram_packing_is_whole_and_tight(counts):
    patterns = pack_lengths(counts, 60)
    seen: dict[int, int] = {}
    for many, content in patterns:
        assert sum(content) <= 60 and many > 0
        assert sum(3 * n > 60 for n in content) <= 2
        for n in content:
            seen[n] = seen.get(n, 0) + many
    assert seen == {n: c for n, c in counts.items() if c}
    # No two sequences could be one, so they are more than half full on average.
    volume = math.ceil(sum(n * c for n, c in counts.items()) / 60)
    assert volume <= sum(m for m, _ in patterns) <= 2 * volume + 1
    table = place_table(patterns)
    assert len(set(zip(table["sequence"].tolist(), table["offset"].tolist()))) == len(table["length"])


def _naive_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return {k: tokenizer.encode(t, add_special_tokens=False).ids + [2] for k, t in texts.items()}


def _check_pieces(pieces, texts):
    by_doc: dict = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for key, ids in _naive_ids(texts).items():
        at = 0
        for k, r in enumerate(sorted(by_doc[key], key=lambda r: r.piece)):
            assert r.piece == k and r.start == at and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    total, sequences = 0, {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        total += r.length
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return total, len(sequences)


def test_packing_query(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    total, used = _check_pieces(QUERIES["op7_large_item_matching"](spark, sf_dir).collect(), texts)
    assert used <= 1.02 * math.ceil(total / 1024) + 1


def test_added_tokens_in_a_text_get_their_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    from penprint.llm.queries import public_encoder

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = public_encoder()()
    end = "<|endoftext|>"
    for text in (end, f"one {end} two", f"a{end}{end}\n b", f" {end} ", "<|endof text|> <|end", f"é's{end}'s 12", "", "plain words"):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encode(text) == ids and (50256 in ids) == (end in text)


def _brute_pipeline(rows, items, judged):
    """Line dedup, near-dedup and decontamination of the documents that the rules keep."""
    docs = {k: t for k, t in rows if judged[k]}
    as_set = lambda line: frozenset(line.encode().lower().split())
    earlier, cut = [], {}
    for key in sorted(docs):
        kept = []
        for line in docs[key].split("\n"):
            s = as_set(line)
            match = s and any(
                100 * len(s & o) >= 80 * len(s | o)
                for o in earlier
                if 100 * min(len(s), len(o)) >= 80 * max(len(s), len(o))
            )
            if not match:
                kept.append(line)
            if s:
                earlier.append(s)
        text = "\n".join(kept)
        if as_set(text):
            cut[key] = text

    def shingles(text):
        w = text.encode().lower().split()
        k = min(5, len(w))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    sets = {k: shingles(t) for k, t in cut.items()}
    root = {k: k for k in cut}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(cut)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    alone = {k: t for k, t in cut.items() if find(k) == k}

    def tokens(text):
        raw = text.encode().lower()
        return bytes(c if chr(c).isalnum() and c < 128 or c > 127 else 32 for c in raw).split()

    windows = set()
    for text in items:
        w = tokens(text)
        m = min(10, len(w))
        windows |= {tuple(w[i : i + m]) for i in range(len(w) - m + 1) if m}
    sizes = {len(w) for w in windows}
    return {
        k: t
        for k, t in alone.items()
        if not any(
            tuple(w[i : i + m]) in windows for w in [tokens(t)] for m in sizes for i in range(len(w) - m + 1)
        )
    }


def test_pipeline(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    judged = {r.doc_id: r.kept for r in QUERIES["op2_line_frequency"](spark, sf_dir).collect()}
    expected = _brute_pipeline([tuple(r) for r in rows], items, judged)
    assert 0 < len(expected) < len(rows)
    _check_pieces(corpus_pipeline.run(spark, sf_dir).collect(), expected)


def test_stages_keep_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns


def test_second_round_loses_no_match(spark, monkeypatch):
    """A group whose closest earlier partners fail: the matches come in the second round."""
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    base = words[:40]
    lines = []
    for i in range(300):
        line = list(base)
        for k in rng.sample(range(40), rng.choice([0, 2, 3, 4, 5, 6, 8])):
            line[k] = rng.choice(words)
        lines.append((i, " ".join(line)))
    docs = spark.createDataFrame(lines, "doc_id bigint, text string")
    sets = [set(t.split()) for _, t in lines]
    expected = {
        i for i in range(300) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))
    }
    monkeypatch.setattr(linedup, "FIRST", 1)
    assert {r.id for r in linedup.repeated_lines(docs).collect()} == expected


def test_cut_buckets_lose_no_match(spark, monkeypatch):
    """Buckets above a bound go in runs of bounded size and lose nothing."""
    rng = random.Random(7)
    words = [f"word{i}" for i in range(60)]
    lines = []
    for i in range(600):
        line = words[:30]
        for k in rng.sample(range(30), rng.choice([0, 1, 2, 3, 4, 5, 7])):
            line[k] = rng.choice(words)
        lines.append((i, " ".join(line)))
    docs = spark.createDataFrame(lines, "doc_id bigint, text string")
    sets = [set(t.split()) for _, t in lines]
    expected = {
        i for i in range(600) if any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(i))
    }
    assert {r.id for r in linedup.repeated_lines(docs).collect()} == expected
    rounds, cut_round = [], linedup._cut_round
    monkeypatch.setattr(linedup, "_cut_round", lambda *a: rounds.append(1) or cut_round(*a))
    for first, hot, run, cell in ((4, 50, 16, 64), (1, 20, 7, 32)):
        for name, value in (("FIRST", first), ("HOT", hot), ("RUN", run), ("CELL", cell)):
            monkeypatch.setattr(linedup, name, value)
        assert {r.id for r in linedup.repeated_lines(docs).collect()} == expected
    assert len(rounds) == 2


def test_a_large_bucket_is_never_in_memory_whole():
    rows = [(t, k) for t, many in ((1, 3), (2, 90_000), (3, 2), (4, 40_000), (5, 1)) for k in range(many)]
    table = pa.table({"token": [t for t, _ in rows], "k": [k for _, k in rows]})
    got = list(linedup._runs(iter(table.to_batches(max_chunksize=10_000))))
    assert pa.Table.from_batches([b for b, _ in got]).equals(table)
    assert max(b.num_rows for b, cut in got if cut) <= linedup.RUN
    assert all(set(b["token"].to_pylist()) <= {1, 3, 5} for b, cut in got if not cut)


def test_near_copies_in_chains(spark):
    """A group whose members mostly match by way of others, in blocks smaller than it is."""
    rng = random.Random(6)
    text = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(160):
        if rng.random() < 0.5:
            text = list(text)
            text[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"z{rng.randrange(9)}" for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id bigint, text string"), words_per_shingle=2).collect()}
    sets = {}
    for k, t in rows:
        w = t.split()
        sets[k] = set(zip(w, w[1:])) or {tuple(w)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {k: find(k) for k in keys}


def test_network_reads_the_whole_text():
    rng = np.random.default_rng(0)
    net = Network(rng.normal(size=(WIDTH, 256, 16)).astype(np.float32), np.zeros(16, np.float32), rng.normal(size=16).astype(np.float32), 0.1)
    texts = [b"", b"short", bytes(rng.integers(32, 127, 1000).astype(np.uint8)), b"x" * 256]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = probabilities(net, data, offsets)
    for text, p in zip(texts, got):
        count = -(-(len(text) + WIDTH - 1) // 256)
        padded = np.frombuffer(text.ljust(count * 256 + WIDTH, b"\0"), np.uint8)
        value = np.array([sum(net.tables[k][padded[i + k]] for k in range(WIDTH)) for i in range(count * 256)])
        value[-(WIDTH - 1) :] = -np.inf
        best = value.reshape(count, 256, 16).max(axis=1)
        chunks = [np.maximum(best[i], best[i + 1]) for i in range(count - 1)] or [best[0]]
        logit = np.mean([np.maximum(c, 0) @ net.out for c in chunks]) + 0.1
        assert abs(p - 1 / (1 + np.exp(-logit))) < 1e-4
    assert len(blocks(data, offsets)[1]) == 5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op5_byte_cnn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = got.where("held_out").select("predicted", "quality").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.94


def test_rebalancing_moves_few_slots(spark, tmp_path):
    rng = random.Random(1)
    sizes = spark.createDataFrame([(i, rng.randrange(1, 1000)) for i in range(512)], "vslot bigint, bytes bigint")
    first = deal_slots(sizes, 8)
    save_map(first, str(tmp_path / "map"))
    grown = rebalance(load_map(spark, str(tmp_path / "map")), sizes, 9)
    save_map(grown, str(tmp_path / "map"))
    old = {r.vslot: r.shard for r in load_map(spark, str(tmp_path / "map"), 1).collect()}
    new = {r.vslot: r.shard for r in load_map(spark, str(tmp_path / "map")).collect()}
    weight = {r.vslot: r.bytes for r in sizes.collect()}
    assert set(old) == set(new) and set(new.values()) == set(range(9))
    moved = sum(weight[k] for k in old if old[k] != new[k]) / sum(weight.values())
    loads = [sum(w for k, w in weight.items() if new[k] == s) for s in range(9)]
    assert moved < 0.16 and max(loads) < 1.1 * sum(loads) / 9


def test_worker_functions_travel_by_value(tmp_path):
    """Workers need not have the package: what a task runs comes with the job."""
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    from penprint.llm import bytecnn, decontam, packing, pii, quality  # noqa: F401

    levels = np.zeros(linedup.COUNTERS, np.uint8)
    functions = [
        minhash._sketch(2, 200), minhash._bands(40, 5), minhash._likely(200, 80), minhash._sets(2),
        minhash._confirm(80), minhash._mark(40, 5, 80), minhash._between(80), linedup._counts,
        linedup._entries(levels, 80), linedup._buckets(80), linedup._fetch, linedup._matching(80),
        linedup._cell_matches(80), decontam._search(decontam.build_patterns([("1", "a b")], 10), "t", "h", False),
        packing._cut(packing.byte_pair_encoder("f", "p"), 2, 1024, True), pii._find(pii.fit([]), 0.9),
        bytecnn._score(bytecnn.fit([], np.zeros(0))),
    ]
    path = tmp_path / "functions"
    path.write_bytes(cloudpickle.dumps(functions))
    code = f"import pickle; print(len(pickle.load(open({str(path)!r}, 'rb'))))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.stdout.strip() == str(len(functions)), done.stderr
