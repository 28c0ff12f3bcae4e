"""Personal data by patterns and a skip-chain conditional random field.

Patterns find mails, IP addresses, card and phone numbers. The field then labels the tokens
of a document that hold a digit or an ``@``, or repeat one that does: neighbouring tokens
share a transition potential, and distant tokens that are equal or similar (the same core,
the same last digits, the local part of a mail) share a potential that favours one label.
Loopy message passing makes the labels consistent over the document, so that a shortened or
repeated number is found where no pattern matches. Tokens inside pattern matches are observed.

Weights come from the patterns' own matches in a bounded sample of documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bytetext import slices

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)  # 0 is no entity
Span = tuple[int, int, int]  # kind, start, end in code points

_LOCAL = r"[A-Za-z0-9._%+-]"
_DOMAIN = r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
# A match can only begin at the start of a run of its first class, or right behind the
# match before; both patterns say so, which keeps long runs linear.
_MAIL = re.compile(rf"(?<!{_LOCAL}){_LOCAL}++{_DOMAIN}")
_MAIL_NEXT = re.compile(rf"{_LOCAL}++{_DOMAIN}")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = " \t,.;:!?()[]{}<>\"'#$%&*|/\\=~^`_-+"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (2 if i % 2 else 1)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _mails(text: str) -> list[tuple[int, int]]:
    found, at = [], 0
    while m := _MAIL_NEXT.match(text, at) or _MAIL.search(text, at):
        found.append(m.span())
        at = m.end()
    return found


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Valid matches per kind, and the places of matches that fail their check."""
    spans: list[Span] = []
    failed: list[tuple[int, int]] = []
    if "@" in text:
        spans += [(0, a, b) for a, b in _mails(text)]

    def check(kind: int, m: re.Match, ok: bool) -> None:
        if ok:
            spans.append((kind, *m.span()))
        else:
            failed.append(m.span())

    for m in _IP.finditer(text):
        check(1, m, all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if len(digits) >= 12:  # shorter runs say nothing about cards
            check(2, m, 16 <= len(digits) <= 19 and luhn(digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            check(3, m, 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15)
    return spans, failed


# --- tokens, features, links -------------------------------------------------------


@dataclass
class Lattice:
    """The tokens that may be part of an entity, and how they hang together."""

    start: np.ndarray  # of the token's core, without outer punctuation
    end: np.ndarray
    features: np.ndarray
    observed: np.ndarray  # the label, or -1
    chain: np.ndarray  # (k, 2) neighbours in the text
    edge: np.ndarray  # (n, 2) whether the token before and behind is no candidate
    skip: np.ndarray  # (k, 2) distant similar tokens


FEATURES = 24


def _features(core: str, raw: str) -> np.ndarray:
    f = np.zeros(FEATURES, np.float32)
    digits = sum(map(str.isdigit, core))
    letters = sum(map(str.isalpha, core))
    f[0] = 1
    f[1] = "@" in core
    f[2] = "@" in core and "." in core.rpartition("@")[2]
    f[3] = raw.startswith("+")
    f[4] = raw.startswith("(") and raw.rstrip(",.;:").endswith(")")
    f[5] = "-" in core
    f[6] = core.count(".") == 3 and letters == 0
    f[7] = core.count(".") in (1, 2)
    f[8] = letters == 0
    f[9] = letters > 0 and digits > 0
    f[10] = digits == 0
    f[11] = core.isdigit()
    for i, (low, high) in enumerate(((1, 1), (2, 2), (3, 3), (4, 4), (5, 6), (7, 7), (8, 9), (10, 12), (13, 15), (16, 19), (20, 10**9))):
        f[12 + i] = low <= digits <= high
    f[23] = ":" in core or "/" in core or "=" in core
    return f


def _keys(core: str) -> list[str]:
    """What makes two tokens similar."""
    low = core.lower()
    keys = ["=" + low]
    digits = "".join(c for c in low if c.isdigit())
    if len(digits) >= 7:
        keys.append("#" + digits[-7:])
    name = low.partition("@")[0]
    if len(name) >= 5:
        keys.append("@" + name)
    return keys


def lattice(text: str, spans: list[Span], failed: list[tuple[int, int]]) -> Lattice | None:
    """None if no token holds a digit or an ``@``."""
    tokens = [(m.start(), m[0]) for m in _TOKEN.finditer(text)]
    cores = [(a + len(t) - len(t.lstrip(_EDGES)), t.strip(_EDGES), t) for a, t in tokens]
    marked = [bool(c) and _ANY.search(c) is not None for _, c, _ in cores]
    if not any(marked):
        return None
    known = {k for (_, c, _), m in zip(cores, marked) if m for k in _keys(c)}
    use = [i for i, (_, c, _) in enumerate(cores) if marked[i] or c and len(c) >= 5 and "@" + c.lower() in known]
    start = np.array([cores[i][0] for i in use])
    end = start + np.array([len(cores[i][1]) for i in use])
    observed = np.full(len(use), -1)
    for label, places in ((0, failed), *((k + 1, [s[1:] for s in spans if s[0] == k]) for k in range(4))):
        for a, b in places:
            low, high = np.searchsorted(end, a, "right"), np.searchsorted(start, b, "left")
            observed[low:high] = label
    at = np.array(use)
    adjacent = np.flatnonzero(np.diff(at) == 1)
    edge = np.ones((len(use), 2), bool)
    edge[adjacent, 1] = edge[adjacent + 1, 0] = False
    groups: dict[str, list[int]] = defaultdict(list)
    for k, i in enumerate(use):
        for key in _keys(cores[i][1]):
            groups[key].append(k)
    # Each with the one before and with the first: no group gives all its pairs.
    skip = {
        (a, b)
        for members in groups.values()
        for k in range(1, len(members))
        for a, b in ((members[k - 1], members[k]), (members[0], members[k]))
        if a != b
    }
    return Lattice(
        start,
        end,
        np.array([_features(cores[i][1], cores[i][2]) for i in use]),
        observed,
        np.stack([adjacent, adjacent + 1], axis=1),
        edge,
        np.array(sorted(skip), np.int64).reshape(-1, 2),
    )


# --- the field ---------------------------------------------------------------------


@dataclass
class Field:
    unary: np.ndarray  # (FEATURES, LABELS)
    transition: np.ndarray  # (LABELS, LABELS)
    agreement: float


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def marginals(field: Field, g: Lattice, rounds: int = 50, damping: float = 0.5) -> np.ndarray:
    """Label probabilities of every token by loopy message passing, all edges at once."""
    own = g.features @ field.unary
    own = own + g.edge[:, :1] * field.transition[0] + g.edge[:, 1:] * field.transition[:, 0]
    seen = g.observed >= 0
    own[seen] = -30
    own[seen, g.observed[seen]] = 0
    same = field.agreement * np.eye(LABELS)
    source = np.concatenate([g.chain[:, 0], g.chain[:, 1], g.skip[:, 0], g.skip[:, 1]])
    target = np.concatenate([g.chain[:, 1], g.chain[:, 0], g.skip[:, 1], g.skip[:, 0]])
    k, s = len(g.chain), len(g.skip)
    potential = np.concatenate(
        [
            np.broadcast_to(field.transition, (k, LABELS, LABELS)),
            np.broadcast_to(field.transition.T, (k, LABELS, LABELS)),
            np.broadcast_to(same, (2 * s, LABELS, LABELS)),
        ]
    )
    back = np.concatenate(
        [np.arange(k, 2 * k), np.arange(k), np.arange(2 * k + s, 2 * (k + s)), np.arange(2 * k, 2 * k + s)]
    ).astype(np.int64)
    message = np.zeros((len(source), LABELS))
    belief = own.copy()
    for _ in range(rounds if len(source) else 0):
        new = _log_sum((belief[source] - message[back])[:, :, None] + potential, 1)
        new -= _log_sum(new, 1)[:, None]
        step = damping * (new - message)
        message = message + step
        belief = own.copy()
        np.add.at(belief, target, message)
        if np.abs(step).max() < 1e-3:
            break
    return np.exp(belief - _log_sum(belief, 1)[:, None])


def fit(texts: list[str], rounds: int = 300) -> Field:
    """Weights from the patterns' matches in ``texts``: softmax regression on token shapes,
    log ratios of neighbouring labels, and the log odds that similar tokens agree."""
    features, labels = [np.zeros((1, FEATURES), np.float32)], [np.zeros(1, np.int64)]
    pair = np.ones((LABELS, LABELS))
    agree = np.ones(2)
    for text in texts:
        g = lattice(text, *base_spans(text))
        if g is None:
            continue
        y = np.maximum(g.observed, 0)
        features.append(g.features)
        labels.append(y)
        np.add.at(pair, (y[g.chain[:, 0]], y[g.chain[:, 1]]), 1)
        np.add.at(pair, (np.zeros(int(g.edge[:, 0].sum()), int), y[g.edge[:, 0]]), 1)
        np.add.at(pair, (y[g.edge[:, 1]], np.zeros(int(g.edge[:, 1].sum()), int)), 1)
        entity = (y[g.skip] > 0).any(axis=1)
        equal = y[g.skip[entity, 0]] == y[g.skip[entity, 1]]
        agree += (equal.sum(), (~equal).sum())
    x, y = np.concatenate(features), np.concatenate(labels)
    target = np.eye(LABELS)[y]
    weight = np.zeros((FEATURES, LABELS))
    for _ in range(rounds):
        score = x @ weight
        p = np.exp(score - _log_sum(score, 1)[:, None])
        weight += 2.0 * (x.T @ (target - p) / len(x) - 1e-3 * weight)
    share = pair / pair.sum()
    ratio = np.log(share / (share.sum(axis=1, keepdims=True) * share.sum(axis=0, keepdims=True)))
    # Agreement among the sample's similar tokens says too little where there are few.
    return Field(weight, np.clip(ratio, -3, 3), float(np.clip(np.log(agree[0] / agree[1]), 4, 6)))


def added_spans(field: Field, text: str, spans: list[Span], g: Lattice, sure: float) -> list[Span]:
    """Runs of unobserved tokens with one label, each token surer than ``sure``.

    A run needs a similar token inside a pattern match of its kind: the field spreads what
    the patterns saw, it does not guess on shapes alone.
    """
    if not (g.observed > 0).any() or not (g.observed < 0).any():
        return []
    p = marginals(field, g)
    label = np.where(p.max(axis=1) >= sure, p.argmax(axis=1), 0)
    label[g.observed >= 0] = 0
    backed = np.zeros(len(label), bool)
    for a, b in ((0, 1), (1, 0)):
        i, j = g.skip[:, a], g.skip[:, b]
        backed[i[g.observed[j] == label[i]]] = True
    # Support spreads along similar tokens of the same label.
    for _ in range(len(label)):
        i, j = g.skip[:, 0], g.skip[:, 1]
        same = (label[i] == label[j]) & (label[i] > 0) & (backed[i] != backed[j])
        if not same.any():
            break
        backed[i[same]] = backed[j[same]] = True
    joined = {tuple(e) for e in g.chain.tolist()}
    found: list[Span] = []
    k = 0
    while k < len(label):
        end = k
        while label[k] and (end, end + 1) in joined and label[end + 1] == label[k]:
            end += 1
        if label[k] and backed[k : end + 1].any():
            found.append((int(label[k]) - 1, int(g.start[k]), int(g.end[end])))
        k = end + 1
    return [s for s in found if not any(s[1] < b and a < s[2] for _, a, b in spans)]


# --- the operator ------------------------------------------------------------------


def train(docs: DataFrame, text_col: str = "text", max_rows: int = 2000, max_bytes: int = 100_000) -> Field:
    """Fit the field on at most ``max_rows`` documents with a digit or ``@``, those with the
    smallest text hash among texts of at most ``max_bytes`` bytes. Finding reads all texts."""
    text = F.col(text_col)
    sample = (
        docs.where(F.octet_length(text) <= max_bytes)
        .where(text.rlike("[0-9@]"))
        .select(F.xxhash64(text).alias("h"))
        .distinct()
        .orderBy("h")
        .limit(max_rows)
    )
    # ``sample`` has at most ``max_rows`` hashes.
    rows = (
        docs.where(F.octet_length(text) <= max_bytes)
        .select(F.xxhash64(text).alias("h"), text.alias("text"))
        .join(F.broadcast(sample), "h")
        .groupBy("h")
        .agg(F.min("text").alias("text"))
        .orderBy("h")
        .limit(max_rows)
        .toArrow()
    )
    return fit(rows["text"].to_pylist())


def find(text: str, field: Field, sure: float = 0.9) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, each by kind and start."""
    if not _ANY.search(text):
        return [], []
    spans, failed = base_spans(text)
    spans.sort()
    if not spans:
        return [], []
    g = lattice(text, spans, failed)
    return spans, sorted(added_spans(field, text, spans, g, sure)) if g else []


def _find(field: Field, sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _ in slices(batches):
            columns: list[list] = [[] for _ in range(4)]
            for text in batch.column("text").to_pylist():
                base, added = find(text or "", field, sure)
                rows = [(*s, False) for s in base] + [(*s, True) for s in added]
                for k, column in enumerate(columns):
                    column.append([r[k] for r in rows])
            spans = pa.StructArray.from_arrays(
                [
                    pa.array(columns[0], pa.list_(pa.int32())),
                    pa.array(columns[1], pa.list_(pa.int32())),
                    pa.array(columns[2], pa.list_(pa.int32())),
                    pa.array(columns[3], pa.list_(pa.bool_())),
                ],
                ["kind", "start", "stop", "added"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("id"), spans], ["id", "found"])

    return run


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sure: float = 0.9, **training
) -> DataFrame:
    """One row per document: ``(id_col, spans)``, an array of kind, start, stop and added.

    Positions are code points, the end exclusive. A null or empty text has no spans.
    Repeated rows and null ids are searched each; other columns are ignored; an empty table
    gives no rows. A document without a pattern match gets no span from the field, as there
    is nothing to be consistent with.
    """
    field = train(docs, text_col, **training)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    found = texts.mapInArrow(
        _find(field, sure),
        "id bigint, found struct<kind:array<int>,start:array<int>,stop:array<int>,added:array<boolean>>",
    )
    zipped = F.arrays_zip("found.kind", "found.start", "found.stop", "found.added")
    return found.select(
        F.col("id").alias(id_col),
        F.transform(
            zipped,
            lambda s: F.struct(
                F.get(kinds, s["kind"]).alias("kind"),
                s["start"].alias("start"),
                s["stop"].alias("stop"),
                s["added"].alias("added"),
            ),
        ).alias("spans"),
    )


def personal_data_report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Counts of base spans per kind, a hash of the base spans, and all spans as text."""
    found = personal_data(docs, id_col, **options)
    base = F.filter("spans", lambda s: ~s["added"])
    order = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*[F.lit(x) for k, i in order.items() for x in (k, i)])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    def joined(spans):
        ranked = F.array_sort(
            F.transform(
                spans,
                lambda s: F.struct(
                    rank[s["kind"]].alias("r"),
                    s["start"].alias("a"),
                    F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")).alias("t"),
                ),
            )
        )
        return F.array_join(F.transform(ranked, lambda s: s["t"]), ",")

    return found.select(
        id_col,
        *[count(k) for k in KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["added"])).cast("bigint").alias("n_added"),
    )
