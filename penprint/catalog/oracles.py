"""The same results in SQL, for a single-machine engine to check the queries against."""

from __future__ import annotations

from ..functions.text import END_MARKER, SPACE, START_MARKER, WORD
from ..functions.words import CLAUSE_DEPS, FUNCTION_WORDS, LITERAL_WORDS
from .queries import PIVOTED, SYNTAX
from .standins import DEP, END_LINE, POS, SPELLINGS, START_LINE


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values: list[str]) -> str:
    return "(" + _list(values)[1:-1] + ")"


def _strip(text: str) -> str:
    return rf"regexp_replace({text}, '\A{SPACE}+|{SPACE}+\z', '', 'g')"


def _words(text: str) -> str:
    return f"len(regexp_extract_all({text}, '{WORD}'))"


# --- derived inputs ----------------------------------------------------------------

MESSY = """messy AS (
  SELECT doc_id AS text_id,
    CASE WHEN doc_id % 7 = 0 THEN replace(t2, chr(10), chr(13) || chr(10)) ELSE t2 END AS text
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN replace(t1, ' ', ' ' || chr(9) || ' ') ELSE t1 END AS t2
    FROM (SELECT doc_id, replace(text, chr(10), repeat(chr(10), CASE WHEN doc_id % 3 = 0 THEN 3 ELSE 2 END)) AS t1
      FROM documents)))"""

NORMALIZED = _strip(
    "regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)),"
    r" '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')"
)

RAW = f"""raw AS (
  SELECT doc_id,
    CASE doc_id % 5 WHEN 3 THEN 'validation' WHEN 4 THEN 'test' ELSE 'train' END AS split,
    {_list(SPELLINGS)}[doc_id % 10 + 1] AS spelled, text,
    '{{"doc_id":' || doc_id || ',"lang":"' || lang || '","origin":"' || source || '"}}' AS raw
  FROM documents)"""

LABEL = (
    f"CASE WHEN lower({_strip('spelled')}) IN ('human', 'gold', 'human_written', 'real', '0') "
    "THEN 'human' ELSE 'llm' END"
)

# Tokens of the stand-in trees: i and head count from 0 inside a sentence of n words.
TOKENS = rf"""pieces AS (
  SELECT doc_id, unnest(l) AS piece, unnest(range(1, len(l) + 1)) AS sent_id FROM (
    SELECT doc_id, string_split(regexp_replace(text, '([.!?]+)\s+', '\1' || chr(1), 'g'), chr(1)) AS l
    FROM documents)),
sents AS (
  SELECT doc_id AS text_id, sent_id, w, len(w) AS n FROM (
    SELECT doc_id, sent_id, regexp_extract_all(piece, '{WORD}') AS w FROM pieces) WHERE len(w) > 0),
words AS (SELECT text_id, sent_id, n, unnest(w) AS word, unnest(range(0, n)) AS i FROM sents),
heads AS (
  SELECT *, CASE WHEN n % 2 = 0 THEN greatest(i - 1, 0) // 4
    ELSE n - 1 - greatest(n - 2 - i, 0) // 4 END AS head FROM words),
tok AS (
  SELECT text_id, sent_id, n, i, head, lower(word) AS lower,
    {_list(POS)}[length(word) % 7 + 1] AS pos,
    CASE WHEN head = i THEN 'ROOT' ELSE {_list(DEP)}[i % 8 + 1] END AS dep FROM heads)"""

# Depth by walking down; the ancestor pairs give subtree sizes.
DEPTHS = """deep AS (
  SELECT text_id, sent_id, i, 0 AS depth FROM tok WHERE head = i
  UNION ALL
  SELECT t.text_id, t.sent_id, t.i, d.depth + 1 FROM tok t JOIN deep d
    ON t.text_id = d.text_id AND t.sent_id = d.sent_id AND t.head = d.i WHERE t.head <> t.i)"""
CLIMBS = """climb AS (
  SELECT text_id, sent_id, i, i AS top FROM tok
  UNION ALL
  SELECT c.text_id, c.sent_id, c.i, t.head FROM climb c JOIN tok t
    ON t.text_id = c.text_id AND t.sent_id = c.sent_id AND t.i = c.top WHERE t.head <> t.i)"""
SIZES = "sizes AS (SELECT text_id, sent_id, top AS i, count(*) AS size FROM climb GROUP BY ALL)"
KIDS = """kids AS (
  SELECT text_id, sent_id, head AS i, count(*) AS children FROM tok WHERE head <> i GROUP BY ALL)"""


def _label(mode: str) -> str:
    plain = "'pos:' || pos || '|dep:' || dep"
    if mode == "category":
        return plain
    return f"CASE WHEN lower IN {_in(LITERAL_WORDS)} THEN 'tok:' || lower ELSE {plain} END"


def _motifs(mode: str, group: str) -> str:
    """Motif counts per group by direct enumeration of child subsets as bit masks."""
    return f"""arcs AS (
  SELECT text_id, sent_id, head, {_label(mode)} AS label FROM tok WHERE head <> i),
bags AS (
  SELECT a.text_id, a.sent_id, p.pos, list_sort(list(a.label)) AS labels
  FROM arcs a JOIN tok p ON p.text_id = a.text_id AND p.sent_id = a.sent_id AND p.i = a.head
  GROUP BY a.text_id, a.sent_id, a.head, p.pos HAVING count(*) >= 3),
masks AS (SELECT *, unnest(range(0, 1 << len(labels))) AS mask FROM bags),
motifs AS (
  SELECT {group}, pos || ':' || array_to_string(
    list_filter(labels, lambda x, j: (mask >> (j - 1)) & 1 = 1), '+') AS motif
  FROM masks WHERE bit_count(mask) >= 3),
counted AS (SELECT {group}, motif, count(*)::BIGINT AS cnt FROM motifs GROUP BY ALL)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _features(keys: str, text: str, source: str) -> str:
    """Feature rows over ``keys`` by plain aggregates, no identities."""
    on = "USING (text_id, sent_id, i)"
    clauses = ", ".join(
        f"count(*) FILTER (dep = '{d}')::BIGINT AS clause_{d}_count" for d in CLAUSE_DEPS
    )
    return (
        _with(TOKENS, DEPTHS, CLIMBS, SIZES, KIDS, recursive=True)
        + f"""SELECT {source}, agg.* EXCLUDE ({keys}) FROM {text} LEFT JOIN (
  SELECT {keys}, count(*)::BIGINT AS token_count, count(DISTINCT sent_id)::BIGINT AS sentence_count,
    round(avg(depth), 6) AS dependency_depth_mean, max(depth)::DOUBLE AS dependency_depth_max,
    min(depth)::DOUBLE AS dependency_depth_min,
    round(avg(coalesce(children, 0)), 6) AS branching_factor_mean,
    max(coalesce(children, 0))::DOUBLE AS branching_factor_max,
    min(coalesce(children, 0))::DOUBLE AS branching_factor_min,
    round(avg(size), 6) AS subtree_size_mean, max(size)::DOUBLE AS subtree_size_max,
    min(size)::DOUBLE AS subtree_size_min, {clauses}
  FROM tok JOIN deep {on} JOIN sizes {on} LEFT JOIN kids {on} GROUP BY ALL) agg"""
    )


def _doc_features(columns: str = "*", digits: int = 6) -> str:
    """Feature rows of whole documents; documents without words get zeros."""
    numbers = ", ".join(
        f"coalesce(agg.{c}, 0) AS {c}" for c in SYNTAX
    )
    inner = _features("text_id", "documents d", "d.doc_id, d.text")
    inner = inner.replace("agg.* EXCLUDE (text_id)", numbers) + " ON d.doc_id = agg.text_id"
    return f"SELECT {columns} FROM ({inner.replace(', 6)', f', {digits})')})"


HASH = "('0x' || substr(md5(doc_id || '-13'), 1, 8))::BIGINT"
IN_TRAIN = f"{HASH} >= 0.2 * 4294967296"

# Character n-grams with repeats, one row per position.
GRAMS = rf"""flat AS (
  SELECT doc_id, string_split(regexp_replace(lower(text), '{SPACE}{SPACE}+', ' ', 'g'), '') AS c FROM documents),
grams AS (
  SELECT doc_id, unnest(list_transform(range(1, len(c) - 1), lambda p: c[p] || c[p + 1] || c[p + 2])) AS gram FROM flat
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(c) - 2), lambda p: c[p] || c[p + 1] || c[p + 2] || c[p + 3])) FROM flat
  UNION ALL
  SELECT doc_id, unnest(list_transform(range(1, len(c) - 3), lambda p: c[p] || c[p + 1] || c[p + 2] || c[p + 3] || c[p + 4])) FROM flat)"""

SCALE = ", ".join(
    f"round((x.{c} - m.{c}_m) / CASE WHEN m.{c}_s = 0 THEN 1 ELSE m.{c}_s END, 6) + 0.0 AS {c}"
    for c in SYNTAX
)
MOMENTS = ", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in SYNTAX)

SENTENCE_LENGTHS = rf"""lengths AS (
  SELECT doc_id, unnest(list_transform(list_filter(regexp_split_to_array(text, '[.!?]+'),
    lambda s: regexp_matches(s, '[^{SPACE[1:]}')), lambda s: {_words('s')})) AS n FROM documents)"""

_ARMS = """arms AS (
  SELECT label, feature_set, model, 6 * a + 3 * b + c + 2 AS k FROM
    (VALUES ('quality', 0), ('toxic', 1)) l(label, a),
    (VALUES ('baseline', 0), ('combined', 1), ('syntax', 2)) f(feature_set, b),
    (VALUES ('linear_svm', 0), ('logistic_regression', 1), ('random_forest', 2)) m(model, c)),
results AS (
  SELECT label, feature_set, model, avg((doc_id % k <> 0)::INT) AS accuracy,
    avg((doc_id % (k + 1) <> 0)::INT) AS f1_macro
  FROM labels, arms GROUP BY label, feature_set, model)"""

_RAW_TEXT_LABEL = _with(RAW) + "SELECT split, text, spelled AS label FROM raw"

ORACLES: dict[str, str] = {
    # sources and sinks
    "src_text_files": f"SELECT source, sum({_words('text')})::BIGINT AS words, true AS ids_dense FROM documents GROUP BY source",
    "src_list_inputs": "SELECT source, sum(strlen(text) + 1)::BIGINT AS bytes FROM documents GROUP BY source",
    "src_jsonl_splits": _RAW_TEXT_LABEL,
    "src_csv_splits": _RAW_TEXT_LABEL,
    "src_corpus_parquet": "SELECT text, CASE WHEN item_id % 2 = 0 THEN 'human' END AS label, 'gutenberg' AS source, 'prose' AS domain, NULL::VARCHAR AS split, '{}' AS raw FROM benchmark",
    "src_features_parquet": _doc_features("doc_id AS text_id, text, token_count, dependency_depth_mean"),
    "src_parse_cache": _with(TOKENS)
    + """SELECT text_id, sent_id::INTEGER AS sentence_id, CASE WHEN text_id % 9 <> 0 THEN d.source END AS author,
  array_to_string(w, ' ') AS sentence_text, n::BIGINT AS tokens FROM sents JOIN documents d ON d.doc_id = text_id""",
    "sink_corpus_parquet": _with(RAW)
    + f"""SELECT 'detectrl' AS source, 'creative_writing' AS domain, {LABEL} AS label, split,
  count(*) AS rows, sum(length(text))::BIGINT AS chars FROM raw GROUP BY ALL""",
    "sink_features_parquet": _with(TOKENS)
    + """SELECT (SELECT count(*) FROM documents) AS rows, count(*) AS tokens,
  count(*) FILTER (dep = 'acl') AS acl FROM tok""",
    "sink_parse_cache": _with(TOKENS)
    + "SELECT count(*) AS sentence_total, count(DISTINCT text_id) AS text_total, true AS refused FROM sents",
    "sink_metadata_csv": """SELECT doc_id AS id, 'Doc, "' || doc_id || '"' AS title, source AS author,
  '/d/' || doc_id || '.txt' AS path, 2::BIGINT AS rows FROM documents""",
    "sink_results": _with(_ARMS)
    + "SELECT label, feature_set, model, round(accuracy, 6) AS accuracy, round(f1_macro, 6) AS f1_macro FROM results",
    # projections, filters, scalar functions
    "first_nonempty_field": _with(RAW) + "SELECT doc_id, text, spelled FROM raw",
    "normalize_label": _with(RAW) + f"SELECT doc_id, {LABEL} AS label FROM raw",
    "build_metadata": _with(RAW) + "SELECT doc_id, split, raw FROM raw",
    "tag_dataset": _with(RAW)
    + "SELECT doc_id, split, 'ghostbuster' AS source, 'creative_writing' AS domain FROM raw",
    "parse_filename_metadata": """SELECT doc_id,
  CASE doc_id % 5 WHEN 1 THEN '/d/Doc_' || doc_id || '.txt' WHEN 2 THEN '/d/-' || source || '.txt'
    WHEN 3 THEN '/d/Doc_' || doc_id || '-__.v2.txt' WHEN 4 THEN '/d/Doc_' || doc_id || '-__.txt'
    ELSE '/d/Doc_' || doc_id || '-' || source || '_' || lang || '-x.txt' END AS source_path,
  CASE WHEN doc_id % 5 = 2 THEN 'Unknown title' ELSE 'Doc ' || doc_id END AS title,
  CASE doc_id % 5 WHEN 0 THEN source || ' ' || lang WHEN 2 THEN source WHEN 3 THEN '.v2'
    ELSE 'Unknown' END AS author FROM documents""",
    "strip_header_footer": f"""WITH raw AS (SELECT doc_id,
    CASE WHEN doc_id % 4 <= 1 THEN 'license' || chr(10) || '{START_LINE}' || chr(10) ELSE '' END || text ||
    CASE WHEN doc_id % 4 IN (0, 2) THEN chr(10) || '{END_LINE}' || chr(10) || 'license' ELSE '' END AS t FROM documents),
  lines AS (SELECT doc_id, string_split(regexp_replace(t, '\\n\\z', ''), chr(10)) AS l FROM raw),
  marks AS (SELECT doc_id, l,
    coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '{START_MARKER}')), true), 0) AS first,
    coalesce(list_position(list_reverse(list_transform(l, lambda x: regexp_matches(x, '{END_MARKER}'))), true), 0) AS back FROM lines)
SELECT doc_id AS text_id, array_to_string(l[first + 1 : len(l) - back], chr(10)) AS text FROM marks""",
    "normalize_text": _with(MESSY) + f"SELECT text_id, {NORMALIZED} AS text FROM messy",
    "word_count": f"SELECT doc_id, {_words('text')}::BIGINT AS words FROM documents",
    "literal_words": f"SELECT unnest({_list(LITERAL_WORDS + ['upon'])}) AS word UNION SELECT lower(source) FROM documents",
    "child_label": _with(TOKENS)
    + f"SELECT text_id, {_label('mixed')} AS label, count(*) AS tokens FROM tok GROUP BY ALL",
    "clause_filter": _with(TOKENS)
    + f"SELECT text_id, sent_id::INTEGER AS sent_id, i::INTEGER AS token_i, lower, dep FROM tok WHERE dep IN {_in(CLAUSE_DEPS)}",
    "fill_missing": """SELECT doc_id, coalesce(quality, 0)::DOUBLE AS quality, coalesce(toxic, 0)::BIGINT AS toxic
  FROM documents LEFT JOIN labels USING (doc_id)""",
    "detect_label_columns": """WITH t AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
  seen AS (
    SELECT 1 AS spot, 'domain' AS name, count(DISTINCT source) AS n FROM t UNION ALL
    SELECT 2, 'quality_label', count(DISTINCT quality) FROM t UNION ALL
    SELECT 4, 'human_chars', count(DISTINCT n_chars) FROM t UNION ALL
    SELECT 5, 'main_language', count(DISTINCT lang = 'en') FROM t UNION ALL
    SELECT 6, 'AI_score', count(DISTINCT toxic) FROM t)
SELECT row_number() OVER (ORDER BY spot) - 1 AS ordinal, name AS column_name
FROM (SELECT 0 AS spot, 'author' AS name UNION ALL SELECT spot, name FROM seen WHERE n <= 2)""",
    "select_numeric_features": """SELECT n_chars, toxic, source = 'src1' AS is_src1
  FROM documents LEFT JOIN labels USING (doc_id)""",
    # chunkers
    "chunk_paragraphs": _with(MESSY)
    + f"""SELECT text_id, unnest(range(0, len(l)))::INTEGER AS chunk_id, unnest(l) AS text FROM (
  SELECT text_id, list_filter(list_transform(string_split({NORMALIZED}, chr(10) || chr(10)), lambda p: {_strip('p')}), lambda p: p <> '') AS l FROM messy)""",
    "chunk_window": f"""SELECT text_id, c::INTEGER AS chunk_id, array_to_string(w[c * 200 + 1 : c * 200 + 200], ' ') AS text FROM (
  SELECT text_id, w, unnest(range(0, (len(w) + 199) // 200)) AS c FROM (
    SELECT doc_id AS text_id, list_filter(regexp_split_to_array(text, '{SPACE}+'), lambda x: x <> '') AS w FROM documents))""",
    "chunk_sentences": f"""SELECT text_id, unnest(range(1, len(l) + 1))::INTEGER AS sentence_id, unnest(l) AS text FROM (
  SELECT doc_id AS text_id, list_filter(string_split(regexp_replace({_strip('text')}, '([.!?]+){SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_matches(s, '[^{SPACE[1:]}')) AS l FROM documents)""",
    "limit_sentences": f"""SELECT doc_id AS text_id, array_to_string(list_filter(string_split(regexp_replace({_strip('text')}, '([.!?]+){SPACE}+', '\\1' || chr(1), 'g'), chr(1)),
    lambda s: regexp_matches(s, '[^{SPACE[1:]}'))[1:3], ' ') AS text FROM documents""",
    "tokens_from_cache": _with(TOKENS)
    + "SELECT text_id, sent_id::INTEGER AS sent_id, i::INTEGER AS token_i, head::INTEGER AS head_i, lower, pos, dep FROM tok",
    "parse_hook": _with(TOKENS)
    + """SELECT text_id, count(*) AS tokens, count(DISTINCT sent_id)::INTEGER AS sentences, sum(head)::BIGINT AS heads,
  sum(length(lower))::BIGINT AS chars, count(*) FILTER (dep = 'relcl') AS relcl, count(*) FILTER (pos = 'VERB') AS verbs
FROM tok GROUP BY text_id""",
    # trees
    "dependency_depth": _with(TOKENS, DEPTHS, recursive=True)
    + "SELECT text_id, sent_id::INTEGER AS sent_id, i::INTEGER AS token_i, depth::INTEGER AS depth FROM deep",
    "subtree_size": _with(TOKENS, CLIMBS, SIZES, recursive=True)
    + "SELECT text_id, sent_id::INTEGER AS sent_id, i::INTEGER AS token_i, size::INTEGER AS subtree_size FROM sizes",
    "branching_factor": _with(TOKENS, KIDS)
    + """SELECT text_id, sent_id::INTEGER AS sent_id, i::INTEGER AS token_i, coalesce(children, 0)::INTEGER AS branching_factor
FROM tok LEFT JOIN kids USING (text_id, sent_id, i)""",
    "motif_counts": _with(TOKENS, _motifs("mixed", "text_id")) + "SELECT text_id, motif, cnt FROM counted",
    "clause_counts": _with(TOKENS)
    + "SELECT d.doc_id AS text_id, "
    + ", ".join(f"count(*) FILTER (dep = '{d}') AS clause_{d}_count" for d in CLAUSE_DEPS)
    + " FROM documents d LEFT JOIN tok ON tok.text_id = d.doc_id GROUP BY d.doc_id",
    # aggregations
    "token_sentence_counts": _with(TOKENS)
    + """SELECT d.doc_id AS text_id, count(tok.i) AS token_count, count(DISTINCT tok.sent_id) AS sentence_count
FROM documents d LEFT JOIN tok ON tok.text_id = d.doc_id GROUP BY d.doc_id""",
    "distribution_summary": """SELECT source, lang, quality, coalesce(round(avg(n_chars * toxic), 6), 0) AS mean,
  coalesce(max(n_chars * toxic), 0)::DOUBLE AS max, coalesce(min(n_chars * toxic), 0)::DOUBLE AS min
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source, lang, quality""",
    "chunk_features": _doc_features("doc_id AS text_id, 0::INTEGER AS chunk_id, * EXCLUDE (doc_id)"),
    "sentence_features": _features(
        "text_id, sent_id", "sents", "sents.text_id, sents.sent_id::INTEGER AS chunk_id, array_to_string(w, ' ') AS text"
    )
    + " ON sents.text_id = agg.text_id AND sents.sent_id = agg.sent_id",
    "motif_merge": _with(TOKENS, _motifs("category", "text_id, sent_id"))
    + "SELECT text_id, motif, sum(cnt)::BIGINT AS cnt FROM counted GROUP BY text_id, motif",
    "motif_pivot": _with(TOKENS, _motifs("category", "text_id"))
    + f""", top AS (SELECT motif FROM counted GROUP BY motif ORDER BY sum(cnt) DESC, motif LIMIT {PIVOTED})
SELECT t.text_id, t.tokens AS token_count, t.sentences AS sentence_count, top.motif, coalesce(c.cnt, 0)::BIGINT AS cnt
FROM (SELECT doc_id AS text_id, count(tok.i) AS tokens, count(DISTINCT tok.sent_id) AS sentences
    FROM documents LEFT JOIN tok ON tok.text_id = doc_id GROUP BY doc_id) t
  CROSS JOIN top LEFT JOIN (SELECT text_id, motif, sum(cnt) AS cnt FROM counted GROUP BY ALL) c
    ON c.text_id = t.text_id AND c.motif = top.motif""",
    "cache_summary": _with(TOKENS)
    + "SELECT count(*) AS sentence_total, count(DISTINCT text_id) AS text_total FROM sents",
    "cache_counts": _with(TOKENS)
    + """, named AS (SELECT CASE WHEN text_id % 9 <> 0 THEN d.source ELSE 'Unknown' END AS author, 'Doc ' || d.lang AS title
  FROM sents JOIN documents d ON d.doc_id = text_id)
SELECT 'author' AS kind, author AS name, count(*) AS sentences FROM named GROUP BY author
UNION ALL SELECT 'title', title, count(*) FROM named GROUP BY title""",
    "metadata_first_wins": _with(TOKENS)
    + """SELECT doc_id AS id, 'Doc ' || lang AS title, CASE WHEN doc_id % 9 <> 0 THEN source ELSE 'Unknown' END AS author,
  '/d/' || doc_id || '.txt' AS path FROM documents WHERE doc_id IN (SELECT text_id FROM sents)""",
    "metadata_row_count": "SELECT count(*) AS metadata_rows FROM documents",
    "results_pivot": _with(_ARMS)
    + "SELECT label, model, "
    + ", ".join(
        f"round(avg(accuracy) FILTER (feature_set = '{f}'), 6) AS {f}"
        for f in ("baseline", "combined", "syntax")
    )
    + " FROM results GROUP BY label, model",
    # stylometry
    "function_word_freq": f"""WITH w AS (SELECT doc_id, unnest(list_distinct(l)) AS word, l FROM (
    SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS l FROM documents)),
  hits AS (SELECT doc_id, word, len(list_filter(l, lambda x: x = word)) AS n FROM w
    WHERE length(word) > 1 AND word IN {_in(FUNCTION_WORDS)})
SELECT d.doc_id, v.word, round(coalesce(hits.n, 0) / greatest({_words('d.text')}, 1), 6) AS freq
FROM documents d CROSS JOIN (SELECT unnest({_list(FUNCTION_WORDS)}) AS word) v
LEFT JOIN hits ON hits.doc_id = d.doc_id AND hits.word = v.word""",
    "char_ngram_vocab": _with(GRAMS)
    + "SELECT gram, count(DISTINCT doc_id) AS df FROM grams GROUP BY gram HAVING count(DISTINCT doc_id) >= 2",
    "char_ngram_tfidf": _with(GRAMS)
    + f""", tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
train AS (SELECT doc_id FROM documents WHERE {IN_TRAIN}),
vocab AS (SELECT gram, ln((1 + (SELECT count(*) FROM train)) / (1 + count(*))) + 1 AS idf
  FROM tf JOIN train USING (doc_id) GROUP BY gram HAVING count(*) >= 2),
x AS (SELECT doc_id, tf, tf * idf AS x FROM tf JOIN vocab USING (gram)),
norm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id)
SELECT doc_id, count(*) AS grams, sum(tf)::BIGINT AS occurrences, round(sum(x / norm), 6) AS weight_sum,
  round(max(x / norm), 6) AS weight_max, round(sum((x / norm) * (x / norm)), 6) AS squares
FROM x JOIN norm USING (doc_id) GROUP BY doc_id""",
    "sentence_stats": _with(SENTENCE_LENGTHS)
    + """SELECT d.doc_id, coalesce(round(avg(n), 6), 0) AS sentence_mean, coalesce(round(stddev_pop(n), 6), 0) AS sentence_std,
  coalesce(min(n), 0)::DOUBLE AS sentence_min, coalesce(max(n), 0)::DOUBLE AS sentence_max
FROM documents d LEFT JOIN lengths USING (doc_id) GROUP BY d.doc_id""",
    "feature_union": _with(GRAMS, SENTENCE_LENGTHS)
    + f""", tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
vocab AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM tf GROUP BY gram HAVING count(*) >= 2),
x AS (SELECT doc_id, tf * idf AS x FROM tf JOIN vocab USING (gram)),
norm AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM x GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS grams, sum(x / norm) AS total, max(x / norm) AS top, sum((x / norm) * (x / norm)) AS squares
  FROM x JOIN norm USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '{WORD}'),
    lambda t: t IN {_in(FUNCTION_WORDS)} AND length(t) > 1)) / greatest({_words('text')}, 1) AS rate FROM documents),
s AS (SELECT doc_id, avg(n) AS mean, stddev_pop(n) AS std, min(n) AS low, max(n) AS high FROM lengths GROUP BY doc_id)
SELECT d.doc_id, round(w.rate, 6) AS word_rate, coalesce(g.grams, 0) AS grams, round(coalesce(g.total, 0), 6) AS weight_sum,
  round(g.top, 6) AS weight_max, round(coalesce(g.squares, 0), 6) AS squares, coalesce(round(mean, 6), 0) AS sentence_mean,
  coalesce(round(std, 6), 0) AS sentence_std, coalesce(low, 0)::DOUBLE AS sentence_min, coalesce(high, 0)::DOUBLE AS sentence_max
FROM documents d JOIN w USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "standard_scale": f"""WITH x AS ({_doc_features(digits=15)}),
m AS (SELECT {MOMENTS} FROM x WHERE {IN_TRAIN})
SELECT doc_id, {SCALE} FROM x, m""",
    "prepare_features": _with(
        f"x AS (SELECT f.*, quality FROM ({_doc_features(digits=15)}) f JOIN labels USING (doc_id))",
        GRAMS.replace("FROM documents", "FROM x"),
        SENTENCE_LENGTHS.replace("FROM documents", "FROM x"),
        recursive=True,
    )
    + f""", m AS (SELECT {MOMENTS} FROM x WHERE {IN_TRAIN}),
tf AS (SELECT doc_id, gram, count(*) AS tf FROM grams GROUP BY ALL),
train AS (SELECT doc_id FROM x WHERE {IN_TRAIN}),
vocab AS (SELECT gram, ln((1 + (SELECT count(*) FROM train)) / (1 + count(*))) + 1 AS idf
  FROM tf JOIN train USING (doc_id) GROUP BY gram HAVING count(*) >= 2),
v AS (SELECT doc_id, tf * idf AS v FROM tf JOIN vocab USING (gram)),
norm AS (SELECT doc_id, sqrt(sum(v * v)) AS norm FROM v GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS grams, sum(v / norm) AS total, max(v / norm) AS top, sum((v / norm) * (v / norm)) AS squares
  FROM v JOIN norm USING (doc_id) GROUP BY doc_id),
w AS (SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '{WORD}'),
    lambda t: t IN {_in(FUNCTION_WORDS)} AND length(t) > 1)) / greatest({_words('text')}, 1) AS rate FROM x),
s AS (SELECT doc_id, avg(n) AS mean, stddev_pop(n) AS std, min(n) AS low, max(n) AS high FROM lengths GROUP BY doc_id)
SELECT x.doc_id, quality, round(w.rate, 6) AS word_rate, coalesce(g.grams, 0) AS grams, round(coalesce(g.total, 0), 6) AS weight_sum,
  round(g.top, 6) AS weight_max, round(coalesce(g.squares, 0), 6) AS squares, coalesce(round(mean, 6), 0) AS sentence_mean,
  coalesce(round(std, 6), 0) AS sentence_std, coalesce(low, 0)::DOUBLE AS sentence_min, coalesce(high, 0)::DOUBLE AS sentence_max,
  {SCALE}
FROM x JOIN w USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id), m""",
    # modelling and evaluation
    "label_encode": """SELECT doc_id, lang, (dense_rank() OVER (ORDER BY lang) - 1)::DOUBLE AS label_index FROM documents""",
    "stratified_split": f"""WITH h AS (SELECT doc_id, lang, {HASH} AS hash FROM documents),
c AS (SELECT lang, count(*) AS n, sum(count(*)) OVER () AS whole FROM h GROUP BY lang),
ideal AS (SELECT lang, ceil(0.2 * whole) * n / whole AS x, ceil(0.2 * whole) AS want FROM c),
share AS (SELECT lang, floor(x) + (row_number() OVER (ORDER BY x - floor(x) DESC, lang)
    <= want - sum(floor(x)) OVER ())::INT AS take FROM ideal)
SELECT doc_id, lang, hash < 0.2 * 4294967296 AS is_test,
  row_number() OVER (PARTITION BY lang ORDER BY hash, doc_id) <= take AS is_test_exact
FROM h JOIN share USING (lang)""",
    "accuracy": "SELECT round(avg((doc_id % 5 <> 0)::INT), 6) AS accuracy FROM labels",
    "f1_macro": """WITH p AS (SELECT quality AS y, CASE WHEN doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS z FROM labels),
classes AS (SELECT y AS c FROM p UNION SELECT z FROM p),
f AS (SELECT c, 2 * count(*) FILTER (y = c AND z = c) / (count(*) FILTER (y = c) + count(*) FILTER (z = c)) AS f1
  FROM classes, p GROUP BY c)
SELECT round(avg(f1), 6) AS f1_macro FROM f""",
    # joins and unions
    "join_tokens_to_head": _with(TOKENS, DEPTHS, recursive=True)
    + """SELECT t.text_id, t.sent_id::INTEGER AS sent_id, t.i::INTEGER AS token_i, t.pos, h.pos AS head_pos, d.depth::INTEGER AS head_depth
FROM tok t JOIN tok h ON h.text_id = t.text_id AND h.sent_id = t.sent_id AND h.i = t.head
JOIN deep d ON d.text_id = t.text_id AND d.sent_id = t.sent_id AND d.i = t.head""",
    "corpus_union": _with(RAW)
    + f"""SELECT text, {LABEL} AS label, 'detectrl' AS source, 'creative_writing' AS domain, split, raw FROM raw
UNION ALL SELECT text, 'human', 'gutenberg', 'prose', NULL, '{{}}' FROM benchmark""",
    "attach_metadata": _with(TOKENS)
    + """SELECT d.doc_id AS text_id, count(tok.i) AS token_count, count(DISTINCT tok.sent_id) AS sentence_count,
  'Doc, "' || d.doc_id || '"' AS title, d.source AS author, '/d/' || d.doc_id || '.txt' AS path
FROM documents d LEFT JOIN tok ON tok.text_id = d.doc_id GROUP BY d.doc_id, d.source""",
}
