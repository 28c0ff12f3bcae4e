"""Row layouts shared by the operators."""

from pyspark.sql import types as T

_INTS = T.ArrayType(T.IntegerType())
_STRINGS = T.ArrayType(T.StringType())

# One parsed sentence. ``head`` holds 0-based positions inside the sentence and points
# to itself at a root; ``start``/``end`` are character offsets inside ``text``.
SENTENCE = T.StructType(
    [
        T.StructField("sent_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("head", _INTS),
        T.StructField("pos", _STRINGS),
        T.StructField("dep", _STRINGS),
        T.StructField("lower", _STRINGS),
        T.StructField("start", _INTS),
        T.StructField("end", _INTS),
    ]
)
SENTENCES = T.ArrayType(SENTENCE)

# One row per chunk (or per text, in sentence mode).
PARSES = T.StructType(
    [
        T.StructField("text_id", T.LongType()),
        T.StructField("chunk_id", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("sents", SENTENCES),
    ]
)

# Serialized sentence document, one JSON line each.
CACHE = T.StructType(
    [
        T.StructField("text_id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("sentence_id", T.IntegerType()),
        T.StructField("sentence_text", T.StringType()),
        T.StructField(
            "doc_json",
            T.StructType(
                [
                    T.StructField("text", T.StringType()),
                    T.StructField(
                        "sents",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("start", T.IntegerType()),
                                    T.StructField("end", T.IntegerType()),
                                ]
                            )
                        ),
                    ),
                    T.StructField(
                        "tokens",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("id", T.IntegerType()),
                                    T.StructField("start", T.IntegerType()),
                                    T.StructField("end", T.IntegerType()),
                                    T.StructField("tag", T.StringType()),
                                    T.StructField("pos", T.StringType()),
                                    T.StructField("morph", T.StringType()),
                                    T.StructField("lemma", T.StringType()),
                                    T.StructField("dep", T.StringType()),
                                    T.StructField("head", T.IntegerType()),
                                ]
                            )
                        ),
                    ),
                ]
            ),
        ),
    ]
)

# Normalized corpus row; ``raw`` is the untouched input row as JSON.
CORPUS = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField(
            "metadata",
            T.StructType(
                [
                    T.StructField("split", T.StringType()),
                    T.StructField("raw", T.StringType()),
                ]
            ),
        ),
    ]
)

METADATA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("path", T.StringType()),
    ]
)

RESULTS = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("feature_set", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("f1_macro", T.DoubleType()),
    ]
)
