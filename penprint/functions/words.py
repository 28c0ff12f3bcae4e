"""Fixed vocabularies."""

# Base list for literal leaves in mixed motifs (42 words).
LITERAL_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had",
    "has", "have", "he", "her", "his", "i", "in", "is", "it", "its", "me", "my",
    "not", "of", "on", "or", "she", "that", "the", "their", "them", "there", "they",
    "this", "to", "was", "we", "were", "with", "you",
]

# Function-word vocabulary in feature order (54 words).
FUNCTION_WORDS = [
    "the", "and", "of", "to", "a", "in", "that", "is", "it", "was", "i", "for", "on",
    "you", "with", "as", "have", "be", "at", "or", "not", "this", "but", "they",
    "his", "her", "she", "he", "we", "their", "my", "me", "so", "if", "there", "what",
    "which", "who", "whom", "been", "when", "were", "would", "do", "did", "had",
    "can", "could", "should", "will", "just", "than", "then", "them",
]

# Dependency labels counted as clauses.
CLAUSE_DEPS = ["acl", "advcl", "ccomp", "relcl", "xcomp"]

# Accepted spellings of the two corpus labels.
HUMAN_LABELS = ["human", "gold", "human_written", "real", "0"]
LLM_LABELS = ["llm", "machine", "generated", "ai", "1"]
