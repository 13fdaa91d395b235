"""Fixed values. Results only agree with the published behaviour if these stay as they are."""

# Spanish stopwords left out of token overlap.
STOPWORDS = (
    "a", "al", "ante", "bajo", "con", "contra", "de", "del", "desde", "durante",
    "el", "en", "entre", "hacia", "hasta", "la", "las", "lo", "los", "mediante",
    "para", "por", "segun", "sin", "sobre", "tras", "un", "una", "unas", "uno",
    "unos", "y", "e", "ni", "o", "u", "que", "se", "es", "esta", "son", "como",
)

# Roman numerals with an arabic twin.
ROMAN_NUMERALS = {
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5",
    "vi": "6", "vii": "7", "viii": "8", "ix": "9", "x": "10",
}

# File types accepted for ingestion.
DOCUMENT_EXTENSIONS = (".pdf", ".docx", ".pptx", ".html", ".md", ".txt", ".xlsx")

# Known latency phases, in report order.
PHASES = (
    "preprocessor_ms", "vector_ms", "bm25_ms", "rrf_ms", "retrieval_ms", "reranker_ms",
    "router_keyword_ms", "router_llm_ms", "crag_ms", "synthesis_ms", "total_ms",
)

# Question type to expected source.
TYPE_TO_SOURCE = {
    "rag": "unstructured",
    "sql": "structured",
    "hybrid": "hybrid",
    "negative": "unstructured",
    "out_of_domain": "unstructured",
}

# Phrases that mark an answer as an abstention (regular expressions).
ABSTENTION_PATTERNS = (
    r"no cuento con suficiente información",
    r"información no encontrada",
    r"no dispongo de.*información",
    r"no tengo.*información.*suficiente",
    r"no es posible responder",
    r"no se encuentra.*en el contexto",
    r"fuera del alcance",
    r"no puedo responder",
    r"no hay información.*disponible",
)

# Patterns that mark a SQL text as an injection attempt.
INJECTION_PATTERNS = (
    r";\s*--",
    r";\s*/\*",
    r"'\s*OR\s*'1'\s*=\s*'1",
    r"'\s*OR\s+1\s*=\s*1",
    r"INTO\s+OUTFILE",
    r"INTO\s+DUMPFILE",
    r"LOAD_FILE\s*\(",
    r"BENCHMARK\s*\(",
    r"SLEEP\s*\(",
    r"WAITFOR\s+DELAY",
    r";\s*(?:DROP|DELETE|UPDATE|INSERT|ALTER|CREATE)",
)

# Patterns forbidden in a read-only SQL text.
FORBIDDEN_PATTERNS = (
    r";\s*DROP\s+",
    r";\s*DELETE\s+",
    r";\s*UPDATE\s+",
    r";\s*INSERT\s+",
    r";\s*ALTER\s+",
    r";\s*CREATE\s+",
    r";\s*TRUNCATE\s+",
    r"--",
    r"/\*",
    r"EXEC\s*\(",
    r"EXECUTE\s*\(",
    r"xp_",
    r"sp_",
)

# Error texts worth a retry.
RETRYABLE_ERRORS = ("connection", "timeout", "deadlock", "lock wait", "too many connections")

# Sentence put before the sources of an answer.
SOURCES_PREAMBLE = (
    "You may use the following sources if needed to answer the user's question. "
    "If you don't know the answer, say \"I don't know.\""
)

# Ablation configurations (id, bm25, vector, rrf, prefilter, reranker, grading, alpha).
ABLATION_CONFIGS = (
    ("C1", True, False, False, False, False, False, 0.0),
    ("C2", False, True, False, False, False, False, 1.0),
    ("C3", True, True, True, False, False, False, 0.5),
    ("C4", True, True, True, True, False, False, 0.5),
    ("C5", True, True, True, False, True, False, 0.5),
    ("C6", True, True, True, True, True, False, 0.6),
    ("C7", False, True, False, False, False, False, 1.0),
    ("C6_crag", True, True, True, True, True, True, 0.6),
)

# Reading a grade from an upper-cased response; the first rule that matches decides.
GRADE_RULES = (
    ("IRRELEVANT", r"IRRELEVANT|NO RELEVANTE"),
    ("RELEVANT", r"RELEVANT|RELEVANTE"),
    ("AMBIGUOUS", r"AMBIGUOUS|AMBIGUO"),
    ("IRRELEVANT", r"NO\s*(ES\s*)?RELEV|IRRELEV|SIN\s*RELEV"),
    ("RELEVANT", r"RELEV|ÚTIL|PERTINENTE|APLICABLE"),
)

# Tags in a question that force its source.
OVERRIDE_TAGS = r"NO\s+ESTRUCTURADO|ESTRUCTURADO|H[ÍI]BRIDO"
