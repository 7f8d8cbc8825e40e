"""Fixed values and default limits the operators share."""

# Section labels in reading order.
SECTION_LABELS = (
    "abstract",
    "introduction",
    "related_work",
    "methodology",
    "results",
    "discussion",
    "limitations",
    "conclusion",
    "future_work",
    "other",
)
REFERENCES = "references"

# Sections whose similarity is boosted, per task.
TASK_SECTIONS = {
    "research_gap": ("limitations", "future_work", "discussion"),
    "comparison": ("methodology", "results"),
    "novelty": ("abstract", "introduction", "conclusion"),
    "summary": ("abstract", "introduction", "results", "conclusion"),
    "literature_review": ("abstract", "methodology", "results", "discussion"),
    "keyword_extraction": ("abstract", "introduction", "methodology"),
    "qa": (),
}

# Passages fetched per task (a question may ask for 1..20).
TASK_TOP_K = {
    "summary": 24,
    "keyword_extraction": 24,
    "comparison": 12,
    "research_gap": 30,
    "literature_review": 30,
    "novelty": 30,
    "qa": 8,
}

# Model tier per task.
TASK_TIER = {
    "metadata_cleanup": "fast",
    "keyword_extraction": "fast",
    "classification": "fast",
    "summary": "strong",
    "qa": "strong",
    "comparison": "strong",
    "research_gap": "strong",
    "novelty": "strong",
    "literature_review": "strong",
}

# Factors, thresholds, limits.
SECTION_BOOST = 1.25
RELEVANCE_FLOOR = 0.35
DUPLICATE_COSINE = 0.92
DUPLICATE_TITLE = 0.72
CONTEXT_CHARS = 18_000
CHUNK_TOKENS = 512
ENCODER_WINDOW = 256
OVERLAP_TOKENS = 64
MIN_CHUNK_TOKENS = 50
MAX_PAGES = 400
MAX_CHARS = 4_000_000
MIN_DOC_CHARS = 200
MAX_UPLOAD_BYTES = 25 * 1024 * 1024
INDEX_VERSION = 1
MAX_ATTEMPTS = 3
RETRY_BASE_MS = 2_000
WINDOW_SECONDS = 60
LOOKUP_TTL_SECONDS = 600

# Accepted states.
PROCESSING_STATES = ("queued", "processing", "completed", "failed", "metadata_only")
READING_STATES = ("to_read", "reading", "read")
JOB_STATES = ("queued", "running", "completed", "failed")
CONCEPT_TYPES = ("keyword", "method", "dataset", "metric", "domain")
CONFIDENCE = ("low", "medium", "high")
