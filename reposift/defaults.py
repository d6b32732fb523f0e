"""Default parameters.

Fixed values: they have to equal the defaults users already rely on, so that
results stay comparable.
"""

# Duplicate search
SIMILARITY_THRESHOLD = 0.85
KNN_LIMIT = 3
EMBED_BATCH_SIZE = 64

# Reviewer scoring
HALF_LIFE_DAYS = 180
DIRECTORY_FALLBACK_WEIGHT = 0.8
REVIEWER_TOP_K = 2
SCORE_DECIMALS = 2
DEFAULT_COMMIT_WEIGHT = 1.0

# Pair corpus and labelling
CLASSIFY_MIN_COSINE = 0.40
MAX_ISSUE_TEXT_CHARS = 12_000
TRUNCATION_NOTE = "\n\n[TRUNCATED: issue text exceeded the maximum length for classification.]"
POSITIVE_TRUST = 0.90
NEGATIVE_TRUST = 0.85
DUPLICATE_TYPES = ["same_bug", "same_feature_request", "same_question", "not_duplicate", "unclear"]
FINAL_ROUTES = ["auto_label", "manual_review"]
LABEL_OUTPUT_COLUMNS = [
    "repo",
    "issue_1_number",
    "issue_1_text",
    "issue_2_number",
    "issue_2_text",
    "cosine_similarity",
    "is_duplicate",
    "final_confidence",
]

# Events
ISSUE_ACTIONS = ["opened", "reopened"]
PR_ACTIONS = ["opened", "reopened", "synchronize"]

# Calibration
HISTOGRAM_BINS = 50
KDE_GRID = 200
F1_EPSILON = 1e-10
