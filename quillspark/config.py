"""Parameters of retrieval, ledger and rendering: data only."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Profile:
    """What a retrieval profile weighs and how much it returns."""

    candidate_limit: int
    selection_limit: int
    max_prompt_chars: int
    guaranteed_recent: int
    recent_window_days: int
    half_life_days: int
    similarity: float
    recency: float
    keyword: float
    short_max: int
    short_boost: float
    short_min_score: float
    short_budget_ratio: float
    timestamp_style: str = "datetime"
    force_recent: bool = False


# The profiles.
PROFILES = {
    "chat": Profile(150, 40, 28000, 6, 14, 21, 0.76, 0.14, 0.10, 150, 0.12, 0.12, 0.15, timestamp_style="date"),
    "longform": Profile(160, 48, 40000, 28, 90, 45, 0.64, 0.18, 0.18, 200, 0.08, 0.10, 0.12, force_recent=True),
    "consulting": Profile(120, 48, 32000, 12, 45, 30, 0.66, 0.12, 0.22, 180, 0.12, 0.10, 0.16),
    "explore": Profile(110, 48, 32000, 12, 45, 35, 0.64, 0.12, 0.24, 180, 0.10, 0.10, 0.15),
    "reframe": Profile(50, 20, 18000, 8, 10, 7, 0.56, 0.28, 0.16, 120, 0.06, 0.15, 0.10, force_recent=True),
}
#: A note counts as recent above this recency score.
RECENT_SCORE = 0.2
RECENT_BONUS = 0.2

# Ranks of polarities, for the winner of a state key and for display.
WINNER_RANK = {"measurement": 4, "decision": 4, "constraint": 3, "identity": 3, "estimate": 2, "plan": 1}
DISPLAY_RANK = {"measurement": 0, "decision": 1, "constraint": 2, "estimate": 3, "plan": 4, "identity": 5}
POLARITIES = ("measurement", "decision", "estimate", "plan", "hypothesis", "constraint", "identity")
STATE_POLARITIES = ("measurement", "decision", "estimate", "plan", "constraint", "identity")

# Words that are no query terms.
STOP_WORDS = (
    "about", "after", "again", "also", "because", "been", "being", "from", "have", "into", "just", "more", "most",
    "much", "only", "over", "same", "than", "that", "their", "them", "then", "there", "these", "they", "this", "today",
    "very", "what", "when", "where", "which", "with", "would", "your",
)

# Attributes that say nothing by themselves, and the ladder that upgrades them (first match wins).
HOLLOW_ATTRIBUTES = (
    "price", "amount", "value", "cost", "number", "total", "monthly", "price.monthly", "price_monthly", "size", "quantity", "qty",
)
ATTRIBUTE_LADDER = (
    (r"month|mensual|subscription|suscrip", "subscription_price_monthly"),
    (r"unit cost|per shrimp|por camar[oó]n|each shrimp", "unit_cost"),
    (r"\bsize\b|grade|16/20|21/25|u/?\d", "size_grade"),
    (r"per taco|quantity|qty|pieces? per|piezas", "quantity_per_unit"),
    (r"buffet|b[aá]sico|premium", "menu_price"),
)
UNSPECIFIED_ATTRIBUTE = "value_unspecified"

# What a claim that stands alone has or lacks, and what marks a derived analysis.
ROLE_WORDS = (
    r"(per month|monthly|buffet|roas|sold|sales|subscription|price of|fee|spend|cogs|taco|guest|staff|rent|ads?|shrimp"
    r"|size|grade|unit cost|per shrimp|recipe|plan|considering|thinking)\b"
)
PRONOUN_CLAIM = r"^(price|amount|value|cost|it|this|size|quantity)\s+(is|=)\s+"
DERIVED_PHRASES = r"(you think|your realistic|scenario|option [ab]:|break-even|reconstructed)"

# The extractor and its limits.
EXTRACTOR_VERSION = "v3"
MAX_ATTEMPTS = 4
MAX_FACTS_PER_NOTE = 40
CHUNK_CHARS = 2800
CHUNK_OVERLAP = 200
SKIP_MIN_CHARS = 12
DEMOTED_CONFIDENCE = 0.55
SAMPLE_LIMIT = 100

# Limits of a sync call, of the backfill loop, and of an error's text.
DEFAULT_SYNC_LIMIT = 15
MAX_SYNC_LIMIT = 40
BACKFILL_LIMIT = 12
MAX_BACKFILL_ROUNDS = 80
MAX_ERROR_CHARS = 500

# Limits of the state in prompts.
MAX_STATE_CHARS = 12000
STATE_FRACTION = 0.45
COMBINE_OVERHEAD = 320
MAX_SUPERSESSIONS = 25

# Requests for vectors.
EMBEDDING_BATCH = 12
EMBEDDING_CHARS = 28000
EMBEDDING_DIMENSIONS = 768
EMBEDDING_MODEL = "embedding-default"
