"""Fixed values of the routing domain.

FIXED VALUES: everything in this module must equal the behaviour being
reproduced (thresholds, tier names, prices, keyword lists, pattern texts).
They are stated plainly, in natural order, and are not derived.  Exception: the
three ``model_id`` names in the price rows are this package's own placeholders.
"""

# -- fixed values: quality and routing thresholds --------------------------
QUALITY_THRESHOLD = 0.8          # a tier "passes" when its score >= 0.8
JUDGE_PASS_SCORE = 0.80          # a judge PASS also needs score >= 0.80
AUTO_ACCEPT_SCORE = 0.90         # skip verification when p(initial) >= 0.90
TIER_1_THRESHOLD = 0.8           # frozen routing policy
TIER_2_THRESHOLD = 0.7
FALLBACK_TIER = "tier_3"
SOLVABLE_SUCCESS_TARGET = 0.88   # acceptable policy configurations
BORDERLINE_MARGIN = 0.10
MAX_PROMPT_CHARS = 20000
HISTORY_DEFAULT_LIMIT = 50
HISTORY_MAX_LIMIT = 100

# -- fixed values: tiers and their price list (USD per million tokens) -----
TIERS = ["tier_1", "tier_2", "tier_3"]
PRICE_ROWS = [
    ("tier_1", 1, "model-small", 0.25, 1.50),
    ("tier_2", 2, "model-medium", 0.30, 2.50),
    ("tier_3", 3, "model-large", 0.75, 3.75),
]
MODES = ["economy", "balanced"]
DEFAULT_MODE = "balanced"

# -- fixed values: threshold grids of the policy studies -------------------
SWEEP_THRESHOLDS = [0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
GRID_THRESHOLDS = [0.40, 0.50, 0.60, 0.70, 0.80, 0.90]
SENSITIVITY_THRESHOLDS = [0.60, 0.70, 0.80, 0.90]
SENSITIVITY_PAIRS = [(0.60, 0.70), (0.70, 0.80), (0.80, 0.90)]

# -- fixed values: pass patterns (bits for tier_1, tier_2, tier_3) ---------
PASS_PATTERNS = [
    ("111", "All three pass"),
    ("011", "Tier 1 fails; Tier 2+3 pass"),
    ("001", "Only Tier 3 passes"),
    ("000", "Nobody passes"),
    ("101", "Tier 1 + Tier 3 pass; Tier 2 fails"),
    ("110", "Tier 1 + Tier 2 pass; Tier 3 fails"),
    ("010", "Only Tier 2 passes"),
    ("100", "Only Tier 1 passes"),
]

# -- fixed values: prompt keyword lists (matched as substrings) ------------
REASONING_KEYWORDS = [
    "explain", "analyze", "compare", "evaluate", "design", "reason",
    "justify", "debug", "optimize", "trade-off", "tradeoff", "architecture",
]
TECHNICAL_KEYWORDS = [
    "api", "database", "redis", "docker", "kubernetes", "async", "fastapi",
    "python", "algorithm", "distributed", "latency", "scalability",
    "race condition", "vector database", "rag", "llm",
]
CODE_MARKERS = ["```", "def ", "class ", "import "]

# -- fixed values: routing decision reasons --------------------------------
REASON_TIER_1 = "Tier 1 predicted success score passed its threshold."
REASON_TIER_2 = "Tier 1 did not meet its threshold, but Tier 2 did."
REASON_FALLBACK = ("Neither Tier 1 nor Tier 2 met the required routing "
                   "threshold, so the strongest tier was selected.")

# -- fixed values: benchmark strategies and judge prefixes -----------------
STRATEGIES = ["always_tier_3", "ml_only", "autopilot"]
BASELINE_STRATEGY = "always_tier_3"
STRATEGY_PREFIXES = [("always_tier_3", "ALWAYS_TIER_3"),
                     ("ml_only", "ML_ONLY"),
                     ("autopilot", "AUTOPILOT")]
DEFAULT_JUDGE_REASON = "No reason provided."

# -- fixed values: text-model parameters ------------------------------------
TFIDF_MIN_DF = 2
TFIDF_MAX_FEATURES = 40000
LR_MAX_ITER = 2000
LR_TOL = 1e-4                    # the solver's default stopping tolerance
CALIBRATION_FOLDS = 3
SEED = 42

# Whitespace as Python's str.isspace() sees it, as a regex class body that
# both Java regex and RE2 accept (RE2's \s lacks \x0b, so it is listed).
PY_SPACE_CLASS = r"\s\x0b\x1c-\x1f\x85\p{Z}"
# Python's Unicode \w: letters, numbers and underscore.
WORD_CLASS = r"\p{L}\p{N}_"
