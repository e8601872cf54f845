"""Every constant of the pipeline in one place, and settings from the environment."""

import os

# sectioning and packing
MAX_CHUNK = 800
MIN_CHUNK = 100
MIN_BODY = 10
JOIN_CHARS = 2

# retrieval
TOP_K = 5
OVERFETCH_RERANK = 3
OVERFETCH_VECTOR = 3
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
BM25_SCALE = 0.05
WEIGHT_SEMANTIC, WEIGHT_KEYWORD = 1.0, 0.3
MIN_HIT_CHARS = 100
CONTEXT_CHARS = 2000
EVAL_TOP_K = 8
# Fixed value: what stands before a query that is encoded for retrieval.
INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

# models behind boundaries
RETRIES = 2
PAGES_PER_SEGMENT = 100

# quality
ISSUE_SMALL, ISSUE_LARGE, EMPTY_CODE = 100, 2000, 50
RATE_GOOD, RATE_POOR = 5.0, 15.0
GRADES = ((0.85, "优秀"), (0.70, "良好"), (0.50, "及格"))
GRADE_LOW = "需改进"
SHORT_DOCUMENT = 10_000

#: Queries, labels and catalog rows are broadcast only up to this many rows; larger ones go through a shuffle.
BROADCAST_ROWS = 20_000
#: Keys alone are broadcast up to so many.
BROADCAST_KEYS = 1_000_000


def setting(name: str, role: str = "", default: str | None = None, environment: dict[str, str] | None = None) -> str | None:
    """A setting: the role's own variable (ROLE_NAME), else the shared one (NAME), else the default; blank ones don't count.

    Read on the driver when a boundary is made; such values never stand in a plan.
    """
    held = os.environ if environment is None else environment
    return next((v for v in (held.get(f"{role}_{name}".upper()) if role else None, held.get(name.upper())) if v and v.strip()), default)
