"""Fixed values that results depend on.

FIXED VALUES: these lists must stay exactly as written (content and order) for the scores,
tags and penalties to be right. Order matters for tags (first five kept) and for the
fixture domain assignment.
"""

# Source score per lower-cased domain; any other domain scores DEFAULT_SOURCE_SCORE.
SOURCE_SCORES = [
    ("techcrunch.com", 9.0),
    ("theverge.com", 8.5),
    ("arstechnica.com", 9.0),
    ("wired.com", 8.5),
    ("thenextweb.com", 7.5),
    ("zdnet.com", 7.0),
    ("cnet.com", 7.0),
    ("engadget.com", 7.5),
    ("venturebeat.com", 8.0),
    ("bloomberg.com", 9.0),
    ("reuters.com", 8.5),
    ("github.com", 8.0),
    ("medium.com", 6.0),
    ("dev.to", 6.5),
    ("hackernoon.com", 6.5),
    ("infoq.com", 7.5),
    ("openai.com", 9.0),
    ("anthropic.com", 9.0),
    ("google.com", 8.5),
    ("microsoft.com", 8.0),
]
DEFAULT_SOURCE_SCORE = 5.0

# Keywords counted (substring match, lower case) for the keyword boost.
TRENDING_KEYWORDS = [
    "ai", "gpt", "llm", "claude", "gemini", "openai", "anthropic",
    "flutter", "dart", "kotlin", "swift", "rust", "go", "python",
    "kubernetes", "docker", "cloud", "aws", "gcp", "azure",
    "machine learning", "deep learning", "neural", "transformer",
    "open source", "github", "apple", "google", "microsoft",
    "android", "ios", "react", "typescript", "java", "spring",
    "security", "vulnerability", "breach", "crypto", "blockchain",
    "startup", "funding", "acquisition", "ipo",
]

# Phrases that cost a title 3 points (once).
CLICKBAIT_PATTERNS = [
    "you won't believe", "shocking", "this one trick",
    "click here", "must see", "jaw-dropping", "unbelievable",
    "blown away", "incredible secret",
]

# Tags in output order; matched case-insensitively as substrings.
TAG_KEYWORDS = [
    "AI", "Machine Learning", "Flutter", "Python", "JavaScript",
    "TypeScript", "Rust", "Go", "Java", "Kubernetes", "Docker",
    "Cloud", "Security", "Open Source", "Android", "iOS",
    "React", "LLM", "GPT", "Blockchain", "Crypto", "Startup",
]

# Operator parameters (effective configuration).
TOP_N = 30
MAX_PER_DOMAIN = 5
STORE_CAP = 150
STORE_TRIM_BATCH = 50
HN_MIN_SCORE = 50
HN_TOP_STORIES = 100
REDDIT_MIN_UPVOTES = 100
REDDIT_MIN_COMMENTS = 20
RSS_MAX_AGE_HOURS = 12
SIMILARITY_THRESHOLD = 0.7
MEMORY_HOURS = 24
MEMORY_EXPIRE_HOURS = 48
SUMMARY_MAX_WORDS = 80
CONTENT_MAX_WORDS = 800
RSS_DESCRIPTION_MAX = 500
SUMMARY_MIN_VALID_WORDS = 5
SUMMARY_MAX_VALID_WORDS = 100
RUN_INTERVAL_HOURS = 1

# Score weights, summed in this order.
WEIGHTS = (0.4, 0.2, 0.2, 0.1, 0.1)
