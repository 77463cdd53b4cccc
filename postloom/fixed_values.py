"""Data contracts, word lists, patterns and defaults.

These have to keep the values users of the existing scripts rely on, so that
results stay the same.  They are plain values, not logic.
"""

# Envelope of one firehose message (JSON in the message value).
FIREHOSE_SCHEMA = """
    did string,
    time_us bigint,
    kind string,
    commit struct<
        rev: string,
        operation: string,
        collection: string,
        rkey: string,
        record: struct<
            `$type`: string,
            text: string,
            langs: array<string>,
            createdAt: string
        >
    >
"""

# Columns of a message topic, as the Kafka connector delivers them.
TOPIC_SCHEMA = """
    key binary,
    value binary,
    topic string,
    partition int,
    offset bigint,
    timestamp timestamp
"""

# A new post.
POST_KIND = "commit"
POST_OPERATION = "create"
POST_COLLECTION = "app.bsky.feed.post"

# Key of a message that carries no `did` field.
UNKNOWN_KEY = "unknown"

# Watermarks and windows.
ACTIVITY_WATERMARK = "1 minute"
ACTIVITY_WINDOW = "2 minutes"
ACTIVITY_SLIDE = "1 minute"
HEALTH_WATERMARK = "1 minute"
HEALTH_WINDOW = "1 minute"
HEALTH_SLIDE = "30 seconds"
POSTS_WATERMARK = "3 minutes"
POSTS_WINDOW = "2 minutes"
TUMBLING_WATERMARK = "2 minutes"
TUMBLING_WINDOW = "2 minutes"

# Admission control and triggers.
ANALYTICS_MAX_OFFSETS = 10_000
COLLECTION_MAX_OFFSETS = 200_000
COLLECTION_SECONDS = 20
COLLECTION_TRIGGER = "5 seconds"
BYTES_PER_POST = 1024

# Mean delay in seconds below which a window earns the grade.
LATENCY_GRADES = [(1, "Excellent"), (5, "Good"), (15, "Fair")]
LATENCY_GRADE_ELSE = "Poor"

# Report sizes.
REPORT_ROWS = 10
TOP_LANGUAGES = 15
TOP_LANGUAGE_WINDOWS = 20

# Table names of the live dashboards.
LANGUAGE_TABLE = "language_counts_kafka_table"
POSTS_TABLE = "raw_posts_kafka_table"
HEALTH_TABLE = "health_metrics_kafka_table"

# Text rules.
NSFW_KEYWORDS = [
    "porn", "sex", "nude", "sexy", "fuck", "cock", "cum", "blowjob",
    "dick", "tits", "ass", "horny", "slut", "nsfw", "onlyfans",
]
STOPWORDS = [
    "the", "and", "a", "of", "in", "to", "is", "it", "for", "on",
    "que", "de", "le", "la", "el", "en", "und", "der", "die",
]
URL_TOKEN = r"^(https?://\S+|www\.\S+)"
MAX_URL_SHARE = 0.5
CHAT_ECHO = r"(?i)model\s+Provide a concise topic\.?\s*model"

# Prompt of the cluster labeller.
PROMPT_HEAD = (
    "Summarize the following 10 posts into 1 concise topic of 3–6 words in English. "
    "If a certain language is very prevelent include that as first word. "
    "Do NOT include emojis, quotes, punctuation, hashtags, URLs, or extra commentary.\n\n"
)

# Embedding, clustering and sampling.
ANALYSIS_ROW_CAP = 15_000
ARROW_BATCH_ROWS = 100
ENCODER_BATCH = 32
REDUCED_DIM = 64
REDUCE_SEED = 2025
MIN_CLUSTER_SIZE = 40
NOISE = -1
SAMPLE_SIZE = 10
SAMPLE_SEED = 42
PROMPT_POSTS = 5
