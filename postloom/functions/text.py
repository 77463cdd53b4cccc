"""Text rules as column expressions, so that they stay inside the JVM.

Java's ``\\w`` and ``\\s`` know ASCII only, so the word and space classes are
spelled out for Unicode.
"""

from pyspark.sql import functions as F

from postloom import fixed_values as V
from postloom.functions.vectors import let

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x1c-\x1f\x85"


def squeeze(text):
    """One blank for each run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def strip(text):
    """Without white space, of any Unicode kind, at both ends."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def words(text):
    return F.split(squeeze(text), " ")


def normalize_post(text):
    """Lower case without mentions, hash signs, digits, extra space and stopwords."""
    lowered = F.lower(text)
    without_mentions = F.regexp_replace(lowered, f"@[{WORD}]+", "")
    without_hashes = F.translate(without_mentions, "#", " ")
    without_digits = F.regexp_replace(without_hashes, "[0-9]+", "")
    kept = F.filter(words(without_digits), lambda word: ~word.isin(V.STOPWORDS))
    return F.array_join(kept, " ")


def is_meaningful(text):
    """Has a word character, and not more than half of the words are URLs."""

    def few_urls(tokens):
        urls = F.filter(tokens, lambda word: word.rlike(V.URL_TOKEN))
        return F.size(urls) / F.size(tokens) <= V.MAX_URL_SHARE

    return text.rlike(f"[{WORD}]") & let(words(text), few_urls)


def is_nsfw(text, whole_word=False):
    """Contains a listed keyword anywhere, or as a word of its own on request."""
    pattern = "|".join(V.NSFW_KEYWORDS)
    if whole_word:
        pattern = f"(?<![{WORD}])(?:{pattern})(?![{WORD}])"
    return F.lower(text).rlike(pattern)


def label_text(text):
    """A post as shown to the labeller: no URLs, no punctuation, single blanks."""
    without_urls = F.regexp_replace(text, f"http[^{SPACE}]+", "")
    return squeeze(F.regexp_replace(without_urls, f"[^{WORD}{SPACE}]", ""))


def label_answer(generated):
    """The labeller's own words: what follows the last echo of the chat prompt."""
    parts = F.split(squeeze(generated), V.CHAT_ECHO)
    return squeeze(F.element_at(parts, -1))
