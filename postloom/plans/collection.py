"""The collection job: new posts from a feed into a Parquet table."""

from postloom import fixed_values as V
from postloom.operators import decode
from postloom.operators.posts import collected_posts
from postloom.streaming.fanout import Table, fan_out
from postloom.streaming.runner import run_for
from postloom.streaming.sinks import to_parquet


def start_collection(parsed, path, checkpoint, every=V.COLLECTION_TRIGGER):
    """Append new posts to ``path`` until stopped; without ``every``, until the input ends."""
    return to_parquet(collected_posts(parsed), path, checkpoint, "collection", every=every)


def collect_for(parsed, path, checkpoint, seconds=V.COLLECTION_SECONDS,
                every=V.COLLECTION_TRIGGER):
    """Collect for ``seconds``; returns the finished query with its progress."""
    return run_for(start_collection(parsed, path, checkpoint, every), seconds)


def start_checked_collection(messages, output, checkpoint, every=V.COLLECTION_TRIGGER):
    """Undecoded messages into ``posts`` and ``dead_letters`` below ``output``, from one read."""
    tables = {
        "posts": Table(lambda held, *_: collected_posts(decode.good_messages(held))),
        "dead_letters": Table(lambda held, *_: decode.dead_letters(held)),
    }
    return fan_out(messages, decode.marked_messages, tables, output, checkpoint, "collection", every)
