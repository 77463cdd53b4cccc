"""Message topics on Kafka, through Spark's own connector.

The connector is a package of its own; name it with ``spark.jars.packages``.
"""

from postloom import fixed_values as V
from postloom.operators.decode import decode_messages

TOPIC_COLUMNS = ["key", "value", "topic", "partition", "offset", "timestamp"]

# Fixed format of the PLAIN login line.
LOGIN_LINE = (
    "org.apache.kafka.common.security.plain.PlainLoginModule required "
    'username="{user}" password="{password}";'
)


def login_options(user=None, password=None, protocol="SASL_PLAINTEXT"):
    """SASL/PLAIN options, or none unless both credentials are given."""
    if not (user and password):
        return {}
    return {
        "kafka.security.protocol": protocol,
        "kafka.sasl.mechanism": "PLAIN",
        "kafka.sasl.jaas.config": LOGIN_LINE.format(user=user, password=password),
    }


def read_options(servers, topic, starting="latest", max_offsets=None, group_prefix=None,
                 min_partitions=None, user=None, password=None, min_offsets=None, max_delay=None):
    """Source options as strings.

    A batch takes at most ``max_offsets`` messages.  With ``min_offsets`` it waits for that many, but
    no longer than ``max_delay``, so that a trickle does not become many small batches.
    ``group_prefix`` names consumer groups: each query gets a group of its own
    under it, so that queries do not take messages from each other.
    """
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": starting,
        "maxOffsetsPerTrigger": max_offsets,
        "minOffsetsPerTrigger": min_offsets,
        "maxTriggerDelay": max_delay,
        "groupIdPrefix": group_prefix,
        "minPartitions": min_partitions,
        **login_options(user, password),
    }
    return {name: str(value) for name, value in options.items() if value is not None}


def write_options(servers, topic, user=None, password=None, **producer):
    """Sink options; ``producer`` settings pass through, with ``_`` for a dot."""
    tuned = {f"kafka.{name.replace('_', '.')}": str(value) for name, value in producer.items()}
    return {
        "kafka.bootstrap.servers": servers,
        "topic": topic,
        **login_options(user, password),
        **tuned,
    }


def kafka_messages(spark, servers, topic, max_offsets=V.ANALYTICS_MAX_OFFSETS, **options):
    """The topic as a stream of undecoded messages, ``max_offsets`` per batch at most.

    The default suits the live job; the collection job takes ``COLLECTION_MAX_OFFSETS``.
    """
    chosen = read_options(servers, topic, max_offsets=max_offsets, **options)
    return spark.readStream.format("kafka").options(**chosen).load().select(*TOPIC_COLUMNS)


def kafka_stream(spark, servers, topic, **options):
    """The topic as a stream of decoded messages, see ``kafka_messages``."""
    return decode_messages(kafka_messages(spark, servers, topic, **options))


def collection_messages(spark, servers, topic, max_offsets=V.COLLECTION_MAX_OFFSETS, **options):
    """The topic for the collection job, in larger batches."""
    return kafka_messages(spark, servers, topic, max_offsets, **options)


def kafka_batch(spark, servers, topic, starting="earliest", **options):
    """What the topic holds now, as a batch of decoded messages."""
    chosen = read_options(servers, topic, starting, **options)
    return decode_messages(spark.read.format("kafka").options(**chosen).load())
