import pytest

from postloom.session import work_dir, write_and_read
from postloom.sources import kafka
from postloom.sources.tables import table


def test_options_without_login():
    assert kafka.read_options("h:9092", "t") == {
        "kafka.bootstrap.servers": "h:9092", "subscribe": "t", "startingOffsets": "latest",
    }


@pytest.mark.parametrize("user, password", [("u", None), (None, "p"), ("u", ""), ("", "p")])
def test_login_needs_both(user, password):
    assert kafka.login_options(user, password) == {}


def test_options_with_everything():
    options = kafka.read_options("h", "t", "earliest", 10_000, "analytics", 64, "u", "p")
    assert options["startingOffsets"] == "earliest"
    assert options["maxOffsetsPerTrigger"] == "10000"
    assert options["groupIdPrefix"] == "analytics"
    assert options["minPartitions"] == "64"
    assert options["kafka.security.protocol"] == "SASL_PLAINTEXT"
    assert options["kafka.sasl.mechanism"] == "PLAIN"
    assert options["kafka.sasl.jaas.config"] == (
        "org.apache.kafka.common.security.plain.PlainLoginModule required "
        'username="u" password="p";'
    )


def test_write_options():
    options = kafka.write_options("h", "t", compression_type="snappy", linger_ms=10)
    assert options == {
        "kafka.bootstrap.servers": "h", "topic": "t",
        "kafka.compression.type": "snappy", "kafka.linger.ms": "10",
    }


def test_scan_reads_only_its_columns(spark, folder):
    scan = table(spark, folder, "documents", "doc_id", "lang").where("lang = 'en'")
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan
    assert "EqualTo(lang,en)" in plan


def test_work_folders_are_fresh_and_shared(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    first, second = work_dir(spark, "a"), work_dir(spark, "a")
    assert first != second
    if base:
        assert first.startswith(base)


def test_written_table_has_no_lineage(spark):
    again = write_and_read(spark.range(10).repartition(2), "numbers")
    assert again.count() == 10
    assert "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
