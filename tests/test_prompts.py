"""Openings, lookups and call metadata."""

from pyspark.sql import functions as F

from tessera.operators import prompts


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_openings(spark):
    say = lambda t, n, c=None: one(spark, prompts.opening(F.lit(t), F.lit(n).cast("string"), F.lit(c).cast("string")))
    assert say("Hi {first_name} of {company}: {name}", "Max Mueller", "ACME") == "Hi Max of ACME: Max Mueller"
    assert say("Hi {first_name}", None) == "Hi there" and say("Hi {first_name}{company}", "", None) == "Hi there"
    assert say("Hi {first_name} {order}", "Max") == "Hi {first_name} {order}"


def test_lookups_and_replies(spark):
    r = spark.createDataFrame([(1, i, "weather", None if i == 4 else "s" * 400, i == 3) for i in range(5)], "call_id int, seq int, name string, summary string, stub boolean")
    lines = prompts.last_lookups(r).first().block.split("\n")
    assert len(lines) == 6 and lines[1] == '    "' + "s" * 300 + '"' and prompts.STUB_TAG in lines[2] and lines[5] == '    "(no summary)"'
    assert one(spark, prompts.last_reply(F.lit("x" * 281))) == "x" * 280 + "…" and one(spark, prompts.last_reply(F.lit(None).cast("string"))) == ""
    assert one(spark, prompts.assembled(F.lit("a"), F.lit(""), F.lit(None).cast("string"), F.lit("b"))) == "a\n\nb"


def test_addresses(spark):
    assert one(spark, prompts.room_phone(F.lit("call-+49172555_ab_c"))) == "+49172555"
    assert one(spark, prompts.sip_host(F.lit("sip:me@host.example:5060;x=y"))) == "host.example" and one(spark, prompts.sip_host(F.lit("host.example"))) == "host.example"
