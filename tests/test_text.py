"""Text kernel, chunking and redaction on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import fixed, rules, text
from tessera.operators import chunking, training
from tessera.sources import files


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Sind Parkschäden an der Stoßstange in der Vollkasko gedeckt?", ["parkschad", "stossstang", "vollkasko", "gedeckt"]),
        ("Wie spät ist es in Tokio?", ["spat", "tokio"]),
        ("§ 4 Straßen gegessen", ["§", "strass", "gegess"]),
        ("Français élève 12", ["fran", "ais", "ve", "12"]),
        ("", []),
        (None, []),
    ],
)
def test_tokens(spark, value, want):
    assert one(spark, text.tokens, value) == want


def test_estimates_and_keys(spark):
    assert [one(spark, text.estimate_tokens, v) for v in ("", "abc", "a" * 9)] == [1, 1, 2]
    assert one(spark, lambda t: text.content_hash(F.lit("BAAI/bge-m3"), t), "abc") == "62d575ff570f32379e3f18c39bfcbf18c9e47109b817e3bc0a35e36e7ac66929"
    assert one(spark, lambda t: text.point_id(t, F.lit("KK-300:§ 4")), "kk-300") == "888c754f-0e52-5fa3-80c9-061bbe39bfcb"


def test_windows_of_a_long_clause(spark):
    body = "§ 9 Lang\n" + " ".join(f"wort{i}" for i in range(400))
    got = one(spark, lambda t: text.windows(t, 50, 10), body)
    w = body.split()
    assert len(got) == 19 and got[0].split() == w[:26] and got[1].split() == w[21:47] and got[-1].split() == w[378:403]
    assert max(max(1, len(g) // 4) for g in got) == 51
    assert one(spark, lambda t: text.windows(t, 50, 10), "short") == ["short"]


def docs(spark, body, product="KK-300"):
    return spark.createDataFrame([("d", "policy", product, "de", body)], "doc_id string, doc_type string, product_code string, lang string, text string")


def test_sections_and_chunks(spark):
    body = "Vorspann\nTeil A: Umfang\n\n§ 1 Erstes\nText eins.\n4.2 Höhe der Leistung\nBetrag gemäß § 7 gilt.\n§ 2b Zweites\nText zwei."
    assert [r.marker for r in chunking.sections(docs(spark, body)).orderBy("seq").collect()] == ["Teil A", "§ 1", "4.2 H", "§ 2b"]
    got = chunking.chunks(docs(spark, body)).orderBy("seq").collect()
    assert [r.clause_id for r in got] == ["KK-300:§ 1", "KK-300:4.2 H", "KK-300:§ 2b"] and got[0].section_path == "§ 1"
    long = chunking.chunks(docs(spark, "§ 9 Lang\n" + " ".join(f"wort{i}" for i in range(400))), 50, 10).orderBy("seq").collect()
    assert [r.clause_id for r in long] == ["KK-300:§ 9", *[f"KK-300:§ 9#{i}" for i in range(1, 19)]]
    plain = chunking.chunks(docs(spark, "no marker", None)).collect()
    assert [(r.clause_id, r.section_path) for r in plain] == [("d:root", "root")]


def test_front_matter(spark, tmp_path):
    (tmp_path / "x.md").write_text("Body only.\n")
    (tmp_path / "y.md").write_text('---\ndoc_id: kk\ndoc_type: regulation\nproduct_code: "KK-300"\nlang: en\n---\n\nBody.\n')
    (tmp_path / "z.md").write_text("---\nnever closed\n")
    got = {r.doc_id: r for r in files.corpus(spark, str(tmp_path)).collect()}
    assert (got["x"].doc_type, got["x"].lang, got["x"].product_code, got["x"].text) == ("policy", "de", None, "Body only.")
    assert (got["kk"].doc_type, got["kk"].product_code, got["kk"].lang, got["kk"].text) == ("regulation", "KK-300", "en", "Body.")
    assert got["z"].text == "---\nnever closed"
    with pytest.raises(FileNotFoundError):
        files.whole_files(spark, str(tmp_path), "*.txt")


@pytest.mark.parametrize(
    ("value", "want"),
    [
        (
            "My policy is DE-HUK-2024-884421, VIN WVWZZZ1JZ3W386752, plate B-MM 4421, phone +49 172 555 0100, email max.mueller@email.de, born 1984-03-15.",
            "My policy is [POLICY], VIN [VIN], plate [PLATE], phone [PHONE], email [EMAIL], born [DOB].",
        ),
        ("My card 4242 4242 4242 4242.", "My card [CARD]."),
        ("Card no 4111111111111111 expires.", "Card no [CARD]expires."),
        ("DE89 3704 0044 0532 0130 00 is mine.", "[IBAN] is mine."),
        ("SVNR 12 030484 W 023 handed over.", "SVNR [SVNR] handed over."),
        ("case number is 2026-04-25-7711.", "case number is [DOB]-7711."),
        ("room 12345.", "room [PHONE]."),
        ("licence B072RRE2I55 there", "licence [DL] there"),
    ],
)
def test_redaction(spark, value, want):
    assert one(spark, rules.redact, value) == want


def test_summary_and_json(spark):
    long = "wort " * 80
    got = one(spark, lambda t: text.summary(F.lit("KK:§ 1"), F.lit("§ 1"), t), long)
    assert got.startswith("Laut KK:§ 1 (§ 1): wort") and got.endswith("wort…") and len(got) < 270
    assert one(spark, text.json_object, 'so: ```{"a": {"b": 1}}``` done') == '{"a": {"b": 1}}'
    assert one(spark, text.json_object, "none") is None


def test_word_spans(spark):
    line = "My car got hit on [[accident_location:the A4 near Köln-Ost]] in [[weather_conditions:pouring rain]]. Plate was [[other_party_plate:K-AB 1234]]."
    words, spans = training.word_spans(line)
    assert len(words) == 16 and spans == [(5, 8, "accident_location"), (10, 11, "weather_conditions"), (14, 15, "other_party_plate")]
    blocks = spark.createDataFrame([(f"{line}\n\nshort [[road_type:x]]\n\nNo markers in this long line of text at all.\n \n{line}",)], "text string")
    got = training.examples(blocks).collect()
    assert len(got) == 2 and [tuple(x) for x in got[0].ner] == spans
    assert one(spark, training.unmarked, "in [[road_type:the city]] now") == "in the city now"


def test_rule_tables_are_consistent():
    assert len(fixed.REDACTIONS) == 12 and len(fixed.INTENTS) == 15 and len(fixed.PILLARS) == 13
    assert set(fixed.COMMON_PILLARS + fixed.AUTO_PILLARS + fixed.HEALTH_PILLARS) <= {p for p, _ in fixed.PILLARS}
