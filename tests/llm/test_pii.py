import pytest

from conftest import tuples
from lodestack.llm import pii
from lodestack.llm.words import words

FAMILY, GIVEN = ["Arkmere", "Oldcroft", "Wendberg"], ["Minla", "Torvi", "Elso"]
NAMES = pii.Names(FAMILY, GIVEN)


@pytest.fixture(scope="module")
def model():
    return pii.train(NAMES)


@pytest.mark.parametrize("text,kind,item", [
    ("Write to ann.lee@mail.corp.example, please.", "email", "ann.lee@mail.corp.example"), ("to minla [at] hq [dot] corp [dot] test, how?", "email", "minla [at] hq [dot] corp [dot] test"), ("by torvi(at)corp-it.example now", "email", "torvi(at)corp-it.example"), ("X.Y@TEAM.CORP.TEST is open", "email", "X.Y@TEAM.CORP.TEST"),
    ("Call +1 (879) 555-0130 if it is red.", "phone", "+1 (879) 555-0130"), ("dial 0049 30 23125 961 and wait", "phone", "0049 30 23125 961"), ("Who answers (224) 555 0157 ext. 18 today?", "phone", "(224) 555 0157 ext. 18"), ("hotline: 01 99 00 58 62", "phone", "01 99 00 58 62"),
    ("Someone pasted SSN 937-34-4349 into it.", "id_number", "937-34-4349"), ("quotes passport no. X41528163 by mistake", "id_number", "X41528163"), ("we saw tax ID 72 368 634 018, remove it", "id_number", "72 368 634 018"), ("my national id 551217-1813.", "id_number", "551217-1813"),
    ("Ship it to 83 Birchmoor Avenue, Apt 7, Elmminster before noon.", "address", "83 Birchmoor Avenue, Apt 7, Elmminster"), ("parts go to 214, rue de Kelgate, 92349 Isterburg.", "address", "214, rue de Kelgate, 92349 Isterburg"), ("to Gartenstraße 217 a, Jovhaven", "address", "Gartenstraße 217 a, Jovhaven"),
    ("Ask Minla Arkmere about it.", "person", "Minla Arkmere"), ("changed by torvi oldcroft.", "person", "torvi oldcroft"), ("Did Wendberg, Elso approve it?", "person", "Wendberg, Elso"), ("According to Dr. Arkmere it is fine", "person", "Dr. Arkmere"), ("Handover: Elso M. WENDBERG", "person", "Elso M. WENDBERG"),
])
def test_items(model, text, kind, item):
    got = [(s.kind, text[s.start : s.end]) for s in pii.entities(text, model, NAMES)]
    assert got == [(kind, item)]
    assert pii.redact(text, pii.entities(text, model, NAMES)) == text.replace(item, pii.PLACEHOLDER[kind])


@pytest.mark.parametrize("text", ["Order 4-137083137 covers 6 units.", "Serial SN 817-45-8426 belongs to it.", "Ticket INC-4675556362 tracks it.", "The node at 10.52.225.212 runs build 2024461420.", "Replace logo@2x.png and icon@3x.png.", "The Arkmere adapter reads it.", "Host torvi-32 was moved.", "Lane 5 of the pipeline feeds Street View tiles.", "It took 150 days to migrate the 300 pages.", "", None])
def test_no_items(model, text):
    assert pii.entities(text, model, NAMES) == []


#: Written by hand, in sentences that ``training_sentences`` does not use.
UNSEEN = [
    ("Ring 555 0199.", [("phone", "555 0199")]), ("Call 030 1234567 / 030 7654321 now", [("phone", "030 1234567"), ("phone", "030 7654321")]), ("The number for the error report is 020 7946 0926.", [("phone", "020 7946 0926")]), ("Our new office: 12 Harbour Street, Millport.", [("address", "12 Harbour Street, Millport")]), ("It stands at 207b Fengate Rd, Elmford", [("address", "207b Fengate Rd, Elmford")]),
    ("Minla Arkmere and Dr. Oldcroft were late.", [("person", "Minla Arkmere"), ("person", "Dr. Oldcroft")]), ("My e-mail is a.b@c.example; passport C12345678.", [("email", "a.b@c.example"), ("id_number", "C12345678")]), ("Wir treffen uns Am Ring 5, 12345 Elmstadt.", [("address", "Am Ring 5, 12345 Elmstadt")]),
    ("Invoice 4711-00812 was paid.", []), ("The server at 10.0.12.7 is down.", []), ("Version 2.14.1003.7 is out.", []), ("It took 300 days and 20 people.", []), ("Oldcroft engines are loud.", []), ("Set 100 200 300 400 500 600 700 800 900 aside.", []),
]


def test_unseen_sentences(model):
    wrong = [(t, got) for t, want in UNSEEN if (got := [(s.kind, t[s.start : s.end]) for s in pii.entities(t, model, NAMES)]) != want]
    assert len(wrong) <= 1, wrong


def test_training_sentences_hold_no_sentence_of_the_tables(spark, data):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    names = spark.read.parquet(f"{data}/name_parts.parquet").collect()
    family, given = ([n.name_part for n in names if n.part_kind == k] for k in ("family", "given"))
    seen = set()
    for name, col in (("pages", "content_text"), ("feedback", "comment"), ("feedback", "question")):
        for (t,) in spark.read.parquet(f"{data}/{name}.parquet").select(col).distinct().collect():
            seen |= runs(t)
    assert not seen & set().union(*(runs(t) for t, _ in pii.training_sentences(family, given, 3000)))


def test_held_out_accuracy(model):
    found = wrong = total = 0
    for text, gold in pii.training_sentences(FAMILY, GIVEN, 400, seed=1234):
        got = {(s.start, s.end, s.kind) for s in pii.entities(text, model, NAMES)}
        found, wrong, total = found + len(got & set(gold)), wrong + len(got - set(gold)), total + len(gold)
    assert found / total > 0.93 and wrong / total < 0.06


def test_odd_rows(spark):
    rows = [("t", "1", "f", "Ask Minla Arkmere."), ("t", "1", "f", "Ask Minla Arkmere."), ("t", "2", "f", None), ("t", "3", "f", ""), ("t", None, "f", "a@b.example " * 3000), ("t", "4", "f", "nothing")]
    df = spark.createDataFrame(rows, "rec_table string, rec_key string, rec_field string, text string").selectExpr("*", "1 AS pii_types")
    names = spark.createDataFrame([("Arkmere", "family"), ("Minla", " Given "), (None, "family"), ("", "given"), ("Arkmere", "family")], "name_part string, part_kind string")
    got = pii.redact_fields(df, names)
    assert tuples(pii.types_found(got)) == [("t", "1", "f", "person"), ("t", None, "f", "email")]
    assert got.where("rec_key = '1'").first().clean_text == "Ask [PERSON]." and got.where("rec_key IS NULL").first().n_items == 3000
    assert pii.types_found(pii.redact_fields(df, names.where("false"))).count() == 1
    assert pii.redact_fields(df.where("false"), names).count() == 0
