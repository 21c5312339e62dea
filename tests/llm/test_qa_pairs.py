import pytest

from conftest import tuples
from lodestack.llm import qa_pairs as qa

LISTS = [f"Open the plan.\n- {a} the cache\n- {b} the note\n- {a} the plan" for a in ("empty", "open") for b in ("keep", "check")] * 3
ANSWERS = ["The cache was emptied on Monday morning. Ask the change board.", "Open the plan and keep the note short. The work is done by the change board.", "Every record was checked after the export."] * 40 + LISTS
ENDS = qa.TerminalContexts(ANSWERS)
Q = "How do I empty the shared cache in Fenula?"


@pytest.mark.parametrize("answer", [None, "", "  ​\n", "N/A", "null", "[]", "—", "<p></p>", "<br/>&nbsp;", '""', "..."])
def test_empty(answer):
    assert qa.defect(Q, answer, ENDS) == "empty"


@pytest.mark.parametrize("answer", [Q, Q.upper(), f"**{Q}**", f"Q: {Q}", f'You asked: "{Q}"', f"{Q} {Q}", "  How  do  I  empty the shared cache in Fenula...", f"Question: {Q[:-1]}"])
def test_copy(answer):
    assert qa.defect(Q, answer, ENDS) == "copy"


@pytest.mark.parametrize("question,answer", [
    (Q, "I'm sorry, but I can't help with that. Please contact the storage team!"), (Q, "I won't be able to assist with requests about the cache"), (Q, "This request goes against my guidelines, as it may be restricted."),
    (Q, "I am not going to answer that"), (Q, "That is not something I will discuss."), (Q, "I'd rather not say"), (Q, "Sorry, no comment"), (Q, "My instructions forbid that."), ("Wo finde ich die Liste und wer darf sie ändern?", "Dazu kein Kommentar."), ("Où se trouve la page des notes?", "Je préfère ne pas en parler."), ("¿Dónde está la lista y quién la puede cambiar?", "Prefiero no hablar de eso."),
    ("Wie kann ich die Liste ändern?", "Diese Frage darf ich nicht beantworten."), ("Où se trouve la page des notes?", "Je ne suis pas autorisé à donner cette information"), ("¿Dónde está la lista y quién la puede cambiar?", "Lo siento, no puedo ayudar con eso."),
])
def test_refusal(question, answer):
    assert qa.defect(question, answer, ENDS) == "refusal"


@pytest.mark.parametrize("answer", ["Open the plan.\n- empty the cache\n- keep the", "The cache was emptied on", "The cache was emptied. Open the plan and kee", "Follow these steps:", "Keep the note short, link it to the plan (see the", "Run this:\n```\ntool drop --fo", "Every record was checked and,"])
def test_truncated(answer):
    assert qa.defect(Q, answer, ENDS) == "truncated"


def test_other_language():
    assert qa.defect(Q, "Die Liste ist leer, weil die Warteschlange nicht geprüft wurde.", ENDS) == "other_language"
    assert qa.defect("Wo finde ich die Liste und wer darf sie ändern?", "The cache was emptied on Monday morning.", ENDS) == "other_language"
    assert qa.defect(Q, "Lo siento, no puedo ayudar con eso.", ENDS) == "other_language"


@pytest.mark.parametrize("answer", [
    "Yes", "No.", "Ask the change board", "https://w.example/x/1", f"{Q} Here is what I found. The cache was emptied on Monday morning.", "I am sorry for the old page. The cache was emptied on Monday morning.", "You cannot empty it without approval. Ask the change board.",
    "The cache was emptied. 🙂", "Open the plan.\n- empty the cache\n- keep the note", "Run this:\n```\ntool drop --all\n```", 'It is done. (The board calls it "plan".)', f"Q: {Q}\nA: The cache was emptied on Monday morning by the change board.",
])
def test_sound_answers(answer):
    assert qa.defect(Q, answer, ENDS) is None


def test_odd_rows(spark):
    rows = [("1", None, None), ("1", None, None), ("2", None, "Yes"), (None, Q, Q), ("3", Q, "word " * 5000 + "end."), ("4", "", "")]
    df = spark.createDataFrame(rows, "feedback_id string, question string, answer string").selectExpr("*", "1 AS defect")
    assert tuples(qa.broken_pairs(df, ENDS)) == [("", "copy"), ("1", "empty"), ("4", "empty")]
    assert qa.broken_pairs(df.where("false")).count() == 0


def test_profile(spark, data):
    f = spark.read.parquet(f"{data}/feedback.parquet")
    broken = qa.broken_pairs(f)
    kinds = {r.defect for r in broken.collect()}
    assert kinds == {"empty", "copy", "refusal", "truncated", "other_language"}
    assert sum(r.n for r in qa.defect_profile(f, broken).collect()) == broken.count()


def test_last_words_are_judged_by_all_answers(spark, data):
    long = "The records of the old store were moved to the new store by the night shift and checked"
    rare = [f"{c}{v}llmer" for c in "bdfgk" for v in "aeiou"]
    rows = [(str(i), Q, f"{long} again.") for i in range(30_000)] + [(w, Q, f"{long} by {w}.") for w in rare] + [(f"{w}-open", Q, f"{long} by {w}") for w in rare] + [("cut", Q, f"{long} by xyll")]
    df = spark.createDataFrame(rows, "feedback_id string, question string, answer string").repartition(4)
    assert tuples(qa.broken_pairs(df)) == [("cut", "truncated")]
    f = spark.read.parquet(f"{data}/feedback.parquet")
    assert tuples(qa.broken_pairs(f)) == tuples(qa.broken_pairs(f, qa.TerminalContexts(r.answer for r in f.collect() if r.answer is not None)))


def test_copy_repeated_at_any_length():
    asked = "Could you tell me where I can find the list of all records that were moved to the new store in Fenula last week?"
    for q in (Q, asked):
        for n in (3, 4, 50, 20_000):
            assert qa.defect(q, " ".join([q] * n), ENDS) == "copy"
            assert qa.defect(q, "\n".join([f"Q: {q}"] * n), ENDS) == "copy"
        for n in (1, 10, 1000, 100_000):
            assert qa.defect(q, f"{q} " + "The cache was emptied on Monday morning. " * n, ENDS) is None
