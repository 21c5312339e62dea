import pytest

from conftest import tuples
from lodestack.llm import markup
from lodestack.llm.words import words


@pytest.fixture(scope="module")
def model():
    return markup.train()


@pytest.mark.parametrize("text,kind,clean", [
    ("<p>The <b>plan</b> is ready.</p>", "html", "The plan is ready."), ("a&nbsp;b &amp; c", "html", "a b & c"), ("<ul><li>one<li>two</ul>", "html", "- one\n- two"), ("<!-- todo --> It stays.", "html", " It stays."),
    ("<h2>Top &amp; <i>more</i></h2><pre>a  **b**\n\n\n  c</pre>tail", "html", "## Top & more\n```\na  **b**\n\n\n  c\n```\ntail"), ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "html", "A | B\n1 | 2\n"),
    ("## Some heading", "markdown", "## Some heading"), ("See [the plan](https://w.example/x/1) now.", "markdown", "See the plan now."), ("- [x] check it", "markdown", "- check it"), ("***a*** and ~~b~~ were swapped.", "markdown", "a and b were swapped."), ("Title here\n=========", "markdown", "# Title here"), ("## A **bold** [x](http://y.example/) title", "markdown", "## A bold x title"),
    ("h2. Some heading", "wiki", "## Some heading"), ("||a||b||\n|1|2|", "wiki", "a | b\n1 | 2"), ("{info:title=x}Use it.{info}", "wiki", "Use it."), ("See [[Place|the plan]] and '''this'''.", "wiki", "See the plan and this."), ("== Some heading ==", "wiki", "## Some heading"), ("{code:java}int x = a[0]; // **no**{code}", "wiki", "```\nint x = a[0]; // **no**\n```"), ("|a|[b|http://x.example/]|", "wiki", "a | b"),
    ("\\section{Some heading}", "latex", "# Some heading"), ("It is $\\frac{a}{b}$ wide.", "latex", "It is $\\frac{a}{b}$ wide."), ("\\item first thing", "latex", "- first thing"), ("\\emph{a}~and~b", "latex", "a and b"), ("\\[ a + b = c \\]", "latex", "$$ a + b = c $$"),
])
def test_notations(model, text, kind, clean):
    found = markup.judged(text, model)
    assert {m.notation for m in found} == {kind}
    assert markup.clean_text(text, found) == clean


def test_code_is_left_as_it_is(model):
    text = "Intro with **bold**.\n```python\nx = {1: '<b>'}\n# **no** heading\n```\nThe <b>end</b>"
    found = markup.judged(text, model)
    assert {m.notation for m in found} == {"html", "markdown"}
    assert markup.clean_text(text, found) == "Intro with bold.\n```\nx = {1: '<b>'}\n# **no** heading\n```\nThe end"


def test_long_inline_formulas(model):
    formula = " + ".join(f"x_{i}" for i in range(60))
    text = f"It is ${formula}$ wide."
    found = markup.judged(text, model)
    assert len(formula) > 200 and {m.notation for m in found} == {"latex"}
    assert markup.clean_text(text, found) == text


@pytest.mark.parametrize("text", [
    "Post in #ops-5 when it is done.", "The rule fires when load < 7 and lag > 22.", "Capacity is 5 * 4 * 2 slots.", "Set $HOME and $PATH first.", "It costs $5 per seat and $12 per item.", "The method __init__ reads array[0] and {id}.", "Logs are in C:\\temp\\new\\alpha here.", "C# and F# use a -> b.",
    "The type List<String> is used.", "Delete *.log and *.tmp below it.", "Rename user_session_id to session_key.", "[WARN] R&D said so.", "one | two | three\nfour | five | six", "Write to <a+b@c.example>, please.", "", None,
])
def test_plain_text_stays(model, text):
    assert markup.judged(text, model) == []


#: Written by hand, in words and layouts that ``training_pages`` does not use.
UNSEEN = [
    ("# Install\n\nRun the installer, then read [the guide](docs/guide.md).\n\n* fast\n* small\n", {"markdown"}), ("The **quick** fox.\n\n> said nobody\n", {"markdown"}), ("Usage\n-----\n\n    make all\n\nThen `make test`.", {"markdown"}), ("| Option | Meaning |\n|:--|--:|\n| -v | verbose |", {"markdown"}),
    ("Dear all,<br/><br/>the lift is broken.<br/>Regards", {"html"}), ("Tom &amp; Jerry &copy; 1940", {"html"}), ("<div class='row'><div class='col-6'>Left</div><div class='col-6'>Right</div></div>", {"html"}), ("A list: <ol><li>First</li><li>Second</li></ol>", {"html"}), ("H<sub>2</sub>O boils.", {"html"}),
    ("h1. Release\n\n* item\n** nested\n\n{code:sql}\nselect 1\n{code}", {"wiki"}), ("'''Paris''' is the capital of [[France]].\n\n== History ==\nText.", {"wiki"}), ("{{Infobox|name=Rome}}\nRome is old.", {"wiki"}), ("See [our page|https://www.example.com/page].", {"wiki"}),
    ("We show that $a^2 + b^2 = c^2$ and \\emph{nothing else}.", {"latex"}), ("\\begin{theorem}\nEvery \\textbf{prime} is odd or two.\n\\end{theorem}", {"latex"}), ("By \\cite{knuth84}, $\\mathcal{O}(n)$ suffices.", {"latex"}),
    ("if (x < 3 && y > 2) { return a[i] * b[j]; }", set()), ("Dinner was $30, drinks $12; we tipped $5.", set()), ("Open C:\\Users\\me\\notes.txt first", set()), ("The function foo_bar_baz(x) calls __repr__ on it.", set()), ("vector<int> v; map<string, int> m;", set()), ("Barnes & Noble; 3 < 5 > 2", set()), ("ls *.py | wc -l > count.txt", set()), ("Ask in channel #help or mail <me@example.org>.", set()), ("2 * 3 * 4 = 24, and 7 ~ 8", set()), ("arr[[0, 1]] = x[::2]", set()),
]


def test_unseen_pages(model):
    wrong = [t for t, want in UNSEEN if {m.notation for m in markup.judged(t, model)} != want]
    assert len(wrong) <= 1, wrong


def test_held_out_accuracy(model):
    right = total = 0
    for text, gold, _ in markup.training_pages(300, seed=4321):
        right += {m.notation for m in markup.judged(text, model)} == {n for *_, n in gold}
        total += 1
    assert right / total > 0.95


def test_training_pages_hold_no_sentence_of_the_tables(spark, data):
    runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
    seen = set()
    for name, col in (("pages", "content_text"), ("chunks", "chunk"), ("feedback", "comment"), ("feedback", "question")):
        for (t,) in spark.read.parquet(f"{data}/{name}.parquet").select(col).distinct().collect():
            seen |= runs(t)
    assert not seen.intersection(*[set().union(*(runs(t) for t, *_ in markup.training_pages(1500)))])


def test_marginals_equal_enumeration(model):
    import itertools

    import numpy as np

    text = "The __init__ of <div>it and <b>x\nList<String> and **y**</b> here</div>"
    c = markup.Context(text)
    marks = markup.marks_of(text, c)
    tree = markup.Tree(text, marks, c)
    assert tree.kinds.count(markup.ELEMENT) == 2 and tree.kinds.count(markup.LINE) == 2 and tree.parents[tree.lines[1]] not in (0,)
    sizes = [markup.STATES[k] for k in tree.kinds]
    own = [model.own(tree, i) for i in range(len(sizes))]
    on, total = [np.zeros(n) for n in sizes], 0.0
    for states in itertools.product(*map(range, sizes)):
        s = own[0][states[0]]
        for i in range(1, len(sizes)):
            p = tree.parents[i]
            s += own[i][states[i]] + model.pairs[tree.kinds[p], tree.kinds[i]][states[p]][states[i]]
        total += np.exp(s)
        for x, st in zip(on, states):
            x[st] += np.exp(s)
    for got, want in zip(model.beliefs(tree), on):
        assert np.allclose(got, want / total)


def test_long_texts_take_time_in_proportion(model):
    import time

    text = "<b>x</b> **y** \\a{b} $z^2$ [[q]] <!-- \\[ {code} | " * 5_000
    began = time.perf_counter()
    markup.clean_text(text, markup.judged(text, model))
    assert time.perf_counter() - began < 20


def test_odd_rows(spark):
    rows = [("k", "1", "<b>x</b>"), ("k", "1", "<b>x</b>"), ("k", "2", None), ("k", "3", ""), ("k", None, "## a\n" + "<i>y</i> " * 3000), ("k", "4", "plain")]
    df = spark.createDataFrame(rows, "item_kind string, item_key string, text string").selectExpr("*", "1 AS notations")
    got = markup.clean_markup(df)
    assert tuples(markup.notations_found(got)) == [("k", "1", "html"), ("k", None, "html"), ("k", None, "markdown")]
    assert got.where("item_key = '1'").first().clean_text == "x"
    assert markup.clean_markup(df.where("false")).count() == 0
