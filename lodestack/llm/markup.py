"""Markup residue in text documents: a tree-structured graphical model over DOM nodes, lines and notation marks.

A text is parsed into a tree. Its root is the document; lines hang on the innermost element that is open where they
begin, or on the root; elements (paired HTML tags, fences, wiki macros, LaTeX environments) hang on the element or
line they stand in, and so do single marks (entities, emphasis, links, formulas and the like). Each node has a state:
a document is clean or marked up, a line is plain, marked up or code, an element or mark is literal or notation.
Feature potentials score the nodes, parent-child potentials connect them, and sum-product message passing up and down
the tree yields every node's marginal. Potentials are trained by likelihood on labelled pages that
``training_pages`` writes. Nodes of a marginal of at least one half are converted.

The clean text keeps structure in one stated form: a heading is a line ``# title`` (one mark a level), a list item
begins with ``- ``, cells are joined by `` | ``, code blocks stand between lines of three backticks, formulas between
``$`` or ``$$``. What stands inside code and formulas is left as it is. Emphasis, tags, macros, addresses of links and
comments go; entities become their characters.
"""

from __future__ import annotations

import html
import random
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.entities import html5
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import row_key

NOTATIONS = ("html", "latex", "markdown", "wiki")
#: Element names, elements without content, wiki macros, LaTeX environments and elements of code.
TAGS = set("a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details div dl dt em embed figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav ol option p pre q s samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
MACROS = "info|note|warning|tip|panel|expand|code|noformat|quote|color|toc|section|column|anchor|excerpt|status|include|children|attachments|gallery|jira|highlight|html|csv|table-plus"
VERBATIM = {"pre", "code", "script", "style", "noformat", "verbatim", "lstlisting", "minted", "fence"}
BLOCK_TAGS = {"p", "div", "tr", "table", "ul", "ol", "blockquote", "section", "article", "header", "footer", "dl", "dt", "dd", "br", "hr"}
HEADING_COMMANDS = {"chapter": 1, "title": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}

_TAG = re.compile(r"<!doctype[^>]*>|</?[A-Za-z][A-Za-z0-9]*(?::[A-Za-z][\w-]*)?(?:\s+[\w:@.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))?)*\s*/?>|&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});", re.I)
_LATEX = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?|\$\$[^$]+\$\$|\\\((?:[^\\\n]|\\[^)\n])+\\\)|\$(?=\S)[^$\n]+?(?<=\S)\$(?!\d)"
    r"|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{(?:[^{}\n]|\{[^{}\n]*\})*\}(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})?|\\[A-Za-z]+(?![A-Za-z])|\\[\\%&#_{}$]|(?<=\w)~(?=\w)|(?<=\})~(?=\w)"
)
_MARKDOWN = re.compile(
    r"^[ \t]{0,3}#{1,6}[ \t]+(?=\S)|^[ \t]*(?:```|~~~)[^\n`]*$|!\[[^\]\n]*\]\([^()\n]*\)|(?<!!)\[[^\]\n]+\]\([^()\n]+\)|\*{2,3}(?=\S)[^*\n]+?(?<=\S)\*{2,3}|(?<!\w)__(?=\S)[^_\n]+?(?<=\S)__(?!\w)|~~(?=\S)[^~\n]+?(?<=\S)~~"
    r"|(?<!`)`[^`\n]+`(?!`)|^[ \t]{0,3}>[ \t]?(?=\S)|^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]+|^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-{3,}:?[ \t]*\|[ \t]*$|^(?:={3,}|-{3,})[ \t]*$|^[ \t]*(?:\*{3,}|_{3,})[ \t]*$|^\[[^\]\n]+\]:[ \t]+\S+",
    re.M,
)
_WIKI = re.compile(
    rf"^[ \t]*h[1-6]\.[ \t]+(?=\S)|\{{(?:{MACROS})(?:[:|][^}}\n]*)?\}}|\[~[^\]\n]+\]|!(?=\S)[^!\n|]+\.(?:png|jpe?g|gif|svg|pdf)(?:\|[^!\n]*)?!|\[\[[^\]\n]+\]\]|\[(?!\[)[^\]\[|\n]+\|[^\]\n]+\]|\{{\{{[^{{}}\n]+\}}\}}"
    r"|^={2,6}(?=[^=\n]+={2,6}[ \t]*$)|'{2,5}(?=\S)[^'\n]+?(?<=\S)'{2,5}|^[ \t]*bq\.[ \t]+|^[ \t]*\|\|(?=[^\n]+\|\|[ \t]*$)|^[ \t]*\|(?=[^\n|]+(?:\|[^\n|]*)+\|[ \t]*$)|^\{\|[^\n]*$|^\|[-}][^\n]*$|__[A-Z]{3,}__|\[\[[^\]\n]*$|^[*#]{2,6}[ \t]+(?=\S)",
    re.M | re.I,
)
_FINDERS = (("html", _TAG, "<&"), ("latex", _LATEX, "\\$~"), ("markdown", _MARKDOWN, "#`[*_~>-="), ("wiki", _WIKI, "{[!|='.*#_"))
#: Marks between two texts, found by their ends so that unclosed ones cost nothing.
_BETWEEN = (("html", "comment", "<!--", "-->"), ("latex", "display math", "\\[", "\\]"))
_TRIGGER = re.compile(r"[<&\\$~`*_#\[\]{}|]|^[ \t]*>|^={2,}|^-{3,}|^[ \t]*(?:h[1-6]|bq)\. |'{2,}|!\S", re.M | re.I)
_CODE_LINE = re.compile(r"(?:[;{}]\s*$|^\s*(?:import|from|def|class|return|public|private|static|const|let|var|SELECT|curl|git|sudo|export|echo)\b|::|->|=>|[A-Za-z]:\\)")
_RULE = re.compile(r"^\s*\|?\s*:?-{2,}:?\s*\|(?:\s*:?-{2,}:?\s*\|?)*\s*$", re.M)
_COMMAND = re.compile(r"\\[a-z]+\{")


@dataclass
class Mark:
    start: int
    end: int
    notation: str
    kind: str
    features: list[str] = field(default_factory=list)
    name: str = ""  # of what may be one end of an element
    side: str = ""  # open, close, toggle, or empty for a mark that stands alone
    mate: int = -1  # the other end


class Context:
    """What the features of all marks of a text share, looked up once."""

    def __init__(self, text: str):
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.has_command = bool(_COMMAND.search(text))
        self.has_rule = "--" in text and bool(_RULE.search(text))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def span(self, no: int) -> tuple[int, int]:
        return self.starts[no], self.starts[no + 1] - 1 if no + 1 < len(self.starts) else len(self.text)

    def line_above(self, at: int) -> str:
        no = self.line(at)
        return self.text[slice(*self.span(no - 1))] if no else ""


def _of_html(c: Context, s: str, a: int, glued: bool) -> Mark:
    if s[0] == "&":
        return Mark(a, a + len(s), "html", "entity", [f"known={s[1] == '#' or s[1:] in html5}"])
    if s[1] == "!":
        return Mark(a, a + len(s), "html", "comment", [])
    name = re.match(r"</?([\w:-]+)", s).group(1)
    low = name.lower()
    known = low in TAGS or ":" in low
    f = [f"known={known}", f"attrs={'=' in s}", f"void={s.endswith('/>') or low in VOID}", f"glued={glued}", f"known={known}:glued={glued}", f"case={'lower' if name.islower() else 'other'}"]
    side = "close" if s[1] == "/" else "" if s.endswith("/>") or low in VOID else "open"
    return Mark(a, a + len(s), "html", "tag", f, low, side)


def _of_latex(c: Context, s: str, a: int) -> Mark:
    text, b = c.text, a + len(s)
    at = lambda kind, f, **more: Mark(a, b, "latex", kind, f, **more)
    inner = s.strip("$")
    if s[0] == "$" and not s.startswith("$$"):
        words = re.findall(r"(?<![\w{])[A-Za-z]{2,} ", re.sub(r"\\[A-Za-z]+", "", inner))
        return at("inline math", [f"command={bool(re.search(r'[A-Za-z]', inner) and chr(92) in inner)}", f"script={bool(re.search(r'[_^][{\w]', inner))}", f"prose={bool(words)}", f"number={inner[0].isdigit()}", f"one={len(inner) == 1}"])
    if s[0] == "$":
        return at("display math", [])
    if s == "~":
        return at("tie", [f"commands={c.has_command}"])
    if s[1] == "(":
        return at("math", [f"command={bool(re.search(r'[\\][A-Za-z]', s[2:-2]))}", f"script={bool(re.search('[_^=+]', s))}"])
    path = bool(re.search(r"(?:[A-Za-z]:|\\)[\w.\\-]*$", text[max(0, a - 60) : a])) or text[b : b + 1] == "\\"
    if not s[1].isalpha():
        return at("escape", [f"char={s[1]}", f"path={path}", f"commands={c.has_command}"])
    ends = re.match(r"\\(begin|end)\{([A-Za-z]+)\*?\}", s)
    if ends:
        return at("environment", [], name=ends.group(2).lower(), side="open" if ends.group(1) == "begin" else "close")
    f = [f"path={path}", f"script={text[b : b + 1] in ('_', '^')}", f"line start={a == c.starts[c.line(a)]}", f"item={s == chr(92) + 'item'}", f"commands={c.has_command}"]
    return at("command" if "{" in s else "bare command", f)


def _of_markdown(c: Context, s: str, a: int, glued: bool) -> Mark:
    text, b = c.text, a + len(s)
    at = lambda kind, f, **more: Mark(a, b, "markdown", kind, f, **more)
    bare = s.lstrip()
    first = bare[:1]
    if first == "#":
        return at("heading", [f"level={len(s.split()[0])}"])
    if bare.startswith(("```", "~~~")) and "`" not in bare[3:]:
        return at("fence", [], name="fence", side="toggle")
    if first == "`":
        return at("code span", [f"glued={glued}"])
    if first in "![" and "](" in s:
        return at("link", [f"url={bool(re.search(r'[(][^)]*[/.#]', s))}", f"glued={glued}"])
    if first == "[":
        return at("definition", [f"url={bool(re.search(r'https?://|/', s))}"])
    if first == ">":
        return at("quote", [f"command={bool(re.search('[<$]', text[slice(*c.span(c.line(a)))]))}"])
    if re.match(r"\s*[-*+]\s+\[", s):
        return at("task", [])
    if "|" in s:
        return at("table rule", [])
    if re.fullmatch(r"\s*[=\-*_]{3,}\s*", s):
        return at("rule", [f"char={first}", f"under text={bool(c.line_above(a).strip())}"])
    inner = s.strip("*_~")
    return at({"*": "strong", "_": "underlined", "~": "struck"}[first], [f"glued={glued}", f"identifier={bool(re.fullmatch(r'[a-z0-9_]+', inner))}", f"glued behind={text[b : b + 1].isalnum()}", f"spaced={' ' in inner}"])


def _of_wiki(c: Context, s: str, a: int) -> Mark:
    b = a + len(s)
    at = lambda kind, f, **more: Mark(a, b, "wiki", kind, f, **more)
    bare = s.lstrip()
    first = bare[:1]
    if re.match(r"h[1-6]\.", bare, re.I):
        return at("heading", [])
    if re.match(r"bq\.", bare, re.I):
        return at("quote", [])
    if s.startswith("{{"):
        return at("template", [f"bar={'|' in s}"])
    dashes = f"dashes={bool(re.fullmatch(r'[ \t|:-]+', c.text[slice(*c.span(c.line(a)))]))}"
    if s.startswith("{|") or re.match(r"\|[-}]", s):
        return at("table", [dashes])
    if s[0] == "{":
        name = re.match(r"\{([\w-]+)", s).group(1).lower()
        return at("macro", [], name=name, side="" if name in ("toc", "anchor", "status", "include", "children", "attachments", "gallery", "jira") else "toggle")
    if s.startswith("[["):
        return at("link", [f"closed={s.endswith(']]')}", f"code={bool(re.fullmatch(r'[\[\]\d, .]+', s))}"])
    if s.startswith("[~"):
        return at("mention", [])
    if s[0] == "[":
        return at("titled link", [f"url={bool(re.search(r'[|][^|]*(?:[/#:.]|[A-Z])', s))}"])
    if s[0] == "!":
        return at("image", [])
    if s[0] == "=":
        return at("equals heading", [])
    if s[0] == "'":
        return at("quotes", [f"count={min(5, len(s) - len(s.lstrip(chr(39))))}"])
    if bare.startswith("||"):
        return at("header row", [])
    if first == "|":
        return at("row", [f"rule={c.has_rule}", dashes])
    if s.startswith("__"):
        return at("switch", [f"known={s.strip('_') in {'TOC', 'NOTOC', 'NOEDITSECTION', 'FORCETOC', 'INDEX', 'NOINDEX'}}"])
    return at("nested list", [f"char={first}"])


def _between(text: str, notation: str, kind: str, opens: str, closes: str) -> Iterator[Mark]:
    at = text.find(opens)
    while at >= 0:
        end = text.find(closes, at + len(opens))
        if end < 0:
            return
        yield Mark(at, end + len(closes), notation, kind)
        at = text.find(opens, end + len(closes))


def marks_of(text: str, context: Context | None = None) -> list[Mark]:
    """All marks that look like notation, by start; ends of elements know each other."""
    if not _TRIGGER.search(text):
        return []
    c = context or Context(text)
    out: list[Mark] = []
    for notation, kind, opens, closes in _BETWEEN:
        out += _between(text, notation, kind, opens, closes)
    for notation, rx, chars in _FINDERS:
        if not any(ch in text for ch in chars):
            continue
        for m in rx.finditer(text):
            s, a = m.group(), m.start()
            if not s:
                continue
            glued = text[a - 1 : a].isalnum()
            mark = _of_html(c, s, a, glued) if notation == "html" else _of_latex(c, s, a) if notation == "latex" else _of_markdown(c, s, a, glued) if notation == "markdown" else _of_wiki(c, s, a)
            out.append(mark)
    out.sort(key=lambda k: (k.start, -k.end))
    waiting: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, m in enumerate(out):
        if not m.side:
            continue
        stack = waiting[m.notation, m.name]
        if stack and m.side != "open":
            m.mate = stack.pop()
            out[m.mate].mate = i
        elif m.side != "close":
            stack.append(i)
    for m in out:
        if m.side:
            m.features.append(f"paired={m.mate >= 0}")
            if m.notation == "html":
                m.features.append(f"{m.features[4]}:paired={m.mate >= 0}")
        m.features = [f"{m.kind}:{f}" for f in m.features]
    return out


DOCUMENT, LINE, ELEMENT, MARK = range(4)
PLAIN, MARKED, CODE = range(3)
STATES = {DOCUMENT: 2, LINE: 3, ELEMENT: 2, MARK: 2}


class Tree:
    """Nodes in document order, parents before their children: kind, parent and features; and the node of every mark."""

    def __init__(self, text: str, marks: list[Mark], context: Context):
        self.kinds, self.parents, self.features, self.lines = [DOCUMENT], [-1], [[]], {}
        self.node = [0] * len(marks)
        open_: list[tuple[int, int, int]] = []  # end, start, node
        for i, m in enumerate(marks):
            if m.side and 0 <= m.mate < i:
                self.node[i] = self.node[m.mate]
                continue
            while open_ and open_[-1][0] <= m.start:
                open_.pop()
            no = context.line(m.start)
            begin, end = context.span(no)
            if no not in self.lines:
                above = next((n for _, a, n in reversed(open_) if a < begin), 0)
                s = text[begin:end]
                self.lines[no] = self._add(LINE, above, ["", f"code={bool(_CODE_LINE.search(s))}", f"prose={len(re.findall(r'[^\W\d_]{2,}', s)) > 4}"])
            inside = open_[-1][2] if open_ and open_[-1][1] >= begin else self.lines[no]
            paired = m.mate > i
            self.node[i] = self._add(ELEMENT if paired else MARK, inside, [f"{m.notation}:{m.kind}", *(f"{m.notation}:{f}" for f in m.features)])
            if paired:
                close = marks[m.mate].start
                if not open_ or close <= open_[-1][0]:
                    open_.append((close, m.start, self.node[i]))

    def _add(self, kind: int, parent: int, features: list[str]) -> int:
        self.kinds.append(kind)
        self.parents.append(parent)
        self.features.append(features)
        return len(self.kinds) - 1


def _lse(x: list[float]) -> float:
    top = max(x)
    return top + log(sum(exp(v - top) for v in x))


class MarkupTree:
    """Potentials of the tree: weights of features, of the document's states, and of every kind of parent and child."""

    def __init__(self) -> None:
        self.weights: dict[str, float] = {}
        self.doc = [0.0, 0.0]
        self.pairs = {(p, c): [[0.0] * STATES[c] for _ in range(STATES[p])] for p, c in ((DOCUMENT, LINE), (LINE, ELEMENT), (LINE, MARK), (ELEMENT, LINE), (ELEMENT, ELEMENT), (ELEMENT, MARK))}

    def own(self, tree: Tree, i: int) -> list[float]:
        """A node's own potential: features speak for code in lines and for notation in elements and marks."""
        if not i:
            return list(self.doc)
        get = self.weights.get
        s = sum(get(f, 0.0) for f in tree.features[i])
        return [0.0, 0.0, s] if tree.kinds[i] == LINE else [0.0, s]

    def beliefs(self, tree: Tree, expected: dict | None = None) -> list[list[float]]:
        """Marginals of all nodes by one pass up and one down; with ``expected``, those of the edges are added to it."""
        kinds, parents, n = tree.kinds, tree.parents, len(tree.kinds)
        inner = [self.own(tree, i) for i in range(n)]
        up: list[list[float]] = [[]] * n
        for i in range(n - 1, 0, -1):
            p, x = parents[i], inner[i]
            up[i] = [_lse([w + v for w, v in zip(row, x, strict=True)]) for row in self.pairs[kinds[p], kinds[i]]]
            inner[p] = [v + u for v, u in zip(inner[p], up[i], strict=True)]
        full = inner
        out = []
        for i in range(n):
            if i:
                p = parents[i]
                pot = self.pairs[kinds[p], kinds[i]]
                rest = [v - u for v, u in zip(full[p], up[i], strict=True)]  # the parent without this child
                joint = [[r + w + v for w, v in zip(row, inner[i], strict=True)] for r, row in zip(rest, pot, strict=True)]
                full[i] = [_lse([row[t] for row in joint]) for t in range(len(joint[0]))]
                if expected is not None:
                    z, add = _lse(full[i]), expected[kinds[p], kinds[i]]
                    for s, row in enumerate(joint):
                        for t, v in enumerate(row):
                            add[s][t] += exp(v - z)
            z = _lse(full[i])
            out.append([exp(v - z) for v in full[i]])
        return out

    def fit(self, pages: list[tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]], epochs: int = 14, rate: float = 0.3, decay: float = 1e-3, seed: int = 9) -> MarkupTree:
        """``pages``: text, spans of true notation (start, end, notation), spans of code."""
        rng = random.Random(seed)
        data = []
        for text, gold, code in pages:
            c = Context(text)
            marks = marks_of(text, c)
            if not marks:
                continue
            tree = Tree(text, marks, c)
            truth = [0] * len(tree.kinds)
            for m, k in zip(marks, tree.node, strict=True):
                if any(a < m.end and m.start < b and n == m.notation for a, b, n in gold):
                    truth[k] = truth[0] = 1
            for no, k in tree.lines.items():
                a, b = c.span(no)
                truth[k] = MARKED if any(x < b and a < y for x, y, _ in gold) else CODE if any(x < b and a < y for x, y in code) else PLAIN
            data.append((tree, truth))
        w = defaultdict(float)
        self.weights = w
        for epoch in range(epochs):
            rng.shuffle(data)
            step = rate / (1 + 0.15 * epoch)
            small = 0.2 * step
            for tree, truth in data:
                moved = {k: [[0.0] * len(v[0]) for _ in v] for k, v in self.pairs.items()}
                p = self.beliefs(tree, moved)
                for i in range(1, len(truth)):
                    k = tree.kinds[i]
                    g = (truth[i] == CODE) - p[i][CODE] if k == LINE else truth[i] - p[i][1]
                    if abs(g) > 1e-3:
                        for f in tree.features[i]:
                            w[f] += step * (g - decay * w[f])
                    moved[tree.kinds[tree.parents[i]], k][truth[tree.parents[i]]][truth[i]] -= 1
                for k, m in moved.items():
                    pot = self.pairs[k]
                    for row, less in zip(pot, m, strict=True):
                        for t, v in enumerate(less):
                            row[t] -= small * (v + decay * row[t])
                for s in (0, 1):
                    self.doc[s] += small * ((truth[0] == s) - p[0][s] - decay * self.doc[s])
        self.weights = dict(w)
        return self


def training_pages(n: int = 1200, seed: int = 13) -> Iterator[tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]]:
    """Labelled pages: lines of prose, of each notation, and of code, paths, variables and signs in running text.

    The lines follow the public descriptions of the notations and of common programming text; their words are those of
    a household, so that no table's sentences are among them.
    """
    r = random.Random(seed)
    word = lambda: r.choice(["kettle", "violin", "meadow", "lantern", "harbour", "sparrow", "orchard", "blanket", "pepper", "ladder", "candle", "bridge"])
    name = lambda: r.choice("BDFGKLMNPRSTVW") + "".join(r.choice("aeioulnrst") for _ in range(5))
    two = lambda: f"{word()} {word()}"
    num = lambda: str(r.randint(2, 900))
    prose = [
        lambda: f"Grandmother left a {two()} near {name()} in May.", lambda: f"Nobody at {name()} had painted the {word()}, although it rained for {num()} evenings.", lambda: f"{name()} | {word()} | {num()}", lambda: f"{two()} | {two()}", lambda: f"- wash the {two()} by hand", lambda: f"* a {word()} for {name()}", lambda: f"{r.randint(1, 9)}) Fold the {word()} twice",
        lambda: f"{name()}: what we know of its {word()}", lambda: f"Photographs are at https://{word()}.example/{name()}_{word()}?a={num()}&b={num()} since spring.", lambda: f"(Children say \"{two()}\" instead.)", lambda: f"The {word()}'s colour isn't {name()}'s choice!", lambda: f"Look! A {word()}! How odd!", lambda: f"{name()} and {name()} met {num()} times; neither spoke.",
    ]
    literal = [
        lambda: f"Follow #{word()} or #{word()}-{num()} for pictures.", lambda: f"Water boils if t > {num()} but not while p < {num()}.", lambda: f"The box measures {num()} * {num()} * {num()} mm.", lambda: f"Export ${word().upper()} or ${{{word().upper()}_DIR}} in the shell, then $EDITOR opens.", lambda: f"A {word()} is ${num()}, two are ${num()}; nothing is above ${num()}.",
        lambda: f"Calls to __{word()}__ and __len__ read items[{num()}] from {{{word()}}}.", lambda: f"Copy D:\\{word()}\\new_{word()}\\text to E:\\backup afterwards.", lambda: f"D:\\{word()}\\{word()}.txt", lambda: f"Neither A# nor C++ has x -> y or x => y.", lambda: f"Return Optional<{name()}> or a {name()}<Integer> there.", lambda: f"Remove *.{word()[:3]}, *.bak and {word()}_* by hand.",
        lambda: f"{word()}_{word()}_count became {word()}_total.", lambda: f"[{word().upper()}] Q&A with {name()} & Sons.", lambda: f"Scale {word()}@3x.webp down.", lambda: f"Mail went to <{word()}.{word()}+{num()}@post.example>.", lambda: f"Between {num()}% ~ {num()}% of {word()}s & a few {word()}s.", lambda: f"HashMap<{name()}, {name()}> beats Set<{name()}> here.", lambda: f"Generic {name()}<T> takes a {name()}<K, V>.",
        lambda: f"while (i < {num()} && j > {num()}) {word()}[i] += j;", lambda: f"Mount \\\\{word()}\\{word()}\\shared first.", lambda: f"About ~{num()} of {name()}, say n^2 or a_{num()[0]}.", lambda: f"cat $HOME/{word()} | sort > {word()}.out", lambda: f"Press [{name()}] or {{{word()}}} to go on.", lambda: f"Use x || y, x && y or x | y as in {name()}.",
        lambda: f"B&B; {name()} has rooms.", lambda: f"grid[[{num()[0]}, 2], [5, {num()[0]}]] holds numbers of {name()}", lambda: f"__all__ and __file__ are names in {name()}.", lambda: f"printf(\"%d\\n\", {word()}); return {num()};", lambda: f"SELECT * FROM {word()} WHERE id <> {num()};", lambda: f"{word()} = {{'{name()}': [{num()}, {num()}]}}", lambda: f"{name()}::{word()}(int a, char *b);",
    ]
    tag = lambda: r.choice(["b", "i", "em", "strong", "u", "span", "code", "small", "sup"])
    block = lambda: r.choice(["p", "div", "li", "td", "th", "blockquote", "pre", "section", "h1", "h2", "h3", "h4", "caption"])

    def around(f) -> str:
        t = f()
        return f"<{t}>{two()}</{t}>"

    notation = {
        "html": [
            lambda: f"{around(block)}", lambda: f"{name()} likes {around(tag)} best", lambda: f"{word()}<br>{word()}<br />{word()}", lambda: f"{word()}&nbsp;{word()} &amp; {word()}", lambda: f"{word()} &gt; {word()}", lambda: f"&lt;em&gt;{two()}&lt;/em&gt; it says", lambda: f"<table class=\"{word()}\"><tr>{around(lambda: 'td')}{around(lambda: 'td')}</tr></table>", lambda: f"{two()}</{block()}>", lambda: f"<{block()}>{two()}",
            lambda: f"<!-- {two()} -->", lambda: f"{name()} <!-- {word()} --> {word()}", lambda: f"<a href=\"https://{word()}.example/{num()}\" target='_blank'>{two()}</a>", lambda: f"<ol>\n<li>{two()}\n<li>{two()}\n</ol>", lambda: f"{two()} &#{num()}; {word()}", lambda: f"{two()} &#x{num()}; {word()}", lambda: f"{word()} &mdash; {word()} &hellip;", lambda: f"<ac:structured-macro ac:name=\"{word()}\"><ac:parameter>{word()}</ac:parameter></ac:structured-macro>", lambda: f"<ri:user ri:userkey=\"{num()}\" />", lambda: f"<img src='{word()}.jpg' width={num()}>", lambda: f"<font color=red>{two()}</font>", lambda: f"<div>\n{two()}\n</div>", lambda: f"{word()}<hr/>", lambda: f"<p>{word()} &amp; {word()}<br>{name()}</p>", lambda: f"<div>\n<b>{word()}</b>&nbsp;{word()}\n</div>",
        ],
        "markdown": [
            lambda: f"{'#' * r.randint(1, 6)} {two()}", lambda: f"**{name()}** is a {word()}", lambda: f"{two()} *is* **{two()}** here", lambda: f"[{two()}](https://{word()}.example/{word()}) and more", lambda: f"[{name()}](#{word()})", lambda: f"a __{two()}__ there", lambda: f"* [{r.choice(' xX')}] {two()}", lambda: f"> {two()} of {name()}", lambda: f"> {name()} came late, and nobody saw", lambda: f"~~{two()}~~ {word()}", lambda: f"***{word()}***", lambda: f"![{word()}]({word()}.gif)", lambda: f"![](https://{word()}.example/{num()}.png)",
            lambda: f"{name()} {word()}\n{'=' * r.randint(4, 14)}", lambda: f"{two()}\n{'-' * r.randint(4, 14)}", lambda: f"```{r.choice(['', 'python', 'sh', 'json'])}\n{word()}({num()})\n```", lambda: f"~~~\n{two()}\n~~~", lambda: f"{word()} | {word()}\n:--- | ---:\n{num()} | {num()}", lambda: f"{word()} | {name()} | {word()}\n|:---:|----|---:|\n{num()} | {word()} | {num()}", lambda: f"| {name()} | {word()} |\n| --- | --- |\n| {num()} | {num()} |", lambda: f"type `{word()} --{word()}`, then wait", lambda: f"`{word()}`", lambda: f"[{num()[0]}]: https://{word()}.example/{num()}", lambda: f"{word()}\n\n***\n", lambda: f"__{name()}__: a {word()}",
        ],
        "wiki": [
            lambda: f"h{r.randint(1, 6)}. {two()}", lambda: f"{{{r.choice(['tip', 'note', 'warning'])}}}{two()}{{{r.choice(['tip', 'note', 'warning'])}}}", lambda: f"{{expand:{two()}}}\n{two()}\n{{expand}}", lambda: f"||{word()}||{name()}||{word()}||", lambda: f"||{name()}||{num()}||", lambda: f"|{word()}|{word()}|{num()}|", lambda: f"[{name()}|https://{word()}.example/{num()}]", lambda: f"a [{two()}|{name()} {word()}] there", lambda: f"ask [~{word()}] today", lambda: f"!{word()}.jpg!", lambda: f"!{word()}.png|width={num()}!", lambda: f"{{color:#{num()}}}{word()}{{color}}", lambda: f"{{code}}\n{word()}({num()})\n{{code}}", lambda: f"{{noformat}}{two()}{{noformat}}", lambda: f"{{toc}}", lambda: f"{{quote}}{two()}{{quote}}",
            lambda: f"{{{{{name()}|{word()}|{num()}}}}}", lambda: f"{{{{{word()}}}}}", lambda: f"[[{name()}]]", lambda: f"in [[{two()}|{word()}]], say", lambda: f"{'=' * (k := r.randint(2, 4))} {two()} {'=' * k}", lambda: f"'''{name()}''' is ''{word()}''", lambda: f"bq. {two()} {name()}", lambda: f"{{|\n|-\n| {word()} || {word()}\n|}}", lambda: f"** {two()}", lambda: f"*** {two()}", lambda: "__NOTOC__", lambda: f"[[{name()}: {word()}",
        ],
        "latex": [
            lambda: f"\\{r.choice(['section', 'subsection', 'chapter'])}{r.choice(['', '*'])}{{{two()}}}", lambda: f"a \\{r.choice(['textbf', 'emph', 'textit', 'texttt'])}{{{two()}}} here", lambda: f"with $\\alpha_{num()[0]} \\ge {num()}$, say", lambda: f"by $\\sqrt{{{num()}}} + \\beta$ at most", lambda: f"$$\\int_0^{num()[0]} f(t)\\,dt = {num()}$$", lambda: f"\\(\\mu + \\sigma^{num()[0]}\\) holds", lambda: f"\\item {two()}", lambda: f"\\item[{word()}] {two()}", lambda: f"{name()}~{num()} and \\ref{{{word()}:{word()}}}", lambda: f"{two()}~\\cite{{{name()}{num()}}}", lambda: f"y = \\prod_j y_j + \\delta",
            lambda: f"\\begin{{{(k := r.choice(['enumerate', 'itemize']))}}}\n\\item {two()}\n\\item {word()}\n\\end{{{k}}}", lambda: f"\\begin{{align}}\na &= b \\\\\nc &= \\frac{{{num()}}}{{d}}\n\\end{{align}}", lambda: f"$k_{num()[0]} = n^{{{num()[0]}}}$ again", lambda: f"\\[ e = m c^2 + {num()} \\]", lambda: f"\\label{{{word()}:{num()}}}", lambda: f"\\footnote{{{two()}}} {word()}", lambda: f"{num()}\\% of \\$ {num()}, \\textsc{{{word()}}}", lambda: f"\\begin{{verbatim}}\n{word()}({num()})\n\\end{{verbatim}}", lambda: f"where $O(n \\log n)$ is meant", lambda: f"the value $x$ is $y + {num()[0]}$",
        ],
    }
    own_line = (">", "h", "#", "|", "=", "\\", "`", "~", "{", "*", "_", "<", "[")
    for _ in range(n):
        text, gold, code = "", [], []
        kinds = r.sample(list(notation), 2 if r.random() < 0.15 else 1) if r.random() < 0.62 else []
        for _ in range(r.randint(1, 9)):
            if text and not text.endswith("\n"):
                text += r.choice(["\n", "\n\n", "\n", " "] if not text.rpartition("\n")[2].lstrip().startswith(own_line) else ["\n"])
            x = r.random()
            if kinds and x < 0.4 and (not text or text.endswith("\n")):
                k = r.choice(kinds)
                s = r.choice(notation[k])()
                gold.append((len(text), len(text) + len(s), k))
                text += s + ("\n" if "\n" in s else "")
            elif x < 0.68:
                s = r.choice(literal)()
                code.append((len(text), len(text) + len(s)))
                text += s
            else:
                text += r.choice(prose)()
        yield text, gold, code


def train(n: int = 1200) -> MarkupTree:
    return MarkupTree().fit(list(training_pages(n)))


def judged(text: str | None, model: MarkupTree, least: float = 0.5) -> list[Mark]:
    """Marks of a text that are notation; inside code and formulas there are none."""
    if not text:
        return []
    c = Context(text)
    marks = marks_of(text, c)
    if not marks:
        return []
    tree = Tree(text, marks, c)
    p = model.beliefs(tree)
    out, until, outer = [], 0, None
    for i, (m, k) in enumerate(zip(marks, tree.node, strict=True)):
        closing = m.side and 0 <= m.mate < i
        if m.start < until and not (closing and marks[m.mate] is outer) and not (outer.name == "pre" and m.name == "code"):
            continue
        if p[k][1] >= least:
            out.append(m)
            if m.mate > i and m.name in VERBATIM:
                until, outer = marks[m.mate].end, m
            elif m.kind in ("inline math", "display math", "math", "code span"):
                until, outer = m.end, m
    return out


Edit = tuple[int, int, str]


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _html_edits(text: str, m: Mark) -> list[Edit]:
    a, b = m.start, m.end
    if m.kind == "entity":
        return [(a, b, html.unescape(text[a:b]).replace("\u00a0", " "))]
    name, opens = m.name, m.side != "close"
    if re.fullmatch("h[1-6]", name):
        return [(a, b, "\n" + "#" * int(name[1]) + " " if opens else "\n")]
    if name == "pre":
        return [(a, b, "\n```\n")]
    if name in ("td", "th"):
        return [(a, b, " | " if not opens and re.compile(r"\s*<t[dh]\b", re.I).match(text, b) else "")]
    if name == "li":
        return [(a, b, "\n- " if opens else "")]
    if name == "img":
        alt = re.search(r"\balt\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", text[a:b], re.I)
        return [(a, b, (alt.group(1) or alt.group(2) or "") if alt else "")]
    return [(a, b, "\n" if name in BLOCK_TAGS else "")]


def _markdown_edits(text: str, m: Mark, line_start: int) -> list[Edit]:
    a, b, s = m.start, m.end, text[m.start : m.end]
    body = a + len(s) - len(s.lstrip())
    if m.kind == "heading":
        end = _line_end(text, a)
        tail = re.search(r"[ \t]+#+[ \t]*$", text[b:end])
        return [(a, body, ""), *([(b + tail.start(), end, "")] if tail else [])]
    if m.kind == "link":
        cut = s.rindex("](") if s.startswith("!") else s.index("](")
        return [(a, a + s.index("[") + 1, ""), (a + cut, b, "")]
    if m.kind == "quote":
        return [(a, body + 1 + (text[body + 1 : body + 2] == " "), "")]
    if m.kind == "task":
        return [(a + s.rindex("["), b, "")]
    if m.kind == "fence":
        return [(a, b, "```")]
    if m.kind == "rule" and s[:1] in "=-" and line_start < a:  # a title stands above
        return [(line_start, line_start, "# " if s[0] == "=" else "## "), (a - 1, b, "")]
    if m.kind in ("rule", "table rule", "definition"):
        return [(a, b, "")]
    n = len(s) - len(s.lstrip("*_~`"))
    return [(a, a + n, ""), (b - n, b, "")]


def _wiki_edits(text: str, m: Mark) -> list[Edit]:
    a, b, s = m.start, m.end, text[m.start : m.end]
    if m.kind == "heading":
        h = re.match(r"[ \t]*h([1-6])\.[ \t]+", s, re.I)
        return [(a, a + h.end(), "#" * int(h.group(1)) + " ")]
    end = _line_end(text, a)
    if m.kind == "equals heading":
        tail = re.search(r"[ \t]*=+[ \t]*$", text[b:end])
        return [(a, b + (text[b] == " "), "#" * len(s) + " "), (b + tail.start(), end, "")]
    if m.kind in ("header row", "row"):  # bars inside links and macros are none of the row's
        bars = [(a + x.start(), a + x.end()) for x in re.finditer(r"\[[^\]\n]*\]|\{[^}\n]*\}|[ \t]*\|+[ \t]*", text[a:end]) if "|" in x.group() and x.group().lstrip()[0] == "|"]
        return [(x, y, "" if x == a or y == end else " | ") for x, y in bars]
    if m.kind in ("link", "template"):
        ends = 2 if s.endswith(("]]", "}}")) else 0
        return [(a, a + max(2, s.rfind("|") + 1), ""), (b - ends, b, "")]
    if m.kind == "titled link":
        return [(a, a + 1, ""), (a + s.index("|"), b, "")]
    if m.kind == "mention":
        return [(a, a + 2, ""), (b - 1, b, "")]
    if m.kind == "quotes":
        n = min(len(s) - len(s.lstrip("'")), len(s) - len(s.rstrip("'")))
        return [(a, a + n, ""), (b - n, b, "")]
    if m.kind == "nested list":
        return [(a, b, "  " * (len(s.strip()) - 1) + "- ")]
    if m.kind == "macro" and m.name in VERBATIM:
        return [(a, b, "\n```\n")]
    if m.kind == "macro" and m.name in ("info", "note", "warning", "tip", "panel", "expand", "quote", "section", "column"):
        return [(a, b, "\n")]
    return [(a, b, "")]


def _latex_edits(text: str, m: Mark) -> list[Edit]:
    a, b, s = m.start, m.end, text[m.start : m.end]
    if m.kind == "environment":
        if m.name in VERBATIM:
            return [(a, b, "\n```\n")]
        return [(a, b, "\n$$\n" if m.name in ("equation", "align", "gather", "multline", "eqnarray", "displaymath", "math") else "\n")]
    if m.kind == "math":
        return [(a, a + 2, "$"), (b - 2, b, "$")]
    if m.kind == "display math" and s.startswith("\\"):
        return [(a, a + 2, "$$"), (b - 2, b, "$$")]
    if m.kind == "bare command":
        return [(a, b + (text[b : b + 1] == " "), "- ")] if s == "\\item" else []
    if m.kind == "tie":
        return [(a, b, " ")]
    if m.kind == "escape":
        return [(a, b, "\n" if s == "\\\\" else s[1:])]
    if m.kind == "command":
        name = re.match(r"\\([A-Za-z]+)", s).group(1)
        head = re.match(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{", s)
        if name in HEADING_COMMANDS:
            return [(a, a + head.end(), "#" * HEADING_COMMANDS[name] + " "), (b - 1, b, "")]
        if name == "href":
            return [(a, a + s.rindex("{") + 1, ""), (b - 1, b, "")]
        if name in ("cite", "ref", "eqref", "pageref"):
            return [(a, a + head.end(), "["), (b - 1, b, "]")]
        if name == "label":
            return [(a, b, "")]
        if name in ("emph", "underline", "footnote", "caption", "url") or name.startswith("text"):
            return [(a, a + head.end(), ""), (b - 1, b, "")]
    return []  # a formula stays


def clean_text(text: str, found: list[Mark]) -> str:
    """The text without the given marks; what stands between the ends of a mark is converted by its own marks."""
    if not found:
        return text
    c = Context(text)
    edits: list[Edit] = []
    for m in found:
        if m.kind == "comment":
            edits.append((m.start, m.end, ""))
        elif m.notation == "html":
            edits += _html_edits(text, m)
        elif m.notation == "markdown":
            no = c.line(m.start)
            edits += _markdown_edits(text, m, c.starts[no - 1] if no and c.line_above(m.start).strip() else m.start)
        else:
            edits += _wiki_edits(text, m) if m.notation == "wiki" else _latex_edits(text, m)
    out: list[str] = []
    at, last = 0, "\n"  # what was written last; the start of a text is the start of a line

    def put(s: str) -> None:
        nonlocal last
        if s:
            out.append(s)
            last = s[-1]

    for a, b, new in sorted(edits):
        if a < at:
            continue
        put(text[at:a])
        if not new and b > a and (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n":
            b += 1  # a line of nothing but a mark
        if new.startswith("\n") and last == "\n":
            new = new[1:]
        if new.endswith("\n") and (b == len(text) or text[b] == "\n"):
            new = new[:-1]
        put(new)
        at = b
    put(text[at:])
    return "".join(out)


def clean_markup(items: DataFrame, with_text: bool = True) -> DataFrame:
    """Every text that holds notation: which notations, and the clean text.

    ``items``: ``item_kind, item_key, text``; extra columns are ignored; null and empty texts and texts without
    notation give no rows (their clean text is the text itself); repeated rows give equal rows; texts are read
    whole. Result: the first two columns, ``notations`` (sorted), ``n_marks``, ``clean_text`` (null unless
    ``with_text``).
    """
    sent = items.sparkSession.sparkContext.broadcast(train())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for kind, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found = judged(text, model)
                if found:
                    for c, v in zip(cols, (kind, key, sorted({m.notation for m in found}), len(found), clean_text(text, found) if with_text else None), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["item_kind", "item_key", "notations", "n_marks", "clean_text"])

    rows = items.select("item_kind", "item_key", "text").where(F.length("text") > 0)
    return rows.mapInArrow(scan, "item_kind string, item_key string, notations array<string>, n_marks int, clean_text string")


def wiki_texts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """The texts of this project that may hold notation."""
    own = pages.select(F.lit("page").alias("item_kind"), row_key("page_id", "version").alias("item_key"), F.col("content_text").alias("text"))
    return own.unionByName(chunks.select(F.lit("chunk").alias("item_kind"), F.coalesce("id", F.lit("")).alias("item_key"), F.col("chunk").alias("text")))


def notations_found(cleaned: DataFrame) -> DataFrame:
    """One row per text and notation."""
    return cleaned.select("item_kind", "item_key", F.explode("notations").alias("markup")).distinct()
