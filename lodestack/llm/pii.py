"""Personal information inside free text: a semi-Markov conditional random field over candidate segments.

Shapes and name dictionaries propose segments of bounded length; whole-span and context features score every
segment with its type; dynamic programming over the segments jointly chooses boundaries and types. Text that no
segment touches can only be ordinary. The weights are trained by the field's likelihood on labelled sentences that
``training_sentences`` writes.

Entities are bounded, as the method asks: a segment has at most ``MAX_SPAN`` characters, a number at most
``MAX_NUMBER`` and ``MIN_DIGITS`` to ``MAX_DIGITS`` digits. Of a longer run of digits and separators every part of
that size between two gaps is a segment.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import row_key

TYPES = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {t: f"[{t.upper()}]" for t in TYPES}
#: Longest segment in characters; entities are far shorter.
MAX_SPAN = 160
#: Bounds of a number: characters and digits (the longest telephone and identity numbers, with extension).
MAX_NUMBER, MIN_DIGITS, MAX_DIGITS = 40, 6, 17
#: Bound of the name dictionary that is sent to the executors.
MAX_NAMES = 500_000

_S = r"[ \t\u00a0\u202f]"
#: Names of identity numbers, of calls, and of numbers that identify things.
_ID_NAMES = r"ssn|social[ -]security(?:[ -](?:number|no|nr))?|passport|reisepass\w*|passeport|pasaporte|national[ -]id(?:entity|entification)?|identity[ -](?:card|number)|id[ -]card|personalausweis\w*|personnummer|tax[ -](?:id|number|no|payer)\w*|taxpayer|steuer[- ]?(?:id|nr|nummer|identifikationsnummer)|num[ée]ro fiscal|s[ée]curit[ée] sociale|dni|nif|nie|nss|tin|itin|insee|driver'?s licen[cs]e"
_CALLS = r"call|phone|tel|telephone|telefon|dial|hotline|fax|mobile|mobil|cell|ring|number for|reach|text|sms|whatsapp|anruf\w*|appel\w*|t[ée]l[ée]phone|llam\w*|answers"
_THINGS = r"order|ticket|serial|sn|s/n|build|version|release|invoice|host|node|device|inc|part|sku|batch|lot|case|issue|port|revision|commit|imei|asset|model|item|ref|reference|tracking|error|code|isbn|ip|at row|line"
_CUES = (("id", re.compile(rf"(?<!\w)(?:{_ID_NAMES})(?!\w)", re.I)), ("call", re.compile(rf"(?<!\w)(?:{_CALLS})(?!\w)", re.I)), ("thing", re.compile(rf"(?<!\w)(?:{_THINGS})(?!\w)", re.I)))

_EMAIL = re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+")
_AT = rf"{_S}*(?:\[{_S}*at{_S}*\]|\({_S}*at{_S}*\)|\{{{_S}*at{_S}*\}}|<at>|＠){_S}*|{_S}+at{_S}+"
_DOT = rf"{_S}*(?:\[{_S}*(?:dot|punkt|point|punto)?\.?{_S}*\]|\({_S}*(?:dot|punkt|point|punto){_S}*\)|\{{dot\}}){_S}*|{_S}+dot{_S}+"
_HIDDEN = re.compile(rf"[A-Za-z0-9._%+\-]+(?:{_AT}|@)[A-Za-z0-9\-]+(?:(?:{_DOT}|\.)[A-Za-z0-9\-]+)+", re.I)
_HIDDEN_HINT = re.compile(r"[\[({<]\s*(?:at|dot)\s*[\])}>]|\sdot\s|＠", re.I)
_NUMBER = re.compile(r"(?<![\w@])(?:\+|\(\+?)?[A-Za-z]{0,2}\d(?:[\d .()/\u00a0\u2011-]*\d)?(?:\s?(?:ext|x|extension|durchwahl|poste)\.?\s?\d{1,5})?(?![\w@])", re.I)
_STREET_EN = r"street|st|avenue|ave|road|rd|lane|ln|drive|dr|court|ct|place|pl|way|boulevard|blvd|square|sq|terrace|close|crescent|highway|hwy|parkway|pkwy|row|walk|mews|gardens|grove|hill|park"
_CITY = rf"(?:,?{_S}*\n?{_S}*(?:[A-Z]{{1,2}}-)?(?:\d{{4,5}}{_S}+)?[^\W\d_]{{3,}}(?:[ -][A-Z][^\W\d_]+)?(?:,?{_S}+(?:[A-Z]{{2}}{_S}+)?\d{{4,5}}(?:-\d{{4}})?)?)"
_FLAT = rf"(?:flat|apt|apartment|unit|suite|room|floor)\.?{_S}*\d+[a-z]?"
_ADDRESSES = (
    ("en", re.compile(rf"(?<![\w.])(?:{_FLAT},?{_S}+)?\d{{1,5}}{_S}?[a-z]?(?:,)?{_S}+(?:[^\W\d_][\w'’-]*{_S}+){{1,3}}(?:{_STREET_EN})(?![\w-])\.?(?:,?{_S}+{_FLAT})?", re.I)),
    ("fr", re.compile(rf"(?<![\w.])\d{{1,4}}(?:{_S}?(?:bis|ter|[a-d]))?,?{_S}+(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route|cours){_S}+(?:(?:de{_S}+la|de{_S}+l['’]|de|du|des|d['’]|la|le){_S}*)?[^\W\d_][\w'’-]*(?:{_S}[A-Z][\w'’-]+)?", re.I)),
    ("es", re.compile(rf"(?<!\w)(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera){_S}*(?:(?:de{_S}+la|de{_S}+los|de|del|la){_S}+)?[^\W\d_][\w'’-]*(?:{_S}[A-Z][\w'’-]+)?,?{_S}*(?:n[º°o]\.?{_S}*)?\d{{1,4}}{_S}?[a-z]?(?!\w)", re.I)),
)
_DE_END = re.compile(rf"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|ufer|damm|chaussee){_S}+\d{{1,4}}(?:{_S}?[a-z](?!\w))?(?!\w)", re.I)
#: Words before a street type that stands alone, as in "Am Ring 5".
_BEFORE_STREET = re.compile(rf"(?:(?<!\w)(?i:am|im|zum|zur|an der|in der|auf dem){_S}+|(?<!\w)[A-ZÄÖÜ][^\W\d_]+(?:e|er|es|en){_S}+)$")
_STREET_HINT = re.compile(rf"(?<!\w)(?:{_STREET_EN}|rue|avenue|av|boulevard|bd|place|chemin|impasse|allée|quai|route|cours|calle|c/|avenida|avda|plaza|paseo|camino|carrera)(?!\w)", re.I)
_AFTER_STREET = re.compile(_CITY)
_TITLES = r"dr|mr|mrs|ms|miss|prof|professor|sir|herr|frau|mme|mlle|monsieur|madame|sr|sra|srta|señor|señora|don|doña|m"
_BEFORE_NAME = re.compile(rf"(?:(?<!\w)(?P<title>{_TITLES})(?:\.{_S}*|{_S}+))?(?:(?<!\w)(?P<given>[^\W\d_][\w'’-]+?){_S}+)?(?:(?<!\w)(?P<initial>[^\W\d_])(?:\.{_S}*|{_S}+))?(?:(?<!\w)(?P<second>[^\W\d_])\.{_S}*)?$", re.I)
_AFTER_NAME = re.compile(rf"(?P<comma>,)?{_S}+(?P<word>[^\W\d_][\w'’-]*)(?P<dot>\.)?")


@dataclass
class Segment:
    start: int
    end: int
    kind: str
    features: list[str] = field(default_factory=list)


def same_length_lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Names:
    """Family and given names; finds family names as whole words in any case."""

    def __init__(self, family: Iterable[str], given: Iterable[str]):
        self.family = {n.strip().lower() for n in family if n and n.strip()}
        self.given = {n.strip().lower() for n in given if n and n.strip()}
        self.find = ahocorasick.Automaton()
        for n in self.family:
            self.find.add_word(n, len(n))
        if self.family:
            self.find.make_automaton()

    def hits(self, low: str) -> Iterator[tuple[int, int]]:
        if self.family:
            for last, n in self.find.iter(low):
                a, b = last - n + 1, last + 1
                if not ((a and (low[a - 1].isalnum() or low[a - 1] == "_")) or (b < len(low) and (low[b].isalnum() or low[b] == "_"))):
                    yield a, b


def _cue(text: str, start: int) -> list[str]:
    """Cue words before a segment, within its sentence: which there are, the nearest, and whether it stands right before."""
    left = text[max(0, start - 48) : start]
    left = re.split(r"[.!?]\s|\n", left)[-1]
    best, at, kinds = "none", -1, set()
    for name, rx in _CUES:
        for m in rx.finditer(left):
            kinds.add(name)
            if m.end() >= at:
                best, at = name, m.end()
    gap = len(left) - at if at >= 0 else 99
    return [f"cue={best}", f"cue={best}:{'next' if gap <= 3 else 'near' if gap <= 12 else 'far'}", *(f"cues={k}" for k in sorted(kinds)), f"all={'+'.join(sorted(kinds))}"]


def _number_features(text: str, a: int, b: int) -> list[str]:
    s = text[a:b]
    body = re.split(r"\s?(?:ext|x|extension|durchwahl|poste)\.?\s?", s, flags=re.I)[0] if re.search(r"(?:ext|x|poste|durchwahl)", s, re.I) else s
    groups = re.findall(r"\d+", body)
    digits = sum(map(len, groups))
    shape = re.sub(r"[^\W\d_]", "L", re.sub(r"\d", "9", re.sub(r"\s", " ", body)))
    lens = "-".join(str(len(g)) for g in groups)
    start = "plus" if re.match(r"\(?\+", s) else "00" if s.startswith("00") else "letter" if s[0].isalpha() else "0" if s[0] == "0" else "paren" if s[0] == "(" else "digit"
    f = [f"start={start}", f"digits={min(16, digits)}", f"groups={lens}", f"shape={shape if len(shape) < 24 else 'long'}", f"parts={min(6, len(groups))}"]
    if body is not s and body != s:
        f.append("extension")
    if len(groups) == 4 and s.count(".") == 3 and all(len(g) <= 3 for g in groups):
        f.append("ip")
    if len(groups) == 1 and start not in ("plus", "00", "letter"):
        f.append("one run")
    if re.fullmatch(r"(?:19|20)\d\d[-/.]\d{1,2}[-/.]\d{1,2}.*", s) or re.fullmatch(r"\d{1,2}[./-]\d{1,2}[./-](?:19|20)?\d\d", s):
        f.append("date")
    return f


def candidates(text: str, names: Names) -> list[Segment]:
    """All segments that some shape or dictionary proposes, with their features."""
    out: list[Segment] = []
    low = None
    if "@" in text or _HIDDEN_HINT.search(text):
        spans = set()
        for m in _EMAIL.finditer(text):
            spans.add((m.start(), m.end()))
        for m in _HIDDEN.finditer(text):
            spans.add((m.start(), m.end()))
        for a, b in spans:
            s = text[a:b]
            while b > a and text[b - 1] in ".-":
                b -= 1
            tail = re.split(r"[^A-Za-z0-9]+", s.rstrip(".-"))[-1].lower()
            host = s.rpartition("@")[2]
            f = [f"hidden={'@' not in s}", "file" if tail in {"png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "js", "css", "pdf"} else "tld", f"scale={bool(re.match(r'[0-9]+x[.]', host))}", f"brackets={bool(re.search('[][(){}]', s))}", f"short={len(tail) < 2}", f"digits={tail.isdigit()}"]
            if "@" not in s and not re.search(r"[\[({<＠]", s):
                f.append("words only" if not re.search(r"\sdot\s", s, re.I) else "words with dot")
            out.append(Segment(a, b, "email", f))
    for m in _NUMBER.finditer(text):
        for a, b in _numbers(text, m.start(), m.end()):
            before = text[a - 1] if a else ""
            f = [*_number_features(text, a, b), *_cue(text, a), f"before={before if before in '-#/$.:=' else ''}"]
            if (a, b) != m.span():
                f.append("part")
            out.append(Segment(a, b, "phone", f))
            out.append(Segment(a, b, "id_number", f))
    if _STREET_HINT.search(text):
        for lang, rx in _ADDRESSES:
            for m in rx.finditer(text):
                _add_address(text, m.start(), m.end(), lang, out)
    for m in _DE_END.finditer(text):
        a = m.start()
        while a > 0 and (text[a - 1].isalpha() or text[a - 1] == "-") and m.start() - a < 40:
            a -= 1
        if a == m.start():  # the type of street stands alone
            before = _BEFORE_STREET.search(text, max(0, a - 40), a)
            if not before:
                continue
            a = before.start()
        _add_address(text, a, m.end(), "de", out)
    if names.family:
        low = same_length_lower(text)
        for a, b in names.hits(low):
            _add_person(text, low, a, b, names, out)
    return [s for s in out if s.end - s.start <= MAX_SPAN]


def _numbers(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """The spans a run of digits and separators may be: all of it, or where it is too long its parts between gaps."""
    digits = sum(c.isdigit() for c in text[a:b])
    if b - a <= MAX_NUMBER and digits <= MAX_DIGITS:
        if b - a >= 7 and digits >= MIN_DIGITS:
            yield a, b
        return
    groups = [(m.start(), m.end()) for m in re.compile(r"\(?\+?[^\W_]+\)?").finditer(text, a, b)]
    for i, (x, _) in enumerate(groups):
        if i and text[groups[i - 1][1] : x].strip(" \t\u00a0/") and not text[groups[i - 1][1] : x].isspace():
            continue  # a part does not begin behind a dash or a dot
        n = 0
        for j in range(i, len(groups)):
            y, z = groups[j]
            n += sum(c.isdigit() for c in text[y:z])
            if z - x > MAX_NUMBER or n > MAX_DIGITS:
                break
            if z - x >= 7 and n >= MIN_DIGITS:
                yield x, z


def _add_address(text: str, a: int, b: int, lang: str, out: list[Segment]) -> None:
    s = text[a:b]
    name = re.findall(r"(?<!\w)[^\W\d_][\w'’-]*", s)
    small = {"the", "of", "and", "in", "on", "for", "to", "was", "is", "a", "an", "with", "by", "at", "from", "its", "our", "each", "per", "are"}
    f = [f"lang={lang}", f"upper={sum(w[0].isupper() for w in name) >= 2 or (lang in ('de', 'fr') and any(w[0].isupper() for w in name))}", f"small={any(w.lower() in small for w in name)}", f"flat={bool(re.search(_FLAT, s, re.I))}", f"words={min(6, len(name))}", f"line={chr(10) in s}", f"count={bool(name) and name[0].islower() and name[0].endswith('s')}:{lang}", f"mixed={any(w[0].islower() for w in name[:-1]) and name[-1][0].isupper()}:{lang}" if name else "no name"]
    out.append(Segment(a, b, "address", [*f, "plain"]))
    m = _AFTER_STREET.match(text, b)
    if m and text[b : b + 1] == ",":
        city = re.search(r"[^\W\d_]{3,}", m.group())
        out.append(Segment(a, m.end(), "address", [*f, "city", f"city upper={city.group()[0].isupper() if city else False}", f"code={bool(re.search('[0-9]{4,5}', m.group()))}"]))


def _add_person(text: str, low: str, a: int, b: int, names: Names, out: list[Segment]) -> None:
    glued = (a and text[a - 1] in "@-/\\.+" and not text[a - 1].isspace() and not (text[a - 1] == "." and a > 1 and text[a - 2].isalpha() and (a < 3 or not text[a - 3].isalnum()))) or (b < len(text) and (text[b] in "@/\\-_" or (text[b] == "." and b + 1 < len(text) and text[b + 1].isalnum())))
    base = ["glued" if glued else "free", f"case={'upper' if text[a:b].isupper() else 'title' if text[a].isupper() else 'lower'}"]
    nxt = re.match(rf"{_S}*([^\W\d_]+)", text[b : b + 24])
    base.append("thing behind" if nxt and nxt.group(1).lower() in {"service", "server", "module", "product", "engine", "machine", "model", "brand", "company", "tool", "app"} else "other behind")
    m = _BEFORE_NAME.search(text, max(0, a - 48), a)
    s, form = a, []
    if m:
        given = m.group("given")
        ok_given = bool(given) and given.lower() in names.given
        if ok_given:
            form.append("given")
        if m.group("initial"):
            dotted = text[m.end("initial") : m.end("initial") + 1] == "."
            if dotted or (m.group("initial").isupper() and m.group("initial") not in "AI"):
                form.append("initial" if dotted else "letter")
        if m.group("title") and (not given or ok_given):
            form.append("title")
        if form:
            s = m.start("title") if "title" in form else m.start("given") if "given" in form else m.start("initial") if m.group("initial") else a
            if "title" in form and given and not ok_given:
                s = a
    if form:
        out.append(Segment(s, b, "person", [*base, *(f"has={x}" for x in form), "built"]))
    after = _AFTER_NAME.match(text, b)
    if after and not glued:
        w = after.group("word")
        if w.lower() in names.given:
            out.append(Segment(s, after.end("word"), "person", [*base, "has=given behind", "comma" if after.group("comma") else "no comma", "built"]))
        elif len(w) == 1 and after.group("dot") and after.group("comma"):
            out.append(Segment(s, after.end("dot"), "person", [*base, "has=initial behind", "comma", "built"]))
    if not form:
        out.append(Segment(a, b, "person", [*base, "bare"]))


class SemiMarkovField:
    """Weights of (type, feature) and of a type itself; ordinary text scores 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[str, str], float] = defaultdict(float)

    def score(self, seg: Segment) -> float:
        w = self.weights
        return w.get((seg.kind, ""), 0.0) + sum(w.get((seg.kind, f), 0.0) for f in seg.features)

    @staticmethod
    def _before(segs: list[Segment]) -> list[int]:
        """For segments by end: how many end at or before the start of each."""
        ends = np.array([s.end for s in segs])
        return [int(np.searchsorted(ends[:i], segs[i].start, side="right")) for i in range(len(segs))]

    def best(self, segs: list[Segment]) -> list[Segment]:
        """The segmentation of highest score (Viterbi over segment ends)."""
        segs = sorted(segs, key=lambda s: (s.end, s.start, s.kind))
        if len(segs) == 1:
            return segs if self.score(segs[0]) > 0 else []
        before = self._before(segs)
        top = [0.0] * (len(segs) + 1)
        for i, seg in enumerate(segs):
            top[i + 1] = max(top[i], top[before[i]] + self.score(seg))
        out, i = [], len(segs)
        while i:
            if top[i] > top[i - 1] and abs(top[i] - top[before[i - 1]] - self.score(segs[i - 1])) < 1e-9:
                out.append(segs[i - 1])
                i = before[i - 1]
            else:
                i -= 1
        return out[::-1]

    def marginals(self, segs: list[Segment]) -> list[float]:
        """Probability of every segment (by the given order of ends), forward and backward over segment ends."""
        n, before = len(segs), self._before(segs)
        score = [self.score(s) for s in segs]
        alpha = [0.0] * (n + 1)
        for i in range(n):
            alpha[i + 1] = np.logaddexp(alpha[i], alpha[before[i]] + score[i])
        beta = [-np.inf] * (n + 1)
        beta[n] = 0.0
        for i in range(n, 0, -1):
            beta[i - 1] = np.logaddexp(beta[i - 1], beta[i])
            beta[before[i - 1]] = np.logaddexp(beta[before[i - 1]], score[i - 1] + beta[i])
        return [float(np.exp(alpha[before[i]] + score[i] + beta[i + 1] - alpha[n])) for i in range(n)]

    def fit(self, data: list[tuple[list[Segment], set[tuple[int, int, str]]]], epochs: int = 16, rate: float = 0.5, decay: float = 1e-3, seed: int = 3) -> SemiMarkovField:
        rng = random.Random(seed)
        data = [(sorted(s, key=lambda x: (x.end, x.start, x.kind)), gold) for s, gold in data if s]
        for epoch in range(epochs):
            rng.shuffle(data)
            step = rate / (1 + 0.1 * epoch)
            for segs, gold in data:
                for seg, p in zip(segs, self.marginals(segs), strict=True):
                    g = ((seg.start, seg.end, seg.kind) in gold) - p
                    if abs(g) > 1e-3:
                        for f in ("", *seg.features):
                            key = (seg.kind, f)
                            self.weights[key] += step * (g - decay * self.weights[key])
        self.weights = {k: v for k, v in self.weights.items() if abs(v) > 1e-6}
        return self


def training_sentences(family: list[str], given: list[str], n: int = 2500, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled sentences: values in the notations of public formats, and numbers and names that identify things.

    The words around the values are those of a household and of shops, so that no table's sentences are among them.
    """
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    nz = lambda k: r.choice("123456789") + d(k - 1)
    cap = lambda: r.choice("BDFGKLMNPRSTVW") + "".join(r.choice("aeioulnrst") for _ in range(r.randint(4, 9)))
    noun = lambda: r.choice(["kettle", "violin lesson", "garden gate", "bakery", "ferry", "old piano", "choir", "order of tea", "lost ticket", "error in the menu", "spare part", "case of wine"])

    def email() -> str:
        user = r.choice([f"{cap()}.{cap()}", f"{cap()}{d(2)}", f"{cap()[0]}.{cap()}", f"{cap()}_{cap()}", f"{cap()}-{cap()}", f"{cap()}+{r.choice(['tea', 'news', 'shop'])}"]).lower()
        host = [cap().lower(), *([cap().lower() + r.choice(["", "-it"])] if r.random() < 0.7 else []), r.choice(["example", "test", "invalid", "com", "org", "net", "de", "io"])]
        s = r.choice([f"{user}@{'.'.join(host)}"] * 3 + [f"{user} [at] {' [dot] '.join(host)}", f"{user}(at){'.'.join(host)}", f"{user} (at) {' (dot) '.join(host)}", f"{user} at {' dot '.join(host)}", f"{user}[at]{'[dot]'.join(host)}", f"{user}{{at}}{'.'.join(host)}"])
        return s.upper() if r.random() < 0.1 else s

    def phone() -> str:
        return r.choice([
            f"+1 ({nz(3)}) {d(3)}-{d(4)}", f"({nz(3)}) {d(3)}-{d(4)}", f"({nz(3)}) {d(3)} {d(4)} ext. {nz(2)}", f"{nz(3)}-{d(3)}-{d(4)}", f"{nz(3)}.{d(3)}.{d(4)}", f"+1{nz(10)}", f"+44 20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}",
            f"+49 (0){nz(2)} {d(5)}-{d(3)}", f"0049 {nz(2)} {d(5)} {d(3)}", f"+49 {nz(3)} {d(7)}", f"0{nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {nz(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+34 {nz(3)} {d(2)} {d(2)} {d(2)}", f"0{nz(3)}/{d(6)}", f"0{nz(3)}-{d(7)}", f"{nz(3)} {d(3)} {d(4)}", f"+{nz(11)}", f"+{nz(2)} {nz(3)} {d(3)} {d(3)}", f"0{nz(2)} {d(7)}",
        ])

    def id_number() -> tuple[str, str]:
        return r.choice([
            (r.choice(["SSN", "social security number", "Social Security no."]), r.choice([f"{nz(3)}-{d(2)}-{d(4)}", f"{nz(3)} {d(2)} {d(4)}", nz(9)])), (r.choice(["passport no.", "passport", "passport number", "Reisepass"]), r.choice("CKLMPX") + nz(8)),
            (r.choice(["national id", "national identity number", "Personnummer"]), f"{d(2)}{r.choice(['01', '07', '11'])}{r.choice(['03', '14', '28'])}-{d(4)}"), (r.choice(["tax ID", "Steuer-ID", "tax number", "TIN"]), r.choice([f"{nz(2)} {d(3)} {d(3)} {d(3)}", nz(11), f"{nz(2)}-{d(7)}"])), (r.choice(["DNI", "NIF"]), nz(8)),
        ])

    def address() -> str:
        city = cap()
        s = r.choice([
            f"{nz(3)} {cap()} {r.choice(['Street', 'Road', 'Avenue', 'Lane', 'Rd', 'Ave', 'St'])}, {city}", f"{nz(2)}{r.choice('abc')} {cap()} {r.choice(['Rd', 'Lane', 'Street'])}, {city} {d(5)}", f"{nz(3)} {cap()} Avenue, Apt {nz(1)}, {city}", f"Flat {nz(1)}, {nz(3)} {cap()} Lane, {city}",
            f"{cap()}straße {nz(3)}, {d(5)} {city}", f"{cap()}weg {nz(2)} a, {city}", f"{cap()}straße {nz(2)}", f"{nz(3)}, rue de {cap()}, {d(5)} {city}", f"{nz(2)} rue {cap()}", f"Calle {cap()} {nz(2)}, {d(5)} {city}", f"{nz(3)} {cap()} {r.choice(['Street', 'Road'])}", f"Am Ring {nz(2)}, {d(5)} {city}",
        ])
        return s.lower() if r.random() < 0.08 else s

    def person() -> str:
        f, g, i = r.choice(family), r.choice(given), r.choice("ABCDEFGHKLMNOPRSTUVWZ")
        s = r.choice([f"{g} {f}", f"{g} {f}", f"{g} {i}. {f}", f"{i}. {f}", f"Dr. {f}", f"Ms {f}", f"Ms {g} {f}", f"Mr. {f}", f"Herr {f}", f"Mme {f}", f"{f}, {g}", f"{f} {g}", f"{g}  {f}", f"{g} {f.upper()}", f"{f}, {i}.", f"Prof. {g} {f}", f"{i}. {i}. {f}"])
        return r.choice([s, s, s, s.lower(), s.upper()])

    def decoy() -> str:
        f = r.choice(family or ["Abcdefberg"])
        return r.choice([
            f"purchase order {nz(2)}-{d(8)}", f"Order no. {nz(1)}-{d(8)}", f"S/N {nz(3)}-{d(2)}-{d(4)}", f"serial no. {nz(3)}-{d(2)}-{d(4)}", f"SN: {nz(9)}", f"ticket REQ-{nz(9)}", f"case no. {nz(8)}", f"release {nz(4)}{d(5)}", f"Build {nz(10)}", f"ping 192.168.{nz(2)}.{nz(2)}", f"host 172.16.{nz(3)}.{nz(2)}", f"v{nz(1)}.{nz(2)}.{d(4)}.{d(2)}", f"{cap().lower()}@4x.jpg", f"{cap()}@2x.webp", f"{cap().lower()}-small@3x.gif",
            f"our {f} kettle", f"a {f} lamp", f"the {f} engine", f"{f} brand tea", f"{f.lower()}-{nz(2)} went down", f"{f.lower()}.{cap().lower()}.example", f"receipt {nz(10)}", f"lot {nz(3)} {d(3)} {d(4)}", f"part no. {nz(3)}-{d(3)}-{d(4)}", f"since 19{d(2)}-0{nz(1)}-1{d(1)} 09:3{d(1)}", f"{nz(3)} steps along the way", f"{nz(2)} cups on the place", f"{nz(3)} bricks of the road", f"Row {nz(1)} of {nz(2)} is in Park View", f"tracking no. {nz(3)}-{d(7)}",
            f"asset {nz(9)}", f"device {nz(8)}", f"IMEI {nz(15)}", f"{nz(2)} pots fit the court", f"looked at {cap().lower()} and left", f"lives at 192.168.{nz(2)}.{nz(2)}", f"revision {nz(8)}", f"sizes {' '.join(nz(3) for _ in range(r.randint(3, 8)))}", f"Platz {nz(2)} is taken",
        ])

    lead = {
        "email": ["Reach the author under ", "reply to ", "mail: ", "Invitations went to ", "His account is ", "bcc ", "Register with <", "Has anyone written to ", ""],
        "phone": ["Phone ", "Ring ", "mobile: ", "Her cell is ", "Text us at ", f"The number for the {noun()} is ", "Fax no. ", "T: ", "Will anyone pick up ", f"Telephone of the {noun()}: ", "dial ", "", "Is "],
        "address": ["We moved to ", "The parcel was left at ", "Visitors come to ", "He rents ", "Post: ", "Was it ", "Return the keys to ", ""],
        "person": ["Thanks to ", "signed by ", "The letter from ", "Cc: ", "Our neighbour ", "", "written by ", "Has ", "Best wishes, "],
    }
    for _ in range(n):
        text, gold = "", []
        for _ in range(r.randint(1, 3)):
            if text:
                text += r.choice([" ", "\n", " "])
            what = r.choice([*TYPES, "phone", "decoy", "decoy", "plain"])
            if what == "plain":
                text += f"Grandmother liked the {noun()} of {cap()} for {nz(2)} years. "
                continue
            if what == "decoy":
                text += r.choice(["", "They sold ", "Once "]) + decoy() + r.choice([".", f" beside the {noun()}.", " as usual."])
                continue
            if what == "phone" and r.random() < 0.08:  # two numbers side by side
                text += r.choice(["Ring ", "T: ", "Phone "])
                for k in (0, 1):
                    value = phone()
                    gold.append((len(text), len(text) + len(value), what))
                    text += value + (" / " if not k else ".")
                continue
            if what == "id_number":
                name, value = id_number()
                text += r.choice(["He wrote his ", f"The {noun()} needs a ", "her ", "Was it ", "my "]) + name + r.choice([" ", " ", ": "])
            else:
                value = {"email": email, "phone": phone, "address": address, "person": person}[what]()
                text += r.choice(lead[what])
            gold.append((len(text), len(text) + len(value), what))
            text += value + r.choice([".", f" about the {noun()}.", " as soon as you can.", ", thanks.", f" with the {noun()}.", "", "?", " tomorrow?"])
        yield text, gold


def train(names: Names, n: int = 2500) -> SemiMarkovField:
    """A field fitted on written sentences with the given name dictionary."""
    family, given = sorted(names.family) or ["abcdefberg"], sorted(names.given) or ["abcdef"]
    data = []
    lexicon = names if names.family else Names(family, given)
    for text, gold in training_sentences([f.capitalize() for f in family[:5000]], [g.capitalize() for g in given[:5000]], n):
        data.append((candidates(text, lexicon), set(gold)))
    return SemiMarkovField().fit(data)


def entities(text: str | None, model: SemiMarkovField, names: Names) -> list[Segment]:
    """Items of personal information in a text, in order."""
    if not text:
        return []
    segs = candidates(text, names)
    return model.best(segs) if segs else []


def redact(text: str, found: list[Segment]) -> str:
    """The text with a typed placeholder in place of every item, otherwise unchanged."""
    out, at = [], 0
    for s in found:
        out += [text[at : s.start], PLACEHOLDER[s.kind]]
        at = s.end
    return "".join([*out, text[at:]])


def load_names(name_parts: DataFrame) -> Names:
    """The name dictionary; a table beyond ``MAX_NAMES`` rows is refused rather than cut."""
    rows = name_parts.select(F.trim("name_part"), F.lower(F.trim("part_kind"))).where(F.trim("name_part") != "").distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError("the name dictionary is too large to be sent to the executors")
    return Names((n for n, k in rows if k == "family"), (n for n, k in rows if k == "given"))


def redact_fields(fields: DataFrame, name_parts: DataFrame, with_text: bool = True) -> DataFrame:
    """Every field that holds an item: its text with placeholders and the types it holds.

    ``fields``: ``rec_table, rec_key, rec_field, text``; extra columns are ignored; null and empty texts and texts
    without an item give no rows (their clean text is the text itself); repeated rows give equal rows. Result: the
    first three columns, ``pii_types`` (sorted, distinct), ``n_items``, ``clean_text`` (null unless ``with_text``).
    """
    names = load_names(name_parts)
    sent = fields.sparkSession.sparkContext.broadcast((train(names), sorted(names.family), sorted(names.given)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, family, given = sent.value
        lexicon = Names(family, given)
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for tab, key, fld, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = entities(text, model, lexicon)
                if found:
                    for c, v in zip(cols, (tab, key, fld, sorted({s.kind for s in found}), len(found), redact(text, found) if with_text else None), strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["rec_table", "rec_key", "rec_field", "pii_types", "n_items", "clean_text"])

    rows = fields.select("rec_table", "rec_key", "rec_field", "text").where(F.length("text") > 0)
    return rows.mapInArrow(scan, "rec_table string, rec_key string, rec_field string, pii_types array<string>, n_items int, clean_text string")


def wiki_fields(pages: DataFrame, feedback: DataFrame) -> DataFrame:
    """The free-text fields of this project."""
    key = F.coalesce(F.col("feedback_id"), F.lit(""))
    out = pages.select(F.lit("pages").alias("rec_table"), row_key("page_id", "version").alias("rec_key"), F.lit("content_text").alias("rec_field"), F.col("content_text").alias("text"))
    pair = F.explode(F.array(*(F.struct(F.lit(c).alias("rec_field"), F.col(c).alias("text")) for c in ("comment", "question"))))
    both = feedback.select(key.alias("rec_key"), pair.alias("f"))
    return out.unionByName(both.select(F.lit("feedback").alias("rec_table"), "rec_key", "f.rec_field", "f.text"))


def types_found(redacted: DataFrame) -> DataFrame:
    """One row per field and type."""
    return redacted.select("rec_table", "rec_key", "rec_field", F.explode("pii_types").alias("pii_type")).distinct()
