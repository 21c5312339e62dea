"""Broken prompt and response pairs: empty, truncated, refused, copied and wrong-language answers.

Copies are found by compression: the answer is compressed with the prompt as zstandard dictionary and the prompt
with the answer as dictionary; where either leaves almost nothing new, the answer only gives the question back.
Languages come from dictionaries of function words, refusals from dictionaries of phrases, and a terminal-context
model, counted over the answers' own sentence and item ends, says whether a text may stop where it does. Its contexts
are the last two words or marks (commas, colons, brackets, fences), apart for text inside brackets and for list items;
how sure it must be depends on whether the answer closes its other sentences.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.runtime import cut_lineage

#: Function words by language.
FUNCTION_WORDS = {
    "en": "the a an of and to is was were in for that it this with you not are be been can cannot should by on at as after before each our we they from which when where why how who what if does do did has have had than whether because so there here into i my your their its will may only or but no yes found already given under while could would these those one per says neither nor explain could",
    "de": "der die das den dem des und ist nicht ein eine einer einem einen von zu zum zur mit wird wurde werden für auf bei nach wenn weil ich sie wir kann darf wie wo warum wer was es im in am an aus oder aber nur noch schon seit bis gilt bitte sich muss danach leider keine kein diese dieser dieses haben habe hat doch laut obwohl ja nein tut mir leid dabei helfen",
    "fr": "le la les l des du de d et est un une pour dans que qui ne n pas par avec notre nous vous je j ce cette ces sur si plus se s puis où comment pourquoi quand elle il au aux en a été être doit peut car mais sans depuis hier avant après merci c mon ma mes votre suis désolé ou son sa ses qu",
    "es": "el la los las de del y en que un una por para con no se es su sus al lo como cómo dónde está fue será puede si porque desde antes después hay hasta ya o pero sin cuando quién qué cuánto esta este esto ese eso son le nos nuestra nuestro debe solo sólo queda luego favor siento mi me tengo estoy puedo yo usted",
}
_LETTERS = {"ß": "de", "ä": "de", "ö": "de", "ü": "de", "ñ": "es", "¿": "es", "¡": "es", "ç": "fr", "è": "fr", "ê": "fr", "à": "fr", "ù": "fr", "œ": "fr", "î": "fr", "ô": "fr", "á": "es", "í": "es", "ó": "es", "ú": "es"}

#: Phrases by language that decline to answer.
REFUSAL_PHRASES = {
    "en": (
        r"\b(?:i|we)(?:'m| am|'re| are)? (?:(?:so |very |truly )?sorry|afraid)\b[^.!?]*\b(?:can(?:no|')?t|cannot|unable|not able|won't|no)\b",
        r"\b(?:i|we) (?:can(?:no|')?t|cannot|could not|couldn't|won't|will not|may not|must not|shouldn't|should not)(?: be able to)? (?:\w+ ){0,2}?(?:help|assist|answer|discuss|share|comment|disclose|provide|reveal|respond|give|fulfil|fulfill|comply|support|do that|tell)\b",
        r"\b(?:i|we)(?:'m| am|'re| are) (?:unable|not able|not allowed|not permitted|not authori[sz]ed|not in a position|not at liberty) to (?:\w+ ){0,2}?(?:help|assist|answer|discuss|share|comment|disclose|provide|reveal|respond|give|fulfil|fulfill|comply)\b",
        r"\b(?:i|we) (?:must|have to|need to|would rather|prefer to) (?:decline|refuse|pass)\b",
        r"\b(?:i|we) (?:decline|refuse) to\b",
        r"\b(?:i|we) (?:don't|do not) feel (?:comfortable|able)\b",
        r"\b(?:this|that|your) (?:request|question)? ?(?:goes|is) (?:against|outside|beyond)\b[^.!?]*\b(?:guidelines|polic(?:y|ies)|rules|allowed|scope|able to|permitted)\b",
        r"\bas an? (?:ai |language |virtual |digital )*(?:assistant|model|ai)\b[^.!?]*\b(?:not|n't|cannot|unable|no access)\b",
        r"\bno answer can be given\b", r"\b(?:i|we) have no (?:access|permission)\b", r"\b(?:i|we) do(?: not|n't) have (?:access|permission)\b",
        r"\b(?:i|we) (?:can(?:no|')?t|cannot|won't|will not) (?:be )?(?:talk|speak|say|go into|answer|discuss|comment)\w*\b", r"\bnot something (?:i|we)(?:'m| am|'re| are)? ?(?:can|could|will|would|may|want|wish|able|allowed)\b", r"\b(?:i|we)(?:'m| am|'re| are) not (?:going|willing|prepared|about) to\b", r"\b(?:i|we)(?:'d| would) rather not\b", r"\b(?:i|we) (?:choose|prefer) not to\b",
        r"\bno comment\b", r"\b(?:my|our) (?:instructions|guidelines|rules|policy|policies|principles|training)\b[^.!?]*\b(?:forbid|prohibit|prevent|(?:do|does)(?: not|n't) (?:allow|permit|let))\w*\b", r"\b(?:is|are) off limits\b",
    ),
    "de": (
        r"\b(?:kann|darf|möchte|werde|können|dürfen)\b[^.!?]*\b(?:nicht|keine?n?)\b[^.!?]*\b(?:helfen|beantworten|antworten|auskunft|sagen|teilen|weitergeben|geben|unterstützen|äußern|erteilen)\b",
        r"\b(?:helfen|beantworten|antworten|auskunft)\b[^.!?]*\b(?:kann|darf|können|dürfen) (?:ich|wir)[^.!?]*\bnicht\b",
        r"\bals (?:ki-?)?(?:assistent|assistentin|sprachmodell|ki)\b[^.!?]*\b(?:kein\w*|nicht)\b",
        r"\b(?:ich|wir) (?:habe|haben) (?:leider )?keinen? (?:zugriff|zugang|berechtigung|befugnis)\b", r"\b(?:bin|sind) (?:leider )?nicht (?:befugt|berechtigt|in der lage)\b",
        r"\bmuss (?:ich|wir)?[^.!?]*\bablehnen\b", r"\b(?:kein kommentar|keine auskunft|keine angaben?)\b", r"\b(?:möchte|will|werde|darf) (?:ich|dazu|das|darüber|mich)[^.!?]*\bnicht\b[^.!?]*$", r"\bmeine (?:vorgaben|regeln|anweisungen)\b[^.!?]*\b(?:verbieten|untersagen|erlauben)\b",
    ),
    "fr": (
        r"\bje (?:ne )?(?:peux|puis|pourrai|saurais|souhaite|veux) (?:malheureusement )?pas\b[^.!?]*\b(?:aider|répondre|partager|donner|fournir|communiquer|assister|commenter|discuter|divulguer|traiter)\b",
        r"\bje ne suis pas (?:autorisée?|en mesure|habilitée?|capable)\b", r"\bje n'ai pas (?:accès|le droit|l'autorisation)\b", r"\bje dois (?:refuser|décliner)\b",
        r"\b(?:sans|aucun|pas de) commentaires?\b", r"\bje (?:préfère|souhaite) ne pas\b", r"\bje refuse\b", r"\bmes (?:consignes|règles|instructions)\b[^.!?]*\b(?:interdi\w+|permett\w+|empêch\w+)",
        r"\ben tant qu'(?:assistante?|ia|modèle)\b[^.!?]*\b(?:pas|aucun)\b", r"\bimpossible (?:pour moi )?de (?:répondre|vous aider)\b",
    ),
    "es": (
        r"\bno (?:puedo|podré|podemos|debo|quiero) (?:\w+ ){0,2}?(?:ayudar\w*|responder\w*|contestar\w*|compartir\w*|dar\w*|comentar\w*|proporcionar\w*|revelar\w*|hablar)\b",
        r"\bno (?:estoy|estamos) (?:autorizad[oa]s?|en condiciones|en posición)\b", r"\bno tengo (?:acceso|permiso|autorización)\b", r"\b(?:debo|tengo que) (?:rechazar|declinar|negarme)\b",
        r"\bsin comentarios\b", r"\bprefiero no\b", r"\bme niego\b", r"\bno voy a (?:\w+ )?(?:responder|contestar|hablar|comentar|decir)\w*", r"\bmis (?:instrucciones|normas|reglas)\b[^.!?]*\b(?:prohíb\w+|permit\w+|impid\w+)",
        r"\bcomo (?:asistente|modelo|ia)\b[^.!?]*\bno\b", r"\bno me es posible (?:ayudar|responder|contestar)\w*\b",
    ),
}
#: What may follow a refusal without being an answer.
CLOSERS = (
    r"^(?:please |bitte |veuillez |por favor )?(?:contact|ask|try|reach|see|wenden|fragen|kontaktieren|versuchen|contacte\w*|demande\w*|essaye\w*|pregunt\w*|intent\w*|consult\w*)\b",
    r"^(?:is there (?:anything|something)|can i help|let me know|anything else|thank|thanks|kann ich|gibt es|puis-je|y a-t-il|puedo|hay algo|gracias|merci|danke|sorry|lo siento|désolé|tut mir leid|es tut mir leid|i apologi[sz]e)\b",
)

#: Words that stand for nothing.
NOTHING = {"", "null", "none", "nil", "na", "nan", "undefined", "empty", "void", "tbd", "todo", "nichts", "keine", "rien", "aucun", "aucune", "nada", "ninguno", "ninguna", "blank", "missing"}

_TAG = re.compile(r"<[^<>]*>")
_INVISIBLE = re.compile(r"[\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\u00ad]")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|[,;:()\[\]{}–—]|(?<!\S)-(?!\S)|-$")
_EMOTICON = re.compile(r"(?<!\w)[:;]-?[()\[\]](?!\w)")
_OPENS, _CLOSES = "([{", ")]}"
_CHAR_WORD = re.compile(r"[^\W_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?…。])[\"'”’»)\]*_]*\s+|\n+")
_BULLET = re.compile(r"^\s*(?:[-*+•–]|\d{1,3}[.)])\s+\S")
_URL_END = re.compile(r"(?:https?://|www\.)\S+$")

_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _WORD_LANGS.setdefault(_w, []).append(_lang)
_REFUSALS = {lang: re.compile("|".join(p)) for lang, p in REFUSAL_PHRASES.items()}
_CLOSER = re.compile("|".join(CLOSERS))


def language(text: str) -> tuple[str | None, float]:
    """Most likely of the four languages and how much speaks for it over the next; None where nothing does."""
    low = text.lower()
    score = dict.fromkeys(FUNCTION_WORDS, 0.0)
    for w in re.findall(r"[^\W\d_]+", low):
        langs = _WORD_LANGS.get(w)
        if langs:
            for lang in langs:
                score[lang] += 1 / len(langs)
    for ch, lang in _LETTERS.items():
        if ch in low:
            score[lang] += min(2, low.count(ch)) * 0.7
    first, second = sorted(score.items(), key=lambda x: -x[1])[:2]
    return (first[0], first[1] - second[1]) if first[1] > 0 and first[1] > second[1] else (None, 0.0)


def is_empty(answer: str | None) -> bool:
    """Only blanks, invisible characters, punctuation, empty markup or a word standing for nothing."""
    if answer is None:
        return True
    bare = _INVISIBLE.sub("", _TAG.sub(" ", html.unescape(answer)))
    kept = "".join(ch for ch in bare if ch.isalnum())
    if not kept:
        return not any(ord(ch) > 0x2BFF for ch in bare)  # a lone pictograph is content
    return kept.lower() in NOTHING and len(bare.split()) <= 2


def _plain(text: str) -> bytes:
    text = _INVISIBLE.sub("", _TAG.sub(" ", text)).casefold()
    return " ".join(_CHAR_WORD.findall(text)).encode()


def novel_bytes(text: bytes, known: bytes) -> int:
    """Bytes zstandard needs for ``text`` with ``known`` as dictionary, less those of an empty frame."""
    data = zstandard.ZstdCompressionDict(known.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packed = zstandard.ZstdCompressor(level=3, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False).compress(text)
    return max(0, len(packed) - 9)


def is_copy(question: str | None, answer: str) -> bool:
    """Whether the answer only gives the question back, up to case, marks, repetition and a short lead-in."""
    if not question:
        return False
    q, a = _plain(question), _plain(answer)
    if len(q) < 8 or len(a) < 0.6 * len(q):
        return False
    # what is new may grow with the question but not with its repetitions, of which a block of 128 KB costs a few bytes
    new = 16 + min(len(a), 2 * len(q) + 40) // 40 + 12 * (len(a) >> 17)
    return novel_bytes(a, q) <= new and novel_bytes(q, a) <= 10 + len(q) // 10


def refusal_language(answer: str) -> str | None:
    """Language of a refusal; None where something is answered or declined nowhere."""
    low = re.sub(r"[’`]", "'", answer.strip().lower())
    parts = [p for p in _SENTENCE_END.split(low) if p and p.strip()]
    declined, left = None, 0
    for p in parts:
        lang = next((n for n, rx in _REFUSALS.items() if rx.search(p)), None)
        if lang:
            declined = declined or lang
        elif not _CLOSER.search(p.strip(" ¿¡\"'")):
            left += 1
    return declined if declined and not left else None


#: Least probability of an end by the style of a text: where its other sentences are closed, where it has but one,
#: where it has at most three words, and in a list item.
LEAST = {"closed": 0.9, "open": 0.02, "short": 0.002, "item": 0.02}


#: What marks that announce more, and words inside brackets, are taken to end before anything is counted, as a share of the mean.
MARK_PRIOR = 0.01
_OPEN_MARK = re.compile(r"^•?\(|^•?[,;:(\[{–—-]$|^```$")


def contexts(sentence: str, item: bool) -> list[tuple[str, str]]:
    """Each word or mark with the one before (or ""); words inside brackets and of list items are told apart."""
    out, before, depth = [], "", 0
    for t in _TOKEN.findall(_EMOTICON.sub(" ", sentence.lower())):
        if t in _CLOSES:
            depth = max(0, depth - 1)
        word = ("•" if item else "") + ("(" if depth else "") + t
        out.append((before, word))
        before = t
        if t in _OPENS:
            depth += 1
    return out


def _sentences(line: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?…])[\"'”’»)\]*_]*\s+", line) if x.strip()]


def _is_closed(sentence: str) -> bool:
    return sentence.rstrip().rstrip("\"'”’»)]}*_~`")[-1:] in tuple(".!?…。")


def count_contexts(texts: Iterable[str], seen: Counter, ends: Counter) -> None:
    """Add how often each pair (one before or "", word or mark) stands in the texts, and how often it ends a sentence or item.

    A list item ends where another line follows. Whether the last words of an open text are an end is what is asked.
    """
    for text in texts:
        lines = text.split("\n")
        for no, line in enumerate(lines):
            if line.lstrip().startswith("```"):
                seen["", "```"] += 1
                continue
            item = bool(_BULLET.match(line))
            for sentence in _sentences(line):
                t = contexts(sentence, item)
                closed = _is_closed(sentence) or (item and no < len(lines) - 1)
                if not closed:
                    del t[-1:]
                seen.update(t)
                if closed and t:
                    ends[t[-1]] += 1


class TerminalContexts:
    """Interpolated model of P(end | last two words or marks), from sentence and item ends of the texts themselves."""

    def __init__(self, texts: Iterable[str]):
        self.seen, self.ends = Counter(), Counter()
        count_contexts(texts, self.seen, self.ends)
        for counts in (self.seen, self.ends):
            for (_, w), n in list(counts.items()):
                counts[w] += n
        n = sum(v for k, v in self.seen.items() if isinstance(k, str))
        self.base = sum(v for k, v in self.ends.items() if isinstance(k, str)) / n if n else 0.1

    def __call__(self, last: tuple[str, str]) -> float:
        w = last[1]
        if not w:
            return self.base
        prior = self.base * (MARK_PRIOR if _OPEN_MARK.search(w) else 1)
        if not last[0]:  # a sentence of one word, of which the word's use inside sentences says nothing
            return (self.ends[last] + 4 * prior) / (self.seen[last] + 4)
        if not self.seen[w]:  # most likely a part of a word
            return 0.2 * prior
        one = (self.ends[w] + 2 * prior) / (self.seen[w] + 2)
        return (self.ends[last] + 4 * one) / (self.seen[last] + 4)


def is_truncated(answer: str, ends: TerminalContexts) -> bool:
    """Whether the text stops before it is finished."""
    asked = open_end(answer)
    return asked is not None and ends(asked[0]) < asked[1]


def open_end(answer: str) -> tuple[tuple[str, str], float] | None:
    """The last two words or marks of a text that ends without a closing mark, and the least P(end) that it needs; None if it is closed."""
    text = _INVISIBLE.sub("", answer).rstrip()
    if text.count("```") % 2:
        return ("", "```"), LEAST["open"]
    if text.endswith("```") or _URL_END.search(text) or _is_closed(text):
        return None
    line = text[text.rfind("\n") + 1 :]
    last = text.rstrip("\"'”’»*_~`")[-1:]
    if not last or not (last.isalnum() or last in "'-/&%$€+#@,;:()[]{}–—") or _EMOTICON.search(line[-3:]):
        return None  # pictographs
    item = bool(_BULLET.match(line))
    fragments = _sentences(line)
    t = contexts(fragments[-1], item) if fragments else []
    style = "item" if item else "closed" if len(fragments) > 1 or re.search(r"[.!?…]\s*\n", text) else "short" if len(_CHAR_WORD.findall(text)) <= 3 and last.isalnum() else "open"
    return t[-1] if t else ("", ""), LEAST[style]


def defect(question: str | None, answer: str | None, ends: TerminalContexts) -> str | None:
    """Kind of defect of an answer, or None."""
    return defect_of_whole(question, answer) or ("truncated" if is_truncated(answer, ends) else None)


def defect_of_whole(question: str | None, answer: str | None) -> str | None:
    """Kind of defect of an answer other than a missing end, or None."""
    if is_empty(answer):
        return "empty"
    if is_copy(question, answer):
        return "copy"
    q_lang, q_margin = language(question) if question else (None, 0.0)
    declined = refusal_language(answer)
    if declined:
        return "other_language" if q_lang and q_margin >= 1 and declined != q_lang else "refusal"
    a_lang, a_margin = language(re.sub(r"```.*?(?:```|$)|https?://\S+", " ", answer, flags=re.S))
    if q_lang and a_lang and a_lang != q_lang and a_margin >= 1.5 and q_margin >= 0.9:
        return "other_language"
    return None


#: Pairs of words a task counts before it sends them on.
PAIRS_AT_ONCE = 200_000


def terminal_counts(feedback: DataFrame) -> DataFrame:
    """``before, word, seen, ends``: the counts of ``count_contexts`` over all answers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, ends = Counter(), Counter()

        def table() -> pa.RecordBatch:
            cols = [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64()), pa.array([ends[k] for k in seen], pa.int64())]
            return pa.RecordBatch.from_arrays(cols, names=["before", "word", "seen", "ends"])

        for batch in batches:
            count_contexts(batch.column(0).to_pylist(), seen, ends)
            if len(seen) > PAIRS_AT_ONCE:
                yield table()
                seen, ends = Counter(), Counter()
        yield table()

    counted = feedback.select("answer").where(F.col("answer").isNotNull()).mapInArrow(count, "before string, word string, seen long, ends long")
    return counted.groupBy("before", "word").agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends"))


def _open_ends(asked: DataFrame, feedback: DataFrame) -> DataFrame:
    """The rows of ``asked`` (``before, word, least``) that end less probably than ``least``, as ``TerminalContexts`` has it."""
    counts = cut_lineage(terminal_counts(feedback))
    total = counts.agg(F.sum("seen").alias("seen"), F.sum("ends").alias("ends")).first()
    base = total.ends / total.seen if total.seen else 0.1
    words = counts.groupBy("word").agg(F.sum("seen").alias("w_seen"), F.sum("ends").alias("w_ends"))
    known = asked.join(words, "word", "left").join(counts, ["before", "word"], "left")
    prior = F.when(F.col("word").rlike(_OPEN_MARK.pattern), F.lit(base * MARK_PRIOR)).otherwise(F.lit(base))
    one = (F.col("w_ends") + 2 * prior) / (F.col("w_seen") + 2)
    two = (F.coalesce("ends", F.lit(0)) + 4 * F.when(F.col("before") == "", prior).otherwise(one)) / (F.coalesce("seen", F.lit(0)) + 4)
    chance = F.when(F.col("word") == "", F.lit(base)).when(F.col("before") == "", two).when(F.col("w_seen").isNull(), 0.2 * prior).otherwise(two)
    return known.where(chance < F.col("least"))


def broken_pairs(feedback: DataFrame, ends: TerminalContexts | None = None) -> DataFrame:
    """Every entry whose answer is defective, with the kind of defect.

    Without ``ends``, the last words of answers are judged by counts over all answers, which are joined to them.
    A null answer is 'empty'; a null question is compared with nothing, so its answer can only be empty, refused
    or truncated. Entries of null id are kept under the empty id. Repeated rows give one row; extra columns are
    ignored; very long texts are judged whole. Result: ``feedback_id, defect``.
    """
    sent = feedback.sparkSession.sparkContext.broadcast(ends)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = []
            for key, q, a in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                kind = defect_of_whole(q, a)
                asked = None if kind else open_end(a)
                if asked and model is not None:
                    kind, asked = "truncated" if model(asked[0]) < asked[1] else None, None
                if kind:
                    rows.append((key, kind, None, None, None))
                elif asked:
                    rows.append((key, None, *asked[0], asked[1]))
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["feedback_id", "defect", "before", "word", "least"])

    rows = feedback.select(F.coalesce("feedback_id", F.lit("")).alias("feedback_id"), "question", "answer")
    judged = rows.mapInArrow(judge, "feedback_id string, defect string, before string, word string, least double")
    if ends is not None:
        return judged.select("feedback_id", "defect").distinct()
    judged = cut_lineage(judged)
    late = _open_ends(judged.where("defect IS NULL").drop("defect"), feedback).select("feedback_id", F.lit("truncated").alias("defect"))
    return judged.where("defect IS NOT NULL").select("feedback_id", "defect").unionByName(late).distinct()


def defect_profile(feedback: DataFrame, broken: DataFrame) -> DataFrame:
    """Defects per kind of feedback; spellings of the kind are folded."""
    kind = F.lower(F.trim("feedback_type"))
    kind = F.when(kind.isin("positive", "pos", "thumbs_up"), "positive").when(kind.isin("negative", "neg", "thumbs_down"), "negative").otherwise("unknown")
    kinds = feedback.select("feedback_id", kind.alias("feedback_kind")).where(F.col("feedback_id").isNotNull()).groupBy("feedback_id").agg(F.max("feedback_kind").alias("feedback_kind"))
    return broken.join(kinds, "feedback_id", "left").groupBy("defect", "feedback_kind").agg(F.count("*").alias("n"))
