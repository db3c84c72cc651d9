"""Unusable responses to prompts (problem 2), each with its kind of defect.

A response is the content field of its action where it was parsed, else the raw text; a raw text that is a whole JSON object
stands for the content in it. The kinds are tried in this order, and one is given: empty, refusal, copies_question,
other_language, truncated.

copies_question: the words of the response are contained in the prompt, by five-word shingles for exact copies, and by the longest
common subsequence (bit-parallel), which bears slips, swaps and dropped words; what is given back several times must be a copy every time. refusal: every
sentence is aligned with refusal templates: whole wordings by longest common subsequence (a slot may stand at the end), and slotted ones, where a phrase of
inability is followed by an act of answering and by an object, each out of a list; courtesies are taken off first, and a sentence that states something is none.
other_language: a whole sentence whose function words (or script) belong to another language than the prompt's, or whose letters go better with the character
n-grams of another language, where it has next to no function word of the prompt's; so languages without a list of their own are told from the prompt's too.
truncated: JSON that does not close, or a text without final stop although texts that begin with the same words end with one, by counts over all responses.

A raw_response that is NULL or an API error is no response, and no case. NULL, blank and invisible contents, and stand-ins
such as n/a, are empty. An unknown action stands for whichever field is filled. Equal rows give equal results; texts have no bound in length and are judged
whole; a kind of opening counts from KNOWN_OPENING responses on, whatever the size of the table. Predictions are read once.
"""

from __future__ import annotations

import functools
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .unify import unify_array

API_ERROR = "__API_ERROR__"
#: A kind of opening counts if at least so many responses have it, however large the table.
KNOWN_OPENING = 3
#: Stand-ins for nothing, without case and punctuation.
NOTHING = frozenset(("", "na", "n a", "null", "none", "nil", "nan", "empty", "blank", "undefined", "no answer", "no content", "no response", "not available", "not applicable", "no answer given"))
#: How refusals are worded; * stands for a subject.
REFUSALS = """
i can not help with that request
i can not help with that
i can not help you with this
i am not able to answer this question
i am unable to provide this information
i am unable to answer
i am unable to help with that
i must decline to respond here
i must decline to answer
i have to decline
i have to pass on this
i will not answer this question
it is impossible for me to tell
no answer can be given by me for this one
you will have to ask somebody else
that is outside what i can do
this is not something i will comment on
this is not something i can comment on
answering would go beyond what i am permitted to share
my guidelines do not allow me to discuss *
my guidelines do not allow me to answer
i will not take a position on *
i would rather not say anything about *
i would rather not answer
i do not feel comfortable answering
i can not answer this question
i can not provide that information
i can not comment on *
no me es posible responder a esta pregunta
no puedo ayudar con esa solicitud
no puedo responder a esta pregunta
diese frage darf ich leider nicht beantworten
dabei kann ich nicht helfen
diese frage kann ich nicht beantworten
je ne peux pas répondre à cette demande
il m est impossible de traiter cette question
je ne peux pas répondre à cette question
não posso ajudar com esse pedido
я не могу ответить на этот вопрос
""".strip().split("\n")
#: Courtesies around refusals, taken off before aligning.
COURTESY = r"\b(?:sorry|apologies|unfortunately|with respect|to be clear|as a(?:n ai)? language model|i am sorry|i regret|but|please consult an expert|and i hope you understand|policy|is there anything else i can do|lo siento|es tut mir leid|je suis désolé|leider|pero|mais|aber|desculpe|извините|но)\b"
#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and is was were are in to what which who how does do did that this it its for by with from as on at has have had not but can could you your there be been when where about according between both give given",
    "de": "der die das den dem des und ist war wird wurde im zu was welche welcher welches wer wie wo für von mit aus als auf bei nicht aber sich ein eine einen einer einem zum zur laut über nach sie können es auch dabei kann ich diese frage",
    "fr": "le la les des du de et est était dans que qui quel quelle pour par avec sur au aux ne pas mais se un une ce cette il elle d l s qu où faut lequel pouvez vous en",
    "es": "el la los las del de y es era en que qué cuál quién para por con sobre al no pero se un una lo según puede esta este cuando describir cual sus",
    "pt": "o a os as do da dos das de e é era em que qual quem para por com sobre ao não mas se um uma já como foi no na acordo dito",
    "it": "il lo la gli le del della dei di e è era in che quale chi per con su al non ma si un una come secondo",
    "nl": "de het een en is was in van wat welke wie voor door met op aan niet maar zich dat deze zijn volgens",
    "pl": "w z na i jest był była to co który która kto dla przez o do nie ale się że według jak",
    "sv": "och i att det som en på är av för med till den har de inte om ett han var från enligt kan vid vilken vad",
    "da": "og i at det som en på er af for med til den har de ikke om et han var fra ifølge kan ved hvilken hvad",
    "fi": "ja on ei se että oli mutta ovat mukaan joka hän tämä kuka mikä kun jos vain myös ole sen olla voi",
    "tr": "ve bir bu için de da ile olarak çok daha göre olan ne kim hangi değil gibi ama sonra kadar var yok mi",
    "cs": "a v na je se že to byl byla s z do o který která podle kdo co pro jako by ale není jsou při od",
    "hu": "a az és egy nem hogy is volt szerint ki mi ez de van meg el csak mint vagy után amely ami aki",
    "ro": "și în de la cu pe nu este a fost care un o din pentru că se mai sunt au potrivit cine ce dar după al",
    "is": "og í að á er var sem um við til af ekki en það hann hún með fyrir samkvæmt hver hvað úr hefur voru",
}
#: Finite verbs that make a sentence of words without a final stop.
VERBS = frozenset("is was are were has have can ist war wird wurde sind kann hat est était sont peut es era fue son puede é foi são pode è sono può zijn heeft jest był była są är har er on oli ovat je byl van volt este sunt var".split())
#: Slotted refusals by language: phrases of inability, and acts of answering; an act may stand before its inability.
SLOTTED = {
    "en": ("can not|could not|will not|would not|am unable to|are unable to|am not able to|are not able to|am not permitted to|am not allowed to|must decline to|have to decline to|decline to|refuse to|must refuse to|would rather not|would prefer not to|prefer not to|do not feel comfortable|am not comfortable|do not want to|do not wish to|will not be able to",
           "answer answering respond responding help helping assist assisting provide providing discuss discussing comment commenting share sharing say fulfil fulfill fulfilling comply complying complete process tell give giving do continue engage disclose offer support handle address reply"),
    "de": ("kann ich nicht|kann ich leider nicht|ich kann nicht|kann nicht|kann leider nicht|darf ich nicht|darf ich leider nicht|möchte ich nicht|ich möchte nicht|werde ich nicht|ich werde nicht|nicht", "beantworten helfen sagen besprechen kommentieren weitergeben erfüllen antworten"),
    "fr": ("je ne peux pas|je ne suis pas en mesure de|je ne souhaite pas|je ne veux pas|je refuse de|il m est impossible de|nous ne pouvons pas|je ne peux malheureusement pas", "répondre aider fournir traiter discuter commenter dire partager satisfaire"),
    "es": ("no puedo|no me es posible|no deseo|no quiero|no podemos|me niego a|no estoy autorizado a", "responder ayudar proporcionar comentar decir compartir atender contestar ayudarle ayudarte"),
    "pt": ("não posso|não consigo|não quero|não podemos|não me é possível|recuso me a", "ajudar responder fornecer comentar dizer partilhar compartilhar atender"),
    "it": ("non posso|non sono in grado di|non voglio|non possiamo|mi rifiuto di", "rispondere aiutare fornire commentare dire condividere soddisfare aiutarla"),
    "ru": ("не могу|не буду|не можем|не имею права|отказываюсь", "ответить отвечать помочь помогать обсуждать комментировать предоставить выполнить сказать"),
}
#: What may surround the slots: subjects, objects, little words.
AROUND = frozenset("i we me you us my this that these those the a an any your such it its here now at all to with on about for of be am in regard regarding question questions request requests prompt query topic matter information answer answers further task as and so please today just simply diese dieser dieses frage fragen anfrage ihre ihnen ihr dabei das bei der die den auf leider ich zu à cette ce votre demande question requête la le vous de pas te esta este esa ese pregunta solicitud su con a le lhe essa esse pergunta pedido com questa questo domanda richiesta a alla вопрос вопросы на этот это запрос вам с этим я по".split())
#: Words of a sentence that says what is known, or what is lacking; such a sentence declines nothing.
STATES = frozenset("was is were are which who what when where because evidence document documents record records source sources without unless until missing mention mentions says confirm war ist waren welche welcher wer wann weil est était sont qui quel quelle parce es era fue cuál quién porque é foi qual quem".split())
_WORDS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_TEMPLATES = [(core, frozenset(core), t.endswith("*")) for t in REFUSALS for core in [t.removesuffix("*").split()]]
_SLOTS = [(re.compile(rf"(?<!\w)(?:{phrases})(?!\w)"), frozenset(acts.split())) for phrases, acts in SLOTTED.values()]
_ASKS = r"^\W*(?:please answer|question|prompt|query|q|frage|pregunta)\s*:\s*"


def tokens(text: str) -> list[str]:
    return re.findall(r"\w+", text)


def plain(text: str) -> str:
    """Lower case, contractions spelt out."""
    t = text.lower().replace("’", "'")
    for a, b in (("can't", "can not"), ("cannot", "can not"), ("won't", "will not"), ("n't", " not"), ("i'm", "i am"), ("i'd", "i would"), ("i'll", "i will"), ("i've", "i have")):
        t = t.replace(a, b)
    return t


def subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table in one long integer (Hyyrö)."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = where.get(y, 0)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def is_empty(text: str) -> bool:
    return " ".join(tokens(re.sub(r"[​-‏⁠﻿­]", "", text.lower()).replace("/", ""))) in NOTHING


def _worded(words: list[str]) -> bool:
    """Whether words align with one of the whole wordings: next to nothing of either is left over, but for a slot."""
    have = frozenset(words)
    for core, known, slot in _TEMPLATES:
        if len(words) > len(core) + 5 or len(known & have) < 0.8 * len(core) - (len(core) - len(known)):
            continue
        if subsequence(core, words) >= 0.85 * len(core) and len(words) - len(core) <= (5 if slot else 2):
            return True
    return False


def _slotted(words: list[str]) -> bool:
    """Whether words fill the slots of a refusal: inability and act within seven words of each other, little around them, and a subject of at most five words named."""
    joined = " ".join(words)
    for phrases, acts in _SLOTS:
        for m in phrases.finditer(joined) if not acts.isdisjoint(words) else ():
            at = joined.count(" ", 0, m.start())
            end = at + m[0].count(" ") + 1
            act = next((k for k in (*range(end, min(end + 7, len(words))), *range(at - 1, max(-1, at - 4), -1)) if words[k] in acts), None)
            if at > 8 or act is None or any(w not in AROUND for w in words[end:act]):
                continue
            other = [w for k, w in enumerate(words) if k != act and not at <= k < end]
            rest = [w for w in other if w not in AROUND]
            named = any(w in ("about", "on", "discuss", "discussing", "über", "sur", "sobre", "su", "о", "обсуждать") for w in words)
            if not STATES.intersection(other) and sum(w not in AROUND for w in words[:at]) <= 1 and len(rest) <= (5 if named else 1):
                return True
    return False


def is_refusal(text: str) -> bool:
    """Whether a text declines, and nothing else: each of its sentences, said once or often, is a refusal or a courtesy."""
    told = re.sub(COURTESY, " ", plain(text))
    sentences = {tuple(w) for w in map(tokens, re.split(r"[.!?。！？;…\n]+", told)) if w}
    if not sentences:
        return False
    if all(_worded(list(w)) or _slotted(list(w)) for w in sentences):
        return True
    return _worded(tokens(told))


def copies(prompt: str, text: str) -> bool:
    """Whether the response gives the prompt back and nothing else, once or more."""
    q = tokens(re.sub(_ASKS, "", prompt.lower()))
    r = tokens(re.sub(_ASKS, "", text.lower()))
    if len(q) < 3 or len(r) < 0.5 * len(q):
        return False
    have = Counter(q)
    inside = sum(w in have for w in r) / len(r)
    if inside < 0.6:
        return False
    known = lambda w: w in have or any(x.startswith(w) or subsequence(list(x), list(w)) >= len(x) - 1 > 2 for x in have)
    if not known(r[-1]) and (len(r) > 1.5 * len(q) or not known(r[-2])):
        return False  # an answer stands behind
    runs = {tuple(q[i : i + 5]) for i in range(len(q) - 4)}
    own = [tuple(r[i : i + 5]) for i in range(len(r) - 4)]
    if own and runs and sum(x in runs for x in own) >= 0.8 * len(own) and len(set(own) & runs) >= 0.8 * len(runs):
        return True
    if len(r) <= 1.5 * len(q):
        return subsequence(r, q) >= 0.65 * max(len(q), len(r))
    # given back several times: every time must be a copy, a last one that breaks off of the beginning; the sum is over the whole response
    parts = [r[i : i + len(q)] for i in range(0, len(r), len(q))]
    same = [subsequence(x, q[: len(x) + 2]) for x in parts]
    return sum(same) >= 0.65 * len(r) and all(n >= 0.65 * len(x) for n, x in zip(same, parts))


def language(text: str) -> tuple[str | None, Counter]:
    """The language of most function words, or of the script; None where nothing tells."""
    letters = Counter("zh" if "㐀" <= c <= "鿿" else "ja" if "぀" <= c <= "ヿ" else "ru" if "Ѐ" <= c <= "ӿ" else "ar" if "؀" <= c <= "ۿ" else "el" if "Ͱ" <= c <= "Ͽ" else "" for c in text if c > "\u036f" and c.isalpha())
    marks = {k: n for k, n in letters.items() if k and n >= 4}
    words = tokens(text.lower().replace("’", " ").replace("'", " "))
    hits = Counter({k: sum(map(known.__contains__, words)) for k, known in _WORDS.items()})
    for k, n in marks.items():
        hits[k] += n if k in ("zh", "ja") else n // 4
    best, n = max(hits.items(), key=lambda x: x[1])
    return (best if n >= 2 else None), hits


@functools.lru_cache(4096)
def _language_of(prompt: str) -> str | None:
    return language(prompt)[0]


@functools.lru_cache(1)
def profiles() -> dict[str, tuple[dict[str, float], float]]:
    """Per language the log probability of a letter after the two before it, out of its function words, and that of an unseen one."""
    out = {}
    for lang, known in _WORDS.items():
        seen: Counter[str] = Counter()
        for w in known:
            t = f"  {w} "
            seen.update(t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1))
        letters = sum(n for g, n in seen.items() if len(g) == 1)
        # probabilities of one, two and three letters mixed, so that unseen runs go by their letters
        out[lang] = ({g: n for g, n in seen.items()}, float(letters))
    return out


@functools.lru_cache(65536)
def _likelihood(word: str, lang: str) -> float:
    """Mean log probability of a word's letters in a language."""
    seen, letters = profiles()[lang]
    t = f"  {word} "
    total = 0.0
    for i in range(2, len(t)):
        three = seen.get(t[i - 2 : i + 1], 0) / max(1, seen.get(t[i - 2 : i], 0))
        two = seen.get(t[i - 1 : i + 1], 0) / max(1, seen.get(t[i - 1], 0))
        total += math.log(0.5 * three + 0.3 * two + 0.19 * seen.get(t[i], 0) / letters + 0.0005)
    return total / (len(t) - 2)


def _strange(text: str, own: str, hits: Counter) -> bool:
    """Whether a sentence's words go better with another language's letters than with those of own, of which it has next to no function word."""
    words = [w for w in re.findall(r"[^\W\d_]+", text.replace("’", "'")) if w[:1].islower() and len(w) > 1]
    if len(words) < 5 or hits[own] > 0.1 * len(words):
        return False
    mean = lambda lang: sum(_likelihood(w, lang) for w in words) / len(words)
    return max(mean(lang) for lang in _WORDS if lang != own) > mean(own) + 0.05


def other_language(prompt: str, text: str) -> bool:
    stop = bool(re.search(r"[.!?。！？][\"'”’»)\s]*$", text))
    a = _language_of(prompt)
    if a is None:
        return False
    b, hits = language(text)
    if b is not None and a != b and hits[b] >= 3 and hits[b] >= hits[a] + 2 and (stop or hits[b] >= 4 and VERBS.intersection(tokens(text.lower()))):
        return True
    return stop and a in _WORDS and _strange(text, a, hits)


def stopped(text: str) -> bool:
    return bool(re.search(r"[.!?。！？…][\"'”’»)\]\s]*$", text)) and not text.rstrip().endswith(("...", "…"))


def openings(text: str) -> list[str]:
    """How a text begins, from three words to one; names, dates and figures (runs of capitalised words and numbers) masked, the first word also as it is."""
    raw = (m[0] for m in re.finditer(r"\S+", text))
    first = next(raw, None)
    out: list[str] = []
    for w in () if first is None else chain((first,), raw):
        bare = w.strip("“”„\"'’.,:;!?()[]«»")
        m = ("N" if out else "9") if bare[:1].isdigit() else "N" if bare[:1].isupper() and out else w.strip("“”„\"(«")
        if m == "N" and out and out[-1] == "N":
            continue
        out.append(m)
        if len(out) == 5:
            break
    masked = out[:]
    if first and (first.strip("“”„\"'(«")[:1].isupper() or first[:1].isdigit()):
        masked = ["N", *out[1:]]
        if len(masked) > 1 and masked[1] == "N":
            masked.pop(1)
    keys = []
    for k in (3, 2, 1):
        if len(out) > k or len(out) == k:
            keys.append(" ".join(out[:k]))
        if k > 1 and len(masked) >= k:
            keys.append("~" + " ".join(masked[:k]))
    return keys


def unclosed_json(text: str) -> bool | None:
    """None: no JSON. Whether a JSON text ends before it closes."""
    t = re.sub(r"^\s*```\w*\s*", "", text)
    if not re.match(r"\s*[\[{]", t):
        return None
    bare = re.sub(r'"[^"]*"', "", re.sub(r"\\.", "", re.sub(r"```\s*$", "", t)))
    return '"' in bare or sum(c in "[{" for c in bare) > sum(c in "]}" for c in bare)


def json_content(text: str) -> str | None:
    """The content of a raw text that is a whole JSON object; None if it is none."""
    try:
        x = json.loads(re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", text))
    except (ValueError, RecursionError):
        return None
    if not isinstance(x, dict):
        return None
    first, second = ("clarification", "answer") if str(x.get("action", "")).startswith("REQUEST") else ("answer", "clarification")
    got = x.get(first) or x.get(second) or ""
    return got if isinstance(got, str) else json.dumps(got)


def contents(predictions: DataFrame, fields: DataFrame) -> DataFrame:
    """response_id, query, content, raw (whether content is the raw text); fields maps actions to content fields: it is a vocabulary, read on the driver whole."""
    which = {r["action"]: r["content_field"] for r in fields.select("action", "content_field").where("action is not null").collect()}
    p = F.col("parsed")
    filled = F.coalesce(F.when(F.trim(p["answer"]) != "", p["answer"]), p["clarification"], p["answer"])
    field = F.element_at(F.create_map(*[F.lit(x) for pair in which.items() for x in pair]), p["action"]) if which else F.lit(None)
    content = F.when(field == "answer", p["answer"]).when(field == "clarification", p["clarification"]).when(field == "reason", p["reason"]).otherwise(filled)
    rows = predictions.where(F.col("raw_response").isNotNull() & ~F.col("raw_response").startswith(API_ERROR))
    return rows.select("response_id", F.coalesce("query", F.lit("")).alias("query"), F.coalesce(F.when(p.isNotNull(), content).otherwise(F.col("raw_response")), F.lit("")).alias("content"), p.isNull().alias("raw"))


def defect_of(prompt: str, text: str, raw: bool) -> tuple[str | None, list[str] | None]:
    """The defect, and of a text without final stop that has none by itself its kinds of openings: their rates decide."""
    if raw:
        broken = unclosed_json(text)
        if broken:
            return "truncated", None
        inner = json_content(text) if broken is False else None
        text = text if inner is None else inner
    if is_empty(text):
        return "empty", None
    if is_refusal(text):
        return "refusal", None
    if copies(prompt, text):
        return "copies_question", None
    if other_language(prompt, text):
        return "other_language", None
    if not stopped(text):
        if text.rstrip().endswith(("�", "\\")):
            return "truncated", None
        if any(w[:1].islower() for w in tokens(text)):
            return None, openings(text)
    return None, None


READ = "response_id long, defect string, openings string, kind string, n long, ends long"


def read(rows: DataFrame) -> DataFrame:
    """One pass over contents: rows of responses with a defect, or with openings to be asked (response_id, defect, openings), and of counts of kinds of openings (kind, n, ends)."""

    kinds = {"response_id": pa.int64(), "defect": pa.string(), "openings": pa.string(), "kind": pa.string(), "n": pa.int64(), "ends": pa.int64()}

    def told(**columns: list) -> pa.RecordBatch:
        size = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns.get(c, [None] * size), k) for c, k in kinds.items()], names=list(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        counts = lambda: told(kind=list(n), n=list(n.values()), ends=[ends[k] for k in n])
        for b in batches:
            prompts, texts = (unify_array(b.column(i))[0].to_pylist() for i in (1, 2))
            for t in b.column(2).to_pylist():
                s = stopped(t)
                for k in openings(t):
                    n[k] += 1
                    ends[k] += s
            judged = [(i, *defect_of(q, t, r)) for i, q, t, r in zip(b.column(0).to_pylist(), prompts, texts, b.column(3).to_pylist())]
            judged = [x for x in judged if x[1] or x[2]]
            yield told(response_id=[i for i, _, _ in judged], defect=[k for _, k, _ in judged], openings=["\n".join(o) if o else None for _, _, o in judged])
            if len(n) > 200_000:  # counts go out in portions; they are summed up afterwards
                yield counts()
                n.clear(), ends.clear()
        if n:
            yield counts()

    return rows.select("response_id", "query", "content", "raw").mapInArrow(run, READ)


def defects(predictions: DataFrame, fields: DataFrame) -> DataFrame:
    """response_id, defect of every unusable response."""
    seen = cut_lineage(read(contents(predictions, fields)))
    rates = seen.where("kind is not null").groupBy("kind").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).where(F.col("n") >= KNOWN_OPENING).select("kind", (F.col("ends") / F.col("n")).alias("rate"))
    # each list of openings once: the longest opening that is known decides
    asked = seen.where("openings is not null").select("openings").distinct()
    kinds = asked.select("openings", F.posexplode(F.split("openings", "\n")).alias("k", "kind"))
    cut = kinds.join(rates, "kind").groupBy("openings").agg(F.min_by("rate", "k").alias("rate")).where("rate >= 0.5").select("openings")
    told = seen.where("defect is not null").select("response_id", "defect")
    return told.unionByName(seen.where("openings is not null").join(cut, "openings", "left_semi").select("response_id", F.lit("truncated").alias("defect")))
