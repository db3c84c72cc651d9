"""Scalar text functions, Column to Column, inside the JVM.

Letters are compared by full case folding, phrases and answers also in compatibility composition (NFKC). Both are static methods of the ICU library
that Spark ships for its collations; only texts beyond ASCII are handed to it. Spark takes a method called by reflection for nondeterministic: such
columns are projected before they are grouped by, aggregated or joined on. NULL gives NULL unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

#: Function words left out of content words.
CONTENT_STOP = "a an the of to in on for and or is was were be been being this that these those it its his her their with as at by from which who whom what when where how did does do not no".split()
#: Words that say nothing of a slot.
SLOT_STOP = "a an the of to in on at for and or is was were are be being that which who what when where whether information identity name exact".split()
#: Relation tags and the words that express them.
RELATIONS = {
    "direct": ["director", "directed", "directs"], "own": ["owner", "owned", "owns", "ownership"], "release": ["release", "released"], "form": ["formed", "formation"],
    "found": ["founded", "founder"], "locate": ["located", "location"], "seat": ["seat"], "birth": ["born", "birth"], "death": ["died", "death"], "population": ["population"],
    "date": ["date"], "year": ["year"], "member": ["member", "membership"], "captain": ["captain", "captained"], "headquarters": ["headquarters", "headquartered"],
    "employ": ["employ", "employed", "employer"], "publish": ["publisher", "published"], "sibling": ["sibling"], "minister": ["minister"], "origin": ["origin"],
}
#: Signs that an answer was declined.
ABSTAIN = ["cannot answer", "can't answer", "insufficient", "not enough information", "无法回答", "信息不足", "无法确定"]
#: Names of months.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

#: Words of questions that ask for a person.
PERSON_WORDS = ["who", "whom", "whose"]
#: Phrases of questions that ask for other kinds, in the order in which they are tried.
QUESTION_PHRASES = {
    "LANGUAGE_OR_NATIONALITY": ["language", "nationality"],
    "LOCATION": ["which country", "what country", "which city", "what city", "where ", " location", "which place", "what place"],
    "ORGANIZATION": ["political party", "organization", "organisation", "association", "community", "company", "institution", "university"],
    "WORK": ["film", "movie", "album", "book", "novel", "song", "television", "show", "series", "game"],
}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column | str, body) -> Column:
    """body of a value that is computed once, however often body names it; inside lambdas the optimizer would repeat it."""
    return F.get(F.transform(F.array(_c(value)), body), 0)


def text(x: Column | str) -> Column:
    """NULL as the empty text."""
    return F.coalesce(_c(x), F.lit(""))


def _icu(kind: str, method: str, x: Column) -> Column:
    return F.call_function("java_method", F.lit(f"com.ibm.icu.{kind}"), F.lit(method), x, F.lit(True))


def fold(x: Column | str) -> Column:
    """Full case folding; NULL as the empty text."""
    return let(text(x), lambda v: F.when(v.rlike(r"[^\x00-\x7f]"), _icu("lang.UCharacter", "foldCase", v)).otherwise(F.lower(v)))


def compat_fold(x: Column | str) -> Column:
    """Compatibility composition, then full case folding; NULL as the empty text."""
    folded = lambda v: _icu("lang.UCharacter", "foldCase", _icu("text.Normalizer", "compose", v))
    return let(text(x), lambda v: F.when(v.rlike(r"[^\x00-\x7f]"), folded(v)).otherwise(F.lower(v)))


def words_only(folded: Column | str) -> Column:
    """Everything but letters, figures and the underscore as single blanks."""
    return F.trim(F.regexp_replace(_c(folded), r"[^\p{L}\p{N}_]+", " "))


def normal(x: Column | str) -> Column:
    """For phrases: case, compatibility forms, punctuation and spacing levelled; articles and underscores stay."""
    return words_only(compat_fold(x))


def normal_answer(x: Column | str) -> Column:
    """For answers: also commas between figures and apostrophes dropped, signs as blanks, articles dropped."""
    t = F.regexp_replace(F.regexp_replace(compat_fold(x), r"(\d),(?=\d)", "$1"), "['’]", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[\p{P}\p{S}]", " "), r"[\s\p{Z}]+", " "))
    return F.array_join(F.filter(F.split(t, " "), lambda w: ~w.isin("a", "an", "the", "")), " ")


def normal_plain(x: Column | str) -> Column:
    """For model answers: punctuation, spacing and underscores levelled; articles stay."""
    return F.trim(F.regexp_replace(fold(x), r"[^\p{L}\p{N}]+", " "))


def contains_phrase(normal_text: Column | str, normal_phrase: Column | str) -> Column:
    """Whether a normalised phrase stands in a normalised text, at word boundaries; false if either is empty."""
    h, n = _c(normal_text), _c(normal_phrase)
    return (n != "") & (h != "") & F.contains(F.concat(F.lit(" "), h, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))


def contains_any(normal_text: Column | str, answers: Column | str, norm=normal) -> Column:
    return F.coalesce(let(normal_text, lambda h: F.exists(F.transform(_c(answers), norm), lambda n: contains_phrase(h, n))), F.lit(False))


def distinct_by(values: Column | str, norm=normal) -> Column:
    """The first spelling of each normal form, in order; empty forms left out."""
    v = _c(values)
    return let(F.transform(v, norm), lambda keys: F.filter(v, lambda a, i: (F.get(keys, i) != "") & (F.array_position(keys, F.get(keys, i)) == i + 1)))


def too_long(x: Column | str, chars: int = 80, tokens: int = 12) -> Column:
    t = text(x)
    return (F.length(t) > chars) | (F.size(F.filter(F.split(t, r"[\s\p{Z}]+"), lambda w: w != "")) > tokens)


def answer_type(x: Column | str) -> Column:
    t = text(x)
    return (
        F.when(F.trim(t).rlike(r"^\d+([.,]\d+)?$"), "number")
        .when(t.rlike(r"(^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2})([^\p{L}\p{N}_]|$)"), "date_or_year")
        .when(F.size(F.filter(F.split(normal(t), " "), lambda w: w != "")) <= 6, "short_entity")
        .otherwise("short_text")
    )


def squeeze(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(x), r"[\s\p{Z}]+", " "))


def sentences(x: Column | str) -> Column:
    """Sentences of a text: a stop, a blank, and a capital or figure, perhaps after an opening sign."""
    return F.filter(F.split(squeeze(x), r"(?<=[.!?]) +(?=[\"'(\[]?[A-Z0-9])"), lambda s: s != "")


def sentence_count(x: Column | str) -> Column:
    """Pieces at every blank behind a stop."""
    return F.size(F.filter(F.split(squeeze(x), r"(?<=[.!?]) +"), lambda s: s != ""))


def repeats_sentence(x: Column | str) -> Column:
    """Whether a sentence of four words and more comes twice."""
    s = F.transform(F.split(squeeze(x), r"(?<=[.!?]) +"), lambda p: F.trim(F.regexp_replace(fold(p), r"[^0-9a-zÀ-ž]+", " ")))
    long = F.filter(s, lambda p: F.size(F.split(p, " ")) >= 4)
    return F.size(long) > F.size(F.array_distinct(long))


def title_of(x: Column | str) -> Column:
    return F.trim(F.regexp_extract(text(x), r"(?is)^\s*title:[ \t]*([^\n]*)\n+(.*)$", 1))


def body_of(x: Column | str) -> Column:
    return F.when(text(x).rlike(r"(?is)^\s*title:[ \t]*[^\n]*\n+.*$"), F.trim(F.regexp_extract(text(x), r"(?is)^\s*title:[ \t]*([^\n]*)\n+(.*)$", 2))).otherwise(text(x))


def references(x: Column | str) -> Column:
    """The distinct numbers of #n marks, ascending; numbers beyond 38 figures are none."""
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.regexp_extract_all(text(x), F.lit(r"#(\d+)"), F.lit(1)), lambda n: n.try_cast("decimal(38,0)")))))


def content_words(x: Column | str, stop: list[str] = CONTENT_STOP) -> Column:
    return F.array_except(F.array_distinct(F.filter(F.split(normal_plain(x), " "), lambda w: w != "")), F.array(*[F.lit(s) for s in stop]))


def relation_tags(x: Column | str) -> Column:
    """Relations a text names, in alphabetical order."""
    have = F.split(F.regexp_replace(F.lower(text(x)), r"[^0-9a-zÀ-ž]+", " "), " ")
    known = {w: tag for tag, words in RELATIONS.items() for w in words}
    tag_of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    named = F.array_intersect(have, F.array(*[F.lit(w) for w in known]))
    return F.array_sort(F.array_distinct(F.transform(named, lambda w: F.element_at(tag_of, w))))


def gapped_mention(normal_text: Column | str, normal_name: Column | str, gap: int = 2) -> Column:
    """Whether the words of a name follow each other in a text with at most gap words between; each word is looked for at its first place, without going back."""

    def follow(hay: Column, name: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

        def step(state: Column, word: Column) -> Column:
            rest = F.array_position(F.slice(hay, state["at"] + 1, F.greatest(F.size(hay) - state["at"], F.lit(0))), word).cast("int")
            ok = state["ok"] & (rest > 0) & ((state["at"] == 0) | (rest - 1 <= gap))
            return F.struct((state["at"] + rest).alias("at"), ok.alias("ok"))

        return (F.size(name) >= 2) & F.aggregate(name, start, step, lambda s: s["ok"])

    return let(F.split(_c(normal_text), " "), lambda hay: let(F.split(_c(normal_name), " "), lambda name: follow(hay, name)))


def unfence(x: Column | str) -> Column:
    """The inside of a fenced block, else the text; trimmed."""
    t = F.regexp_replace(text(x), r"^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"(?i)^```[ \t\r\n]*(?:json|text)?\s*", ""), r"\s*```$", "")).otherwise(t)


def is_json_object(x: Column) -> Column:
    """Whether a text is one JSON object and nothing behind it: as the first of two values of a list, since the parser stops at the end of a value."""
    both = F.try_parse_json(F.concat(F.lit("["), x, F.lit(",1]")))
    return F.coalesce(F.ltrim(x).startswith("{") & (F.try_variant_get(both, "$[1]", "int") == 1), F.lit(False))


def json_object(x: Column | str) -> Column:
    """A JSON object as text: strictly, else from the first brace to the last; NULL if neither parses."""
    t = unfence(x)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    whole = F.when(is_json_object(t), t)
    return F.coalesce(whole, F.when(is_json_object(inner), inner))


def predicted_answer(x: Column | str) -> Column:
    """The field answer of a JSON object, else the first line that is not blank without its label and quotation marks."""
    t = unfence(x)
    field = F.trim(F.get_json_object(t, "$.answer"))
    line = F.coalesce(F.get(F.filter(F.transform(F.split(text(x), r"[\r\n]"), lambda s: F.trim(s)), lambda s: s != ""), 0), F.lit(""))
    line = F.regexp_replace(line, r"(?i)^(?:answer|final answer|答案)\s*[:：]\s*", "")
    return F.coalesce(F.when(is_json_object(t), field), F.regexp_replace(F.trim(line), r'^"+|"+$', ""))


def action(x: Column | str) -> Column:
    """Canonical action; NULL for others."""
    a = F.upper(F.trim(text(x)))
    a = F.when(a == "REQUEST_CONFLICT_RESOLUTION", "REQUEST_CONFIRMATION").otherwise(a)
    return F.when(a.isin("ANSWER", "REQUEST_INFORMATION", "REQUEST_CONFIRMATION"), a)


def role(x: Column | str) -> Column:
    """Canonical role; NULL for others."""
    r = F.lower(F.trim(text(x)))
    return F.when(r.isin("assistant", "model"), "assistant").when(r.isin("user", "human"), "user").when(r == "system", "system")


def abstains(x: Column | str) -> Column:
    t = F.lower(text(x))
    out = F.lit(False)
    for sign in ABSTAIN:
        out = out | F.contains(t, F.lit(sign))
    return out


def render_evidence(docs: Column | str) -> Column:
    """[Document i] title, newline, text; blank lines between."""
    return F.array_join(F.transform(_c(docs), lambda d, i: F.concat(F.lit("[Document "), (i + 1).cast("string"), F.lit("] "), text(d["title"]), F.lit("\n"), text(d["text"]))), "\n\n")


def compact_evidence(docs: Column | str) -> Column:
    return F.transform(_c(docs), lambda d: F.struct(d["document_id"].alias("document_id"), d["title"].alias("title"), d["text"].alias("text")))


def json_text(x: Column) -> Column:
    """A text as JSON writes it, in quotation marks."""
    return let(F.to_json(F.array(x)), lambda j: F.substring(j, F.lit(2), F.length(j) - 2))


def canonical_json(x: Column, kind: t.DataType) -> Column:
    """A value of a nested type as compact JSON with the keys in order at every level; NULL fields stay, as null."""
    if isinstance(kind, t.StructType):
        fields = [F.concat(F.lit(f'"{f.name}":'), canonical_json(x[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, t.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: canonical_json(v, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, t.StringType):
        out = json_text(x)
    else:
        out = x.cast("string")
    return F.coalesce(F.when(x.isNotNull(), out), F.lit("null"))


def request_hash(x: Column, kind: t.StructType) -> Column:
    """SHA-256 of the canonical JSON of a request."""
    return F.sha2(canonical_json(x, kind), 256)


def semantic_type(question: Column | str, answer: Column | str) -> Column:
    """What kind of thing an answer is, from its form and the question's words; the first kind that fits."""

    def of(q: Column, a: Column) -> Column:
        words, named = F.split(q, " "), lambda w: F.contains(q, F.lit(w))
        dated = a.rlike(r"(^|[^\p{L}\p{N}_])(1[0-9]{3}|20[0-9]{2})([^\p{L}\p{N}_]|$)") | F.lower(a).rlike("|".join(m.lower() for m in MONTHS))
        signs = {"DATE": dated, "NUMBER": F.trim(a).rlike(r"^[+-]?\d[\d.,]*(\s*%|\s+[A-Za-z]+)?$"), "PERSON": F.arrays_overlap(words, F.array(*[F.lit(w) for w in PERSON_WORDS]))}
        signs |= {kind: F.exists(F.array(*[F.lit(p) for p in phrases]), named) for kind, phrases in QUESTION_PHRASES.items()}
        signs |= {"BOOLEAN": normal_answer(a).isin("yes", "no")}
        out = F.lit("OTHER")
        for kind, sign in reversed(signs.items()):
            out = F.when(sign, F.lit(kind)).otherwise(out)
        return out

    return let(normal_answer(question), lambda q: let(text(answer), lambda a: of(q, a)))
