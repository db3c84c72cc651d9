"""Transforms of nested evidence: select, edit, restore, replace answers by counterfactual ones. Row-local, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T

#: Invented words for counterfactual answers.
PSEUDO = ["Maren", "Valeris", "Corwin", "Selora", "Tavian", "Norwyn", "Elara", "Caldren", "Lumeria", "Averon", "Soralis", "Belvar", "Nerissa", "Ordel"]
#: Counterfactual answers by kind.
TYPED = {"PERSON": "Maren Valeris", "LANGUAGE_OR_NATIONALITY": "Lumerian", "LOCATION": "Selora", "ORGANIZATION": "Averon Society", "WORK": "The Lumerian Chronicle"}


def supporting(context: Column) -> Column:
    return F.filter(context, lambda d: F.coalesce(d["is_supporting"], F.lit(False)))


def by_ids(context: Column, ids: Column) -> Column:
    """The documents whose id is in ids, in their order."""
    return F.filter(context, lambda d: F.array_contains(ids, d["document_id"]))


def changed_documents(before: Column, after: Column) -> Column:
    """Ids of documents whose title or text differs at the same position."""
    same = F.zip_with(before, after, lambda a, b: F.struct(F.coalesce(b["document_id"], a["document_id"]).alias("id"), (~a["text"].eqNullSafe(b["text"]) | ~a["title"].eqNullSafe(b["title"])).alias("changed")))
    return F.transform(F.filter(same, lambda x: x["changed"]), lambda x: x["id"])


def map_text(docs: Column, document_id: Column, change) -> Column:
    """docs with change applied to the text of one document."""
    return F.transform(docs, lambda d: F.struct(d["document_id"].alias("document_id"), d["title"].alias("title"), F.when(d["document_id"] == document_id, change(d["text"])).otherwise(d["text"]).alias("text")))


def undo_replacement(docs: Column, edit: Column) -> Column:
    """The removed span put back for its replacement; NULL where the replacement is not found."""
    swapped = map_text(docs, edit["document_id"], lambda t: F.when(edit["replacement_span"] != "", F.replace(t, edit["replacement_span"], edit["original_span"])).otherwise(F.trim(F.concat_ws(" ", t, edit["original_span"]))))
    found = F.exists(docs, lambda d: (d["document_id"] == edit["document_id"]) & F.contains(d["text"], edit["replacement_span"]))
    return F.when(found, swapped)


def undo_addition(docs: Column, edit: Column) -> Column:
    """The appended claim taken away again; NULL where it is not found."""
    found = F.exists(docs, lambda d: (d["document_id"] == edit["document_id"]) & F.contains(d["text"], edit["appended_text"]))
    return F.when(found, map_text(docs, edit["document_id"], lambda t: F.rtrim(F.replace(t, edit["appended_text"], F.lit("")))))


def without_answers(docs: Column, answers: Column) -> Column:
    """docs in which every document that mentions an answer is blank."""
    return T.let(F.transform(answers, T.normal_answer), lambda names: F.transform(
        docs,
        lambda d: F.when(
            T.let(T.normal_answer(F.concat_ws(" ", d["title"], d["text"])), lambda h: F.exists(names, lambda n: T.contains_phrase(h, n))),
            F.struct(d["document_id"].alias("document_id"), F.lit("").alias("title"), F.lit("").alias("text")),
        ).otherwise(F.struct(d["document_id"].alias("document_id"), d["title"].alias("title"), d["text"].alias("text"))),
    ))


def hash_index(seed: Column, offset: Column | int, modulo: int) -> Column:
    """The first eight bytes of a SHA-256 modulo a number, in two halves of 32 bits, so that nothing overflows."""
    digest = F.sha2(F.concat(seed, F.lit(":"), F.lit(offset).cast("string") if isinstance(offset, int) else offset.cast("string")), 256)
    high, low = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 9, 8), 16, 10).cast("long")
    return (((high % modulo) * F.lit((1 << 32) % modulo) + low % modulo) % modulo).cast("int")


def pseudo_words(answer: Column, seed: Column) -> Column:
    """As many invented words as the answer has, without repetition: a taken word gives way to the next free one. At most as many as there are."""
    words = F.array(*[F.lit(w) for w in PSEUDO])
    n = F.least(F.greatest(F.size(F.filter(F.split(T.words_only(T.text(answer)), " "), lambda w: w != "")), F.lit(1)), F.lit(len(PSEUDO)))

    def add(chosen: Column, k: Column) -> Column:
        at = hash_index(seed, k, len(PSEUDO))
        turned = F.concat(F.slice(words, at + 1, F.lit(len(PSEUDO))), F.slice(words, F.lit(1), at))
        return F.array_append(chosen, F.get(F.filter(turned, lambda w: ~F.array_contains(chosen, w)), 0))

    return F.array_join(F.aggregate(F.sequence(F.lit(0), n - 1), F.array().cast("array<string>"), add), " ")


def moved_number(token: Column, date: Column) -> Column:
    """One number changed: thousands and decimals keep their form; in dates years move within two centuries and days within a month."""
    plain = token.rlike(r"^\d+$")
    n = F.when(plain, token.try_cast("decimal(37,0)"))
    whole = F.regexp_extract(token, r"^(\d+)", 1).try_cast("decimal(37,0)")
    return (
        F.when(token.rlike(r"^\d+,\d{3}$"), F.coalesce(F.format_number(F.replace(token, F.lit(","), F.lit("")).try_cast("decimal(37,0)") + 7, 0), token))
        .when(token.rlike(r"[.,]"), F.coalesce(F.concat((whole + 7).cast("string"), F.regexp_extract(token, r"^\d+(.*)$", 1)), token))
        .when(date & n.between(1000, 2099), (F.pmod(n.cast("long") - 1883, F.lit(200)) + 1900).cast("string"))
        .when(date & n.between(1, 31), ((n.cast("long") + 7) % 28 + 1).cast("string"))
        .otherwise(F.coalesce((n + 7).cast("string"), token))
    )


def move_numbers(x: Column, date: Column) -> Column:
    """Every number of a text moved: pieces between numbers, and numbers, are taken apart and woven together again."""
    pattern = r"\d+(?:[.,]\d+)?"
    between = F.split(x, pattern)
    numbers = F.transform(F.regexp_extract_all(x, F.lit(rf"({pattern})"), F.lit(1)), lambda t: moved_number(t, date))
    woven = F.zip_with(between, numbers, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
    return F.array_join(woven, "")


def move_month(x: Column) -> Column:
    """The first month named, five months on."""
    found = F.regexp_extract(x, rf"(?i)\b({'|'.join(T.MONTHS)})\b", 1)
    at = F.array_position(F.array(*[F.lit(m.lower()) for m in T.MONTHS]), F.lower(found)).cast("int")
    target = F.element_at(F.array(*[F.lit(m) for m in T.MONTHS]), (at + 4) % 12 + 1)
    start = F.locate("\u0000", F.regexp_replace(x, rf"(?i)^(.*?)\b({'|'.join(T.MONTHS)})\b", "$1\u0000$2"))
    return F.when(at > 0, F.concat(F.substring(x, F.lit(1), start - 1), target, F.substring(x, start + F.length(found), F.length(x)))).otherwise(x)


def counterfactual_answer(answer: Column, seed: Column, question: Column) -> Column:
    """Another answer of the same kind and form."""
    return T.let(F.trim(T.text(answer)), lambda a: T.let(T.semantic_type(question, a), lambda kind: _other(a, seed, kind)))


def _other(a: Column, seed: Column, kind: Column) -> Column:
    out = F.when(kind == "DATE", move_numbers(move_month(a), F.lit(True))).when(kind == "NUMBER", move_numbers(a, F.lit(False)))
    for k, v in TYPED.items():
        out = out.when(kind == k, v)
    letters = F.array_join(F.transform(F.sequence(F.lit(0), F.least(F.greatest(F.length(F.regexp_replace(a, r"[^\p{L}\p{N}_]", "")), F.lit(2)), F.lit(8)) - 1), lambda i: F.char(hash_index(seed, i, 26) + 65)), "")
    acronym = (F.upper(a) == a) & a.rlike(r"\p{L}") & ~T.words_only(a).contains(" ")
    return F.when(a != "", out.when(acronym, letters).otherwise(pseudo_words(a, seed)))


def quoted(x: Column) -> Column:
    """A text as a literal pattern."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def replace_answers(x: Column, answers: Column, new: Column) -> Column:
    """Every answer in a text replaced, longest first, at word boundaries, whatever its case."""
    ordered = F.array_sort(F.filter(answers, lambda a: F.trim(a) != ""), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    safe = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return F.aggregate(ordered, x, lambda t, a: F.regexp_replace(t, F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])"), quoted(a), F.lit(r"(?![\p{L}\p{N}_])")), safe))


def counterfactual_evidence(docs: Column, answers: Column, new: Column) -> Column:
    return T.let(new, lambda n: _replaced(docs, answers, n))


def _replaced(docs: Column, answers: Column, new: Column) -> Column:
    return F.transform(docs, lambda d: F.struct(d["document_id"].alias("document_id"), replace_answers(T.text(d["title"]), answers, new).alias("title"), replace_answers(T.text(d["text"]), answers, new).alias("text")))


def counterfactual_error(before: Column, after: Column, answers: Column, new: Column) -> Column:
    """Why a counterfactual evidence is unusable; NULL if it is usable."""
    joined = T.normal_answer(T.render_evidence(after))
    return (
        F.when(T.render_evidence(before) == T.render_evidence(after), "NOTHING_REPLACED")
        .when(T.contains_any(joined, answers, T.normal_answer), "ANSWER_REMAINS")
        .when(~T.contains_phrase(joined, T.normal_answer(new)), "NEW_ANSWER_ABSENT")
    )


def shifted_last_number(x: Column) -> Column:
    """The last year three on, else the last number seven on; the first place where it is written is replaced. NULL without a number, or for one beyond 37 figures."""
    years = F.regexp_extract_all(x, F.lit(r"\b(1[0-9]{3}|20[0-9]{2})\b"), F.lit(1))
    numbers = F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1))
    year, number = F.try_element_at(years, F.lit(-1)), F.try_element_at(numbers, F.lit(-1))
    old = F.coalesce(year, number)
    new = F.when(year.isNotNull(), (year.cast("long") + 3).cast("string")).otherwise((number.try_cast("decimal(37,0)") + 7).cast("string"))
    at = F.position(old, x)
    return F.when(new.isNotNull(), F.concat(F.substring(x, F.lit(1), at - 1), new, F.substring(x, at + F.length(old), F.length(x))))
