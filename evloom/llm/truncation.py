"""Texts that were cut off (problem 1).

Each text is first read for how it ends: what was put behind a cut (dots, a broken character, a note such as [truncated]) is taken off, then a JSON text is
closed if it ends outside strings with all brackets matched, and prose, also the prose of the last string of a JSON text, if its last sentence has an end.
A closed text is complete; all others are suspects.

Near-copies by min-hash banding: a text stands in buckets by windows from its beginning, of 8, 16, 32 ... words by all their words, and of 24, 48, 96 ... words by
the min-hash of their five-word shingles. A suspect stands in the buckets of its longest windows only, so that also a text that lost most of itself meets
its original. Within a bucket texts are in the order of the words behind the window: of all texts of a bucket the one that follows a suspect goes on like it
the longest, so one neighbour stands for all members, and no pairs are formed within a bucket, however many texts share it; buckets are cut by ranges
of that order. The pair is aligned word by word (longest common subsequence, bit-parallel, whole texts): a suspect of which 0.8 of the shingles stand in its
neighbour, and whose alignment runs to its end before the neighbour's, was cut (copy), unless nothing but a stop is what it lacks.

A suspect whose neighbours do not tell is held against all texts, exactly: of the n shingles of a suspect 0.8 n stand in its copy, so of any 0.2 n + 1 at
least one does; the rarest are taken (as suspects have them), and texts that hold one of them and, by 256 bits of their shingles, may hold 0.8 of all and, by 256 bits of
their words, the suspect's last whole word before their end, are aligned. Where only the cut texts are asked for and not what tells them (cut_texts), suspects
that a sign tells (below) are cut with or without a copy, and are held against nothing.

Suspects without such a copy are scored by terminality: JSON by its brackets, marks behind the end (structure); prose by its closing word, by how often, over all
prose, that word ends a sentence: one that does nine tenths of the times closes the text, a lower-case one that next to never does leaves it cut, sentences before it
decide where the word is rare; error messages by whether messages with the same opening words ever end with a stop (a tenth of them), over all messages (closing).

NULL and empty texts, and NULL attempts, are no case; a delivery that comes twice counts twice; a text that is invalid JSON but
ends with its last bracket is complete; a short answer without stop is complete. Equal texts get equal results; texts have no bound in length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .codepoints import pieces
from .words import mixed, shingles, span_hashes, text_keys, words

#: What is put behind a cut, one at a time.
MARK = r"(?:\.\.\.|…|�+|\\+(?:u[0-9a-fA-F]{0,3})?|<[a-z_ ]{2,20}>|\[[a-zA-Z_ ]{2,30}\]|\((?:[a-z]+ )*(?:limit|truncated|cut|length|reached|omitted)(?: [a-z]+)*\))$"
SIMILARITY = 0.8
#: How often a word must stand in prose before it tells how texts end.
KNOWN_WORD = 20
#: Words of a text that is compared with others, its last one aside.
LEAST = 8
#: Places of a suspect: those of its longest windows, two by all words and two by min-hash. What they miss is found by shingles.
OWN = 4
#: Most bits that tell which shingles or texts are asked for: a log to base 2; 16 MB.
ASKED = 27
#: Multipliers of the min-hashes, each a band of its own: a suspect is held against one neighbour per bucket, so buckets need not be small.
BANDS = (np.uint64(0x9E3779B97F4A7C15),)


def attempt_texts(calls: DataFrame) -> DataFrame:
    """delivery_id, attempt, field, text, dataset, provider of every non-empty raw_response and api_error."""
    rows = calls.select("delivery_id", "dataset", "provider", F.explode("attempts").alias("a")).where("a is not null")
    texts = F.array(F.struct(F.lit("raw_response").alias("field"), F.col("a.raw_response").alias("text")), F.struct(F.lit("api_error").alias("field"), F.col("a.api_error").alias("text")))
    return rows.select("delivery_id", "dataset", "provider", F.col("a.attempt").alias("attempt"), F.explode(texts).alias("t")).select("delivery_id", "attempt", "t.field", "t.text", "dataset", "provider").where("text <> ''")


_MARK = re.compile(MARK)
_JSON = re.compile(r'^[\s`]*(?:json)?\s*[\{\[]|^[^"{\[]*[\{\[]\s*(?:"[^"]{1,60}"\s*:|\{|"|$)|^\s*"[^"]{1,60}":? ')
_HEADLESS = re.compile(r'^\s*"[^"]{1,60}"')
_ESCAPES, _STRINGS = re.compile(r"\\.", re.DOTALL), re.compile(r'"[^"]*"')
_CLOSERS = "\"'”’»)]"
_STOPS = ".!?。！？"
_BREAK = re.compile(r"[.!?] +(?=[^\W\d_a-zß-ÿ])")
_BEGUN = re.compile(r"^[A-ZÀ-Þ]\w* [a-zß-ÿ]+(?: |$)")
_AROUND = " \t\r\n.,:;!?。！？()[]{}<>*`\"'“”„‘’«»…"
_KIND = re.compile(r"\s*(\S+\s*\S*)")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")


def unmarked(text: str) -> tuple[str, bool]:
    """(text without what was put behind a cut and without white space and fences at its end, whether there was anything)."""
    end, found = len(text), False
    while True:
        end = len(text[:end].rstrip())
        start = max(0, end - 40)
        if text[end - 1 : end] == ")":
            start = max(0, text.rfind("(", 0, end))
        elif text[end - 1 : end] in ("�", "\\"):
            start = len(text[:end].rstrip(text[end - 1]))
        m = _MARK.search(text, start, end)
        if not m:
            return (text[:end] if found else text[:end].rstrip(" \t\r\n`")), found
        end, found = m.start(), True


def stopped(body: str) -> bool:
    return body.rstrip(_CLOSERS)[-1:] in _STOPS and bool(body.rstrip(_CLOSERS))


def _has_sentence(text: str) -> bool:
    """Whether a sentence ends before the end of the text; a stop behind fewer than three letters is an abbreviation's."""
    for m in _BREAK.finditer(text):
        before = text[max(0, m.start() - 12) : m.start()].rstrip("\"'”’)%")
        if len(before) >= 3 and before[-3:].isalnum():
            return True
    return False


def last_string(body: str) -> str | None:
    """The string value that a closed JSON text ends with; None if it ends otherwise."""
    t = body.rstrip("]} \t\r\n")
    if len(t) < 2 or t[-1] != '"':
        return None
    at = t.rfind('"', 0, -1)
    while at > 0 and t[at - 1] == "\\":
        at = t.rfind('"', 0, at)
    return t[at + 1 : -1] if at >= 0 and t[:at].rstrip().endswith((":", "[", ",")) else None


def judge(text: str, field: str) -> tuple[str, str]:
    """(how a text ends, its part whose closing word tells).

    closed, open (cut in a JSON text, or a mark stands behind), prose (no final stop after sentences) or loose (no stop, and nothing that asks for one).
    """
    body, marked = unmarked(text)
    if _JSON.match(text):
        bare = _STRINGS.sub("", _ESCAPES.sub("", body))
        shut = body[-1:] in ("]", "}") and (body.rstrip("]}").rstrip()[-1:] in ('"', "_") or body.rstrip("]}").rstrip()[-1:].isalnum() or body[-2:-1] in ("]", "}"))
        if '"' in bare and not shut:  # an unescaped quotation mark within makes the text invalid, not cut
            return "open", ""
        depth = bare.count("{") + bare.count("[") - bare.count("}") - bare.count("]") + bool(_HEADLESS.match(text))
        if depth > 0 or body.endswith((":", ",")):
            return "open", ""
        value = re.sub(r"(?:\\[nrt]|\s)+$", "", last_string(body) or "")
        # brackets may have been put behind a cut as well: then the last string is prose that breaks off
        if not stopped(value.rstrip()) and sum(w[:1].islower() for w in value.split()) >= 3 and not value.rstrip().endswith((")", "]")):
            return "prose", value
        return "closed", ""
    if marked:
        return "open", ""
    if stopped(body):
        return "closed", ""
    return ("prose" if field == "raw_response" and (_has_sentence(body) or _BEGUN.match(body)) else "loose"), body


def ending(text: str, field: str) -> str:
    return judge(text, field)[0]


def opening(text: str) -> str:
    """The first two words of a message, figures masked: the kind of message."""
    m = _KIND.match(text)
    return re.sub(r"\d+", "9", m[1]) if m else ""


def normal(text: str, suspect: bool) -> str:
    """A text as it is compared: JSON from its beginning on, whatever fence or words stand before it, escaped letters as letters, without marks."""
    t = unmarked(text)[0] if suspect else text
    if _JSON.match(t) and not _HEADLESS.match(t):
        at = min((i for i in (t.find("{"), t.find("[")) if i >= 0), default=0)
        t = t[at:]
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), t) if "\\u" in t else t


def buckets(hashes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window length, key) of the windows of texts, of which the first so many words count: by all words, and by the min-hash of their shingles. No work per text."""
    rows, lengths, keys = [], [], []
    length, exact = LEAST, True
    with np.errstate(over="ignore"):
        end = np.minimum(np.arange(len(hashes)) + 5, len(hashes))
        sh = span_hashes(hashes, np.arange(len(hashes)), end)
        bands = [(sh * odd) >> np.uint64(16) for odd in BANDS]
        while len(at := np.flatnonzero(sizes >= length)):
            start = offsets[at]
            if exact:
                found = [span_hashes(hashes, start, start + length)]
            else:
                step = max(1, (1 << 22) // length)  # texts at once
                found = [mixed(np.concatenate([low[start[i : i + step, None] + np.arange(length - 4)].min(1) for i in range(0, len(at), step)]) + odd) for low, odd in zip(bands, BANDS)]
            for k in found:
                rows.append(at)
                lengths.append(np.full(len(at), length))
                keys.append((k ^ np.uint64(length)).view(np.int64))
            # by all words: 8, 16, 32 ...; by min-hash: 24, 48, 96 ...
            length, exact = (length * 3 // 2, False) if exact and length > LEAST else (length * 2, True) if exact else (length * 4 // 3, True)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(lengths), np.concatenate(keys)


def _tails(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Words as bytes whose order puts a text right before those that go on like it."""
    size = np.maximum(end - start, 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], size) + np.repeat(start, size)
    raw = (hashes[at] >> np.uint64(32)).astype(">u4").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((ends * 4).astype(np.int32).tobytes()), pa.py_buffer(raw)])


def distinct_shingles(hashes: np.ndarray, offsets: np.ndarray, without: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of all texts, without repetition and in order; so many last words aside."""
    sh, ends = shingles(hashes, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(ends))
    if without:
        inside = np.arange(len(sh)) < ends[1:][row] - without
        row, sh = row[inside], sh[inside]
    order = np.lexsort((sh, row))
    row, sh = row[order], sh[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sh[1:] != sh[:-1])
    return row[new], sh[new]


def sketches(row: np.ndarray, sh: np.ndarray, n: int) -> np.ndarray:
    """n x 4 longs: 256 bits of the shingles (or words) of each text."""
    held = np.zeros((n, 256), bool)
    held[row, ((sh >> np.uint64(8)) & np.uint64(255)).astype(np.int64)] = True
    return np.packbits(held, axis=1, bitorder="little").view(np.int64).reshape(n, 4)


SEEN = "delivery_id long, attempt int, field string, dataset string, provider string, ending string, kind string, last string, inner boolean, tid binary, own array<struct<key:long,tail:binary>>, grams array<long>, bits array<long>"
_OWN = pa.list_(pa.struct([("key", pa.int64()), ("tail", pa.binary())]))


def read(texts: DataFrame) -> DataFrame:
    """texts without the text: its ending, the kind of an error message, the closing word of prose without stop and whether it begins in lower case; of suspects a hash of their words, their places in the buckets of their longest windows, their shingles, and the bits of these with the bit of the last whole word. One pass."""
    names = [c.split()[0] for c in SEEN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 5):
            raw, fields = b.column(5).to_pylist(), b.column(2).to_pylist()
            how = [judge(t, f) for t, f in zip(raw, fields)]
            kind = [opening(t) if f == "api_error" else None for t, f in zip(raw, fields)]
            last = [t.rsplit(None, 1)[-1] if f == "raw_response" and h in ("loose", "prose") and t and not t.isspace() else None for (h, t), f in zip(how, fields)]
            inner = [t is not None and t.strip(_AROUND)[:1].islower() for t in last]
            last = [None if t is None else last_word(t) for t in last]
            tid: list = [None] * len(raw)
            own, grams, bits = ([None] * len(raw) for _ in range(3))
            at = [i for i, (h, _) in enumerate(how) if h != "closed"]
            hashes, offsets = words(pa.array([normal(raw[i], True) for i in at], pa.string()), unified=True)
            sizes = np.diff(offsets) - 1  # the last word may be broken
            which, length, key = buckets(hashes, offsets, sizes)
            tails = _tails(hashes, offsets[which] + length, offsets[which] + np.minimum(sizes[which], 2 * length)).to_pylist()
            for k, z, x in zip(which.tolist(), key.tolist(), tails):
                own[at[k]] = [*(own[at[k]] or []), {"key": z, "tail": x}]
            ids = text_keys(hashes, offsets).to_pylist()
            row, sh = distinct_shingles(hashes, offsets, 1)
            ends = np.searchsorted(row, np.arange(len(at) + 1))
            held = sketches(row, sh, len(at))
            for k, i in enumerate(at):
                if own[i]:
                    own[i], tid[i] = own[i][-OWN:], ids[k]
                    grams[i], bits[i] = sh[ends[k] : ends[k + 1]].view(np.int64), [*held[k].tolist(), int(hashes[offsets[k + 1] - 2] >> np.uint64(8)) & 255]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([h for h, _ in how], pa.string()), pa.array(kind, pa.string()), pa.array(last, pa.string()), pa.array(inner, pa.bool_()), pa.array(tid, pa.binary()), pa.array(own, _OWN), pa.array(grams, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=names)

    return texts.select(*names[:5], "text").mapInArrow(run, SEEN)


def places(texts: DataFrame, wanted) -> DataFrame:
    """key, tail, at (delivery_id, and attempt and field in one number) of every text in the bucket of each of its windows that is among the wanted ones; the tail is as long as the window, which is all that a suspect of this bucket can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 3):
            raw, fields = b.column(3).to_pylist(), b.column(2).to_pylist()
            suspect = [judge(t, f)[0] != "closed" for t, f in zip(raw, fields)]
            hashes, offsets = words(pa.array([normal(t, s) for t, s in zip(raw, suspect)], pa.string()), unified=True)
            sizes = np.diff(offsets) - np.array(suspect, np.int64)
            which, length, key = buckets(hashes, offsets, sizes)
            # a suspect goes on like another one within its longest windows; in shorter ones it would only meet itself
            keep = (~np.array(suspect, bool)[which] | (sizes[which] < 2 * length)) & is_asked(key.view(np.uint64), *wanted.value)
            which, length, key = which[keep], length[keep], key[keep]
            start = offsets[which] + length
            end = offsets[which] + np.minimum(sizes[which], 2 * length + 1)
            # of texts of a batch that go on alike one is enough
            alike = mixed(key.view(np.uint64) ^ span_hashes(hashes, start, end))
            _, first = np.unique(alike, return_index=True)
            rows = pa.array(which[first])
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), _tails(hashes, start[first], end[first]), *[b.column(c).take(rows) for c in range(2)]], names=["key", "tail", "d", "n"])

    found = texts.select(*where(), "field", "text").mapInArrow(run, "key long, tail binary, d long, n long")
    return found.select("key", "tail", F.struct("d", "n").alias("at"))


def where() -> list[Column]:
    """A text's delivery, and its attempt and field in one number."""
    return [F.col("delivery_id").alias("d"), (F.coalesce(F.col("attempt").cast("long"), F.lit(1 << 40)) * 2 + (F.col("field") == "api_error").cast("long")).alias("n")]


def last_word(token: str) -> str:
    """A word as closing words are counted: lower case, without the signs around it; all figures are one word."""
    w = token.strip(_AROUND).lower()
    return "9" if w and not w.strip("0123456789.,:/-–%") else w


def closing_words(texts: DataFrame) -> DataFrame:
    """last, last_n, last_rate: how often each word stands in a prose raw_response, and the part of it that ends a sentence or text with a stop. Counted over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        ends: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"last": pa.array(list(n), pa.string()), "n": pa.array(list(n.values()), pa.int64()), "ends": pa.array([ends[w] for w in n], pa.int64())})

        for b in batches:
            for text in b.column(0).to_pylist():
                if _JSON.match(text):
                    continue
                tokens = unmarked(text)[0].split()
                for k, token in enumerate(tokens):
                    stop = stopped(token)
                    if k + 1 < len(tokens) or stop:  # how a text ends that lacks a stop is what is asked
                        w = last_word(token)
                        n[w] += 1
                        ends[w] += stop
            if len(n) > 200_000:
                yield told()
                n.clear(), ends.clear()
        if n:
            yield told()

    counts = texts.where("field = 'raw_response'").select("text").mapInArrow(run, "last string, n long, ends long")
    return counts.groupBy("last").agg(F.sum("n").alias("last_n"), (F.sum("ends") / F.sum("n")).alias("last_rate"))


def stops(errors: DataFrame, kind: str) -> DataFrame:
    """Each kind of error messages, how many there are, and the part that ends with a stop; partial aggregation keeps hot kinds small."""
    return errors.groupBy(kind).agg(F.avg((F.col("ending") == "closed").cast("int")).alias(f"{kind}_rate"), F.count(F.lit(1)).alias(f"{kind}_n")).where(F.col(kind).isNotNull())


def ends_early(cut: list, whole: list) -> bool:
    """Whether the word-by-word alignment of cut (without its last word, which may be broken) with whole runs to the end of cut, and stops before the end of whole.

    Longest common subsequence, a row of the table in one long integer: it also tells the shortest beginnings of both that already have the whole of it.
    """
    n = 0
    while n < min(len(cut), len(whole)) and cut[n] == whole[n]:
        n += 1
    cut, whole = cut[n:], whole[n:]
    if not cut:
        return bool(whole)
    where: dict = {}
    for i, x in enumerate(cut):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(cut)) - 1
    row, reached = full, 0
    for j, y in enumerate(whole, 1):
        m = where.get(y, 0)
        if m:
            u = row & m
            new = (row + u | row - u) & full
            if new.bit_count() != row.bit_count():
                reached = j
            row = new
    ended = (full ^ row).bit_length()  # the last word of cut that a longest alignment needs
    return ended == len(cut) and len(whole) > reached


def lacks_only_a_stop(cut: str, whole: str) -> bool:
    """Whether a sentence of whole ends with the last words of cut."""
    tail = " ".join(cut.split()[-3:])
    stop = f"[{re.escape(_CLOSERS)}]*[{re.escape(_STOPS)}]" + r"(?:\s|$)"
    return bool(tail) and bool(re.search(re.escape(tail) + stop, " ".join(whole.split())))


def neighbours(rows: DataFrame) -> DataFrame:
    """key, tail, at2 of every own row that another row of its bucket goes on like: the one that follows it in the order of tails.

    rows: key, tail, own, at, distinct by key and tail. The order is cut into ranges, one task each; the last own row of a range is followed by the
    first row of the next one, out of a table of two rows per range.
    """
    at = pa.struct([("d", pa.int64()), ("n", pa.int64())])
    names = ["part", "edge", "key", "tail", "at2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, first = TaskContext.get().partitionId(), None, True
        for b in batches:
            out: list[tuple] = []
            for key, tail, own, where in zip(*(b.column(c).to_pylist() for c in range(4))):
                if first:
                    out.append((part, "first", key, tail, where))
                    first = False
                if waiting and waiting[0] == key and len(tail) > len(waiting[1]) and tail.startswith(waiting[1]):
                    out.append((None, None, *waiting, where))
                waiting = (key, tail) if own else None
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.string(), pa.int64(), pa.binary(), at))], names=names)
        if waiting:
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((part, "last", *waiting, None), (pa.int32(), pa.string(), pa.int64(), pa.binary(), at))], names=names)

    ordered = rows.select("key", "tail", "own", "at").repartitionByRange("key", "tail").sortWithinPartitions("key", "tail")
    told = cut_lineage(ordered.mapInArrow(run, "part int, edge string, key long, tail binary, at2 struct<d:long,n:long>"))
    last = told.where("edge = 'last'").select("part", "key", "tail")
    first = told.where("edge = 'first'").select(F.col("part").alias("p"), F.col("key").alias("k"), F.col("tail").alias("t"), "at2")
    after = last.join(first, last["key"] == first["k"]).where("p > part").groupBy("key", "tail").agg(F.min_by(F.struct("t", "at2"), "p").alias("x"))
    after = after.where((F.length("x.t") > F.length("tail")) & F.startswith(F.col("x.t"), F.col("tail"))).select("key", "tail", "x.at2")
    return told.where("edge is null").select("key", "tail", "at2").unionByName(after)


def asked(keys: DataFrame) -> tuple[int, np.ndarray]:
    """(log of the size, bits) of the upper bits of keys: what is not among the bits is no key. The size goes with the number of keys, up to 2^ASKED."""
    size = min(ASKED, max(12, (64 * keys.count()).bit_length()))
    place = F.shiftrightunsigned("key", 64 - size)
    got = keys.select(F.shiftrightunsigned(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - size}) & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(1 << (size - 6), np.int64)
    bits[np.asarray(got.column("at"))] = np.asarray(got.column("bits"))
    return size, bits.view(np.uint64)


def is_asked(keys: np.ndarray, size: int, bits: np.ndarray) -> np.ndarray:
    place = keys >> np.uint64(64 - size)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def postings(texts: DataFrame, wanted) -> DataFrame:
    """key, text, at2, held of every text with one of the wanted shingles; text is a hash of its words, held the bits of its shingles and of its words but the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, bits = wanted.value
        for b in pieces(batches, 2):
            hashes, offsets = words(pa.array([normal(t, False) for t in b.column(2).to_pylist()], pa.string()), unified=True)
            text = span_hashes(hashes, offsets[:-1], offsets[1:])
            once = np.zeros(len(text), bool)
            once[np.unique(text, return_index=True)[1]] = True
            row, sh = distinct_shingles(hashes, offsets)
            inner = np.ones(len(hashes), bool)
            inner[offsets[1:][np.diff(offsets) > 0] - 1] = False
            held = np.hstack([sketches(row, sh, len(text)), sketches(np.repeat(np.arange(len(text)), np.diff(offsets))[inner], hashes[inner], len(text))])
            hit = once[row] & is_asked(sh, size, bits)
            row, sh = row[hit], sh[hit]
            at = pa.array(row)
            eight = pa.FixedSizeListArray.from_arrays(pa.array(held[row].ravel()), 8).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(sh.view(np.int64)), pa.array(text[row].view(np.int64)), *[b.column(c).take(at) for c in range(2)], eight], names=["key", "text", "d", "n", "held"])

    found = texts.select(*where(), "text").mapInArrow(run, "key long, text long, d long, n long, held array<long>")
    return found.select("key", "text", F.struct("d", "n").alias("at2"), "held")


def sifted(rows: DataFrame, by: str, keys: DataFrame) -> DataFrame:
    """rows whose column by may be among the same column of keys; nothing is shuffled."""
    wanted = rows.sparkSession.sparkContext.broadcast(asked(keys.select(F.xxhash64(by).alias("key"))))
    rows = rows.select(F.xxhash64(by).alias("key"), "*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(is_asked(np.asarray(b.column(0)).view(np.uint64), *wanted.value)))

    return rows.mapInArrow(run, rows.schema).drop("key")


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs with text and whole, the texts at at and at2; only texts that a pair asks for are shuffled."""
    both = pairs.select(F.explode(F.array("at", "at2")).alias("at")).distinct()
    t = sifted(texts.select(F.struct(*where()).alias("at"), "text"), "at", both)
    pairs = pairs.join(t, "at").select("tid", "ending", "text", F.col("at2").alias("at"))
    return pairs.join(t.withColumnRenamed("text", "whole"), "at").select("tid", "ending", "text", "whole")


def copied(pairs: DataFrame) -> DataFrame:
    """tid of pairs (tid, ending, text, whole) of which whole is a near-copy that goes on. Each text of a batch is read once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            (of_a, texts), (of_b, wholes) = pd.factorize(f.text), pd.factorize(f.whole)
            cut, whole = [normal(t, True) for t in texts], [normal(t, False) for t in wholes]
            (ha, oa), (hb, ob) = words(pa.array(cut, pa.string()), unified=True), words(pa.array(whole, pa.string()), unified=True)
            oe = np.maximum(oa[1:] - 1, oa[:-1])  # without the last word
            (ra, sa), (rb, sb) = distinct_shingles(ha, oa, 1), distinct_shingles(hb, ob)
            near = contained(of_a, np.searchsorted(ra, np.arange(len(cut) + 1)), sa, of_b, rb, sb)
            found: set = set()
            for i in np.flatnonzero(near).tolist():
                j, k, tid = of_a[i], of_b[i], f.tid.iloc[i]
                if tid in found:
                    continue
                a, b = ha[oa[j] : oe[j]], hb[ob[k] : ob[k + 1]]
                if (b[:-1] == a[-1]).any() and ends_early(a.tolist(), b.tolist()) and goes_on(a, wholes[k]) and (f.ending.iloc[i] == "open" or not lacks_only_a_stop(cut[j], whole[k])):
                    found.add(tid)
            yield pd.DataFrame({"tid": list(found)}, dtype=object)

    return pairs.mapInPandas(run, "tid binary").distinct()


def contained(of_a: np.ndarray, ends: np.ndarray, sa: np.ndarray, of_b: np.ndarray, rb: np.ndarray, sb: np.ndarray, most: int = 1 << 21) -> np.ndarray:
    """Of pairs (of_a, of_b) of texts whether SIMILARITY of the first one's shingles stand in the second; so many shingles at once."""
    there = np.sort(mixed(sb ^ mixed(rb.astype(np.uint64))))
    size = np.diff(ends)[of_a]
    out, sums, start = np.zeros(len(of_a), bool), np.cumsum(size), 0
    while start < len(of_a) and len(there):
        end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + most, "right")))
        n = size[start:end]
        pair = np.repeat(np.arange(end - start), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ends[:-1][of_a[start:end]], n)
        asked_for = mixed(sa[at] ^ mixed(of_b[start:end][pair].astype(np.uint64)))
        hit = there[np.minimum(np.searchsorted(there, asked_for), len(there) - 1)] == asked_for
        out[start:end] = (n > 0) & (np.bincount(pair[hit], minlength=end - start) >= SIMILARITY * n)
        start = end
    return out


def goes_on(cut: np.ndarray, text: str) -> bool:
    """Whether a text that is a suspect itself goes on also without its last word, which may be broken, as that of cut is."""
    if judge(text, "raw_response")[0] == "closed":
        return True
    hashes, _ = words(pa.array([normal(text, True)], pa.string()), unified=True)
    b = hashes[:-1]
    x, y = (np.unique(shingles(h, np.array([0, len(h)]))[0]) for h in (cut, b))
    return len(np.intersect1d(x, y, assume_unique=True)) >= SIMILARITY * len(x) and ends_early(cut.tolist(), b.tolist())


def frequencies(grams: DataFrame, keys: DataFrame) -> DataFrame:
    """key, c: in how many rows of grams, arrays of distinct shingles, each of keys is; only what may be among keys leaves a worker, counted by batches."""
    wanted = grams.sparkSession.sparkContext.broadcast(asked(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sh = np.asarray(b.column(0).flatten()).view(np.uint64)
            key, c = np.unique(sh[is_asked(sh, *wanted.value)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c.astype(np.int64))], names=["key", "c"])

    return grams.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def by_shingles(texts: DataFrame, all_: DataFrame, rest: DataFrame) -> DataFrame:
    """tid, at, ending, at2 of all pairs of a suspect of rest with a text that may hold SIMILARITY of its shingles; all_: all suspects, by which shingles are rare."""
    n = F.size("grams")
    spared = (n - F.ceil(n * F.lit(SIMILARITY))).alias("spared")
    keys = rest.select("tid", spared, F.explode("grams").alias("key"))
    keys = keys.join(frequencies(all_.select("grams"), keys.select("key").distinct()), "key")
    keys = keys.withColumn("rn", F.row_number().over(Window.partitionBy("tid").orderBy("c", "key"))).where("rn <= spared + 1").select("tid", "spared", "key")
    keys = cut_lineage(keys.join(rest.select("tid", "at", "ending", "bits"), "tid"))
    distinct = keys.select("key").distinct()
    wanted = texts.sparkSession.sparkContext.broadcast(asked(distinct))
    post = postings(texts, wanted).join(distinct, "key", "left_semi").groupBy("key", "text").agg(F.min(F.struct("at2", "held")).alias("p")).select("key", "p.*")
    missing = sum((F.bit_count(F.get("bits", F.lit(i)).bitwiseAND(F.bitwise_not(F.get("held", F.lit(i))))) for i in range(4)), F.lit(0))
    # whatever aligns to its end has its last word in the other text, and something behind it
    last = F.expr("shiftrightunsigned(get(held, cast(4 + shiftright(get(bits, 4), 6) AS int)), cast(get(bits, 4) & 63 AS int)) & 1L = 1L")
    return keys.join(post, "key").where((F.col("at") != F.col("at2")) & (missing <= F.col("spared")) & last).select("tid", "at", "ending", "at2").distinct()


def aligned_cuts(texts: DataFrame, seen: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """tid of suspects (rows of seen with a tid; of: those asked for, else all) that end early against a near-copy: by the neighbours in their buckets first, the rest by all texts that share shingles."""
    seen = seen.where("tid is not null")
    own = seen if of is None else sifted(seen, "tid", of).join(of, "tid", "left_semi")
    one = own.groupBy("tid").agg(F.min(F.struct(*where())).alias("at"), F.min("ending").alias("ending"), F.first(F.struct("own", "grams", "bits")).alias("x"))
    one = cut_lineage(one.select("tid", "at", "ending", "x.*"))
    mine = one.select("tid", "at", "ending", F.explode("own").alias("o")).select("tid", "at", "ending", "o.key", "o.tail")
    # only buckets with a suspect matter; of texts that go on alike one stands for all
    keys = mine.select("key").distinct()
    wanted = texts.sparkSession.sparkContext.broadcast(asked(keys))
    others = places(texts, wanted).join(keys, "key", "left_semi").select("key", "tail", F.lit(False).alias("own"), "at")
    rows = others.unionByName(mine.select("key", "tail", F.lit(True).alias("own"), "at")).groupBy("key", "tail").agg(F.max("own").alias("own"), F.min("at").alias("at"))
    pairs = cut_lineage(mine.join(neighbours(rows), ["key", "tail"]).select("tid", "at", "ending", "at2").distinct())
    near = cut_lineage(copied(with_texts(pairs, texts)))
    rest = one.where(F.size("grams") > 0).join(near, "tid", "left_anti")
    more = cut_lineage(by_shingles(texts, seen, rest).join(pairs.select("tid", "at2"), ["tid", "at2"], "left_anti"))
    return near.unionByName(copied(with_texts(more, texts)))


def signs(texts: DataFrame, seen: DataFrame) -> DataFrame:
    """delivery_id, attempt, field, dataset, provider, tid, sign of every suspect: structure, if the JSON is open or a mark stands behind, closing, if the last sentence or the closing word lacks an end, else NULL."""
    seen = seen.withColumn("word", F.substring_index("kind", " ", 1))
    errors = seen.where("field = 'api_error'")
    open_ = seen.where("ending <> 'closed'").drop("own", "grams", "bits")
    # only error messages have a kind; the others stay out of the join, where they would all meet under NULL
    told = open_.where("field = 'api_error'").join(stops(errors, "kind"), "kind", "left").join(stops(errors, "word"), "word", "left")
    prose = open_.where("field <> 'api_error'")
    prose = prose.where("last is null").unionByName(prose.where("last is not null").join(closing_words(texts), "last", "left"), allowMissingColumns=True)
    judged = told.unionByName(prose, allowMissingColumns=True)
    # a kind too rare to tell (cut within its first words) goes by its first word
    asks = F.when(F.col("kind_n") >= 3, F.col("kind_rate") >= 0.1).otherwise((F.col("word_n") >= 10) & (F.col("word_rate") >= 0.1))
    known = F.coalesce(F.col("last_n") >= KNOWN_WORD, F.lit(False))
    final = known & (F.col("last_rate") >= 0.9)
    never = known & F.col("inner") & (F.col("last_rate") <= 0.02)
    sign = F.when(F.col("ending") == "open", "structure").when((F.col("ending") == "prose") & ~final | never | asks, "closing")
    return judged.select("delivery_id", "attempt", "field", "dataset", "provider", "tid", sign.alias("sign"))


def truncated(calls: DataFrame) -> DataFrame:
    """delivery_id, attempt, field, dataset, provider, evidence (copy, structure, closing) of every text that was cut.

    copy: a near-copy goes on, which every suspect is held against; of the others their sign.
    """
    texts = attempt_texts(calls)
    seen = cut_lineage(read(texts))
    judged = signs(texts, seen)
    copies = aligned_cuts(texts, seen).withColumn("copied", F.lit(True))
    judged = judged.where("tid is null").withColumn("copied", F.lit(None).cast("boolean")).unionByName(judged.where("tid is not null").join(copies, "tid", "left"))
    evidence = F.when(F.col("copied"), "copy").otherwise(F.col("sign"))
    return judged.select("delivery_id", "attempt", "field", "dataset", "provider", evidence.alias("evidence")).where("evidence is not null")


def cut_texts(calls: DataFrame) -> DataFrame:
    """truncated without the evidence: the same texts. A suspect that has a sign was cut whether or not it has a near-copy, so only those without one are held against other texts."""
    texts = attempt_texts(calls)
    seen = cut_lineage(read(texts))
    judged = cut_lineage(signs(texts, seen).where("sign is not null or tid is not null"))
    untold = judged.where("sign is null")
    copies = aligned_cuts(texts, seen, untold.select("tid").distinct())
    names = ["delivery_id", "attempt", "field", "dataset", "provider"]
    return judged.where("sign is not null").select(*names).unionByName(untold.join(copies, "tid", "left_semi").select(*names))


def truncation_report(calls: DataFrame) -> DataFrame:
    """How many texts of each provider, dataset and field there are, and how many of them were cut."""
    group = ["provider", "dataset", "field"]
    all_ = attempt_texts(calls).groupBy(*group).agg(F.count(F.lit(1)).alias("texts"))
    cut = cut_texts(calls).groupBy(*group).agg(F.count(F.lit(1)).alias("cut"))
    same = [all_[c].eqNullSafe(cut[c]) for c in group]
    return all_.join(cut, same, "left").select(*[all_[c] for c in group], "texts", F.coalesce("cut", F.lit(0).cast("long")).alias("cut"), (F.coalesce("cut", F.lit(0)) / F.col("texts")).alias("share"))
