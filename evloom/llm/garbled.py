"""Text read in the wrong character encoding (problem 10): found, and restored where it can be.

UTF-8 read as something else: for each wrong encoding the character sequences that the letters, punctuation and
ideographs of the common languages turn into are computed by rule, and all of them are matched at once by an
Aho-Corasick automaton (longest match first). Only matched spans are replaced, so correct text beside them stays. What was
garbled several times is restored in as many rounds, until nothing changes.

Single-byte encodings mixed up with each other leave no sequence that proper text could not hold: one letter stands for one letter. Alphabets (Cyrillic and Greek in
their encodings, shown as Western or as another Cyrillic) are tried pair by pair: runs that are wholly foreign are read back, and the pair is taken whose letters
go best with the frequencies of Russian or Greek, if they go well, are written as words are, and go better than what stood there. Chinese (GB 2312) shown as
Western is read back only in whole runs, where no alphabet fits, every pair of bytes is a common ideograph or its punctuation, and the way back gives the same bytes.
Central European shown as Western is told by signs inside words. What no pair explains stays as it is.

The replacement character says that something was lost: such a text is found, and what else is garbled in it is restored.

NULL, empty and ASCII-only texts are no case; no text is cut; equal texts have equal results; other columns are not touched.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Encodings that UTF-8 bytes are wrongly read in.
WRONG = ("latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "mac_roman", "koi8_r", "cp866")
#: Letters of Central European, Baltic and Turkish alphabets beyond Latin-1.
EXTENDED = "ĄąĆćĘęŁłŃńŚśŹźŻżČčĎďĚěŇňŘřŠšŤťŮůŽžŐőŰűĞğİıŞşĀāĒēĢģĪīĶķĻļŅņŪūŒœŸȘșȚț"
#: Punctuation and signs beyond Latin-1.
SIGNS = "‐‑–—‘’‚“”„†‡•…‰‹›€™№−"
#: Frequency of Russian letters, per thousand, in alphabetical order from а to я (ё with е).
RUSSIAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюя", (80, 16, 45, 17, 30, 85, 9, 17, 74, 12, 35, 44, 32, 67, 110, 28, 47, 55, 63, 26, 3, 10, 5, 14, 7, 4, 1, 19, 17, 3, 6, 20)))
#: Frequency of Greek letters, per thousand, in alphabetical order from α to ω (accented ones with their letter, ς with σ).
GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", (120, 8, 20, 17, 85, 5, 55, 11, 85, 41, 33, 44, 79, 6, 98, 50, 50, 49, 91, 43, 12, 14, 2, 18)))
#: Alphabets, as (encoding that was written, encodings it was read in).
ALPHABETS = (
    ("cp1251", ("cp1252", "latin-1", "koi8_r", "cp866")), ("koi8_r", ("cp1252", "latin-1", "cp1251", "cp866")), ("iso8859_5", ("cp1252", "latin-1", "cp1251", "koi8_r")),
    ("cp866", ("cp1252", "latin-1", "cp1251", "koi8_r")), ("cp1253", ("cp1252", "latin-1")), ("iso8859_7", ("cp1252", "latin-1")),
)


def _read(data: bytes, encoding: str) -> str | None:
    """Bytes as the encoding shows them; bytes it leaves undefined show as control characters."""
    if encoding in ("cp1252", "cp1250", "cp1251"):
        return "".join(_one(b, encoding) for b in data)
    return data.decode(encoding)


@functools.lru_cache(4096)
def _one(b: int, encoding: str) -> str:
    try:
        return bytes([b]).decode(encoding)
    except UnicodeDecodeError:
        return chr(b)


def _targets() -> list[str]:
    gb = []
    for high in range(0xB0, 0xF8):
        for low in range(0xA1, 0xFF):
            try:
                gb.append(bytes((high, low)).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return [
        *map(chr, range(0x80, 0x100)), *EXTENDED, *SIGNS, *map(chr, range(0x386, 0x3CF)), *map(chr, range(0x401, 0x460)), "Ґ", "ґ",
        *map(chr, range(0x3001, 0x3012)), *map(chr, range(0x3041, 0x30FF)), *map(chr, range(0xFF01, 0xFF60)), *gb, *map(chr, range(0x1F300, 0x1F650)), *map(chr, range(0x1F900, 0x1FA00)), "\ufeff", "\u200b", "\u200d", "\ufffd",
        *(_one(b, encoding) for encoding in WRONG for b in range(0x80, 0x100)),  # for what was garbled twice
    ]


@functools.lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Garbled sequence to (restored character, strong); weak ones, which proper text may hold, count in runs only."""
    a = ahocorasick.Automaton()
    quotes = set("‘’“”„‚–—…‹›»«†‡•")
    for encoding in WRONG:
        for ch in _targets():
            seen = _read(ch.encode("utf-8"), encoding)
            if seen == ch or seen in a:
                continue
            first, rest = seen[0], seen[1:]
            cyrillic = "Ѐ" <= first <= "ӿ"
            weak = len(seen) == 2 and (first.isalpha() and (rest in quotes) or cyrillic and rest.isalpha() and "Ѐ" <= rest <= "ӿ" and rest in "ёЁіІїЇєЄ")
            a.add_word(seen, (ch, len(seen), not weak))
    a.make_automaton()
    return a


def _spans(text: str) -> list[tuple[int, int, str, bool]]:
    out = []
    for end, (ch, n, strong) in automaton().iter_long(text):
        a, b = end - n + 1, end + 1
        if not strong:
            beside = text[max(0, a - 1) : a] + text[b : b + 1]
            if "Ѐ" <= text[a] <= "ӿ":  # Cyrillic inside a Latin word
                strong = any(c.isascii() and c.isalpha() for c in beside)
            else:  # a capital and a sign inside a word of small letters
                strong = any(c.islower() for c in beside)
        out.append((a, b, ch, strong))
    return out


def alien_runs(text: str, spans: list) -> list[tuple[int, int]]:
    """Longer runs of Western high characters with garbled sequences in them that make up less than half: bytes of something else, or with bytes lost between."""
    runs = [m.span() for m in re.finditer(r"[\x80-\xff]{6,}", text)] if spans else []
    covered = {i for s in spans for i in range(s[0], s[1])} if runs else ()
    return [(a, b) for a, b in runs if 0 < sum(i in covered for i in range(a, b)) < 0.5 * (b - a)]


def ungarble_utf8(text: str) -> str:
    """Runs of garbled sequences replaced; a run without a strong sequence counts from two sequences on."""
    spans = _spans(text)
    if not spans:
        return text
    runs: list[list] = []
    for s in spans:
        if runs and runs[-1][-1][1] == s[0]:
            runs[-1].append(s)
        else:
            runs.append([s])
    good = [r for r in runs if any(s[3] for s in r) or len(r) > 1]
    if not good:
        return text
    # beside others, also a weak sequence at the end of a word is one
    good = [r for r in runs if any(s[3] for s in r) or len(r) > 1 or r[0][0] and text[r[0][0] - 1].isalpha() and not text[r[0][0]].isupper()]
    alien = alien_runs(text, spans)
    good = [r for r in good if not any(a <= r[0][0] < b for a, b in alien)]
    out, at = [], 0
    for r in good:
        out += [text[at : r[0][0]], *(s[2] for s in r)]
        at = r[-1][1]
    return "".join(out) + text[at:]


def _as_words(word: str) -> bool:
    return word.islower() or word.istitle() or word.isupper()


_PLAIN_GREEK = str.maketrans("άέήίόύώϊϋΐΰς", "αεηιουωιυιυσ")


def _fit(words: list[str]) -> float:
    """Mean log frequency of letters, as Russian or as Greek ones, whichever script they are in; other signs count as very rare letters."""
    letters = "".join(words).lower().replace("ё", "е").translate(_PLAIN_GREEK)
    return max(sum(math.log(known.get(c, 0.2) / 1000) for c in letters) / max(1, len(letters)) for known in (RUSSIAN, GREEK))


@functools.lru_cache(64)
def _way(written: str, seen: str) -> tuple[dict[int, str], re.Pattern]:
    """(what each character seen for a high byte stands for, runs of such characters)."""
    table = {}
    for b in range(0x80, 0x100):
        try:
            was = bytes([b]).decode(written)
        except UnicodeDecodeError:
            continue
        shown = _one(b, seen)
        if not (shown.isspace() and was.isspace()):
            table[ord(shown)] = was
    inside = "".join(re.escape(chr(c)) for c in sorted(table) if table[c].isalpha())
    return table, re.compile(f"[{inside}]+")


def alphabets(text: str) -> str:
    """A text in which an alphabet was read in another encoding, read back; unchanged where no pair fits."""
    if not re.search(r"[\x80-\u04ff\u2000-\u25ff]{3}", text):
        return text
    stood = re.findall(r"[\u0370-\u04ff]{3,}", text)
    western = len(re.findall(r"[\x80-\xff]{3,}", text))
    if not western and (not stood or _fit(stood) > -3.3 and sum(map(_as_words, stood)) >= 0.9 * len(stood)):
        return text
    best: tuple[float, str, str] | None = None
    for written, readings in ALPHABETS:
        for seen in readings:
            table, run = _way(written, seen)
            runs = [m[0] for m in run.finditer(text) if not (text[m.start() - 1 : m.start()].isascii() and text[m.start() - 1 : m.start()].isalpha()) and not text[m.end() : m.end() + 1].isalpha()]
            long = [w for w in runs if len(w) >= 3]
            shown = sum(ord(c) in table for c in text)
            if sum(map(len, long)) < 8 or sum(map(len, runs)) < 0.8 * shown:
                continue  # signs between the letters: rather bytes of something else
            back = [w.translate(table) for w in long]
            fit = _fit(back)
            if fit < -3.6 or sum(map(_as_words, back)) < 0.8 * len(back) or any(c not in RUSSIAN and c not in GREEK and c != "ё" for c in "".join(back).lower().translate(_PLAIN_GREEK)):
                continue
            before = sum(_as_words(w) and w.isalpha() for w in long) / len(long)
            if fit < _fit(long) + (0.25 if before < 0.8 else 0.6):
                continue
            if best is None or fit > best[0]:
                best = fit, written, seen
    if best is None:
        return text
    table, run = _way(best[1], best[2])
    return re.sub(rf"(?<![A-Za-z]){run.pattern}(?![A-Za-z])", lambda m: m[0].translate(table), text)


def western_chinese(text: str) -> str:
    """GB 2312 read as Western: whole runs of characters of high bytes."""

    def back(m: re.Match) -> str:
        try:
            raw = m[0].encode("cp1252")
            got = raw.decode("gb2312")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m[0]
        try:
            raw.decode("utf-8")
            return m[0]
        except UnicodeDecodeError:
            pass
        common = sum(0xB0 <= b <= 0xD7 or 0xA1 <= b <= 0xA3 for b in raw[::2])
        ideographs = sum("一" <= c <= "鿿" for c in got)
        return got if common == len(got) and 2 * ideographs >= len(got) and got.encode("gb2312") == raw else m[0]

    western = [c for c in text if "\x80" <= c <= "ÿ"]
    if sum(c in "ÐÑ" for c in western) > 0.25 * len(western):
        return text  # rather Cyrillic UTF-8 that lost bytes
    pairs = re.findall(r"[°-þ][¡-þ]", "".join(re.findall(r"(?<![^\x00-\x7f])(?:[¡-þ]{2})+(?![^\x00-\x7f])", text)))
    if len(pairs) >= 8 and max(pairs) < "É":  # all in the rows of Hangul, which no Chinese text keeps to
        korean = lambda m: m[0].encode("latin-1").decode("euc_kr", "replace")
        done = re.sub(r"(?<![^\x00-\x7f])(?:[¡-þ]{2})+(?![^\x00-\x7f])", korean, text)
        return text if "\ufffd" in done else done
    out = re.sub(r"[^\x00-\x7f]{4,}", back, text)
    if out != text:  # short runs, punctuation and accented letters of names beside the ideographs
        out = re.sub(r"(?<![\x80-\xff])(?:[¡-£°-×][¡-þ])(?![\x80-\xff])", lambda m: m[0].encode("cp1252").decode("gb2312", "replace") if "\ufffd" not in m[0].encode("cp1252").decode("gb2312", "replace") else m[0], out)
        out = re.sub(r"¨[¡-¹]", lambda m: m[0].encode("cp1252").decode("gb2312", "replace"), out)
    return out


def gbk_of_utf8(text: str) -> str:
    """UTF-8 read as GBK: runs of ideographs whose GBK bytes are UTF-8 for ideographs, and single ones inside Latin words."""

    def back(m: re.Match) -> str:
        try:
            got = m[0].encode("gbk").decode("utf-8", "replace")
        except UnicodeEncodeError:
            return m[0]
        good = sum("\u3000" <= c <= "\u9fff" or "\uff00" <= c <= "\uff60" for c in got)
        return got if good >= 2 and good >= 0.6 * len(got) else m[0]

    def letter(m: re.Match) -> str:
        try:
            got = m[0].encode("gbk").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m[0]
        return got if all("\xc0" <= c <= "\u024f" for c in got) else m[0]

    out = re.sub(r"[^\x00-\x7f\ufffd]{3,}", back, text)
    return re.sub(r"(?<=[A-Za-zÀ-ɏ])[\u4e00-\u9fff]+(?=[a-zß-ɏ])", letter, out)


def western_central(text: str) -> str:
    """Central European (Windows 1250, or ISO 8859-2) read as Western: signs inside words."""
    for encoding, sure, likely in (("cp1250", "³¿¹œŸ", "³¿¹œŸêæñó£¯¥Œ"), ("iso8859-2", "³¿±¶¼", "³¿±¶¼êæñó£¯¡¦")):
        inner = rf"(?:[A-Za-zÀ-ÿ][{sure}][a-zà-ÿ]|[a-zà-ÿ]{{3}}[{sure}](?![\w²³])|(?<!\w)[³¿][a-z]{{3}})"
        hits = [m for m in re.finditer(inner, text) if not re.match(r"(?:k?m|cm|mm)[²³¹]", m[0])]
        hits = [m for m in hits if not (m[0][0] == "¿" and m[0][1:2].isalpha() and not m[0][0].isalnum() and re.match(r"¿[a-zà-ÿ]", m[0]))]
        if not hits:
            continue
        if not any(re.match(rf"[A-Za-zÀ-ÿ][{sure}][a-zà-ÿ]", m[0]) for m in hits) and len(hits) < 2:
            continue
        word = rf"[A-Za-zÀ-ÿ{likely}]*[{likely}][A-Za-zÀ-ÿ{likely}]*"
        return re.sub(word, lambda m, e=encoding: _recode(m[0], e), text)
    return text


def _recode(word: str, encoding: str) -> str:
    try:
        return word.encode("cp1252").decode(encoding)
    except (UnicodeDecodeError, UnicodeEncodeError):
        return word


def restore(text: str | None) -> tuple[str | None, list[str]]:
    """(text restored as far as it can be, how it was garbled); no way: proper text."""
    if not text or text.isascii():
        return text, []
    how: list[str] = []
    if "�" in text:
        how.append("lost")
    out = text
    covered = sum(b - a for a, b, _, _ in _spans(text)) / sum(c > "\x7f" for c in text)
    for name, f in (("gbk", gbk_of_utf8), ("alphabet", alphabets), ("western_chinese", western_chinese)):
        new = f(out) if covered < 0.35 else out
        if new != out:
            how.append(name)
            out = new
    while (new := ungarble_utf8(out)) != out:  # ends: every round makes the text shorter
        how.append("again" if "utf8" in how else "utf8")
        out = new
    if not how and re.search(r"[\x80-\xff]{6}", out) and alien_runs(out, _spans(out)):
        how.append("lost")
    if not how and (new := western_central(out)) != out:
        how.append("western_central")
        out = new
    return out, how


def restored(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, how, restored text of every garbled document."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [restore(t) for t in b.column(1).to_pylist()]
            at = [i for i, (_, how) in enumerate(done) if how]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([",".join(done[i][1]) for i in at], pa.string()), pa.array([done[i][0] for i in at], pa.string())], names=["rid", "how", "restored"])

    return docs.select(docs[id_col].alias("rid"), text).where(f"{text} <> ''").mapInArrow(run, f"rid {kind}, how string, restored string").withColumnRenamed("rid", id_col)
