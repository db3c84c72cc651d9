"""One form for text that looks the same (problem 5).

Texts of an Arrow batch are one array of code points. Full-width and other compatibility letters, ligatures, spaces of
other widths and look-alike hyphens go through lookup tables, with expansion offsets where one character becomes several;
characters without a shape of their own are dropped; letters borrowed from another script inside a word go back to the
word's script; combining accents are composed with a pair table. All steps are array operations over the whole batch.

Left alone, as ordinary: composed accented letters, typographic quotes and dashes, superscripts and fractions, the
ellipsis, words wholly in another script, full-width punctuation and the wide space in strings with Chinese or Japanese
characters, joiners between emoji or in scripts that need them, marks that compose with nothing.

NULL stays NULL, the empty text stays empty; white space is not trimmed or collapsed; the length of a text has no bound.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codepoints import keep, pieces, rows_of, to_codepoints, to_strings

SIZE = 0x110000
LATIN, CYRILLIC, GREEK = 1, 2, 3

#: Letters that look like a Latin letter, and that letter, pair by pair.
CYRILLIC_LIKE = "АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX аa еe ѕs іi јj оo рp сc уy хx ԁd ԛq ԝw һh ӏl"
GREEK_LIKE = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv ϲc ϳj"
#: Characters without a shape of their own.
INVISIBLE = (0x00AD, 0x034F, 0x061C, 0x180E, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0xFEFF)
JOINERS, DIRECTIONS = (0x200C, 0x200D), (0x061C, 0x200E, 0x200F, 0x202A, 0x202B, 0x202C, 0x202D, 0x202E, 0x2066, 0x2067, 0x2068, 0x2069)
HYPHENS = (0x2010, 0x2011, 0xFE63)


@functools.lru_cache(1)
def tables() -> dict[str, np.ndarray]:
    """Lookup tables from Python's Unicode data, by rule; built once per worker."""
    single = np.arange(SIZE, dtype=np.uint32)
    wide_only = np.zeros(SIZE, bool)  # ordinary in strings with Chinese characters
    length = np.ones(SIZE, np.int64)
    start = np.zeros(SIZE, np.int64)
    flat: list[int] = []
    pairs: list[tuple[int, int]] = []
    apart: list[int] = []
    apart_length = np.ones(SIZE, np.int64)
    apart_start = np.zeros(SIZE, np.int64)
    script = np.zeros(SIZE, np.uint8)
    kind = np.zeros(SIZE, np.uint8)  # 1 letter, 2 mark, 3 letter or digit that isn't of the three scripts
    ccc = np.zeros(SIZE, np.uint8)
    #: Only planes with characters that have such forms are walked.
    for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)]:
        ch = chr(c)
        cat = unicodedata.category(ch)
        if cat in ("Cn", "Cs", "Co"):
            continue
        ccc[c] = unicodedata.combining(ch)
        if cat[0] == "M":
            kind[c] = 2
        elif cat[0] == "L":
            kind[c] = 1
            name = unicodedata.name(ch, "")
            script[c] = LATIN if name.startswith("LATIN ") else CYRILLIC if name.startswith("CYRILLIC ") else GREEK if name.startswith("GREEK ") else 0
        how = unicodedata.decomposition(ch)
        if not how:
            continue
        tag, parts = (how.split()[0], how.split()[1:]) if how[0] == "<" else ("", how.split())
        if not tag:
            if len(parts) == 1:
                if not unicodedata.category(ch).startswith("M") and not 0xF900 <= c < 0xFB00 and c not in (0x2000, 0x2001, 0x0340, 0x0341, 0x037E, 0x0387):
                    single[c] = ord(unicodedata.normalize("NFC", ch)) if len(unicodedata.normalize("NFC", ch)) == 1 else c
                elif c in (0x2000, 0x2001):
                    single[c] = 0x20
            elif unicodedata.normalize("NFC", unicodedata.normalize("NFD", ch)) == ch:
                pairs.append((int(parts[0], 16) << 21 | int(parts[1], 16), c))
                whole = unicodedata.normalize("NFD", ch)
                apart_start[c], apart_length[c] = len(apart), len(whole)
                apart += map(ord, whole)
            continue
        target = unicodedata.normalize("NFKC", ch)
        if cat == "Zs":
            single[c] = 0x20
            wide_only[c] = c == 0x3000
        elif tag in ("<wide>", "<narrow>") or tag == "<font>" or tag == "<compat>" and (cat[0] == "L" and 0xFB00 <= c <= 0xFB06 or cat == "Nl" or 0x132 <= c <= 0x1CC and cat[0] == "L" and c not in (0x149,)):
            if len(target) == 1:
                single[c] = ord(target)
                wide_only[c] = tag == "<wide>" and cat[0] not in "LN"
            else:
                start[c], length[c] = len(flat), len(target)
                flat += map(ord, target)
    for c in HYPHENS:
        single[c] = 0x2D
    like = np.zeros(SIZE, np.uint32)
    back = np.zeros(SIZE, np.uint32)
    for pair in (CYRILLIC_LIKE + " " + GREEK_LIKE).split():
        like[ord(pair[0])] = ord(pair[1])
    for pair in CYRILLIC_LIKE.split():
        back[ord(pair[1])] = ord(pair[0])
    for lead in range(19):  # Hangul syllables, by their arithmetic
        for vowel in range(21):
            lv = 0xAC00 + (lead * 21 + vowel) * 28
            pairs.append(((0x1100 + lead) << 21 | 0x1161 + vowel, lv))
            pairs += [(lv << 21 | 0x11A7 + tail, lv + tail) for tail in range(1, 28)]
    keys = np.array([k for k, _ in pairs], np.int64)
    order = np.argsort(keys)
    can_follow = np.zeros(SIZE, bool)
    can_follow[keys & 0x1FFFFF] = True
    gone = np.zeros(SIZE, bool)
    gone[list(INVISIBLE)] = True
    odd = gone | can_follow | (single != np.arange(SIZE)) | (length > 1) | (like > 0)
    return {
        "single": single, "wide_only": wide_only, "length": length, "start": start, "flat": np.array(flat, np.uint32), "script": script, "kind": kind, "ccc": ccc,
        "like": like, "back": back, "keys": keys[order], "made": np.array([c for _, c in pairs], np.uint32)[order], "gone": gone, "odd": odd, "can_follow": can_follow,
        "apart": np.array(apart, np.uint32), "apart_length": apart_length, "apart_start": apart_start,
    }


def _is_cjk(c: np.ndarray) -> np.ndarray:
    return (c >= 0x3040) & (c <= 0x30FF) | (c >= 0x3400) & (c <= 0x9FFF) | (c >= 0x20000) & (c <= 0x3FFFF)


def _expand(cps: np.ndarray, offsets: np.ndarray, length: np.ndarray, start: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code point replaced by its stretch of flat where it has one."""
    each = length[cps]
    if not (each > 1).any():
        return cps, offsets
    where = np.repeat(np.arange(len(cps)), each)
    inner = np.arange(len(where)) - np.repeat(np.cumsum(each) - each, each)
    many = each[where] > 1
    out = cps[where]
    out[many] = flat[start[cps[where[many]]] + inner[many]]
    return out, np.concatenate([[0], np.cumsum(each)])[offsets]


def _compose(cps: np.ndarray, offsets: np.ndarray, t: dict) -> tuple[np.ndarray, np.ndarray]:
    """Marks put in canonical order and composed with their bases, pair by pair."""
    if not t["can_follow"][cps].any():
        return cps, offsets
    cps, offsets = _expand(cps, offsets, t["apart_length"], t["apart_start"], t["apart"])
    ccc = t["ccc"][cps]
    if ((ccc[1:] > 0) & (ccc[:-1] > ccc[1:])).any():
        group = np.cumsum(ccc == 0)
        cps = cps[np.lexsort((ccc, group, rows_of(offsets)))]
    tried = np.zeros(len(cps), bool)
    while True:
        # marks that do not compose stay between a base and later marks of higher classes
        ccc = t["ccc"][cps]
        starter = np.maximum.accumulate(np.where((ccc == 0), np.arange(len(cps)), 0))
        follow = np.flatnonzero(t["can_follow"][cps] & ~tried)
        follow = follow[follow > 0]
        rows = np.searchsorted(offsets, follow, "right") - 1
        base = starter[follow - 1]
        inside = base >= offsets[rows]
        follow, base = follow[inside], base[inside]
        if not len(follow):
            return cps, offsets
        # one mark of each base at a time, the first not tried; the base may be composed again in the next round
        first = np.concatenate([[True], np.diff(base) > 0])
        follow, base = follow[first], base[first]
        blocked = (base != follow - 1) & (t["ccc"][cps[follow - 1]] >= ccc[follow])
        key = cps[base].astype(np.int64) << 21 | cps[follow].astype(np.int64)
        at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
        ok = (t["keys"][at] == key) & ~blocked & ~np.isin(base, follow)
        tried = tried.copy()
        tried[follow[~ok & ~np.isin(base, follow[ok])]] = True
        if not ok.any():
            continue
        cps = cps.copy()
        cps[base[ok]] = t["made"][at[ok]]
        mask = np.ones(len(cps), bool)
        mask[follow[ok]] = False
        tried = tried[mask]
        cps, offsets = keep(cps, offsets, mask)


def _borrowed(cps: np.ndarray, offsets: np.ndarray, t: dict) -> np.ndarray:
    """Code points with letters borrowed from another script put back."""
    n = len(cps)
    script = t["script"][cps]
    part = (t["kind"][cps] > 0)
    breaks = np.zeros(n, bool)
    breaks[offsets[:-1][offsets[:-1] < n]] = True
    begins = part & (breaks | ~np.concatenate([[False], part[:-1]]))
    word = np.cumsum(begins) - 1
    word[~part] = -1
    at = np.flatnonzero(part & (script > 0))
    if not len(at):
        return cps
    words = int(word.max()) + 1
    count = lambda mask: np.bincount(word[at][mask[at]], minlength=words)
    latin, foreign = count(script == LATIN), count(script > LATIN)
    if not foreign.any():
        return cps
    alike = count((script > LATIN) & (t["like"][cps] > 0))
    turned = count((script == LATIN) & (t["back"][cps] > 0))
    row = rows_of(offsets)
    row_latin = np.bincount(row[at], weights=script[at] == LATIN, minlength=len(offsets) - 1)
    row_true = np.bincount(row[at], weights=(script[at] > LATIN) & (t["like"][cps[at]] == 0), minlength=len(offsets) - 1)
    first = np.flatnonzero(begins)
    among_latin = (row_latin[row[first]] > 0) & (row_true[row[first]] == 0)
    to_latin = (foreign > 0) & (alike == foreign) & ((latin > 0) | among_latin)
    cyrillic = count(script == CYRILLIC)
    to_cyrillic = ~to_latin & (latin > 0) & (cyrillic == foreign) & (foreign > 0) & (turned == latin)
    out = cps.copy()
    sel = at[(script[at] > LATIN) & to_latin[word[at]]]
    out[sel] = t["like"][cps[sel]]
    sel = at[(script[at] == LATIN) & to_cyrillic[word[at]]]
    out[sel] = t["back"][cps[sel]]
    return out


def unify_block(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of a batch in one form."""
    t = tables()
    n = len(offsets) - 1
    if not len(cps):
        return cps, offsets
    row = rows_of(offsets)
    gone = t["gone"][cps]
    if gone.any():
        before = np.concatenate([[0], cps[:-1]])
        after = np.concatenate([cps[1:], [0]])
        pictures = lambda c: (c >= 0x1F000) & (c <= 0x1FAFF) | (c >= 0x2600) & (c <= 0x27BF) | (c == 0xFE0F)
        joining = lambda c: (c >= 0x0600) & (c <= 0x0DFF) | (c >= 0x0F00) & (c <= 0x109F) | (c >= 0xFB50) & (c <= 0xFEFC)
        needed = np.isin(cps, JOINERS) & (pictures(before) & pictures(after) | joining(before) | joining(after))
        right_to_left = np.zeros(n, bool)
        right_to_left[row[(cps >= 0x0590) & (cps <= 0x08FF) | (cps >= 0xFB1D) & (cps <= 0xFDFF)]] = True
        needed |= np.isin(cps, DIRECTIONS) & right_to_left[row]
        cps, offsets = keep(cps, offsets, ~gone | needed)
        row = rows_of(offsets)
    ordinary = t["wide_only"][cps]
    if ordinary.any():
        cjk = np.zeros(n, bool)
        cjk[row[_is_cjk(cps)]] = True
        ordinary &= cjk[row]
    cps = np.where(ordinary, cps, t["single"][cps])
    cps, offsets = _expand(cps, offsets, t["length"], t["start"], t["flat"])
    cps, offsets = _compose(cps, offsets, t)
    return _borrowed(cps, offsets, t), offsets


def unify_array(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(texts in one form, whether each changed). Rows without any odd character are not touched."""
    strings = strings.cast(pa.string())
    cps, offsets = to_codepoints(strings)
    odd = np.zeros(len(strings), bool)
    odd[rows_of(offsets)[tables()["odd"][cps]]] = True
    if not odd.any():
        return strings, odd
    picked = np.flatnonzero(odd)
    out, ends = unify_block(cps[odd[rows_of(offsets)]], np.concatenate([[0], np.cumsum(np.diff(offsets)[picked])]))
    done = to_strings(out, ends)
    flags = np.zeros(len(strings), bool)
    flags[picked] = np.asarray(pc.not_equal(done, strings.take(pa.array(picked))))
    index = np.arange(len(strings))
    index[picked] = len(strings) + np.arange(len(picked))
    return pa.concat_arrays([strings, done]).take(pa.array(index)), flags


def unify_column(df: DataFrame, text: str, out: str = "unified", flag: str = "changed") -> DataFrame:
    """df with the text in one form, and whether that differs; all columns stay, names that clash are replaced."""
    kept = [c for c in df.columns if c not in (out, flag)]
    at = kept.index(text)
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), f"`{out}` string", f"`{flag}` boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, at):
            done, changed = unify_array(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns, done, pa.array(changed)], names=[*kept, out, flag])

    return df.select(*kept).mapInArrow(run, schema)


def family_strings(families: DataFrame) -> DataFrame:
    """family_id, field, text of answer, answer_aliases and full_state evidence; NULL and empty texts left out."""
    one = F.array(F.struct(F.lit("answer").alias("field"), F.col("answer").alias("text")))
    aliases = F.transform(F.coalesce("answer_aliases", F.array().cast("array<string>")), lambda a: F.struct(F.lit("answer_aliases").alias("field"), a.alias("text")))
    evidence = F.coalesce(F.transform(F.col("full_state.evidence"), lambda e: F.struct(F.lit("evidence").alias("field"), e["text"].alias("text"))), F.array().cast("array<struct<field:string,text:string>>"))
    return families.select("family_id", F.explode(F.concat(one, aliases, evidence)).alias("s")).select("family_id", "s.field", "s.text").where("text <> ''")


def affected_fields(families: DataFrame) -> DataFrame:
    """(family_id, field) with at least one string that another form stands for; distinct."""
    return unify_column(family_strings(families), "text").where("changed").select("family_id", "field").distinct()
