"""A whole corpus as token ids of a public tokenizer (problem 8).

Overlapping chunk encoding: a long text is cut into chunks of CHUNK characters that run on for OVERLAP characters into the next one. All chunks are
pre-tokenised in parallel, each from its own beginning, and stitched at the first place of the overlap where the pre-token boundaries of both resynchronise:
the pattern looks ahead only, so from a common boundary on both say the same. A chunk's boundaries count once it has passed a place where a boundary stands
whatever came before, the end of a run of letters or of figures (no pre-token goes on behind it); the last two pre-tokens of a chunk, which its end may have
cut, count never. Where nothing resynchronises (one pre-token longer than the overlap, a chunk without such a place) two chunks stay one. The pieces between
the stitches are encoded independently, in parallel, and their ids joined in order equal the ids of the whole text. This holds for any script.
Short texts, the bulk, are encoded where they lie, without any shuffle; long ones are a second scan of their own, filtered by length.

NULL and empty texts give an empty list of ids. Special-token strings inside a text are ordinary text. Every document gives one row, also
repeated ones. Decoding concatenates the tokens' raw bytes.
"""

from __future__ import annotations

import base64
import functools
import importlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

TOKENIZER = "byte_bpe_50k"
CHUNK = 1 << 16
OVERLAP = 1 << 11


@functools.lru_cache(4)
def encoding(name: str, folder: str | None = None):
    """A byte-level tokenizer by name; folder: where its ranks lie, by default the installed public_tokenizers."""
    import tiktoken

    public = importlib.import_module("public_tokenizers")
    path = f"{folder}/{name}.tiktoken" if folder else public.path(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encode_column(texts: pa.Array, name: str, folder: str | None) -> pa.ListArray:
    enc = encoding(name, folder)
    each = [np.asarray(enc.encode_ordinary(t), np.int32) if t else np.zeros(0, np.int32) for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *each])))


@functools.lru_cache(1)
def _patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """(pre-tokens, places where a boundary stands whatever came before)."""
    return regex.compile(importlib.import_module("public_tokenizers").PATTERN), regex.compile(r"\p{L}(?!\p{L})|\p{N}(?!\p{N})")


def boundaries(text: str, first: bool, last: bool, chunk: int, overlap: int) -> tuple[list[int], list[int]]:
    """Pre-token boundaries of a chunk in its first overlap characters and behind its chunk characters, the latter only as far as they are those of the whole text.

    Boundaries behind white space are left out: what follows decides how white space is split, and a piece that ends there would not see it.
    """
    token, certain = _patterns()
    ends = [m.end() for m in token.finditer(text)]
    ends = [*[e for e in ends[:-2] if not text[e - 1].isspace()], *ends[-2:]]
    head = [e for e in ends if e < overlap]
    m = None if first else certain.search(text)
    known = first or m is not None and m.end() <= chunk
    tail = [e for e in ends[: -2 if not last else None] if chunk <= e < chunk + overlap] if known else []
    return head, tail


def stitched(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(rid, row, k, piece) out of (rid, row, k, last, text): the pieces between stitches, whose ids are independent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, k, last, text = (b.column(i) for i in (1, 2, 3, 4))
            both = [boundaries(t, n == 0, z, chunk, overlap) for n, z, t in zip(k.to_pylist(), last.to_pylist(), text.to_pylist())]
            yield pa.RecordBatch.from_arrays([row, k, pa.array([h for h, _ in both], pa.list_(pa.int32())), pa.array([t for _, t in both], pa.list_(pa.int32()))], names=["row", "k", "head", "tail"])

    at = chunks.mapInArrow(run, "row long, k int, head array<int>, tail array<int>")
    before = at.select("row", (F.col("k") + 1).alias("k"), F.transform("tail", lambda x: x - chunk).alias("prior"))
    cuts = cut_lineage(at.join(before, ["row", "k"]).select("row", "k", F.array_min(F.array_intersect("prior", "head")).alias("cut")).where("cut is not null"))
    # a chunk ends where the next one begins: at the next one's stitch, or, unstitched, with its own characters
    begin, end = cuts.withColumnRenamed("cut", "begin"), cuts.select("row", (F.col("k") - 1).alias("k"), (F.col("cut") + chunk).alias("end"))
    of = chunks.join(begin, ["row", "k"], "left").join(end, ["row", "k"], "left")
    start = F.coalesce("begin", F.lit(0))
    stop = F.when(F.col("last"), F.length("text")).otherwise(F.coalesce("end", F.lit(chunk)))
    group = F.max(F.when(F.col("begin").isNotNull() | (F.col("k") == 0), F.col("k"))).over(Window.partitionBy("row").orderBy("k"))
    cut = of.select("rid", "row", "k", F.substring(F.col("text"), start + 1, stop - start).alias("piece"))
    # which chunks stay together is found without their texts
    groups = of.select("row", "k", "begin").select("row", "k", group.alias("g"))
    return cut.join(groups, ["row", "k"]).groupBy("rid", "row", "g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "piece"))), lambda x: x["piece"]), "").alias("piece")).withColumnRenamed("g", "k")


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text", name: str = TOKENIZER, folder: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id_col, ids) of every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _encode_column(b.column(1), name, folder)], names=["rid", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(2).to_pylist()):
                n = max(1, -(-max(0, len(t) - overlap) // chunk))  # the rest behind the last chunk is at most an overlap
                for k in range(0, n, 64):  # slices go out in portions
                    ks = range(k, min(n, k + 64))
                    texts = [t[j * chunk :] if j == n - 1 else t[j * chunk : (j + 1) * chunk + overlap] for j in ks]
                    same = pa.array([i] * len(texts))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), b.column(1).take(same), pa.array(ks, pa.int32()), pa.array([j == n - 1 for j in ks]), pa.array(texts, pa.string())], names=["rid", "row", "k", "last", "text"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], _encode_column(b.column(3), name, folder)], names=["rid", "row", "k", "ids"])

    done = rows.where(F.length("text") <= chunk).mapInArrow(short, f"rid {kind}, ids array<int>")
    # a long row gets a number of its own, so that rows with the same id stay apart
    long = rows.where(F.length("text") > chunk).select("rid", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(cut, f"rid {kind}, row long, k int, last boolean, text string")
    long = cut_lineage(long.repartition("row", "k"))
    long = stitched(long, chunk, overlap).repartition("row", "k").mapInArrow(pieces, f"rid {kind}, row long, k int, ids array<int>")
    whole = long.groupBy("rid", "row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids")).select("rid", "ids")
    return done.unionByName(whole).withColumnRenamed("rid", id_col)


def count_tokens(docs: DataFrame, id_col: str, text: str = "text", name: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """docs with a column tokens: the number of ids of its text; other columns stay (an old column tokens is replaced)."""
    kept = [c for c in docs.columns if c != "tokens"]
    at = kept.index(text)
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept), "tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            enc = encoding(name, folder)
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*kept, "tokens"])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(ids: list[int], name: str = TOKENIZER, folder: str | None = None) -> str:
    return encoding(name, folder).decode_bytes(ids).decode("utf-8", "replace")
