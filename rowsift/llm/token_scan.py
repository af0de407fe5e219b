"""Token counts of flat, unindexed token files by a separator scan.

A token file is a plain run of little-endian token ids; every document ends
with the end-of-document id, and nothing says where. Files are cut into blocks
of ``BLOCK`` tokens. In each block one vectorised comparison finds the
separators; documents that lie inside a block are complete there. What crosses
blocks is stitched from one summary row per block: a prefix scan over them
carries the place of the last separator and the running number of documents
into each block, so the document that ends at a block's first separator gets
its true start, however many blocks back that is.

Files may tag documents: the first ``TAG`` tokens of each state its id, 13
bits a token, low bits first (all ones: no id). Tags are not counted.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arc_convert import _write, read_archives
from .bpe_tree import _slices, read_ranks, tokenizer
from .common import map_frames, staged

BLOCK = 1 << 16
#: Raw bytes after which the next token file begins (at the end of a document).
FILE_BYTES = 16 << 20
TAG, TAG_BITS = 5, 13
#: Bytes of a file worked on at a time.
PIECE = 1 << 20
_NO_ID = (1 << (TAG * TAG_BITS)) - 1


def tag_of(doc_id: int | None) -> list[int]:
    value = _NO_ID if doc_id is None else doc_id & ((1 << 64) - 1)
    return [(value >> (TAG_BITS * k)) & ((1 << TAG_BITS) - 1) for k in range(TAG)]


def id_of(tag) -> int | None:
    value = sum(int(t) << (TAG_BITS * k) for k, t in enumerate(tag))
    if value == _NO_ID or len(tag) < TAG:
        return None
    return value - (1 << 64) if value >> 63 else value


def write_token_files(docs: DataFrame, path: str, *, rank_path: str, pattern: str, end_id: int, width: int = 2,
                      doc_id: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> None:
    """Encode texts and write them as tagged flat files of ``width``-byte ids.

    Tasks write what they read, nothing is shuffled; a null text is empty; a
    text of any length goes through the encoder in blocks. Files are
    gzip-compressed and end with one byte that is no whole id.
    """
    rank_file = read_ranks(rank_path)
    end = np.array([end_id], dtype=f"<u{width}").tobytes()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").cast("string").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))

    def run(frames):
        bpe = tokenizer(rank_file, pattern)
        out, size = [], 0
        for pdf in _slices(frames, "text"):
            parts: list[list] = [[] for _ in range(len(pdf))]
            for at, ids in bpe.encode_texts(pdf["text"]):
                parts[at].append(ids.astype(f"<u{width}").tobytes())
            for key, found in zip(pdf["doc_id"], parts):
                tag = np.array(tag_of(None if key is None else int(key)), dtype=f"<u{width}").tobytes()
                whole = [tag, *found, end]
                out += whole
                size += sum(map(len, whole))
                if size >= file_bytes:
                    yield pd.DataFrame({"archive": [b"".join(out)]})
                    out, size = [], 0
        if out:
            yield pd.DataFrame({"archive": [b"".join(out)]})

    _write(map_frames(rows, run, "archive binary"), path, "\n")


def raw_pieces(content: bytes, zipped: bool) -> Iterator[bytes]:
    """A file's bytes in pieces of at most ``PIECE``; gzip members one after the other.

    Of a file that ends inside a member comes what can be read."""
    if not zipped:
        yield from (content[i:i + PIECE] for i in range(0, len(content), PIECE))
        return
    unzip, feed, at = zlib.decompressobj(31), b"", 0
    while feed or at < len(content):
        if not feed:
            feed = content[at:at + PIECE]
            at += PIECE
        if unzip.eof:  # the next member, behind any padding
            feed = feed.lstrip(b"\0")
            if not feed:
                continue
            unzip = zlib.decompressobj(31)
        piece = unzip.decompress(feed, PIECE)
        feed = unzip.unused_data if unzip.eof else unzip.unconsumed_tail
        if piece:
            yield piece
    while not unzip.eof and (piece := unzip.decompress(b"", PIECE)):
        yield piece


def summarise(ids: np.ndarray, end_id: int, tag: int) -> dict:
    """What one block tells: its separators, the documents inside it, and its open ends."""
    seps = np.flatnonzero(ids == end_id)
    inside = []
    if len(seps) > 1:
        starts = seps[:-1] + 1
        sizes = seps[1:] - starts
        # a document shorter than its tag has none
        tags = ids[np.minimum(starts[:, None] + np.arange(tag), len(ids) - 1)] if tag else np.empty((len(starts), 0))
        inside = [{"start": int(s), "size": int(n), "tag": t[:n].tolist()} for s, n, t in zip(starts, sizes, tags)]
    last = int(seps[-1]) if len(seps) else None
    return {"n": len(ids), "seps": len(seps), "first_sep": int(seps[0]) if len(seps) else None, "last_sep": last,
            "head": ids[:tag].tolist(), "tail": [] if last is None else ids[last + 1:last + 1 + tag].tolist(),
            "inside": inside}


def scan_files(spark: SparkSession, path: str, *, end_id: int, width: int = 2, tagged: bool = True,
               block: int = BLOCK) -> DataFrame:
    """One row per document of the files below ``path``: ``file, nth, start,
    n_tokens, doc_id, ended``.

    ``nth`` and ``start`` (in tokens) count from 0 in each file; ``n_tokens``
    excludes separator and tag; ``ended`` is false for a last document without
    separator (none is listed when nothing follows the last separator). Empty
    documents have 0 tokens. Bytes at the end of a file that are no whole id
    are ignored. ``doc_id`` is null in files without tags. Files whose name
    ends in ``.gz`` are gunzipped, with all their members; others are ids as
    they stand, whatever their first bytes.
    """
    tag = TAG if tagged else 0
    if block <= max(tag, 1):
        raise ValueError("a block must be longer than a tag")
    step = block * width

    def run(frames):
        for pdf in frames:
            for name, content in zip(pdf["path"], pdf["content"]):
                rest, at, out = b"", 0, []
                for piece in raw_pieces(bytes(content), name.endswith(".gz")):
                    rest += piece
                    while len(rest) >= step:
                        out.append({"file": name, "block": at} | summarise(np.frombuffer(rest[:step], f"<u{width}"), end_id, tag))
                        rest, at = rest[step:], at + 1
                left = len(rest) // width
                if left:
                    out.append({"file": name, "block": at} | summarise(np.frombuffer(rest, f"<u{width}", left), end_id, tag))
                if out:
                    made = pd.DataFrame(out)
                    yield made.astype({"first_sep": "Int64", "last_sep": "Int64"})

    blocks = staged(map_frames(
        read_archives(spark, path), run,
        "file string, block long, n long, seps long, first_sep long, last_sep long, head array<int>, tail array<int>, "
        "inside array<struct<start: int, size: int, tag: array<int>>>"), "token-blocks")

    w = Window.partitionBy("file").orderBy("block")
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("block") * block
    slim = blocks.select("file", "block", "n", "seps", "first_sep", "last_sep", "head", "tail")
    open_end = F.when(F.col("seps") > 0, F.struct(
        (base + F.col("last_sep") + 1).alias("at"),
        F.slice(F.concat("tail", F.coalesce(F.lead("head").over(w), F.array().cast("array<int>"))), 1, max(tag, 1)).alias("tag")))
    scanned = (slim.withColumn("open", open_end)
               .withColumn("before", F.last("open", ignorenulls=True).over(earlier))
               .withColumn("docs_before", F.coalesce(F.sum("seps").over(earlier), F.lit(0)))
               .withColumn("at_first", F.first("head").over(w))
               .withColumn("is_last", F.lead("block").over(w).isNull()))
    start = F.coalesce(F.col("before.at"), F.lit(0))
    lead_tag = F.coalesce(F.col("before.tag"), F.col("at_first"))
    crossing = scanned.where("seps > 0").select(
        "file", F.col("docs_before").alias("nth"), start.alias("start"),
        (base + F.col("first_sep") - start).alias("size"), lead_tag.alias("tag"), F.lit(True).alias("ended"))
    own = F.col("seps") > 0
    tail_start = F.when(own, F.col("open.at")).otherwise(start)
    open_docs = scanned.where("is_last").select(
        "file", (F.col("docs_before") + F.col("seps")).alias("nth"), tail_start.alias("start"),
        (base + F.col("n") - tail_start).alias("size"),
        F.when(own, F.col("open.tag")).otherwise(lead_tag).alias("tag"), F.lit(False).alias("ended")).where("size > 0")
    inner = (blocks.where("seps > 1").join(scanned.select("file", "block", "docs_before"), ["file", "block"])
             .select("file", "block", "docs_before", F.posexplode("inside").alias("k", "d"))
             .select("file", (F.col("docs_before") + 1 + F.col("k")).alias("nth"), (base + F.col("d.start")).alias("start"),
                     F.col("d.size").cast("long").alias("size"), F.col("d.tag").alias("tag"), F.lit(True).alias("ended")))
    docs = crossing.unionByName(inner).unionByName(open_docs)
    if not tagged:
        return docs.select("file", "nth", "start", F.col("size").alias("n_tokens"),
                           F.lit(None).cast("long").alias("doc_id"), "ended")
    tags = F.slice("tag", 1, F.least(F.lit(tag), F.greatest(F.col("size").cast("int"), F.lit(0))))
    value = F.lit(0).cast("long")
    for k in range(TAG):  # the top token holds 12 bits of a 64-bit id
        value = value.bitwiseOR(F.shiftleft(F.get(F.col("tag"), F.lit(k)).cast("long"), TAG_BITS * k))
    has = (F.col("size") >= tag) & (F.get(F.col("tag"), F.lit(TAG - 1)) < (1 << (64 - TAG_BITS * (TAG - 1))))
    return docs.withColumn("tag", tags).select(
        "file", "nth", "start", F.greatest(F.col("size") - tag, F.lit(0)).alias("n_tokens"),
        F.when(has, value).alias("doc_id"), "ended")


def token_counts(docs: DataFrame, path: str, *, rank_path: str, pattern: str, end_id: int, **names) -> DataFrame:
    """Write ``docs`` as flat files below ``path`` and count their tokens by scanning them.

    ``doc_id, n_tokens`` per row of ``docs``: a null text has 0 tokens, a null
    id stays null, repeated rows each give a row, an empty table an empty one;
    a text of any length is encoded and scanned whole, in blocks; further
    columns are not read.
    """
    write_token_files(docs, path, rank_path=rank_path, pattern=pattern, end_id=end_id, **names)
    return scan_files(docs.sparkSession, path, end_id=end_id).select("doc_id", "n_tokens")
