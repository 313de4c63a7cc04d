"""Fill-in-middle transformation by block rotation.

A text is cut into prefix, middle and suffix. Its bytes, with a sentinel before each part, lie in one bytearray as
`<P>`prefix`<M>`middle`<S>`suffix; two adjacent blocks are exchanged in place by three reversals, which gives either form,
and the same exchange backwards restores the text. Cuts and form are drawn from a hash of the id, so that reruns agree
and nothing is shuffled.

Defined results: NULL text is empty; an empty text, or one that holds a sentinel, stays plain; a NULL id draws as
an empty one; repeated rows give equal rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.common import read

#: What marks prefix, suffix and middle.
P, S, M = b"<P>", b"<S>", b"<M>"
MARK = 3


@dataclass(frozen=True)
class FimParams:
    """Of 100 texts, so many are transformed, and so many of those suffix first."""

    transformed: int = 90
    suffix_first: int = 20
    seed: int = 1


def exchange(buf: bytearray, start: int, middle: int, end: int) -> None:
    """Exchanges buf[start:middle] and buf[middle:end] in place: each block is reversed, then both together."""
    view = np.frombuffer(buf, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        view[a:b] = view[a:b][::-1]


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def transform(text: str, doc_id: int | None, p: FimParams = FimParams()) -> tuple[str, int | None, int | None, bytes]:
    """form, code points of prefix and middle (None if plain), output."""
    raw, n = text.encode(), len(text)
    a, b, c, d = draws(doc_id, p.seed)
    if not raw or P in raw or S in raw or M in raw or c % 100 >= p.transformed:
        return "plain", None, None, raw
    first, second = sorted((a % (n + 1), b % (n + 1)))
    at = len(text[:first].encode())
    to = at + len(text[first:second].encode())
    buf = bytearray(raw)
    buf[to:to], buf[at:at], buf[0:0] = S, M, P  # from the back, so that the cuts stay where they are
    at, to = at + MARK, to + 2 * MARK
    if d % 100 < p.suffix_first:
        exchange(buf, 0, to, len(buf))
        return "spm", first, second - first, bytes(buf)
    exchange(buf, at, to, len(buf))
    return "psm", first, second - first, bytes(buf)


def restore(output: bytes, form: str) -> bytes:
    """The text again, from an output and its form alone: a transformed text holds each sentinel once."""
    if form == "plain":
        return output
    buf = bytearray(output)
    suffix, end = buf.index(S), len(buf)
    cut = buf.index(M if form == "psm" else P, suffix)
    exchange(buf, suffix, cut, end)
    at, to = buf.index(M), end - (cut - suffix)
    del buf[to : to + MARK], buf[at : at + MARK], buf[:MARK]
    return bytes(buf)


def fill_in_middle(docs: DataFrame, params: FimParams = FimParams()) -> DataFrame:
    """(doc_id, text) -> doc_id, n, form, prefix_chars, middle_chars, output."""
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                rows.append((len(text), *transform(text, i, params)))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")


def restored(transformed: DataFrame) -> DataFrame:
    """Adds `restored`, the text rebuilt from output and form."""
    names = [*transformed.columns, "restored"]
    form, output = transformed.columns.index("form"), transformed.columns.index("output")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restore(o.as_py(), f.as_py()) for o, f in zip(b.column(output), b.column(form))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], names)

    return transformed.mapInArrow(run, transformed.withColumn("restored", F.col("output")).schema)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = restored(fill_in_middle(read(spark, sf_dir, "documents")))
    sha = lambda c: F.sha2(F.col(c), 256).alias(f"{c}_sha256")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
g AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS b, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS e FROM d),
f AS (
  SELECT doc_id, t, n, least(a, b) AS p, greatest(a, b) AS q,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM g
), x AS (SELECT *, substr(t, 1, p) AS pre, substr(t, p + 1, q - p) AS mid, substr(t, q + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM x
"""
