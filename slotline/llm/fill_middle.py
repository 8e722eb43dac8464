"""Fill-in-middle transformation: a text is cut at two token boundaries and its parts are put in another order.

Method. A text's tokens are runs of ASCII letters and single other code points. The places before, between and after
them, in code points, are kept in a compressed set (``boundary_set``) whose select gives both cuts. The cuts and the form
come from a hash of the document's id, so that a task that runs again makes the same rows. The middle stands last,
behind the suffix (``psm``) or behind the prefix (``spm``); ``plain`` texts stay as they are. No text that holds one of
the three marks is cut, so the marks of an output are its own and ``restored`` takes it apart again.

Null texts are empty texts. Empty texts are plain. Texts of any length are cut whole. A null id hashes as the empty text;
repeated rows get the same output. An empty table gives an empty result. Extra columns pass through ``cut``; its own
columns replace inputs of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotline.llm.boundary_set import BoundarySet
from slotline.llm.common import extended, numbered, release, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
CUT_OF_100, SPM_OF_100 = 90, 20  #: of a hundred texts so many are cut, and of a hundred cut ones so many are spm
SEED = "1:"
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundaries(text: str) -> np.ndarray:
    """The places between a text's tokens, its start and its end, in code points."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letter = ((points | 32) - np.uint32(97)) < 26
    apart = np.ones(len(points) + 1, dtype=bool)
    if len(points):
        apart[1:-1] = ~(letter[1:] & letter[:-1])
    return np.flatnonzero(apart)


def hashes(doc_id: int | None) -> tuple[int, ...]:
    """Four 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{SEED}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def transformed(doc_id: int | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    text = text or ""
    places = BoundarySet(boundaries(text))
    n = len(places) - 1
    h1, h2, h3, h4 = hashes(doc_id)
    if not text or h3 % 100 >= CUT_OF_100 or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = places.select(first), places.select(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SPM_OF_100:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def cut(documents: DataFrame, rows: int = 256) -> DataFrame:
    """Every input row with (n, form, prefix_chars, middle_chars, output). ``documents``: doc_id, text, others.

    ``rows``: texts that a task takes at once.
    """
    documents = documents.drop(*ADDED)
    named = documents.columns
    documents = numbered(documents, ("doc_id", "text"))
    names = documents.columns
    schema = extended(documents, n="long", form="string", prefix_chars="long", middle_chars="long", output="string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            ids, texts = batch.schema.get_field_index("doc_id"), batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                made = [transformed(*x) for x in zip(part.column(ids).to_pylist(), part.column(texts).to_pylist())]
                new = [pa.array(list(c), k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*names, *ADDED])

    return documents.mapInArrow(run, schema).toDF(*named, *ADDED)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of."""
    after = lambda s, mark: F.substr(s, F.instr(s, mark) + len(mark))
    before = lambda s, mark: F.substr(s, F.lit(1), F.instr(s, mark) - 1)
    middle = after(output, MIDDLE)
    head = before(output, MIDDLE)
    psm = F.concat(before(after(head, PREFIX), SUFFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, before(after(head, SUFFIX), PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cut(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


_HASH = "CAST('0x' || substr(sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8) AS BIGINT)"
SQL = f"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
    {_HASH.format(1)} AS h1, {_HASH.format(9)} AS h2, {_HASH.format(17)} AS h3, {_HASH.format(25)} AS h4 FROM documents),
    sized AS (SELECT *, len(w) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
    parts AS (SELECT *, array_to_string(w[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p, array_to_string(w[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
    array_to_string(w[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s FROM sized)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
