"""Fill-in-middle transformation as a pyarrow.compute pipeline.

Texts are cut into units as list arrays, flattened with the indices of their rows, numbered within
their rows, filtered by role, put back into lists and joined; no text is looked at one by one. The
draws of a row come from a hash of its key, so a rerun after a lost executor gives the same rows.
The text is rebuilt from output and form by Spark's own functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from kickline.llm.common import batched, table
from kickline.llm.registry import query

#: Markers of the three parts (fixed by the contract).
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit is a word with the white space before it, or the white space at the end (fixed by the contract).
UNIT = rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: A byte that no UTF-8 text holds.
CUT = b"\xff"
OUT = ["n", "form", "prefix_chars", "middle_chars", "output"]


def draws(key: str, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the key's decimal form; a null key draws like an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def _mod(x: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(x, pc.multiply(pc.divide(x, by), by))


def _text(x: str) -> pa.Scalar:
    return pa.scalar(x.encode(), pa.large_binary())


def rearranged(texts: pa.Array, h1: pa.Array, h2: pa.Array, h3: pa.Array, h4: pa.Array, fim_percent: int, spm_percent: int) -> list[pa.Array]:
    """The columns OUT of a batch of UTF-8 texts (large binary, no nulls)."""
    rows = len(texts)
    units = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\0" + CUT), pattern=CUT)
    n = pc.cast(pc.subtract(pc.list_value_length(units), 1), pa.int64())  # what follows the last cut is empty
    parent, flat = pc.list_parent_indices(units), pc.list_flatten(units)
    starts = pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(units).to_numpy(), dtype=np.int64)])[:-1])
    ordinal = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int64)), pc.take(starts, parent))

    a, b = _mod(h1, pc.add(n, 1)), _mod(h2, pc.add(n, 1))
    low, high = pc.min_element_wise(a, b), pc.max_element_wise(a, b)
    after_low, after_high = (pc.greater_equal(ordinal, pc.take(x, parent)) for x in (low, high))
    roles = (pc.invert(after_low), pc.and_not(after_low, after_high), after_high)
    # the empty piece after the last cut counts to the suffix
    sizes = (low, pc.subtract(high, low), pc.add(pc.subtract(n, high), 1))
    empty = _text("")
    parts = []
    for role, size in zip(roles, sizes, strict=True):
        offsets = pa.array(np.concatenate([[0], np.cumsum(size.to_numpy(), dtype=np.int64)]).astype(np.int32))
        parts.append(pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(flat, role)), empty))
    prefix, middle, suffix = parts

    marked = pc.or_(pc.or_(*(pc.match_substring(texts, x.encode()) for x in (PREFIX, SUFFIX))), pc.match_substring(texts, MIDDLE.encode()))
    plain = pc.or_(pc.or_(marked, pc.equal(n, 0)), pc.greater_equal(_mod(h3, pa.array(np.full(rows, 100))), fim_percent))
    spm = pc.less(_mod(h4, pa.array(np.full(rows, 100))), spm_percent)
    p, s, m = _text(PREFIX), _text(SUFFIX), _text(MIDDLE)
    output = pc.if_else(plain, texts, pc.if_else(spm, pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty),
                                                 pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty)))
    form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
    none = pa.scalar(None, pa.int64())
    chars = [pc.if_else(plain, none, pc.cast(pc.utf8_length(pc.cast(x, pa.large_string())), pa.int64())) for x in (prefix, middle)]
    return [n, pc.cast(form, pa.string()), *chars, pc.cast(output, pa.large_string())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """key, n, form, prefix_chars, middle_chars and output, one row per row of `docs`.

    n counts the units of the whole text. Rows whose third draw modulo 100 is below `fim_percent` are cut at two
    unit borders and written suffix first (spm, below `spm_percent` of the fourth draw) or prefix first (psm); the
    others, texts without a unit and texts that hold a marker stay plain, without character counts. A null
    text is empty; a null key draws like an empty key; rows that share a key share the draws, repeated rows come out
    repeated. Other columns of `docs` are not read, whatever their names; `key` may be of any type
    that has a decimal form, but not named like an output column. An empty table gives an empty table.
    """
    if key in OUT:
        raise ValueError(f"the key cannot be named like an output column: {key}")
    named = f"`{key.replace('`', '``')}`"
    source = docs.select(F.col(named).alias("key"), F.col(f"`{text.replace('`', '``')}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batched(batches, 8_000_000):
            texts = pc.fill_null(pc.cast(pc.cast(batch.column(1), pa.binary()), pa.large_binary()), b"")
            found = rearranged(texts, *batch.columns[2:], fim_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["key", *OUT])

    kind = dict(source.dtypes)["key"]
    out = source.select("key", "text", *draws("key", seed)).mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.select(F.col("key").alias(key), *OUT)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that `output` was made of, from it and its form alone.

    The parts hold no marker, and a marker cannot arise where a part meets one, so the outermost markers are the borders.
    """
    head = F.substring_index(output, MIDDLE, 1)
    middle = F.substring_index(output, MIDDLE, -1)

    def pieces(first: str, second: str) -> tuple[Column, Column]:
        return F.expr(f"substring(substring_index(`{output}`, '{second}', 1), {len(first) + 1})"), F.substring_index(head, second, -1)
    psm_prefix, psm_suffix = pieces(PREFIX, SUFFIX)
    spm_suffix, spm_prefix = pieces(SUFFIX, PREFIX)
    return (F.when(F.col(form) == "psm", F.concat(psm_prefix, middle, psm_suffix))
            .when(F.col(form) == "spm", F.concat(spm_prefix, middle, spm_suffix)).otherwise(F.col(output)))


@query("op13_fill_in_middle", r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS x,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents
), drawn AS (
  SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::UBIGINT % (len(u) + 1)::UBIGINT AS a, ('0x' || substr(x, 9, 8))::UBIGINT % (len(u) + 1)::UBIGINT AS b,
         CASE WHEN len(u) = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(x, 17, 8))::UBIGINT % 100 >= 50 THEN 'plain'
              WHEN ('0x' || substr(x, 25, 8))::UBIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT *, array_to_string(u[1:least(a, b)::BIGINT], '') AS p, array_to_string(u[least(a, b)::BIGINT + 1:greatest(a, b)::BIGINT], '') AS m,
         array_to_string(u[greatest(a, b)::BIGINT + 1:], '') AS s
  FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts""")
def op13_fill_in_middle(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
