"""The readers of JSON, XBRL and feeds as table functions for SQL, and numbers as Python writes them.

    register(spark)
    spark.sql("SELECT doc_id, f.* FROM docs, LATERAL json_flatten(text) f")

Each row's text is read by itself where the row is; batches of rows travel as Arrow. A null or broken text gives no rows.
A table function is called anew for each row, which costs a millisecond; over large tables the same entities come as an array of
whole batches at a time:

    spark.sql("SELECT doc_id, f.* FROM docs LATERAL VIEW inline(json_flatten_all(text)) f")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import adapters

#: What a function returns: the columns of an entity behind the document's number.
RETURNS = adapters.SCHEMA.split(", ", 1)[1]
READERS = {"json_flatten": adapters.json_leaves, "xbrl_facts": adapters.xbrl_facts, "feed_items": adapters.feed_items}


def table_function(read: Callable[[str], list[tuple]]):
    """A table function of one text whose rows are the entities that `read` finds, numbered in their order."""

    class Reader:
        def eval(self, text: str) -> Iterator[tuple]:
            for k, (*entity, metadata) in enumerate(read(text or "")):
                yield (k, *entity, dict(metadata))

    return F.udtf(Reader, returnType=RETURNS, useArrow=True)


def array_function(read: Callable[[str], list[tuple]]):
    """A function of a column of texts whose values are arrays of the same rows: one call for a batch of texts."""
    names = [x.split()[0] for x in RETURNS.split(", ")]
    kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.map_(pa.string(), pa.string()))
    row = pa.struct(list(zip(names, kinds, strict=True)))

    def entities(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for text in texts.to_pylist():
            rows += [(k, *e) for k, e in enumerate(read(text or ""))]
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        values = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], fields=list(row))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return F.arrow_udf(entities, f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in RETURNS.split(', '))}>>")


#: A double as Python writes it, as an expression of SQL alone: whole digits between 1e-4 and 1e16, two digits of an exponent
#: elsewhere (see columns.float_text).
PY_STR = """CREATE OR REPLACE TEMPORARY FUNCTION py_str(v DOUBLE) RETURNS STRING RETURN
  CASE WHEN v IS NULL THEN NULL WHEN isnan(v) THEN 'nan' WHEN v = double('inf') THEN 'inf' WHEN v = double('-inf') THEN '-inf'
    WHEN instr(string(v), 'E') = 0 THEN string(v)
    WHEN int(split_part(string(v), 'E', 2)) BETWEEN -4 AND 15 THEN regexp_replace(regexp_replace(string(try_cast(string(v) AS DECIMAL(38, 22))), '0+$', ''), '[.]$', '.0')
    ELSE regexp_replace(split_part(string(v), 'E', 1), '[.]0$', '') || 'e' || if(int(split_part(string(v), 'E', 2)) < 0, '-', '+') || lpad(string(abs(int(split_part(string(v), 'E', 2)))), greatest(2, length(string(abs(int(split_part(string(v), 'E', 2)))))), '0')
  END"""


def register(spark: SparkSession) -> None:
    for name, read in READERS.items():
        spark.udtf.register(name, table_function(read))
        spark.udf.register(f"{name}_all", array_function(read))
    spark.sql(PY_STR)
