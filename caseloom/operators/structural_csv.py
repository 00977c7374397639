"""Comma-separated lines read by a structural index; lines that cannot be read come out with the reason.

A batch of lines is one byte buffer. A mask of its quotes and the parity of their running count tell which
commas delimit and which line breaks end a record, so fields are located for the whole batch at once.
Types are then checked by Spark expressions against the field_spec of the line's module.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTE, COMMA, LF, CR = 34, 44, 10, 13

#: Rows of field_spec up to which it is sent to every executor; a larger one is joined by shuffle.
SPEC_BROADCAST_ROWS = 20_000

HEAD, TAIL = ("case_id", "short_description", "description"), ("tags", "notes")

#: The spellings of a boolean.
BOOL_TRUE, BOOL_FALSE = ("true", "True", "TRUE", "1"), ("false", "False", "FALSE", "0")
INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MONEY = r"^-?\$?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]{1,2})?$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def structural_index(lines: pa.Array, records: bool = False) -> tuple[pa.Array, pa.Array]:
    """(whether the quoting holds, the unquoted fields) of each line; both null for a null line.

    With records, a line may be a whole text, and its fields come as a list for each record.

    Field i of a line runs between two unquoted commas. Quoting holds if each quote that opens stands at a
    field's start or doubles the one before it, each that closes stands at a field's end or is doubled by the
    next, and their number is even. An unquoted line break ends the record; if more follows, its fields count
    on, so that the line ends up with a wrong number of columns.
    """
    lines = lines.cast(pa.large_string())
    n = len(lines)
    if n == 0:
        return pa.array([], pa.bool_()), pa.array([], pa.list_(pa.string()))
    blank = pc.fill_null(lines, "")
    blank = pa.concat_arrays([blank]) if blank.offset else blank
    offsets = np.frombuffer(blank.buffers()[1], np.int64, n + 1)
    raw = blank.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(data))

    quote = data == QUOTE
    running = np.concatenate([[0], np.cumsum(quote)])
    inside = ((running[:-1] - running[offsets[:-1]][row]) & 1).astype(bool)
    ends_record = ((data == LF) | (data == CR)) & ~inside
    # line breaks at the very end close the record and hold nothing
    solid = np.where(ends_record, -1, at)
    last = np.full(n, -1)
    np.maximum.at(last, row, solid)
    tail = ends_record & (at > last[row])
    delim = ((data == COMMA) & ~inside) | (ends_record & ~tail)

    first_byte, last_byte = at == offsets[:-1][row], at == offsets[1:][row] - 1
    before = np.concatenate([[False], delim[:-1]]) | first_byte
    after = np.concatenate([delim[1:] | tail[1:], [False]]) | last_byte
    quote_before = np.concatenate([[False], quote[:-1] & inside[:-1]]) & ~first_byte
    quote_after = np.concatenate([quote[1:], [False]]) & ~last_byte
    opens, closes = quote & ~inside, quote & inside
    wrong = (opens & ~(before | quote_before)) | (closes & ~(after | quote_after))
    broken = np.bincount(row[wrong], minlength=n) > 0
    broken |= ((running[offsets[1:]] - running[offsets[:-1]]) & 1).astype(bool)

    # what remains of the bytes: no delimiters, no enclosing quotes, one of each doubled pair
    keep = ~(delim | tail | closes | (opens & before))
    kept = np.concatenate([[0], np.cumsum(keep)])
    cuts = np.flatnonzero(delim)
    cut_rows = row[cuts]
    per_row = np.bincount(cut_rows, minlength=n) + 1
    # a field ends at each delimiter and at the end of its row; they interleave in byte order
    ends = np.sort(np.concatenate([cuts * 2 + 1, offsets[1:] * 2]), kind="stable") // 2
    field_offsets = np.concatenate([[0], kept[ends]]).astype(np.int32)
    values = pa.StringArray.from_buffers(len(ends), pa.py_buffer(field_offsets), pa.py_buffer(data[keep].tobytes()))
    fields = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), values)
    if records:
        ends_rows = np.cumsum(per_row)
        closes_record = np.zeros(len(ends), bool)
        closes_record[ends_rows - 1] = True
        closes_record[np.arange(len(cuts)) + cut_rows] |= ends_record[cuts]
        bounds = np.concatenate([[0], np.flatnonzero(closes_record) + 1])
        inner = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
        fields = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.searchsorted(bounds, ends_rows)]), pa.int32()), inner)
    null = np.asarray(pc.is_null(lines))
    fine = pa.array(~broken, mask=null)
    return fine, pc.if_else(pc.and_(pc.fill_null(fine, False), pc.is_valid(lines)), fields, pa.scalar(None, fields.type))


def split_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """df with fine BOOLEAN and fields ARRAY<STRING> (trimmed; null where the quoting is broken) in place of line."""
    others = [c for c in df.columns if c != line]
    out = df.select(*others).withColumns({"__fine": F.lit(True), "__fields": F.array(F.lit(""))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fine, fields = structural_index(batch.column(0))
            flat = pa.ListArray.from_arrays(fields.offsets, pc.utf8_trim_whitespace(fields.values), mask=pc.is_null(fields)) if len(fields) else fields
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fine, flat], names=[*others, "__fine", "__fields"])

    schema = out.schema
    for f in schema.fields:
        f.nullable = True
    return df.select(line, *others).mapInArrow(run, schema).withColumnsRenamed({"__fine": "fine", "__fields": "fields"})


def split_records(df: DataFrame, text: str = "text") -> DataFrame:
    """df with records ARRAY<ARRAY<STRING>> in place of text: its fields, trimmed, record by record; null where the quoting is broken."""
    others = [c for c in df.columns if c != text]
    schema = df.select(*others).withColumn("__records", F.array(F.array(F.lit("")))).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = structural_index(batch.column(0), records=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], rows], names=[*others, "__records"])

    for f in schema.fields:
        f.nullable = True
    out = df.select(text, *others).mapInArrow(run, schema).withColumnRenamed("__records", "records")
    return out.withColumn("records", F.transform("records", lambda r: F.transform(r, lambda x: F.trim(x))))


def layout(field_spec: DataFrame) -> DataFrame:
    """(module, columns): per module the columns of its lines in order, each with type, need and allowed values."""
    of = lambda name, kind, optional: F.struct(
        F.lit(name).alias("column_name"), F.lit(kind).alias("leaf_type"), F.lit(optional).alias("optional"), F.lit(None).cast("array<string>").alias("enum_values")
    )
    spec = field_spec.groupBy("module").agg(
        F.array_sort(
            F.collect_list(F.struct("pos", "column_name", "leaf_type", F.coalesce("optional", F.lit(False)).alias("optional"), "enum_values"))
        ).alias("spec")
    )
    middle = F.transform("spec", lambda s: F.struct(s["column_name"].alias("column_name"), s["leaf_type"].alias("leaf_type"), s["optional"].alias("optional"), s["enum_values"].alias("enum_values")))
    return spec.select(
        "module",
        F.concat(F.array(*[of(c, "string", False) for c in HEAD]), middle, F.array(*[of(c, "string", True) for c in TAIL])).alias("columns"),
    )


def no_module() -> Column:
    """The columns of a line whose module has no field_spec."""
    return F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit("string").alias("leaf_type"), F.lit(c in TAIL).alias("optional"), F.lit(None).cast("array<string>").alias("enum_values")) for c in HEAD + TAIL])


def with_layout(rows: DataFrame, field_spec: DataFrame) -> DataFrame:
    """rows with the columns of their module, the five common ones where it has no field_spec."""
    spec = layout(field_spec)
    few = field_spec.limit(SPEC_BROADCAST_ROWS + 1).count() <= SPEC_BROADCAST_ROWS
    return rows.join(F.broadcast(spec) if few else spec, "module", "left").withColumn("columns", F.coalesce("columns", no_module()))


def value_fault(value: Column, kind: Column, optional: Column, allowed: Column) -> Column:
    """Why a trimmed value does not fit its column, or null."""
    bad = lambda leaf, fits: F.when((kind == leaf) & ~fits, f"INVALID_{leaf.upper()}")
    return F.when(value == "", F.when(~optional, "MISSING_REQUIRED")).otherwise(
        F.coalesce(
            bad("bool", value.isin(*BOOL_TRUE, *BOOL_FALSE)),
            bad("int", value.rlike(INT)),
            bad("float", value.rlike(FLOAT)),
            bad("money", value.rlike(MONEY)),
            bad("date", value.rlike(DATE) & value.try_cast("date").isNotNull()),
            bad("enum", F.coalesce(F.array_contains(allowed, value), F.lit(False))),
        )
    )


def read_cases(lines: DataFrame, field_spec: DataFrame) -> DataFrame:
    """The case lines with fault (BROKEN_QUOTING, WRONG_COLUMN_COUNT or null) and their columns and fields.

    Left out as no cases: row_num 1, null lines, lines whose first field is ``#desc``, and lines of the right
    number of columns with nothing filled after the first three. A module without field_spec has only the five
    common columns. Extra columns of ``lines`` are ignored.
    """
    rows = lines.select("line_id", "import_file", "module", "row_num", "received_at", "line").where(F.col("line").isNotNull() & ~F.col("row_num").eqNullSafe(1) & ~F.col("line").rlike(r'^\s*"?\s*#desc\s*"?\s*(,|$)'))
    parsed = with_layout(split_lines(rows), field_spec)
    counted = F.size("fields") == F.size("columns")
    stub = counted & F.forall(F.slice("fields", 4, F.greatest(F.size("fields"), F.lit(1))), lambda v: v == "")
    return (
        parsed.withColumn("fault", F.when(~F.col("fine"), "BROKEN_QUOTING").when(~counted, "WRONG_COLUMN_COUNT"))
        .where(~F.coalesce(stub, F.lit(False)))
        .select("line_id", "import_file", "module", "row_num", "received_at", "fault", "columns", "fields")
    )


def failures(lines: DataFrame, field_spec: DataFrame) -> DataFrame:
    """(line_id, column_name, reason), one row for each failure; a line delivered several times counts once.

    Only failures are shuffled, after duplicates within each task are gone. An empty table gives no rows.
    """
    read = read_cases(lines, field_spec)
    whole = F.when(F.col("fault").isNotNull(), F.array(F.struct(F.lit("").alias("column_name"), F.col("fault").alias("reason"))))
    cells = F.filter(
        F.zip_with("columns", "fields", lambda c, v: F.struct(c["column_name"].alias("column_name"), value_fault(v, c["leaf_type"], c["optional"], c["enum_values"]).alias("reason"))),
        lambda x: x["reason"].isNotNull(),
    )
    return read.select("line_id", F.inline(F.coalesce(whole, cells))).distinct()


#: The typed maps of a loaded case: name, leaf types held there, and the typed value.
def _typed(value: Column, kind: Column) -> Column:
    money = F.regexp_replace(value, r"[$,]", "").try_cast("decimal(38,2)")
    filled = F.when(value != "", value)
    return F.struct(
        F.when(kind == "bool", filled.isin(*BOOL_TRUE)).alias("flag"),
        F.when(kind == "int", filled.try_cast("decimal(38,0)")).alias("whole"),
        F.when(kind == "float", filled.try_cast("double")).alias("number"),
        F.when(kind == "money", F.when(value != "", money)).alias("amount"),
        F.when(kind == "date", filled.try_cast("date")).alias("day"),
        F.when(kind == "list", F.filter(F.transform(F.split(filled, ";"), lambda x: F.trim(x)), lambda x: x != "")).alias("items"),
        filled.alias("text"),
    )


def load_cases(lines: DataFrame, field_spec: DataFrame) -> DataFrame:
    """The lines without failure as typed rows: one per line_id, ``cells`` holding each column's typed value.

    Of several deliveries the earliest is kept (ties: any, the line being the same). Whole numbers are
    DECIMAL(38,0) and amounts DECIMAL(38,2); what lies beyond them has its text only. Text is the trimmed value as
    it was written, whatever its type.
    """
    read = read_cases(lines, field_spec).where(F.col("fault").isNull())
    bad = F.exists(F.zip_with("columns", "fields", lambda c, v: value_fault(v, c["leaf_type"], c["optional"], c["enum_values"])), lambda x: x.isNotNull())
    good = read.where(~F.coalesce(bad, F.lit(False)))
    # the columns of a module are not shuffled with its lines but looked up again behind the shuffle
    first = good.groupBy("line_id").agg(F.min_by(F.struct("import_file", "module", "row_num", "fields"), F.struct("received_at", "import_file")).alias("r"))
    return with_layout(first.withColumn("module", F.col("r.module")), field_spec).select(
        "line_id",
        "r.import_file",
        "r.module",
        "r.row_num",
        *[F.get("r.fields", F.lit(i)).alias(c) for i, c in enumerate(HEAD)],
        F.zip_with("columns", "r.fields", lambda c, v: F.struct(c["column_name"].alias("column_name"), c["leaf_type"].alias("leaf_type"), _typed(v, c["leaf_type"]).alias("value"))).alias("cells"),
    )
