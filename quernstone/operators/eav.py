"""Entity-attribute-value rows into one typed row per entity.

Plan: names are spelled as declared by a join with the declarations, which are the result's schema and so fit the driver; values are typed by native
expressions; one aggregation keeps each cell's latest value; entities are hash-bucketed over the partitions; in each bucket an
Arrow function dictionary-encodes entity and attribute and scatters the values into one numpy array per column type.

Defined cases: null entity or name: no cell. Undeclared name: no column, but its entity gets a row. A placeholder or a value that doesn't denote one of the
declared type: no value; the latest usable value of the cell holds, equal times are resolved by the greater value. An entity
whose rows hold no usable value still gets its row of nulls. Two rows that are equal count once. Columns beside those read are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.session import bounded, split_hot

#: Texts that stand for a missing value.
PLACEHOLDERS = ["", "-", "--", "n/a", "na", "none", "null", "tbd", "unknown", "see notes", "soon", "latest", "?"]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
TYPES = {"str": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "date": T.DateType()}
_NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?$"
_ARROW = {"str": pa.string(), "int": pa.int64(), "float": pa.float64(), "date": pa.date32()}
_BLANK = r"^[\s ]+|[\s ]+$"


def spelling(name: Column) -> Column:
    """What all spellings of one declared name have in common: its letters and digits in lower case."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, _BLANK, "")


def digits_of(text: Column) -> Column:
    """A number's text without blanks and grouping marks."""
    return F.regexp_replace(stripped(text), r"(?<=\d)[,_](?=\d)", "")


def number_of(text: Column) -> Column:
    """The number a text denotes; commas and underscores between digits only group them."""
    plain = digits_of(text)
    return F.when(plain.rlike(_NUMBER), plain.try_cast("double"))


def whole_of(text: Column) -> Column:
    """The whole number a text denotes; zero decimals are allowed, and an exponent if what it makes is whole."""
    plain = F.regexp_replace(digits_of(text), r"(?<=\d)\.0*$", "")
    number = plain.try_cast("decimal(38,6)")
    return F.when(plain.rlike(_NUMBER), F.when(number == F.floor(number), number).try_cast("bigint"))


def date_of(text: Column) -> Column:
    """The calendar date a text denotes: year first with any separator or none, with or without a time; day or month first where a
    month name, a dot or a number over 12 settles which is which. One chain of replacements brings every form to year-month-day."""
    time = r"(?:[t ]\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?:z|utc|[+-]\d{2}:?\d{2})?)?$"
    month, over, to12 = rf"({'|'.join(MONTHS)})[a-z]*", r"(1[3-9]|2\d|3[01])", r"(0?[1-9]|1[0-2])"
    t = F.lower(stripped(text))
    for pattern, order in (
        (rf"^(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}}){time}", "$1-$3-$4"),
        (r"^((?:1[6-9]|2[01])\d{2})(\d{2})(\d{2})(?:t\d{4,6}z?)?$", "$1-$2-$3"),
        (rf"^(?:[a-z]{{3,9}}\.?,? )?(\d{{1,2}})(?:st|nd|rd|th|\.)?[ -]{month}\.?,?[ -](\d{{4}}){time}", "$3-$2-$1"),
        (rf"^(?:[a-z]{{3,9}}, )?{month}\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){time}", "$3-$1-$2"),
        (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}){time}", "$3-$2-$1"),
        (rf"^{over}[-/]{to12}[-/](\d{{4}}){time}", "$3-$2-$1"),
        (rf"^{to12}[-/]{over}[-/](\d{{4}}){time}", "$3-$1-$2"),
        (rf"^{to12}[-/]\1[-/](\d{{4}}){time}", "$2-$1-$1"),
    ):
        t = F.regexp_replace(t, pattern, order)
    for k, name in enumerate(MONTHS):
        t = F.replace(t, F.lit(f"-{name}-"), F.lit(f"-{k + 1}-"))
    return F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), t.try_cast("date"))


def typed_cells(fields: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per row of FIELDS: unit_id, name as declared (null if it isn't), its value in the column of its type (s, i, f or d),
    `misplaced`: whether the value denotes one of the declared type but stands outside that type's own column."""
    declared = specs.select("name", "field_type").distinct().collect()
    kinds = fields.sparkSession.createDataFrame([(r["name"], r["field_type"]) for r in declared if r["name"] is not None], "name string, kind string")
    kinds = kinds.select(F.col("name").alias("_declared"), "kind", spelling(F.col("name")).alias("_key"))
    f = fields.select("unit_id", "v_text", F.col("v_num").cast("double").alias("v_num"), F.col("v_int").cast("bigint").alias("v_int"), F.col("v_date").cast("string").alias("v_date"), "written_at", spelling(F.col("name")).alias("_key"))
    f = f.filter("unit_id is not null").join(bounded(kinds), "_key", "left")
    kind, text, day = F.col("kind"), F.col("v_text"), F.col("v_date")
    num = F.when(~(F.isnan("v_num") | (F.abs("v_num") == float("inf"))), F.col("v_num"))
    as_text, int_text = num.cast("string"), F.col("v_int").cast("string")
    as_day = F.when(num == F.floor(num), num.cast("decimal(30,0)")).cast("string")
    f = f.select(
        "unit_id", F.col("_declared").alias("name"), "kind", "written_at", "v_int", num.alias("v_num"), "v_date",
        F.when(kind == "str", F.coalesce(text, day, int_text, as_text)).when(kind == "int", F.coalesce(as_text, text, day)).when(kind == "float", F.coalesce(int_text, text, day)).when(kind == "date", F.coalesce(day, text, int_text, as_day)).alias("_other"),
    )
    other = F.col("_other")
    f = f.select(
        "unit_id", "name", "kind", "written_at", "v_int", "v_num", "v_date",
        F.when((kind == "str") & ~F.lower(stripped(other)).isin(PLACEHOLDERS), other).alias("s"),
        F.when((kind == "int") & F.col("v_int").isNull(), whole_of(other)).alias("_i"),
        F.when((kind == "float") & F.col("v_num").isNull(), number_of(other)).alias("_f"),
        F.when(kind == "date", date_of(other)).alias("d"),
    )
    return f.select(
        "unit_id", "name", "kind", "written_at", "s", F.when(kind == "int", F.coalesce("v_int", "_i")).alias("i"), F.when(kind == "float", F.coalesce("v_num", "_f")).alias("f"), "d",
        (F.col("_i").isNotNull() | F.col("_f").isNotNull() | (F.col("d").isNotNull() & F.col("v_date").isNull())).alias("misplaced"),
    )


def _latest(cells: DataFrame) -> DataFrame:
    value = F.struct("written_at", "s", "i", "f", "d")
    usable = F.coalesce(F.col("s").isNotNull() | F.col("i").isNotNull() | F.col("f").isNotNull() | F.col("d").isNotNull(), F.lit(False))
    best = cells.groupBy("unit_id", "name").agg(F.max(F.when(usable, value)).alias("v"), F.max("misplaced").alias("misplaced"))
    return best.select("unit_id", "name", "misplaced", "v.s", "v.i", "v.f", "v.d")


def _scatter(columns: dict[str, str], out: pa.Schema):
    """The Arrow function of a hash bucket, sorted by entity: an entity that a batch ends in waits for the next one."""
    order = {name: k for k, name in enumerate(columns)}
    by_kind: dict[str, list[str]] = {}
    for name, kind in columns.items():
        by_kind.setdefault(kind, []).append(name)

    def wide(t: pa.Table) -> pa.RecordBatch:
        entity, attribute = t["unit_id"].combine_chunks().dictionary_encode(), t["name"].combine_chunks().dictionary_encode()
        rows, ids = entity.indices.to_numpy(), entity.dictionary
        names = [order.get(n, -1) for n in attribute.dictionary.to_pylist()]
        cols = np.array([*names, -1])[attribute.indices.fill_null(len(names)).to_numpy()]
        arrays = {"unit_id": ids}
        for kind, source in (("str", "s"), ("int", "i"), ("float", "f"), ("date", "d")):
            own = by_kind.get(kind, [])
            if not own:
                continue
            values = t[source].combine_chunks()
            if kind == "date":
                values = values.cast(pa.int32())
            at = np.full(len(order), -1)
            at[[order[n] for n in own]] = np.arange(len(own))
            k = np.where(cols >= 0, at[cols], -1)
            there = (k >= 0) & values.is_valid().to_numpy(zero_copy_only=False)
            grid = np.full((len(own), len(ids)), -1, np.int64)  # the row of each cell's value
            grid[k[there], rows[there]] = np.flatnonzero(there)
            if kind == "str":
                for j, n in enumerate(own):
                    arrays[n] = values.take(pa.array(grid[j], mask=grid[j] < 0))
                continue
            flat = values.fill_null(0).to_numpy()
            dense = np.zeros(grid.shape, flat.dtype)
            dense[grid >= 0] = flat[grid[grid >= 0]]
            for j, n in enumerate(own):
                arrays[n] = pa.array(dense[j], mask=grid[j] < 0).cast(_ARROW[kind])
        wrong = np.flatnonzero(t["misplaced"].to_numpy() & (cols >= 0))
        wrong = wrong[np.lexsort((cols[wrong], rows[wrong]))]
        offsets = np.searchsorted(rows[wrong], np.arange(len(ids) + 1))
        arrays["_misplaced"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(list(order), pa.string()).take(pa.array(cols[wrong])))
        return pa.RecordBatch.from_arrays([arrays[n].cast(out.field(n).type) for n in out.names], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            ids = t["unit_id"]
            last = ids[-1].as_py()
            first = t.num_rows  # where the last entity begins
            keep = pc.index(ids, last).as_py()
            first = keep if keep >= 0 else first
            if first:
                yield wide(t.slice(0, first))
            held = t.slice(first).combine_chunks().to_batches()
        if held:
            yield wide(pa.Table.from_batches(held))

    return run


def widen(fields: DataFrame, specs: DataFrame) -> DataFrame:
    """One row per unit_id of FIELDS (unit_id, name, v_text, v_num, v_int, v_date, written_at), a column of its type per declared
    name of SPECS (name, field_type), and `_misplaced`, the declared names of which some row holds its value in another type's column.

    Partitioned by entity once. An entity with very many rows is first reduced to its cells, of which there are as many as declared names."""
    declared = sorted(specs.select("name", "field_type").distinct().collect(), key=lambda r: str(r["name"]))
    columns = {r["name"]: r["field_type"] for r in declared if r["name"] is not None}
    keys = [("".join(c for c in n if c.isalnum())).lower() for n in columns]
    if len(set(keys)) < len(keys) or not set(columns.values()) <= set(TYPES) or {"unit_id", "_misplaced"} & set(columns):
        raise ValueError("declared names must be distinct in letters and digits, other than unit_id and _misplaced, and of type str, int, float or date")
    present = fields.select("unit_id", "name", "v_text", "v_num", "v_int", "v_date", "written_at")
    cold, hot = split_hot(present, ["unit_id"])
    parts = [_latest(typed_cells(cold.repartition("unit_id"), specs))]
    if hot is not None:
        parts.append(_latest(typed_cells(hot, specs)).repartition("unit_id"))
    schema = T.StructType([T.StructField("unit_id", T.StringType()), *(T.StructField(n, TYPES[k]) for n, k in columns.items()), T.StructField("_misplaced", T.ArrayType(T.StringType()))])
    out = pa.schema([("unit_id", pa.string()), *((n, _ARROW[k]) for n, k in columns.items()), ("_misplaced", pa.list_(pa.string()))])
    wide = [p.sortWithinPartitions("unit_id").mapInArrow(_scatter(columns, out), schema) for p in parts]
    return wide[0] if len(wide) == 1 else wide[0].unionByName(wide[1])

