"""Record sources: text cut into fields, or tables whose columns are the fields.

Order without a global sort: each record has a chunk (operand, file and block, comparable as
a string) and a position in it. Both come from the scan; nothing is computed unless used.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import regexes
from ..functions.columns import Val, text

CHUNK_ROWS = 1_000_000
CHUNK, POS, NR, FIELDS = "__chunk", "__pos", "__nr", "__fields"


def split_column(value: Column, fs: str) -> Column:
    """The fields of a record; none for an empty one."""
    if fs == "":
        return F.array().cast("array<string>")
    if fs == " ":
        trimmed = F.regexp_replace(value, r"\A[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+\z", "")
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\r\x0b\f]+", -1))
    # One character, escaped where it means something, is cut without a regular expression.
    pattern = (fs if fs.isalnum() or not fs.isascii() else f"\\{fs}") if len(fs) == 1 else regexes.translate(fs)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, pattern, -1))


@dataclass(frozen=True)
class Records:
    """A DataFrame as records. columns: the fields' columns of a table; None: text in `value`."""

    df: DataFrame
    columns: tuple[str, ...] | None = None
    order: tuple[Column, Column] | None = None
    name: Column | None = None
    #: The operands that these records are put together from, if there are several.
    parts: tuple = ()

    @staticmethod
    def concat(parts: list[Records]) -> Records:
        """Operands one after the other; a table's fields of different kinds become text."""
        if len({p.columns is None for p in parts}) > 1:
            raise ValueError("operands are either all tables or all text")
        own = [p.ordered() for p in parts]
        chunk = [F.concat(F.format_string("%05d|", F.lit(i)), F.col(CHUNK)).alias(CHUNK) for i in range(len(own))]
        if own[0].columns is None:
            chosen = [p.df.select("value", c, POS) for p, c in zip(own, chunk, strict=True)]
            columns = None
        else:
            columns = tuple(f"f{k}" for k in range(1, max(len(p.columns) for p in own) + 1))
            kinds = [{p.df.schema[p.columns[k]].dataType for p in own if k < len(p.columns)} for k in range(len(columns))]
            field = lambda p, k: F.lit("") if k >= len(p.columns) else p.value(k + 1).col if len(kinds[k]) == 1 else text(p.value(k + 1))
            chosen = [p.df.select(*[field(p, k).alias(n) for k, n in enumerate(columns)], c, POS) for p, c in zip(own, chunk, strict=True)]
        df = chosen[0]
        for part in chosen[1:]:
            df = df.unionAll(part)
        return Records(df, columns, (F.col(CHUNK), F.col(POS)), None, tuple(parts))

    @staticmethod
    def from_table(df: DataFrame, columns: list[str] | None = None) -> Records:
        """Columns in order are $1, $2, ...; numbers stay numbers, timestamps and lists become text when read."""
        return Records(df, tuple(columns or df.columns), _file_order(df))

    @staticmethod
    def from_text(spark: SparkSession, paths: str | list[str], rs: str = "\n") -> Records:
        """Text files in the order of the operands, cut at rs ('' for paragraphs)."""
        parts = []
        for i, path in enumerate([paths] if isinstance(paths, str) else paths):
            lines = spark.read.text(path, lineSep=rs or "\n")
            value = F.regexp_replace("value", "\r\\z", "") if rs == "\n" else F.col("value")
            part = lines.select(F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias(POS), value.alias("value"))
            chunk = F.format_string("%05d|%s|%015d", F.lit(i), F.col("__file"), F.col("__block").cast("long"))
            parts.append(part.select("value", chunk.alias(CHUNK), F.col(POS).cast("long").alias(POS), F.col("__file")))
        df = parts[0]
        for part in parts[1:]:
            df = df.unionAll(part)
        # Each operand by itself, for programs that tell the first one from the others.
        own = tuple(Records(_paragraphs(p) if not rs else p, None, (F.col(CHUNK), F.col(POS)), F.col("__file")) for p in parts) if len(parts) > 1 else ()
        return Records(df if rs else _paragraphs(df), None, (F.col(CHUNK), F.col(POS)), F.col("__file"), own)

    @staticmethod
    def from_lines(spark: SparkSession, lines: list[str]) -> Records:
        df = spark.createDataFrame([(s,) for s in lines], "value string")
        return Records(df, None, _file_order(df))

    def ordered(self) -> Records:
        """With the columns __chunk and __pos."""
        if CHUNK in self.df.columns:
            return self
        chunk, pos = self.order
        return replace(self, df=self.df.select("*", chunk.alias(CHUNK), pos.alias(POS)))

    def split(self, fs: str) -> Records:
        """Text with the column __fields.

        A generator of one row a record makes it: filters on fields are not pushed through
        that, so a line is split once and not again for each time that a field is read.
        """
        if FIELDS in self.df.columns:
            return self
        return replace(self, df=self.df.select("*", F.inline(F.array(F.struct(split_column(F.col("value"), fs).alias(FIELDS))))))

    def numbered(self) -> Records:
        """With __nr, the record's number from 1.

        A window numbers records inside a chunk; the counts of all chunks, one small row each,
        give where a chunk starts.
        """
        own = self.ordered()
        starts = own.df.groupBy(CHUNK).agg(F.count(F.lit(1)).alias("__n"))
        ahead = F.coalesce(F.sum("__n").over(Window.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = starts.select(CHUNK, ahead.alias("__ahead"))
        inside = F.row_number().over(Window.partitionBy(CHUNK).orderBy(POS))
        df = own.df.withColumn("__inside", inside).join(starts, CHUNK).withColumn(NR, (F.col("__ahead") + F.col("__inside")).cast("double"))
        return replace(own, df=df.drop("__inside", "__ahead"))

    def value(self, k: int) -> Val:
        """A table's field k as a value."""
        name = self.columns[k - 1]
        kind, c = self.df.schema[name].dataType, F.col(f"`{name}`")
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            return Val(c, "num", whole=True)
        if isinstance(kind, (T.DoubleType, T.FloatType, T.DecimalType)):
            return Val(c, "num")
        if isinstance(kind, T.BooleanType):
            return Val(c.cast("int"), "num", whole=True)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return Val(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "str", ascii=True)
        if isinstance(kind, T.ArrayType):
            return Val(F.concat_ws(" ", F.transform(c, lambda x: x.cast("string"))), "str")
        return Val(c.cast("string"), "strnum")

    def line(self, values: list[Val], ofs: str) -> Column:
        return F.concat_ws(ofs, *[text(v) for v in values])


def _paragraphs(lines: DataFrame) -> DataFrame:
    """Lines joined between empty ones: a paragraph is the lines of a file before which as many empty lines lie."""
    from ..operators.ordered import carried

    numbered = carried(lines, {"__empty": ("sum", (F.col("value") == "").cast("long"))}).filter("value <> ''")
    found = numbered.groupBy(F.substring(CHUNK, 1, 5).alias("__operand"), "__file", F.coalesce("__empty", F.lit(0)).alias("__empty")).agg(F.array_sort(F.collect_list(F.struct(CHUNK, POS, "value"))).alias("__lines"))
    return found.select(F.array_join(F.col("__lines.value"), "\n").alias("value"), F.col("__lines")[0][CHUNK].alias(CHUNK), F.col("__lines")[0][POS].alias(POS), "__file")


def _file_order(df: DataFrame) -> tuple[Column, Column]:
    """A table read from files has row numbers in its metadata; any other keeps its partitions' order."""
    try:
        if df.isStreaming or not df.inputFiles():
            raise LookupError
        df.select("_metadata.row_index")
        row = F.col("_metadata.row_index")
        return F.format_string("%s|%015d", F.col("_metadata.file_path"), F.floor(row / CHUNK_ROWS)), row
    except Exception:  # noqa: BLE001  (an analysis error: no such column)
        number = F.monotonically_increasing_id()
        return F.format_string("%012d", F.shiftright(number, 33)), number
