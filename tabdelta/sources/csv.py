"""CSV files: encoding, delimiter and numbers are found out; dates stay text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import EMPTY, NUMBER, STRING, cell, parse_numeric_text
from .scratch import Scratch

#: Where windows-1252 has other characters than ISO 8859-1, which Spark reads: both sides of a translation.
_OTHER = [(chr(b), bytes([b]).decode("cp1252")) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
_WESTERN = tuple("".join(side) for side in zip(*_OTHER, strict=True))
DELIMITERS = [",", ";", "\t", "|"]


def sniff_format(content: Column) -> Column:
    """zip, cfb or text, by the first bytes of a file."""
    head = F.hex(F.substring(content, 1, 8))
    return F.when(F.startswith(head, F.lit("504B0304")), "zip").when(head == "D0CF11E0A1B11AE1", "cfb").otherwise("text")


def is_encrypted(content: Column) -> Column:
    """Whether an old container file holds an encrypted package."""
    mark = F.lit("EncryptedPackage".encode("utf-16-le").hex().upper())
    return (sniff_format(content) == "cfb") & F.contains(F.hex(F.substring(content, 1, 8192)), mark)


def encoding_of(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else windows-1252."""
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")


def top_level(line: str, delimiter: str) -> int:
    """Delimiters of a line outside quotes."""
    return sum(part.count(delimiter) for part in line.split('"')[::2])


def detect_delimiter(lines: list[str]) -> str:
    """The delimiter that splits most lines into the same number of fields.

    Over the first 50 lines with text: the commonest count of at least one scores its
    frequency a thousandfold, plus ten times itself, less the variance; of counts as common the
    largest is taken, of delimiters the first.
    """
    some = [x for x in lines if x][:50]
    best, top = ",", float("-inf")
    for d in DELIMITERS:
        counts = [top_level(x, d) for x in some]
        if not counts:
            continue
        freq = {n: counts.count(n) for n in dict.fromkeys(counts)}
        mode = max(freq, key=lambda n: (freq[n], n))
        if mode < 1:
            continue
        mean = sum(counts) / len(counts)
        score = freq[mode] * 1000 + mode * 10 - sum((n - mean) ** 2 for n in counts) / len(counts)
        if score > top:
            best, top = d, score
    return best


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``f, b, at, value``: lines with their file, the first byte of their block, and their order in it.

    Blocks are the splits that Spark gives to tasks.  The bytes of a line stay as they are.
    """
    text = spark.read.text(path)
    return text.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("at"), "value")


def _odd() -> Column:
    """Whether a line opens or closes a quoted field without closing or opening it again."""
    return (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"')))) % 2 == 1


def _blocks(lines: DataFrame) -> DataFrame:
    """``f, b, inside, crossed, utf8``: whether a block begins within quotes, whether a record has lines in it that are not its first, and whether its file is UTF-8.

    Whether a block begins within quotes is the parity of the quotes before it: a running sum over a row a block.
    """
    each = lines.groupBy("f", "b").agg(F.count_if(_odd()).alias("odd"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    before = F.sum("odd").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.coalesce(before, F.lit(0)) % 2 == 1
    return each.select("f", "b", inside.alias("inside"), (inside | (F.col("odd") > 0)).alias("crossed"), F.bool_and("utf8").over(Window.partitionBy("f")).alias("utf8"))


def _records(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """``f, b, at, value`` with the lines of a record as one; a record lies where its first line does."""
    crossed = blocks.where("crossed").select("f", "b", "inside")
    plain = lines.join(F.broadcast(crossed.select("f", "b")), ["f", "b"], "left_anti")
    own = Window.partitionBy("f", "b").orderBy("at")
    quotes = F.coalesce(F.sum(_odd().cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("inside").cast("int")
    marked = lines.join(F.broadcast(crossed), ["f", "b"]).withColumn("head", quotes % 2 == 0)
    marked = marked.withColumn("k", F.count_if("head").over(own)).withColumn("ends", F.lead("head").over(own))
    whole = marked.where("head AND ends")
    # lines at the start of a block go on with the last record of the last block in which one begins
    last = Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    heads = marked.groupBy("f", "b").agg(F.max("k").alias("k")).withColumn("x", F.when(F.col("k") > 0, F.struct("b", "k")))
    open_ = heads.select("f", "b", F.last("x", ignorenulls=True).over(last).alias("before"))
    parts = marked.where("NOT (head AND ends) OR ends IS NULL").join(F.broadcast(open_), ["f", "b"])
    record = F.when(F.col("k") > 0, F.struct("b", "k")).otherwise(F.col("before"))
    joined = parts.groupBy("f", record.alias("x")).agg(F.array_sort(F.collect_list(F.struct("b", "at", "value"))).alias("l"))
    one = joined.select("f", F.col("l")[0]["b"].alias("b"), F.col("l")[0]["at"].alias("at"), F.array_join(F.col("l")["value"], "\n").alias("value"))
    return plain.unionByName(whole.select(*lines.columns)).unionByName(one)


def split_fields(record: Column, delimiter: str) -> Column:
    """The fields of a record and an empty text after them; records hold no carriage returns.

    Between quotes, every second piece lies within them; an empty piece between two of those is a quote that was doubled.
    """
    ended = F.concat(record, F.lit("\r"))

    def piece(x: Column, i: Column) -> Column:
        outside = F.when((x == "") & (i > 0), '"').otherwise(F.replace(x, F.lit(delimiter), F.lit("\r")))
        return F.when(i % 2 == 0, outside).otherwise(x)

    quoted = F.array_join(F.transform(F.split(ended, '"', -1), piece), "")
    return F.split(F.when(F.contains(record, F.lit('"')), quoted).otherwise(F.replace(ended, F.lit(delimiter), F.lit("\r"))), "\r", -1)


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, columns: int | None = None, place: bool = False) -> DataFrame:
    """The fields of files as text columns ``_c0``, ``_c1`` and so on; with ``place`` their order too, as ``_place``.

    Quotes double to escape, and fields may hold newlines, which become ``\\n``.  Lines end with CR, LF or both;
    an empty line is a row, empty fields are null.  There are as many columns as the longest record has fields, which is
    looked for unless ``columns`` is given.  A file is UTF-8 if all its bytes are valid, else windows-1252.

    A file is read in blocks by many tasks.  A first pass tests bytes and counts quotes by block; where no field holds a newline, the
    second one shuffles nothing.  Otherwise the lines of blocks that a record goes through are put together, and records sorted by place.
    """
    if delimiter is None:
        delimiter = detect_delimiter([r["value"] for r in spark.read.text(path).limit(200).collect()])
    lines = _lines(spark, path)
    blocks = Scratch(spark, "csv").save(_blocks(lines))
    facts = blocks.agg(F.bool_or("crossed").alias("crossed"), F.bool_or(~F.col("utf8")).alias("western")).first()
    records = _records(lines, blocks) if facts["crossed"] else lines
    named_western = encoding is not None and encoding.lower() in ("windows-1252", "cp1252")
    if named_western or (encoding is None and facts["western"]):
        text = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), *_WESTERN)
        if named_western:
            records = records.withColumn("value", text)
        else:
            files = blocks.where("NOT utf8").select("f", F.lit(True).alias("western")).distinct()
            records = records.join(F.broadcast(files), "f", "left").withColumn("value", F.when(F.col("western"), text).otherwise(F.col("value"))).drop("western")
    fields = records.select(F.struct("f", "b", "at").alias("_place"), split_fields(F.col("value"), delimiter).alias("x"))
    if columns is None:
        columns = (fields.agg(F.max(F.size("x"))).first()[0] or 1) - 1
    out = [F.nullif(F.get("x", F.lit(k)), F.lit("")).alias(f"_c{k}") for k in range(columns)]
    # records put together stand apart from the others
    rows = fields.select("_place", *out).orderBy("_place") if facts["crossed"] else fields.select("_place", *out)
    return rows if place else rows.drop("_place")


def read_csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A file whose first record names the columns, as texts and without empty rows.

    Columns without a name are called after their number, and a name that comes again gets a number.
    """
    rows = read_csv(spark, path, place=True)
    head = rows.orderBy("_place").limit(1).collect()
    if not head:
        return spark.createDataFrame([], "_c0 string").drop("_c0")
    names: list[str] = []
    for k, x in enumerate(head[0][1:]):
        name, n = x or f"Column {k + 1}", 2
        while name in names:
            name, n = f"{x or 'Column'} ({n})", n + 1
        names.append(name)
    first = head[0]["_place"]
    at = F.col("_place")
    data = rows.where(~((at["f"] == first["f"]) & (at["b"] == first["b"]) & (at["at"] == first["at"]))).drop("_place").na.drop("all")
    return data.select(*[F.col(f"_c{k}").alias(name) for k, name in enumerate(names)])


def numeric_columns(tables: list[DataFrame]) -> dict[str, str]:
    """``bigint`` or ``double`` for the columns of texts that show plain numbers alone in all tables; ``007`` is none."""
    kinds: dict[str, set[str]] = {}
    for df in tables:
        each = [F.struct(F.bool_and(F.col(quoted(c)).rlike(r"^-?(0|[1-9]\d{0,17})$")).alias("bigint"), F.bool_and(F.col(quoted(c)).rlike(r"^-?(0|[1-9]\d{0,14})(\.\d{1,15})?$")).alias("double")).alias(f"k{k}") for k, c in enumerate(df.columns)]
        row = df.agg(*each).first() if each else []
        for c, x in zip(df.columns, row, strict=True):
            kinds.setdefault(c, set()).add("bigint" if x["bigint"] else "double" if x["double"] else "string" if x["double"] is False else "any")
    some = {c: k - {"any"} for c, k in kinds.items()}
    return {c: "bigint" if k == {"bigint"} else "double" for c, k in some.items() if k and "string" not in k}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def csv_cell(text: Column) -> Column:
    """A field as a cell: a number if it shows one, with an exponent too."""
    n = parse_numeric_text(text, exponent=True)
    blank = text.isNull() | (text == "")
    return cell(F.when(blank, EMPTY).when(n.isNotNull(), NUMBER).otherwise(STRING), n, F.when(n.isNull() & ~blank, text))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    """Fields with quotes, delimiters or newlines are quoted; one file a partition, in the order of the partitions."""
    df.write.csv(path, sep=delimiter, quote='"', escape='"', header=True, lineSep="\r\n")
