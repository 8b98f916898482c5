"""CSV text -> numbered records, with every large file read by many tasks.

Spark splits text files at any line break, but a quoted field may hold line
breaks. Whether a line stands inside a quoted field depends on all lines
before it, and only through one bit. Each line is therefore seen as a function
of that bit: it opens a quoted field, closes one, swaps or keeps the bit. Such
functions chain within a split by a window over its lines, and from split to
split by a window over one row a split, so no task reads a whole file. The
window over a split's lines numbers its records for both values of the bit it
may begin with; once the splits are chained each line takes the right number,
and the lines are shuffled and sorted only once.

Most files need none of that. A file is *plain* if no line that is read from a
field's start leaves a quoted field open, no line is blank, and no carriage
return stands inside a line: then every line is a record and its number is its
place in its split plus the lines of the splits before. Plain files are read
without a shuffle; only the lines of the others are dealt out, by split.

A file of which a quoted field is never closed is known from that one bit, and
rejected before anything is gathered.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.session import materialize

# Stands for a doubled quote while the quotes around a field are taken off (a code point that is no character).
_QUOTE_MARK = "﷐"


def one_path(path: Column) -> Column:
    """The same text for a local path however it is written (``file:/x``, ``file:///x``)."""
    return F.regexp_replace(path, "^file:/+", "file:/")


_LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _load(spark: SparkSession, reader: DataFrameReader, paths: list[str]) -> DataFrame:
    """``reader.load(paths)``, its folders listed by some tasks a core: a task a folder takes longer to start than to list."""
    given = spark.conf.get(_LISTING_TASKS)
    spark.conf.set(_LISTING_TASKS, str(min(int(given), max(200, 4 * spark.sparkContext.defaultParallelism))))
    try:
        return reader.load(paths)  # lists at once
    finally:
        spark.conf.set(_LISTING_TASKS, given)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(source_file, size) of every file, those without a byte included.

    Spark's own file index lists the folders (by parallel jobs when there are
    many) and holds the names; no content is read. Files with bytes come from
    the ``binaryFile`` source, which leaves out empty ones; the names of all
    files come from the index in one text.
    """
    scan = _load(spark, spark.read.format("binaryFile").option("recursiveFileLookup", "true"), paths)
    sized = scan.select(one_path(F.col("_metadata.file_path")).alias("source_file"), F.col("length").alias("size"))
    text = spark._jvm.org.apache.hadoop.util.StringUtils.join("\n", scan._jdf.inputFiles())
    names = spark.createDataFrame([(x,) for x in text.split("\n") if x], "name string")
    listed = names.select(one_path(F.col("name")).alias("source_file")).distinct()
    return listed.join(sized, "source_file", "left").select("source_file", F.coalesce("size", F.lit(0)).cast("bigint").alias("size"))


def accepted(path: Column, suffixes) -> Column:
    ok = F.lit(False)
    for suffix in suffixes:
        ok = ok | F.lower(path).endswith(suffix)
    return ok


def _quoted() -> str:
    return r'"[^"]*+(?:""[^"]*+)*+'


def leaves_open(text: Column, sep: str) -> Column:
    """True if a line that begins a record ends inside a quoted field."""
    other = f"[^{_class(sep)}]*+"
    pattern = rf'(?s)^(?:(?:{_quoted()}"{other}|(?!"){other})\Q{sep}\E)*+{_quoted()}$'
    return text.contains('"') & text.rlike(pattern)


def _class(sep: str) -> str:
    """A separator within a character class."""
    return "\\" + sep if sep in "\\]^-[&" else sep


def text_lines(spark: SparkSession, paths: list[str], suffixes, sep: str = ",", skip_unreadable: bool = False) -> DataFrame:
    """(source_file, block, at, value, opens): the lines of all accepted files, in the order of (block, at).

    ``block`` is where the line's split begins in the file. With
    ``skip_unreadable`` a file that can't be read (on) gives no (more) lines
    instead of stopping the job; ``file_summary`` tells such files by their bytes.
    """
    reader = spark.read.format("text").option("lineSep", "\n").option("recursiveFileLookup", "true")
    if skip_unreadable:
        reader = reader.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    rows = _load(spark, reader, paths).select(
        one_path(F.col("_metadata.file_path")).alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value")
    return rows.where(accepted(F.col("source_file"), suffixes)).withColumn("opens", leaves_open(F.col("value"), sep))


def file_summary(lines: DataFrame) -> DataFrame:
    """One row a file: its splits (block, first, n, before), bytes read and whether it is plain.

    ``before`` counts the lines of the splits before. The array has one entry
    a split, so it is bounded by file size over split size.
    """
    value = F.col("value")
    splits = lines.groupBy("source_file", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first"), F.sum(F.octet_length(value) + 1).alias("bytes"),
        F.bool_or(F.col("opens") | _blank(value) | value.rlike("\r[^\n]")).alias("odd"))
    before = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return splits.groupBy("source_file").agg(
        F.collect_list(F.struct("block", "first", "n", "before")).alias("splits"), F.sum("bytes").alias("bytes"), (~F.bool_or("odd")).alias("plain"))


def _blank(value: Column) -> Column:
    return value.rlike(r"^\s*$")


@dataclass
class Records:
    """Numbered records of all files: those of plain files are lines, the others are written."""

    lines: DataFrame  # written: source_file, block, at, value, opens
    files: DataFrame  # source_file, bytes, plain, splits, open_end
    odd: DataFrame  # written: source_file, rec_no, value of files that aren't plain

    def heads(self) -> DataFrame:
        """(source_file, value): the first record of each file."""
        plain = self.lines.groupBy("source_file").agg(F.min_by("value", F.struct("block", "at")).alias("value"))
        plain = plain.join(self.files.where("plain").select("source_file"), "source_file", "left_semi")
        return plain.unionByName(self.odd.where("rec_no = 1").select("source_file", "value"))

    def numbered(self, files: DataFrame) -> DataFrame:
        """Every record of ``files`` (one row a file, with all their columns): ..., rec_no, value."""
        keep = [c for c in files.columns if c not in ("source_file", "plain", "splits")]
        plain = self.lines.join(files.where("plain"), "source_file")
        split = F.element_at(F.filter("splits", lambda s: s["block"] == F.col("block")), 1)
        number = split["before"] + F.col("at") - split["first"] + 1
        plain = plain.select("source_file", *keep, number.alias("rec_no"), "value")
        odd = self.odd.join(files.where("NOT plain"), "source_file").select("source_file", *keep, "rec_no", "value")
        return plain.unionByName(odd)


def read_records(spark: SparkSession, paths: list[str], sep: str = ",", suffixes=(".csv",), skip_unreadable: bool = False) -> Records:
    """The records of all accepted files. Blank records are left out and not numbered."""
    lines = materialize(text_lines(spark, paths, suffixes, sep, skip_unreadable), "statement-lines")
    files = materialize(file_summary(lines), "statement-files")
    odd_lines = lines.join(files.where("NOT plain").select("source_file"), "source_file", "left_semi")
    odd, ends = _joined(odd_lines, sep)
    files = files.join(ends, "source_file", "left").withColumn("open_end", F.coalesce("open_end", F.lit(False)))
    return Records(lines, files, materialize(odd, "statement-odd-records"))


def _joined(lines: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """Records of files that aren't plain, and (source_file, open_end): whether a quoted field is never closed."""
    # A carriage return inside a line ends a line, too.
    parts = F.when(F.col("value").contains("\r"), F.split("value", "(?<=\r)(?!$)")).otherwise(F.array("value"))
    lines = lines.select("source_file", "block", "at", "opens", F.posexplode(parts).alias("part", "value"), F.size(parts).alias("parts"))
    lines = lines.withColumn("breaks", F.col("part") == F.col("parts") - 1)  # a line feed follows
    # Without a quote an open field stays open.
    lines = lines.withColumns({
        "from_start": F.when(F.col("parts") == 1, F.col("opens")).otherwise(leaves_open(F.col("value"), sep)).cast("int"),
        "from_open": (~F.col("value").contains('"') | leaves_open(F.concat(F.lit('"'), "value"), sep)).cast("int")})
    # A line that gives the same bit from either one sets it; else it keeps or swaps it.
    sets = F.col("from_start") == F.col("from_open")
    inside = Window.partitionBy("source_file", "block").orderBy("at", "part")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("swaps", F.sum(F.when(~sets, F.col("from_start")).otherwise(0)).over(running))
    lines = lines.withColumn("last_set", F.last(F.when(sets, F.struct(F.col("from_start").alias("bit"), "swaps")), ignorenulls=True).over(running))
    lines = lines.withColumn("bit", F.pmod(F.col("last_set.bit") + F.col("swaps") - F.col("last_set.swaps"), F.lit(2)))
    # The bit after and before each line, and the records begun so far, if the split begins with bit 0 or 1.
    after = {c: F.coalesce("bit", F.pmod(F.lit(c) + F.col("swaps"), F.lit(2))) for c in (0, 1)}
    lines = lines.withColumns({f"after_{c}": after[c].cast("int") for c in (0, 1)})
    lines = lines.withColumns({f"before_{c}": F.coalesce(F.lag(f"after_{c}").over(inside), F.lit(c)) for c in (0, 1)}
                              | {"last": F.lead("at").over(inside).isNull(), "blank": _blank(F.col("value"))})
    lines = lines.withColumns({f"skip_{c}": F.col("blank") & (F.col(f"before_{c}") == 0) & (F.col(f"after_{c}") == 0) for c in (0, 1)})
    lines = lines.withColumns({f"begun_{c}": F.sum(((F.col(f"before_{c}") == 0) & ~F.col(f"skip_{c}")).cast("int")).over(running) for c in (0, 1)})
    lines = materialize(lines.select(
        "source_file", "block", "at", "part", "value", "breaks", "last", "bit", "swaps",
        *[f"{x}_{c}" for c in (0, 1) for x in ("before", "after", "skip", "begun")]), "statement-odd-lines")
    # From split to split: the last split that sets the bit, and the swaps since.
    ahead = Window.partitionBy("source_file").orderBy("block")
    upto = ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = lines.where("last").select("source_file", "block", "bit", "begun_0", "begun_1",
                                      F.when(F.col("bit").isNull(), F.pmod("swaps", F.lit(2))).otherwise(0).alias("swap"))
    sums = sums.withColumn("swaps_so_far", F.sum("swap").over(upto))
    sums = sums.withColumn("set_at", F.last(F.when(F.col("bit").isNotNull(), F.struct("bit", "swaps_so_far")), ignorenulls=True).over(upto))
    after = F.pmod(F.coalesce(F.col("set_at.bit"), F.lit(0)) + F.col("swaps_so_far") - F.coalesce(F.col("set_at.swaps_so_far"), F.lit(0)), F.lit(2))
    sums = sums.withColumn("after", after)
    sums = sums.withColumn("carried", F.coalesce(F.lag("after").over(ahead), F.lit(0)))
    sums = sums.withColumn("begun", F.when(F.col("carried") == 0, F.col("begun_0")).otherwise(F.col("begun_1")))
    sums = materialize(sums.select(
        "source_file", "block", "carried", "after",
        F.coalesce(F.sum("begun").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")), "statement-odd-splits")
    ends = sums.groupBy("source_file").agg((F.max_by("after", "block") == 1).alias("open_end"))
    closed = ends.where("NOT open_end").select("source_file")

    splits = sums.join(closed, "source_file", "left_semi").select("source_file", "block", "carried", "before")
    held = lambda x: F.when(F.col("carried") == 0, F.col(f"{x}_0")).otherwise(F.col(f"{x}_1"))
    lines = lines.join(splits, ["source_file", "block"]).where(~held("skip")).select(
        "source_file", "block", "at", "part", "value", "breaks", held("before").alias("open_before"), held("after").alias("open_after"),
        (F.col("before") + held("begun")).cast("bigint").alias("rec_no"))
    whole = (F.col("open_before") == 0) & (F.col("open_after") == 0)
    single = lines.where(whole).select("source_file", "rec_no", "value")
    piece = F.struct("block", "at", "part", F.when(F.col("breaks"), F.concat("value", F.lit("\n"))).otherwise(F.col("value")).alias("value"))
    several = lines.where(~whole).groupBy("source_file", "rec_no").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    several = several.select("source_file", "rec_no", F.regexp_replace(F.array_join("pieces.value", ""), "\n$", "").alias("value"))
    return single.unionByName(several), ends


def record_fields(value: Column, sep: str = ",") -> Column:
    """The fields of a record, however many: quotes around a field are taken off, doubled ones count once."""
    text = F.regexp_replace(value, "\r$", "")
    other = f"[^{_class(sep)}]*+"
    # Each match takes its separator along, so none is empty.
    pattern = rf'(?s)\Q{sep}\E({_quoted()}"{other}|{other})'
    quoted = F.transform(F.regexp_extract_all(F.concat(F.lit(sep), text), F.lit(pattern), F.lit(1)), _unquoted)
    return F.when(text.contains('"'), quoted).otherwise(F.split(text, rf"\Q{sep}\E", -1))


def _unquoted(field: Column) -> Column:
    """A field without its quotes; text after the closing quote stays as it is."""
    inner = F.replace(F.substring(field, 2, 1 << 30), F.lit('""'), F.lit(_QUOTE_MARK))
    content = F.substring_index(inner, '"', 1)
    rest = F.when(F.locate('"', inner) > 0, F.substring(inner, F.locate('"', inner) + 1, F.lit(1 << 30))).otherwise(F.lit(""))
    plain = F.concat(F.replace(content, F.lit(_QUOTE_MARK), F.lit('"')), F.replace(rest, F.lit(_QUOTE_MARK), F.lit('""')))
    return F.when(field.startswith('"'), plain).otherwise(field)
