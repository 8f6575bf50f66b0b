"""Fill-in-middle transformation over relational units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A unit: white space with the word after it, or white space that no word follows.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Documents of a hundred that are cut, and of a hundred cut ones those whose suffix comes first.
RATE, SPM = 50, 80
#: Groups of partitions whose equal rows are worked on together.
PARTS = 4096
_KEY = ["key_a", "key_b", "part"]


def units_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def _draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers that follow from the id alone."""
    told = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(told, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restore(output: Column, form: Column) -> Column:
    """The text that an output of the given form was made of."""
    at = lambda mark: F.instr(output, mark)
    between = lambda i, j: F.substring(output, i + 3, j - i - 3)
    last = F.substring(output, at(MIDDLE) + 3, F.length(output))
    psm = F.concat(between(F.lit(1), at(SUFFIX)), last, between(at(SUFFIX), at(MIDDLE)))
    spm = F.concat(between(at(PREFIX), at(MIDDLE)), last, between(F.lit(1), at(PREFIX)))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n: units, form, prefix_chars, middle_chars, output), a row for each of ``docs``.

    Form and cuts are drawn from the id. A text that is empty or names a mark stays plain,
    as do (100 - ``rate``) of a hundred others; its two numbers of characters are null. Of
    those cut, ``spm`` of a hundred give suffix, prefix, middle, the rest prefix, suffix,
    middle.

    Plain rows are never shuffled. Texts to be cut are dealt out once, by a key of their id
    and text; there, units are exploded, their lengths summed up in order, cut requests
    joined by ordinal, and a document's offsets gathered. Both sides of that join stand on
    the one exchange. Rows that repeat id and text are worked on once for each group of
    partitions they come from and all come back; other rows that repeat an id are cut each by its own units.
    A null text is empty, a null id draws as an empty one. Other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = _draws(F.col("doc_id"), seed)
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.col("text") == "") | marked | (h3 % 100 >= rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h4 % 100 < spm, "spm").otherwise("psm"))
    none = F.lit(None).cast("long")
    whole = rows.where(F.col("form") == "plain").select("doc_id", F.size(units_of(F.col("text"))).cast("long").alias("n"), "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))

    named = F.coalesce(F.concat(F.length(F.col("doc_id").cast("string")), F.lit(":"), F.col("doc_id").cast("string")), F.lit("-"))
    told = F.md5(F.concat(named, F.col("text")))
    never_null = lambda c: F.coalesce(c, F.lit(0))
    half = lambda at: never_null(F.conv(F.substring(told, at, 15), 16, 10).cast("long"))
    keyed = rows.where(F.col("form") != "plain").select(half(1).alias("key_a"), half(16).alias("key_b"), never_null(F.spark_partition_id() % PARTS).alias("part"), F.struct("doc_id", "text", "form").alias("doc"))
    # both readers below need both columns, and no key can be null, so their exchanges are the same and one is reused
    dealt = keyed.groupBy(*_KEY).agg(F.first("doc").alias("doc"), F.count(F.lit(1)).alias("copies")).where("copies > 0")

    units = dealt.select(*_KEY, F.posexplode(units_of(F.col("doc.text"))).alias("unit", "string")).select(*_KEY, (F.col("unit") + 1).cast("long").alias("units"), F.length("string").alias("chars"))
    sums = units.select(*_KEY, "units", F.sum("chars").over(Window.partitionBy(*_KEY).orderBy("units").rowsBetween(Window.unboundedPreceding, 0)).alias("until"))
    counted = dealt.select(*_KEY, "doc", "copies", F.size(units_of(F.col("doc.text"))).cast("long").alias("n"))
    h1, h2, *_ = _draws(F.col("doc.doc_id"), seed)
    one, other = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    requests = counted.select(*_KEY, "doc", "copies", "n", F.least(one, other).alias("first"), F.greatest(one, other).alias("second"))
    # a cut before the first unit meets none and is at 0
    at_cut = (F.col("u.units") == F.col("r.first")) | (F.col("u.units") == F.col("r.second"))
    same = [F.col(f"r.{k}") == F.col(f"u.{k}") for k in _KEY]
    met = requests.alias("r").join(sums.alias("u"), [*same, at_cut], "left").select("r.*", "units", "until")
    offset = lambda cut: F.coalesce(F.max(F.when(F.col("units") == F.col(cut), F.col("until"))), F.lit(0)).cast("int")
    cut = met.groupBy(*_KEY).agg(F.first("doc").alias("doc"), F.first("copies").alias("copies"), F.first("n").alias("n"), offset("first").alias("p"), offset("second").alias("m"))
    text = F.col("doc.text")
    prefix, middle = F.substring(text, F.lit(1), F.col("p")), F.substring(text, F.col("p") + 1, F.col("m") - F.col("p"))
    suffix = F.substring(text, F.col("m") + 1, F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm_ = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    output = F.when(F.col("doc.form") == "psm", psm).otherwise(spm_)
    cut = cut.select("doc.doc_id", "n", "doc.form", F.col("p").cast("long").alias("prefix_chars"), (F.col("m") - F.col("p")).cast("long").alias("middle_chars"), output.alias("output"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return whole.unionByName(cut.drop("copy"))
