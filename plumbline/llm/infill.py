"""Fill-in-the-middle examples: prefix, suffix and middle of a text put in another order between markers. Spark functions only.

A delimiter that no text can hold, since texts are escaped first, is put behind every unit of a text. Counting it counts
the units, and substring_index takes the first, the middle and the last of them out; then the delimiters go and the
escapes are undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the space before it, or the space that ends a text.
UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
#: The delimiter, and the character that begins an escape. Neither is white space, so escapes leave the units as they are.
DELIMITER, ESCAPE = "\x01", "\x02"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _swap(x: Column, old: str, new: str) -> Column:
    return F.replace(x, F.lit(old), F.lit(new))


def escaped(x: Column) -> Column:
    """x without the delimiter: it and the escape character become pairs that begin with the escape character."""
    return _swap(_swap(x, ESCAPE, ESCAPE + "e"), DELIMITER, ESCAPE + "d")


def unescaped(x: Column) -> Column:
    """The inverse of escaped. Every escape character has its letter behind it, so that no replacement sees a part of two."""
    return _swap(_swap(x, ESCAPE + "d", DELIMITER), ESCAPE + "e", ESCAPE)


def _number(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits, from 0."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _parts(marked: Column, n: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """The units before a, from a to b, and from b, of a text with n delimiters."""
    each = (
        F.call_function("substring_index", marked, F.lit(DELIMITER), a.cast("int")),
        F.call_function("substring_index", F.call_function("substring_index", marked, F.lit(DELIMITER), b.cast("int")), F.lit(DELIMITER), (a - b).cast("int")),
        F.call_function("substring_index", marked, F.lit(DELIMITER), (b - n - 1).cast("int")),
    )
    return tuple(unescaped(_swap(x, DELIMITER, "")) for x in each)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm_rate: int = 80, seed: int = 42) -> DataFrame:
    """One row per row of docs: (id, n, form, prefix, middle, suffix, output).

    A hash of seed and id decides: `rate` percent of the texts are taken apart at two borders between their n units,
    `spm_rate` percent of these with the suffix before the prefix (form spm), the others as prefix, suffix, middle
    (psm). The form is plain, and the output the text itself, for the others, for empty texts and for such as hold a
    marker, which would make the output ambiguous; their parts are null.

    Nulls: a null text is an empty one; a null id hashes as an empty string and stays null. A text of white space alone
    is one unit. Texts of any length are treated whole. Rows that repeat an id get the same numbers. Empty table: no
    rows. Other columns are not read, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), digest.alias("d"))
    rows = rows.withColumn("marked", F.regexp_replace(escaped(F.col("t")), UNIT, "$0" + DELIMITER))
    rows = rows.withColumn("n", (F.length("marked") - F.length(_swap(F.col("marked"), DELIMITER, ""))).cast("long"))
    h1, h2, h3, h4 = (_number(F.col("d"), k) for k in range(4))
    ambiguous = F.contains("t", F.lit(PREFIX)) | F.contains("t", F.lit(SUFFIX)) | F.contains("t", F.lit(MIDDLE))
    form = F.when((F.col("t") == "") | ambiguous | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_rate, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "x": h1 % (F.col("n") + 1), "y": h2 % (F.col("n") + 1)})
    rows = rows.withColumns({"a": F.least("x", "y"), "b": F.greatest("x", "y")})
    apart = F.col("form") != "plain"
    prefix, middle, suffix = _parts(F.col("marked"), F.col("n"), F.col("a"), F.col("b"))
    rows = rows.withColumns({"prefix": F.when(apart, prefix), "middle": F.when(apart, middle), "suffix": F.when(apart, suffix)})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    return rows.select(F.col("id").alias(id_col), "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of that form was made of. Parts hold no marker and a marker begins with `<` alone, so
    that the first of each kind is the one that was put in."""

    def between(start: str, end: str | None) -> Column:
        rest = F.substr(output, F.instr(output, start) + len(start))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
