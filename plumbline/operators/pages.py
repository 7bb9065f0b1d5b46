"""Scans of cells of any size by pages: a cell is cut into windows that many tasks read, with the results of one reading.

A window is a core, some text before it that patterns look back on, and as much behind it as a match can be long; a match
belongs to the page in whose core it begins. A family's matches do not overlap, so that where its search begins in a page
depends on where its last match of the page before ended. All pages are searched from the beginning of their core first;
then those that a match of the page before reaches into are searched again from its end, until none is left. Borders of
private keys are put together across pages afterwards.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.shapes import ARROW_SPAN, FIELDS, LINE, PREFILTER, SPAN, _FINDERS, as_matches, hits, row_of
from plumbline.runtime import materialize, release

FAMILIES = tuple(_FINDERS)
#: Characters of a core, before it and behind it. What a pattern matches is shorter than BEHIND, and reads at most LINE
#: characters back.
CORE, BEFORE, BEHIND = 1 << 16, 2 * LINE, 9216
PAGE = "page long, at long, begin long, stop long, final boolean, text string"


def _cut(df: DataFrame, core: int) -> DataFrame:
    """(id, PAGE): the windows of each text t; at is the place of the window's first character, begin and stop those of the core."""

    def run(batches):
        for batch in batches:
            for id_, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for s in range(0, len(text), 16 * core):
                    rows = []
                    for begin in range(s, min(len(text), s + 16 * core), core):
                        at, stop = max(0, begin - BEFORE), min(len(text), begin + core)
                        rows.append((begin // core, at, begin, stop, stop == len(text), text[at : stop + BEHIND]))
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    ids = pa.array([id_.as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([ids, *cols], names=["id", "page", "at", "begin", "stop", "final", "text"])

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, {PAGE}")


def _searched(pages: DataFrame) -> DataFrame:
    """(id, page, begin, entry, exit, spans) of pages with entry, where each family's search begins: the spans that begin in
    the core, and where each search goes on."""

    def run(batches):
        for batch in batches:
            spans, exits = [], []
            for at, stop, text, entry in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("at", "stop", "text", "entry")), strict=True):
                own, out, userinfo = [], [], {}
                for family, start in zip(FAMILIES, entry, strict=True):
                    end = start
                    if family == "url_userinfo":
                        # a match of the page before that ends here began before all of this page
                        userinfo[start - at] = -1
                    for m in hits(family, text, start - at, stop - at):
                        end = at + m.end()
                        if family == "url_userinfo":
                            userinfo[m.end()] = m.start()
                        if (r := row_of(family, m, text)) is not None:
                            own.append(r)
                    out.append(max(end, stop))
                spans.append([r for r in own if not (r["family"] == "email" and userinfo.get(r["start"] + r["value"].index("@") + 1, len(text)) < r["start"])])
                exits.append(out)
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("id", "page", "at", "begin", "entry")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(exits, pa.list_(pa.int64())), pa.array(spans, ARROW_SPAN)], names=["id", "page", "at", "begin", "entry", "exit", "spans"])

    kind = pages.schema["id"].dataType.simpleString()
    return pages.select("id", "page", "at", "begin", "stop", "text", "entry").mapInArrow(run, f"id {kind}, page long, at long, begin long, entry array<long>, exit array<long>, spans {SPAN}")


def page_spans(df: DataFrame, core: int = CORE) -> DataFrame:
    """(id, nth, family, start, end, value, line, names) of the texts t of df (id, t): nth numbers the families."""
    spark = df.sparkSession
    may = df.where(F.col("t").rlike(PREFILTER))
    pages = materialize(_cut(may.select("id", "t"), core), "pages")
    todo = pages.withColumn("entry", F.array_repeat(F.col("begin"), len(FAMILIES)))
    done, old = None, []
    before = Window.partitionBy("id").orderBy("page")
    while True:
        new = materialize(_searched(todo), "searched")
        # each round replaces the pages that were searched from a wrong place; later rounds have few of them
        done = new if done is None else materialize(done.join(new.select("id", "page"), ["id", "page"], "left_anti").unionByName(new), "searched")
        met = done.select("id", "page", "entry", F.lag("exit").over(before).alias("right")).where("right IS NOT NULL AND right <> entry")
        wrong = materialize(met.select("id", "page", F.col("right").alias("entry")), "wrong")
        if wrong.isEmpty():
            break
        old += [new] if new is not done else []
        todo = pages.join(wrong, ["id", "page"])
    release(spark, pages, *old)
    found = done.select("id", "at", F.explode("spans").alias("s")).select(
        "id", F.col("s.family").alias("family"), (F.col("at") + F.col("s.start")).alias("start"), (F.col("at") + F.col("s.end")).alias("end"), "s.value", "s.line", "s.names"
    )
    # a key is from the first beginning of a kind to the first end of it: borders know the ones before them
    borders = found.where("family = 'delimiter'").select("id", "start", "end", "line", "names", F.split("value", " ", 2).alias("v"))
    of_kind = Window.partitionBy("id", F.col("v")[1]).orderBy("start")
    side = F.col("v")[0]
    borders = borders.withColumn("previous", F.lag(side).over(of_kind))
    opening = F.when((side == "BEGIN") & F.coalesce(F.col("previous") != "BEGIN", F.lit(True)), F.struct("start", "line"))
    borders = borders.withColumn("opened", F.last(opening, ignorenulls=True).over(of_kind))
    keys = borders.where((side == "END") & (F.col("previous") == "BEGIN"))
    keys = keys.select("id", F.lit("pem").alias("family"), F.col("opened.start").alias("start"), "end", F.lit("").alias("value"), F.col("opened.line").alias("line"), "names")
    names = F.array(*[F.lit(f) for f in (*FAMILIES[: FAMILIES.index("delimiter")], "pem", *FAMILIES[FAMILIES.index("delimiter") :])])
    return found.where("family <> 'delimiter'").unionByName(keys).withColumn("nth", F.array_position(names, F.col("family")))


def scan_pages(df: DataFrame, id_col: str, text_col: str, core: int = CORE) -> DataFrame:
    """(id, FIELDS): a row for each candidate of scan_cells without a limit, for texts of any size; places are longs.

    Each page is a task's work; nothing of a cell but its matches and the ends of its pages comes together, and matches
    are rows. Of equal spans and labels the first family's counts. Null texts and such without a candidate have no rows,
    an id has to stand for one text. Empty table: no rows. Other columns are not read.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t IS NOT NULL")
    span = F.struct("family", F.lit(0).alias("start"), (F.col("end") - F.col("start")).cast("int").alias("end"), "value", "line", "names")
    found = page_spans(rows, core).select("id", "nth", F.col("start").alias("from"), F.posexplode(as_matches(F.array(span))).alias("k", "m"))
    place = {f: (F.col("m")[f] + F.col("from")).alias(f) for f in ("start", "end")}
    each = found.select("id", "nth", "k", *[place.get(f, F.col("m")[f].alias(f)) for f in FIELDS])
    label = ("start", "end", "category", "subtype")
    rest = [f for f in FIELDS if f not in label]
    first = each.groupBy("id", *label).agg(F.min(F.struct("nth", "k", *rest)).alias("x"))
    return first.select("id", *[F.col(f) if f in label else F.col(f"x.{f}").alias(f) for f in FIELDS])
