"""Line dedup by content-defined chunks.

Each line is hashed, and a rolling hash over the hashes of two neighbouring lines marks the places where it is smaller
than before and after. Text is cut there, so an inserted or deleted line moves only the cuts beside it. Such chunks are
seldom inside a repeat of a few lines, so a second family has the finest cuts there are: every run of ``least_lines``
lines that are not blank, with the blank ones between them, is a chunk too. Chunks of the first family count if they
hold more such lines than that. Only the place where a chunk occurs first stays: the document of the smallest id, and
there its first place; at all others its lines go. Chunks are judged on the input, so of each line that goes an equal
one stays.

Chunks are named by a hash of their lines' hashes. Only those whose name occurs more than once are compared by bytes,
and where different bytes share a name, nothing of that name is removed.

Everything is DataFrame expressions. Chunks are found within a row and written as numbers; counting combines equal names
before the shuffle; what goes is listed by document and text and joined back, so no text is rebuilt by grouping.

Cases: a null text stays null and has no lines, an empty one has one line and stays; a null id comes before all others;
rows that repeat an id count as one document, so each keeps what that document keeps; an empty table gives no rows;
all columns of the input are passed through, whatever their names, but one named like an added column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowfind.session import scratch

BIGGEST = (1 << 63) - 1
ADDED = ("__n_lines", "__n_removed_lines", "__n_removed_chunks")
ROW = ("doc", "key1", "key2")


def cuts(hashes: Column) -> Column:
    """(first, last) line numbers of the chunks of a list of lines' hashes."""
    n = F.size(hashes)
    none = F.array(F.lit(None).cast("long"))
    earlier = F.concat(none, F.slice(hashes, F.lit(1), n - 1))
    roll = F.zip_with(earlier, hashes, lambda a, b: F.when(a.isNotNull(), F.xxhash64(a, b)))
    before = F.concat(none, F.slice(roll, F.lit(1), n - 1))
    after = F.concat(F.slice(roll, F.lit(2), n), none)
    beside = F.zip_with(before, after, lambda a, b: F.least(F.coalesce(a, F.lit(BIGGEST)),
                                                             F.coalesce(b, F.lit(BIGGEST))))
    low = F.zip_with(roll, beside, lambda r, b: F.coalesce(r < b, F.lit(False)))
    ends = F.filter(F.transform(low, lambda x, i: F.when(x, i)), lambda e: e.isNotNull())
    ends = F.array_union(ends, F.array(n - 1))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda e: e + 1))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("first"), b.alias("last")))


def part(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first + 1, last - first + 1)


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by a generator of one row: lambdas that use them would compute them again for each element."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, text, key1, key2): rows with equal ids and keys hold equal texts."""
    return docs.select(F.col(id_column).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        "*", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2"))


def chunks(rows: DataFrame, least_lines: int) -> DataFrame:
    """(doc, key1, key2, hash, first, last) of the chunks of both families of each row."""
    rows = once(rows, lines=F.split("text", "\n"))
    rows = once(rows, hashes=F.transform("lines", lambda x: F.xxhash64(x)),
                filled=F.transform("lines", lambda x: F.trim(x) != "")).drop("lines", "text")
    at = F.filter(F.transform("filled", lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    rows = once(rows, at=at).where(F.size("at") >= least_lines)
    starts = F.slice("at", F.lit(1), F.size("at") - (least_lines - 1))
    runs = F.zip_with(starts, F.slice("at", F.lit(least_lines), F.size("at")),
                      lambda a, b: F.struct(a.alias("first"), b.alias("last")))
    longer = F.filter(cuts(F.col("hashes")), lambda c: F.size(F.filter(
        part(F.col("filled"), c["first"], c["last"]), lambda x: x)) > least_lines)
    named = F.transform(F.concat(longer, runs), lambda c: F.struct(
        F.xxhash64(part(F.col("hashes"), c["first"], c["last"])).alias("hash"), c["first"].alias("first"),
        c["last"].alias("last")))
    return rows.select(*ROW, F.inline(named))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc"].eqNullSafe(right["doc"]) & (left["key1"] == right["key1"]) & (left["key2"] == right["key2"])


def removals(docs: DataFrame, least_lines: int, id_column: str, text: str) -> DataFrame:
    """(doc, key1, key2, gone): numbers of the lines that go from each text of a document, where there are any."""
    rows = keyed(docs, id_column, text)
    found = scratch(chunks(rows, least_lines), "chunks")
    repeated = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    # What repeats grows with the documents, so it is dealt out by name at every size. Rows that repeat are one.
    held = (found.join(repeated.hint("merge"), "hash").groupBy(*ROW, "hash")
            .agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("at")))
    held = scratch(held, "repeated-chunks")
    asked = held.groupBy(*ROW).agg(F.collect_list(F.struct("hash", "at")).alias("asked"))
    asked = asked.hint("merge")
    texts = rows.join(asked, same_row(rows, asked)).select(rows["doc"], "text", "asked")
    # Null ids come first, as the smallest number does.
    place = F.coalesce(F.col("doc").cast("long"), F.lit(-BIGGEST - 1))
    texts = once(texts, lines=F.split("text", "\n")).select("doc", "lines", F.inline("asked"))
    bytes_of = texts.select("doc", "lines", "hash", F.inline("at")).select(
        place.alias("place"), "hash", F.array_join(part(F.col("lines"), F.col("first"), F.col("last")), "\n").alias(
            "bytes"))
    equal = (bytes_of.groupBy("hash", "bytes").agg(F.min("place").alias("place"))
             .groupBy("hash").agg(F.count("*").alias("kinds"), F.min("place").alias("place"))
             .where("kinds = 1").select("hash", F.col("place").alias("kept_at")))
    equal = scratch(equal, "equal-chunks").hint("merge")
    later = F.when(place == F.col("kept_at"), F.slice("at", F.lit(2), F.size("at"))).otherwise(F.col("at"))
    spans = F.flatten(F.transform("later", lambda c: F.sequence(c["first"], c["last"])))
    gone = held.join(equal, "hash").withColumn("later", later).where(F.size("later") > 0)
    return gone.groupBy(*ROW).agg(F.array_distinct(F.flatten(F.collect_list(spans))).alias("gone"))


def line_dedup(docs: DataFrame, least_lines: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shortened texts and ``__n_lines``, ``__n_removed_lines``, ``__n_removed_chunks``: how many lines a
    text had, how many of them went, and in how many places."""
    if least_lines < 2:
        raise ValueError("a chunk has two lines or more")
    gone = scratch(removals(docs, least_lines, id_column, text), "removed-lines").hint("merge")
    # All columns of the input are fields of one, so no name of theirs meets one used here.
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    own = F.col("row").getField(text)
    rows = rows.select("row", own.alias("own"), F.col("row").getField(id_column).alias("doc"),
                       F.coalesce(own, F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("text").alias("key1"), F.xxhash64(F.lit(1), "text").alias("key2"))
    rows = rows.join(gone, same_row(rows, gone), "left").select("row", "own", "text", "gone")
    rows = once(rows, lines=F.split("text", "\n"))
    rows = once(rows, left=F.when(F.col("gone").isNotNull(), F.array_except(
        F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))))
    kept = F.array_join(F.transform("left", lambda i: F.get(F.col("lines"), i)), "\n")
    # A place ends where the next line that goes is not the next line.
    ordered = F.sort_array("gone")
    following = F.concat(F.slice(ordered, F.lit(2), F.size("gone")), F.array(F.lit(-1)))
    places = F.size(F.filter(F.zip_with(ordered, following, lambda a, b: b != a + 1), lambda x: x))
    columns = [F.when(F.col("gone").isNull(), F.col("own")).otherwise(kept).alias(c) if c == text
               else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ADDED]
    counts = (F.when(F.col("own").isNull(), 0).otherwise(F.size("lines")),
              F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")),
              F.when(F.col("gone").isNull(), 0).otherwise(places))
    return rows.select(*columns, *(c.cast("long").alias(name) for name, c in zip(ADDED, counts)))
