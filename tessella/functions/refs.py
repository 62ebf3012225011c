"""References of the form book.chapter.verse: parsing, checking, ordering, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Book codes in canonical order with name and number of chapters.
BOOKS = (
    "GEN Genesis 50, EXO Exodus 40, LEV Leviticus 27, NUM Numbers 36, DEU Deuteronomy 34, JOS Joshua 24, JDG Judges 21, RUT Ruth 4, 1SA 1 Samuel 31, "
    "2SA 2 Samuel 24, 1KI 1 Kings 22, 2KI 2 Kings 25, 1CH 1 Chronicles 29, 2CH 2 Chronicles 36, EZR Ezra 10, NEH Nehemiah 13, EST Esther 10, JOB Job 42, "
    "PSA Psalms 150, PRO Proverbs 31, ECC Ecclesiastes 12, SNG Song of Solomon 8, ISA Isaiah 66, JER Jeremiah 52, LAM Lamentations 5, EZK Ezekiel 48, "
    "DAN Daniel 12, HOS Hosea 14, JOL Joel 3, AMO Amos 9, OBA Obadiah 1, JON Jonah 4, MIC Micah 7, NAM Nahum 3, HAB Habakkuk 3, ZEP Zephaniah 3, HAG Haggai 2, "
    "ZEC Zechariah 14, MAL Malachi 4, MAT Matthew 28, MRK Mark 16, LUK Luke 24, JHN John 21, ACT Acts 28, ROM Romans 16, 1CO 1 Corinthians 16, "
    "2CO 2 Corinthians 13, GAL Galatians 6, EPH Ephesians 6, PHP Philippians 4, COL Colossians 4, 1TH 1 Thessalonians 5, 2TH 2 Thessalonians 3, 1TI 1 Timothy 6, "
    "2TI 2 Timothy 4, TIT Titus 3, PHM Philemon 1, HEB Hebrews 13, JAS James 5, 1PE 1 Peter 5, 2PE 2 Peter 3, 1JN 1 John 5, 2JN 2 John 1, 3JN 3 John 1, "
    "JUD Jude 1, REV Revelation 22"
)
FIRST_OF_SECOND_PART = "MAT"


def book_rows() -> list[tuple[str, str, int, int, str]]:
    out, part = [], "old"
    for order, entry in enumerate(BOOKS.split(", "), 1):
        code, *name, chapters = entry.split(" ")
        part = "new" if code == FIRST_OF_SECOND_PART else part
        out.append((code, " ".join(name), order, int(chapters), part))
    return out


def books(spark: SparkSession) -> DataFrame:
    """The book dimension: code, name, order, chapters, testament. 66 rows."""
    return spark.createDataFrame(book_rows(), "code string, name string, book_order int, chapters int, testament string")


def _lookup(column: Column, pairs: list[tuple]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in pairs for x in p]), column)


def _names() -> list[tuple[str, str]]:
    """Lower-case names without spaces, their starts of two letters or more where unambiguous, and codes."""
    rows, out = book_rows(), {}
    full = {r[1].lower().replace(" ", ""): r[0] for r in rows}
    for code, name, *_ in rows:
        key = name.lower().replace(" ", "")
        for n in range(3 if key[0].isdigit() else 2, len(key) + 1):
            if n == len(key) or sum(k.startswith(key[:n]) for k in full) == 1:
                out.setdefault(key[:n], code)
        out[code.lower()] = code
    return sorted(out.items())


def book_code(name: Column) -> Column:
    """The code of a book name, an unambiguous start of it, or a code, in any case; null if unknown."""
    key = F.regexp_replace(F.lower(F.trim(name)), r"[\s.]+", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in _names() for x in p]), key)


def parse_verse_id(text: Column) -> Column:
    """struct(book, chapter, verse, part) from ``GEN.1.1``, ``Genesis 1:1``, ``1 John 3:16a``; null if it is none."""
    t = F.trim(text)
    # a text with a semicolon is none, so those that match have three now; the end is that of $, and is left out of the part
    pattern = r"^((?:[123]\s*)?[A-Za-z]+(?:\s+of\s+[A-Za-z]+)?|[123]?[A-Za-z]{2,3})\.?\s*(\d+)[:.](\d+)([a-zA-Z])?(?:\r\n|[\n\r\u0085\u2028\u2029])?\z"
    fields = F.split(F.regexp_replace(F.when(~t.contains(";"), t), pattern, "$1;$2;$3;$4"), ";", -1)

    def read(f: Column) -> Column:
        part = F.lower(f[3])
        return F.struct(book_code(f[0]).alias("book"), f[1].try_cast("int").alias("chapter"), f[2].try_cast("int").alias("verse"), F.when(part != "", part).alias("part"))

    # lambdas compute their argument once, and not in one method of generated code, which the names make too long for the JVM to compile
    read_ = F.transform(F.filter(F.array(fields), lambda f: F.size(f) == 4), read)
    return F.get(F.filter(read_, lambda r: r["book"].isNotNull()), F.lit(0))


def is_valid(ref: Column) -> Column:
    """Chapter within the book, verse from 1, part a-z."""
    most = F.try_element_at(F.create_map(*[F.lit(x) for r in book_rows() for x in (r[0], r[3])]), ref["book"])
    return F.coalesce(ref["chapter"].between(F.lit(1), most) & (ref["verse"] >= 1) & (ref["part"].isNull() | ref["part"].rlike("^[a-z]$")), F.lit(False))


def canonical(ref: Column) -> Column:
    return F.when(ref.isNotNull(), F.concat(F.concat_ws(".", ref["book"], ref["chapter"].cast("string"), ref["verse"].cast("string")), F.coalesce(ref["part"], F.lit(""))))


def sort_key(ref: Column) -> list[Column]:
    """Canonical order: book, chapter, verse, whole verse before its parts."""
    order = F.try_element_at(F.create_map(*[F.lit(x) for r in book_rows() for x in (r[0], r[2])]), ref["book"])
    return [order.asc_nulls_last(), ref["chapter"].asc(), ref["verse"].asc(), ref["part"].asc_nulls_first()]


def expand_range(df: DataFrame, start: str, end: str, verses: DataFrame) -> DataFrame:
    """Each verse of ``verses`` (book, chapter, verse) between two parsed references, across chapters."""
    place = lambda c: F.struct(F.col(c)["chapter"], F.col(c)["verse"])
    same = F.col("v.book") == F.col(f"r.{start}")["book"]
    inside = F.struct("v.chapter", "v.verse").between(place(f"r.{start}"), place(f"r.{end}"))
    return df.alias("r").join(verses.alias("v"), same & inside)


def create_verse_id(book: Column, chapter: Column, verse: Column, part: Column) -> Column:
    """struct(book, chapter, verse, part) from a book's name or code and numbers; null unless it is valid."""
    code = book_code(book)
    ref = F.struct(code.alias("book"), chapter.cast("int").alias("chapter"), verse.cast("int").alias("verse"), part.alias("part"))
    return F.when(code.isNotNull() & is_valid(ref), ref)


def _place(ref: Column) -> Column:
    order = F.try_element_at(F.create_map(*[F.lit(x) for r in book_rows() for x in (r[0], r[2])]), ref["book"])
    return F.struct(order, ref["chapter"], ref["verse"], F.coalesce(ref["part"], F.lit("")))


def compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as ``a`` stands before, at or after ``b`` in canonical order; null if either is null."""
    return F.when(a.isNull() | b.isNull(), None).when(_place(a) < _place(b), -1).when(_place(a) == _place(b), 0).otherwise(1)


def verse_range(text: Column) -> Column:
    """struct(start, end) of ``GEN.1.1-GEN.1.5``, ``Genesis 1:1-5`` or two full references; null if the end is before the start."""
    t = F.trim(text)
    short = r"^(.*\d+):(\d+)\s*-\s*(\d+)$"
    sides = F.split(t, "-", -1)
    head = F.regexp_extract(t, short, 1)
    is_short = t.rlike(short)

    def side(i: int, number: int) -> Column:
        """One end; its text is chosen first, so that it is parsed once."""
        return parse_verse_id(F.when(is_short, F.concat(head, F.lit(":"), F.regexp_extract(t, short, number))).when(F.size(sides) == 2, F.get(sides, F.lit(i))))

    def checked(r: Column) -> Column:
        good = r["start"].isNotNull() & r["end"].isNotNull() & (compare(r["start"], r["end"]) <= 0) & (~r["short"] | (is_valid(r["start"]) & is_valid(r["end"])))
        return F.when(good, F.struct(r["start"].alias("start"), r["end"].alias("end")))

    # a lambda's argument is computed once, however often the checks use it
    both = F.struct(side(0, 2).alias("start"), side(1, 3).alias("end"), is_short.alias("short"))
    return F.get(F.transform(F.array(both), checked), F.lit(0))


def reference_spans(text: Column) -> Column:
    """``John 3:16; Matt 5:17-19, Gen 1 1`` as structs (book, chapter, verse, part, last, listed): each item is parsed once, by one match."""
    pattern = r"(?s)^([1-3]?\s*\w+)\.?\s+(\d+)[:.\s]\s*(\d+)(?:\s*-\s*(\d+))?.*$"

    def read(r: Column) -> Column:
        # an empty text costs a cast an exception
        number = lambda i: F.when(F.get(r["f"], F.lit(i)) != "", F.get(r["f"], F.lit(i)).try_cast("int"))
        verse = number(2)
        span = F.struct(r["book"].alias("book"), number(1).alias("chapter"), verse.alias("verse"), F.lit(None).cast("string").alias("part"), F.coalesce(number(3), verse).alias("last"), F.lit(True).alias("listed"))
        return F.when(r["book"].isNotNull(), F.array(span)).otherwise(F.transform(F.filter(F.array(parse_verse_id(r["item"])), lambda p: p.isNotNull()), alone))

    def alone(p: Column) -> Column:
        return F.struct(p["book"].alias("book"), p["chapter"].alias("chapter"), p["verse"].alias("verse"), p["part"].alias("part"), p["verse"].alias("last"), F.lit(False).alias("listed"))

    items = F.filter(F.transform(F.split(text, "[;,]", -1), lambda x: F.trim(x)), lambda x: x != "")
    # an item holds no semicolon, so only those that match have one now
    fields = F.transform(items, lambda x: F.struct(x.alias("item"), F.split(F.regexp_replace(x, pattern, "$1;$2;$3;$4"), ";", -1).alias("f")))
    named = F.transform(fields, lambda r: F.struct(r["item"].alias("item"), r["f"].alias("f"), F.when(F.size(r["f"]) == 4, book_code(r["f"][0])).alias("book")))
    return F.flatten(F.transform(named, read))


def span_verses(spans: Column, expand: bool = False) -> Column:
    """References of ``reference_spans``: of each its first verse, or with ``expand`` every verse; none of a reversed range."""

    def verses(r: Column) -> Column:
        ref = lambda v: F.struct(r["book"].alias("book"), r["chapter"].alias("chapter"), v.alias("verse"), r["part"].alias("part"))
        all_ = F.when(~r["listed"], F.array(r["verse"])).when(r["last"] >= r["verse"], F.sequence(r["verse"], r["last"]) if expand else F.array(r["verse"])).otherwise(F.array().cast("array<int>"))
        return F.transform(all_, ref)

    return F.flatten(F.transform(spans, verses))


def reference_list(text: Column, expand: bool = False) -> Column:
    """All references of ``John 3:16; Matt 5:17-19, Gen 1 1``, as structs; of a range its first verse, or with ``expand`` every verse."""
    return span_verses(reference_spans(text), expand)
