"""Removal of duplicate lines, equal or within a few edits, by a segment-partition join.

Lines are linked by an edit distance of at most what the length of the shorter one allows
(``EDITS``: by bands of length, or one number for all); the first occurrence of a class
(by id, then position) stays and the others go. The join is built from DataFrame functions:

* each distinct line is cut into one segment more than the edits allowed at its length, all
  of even length. That many edits leave at least one segment of a similar line untouched;
* a line is probed for the segments of the lines it can reach (as long or shorter by the
  edits): each can have moved by a few positions only, bounded from both ends of the line.
  Entries stand for windows, as long as the shortest segment of the band: the least hash of
  the six substrings of one length inside the window, the same wherever the window has moved to.
  Windows that overlap mostly share it, so a line of six edits has some 20 entries, not
  one for each of its 128 windows. The window that has not moved is the line's own segment;
  own segments are the index, all windows the probes;
* counts of eight letters rule out most pairs inside the join: an edit changes them by
  two in all at most;
* what is left is verified: Spark's levenshtein with a threshold (a banded table) rules
  out, and bit-parallel edit distance in a band around the diagonal that ends in the
  corner, one machine word per column, decides on what two lines do not share at their
  beginnings and ends.

Equal lines are one line from the start, so a line in a third of all documents is one
index entry.

Equal lines go by their hash whatever their length; below the first band of ``EDITS`` only
they do. Lines under ``min_chars`` characters and blank ones take no part.

Defined results: NULL text stays NULL and empty text empty; blank lines stay; NULL
ids come last; rows with equal id and text are treated alike; documents of which
lines were removed and nothing but white space is left are dropped by ``dedup_lines``;
extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import components, fresh, semi_join, stored

# Edits allowed by length of the shorter line: (from so many characters, edits).
EDITS = ((20, 1), (40, 2), (80, 3), (120, 4), (160, 5), (200, 6))
Edits = int | tuple[tuple[int, int], ...]
LARGE_WINDOW = 32  # characters of a window from which longer lines need no larger one
LETTERS = "eantiros"  # the letters that are counted (a byte each in a long); any would be right, frequent ones rule out more


def _bands(max_edits: Edits, min_chars: int) -> list[tuple[int, int, int]]:
    """(from, below, edits) of the bands of line length that take part."""
    starts = [(min_chars, max_edits)] if isinstance(max_edits, int) else sorted(max_edits)
    ends = [start for start, _ in starts[1:]] + [1 << 31]
    return [(max(start, min_chars), end, k) for (start, k), end in zip(starts, ends, strict=True) if end > min_chars]


def _row(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _lines(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """id, row, pos, line, chars (its length), lid of the lines that take part."""
    lines = df.select(F.col(id_col).alias("id"), _row(id_col, text_col).alias("row"),
                      F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "line"))
    return lines.withColumn("chars", F.char_length("line")).filter((F.col("chars") >= min_chars) & F.col("line").rlike(r"\S")).withColumn("lid", F.xxhash64("line"))


def _first() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row", "pos"))


def _letter_counts(line: Column) -> Column:
    counts = F.lit(0).cast("long")
    for i, c in enumerate(LETTERS):
        n = (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c), F.lit("")))).cast("long")
        counts = counts.bitwiseOR(F.shiftleft(n.bitwiseAND(F.lit(255)), 8 * i))
    return counts


def _letters_apart(x: Column, y: Column) -> Column:
    """Sum of the differences of the letter counts (each modulo 256, so never too large)."""
    total = F.lit(0).cast("long")
    for i in range(len(LETTERS)):
        d = F.shiftright(x, 8 * i).bitwiseAND(F.lit(255)) - F.shiftright(y, 8 * i).bitwiseAND(F.lit(255))
        total = total + F.least(F.abs(d), 256 - F.abs(d))
    return total


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, inside a function of higher order too."""
    return F.transform(F.array(value), use)[0]


def _reach(edits: int, i: int) -> tuple[int, int]:
    """How far (least, most) segment ``i`` of a line that is shorter by 0 to ``edits`` can start from this line's own."""
    def start(n: int) -> int:
        return n // (edits + 1) * i + max(0, i - (edits + 1 - n % (edits + 1)))
    spans = [(start(n - shorter) - start(n) + max(-i, shorter - (edits - i)), start(n - shorter) - start(n) + min(i, shorter + edits - i))
             for n in range(2 * edits, 3 * edits + 1) for shorter in range(edits + 1)]  # any remainder of the length
    return min(least for least, _ in spans), max(most for _, most in spans)


def _windows(bands: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, str]]:
    """(start, end, edits, size of window, size of substring, segments with their reach, in SQL) by band of length."""
    out = []
    for start, end, edits in bands:
        while start < end:  # long lines have larger windows: cut where the length has doubled
            size = start // (edits + 1)
            until = end if size >= LARGE_WINDOW else min(max(1, 2 * start), end)
            segments = ", ".join("named_struct('i', {}, 'least', {}, 'most', {})".format(i, *_reach(edits, i)) for i in range(edits + 1))
            out.append((start, until, edits, size, max(min(size, 1), size - 5), f"array({segments})"))
            start = until
    return out


def line_entries(lines: DataFrame, bands: list[tuple[int, int, int]], index: bool) -> DataFrame:
    """Entries of lines (lid, line, chars): key, lid, chars, letters and edits.

    With ``index`` those of the line's own segments, else (the probes) those of all windows they can have moved to.
    """
    windows = ", ".join(
        f"named_struct('band', {n}, 'start', {start}, 'end', {end}, 'edits', {edits}, 'size', {size}, 'gram', {gram}, 'segments', {segments})"
        for n, (start, end, edits, size, gram, segments) in enumerate(_windows(bands)))
    # a probe may be longer than the lines it looks for
    fits = F.filter(F.expr(f"array({windows})"), lambda w: (F.col("chars") >= w["start"]) & (
        F.col("chars").cast("long") < w["end"] + (F.lit(0) if index else w["edits"]).cast("long")))
    band = lines.select("lid", "line", "chars", _letter_counts(F.col("line")).alias("letters"), F.explode(fits).alias("w"))
    part = band.select("lid", "line", "chars", "letters", "w.band", "w.edits", "w.size", "w.gram", F.explode("w.segments").alias("s"))
    k = F.col("edits") + 1
    base, more = F.floor(F.col("chars") / k).cast("int"), F.col("chars") % k
    own = base * F.col("s.i") + F.greatest(F.lit(0), F.col("s.i") - (k - more))
    part = part.withColumn("own", own)
    least = F.col("own") if index else F.greatest(F.lit(0), F.col("own") + F.col("s.least"))
    most = F.col("own") if index else F.least(F.col("chars") - F.col("size"), F.col("own") + F.col("s.most"))
    part = part.select("lid", "line", "chars", "letters", "band", "edits", "size", "gram", F.col("s.i").alias("i"),
                       least.alias("least"), (most - least).alias("moves"))
    piece = F.substring(F.col("line"), F.col("least") + 1, F.col("moves") + F.col("size"))
    several = F.col("size") - F.col("gram") + 1

    # bound by _let: a column that is used inside a function of higher order would be computed in each step
    def hashes(piece: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.col("moves") + F.col("size") - F.col("gram") + 1),
                           lambda p: F.xxhash64(F.substring(piece, p, F.col("gram"))))

    def mins(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("moves")), lambda t: F.array_min(F.slice(hashes, t + 1, several)))

    least = _let(piece, lambda piece: F.array_min(hashes(piece)) if index else _let(hashes(piece), mins))
    part = part.withColumn("least", least)
    if not index:
        part = part.withColumn("least", F.explode(F.array_distinct("least")))
    return part.select(F.xxhash64("least", "band", "i").alias("key"), "lid", "chars", "letters", "edits")


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _shared(x: Column, y: Column) -> Column:
    """How many characters two strings share at their beginnings (of lines above 131,071 maybe fewer)."""
    most = F.least(F.char_length(x), F.char_length(y))
    steps = F.array(*(F.lit(1 << i) for i in range(16, -1, -1)))
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(
        (n + step <= most) & (F.substring(x, n + 1, step) == F.substring(y, n + 1, step)), n + step).otherwise(n))


def edit_distance_within(rows: Column, columns: Column, max_edits: int, limit: Column | None = None) -> Column:
    """True if the edit distance of two strings, the first the longer or as long, is at most ``max_edits`` (30 at most).

    With ``limit``, at most that (and ``max_edits``, the width of the band).
    The strings are arrays of characters in columns of their own: an expression here would be computed in each step.
    Bit r of a word stands for row j - max_edits + r of column j of the distance table; ``up`` and ``down`` hold
    the vertical steps of +1 and -1 there. The distance is followed along the diagonal that ends in the corner:
    it grows by one in each column whose diagonal step is not free.
    """
    width = 2 * max_edits + 1
    full = (1 << width) - 1
    extra = F.size(rows) - F.size(columns)

    def column(state: Column, j: Column) -> Column:
        c, up, down = F.get(columns, j - 1), state["up"], state["down"]
        same = F.lit(0).cast("long")
        for r in range(width):
            same = same + F.when(F.get(rows, j - 1 - max_edits + r) == c, F.lit(1 << r)).otherwise(F.lit(0)).cast("long")

        def steps(free: Column) -> Column:
            right = down.bitwiseOR(F.bitwise_not(free.bitwiseOR(up)).bitwiseAND(F.lit(full)))
            left, below = free.bitwiseAND(up), F.shiftright(free, 1)
            return F.struct(
                left.bitwiseOR(F.bitwise_not(below.bitwiseOR(right)).bitwiseAND(F.lit(full))).alias("up"),
                below.bitwiseAND(right).alias("down"),
                (state["distance"] + 1 - F.getbit(free, (extra + max_edits).cast("int"))).alias("distance"))

        return _let(same, lambda same: _let(
            (same.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(same).bitwiseOR(down).bitwiseAND(F.lit(full)), steps))

    start = F.struct(F.lit(full & ~((1 << max_edits) - 1)).cast("long").alias("up"), F.lit(0).cast("long").alias("down"),
                     extra.cast("long").alias("distance"))
    steps = F.when(F.size(columns) > 0, F.sequence(F.lit(1), F.size(columns))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(steps, start, column, lambda s: s["distance"])
    return F.when(extra.between(0, max_edits), end <= (max_edits if limit is None else limit)).otherwise(F.lit(False))


def similar_lines(lines: DataFrame, first: DataFrame, max_edits: Edits, min_chars: int) -> DataFrame:
    """Links (a, b) between different lines. ``first``: lid, first of the lines that occur more than once."""
    bands = _bands(max_edits, min_chars)
    most = max(edits for _, _, edits in bands)
    lines = lines.filter(F.col("chars") >= bands[0][0])
    few = first.count() <= 500_000  # sent to every executor only up to that many rows
    repeated = F.broadcast(first) if few else first
    one_each = (lines.join(repeated, "lid", "left")
                .filter("first IS NULL OR (first.row = row AND first.pos = pos)").select("lid", "line", "chars"))
    x, y = line_entries(one_each, bands, False).alias("x"), line_entries(one_each, bands, True).alias("y")
    shorter = F.col("x.chars") - F.col("y.chars")
    close = _letters_apart(F.col("x.letters"), F.col("y.letters")) <= 2 * F.col("y.edits")
    other = (shorter <= F.col("y.edits")) & ((shorter > 0) & (F.col("x.lid") != F.col("y.lid")) | (shorter == 0) & (F.col("x.lid") < F.col("y.lid")))
    pairs = stored(x.join(y, (F.col("x.key") == F.col("y.key")) & other & close)
                   .select(F.col("x.lid").alias("a"), F.col("y.lid").alias("b"), F.col("y.edits").alias("edits")).distinct(), "line-pairs")

    needed = stored(pairs.select(F.col("a").alias("lid")).union(pairs.select("b")).distinct(), "line-ids")
    texts = stored(semi_join(one_each, needed, "lid").dropDuplicates(["lid"]), "line-texts")
    both = (pairs.join(texts.select(F.col("lid").alias("a"), F.col("line").alias("line_a")), "a")
            .join(texts.select(F.col("lid").alias("b"), F.col("line").alias("line_b")), "b"))
    # the bit-parallel form takes some 25 microseconds a character here, so Spark's banded levenshtein rules out first
    ruled_in = F.lit(False)
    for edits in sorted({edits for _, _, edits in bands}):
        ruled_in = F.when(F.col("edits") == edits, F.levenshtein("line_a", "line_b", edits) >= 0).otherwise(ruled_in)
    both = both.filter(ruled_in)
    tasks = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are few bytes but some work each
    both = both.repartition(tasks)
    for _ in range(2):  # without what they share at the beginnings, then, reversed, at the ends: the distance is the same
        shared = _shared(F.col("line_a"), F.col("line_b")) + 1
        both = both.withColumn("shared", shared).select("a", "b", "edits", *(
            F.reverse(F.substring(c, F.col("shared"), F.char_length(c))).alias(c) for c in ("line_a", "line_b")))
    both = both.select("a", "b", "edits", characters(F.col("line_a")).alias("rows"), characters(F.col("line_b")).alias("columns"))
    # the verdict is a stored column, not a filter: the optimizer would reason about so large a condition for minutes
    near = edit_distance_within(F.col("rows"), F.col("columns"), most, F.col("edits")).alias("near")
    return stored(both.select("a", "b", near), "line-verdicts").filter("near").select("a", "b")


def mark_duplicate_lines(df: DataFrame, max_edits: Edits = EDITS, min_chars: int = 1, id_col: str = "doc_id",
                         text_col: str = "text", drop_col: str = "drop_lines") -> DataFrame:
    """``df`` with ``drop_col``: positions (from 0) of the lines that an earlier line of their class repeats."""
    lines = _lines(df, id_col, text_col, min_chars)
    occurrences = stored(lines.select("id", "row", "pos", "lid"), "line-occurrences")
    first = occurrences.groupBy("lid").agg(F.count("*").alias("n"), _first().alias("first"))
    repeated = stored(first.filter("n > 1").select("lid", "first"), "repeated-lines")
    links = stored(similar_lines(lines, repeated, max_edits, min_chars), "line-links")
    classes = components(links, "line-classes").select(F.col("node").alias("lid"), "component")
    in_class = (classes.join(first.select("lid", "first"), "lid"))
    class_first = in_class.groupBy("component").agg(F.min("first").alias("class_first"))
    kept = in_class.join(class_first, "component").select("lid", F.col("class_first").alias("first"))
    # every line that is not alone, with the occurrence of its class that stays
    kept = stored(kept.union(repeated.join(classes, "lid", "left_anti").select("lid", "first")), "line-firsts")
    row = fresh(df, "line_row")
    drops = (occurrences.join(kept, "lid").filter("NOT (first.row = row AND first.pos = pos)")
             .groupBy(F.col("row").alias(row)).agg(F.collect_set("pos").alias(drop_col)))
    return (df.withColumn(row, _row(id_col, text_col)).join(drops, row, "left")
            .select(*(F.col(f"`{c}`") for c in df.columns), F.coalesce(drop_col, F.array().cast("array<int>")).alias(drop_col)))


def without_lines(text: Column, drop: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(drop, i))
    return F.when(F.size(drop) == 0, text).otherwise(F.concat_ws("\n", kept))


def dedup_lines(df: DataFrame, max_edits: Edits = EDITS, min_chars: int = 1, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``df`` with the duplicate lines of its texts removed, without documents that lost all their text."""
    drop = fresh(df, "drop_lines")
    marked = mark_duplicate_lines(df, max_edits, min_chars, id_col, text_col, drop)
    marked = marked.withColumn(text_col, without_lines(F.col(text_col), F.col(drop)))
    return marked.filter((F.size(drop) == 0) | F.col(text_col).rlike(r"\S")).drop(drop)
