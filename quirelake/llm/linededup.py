"""Removal of passages that repeat across documents.

Native: everything is DataFrame expressions.  A text is cut into lines: at line breaks,
at ends of sentences, and within longer ones by content, that is at blanks and inside
long tokens where the characters around them fall into classes that a hash of their
codes has dealt (``_dealt``).  So lines do not depend on what stands around a pasted
passage, in any alphabet.  Each line is hashed; a rolling hash over two lines in a row
chooses the chunk boundaries, at its local minima.  A boundary depends on four lines
only and there is one in every two to six, so a chunk spans several lines and the
boundaries inside a passage are the same in every document.

Chunks only find passages (seeds), by the hash of all their lines' hashes.  Of a chunk that
several documents hold, the document with the smallest key is the keeper.  From its
chunks each other document is compared, line by line and in the outermost lines word by
word, with one and the same keeper; a stretch of whole lines of ``min_bytes`` bytes or
more is removed, with the words of its outer lines that are equal too.  Only hashes are
shuffled for all chunks; texts only where chunks are equal.

Skew: frequent chunks are reduced where they are read; a chunk or passage that holds
more than 1/4096 of the rows (so at most 4096 of them) is joined by a broadcast of its
few numbers, or its rows are dealt over copies of its text.

A stretch that ends with up to three words of the next line or sentence, or begins
with up to three of the one before, leaves those: so many are equal by chance.

Defined cases: null and empty texts stay as they are; a repeated document loses
what it shares with the one of smallest key, and a document that loses all its
words is dropped; rows with the same key count as one document; rows with a null
key come after all others, by the hash of their text, and rows with the same key and
text are one; lines are equal if their bytes are, so text that is wrapped in another
way is another text; other columns are returned as they are, whatever their names; an
empty table gives an empty result; a text of any length is one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _dealt(share: int, salt: int, rest: str) -> str:
    """Characters of a regex class: ``share`` of 16 of the visible ones up to U+00FF, by a multiplicative hash of the code, and ``rest``."""
    own = [c for c in range(0x21, 0x100) if (c * 2654435761 + salt * 0x9E3779B9 >> 11) % 16 < share]
    return "".join(f"\\x{c:02x}" for c in own) + rest


#: Beyond U+00FF: all characters, and half of the blocks of 64.
_ALL = r"\x{100}-\x{10FFFF}"
_HALF = "".join(f"\\x{{{c:x}}}-\\x{{{c + 63:x}}}" for c in range(0x100, 0x10000, 64) if not 0xD800 <= c < 0xE000 and (c * 2654435761 >> 17) % 2)
#: Where a line begins: at a line break; at a blank after the end of a sentence, or between two characters of the classes.
BREAK = rf"(?<=[{_dealt(9, 2, _ALL)}.!?\u3002])[ \t](?:[{_dealt(8, 1, _ALL)}]|(?<=[.!?\u3002].))|\n(?<=[^\n].)"
#: A line: its first character and on to where the next begins. Characters from "!" to U+D7FF are passed over in one loop.
LINE = rf"(?s).[!-\x{{D7FF}}]*(?:(?!{BREAK}).[!-\x{{D7FF}}]*)*+"
#: And, in lines of more than LONG_LINE bytes, within tokens of more than 32 characters: after three characters of a class.
LONG_LINE, LONG_TOKEN, _SIGN = 64, r"\S{33}", _dealt(6, 3, _HALF)
WITHIN = rf"(?<=[{_SIGN}][{_SIGN}][{_SIGN}])(?=\S)(?<=\S{{32}})"
PART = rf"(?s).(?:(?!{WITHIN}).)*+"
#: Where a word begins; the blanks before it belong to it.
WORD = r"(?<=[^ \t\n\r])(?=[ \t\n\r])"
BLANKS = " \t\n\r"
GAP = "[ \\t\\n\\r]+"
#: Least bytes of a line that is a chunk by itself.
LONE_BYTES = 20
#: Phrases beyond the outermost equal chunks that are compared, and the grid of such pieces.
REACH, GRID = 8, 16
#: A key with more than one in so many rows is dealt over several tasks.
HOT_SHARE = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bare(word: Column) -> Column:
    return F.trim(word, F.lit(BLANKS))


def _lines(text: Column) -> Column:
    """Lines of a text but for those within long tokens. Spark compiles this pattern once a task, that of a split once a text."""
    return F.regexp_extract_all(text, F.lit(LINE), 0)


def _finer(lines: Column) -> Column:
    """Lines with long tokens cut within these."""
    wide = lambda line: (F.octet_length(line) > LONG_LINE) & line.rlike(LONG_TOKEN)
    finer = F.flatten(F.transform(lines, lambda x: F.when(wide(x), F.regexp_extract_all(x, F.lit(PART), 0)).otherwise(F.array(x))))
    return F.when(F.exists(lines, wide), finer).otherwise(lines)


def _phrases(text: Column) -> Column:
    """Array of the lines of a text; joined they give the text."""
    return _let(_lines(text), _finer)


def _words(text: Column) -> Column:
    """Array of the words of a text with the blanks before them; joined they give the text."""
    return F.split(text, WORD, -1)


def _ends(phrase: Column, following: Column) -> Column:
    """Whether a line or sentence ends with the phrase."""
    return F.coalesce(phrase.endswith(".") | phrase.endswith("!") | phrase.endswith("?") | following.startswith("\n"), F.lit(False))


def _joined(parts: Column, start: Column, end: Column) -> Column:
    """Text of the parts from ``start`` to before ``end``."""
    return F.when(end > start, F.array_join(F.slice(parts, start + 1, end - start), "")).otherwise("")


def _hashes(p: Column) -> Column:
    return F.transform(p, lambda x: F.xxhash64(x))


def _cuts(h: Column) -> Column:
    """Array of the first lines of the chunks, and behind it the number of lines, by the hashes of the lines."""

    def least(r: Column) -> Column:
        # Beside a missing neighbour the comparison is null, so the ends of a text are no minima.
        return F.transform(r, lambda x, i: F.when((x < F.get(r, i - 1)) & (x <= F.get(r, i + 1)), i))

    # Rolling, of each two lines in a row: the next one comes in and the first goes out by one exclusive or each.
    rolling = F.zip_with(h, F.slice(h, F.lit(2), F.size(h)), lambda x, y: x.bitwiseXOR(y))
    return F.concat(F.array(F.lit(0)), F.array_compact(_let(rolling, least)), F.array(F.size(h)))


def _chunk(p: Column, h: Column, k: Column, to: Column) -> Column:
    """struct(h hash of its lines' hashes, p first line, n lines, l bytes of its outer lines) of the chunk from line ``k`` to before ``to``."""
    outer = F.octet_length(F.get(p, k)) + F.when(to - k > 1, F.octet_length(F.get(p, to - 1))).otherwise(0)
    return F.struct(F.xxhash64(F.slice(h, k + 1, to - k)).alias("h"), k.alias("p"), (to - k).alias("n"), outer.alias("l"))


def chunk_marks(text: Column) -> Column:
    """Array of the chunks of a text, as ``_chunk`` gives them."""

    def chunks(p: Column, h: Column, c: Column) -> Column:
        # The cuts ascend, from the first phrase to behind the last.
        return F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda k, to: _chunk(p, h, k, to))

    return _let(_phrases(text), lambda p: _let(_hashes(p), lambda h: _let(_cuts(h), lambda c: chunks(p, h, c))))


def marks_of(rows: DataFrame) -> DataFrame:
    """doc, row and the chunks of the texts ``body``: those of ``chunk_marks``, one a row.

    Each step is a projection of its own: nested, every level would copy all lines.  The
    chunks are taken behind the generator, where Spark compiles them.
    """
    lines = rows.select("doc", "row", _lines(F.col("body")).alias("s")).select("doc", "row", _finer(F.col("s")).alias("s"))
    cuts = lines.select("doc", "row", "s", _hashes(F.col("s")).alias("x")).select("doc", "row", "s", "x", _cuts(F.col("x")).alias("c"))
    at = cuts.select("doc", "row", "s", "x", "c", F.explode(F.sequence(F.lit(0), F.size("c") - 2)).alias("i"))
    chunk = _chunk(F.col("s"), F.col("x"), F.get("c", F.col("i")), F.get("c", F.col("i") + 1))
    return at.select("doc", "row", chunk.alias("m")).select("doc", "row", "m.*")


def _equal_words(ours: Column, theirs: Column, at_end: bool) -> Column:
    """Number of equal words at the begin or at the end of two phrases; 0 beside a missing phrase."""
    bare = lambda p: F.split(F.ltrim(p, F.lit(BLANKS)), GAP, -1)
    side = (lambda p: F.reverse(bare(p))) if at_end else bare
    same = F.zip_with(side(ours), side(theirs), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(_let(same, lambda s: F.coalesce(F.nullif(F.array_position(s, False), F.lit(0)) - 1, F.size(s).cast("long"))), F.lit(0)).cast("int")


def _stretches(ours: Column, found: Column, min_bytes: int) -> Column:
    """Array of struct(s, e): from place s to before place e our words are those of a keeper.

    A place is struct(i phrase, w word in it).  ``found`` is an array of
    struct(k lines of the keeper, at line of ours where they begin).
    """

    def unequal(x: Column) -> Column:
        def differs(i: Column) -> Column:
            return ~F.coalesce(F.get(x["k"], i) == F.get(ours, i + x["at"]), F.lit(False))

        def run(i: Column, j: Column) -> Column:
            begin, end = i + x["at"] + 1, F.get(bad[0], j + 1) + x["at"]
            return F.when(end > begin, F.struct(begin.alias("a"), end.alias("b"), F.get(x["k"], i).alias("before"), F.get(x["k"], F.get(bad[0], j + 1)).alias("after")))

        bad: list[Column] = []

        def runs(b: Column) -> Column:
            bad.append(b)
            return F.filter(F.transform(b, run), lambda r: r.isNotNull())

        return F.transform(_let(F.filter(F.sequence(F.lit(-1), F.size(x["k"])), differs), runs), edges)

    def edges(r: Column) -> Column:
        # Words are compared beside long runs only.
        before, after = F.get(ours, r["a"] - 1), F.get(ours, r["b"])
        value = F.struct(r["a"].alias("a"), r["b"].alias("b"), _equal_words(before, r["before"], True).alias("t"), _equal_words(after, r["after"], False).alias("h"))
        long = lambda body: (F.octet_length(body) >= min_bytes) & (F.octet_length(F.trim(body, F.lit(BLANKS))) >= min_bytes)
        return F.when(_let(_joined(ours, r["a"], r["b"]), long), _let(value, lambda v: place(v, before)))

    def place(v: Column, before: Column) -> Column:
        # Up to three words of the sentence before or behind may be equal by chance.
        tail = F.when((v["t"] > 3) | ~_ends(before, F.get(ours, v["a"])), v["t"]).otherwise(0)
        head = F.when((v["h"] > 3) | ~_ends(F.get(ours, v["b"] - 1), F.get(ours, v["b"])), v["h"]).otherwise(0)
        first = F.when(tail > 0, F.struct((v["a"] - 1).alias("i"), (F.size(_words(before)) - tail).alias("w")))
        return F.struct(F.coalesce(first, F.struct(v["a"].alias("i"), F.lit(0).alias("w"))).alias("s"), F.struct(v["b"].alias("i"), head.alias("w")).alias("e"))

    return F.filter(F.flatten(F.transform(found, unequal)), lambda r: r.isNotNull())


def _without(text: Column, found: Column, min_bytes: int) -> Column:
    """The text without the stretches that ``found`` shows; null if there are none."""

    def rest(p: Column, cuts: Column) -> Column:
        begin = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("w")))
        end = F.array(F.struct(F.size(p).alias("i"), F.lit(0).alias("w")))
        to = F.concat(F.transform(cuts, lambda c: c["s"]), end)
        kept = _let(F.concat(begin, F.transform(cuts, lambda c: c["e"])), lambda e: F.transform(to, lambda t, j: piece(p, F.array_max(F.slice(e, F.lit(1), j + 1)), t)))
        return F.when(F.size(cuts) > 0, _bare(F.array_join(kept, "")))

    def piece(p: Column, a: Column, b: Column) -> Column:
        of = lambda i: F.coalesce(_words(F.get(p, i)), F.array().cast("array<string>"))
        within = _let(of(a["i"]), lambda w: _joined(w, a["w"], b["w"]))
        first = F.when(a["w"] == 0, F.get(p, a["i"])).otherwise(_let(of(a["i"]), lambda w: _joined(w, a["w"], F.size(w))))
        last = F.when(b["w"] > 0, _let(of(b["i"]), lambda w: _joined(w, F.lit(0), b["w"]))).otherwise("")
        return F.when(a >= b, "").when(a["i"] == b["i"], within).otherwise(F.concat(first, _joined(p, a["i"] + 1, b["i"]), last))

    return _let(_phrases(text), lambda p: _let(F.sort_array(_stretches(p, found, min_bytes)), lambda cuts: rest(p, cuts)))


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_bytes: int = 120, length: str | None = None) -> DataFrame:
    """``docs`` without the passages of ``min_bytes`` bytes or more that a document of smaller key holds too.

    ``length`` names a column of ``docs`` to be set to the length of a changed text.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    d = docs.alias("d")
    body, doc = F.col(f"d.`{text}`").cast("string"), F.col(f"d.`{key}`")
    # The hash of a row is taken below the generator; beside it, it would be taken of the whole text for each chunk.
    rows = d.filter(F.octet_length(body) > 0).select(doc.alias("doc"), F.xxhash64(body).alias("row"), body.alias("body"))
    marks = scratch.table(marks_of(rows).filter((F.col("n") > 1) | (F.col("l") >= LONE_BYTES)), "marks", hashes=("h",))

    # By hash: which chunks are held by several documents, and by which first.
    free = F.when(F.col("doc").isNull(), F.col("row"))
    ends = marks.groupBy("h").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.min(free).alias("nlow"), F.max(free).alias("nhigh"), F.count("*").alias("rows"))
    several = F.coalesce(F.col("low") < F.col("high"), F.lit(False)) | (F.col("nlow").isNotNull() & (F.col("low").isNotNull() | (F.col("nlow") < F.col("nhigh"))))
    repeated = scratch.table(ends.filter(several).select("h", "low", "nlow", "rows"), "repeated")
    first = F.when(F.col("low").isNotNull(), F.col("doc") == F.col("low")).otherwise(F.col("row") == F.col("nlow"))
    later = F.when(F.col("low").isNotNull(), F.coalesce(F.col("doc") > F.col("low"), F.lit(True))).otherwise(F.col("row") > F.col("nlow"))
    # The rows of a hot chunk are dealt over lots; at most HOT_SHARE chunks are hot, so what is broadcast is bounded.
    size = _lot(repeated, "rows")
    lots = F.coalesce(F.col("lots"), F.lit(1))
    hot = F.broadcast(repeated.filter(F.col("rows") > size).select("h", F.ceil(F.col("rows") / size).cast("int").alias("lots")))
    copies = F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot")
    dealt = marks.join(hot, "h", "left").withColumn("lot", F.pmod(F.xxhash64("doc", "row"), lots.cast("long")).cast("int")).drop("lots")
    wanted = repeated.withColumn("lots", F.ceil(F.col("rows") / size).cast("int")).select("h", "low", "nlow", "lots", copies)
    held = scratch.table(dealt.join(wanted.hint("shuffle_hash"), ["h", "lot"]), "held")
    for name in ("marks", "repeated"):
        scratch.drop(name)
    keeper = held.filter(first).groupBy("h").agg(F.min(F.struct("row", "p")).alias("k"), F.first("lots").alias("lots"))
    keeper = keeper.select("h", F.col("k.row").alias("krow"), F.col("k.p").alias("q"), copies)
    both = held.filter(later).join(keeper, ["h", "lot"]).select("doc", "row", "low", "krow", "p", "q", "n", "l")
    low, high = F.min("q") - REACH, F.max(F.col("q") + F.col("n")) + REACH
    places = both.groupBy("doc", "row", "low", "krow", (F.col("p") - F.col("q")).alias("shift")).agg(
        (F.floor(F.greatest(low, F.lit(0)) / GRID) * GRID).cast("int").alias("from"), (F.ceil(high / GRID) * GRID).cast("int").alias("to"), F.sum("l").alias("l")
    )
    # Three quarters of a passage may lie in chunks that reach beyond it.
    places = places.filter(F.col("l") >= min_bytes // 4).drop("l")
    places = scratch.table(places, "places")
    scratch.drop("held")

    # By bytes: the keepers' texts at those places, once for each place, to the documents they are compared with.
    place = ["low", "krow", "from", "to"]
    asked = scratch.table(places.groupBy(*place).agg(F.count("*").alias("rows")), "asked")
    lots = F.ceil(F.col("rows") / _lot(asked, "rows")).cast("int")
    asked = asked.withColumn("lots", lots)
    spots = asked.groupBy("low", "krow").agg(F.collect_list(F.struct("from", "to", "lots")).alias("at")).alias("w")
    same = doc.eqNullSafe(F.col("w.low")) & (F.xxhash64(body) == F.col("w.krow"))
    cut = _let(_phrases(body), lambda p: F.transform("w.at", lambda x: x.withField("k", F.slice(p, x["from"] + 1, x["to"] - x["from"]))))
    shown = d.join(spots.hint("shuffle_hash"), same).select("w.low", "w.krow", F.explode(cut).alias("x")).select("low", "krow", "x.*")
    shown = shown.withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).drop("lots")
    shown = scratch.table(shown, "shown", hashes=("k.list.element",))
    dealt = _null_safe(places.alias("p"), F.broadcast(asked.filter("lots > 1")).alias("q"), place, "left")
    dealt = dealt.select("p.*", F.coalesce(F.pmod(F.xxhash64("p.doc", "p.row"), F.col("q.lots").cast("long")), F.lit(0)).cast("int").alias("lot"))
    found = _null_safe(dealt.alias("p"), shown.alias("q"), [*place, "lot"], "inner")
    found = found.groupBy("p.doc", "p.row").agg(F.collect_set(F.struct(F.col("q.k").alias("k"), (F.col("p.from") + F.col("p.shift")).alias("at"))).alias("found"))
    found = scratch.table(found, "found").alias("g")
    for name in ("places", "asked", "shown"):
        scratch.drop(name)

    same = doc.eqNullSafe(F.col("g.doc")) & (F.xxhash64(body) == F.col("g.row"))
    joined = d.join(found.hint("shuffle_hash"), same, "left")
    new = _let(F.when(F.col("g.found").isNotNull(), _without(body, F.col("g.found"), min_bytes)), lambda t: F.array(F.struct(F.coalesce(t, body).alias("t"), t.isNotNull().alias("changed"))))
    # A generator computes the new text once; a row that has lost all its words gives none.
    rows = F.explode(F.filter(new, lambda x: ~x["changed"] | (F.length(_bare(x["t"])) > 0)))
    changed = joined.select(F.struct(*[F.col(f"d.`{c}`") for c in docs.columns if c != text]).alias("rest"), rows.alias("new"))

    def column(c: str) -> Column:
        if c == text:
            return F.col("new.t").alias(c)
        if c == length:
            return F.when(F.col("new.changed"), F.length("new.t")).otherwise(F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"rest.`{c}`").alias(c)

    return changed.select(*[column(c) for c in docs.columns])


def _lot(df: DataFrame, rows: str) -> int:
    """Rows from which a key is hot; at most HOT_SHARE keys have so many."""
    return max(1000, (df.agg(F.sum(rows)).first()[0] or 0) // HOT_SHARE)


def _null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join of ``a`` (alias p) and ``b`` (alias q) in which null keys are equal."""
    condition = F.lit(True)
    for c in on:
        condition = condition & F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    return a.join(b, condition, how)
