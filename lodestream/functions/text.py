"""Text splitting as column expressions: lines, slices of long lines, and chunks of whole lines with overlap.

All of it runs inside the JVM; a text is folded once, from left to right, in time that is nearly linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that strip() removes.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: What ends a sentence, by mode. "line" splits at newlines, and where the punctuation is followed by a literal \s.
BREAKS = {"line": r"([\\.?!])\\s+", "sentence": r"([.?!])\s+"}


def strip(text: Column) -> Column:
    """text without white space at its ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def lines(text: Column, mode: str = "line") -> Column:
    """Stripped, non-empty pieces of text between newlines; in mode "sentence" also after . ? ! and white space."""
    broken = F.regexp_replace(text, BREAKS[mode], "$1\n")
    return F.filter(F.transform(F.split(broken, "\n"), strip), lambda x: x != "")


def slice_step(max_size: int) -> int:
    """How far the slices of a long line start from each other. A tenth of a slice, or 50 characters, is shared."""
    step = max_size - max(50, int(max_size * 0.1))
    if step < 1:
        raise ValueError("max_size must be over 50, or long lines can't be sliced")
    return step


def slices(pieces: Column, max_size: int) -> Column:
    """pieces with every one longer than max_size cut into slices of that size."""
    step = slice_step(max_size)

    def cut(piece: Column) -> Column:
        starts = F.sequence(F.lit(1), F.char_length(piece), F.lit(step))
        return F.when(F.char_length(piece) > max_size, F.transform(starts, lambda at: F.substring(piece, at, F.lit(max_size)))).otherwise(F.array(piece))

    return F.flatten(F.transform(pieces, cut))


#: Pieces that are folded into one list of borders, at least.
FOLD_PIECES = 64
#: A border is one number: the first piece (from 1) times this, and how many pieces.
_BORDER = 1 << 31


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once; an expression that stands inside a lambda is computed for every element."""
    return F.transform(F.array(value), use)[0]


def _borders(lengths: Column, max_size: int, min_size: int, overlap: int) -> Column:
    """The chunks of pieces with these lengths, each as a border.

    A fold copies its state at every step, so what it has found so far is kept out of the way: pieces are folded in groups of
    about the square root of their number, and a group's borders are handed to the outer fold as one array."""
    longs, ints = "array<bigint>", "array<int>"

    def piece_step(s: Column, n: Column) -> Column:
        full = (s["size"] + n > max_size) & (s["held"] > 0)
        if overlap > 0:
            kept = F.when(s["held"] >= overlap, overlap).otherwise(0)
            shared = F.when(s["held"] >= overlap, F.aggregate(s["tail"], F.lit(0), lambda total, x: total + x + 1)).otherwise(0)
            tail = F.slice(F.concat(s["tail"], F.array(n)), F.greatest(F.lit(1), F.size(s["tail"]) + 2 - overlap), overlap)
        else:
            kept, shared, tail = F.lit(0), F.lit(0), F.array().cast(ints)
        border = (s["at"] - s["held"]).cast("bigint") * _BORDER + s["held"]
        return F.struct(
            (s["at"] + 1).alias("at"),
            (F.when(full, kept).otherwise(s["held"]) + 1).alias("held"),
            (F.when(full, F.greatest(shared - 1, F.lit(0))).otherwise(s["size"]) + n + 1).alias("size"),
            tail.alias("tail"),
            F.when(full, F.concat(s["found"], F.array(border))).otherwise(s["found"]).alias("found"),
        )

    def group_step(s: Column, group: Column) -> Column:
        none = F.array().cast(longs)
        start = F.struct(s["at"].alias("at"), s["held"].alias("held"), s["size"].alias("size"), s["tail"].alias("tail"), none.alias("found"))
        after = lambda r: F.struct(r["at"].alias("at"), r["held"].alias("held"), r["size"].alias("size"), r["tail"].alias("tail"), F.concat(s["done"], F.array(r["found"])).alias("done"))
        return _bound(F.aggregate(group, start, piece_step), after)

    def finish(s: Column) -> Column:
        last = (s["at"] - s["held"]).cast("bigint") * _BORDER + s["held"]
        found = F.flatten(s["done"])
        return F.when((s["held"] > 0) & (s["size"] >= min_size), F.concat(found, F.array(last))).otherwise(found)

    def fold(sizes: Column) -> Column:
        step = F.greatest(F.lit(FOLD_PIECES), F.floor(F.sqrt(F.size(sizes))).cast("int"))
        starts = F.when(F.size(sizes) > 0, F.sequence(F.lit(1), F.size(sizes), step)).otherwise(F.array().cast(ints))
        groups = F.transform(starts, lambda at: F.slice(sizes, at, step))
        zero = lambda name: F.lit(0).alias(name)
        start = F.struct(F.lit(1).alias("at"), zero("held"), zero("size"), F.array().cast(ints).alias("tail"), F.array().cast(f"array<{longs}>").alias("done"))
        return F.aggregate(groups, start, group_step, finish)

    return _bound(lengths, fold)


def merge(pieces: Column, max_size: int = 1000, min_size: int = 50, overlap: int = 1) -> Column:
    """Pack pieces from left to right into chunks joined by single spaces.

    A piece that would carry a chunk over max_size closes it; the next chunk starts with the last `overlap` pieces and takes
    that piece unchecked, so a chunk may be longer than max_size. A last chunk below min_size is dropped. The fold works on
    the pieces' lengths; texts are joined once the chunks' borders are known.
    """

    def cut(all_pieces: Column) -> Column:
        borders = _borders(F.transform(all_pieces, F.char_length), max_size, min_size, overlap)
        first, count = (lambda b: F.floor(b / _BORDER).cast("int")), (lambda b: F.pmod(b, F.lit(_BORDER)).cast("int"))
        return F.transform(borders, lambda b: F.array_join(F.slice(all_pieces, first(b), count(b)), " "))

    return F.when(pieces.isNotNull(), _bound(pieces, cut))


def chunks(text: Column, max_size: int = 1000, min_size: int = 50, overlap: int = 1, mode: str = "line") -> Column:
    """Chunks of a text: none of an empty or null one, the text itself (unstripped) if it is shorter than min_size."""
    none = F.array().cast("array<string>")
    return (
        F.when(F.coalesce(F.char_length(text), F.lit(0)) == 0, none)
        .when(F.char_length(text) < min_size, F.array(text))
        .otherwise(merge(slices(lines(text, mode), max_size), max_size, min_size, overlap))
    )
